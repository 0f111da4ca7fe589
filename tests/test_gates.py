"""Gates and audits: each reason once, and nothing against good rows."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from infratrace.functions import sql
from infratrace.functions.ids import sha256_text
from infratrace.operators import audit, background, corpus, features, mining, pivots, prospective, rules, timeline

T0 = datetime(2026, 1, 1)


def day(n):
    return T0 + timedelta(days=n)


def reasons(df, key):
    return {r[key]: r["reason"] for r in df.collect()}


def codes(df):
    return {(r["code"], r["record_id"]) for r in df.collect()}


def frame(spark, schema, *rows):
    return spark.createDataFrame(list(rows), schema)


REVIEW = "assertion_id string, review_id string, decision string, reviewed_role string, source_confidence double, extraction_confidence double, role_confidence double, reviewed_at timestamp, reviewer_id string"


def reviews(spark, *rows):
    return frame(spark, REVIEW, *[(a, f"r-{a}", d, role, s, 0.9, 0.9, t, "me") for a, d, role, s, t in rows])


def test_accepted_sources(spark):
    names = ["ok", "none", "no", "lost", "late", "family"]
    a = frame(spark, "assertion_id string, indicator_id string, document_id string, source_mention_id string, role string, available_at timestamp", *[(n, "i", "other" if n == "family" else "d", "gone" if n == "lost" else "m", "c2", day(9) if n == "late" else T0) for n in names])
    r = reviews(spark, *[(n, "rejected" if n == "no" else "accepted", None, 0.5, day(1)) for n in names if n != "none"])
    m = frame(spark, "mention_id string, scope string, source_family_id string, document_id string", ("m", "domain", "f", "d"))
    i = frame(spark, "indicator_id string, normalized_value string", ("i", "a.b"))
    f = frame(spark, "document_id string, source_family_id string", ("d", "f"), ("other", "f"))
    told = pivots.accepted_sources(a, r, m, i, f, F.lit(day(5)))
    assert reasons(told, "assertion_id") == {"ok": None, "none": "review_missing", "no": "review_not_accepted", "lost": "mention_missing", "late": "available_after_cutoff", "family": "family_mismatch"}
    assert told.where("assertion_id = 'ok'").collect()[0]["role"] == "c2"


def test_assertion_reviews(spark):
    a = frame(spark, "assertion_id string, available_at timestamp", *[(n, day(1)) for n in ("ok", "early", "role", "zero", "twice")])
    r = reviews(spark, ("ok", "accepted", "c2", 0.5, day(2)), ("early", "accepted", "c2", 0.5, T0), ("role", "accepted", "victim", 0.5, day(2)), ("zero", "accepted", "c2", 0.0, day(2)), ("twice", "accepted", "c2", 0.5, day(2)), ("twice", "rejected", "c2", 0.5, day(2)), ("who", "accepted", "c2", 0.5, day(2)))
    assert reasons(corpus.assertion_review_gate(r, a), "assertion_id") == {"ok": None, "early": "review_predates_subject", "role": "role_not_allowed", "zero": "confidence_missing", "twice": "reviewed_twice", "who": "unknown_subject"}


def test_bundle_and_assertion_audit(spark):
    i = frame(spark, "indicator_id string", ("i",))
    h = "a" * 64
    mention = "mention_id string, indicator_id string, document_id string, source_family_id string, raw_form_hash string, context_excerpt_hash string, observed_at timestamp, available_at timestamp"
    m = frame(spark, mention, ("m", "i", "d", "f", h, h, T0, T0), ("x", "gone", "d", "f", h, h, T0, T0), ("y", "i", "d", "g", "bad", h, T0, T0))
    a = frame(spark, "assertion_id string, source_mention_id string, indicator_id string, document_id string, available_at timestamp", ("ok", "m", "i", "d", T0), ("lost", "none", "i", "d", T0), ("diff", "m", "i", "e", T0))
    f = frame(spark, "document_id string, source_family_id string", ("d", "f"))
    q = frame(spark, "query_id string, registered_at timestamp, source_assertion_ids array<string>", ("q", day(3), ["ok"]), ("none", T0, []), ("bad", day(-1), ["diff"]))
    told = audit.audit_assertions(m, a, reviews(spark, ("ok", "accepted", "c2", 0.5, day(1))), i, f, q)
    assert codes(told) == {("mention_indicator_missing", "x"), ("mention_family_mismatch", "y"), ("invalid_source_mentions", "y"), ("assertion_mention_missing", "lost"), ("assertion_mention_differs", "diff"), ("query_lacks_assertion_provenance", "none"), ("query_uses_unaccepted_assertion", "bad"), ("query_predates_assertion_availability", "bad")}
    assert audit.counts(told).count() == 8


def test_event_gates(spark):
    schema = "event_id string, opportunity_id string, entity_epoch_id string, api_schema_version string, dataset_split string, raw_manifest_hash string"
    good = ("o", "e", "v1", "prospective_test", "a" * 64)
    rows = {"ok": good, "opp": ("x", *good[1:]), "epoch": ("o", "other", *good[2:]), "api": ("o", "e", "v2", *good[3:]), "split": ("o", "e", "v1", "development", good[4]), "hash": (*good[:4], "zz"), "draft": ("o2", *good[1:]), "text": ("o3", *good[1:])}
    e = frame(spark, schema, *[(k, *v) for k, v in rows.items()])
    o = frame(spark, "opportunity_id string, entity_epoch_id string, query_id string, query_hash string", ("o", "e", "q", "h"), ("o2", "e", "d", "h"), ("o3", "e", "q", "other"))
    q = frame(spark, "query_id string, status string, query_hash string", ("q", "frozen", "h"), ("d", "draft", "h"))
    d = frame(spark, "query_id string, api_schema_version string", ("q", "v1"), ("d", "v1"))
    assert reasons(prospective.event_gates(e, o, q, d), "event_id") == {"ok": None, "opp": "opportunity_unknown", "epoch": "epoch_mismatch", "api": "api_schema_mismatch", "split": "split_not_prospective", "hash": "manifest_hash_invalid", "draft": "query_not_frozen", "text": "query_hash_mismatch"}


def test_execution_gate_and_missed_slots(spark):
    e = frame(spark, "run string, query_id string, split string, executed_at timestamp, cutoff_at timestamp", ("ok", "f", "prospective_test", day(5), day(4)), ("early", "f", "prospective_test", day(1), day(1)), ("draft", "d", "prospective_test", day(5), day(4)), ("dev", "d", "development", day(5), day(4)), ("cut", "d", "development", day(5), day(6)), ("src", "s", "development", day(5), day(4)), ("who", "x", "development", day(5), day(4)))
    q = frame(spark, "query_id string, status string, valid_for_test_from timestamp, source_available_at timestamp", ("f", "frozen", day(2), T0), ("d", "draft", None, None), ("s", "draft", None, day(9)))
    assert reasons(prospective.execution_gate(e, q), "run") == {"ok": None, "early": "before_valid_from", "draft": "query_not_frozen", "dev": None, "cut": "cutoff_after_execution", "src": "source_after_cutoff", "who": "query_unknown"}
    o = frame(spark, "opportunity_id string, window_end timestamp", ("done", day(1)), ("late", day(1)), ("none", day(1)), ("open", day(9)))
    x = frame(spark, "opportunity_id string, status string, executed_at timestamp", ("done", "complete", T0), ("late", "complete", day(2)), ("none", "failed", T0))
    assert {r["opportunity_id"] for r in prospective.missed_slots(o, x, F.lit(day(5))).collect()} == {"late", "none"}


def test_precheck_result_checks(spark):
    p = frame(spark, "precheck_id string, query_id string, cutoff_at timestamp", ("p", "q", T0))
    e = frame(spark, "query_run_id string, query_id string, cutoff_at timestamp, status string, hit_count int, raw_manifest_hash string", ("run", "q", T0, "complete", 2, "h"), ("other", "z", T0, "complete", 2, "h"))
    rows = {"ok": ("p", "run", "complete", 2, "h"), "pre": ("x", "run", "complete", 2, "h"), "exe": ("p", "x", "complete", 2, "h"), "q": ("p", "other", "complete", 2, "h"), "st": ("p", "run", "failed", 2, "h"), "n": ("p", "run", "complete", 3, "h"), "m": ("p", "run", "complete", 2, None)}
    r = frame(spark, "result_id string, precheck_id string, collection_run_id string, status string, hit_count int, raw_manifest_hash string", *[(k, *v) for k, v in rows.items()])
    assert reasons(pivots.precheck_result_checks(r, p, e), "result_id") == {"ok": None, "pre": "unknown_precheck", "exe": "unknown_execution", "q": "query_mismatch", "st": "status_mismatch", "n": "hit_count_mismatch", "m": "manifest_mismatch"}


def test_design_checks(spark):
    q = frame(spark, "query_id string, query_text string, source_assertion_ids array<string>, source_feature_ids array<string>, source_available_at timestamp", ("q", "text", [], ["feat"], T0)).withColumn("query_hash", sha256_text(F.col("query_text")))
    h = q.collect()[0]["query_hash"]
    clauses = frame(spark, "design_id string, clause_id string, source_assertion_id string, source_feature_id string, available_at timestamp", *[(d, "c", None, "feat", T0) for d in ("ok", "omit", "text", "ids")])
    s = frame(spark, "stat_snapshot_id string, feature_id string", ("snap", "feat"))
    d = frame(spark, "design_id string, query_id string, rendered_query string, query_hash string, clause_ids array<string>, background_snapshot_ids array<string>, cutoff_at timestamp", ("ok", "q", "text", h, ["c"], ["snap"], day(1)), ("omit", "q", "text", h, ["c"], [], day(1)), ("text", "q", "other", h, ["c"], ["snap"], day(1)), ("ids", "q", "text", h, ["c", "x"], ["snap"], day(1)), ("who", "z", "text", h, ["c"], [], day(1)))
    assert reasons(rules.design_checks(d, clauses, q, s), "design_id") == {"ok": None, "omit": "background_snapshot_omitted", "text": "query_text_mismatch", "ids": "clause_ids_mismatch", "who": "query_unknown"}
    pre = frame(spark, "design_id string, status string, page_count int, hit_count int, recorded_at timestamp", ("ok", "complete", 1, 2, T0), ("many", "complete", 3, 2, T0), ("part", "partial_max_pages", 1, 2, T0), ("zero", "complete", 1, 0, T0), ("wait", "complete", 1, 2, T0), ("old", "complete", 1, 2, day(5)))
    rev = frame(spark, "design_id string, decision string, reviewed_at timestamp", ("ok", "accepted", day(1)), ("old", "accepted", day(1)))
    assert reasons(rules.design_precheck_gate(pre, rev), "design_id") == {"ok": None, "many": "page_budget_exceeded", "part": "precheck_partial_max_pages", "zero": "zero_hits", "wait": "human_review_required", "old": "review_predates_precheck"}


def test_watch_audit_and_timeline_gates(spark):
    q = frame(spark, "query_id string, query_class string, source_precheck_ids array<string>, source_indicator_ids array<string>, source_assertion_ids array<string>", ("q0", "q0_seed", [], ["i"], ["a"]), ("lone", "q0_seed", [], ["i"], ["a"]), ("q2", "q2_derived", ["good"], [], []), ("q2bad", "q2_derived", ["bad"], [], []), ("q2none", "q2_derived", [], [], []))
    land = frame(spark, "landmark_id string, query_id string, indicator_id string, assertion_id string, window_start timestamp, window_end timestamp", ("l", "q0", "i", "a", T0, day(1)), ("back", "q0", "i", "a", day(1), T0), ("kind", "q2", "i", "a", T0, day(1)), ("own", "q0", "z", "a", T0, day(1)))
    el = frame(spark, "precheck_id string, eligible boolean", ("good", True), ("bad", False))
    rv = frame(spark, "precheck_id string, decision string", ("good", "accepted"), ("bad", "accepted"))
    assert codes(audit.audit_watch(q, land, el, rv)) == {("invalid_landmarks", "back"), ("q0_query_lacks_landmark", "lone"), ("accepted_precheck_not_eligible", "bad"), ("q2_lacks_precheck_provenance", "q2none"), ("q2_has_ineligible_precheck", "q2bad")}
    entries = frame(spark, "timeline_entry_id string, landmark_id string, observation_id string", ("t", "l", "o"), ("t2", "l", "gone"), ("t3", "own", "o"))
    told = timeline.timeline_gates(entries, land, q, frame(spark, "observation_id string, indicator_id string", ("o", "i")))
    assert reasons(told, "record_id") == {"kind": "landmark_query_not_q0", "own": "landmark_not_owned", "t2": "observation_unknown", "t3": "observation_of_other_indicator"}


def test_feature_audit_recomputes(spark):
    host = "observation_id string, indicator_id string, observed_at timestamp, collected_at timestamp, host_observed boolean, asn long, prefix string, query_run_id string"
    h = frame(spark, host, *[(o, f"i-{o}", day(1), day(1), True, 1, None, "run") for o in "abcd"])
    s = frame(spark, "service_observation_id string, observation_id string, port int, transport string, protocol string, observed_at timestamp, cert_sha256 string, software_product string", *[(f"s{o}", o, 443, "tcp", "https", None, c, None) for o, c in zip("abcd", "qqxy")])
    sets = frame(spark, "reference_set_id string, cutoff_at timestamp, protocol string, ports array<int>, product string, window_start timestamp, window_end timestamp, registered_at timestamp, source_query_run_ids array<string>", ("set", day(5), "https", [443], None, None, None, day(6), ["run"]))
    seen = features.observed_features(h, s)
    catalog, members = features.feature_catalog(seen), background.memberships(sets, h, s)
    anchors = frame(spark, "reference_set_id string, observation_id string", ("set", "a"), ("set", "b"))
    stats = background.feature_stats(catalog, seen, sets, members, anchors)
    judged = background.assess(stats, catalog).withColumn("assessment_id", F.col("feature_id"))
    rv = frame(spark, "assessment_id string, decision string", ("none", "accepted"))
    fine = audit.audit_features(catalog, seen, sets, members, anchors, stats, judged, rv.limit(0), h, s)
    assert fine.count() == 0
    wrong = stats.withColumn("anchor_numerator", F.when(F.col("anchor_numerator") == 2, F.lit(1).cast("bigint")).otherwise(F.col("anchor_numerator")))
    told = audit.audit_features(catalog, seen, sets, members.where("observation_id <> 'd'"), anchors, wrong, judged, rv, h, s)
    assert {r["code"] for r in told.collect()} == {"non_reproducible_reference_sets", "non_reproducible_feature_stat_snapshots", "non_reproducible_feature_eligibility_assessments", "accepted_feature_not_eligible"}
    runs = frame(spark, "query_run_id string, status string", ("run", "partial"))
    assert ("set_run_not_complete", "set") in codes(corpus.provenance_gates(sets, members, h, runs))
    sources = frame(spark, "source_id string", ("as",), ("pre",))
    made = corpus.observation_runs(frame(spark, "assessment_id string, evidence_observation_ids array<string>", ("as", ["a", "b"])), h, frame(spark, "precheck_id string, result_id string, collection_run_id string, recorded_at timestamp", ("pre", "1", "old", T0), ("pre", "2", "new", day(1))), sources)
    assert {(r["source_id"], r["query_run_id"]) for r in made.collect()} == {("as", "run"), ("pre", "new")}
    e = frame(spark, "feature_id string, reference_set_id string, eligible boolean", ("f", "b", True), ("f", "a", True), ("f", "c", False))
    assert background.eligible_sets(e).collect()[0]["reference_set_ids"] == ["a", "b"]


def test_freeze_audit(spark):
    d = frame(spark, "design_id string, query_id string, query_hash string, clause_ids array<string>, background_snapshot_ids array<string>, registered_at timestamp", ("d", "q", "h", ["c"], ["b"], T0))
    s = frame(spark, "design_id string, schedule_id string, starts_at timestamp, registered_at timestamp", ("d", "s", day(3), day(1)))
    p = frame(spark, "design_id string, result_id string, status string, recorded_at timestamp", ("d", "r", "complete", day(1)))
    r = frame(spark, "design_id string, review_id string, decision string, reviewed_at timestamp", ("d", "v", "accepted", day(1)))
    stored = rules.freeze_manifests(d, s, p, r, F.lit(day(2)), F.lit(day(2))).drop("reason")
    q = frame(spark, "query_id string, status string, query_text string, frozen_at timestamp, valid_for_test_from timestamp", ("q", "frozen", "t", day(2), day(2)), ("bare", "frozen", "t", day(2), day(2))).withColumn("query_hash", sha256_text(F.col("query_text")))
    assert codes(audit.audit_freezes(q, stored, d, s, p, r)) == {("frozen_query_lacks_manifest", "bare")}
    changed = d.withColumn("clause_ids", F.array(F.lit("z")))
    assert ("non_reproducible_freeze_manifest", "d") in codes(audit.audit_freezes(q, stored, changed, s, p, r))


def test_search_protocols_and_sql_functions(spark):
    rows = frame(spark, "name string, version string, queries array<string>, allowlist array<string>, acquisition_mode string, source_access_class string", ("n", "1", ["a", "b"], ["x"], "m", "public"), ("n", "1", ["b", "a", "a"], ["x"], "m", "public"), ("n", "1", ["a"], ["x"], "m", "public"), ("n", "1", [], ["x"], "m", "public"))
    got = mining.search_protocols(rows).collect()
    assert got[0]["search_protocol_id"] == got[1]["search_protocol_id"] != got[2]["search_protocol_id"] and got[3]["reason"] == "queries_missing"
    sql.register(spark)
    row = spark.sql("select wilson_low(2, 2) l, wilson_high(0, 0) h, canonical_value('  A  b ') c, defang('http://a.b@c/d.e') d, joined_id('ioc', array('a', null)) i, ipv6_valid('::1') v, feature_lift(0.5, 0) f").collect()[0]
    low = background.wilson(F.lit(2), F.lit(2))[0]
    assert abs(row["l"] - spark.range(1).select(low).collect()[0][0]) < 1e-12 and row["h"] == 1.0
    assert (row["c"], row["d"], row["v"]) == ("a b", "hxxp://a[.]b[@]c/d[.]e", True) and abs(row["f"] - 5e8) < 1


def test_memberships_move_hosts_once_for_all_sets(spark):
    h = frame(spark, "observation_id string, observed_at timestamp, collected_at timestamp, host_observed boolean", ("a", day(1), day(1), True), ("b", day(1), day(1), True))
    s = frame(spark, "observation_id string, port int, protocol string, software_product string", ("a", 443, "https", None), ("b", 22, "ssh", None))
    sets = frame(spark, "reference_set_id string, cutoff_at timestamp, protocol string, ports array<int>, product string, window_start timestamp, window_end timestamp, registered_at timestamp", ("web", day(5), "https", [443], None, None, None, day(6)), ("any", day(5), None, None, None, None, None, day(6)))
    told = background.memberships(sets, h, s)
    assert {(r["reference_set_id"], r["observation_id"], r["exclusion_reason"]) for r in told.collect()} == {("web", "a", None), ("any", "a", None), ("any", "b", None), ("web", "b", "stratum_mismatch")}
    tree = told._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftOuter, (observation_id" in tree and not any("LeftOuter" in line and "reference_set_id" in line for line in tree.splitlines())
