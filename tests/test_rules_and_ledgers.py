"""Pivots, rules, prospective path, ledgers, audits, scans on small cases."""

import json
import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from infratrace.operators import audit, constraints, corpus, mining, pivots, prospective, rules, scan
from infratrace.sources import ledger, readers

T0 = datetime(2026, 1, 1)


def day(n):
    return T0 + timedelta(days=n)


def reasons(df, key):
    return {r[key]: r["reason"] for r in df.collect()}


def test_verification_gates(spark):
    docs = spark.createDataFrame([("d", "see relay[.]example[.]org and 192.0.2.5 and relay[.]example[.]org", T0, "fam", "exact_timestamp")], "document_id string, text string, published_at timestamp, source_family_id string, published_time_precision string")
    rows = [("d", 0, "domain", "relay[.]example[.]org", "relay_node", None), ("d", 1, "domain", "absent[.]example[.]org", "unknown", None), ("d", 2, "ip", "192.0.2.5", "unknown", "2027-01-01"), ("d", 3, "domain", "relay[.]example[.]org", "victim", None), ("d", 4, "ip", "192.0.2.5", "gossip", None), ("d", 5, "ip", "999.0.2.5", "unknown", None)]
    cands = spark.createDataFrame(rows, "document_id string, pos int, scope string, raw_form string, context string, observed_at string")
    told = mining.verify(cands, docs, F.lit(day(9)))
    assert {r["pos"]: r["status"] for r in told.collect()} == {0: "verified", 1: "source_mismatch", 2: "future_time", 3: "duplicate", 4: "format_rejected", 5: "format_rejected"}
    got = mining.funnel(told, ["document_id"]).collect()[0]
    assert (got["candidates"], got["verified"], got["format_rejected"], got["duplicates"]) == (6, 1, 2, 1)
    made = mining.indicator_tables(told, docs, F.lit(day(9)), F.lit(day(9)), public_id=mining.public_id_udf("INFRATRACE_TEST_KEY"))
    a = made.assertions.collect()[0]
    assert a["role"] == "relay_orb" and made.mentions.count() == 1 and made.rejected.count() == 0
    with pytest.raises(Exception, match="32 bytes"):
        made.indicators.collect()
    undated = mining.indicator_tables(told, docs.withColumn("published_at", F.lit(None).cast("timestamp")), F.lit(day(9)), F.lit(day(9)))
    assert [r["reason"] for r in undated.rejected.collect()] == ["publication_time_not_exact"]


def test_extractor_hook(spark):
    docs = spark.createDataFrame([("d", "a b"), ("e", None)], "document_id string, text string")
    got = mining.mine_with(docs, lambda t: [("mutex", w, "unknown", None) for w in t.split()]).collect()
    assert [(r["document_id"], r["pos"], r["raw_form"]) for r in got] == [("d", 0, "a"), ("d", 1, "b")]


def test_search_candidates(spark):
    rows = [("q", 0, "HTTPS://Example.org/a?b=2&a=1#part"), ("q", 1, "https://example.org/a?a=1&b=2"), ("q", 2, "https://elsewhere.net/"), ("q", 3, "broken")]
    told = mining.search_candidates(spark.createDataFrame(rows, "query_id string, pos int, url string"), spark.createDataFrame([(" Example.org. ",)], "domain string"))
    assert [r["status"] for r in told.orderBy("pos").collect()] == ["candidate", "duplicate", "outside_allowlist", "invalid_url"]
    total = mining.search_funnel(told, ["query_id"]).where("query_id is null").collect()[0]
    assert (total["results"], total["candidates"], total["duplicates"], total["outside"], total["invalid"]) == (4, 1, 1, 1, 1)


def test_expand_terms(spark):
    terms = spark.createDataFrame([(0, "{name} relay"), (1, "plain"), (2, "{name} relay")], "term_pos int, term string")
    names = spark.createDataFrame([("beta", 0, None), ("alpha", 1, 1)], "name string, name_pos int, priority int")
    got = mining.expand_terms(terms, names).orderBy("term_pos", "priority", "name_pos").collect()
    assert [r["query"] for r in got] == ["alpha relay", "beta relay", "plain"]


def test_pivot_plans(spark):
    rows = [("a", "ip", "8.8.8.8", "c2", T0), ("b", "domain", "relay.badinfra.net", "c2", T0), ("c", "hash_md5", "x", "c2", T0), ("d", "ip", "8.8.8.8", "unknown", T0), ("e", "ip", "192.168.18.111", "c2", T0), ("f", "ip", "8.8.8.8", "c2", day(9)), ("g", "spki", "x", "c2", T0), ("h", "domain", "x.exe", "c2", T0), ("i", "cert", "1.2.3.4", "c2", T0)]
    got = {r["indicator_id"]: (r["status"], r["query_class"], r["reason"]) for r in pivots.plan_pivots(spark.createDataFrame(rows, "indicator_id string, scope string, value string, role string, available_at timestamp"), F.lit(day(1))).collect()}
    assert got["a"] == ("registered_not_executed", "q0_seed", None) and got["b"][:2] == ("registered_not_executed", "q1_direct_pivot")
    assert got["c"][0] == "unsupported" and "not pivotable" in got["d"][2] and got["e"] == ("blocked", "q0_seed", "IP is not globally routable")
    assert got["f"][0] == "blocked" and got["g"][0] == "blocked" and "filelike" in got["h"][2] and got["i"][0] == "blocked"


def test_prechecks(spark):
    pre = spark.createDataFrame([("p", []), ("z", []), ("r", []), ("ok", []), ("b", ["x", "broad_shared"]), ("no", [])], "precheck_id string, risk_flags array<string>")
    res = [("p", "1", "complete", 5, T0), ("p", "2", "partial_max_pages", 5, day(1)), ("z", "1", "complete", 0, T0), ("r", "1", "complete", 2, T0), ("ok", "1", "complete", 2, T0), ("b", "1", "complete", 2, T0), ("no", "1", "complete", 2, T0)]
    results = spark.createDataFrame(res, "precheck_id string, result_id string, status string, hit_count int, recorded_at timestamp")
    reviews = spark.createDataFrame([("ok", "accepted"), ("b", "accepted"), ("no", "rejected")], "precheck_id string, decision string")
    told = pivots.precheck_eligibility(pre, results, reviews)
    assert reasons(told, "precheck_id") == {"p": "precheck_partial_max_pages", "z": "zero_hit_not_death_evidence", "r": "human_review_required", "ok": "eligible_q2_source", "b": "broad_shared", "no": "human_review_rejected"}
    q = spark.createDataFrame([("q1", ["ok"]), ("q2", ["ok", "p"]), ("q3", [])], "query_id string, precheck_ids array<string>")
    got = pivots.q2_admission(q, told.withColumn("source_available_at", F.lit(T0)))
    assert {r["query_id"]: r["admitted"] for r in got.collect()} == {"q1": True, "q2": False, "q3": False}


def clause(design, ident, origin, role, value, **more):
    row = {"design_id": design, "clause_id": ident, "feature_origin": origin, "logical_role": role, "cooccurrence_scope": "host", "query_field": "f", "canonical_value": value, "source_assertion_id": None, "source_precheck_id": None, "source_feature_id": None, "node_id": None, "available_at": T0} | more
    return tuple(row.values())


CLAUSE = "design_id string, clause_id string, feature_origin string, logical_role string, cooccurrence_scope string, query_field string, canonical_value string, source_assertion_id string, source_precheck_id string, source_feature_id string, node_id string, available_at timestamp"


def test_designs(spark):
    rows = [
        clause("ok", "1", "derived", "required", "v", source_feature_id="feat"), clause("late", "1", "derived", "required", "v", source_feature_id="feat", available_at=day(9)), clause("mix", "1", "derived", "required", "v", source_feature_id="feat"),
        clause("nodes", "1", "cti_direct", "required", "a", source_assertion_id="as", node_id="node-a"), clause("nodes", "2", "cti_direct", "required", "b", source_assertion_id="as", node_id="node-b"),
        clause("neg", "1", "derived", "exclusion", "v", source_feature_id="feat"), clause("new", "1", "cti_direct", "required", "a", source_assertion_id="other"),
    ]
    kinds = {"ok": "derived_only", "late": "derived_only", "mix": "cti_only", "nodes": "cti_only", "neg": "derived_only", "new": "cti_only", "none": "cti_only"}
    designs = spark.createDataFrame([(k, "q2_derived", v, day(5)) for k, v in kinds.items()], "design_id string, query_class string, composition_type string, cutoff_at timestamp")
    a = spark.createDataFrame([("as",)], "assertion_id string")
    f = spark.createDataFrame([("feat", "f", "v", T0)], "feature_id string, query_field string, canonical_value string, first_available_at timestamp")
    got = {r["design_id"]: r["reasons"] for r in rules.validate_designs(designs, spark.createDataFrame(rows, CLAUSE), a, spark.createDataFrame([], "precheck_id string"), f).collect()}
    assert got["ok"] == [] and "feature_leakage" in got["late"] and got["mix"] == ["composition_mismatch"] and got["nodes"] == ["required_nodes_differ"]
    assert got["neg"] == ["positive_clause_missing"] and got["new"] == ["unaccepted_cti_provenance"] and "clauses_missing" in got["none"]
    built = rules.build_clauses(spark.createDataFrame([rows[0], clause("s", "1", "derived", "score_only", "v")], CLAUSE).drop("clause_id"))
    assert [(r["operator"], r["reason"]) for r in built.orderBy("design_id").collect()] == [("AND", None), (None, "score_only_clause")]


def test_render_and_match(spark):
    rows = [("r", "2", "required", "a", 'x"y'), ("r", "1", "required", "b", "1"), ("r", "3", "alternative", "c", "1"), ("r", "4", "alternative", "c", "2"), ("r", "5", "exclusion", "d", "é")]
    c = spark.createDataFrame(rows, "design_id string, clause_id string, logical_role string, query_field string, canonical_value string")
    assert rules.render(c).collect()[0]["rule"] == 'b: "1" AND a: "x\\"y" AND (c: "1" OR c: "2") AND NOT (d: "é")'
    seen = [("h1", "a", 'x"y'), ("h1", "b", "1"), ("h1", "c", "2"), ("h2", "a", 'x"y'), ("h2", "b", "1"), ("h3", "a", 'x"y'), ("h3", "b", "1"), ("h3", "c", "1"), ("h3", "d", "é"), ("h4", "c", "1")]
    got = rules.match_rules(spark.createDataFrame(seen, "observation_id string, query_field string, canonical_value string"), c).collect()
    assert [r["observation_id"] for r in got] == ["h1"]


def test_freeze(spark):
    d = spark.createDataFrame([("d", "q", "h", ["c"], ["b"], T0), ("n", "q2", "h", ["c"], ["b"], T0)], "design_id string, query_id string, query_hash string, clause_ids array<string>, background_snapshot_ids array<string>, registered_at timestamp")
    s = spark.createDataFrame([("d", "s", day(3), day(1))], "design_id string, schedule_id string, starts_at timestamp, registered_at timestamp")
    p = spark.createDataFrame([("d", "r", "complete", day(1))], "design_id string, result_id string, status string, recorded_at timestamp")
    r = spark.createDataFrame([("d", "v", "accepted", day(1))], "design_id string, review_id string, decision string, reviewed_at timestamp")
    made = rules.freeze_manifests(d, s, p, r, F.lit(day(2)), F.lit(day(2)))
    assert reasons(made, "design_id") == {"d": None, "n": "schedule_missing"}
    again = audit.differences(made.where("design_id = 'd'"), made.where("design_id = 'd'"), ["design_id"], ["lineage_hash"], "x")
    assert again.count() == 0 and len(made.where("design_id = 'd'").collect()[0]["lineage_hash"]) == 64
    assert rules.freeze_manifests(d, s, p, r, F.lit(day(2)), F.lit(day(4))).where("design_id = 'd'").collect()[0]["reason"] == "schedule_starts_early"


def test_slots(spark):
    s = spark.createDataFrame([("s", day(0), 24)], "schedule_id string, starts_at timestamp, interval_hours int")
    e = spark.createDataFrame([("open", day(-9), None), ("ended", day(-9), day(0)), ("future", day(5), None)], "entity_epoch_id string, valid_from timestamp, valid_to timestamp")
    at = lambda n, hours=24 * 7: [(r["entity_epoch_id"], r["status"]) for r in prospective.due_opportunities(s, e, F.lit(day(n)), hours).orderBy("due_at").collect()]
    assert at(0) == [("open", "due")] and at(1) == [("open", "missed"), ("open", "due")] and at(1, 5) == at(1) and at(-1) == []


def test_events_and_candidates(spark):
    h = spark.createDataFrame([("a", "i", day(3), "e1"), ("b", "i", None, "e1"), ("c", "i", day(1), "e1"), ("d", "i", day(4), "e1")], "observation_id string, indicator_id string, observed_at timestamp, entity_epoch_id string")
    s = spark.createDataFrame([("s1", "a", day(3)), ("s2", "d", day(1))], "service_observation_id string, observation_id string, observed_at timestamp")
    told = prospective.prospective_events(h, s, F.lit(day(2)))
    assert {r["observation_id"]: r["time_status"] for r in told.collect()} == {"a": "eligible", "b": "unresolved", "c": "pre_freeze", "d": "pre_freeze"}
    assert told.where("observation_id = 'd'").collect()[0]["record_time_statuses"] == {"d": "eligible", "s2": "pre_freeze"}
    made = prospective.candidates(told.withColumn("event_id", F.col("observation_id")), ["entity_epoch_id"]).collect()
    assert [(m["first_observation_event_id"], m["first_candidate_at"]) for m in made] == [("a", day(3))]


def test_evidence_and_grades(spark):
    c = spark.createDataFrame([("c", day(2), ["f1"], ["fam"])], "candidate_id string, first_candidate_at timestamp, discovery_feature_ids array<string>, discovery_source_family_ids array<string>")
    rows = [("ok", "c", "new", "validation", "available", ["f2"], day(3), day(3)), ("fam", "c", "fam", "validation", "available", ["f2"], day(3), None), ("reuse", "c", "n2", "validation", "available", ["f1"], day(3), None), ("early", "c", "n3", "validation", "available", ["f2"], day(1), None),
            ("seen", "c", "n4", "validation", "available", ["f2"], day(3), day(1)), ("off", "c", "n5", "validation", "unavailable", ["f1"], day(1), None), ("twice", "c", "new", "validation", "available", ["f3"], day(4), None), ("who", "x", "n", "validation", "available", [], day(3), None)]
    e = spark.createDataFrame(rows, "evidence_id string, candidate_id string, source_family_id string, role string, availability string, feature_ids array<string>, available_at timestamp, observed_at timestamp")
    assert reasons(prospective.evidence_gate(e, c), "evidence_id") == {"ok": None, "fam": "same_source_family", "reuse": "feature_reuse", "early": "pre_candidate_evidence", "seen": "pre_candidate_observation", "off": None, "twice": "family_repeated", "who": "unknown_candidate"}
    v = [("a", "available", "validation", True), ("a", "available", "validation", False), ("b", "unavailable", "validation", None), ("d", "available", "context", None), ("e", "available", "validation", False), ("f", "available", "contradiction", None)]
    got = prospective.adjudication_status(spark.createDataFrame(v, "k string, availability string, role string, supports_candidate boolean"), ["k"])
    assert {r["k"]: r["status"] for r in got.collect()} == {"a": "contradicted", "b": "unobservable", "d": "unresolved", "e": "negative", "f": "contradicted"}
    g = spark.createDataFrame([("c", "grade-1", None, day(1)), ("c", "grade-2", "grade-1", day(2)), ("c", "bad", "grade-1", day(3))], "candidate_id string, grade_event_id string, previous_grade_event_id string, graded_at timestamp")
    assert reasons(prospective.grade_chain(g), "grade_event_id") == {"grade-1": None, "grade-2": None, "bad": "previous_mismatch"}
    adj = spark.createDataFrame([("1", "c", "unresolved", ["ok"], "x", "y"), ("2", "c", "unresolved", ["who"], "x", "y"), ("3", "c", "unresolved", [], "x", "x"), ("4", "c", "positive", [], "x", "y")], "adjudication_id string, candidate_id string, status string, evidence_ids array<string>, adjudicator_id string, implementer_id string")
    got = prospective.adjudication_check(adj, e.withColumn("supports_candidate", F.lit(None).cast("boolean")))
    assert reasons(got, "adjudication_id") == {"1": None, "2": "evidence_unknown", "3": "adjudicator_not_independent", "4": "status_not_supported"}


def test_ledger_replays(spark, tmp_path):
    path = f"file://{tmp_path}/ledger"
    rows = spark.createDataFrame([("a", 1, day(1)), ("b", 2, day(1))], "id string, v int, first_available_at timestamp")
    run = lambda df, **kw: {r["action"]: r["rows"] for r in ledger.append(df, path, ["id"], **kw).collect()}
    assert run(rows) == {"insert": 2} and run(rows) == {"noop": 2}
    assert run(rows.withColumn("v", F.lit(9))) == {"conflict": 2}
    late, early = rows.withColumn("first_available_at", F.lit(day(5))), rows.withColumn("first_available_at", F.lit(T0))
    assert run(late, earliest="first_available_at") == {"noop": 2} and run(early, earliest="first_available_at") == {"backfill_conflict": 2}
    both = spark.createDataFrame([("n", 1, T0), ("n", 1, T0), ("m", 1, T0), ("m", 2, T0)], rows.schema)
    assert run(both) == {"insert": 1, "duplicate": 1, "conflict": 2}
    assert spark.read.parquet(path).count() == 3


def test_public_manifest_fails_closed(spark):
    docs = spark.createDataFrame([("a", "p", "h", "public"), ("b", "p", "h", "restricted")], "document_id string, publisher string, content_sha256 string, source_access_class string")
    want = spark.createDataFrame([(0, "b"), (1, "a"), (2, "c")], "position int, document_id string")
    told = ledger.public_manifest(docs, want)
    assert reasons(told, "document_id") == {"a": None, "b": "restricted", "c": "missing"}
    assert told.where("document_id = 'b'").collect()[0]["publisher"] is None
    with pytest.raises(Exception, match="refused"):
        ledger.strict(told).collect()


def test_page_log_and_accounting(spark):
    log = [("done", 1, "h", "h", "q", "q", 1, "t2", "complete"), ("done", 2, "h", "h", "q", "q", 2, None, "complete"), ("part", 1, "h", "h", "q", "q", 1, "t2", "partial"), ("loop", 1, "h", "h", "q", "q", 1, "same", "partial"), ("loop", 2, "h", "x", "q", "q", 1, "same", "partial"), ("gap", 2, "h", "h", "q", "q", 1, None, "complete")]
    df = spark.createDataFrame(log, "run_id string, page_number int, page_hash string, stored_hash string, query_hash string, run_query_hash string, cumulative_hits int, next_page_token string, run_status string")
    got = {(r["run_id"], r["page_number"]): r["violation"] for r in scan.page_log_audit(df).where("violation is not null").collect()}
    assert got == {("loop", 2): "page_hash_mismatch", ("gap", 2): "page_gap"}
    assert {r["run_id"]: (r["status"], r["resume_token"]) for r in scan.run_accounting(df, 1).collect()} == {"done": ("complete", None), "part": ("partial_max_pages", "t2"), "loop": ("token_loop", "same"), "gap": ("complete", None)}


def test_scan_pages_from_files(spark, tmp_path):
    host = {"ip": "198.51.100.7", "last_updated_at": "2026-01-01T10:00:00Z", "autonomous_system": {"asn": 64500, "bgp_prefix": "198.51.100.0/24"}, "services": [{"port": 443, "service_name": "HTTPS", "observed_at": "2026-01-01T11:00:00Z", "jarm": {"fingerprint": "J" * 62}, "banner": " Hello  World ", "spki_sha256": "AB", "software": [{"vendor": "Acme", "product": "Gateway", "version": "1"}]}]}
    folder = tmp_path / "pages" / "run-1"
    folder.mkdir(parents=True)
    (folder / "page-0001.json").write_text(json.dumps({"result": {"hits": [{"host": host}, {"host_v1": {"resource": host | {"ip": "198.51.100.8"}}}, {"note": "no address"}], "next_page_token": "t2"}}))
    other = tmp_path / "pages" / "run-2"
    other.mkdir()
    (other / "page-0001.json").write_text(json.dumps({"result": {"hits": []}}))
    pages = readers.scan_pages(spark, f"{tmp_path}/pages")
    runs = spark.createDataFrame([("run-1", "q1_direct_pivot", None, None, day(1)), ("run-2", "q0_seed", "192.0.2.9", "ioc-seed", day(1))], "run_id string, query_class string, exact_ip string, indicator_id string, collected_at timestamp")
    known = spark.createDataFrame([("198.51.100.7", "ioc-seed")], "ip string, indicator_id string")
    history = spark.createDataFrame([("198.51.100.7", 443, day(-3), day(-1)), ("198.51.100.7", 443, day(-2), day(0))], "ip string, port int, first_seen timestamp, last_seen timestamp")
    made = scan.normalize(pages, runs, known, history)
    hosts = {r["indicator_id"]: r for r in made.hosts.where("host_observed").collect()}
    assert len(hosts) == 2 and "ioc-seed" in hosts and hosts["ioc-seed"]["asn"] == 64500
    missing = made.hosts.where("not host_observed").collect()
    assert [(m["query_run_id"], m["negative_reason"], m["observed_at"]) for m in missing] == [("run-2", "not_found", None)]
    s = made.services.where("history_days is not null").collect()[0]
    assert (s["port"], s["protocol"], s["observation_time_basis"], s["software_product"], s["spki_sha256"], s["history_days"]) == (443, "https", "service", "Gateway", "ab", 3)
    assert made.discovered.count() == 1 and made.violations.count() == 0


def test_document_corpus_and_json_readers(spark, tmp_path):
    (tmp_path / "docs").mkdir()
    for name, text in (("a.html", "one"), ("b.html", "one"), ("c.html", "two")):
        (tmp_path / "docs" / name).write_text(text)
    index = [("a.html", "p", "2026-01-01", "date", "public"), ("b.html", "p", "2026-01-01", "date", "public"), ("c.html", "p", "2026", "date", "public"), ("d.html", "p", "2026", "year", "public"), ("e.html", "", "2026", "year", "public")]
    df = spark.createDataFrame(index, "path string, publisher string, published_at_raw string, published_time_precision string, source_access_class string")
    good, bad = readers.document_corpus(spark, f"{tmp_path}/docs", df)
    assert [r["path"] for r in good.collect()] == ["a.html"]
    assert reasons(bad, "path") == {"b.html": "duplicate_content", "c.html": "precision_mismatch", "d.html": "missing_file", "e.html": "missing_field"}
    (tmp_path / "log.jsonl").write_text('{"a": 1}\n\n{broken\n')
    got = readers.json_lines(spark, f"{tmp_path}/log.jsonl", "a int").collect()
    assert [(r["a"], r["broken"]) for r in got] == [(1, None), (None, "{broken")]
    with pytest.raises(Exception):
        readers.json_lines(spark, f"{tmp_path}/log.jsonl", "a int", strict=True).collect()
    (tmp_path / "list.json").write_text('[{"a": 1}, {"a": 2}]')
    assert readers.json_array(spark, f"{tmp_path}/list.json", "a int").count() == 2


def test_transitions_and_histories(spark):
    log = spark.createDataFrame([("o", 1, "due"), ("o", 2, "partial"), ("o", 3, "complete"), ("o", 4, "due"), ("p", 1, "missed"), ("p", 2, "late"), ("p", 3, "late")], "k string, n int, status string")
    got = {(r["k"], r["n"]): r["allowed"] for r in prospective.transitions(log, prospective.OPPORTUNITY_MOVES, ["k"], ["n"]).collect()}
    assert [k for k, v in got.items() if not v] == [("o", 4), ("p", 2)]
    h = spark.createDataFrame([("a", 1, "partial", 2), ("a", 2, "partial", 1), ("b", 1, "complete", 2), ("b", 2, "complete", 2)], "k string, n int, status string, hits int")
    assert {(r["k"], r["n"]): r["violation"] for r in prospective.monotone(h, ["k"], ["n"], ["hits"]).where("violation is not null").collect()} == {("a", 2): "counter_decrease", ("b", 2): "terminal_status"}
    state = prospective.execution_status(F.col("s"), F.col("t"), F.lit(day(1)))
    rows = [("partial_max_pages", T0), ("complete", day(1)), ("complete", T0), ("failed", T0), ("odd", T0)]
    assert [r[0] for r in spark.createDataFrame(rows, "s string, t timestamp").select(state).collect()] == ["partial", "late", "complete", "failed", "unsupported"]


def test_source_families_and_constraints(spark):
    docs = spark.createDataFrame([("original",), ("translation",), ("other",)], "document_id string")
    members = spark.createDataFrame([("original", "f1"), ("translation", "f1"), ("other", "f2")], "document_id string, source_family_id string")
    claims = docs.select(F.lit("claim").alias("k"), "document_id")
    got = corpus.independent_sources(claims, members, ["k"]).collect()[0]
    assert (got["documents"], got["independent_sources"], got["without_family"]) == (3, 2, 0)
    families = spark.createDataFrame([("f1", "original"), ("f2", "gone")], "source_family_id string, canonical_document_id string")
    assert {r["code"] for r in corpus.family_checks(families, members, docs).collect()} == {"missing_canonical_document", "invalid_canonical_membership"}
    rows = constraints.check(spark.createDataFrame([("tcp", 0), ("icmp", 80), ("udp", 53)], "transport string, port int"), "service_observations")
    assert [r["violations"] for r in rows.collect()] == [["port_out_of_range"], ["transport_invalid"], []]
    d = spark.createDataFrame([("m", "p", "public"), ("prospective_validation", "p", "public"), (None, "p", "public")], "acquisition_mode string, corpus_purpose string, source_access_class string")
    assert [r["reason"] for r in constraints.development_only(d).collect()] == [None, "prospective_material", "provenance_missing"]
    pairs = spark.createDataFrame([("q0_seed", "rq1")], "query_class string, question string")
    q = spark.createDataFrame([("q0_seed", "rq1"), ("q0_seed", "rq2")], "query_class string, question string")
    assert {r["question"]: r["supported"] for r in constraints.supported_questions(q, pairs).collect()} == {"rq1": True, "rq2": False}


def test_group_hash_is_blind_to_order(spark):
    from infratrace.functions.ids import group_hash, sha256_text

    rows = [(k % 3, f"row-{k}") for k in range(900)]
    of = lambda r: {x["g"]: x["h"] for x in group_hash(spark.createDataFrame(r, "g int, row string").repartition(5), ["g"], sha256_text(F.col("row")), "h").collect()}
    one, two = of(rows), of(rows[::-1])
    assert one == two and len(set(one.values())) == 3 and of(rows[:-1])[2] != one[2]


def test_append_reads_the_named_partitions(spark, tmp_path):
    path = f"file://{tmp_path}/parted"
    run = lambda rows: {r["action"]: r["rows"] for r in ledger.append(spark.createDataFrame(rows, "day string, id int, v int"), path, ["day", "id"], partition_by=["day"]).collect()}
    assert run([("a", 1, 1), ("a", 2, 1), (None, 3, 1)]) == {"insert": 3}
    assert run([("a", 1, 1), ("a", 2, 9), ("b", 1, 1), (None, 3, 1)]) == {"noop": 2, "conflict": 1, "insert": 1}
    assert spark.read.parquet(path).count() == 4


def test_rules_deal_out_observations_once_by_entity(spark):
    seen = spark.createDataFrame([("e", "f", "a"), ("e", "f", "a"), ("e", "g", "b"), ("x", "f", "a"), ("x", "g", "z")], "entity string, query_field string, canonical_value string")
    clauses = spark.createDataFrame([("r", "1", "required", "f", "a"), ("r", "2", "alternative", "g", "b"), ("r", "3", "exclusion", "g", "z"), ("s", "4", "alternative", "g", "z")], "design_id string, clause_id string, logical_role string, query_field string, canonical_value string")
    got = rules.match_rules(seen, clauses, "entity")
    assert sorted(map(tuple, got.collect())) == [("r", "e"), ("s", "x")]
    plan = got._jdf.queryExecution().sparkPlan().toString() + got._jdf.queryExecution().executedPlan().toString()
    assert set(re.findall(r"Exchange hashpartitioning\((.*?)#", plan)) == {"entity"} and not re.search(r"hashpartitioning\(entity#\d+, [a-z]", plan)
