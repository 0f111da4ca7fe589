"""Timelines, continuity, epochs, features, background, graph on small cases."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from infratrace.operators import background, epochs, features, graph, timeline

T0 = datetime(2026, 1, 1)
HOST = "observation_id string, indicator_id string, observed_at timestamp, collected_at timestamp, host_observed boolean, negative_reason string, asn long, prefix string, query_run_id string"
SERVICE = "service_observation_id string, observation_id string, port int, transport string, protocol string, observed_at timestamp, cert_sha256 string, jarm string, banner_hash string, software_product string"


def day(n):
    return None if n is None else T0 + timedelta(days=n)


def hosts(spark, rows):
    """(observation, indicator, day, reason or None)"""
    return spark.createDataFrame([(o, i, day(d), day(d), r is None, r, 64500, None, "run") for o, i, d, r in rows], HOST)


def services(spark, rows):
    """(observation, port, cert, jarm, banner, product)"""
    return spark.createDataFrame([(f"s-{o}-{p}", o, p, "tcp", "https", None, c, j, b, sw) for o, p, c, j, b, sw in rows], SERVICE)


def landmark(spark):
    return spark.createDataFrame([("landmark-1", "ioc-1", T0, day(30))], "landmark_id string, indicator_id string, window_start timestamp, window_end timestamp")


def assess(spark, h, s, contradictions=None):
    entries = timeline.timeline(landmark(spark), hosts(spark, h), services(spark, s))
    return timeline.continuity(entries, landmark(spark), contradictions).collect()[0], entries


def test_current_response_alone_is_unknown(spark):
    got, _ = assess(spark, [("a", "ioc-1", 2, None)], [])
    assert (got["status"], got["derived_pivot_allowed"], got["current_response"]) == ("unknown", False, True)


def test_same_certificate_out_of_order_is_continuous(spark):
    got, entries = assess(spark, [("b", "ioc-1", 10, None), ("a", "ioc-1", 2, None)], [("a", 443, "x", None, None, None), ("b", 443, "x", None, None, None)])
    assert [r["observation_id"] for r in entries.orderBy("nth").collect()] == ["a", "b"]
    assert got["status"] == "continuous" and got["derived_pivot_allowed"] and len(got["stable_fingerprint_ids"]) == 1


def test_missing_scan_is_probable(spark):
    got, _ = assess(spark, [("a", "ioc-1", 2, None), ("b", "ioc-1", 10, None), ("c", "ioc-1", 12, "not_scanned")], [])
    assert (got["status"], got["current_response"], got["missing_scan_count"], got["last_positive_at"]) == ("probable", None, 1, day(10))
    made = spark.createDataFrame([("x", "probable"), ("y", "probable"), ("z", "continuous")], "assessment_id string, status string")
    reviews = spark.createDataFrame([("x", "accepted", True), ("z", "rejected", True)], "assessment_id string, decision string, allow_probable boolean")
    assert {r["assessment_id"]: r["allowed"] for r in timeline.pivot_permission(made, reviews).collect()} == {"x": True, "y": False, "z": False}


def test_disjoint_and_overlapping_sets(spark):
    got, _ = assess(spark, [("a", "ioc-1", 2, None), ("b", "ioc-1", 10, None)], [("a", 443, "x", None, None, None), ("b", 443, "y", None, None, None)])
    assert got["status"] == "reassigned"
    three = [("a", 1, "a", "b", None, None), ("b", 1, "c", "b", None, None), ("c", 1, "a", None, None, None), ("c", 2, "c", None, None, None)]
    got, _ = assess(spark, [("a", "ioc-1", 1, None), ("b", "ioc-1", 2, None), ("c", "ioc-1", 3, None)], three)
    assert got["status"] == "probable" and got["conflicting_fingerprint_ids"] == []
    got, _ = assess(spark, [("a", "ioc-1", 2, None)], [], spark.createDataFrame([("landmark-1", "a")], "landmark_id string, observation_id string"))
    assert got["status"] == "contradicted"


def replay_epochs(rows):
    out, state = {}, {}
    for who, _, obs, ids in sorted(rows):
        epoch, held = state.get(who, (0, set()))
        ids = set(ids)
        if ids and held and not ids & held:
            epoch, held = epoch + 1, ids
        else:
            held = held | ids
        state[who] = epoch, held
        out[obs] = epoch
    return out


def test_epochs_against_replay_folded_and_streamed(spark):
    rng = random.Random(3)
    rows = [(f"ioc-{rng.randint(0, 6)}", T0 + timedelta(hours=rng.randint(0, 200)), f"o{i:04d}", sorted({f"c{rng.randint(0, 4)}" for _ in range(rng.randint(0, 2))})) for i in range(600)]
    df = spark.createDataFrame([(w, t, t, o, i) for w, t, o, i in rows], "indicator_id string, effective_at timestamp, collected_at timestamp, observation_id string, ids array<string>")
    want = replay_epochs(rows)
    for limit, chunk in ((10_000, 100), (60, 100), (0, 7)):
        assert {r["observation_id"]: r["epoch"] for r in epochs.assign_epochs(df, limit, chunk).collect()} == want


def test_one_long_history_over_many_chunks(spark):
    """Identities that come, go and come back, in runs of many lengths, with observations that have none."""
    rng = random.Random(8)
    rows, held = [], ["a"]
    for i in range(1500):
        if rng.random() < 0.05:
            held = rng.sample("abcdefghij", rng.randint(1, 3))
        ids = rng.sample(held, rng.randint(0, len(held))) if rng.random() < 0.7 else []
        rows.append(("ioc-1", T0 + timedelta(minutes=i // 3), f"o{i:05d}", sorted(ids)))
    df = spark.createDataFrame([(w, t, t, o, i) for w, t, o, i in rows], "indicator_id string, effective_at timestamp, collected_at timestamp, observation_id string, ids array<string>")
    want = replay_epochs(rows)
    assert max(want.values()) > 20
    made = epochs.assign_epochs(df, 0, 20)
    assert {r["observation_id"]: r["epoch"] for r in made.collect()} == want
    assert epochs._chunks(df, 20).select("chunk").distinct().count() > 50
    plain, ranged = epochs._ordered(made), epochs._ordered(made, 15)
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, ranged.select(plain.columns).collect()))


def test_histories_without_identities_or_rows(spark):
    schema = "indicator_id string, effective_at timestamp, collected_at timestamp, observation_id string, ids array<string>"
    none = spark.createDataFrame([(f"i{k % 2}", T0, T0, f"o{k}", []) for k in range(9)], schema)
    assert {r["epoch"] for r in epochs.assign_epochs(none, 0, 2).collect()} == {0}
    assert epochs.assign_epochs(none.limit(0), 0, 2).count() == 0


def test_epoch_case_and_open_end(spark):
    h = hosts(spark, [("obs-a", "ioc-1", 0, None), ("obs-b", "ioc-1", 1, None), ("obs-c", "ioc-1", 2, None)])
    ids = spark.createDataFrame([("obs-a", "a"), ("obs-b", "a"), ("obs-c", "c")], "observation_id string, identity string")
    assigned = epochs.assign_epochs(epochs.histories(h, ids))
    table = epochs.entity_epochs(assigned, open_last=True)
    made = table.orderBy("epoch").collect()
    members = epochs.epoch_members(assigned, table).orderBy("nth").collect()
    assert [[r["observation_id"] for r in members if r["entity_epoch_id"] == m["entity_epoch_id"]] for m in made] == [["obs-a", "obs-b"], ["obs-c"]]
    assert [m["valid_to"] for m in made] == [day(1), None]


def test_features(spark):
    h = hosts(spark, [("a", "ioc-1", 1, None), ("b", "ioc-2", 0, None), ("n", "ioc-3", 0, "not_found")])
    s = services(spark, [("a", 443, "Q", "0" * 62, "hash", " NGINX "), ("b", 443, "q", None, None, "Other"), ("n", 443, "z", None, None, None)])
    seen = features.observed_features(h, s)
    got = {(r["feature_type"], r["canonical_value"]): r for r in features.feature_catalog(seen).collect()}
    assert got["cert_sha256", "q"]["first_available_at"] == day(0)
    assert got["software_product", "nginx"]["shared_or_default"] and got["jarm", "0" * 62]["shared_or_default"]
    assert got["banner_hash", "hash"]["stability"] == "unavailable" and got["banner_hash", "hash"]["query_field"] is None
    assert ("cert_sha256", "z") not in got
    again = features.feature_catalog(features.observed_features(h, s)).collect()
    assert {r["feature_id"] for r in again} == {r["feature_id"] for r in got.values()}


def reference(spark, **changes):
    row = {"reference_set_id": "set", "cutoff_at": day(5), "protocol": "https", "ports": [443], "product": "relaybox", "window_start": None, "window_end": None, "registered_at": day(6)} | changes
    return spark.createDataFrame([tuple(row.values())], "reference_set_id string, cutoff_at timestamp, protocol string, ports array<int>, product string, window_start timestamp, window_end timestamp, registered_at timestamp")


def test_background(spark):
    h = hosts(spark, [("a", "i1", 1, None), ("b", "i2", 1, None), ("c", "i3", 7, None), ("d", "i4", 1, "no_response")])
    s = services(spark, [("a", 443, "q", None, None, "RelayBox"), ("b", 80, "q", None, None, "relaybox"), ("c", 443, "x", None, None, "relaybox")])
    got = {r["observation_id"]: r["exclusion_reason"] for r in background.memberships(reference(spark), h, s).collect()}
    assert got == {"a": None, "b": "stratum_mismatch", "c": "after_cutoff", "d": "not_observable"}


def test_statistics_and_eligibility(spark):
    h = hosts(spark, [(o, f"i-{o}", 1, None) for o in "abcd"])
    s = services(spark, [("a", 443, "q", None, None, None), ("b", 443, "q", None, None, None), ("c", 443, "x", None, None, None), ("d", 443, "y", None, None, None)])
    sets = reference(spark, product=None)
    seen = features.observed_features(h, s)
    catalog = features.feature_catalog(seen)
    anchors = spark.createDataFrame([("set", "a"), ("set", "b")], "reference_set_id string, observation_id string")
    members = background.memberships(sets, h, s).where("observation_id in ('c', 'd')")
    stats = background.feature_stats(catalog, seen, sets, members, anchors, manifest=True)
    judged = background.assess(stats, catalog)
    q = judged.join(catalog.select("feature_id", "canonical_value", "feature_type"), "feature_id").where("canonical_value = 'q'").collect()[0]
    assert (q["anchor_numerator"], q["anchor_denominator"], q["background_numerator"], q["background_denominator"]) == (2, 2, 0, 2)
    assert q["anchor_support"] == 1.0 and q["background_prevalence"] == 0.0 and q["status"] == "candidate" and len(q["source_manifest_hash"]) == 64
    reviews = spark.createDataFrame([(q["feature_id"], "accepted", day(9))], "assessment_id string, decision string, reviewed_at timestamp")
    told = background.eligible(judged.withColumn("assessment_id", F.col("feature_id")).withColumn("assessed_at", F.lit(day(8))), reviews)
    assert [r["feature_id"] for r in told.where("eligible").collect()] == [q["feature_id"]]
    nothing = background.assess(background.feature_stats(catalog, seen, sets, members.limit(0), anchors), catalog)
    assert all("matched_background_missing" in r["reason_codes"] for r in nothing.collect())


def test_wilson(spark):
    low, high = background.wilson(F.col("n"), F.col("d"))
    got = [tuple(r) for r in spark.createDataFrame([(0, 0), (2, 2), (5, 10)], "n int, d int").select(low, high).collect()]
    assert got[0] == (0.0, 1.0) and abs(got[1][0] - 0.34238) < 1e-4 and got[1][1] == 1.0 and abs(got[2][0] - 0.23659) < 1e-4


def test_shared_infrastructure(spark):
    h = hosts(spark, [("o1", "ioc-b", 2, None), ("o2", "ioc-a", 1, None), ("o3", "ioc-a", 3, None)])
    s = services(spark, [(o, 443, None, "j" * 62, None, None) for o in ("o1", "o2", "o3")])
    fps, edges = graph.fingerprint_graph(h, s)
    assert [r["first_available_at"] for r in fps.where("fingerprint_type = 'jarm'").collect()] == [day(1)]
    pairs, _ = graph.shared_infrastructure(graph.earliest_members(edges))
    assert [(r["left_id"], r["right_id"], r["relation_type"], r["available_at"]) for r in pairs.collect()] == [("ioc-a", "ioc-b", "shares_jarm", day(2))]


def test_shared_infrastructure_hot_key(spark):
    members = spark.range(400).select(F.lit("fp").alias("fingerprint_id"), F.lit("jarm").alias("fingerprint_type"), F.concat(F.lit("ioc-"), F.col("id").cast("string")).alias("indicator_id"), F.lit(T0).alias("available_at"), F.lit(T0).alias("valid_from"))
    for salt_members in (2000, 30):
        pairs, _ = graph.shared_infrastructure(members, salt_members=salt_members)
        assert pairs.count() == pairs.distinct().count() == 400 * 399 // 2
    rows, hot = graph.shared_infrastructure(members, max_members=100)
    star = graph.shared_with_first(members, hot)
    held = members.join(hot, "fingerprint_id").count() - hot.count()
    assert rows.count() + star.count() == held and star.where("left_id >= right_id").count() == 0
    none, hot = graph.shared_infrastructure(members, max_members=100)
    assert none.count() == 0 and hot.collect()[0]["members"] == 400
