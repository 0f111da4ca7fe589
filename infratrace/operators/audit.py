"""Integrity audits: violations as rows of code, record_id, detail; an audit passes if there are none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import stash
from . import background, constraints, corpus, mining, rules


def issue(df: DataFrame, code: Column | str, record: str, detail: Column | None = None) -> DataFrame:
    code = F.lit(code) if isinstance(code, str) else code
    return df.select(code.alias("code"), F.col(record).cast("string").alias("record_id"), (detail if detail is not None else F.lit(None)).cast("string").alias("detail"))


def union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def invalid_rows(df: DataFrame, table: str, key: str) -> DataFrame:
    """Rows that break their table's rules, as invalid_<table> with the rules in detail."""
    bad = constraints.check(df, table).where(F.size("violations") > 0)
    return issue(bad, f"invalid_{table}", key, F.array_join("violations", ","))


def orphans(child: DataFrame, parent: DataFrame, key: str, record: str, code: str) -> DataFrame:
    return issue(child.join(parent.select(key).distinct(), key, "left_anti"), code, record)


def counts(issues: DataFrame) -> DataFrame:
    return issues.groupBy("code").agg(F.count("*").alias("issues"))


def table_counts(tables: dict[str, DataFrame], issues: DataFrame | None = None) -> DataFrame:
    """kind, name, rows: the rows of each table, and of each issue code."""
    parts = [df.agg(F.count("*").alias("rows")).select(F.lit("table").alias("kind"), F.lit(name).alias("name"), "rows") for name, df in tables.items()]
    if issues is not None:
        parts.append(counts(issues).select(F.lit("issue").alias("kind"), F.col("code").alias("name"), F.col("issues").alias("rows")))
    return union(parts)


def audit_corpus(documents: DataFrame, families: DataFrame, memberships: DataFrame, assertions: DataFrame, protocols: DataFrame | None = None) -> DataFrame:
    """Stage 0: search protocols (name, version, queries, allowlist, acquisition_mode,
    source_access_class, search_protocol_id), documents, families and assertions' documents."""
    parts = [invalid_rows(documents, "source_documents", "document_id"), orphans(documents, memberships, "document_id", "document_id", "missing_source_family")]
    if protocols is not None:
        again = mining.search_protocols(protocols.withColumnRenamed("search_protocol_id", "_stored"))
        reason = F.coalesce("reason", F.when(~F.col("_stored").eqNullSafe(F.col("search_protocol_id")), "id_differs"))
        parts.insert(0, issue(again.withColumn("reason", reason).where("reason is not null"), "invalid_search_protocol", "_stored", F.col("reason")))
    checks = corpus.family_checks(families, memberships, documents)
    parts.append(checks.select("code", F.col("record_id").cast("string").alias("record_id"), F.lit(None).cast("string").alias("detail")))
    parts.append(orphans(assertions, documents, "document_id", "assertion_id", "invalid_assertion_document"))
    return union(parts)


def audit_assertions(mentions: DataFrame, assertions: DataFrame, reviews: DataFrame, indicators: DataFrame, memberships: DataFrame, queries: DataFrame) -> DataFrame:
    """Phase A: mentions, assertions, reviews, and the assertions that queries rest on."""
    parts = [invalid_rows(mentions, "source_mentions", "mention_id"), invalid_rows(reviews, "assertion_reviews", "review_id")]
    parts.append(corpus.bundle_checks(mentions, assertions, indicators, memberships).select("code", F.col("record_id").cast("string").alias("record_id"), F.lit(None).cast("string").alias("detail")))
    parts.append(issue(queries.where(F.size(F.coalesce("source_assertion_ids", F.array().cast("array<string>"))) == 0), "query_lacks_assertion_provenance", "query_id"))
    used = queries.select("query_id", "registered_at", F.explode("source_assertion_ids").alias("assertion_id")).join(reviews.select("assertion_id", "decision"), "assertion_id", "left").join(assertions.select("assertion_id", "available_at"), "assertion_id", "left")
    parts.append(issue(used.where(~F.col("decision").eqNullSafe(F.lit("accepted"))), "query_uses_unaccepted_assertion", "query_id", F.col("assertion_id")))
    parts.append(issue(used.where("registered_at < available_at"), "query_predates_assertion_availability", "query_id", F.col("assertion_id")))
    return union(parts)


def audit_watch(queries: DataFrame, landmarks: DataFrame, precheck_eligibility: DataFrame, reviews: DataFrame) -> DataFrame:
    """Phase B: watch queries have landmarks, accepted prechecks are eligible, Q2 rests on such.

    queries: query_id, query_class, source_precheck_ids. precheck_eligibility: precheck_id, eligible."""
    q0 = queries.where("query_class = 'q0_seed'").join(landmarks.select("query_id").distinct(), "query_id", "left_anti")
    accepted = reviews.where("decision = 'accepted'").join(precheck_eligibility.select("precheck_id", "eligible"), "precheck_id", "left")
    q2 = queries.where("query_class = 'q2_derived'")
    each = q2.select("query_id", F.explode("source_precheck_ids").alias("precheck_id")).join(precheck_eligibility.select("precheck_id", "eligible"), "precheck_id", "left")
    not_ok = ~F.coalesce("eligible", F.lit(False))
    return union([
        invalid_rows(landmarks, "landmarks", "landmark_id"), issue(q0, "q0_query_lacks_landmark", "query_id"), issue(accepted.where(not_ok), "accepted_precheck_not_eligible", "precheck_id"),
        issue(q2.where(F.size(F.coalesce("source_precheck_ids", F.array().cast("array<string>"))) == 0), "q2_lacks_precheck_provenance", "query_id"), issue(each.where(not_ok), "q2_has_ineligible_precheck", "query_id", F.col("precheck_id")),
    ])


def differences(stored: DataFrame, again: DataFrame, key: list[str], columns: list[str], code: str) -> DataFrame:
    """Rows that are stored and do not come out again, or the other way round, or differ."""
    label = lambda df, n: df.select(*key, F.struct(*columns).alias(n))
    both = label(stored, "_s").join(label(again, "_a"), key, "full")
    record = F.concat_ws("|", *[F.col(k).cast("string") for k in key])
    return both.where(~F.col("_s").eqNullSafe(F.col("_a"))).select(F.lit(code).alias("code"), record.alias("record_id"), F.when(F.col("_a").isNull(), "not reproduced").when(F.col("_s").isNull(), "not stored").otherwise("differs").alias("detail"))


def audit_features(catalog: DataFrame, observations: DataFrame, sets: DataFrame, members: DataFrame, anchors: DataFrame, stats: DataFrame, assessments: DataFrame, reviews: DataFrame, hosts: DataFrame, services: DataFrame) -> DataFrame:
    """Phase C: what is stored comes out again from what it was made of. Statistics are made once, while the
    DataFrame is built."""
    again = background.memberships(sets, hosts, services)
    told = stash(background.feature_stats(catalog, observations, sets, members, anchors), "audit-stats")
    judged = background.assess(told, catalog)
    numbers = ["anchor_numerator", "anchor_denominator", "background_numerator", "background_denominator"]
    accepted = reviews.where("decision = 'accepted'").join(assessments.select("assessment_id", "status"), "assessment_id", "left").where(~F.col("status").eqNullSafe(F.lit("candidate")))
    return union([
        invalid_rows(catalog, "features", "feature_id"), differences(members, again, ["membership_id"], ["observable", "exclusion_reason"], "non_reproducible_reference_sets"),
        differences(stats, told, ["feature_id", "reference_set_id"], numbers, "non_reproducible_feature_stat_snapshots"),
        differences(assessments, judged, ["feature_id", "reference_set_id"], ["status", "reason_codes"], "non_reproducible_feature_eligibility_assessments"), issue(accepted, "accepted_feature_not_eligible", "assessment_id"),
    ])


def audit_freezes(queries: DataFrame, stored: DataFrame, designs: DataFrame, schedules: DataFrame, prechecks: DataFrame, reviews: DataFrame) -> DataFrame:
    """Phase D: frozen queries have a manifest, and manifests come out again. One freeze a design."""
    lacking = queries.where("status = 'frozen'").join(stored.select("query_id").distinct(), "query_id", "left_anti")
    when = stored.select("design_id", F.col("frozen_at").alias("_f"), F.col("valid_for_test_from").alias("_v"))
    again = rules.freeze_manifests(designs.join(when, "design_id"), schedules, prechecks, reviews, F.col("_f"), F.col("_v"))
    return union([invalid_rows(queries, "queries", "query_id"), issue(lacking, "frozen_query_lacks_manifest", "query_id"), differences(stored, again, ["design_id"], ["lineage_hash"], "non_reproducible_freeze_manifest")])


def audit_candidates(candidates: DataFrame, events: DataFrame) -> DataFrame:
    """Phase E: candidates whose first event is not there."""
    known = events.select(F.col("event_id").alias("first_observation_event_id")).distinct()
    return issue(candidates.join(known, "first_observation_event_id", "left_anti"), "candidate_without_event", "candidate_id")


def unresolved_times(events: DataFrame) -> DataFrame:
    return events.agg(F.count("*").alias("events"), F.count_if(F.col("time_status") == "unresolved").alias("unresolved"))
