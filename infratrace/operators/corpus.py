"""Source families, bundles and reviews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Registers of a sketch, as a power of two, and the relative standard error that follows.
SKETCH = 12
ERROR = 1.04 / 2 ** (SKETCH / 2)


def independent_sources(claims: DataFrame, memberships: DataFrame, by: list[str]) -> DataFrame:
    """by, documents, independent_sources (different families) and documents without a family.
    claims: by and document_id; memberships: document_id, source_family_id."""
    told = claims.join(memberships.select("document_id", "source_family_id"), "document_id", "left")
    return told.groupBy(*by).agg(F.count_distinct("document_id").alias("documents"), F.count_distinct("source_family_id").alias("independent_sources"), F.count_if(F.col("source_family_id").isNull()).alias("without_family"))


def family_sketches(claims: DataFrame, memberships: DataFrame, by: list[str], period: list[str], size: int = SKETCH) -> DataFrame:
    """A sketch (HyperLogLog, 2**size registers) of the families of each `by` and period, to be stored: a later
    period adds rows and the earlier ones are not read again. claims: by, period and document_id."""
    told = claims.join(memberships.select("document_id", "source_family_id"), "document_id").where("source_family_id is not null")
    return told.groupBy(*by, *period).agg(F.hll_sketch_agg("source_family_id", size).alias("families"), F.count("*").alias("claims"))


def estimated_sources(sketches: DataFrame, by: list[str]) -> DataFrame:
    """by, claims and the estimated number of different families over all periods of `family_sketches`, with its
    relative standard error (of sketches of SKETCH registers)."""
    merged = sketches.groupBy(*by).agg(F.hll_union_agg("families").alias("f"), F.sum("claims").alias("claims"))
    return merged.select(*by, "claims", F.hll_sketch_estimate("f").alias("estimated_sources"), F.lit(ERROR).alias("relative_error"))


def family_checks(families: DataFrame, memberships: DataFrame, documents: DataFrame) -> DataFrame:
    """code, record_id: a document in two families, a family of unknown or foreign canonical document,
    a membership of an unknown document or family."""
    two = memberships.groupBy("document_id").agg(F.count_distinct("source_family_id").alias("n")).where("n > 1").select(F.lit("document_in_two_families").alias("code"), F.col("document_id").alias("record_id"))
    known = documents.select("document_id").distinct()
    orphan = memberships.join(known, "document_id", "left_anti").select(F.lit("unknown_document").alias("code"), F.col("document_id").alias("record_id"))
    nowhere = memberships.join(families.select("source_family_id").distinct(), "source_family_id", "left_anti").select(F.lit("unknown_family").alias("code"), F.col("document_id").alias("record_id"))
    missing = families.select(F.col("canonical_document_id").alias("document_id"), "source_family_id").join(known, "document_id", "left_anti").select(F.lit("missing_canonical_document").alias("code"), F.col("source_family_id").alias("record_id"))
    own = families.select(F.col("canonical_document_id").alias("document_id"), "source_family_id").join(memberships.select("document_id", F.col("source_family_id").alias("m")), "document_id", "left").where(~F.col("m").eqNullSafe(F.col("source_family_id")))
    canonical = own.select(F.lit("invalid_canonical_membership").alias("code"), F.col("source_family_id").alias("record_id"))
    return two.unionAll(orphan).unionAll(nowhere).unionAll(missing).unionAll(canonical)


def bundle_checks(mentions: DataFrame, assertions: DataFrame, indicators: DataFrame, memberships: DataFrame) -> DataFrame:
    """code, record_id: references that leave the batch or the document's family."""
    m = mentions.join(indicators.select("indicator_id", F.lit(True).alias("_i")).distinct(), "indicator_id", "left").join(memberships.select("document_id", F.col("source_family_id").alias("_f")), "document_id", "left")
    code = F.when(F.col("_i").isNull(), "mention_indicator_missing").when(~F.col("_f").eqNullSafe(F.col("source_family_id")), "mention_family_mismatch")
    first = m.select(code.alias("code"), F.col("mention_id").alias("record_id"))
    own = mentions.select(F.col("mention_id").alias("source_mention_id"), F.col("indicator_id").alias("_i"), F.col("document_id").alias("_d"), F.col("available_at").alias("_t"))
    a = assertions.join(own, "source_mention_id", "left")
    code = F.when(F.col("_i").isNull(), "assertion_mention_missing").when((F.col("_i") != F.col("indicator_id")) | (F.col("_d") != F.col("document_id")) | (F.col("_t") != F.col("available_at")), "assertion_mention_differs")
    return first.unionAll(a.select(code.alias("code"), F.col("assertion_id").alias("record_id"))).where("code is not null")


def review_gate(reviews: DataFrame, subjects: DataFrame, subject: str, accepts: Column | None = None, time: str = "assessed_at") -> DataFrame:
    """reviews (subject, decision, reviewed_at) with reason: unknown subject, older than the subject,
    more than one review of it, accepted though `accepts` (a condition on the subject) is false."""
    n = reviews.groupBy(subject).agg(F.count("*").alias("_n"))
    own = subjects.select(F.col(subject), F.col(time).alias("_time"), (accepts if accepts is not None else F.lit(True)).alias("_ok"))
    told = reviews.join(own, subject, "left").join(n, subject)
    reason = F.when(F.col("_time").isNull(), "unknown_subject").when(F.col("reviewed_at") < F.col("_time"), "review_predates_subject").when(F.col("_n") > 1, "reviewed_twice").when((F.col("decision") == "accepted") & ~F.col("_ok"), "subject_does_not_qualify")
    return told.withColumn("reason", reason).drop("_n", "_time", "_ok")


def assertion_review_gate(reviews: DataFrame, assertions: DataFrame) -> DataFrame:
    """As review_gate; accepted reviews need a pivotable role and confidences above zero."""
    told = review_gate(reviews, assertions, "assertion_id", time="available_at")
    weak = F.coalesce(F.least("source_confidence", "extraction_confidence", "role_confidence"), F.lit(0.0)) <= 0
    role = F.coalesce(F.col("reviewed_role"), F.lit("unknown")).isin("unknown", "victim", "sinkhole")
    accepted = F.col("decision") == "accepted"
    return told.withColumn("reason", F.coalesce("reason", F.when(accepted & role, "role_not_allowed").when(accepted & (weak | F.col("source_confidence").isNull() | F.col("extraction_confidence").isNull() | F.col("role_confidence").isNull()), "confidence_missing")))


def observation_runs(assessments: DataFrame, hosts: DataFrame, precheck_results: DataFrame, sources: DataFrame) -> DataFrame:
    """source_id, query_run_id: runs that eligible sources rest on. sources: source_id (a continuity
    assessment or a precheck). Assessments give their evidence's runs, prechecks their latest run."""
    from .pivots import latest_results

    own = assessments.join(sources, F.col("assessment_id") == F.col("source_id"), "left_semi").select(F.col("assessment_id").alias("source_id"), F.explode("evidence_observation_ids").alias("observation_id"))
    first = own.join(hosts.select("observation_id", "query_run_id"), "observation_id").select("source_id", "query_run_id")
    last = latest_results(precheck_results).join(sources, F.col("precheck_id") == F.col("source_id"), "left_semi").select(F.col("precheck_id").alias("source_id"), F.col("collection_run_id").alias("query_run_id"))
    return first.unionAll(last).distinct()


def provenance_gates(sets: DataFrame, members: DataFrame, hosts: DataFrame, runs: DataFrame) -> DataFrame:
    """code, record_id: reference sets on unknown or incomplete runs, memberships outside their set's
    runs, observable members after the cutoff. runs: query_run_id, status."""
    used = sets.select("reference_set_id", "cutoff_at", F.explode("source_query_run_ids").alias("query_run_id"))
    bad = used.join(runs.select("query_run_id", "status"), "query_run_id", "left").where(~F.col("status").eqNullSafe(F.lit("complete"))).select(F.lit("set_run_not_complete").alias("code"), F.col("reference_set_id").alias("record_id")).distinct()
    rows = members.join(hosts.select("observation_id", "query_run_id", F.coalesce("observed_at", "collected_at").alias("seen"), "collected_at"), "observation_id", "left")
    outside = rows.join(used.select("reference_set_id", "query_run_id"), ["reference_set_id", "query_run_id"], "left_anti").select(F.lit("member_outside_runs").alias("code"), F.col("membership_id").alias("record_id"))
    late = rows.join(sets.select("reference_set_id", "cutoff_at"), "reference_set_id").where("observable and greatest(seen, collected_at) > cutoff_at").select(F.lit("member_after_cutoff").alias("code"), F.col("membership_id").alias("record_id"))
    return bad.unionAll(outside).unionAll(late)


def feature_observation_gates(observations: DataFrame, hosts: DataFrame) -> DataFrame:
    """observations (feature_observation_id, observation_id, query_run_id, available_at) with reason:
    raw_provenance_mismatch (no such observation, or another run's), availability_differs or null."""
    own = hosts.select("observation_id", F.col("query_run_id").alias("_run"), F.col("collected_at").alias("_collected"))
    told = observations.join(own, "observation_id", "left")
    reason = F.when(~F.col("_run").eqNullSafe(F.col("query_run_id")), "raw_provenance_mismatch").when(F.col("available_at") != F.col("_collected"), "availability_differs")
    return told.withColumn("reason", reason).select(*observations.columns, "reason")


def anchor_gates(anchors: DataFrame, sets: DataFrame, hosts: DataFrame, runs: DataFrame) -> DataFrame:
    """anchors (reference_set_id, observation_id) of statistics with reason: anchor_unknown,
    anchor_not_observed, anchor_not_authorized (its run is not one of `runs`), anchor_after_cutoff or null."""
    own = hosts.select("observation_id", "host_observed", "query_run_id", F.coalesce("observed_at", "collected_at").alias("_seen"), F.col("collected_at").alias("_collected"))
    told = anchors.join(own, "observation_id", "left").join(runs.select("query_run_id", F.lit(True).alias("_allowed")).distinct(), "query_run_id", "left").join(sets.select("reference_set_id", F.col("cutoff_at").alias("_cutoff")), "reference_set_id")
    c = F.col
    reason = F.when(c("_collected").isNull(), "anchor_unknown").when(~c("host_observed"), "anchor_not_observed").when(c("_allowed").isNull(), "anchor_not_authorized").when(F.greatest("_seen", "_collected") > c("_cutoff"), "anchor_after_cutoff")
    return told.withColumn("reason", reason).select(*anchors.columns, "reason")
