"""Landmark timelines, continuity and the permission to pivot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import iso_text, joined_id
from .graph import SERVICE_TYPES


def effective_time() -> Column:
    return F.coalesce("observed_at", "collected_at")


def service_evidence(services: DataFrame) -> DataFrame:
    """observation_id and the sorted fingerprint ids of its services; software counts, port sets do not."""
    has = lambda c: F.nullif(F.col(c), F.lit("")) if c in services.columns else F.lit(None).cast("string")
    software = [has(c) for c in ("software_vendor", "software_product", "software_version")]
    kinds = [F.struct(F.lit(t).alias("t"), has(c).alias("v")) for t, c in SERVICE_TYPES.items()]
    kinds.append(F.struct(F.lit("software").alias("t"), F.nullif(F.concat_ws("|", *software), F.lit("")).alias("v")))
    each = services.select("observation_id", F.inline(F.array(*kinds))).where("v is not null")
    return each.groupBy("observation_id").agg(F.sort_array(F.collect_set(joined_id("fp", F.col("t"), F.col("v")))).alias("fingerprint_ids"))


def observation_kind() -> Column:
    reason = F.col("negative_reason")
    return F.when(F.col("host_observed"), "positive").when(reason.isin("not_found", "no_response", "api_error"), reason).otherwise("missing_scan")


def timeline(landmarks: DataFrame, hosts: DataFrame, services: DataFrame) -> DataFrame:
    """Entries of each landmark: its indicator's observations within the window, both ends in, in
    order (nth). landmarks: landmark_id, indicator_id, window_start, window_end."""
    told = hosts.withColumn("effective_at", effective_time()).join(landmarks.select("landmark_id", "indicator_id", "window_start", "window_end"), "indicator_id")
    told = told.where(F.col("effective_at").between(F.col("window_start"), F.col("window_end"))).join(service_evidence(services), "observation_id", "left")
    nth = F.row_number().over(Window.partitionBy("landmark_id").orderBy("effective_at", "collected_at", "observation_id"))
    return told.select(
        joined_id("timeline", F.col("landmark_id"), F.col("observation_id")).alias("timeline_entry_id"), "landmark_id", "observation_id", observation_kind().alias("observation_kind"), "observed_at", "collected_at",
        "effective_at", "host_observed", "negative_reason", F.coalesce("fingerprint_ids", F.array().cast("array<string>")).alias("fingerprint_ids"), nth.alias("nth"),
    )


def continuity(entries: DataFrame, landmarks: DataFrame | None = None, contradictions: DataFrame | None = None, assessed_at: Column | None = None) -> DataFrame:
    """One row for each landmark that has entries (or each of `landmarks`).

    Stable fingerprints are in every positive observation that has any, of two or more; if there are
    none, fingerprints seen once conflict. contradictions: landmark_id, observation_id.
    """
    positive = entries.where("host_observed")
    fps = positive.select("landmark_id", F.explode("fingerprint_ids").alias("fp")).groupBy("landmark_id", "fp").agg(F.count("*").alias("n"))
    sets = positive.where(F.size("fingerprint_ids") > 0).groupBy("landmark_id").agg(F.count("*").alias("n_sets"))
    told = fps.join(sets, "landmark_id").where("n_sets >= 2")
    split = told.groupBy("landmark_id").agg(F.sort_array(F.collect_list(F.when(F.col("n") == F.col("n_sets"), F.col("fp")))).alias("stable"), F.sort_array(F.collect_list(F.when(F.col("n") == 1, F.col("fp")))).alias("once"))
    # the latest is the first of the largest collected_at in timeline order
    latest = F.max_by(F.struct("observation_id", "observation_kind", "host_observed"), F.struct("collected_at", -F.col("nth")))
    base = entries.groupBy("landmark_id").agg(
        latest.alias("latest"), F.count_if("host_observed").alias("n_positive"), F.count_if(F.col("observation_kind") == "missing_scan").alias("missing_scan_count"),
        F.max(F.when(F.col("host_observed"), F.col("effective_at"))).alias("last_positive_at"), F.transform(F.array_sort(F.collect_list(F.struct("nth", "observation_id"))), lambda x: x["observation_id"]).alias("evidence_observation_ids"),
    )
    if landmarks is not None:
        base = landmarks.select("landmark_id").join(base, "landmark_id", "left")
    told = base.join(split, "landmark_id", "left")
    if contradictions is not None:
        told = told.join(contradictions.select("landmark_id", F.lit(True).alias("contradicted")).distinct(), "landmark_id", "left")
    else:
        told = told.withColumn("contradicted", F.lit(None).cast("boolean"))
    none = F.array().cast("array<string>")
    told = told.withColumn("stable_fingerprint_ids", F.coalesce("stable", none)).withColumn("conflicting_fingerprint_ids", F.when(F.size(F.coalesce("stable", none)) > 0, none).otherwise(F.coalesce("once", none)))
    historical = F.coalesce(F.col("n_positive") - F.col("latest.host_observed").cast("int"), F.lit(0))
    status = (
        F.when(F.coalesce("contradicted", F.lit(False)), "contradicted").when(historical == 0, "unknown").when(F.size("stable_fingerprint_ids") > 0, "continuous")
        .when(F.size("conflicting_fingerprint_ids") > 0, "reassigned").otherwise("probable")
    )
    out = told.select(
        "landmark_id", status.alias("status"), F.when(~F.col("latest.observation_kind").isin("missing_scan", "api_error"), F.col("latest.host_observed")).alias("current_response"), historical.alias("historical_positive_count"),
        F.coalesce("missing_scan_count", F.lit(0)).alias("missing_scan_count"), "last_positive_at", "stable_fingerprint_ids", "conflicting_fingerprint_ids", F.coalesce("evidence_observation_ids", none).alias("evidence_observation_ids"),
    ).withColumn("derived_pivot_allowed", F.col("status") == "continuous")
    if assessed_at is not None:
        out = out.withColumn("assessment_id", joined_id("continuity", F.col("landmark_id"), F.col("status"), iso_text(assessed_at), F.array_join("evidence_observation_ids", ","))).withColumn("assessed_at", assessed_at)
    return out


def pivot_permission(assessments: DataFrame, reviews: DataFrame) -> DataFrame:
    """assessments with allowed: continuous, or probable with an accepted review that allows it; never
    if rejected. reviews: assessment_id, decision, allow_probable."""
    told = assessments.join(reviews.select("assessment_id", "decision", "allow_probable"), "assessment_id", "left")
    allowed = F.when(F.col("decision") == "rejected", False).when(F.col("status") == "continuous", True).otherwise(F.coalesce((F.col("status") == "probable") & (F.col("decision") == "accepted") & F.col("allow_probable"), F.lit(False)))
    return told.withColumn("allowed", allowed)


def timeline_gates(entries: DataFrame, landmarks: DataFrame, queries: DataFrame, hosts: DataFrame) -> DataFrame:
    """Reasons against landmarks and entries: landmark_query_unknown, landmark_query_not_q0,
    landmark_not_owned, observation_unknown, observation_of_other_indicator.

    queries: query_id, query_class, source_indicator_ids, source_assertion_ids."""
    told = landmarks.join(queries, "query_id", "left")
    owns = F.array_contains("source_indicator_ids", F.col("indicator_id")) & F.array_contains("source_assertion_ids", F.col("assertion_id"))
    reason = F.when(F.col("query_class").isNull(), "landmark_query_unknown").when(F.col("query_class") != "q0_seed", "landmark_query_not_q0").when(~F.coalesce(owns, F.lit(False)), "landmark_not_owned")
    first = told.select(F.col("landmark_id").alias("record_id"), reason.alias("reason"))
    seen = entries.select("timeline_entry_id", "landmark_id", "observation_id").join(landmarks.select("landmark_id", F.col("indicator_id").alias("own")), "landmark_id", "left").join(hosts.select("observation_id", "indicator_id"), "observation_id", "left")
    reason = F.when(F.col("indicator_id").isNull(), "observation_unknown").when(~F.col("indicator_id").eqNullSafe(F.col("own")), "observation_of_other_indicator")
    return first.unionByName(seen.select(F.col("timeline_entry_id").alias("record_id"), reason.alias("reason"))).where("reason is not null")
