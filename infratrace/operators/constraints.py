"""Row rules of the tables: every row gets the sorted names of the rules it breaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sizes import broadcast_if_few

c = F.col


def violations(df: DataFrame, rules: dict[str, Column], name: str = "violations") -> DataFrame:
    """df with the codes of broken rules; a rule is the condition under which a row is wrong, and null
    is not wrong."""
    codes = F.array(*[F.when(cond, F.lit(code)) for code, cond in rules.items()])
    return df.withColumn(name, F.array_sort(F.array_compact(codes)))


def passing(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    return violations(df, rules).where(F.size("violations") == 0).drop("violations")


def blank(column: str) -> Column:
    return F.coalesce(F.trim(c(column)), F.lit("")) == ""


def not_hash(column: str) -> Column:
    return ~F.coalesce(c(column).rlike("^[0-9a-f]{64}$"), F.lit(False))


def out_of(column: str, low: float, high: float) -> Column:
    return ~c(column).between(low, high)


def table_rules() -> dict[str, dict[str, Column]]:
    """The rules of every table; columns need a session, so they are made on demand."""
    exact = c("published_time_precision") == "exact_timestamp"
    return {
        "source_documents": {
            "document_id_missing": blank("document_id"), "content_hash_invalid": not_hash("content_sha256"), "exact_time_missing": exact & c("published_at").isNull(), "coarse_time_promoted": ~exact & c("published_at").isNotNull(),
            "raw_time_missing": (c("published_time_precision") != "unknown") & blank("published_at_raw"), "published_after_retrieval": c("published_at") > c("retrieved_at"),
        },
        "source_mentions": {"hash_invalid": not_hash("raw_form_hash") | not_hash("context_excerpt_hash"), "observed_after_available": c("observed_at") > c("available_at"), "family_missing": blank("source_family_id")},
        "assertion_reviews": {
            "accepted_without_confidence": (c("decision") == "accepted") & (c("source_confidence").isNull() | c("extraction_confidence").isNull() | c("role_confidence").isNull()),
            "accepted_role_invalid": (c("decision") == "accepted") & F.coalesce(c("reviewed_role"), F.lit("unknown")).isin("unknown", "victim", "sinkhole"), "reviewer_missing": blank("reviewer_id"),
            "confidence_out_of_range": out_of("source_confidence", 0, 1) | out_of("extraction_confidence", 0, 1) | out_of("role_confidence", 0, 1),
        },
        "host_observations": {
            "negative_without_reason": ~c("host_observed") & c("negative_reason").isNull(), "positive_with_reason": c("host_observed") & c("negative_reason").isNotNull(), "observed_after_collected": c("observed_at") > c("collected_at"),
        },
        "service_observations": {"port_out_of_range": out_of("port", 1, 65535), "transport_invalid": ~c("transport").isin("tcp", "udp")},
        "landmarks": {"window_reversed": c("window_end") < c("window_start"), "registered_before_source": c("registered_at") < c("source_available_at")},
        "features": {"value_missing": blank("canonical_value"), "hash_mismatch": c("canonical_value_hash") != F.sha2(c("canonical_value").cast("binary"), 256), "unavailable_with_field": (c("stability") == "unavailable") & c("query_field").isNotNull(), "stable_without_field": (c("stability") == "stable") & c("query_field").isNull()},
        "feature_observations": {"observed_after_available": c("observed_at") > c("available_at")},
        "entity_epochs": {"interval_reversed": c("valid_to") < c("valid_from"), "observations_missing": c("observations") <= 0},
        "reference_sets": {"registered_before_cutoff": c("registered_at") < c("cutoff_at"), "manifest_invalid": not_hash("snapshot_manifest_hash"), "runs_missing": F.size("source_query_run_ids") <= 0},
        "reference_memberships": {"reason_on_observable": c("observable") & c("exclusion_reason").isNotNull(), "reason_missing": ~c("observable") & c("exclusion_reason").isNull()},
        "feature_stats": {
            "numerator_above_denominator": (c("anchor_numerator") > c("anchor_denominator")) | (c("background_numerator") > c("background_denominator")), "interval_reversed": (c("anchor_ci_low") > c("anchor_ci_high")) | (c("background_ci_low") > c("background_ci_high")),
            "support_out_of_range": out_of("anchor_support", 0, 1) | out_of("background_prevalence", 0, 1),
        },
        "feature_eligibility": {"blocked_without_reason": (c("status") == "blocked") & (F.size("reason_codes") <= 0), "candidate_with_reason": (c("status") == "candidate") & (F.size("reason_codes") > 0)},
        "clauses": {
            "direct_without_source": (c("feature_origin") == "cti_direct") & c("source_assertion_id").isNull() & c("source_precheck_id").isNull(), "derived_without_feature": (c("feature_origin") == "derived") & c("source_feature_id").isNull(),
            "derived_with_assertion": (c("feature_origin") == "derived") & c("source_assertion_id").isNotNull(), "field_or_value_missing": blank("query_field") | blank("canonical_value"),
        },
        "schedules": {"interval_not_positive": c("interval_hours") <= 0, "budget_negative": (c("max_alerts_per_run") < 0) | (c("max_credits_per_run") < 0)},
        "queries": {"frozen_without_time": (c("status") == "frozen") & (c("frozen_at").isNull() | c("valid_for_test_from").isNull()), "valid_before_frozen": c("valid_for_test_from") < c("frozen_at"), "hash_mismatch": c("query_hash") != F.sha2(c("query_text").cast("binary"), 256)},
        "opportunities": {"window_reversed": c("window_end") <= c("due_at"), "run_missing": c("status").isin("complete", "late", "partial") & c("query_run_id").isNull(), "missed_without_reason": (c("status") == "missed") & blank("reason")},
        "prospective_events": {"eligible_without_time": (c("time_status") == "eligible") & c("observed_at").isNull(), "unresolved_with_time": (c("time_status") == "unresolved") & c("observed_at").isNotNull()},
        "evidence": {"unavailable_with_support": (c("availability") != "available") & c("supports_candidate").isNotNull(), "validation_without_support": (c("availability") == "available") & (c("role") == "validation") & c("supports_candidate").isNull()},
        "adjudications": {"adjudicator_missing": blank("adjudicator_id"), "evidence_missing": c("status").isin("positive", "negative", "contradicted") & (F.size("evidence_ids") <= 0)},
    }


def check(df: DataFrame, name: str) -> DataFrame:
    """df with violations by the rules of the named table; rules on columns it lacks are left out."""
    usable = {}
    for code, rule in table_rules()[name].items():
        try:
            df.select(rule)
        except Exception as e:  # noqa: BLE001
            if "UNRESOLVED_COLUMN" not in str(e):
                raise
        else:
            usable[code] = rule
    return violations(df, usable)


def as_of(df: DataFrame, cutoff: Column, available_at: str = "available_at") -> DataFrame:
    """Rows known by the cutoff, the cutoff itself included."""
    return df.where(c(available_at) <= cutoff)


def leakage(df: DataFrame, cutoff: Column, by: list[str], available_at: str = "available_at") -> DataFrame:
    """How many rows of each group come after the cutoff."""
    return df.groupBy(*by).agg(F.count("*").alias("rows"), F.count_if(c(available_at) > cutoff).alias("leaked"))


def development_only(documents: DataFrame) -> DataFrame:
    """documents with reason: provenance_missing, prospective_material or null."""
    missing = blank("acquisition_mode") | blank("corpus_purpose") | blank("source_access_class")
    return documents.withColumn("reason", F.when(missing, "provenance_missing").when((c("acquisition_mode") == "prospective_validation") | (c("corpus_purpose") == "prospective_validation"), "prospective_material"))


def supported_questions(queries: DataFrame, pairs: DataFrame) -> DataFrame:
    """queries with supported: whether (query_class, question) is among the pairs."""
    return queries.join(broadcast_if_few(pairs.select("query_class", "question", F.lit(True).alias("supported")).distinct()), ["query_class", "question"], "left").na.fill(False, ["supported"])
