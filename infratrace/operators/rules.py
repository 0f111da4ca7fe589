"""Clauses to rules: building, checking, rendering, matching, freezing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import iso_text, json_id, joined_id, sha256_text
from ..sources.shared import stash

OPERATORS = {"required": "AND", "alternative": "OR", "exclusion": "NOT"}
#: Clause origins of each kind of composition.
ORIGINS = {"cti_only": ("cti_direct",), "cti_derived": ("cti_direct", "derived"), "derived_only": ("derived",)}


def build_clauses(clauses: DataFrame, canonicalizer_version: str = "v1") -> DataFrame:
    """clauses with operator, clause_id and reason (score_only_clause, provenance_missing)."""
    own = ["feature_origin", "logical_role", "cooccurrence_scope", "query_field", "canonical_value", "source_assertion_id", "source_precheck_id", "source_feature_id", "node_id"]
    rows = clauses.withColumns({c: F.trim(c) for c in ("query_field", "canonical_value")})
    operator = F.create_map(*[F.lit(x) for kv in OPERATORS.items() for x in kv])[F.col("logical_role")]
    ident = json_id("query-clause", canonicalizer_version=F.lit(canonicalizer_version), **{c: F.col(c) for c in own})
    source = F.when(F.col("feature_origin") == "cti_direct", F.coalesce("source_assertion_id", "source_precheck_id")).otherwise(F.col("source_feature_id"))
    reason = F.when(operator.isNull(), "score_only_clause").when(source.isNull(), "provenance_missing")
    return rows.withColumn("operator", operator).withColumn("clause_id", F.when(operator.isNotNull(), ident)).withColumn("reason", reason)


def validate_designs(designs: DataFrame, clauses: DataFrame, assertions: DataFrame, prechecks: DataFrame, features: DataFrame) -> DataFrame:
    """designs (design_id, query_class, composition_type, cutoff_at) with the sorted reasons against them.

    clauses: design_id and a clause's columns. assertions, prechecks: accepted ids; features: the
    eligible catalog (feature_id, query_field, canonical_value, first_available_at)."""
    f = features.select(F.col("feature_id").alias("source_feature_id"), F.col("query_field").alias("_field"), F.col("canonical_value").alias("_value"), F.col("first_available_at").alias("_first"))
    told = (
        clauses.join(assertions.select(F.col("assertion_id").alias("source_assertion_id"), F.lit(True).alias("_a")).distinct(), "source_assertion_id", "left")
        .join(prechecks.select(F.col("precheck_id").alias("source_precheck_id"), F.lit(True).alias("_p")).distinct(), "source_precheck_id", "left").join(f, "source_feature_id", "left")
        .join(designs.select("design_id", "cutoff_at"), "design_id")
    )
    c = F.col
    direct = c("feature_origin") == "cti_direct"
    rules = {
        "feature_leakage": c("available_at") > c("cutoff_at"), "unaccepted_cti_provenance": direct & c("_a").isNull() & c("_p").isNull(), "feature_not_eligible": ~direct & c("_field").isNull(),
        "query_field_differs": ~direct & (c("_field") != c("query_field")), "value_differs": ~direct & (c("_value") != c("canonical_value")), "availability_differs": ~direct & (c("_first") != c("available_at")),
    }
    codes = F.array_compact(F.array(*[F.when(cond, k) for k, cond in rules.items()]))
    required_nodes = F.collect_set(F.when(direct & (c("logical_role") == "required"), F.col("node_id")))
    each = told.groupBy("design_id").agg(
        F.array_distinct(F.flatten(F.collect_list(codes))).alias("codes"), F.count("*").alias("n"), F.count_distinct("clause_id").alias("n_different"), F.array_sort(F.collect_set("feature_origin")).alias("origins"),
        F.size(required_nodes).alias("nodes"), F.bool_or(c("cooccurrence_scope") == "graph_edge").alias("edge"), F.bool_or(c("logical_role").isin("required", "alternative")).alias("positive"),
    )
    out = designs.join(each, "design_id", "left")
    expected = F.create_map(*[x for k, v in ORIGINS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])[c("composition_type")]
    q3 = c("composition_type") == "q3_graph_expansion"
    own = {
        "clauses_missing": c("n").isNull(), "clauses_duplicated": c("n") != c("n_different"), "class_not_supported": ~c("query_class").isin("q2_derived", "q3_cluster"),
        "q3_needs_graph_expansion": ((c("query_class") == "q3_cluster") != q3), "graph_edge_missing": q3 & ~F.coalesce(c("edge"), F.lit(False)), "composition_mismatch": ~q3 & ~c("origins").eqNullSafe(expected),
        "required_nodes_differ": c("nodes") > 1, "positive_clause_missing": ~F.coalesce(c("positive"), F.lit(False)),
    }
    reasons = F.array_sort(F.array_distinct(F.concat(F.coalesce("codes", F.array().cast("array<string>")), F.array_compact(F.array(*[F.when(cond, k) for k, cond in own.items()])))))
    return out.withColumn("reasons", reasons).select(*designs.columns, "reasons")


def quoted(value: Column) -> Column:
    """A JSON string literal."""
    text = F.to_json(F.struct(value.alias("v")))
    return F.substring(text, F.lit(6), F.length(text) - 6)


def render(clauses: DataFrame, by: str = "design_id") -> DataFrame:
    """by, rule: required AND (alternatives) AND NOT (exclusions), each in clause_id order."""
    each = F.struct("clause_id", "logical_role", F.concat("query_field", F.lit(": "), quoted(F.col("canonical_value"))).alias("text"))
    got = clauses.groupBy(by).agg(F.array_sort(F.collect_list(each)).alias("c"))
    of = lambda role: F.transform(F.filter("c", lambda x: x["logical_role"] == role), lambda x: x["text"])
    alternatives = F.when(F.size(of("alternative")) > 0, F.array(F.concat(F.lit("("), F.array_join(of("alternative"), " OR "), F.lit(")")))).otherwise(F.array().cast("array<string>"))
    excluded = F.transform(of("exclusion"), lambda t: F.concat(F.lit("NOT ("), t, F.lit(")")))
    rule = F.array_join(F.concat(of("required"), alternatives, excluded), " AND ")
    return got.where((F.size(of("required")) > 0) | (F.size(of("alternative")) > 0)).select(by, rule.alias("rule"))


def match_rules(observations: DataFrame, clauses: DataFrame, entity: str = "observation_id") -> DataFrame:
    """design_id and entity of every match: all required clauses, one alternative if there are any, no
    exclusion. observations: entity, query_field, canonical_value.

    Observations become numbers of the clauses' terms (field and value), others are dropped, and are dealt
    out by entity once: all that follows stays within an entity. Rules whose required clauses are all
    there are looked up among the entity's other terms, for their alternatives and exclusions. Rules that
    require nothing begin with an alternative. Rows without an entity match nothing. Clauses are read
    while the DataFrame is built."""
    own = clauses.select("design_id", "clause_id", "logical_role", "query_field", "canonical_value").distinct()
    is_role = lambda r: F.coalesce(F.col("logical_role") == r, F.lit(False))
    needs = own.groupBy("design_id").agg(F.count_if(is_role("required")).alias("n_required"), F.count_if(is_role("alternative")).alias("n_alternative"))
    on = ["query_field", "canonical_value"]
    opens = is_role("required") | (is_role("alternative") & (F.col("n_required") == 0))
    told = own.join(needs, "design_id").groupBy("design_id", *on, "n_required", "n_alternative").agg(F.count_if(opens).alias("opens"), F.bool_or(is_role("alternative")).alias("alternative"), F.bool_or(is_role("exclusion")).alias("excluded"))
    told = stash(told, "rule-clauses")
    others = F.col("alternative") | F.col("excluded")
    terms = told.groupBy(*on).agg(F.max(F.col("opens") > 0).alias("opens"), F.max(others).alias("others")).where("opens or others")
    terms = stash(terms.select(*on, F.monotonically_increasing_id().alias("term"), (F.col("opens").cast("int") + F.col("others").cast("int") * 2).alias("kinds")), "rule-terms").where("term is not null")
    asked = stash(told.join(terms.drop("kinds"), on), "rule-asks")
    dealt = observations.join(terms, on).where(F.col(entity).isNotNull()).select(entity, "term", "kinds").repartition(entity)
    # the kind of a term as an aggregate: both uses then read one exchange
    seen = dealt.groupBy(entity, "term").agg(F.max("kinds").alias("kinds"))
    first = seen.where("kinds in (1, 3)").join(asked.where("opens > 0").select("design_id", "term", "n_required", "n_alternative", "opens"), "term")
    first = first.groupBy("design_id", entity).agg(F.sum("opens").alias("n"), F.max("n_required").alias("n_required"), F.max("n_alternative").alias("n_alternative"))
    begun = first.where("n_required = 0 or n = n_required").select("design_id", entity, "n_alternative")
    rest = asked.where(others).select("design_id", "term", "alternative", "excluded")
    found = begun.join(seen.where("kinds in (2, 3)").select(entity, "term"), entity, "left").join(rest, ["design_id", "term"], "left")
    got = found.groupBy("design_id", entity).agg(F.max("n_alternative").alias("n"), F.bool_or("alternative").alias("alternative"), F.bool_or("excluded").alias("excluded"))
    return got.where(((F.col("n") == 0) | F.coalesce("alternative", F.lit(False))) & ~F.coalesce("excluded", F.lit(False))).select("design_id", entity)


def budgeted(rows: DataFrame, run: str, order: list[str], most: int) -> DataFrame:
    """The first `most` rows of each run in the frozen order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(run).orderBy(*order))).where(F.col("_n") <= most).drop("_n")


def design_checks(designs: DataFrame, clauses: DataFrame, queries: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Reasons against registering designs: text and hash, clause ids, assertion and feature provenance
    as the query has them, background snapshots of used features included, source time the latest.

    clauses: design_id, clause_id, source_assertion_id, source_feature_id, available_at. queries:
    query_id, query_text, query_hash, source_assertion_ids, source_feature_ids, source_available_at.
    snapshots: stat_snapshot_id, feature_id."""
    ids = lambda c: F.array_sort(F.collect_set(c))
    each = clauses.groupBy("design_id").agg(ids("clause_id").alias("_clauses"), ids("source_assertion_id").alias("_assertions"), ids("source_feature_id").alias("_features"), F.max("available_at").alias("_latest"))
    need = clauses.join(snapshots.withColumnRenamed("feature_id", "source_feature_id"), "source_feature_id").groupBy("design_id").agg(ids("stat_snapshot_id").alias("_snapshots"))
    told = designs.join(each, "design_id", "left").join(need, "design_id", "left").join(queries.select("query_id", "query_text", F.col("query_hash").alias("_hash"), "source_assertion_ids", "source_feature_ids", "source_available_at"), "query_id", "left")
    c, empty = F.col, F.array().cast("array<string>")
    reason = (
        F.when(c("_hash").isNull(), "query_unknown").when((c("rendered_query") != c("query_text")) | (c("query_hash") != c("_hash")) | (sha256_text(c("query_text")) != c("_hash")), "query_text_mismatch")
        .when(~F.array_sort("clause_ids").eqNullSafe(c("_clauses")), "clause_ids_mismatch").when(~F.array_sort(F.coalesce("source_assertion_ids", empty)).eqNullSafe(F.coalesce("_assertions", empty)), "assertion_provenance_mismatch")
        .when(~F.array_sort(F.coalesce("source_feature_ids", empty)).eqNullSafe(F.coalesce("_features", empty)), "feature_provenance_mismatch").when(F.size(F.array_except(F.coalesce("_snapshots", empty), F.coalesce("background_snapshot_ids", empty))) > 0, "background_snapshot_omitted")
        .when(~c("source_available_at").eqNullSafe(c("_latest")), "source_time_mismatch").when(c("_latest") > c("cutoff_at"), "feature_leakage")
    )
    return told.withColumn("reason", reason).select(*designs.columns, "reason")


def design_precheck_gate(prechecks: DataFrame, reviews: DataFrame, page_budget: int = 2) -> DataFrame:
    """design prechecks with reason: not complete, over budget, no hit, no accepted review, or null."""
    told = prechecks.join(reviews.select("design_id", "decision", "reviewed_at"), "design_id", "left")
    reason = (
        F.when(F.col("status") != "complete", F.concat(F.lit("precheck_"), F.col("status"))).when(F.col("page_count") > page_budget, "page_budget_exceeded").when(F.col("hit_count") == 0, "zero_hits")
        .when(F.col("decision").isNull(), "human_review_required").when(F.col("decision") != "accepted", "human_review_rejected").when(F.col("reviewed_at") < F.col("recorded_at"), "review_predates_precheck")
    )
    return told.withColumn("reason", reason)


def budget_schedules(designs: DataFrame) -> DataFrame:
    """designs (design_id, interval_hours, starts_at, max_alerts_per_run, max_credits_per_run,
    max_pages_per_run, tie_break_rule) with schedule_id, the same for the same budget, and reason:
    interval_not_positive, budget_negative or null."""
    c = F.col
    ident = json_id(
        "query-schedule", design_id=c("design_id"), interval_hours=c("interval_hours"), starts_at=iso_text(c("starts_at")), max_alerts_per_run=c("max_alerts_per_run"),
        max_credits_per_run=c("max_credits_per_run").cast("string"), max_pages_per_run=c("max_pages_per_run"), tie_break_rule=c("tie_break_rule"),
    )
    reason = F.when(c("interval_hours") <= 0, "interval_not_positive").when(F.least("max_alerts_per_run", "max_credits_per_run", "max_pages_per_run") < 0, "budget_negative")
    return designs.withColumn("schedule_id", ident).withColumn("reason", reason)


def freeze_manifests(designs: DataFrame, schedules: DataFrame, prechecks: DataFrame, reviews: DataFrame, frozen_at: Column, valid_from: Column) -> DataFrame:
    """A manifest for each design with a lineage hash over what it rests on, or the reason why not."""
    told = (
        designs.join(schedules.select("design_id", "schedule_id", "starts_at", F.col("registered_at").alias("_scheduled")), "design_id", "left")
        .join(prechecks.select("design_id", F.col("result_id").alias("precheck_result_id"), "status", F.col("recorded_at").alias("_recorded")), "design_id", "left")
        .join(reviews.select("design_id", "review_id", "decision", "reviewed_at"), "design_id", "left").withColumn("frozen_at", frozen_at).withColumn("valid_for_test_from", valid_from)
    )
    c = F.col
    reason = (
        F.when(c("schedule_id").isNull(), "schedule_missing").when(c("precheck_result_id").isNull() | (c("status") != "complete"), "precheck_not_complete").when(c("review_id").isNull() | (c("decision") != "accepted"), "review_not_accepted")
        .when(F.greatest("registered_at", "_scheduled", "_recorded", "reviewed_at") > c("frozen_at"), "artifact_after_freeze").when(c("valid_for_test_from") < c("frozen_at"), "valid_before_freeze").when(c("starts_at") < c("valid_for_test_from"), "schedule_starts_early")
    )
    lineage = {k: c(k) for k in ("design_id", "query_hash", "schedule_id", "precheck_result_id", "review_id")} | {"clause_ids": F.array_join(F.array_sort("clause_ids"), ","), "background_snapshot_ids": F.array_join(F.array_sort("background_snapshot_ids"), ","), "valid_for_test_from": iso_text(c("valid_for_test_from"))}
    told = told.withColumn("reason", reason).withColumn("lineage_hash", F.when(reason.isNull(), F.substring(json_id("x", n=64, **lineage), 3, 64)))
    ident = joined_id("query-freeze", c("lineage_hash"), iso_text(c("frozen_at")))
    return told.withColumn("freeze_id", F.when(c("lineage_hash").isNotNull(), ident)).select("freeze_id", "design_id", "query_id", "query_hash", "schedule_id", "frozen_at", "valid_for_test_from", "lineage_hash", "reason")
