"""Accepted assertions to pivots, and bounded prechecks to eligible sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.ids import joined_id, iso_text

#: Scopes with a direct pivot, groups of roles that go together, flags that block.
PIVOT_TYPE = {"cert": "cert_sha256", "spki": "spki", "ssh_key": "ssh_key", "jarm": "jarm", "ja4": "ja4", "domain": "domain"}
TEMPLATES = {"cert_sha256", "jarm", "domain", "banner_token", "product", "port"}
ROLE_GROUPS = (("relay_orb", "staging"), ("controller", "c2"), ("scanner",))
BLOCKING_FLAGS = ("broad_shared", "restricted", "role_conflict", "unsupported")
MAX_RENDERED = 2000


def accepted_sources(assertions: DataFrame, reviews: DataFrame, mentions: DataFrame, indicators: DataFrame, families: DataFrame, cutoff_at: Column) -> DataFrame:
    """Each assertion with its review, mention and indicator; reason is null where it may be used.

    families: document_id, source_family_id."""
    r = reviews.select("assertion_id", "review_id", "decision", "reviewed_role", *[F.col(c).alias(f"_{c}") for c in ("source_confidence", "extraction_confidence", "role_confidence")])
    m = mentions.select(F.col("mention_id").alias("source_mention_id"), "scope", "source_family_id", F.col("document_id").alias("_mention_document"))
    f = families.select("document_id", F.col("source_family_id").alias("_family"))
    told = assertions.select("assertion_id", "indicator_id", "document_id", "source_mention_id", "role", "available_at").join(r, "assertion_id", "left").join(m, "source_mention_id", "left").join(indicators.select("indicator_id", F.col("normalized_value").alias("value")), "indicator_id", "left").join(f, "document_id", "left")
    reason = (
        F.when(F.col("decision").isNull(), "review_missing").when(F.col("decision") != "accepted", "review_not_accepted").when(F.col("scope").isNull(), "mention_missing").when(F.col("value").isNull(), "indicator_missing")
        .when(~F.col("_family").eqNullSafe(F.col("source_family_id")) | ~F.col("_mention_document").eqNullSafe(F.col("document_id")), "family_mismatch").when(F.col("available_at") > cutoff_at, "available_after_cutoff")
    )
    return told.select("indicator_id", "assertion_id", "review_id", "scope", "value", F.coalesce("reviewed_role", "role").alias("role"), "available_at", "source_family_id", *[F.col(f"_{c}").alias(c) for c in ("source_confidence", "extraction_confidence", "role_confidence")], reason.alias("reason"))


def plan_pivots(accepted: DataFrame, cutoff_at: Column, templates: dict[str, str] | None = None, ipv6: bool = True) -> DataFrame:
    """accepted (indicator_id, scope, value, role, available_at) with query_class, pivot_type, status
    (registered_not_executed, blocked, unsupported), reason and query_text."""
    templates = templates if templates is not None else {t: f"{t}: {{pivot_value}}" for t in TEMPLATES}
    scope, value, role = F.col("scope"), F.col("value"), F.col("role")
    pivot = F.when(scope == "ip", "ip").otherwise(F.create_map(*[F.lit(x) for kv in PIVOT_TYPE.items() for x in kv])[scope])
    template = F.create_map(*[F.lit(x) for kv in (templates or {"": ""}).items() for x in kv])[pivot]
    is_global = T.ip_is_global(value, ipv6)
    bare = F.when((pivot == "domain") & value.startswith("*."), F.substring(value, F.lit(3), F.length(value))).otherwise(T.strip(value))
    unsafe = T.domain_block_reason(bare)
    rendered = F.when(scope == "ip", F.concat(F.lit("host.ip = "), T.strip(value))).otherwise(F.replace(template, F.lit("{pivot_value}"), bare))
    looks_ip = T.is_ip(value) if ipv6 else value.rlike(T.IPV4)
    early = (F.col("available_at") > cutoff_at) | ~F.coalesce(role.isin(*T.PIVOTABLE_ROLES), F.lit(False))
    reason = (
        F.when(F.col("available_at") > cutoff_at, "accepted assertion is available after cutoff")
        .when(~F.coalesce(role.isin(*T.PIVOTABLE_ROLES), F.lit(False)), F.concat(F.lit("accepted assertion role is not pivotable: "), F.coalesce(role, F.lit("unknown"))))
        .when((scope == "ip") & is_global.isNull(), "IP value is invalid").when((scope == "ip") & ~is_global, "IP is not globally routable")
        .when(pivot.isNull(), "scope has no direct template").when((scope != "ip") & looks_ip, "raw address is not allowed in a template")
        .when((scope != "ip") & template.isNull(), F.concat(F.lit("no template for pivot type: "), pivot)).when((pivot == "domain") & (unsafe != ""), F.concat(F.lit("domain blocked: "), unsafe))
        .when(F.length(rendered) > MAX_RENDERED, "rendered query is too long")
    )
    status = F.when(reason.isNull(), "registered_not_executed").when((reason == "scope has no direct template"), "unsupported").otherwise("blocked")
    query_class = F.when(~early & pivot.isNotNull(), F.when(scope == "ip", "q0_seed").otherwise("q1_direct_pivot"))
    out = accepted.withColumn("query_class", query_class).withColumn("pivot_type", F.when(query_class.isNotNull(), pivot)).withColumn("status", status).withColumn("reason", reason)
    return out.withColumn("query_text", F.when(reason.isNull(), rendered))


def roles_compatible(roles: Column) -> Column:
    fits = [F.size(F.array_except(roles, F.array(*map(F.lit, g)))) == 0 for g in ROLE_GROUPS]
    out = F.lit(False)
    for f in fits:
        out = out | f
    return (F.size(roles) > 0) & out


def composites(sources: DataFrame, windows: DataFrame) -> DataFrame:
    """node_id's composite of accepted assertions; windows: node_id, window_start, window_end.
    sources: node_id, assertion_id, role, available_at. reason tells why there is none."""
    told = sources.join(windows, "node_id")
    each = told.groupBy("node_id", "window_start", "window_end").agg(
        F.sort_array(F.collect_set("assertion_id")).alias("assertion_ids"), F.count("*").alias("n"), F.sort_array(F.collect_set("role")).alias("roles"), F.max("available_at").alias("available_at"),
        F.bool_and(F.col("available_at").between(F.col("window_start"), F.col("window_end"))).alias("inside"),
    )
    reason = F.when(F.col("n") < 2, "too_few_assertions").when(F.trim("node_id") == "", "node_missing").when(F.col("window_end") < F.col("window_start"), "window_reversed").when(~F.col("inside"), "outside_window").when(~roles_compatible(F.col("roles")), "incompatible_roles").when(F.size("assertion_ids") != F.col("n"), "duplicate_assertions")
    ident = joined_id("cti-composite", F.col("node_id"), iso_text(F.col("window_start")), iso_text(F.col("window_end")), F.array_join("assertion_ids", "|"))
    return each.withColumn("reason", reason).withColumn("composite_id", F.when(reason.isNull(), ident)).drop("n", "inside")


def precheck_definitions(sources: DataFrame) -> DataFrame:
    """sources (query_id, query_hash, node_id, cutoff_at, page_budget, assertion_id, role, scope,
    available_at, risk_flags) rolled up to one definition a query and node."""
    keys = ["query_id", "query_hash", "node_id", "cutoff_at", "page_budget"]
    each = sources.groupBy(*keys).agg(F.sort_array(F.collect_list("assertion_id")).alias("assertion_ids"), F.sort_array(F.collect_set("role")).alias("roles"), F.collect_set("scope").alias("scopes"), F.flatten(F.collect_list(F.coalesce("risk_flags", F.array().cast("array<string>")))).alias("flags"), F.max("available_at").alias("source_available_at"))
    flags = F.array_sort(F.array_distinct(F.when(roles_compatible(F.col("roles")), F.col("flags")).otherwise(F.array_append("flags", F.lit("role_conflict")))))
    ident = joined_id("precheck", F.col("query_id"), F.col("query_hash"), F.col("node_id"), iso_text(F.col("cutoff_at")), F.col("page_budget"), F.array_join("assertion_ids", "|"))
    out = each.withColumn("risk_flags", flags).withColumn("scope", F.when(F.size("scopes") == 1, F.col("scopes")[0]).otherwise("composite")).withColumn("precheck_id", ident)
    return out.withColumn("reason", F.when(F.col("source_available_at") > F.col("cutoff_at"), "source_after_cutoff")).drop("scopes", "flags")


def hit_distribution(hits: DataFrame, key: str, value: str) -> DataFrame:
    """key and a map of value to its number of hits, sorted by value."""
    n = hits.groupBy(key, value).agg(F.count("*").alias("n"))
    return n.groupBy(key).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col(value).cast("string"), F.col("n").cast("int"))))).alias("hit_distribution"))


def latest_results(results: DataFrame, key: str = "precheck_id", time: str = "recorded_at", tie: str = "result_id") -> DataFrame:
    nth = F.row_number().over(Window.partitionBy(key).orderBy(F.col(time).desc(), F.col(tie).desc()))
    return results.withColumn("_n", nth).where("_n = 1").drop("_n")


def precheck_eligibility(prechecks: DataFrame, results: DataFrame, reviews: DataFrame) -> DataFrame:
    """prechecks with eligible and reason from the latest result and its review, first reason first."""
    r = latest_results(results).select("precheck_id", F.col("status").alias("_status"), F.col("hit_count").alias("_hits"))
    told = prechecks.join(r, "precheck_id", "left").join(reviews.select("precheck_id", F.col("decision").alias("_decision")), "precheck_id", "left")
    flag = F.array_min(F.array_intersect(F.coalesce("risk_flags", F.array().cast("array<string>")), F.array(*map(F.lit, BLOCKING_FLAGS))))
    reason = (
        F.when(flag.isNotNull(), flag).when(F.col("_status").isNull(), "precheck_missing").when(F.col("_status") != "complete", F.concat(F.lit("precheck_"), F.col("_status"))).when(F.col("_hits") == 0, "zero_hit_not_death_evidence")
        .when(F.col("_decision").isNull(), "human_review_required").when(F.col("_decision") != "accepted", "human_review_rejected").otherwise("eligible_q2_source")
    )
    return told.withColumn("reason", reason).withColumn("eligible", F.col("reason") == "eligible_q2_source").drop("_status", "_hits", "_decision")


def q2_admission(queries: DataFrame, eligible: DataFrame) -> DataFrame:
    """queries (query_id, precheck_ids) with admitted and the latest source time; eligible: precheck_id,
    eligible, source_available_at."""
    each = queries.select("query_id", F.explode_outer("precheck_ids").alias("precheck_id")).join(eligible, "precheck_id", "left")
    got = each.groupBy("query_id").agg(F.bool_and(F.coalesce("eligible", F.lit(False))).alias("admitted"), F.max("source_available_at").alias("source_available_at"))
    return queries.join(got, "query_id")


def precheck_result_checks(results: DataFrame, prechecks: DataFrame, executions: DataFrame) -> DataFrame:
    """reason against each result: unknown precheck or execution, or a field that differs from the run's."""
    e = executions.select(F.col("query_run_id").alias("collection_run_id"), *[F.col(c).alias(f"_{c}") for c in ("query_id", "cutoff_at", "status", "hit_count", "raw_manifest_hash")])
    p = prechecks.select("precheck_id", F.col("query_id").alias("_own"), F.col("cutoff_at").alias("_cutoff"))
    told = results.join(p, "precheck_id", "left").join(e, "collection_run_id", "left")
    reason = (
        F.when(F.col("_own").isNull(), "unknown_precheck").when(F.col("_query_id").isNull(), "unknown_execution").when(F.col("_own") != F.col("_query_id"), "query_mismatch").when(F.col("_cutoff") != F.col("_cutoff_at"), "cutoff_mismatch")
        .when(F.col("status") != F.col("_status"), "status_mismatch").when(F.col("hit_count") != F.col("_hit_count"), "hit_count_mismatch").when(~F.col("raw_manifest_hash").eqNullSafe(F.col("_raw_manifest_hash")), "manifest_mismatch")
    )
    return told.withColumn("reason", reason).drop("_own", "_cutoff", "_query_id", "_cutoff_at", "_status", "_hit_count", "_raw_manifest_hash")


def lookup(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small fixed table as DataFrame."""
    return spark.createDataFrame(rows, schema)
