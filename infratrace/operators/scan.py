"""Scan runs: page logs, run accounting, and pages normalised to hosts and services."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import joined_id, sha256_text
from ..functions.text import is_ip
from .graph import normalized_hash


def _get(page: Column, paths: tuple[str, ...], kind: str) -> Column:
    return F.coalesce(*[F.try_variant_get(page, p, kind) for p in paths])


def page_hits(pages: DataFrame, page: str = "page") -> DataFrame:
    """pages with hits (array of variant, under up to three nested `result`s) and next_token."""
    v = F.col(page)
    nests = ("$", "$.result", "$.result.result", "$.result.result.result")
    hits = _get(v, tuple(f"{n}.hits" for n in nests), "array<variant>")
    token = _get(v, tuple(f"{n}.{t}" for n in nests for t in ("next_page_token", "links.next", "cursor")), "string")
    return pages.withColumn("hits", F.coalesce(hits, F.array().cast("array<variant>"))).withColumn("next_token", F.nullif(token, F.lit("")))


def page_log_audit(log: DataFrame) -> DataFrame:
    """The first violation of each page log row, null if none, in the order of the codes below.

    log: run_id, page_number, page_hash, stored_hash (of the stored page), query_hash, run_query_hash,
    cumulative_hits, next_page_token, run_status.
    """
    by_run = Window.partitionBy("run_id").orderBy("page_number")
    last = F.col("page_number") == F.max("page_number").over(Window.partitionBy("run_id"))
    told = log.withColumn("_nth", F.row_number().over(by_run)).withColumn("_before", F.lag("cumulative_hits").over(by_run)).withColumn("_last", last)
    c = F.col
    code = (
        F.when(c("page_number") != c("_nth"), "page_gap").when(~c("page_hash").eqNullSafe(c("stored_hash")), "page_hash_mismatch").when(~c("query_hash").eqNullSafe(c("run_query_hash")), "query_hash_mismatch")
        .when(c("cumulative_hits") < c("_before"), "hits_decrease").when(~c("_last") & c("next_page_token").isNull(), "token_missing")
        .when(c("_last") & (c("run_status") == "complete") & c("next_page_token").isNotNull(), "complete_with_token")
        .when(c("_last") & (c("run_status") != "complete") & c("next_page_token").isNull(), "incomplete_without_token")
    )
    return told.withColumn("violation", code).drop("_nth", "_before", "_last")


def run_accounting(log: DataFrame, max_pages: int | None = None) -> DataFrame:
    """Of each run: pages, hits, resume token and status complete, partial_max_pages, resumable or
    token_loop (a token came twice)."""
    got = log.groupBy("run_id").agg(F.count("*").alias("pages"), F.max_by("cumulative_hits", "page_number").alias("hits"), F.max_by(F.struct("next_page_token"), "page_number").alias("t"), (F.count("next_page_token") > F.count_distinct("next_page_token")).alias("loop"))
    token = F.col("t.next_page_token")
    status = F.when(F.col("loop"), "token_loop").when(token.isNull(), "complete").when(F.lit(max_pages).isNotNull() & (F.col("pages") >= F.lit(max_pages)), "partial_max_pages").otherwise("resumable")
    return got.select("run_id", "pages", "hits", token.alias("resume_token"), status.alias("status"))


class Normalized(NamedTuple):
    hosts: DataFrame
    services: DataFrame
    discovered: DataFrame
    violations: DataFrame


HOST = ("$.host_v1.resource", "$.host", "$")


def host_rows(pages: DataFrame) -> DataFrame:
    """A row for each hit with an address, whatever nests it. Stateless."""
    hits = page_hits(pages).select("run_id", "page_number", sha256_text(F.to_json("page")).alias("page_hash"), F.posexplode("hits").alias("hit_pos", "hit"))
    pick = lambda path, kind: _get(F.col("hit"), tuple(f"{h}.{path}" for h in HOST), kind)
    return hits.select(
        "run_id", "page_number", "page_hash", "hit_pos", pick("ip", "string").alias("ip"), pick("last_updated_at", "string").try_cast("timestamp").alias("observed_at"),
        pick("autonomous_system.asn", "bigint").alias("asn"), pick("autonomous_system.bgp_prefix", "string").alias("prefix"),
        F.coalesce(pick("location.country_code", "string"), pick("location.country", "string")).alias("country"), F.coalesce(pick("autonomous_system.name", "string"), pick("autonomous_system.organization", "string")).alias("organization"),
        F.coalesce(pick("dns.names", "array<string>"), pick("dns.reverse_dns.names", "array<string>")).alias("dns_names"), F.coalesce(pick("services", "array<variant>"), F.array().cast("array<variant>")).alias("services"), sha256_text(F.to_json("hit")).alias("raw_record_hash"),
    ).where(F.coalesce(is_ip(F.col("ip")), F.lit(False)))


def placed(host: DataFrame, runs: DataFrame, known_ips: DataFrame) -> DataFrame:
    """host_rows with their run's columns, indicator_id, observation_id and reason, null for a good row.
    Stateless beside the two tables."""
    rows = host.join(runs.select("run_id", "query_class", "exact_ip", "collected_at", F.col("indicator_id").alias("seed_id")), "run_id").join(known_ips.select("ip", F.col("indicator_id").alias("known_id")).dropDuplicates(["ip"]), "ip", "left")
    rows = rows.withColumn("indicator_id", F.coalesce("known_id", joined_id("ioc", F.lit("scan"), F.lit("ip"), F.col("ip")))).withColumn("observation_id", joined_id("obs", F.col("run_id"), F.col("ip")))
    return rows.withColumn("reason", F.when((F.col("query_class") == "q0_seed") & (F.col("ip") != F.col("exact_ip")), "q0_other_ip").when(F.col("observed_at") > F.col("collected_at"), "observed_after_collected"))


HOST_COLUMNS = ["observation_id", "indicator_id", "observed_at", "collected_at", "observation_time_basis", "host_observed", "negative_reason", "asn", "prefix", "country", "organization", "raw_record_hash", "query_run_id"]


def observed_hosts(good: DataFrame) -> DataFrame:
    """Host observations of placed rows without a reason, other columns kept."""
    basis = F.when(F.col("observed_at").isNotNull(), "host").otherwise("collection")
    return good.withColumn("observation_time_basis", basis).withColumn("host_observed", F.lit(True)).withColumn("negative_reason", F.lit(None).cast("string")).withColumn("query_run_id", F.col("run_id"))


def not_found(silent: DataFrame) -> DataFrame:
    """The negative observation of runs on one address without a hit."""
    none = lambda kind, *names: [F.lit(None).cast(kind).alias(c) for c in names]
    return silent.select(
        joined_id("obs", F.col("run_id"), F.lit("not-found")).alias("observation_id"), "indicator_id", *none("timestamp", "observed_at"), "collected_at", F.lit("collection").alias("observation_time_basis"), F.lit(False).alias("host_observed"), F.lit("not_found").alias("negative_reason"),
        *none("bigint", "asn"), *none("string", "prefix", "country", "organization"), sha256_text(F.col("run_id")).alias("raw_record_hash"), F.col("run_id").alias("query_run_id"),
    )


def service_fields(s: Column, observation_id: Column, host_time: Column) -> dict[str, Column]:
    """A service record's columns from its variant."""
    one = lambda *paths: F.nullif(_get(s, tuple(f"$.{p}" for p in paths), "string"), F.lit(""))
    port = F.coalesce(F.try_variant_get(s, "$.port", "int"), F.try_variant_get(s, "$.port", "string").try_cast("int"))
    transport = F.when(F.lower(one("transport_protocol", "transport")) == "udp", "udp").otherwise("tcp")
    seen = one("observed_at", "observation_time").try_cast("timestamp")
    return {
        "port": port, "transport": transport, "protocol": F.lower(F.coalesce(one("service_name", "protocol"), F.lit("unknown"))),
        "observed_at": F.coalesce(seen, host_time), "observation_time_basis": F.when(seen.isNotNull(), "service").otherwise("host"), "extended_service": F.lower(one("extended_service_name")),
        "banner_hash": normalized_hash(one("banner", "service_banner")), "http_title_hash": normalized_hash(one("http.response.html_title", "http.title", "html_title")),
        "cert_sha256": F.lower(one("tls.certificates.leaf_data.fingerprint", "tls.certificates.leaf_fp_sha_256", "tls.certificate.fingerprint_sha256", "tls.fingerprint_sha256", "certificate")),
        "spki_sha256": F.lower(one("tls.certificates.leaf_data.spki_subject_fingerprint", "spki_sha256")), "jarm": F.lower(one("jarm.fingerprint", "jarm")), "ja4": F.lower(one("tls.ja4", "ja4")),
        "ssh_key_hash": one("ssh.server_host_key.fingerprint_sha256", "ssh_key_hash"), "software_vendor": one("software[0].vendor"), "software_product": one("software[0].product"), "software_version": one("software[0].version"),
        "service_observation_id": joined_id("svc", observation_id, port, transport),
    }


def normalize(pages: DataFrame, runs: DataFrame, known_ips: DataFrame, history: DataFrame | None = None, extractor_version: str = "v1") -> Normalized:
    """Pages (run_id, page_number, page) of runs (run_id, query_class, exact_ip, indicator_id,
    collected_at) as host and service observations.

    Hits without an address are skipped. A run on one exact address (class q0_seed) without a hit
    leaves one negative row. An address that a run shows again is one observation, that of its first hit.
    An address that no known_ips (ip, indicator_id) row names is a new
    indicator. history: ip, port, first_seen, last_seen.
    """
    host = host_rows(pages)
    rows = placed(host, runs, known_ips)
    nth = F.row_number().over(Window.partitionBy("run_id", "ip").orderBy("page_number", "hit_pos"))
    rows = rows.withColumn("reason", F.coalesce("reason", F.when(nth > 1, "address_repeated")))
    good = rows.where("reason is null")
    hosts = observed_hosts(good).select(*HOST_COLUMNS)
    nothing = not_found(runs.where("query_class = 'q0_seed'").join(host.select("run_id").distinct(), "run_id", "left_anti"))
    each = good.select("observation_id", "ip", "observed_at", F.explode("services").alias("s"))
    services = each.select("observation_id", "ip", *[c.alias(n) for n, c in service_fields(F.col("s"), F.col("observation_id"), F.col("observed_at")).items()])
    services = services.where("port between 1 and 65535").withColumn("extractor_version", F.lit(extractor_version)).dropDuplicates(["service_observation_id"])
    if history is not None:
        span = history.groupBy("ip", "port").agg(F.min("first_seen").alias("history_from"), F.max("last_seen").alias("history_to"))
        micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
        days = F.floor((micros("history_to") - micros("history_from")) / 86_400_000_000)
        services = services.join(span, ["ip", "port"], "left").withColumn("history_days", days)
    new = good.where("known_id is null").select("indicator_id", F.col("ip").alias("normalized_value"), F.when(F.col("ip").contains(":"), "other").otherwise("ipv4").alias("indicator_type"), F.lit("restricted").alias("sensitivity")).dropDuplicates(["indicator_id"])
    return Normalized(hosts.unionByName(nothing), services.drop("ip"), new, rows.where("reason is not null").select("run_id", "ip", "reason"))
