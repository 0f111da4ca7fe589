"""Fingerprints of hosts and services, who was seen with them, and who shares them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import joined_id, sha256_text
from ..functions.text import canonical

#: Service columns that are fingerprints, by type.
SERVICE_TYPES = {"cert": "cert_sha256", "spki": "spki_sha256", "jarm": "jarm", "ja4": "ja4", "ssh": "ssh_key_hash", "banner": "banner_hash", "http": "http_title_hash"}
SHARED_TYPES = ("cert", "spki", "jarm", "banner")


def service_fingerprints(services: DataFrame) -> DataFrame:
    """service rows unpivoted: observation_id, service_observation_id, fingerprint_type, fingerprint_value."""
    each = [F.struct(F.lit(t).alias("fingerprint_type"), F.col(c).alias("fingerprint_value")) for t, c in SERVICE_TYPES.items() if c in services.columns]
    return services.select("observation_id", "service_observation_id", F.inline(F.array(*each))).where("fingerprint_value is not null and fingerprint_value <> ''")


def portsets(services: DataFrame) -> DataFrame:
    """observation_id, ports and the hash of the sorted different transport/port of a host."""
    ports = F.array_join(F.sort_array(F.collect_set(F.concat_ws("/", "transport", F.col("port").cast("string")))), ",")
    return services.where("port is not null").groupBy("observation_id").agg(ports.alias("ports")).withColumn("portset_hash", sha256_text(F.col("ports")))


def fingerprint_graph(hosts: DataFrame, services: DataFrame, extractor_version: str = "v1") -> tuple[DataFrame, DataFrame]:
    """(fingerprints, relations). A fingerprint is first available when first collected; each is
    observed_with its service (or host, for port sets) and with the indicator."""
    seen = service_fingerprints(services).join(hosts.select("observation_id", "indicator_id", "collected_at", "observed_at", "query_run_id"), "observation_id")
    sets = portsets(services).select("observation_id", F.col("observation_id").alias("service_observation_id"), F.lit("portset").alias("fingerprint_type"), F.col("portset_hash").alias("fingerprint_value"))
    seen = seen.unionByName(sets.join(hosts.select("observation_id", "indicator_id", "collected_at", "observed_at", "query_run_id"), "observation_id"))
    seen = seen.withColumn("fingerprint_id", joined_id("fp", F.col("fingerprint_type"), F.col("fingerprint_value")))
    fingerprints = seen.groupBy("fingerprint_id", "fingerprint_type", "fingerprint_value").agg(F.min("collected_at").alias("first_available_at")).withColumn("extractor_version", F.lit(extractor_version))
    ends = F.array(F.struct(F.col("service_observation_id").alias("src_id"), F.lit(False).alias("of_indicator")), F.struct(F.col("indicator_id").alias("src_id"), F.lit(True).alias("of_indicator")))
    edges = seen.select("fingerprint_id", "fingerprint_type", "collected_at", "observed_at", "query_run_id", F.inline(ends))
    relation = joined_id("rel", F.col("src_id"), F.col("fingerprint_id"), F.lit("observed_with"), F.col("query_run_id"))
    relations = edges.select(relation.alias("relation_id"), "src_id", F.col("fingerprint_id").alias("dst_id"), F.lit("observed_with").alias("relation_type"), "fingerprint_type", "of_indicator", F.coalesce("observed_at", "collected_at").alias("valid_from"), F.col("collected_at").alias("available_at"))
    order = F.struct("available_at", "valid_from")
    return fingerprints, relations.groupBy("relation_id", "src_id", "dst_id", "relation_type", "fingerprint_type", "of_indicator").agg(F.min(order).alias("o")).select("relation_id", "src_id", "dst_id", "relation_type", "fingerprint_type", "of_indicator", "o.valid_from", "o.available_at")


def earliest_members(relations: DataFrame) -> DataFrame:
    """One row for each (fingerprint, indicator): its first membership."""
    order = F.struct("available_at", "valid_from", "relation_id")
    own = relations.where(F.col("of_indicator") & F.col("fingerprint_type").isin(*SHARED_TYPES))
    return own.groupBy(F.col("dst_id").alias("fingerprint_id"), "fingerprint_type", F.col("src_id").alias("indicator_id")).agg(F.min(order).alias("o")).select("fingerprint_id", "fingerprint_type", "indicator_id", "o.available_at", "o.valid_from")


def shared_infrastructure(members: DataFrame, max_members: int | None = None, salt_members: int = 2000) -> tuple[DataFrame, DataFrame]:
    """(pairs, hot): unordered pairs of indicators with a fingerprint in common, available when both are.

    The join is on the fingerprint. One of more than `salt_members` members is shared out: its left
    rows are dealt to salts and its right rows go to all of them; others have a single salt. With
    `max_members`, fingerprints above it yield no pairs but are returned in `hot` with their members'
    count: a shared default says nothing about a pair, and membership holds all there is to know.
    """
    counts = members.groupBy("fingerprint_id").agg(F.count("*").alias("members"))
    hot = counts.where(F.col("members") > max_members) if max_members else counts.where(F.lit(False))
    rows = members.join(hot, "fingerprint_id", "left_anti") if max_members else members
    large = counts.where(F.col("members") > salt_members).select("fingerprint_id", F.ceil(F.col("members") / salt_members).cast("int").alias("salts"))
    rows = rows.join(large, "fingerprint_id", "left").withColumn("salts", F.coalesce("salts", F.lit(1)))
    left = rows.select("fingerprint_id", "fingerprint_type", F.col("indicator_id").alias("left_id"), F.col("available_at").alias("la"), F.col("valid_from").alias("lv"), F.pmod(F.xxhash64("indicator_id"), F.col("salts")).cast("int").alias("salt"))
    right = rows.select("fingerprint_id", F.col("indicator_id").alias("right_id"), F.col("available_at").alias("ra"), F.col("valid_from").alias("rv"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    pairs = left.join(right, ["fingerprint_id", "salt"]).where("left_id < right_id")
    kind = F.concat(F.lit("shares_"), F.col("fingerprint_type"))
    return pairs.select(joined_id("rel", F.col("left_id"), F.col("right_id"), kind, F.col("fingerprint_id")).alias("relation_id"), "left_id", "right_id", kind.alias("relation_type"), "fingerprint_id", F.greatest("la", "ra").alias("available_at"), F.greatest("lv", "rv").alias("valid_from")), hot


def shared_with_first(members: DataFrame, hot: DataFrame) -> DataFrame:
    """The members of hot fingerprints, each with the first of them by id: a row a member in place of
    all pairs, from which every pair follows. Columns as of shared_infrastructure's pairs."""
    rows = members.join(hot.select("fingerprint_id"), "fingerprint_id", "left_semi")
    first = rows.groupBy("fingerprint_id").agg(F.min_by(F.struct("indicator_id", "available_at", "valid_from"), "indicator_id").alias("f"))
    told = rows.join(first, "fingerprint_id").where(F.col("indicator_id") != F.col("f.indicator_id"))
    kind = F.concat(F.lit("shares_"), F.col("fingerprint_type"))
    left = F.col("f.indicator_id")
    return told.select(joined_id("rel", left, F.col("indicator_id"), kind, F.col("fingerprint_id")).alias("relation_id"), left.alias("left_id"), F.col("indicator_id").alias("right_id"), kind.alias("relation_type"), "fingerprint_id", F.greatest("available_at", "f.available_at").alias("available_at"), F.greatest("valid_from", "f.valid_from").alias("valid_from"))


def normalized_hash(value: Column) -> Column:
    text = canonical(value)
    return F.when(text.isNotNull(), sha256_text(text))
