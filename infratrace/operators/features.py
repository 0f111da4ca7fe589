"""Observations to features, with where and when each was seen."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ids import joined_id, sha256_text
from ..functions.text import canonical

CANONICALIZER = "v1"
SHARED_PRODUCTS = ("apache", "httpd", "nginx", "openssh", "iis")
#: Source column, family, type, query field below host., stability.
HOST_SPEC = (
    ("asn", "network", "asn", "autonomous_system.asn", "stable"),
    ("prefix", "network", "prefix", "autonomous_system.bgp_prefix", "stable"),
)
SERVICE_SPEC = (
    ("cert_sha256", "identity", "cert_sha256", "services.tls.certificates.leaf_data.fingerprint", "stable"),
    ("spki_sha256", "identity", "spki_sha256", "services.tls.certificates.leaf_data.spki_subject_fingerprint", "stable"),
    ("ssh_key_hash", "identity", "ssh_key", "services.ssh.server_host_key.fingerprint_sha256", "stable"),
    ("jarm", "tls", "jarm", "services.jarm.fingerprint", "stable"),
    ("ja4", "tls", "ja4", "services.tls.ja4", "stable"),
    ("banner_hash", "http", "banner_hash", None, "unavailable"),
    ("http_title_hash", "http", "title_hash", None, "unavailable"),
    ("port", "service", "port", "services.port", "stable"),
    ("protocol", "service", "protocol", "services.service_name", "stable"),
    ("software_vendor", "device", "software_vendor", "services.software.vendor", "stable"),
    ("software_product", "device", "software_product", "services.software.product", "stable"),
    ("software_version", "device", "software_version", "services.software.version", "unstable"),
)


def _unpivot(rows: DataFrame, spec: tuple, keep: list[str]) -> DataFrame:
    """A row for each value of the spec's columns. Values are put into canonical form after they are rows, so
    that each is read once."""
    each = []
    for column, family, kind, field, stability in spec:
        if column in rows.columns:
            each.append(F.struct(F.lit(family).alias("feature_family"), F.lit(kind).alias("feature_type"), F.col(column).cast("string").alias("_raw"), F.lit(f"host.{field}" if field else None).cast("string").alias("query_field"), F.lit(stability).alias("stability")))
    told = rows.select(*keep, F.inline(F.array(*each))).where("_raw is not null")
    told = told.withColumn("canonical_value", canonical(F.col("_raw"))).where("canonical_value is not null")
    shared = F.when(F.col("feature_type") == "jarm", F.col("_raw").rlike("^0+$")).when(F.col("feature_type") == "software_product", F.col("canonical_value").isin(*SHARED_PRODUCTS)).otherwise(False)
    return told.select(*keep, "feature_family", "feature_type", "canonical_value", "query_field", "stability", shared.alias("shared_or_default"))


def observed_features(hosts: DataFrame, services: DataFrame, extractor_version: str = "v1") -> DataFrame:
    """A row for each feature of each observed host or service. Services without a host are left out;
    `timeline`'s and `audit`'s orphan checks report them."""
    times = ["observation_id", "query_run_id", "observed_at", "available_at"]
    seen = hosts.where("host_observed").withColumn("available_at", F.col("collected_at"))
    own = _unpivot(seen.withColumn("service_observation_id", F.lit(None).cast("string")), HOST_SPEC, [*times, "service_observation_id"])
    joined = services.withColumnRenamed("observed_at", "_service_time").join(seen.select(*times), "observation_id").withColumn("observed_at", F.coalesce("_service_time", "observed_at"))
    rows = own.unionByName(_unpivot(joined, SERVICE_SPEC, [*times, "service_observation_id"]))
    rows = rows.withColumn("feature_id", joined_id("feature", F.col("feature_family"), F.col("feature_type"), F.col("canonical_value"), F.lit(CANONICALIZER), F.lit(extractor_version)))
    seen_id = joined_id("feature-observation", F.col("feature_id"), F.col("observation_id"), F.coalesce("service_observation_id", F.lit("host")))
    return rows.withColumn("feature_observation_id", seen_id).withColumn("extractor_version", F.lit(extractor_version))


def feature_catalog(rows: DataFrame) -> DataFrame:
    """One row for each feature with its earliest availability."""
    kind = F.replace(F.replace("feature_type", F.lit("_sha256"), F.lit("")), F.lit("ssh_key"), F.lit("ssh"))
    keys = ["feature_id", "feature_family", "feature_type", "canonical_value", "query_field", "stability", "shared_or_default", "extractor_version"]
    out = rows.groupBy(*keys).agg(F.min("available_at").alias("first_available_at"))
    source = F.when(F.col("feature_type").isin("cert_sha256", "spki_sha256", "ssh_key", "jarm", "ja4"), joined_id("fp", kind, F.col("canonical_value")))
    return out.withColumn("canonical_value_hash", sha256_text(F.col("canonical_value"))).withColumn("canonicalizer_version", F.lit(CANONICALIZER)).withColumn("source_fingerprint_id", source)


def feature_observations(rows: DataFrame) -> DataFrame:
    keep = ["feature_observation_id", "feature_id", "observation_id", "service_observation_id", "query_run_id", "observed_at", "available_at"]
    return rows.select(*keep).dropDuplicates(["feature_observation_id"])


def identities(rows: DataFrame) -> DataFrame:
    """observation_id, identity: stable identity features, as epochs need them."""
    return rows.where("feature_family = 'identity' and stability = 'stable'").select("observation_id", F.col("feature_id").alias("identity"))
