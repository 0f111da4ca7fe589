"""Readers: driver tables, scan pages, logs, document folders, JSON arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def scan_pages(spark: SparkSession, folder: str, glob: str = "page-*.json", run: str = r"([^/]+)/[^/]+$", number: str = r"page-0*(\d+)\.json$", stream: bool = False, files_per_trigger: int | None = None) -> DataFrame:
    """Raw result pages, one JSON document a file: path, run_id, page_number, page (variant). The run and
    the number are groups of patterns over the path: the folder and the file's name by default. As a stream
    if asked, by so many files at a time."""
    options = {"wholetext": True, "recursiveFileLookup": True, "pathGlobFilter": glob, **({"maxFilesPerTrigger": files_per_trigger} if files_per_trigger else {})}
    raw = (spark.readStream if stream else spark.read).format("text").schema("value string").options(**options).load(folder)
    raw = raw.select(F.input_file_name().alias("path"), F.try_parse_json("value").alias("page"))
    return raw.select("path", F.regexp_extract("path", run, 1).alias("run_id"), F.regexp_extract("path", number, 1).try_cast("int").alias("page_number"), "page")


def page_log(spark: SparkSession, folder: str, stream: bool = False, files_per_trigger: int | None = None) -> DataFrame:
    """Raw result pages, one JSON document {run_id, page_number, page} a line, as `scan_pages` gives them. Runs of few
    hits make many pages: a file each costs far more than what it holds."""
    options = {"recursiveFileLookup": True, **({"maxFilesPerTrigger": files_per_trigger} if files_per_trigger else {})}
    raw = (spark.readStream if stream else spark.read).format("text").schema("value string").options(**options).load(folder)
    raw = raw.where(F.trim("value") != "").select(F.input_file_name().alias("path"), F.try_parse_json("value").alias("v"))
    part = lambda path, kind: F.try_variant_get("v", path, kind)
    return raw.select("path", part("$.run_id", "string").alias("run_id"), part("$.page_number", "int").alias("page_number"), part("$.page", "variant").alias("page"))


def json_lines(spark: SparkSession, path: str, schema: str, strict: bool = False) -> DataFrame:
    """A JSONL log; blank lines are skipped. Broken lines fail if strict, else keep their text in `broken`."""
    if strict:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    return spark.read.schema(f"{schema}, broken string").option("columnNameOfCorruptRecord", "broken").json(path)


def json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A file that holds one JSON array of records (watch lists, clauses, reviews)."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def document_corpus(spark: SparkSession, folder: str, index: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents, rejected): files named by an index (path, publisher, published_at_raw,
    published_time_precision, source_access_class, ...) with the hash of their bytes.

    Rejected rows have a reason: missing_field, missing_file, duplicate_path, duplicate_content or
    precision_mismatch.
    """
    from ..functions.text import publication_precision

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    root = folder.rstrip("/").removeprefix("file://")
    files = files.select(F.regexp_replace("path", f"^[a-z0-9]*:?/*{root.lstrip('/')}/", "").alias("path"), F.sha2("content", 256).alias("content_sha256"), "length")
    told = index.join(files, "path", "left")
    names = told.groupBy("path").agg(F.count("*").alias("n_path"))
    same = told.where("content_sha256 is not null").groupBy("content_sha256").agg(F.min("path").alias("first_path"))
    told = told.join(names, "path").join(same, "content_sha256", "left")
    empty = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    reason = (
        F.when(empty("path") | empty("publisher") | empty("source_access_class") | empty("published_time_precision"), "missing_field")
        .when(F.col("content_sha256").isNull(), "missing_file").when(F.col("n_path") > 1, "duplicate_path")
        .when(F.col("first_path") != F.col("path"), "duplicate_content")
        .when(publication_precision(F.col("published_at_raw")) != F.col("published_time_precision"), "precision_mismatch")
    )
    told = told.withColumn("reason", reason).drop("n_path", "first_path")
    return told.where("reason is null").drop("reason"), told.where("reason is not null")


def run_observations(hosts: DataFrame, services: DataFrame, runs: list[str]) -> tuple[DataFrame, DataFrame]:
    """Hosts of some runs (a partition filter where the table is partitioned by run) and their services."""
    own = hosts.where(F.col("query_run_id").isin(runs))
    return own, services.join(own.select("observation_id"), "observation_id", "left_semi")


def indicator_observations(hosts: DataFrame, services: DataFrame, indicators: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Hosts of some indicators across runs, and their services."""
    own = hosts.join(indicators.select("indicator_id").distinct(), "indicator_id", "left_semi")
    return own, services.join(own.select("observation_id"), "observation_id", "left_semi")


# -- the observation model over the driver's events --------------------------------------------------

HOSTS_V = """
select concat('obs-',cast(event_id as string)) as observation_id, concat('ioc-',cast(user_id as string)) as indicator_id,
       case when event_type<>'error' then ts end as observed_at, ts + interval 1 hour as collected_at, event_type<>'error' as host_observed,
       case when event_type='error' then case event_id % 4 when 0 then 'not_found' when 1 then 'not_scanned' when 2 then 'no_response' else 'api_error' end end as negative_reason,
       cast(64500 + user_id % 7 as bigint) as asn, concat('run-',cast(event_id % 8 as string)) as query_run_id
from events"""
SERVICES_V = """
select concat('svc-',cast(event_id as string)) as service_observation_id, concat('obs-',cast(event_id as string)) as observation_id,
       case k % 4 when 0 then 443 when 1 then 22 when 2 then 8443 else 80 end as port, 'tcp' as transport,
       case k % 4 when 0 then 'https' when 1 then 'ssh' when 2 then 'https' else 'http' end as protocol,
       case when event_id % 10 <> 0 then ts end as observed_at,
       case when event_type in ('click','purchase') then concat('cert-',cast(user_id % 20 as string),'-',cast(phase as string)) end as cert_sha256,
       case when k % 5 = 0 then repeat('0',62) else concat('jarm-',cast(k % 12 as string)) end as jarm,
       case k % 6 when 0 then 'nginx' when 1 then 'openssh' when 2 then 'apache' else concat('relaybox-',cast(k % 3 as string)) end as software_product
from (select *, cast(regexp_extract(props,'([0-9]+)',1) as int) as k, cast(floor((extract(day from ts)-1)/10.0) as int) as phase
      from events where event_type in ('click','view','purchase')) e"""
#: The same views for the SQL that results are held against.
VIEWS = f"hosts_v as ({HOSTS_V}), services_v as ({SERVICES_V})"

HOST_COLUMNS = {"prefix": "string", "raw_record_hash": "string"}
SERVICE_COLUMNS = {"spki_sha256": "string", "ja4": "string", "ssh_key_hash": "string", "banner_hash": "string", "http_title_hash": "string", "software_vendor": "string", "software_version": "string"}


def _with(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    return df.withColumns({c: F.lit(None).cast(t) for c, t in columns.items() if c not in df.columns})


def event_observations(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(hosts, services) of the events table, with the optional columns of the model as nulls."""
    hosts = spark.sql(HOSTS_V.replace("from events", "from {events}"), events=table(spark, folder, "events"))
    services = spark.sql(SERVICES_V.replace("from events", "from {events}"), events=table(spark, folder, "events"))
    return _with(hosts, HOST_COLUMNS), _with(services, SERVICE_COLUMNS)


def present(df: DataFrame, name: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None)
