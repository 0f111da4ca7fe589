"""Append-only tables: classify a batch against what is stored, append what is new, export in public."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.ids import sha256_text
from . import index
from .shared import shared_folder


#: Partitions of a batch that are looked up by name.
FEW_PARTITIONS = 256


def payload_hash(columns: list[str]) -> Column:
    return sha256_text(F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]), {"ignoreNullFields": "false"}))


def classify(batch: DataFrame, stored: DataFrame, key: list[str], earliest: str | None = None) -> DataFrame:
    """batch with action: insert, noop (same key, same payload), conflict (same key, other payload, in
    the store or in the batch) or duplicate (again in the batch).

    With `earliest` that column is not part of the payload: a stored row keeps it, and an earlier
    value is a backfill_conflict.
    """
    columns = [c for c in batch.columns if c != earliest]
    old = stored.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(key)], payload_hash(columns).alias("_old"), *([F.col(earliest).alias("_first")] if earliest else []))
    new = batch.withColumn("_new", payload_hash(columns))
    same = [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(key)]
    told = new.join(old, same, "left")
    order = ([F.col(earliest)] if earliest else []) + [F.col("_new")]
    by_key = Window.partitionBy(*key)
    told = told.withColumn("_nth", F.row_number().over(by_key.orderBy(*order))).withColumn("_least", F.min("_new").over(by_key)).withColumn("_most", F.max("_new").over(by_key))
    action = F.when(F.col("_old").isNotNull() & (F.col("_old") != F.col("_new")), "conflict").when(F.col("_least") != F.col("_most"), "conflict")
    if earliest:
        action = action.when(F.col("_old").isNotNull() & (F.col(earliest) < F.col("_first")), "backfill_conflict")
    action = action.when(F.col("_old").isNotNull(), "noop").when(F.col("_nth") > 1, "duplicate").otherwise("insert")
    return told.withColumn("action", action).select(*batch.columns, "action")


def append(batch: DataFrame, path: str, key: list[str], earliest: str | None = None, partition_by: list[str] | None = None, indexed: bool = True, files: int | None = None) -> DataFrame:
    """Append the new rows of batch to the Parquet table at path; returns action, rows. Replays insert
    nothing; conflicts are refused and counted.

    Of the stored rows only those are hashed whose key the batch has, and they are looked for only in files
    that the table's index (sources/index.py) says may hold one; new files are indexed after the
    append. Where `partition_by` is part of the key and the batch names no more than FEW_PARTITIONS, only
    these are read. `files` is the most files that the rows are written to; else there are as many as the
    classified batch has partitions, which is up to the session."""
    spark, schema = batch.sparkSession, batch.schema
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath)
    stored = spark.createDataFrame([], schema)
    if there:
        keys = _cut(batch.select(*key).distinct())
        every = index.read_files(spark, path, schema, index.files_for(keys, path, schema, key)) if indexed else spark.read.schema(schema).parquet(path)
        if partition_by and set(partition_by) <= set(key):
            named = keys.select(*partition_by).distinct().limit(FEW_PARTITIONS + 1).collect()
            if len(named) <= FEW_PARTITIONS:
                every = every.where(reduce(or_, [reduce(and_, [F.col(c).eqNullSafe(F.lit(r[c])) for c in partition_by]) for r in named], F.lit(False)))
        wanted = keys.select(*[F.col(c).alias(f"_w{i}") for i, c in enumerate(key)])
        stored = every.join(wanted, [F.col(c).eqNullSafe(F.col(f"_w{i}")) for i, c in enumerate(key)], "left_semi")
    told = _cut(classify(batch, stored, key, earliest))
    new = told.where("action = 'insert'").select(*batch.columns)
    (new.coalesce(files) if files else new).write.mode("append").partitionBy(*(partition_by or [])).parquet(path)
    if indexed:
        index.refresh(spark, path, schema, key)
    return told.groupBy("action").agg(F.count("*").alias("rows"))


def _cut(df: DataFrame) -> DataFrame:
    """df checkpointed in the shared folder of the session."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def latest(events: DataFrame, key: list[str], time: str, tie: str) -> DataFrame:
    """Current state of an event log: the last event of each key."""
    rest = [c for c in events.columns if c not in key]
    last = F.max_by(F.struct(*rest), F.struct(time, tie)).alias("_last")
    return events.groupBy(*key).agg(last).select(*key, "_last.*")


#: Columns that a public source manifest may show.
PUBLIC_COLUMNS = (
    "document_id", "canonical_url", "publisher", "title", "published_at", "published_at_raw", "published_time_precision", "source_timezone", "retrieved_at",
    "content_sha256", "acquisition_mode", "source_access_class", "corpus_purpose", "source_independence", "source_family_id",
)


def public_manifest(documents: DataFrame, requested: DataFrame) -> DataFrame:
    """requested (position, document_id) with the public columns; reason is missing or restricted."""
    shown = documents.select(*[c for c in PUBLIC_COLUMNS if c in documents.columns])
    told = requested.join(shown, "document_id", "left")
    reason = F.when(F.col("publisher").isNull() & F.col("content_sha256").isNull(), "missing").when(F.coalesce(F.col("source_access_class"), F.lit("")) != "public", "restricted")
    hide = [c for c in shown.columns if c != "document_id"]
    told = told.withColumn("reason", reason)
    return told.select("position", "document_id", *[F.when(F.col("reason").isNull(), F.col(c)).alias(c) for c in hide], "reason")


def strict(df: DataFrame, reason: str = "reason") -> DataFrame:
    """df, failing the query if any row has a reason."""
    return df.where(F.when(F.col(reason).isNotNull(), F.raise_error(F.concat(F.lit("refused: "), F.col(reason)))).otherwise(F.lit(True)).cast("boolean"))


def empty_like(spark: SparkSession, df: DataFrame) -> DataFrame:
    return spark.createDataFrame([], df.schema)
