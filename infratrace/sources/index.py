"""An index beside an append-only table: which of its files may hold a key.

`<table>/_index` (hidden from readers of the table) has a row for each file with the least and greatest
first key column, and the file's Bloom filter as rows of 64-bit words. A key sets HASHES bits of one word, so
asking for it is an equality join on (level, word) and a bit test; at BITS bits a key a file is asked in vain
by about one key in 30,000. Words are stored in order of spots, so the spots of a small batch reach the scan
as a filter, and files whose range of keys the batch does not touch are left out before.

The files themselves are the truth: one that the index does not know (a job may end between writing rows
and indexing them) counts as holding every key and is indexed by the next append.
"""

from __future__ import annotations

import re
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Bits of the filter for each key, bits that a key sets, and spots that words are ordered by.
BITS, HASHES, SPOTS = 32, 8, 64
#: Words of an index file.
FILE_WORDS = 2_000_000


def _places(key: list[Column], level: Column) -> tuple[Column, Column, Column]:
    """spot, word and mask of a key in a filter of 2**level words."""
    h = F.xxhash64(*[x for c in key for x in (c, c.isNull())])
    again = F.xxhash64(h, F.lit(1))
    one, mask = F.lit(1).cast("long"), F.lit(0).cast("long")
    for i in range(HASHES):
        mask = mask.bitwiseOR(F.call_function("shiftleft", one, F.shiftright(again, 6 * i).bitwiseAND(F.lit(63)).cast("int")))
    word = F.shiftright(h, 6).bitwiseAND(F.call_function("shiftleft", one, level) - 1)
    return h.bitwiseAND(F.lit(SPOTS - 1)).cast("int"), word, mask


def _below(path: str) -> str:
    """What precedes a file's place below the table."""
    return "/" + path.rstrip("/").rsplit("/", 1)[1] + "/"


def files_of(spark: SparkSession, path: str, schema: StructType) -> list[str]:
    """Every file of a table, below its path."""
    mark = _below(path)
    return [f[f.rindex(mark) + len(mark):] for f in spark.read.schema(schema).parquet(path).inputFiles()]


def read_files(spark: SparkSession, path: str, schema: StructType, files: list[str]) -> DataFrame:
    """Some files of a table with its partition columns."""
    if not files:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", path).parquet(*[f"{path.rstrip('/')}/{unquote(f)}" for f in files])


def _tables(spark: SparkSession, path: str, first: str) -> tuple[DataFrame, DataFrame] | None:
    """The index's rows for files and for words, if there is an index."""
    root = f"{path.rstrip('/')}/_index"
    jpath = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/files/_SUCCESS")
    if not jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath):
        return None
    files = spark.read.schema(f"file string, rows long, level int, low {first}, high {first}, nulls boolean").parquet(f"{root}/files")
    return files.dropDuplicates(["file"]), spark.read.schema("file string, level int, spot int, word long, bits long").parquet(f"{root}/words")


def refresh(spark: SparkSession, path: str, schema: StructType, key: list[str]) -> int:
    """Index the files that the index does not know; their number. Words first, so that a file that is
    known has all of its words."""
    first = schema[key[0]].dataType.simpleString()
    known = _tables(spark, path, first)
    done = {r["file"] for r in known[0].select("file").collect()} if known else set()
    new = [f for f in files_of(spark, path, schema) if f not in done]
    if not new:
        return 0
    name = F.regexp_extract("_metadata.file_path", f".*{re.escape(_below(path))}(.*)", 1)
    rows = read_files(spark, path, schema, new).select(name.alias("file"), *[F.col(c).alias(f"k{i}") for i, c in enumerate(key)])
    level = F.ceil(F.log2(F.greatest(F.col("rows") * BITS / 64, F.lit(1.0)))).cast("int")
    sizes = rows.groupBy("file").agg(F.count("*").alias("rows"), F.min("k0").alias("low"), F.max("k0").alias("high"), F.bool_or(F.col("k0").isNull()).alias("nulls")).withColumn("level", level)
    sizes = sizes.select("file", "rows", "level", "low", "high", "nulls")
    spot, word, mask = _places([F.col(f"k{i}") for i in range(len(key))], F.col("level"))
    words = rows.join(F.broadcast(sizes.select("file", "level")), "file").select("file", "level", spot.alias("spot"), word.alias("word"), mask.alias("mask"))  # a row for each new file
    words = words.groupBy("file", "level", "spot", "word").agg(F.bit_or("mask").alias("bits"))
    words.sort("spot", "word").write.option("maxRecordsPerFile", FILE_WORDS).mode("append").parquet(f"{path.rstrip('/')}/_index/words")
    sizes.coalesce(1).write.mode("append").parquet(f"{path.rstrip('/')}/_index/files")
    return len(new)


def files_for(keys: DataFrame, path: str, schema: StructType, key: list[str]) -> list[str]:
    """Files of the table that may hold one of `keys` (columns key, different rows), below its path."""
    spark = keys.sparkSession
    every = files_of(spark, path, schema)
    known = _tables(spark, path, schema[key[0]].dataType.simpleString())
    if not known:
        return every
    files, words = known
    first = F.col(key[0])
    span = keys.agg(F.min(first).alias("low"), F.max(first).alias("high"), F.coalesce(F.bool_or(first.isNull()), F.lit(False)).alias("nulls"), F.collect_set(_places([F.col(c) for c in key], F.lit(0))[0]).alias("spots")).first()
    if not span["spots"]:
        return []
    told = {r["file"]: r for r in files.select("file", "level", ((F.col("low") <= F.lit(span["high"])) & (F.col("high") >= F.lit(span["low"]))).alias("near"), "nulls").collect()}
    near = {f: r["level"] for f, r in told.items() if r["near"] or r["nulls"] and span["nulls"]}
    levels = F.explode(F.array(*[F.lit(x) for x in sorted(set(near.values()))] or [F.lit(0)]))
    spot, word, mask = _places([F.col(c) for c in key], F.col("level"))
    asked = keys.withColumn("level", levels).select("level", spot.alias("spot"), word.alias("word"), mask.alias("mask"))
    if len(span["spots"]) < SPOTS:
        words = words.where(F.col("spot").isin(*span["spots"]))
    if len(near) < len(told):
        words = words.join(F.broadcast(spark.createDataFrame([(f,) for f in near], "file string")), "file", "left_semi")  # a row for each file of the table
    hits = words.join(asked, ["level", "spot", "word"]).where(F.col("bits").bitwiseAND(F.col("mask")) == F.col("mask"))
    found = {r["file"] for r in hits.select("file").distinct().collect()} if near else set()
    return [f for f in every if f in found or f not in told]
