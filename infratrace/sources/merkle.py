"""A tree of hashes over a table's parts: two states of a table are compared from the root down, and only the
parts that differ are read.

A row's part is the first hex digits of its key's hash, so parts are even and equal keys meet in equal
parts; a part's hash covers its rows in any order, a node's hash its children. `<path>/rows` is partitioned by part,
`<path>/tree` has a row for each node: node (a prefix of parts, the root empty), hash and rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.ids import sha256_text
from ..operators.audit import differences

#: Hex digits of a part: 16**DIGITS parts at most.
DIGITS = 2


def _text(columns: list[str]) -> Column:
    return F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]), {"ignoreNullFields": "false"})


def tree(rows: DataFrame, key: list[str], digits: int = DIGITS) -> DataFrame:
    """node, hash and rows of every node. Row hashes are joined within the 256 values of their first byte before
    they are joined to a part's."""
    join = lambda of: sha256_text(F.array_join(F.array_sort(F.collect_list(of)), "|"))
    each = rows.select(F.substring(sha256_text(_text(key)), 1, digits).alias("node"), sha256_text(_text(rows.columns)).alias("h"))
    fine = each.groupBy("node", F.substring("h", 1, 2).alias("b")).agg(join(F.col("h")).alias("h"), F.count("*").alias("rows"))
    level = fine.groupBy("node").agg(join(F.concat("b", "h")).alias("hash"), F.sum("rows").alias("rows"))
    out = level
    for n in range(digits - 1, -1, -1):
        level = level.groupBy(F.substring("node", 1, n).alias("up")).agg(join(F.concat("node", "hash")).alias("hash"), F.sum("rows").alias("rows")).withColumnRenamed("up", "node")
        out = out.unionByName(level)
    return out


def write(rows: DataFrame, path: str, key: list[str], digits: int = DIGITS) -> None:
    """rows and their tree."""
    rows.withColumn("_part", F.substring(sha256_text(_text(key)), 1, digits)).write.partitionBy("_part").parquet(f"{path}/rows")
    tree(rows, key, digits).coalesce(1).write.parquet(f"{path}/tree")  # at most 16**digits * 16 / 15 rows


def changed_parts(spark: SparkSession, stored: str, again: str, digits: int = DIGITS) -> list[str]:
    """Parts that differ between two states: nodes are compared level by level below those that differ."""
    one, two = (spark.read.schema("node string, hash string, rows long").parquet(f"{p}/tree") for p in (stored, again))
    differing = [""]
    for n in range(digits + 1):
        near = F.length("node") == n
        if n:
            near = near & F.substring("node", 1, n - 1).isin(differing)
        both = one.where(near).select("node", F.col("hash").alias("a")).join(two.where(near).select("node", F.col("hash").alias("b")), "node", "full")
        differing = sorted(r["node"] for r in both.where(~F.col("a").eqNullSafe(F.col("b"))).select("node").collect())
        if not differing:
            break
    return differing


def read_parts(spark: SparkSession, path: str, schema: StructType, parts: list[str]) -> DataFrame:
    """Rows of some parts; the folders of others are not opened."""
    every = spark.read.schema(StructType([*schema, StructField("_part", StringType())])).parquet(f"{path}/rows")
    return every.where(F.col("_part").isin(parts) if parts else F.lit(False)).drop("_part")


def audit(spark: SparkSession, stored: str, again: str, schema: StructType, key: list[str], code: str, digits: int = DIGITS) -> DataFrame:
    """`differences` of two states (code, record_id, detail), from the parts that differ."""
    parts = changed_parts(spark, stored, again, digits)
    columns = [f.name for f in schema if f.name not in key]
    return differences(*(read_parts(spark, p, schema, parts) for p in (stored, again)), key, columns, code)
