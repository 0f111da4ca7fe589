"""What the corpus operators share: tables in the shared folder, Arrow batch bounds, components."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but space and U+0009..U+000D.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows and bytes of an Arrow batch, so that a batch of long texts stays small.
BATCH_ROWS, BATCH_BYTES = 512, 16 << 20
#: Rows up to which a side table is sent to every task.
SIDE_ROWS = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession) -> None:
    """Lower the rows and bytes of an Arrow batch unless the session has chosen its own numbers."""
    for key, value in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, str(value))


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share; it goes when the session ends.

    A session on one machine that names no folder, such as a notebook, gets one of that machine; on a
    cluster the folder must be named.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = f"file://{tempfile.gettempdir()}/infratrace"
    path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    jpath, files = _files(spark, path)
    files.deleteOnExit(jpath)
    return path


def _files(spark: SparkSession, path: str):
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath, jpath.getFileSystem(spark._jsc.hadoopConfiguration())


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage and gives the planner sizes."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stashed = path
    return out


def side(stashed: DataFrame, rows: int = SIDE_ROWS) -> DataFrame:
    """A stashed table as one side of a join: sent to every task up to so many rows, moved by key beyond.

    The planner sizes what `explode` makes by the rows it is made of, so it may take the other side for
    the smaller one and collect all of it in the driver."""
    return stashed.hint("broadcast" if stashed.count() <= rows else "merge")


def discard(*stashed: DataFrame) -> None:
    """Delete tables that `stash` wrote, once what was made of them is written itself."""
    for df in stashed:
        jpath, files = _files(df.sparkSession, df._stashed)
        files.delete(jpath, True)


def source_order() -> Column:
    """Place of a row in its scan: stable while the scanned files are."""
    return F.monotonically_increasing_id()


def connected_components(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """Components of an undirected graph, by contraction.

    edges: columns a, b (long, not null). Returns id, root for every end of an edge between two
    different nodes; root is one node of the component. In each round every node joins its
    neighbour (or itself) of the smallest hash and edges between joined nodes vanish, so the graph
    shrinks geometrically whatever its shape; a hub's edges are reduced before they are shuffled.
    """
    spark = edges.sparkSession
    live = stash(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    maps: list[DataFrame] = []
    for k in range(max_rounds):
        if live.isEmpty():
            break
        rank = lambda c: F.struct(F.xxhash64(F.lit(k), c).alias("h"), c.alias("id"))
        ends = live.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(live.select("b", "a"))
        joined = ends.groupBy("u").agg(F.min(rank(F.col("v"))).alias("near"))
        step = stash(joined.select("u", F.least("near", rank(F.col("u")))["id"].alias("m")), f"step{k}")
        maps.append(step)
        left = live.join(step.select(F.col("u").alias("a"), F.col("m").alias("ma")), "a")
        both = left.join(step.select(F.col("u").alias("b"), F.col("m").alias("mb")), "b")
        done, live = live, stash(both.where("ma <> mb").select(F.least("ma", "mb").alias("a"), F.greatest("ma", "mb").alias("b")).distinct(), f"edges{k}")
        discard(done)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    if not maps:
        return spark.createDataFrame([], "id long, root long")
    roots = maps[-1].select(F.col("u").alias("id"), F.col("m").alias("root"))
    for step in reversed(maps[:-1]):
        known = roots.select(F.col("id").alias("m"), F.col("root"))
        roots = stash(step.join(known, "m", "left").select(F.col("u").alias("id"), F.coalesce("root", "m").alias("root")), "roots")
        discard(step)
    return roots
