"""Each row with the latest record at or before its own time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Seconds of a bucket of time.
BUCKET = 24 * 3600


def as_of(rows: DataFrame, records: DataFrame, key: list[str], at: str, time: str, tie: str, found: str = "record", bucket: int = BUCKET) -> DataFrame:
    """rows with `found`, a struct of the columns of the record of the same key that has the greatest
    (time, tie) of those at or before the row's `at`; null if there is none.

    Rows and records of a key are put in order together, bucket of time by bucket of time, and a bucket takes
    over the last record of those before it. So a key that holds a large part of all rows is sorted in as many tasks
    as it has buckets, and nothing is paired. A null key or time finds nothing; records without a time are
    never found. Repeated rows stay."""
    width = bucket * 1_000_000
    number = lambda c: F.floor(F.unix_micros(c.cast("timestamp")) / width)
    keys = [f"_k{i}" for i in range(len(key))]
    named = lambda *more: [*[F.col(c).alias(k) for c, k in zip(key, keys)], *more]
    whole = lambda df: F.struct(*[F.col(f"`{c}`") for c in df.columns])
    known = records.where(F.col(time).isNotNull()).select(*named(F.col(time).cast("timestamp").alias("_t"), F.col(tie).alias("_tie"), whole(records).alias("_record")))
    asked = rows.select(*named(F.col(at).cast("timestamp").alias("_t"), whole(rows).alias("_row")))
    empty = lambda df, c: F.lit(None).cast(df.schema[c].dataType)
    both = known.select(*keys, "_t", "_tie", "_record", empty(asked, "_row").alias("_row")).unionAll(asked.select(*keys, "_t", empty(known, "_tie"), empty(known, "_record"), "_row"))
    both = both.withColumn("_b", number(F.col("_t")))
    # of equal times records come first
    order = Window.partitionBy(*keys, "_b").orderBy("_t", F.col("_row").isNotNull(), "_tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = F.last("_record", ignorenulls=True).over(order)
    ends = both.where("_b is not null").groupBy(*keys, "_b").agg(F.max_by("_record", F.when(F.col("_record").isNotNull(), F.struct("_t", "_tie"))).alias("_end"))
    before = F.last("_end", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    carried = ends.select(*[F.col(k).alias(f"{k}c") for k in keys], F.col("_b").alias("_bc"), before.alias("_before"))
    same = [F.col(k).eqNullSafe(F.col(f"{k}c")) for k in keys] + [F.col("_b") == F.col("_bc")]
    told = both.withColumn("_inside", inside).where("_row is not null").join(carried, same, "left")
    complete = F.col("_t").isNotNull()
    for k in keys:
        complete = complete & F.col(k).isNotNull()
    return told.select("_row.*", F.when(complete, F.coalesce("_inside", "_before")).alias(found))

