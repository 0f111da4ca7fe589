"""What `explode` makes is moved by key: the planner takes it for as small as what it is made of."""

from pyspark.sql import functions as F

from infratrace.llm import common, near_copies, op6_simhash


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_signatures_do_not_go_through_the_driver(spark):
    fps = common.stash(spark.range(300).select(F.xxhash64("id").alias("fp")), "fps")
    assert "Broadcast" not in plan(op6_simhash.links(fps))
    close = common.stash(spark.range(150).select((F.col("id") * 2).alias("fp")).unionAll(spark.range(300).select(F.xxhash64("id"))), "fps")
    hot = plan(op6_simhash.links(close, hot=5))
    assert "BuildLeft" not in hot and "SortMergeJoin" in hot


def test_bands_do_not_go_through_the_driver(spark, monkeypatch):
    plans = {}
    monkeypatch.setattr(near_copies, "stash", lambda df, name: plans.setdefault(name, plan(df)) and common.stash(df, name))
    docs = spark.range(40).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("a b c d e f g"), F.col("id") % 8).alias("text"))
    assert near_copies.near_copies(docs).count() == 40
    assert "Broadcast" not in plans["filed"]


def test_side_is_sent_or_moved_by_its_rows(spark):
    one = spark.range(50).withColumnRenamed("id", "k")
    small = common.stash(spark.range(3).withColumnRenamed("id", "k"), "side")
    assert "BroadcastHashJoin" in plan(one.join(common.side(small, 3), "k"))
    assert "SortMergeJoin" in plan(one.join(common.side(small, 2), "k"))
