"""The index of a ledger: which files an append opens, and that its results are those without it."""

import random

import pytest

from infratrace.sources import index, ledger

SCHEMA = "k long, s string, v int"


def _frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame(rows, schema).coalesce(1)


def _actions(df):
    return {r["action"]: r["rows"] for r in df.collect()}


def _keys(spark, ids):
    return _frame(spark, [(i, None if i % 5 == 0 else f"s{i}", 0) for i in ids]).select("k", "s")


@pytest.fixture(scope="module")
def filled(spark, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('ledgers')}/ledger"
    for part in range(6):
        rows = [(i, None if i % 5 == 0 else f"s{i}", i % 7) for i in range(part * 500, part * 500 + 500)]
        assert _actions(ledger.append(_frame(spark, rows), path, ["k", "s"])) == {"insert": 500}
    return path


def test_only_files_that_may_hold_a_key_are_opened(spark, filled):
    schema = _frame(spark, []).schema
    assert len(index.files_of(spark, filled, schema)) == 6
    opened = lambda ids: index.files_for(_keys(spark, ids), filled, schema, ["k", "s"])
    assert len(opened(range(1000, 1500))) == 1  # a replayed batch: the file it wrote
    assert len(opened([10, 2990])) == 2
    assert opened(range(5000, 9000)) == []  # beyond every range
    assert opened([]) == []
    strange = [(i, "other", 0) for i in range(0, 3000, 3)]  # within the ranges, but nobody's keys
    assert len(index.files_for(_frame(spark, strange).select("k", "s"), filled, schema, ["k", "s"])) <= 1


def test_results_are_those_without_index(spark, tmp_path):
    rng = random.Random(4)
    paths = {True: f"file://{tmp_path}/with", False: f"file://{tmp_path}/without"}
    seen = {}
    for step in range(4):
        rows = [(k := rng.choice([None, *range(60)]), None if k is None or k % 2 else "x", rng.randint(0, 1)) for _ in range(40)]
        told = {on: _actions(ledger.append(_frame(spark, rows), path, ["k", "s"], indexed=on)) for on, path in paths.items()}
        assert told[True] == told[False], step
        seen = {on: sorted(map(tuple, spark.read.schema(SCHEMA).parquet(path).collect()), key=repr) for on, path in paths.items()}
        assert seen[True] == seen[False]
    assert any(r[0] is None for r in seen[True])


def test_files_unknown_to_the_index_are_read_and_indexed_later(spark, tmp_path):
    path = f"file://{tmp_path}/ledger"
    ledger.append(_frame(spark, [(1, "a", 1)]), path, ["k"])
    _frame(spark, [(2, "b", 2)]).write.mode("append").parquet(path)  # as if the job had ended before indexing
    schema = _frame(spark, []).schema
    assert len(index.files_for(_frame(spark, [(9, "", 0)]).select("k"), path, schema, ["k"])) == 1
    assert _actions(ledger.append(_frame(spark, [(2, "b", 2), (1, "a", 1), (3, "c", 3)]), path, ["k"])) == {"noop": 2, "insert": 1}
    assert index.files_for(_frame(spark, [(9, "", 0)]).select("k"), path, schema, ["k"]) == []
    assert index.refresh(spark, path, schema, ["k"]) == 0


def test_partitioned_table(spark, tmp_path):
    path = f"file://{tmp_path}/ledger"
    rows = [(i, f"day {i % 3}/é", i) for i in range(30)]
    run = lambda r: _actions(ledger.append(_frame(spark, r), path, ["s", "k"], partition_by=["s"]))
    assert run(rows) == {"insert": 30}
    assert run(rows[:7]) == {"noop": 7}
    assert run([(1, "day 1/é", 5), (99, "day 1/é", 1)]) == {"conflict": 1, "insert": 1}
    schema = _frame(spark, []).schema
    assert len(index.files_for(_frame(spark, rows[:1]).select("s", "k"), path, schema, ["s", "k"])) == 1


def test_an_append_writes_the_files_it_is_asked_for(spark, tmp_path):
    before, path = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled"), f"file://{tmp_path}/ledger"
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # as for a batch that is too large to be joined up
    try:
        rows = [(i, f"s{i}", i % 7) for i in range(400)]
        assert _actions(ledger.append(_frame(spark, rows), path, ["k", "s"], files=1)) == {"insert": 400}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    schema = _frame(spark, []).schema
    assert len(index.files_for(_keys(spark, [3, 300]), path, schema, ["k", "s"])) == len(index.files_of(spark, path, schema)) == 1
