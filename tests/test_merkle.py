"""Two states of a table by their trees of hashes."""

from infratrace.operators import mining
from infratrace.sources import merkle

SCHEMA = "k long, s string"


def test_one_changed_row_is_found_by_reading_one_part(spark, tmp_path):
    rows = [(i, None if i % 7 == 0 else f"s{i}") for i in range(2000)]
    states = {"a": rows, "same": rows[::-1], "changed": [(i, "other" if i == 77 else s) for i, s in rows], "less": rows[:-1]}
    for name, state in states.items():
        merkle.write(spark.createDataFrame(state, SCHEMA), f"file://{tmp_path}/{name}", ["k"])
    at = lambda name: f"file://{tmp_path}/{name}"
    schema = spark.createDataFrame([], SCHEMA).schema
    assert merkle.changed_parts(spark, at("a"), at("same")) == []
    assert merkle.audit(spark, at("a"), at("same"), schema, ["k"], "x").count() == 0
    for name, want in (("changed", ("77", "differs")), ("less", ("1999", "not reproduced"))):
        parts = merkle.changed_parts(spark, at("a"), at(name))
        assert len(parts) == 1
        read = merkle.read_parts(spark, at("a"), schema, parts)
        assert len(read.inputFiles()) > 0 and read.count() < 40
        assert [(r["record_id"], r["detail"]) for r in merkle.audit(spark, at("a"), at(name), schema, ["k"], "x").collect()] == [want]


def test_tree_of_no_rows_and_of_repeated_rows(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert merkle.tree(none, ["k"]).count() == 0
    root = lambda rows: [r["hash"] for r in merkle.tree(spark.createDataFrame(rows, SCHEMA), ["k"]).collect() if r["node"] == ""]
    assert root([(1, "a"), (1, "a")]) != root([(1, "a")]) and root([(1, None)]) != root([(1, "null")])


def test_extractor_in_sql(spark):
    spark.udtf.register("words_of", mining.extractor_udtf(lambda t: [("word", w, "unknown", None) for w in t.split()]))
    spark.createDataFrame([(1, "a b"), (2, None), (3, "")], "id int, text string").createOrReplaceTempView("texts_in")
    got = spark.sql("select id, f.pos, f.raw_form from texts_in, lateral words_of(text) f").collect()
    assert sorted(map(tuple, got)) == [(1, 0, "a"), (1, 1, "b")]
