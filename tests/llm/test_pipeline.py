"""The pipeline, stage by stage, against what each should do to a small corpus."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from infratrace.llm import common, op7_bpe

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SECRET = "f33e61083db5dbdf4bd2369d2f80176e57f7fda2"


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(9)
    words = {"en": ["the", "and", "of", "ing", "tion", "her"], "de": ["der", "und", "sch", "ein", "über", "ung"]}
    rows = []
    for i in range(120):
        lang = "en" if i % 3 else "de"
        text = " ".join("".join(rng.choice(words[lang]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(60, 200)))
        rows.append((i, text, lang, f"s{i % 4}", len(text)))
    rows += [(1000 + i, rows[i][1], rows[i][2], "s0", rows[i][4]) for i in range(20)]  # copies
    rows += [(2000, None, "en", "s1", None), (2001, "123 456", "en", "s1", 7), (2002, "", None, None, 0)]
    leaky = rows[3][1] + f' token = "{SECRET}" end'
    rows.append((3000, leaky, "en", "s2", len(leaky)))
    own = " ".join("".join(rng.choice(words["en"]) for _ in range(2)) for _ in range(150))
    rows.append((3001, f'{own} secret = "{SECRET[:-1]}3" end', "en", "s2", None))
    return spark.createDataFrame(rows, DOCS)


def test_stages(spark, corpus):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language", "near duplicates", "secrets", "mixing", "encoding"]
    out = {"input": corpus}
    for name, stage in corpus_pipeline.STAGES:
        out[name] = common.stash(stage(spark, list(out.values())[-1], ""), name.replace(" ", "_"))
    ids = {k: [r["doc_id"] for r in v.select("doc_id").collect()] for k, v in out.items()}
    assert all(out[n].columns == corpus.columns for n in names[:-1])
    assert set(ids["input"]) - set(ids["language"]) == {2000, 2001, 2002}
    assert len(ids["near duplicates"]) == len(set(ids["near duplicates"]))
    assert not any(1000 <= i < 1020 for i in ids["near duplicates"]) and set(range(20)) <= set(ids["near duplicates"])
    texts = {r["doc_id"]: r["text"] for r in out["secrets"].collect()}
    assert sorted(texts) == sorted(ids["near duplicates"])
    before = {r["doc_id"]: r["text"] for r in out["near duplicates"].collect()}
    assert 3000 not in texts and SECRET[:-1] in before[3001]  # 3000 is a near copy of 3
    assert SECRET[:-1] not in texts[3001] and corpus_pipeline.MASK in texts[3001]
    assert all(texts[i] == before[i] for i in texts if i != 3001)
    counted = Counter(ids["mixing"])
    assert max(counted.values()) <= 2
    words = out["secrets"].select(F.sum(F.size(F.split("text", " ")))).collect()[0][0]
    mixed = out["mixing"].select(F.sum(F.size(F.split("text", " ")))).collect()[0][0]
    assert abs(mixed - 1.5 * words) <= 8
    last = {(r["doc_id"], bytes(r["token_ids"])): r["n_tokens"] for r in out["encoding"].collect()}
    v = op7_bpe.Vocabulary(op7_bpe.PATH)
    for r in out["mixing"].collect():
        ids_of = v.encode_batch([r["text"]])[0]
        assert last[r["doc_id"], ids_of] == len(np.frombuffer(ids_of, "<u4")) and v.decode(ids_of) == r["text"]


def test_repeated_rows_and_empty_table(spark, corpus):
    twice = corpus.where("doc_id < 5").unionAll(corpus.where("doc_id < 5"))
    kept = corpus_pipeline.near_duplicates(spark, twice, "")
    assert kept.count() == 5
    mixed = corpus_pipeline.mixing(spark, twice, "")
    assert mixed.count() > 0 and mixed.columns == corpus.columns
    empty = corpus.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        empty = common.stash(stage(spark, empty, ""), "empty")
        assert empty.count() == 0, name


def test_columns_of_any_name_come_through(spark, corpus):
    names = ["m", "live", "words", "size", "nth", "key", "row", "score", "lang_pred", "_lang", "fp", "kept", "position", "component"]
    wide = corpus.where("doc_id % 5 < 2")
    for i, name in enumerate(names):
        wide = wide.withColumn(name, F.concat(F.lit(f"{name}-"), F.col("doc_id").cast("string")))
    docs = wide
    for name, stage in corpus_pipeline.STAGES:
        docs = common.stash(stage(spark, docs, ""), "wide")
        rows = docs.select("doc_id", *names).collect()
        assert rows and all(r[c] == f"{c}-{r['doc_id']}" for r in rows for c in names), name


def test_run_on_the_table(spark, data):
    got = corpus_pipeline.run(spark, data)
    assert got.count() > 0 and "token_ids" in got.columns
    assert corpus_pipeline.ORACLE_SQL is None


def test_maps_at_any_depth_come_through(spark, corpus):
    some = corpus.where("doc_id % 3 = 0 and doc_id < 1000")
    # rows of one doc_id and text that differ in a map, or in where a null stands, only
    twice = some.select("*", F.explode(F.array(F.lit(1), F.lit(2))).alias("copy"))
    entry = lambda c: F.create_map(F.lit("copy"), c, F.lit("none"), F.lit(None).cast("int"))
    wide = (
        twice.withColumn("top", entry(F.col("copy"))).withColumn("listed", F.array(entry(F.col("copy")), F.lit(None)))
        .withColumn("inside", F.struct(entry(F.col("copy")).alias("m"))).withColumn("nulls", F.struct(F.when(F.col("copy") == 1, 1).alias("a"), F.when(F.col("copy") == 2, 1).alias("b"))).drop("copy")
    )
    assert len({r[0] for r in wide.select(corpus_pipeline._key(wide)).collect()}) == wide.count()
    turned = wide.select(corpus_pipeline._key(wide).alias("k")).intersect(
        wide.withColumn("top", F.map_from_entries(F.reverse(F.map_entries("top")))).select(corpus_pipeline._key(wide).alias("k")))
    assert turned.count() == wide.count()  # the order of a map's entries says nothing
    mixed = corpus_pipeline.mixing(spark, common.stash(wide, "wide"), "").collect()
    assert {r["top"]["copy"] for r in mixed} == {1, 2}
    assert all(r["top"]["copy"] == r["listed"][0]["copy"] == r["inside"]["m"]["copy"] == (1 if r["nulls"]["a"] else 2) for r in mixed)
    docs = wide
    for name, stage in corpus_pipeline.STAGES:
        docs = common.stash(stage(spark, docs, ""), "maps")
        got = docs.select("top", "listed", "inside").collect()
        assert got and all(r["top"]["copy"] == r["listed"][0]["copy"] == r["inside"]["m"]["copy"] for r in got), name
