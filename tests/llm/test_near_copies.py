"""Near copies by five-word shingles against brute force."""

import random

import pytest

import corpus_pipeline
from infratrace.llm import near_copies, op6_simhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))}


def similarity(a, b):
    return len(a & b) / len(a | b)


def edited(rng, words, edits):
    words = list(words)
    for at in rng.sample(range(len(words)), edits):
        words[at] = f"new{rng.randint(0, 10**9)}"
    return " ".join(words)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    out = []
    for _ in range(25):
        words = [f"w{rng.randint(0, 300)}" for _ in range(rng.randint(100, 300))]
        out += [edited(rng, words, k) for k in (0, 1, 2, 3, 5, 9)]
    return out + [out[0].upper(), "one two", "One  two", "one two three four five"]


def brute(texts):
    root = list(range(len(texts)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    sets = [shingles(t) for t in texts]
    for i in range(len(texts)):
        for j in range(i):
            if similarity(sets[i], sets[j]) >= 0.8:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))]


@pytest.mark.parametrize("hot, block", [(50, 1000), (2, 2)])
def test_classes_against_brute_force(spark, texts, hot, block):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in near_copies.near_copies(df, hot=hot, block=block).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts)


def test_fingerprints_and_bands_together(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = op6_simhash.near_duplicates(df, shingle=5, similarity=0.8).collect()
    assert [r["component_id"] for r in sorted(got, key=lambda r: r["doc_id"])] == brute(texts)
    assert all(r["fingerprint"] % 2**64 == op6_simhash.fingerprint(texts[r["doc_id"]], 5) for r in got)


def test_links_found_by_fingerprints_alone(spark, texts):
    prints = [(i, op6_simhash._signed(op6_simhash.fingerprint(t, 5))) for i, t in enumerate(texts)]
    got = op6_simhash._candidates(spark.createDataFrame(prints, "node long, fp long"), 4, 1000, 1000)
    close = {(i, j) for i, a in prints for j, b in prints if i < j and (a ^ b).bit_count() <= 4 and (a >= 0) == (b >= 0)}
    pairs = {(r["a"], r["b"]) for r in got.collect()}
    assert pairs and all(((prints[a][1] ^ prints[b][1]) & (2**64 - 1)).bit_count() <= 4 for a, b in pairs) and len(close) > 10


def test_stage_leaves_one_of_each_class(spark, texts):
    # many of these pairs at 0.8 or more differ in more than four bits of their fingerprints
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], DOCS)
    kept = sorted(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, df, "").collect())
    assert kept == sorted(set(brute(texts)))


def test_rows_without_words_or_ids(spark):
    rows = [(None, None), (8, ""), (7, " \n"), (5, "a b c d e f"), (5, "a b c d e f"), (None, "alone in the world here")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_copies.near_copies(df).collect()
    assert sorted(str(r["component_id"]) for r in got) == ["5", "5", "7", "7", "7", "None"]
    assert near_copies.near_copies(df.limit(0)).count() == 0
