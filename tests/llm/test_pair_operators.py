"""SimHash and embedding near-duplicates against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from infratrace.llm import common, op6_simhash, op8_embeddings

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def classes(n, linked):
    root = list(range(n))

    def find(a):
        while root[a] != a:
            root[a] = root[root[a]]
            a = root[a]
        return a

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_components_of_awkward_graphs(spark):
    rng = random.Random(0)
    chain, star = [(i, i + 1) for i in range(200)], [(1000, 1000 + i) for i in range(1, 150)]
    rest = [(rng.randint(2000, 2400), rng.randint(2000, 2400)) for _ in range(300)]
    edges = chain + star + rest + [(5, 5)] + chain[:3]
    got = {r["id"]: r["root"] for r in common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    ids = sorted({x for e in edges if e[0] != e[1] for x in e})
    at = {x: i for i, x in enumerate(ids)}
    want = classes(len(ids), [(at[a], at[b]) for a, b in edges if a != b])
    assert set(got) == set(ids)
    for a in ids:
        assert (got[a] == got[ids[want[at[a]]]]) and want[at[got[a]]] == want[at[a]]
    assert common.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_fingerprint(text):
    import xxhash

    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes)) if hashes else 0


def test_fingerprints(spark):
    texts = ["A b\tC d e", "one two", "", None, "É é x y z", "w " * 9000, "a b c d e f"]
    for t in texts:
        assert op6_simhash.fingerprint(t) == brute_fingerprint(t)
    got = spark.createDataFrame([("one two three four",)], "s string").select(F.xxhash64("s")).collect()[0][0]
    assert op6_simhash.fingerprint("One TWO three four") == got % 2**64


def test_segments_leave_no_link_out():
    for bits in range(0, 12):
        cut = op6_simhash.segments(bits)
        assert sum(n for _, n in cut) == 64 and 2 * len(cut) > bits


@pytest.mark.parametrize("hot, block", [(1000, 1000), (3, 2)])
def test_links_against_brute_force(spark, hot, block):
    rng = random.Random(7)
    seeds = [rng.getrandbits(64) for _ in range(30)]
    fps = set(seeds)
    for s in seeds:
        for _ in range(6):
            x = s
            for b in rng.sample(range(64), rng.randint(0, 6)):
                x ^= 1 << b
            fps.add(x)
    fps = sorted(fps)
    df = spark.createDataFrame([(op6_simhash._signed(x),) for x in fps], "fp long")
    edges = op6_simhash.links(df, 4, hot, block)
    got = {r["id"]: r["root"] for r in common.connected_components(edges).collect()}
    want = classes(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4])
    root = [got.get(op6_simhash._signed(x), op6_simhash._signed(x)) for x in fps]
    for i in range(len(fps)):
        for j in range(i):
            assert (root[i] == root[j]) == (want[i] == want[j])
    if hot == 1000:
        pairs = [(r["a"], r["b"]) for r in edges.collect()]
        assert len(pairs) == len(set(pairs)) == sum((fps[i] ^ fps[j]).bit_count() <= 4 for i in range(len(fps)) for j in range(i))


def test_simhash_rows(spark):
    long = " ".join(f"w{i}" for i in range(400))
    near = long.replace("w7 ", "v7 ")
    rows = [(5, long), (3, near), (9, "something else entirely and more"), (None, None), (8, ""), (5, long), (None, "alone in the world here")]
    df = spark.createDataFrame([r + ("en", "s", 1) for r in rows], DOCS).withColumn("fingerprint", F.lit("clash"))
    got = op6_simhash.near_duplicates(df).collect()
    assert len(got) == 7
    assert {r["component_id"] for r in got if r["doc_id"] in (5, 3)} == {3}
    assert {r["component_id"] for r in got if r["fingerprint"] == 0} == {8}
    assert [r["component_id"] for r in got if r["doc_id"] is None and r["fingerprint"] != 0] == [None]
    assert op6_simhash.near_duplicates(df.limit(0)).count() == 0


def embed(spark, rows, kind="float"):
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int")


@pytest.mark.parametrize("block, dim", [(1024, 64), (8, 64), (1024, 16), (1024, 90)])
def test_embeddings_against_brute_force(spark, block, dim):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(60, dim))
    x = np.concatenate([centres, *[centres[:20] + rng.normal(scale=s, size=(20, dim)) for s in (0.05, 0.15, 0.3)], np.repeat(centres[:1], 10, axis=0), centres[:3] * 2]).astype(np.float32)
    order = rng.permutation(len(x))
    rows = [(int(order[i]), [float(v) for v in x[i]], 0) for i in range(len(x))]
    got = {r["vec_id"]: r for r in op8_embeddings.near_duplicates(embed(spark, rows), block=block).collect()}
    y = x.astype(np.float64)
    cos = (y @ y.T) / np.outer(np.linalg.norm(y, axis=1), np.linalg.norm(y, axis=1))
    linked = (cos >= 0.95) & ~np.eye(len(x), dtype=bool)
    want = {int(order[i]): int(linked[i].sum()) for i in range(len(x))}
    assert all(got[v]["n_links"] <= n for v, n in want.items())
    assert sum(r["n_links"] for r in got.values()) >= 0.9 * sum(want.values())
    if sum(r["n_links"] for r in got.values()) == sum(want.values()):
        roots = classes(len(x), np.argwhere(linked).tolist())
        least = {}
        for i, r in enumerate(roots):
            least[r] = min(least.get(r, 10**9), int(order[i]))
        assert all(got[int(order[i])]["component_id"] == least[r] for i, r in enumerate(roots))
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got.values())


def test_embedding_edges(spark):
    rows = [(1, [1.0, 0.0], 0), (2, [2.0, 0.0], 1), (3, None, 0), (4, [0.0, 0.0], 0), (5, [float("nan"), 1.0], 0), (6, [float("inf"), 1.0], 0), (7, [1.0, None], 0), (8, [], 0), (9, [1.0, 0.0, 0.0], 0), (2, [2.0, 0.0], 1), (None, [1.0, 0.0], 0)]
    got = op8_embeddings.near_duplicates(embed(spark, rows, "double")).collect()
    assert len(got) == len(rows)
    assert {(r["vec_id"], r["n_links"], r["component_id"]) for r in got if r["vec_id"] in (1, 2)} == {(1, 3, 1), (2, 3, 1)}
    assert all((r["n_links"], r["component_id"], r["kept"]) == (0, r["vec_id"], True) for r in got if r["vec_id"] in (3, 4, 5, 6, 7, 8, 9))
    assert [r["component_id"] for r in got if r["vec_id"] is None] == [1]
    assert op8_embeddings.near_duplicates(embed(spark, [])).count() == 0


def test_embedding_recall_on_the_table(spark, data):
    t = spark.read.parquet(f"{data}/embeddings.parquet")
    made = t.unionAll(t.select((F.col("vec_id") + 1_000_000).alias("vec_id"), F.transform("embedding", lambda v, i: (v + F.when(i % 7 == 0, 0.02).otherwise(0.0)).cast("float")).alias("embedding"), "label"))
    got = op8_embeddings.near_duplicates(made).agg(F.sum("n_links")).collect()[0][0]
    x = np.array([list(r["embedding"]) for r in made.collect()], dtype=np.float64)
    cos = (x @ x.T) / np.outer(np.linalg.norm(x, axis=1), np.linalg.norm(x, axis=1))
    want = int((cos >= 0.95).sum()) - len(x)
    assert want > 0 and 0.9 * want <= got <= want


def partners(rng, n, dim, mean, cosine):
    """Unit vectors with that cosine to each other in the mean, and one more for each at `cosine` to it."""
    common = np.zeros(dim)
    common[0] = 1
    unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    x = unit(np.sqrt(mean) * common + np.sqrt(1 - mean) * unit(rng.normal(size=(n, dim))))
    aside = rng.normal(size=(n, dim))
    aside = unit(aside - (aside * x).sum(axis=1, keepdims=True) * x)
    return np.concatenate((x, cosine * x + np.sqrt(1 - cosine**2) * aside))


@pytest.mark.parametrize("mean", [0.0, 0.7, 0.85])
def test_embedding_recall_with_a_common_direction(mean):
    """The codes alone: of pairs just above the threshold nine in ten and more meet, whatever the vectors
    have in common, and far fewer than all pairs do."""
    rng = np.random.default_rng(11)
    n, dim = 3000, 64
    x = partners(rng, n, dim, mean, 0.952)
    coder = op8_embeddings.Coder(dim, 2 * n, 0.95, x[rng.permutation(2 * n)[:2000]])
    values, known = coder.code(x)
    known = known.view(np.uint64)
    met = lambda a, b: ((np.bitwise_count(values[a] ^ values[b]) <= 1).any(axis=1)) & (np.bitwise_count(known[a] ^ known[b]) <= coder.reach)
    assert met(np.arange(n), np.arange(n, 2 * n)).mean() >= 0.93
    a, b = rng.integers(0, 2 * n, (2, 100_000))
    assert met(a, b)[a != b].mean() < (0.05 if mean < 0.8 else 0.4)


@pytest.mark.parametrize("dim", [64, 384])
@pytest.mark.parametrize("mean", [0.9, 0.92, 0.94, 0.97])
def test_embedding_recall_in_tight_clouds(mean, dim):
    rng = np.random.default_rng(12)
    n = 1500
    x = partners(rng, n, dim, mean, 0.952)
    coder = op8_embeddings.Coder(dim, 2 * n, 0.95, x[rng.permutation(2 * n)[:1500]])
    values, known = coder.code(x)
    known = known.view(np.uint64)
    near = (np.bitwise_count(values[:n] ^ values[n:]) <= 1).any(axis=1) & (np.bitwise_count(known[:n] ^ known[n:]) <= coder.reach)
    assert near.mean() >= 0.9


def test_links_of_a_tight_cloud_and_of_rare_lengths(spark):
    rng = np.random.default_rng(13)
    x = partners(rng, 60, 64, 0.94, 0.952)
    rows = [(i, [float(v) for v in e], 0) for i, e in enumerate(x)]
    cos = (x @ x.T) / np.outer(np.linalg.norm(x, axis=1), np.linalg.norm(x, axis=1))
    got = op8_embeddings.near_duplicates(embed(spark, rows, "double"), block=32, hot=64).agg(F.sum("n_links")).collect()[0][0]
    assert got == int((cos >= 0.95).sum()) - len(x) > 0
    # lengths beyond those that are learned
    vectors = [(100 * d + k, [float(v) for v in e], 0) for d in range(20, 20 + op8_embeddings.LENGTHS + 2) for k, e in enumerate(partners(rng, 8, d, 0.9, 0.97))]
    found = {r["vec_id"]: r["n_links"] for r in op8_embeddings.near_duplicates(embed(spark, vectors, "double")).collect()}
    pairs = total = 0
    for d in range(20, 20 + op8_embeddings.LENGTHS + 2):
        own = [v for v in vectors if v[0] // 100 == d]
        y = np.array([v[1] for v in own])
        c = (y @ y.T) / np.outer(np.linalg.norm(y, axis=1), np.linalg.norm(y, axis=1))
        pairs, total = pairs + sum(found[v[0]] for v in own), total + int((c >= 0.95).sum()) - len(own)
    assert 0.9 * total <= pairs <= total


def test_shapes_grow_with_the_table():
    bits = [op8_embeddings.shape(n, 0.1)[0] for n in (10**3, 10**5, 10**7, 10**9)]
    assert bits == sorted(set(bits))
    work = [t * (b + 1) * (1 + n / 2**b) for n in (10**5, 10**9) for b, t in [op8_embeddings.shape(n, 0.1)]]
    assert work[1] < 20 * work[0]  # a vector's lookups, for ten thousand times the vectors


def test_large_buckets_give_the_same(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([c + rng.normal(scale=0.03, size=(150, 16)) for c in rng.normal(size=(3, 16))])
    rows = [(i, [float(v) for v in e], 0) for i, e in enumerate(x)]
    got = [sorted(map(tuple, op8_embeddings.near_duplicates(embed(spark, rows, "double"), hot=hot, block=block).collect())) for hot, block in ((10**9, 1024), (16, 20))]
    cos = (x @ x.T) / np.outer(np.linalg.norm(x, axis=1), np.linalg.norm(x, axis=1))
    want = int((cos >= 0.95).sum()) - len(x)
    assert got[0] == got[1] and 0.98 * want <= sum(r[1] for r in got[0]) <= want
