"""The language model, the prefix trie and hard negatives against plain Python, edge cases included."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from infratrace.llm import op11_pitman_yor as lm
from infratrace.llm import op12_prefix_trie as trie
from infratrace.llm import op13_hard_negatives as hard

# -- language model -----------------------------------------------------------------------------


def plain_scores(rows, sweeps=lm.SWEEPS):
    """The model with dictionaries: one restaurant for each context, all in one place."""
    h = lambda w: xxhash.xxh64_intdigest(w)
    docs = {i: [*(t or "").encode().lower().split(), b""] for i, t in rows}
    train = [w for i, w in docs.items() if i is None or zlib.crc32(str(i).encode()) % 10]
    n, c = Counter(), Counter()
    for w in train:
        n.update(w)
        c.update(zip([b"", *w[:-1]], w))
    u64 = lambda x: np.array(x, dtype=np.uint64)
    discount = lambda counts: lm._discount(sum(x == 1 for x in counts), sum(x == 2 for x in counts))
    d = discount(c.values())
    dishes = sorted({w for _, w in c})
    tables = {p: 1 for p in c}
    states = []
    for r in range(sweeps + 1):
        if r:
            before, below, k, t = states[-1]
            a = np.array([(lm.THETA + d * below[u]) * before.root(np.array(k[w]), np.array(t[w])) for u, w in c])
            keys = lm.mixed(u64([h(u) for u, _ in c]) ^ lm.mixed(u64([h(w) for _, w in c])))
            tables = dict(zip(c, lm.tables(np.array(list(c.values())), a, d, keys, r).tolist())) if c else {}
        below, k = Counter(), Counter()
        for (u, w), x in tables.items():
            below[u] += x
            k[w] += x
        d0 = discount(k.values()) if not r else d0
        t = {w: 1 for w in dishes} if not r else dict(zip(dishes, lm.tables(np.array([k[w] for w in dishes]), np.full(len(dishes), states[-1][0].base()), d0, u64([h(w) for w in dishes]), r).tolist()))
        states.append((lm.State(sum(n.values()), len(n), sum(k.values()), sum(t.values()), d, d0), below, k, Counter(t)))
        drawn = [*drawn, tables] if r else []
    out = {}
    for i, words in docs.items():
        total = base = 0.0
        for u, w in zip([b"", *words[:-1]], words):
            p = 0.0
            for (s, below, k, t), seated in zip(states[1:], drawn):
                p += (max(c[u, w] - d * seated.get((u, w), 0), 0) + (lm.THETA + d * below[u]) * s.root(np.array(k[w]), np.array(t[w]))) / (lm.THETA + n[u])
            total += math.log10(p / sweeps)
            base += math.log10((n[w] + 0.1) / (sum(n.values()) + 0.1 * (len(n) + 1)))
        out[i] = (len(words), sum(n[w] > 0 for w in words), sum(n.values()), base, total)
    return out


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(2)
    words = [f"w{k}" for k in range(40)]
    rows = [(i, " ".join(rng.choice(words[: 5 + i % 35]) for _ in range(rng.randint(0, 60)))) for i in range(120)]
    hot = "is on " * 300
    return rows + [(500 + i, hot) for i in range(20)] + [(900, None), (901, ""), (902, " \n\x0b\t"), (903, "Ünique W1\x85W1 w1"), (904, "long " * 5000), (-7, "w1 W2 é漢")]


def test_scores_are_those_of_one_process(spark, texts):
    docs = spark.createDataFrame(texts, "doc_id long, text string").withColumn("batch", F.lit("mine")).repartition(3)
    got = {r["doc_id"]: r for r in lm.scores(docs, batch=400, parts=5).collect()}
    want = plain_scores(texts)
    assert set(got) == set(want)
    for i, (n, known, total, base, score) in want.items():
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (n, known, total) and r["held_out"] == (zlib.crc32(str(i).encode()) % 10 == 0)
        assert abs(r["base_score"] - base) < 1e-9 * max(1, abs(base)) and abs(r["score"] - score) < 1e-9 * max(1, abs(score)), i
    held = [r for r in got.values() if r["held_out"] and r["n_known"] == r["n_tokens"]]
    assert held and sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    other = {r["doc_id"]: r["score"] for r in lm.scores(docs.repartition(2), batch=100_000, parts=2).collect()}
    assert all(abs(other[i] - r["score"]) < 1e-9 * max(1, abs(r["score"])) for i, r in got.items())  # however it is dealt


def test_tables_follow_the_seating(spark):
    rng = np.random.default_rng(1)
    for c, d, a in ((3, 0.5, 0.7), (6, 0.8, 2.0), (9, 0.3, 0.05)):
        # all ways to seat c customers one after the other, by their number of tables
        ways = {1: 1.0}
        for n in range(1, c):
            ways = {t: ways.get(t, 0) * (n - d * t) + ways.get(t - 1, 0) for t in range(1, n + 2)}
        exact = np.array([ways[t] * a**t for t in range(1, c + 1)])
        drawn = lm.tables(np.full(40_000, c), np.full(40_000, a), d, rng.integers(0, 1 << 62, 40_000).astype(np.uint64), 1)
        share = np.bincount(drawn, minlength=c + 1)[1:] / len(drawn)
        assert np.abs(share - exact / exact.sum()).max() < 0.01
    many = lm.tables(np.array([10**9, 5000, 1, 0]), np.array([50.0, 1e-9, 1.0, 1.0]), 0.7, np.arange(4, dtype=np.uint64), 1)
    assert 50 < many[0] < 5000 and many[1] == 1 and many[2:].tolist() == [1, 0]


def test_model_without_rows_or_training(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert lm.scores(empty).count() == 0
    held = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 10 == 0)
    got = lm.scores(spark.createDataFrame([(held, "a b"), (held, "a b")], "doc_id long, text string")).collect()
    assert len(got) == 2 and all(r["train_tokens"] == r["n_known"] == 0 and abs(r["score"]) < 1e-9 for r in got)
    null = lm.scores(spark.createDataFrame([(None, "a b"), (None, None)], "doc_id long, text string")).collect()
    assert [r["held_out"] for r in null] == [False, False] and {r["doc_id"] for r in null} == {None}


# -- prefix trie --------------------------------------------------------------------------------


def plain_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    made = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        made[c] = own.get(c - int(math.fmod(c, 5)), [])[:h] + turns[h:]
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in made.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    kids = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1].encode()) if p else 0
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), kids[p], leaves[p], saved[p], hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()) for p, m in members.items())


TURNS = "conv_id long, turn long, role string, text string"


def told(nodes):
    return sorted((r["conv_id"], r["depth"], -1 if r["parent_conv_id"] is None else r["parent_conv_id"], *(r[c] for c in trie.RESULT[3:])) for r in nodes.collect())


@pytest.fixture(scope="module")
def turns():
    rng = random.Random(6)
    rows = []
    for c in [*range(200), -3, -10]:
        for t in range(rng.randint(0, 7)):
            rows.append((c, t, rng.choice(["user", "assistant", None]), rng.choice(["a", "é" * 9, "", None, "long " * 50, f"own {c}"])))
    for c in range(1000, 1400):  # one conversation that many share, longer than any head
        rows += [(c, t, "user", f"same {t}") for t in range(14)]
    rows += [(1, None, "user", "first"), (1, None, "system", "first"), (2, 0, "user", "tie"), (2, 0, "user", "tie"), (2, 0, "assistant", "tie"), (None, 1, "user", "nobody")]
    return rows


def test_trie_is_the_plain_one(spark, turns):
    df = spark.createDataFrame(turns, TURNS).withColumn("path", F.lit(1)).withColumn("kind", F.lit("x")).repartition(4)
    paths = trie.rebuilt(trie.keyed(df))
    want = plain_trie(turns)
    assert told(trie.prefix_trie(paths)) == want
    # splitters all over, and such as end early: most nodes in the skeleton, or hardly any
    assert told(trie.prefix_trie(paths, tasks=12)) == want
    assert told(trie.prefix_trie(paths, tasks=5, split_turns=2)) == want


def test_trie_of_little(spark):
    assert trie.prefix_trie(trie.rebuilt(trie.keyed(spark.createDataFrame([], TURNS)))).count() == 0
    one = [(7, 0, None, None)]
    assert told(trie.prefix_trie(trie.rebuilt(trie.keyed(spark.createDataFrame(one, TURNS))))) == plain_trie(one)


def test_pieces_of_ids_are_hashed_in_order(spark):
    paths = spark.createDataFrame([(c, b"k" * 16, [3]) for c in range(5000)], "conv_id long, path binary, sizes array<long>")
    got = {r["depth"]: r for r in trie.prefix_trie(paths, tasks=7).collect()}
    assert got[1]["ends_sha256"] == hashlib.sha256(",".join(map(str, range(5000))).encode()).hexdigest()
    assert (got[0]["n_convs"], got[0]["n_children"], got[0]["saved_tokens"]) == (5000, 1, 4999 * 3)


# -- hard negatives -----------------------------------------------------------------------------


def plain_negatives(rows, every):
    good = []
    for nth, (v, e, label) in enumerate(rows):
        if label is not None and e is not None and all(x is not None and math.isfinite(x) for x in e):
            good.append((v, nth, [math.floor(256 * x) if abs(x) < 2**52 else 256 * int(x) for x in e], label))
    order = lambda s, x: (-s, x[0] is None, x[0] or 0, x[1])
    out = []
    for a in good:
        if a[0] is None or a[0] % every:
            continue
        scored = [(sum(p * q for p, q in zip(a[2], b[2])), b) for b in good if len(b[2]) == len(a[2]) and b[1] != a[1]]
        liked = sorted((x for x in scored if x[1][3] == a[3]), key=lambda x: order(*x))[:5]
        for ps, p in liked:
            window = sorted((x for x in scored if x[1][3] != a[3] and 30 * ps <= 100 * x[0] <= 90 * ps), key=lambda x: order(*x))[:10]
            out += [(a[0], p[0], k, n[0], ps, ns) for k, (ns, n) in enumerate(window, 1)]
    return sorted(out, key=repr)


VECTORS = "vec_id long, embedding array<double>, label int"


def test_hard_negatives_are_all_found(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(6, 12))
    rows = [(i, [float(x) for x in centres[i % 6] + rng.normal(scale=0.7, size=12)], int(rng.integers(0, 4))) for i in range(300)]
    rows += [(1000 + i, rows[20][1], i % 2) for i in range(60)] + [(20, rows[20][1], rows[20][2])]  # copies, and a repeated row
    rows += [(2000, None, 1), (2001, rows[1][1], None), (2002, [float("nan")] * 12, 1), (2003, [None] * 12, 1), (2004, [float("inf")] * 12, 1), (None, rows[3][1], 2), (None, rows[3][1], 3)]
    rows += [(2010 + i, [], i % 2) for i in range(4)] + [(2020 + 10 * i, [1.0 + i, 2.0, -1.0], i % 2) for i in range(8)] + [(2200 + 10 * i, [5e5 * (i + 1)] * 12, i % 2) for i in range(4)]
    df = spark.createDataFrame(rows, VECTORS).withColumn("w", F.lit(1)).coalesce(1)
    want = plain_negatives(rows, 10)
    assert len(want) > 1000
    run = lambda **k: sorted((tuple(r) for r in hard.hard_negatives(df, F.col("vec_id") % 10 == 0, **k).collect()), key=repr)
    assert run() == want
    # few rows at first, small cells, blocks and tiles: windows are certified in the second round
    assert run(cell_rows=8, first=16, block=32, tile=7) == want


def test_hard_negatives_of_little(spark):
    none = spark.createDataFrame([], VECTORS)
    assert hard.hard_negatives(none, F.col("vec_id") % 10 == 0).count() == 0
    lone = spark.createDataFrame([(10, [1.0], 1), (11, [1.0], 2)], VECTORS)
    assert hard.hard_negatives(lone, F.col("vec_id") % 10 == 0).count() == 0  # no positive
    big = spark.createDataFrame([(10, [1e300], 1), (11, [1e300], 1)], VECTORS)
    with pytest.raises(Exception, match="OverflowError"):
        hard.hard_negatives(big, F.col("vec_id") % 10 == 0).count()


def test_cells_come_in_falling_order_of_bounds(spark):
    rng = np.random.default_rng(7)
    x = np.round(rng.normal(size=(500, 10)) * 256)
    index = hard.Index({10: (hard.codebook(x[:, :5], 6, rng), hard.codebook(x[:, 5:], 5, rng))})
    i, d, j, f = index.place(10, x)
    index.radii[10] = tuple(np.array([far[code == k].max(initial=-1.0) for k in range(n)]) for code, far, n in ((i, d, 6), (j, f, 5)))
    index.rows[10] = {(int(p), int(q)): 0 for p, q in zip(i, j)}
    for p, q in zip(i, j):
        index.rows[10][int(p), int(q)] += 1
    a = x[0]
    seen = list(index.visits(10, a))
    assert sum(s[3] for s in seen) == 500 and len({s[1:3] for s in seen}) == len(seen)
    assert all(one[0] >= two[0] for one, two in zip(seen, seen[1:]))
    for bound, p, q, _ in seen:
        assert (x[(i == p) & (j == q)] @ a).max() <= bound
