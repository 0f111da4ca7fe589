"""Language-model scores by a hierarchical Pitman-Yor model with sampled seating.

Every previous word (or the start of a text) is a restaurant, the next word a dish; all of these
restaurants share the root, whose base is even over the words known and one unknown:

    P(w | u) = (c_uw - d t_uw + (theta + d T_u) P(w)) / (theta + c_u)
    P(w)     = (K_w - d0 t_w + (theta0 + d0 T) / (V + 1)) / (theta0 + K)

c are customers, t tables, T_u = sum of t_uw; the root's customers are the tables below it, K_w = sum of
t_uw. A Gibbs round draws the tables of every dish given its restaurant's and the root's state of the round
before: for up to EXACT customers from the conditional p(t) ~ S_d(c, t) a^t with a = (theta + d T_u) P(w)
(generalised Stirling numbers sum the seatings of c customers at t tables), for more the rest is seated after
these in blocks of an eighth. Dishes of a round are drawn at once, as in other distributed samplers.
The first state has one table a dish. Predictive probabilities are averaged over the rounds. Discounts
come from the corpus: n1 / (n1 + 2 n2), of pairs and of the root's dishes.

Documents are read once into batches of BATCH tokens: numbers of words, each different word by its XXH64.
A batch sends every different pair once to the pair's part, which answers with the corpus count and marks
one of the batches as the one that counts the pair's tables; then every round it sends the tables of
its words to the words' parts and gets the sums. Batches stay where they are (a table bucketed by batch),
only these messages move. A pair or word that is in every document is one entry of each batch, so no part
depends on how often anything occurs. Random numbers are functions of pair, word and round: a task that is
run again draws the same, and batches that share a pair agree without asking.

Nothing is cut off: all pairs of all documents are counted. Two of n different words share a hash with
chance n * n / 2**65. Null texts are empty (one end token). A null doc_id trains. Repeated rows are documents
of their own. Without training tokens every text has probability 1. An empty table gives an empty result.
Other columns are left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, discard, shared_path, stash, table

FOLDS, HELD_OUT = 10, 0
#: The weight of every word in the unigram base score.
ADDED = 0.1
#: Strengths, least and largest discount, Gibbs rounds.
THETA, THETA_ROOT, DISCOUNTS, SWEEPS = 1.0, 1.0, (0.05, 0.95), 2
#: Customers up to which tables are drawn from the exact conditional.
EXACT = 48
#: Tokens of a batch, but for its last document.
BATCH = 1_000_000
GOLDEN = np.uint64(0x9E3779B97F4A7C15)

MESSAGE = "batch long, part int, data binary, sums array<double>"
COLUMNS = ["batch", "part", "data", "sums"]


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


# -- arrays as bytes ----------------------------------------------------------------------------

def pack(*arrays: np.ndarray) -> bytes:
    """Arrays in one compressed value; whole numbers in as few bytes as their largest needs."""
    out = []
    for x in arrays:
        if x.dtype.kind in "iub":
            x = x.astype(np.min_scalar_type(int(x.max()) if len(x) else 0)) if not len(x) or x.min() >= 0 else x
        out.append(x.dtype.str.encode() + b" %d\n" % len(x) + x.tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(out))


def unpack(data: bytes) -> list[np.ndarray]:
    data, at, out = zstandard.ZstdDecompressor().decompress(data), 0, []
    while at < len(data):
        end = data.index(b"\n", at)
        kind, n = data[at:end].split()
        out.append(np.frombuffer(data, kind.decode(), int(n), end + 1))
        at = end + 1 + out[-1].nbytes
    return out


def mixed(x: np.ndarray) -> np.ndarray:
    """A well-mixed 64-bit value of each (the finaliser of splitmix64, fixed values)."""
    x = x + GOLDEN
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def uniform(keys: np.ndarray, draw: int) -> np.ndarray:
    """A number in (0, 1) for each key."""
    return (mixed(keys ^ mixed(np.array([draw], dtype=np.uint64))) >> np.uint64(11)) * 2.0**-53 + 2.0**-54


# -- seating ------------------------------------------------------------------------------------

def log_stirling(d: float, most: int = EXACT) -> np.ndarray:
    """log S_d(c, t) for c, t up to `most`."""
    s = np.full((most + 1, most + 1), -np.inf)
    s[1, 1] = 0.0
    t = np.arange(most + 1)
    for c in range(1, most):
        with np.errstate(divide="ignore", invalid="ignore"):
            stay = s[c] + np.log(np.maximum(c - d * t, 0))
        s[c + 1] = np.logaddexp(stay, np.concatenate(([-np.inf], s[c, :-1])))
    return s


def tables(c: np.ndarray, a: np.ndarray, d: float, keys: np.ndarray, draw: int, exact: int = EXACT) -> np.ndarray:
    """Tables of dishes with c customers whose new tables weigh a."""
    t = np.minimum(c, 1).astype(np.int64)
    many = np.flatnonzero(c > 1)
    if not len(many):
        return t
    s, u = log_stirling(d, exact), uniform(keys[many], 16 * draw)
    size, log_a = np.minimum(c[many], exact), np.log(np.maximum(a[many], 1e-300))
    order = np.argsort(size, kind="stable")
    ends = np.flatnonzero(np.diff(size[order], append=exact + 1))
    start = 0
    for end in ends + 1:
        n = int(size[order[start]])
        for k in range(start, end, 1 << 16):
            own = order[k:min(k + (1 << 16), end)]
            w = s[n, 1:n + 1][None] + log_a[own][:, None] * np.arange(1, n + 1)
            w = np.exp(w - w.max(axis=1, keepdims=True)).cumsum(axis=1)
            t[many[own]] = 1 + (w < (u[own] * w[:, -1])[:, None]).sum(axis=1)
        start = end
    live, seated, step = many[c[many] > exact], float(exact), 1
    while len(live):  # all dishes seat the same number so far
        m = np.minimum(c[live] - seated, max(1.0, seated // 8))
        p = a[live] / (a[live] + seated + m / 2 - d * t[live])
        one, two = uniform(keys[live], 16 * draw + 1 + 4096 * step), uniform(keys[live], 16 * draw + 2 + 4096 * step)
        normal = np.sqrt(-2 * np.log(one)) * np.cos(2 * math.pi * two)
        new = np.floor(m * p + np.sqrt(m * p * (1 - p)) * normal + uniform(keys[live], 16 * draw + 3 + 4096 * step))
        t[live] += np.clip(new, 0, m).astype(np.int64)
        seated += max(1.0, seated // 8)
        live, step = live[c[live] > seated], step + 1
    return t


class State:
    """Numbers of a round that hold for the whole corpus."""

    def __init__(self, tokens: float, words: float, customers: float, root_tables: float, d: float, d0: float):
        self.tokens, self.words, self.customers, self.root_tables, self.d, self.d0 = tokens, words, customers, root_tables, d, d0

    def base(self) -> float:
        return (THETA_ROOT + self.d0 * self.root_tables) / (self.words + 1)

    def root(self, k: np.ndarray, t: np.ndarray) -> np.ndarray:
        return (k - self.d0 * t + self.base()) / (THETA_ROOT + self.customers)


# -- batches ------------------------------------------------------------------------------------

class Numbers(dict):
    """Words to numbers from 1, in order of their first use; 0 is the end of a text, and its start."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self) + 1
        return n


class Batch:
    """Documents of a batch: ids, lengths and the numbers of their tokens; hashes of words."""

    def __init__(self, ids, null, held, lengths, tokens, words):
        self.ids, self.null, self.held, self.lengths, self.words = ids, null, held, lengths, words
        self.tokens = tokens.astype(np.uint64)
        self.trains = np.repeat(~held.astype(bool), lengths)

    def pairs(self, inverse: bool = False):
        """The different pairs (context << 32 | word) in order and, for each token, its pair."""
        each = self.tokens.copy()
        each[1:] |= self.tokens[:-1] << np.uint64(32)
        if inverse:
            return np.unique(each, return_inverse=True)
        each.sort()  # sooner done than by np.unique, which hashes first
        return each[np.concatenate((np.ones(1, bool), each[1:] != each[:-1]))]

    def keys(self, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each pair its key, and the numbers of context and word."""
        u, w = (pairs >> np.uint64(32)).astype(np.int64), (pairs & np.uint64(0xFFFFFFFF)).astype(np.int64)
        return mixed(self.words[u] ^ mixed(self.words[w])), u, w


def make_batches(limit: int):
    """Documents (doc_id, held, text) to batches."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        task, made = TaskContext.get().partitionId(), 0
        ids, held, lengths, pieces, numbers, size = [], [], [], [], Numbers(), 0

        def done() -> pd.DataFrame:
            nonlocal ids, held, lengths, pieces, numbers, size, made
            words = np.array([xxhash.xxh64_intdigest(b"")] + [xxhash.xxh64_intdigest(w) for w in numbers], dtype=np.uint64)
            null = np.array([i is None for i in ids])
            data = pack(np.array([i or 0 for i in ids], dtype=np.int64), null, np.array(held, dtype=bool), np.array(lengths, dtype=np.int64), np.concatenate(pieces), words)
            rows = [(task << 24 | made, None, data, None)]
            ids, held, lengths, pieces, numbers, size, made = [], [], [], [], Numbers(), 0, made + 1
            return _rows(rows)

        for frame in frames:
            for i, h, text in zip(frame["doc_id"].astype(object), frame["held"], frame["text"]):
                tokens = text.encode().lower().split() if text else []
                piece = np.zeros(len(tokens) + 1, dtype=np.uint32)
                piece[:-1] = np.fromiter(map(numbers.__getitem__, tokens), np.uint32, len(tokens))
                ids.append(None if pd.isna(i) else int(i))
                held.append(h)
                lengths.append(len(piece))
                pieces.append(piece)
                size += len(piece)
                if size >= limit:
                    yield done()
        if ids:
            yield done()

    return run


def by_part(keys: np.ndarray, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    """The places of the keys of each part, in order."""
    part = (keys % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    cuts = np.searchsorted(part[order], np.arange(parts + 1))
    for p in range(parts):
        if cuts[p] < cuts[p + 1]:
            yield p, order[cuts[p]:cuts[p + 1]]


def gathered(answers: pd.DataFrame, keys: np.ndarray, parts: int) -> list[np.ndarray]:
    """Arrays in the keys' order from the answers of their parts."""
    told = {int(p): unpack(d) for p, d in zip(answers["part"], answers["data"])}
    out: list[np.ndarray] = []
    for p, own in by_part(keys, parts):
        for k, x in enumerate(told[p]):
            if len(out) <= k:
                out.append(np.zeros(len(keys), dtype=np.int64))
            out[k][own] = x[:len(own)]
    return out


def _rows(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=COLUMNS).astype({"batch": "Int64", "part": "Int32"})


def pair_messages(parts: int):
    """Each batch's different pairs, with their training tokens, to the pairs' parts."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, data in zip(frame["batch"], frame["data"]):
                batch = Batch(*unpack(data))
                pairs, of = batch.pairs(inverse=True)
                counts = np.bincount(of[batch.trains], minlength=len(pairs))
                keys = batch.keys(pairs)[0]
                yield _rows([(name, part, pack(keys[own], counts[own]), None) for part, own in by_part(keys, parts)])

    return run


def count_pairs(key: tuple, messages: pd.DataFrame) -> pd.DataFrame:
    """Each pair's customers in the corpus, and whether this batch counts its tables; sums: pairs with one and
    with two customers."""
    sent = [unpack(d) for d in messages["data"]]
    keys = np.concatenate([x[0] for x in sent]).astype(np.uint64)
    _, first, of = np.unique(keys, return_index=True, return_inverse=True)
    c = np.bincount(of, weights=np.concatenate([x[1] for x in sent])).astype(np.int64)
    own = np.zeros(len(keys), dtype=np.uint8)
    own[first] = 1
    rows, at = [(None, key[0], None, [float((c == 1).sum()), float((c == 2).sum())])], 0
    for batch, x in zip(messages["batch"], sent):
        n = len(x[0])
        rows.append((batch, key[0], pack(c[of[at:at + n]], own[at:at + n]), None))
        at += n
    return _rows(rows)


def word_messages(name: int, batch: Batch, u: np.ndarray, w: np.ndarray, t: np.ndarray, parts: int) -> list[tuple]:
    """A batch's training tokens and tables, by context and by dish, to the words' parts."""
    size = len(batch.words)
    n = np.bincount(batch.tokens[batch.trains].astype(np.int64), minlength=size)
    below, above = (np.bincount(x, weights=t, minlength=size).astype(np.int64) for x in (u, w))
    return [(name, part, pack(batch.words[own], n[own], below[own], above[own]), None) for part, own in by_part(batch.words, parts)]


def with_pairs(parts: int):
    """A batch and, in a row of its own (part -1), its pairs' customers and which it counts."""
    def run(key: tuple, own: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        if not len(own):
            return _rows([])
        batch = Batch(*unpack(own["data"].iloc[0]))
        c, mine = gathered(answers, batch.keys(batch.pairs())[0], parts)
        return _rows([(key[0], None, own["data"].iloc[0], None), (key[0], -1, pack(c, mine), None)])

    return run


def first_words(parts: int):
    """A batch's words with one table a dish."""
    def run(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        batch, (c, mine) = _stored(own)
        _, u, w = batch.keys(batch.pairs())
        return _rows(word_messages(key[0], batch, u, w, np.minimum(c, 1) * mine, parts))

    return run


def add_words(draw: int, state: State | None):
    """Sums of each word's tokens, tables as context and customers at the root, and its tables there; sums:
    tokens, words, customers and tables of the root, dishes of the root with one and with two customers."""
    def run(key: tuple, messages: pd.DataFrame) -> pd.DataFrame:
        sent = [unpack(d) for d in messages["data"]]
        words = np.concatenate([x[0] for x in sent]).astype(np.uint64)
        names, first, of = np.unique(words, return_index=True, return_inverse=True)
        n, below, k = (np.bincount(of, weights=np.concatenate([x[i] for x in sent])).astype(np.int64) for i in (1, 2, 3))
        t = np.minimum(k, 1) if state is None else tables(k, np.full(len(k), state.base()), state.d0, names, draw)
        rows, at = [(None, key[0], None, [float(x) for x in (n.sum(), (n > 0).sum(), k.sum(), t.sum(), (k == 1).sum(), (k == 2).sum())])], 0
        for batch, x in zip(messages["batch"], sent):
            own = of[at:at + len(x[0])]
            rows.append((batch, key[0], pack(n[own], below[own], k[own], t[own]), None))
            at += len(own)
        return _rows(rows)

    return run


def _dealt(batch: Batch, c: np.ndarray, pairs: np.ndarray, words: list[np.ndarray], state: State, draw: int) -> tuple[np.ndarray, ...]:
    """Tables of the batch's pairs in a round, given the words of the round before."""
    keys, u, w = batch.keys(pairs)
    _, below, k, t = words
    a = (THETA + state.d * below[u]) * state.root(k, t)[w]
    return tables(c, a, state.d, keys, draw), u, w


def sweep(parts: int, draw: int, state: State):
    """A Gibbs round of a batch's own pairs: tables by word."""
    def run(key: tuple, own: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        if not len(own):
            return _rows([])
        batch, (c, mine) = _stored(own)
        words = gathered(answers, batch.words, parts)
        pairs, mine = batch.pairs(), mine.astype(bool)
        t, u, w = _dealt(batch, c[mine].astype(np.int64), pairs[mine], words, state, draw)
        return _rows(word_messages(key[0], batch, u, w, t, parts))

    return run


def _stored(own: pd.DataFrame) -> tuple[Batch, list[np.ndarray]]:
    """The batch, and what is known of its pairs."""
    pairs = own["part"].notna()
    return Batch(*unpack(own["data"][~pairs].iloc[0])), unpack(own["data"][pairs].iloc[0])


RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score(parts: int, states: list[State]):
    """Scores of a batch's documents; states of the first state and of each round."""
    def run(key: tuple, own: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        if not len(own):
            return pd.DataFrame({c.split()[0]: [] for c in RESULT.split(", ")})
        batch, (c, _) = _stored(own)
        c = c.astype(np.int64)
        rounds = [gathered(answers[answers["round"] == r], batch.words, parts) for r in range(len(states))]
        pairs, of = batch.pairs(inverse=True)
        n, p = rounds[0][0], np.zeros(len(pairs))
        for r in range(1, len(states)):
            t, u, w = _dealt(batch, c, pairs, rounds[r - 1], states[r - 1], r)
            _, below, k, top = rounds[r]
            s = states[r]
            p += (np.maximum(c - s.d * t, 0) + (THETA + s.d * below[u]) * s.root(k, top)[w]) / (THETA + n[u])
        first = states[0]
        log_p = np.log10(p / (len(states) - 1))
        base = np.log10((n + ADDED) / (first.tokens + ADDED * (first.words + 1)))
        tokens = batch.tokens.astype(np.int64)
        starts = np.concatenate(([0], np.cumsum(batch.lengths)[:-1])).astype(np.int64)
        ids = pd.array(batch.ids, dtype="Int64")
        ids[batch.null.astype(bool)] = pd.NA
        return pd.DataFrame({
            "doc_id": ids, "held_out": batch.held.astype(bool), "n_tokens": batch.lengths.astype(np.int64), "n_known": np.add.reduceat((n > 0).astype(np.int64)[tokens], starts),
            "train_tokens": int(first.tokens), "base_score": np.add.reduceat(base[tokens], starts), "score": np.add.reduceat(log_p[of], starts),
        })

    return run


# -- the job ------------------------------------------------------------------------------------

def bucketed(df: DataFrame, name: str, buckets: int) -> DataFrame:
    """df as a table in the shared folder, bucketed by batch: later groups by batch do not move it."""
    path = shared_path(df.sparkSession, name)
    title = path.rsplit("/", 1)[1].replace("-", "_")
    df.write.bucketBy(buckets, "batch").option("path", path).saveAsTable(title)
    out = df.sparkSession.table(title)
    out._stashed, out._title = path, title
    return out


def _sums(df: DataFrame, n: int) -> list[float]:
    row = df.where("batch IS NULL").agg(*[F.coalesce(F.sum(F.col("sums")[i]), F.lit(0.0)).alias(f"s{i}") for i in range(n)]).first()
    return list(row)


def _discount(one: float, two: float) -> float:
    return min(max(one / (one + 2 * two), DISCOUNTS[0]), DISCOUNTS[1]) if one + two > 0 else DISCOUNTS[0]


def scores(docs: DataFrame, sweeps: int = SWEEPS, batch: int = BATCH, parts: int | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document."""
    spark = docs.sparkSession
    bound_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held"), "text")
    parts = parts or max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows.rdd.getNumPartitions())
    read = bucketed(rows.mapInPandas(make_batches(batch), MESSAGE), "batches", parts)
    counted = stash(read.mapInPandas(pair_messages(parts), MESSAGE).groupBy("part").applyInPandas(count_pairs, MESSAGE), "pairs")
    d = _discount(*_sums(counted, 2))
    kept = bucketed(_by_batch(read, counted, with_pairs(parts), MESSAGE), "state", parts)
    spark.sql(f"DROP TABLE {read._title}")
    discard(read, counted)
    words = [stash(kept.groupBy("batch").applyInPandas(first_words(parts), MESSAGE).groupBy("part").applyInPandas(add_words(0, None), MESSAGE), "words")]
    n, v, k, t, *few = _sums(words[0], 6)
    d0 = _discount(*few)
    states = [State(n, v, k, t, d, d0)]
    for r in range(1, sweeps + 1):
        sent = _by_batch(kept, words[-1], sweep(parts, r, states[-1]), MESSAGE)
        words.append(stash(sent.groupBy("part").applyInPandas(add_words(r, states[-1]), MESSAGE), "words"))
        _, _, k, t, *_ = _sums(words[-1], 6)
        states.append(State(n, v, k, t, d, d0))
    every = words[0].withColumn("round", F.lit(0))
    for r, df in enumerate(words[1:], 1):
        every = every.unionByName(df.withColumn("round", F.lit(r)))
    return _by_batch(kept, every, score(parts, states), RESULT)


def _by_batch(kept: DataFrame, answers: DataFrame, run, schema: str) -> DataFrame:
    return kept.groupBy("batch").cogroup(answers.where("batch IS NOT NULL").groupBy("batch")).applyInPandas(run, schema)


def op11_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(table(spark, sf_dir, "documents"))
