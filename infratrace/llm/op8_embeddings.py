"""Embedding near-duplicates by iterative quantisation and multi-index Hamming tables.

Vectors become binary codes: unit vectors are centred, turned to their principal directions and then by
rotations that are learned (on at most SAMPLE vectors, chosen by hash) so that signs lose least, which
balances the bits. A code is cut into `tables` substrings of `bits` bits, one for each table, and
every vector is filed once in each. A vector looks its substring up with every single bit turned
over too, so a pair is met in the first table whose substrings differ in one bit at most. Pairs whose
codes differ in far more bits than the threshold allows go no further; the rest are reranked with
the original vectors in double precision.

At the threshold's angle a bit differs with some chance, greater the nearer the vectors lie to their
common centre, and `shape` takes it from the sample. Of the shapes that miss a pair at the threshold
with chance MISS it takes that of the least work: substrings grow with the logarithm of the number
of vectors, so a bucket stays small and lookups grow little faster than the vectors. In a tight cloud, where
vectors are about as far from their centre as from each other at the threshold, a bit differs with a chance above
FLIP and codes tell too little: all vectors are one bucket then, compared whole in blocks, which finds every
pair and grows with the square.

Equal vectors meet in a count first, and only different ones are filed. A bucket that more than HOT
pairs look up is dealt to pairs of blocks of BLOCK vectors, so no task holds a bucket however large it
grows. A block pair is compared as a matrix and yields a sum of links for each vector and a
spanning forest of its links, never the pairs.

Vectors that are null, empty, zero or hold null or non-finite components link with nothing and stay.
Components of any size work: a vector is scaled by a power of two before its norm is taken. Vectors of
different lengths never link. Rotations are learned for the LENGTHS most frequent lengths; others get
random planes. A null vec_id is never a class id unless the class has no other. Repeated rows are
separate vectors that link. An empty table gives an empty result. Other columns are left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructType

from .common import bound_batches, connected_components, discard, source_order, stash, table

THRESHOLD = 0.95
#: Vectors to learn rotations from at most, rounds of learning, and lengths that are learned.
SAMPLE, ROUNDS, LENGTHS = 4096, 40, 16
#: Bits of one rotation at most; chance to miss a pair at the threshold; chance of a bit to differ above
#: which codes tell too little and all vectors are one bucket.
BITS, MISS, FLIP = 64, 0.02, 0.35
#: Pairs that look a bucket up above which it is compared in blocks, and vectors of a block.
HOT, BLOCK = 4096, 1024


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times the power of two that brings their largest component to about 1."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])


def unit(x: np.ndarray) -> np.ndarray:
    x = scaled(x)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def shape(n: int, flip: float, miss: float = MISS) -> tuple[int, int]:
    """(bits of a substring, tables) of the least work for n vectors, where a bit of a pair at the
    threshold differs with chance `flip`; above FLIP no bits and one table."""
    def work(bits: int) -> tuple[float, int, int]:
        hit = (1 - flip)**bits + bits * flip * (1 - flip)**(bits - 1)
        tables = max(1, math.ceil(math.log(miss) / math.log(1 - hit)))
        return tables * (bits + 1) * (1 + n / 2**bits), bits, tables

    return min(work(b) for b in range(6, 41))[1:] if flip <= FLIP else (0, 1)


class Coder:
    """Centre and projection whose signs are the code of a unit vector of one length."""

    def __init__(self, dim: int, n: int, threshold: float, x: np.ndarray | None = None, rounds: int = ROUNDS, seed: int = 5):
        rng = np.random.default_rng(seed)
        chord, spread = math.sqrt(2 - 2 * threshold), 1.0
        self.centre = np.zeros(dim)
        if x is not None:
            x = unit(x)
            self.centre = x.mean(axis=0)
            x = x - self.centre
            spread = float(np.quantile(np.linalg.norm(x, axis=1), 0.25))
        angle = 2 * math.asin(min(1.0, chord / 2 / max(spread, 1e-9)))
        self.flip = min(0.5, max(0.01, angle / math.pi))
        self.bits, self.tables = shape(n, self.flip)
        size, each = self.bits * self.tables, min(dim, BITS)
        if x is None or not size:
            self.projection = rng.normal(size=(dim, size))
        else:
            first = np.linalg.eigh(x.T @ x)[1][:, ::-1][:, :each]
            v = x @ first
            turned = []
            for _ in range(-(-size // each)):
                turn = np.linalg.qr(rng.normal(size=(each, each)))[0]
                for _ in range(rounds):
                    left, _, right = np.linalg.svd(np.where(v @ turn >= 0, 1.0, -1.0).T @ v)
                    turn = (left @ right).T
                turned.append(first @ turn)
            self.projection = np.concatenate(turned, axis=1)[:, :size]
        known = min(size, 64)
        self.reach = math.ceil(known * self.flip + 5 * math.sqrt(known * self.flip * (1 - self.flip)))

    def code(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The substrings of each unit vector, and the first 64 bits of its code."""
        signs = (x - self.centre) @ self.projection >= 0
        values = signs.reshape(len(x), self.tables, self.bits) @ (np.int64(1) << np.arange(self.bits, dtype=np.int64))
        first = np.zeros((len(x), 64), dtype=bool)
        first[:, :min(64, signs.shape[1])] = signs[:, :64]
        return values, np.packbits(first, axis=1, bitorder="little").view("<i8")[:, 0]


class Coders:
    """A coder for every length: learned ones, and random planes for the rest."""

    def __init__(self, learned: dict[int, Coder], n_rest: int, threshold: float):
        self.by_dim, self.n_rest, self.threshold = learned, n_rest, threshold

    def of(self, dim: int) -> Coder:
        return self.by_dim[dim] if dim in self.by_dim else Coder(dim, self.n_rest, self.threshold)


def learn(vectors: DataFrame, threshold: float, sample: int = SAMPLE, lengths: int = LENGTHS) -> Coders:
    """Coders for vectors (column e); what reaches the driver is `sample` vectors a learned length."""
    known = vectors.groupBy(F.size("e").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(lengths).collect()
    sizes = {r["dim"]: r["count"] for r in known}
    if not sizes:
        return Coders({}, 1, threshold)
    share = F.create_map(*[x for dim, n in sizes.items() for x in (F.lit(dim), F.lit(1.2 * sample / n))])
    draw = F.pmod(F.xxhash64("e"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    rows = vectors.where(draw < share[F.size("e")]).select("e").limit(2 * sample * len(sizes)).collect()
    drawn: dict[int, list] = {dim: [] for dim in sizes}
    for e in sorted(list(r["e"]) for r in rows):
        if len(drawn[len(e)]) < sample:
            drawn[len(e)].append(e)
    learned = {dim: Coder(dim, n, threshold, np.array(drawn[dim], dtype=np.float64) if drawn[dim] else None) for dim, n in sizes.items()}
    return Coders(learned, min(sizes.values()), threshold)


CODE = (StructType().add("dim", IntegerType()).add("bits", IntegerType()).add("reach", IntegerType()).add("known", LongType())
        .add("substrings", ArrayType(LongType())).add("x", ArrayType(DoubleType())).add("norm", DoubleType()))


def code_udf(coders: Coders):
    """e -> its code, its components scaled by a power of two, and their norm."""
    @F.pandas_udf(CODE)
    def codes(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for vectors in batches:
            dims = np.array([len(v) for v in vectors], dtype=np.int64)
            out: list[tuple] = [()] * len(vectors)
            for dim in np.unique(dims):
                own, coder = np.flatnonzero(dims == dim), coders.of(int(dim))
                x = scaled(np.stack([np.asarray(vectors.iloc[i], dtype=np.float64) for i in own]))
                norm = np.linalg.norm(x, axis=1)
                values, known = coder.code(x / norm[:, None])
                for k, i in enumerate(own):
                    out[i] = (int(dim), coder.bits, coder.reach, int(known[k]), values[k], x[k], float(norm[k]))
            yield pd.DataFrame(out, columns=CODE.names)

    return codes


def compare(threshold: float):
    """Links within a block pair: (a, null, links of a) and forest edges (a, b, null)."""
    def work(key, batch: pd.DataFrame) -> pd.DataFrame:
        t = key[1]
        looks = batch["looks"].to_numpy()
        left, right = np.flatnonzero(looks), np.flatnonzero(~looks)
        none = pd.DataFrame({"a": pd.array([], dtype="Int64"), "b": pd.array([], dtype="Int64"), "n": pd.array([], dtype="Int64")})
        if not len(left) or not len(right):
            return none
        ids, copies, norm = batch["rep"].to_numpy(), batch["copies"].to_numpy(), batch["norm"].to_numpy()
        x, code = np.stack(batch["x"].to_numpy()), np.stack(batch["substrings"].to_numpy())
        near = (x[left] @ x[right].T) / (norm[left][:, None] * norm[right][None]) >= threshold
        near &= ids[left][:, None] < ids[right][None]
        i, j = np.nonzero(near)
        met = (np.bitwise_count(code[left[i], :t] ^ code[right[j], :t]) <= 1).any(axis=1)  # in an earlier table
        i, j = i[~met], j[~met]
        if not len(i):
            return none
        n = np.zeros(len(batch), dtype=np.int64)
        np.add.at(n, left[i], copies[right[j]])
        np.add.at(n, right[j], copies[left[i]])
        # a vector that looks up and is filed here is two rows of one id
        _, node = np.unique(ids, return_inverse=True)
        name = np.zeros(node.max() + 1, dtype=np.int64)
        name[node] = ids
        label, a, b = np.arange(len(name)), node[left[i]], node[right[j]]
        while True:  # smallest place reachable
            new = label.copy()
            np.minimum.at(new, a, label[b])
            np.minimum.at(new, b, label[a])
            new = new[new]
            if (new == label).all():
                break
            label = new
        some, joined = np.flatnonzero(n), np.flatnonzero(label != np.arange(len(label)))
        return pd.DataFrame({
            "a": pd.array(np.concatenate((ids[some], name[joined])), dtype="Int64"),
            "b": pd.array([*[None] * len(some), *name[label[joined]]], dtype="Int64"),
            "n": pd.array([*n[some], *[None] * len(joined)], dtype="Int64"),
        })

    return work


def _around(value: Column, bits: Column) -> Column:
    """A substring, and with each of its bits turned over."""
    return F.transform(F.sequence(F.lit(0), bits), lambda i: F.when(i == 0, value).otherwise(value.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i - 1))))


def _cosine() -> Column:
    dot = F.aggregate(F.zip_with("xa", "xb", lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    return dot / (F.col("na") * F.col("nb"))


def links(coded: DataFrame, threshold: float = THRESHOLD, hot: int = HOT, block: int = BLOCK) -> DataFrame:
    """a, b, n: rows (a, null, n) say that a links n other vectors more, rows (a, b, null) are edges
    that keep every class connected. coded: rep, copies and what `code_udf` gives."""
    key = ["dim", "t", "value"]
    filed = coded.select("dim", "bits", "reach", "known", "rep", F.posexplode("substrings").alias("t", "value"))
    looked = filed.select("dim", "t", "reach", "known", "rep", F.explode(_around(F.col("value"), F.col("bits"))).alias("value"))
    buckets = filed.groupBy(*key, "bits").agg(F.count("*").alias("members"))
    looks = buckets.select("dim", "t", "members", F.explode(_around(F.col("value"), F.col("bits"))).alias("value")).groupBy(*key).agg(F.sum("members").alias("lookers"))
    large = stash(buckets.join(looks, key).where(F.col("members") * F.col("lookers") > hot).select(*key, F.ceil(F.col("members") / block).alias("blocks"), F.ceil(F.col("lookers") / block).alias("rows")), "large_buckets")
    any_large = not large.isEmpty()
    small = (lambda df: df.join(large, key, "left_anti")) if any_large else (lambda df: df)
    one = small(looked).select(*key, "reach", F.col("known").alias("ka"), F.col("rep").alias("a"))
    two = filed.select(*key, F.col("known").alias("kb"), F.col("rep").alias("b"))
    met = one.join(two, key).where((F.col("a") < F.col("b")) & (F.bit_count(F.col("ka").bitwiseXOR(F.col("kb"))) <= F.col("reach"))).select("a", "b", "t")
    of = lambda k: coded.select(F.col("rep").alias(k), F.col("copies").alias(f"c{k}"), F.col("substrings").alias(f"s{k}"), F.col("x").alias(f"x{k}"), F.col("norm").alias(f"n{k}"))
    first = F.array_position(F.zip_with("sa", "sb", lambda p, q: F.bit_count(p.bitwiseXOR(q)) <= 1), True) == F.col("t") + 1
    pairs = stash(stash(met, "met").join(of("a"), "a").join(of("b"), "b").where(first & (_cosine() >= threshold)).select("a", "b", "ca", "cb"), "pairs")
    null = F.lit(None).cast("long")
    out = pairs.select("a", "b", null.alias("n")).unionAll(pairs.select("a", null, "cb")).unionAll(pairs.select("b", null, "ca"))
    if any_large:
        spread = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
        own = lambda n: F.pmod(F.xxhash64("rep"), F.col(n))
        held = filed.join(large, key).select(*key, own("blocks").alias("i"), spread("rows").alias("j"), F.lit(False).alias("looks"), "rep")
        lookers = looked.join(large, key).select(*key, own("rows").alias("j"), spread("blocks").alias("i"), F.lit(True).alias("looks"), "rep").select(*held.columns)
        dealt = held.unionAll(lookers).join(coded.select("rep", "copies", "substrings", "x", "norm"), "rep")
        out = out.unionAll(dealt.groupBy(*key, "i", "j").applyInPandas(compare(threshold), "a long, b long, n long"))
    return out


def near_duplicates(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", threshold: float = THRESHOLD, hot: int = HOT, block: int = BLOCK, sample: int = SAMPLE) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row."""
    bound_batches(vectors.sparkSession)
    finite = F.forall("e", lambda x: F.coalesce((F.abs(x) < float("inf")) & ~F.isnan(x), F.lit(False)))
    usable = F.coalesce(F.size("e") > 0, F.lit(False)) & F.coalesce(finite & F.exists("e", lambda x: x != 0), F.lit(False))
    rows = stash(vectors.select(source_order().alias("nth"), F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("e")).withColumn("usable", usable), "vectors")
    good = rows.where("usable")
    reps = stash(good.groupBy("e").agg(F.min("nth").alias("rep"), F.count("*").alias("copies"), F.min("vec_id").alias("first_id")), "reps")
    coded = stash(reps.select("rep", "copies", code_udf(learn(reps, threshold, sample))("e").alias("c")).select("rep", "copies", "c.*"), "codes")
    found = stash(links(coded, threshold, hot, block), "links")
    discard(coded)
    counts = found.where("n is not null").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    comps = connected_components(found.where("b is not null").select("a", "b"))
    member = reps.select("rep", "copies", "first_id").join(comps.withColumnRenamed("id", "rep"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    smallest = member.groupBy("root").agg(F.min("first_id").alias("component_id"))
    told = member.join(smallest, "root").join(counts, "rep", "left").select("rep", "component_id", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"))
    told = stash(told.join(reps.select("rep", "e"), "rep").select("e", "component_id", "n_links"), "told")
    linked = good.select("vec_id", "e").join(told, "e").select("vec_id", "n_links", "component_id")
    alone = rows.where(~F.col("usable")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionAll(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op8_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
