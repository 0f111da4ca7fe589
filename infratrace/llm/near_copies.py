"""Near copies by the Jaccard similarity of word shingles: candidates are found, exact sets decide.

A text's shingles are its runs of `shingle` lower-cased words (a shorter text is one shingle), held as
XXH64 (seed 42). Texts of the same words are one node. Fingerprints of a few differing bits reach only
the closest of pairs at a similarity of 0.8, so a node is filed once for each of BANDS bands of ROWS
minima too; nodes that share a band are candidates, as are those that the caller adds, and each
candidate pair's shingle sets are compared, so a link always has the similarity. A pair at 0.8 shares
no band with chance 0.0004, one at 0.9 with chance below 1e-7. Sets whose sizes alone rule the
similarity out are not fetched.

Bands shared by more than `hot` nodes do not become pairs: their members are dealt to pairs of blocks,
each block pair is compared in one task and yields only a spanning forest of its links; nothing is
dropped.

Nulls and texts without words are one node. Rows that repeat a doc_id stay rows; a null doc_id never
becomes a class id unless the whole class has none. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructType

from .common import bound_batches, connected_components, discard, side, stash

SEED = 42
SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 20, 5
#: Members of a band's value above which its pairs are compared in blocks.
HOT = 50
BLOCK = 1000

_random = np.random.default_rng(SEED)
_TIMES = _random.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _random.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def hashes_of(words: list[bytes], shingle: int) -> np.ndarray:
    """The hash of every shingle in order, repeats included; without words that of nothing."""
    n = max(1, len(words) - shingle + 1)
    joined, at = b" ".join(words), [0]
    for w in words:
        at.append(at[-1] + len(w) + 1)
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[at[i]:at[i + shingle] - 1], SEED) for i in range(n)] if n > 1 else [digest(joined, SEED)], dtype="<u8")


def majority(hashes: np.ndarray) -> int:
    """The bits that more than half of the hashes have set, as an unsigned 64-bit number."""
    total = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 4096):
        total += np.unpackbits(hashes[at:at + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(total * 2 > len(hashes), bitorder="little").view("<u8")[0])


def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """A text's different shingles, sorted, as unsigned 64-bit numbers."""
    return np.unique(hashes_of(words_of(text), shingle))


def bands(hashes: np.ndarray) -> np.ndarray:
    """One number a band, from the minima of the shingles."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(hashes), 4096):
        least = np.minimum(least, (hashes[at:at + 4096, None] * _TIMES + _PLUS).min(axis=0))
    return np.array([xxhash.xxh64_intdigest(row.tobytes(), SEED) for row in least.reshape(BANDS, ROWS)], dtype="<u8")


def node(text: str | None) -> int:
    """The number of a text's words in order, unsigned."""
    return xxhash.xxh64_intdigest(b" ".join(words_of(text)), SEED)


MARK = StructType().add("node", LongType()).add("size", IntegerType()).add("fp", LongType()).add("bands", ArrayType(LongType()))


def _marks(shingle: int):
    """text -> its node, the number of its shingles, its fingerprint and its bands."""
    @F.pandas_udf(MARK)
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            nodes, sizes, fps, filed = [], [], [], []
            for text in batch:
                words = words_of(text)
                every = hashes_of(words, shingle)
                own = np.unique(every)
                nodes.append(xxhash.xxh64_intdigest(b" ".join(words), SEED))
                sizes.append(len(own))
                fps.append(majority(every) if words else 0)
                filed.append(bands(own).view("<i8"))
            signed = lambda x: np.array(x, dtype="<u8").view("<i8")
            yield pd.DataFrame({"node": signed(nodes), "size": np.array(sizes, dtype=np.int32), "fp": signed(fps), "bands": pd.Series(filed, dtype=object)})

    return run


def _shingles(shingle: int):
    @F.pandas_udf(ArrayType(LongType()))
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([shingles(x, shingle).view("<i8") for x in batch], dtype=object)

    return run


def _block_forest(similarity: float):
    def work(key, batch: pd.DataFrame) -> pd.DataFrame:
        bi, bj = key[2], key[3]
        nodes, block, sets = batch["node"].to_numpy(), batch["block"].to_numpy(), batch["hashes"].to_numpy()
        left, right = np.flatnonzero(block == bi), np.flatnonzero(block == bj)
        out: list[tuple[int, int]] = []
        if len(left) and len(right):
            sizes = np.array([len(s) for s in sets])
            filed = np.concatenate([sets[i] for i in left])
            owner = np.repeat(np.arange(len(left)), sizes[left])
            order = np.argsort(filed, kind="stable")
            filed, owner = filed[order], owner[order]
            root = list(range(len(nodes)))

            def find(v: int) -> int:
                while root[v] != v:
                    root[v] = root[root[v]]
                    v = root[v]
                return v

            for j in right:
                first, end = np.searchsorted(filed, sets[j], "left"), np.searchsorted(filed, sets[j], "right")
                n = end - first
                at = np.arange(n.sum()) + np.repeat(first - np.cumsum(n) + n, n)
                shared = np.bincount(owner[at], minlength=len(left))
                for i in left[shared / (sizes[left] + sizes[j] - shared) >= similarity]:
                    a, b = find(int(i)), find(int(j))
                    if a != b:
                        root[max(a, b)] = min(a, b)
                        out.append((int(nodes[i]), int(nodes[j])))
        pairs = np.array(out, dtype=np.int64).reshape(-1, 2)
        return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})

    return work


def links(filed: DataFrame, more: DataFrame | None, sizes: DataFrame, sets_of: Callable[[DataFrame], DataFrame], similarity: float = SIMILARITY, hot: int = HOT, block: int = BLOCK) -> DataFrame:
    """a, b: edges between nodes that keep every class connected.

    filed: band, value, node, with values of two nodes or more only; more: further candidates a, b;
    sizes: node, size; sets_of gives node, hashes for a table of nodes.
    """
    key = ["band", "value"]
    hot_keys = stash(filed.groupBy(*key).count().where(F.col("count") > hot).withColumn("blocks", F.ceil(F.col("count") / block).cast("int")).drop("count"), "hot_bands")
    any_hot = not hot_keys.isEmpty()
    cold = filed.join(side(hot_keys), key, "left_anti") if any_hot else filed
    a, b = cold.select(*key, F.col("node").alias("a")), cold.select(*key, F.col("node").alias("b"))
    shared = a.hint("merge").join(b, key).where("a < b").select("a", "b")
    shared = (shared.unionAll(more) if more is not None else shared).distinct()
    small, large = F.least("x", "y"), F.greatest("x", "y")
    sized = shared.join(sizes.select(F.col("node").alias("a"), F.col("size").alias("x")), "a").join(sizes.select(F.col("node").alias("b"), F.col("size").alias("y")), "b")
    pairs = stash(sized.where(small / large >= similarity).select("a", "b"), "candidates")
    compared = pairs.select(F.col("a").alias("node")).unionAll(pairs.select("b"))
    if any_hot:
        compared = compared.unionAll(filed.join(side(hot_keys), key, "left_semi").select("node"))
    sets = stash(sets_of(compared.distinct()), "shingles")
    one, two = sets.select(F.col("node").alias("a"), F.col("hashes").alias("x")), sets.select(F.col("node").alias("b"), F.col("hashes").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    found = pairs.join(one, "a").join(two, "b").where(both / (F.size("x") + F.size("y") - both) >= similarity).select("a", "b")
    if any_hot:
        own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
        dealt = (
            filed.join(side(hot_keys), key).withColumn("block", own).join(sets, "node")
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            .select(*key, F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"), "block", "node", "hashes")
        )
        found = found.unionAll(dealt.groupBy(*key, "bi", "bj").applyInPandas(_block_forest(similarity), "a long, b long"))
    out = stash(found, "links")
    discard(hot_keys, pairs, sets)
    return out


def near_copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = SHINGLE, similarity: float = SIMILARITY, hot: int = HOT, block: int = BLOCK, keep: dict[str, Column] | None = None, more: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """doc_id, fingerprint, component_id, component (one of the class's nodes) and the `keep` columns of
    every row. more: further candidates a, b from a table of node, fp."""
    bound_batches(docs.sparkSession)
    keep = keep or {}
    digest = F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))
    marked = stash(docs.select(digest.alias("digest"), F.col(doc_id).cast("long").alias("doc_id"), _marks(shingle)(F.col(text)).alias("mark"), F.struct(F.lit(0).alias("_"), *[c.alias(k) for k, c in keep.items()]).alias("kept")), "marks")
    classes = stash(marked.groupBy("mark.node").agg(F.min("doc_id").alias("first_id"), F.min("digest").alias("digest"), F.first("mark").alias("mark")).select("node", "first_id", "digest", "mark.size", "mark.fp", "mark.bands"), "nodes")
    every = classes.select("node", F.posexplode("bands").alias("band", "value")).select("band", "value", "node")
    shared = every.groupBy("band", "value").count().where("count > 1").drop("count")
    # both sides hold BANDS rows a node, which their sizes as the planner sees them do not tell
    filed = stash(every.join(shared.hint("merge"), ["band", "value"]), "filed")

    def sets_of(nodes: DataFrame) -> DataFrame:
        wanted = classes.join(nodes, "node", "left_semi").select("digest", "node")
        # only texts that are asked for are read on; copies fall together before they move
        texts = docs.select(digest.alias("digest"), F.col(text).alias("text")).join(wanted.select("digest"), "digest", "left_semi").dropDuplicates(["digest"])
        return texts.join(wanted, "digest").select("node", _shingles(shingle)(F.col("text")).alias("hashes"))

    edges = links(filed, more(classes.select("node", "fp")) if more else None, classes.select("node", "size"), sets_of, similarity, hot, block)
    comps = connected_components(edges)
    member = classes.join(comps, classes.node == comps.id, "left").select("node", "first_id", F.coalesce("root", "node").alias("root"))
    smallest = member.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = stash(member.join(smallest, "root").select("node", "component_id", F.col("root").alias("component")), "named")
    discard(filed, classes, edges)
    told = marked.select("doc_id", F.col("mark.node").alias("node"), F.col("mark.fp").alias("fingerprint"), "kept").join(named, "node")
    return told.select("doc_id", "fingerprint", "component_id", "component", *[F.col("kept").getField(k).alias(k) for k in keep])
