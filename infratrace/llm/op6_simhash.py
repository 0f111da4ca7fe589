"""SimHash near-duplicates through deletion-variant signatures.

A text's fingerprint is the majority of the XXH64 (seed 42) bits of its 4-word shingles. Two
fingerprints link when at most `max_bits` bits differ. The 64 bits are cut into max_bits // 2 + 1
segments: if every segment differed in two bits or more, more than max_bits bits would, so a linked
pair has a segment that differs in one bit at most, and the two share that segment with one bit
blanked out. Each different fingerprint is filed once for every blanked bit; an equality join on
(segment, bit, rest) gives the candidates and the join's condition verifies them. Only different
fingerprints are joined: copies meet in a count before it. A pair counts in its first fitting
segment alone, so the join gives each link once.

Keys shared by more than `hot` different fingerprints do not go through that join: their members are
dealt to pairs of blocks, each block pair is compared in one task and yields only a spanning forest
of its links, so rows grow with the members and not with their pairs; nothing is dropped.

With `similarity`, texts link by the Jaccard similarity of their shingle sets instead: the pairs that the
signatures find are candidates, `near_copies` adds those that lie beyond `max_bits`, and exact sets
decide.

Segments of a third of 64 bits tell about two million keys apart a blanked bit: up to some 10^7
different fingerprints a key holds a few of them, at 10^9 some 500, and work then grows with the square.

Nulls and texts without words have fingerprint zero and link like any other. Rows that repeat a
doc_id stay rows; a null doc_id never becomes a class id unless the whole class has none. An empty
table gives an empty result. Other columns are left out unless named in `keep`; those may bear
any names but those of the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from . import near_copies
from .common import bound_batches, connected_components, discard, side, stash, table
from .near_copies import hashes_of, majority, words_of

SHINGLE = 4
MAX_BITS = 4
#: Members of a signature above which its pairs are compared in blocks, and members of a block.
HOT = 100
BLOCK = 16_384


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The fingerprint of one text as an unsigned 64-bit number."""
    words = words_of(text)
    return majority(hashes_of(words, shingle)) if words else 0


def _fingerprints(shingle: int):
    @F.pandas_udf(LongType())
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series(np.array([fingerprint(x, shingle) for x in batch], dtype="<u8").view("<i8"))

    return run


def segments(max_bits: int) -> list[tuple[int, int]]:
    """(first bit, bits) of each segment."""
    n = max_bits // 2 + 1
    cuts = [64 * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _mask(first: int, bits: int) -> int:
    return ((1 << bits) - 1) << first


def _differing(a: Column, b: Column, mask: int) -> Column:
    return F.bit_count(a.bitwiseXOR(b).bitwiseAND(F.lit(_signed(mask))))


def variants(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """seg, bit, rest, fp: each fingerprint once for every bit that can be blanked out."""
    keys = [
        F.struct(F.lit(s).alias("seg"), F.lit(p).alias("bit"), F.col("fp").bitwiseAND(F.lit(_signed(_mask(first, bits) & ~(1 << (first + p))))).alias("rest"))
        for s, (first, bits) in enumerate(segments(max_bits)) for p in range(bits)
    ]
    return fps.select("fp", F.explode(F.array(*keys)).alias("k")).select("k.seg", "k.bit", "k.rest", "fp")


def _first_fit(a: Column, b: Column, seg: Column, bit: Column, max_bits: int) -> Column:
    """The pair links, and (seg, bit) is the one signature under which it counts."""
    parts = segments(max_bits)
    ok = F.bit_count(a.bitwiseXOR(b)) <= max_bits
    here = F.lit(False)
    for s, (first, bits) in enumerate(parts):
        earlier = F.lit(True)
        for f, n in parts[:s]:
            earlier = earlier & (_differing(a, b, _mask(f, n)) > 1)
        own = F.lit(False)
        for p in range(bits):
            differs = _differing(a, b, 1 << (first + p)) == 1
            own = own | ((bit == p) & (differs | (_differing(a, b, _mask(first, bits)) == 0) if p == 0 else differs))
        here = here | ((seg == s) & earlier & own)
    return ok & here


def _block_forest(max_bits: int):
    def work(key, batch: pd.DataFrame) -> pd.DataFrame:
        bi, bj = key[3], key[4]
        x = batch["fp"].to_numpy().view(np.uint64)
        left = np.sort(x[batch["block"].to_numpy() == bi])
        right = left if bi == bj else np.sort(x[batch["block"].to_numpy() == bj])
        out: list[tuple[int, int]] = []
        if len(left) and len(right):
            root = {int(v): int(v) for v in np.concatenate((left, right))}

            def find(v: int) -> int:
                while root[v] != v:
                    root[v] = root[root[v]]
                    v = root[v]
                return v

            for a in left:
                for b in right[np.bitwise_count(right ^ a) <= max_bits]:
                    ra, rb = find(int(a)), find(int(b))
                    if ra != rb:
                        root[max(ra, rb)] = min(ra, rb)
                        out.append((int(a), int(b)))
        pairs = np.array(out, dtype=np.uint64).reshape(-1, 2).view(np.int64)
        return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})

    return work


def links(fps: DataFrame, max_bits: int = MAX_BITS, hot: int = HOT, block: int = BLOCK) -> DataFrame:
    """a, b: edges between the different fingerprints of fps that keep every class connected."""
    key = ["seg", "bit", "rest"]
    # a small file of fingerprints becomes many signatures: they are made in as many tasks as they are joined in
    spread = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    filed = variants(fps.repartition(spread, "fp"), max_bits)
    hot_keys = stash(filed.groupBy(*key).count().where(F.col("count") > hot).withColumn("blocks", F.ceil(F.col("count") / block).cast("int")).drop("count"), "hot_keys")
    any_hot = not hot_keys.isEmpty()
    cold = filed.join(side(hot_keys), key, "left_anti") if any_hot else filed
    a, b = cold.select(*key, F.col("fp").alias("a")), cold.select(*key, F.col("fp").alias("b"))
    # by its size the planner takes the signatures for no more than the fingerprints and would send all of them to every task
    pairs = a.hint("merge").join(b, key).where((F.col("a") < F.col("b")) & _first_fit(F.col("a"), F.col("b"), F.col("seg"), F.col("bit"), max_bits)).select("a", "b")
    if not any_hot:
        return pairs
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    dealt = (
        filed.join(side(hot_keys), key).withColumn("block", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(*key, F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"), "block", "fp")
    )
    return pairs.unionAll(dealt.groupBy(*key, "bi", "bj").applyInPandas(_block_forest(max_bits), "a long, b long"))


def _candidates(nodes: DataFrame, max_bits: int, hot: int, block: int) -> DataFrame:
    """a, b (a < b): nodes (columns node, fp) whose fingerprints link, each class of fingerprints kept
    connected. Nodes of one fingerprint are each paired with the first of them."""
    nodes = stash(nodes, "fingerprints")
    first = stash(nodes.groupBy("fp").agg(F.min("node").alias("rep")), "first_nodes")
    near = links(first.select("fp"), max_bits, hot, block)
    near = near.join(first.select(F.col("fp").alias("a"), F.col("rep").alias("x")), "a").join(first.select(F.col("fp").alias("b"), F.col("rep").alias("y")), "b")
    equal = nodes.join(first, "fp").where("node <> rep").select(F.col("rep").alias("a"), F.col("node").alias("b"))
    return stash(near.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).unionAll(equal), "near_fingerprints")


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = SHINGLE, max_bits: int = MAX_BITS, similarity: float | None = None, hot: int = HOT, block: int = BLOCK, keep: dict[str, Column] | None = None) -> DataFrame:
    """doc_id, fingerprint (long, the bits as a signed number), component_id, component (one of the
    class's fingerprints, or nodes if `similarity` is given) and the `keep` columns of every row."""
    if similarity is not None:
        return near_copies.near_copies(docs, text, doc_id, shingle, similarity, keep=keep, more=lambda nodes: _candidates(nodes, max_bits, hot, block))
    bound_batches(docs.sparkSession)
    keep = keep or {}
    kept = F.struct(F.lit(0).alias("_"), *[c.alias(k) for k, c in keep.items()]).alias("kept")
    marked = stash(docs.select(F.col(doc_id).cast("long").alias("doc_id"), _fingerprints(shingle)(F.col(text)).alias("fp"), kept), "fingerprints")
    classes = stash(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "classes")
    comps = connected_components(links(classes.select("fp"), max_bits, hot, block))
    member = classes.join(comps, classes.fp == comps.id, "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    smallest = member.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = stash(member.join(smallest, "root").select("fp", "component_id", F.col("root").alias("component")), "named")
    discard(classes)
    told = marked.join(named, "fp")
    return told.select("doc_id", F.col("fp").alias("fingerprint"), "component_id", "component", *[F.col("kept").getField(k).alias(k) for k in keep])


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")
