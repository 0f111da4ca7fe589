"""Shards by extendible hashing, in DataFrame functions only.

A row's code is 32 bits of a hash of its key, then 31 bits of its own that part rows with equal keys.
A shard is a prefix of codes. Beginning with the empty prefix, only shards above the byte limit split
on their next bit, until every shard fits or holds a single row: so a shard is the shortest prefix that
fits. The directory is found in rounds of ROUND bits. A round sums the bytes of the rows still in
oversized buckets by their next ROUND bits, and all shorter prefixes are sums of those few rows; rows
are read again only where a bucket of the round's full length is still too large.

Nothing is moved but a key, a code and a size for each row; the directory is joined back as its size
allows. Hot keys split on the bits of their own. Sums are grouped by (depth, prefix) after a partial
sum, so the first round's few prefixes are small tables whatever the input.

A null key is one key; null texts have no bytes. A single row above the limit has a shard to itself.
Repeated rows are dealt separately. An empty table gives an empty result and an empty directory.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, source_order, stash, table

#: Bytes of text in a shard at most: of shards that are written as files, and of those that the query
#: deals, which are chunks that a loader reads at once.
SHARD_BYTES, CHUNK_BYTES = 64 << 20, 64 << 10
BITS, KEY_BITS, ROUND = 63, 32, 10


def codes(docs: DataFrame, keep: dict[str, Column], key: str = "doc_id", text: str = "text") -> DataFrame:
    """nth, kept, bytes and code of each row."""
    nth = source_order()
    name = F.coalesce(F.col(key).cast("string"), F.lit("null"))
    high = F.conv(F.substring(F.md5(name.cast("binary")), 1, 8), 16, 10).cast("long")
    rows = docs.select(nth.alias("nth"), F.struct(*[c.alias(k) for k, c in keep.items()]).alias("kept"), F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long").alias("bytes"), high.alias("high"))
    low = F.xxhash64("nth").bitwiseAND(F.lit((1 << (BITS - KEY_BITS)) - 1))
    return stash(rows.select("nth", "kept", "bytes", F.shiftleft("high", BITS - KEY_BITS).bitwiseOR(low).alias("code")), "codes")


def _prefix(bits: int) -> Column:
    return F.shiftright("code", BITS - bits)


def directory(rows: DataFrame, limit: int = SHARD_BYTES, step: int = ROUND) -> list[tuple[int, DataFrame]]:
    """For each round, its bits and a table leaf, depth, bytes, docs: the shard of every leaf of that
    many bits; depth is null where the leaf goes on to the next round."""
    rounds, open_rows, bits = [], rows, 0
    while bits < BITS:
        begun, bits = bits, min(BITS, bits + step)
        leaves = open_rows.groupBy(_prefix(bits).alias("leaf")).agg(F.sum("bytes").alias("bytes"), F.count("*").alias("docs"))
        depths = list(range(begun, bits + 1)) if begun == 0 else list(range(begun + 1, bits + 1))
        each = leaves.withColumn("depth", F.explode(F.array(*map(F.lit, depths)))).withColumn("prefix", F.expr(f"shiftright(leaf, {bits} - depth)"))
        sums = each.groupBy("depth", "prefix").agg(F.sum("bytes").alias("all_bytes"), F.sum("docs").alias("all_docs"))
        fits = (F.col("all_bytes") <= limit) | (F.col("all_docs") == 1)
        fits = fits | (F.col("depth") == BITS)
        chosen = each.select("leaf", "depth", "prefix").join(sums.where(fits), ["depth", "prefix"], "left")
        first = F.min(F.when(F.col("all_docs").isNotNull(), F.struct("depth", F.col("all_bytes").alias("bytes"), F.col("all_docs").alias("docs"))))
        found = stash(chosen.groupBy("leaf").agg(first.alias("s")).select("leaf", "s.depth", "s.bytes", "s.docs"), "directory")
        rounds.append((bits, found))
        too_large = found.where("depth is null").select(F.col("leaf").alias("open_leaf"))
        if too_large.isEmpty():
            break
        before, open_rows = open_rows, stash(open_rows.join(too_large, _prefix(bits) == F.col("open_leaf"), "left_semi"), "oversized")
        if before is not rows:
            discard(before)
    return rounds


def assign(rows: DataFrame, rounds: list[tuple[int, DataFrame]]) -> DataFrame:
    """rows with shard (the prefix in 0s and 1s), depth, shard_bytes and shard_docs."""
    out, names = rows, ["depth", "bytes", "docs"]
    for k, (bits, found) in enumerate(rounds):
        own = found.where("depth is not null").select(F.col("leaf").alias(f"leaf{k}"), *[F.col(c).alias(f"{c}{k}") for c in names])
        out = out.join(own, _prefix(bits) == F.col(f"leaf{k}"), "left").drop(f"leaf{k}")
    depth, size, docs = (F.coalesce(*[F.col(f"{c}{k}") for k in range(len(rounds))]) for c in names)
    text = F.lpad(F.conv("code", 10, 2), BITS, "0")
    out = out.select("nth", "kept", "bytes", "code", depth.alias("depth"), size.alias("shard_bytes"), docs.alias("shard_docs"))
    return out.withColumn("shard", F.substring(text, F.lit(1), F.col("depth")))


def shards(docs: DataFrame, keep: dict[str, Column], key: str = "doc_id", text: str = "text", limit: int = SHARD_BYTES) -> DataFrame:
    rows = codes(docs, keep, key, text)
    return assign(rows, directory(rows, limit))


def write_shards(docs: DataFrame, out: str, key: str = "doc_id", text: str = "text", limit: int = SHARD_BYTES) -> None:
    """Write docs to `out`, a folder shard=PREFIX for each shard; a column `shard` of docs is replaced."""
    dealt = shards(docs, {"row": F.struct(*[f"`{c}`" for c in docs.columns if c != "shard"])}, key, text, limit)
    dealt.select("kept.row.*", F.concat(F.lit("s"), "shard").alias("shard")).repartition("shard").write.partitionBy("shard").parquet(out)


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = shards(table(spark, sf_dir, "documents"), {"doc_id": F.col("doc_id")}, limit=CHUNK_BYTES)
    return dealt.select("kept.doc_id", "bytes", "shard", "depth", "shard_bytes", "shard_docs")


ORACLE = f"""
with rows as (
  select row_number() over () as nth, doc_id, coalesce(strlen(text), 0)::bigint as bytes, ('0x' || md5(coalesce(doc_id::varchar, 'null'))[1:8])::bigint as code
  from documents),
each as (
  select nth, doc_id, bytes, code, d::int as depth, sum(bytes) over (partition by d, code >> (32 - d)::int)::bigint as shard_bytes,
         count(*) over (partition by d, code >> (32 - d)::int) as shard_docs
  from rows, range(0, 33) t(d)),
fitting as (select *, row_number() over (partition by nth order by depth) as k from each where shard_bytes <= {CHUNK_BYTES} or shard_docs = 1)
select doc_id, bytes, lpad(bin(code), 32, '0')[1:depth] as shard, depth, shard_bytes, shard_docs from fitting where k = 1
"""
