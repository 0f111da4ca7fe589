"""Conversation prefix trie by splitter and skeleton.

Conversations are rebuilt (the first turns of another one, then their own), become paths of turn keys
and are sorted by (path, conv_id) into shards. A node whose members lie in two shards is a prefix of a
splitter's path, so the splitters' prefixes, the *skeleton*, hold every such node. The skeleton is
broadcast: at most MAX_TASKS * SHARDS_A_TASK paths of SPLIT_TURNS turns. A shard is read once in order,
with the nodes of one path open, and finishes all its other nodes; of skeleton nodes it gives partial
sums, which are added up and rolled up along the skeleton.

Splitters hold a conv_id beside the path, so a conversation that very many share is dealt to many shards.
A splitter's path ends after SPLIT_TURNS turns: a node below that depth is never cut, and copies longer
than that stay together, read row by row like all others. Ids of conversations that end in a skeleton node
are handed on in pieces of text and hashed in order, as SHA-256 asks for.

A conversation's keys (not its texts) are one row. Null roles and texts are empty; rows without conv_id
take no part. Turns of one conversation with the same number are ordered by role and text, repeated rows
are turns of their own. `conv_id % 5` keeps the sign of conv_id. Turn keys are MD5 digests of role and
text. An empty table gives no node, not even a root. Other columns are left out.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from .common import bound_batches, discard, stash, table

#: Conversations that share a beginning; the number of turns of it is below HEADS.
FAMILY, HEADS = 5, 9
#: Bytes of a turn's key.
KEY = 16
#: Conversations of a task until MAX_TASKS are reached, shards of a task, conversations drawn for a shard.
TASK_ROWS, MAX_TASKS, SHARDS_A_TASK, DRAWN = 100_000, 4000, 4, 8
#: Turns of a splitter's path at most.
SPLIT_TURNS = 64
#: Characters of a piece of ids, and rows of a batch that a shard returns.
PIECE, BATCH = 1 << 16, 8192

#: What a shard says: a finished node, one whose parent is in the skeleton, a share of a skeleton node, ids
#: that end in one.
NODE, BELOW, SHARE, ENDS = range(4)
SAID = "kind int, at int, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, bytes long, ends string"
RESULT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def keyed(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, turn, nth (among turns of the same number), key and bytes of each turn. Texts are moved only
    where turns of a conversation have the same number."""
    rows = turns.where(F.col(conv_id).isNotNull()).select(
        F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")
    )
    key = F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary")))
    told = lambda df, nth: df.select("conv_id", "turn", nth.alias("nth"), key.alias("key"), F.octet_length("text").cast("long").alias("bytes"))
    ties = stash(rows.groupBy("conv_id", "turn").count().where("count > 1").select(F.col("conv_id").alias("c"), F.col("turn").alias("t")), "ties")
    if ties.isEmpty():
        return told(rows, F.lit(1))
    same = (F.col("conv_id") == F.col("c")) & F.col("turn").eqNullSafe(F.col("t"))
    nth = F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy("role", "text"))
    return told(rows.join(ties, same, "left_anti"), F.lit(1)).unionAll(told(rows.join(ties, same, "left_semi"), nth))


def rebuilt(turns: DataFrame, family: int = FAMILY, heads: int = HEADS) -> DataFrame:
    """conv_id, path (its turns' keys, joined) and sizes (their bytes) of every rebuilt conversation."""
    each = F.struct(F.col("turn").isNotNull().alias("known"), "turn", "nth", "key", "bytes")
    convs = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(each)).alias("own"))
    convs = convs.withColumn("own", F.transform("own", lambda x: F.struct(x["key"].alias("key"), x["bytes"].alias("bytes"))))
    first = F.col("conv_id") % family
    convs = stash(convs.withColumn("base", F.col("conv_id") - first).withColumn("h", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int")), "conversations")
    starts = convs.where(first == 0).select(F.col("conv_id").alias("base"), F.slice("own", 1, heads - 1).alias("start"))
    start = F.slice(F.coalesce("start", F.slice("own", 1, 0)), F.lit(1), F.col("h"))
    told = convs.join(starts, "base", "left").withColumn("turns", F.concat(start, F.slice("own", F.col("h") + 1, F.greatest(F.size("own"), F.lit(1)))))
    path = F.unhex(F.array_join(F.transform("turns", lambda x: F.hex(x["key"])), ""))
    out = stash(told.select("conv_id", path.alias("path"), F.transform("turns", lambda x: x["bytes"]).alias("sizes")), "paths")
    discard(convs)
    return out


def splitters(paths: DataFrame, shards: int, n: int, turns: int = SPLIT_TURNS, drawn: int = DRAWN) -> list[tuple[bytes, int]]:
    """(path, conv_id) between the shards, from `drawn` rows for each (chosen by hash)."""
    share = min(1.0, drawn * shards / max(n, 1))
    hashed = F.pmod(F.xxhash64("conv_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    rows = paths.where(hashed < share).select(F.substring("path", 1, turns * KEY).alias("p"), "conv_id").limit(2 * drawn * shards).collect()
    rows = sorted((bytes(r["p"]), r["conv_id"]) for r in rows)
    return sorted({rows[len(rows) * k // shards] for k in range(1, shards)}) if rows else []


def skeleton(cuts: list[tuple[bytes, int]]) -> dict[bytes, int]:
    """A number for every prefix of a splitter's path, the root first."""
    found = {p[:k] for p, _ in cuts for k in range(0, len(p) + 1, KEY)} | {b""}
    return {p: i for i, p in enumerate(sorted(found, key=lambda p: (len(p), p)))}


class _Open:
    """A node of the path that is being read."""

    __slots__ = ("at", "size", "n", "low", "children", "leaves", "saved", "ends", "first", "waiting")

    def __init__(self, at: int | None, size: int):
        self.at, self.size, self.n, self.low = at, size, 0, None
        self.children = self.leaves = self.saved = 0
        self.ends = None  # a running hash, or pieces of text where the node is in the skeleton
        self.first, self.waiting = 0, []


def _common(a: bytes, b: bytes) -> int:
    """Turns that two paths have in common from the start."""
    if a == b:
        return len(a) // KEY
    k, most = 0, min(len(a), len(b))
    while k < most and a[k:k + KEY] == b[k:k + KEY]:
        k += KEY
    return k // KEY


def read_shards(names: dict[bytes, int], piece: int = PIECE, batch: int = BATCH):
    """Rows (path, conv_id, sizes, shard) in order of (path, conv_id), of any shards, to what these say (SAID)."""
    columns = [c.split()[0] for c in SAID.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        open_: list[_Open] = []

        def hand_on(node: _Open) -> None:
            out.append((ENDS, node.at, node.first, None, None, None, None, None, None, None, ",".join(node.ends)))
            node.ends = None

        def close() -> None:
            node, depth = open_.pop(), len(open_)
            parent = open_[-1] if open_ else None
            if parent is not None:
                parent.n += node.n
                parent.low = node.low if parent.low is None else min(parent.low, node.low)
            if node.at is not None:
                if node.ends:
                    hand_on(node)
                out.append((SHARE, node.at, node.low, depth, None, node.n, node.children, node.leaves, node.saved, node.size, None))
                out.extend((BELOW, node.at, *row) for row in node.waiting)
                return
            leaves, saved = node.leaves or 1, node.saved + (node.n - 1) * node.size
            parent.children, parent.leaves, parent.saved = parent.children + 1, parent.leaves + leaves, parent.saved + saved
            digest = (node.ends or hashlib.sha256()).hexdigest()
            parent.waiting.append((node.low, depth, None, node.n, node.children, leaves, saved, None, digest))
            out.extend((NODE, None, low, d, node.low, *rest) for low, d, _, *rest in node.waiting)

        before, at = b"", None
        for frame in frames:
            for path, conv, sizes, shard in zip(frame["path"], frame["conv_id"], frame["sizes"], frame["shard"]):
                if shard != at:  # the shards between may be another task's: a piece of ids ends here
                    for node in open_:
                        if node.at is not None and node.ends:
                            hand_on(node)
                    at = shard
                depth = len(path) // KEY
                if not open_:
                    open_.append(_Open(names[b""], 0))
                keep = _common(before, path)
                while len(open_) > keep + 1:
                    close()
                for d in range(len(open_), depth + 1):
                    at = names.get(path[:d * KEY]) if open_[-1].at is not None else None
                    open_.append(_Open(at, int(sizes[d - 1])))
                node, conv = open_[-1], int(conv)
                node.n += 1
                node.low = conv if node.low is None else min(node.low, conv)
                if node.at is None:
                    if node.ends is None:
                        node.ends = hashlib.sha256(str(conv).encode())
                    else:
                        node.ends.update(f",{conv}".encode())
                else:
                    if not node.ends:
                        node.ends, node.first = [], conv
                    node.ends.append(str(conv))
                    if len(node.ends) * 8 > piece:
                        hand_on(node)
                before = path
                if len(out) >= batch:
                    yield pd.DataFrame(out, columns=columns).astype(KINDS)
                    out.clear()
        while open_:
            close()
        if out:
            yield pd.DataFrame(out, columns=columns).astype(KINDS)

    return run


KINDS = {c.split()[0]: "Int32" if c.endswith(" int") else "Int64" for c in SAID.split(", ") if not c.endswith("string")}


def rolled_up(shares: list, names: dict[bytes, int]) -> list[tuple]:
    """Skeleton nodes (at, and the columns of the result but the hash) from their summed shares."""
    of, path = {r["at"]: r.asDict() for r in shares}, {i: p for p, i in names.items()}
    for at in sorted(of, key=lambda a: -len(path[a])):
        node = of[at]
        node["n_leaves"] = node["n_leaves"] or 1
        node["saved_tokens"] += (node["n_convs"] - 1) * node["bytes"]
        if path[at]:
            parent = of[names[path[at][:-KEY]]]
            node["parent"] = parent["conv_id"]
            parent["n_children"] += 1
            parent["n_leaves"] += node["n_leaves"]
            parent["saved_tokens"] += node["saved_tokens"]
    return [(at, x["conv_id"], len(path[at]) // KEY, x.get("parent"), x["n_convs"], x["n_children"], x["n_leaves"], x["saved_tokens"]) for at, x in of.items()]


def hash_pieces(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pieces of ids in order of (at, first) to one digest for each node."""
    at, digest = None, None
    for frame in frames:
        done = []
        for a, text in zip(frame["at"], frame["ends"]):
            if a != at:
                if digest is not None:
                    done.append((at, digest.hexdigest()))
                at, digest = a, hashlib.sha256(text.encode())
            else:
                digest.update(b"," + text.encode())
        yield pd.DataFrame(done, columns=["at", "ends_sha256"])
    if digest is not None:
        yield pd.DataFrame([(at, digest.hexdigest())], columns=["at", "ends_sha256"])


def prefix_trie(paths: DataFrame, tasks: int | None = None, split_turns: int = SPLIT_TURNS) -> DataFrame:
    """The nodes of the trie of paths (conv_id, path, sizes)."""
    spark = paths.sparkSession
    bound_batches(spark)
    n = paths.count()
    tasks = tasks or max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(MAX_TASKS, -(-n // TASK_ROWS)))
    shards = tasks * SHARDS_A_TASK
    cuts = splitters(paths, shards, n, split_turns)
    names = skeleton(cuts)

    @F.pandas_udf(IntegerType())
    def shard_of(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for p, c in batches:
            yield pd.Series([bisect_right(cuts, (bytes(a), int(b))) for a, b in zip(p, c)], dtype="int32")

    dealt = paths.withColumn("shard", shard_of("path", "conv_id")).repartition(tasks, "shard").sortWithinPartitions("path", "conv_id")
    said = stash(dealt.select("path", "conv_id", "sizes", "shard").mapInPandas(read_shards(names), SAID), "said")
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    shares = said.where(F.col("kind") == SHARE).groupBy("at").agg(F.min("conv_id").alias("conv_id"), F.max("bytes").alias("bytes"), *sums).collect()
    top = spark.createDataFrame(rolled_up(shares, names), "at int, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long")
    pieces = said.where(F.col("kind") == ENDS).select("at", F.col("conv_id").alias("first"), "ends")
    hashes = pieces.repartition("at").sortWithinPartitions("at", "first").mapInPandas(hash_pieces, "at int, ends_sha256 string")
    top_rows = top.join(hashes, "at", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())))
    named = said.withColumnRenamed("ends", "ends_sha256")
    parents = F.broadcast(top.select("at", F.col("conv_id").alias("low")))  # a row for each skeleton node
    below = named.where(F.col("kind") == BELOW).join(parents, "at").withColumn("parent_conv_id", F.col("low"))
    return named.where(F.col("kind") == NODE).select(*RESULT).unionAll(below.select(*RESULT)).unionAll(top_rows.select(*RESULT))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(rebuilt(keyed(table(spark, sf_dir, "conversations"))))


#: CRC-32 of the decimal digits bit by bit, then prefixes as lists of turns.
ORACLE = """
WITH turns AS (
    SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
           row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
    FROM conversations WHERE conv_id IS NOT NULL),
convs AS (
    SELECT conv_id, xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
               lambda acc, b: list_reduce(list_prepend(xor(acc, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda y, z: xor(y >> 1, 3988292384::BIGINT * (y & 1))))) % 9 AS h
    FROM (SELECT DISTINCT conv_id FROM turns)),
parts AS (
    SELECT c.conv_id, 0 AS part, t.pos, t.role, t.text FROM convs c JOIN turns t ON t.conv_id = c.conv_id - c.conv_id % 5 WHERE t.pos <= c.h
    UNION ALL
    SELECT c.conv_id, 1, t.pos, t.role, t.text FROM convs c JOIN turns t ON t.conv_id = c.conv_id WHERE t.pos > c.h),
steps AS (
    SELECT conv_id, row_number() OVER w AS depth, list(md5(length(role) || ':' || role || text)) OVER w AS prefix, strlen(text) AS bytes
    FROM parts WINDOW w AS (PARTITION BY conv_id ORDER BY part, pos)),
members AS (SELECT * FROM steps UNION ALL SELECT conv_id, 0, []::VARCHAR[], 0 FROM convs),
ended AS (SELECT conv_id, max(depth) AS last FROM members GROUP BY conv_id),
nodes AS (
    SELECT prefix, depth, min(conv_id) AS low, count(*) AS n_convs, (count(*) - 1) * max(bytes) AS saved,
           sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE depth = last), '')) AS ends_sha256
    FROM members JOIN ended USING (conv_id) GROUP BY prefix, depth),
kids AS (SELECT list_slice(prefix, 1, depth - 1) AS prefix, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1),
told AS (SELECT n.*, coalesce(k.n, 0) AS n_children FROM nodes n LEFT JOIN kids k ON k.prefix = n.prefix),
sums AS (
    SELECT list_slice(prefix, 1, up) AS prefix, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS leaves, sum(saved) AS saved
    FROM (SELECT *, unnest(range(0, depth + 1)) AS up FROM told) GROUP BY 1)
SELECT t.low AS conv_id, t.depth::BIGINT AS depth, p.low AS parent_conv_id, t.n_convs, t.n_children::BIGINT AS n_children,
       s.leaves::BIGINT AS n_leaves, s.saved::BIGINT AS saved_tokens, t.ends_sha256
FROM told t JOIN sums s ON s.prefix = t.prefix LEFT JOIN nodes p ON t.depth > 0 AND p.prefix = list_slice(t.prefix, 1, t.depth - 1)
"""
