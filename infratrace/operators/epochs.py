"""Entity epochs: stretches of an indicator's history that may be one machine."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import joined_id, sha256_text
from ..sources.shared import stash

#: Observations of an indicator that are folded as one array; longer histories are scanned in chunks.
FOLD_LIMIT = 5000
#: Observations of a chunk of long histories.
CHUNK_ROWS = 200_000
#: Chunks for each partition of a shuffle at most: a range's bounds and a task's result go through the driver.
MOST_CHUNKS = 8
#: Observations that one hash of an epoch's id covers.
CHUNK = 1000


def histories(hosts: DataFrame, identities: DataFrame) -> DataFrame:
    """Observed hosts with effective_at and ids, the sorted identity features of the observation.
    identities: observation_id, identity."""
    ids = identities.where("identity is not null").groupBy("observation_id").agg(F.sort_array(F.collect_set("identity")).alias("ids"))
    rows = hosts.where("host_observed").select("indicator_id", "observation_id", F.coalesce("observed_at", "collected_at").alias("effective_at"), "collected_at")
    return rows.join(ids, "observation_id", "left").withColumn("ids", F.coalesce("ids", F.array().cast("array<string>")))


def _folded(rows: DataFrame) -> DataFrame:
    each = F.struct("effective_at", "collected_at", "observation_id", "ids")
    grouped = rows.groupBy("indicator_id").agg(F.array_sort(F.collect_list(each)).alias("h"))
    # the fold keeps what it needs: the places where an epoch opens and the identities so far
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("held"), F.array().cast("array<int>").alias("openings"))

    def step(acc, x):
        new = (F.size(x["ids"]) > 0) & (F.size(acc["held"]) > 0) & ~F.arrays_overlap(x["ids"], acc["held"])
        held = F.when(new, x["ids"]).when(F.size(F.array_except(x["ids"], acc["held"])) == 0, acc["held"]).otherwise(F.array_union(acc["held"], x["ids"]))
        openings = F.when(new, F.array_append(acc["openings"], acc["at"])).otherwise(acc["openings"])
        return F.struct((acc["at"] + 1).alias("at"), held.alias("held"), openings.alias("openings"))

    folded = grouped.select("indicator_id", "h", F.aggregate("h", start, step)["openings"].alias("openings"))
    each = folded.select("indicator_id", "openings", F.posexplode("h").alias("at", "h"))
    epoch = F.size(F.filter("openings", lambda o: o <= F.col("at")))
    return each.select("indicator_id", "h.effective_at", "h.collected_at", "h.observation_id", "h.ids", epoch.alias("epoch"))


ORDER = ["indicator_id", "effective_at", "collected_at", "observation_id"]

#: Rows of a chunk: an observation, or what the carry must know at the end of an indicator's part of a chunk.
OBSERVED, LAST, ALL = range(3)


def _fold_chunk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows in order with chunk, seq, the epoch as if each chunk were the beginning (local) and whether the
    chunk has met none of the identities before (fresh). An indicator's part of a chunk ends with two rows
    more: the identities of its last local epoch and of all of it."""
    from pyspark import TaskContext

    chunk, seq = TaskContext.get().partitionId(), 0
    at, local, held, met = None, 0, set(), set()

    def ends() -> pd.DataFrame:
        none = {"effective_at": pd.NaT, "collected_at": pd.NaT, "observation_id": None}
        return pd.DataFrame({"indicator_id": [at, at], **none, "ids": [sorted(held), sorted(met)], "chunk": chunk, "seq": [seq, seq + 1], "local": local, "fresh": False, "kind": [LAST, ALL]})

    for frame in frames:
        out, starts = [], 0
        for k, (who, ids) in enumerate(zip(frame["indicator_id"], frame["ids"])):
            if who != at:
                if at is not None:
                    if k > starts:
                        yield frame.iloc[starts:k].assign(**_columns(out), chunk=chunk, kind=OBSERVED)
                    yield ends()
                    seq, out, starts = seq + 2, [], k
                at, local, held, met = who, 0, set(), set()
            ids = set(ids)
            fresh = bool(ids) and ids.isdisjoint(met)
            if ids and held and ids.isdisjoint(held):
                local, held = local + 1, ids
            else:
                held = held | ids
            met |= ids
            out.append((seq, local, fresh))
            seq += 1
        if len(frame) > starts:
            yield frame.iloc[starts:].assign(**_columns(out), chunk=chunk, kind=OBSERVED)
    if at is not None:
        yield ends()


def _columns(out: list[tuple]) -> dict[str, list]:
    return {name: [x[i] for x in out] for i, name in enumerate(("seq", "local", "fresh"))}


def _carry(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """What holds where each part of a chunk begins: the epoch, and from which row on the local epochs count,
    by how much more. Rows: fresh observations and ends, by indicator, chunk and seq."""
    at, epoch, held = None, 0, set()
    chunk, opened, last, out = None, None, set(), []
    for frame in frames:
        for who, k, seq, local, kind, ids in frame[["indicator_id", "chunk", "seq", "local", "kind", "ids"]].itertuples(index=False):
            if who != at:
                at, epoch, held, chunk = who, 0, set(), None
            if k != chunk:
                chunk, opened = k, None
            ids = set(ids)
            if kind == OBSERVED:
                # what overlaps `held`, or an observation of the chunk before it, opens nothing
                if opened is None and ids.isdisjoint(held):
                    opened = seq, local, 1 if held else 0
            elif kind == LAST:
                last, ended = ids, local
            else:
                first, own, new = opened or (None, 0, 0)
                out.append((at, chunk, epoch, first, new - own))
                if opened is None:
                    held = held | ids
                else:
                    epoch, held = epoch + new + ended - own, last
        if len(out) > 10_000:
            yield _carried(out)
            out = []
    yield _carried(out)


def _carried(out: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(out, columns=["indicator_id", "chunk", "before", "from_seq", "more"]).astype({"from_seq": "Int64"})


def _chunks(rows: DataFrame, chunk_rows: int) -> DataFrame:
    """rows sorted by ranges into chunks, each folded by itself. A chunk is read as it comes, so its size is bound
    by no memory: where chunks of `chunk_rows` would be too many for the driver, they are larger."""
    chosen = rows.select(*ORDER, "ids")
    least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = min(max(least, -(-chosen.count() // chunk_rows)), MOST_CHUNKS * max(least, 32))
    types = ", ".join(f"{c} {t}" for c, t in chosen.dtypes)
    folded = chosen.repartitionByRange(parts, *ORDER).sortWithinPartitions(*ORDER).mapInPandas(_fold_chunk, f"{types}, chunk int, seq long, local int, fresh boolean, kind int")
    return stash(folded, "chunks")


def _scanned(rows: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Long histories as a segmented scan: sorted into chunks by ranges, so that one indicator spreads over
    many; each chunk is folded by itself, a carry over the chunks' summaries tells what is open where a
    chunk begins, and the two are joined.

    This is exact: until the epoch that is open at its beginning ends, a chunk opens no epoch; it ends at the
    chunk's first fresh observation that has none of its identities; and from a fresh observation
    on a chunk's own fold is right, since that one opens an epoch whatever came before it in the chunk. The
    carry reads only fresh observations and two rows for each part."""
    folded = _chunks(rows, chunk_rows)
    told = folded.where((F.col("kind") != OBSERVED) | F.col("fresh")).select("indicator_id", "chunk", "seq", "local", "kind", "ids")
    carry = told.repartition("indicator_id").sortWithinPartitions("indicator_id", "chunk", "seq").mapInPandas(_carry, "indicator_id string, chunk int, before int, from_seq long, more int")
    placed = folded.where(F.col("kind") == OBSERVED).join(carry, ["indicator_id", "chunk"])
    own = F.coalesce(F.col("seq") >= F.col("from_seq"), F.lit(False))
    epoch = F.col("before") + F.when(own, F.col("local") + F.col("more")).otherwise(F.lit(0))
    return placed.select(*ORDER, "ids", epoch.cast("int").alias("epoch"))


def assign_epochs(rows: DataFrame, fold_limit: int = FOLD_LIMIT, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """histories() with epoch: a new one begins only where an observation has identities, the epoch has
    some too, and they have none in common; else its identities join the epoch's.

    Short histories are folded in the JVM; those above `fold_limit` are scanned in chunks, so no task
    gathers or reads one of them whole. rows are written once (`stash`): they are read more than once."""
    rows = stash(rows, "histories")
    sizes = rows.groupBy("indicator_id").agg(F.count("*").alias("n")).where(F.col("n") > fold_limit).select("indicator_id")
    columns = [*ORDER, "ids", "epoch"]
    if sizes.isEmpty():
        return _folded(rows).select(*columns)
    short, long = rows.join(sizes, "indicator_id", "left_anti"), rows.join(sizes, "indicator_id", "left_semi")
    return _folded(short).select(*columns).unionByName(_scanned(long, chunk_rows).select(*columns))


def _ordered(assigned: DataFrame, limit: int = CHUNK_ROWS) -> DataFrame:
    """assigned with nth within its epoch. Epochs above `limit` rows are numbered within ranges and the ranges'
    sums are added, so no task sorts one of them."""
    key, order = ["indicator_id", "epoch"], ["effective_at", "collected_at", "observation_id"]
    nth = F.row_number().over(Window.partitionBy(*key).orderBy(*order)).cast("long")
    sizes = assigned.groupBy(*key).count()
    large = stash(sizes.where(F.col("count") > limit), "large_epochs")
    if large.isEmpty():
        return assigned.withColumn("nth", nth)
    parts = -(-large.agg(F.sum("count")).first()[0] // limit)
    many = assigned.join(large.select(*key), key, "left_semi").repartitionByRange(parts, *key, *order)
    many = stash(many.withColumn("_range", F.spark_partition_id()), "ranges")
    held = many.groupBy(*key, "_range").count()
    before = F.coalesce(F.sum("count").over(Window.partitionBy(*key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.row_number().over(Window.partitionBy(*key, "_range").orderBy(*order))
    numbered = many.withColumn("nth", inside).join(held.withColumn("_before", before).drop("count"), [*key, "_range"])
    numbered = numbered.withColumn("nth", F.col("nth") + F.col("_before")).select(*assigned.columns, "nth")
    return assigned.join(large.select(*key), key, "left_anti").withColumn("nth", nth).unionByName(numbered)


def entity_epochs(assigned: DataFrame, resolution_version: str = "v1", open_last: bool = False, chunk: int = CHUNK) -> DataFrame:
    """One row for each epoch, with bounds, number of observations and identities.

    Its id is a hash over its observations in order, taken in chunks: the observations of an epoch,
    however many, are sorted but never gathered in one row. `epoch_members` has them as rows."""
    key, assigned = ["indicator_id", "epoch"], stash(assigned, "assigned")
    out = assigned.groupBy(*key).agg(F.min("effective_at").alias("valid_from"), F.max("effective_at").alias("valid_to"), F.count("*").alias("observations"), F.max("collected_at").alias("available_at"))
    each = assigned.select(*key, F.explode("ids").alias("identity")).distinct().groupBy(*key).agg(F.array_sort(F.collect_list("identity")).alias("identity_feature_ids"))
    parts = _ordered(assigned).groupBy(*key, F.floor((F.col("nth") - 1) / chunk).alias("part")).agg(F.array_sort(F.collect_list(F.struct("nth", "observation_id"))).alias("o"))
    parts = parts.select(*key, "part", sha256_text(F.array_join(F.transform("o", lambda x: x["observation_id"]), "|")).alias("hash"))
    hashes = parts.groupBy(*key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "hash"))), lambda x: x["hash"]), "|").alias("hashes"))
    out = out.join(hashes, key).join(each, key, "left").withColumn("identity_feature_ids", F.coalesce("identity_feature_ids", F.array().cast("array<string>")))
    out = out.withColumn("entity_epoch_id", joined_id("entity-epoch", F.col("indicator_id"), F.lit(resolution_version), F.col("hashes"))).withColumn("resolution_version", F.lit(resolution_version)).drop("hashes")
    if open_last:
        last = F.max("epoch").over(Window.partitionBy("indicator_id"))
        out = out.withColumn("valid_to", F.when(F.col("epoch") < last, F.col("valid_to")))
    return out


def epoch_members(assigned: DataFrame, epochs: DataFrame) -> DataFrame:
    """entity_epoch_id, nth and observation_id of every observation, in the order of its epoch."""
    own = epochs.select("indicator_id", "epoch", "entity_epoch_id")
    return _ordered(assigned).join(own, ["indicator_id", "epoch"]).select("entity_epoch_id", "nth", "observation_id")
