"""The prospective path as Structured Streaming: replays change nothing, late rows are never lost."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.text import is_ip
from ..operators import scan
from ..operators.prospective import candidates, execution_status, time_status
from ..sources import ledger


def stream_table(spark: SparkSession, folder: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


def classify_times(hosts: DataFrame, valid_from: Column) -> DataFrame:
    """Stateless: each observation's effective time and prospective class."""
    return hosts.withColumn("effective_at", F.coalesce("observed_at", "collected_at")).withColumn("time_status", time_status(F.col("observed_at"), valid_from))


def label_executions(executions: DataFrame) -> DataFrame:
    """Executions with their opportunity's state; late ones are labelled, never dropped."""
    return executions.withColumn("opportunity_status", execution_status(F.col("execution"), F.col("executed_at"), F.col("window_end")))


def normalize_stream(pages: DataFrame, runs: DataFrame, known_ips: DataFrame, valid_from: Column) -> DataFrame:
    """A stream of scan pages (run_id, page_number, page) as observations, a row for each hit: what
    `scan.normalize` and `prospective_events` say, without state. runs and known_ips are tables.

    services is an array of the hit's service observations; time_status is that of the earliest record,
    unresolved where one lacks its time; record_time_statuses has each record's. A run on one
    address whose only page shows none gives the negative row. reason is as for pages at rest, but for an address
    that a run shows again: `write_observations` keeps the first."""
    host = scan.placed(scan.host_rows(pages), runs, known_ips)
    fields = lambda s: F.struct(*[c.alias(n) for n, c in scan.service_fields(s, F.col("observation_id"), F.col("observed_at")).items()])
    good = scan.observed_hosts(host).withColumn("services", F.filter(F.transform("services", fields), lambda s: s["port"].between(1, 65535)))
    names = F.transform("services", lambda s: s["service_observation_id"])
    good = good.withColumn("services", F.filter("services", lambda s, i: F.array_position(names, s["service_observation_id"]) == i + 1))
    own = F.struct(F.col("observation_id").alias("key"), time_status(F.col("observed_at"), valid_from).alias("value"))
    others = F.transform("services", lambda s: F.struct(s["service_observation_id"].alias("key"), time_status(s["observed_at"], valid_from).alias("value")))
    gap = F.col("observed_at").isNull() | F.exists("services", lambda s: s["observed_at"].isNull())
    first = F.least("observed_at", F.array_min(F.transform("services", lambda s: s["observed_at"])))
    good = good.withColumn("record_time_statuses", F.map_from_entries(F.array_sort(F.concat(F.array(own), others)))).withColumn("time_status", time_status(F.when(~gap, first), valid_from))
    columns = [*scan.HOST_COLUMNS, "page_number", "hit_pos", "reason", "services", "record_time_statuses", "time_status"]
    address = lambda h: F.coalesce(is_ip(F.coalesce(*[F.try_variant_get(h, f"{p}.ip", "string") for p in scan.HOST])), F.lit(False))
    empty = scan.page_hits(pages).where(F.col("page_number") == 1).where(F.col("next_token").isNull() & ~F.exists("hits", address))
    silent = empty.select("run_id").join(runs.where("query_class = 'q0_seed'"), "run_id")
    none = scan.not_found(silent).withColumn("page_number", F.lit(1)).withColumn("hit_pos", F.lit(0))
    return good.select(*columns).unionByName(none.select(*scan.HOST_COLUMNS, "page_number", "hit_pos"), allowMissingColumns=True)


def write_observations(observations: DataFrame, root: str, checkpoint: str):
    """normalize_stream into the ledgers <root>/hosts and <root>/services and the table <root>/refused. Of an
    address that a run shows more than once in a batch the first hit is taken; what a ledger has stays."""
    def write(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        good = batch.where("reason IS NULL").groupBy("observation_id").agg(F.min_by(F.struct(*[c for c in batch.columns if c != "observation_id"]), F.struct("page_number", "hit_pos")).alias("r"))
        good = good.select("observation_id", "r.*")
        hosts = good.select(*scan.HOST_COLUMNS, "time_status", F.to_json("record_time_statuses").alias("record_time_statuses"))
        ledger.append(hosts, f"{root}/hosts", ["observation_id"])
        ledger.append(good.select("observation_id", F.explode("services").alias("s")).select("observation_id", "s.*"), f"{root}/services", ["service_observation_id"])
        # a batch that is written again replaces itself
        batch.where("reason IS NOT NULL").select("query_run_id", "observation_id", "reason").write.mode("overwrite").parquet(f"{root}/refused/batch={number}")
        batch.unpersist()

    return observations.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def to_ledger(stream: DataFrame, path: str, key: list[str], checkpoint: str, earliest: str | None = None):
    """Append a stream to an immutable table; a batch that is seen again inserts nothing."""
    def write(batch: DataFrame, _: int) -> None:
        ledger.append(batch, path, key, earliest)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


class NewKeys(StatefulProcessor):
    """The earliest row of each key in the first batch that has the key; later rows of it are held back as long
    as the state remembers it. Nothing is dropped for being late."""

    def __init__(self, columns: list[str], order: list[str], remember_ms: int | None):
        self.columns, self.order, self.remember_ms = columns, order, remember_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "seen boolean", ttlDurationMs=self.remember_ms)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        if self.seen.exists():
            return
        best = None
        for frame in rows:
            some = frame if best is None else pd.concat((best, frame))
            best = some.sort_values(self.order, kind="stable").head(1)
        self.seen.update((True,))
        yield best[self.columns]

    def close(self) -> None:
        pass


def new_keys(rows: DataFrame, key: list[str], order: list[str], remember: str | None = None) -> DataFrame:
    """A stream with one row for each key: the earliest (by order) of the batch that first has it.

    With `remember` a key's state goes after that time and the key may come out again, so what follows must bear
    replays, as ledgers do. Clocks make such a query run on and on: it is for triggers at intervals, not for
    runs over what is available now."""
    processor = NewKeys(rows.columns, order, int(pd.Timedelta(remember).total_seconds() * 1000) if remember else None)
    return rows.groupBy(*key).transformWithStateInPandas(statefulProcessor=processor, outputStructType=rows.schema, outputMode="Append", timeMode="ProcessingTime" if remember else "None")


def first_candidates(events: DataFrame, path: str, key: list[str], checkpoint: str, hold_back: bool = False, remember: str | None = None):
    """First candidates of a stream of events: a batch's firsts are appended unless the table has the
    candidate; what is there is never overwritten, however late an earlier event comes.

    With `hold_back`, events of keys that came before are held back by state (see `new_keys`), so that they do not
    reach the table's index; the table stays the truth and is the same either way."""
    if hold_back:
        events = new_keys(events.where("time_status = 'eligible'"), key, ["observed_at", "event_id"], remember)

    def write(batch: DataFrame, _: int) -> None:
        ledger.append(candidates(batch, key), path, ["candidate_id"])

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def streaming_slots(opportunities: DataFrame, executions: DataFrame, delay: str = "1 hour", grace: str = "7 days") -> DataFrame:
    """opportunity_id, status, at from streams of opportunities (opportunity_id, due_at, window_end) and
    executions (opportunity_id, executed_at, status): `missed` (at the window's end) once the watermark has passed
    the window and no complete execution came in it, `late` for each execution after it.

    Both are joins of the streams, whose state Spark keeps: a slot for `grace` after its window, and
    executions after that are of an unknown slot. Executions may come before their slot, so complete ones are
    kept. The watermark is the earlier of the two streams': each must move on for windows to end."""
    grace = f"interval {int(pd.Timedelta(grace).total_seconds() * 1000)} milliseconds"
    t = lambda c: F.col(c).cast("timestamp")
    slots = opportunities.select("opportunity_id", t("window_end").alias("window_end")).withWatermark("window_end", delay)
    # a slot that comes again before its window has ended is the same slot; after that it is behind the watermark
    slots = slots.dropDuplicatesWithinWatermark(["opportunity_id"])
    runs = executions.select(F.col("opportunity_id").alias("_slot"), t("executed_at").alias("executed_at"), "status").withWatermark("executed_at", delay)
    own = F.col("opportunity_id") == F.col("_slot")
    hits = slots.join(runs.where("status = 'complete'"), own & (F.col("executed_at") < F.col("window_end")), "left")
    missed = hits.where("_slot is null").select("opportunity_id", F.lit("missed").alias("status"), F.col("window_end").alias("at"))
    after = slots.join(runs, own & (F.col("executed_at") >= F.col("window_end")) & (F.col("executed_at") <= F.col("window_end") + F.expr(grace)))
    return missed.unionByName(after.select("opportunity_id", F.lit("late").alias("status"), F.col("executed_at").alias("at")))


class EpochProcessor(StatefulProcessor):
    """Epochs of one indicator from rows out of order.

    Rows wait until the watermark has passed their bucket of time and are then taken in order of
    (effective_at, collected_at, observation_id). What a batch brings is filed in pieces of up to PIECE rows in order of
    time, each under its first bucket with a timer at that bucket's end, so a batch costs what it brings however
    many buckets it meets. A piece is read when its timer fires; rows that are not over are filed again by
    distances that double, so that a row is filed a number of times that grows with the logarithm of its
    wait. Rows behind the watermark do not get here: Spark holds them back. Should one of a bucket that was taken before
    come, it goes to the epoch open at the time, marked late.
    """

    #: Rows of a piece.
    PIECE = 1000

    def __init__(self, bucket_ms: int):
        self.bucket_ms = bucket_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "bucket long, nth long", "rows array<struct<effective_at timestamp, collected_at timestamp, observation_id string, ids array<string>>>")
        self.filed = handle.getValueState("filed", "pieces long, over long")
        self.open = handle.getValueState("open", "epoch int, held array<string>, taken long")

    def _bucket(self, t: Any) -> int:
        return pd.Timestamp(t).value // (self.bucket_ms * 1_000_000)

    def _file(self, groups: list[list[tuple]], n: int) -> int:
        """Files groups of rows, each in order of time; the number of the next piece."""
        ends = set()
        for rows in groups:
            for at in range(0, len(rows), self.PIECE):
                bucket = self._bucket(rows[at][0])
                self.waiting.updateValue((bucket, n), (rows[at:at + self.PIECE],))
                ends.add((bucket + 1) * self.bucket_ms)
                n += 1
        for end in ends:
            self.handle.registerTimer(end)
        return n

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        epoch, _, taken = self.open.get() if self.open.exists() else (0, [], None)
        new, late = [], []
        for f in rows:
            for t, c, o, ids in zip(f["effective_at"], f["collected_at"], f["observation_id"], f["ids"]):
                if taken is not None and self._bucket(t) <= taken:
                    late.append((key[0], o, t, epoch, True))
                else:
                    new.append((t.to_pydatetime(), None if pd.isna(c) else c.to_pydatetime(), o, list(ids)))
        if new:
            n, over = self.filed.get() if self.filed.exists() else (0, None)
            self.filed.update((self._file([sorted(new, key=lambda r: r[0])], n), over))
        if late:
            yield pd.DataFrame(late, columns=EPOCHS)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        # timers of a key may come in any order: the first takes all buckets that are over, the oldest first
        over = timerValues.getCurrentWatermarkInMs() // self.bucket_ms
        n, before = self.filed.get()
        if before == over:
            return
        pieces, rows = sorted(k for k in self.waiting.keys() if k[0] < over), []
        for i, piece in enumerate(pieces):
            rows += [tuple(r) for r in self.waiting.getValue(piece)[0]]
            self.waiting.removeKey(piece)
            # the pieces to come begin there
            until = pieces[i + 1][0] if i + 1 < len(pieces) else over
            ready, rows = [r for r in rows if self._bucket(r[0]) < until], [r for r in rows if self._bucket(r[0]) >= until]
            if ready:
                yield from self._take(key, ready)
        groups: dict[int, list] = {}
        for r in sorted(rows, key=lambda r: r[0]):
            groups.setdefault((self._bucket(r[0]) - over + 1).bit_length(), []).append(r)
        self.filed.update((self._file(list(groups.values()), n), over))

    def _take(self, key: Any, rows: list) -> Iterator[pd.DataFrame]:
        epoch, held, _ = self.open.get() if self.open.exists() else (0, [], None)
        held, out = set(held), []
        for t, _, o, ids in sorted(rows, key=lambda r: (r[0], r[1] is not None, r[1], r[2])):
            ids = set(ids)
            if ids and held and ids.isdisjoint(held):
                epoch, held = epoch + 1, ids
            else:
                held |= ids
            out.append((key[0], o, pd.Timestamp(t), epoch, False))
        self.open.update((epoch, sorted(held), self._bucket(out[-1][2])))
        yield pd.DataFrame(out, columns=EPOCHS)

    def close(self) -> None:
        pass


EPOCHS = ["indicator_id", "observation_id", "effective_at", "epoch", "late"]


def streaming_epochs(histories: DataFrame, delay: str = "1 hour", bucket: str = "1 hour") -> DataFrame:
    """indicator_id, observation_id, effective_at, epoch, late from a stream of histories
    (indicator_id, observation_id, effective_at, ids and, if there is, collected_at). Rows later than `delay` are
    left out, as in every query with a watermark: a ledger (`to_ledger`) beside this one keeps them."""
    known = F.col("collected_at") if "collected_at" in histories.columns else F.col("effective_at")
    rows = histories.select("indicator_id", "observation_id", F.col("effective_at").cast("timestamp").alias("effective_at"), known.cast("timestamp").alias("collected_at"), "ids").withWatermark("effective_at", delay)
    schema = "indicator_id string, observation_id string, effective_at timestamp, epoch int, late boolean"
    processor = EpochProcessor(int(pd.Timedelta(bucket).total_seconds() * 1000))
    return rows.groupBy("indicator_id").transformWithStateInPandas(statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode="EventTime")


def run_to_end(writer, start: Callable | None = None) -> None:
    """Run what is available and stop."""
    query = (start or (lambda w: w.trigger(availableNow=True).start()))(writer)
    query.awaitTermination()
