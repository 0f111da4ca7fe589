"""The streaming forms: replays, late rows and order."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from infratrace.operators import epochs
from infratrace.streaming import prospective as streaming

T0 = datetime(2026, 1, 1)
EVENT = "event_id string, indicator_id string, observed_at timestamp, time_status string, query_id string, entity_epoch_id string"


def test_first_candidates_are_never_overwritten(spark, tmp_path):
    source, table = f"{tmp_path}/events", f"file://{tmp_path}/candidates"
    rows = [("e1", "i", T0, "eligible", "q", "x"), ("e2", "i", T0 + timedelta(days=1), "eligible", "q", "x"), ("e3", "i", T0, "unresolved", "q", "y")]
    spark.createDataFrame(rows, EVENT).coalesce(1).write.parquet(source)
    run = lambda: streaming.run_to_end(streaming.first_candidates(streaming.stream_table(spark, source, EVENT), table, ["query_id", "entity_epoch_id"], f"{tmp_path}/check"))
    run()
    spark.createDataFrame([("e0", "i", T0 - timedelta(days=1), "eligible", "q", "x"), ("e4", "i", T0, "eligible", "q", "z")], EVENT).coalesce(1).write.mode("append").parquet(source)
    run()
    got = {r["entity_epoch_id"]: r["first_observation_event_id"] for r in spark.read.parquet(table).collect()}
    assert got == {"x": "e1", "z": "e4"}


def test_ledger_replay_inserts_nothing(spark, tmp_path):
    source, table = f"{tmp_path}/rows", f"file://{tmp_path}/ledger"
    schema = "id string, v int"
    for _ in range(2):
        spark.createDataFrame([("a", 1), ("b", 2)], schema).coalesce(1).write.mode("append").parquet(source)
    writer = streaming.to_ledger(streaming.stream_table(spark, source, schema, 1), table, ["id"], f"{tmp_path}/check")
    streaming.run_to_end(writer)
    assert spark.read.parquet(table).count() == 2


def test_epochs_out_of_order_match_the_batch(spark, tmp_path):
    rng = random.Random(5)
    rows = [(f"i{k % 3}", T0 + timedelta(hours=k), f"o{k:03d}", sorted({f"c{rng.randint(0, 3)}" for _ in range(rng.randint(0, 2))})) for k in range(90)]
    schema = "indicator_id string, effective_at timestamp, observation_id string, ids array<string>"
    # neighbours are shuffled within what the watermark waits for; a last row moves it past all others
    chunks = [rows[at:at + 30] for at in range(0, 90, 30)]
    for chunk in chunks:
        rng.shuffle(chunk)
    last = [(f"i{k}", T0 + timedelta(days=30), f"end{k}", []) for k in range(3)]
    for n, chunk in enumerate([*chunks, last, [("i0", T0 + timedelta(days=31), "flush", [])]]):
        spark.createDataFrame(chunk, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/h")
    stream = streaming.streaming_epochs(streaming.stream_table(spark, f"{tmp_path}/h", schema, 1), "36 hours")
    query = stream.writeStream.format("memory").queryName("epochs_out").option("checkpointLocation", f"{tmp_path}/check").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    got = {r["observation_id"]: r["epoch"] for r in spark.table("epochs_out").collect() if not r["late"]}
    df = spark.createDataFrame(rows, schema).withColumn("collected_at", F.col("effective_at"))
    want = {r["observation_id"]: r["epoch"] for r in epochs.assign_epochs(df).collect()}
    assert got and all(want[k] == v for k, v in got.items() if k in want)


def test_epochs_of_quiet_indicators_come_out(spark, tmp_path):
    schema = "indicator_id string, effective_at timestamp, observation_id string, ids array<string>"
    rows = [(f"i{k % 3}", T0 + timedelta(hours=k, microseconds=k), f"o{k:02d}", [f"c{k // 12}"]) for k in range(36)]
    # only another indicator moves the watermark on
    for chunk in (rows[:20], rows[20:], [("other", T0 + timedelta(days=30), "mark", [])]):
        spark.createDataFrame(chunk, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/h")
    stream = streaming.streaming_epochs(streaming.stream_table(spark, f"{tmp_path}/h", schema, 1), "36 hours")
    query = stream.writeStream.format("memory").queryName("quiet_out").option("checkpointLocation", f"{tmp_path}/check").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    got = sorted((r["observation_id"], r["epoch"], r["late"]) for r in spark.table("quiet_out").collect())
    assert got == [(o, int(ids[0][1:]), False) for _, _, o, ids in rows]


def test_times_and_late_executions_are_labelled(spark):
    h = spark.createDataFrame([("a", T0, T0), ("b", None, T0)], "observation_id string, observed_at timestamp, collected_at timestamp")
    assert [r["time_status"] for r in streaming.classify_times(h, F.lit(T0)).collect()] == ["eligible", "unresolved"]
    e = spark.createDataFrame([("complete", T0 + timedelta(days=2), T0)], "execution string, executed_at timestamp, window_end timestamp")
    assert [r["opportunity_status"] for r in streaming.label_executions(e).collect()] == ["late"]


def _to_memory(spark, told, name, check):
    told.writeStream.format("memory").queryName(name).option("checkpointLocation", check).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.table(name).collect()


def test_epochs_take_ties_by_collection(spark, tmp_path):
    schema = "indicator_id string, effective_at timestamp, collected_at timestamp, observation_id string, ids array<string>"
    hour = lambda k: T0 + timedelta(hours=k)
    first = [("i", hour(5), hour(9), "a", ["x"]), ("i", hour(5), hour(7), "b", ["y"]), ("i", hour(5), hour(8), "c", ["y", "x"])]
    deliveries = [first, [("i", hour(60), hour(60), "d", ["z"])], [("i", hour(61), hour(61), "e", [])], [("i", hour(4), hour(61), "late", ["q"])], [("end", hour(900), hour(900), "x", [])], [("end", hour(901), hour(901), "y", [])]]
    for rows in deliveries:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/h")
    told = streaming.streaming_epochs(streaming.stream_table(spark, f"{tmp_path}/h", schema, 1), "2 hours", "3 hours")
    got = {r["observation_id"]: (r["epoch"], r["late"]) for r in _to_memory(spark, told, "ties_out", f"{tmp_path}/check")}
    # by collection b, c, a: one epoch; by name a would end before b
    assert {k: got[k] for k in "abcde"} == {"b": (0, False), "c": (0, False), "a": (0, False), "d": (1, False), "e": (1, False)}
    assert "late" not in got  # behind the watermark


def test_slots_are_missed_by_timer(spark, tmp_path):
    day = lambda k: T0 + timedelta(days=k)
    slots = [(f"s{k}", day(k), day(k + 7)) for k in range(5)] + [("end", day(400), day(401))]
    runs = [("s0", day(1), "complete"), ("s1", day(2), "failed"), ("s2", day(12), "complete"), ("s3", day(4), "partial"), ("s3", day(5), "complete"), ("nobody", day(1), "complete")]
    spark.createDataFrame(slots, "opportunity_id string, due_at timestamp, window_end timestamp").coalesce(1).write.parquet(f"{tmp_path}/slots")
    spark.createDataFrame(runs, "opportunity_id string, executed_at timestamp, status string").coalesce(1).write.parquet(f"{tmp_path}/runs")
    read = lambda name, schema: streaming.stream_table(spark, f"{tmp_path}/{name}", schema)
    told = streaming.streaming_slots(read("slots", "opportunity_id string, due_at timestamp, window_end timestamp"), read("runs", "opportunity_id string, executed_at timestamp, status string"))
    got = sorted((r["opportunity_id"], r["status"], r["at"]) for r in _to_memory(spark, told, "slots_out", f"{tmp_path}/check") if r["opportunity_id"] != "end")
    assert got == [("s1", "missed", day(8)), ("s2", "late", day(12)), ("s2", "missed", day(9)), ("s4", "missed", day(11))]


def test_keys_that_came_before_are_held_back(spark, tmp_path):
    event = lambda e, k, hours: (e, "i", T0 + timedelta(hours=hours), "eligible", "q", k)
    batches = [[event("e2", "x", 5), event("e1", "x", 4), event("e3", "y", 9)], [event("e0", "x", 0), event("e4", "y", 1)], [event("e5", "z", -900)]]
    for rows in batches:
        spark.createDataFrame(rows, EVENT).coalesce(1).write.mode("append").parquet(f"{tmp_path}/events")
    read = lambda: streaming.stream_table(spark, f"{tmp_path}/events", EVENT, 1)
    passed = _to_memory(spark, streaming.new_keys(read(), ["entity_epoch_id"], ["observed_at", "event_id"]), "new_out", f"{tmp_path}/c0")
    assert sorted(r["event_id"] for r in passed) == ["e1", "e3", "e5"]  # three of six; the late e5 stays
    for k, hold in enumerate((False, True)):
        streaming.run_to_end(streaming.first_candidates(read(), f"file://{tmp_path}/t{k}", ["entity_epoch_id"], f"{tmp_path}/d{k}", hold))
    tables = [sorted(map(tuple, spark.read.parquet(f"{tmp_path}/t{k}").collect())) for k in range(2)]
    assert tables[0] == tables[1] and len(tables[0]) == 3


def test_page_files_as_a_stream(spark, tmp_path):
    from infratrace.sources import readers

    def page(run, number, text):
        folder = tmp_path / "pages" / run
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"page-{number:03d}.json").write_text(text)

    hit = '{"host":{"ip":"%s","last_updated_at":"2026-01-0%dT00:00:00Z","services":[{"port":443,"protocol":"HTTPS","observed_at":"2026-01-05T00:00:00Z"},{"port":443},{"port":"22"},{"port":70000}]}}'
    page("r1", 1, '{"result":{"hits":[%s,%s,{"host":{}}]}}' % (hit % ("8.8.8.8", 2), hit % ("8.8.8.8", 3)))
    page("r2", 1, '{"result":{"result":{"hits":[]}}}')
    page("r3", 1, '{"hits":[%s]}' % (hit % ("9.9.9.9", 4)))
    page("r4", 1, "no json")
    run = "run_id string, query_class string, exact_ip string, indicator_id string, collected_at timestamp"
    runs = spark.createDataFrame([("r1", "q1", None, None, T0 + timedelta(days=9)), ("r2", "q0_seed", "1.1.1.1", "ioc-1", T0), ("r3", "q0_seed", "1.1.1.2", "ioc-2", T0 + timedelta(days=9)), ("r4", "q1", None, None, T0)], run)
    known = spark.createDataFrame([("8.8.8.8", "ioc-8")], "ip string, indicator_id string")

    def deliver():
        pages = readers.scan_pages(spark, f"{tmp_path}/pages", stream=True)
        told = streaming.normalize_stream(pages, runs, known, F.lit(T0 + timedelta(days=2)))
        streaming.run_to_end(streaming.write_observations(told, f"file://{tmp_path}/out", f"{tmp_path}/check"))

    deliver()
    page("r5", 1, '{"hits":[%s]}' % (hit % ("8.8.4.4", 4)))
    page("r1", 2, '{"hits":[%s]}' % (hit % ("8.8.8.8", 9)))  # the run shows it again: what is there stays
    runs = runs.unionAll(spark.createDataFrame([("r5", "q1", None, None, T0 + timedelta(days=9))], run))
    deliver()
    hosts = {r["query_run_id"]: r for r in spark.read.parquet(f"{tmp_path}/out/hosts").collect()}
    assert set(hosts) == {"r1", "r2", "r5"}
    assert hosts["r1"]["indicator_id"] == "ioc-8" and hosts["r1"]["observed_at"] == T0 + timedelta(days=1) and hosts["r1"]["time_status"] == "pre_freeze"
    assert (hosts["r2"]["host_observed"], hosts["r2"]["negative_reason"], hosts["r2"]["indicator_id"]) == (False, "not_found", "ioc-1")
    assert hosts["r5"]["time_status"] == "eligible" and hosts["r5"]["record_time_statuses"].count("eligible") == 3
    ports = sorted((r["observation_id"], r["port"], r["protocol"]) for r in spark.read.parquet(f"{tmp_path}/out/services").collect())
    assert len(ports) == 4 and {p[1] for p in ports} == {22, 443}
    refused = [(r["query_run_id"], r["reason"]) for r in spark.read.parquet(f"{tmp_path}/out/refused").collect()]
    assert refused == [("r3", "q0_other_ip")]


def test_slots_that_come_late_or_twice(spark, tmp_path):
    day = lambda k: T0 + timedelta(days=k)
    slot, run = "opportunity_id string, due_at timestamp, window_end timestamp", "opportunity_id string, executed_at timestamp, status string"
    # the second delivery repeats a slot and has one that was due before the watermark, whose window is open
    for name, schema, deliveries in (("slots", slot, [[("a", day(0), day(40)), ("b", day(0), day(12)), ("d", day(30), day(39))], [("a", day(0), day(40)), ("c", day(1), day(50))], [("end", day(400), day(401))]]), ("runs", run, [[("d", day(35), "complete"), ("b", day(13), "complete")], [("a", day(41), "complete")], [("end", day(400), "failed")]])):
        for rows in deliveries:
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}")
    told = streaming.streaming_slots(streaming.stream_table(spark, f"{tmp_path}/slots", slot, 1), streaming.stream_table(spark, f"{tmp_path}/runs", run, 1))
    got = sorted((r["opportunity_id"], r["status"], r["at"]) for r in _to_memory(spark, told, "slots_again", f"{tmp_path}/check") if r["opportunity_id"] != "end")
    assert got == [("a", "late", day(41)), ("a", "missed", day(40)), ("b", "late", day(13)), ("b", "missed", day(12)), ("c", "missed", day(50))]


class _State(dict):
    """A handle, a map and a value in memory, as far as EpochProcessor asks."""

    def __init__(self):
        self.writes, self.timers, self.value = 0, set(), None

    getMapState = getValueState = lambda self, name, *_: self.setdefault(name, _State())
    registerTimer = lambda self, at: self.timers.add(at)
    exists = lambda self: self.value is not None
    getValue = dict.get
    containsKey = dict.__contains__
    removeKey = dict.pop
    get = lambda self: self.value

    def update(self, value):
        self.value = value

    def updateValue(self, key, value):
        self[key], self.writes = value, self.writes + 1

    def getCurrentWatermarkInMs(self):
        return self.value


def test_epochs_file_a_batch_not_its_buckets():
    import pandas as pd

    hour, base = 3_600_000, int(pd.Timestamp(T0).value // 1_000_000)
    rng, handle, clock = random.Random(3), _State(), _State()
    processor = streaming.EpochProcessor(hour)
    processor.init(handle)
    rows = [(pd.Timestamp(T0) + pd.Timedelta(minutes=rng.randint(0, 60 * 720)), pd.NaT, f"o{k:03d}", [f"c{rng.randint(0, 3)}"]) for k in range(500)]
    frame = lambda part: pd.DataFrame(part, columns=["effective_at", "collected_at", "observation_id", "ids"])
    list(processor.handleInputRows(("i",), iter([frame(rows)]), clock))
    assert handle["waiting"].writes == 1 and len(handle.timers) == 1  # not one for each of some 360 hours
    out, steps = [], 0
    while handle.timers:  # the watermark moves on by an hour
        steps += 1
        clock.value = base + steps * hour
        for at in sorted(t for t in handle.timers if t <= clock.value):
            handle.timers.discard(at)
            out += [r for f in processor.handleExpiredTimer(("i",), clock, None) for r in f.itertuples(index=False)]
    assert not handle["waiting"] and steps <= 722
    want, epoch, held = [], 0, set()
    for t, _, o, ids in sorted(rows, key=lambda r: (r[0], r[2])):
        epoch, held = (epoch + 1, set(ids)) if held and held.isdisjoint(ids) else (epoch, held | set(ids))
        want.append((o, epoch))
    assert [(r.observation_id, r.epoch) for r in out] == want
    assert handle["waiting"].writes < 720  # pieces, by doubling distances


def test_page_logs_give_what_page_files_give(spark, tmp_path):
    import json

    from infratrace.sources import readers

    pages = [("r1", 1, {"result": {"hits": [{"ip": "8.8.8.8", "note": "a\nb"}], "next_page_token": "t"}}), ("r1", 12, {"hits": []}), ("r2", 1, {"é": None})]
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "a.jsonl").write_text("".join(json.dumps({"run_id": r, "page_number": n, "page": p}) + "\n\n" for r, n, p in pages) + "no json\n")
    for r, n, p in pages:
        (tmp_path / "files" / r).mkdir(parents=True, exist_ok=True)
        (tmp_path / "files" / r / f"page-{n:03d}.json").write_text(json.dumps(p))
    rows = lambda df: sorted(tuple(r) for r in df.where("run_id is not null").selectExpr("run_id", "page_number", "to_json(page)").collect())
    want = rows(readers.scan_pages(spark, f"{tmp_path}/files"))
    assert len(want) == 3 and rows(readers.page_log(spark, f"{tmp_path}/log")) == want
    told = readers.page_log(spark, f"{tmp_path}/log", stream=True).selectExpr("run_id", "page_number", "to_json(page) as page").where("run_id is not null")
    assert sorted(map(tuple, _to_memory(spark, told, "log_out", f"{tmp_path}/check"))) == want
