"""Frozen rules over time: slots, events, first candidates, independent evidence, grades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import iso_text, json_id

#: What an opportunity may become.
OPPORTUNITY_MOVES = {"due": ("missed", "partial", "failed", "complete", "late"), "partial": ("partial", "failed", "complete", "late")}
QUERY_MOVES = {"draft": ("validated", "retired"), "validated": ("frozen", "retired"), "frozen": ("retired",)}


def slots(schedules: DataFrame, as_of: Column) -> DataFrame:
    """A row for each slot of schedules (schedule_id, starts_at, interval_hours, ...) due by as_of."""
    step = F.make_dt_interval(F.lit(0), F.col("interval_hours"))
    due = F.when(F.col("starts_at") <= as_of, F.sequence("starts_at", as_of, step))
    return schedules.withColumn("due_at", F.explode(due)).withColumn("window_end", F.col("due_at") + step)


def due_opportunities(schedules: DataFrame, epochs: DataFrame, as_of: Column, bucket_hours: int = 24 * 7) -> DataFrame:
    """Every slot with every epoch that overlaps it: due while its window is open, then missed.

    Both sides are spread over buckets of time and joined on the bucket, so the overlap is an
    equality join whatever the sizes; a pair is kept in the first bucket the two share. Epochs without
    an end reach to the last slot."""
    size = bucket_hours * 3600
    number = lambda t: F.floor(F.unix_seconds(t.cast("timestamp")) / size)
    s = slots(schedules, as_of).withColumn("_b", F.explode(F.sequence(number(F.col("due_at")), number(F.col("window_end")))))
    begun = number(F.col("valid_from"))
    horizon = s.agg(F.coalesce(F.max("_b"), F.lit(0)).alias("_last"))  # one row
    e = epochs.select("entity_epoch_id", "valid_from", "valid_to", begun.alias("_from")).join(F.broadcast(horizon), F.lit(True))
    until = F.least(F.coalesce(number(F.col("valid_to")), F.col("_last")), F.col("_last"))
    e = e.where("_from <= _last").withColumn("_b", F.explode(F.sequence("_from", F.greatest(until, "_from")))).drop("_last")
    told = s.join(e, "_b").where((F.col("valid_from") < F.col("window_end")) & (F.col("valid_to").isNull() | (F.col("valid_to") > F.col("due_at"))))
    told = told.where(F.col("_b") == F.greatest(number(F.col("due_at")), F.col("_from")))
    return told.withColumn("status", F.when(as_of < F.col("window_end"), "due").otherwise("missed")).withColumn("reason", F.when(F.col("status") == "missed", "schedule_window_elapsed")).drop("_b", "_from")


def opportunity_id() -> Column:
    c = F.col
    return json_id("opportunity", query_id=c("query_id"), query_version=c("query_version"), query_hash=c("query_hash"), schedule_id=c("schedule_id"), entity_epoch_id=c("entity_epoch_id"), due_at=iso_text(c("due_at")))


def execution_status(execution: Column, executed_at: Column, window_end: Column) -> Column:
    return (
        F.when(execution == "failed", "failed").when(execution.isin("partial", "partial_max_pages"), "partial").when(execution != "complete", "unsupported")
        .when(executed_at >= window_end, "late").when(execution == "complete", "complete").otherwise("unsupported")
    )


def time_status(observed_at: Column, valid_from: Column) -> Column:
    return F.when(observed_at.isNull(), "unresolved").when(observed_at < valid_from, "pre_freeze").otherwise("eligible")


def prospective_events(hosts: DataFrame, services: DataFrame, valid_from: Column) -> DataFrame:
    """A row for each host: unresolved if a record of it lacks its time, else by the earliest of them.
    valid_from may be a column of hosts."""
    own = hosts.withColumn("valid_from", valid_from)
    records = own.select("observation_id", F.col("observation_id").alias("record_id"), "observed_at").unionAll(services.select("observation_id", "service_observation_id", "observed_at"))
    records = records.join(own.select("observation_id", "valid_from"), "observation_id")
    entry = F.struct(F.col("record_id").alias("key"), time_status(F.col("observed_at"), F.col("valid_from")).alias("value"))
    each = records.groupBy("observation_id").agg(F.bool_or(F.col("observed_at").isNull()).alias("_gap"), F.min("observed_at").alias("_first"), F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("record_time_statuses"))
    told = own.withColumnRenamed("observed_at", "_host_time").join(each, "observation_id").withColumn("observed_at", F.when(~F.col("_gap"), F.col("_first")))
    return told.withColumn("time_status", time_status(F.col("observed_at"), F.col("valid_from"))).drop("_gap", "_first", "_host_time", "valid_from")


def event_gates(events: DataFrame, opportunities: DataFrame, queries: DataFrame, designs: DataFrame) -> DataFrame:
    """reason against each event: its opportunity, epoch, query and versions must agree."""
    o = opportunities.select("opportunity_id", F.col("entity_epoch_id").alias("_epoch"), F.col("query_id").alias("_query"), F.col("query_hash").alias("_hash"))
    q = queries.select(F.col("query_id").alias("_query"), F.col("status").alias("_status"), F.col("query_hash").alias("_query_hash"))
    d = designs.select(F.col("query_id").alias("_query"), F.col("api_schema_version").alias("_api"))
    told = events.join(o, "opportunity_id", "left").join(q, "_query", "left").join(d, "_query", "left")
    c = F.col
    reason = (
        F.when(c("_epoch").isNull(), "opportunity_unknown").when(c("_epoch") != c("entity_epoch_id"), "epoch_mismatch").when(~c("_status").eqNullSafe(F.lit("frozen")), "query_not_frozen").when(c("_hash") != c("_query_hash"), "query_hash_mismatch")
        .when(~c("_api").eqNullSafe(c("api_schema_version")), "api_schema_mismatch").when(c("dataset_split") != "prospective_test", "split_not_prospective").when(~F.coalesce(c("raw_manifest_hash").rlike("^[0-9a-f]{64}$"), F.lit(False)), "manifest_hash_invalid")
    )
    return told.withColumn("reason", reason).select(*events.columns, "reason")


def candidates(events: DataFrame, key: list[str], event_id: str = "event_id", discovery: DataFrame | None = None) -> DataFrame:
    """The first eligible event of each key (query, version, hash, epoch).

    discovery (columns of the key that it has, discovery_feature_id, discovery_source_family_id) gives
    each candidate the sorted, different features and source families that its query was found by."""
    good = events.where("time_status = 'eligible'")
    rest = [x for x in ("indicator_id",) if x not in key]
    first = F.min_by(F.struct(event_id, "observed_at", *rest), F.struct("observed_at", event_id))
    ident = json_id("candidate", **{k: F.col(k) for k in key})
    made = good.groupBy(*key).agg(first.alias("f")).select(ident.alias("candidate_id"), *key, *[f"f.{x}" for x in rest], F.col("f.observed_at").alias("first_candidate_at"), F.col(f"f.{event_id}").alias("first_observation_event_id"))
    if discovery is None:
        return made
    own = [k for k in key if k in discovery.columns]
    ids = lambda c: F.sort_array(F.collect_set(c)).alias(f"{c}s")
    return made.join(discovery.groupBy(*own).agg(ids("discovery_feature_id"), ids("discovery_source_family_id")), own, "left")


def evidence_gate(evidence: DataFrame, candidates: DataFrame) -> DataFrame:
    """evidence with reason, first that holds: unknown candidate, discovery role, same family, feature
    reuse, before the candidate, or a second record of its family. What is not available passes the
    gates between, but counts for its family.

    candidates: candidate_id, first_candidate_at, discovery_feature_ids, discovery_source_family_ids."""
    told = evidence.join(candidates.select("candidate_id", "first_candidate_at", "discovery_feature_ids", "discovery_source_family_ids"), "candidate_id", "left")
    c, free = F.col, F.col("availability") == "available"
    nth = F.row_number().over(Window.partitionBy("candidate_id", "source_family_id").orderBy("available_at", "evidence_id"))
    told = told.withColumn("_n", nth)
    reason = (
        F.when(c("first_candidate_at").isNull(), "unknown_candidate").when(c("role") == "discovery", "discovery_evidence").when(free & F.array_contains("discovery_source_family_ids", c("source_family_id")), "same_source_family")
        .when(free & F.arrays_overlap("feature_ids", "discovery_feature_ids"), "feature_reuse").when(free & (c("available_at") < c("first_candidate_at")), "pre_candidate_evidence")
        .when(free & (c("observed_at") < c("first_candidate_at")), "pre_candidate_observation").when(c("_n") > 1, "family_repeated")
    )
    return told.withColumn("reason", reason).select(*evidence.columns, "reason")


def adjudication_status(evidence: DataFrame, by: list[str]) -> DataFrame:
    """by and the conservative status of its evidence (availability, role, supports_candidate)."""
    c, free = F.col, F.col("availability") == "available"
    judged = free & (c("role") == "validation")
    got = evidence.groupBy(*by).agg(
        F.coalesce(F.bool_or(free & (c("role") == "contradiction")), F.lit(False)).alias("contra"), F.coalesce(F.bool_or(judged & c("supports_candidate")), F.lit(False)).alias("pro"),
        F.coalesce(F.bool_or(judged & ~c("supports_candidate")), F.lit(False)).alias("con"), F.bool_and(c("availability") == "unavailable").alias("none"),
    )
    status = F.when(c("contra") | (c("pro") & c("con")), "contradicted").when(c("pro"), "positive").when(c("con"), "negative").when(c("none"), "unobservable").otherwise("unresolved")
    return got.select(*by, status.alias("status"))


def adjudication_check(adjudications: DataFrame, evidence: DataFrame) -> DataFrame:
    """adjudications (adjudication_id, candidate_id, status, evidence_ids, adjudicator_id, implementer_id)
    with reason: evidence unknown or of another candidate, status not what the evidence says, or the
    adjudicator built the rule."""
    cited = adjudications.select("adjudication_id", F.col("candidate_id").alias("_own"), F.explode_outer("evidence_ids").alias("evidence_id")).join(evidence, "evidence_id", "left")
    bad = cited.groupBy("adjudication_id").agg(F.bool_or(F.col("evidence_id").isNotNull() & ~F.col("candidate_id").eqNullSafe(F.col("_own"))).alias("_foreign"))
    status = adjudication_status(cited.where("candidate_id is not null"), ["adjudication_id"]).withColumnRenamed("status", "_status")
    told = adjudications.join(bad, "adjudication_id", "left").join(status, "adjudication_id", "left")
    reason = F.when(F.col("_foreign"), "evidence_unknown").when(F.col("adjudicator_id") == F.col("implementer_id"), "adjudicator_not_independent").when(F.coalesce("_status", F.lit("unresolved")) != F.col("status"), "status_not_supported")
    return told.withColumn("reason", reason).drop("_foreign", "_status")


def grade_chain(grades: DataFrame, adjudications: DataFrame | None = None, position: str | None = None) -> DataFrame:
    """grade events (candidate_id, grade_event_id, previous_grade_event_id, graded_at) with reason, first
    that holds: adjudication_foreign (with adjudications: adjudication_id, candidate_id),
    previous_mismatch, time_backward, or null.

    Events come in order of `position`, a column that says when they were appended, and the one before
    must be the latest grade so far by time and id; without it in order of time, then id."""
    told, foreign, backward = grades, F.lit(False), F.lit(False)
    if adjudications is not None:
        told = told.join(adjudications.select("adjudication_id", F.col("candidate_id").alias("_owner")), "adjudication_id", "left")
        foreign = ~F.col("_owner").eqNullSafe(F.col("candidate_id"))
    order = Window.partitionBy("candidate_id").orderBy(*([position] if position else ["graded_at", "grade_event_id"]))
    if position:
        latest = F.max(F.struct("graded_at", "grade_event_id")).over(order.rowsBetween(Window.unboundedPreceding, -1))
        told = told.withColumn("_latest", latest)
        before, backward = F.col("_latest.grade_event_id"), F.coalesce(F.col("graded_at") < F.col("_latest.graded_at"), F.lit(False))
    else:
        told = told.withColumn("_before", F.lag("grade_event_id").over(order))
        before = F.col("_before")
    reason = F.when(foreign, "adjudication_foreign").when(~before.eqNullSafe(F.col("previous_grade_event_id")), "previous_mismatch").when(backward, "time_backward")
    return told.withColumn("reason", reason).select(*grades.columns, "reason")


def current_grades(grades: DataFrame) -> DataFrame:
    return grades.groupBy("candidate_id").agg(F.max_by("grade", F.struct("graded_at", "grade_event_id")).alias("grade"))


def transitions(log: DataFrame, moves: dict[str, tuple], key: list[str], order: list[str], status: str = "status") -> DataFrame:
    """A log with previous and allowed: the first of a key is free, the same state again is no move."""
    pairs = F.array(*[F.lit(f"{a}>{b}") for a, bs in moves.items() for b in bs])
    told = log.withColumn("previous", F.lag(status).over(Window.partitionBy(*key).orderBy(*order)))
    move = F.concat_ws(">", "previous", status)
    return told.withColumn("allowed", F.col("previous").isNull() | (F.col("previous") == F.col(status)) | F.array_contains(pairs, move))


def monotone(history: DataFrame, key: list[str], order: list[str], counters: list[str], resumable: tuple = ("partial", "partial_max_pages")) -> DataFrame:
    """A resumable history with violation: terminal_status (only partial may go on) or counter_decrease."""
    w = Window.partitionBy(*key).orderBy(*order)
    fall = F.lit(False)
    for c in counters:
        fall = fall | F.coalesce(F.col(c) < F.lag(c).over(w), F.lit(False))
    before = F.lag("status").over(w)
    return history.withColumn("violation", F.when(before.isNotNull() & ~before.isin(*resumable), "terminal_status").when(fall, "counter_decrease"))


def execution_gate(executions: DataFrame, queries: DataFrame) -> DataFrame:
    """executions (query_id, split, executed_at, cutoff_at) with reason, null if admissible."""
    told = executions.join(queries.select("query_id", F.col("status").alias("_status"), F.col("valid_for_test_from").alias("_valid"), F.col("source_available_at").alias("_source")), "query_id", "left")
    c = F.col
    prospective = c("split") == "prospective_test"
    reason = (
        F.when(c("_status").isNull(), "query_unknown").when(c("cutoff_at") > c("executed_at"), "cutoff_after_execution").when(c("_source") > c("cutoff_at"), "source_after_cutoff")
        .when(prospective & (c("_status") != "frozen"), "query_not_frozen").when(prospective & (c("executed_at") < c("_valid")), "before_valid_from")
    )
    return told.withColumn("reason", reason).drop("_status", "_valid", "_source")


def missed_slots(opportunities: DataFrame, executions: DataFrame, as_of: Column) -> DataFrame:
    """Opportunities whose window has passed without a complete execution in it."""
    done = executions.where("status = 'complete'").select("opportunity_id", "executed_at")
    hit = opportunities.join(done, "opportunity_id").where("executed_at < window_end").select("opportunity_id").distinct()
    return opportunities.where(F.col("window_end") <= as_of).join(hit, "opportunity_id", "left_anti")
