"""Queries over observations: hosts and services as the events table holds them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import joined_id
from ..functions.sizes import broadcast_if_few
from ..operators import asof, audit, background, epochs, features, graph, prospective, rules, timeline
from ..sources.readers import VIEWS, event_observations, table
from ..sources.shared import stash

T0, CUTOFF, AS_OF = "2024-01-01 00:00:00", "2024-01-15 00:00:00", "2024-02-15 00:00:00"


def _at(text: str):
    return F.lit(text).cast("timestamp_ntz")


def _bounds(spark: SparkSession, folder: str) -> DataFrame:
    """One row."""
    return F.broadcast(table(spark, folder, "events").agg(F.min("ts").alias("t0"), F.max("ts").alias("t1")))


def host_service_join(spark: SparkSession, folder: str) -> DataFrame:
    hosts, services = event_observations(spark, folder)
    told = services.select("observation_id", "port", "protocol").join(hosts.select("observation_id", "indicator_id", "asn"), "observation_id")
    return told.groupBy("asn", "port", "protocol").agg(F.count("*").alias("services"), F.count_distinct("indicator_id").alias("indicators"))


def orphan_services(spark: SparkSession, folder: str) -> DataFrame:
    hosts, services = event_observations(spark, folder)
    seen = hosts.where("query_run_id <> 'run-3'")
    return services.select("service_observation_id", "observation_id").join(seen.select("observation_id"), "observation_id", "left_anti").select("service_observation_id", "observation_id")


def fingerprint_catalog(spark: SparkSession, folder: str) -> DataFrame:
    found, _ = graph.fingerprint_graph(*event_observations(spark, folder))
    return found.where("fingerprint_type <> 'portset'").select("fingerprint_id", "fingerprint_type", "fingerprint_value", "first_available_at")


def portset_fingerprint(spark: SparkSession, folder: str) -> DataFrame:
    """Ports of an indicator's hosts in a run, as one host."""
    hosts, services = event_observations(spark, folder)
    own = services.join(hosts.select("observation_id", "indicator_id", "query_run_id"), "observation_id").select(F.concat_ws("|", "indicator_id", "query_run_id").alias("observation_id"), "transport", "port")
    return graph.portsets(own)


def fingerprint_edges(spark: SparkSession, folder: str) -> DataFrame:
    _, edges = graph.fingerprint_graph(*event_observations(spark, folder))
    return edges.groupBy("fingerprint_type", "of_indicator").agg(F.count("*").alias("edges"), F.count_distinct("src_id").alias("sources"), F.min("available_at").alias("first_available_at"))


#: Indicators of a fingerprint up to which all pairs are listed.
MOST_MEMBERS = 500


def shared_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """All pairs of indicators that share a fingerprint; where more than MOST_MEMBERS share one, such as
    a vendor's default, each with the first of them."""
    _, edges = graph.fingerprint_graph(*event_observations(spark, folder))
    members = graph.earliest_members(edges)
    pairs, hot = graph.shared_infrastructure(members, max_members=MOST_MEMBERS)
    return pairs.unionByName(graph.shared_with_first(members, hot)).select("relation_id", "left_id", "right_id", "relation_type", "fingerprint_id", "available_at")


def _landmarks(hosts: DataFrame) -> DataFrame:
    first = hosts.groupBy("indicator_id").agg(F.min(F.coalesce("observed_at", "collected_at")).alias("window_start"))
    return first.select(F.concat(F.lit("landmark-"), "indicator_id").alias("landmark_id"), "indicator_id", "window_start", (F.col("window_start") + F.expr("interval 10 days")).alias("window_end"))


def timeline_order(spark: SparkSession, folder: str) -> DataFrame:
    hosts, services = event_observations(spark, folder)
    told = timeline.timeline(_landmarks(hosts), hosts, services)
    return told.select("timeline_entry_id", "landmark_id", "observation_id", "observation_kind", "nth", F.array_join("fingerprint_ids", ",").alias("fingerprints"))


def continuity_status(spark: SparkSession, folder: str) -> DataFrame:
    hosts, services = event_observations(spark, folder)
    few = services.withColumn("jarm", F.lit(None).cast("string")).withColumn("software_product", F.lit(None).cast("string"))
    told = timeline.continuity(timeline.timeline(_landmarks(hosts), hosts, few))
    return told.select("landmark_id", "status", "current_response", "historical_positive_count", "missing_scan_count", "last_positive_at", F.array_join("stable_fingerprint_ids", ",").alias("stable"), F.array_join("conflicting_fingerprint_ids", ",").alias("conflicting"))


def _assigned(spark: SparkSession, folder: str) -> DataFrame:
    hosts, services = event_observations(spark, folder)
    return epochs.assign_epochs(epochs.histories(hosts, services.select("observation_id", F.col("cert_sha256").alias("identity"))))


def entity_epochs(spark: SparkSession, folder: str) -> DataFrame:
    return _assigned(spark, folder).select("indicator_id", "observation_id", "epoch")


def _purchases(spark: SparkSession, folder: str, key: str) -> DataFrame:
    e = table(spark, folder, "events").withColumn("k", F.expr(key))
    seen, bought = e.where("event_type = 'view'").select("k", "event_id", "ts"), e.where("event_type = 'purchase'").select("k", "event_id", "ts", "value")
    told = asof.as_of(seen, bought, ["k"], "ts", "ts", "event_id")
    return told.select("event_id", F.col("record.event_id").alias("purchase_id"), F.col("record.ts").alias("purchased_at"), F.col("record.value").alias("value"))


def latest_before(spark: SparkSession, folder: str) -> DataFrame:
    """Each view with its user's latest purchase at that time."""
    return _purchases(spark, folder, "user_id")


def latest_before_hot(spark: SparkSession, folder: str) -> DataFrame:
    """The same where two keys hold everything."""
    return _purchases(spark, folder, "user_id % 2")


def hot_epochs(spark: SparkSession, folder: str) -> DataFrame:
    """All addresses of a network as one indicator, folded in chunks of 500 observations."""
    hosts, services = event_observations(spark, folder)
    one = hosts.withColumn("indicator_id", F.concat(F.lit("net-"), (F.col("asn") % 3).cast("string")))
    made = epochs.histories(one, services.select("observation_id", F.col("cert_sha256").alias("identity")))
    return epochs.assign_epochs(made, 0, 500).select("indicator_id", "observation_id", "epoch")


def epoch_intervals(spark: SparkSession, folder: str) -> DataFrame:
    made = epochs.entity_epochs(_assigned(spark, folder))
    return made.select("entity_epoch_id", "indicator_id", "epoch", "valid_from", "valid_to", "available_at", F.col("observations").cast("int").alias("observations"), F.array_join("identity_feature_ids", ",").alias("identities"))


def features_unpivot(spark: SparkSession, folder: str) -> DataFrame:
    seen = features.observed_features(*event_observations(spark, folder))
    return features.feature_observations(seen).join(seen.select("feature_observation_id", "feature_type", "canonical_value").distinct(), "feature_observation_id").select("feature_observation_id", "feature_id", "observation_id", "feature_type", "canonical_value", "observed_at")


def feature_first_available(spark: SparkSession, folder: str) -> DataFrame:
    made = features.feature_catalog(features.observed_features(*event_observations(spark, folder)))
    return made.select("feature_id", "feature_family", "feature_type", "canonical_value", "query_field", "stability", "shared_or_default", "first_available_at", "source_fingerprint_id")


SETS = "reference_set_id string, protocol string, ports array<int>, product string, days int"
SET_ROWS = [("set-https", "https", [443], None, 14), ("set-relaybox", None, None, "relaybox-1", 20), ("set-any", None, None, None, 25)]


def _sets(spark: SparkSession, folder: str) -> DataFrame:
    sets = spark.createDataFrame(SET_ROWS, SETS)
    at = sets.join(_bounds(spark, folder), F.lit(True))  # one row of bounds
    cutoff = F.date_trunc("day", "t0").cast("timestamp_ntz") + F.make_dt_interval("days")
    return at.select("reference_set_id", "protocol", "ports", "product", cutoff.alias("cutoff_at"), (cutoff - F.expr("interval 12 days")).alias("window_start"), cutoff.alias("window_end"), cutoff.alias("registered_at"))


def reference_memberships(spark: SparkSession, folder: str) -> DataFrame:
    hosts, services = event_observations(spark, folder)
    return background.memberships(_sets(spark, folder), hosts, services).select("membership_id", "reference_set_id", "observation_id", "observable", "exclusion_reason")


def _stats(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    hosts, services = event_observations(spark, folder)
    sets = _sets(spark, folder)
    seen = features.observed_features(hosts, services)
    catalog, observations = features.feature_catalog(seen), seen.select("feature_id", "observation_id", "observed_at", "available_at")
    members = background.memberships(sets, hosts, services, excluded=False)
    return background.feature_stats(catalog, observations, sets, members, _anchors(hosts, sets)), catalog


_NUMBERS = ["anchor_numerator", "anchor_denominator", "background_numerator", "background_denominator"]


def feature_stats_wilson(spark: SparkSession, folder: str) -> DataFrame:
    stats, _ = _stats(spark, folder)
    shares = ["anchor_support", "background_prevalence", "anchor_ci_low", "anchor_ci_high", "background_ci_low", "background_ci_high"]
    return stats.select("feature_id", "reference_set_id", *_NUMBERS, *[F.round(x, 9).alias(x) for x in shares], F.round("reference_lift", 3).alias("reference_lift"))


def feature_eligibility(spark: SparkSession, folder: str) -> DataFrame:
    stats, catalog = _stats(spark, folder)
    return background.assess(stats, catalog).select("feature_id", "reference_set_id", "status", F.array_join("reason_codes", ",").alias("reason_codes"))


def _schedules(spark: SparkSession, folder: str) -> DataFrame:
    b = _bounds(spark, folder).withColumn("t0", F.date_trunc("day", "t0").cast("timestamp_ntz"))
    each = F.explode(F.array(*[F.struct(F.lit(f"schedule-{n}").alias("schedule_id"), F.lit(h).alias("interval_hours")) for n, h in (("day", 24), ("week", 168))]))
    return b.select("t0", each.alias("s")).select("s.schedule_id", "s.interval_hours", F.col("t0").alias("starts_at"))


def due_opportunities(spark: SparkSession, folder: str) -> DataFrame:
    made = epochs.entity_epochs(_assigned(spark, folder), open_last=True)
    as_of = F.col("starts_at") + F.expr("interval 20 days")
    told = prospective.due_opportunities(_schedules(spark, folder), made, as_of)
    return told.groupBy("schedule_id", "due_at", "window_end", "status").agg(F.count("*").alias("opportunities"), F.count_distinct("entity_epoch_id").alias("epochs"))


def prospective_events(spark: SparkSession, folder: str) -> DataFrame:
    hosts, services = event_observations(spark, folder)
    seen = hosts.join(_bounds(spark, folder).select((F.date_trunc("day", "t0").cast("timestamp_ntz") + F.expr("interval 10 days")).alias("valid")), F.lit(True))
    told = prospective.prospective_events(seen, services, F.col("valid"))
    return told.select("observation_id", "indicator_id", "time_status", "observed_at", F.size("record_time_statuses").alias("records"))


def candidates_first_seen(spark: SparkSession, folder: str) -> DataFrame:
    told = prospective_events(spark, folder).withColumn("event_id", joined_id("prospective-event", F.col("observation_id")))
    asn = event_observations(spark, folder)[0].select("observation_id", "asn")
    made = prospective.candidates(told.join(asn, "observation_id"), ["asn", "indicator_id"])
    return made.select("asn", "indicator_id", "first_candidate_at", "first_observation_event_id")


def _evidence(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, folder, "events")
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
    rows = e.select(
        F.concat(F.lit("ev-"), F.col("event_id").cast("string")).alias("evidence_id"), F.concat(F.lit("cand-"), (F.col("user_id") % 40).cast("string")).alias("candidate_id"), F.concat(F.lit("family-"), k.cast("string")).alias("source_family_id"),
        F.when(F.col("event_id") % 9 == 0, "discovery").when(F.col("event_id") % 9 == 1, "contradiction").otherwise("validation").alias("role"), F.when(F.col("event_id") % 5 == 0, "unavailable").otherwise("available").alias("availability"),
        F.array(F.concat(F.lit("f-"), (F.col("event_id") % 6).cast("string"))).alias("feature_ids"), F.col("ts").alias("available_at"), F.when(F.col("event_id") % 4 != 0, F.col("ts")).alias("observed_at"), F.when(F.col("event_id") % 5 != 0, F.col("event_id") % 3 != 0).alias("supports_candidate"),
    )
    t = _bounds(spark, folder).select((F.date_trunc("day", "t0").cast("timestamp_ntz") + F.expr("interval 5 days")).alias("first_candidate_at"))
    ids = e.select((F.col("user_id") % 40).alias("n")).distinct().where("n < 35")
    own = ids.join(t, F.lit(True)).select(F.concat(F.lit("cand-"), F.col("n").cast("string")).alias("candidate_id"), "first_candidate_at", F.array(F.concat(F.lit("f-"), (F.col("n") % 6).cast("string"))).alias("discovery_feature_ids"), F.array(F.concat(F.lit("family-"), F.col("n").cast("string"))).alias("discovery_source_family_ids"))
    return rows, own


def evidence_gate(spark: SparkSession, folder: str) -> DataFrame:
    return prospective.evidence_gate(*_evidence(spark, folder)).select("evidence_id", "candidate_id", "reason")


def adjudication_status(spark: SparkSession, folder: str) -> DataFrame:
    gated = prospective.evidence_gate(*_evidence(spark, folder)).where("reason is null or reason in ('family_repeated')")
    return prospective.adjudication_status(gated, ["candidate_id", "source_family_id"])


def status_transitions(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events")
    status = F.element_at(F.array(*map(F.lit, ("due", "missed", "partial", "complete", "late"))), (F.col("event_id") % 5 + 1).cast("int"))
    log = e.select("event_id", "user_id", "ts", status.alias("status"))
    told = prospective.transitions(log, prospective.OPPORTUNITY_MOVES, ["user_id"], ["ts", "event_id"])
    return told.groupBy("previous", "status", "allowed").agg(F.count("*").alias("moves"))


def audit_candidates(spark: SparkSession, folder: str) -> DataFrame:
    told = prospective_events(spark, folder).withColumn("event_id", joined_id("prospective-event", F.col("observation_id")))
    asn = event_observations(spark, folder)[0].select("observation_id", "asn")
    made = prospective.candidates(told.join(asn, "observation_id"), ["asn", "indicator_id"])
    return audit.audit_candidates(made, told.where("cast(substring_index(observation_id, '-', -1) as long) % 3 <> 0"))  # the others are the fault


def audit_features(spark: SparkSession, folder: str) -> DataFrame:
    """Issues by code of stored sets, statistics and assessments, some of which were edited: every
    membership of a 101st observation, the counts in one set, the verdicts in another; all of the third
    set's features are accepted."""
    hosts, services = event_observations(spark, folder)
    sets = stash(_sets(spark, folder), "sets")
    catalog_keys = ["feature_id", "feature_family", "feature_type", "canonical_value", "query_field", "stability", "shared_or_default", "extractor_version"]
    seen = stash(features.observed_features(hosts, services).select(*catalog_keys, "observation_id", "observed_at", "available_at"), "features")
    catalog, observations = stash(features.feature_catalog(seen), "catalog"), seen.select("feature_id", "observation_id", "observed_at", "available_at")
    anchors = _anchors(hosts, sets)
    members = stash(background.memberships(sets, hosts, services), "members")
    stats = stash(background.feature_stats(catalog, observations, sets, members, anchors), "stats")
    judged = stash(background.assess(stats, catalog).withColumn("assessment_id", F.concat_ws("|", "feature_id", "reference_set_id")), "assessments")
    edited = F.substring_index("observation_id", "-", -1).cast("long") % 101 == 0
    in_set = lambda name: F.col("reference_set_id") == name
    stored = members.withColumn("exclusion_reason", F.when(edited, "edited").otherwise(F.col("exclusion_reason")))
    counted = stats.withColumn("anchor_numerator", F.col("anchor_numerator") + F.when(in_set("set-any"), 1).otherwise(0))
    told = judged.withColumn("status", F.when(in_set("set-https"), "edited").otherwise(F.col("status")))
    accepted = judged.where(in_set("set-relaybox")).select("assessment_id", F.lit("accepted").alias("decision"))
    return audit.counts(audit.audit_features(catalog, observations, sets, stored, anchors, counted, told, accepted, hosts, services))


def _anchors(hosts: DataFrame, sets: DataFrame) -> DataFrame:
    of_user = F.substring_index("indicator_id", "-", -1).cast("long")
    return hosts.where("host_observed").where(of_user % 10 == 3).join(broadcast_if_few(sets.select("reference_set_id", "cutoff_at")), F.col("collected_at") <= F.col("cutoff_at")).select("reference_set_id", "observation_id")


_CLAUSES = [("rule-a", "c1", "required", "host.services.service_name", "https"), ("rule-a", "c2", "alternative", "host.services.software.product", "relaybox-1"), ("rule-a", "c3", "alternative", "host.services.software.product", "relaybox-2"), ("rule-a", "c4", "exclusion", "host.services.port", "8443"),
            ("rule-b", "c5", "required", "host.services.jarm.fingerprint", "jarm-1"), ("rule-b", "c6", "required", "host.autonomous_system.asn", "64501")]


def rule_match_hosts(spark: SparkSession, folder: str) -> DataFrame:
    seen = features.observed_features(*event_observations(spark, folder)).where("query_field is not null")
    clauses = spark.createDataFrame(_CLAUSES, "design_id string, clause_id string, logical_role string, query_field string, canonical_value string")
    return rules.match_rules(seen.select("observation_id", "query_field", "canonical_value"), clauses)


QUERIES = {f.__name__: f for f in (
    host_service_join, orphan_services, fingerprint_catalog, portset_fingerprint, fingerprint_edges, shared_pairs, timeline_order, continuity_status, entity_epochs, hot_epochs, latest_before, latest_before_hot, epoch_intervals, features_unpivot, feature_first_available,
    reference_memberships, feature_stats_wilson, feature_eligibility, due_opportunities, prospective_events, candidates_first_seen, evidence_gate, adjudication_status, status_transitions, audit_candidates, audit_features, rule_match_hosts,
)}

_FPS = """
fps as (
  select 'cert' as fingerprint_type, cert_sha256 as fingerprint_value, observation_id, service_observation_id from services_v where cert_sha256 is not null
  union all select 'jarm', jarm, observation_id, service_observation_id from services_v where jarm is not null),
seen as (select f.*, h.indicator_id, h.collected_at, h.observed_at, h.query_run_id, 'fp-' || sha256(fingerprint_type || '|' || fingerprint_value)[1:20] as fingerprint_id from fps f join hosts_v h using (observation_id))"""
_FEATURES = """
raw as (
  select observation_id, null as service_observation_id, observed_at, collected_at as available_at, 'network' as feature_family, 'asn' as feature_type, cast(asn as varchar) as canonical_value, 'host.autonomous_system.asn' as query_field, 'stable' as stability, false as shared_or_default from hosts_v where host_observed
  union all
  select s.observation_id, s.service_observation_id, coalesce(s.observed_at, h.observed_at), h.collected_at, u.family, u.type, lower(u.value), u.field, 'stable',
         case u.type when 'jarm' then regexp_full_match(u.value, '0+') when 'software_product' then u.value in ('apache', 'httpd', 'nginx', 'openssh', 'iis') else false end
  from services_v s join hosts_v h using (observation_id),
       lateral (values ('identity', 'cert_sha256', s.cert_sha256, 'host.services.tls.certificates.leaf_data.fingerprint'), ('tls', 'jarm', s.jarm, 'host.services.jarm.fingerprint'), ('service', 'port', cast(s.port as varchar), 'host.services.port'),
                ('service', 'protocol', s.protocol, 'host.services.service_name'), ('device', 'software_product', s.software_product, 'host.services.software.product')) u(family, type, value, field)
  where h.host_observed and u.value is not null),
features as (
  select *, 'feature-' || sha256(feature_family || '|' || feature_type || '|' || canonical_value || '|v1|v1')[1:20] as feature_id from raw)"""
_SETS_SQL = """
bounds as (select date_trunc('day', min(ts)) as t0 from events),
sets as (select s.*, t0 + s.days * interval 1 day as cutoff_at, t0 + s.days * interval 1 day - interval 12 day as window_start
         from bounds, (values ('set-https', 'https', 443, null, 14), ('set-relaybox', null, null, 'relaybox-1', 20), ('set-any', null, null, null, 25)) s(reference_set_id, protocol, port, product, days)),
members as (
  select r.reference_set_id, r.cutoff_at, h.observation_id, case
    when h.collected_at > r.cutoff_at or coalesce(h.observed_at, h.collected_at) > r.cutoff_at then 'after_cutoff' when not h.host_observed then 'not_observable'
    when not coalesce(h.observed_at, h.collected_at) between r.window_start and r.cutoff_at then 'time_window_mismatch'
    when not exists (select 1 from services_v s where s.observation_id = h.observation_id and (r.protocol is null or s.protocol = r.protocol) and (r.port is null or s.port = r.port) and (r.product is null or s.software_product = r.product)) then 'stratum_mismatch' end as exclusion_reason
  from hosts_v h, sets r)"""
_STATS_SQL = f"""
{_FEATURES}, {_SETS_SQL},
anchors as (select r.reference_set_id, h.observation_id from hosts_v h join sets r on h.collected_at <= r.cutoff_at where h.host_observed and cast(split_part(h.indicator_id, '-', 2) as bigint) % 10 = 3),
sample as (
  select reference_set_id, observation_id, max(a) as a, max(b) as b from (select reference_set_id, observation_id, 1 as a, 0 as b from anchors union all select reference_set_id, observation_id, 0, 1 from members where exclusion_reason is null) group by all),
totals as (select reference_set_id, sum(a)::bigint as anchor_denominator, sum(b)::bigint as background_denominator from sample group by 1),
known as (select feature_id, observation_id, min(greatest(available_at, coalesce(observed_at, available_at))) as known_at from features group by 1, 2),
hits as (select k.feature_id, s.reference_set_id, sum(s.a)::bigint as anchor_numerator, sum(s.b)::bigint as background_numerator from known k join sample s using (observation_id) join sets r using (reference_set_id) where k.known_at <= r.cutoff_at group by 1, 2),
cat as (select feature_id, any_value(stability) as stability, any_value(query_field) as query_field, any_value(shared_or_default) as shared_or_default, min(available_at) as first_available_at from features group by 1),
stats as (
  select c.feature_id, r.reference_set_id, r.cutoff_at, c.shared_or_default, c.first_available_at, coalesce(anchor_numerator, 0) as anchor_numerator, coalesce(anchor_denominator, 0) as anchor_denominator, coalesce(background_numerator, 0) as background_numerator, coalesce(background_denominator, 0) as background_denominator
  from cat c cross join sets r left join totals t using (reference_set_id) left join hits h on h.feature_id = c.feature_id and h.reference_set_id = r.reference_set_id),
shares as (select *, case when anchor_denominator = 0 then 0.0::double else anchor_numerator::double / anchor_denominator end as anchor_support, case when background_denominator = 0 then 0.0::double else background_numerator::double / background_denominator end as background_prevalence from stats)"""


def _wilson_sql(n: str, d: str, sign: str) -> str:
    z = "1.959963984540054::double"
    p, term = f"({n}::double / {d})", f"(1 + {z} * {z} / {d}::double)"
    inner = f"(({p} + {z} * {z} / (2 * {d}::double)) / {term}) {sign} ({z} * sqrt(({p} * (1 - {p}) + {z} * {z} / (4 * {d}::double)) / {d}::double) / {term})"
    return f"case when {d} = 0 then {'0.0' if sign == '-' else '1.0'}::double else {'greatest(0.0::double, ' if sign == '-' else 'least(1.0::double, '}{inner}) end"


_AS_OF = """
with e as (select *, {key} as k from events),
b as (select k, ts, arg_max(event_id, event_id) as event_id, arg_max(value, event_id) as value from e where event_type = 'purchase' group by k, ts)
select v.event_id, b.event_id as purchase_id, b.ts as purchased_at, b.value from (select * from e where event_type = 'view') v asof left join b on v.k = b.k and v.ts >= b.ts"""
_EPOCHS = """
ids as (
  select h.indicator_id ind, coalesce(h.observed_at, h.collected_at) eff, h.collected_at col, h.observation_id obs, list_sort(list_distinct(list(s.cert_sha256) filter (where s.cert_sha256 is not null))) fps
  from hosts_v h left join services_v s on s.observation_id = h.observation_id where h.host_observed group by all),
n as (select *, row_number() over (partition by ind order by eff, col, obs) rn from ids),
r as (
  select ind, obs, eff, col, fps, rn, 0 ep, coalesce(fps, []) cur from n where rn = 1
  union all
  select n.ind, n.obs, n.eff, n.col, n.fps, n.rn, case when len(coalesce(n.fps, [])) > 0 and len(r.cur) > 0 and not list_has_any(n.fps, r.cur) then r.ep + 1 else r.ep end,
         case when len(coalesce(n.fps, [])) > 0 and len(r.cur) > 0 and not list_has_any(n.fps, r.cur) then n.fps else list_distinct(list_concat(r.cur, coalesce(n.fps, []))) end
  from r join n on n.ind = r.ind and n.rn = r.rn + 1),
made as (
  select ind as indicator_id, ep as epoch, min(eff) as valid_from, max(eff) as valid_to, max(col) as available_at, count(*) as observations, list(obs order by eff, col, obs) as obs_ids,
         array_to_string(list_sort(list_distinct(flatten(list(coalesce(fps, []))))), ',') as identities from r group by 1, 2)"""
_TIMELINE = """
landmarks as (select 'landmark-' || indicator_id as landmark_id, indicator_id, min(coalesce(observed_at, collected_at)) as window_start, min(coalesce(observed_at, collected_at)) + interval 10 day as window_end from hosts_v group by indicator_id),
entries as (
  select l.landmark_id, h.observation_id, case when h.host_observed then 'positive' when h.negative_reason in ('not_found', 'no_response', 'api_error') then h.negative_reason else 'missing_scan' end as observation_kind,
         h.observed_at, h.collected_at, coalesce(h.observed_at, h.collected_at) as eff, h.host_observed, row_number() over (partition by l.landmark_id order by coalesce(h.observed_at, h.collected_at), h.collected_at, h.observation_id)::int as nth
  from hosts_v h join landmarks l using (indicator_id) where coalesce(h.observed_at, h.collected_at) between l.window_start and l.window_end)"""

ORACLES = {
    "host_service_join": f"with {VIEWS} select asn, port, protocol, count(*) as services, count(distinct indicator_id) as indicators from services_v join hosts_v using (observation_id) group by 1, 2, 3",
    "orphan_services": f"with {VIEWS} select service_observation_id, observation_id from services_v s where not exists (select 1 from hosts_v h where h.observation_id = s.observation_id and h.query_run_id <> 'run-3')",
    "fingerprint_catalog": f"with {VIEWS}, {_FPS} select fingerprint_id, fingerprint_type, fingerprint_value, min(collected_at) as first_available_at from seen group by 1, 2, 3",
    "portset_fingerprint": f"""
with {VIEWS}, own as (select distinct h.indicator_id || '|' || h.query_run_id as observation_id, s.transport || '/' || s.port as p from services_v s join hosts_v h using (observation_id)),
sets as (select observation_id, string_agg(p, ',' order by p) as ports from own group by 1) select observation_id, ports, sha256(ports) as portset_hash from sets""",
    "fingerprint_edges": f"""
with {VIEWS}, {_FPS}, allseen as (
  select fingerprint_type, fingerprint_id, service_observation_id, indicator_id, query_run_id, collected_at from seen
  union all select 'portset', 'fp-' || sha256('portset|' || sha256(ports))[1:20], observation_id, indicator_id, query_run_id, collected_at from (
    select s.observation_id, string_agg(distinct s.transport || '/' || s.port, ',' order by s.transport || '/' || s.port) as ports from services_v s group by 1) join hosts_v using (observation_id)),
edges as (select distinct fingerprint_type, fingerprint_id, src_id, of_indicator, query_run_id, min(collected_at) as t from (
  select *, service_observation_id as src_id, false as of_indicator from allseen union all select *, indicator_id, true from allseen) group by all)
select fingerprint_type, of_indicator, count(*) as edges, count(distinct src_id) as sources, min(t) as first_available_at from edges group by 1, 2""",
    "shared_pairs": f"""
with {VIEWS}, {_FPS}, members as (select *, count(*) over f as n, min(indicator_id) over f as first from (select fingerprint_id, fingerprint_type, indicator_id, min(collected_at) as t from seen group by all) window f as (partition by fingerprint_id))
select 'rel-' || sha256(a.indicator_id || '|' || b.indicator_id || '|shares_' || a.fingerprint_type || '|' || a.fingerprint_id)[1:20] as relation_id, a.indicator_id as left_id, b.indicator_id as right_id, 'shares_' || a.fingerprint_type as relation_type,
       a.fingerprint_id, greatest(a.t, b.t) as available_at from members a join members b on a.fingerprint_id = b.fingerprint_id and a.indicator_id < b.indicator_id where a.n <= {MOST_MEMBERS} or a.indicator_id = a.first""",
    "timeline_order": f"""
with {VIEWS}, {_TIMELINE}, fp as (
  select observation_id, array_to_string(list_sort(list_distinct(list('fp-' || sha256(t || '|' || v)[1:20]))), ',') as fingerprints from (
    select observation_id, 'cert' as t, cert_sha256 as v from services_v union all select observation_id, 'jarm', jarm from services_v union all select observation_id, 'software', software_product from services_v) where v is not null group by 1)
select 'timeline-' || sha256(landmark_id || '|' || observation_id)[1:20] as timeline_entry_id, landmark_id, observation_id, observation_kind, nth, coalesce(fingerprints, '') as fingerprints from entries left join fp using (observation_id)""",
    "continuity_status": f"""
with {VIEWS}, {_TIMELINE}, fp as (select observation_id, 'fp-' || sha256('cert|' || cert_sha256)[1:20] as fp from services_v where cert_sha256 is not null),
counts as (select landmark_id, fp, count(*) as n from entries join fp using (observation_id) where host_observed group by 1, 2),
sets as (select landmark_id, count(*) as k from entries where host_observed and observation_id in (select observation_id from fp) group by 1),
split as (select landmark_id, list_sort(list(fp) filter (n = k)) as stable, list_sort(list(fp) filter (n = 1)) as once from counts join sets using (landmark_id) where k >= 2 group by 1),
latest as (select * from (select *, row_number() over (partition by landmark_id order by collected_at desc, nth) as r from entries) where r = 1),
base as (
  select e.landmark_id, count(*) filter (e.host_observed) - any_value(l.host_observed::int) as historical, count(*) filter (e.observation_kind = 'missing_scan') as missing_scan_count, max(e.eff) filter (e.host_observed) as last_positive_at,
         case when any_value(l.observation_kind) not in ('missing_scan', 'api_error') then any_value(l.host_observed) end as current_response from entries e join latest l using (landmark_id) group by 1),
told as (select b.*, coalesce(stable, []) as stable, case when len(coalesce(stable, [])) > 0 then [] else coalesce(once, []) end as conflicting from base b left join split using (landmark_id))
select landmark_id, case when historical = 0 then 'unknown' when len(stable) > 0 then 'continuous' when len(conflicting) > 0 then 'reassigned' else 'probable' end as status, current_response, historical::bigint as historical_positive_count, missing_scan_count, last_positive_at,
       array_to_string(stable, ',') as stable, array_to_string(conflicting, ',') as conflicting from told""",
    "entity_epochs": f"with recursive {VIEWS}, {_EPOCHS} select ind as indicator_id, obs as observation_id, ep as epoch from r",
    "latest_before": _AS_OF.format(key="user_id"),
    "latest_before_hot": _AS_OF.format(key="user_id % 2"),
    "hot_epochs": f"with recursive {VIEWS}, {_EPOCHS.replace('h.indicator_id ind', "'net-' || (h.asn % 3) ind")} select ind as indicator_id, obs as observation_id, ep as epoch from r",
    "epoch_intervals": f"""
with recursive {VIEWS}, {_EPOCHS}
select 'entity-epoch-' || sha256(indicator_id || '|v1|' || array_to_string(list_transform(range(0, (len(obs_ids) + 999) // 1000), lambda i: sha256(array_to_string(obs_ids[i * 1000 + 1:(i + 1) * 1000], '|'))), '|'))[1:20] as entity_epoch_id, indicator_id, epoch, valid_from, valid_to, available_at, observations::int as observations, identities from made""",
    "features_unpivot": f"""
with {VIEWS}, {_FEATURES}
select distinct 'feature-observation-' || sha256(feature_id || '|' || observation_id || '|' || coalesce(service_observation_id, 'host'))[1:20] as feature_observation_id, feature_id, observation_id, feature_type, canonical_value, observed_at from features""",
    "feature_first_available": f"""
with {VIEWS}, {_FEATURES}
select feature_id, feature_family, feature_type, canonical_value, query_field, stability, shared_or_default, min(available_at) as first_available_at,
       case when feature_type in ('cert_sha256', 'jarm') then 'fp-' || sha256(replace(feature_type, '_sha256', '') || '|' || canonical_value)[1:20] end as source_fingerprint_id from features group by 1, 2, 3, 4, 5, 6, 7""",
    "reference_memberships": f"with {VIEWS}, {_SETS_SQL} select 'reference-membership-' || sha256(reference_set_id || '|' || observation_id)[1:20] as membership_id, reference_set_id, observation_id, exclusion_reason is null as observable, exclusion_reason from members",
    "feature_stats_wilson": f"""
with {VIEWS}, {_STATS_SQL}
select feature_id, reference_set_id, anchor_numerator, anchor_denominator, background_numerator, background_denominator, round(anchor_support, 9) as anchor_support, round(background_prevalence, 9) as background_prevalence,
  round({_wilson_sql("anchor_numerator", "anchor_denominator", "-")}, 9) as anchor_ci_low, round({_wilson_sql("anchor_numerator", "anchor_denominator", "+")}, 9) as anchor_ci_high,
  round({_wilson_sql("background_numerator", "background_denominator", "-")}, 9) as background_ci_low, round({_wilson_sql("background_numerator", "background_denominator", "+")}, 9) as background_ci_high,
  round(anchor_support / greatest(background_prevalence, 1e-9::double), 3) as reference_lift from shares""",
    "feature_eligibility": f"""
with {VIEWS}, {_STATS_SQL}, told as (
  select feature_id, reference_set_id, array_to_string(list_sort(list_filter([case when first_available_at > cutoff_at then 'available_after_cutoff' end, case when shared_or_default then 'shared_or_default' end, case when anchor_numerator < 2 then 'insufficient_distinct_anchors' end,
    case when anchor_support < 0.5 then 'insufficient_anchor_support' end, case when background_denominator = 0 then 'matched_background_missing' end, case when background_denominator > 0 and background_prevalence > 0.1 then 'background_too_common' end], lambda x: x is not null)), ',') as reason_codes from shares)
select feature_id, reference_set_id, case when reason_codes = '' then 'candidate' else 'blocked' end as status, reason_codes from told""",
    "due_opportunities": f"""
with recursive {VIEWS}, {_EPOCHS}, bounds as (select date_trunc('day', min(ts)) as t0 from events),
ends as (select *, case when epoch < max(epoch) over (partition by indicator_id) then valid_to end as until from made),
slots as (
  select schedule_id, due_at, due_at + h * interval 1 hour as window_end, t0 + interval 20 day as as_of from (
    select schedule_id, h, t0, unnest(generate_series(t0, t0 + interval 20 day, h * interval 1 hour)) as due_at from bounds, (values ('schedule-day', 24), ('schedule-week', 168)) s(schedule_id, h)))
select schedule_id, due_at, window_end, case when as_of < window_end then 'due' else 'missed' end as status, count(*) as opportunities, count(distinct indicator_id || '|' || epoch) as epochs
from slots join ends on valid_from < window_end and (until is null or until > due_at) group by 1, 2, 3, 4""",
    "prospective_events": f"""
with {VIEWS}, bounds as (select date_trunc('day', min(ts)) + interval 10 day as valid from events),
records as (select observation_id, observed_at from hosts_v union all select observation_id, observed_at from services_v),
each as (select observation_id, bool_or(observed_at is null) as gap, min(observed_at) as first, count(*)::int as records from records group by 1),
told as (select h.observation_id, h.indicator_id, case when not gap then first end as observed_at, records, valid from hosts_v h join each using (observation_id), bounds)
select observation_id, indicator_id, case when observed_at is null then 'unresolved' when observed_at < valid then 'pre_freeze' else 'eligible' end as time_status, observed_at, records from told""",
}
ORACLES["candidates_first_seen"] = f"""
with ev as ({ORACLES["prospective_events"]}), asns as (select 'obs-' || event_id as observation_id, 64500 + user_id % 7 as asn from events),
told as (select asn, indicator_id, observed_at, 'prospective-event-' || sha256(observation_id)[1:20] as event_id from ev join asns using (observation_id) where time_status = 'eligible')
select asn::bigint as asn, indicator_id, min(observed_at) as first_candidate_at, arg_min(event_id, (observed_at, event_id)) as first_observation_event_id from told group by 1, 2"""
_EVIDENCE_SQL = """
ev as (
  select event_id, 'ev-' || event_id as evidence_id, 'cand-' || (user_id % 40) as candidate_id, user_id % 40 as n, 'family-' || regexp_extract(props, '([0-9]+)', 1) as source_family_id,
         case event_id % 9 when 0 then 'discovery' when 1 then 'contradiction' else 'validation' end as role, case when event_id % 5 = 0 then 'unavailable' else 'available' end as availability, event_id % 6 as f, ts as available_at,
         case when event_id % 4 <> 0 then ts end as observed_at, case when event_id % 5 <> 0 then event_id % 3 <> 0 end as supports_candidate, (select date_trunc('day', min(ts)) + interval 5 day from events) as t from events),
gated as (
  select *, case when n >= 35 then 'unknown_candidate' when role = 'discovery' then 'discovery_evidence' when availability = 'available' and source_family_id = 'family-' || n then 'same_source_family' when availability = 'available' and f = n % 6 then 'feature_reuse'
    when availability = 'available' and available_at < t then 'pre_candidate_evidence' when availability = 'available' and observed_at < t then 'pre_candidate_observation'
    when row_number() over (partition by candidate_id, source_family_id order by available_at, evidence_id) > 1 then 'family_repeated' end as reason from ev)"""
ORACLES["evidence_gate"] = f"with {_EVIDENCE_SQL} select evidence_id, candidate_id, reason from gated"
ORACLES["adjudication_status"] = f"""
with {_EVIDENCE_SQL}, g as (
  select candidate_id, source_family_id, bool_or(availability = 'available' and role = 'contradiction') as contra, coalesce(bool_or(availability = 'available' and role = 'validation' and supports_candidate), false) as pro,
         coalesce(bool_or(availability = 'available' and role = 'validation' and not supports_candidate), false) as con, bool_and(availability = 'unavailable') as nothing from gated where reason is null or reason = 'family_repeated' group by 1, 2)
select candidate_id, source_family_id, case when contra or (pro and con) then 'contradicted' when pro then 'positive' when con then 'negative' when nothing then 'unobservable' else 'unresolved' end as status from g"""
ORACLES["status_transitions"] = """
with log as (select event_id, user_id, ts, ['due', 'missed', 'partial', 'complete', 'late'][event_id % 5 + 1] as status from events),
told as (select *, lag(status) over (partition by user_id order by ts, event_id) as previous from log)
select previous, status, previous is null or previous = status or (previous = 'due' and status in ('missed', 'partial', 'failed', 'complete', 'late')) or (previous = 'partial' and status in ('partial', 'failed', 'complete', 'late')) as allowed, count(*) as moves from told group by 1, 2, 3"""
ORACLES["audit_candidates"] = f"""
with ev as ({ORACLES["prospective_events"]}), asns as (select 'obs-' || event_id as observation_id, 64500 + user_id % 7 as asn from events),
told as (select asn::bigint as asn, indicator_id, observed_at, observation_id, 'prospective-event-' || sha256(observation_id)[1:20] as event_id from ev join asns using (observation_id) where time_status = 'eligible'),
firsts as (select asn, indicator_id, arg_min(observation_id, (observed_at, event_id)) as obs from told group by 1, 2)
select 'candidate_without_event' as code, 'candidate-' || sha256('{{"asn":' || asn || ',"indicator_id":"' || indicator_id || '"}}')[1:20] as record_id, null::varchar as detail from firsts where cast(split_part(obs, '-', 2) as bigint) % 3 = 0"""
ORACLES["rule_match_hosts"] = f"""
with {VIEWS}
select distinct 'rule-a' as design_id, observation_id from services_v s join hosts_v h using (observation_id) where h.host_observed and protocol = 'https' and software_product in ('relaybox-1', 'relaybox-2') and port <> 8443
union all select distinct 'rule-b', observation_id from services_v join hosts_v using (observation_id) where host_observed and jarm = 'jarm-1' and asn = 64501"""

ORACLES["audit_features"] = f"""
select 'non_reproducible_reference_sets' as code, count(*) as issues from ({ORACLES['reference_memberships']}) where cast(split_part(observation_id, '-', 2) as bigint) % 101 = 0
union all select 'non_reproducible_feature_stat_snapshots', count(*) from ({ORACLES['feature_stats_wilson']}) where reference_set_id = 'set-any'
union all select 'non_reproducible_feature_eligibility_assessments', count(*) from ({ORACLES['feature_eligibility']}) where reference_set_id = 'set-https'
union all select 'accepted_feature_not_eligible', count(*) from ({ORACLES['feature_eligibility']}) where reference_set_id = 'set-relaybox' and status <> 'candidate'"""
