"""Scan pages made from the observations, read back by the normaliser."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import scan
from ..sources.readers import VIEWS, event_observations


def _ip(n):
    """A routable-looking address for a number."""
    n = n.cast("long")
    return F.concat_ws(".", F.lit("8"), ((n / 65536).cast("int") % 256).cast("string"), ((n / 256).cast("int") % 256).cast("string"), (n % 256).cast("string"))


#: Hits of a page.
PAGE = 50


def pages(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pages, runs, known addresses): every positive observation is a hit, on pages of PAGE hits in three
    envelopes. Indicators whose number is a multiple of 4 are watched on their exact address, a run for
    each and day; a day's others of a query run are one scan."""
    hosts, services = event_observations(spark, folder)
    n, day = F.substring_index("indicator_id", "-", -1).cast("long"), F.date_trunc("day", "observed_at").cast("timestamp_ntz")
    s = services.groupBy("observation_id").agg(F.sort_array(F.collect_list(F.struct("port", F.upper("protocol").alias("service_name"), F.struct("jarm").alias("x"), "cert_sha256", "software_product"))).alias("s"))
    seen = hosts.where("host_observed").join(s, "observation_id").withColumn("n", n).withColumn("day", day)
    stamp = F.date_format("day", "yyyyMMdd")
    seen = seen.withColumn("run_id", F.when(F.col("n") % 4 == 0, F.concat_ws("-", F.lit("watch"), F.col("n").cast("string"), stamp)).otherwise(F.concat_ws("-", F.lit("scan"), "query_run_id", stamp)))
    service = F.transform("s", lambda x: F.struct(x["port"].alias("port"), x["service_name"].alias("service_name"), F.lit("tcp").alias("transport_protocol"), x["x"]["jarm"].alias("jarm"), x["cert_sha256"].alias("certificate"), F.array(F.struct(F.lit("acme").alias("vendor"), x["software_product"].alias("product"))).alias("software")))
    host = F.struct(_ip(F.col("n")).alias("ip"), F.date_format("observed_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("last_updated_at"), F.struct("asn").alias("autonomous_system"), service.alias("services"))
    hit = F.when(F.col("n") % 3 == 0, F.to_json(F.struct(host.alias("host")))).when(F.col("n") % 3 == 1, F.to_json(F.struct(F.struct(host.alias("resource")).alias("host_v1")))).otherwise(F.to_json(host))
    place = F.row_number().over(Window.partitionBy("run_id").orderBy("observed_at", "observation_id")) - 1
    placed = seen.withColumn("hit", hit).withColumn("place", place).withColumn("page_number", (F.col("place") / PAGE).cast("int") + 1)
    each = placed.groupBy("run_id", "page_number").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "hit"))), lambda x: x["hit"]), ",").alias("hits"), F.min("n").alias("n"))
    empty = F.col("run_id").startswith("watch") & (F.col("n") % 20 == 8)
    text = F.when(empty, '{"result":{"hits":[]}}').when(F.col("page_number") % 2 == 1, F.concat(F.lit('{"result":{"hits":['), "hits", F.lit("]}}"))).otherwise(F.concat(F.lit('{"result":{"result":{"hits":['), "hits", F.lit(']},"next_page_token":"t"}}')))
    made = each.select("run_id", "page_number", F.parse_json(text).alias("page"))
    watch = F.col("run_id").startswith("watch")
    runs = seen.groupBy("run_id", "day").agg(F.min("n").alias("n")).select(
        "run_id", F.when(watch, "q0_seed").otherwise("q1_direct_pivot").alias("query_class"), F.when(watch, _ip(F.when(F.col("n") % 28 == 0, F.col("n") + 1).otherwise(F.col("n")))).alias("exact_ip"),
        F.when(watch, F.concat(F.lit("ioc-"), F.col("n").cast("string"))).alias("indicator_id"), (F.col("day") + F.when(F.dayofmonth("day") % 10 == 1, F.expr("interval -1 day")).otherwise(F.expr("interval 2 day"))).cast("timestamp").alias("collected_at"),
    )
    known = seen.where("n % 5 <> 0").select(_ip(F.col("n")).alias("ip"), "indicator_id").distinct()
    return made, runs, known


def scan_hosts(spark: SparkSession, folder: str) -> DataFrame:
    made = scan.normalize(*pages(spark, folder))
    return made.hosts.select("observation_id", "indicator_id", F.col("observed_at").cast("timestamp_ntz").alias("observed_at"), "host_observed", "negative_reason", "asn", "query_run_id")


def scan_services(spark: SparkSession, folder: str) -> DataFrame:
    made = scan.normalize(*pages(spark, folder))
    return made.services.select("service_observation_id", "observation_id", "port", "transport", "protocol", "jarm", "cert_sha256", "software_vendor", "software_product")


def scan_violations(spark: SparkSession, folder: str) -> DataFrame:
    made = scan.normalize(*pages(spark, folder))
    return made.violations


QUERIES = {f.__name__: f for f in (scan_hosts, scan_services, scan_violations)}

_SQL = f"""
{VIEWS},
seen as (
  select *, case when n % 4 = 0 then 'watch-' || n || '-' || strftime(day, '%Y%m%d') else 'scan-' || query_run_id || '-' || strftime(day, '%Y%m%d') end as run_id, '8.' || (n // 65536 % 256) || '.' || (n // 256 % 256) || '.' || (n % 256) as ip
  from (select h.*, cast(split_part(h.indicator_id, '-', 2) as bigint) as n, date_trunc('day', observed_at) as day from hosts_v h where host_observed and exists (select 1 from services_v s where s.observation_id = h.observation_id))),
judged as (
  select *, n % 20 = 8 and n % 4 = 0 as nothing, case when n % 28 = 0 then 'q0_other_ip' when day(day) % 10 = 1 then 'observed_after_collected' when row_number() over (partition by run_id, ip order by observed_at, observation_id) > 1 then 'address_repeated' end as reason from seen)"""
ORACLES = {
    "scan_hosts": f"""
with {_SQL}
select 'obs-' || sha256(run_id || '|' || ip)[1:20] as observation_id, case when n % 5 <> 0 then indicator_id else 'ioc-' || sha256('scan|ip|' || ip)[1:20] end as indicator_id, date_trunc('second', observed_at) as observed_at, true as host_observed, null::varchar as negative_reason, asn, run_id as query_run_id
from judged where reason is null and not nothing
union all select distinct 'obs-' || sha256(run_id || '|not-found')[1:20], indicator_id, null::timestamp, false, 'not_found', null::bigint, run_id from judged where nothing""",
    "scan_services": f"""
with {_SQL}, s as (select 'obs-' || sha256(run_id || '|' || ip)[1:20] as obs, v.* from judged j join services_v v using (observation_id) where reason is null and not nothing)
select 'svc-' || sha256(obs || '|' || port || '|tcp')[1:20] as service_observation_id, obs as observation_id, port, 'tcp' as transport, protocol, jarm, cert_sha256, 'acme' as software_vendor, software_product from s""",
    "scan_violations": f"with {_SQL} select run_id, ip, reason from judged where reason is not null and not nothing",
}
