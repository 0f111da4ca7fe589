"""Queries over the star-schema tables: page logs, prechecks, rules, ledgers, grades, audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import audit, constraints, corpus, mining, pivots, prospective, rules, scan
from ..sources import ledger
from ..sources.readers import table


def _text(prefix: str, column: str):
    return F.concat(F.lit(f"{prefix}-"), F.col(column).cast("string"))


_LINE = ("l_partkey", "l_quantity", "l_returnflag", "l_shipdate", "l_linestatus")


def _lines(spark: SparkSession, folder: str) -> DataFrame:
    """lineitem with one row for each order and line number."""
    return table(spark, folder, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(*[F.min(c).alias(c) for c in _LINE])


_LINES = f"lines as (select l_orderkey, l_linenumber, {', '.join(f'min({c}) as {c}' for c in _LINE)} from lineitem group by 1, 2)"


def _page_log(spark: SparkSession, folder: str) -> DataFrame:
    """Order = run, line = page; some pages and hashes are wrong."""
    n = F.col("l_orderkey") + F.col("l_linenumber")
    rows = _lines(spark, folder).where((F.col("l_orderkey") + F.col("l_linenumber")) % 37 != 0)
    return rows.select(
        _text("run", "l_orderkey").alias("run_id"), F.col("l_linenumber").alias("page_number"), F.col("l_partkey").alias("page_hash"), F.when(n % 41 == 0, F.lit(-1)).otherwise(F.col("l_partkey")).alias("stored_hash"),
        F.col("l_orderkey").alias("query_hash"), F.when(n % 43 == 0, F.lit(-1)).otherwise(F.col("l_orderkey")).alias("run_query_hash"), F.floor("l_quantity").alias("cumulative_hits"),
        F.when(F.col("l_returnflag") != "R", F.concat_ws("-", F.lit("t"), F.when(n % 5 == 0, F.lit(0)).otherwise(F.col("l_linenumber")).cast("string"))).alias("next_page_token"), F.when(F.col("l_orderkey") % 2 == 0, "complete").otherwise("partial").alias("run_status"),
    )


def page_log_audit(spark: SparkSession, folder: str) -> DataFrame:
    return scan.page_log_audit(_page_log(spark, folder)).select("run_id", "page_number", "violation")


def run_accounting(spark: SparkSession, folder: str) -> DataFrame:
    return scan.run_accounting(_page_log(spark, folder), max_pages=4)


def precheck_eligibility(spark: SparkSession, folder: str) -> DataFrame:
    o = table(spark, folder, "orders")
    prechecks = o.select(_text("pre", "o_orderkey").alias("precheck_id"), F.when(F.col("o_orderkey") % 11 == 0, F.array(F.lit("restricted"), F.lit("broad_shared"))).when(F.col("o_orderkey") % 11 == 1, F.array(F.lit("harmless"))).alias("risk_flags"))
    li = _lines(spark, folder)
    status = F.when(F.col("l_returnflag") == "N", "complete").when(F.col("l_returnflag") == "A", "partial_max_pages").otherwise("failed")
    results = li.select(_text("pre", "l_orderkey").alias("precheck_id"), F.concat_ws("-", F.lit("res"), "l_orderkey", "l_linenumber").alias("result_id"), status.alias("status"), F.pmod("l_partkey", F.lit(4)).alias("hit_count"), F.col("l_shipdate").alias("recorded_at"))
    reviews = o.where("o_orderkey % 3 <> 0").select(_text("pre", "o_orderkey").alias("precheck_id"), F.when(F.col("o_orderkey") % 3 == 1, "accepted").otherwise("rejected").alias("decision"))
    return pivots.precheck_eligibility(prechecks, results, reviews).select("precheck_id", "eligible", "reason")


def hit_distribution(spark: SparkSession, folder: str) -> DataFrame:
    told = pivots.hit_distribution(table(spark, folder, "lineitem"), "l_suppkey", "l_returnflag")
    return told.select("l_suppkey", F.array_join(F.transform(F.map_entries("hit_distribution"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",").alias("distribution"))


def precheck_definitions(spark: SparkSession, folder: str) -> DataFrame:
    roles = F.element_at(F.array(*map(F.lit, ("relay_orb", "staging", "controller", "c2", "scanner"))), (F.col("l_linenumber") % 5 + 1).cast("int"))
    li = table(spark, folder, "lineitem")
    rows = li.select(
        _text("q", "l_orderkey").alias("query_id"), F.lit("h").alias("query_hash"), F.lit("node").alias("node_id"), F.lit("1998-01-01").cast("timestamp_ntz").alias("cutoff_at"), F.lit(2).alias("page_budget"),
        F.concat_ws("-", F.lit("as"), "l_orderkey", "l_linenumber").alias("assertion_id"), F.when(F.col("l_orderkey") % 8 == 0, F.when(F.col("l_linenumber") % 2 == 0, "relay_orb").otherwise("staging")).otherwise(roles).alias("role"),
        F.when(F.col("l_tax") > 0.04, "domain").otherwise("cert").alias("scope"), F.col("l_shipdate").alias("available_at"), F.when(F.col("l_returnflag") == "R", F.array(F.lit("restricted"))).alias("risk_flags"),
    )
    told = pivots.precheck_definitions(rows)
    return told.select("precheck_id", "query_id", F.array_join("roles", ",").alias("roles"), "scope", F.array_join("risk_flags", ",").alias("risk_flags"), "source_available_at", "reason")


def composites(spark: SparkSession, folder: str) -> DataFrame:
    li = table(spark, folder, "lineitem")
    role = F.when(F.col("l_orderkey") % 2 == 0, F.when(F.col("l_linenumber") == 1, "c2").otherwise("controller")).when(F.col("l_linenumber") == 1, "scanner").otherwise("staging")
    rows = li.select(_text("node", "l_orderkey").alias("node_id"), F.concat_ws("-", F.lit("as"), "l_orderkey", "l_linenumber").alias("assertion_id"), role.alias("role"), F.col("l_shipdate").alias("available_at"))
    windows = table(spark, folder, "orders").select(_text("node", "o_orderkey").alias("node_id"), F.col("o_orderdate").alias("window_start"), (F.col("o_orderdate") + F.expr("interval 90 days")).alias("window_end"))
    return pivots.composites(rows, windows).select("composite_id", "node_id", F.array_join("roles", ",").alias("roles"), "available_at", "reason")


def rule_match(spark: SparkSession, folder: str) -> DataFrame:
    """An order is a host, the brands, types and sizes of its parts are its features."""
    li, p = table(spark, folder, "lineitem").select("l_orderkey", "l_partkey"), table(spark, folder, "part")
    shipped = li.join(p, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("entity"), F.inline(F.array(F.struct(F.lit("brand").alias("query_field"), F.col("p_brand").alias("canonical_value")), F.struct(F.lit("type").alias("query_field"), F.col("p_type").alias("canonical_value")), F.struct(F.lit("size").alias("query_field"), F.col("p_size").cast("string").alias("canonical_value")))))
    return rules.match_rules(shipped, _clauses(spark, folder), "entity")


def _clauses(spark: SparkSession, folder: str) -> DataFrame:
    """A rule for each brand: the brand is required, one of the types of its large parts must be there,
    and a size that its number of parts picks is excluded."""
    p = table(spark, folder, "part")
    rule = F.concat(F.lit("rule-"), "p_brand").alias("design_id")
    clause = lambda role, field, value: (F.concat_ws("-", F.lit("c"), F.lit(field), value).alias("clause_id"), F.lit(role).alias("logical_role"), F.lit(field).alias("query_field"), value.alias("canonical_value"))
    required = p.select(rule, *clause("required", "brand", F.col("p_brand"))).distinct()
    alternative = p.where("p_size >= 45").select(rule, *clause("alternative", "type", F.col("p_type"))).distinct()
    size = (F.col("n") % 50 + 1).cast("string")
    return required.unionAll(alternative).unionAll(p.groupBy("p_brand").agg(F.count("*").alias("n")).select(rule, *clause("exclusion", "size", size)))


def rule_render(spark: SparkSession, folder: str) -> DataFrame:
    p = table(spark, folder, "part")
    role = F.when(F.col("p_partkey") % 5 == 0, "exclusion").when(F.col("p_partkey") % 2 == 0, "alternative").otherwise("required")
    rows = p.select((F.col("p_partkey") % 97).alias("design_id"), F.concat(F.lit("c-"), F.lpad(F.col("p_partkey").cast("string"), 9, "0")).alias("clause_id"), role.alias("logical_role"), F.col("p_brand").alias("query_field"), F.concat("p_name", F.lit(' "x"')).alias("canonical_value"))
    return rules.render(rows)


def budgeted_alerts(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return rules.budgeted(rows, "o_custkey", ["o_orderdate", "o_orderkey"], 3)


def execution_status(spark: SparkSession, folder: str) -> DataFrame:
    o = table(spark, folder, "orders")
    execution = F.when(F.col("o_orderstatus") == "F", "complete").when(F.col("o_orderstatus") == "O", "partial_max_pages").otherwise("failed")
    end = F.col("o_orderdate").cast("timestamp_ntz") + F.expr("interval 7 days")
    seen = F.col("o_orderdate").cast("timestamp_ntz") + F.make_dt_interval((F.col("o_orderkey") % 11).cast("int"))
    return o.select("o_orderkey", prospective.execution_status(F.when(F.col("o_orderkey") % 29 == 0, "odd").otherwise(execution), seen, end).alias("status"))


def execution_gate(spark: SparkSession, folder: str) -> DataFrame:
    o, c = table(spark, folder, "orders"), table(spark, folder, "customer")
    runs = o.select("o_orderkey", F.col("o_custkey").alias("query_id"), F.when(F.col("o_orderkey") % 2 == 0, "prospective_test").otherwise("development").alias("split"), F.col("o_orderdate").alias("executed_at"), (F.col("o_orderdate") - F.make_dt_interval((F.col("o_orderkey") % 5 - 1).cast("int"))).alias("cutoff_at"))
    status = F.when(F.col("c_custkey") % 3 == 0, "draft").otherwise("frozen")
    queries = c.where("c_custkey % 10 <> 7").select(F.col("c_custkey").alias("query_id"), status.alias("status"), F.lit("1995-06-01").cast("timestamp_ntz").alias("valid_for_test_from"), F.when(F.col("c_custkey") % 4 == 0, F.lit("1996-01-01").cast("timestamp_ntz")).alias("source_available_at"))
    return prospective.execution_gate(runs, queries).select("o_orderkey", "reason")


def grade_chain(spark: SparkSession, folder: str) -> DataFrame:
    """Orders of a customer are grades of a candidate; each names the one before, some wrongly."""
    o = table(spark, folder, "orders").select(F.col("o_custkey").alias("candidate_id"), F.col("o_orderkey").alias("grade_event_id"), F.col("o_orderdate").alias("graded_at"), F.col("o_orderpriority").alias("grade"))
    from pyspark.sql import Window

    before = F.lag("grade_event_id").over(Window.partitionBy("candidate_id").orderBy("graded_at", "grade_event_id"))
    named = o.withColumn("previous_grade_event_id", F.when(F.col("grade_event_id") % 13 == 0, F.lit(0)).otherwise(before))
    return prospective.grade_chain(named).select("candidate_id", "grade_event_id", "reason")


def current_grades(spark: SparkSession, folder: str) -> DataFrame:
    o = table(spark, folder, "orders").select(F.col("o_custkey").alias("candidate_id"), F.col("o_orderkey").alias("grade_event_id"), F.col("o_orderdate").alias("graded_at"), F.col("o_orderpriority").alias("grade"))
    return prospective.current_grades(o)


def _batches(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """What is stored, and a batch of new rows, replays, changed rows and rows given twice."""
    o = table(spark, folder, "orders").select("o_orderkey", "o_custkey", F.col("o_orderdate").alias("first_available_at"))
    stored = o.where("o_orderkey % 3 <> 0")
    k = F.col("o_orderkey")
    batch = o.where("o_orderkey % 2 = 0").withColumn("o_custkey", F.when(k % 14 == 0, F.col("o_custkey") + 1).otherwise(F.col("o_custkey"))).withColumn("first_available_at", F.when(k % 10 == 0, F.col("first_available_at") - F.expr("interval 1 day")).otherwise(F.col("first_available_at")))
    again = batch.where("o_orderkey % 9 = 0")
    other = batch.where("o_orderkey % 33 = 0").withColumn("o_custkey", F.col("o_custkey") + 5)
    return batch.unionAll(again).unionAll(other), stored


def immutable_append_classify(spark: SparkSession, folder: str) -> DataFrame:
    told = ledger.classify(*_batches(spark, folder), ["o_orderkey"])
    return told.groupBy("o_orderkey", "action").agg(F.count("*").alias("rows"))


def backfill_classify(spark: SparkSession, folder: str) -> DataFrame:
    told = ledger.classify(*_batches(spark, folder), ["o_orderkey"], earliest="first_available_at")
    return told.groupBy("action").agg(F.count("*").alias("rows"))


def latest_state(spark: SparkSession, folder: str) -> DataFrame:
    li = _lines(spark, folder).select("l_orderkey", "l_linenumber", "l_shipdate", "l_linestatus")
    return ledger.latest(li, ["l_orderkey"], "l_shipdate", "l_linenumber")


def counter_history(spark: SparkSession, folder: str) -> DataFrame:
    li = _lines(spark, folder).select("l_orderkey", "l_linenumber", F.floor("l_quantity").alias("hit_count"), F.when(F.col("l_returnflag") == "N", "partial").when(F.col("l_returnflag") == "A", "partial_max_pages").otherwise("complete").alias("status"))
    return prospective.monotone(li, ["l_orderkey"], ["l_linenumber"], ["hit_count"]).select("l_orderkey", "l_linenumber", "violation")


def audit_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as sources with some bad rows; labels as assertions on them."""
    d = table(spark, folder, "documents")
    precision = F.when(F.col("doc_id") % 7 == 0, "date").otherwise("exact_timestamp")
    docs = d.where("doc_id % 23 <> 0").select(
        _text("doc", "doc_id").alias("document_id"), F.when(F.col("doc_id") % 19 == 0, "bad").otherwise(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)).alias("content_sha256"), precision.alias("published_time_precision"),
        F.when(F.col("doc_id") % 5 != 0, F.lit("2025-01-01").cast("timestamp_ntz")).alias("published_at"), F.lit("2025-01-01").alias("published_at_raw"), F.lit("2025-02-01").cast("timestamp_ntz").alias("retrieved_at"),
    )
    memberships = d.where("doc_id % 11 <> 0").select(_text("doc", "doc_id").alias("document_id"), F.concat(F.lit("family-"), "source").alias("source_family_id"))
    families = d.groupBy("source").agg(F.min("doc_id").alias("first")).select(F.concat(F.lit("family-"), "source").alias("source_family_id"), _text("doc", "first").alias("canonical_document_id"))
    claims = table(spark, folder, "labels").select(_text("as", "doc_id").alias("assertion_id"), _text("doc", "doc_id").alias("document_id"))
    return audit.audit_corpus(docs, families, memberships, claims)


def constraint_violations(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events")
    rows = e.select(F.col("event_id").alias("opportunity_id"), F.col("ts").alias("due_at"), (F.col("ts") + F.make_dt_interval(F.lit(0), (F.col("event_id") % 4).cast("int"))).alias("window_end"), F.when(F.col("event_id") % 3 == 0, "missed").otherwise("complete").alias("status"), F.when(F.col("event_id") % 5 != 0, F.lit("run")).alias("query_run_id"), F.when(F.col("event_id") % 2 == 0, F.lit("late")).alias("reason"))
    told = constraints.check(rows, "opportunities").withColumn("violations", F.array_join("violations", ","))
    return told.groupBy("violations").agg(F.count("*").alias("rows"))


def public_manifest(spark: SparkSession, folder: str) -> DataFrame:
    s = table(spark, folder, "supplier")
    docs = s.where("s_suppkey % 7 <> 0").select(_text("doc", "s_suppkey").alias("document_id"), F.col("s_name").alias("publisher"), F.lit("h").alias("content_sha256"), F.when(F.col("s_nationkey") % 2 == 0, "public").otherwise("restricted").alias("source_access_class"), F.col("s_acctbal").alias("internal"))
    wanted = s.where("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("position"), _text("doc", "s_suppkey").alias("document_id"))
    return ledger.public_manifest(docs, wanted)


def screening(spark: SparkSession, folder: str) -> DataFrame:
    c, o = table(spark, folder, "customer"), table(spark, folder, "orders")
    cands = c.select(_text("cand", "c_custkey").alias("candidate_id"))
    # orders of customers are decisions on them; every fifth customer's are on a candidate that is not there
    decisions = o.select(F.concat(F.lit("cand-"), (F.col("o_custkey") + F.when(F.col("o_custkey") % 5 == 0, 10_000_000).otherwise(0)).cast("string")).alias("candidate_id"), F.when(F.col("o_orderstatus") == "F", "include").otherwise("exclude").alias("decision"))
    return mining.apply_screening(cands, decisions).groupBy("reason", "included").agg(F.count("*").alias("candidates"))


def review_gate(spark: SparkSession, folder: str) -> DataFrame:
    o, c = table(spark, folder, "orders"), table(spark, folder, "customer")
    reviews = o.select("o_orderkey", F.col("o_custkey").alias("subject_id"), F.when(F.col("o_orderstatus") == "F", "accepted").otherwise("rejected").alias("decision"), F.col("o_orderdate").alias("reviewed_at"))
    subjects = c.where("c_custkey % 13 <> 0").select(F.col("c_custkey").alias("subject_id"), F.lit("1994-01-01").cast("timestamp_ntz").alias("assessed_at"), (F.col("c_acctbal") > 0).alias("good"))
    return corpus.review_gate(reviews, subjects, "subject_id", F.col("good")).select("o_orderkey", "reason")


QUERIES = {f.__name__: f for f in (
    page_log_audit, run_accounting, precheck_eligibility, hit_distribution, precheck_definitions, composites, rule_match, rule_render, budgeted_alerts, execution_status, execution_gate, grade_chain, current_grades,
    immutable_append_classify, backfill_classify, latest_state, counter_history, audit_corpus, constraint_violations, public_manifest, screening, review_gate,
)}

_LOG = f"""
{_LINES}, log as (
  select 'run-' || l_orderkey as run_id, l_linenumber as page_number, l_partkey as page_hash, case when n % 41 = 0 then -1 else l_partkey end as stored_hash, l_orderkey as query_hash, case when n % 43 = 0 then -1 else l_orderkey end as run_query_hash,
         floor(l_quantity)::bigint as cumulative_hits, case when l_returnflag <> 'R' then 't-' || case when n % 5 = 0 then 0 else l_linenumber end end as next_page_token, case when l_orderkey % 2 = 0 then 'complete' else 'partial' end as run_status
  from (select *, l_orderkey + l_linenumber as n from lines) where n % 37 <> 0)"""
_CLAUSES = """
clauses as (
  select distinct 'rule-' || p_brand as design_id, 'c-brand-' || p_brand as clause_id, 'required' as role, 'brand' as field, p_brand as value from part
  union all select distinct 'rule-' || p_brand, 'c-type-' || p_type, 'alternative', 'type', p_type from part where p_size >= 45
  union all select 'rule-' || p_brand, 'c-size-' || (count(*) % 50 + 1), 'exclusion', 'size', (count(*) % 50 + 1)::varchar from part group by p_brand)"""
_BATCH = """
o as (select o_orderkey as k, o_custkey as c, o_orderdate as t from orders),
stored as (select * from o where k % 3 <> 0),
base as (select k, case when k % 14 = 0 then c + 1 else c end as c, case when k % 10 = 0 then t - interval 1 day else t end as t from o where k % 2 = 0),
batch as (select * from base union all select * from base where k % 9 = 0 union all select k, c + 5, t from base where k % 33 = 0)"""

ORACLES = {
    "page_log_audit": f"""
with {_LOG}, told as (select *, row_number() over w as nth, lag(cumulative_hits) over w as before, page_number = max(page_number) over (partition by run_id) as last from log window w as (partition by run_id order by page_number))
select run_id, page_number, case when page_number <> nth then 'page_gap' when page_hash <> stored_hash then 'page_hash_mismatch' when query_hash <> run_query_hash then 'query_hash_mismatch' when cumulative_hits < before then 'hits_decrease'
  when not last and next_page_token is null then 'token_missing' when last and run_status = 'complete' and next_page_token is not null then 'complete_with_token' when last and run_status <> 'complete' and next_page_token is null then 'incomplete_without_token' end as violation from told""",
    "run_accounting": f"""
with {_LOG}, got as (select run_id, count(*) as pages, arg_max(cumulative_hits, page_number) as hits, max(page_number) as m, count(next_page_token) > count(distinct next_page_token) as loop from log group by 1)
select g.run_id, pages, hits, l.next_page_token as resume_token, case when loop then 'token_loop' when l.next_page_token is null then 'complete' when pages >= 4 then 'partial_max_pages' else 'resumable' end as status
from got g join log l on l.run_id = g.run_id and l.page_number = g.m""",
    "precheck_eligibility": f"""
with {_LINES}, latest as (select *, row_number() over (partition by l_orderkey order by l_shipdate desc, 'res-' || l_orderkey || '-' || l_linenumber desc) as r from lines),
told as (select o.o_orderkey as k, case l_returnflag when 'N' then 'complete' when 'A' then 'partial_max_pages' when 'R' then 'failed' end as status, l_partkey % 4 as hits from orders o left join latest l on l.l_orderkey = o.o_orderkey and l.r = 1),
reasons as (select k, case when k % 11 = 0 then 'broad_shared' when status is null then 'precheck_missing' when status <> 'complete' then 'precheck_' || status when hits = 0 then 'zero_hit_not_death_evidence' when k % 3 = 0 then 'human_review_required' when k % 3 = 2 then 'human_review_rejected' else 'eligible_q2_source' end as reason from told)
select 'pre-' || k as precheck_id, reason = 'eligible_q2_source' as eligible, reason from reasons""",
    "hit_distribution": "select l_suppkey, string_agg(l_returnflag || '=' || n, ',' order by l_returnflag) as distribution from (select l_suppkey, l_returnflag, count(*) as n from lineitem group by 1, 2) group by 1",
    "precheck_definitions": """
with rows as (
  select l_orderkey as k, 'as-' || l_orderkey || '-' || l_linenumber as a, case when l_orderkey % 8 = 0 then case when l_linenumber % 2 = 0 then 'relay_orb' else 'staging' end else ['relay_orb', 'staging', 'controller', 'c2', 'scanner'][l_linenumber % 5 + 1] end as role,
         case when l_tax > 0.04 then 'domain' else 'cert' end as scope, l_shipdate as t, l_returnflag as f from lineitem),
each as (select k, list_sort(list(a)) as ids, list_sort(list(distinct role)) as roles, count(distinct scope) as n, min(scope) as scope, bool_or(f = 'R') as restricted, max(t) as t from rows group by k),
told as (select *, len(list_filter(roles, lambda r: r not in ('relay_orb', 'staging'))) = 0 or len(list_filter(roles, lambda r: r not in ('controller', 'c2'))) = 0 or roles = ['scanner'] as fine from each)
select 'precheck-' || sha256('q-' || k || '|h|node|1998-01-01T00:00:00+00:00|2|' || array_to_string(ids, '|'))[1:20] as precheck_id, 'q-' || k as query_id, array_to_string(roles, ',') as roles, case when n = 1 then scope else 'composite' end as scope,
  array_to_string(list_filter([case when restricted then 'restricted' end, case when not fine then 'role_conflict' end], lambda x: x is not null), ',') as risk_flags, t as source_available_at, case when t > timestamp '1998-01-01' then 'source_after_cutoff' end as reason from told""",
    "composites": """
with rows as (
  select l_orderkey as k, 'as-' || l_orderkey || '-' || l_linenumber as a, case when l_orderkey % 2 = 0 then case when l_linenumber = 1 then 'c2' else 'controller' end when l_linenumber = 1 then 'scanner' else 'staging' end as role, l_shipdate as t, o_orderdate as ws, o_orderdate + interval 90 day as we
  from lineitem join orders on o_orderkey = l_orderkey),
each as (select k, ws, we, list_sort(list(distinct a)) as ids, count(*) as n, list_sort(list(distinct role)) as roles, max(t) as t, bool_and(t between ws and we) as inside from rows group by 1, 2, 3),
told as (select *, case when n < 2 then 'too_few_assertions' when not inside then 'outside_window' when not (roles in (['c2'], ['controller'], ['c2', 'controller'], ['scanner'], ['staging'])) then 'incompatible_roles' when len(ids) <> n then 'duplicate_assertions' end as reason from each)
select case when reason is null then 'cti-composite-' || sha256('node-' || k || '|' || strftime(ws, '%Y-%m-%dT%H:%M:%S+00:00') || '|' || strftime(we, '%Y-%m-%dT%H:%M:%S+00:00') || '|' || array_to_string(ids, '|'))[1:20] end as composite_id, 'node-' || k as node_id, array_to_string(roles, ',') as roles, t as available_at, reason from told""",
    "rule_match": f"""
with {_CLAUSES}, shipped as (select distinct l_orderkey as entity, p_brand, p_type, p_size from lineitem join part on p_partkey = l_partkey),
seen as (select entity, 'brand' as field, p_brand as value from shipped union select entity, 'type', p_type from shipped union select entity, 'size', p_size::varchar from shipped),
hits as (select distinct design_id, entity, clause_id, role from seen join clauses using (field, value)),
needs as (select design_id, count(*) filter (role = 'required') as r, count(*) filter (role = 'alternative') as a from clauses group by 1)
select design_id, entity from hits join needs using (design_id) group by design_id, entity, r, a
having count(*) filter (role = 'required') = r and (a = 0 or count(*) filter (role = 'alternative') > 0) and count(*) filter (role = 'exclusion') = 0 and r + a > 0""",
    "rule_render": r"""
with rows as (
  select p_partkey % 97 as design_id, lpad(p_partkey::varchar, 9, '0') as c, case when p_partkey % 5 = 0 then 'x' when p_partkey % 2 = 0 then 'a' else 'r' end as role, p_brand || ': "' || p_name || ' \"x\"' || '"' as t from part),
each as (select design_id, string_agg(t, ' AND ' order by c) filter (role = 'r') as r, '(' || string_agg(t, ' OR ' order by c) filter (role = 'a') || ')' as a, string_agg('NOT (' || t || ')', ' AND ' order by c) filter (role = 'x') as x from rows group by 1)
select design_id, concat_ws(' AND ', r, a, x) as rule from each where r is not null or a is not null""",
    "budgeted_alerts": "select o_custkey, o_orderkey, o_orderdate from (select *, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as n from orders) where n <= 3",
    "execution_status": "select o_orderkey, case when o_orderkey % 29 = 0 then 'unsupported' when o_orderstatus = 'O' then 'partial' when o_orderstatus <> 'F' then 'failed' when o_orderkey % 11 >= 7 then 'late' else 'complete' end as status from orders",
    "execution_gate": """
select o_orderkey, case when o_custkey % 10 = 7 then 'query_unknown' when o_orderkey % 5 = 0 then 'cutoff_after_execution' when o_custkey % 4 = 0 and timestamp '1996-01-01' > o_orderdate - (o_orderkey % 5 - 1) * interval 1 day then 'source_after_cutoff'
  when o_orderkey % 2 = 0 and o_custkey % 3 = 0 then 'query_not_frozen' when o_orderkey % 2 = 0 and o_orderdate < timestamp '1995-06-01' then 'before_valid_from' end as reason from orders""",
    "grade_chain": "select o_custkey as candidate_id, o_orderkey as grade_event_id, case when o_orderkey % 13 = 0 then 'previous_mismatch' end as reason from orders",
    "current_grades": "select o_custkey as candidate_id, arg_max(o_orderpriority, (o_orderdate, o_orderkey)) as grade from orders group by 1",
    "immutable_append_classify": f"""
with {_BATCH}, told as (
  select b.k, b.c, b.t, case when s.k is not null and (s.c <> b.c or s.t <> b.t) then 'conflict' when count(distinct (b.c, b.t)) over (partition by b.k) > 1 then 'conflict' when s.k is not null then 'noop' when row_number() over (partition by b.k order by b.c, b.t) > 1 then 'duplicate' else 'insert' end as action
  from batch b left join stored s on s.k = b.k)
select k as o_orderkey, action, count(*) as rows from told group by 1, 2""",
    "backfill_classify": f"""
with {_BATCH}, told as (
  select case when s.k is not null and s.c <> b.c then 'conflict' when count(distinct b.c) over (partition by b.k) > 1 then 'conflict' when s.k is not null and b.t < s.t then 'backfill_conflict' when s.k is not null then 'noop' when row_number() over (partition by b.k order by b.t, b.c) > 1 then 'duplicate' else 'insert' end as action
  from batch b left join stored s on s.k = b.k)
select action, count(*) as rows from told group by 1""",
    "latest_state": f"with {_LINES} select l_orderkey, arg_max(l_linenumber, (l_shipdate, l_linenumber)) as l_linenumber, arg_max(l_shipdate, (l_shipdate, l_linenumber)) as l_shipdate, arg_max(l_linestatus, (l_shipdate, l_linenumber)) as l_linestatus from lines group by 1",
    "counter_history": f"""
with {_LINES} select l_orderkey, l_linenumber, case when lag(l_returnflag) over w = 'R' then 'terminal_status' when floor(l_quantity) < lag(floor(l_quantity)) over w then 'counter_decrease' end as violation
from lines window w as (partition by l_orderkey order by l_linenumber)""",
    "audit_corpus": """
with docs as (select doc_id, case when doc_id % 7 = 0 then 'date' else 'exact_timestamp' end as p, doc_id % 5 <> 0 as has_time from documents where doc_id % 23 <> 0),
bad as (select doc_id, array_to_string(list_filter([case when p <> 'exact_timestamp' and has_time then 'coarse_time_promoted' end, case when doc_id % 19 = 0 then 'content_hash_invalid' end, case when p = 'exact_timestamp' and not has_time then 'exact_time_missing' end], lambda x: x is not null), ',') as detail from docs),
families as (select source, min(doc_id) as first from documents group by 1)
select 'invalid_source_documents' as code, 'doc-' || doc_id as record_id, detail from bad where detail <> ''
union all select 'missing_source_family', 'doc-' || doc_id, null from docs where doc_id % 11 = 0
union all select 'unknown_document', 'doc-' || doc_id, null from documents where doc_id % 11 <> 0 and doc_id % 23 = 0
union all select 'missing_canonical_document', 'family-' || source, null from families where first % 23 = 0
union all select 'invalid_canonical_membership', 'family-' || source, null from families where first % 11 = 0
union all select 'invalid_assertion_document', 'as-' || doc_id, null from labels where doc_id not in (select doc_id from docs)""",
    "constraint_violations": """
select array_to_string(list_filter([case when event_id % 3 = 0 and event_id % 2 <> 0 then 'missed_without_reason' end, case when event_id % 3 <> 0 and event_id % 5 = 0 then 'run_missing' end, case when event_id % 4 = 0 then 'window_reversed' end], lambda x: x is not null), ',') as violations, count(*) as rows from events group by 1""",
    "public_manifest": """
select position, document_id, case when reason is null then publisher end as publisher, case when reason is null then 'h' end as content_sha256, case when reason is null then 'public' end as source_access_class, reason from (
  select s_suppkey as position, 'doc-' || s_suppkey as document_id, s_name as publisher, case when s_suppkey % 7 = 0 then 'missing' when s_nationkey % 2 <> 0 then 'restricted' end as reason from supplier where s_suppkey % 2 = 0)""",
    "screening": """
with d as (select 'cand-' || (o_custkey + case when o_custkey % 5 = 0 then 10000000 else 0 end) as id, min(case when o_orderstatus = 'F' then 'include' else 'exclude' end) as decision, count(*) as n from orders group by 1),
told as (select case when c.c_custkey is null then 'unknown_candidate' when n > 1 then 'conflicting_decisions' when decision is null then 'undecided' end as reason, decision from (select c_custkey, 'cand-' || c_custkey as id from customer) c full join d using (id))
select reason, coalesce(reason is null and decision = 'include', false) as included, count(*) as candidates from told group by 1, 2""",
    "review_gate": """
with r as (select *, count(*) over (partition by o_custkey) as n from orders)
select o_orderkey, case when o_custkey % 13 = 0 then 'unknown_subject' when o_orderdate < timestamp '1994-01-01' then 'review_predates_subject' when n > 1 then 'reviewed_twice' when o_orderstatus = 'F' and c_acctbal <= 0 then 'subject_does_not_qualify' end as reason
from r left join customer on c_custkey = o_custkey""",
}
