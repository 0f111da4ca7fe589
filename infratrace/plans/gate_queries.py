"""Gates, checks and audits over tables that orders, customers, lines and parts stand for.

Each case names its input tables in SQL that Spark and the checking engine both read; the operator
runs on them here, and the query beside it says in SQL what should come out. Remainders of keys plant
every fault that a gate knows.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import group_hash, sha256_text
from ..operators import audit, background, constraints, corpus, mining, pivots, prospective, rules, timeline
from ..sources.readers import table

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "labels")
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def view(spark: SparkSession, folder: str, text: str) -> DataFrame:
    """The result of SQL over the driver's tables."""
    named = {t for t in TABLES if re.search(rf"\b(from|join) {t}\b", text)}
    plain = text.replace("{", "{{").replace("}", "}}")
    return spark.sql(re.sub(rf"\b(from|join) ({'|'.join(TABLES)})\b", r"\1 {\2}", plain), **{t: table(spark, folder, t) for t in named})


def case(name: str, run: Callable[..., DataFrame], sql: str, **inputs: str) -> None:
    """Register a query: run(**tables) and the SQL over the same tables."""
    QUERIES[name] = lambda spark, folder: run(**{k: view(spark, folder, t) for k, t in inputs.items()})
    ORACLES[name] = "with " + ",\n".join(f"{k} as ({t})" for k, t in inputs.items()) + sql


def text_of(prefix: str, of: str) -> str:
    return f"concat('{prefix}', cast({of} as string))"


AT = "timestamp '1996-07-01 00:00:00'"
#: Orders with short names, their customer's number and a remainder of both.
O = "(select o_orderkey as k, o_custkey as c, o_orderstatus as s, o_orderdate as d, o_totalprice as p from orders) o"  # noqa: E741

# -- corpus -----------------------------------------------------------------------------------------

_ASSERTIONS = f"select {text_of('as-', 'k')} as assertion_id, {text_of('i-', 'c')} as indicator_id, {text_of('d-', 'k % 100')} as document_id, {text_of('m-', 'k')} as source_mention_id, case when s = 'F' then 'c2' else 'relay_orb' end as role, d as available_at, k, c from {O}"
_REVIEWS = f"""select {text_of('as-', 'k')} as assertion_id, {text_of('r-', 'k')} as review_id, case when k % 7 = 1 then 'rejected' else 'accepted' end as decision, case when k % 3 = 0 then 'staging' when k % 29 = 0 then 'victim' when s <> 'F' then 'c2' end as reviewed_role,
  case when k % 31 = 0 then 0.0 else 0.5 end + 0e0 as source_confidence, case when k % 37 <> 0 then 0.9e0 end as extraction_confidence, 0.9e0 as role_confidence, d + interval 2 day - (k % 4) * interval 1 day as reviewed_at, case when k % 41 = 0 then ' ' else 'me' end as reviewer_id from {O} where k % 7 <> 0"""
_MENTIONS = f"""select {text_of('m-', 'k')} as mention_id, {text_of('i-', 'c')} as indicator_id, {text_of('d-', 'k % 100')} as document_id, case when k % 19 = 0 then 'f-x' else {text_of('f-', 'k % 100 % 7')} end as source_family_id, 'domain' as scope,
  case when k % 43 = 0 then 'bad' else repeat('a', 64) end as raw_form_hash, repeat('b', 64) as context_excerpt_hash, case when k % 47 = 0 then d + interval 1 day else d end as observed_at, d as available_at from {O} where k % 11 <> 0"""
_INDICATORS = f"select {text_of('i-', 'c_custkey')} as indicator_id, c_name as normalized_value from customer where c_custkey % 13 <> 0"
_FAMILIES = f"select distinct {text_of('d-', 'o_orderkey % 100')} as document_id, {text_of('f-', 'o_orderkey % 100 % 7')} as source_family_id from orders"

case(
    "accepted_sources",
    lambda assertions_t, reviews_t, mentions_t, indicators_t, families_t: pivots.accepted_sources(assertions_t, reviews_t, mentions_t, indicators_t, families_t, F.lit("1996-07-01").cast("timestamp_ntz")).select("assertion_id", "role", "value", "reason"),
    f"""
select a.assertion_id, coalesce(r.reviewed_role, a.role) as role, i.normalized_value as value, case when r.decision is null then 'review_missing' when r.decision <> 'accepted' then 'review_not_accepted' when m.scope is null then 'mention_missing' when i.normalized_value is null then 'indicator_missing'
  when m.source_family_id = 'f-x' then 'family_mismatch' when a.available_at > {AT} then 'available_after_cutoff' end as reason
from assertions_t a left join reviews_t r using (assertion_id) left join mentions_t m on m.mention_id = a.source_mention_id left join indicators_t i on i.indicator_id = a.indicator_id""",
    assertions_t=_ASSERTIONS, reviews_t=_REVIEWS, mentions_t=_MENTIONS, indicators_t=_INDICATORS, families_t=_FAMILIES,
)
_BUNDLE = f"select {text_of('as-', 'k')} as assertion_id, case when k % 11 = 0 then 'none' else {text_of('m-', 'k')} end as source_mention_id, case when k % 17 = 0 then 'i-x' else {text_of('i-', 'c')} end as indicator_id, {text_of('d-', 'k % 100')} as document_id, case when k % 23 = 0 then d + interval 1 day else d end as available_at from {O}"
_BUNDLE_SQL = """
  select case when i.indicator_id is null then 'mention_indicator_missing' when m.source_family_id = 'f-x' then 'mention_family_mismatch' end as code, m.mention_id as record_id from mentions_t m left join indicators_t i using (indicator_id)
  union all select case when m.mention_id is null then 'assertion_mention_missing' when m.indicator_id <> a.indicator_id or m.available_at <> a.available_at then 'assertion_mention_differs' end, a.assertion_id from bundle_t a left join mentions_t m on m.mention_id = a.source_mention_id"""
case(
    "bundle_checks", lambda mentions_t, bundle_t, indicators_t, families_t: corpus.bundle_checks(mentions_t, bundle_t, indicators_t, families_t),
    f" select code, record_id from ({_BUNDLE_SQL}) where code is not null",
    mentions_t=_MENTIONS, bundle_t=_BUNDLE, indicators_t=_INDICATORS, families_t=_FAMILIES,
)
case(
    "assertion_reviews", lambda reviews_t, assertions_t: corpus.assertion_review_gate(reviews_t, assertions_t.where("k % 5 <> 0")).select("assertion_id", "reason"),
    """
select r.assertion_id, case when a.k is null then 'unknown_subject' when r.reviewed_at < a.available_at then 'review_predates_subject' when r.decision = 'accepted' and coalesce(r.reviewed_role, 'unknown') in ('unknown', 'victim', 'sinkhole') then 'role_not_allowed'
  when r.decision = 'accepted' and (r.source_confidence <= 0 or r.extraction_confidence is null) then 'confidence_missing' end as reason
from reviews_t r left join (select * from assertions_t where k % 5 <> 0) a using (assertion_id)""",
    reviews_t=_REVIEWS, assertions_t=_ASSERTIONS,
)
_CITING = f"select {text_of('q-', 'k')} as query_id, d + interval 1 day - (k % 3) * interval 1 day as registered_at, case when k % 13 = 0 then null else split(concat('as-', cast(k as string), ',as-', cast(k + 1 as string)), ',') end as source_assertion_ids, k from {O}"
case(
    "audit_assertions", lambda mentions_t, bundle_t, reviews_t, indicators_t, families_t, citing_t: audit.audit_assertions(mentions_t, bundle_t, reviews_t, indicators_t, families_t, citing_t),
    f""",
used as (select query_id, registered_at, unnest(source_assertion_ids) as assertion_id from citing_t),
told as (select u.*, r.decision, a.available_at from used u left join reviews_t r using (assertion_id) left join bundle_t a using (assertion_id))
select 'invalid_source_mentions' as code, mention_id as record_id, array_to_string(list_filter([case when source_family_id = '' then 'family_missing' end, case when raw_form_hash = 'bad' then 'hash_invalid' end, case when observed_at > available_at then 'observed_after_available' end], lambda x: x is not null), ',') as detail
from mentions_t where raw_form_hash = 'bad' or observed_at > available_at
union all select 'invalid_assertion_reviews', review_id, detail from (
  select review_id, array_to_string(list_filter([case when decision = 'accepted' and coalesce(reviewed_role, 'unknown') in ('unknown', 'victim', 'sinkhole') then 'accepted_role_invalid' end, case when decision = 'accepted' and extraction_confidence is null then 'accepted_without_confidence' end,
    case when trim(reviewer_id) = '' then 'reviewer_missing' end], lambda x: x is not null), ',') as detail from reviews_t) where detail <> ''
union all select code, record_id, null from ({_BUNDLE_SQL}) where code is not null
union all select 'query_lacks_assertion_provenance', query_id, null from citing_t where source_assertion_ids is null
union all select 'query_uses_unaccepted_assertion', query_id, assertion_id from told where decision is distinct from 'accepted'
union all select 'query_predates_assertion_availability', query_id, assertion_id from told where registered_at < available_at""",
    mentions_t=_MENTIONS, bundle_t=_BUNDLE, reviews_t=_REVIEWS, indicators_t=_INDICATORS, families_t=_FAMILIES, citing_t=_CITING,
)
case(
    "development_documents", lambda docs_t: constraints.development_only(docs_t).groupBy("reason").agg(F.count("*").alias("documents")),
    " select case when trim(coalesce(acquisition_mode, '')) = '' or trim(coalesce(corpus_purpose, '')) = '' then 'provenance_missing' when acquisition_mode = 'prospective_validation' or corpus_purpose = 'prospective_validation' then 'prospective_material' end as reason, count(*) as documents from docs_t group by 1",
    docs_t="select doc_id, case when doc_id % 6 = 0 then ' ' when doc_id % 6 = 1 then 'prospective_validation' else 'search' end as acquisition_mode, case when doc_id % 5 = 0 then null when doc_id % 5 = 1 then 'prospective_validation' else 'development' end as corpus_purpose, 'public' as source_access_class from documents",
)
_RUN_HOSTS = f"select {text_of('obs-', 'c_custkey')} as observation_id, {text_of('run-', 'c_custkey % 9')} as query_run_id from customer"
case(
    "observation_runs", lambda assessed_t, hosts_t, results_t, sources_t: corpus.observation_runs(assessed_t, hosts_t, results_t, sources_t),
    """,
last as (select * from (select *, row_number() over (partition by precheck_id order by recorded_at desc, result_id desc) as n from results_t) where n = 1)
select source_id, query_run_id from (select assessment_id as source_id, unnest(evidence_observation_ids) as observation_id from assessed_t join sources_t on source_id = assessment_id) join hosts_t using (observation_id)
union select precheck_id, collection_run_id from last join sources_t on source_id = precheck_id""",
    assessed_t=f"select {text_of('src-', 'k')} as assessment_id, split(concat('obs-', cast(c as string), ',obs-', cast(c + 1 as string)), ',') as evidence_observation_ids from {O}", hosts_t=_RUN_HOSTS,
    results_t=f"select {text_of('pre-', 'c')} as precheck_id, k as result_id, d as recorded_at, {text_of('col-', 'k % 9')} as collection_run_id from {O}",
    sources_t=f"select {text_of('src-', 'k')} as source_id from {O} where k % 3 = 0 union all select {text_of('pre-', 'c_custkey')} from customer where c_custkey % 4 = 0",
)
_SETS_IN = "select concat('set-', cast(n_nationkey as string)) as reference_set_id, timestamp '1996-07-01 00:00:00' as cutoff_at, split(concat('run-', cast(n_nationkey % 9 as string), ',run-', cast((n_nationkey + 1) % 9 as string)), ',') as source_query_run_ids from nation"
_ANCHOR_HOSTS = f"select {text_of('obs-', 'k')} as observation_id, {text_of('run-', 'k % 9')} as query_run_id, d as collected_at, case when k % 5 <> 0 then d + interval 1 day end as observed_at, k % 11 <> 0 as host_observed from {O}"
case(
    "provenance_gates", lambda sets_t, members_t, hosts_t, runs_t: corpus.provenance_gates(sets_t, members_t, hosts_t, runs_t),
    f""",
used as (select reference_set_id, cutoff_at, unnest(source_query_run_ids) as query_run_id from sets_t),
seen as (select m.*, h.query_run_id, greatest(coalesce(h.observed_at, h.collected_at), h.collected_at) as seen_at from members_t m left join hosts_t h using (observation_id))
select distinct 'set_run_not_complete' as code, reference_set_id as record_id from used left join runs_t using (query_run_id) where status is distinct from 'complete'
union all select 'member_outside_runs', membership_id from seen s where not exists (select 1 from used u where u.reference_set_id = s.reference_set_id and u.query_run_id = s.query_run_id)
union all select 'member_after_cutoff', membership_id from seen where observable and seen_at > {AT}""",
    sets_t=_SETS_IN, hosts_t=_ANCHOR_HOSTS, runs_t="select concat('run-', cast(r_regionkey as string)) as query_run_id, case when r_regionkey = 2 then 'failed' else 'complete' end as status from region",
    members_t=f"select {text_of('mem-', 'k')} as membership_id, {text_of('set-', 'c % 25')} as reference_set_id, {text_of('obs-', 'k + k % 13 % 2')} as observation_id, k % 3 <> 0 as observable from {O}",
)
case(
    "anchor_gates", lambda anchors_t, sets_t, hosts_t, runs_t: corpus.anchor_gates(anchors_t, sets_t, hosts_t, runs_t),
    f"""
select a.reference_set_id, a.observation_id, case when h.collected_at is null then 'anchor_unknown' when not h.host_observed then 'anchor_not_observed' when h.query_run_id not in (select query_run_id from runs_t) then 'anchor_not_authorized'
  when greatest(coalesce(h.observed_at, h.collected_at), h.collected_at) > {AT} then 'anchor_after_cutoff' end as reason from anchors_t a left join hosts_t h using (observation_id)""",
    anchors_t=f"select {text_of('set-', 'c % 25')} as reference_set_id, {text_of('obs-', 'k + k % 13 % 2')} as observation_id from {O}", sets_t=_SETS_IN, hosts_t=_ANCHOR_HOSTS,
    runs_t="select concat('run-', cast(r_regionkey as string)) as query_run_id from region",
)
case(
    "feature_observation_gates", lambda observed_t, hosts_t: corpus.feature_observation_gates(observed_t, hosts_t).groupBy("reason").agg(F.count("*").alias("observations")),
    " select case when h.query_run_id is null or h.query_run_id <> o.query_run_id then 'raw_provenance_mismatch' when h.collected_at <> o.available_at then 'availability_differs' end as reason, count(*) as observations from observed_t o left join hosts_t h using (observation_id) group by 1",
    observed_t=f"select k as feature_observation_id, {text_of('obs-', 'k + k % 13 % 2')} as observation_id, {text_of('run-', '(k + k % 7 % 2) % 9')} as query_run_id, case when k % 4 = 0 then d + interval 1 day else d end as available_at from {O}", hosts_t=_ANCHOR_HOSTS,
)
_PROTOCOLS = f"select {text_of('protocol ', 's_suppkey')} as name, 'v1' as version, case when s_suppkey % 7 = 0 then cast(null as string) else concat('beta,alpha,', s_name) end as q, case when s_suppkey % 11 = 0 then cast(null as string) else 'b.org,a.org,b.org' end as a, case when s_suppkey % 2 = 0 then 'search' end as acquisition_mode, 'public' as source_access_class, s_suppkey from supplier"
_PROTOCOL_SQL = """
  select name, case when q is null then 'queries_missing' when a is null then 'allowlist_missing' end as reason, s_suppkey,
    'search-protocol-' || sha256('{"acquisition_mode":' || case when acquisition_mode is null then 'null' else '"search"' end || ',"allowlist":' || case when a is null then '""' else '"a.org\\nb.org"' end || ',"name":"' || name || '","queries":' || case when q is null then '""' else '"' || array_to_string(list_sort(string_split(q, ',')), '\\n') || '"' end || ',"source_access_class":"public","version":"v1"}')[1:16] as search_protocol_id from protocols_t"""


def _lists(protocols: DataFrame) -> DataFrame:
    each = lambda c: F.coalesce(F.split(c, ","), F.array().cast("array<string>"))
    return protocols.withColumn("queries", each("q")).withColumn("allowlist", each("a"))


case("search_protocols", lambda protocols_t: mining.search_protocols(_lists(protocols_t)).select("name", "search_protocol_id", "reason"), f" select name, search_protocol_id, reason from ({_PROTOCOL_SQL})", protocols_t=_PROTOCOLS)
_STAGE_DOCS = "select concat('doc-', cast(doc_id as string)) as document_id, repeat('a', 64) as content_sha256, 'unknown' as published_time_precision, doc_id from documents"


def _stage0(protocols_t: DataFrame, docs_t: DataFrame, members_t: DataFrame, first_t: DataFrame, claims_t: DataFrame) -> DataFrame:
    stored = mining.search_protocols(_lists(protocols_t)).drop("reason")
    stored = stored.withColumn("search_protocol_id", F.when(F.col("s_suppkey") % 5 == 0, F.concat(F.lit("old-"), "name")).otherwise(F.col("search_protocol_id")))
    issues = audit.audit_corpus(docs_t, first_t, members_t, claims_t, stored)
    return audit.table_counts({"documents": docs_t, "families": first_t, "memberships": members_t, "assertions": claims_t, "protocols": protocols_t}, issues)


case(
    "audit_stage0_counts", _stage0,
    f""",
p as (select coalesce(reason, case when s_suppkey % 5 = 0 then 'id_differs' end) as reason from ({_PROTOCOL_SQL})),
issues as (
  select 'invalid_search_protocol' as code from p where reason is not null
  union all select 'missing_source_family' from docs_t where doc_id % 11 = 0
  union all select 'invalid_assertion_document' from claims_t where document_id not in (select document_id from docs_t)
  union all select 'invalid_canonical_membership' from first_t where cast(split_part(canonical_document_id, '-', 2) as bigint) % 11 = 0)
select 'issue' as kind, code as name, count(*) as rows from issues group by code
union all select 'table', 'documents', count(*) from docs_t union all select 'table', 'families', count(*) from first_t union all select 'table', 'memberships', count(*) from members_t
union all select 'table', 'assertions', count(*) from claims_t union all select 'table', 'protocols', count(*) from protocols_t""",
    protocols_t=_PROTOCOLS, docs_t=_STAGE_DOCS, members_t="select concat('doc-', cast(doc_id as string)) as document_id, concat('family-', source) as source_family_id from documents where doc_id % 11 <> 0",
    first_t="select concat('family-', source) as source_family_id, concat('doc-', cast(min(doc_id) as string)) as canonical_document_id from documents group by source", claims_t="select concat('as-', cast(doc_id as string)) as assertion_id, concat('doc-', cast(doc_id * 2 as string)) as document_id from labels",
)

# -- search -----------------------------------------------------------------------------------------

_RESULTS = "select page_id % 10 as query_id, page_id as pos, case when page_id % 9 = 0 then 'ftp://old.example.com/x' when page_id % 4 = 0 then concat('http://a.example.com/', cast(page_id % 40 as string)) else concat('https://other', cast(page_id % 5 as string), '.test/') end as url from pages"
case(
    "search_funnel", lambda results_t, allowed_t: mining.search_funnel(mining.search_candidates(results_t, allowed_t), ["query_id"]),
    """,
gated as (select *, case when url like 'ftp%' then 'invalid_url' when url like 'https%' then 'outside_allowlist' when row_number() over (partition by url order by query_id, pos) > 1 then 'duplicate' else 'candidate' end as status from results_t)
select query_id, count(*) as results, count(*) filter (status = 'candidate') as candidates, count(*) filter (status = 'duplicate') as duplicates, count(*) filter (status = 'outside_allowlist') as outside, count(*) filter (status = 'invalid_url') as invalid from gated group by rollup (query_id)""",
    results_t=_RESULTS, allowed_t="select 'Example.com.' as domain from region where r_regionkey = 0",
)
case(
    "watch_list_terms", lambda terms_t, names_t: mining.expand_terms(terms_t, names_t),
    """,
every as (
  select term_pos, term as query, 0 as priority, 0::bigint as name_pos from terms_t where not contains(term, '{name}')
  union all select term_pos, replace(term, '{name}', name), coalesce(n.priority, 3), name_pos from terms_t, names_t n where contains(term, '{name}'))
select term_pos, query, priority, name_pos from (select *, row_number() over (partition by query order by term_pos, priority, name_pos) as n from every) where n = 1""",
    terms_t="select r_regionkey as term_pos, case when r_regionkey % 2 = 0 then '{name} relay' else concat(r_name, ' relay') end as term from region", names_t="select case when s_suppkey % 3 = 0 then 'AFRICA' else s_name end as name, cast(s_suppkey as bigint) as name_pos, case when s_suppkey % 4 <> 0 then cast(s_suppkey % 5 as int) end as priority from supplier",
)
case(
    "supported_questions", lambda queries_t, pairs_t: constraints.supported_questions(queries_t, pairs_t),
    " select k, query_class, question, (query_class, question) in (select (query_class, question) from pairs_t) as supported from queries_t",
    queries_t=f"select k, {text_of('class-', 'c % 4')} as query_class, {text_of('rq', 'k % 3')} as question from {O}", pairs_t="select concat('class-', cast(n_nationkey % 4 as string)) as query_class, concat('rq', cast(n_regionkey % 3 as string)) as question from nation where n_nationkey < 6",
)

# -- features ---------------------------------------------------------------------------------------

_ASSESSED = "select concat('a-', cast(l_partkey as string), '-', cast(l_suppkey as string)) as assessment_id, l_partkey as feature_id, concat('set-', cast(l_suppkey as string)) as reference_set_id, case when l_suppkey % 3 = 0 then 'blocked' else 'candidate' end as status, min(l_shipdate) as assessed_at from lineitem group by l_partkey, l_suppkey"
_FEATURE_REVIEWS = "select concat('a-', cast(l_partkey as string), '-', cast(l_suppkey as string)) as assessment_id, case when l_partkey % 5 = 1 then 'rejected' else 'accepted' end as decision, min(l_shipdate) + interval 1 day - (l_partkey % 3) * interval 1 day as reviewed_at from lineitem where l_partkey % 5 <> 0 group by l_partkey, l_suppkey"
_ELIGIBLE_SQL = "select a.assessment_id, feature_id, reference_set_id, coalesce(status = 'candidate' and decision = 'accepted' and reviewed_at >= assessed_at, false) as eligible from assessed_t a left join reviews_t r using (assessment_id)"
case("eligible_features", lambda assessed_t, reviews_t: background.eligible(assessed_t, reviews_t).select("assessment_id", "eligible"), f" select assessment_id, eligible from ({_ELIGIBLE_SQL})", assessed_t=_ASSESSED, reviews_t=_FEATURE_REVIEWS)
case(
    "eligible_sets", lambda assessed_t, reviews_t: background.eligible_sets(background.eligible(assessed_t, reviews_t)).select("feature_id", F.array_join("reference_set_ids", ",").alias("reference_set_ids")),
    f" select feature_id, string_agg(distinct reference_set_id, ',' order by reference_set_id) as reference_set_ids from ({_ELIGIBLE_SQL}) where eligible group by 1", assessed_t=_ASSESSED, reviews_t=_FEATURE_REVIEWS,
)
case(
    "group_manifest", lambda rows_t: group_hash(rows_t, ["l_suppkey"], sha256_text(F.col("row")), "manifest"),
    """, hashes as (select l_suppkey, sha256(row) as h from rows_t), parts as (select l_suppkey, h[1:2] as b, sha256(string_agg(h, '|' order by h)) as p from hashes group by 1, 2)
select l_suppkey, sha256(string_agg(b || p, '|' order by b || p)) as manifest from parts group by 1""",
    rows_t="select l_suppkey, concat(cast(l_orderkey as string), '|', cast(l_linenumber as string)) as row from lineitem",
)

# -- queries, rules, freezes ------------------------------------------------------------------------

_ADMIT = f"select {text_of('q-', 'k')} as query_id, split(concat('pre-', cast(c as string), ',pre-', cast(c + k % 3 as string)), ',') as precheck_ids from {O}"
_ELIGIBLE_PRE = "select concat('pre-', cast(c_custkey as string)) as precheck_id, c_custkey % 4 <> 0 as eligible, timestamp '1996-01-01 00:00:00' + (c_custkey % 30) * interval 1 day as source_available_at from customer"
case(
    "q2_admission", lambda queries_t, prechecks_t: pivots.q2_admission(queries_t, prechecks_t).select("query_id", "admitted", F.col("source_available_at").cast("timestamp_ntz").alias("source_available_at")),
    " select query_id, bool_and(coalesce(eligible, false)) as admitted, max(source_available_at) as source_available_at from (select query_id, unnest(precheck_ids) as precheck_id from queries_t) left join prechecks_t using (precheck_id) group by 1",
    queries_t=_ADMIT, prechecks_t=_ELIGIBLE_PRE,
)
_CLAUSE_ROWS = """select p_partkey, concat('d-', cast(p_partkey % 500 as string)) as design_id, case when p_partkey % 2 = 0 then 'cti_direct' else 'derived' end as feature_origin, case p_partkey % 7 when 0 then 'score' when 1 then 'alternative' when 2 then 'exclusion' else 'required' end as logical_role,
  'same_host' as cooccurrence_scope, ' host.x ' as query_field, p_brand as canonical_value, case when p_partkey % 2 = 0 and p_partkey % 9 <> 0 then concat('as-', cast(p_partkey as string)) end as source_assertion_id, case when p_partkey % 18 = 0 then 'pre-1' end as source_precheck_id,
  case when p_partkey % 2 = 1 and p_partkey % 5 <> 0 then concat('f-', cast(p_partkey as string)) end as source_feature_id, concat('node-', cast(p_partkey % 3 as string)) as node_id, timestamp '1996-01-01 00:00:00' + (p_partkey % 300) * interval 1 day as available_at from part"""
_CLAUSE_SQL = """
  select *, case logical_role when 'required' then 'AND' when 'alternative' then 'OR' when 'exclusion' then 'NOT' end as operator,
    case when logical_role = 'score' then 'score_only_clause' when case when feature_origin = 'cti_direct' then coalesce(source_assertion_id, source_precheck_id) else source_feature_id end is null then 'provenance_missing' end as reason from rows_t"""
_j = lambda c: f"""case when {c} is null then 'null' else '"' || {c} || '"' end"""
case(
    "rule_clauses", lambda rows_t: rules.build_clauses(rows_t).select("p_partkey", "operator", "clause_id", "reason"),
    f""" select p_partkey, operator, case when operator is not null then 'query-clause-' || sha256('{{"canonical_value":"' || canonical_value || '","canonicalizer_version":"v1","cooccurrence_scope":"same_host","feature_origin":"' || feature_origin || '","logical_role":"' || logical_role || '","node_id":"' || node_id
  || '","query_field":"host.x","source_assertion_id":' || {_j('source_assertion_id')} || ',"source_feature_id":' || {_j('source_feature_id')} || ',"source_precheck_id":' || {_j('source_precheck_id')} || '}}')[1:20] end as clause_id, reason from ({_CLAUSE_SQL})""",
    rows_t=_CLAUSE_ROWS,
)
_DESIGNS = "select distinct concat('d-', cast(p_partkey % 500 as string)) as design_id, case when p_partkey % 500 % 11 = 0 then 'q0_seed' when p_partkey % 500 % 6 = 5 then 'q3_cluster' else 'q2_derived' end as query_class, case p_partkey % 500 % 3 when 0 then 'cti_derived' when 1 then 'derived_only' else 'q3_graph_expansion' end as composition_type, timestamp '1996-07-01 00:00:00' as cutoff_at from part"


def _designs(rows_t: DataFrame, designs_t: DataFrame, features_t: DataFrame) -> DataFrame:
    clauses = rules.build_clauses(rows_t).where("logical_role <> 'score'")
    accepted = rows_t.where("p_partkey % 4 = 0").select(F.col("source_assertion_id").alias("assertion_id"))
    prechecks = rows_t.select(F.col("source_precheck_id").alias("precheck_id")).where("precheck_id is not null").distinct()
    told = rules.validate_designs(designs_t, clauses, accepted, prechecks, features_t)
    return told.select("design_id", F.array_join("reasons", ",").alias("reasons"))


case(
    "rule_designs", _designs,
    """,
accepted as (select source_assertion_id as a from rows_t where p_partkey % 4 = 0),
each as (
  select r.*, d.cutoff_at, f.query_field as ff, f.canonical_value as fv, f.first_available_at as ft, r.source_assertion_id in (select a from accepted where a is not null) as ok_a, r.source_precheck_id is not null as ok_p
  from rows_t r join designs_t d using (design_id) left join features_t f on f.feature_id = r.source_feature_id where logical_role <> 'score'),
codes as (
  select design_id, unnest([case when available_at > cutoff_at then 'feature_leakage' end, case when feature_origin = 'cti_direct' and not coalesce(ok_a, false) and not ok_p then 'unaccepted_cti_provenance' end, case when feature_origin <> 'cti_direct' and ff is null then 'feature_not_eligible' end,
    case when feature_origin <> 'cti_direct' and ff <> 'host.x' then 'query_field_differs' end, case when feature_origin <> 'cti_direct' and fv <> canonical_value then 'value_differs' end, case when feature_origin <> 'cti_direct' and ft <> available_at then 'availability_differs' end]) as code from each),
groups as (
  select design_id, count(*) as n, list_sort(list(distinct feature_origin)) as origins, count(distinct case when feature_origin = 'cti_direct' and logical_role = 'required' then node_id end) as nodes, bool_or(logical_role in ('required', 'alternative')) as positive,
    count(distinct (canonical_value, feature_origin, logical_role, node_id, coalesce(source_assertion_id, ''), coalesce(source_feature_id, ''), coalesce(source_precheck_id, ''))) as different from each group by 1),
own as (
  select d.design_id, unnest([case when n is null then 'clauses_missing' end, case when n <> different then 'clauses_duplicated' end, case when query_class = 'q0_seed' then 'class_not_supported' end, case when (query_class = 'q3_cluster') <> (composition_type = 'q3_graph_expansion') then 'q3_needs_graph_expansion' end,
    case when composition_type = 'q3_graph_expansion' then 'graph_edge_missing' end, case when composition_type <> 'q3_graph_expansion' and origins is distinct from case composition_type when 'cti_derived' then ['cti_direct', 'derived'] else ['derived'] end then 'composition_mismatch' end,
    case when nodes > 1 then 'required_nodes_differ' end, case when not coalesce(positive, false) then 'positive_clause_missing' end]) as code from designs_t d left join groups g using (design_id))
select d.design_id, coalesce(string_agg(distinct code, ',' order by code), '') as reasons from designs_t d left join (select * from codes union all select * from own) x using (design_id) group by 1""",
    rows_t=_CLAUSE_ROWS, designs_t=_DESIGNS,
    features_t="select concat('f-', cast(p_partkey as string)) as feature_id, case when p_partkey % 13 = 0 then 'host.y' else 'host.x' end as query_field, case when p_partkey % 17 = 0 then 'other' else p_brand end as canonical_value, timestamp '1996-01-01 00:00:00' + (p_partkey % 300 + p_partkey % 19 % 2) * interval 1 day as first_available_at from part where p_partkey % 3 <> 0",
)
_CHECKED = "select concat('d-', cast(c_custkey as string)) as design_id, concat('q-', cast(c_custkey as string)) as query_id, c_name as rendered_query, split(case when c_custkey % 5 = 0 then 'c-x' else concat('c-', cast(c_custkey as string)) end, ',') as clause_ids, split(case when c_custkey % 6 = 0 then 's-none' else concat('s-', cast(c_custkey % 40 as string)) end, ',') as background_snapshot_ids, timestamp '1996-07-01 00:00:00' as cutoff_at, c_custkey as n from customer"
_QUERIES_IN = "select concat('q-', cast(c_custkey as string)) as query_id, case when c_custkey % 7 = 0 then 'other' else c_name end as query_text, split(case when c_custkey % 8 = 0 then 'as-x' else concat('as-', cast(c_custkey as string)) end, ',') as source_assertion_ids, split(concat('f-', cast((c_custkey + c_custkey % 9 % 2) % 40 as string)), ',') as source_feature_ids, timestamp '1996-01-01 00:00:00' + (c_custkey % 250) * interval 1 day as source_available_at from customer where c_custkey % 10 <> 0"
_USED = "select concat('d-', cast(c_custkey as string)) as design_id, concat('c-', cast(c_custkey as string)) as clause_id, concat('as-', cast(c_custkey as string)) as source_assertion_id, concat('f-', cast(c_custkey % 40 as string)) as source_feature_id, timestamp '1996-01-01 00:00:00' + (c_custkey % 250 + c_custkey % 11 % 2) * interval 1 day as available_at from customer"


def _hashed(df: DataFrame, of: str) -> DataFrame:
    return df.withColumn("query_hash", sha256_text(F.col(of)))


case(
    "design_checks", lambda designs_t, used_t, queries_t, snapshots_t: rules.design_checks(_hashed(designs_t, "rendered_query"), used_t, _hashed(queries_t, "query_text"), snapshots_t).select("design_id", "reason"),
    """
select design_id, case when q.query_id is null then 'query_unknown' when rendered_query <> query_text then 'query_text_mismatch' when n % 5 = 0 then 'clause_ids_mismatch' when n % 8 = 0 then 'assertion_provenance_mismatch' when n % 9 % 2 = 1 then 'feature_provenance_mismatch'
  when n % 6 = 0 and n % 40 % 3 <> 0 then 'background_snapshot_omitted' when n % 11 % 2 = 1 then 'source_time_mismatch' when u.available_at > cutoff_at then 'feature_leakage' end as reason from designs_t d left join queries_t q using (query_id) left join used_t u using (design_id)""",
    designs_t=_CHECKED, used_t=_USED, queries_t=_QUERIES_IN, snapshots_t="select distinct concat('s-', cast(c_custkey % 40 as string)) as stat_snapshot_id, concat('f-', cast(c_custkey % 40 as string)) as feature_id from customer where c_custkey % 40 % 3 <> 0",
)
_DESIGN_PRE = f"select {text_of('d-', 'k')} as design_id, {text_of('res-', 'k')} as result_id, case when k % 7 = 0 then 'partial_max_pages' when k % 7 = 1 then 'failed' else 'complete' end as status, cast(k % 4 as int) as page_count, cast(c % 6 as int) as hit_count, d as recorded_at from {O}"
_DESIGN_REV = f"select {text_of('d-', 'k')} as design_id, {text_of('rev-', 'k')} as review_id, case when k % 9 = 0 then 'rejected' else 'accepted' end as decision, d + interval 1 day - (k % 5 % 3) * interval 1 day as reviewed_at from {O} where k % 8 <> 0"
case(
    "design_prechecks", lambda prechecks_t, reviews_t: rules.design_precheck_gate(prechecks_t, reviews_t).select("design_id", "reason"),
    """
select p.design_id, case when status <> 'complete' then 'precheck_' || status when page_count > 2 then 'page_budget_exceeded' when hit_count = 0 then 'zero_hits' when decision is null then 'human_review_required' when decision <> 'accepted' then 'human_review_rejected' when reviewed_at < recorded_at then 'review_predates_precheck' end as reason
from prechecks_t p left join reviews_t r using (design_id)""",
    prechecks_t=_DESIGN_PRE, reviews_t=_DESIGN_REV,
)
_BUDGETS = f"select {text_of('d-', 'k')} as design_id, cast(case when k % 9 = 0 then 0 else 168 end as int) as interval_hours, d as starts_at, cast(20 - k % 23 as int) as max_alerts_per_run, cast(100 as int) as max_credits_per_run, cast(k % 5 as int) as max_pages_per_run, 'oldest' as tie_break_rule, d as registered_at from {O}"
_BUDGET_ID = """'query-schedule-' || sha256('{"design_id":"' || design_id || '","interval_hours":' || interval_hours || ',"max_alerts_per_run":' || max_alerts_per_run || ',"max_credits_per_run":"100","max_pages_per_run":' || max_pages_per_run || ',"starts_at":"' || strftime(starts_at, '%Y-%m-%dT%H:%M:%S+00:00') || '","tie_break_rule":"oldest"}')[1:20]"""
case(
    "budget_schedules", lambda designs_t: rules.budget_schedules(designs_t).select("design_id", "schedule_id", "reason"),
    f" select design_id, {_BUDGET_ID} as schedule_id, case when interval_hours <= 0 then 'interval_not_positive' when least(max_alerts_per_run, max_credits_per_run, max_pages_per_run) < 0 then 'budget_negative' end as reason from designs_t", designs_t=_BUDGETS,
)
_FREEZABLE = f"select {text_of('d-', 'k')} as design_id, {text_of('q-', 'k')} as query_id, {text_of('h-', 'k')} as query_hash, split(concat('c-', cast(k as string), ',c-', cast(k + 1 as string)), ',') as clause_ids, split('s-1', ',') as background_snapshot_ids, d as registered_at, d + interval 5 day - (k % 11 % 2) * interval 5 day as frozen_at, d + interval 6 day - (k % 13 % 2) * interval 3 day as valid_for_test_from from {O}"
_SCHEDULES_IN = f"select {text_of('d-', 'k')} as design_id, {text_of('s-', 'k')} as schedule_id, d + interval 7 day - (k % 17 % 2) * interval 4 day as starts_at, d + interval 1 day as registered_at from {O} where k % 6 <> 0"


def _frozen(designs_t: DataFrame, schedules_t: DataFrame, prechecks_t: DataFrame, reviews_t: DataFrame) -> DataFrame:
    return rules.freeze_manifests(designs_t.withColumnRenamed("frozen_at", "f").withColumnRenamed("valid_for_test_from", "v"), schedules_t, prechecks_t, reviews_t, F.col("f"), F.col("v"))


_FREEZE_SQL = """
  select d.design_id, d.query_id, d.query_hash, d.frozen_at, d.valid_for_test_from, case when schedule_id is null then 'schedule_missing' when status <> 'complete' then 'precheck_not_complete' when decision is distinct from 'accepted' then 'review_not_accepted'
    when greatest(d.registered_at, s.registered_at, p.recorded_at, r.reviewed_at) > d.frozen_at then 'artifact_after_freeze' when valid_for_test_from < d.frozen_at then 'valid_before_freeze' when starts_at < valid_for_test_from then 'schedule_starts_early' end as reason,
    sha256('{"background_snapshot_ids":"s-1","clause_ids":"' || array_to_string(list_sort(clause_ids), ',') || '","design_id":"' || d.design_id || '","precheck_result_id":"' || result_id || '","query_hash":"' || query_hash || '","review_id":"' || review_id || '","schedule_id":"' || schedule_id
      || '","valid_for_test_from":"' || strftime(valid_for_test_from, '%Y-%m-%dT%H:%M:%S+00:00') || '"}') as lineage
  from designs_t d left join schedules_t s using (design_id) left join prechecks_t p using (design_id) left join reviews_t r using (design_id)"""
_FREEZE_INPUTS = {"designs_t": _FREEZABLE, "schedules_t": _SCHEDULES_IN, "prechecks_t": _DESIGN_PRE, "reviews_t": _DESIGN_REV}
case(
    "freeze_manifests", lambda **t: _frozen(**t).select("design_id", "freeze_id", "lineage_hash", "reason"),
    f" select design_id, case when reason is null then 'query-freeze-' || sha256(lineage || '|' || strftime(frozen_at, '%Y-%m-%dT%H:%M:%S+00:00'))[1:20] end as freeze_id, case when reason is null then lineage end as lineage_hash, reason from ({_FREEZE_SQL})", **_FREEZE_INPUTS,
)


def _audit_freezes(queries_t: DataFrame, **t: DataFrame) -> DataFrame:
    """What was frozen, stored with a few hashes changed and a few manifests lost."""
    good = _frozen(**t).where("reason is null")
    n = F.substring_index("design_id", "-", -1).cast("long")
    stored = good.where(n % 10 != 4).withColumn("lineage_hash", F.when(n % 10 == 3, F.lit("changed")).otherwise(F.col("lineage_hash")))
    when = stored.select("design_id")
    designs = t["designs_t"].drop("frozen_at", "valid_for_test_from")
    return audit.audit_freezes(queries_t, stored, designs.join(when, "design_id"), t["schedules_t"], t["prechecks_t"], t["reviews_t"])


case(
    "audit_freezes", _audit_freezes,
    f""",
good as (select design_id, query_id, cast(split_part(design_id, '-', 2) as bigint) as n from ({_FREEZE_SQL}) where reason is null),
stored as (select * from good where n % 10 <> 4)
select 'invalid_queries' as code, query_id as record_id, 'frozen_without_time' as detail from queries_t where status = 'frozen' and frozen_at is null
union all select 'frozen_query_lacks_manifest', query_id, null from queries_t where status = 'frozen' and query_id not in (select query_id from stored)
union all select 'non_reproducible_freeze_manifest', design_id, 'differs' from stored where n % 10 = 3""",
    queries_t=f"select {text_of('q-', 'k')} as query_id, case when c % 5 = 0 then 'frozen' else 'draft' end as status, case when k % 3 = 0 then d end as frozen_at, d as valid_for_test_from from {O}", **_FREEZE_INPUTS,
)
_STATES = f"select c as query_id, k, d, case k % 4 when 0 then 'draft' when 1 then 'validated' when 2 then 'frozen' else 'retired' end as status from {O}"
case(
    "query_moves", lambda log_t: prospective.transitions(log_t, prospective.QUERY_MOVES, ["query_id"], ["d", "k"]).select("k", "previous", "status", "allowed"),
    """ select k, previous, status, previous is null or previous = status or previous || '>' || status in ('draft>validated', 'draft>retired', 'validated>frozen', 'validated>retired', 'frozen>retired') as allowed
from (select *, lag(status) over (partition by query_id order by d, k) as previous from log_t)""", log_t=_STATES,
)

# -- watch, prechecks -------------------------------------------------------------------------------

_LANDMARKS = f"select {text_of('l-', 'k')} as landmark_id, {text_of('q-', 'c')} as query_id, {text_of('i-', 'k % 7')} as indicator_id, {text_of('a-', 'k % 5')} as assertion_id, d as window_start, case when k % 23 = 0 then d - interval 1 day else d + interval 1 day end as window_end from {O} where c % 6 <> 0"
_WATCH = "select concat('q-', cast(c_custkey as string)) as query_id, case c_custkey % 3 when 0 then 'q2_derived' else 'q0_seed' end as query_class, split(concat('pre-', cast(c_custkey as string), ',pre-', cast(c_custkey + 1 as string)), ',') as source_precheck_ids, split('i-0,i-1,i-2,i-3', ',') as source_indicator_ids, split('a-0,a-1,a-2', ',') as source_assertion_ids from customer where c_custkey % 11 <> 0"
case(
    "timeline_gates", lambda entries_t, landmarks_t, queries_t, hosts_t: timeline.timeline_gates(entries_t, landmarks_t, queries_t, hosts_t),
    """,
first as (
  select landmark_id as record_id, case when query_class is null then 'landmark_query_unknown' when query_class <> 'q0_seed' then 'landmark_query_not_q0' when not (list_contains(source_indicator_ids, indicator_id) and list_contains(source_assertion_ids, assertion_id)) then 'landmark_not_owned' end as reason
  from landmarks_t left join queries_t using (query_id)
  union all select timeline_entry_id, case when h.indicator_id is null then 'observation_unknown' when h.indicator_id is distinct from l.indicator_id then 'observation_of_other_indicator' end from entries_t e left join landmarks_t l using (landmark_id) left join hosts_t h using (observation_id))
select record_id, reason from first where reason is not null""",
    entries_t=f"select {text_of('t-', 'k')} as timeline_entry_id, {text_of('l-', 'k')} as landmark_id, {text_of('o-', 'k')} as observation_id from {O}", landmarks_t=_LANDMARKS, queries_t=_WATCH,
    hosts_t=f"select {text_of('o-', 'k')} as observation_id, {text_of('i-', '(k + k % 13 % 2) % 7')} as indicator_id from {O} where k % 17 <> 0",
)
case(
    "pivot_permission", lambda assessed_t, reviews_t: timeline.pivot_permission(assessed_t, reviews_t).select("assessment_id", "allowed"),
    " select assessment_id, case when decision = 'rejected' then false when status = 'continuous' then true else coalesce(status = 'probable' and decision = 'accepted' and allow_probable, false) end as allowed from assessed_t left join reviews_t using (assessment_id)",
    assessed_t=f"select k as assessment_id, case k % 4 when 0 then 'continuous' when 1 then 'probable' when 2 then 'reassigned' else 'unknown' end as status from {O}", reviews_t=f"select k as assessment_id, case when c % 3 = 0 then 'rejected' else 'accepted' end as decision, c % 2 = 0 as allow_probable from {O} where k % 5 <> 0",
)
case(
    "audit_watch", lambda queries_t, landmarks_t, prechecks_t, reviews_t: audit.audit_watch(queries_t, landmarks_t, prechecks_t, reviews_t),
    """,
q2 as (select query_id, unnest(source_precheck_ids) as precheck_id from queries_t where query_class = 'q2_derived')
select 'invalid_landmarks' as code, landmark_id as record_id, 'window_reversed' as detail from landmarks_t where window_end < window_start
union all select 'q0_query_lacks_landmark', query_id, null from queries_t where query_class = 'q0_seed' and query_id not in (select query_id from landmarks_t)
union all select 'accepted_precheck_not_eligible', r.precheck_id, null from reviews_t r left join prechecks_t p using (precheck_id) where decision = 'accepted' and not coalesce(eligible, false)
union all select 'q2_has_ineligible_precheck', query_id, precheck_id from q2 left join prechecks_t p using (precheck_id) where not coalesce(eligible, false)""",
    queries_t=_WATCH, landmarks_t=_LANDMARKS, prechecks_t=_ELIGIBLE_PRE, reviews_t="select concat('pre-', cast(c_custkey as string)) as precheck_id, case when c_custkey % 2 = 0 then 'accepted' else 'rejected' end as decision from customer",
)
case(
    "precheck_results", lambda results_t, prechecks_t, runs_t: pivots.precheck_result_checks(results_t, prechecks_t, runs_t).select("result_id", "reason"),
    """
select result_id, case when p.query_id is null then 'unknown_precheck' when e.query_id is null then 'unknown_execution' when p.query_id <> e.query_id then 'query_mismatch' when p.cutoff_at <> e.cutoff_at then 'cutoff_mismatch' when r.status <> e.status then 'status_mismatch' when r.hit_count <> e.hit_count then 'hit_count_mismatch'
  when r.raw_manifest_hash is distinct from e.raw_manifest_hash then 'manifest_mismatch' end as reason from results_t r left join prechecks_t p using (precheck_id) left join runs_t e on e.query_run_id = r.collection_run_id""",
    results_t=f"select k as result_id, {text_of('pre-', 'c')} as precheck_id, {text_of('run-', 'k')} as collection_run_id, case when k % 5 = 0 then 'failed' else 'complete' end as status, k % 4 as hit_count, case when k % 6 <> 0 then 'h' end as raw_manifest_hash from {O}",
    prechecks_t="select concat('pre-', cast(c_custkey as string)) as precheck_id, c_custkey % 20 as query_id, timestamp '1996-07-01 00:00:00' as cutoff_at from customer where c_custkey % 13 <> 0",
    runs_t=f"select {text_of('run-', 'k')} as query_run_id, (c + k % 17 % 2) % 20 as query_id, case when k % 19 = 0 then d else {AT} end as cutoff_at, 'complete' as status, k % 4 + k % 7 % 2 as hit_count, 'h' as raw_manifest_hash from {O} where k % 11 <> 0",
)

# -- prospective ------------------------------------------------------------------------------------

case(
    "event_gates", lambda events_t, opportunities_t, queries_t, designs_t: prospective.event_gates(events_t, opportunities_t, queries_t, designs_t).select("event_id", "reason"),
    """
select event_id, case when o.entity_epoch_id is null then 'opportunity_unknown' when o.entity_epoch_id <> e.entity_epoch_id then 'epoch_mismatch' when q.status <> 'frozen' then 'query_not_frozen' when o.query_hash <> q.query_hash then 'query_hash_mismatch' when d.api_schema_version is distinct from e.api_schema_version then 'api_schema_mismatch'
  when dataset_split <> 'prospective_test' then 'split_not_prospective' when raw_manifest_hash = 'bad' then 'manifest_hash_invalid' end as reason from events_t e left join opportunities_t o using (opportunity_id) left join queries_t q on q.query_id = o.query_id left join designs_t d on d.query_id = o.query_id""",
    events_t=f"select k as event_id, {text_of('opp-', 'c')} as opportunity_id, case when k % 13 = 0 then 'ep-x' else {text_of('ep-', 'c')} end as entity_epoch_id, case when k % 17 = 0 then 'v2' else 'v1' end as api_schema_version, case when k % 19 = 0 then 'development' else 'prospective_test' end as dataset_split, case when k % 23 = 0 then 'bad' else repeat('a', 64) end as raw_manifest_hash from {O}",
    opportunities_t="select concat('opp-', cast(c_custkey as string)) as opportunity_id, concat('ep-', cast(c_custkey as string)) as entity_epoch_id, c_custkey % 50 as query_id, case when c_custkey % 29 = 0 then 'old' else concat('h-', cast(c_custkey % 50 as string)) end as query_hash from customer where c_custkey % 10 <> 3",
    queries_t="select distinct c_custkey % 50 as query_id, case when c_custkey % 50 % 9 = 0 then 'draft' else 'frozen' end as status, concat('h-', cast(c_custkey % 50 as string)) as query_hash from customer", designs_t="select distinct c_custkey % 50 as query_id, 'v1' as api_schema_version from customer where c_custkey % 50 <> 7",
)
_EVIDENCE_IN = f"select {text_of('ev-', 'k')} as evidence_id, {text_of('cand-', 'c')} as candidate_id, case when k % 6 = 0 then 'unavailable' else 'available' end as availability, case k % 5 when 0 then 'contradiction' else 'validation' end as role, k % 3 <> 0 as supports_candidate from {O}"
_JUDGED = f"select {text_of('ad-', 'k')} as adjudication_id, {text_of('cand-', 'c')} as candidate_id, case k % 4 when 0 then 'positive' when 1 then 'negative' when 2 then 'contradicted' else 'unresolved' end as status, split(concat('ev-', cast(k as string), ',ev-', cast(case when k % 7 = 0 then k + 1 else k end as string)), ',') as evidence_ids, {text_of('p-', 'k % 9')} as adjudicator_id, 'p-3' as implementer_id from {O}"
case(
    "adjudication_checks", lambda judged_t, evidence_t: prospective.adjudication_check(judged_t, evidence_t).select("adjudication_id", "reason"),
    """,
cited as (select a.adjudication_id, a.candidate_id as own, e.* from (select *, unnest(evidence_ids) as evidence_id from judged_t) a left join evidence_t e using (evidence_id)),
got as (
  select adjudication_id, bool_or(coalesce(candidate_id <> own, true)) as foreign_, bool_or(availability = 'available' and role = 'contradiction') as contra, bool_or(availability = 'available' and role = 'validation' and supports_candidate) as pro,
    bool_or(availability = 'available' and role = 'validation' and not supports_candidate) as con, bool_and(availability = 'unavailable') as none_, count(candidate_id) as known from cited group by 1),
told as (select *, case when known = 0 then 'unresolved' when contra or (pro and con) then 'contradicted' when pro then 'positive' when con then 'negative' when none_ then 'unobservable' else 'unresolved' end as told from got)
select j.adjudication_id, case when exists (select 1 from cited c where c.adjudication_id = j.adjudication_id and c.evidence_id is not null and c.candidate_id is distinct from own or c.adjudication_id = j.adjudication_id and c.evidence_id is null) then 'evidence_unknown'
  when adjudicator_id = implementer_id then 'adjudicator_not_independent' when told <> status then 'status_not_supported' end as reason from judged_t j left join told using (adjudication_id)""",
    judged_t=_JUDGED, evidence_t=_EVIDENCE_IN,
)
case(
    "grade_history", lambda grades_t, judged_t: prospective.grade_chain(grades_t, judged_t, position="grade_event_id").select("grade_event_id", "reason"),
    """,
told as (select g.*, a.candidate_id as owner, max({'t': graded_at, 'i': grade_event_id}) over (partition by g.candidate_id order by grade_event_id rows between unbounded preceding and 1 preceding) as latest from grades_t g left join judged_t a using (adjudication_id))
select grade_event_id, case when owner is distinct from candidate_id then 'adjudication_foreign' when latest.i is distinct from previous_grade_event_id then 'previous_mismatch' when graded_at < latest.t then 'time_backward' end as reason from told""",
    grades_t="""select o_custkey as candidate_id, o_orderkey as grade_event_id, o_orderdate as graded_at, concat('ad-', cast(o_orderkey as string)) as adjudication_id,
      case when o_orderkey % 13 = 0 then 0 else lag(o_orderkey) over (partition by o_custkey order by o_orderkey) end as previous_grade_event_id from orders""",
    judged_t="select concat('ad-', cast(o_orderkey as string)) as adjudication_id, case when o_orderkey % 11 = 0 then o_custkey + 1 else o_custkey end as candidate_id from orders where o_orderkey % 17 <> 0",
)
case(
    "candidate_provenance", lambda events_t, discovery_t: prospective.candidates(events_t, ["query_id", "entity_epoch_id"], discovery=discovery_t).select("candidate_id", "query_id", "entity_epoch_id", "first_candidate_at", "first_observation_event_id", F.array_join("discovery_feature_ids", ",").alias("features"), F.array_join("discovery_source_family_ids", ",").alias("families")),
    """,
first as (select query_id, entity_epoch_id, min_by(event_id, (observed_at, event_id)) as e, min(observed_at) as t from events_t where time_status = 'eligible' group by 1, 2),
ids as (select query_id, string_agg(distinct discovery_feature_id, ',' order by discovery_feature_id) as f, string_agg(distinct discovery_source_family_id, ',' order by discovery_source_family_id) as s from discovery_t group by 1)
select 'candidate-' || sha256('{"entity_epoch_id":"' || entity_epoch_id || '","query_id":"' || query_id || '"}')[1:20] as candidate_id, query_id, entity_epoch_id, t as first_candidate_at, e as first_observation_event_id, f as features, s as families from first left join ids using (query_id)""",
    events_t=f"select k as event_id, {text_of('q-', 'c % 40')} as query_id, {text_of('ep-', 'c')} as entity_epoch_id, {text_of('i-', 'c')} as indicator_id, case when k % 4 = 0 then 'pre_freeze' else 'eligible' end as time_status, d as observed_at from {O}",
    discovery_t="select concat('q-', cast(p_partkey % 35 as string)) as query_id, concat('f-', cast(p_size as string)) as discovery_feature_id, concat('family-', p_brand) as discovery_source_family_id from part",
)
case(
    "missed_slots", lambda slots_t, runs_t: prospective.missed_slots(slots_t, runs_t, F.lit("1997-01-01").cast("timestamp_ntz")).select("opportunity_id"),
    " select opportunity_id from slots_t s where window_end <= timestamp '1997-01-01' and not exists (select 1 from runs_t r where r.opportunity_id = s.opportunity_id and status = 'complete' and executed_at < window_end)",
    slots_t=f"select k as opportunity_id, d + interval 7 day as window_end from {O}", runs_t="select l_orderkey as opportunity_id, l_shipdate as executed_at, case when l_linenumber % 2 = 0 then 'complete' else 'failed' end as status from lineitem",
)

# -- indicators -------------------------------------------------------------------------------------

#: scope, what it is reported as, its value, whether that has the scope's form. {n} stands for a number.
SCOPE_ROWS = (
    ("ip", " 1[.]2(.)3.{n} ", "1.2.3.{n}", True), ("ip", "1.2.300.{n}", "1.2.300.{n}", False), ("domain", "Ex{n}[dot]Example.COM.", "ex{n}.example.com", True), ("domain", "-{n}.com", "-{n}.com", False),
    ("url", "hxxps[:]//H{n}.Example.com/A?b", "https://h{n}.example.com/A?b", True), ("url", "h{n}.example.com/A", "http://h{n}.example.com/A", True), ("url", "http://under_score/{n}", "http://under_score/{n}", False),
    ("email", "A{n}[@]Mail.Example.com", "A{n}@mail.example.com", True), ("email", "a{n}@mail", "a{n}@mail", False), ("mutex", "Global/{n}x", "Global/{n}x", True), ("filepath", "C:\\Temp\\{n}.exe", "C:\\Temp\\{n}.exe", True), ("filepath", "temp{n}", "temp{n}", False),
    ("port_protocol", " TCP/{n} ", "tcp/{n}", True), ("port_protocol", "tcp/7{n}00000", "tcp/7{n}00000", False), ("ja4", "T13D_{n}_abcdef", "t13d_{n}_abcdef", True), ("ja4", "x{n}", "x{n}", False), ("http_device_hint", " Router {n} ", "Router {n}", True),
    ("ssh_key", "ssh-rsa AAAAB3NzaC1yc2EAAAADAQAB{n}", "ssh-rsa AAAAB3NzaC1yc2EAAAADAQAB{n}", True), ("spki", "ZZ{n}", "zz{n}", False), ("nonsense", "a{n}", "a{n}", False),
)
HASH_SCOPES = (("hash_md5", 1, True), ("ja3", 1, True), ("hash_sha1", 1, False), ("hash_sha256", 2, True), ("spki", 2, True), ("cert", 2, True))


def scope_forms(spark: SparkSession, folder: str) -> DataFrame:
    """Every scope's reported forms, with a number in each that the nations give, normalised and judged."""
    from ..functions import text as T

    one = view(spark, folder, "select n_nationkey + 1 as n from nation")
    rows = F.inline(F.array(*[F.struct(F.lit(i).alias("place"), F.lit(s).alias("scope"), F.lit(raw).alias("raw")) for i, (s, raw, _, _) in enumerate(SCOPE_ROWS)]))
    plain = one.select("n", rows).select("n", "place", "scope", F.replace("raw", F.lit("{n}"), F.col("n").cast("string")).alias("raw"))
    digest = F.upper(F.md5(F.col("n").cast("string").cast("binary")))
    hashed = F.inline(F.array(*[F.struct(F.lit(100 + i).alias("place"), F.lit(s).alias("scope"), F.repeat(digest, k).alias("raw")) for i, (s, k, _) in enumerate(HASH_SCOPES)]))
    told = plain.unionByName(one.select("n", hashed))
    told = told.withColumn("value", T.normalize(F.col("scope"), F.col("raw")))
    return told.select("n", "place", "scope", "value", T.valid(F.col("scope"), F.col("value")).alias("is_valid"))


def _scope_sql() -> str:
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    plain = " union all ".join(f"select n, {i} as place, {quote(s)} as scope, replace({quote(v)}, '{{n}}', n::varchar) as value, {str(ok).lower()} as is_valid from k" for i, (s, _, v, ok) in enumerate(SCOPE_ROWS))
    hashed = " union all ".join(f"select n, {100 + i}, {quote(s)}, repeat(md5(n::varchar), {m}), {str(ok).lower()} from k" for i, (s, m, ok) in enumerate(HASH_SCOPES))
    return f"with k as (select n_nationkey + 1 as n from nation) {plain} union all {hashed}"


QUERIES["scope_forms"], ORACLES["scope_forms"] = scope_forms, _scope_sql()
