"""Queries over documents and pages: mining, verification, URLs, domains, dates, errors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import html
from ..functions import text as T
from ..functions.ids import joined_id, sha256_text
from ..operators import constraints, corpus, mining, pivots
from ..sources.readers import table
from ..sources.shared import stash

AVAILABLE = "2026-06-01 00:00:00"


def _docs(spark: SparkSession, folder: str) -> DataFrame:
    """documents as source documents; every tenth has no exact publication time."""
    d = table(spark, folder, "documents")
    published = F.when(F.col("doc_id") % 10 != 0, F.timestamp_seconds(1735689600 + F.pmod("doc_id", F.lit(365)) * 86400).cast("timestamp_ntz"))
    return d.select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("document_id"), "doc_id", "text", F.concat(F.lit("family-"), F.col("source")).alias("source_family_id"), published.alias("published_at"), F.when(published.isNull(), "date").otherwise("exact_timestamp").alias("published_time_precision"))


def _mined(scope: str):
    def query(spark: SparkSession, folder: str) -> DataFrame:
        found = mining.mine(_docs(spark, folder), (scope,))
        return found.withColumn("value", T.normalize(F.col("scope"), F.col("raw_form"))).withColumn("is_valid", T.valid(F.col("scope"), F.col("value")))
    return query


def mine_domain(spark: SparkSession, folder: str) -> DataFrame:
    """Domains named anywhere in raw pages, with the reason not to search for them."""
    pages = table(spark, folder, "pages").select(F.col("page_id").alias("document_id"), F.col("html").alias("text"))
    found = mining.mine(pages, ("domain",))
    found = found.withColumn("value", T.normalize(F.col("scope"), F.col("raw_form"))).withColumn("is_valid", T.valid(F.col("scope"), F.col("value")))
    return found.withColumn("block_reason", T.domain_block_reason(F.col("value")))


def _reports(spark: SparkSession, folder: str) -> DataFrame:
    """Documents and raw pages, each with hashes and a link of its own."""
    d, p = table(spark, folder, "documents"), table(spark, folder, "pages")
    rows = d.select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("document_id"), "text").unionAll(p.select(F.concat(F.lit("page-"), F.col("page_id").cast("string")), "html"))
    name = F.col("document_id")
    return rows.select("document_id", F.concat_ws(" ", "text", F.md5(name.cast("binary")), F.upper(F.sha2(name.cast("binary"), 256)), F.concat(F.lit("hxxps://"), name, F.lit(".example.org/a?b=1"))).alias("text"))


def mine_scopes(spark: SparkSession, folder: str) -> DataFrame:
    """Finds of every scope in documents and pages, in one pass over their texts."""
    return mining.mine(_reports(spark, folder))


def _mined_sql(scope: str, pattern: str, lookaround: tuple[str, str], valid: str, value: str = "lower(raw_form)") -> str:
    """DuckDB's expressions have no look-around: one character on each side is matched and cut off
    again, which finds the same as long as finds do not touch."""
    before, after = lookaround
    return rf"""
select document_id, '{scope}' as scope, (row_number() over (partition by document_id order by n) - 1)::int as pos, raw_form, {value} as value, {valid} as is_valid
from (select document_id, n, regexp_extract(hit, '{pattern}') as raw_form
      from (select 'doc-' || doc_id as document_id, unnest(hits) as hit, generate_subscripts(hits, 1) as n
            from (select doc_id, regexp_extract_all(' ' || coalesce(text, '') || ' ', '{before}{pattern}{after}') as hits from documents)))"""


def refang_defang_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    found = mining.mine(_docs(spark, folder), ("ip", "email"))
    masked = T.defang(F.col("raw_form"))
    return found.select("document_id", "scope", "pos", "raw_form", masked.alias("defanged"), T.refang(masked).alias("refanged"), T.is_defanged(masked).alias("was_defanged"))


def _candidates(spark: SparkSession, folder: str) -> DataFrame:
    """Mined rows as a reader would report them: some twice, some altered, some from the future."""
    found = mining.mine(_docs(spark, folder), ("ip", "email", "hash_sha1"))
    n = F.substring_index("document_id", "-", -1).cast("long") + F.col("pos")
    copies = found.withColumn("copy", F.explode(F.when(n % 3 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    n = F.substring_index("document_id", "-", -1).cast("long") + F.col("pos") + F.col("copy")
    return copies.select(
        "document_id", (F.col("pos") * 2 + F.col("copy")).alias("pos"), F.when(n % 11 == 0, "nonsense").otherwise(F.col("scope")).alias("scope"), F.when(n % 7 == 0, F.concat(F.col("raw_form"), F.lit("0"))).otherwise(F.col("raw_form")).alias("raw_form"),
        F.when(n % 13 == 0, "gossip").when(n % 2 == 0, "victim").otherwise("relay_node").alias("context"), F.when(n % 5 == 0, "2027-01-01 00:00:00").when(n % 5 == 1, "2025-03-01 00:00:00").alias("observed_at"),
    )


def _verified(spark: SparkSession, folder: str) -> DataFrame:
    return mining.verify(_candidates(spark, folder), _docs(spark, folder), F.lit(AVAILABLE).cast("timestamp"))


def verify_funnel(spark: SparkSession, folder: str) -> DataFrame:
    return mining.funnel(_verified(spark, folder), ["document_id"])


def indicator_ids(spark: SparkSession, folder: str) -> DataFrame:
    when = F.lit(AVAILABLE).cast("timestamp_ntz")
    made = mining.indicator_tables(_verified(spark, folder), _docs(spark, folder), when, when)
    return made.indicators.select("indicator_id", "indicator_type", "normalized_value")


def mention_ids(spark: SparkSession, folder: str) -> DataFrame:
    when = F.lit(AVAILABLE).cast("timestamp_ntz")
    made = mining.indicator_tables(_verified(spark, folder), _docs(spark, folder), when, when)
    a = made.assertions.select("assertion_id", F.col("source_mention_id").alias("mention_id"), "role")
    return made.mentions.select("mention_id", "indicator_id", "document_id", "source_family_id").join(a, "mention_id")


#: The key of the query below, which holds no secret; real ones are set where the workers start.
QUERY_KEY = ("INFRATRACE_QUERY_KEY", "a" * 32)


def public_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Indicators by a pseudonym that only the key's holder can make."""
    spark.sparkContext.environment.setdefault(*QUERY_KEY)
    when = F.lit(AVAILABLE).cast("timestamp_ntz")
    made = mining.indicator_tables(_verified(spark, folder), _docs(spark, folder), when, when, mining.public_id_udf(QUERY_KEY[0]))
    return made.indicators.select("indicator_id", "public_id")


_VERIFIED_SQL = r"""
docs as (
  select 'doc-' || doc_id as document_id, doc_id, text, 'family-' || source as source_family_id,
         case when doc_id % 10 <> 0 then timestamp '2025-01-01' + (doc_id % 365) * interval 1 day end as published_at from documents),
hits as (
  select document_id, doc_id, scope, (row_number() over (partition by document_id, scope order by n) - 1)::int as pos, regexp_extract(hit, pattern) as raw_form
  from (select document_id, doc_id, scope, pattern, unnest(hits) as hit, generate_subscripts(hits, 1) as n from (
    select document_id, doc_id, 'ip' as scope, '([0-9]{1,3}\.){3}[0-9]{1,3}' as pattern, regexp_extract_all(' ' || coalesce(text, '') || ' ', '[^0-9.]([0-9]{1,3}\.){3}[0-9]{1,3}[^0-9.]') as hits from docs
    union all select document_id, doc_id, 'email', '.+', regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9._%+-]+@([A-Za-z0-9-]+\.)+[A-Za-z]{2,}') from docs
    union all select document_id, doc_id, 'hash_sha1', '[0-9a-fA-F]{40}', regexp_extract_all(' ' || coalesce(text, '') || ' ', '[^0-9a-fA-F][0-9a-fA-F]{40}[^0-9a-fA-F]') from docs))),
copies as (select *, unnest(case when (doc_id + pos) % 3 = 0 then [0, 1] else [0] end) as copy from hits),
candidates as (
  select document_id, pos * 2 + copy as pos, case when n % 11 = 0 then 'nonsense' else scope end as scope, case when n % 7 = 0 then raw_form || '0' else raw_form end as raw_form,
         case when n % 13 = 0 then 'gossip' when n % 2 = 0 then 'victim' else 'relay_node' end as context,
         case when n % 5 = 0 then timestamp '2027-01-01' when n % 5 = 1 then timestamp '2025-03-01' end as seen
  from (select *, doc_id + pos + copy as n from copies)),
judged as (
  select c.*, d.text, d.published_at, d.source_family_id, coalesce(c.seen, d.published_at) as observed,
         case c.scope when 'hash_sha1' then lower(raw_form) when 'email' then regexp_replace(raw_form, '@.*$', '') || '@' || lower(regexp_extract(raw_form, '@(.*)$', 1)) else raw_form end as value
  from candidates c join docs d using (document_id)),
gated as (
  select *, case
    when context = 'gossip' then 'format_rejected'
    when not coalesce(case scope when 'ip' then regexp_full_match(value, '((25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])\.){3}(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])')
         when 'email' then regexp_full_match(value, '[A-Za-z0-9._%+\-]+@([A-Za-z0-9-]+\.)+[A-Za-z]{2,}') when 'hash_sha1' then regexp_full_match(value, '[0-9a-fA-F]{40}') else false end, false) then 'format_rejected'
    when not contains(text, raw_form) then 'source_mismatch' when observed is null then 'format_rejected' when observed > timestamp '2026-06-01' then 'future_time' else 'verified' end as gate from judged),
verified as (
  select *, case when gate = 'verified' and row_number() over (partition by document_id, scope, value, gate order by pos, raw_form) > 1 then 'duplicate' else gate end as status,
         'ioc-' || sha256(scope || '|' || value)[1:20] as indicator_id, sha256(raw_form) as raw_hash, sha256('') as evidence from gated),
mentions as (
  select *, 'mention-' || sha256(document_id || '|' || indicator_id || '|' || raw_hash || '|' || evidence)[1:20] as mention_id, case context when 'relay_node' then 'relay_orb' else context end as role
  from verified where status = 'verified' and published_at is not null)"""


def url_canonical(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "pages").select("page_id", T.canonical_url(F.col("url")).alias("canonical"))


ALLOWED = ("example.com", "ththth.example.net")


def _allowlist(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(x,) for x in ALLOWED], "domain string")


def search_dedupe_rank(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages").select((F.col("page_id") % 10).alias("query_id"), F.col("page_id").alias("pos"), F.regexp_replace("url", r"/\d+", "/x").alias("url"))
    told = mining.search_candidates(pages, _allowlist(spark))
    return told.select("query_id", "pos", "rank", "canonical", "status", "candidate_id")


def allowlist_filter(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages").select(F.lit(0).alias("query_id"), F.col("page_id").alias("pos"), "url")
    told = mining.search_candidates(pages, _allowlist(spark))
    return told.groupBy("publisher").agg(F.count("*").alias("pages"), F.count_if(F.col("status") != "outside_allowlist").alias("inside"))


def domain_block_reason(spark: SparkSession, folder: str) -> DataFrame:
    host = T.url_host(F.col("url"))
    label = F.element_at(F.split(host, r"\."), 1)
    made = F.array(host, F.concat(label, F.lit(".exe")), label, F.concat(F.lit("trojan."), label, F.lit(".net")), F.concat(label, F.lit(".badinfra.net")), F.concat(F.lit("-"), label, F.lit(".net")))
    return table(spark, folder, "pages").select("page_id", F.posexplode(made).alias("variant", "domain")).withColumn("reason", T.domain_block_reason(F.col("domain")))


_CANONICAL_SQL = r"""
parts as (
  select *, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.\-]*)://', 1)) as scheme, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)', 1)) as host,
         regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)', 1) as path, regexp_extract(url, '^[^?#]*\?([^#]*)', 1) as query from pages_in),
canon as (
  select *, scheme || '://' || host || case when path = '' then '/' else path end
    || case when query = '' then '' else '?' || array_to_string(list_sort(list_filter(string_split(query, '&'), lambda p: p <> '')), '&') end as canonical from parts)"""


def publication_precision(spark: SparkSession, folder: str) -> DataFrame:
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    raw = F.when(F.col("o_orderkey") % 6 == 0, day).when(F.col("o_orderkey") % 6 == 1, F.substring(day, 1, 7)).when(F.col("o_orderkey") % 6 == 2, F.substring(day, 1, 4)).when(F.col("o_orderkey") % 6 == 3, F.concat(day, F.lit("T10:00:00Z"))).when(F.col("o_orderkey") % 6 == 4, F.concat(day, F.lit("T10:00:00"))).otherwise(" ")
    told = table(spark, folder, "orders").select("o_orderkey", raw.alias("raw"))
    return told.select("o_orderkey", "raw", T.publication_precision(F.col("raw")).alias("published_time_precision"), T.publication_timezone(F.col("raw"), F.lit(None).cast("string")).alias("source_timezone"))


def html_main_text(spark: SparkSession, folder: str) -> DataFrame:
    return html.main_text(table(spark, folder, "pages").select("page_id", "html"))


def extract_and_verify(spark: SparkSession, folder: str) -> DataFrame:
    """Pages to verified indicators; every sixth page says where it was reported, others hold addresses."""
    p, k = table(spark, folder, "pages"), F.col("page_id")
    address = F.concat_ws(".", F.lit("9"), (k % 300).cast("string"), (k % 7).cast("string"), (k % 90).cast("string"))
    note = F.when(k % 6 == 0, F.concat(F.lit("<p>See "), F.replace(address, F.lit("."), F.lit("[.]")), F.lit("</p>"))).otherwise(F.concat(F.lit("<p>Seen at "), address, F.lit(" and "), address, F.lit(" by op"), k.cast("string"), F.lit("@relay.example.org today</p>")))
    pages = p.select(k.alias("document_id"), F.replace("html", F.lit("</article>"), F.concat(note, F.lit("</article>"))).alias("html"), F.when(k % 5 != 0, F.lit("2025-05-01").cast("timestamp_ntz")).alias("published_at"))
    told = mining.extract_and_verify(pages, F.lit(AVAILABLE).cast("timestamp"), ("ip", "email"))
    return told.select("document_id", "scope", "pos", "raw_form", "value", "status", "indicator_id", "document_format", "text_extractor", "text_sha256", "text_chars")


def independent_sources(spark: SparkSession, folder: str) -> DataFrame:
    d = _docs(spark, folder)
    claims = table(spark, folder, "documents").select("lang", F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("document_id"))
    return corpus.independent_sources(claims, d.where("doc_id % 17 <> 0"), ["lang"])


def estimated_sources(spark: SparkSession, folder: str) -> DataFrame:
    """Different customers of each nation, counted and estimated from stored sketches of years, and whether the
    estimate is within four standard errors."""
    o, c = table(spark, folder, "orders"), table(spark, folder, "customer")
    rows = o.join(c.select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
    claims = rows.select("c_nationkey", F.year("o_orderdate").alias("year"), F.col("o_orderkey").alias("document_id"))
    members = o.select(F.col("o_orderkey").alias("document_id"), F.col("o_custkey").alias("source_family_id"))
    sketches = stash(corpus.family_sketches(claims, members, ["c_nationkey"], ["year"]), "sketches")
    told = corpus.estimated_sources(sketches, ["c_nationkey"]).join(corpus.independent_sources(claims, members, ["c_nationkey"]), "c_nationkey")
    near = F.abs(F.col("estimated_sources") - F.col("independent_sources")) <= 4 * F.col("relative_error") * F.col("independent_sources") + 1
    return told.select("c_nationkey", "claims", "independent_sources", near.alias("is_near"))


def address_forms(spark: SparkSession, folder: str) -> DataFrame:
    """Addresses of many forms made from customers: which are some, and which are globally routable."""
    k, x = F.col("c_custkey"), F.hex("c_custkey")
    forms = [F.concat(F.lit("2600:"), x, F.lit("::1")), F.concat(F.lit("2001:db8::"), x), F.concat(F.lit("::ffff:8.8."), (k % 256).cast("string"), F.lit(".9")), F.concat(F.lit("::ffff:10.0."), (k % 300).cast("string"), F.lit(".9")),
             F.concat(F.lit("fe80::"), x, F.lit("%eth0")), F.concat(F.lit("2600::"), x, F.lit("::1")), F.concat(F.lit("2600:1:2:3:4:5:6:"), x), F.concat(F.lit("8.8."), (k % 300).cast("string"), F.lit(".7"))]
    value = F.element_at(F.array(*forms), (k % 8 + 1).cast("int"))
    return table(spark, folder, "customer").select("c_custkey", value.alias("value")).select("c_custkey", "value", T.is_ip(F.col("value")).alias("is_ip"), T.ip_is_global(F.col("value")).alias("is_global"))


def error_classes(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events").where("event_type = 'error'")
    k = F.col("event_id") % 7
    message = F.when(k == 0, "SSL: CERTIFICATE_VERIFY_FAILED").when(k == 1, "Status 429 too many").when(k == 2, "bad gateway, status code: 504").when(k == 3, "status=502").when(k == 4, "request timed out").when(k == 5, "Status 404").otherwise("broken pipe")
    told = e.select(message.alias("message"), F.when(k == 6, "ConnectionError").otherwise("ApiError").alias("class_name"))
    told = told.select(T.error_category(F.col("message"), F.col("class_name")).alias("category"), T.http_status(F.col("message")).alias("http_status"))
    return told.withColumn("retryable", T.error_retryable(F.col("category"), F.col("http_status"))).groupBy("category", "http_status", "retryable").agg(F.count("*").alias("errors"))


def pivot_plan(spark: SparkSession, folder: str) -> DataFrame:
    v = _verified(spark, folder).where("status = 'verified'")
    rows = v.select("document_id", "indicator_id", "scope", "value", T.context_role(F.col("context")).alias("role"), F.col("observed").alias("available_at"))
    return pivots.plan_pivots(rows, F.lit("2025-12-31").cast("timestamp")).select("document_id", "indicator_id", "scope", "value", "query_class", "pivot_type", "status", "reason", "query_text")


_BROAD = "', '".join(T.BROAD_SUFFIXES)
_FILES = "', '".join(T.FILELIKE_SUFFIXES)
_MALWARE = "', '".join(T.MALWARE_LABELS)


def leakage_filter(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "lineitem")
    return constraints.leakage(rows, F.lit("1996-06-30").cast("timestamp_ntz"), ["l_returnflag", "l_linestatus"], "l_shipdate")


def manifest_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Content ids by both recipes over a star-schema table."""
    from ..functions.ids import json_id

    c = table(spark, folder, "customer")
    return c.select("c_custkey", joined_id("src", F.col("c_name"), F.col("c_mktsegment")).alias("joined"), json_id("src", name=F.col("c_name"), nation=F.col("c_nationkey"), segment=F.col("c_mktsegment"), gone=F.lit(None).cast("string")).alias("canonical"), sha256_text(F.col("c_name")).alias("name_sha256"))


_EMAIL = r"[A-Za-z0-9._%+-]+@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}"
_IP = r"(?:[0-9]{1,3}\.){3}[0-9]{1,3}"
_IP_OK = r"regexp_full_match(raw_form, '((25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])\.){3}(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])')"

#: The pages' one article: pieces between tags, with the entities that pages use.
_TEXT_SQL = r"""
pieces as (
  select page_id, list_filter(list_transform(string_split_regex(regexp_extract(html, '(?s)<article>(.*)</article>', 1), '<[^>]*>'),
    lambda t: regexp_replace(replace(replace(replace(replace(t, '&quot;', '"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&'), '^\s+|\s+$', '', 'g')), lambda t: t <> '') as shown from pages_in),
texts as (select page_id, array_to_string(shown, chr(10)) as text from pieces)"""
_BLOCKED = rf"""case when domain = '' then 'empty_domain' when not contains(domain, '.') then 'single_label_domain'
  when not regexp_full_match(domain, '[a-z0-9]([a-z0-9-]{{0,61}}[a-z0-9])?(\.[a-z0-9]([a-z0-9-]{{0,61}}[a-z0-9])?)*') then 'invalid_domain_syntax'
  when list_contains({list(T.BROAD_EXACT)}, domain) or len(list_filter(['{_BROAD}'], lambda s: domain = s or suffix(domain, '.' || s))) > 0 then 'broad_or_reference_domain'
  when list_contains(['{_FILES}'], string_split(domain, '.')[-1]) then 'filelike_domain' when list_has_any(['{_MALWARE}'], string_split(domain, '.')) then 'malware_label_domain' else '' end"""

QUERIES = {
    "mine_ipv4": _mined("ip"), "mine_email": _mined("email"), "mine_sha1": _mined("hash_sha1"), "mine_domain": mine_domain, "mine_scopes": mine_scopes,
    "refang_defang_roundtrip": refang_defang_roundtrip, "verify_funnel": verify_funnel, "indicator_ids": indicator_ids, "mention_ids": mention_ids, "public_ids": public_ids,
    "url_canonical": url_canonical, "allowlist_filter": allowlist_filter, "domain_block_reason": domain_block_reason, "search_dedupe_rank": search_dedupe_rank,
    "publication_precision": publication_precision, "html_main_text": html_main_text, "extract_and_verify": extract_and_verify, "independent_sources": independent_sources, "estimated_sources": estimated_sources, "address_forms": address_forms, "error_classes": error_classes,
    "pivot_plan": pivot_plan, "leakage_filter": leakage_filter, "manifest_ids": manifest_ids,
}

ORACLES = {
    "html_main_text": rf"""
with pages_in as (select * from pages), {_TEXT_SQL}
select page_id, text, 'html_main' as extractor, len(text)::int as text_chars, sha256(text) as text_sha256, case when len(text) > 2000000 then 'document_too_long' end as reason from texts""",
    "extract_and_verify": rf"""
with noted as (select *, '9.' || (page_id % 300) || '.' || (page_id % 7) || '.' || (page_id % 90) as a from pages),
pages_in as (
  select page_id, replace(html, '</article>', case when page_id % 6 = 0 then '<p>See ' || replace(a, '.', '[.]') || '</p>' else '<p>Seen at ' || a || ' and ' || a || ' by op' || page_id || '@relay.example.org today</p>' end || '</article>') as html from noted),
{_TEXT_SQL},
hits as (
  select page_id, text, 'ip' as scope, unnest(regexp_extract_all(' ' || regexp_replace(text, '([^0-9.])', '\1\1', 'g') || ' ', '[^0-9.]((?:[0-9]{{1,3}}\.){{3}}[0-9]{{1,3}})[^0-9.]', 1)) as raw_form, generate_subscripts(regexp_extract_all(' ' || regexp_replace(text, '([^0-9.])', '\1\1', 'g') || ' ', '[^0-9.]((?:[0-9]{{1,3}}\.){{3}}[0-9]{{1,3}})[^0-9.]', 1), 1) - 1 as pos from texts
  union all select page_id, text, 'email', unnest(regexp_extract_all(text, '{_EMAIL}')), generate_subscripts(regexp_extract_all(text, '{_EMAIL}'), 1) - 1 from texts),
judged as (select *, case when scope = 'email' or {_IP_OK} then case when page_id % 5 = 0 then 'format_rejected' else 'verified' end else 'format_rejected' end as gate from hits),
told as (select *, case when gate = 'verified' and row_number() over (partition by page_id, scope, raw_form order by pos) > 1 then 'duplicate' else gate end as status from judged)
select page_id::varchar as document_id, scope, pos::int as pos, raw_form, raw_form as value, status, case when status in ('verified', 'duplicate') then 'ioc-' || sha256(scope || '|' || raw_form)[1:20] end as indicator_id,
  'html_or_text' as document_format, 'html_main' as text_extractor, sha256(text) as text_sha256, len(text)::int as text_chars from told""",
    "mine_scopes": rf"""
with reports as (
  select document_id, concat_ws(' ', text, md5(document_id), upper(sha256(document_id)), 'hxxps://' || document_id || '.example.org/a?b=1') as text
  from (select 'doc-' || doc_id as document_id, text from documents union all select 'page-' || page_id, html from pages)),
found as (
  select document_id, 'ip' as scope, regexp_extract_all(' ' || regexp_replace(text, '([^0-9.])', '\1\1', 'g') || ' ', '[^0-9.]((?:[0-9]{{1,3}}\.){{3}}[0-9]{{1,3}})[^0-9.]', 1) as h from reports
  union all select document_id, 'email', regexp_extract_all(text, '{_EMAIL}') from reports
  union all select document_id, 'url', regexp_extract_all(text, '(?i)\bh(?:tt|xx)ps?(?:\[:\]|:)//[^\s"''<>]+') from reports
  union all select document_id, 'domain', regexp_extract_all(' ' || regexp_replace(text, '([^@\w.\-])', '\1\1', 'g') || ' ', '(?i)[^@\w.\-]((?:[a-z0-9](?:[a-z0-9-]{{0,61}}[a-z0-9])?\.)+[a-z][a-z0-9-]{{1,62}})[^\w@\-]', 1) from reports
  union all select document_id, 'hash_' || name, regexp_extract_all(' ' || regexp_replace(text, '([^0-9a-fA-F])', '\1\1', 'g') || ' ', '[^0-9a-fA-F]([0-9a-fA-F]{{' || digits || '}})[^0-9a-fA-F]', 1)
  from reports, (values ('md5', 32), ('sha1', 40), ('sha256', 64)) t(name, digits))
select document_id, scope, (generate_subscripts(h, 1) - 1)::int as pos, unnest(h) as raw_form from found""",
    "mine_domain": rf"""
with apart as (select page_id, ' ' || regexp_replace(html, '([^@\w.\-])', '\1\1', 'g') || ' ' as t from pages),
hits as (select page_id, regexp_extract_all(t, '(?i)[^@\w.\-]((?:[a-z0-9](?:[a-z0-9-]{{0,61}}[a-z0-9])?\.)+[a-z][a-z0-9-]{{1,62}})[^\w@\-]', 1) as h from apart),
each as (select page_id, unnest(h) as raw_form, generate_subscripts(h, 1) - 1 as pos from hits),
told as (select *, lower(raw_form) as domain from each)
select page_id as document_id, 'domain' as scope, pos::int as pos, raw_form, domain as value, len(domain) between 4 and 253 as is_valid, {_BLOCKED} as block_reason from told""",
    "mine_ipv4": _mined_sql("ip", _IP, ("[^0-9.]", "[^0-9.]"), _IP_OK, "raw_form"),
    "mine_email": _mined_sql("email", _EMAIL, ("", ""), "true", "regexp_extract(raw_form, '^(.*)@', 1) || '@' || lower(regexp_extract(raw_form, '@([^@]*)$', 1))"),
    "mine_sha1": _mined_sql("hash_sha1", "[0-9a-fA-F]{40}", ("[^0-9a-fA-F]", "[^0-9a-fA-F]"), "true"),
    "refang_defang_roundtrip": f"""
with {_VERIFIED_SQL}
select document_id, scope, pos, raw_form, replace(replace(raw_form, '@', '[@]'), '.', '[.]') as defanged, raw_form as refanged, true as was_defanged from hits where scope in ('ip', 'email')""",
    "verify_funnel": f"""
with {_VERIFIED_SQL}
select document_id, count(*) as candidates, count(*) filter (status = 'verified') as verified, count(*) filter (status = 'format_rejected') as format_rejected, count(*) filter (status = 'source_mismatch') as source_mismatch,
       count(*) filter (status = 'future_time') as future_time, count(*) filter (status = 'duplicate') as duplicates from verified group by document_id""",
    "indicator_ids": f"with {_VERIFIED_SQL} select distinct indicator_id, case scope when 'ip' then 'ipv4' else 'other' end as indicator_type, value as normalized_value from mentions",
    "public_ids": rf"""
with {_VERIFIED_SQL}
select distinct indicator_id, 'pub-' || sha256(encode(repeat('=', 32) || repeat('\', 32)) || unhex(sha256(repeat('W', 32) || repeat('6', 32) || scope || '|' || value)))[1:24] as public_id
from mentions""",
    "mention_ids": f"with {_VERIFIED_SQL} select distinct mention_id, indicator_id, document_id, source_family_id, 'assert-' || sha256(mention_id || '|' || role || '|' || evidence)[1:20] as assertion_id, role from mentions",
    "url_canonical": f"with pages_in as (select * from pages), {_CANONICAL_SQL} select page_id, canonical from canon",
    "allowlist_filter": f"""
with pages_in as (select * from pages), {_CANONICAL_SQL}
select host as publisher, count(*) as pages, count(*) filter ({" or ".join(f"host = '{d}' or host like '%.{d}'" for d in ALLOWED)}) as inside from canon group by host""",
    "search_dedupe_rank": f"""
with pages_in as (select page_id % 10 as query_id, page_id as pos, regexp_replace(url, '/\\d+', '/x', 'g') as url from pages), {_CANONICAL_SQL},
gated as (select *, row_number() over (partition by query_id order by pos)::int as rank, case when {" or ".join(f"host = '{d}' or host like '%.{d}'" for d in ALLOWED)} then 'candidate' else 'outside_allowlist' end as gate from canon),
told as (select *, case when gate = 'candidate' and row_number() over (partition by canonical, gate order by query_id, pos) > 1 then 'duplicate' else gate end as status from gated)
select query_id, pos, rank, canonical, status, case when status = 'candidate' then 'cti-candidate-' || sha256(canonical)[1:16] end as candidate_id from told""",
    "domain_block_reason": rf"""
with hosts as (select page_id, lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1)) as host from pages),
made as (select page_id, host, string_split(host, '.')[1] as label from hosts),
variants as (
  select page_id, unnest([0, 1, 2, 3, 4, 5]) as variant, unnest([host, label || '.exe', label, 'trojan.' || label || '.net', label || '.badinfra.net', '-' || label || '.net']) as domain from made)
select page_id, variant, domain, case when domain = '' then 'empty_domain' when not contains(domain, '.') then 'single_label_domain'
  when not regexp_full_match(domain, '[a-z0-9]([a-z0-9-]{{0,61}}[a-z0-9])?(\.[a-z0-9]([a-z0-9-]{{0,61}}[a-z0-9])?)*') then 'invalid_domain_syntax'
  when len(list_filter(['{_BROAD}'], lambda s: domain = s or suffix(domain, '.' || s))) > 0 then 'broad_or_reference_domain'
  when list_contains(['{_FILES}'], string_split(domain, '.')[-1]) then 'filelike_domain' when list_has_any(['{_MALWARE}'], string_split(domain, '.')) then 'malware_label_domain' else '' end as reason
from variants""",
    "publication_precision": r"""
with raws as (
  select o_orderkey, case o_orderkey % 6 when 0 then d when 1 then d[1:7] when 2 then d[1:4] when 3 then d || 'T10:00:00Z' when 4 then d || 'T10:00:00' else ' ' end as raw
  from (select o_orderkey, strftime(o_orderdate, '%Y-%m-%d') as d from orders))
select o_orderkey, raw, case when trim(raw) = '' then 'unknown' when regexp_full_match(raw, '\d{4}-\d{2}-\d{2}') then 'date' when regexp_full_match(raw, '\d{4}-\d{2}') then 'month' when regexp_full_match(raw, '\d{4}') then 'year'
  when raw like '%Z' then 'exact_timestamp' else 'unknown' end as published_time_precision, case when raw like '%Z' then 'UTC' else 'unknown' end as source_timezone from raws""",
    "independent_sources": """
select lang, count(distinct doc_id) as documents, count(distinct case when doc_id % 17 <> 0 then source end) as independent_sources, count(*) filter (doc_id % 17 = 0 or source is null) as without_family
from documents group by lang""",
    "estimated_sources": """
select c_nationkey, count(*) as claims, count(distinct o_custkey) as independent_sources, true as is_near from orders join customer on c_custkey = o_custkey group by 1""",
    "address_forms": """
select c_custkey, value, form in (0, 1, 2, 4, 6) or (form in (3, 7) and c_custkey % 300 <= 255) as is_ip,
       case when form in (0, 2, 6) then true when form in (1, 4) then false when form = 3 and c_custkey % 300 <= 255 then false when form = 7 and c_custkey % 300 <= 255 then true end as is_global
from (select c_custkey, c_custkey % 8 as form, case c_custkey % 8 when 0 then '2600:' || h || '::1' when 1 then '2001:db8::' || h when 2 then '::ffff:8.8.' || c_custkey % 256 || '.9' when 3 then '::ffff:10.0.' || c_custkey % 300 || '.9'
        when 4 then 'fe80::' || h || '%eth0' when 5 then '2600::' || h || '::1' when 6 then '2600:1:2:3:4:5:6:' || h else '8.8.' || c_custkey % 300 || '.7' end as value
      from (select c_custkey, upper(printf('%x', c_custkey)) as h from customer))""",
    "error_classes": """
select category, http_status, category <> 'ssl_cert_verify_failed' and (http_status in ('429','500','502','503','504') or category in ('api_timeout','network_error','api_rate_limited','api_504_gateway_timeout','api_5xx_error')) as retryable, count(*) as errors
from (select case event_id % 7 when 0 then 'ssl_cert_verify_failed' when 1 then 'api_rate_limited' when 2 then 'api_504_gateway_timeout' when 3 then 'api_5xx_error' when 4 then 'api_timeout' when 5 then 'scan_api_error' else 'network_error' end as category,
             case event_id % 7 when 1 then '429' when 2 then '504' when 3 then '502' when 5 then '404' else '' end as http_status from events where event_type = 'error') group by all""",
    "pivot_plan": rf"""
with {_VERIFIED_SQL},
rows as (select document_id, indicator_id, scope, value, case context when 'relay_node' then 'relay_orb' else context end as role, observed as available_at, string_split(value, '.') as p from verified where status = 'verified'),
told as (
  select *, case when scope = 'ip' then p[1]::bigint * 16777216 + p[2]::bigint * 65536 + p[3]::bigint * 256 + p[4]::bigint end as n from rows),
reasons as (
  select *, case when available_at > timestamp '2025-12-31' then 'accepted assertion is available after cutoff' when role <> 'relay_orb' then 'accepted assertion role is not pivotable: ' || role
    when scope = 'ip' and ({" or ".join(f"n between {int(net[0])} and {int(net[-1])}" for net in map(__import__("ipaddress").ip_network, T.NOT_GLOBAL))}) then 'IP is not globally routable'
    when scope <> 'ip' then 'scope has no direct template' end as reason from told)
select document_id, indicator_id, scope, value, case when available_at <= timestamp '2025-12-31' and role = 'relay_orb' and scope = 'ip' then 'q0_seed' end as query_class,
  case when available_at <= timestamp '2025-12-31' and role = 'relay_orb' and scope = 'ip' then 'ip' end as pivot_type,
  case when reason is null then 'registered_not_executed' when reason = 'scope has no direct template' then 'unsupported' else 'blocked' end as status, reason, case when reason is null then 'host.ip = ' || value end as query_text
from reasons""",
    "leakage_filter": "select l_returnflag, l_linestatus, count(*) as rows, count(*) filter (l_shipdate > timestamp '1996-06-30') as leaked from lineitem group by 1, 2",
    "manifest_ids": """
select c_custkey, 'src-' || sha256(c_name || '|' || c_mktsegment)[1:20] as joined,
  'src-' || sha256('{"gone":null,"name":"' || c_name || '","nation":' || c_nationkey || ',"segment":"' || c_mktsegment || '"}')[1:20] as canonical, sha256(c_name) as name_sha256 from customer""",
}
