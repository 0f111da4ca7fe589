"""Documents to indicators: mining, verification, tables of indicators, mentions and assertions."""

from __future__ import annotations

import hmac
import os
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import html as H
from ..functions import text as T
from ..functions.ids import joined_id, json_id, sha256_text

#: What to look for in running text, for each scope that a pattern can find.
PATTERNS = {
    "ip": r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9.])",
    "email": r"[A-Za-z0-9._%+-]+@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}",
    "hash_md5": r"(?<![0-9a-fA-F])[0-9a-fA-F]{32}(?![0-9a-fA-F])",
    "hash_sha1": r"(?<![0-9a-fA-F])[0-9a-fA-F]{40}(?![0-9a-fA-F])",
    "hash_sha256": r"(?<![0-9a-fA-F])[0-9a-fA-F]{64}(?![0-9a-fA-F])",
    "url": r"(?i)\bh(?:tt|xx)ps?(?:\[:\]|:)//[^\s\"'<>]+",
    "domain": r"(?i)(?<![@\w.-])(?:[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?(?:\.|\[\.\]))+[a-z][a-z0-9-]{1,62}(?![\w@-])",
}


#: What a text holds that has a find of the scope; the rest is not searched by the scope's pattern.
TRIGGERS = {"ip": lambda t: t.rlike(r"[0-9]\.[0-9]"), "email": lambda t: F.contains(t, F.lit("@")), "url": lambda t: F.contains(t, F.lit("//")), "domain": lambda t: F.contains(t, F.lit("."))}
#: Scopes that are whole runs of hexadecimal digits, by length: one pass finds them all.
RUNS = {"hash_md5": 32, "hash_sha1": 40, "hash_sha256": 64}


def mine(docs: DataFrame, scopes: tuple[str, ...] = tuple(PATTERNS), text: str = "text", document_id: str = "document_id", patterns: dict[str, str] | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """document_id, scope, pos (of the find within its scope, from 0) and raw_form of every find, and the
    `keep` columns of its document. Hashes of all lengths are found in one pass; other scopes search only texts
    that hold what a find cannot be without. `patterns` are searched as they are."""
    own, none = patterns or {}, F.array().cast("array<string>")
    kept = F.struct(F.lit(0).alias("_"), *keep).alias("_keep")
    rows = docs.select(F.col(document_id).alias("document_id"), kept, F.col(text).alias("_text"))
    if any(s in RUNS and s not in own for s in scopes):
        rows = rows.withColumn("_runs", F.coalesce(F.regexp_extract_all("_text", F.lit(f"[0-9a-fA-F]{{{min(RUNS.values())},}}"), 0), none))

    def finds(scope: str) -> Column:
        if scope in RUNS and scope not in own:
            hits = F.filter("_runs", lambda v: F.length(v) == RUNS[scope])
        else:
            hits = F.regexp_extract_all(F.col("_text"), F.lit(own.get(scope) or PATTERNS[scope]), 0)
            hits = F.coalesce(hits if scope in own else F.when(TRIGGERS[scope](F.col("_text")), hits), none)
        return F.transform(hits, lambda v, i: F.struct(F.lit(scope).alias("scope"), i.alias("pos"), v.alias("raw_form")))

    return rows.select("document_id", "_keep", F.explode(F.concat(*map(finds, scopes))).alias("f")).select("document_id", "f.*", *[F.col("_keep").getField(k).alias(k) for k in keep])


def mine_with(docs: DataFrame, extract: Callable[[str], list[tuple]], text: str = "text", document_id: str = "document_id") -> DataFrame:
    """Finds of a user's function from a text to (scope, raw_form, context, observed_at) tuples."""
    def run(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in rows:
            out = [(d, i, *f) for d, t in zip(frame["document_id"], frame["text"]) for i, f in enumerate(extract(t or ""))]
            yield pd.DataFrame(out, columns=["document_id", "pos", "scope", "raw_form", "context", "observed_at"])

    chosen = docs.select(F.col(document_id).cast("string").alias("document_id"), F.col(text).alias("text"))
    return chosen.mapInPandas(run, "document_id string, pos int, scope string, raw_form string, context string, observed_at string")


def extractor_udtf(extract: Callable[[str], list[tuple]]):
    """The same function as a table function for SQL: `select d.id, f.* from docs d, lateral name(d.text) f` once it
    is registered by spark.udtf.register(name, ...)."""
    class Extract:
        def eval(self, text: str):
            for pos, found in enumerate(extract(text or "")):
                yield (pos, *found)

    return F.udtf(Extract, returnType="pos int, scope string, raw_form string, context string, observed_at string")


def verify(candidates: DataFrame, docs: DataFrame, available_at: Column, text: str | None = "text", ipv6: bool = True) -> DataFrame:
    """candidates with value, observed, time_basis and status.

    Gates in order: context, form, verbatim in the source, time. The first row of a (document, scope,
    value) that passes is verified, later ones are duplicate.
    candidates: document_id, pos, scope, raw_form and, if there are, context and observed_at (text).
    docs: document_id, text, published_at. A document meets the different forms reported for it once, so
    texts do not multiply; `text` None says that candidates were cut out of their texts, which are then
    not read.
    """
    have = candidates.columns
    rows = candidates
    for c in ("context", "observed_at"):
        if c not in have:
            rows = rows.withColumn(c, F.lit("unknown" if c == "context" else None).cast("string"))
    told = rows.join(docs.select("document_id", F.col("published_at").cast("timestamp").alias("_published")), "document_id", "left")
    if text is None:
        told = told.withColumn("_found", F.lit(True))
    else:
        forms = rows.groupBy("document_id").agg(F.collect_set("raw_form").alias("_forms"))
        verbatim = docs.select("document_id", F.col(text).alias("_text")).join(forms, "document_id")
        verbatim = verbatim.select("document_id", F.explode(F.filter("_forms", lambda f: F.contains("_text", f))).alias("raw_form"), F.lit(True).alias("_found")).distinct()
        told = told.join(verbatim, ["document_id", "raw_form"], "left")
    scope, raw, seen = F.col("scope"), F.col("raw_form"), F.nullif(F.col("observed_at"), F.lit(""))
    told = told.withColumn("value", T.normalize(scope, raw)).withColumn("_observed", F.when(seen.isNull(), F.col("_published")).otherwise(seen.try_cast("timestamp")))
    told = told.withColumn("time_basis", F.when(seen.isNull(), "publication_date_fallback").otherwise("observed_in_report"))
    gate = (
        F.when(~F.coalesce(F.col("context"), F.lit("unknown")).isin(*T.CONTEXTS) | ~T.valid(scope, F.col("value"), ipv6), "format_rejected")
        .when(F.col("_found").isNull(), "source_mismatch").when(F.col("_observed").isNull(), "format_rejected")
        .when(F.col("_observed") > available_at.cast("timestamp"), "future_time").otherwise("verified")
    )
    told = told.withColumn("_gate", gate)
    nth = F.row_number().over(Window.partitionBy("document_id", "scope", "value", "_gate").orderBy("pos", "raw_form"))
    told = told.withColumn("status", F.when((F.col("_gate") == "verified") & (nth > 1), "duplicate").otherwise(F.col("_gate")))
    return told.withColumn("observed", F.col("_observed")).withColumn("indicator_id", F.when(F.col("status").isin("verified", "duplicate"), joined_id("ioc", scope, F.col("value")))).select(*rows.columns, "value", "observed", "time_basis", "status", "indicator_id")


def extract_and_verify(pages: DataFrame, available_at: Column, scopes: tuple[str, ...] = tuple(PATTERNS), html: str = "html", document_id: str = "document_id", ipv6: bool = True, max_chars: int = H.MAX_CHARS) -> DataFrame:
    """Pages (document_id, published_at and markup) to verified indicators in one pass: readable text,
    mining, the gates of `verify`, and where each find comes from (document_format, text_extractor,
    text_sha256, text_chars). Pages that are too long give one row of status document_too_long."""
    read = H.main_text(pages.select(F.col(document_id).cast("string").alias("document_id"), "published_at", F.col(html).alias("html")), max_chars=max_chars)
    source = F.struct("published_at", F.lit("html_or_text").alias("document_format"), F.col("extractor").alias("text_extractor"), "text_sha256", "text_chars", "reason").alias("source")
    found = mine(read.select("document_id", F.when(F.col("reason").isNull(), F.col("text")).alias("text"), source), scopes, keep=("source",))
    dates = found.select("document_id", "source.published_at").distinct()
    told = verify(found, dates, available_at, text=None, ipv6=ipv6)
    long = read.where("reason is not null").select("document_id", source, F.col("reason").alias("status"))
    kept = ["document_id", "scope", "pos", "raw_form", "value", "observed", "time_basis", "status", "indicator_id", "source.document_format", "source.text_extractor", "source.text_sha256", "source.text_chars"]
    return told.unionByName(long, allowMissingColumns=True).select(*kept)


def funnel(verified: DataFrame, by: list[str]) -> DataFrame:
    """Counts of candidates by outcome."""
    n = lambda s: F.count_if(F.col("status") == s)
    return verified.groupBy(*by).agg(F.count("*").alias("candidates"), n("verified").alias("verified"), n("format_rejected").alias("format_rejected"), n("source_mismatch").alias("source_mismatch"), n("future_time").alias("future_time"), n("duplicate").alias("duplicates"))


class IndicatorTables(NamedTuple):
    indicators: DataFrame
    mentions: DataFrame
    assertions: DataFrame
    rejected: DataFrame


def public_id_udf(key_variable: str):
    """scope|value -> pub- and 24 hex digits of an HMAC. The key (32 bytes or more) is read from an
    environment variable where the rows are, so it is in no plan and no log."""
    @F.pandas_udf(StringType())
    def public_id(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        key = os.environ.get(key_variable, "").encode()
        if len(key) < 32:
            raise ValueError(f"{key_variable} must hold 32 bytes or more")
        for values in batches:
            yield pd.Series([None if v is None else "pub-" + hmac.new(key, v.encode(), "sha256").hexdigest()[:24] for v in values], dtype=object)

    return public_id


def indicator_tables(verified: DataFrame, docs: DataFrame, ingested_at: Column, available_at: Column, public_id=None) -> IndicatorTables:
    """Indicators, mentions and pending assertions of verified rows whose document has an exact
    publication time and a source family; other rows are rejected with a reason."""
    if "context_evidence" not in verified.columns:
        verified = verified.withColumn("context_evidence", F.lit(""))
    rows = verified.where("status = 'verified'").join(docs.select("document_id", "source_family_id", "published_at", "published_time_precision"), "document_id", "left")
    reason = F.when(F.col("published_at").isNull() | (F.col("published_time_precision") != "exact_timestamp"), "publication_time_not_exact").when(F.coalesce("source_family_id", F.lit("")) == "", "source_family_missing")
    rows = rows.withColumn("reason", reason)
    good = rows.where("reason is null")
    raw_hash, evidence = sha256_text(F.col("raw_form")), sha256_text(F.substring("context_evidence", 1, 500))
    good = good.withColumn("raw_form_hash", raw_hash).withColumn("context_excerpt_hash", evidence).withColumn("role", T.context_role(F.col("context")))
    good = good.withColumn("mention_id", joined_id("mention", F.col("document_id"), F.col("indicator_id"), F.col("raw_form_hash"), F.col("context_excerpt_hash")))
    shown = public_id(F.concat_ws("|", "scope", "value")) if public_id else F.lit(None).cast("string")
    indicators = good.select("indicator_id", T.indicator_type(F.col("scope"), F.col("value")).alias("indicator_type"), F.col("value").alias("normalized_value"), shown.alias("public_id"), ingested_at.alias("first_ingested_at"), T.context_sensitivity(F.col("context")).alias("sensitivity")).dropDuplicates(["indicator_id"])
    mentions = good.select("mention_id", "indicator_id", "document_id", "source_family_id", "scope", "raw_form_hash", "context_excerpt_hash", F.col("observed").alias("observed_at"), available_at.alias("available_at")).dropDuplicates(["mention_id"])
    assertions = good.select(
        joined_id("assert", F.col("mention_id"), F.col("role"), F.col("context_excerpt_hash")).alias("assertion_id"), "indicator_id", "document_id", F.col("mention_id").alias("source_mention_id"), "role",
        F.lit("candidate").alias("verdict"), F.lit("claim").alias("evidence_type"), F.col("observed").alias("vendor_first_seen"), F.col("published_at").alias("first_public_at"), available_at.alias("available_at"),
        *[F.lit(None).cast("double").alias(c) for c in ("source_confidence", "extraction_confidence", "role_confidence")], "context_excerpt_hash", F.lit("pending").alias("reviewer_status"),
    ).dropDuplicates(["assertion_id"])
    return IndicatorTables(indicators, mentions, assertions, rows.where("reason is not null").select("document_id", "scope", "value", "reason"))


# -- search results and screening ---------------------------------------------------------------

def search_candidates(results: DataFrame, allowlist: DataFrame, query: str = "query_id", pos: str = "pos", fallback: bool = True) -> DataFrame:
    """results (query_id, pos, url, ...) with canonical url, publisher, rank within the query and
    status: invalid_url, outside_allowlist, duplicate or candidate (the first of its url)."""
    told = results.withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy(pos))).withColumn("canonical", T.canonical_url(F.col("url"), fallback))
    hosts = told.select("canonical").distinct().withColumn("tail", F.explode(T.host_tails(T.url_host(F.col("canonical")))))
    names = allowlist.select(F.lower(F.regexp_replace(T.strip(F.col("domain")), r"^\.+|\.+$", "")).alias("tail")).distinct()
    allowed = hosts.join(names, "tail", "left_semi").select("canonical").distinct().withColumn("allowed", F.lit(True))
    told = told.join(allowed, "canonical", "left")
    gate = F.when(F.col("canonical").isNull(), "invalid_url").when(F.col("allowed").isNull(), "outside_allowlist").otherwise("candidate")
    told = told.withColumn("_gate", gate)
    # only candidates are numbered; others, among them all addresses without a canonical form, are spread
    spread = F.when(F.col("_gate") != "candidate", F.xxhash64(query, pos))
    nth = F.row_number().over(Window.partitionBy("canonical", "_gate", spread).orderBy(query, pos))
    status = F.when((F.col("_gate") == "candidate") & (nth > 1), "duplicate").otherwise(F.col("_gate"))
    told = told.withColumn("status", status).withColumn("publisher", T.url_host(F.col("canonical")))
    return told.withColumn("candidate_id", F.when(F.col("status") == "candidate", F.concat(F.lit("cti-candidate-"), F.substring(sha256_text(F.col("canonical")), 1, 16)))).drop("allowed", "_gate")


def search_funnel(told: DataFrame, by: list[str]) -> DataFrame:
    """Counts by outcome with subtotals over `by`."""
    n = lambda s: F.count_if(F.col("status") == s)
    return told.rollup(*by).agg(F.count("*").alias("results"), n("candidate").alias("candidates"), n("duplicate").alias("duplicates"), n("outside_allowlist").alias("outside"), n("invalid_url").alias("invalid"))


def apply_screening(candidates: DataFrame, decisions: DataFrame) -> DataFrame:
    """candidates with decision and reason: undecided, conflicting_decisions or null; decisions on
    unknown candidates come as rows of their own with reason unknown_candidate."""
    each = decisions.groupBy("candidate_id").agg(F.min("decision").alias("decision"), F.count("*").alias("n"))
    told = candidates.join(each, "candidate_id", "full")
    known = candidates.select("candidate_id", F.lit(True).alias("known")).distinct()
    told = told.join(known, "candidate_id", "left")
    reason = F.when(F.col("known").isNull(), "unknown_candidate").when(F.col("n") > 1, "conflicting_decisions").when(F.col("decision").isNull(), "undecided")
    return told.withColumn("reason", reason).withColumn("included", F.col("reason").isNull() & (F.col("decision") == "include")).drop("n", "known")


def expand_terms(terms: DataFrame, names: DataFrame, placeholder: str = "{name}") -> DataFrame:
    """terms (term_pos, term) with the placeholder replaced by each of names (name_pos, name,
    priority, 3 if null), first occurrence kept, in order of term, priority and name."""
    wanted = names.select("name", "name_pos", F.coalesce("priority", F.lit(3)).alias("priority"))
    plain = terms.where(~F.col("term").contains(placeholder)).select("term_pos", F.col("term").alias("query"), F.lit(0).alias("priority"), F.lit(0).alias("name_pos"))
    # names are a watch list, so each term meets them all
    filled = terms.where(F.col("term").contains(placeholder)).join(wanted, F.lit(True)).select("term_pos", F.replace("term", F.lit(placeholder), F.col("name")).alias("query"), "priority", "name_pos")
    nth = F.row_number().over(Window.partitionBy("query").orderBy("term_pos", "priority", "name_pos"))
    return plain.unionByName(filled).withColumn("_n", nth).where("_n = 1").drop("_n")


def search_protocols(rows: DataFrame) -> DataFrame:
    """rows (name, version, queries, allowlist, acquisition_mode, source_access_class) with a content id:
    the same protocol in another order of its lists has the same id. reason: queries_missing,
    allowlist_missing."""
    lists = {c: F.array_join(F.array_sort(F.array_distinct(c)), "\n") for c in ("queries", "allowlist")}
    ident = json_id("search-protocol", n=16, **lists, **{c: F.col(c) for c in ("name", "version", "acquisition_mode", "source_access_class")})
    reason = F.when(F.size("queries") <= 0, "queries_missing").when(F.size("allowlist") <= 0, "allowlist_missing")
    return rows.withColumn("search_protocol_id", ident).withColumn("reason", reason)
