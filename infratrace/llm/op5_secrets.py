"""Secrets in whole texts, told apart by who else has them.

Every text is searched for assigned values (`assign`), access keys (`access`), long hexadecimal runs
(`hex`) and, beyond those, long mixed runs of letters and digits (`token`). The candidates' hashes are
counted over the whole corpus by different repositories and different owners. A value that MIN_OWNERS
owners and MIN_REPOS repositories or more have is a widely copied `example` (one repository of many
owners is no copying); one that stays with few and looks random is `live`; anything else is `weak`. The first three kinds are always reported; a `token` span is added
only where it is live and no other span covers it.

Only candidates are shuffled, never texts. Hashes are reduced to one a repository and one an owner before
they are counted, so a value that is everywhere shrinks before it moves; the counts are joined back to the candidates
as sizes allow, and a common value's rows can be split by the join.

Positions are code points, end exclusive. Null texts are empty. A null owner or repository is one
owner or repository of its own. Rows that repeat are separate documents with equal spans. An empty
table gives an empty result. Spans of a text are gathered by row, so their number is bounded by it.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StringType, StructType

from .common import bound_batches, source_order, stash, table

KINDS = ("assign", "access", "hex", "token")
#: Owners and repositories that a widely copied value has at least.
MIN_OWNERS, MIN_REPOS = 3, 3
#: Characters of a token at least, and its entropy in bits a character.
TOKEN_CHARS, TOKEN_BITS = 20, 3.0
#: The base patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
TOKEN = re.compile(rf"[A-Za-z0-9+/_.=-]{{{TOKEN_CHARS},}}")
PLACEHOLDERS = re.compile(r"example|sample|changeme|placeholder|dummy|your|xxxx|1234567|abcdef|test", re.IGNORECASE)
_RUN = bytes(120 if chr(b) in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-" else 32 for b in range(256))


def entropy(value: str) -> float:
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


def looks_random(value: str) -> bool:
    return not PLACEHOLDERS.search(value) and entropy(value) >= min(TOKEN_BITS, math.log2(max(2, len(value))) - 0.5) and any(c.isdigit() for c in value)


def candidates(text: str | None) -> list[tuple[str, int, int, str, bool]]:
    """(kind, start, end, value, looks random) by start, then kind as listed."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    low = raw.lower()
    found = []
    if any(w in low for w in WORDS):
        found += [("assign", *m.span(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if b"AKIA" in raw:
        found += [("access", *m.span(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    if b"x" * TOKEN_CHARS in raw.translate(_RUN):
        found += [("hex", *m.span(), m[0]) for m in HEX.finditer(text) if len(m[0]) >= 24]
        starts, ends = [], []  # what is taken, without overlaps
        for a, b in sorted((a, b) for _, a, b, _ in found):
            if ends and a <= ends[-1]:
                ends[-1] = max(b, ends[-1])
            else:
                starts.append(a)
                ends.append(b)
        for m in TOKEN.finditer(text):
            a, b = m.span()
            before = bisect_left(starts, b) - 1
            if any(c.isdigit() for c in m[0]) and any(c.isalpha() for c in m[0]) and (before < 0 or ends[before] <= a):
                found.append(("token", a, b, m[0]))
    return [(k, a, b, v, looks_random(v)) for k, a, b, v in sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))]


SPAN = StructType().add("kind", StringType()).add("start", IntegerType()).add("end", IntegerType()).add("value", LongType()).add("random", BooleanType())


@F.pandas_udf(ArrayType(SPAN))
def _candidates(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield pd.Series([[{"kind": k, "start": a, "end": b, "value": int.from_bytes(hashlib.blake2b(v.encode(), digest_size=8).digest(), "little", signed=True), "random": r} for k, a, b, v, r in candidates(x)] for x in texts], dtype=object)


def ownership(found: DataFrame) -> DataFrame:
    """value, n_repos, n_owners over all candidates (columns value, repo, owner): different repositories
    and different owners, each reduced by value and name before values are counted."""
    by_repo = found.select("value", "repo").distinct().groupBy("value").agg(F.count("*").alias("n_repos"))
    by_owner = found.select("value", "owner").distinct().groupBy("value").agg(F.count("*").alias("n_owners"))
    return by_repo.join(by_owner, "value")


def find_secrets(docs: DataFrame, text: str = "text", repo: Column | None = None, owner: Column | None = None, keep: dict[str, Column] | None = None, min_owners: int = MIN_OWNERS, min_repos: int = MIN_REPOS) -> DataFrame:
    """One row for each of docs: the `keep` columns and secrets, an array of
    (start, place of the kind, kind, end, label, n_repos, n_owners) in the order of the text."""
    bound_batches(docs.sparkSession)
    name = lambda c: F.coalesce((F.lit("") if c is None else c).cast("string"), F.lit("\0null"))
    keep = keep if keep is not None else {"doc_id": F.col("doc_id")}
    # a column of one struct keeps the names of `keep` apart from those used here
    marked = stash(docs.select(source_order().alias("nth"), F.struct(*[c.alias(k) for k, c in keep.items()]).alias("kept"), name(repo).alias("repo"), name(owner).alias("owner"), _candidates(F.col(text)).alias("found")), "candidates")
    each = marked.select("nth", "repo", "owner", F.explode("found").alias("s")).select("nth", "repo", "owner", "s.*")
    counts = stash(ownership(each), "ownership")
    label = F.when((F.col("n_owners") >= min_owners) & (F.col("n_repos") >= min_repos), "example").when(F.col("random"), "live").otherwise("weak")
    place = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int")
    told = each.join(counts, "value").withColumn("label", label).where((F.col("kind") != "token") | (F.col("label") == "live"))
    spans = told.groupBy("nth").agg(F.array_sort(F.collect_list(F.struct("start", place.alias("place"), "kind", "end", "label", "n_repos", "n_owners"))).alias("secrets"))
    empty = F.array().cast(spans.schema["secrets"].dataType)
    return marked.select("nth", "kept").join(spans, "nth", "left").select("kept.*", F.coalesce("secrets", empty).alias("secrets"))


def masked(t: Column, spans: Column, mask: str) -> Column:
    """A text with its spans replaced by `mask`, overlapping ones once; a null or empty array leaves it
    as it is."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("upto"))

    def step(acc: Column, s: Column) -> Column:
        begun = s["start"] >= acc["upto"]
        kept = F.concat(acc["out"], t.substr(acc["upto"] + 1, s["start"] - acc["upto"]), F.lit(mask))
        return F.struct(F.when(begun, kept).otherwise(acc["out"]).alias("out"), F.greatest(acc["upto"], s["end"]).alias("upto"))

    folded = F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], t.substr(acc["upto"] + 1, F.length(t))))
    return F.when(F.coalesce(F.size(spans), F.lit(0)) > 0, folded).otherwise(t)


def span_text(secrets: Column, base_only: bool = False) -> Column:
    """kind:start:end of the spans, comma-joined."""
    chosen = F.filter(secrets, lambda s: s["kind"] != "token") if base_only else secrets
    return F.array_join(F.transform(chosen, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_where(secrets: Column, field: str, value: str) -> Column:
    return F.size(F.filter(secrets, lambda s: s[field] == value)).cast("long")


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document stands for a repository of its own and its source for the owner."""
    docs = table(spark, sf_dir, "documents")
    found = find_secrets(docs, repo=F.col("doc_id"), owner=F.col("source"))
    s = F.col("secrets")
    return found.select(
        "doc_id",
        *[count_where(s, "kind", k).alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(span_text(s, base_only=True).cast("binary"), 256).alias("base_sha256"),
        span_text(s).alias("spans"),
        *[count_where(s, "label", k).alias(f"n_{k}") for k in ("live", "example", "weak")],
    )
