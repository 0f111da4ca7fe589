"""Deterministic content ids as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sha256_text(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def joined_id(prefix: str, *parts: Column, n: int = 20) -> Column:
    """prefix- and the first n hex digits of sha256 over the parts joined by |. Null parts are empty."""
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.concat(F.lit(f"{prefix}-"), F.substring(sha256_text(text), 1, n))


def json_text(**fields: Column) -> Column:
    """Canonical JSON: keys in order, nulls kept. Pass times through iso_text and doubles as text."""
    row = F.struct(*[fields[k].alias(k) for k in sorted(fields)])
    return F.to_json(row, {"ignoreNullFields": "false"})


def json_id(prefix: str, n: int = 20, **fields: Column) -> Column:
    return F.concat(F.lit(f"{prefix}-"), F.substring(sha256_text(json_text(**fields)), 1, n))


def iso_text(time: Column) -> Column:
    """ISO 8601 with +00:00; microseconds only when there are any."""
    t = time.cast("timestamp_ntz")
    whole = F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss")
    return F.concat(whole, F.when(F.date_format(t, "SSSSSS") != "000000", F.date_format(t, ".SSSSSS")).otherwise(""), F.lit("+00:00"))


def group_hash(rows: DataFrame, by: list[str], row_hash: Column, name: str) -> DataFrame:
    """by and a hash over the hex hashes of a group's rows, whatever their order. Hashes are first joined
    within the 256 values of their first byte, so no row holds a whole group."""
    part = lambda of, c: sha256_text(F.array_join(F.array_sort(F.collect_list(of)), "|")).alias(c)
    each = rows.select(*by, row_hash.alias("_h")).groupBy(*by, F.substring("_h", 1, 2).alias("_b")).agg(part("_h", "_p"))
    return each.groupBy(*by).agg(part(F.concat("_b", "_p"), name))
