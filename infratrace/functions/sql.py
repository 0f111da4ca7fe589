"""The library's functions by name in SQL.

Native expressions become SQL functions through `expr` text where Spark can hold them as such; only
what needs Python is registered as Arrow functions.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from . import html, text

#: Temporary SQL functions: signature and body.
FUNCTIONS = {
    "wilson_low(n double, d double)": "case when d = 0 then 0.0D else greatest(0.0D, (n / d + 3.8414588206941227D / (2 * d) - 1.959963984540054D * sqrt((n / d * (1 - n / d) + 3.8414588206941227D / (4 * d)) / d)) / (1 + 3.8414588206941227D / d)) end",
    "wilson_high(n double, d double)": "case when d = 0 then 1.0D else least(1.0D, (n / d + 3.8414588206941227D / (2 * d) + 1.959963984540054D * sqrt((n / d * (1 - n / d) + 3.8414588206941227D / (4 * d)) / d)) / (1 + 3.8414588206941227D / d)) end",
    "feature_lift(support double, prevalence double)": "support / greatest(prevalence, 1e-9D)",
    "canonical_value(v string)": r"nullif(trim(regexp_replace(lower(v), '(?U)\\s+', ' ')), '')",
    "joined_id(prefix string, parts array<string>)": "concat(prefix, '-', substring(sha2(array_join(transform(parts, x -> coalesce(x, '')), '|'), 256), 1, 20))",
    "defang(v string)": "case when instr(v, '://') > 0 then concat(regexp_replace(substring(v, 1, instr(v, '://') + 2), '^http(s?)://', 'hxxp$1://'), replace(replace(substring(v, instr(v, '://') + 3), '@', '[@]'), '.', '[.]')) else replace(replace(v, '@', '[@]'), '.', '[.]') end",
}


def _once(value: str, body: str) -> str:
    """body, with the value as x, worked out once however often the body names it."""
    return f"element_at(transform(array({value}), x -> {body}), 1)"


def _replaced(value: str, steps) -> str:
    for pattern, into in steps:
        value = f"regexp_replace({value}, r'{pattern}', '{into}')"
    return value


_STRIPPED = r"regexp_replace(v, r'(?U)^\s+|\s+$', '')"
_HEX = {"ja3": "32", "hash_md5": "32", "hash_sha1": "40", "hash_sha256": "64", "spki": "64"}
_FORMS = {
    "ip": text.IPV4, "email": text.EMAIL, "mutex": text.MUTEX, "filepath": text.FILEPATH, "jarm": "(?i)^[0-9a-z]{62}$", "cert": "(?i)^([0-9a-f]{40}|[0-9a-f]{64})$", "ja4": "(?i)^[a-z0-9_]{10,128}$",
    "ssh_key": r"^ssh-(?:rsa|ed25519) [A-Za-z0-9+/=]{20,}$",
} | {scope: f"^[0-9a-fA-F]{{{n}}}$" for scope, n in _HEX.items()}
#: Functions that name others come after them.
FUNCTIONS |= {
    "refang(v string)": _replaced(_STRIPPED, text.REFANG * 3),
    "is_defanged(v string)": f"refang(v) <> {_STRIPPED}",
    "normalize_indicator(scope string, v string)": _once("refang(v)", r"""case when scope in ('hash_md5', 'hash_sha1', 'hash_sha256', 'ja3', 'jarm') then lower(x) when scope = 'cert' then lower(replace(x, ':', ''))
      when scope = 'domain' then lower(regexp_replace(x, r'\.+$', '')) when scope = 'email' then concat(regexp_extract(x, '^(.*@)', 1), lower(regexp_extract(x, '([^@]*)$', 1)))
      when scope = 'url' then concat(regexp_extract(x, r'^([A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#]*@)?)', 1), lower(regexp_extract(x, r'^(?:[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#]*@)?)([^/?#@]*)', 1)), regexp_replace(x, r'^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*', ''))
      else x end"""),
    "valid_indicator(scope string, v string)": _once("v", "coalesce(x <> '' and case " + " ".join(f"when scope = '{scope}' then x rlike r'{form}'" for scope, form in _FORMS.items()) + f" when scope = 'domain' then x rlike r'{text.DOMAIN}' and not x rlike r'{text.IPV4}' else false end, false)"),
    "publication_precision(v string)": r"""case when v is null or trim(v) = '' then 'unknown' when trim(v) rlike r'^\d{4}-\d{2}-\d{2}$' then 'date' when trim(v) rlike r'^\d{4}-\d{2}$' then 'month' when trim(v) rlike r'^\d{4}$' then 'year'
      when trim(v) rlike r'^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?(Z|[+-]\d{2}:?\d{2})$' and try_cast(trim(v) as timestamp) is not null then 'exact_timestamp' else 'unknown' end""",
}


def register(spark: SparkSession) -> None:
    """Make the functions known to spark.sql in this session."""
    for signature, body in FUNCTIONS.items():
        spark.sql(f"create or replace temporary function {signature} return {body}")
    spark.udf.register("ipv6_valid", text.ipv6_valid)
    spark.udf.register("ipv6_is_global", text.ipv6_global)
    spark.udf.register("canonical_url_by_library", text.url_by_library)
    spark.udf.register("readable_text", html.readable_text)
