from urllib.parse import parse_qsl, urlencode, urlsplit, urlunsplit

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from infratrace.functions import html
from infratrace.functions import text as T
from infratrace.functions.ids import iso_text, joined_id, json_id
from infratrace.operators import mining


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_refang_and_defang(spark):
    rows = [(" Relay[.]Example[.]ORG ",), ("hxxps://a[dot]b[.]com/x",), ("me[at]x{.}org",), ("1(.)2( . )3[.]4",), ("plain.org",)]
    got = values(spark, rows, "v string", T.refang(F.col("v")), T.is_defanged(F.col("v")))
    assert got == [("Relay.Example.ORG", True), ("https://a.b.com/x", True), ("me@x.org", True), ("1.2.3.4", True), ("plain.org", False)]
    got = values(spark, [("http://a.b/c.d",), ("x@y.org",), ("1.2.3.4",)], "v string", T.defang(F.col("v")))
    assert [g[0] for g in got] == ["hxxp://a[.]b/c[.]d", "x[@]y[.]org", "1[.]2[.]3[.]4"]


def test_normalize(spark):
    rows = [("domain", "Relay[.]Example[.]ORG."), ("cert", "AA:" * 31 + "AA"), ("url", "hxxps://Relay[.]Example[.]ORG/Path"), ("url", "evil.org/x"), ("email", "Me.X@Host.ORG"), ("hash_md5", "AB" * 16), ("ja4", " T13D "), ("mutex", "Keep Me")]
    got = [g[0] for g in values(spark, rows, "s string, v string", T.normalize(F.col("s"), F.col("v")))]
    assert got == ["relay.example.org", "a" * 64, "https://relay.example.org/Path", "http://evil.org/x", "Me.X@host.org", "ab" * 16, "t13d", "Keep Me"]


@pytest.mark.parametrize("scope, good, bad", [
    ("ip", ["1.2.3.4", "2001:db8::1"], ["1.2.3.256", "1.2.3", "2001:::1", ""]), ("domain", ["a.example.org"], ["localhost", "1.2.3.4", "-a.org", " a.org"]), ("url", ["https://a.org/x?y", "ftp://1.2.3.4:21/"], ["mailto:a@b.c", "http://", "http://a b.org"]),
    ("cert", ["a" * 40, "A" * 64], ["a" * 41]), ("jarm", ["z" * 62], ["z" * 61]), ("hash_sha256", ["0" * 64], ["g" * 64]), ("email", ["a@b.co"], ["a@b"]), ("filepath", ["C:\\x", "/etc/x", "%TEMP%\\a"], ["etc"]),
    ("spki", ["b" * 64], ["b"]), ("port_protocol", ["tcp/443", "65535/udp"], ["tcp/0", "tcp/65536", "icmp/1"]), ("ssh_key", ["ssh-rsa " + "A" * 24], ["ssh-dss " + "A" * 24]), ("nonsense", [], ["x"]),
])
def test_valid(spark, scope, good, bad):
    rows = [(scope, v) for v in good + bad]
    got = [g[0] for g in values(spark, rows, "s string, v string", T.valid(F.col("s"), F.col("v")))]
    assert got == [True] * len(good) + [False] * len(bad)


def test_addresses_that_touch_are_all_found(spark):
    docs = spark.createDataFrame([("a", "seen 9.1.1.1 9.2.2.2,9.3.3.3 now"), ("b", "9.1.1.1.1 9.2.2.2. 9.3.3.3")], "document_id string, text string")
    got = mining.mine(docs, ("ip",)).orderBy("document_id", "pos").collect()
    assert [(r["document_id"], r["raw_form"]) for r in got] == [("a", "9.1.1.1"), ("a", "9.2.2.2"), ("a", "9.3.3.3"), ("b", "9.3.3.3")]


def test_domain_block_reason(spark):
    rows = ["relay.example.org", "relay.badinfra.net", "payload.exe", "localhost", "", "*.lumen.com", "a..b", "trojan.x.net", None]
    got = [g[0] for g in values(spark, [(r,) for r in rows], "v string", T.domain_block_reason(F.col("v")))]
    assert got == ["broad_or_reference_domain", "", "filelike_domain", "single_label_domain", "empty_domain", "broad_or_reference_domain", "invalid_domain_syntax", "malware_label_domain", "empty_domain"]


def test_global_addresses(spark):
    rows = ["8.8.8.8", "192.168.18.111", "192.0.0.9", "224.0.0.1", "100.64.1.1", "not an ip", "2001:4860::1", "::1", "fe80::1"]
    got = [g[0] for g in values(spark, [(r,) for r in rows], "v string", T.ip_is_global(F.col("v")))]
    assert got == [True, False, True, True, False, None, True, False, False]


def replay(url):
    parts = urlsplit(url.strip())
    host = (parts.hostname or "").lower()
    port = f":{parts.port}" if parts.port else ""
    return urlunsplit((parts.scheme.lower(), host + port, parts.path or "/", urlencode(sorted(parse_qsl(parts.query, keep_blank_values=True))), ""))


def test_canonical_url(spark):
    rows = ["HTTPS://Example.org/a?b=2&a=1#part", "https://example.org", "http://u:p@X.org:8080/p?q", "ftp://x.org/", "broken", "http://[2001:DB8::1]:80/x", "http://x.org/?a=~x&b=*", None]
    got = [g[0] for g in values(spark, [(r,) for r in rows], "v string", T.canonical_url(F.col("v")))]
    assert got == ["https://example.org/a?a=1&b=2", "https://example.org/", "http://x.org:8080/p?q=", None, None, "http://[2001:db8::1]:80/x", "http://x.org/?a=~x&b=%2A", None]


@settings(max_examples=6, deadline=None)
@given(st.lists(st.text(alphabet="abAZ09=&%+._~*é -", max_size=14), min_size=30, max_size=60))
def test_canonical_url_like_the_standard_library(spark, queries):
    urls = [f"https://Host.example/p{i}?{q.strip()}" for i, q in enumerate(queries)]
    got = [g[0] for g in values(spark, [(u,) for u in urls], "v string", T.canonical_url(F.col("v")))]
    assert got == [replay(u) for u in urls]


def test_publication_dates(spark):
    rows = ["2026-01-01", "2026-01", "2026", "2026-01-01T10:00:00Z", "2026-01-01T10:00:00+02:00", "2026-01-01T10:00:00", "January", "", None]
    got = values(spark, [(r,) for r in rows], "v string", T.publication_precision(F.col("v")), T.publication_timezone(F.col("v"), F.lit(None).cast("string")), iso_text(T.publication_time(F.col("v"))))
    assert got == [("date", "unknown", None), ("month", "unknown", None), ("year", "unknown", None), ("exact_timestamp", "UTC", "2026-01-01T10:00:00+00:00"), ("exact_timestamp", "+0200", "2026-01-01T08:00:00+00:00"),
                   ("unknown", "unknown", None), ("unknown", "unknown", None), ("unknown", "unknown", None), ("unknown", "unknown", None)]


def test_ids(spark):
    import hashlib
    import json

    row = values(spark, [("a", "é\"\n", None, 3)], "a string, b string, n string, i int", joined_id("ioc", F.col("a"), F.col("b")), json_id("x", z=F.col("b"), y=F.col("n"), k=F.col("i")))[0]
    assert row[0] == "ioc-" + hashlib.sha256("a|é\"\n".encode()).hexdigest()[:20]
    text = json.dumps({"z": "é\"\n", "y": None, "k": 3}, sort_keys=True, ensure_ascii=False, separators=(",", ":"))
    assert row[1] == "x-" + hashlib.sha256(text.encode()).hexdigest()[:20]


def test_readable_text(spark):
    page = "<html><style>s{}</style><nav>menu</nav><main><p>Main  text</p><script>x()</script></main><noscript>no</noscript><footer>foot</footer></html>"
    rows = [(1, page), (2, "<p>all <b>of</b> it"), (3, "just text"), (4, ""), (5, None)]
    got = {r["id"]: (r["text"], r["extractor"]) for r in html.main_text(spark.createDataFrame(rows, "id int, html string")).collect()}
    assert got == {1: ("Main  text", "html_main"), 2: ("all\nof\nit", "html_all"), 3: ("just text", "html_all"), 4: ("", "raw"), 5: ("", "raw")}


def test_readable_text_of_odd_pages():
    cases = {
        "<p>a</p><template><main></template><p>b</p>": ("a\nb", "html_all"),  # a main element that is hidden is none
        "<main><svg><article>x</article></svg>y</main>z": ("y", "html_main"),
        "</main></script><p>a</p>": ("a", "html_all"),  # nothing open, nothing closed
        "<article>one<main>two</main>three</article>four": ("one\ntwo\nthree", "html_main"),
        "<script>only()</script>": ("<script>only()</script>", "raw"),
        "<p> a  b </p>\n<p>\tc</p>": ("a  b\nc", "html_all"),
        "<noscript>x": ("<noscript>x", "raw"),
        None: ("", "raw"),
    }
    assert {k: html.readable(k) for k in cases} == cases


def test_pages_that_are_too_long(spark):
    from infratrace.operators import mining

    pages = spark.createDataFrame([(1, "<p>see 9.8.7.6 and 9.8.7.6</p>", None), (2, "<p>" + "x" * 300 + "</p>", None)], "document_id int, html string, published_at timestamp")
    got = mining.extract_and_verify(pages, F.lit("2026-01-01").cast("timestamp"), ("ip",), ipv6=False, max_chars=200).collect()
    assert sorted((r["document_id"], r["status"], r["text_extractor"]) for r in got) == [("1", "format_rejected", "html_all"), ("1", "format_rejected", "html_all"), ("2", "document_too_long", "html_all")]
