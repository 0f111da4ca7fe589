"""Latest records, sketches and addresses against plain Python."""

import ipaddress
import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from infratrace.functions import text as T
from infratrace.operators import asof, corpus

T0 = datetime(2026, 1, 1)


def test_as_of_against_plain_python(spark):
    rng = random.Random(3)
    when = lambda: None if rng.random() < 0.05 else T0 + timedelta(hours=rng.randint(0, 400))
    key = lambda: rng.choice(["hot", "hot", "hot", "a", None])
    rows = [(key(), when(), k % 50, "r") for k in range(300)]
    records = [(key(), when(), k % 60, k) for k in range(120)]
    left = spark.createDataFrame(rows, "k string, at timestamp, n int, record_ string")
    right = spark.createDataFrame(records, "k string, at timestamp, n int, value int")

    def plain(k, at):
        best = [r for r in records if k is not None and at is not None and r[0] == k and r[1] is not None and r[1] <= at]
        return max(best, key=lambda r: (r[1], r[2]))[1:3] if best else None

    want = sorted((k, at, n, plain(k, at)) for k, at, n, _ in rows if k is not None and at is not None)
    for bucket in (3600 * 7, 3600 * 24 * 365):
        got = asof.as_of(left, right, ["k"], "at", "at", "n", bucket=bucket).collect()
        assert len(got) == len(rows)
        assert sorted((r["k"], r["at"], r["n"], r["record"] and (r["record"]["at"], r["record"]["n"])) for r in got if r["k"] is not None and r["at"] is not None) == want
        assert all(r["record"] is None for r in got if r["k"] is None or r["at"] is None)
    none = asof.as_of(left, right.limit(0), ["k"], "at", "at", "n")
    assert none.where("record is not null").count() == 0 and none.count() == 300


def test_sketches_are_merged(spark):
    claims = spark.createDataFrame([(k % 2, k % 7, f"d{k}") for k in range(4000)], "g int, day int, document_id string")
    members = claims.select("document_id", F.expr("concat('f', cast(substring(document_id, 2) as int) % 1500)").alias("source_family_id")).where("document_id <> 'd0'")
    told = {r["g"]: r for r in corpus.estimated_sources(corpus.family_sketches(claims, members, ["g"], ["day"]), ["g"]).collect()}
    assert told[0]["claims"] == 1999 and told[1]["claims"] == 2000
    assert all(abs(r["estimated_sources"] - 750) <= 4 * r["relative_error"] * 750 for r in told.values())


def test_addresses_as_the_standard_library_has_them(spark):
    rng = random.Random(1)
    values = ["::", "::1", "1::", "::ffff:8.8.8.8", "::ffff:10.0.0.1", "fe80::1%eth0", "fe80::1%", "fe80::1%a%b", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "1::2::3", ":::", "1:2:3:4:5:6:7:8:9", "12345::", "g::"]
    values += ["2001:db8::1", "2002::1", "2001:20::5", "64:ff9b:1::9", "64:ff9b::8.8.8.8", "::1.2.3", "1.2.3.4::", "::256.1.1.1", "::01.2.3.4", "a:b", ":", "", "1:2:3:4:5:6:1.2.3.4", "1:2:3:4:5:6:7:1.2.3.4", "::FFFF:1.1.1.1", "8.8.8.8", "10.1.1.1", "192.0.0.9", "x"]
    for _ in range(1500):
        a = list(str(ipaddress.IPv6Address(rng.getrandbits(128) & rng.choice([(1 << 128) - 1, (1 << 64) - 1, 0xFFFF << 112 | 0xFF]) | rng.choice([0, 0x20010DB8 << 96, 0x2001 << 112, 0xFC << 120, 0xFFFF << 32]))))
        for _ in range(rng.choice([0, 0, 1, 2])):
            a[rng.randrange(len(a))] = rng.choice(":0f.%g")
        values.append("".join(a))

    def library(v):
        try:
            return True, ipaddress.ip_address(v).is_global
        except ValueError:
            return False, None

    df = spark.createDataFrame([(v,) for v in values], "v string").select("v", T.is_ip(F.col("v")).alias("ip"), T.ip_is_global(F.col("v")).alias("open"))
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
    wrong = [r for r in df.collect() if (r["ip"], r["open"]) != library(r["v"])]
    assert not wrong
