"""BPE, WARC, token files."""

import gzip
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from infratrace.llm import op7_bpe, op9_warc, op10_token_files

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ALPHABET = "aab e theing  \n\t'sre12é漢🙂.,!\xa0\x85\x1c​　́-_ABCΣİß½"
SPECIAL = ["", "   ", "\n \n", "a\n  b", "a \n", "a\n ", "x" * 5000, "ab" * 3000, " " * 500, "I'll don't we've", "'" * 30, "\x00\x01", "<|endoftext|>", "a<|endoftext|> b <|startoftext|>x", "Σ ΑΣ", "é ́a"]


def texts(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 50))) for _ in range(n)] + SPECIAL


def library(path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def packed(ids, kind="<u4"):
    return np.array(ids, dtype=kind).tobytes()


# -- 7 BPE ----------------------------------------------------------------------------------------

def test_bpe_like_the_library():
    t, v, xs = library(op7_bpe.PATH), op7_bpe.Vocabulary(op7_bpe.PATH), texts(5000, 1)
    want = [e.ids for e in t.encode_batch(xs, add_special_tokens=False)]
    assert v.encode_batch(xs) == [packed(w) for w in want]
    assert v.encode_batch(xs) == [packed(w) for w in want]  # from what is remembered
    for w in want:
        assert v.decode(packed(w)) == t.decode(w, skip_special_tokens=False)
    assert v.decode(packed([191, 100])) == t.decode([191, 100], skip_special_tokens=False)


def test_bpe_rows(spark):
    rows = [(1, "the cat"), (2, None), (3, ""), (1, "the cat")]
    df = spark.createDataFrame([r + (None, None, None) for r in rows], DOCS).withColumn("token_ids", F.lit("clash"))
    got = op7_bpe.encode_documents(df, decoded="decoded")
    assert got.columns.count("token_ids") == 1 and got.count() == 4
    by = {r["doc_id"]: r for r in got.collect()}
    assert by[1]["decoded"] == "the cat" and by[2]["token_ids"] == b"" and by[2]["decoded"] == "" and by[3]["decoded"] == ""
    again = op7_bpe.decode_documents(op7_bpe.encode_documents(df)).where("doc_id = 1").collect()
    assert {r["decoded"] for r in again} == {"the cat"}
    assert op7_bpe.encode_documents(df.limit(0)).count() == 0


# -- 9 WARC ---------------------------------------------------------------------------------------

def test_arc_versions():
    body = b"HTTP/1.0 200 OK\r\n\r\n<html>\n\nWARC/1.1\r\n\r\n"
    for version in (1, 2):
        data = op9_warc.arc_header("x.arc", version, "20010203040506") + op9_warc.arc_record("http://a.b/c d", "1.2.3.4", "20010203040506", "text/html", body, version) + b"\n" + op9_warc.arc_record("dns:a.b", "1.2.3.4", "200102030405", "text/dns", b"x", version)
        got = list(op9_warc.parse_arc(data))
        assert got[0][0]["version"] == str(version) and got[1][1] == body and got[1][0]["URL"] == "http://a.b/c%20d" and got[2][1] == b"x"
        assert len(got[1][0]) == (5 if version == 1 else 10)
    assert op9_warc.iso_time("20010203040506") == "2001-02-03T04:05:06Z" and op9_warc.iso_time("200102030405") == "2001-02-03T04:05:00Z" and op9_warc.iso_time("x").startswith("1970")
    with pytest.raises(ValueError, match="declares"):
        list(op9_warc.parse_arc(data[:-2]))
    with pytest.raises(ValueError, match="does not end"):
        list(op9_warc.parse_arc(data[:-5]))


def test_warc_round_trip(spark, tmp_path):
    pages = [(4, "http://a/4", "same"), (2, "http://a/2", "same"), (9, "http://a/9", "é\r\n\r\nWARC/1.1\r\n\r\n"), (1, None, None), (3, "http://a b/3", ""), (None, "http://a/n", "same"), (2, "http://a/2", "same"), (7, "http://a/7", "x" * 300_000)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("type", F.lit("clash"))
    op9_warc.pages_to_warc(df, f"file://{tmp_path}/warc", file_bytes=200)
    back = op9_warc.read_warc(spark, f"file://{tmp_path}/warc")
    rows = back.where("record_type <> 'warcinfo'").collect()
    assert len(rows) == len(pages) and all(r["digest_ok"] for r in rows) and len({r["record_id"] for r in rows}) == len(pages)
    by = {}
    for r in rows:
        by.setdefault(r["page_id"], r)
    assert (by[2]["record_type"], by[2]["payload"], by[2]["refers_to"]) == ("response", b"same", None)
    assert (by[4]["record_type"], by[4]["payload"], by[4]["refers_to"], by[4]["payload_bytes"], by[4]["payload_digest"]) == ("revisit", None, 2, 4, op9_warc.base32(b"same"))
    assert by[None]["refers_to"] == 2 and (by[1]["record_type"], by[3]["refers_to"], by[3]["payload_bytes"]) == ("response", 1, 0)
    assert by[9]["payload"].decode() == "é\r\n\r\nWARC/1.1\r\n\r\n" and by[7]["payload_bytes"] == 300_000 and by[1]["uri"] == "about:blank"
    assert back.where("record_type = 'warcinfo'").count() >= 1
    files = [len(f.read_bytes()) for f in (tmp_path / "warc").glob("part-*")]
    assert len(files) > 3 and sum(n > 2000 for n in files) == 1  # only the long record's
    op9_warc.pages_to_warc(df, f"file://{tmp_path}/large", min_bytes=5)
    assert op9_warc.read_warc(spark, f"file://{tmp_path}/large").where("record_type = 'revisit'").count() == 0
    op9_warc.pages_to_warc(df.limit(0), f"file://{tmp_path}/none")
    assert op9_warc.read_warc(spark, f"file://{tmp_path}/none").count() == 0
    assert gzip.decompress(gzip.compress(op9_warc.arc_header("x", 1, "20010203040506"))).startswith(b"filedesc://")


# -- 10 token files -------------------------------------------------------------------------------

def test_token_encoder_like_the_library():
    t, e, xs = library(op10_token_files.PATH), op10_token_files.Encoder(op10_token_files.PATH), texts(5000, 2)
    want = [packed(x.ids, e.dtype) for x in t.encode_batch(xs, add_special_tokens=False)]
    assert e.encode(xs) == want and e.encode(xs) == want


def test_token_files(spark, tmp_path):
    rows = [(i, f"text number {i} " * (i % 40)) for i in random.Random(1).sample(range(500), 200)] + [(1000, None), (None, "no id"), (3000, "x " * 5000), (7, "twice"), (7, "twice")]
    df = spark.createDataFrame([r + (None, None, None) for r in rows], DOCS).withColumn("range", F.lit("clash")).repartition(5)
    folder = f"file://{tmp_path}/tokens"
    op10_token_files.write_token_files(df, folder, length=64, batch=4, file_ids=500)
    got = op10_token_files.with_starts(op10_token_files.read_token_files(spark, folder)).collect()
    t = library(op10_token_files.PATH)
    want = sorted(((-1 if i is None else i, zlib.crc32(packed(t.encode(x or "", add_special_tokens=False).ids + [2]))) for i, x in rows))
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], zlib.crc32(r["ids"])) for r in got) == want
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    in_order = [-1 if r["doc_id"] is None else r["doc_id"] for r in sorted(got, key=lambda r: r["start"])]
    assert in_order == sorted(in_order)
    op10_token_files.write_token_files(df.limit(0), f"file://{tmp_path}/none")
    assert op10_token_files.read_token_files(spark, f"file://{tmp_path}/none").count() == 0


def test_sequences_are_found_without_a_copy(tmp_path):
    ids = np.arange(1000, dtype="<u2")
    path = tmp_path / "one"
    path.write_bytes(op10_token_files.stream(ids, [400, 600], [5, None], 64, 4, {"range": 0, "number": 3}) + b"\n")
    mapped = pa.memory_map(str(path))
    start, size = mapped.read_buffer(mapped.size()).address, mapped.size()
    mapped.seek(0)
    file = op10_token_files.TokenFile(mapped)
    assert len(file) == 16 and file.place == (0, 3)
    for k in (15, 0, 7, 3, 8):
        got, mask = file.sequence(k)
        assert start <= got.__array_interface__["data"][0] < start + size and start <= mask.buffers()[1].address < start + size
        want = ids[k * 64:(k + 1) * 64]
        assert got[:len(want)].tolist() == want.tolist() and mask.to_pylist() == [True] * len(want) + [False] * (64 - len(want))
    with pytest.raises(IndexError):
        file.sequence(16)
    mapped.seek(0)
    seen = [op10_token_files.fixed_view(b) for b in op10_token_files.sequences(mapped)]
    assert np.concatenate(seen).reshape(-1)[:1000].tolist() == ids.tolist()
    empty = op10_token_files.TokenFile(op10_token_files.stream(ids[:0], [], [], 64, 4, {"range": 0, "number": 0}))
    assert len(empty) == 0


def test_workers_forget(monkeypatch):
    monkeypatch.setattr(op7_bpe, "CACHE_BYTES", 20_000)
    monkeypatch.setattr(op7_bpe, "TRIE", 100)
    monkeypatch.setattr(op10_token_files, "CACHE_BYTES", 20_000)
    t, v, e = library(op7_bpe.PATH), op7_bpe.Vocabulary(op7_bpe.PATH), op10_token_files.Encoder(op10_token_files.PATH)
    rng = random.Random(3)
    long = "".join(rng.choice("abcdefgh漢é") for _ in range(50_000))
    for n in range(20):
        xs = [" ".join(f"{rng.choice('abcxyz')}{rng.randint(0, 10**6)}" for _ in range(40)) for _ in range(10)] + [long if n == 4 else "", f"a {long[:3000]} b"]
        assert v.encode_batch(xs) == [packed(w.ids) for w in t.encode_batch(xs, add_special_tokens=False)]
        e.encode(xs)
        assert v.held < 400_000 and max(map(len, v.words)) <= op7_bpe.LONG and max(map(len, v.pieces)) <= op7_bpe.LONG
        assert e.held < 400_000 and not any(len(x) > op10_token_files.LONG for x in [*e.known, *e.plain])
    v.forget()
    e.forget()
    assert not v.words and not v.pieces and not e.plain and v.held == e.held == 0


def test_arc_as_old_crawlers_wrote_it(spark):
    head = op9_warc.arc_header("old.arc", 1, "19990101000000")
    page = b"HTTP/1.0 200 OK\r\nX-Page-Id: not a number\r\n\r\n<p>old</p>"
    records = [op9_warc.arc_record("http://h/a", "1.2.3.4", "19990101000000", "text/html", page, 1).replace(b"http://h/a", b"http://h/a b  c"), op9_warc.arc_record("http://h/z", "1.2.3.4", "199901010000", "text/plain", b"bare", 1)]
    plain = head + b"".join(records)
    zipped = b"".join(gzip.compress(part) for part in (head, *records))
    for data in (plain, zipped):
        got = list(op9_warc.parse_arc(data))
        assert [f["URL"] for f, _ in got] == ["filedesc://old.arc", "http://h/a b  c", "http://h/z"] and [c for _, c in got[1:]] == [page, b"bare"]
    with pytest.raises(ValueError, match="gzip member"):
        list(op9_warc.parse_arc(zipped[:-4]))
    rows = op9_warc.warc_records(spark.createDataFrame([(zipped,)], "arc binary")).collect()
    assert [(r["type"], r["page_id"], r["uri"]) for r in rows] == [("warcinfo", None, "filedesc://old.arc"), ("response", None, "http://h/a b  c"), ("resource", None, "http://h/z")]


def test_record_ids_differ_by_corpus(spark):
    pages = spark.createDataFrame([(1, "http://h/1", "x")], "page_id long, url string, html string")
    ids = lambda name: {r["record_id"] for r in op9_warc.warc_records(op9_warc.pages_to_arc(pages, name=name)).collect()}
    assert ids("one") == ids("one") and not ids("one") & ids("two")
