"""The registered queries against plain Python over the same tables, edge cases included."""

import base64
import hashlib
import random
import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import xxhash

from infratrace.llm import op7_bpe, op10_token_files
from infratrace.llm.registry import QUERIES


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    words = {"en": "the and of a to in is you that it he was for on are".split(), "de": "der die und in den von zu das mit sich des auf für ist im".split()}
    out = []
    for i in range(160):
        lang = "en" if i % 2 else "de"
        out.append([i, " ".join(rng.choice(words[lang]) for _ in range(rng.randint(60, 160))), lang, f"s{i % 5}"])
    for i in range(20):  # copies, and copies of a changed word
        out.append([500 + i, out[i][1], "en", "s1"])
        out.append([600 + i, out[i][1].replace(" ", " x ", 1), "en", "s2"])
    secret, example = "q8Zr2LmX0tPw5VnB7yKc3", "Zx9Kq2Lw8Er7Ty6Ui5Op4"
    out += [[700, f"my {secret} and AKIA{'Q7RT2ZKX9WPL4MNB'} {'0123456789abcdef' * 2} end", "en", "s3"], [701, 'PassWord" : \'hunter22\' token=x secret = abc_1', None, None]]
    out += [[710 + i, f"api_key={example} é漢 {example}", "en", f"s{i}"] for i in range(5)]
    out += [[800, None, "en", "s1"], [801, "", "en", None], [802, " \n\t", None, "s1"], [803, "12 34 !!", "fr", "s1"], [804, "Lang " * 40_000 + "token=" + "k9" * 30_000, "en", "s0"], [805, "<|endoftext|>Hi\x85 \xa0there\x1c漢", "en", "s0"]]
    return out


@pytest.fixture(scope="module")
def folder(tmp_path_factory, rows):
    to = tmp_path_factory.mktemp("tables")
    ids, texts, langs, sources = zip(*rows)
    pq.write_table(pa.table({"doc_id": pa.array(ids, pa.int64()), "text": pa.array(texts, pa.string()), "lang": pa.array(langs, pa.string()), "source": pa.array(sources, pa.string()), "n_chars": pa.array([len(t or "") for t in texts], pa.int64())}), to / "documents.parquet")
    rng = np.random.default_rng(2)
    base = rng.normal(size=(60, 24))
    vectors = [list(v) for v in np.concatenate((base, base[:20] + rng.normal(scale=0.1, size=(20, 24)), base[:5] * 3))]
    vectors += [[1e200] * 24, [1e200] * 23 + [1.01e200], [1e-200] * 24, [0.0] * 24, None, [], [float("nan")] * 24, [float("inf")] * 24, [None] * 24, [1.0, 2.0], [2.0, 4.0]]
    pq.write_table(pa.table({"vec_id": pa.array(rng.permutation(1000)[:len(vectors)], pa.int64()), "embedding": pa.array(vectors, pa.list_(pa.float64())), "label": pa.array([0] * len(vectors), pa.int32())}), to / "embeddings.parquet")
    html = ["<p>a</p>", "<p>b</p>", "", None, "é" * 70_000, "x\r\n\r\nWARC/1.1\r\n\r\n"]
    pages = [(i, f"http://h/{i} {i}" if i % 7 else None, html[i * i % 6] if i % 3 else f"<b>{i}</b>") for i in rng.permutation(80).tolist()]
    pq.write_table(pa.table({"page_id": pa.array([p[0] for p in pages], pa.int64()), "url": pa.array([p[1] for p in pages]), "html": pa.array([p[2] for p in pages], pa.string())}), to / "pages.parquet")
    return str(to)


def run(spark, folder, name):
    return QUERIES[name](spark, folder).collect()


def least_reachable(ids, linked):
    root = {i: i for i in ids}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def library(path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def test_op4_language(spark, folder, rows, tmp_path):
    got = {r["doc_id"]: r for r in run(spark, folder, "op4_language")}
    assert len(got) == len(rows)
    right = []
    for i, text, lang, _ in rows:
        r = got[i]
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r["score"] <= 1
        if not re.search(r"[^\W\d_]", text or ""):
            assert (r["lang_pred"], r["score"]) == ("und", 0)
        elif r["held_out"] and i < 160:
            right.append(r["lang_pred"] == lang)
    assert len(right) > 20 and np.mean(right) > 0.95
    # labels and sources of held-out documents change nothing
    t = pq.read_table(f"{folder}/documents.parquet").to_pandas()
    out = t["doc_id"].map(lambda i: zlib.crc32(str(i).encode()) % 4 == 2)
    t.loc[out, "lang"], t["source"] = "xx", "other"
    pq.write_table(pa.Table.from_pandas(t, preserve_index=False), tmp_path / "documents.parquet")
    again = {r["doc_id"]: r for r in run(spark, str(tmp_path), "op4_language")}
    assert all((again[i]["lang_pred"], again[i]["score"]) == (got[i]["lang_pred"], got[i]["score"]) for i in got)


def test_op5_secrets(spark, folder, rows):
    rules = [
        ("assign", r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?[ ]*[:=][ ]*["']?([A-Za-z0-9+/_.=-]+)""", 6),
        ("access", "(AKIA[A-Z0-9]+)", 20),
        ("hex", "([0-9a-f]+)", 24),
    ]
    got = {r["doc_id"]: r for r in run(spark, folder, "op5_secrets")}
    assert len(got) == len(rows)
    for i, text, _, _ in rows:
        spans = sorted((m.start(), k, m.end(), name) for k, (name, rule, least) in enumerate(rules) for m in re.finditer(rule, text or "") if len(m[1]) >= least)
        joined = [f"{name}:{a}:{b}" for a, _, b, name in spans]
        r = got[i]
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(s[3] == name for s in spans) for name, _, _ in rules]
        assert r["base_sha256"] == hashlib.sha256(",".join(joined).encode()).hexdigest()
        assert set(joined) <= set(filter(None, r["spans"].split(",")))
    assert "token:3:24" in got[700]["spans"] and all(got[710 + i]["n_example"] == 1 and got[710 + i]["n_live"] == 0 for i in range(5))


def test_op6_simhash(spark, folder, rows):
    prints = {}
    for i, text, _, _ in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        hashes = [xxhash.xxh64_intdigest(" ".join(words[k:k + 4]), 42) for k in range(max(1, len(words) - 3))] if words else []
        prints[i] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    ids = sorted(prints)
    want = least_reachable(ids, [(a, b) for a in ids for b in ids if a < b and (prints[a] ^ prints[b]).bit_count() <= 4])
    got = run(spark, folder, "op6_simhash")
    assert sorted((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got) == [(i, f"{prints[i]:016x}", want[i]) for i in ids]


def test_op7_bpe(spark, folder, rows):
    t, want = library(op7_bpe.PATH), {}
    for i, text, _, _ in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids
        want[i] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest())
    assert {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in run(spark, folder, "op7_bpe")} == want


def test_op8_embeddings(spark, folder):
    t = pq.read_table(f"{folder}/embeddings.parquet").to_pylist()
    fine = [r for r in t if r["embedding"] and all(v is not None and np.isfinite(v) for v in r["embedding"]) and any(r["embedding"])]
    linked = []
    for a in fine:
        for b in fine:
            if a["vec_id"] < b["vec_id"] and len(a["embedding"]) == len(b["embedding"]):
                x, y = (np.array(r["embedding"], np.longdouble) for r in (a, b))
                if (x * y).sum() / np.sqrt((x * x).sum() * (y * y).sum()) >= 0.95:
                    linked.append((a["vec_id"], b["vec_id"]))
    ids = sorted(r["vec_id"] for r in t)
    want = least_reachable(ids, linked)
    assert len(linked) > 25
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in run(spark, folder, "op8_embeddings")}
    assert got == {i: (sum(i in p for p in linked), want[i], want[i] == i) for i in ids}


def test_op9_warc(spark, folder):
    t = pd.DataFrame(pq.read_table(f"{folder}/pages.parquet").to_pylist())
    t["payload"] = t["html"].map(lambda x: (x or "").encode())
    first, want = t.groupby("payload")["page_id"].min(), {}
    for r in t.itertuples():
        own = first[r.payload] == r.page_id
        want[r.page_id] = (len(r.payload), base64.b32encode(hashlib.sha1(r.payload).digest()).decode(), "response" if own else "revisit", None if own else int(first[r.payload]))
    got = run(spark, folder, "op9_warc")
    assert len(got) == len(want) and {r["page_id"]: (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got} == want


def test_op10_token_files(spark, folder, rows):
    t, at, want = library(op10_token_files.PATH), 0, {}
    for i, text, _, _ in sorted(rows, key=lambda r: r[0]):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        want[i] = (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in run(spark, folder, "op10_token_files")} == want
