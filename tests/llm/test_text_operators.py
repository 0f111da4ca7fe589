"""Quality rules, mixing, sharding, language, secrets."""

import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from infratrace.llm import op1_quality, op2_mixing, op3_sharding, op4_language, op5_secrets

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def docs(spark, rows):
    return spark.createDataFrame([tuple(r) + (None,) * (5 - len(r)) for r in rows], DOCS)


# -- 1 quality ------------------------------------------------------------------------------------

def base(text):
    words, lines = WORDS.findall(text or ""), [x for x in (text or "").split("\n") if WORDS.search(x)]
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    n = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if n[w] > 1 for k in range(3)}
    bad = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), bad


def test_quality_against_brute_force(spark):
    rng = random.Random(1)
    words = ["a", "bb", "the", "é漢", "x.", "#1", "no|pe"]
    texts = ["".join(rng.choice(words) + rng.choice([" ", "  ", "\n", "\t", "\x0b", " \n\n "]) for _ in range(rng.randint(0, 120))) for _ in range(80)]
    texts += [None, "", " \n ", "one", "a b c a b c", "a a a a a a", "w " * 30_000, "  x y"]
    df = docs(spark, [(i, t) for i, t in enumerate(texts)])
    got = {r["doc_id"]: r for r in op1_quality.judge(df).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == base(t), repr(t)[:80]
        assert not (r["base_failed"] and r["kept"])


def test_quality_lines_and_edges(spark):
    good = " ".join(f"word{i}" for i in range(60)) + "."
    menu = "\n".join("Home | About | News | Contact" for _ in range(40))
    notice = "We use cookies and our privacy policy applies to you."
    df = docs(spark, [(1, good), (2, f"{good}\n{menu}"), (3, f"{good}\n{notice}\nMore"), (4, None)]).unionAll(docs(spark, [(1, good)])).withColumn("kept", F.lit("clash")).withColumn("extra", F.lit(7))
    got = op1_quality.judge(df)
    rows = {r["doc_id"]: r for r in got.collect()}
    assert got.columns.count("kept") == 1 and rows[1]["extra"] == 7 and got.where("doc_id = 1").count() == 2
    assert rows[1]["kept"] and rows[1]["clean_text"] == good and not rows[2]["kept"]
    assert rows[3]["kept"] and rows[3]["clean_text"] == good and rows[3]["n_failed_lines"] == 2 and not rows[4]["kept"]
    assert op1_quality.judge(df.limit(0)).count() == 0
    foreign = docs(spark, [(9, f"{good}\nAlle Rechte vorbehalten und so weiter hier.\nNous utilisons des cookies sur ce site.\nTodos los derechos reservados para siempre.")])
    assert op1_quality.judge(foreign).collect()[0]["clean_text"] == good


def test_quality_keeps_columns_of_any_name(spark):
    df = docs(spark, [(1, "a b")])
    for name in ("words", "lines", "told", "row", "bad", "places", "notices"):
        df = df.withColumn(name, F.lit(name))
    got = op1_quality.judge(df).collect()[0]
    assert all(got[name] == name for name in ("words", "lines", "told", "row", "bad", "places", "notices")) and got["n_words"] == 2


def test_clean_text_keeps_repeated_lines_that_pass(spark):
    refrain, verse = "And this is the line that we all sing again.", " ".join(f"word{i}" for i in range(60)) + "."
    df = docs(spark, [(1, f"{refrain}\n{verse}\nMore\n{refrain}\nMore\n{refrain}"), (2, f"{refrain}\n{verse}\n{refrain}"), (3, f"{refrain}\n\n{verse}\n \nMore\n")])
    got = {r["doc_id"]: r for r in op1_quality.judge(df).collect()}
    assert got[1]["n_failed_lines"] == 2 and got[1]["lost_words"] == 2
    assert got[1]["clean_text"] == f"{refrain}\n{verse}\n{refrain}\n{refrain}"
    assert got[2]["clean_text"] == f"{refrain}\n{verse}\n{refrain}"
    assert got[3]["clean_text"] == f"{refrain}\n\n{verse}\n \n" and got[3]["n_lines"] == 3


# -- 2 mixing -------------------------------------------------------------------------------------

def fill(sizes, weights, total):
    """Water level by repeated sharing."""
    left, out, open_ = total, {}, dict(weights)
    while open_:
        level = left / sum(open_.values())
        full = [s for s, w in open_.items() if 2 * sizes[s] <= level * w]
        if not full:
            return out | {s: level * w for s, w in open_.items()}
        for s in full:
            out[s] = 2 * sizes[s]
            left -= out[s]
            del open_[s]
    return out


def test_mixing(spark):
    rng = random.Random(2)
    names = ["a", "b", "é", None, "z"]
    rows = [(i, "w " * rng.choice([0, 1, 5, 40]), None, names[min(4, int(rng.expovariate(1.2)))]) for i in range(400)] + [(999, None, None, "empty"), (7, "w w", None, "a"), (7, "w w", None, "a")]
    df = docs(spark, rows)
    queued = op2_mixing.queue(df, {"doc_id": F.col("doc_id")}, ranges=16)
    got = [r.asDict() for r in queued.select("kept.doc_id", "source", "size", "source_size", "target").collect()]
    sizes = Counter()
    for _, t, _, s in rows:
        sizes[s] += len(WORDS.findall(t or ""))
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    want = fill(sizes, {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}, 1.5 * sum(sizes.values()))
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and math.isclose(r["target"], want[r["source"]], rel_tol=1e-12)
    waiting = [r.asDict() for r in queued.select("nth", "source", "key", "size", "source_size", "target", "upto").collect()]
    piece, line = 16, []
    for r in waiting:  # the queue in plain Python: every copy, in pieces where time 1 falls within it
        for epoch in (0, 1):
            begin = epoch * r["source_size"] + r["upto"] - r["size"]
            whole = not begin < r["target"] < begin + r["size"]
            cuts = [(0, r["size"])] if whole else [(at, min(piece, r["size"] - at)) for at in range(0, r["size"], piece)]
            line += [((begin + at + n) / r["target"], (r["source"] is not None, r["source"] or ""), r["key"], r["nth"], epoch, k, n) for k, (at, n) in enumerate(cuts) if n]
    budget, at, want_mix = int(1.5 * sum(sizes.values())), 0, []
    for finish, _, _, nth, epoch, part, n in sorted(line):
        if at < budget:
            want_mix.append((at, nth, epoch, part, min(n, budget - at)))
        at += n
    mixed = op2_mixing.mix(queued, bins=32)
    assert sorted((r["position"], r["nth"], r["epoch"], r["part"], r["words"]) for r in mixed.collect()) == want_mix
    per, of = Counter(), {r["nth"]: r for r in waiting}
    for _, nth, _, _, n in want_mix:
        per[nth] += n
    assert sum(per.values()) == budget and all(n <= 2 * of[nth]["size"] for nth, n in per.items())
    served = Counter()
    for nth, n in per.items():
        served[of[nth]["source"]] += n
    assert all(abs(served[s] - want[s]) <= 2 * piece for s in want)
    copies = op2_mixing.by_copy(mixed).collect()
    assert sum(r["words"] for r in copies) == budget and len({(r["nth"], r["epoch"]) for r in copies}) == len(copies)
    plan = mixed._jdf.queryExecution().executedPlan().toString()
    assert "Window" in plan and "finish" in plan


def test_mixing_reruns_and_empty(spark, data):
    one, two = (op2_mixing.op2_mixing(spark, data).orderBy("doc_id").collect() for _ in range(2))
    assert one == two
    assert op2_mixing.queue(docs(spark, []), {"doc_id": F.col("doc_id")}).count() == 0
    nothing = op2_mixing.queue(docs(spark, [(1, None, None, None)]), {"doc_id": F.col("doc_id")})
    assert nothing.collect()[0]["target"] == 0 and op2_mixing.mix(nothing).count() == 0


def test_first_words(spark):
    df = docs(spark, [(1, " a\tb  c "), (2, "a b")])
    assert [r[0] for r in df.select(op2_mixing.first_words(F.col("text"), F.lit(2))).collect()] == ["a b", "a b"]


# -- 3 sharding -----------------------------------------------------------------------------------

def split(rows, limit, prefix=""):
    """Extendible hashing as such: split what is too large on its next bit."""
    if sum(b for _, b in rows) <= limit or len(rows) == 1 or len(prefix) == 63:
        return {prefix: rows} if rows or not prefix else {prefix: []}
    out = {}
    for bit in "01":
        out |= split([r for r in rows if r[0][len(prefix)] == bit], limit, prefix + bit)
    return out


@pytest.mark.parametrize("step", [3, 10, 63])
def test_sharding_against_brute_force(spark, step):
    rng = random.Random(4)
    rows = [(rng.choice([7, rng.randint(0, 10_000)]), "x" * rng.choice([0, 1, 30, 200])) for _ in range(300)] + [(None, "y" * 5000), (1, None)]
    coded = op3_sharding.codes(docs(spark, rows), {"doc_id": F.col("doc_id")})
    local = [(format(r["code"], "063b"), r["bytes"]) for r in coded.collect()]
    want = {p: rs for p, rs in split(local, 1000).items() if rs}
    got = op3_sharding.assign(coded, op3_sharding.directory(coded, 1000, step)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert format(r["code"], "063b").startswith(r["shard"]) and r["shard"] in want
        assert r["shard_bytes"] == sum(b for _, b in want[r["shard"]]) and r["shard_docs"] == len(want[r["shard"]])
        assert r["shard_bytes"] <= 1000 or r["shard_docs"] == 1


def test_shards_are_written_whole(spark, tmp_path):
    df = docs(spark, [(i, "x" * 100, "en", "s", 100) for i in range(50)])
    op3_sharding.write_shards(df.withColumn("shard", F.lit("clash")), f"file://{tmp_path}/shards", limit=1000)
    back = spark.read.parquet(f"file://{tmp_path}/shards")
    assert sorted(r["doc_id"] for r in back.collect()) == list(range(50)) and back.select("shard").distinct().count() >= 5
    assert op3_sharding.shards(docs(spark, []), {"doc_id": F.col("doc_id")}).count() == 0


# -- 4 language -----------------------------------------------------------------------------------

def test_language_held_out_accuracy(spark, data):
    got = op4_language.op4_language(spark, data).join(spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "lang"), "doc_id").toPandas()
    held = got[got["held_out"] & got["lang"].notna()]
    assert len(held) > 20 and (held["lang_pred"] == held["lang"]).mean() > 0.93 and got["score"].between(0, 1).all()


def test_language_edges(spark):
    rows = [(i, t, k) for i, (t, k) in enumerate([("the cat and the dog", "en"), ("der hund und die katze", "de")] * 40)]
    net = op4_language.train(docs(spark, rows + [(1000, "unlabelled", None), (1001, None, "fr"), (1002, "123", "fr")]))
    assert net.langs == ["de", "en"]
    df = docs(spark, [(1, "the dog and the cat"), (2, "die katze und der hund"), (3, None), (4, "123 !!"), (5, ""), (6, "the and " * 40_000)]).withColumn("score", F.lit("clash"))
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in op4_language.identify(df, net).collect()}
    assert got[1][0] == "en" and got[2][0] == "de" and got[6][0] == "en" and all(got[i] == ("und", 0.0) for i in (3, 4, 5))
    assert op4_language.train(docs(spark, [(1, "text", None)])) is None
    assert [r["lang_pred"] for r in op4_language.identify(df.where("doc_id = 1"), None).collect()] == ["und"]
    assert op4_language.identify(df.limit(0), net).count() == 0


def test_copies_of_a_text_teach_once(spark):
    rng = random.Random(8)
    sounds = {"de": "der die und sch ein über ung nicht".split(), "en": "the and of ing tion her with is".split()}
    make = lambda k: " ".join(rng.choice(sounds[k]) for _ in range(40))
    rows = [(i, f"{make('de')}", "de") for i in range(300)] + [(1000 + i, make("en"), "en") for i in range(300)]
    rows += [(10_000 + i, rows[0][1], "de") for i in range(20_000)]
    drawn = op4_language.sample(docs(spark, rows), sample_rows=200)
    assert Counter(k for k, _ in drawn) == {"de": 100, "en": 100} and len({tuple(s) for _, s in drawn}) == 200
    net = op4_language.train(docs(spark, rows))
    net.tables()
    fresh = [(k, make(k)) for k in ("de", "en") for _ in range(50)]
    assert sum(p == k for (k, _), (p, _) in zip(fresh, net.predict([t for _, t in fresh]))) >= 95
    many = docs(spark, [(i, f"text {i}", f"l{i % 40}") for i in range(400)])
    assert len({k for k, _ in op4_language.sample(many, max_langs=8)}) == 8


def test_no_language_is_left_out(spark):
    rows = [(i, f"word {i}", f"l{i}") for i in range(3000)] + [(10_000 + i, f"other {i}", "big") for i in range(3000)]
    drawn = op4_language.sample(docs(spark, rows), sample_rows=600)
    assert len(drawn) == 3001 and len({k for k, _ in drawn}) == 3001


def test_long_texts_have_the_mean_of_their_windows():
    import numpy as np

    net = op4_language.Network(["a", "b", "c"])
    net.tables()
    texts = ["x y z " * 40_000, "short", "b" * 70_000, "end " * 100]
    for text, (lang, score) in zip(texts, net.predict(texts)):
        logs = np.concatenate([z for _, z in net.log_probabilities(op4_language.windows(text.encode()))]).mean(axis=0)
        q = np.exp(logs) / np.exp(logs).sum()
        assert lang == net.langs[q.argmax()] and abs(score - q.max()) < 1e-5


def test_network_tables_match_the_definition():
    import numpy as np

    net = op4_language.Network(["a", "b"])
    net.tables()
    x = np.random.default_rng(0).integers(0, 256, (3, op4_language.WINDOW), dtype=np.uint8)
    pooled = [sum((net.p["embed"] @ net.p[f"f{w}"][k])[x[:, k:op4_language.WINDOW - w + 1 + k]] for k in range(w)).max(axis=1) + net.p[f"b{w}"] for w in op4_language.WIDTHS]
    z = np.maximum(np.concatenate(pooled, axis=1), 0) @ net.p["dense"] + net.p["bias"]
    want = z - np.log(np.exp(z).sum(axis=1, keepdims=True))
    assert np.allclose(np.concatenate([z for _, z in net.log_probabilities(x)]), want, atol=1e-4)


# -- 5 secrets ------------------------------------------------------------------------------------

KEY = "AKIA" + "Q7RT2ZKX9WPL4MNB"


def test_base_spans():
    text = f'TOKEN = "abcdef" secret:ab {KEY} password=x1y2z3 ' + "0123456789abcdef" * 2
    found = [(k, text[a:b]) for k, a, b, _, _ in op5_secrets.candidates(text) if k != "token"]
    assert found == [("assign", 'TOKEN = "abcdef'), ("access", KEY), ("assign", "password=x1y2z3"), ("hex", "0123456789abcdef" * 2)]
    assert op5_secrets.candidates('token=token"=abcdefgh') == [] and op5_secrets.candidates("paſſword=abcdefgh") == []
    assert op5_secrets.candidates(None) == [] and op5_secrets.candidates("") == []


def test_ownership(spark):
    live, copied = "q8Zr2LmX0tPw5VnB7yKc3", "hJ4kD9sW1zXv6QbN8rTy2"
    rows = [(1, f"use {live} here", None, "own"), (2, f"é {live}", None, "own")] + [(10 + i, f"copy {copied} token={copied}", None, f"s{i}") for i in range(4)] + [(50, None, None, None), (51, "password=changeme1", None, None), (1, f"use {live} here", None, "own")]
    got = op5_secrets.find_secrets(docs(spark, rows), repo=F.col("doc_id"), owner=F.col("source")).collect()
    by = defaultdict(list)
    for r in got:
        by[r["doc_id"]].append(r["secrets"])
    assert len(got) == len(rows) and len(by[1]) == 2
    assert [(s["kind"], s["start"], s["label"], s["n_owners"], s["n_repos"]) for s in by[1][0]] == [("token", 4, "live", 1, 2)]
    assert [(s["kind"], s["label"], s["n_owners"]) for s in by[10][0]] == [("assign", "example", 4)]
    assert by[50] == [[]] and [s["label"] for s in by[51][0]] == ["weak"]
    assert op5_secrets.find_secrets(docs(spark, [])).count() == 0


def test_one_repository_of_many_owners_copies_nothing(spark):
    value = "hJ4kD9sW1zXv6QbN8rTy2"
    rows = [(7, f"token={value}", None, f"o{i}") for i in range(5)]
    got = op5_secrets.find_secrets(docs(spark, rows), repo=F.col("doc_id"), owner=F.col("source")).collect()
    assert {(s["label"], s["n_owners"], s["n_repos"]) for r in got for s in r["secrets"]} == {("live", 5, 1)}


def test_tokens_beside_many_spans():
    text = " ".join(f"token=ab{i}cdefgh x{i}Q7RT2ZKX9WPL4MNBvvvv" for i in range(20_000))
    kinds = Counter(k for k, *_ in op5_secrets.candidates(text))
    assert kinds == {"assign": 20_000, "token": 20_000}


def test_masking(spark):
    df = spark.createDataFrame([("abcdefghij", [(2, 4), (3, 5), (7, 8)]), ("é漢字", []), (None, None), ("xy", [(0, 2)])], "text string, s array<struct<start:int,end:int>>")
    assert [r[0] for r in df.select(op5_secrets.masked(F.col("text"), F.col("s"), "#")).collect()] == ["ab#fg#ij", "é漢字", None, "#"]
