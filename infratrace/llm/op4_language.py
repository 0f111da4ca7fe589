"""Language of whole texts by a byte convolutional network.

Bytes are embedded, filters two, three and four bytes wide run over windows of WINDOW bytes, each
filter keeps its largest answer, and a softmax over those gives the languages of a window. The
network is trained here, in numpy with Adam, on windows of labelled texts. A whole text is cut into
windows from end to end; its answer is the mean of their log probabilities.

Training takes at most SAMPLE_ROWS different labelled texts, shared evenly among the languages and chosen
by a hash of the text, one for each language if there are more of them, and TRAIN_WINDOWS windows spread over
each whole text; these bounds do not grow with the table and keep the training in the driver small. All languages
are learned (MAX_LANGS is above their number). Everything else covers all rows. Since filters
are linear in the bytes they see, their answers for every pair of bytes are tabled once in a worker.

Null texts and texts without a letter are `und` with score 0, as is everything if no labelled text
has a letter. Labels that are null teach nothing. Repeated rows get equal answers; an empty table
gives an empty result; columns of the input stay, and those named like an answer are replaced.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructType

from .common import bound_batches, table

#: Labelled rows to learn from at most, windows from each, and batches seen in training, as many for
#: little text as for much.
SAMPLE_ROWS, TRAIN_WINDOWS, STEPS = 2400, 3, 450
#: Labels that are learned at most: more than there are codes of languages, so none is left out. In a column that
#: holds more, which names other things too, those of the most texts are.
MAX_LANGS = 8192
WINDOW, EMBED, FILTERS, WIDTHS = 256, 8, 8, (2, 3, 4)
NONE = "und"
#: Bytes that are worked on at once.
CHUNK = 1 << 16


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def windows(raw: bytes) -> np.ndarray:
    """All bytes of a text as rows of WINDOW bytes, the last filled with zeros."""
    n = max(1, -(-len(raw) // WINDOW))
    out = np.zeros(n * WINDOW, dtype=np.uint8)
    out[:len(raw)] = np.frombuffer(raw, dtype=np.uint8)
    return out.reshape(n, WINDOW)


class Network:
    """embed: byte -> EMBED numbers; filters of each width; dense layer over their largest answers."""

    def __init__(self, langs: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.langs = langs
        self.p = {"embed": rng.normal(0, 0.5, (256, EMBED)), "dense": rng.normal(0, 0.1, (FILTERS * len(WIDTHS), len(langs))), "bias": np.zeros(len(langs))}
        for w in WIDTHS:
            self.p[f"f{w}"] = rng.normal(0, 1 / np.sqrt(w * EMBED), (w, EMBED, FILTERS))
            self.p[f"b{w}"] = np.zeros(FILTERS)
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def train(self, x: np.ndarray, y: np.ndarray, steps: int = STEPS, batch: int = 64, rate: float = 0.01, seed: int = 11) -> None:
        rng, order = np.random.default_rng(seed), np.zeros(0, dtype=np.int64)
        m, v = ({k: np.zeros_like(a) for k, a in self.p.items()} for _ in range(2))
        for step in range(1, steps + 1):
            if len(order) < min(batch, len(x)):
                order = np.concatenate((order, rng.permutation(len(x))))
            own, order = order[:batch], order[batch:]
            for k, d in self.gradient(x[own], y[own]).items():
                m[k] += 0.1 * (d - m[k])
                v[k] += 0.001 * (d * d - v[k])
                self.p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)

    def gradient(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        n, rows = len(x), np.arange(len(x))[:, None]
        pooled, places = [], []
        for w in WIDTHS:
            answers = sum((self.p["embed"] @ self.p[f"f{w}"][k])[x[:, k:WINDOW - w + 1 + k]] for k in range(w))
            at = answers.argmax(axis=1)
            places.append(at)
            pooled.append(answers[rows, at, np.arange(FILTERS)] + self.p[f"b{w}"])
        raw = np.concatenate(pooled, axis=1)
        h = np.maximum(raw, 0)
        z = h @ self.p["dense"] + self.p["bias"]
        q = np.exp(z - z.max(axis=1, keepdims=True))
        q /= q.sum(axis=1, keepdims=True)
        q[np.arange(n), y] -= 1
        q /= n
        g = {"dense": h.T @ q, "bias": q.sum(axis=0), "embed": np.zeros_like(self.p["embed"])}
        back = (q @ self.p["dense"].T) * (raw > 0)
        for i, w in enumerate(WIDTHS):
            d = back[:, i * FILTERS:(i + 1) * FILTERS]
            g[f"b{w}"] = d.sum(axis=0)
            g[f"f{w}"] = np.zeros_like(self.p[f"f{w}"])
            for k in range(w):
                seen = x[rows, places[i] + k]  # the byte under each filter's best place
                g[f"f{w}"][k] = np.einsum("nfe,nf->ef", self.p["embed"][seen], d)
                np.add.at(g["embed"], seen, d[:, :, None] * self.p[f"f{w}"][k].T[None])
        return g

    def tables(self) -> None:
        """Answers for pairs of bytes: width 2, halves of widths 3 and 4; and the third byte of width 3."""
        e = self.p["embed"]
        one = {(w, k): e @ self.p[f"f{w}"][k] for w in WIDTHS for k in range(w)}
        pair = lambda w, k: (one[w, k][:, None] + one[w, k + 1][None]).reshape(65536, FILTERS)
        self.pairs = np.ascontiguousarray(np.concatenate([pair(2, 0), pair(3, 0), pair(4, 0), pair(4, 2)], axis=1))
        self.third = np.ascontiguousarray(one[3, 2])
        self.offset = np.concatenate([self.p[f"b{w}"] for w in WIDTHS])

    def log_probabilities(self, x: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Of each language for each window, with the first window's place, some windows at a time."""
        f, step = FILTERS, max(1, CHUNK // WINDOW)
        for at in range(0, len(x), step):
            part = x[at:at + step]
            codes = part[:, :-1].astype(np.int32) << 8 | part[:, 1:]
            got = self.pairs.take(codes, axis=0)  # window, place, 4 * FILTERS
            two = got[:, :, :f].max(axis=1)
            three = (got[:, :-1, f:2 * f] + self.third.take(part[:, 2:], axis=0)).max(axis=1)
            four = (got[:, :-2, 2 * f:3 * f] + got[:, 2:, 3 * f:]).max(axis=1)
            h = np.maximum(np.concatenate((two, three, four), axis=1) + self.offset, 0)
            z = (h @ self.p["dense"] + self.p["bias"]).astype(np.float64)
            z -= z.max(axis=1, keepdims=True)
            yield at, z - np.log(np.exp(z).sum(axis=1, keepdims=True))

    def predict(self, texts: list[str]) -> list[tuple[str, float]]:
        cut = [windows(x.encode("utf-8")) for x in texts]
        if not cut:
            return []
        sizes = np.array([len(c) for c in cut])
        owner, mean = np.repeat(np.arange(len(cut)), sizes), np.zeros((len(cut), len(self.langs)))
        for at, logs in self.log_probabilities(np.concatenate(cut)):
            own = owner[at:at + len(logs)]
            first = np.flatnonzero(np.diff(own, prepend=-1))  # where a text's windows begin
            mean[own[first]] += np.add.reduceat(logs, first, axis=0)
        mean /= sizes[:, None]
        q = np.exp(mean - mean.max(axis=1, keepdims=True))
        q /= q.sum(axis=1, keepdims=True)
        best = q.argmax(axis=1)
        return [(self.langs[b], float(q[i, b])) for i, b in enumerate(best)]


def sample(labelled: DataFrame, text: str = "text", lang: str = "lang", sample_rows: int = SAMPLE_ROWS, max_langs: int = MAX_LANGS) -> list[tuple[str, list[str]]]:
    """(language, pieces of a text) of at most `sample_rows` different texts, evenly by language.

    Copies of a text count once: texts are drawn by their hash and reduced to different ones before a
    language's quota is filled, so no text, however often it occurs, displaces others.
    """
    usable = labelled.where(F.col(lang).isNotNull() & has_letter(F.col(text))).select(F.col(text).alias("text"), F.col(lang).alias("lang")).withColumn("h", F.xxhash64("text"))
    known = usable.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).orderBy(F.desc("n"), "lang").limit(max_langs)
    counts = [(r["lang"], max(1, r["n"])) for r in known.collect()]  # max_langs rows at most
    if not counts:
        return []
    quota = max(1, sample_rows // len(counts))
    draw = F.pmod("h", F.lit(1 << 30)) / F.lit(float(1 << 30))
    spots = [F.substring(F.col("text"), (F.length("text") * k / TRAIN_WINDOWS).cast("int") + 1, F.lit(WINDOW)) for k in range(TRAIN_WINDOWS)]
    # enough that a language falls short of its quota, or of its one text, with chance 10^-8
    shares = usable.sparkSession.createDataFrame([(k, max(1.3 * quota, quota + 6 * quota**0.5 + 12) / n) for k, n in counts], "lang string, share double")
    drawn = usable.join(F.broadcast(shares), "lang").where(draw < F.col("share")).groupBy("lang", "h").agg(F.min(F.array(*spots)).alias("spots"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h"))  # over about 1.3 quotas
    rows = drawn.withColumn("place", place).where(F.col("place") <= quota).collect()
    return sorted((r["lang"], list(r["spots"])) for r in rows)


def train(labelled: DataFrame, text: str = "text", lang: str = "lang", sample_rows: int = SAMPLE_ROWS, max_langs: int = MAX_LANGS) -> Network | None:
    """A network learned from labelled rows; None if no language has a text with a letter."""
    rows = sample(labelled, text, lang, sample_rows, max_langs)
    if not rows:
        return None
    langs = sorted({k for k, _ in rows})
    data = sorted({(k, s.encode()[:WINDOW]) for k, spots in rows for s in spots if s})
    x = np.concatenate([windows(s) for _, s in data])
    y = np.array([langs.index(k) for k, _ in data])
    net = Network(langs)
    net.train(x, y)
    return net


@lru_cache(maxsize=2)
def _ready(blob: bytes) -> Network:
    net = pickle.loads(blob)
    net.tables()
    return net


def predict_udf(net: Network):
    blob = pickle.dumps(net)

    @F.pandas_udf(StructType().add("lang", StringType()).add("score", DoubleType()))
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        ready = _ready(blob)
        for texts in batches:
            got: list[tuple[str | None, float | None]] = [(None, None)] * len(texts)
            held, size, known = [], 0, texts.tolist()
            for i, x in enumerate([*known, None]):
                if isinstance(x, str):
                    held.append(i)
                    size += len(x)
                if held and (size > CHUNK or i == len(known)):
                    for k, answer in zip(held, ready.predict([known[k] for k in held])):
                        got[k] = answer
                    held, size = [], 0
            yield pd.DataFrame(got, columns=["lang", "score"])

    return predict


def identify(docs: DataFrame, net: Network | None, text: str = "text", lang_pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """docs with the predicted language and its score."""
    bound_batches(docs.sparkSession)
    old = [c for c in docs.columns if c not in (lang_pred, score)]
    if net is None:
        return docs.select(*old, F.lit(NONE).alias(lang_pred), F.lit(0.0).alias(score))
    answer = predict_udf(net)(F.when(has_letter(F.col(text)), F.col(text)))
    marked = docs.select(*old, answer.alias("_answer"))
    return marked.select(*old, F.coalesce("_answer.lang", F.lit(NONE)).alias(lang_pred), F.coalesce("_answer.score", F.lit(0.0)).alias(score))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = train(docs.where(~held_out(F.col("doc_id"))))
    return identify(docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out")), net).select("doc_id", "held_out", "lang_pred", "score")
