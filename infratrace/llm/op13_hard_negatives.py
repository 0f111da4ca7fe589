"""Hard negatives by an inverted multi-index.

Vectors become integers (floor(256 * x)) and are cut into halves. Two codebooks, one for each half, learned
on a bounded sample, form cells: a vector lies in the cell of its nearest codes (the half spaces), and every
code knows the largest distance of any vector filed under it. A half's inner product with an anchor is at
most anchor . code + |anchor| * radius, and a cell's bound is the sum of its halves' bounds. An anchor visits
cells in falling order of that sum, which a heap over the two sorted lists gives (multi-sequence).

A search has two rounds. In the first an anchor visits cells until they hold FIRST rows. The worst score
that is still wanted in any of its windows, so far, then certifies the rest: of the cells that follow, those
whose bound reaches it are visited, and the others cannot hold a result. So results are exact whatever
the codebooks; on data without structure most cells are visited. Positives are one search with a window of
all scores among equal labels, negatives another with a window for each positive.

Cells meet anchors as blocks: BLOCK rows of a cell and TILE anchors are one matrix product, of which
rows that enter a window's best remain. Of rows that agree in vector and label only the first KEEP can be
among the first of anything, so copies of a vector are cut to these (all still count as anchors).

Rows with a null label or vector, or with null or non-finite components, take no part. Vectors of different
lengths are never compared; codebooks are learned for the LENGTHS most frequent lengths, other lengths are one
cell each. Components too large for exact double products (WIDE) are computed as Python integers; a score
beyond 64 bits raises. A null vec_id is never an anchor and comes last among ties; repeated rows are rows of
their own. An empty table gives an empty result. Other columns are left out.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bound_batches, discard, source_order, stash, table

SCALE, POSITIVES, NEGATIVES = 256, 5, 10
#: A negative's score lies between these hundredths of the positive's.
LEAST, MOST = 30, 90
#: Rows of a cell on average, codes of a half at most, vectors to learn from and rounds of learning, lengths that are learned.
CELL_ROWS, CODES, SAMPLE, ROUNDS, LENGTHS = 256, 128, 4096, 10, 8
#: Rows in the cells of a first round; rows of a block and anchors of a tile.
FIRST, BLOCK, TILE = 4096, 2048, 4096
ANY = 1 << 62


def wide(q: np.ndarray) -> bool:
    """Products of such components may exceed what doubles hold exactly."""
    return bool(len(q)) and float(np.abs(q).max()) > math.sqrt(2**52 / len(q))


def integers(x: np.ndarray) -> tuple[bool, bytes]:
    """Whether the vector is wide, and floor(SCALE * x) as int32, or x itself where it is."""
    with np.errstate(over="ignore"):
        q = np.floor(SCALE * x)
    return (True, x.astype("<f8").tobytes()) if wide(q) else (False, q.astype("<i4").tobytes())


def exact(is_wide: bool, data: bytes) -> list[int]:
    """The components as Python integers."""
    if not is_wide:
        return [int(v) for v in np.frombuffer(data, "<i4")]
    return [SCALE * int(v) if abs(v) >= 2**52 else math.floor(SCALE * float(v)) for v in np.frombuffer(data, "<f8")]


def codebook(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = ROUNDS) -> np.ndarray:
    """k centres of the rows of x, by Lloyd's rounds."""
    centres = x[rng.choice(len(x), size=min(k, len(x)), replace=False)]
    for _ in range(rounds):
        own = nearest(x, centres)[0]
        n = np.bincount(own, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each row and the distance to it."""
    own = np.argmin((centres * centres).sum(axis=1)[None] - 2 * x @ centres.T, axis=1)
    return own, np.linalg.norm(x - centres[own], axis=1)


class Index:
    """The codebooks of each length; radii and rows of cells once these are known."""

    def __init__(self, books: dict[int, tuple[np.ndarray, np.ndarray]]):
        self.books = books
        self.radii: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.rows: dict[int, dict[tuple[int, int], int]] = {}

    def place(self, dim: int, q: np.ndarray) -> tuple[np.ndarray, ...]:
        """Codes and distances of both halves of rows q."""
        h = dim // 2
        one, two = self.books.get(dim) or (np.zeros((1, h)), np.zeros((1, dim - h)))
        return (*nearest(q[:, :h], one), *nearest(q[:, h:], two))

    def visits(self, dim: int, a: np.ndarray | None) -> Iterator[tuple[float, int, int, int]]:
        """(bound, i, j, rows) of the cells of one length that hold rows, in falling order of the bound. a is
        None for a wide anchor, which no bound holds back."""
        rows = self.rows.get(dim, {})
        if (-1, -1) in rows:  # wide rows
            yield math.inf, -1, -1, rows[-1, -1]
        if dim not in self.radii:
            return
        h, one, two = dim // 2, *(self.books.get(dim) or (np.zeros((1, dim // 2)), np.zeros((1, dim - dim // 2))))
        if a is None:
            yield from ((math.inf, i, j, n) for (i, j), n in sorted(rows.items()) if i >= 0)
            return
        bounds = []
        for part, codes, radius in ((a[:h], one, self.radii[dim][0]), (a[h:], two, self.radii[dim][1])):
            norm = float(np.linalg.norm(part))
            slack = 1e-9 * norm * (np.linalg.norm(codes, axis=1) + radius) + 1e-6
            bounds.append(np.where(radius >= 0, codes @ part + norm * radius + slack, -math.inf))
        order = [np.argsort(-b, kind="stable") for b in bounds]
        sorted_ = [b[o] for b, o in zip(bounds, order)]
        heap, seen = [(-(sorted_[0][0] + sorted_[1][0]), 0, 0)], {(0, 0)}
        while heap:
            bound, p, r = heapq.heappop(heap)
            if bound == math.inf:
                return
            cell = int(order[0][p]), int(order[1][r])
            if cell in rows:
                yield -bound, *cell, rows[cell]
            for nxt in ((p + 1, r), (p, r + 1)):
                if nxt[0] < len(order[0]) and nxt[1] < len(order[1]) and nxt not in seen:
                    seen.add(nxt)
                    heapq.heappush(heap, (-(sorted_[0][nxt[0]] + sorted_[1][nxt[1]]), *nxt))


def learn(rows: DataFrame, cell_rows: int, sample: int = SAMPLE, lengths: int = LENGTHS, seed: int = 3) -> Index:
    """Codebooks from rows (dim, wide, q); `sample` vectors a learned length reach the driver."""
    known = rows.where(~F.col("wide")).groupBy("dim").count().orderBy(F.desc("count"), "dim").limit(lengths).collect()
    sizes = {r["dim"]: r["count"] for r in known if r["dim"] > 0}
    if not sizes:
        return Index({})
    share = F.create_map(*[x for dim, n in sizes.items() for x in (F.lit(dim), F.lit(1.2 * sample / n))])
    draw = F.pmod(F.xxhash64("q"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    drawn = rows.where(~F.col("wide") & (draw < share[F.col("dim")])).select("dim", "q").limit(2 * sample * len(sizes)).collect()
    rng, books = np.random.default_rng(seed), {}
    for dim, n in sizes.items():
        own = sorted(bytes(r["q"]) for r in drawn if r["dim"] == dim)[:sample]
        if own:
            x = np.stack([np.frombuffer(q, "<i4") for q in own]).astype(np.float64)
            k = max(1, min(CODES, round(math.sqrt(n / cell_rows))))
            books[dim] = codebook(x[:, :dim // 2], k, rng), codebook(x[:, dim // 2:], k, rng)
    return Index(books)


def integer_rows(vectors: DataFrame, vec_id: str, embedding: str, label: str) -> DataFrame:
    """nth, vec_id, label, dim, wide and q of every row that takes part."""
    good = F.col(label).isNotNull() & F.coalesce(F.forall(F.col(embedding), lambda x: F.coalesce((F.abs(x) < float("inf")) & ~F.isnan(x), F.lit(False))), F.lit(False))
    rows = vectors.select(source_order().alias("nth"), F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), F.col(embedding).alias("e"), good.alias("good")).where("good").drop("good")

    @F.pandas_udf("wide boolean, q binary")
    def to_integers(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([integers(np.asarray(v, dtype=np.float64)) for v in batch], columns=["wide", "q"])

    return rows.select("nth", "vec_id", "label", F.size("e").alias("dim"), to_integers("e").alias("i")).select("nth", "vec_id", "label", "dim", "i.*")


def _first() -> list[Column]:
    return [F.col("vec_id").asc_nulls_last(), F.col("nth").asc()]


def without_copies(rows: DataFrame, keep: int, salts: int = 64) -> DataFrame:
    """The first `keep` rows of those with equal vectors and labels. Only groups whose hash is met more often
    are looked at, in two steps, so that no task sorts a large one."""
    rows = rows.withColumn("h", F.xxhash64("q", "label"))
    often = stash(rows.groupBy("h").count().where(F.col("count") > keep).select("h"), "copies")
    if often.isEmpty():
        return rows.drop("h")
    many = rows.join(often, "h", "left_semi").withColumn("salt", F.pmod(F.xxhash64("nth"), F.lit(salts)))
    key = ["dim", "wide", "q", "label"]
    for by in ([*key, "salt"], key):
        many = many.withColumn("n", F.row_number().over(Window.partitionBy(*by).orderBy(*_first()))).where(F.col("n") <= keep).drop("n")
    return rows.join(often, "h", "left_anti").drop("h").unionByName(many.drop("h", "salt"))


def filed(rows: DataFrame, index: Index, block: int = BLOCK) -> DataFrame:
    """rows with their cell (i, j) and part of it; index learns radii and sizes of cells, which are as many as
    codes and pairs of codes."""
    @F.pandas_udf("i int, j int, d double, f double")
    def cells(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for dims, is_wide, q in batches:
            out = np.full((len(dims), 4), -1.0)
            for dim in np.unique(dims[~is_wide]):
                own = np.flatnonzero((dims == dim) & ~is_wide)
                x = np.stack([np.frombuffer(q.iloc[k], "<i4") for k in own]).astype(np.float64)
                i, d, j, f = index.place(int(dim), x)
                out[own] = np.stack((i, d, j, f), axis=1)
            yield pd.DataFrame({"i": out[:, 0].astype("int32"), "j": out[:, 2].astype("int32"), "d": out[:, 1], "f": out[:, 3]})

    placed = stash(rows.withColumn("c", cells("dim", "wide", "q")).select(*rows.columns, "c.*"), "cells")
    for side, (code, far) in enumerate((("i", "d"), ("j", "f"))):
        for r in placed.where(F.col(code) >= 0).groupBy("dim", code).agg(F.max(far).alias("r")).collect():
            dim = r["dim"]
            k = [len(b) for b in index.books[dim]] if dim in index.books else [1, 1]
            radii = index.radii.setdefault(dim, (np.full(k[0], -1.0), np.full(k[1], -1.0)))
            radii[side][r[code]] = r["r"] * (1 + 1e-9) + 1e-9
    sizes = placed.groupBy("dim", "i", "j").agg(F.count("*").alias("n")).withColumn("parts", F.ceil(F.col("n") / block))
    for r in sizes.collect():
        index.rows.setdefault(r["dim"], {})[r["i"], r["j"]] = r["n"]
    parts = F.pmod(F.xxhash64("nth"), F.col("parts")).cast("int").alias("part")
    return placed.drop("d", "f").join(sizes.drop("n"), ["dim", "i", "j"]).select(*rows.columns, "i", "j", parts)


REQUEST = "dim int, i int, j int, part int, tile int, anchor long, own long, wide boolean, q binary, w array<int>, least array<long>, most array<long>"


def requests(anchors: DataFrame, index: Index, again: bool, tiles: int, first: int = FIRST, block: int = BLOCK) -> DataFrame:
    """Cells that anchors (nth, label, dim, wide, q, w, least, most) visit: the first ones until they hold
    `first` rows or, again, those that follow and whose bound reaches the least score wanted."""
    columns = [c.split()[0] for c in REQUEST.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for n, label, dim, is_wide, q, w, least, most in frame.itertuples(index=False):
                wanted = [x for x, y in zip(least, most) if x <= y]
                if not wanted:
                    continue
                floor, held = min(wanted), 0
                a = None if is_wide else np.frombuffer(q, "<i4").astype(np.float64)
                for bound, i, j, rows in index.visits(dim, a):
                    if again and bound < floor or not again and held >= first:
                        break
                    if again == (held >= first):
                        for part in range(-(-rows // block)):
                            out.append((dim, i, j, part, n % tiles, n, label, is_wide, q, w, least, most))
                    held += rows
                if len(out) > 4096:
                    yield pd.DataFrame(out, columns=columns)
                    out = []
            yield pd.DataFrame(out, columns=columns)

    return anchors.select("nth", "label", "dim", "wide", "q", "w", "least", "most").mapInPandas(run, REQUEST)


FOUND = "anchor long, w int, score long, vec_id long, nth long"


def score_blocks(same: bool, keep: int):
    """Of a block of rows and a tile of anchors, the first `keep` rows of each window."""
    kinds = {"anchor": "int64", "w": "int32", "score": "int64", "vec_id": "Int64", "nth": "int64"}

    def run(asked: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if not len(asked) or not len(rows):
            return pd.DataFrame({c: [] for c in kinds}).astype(kinds)
        rows = rows.sort_values(["vec_id", "nth"], na_position="last")
        if rows["wide"].any() or asked["wide"].any():
            b = [exact(x, q) for x, q in zip(rows["wide"], rows["q"])]
            s = np.array([[sum(map(int.__mul__, exact(x, q), v)) for v in b] for x, q in zip(asked["wide"], asked["q"])], dtype=object).reshape(len(asked), len(rows)).astype(np.int64)
        else:
            one, two = (np.stack([np.frombuffer(q, "<i4") for q in x["q"]]).astype(np.float64) for x in (asked, rows))
            s = (one @ two.T).astype(np.int64)
        label, nth = rows["label"].to_numpy(), rows["nth"].to_numpy()
        ids = rows["vec_id"].astype("Int64").array
        out = []
        for k, (n, own, w, least, most) in enumerate(zip(asked["anchor"], asked["own"], asked["w"], asked["least"], asked["most"])):
            able = (label == own) & (nth != n) if same else label != own
            for x, low, high in zip(w, least, most):
                hit = np.flatnonzero(able & (s[k] >= low) & (s[k] <= high))
                if len(hit) > keep:
                    hit = hit[np.argsort(-s[k][hit], kind="stable")[:keep]]
                out.extend((n, x, s[k][h], ids[h], nth[h]) for h in hit)
        return pd.DataFrame(out, columns=list(kinds)).astype(kinds)

    return run


def _floor_div(x: Column, k: int) -> Column:
    return ((x - F.pmod(x, F.lit(k))) / F.lit(k)).cast("long")


def _best(found: DataFrame, keep: int) -> DataFrame:
    order = Window.partitionBy("anchor", "w").orderBy(F.desc("score"), *_first())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep)


def search(anchors: DataFrame, rows: DataFrame, index: Index, same: bool, keep: int, n_anchors: int, first: int = FIRST, block: int = BLOCK, tile: int = TILE) -> DataFrame:
    """anchor, w, score, vec_id, nth, rank: the first `keep` rows of each window of each anchor.
    anchors: as for `requests`; rows: `filed`."""
    tiles = max(1, -(-n_anchors // tile))
    cell = ["dim", "i", "j", "part"]

    def visited(asked: DataFrame) -> DataFrame:
        if tiles == 1:
            near = rows.withColumn("tile", F.lit(0))
        else:
            asked = stash(asked, "requests")
            near = rows.join(asked.select(*cell, F.col("tile").alias("t")).distinct(), cell).withColumnRenamed("t", "tile")
        key = [*cell, "tile"]
        return asked.groupBy(*key).cogroup(near.select(*key, "nth", "vec_id", "label", "wide", "q").groupBy(*key)).applyInPandas(score_blocks(same, keep), FOUND)

    begun = stash(_best(visited(requests(anchors, index, False, tiles, first, block)), keep), "first_cells")
    full = begun.where(F.col("rank") == keep).groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct("w", "score"))).alias("worst"))
    least = F.zip_with("w", "least", lambda w, x: F.coalesce(F.greatest(F.element_at("worst", w), x), x))
    rest = anchors.join(full.withColumnRenamed("anchor", "nth"), "nth", "left").withColumn("least", F.when(F.col("worst").isNull(), F.col("least")).otherwise(least))
    more = visited(requests(rest, index, True, tiles, first, block))
    return stash(_best(begun.drop("rank").unionByName(more), keep), "certified")


def hard_negatives(
    vectors: DataFrame, anchors: Column, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", positives: int = POSITIVES, negatives: int = NEGATIVES,
    least: int = LEAST, most: int = MOST, cell_rows: int = CELL_ROWS, first: int = FIRST, block: int = BLOCK, tile: int = TILE,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score. `anchors` is a condition on
    vec_id; a negative's score is `least` to `most` hundredths of its positive's."""
    bound_batches(vectors.sparkSession)
    every = stash(integer_rows(vectors, vec_id, embedding, label), "integers")
    kept = without_copies(every, max(positives + 1, negatives))
    index = learn(every, cell_rows)
    rows = stash(filed(kept, index, block), "filed")
    one = lambda x: F.array(F.lit(x).cast("long"))
    asked = stash(every.where(anchors).withColumn("w", F.array(F.lit(0))).withColumn("least", one(-ANY)).withColumn("most", one(ANY)), "anchors")
    n = asked.count()
    liked = search(asked, rows, index, True, positives, n, first, block, tile).select("anchor", F.col("rank").alias("w"), F.col("score").alias("positive_score"), F.col("vec_id").alias("positive_id"))
    times = lambda k: F.col("positive_score").cast("decimal(28,0)") * F.lit(k)
    low, high = (-_floor_div(times(-least), 100)).alias("least"), _floor_div(times(most), 100).alias("most")
    windows = liked.groupBy(F.col("anchor").alias("nth")).agg(F.array_sort(F.collect_list(F.struct("w", low, high))).alias("v"))
    windows = windows.select("nth", *[F.col(f"v.{c}").alias(c) for c in ("w", "least", "most")])
    asked = stash(asked.drop("w", "least", "most").join(windows, "nth"), "windows")
    found = search(asked, rows, index, False, negatives, n, first, block, tile).select("anchor", "w", "rank", F.col("score").alias("negative_score"), F.col("vec_id").alias("negative_id"))
    told = found.join(liked, ["anchor", "w"]).join(asked.select(F.col("nth").alias("anchor"), F.col("vec_id").alias("anchor_id")), "anchor")
    return told.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors.withColumn("label", label), F.col("vec_id") % 100 == 0)


ORACLE = """
WITH rows AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
    FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
    SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.q, b.q)::BIGINT AS score
    FROM rows a JOIN rows b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
positives AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM pairs WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
found AS (
    SELECT p.*, n.vec_id AS negative_id, n.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY n.score DESC, n.vec_id) AS rank
    FROM positives p JOIN pairs n ON n.anchor_id = p.anchor_id AND NOT n.same AND 30 * p.positive_score <= 100 * n.score AND 100 * n.score <= 90 * p.positive_score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM found WHERE rank <= 10
"""
