"""Documents through the corpus operators, one after the other.

Language ID drops documents without a recognised language, near-duplicate search keeps one document
of each class, the secret scan masks live secrets, mixing repeats and cuts documents to the sources'
targets, and encoding adds token ids. Texts are joined to decisions by a digest of the row, so equal
rows share a decision and only keys are grouped.

Documents travel in one struct while a stage works on them, so columns besides those of `documents`
may bear any names; they come out as they came in. Null doc_ids, texts and sources are values of their
own. A stage gives an empty result for an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType, VariantType

from infratrace.llm import common, op2_mixing, op4_language, op5_secrets, op6_simhash, op7_bpe

#: A language must be this likely.
MIN_SCORE = 0.3
#: Words of a shingle, and the share of shingles that near duplicates have in common.
SHINGLE, SIMILARITY = 5, 0.8
MASK = "[SECRET]"


def _plain(c: Column, kind: DataType) -> Column:
    """c in types that can be hashed: maps as sorted entries, variants as JSON, and whether a value is null
    beside each value, at any depth."""
    if isinstance(kind, MapType):
        value = lambda e: F.struct(e["key"].alias("k"), _plain(e["value"], kind.valueType).alias("v"))
        # keys of a map differ, so they alone order its entries; a structured key is told by its own hash
        entries = F.array_sort(F.transform(F.map_entries(c), lambda e: F.struct(F.xxhash64(_plain(e["key"], kind.keyType)).alias("h"), value(e).alias("e"))))
        inner = F.struct(F.size(c), F.transform(entries, lambda x: x["e"]))
    elif isinstance(kind, ArrayType):
        inner = F.struct(F.size(c), F.transform(c, lambda x: _plain(x, kind.elementType)))
    elif isinstance(kind, StructType):
        inner = F.struct(*[_plain(c.getField(f.name), f.dataType).alias(f"f{i}") for i, f in enumerate(kind)])
    elif isinstance(kind, VariantType):
        inner = F.to_json(c)
    else:
        inner = c
    return F.struct(c.isNull().alias("n"), inner.alias("v"))


def _key(docs: DataFrame) -> Column:
    """A row in one value that is never null: only rows equal in every column share it."""
    plain = [_plain(F.col(f"`{f.name}`"), f.dataType) for f in docs.schema]
    text = F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    return F.concat(text, F.hex(F.xxhash64(*plain)))


def _rows(docs: DataFrame) -> DataFrame:
    """row (a struct of all columns), key and text."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), _key(docs).alias("key"), F.col("text").alias("text"))


def _with_text(columns: list[str], text, changed):
    """row with another text where `changed`; n_chars, if there is such a column, follows."""
    out = F.col("row").withField("text", text)
    if "n_chars" in columns:
        out = out.withField("n_chars", F.when(changed, F.length(text).cast("long")).otherwise(F.col("row.n_chars")))
    return out.alias("row")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language; those without a letter or without a likely language go."""
    net = op4_language.train(docs.where(~op4_language.held_out(F.col("doc_id"))))
    told = op4_language.identify(_rows(docs), net)
    return told.where((F.col("lang_pred") != op4_language.NONE) & (F.col("score") >= MIN_SCORE)).select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of texts that share 0.8 of their five-word shingles: the smallest
    doc_id and, of its rows, that of the smallest key.

    At 0.8 most pairs differ in more bits than deletion variants reach: these find one pair in ten and
    MinHash bands the others. Every pair is compared exactly."""
    found = op6_simhash.near_duplicates(docs, shingle=SHINGLE, similarity=SIMILARITY, keep={"key": _key(docs)})
    order = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "key")
    best = common.stash(found.groupBy("component").agg(F.min(order).alias("k")).select("k.key"), "kept")
    return _rows(docs).join(best, "key", "left_semi").dropDuplicates(["key"]).select("row.*")


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Live secrets are masked; widely copied examples and everything else stay."""
    found = op5_secrets.find_secrets(docs, repo=F.col("doc_id"), owner=F.col("source"), keep={"key": _key(docs)})
    live = F.filter("secrets", lambda s: s["label"] == "live")
    spans = common.stash(found.select("key", live.alias("live")).where(F.size("live") > 0).dropDuplicates(["key"]), "live")
    told = _rows(docs).join(spans, "key", "left")
    clean = op5_secrets.masked(F.col("text"), F.col("live"), MASK)
    return told.select(_with_text(docs.columns, clean, F.col("live").isNotNull())).select("row.*")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each copy that the mix takes; where it takes the beginning of a text, these words. Texts move once,
    to their keys, and are not moved again into the order of the mix."""
    queued = common.stash(op2_mixing.queue(docs, {"key": _key(docs)}), "queue")
    taken = op2_mixing.by_copy(op2_mixing.mix(queued)).join(queued.select("nth", "size"), "nth").select("kept.key", "words", "size")
    taken = common.stash(taken, "mix")
    common.discard(queued)
    texts = _rows(docs).dropDuplicates(["key"])
    told = texts.join(taken, "key")
    whole = F.col("words") >= F.col("size")
    text = F.when(whole, F.col("text")).otherwise(op2_mixing.first_words(F.col("text"), F.col("words")))
    return told.select(_with_text(docs.columns, text, ~whole)).select("row.*")


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document with its token ids (packed, unsigned 32 bits) in place of its text; columns named
    token_ids and n_tokens are replaced."""
    done = op7_bpe.encode_documents(docs, ids="token_ids")
    return done.withColumn("n_tokens", F.expr("cast(length(token_ids) div 4 as bigint)")).drop("text")


STAGES = [
    ("language", language),
    ("near duplicates", near_duplicates),
    ("secrets", secrets),
    ("mixing", mixing),
    ("encoding", encoding),
]

#: A trained network and fingerprints have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents, writing each one's result before the next reads it."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        done = common.stash(stage(spark, docs, sf_dir), name.replace(" ", "_"))
        if hasattr(docs, "_stashed"):
            common.discard(docs)
        docs = done
    return docs
