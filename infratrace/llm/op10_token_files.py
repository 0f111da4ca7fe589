"""Token ids in Arrow stream files of equal-length sequences.

Documents are dealt out by ranges of doc_id and encoded in that order; an end id closes each
document. The ids of a range form one run that is cut into sequences of `length` ids, whatever
documents they belong to; the last sequence of a file is padded. A file is one Arrow stream whose
record batches have

- ids: fixed-size list of unsigned ids (16 bits if the vocabulary allows, else 32),
- mask: fixed-size list of booleans, false on padding,
- ends: fixed-size list of booleans, true on the last id of a document,
- doc_ids: list of the documents that end in the sequence,

so that a mapped file gives any sequence and its mask without a copy (`TokenFile.sequence`). The schema's
metadata holds the place of the file (range, number in the range) and, since streams have no footer,
where each record batch begins after the schema: sequence k is in batch k // `batch`, found at once. Spark's own writer commits the
files: each is one row, so a lost executor leaves none behind. Files end in a line feed after the
stream's end mark, which Arrow readers ignore.

The vocabulary is a file of the tokenizers library. That library encodes each different run of
non-space characters once; its normaliser and splitter never look across white space, so the ids are
those of the whole text. Runs in Latin-1 are split here by the vocabulary's pattern and only new words
among them go to the library's merges. What a worker remembers is bounded in bytes, the less recent half
going first; it leaves out runs of more than LONG characters and is dropped when the task ends.

Null texts are empty and consist of the end id. Null doc_ids come first. Rows that repeat a doc_id
stay separate, in the order of their texts' hashes. An empty table gives files without sequences and an
empty result; other columns are left out of the files.
"""

from __future__ import annotations

import os
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bound_batches, shared_path, source_order, stash, table
from .op7_bpe import byte_letters

PATH = public_tokenizers.path("word_bpe_49k.json")
END = 2
#: Ids in a sequence, sequences in a record batch, ids in a file at most (but for the last document's).
LENGTH, BATCH, FILE_IDS = 1024, 256, 8_000_000
#: Bytes of runs and words that a worker remembers within a task, about, and as much of what it had
#: before; what one takes besides its letters and ids; and characters of a run that is not remembered.
CACHE_BYTES, ENTRY, LONG = 64 << 20, 200, 1024
#: Characters that Python's split() takes for white space and the vocabulary does not.
ODD = "\x1c\x1d\x1e\x1f"


#: Fixed value: the vocabulary's splitting pattern, for lower-case text in Latin-1.
SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.letters = dict(enumerate(byte_letters()))
        self.code = "H" if self.tokenizer.get_vocab_size() <= 1 << 16 else "I"
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.forget()

    def forget(self) -> None:
        """Drop what texts have left behind."""
        self.known: dict[str, bytes] = {}  # runs that go through the whole library
        self.plain: dict[str, bytes] = {}  # Latin-1 runs and the words they are cut into, which are runs of their own
        self.older: tuple[dict[str, bytes], dict[str, bytes]] = {}, {}
        self.held = 0

    def renew(self) -> None:
        self.older = self.known, self.plain
        self.known, self.plain, self.held = {}, {}, 0

    def keep(self, held: dict[str, bytes], key: str, ids: bytes) -> None:
        if len(key) <= LONG:
            held[key] = ids
            self.held += ENTRY + len(key) + len(ids)

    def library(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype=self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def word(self, word: str) -> bytes:
        """Ids of what the splitter yields: the library's merges alone."""
        spelt = word if word.isascii() else word.encode("utf-8").decode("latin-1")
        return array(self.code, [t.id for t in self.model.tokenize(spelt.translate(self.letters))]).tobytes()

    def run(self, run: str) -> bytes:
        """Ids of a lower-case run of Latin-1 characters other than spaces."""
        found = self.older[1].get(run)
        if found is None:
            if "<|" in run:  # may hold a special token
                found = self.library([run])[0]
            else:
                words = SPLIT.findall(run)
                found = self.word(run) if len(words) == 1 else b"".join([self.plain.get(w) or self.run(w) for w in words])
        self.keep(self.plain, run, found)
        return found

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Packed ids of each whole text.

        In Latin-1 the normaliser only lowers letters, one for one, so differently written forms
        share what is remembered; other runs go through the whole library.
        """
        out = []
        for text in texts:
            if self.held > CACHE_BYTES:
                self.renew()
            known, plain, older = self.known, self.plain, self.older[0]
            text = text if isinstance(text, str) else ""
            if any(c in text for c in ODD):
                out.append(self.library([text])[0])
            elif _latin(text):
                words = text.lower().split()
                long = {}
                for w in set(words).difference(plain):
                    ids = self.run(w)
                    if len(w) > LONG:
                        long[w] = ids
                out.append(b"".join([long[w] if w in long else plain[w] for w in words] if long else map(plain.__getitem__, words)))
            else:
                words = text.split()
                now = {w: older[w] for w in words if w in older}
                fresh = list({w for w in words if w not in known and w not in now})
                now.update(zip(fresh, self.library(fresh)))
                out.append(b"".join([known[w] if w in known else now[w] for w in words]))
                for w, ids in now.items():
                    self.keep(known, w, ids)
        return out


def _latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One for each Python worker."""
    return Encoder(path)


def _schema(dtype: np.dtype, length: int, meta: dict) -> pa.Schema:
    kind = pa.uint16() if dtype.itemsize == 2 else pa.uint32()
    fields = [("ids", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length)), ("ends", pa.list_(pa.bool_(), length)), ("doc_ids", pa.list_(pa.int64()))]
    return pa.schema(fields, metadata={k: str(v) for k, v in meta.items()})


def stream(ids: np.ndarray, sizes: list[int], doc_ids: list[int | None], length: int, batch: int, meta: dict) -> bytes:
    """One file: the run `ids` of documents that have `sizes` ids."""
    n = -(-len(ids) // length)
    full = np.zeros(n * length, dtype=ids.dtype)
    full[:len(ids)] = ids
    last = np.cumsum(np.array(sizes, dtype=np.int64)) - 1
    mask, ends = np.zeros(n * length, dtype=bool), np.zeros(n * length, dtype=bool)
    mask[:len(ids)] = True
    ends[last] = True
    per = np.searchsorted(last, np.arange(n + 1, dtype=np.int64) * length)
    docs = pa.array(doc_ids, type=pa.int64())
    schema, parts, starts = _schema(ids.dtype, length, {}), [], [0]
    for at in range(0, n, batch):
        to = min(n, at + batch)
        cut = slice(at * length, to * length)
        fixed = [pa.FixedSizeListArray.from_arrays(pa.array(x[cut]), length) for x in (full, mask, ends)]
        lists = pa.ListArray.from_arrays(pa.array(per[at:to + 1] - per[at], type=pa.int32()), docs[int(per[at]):int(per[to])])
        parts.append(pa.record_batch([*fixed, lists], schema=schema))
        starts.append(starts[-1] + parts[-1].serialize().size)
    schema = _schema(ids.dtype, length, meta | {"batch": batch, "sequences": n, "starts": ",".join(map(str, starts[:-1]))})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, schema) as out:
        for part in parts:
            out.write_batch(part.replace_schema_metadata(schema.metadata))
    return sink.getvalue().to_pybytes()


class TokenFile:
    """Any sequence of a file by its number; over a memory map or a buffer without a copy."""

    def __init__(self, source: pa.Buffer | bytes | pa.NativeFile):
        self.source = source if isinstance(source, pa.NativeFile) else pa.BufferReader(source)
        self.schema = pa.ipc.read_schema(pa.ipc.read_message(self.source))
        self.begin = self.source.tell()
        meta = {k.decode(): v.decode() for k, v in self.schema.metadata.items()}
        self.batch, self.length, self.place = int(meta["batch"]), int(meta["sequences"]), (int(meta["range"]), int(meta["number"]))
        self.starts = [int(x) for x in meta["starts"].split(",") if x]

    def __len__(self) -> int:
        return self.length

    def record_batch(self, number: int) -> pa.RecordBatch:
        self.source.seek(self.begin + self.starts[number])
        return pa.ipc.read_record_batch(pa.ipc.read_message(self.source), self.schema)

    def sequence(self, k: int) -> tuple[np.ndarray, pa.BooleanArray]:
        """The ids of sequence k and their mask."""
        if not 0 <= k < self.length:
            raise IndexError(k)
        own = self.record_batch(k // self.batch).slice(k % self.batch, 1)
        return own.column("ids").flatten().to_numpy(zero_copy_only=True), own.column("mask").flatten()


def sequences(source: pa.Buffer | bytes | pa.NativeFile) -> Iterator[pa.RecordBatch]:
    """Record batches of a file; over a memory map or a buffer their lists are views of it."""
    reader = pa.ipc.open_stream(source)
    yield from reader


def fixed_view(batch: pa.RecordBatch, column: str = "ids") -> np.ndarray:
    """The ids of a batch as a matrix, without a copy."""
    col = batch.column(column)
    return col.flatten().to_numpy(zero_copy_only=True).reshape(len(batch), -1)


def write_token_files(docs: DataFrame, out: str, text: str = "text", doc_id: str = "doc_id", path: str = PATH, end: int = END, length: int = LENGTH, batch: int = BATCH, file_ids: int = FILE_IDS) -> None:
    """Write the files of docs to the folder `out`, in ascending doc_id order."""
    bound_batches(docs.sparkSession)

    def pack(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        enc, part, number = encoder(path), TaskContext.get().partitionId(), 0
        tail = np.array([end], dtype=enc.dtype).tobytes()
        runs, sizes, ids, size = [], [], [], 0

        def file() -> pd.DataFrame:
            run = np.frombuffer(b"".join(runs), dtype=enc.dtype)
            blob = stream(run, sizes, ids, length, batch, {"range": part, "number": number, "length": length})
            return pd.DataFrame({"blob": [blob]})

        try:
            for frame in rows:
                for i, packed in zip(frame["doc_id"].tolist(), enc.encode(frame["text"].tolist())):
                    runs += [packed, tail]
                    sizes.append(len(packed) // enc.dtype.itemsize + 1)
                    ids.append(None if i is None or i != i else int(i))
                    size += sizes[-1]
                    if size >= file_ids:
                        yield file()
                        runs, sizes, ids, size, number = [], [], [], 0, number + 1
            if sizes:
                yield file()
        finally:
            enc.forget()

    chosen = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), source_order().alias("nth"))
    keys = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), "nth"]
    dealt = chosen.repartitionByRange(*keys).sortWithinPartitions(*keys).select("doc_id", "text")
    blobs = dealt.mapInPandas(pack, "blob binary")
    blobs.select(F.col("blob").cast("string").alias("value")).write.option("maxRecordsPerFile", 1).text(out)


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, range, number, local_start, ids (packed unsigned 32 bits) of each document in the files."""
    def unpack(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in rows:
            for blob in frame["content"]:
                if len(blob) < 8:
                    continue
                place = TokenFile(blob).place
                at, held = 0, []
                for part in sequences(blob):
                    ids = fixed_view(part).reshape(-1)
                    flags = [np.asarray(part.column(c).flatten().to_numpy(zero_copy_only=False)) for c in ("mask", "ends")]
                    ids = ids[flags[0]]
                    cuts = (np.flatnonzero(flags[1]) + 1).tolist()
                    docs, texts, begun = part.column("doc_ids").flatten().to_pylist(), [], 0
                    starts, ends = [], []
                    for c in cuts:
                        held.append(ids[begun:c])
                        run = np.concatenate(held).astype("<u4")
                        texts.append(run.tobytes())
                        starts.append(at)
                        ends.append(len(run))
                        at, begun, held = at + len(run), c, []
                    held.append(ids[begun:])
                    yield pd.DataFrame({"doc_id": pd.array(docs, dtype="Int64"), "range": place[0], "number": place[1], "local_start": starts, "n_tokens": ends, "ids": texts})

    files = spark.read.format("binaryFile").load(folder).select("content")
    return files.mapInPandas(unpack, "doc_id long, range int, number int, local_start long, n_tokens long, ids binary")


def with_starts(docs: DataFrame) -> DataFrame:
    """Add start: the ids of all documents before this one. One row a file decides it."""
    files = docs.groupBy("range", "number").agg(F.sum("n_tokens").alias("size"))
    before = Window.orderBy("range", "number").rowsBetween(Window.unboundedPreceding, -1)
    base = files.select("range", "number", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("base"))
    return docs.join(base, ["range", "number"]).withColumn("start", F.col("base") + F.col("local_start")).drop("base")


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_path(spark, "token_files")
    write_token_files(table(spark, sf_dir, "documents"), folder)
    bound_batches(spark)
    read = read_token_files(spark, folder)
    short = stash(read.select("doc_id", "range", "number", "local_start", "n_tokens", F.crc32("ids").alias("ids_crc32")), "token_digests")
    return with_starts(short).select("doc_id", "start", "n_tokens", "ids_crc32")
