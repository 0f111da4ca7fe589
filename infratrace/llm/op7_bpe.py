"""Byte-level BPE encoding through a trie of distinct words, and decoding.

A word's encoding ends in one token, and what stands before that token is the encoding of the shorter
prefix: so the last token of every prefix is all there is to know. The distinct words of a batch go
into a trie; a depth-first walk gives each node the last token of its prefix, namely the only
vocabulary token that ends there and stays whole beside the last token of the prefix before it. Shared
prefixes are worked out once; a word's ids are read back from its end. Two tokens stay whole beside
each other if, of the pieces that face each other while both are built, none would merge sooner than
the next merge of their own tokens; this gives the ids that merging in rank order gives.

The vocabulary is a file of the tokenizers library (byte-level BPE without added prefix space) found
by `path` on every executor. Its added tokens are cut out of the text first, as that library does.

Null texts are empty: no ids, decoded to an empty text. Texts of any length are encoded whole. What a
worker remembers between batches is bounded in bytes and dropped when its task ends; words of more than
LONG characters are walked by themselves and not remembered. Rows and other columns stay as they are,
repeated rows included.
"""

from __future__ import annotations

import gc
import json
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType, StructType

from .common import bound_batches, table

PATH = public_tokenizers.path("byte_bpe_50k.json")
#: Bytes of pieces and words that a worker remembers within a task, about; twice that while the older
#: ones are let go. ENTRY is what one takes besides its letters and ids.
CACHE_BYTES, ENTRY = 40 << 20, 230
#: Pairs of tokens, and steps beyond the vocabulary's own, that a worker remembers.
PAIRS, STEPS = 150_000, 150_000
#: Characters of a word that is walked by itself, and of the words that share a trie.
LONG, TRIE = 1024, 1 << 18

#: The white space of the vocabulary's splitting pattern, and that pattern.
SPACE = r"\t-\r \x85\xa0  -     　"
SPLIT = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
MARKS = (".", ",", "!", "?", ":", ";")
#: Where cutting a text at its spaces could part a run of white space.
RUN = re.compile(r"\s (?:\s|\Z)")


def byte_letters() -> list[str]:
    """The letter that stands for each byte in vocabulary files of byte-level BPE."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class Vocabulary:
    """Tokens, merges and the encodings found so far."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte_of = {c: b for b, c in enumerate(byte_letters())}
        added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        vocab = spec["model"]["vocab"]
        self.token = {i: bytes(byte_of[c] for c in t) for t, i in vocab.items() if t not in added}
        self.token |= {i: t.encode() for t, i in added.items()}
        self.added = {t: i.to_bytes(4, "little") for t, i in added.items()}
        self.cut_added = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.rank: dict[tuple[int, int], int] = {}
        self.made: dict[int, tuple[int, int, int]] = {}  # token: rank, left, right
        for n, merge in enumerate(spec["model"]["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            pair = (vocab[left], vocab[right])
            self.rank[pair] = n
            self.made.setdefault(vocab[left + right], (n, *pair))
        self.whole: dict[tuple[int, int], bool] = {}
        self.id_of: dict[bytes, int] = {}
        special = {*added.values()}
        for i in sorted(self.token, key=lambda i: self.made.get(i, (-1,))[0]):
            made = self.made.get(i)
            if i not in special and (len(self.token[i]) == 1 or made and self.stay_whole(made[1], made[2], made[0])):
                self.id_of[self.token[i]] = i
        self.suffixes()
        del self.id_of  # the states hold it now
        self.split = regex.compile(SPLIT)
        self.words: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}  # what follows a space, with that space
        self.older: tuple[dict[str, bytes], dict[str, bytes]] = {}, {}  # both as they were before the last renewal
        self.held = 0
        self.whole.clear()

    def forget(self) -> None:
        """Drop what texts have left behind; the vocabulary stays."""
        self.words, self.pieces, self.older, self.held = {}, {}, ({}, {}), 0
        self.whole.clear()

    def suffixes(self) -> None:
        """States that know which tokens end where a text has been read to, longest first."""
        step: dict[int, int] = {}  # state * 256 + byte: state
        ends: list[tuple] = [()]
        queue: list[tuple[int, int, int]] = []
        for raw, i in self.id_of.items():
            state = 0
            for b in raw:
                at = state << 8 | b
                if at not in step:
                    step[at] = len(ends)
                    ends.append(())
                    queue.append((len(ends) - 1, state, b))
                state = step[at]
            ends[state] = ((len(raw), i),)
        deep = [0] * len(ends)
        for state, parent, _ in queue:
            deep[state] = deep[parent] + 1
        queue.sort(key=lambda x: deep[x[0]])
        fall = [0] * len(ends)
        for state, parent, b in queue:
            if parent:
                back = fall[parent]
                while back and back << 8 | b not in step:
                    back = fall[back]
                fall[state] = step.get(back << 8 | b, 0)
            ends[state] += ends[fall[state]]
        self.step, self.ends, self.fall, self.steps = step, ends, fall, len(step) + STEPS

    def follow(self, state: int, b: int) -> int:
        at = state << 8 | b
        while state and state << 8 | b not in self.step:
            state = self.fall[state]
        found = self.step.get(state << 8 | b, 0)
        if len(self.step) < self.steps:
            self.step[at] = found
        return found

    def stay_whole(self, a: int, b: int, until: float = float("inf")) -> bool:
        """No merge of rank below `until` crosses the border between tokens a and b."""
        made, rank = self.made, self.rank
        end_a = end_b = until
        while True:
            crossing = rank.get((a, b))
            if crossing is not None and crossing < end_a and (crossing <= end_b if end_b < until else crossing < until):
                return False
            at_a, at_b = made.get(a), made.get(b)
            if at_a is None and at_b is None:
                return True
            if at_b is None or (at_a is not None and at_a[0] > at_b[0]):
                end_a, a = at_a[0], at_a[2]
            else:
                end_b, b = at_b[0], at_b[1]

    def beside(self, a: int, b: int) -> bool:
        if len(self.whole) > PAIRS:
            self.whole.clear()
        found = self.whole[a, b] = self.stay_whole(a, b)
        return found

    def chain(self, raw: bytes) -> bytes:
        """Encode one word, however long, by the same walk over its only path."""
        last, state, whole, token = [0], 0, self.whole, self.token
        for depth, b in enumerate(raw, 1):
            state = self.step[at] if (at := state << 8 | b) in self.step else self.follow(state, b)
            for n, end in self.ends[state]:
                if n == depth:
                    break
                pair = (last[depth - n], end)
                if whole[pair] if pair in whole else self.beside(*pair):
                    break
            last.append(end)
        ids, at = [], len(raw)
        while at:
            ids.append(last[at])
            at -= len(token[last[at]])
        ids.reverse()
        return array("I", ids).tobytes()

    def walk(self, words: list[str]) -> None:
        """Encode distinct words by one depth-first walk over their trie."""
        root: dict = {}
        deepest = 0
        for word in words:
            raw, node = word.encode("utf-8"), root
            for b in raw:
                if (child := node.get(b)) is None:
                    child = node[b] = {}
                node = child
            node[-1] = word
            deepest = max(deepest, len(raw))
        last = [0] * (deepest + 1)
        step, ends, whole, token, done = self.step, self.ends, self.whole, self.token, self.words
        todo = [(b, child, 1, 0) for b, child in root.items()]
        while todo:
            b, node, depth, state = todo.pop()
            while True:  # down to the next fork
                state = step[at] if (at := state << 8 | b) in step else self.follow(state, b)
                for n, end in ends[state]:
                    if n == depth:
                        break
                    pair = (last[depth - n], end)
                    if whole[pair] if pair in whole else self.beside(*pair):
                        break
                last[depth] = end
                if -1 in node:
                    ids, at = [end], depth - n
                    while at:
                        ids.append(end := last[at])
                        at -= len(token[end])
                    ids.reverse()
                    done[node.pop(-1)] = array("I", ids).tobytes()
                if not node:
                    break
                depth += 1
                b, child = node.popitem()
                if node:
                    todo += [(c, other, depth, state) for c, other in node.items()]
                node = child

    def learn(self, words: set[str]) -> None:
        held, older = self.words, self.older[1]
        new = [x for x in words if x not in held]
        held.update((x, older[x]) for x in new if x in older)
        part, size = [], 0
        for x in sorted(x for x in new if x not in older):
            if len(x) > LONG:
                held[x] = self.chain(x.encode("utf-8"))
                continue
            part.append(x)
            size += len(x)
            if size > TRIE:
                self.walk(part)
                part, size = [], 0
        self.walk(part)
        self.held += ENTRY * len(new) + sum(len(x) + len(held[x]) for x in new)

    def cut_piece(self, piece: str) -> list[str]:
        """The words of what stands between a space (which is theirs) and the next."""
        if piece.isalpha():
            return [" " + piece]
        if piece[-1:] in MARKS and piece[:-1].isalpha():
            return [" " + piece[:-1], piece[-1]]
        return self.split.findall(" " + piece)

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Packed ids (unsigned 32 bits, little-endian) of each text."""
        running = gc.isenabled()
        gc.disable()  # nothing here forms cycles, and a trie is many containers
        try:
            return self._encode(texts)
        finally:
            if running:
                gc.enable()

    def _encode(self, texts: list[str]) -> list[bytes]:
        if self.held > CACHE_BYTES:
            self.older = self.pieces, self.words
            self.pieces, self.words, self.held = {}, {}, 0
        parts = [self.cut_added.split(x) if self.cut_added and any(t in x for t in self.added) else [x] for x in texts]
        cut: list[list] = []
        fresh: dict[str, list[str]] = {}
        words: set[str] = set()
        known, older = self.pieces, self.older[0]
        for text in parts:
            own = []
            for k, part in enumerate(text):
                if k % 2:
                    own.append(self.added[part])
                elif RUN.search(part):
                    found = self.split.findall(part)
                    words.update(found)
                    own.append((found, ()))
                else:
                    first, *rest = part.split(" ")
                    for piece in set(rest):
                        if piece not in known and piece not in fresh:
                            if piece in older:
                                known[piece] = older[piece]
                            else:
                                fresh[piece] = self.cut_piece(piece)
                                words.update(fresh[piece])
                    found = self.split.findall(first)
                    words.update(found)
                    own.append((found, rest))
            cut.append(own)
        self.learn(words)
        word, pieces = self.words.__getitem__, self.pieces
        for piece, found in fresh.items():
            pieces[piece] = b"".join(map(word, found))
        self.held += ENTRY * len(fresh) + sum(len(x) + len(pieces[x]) for x in fresh)
        piece = pieces.__getitem__
        out = [b"".join(x if isinstance(x, bytes) else b"".join(map(word, x[0])) + b"".join(map(piece, x[1])) for x in own) for own in cut]
        for held, used in ((pieces, fresh), (self.words, words)):
            for x in used:
                if len(x) > LONG:
                    self.held -= ENTRY + len(x) + len(held.pop(x))
        return out

    def decode(self, packed: bytes) -> str:
        return b"".join(map(self.token.__getitem__, np.frombuffer(packed, dtype="<u4").tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    """One for each Python worker."""
    found = Vocabulary(path)
    gc.freeze()
    return found


#: Rows, and characters (but for the last text's), whose words are looked up together.
ROWS, CHARS = 512, 2_000_000


def _encoded(v: Vocabulary, texts: pd.Series) -> list[bytes]:
    out, held, size = [], [], 0
    for x in texts:
        held.append(x if isinstance(x, str) else "")
        size += len(held[-1])
        if len(held) == ROWS or size > CHARS:
            out += v.encode_batch(held)
            held, size = [], 0
    return out + v.encode_batch(held)


def _with_vocabulary(path: str, work):
    """An iterator function over batches whose worker forgets what it remembered when it ends."""
    def run(batches: Iterator[pd.Series]) -> Iterator:
        v = vocabulary(path)
        try:
            for batch in batches:
                yield work(v, batch)
        finally:
            v.forget()
    return run


def encode_udf(path: str = PATH):
    """text -> packed ids."""
    def ids(v: Vocabulary, texts: pd.Series) -> pd.Series:
        return pd.Series(_encoded(v, texts), dtype=object)

    @F.pandas_udf(BinaryType())
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from _with_vocabulary(path, ids)(batches)
    return encode


def decode_udf(path: str = PATH):
    """packed ids -> text; bytes that are no UTF-8 become U+FFFD. Null stays null."""
    def texts(v: Vocabulary, ids: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else v.decode(x) for x in ids], dtype=object)

    @F.pandas_udf(StringType())
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from _with_vocabulary(path, texts)(batches)
    return decode


def encode_decode_udf(path: str = PATH):
    """text -> packed ids and the text decoded from them."""
    def both_of(v: Vocabulary, texts: pd.Series) -> pd.DataFrame:
        ids = _encoded(v, texts)
        return pd.DataFrame({"ids": pd.Series(ids, dtype=object), "decoded": pd.Series([v.decode(x) for x in ids], dtype=object)})

    @F.pandas_udf(StructType().add("ids", BinaryType()).add("decoded", StringType()))
    def both(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        yield from _with_vocabulary(path, both_of)(batches)
    return both


def encode_documents(docs: DataFrame, text: str = "text", path: str = PATH, ids: str = "token_ids", decoded: str | None = None) -> DataFrame:
    """docs with the packed ids of `text` and, if named, the text decoded from them.

    Columns of docs that bear these names are replaced.
    """
    bound_batches(docs.sparkSession)
    if decoded is None:
        return docs.withColumn(ids, encode_udf(path)(F.col(text)))
    old = [c for c in docs.columns if c not in (ids, decoded)]
    out = docs.select(*old, encode_decode_udf(path)(F.col(text)).alias("_both"))
    return out.select(*old, F.col("_both.ids").alias(ids), F.col("_both.decoded").alias(decoded))


def decode_documents(docs: DataFrame, ids: str = "token_ids", path: str = PATH, text: str = "decoded") -> DataFrame:
    bound_batches(docs.sparkSession)
    return docs.withColumn(text, decode_udf(path)(F.col(ids)))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = encode_documents(docs, ids="ids", decoded="decoded")
    return done.select("doc_id", F.expr("cast(length(ids) div 4 as bigint)").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
