"""Byte-level BPE encoding and decoding with the ``tokenizers`` library over Arrow batches.

A batch is cut into the matches of the public split pattern at once, by rules on runs of character classes. Bytes are
mapped to the printable characters in which the vocabulary is written, distinct pieces of the batch are encoded once by
the library's BPE model (equal hashes are confirmed by comparing bytes), and ids are gathered back in text order, with
the byte and character offsets of every token. Pieces met before are kept in a bounded cache of the worker.
Decoding reverses the byte table; a token may end inside a character, so bytes are joined before they become text.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import json
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chars import BLANK, LETTER, OTHER, byte_starts, classes, code_points
from .scratch import small_batches
from .text import Ranges, distinct, gathered, lists, same_bytes, sized, utf8

RANKS, VOCABULARY = "byte_bpe_50k.tiktoken", "byte_bpe_50k.json"
CACHE_PIECES = 300_000


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_characters() -> np.ndarray:
    """Code point for each byte: itself where printable, else the next of U+0100 onwards."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = np.zeros(256, np.uint32)
    out[shown] = shown
    hidden = [b for b in range(256) if b not in shown]
    out[hidden] = 0x100 + np.arange(len(hidden))
    return out


def piece_starts(cp: np.ndarray, first: np.ndarray) -> np.ndarray:
    r"""Where a match of the split pattern begins; first: where a text begins. Every character is in one match.

    Runs of letters, numbers, blanks and others are matches, but the last blank of a run before other text stands
    apart: a plain space joins the run after it. An apostrophe alone, joined by no space, takes the contraction after it.
    """
    kind = classes()[cp]
    begin = first.copy()
    begin[1:] |= kind[1:] != kind[:-1]
    at = np.flatnonzero(begin)
    to = np.append(at[1:], len(cp))
    out = begin.copy()
    more = to < len(cp)
    more[more] &= ~first[to[more]]
    blank = more & (kind[at] == BLANK)
    last = to[blank] - 1
    out[last] = True
    out[last[cp[last] == 0x20] + 1] = False
    mark = more & (kind[at] == OTHER) & (to - at == 1) & (cp[at] == 0x27) & out[at]
    mark[mark] &= kind[to[mark]] == LETTER
    follows = np.flatnonzero(mark) + 1
    p, end = at[follows], to[follows]
    c1 = cp[p].astype(np.int64)
    c2 = np.where(p + 1 < end, cp[np.minimum(p + 1, len(cp) - 1)], 0)
    one = np.isin(c1, [ord(c) for c in "stmd"])
    two = ((c1 == ord("r")) | (c1 == ord("v"))) & (c2 == ord("e")) | (c1 == ord("l")) & (c2 == ord("l"))
    size = np.where(one, 1, np.where(two, 2, 0))
    out[p[size > 0]] = False
    rest = p + size
    out[rest[(size > 0) & (rest < end)]] = True
    return np.flatnonzero(out)


class Memo:
    """Ids of the first ``limit`` byte strings met, which hold the frequent ones; others are spelled each time. A string
    is taken for a known one only if their bytes are equal."""

    def __init__(self, spell, limit: int):
        """spell: (data, start, end) -> ids of the strings in a row, and how many each has. Strings met: hash and number
        in the order of the hashes; ids and bytes by number."""
        self.spell, self.limit = spell, limit
        self.known, self.where = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.ids, self.ends = np.zeros(0, np.int32), np.zeros(1, np.int64)
        self.body, self.body_ends = np.zeros(0, np.uint8), np.zeros(1, np.int64)

    def _learn(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, h: np.ndarray, ids: np.ndarray, n: np.ndarray) -> None:
        one, first = np.unique(h, return_index=True)
        at = np.searchsorted(self.known, one)
        inside = at < len(self.known)
        new = ~inside
        new[inside] = self.known[at[inside]] != one[inside]  # a hash stands for one string
        keep = np.zeros(len(h), bool)
        keep[first] = new
        body, bounds = gathered(data, start[keep], end[keep])
        number = np.cumsum(keep) - 1 + len(self.ends) - 1
        self.ids, self.ends = np.concatenate([self.ids, ids[np.repeat(keep, n)]]), np.concatenate([self.ends, self.ends[-1] + np.cumsum(n[keep])])
        self.body, self.body_ends = np.concatenate([self.body, body]), np.concatenate([self.body_ends, self.body_ends[-1] + bounds[1:]])
        self.known, self.where = np.insert(self.known, at[new], one[new]), np.insert(self.where, at[new], number[first[new]])

    def find(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, h: np.ndarray) -> np.ndarray:
        """Numbers of the distinct strings data[start:end] with hashes h, -1 for those that are not held."""
        out = np.full(len(h), -1)
        if len(self.known):
            slot = np.minimum(np.searchsorted(self.known, h), len(self.known) - 1)
            out = np.where(self.known[slot] == h, self.where[slot], -1)
        met = np.flatnonzero(out >= 0)
        begin, size = self.body_ends[out[met]], end[met] - start[met]
        equal = size == self.body_ends[out[met] + 1] - begin
        equal &= same_bytes(data, start[met], self.body, begin, np.where(equal, size, 0))
        out[met[~equal]] = -1
        return out

    def encode(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, h: np.ndarray, back: np.ndarray, found: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids in a row, and how many for each, of the strings back of the distinct strings data[start:end]; h: hashes;
        found: what find() gives, where the caller has it."""
        out = self.find(data, start, end, h) if found is None else found.copy()
        new = np.flatnonzero(out < 0)
        ids, ends = self.ids, self.ends
        if len(new):
            got, n = self.spell(data, start[new], end[new])
            out[new] = len(ends) - 1 + np.arange(len(new))
            ids, ends = np.concatenate([ids, got]), np.concatenate([ends, ends[-1] + np.cumsum(n)])
            if len(self.known) < self.limit:
                self._learn(data, start[new], end[new], h[new], got, n)
        number = out[back]
        n = ends[number + 1] - ends[number]
        total = np.cumsum(n)
        return ids[np.repeat(ends[number] - (total - n), n) + np.arange(total[-1] if len(n) else 0)], n


class Codec:
    """The vocabulary, and ids of the pieces met so far."""

    def __init__(self, ranks: str, vocabulary: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a worker has one core
        from tokenizers import Tokenizer, models, pre_tokenizers

        with open(vocabulary, encoding="utf-8") as f:
            model = json.load(f)["model"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.mark = 1 + max(model["vocab"].values())  # "\n" begins a piece: no byte is written so, and it merges with nothing
        self.model = Tokenizer(models.BPE(vocab=model["vocab"] | {"\n": self.mark}, merges=merges, cache_capacity=0))
        self.model.pre_tokenizer = pre_tokenizers.Split("\n", "merged_with_next")
        with open(ranks, "rb") as f:
            table = {int(b): base64.b64decode(a) for a, b in map(bytes.split, f)}
        size = max(table) + 1
        self.lengths = np.array([len(table.get(i, b"")) for i in range(size)], np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.lengths)])
        self.flat = np.frombuffer(b"".join(table.get(i, b"") for i in range(size)), np.uint8)
        self.characters = byte_characters()
        self.pieces = Memo(self._spell, CACHE_PIECES)

    def _spell(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the given pieces by the library."""
        body, bounds = gathered(data, start, end)
        size = np.diff(bounds)
        text = np.full(len(body) + len(size), ord("\n"), np.uint32)
        text[np.arange(len(body)) + np.repeat(np.arange(1, len(size) + 1), size)] = self.characters.take(body)
        (found,) = self.model.encode_batch_fast([text.tobytes().decode("utf-32-le")], add_special_tokens=False)
        ids = np.array(found.ids, np.int32)
        begin = np.flatnonzero(ids == self.mark)
        return np.delete(ids, begin), np.diff(begin, append=len(ids)) - 1

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and how many each text has."""
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(offsets) - 1, np.int64)
        cp = code_points(data)
        byte = byte_starts(cp)
        first = np.zeros(len(cp) + 1, bool)
        first[np.searchsorted(byte, offsets)] = True
        start = byte[piece_starts(cp, first[:-1])]
        end = np.append(start[1:], len(data))
        h = Ranges(data)(start, end)
        sample, back = distinct(data, start, end, h)
        ids, n = self.pieces.encode(data, start[sample], end[sample], h[sample], back)
        upto = np.concatenate([[0], np.cumsum(n)])[np.searchsorted(start, offsets)]
        return ids, np.diff(upto)

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """Bytes of the ids in a row. Ids outside the table are an error."""
        n = self.lengths[ids]
        total = np.cumsum(n)
        return self.flat[np.repeat(self.at[ids] - (total - n), n) + np.arange(total[-1])] if len(ids) else np.zeros(0, np.uint8)


@functools.cache
def codec(ranks: str, vocabulary: str) -> Codec:
    return Codec(ranks, vocabulary)


def _paths(ranks: str | None, vocabulary: str | None) -> tuple[str, str]:
    return ranks or public_path(RANKS), vocabulary or public_path(VOCABULARY)


def encode(docs: DataFrame, ranks: str | None = None, vocabulary: str | None = None) -> DataFrame:
    """docs (doc_id, text) -> doc_id, ids ARRAY<INT>, starts ARRAY<INT>: the character in which each token begins, so
    tokens that share one character have the same start. Null and empty texts have no ids. Rows stay as they come,
    repeated ones too; extra columns are left out; an empty table gives none."""
    paths = _paths(ranks, vocabulary)
    small_batches(docs.sparkSession)

    def run(batches):
        c = codec(*paths)
        for batch in sized(batches, "text"):
            data, offsets = utf8(batch.column("text"))
            ids, n = c.encode(data, offsets)
            begin = np.cumsum(c.lengths[ids]) - c.lengths[ids]
            chars = np.cumsum((data & 0xC0) != 0x80) - 1
            before = np.concatenate([chars, chars[-1:] + 1])[np.minimum(offsets[:-1], len(data))] if len(data) else np.zeros(len(n), np.int64)
            starts = chars[begin] - np.repeat(before, n) if len(ids) else begin
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists(ids, n, pa.int32()), lists(starts.astype(np.int32), n, pa.int32())], ["doc_id", "ids", "starts"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids array<int>, starts array<int>")


def decode(tokens: DataFrame, ranks: str | None = None, vocabulary: str | None = None) -> DataFrame:
    """tokens (doc_id, ids) -> doc_id, text. Null ids give a null text, no ids an empty one; bytes that are no
    characters become U+FFFD."""
    paths = _paths(ranks, vocabulary)

    def run(batches):
        c = codec(*paths)
        for batch in batches:
            texts = [None if x is None else c.decode(np.array(x, np.int64)).tobytes().decode("utf-8", "replace") for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return tokens.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, ranks: str | None = None, vocabulary: str | None = None) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_tokens, ids_sha256, decoded_sha256, with the rules of encode() and decode()."""
    paths = _paths(ranks, vocabulary)
    small_batches(docs.sparkSession)

    def run(batches):
        c = codec(*paths)
        for batch in sized(batches, "text"):
            ids, n = c.encode(*utf8(batch.column("text")))
            back = c.decode(ids)
            ends = np.concatenate([[0], np.cumsum(n)])
            size = np.concatenate([[0], np.cumsum(c.lengths[ids])])[ends]
            raw = memoryview(ids.astype("<u4").tobytes())
            body = memoryview(back.tobytes())
            sha = lambda x: hashlib.sha256(x).hexdigest()
            a = [sha(raw[4 * i : 4 * j]) for i, j in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            b = [sha(body[i:j]) for i, j in zip(size[:-1].tolist(), size[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), pa.array(a), pa.array(b)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op7_byte_bpe(spark, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
