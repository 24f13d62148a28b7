r"""Token counts from compiled finite-state machines.

Splitter: a deterministic transducer of seven states over ten character classes marks where pieces begin (an output may
lag one character, for contractions). A batch is cut into chunks of equal length at any character; every chunk's map
from states to states is computed for all chunks side by side, the maps are composed by a parallel prefix scan, and a
second sweep from the known states writes the marks.

Counter: BPE of a prefix is BPE of the prefix up to its last token, plus that token; and two tokens may be neighbours
exactly if BPE of their joined bytes gives the two. So the machine's state is, for every cut from which a longer token
may still come, the place in the vocabulary's trie and the last token before the cut; a byte's transition is annotated
with the change in emitted tokens. Transitions are compiled from the merges when first met, and kept. All pieces of a
batch step through the table at once, one byte each; a piece over LONG bytes is cut into chunks that step at once too,
whose maps are composed from left to right.
"""

from __future__ import annotations

import functools
import json
import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytebpe import byte_characters, public_path
from .chars import BLANK, LETTER, NUMBER, byte_starts, classes
from .scratch import small_batches
from .text import sized, utf8

VOCABULARY, LIMIT = "word_bpe_49k.json", 2048
END = "</w>"
MAX_STATES, CHUNK, LONG, WARM = 250_000, 512, 2_048, 256

# character classes and states of the splitter
_BLANK, _NUM, _OTHER, _APOS, _LET, _ONE, _R, _V, _L, _E = range(10)
FRESH, LETTERS, OTHERS, MARK, MARK_R, MARK_V, MARK_L = range(7)
HERE, BEFORE = 1, 2


def splitter() -> tuple[np.ndarray, np.ndarray]:
    """Next state and marks by state and class."""
    letters = (_LET, _ONE, _R, _V, _L, _E)
    to, out = np.zeros((7, 10), np.uint8), np.zeros((7, 10), np.uint8)
    for s in range(7):
        late = BEFORE if s >= MARK_R else 0  # the letter after the apostrophe began a piece after all
        inside = s in (OTHERS, MARK)
        to[s, _BLANK], out[s, _BLANK] = FRESH, late
        to[s, _NUM], out[s, _NUM] = FRESH, HERE | late
        to[s, _OTHER], out[s, _OTHER] = OTHERS, (0 if inside else HERE) | late
        to[s, _APOS], out[s, _APOS] = (OTHERS if inside else MARK), (0 if inside else HERE) | late
        for c in letters:
            to[s, c], out[s, c] = LETTERS, (0 if s in (LETTERS, MARK_R, MARK_V, MARK_L) else HERE) | late
    for c, s in ((_ONE, FRESH), (_R, MARK_R), (_V, MARK_V), (_L, MARK_L)):
        to[MARK, c], out[MARK, c] = s, 0
    for s, c in ((MARK_R, _E), (MARK_V, _E), (MARK_L, _L)):
        to[s, c], out[s, c] = FRESH, 0
    return to, out


@functools.cache
def _class_table() -> np.ndarray:
    kind = classes()
    out = np.full(0x110000, _OTHER, np.uint8)
    out[kind == BLANK], out[kind == NUMBER], out[kind == LETTER] = _BLANK, _NUM, _LET
    for c, k in [("'", _APOS), ("s", _ONE), ("t", _ONE), ("m", _ONE), ("d", _ONE), ("r", _R), ("v", _V), ("l", _L), ("e", _E)]:
        out[ord(c)] = k
    return out


def piece_marks(cp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where pieces begin (bool by character) and each character's class. The last character must be blank."""
    kind = _class_table()[cp]
    to, out = splitter()
    n = len(cp)
    chunks = -(-n // CHUNK)
    grid = np.zeros((chunks, CHUNK), np.uint8)
    grid.ravel()[:n] = kind
    grid = np.ascontiguousarray(grid.T)
    after, marked = np.zeros((7, 16), np.uint8), np.zeros((7, 16), np.uint8)
    after[:, :10], marked[:, :10] = to << 4, out  # a state is held times 16, to be joined with a class by one OR
    after, marked = after.ravel(), marked.ravel()
    maps = np.tile(np.arange(7, dtype=np.uint8) << 4, (chunks, 1))
    for t in range(CHUNK):
        maps = after.take(maps | grid[t][:, None])
    d = 1
    while d < chunks:  # maps[i] becomes the map of chunks 0 to i
        maps[d:] = np.take_along_axis(maps[d:], maps[:-d] >> 4, axis=1)
        d *= 2
    state = np.concatenate([[FRESH << 4], maps[:-1, FRESH]]).astype(np.uint8)
    marks = np.empty((CHUNK, chunks), np.uint8)
    for t in range(CHUNK):
        at = state | grid[t]
        marks[t] = marked.take(at)
        state = after.take(at)
    marks = marks.T.ravel()[:n]
    begins = (marks & HERE) > 0
    begins[:-1] |= (marks[1:] & BEFORE) > 0
    return begins, kind


class Counter:
    """The lazily compiled transducer of one vocabulary."""

    def __init__(self, vocabulary: str):
        with open(vocabulary, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.special = re.compile("|".join(re.escape(t["content"]) for t in spec["added_tokens"]) or "(?!)")
        byte = {chr(c): b for b, c in enumerate(byte_characters())}
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.rank = {m: i for i, m in enumerate(merges)}
        self.token = {t: i for t, i in model["vocab"].items()}
        self.symbols: dict[int, tuple[str, ...]] = {}
        self.children: list[dict[int, int]] = [{}]
        self.plain: list[int] = [-1]
        self.final: list[dict[int, int]] = [{}]
        for t, i in self.token.items():
            last = t.endswith(END) and t != END
            body = t[: -len(END)] if last else t
            if not body or any(c not in byte for c in body):
                continue
            self.symbols[i] = (*body[:-1], body[-1] + END) if last else tuple(body)
            node = 0
            for c in body[: len(body) - last]:
                if byte[c] not in self.children[node]:
                    self.children[node][byte[c]] = len(self.children)
                    self.children.append({})
                    self.plain.append(-1)
                    self.final.append({})
                node = self.children[node][byte[c]]
            if last:
                self.final[node][byte[body[-1]]] = i
            else:
                self.plain[node] = i
        self.pairs: dict[tuple[int, int], bool] = {}
        self.clear()

    def clear(self) -> None:
        self.states = {((0, -1, 0),): 0}
        self.keys = [((0, -1, 0),)]
        self.letter = np.full(256, -1, np.int64)
        self.next = np.full((1024, 32), -1, np.int32)
        self.step = np.zeros((1024, 32), np.int16)
        self.last = np.full((1024, 32), -(1 << 14), np.int16)

    def merge(self, parts: list[str]) -> list[str]:
        """Plain BPE: the pair of least rank first, the leftmost of equals."""
        get, none = self.rank.get, len(self.rank)
        while len(parts) > 1:
            ranks = [get(pair, none) for pair in zip(parts, parts[1:])]
            best = min(ranks)
            if best == none:
                break
            i = ranks.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def neighbours(self, a: int, b: int) -> bool:
        """May token b follow token a (or begin, for a = -1)?"""
        found = self.pairs.get((a, b))
        if found is None:
            parts = self.merge([*(self.symbols[a] if a >= 0 else ()), *self.symbols[b]])
            found = self.pairs[a, b] = [self.token[p] for p in parts] == ([a, b] if a >= 0 else [b])
        return found

    def compile(self, state: int, b: int) -> None:
        key, at = self.keys[state], self.letter[b]
        token, count, alive = -1, 0, []
        for node, before, n in key:
            child = self.children[node].get(b)
            if child is None:
                continue
            t = self.plain[child]
            if t >= 0 and token < 0 and self.neighbours(before, t):
                token, count = t, n + 1
            if self.children[child] or self.final[child]:
                alive.append((child, before, n))
        new = (*((c, x, n - count) for c, x, n in alive), (0, token, 0))
        to = self.states.get(new)
        if to is None:
            to = self.states[new] = len(self.keys)
            self.keys.append(new)
            if to >= len(self.next):
                grow = lambda a, fill: np.concatenate([a, np.full_like(a, fill)])
                self.next, self.step, self.last = grow(self.next, -1), grow(self.step, 0), grow(self.last, -(1 << 14))
        self.next[state, at], self.step[state, at] = to, count

    def finish(self, state: int, b: int) -> None:
        for node, before, n in self.keys[state]:
            t = self.final[node].get(b)
            if t is not None and self.neighbours(before, t):
                self.last[state, self.letter[b]] = n + 1
                return
        raise ValueError(f"no token ends with byte {b}")

    def _fill(self, table, empty, state, letter, byte, make) -> None:
        missing = table[state, letter] == empty
        for s, b in np.unique(np.stack([state[missing], byte[missing]]), axis=1).T.tolist():
            make(s, b)

    def counts(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Tokens of each piece data[start:end]."""
        if len(self.keys) > MAX_STATES:
            self.clear()
        met = np.flatnonzero(np.bincount(data, minlength=256))
        new = met[self.letter[met] < 0]
        self.letter[new] = (self.letter >= 0).sum() + np.arange(len(new))
        while self.letter.max() >= self.next.shape[1]:
            wide = lambda a, fill: np.concatenate([a, np.full_like(a, fill)], axis=1)
            self.next, self.step, self.last = wide(self.next, -1), wide(self.step, 0), wide(self.last, -(1 << 14))
        size = end - start
        long = np.flatnonzero(size > LONG)
        n = np.zeros(len(size), np.int64)
        short = size <= LONG
        state, n[short] = self._walk(data, start[short], end[short] - 1, np.zeros(short.sum(), np.int32))
        last = np.zeros(len(size), np.int32)
        last[short] = state
        for i in long.tolist():
            last[i], n[i] = self._scan(data, int(start[i]), int(end[i]) - 1)
        byte = data[end - 1].astype(np.int64)
        letter = self.letter[byte]
        self._fill(self.last, -(1 << 14), last, letter, byte, self.finish)
        return n + self.last[last, letter]

    def _walk(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, state: np.ndarray, count_from: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """State after data[start:end] from a state, and tokens emitted; from the place count_from on, where given, and
        then the state there too. All ranges step side by side."""
        size = end - start
        order = np.argsort(-size, kind="stable")
        at, size, state = start[order], size[order], state[order].astype(np.int32)
        n, there = np.zeros(len(at), np.int64), state.copy()
        begin = count_from[order] if count_from is not None else None
        for j in range(int(size[0]) if len(size) else 0):
            m = int(np.searchsorted(-size, -j))  # ranges longer than j
            byte = data[at[:m] + j].astype(np.int64)
            letter, now = self.letter[byte], state[:m]
            if begin is not None:
                here = begin[:m] == at[:m] + j
                there[:m][here], n[:m][here] = now[here], 0
            to = self.next[now, letter]
            if (to < 0).any():
                self._fill(self.next, -1, now, letter, byte, self.compile)
                to = self.next[now, letter]
            n[:m] += self.step[now, letter]
            state[:m] = to
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        return (state[back], n[back]) if begin is None else (state[back], n[back], there[back])

    def _scan(self, data: np.ndarray, start: int, end: int) -> tuple[int, int]:
        """State after one long range from the first state, and tokens emitted, by chunks side by side.

        A chunk's map is needed for one state only, that in which it is entered. It is guessed by stepping through the
        WARM bytes before the chunk; composing the chunks' maps from left to right checks every guess against the state
        that the chunk before ends in, and a chunk that was entered in another state is stepped through again."""
        cuts = np.append(np.arange(start, end, LONG), end)
        first, last = cuts[:-1], cuts[1:]
        warm = np.maximum(first - WARM, start)
        state, n, entered = self._walk(data, warm, last, np.zeros(len(first), np.int32), first)
        now, total = 0, 0
        for i in range(len(first)):
            if entered[i] != now:
                one, more = self._walk(data, first[i : i + 1], last[i : i + 1], np.array([now], np.int32))
                state[i], n[i] = one[0], more[0]
            now, total = int(state[i]), total + int(n[i])
        return now, total


@functools.cache
def counter(vocabulary: str) -> Counter:
    return Counter(vocabulary)


def normal(text: str) -> str:
    """NFC, then lower case character by character (no final sigma)."""
    if not unicodedata.is_normalized("NFC", text):
        text = unicodedata.normalize("NFC", text)
    return (text.replace("Σ", "σ") if "Σ" in text else text).lower()


def count_texts(c: Counter, texts: list[str]) -> np.ndarray:
    n = np.zeros(len(texts), np.int64)
    parts = []
    for i, text in enumerate(texts):
        sections = c.special.split(text)  # their strings are tokens of their own, and part the text before all else
        n[i] += len(sections) - 1
        parts.append("\n".join(map(normal, sections)))
    size = np.array([len(x) + 1 for x in parts], np.int64)
    if not len(size):
        return n
    joined = "\n".join(parts) + "\n"
    cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    begins, kind = piece_marks(cp)
    edge = np.flatnonzero(begins | (kind == _BLANK))
    start = np.flatnonzero(begins)
    end = edge[np.searchsorted(edge, start, "right")]
    byte = byte_starts(cp)
    data = np.frombuffer(joined.encode("utf-8", "surrogatepass"), np.uint8)
    tokens = c.counts(data, byte[start], byte[end]) if len(start) else np.zeros(0, np.int64)
    upto = np.concatenate([[0], np.cumsum(tokens)])[np.searchsorted(start, np.concatenate([[0], np.cumsum(size)]))]
    return n + np.diff(upto)


def token_counts(docs: DataFrame, limit: int = LIMIT, vocabulary: str | None = None) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    Null and empty texts have 0 bytes and 0 tokens. Rows stay as they come, repeated ones too; extra columns are left
    out; an empty table gives none. A long text is one batch of its own.
    """
    path = vocabulary or public_path(VOCABULARY)
    small_batches(docs.sparkSession)

    def run(batches):
        c = counter(path)
        for batch in sized(batches, "text"):
            size = np.diff(utf8(batch.column("text"))[1])
            n = count_texts(c, [x or "" for x in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(size), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op8_token_counts(spark, sf_dir: str) -> DataFrame:
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
