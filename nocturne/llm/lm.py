"""Language-model scores from a causal self-attention model trained in numpy on subword ids.

Subwords are the byte-level BPE ids of every lower-cased word with a space before it, then one end. Frequent
ids are classes of their own, others share classes by the company they keep, and classes fall into groups. One masked
attention layer over the CONTEXT ids before it predicts the group of the next id, on top of the counts of what follows
the class before; the class within its group follows from these counts, the id within its class from its own. All is
normalised over ids, so a score is the log10 probability of the text.

Counts of words and ids cover all training texts, and training goes once through all of them: windows of CONTEXT ids lie
end to end, so that every training id is predicted exactly once. Texts are dealt by hash over ROUNDS rounds, and in a
round over groups of about SHARD_BYTES of text; a group starts from the common weights and runs Adam over its windows as
they stream in, and the groups' weights are averaged. Rounds, groups, the order in a group and the steps follow from the
texts alone, so the model does not depend on partitions or executors but for the rounding of sums. A task holds one
buffer of windows, whatever its share. Scoring goes through each text in blocks of BLOCK ids, each with the CONTEXT - 1
before it as overlap: each id is scored once, with the whole context, in one batched masked product.

The word-count baseline is exact: words are counted and looked up by their bytes (those over LONG bytes by SHA-256); the
at most HEAD most frequent ones are looked up in a broadcast table, all others are joined with the table of counts.
"""

from __future__ import annotations

import functools
import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytebpe import RANKS, VOCABULARY, Memo, codec, public_path
from .scratch import Scratch
from .text import LOWER, Ranges, binaries, distinct, gathered, same_bytes, sized, utf8, words

END, IDS = 50_256, 50_257
CONTEXT, BLOCK, WIDTH, CLASSES, GROUPS = 16, 16, 12, 768, 32
OWN, NEAR, LEAST = 576, 64, 20
HEAD, LONG, MEMO = 1 << 18, 32, 300_000
ROUNDS, SHARD_BYTES, BUFFER, BATCH, RATE, SETTLE = 3, 32 << 20, 8_192, 128, 3e-2, 150
SEGMENT = 4_096
LIMIT = 60  # exponents lie within it, so that no sum of their powers is 0 or infinite
HELD = 5
DOCUMENT, WORDS, PAIRS, BYTES = range(4)  # kinds of rows of the first pass


# --- the model --------------------------------------------------------------------------------------------------------


def shapes() -> dict[str, tuple[int, ...]]:
    return {"emb": (CLASSES, WIDTH), "q": (WIDTH, WIDTH), "k": (WIDTH, WIDTH), "v": (WIDTH, WIDTH), "o": (WIDTH, WIDTH), "out": (WIDTH, GROUPS), "rel": (CONTEXT,)}


def initial() -> dict[str, np.ndarray]:
    """Weights with which attention adds little."""
    rng = np.random.default_rng(5)
    return {k: (rng.standard_normal(s) * {"o": 0.1, "rel": 0}.get(k, 0.3)).astype(np.float32) for k, s in shapes().items()}


def pair_table(pairs: np.ndarray) -> np.ndarray:
    """Smoothed log shares of the classes after each class."""
    share = (pairs.sum(axis=0) + 0.5) / (pairs.sum() + 0.5 * CLASSES)
    return np.log((pairs + 5 * share) / (pairs.sum(axis=1, keepdims=True) + 5)).astype(np.float32)


def by_group(pair: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Shares of the groups after each class."""
    out = np.zeros((CLASSES, GROUPS), np.float32)
    np.add.at(out.T, group, np.exp(pair).T)
    return np.maximum(out, 1e-30)


def flat(p: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in shapes()])


def unflat(x: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k, s in shapes().items():
        n = math.prod(s)
        out[k] = x[at : at + n].reshape(s).astype(np.float32, copy=False)
        at += n
    return out


GAP = np.arange(CONTEXT)[:, None] - np.arange(CONTEXT)[None, :]
BEHIND = np.maximum(GAP, 0)


def gradient(p: dict[str, np.ndarray], shares: np.ndarray, group: np.ndarray, c: np.ndarray, measured: bool = True) -> tuple[float, dict[str, np.ndarray]]:
    """Mean loss of the groups (NaN unless measured) and its gradient for windows of CONTEXT + 1 classes; -1 pads the end
    of a window.

    Most arrays lie across, a place a column, where a factor a place costs little. Queries, keys and values lie one under
    another with a one below, so that products with the values also give sums of rows. Neither the rows of attention nor
    the groups' shares are scaled to 1: what goes in and out of them is."""
    kind, n, w = shares.dtype, len(c), WIDTH
    blocks = lambda a: a.reshape(len(a), n, CONTEXT).transpose(1, 0, 2)
    x, y = np.maximum(c[:, :-1], 0).ravel(), group.take(np.maximum(c[:, 1:], 0).ravel())
    there = (c[:, 1:] >= 0).ravel().astype(kind)
    scale = kind.type(w**-0.5)
    e = p["emb"].take(x, axis=0)
    into = np.concatenate([p["q"] * scale, p["k"], p["v"]], axis=1)
    made = np.empty((3 * w + 1, len(e)), kind)
    np.matmul(into.T, e.T, out=made[:-1])
    made[-1] = 1
    q, k, v1 = (blocks(a) for a in (made[:w], made[w : 2 * w], made[2 * w :]))
    a = q.transpose(0, 2, 1) @ k
    np.exp(np.clip(a, -LIMIT, LIMIT, out=a), out=a)
    a *= np.where(GAP >= 0, np.exp(p["rel"])[BEHIND], 0)
    av = np.empty((w + 1, len(e)), kind)
    np.matmul(v1, a.transpose(0, 2, 1).copy(), out=blocks(av))  # small products are faster by a copy than by a mirrored view
    part = 1 / av[-1]
    av = av[:-1] * part
    h = p["o"].T @ av
    z = h.T @ p["out"]
    np.exp(np.clip(z, -LIMIT, LIMIT, out=z), out=z)
    z *= shares.take(x, axis=0)
    all_ = z @ np.ones(GROUPS, kind)
    flat_z, at = z.reshape(-1), np.arange(0, z.size, GROUPS) + y
    total = max(float(there.sum()), 1.0)
    loss = -float((np.log(flat_z.take(at) / all_) * there).sum()) / total if measured else math.nan
    flat_z[at] -= all_
    there /= all_ * kind.type(total)
    g = {"out": (h * there) @ z}
    dh = p["out"] @ z.T
    dh *= there
    g["o"] = av @ dh.T
    dav = np.empty((w + 1, len(e)), kind)
    np.multiply(p["o"] @ dh, part, out=dav[:-1])
    np.negative(np.einsum("ij,ij->j", dav[:-1], av), out=dav[-1])
    dav = blocks(dav)
    ds = dav.transpose(0, 2, 1) @ v1
    ds *= a  # 0 ahead
    g["rel"] = np.bincount(BEHIND.ravel(), np.ones(n, kind) @ ds.reshape(n, -1), CONTEXT).astype(kind)
    back = np.empty((3 * w, len(e)), kind)
    np.matmul(k, ds.transpose(0, 2, 1).copy(), out=blocks(back[:w]))
    np.matmul(q, ds, out=blocks(back[w : 2 * w]))
    np.matmul(dav[:, :-1], a, out=blocks(back[2 * w :]))
    g["q"], g["k"], g["v"] = (back @ e).reshape(3, w, w).transpose(0, 2, 1)
    g["q"] = g["q"] * scale
    order = np.argsort(x, kind="stable")
    x = x.take(order)
    new = np.ones(len(x), bool)
    np.not_equal(x[1:], x[:-1], out=new[1:])
    first = np.flatnonzero(new)
    g["emb"] = np.zeros_like(p["emb"])
    g["emb"][x.take(first)] = np.add.reduceat((back.T @ into.T).take(order, axis=0), first, axis=0)
    return loss, g


class Trainer:
    """Adam over windows in the order in which they come, from given weights; shuffled within buffers of BUFFER."""

    def __init__(self, start: np.ndarray, shares: np.ndarray, group: np.ndarray, rate: float, seed: int):
        self.x, self.shares, self.group, self.rate = start.astype(np.float32).copy(), shares, group, rate
        self.m, self.s, self.steps, self.windows = np.zeros_like(self.x), np.zeros_like(self.x), 0, 0
        self.rng, self.held = np.random.default_rng(seed), []

    def add(self, windows: np.ndarray) -> None:
        self.held.append(windows)
        if sum(map(len, self.held)) >= BUFFER:
            rows = np.concatenate(self.held)
            full = len(rows) // BUFFER * BUFFER
            for lo in range(0, full, BUFFER):
                self._run(rows[lo : lo + BUFFER])
            self.held = [rows[full:].copy()]

    def _run(self, rows: np.ndarray) -> None:
        rows = rows[self.rng.permutation(len(rows))]
        for lo in range(0, len(rows), BATCH):
            _, g = gradient(unflat(self.x), self.shares, self.group, rows[lo : lo + BATCH], measured=False)
            g = flat(g)
            self.steps += 1
            self.m += np.float32(0.1) * (g - self.m)
            self.s += np.float32(0.01) * (g * g - self.s)
            now = self.rate / (1 + self.steps / SETTLE) ** 0.5 / (1 - 0.9**self.steps)
            self.x -= np.float32(now) * self.m / (np.sqrt(self.s * np.float32(1 / (1 - 0.99**self.steps))) + np.float32(1e-8))
        self.windows += len(rows)

    def end(self) -> np.ndarray:
        """The weights, times the number of windows, and this number."""
        if self.held:
            self._run(np.concatenate(self.held))
            self.held = []
        return np.append(self.x.astype(np.float64), 1.0) * self.windows


def _attend(into: dict[str, np.ndarray], x: np.ndarray, text: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """What attention adds to the groups, for all places of x but the first CONTEXT - 1; their number is a multiple of
    BLOCK. Keys and values lie side by side with a one after them, so that the product with the values also gives the
    sums of rows; sums and means lie across, where they divide at once."""
    back, w, seen = CONTEXT - 1, WIDTH, CONTEXT - 1 + BLOCK
    n = len(x) - back
    e = into["emb"].take(x, axis=0)
    kv = np.empty((len(x), 2 * w + 1), np.float32)
    np.matmul(e, into["kv"], out=kv[:, :-1])
    kv[:, -1] = 1
    row, one = kv.strides
    across = lambda size, at: np.ndarray((n // BLOCK, size, seen), np.float32, kv, at * one, (BLOCK * row, one, row))
    s = (e[back:] @ into["q"]).reshape(-1, BLOCK, w) @ across(w, 0)
    np.exp(np.clip(s, -LIMIT, LIMIT, out=s), out=s)
    s *= bias
    mixed = np.flatnonzero(text[: n - BLOCK + 1 : BLOCK] != text[seen - 1 :: BLOCK])  # blocks that touch more than one text
    if len(mixed):
        near = text.take(mixed[:, None] * BLOCK + np.arange(seen))
        s[mixed] *= near[:, back:, None] == near[:, None, :]
    sums = np.empty((w + 1, n), np.float32)
    np.matmul(across(w + 1, w), s.transpose(0, 2, 1), out=sums.reshape(w + 1, -1, BLOCK).transpose(1, 0, 2))
    sums[:-1] /= sums[-1]
    return sums[:-1].T @ into["out"]


def class_scores(p: dict[str, np.ndarray], pair: np.ndarray, group: np.ndarray, x: np.ndarray, y: np.ndarray, text: np.ndarray, shares: np.ndarray | None = None) -> np.ndarray:
    """Log probability of each class y given the classes x up to and with the one at its place. All texts in a row;
    text: which one a place is in; shares: by_group(), where the caller has it. Blocks overlap by the context, so every
    place sees CONTEXT classes of its own text. Segments fit the cache."""
    n, back = len(x), CONTEXT - 1
    blocks = -(-n // BLOCK)
    pad = lambda a, fill: np.concatenate([np.full(back, fill, a.dtype), a, np.full(blocks * BLOCK - n, fill, a.dtype)])
    xs, ts = pad(x, 0), pad(text, -1)
    gap = np.arange(BLOCK)[:, None] + back - np.arange(back + BLOCK)[None, :]
    bias = np.where((gap >= 0) & (gap < CONTEXT), np.exp(p["rel"])[np.clip(gap, 0, CONTEXT - 1)], 0).astype(np.float32)
    into = {"emb": p["emb"], "q": p["q"] * np.float32(WIDTH**-0.5), "kv": np.concatenate([p["k"], p["v"]], axis=1), "out": p["o"] @ p["out"]}
    shares = by_group(pair, group) if shares is None else shares
    out, held, one = pair.ravel().take(x.astype(np.int32) * CLASSES + y), np.empty((SEGMENT, GROUPS), np.float32), np.ones(GROUPS, np.float32)
    place = group.take(y) + np.arange(n) % SEGMENT * GROUPS
    for lo in range(0, blocks * BLOCK, SEGMENT):
        hi = min(lo + SEGMENT, blocks * BLOCK)
        z = _attend(into, xs[lo : hi + back], ts[lo : hi + back], bias)[: n - lo]
        np.clip(z, -LIMIT, LIMIT, out=z)
        out[lo:hi] += z.reshape(-1).take(place[lo:hi])
        np.exp(z, out=z)
        z *= shares.take(x[lo:hi], axis=0, out=held[: len(z)], mode="clip")
        out[lo:hi] -= np.log(z @ one)
    return out


def shared_ids(counts: np.ndarray) -> np.ndarray:
    """The ids that share classes: neither among the most frequent nor rare."""
    order = np.argsort(-counts, kind="stable")
    order = order[order != END]
    out = np.zeros(IDS, bool)
    out[order[OWN - 1 :]] = counts[order[OWN - 1 :]] >= LEAST
    return out


def group_ids(counts: np.ndarray, near: np.ndarray) -> np.ndarray:
    """Class of every id: the end and the most frequent ids alone, rare ones together, the rest by k-means of the
    ids before and after them."""
    order = np.argsort(-counts, kind="stable")
    order = order[order != END]
    cls = np.full(IDS, CLASSES - 1, np.int16)
    cls[END] = 0
    cls[order[: OWN - 1]] = np.arange(1, OWN)
    rest = order[shared_ids(counts)[order]]
    k = CLASSES - 1 - OWN
    if len(rest):
        x = np.sqrt(near[rest]).astype(np.float32)
        x /= np.sqrt((x * x).sum(axis=1, keepdims=True)) + 1e-9
        centers = x[np.linspace(0, len(rest) - 1, min(k, len(rest))).astype(np.int64)]
        for _ in range(12):
            at = (x @ centers.T).argmax(axis=1)
            sums = np.zeros_like(centers)
            np.add.at(sums, at, x * np.sqrt(counts[rest])[:, None].astype(np.float32))
            size = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
            centers = np.where(size > 0, sums / np.maximum(size, 1e-9), centers)
        cls[rest] = OWN + (x @ centers.T).argmax(axis=1)
    return cls


def group_classes(pairs: np.ndarray) -> np.ndarray:
    """Group of every class: k-means of what stands before and after it, from the most frequent classes."""
    x = np.concatenate([np.sqrt(pairs), np.sqrt(pairs.T)], axis=1).astype(np.float32)
    x /= np.sqrt((x * x).sum(axis=1, keepdims=True)) + 1e-9
    centers = x[np.argsort(-pairs.sum(axis=0), kind="stable")[:GROUPS]]
    for _ in range(12):
        at = (x @ centers.T).argmax(axis=1)
        sums = np.zeros_like(centers)
        np.add.at(sums, at, x)
        size = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        centers = np.where(size > 0, sums / np.maximum(size, 1e-9), centers)
    return (x @ centers.T).argmax(axis=1)


# --- texts ------------------------------------------------------------------------------------------------------------


def word_keys(low: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.BinaryArray:
    """The bytes of words; of those over LONG bytes, a zero and their SHA-256."""
    long = np.flatnonzero(end - start > LONG)
    if not len(long):
        return binaries(*gathered(low, start, end))
    digests = [b"\0" + hashlib.sha256(low[a:b].tobytes()).digest() for a, b in zip(start[long].tolist(), end[long].tolist(), strict=True)]
    start, size = start.copy(), end - start
    start[long], size[long] = len(low) + 33 * np.arange(len(long)), 33
    return binaries(*gathered(np.concatenate([low, np.frombuffer(b"".join(digests), np.uint8)]), start, start + size))


class Slice:
    """The words of a slice of texts: lower-cased bytes; row of every word; distinct words and which each word is."""

    def __init__(self, column):
        data, offsets = utf8(column)
        self.low, self.texts = LOWER.take(data), len(column)
        start, end, self.row = words(data, offsets)
        h = Ranges(self.low)(start, end)
        sample, self.back = distinct(self.low, start, end, h)
        self.start, self.end, self.hash = start[sample], end[sample], h[sample]

    def keys(self, chosen: np.ndarray) -> pa.BinaryArray:
        return word_keys(self.low, self.start[chosen], self.end[chosen])

    def streams(self, paths, found: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, an end after each, and how many ids each text has."""
        ids, each = speller(*paths).encode(self.low, self.start, self.end, self.hash, self.back, found)
        size = np.bincount(self.row, each, self.texts).astype(np.int64)
        return np.insert(ids, np.cumsum(size), END), size + 1


@functools.cache
def speller(*paths) -> Memo:
    """BPE ids of words, each with a space before it."""

    def spell(low: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        body, bounds = gathered(low, start, end)
        spaced = bounds + np.arange(len(bounds))
        out = np.full(spaced[-1], 0x20, np.uint8)
        inside = np.ones(len(out), bool)
        inside[spaced[:-1]] = False
        out[inside] = body
        return codec(*paths).encode(out, spaced)

    return Memo(spell, MEMO)


def find(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each key, and whether it is there."""
    if not len(sorted_keys):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return at, sorted_keys[at] == keys


def _tally(keys, n):
    order = np.argsort(keys)
    first = np.flatnonzero(np.append(True, keys[order][1:] != keys[order][:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[order][first], np.add.reduceat(n[order], first) if len(first) else n


FIRST = pa.schema([("kind", pa.int32()), ("doc_id", pa.int64()), ("text", pa.string()), ("learn", pa.bool_()), ("hash", pa.int64()), ("ids", pa.binary()), ("word", pa.binary()), ("key", pa.int64()), ("n", pa.int64())])
FIRST_DDL = "kind int, doc_id long, text string, learn boolean, hash long, ids binary, word binary, key long, n long"


def _rows(kind: int, m: int, **columns) -> pa.RecordBatch:
    columns["kind"] = pa.array(np.full(m, kind, np.int32))
    return pa.RecordBatch.from_arrays([columns[f.name] if f.name in columns else pa.nulls(m, f.type) for f in FIRST], schema=FIRST)


def _first_pass(paths):
    """Each text with its ids, two bytes each; and of the texts to learn from, counts of words, of pairs of ids,
    a * IDS + b, the first of a text after an end, and of bytes."""

    def run(batches):
        keys, counts, bytes_, memo = [], [], 0, speller(*paths)
        held = np.zeros(0, np.int64)  # counts of the words that the worker knows by number
        for batch in sized(batches, "text"):
            column, learn = batch.column("text"), batch.column("learn").to_numpy(zero_copy_only=False)
            part = Slice(column)
            found = memo.find(part.low, part.start, part.end, part.hash)
            ids, size = part.streams(paths, found)
            bounds = np.concatenate([[0], np.cumsum(size)])
            given = {c: batch.column(c) for c in ("doc_id", "learn", "hash")}
            yield _rows(DOCUMENT, len(learn), text=column.cast(pa.string()), ids=binaries(ids.astype("<u2").view(np.uint8), 2 * bounds), **given)
            if not learn.any():
                continue
            bytes_ += int(np.diff(utf8(column)[1])[learn].sum())
            n = np.bincount(part.back[learn[part.row]], minlength=len(part.start))
            held = np.concatenate([held, np.zeros(max(0, len(memo.ends) - 1 - len(held)), np.int64)])
            held[found[found >= 0]] += n[found >= 0]
            new = np.flatnonzero((n > 0) & (found < 0))
            yield _rows(WORDS, len(new), word=part.keys(new), n=pa.array(n[new]))
            pair = np.concatenate([[END], ids[:-1]]).astype(np.int64) * IDS + ids
            k, n = np.unique(pair if learn.all() else pair[np.repeat(learn, size)], return_counts=True)
            keys.append(k)
            counts.append(n)
            if sum(map(len, keys)) > 3_000_000:
                k, n = _tally(np.concatenate(keys), np.concatenate(counts))
                keys, counts = [k], [n]
                if len(k) > 1_500_000:
                    yield _rows(PAIRS, len(k), key=pa.array(k), n=pa.array(n))
                    keys, counts = [], []
        if keys:
            k, n = _tally(np.concatenate(keys), np.concatenate(counts))
            yield _rows(PAIRS, len(k), key=pa.array(k), n=pa.array(n))
        seen = np.flatnonzero(held)
        yield _rows(WORDS, len(seen), word=word_keys(memo.body, memo.body_ends[seen], memo.body_ends[seen + 1]), n=pa.array(held[seen]))
        yield _rows(BYTES, 1, n=pa.array([bytes_]))

    return run


def _neighbours(shared):
    """From counts of pairs, counts of (id, after or before, frequent id) for the ids that share classes."""

    def run(batches):
        rank, rest = shared.value
        for batch in batches:
            a, b = np.divmod(batch.column("key").to_numpy(), IDS)
            n = batch.column("n").to_numpy()
            after, before = (rank[b] >= 0) & rest[a], (rank[a] >= 0) & rest[b]
            key, n = _tally(np.concatenate([a[after] * 2 * NEAR + rank[b[after]], b[before] * 2 * NEAR + NEAR + rank[a[before]]]), np.concatenate([n[after], n[before]]))
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], ["key", "n"])

    return run


def _class_pairs(shared):
    def run(batches):
        cls = shared.value.astype(np.int64)
        for batch in batches:
            a, b = np.divmod(batch.column("key").to_numpy(), IDS)
            key, n = _tally(cls[a] * CLASSES + cls[b], batch.column("n").to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], ["key", "n"])

    return run


def windows_of(c: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Windows of CONTEXT + 1 from the classes of texts in a row: each begins with the class before (at a text, the
    end's) and they lie end to end, so that every class but it is in one window; -1 pads the last of a text."""
    each = -(-size // CONTEXT)
    out = np.full((int(each.sum()), CONTEXT + 1), -1, c.dtype)
    if not len(out):
        return out
    skipped = (np.cumsum(each) - each) * CONTEXT - (np.cumsum(size) - size)  # places left open before each text
    place = np.arange(len(c), dtype=np.int32) + np.repeat(skipped.astype(np.int32), size)
    out.ravel()[place + place // CONTEXT + 1] = c
    out[1:, 0] = out[:-1, -1]
    out[np.cumsum(each) - each, 0] = c[-1]  # a text ends with an end, so one is before each
    return out


def _stored(batch) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts of a batch of the first pass, and how many each has."""
    data, offsets = utf8(batch.column("ids"))
    return np.frombuffer(data.tobytes(), "<u2").astype(np.int32), np.diff(offsets) // 2


def _train(shared, round_: int):
    """Sum over the groups of a task of their weights times their windows; rows come sorted by group."""

    def run(batches):
        start, pair, group, cls = shared.value
        shares, total, now, trainer = by_group(pair, group), 0.0, None, None
        for batch in sized(batches, "ids"):
            ids, size = _stored(batch)
            c, ends = cls[ids], np.concatenate([[0], np.cumsum(size)])
            of = batch.column("shard").to_numpy()
            cuts = [0, *(np.flatnonzero(of[1:] != of[:-1]) + 1).tolist(), len(of)]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if trainer is None or of[lo] != now:
                    total = total + trainer.end() if trainer else total
                    now, trainer = of[lo], Trainer(start, shares, group, RATE * (1 - 0.3 * round_), round_)
                trainer.add(windows_of(c[ends[lo] : ends[hi]], size[lo:hi]))
        if trainer:
            total = total + trainer.end()
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["at", "x"])

    return run


def _score(shared):
    def run(batches):
        (body, bounds, head, value), params, pair, group, cls, within = shared.value
        p, shares = unflat(params), by_group(pair, group)
        for batch in sized(batches, "text"):
            part, texts = Slice(batch.column("text")), batch.num_rows
            ids, size = _stored(batch)
            text = np.repeat(np.arange(texts, dtype=np.int32), size)
            y = cls[ids]
            x = np.concatenate([cls[[END]], y[:-1]])  # a text begins after the end of the one before
            log = class_scores(p, pair, group, x, y, text, shares).astype(np.float64) + within[ids]
            at, known = find(head, part.hash)
            if len(head):
                n = part.end - part.start
                known &= n == bounds[at + 1] - bounds[at]
                known &= same_bytes(part.low, part.start, body, bounds[at], np.where(known, n, 0))
            of_word = np.where(known, value[at] if len(head) else 0.0, 0.0)
            seen = known[part.back]
            far = np.flatnonzero(~known)
            place = np.zeros(len(known), np.int32)
            place[far] = np.arange(len(far))
            rest = part.keys(far).take(pa.array(place[part.back[~seen]]))
            ends = np.concatenate([[0], np.cumsum(np.bincount(part.row[~seen], minlength=texts))]).astype(np.int32)
            found = np.bincount(part.row, of_word[part.back], texts).astype(np.float64)  # whole numbers where there are no words
            columns = [pa.array(np.bincount(part.row, minlength=texts) + 1), pa.array(np.bincount(part.row[seen], minlength=texts)), pa.array(found), pa.array(np.bincount(text, log, texts) / np.log(10))]
            yield pa.RecordBatch.from_arrays([batch.column("rid"), batch.column("doc_id"), *columns, pa.ListArray.from_arrays(pa.array(ends), rest)], ["rid", "doc_id", "n_tokens", "known", "base", "score", "rest"])

    return run


def fit_model(docs: DataFrame, pairs_seen: DataFrame, id_counts: np.ndarray, bytes_: int):
    """docs (ids, hash) to learn from -> weights, table of pairs, groups of classes, classes of ids and log shares
    within classes."""
    spark = docs.sparkSession
    order = np.argsort(-id_counts, kind="stable")[:NEAR]
    rank = np.full(IDS, -1, np.int64)
    rank[order] = np.arange(NEAR)
    near = np.zeros(IDS * 2 * NEAR, np.float32)
    found = pairs_seen.mapInArrow(_neighbours(spark.sparkContext.broadcast((rank, shared_ids(id_counts)))), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toArrow()
    near[found.column("key").to_numpy()] = found.column("n").to_numpy()
    cls = group_ids(id_counts, near.reshape(IDS, 2 * NEAR))
    weight = id_counts + 0.5
    of_class = np.bincount(cls, weight, CLASSES)
    within = np.log(weight) - np.log(of_class[cls])
    found = pairs_seen.mapInArrow(_class_pairs(spark.sparkContext.broadcast(cls)), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toArrow()
    pairs = np.zeros(CLASSES * CLASSES)
    pairs[found.column("key").to_numpy()] = found.column("n").to_numpy()
    pairs = pairs.reshape(CLASSES, CLASSES)
    pair, group = pair_table(pairs), group_classes(pairs)
    params = flat(initial())
    shards = max(1, round(bytes_ / ROUNDS / SHARD_BYTES))
    dealt = docs.select("ids", "hash", F.pmod("hash", F.lit(ROUNDS)).alias("round"), F.pmod(F.shiftright("hash", 17), F.lit(shards)).alias("shard"))
    for r in range(ROUNDS):
        part = dealt.where(F.col("round") == r).repartition(min(shards, 2_000), "shard").sortWithinPartitions("shard", "hash").select("shard", "ids")
        got = part.mapInArrow(_train(spark.sparkContext.broadcast((params, pair, group, cls)), r), "at long, x double").groupBy("at").agg(F.sum("x").alias("x")).toArrow()
        if got.num_rows:
            x = np.zeros(len(params) + 1)
            x[got.column("at").to_numpy()] = got.column("x").to_numpy()
            params = (x[:-1] / x[-1]).astype(np.float32)
    return params, pair, group, cls, within


def lm_scores(docs: DataFrame, train, ranks: str | None = None, vocabulary: str | None = None) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_tokens, n_known, train_tokens, base_score, score; ``train`` is the condition
    for rows to learn from.

    Tokens are words ``[^\\x20\\x09-\\x0D]+`` with A-Z lowered, then one end. A null or empty text is its end alone.
    Repeated rows are scored, and learned from, each. Without training rows base_score is 0 a token and the model
    spreads its probability evenly within classes. Extra columns are ignored; an empty table gives no rows.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "lm")
    paths = (ranks or public_path(RANKS), vocabulary or public_path(VOCABULARY))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(train, F.lit(False)).alias("learn")).withColumn("hash", F.xxhash64("doc_id", "text"))
    seen = scratch.save(rows.mapInArrow(_first_pass(paths), FIRST_DDL), "first")
    counts = scratch.save(seen.where(F.col("kind") == WORDS).groupBy("word").agg(F.sum("n").alias("c")), "counts")
    pairs = scratch.save(seen.where(F.col("kind") == PAIRS).groupBy("key").agg(F.sum("n").alias("n")), "pairs")
    bytes_ = seen.where(F.col("kind") == BYTES).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    ids = pairs.groupBy((F.col("key") % IDS).alias("key")).agg(F.sum("n").alias("n")).toArrow()
    id_counts = np.zeros(IDS)
    id_counts[ids.column("key").to_numpy()] = ids.column("n").to_numpy()
    ends = int(id_counts[END])  # one a text
    level = F.floor(F.log2(F.col("c").cast("double"))).cast("int")
    by_level = {r["level"]: (r["v"], r["n"]) for r in counts.groupBy(level.alias("level")).agg(F.count("*").alias("v"), F.sum("c").alias("n")).collect()}
    total = ends + sum(n for _, n in by_level.values())
    distinct_ = (ends > 0) + sum(v for v, _ in by_level.values())
    least, room = 63, HEAD
    for x in sorted(by_level, reverse=True):
        room -= by_level[x][0]
        if room < 0:
            break
        least = x
    base = lambda c: np.log10((c + 0.5) / (total + 0.5 * (distinct_ + 1)))
    found = counts.where((F.col("c") >= F.lit(1 << least)) & (F.length("word") <= LONG)).toArrow().combine_chunks() if least < 63 else None
    model = fit_model(seen.where((F.col("kind") == DOCUMENT) & F.col("learn")), pairs, id_counts, bytes_)
    shared = spark.sparkContext.broadcast((_head(found, base), *model))
    first = seen.where(F.col("kind") == DOCUMENT).select("doc_id", "text", "ids", F.monotonically_increasing_id().alias("rid")).mapInArrow(_score(shared), "rid long, doc_id long, n_tokens long, known long, base double, score double, rest array<binary>")
    first = scratch.save(first, "scored")
    scratch.drop(seen)
    rest = first.select("rid", F.explode("rest").alias("word")).join(counts, "word", "left")
    c = F.coalesce(F.col("c"), F.lit(0))
    rest = rest.groupBy("rid").agg(F.count_if(c > 0).alias("k"), F.sum(F.log10((c + 0.5) / F.lit(total + 0.5 * (distinct_ + 1)))).alias("b"))
    out = first.drop("rest").join(rest, "rid", "left")
    end = float(base(ends))
    return out.select("doc_id", "n_tokens", (F.col("known") + F.coalesce("k", F.lit(0)) + F.lit(int(ends > 0))).cast("long").alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("b", F.lit(0.0)) + F.lit(end)).alias("base_score"), "score")


def _head(found: pa.Table | None, base):
    """Frequent words for look-ups: their bytes, where each begins, hashes in order and base scores."""
    if found is None or not found.num_rows:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64), np.zeros(0, np.uint64), np.zeros(0)
    body, bounds = utf8(found.column("word"))
    h = Ranges(body)(bounds[:-1], bounds[1:])
    _, order = np.unique(h, return_index=True)  # a second word of one hash is left to the join
    body, bounds = gathered(body, bounds[:-1][order], bounds[1:][order])
    return body, bounds, h[order], base(found.column("c").to_numpy()[order])


def op6_lm_score(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % HELD == 1, F.lit(False))
    out = lm_scores(docs, ~held)
    return out.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
