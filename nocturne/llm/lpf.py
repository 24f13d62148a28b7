"""Removal of repeated byte strings through suffix order and longest-previous-factor arrays.

A string of WINDOW bytes that starts at two places is to be found wherever its copies lie, without a suffix array of
the whole corpus. Every window is owned by one anchor, the rightmost GRAM-byte string of least hash inside it, so equal
windows are owned by equal anchors at equal offsets (winnowing, Schleimer et al., 2003); there is one anchor for about
170 bytes. Then

1. anchors are counted by hash of their bytes and by 128-bit hash of all bytes that their windows cover (the context).
   An anchor whose context occurs again has only repeated windows; one whose bytes occur once has none. No text moves;
2. of the rest, one text for each distinct context goes to a block: contexts of equal anchors go to one block. Its
   windows are put in suffix order, to a depth of WINDOW, and the previous and next smaller positions in that order
   give each window the earlier one with the longest common start: the longest previous factor reaches WINDOW, or not.
   The same arrays of the mirrored positions tell of later copies. All comparisons in a block are of bytes;
3. an anchor with more than CROWD contexts is dealt over many blocks. Each sends the 128-bit hash of every distinct
   window once, dealt by hash, so that even a passage in a third of all documents is one hash a block, and gets back
   those that other blocks also have;
4. the spans of repeated windows go back to their documents, whose key is doc_id and a hash of the text.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch
from .text import Ranges, U, sized, utf8, whole_groups

WINDOW, GRAM, CROWD = 400, 64, 2_000
BLOCK_BYTES, HASHES_A_TASK, ANCHOR_BYTES = 1 << 20, 1_000_000, 1 << 19


# --- suffix order and LPF of one block --------------------------------------------------------------------------------


def dense(keys: np.ndarray) -> np.ndarray:
    """Rank of each key among the distinct keys."""
    order = np.argsort(keys)
    new = np.ones(len(keys), np.int64)
    new[:1] = 0
    sorted_keys = keys[order]
    new[1:] = sorted_keys[1:] != sorted_keys[:-1]
    out = np.empty(len(keys), np.int64)
    out[order] = np.cumsum(new)
    return out


def suffix_ranks(data: np.ndarray, depth: int, at: np.ndarray | None = None) -> np.ndarray:
    """Rank of every suffix by its first ``depth`` bytes (a shorter suffix first); equal exactly if those are equal.

    Prefix doubling from 8 bytes on; the last step overlaps, so the depth is met exactly. at: only these are needed."""
    n = len(data)
    padded = np.concatenate([data.astype(U) + U(1), np.zeros(depth + 8, U)])
    if depth < 7:
        key = np.zeros(n, U)
        for i in range(depth):
            key = key * U(257) + padded[i : n + i]
        rank, k = dense(key), depth
    else:
        key = np.zeros(n, U)
        for i in range(7):
            key = key * U(257) + padded[i : n + i]
        rank, k = dense(key), 7
    while k < depth:
        step = min(k, depth - k)
        after = np.concatenate([rank[step:] + 1, np.zeros(min(step, n), np.int64)])[:n]
        k += step
        rank = dense((rank * (n + 2) + after) if k < depth or at is None else (rank * (n + 2) + after)[at])
    return rank


def previous_smaller(x: np.ndarray) -> np.ndarray:
    """Index of the nearest smaller value to the left of each, or -1; all at once, by jumping along found answers."""
    n = len(x)
    out = np.arange(-1, n - 1)
    todo = np.flatnonzero(out >= 0)
    while len(todo):
        todo = todo[x[out[todo]] > x[todo]]
        out[todo] = out[out[todo]]
        todo = todo[out[todo] >= 0]
    return out


def previous_factors(rank: np.ndarray) -> np.ndarray:
    """Of windows in text order with their ranks in suffix order (equal for equal windows): is there an equal one before?

    In suffix order, ties by position, the longest match of a window that starts earlier is with its previous or next
    smaller position (Crochemore and Ilie, 2008); it is whole, so the longest previous factor reaches the depth of the
    ranks, exactly if the ranks are equal. Next smaller positions come after all ties, so they never have equal rank."""
    sa = np.argsort(rank * len(rank) + np.arange(len(rank)))
    before = previous_smaller(sa)
    at = np.flatnonzero(before >= 0)
    at = at[rank[sa[at]] == rank[sa[before[at]]]]
    out = np.zeros(len(rank), bool)
    out[sa[at]] = True
    return out


def lpf(data: np.ndarray, depth: int) -> np.ndarray:
    """For each position, the length of the longest match of its suffix that starts earlier, ``depth`` at most: the
    greatest power-of-two sum of prefixes that agree with the previous or next smaller position in suffix order."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    sizes = [1]
    while sizes[-1] * 2 <= depth:
        sizes.append(sizes[-1] * 2)
    ranks = {s: suffix_ranks(data, s) for s in sizes}
    sa = np.lexsort((np.arange(n), suffix_ranks(data, depth)))
    low = previous_smaller(sa)
    high = n - 1 - previous_smaller(sa[::-1])[::-1]
    best = np.zeros(n, np.int64)
    for other in (low, np.where(high < n, high, -1)):
        i = np.flatnonzero(other >= 0)
        a, b = sa[i], sa[other[i]]
        got = np.zeros(len(i), np.int64)
        for s in [*sizes[::-1], *sizes[::-1]]:
            fits = (a + got + s <= n) & (b + got + s <= n) & (got + s <= depth)
            j = np.flatnonzero(fits)
            j = j[ranks[s][a[j] + got[j]] == ranks[s][b[j] + got[j]]]
            got[j] += s
        best[a] = np.maximum(best[a], got)
    return best


def repeated_windows(data: np.ndarray, starts: np.ndarray, window: int) -> np.ndarray:
    """Of the windows at ``starts``, in order: does it equal one at an earlier start, or a later one?"""
    rank = suffix_ranks(data, window, starts)
    return previous_factors(rank) | previous_factors(rank[::-1])[::-1]


# --- anchors ----------------------------------------------------------------------------------------------------------


def anchors(data: np.ndarray, offsets: np.ndarray, window: int, gram: int):
    """Of all texts in a row: row, first and last window start and place of every anchor (relative to the text), hash
    of its bytes and 128-bit hash of its context."""
    n, w = len(data), window - gram + 1
    rows = np.flatnonzero(np.diff(offsets) >= window)
    if not len(rows):
        return [np.zeros(0, np.int64)] * 4 + [np.zeros(0, U)] * 3
    ranges = Ranges(data)
    at = np.arange(n - gram + 1)
    h = ranges(at, at + gram)
    # minima of stretches of w places, from either end; low bits hold the place in the stretch, later ones first
    bits = U((1 << (w - 1).bit_length()) - 1)
    m = len(h)
    padded = np.full(-(-m // w) * w, ~U(0))
    padded[:m] = (h & ~bits) | (bits - (at % w).astype(U))
    grid = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    place = np.arange(n - window + 1)
    first, second = back[place], ahead[place + w - 1]
    right = (second & ~bits) <= (first & ~bits)  # of equals, the one in the later stretch
    stretch = np.where(right, place + w - 1, place) // w * w
    anchor = stretch + (bits - (np.where(right, second, first) & bits)).astype(np.int64)
    valid = np.zeros(n - window + 1, bool)
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, offsets[rows], 1)
    np.add.at(edge, offsets[rows + 1] - window + 1, -1)
    valid = np.cumsum(edge)[: n - window + 1] > 0
    new = valid.copy()
    new[1:] &= (anchor[1:] != anchor[:-1]) | ~valid[:-1]
    first_of_text = np.zeros(n + 1, bool)
    first_of_text[offsets[rows]] = True
    new |= valid & first_of_text[: n - window + 1]
    lo = np.flatnonzero(new)
    stop = np.flatnonzero(valid & np.append(new[1:] | ~valid[1:], True))
    row = np.searchsorted(offsets, lo, "right") - 1
    a = anchor[lo]
    offset = (a - lo).astype(U) * U(0x9FB21C651E98DF25)
    context = [ranges(lo, stop + window) ^ offset, Ranges(data, 1)(lo, stop + window)]
    return [row, lo - offsets[row], stop - offsets[row], a - offsets[row], h[a], *context]


def _anchors(window: int, gram: int):
    def run(batches):
        for batch in sized(batches, "text", ANCHOR_BYTES):
            row, lo, hi, a, *hashes = anchors(*utf8(batch.column("text")), window, gram)
            own = [batch.column(c).take(pa.array(row)) for c in ("did", "tid")]
            yield pa.RecordBatch.from_arrays([*(pa.array(x.view(np.int64)) for x in hashes), *own, *(pa.array(x.astype(np.int32)) for x in (lo, hi, a))], ["fp", "ctx", "ctx2", "did", "tid", "lo", "hi", "a"])

    return run


def _contexts(window: int):
    def run(batches):
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            out = {k: [] for k in ("fp", "did", "tid", "lo", "solo", "body", "salt")}
            for text, did, tid, wanted in zip(texts, *(batch.column(c).to_pylist() for c in ("did", "tid", "wanted")), strict=True):
                view = memoryview(text.as_buffer())
                for x in wanted:
                    out["fp"].append(x["fp"])
                    out["did"].append(did)
                    out["tid"].append(tid)
                    out["lo"].append(x["lo"])
                    out["solo"].append(x["solo"])
                    out["salt"].append(x["salt"])
                    out["body"].append(bytes(view[x["lo"] : x["hi"] + window]))
            kinds = {"fp": pa.int64(), "did": pa.int64(), "tid": pa.int64(), "lo": pa.int32(), "solo": pa.bool_(), "salt": pa.int32(), "body": pa.binary()}
            yield pa.RecordBatch.from_arrays([pa.array(v, kinds[k]) for k, v in out.items()], list(out))

    return run


def _starts(bodies, window: int):
    """Bytes of the contexts in a row, every window start, and the context of each start."""
    data, offsets = utf8(bodies)
    n = np.diff(offsets) - window + 1
    of = np.repeat(np.arange(len(n)), n)
    return data, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + offsets[:-1][of], of, offsets


def _spans(t: pa.Table, of: np.ndarray, starts: np.ndarray, offsets: np.ndarray, found: np.ndarray) -> pa.RecordBatch:
    """Runs of repeated windows of the contexts that stand for themselves: (did, tid, lo, hi) by window starts."""
    found = found & t.column("solo").to_numpy()[of]
    new = found.copy()
    new[1:] &= ~found[:-1] | (of[1:] != of[:-1])
    last = found.copy()
    last[:-1] &= ~found[1:] | (of[1:] != of[:-1])
    i, j = np.flatnonzero(new), np.flatnonzero(last)
    base = t.column("lo").to_numpy()[of[i]]
    ends = [pa.array((base + starts[x] - offsets[of[i]]).astype(np.int32)) for x in (i, j)]
    return pa.RecordBatch.from_arrays([*(t.column(c).combine_chunks().take(pa.array(of[i])) for c in ("did", "tid")), *ends], ["did", "tid", "lo", "hi"])


def _blocks(window: int):
    def run(batches):
        for t, cuts in whole_groups(sized(batches, "body", BLOCK_BYTES), ["fp"]):
            data, starts, of, offsets = _starts(t.column("body"), window)
            yield _spans(t, of, starts, offsets, repeated_windows(data, starts, window))

    return run


def _window_hashes(data: np.ndarray, starts: np.ndarray, window: int) -> np.ndarray:
    """128-bit hashes of the windows, as two columns."""
    return np.stack([Ranges(data, seed)(starts, starts + window) for seed in (0, 1)], axis=1)


def _runs(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows of two columns, and which run of equals each of them is in, in that order."""
    order = np.lexsort((pairs[:, 1], pairs[:, 0]))
    new = np.zeros(len(order), np.int64)
    new[1:] = (pairs[order][1:] != pairs[order][:-1]).any(axis=1)
    return order, np.cumsum(new)


def _crowd_hashes(window: int, buckets: int):
    """Of a block of a crowd: its distinct window hashes, packed by bucket."""

    def run(batches):
        for t, cuts in whole_groups(batches, ["block"]):
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                part = t.slice(a, b - a)
                data, starts, _, _ = _starts(part.column("body"), window)
                h = _window_hashes(data, starts, window)
                order, run_ = _runs(h)
                h = h[order[np.append(True, run_[1:] != run_[:-1])]] if len(order) else h
                at = (h[:, 0] % U(buckets)).astype(np.int64)
                order = np.argsort(at, kind="stable")
                edge = np.searchsorted(at[order], np.arange(buckets + 1))
                full = np.flatnonzero(np.diff(edge))
                block = part.column("block")[0].as_py()
                yield pa.RecordBatch.from_arrays([pa.array(full), pa.array([block] * len(full), pa.int64()), pa.array([h[order[edge[i] : edge[i + 1]]].tobytes() for i in full], pa.binary())], ["bucket", "block", "hashes"])

    return run


def _crowd_common(batches):
    """Of a bucket: to each block those of its hashes that another block also has."""
    for t, cuts in whole_groups(batches, ["bucket"]):
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            each = [np.frombuffer(x.as_py(), U).reshape(-1, 2) for x in t.column("hashes").slice(a, b - a)]
            every = np.concatenate(each)
            order, run_ = _runs(every)
            common = np.zeros(len(every), bool)
            common[order] = np.bincount(run_)[run_] > 1
            ends = np.cumsum([0, *map(len, each)])
            back = [x[common[i:j]].tobytes() for x, i, j in zip(each, ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([t.column("block").slice(a, b - a).combine_chunks(), pa.array(back, pa.binary())], ["block", "hashes"])


def _crowd_spans(window: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.Table.from_batches([_spans(left, *(np.zeros(0, np.int64),) * 3, np.zeros(0, bool))])
        data, starts, of, offsets = _starts(left.column("body"), window)
        common = np.frombuffer(b"".join(right.column("hashes").to_pylist()), U).reshape(-1, 2)
        order, run_ = _runs(np.concatenate([_window_hashes(data, starts, window), common]))
        elsewhere = np.zeros(run_[-1] + 1, bool)
        elsewhere[run_[order >= len(starts)]] = True
        found = np.zeros(len(order), bool)
        found[order] = elsewhere[run_]
        return pa.Table.from_batches([_spans(left, of, starts, offsets, repeated_windows(data, starts, window) | found[: len(starts)])])

    return run


def repeated_spans(docs: DataFrame, scratch: Scratch, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """docs (did, tid, text) -> did, tid, lo, hi: all window starts lo..hi of a text begin repeated strings. Spans may touch."""
    spot = scratch.save(docs.mapInArrow(_anchors(window, gram), "fp long, ctx long, ctx2 long, did long, tid long, lo int, hi int, a int"), "anchors")
    kinds = scratch.save(spot.groupBy("fp", "ctx", "ctx2").agg(F.count("*").alias("n"), F.min(F.struct("did", "tid", "lo", "hi")).alias("one")), "kinds")
    groups = scratch.save(kinds.groupBy("fp").agg(F.count("*").alias("kinds")).where("kinds > 1"), "groups")
    many = kinds.where("n > 1").select("fp", "ctx", "ctx2")
    whole = scratch.save(spot.join(many, ["fp", "ctx", "ctx2"], "left_semi").select("did", "tid", "lo", "hi"), "whole")
    salt = F.pmod(F.col("ctx"), F.ceil(F.col("kinds") / CROWD)).cast("int")
    wanted = kinds.join(groups, "fp").select("one.did", "one.tid", F.struct("fp", "one.lo", "one.hi", (F.col("n") == 1).alias("solo"), F.when(F.col("kinds") > CROWD, salt).otherwise(-1).alias("salt")).alias("x"))
    wanted = scratch.save(wanted.groupBy("did", "tid").agg(F.collect_list("x").alias("wanted")), "wanted")
    scratch.drop(spot, kinds, groups)
    cut = docs.join(wanted, ["did", "tid"]).dropDuplicates(["did", "tid"]).mapInArrow(_contexts(window), "fp long, did long, tid long, lo int, solo boolean, body binary, salt int")
    cut = scratch.save(cut, "contexts")
    spans = "did long, tid long, lo int, hi int"
    small = cut.where("salt < 0").repartition("fp").sortWithinPartitions("fp").mapInArrow(_blocks(window), spans)
    crowd = cut.where("salt >= 0").withColumn("block", F.xxhash64("fp", "salt"))
    total = crowd.agg(F.sum(F.length("body") - window + 1)).first()[0]
    parts = [whole, small]
    if total:
        buckets = int(-(-total // HASHES_A_TASK))
        sent = scratch.save(crowd.repartition("block").sortWithinPartitions("block").mapInArrow(_crowd_hashes(window, buckets), "bucket long, block long, hashes binary"), "sent")
        back = scratch.save(sent.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_crowd_common, "block long, hashes binary"), "back")
        parts.append(crowd.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(_crowd_spans(window), spans))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _cover(lists, window: int):
    """Removed [start, end) runs of one text, in order and apart."""
    if not lists:
        return []
    lo = np.array([x["lo"] for x in lists], np.int64)
    hi = np.array([x["hi"] for x in lists], np.int64) + window
    order = np.argsort(lo, kind="stable")
    lo, hi = lo[order], np.maximum.accumulate(hi[order])
    first = np.append(True, lo[1:] > hi[:-1])
    return list(zip(lo[first].tolist(), hi[np.append(first[1:], True)].tolist(), strict=True))


def _with_spans(docs: DataFrame, window: int) -> DataFrame:
    scratch = Scratch(docs.sparkSession, "lpf")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumns({"did": F.coalesce("doc_id", F.lit(0)), "tid": F.xxhash64("text")})
    spans = repeated_spans(docs.select("did", "tid", "text").where(F.octet_length("text") >= window), scratch, window)
    spans = scratch.save(spans.groupBy("did", "tid").agg(F.collect_set(F.struct("lo", "hi")).alias("spans")), "spans")
    return docs.join(spans, ["did", "tid"], "left")


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs (doc_id, text) -> doc_id, kept BINARY, removed ARRAY<STRUCT<lo, hi>> (byte runs).

    A byte goes if a ``window``-byte string over it also starts anywhere else, in its own text or another. Null and
    empty texts, and texts shorter than ``window``, stay. Rows that repeat doc_id and text are copies of each other and
    go whole. Extra columns are ignored; an empty table gives no rows. What is left may not be valid UTF-8.
    """

    def run(batches):
        for batch in batches:
            kept, runs = [], []
            for text, spans in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("spans").to_pylist(), strict=True):
                cover = _cover(spans, window)
                ends = [0, *(x for r in cover for x in r), len(text)]
                kept.append(b"".join(text[a:b] for a, b in zip(ends[::2], ends[1::2], strict=True)))
                runs.append([{"lo": a, "hi": b} for a, b in cover])
            kind = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(kept, pa.binary()), pa.array(runs, kind)], ["doc_id", "kept", "removed"])

    return _with_spans(docs, window).select("doc_id", "text", "spans").mapInArrow(run, "doc_id long, kept binary, removed array<struct<lo:int,hi:int>>")


def op9_repeats(spark, sf_dir: str) -> DataFrame:
    """Digests of remove_repeats(), taken where the texts are."""

    def run(batches):
        for batch in batches:
            out = [[], [], [], []]
            for text, spans in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("spans").to_pylist(), strict=True):
                cover = _cover(spans, WINDOW)
                ends = [0, *(x for r in cover for x in r), len(text)]
                sha = hashlib.sha256()
                for a, b in zip(ends[::2], ends[1::2], strict=True):
                    sha.update(text[a:b])
                for x, v in zip(out, (len(text), sum(b - a for a, b in cover), len(cover), sha.hexdigest()), strict=True):
                    x.append(v)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in out[:3]), pa.array(out[3], pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return _with_spans(docs, WINDOW).select("doc_id", "text", "spans").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
