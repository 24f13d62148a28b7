"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A document is the set of its hashed words, word pairs and pairs one word apart, each counted once, in ``DIM`` buckets.
Per-coordinate learning rates and an L1 penalty leave few weights, so the model is an array of at most ``DIM`` floats,
whatever the corpus, and is broadcast. Training takes at most ``MAX_TRAIN`` labelled documents, those of least hash, in
at most ``SHARDS`` groups of bounded size; each group trains alone and the weights are averaged (parameter mixing).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .scratch import small_batches
from .text import LOWER, U, Ranges, mix, sized, utf8

#: MAX_TRAIN bounds the sample of labelled rows that the classifier is fitted on; everything is scored.
MAX_TRAIN, SHARDS, PER_SHARD, EPOCHS = 16_000, 4, 4_000, 15
BITS = 20
DIM = 1 << BITS
ALPHA, BETA, L2 = 5.0, 1.0, 0.1
#: The L1 penalty is one unit for each 500 documents of a group, from 1 to L1_MOST; a feature of fewer than 3 documents has no weight.
L1_PER_DOCUMENT, L1_MOST, LEAST_DOCUMENTS, SETTLED = 1 / 500, 8.0, 3, 0.01
THRESHOLD = 0.7

#: Bytes of a word: digits, letters, and all that is not ASCII.
WORD = np.zeros(256, bool)
WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of every text in a row, and where each text's begin (and the last's end)."""
    inside = WORD[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    edge = np.concatenate([[False], inside, [False]])
    start = np.flatnonzero(inside & (~edge[:-2] | first[:-1]))
    end = np.flatnonzero(inside & (~edge[2:] | first[1:])) + 1
    row = np.searchsorted(offsets, start, "right") - 1
    h = Ranges(LOWER[data])(start, end)
    found, rows = [h], [row]
    for gap, salt in ((1, 0x8CB92BA72F3D8DD7), (2, 0xA0761D6478BD642F)):
        if len(h) > gap:
            same = row[gap:] == row[:-gap]
            found.append(mix(h[:-gap] * U(salt) + h[gap:])[same])
            rows.append(row[gap:][same])
    key = np.unique((np.concatenate(rows).astype(U) << U(BITS)) | (np.concatenate(found) >> U(64 - BITS)))
    return (key & U(DIM - 1)).astype(np.int64), np.searchsorted(key >> U(BITS), np.arange(len(offsets)))


def train(texts: pa.Array, toxic: np.ndarray, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights and bias after EPOCHS passes; a document that is off by less than SETTLED changes nothing."""
    parts = [features(*utf8(b.column("text"))) for b in sized([pa.RecordBatch.from_arrays([texts], ["text"])], "text")]
    x = np.concatenate([p for p, _ in parts]) if parts else np.zeros(0, np.int64)
    base = np.cumsum([0, *(c[-1] for _, c in parts)])
    cut = np.concatenate([[0], *(b + c[1:] for b, (_, c) in zip(base[:-1], parts, strict=True))]).astype(np.int64)
    del parts
    often = np.bincount(x, minlength=DIM)[x] >= LEAST_DOCUMENTS
    cut = np.concatenate([[0], np.cumsum(often)])[cut]
    x = x[often]
    l1 = min(L1_MOST, max(1.0, len(toxic) * L1_PER_DOCUMENT))
    z, n = np.zeros(DIM), np.zeros(DIM)
    zb = nb = 0.0
    rng = np.random.default_rng(seed)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(toxic)):
            at = x[cut[i] : cut[i + 1]]
            zi, ni = z[at], n[at]
            root = np.sqrt(ni)
            w = np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((BETA + root) / ALPHA + L2))
            b = -zb / ((BETA + nb**0.5) / ALPHA)
            g = 1 / (1 + np.exp(-np.clip(w.sum() + b, -35, 35))) - toxic[i]
            if abs(g) < SETTLED:
                continue
            z[at] = zi + g - (np.sqrt(ni + g * g) - root) / ALPHA * w
            n[at] = ni + g * g
            zb += g - ((nb + g * g) ** 0.5 - nb**0.5) / ALPHA * b
            nb += g * g
    w = np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((BETA + np.sqrt(n)) / ALPHA + L2))
    return w, -zb / ((BETA + nb**0.5) / ALPHA)


def fit(docs: DataFrame, labels: DataFrame, where=None) -> np.ndarray:
    """docs (doc_id, text), labels (doc_id, toxic) -> DIM weights and the bias. where: which doc_id may be learned from.

    Labels other than 0 and 1 (null too) are left out; a doc_id labelled more than once is toxic if any row says so, and of
    different texts of one doc_id the least is learned from.
    Without labels all weights are 0."""
    labels = labels.where(F.col("toxic").isin(0, 1))
    if where is not None:
        labels = labels.where(where)
    chosen = labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_TRAIN)
    shards = max(1, min(SHARDS, round(chosen.count() / PER_SHARD)))

    def run(table: pa.Table) -> pa.Table:
        w, b = train(table.column("text").combine_chunks(), table.column("toxic").to_numpy())
        at = np.flatnonzero(w)
        return pa.table({"at": pa.array(np.append(at, DIM)), "w": pa.array(np.append(w[at], b) / shards)})

    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic"))
    rows = rows.select(F.pmod(F.xxhash64(F.lit(1), "doc_id"), F.lit(shards)).alias("shard"), "text", "toxic")
    got = rows.groupBy("shard").applyInArrow(run, "at long, w double").groupBy("at").agg(F.sum("w").alias("w")).toArrow()
    out = np.zeros(DIM + 1, np.float64)
    out[got.column("at").to_numpy()] = got.column("w").to_numpy()
    return out


def with_score(docs: DataFrame, model: np.ndarray, name: str = "score") -> DataFrame:
    """All rows and columns of docs, in their order, and the score (0 to 1) as column ``name``, which docs must not
    have. Null and empty texts have the score of the bias alone."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        w = shared.value
        for batch in sized(batches, "text"):
            x, cut = features(*utf8(batch.column("text")))
            total = np.concatenate([[0], np.cumsum(w[x])])
            yield batch.append_column(name, pa.array(1 / (1 + np.exp(-np.clip(total[cut[1:]] - total[cut[:-1]] + w[DIM], -35, 35)))))

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, DoubleType())]))


def score(docs: DataFrame, model: np.ndarray) -> DataFrame:
    """docs (doc_id, text) -> doc_id, score."""
    return with_score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model).select("doc_id", "score")


def fold(mod: int):
    """The fold of a doc_id: crc32 of its decimal text, by mod."""
    return F.crc32(F.col("doc_id").cast("string")) % mod


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs (doc_id, text), labels (doc_id, toxic) -> doc_id, held_out, score, predicted.

    Rows of fold 1 of 3 are never learned from. One row for each row of docs, in no order; extra columns are ignored;
    an empty table gives none."""
    model = fit(docs, labels, fold(3) != 1)
    return score(docs, model).select("doc_id", F.coalesce(fold(3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return classify(docs.select("doc_id", "text"), labels.select("doc_id", "toxic"))
