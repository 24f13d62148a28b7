"""A corpus from raw documents: toxic ones out, boilerplate lines out, one of each near-duplicate group, a mixture to
target weights, and byte-level BPE.

Each stage takes (spark, docs, sf_dir) with docs as its predecessor left them; all but the last return the columns of
docs, whatever further ones it has. The last returns doc_id, n_tokens and the digests of the ids and of the text decoded
from them. Null texts stay null up to the last stage, which takes them for empty; rows with a null doc_id go no farther
than the mixture, whose decision needs it; repeated rows are scored each, and share one component and one decision.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nocturne.llm import bytebpe, linededup, minhash, mixing, toxicity
from nocturne.llm.scratch import Scratch, fresh


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. It learns from the labelled documents among these."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), toxicity.fold(3) != 1)
    (score,) = fresh(docs.columns, "_toxicity")
    return toxicity.with_score(docs, model, score).where(F.col(score) < toxicity.THRESHOLD).drop(score)


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that a source repeats on a tenth of its documents go; n_chars, where there is one, follows the text."""
    names = [c for c in docs.columns if c in ("n_lines", "n_dropped")]
    aside = fresh(docs.columns, *(f"{c}_" for c in names))
    out = linededup.drop_lines(docs.withColumnsRenamed(dict(zip(names, aside, strict=True)))).drop("n_lines", "n_dropped").withColumnsRenamed(dict(zip(aside, names, strict=True)))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long")))
    return out.select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles at a similarity of 0.8 or more, the one of least doc_id stays."""
    found = minhash.near_duplicates(docs.select("doc_id", "text"), words=5, percent=80)
    gone = Scratch(spark, "gone").save(found.where(~F.col("kept")).select("doc_id").distinct(), "gone")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are sampled so that tokens meet the target weights of source, language and topic, at a rate that lets
    them."""
    return mixing.sample(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE there and back."""
    return bytebpe.digests(docs)


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_boilerplate), ("minhash", drop_near_copies), ("mixing", mix_sources), ("byte_bpe", encode)]

ORACLE_SQL = None  # hashing, training and BPE are beyond SQL: each stage and the whole are tested against plain Python


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
