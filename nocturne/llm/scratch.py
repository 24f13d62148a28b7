"""Intermediate tables in the folder that the cluster shares.

A step that is used more than once is written as Parquet under ``spark.checkpoint.dir`` and read again: its lineage
ends there, so a lost executor costs one task of the step that reads it and not the steps before it.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder of the session; where none is set, a temporary folder on one machine, an error on a cluster,
    whose executors do not see each other's disks."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="nocturne-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def fresh(columns: list[str], *names: str) -> list[str]:
    """The names, each with as many underscores after it as it takes to be none of the columns, in any case."""
    taken, out = {c.lower() for c in columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


BATCH_ROWS = 1_000


def small_batches(spark: SparkSession) -> None:
    """Let Arrow batches of the session hold at most BATCH_ROWS rows. A batch is so many rows whatever their size, and is
    held several times over outside the heap; with 10 000 rows of text, two tasks at a time fill a small executor."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


class Scratch:
    """Named tables of one run of one operator."""

    def __init__(self, spark: SparkSession, what: str):
        small_batches(spark)
        self.spark, self.root, self.n = spark, f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}", 0

    def save(self, df: DataFrame, name: str = "t") -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n:03d}-{name}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that nothing reads any more."""
        jvm = self.spark.sparkContext._jvm
        for t in tables:
            p = jvm.org.apache.hadoop.fs.Path(t._scratch_path)
            p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
