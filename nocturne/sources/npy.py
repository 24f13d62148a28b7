"""Arrays in numpy's file format: spectrograms, label images and filters."""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..kernels.filters import cheby1_sos

ROWS = "path string, row long, x array<double>"


def read_npy(spark: SparkSession, path) -> DataFrame:
    """(path, row, x): the rows of arrays of one or two dimensions; a vector is one row."""
    return decode_npy(spark.read.format("binaryFile").load(path).select("path", "content"))


def decode_npy(files: DataFrame) -> DataFrame:
    """read_npy() of files (path, content)."""

    def run(batches):
        schema = pa.schema([("path", pa.string()), ("row", pa.int64()), ("x", pa.list_(pa.float64()))])
        for batch in batches:
            for p, raw in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                a = np.atleast_2d(np.load(io.BytesIO(raw), allow_pickle=False))
                if a.ndim != 2:
                    raise ValueError(f"{p}: {a.ndim} dimensions")
                for lo in range(0, len(a), 256):
                    part = a[lo : lo + 256]
                    yield pa.RecordBatch.from_pylist([{"path": p, "row": lo + i, "x": r.astype(float)} for i, r in enumerate(part)], schema)

    return files.mapInArrow(run, ROWS)


def encode_labels(pixels: DataFrame, rec: str = "rec", rows: int | None = None, columns: int | None = None) -> DataFrame:
    """pixels (rec, f_idx, t_idx, label) -> (rec, content): the label image (frequencies by times, 0 elsewhere) of each
    recording as the bytes of a file; its size is the least that holds the pixels, or as given."""

    def run(table):
        f, t = table.column("f_idx").to_numpy(), table.column("t_idx").to_numpy()
        image = np.zeros((rows or int(f.max()) + 1, columns or int(t.max()) + 1), np.int64)
        image[f, t] = table.column("label").to_numpy()
        out = io.BytesIO()
        np.save(out, image)
        return table.select([rec]).slice(0, 1).append_column("content", pa.array([out.getvalue()], pa.binary()))

    kind = f"`{rec}` {pixels.schema[rec].dataType.simpleString()}, content binary"
    return pixels.select(rec, "f_idx", "t_idx", "label").groupBy(rec).applyInArrow(run, kind)


def general(v: float) -> str:
    """A number as %g has it where whole, else as it is."""
    return str(int(v)) if v == int(v) else repr(float(v))


def filter_name(fs: float, band: tuple[float, float]) -> str:
    """The file in which a band's filter is kept."""
    return f"sophase_sos_Fs{general(fs)}_{general(band[0])}_{general(band[1])}.npy"


def phase_filter(spark: SparkSession, fs: float, band: tuple[float, float], folder: str | None = None) -> np.ndarray:
    """Second-order sections of the slow-oscillation band: the folder's file, or a Chebyshev design where there is none."""
    if folder is not None:
        path = f"{folder.rstrip('/')}/{filter_name(fs, band)}"
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
            rows = sorted(read_npy(spark, path).collect(), key=lambda r: r["row"])  # a filter has a few rows
            return np.array([r["x"] for r in rows])
    return cheby1_sos(4, 0.2, band, fs, "bandpass")
