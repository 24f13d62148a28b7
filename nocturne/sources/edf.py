"""Recordings in the European Data Format, plain or gzipped.

Files come through Spark's binaryFile reader, so any store that Spark reads will do. Headers are rows of a table; samples
are chunk rows (path, ch, t0, fs, x ARRAY<DOUBLE>), one for each signal and run of records, of the wanted channels only.
"""

from __future__ import annotations

import gzip
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: The fields of the main header and, per signal, of the signal headers, with their widths in bytes.
MAIN = (("version", 8), ("patient", 80), ("recording", 80), ("start_date", 8), ("start_time", 8), ("header_bytes", 8), ("reserved", 44), ("records", 8), ("duration", 8), ("signals", 4))
SIGNAL = (("label", 16), ("transducer", 80), ("dimension", 8), ("pmin", 8), ("pmax", 8), ("dmin", 8), ("dmax", 8), ("prefilter", 80), ("samples", 8), ("reserved", 32))

HEADERS = "path string, start_date string, start_time string, records long, duration double, ch string, dimension string, fs double, per_record long, scale double, offset double, error string"
CHUNKS = "path string, ch string, t0 double, fs double, x array<double>"


def _text(raw: bytes) -> str:
    return raw.decode("utf-8", "replace").strip(" \0")


def _number(text: str, kind):
    m = re.match(r"\s*[-+]?\d+" if kind is int else r"\s*[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?", text)
    return kind(m[0]) if m else kind(0)


def parse_header(data: bytes) -> tuple[dict, list[dict]]:
    """Main header and signal headers; the count of records follows from the size of the data."""
    if len(data) < 256:
        raise ValueError("shorter than a header")
    main, at = {}, 0
    for name, width in MAIN:
        main[name], at = _text(data[at : at + width]), at + width
    n = _number(main["signals"], int)
    if n <= 0 or len(data) < 256 * (n + 1):
        raise ValueError("no signals, or a header cut short")
    signals = [{} for _ in range(n)]
    for name, width in SIGNAL:
        for s in signals:
            s[name], at = _text(data[at : at + width]), at + width
    for i, s in enumerate(signals):
        s["label"] = s["label"] or f"ch{i}"
        s["samples"] = _number(s["samples"], int)
        lo, hi, dlo, dhi = (_number(s[k], float) for k in ("pmin", "pmax", "dmin", "dmax"))
        if s["samples"] < 0:
            raise ValueError(f"{s['label']}: negative samples in a record")
        if dhi == dlo:
            raise ValueError(f"{s['label']}: equal digital limits")
        s["scale"] = (hi - lo) / (dhi - dlo)
        s["offset"] = lo - dlo * s["scale"]
    main["duration"] = _number(main["duration"], float)
    if not main["duration"] > 0:
        raise ValueError("a record has no duration")
    width = 2 * sum(s["samples"] for s in signals)
    if width == 0:
        raise ValueError("records are empty")
    main["begin"], main["width"] = 256 * (n + 1), width
    main["records"] = (len(data) - main["begin"]) // width
    return main, signals


def _content(path: str, raw: bytes) -> bytes:
    return gzip.decompress(raw) if path.lower().endswith(".gz") else raw


def _head(path: str, raw: bytes) -> bytes:
    """At least the headers; of a gzipped file no more than these is inflated, if they state the count of records."""
    if not path.lower().endswith(".gz"):
        return raw
    main = zlib.decompressobj(31).decompress(raw, 256)
    n, records = _number(_text(main[252:256]), int), _number(_text(main[236:244]), int)
    return _content(path, raw) if records <= 0 else zlib.decompressobj(31).decompress(raw, 256 * (max(n, 0) + 1))


def _files(spark: SparkSession, path) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def read_headers(spark: SparkSession, path) -> DataFrame:
    """One row a signal; a file that cannot be read is one row with its error. The count of records is the header's,
    or, where that is not above 0, follows from the file's size."""
    return decode_headers(_files(spark, path))


def decode_headers(files: DataFrame) -> DataFrame:
    """read_headers() of files (path, content)."""

    def run(batches):
        for batch in batches:
            rows = []
            for p, raw in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                empty = dict.fromkeys(x.split()[0] for x in HEADERS.split(", "))
                try:
                    data = _head(p, raw)
                    main, signals = parse_header(data)
                    stated = _number(_text(data[236:244]), int)
                except (ValueError, OSError, EOFError, zlib.error) as e:
                    rows.append(empty | {"path": p, "error": str(e)})
                    continue
                rows += [empty | {"path": p, "start_date": main["start_date"], "start_time": main["start_time"], "records": stated if stated > 0 else main["records"], "duration": main["duration"], "ch": s["label"], "dimension": s["dimension"], "fs": s["samples"] / main["duration"], "per_record": s["samples"], "scale": s["scale"], "offset": s["offset"]} for s in signals]
            kinds = {"string": pa.string(), "long": pa.int64(), "double": pa.float64()}
            yield pa.RecordBatch.from_pylist(rows, pa.schema([(n, kinds[k]) for n, k in (x.split() for x in HEADERS.split(", "))]))

    return files.mapInArrow(run, HEADERS)


def read_edf(spark: SparkSession, path, channels: list[str] | None = None, chunk_seconds: float = 300.0, skip_bad: bool = False) -> DataFrame:
    """Samples of the wanted channels (any case; missing ones are no error), in physical units. A file that cannot be read
    fails the job, or with skip_bad gives no rows; read_headers() tells why."""
    return decode_samples(_files(spark, path), channels, chunk_seconds, skip_bad)


def decode_samples(files: DataFrame, channels: list[str] | None = None, chunk_seconds: float = 300.0, skip_bad: bool = False) -> DataFrame:
    """read_edf() of files (path, content)."""
    wanted = None if channels is None else {c.strip().lower() for c in channels}

    def run(batches):
        schema = pa.schema([("path", pa.string()), ("ch", pa.string()), ("t0", pa.float64()), ("fs", pa.float64()), ("x", pa.list_(pa.float64()))])
        for batch in batches:
            for p, raw in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                try:
                    data = _content(p, raw)
                    main, signals = parse_header(data)
                except (ValueError, OSError, EOFError, zlib.error):
                    if skip_bad:
                        continue
                    raise
                records = np.frombuffer(data, "<i2", main["records"] * main["width"] // 2, main["begin"]).reshape(main["records"], -1)
                step = max(1, int(chunk_seconds / main["duration"]))
                at, seen = 0, set()
                for s in signals:
                    n, key = s["samples"], s["label"].lower()
                    if n and key not in seen and (wanted is None or key in wanted):
                        seen.add(key)
                        rows = [{"path": p, "ch": s["label"], "t0": i * main["duration"], "fs": n / main["duration"], "x": records[i : i + step, at : at + n].ravel() * s["scale"] + s["offset"]} for i in range(0, main["records"], step)]
                        yield pa.RecordBatch.from_pylist(rows, schema)
                    at += n

    return files.mapInArrow(run, CHUNKS)


def encode_edf(signals: dict[str, np.ndarray], per_record: dict[str, int], limits: tuple[float, float], duration: float = 1.0, start: tuple[str, str] = ("01.01.24", "00.00.00"), dimension: str = "uV") -> bytes:
    """A file's bytes: each signal cut into whole records, the last filled with the least value; physical limits are met by
    -32768 and 32767."""
    lo, hi = limits
    scale = (hi - lo) / 65535
    records = max([-(-len(x) // per_record[c]) for c, x in signals.items()], default=0)
    raw = {c: np.full(records * per_record[c], -32768, "<i2") for c in signals}
    for c, x in signals.items():
        raw[c][: len(x)] = np.clip(np.rint((np.asarray(x, float) - lo) / scale) - 32768, -32768, 32767)
    fields = lambda values, width: b"".join(str(v)[:width].ljust(width).encode() for v in values)
    n = len(signals)
    main = {"version": 0, "start_date": start[0], "start_time": start[1], "header_bytes": 256 * (n + 1), "records": records, "duration": f"{duration:g}", "signals": n}
    own = {"label": list(signals), "dimension": [dimension] * n, "pmin": [f"{lo:g}"] * n, "pmax": [f"{hi:g}"] * n, "dmin": [-32768] * n, "dmax": [32767] * n, "samples": [per_record[c] for c in signals]}
    out = b"".join(fields([main.get(k, "")], w) for k, w in MAIN) + b"".join(fields(own.get(k, [""] * n), w) for k, w in SIGNAL)
    body = np.concatenate([raw[c].reshape(records, -1) for c in signals], axis=1) if records else np.zeros((0, 0), "<i2")
    return out + body.astype("<i2").tobytes()
