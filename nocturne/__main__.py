"""python -m nocturne extract --spect S.npy --stimes T.npy --sfreqs F.npy --out peaks.csv"""

from __future__ import annotations

import argparse

import numpy as np

from . import arrays
from .functions.digits import significant, time_places
from .sources.peaks_csv import COLUMNS, FREQUENCIES, TIMES, preamble


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="nocturne")
    extract = out.add_subparsers(dest="what", required=True).add_parser("extract", help="peaks of a spectrogram in .npy files")
    for name in ("spect", "stimes", "sfreqs", "out"):
        extract.add_argument(f"--{name}", required=True)
    extract.add_argument("--labels-out")
    for name, value in (("seg-time", 30.0), ("merge-thresh", 11.0), ("trim-vol", 0.8), ("dur-min", 0.5), ("dur-max", 5.0), ("bw-min", 2.0), ("bw-max", 15.0)):
        extract.add_argument(f"--{name}", type=float, default=value)
    for name, value in (("downsample-f", 2), ("downsample-t", 2), ("expand-labels-distance", 0)):
        extract.add_argument(f"--{name}", type=int, default=value)
    return out


NAMES = {"PeakTime": "peak_time", "PeakFrequency": "peak_freq", "Duration": "duration", "Bandwidth": "bandwidth", "Height": "height", "Volume": "volume", "SegmentNum": "segment", "Area": "area", "Peakiness": "peakiness", "bbox_tl_s": "bbox_t", "bbox_tl_Hz": "bbox_f"}


def main(args: list[str] | None = None) -> int:
    a = parser().parse_args(args)
    image, times, freqs = (np.load(x, allow_pickle=False).astype(float) for x in (a.spect, a.stimes, a.sfreqs))
    rows, labels = arrays.extract_peaks(image, times, freqs, None, a.seg_time, (a.dur_min, a.dur_max), (a.bw_min, a.bw_max), threshold=a.merge_thresh, keep=a.trim_vol, stride=(a.downsample_t, a.downsample_f), reach=a.expand_labels_distance)
    fs = 1 / (times[1] - times[0]) if len(times) > 1 else float("nan")
    places = dict.fromkeys(TIMES, time_places(fs)) | dict.fromkeys(FREQUENCIES, 4)
    with open(a.out, "w", encoding="utf-8") as f:
        info = arrays.build_info()
        f.write("\n".join([*preamble("nocturne", info["version"], info["version"]), ",".join(COLUMNS)]) + "\n")
        for r in rows:
            cells = [r["segment"] if c == "SegmentNum" else 0 if c == "PeakStage" else significant(r[NAMES[c]], places.get(c, 3)) if c in NAMES else float("nan") for c in COLUMNS]
            f.write(",".join(str(x) for x in cells) + "\n")
    if a.labels_out:
        with open(a.labels_out, "wb") as f:
            f.write(arrays.save_labels(labels))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
