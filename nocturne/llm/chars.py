"""Code points of a batch and their regex classes."""

from __future__ import annotations

import functools

import numpy as np

OTHER, LETTER, NUMBER, BLANK = 0, 1, 2, 3

@functools.cache
def classes() -> np.ndarray:
    r"""By code point: \p{L}, \p{N}, \s or none of them, as the tokenizers library's own Unicode tables have it."""
    from tokenizers import Regex, pre_tokenizers

    # planes 4 to 13 are unassigned and the last two are private, none of them letters, numbers or blanks
    known = np.concatenate([np.arange(0xD800), np.arange(0xE000, 0x40000), np.arange(0xE0000, 0xE1000)]).astype(np.uint32)
    text = known.tobytes().decode("utf-32-le")
    out = np.full(0x110000, OTHER, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (BLANK, r"\s+")):
        for _, (start, end) in pre_tokenizers.Split(Regex(pattern), "removed", invert=True).pre_tokenize_str(text):
            out[known[start:end]] = kind
    return out


def code_points(data: np.ndarray) -> np.ndarray:
    if not len(data) or data.max() < 128:
        return data
    return np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)


def byte_starts(cp: np.ndarray) -> np.ndarray:
    """Where each code point begins in UTF-8, and where the last ends."""
    size = np.ones(len(cp), np.int64)
    if cp.dtype != np.uint8:
        for least in (0x80, 0x800, 0x10000):
            size += cp >= least
    out = np.zeros(len(cp) + 1, np.int64)
    np.cumsum(size, out=out[1:])
    return out
