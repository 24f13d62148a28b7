"""Labelled regions: resizing, growing, trimming to volume, masks for a second pass, smoothing."""

from __future__ import annotations

import numpy as np

from .watershed import SMALL, _shifted, components, outline

FOUR = ((-1, 0), (1, 0), (0, -1), (0, 1))


def resize(label: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    """Nearest-neighbour copy at another size, pixel centres aligned, halves upward."""
    at = []
    for n, m in zip(label.shape, shape, strict=True):
        scale = m / n
        place = np.arange(1, m + 1) / scale + 0.5 * (1 - 1 / scale)
        at.append(np.clip(np.floor(place + 0.5).astype(int), 1, n) - 1)
    return label[np.ix_(*at)]


def grow(label: np.ndarray, steps: int) -> np.ndarray:
    """Background within so many steps up, down or sideways takes the nearest label; of equals the least."""
    none = np.iinfo(np.int64).max
    out = np.where(label > 0, label, none).astype(np.int64)
    for _ in range(steps):
        near = np.full(out.shape, none)
        for di, dj in FOUR:
            near = np.minimum(near, _shifted(out, di, dj, none))
        out = np.where(out == none, near, out)
    return np.where(out == none, 0, out)


def _filled(mask: np.ndarray) -> np.ndarray:
    """The mask and the holes that are not joined to the outside up, down or sideways."""
    wide = np.zeros((mask.shape[0] + 2, mask.shape[1] + 2), bool)
    wide[1:-1, 1:-1] = mask
    if mask.size <= SMALL:
        met, step, ahead = wide.ravel().tolist(), wide.shape[1], [0]
        met[0] = True
        while ahead:
            p = ahead.pop()
            for q in (p - 1, p + 1, p - step, p + step):
                if 0 <= q < len(met) and not met[q]:
                    met[q] = True
                    ahead.append(q)
        return mask | ~np.array(met).reshape(wide.shape)[1:-1, 1:-1]
    outside = np.zeros(wide.shape, bool)
    outside[0, :] = outside[-1, :] = outside[:, 0] = outside[:, -1] = True
    while True:
        new = outside.copy()
        for di, dj in FOUR:
            new |= _shifted(outside, di, dj, False)
        new &= ~wide
        if (new == outside).all():
            return ~outside[1:-1, 1:-1]
        outside = new


def trim(label: np.ndarray, value: np.ndarray, keep: float = 0.8, floor: float | None = None) -> np.ndarray:
    """Each region cut at the level above which it holds the share ``keep`` of its volume over the floor (the image's
    minimum if not given); holes are filled and the part of greatest volume stays. Single pixels go; regions that are
    flat, or have no volume, stay whole. Later labels lie over earlier ones."""
    floor = np.nanmin(value) if floor is None or floor != floor else floor
    out = np.zeros(label.shape, np.int64)
    r, c = np.nonzero(label > 0)
    order = np.argsort(label[r, c], kind="stable")
    k_of, r, c = label[r, c][order], r[order], c[order]
    first = np.flatnonzero(np.append(len(k_of) > 0, k_of[1:] != k_of[:-1])[: len(k_of)])
    if not len(first):
        return out
    size = np.diff(np.append(first, len(k_of)))
    boxes = zip(k_of[first].tolist(), size.tolist(), *(f.reduceat(x, first).tolist() for x in (r, c) for f in (np.minimum, np.maximum)), strict=True)
    for k, n, r0, r1, c0, c1 in boxes:
        if n < 2:
            continue
        box = np.s_[r0 : r1 + 1, c0 : c1 + 1]
        own = label[box] == k
        volume = np.where(own, np.maximum(np.nan_to_num(value[box] - floor), 0), 0.0)
        v = np.sort(volume[own])
        if v[0] == v[-1] or v.sum() <= 0:
            out[box][own] = k
            continue
        run = np.cumsum(v)
        level = v[int(np.argmax(run > (1 - keep) * run[-1]))]
        part = components(_filled(own & (volume >= level)))
        whole = np.maximum(np.nan_to_num(value[box] - floor), 0)
        best = np.bincount(part.ravel(), whole.ravel())
        best[0] = -1
        out[box][part == int(best.argmax())] = k
    return out


def contours(label: np.ndarray) -> np.ndarray:
    """True on the outline of every region."""
    out = np.zeros(label.shape, bool)
    for k in np.unique(label[label > 0]).tolist():
        for p in outline(label == k):
            out[p] = True
    return out


def second_pass(image: np.ndarray, times: np.ndarray, label: np.ndarray, label_times: np.ndarray) -> np.ndarray:
    """image where the label column nearest in time has a region, inside its outline; 0 elsewhere."""
    at = np.searchsorted(label_times, times)
    at = np.clip(at, 1, len(label_times) - 1) if len(label_times) > 1 else np.zeros(len(times), int)
    at = at - (times - label_times[at - 1] < label_times[at] - times) if len(label_times) > 1 else at
    inside = (label > 0) & ~contours(label)
    return np.where(inside[:, at], image, 0.0)


def blur(x: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian smoothing to two sigmas, edges repeated, values that are not finite taken as 0."""
    if sigma <= 0:
        return np.where(np.isfinite(x), x, 0.0)
    reach = int(np.ceil(2 * sigma))
    w = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    w /= w.sum()
    out = np.where(np.isfinite(x), x, 0.0)
    for axis in (0, 1):
        pad = [(reach, reach) if a == axis else (0, 0) for a in (0, 1)]
        out = np.lib.stride_tricks.sliding_window_view(np.pad(out, pad, mode="edge"), 2 * reach + 1, axis=axis) @ w
    return out


def so_phase(x: np.ndarray, sos: np.ndarray, excluded: np.ndarray | None = None) -> np.ndarray:
    """Unwrapped phase of the zero-phase filtered signal; NaN at excluded samples."""
    from .filters import analytic, sosfiltfilt

    out = np.unwrap(np.angle(analytic(sosfiltfilt(sos, x))))
    return out if excluded is None else np.where(excluded, np.nan, out)
