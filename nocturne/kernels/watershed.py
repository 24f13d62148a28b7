"""Segmentation of an image into basins and the merging of basins.

Images are flattened column by column, because ties are decided by the order in which pixels are met. Labels are from 1;
0 is background or a line between basins.
"""

from __future__ import annotations

import heapq
import math

import numpy as np

#: Images up to this size are labelled by a walk over their pixels, larger ones by arrays.
SMALL = 1_024
EIGHT = [(i, j) for j in (-1, 0, 1) for i in (-1, 0, 1) if i or j]


def _shifted(x: np.ndarray, di: int, dj: int, fill) -> np.ndarray:
    """x[r + di, c + dj] at [r, c]."""
    out = np.full_like(x, fill)
    r, c = x.shape
    out[max(0, -di) : r - max(0, di), max(0, -dj) : c - max(0, dj)] = x[max(0, di) : r - max(0, -di), max(0, dj) : c - max(0, -dj)]
    return out


def components(mask: np.ndarray) -> np.ndarray:
    """Labels of 8-connected components, numbered by their first pixel going down the columns.

    Every pixel takes the least place number around it, and then that of the place it points to, until all agree."""
    if mask.size <= SMALL:
        return _walked(mask)
    place = np.arange(mask.size).reshape(mask.shape[::-1]).T
    none = mask.size
    low = np.where(mask, place, none)
    while True:
        new = low
        for di, dj in EIGHT:
            new = np.minimum(new, _shifted(low, di, dj, none))
        new = np.where(mask, new, none)
        flat = np.append(new.ravel(order="F"), none)
        flat = flat[flat]
        new = flat[:-1].reshape(mask.shape, order="F")
        if (new == low).all():
            break
        low = new
    roots = np.unique(low[mask])
    return np.where(mask, np.searchsorted(roots, low) + 1, 0)


def _walked(mask: np.ndarray) -> np.ndarray:
    """components() of a small mask."""
    high = mask.shape[0] + 2
    wide = np.zeros((mask.shape[1] + 2, high), np.int64)
    wide[1:-1, 1:-1] = mask.T
    left, count = wide.ravel().tolist(), 0
    out = [0] * len(left)
    around = (-high - 1, -high, -high + 1, -1, 1, high - 1, high, high + 1)
    for start in np.flatnonzero(wide.ravel()).tolist():
        if not left[start]:
            continue
        count += 1
        left[start], out[start], ahead = 0, count, [start]
        while ahead:
            p = ahead.pop()
            for d in around:
                if left[p + d]:
                    left[p + d], out[p + d] = 0, count
                    ahead.append(p + d)
    return np.array(out).reshape(wide.shape)[1:-1, 1:-1].T


def minima(x: np.ndarray) -> np.ndarray:
    """Pixels of plateaus without a lower neighbour; NaN is never one."""
    can = ~np.isnan(x)
    level = np.where(can, x, np.inf)
    lower = np.zeros(x.shape, bool)
    for di, dj in EIGHT:
        lower |= _shifted(level, di, dj, np.inf) < level
    can &= ~lower
    while True:  # a plateau loses all its pixels if one of them has a lower neighbour
        bad = np.zeros(x.shape, bool)
        for di, dj in EIGHT:
            bad |= _shifted(lower, di, dj, False) & (_shifted(level, di, dj, np.inf) == level)
        bad &= can
        if not bad.any():
            return can
        can &= ~bad
        lower |= bad


def watershed(x: np.ndarray) -> np.ndarray:
    """Basins of the regional minima by flooding: the lowest pixel first, those of one level in the order they were
    met; a pixel between two basins is a line."""
    r, c = x.shape
    label = components(minima(x)).ravel(order="F")
    value = x.ravel(order="F").tolist()
    state = label.tolist()
    met = (label > 0).tolist()
    steps = [di + dj * r for di, dj in EIGHT]
    rows = np.tile(np.arange(r), c).tolist()
    cols = np.repeat(np.arange(c), r).tolist()

    def around(p):
        i, j = rows[p], cols[p]
        for (di, dj), s in zip(EIGHT, steps, strict=True):
            if 0 <= i + di < r and 0 <= j + dj < c:
                yield p + s

    heap, count = [], 0

    def meet(p, least):
        nonlocal count
        for q in around(p):
            if not met[q] and value[q] == value[q]:
                met[q] = True
                heapq.heappush(heap, (max(value[q], least), count, q))
                count += 1

    for p in np.flatnonzero(label).tolist():
        meet(p, value[p])
    while heap:
        level, _, p = heapq.heappop(heap)
        own = {state[q] for q in around(p)} - {0}
        if len(own) == 1:
            state[p] = own.pop()
            meet(p, level)
    return np.array(state).reshape((r, c), order="F")


def basins(x: np.ndarray) -> np.ndarray:
    """Watershed, and then one label for what touches across a corner."""
    return components(watershed(x) > 0)


class Region:
    """Pixels of one basin: its inside, the pixels of other labels around it, both and what they were at every merge,
    and the labels of the regions near it."""

    __slots__ = ("inside", "border", "every", "near", "_known")

    def __init__(self, inside: set[int], border: set[int]):
        self.inside, self.border, self.every, self.near, self._known = inside, border, inside | border, set(), None

    def extremes(self, value: list[float]) -> tuple[float, float]:
        """Lowest value of the border, highest of all; of one and the same image."""
        if self._known is None:
            edge = [x for x in map(value.__getitem__, self.border) if x == x]
            top = max((x for x in map(value.__getitem__, self.inside) if x == x), default=-math.inf)
            self._known = min(edge, default=math.nan), max(top, max(edge, default=-math.inf))
        return self._known

    def take(self, other: Region) -> None:
        """What both borders hold is on no border any more, and inside neither."""
        self.inside |= other.inside
        self.border ^= other.border
        self.every |= other.every
        self._known = None


def _sets(label: np.ndarray, place: np.ndarray) -> dict[int, set[int]]:
    """The places of each label above 0."""
    order = np.argsort(label, kind="stable")
    order = order[label[order] > 0]
    cut = np.flatnonzero(label[order][1:] != label[order][:-1]) + 1
    return {int(label[part[0]]): set(place[part].tolist()) for part in np.split(order, cut) if len(part)}


def graph(label: np.ndarray) -> dict[int, Region]:
    """Regions by label. A border pixel touches the region, also across a corner; regions are near each other if they
    lie within a 5 by 5 square of each other's pixels."""
    r, c = label.shape
    regions = {}
    place = np.arange(label.size).reshape((c, r)).T
    place = place.ravel()
    touch = np.stack([_shifted(label, di, dj, 0).ravel() for di, dj in EIGHT])
    at, each = np.nonzero((touch > 0) & (touch != label.ravel()))
    edge = np.unique(touch[at, each].astype(np.int64) * label.size + place[each])
    inside, border = _sets(label.ravel(), place), _sets(edge // max(label.size, 1), edge % max(label.size, 1))
    for k, own in sorted(inside.items()):
        regions[k] = Region(own, border.get(k, set()))
    for di in range(-2, 3):
        for dj in range(-2, 3):
            other = _shifted(label, di, dj, 0)
            both = (label > 0) & (other > 0) & (other != label)
            for a, b in np.unique(np.stack([label[both], other[both]]), axis=1).T.tolist():
                regions[a].near.add(b)
                regions[b].near.add(a)
    return regions


def weight(a: Region, b: Region, value) -> float | None:
    """Twice the highest pixel that both borders hold, less what the regions rise above their own borders:
    2 max(shared) + max(-min(border a) - max(b), -min(border b) - max(a)); none without such a pixel. value: a list."""
    shared = a.border & b.border
    if not shared:
        return None
    value = value.tolist() if isinstance(value, np.ndarray) else value
    (low_a, top_a), (low_b, top_b) = a.extremes(value), b.extremes(value)
    ridge = max((x for x in map(value.__getitem__, shared) if x == x), default=math.nan)
    return float(2 * ridge + max(-low_a - top_b, -low_b - top_a))


def merged(label: np.ndarray, height: np.ndarray, threshold: float = 8.0, most: float = math.inf, absorb: bool = True) -> dict[int, Region]:
    """Regions by label after merging along edges, the heaviest first, of equals the first of the table.

    absorb: peaks of spectrograms. Edges above the threshold merge, the second region of the edge's row into the first;
    rows of a survivor move to the end of the table, and of two rows that come to name the same pair the earlier keeps
    its direction. Former neighbours whose only neighbour is now the survivor are taken in. Otherwise, modes of
    histograms: edges at the threshold merge too, the higher label into the lower, rows stay in place and nothing else
    is taken in. A threshold of NaN is the 95th percentile of the first weights; most: merges at most."""
    value, regions = height.ravel(order="F").tolist(), graph(label)
    rows: dict[tuple[int, int], tuple[float, int, tuple[int, int]]] = {}  # weight, place in the table, direction
    heap: list = []
    pair = lambda a, b: (min(a, b), max(a, b))

    def put(key, w, place, way):
        rows[key] = (w, place, way)
        heapq.heappush(heap, (-w, place, key))

    places = 0
    for a in sorted(regions):
        for b in sorted(regions[a].near):
            if a < b and (w := weight(regions[a], regions[b], value)) is not None:
                put((a, b), w, places, (a, b))
                places += 1
    if threshold != threshold:
        w = np.sort([x[0] for x in rows.values()])
        h = min(max(0.95 * len(w) + 0.5, 1), len(w)) if len(w) else 1
        threshold = float(w[int(h) - 1] + (h % 1) * (w[min(int(h), len(w) - 1)] - w[int(h) - 1])) if len(w) else 0.0
    old_place = {}
    merges = 0
    while heap and merges < most:
        w, place, key = heapq.heappop(heap)
        if rows.get(key, (None, None))[:2] != (-w, place):
            continue
        if -w < threshold or absorb and -w == threshold:
            break
        keep, gone = rows[key][2] if absorb else key
        lost = regions.pop(gone)
        moved = {}
        for n in lost.near:
            row = rows.pop(pair(gone, n), None)
            if row and n != keep:
                moved[n] = (row[1], tuple(keep if x == gone else x for x in row[2]))
        whole = regions[keep]
        whole.take(lost)
        whole.near = (whole.near | lost.near) - {keep, gone}
        for n in lost.near - {keep}:
            if n in regions:
                regions[n].near.discard(gone)
                regions[n].near.add(keep)
        for n in sorted(lost.near - {keep}) if absorb else ():
            if n in regions and regions[n].near == {keep}:
                whole.take(regions.pop(n))
                whole.near.discard(n)
                rows.pop(pair(keep, n), None)
        for n in sorted(whole.near & regions.keys()):
            at = pair(keep, n)
            w = weight(whole, regions[n], value)
            before = rows.pop(at, None)
            if w is None:
                whole.near.discard(n)
                regions[n].near.discard(keep)
                continue
            known = [x for x in (before and before[1:], moved.get(n)) if x]
            way = min(known)[1] if known else at
            if before and not absorb:
                place = before[1]
            elif not absorb and at in old_place:
                place = old_place[at]
            else:
                place, places = places, places + 1
            old_place[at] = place
            put(at, w, place, way)
        whole.near &= regions.keys()
        merges += 1
    return regions


def merge(label: np.ndarray, height: np.ndarray, threshold: float = 8.0, most: float = math.inf, view: str = "inside") -> np.ndarray:
    """Label image after merged(). view: "inside", without borders; "border", insides and borders, later labels over
    earlier ones; "every", by the rules of modes, all pixels that a region has held, later labels over earlier ones."""
    out = np.zeros(label.size, np.int64)
    for k, region in sorted(merged(label, height, threshold, most, view != "every").items()):
        pixels = {"inside": region.inside, "border": region.inside | region.border, "every": region.every}[view]
        out[list(pixels)] = k
    return out.reshape(label.shape, order="F")


def paint(label: np.ndarray) -> np.ndarray:
    """Each region grown by one pixel all round, later labels over earlier ones, numbered densely."""
    _, dense = np.unique(np.append(label.ravel(), 0), return_inverse=True)
    dense = dense[:-1].reshape(label.shape)
    out = dense.copy()
    for di, dj in EIGHT:
        out = np.maximum(out, _shifted(dense, di, dj, 0))
    return out


def outline(mask: np.ndarray) -> list[tuple[int, int]]:
    """Clockwise boundary of the region of the first pixel going down the columns, closed by its start; one pixel is
    its own boundary."""
    ring = [(0, -1), (-1, -1), (-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1)]
    r, c = mask.shape
    at = np.flatnonzero(mask.ravel(order="F"))
    if not len(at):
        return []
    start = (int(at[0] % r), int(at[0] // r))
    p, back, out, first = start, 0, [start], None
    while True:
        for k in range(1, 9):
            d = (back + k) % 8
            q = p[0] + ring[d][0], p[1] + ring[d][1]
            if 0 <= q[0] < r and 0 <= q[1] < c and mask[q]:
                break
        else:
            return out
        if first is None:
            first = (p, d)
        elif (p, d) == first:
            return out
        out.append(q)
        before = (d + 7) % 8
        came = p[0] + ring[before][0] - q[0], p[1] + ring[before][1] - q[1]
        p, back = q, ring.index(came)
