"""Permutation test of two groups over many bins with one bound of familywise error."""

from __future__ import annotations

import math

import numpy as np

#: What a bound lies above its null value by, and how far the achieved error rate may be off unremarked.
OFFSET, TOLERANCE = 1e-5, 0.01
#: Values of group membership that are held at a time.
BLOCK = 4_000_000
MASK = (1 << 64) - 1


def last(n):
    """Draws from here on are thrown away where a number below n is wanted."""
    return MASK - MASK % n


class Xoshiro:
    """The public xoshiro256++ generator, its state spread from one seed by SplitMix64 (Blackman and Vigna, 2019)."""

    def __init__(self, seed: int):
        self.s, z = [], seed & MASK
        for _ in range(4):
            z = (z + 0x9E3779B97F4A7C15) & MASK
            x = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & MASK
            x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & MASK
            self.s.append(x ^ (x >> 31))

    def __next__(self) -> int:
        a, b, c, d = self.s
        turn = lambda x, k: ((x << k) | (x >> (64 - k))) & MASK
        out = (turn((a + d) & MASK, 23) + a) & MASK
        c, d = c ^ a, d ^ b
        self.s = [a ^ d, b ^ c, c ^ ((b << 17) & MASK), turn(d, 45)]
        return out

    def below(self, n: int) -> int:
        """Even over 0 .. n - 1: draws of the last, unfull stretch are thrown away."""
        while (v := next(self)) >= last(n):
            pass
        return v % n

    def shuffle(self, items: list) -> None:
        for i in range(len(items) - 1, 0, -1):
            j = self.below(i + 1)
            items[i], items[j] = items[j], items[i]


class Stream:
    """The draws of a Xoshiro one after another, LANES at a time: lane i starts ``steps`` draws after lane i - 1. A step
    of the generator is linear over bits, so ``steps`` of them are a matrix, which brings a lane's state to the next."""

    LANES = 2_048

    def __init__(self, source: Xoshiro, total: int):
        """total: draws that will be wanted, about; more can be taken."""
        self.steps = min(max(-(-total // self.LANES), 1), 2_048)
        self.jump = _power(_step_matrix(), self.steps)
        self.bits, self.held = _bits(np.array([source.s], np.uint64)), np.zeros(0, np.uint64)
        power = self.jump
        while len(self.bits) < self.LANES:
            self.bits = np.concatenate([self.bits, _times(self.bits, power)])
            power = _times(power, power)
        self.block = power  # as many steps as all lanes make

    def take(self, n: int) -> np.ndarray:
        parts = [self.held]
        while sum(map(len, parts)) < n:
            parts.append(self._more())
        all_ = np.concatenate(parts) if len(parts) > 1 else parts[0]
        self.held = all_[n:]
        return all_[:n]

    def _more(self) -> np.ndarray:
        s, out = list(_words(self.bits)), np.empty((self.steps, self.LANES), np.uint64)
        turn = lambda x, k: (x << np.uint64(k)) | (x >> np.uint64(64 - k))
        for row in out:
            a, b, c, d = s
            np.add(turn(a + d, 23), a, out=row)
            c, d = c ^ a, d ^ b
            s = [a ^ d, b ^ c, c ^ (b << np.uint64(17)), turn(d, 45)]
        self.bits = _times(self.bits, self.block)
        return out.T.ravel()


def _bits(states: np.ndarray) -> np.ndarray:
    """(n, 4) words -> (n, 256) bits as floating-point numbers, in which products are fast."""
    return np.unpackbits(states.astype("<u8").view(np.uint8).reshape(len(states), 32), axis=1, bitorder="little").astype(np.float32)


def _words(bits: np.ndarray) -> np.ndarray:
    """(n, 256) bits -> (4, n) words."""
    return np.ascontiguousarray(np.packbits(bits.astype(np.uint8), axis=1, bitorder="little").view("<u8").astype(np.uint64).T)


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.mod(a @ b, 2)  # sums of at most 256 ones are exact


def _step_matrix() -> np.ndarray:
    """What one step makes of each single bit."""
    out = []
    for i in range(256):
        x = Xoshiro(0)
        x.s = [(1 << i >> 64 * j) & MASK for j in range(4)]
        next(x)
        out.append(x.s)
    return _bits(np.array(out, np.uint64))


def _power(m: np.ndarray, n: int) -> np.ndarray:
    out = np.eye(len(m), dtype=np.float32)
    while n:
        out, m, n = _times(out, m) if n & 1 else out, _times(m, m), n >> 1
    return out


def shuffles(seed: int, m: int, n: int):
    """The order of m items after each of n shuffles of Xoshiro(seed), one upon the other, without a step an item."""
    draw, order = Xoshiro(seed), np.arange(m)
    if m < 64 or m * n < 1 << 18:
        items = order.tolist()
        for _ in range(n):
            draw.shuffle(items)
            yield np.array(items)
        return
    stream, size = Stream(draw, (m - 1) * n), np.arange(m, 1, -1).astype(np.uint64)
    limit = last(size)
    for _ in range(n):
        v = stream.take(m - 1)
        at = 0
        while len(bad := np.flatnonzero(v[at:] >= limit[at:])):  # such a draw is thrown away, and the next takes its place
            at += bad[0]
            v = np.concatenate([v[:at], v[at + 1 :], stream.take(1)])
        order = order[_swapped((v % size)[::-1].astype(np.int64))]
        yield order


def _swapped(j: np.ndarray) -> np.ndarray:
    """What lies where after places i = m - 1 .. 1 are exchanged with j[i - 1] each, j[i - 1] <= i.

    Place i takes what lay at its j just then: what came there from the last exchange before with this j, that of the
    least i' > i, which lay at i' till then; if there was none, the item of the place itself."""
    m = len(j) + 1
    shift = np.int64(m.bit_length())
    j = np.append(0, j)  # place 0 is left with what lies there at the end
    key = np.sort((j << shift) | np.arange(m))
    kind = np.int32 if m < 1 << 31 else np.int64
    i, of = (key & ((1 << shift) - 1)).astype(kind), (key >> shift).astype(kind)
    later = np.full(m, -1, kind)  # the exchange that put something at j[i] before i, if any
    same = of[1:] == of[:-1]
    later[i[:-1][same]] = i[1:][same]
    first = np.full(m, -1, kind)  # the last exchange, of i' > x, that put something at x
    head = np.flatnonzero(np.append(True, ~same))
    x, least = of[head], i[head]
    second = np.full(len(head), -1, kind)
    more = np.append(head[1:], m) - head > 1
    second[more] = i[head[more] + 1]
    first[x] = np.where(least > x, least, second)  # j[x] = x puts nothing anywhere
    root = np.where(first < 0, np.arange(m, dtype=kind), first)
    while True:  # what lay at i' came, in turn, from a later i'
        further = root[root]
        if np.array_equal(further, root):
            break
        root = further
    return np.where(later < 0, j, root[later])


def permutation_test(a: np.ndarray, b: np.ndarray, alpha: float = 0.05, n: int = 10_000, seed: int = 0) -> dict:
    """a, b: (bins, observations). diff: mean a - mean b per bin; bound: what |diff| must reach; significant; reached:
    how many permutations reach the bound in some bin; warning: a text, or None.

    Observations that are missing everywhere are left out; a group without any is an error. The null values of each bin
    are sorted downward, missing ones first, and the bound, OFFSET above the value, moves down a rank at a time to the
    first at which ceil(alpha n) permutations reach it in some bin. If that is all of them there is no bound (0) and a
    warning. A bin with too few values in a group has no difference and is not significant."""
    if not 0 < alpha <= 1:
        raise ValueError(f"alpha must be above 0 and at most 1, not {alpha}")
    if n < 1:
        raise ValueError("at least one permutation is needed")
    a, b = (np.where(np.isfinite(x), x, np.nan) for x in (np.asarray(a, float), np.asarray(b, float)))
    if not len(a) or len(a) != len(b):
        raise ValueError("both groups need the same bins, at least one")
    a, b = (x[:, ~np.isnan(x).all(axis=0)] for x in (a, b))
    if not a.shape[1] or not b.shape[1]:
        raise ValueError("both groups need at least one observation")
    x = np.concatenate([a, b], axis=1)
    there, value = ~np.isnan(x), np.nan_to_num(x)

    def difference(first: np.ndarray) -> np.ndarray:
        """(permutations, bins) for rows of group membership."""
        s = first.astype(float)
        with np.errstate(invalid="ignore", divide="ignore"):
            return (s @ value.T) / (s @ there.T) - ((1 - s) @ value.T) / ((1 - s) @ there.T)

    diff = difference((np.arange(x.shape[1]) < a.shape[1])[None, :])[0]
    orders, null = shuffles(seed, x.shape[1], n), []
    block = max(1, min(500, BLOCK // x.shape[1]))
    for lo in range(0, n, block):
        rows = np.zeros((min(block, n - lo), x.shape[1]), bool)
        for row, order in zip(rows, orders, strict=False):
            row[order[: a.shape[1]]] = True
        null.append(np.abs(difference(rows)))
    null = np.concatenate(null)
    need, bound, reached, warning = math.ceil(alpha * n), np.zeros(len(diff)), 0, None
    if need >= n:
        warning = "the bound would take in all permutations: more permutations or a smaller alpha are needed"
    else:
        down = np.sort(null, axis=0)[::-1]  # missing ones first
        many = lambda k: int((null >= down[k] + OFFSET).any(axis=1).sum())
        lo, hi = 0, n - 1
        while lo < hi:  # the number grows with the rank
            mid = (lo + hi) // 2
            lo, hi = (lo, mid) if many(mid) >= need else (mid + 1, hi)
        bound, reached = down[lo] + OFFSET, many(lo)
        if abs(alpha - reached / n) > TOLERANCE:
            warning = f"achieved alpha {reached / n:.4f} differs from {alpha:.4f}"
    with np.errstate(invalid="ignore"):
        significant = np.isfinite(diff) & (np.abs(diff) >= bound)
    return {"diff": diff, "bound": bound, "significant": significant, "reached": reached, "warning": warning}
