"""Estimates over many overlapping dense windows at once, at a cost that grows with the samples and not with samples x window.

Order statistics come from a wavelet matrix over the ranks of the values: one bit of the rank a level, so a quantile of any run of positions takes one step a level, for
all windows together. The deviations from a window's median are two sorted sequences, whose middle a bisection finds. Sums of a polynomial weight over a range of values
are sums of powers over the tree nodes that make up the range; sums of a polynomial weight in time are sums of powers over short blocks. Powers are taken about the middle of the
node or block and in units of its size, so nothing cancels.
"""

from __future__ import annotations

import sys
from math import comb

import numpy as np
from pyspark import cloudpickle

# windows that go through the levels together
CHUNK = 1 << 14


class Ranks:
    """Wavelet matrix over the ranks 1..n of finite values; a stable sort tells equal values apart."""

    def __init__(self, x: np.ndarray):
        self.n = len(x)
        order = np.argsort(x, kind="stable")
        self.sorted = x[order]
        rank = np.empty(self.n, np.int32)
        rank[order] = np.arange(1, self.n + 1, dtype=np.int32)
        self.bits = int(self.n + 1).bit_length()
        self.zeros, self.ranks = [], [rank]
        for bit in range(self.bits - 1, -1, -1):
            zero = (rank >> bit) & 1 == 0
            below = np.zeros(self.n + 1, np.int32)
            np.cumsum(zero, out=below[1:])
            self.zeros.append(below)
            rank = np.concatenate([rank[zero], rank[~zero]])
            self.ranks.append(rank)

    def value(self, lo, hi, k):
        """The ``k``-th smallest value (from 0) among the positions ``lo..hi``."""
        found, k = np.zeros(len(lo), np.int32), k.copy()
        for level, below in enumerate(self.zeros):
            a, b = below[lo], below[hi]
            right = k >= b - a
            k -= np.where(right, b - a, 0)
            lo, hi = np.where(right, below[-1] + lo - a, a), np.where(right, below[-1] + hi - b, b)
            found += right.astype(np.int32) << (self.bits - 1 - level)
        return self.sorted[found - 1]

    def median(self, lo, hi):
        n = hi - lo
        low = self.value(lo, hi, (n - 1) // 2)
        out, even = low.copy(), np.flatnonzero(n % 2 == 0)
        out[even] = (low[even] + self.value(lo[even], hi[even], n[even] // 2)) / 2.0
        return out

    def median_deviation(self, lo, hi, m):
        """Median of ``|x - m|`` for the medians ``m``: how many of the smaller half of the deviations lie below the median is bisected."""
        n = hi - lo
        below = n // 2
        above, take = n - below, (n + 1) // 2

        def under(i, at):
            return m[at] - self.value(lo[at], hi[at], below[at] - 1 - i)

        def over(i, at):
            return self.value(lo[at], hi[at], below[at] + i) - m[at]

        a, z = np.maximum(take - above, 0), np.minimum(take, below)
        while True:
            at = np.flatnonzero(a < z)
            if not len(at):
                break
            i = (a[at] + z[at]) // 2
            more = under(i, at) < over(take[at] - i - 1, at)
            a[at], z[at] = np.where(more, i + 1, a[at]), np.where(more, z[at], i)
        low, high = np.full(len(n), -np.inf), np.full(len(n), np.inf)
        for at, end, i, pick, side in ((a > 0, low, a - 1, np.maximum, under), (take - a > 0, low, take - a - 1, np.maximum, over),
                                       (a < below, high, a, np.minimum, under), (take - a < above, high, take - a, np.minimum, over)):
            at = np.flatnonzero(at)
            end[at] = pick(end[at], side(i[at], at))
        return np.where(n % 2 == 0, (low + high) / 2.0, low)

    def powers(self, level: int):
        """Middle and half width of each tree node at ``level``, and running sums of the powers 1 to 5 about it, per position."""
        bit = self.bits - level
        rank = self.ranks[level]
        first = np.arange((self.n >> bit) + 1) << bit
        last = np.minimum(first + (1 << bit) - 1, self.n)
        a, b = self.sorted[np.maximum(first, 1) - 1], self.sorted[np.maximum(last, 1) - 1]
        middle, half = (a + b) / 2.0, np.where(b > a, (b - a) / 2.0, 1.0)
        node = rank >> bit
        z = (self.sorted[rank - 1] - middle[node]) / half[node]
        sums, power = np.zeros((self.n + 1, 5)), np.ones(self.n)
        for k in range(5):
            power = power * z
            np.cumsum(power, out=sums[1:, k])
        return middle, half, sums

    def bisquare(self, lo, hi, m, s):
        """Sums of ``w`` and ``w u`` with ``u = (x - m) / s`` and ``w = (1 - u u)^2`` where ``|u| < 1``."""
        first, last = np.searchsorted(self.sorted, m - s, "right"), np.searchsorted(self.sorted, m + s, "left") + 1
        weight, moved = np.zeros(len(lo)), np.zeros(len(lo))
        # the ranks between two that are left out: one path down to each, and what lies between the paths
        paths = [(first, lo, hi, 0), (last, lo, hi, 1)]
        for level, below in enumerate(self.zeros):
            bit = self.bits - 1 - level
            apart = (first >> (bit + 1)) != (last >> (bit + 1))
            middle, half, sums = self.powers(level + 1)
            down = []
            for end, a, z, side in paths:
                a0, z0 = below[a], below[z]
                a1, z1 = below[-1] + a - a0, below[-1] + z - z0
                right = (end >> bit) & 1 == 1
                own = np.flatnonzero(apart & (right if side else ~right))
                node = (end[own] >> bit) ^ 1
                f, e = (a0[own], z0[own]) if side else (a1[own], z1[own])
                some = e > f
                own, node, f, e = own[some], node[some], f[some], e[some]
                got = sums[e] - sums[f]
                shift, scale = (middle[node] - m[own]) / s[own], half[node] / s[own]
                parts = [(e - f).astype(float)] + [got[:, k] * scale ** (k + 1) for k in range(5)]
                u = [sum(comb(j, k) * shift ** (j - k) * parts[k] for k in range(j + 1)) for j in range(6)]
                weight[own] += u[0] - 2.0 * u[2] + u[4]
                moved[own] += u[1] - 2.0 * u[3] + u[5]
                down.append((end, np.where(right, a1, a0), np.where(right, z1, z0), side))
            paths = down
        return weight, moved


def _chunks(n: int):
    return [slice(i, min(i + CHUNK, n)) for i in range(0, n, CHUNK)]


def median_dense(t, x, at, lo, hi, half):
    ranks = Ranks(x)
    return np.concatenate([ranks.median(lo[c], hi[c]) for c in _chunks(len(lo))])


def biweight_dense(t, x, at, lo, hi, half, c: float = 5.0):
    ranks = Ranks(x)
    m = np.concatenate([ranks.median(lo[k], hi[k]) for k in _chunks(len(lo))])
    s = c * np.concatenate([ranks.median_deviation(lo[k], hi[k], m[k]) for k in _chunks(len(lo))])
    out, live = m.copy(), np.flatnonzero(s > 0)
    weight, moved = ranks.bisquare(lo[live], hi[live], m[live], s[live])
    out[live] += s[live] * moved / weight
    return out


def lowess_dense(t, x, at, lo, hi, half):
    """NaN where the samples lie so close together that the sums do not determine the line."""
    size = half / 2.0
    level = x.mean()
    block = np.floor((t - t[0]) / size).astype(np.int64)
    starts = np.searchsorted(block, np.arange(block[-1] + 2))
    tau = (t - (t[0] + (block + 0.5) * size)) / half
    plain, flux = np.zeros((len(t) + 1, 12)), np.zeros((len(t) + 1, 11))
    power = np.ones(len(t))
    for k in range(12):
        np.cumsum(power, out=plain[1:, k])
        if k < 11:
            np.cumsum(power * (x - level), out=flux[1:, k])
        power = power * tau
    out = np.empty(len(at))
    for c in _chunks(len(at)):
        out[c] = _lines(plain, flux, block, starts, t[0], size, at[c], lo[c], np.searchsorted(t, at[c]), hi[c], half)
    return out + level


def _lines(plain, flux, block, starts, origin, size, at, lo, mid, hi, half):
    s, y = [0.0] * 3, [0.0] * 2
    for sign, a, z in ((-1.0, lo, mid), (1.0, mid, hi)):
        some = np.flatnonzero(z > a)
        first = np.zeros(len(at), np.int64)
        first[some] = block[a[some]]
        reach = int((block[z[some] - 1] - first[some]).max()) + 1 if len(some) else 0
        for j in range(reach):
            q = np.minimum(first + j, len(starts) - 2)
            f = np.minimum(np.maximum(a, starts[q]), z)
            e = np.maximum(np.minimum(z, starts[q + 1]), f)
            if j and (first + j > len(starts) - 2).any():
                e = np.where(first + j > len(starts) - 2, f, e)
            shift = (origin + (q + 0.5) * size - at) / half
            p, g = ((table[e] - table[f]).T.copy() for table in (plain, flux))
            for v in (p, g):
                # powers about the middle of the block become powers about the centre of the window
                for r in range(1, len(v)):
                    for k in range(len(v) - 1, r - 1, -1):
                        v[k] += shift * v[k - 1]
            for sums, v in ((s, p), (y, g)):
                for k in range(len(sums)):
                    sums[k] = sums[k] + (v[k] - 3.0 * sign * v[k + 3] + 3.0 * v[k + 6] - sign * v[k + 9]) * half ** k
    det = s[0] * s[2] - s[1] * s[1]
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(det > 1e-9 * (s[0] * half) ** 2, (s[2] * y[0] - s[1] * y[1]) / det, np.nan)


cloudpickle.register_pickle_by_value(sys.modules[__name__])
