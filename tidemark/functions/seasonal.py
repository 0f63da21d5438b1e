"""Order statistics of every day's season, for many site calendars at once.

A day's season is what its site saw within a window of the year, in other years.  Along the ring of
days (unrolled past both ends) such a season is one range minus the day's own year, which is one
range of the days sorted by year.  Two wavelet matrices over the ranks of a site's values answer
"the k-th smallest value of range A without range B" and "how many are smaller" for all days in
one descent per bit, so n days cost n log n steps in place of n squared, and all of them are numpy
operations on whole blocks of sites.
"""

from __future__ import annotations

import numpy as np

#: A key space wider than any day on the unrolled ring.
_RING = 2048


class WaveletMatrix:
    """Zeros before every place, bit by bit from the highest."""

    def __init__(self, ranks: np.ndarray, bits: int):
        self.zeros: list[np.ndarray] = []
        seq = ranks.astype(np.int64)
        for bit in range(bits - 1, -1, -1):
            one = (seq >> bit & 1).astype(bool)
            before = np.zeros(len(seq) + 1, np.int64)
            np.cumsum(~one, out=before[1:])
            self.zeros.append(before)
            seq = np.concatenate([seq[~one], seq[one]])

    def split(self, level: int, lo: np.ndarray, hi: np.ndarray):
        """Ranges of the zeros among [lo, hi) at this level."""
        z = self.zeros[level]
        return z[lo], z[hi]


class Seasons:
    """Ranges of all days of a block.  ``site`` is sorted; ``value`` may hold NaN, which takes no part in any season."""

    def __init__(self, site: np.ndarray, doy: np.ndarray, year: np.ndarray, value: np.ndarray, window: int):
        ok = np.flatnonzero(np.isfinite(value))
        s, d, y, v = site[ok].astype(np.int64), doy[ok].astype(np.int64), year[ok].astype(np.int64), value[ok]
        order = np.lexsort((v, s))
        self.sorted = v[order]
        self.offset = np.searchsorted(s, site)                               # where each row's site begins among the sorted values
        start = np.searchsorted(s, s)
        rank = np.empty(len(ok), np.int64)
        rank[order] = np.arange(len(ok)) - start[order]
        new = np.ones(len(ok), bool)
        new[1:] = (self.sorted[1:] != self.sorted[:-1]) | (s[order][1:] != s[order][:-1])
        ties = np.maximum.accumulate(np.where(new, np.arange(len(ok)), 0))
        self.first = np.full(len(site), -1, np.int64)                        # rank of the first equal value
        self.first[ok[order]] = ties - start[order]
        self.bits = max(1, int(rank.max(initial=0)).bit_length())
        base = int(y.min(initial=0))
        span = int(max(y.max(initial=0), year.max(initial=0))) - min(base, int(year.min(initial=base))) + 2
        base = min(base, int(year.min(initial=base)))
        # the ring unrolled: days near its ends stand a second time beyond the other end
        after, ahead = np.flatnonzero(d <= window + 1), np.flatnonzero(d >= 366 - window)
        whole = 2 * window + 1 >= 366
        pick = np.arange(len(ok)) if whole else np.concatenate([np.arange(len(ok)), after, ahead])
        ring = d if whole else np.concatenate([d, d[after] + 365, d[ahead] - 365])
        ring = ring + 512
        here = doy.astype(np.int64) + 512
        low, high = (np.zeros_like(here), np.full_like(here, _RING - 1)) if whole else (here - window, here + window)
        self.ranges, self.matrices = [], []
        for group, own in ((s[pick], site.astype(np.int64)), (s[pick] * span + (y[pick] - base), site.astype(np.int64) * span + (year.astype(np.int64) - base))):
            key = group * _RING + ring
            by = np.argsort(key, kind="stable")
            key = key[by]
            self.matrices.append(WaveletMatrix(rank[pick][by], self.bits))
            self.ranges.append((np.searchsorted(key, own * _RING + low, "left"), np.searchsorted(key, own * _RING + high, "right")))
        (a, z), (b, y) = self.ranges
        self.n = (z - a) - (y - b)

    def kth(self, k: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """The k-th smallest value (from 0) of the season of each of ``rows``."""
        k, rank = k.copy(), np.zeros(len(rows), np.int64)
        (a, z), (b, y) = [(lo[rows], hi[rows]) for lo, hi in self.ranges]
        for level in range(self.bits):
            a0, z0 = self.matrices[0].split(level, a, z)
            b0, y0 = self.matrices[1].split(level, b, y)
            zeros = (z0 - a0) - (y0 - b0)
            up = k >= zeros
            k -= np.where(up, zeros, 0)
            rank = rank << 1 | up
            n0, n1 = self.matrices[0].zeros[level][-1], self.matrices[1].zeros[level][-1]
            a, z = np.where(up, n0 + a - a0, a0), np.where(up, n0 + z - z0, z0)
            b, y = np.where(up, n1 + b - b0, b0), np.where(up, n1 + y - y0, y0)
        return self.sorted[self.offset[rows] + rank]

    def below(self, rows: np.ndarray) -> np.ndarray:
        """How many values of the season lie strictly below the row's own value."""
        count, limit = np.zeros(len(rows), np.int64), self.first[rows]
        (a, z), (b, y) = [(lo[rows], hi[rows]) for lo, hi in self.ranges]
        for level in range(self.bits):
            a0, z0 = self.matrices[0].split(level, a, z)
            b0, y0 = self.matrices[1].split(level, b, y)
            up = (limit >> (self.bits - 1 - level) & 1).astype(bool)
            count += np.where(up, (z0 - a0) - (y0 - b0), 0)
            n0, n1 = self.matrices[0].zeros[level][-1], self.matrices[1].zeros[level][-1]
            a, z = np.where(up, n0 + a - a0, a0), np.where(up, n0 + z - z0, z0)
            b, y = np.where(up, n1 + b - b0, b0), np.where(up, n1 + y - y0, y0)
        return count


#: Days of a site up to which its seasons are sorted one by one, and rows that such a step takes at a time.
SHORT, STEP = 40, 16_384


def _short_stats(site: np.ndarray, doy: np.ndarray, year: np.ndarray, value: np.ndarray, window: int):
    """``season_stats`` of sites of few days: each day's season is a masked row of its site's days, sorted."""
    start = np.searchsorted(site, site)
    number = np.cumsum(np.r_[True, site[1:] != site[:-1]]) - 1
    place, width = np.arange(len(site)) - start, int((np.arange(len(site)) - start).max(initial=0)) + 1
    v, d, y = np.full((number[-1] + 1, width), np.nan), np.zeros((number[-1] + 1, width), np.int64), np.zeros((number[-1] + 1, width), np.int64)
    value = np.where(np.isfinite(value), value, np.nan)
    v[number, place], d[number, place], y[number, place] = value, doy, year
    n, below = np.zeros(len(site), np.int64), np.zeros(len(site), np.int64)
    median, mad = np.full(len(site), np.nan), np.full(len(site), np.nan)
    for lo in range(0, len(site), STEP):
        rows = slice(lo, lo + STEP)
        of, own = v[number[rows]], value[rows, None]
        gap = np.abs(d[number[rows]] - doy[rows, None])
        part = ~np.isnan(of) & (y[number[rows]] != year[rows, None])
        if 2 * window + 1 < 366:
            part &= np.minimum(gap, 365 - gap) <= window
        m = part.sum(1)
        n[rows], below[rows] = m, (part & (of < own)).sum(1)

        def middle(x):
            x = np.sort(np.where(part, x, np.inf), axis=1)
            i = np.arange(len(x))
            return np.where(m > 0, (x[i, np.maximum(m - 1, 0) // 2] + x[i, np.minimum(m // 2, width - 1)]) / 2, np.nan)

        median[rows] = middle(of)
        mad[rows] = middle(np.abs(of - median[rows, None]))
    return n, median, mad, below


def season_stats(site: np.ndarray, doy: np.ndarray, year: np.ndarray, value: np.ndarray, window: int):
    """Count, median, median absolute deviation and number of smaller values of every row's season.

    ``site`` is sorted.  Sites of at most ``SHORT`` days are sorted season by season, the others share wavelet matrices.
    """
    few = np.searchsorted(site, site, "right") - np.searchsorted(site, site) <= SHORT
    out = (np.zeros(len(site), np.int64), np.full(len(site), np.nan), np.full(len(site), np.nan), np.zeros(len(site), np.int64))
    for rows, stats in ((few, _short_stats), (~few, _long_stats)):
        if rows.any():
            for whole, part in zip(out, stats(site[rows], doy[rows].astype(np.int64), year[rows].astype(np.int64), value[rows], window), strict=True):
                whole[rows] = part
    return out


def _long_stats(site: np.ndarray, doy: np.ndarray, year: np.ndarray, value: np.ndarray, window: int):
    """``season_stats`` of sites of any length.

    The deviations left and right of the median are two sorted runs; the middle of their union is
    found by bisection on how many come from the left.
    """
    s = Seasons(site, doy, year, value, window)
    median, mad = np.full(len(site), np.nan), np.full(len(site), np.nan)
    below = np.zeros(len(site), np.int64)
    rows = np.flatnonzero(s.n > 0)
    if len(rows):
        n = s.n[rows]
        mid = (n - 1) // 2
        upper = s.kth(n // 2, rows)
        med = (s.kth(mid, rows) + upper) / 2
        median[rows] = med
        # left: med - s[mid - j], j = 0 .. mid; right: s[mid + 1 + j] - med
        right = n - mid - 1
        lo, hi = np.maximum(0, mid + 1 - right), mid + 1
        todo = np.flatnonzero(lo < hi)
        while len(todo):
            half = (lo[todo] + hi[todo]) // 2
            r, m = rows[todo], mid[todo]
            more = np.abs(s.kth(m - half, r) - med[todo]) < np.abs(s.kth(2 * m + 1 - half, r) - med[todo])
            lo[todo] = np.where(more, half + 1, lo[todo])
            hi[todo] = np.where(more, hi[todo], half)
            todo = todo[lo[todo] < hi[todo]]

        def left_at(j):
            inside = (j >= 0) & (j <= mid)
            return np.where(inside, np.abs(s.kth(np.where(inside, mid - j, 0), rows) - med), np.nan)

        def right_at(j):
            inside = (j >= 0) & (j < right)
            return np.where(inside, np.abs(s.kth(np.where(inside, mid + 1 + j, 0), rows) - med), np.nan)

        first = np.fmax(left_at(lo - 1), right_at(mid - lo))
        second = np.where(n % 2 == 1, first, np.fmin(left_at(lo), right_at(mid + 1 - lo)))
        mad[rows] = (first + second) / 2
    known = np.flatnonzero((s.n > 0) & (s.first >= 0))
    below[known] = s.below(known)
    return s.n, median, mad, below
