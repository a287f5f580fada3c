"""``difflib.SequenceMatcher(None, a, b).ratio()`` in about linear time, with the same result.

difflib takes the longest run of characters of which ``b`` has few (at 200 characters or more: at
most one in a hundred and one), the first in ``a``, then in ``b``; lets it grow over equal
characters on both sides and goes on left and right of it. It reads the whole range for each
block. Here grams of k such characters are looked up by their places in ``b``, longest first.
What is left of the first hit has no hit of that length, and right of it the search goes on: so a
place of ``a`` is looked up once for each k. Runs over ``SHORT`` are found by bisection on k.
"""

from __future__ import annotations

from bisect import bisect_left
from difflib import SequenceMatcher

import numpy as np

#: Longest grams that are looked up in tables; texts that are short together go to difflib.
SHORT, FEW = 16, 300


def common_start(a: str, i: int, ahi: int, b: str, j: int, bhi: int) -> int:
    """How many characters of a[i:ahi] and b[j:bhi] agree from the start."""
    n, at, step = min(ahi - i, bhi - j), 0, 16
    while at < n:
        s = min(step, n - at)
        if a[i + at : i + at + s] == b[j + at : j + at + s]:
            at, step = at + s, 2 * step
        elif s == 1:
            break
        else:
            step = s // 2
    return at


def common_end(a: str, alo: int, i: int, b: str, blo: int, j: int) -> int:
    """How many characters of a[alo:i] and b[blo:j] agree from the end."""
    n, at, step = min(i - alo, j - blo), 0, 16
    while at < n:
        s = min(step, n - at)
        if a[i - at - s : i - at] == b[j - at - s : j - at]:
            at, step = at + s, 2 * step
        elif s == 1:
            break
        else:
            step = s // 2
    return at


class Grams:
    """Runs of characters that ``b`` has few of, in two texts side by side."""

    def __init__(self, a: str, b: str):
        self.m, n = len(a), len(b)
        codes = np.frombuffer((a + b).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        counts = np.bincount(codes[self.m :], minlength=int(codes.max(initial=0)) + 1)
        few = counts > 0
        if n >= 200:
            few &= counts <= n // 100 + 1
        ends = np.where(few[codes], self.m + n, np.arange(self.m + n))
        ends[: self.m] = np.minimum(ends[: self.m], self.m)
        ends = np.minimum.accumulate(ends[::-1])[::-1] if n else ends
        ends[: self.m] = np.minimum(ends[: self.m], self.m)
        #: How many such characters follow each place, itself included; and names of the grams of 1, 2, 4... there.
        self.runs = ends - np.arange(self.m + n)
        self.names, self.tables, self.longest = [codes], {}, 0
        self.most = int(min(self.runs[: self.m].max(initial=0), self.runs[self.m :].max(initial=0)))

    def keys(self, at: np.ndarray, k: int) -> np.ndarray:
        """Numbers that are equal where the grams of k are."""
        p = k.bit_length() - 1
        while len(self.names) <= p:
            half = 1 << (len(self.names) - 1)
            where = np.flatnonzero(self.runs >= 2 * half)
            name = np.zeros(len(self.runs), np.int64)
            name[where] = np.unique(self._pair(self.names[-1], where, half), return_inverse=True)[1]
            self.names.append(name)
        return self._pair(self.names[p], at, k - (1 << p)) if k > 1 << p else self.names[p][at]

    @staticmethod
    def _pair(names: np.ndarray, at: np.ndarray, step: int) -> np.ndarray:
        return (names[at] << 32) + names[at + step]

    def places(self, lo: int, hi: int, k: int) -> np.ndarray:
        """Where grams of k start that end before ``hi``."""
        return lo + np.flatnonzero(self.runs[lo : max(lo, hi - k + 1)] >= k)

    def table(self, k: int) -> tuple[list, list, list, list]:
        """Places in ``a`` whose gram ``b`` has, from and to where its places in ``b`` stand in a list, and that list."""
        if k not in self.tables:
            ia, ib = self.places(0, self.m, k), self.places(self.m, len(self.runs), k)
            ka, kb = self.keys(ia, k), self.keys(ib, k)
            order = np.argsort(kb, kind="stable")
            kb = kb[order]
            lo, hi = np.searchsorted(kb, ka, "left"), np.searchsorted(kb, ka, "right")
            hit = hi > lo
            self.tables[k] = ia[hit].tolist(), lo[hit].tolist(), hi[hit].tolist(), (ib[order] - self.m).tolist()
        return self.tables[k]

    def find(self, alo: int, ahi: int, blo: int, bhi: int, k: int) -> tuple[int, int] | None:
        """The first gram of k in a[alo:ahi] that b[blo:bhi] has, and where first."""
        ia, lo, hi, ib = self.table(k)
        for x in range(bisect_left(ia, alo), len(ia)):
            if ia[x] > ahi - k:
                break
            y = bisect_left(ib, blo, lo[x], hi[x])
            if y < hi[x] and ib[y] <= bhi - k:
                return ia[x], ib[y]
        return None

    def find_long(self, alo: int, ahi: int, blo: int, bhi: int, most: int) -> tuple[int, int, int] | None:
        """The longest common gram of more than ``SHORT`` and at most ``most``: the first place in a, in b, its length."""
        found, low, high = None, SHORT + 1, min(most, ahi - alo, bhi - blo)
        while low <= high:
            k = (low + high) // 2
            ia, ib = self.places(alo, ahi, k), self.places(self.m + blo, self.m + bhi, k)
            ka, kb = self.keys(ia, k), self.keys(ib, k)
            hits = np.flatnonzero(np.isin(ka, kb))
            if len(hits):
                found, low = (int(ia[hits[0]]), int(ib[np.flatnonzero(kb == ka[hits[0]])[0]]) - self.m, k), k + 1
            else:
                high = k - 1
        return found


def matches(a: str, b: str) -> int:
    """The sizes of difflib's matching blocks together."""
    grams = Grams(a, b)
    total, left = 0, [(0, len(a), 0, len(b), grams.most)]
    while left:
        alo, ahi, blo, bhi, k = left.pop()
        while alo < ahi and blo < bhi:
            if k > SHORT:
                hit = grams.find_long(alo, ahi, blo, bhi, k)
                k = hit[2] if hit else SHORT
            elif k:
                hit = grams.find(alo, ahi, blo, bhi, k)
                k -= not hit
            else:
                total += common_start(a, alo, ahi, b, blo, bhi)
                break
            if not hit:
                continue
            i, j = hit[:2]
            before = common_end(a, alo, i, b, blo, j)
            after = common_start(a, i + k, ahi, b, j + k, bhi)
            total += before + k + after
            left.append((alo, i - before, blo, j - before, k - 1))
            alo, blo = i + k + after, j + k + after
    return total


def ratio(a: str, b: str) -> float:
    """difflib's similarity ratio of two texts."""
    if a == b:
        return 1.0
    if len(a) + len(b) < FEW:
        return SequenceMatcher(None, a, b).ratio()
    return 2.0 * matches(a, b) / (len(a) + len(b))
