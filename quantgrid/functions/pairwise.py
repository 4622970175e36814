"""Order statistics of all differences x - y of two sorted samples, without forming them."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

#: Differences of one pair of samples that may be formed at once.
FORMED = 4096


def slack(x: np.ndarray, y: np.ndarray) -> float:
    """More than x - c and x - y can lose in rounding."""
    return 8 * np.finfo(float).eps * max(np.abs(x[[0, -1]]).max(), np.abs(y[[0, -1]]).max(), 1e-300) * 2


def count_up_to(x: np.ndarray, y: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Pairs with x - y <= c for each cut c, as y >= x - c: one sorted search a cut."""
    return np.array([len(x) * len(y) - np.searchsorted(y, x - c, "left").sum() for c in cuts], np.int64)


def kth_differences(x: np.ndarray, y: np.ndarray, ks: Sequence[int]) -> list[float]:
    """The k-th smallest (from 0) of all x - y for each k; x and y are sorted.

    The value axis is halved until few pairs lie between the ends, then those are formed and sorted:
    O(n log n) for each halving, and the answer is one of the differences as doubles give it.
    """
    if len(x) * len(y) <= FORMED:
        d = np.sort((x[:, None] - y[None, :]).ravel())
        return [float(d[int(k)]) for k in ks]
    eps, few = slack(x, y), max(FORMED, 4 * (len(x) + len(y)))
    out = []
    for k in map(int, ks):
        low, high = x[0] - y[-1] - 2 * eps, x[-1] - y[0] + 2 * eps  # none up to low, all up to high
        while True:
            # Every pair below first lies under low, every pair from last on above high; rounding included.
            last, first = np.searchsorted(y, x - high - eps, "left"), np.searchsorted(y, x - low + eps, "right")
            if (first - last).sum() <= few:
                break
            middle = low + (high - low) / 2
            if not low + 4 * eps < middle < high - 4 * eps:
                break
            if count_up_to(x, y, np.array([middle]))[0] > k:
                high = middle
            else:
                low = middle
        rank = k - int((len(y) - first).sum())
        sizes = first - last
        if sizes.sum() <= 64 * few:
            at = np.repeat(np.arange(len(x)), sizes)
            places = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(last, sizes)
            d = np.sort(x[at] - y[places])
            out.append(float(d[min(max(rank, 0), len(d) - 1)]))
        else:  # very many pairs within rounding of one value
            out.append(float(low + (high - low) / 2))
    return out


def u_statistic(x: np.ndarray, y: np.ndarray) -> float:
    """Pairs with x > y, ties counting a half."""
    return float(np.searchsorted(y, x, "left").sum() + np.searchsorted(y, x, "right").sum()) / 2


def tie_sum(values: np.ndarray) -> float:
    """Sum of t^3 - t over the sizes of ties; ``values`` is sorted."""
    starts = np.flatnonzero(np.r_[True, values[1:] != values[:-1], True])
    t = np.diff(starts).astype(float)
    return float((t**3 - t).sum())
