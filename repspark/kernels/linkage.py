"""Agglomerative clustering of equal-length strings by the share of differing positions.

Clusters that any of the three linkages forms at or below a height lie within the components of the
graph of pairs at or below it, so the components are found first, block by block, and each is clustered
alone. Ties merge the pair with the smallest member numbers.
"""

from __future__ import annotations

import numpy as np

from repspark.kernels.graph import components

MODES = ("average", "complete", "single")
BLOCK = 2048


def encode(seqs: list[str]) -> np.ndarray:
    return np.frombuffer("".join(seqs).encode("latin-1", "replace"), dtype=np.uint8).reshape(len(seqs), -1)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing positions over the length, for all pairs of rows."""
    if a.shape[1] == 0:
        return np.zeros((len(a), len(b)))
    if len(a) * len(b) <= 4096:
        return (a[:, None, :] != b[None, :, :]).sum(axis=2, dtype=np.float32) / np.float32(a.shape[1])
    same = np.zeros((len(a), len(b)), dtype=np.float32)
    for c in np.unique(a):
        same += (a == c).astype(np.float32) @ (b == c).astype(np.float32).T
    return 1.0 - same / a.shape[1]


def forest(a: np.ndarray, b: np.ndarray | None, cutoff: float) -> list[tuple[int, int]]:
    """Edges (row, row) that tie together what the pairs at or below the cutoff tie together, one fewer than rows of a component.

    Rows of ``b`` are numbered after those of ``a``, and only pairs across count; without ``b`` the pairs within ``a``.
    The least number spreads from row to row until none changes, all pairs at once.
    """
    n = len(a)
    near = np.round(distances(a, a if b is None else b), 6) <= cutoff
    left = np.arange(n)
    right = left if b is None else np.arange(n, n + len(b))
    most = n + near.shape[1]
    while True:
        new_right = np.minimum(right, np.where(near, left[:, None], most).min(axis=0, initial=most))
        new_left = np.minimum(left, np.where(near, new_right[None, :], most).min(axis=1, initial=most))
        if b is None:
            new_right = new_left
        if np.array_equal(new_left, left) and np.array_equal(new_right, right):
            break
        left, right = new_left, new_right
    label = left if b is None else np.concatenate([left, right])
    at = np.flatnonzero(label != np.arange(len(label)))
    return list(zip(at.tolist(), label[at].tolist()))


def _linked(codes: np.ndarray, cutoff: float) -> np.ndarray:
    """Component number of each row in the graph of pairs at or below the cutoff."""
    edges = []
    for lo in range(0, len(codes), BLOCK):
        for at in range(lo, len(codes), BLOCK):
            one, two = codes[lo : lo + BLOCK], codes[at : at + BLOCK]
            place = lambda i, n=len(one), lo=lo, at=at: lo + i if i < n else at + i - n
            edges += [(place(i), place(j)) for i, j in forest(one, None if at == lo else two, cutoff)]
    root = components(edges)
    return np.array([root.get(i, i) for i in range(len(codes))])


def nearest_in(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest distance above 0 of each row of ``a`` to a row of ``b``; infinite if there is none."""
    d = distances(a, b)
    return np.where(d > 1e-7, d, np.inf).min(axis=1, initial=np.inf)


def _agglomerate(d: np.ndarray, cutoff: float, mode: str) -> np.ndarray:
    """Cluster number of each row of a distance matrix; heights rounded to 6 digits, cut inclusive."""
    n = len(d)
    d = d.copy()
    np.fill_diagonal(d, np.inf)
    size = np.ones(n)
    label = np.arange(n)
    while n > 1:
        at = int(np.argmin(d))
        i, j = sorted(divmod(at, len(d)))
        if round(float(d[i, j]), 6) > cutoff:
            break
        if mode == "single":
            row = np.minimum(d[i], d[j])
        elif mode == "complete":
            row = np.maximum(d[i], d[j])
        else:
            row = (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])
        row[[i, j]] = np.inf
        d[i, :] = d[:, i] = row
        d[j, :] = d[:, j] = np.inf
        size[i] += size[j]
        label[label == j] = i
        n -= 1
    return label


def _agglomerate_large(codes: np.ndarray, cutoff: float, mode: str) -> np.ndarray:
    """``_agglomerate`` of the rows themselves: distances are recomputed where they are needed, so memory grows with the rows only.

    Each cluster keeps its nearest one. A merge leaves those that had one of its two parts as nearest with a lower bound
    (neither linkage brings clusters nearer), looked up again when it comes first. Distances are quotients of whole numbers, so ties are exact.
    """
    n, length = codes.shape
    letters = np.unique(codes)
    one = (codes[:, :, None] == letters).reshape(n, -1).astype(np.float32)
    total = one.astype(np.float64) if mode == "average" else one
    size = np.ones(n)
    label = np.arange(n)
    active = np.ones(n, dtype=bool)
    nearest_of = np.zeros(n, dtype=np.int64)
    least = np.full(n, np.inf)
    stale = np.zeros(n, dtype=bool)

    def row(i: int) -> np.ndarray:
        if mode == "average":
            whole = size * size[i] * length
            d = (whole - total @ total[i]) / whole
        else:
            same = np.full(n, np.inf)
            mine = np.flatnonzero(label == i)
            for lo in range(0, len(mine), 256):
                same = np.minimum(same, (one @ one[mine[lo : lo + 256]].T).min(axis=1))
            far = np.full(n, np.inf)
            np.minimum.at(far, label, same)
            d = (length - far) / length
        d[~active] = np.inf
        d[i] = np.inf
        return d

    for lo in range(0, n, 256):
        same = (one[lo : lo + 256] @ one.T).astype(np.float64)
        same[np.arange(len(same)), np.arange(lo, lo + len(same))] = -np.inf
        nearest_of[lo : lo + 256] = same.argmax(axis=1)
        least[lo : lo + 256] = (length - same.max(axis=1)) / length
    while True:
        i = int(np.argmin(least))
        if not round(float(least[i]), 6) <= cutoff:
            return label
        if stale[i]:
            d = row(i)
            nearest_of[i], least[i], stale[i] = d.argmin(), d.min(), False
            continue
        a, b = sorted((i, int(nearest_of[i])))
        if mode == "average":
            total[a] += total[b]
        size[a] += size[b]
        label[label == b] = a
        active[b], least[b], stale[b] = False, np.inf, False
        stale |= active & ((nearest_of == a) | (nearest_of == b))
        d = row(a)
        nearest_of[a], least[a], stale[a] = d.argmin(), d.min(), False
        closer = active & ~stale & ((d < least) | ((d == least) & (a < nearest_of)))
        closer[a] = False
        least[closer], nearest_of[closer] = d[closer], a


def clusters(seqs: list[str], cutoff: float, mode: str = "average", largest: int = 12_000) -> list[int]:
    """Cluster number from 1 of each distinct string, in order of first appearance.

    More than ``largest`` similar strings are clustered without a matrix of their distances.
    """
    if mode not in MODES:
        raise ValueError(f"mode is one of {', '.join(MODES)}")
    if len(seqs) < 2:
        return [1] * len(seqs)
    codes = encode(seqs)
    linked = _linked(codes, cutoff)
    out = linked.copy()
    if mode != "single":
        for c in np.unique(linked):
            rows = np.flatnonzero(linked == c)
            if len(rows) < 3:
                continue
            if len(rows) > largest:
                out[rows] = rows[_agglomerate_large(codes[rows], cutoff, mode)]
            else:
                out[rows] = rows[_agglomerate(distances(codes[rows], codes[rows]).astype(np.float64), cutoff, mode)]
    number: dict[int, int] = {}
    return [number.setdefault(int(x), len(number) + 1) for x in out]


def nearest(seqs: list[str]) -> list[float | None]:
    """Smallest distance above 0 of each string to another, or None if there is none."""
    if len(seqs) < 2:
        return [None] * len(seqs)
    codes = encode(seqs)
    n = max(1, codes.shape[1])
    best = np.full(len(seqs), np.inf)
    for lo in range(0, len(seqs), BLOCK):
        for at in range(0, len(seqs), BLOCK):
            best[lo : lo + BLOCK] = np.minimum(best[lo : lo + BLOCK], nearest_in(codes[lo : lo + BLOCK], codes[at : at + BLOCK]))
    return [None if np.isinf(x) else round(float(x) * n) / n for x in best]


def _percentile(x: np.ndarray, upto: np.ndarray, q: float) -> float:
    """np.percentile of sorted values that are repeated; ``upto`` is the running sum of the repeats."""
    at = (int(upto[-1]) - 1) * q / 100
    low = int(at)
    a, b = x[np.searchsorted(upto, [low, min(low + 1, int(upto[-1]) - 1)], side="right")]
    return float(a + (b - a) * (at - low))


def density_valley(values: list[float], floor: float, counts: list[int] | None = None) -> float:
    """First minimum of a Gaussian density between its first two peaks, at least ``floor``; ``floor`` if there is none.

    Each value stands for as many equal ones as its count, for one without ``counts``.
    """
    x = np.asarray(values, dtype=float)
    w = np.ones(len(x), dtype=np.int64) if counts is None else np.asarray(counts, dtype=np.int64)
    n = int(w.sum())
    if n < 3 or x.min() == x.max():
        return floor
    order = np.argsort(x, kind="stable")
    x, w = x[order], w[order]
    upto = np.cumsum(w)
    deviation = float(np.sqrt((w * (x - (w * x).sum() / n) ** 2).sum() / (n - 1)))
    width = 0.9 * min(deviation, (_percentile(x, upto, 75) - _percentile(x, upto, 25)) / 1.34 or deviation) * n**-0.2
    grid = np.linspace(x.min(), x.max(), 512)
    hist, edges = np.histogram(x, bins=2048, weights=w)
    mids = (edges[1:] + edges[:-1]) / 2
    dens = (np.exp(-0.5 * ((grid[:, None] - mids) / width) ** 2) * hist).sum(axis=1)
    peak = np.flatnonzero((dens[1:-1] > dens[:-2]) & (dens[1:-1] >= dens[2:])) + 1
    if len(peak) < 2:
        return floor
    a, b = peak[0], peak[1]
    return max(floor, float(grid[a + int(np.argmin(dens[a : b + 1]))]))
