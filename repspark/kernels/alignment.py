"""Global pairwise alignment with affine gaps, and the distance of two CDR3 that differ in length."""

from __future__ import annotations

import numpy as np

from repspark.kernels.graph import components

#: Scores: a deviation of the aligner's own defaults shows in these only.
MATCH, MISMATCH, GAP_OPEN, GAP_EXTEND = 1.0, -1.0, 10.0, 4.0


def align(a: str, b: str, match: float = MATCH, mismatch: float = MISMATCH, gap_open: float = GAP_OPEN, gap_extend: float = GAP_EXTEND, wild: str = "") -> tuple[str, str, float]:
    """(a with gaps, b with gaps, score). A letter of ``wild`` matches any. Ties prefer a pair, then a gap in b, then in a."""
    n, m = len(a), len(b)
    low = -1e18
    pair = np.full((n + 1, m + 1), low)
    gap_b = np.full((n + 1, m + 1), low)
    gap_a = np.full((n + 1, m + 1), low)
    pair[0, 0] = 0
    for i in range(1, n + 1):
        gap_b[i, 0] = -gap_open - gap_extend * i
    for j in range(1, m + 1):
        gap_a[0, j] = -gap_open - gap_extend * j
    x = np.array(list(a), dtype="U1")
    y = np.array(list(b), dtype="U1")
    free = np.isin(y, list(wild)) if wild else np.zeros(m, dtype=bool)
    steps = gap_extend * np.arange(m + 1)
    for i in range(1, n + 1):
        fits = np.ones(m, dtype=bool) if a[i - 1] in wild else (y == x[i - 1]) | free
        pair[i, 1:] = np.where(fits, match, mismatch) + np.maximum(np.maximum(pair[i - 1, :-1], gap_b[i - 1, :-1]), gap_a[i - 1, :-1])
        gap_b[i, 1:] = np.maximum(np.maximum(pair[i - 1, 1:], gap_a[i - 1, 1:]) - gap_open - gap_extend, gap_b[i - 1, 1:] - gap_extend)
        # a gap in a opens after a pair or a gap in b and runs on: the best opening so far, less the steps since
        opened = np.maximum.accumulate(np.maximum(pair[i], gap_b[i]) + steps)
        gap_a[i, 1:] = opened[:-1] - gap_open - steps[1:]
    tables = (pair, gap_b, gap_a)
    i, j = n, m
    at = int(np.argmax([t[n, m] for t in tables]))
    score = float(tables[at][n, m])
    x, y = [], []
    while i or j:
        if at == 0:
            x.append(a[i - 1])
            y.append(b[j - 1])
            i, j = i - 1, j - 1
            at = int(np.argmax([t[i, j] for t in tables]))
        elif at == 1:
            here = gap_b[i, j]
            x.append(a[i - 1])
            y.append("-")
            i -= 1
            at = 1 if here == gap_b[i, j] - gap_extend else (0 if pair[i, j] >= gap_a[i, j] else 2)
        else:
            here = gap_a[i, j]
            x.append("-")
            y.append(b[j - 1])
            j -= 1
            at = 2 if here == gap_a[i, j] - gap_extend else (0 if pair[i, j] >= gap_b[i, j] else 1)
    return "".join(reversed(x)), "".join(reversed(y)), score


def gap_runs(s: str) -> int:
    return sum(1 for i, c in enumerate(s) if c == "-" and (i == 0 or s[i - 1] != "-"))


def indel_distance(a: str, b: str) -> float:
    """1 - (equal positions, gaps counting as equal, less one per gap) / aligned length; 1 if the longer needs gaps or the score isn't above 0."""
    longer, shorter = (a, b) if len(a) >= len(b) else (b, a)
    x, y, score = align(longer, shorter)
    if "-" in x or score <= 0:
        return 1.0
    same = sum(p == q or q == "-" for p, q in zip(x, y))
    return 1.0 - (same - gap_runs(y)) / len(x)


def _mismatches(a: bytes, b: bytes) -> np.ndarray:
    return np.frombuffer(a, np.uint8) != np.frombuffer(b, np.uint8)


def within(a: str, b: str, cutoff: float) -> bool:
    """Whether indel_distance(a, b) <= cutoff, without aligning where a bound decides."""
    longer, shorter = (a, b) if len(a) >= len(b) else (b, a)
    n, m = len(longer), len(shorter)
    d = n - m
    if d == 0 or m - GAP_OPEN - GAP_EXTEND * d <= 0:
        return indel_distance(a, b) <= cutoff if d == 0 else cutoff >= 1.0
    allowed = int(cutoff * n + 1e-9) - 1  # mismatches, with one gap
    if allowed < 0:
        return False
    # of allowed + 2 pieces of the shorter, mismatches spoil so many and the gap one, so one stands unchanged within d places of its own
    if allowed + 2 <= m:
        step = m // (allowed + 2)
        if not any(shorter[p : p + step] in longer[p : p + step + d] for p in range(0, step * (allowed + 2), step)):
            return False
    x, y = longer.encode(), shorter.encode()
    before = np.concatenate([[0], np.cumsum(_mismatches(x[:m], y))])
    after = np.concatenate([np.cumsum(_mismatches(x[d:], y)[::-1])[::-1], [0]])
    one = int((before + after).min())
    # a second gap must save more than its opening, a gap in the longer more than both it then needs
    if 2 * one <= GAP_OPEN:
        return (m - 2 * one - GAP_OPEN - GAP_EXTEND * d) > 0 and (one + 1) / n <= cutoff + 1e-9
    least = np.zeros(d + 1)
    for i in range(m):
        least = np.minimum.accumulate(least) + (np.frombuffer(x[i : i + d + 1], np.uint8) != y[i])
    if least.min() > allowed:
        return False
    return indel_distance(a, b) <= cutoff


def _least(x: np.ndarray, y: np.ndarray, most: int) -> np.ndarray:
    """Fewest mismatches, capped at ``most``, of each longer row of ``x`` with each shorter row of ``y`` over all places of their gaps."""
    d, m = x.shape[1] - y.shape[1], y.shape[1]
    least = np.zeros((d + 1, len(x), len(y)), dtype=np.uint8)
    for i in range(m):
        for k in range(1, d + 1):
            np.minimum(least[k], least[k - 1], out=least[k])
        for k in range(d + 1):
            least[k] += x[:, i + k, None] != y[None, :, i]
        if i % 128 == 127:
            np.minimum(least, min(most, 120), out=least)
    return least.min(axis=0)


def near_pairs(a: list[str], b: list[str] | None, cutoff: float, few: int = 2048, block: int = 256) -> list[tuple[int, int]]:
    """(i, j) with within(a[i], b[j]) of all pairs that differ in length; pairs within ``a`` once each if ``b`` is None.

    Many pairs of two lengths are bounded as a matrix, those of rarer lengths in one list, so only pairs that may be
    near are looked at one by one.
    """
    by: list[dict[int, list[int]]] = []
    for seqs in (a, a if b is None else b):
        at: dict[int, list[int]] = {}
        for i, s in enumerate(seqs):
            at.setdefault(len(s), []).append(i)
        by.append(at)
    other = a if b is None else b
    out = []
    rare: list[tuple[list[int], list[int], int]] = []
    for n, left in by[0].items():
        for m, right in by[1].items():
            if n == m or (b is None and n < m):
                continue
            hi, lo = max(n, m), min(n, m)
            allowed = int(cutoff * hi + 1e-6) - 1
            if cutoff < 1.0 and (lo - GAP_OPEN - GAP_EXTEND * (hi - lo) <= 0 or allowed < 0):
                continue
            if cutoff < 1.0 and allowed < 120 and len(left) * len(right) <= few:
                rare.append((left, right, allowed))
                continue
            if cutoff >= 1.0 or allowed >= 120:
                out += [(i, j) for i in left for j in right if within(a[i], other[j], cutoff)]
                continue
            x, y = _codes([a[i] for i in left]), _codes([other[j] for j in right])
            for p in range(0, len(left), block):
                for q in range(0, len(right), block):
                    u, v = x[p : p + block], y[q : q + block]
                    least = _least(u, v, allowed + 1) if n > m else _least(v, u, allowed + 1).T
                    for i, j in np.argwhere(least <= allowed):
                        i, j = left[p + int(i)], right[q + int(j)]
                        if within(a[i], other[j], cutoff):
                            out.append((i, j))
    for i, j in _rare_pairs(a, other, rare):
        if within(a[i], other[j], cutoff):
            out.append((i, j))
    return out


def _rare_pairs(a: list[str], b: list[str], rare: list[tuple[list[int], list[int], int]], block: int = 8192) -> list[tuple[int, int]]:
    """Those of the pairs (members of a, members of b, allowed mismatches) that ``_least`` doesn't exclude, of all lengths at once."""
    if not rare:
        return []
    i = np.concatenate([np.repeat(x, len(y)) for x, y, _ in rare])
    j = np.concatenate([np.tile(y, len(x)) for x, y, _ in rare])
    allowed = np.repeat([w for _, _, w in rare], [len(x) * len(y) for x, y, _ in rare])
    size = [np.array([len(s) for s in side]) for side in (a, b)]
    wide = int(max(size[0].max(), size[1].max()))
    codes = [_codes([s.ljust(wide) for s in side]) for side in (a, b)]
    out = []
    for at in range(0, len(i), block):
        p, q, most = i[at : at + block], j[at : at + block], allowed[at : at + block].astype(np.uint8)
        n, m = size[0][p], size[1][q]
        turn = n < m
        x, y = codes[0][p], codes[1][q]
        x[turn], y[turn] = y[turn], x[turn].copy()
        d, short = np.abs(n - m), np.minimum(n, m)
        gap = int(d.max())
        x, y = np.ascontiguousarray(np.pad(x, ((0, 0), (0, gap + 1))).T), np.ascontiguousarray(y.T)
        least = np.zeros((gap + 1, len(p)), dtype=np.uint8)
        for k in range(int(short.max())):
            np.minimum.accumulate(least, axis=0, out=least)
            least += (x[k : k + gap + 1] != y[k]) & (k < short)
            if k % 8 == 7:  # mismatches only grow: pairs beyond theirs at every place are left behind
                live = np.flatnonzero(least.min(axis=0) <= most)
                if len(live) < 0.7 * len(p):
                    p, q, most, d, short, x, y, least = p[live], q[live], most[live], d[live], short[live], x[:, live], y[:, live], least[:, live]
                    if not len(p):
                        break
                np.minimum(least, most + np.uint8(1), out=least)
        # places beyond a pair's own gap aren't reached from, so the row of its gap has the least of its own
        np.minimum.accumulate(least, axis=0, out=least)
        near = least[d, np.arange(len(p))] <= most
        out += list(zip(p[near].tolist(), q[near].tolist()))
    return out


def _codes(seqs: list[str]) -> np.ndarray:
    return np.frombuffer("".join(seqs).encode("latin-1", "replace"), np.uint8).reshape(len(seqs), -1)


def composites(edges: list[tuple[str, str]]) -> dict[str, str]:
    """Composite name of each clonotype of the near pairs.

    In name order each clonotype not yet in a composite gathers all near ones; composites that share a member
    are one. Names join by '.'.
    """
    near: dict[str, list[str]] = {}
    for a, b in edges:
        near.setdefault(a, []).append(b)
        near.setdefault(b, []).append(a)
    taken: set[str] = set()
    kept = []
    for c in sorted(near):
        if c not in taken:
            kept += [(c, o) for o in near[c]]
            taken.update(near[c], (c,))
    groups: dict[str, list[str]] = {}
    for c, r in components(kept).items():
        groups.setdefault(r, []).append(c)
    return {c: name for g in groups.values() for name in [".".join(sorted(g))] for c in g}


def merge_by_indels(members: dict[str, list[str]], lengths: dict[str, int], cutoff: float) -> dict[str, str]:
    """``composites`` of clonotypes of different CDR3 length whose farthest pair of sequences is within the cutoff."""
    names = sorted(members)
    near = lambda c, o: lengths[o] != lengths[c] and all(within(s, t, cutoff) for s in members[c] for t in members[o])
    return composites([(c, o) for i, c in enumerate(names) for o in names[i + 1 :] if near(c, o)])
