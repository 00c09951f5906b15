"""Gaps of a gapped alignment pair: resolved outside the CDR3, taken out or filled inside it."""

from __future__ import annotations

import re
from functools import lru_cache

from repspark.kernels.alignment import align

_GAP = re.compile(r"(?<=[ACTG])-+(?=[ACTG])")


def correct(seq: str | None, germline: str | None, arch: list[int]) -> tuple[str | None, str | None, list[int], str | None]:
    """(sequence, germline, region lengths, 'pos_ref_alt,...' or None) without inner gaps.

    ``arch`` has the seven region lengths FR1..FR4. pos is the column before the gap. A deletion
    outside the CDR3 is filled from the germline and lengthens its region, one inside is cut from both;
    an insertion outside is cut from both and shortens its region, one inside fills the germline.
    Positions are of the sequence as it then stands, so earlier events shift later ones.
    """
    if not seq or not germline:
        return seq, germline, arch, None
    s, g, arch = list(seq), list(germline), list(arch)
    found = sorted([(m.start(), m.end(), "del") for m in _GAP.finditer(seq)] + [(m.start(), m.end(), "ins") for m in _GAP.finditer(germline)])
    events, cut = [], 0
    for start, end, kind in found:
        a, b = start - cut, end - cut
        if b > min(len(s), len(g)) or a < 1:
            continue
        n = b - a
        inner_from, inner_to = sum(arch[:5]), sum(arch[:6])
        outside = a <= inner_from or a > inner_to
        if kind == "del":
            events.append(f"{a}_{''.join(g[a - 1 : b])}_{s[a - 1]}")
            if outside:
                s[a:b] = g[a:b]
                _grow(arch, a + 1, n)
            else:
                del s[a:b], g[a:b]
                cut += n
        else:
            events.append(f"{a}_{g[a - 1]}_{''.join(s[a - 1 : b])}")
            if outside:
                del s[a:b], g[a:b]
                cut += n
                _grow(arch, a + 1, -n)
            else:
                g[a:b] = s[a:b]
    if events:
        arch[6] = max(0, len(s) - sum(arch[:6]))
    return "".join(s), "".join(g), arch, ",".join(events) or None


def _grow(arch: list[int], pos: int, n: int) -> None:
    total = 0
    for i in range(7):
        total += arch[i]
        if pos <= total or i == 6:
            arch[i] = max(0, arch[i] + n)
            return


_INNER = re.compile(r"(?<=[^-])-+(?=[^-])")


def _aligned(a: str, b: str) -> tuple[str, str]:
    """Two germlines with gaps. What fits at their ends, the right one first, is paired as it stands; only the rest is aligned."""
    fits = lambda p, q: p == q or p == "N" or q == "N"
    most, right, left = min(len(a), len(b)), 0, 0
    while right < most and fits(a[-1 - right], b[-1 - right]):
        right += 1
    while left < most - right and fits(a[left], b[left]):
        left += 1
    x, y = a[left : len(a) - right], b[left : len(b) - right]
    if x and y:
        x, y, _ = align(x, y, wild="N")
    else:
        x, y = x.ljust(len(y), "-"), y.ljust(len(x), "-")
    return a[:left] + x + a[len(a) - right :], b[:left] + y + b[len(b) - right :]


@lru_cache(maxsize=20_000)
def match_consensus(seq: str, germline: str, consensus: str) -> tuple[str, str, str | None]:
    """(sequence, germline, events) brought to the length of the consensus germline of its clonotype.

    Events have the form of ``correct``: 'column before the gap_bases there in the consensus_bases here', first what was
    filled in, then what was taken out, with columns of the alignment (less those taken out before). N fits any base, and
    gaps at either end are left as they are.
    """
    x, y = _aligned(consensus, germline)
    lacks = [m.span() for m in _INNER.finditer(y)]
    extra = [m.span() for m in _INNER.finditer(x)]
    filled = {k for a, b in lacks for k in range(a, b)}
    dropped = {k for a, b in extra for k in range(a, b)}
    events = [f"{a}_{x[a - 1 : b]}_{y[a - 1]}" for a, b in lacks]
    gone = 0
    for a, b in extra:
        events.append(f"{a - gone}_{x[a - 1]}_{y[a - 1 : b]}")
        gone += b - a
    s, g, i = [], [], 0  # i: place in seq and germline
    for k in range(len(x)):
        if k in filled:
            s.append(x[k])
            g.append(x[k])
        elif y[k] != "-":
            if k not in dropped:
                s.append(seq[i : i + 1])
                g.append(germline[i : i + 1])
            i += 1
    return "".join(s) + seq[i:], "".join(g) + germline[i:], ",".join(events) or None
