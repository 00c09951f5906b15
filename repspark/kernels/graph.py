"""Union-find over hashable members."""

from __future__ import annotations

from collections.abc import Hashable, Iterable


def components(edges: Iterable[tuple[Hashable, Hashable]]) -> dict[Hashable, Hashable]:
    """Smallest member of each member's component; members are those the edges name."""
    parent: dict = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = find(a), find(b)
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
    return {x: find(x) for x in parent}
