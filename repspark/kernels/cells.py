"""Order-dependent decisions on the chain combinations of a unit's cells."""

from __future__ import annotations

from itertools import combinations

KEPT = ("Yes", "Single_chain_2", "Potential_MB_doublet")
_MB_ORDER = {"Yes": 0, "Single_chain_2": 1, "Potential_MB_doublet": 2}


def resolve(combos: list[tuple[str, str, int]], mission_bio: bool = False) -> dict[tuple[str, str], tuple[str | None, str]]:
    """(igclonotype number or None, final class) of each (merged chains, class) with its row count.

    Combinations are taken by count descending (mission-bio: by class, then count), ties by name. One of
    three or more chains that shares a chain with an earlier kept one is a doublet; one whose chains all
    lie in an earlier kept one is an alternative of it; one without either gets a new number. Then kept
    ones with two or more different chains in earlier kept ones are doublets too.
    """
    rows = [(set(c.split("-")), c, k, n) for c, k, n in combos if k in KEPT]
    rows.sort(key=lambda r: ((_MB_ORDER[r[2]],) if mission_bio else ()) + (-r[3], r[1], r[2]))
    number: list[int | None] = [None] * len(rows)
    final = [r[2] for r in rows]
    kept: list[int] = []
    # the first kept combination with a chain, and with two: a combination of one or two lies in the first that has them
    with_chain: dict[str, int] = {}
    with_pair: dict[tuple[str, ...], int] = {}
    for i, (chains, *_rest) in enumerate(rows):
        if len(chains) >= 3:
            if not with_chain.keys().isdisjoint(chains):
                final[i] = "Clonotype_doublet"
                continue
        elif (j := with_chain.get(next(iter(chains))) if len(chains) == 1 else with_pair.get(tuple(sorted(chains)))) is not None:
            final[i] = "Alternative_clonotype"
            number[i] = number[j]
            continue
        number[i] = len(kept) + 1
        kept.append(i)
        for c in chains:
            with_chain.setdefault(c, i)
        for pair in combinations(sorted(chains), 2):
            with_pair.setdefault(pair, i)
    alive: set[str] = set()
    for i in kept:
        if len(rows[i][0] & alive) >= 2:
            final[i] = "Clonotype_doublet"
        else:
            alive |= rows[i][0]
    count: dict[int, int] = {}
    first: dict[int, int] = {}
    for i, r in enumerate(rows):
        if number[i] is None or final[i] in ("Clonotype_doublet", "Single_chain_2"):
            continue
        count[number[i]] = count.get(number[i], 0) + r[3]
        first.setdefault(number[i], i)
    rank = {k: p + 1 for p, k in enumerate(sorted(count, key=lambda k: (-count[k], first[k])))}
    out = {}
    for i, (_, c, k, _n) in enumerate(rows):
        if final[i] == "Potential_MB_doublet":
            loci = {x.split(".")[0] for x in c.split("-")}
            paired = "IGH" in loci and loci & {"IGK", "IGL"}
            final[i] = "Single_chain_2" if len(rows[i][0]) == 2 and not paired else "Yes"
        ranked = final[i] not in ("Clonotype_doublet", "Single_chain_2") and number[i] in rank
        out[(c, k)] = (f"C{rank[number[i]]}" if ranked else None, final[i])
    return out
