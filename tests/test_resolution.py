"""The resolution of many chain combinations in one unit."""

import random
import time

from repspark.kernels.cells import KEPT, resolve


def _plain(combos):
    """Class of each combination by comparing it with all kept ones."""
    rows = sorted(((set(c.split("-")), c, k, n) for c, k, n in combos if k in KEPT), key=lambda r: (-r[3], r[1], r[2]))
    final, kept = [r[2] for r in rows], []
    for i, (chains, *_rest) in enumerate(rows):
        for j in kept:
            if len(chains) >= 3 and chains & rows[j][0]:
                final[i] = "Clonotype_doublet"
                break
            if chains <= rows[j][0]:
                final[i] = "Alternative_clonotype"
                break
        else:
            kept.append(i)
    alive = []
    for i in kept:
        if len({c for j in alive for c in rows[i][0] & rows[j][0]}) >= 2:
            final[i] = "Clonotype_doublet"
        else:
            alive.append(i)
    return {(r[1], r[2]): f for r, f in zip(rows, final)}


def test_classes_are_those_of_all_comparisons():
    rng = random.Random(4)
    for size in (3, 6, 12, 40):
        for _ in range(60):
            names = {"-".join(sorted(rng.sample([f"{x}{i}" for x in "HKL" for i in range(size)], rng.choice([1, 2, 2, 3, 4])))) for _ in range(40)}
            combos = [(c, rng.choice(KEPT[:2]), rng.randrange(1, 9)) for c in sorted(names)]
            assert {k: v[1] for k, v in resolve(combos).items()} == _plain(combos)


def test_many_combinations_of_one_unit_end_soon():
    rng = random.Random(6)
    combos = [(f"IGH.C{i}-IGK.C{rng.randrange(60_000)}", "Yes", rng.randrange(1, 5)) for i in range(60_000)]
    began = time.monotonic()
    got = resolve(combos)
    assert len(got) == 60_000 and time.monotonic() - began < 20
