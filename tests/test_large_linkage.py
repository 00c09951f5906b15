import random
from fractions import Fraction

import pytest

from repspark.kernels.linkage import clusters


def _plain(seqs, cutoff, mode):
    """Exact heights; ties merge the pair with the smallest first members."""
    dist = {(s, t): Fraction(sum(x != y for x, y in zip(s, t)), len(s)) for s in seqs for t in seqs}
    groups = {i: [s] for i, s in enumerate(seqs)}
    while len(groups) > 1:
        height = lambda i, j: (max if mode == "complete" else lambda v: sum(v) / len(v))([dist[s, t] for s in groups[i] for t in groups[j]])
        d, i, j = min((height(i, j), i, j) for i in groups for j in groups if i < j)
        if round(float(d), 6) > cutoff:
            break
        groups[i] += groups.pop(j)
    return {frozenset(g) for g in groups.values()}


def _sequences(rng, n, length, rate):
    base = ["".join(rng.choice("ACGT") for _ in range(length)) for _ in range(2)]
    return list(dict.fromkeys("".join(c if rng.random() > rate else rng.choice("ACGT") for c in rng.choice(base)) for _ in range(n)))


@pytest.mark.parametrize("mode", ["average", "complete"])
def test_large_components_are_clustered_as_by_all_distances(mode):
    rng = random.Random(9)
    for length, rate in ((10, 0.25), (21, 0.2), (40, 0.15)):
        for _ in range(8):
            seqs = _sequences(rng, 24, length, rate)
            got = clusters(seqs, 0.2, mode, largest=2)
            assert {frozenset(s for s, g in zip(seqs, got) if g == k) for k in set(got)} == _plain(seqs, 0.2, mode)


@pytest.mark.parametrize("mode", ["average", "complete"])
def test_a_component_above_the_limit(mode):
    seqs = _sequences(random.Random(1), 900, 45, 0.12)
    got = clusters(seqs, 0.2, mode, largest=300)
    assert len(got) == len(seqs) and got[0] == 1 and 1 < len(set(got)) < len(seqs)
