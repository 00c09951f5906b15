"""Indel merging of groups of any size."""

import random

import pytest

from repspark.kernels.alignment import composites, merge_by_indels, near_pairs, within
from repspark.operators.clonotypes import merge_indel_clonotypes


def _family(rng, n, size):
    out = set()
    while len(out) < n:
        b = list(rng.choice(size))
        p = rng.randrange(len(b) - 9)
        del b[p : p + rng.choice([0, 1, 3, 3, 6])]
        for _ in range(rng.randrange(0, 9)):
            b[rng.randrange(len(b))] = rng.choice("ACGT")
        out.add("".join(b))
    return sorted(out)


@pytest.mark.parametrize("cutoff", [0.1, 0.2, 0.3, 1.0])
def test_near_pairs_of_blocks_are_those_of_single_comparisons(cutoff):
    rng = random.Random(7)
    bases = ["".join(rng.choice("ACGT") for _ in range(n)) for n in (45, 45, 48, 140)]
    a, b = _family(rng, 50, bases), _family(rng, 40, bases)
    plain = lambda x, y: {(i, j) for i in range(len(x)) for j in range(len(y)) if len(x[i]) != len(y[j]) and within(x[i], y[j], cutoff)}
    assert set(near_pairs(a, b, cutoff, few=0, block=16)) == plain(a, b)
    assert set(near_pairs(a, b, cutoff)) == plain(a, b)
    own = near_pairs(a, None, cutoff, few=40)
    assert len(own) == len(set(own)) and {tuple(sorted(p)) for p in own} == {p for p in plain(a, a) if p[0] < p[1]}


@pytest.mark.parametrize("mode", ["soft_filter", "hard_filter"])
def test_a_group_of_more_than_3000_clonotypes(spark, mode):
    rng = random.Random(11)
    seqs = ["".join(rng.choice("ACGT") for _ in range(45)) for _ in range(3040)]
    shorter = [s[:20] + s[23:] for s in seqs[:40]]
    rows = [("u", "V1", 280, f"V1_C{i:04d}", s) for i, s in enumerate(seqs)] + [("u", "V1", 280, f"V1_D{i:04d}", s) for i, s in enumerate(shorter)]
    # a second sequence that is far from the shorter clonotype: joined by the modal sequence, not by all
    rows += [("u", "V1", 280, "V1_C0000", seqs[0])] * 2 + [("u", "V1", 280, "V1_C0000", "A" * 45)]
    df = spark.createDataFrame(rows, "unit string, v_cluster string, len_no_CDR3 int, Clonotype string, cdr3 string")
    got = {r["Clonotype"]: r["CorrectClt"] for r in merge_indel_clonotypes(df, mode=mode, block=500).select("Clonotype", "CorrectClt").distinct().collect()}
    edges = [(f"V1_C{i:04d}", f"V1_D{j:04d}") for i, s in enumerate(seqs) for j, t in enumerate(shorter) if within(s, t, 0.2) and (mode == "soft_filter" or i)]
    want = composites(edges)
    assert len(got) == 3080 and len(edges) >= 39 and got == {c: want.get(c, c) for c in got}


@pytest.mark.parametrize("mode", ["soft_filter", "hard_filter"])
def test_groups_without_a_gene_and_several_blocks(spark, mode):
    rng = random.Random(2)
    bases = ["".join(rng.choice("ACGT") for _ in range(n)) for n in (45, 48)]
    seqs = _family(rng, 80, bases)
    members = {f"C{i // 2:03d}_{len(s)}": [] for i, s in enumerate(seqs)}
    for i, s in enumerate(seqs):
        members[f"C{i // 2:03d}_{len(s)}"].append(s)
    df = spark.createDataFrame([(u, v, 3, f"{v}{c}", s) for u in ("a", "b") for v in (None, "V") for c, ss in members.items() for s in ss], "unit string, v_cluster string, len_no_CDR3 int, Clonotype string, cdr3 string")
    got = {(r[0], r[1]): r[2] for r in merge_indel_clonotypes(df, mode=mode, block=7).select("unit", "Clonotype", "CorrectClt").distinct().collect()}
    for v in (None, "V"):
        named = {f"{v}{c}": sorted(ss) if mode == "hard_filter" else [max(ss, key=lambda s: s[::-1])] for c, ss in members.items()}
        want = merge_by_indels(named, {c: len(ss[0]) for c, ss in named.items()}, 0.2)
        assert want and all(got[(u, c)] == want.get(c, c) for u in ("a", "b") for c in named)
