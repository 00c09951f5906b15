import random

import pytest

from repspark.kernels.alignment import align, indel_distance, merge_by_indels, within
from repspark.kernels.cells import resolve
from repspark.kernels.graph import components
from repspark.kernels.indels import correct, match_consensus
from repspark.kernels.linkage import clusters, density_valley, nearest


def test_components():
    assert components([("b", "a"), ("c", "b"), ("y", "x")]) == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x"}
    assert components([]) == {}


def test_cut_is_inclusive_and_numbered_by_first_appearance():
    a, at, above = "AAAAAAAAAA", "AAAAAAAACC", "AAAAAAACCC"
    for mode in ("single", "average", "complete"):
        assert clusters([a, at], 0.2, mode) == [1, 1]
        assert clusters([a, above], 0.2, mode) == [1, 2]
    assert clusters([], 0.2) == [] and clusters(["A"], 0.2) == [1]
    with pytest.raises(ValueError):
        clusters(["A"], 0.2, "ward")


def test_chain_under_the_three_linkages():
    a, b, c = "AAAAAAAAAA", "AAAAAAAACC", "AAAAAACCCC"
    assert clusters([a, b, c], 0.2, "single") == [1, 1, 1]
    assert clusters([a, b, c], 0.2, "complete") == [1, 1, 2]
    assert clusters([a, b, c], 0.2, "average") == [1, 1, 2]
    assert clusters([a, b, c], 0.3, "average") == [1, 1, 1]


def _plain_linkage(seqs, cutoff, mode):
    groups = [[i] for i in range(len(seqs))]
    dist = lambda i, j: sum(x != y for x, y in zip(seqs[i], seqs[j])) / len(seqs[0])
    while len(groups) > 1:
        best = None
        for i in range(len(groups)):
            for j in range(i + 1, len(groups)):
                ds = [dist(p, q) for p in groups[i] for q in groups[j]]
                d = round({"single": min, "complete": max, "average": lambda v: sum(v) / len(v)}[mode](ds), 6)
                if best is None or d < best[0]:
                    best = (d, i, j)
        if best[0] > cutoff:
            break
        groups[best[1]] += groups.pop(best[2])
    return {frozenset(seqs[i] for i in g) for g in groups}


@pytest.mark.parametrize("mode", ["single", "average", "complete"])
def test_linkage_against_brute_force(mode):
    random.seed(5)
    for _ in range(15):
        base = ["".join(random.choice("ACGT") for _ in range(37)) for _ in range(4)]
        seqs = list(dict.fromkeys("".join(c if random.random() > 0.12 else random.choice("ACGT") for c in random.choice(base)) for _ in range(14)))
        got = clusters(seqs, 0.2, mode)
        found = {frozenset(s for s, g in zip(seqs, got) if g == k) for k in set(got)}
        assert len(found) == len(_plain_linkage(seqs, 0.2, mode))
        if mode == "single":
            assert found == _plain_linkage(seqs, 0.2, mode)


def test_alignment_and_distance():
    assert align("ACGGT", "ACT", gap_open=1, gap_extend=1)[0] == "ACGGT"
    x, y, _ = align("AAACCCGGGTTTAAACCCGGGTTT", "AAACCCGGGTTTCCCGGGTTT")
    assert x == "AAACCCGGGTTTAAACCCGGGTTT" and y.replace("-", "") == "AAACCCGGGTTTCCCGGGTTT"
    assert indel_distance("AAACCCGGGTTTACGAAACCCGGGTTTACG", "AAACCCGGGTTTAAACCCGGGTTTACG") == pytest.approx(1 / 30)
    assert indel_distance("AAAA", "CCC") == 1.0


def test_bound_decides_as_the_alignment_does():
    random.seed(3)
    for k in range(1500):
        n = random.randrange(24, 50)
        a = "".join(random.choice("ACGT") for _ in range(n))
        d = random.choice([1, 3, 3, 6])
        p = random.randrange(0, n - d)
        b = list(a[:p] + a[p + d :])
        for _ in range(random.randrange(0, 10)):
            b[random.randrange(len(b))] = random.choice("ACGT")
        b = "".join(b)
        assert within(a, b, 0.2) == (indel_distance(a, b) <= 0.2)


def test_merge_joins_composites_that_share_a_member():
    base = "AAACCCGGGTTTACGAAACCCGGGTTTACGAAACCCGGGTTTACG"
    one, two = base[:12] + base[15:], base[:12] + "CAT" + base[12:]
    got = merge_by_indels({"v_C1": [base], "v_C10": [one], "v_C2": [two], "v_C3": ["T" * 45]}, {"v_C1": 45, "v_C10": 42, "v_C2": 48, "v_C3": 45}, 0.2)
    assert got == {"v_C1": "v_C1.v_C10.v_C2", "v_C10": "v_C1.v_C10.v_C2", "v_C2": "v_C1.v_C10.v_C2"}


def test_gap_events():
    arch = [6, 3, 3, 3, 3, 6, 6]
    seq = "AAACCCGGGTTTAAACCCACGTTTGGGGGG"
    assert correct(seq, seq, arch) == (seq, seq, arch, None)
    dele = seq[:3] + "--" + seq[5:]
    s, g, a, e = correct(dele, seq, [4, 3, 3, 3, 3, 6, 8])
    assert s == seq and g == seq and sum(a) == len(s) and a[0] == 6 and e == "3_ACC_A"
    ins = seq[:3] + "--" + seq[5:]
    s, g, a, e = correct(seq, ins, arch)
    assert s == g == seq[:3] + seq[5:] and a[0] == 4 and e == "3_A_ACC"
    inside = seq[:20] + "--" + seq[22:]
    s, g, a, e = correct(inside, seq, arch)
    assert len(s) == len(g) == 28 and "-" not in s + g
    two = correct(seq[:3] + "--" + seq[5:], seq[:9] + "-" + seq[10:], arch)
    assert "-" not in two[0] + two[1] and two[3].count(",") == 1
    assert correct(None, seq, arch)[0] is None


def test_consensus_germline_length():
    s, g, e = match_consensus("ACGTACGTAC", "ACGTACGTAC", "ACGTACGTAC")
    assert (s, g, e) == ("ACGTACGTAC", "ACGTACGTAC", None)
    c = "ACGTTGCAAGGCTTACCGATTGACCGTACGTTAGCATCGA"
    assert match_consensus(c[:20] + c[23:], c[:20] + c[23:], c) == (c, c, "20_TTGA_T")
    own = c[:20] + "NNN" + c[20:]
    s, g, e = match_consensus(c[:20] + "GGG" + c[20:], own, c)
    assert len(s) == len(g) == len(c) and e.count("_") == 2 and "," not in e
    # gaps at the ends have no base on either side: the sequence stays as it is there
    assert match_consensus(c[4:], c[4:], c) == (c[4:], c[4:], None)


def test_translation_and_agreement_of_a_batch():
    import pyarrow as pa

    from repspark.kernels.codons import agreement, translate

    assert translate(pa.array(["ATGTAAGC", None, "", "atgNNNtga"])).to_pylist() == ["M*", None, "", "MX*"]
    assert translate(pa.array(["x", "ATG", "ATG"]).slice(1)).to_pylist() == ["M", "M"] and translate(pa.array([], pa.string())).to_pylist() == []
    share, missing, filled = agreement(pa.array(["ACGT", "", "ACGT"]), pa.array(["ANGA", "NN", "ACGTNN"]))
    assert share.tolist() == [2 / 3, 0, 1] and missing.tolist() == [1, 2, 2] and filled.to_pylist() == ["ACGA", "NN", "ACGTNN"]


def test_subset_labels_are_those_of_all_cdr3_of_a_consensus():
    from itertools import product

    from repspark.kernels.subset_labels import _TOKEN, labels

    random.seed(8)
    genes = [("IGHV3-21",), ("IGHV1-69",), ("IGHV4-34", "IGHV4-39"), ("IGHV3-48",), ("IGHV2-5",)]
    seeds = ["ARDDAAMDV", "ARGGDYDYVWGSYRANDAFDI", "AVRGAAAAAAARRYYYYGMDV", "AREADFWSGYYAYYYYYGMDV", "AHRAAAAAAWAAGAFDY", "AKDAAAAWAADY"]
    for _ in range(150):
        text = "".join(f"[{''.join(sorted({c, *random.sample('ARNDCGWYKV', random.choice([1, 2]))}))}]" if random.random() < 0.15 else c for c in random.choice(seeds))
        each = product(*[a or b for a, b in _TOKEN.findall(text)])
        g = random.choice(genes)
        want = {labels(g, "".join(x))[0] for x in each}
        assert set(labels(g, text)) == want
    assert labels(("IGHV3-21",), "A" + "[ACDEFGHIKLMNPQRSTVWY]" * 20) and labels(("IGHV1-2",), "A", False) == ("Unassigned",)


def test_resolution_of_cells():
    got = resolve([("H1-K1-K2", "Yes", 60), ("H1-K1", "Yes", 20), ("H2-L1", "Yes", 15), ("H1-L1", "Yes", 6), ("H1-H2-K1", "Yes", 3), ("K9-L9", "Single_chain_2", 2)])
    assert got[("H1-K1-K2", "Yes")] == ("C1", "Yes")
    assert got[("H1-K1", "Yes")] == ("C1", "Alternative_clonotype")
    assert got[("H2-L1", "Yes")] == ("C2", "Yes")
    assert got[("H1-L1", "Yes")] == (None, "Clonotype_doublet")
    assert got[("H1-H2-K1", "Yes")] == (None, "Clonotype_doublet")
    assert got[("K9-L9", "Single_chain_2")] == (None, "Single_chain_2")
    mb = resolve([("IGH.C1-IGK.C1", "Potential_MB_doublet", 4), ("IGH.C2-IGH.C3", "Potential_MB_doublet", 3)], True)
    assert mb[("IGH.C1-IGK.C1", "Potential_MB_doublet")][1] == "Yes" and mb[("IGH.C2-IGH.C3", "Potential_MB_doublet")] == (None, "Single_chain_2")
    assert resolve([]) == {}


def test_nearest_and_valley():
    assert nearest(["AAAA", "AAAC", "CCCC"]) == [0.25, 0.25, 0.75] and nearest(["AA"]) == [None]
    random.seed(1)
    v = [random.gauss(0.08, 0.03) for _ in range(500)] + [random.gauss(0.7, 0.05) for _ in range(500)]
    assert 0.2 <= density_valley(v, 0.2) < 0.6 and density_valley([], 0.2) == 0.2
