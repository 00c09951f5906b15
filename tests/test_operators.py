"""Domain operators on small literal tables."""

import pytest
from pyspark.sql import functions as F

from repspark.config import AnnotateConfig
from repspark.functions.sequences import as_bool, compose_vdj, identity, r110, revcomp, translate_nt, v_genes
from repspark.functions.subsets import MAJOR, stereotype_subset
from repspark.operators import contamination, recalc
from repspark.operators.airr import FIELDS, to_airr
from repspark.operators.clonotypes import automatic_cutoff, v_cluster_map
from repspark.operators.immunogenetics import clonotype_subset, consensus_cdr3, correct_indels, possible_cdr3
from repspark.operators.reads import collapse, concat_pairs, merge_pairs, numbered_reads
from repspark.operators.tidy import modal_length, require_columns, unique_sequences, with_read_counts
from repspark.operators.trees import abundances, write_bundle
from repspark.operators.wide import cells_long, cells_wide


def values(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_scalars(spark):
    df = spark.createDataFrame([("ACGTN", "ATGTAAGC", "IGHV1-2*01/x, IGHV1-3*02 ,IGHV1-2*03", "T"), (None, None, None, "false"), ("", "AC", "", "?")], "s string, n string, v string, b string")
    got = df.select(revcomp("s").alias("r"), translate_nt("n").alias("t"), v_genes("v").alias("g"), as_bool("b").alias("b"), identity("s", F.lit("ACGTA")).alias("i")).collect()
    assert tuple(got[0]) == ("NACGT", "M*", ["IGHV1-2"], True, 0.8)
    assert tuple(got[1]) == (None, None, None, False, None)
    assert tuple(got[2])[:2] == ("", "")
    assert df.select(revcomp(revcomp("s"))).first()[0] == "ACGTN"
    assert spark.range(1).select(translate_nt(F.lit("atgNNNtga"))).first()[0] == "MX*"


def test_compose_and_r110(spark):
    df = spark.createDataFrame([("V/1", "", "J"), ("V", "D", "J"), (None, None, None)], "v string, d string, j string")
    assert [r[0] for r in df.select(compose_vdj("v", "d", "j")).collect()] == ["V-1/J", "V/D/J", "/"]
    marks = spark.createDataFrame([("IGLV3-21*01/IGLJ1", "AC"), ("IGLV3-21*01/IGLJ1", "AG"), ("IGLV3-2*01/J", "C")], "v string, s string").select(r110("v", "s"))
    assert [r[0] for r in marks.collect()] == ["[R110]", "", ""]


def _example(motif: str) -> str:
    out, i = "", 1
    while i < len(motif) - 1:
        if motif[i] == "[":
            out += motif[i + 1]
            i = motif.index("]", i) + 1
        else:
            out += "A" if motif[i] == "." else motif[i]
            i += 1
    return out


@pytest.mark.parametrize("rule", MAJOR, ids=lambda r: r.label)
def test_each_major_rule_and_its_near_miss(spark, rule):
    gene = rule.v.strip("^$").replace("[157]", "1-69").replace("[246]", "4-39").replace("(2|46)", "2").replace("(58|69)", "58").replace("(4|59)", "4")
    gene = "IGHV3-30" if gene == "IGHV3" else gene
    cdr3 = _example(rule.motifs[0][0])
    df = spark.createDataFrame([(f"{gene}*01/IGHJ4", f"C{cdr3}W"), (f"{gene}*01/IGHJ4", f"C{cdr3}AW"), ("IGKV1-5*01/J", f"C{cdr3}W"), (f"{gene}*01", None)], "v string, j string")
    got = [r[0] for r in df.select(stereotype_subset(F.lit(True), "v", "j", False)).collect()]
    earlier = [r.label for r in MAJOR[: MAJOR.index(rule) + 1]]
    assert got[0] in earlier and got[1] != rule.label and got[2:] == ["NA", "NA"]


def test_consensus_and_its_expansion(spark):
    df = spark.createDataFrame([("a", "CARW"), ("a", "CARW"), ("a", "CTRW"), ("a", "CTRW"), ("a", "CAAAW"), ("b", "CC"), ("b", "CCC"), ("c", None), ("c", "")], "k string, s string")
    got = dict(values(consensus_cdr3(df, ["k"], "s")))
    assert got == {"a": "C[AT]RW", "b": "CC"}
    assert sorted(spark.range(1).select(possible_cdr3(F.lit("C[AT]R[LW]"))).first()[0]) == ["CARL", "CARW", "CTRL", "CTRW"]
    label = spark.range(1).select(clonotype_subset(F.lit(True), F.lit("IGHV3-21*01/J"), F.lit("A[KR]DAAAMDV"))).first()[0]
    assert label == "CLL#2,Satellite#2/169" or label == "CLL#2"


def test_indels_only_touch_gapped_rows(spark):
    df = spark.createDataFrame([("AAACCCGGGTTT", "AAACCCGGGTTT", [3, 2, 2, 1, 1, 2, 1]), ("AA-CCCGGGTTT", "AAACCCGGGTTT", [2, 2, 2, 1, 1, 2, 1]), (None, None, [0] * 7)], "VDJseq string, germline_alignment string, arch array<int>")
    got = {r["VDJseq"]: r["indel"] for r in correct_indels(df.withColumn("x", F.lit(1))).collect()}
    assert got == {"AAACCCGGGTTT": "2_AA_A", None: None} or got == {"AAACCCGGGTTT": None, None: None}


def test_v_clusters(spark):
    df = spark.createDataFrame([("u", "A*01,B*01"), ("u", "B*02,C*01"), ("u", "D*01"), ("w", "A*01"), ("w", None), ("w", "")], "unit string, v_call string")
    assert values(v_cluster_map(df)) == [("u", "A", "A,B,C"), ("u", "B", "A,B,C"), ("u", "C", "A,B,C"), ("u", "D", "D"), ("w", "A", "A")]


def test_reads(spark):
    df = spark.createDataFrame([("s", "acg"), ("s", "ACG"), ("s", "TTT"), ("s", ""), ("s", None), ("t", "A")], "sample string, sequence string")
    assert values(numbered_reads(collapse(df))) == [("s", "read1_n=2", "ACG", 2), ("s", "read2_n=1", "TTT", 1), ("t", "read1_n=1", "A", 1)]
    one = spark.createDataFrame([(1, "AAACCCGGGTTTACGT"), (2, "AAAA")], "i int, sequence string")
    two = spark.createDataFrame([(1, "GGGACGTAAACCC"), (2, "TTTT")], "i int, sequence string")
    assert values(concat_pairs(one, two, ["i"]).select("i", "sequence"))[1] == (2, "AAAAAAAA")
    merged = {r["i"]: (r["sequence"], r["merged"]) for r in merge_pairs(one, two, ["i"], 10, 200, 0.0).collect()}
    assert merged == {1: ("AAACCCGGGTTTACGTCCC", True), 2: ("AAAA", False)}


def test_counts_need_every_id(spark):
    df = spark.createDataFrame([("u", "a=3", "S"), ("u", "b=2", "S"), ("w", "a=3", "S"), ("w", "b", "S")], "unit string, sequence_id string, s string")
    got = unique_sequences(with_read_counts(df, ["unit"]), ["unit"], ["s"], 2)
    assert values(got.select("unit", "sequence_id", "total_reads_unique_seq")) == [("u", "a=3", 5), ("w", "a=3", 2)]
    lens = spark.createDataFrame([("g", "AA"), ("g", "CCC"), (None, "A")], "g string, s string")
    assert values(modal_length(lens, ["g"], "s")) == [("g", "AA"), (None, "A")]
    with pytest.raises(ValueError):
        require_columns(df, ["nope"])


def _bulk(spark, freq):
    rows = [("S1", "K1", "X", 1000), ("S2", "K2", "X", freq), ("S2", "K2", "Y", 1000 - freq), ("S3", "K1", "X", 50), ("S3", "K1", "Z", 950)]
    return spark.createDataFrame([(s, k, seq, f"C.{seq}", f"C.{seq}.CV1", n, 100.0) for s, k, seq, n in rows], "SampleID string, CaseID string, seq string, ClonotypeID string, ClonotypeVariantID string, ClonotypeVariant_nReads bigint, ClonotypeVariant_freq double")


@pytest.mark.parametrize("freq,raw", [(99, "OUT"), (100, "OUT"), (101, "OUT_X")])
def test_bulk_contamination_at_the_cutoff(spark, freq, raw):
    got = {(r["SampleID"], r["seq"]): (r["Contamination_FLAG"], r["Contamination_raw"]) for r in contamination.flag_bulk(_bulk(spark, freq), ["seq"], case="CaseID").collect()}
    assert got[("S2", "X")] == ("OUT_CLONOTYPE", raw) and got[("S2", "Y")] == ("PASS", "PASS") and got[("S3", "X")][0] == "PASS"
    assert got[("S1", "X")][1] == ("OUT_X" if raw == "OUT_X" else "PASS")


def test_cell_contamination_and_tags(spark):
    cells = spark.createDataFrame([("S1", "K1", "q", "c1")] * 20 + [("S2", "K2", "q", "c9")] * 2 + [("S2", "K2", "z", "c8")], "s string, k string, q string, c string")
    got = contamination.flag_cells(cells, ["q"], "q", "c", "s", case="k")
    assert values(got.where("Contamination_FLAG <> 'PASS'").select("s", "q", "Contamination_FLAG", "Contamination_Ratio")) == [("S2", "q", "OUT_CLONOTYPE", "2|20")] * 2
    tags = spark.createDataFrame([("c", "T1")] * 20 + [("c", "T2")] * 2 + [("c", "Multiplet"), (None, "T1"), ("d", "T2"), ("d", None)], "c string, Sample_Tag string")
    assert {r["Sample_Tag"]: r["SampleTag_FLAG"] for r in contamination.flag_tags(tags, "c").where("c = 'c'").collect()} == {"T1": "PASS", "T2": "PASS", "Multiplet": None}
    assert contamination.flag_tags(tags, "c", cutoff=9.9).where("SampleTag_FLAG = 'OUT'").first()["SampleTag_Ratio"] == "2:20"


def test_rescue_then_new_ranks(spark):
    full = [("S", f"a{i}", "Yes", "IGH.C2-IGK.C2", "C1") for i in range(35)] + [("S", f"b{i}", "Yes", "IGH.C1-IGK.C1", "C2") for i in range(46)]
    single = [("S", f"c{i}", "Single_chain_1", "IGK.C1", None) for i in range(4)] + [("S", "d", "Single_chain_1", "IGL.C7", None), ("S", "e", "Single_chain_2", "IGH.C2-IGK.C2", None), ("S", "f", "Not_supported", None, None)]
    df = spark.createDataFrame(full + single, "g string, barcode string, completeBCR string, m string, num string")
    got = recalc.rescue_single_chains(df, "g", "m", "num")
    count = {(r["num"], r["completeBCR"]): r["count"] for r in got.groupBy("num", "completeBCR").count().collect()}
    assert count == {("C1", "Yes"): 35, ("C2", "Yes"): 46, ("C2", "Yes_rescue"): 4, ("C1", "Yes_rescue"): 1, (None, "Single_chain_1"): 1, (None, "Not_supported"): 1}
    again = recalc.recalculate_numbers(got.withColumn("v", F.col("num")).withColumn("s", F.col("num")), "g", "num", "v", "s", None)
    assert {r["num"]: r["count"] for r in again.groupBy("num").count().collect()} == {"C1": 50, "C2": 36, None: 2}


def test_recalculated_ids_keep_split_suffixes(spark):
    rows = [("S", "IGH.C2x2")] * 3 + [("S", "IGH.C2x3")] * 2 + [("S", "IGH.C1")] * 4 + [("S", "IGH.C2xNA4")]
    df = spark.createDataFrame([(g, c, f"{c}.CV1", f"{c}.CV1.S1", str(i)) for i, (g, c) in enumerate(rows)], "SampleID string, ClonotypeID string, ClonotypeVariantID string, SubcloneID string, i string")
    got = {r["ClonotypeID"]: r["count"] for r in recalc.recalculate_cells(df).groupBy("ClonotypeID").count().collect()}
    assert got == {"IGH.C1x1": 3, "IGH.C1x2": 2, "IGH.C1xNA4": 1, "IGH.C2": 4}


def test_wide_and_long(spark):
    df = spark.createDataFrame([("S", "b1", "IGH.C2", "h2"), ("S", "b1", "IGH.C1", "h1"), ("S", "b1", "IGL.C1", "l"), ("S", "b2", "IGK.C3", "k")], "s string, barcode string, ClonotypeID string, q string")
    wide = cells_wide(df, ["ClonotypeID", "q"], ["s", "barcode"])
    assert {r["barcode"]: (r["IGH1_q"], r["IGH2_q"], r["IGL1_q"], r["IGL2_q"]) for r in wide.collect()} == {"b1": ("h1", "h2", "l", None), "b2": (None, None, "k", None)}
    assert values(cells_long(wide, ["ClonotypeID", "q"], ["s", "barcode"]).select("s", "barcode", "ClonotypeID", "q")) == values(df)


def test_airr_fields(spark):
    base = ("c1", "ACGTACGTACGTACGTACGTACG", "IGLV1*01/IGLJ2[R110]", "productive", "AAACCCGGGTTTAAACCCGGGTT", "NNN", "CX", "IGLC", "3-3-3-3-3-6-2", "S", 5, "C1", "m")
    df = spark.createDataFrame([base], "contig_id string, Raw_sequence string, VDJ_genes string, Functionality string, VDJ_sequence_correctedCDR3 string, IgBlast_Germline_alignment string, Junction_aa string, C_gene string, VDJ_positions string, SampleID string, Subclone_nReads bigint, ClonotypeID string, extra string")
    r = to_airr(df, metadata=["extra"]).first()
    assert r.__fields__ == [*FIELDS, "extra"]
    assert (r["d_call"], r["j_call"], r["cdr3"], r["fwr4"], r["fwr4_end"], r["cdr3_aa"]) == ("", "IGLJ2", "CCCGGG", "TT", 23, "PG")
    assert r["junction"] == "AAACCCGGGTT" and r["fwr1_aa"] == "K"
    for bad in ({"germline": "x"}, {"metadata": ["none"]}):
        with pytest.raises(ValueError):
            to_airr(df, **bad)


def test_tree_bundle(spark, tmp_path):
    df = spark.createDataFrame([("C1", "C1.1", "b1", "ACGT"), ("C1", "C1.1", "b2", "ACGT"), ("C1", "C1.2", "b3", "ACGA"), ("C2", "C2.1", "b4", "A")], "c string, s string, b string, q string")
    assert values(abundances(df, "c", "s")) == [("C1", "C1.1", 2), ("C1", "C1.2", 1), ("C1", "GL", 0)]
    cells = spark.createDataFrame(
        [("S", f"b{i}", c, "C1", n, h1, h2, "AC" * 30, h2 and "GG", "TT", "AAAA") for i, (c, n, h1, h2) in enumerate([("Yes", "C1.1", "IGH.C1.CV1.S1", None), ("Yes", "C1.1", "IGH.C1.CV1.S1", None), ("Yes", "C1.2", "IGH.C1.CV12.S10", "IGH.C2.CV1.S1"), ("Yes_rescue", "C1.1", "IGH.C1.CV1.S2", None)])],
        "SampleID string, barcode string, completeBCR string, igClonotypeID_num string, igSubcloneID_in_Clonotype_num string, IGH1_SubcloneID string, IGH2_SubcloneID string, IGH1_VDJ_sequence_correctedCDR3 string, IGH2_VDJ_sequence_correctedCDR3 string, IGL1_VDJ_sequence_correctedCDR3 string, IGH1_Consensus_Germline string",
    )
    for c in ("IGL1_SubcloneID", "IGL2_SubcloneID", "IGL2_VDJ_sequence_correctedCDR3", "IGH2_Consensus_Germline", "IGL1_Consensus_Germline", "IGL2_Consensus_Germline"):
        cells = cells.withColumn(c, F.lit(None).cast("string"))
    paths = write_bundle(cells, f"file://{tmp_path}/hl", "C1")
    text = lambda k: open(paths[k].removeprefix("file://")).read()
    assert text("abundance") == "GL,0\nC1.1,2\nC1.2,1\n" and "C1.1,b0:b1" in text("idmap") and paths["fasta"].endswith("subclones_HL_C1.fasta")
    assert text("fasta").startswith(">GL       \nAAAA\n>C1.1     \n" + "AC" * 30 + "TT\n")
    lines = text("phylip").split("\n")
    assert lines[0] == "3 64" and lines[2].startswith("C1.1      ACACACACAC ACACACACAC") and lines[6].strip().startswith("ACACACACAC TT")
    paths = write_bundle(cells, f"file://{tmp_path}/h", "C1", chain="H")
    assert text("abundance") == "GL,0\nIGH.C1.1,2\nIGH.C1.2,1\nIGH.C1_IGH.C2.3,1\n"
    for bad in (dict(clone="C2"), dict(clone="C1", chain="L"), dict(clone="C1", chain="X"), dict(clone="C1", mode="tissue")):
        with pytest.raises(ValueError):
            write_bundle(cells, f"file://{tmp_path}/x", **bad)


def test_config_and_cutoff(spark):
    with pytest.raises(ValueError):
        AnnotateConfig(hc_mode="ward")
    with pytest.raises(ValueError):
        AnnotateConfig(hc_similarity_cutoff=2)
    assert AnnotateConfig(data_type="missionbio").primer == "missionbio"
    assert automatic_cutoff(spark.createDataFrame([], "distance double")) == 0.2

def test_chain_labels(spark):
    from repspark.operators.cells import relabel_chains

    rows = [("K1", "K1.CV1", "C1", "Yes")] * 3 + [("K1", "K1.CV1", "C2", "Yes")] * 2 + [("K1", "K1.CV1", "C2", "Alternative_clonotype"), ("K1", "K1.CV1", None, "Single_chain_1"), ("K1", "K1.CV9", None, "Single_chain_1"), ("K1", "K1.CV9", None, "Not_supported")]
    rows += [("K2", "K2.CV1", "C1", "Yes"), ("K2", "K2.CV2", "C2", "Yes"), ("K2", "K2.CV1", "C2", "Yes"), ("K2", "K2.CV2", "C1", "Yes"), ("K2", "K2.CV1", None, "Single_chain_1"), ("K2", "K2.CV1", None, "Single_chain_2")]
    rows += [("K3", "K3.CV1", "C1", "Yes"), ("K3", "K3.CV2", None, "Not_supported"), ("K3", "K3.CV2", None, "Single_chain_1"), ("K3", "K3.CV2", None, "Single_chain_1")]
    rows += [("K4", "K4.CV1", None, "Single_chain_1"), ("K5", "K5.CV1", None, "Single_chain_1"), ("K5", "K5.CV1", None, "Single_chain_1")]
    df = spark.createDataFrame([("u", f"{i:03d}", *r) for i, r in enumerate(rows)], "unit string, sequence_id string, clonotypeID string, clonotypeVariantID_in_Cltp string, igclonotypeID string, completeBCR string")
    got = [r["clonotypeID"] for r in relabel_chains(df).orderBy("sequence_id").collect()]
    assert got == ["K1x1"] * 3 + ["K1x2"] * 3 + ["K1x1", "K1x3", "K1x4"] + ["K2x1", "K2x2", "K2x2", "K2x1", "K2xNA1", "K2xNA2"] + ["K3x1", "K3x1", "K3x2", "K3x3"] + ["K4", "K5x1", "K5x2"]
