import pytest

from repspark.sources.aligner import read_aligned, run_aligner, write_airr
from repspark.sources.raw import check_format, expand_paths, read_fasta, read_fastq, read_table, write_fasta


def values(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_fasta_with_an_empty_record_and_wrapped_lines(spark, tmp_path):
    p = tmp_path / "s1.fasta"
    p.write_text(">read1_n=3\nACGT\nACG\n>read15_n=218\n>read2_n=1\r\nTTT\r\n")
    assert values(read_fasta(spark, str(p))) == [("s1", "read15_n=218", ""), ("s1", "read1_n=3", "ACGTACG"), ("s1", "read2_n=1", "TTT")]
    assert read_fasta(spark, str(p), {"s1.fasta": "label"}).first()["sample"] == "label"
    out = tmp_path / "out"
    write_fasta(read_fasta(spark, str(p)), str(out))
    assert (out / "sample=s1").exists()


def test_fastq(spark, tmp_path):
    p = tmp_path / "r.fastq"
    p.write_text("@a 1\nACGT\n+\n@III\n@b\nTT\n+\nII\n")
    assert values(read_fastq(spark, str(p))) == [("r", "a 1", "ACGT"), ("r", "b", "TT")]


def test_tables_of_each_format(spark, tmp_path):
    a = tmp_path / "a.tsv"
    a.write_text("sequence_id\tsequence\tlocus\tconsensus_count\nx\tAC\tIGH\t7\ny\tGG\tTRA\t2\n")
    assert values(read_table(spark, str(a), "AIRR")) == [("a", "x", "AC")]
    assert values(read_table(spark, str(a), "trust4", "bulk")) == [("a", "x=7", "AC")]
    m = tmp_path / "m.tsv"
    m.write_text("cloneId\tcloneCount\ttargetSequences\tallVHitsWithScore\n0\t5.0\tAC,GT\tIGHV1(3)\nq\t2.0\tTT\tIGKV1(2)\n")
    assert values(read_table(spark, str(m), "mixcr")) == [("m", "mIGH_0", "ACGT"), ("m", "q", "TT")]
    assert values(read_table(spark, str(m), "mixcr", "bulk")) == [("m", "mIGH_0=5", "ACGT"), ("m", "q=2", "TT")]
    c = tmp_path / "c.csv"
    c.write_text("contig_id,fwr1_nt,cdr1_nt,fwr2_nt,cdr2_nt,fwr3_nt,cdr3_nt,fwr4_nt\nk_1,A,C,G,T,AA,CC,\n")
    assert values(read_table(spark, str(c), "10xbcr_csv")) == [("c", "k_1", "ACGTAACC")]
    for bad in (lambda: check_format("sam"), lambda: read_table(spark, str(a), "airr", "spatial")):
        with pytest.raises(ValueError):
            bad()
    assert expand_paths([str(tmp_path)])[0].endswith("a.tsv")
    with pytest.raises(FileNotFoundError):
        expand_paths([str(tmp_path / "none")])


def test_aligner_boundary(spark, tmp_path):
    cols = ["sequence_id", "productive", "complete_vdj", "v_call", "d_call", "j_call", "fwr1", "cdr1", "fwr2", "cdr2", "fwr3", "cdr3", "fwr4", "v_identity", "junction", "junction_aa", "junction_aa_length", "sequence", "sequence_alignment", "germline_alignment"]
    for s in ("A", "B"):
        (tmp_path / f"{s}_igblast_out.tsv").write_text("\t".join(cols) + "\n" + "\t".join(["x"] * 13 + ["97.5", "x", "x", "9", "x", "x", "x"]) + "\n")
    df = read_aligned(spark, str(tmp_path), cases={"A": "K", "B": "K"})
    assert values(df.select("sample", "unit", "v_identity", "junction_aa_length", "c_call")) == [("A", "K", 97.5, 9, None), ("B", "K", 97.5, 9, None)]
    assert read_aligned(spark, str(tmp_path), ["A"]).count() == 1
    with pytest.raises(FileNotFoundError):
        run_aligner(df, "no-such-program", {})
    write_airr(df, str(tmp_path / "airr"), one_file=True)
    assert spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "airr")).count() == 2
