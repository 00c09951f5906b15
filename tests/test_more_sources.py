import logging
import stat

import pytest
from pyspark.sql import functions as F

from repspark.api import AnnotateConfig
from repspark.operators.report import clonality, flag_rates, scores_long, write_dictionary
from repspark.sources.aligner import run_aligner
from repspark.sources.germline import read_germline, read_j_frames
from repspark.sources.raw import expand_paths, read_fasta


def values(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_a_record_begins_at_the_start_of_a_line(spark, tmp_path):
    p = tmp_path / "s.fasta"
    p.write_bytes(b">a desc > more\r\nAC>GT\r\n>b\nTT\n\n>c > \n")
    assert values(read_fasta(spark, str(p))) == [("s", "a desc > more", "AC>GT"), ("s", "b", "TT"), ("s", "c >", "")]
    (tmp_path / "empty.fasta").write_text("")
    assert read_fasta(spark, str(tmp_path / "empty.fasta")).count() == 0


def test_records_are_whole_in_small_splits(spark, tmp_path):
    p = tmp_path / "s.fasta"
    p.write_text("".join(f">r{i} > x\n{'ACGT' * 20}\n{'G' * (i % 7)}\n" for i in range(2000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        got = {r["sequence_id"]: r["sequence"] for r in read_fasta(spark, str(p)).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == {f"r{i} > x": "ACGT" * 20 + "G" * (i % 7) for i in range(2000)}


def test_paths_with_a_scheme(spark, tmp_path):
    for n in "ba":
        (tmp_path / f"{n}.fa").write_text(">x\nA\n")
    (tmp_path / "sub").mkdir()
    assert [p.rsplit("/", 1)[1] for p in expand_paths([f"file://{tmp_path}"])] == ["a.fa", "b.fa"]
    assert expand_paths([str(tmp_path / "a.fa")]) == [str(tmp_path / "a.fa")]
    with pytest.raises(FileNotFoundError):
        expand_paths([f"file://{tmp_path}/none"])


def test_the_aligner_is_called_with_its_options(spark, tmp_path):
    program = tmp_path / "aligner"
    program.write_text('#!/bin/sh\nwhile [ $# -gt 1 ]; do case $1 in -query) q=$2;; -out) o=$2;; esac; case $1 in -num_threads) t=$2;; -evalue) e=$2;; -germline_db_V) v=$2;; esac; shift; done\n'
                       'printf "sequence_id\\tsequence\\tv_call\\tjunction\\n" > $o\nawk -v x="$v-$t-$e" \'/^>/ {id=substr($0,2)} !/^>/ {print id "\\t" $0 "\\t" x "\\t"}\' $q >> $o\n')  # fmt: skip
    program.chmod(program.stat().st_mode | stat.S_IEXEC)
    df = spark.createDataFrame([("s", "a", "ACGT"), ("t", "b", "GG")], "sample string, sequence_id string, sequence string")
    got = run_aligner(df, str(program), {"V": "db"}, evalue=0.1, threads=2)
    assert values(got.select("sample", "sequence_id", "sequence", "v_call", "junction")) == [("s", "a", "ACGT", "db-2-0.1", None), ("t", "b", "GG", "db-2-0.1", None)]


def test_germline_tables(spark, tmp_path):
    (tmp_path / "j.fasta").write_text(">J00256|IGHJ1*01|Homo sapiens|F\ngctg..aat\n>IGHJ2*01 x\nCTAC\n")
    (tmp_path / "aux").write_text("#gene/allele name\tframe\n\nIGHJ1*01\t0\tJH\t17\t1\nIGKJ9*01  1  JK\n")
    assert values(read_germline(spark, str(tmp_path / "j.fasta"))) == [("IGHJ1*01", "GCTGAAT"), ("IGHJ2*01", "CTAC")]
    assert values(read_j_frames(spark, str(tmp_path / "aux"))) == [("IGHJ1*01", 0, "JH", 17, 1), ("IGKJ9*01", 1, "JK", None, None)]


def test_report(spark, tmp_path):
    rows = [("IGH", "T", "F", "F", "T", "IGHV1*01", "AR", 5.0, 1.0)] * 3 + [("IGH", "T", "F", "F", "T", "IGHV1*02,IGHV1*01", "AK", 4.0, None), ("IGK", "F", "T", None, "T", "IGKV1", "Q", 1.0, 9.0), (None, "T", "F", "F", "T", "V", "A", None, None)]
    df = spark.createDataFrame(rows, "locus string, productive string, stop_codon string, v_frameshift string, complete_vdj string, v_call string, cdr3_aa string, v_score double, d_score double")
    rates = {(r["flag"], r["locus"], r["sound"]): (r["n"], r["percent"]) for r in flag_rates(df).collect()}
    assert rates[("productive", "IGH", True)] == (4, 100.0) and rates[("v_frameshift", "IGK", False)] == (1, 100.0) and not any(k[1] is None for k in rates) and len(rates) == 8
    assert values(scores_long(df))[0] == ("IGH", "d_score", 1.0) and scores_long(df).where("gene = 'd_score'").count() == 3
    groups = clonality(df)
    assert {(r["clonal_group"], r["clonal_id"], r["n"]) for r in groups.collect()} == {("IGHV1_AR", "IGH.1", 3), ("Unique_IGH", "Unique_IGH", 1), ("Unique_NA", "Unique_NA", 1)}
    text = open(write_dictionary(groups, str(tmp_path / "d.txt"))).read().split("\n")
    assert text[1] == "IGH.1 --> IGHV1_AR" and len(text) == 5
    with pytest.raises(ValueError):
        write_dictionary(groups, str(tmp_path / "e.txt"), largest=1)


def test_dedupe_scope_of_joint_bulk(spark, small, caplog):
    from repspark.plans.annotate import annotate
    from repspark.plans.base import aligned

    with pytest.raises(ValueError):
        AnnotateConfig(dedupe_scope="cell")
    one = aligned(spark, small).where("n_reads is not null and sample like 'M%'").withColumn("unit", F.lit("case"))
    two = one.withColumn("sample", F.lit("other"))
    plain = {"data_type": "bulk", "analysis_mode": "joint", "hc_mode": "single", "cdr3_InDel_correction_mode": "no"}
    with caplog.at_level(logging.INFO, "repspark"):
        unit = annotate(one.unionByName(two), AnnotateConfig(**plain)).count()
    assert "clonotypes assigned" in caplog.text
    assert annotate(one.unionByName(two), AnnotateConfig(**plain, dedupe_scope="sample")).groupBy("SampleID").count().count() > 1
    assert unit > 0
