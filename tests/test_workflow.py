import pytest
from pyspark.sql import functions as F

from repspark.api import AnnotateConfig, annotate, annotate_folder, combine, mission_bio_cells, rescue_contigs, to_airr
from repspark.operators.contamination import tag_table
from repspark.plans.base import aligned


@pytest.fixture(scope="module")
def contigs(spark, small):
    return annotate(aligned(spark, small).where("n_reads is null"), AnnotateConfig()).cache()


def test_single_cell_invariants(contigs):
    n = contigs.count()
    assert n > 100 and contigs.select("SampleID", "contig_id").distinct().count() == n
    assert contigs.where("SubcloneID not like concat(ClonotypeVariantID, '.S%') or ClonotypeVariantID not like concat(ClonotypeID, '.CV%')").count() == 0
    assert contigs.where("igClonotypeID_num is not null and completeBCR not in ('Yes', 'Alternative_clonotype')").count() == 0
    assert contigs.groupBy("SampleID", "barcode", "ClonotypeID").count().where("count > 1").count() == 0


def test_bulk_frequencies_sum_to_hundred(spark, small):
    df = annotate(aligned(spark, small).where("n_reads is not null"), AnnotateConfig(data_type="bulk", cdr3_InDel_correction_mode="no"))
    total = df.select("SampleID", "ClonotypeID", "Clonotype_freq").distinct().groupBy("SampleID").agg(F.sum("Clonotype_freq").alias("t"))
    assert total.where("abs(t - 100) > 1e-6").count() == 0 and total.count() > 3
    sub = df.groupBy("SampleID", "ClonotypeID").agg(F.sum("Subclone_freq_in_Clonotype").alias("t"))
    assert sub.where("abs(t - 100) > 1e-6").count() == 0


def test_result_does_not_depend_on_partitions(spark, small):
    rows = lambda: sorted(map(tuple, annotate(aligned(spark, small).where("n_reads is null and sample like 'M%'"), AnnotateConfig(hc_mode="single")).select("SampleID", "contig_id", "SubcloneID", "completeBCR", "igClonotypeID_num").collect()), key=repr)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "1")
        one = rows()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert one == rows()


def test_rescue_never_touches_complete_cells(contigs):
    got = rescue_contigs(contigs)
    assert got.count() == contigs.count()
    keys = ["SampleID", "contig_id"]
    yes = contigs.where("completeBCR = 'Yes'").select(*keys)
    assert got.join(yes, keys, "left_semi").where("completeBCR <> 'Yes'").count() == 0


def test_combine_and_mission_bio(spark, contigs):
    cells = contigs.where("barcode is not null").select("SampleID", "barcode").distinct().unionByName(spark.createDataFrame([("S", "none")], "SampleID string, barcode string")).withColumn("completeBCR", F.lit("old"))
    got = combine(cells, contigs)
    assert got.count() == cells.count() and got.where("barcode = 'none' and completeBCR is null and IGH1_ClonotypeID is null").count() == 1
    named = contigs.where("barcode is not null and ClonotypeID like 'IG%'").select("SampleID", "barcode").distinct().count()
    assert got.where("IGH1_ClonotypeID is not null or IGL1_ClonotypeID is not null").count() == named
    assert mission_bio_cells(contigs, cells).count() == cells.count()
    assert to_airr(contigs.withColumn("VDJ_sequence_correctedCDR3", F.col("VDJ_sequence"))).where("sequence_alignment_aa is null").count() == 0


def test_joint_mode_needs_cases_and_tags_pivot(spark, tmp_path):
    with pytest.raises(ValueError):
        annotate_folder(spark, str(tmp_path), AnnotateConfig(analysis_mode="joint"))
    df = spark.createDataFrame([("c", "T1"), ("c", "T1"), ("d", "T2"), (None, "T1")], "c string, Sample_Tag string")
    assert sorted(map(tuple, tag_table(df, "c", ["T1", "T2"]).collect())) == [("c", 2, 0), ("d", 0, 1)]
