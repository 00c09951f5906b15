"""Variant and subclone identifiers and frequencies, bulk and single cell."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repspark.functions.missing import na_text
from repspark.functions.sequences import locus
from repspark.operators.clonotypes import dotted, nested_ranks, rank_set
from repspark.operators.ranks import join_same, numbered
from repspark.runtime import written


def bulk_ids(df: DataFrame, unit: str = "unit", reads: str = "total_reads_unique_seq") -> DataFrame:
    """ClonotypeID (global rank by reads over all chains, with its locus), variants (V cluster, CDR3 aa), subclones.

    Needs one row per unique sequence with CorrectClt, v_cluster, cdr3_aa and the reads; a tie goes to the smaller key,
    of subclones to the smaller sequence_id. Subclones are numbered by ``ranks.numbered``, so a clonotype may be of any size.
    """
    df = df.withColumn("_cv", F.concat_ws("_", "v_cluster", "cdr3_aa"))
    df = rank_set(df, [([unit], "CorrectClt", "_c", "C"), ([unit, "CorrectClt"], "_cv", "_v", "CV")], by=reads)
    df = df.withColumn("clonotypeID", dotted(locus("v_cluster"), "_c")).withColumn("clonotypeVariantID_in_Cltp", dotted("clonotypeID", "_v")).drop("_cv", "_v", "_c")
    order = [F.col(reads).desc(), F.col("sequence_id")]
    df = numbered(numbered(df, [unit, "clonotypeVariantID_in_Cltp"], order, "_s"), [unit, "clonotypeID"], order, "_n")
    names = {"subcloneID_in_CV": F.concat("clonotypeVariantID_in_Cltp", F.lit(".S"), F.col("_s").cast("string")), "subcloneID_in_Clt": F.concat("clonotypeID", F.lit("."), F.col("_n").cast("string"))}
    return df.withColumns(names).drop("_s", "_n")


def bulk_frequencies(df: DataFrame, unit: str = "unit", reads: str = "total_reads_unique_seq") -> DataFrame:
    """Reads and percentages of clonotype (of the unit), variant (of the clonotype) and subclone (of variant and clonotype).

    Reads are summed per variant before the shuffle, clonotypes and units from those, and rows joined back once.
    """
    keys = [unit, "clonotypeID", "clonotypeVariantID_in_Cltp"]
    variants = written(df.groupBy(*keys).agg(F.sum(reads).alias("clonotypeVariant_nreads")), "variant-reads")
    clones = variants.groupBy(*keys[:2]).agg(F.sum("clonotypeVariant_nreads").alias("clonotypeID_nreads"))
    units = clones.groupBy(unit).agg(F.sum("clonotypeID_nreads").alias("_t"))
    every = join_same(join_same(variants, clones, keys[:2]), units, [unit])
    clt, cv = F.col("clonotypeID_nreads"), F.col("clonotypeVariant_nreads")
    return join_same(df, every, keys).withColumns({
        "clonotypeID_freq": clt * 100.0 / F.col("_t"), "clonotypeVariant_freq": cv * 100.0 / clt,
        "subclone_freq_in_CV": F.col(reads) * 100.0 / cv, "subclone_freq": F.col(reads) * 100.0 / clt,
    }).drop("_t")


def cell_ids(df: DataFrame, unit: str = "unit", clonotype: str = "CorrectClt") -> DataFrame:
    """Single cell: ClonotypeID per locus by contigs, variants (V cluster, CDR3 aa), subclones (sequence and indels)."""
    df = df.withColumn("_locus", locus("v_cluster")).withColumn("_cv", F.concat_ws("_", "v_cluster", "cdr3_aa"))
    df = df.withColumn("_sub", F.concat_ws("_", "VDJseq", na_text("indel")))
    scope = [unit, "_locus"]
    df = rank_set(df, [(scope, clonotype, "_c", "C"), ([*scope, clonotype], "_cv", "_v", "CV"), ([*scope, clonotype, "_cv"], "_sub", "_s", "S")])
    df = df.withColumn("clonotypeID", dotted("_locus", "_c")).withColumn("clonotypeVariantID_in_Cltp", dotted("clonotypeID", "_v")).withColumn("Unique_SequenceID", dotted("clonotypeVariantID_in_Cltp", "_s"))
    return df.drop("_locus", "_cv", "_sub", "_c", "_v", "_s")


def numbered_cell_ids(df: DataFrame, sub: str, unit: str = "unit", clonotype: str = "CorrectClt") -> DataFrame:
    """As ``cell_ids``, of narrow rows: ``sub`` is a number in the order of the subclones' sequences and indels, and _cvk numbers the variants of a clonotype in their order."""
    df = df.withColumn("_locus", locus("v_cluster")).withColumn("_cv", F.concat_ws("_", "v_cluster", "cdr3_aa"))
    return dotted_ids(nested_ranks(df, [unit, "_locus", clonotype], "_cv", sub, True).withColumn("clonotypeID", F.concat("_locus", F.lit(".C"), F.col("_c").cast("string"))).drop("_locus", "_cv", "_c"))


def dotted_ids(df: DataFrame) -> DataFrame:
    """Rows with the variant's and subclone's id from the clonotype's and the ranks _v and _s."""
    df = df.withColumn("clonotypeVariantID_in_Cltp", F.concat("clonotypeID", F.lit(".CV"), F.col("_v").cast("string")))
    return df.withColumn("Unique_SequenceID", F.concat("clonotypeVariantID_in_Cltp", F.lit(".S"), F.col("_s").cast("string"))).drop("_v", "_s")
