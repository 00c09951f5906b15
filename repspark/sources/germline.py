"""Side tables of germline genes: sequences from FASTA, and frame and CDR3 end of J genes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repspark.sources.raw import read_fasta


def read_germline(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """(gene, sequence): the second field of a header with '|', else its first word; bases in upper case without gap dots."""
    head = F.col("sequence_id")
    gene = F.when(head.contains("|"), F.trim(F.split(head, r"\|")[1])).otherwise(F.substring_index(head, " ", 1))
    return read_fasta(spark, paths).select(gene.alias("gene"), F.upper(F.translate("sequence", ".", "")).alias("sequence"))


def read_j_frames(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """(gene, frame, kind, cdr3_end, extra) of a table of blank-separated fields; lines that begin with '#' and blank ones are none, a missing field is null."""
    lines = spark.read.text(paths).where(~F.trim("value").startswith("#") & (F.trim("value") != ""))
    f = F.split(F.trim("value"), r"\s+")
    at = lambda i: F.try_element_at(f, F.lit(i))
    return lines.select(at(1).alias("gene"), at(2).try_cast("int").alias("frame"), at(3).alias("kind"), at(4).try_cast("int").alias("cdr3_end"), at(5).try_cast("int").alias("extra"))
