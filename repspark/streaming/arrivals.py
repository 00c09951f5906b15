"""Arriving contigs: each contig kept once in a written table, counts per sample and clonotype from it.

The reference works on whole files only; this is the same first step for rows that come in over time and in any
order. ``store_contigs`` and ``stored_contigs`` leave out no row, however late. ``distinct_contigs`` on a stream gives
early figures only: rows later than its watermark are missing there, and are to be had from the stored table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.types import StructType

KEY = ["sample", "sequence_id"]


def read_arrivals(spark: SparkSession, folder: str, schema: StructType, files_per_batch: int = 64) -> DataFrame:
    """Parquet files of a folder as they appear."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def latest_copy(rows: DataFrame) -> DataFrame:
    """Each (sample, sequence_id) once, as it was loaded last; of equal load times the greatest row. Rows without a sample or id are left out."""
    rest = [c for c in rows.columns if c not in (*KEY, "loaded_at")]
    best = rows.where(F.col("sample").isNotNull() & F.col("sequence_id").isNotNull()).groupBy(*KEY).agg(F.max(F.struct("loaded_at", *rest)).alias("_r"))
    return best.select(*[c if c in KEY else F.col(f"_r.{c}").alias(c) for c in rows.columns])


def store_contigs(rows: DataFrame, path: str) -> DataStreamWriter:
    """A writer that adds each micro-batch to the table of contigs in ``path``; set its trigger and start it.

    A batch is one folder that a repeated batch replaces, and the checkpoint lies in the table, so nothing is lost
    or counted twice when the stream is taken up again.
    """
    add = lambda batch, number: latest_copy(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")
    return rows.writeStream.foreachBatch(add).option("checkpointLocation", f"{path}/_checkpoint")


def stored_contigs(spark: SparkSession, path: str) -> DataFrame:
    """The contigs stored so far, each (sample, sequence_id) once, as it was loaded last."""
    return latest_copy(spark.read.parquet(path).drop("batch"))


def distinct_contigs(rows: DataFrame, late: str = "1 day") -> DataFrame:
    """Each (sample, sequence_id) of a stream once, early: copies within ``late`` of the first are dropped, its state then forgotten.

    Rows later than ``late`` are missing; whole results come from ``stored_contigs``.
    """
    return rows.withWatermark("loaded_at", late).dropDuplicatesWithinWatermark(KEY)


def clonotype_counts(rows: DataFrame, window: str = "1 day") -> DataFrame:
    """(day, sample, clonotypeID, n): contigs per window of load time; of ``stored_contigs`` all, of a stream those once it is past the watermark."""
    return rows.where(F.col("clonotypeID").isNotNull()).groupBy(F.window("loaded_at", window).alias("w"), "sample", "clonotypeID").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("day"), "sample", "clonotypeID", "n")
