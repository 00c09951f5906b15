"""The aligner boundary: its output as input, and its call where the program is installed; tables out."""

from __future__ import annotations

import os
import shutil
import subprocess
import tempfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from repspark.operators.tidy import REQUIRED
from repspark.runtime import ship

PATTERN = "_igblast_out.tsv"
_KINDS = {"v_identity": T.DoubleType(), "junction_aa_length": T.IntegerType(), "v_score": T.DoubleType(), "d_score": T.DoubleType(), "j_score": T.DoubleType(), "c_score": T.DoubleType()}
EXTRA = ["locus", "stop_codon", "v_frameshift", "cdr3_aa", "v_score", "d_score", "j_score", "c_score"]


def read_aligned(spark: SparkSession, folder: str, samples: list[str] | None = None, cases: dict[str, str] | None = None) -> DataFrame:
    """Rows of the aligner's TSV files with sample and unit: the sample, or its case in joint mode.

    Columns are taken by name; a missing c_call is null. ``samples`` restricts to listed ones, each of which must be there.
    """
    df = spark.read.option("header", True).option("sep", "\t").option("pathGlobFilter", f"*{PATTERN}").csv(folder).withColumn("sample", F.regexp_extract(F.col("_metadata.file_path"), f"([^/]+){PATTERN}$", 1))
    for c in REQUIRED:
        if c not in df.columns:
            if c != "c_call":
                raise ValueError(f"missing column {c}")
            df = df.withColumn(c, F.lit(None).cast("string"))
    df = df.select(*[F.col(c).cast(_KINDS.get(c, T.StringType())).alias(c) for c in [*REQUIRED, *[e for e in EXTRA if e in df.columns]]])
    if samples:
        df = df.where(F.col("sample").isin(*samples))
    if cases:
        m = F.create_map(*[F.lit(x) for kv in cases.items() for x in kv])
        return df.withColumn("unit", F.try_element_at(m, F.col("sample")))
    return df.withColumn("unit", F.col("sample"))


def run_aligner(df: DataFrame, program: str, database: dict[str, str], evalue: float | None = None, annotate_c: bool = True, columns: list[str] | None = None, threads: int = 1) -> DataFrame:
    """Aligner output of (sample, sequence_id, sequence), a process per batch of rows on the executors; raises where the program is missing.

    ``database`` maps V, D, J (and C) to germline databases. Each process has ``threads`` threads; set spark.task.cpus to as many.
    """
    if not shutil.which(program):
        raise FileNotFoundError(f"aligner {program} is not installed; read its output with read_aligned instead")
    names = columns or [c for c in REQUIRED if c != "sample"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            with tempfile.TemporaryDirectory() as tmp:
                source, target = os.path.join(tmp, "in.fasta"), os.path.join(tmp, "out.tsv")
                with open(source, "w") as f:
                    f.write("".join(f">{i}\n{s}\n" for i, s in zip(pdf["sequence_id"], pdf["sequence"])))
                cmd = [program, "-query", source, "-out", target, "-outfmt", "19", "-num_alignments_D", "1", "-extend_align5end", "-extend_align3end"]
                for gene, db in database.items():
                    if gene != "C" or annotate_c:
                        cmd += [f"-{'c_region_db' if gene == 'C' else f'germline_db_{gene}'}", db]
                if threads > 1:
                    cmd += ["-num_threads", str(threads)]
                if evalue is not None:
                    cmd += ["-evalue", str(evalue)]
                subprocess.run(cmd, check=True, capture_output=True)
                got = pd.read_csv(target, sep="\t", dtype=str)
            got["sample"] = got["sequence_id"].map(dict(zip(pdf["sequence_id"], pdf["sample"])))
            got = got.reindex(columns=[*names, "sample"]).astype(object)
            yield got.where(got.notna(), None)

    ship(df.sparkSession)
    return df.mapInPandas(run, ", ".join(f"{c} string" for c in [*names, "sample"]))


#: Texts are written as they are, with their outer spaces.
_AS_IS = {"header": True, "sep": "\t", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def write_annotated(df: DataFrame, path: str, fmt: str = "parquet", by: tuple[str, ...] = ("SampleID",)) -> None:
    """The annotated table, a folder per sample."""
    w = df.write.mode("overwrite").partitionBy(*by)
    if fmt == "tsv":
        w.options(**_AS_IS).csv(path)
    elif fmt == "parquet":
        w.parquet(path)
    else:
        raise ValueError("fmt is parquet or tsv")


def write_airr(df: DataFrame, path: str, one_file: bool = False) -> None:
    """The AIRR table as TSV; one file only on demand."""
    (df.coalesce(1) if one_file else df).write.mode("overwrite").options(**_AS_IS, emptyValue="").csv(path)


def write_missionbio(cells: DataFrame, path: str) -> None:
    """The per-barcode table of ``mission_bio_cells`` as TSV, with a header."""
    cells.write.mode("overwrite").options(**_AS_IS).csv(path)


def split_by_sample(df: DataFrame, samples: list[str], column: str = "SampleID") -> dict[str, DataFrame]:
    """One lazy table per named sample."""
    return {f"{s}_annot": df.where(F.col(column) == s) for s in samples}
