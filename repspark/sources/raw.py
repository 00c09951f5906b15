"""Raw inputs: FASTA, FASTQ, and the tables of the supported sequencing formats, to (sample, sequence_id, sequence)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from repspark.runtime import file_system, written

FASTA_FORMATS = ("fasta", "10xbcr_fasta")
TSV_FORMATS = ("mixcr", "bdrhapsodybcr", "parsebcr", "trust4", "airr", "imgt_airr")
CSV_FORMATS = ("10xbcr_csv",)
FORMATS = FASTA_FORMATS + TSV_FORMATS + CSV_FORMATS
DATA_TYPES = ("single_cell", "bulk", "missionbio")
LOCI = ("IGH", "IGK", "IGL")
_SUFFIX = r"([^/]+?)(?:\.(?:fasta|fa|fastq|fq|tsv|csv|txt))?(?:\.gz)?$"


def check_format(name: str) -> str:
    n = name.lower()
    if n not in FORMATS:
        raise ValueError(f"input_format is one of {', '.join(FORMATS)}")
    return n


def expand_paths(paths: list[str]) -> list[str]:
    """Files of the given files and directories, in order, on any file system that Spark reads; a missing one raises."""
    spark, out = SparkSession.active(), []
    for p in paths:
        fs, path = file_system(spark, p)
        if not fs.exists(path):
            raise FileNotFoundError(p)
        found = [f.getPath() for f in fs.listStatus(path) if f.isFile()] if fs.getFileStatus(path).isDirectory() else [path]
        plain = ":" not in p.split("/", 1)[0]
        out += sorted(f.toUri().getPath() if plain else f.toString() for f in found)
    return out


def _sample(labels: dict[str, str] | None):
    """The sample's label, else its name in a folder ``sample=<name>`` (as ``write_fasta`` makes), else the file's name."""
    name = F.coalesce(F.nullif(F.regexp_extract("path", "/sample=([^/]+)/[^/]+$", 1), F.lit("")), F.regexp_extract("path", _SUFFIX, 1))
    if not labels:
        return name
    m = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])
    return F.coalesce(F.try_element_at(m, F.regexp_extract("path", "([^/]+)$", 1)), name)


def read_fasta(spark: SparkSession, paths: list[str] | str, labels: dict[str, str] | None = None) -> DataFrame:
    """(sample, sequence_id, sequence) of each record; a record without a sequence has an empty one.

    A record begins with '>' at the start of a line; a '>' elsewhere is part of its text. Line ends may be CRLF.
    """
    raw = spark.read.option("lineSep", "\n>").text(paths).select(F.col("_metadata.file_path").alias("path"), F.regexp_replace("value", "^>", "").alias("value"))
    lines = F.split("value", r"\r?\n")
    rows = raw.where(F.trim("value") != "").select(_sample(labels).alias("sample"), F.regexp_replace(lines[0], r"^\s+|\s+$", "").alias("sequence_id"), F.regexp_replace(F.array_join(F.slice(lines, 2, 1 << 30), ""), r"\s", "").alias("sequence"))
    return rows.where(F.col("sequence_id") != "")


def read_fastq(spark: SparkSession, paths: list[str] | str, labels: dict[str, str] | None = None, newline: str = "\n") -> DataFrame:
    """(sample, sequence_id, sequence) of lines 1 and 2 of every 4, whatever line 3 holds; a carriage return before the newline is left out.

    Lines are written once with their place in their split, so files are split among tasks and each line still has its
    number in the file. A header without '@' raises, as records of more than 4 lines do; blank lines at the end are no records.
    """
    place = F.monotonically_increasing_id()  # grows within a split, which lies in one task
    raw = spark.read.option("lineSep", newline).text(paths).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("at"), place.alias("i"), F.regexp_replace("value", r"\r$", "").alias("value"))
    lines = written(raw, "fastq")
    splits = lines.groupBy("path", "at").agg(F.min("i").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("path").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    number = F.col("i") - F.col("first") + F.col("before")
    numbered = lines.join(F.broadcast(splits.withColumn("before", before).drop("n")), ["path", "at"]).select("path", (number % 4).alias("k"), F.floor(number / 4).alias("record"), "value")
    line = lambda k: F.max(F.when(F.col("k") == k, F.col("value")))
    records = numbered.where(F.col("k") < 2).groupBy("path", "record").agg(line(0).alias("head"), F.coalesce(line(1), F.lit("")).alias("bases"))
    wrong = F.raise_error(F.concat(F.lit("no FASTQ header at line "), (F.col("record") * 4 + 1).cast("string"), F.lit(" of "), F.col("path")))
    head = F.when(F.col("head").startswith("@"), F.col("head")).otherwise(wrong)
    rows = records.where((F.trim("head") != "") | (F.trim("bases") != ""))
    return rows.select(_sample(labels).alias("sample"), F.substring(head, F.lit(2), F.length("head")).alias("sequence_id"), F.col("bases").alias("sequence"))


def read_table(spark: SparkSession, paths: list[str] | str, input_format: str, data_type: str = "single_cell", labels: dict[str, str] | None = None) -> DataFrame:
    """(sample, sequence_id, sequence) from a table of one of the supported formats. Mission-bio is read as single cell."""
    fmt = check_format(input_format)
    if data_type not in DATA_TYPES:
        raise ValueError(f"data_type is one of {', '.join(DATA_TYPES)}")
    if fmt in FASTA_FORMATS:
        return read_fasta(spark, paths, labels)
    raw = spark.read.option("header", True).option("sep", "," if fmt in CSV_FORMATS else "\t").csv(paths)
    df = raw.select("*", F.col("_metadata.file_path").alias("path")).withColumn("sample", _sample(labels))
    bulk = data_type == "bulk"
    if fmt == "10xbcr_csv":
        parts = ["fwr1_nt", "cdr1_nt", "fwr2_nt", "cdr2_nt", "fwr3_nt", "cdr3_nt", "fwr4_nt"]
        return df.select("sample", F.col("contig_id").alias("sequence_id"), F.concat(*[F.coalesce(F.col(c), F.lit("")) for c in parts]).alias("sequence"))
    if fmt == "mixcr":
        ident = F.when(F.col("cloneId").rlike("^[0-9]+$"), F.concat(F.col("sample"), F.substring("allVHitsWithScore", 1, 3), F.lit("_"), F.col("cloneId"))).otherwise(F.col("cloneId"))
        count = F.col("cloneCount").cast("double").cast("bigint").cast("string") if bulk else None
        return df.select("sample", (F.concat_ws("=", ident, count) if bulk else ident).alias("sequence_id"), F.regexp_replace("targetSequences", ",", "").alias("sequence"))
    ident = F.concat_ws("=", "sequence_id", F.col("consensus_count").cast("bigint").cast("string")) if bulk else F.col("sequence_id")
    return df.where(F.col("locus").isin(*LOCI)).select("sample", ident.alias("sequence_id"), "sequence")


def write_fasta(df: DataFrame, path: str) -> None:
    """Records as text files under ``path``, one folder per sample."""
    df.select("sample", F.concat(F.lit(">"), F.col("sequence_id"), F.lit("\n"), F.col("sequence")).alias("value")).write.mode("overwrite").partitionBy("sample").text(path)
