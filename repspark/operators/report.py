"""Quality report of aligner output: rates by locus, scores, clonality with its dictionary."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from repspark.functions.sequences import as_bool, v_genes
from repspark.operators.ranks import numbered
from repspark.operators.trees import _write

#: The four rates of the report; what counts as sound, where a missing value counts as the other.
RATES = {"productive": True, "stop_codon": False, "v_frameshift": False, "complete_vdj": True}
LOCI = ("IGH", "IGK", "IGL")
SCORES = ("v_score", "d_score", "j_score", "c_score")
#: Fixed value: the first line of the dictionary.
FIRST_LINE = "Dictionary of the corresponding IGVgene_CDR3aa for each clonal group:"


def sound(flag: str):
    """Whether the flag is as it should be; a missing value is not."""
    return F.coalesce(as_bool(flag) == F.lit(RATES[flag]), F.lit(False))


def flag_rates(df: DataFrame, flags: list[str] | None = None, locus: str = "locus") -> DataFrame:
    """(flag, locus, sound, n, percent): contigs of each of the three loci by whether the flag is as it should be."""
    flags = [f for f in (flags or RATES) if f in df.columns]
    rows = df.where(F.col(locus).isin(*LOCI))
    long = rows.select(locus, F.explode(F.array(*[F.struct(F.lit(f).alias("flag"), sound(f).alias("sound")) for f in flags])).alias("x")).select(locus, "x.*")
    n = long.groupBy("flag", locus, "sound").agg(F.count(F.lit(1)).alias("n"))
    whole = F.sum("n").over(Window.partitionBy("flag", locus))
    return n.select("flag", locus, "sound", "n", (F.col("n") * 100.0 / whole).alias("percent"))


def locus_counts(df: DataFrame, locus: str = "locus") -> DataFrame:
    return df.groupBy(locus).agg(F.count(F.lit(1)).alias("n"))


def scores_long(df: DataFrame, scores: list[str] | None = None, keys: list[str] | None = None) -> DataFrame:
    """(keys, gene, score): one row per alignment score that is there; of the D gene those of heavy chains only."""
    scores = [s for s in (scores or SCORES) if s in df.columns]
    keys = keys or ["locus"]
    out = df.unpivot(keys, scores, "gene", "score").where(F.col("score").isNotNull())
    return out.where((F.col("gene") != "d_score") | (F.col("locus") == "IGH")) if "locus" in keys else out


def clonality(df: DataFrame, locus: str = "locus", v_call: str = "v_call", cdr3: str = "cdr3_aa") -> DataFrame:
    """(locus, clonal_group, clonal_id, n, percent) over sound contigs per V genes and CDR3, of the flags that are there.

    Groups of one contig are pooled as Unique_<locus>; the others are named <locus>.<place> by contigs descending, then name.
    """
    for f in RATES:
        if f in df.columns:
            df = df.where(sound(f))
    n = df.where(F.col(cdr3).isNotNull() & F.col(v_call).isNotNull()).select(locus, F.concat_ws("_", F.array_join(v_genes(v_call), ","), F.col(cdr3)).alias("g")).groupBy(locus, "g").agg(F.count(F.lit(1)).alias("n"))
    single = F.concat(F.lit("Unique_"), F.coalesce(F.col(locus), F.lit("NA")))
    pooled = n.withColumn("clonal_group", F.when(F.col("n") == 1, single).otherwise(F.col("g"))).groupBy(locus, "clonal_group").agg(F.sum("n").alias("n"), F.max(F.col("n") == 1).alias("_single"))
    named = numbered(pooled.where(~F.col("_single")), [locus], [F.col("n").desc(), F.col("clonal_group")], "_k").withColumn("clonal_id", F.concat_ws(".", F.coalesce(F.col(locus), F.lit("NA")), F.col("_k").cast("string"))).drop("_k")
    every = named.unionByName(pooled.where("_single").withColumn("clonal_id", F.col("clonal_group"))).drop("_single")
    total = pooled.agg(F.sum("n")).scalar()
    return every.select(locus, "clonal_group", "clonal_id", "n", (F.col("n") * 100.0 / total).alias("percent"))


def write_dictionary(groups: DataFrame, path: str, largest: int = 1_000_000) -> str:
    """The report's text file: which V genes and CDR3 each clonal group of ``clonality`` stands for, most contigs first. Its size is checked."""
    rows = groups.orderBy(F.col("n").desc(), "clonal_id").select("clonal_id", "clonal_group").limit(largest + 1).collect()
    if len(rows) > largest:
        raise ValueError("too many clonal groups for one file")
    _write(groups.sparkSession, path, FIRST_LINE + "\n" + "".join(f"{a} --> {b}\n" for a, b in rows))
    return path
