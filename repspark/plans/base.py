"""The tables that the registered queries run over, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from repspark.functions.sequences import v_genes
from repspark.operators.tidy import REGIONS
from repspark.runtime import table

_HEX, _NT = "0123456789abcdef", "ACGTACGTACGTACGT"


def latest_contigs(spark: SparkSession, sf_dir: str, columns: list[str] | None = None, together: Column | None = None) -> DataFrame:
    """tidy_contigs (with those ``columns`` only) with one row per (sample, sequence_id), that loaded last (of equal times the greatest); rows without a sample or id are left out.

    Aggregated, not sorted: the row travels as one struct behind its load time. With ``together``, an expression of sample and
    sequence_id, the one shuffle is by it.
    """
    df = table(spark, sf_dir, "tidy_contigs").where(F.col("sample").isNotNull() & F.col("sequence_id").isNotNull())
    rest = columns or [c for c in df.columns if c not in ("sample", "sequence_id")]
    if together is not None:
        df = df.withColumn("_together", together).repartition("_together")
    best = df.groupBy(*["_together"] * (together is not None), "sample", "sequence_id").agg(F.max(F.struct("loaded_at", *[c for c in rest if c != "loaded_at"])).alias("r"))
    return best.select("sample", "sequence_id", *[f"r.{c}" for c in rest])


def _nt(*parts: Column | str) -> Column:
    return F.translate(F.md5(F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])), _HEX, _NT)


def aligned(spark: SparkSession, sf_dir: str, together: Column | None = None) -> DataFrame:
    """Aligner-like rows of the contigs that have a junction: regions spelled from the V gene and the junction.

    One base of FR1 is changed, so that identities differ; incomplete rows lack none, two or four regions.
    """
    df = latest_contigs(spark, sf_dir, together=together).where(F.length("junction") >= 9).withColumn("unit", F.col("sample"))
    g = F.coalesce(F.try_element_at(v_genes("v_call"), F.lit(1)), F.lit("NA"))
    j, n = F.col("junction"), F.length("sequence_id")
    whole = F.upper("complete_vdj").isin("T", "TRUE")
    gap2, gap4 = ~whole & (n % 3 >= 1), ~whole & (n % 3 == 2)
    fr1 = _nt(g, "a")
    p = n % 30 + 1
    germ = {
        "fwr1": fr1, "cdr1": F.substring(_nt(g, "b"), 1, 24), "fwr2": F.substring(_nt(g, "c"), 1, 30), "cdr2": F.substring(_nt(g, "d"), 1, 24), "fwr3": F.concat(_nt(g, "e"), F.substring(j, 1, 3)),
        "cdr3": F.substring(j, F.lit(4), F.length(j) - 6), "fwr4": F.concat(F.substring(j, -3, 3), F.lit("GGCCAAGGGACCACG")),
    }
    seq = germ | {"fwr1": F.concat(F.substring(fr1, F.lit(1), p - 1), F.lit("A"), F.substring(fr1, p + 1, F.lit(40)))}
    for gap, names in ((gap2, REGIONS[:2]), (gap4, REGIONS[2:4])):
        for r in names:
            seq[r], germ[r] = F.when(gap, "").otherwise(seq[r]), F.when(gap, "").otherwise(germ[r])
    germ["cdr3"] = F.repeat(F.lit("N"), F.length(j) - 6)
    df = df.withColumns(seq).withColumn("germline_alignment", F.concat(*[germ[r] for r in REGIONS]))
    text = F.concat(*REGIONS)
    return df.withColumns({"sequence_alignment": text, "sequence": text, "v_identity": F.lit(None).cast("double")})


def nt_sql(x: str) -> str:
    return f"translate(md5({x}), '{_HEX}', '{_NT}')"


GENES_SQL = "list_sort(list_distinct(list_filter(list_transform(string_split(string_split(v_call, '/')[1], ','), lambda x: upper(trim(regexp_replace(x, '\\*[0-9]+', '', 'g')))), lambda x: x NOT IN ('', 'NA'))))"

CONTIGS_SQL = """contigs AS (SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY sample, sequence_id ORDER BY loaded_at DESC) AS k FROM tidy_contigs WHERE sample IS NOT NULL AND sequence_id IS NOT NULL) WHERE k = 1)"""

ALIGNED_SQL = f"""{CONTIGS_SQL},
base AS (SELECT *, coalesce({GENES_SQL}[1], 'NA') AS g, length(sequence_id) AS n, upper(complete_vdj) IN ('T', 'TRUE') AS whole FROM contigs WHERE length(junction) >= 9),
germ AS (SELECT *, {nt_sql("g || 'a'")} AS g1, (NOT whole) AND n % 3 >= 1 AS gap2, (NOT whole) AND n % 3 = 2 AS gap4 FROM base),
regions AS (SELECT *, CASE WHEN gap2 THEN '' ELSE g1 END AS germ1,
  CASE WHEN gap2 THEN '' ELSE substr(g1, 1, n % 30) || 'A' || substr(g1, n % 30 + 2, 40) END AS fwr1, CASE WHEN gap2 THEN '' ELSE substr({nt_sql("g || 'b'")}, 1, 24) END AS cdr1,
  CASE WHEN gap4 THEN '' ELSE substr({nt_sql("g || 'c'")}, 1, 30) END AS fwr2, CASE WHEN gap4 THEN '' ELSE substr({nt_sql("g || 'd'")}, 1, 24) END AS cdr2,
  {nt_sql("g || 'e'")} || substr(junction, 1, 3) AS fwr3, substr(junction, 4, length(junction) - 6) AS cdr3, right(junction, 3) || 'GGCCAAGGGACCACG' AS fwr4 FROM germ),
aligned AS (SELECT *, fwr1 || cdr1 || fwr2 || cdr2 || fwr3 || cdr3 || fwr4 AS seq, germ1 || cdr1 || fwr2 || cdr2 || fwr3 || repeat('N', length(cdr3)) || fwr4 AS germline FROM regions)"""
