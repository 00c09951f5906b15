"""Queries of the training-data problems and the SQL of those that SQL can express."""

from __future__ import annotations

import hashlib
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repspark.functions.missing import present
from repspark.llm.bpe import encode_texts
from repspark.llm.leaks import find_leaks
from repspark.llm.quantiles import K, daily_sketches, group_percentiles, total_percentiles
from repspark.llm.sentences import doubtful_places, find_sentences
from repspark.llm.term_counts import TermCountStore, marked
from repspark.llm.top_n import latest_per_item, top_n
from repspark.runtime import scratch, table, written

PERMILLE = [50, 250, 500, 750, 950]
TERM_FIELDS = {"v_call": ",", "junction_aa": None}
#: The rows loaded in the last so many days stand for the day's delta; all before them are the counts kept so far.
DELTA_DAYS = 30


def p1_percentiles(spark: SparkSession, sf_dir: str, k: int = K) -> DataFrame:
    """Percentiles of V_identity for each sample, and for all rows together (a null SampleID, scope 'all').

    max_rank_error is the proven bound of the rank error, in rows. A row whose SampleID is null, '' or NA
    counts in 'all' only. Every row counts, copies too.
    """
    df = table(spark, sf_dir, "annotated_contigs").select(present("SampleID").alias("SampleID"), "V_identity", "loaded_at")
    days = written(daily_sketches(df, "V_identity", "SampleID", "loaded_at", 0.0, 100.0, k), "sketches")
    each = group_percentiles(days, PERMILLE, k).withColumn("scope", F.lit("sample"))
    whole = total_percentiles(days, PERMILLE, k).withColumn("scope", F.lit("all")).withColumn("grp", F.lit(None).cast("string"))
    cols = [F.col("grp").alias("SampleID"), "scope", "n_values", F.col("rank_error").alias("max_rank_error"), *[F.col(f"q{q}").alias(f"p{q // 10:02d}") for q in PERMILLE]]
    return each.unionByName(whole).select(*cols)


def p1_within_bound(spark: SparkSession, sf_dir: str, k: int = K) -> DataFrame:
    """(scope, SampleID, percentile, n_values, within): whether each estimate's true rank lies within its bound."""
    got = written(p1_percentiles(spark, sf_dir, k), "percentiles")
    v = F.col("V_identity")
    values = table(spark, sf_dir, "annotated_contigs").select(present("SampleID").alias("SampleID"), v.alias("v")).where(v.isNotNull() & ~F.isnan(v) & v.between(0.0, 100.0))
    ps = [q // 10 for q in PERMILLE]
    ranks = [F.count_if(F.col("v") < F.col(f"p{p:02d}")).alias(f"lt{p}") for p in ps] + [F.count_if(F.col("v") <= F.col(f"p{p:02d}")).alias(f"le{p}") for p in ps]
    first = [F.any_value(c).alias(c) for c in ("n_values", "max_rank_error")]
    per = got.where("scope = 'sample'").join(values, "SampleID").groupBy("SampleID").agg(*ranks, *first).withColumn("scope", F.lit("sample"))
    row = got.where("scope = 'all'").drop("SampleID", "scope").first()
    if row is None:
        return spark.createDataFrame([], "scope string, SampleID string, percentile int, n_values bigint, within boolean")
    whole = values.select("v", *[F.lit(row[c]).alias(c) for c in row.__fields__]).agg(*ranks, *first).withColumn("scope", F.lit("all")).withColumn("SampleID", F.lit(None).cast("string"))
    checks = F.explode(
        F.array(*[F.struct(F.lit(p).alias("percentile"), ((F.col(f"lt{p}") < F.ceil(F.col("n_values") * p / 100) + F.col("max_rank_error")) & (F.col(f"le{p}") >= F.ceil(F.col("n_values") * p / 100) - F.col("max_rank_error"))).alias("within")) for p in ps])
    ).alias("c")
    return per.unionByName(whole).select("scope", "SampleID", "n_values", checks).select("scope", "SampleID", "c.percentile", "n_values", "c.within")


def p1_within_bound_small(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with buffers of 16 values, so that samples are collapsed many times too, and the bound of each is below its values."""
    got = written(p1_percentiles(spark, sf_dir, 16), "percentiles")
    r = got.agg(F.max("max_rank_error").alias("e"), F.max(F.col("max_rank_error") / F.col("n_values")).alias("share")).first()
    collapsed, useful = (r["e"] or 0) > 0, (r["share"] or 0) < 1
    return p1_within_bound(spark, sf_dir, 16).withColumns({"collapsed": F.lit(collapsed), "useful": F.lit(useful)})


def store_path(spark: SparkSession, name: str, source: str) -> str:
    """Where the counts of a table are kept: a folder of ``repspark.term_store`` (a setting of the session) of its own, else one that goes with the driver."""
    root = spark.conf.get("repspark.term_store", None)
    return f"{root.rstrip('/')}/{name}-{hashlib.sha256(source.encode()).hexdigest()[:16]}" if root else scratch(spark, name)


def counted_rows(spark: SparkSession, sf_dir: str) -> TermCountStore:
    """Counts of all rows of tidy_contigs. Rows loaded since the store was last brought up to date are its delta; a new store
    is given the earlier rows first, then those of the last days, as it would have been."""
    rows = table(spark, sf_dir, "tidy_contigs").select(*TERM_FIELDS, F.col("loaded_at").cast("timestamp_ntz").alias("at"), F.lit(1).alias("sign"))
    last = rows.agg(F.max("at").cast("string")).first()[0]
    store = TermCountStore(spark, store_path(spark, "terms", sf_dir), TERM_FIELDS)
    at, done = F.col("at"), store.note()
    moment = lambda t: F.lit(t).cast("timestamp_ntz")
    if done is None:
        early = F.coalesce(at <= moment(last) - F.make_interval(days=F.lit(DELTA_DAYS)), F.lit(True))
        store.apply(rows.where(early), note="")
        store.apply(rows.where(~early), note=last or "")
    elif last and last != done:
        store.apply(rows.where(at > moment(done)) if done else rows.where(at.isNotNull()), note=last)
    return store


def record_changes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The valid contigs of tidy_contigs as they were DELTA_DAYS before the last load, and what has changed since, both with a sign.

    A contig (sample, sequence_id) is as it was loaded last; one that is not productive is withdrawn. Loading it anew
    changes it, withdrawing it deletes it. Only contigs loaded in those days are looked at for the changes.
    """
    rows = table(spark, sf_dir, "tidy_contigs").where(F.col("sample").isNotNull() & F.col("sequence_id").isNotNull())
    key, at = ["sample", "sequence_id"], F.col("loaded_at").cast("timestamp_ntz")
    rows = rows.select(*key, at.alias("at"), F.upper(F.trim("productive")).isin("T", "TRUE").alias("valid"), *TERM_FIELDS)
    since = F.lit(rows.agg(F.max("at").cast("string")).first()[0]).cast("timestamp_ntz") - F.make_interval(days=F.lit(DELTA_DAYS))
    is_new = F.coalesce(F.col("at") > since, F.lit(False))
    row = F.struct("at", *TERM_FIELDS, "valid")
    before = rows.where(~is_new).groupBy(*key).agg(F.max(row).alias("r")).where("r.valid").select(*[f"r.{f}" for f in TERM_FIELDS], F.lit(1).alias("sign"))
    touched = rows.where(is_new).select(*key).distinct()
    pairs = rows.join(touched, key, "left_semi").groupBy(*key).agg(F.max(F.when(~is_new, row)).alias("old"), F.max(row).alias("new"))
    sides = F.array(F.struct(F.col("old").alias("r"), F.lit(-1).alias("sign")), F.struct(F.col("new").alias("r"), F.lit(1).alias("sign")))
    changes = pairs.select(F.explode(F.filter(sides, lambda x: F.coalesce(x["r"]["valid"], F.lit(False)))).alias("x"))
    return before, changes.select(*[f"x.r.{f}" for f in TERM_FIELDS], "x.sign")


def p2_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrences, records and mark over the valid contigs: the counts of an earlier day, brought up to date by added, changed and deleted records."""
    store = TermCountStore(spark, scratch(spark, "valid-terms"), TERM_FIELDS)
    for part in record_changes(spark, sf_dir):
        store.apply(part)
    store.compact()
    return marked(store)


def p2_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrences, records and mark of every gene call and junction."""
    return marked(counted_rows(spark, sf_dir))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The terms that are too rare or too common to be useful."""
    return p2_counts(spark, sf_dir).where(F.col("mark").isNotNull()).select("field_name", "term", "mark")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five clonotypes of each sample by their latest frequency."""
    df = table(spark, sf_dir, "clonotype_freqs").withColumn("sample", present("sample")).withColumn("ClonotypeID", present("ClonotypeID"))
    return top_n(latest_per_item(df, "sample", "ClonotypeID", "Clonotype_freq", "reported_at"), "sample", "ClonotypeID", "Clonotype_freq", 5).select("sample", "ClonotypeID")


def vocabulary_path() -> str:
    """Place of the vocabulary: REPSPARK_TOKENIZERS or the installed package of public tokenizers."""
    folder = os.environ.get("REPSPARK_TOKENIZERS")
    if not folder:
        import public_tokenizers

        return public_tokenizers.path("byte_bpe_50k.tiktoken")
    return f"{folder}/byte_bpe_50k.tiktoken"


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    return encode_texts(table(spark, sf_dir, "documents"), vocabulary_path())


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and the evaluation items that leaked into them."""
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sentences of every document."""
    return find_sentences(table(spark, sf_dir, "documents"))


def p8_doubtful(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The places at which the model is in doubt."""
    return doubtful_places(table(spark, sf_dir, "documents"))


QUERIES = {"p1_percentiles": p1_percentiles, "p1_within_bound": p1_within_bound, "p1_within_bound_small": p1_within_bound_small, "p2_found": p2_found, "p2_counts": p2_counts, "p2_changed": p2_changed, "p5_found": p5_found, "p6_ids": p6_ids, "p7_found": p7_found, "p8_found": p8_found, "p8_doubtful": p8_doubtful}

_TERMS = """terms AS (
  SELECT rid, 'v_call' AS field_name, upper(trim(t)) AS term FROM (SELECT rid, unnest(string_split(v_call, ',')) AS t FROM rows)
  UNION ALL SELECT rid, 'junction_aa', upper(trim(junction_aa)) FROM rows),
good AS (SELECT * FROM terms WHERE term IS NOT NULL AND term NOT IN ('', 'NA')),
total AS (SELECT field_name, count(DISTINCT rid) AS n FROM good GROUP BY 1),
counts AS (SELECT field_name, term, count(*) AS occurrences, count(DISTINCT rid) AS records FROM good GROUP BY 1, 2),
marks AS (SELECT field_name, term, occurrences, records, CASE WHEN records < 3 THEN 'rare' WHEN records > 0.02 * n THEN 'common' END AS mark FROM counts JOIN total USING (field_name))"""
_COUNTS = f"rows AS (SELECT row_number() OVER () AS rid, v_call, junction_aa FROM tidy_contigs), {_TERMS}"
_CURRENT = f"""latest AS (SELECT v_call, junction_aa, productive, row_number() OVER (PARTITION BY sample, sequence_id ORDER BY loaded_at DESC, v_call DESC NULLS LAST, junction_aa DESC NULLS LAST, upper(trim(productive)) IN ('T', 'TRUE') DESC NULLS LAST) AS k
  FROM tidy_contigs WHERE sample IS NOT NULL AND sequence_id IS NOT NULL),
rows AS (SELECT row_number() OVER () AS rid, v_call, junction_aa FROM latest WHERE k = 1 AND upper(trim(productive)) IN ('T', 'TRUE')), {_TERMS}"""

_VALUES = """v AS (SELECT CASE WHEN SampleID NOT IN ('', 'NA') THEN SampleID END AS SampleID FROM annotated_contigs WHERE NOT isnan(V_identity) AND V_identity BETWEEN 0 AND 100),
n AS (SELECT 'sample' AS scope, SampleID, count(*) AS n_values FROM v WHERE SampleID IS NOT NULL GROUP BY SampleID UNION ALL SELECT 'all', NULL, count(*) FROM v)"""

ORACLE = {
    "p1_within_bound": f"WITH {_VALUES} SELECT scope, SampleID, percentile, n_values, true AS within FROM n, (VALUES (5), (25), (50), (75), (95)) p (percentile)",
    "p1_within_bound_small": f"WITH {_VALUES} SELECT scope, SampleID, percentile, n_values, true AS within, true AS collapsed, true AS useful FROM n, (VALUES (5), (25), (50), (75), (95)) p (percentile)",
    "p2_counts": f"WITH {_COUNTS} SELECT * FROM marks",
    "p2_changed": f"WITH {_CURRENT} SELECT * FROM marks",
    "p2_found": f"WITH {_COUNTS} SELECT field_name, term, mark FROM marks WHERE mark IS NOT NULL",
    "p5_found": """WITH latest AS (
  SELECT sample, ClonotypeID, Clonotype_freq, row_number() OVER (PARTITION BY sample, ClonotypeID ORDER BY reported_at DESC) AS k
  FROM clonotype_freqs WHERE sample NOT IN ('', 'NA') AND ClonotypeID NOT IN ('', 'NA')),
ranked AS (SELECT sample, ClonotypeID, row_number() OVER (PARTITION BY sample ORDER BY Clonotype_freq DESC, ClonotypeID) AS k FROM latest WHERE k = 1 AND Clonotype_freq IS NOT NULL AND NOT isnan(Clonotype_freq))
SELECT sample, ClonotypeID FROM ranked WHERE k <= 5""",
}
