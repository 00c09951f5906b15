"""Queries of the general problems: a few keys holding most rows (3), references to missing records (4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repspark.functions.missing import present
from repspark.operators.heavy_keys import keyed_fields, per_key_summary, skew_join
from repspark.operators.orphans import composite_key, find_orphans, orphan_report
from repspark.runtime import table, written

HEAVY_FIELDS = ["Clonotype", "clonotypeID"]


def p3_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, reads and samples of every Clonotype and clonotypeID; null, '' and NA are no values; no reads at all sum to 0."""
    df = table(spark, sf_dir, "tidy_contigs")
    rows = df.select(present("sample").alias("sample"), "n_reads", *[present(f).alias(f) for f in HEAVY_FIELDS])
    out = per_key_summary(keyed_fields(rows, HEAVY_FIELDS, ["sample", "n_reads"]), "keyed", "n_reads", "sample")
    parts = F.split("keyed", "\u0001", 2)
    return out.select(parts[0].alias("field_name"), parts[1].alias("key_value"), "n_rows", F.coalesce("sum", F.lit(0).cast("bigint")).alias("sum_reads"), F.col("n_distinct").alias("n_samples"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of Clonotype and clonotypeID that at least 2.5 % of the rows with a value hold."""
    per_key = written(p3_per_key(spark, sf_dir), "per-key")
    total = per_key.groupBy("field_name").agg(F.sum("n_rows").alias("total"))
    return per_key.join(F.broadcast(total), "field_name").where(F.col("n_rows") * 40 >= F.col("total")).select("field_name", "key_value")


def p3_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every contig with the rows and samples of its clonotypeID, null without one: a join on a key that few values dominate."""
    rows = table(spark, sf_dir, "tidy_contigs").select(present("clonotypeID").alias("key_value"), "sample", "sequence_id", "loaded_at")
    per_key = written(p3_per_key(spark, sf_dir).where("field_name = 'clonotypeID'").select("key_value", "n_rows", "n_samples"), "per-key")
    return skew_join(rows, per_key, "key_value", how="left")


def p4_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All references and all parents; keys begin with the name of the target."""
    contigs, cells = table(spark, sf_dir, "annotated_contigs"), table(spark, sf_dir, "cells")
    tagged = lambda name, *c: F.concat(F.lit(f"{name}|"), composite_key(*c))

    def unpivot(df: DataFrame, src: str, at: str, refs: list[tuple[str, object]]) -> DataFrame:
        each = F.explode(F.array(*[F.struct(F.lit(f).alias("ref_field"), k.alias("key")) for f, k in refs])).alias("x")
        return df.select("record_id", F.col(at).alias("at"), each).select(F.lit(src).alias("src_table"), "x.ref_field", "record_id", "x.key", "at").where(F.col("key").isNotNull())

    sample = present("SampleID")
    refs = unpivot(
        contigs, "annotated_contigs", "loaded_at", [("barcode", tagged("c", present("barcode"))), ("SampleID", tagged("s", sample)), ("SubcloneID", tagged("u", sample, present("SubcloneID")))]
    ).unionByName(unpivot(cells, "cells", "registered_at", [("SampleID", tagged("s", sample))]))
    life = ["registered_at", "deleted_at"]
    parents = (
        cells.select(tagged("c", F.col("barcode")).alias("key"), *life)
        .unionByName(table(spark, sf_dir, "sample_sheet").select(tagged("s", F.col("SampleID")).alias("key"), *life))
        .unionByName(table(spark, sf_dir, "subclones").select(tagged("u", F.col("SampleID"), F.col("SubcloneID")).alias("key"), *life))
    )
    return refs, parents


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every reference without a valid target row, distinct."""
    return find_orphans(*p4_inputs(spark, sf_dir)).select("src_table", "ref_field", "record_id").distinct()


def p4_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References and orphans per table, field and month of the reference."""
    refs, parents = p4_inputs(spark, sf_dir)
    return orphan_report(refs, find_orphans(refs, parents))


QUERIES = {"p3_found": p3_found, "p3_per_key": p3_per_key, "p3_joined": p3_joined, "p4_found": p4_found, "p4_report": p4_report}

_REFS = """refs AS (
  SELECT 'annotated_contigs' AS src_table, 'barcode' AS ref_field, record_id, 'c' AS target, barcode AS k1, '' AS k2, loaded_at AS seen_at FROM annotated_contigs WHERE barcode NOT IN ('', 'NA')
  UNION ALL SELECT 'annotated_contigs', 'SampleID', record_id, 's', SampleID, '', loaded_at FROM annotated_contigs WHERE SampleID NOT IN ('', 'NA')
  UNION ALL SELECT 'annotated_contigs', 'SubcloneID', record_id, 'u', SampleID, SubcloneID, loaded_at FROM annotated_contigs WHERE SampleID NOT IN ('', 'NA') AND SubcloneID NOT IN ('', 'NA')
  UNION ALL SELECT 'cells', 'SampleID', record_id, 's', SampleID, '', registered_at FROM cells WHERE SampleID NOT IN ('', 'NA')),
parents AS (
  SELECT 'c' AS target, barcode AS k1, '' AS k2, registered_at, deleted_at FROM cells
  UNION ALL SELECT 's', SampleID, '', registered_at, deleted_at FROM sample_sheet
  UNION ALL SELECT 'u', SampleID, SubcloneID, registered_at, deleted_at FROM subclones),
orphans AS (
  SELECT DISTINCT src_table, ref_field, record_id, seen_at FROM refs r WHERE NOT EXISTS (
    SELECT 1 FROM parents p WHERE p.target = r.target AND p.k1 = r.k1 AND p.k2 = r.k2 AND p.registered_at <= r.seen_at AND (p.deleted_at IS NULL OR p.deleted_at > r.seen_at)))"""

_PER_KEY = """rows AS (
  SELECT 'Clonotype' AS field_name, Clonotype AS key_value, sample, n_reads FROM tidy_contigs UNION ALL SELECT 'clonotypeID', clonotypeID, sample, n_reads FROM tidy_contigs),
per_key AS (
  SELECT field_name, key_value, CAST(count(*) AS BIGINT) AS n_rows, CAST(coalesce(sum(n_reads), 0) AS BIGINT) AS sum_reads, CAST(count(DISTINCT CASE WHEN sample NOT IN ('', 'NA') THEN sample END) AS BIGINT) AS n_samples
  FROM rows WHERE key_value NOT IN ('', 'NA') GROUP BY 1, 2)"""

ORACLE = {
    "p3_per_key": f"WITH {_PER_KEY} SELECT * FROM per_key",
    "p3_joined": f"WITH {_PER_KEY} SELECT CASE WHEN t.clonotypeID NOT IN ('', 'NA') THEN t.clonotypeID END AS key_value, sample, sequence_id, loaded_at, n_rows, n_samples FROM tidy_contigs t LEFT JOIN per_key p ON p.field_name = 'clonotypeID' AND p.key_value = t.clonotypeID",
    "p3_found": f"WITH {_PER_KEY} SELECT field_name, key_value FROM per_key JOIN (SELECT field_name, sum(n_rows) AS total FROM per_key GROUP BY 1) t USING (field_name) WHERE n_rows >= 0.025 * total",
    "p4_found": f"WITH {_REFS} SELECT DISTINCT src_table, ref_field, record_id FROM orphans",
    "p4_report": f"""WITH {_REFS}
SELECT src_table, ref_field, month, CAST(sum(n_refs) AS BIGINT) AS n_refs, CAST(sum(n_orphans) AS BIGINT) AS n_orphans FROM (
  SELECT src_table, ref_field, strftime(seen_at, '%Y-%m') AS month, count(DISTINCT record_id) AS n_refs, 0 AS n_orphans FROM refs GROUP BY 1, 2, 3
  UNION ALL SELECT src_table, ref_field, strftime(seen_at, '%Y-%m'), 0, count(DISTINCT record_id) FROM orphans GROUP BY 1, 2, 3) GROUP BY 1, 2, 3""",
}
