"""Queries of the steps after annotation: ids anew after cells or contamination were removed, rescue of single chains."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repspark.operators import cells as C
from repspark.operators import contamination
from repspark.operators.recalc import MERGED, NUMBERS, recalculate_cells
from repspark.plans.annotate import PUBLIC
from repspark.plans.cell_sql import CLASSES, RESOLVED, numbered
from repspark.plans.domain_queries import BULKANN_SQL, CONTAM_BULK_SQL, SC_SQL, bulk_annotated, single_cell
from repspark.plans.workflow import remove_contamination, rescue_contigs
from repspark.runtime import table, written

IDS = ["ClonotypeID", "ClonotypeVariantID", "SubcloneID"]
SHOWN = ["record_id", "SampleID", "barcode", "completeBCR", *IDS, *MERGED, *NUMBERS]


def numbered_contigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single-cell contigs, one per cell and chain, with the merged ids and numbers of their cell."""
    rows = single_cell(spark, sf_dir).groupBy("SampleID", "barcode", "ClonotypeID").agg(F.min(F.struct("record_id", "ClonotypeVariantID", "SubcloneID")).alias("r")).select("SampleID", "barcode", "ClonotypeID", "r.*")
    rows = written(rows, "contigs")
    names = {"SampleID": "unit", "ClonotypeID": "clonotypeID", "ClonotypeVariantID": "clonotypeVariantID_in_Cltp", "SubcloneID": "Unique_SequenceID"}
    cells = C.numbered(written(C.resolve_classes(C.initial_class(C.merged_ids(rows.withColumnsRenamed(names)))), "cells"))
    public = cells.select(F.col("unit").alias("SampleID"), "barcode", "completeBCR", *[F.col(c).alias(PUBLIC[c]) for c in cells.columns if PUBLIC.get(c) in (*MERGED, *NUMBERS)])
    return written(rows.join(public, ["SampleID", "barcode"]).select(*SHOWN), "numbered")


def recalc_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ids anew after the cells that the registry has deleted are gone."""
    gone = table(spark, sf_dir, "cells").groupBy("SampleID", "barcode").agg(F.max("deleted_at").alias("d")).where("d is not null").select("SampleID", "barcode")
    left = numbered_contigs(spark, sf_dir).join(gone, ["SampleID", "barcode"], "left_anti")
    return recalculate_cells(written(left.withColumn("old", F.col("SubcloneID")), "left")).select(*SHOWN, "old")


def _rescue(relaxed: bool):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rescue_contigs(numbered_contigs(spark, sf_dir), relaxed=relaxed)

    return run


def contam_bulk_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subclones free of contamination, with ids and frequencies anew."""
    flagged = contamination.flag_bulk(written(bulk_annotated(spark, sf_dir), "bulk"), ["VDJ_genes", "Junction_aa"], case="CaseID").withColumn("old", F.col("SubcloneID"))
    got = remove_contamination(flagged)
    return got.select("SampleID", "old", *IDS, "SubcloneID_in_Clonotype", "Clonotype_nReads", *[F.round(c, 9).alias(c) for c in ("Clonotype_freq", "ClonotypeVariant_freq", "Subclone_freq_in_Clonotype", "Subclone_freq_in_ClonotypeVariant")])


def id_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(check, wrong rows) of recalculated and rescued contigs: chain, merged and numbered ids agree in every row."""
    out = None
    for name, df in (("recalculated", recalc_merged(spark, sf_dir)), ("rescued", _rescue(False)(spark, sf_dir))):
        df = written(df, "ids")
        own = F.exists(F.split("igSubcloneID", "-"), lambda x: x == F.col("SubcloneID")) & F.exists(F.split("igClonotypeVariantID", "-"), lambda x: x == F.col("ClonotypeVariantID")) & F.exists(F.split("igClonotypeID", "-"), lambda x: x == F.col("ClonotypeID"))
        nested = F.col("SubcloneID").startswith(F.concat("ClonotypeVariantID", F.lit(".S"))) & F.col("ClonotypeVariantID").startswith(F.concat("ClonotypeID", F.lit(".CV")))
        numbers = F.col("igClonotypeID_num").isNull() | (F.col("igClonotypeVariantID_num").startswith(F.concat("igClonotypeID_num", F.lit(".CV"))) & F.col("igSubcloneID_in_ClonotypeVariant_num").startswith(F.concat("igClonotypeVariantID_num", F.lit(".S"))) & F.col("igSubcloneID_in_Clonotype_num").startswith(F.concat("igClonotypeID_num", F.lit("."))))
        wrong = lambda c: F.count_if(~F.coalesce(c, F.lit(False)))
        got = df.agg(F.count(F.lit(1)).alias("n"), wrong(own).alias("own"), wrong(nested).alias("nested"), wrong(numbers).alias("numbers")).select(F.lit(name).alias("step"), (F.col("n") > 0).alias("any_rows"), "own", "nested", "numbers")
        out = got if out is None else out.unionByName(got)
    return out


QUERIES = {"recalc_merged": recalc_merged, "rescue_numbers": _rescue(False), "rescue_numbers_relaxed": _rescue(True), "contam_bulk_removed": contam_bulk_removed, "id_agreement": id_agreement}

NUMBERED_SQL = f"""{SC_SQL}, one AS (SELECT SampleID AS unit, barcode, cid, record_id, cv, sub FROM (SELECT SampleID, barcode, ClonotypeID AS cid, record_id, ClonotypeVariantID AS cv, SubcloneID AS sub, row_number() OVER (PARTITION BY SampleID, barcode, ClonotypeID ORDER BY record_id) AS k FROM sc) WHERE k = 1),
{CLASSES}, {RESOLVED}, {numbered('solved', 'ranked')},
nc AS (SELECT o.record_id, o.unit, o.barcode, completeBCR, cid, cv, sub, m, mv, ms, ig AS n1, igcv AS n2, igsub AS n3, igin AS n4 FROM one o JOIN ranked r ON r.unit = o.unit AND r.barcode = o.barcode)"""


def recalc_sql(src: str) -> str:
    """``again``: all ids of ``src`` anew."""
    place = lambda parents, key, n: f"dense_rank() OVER (PARTITION BY {parents} ORDER BY {n} DESC, {key})"
    element = lambda name, new: f"""e_{name} AS (SELECT unit, {name}, string_agg(coalesce(t, 'NA'), '-' ORDER BY i) AS new_{name} FROM (SELECT q.unit, q.{name}, q.i, t FROM (SELECT unit, {name}, unnest(range(1, len(string_split({name}, '-')) + 1)) AS i, unnest(string_split({name}, '-')) AS x FROM (SELECT DISTINCT unit, {name} FROM {src})) q LEFT JOIN (SELECT unit, {new} AS x, min(new_{new}) AS t FROM a3 GROUP BY 1, 2) o ON o.unit = q.unit AND o.x = q.x) GROUP BY 1, 2)"""
    return f"""a1 AS (SELECT *, substr(cid, 1, 3) AS loc_, count(*) OVER (PARTITION BY unit, substr(cid, 1, 3), cid) AS bn FROM {src}), a2 AS (SELECT *, loc_ || '.C' || {place('unit, loc_', 'cid', 'bn')} AS new_cid, count(*) OVER (PARTITION BY unit, cid, cv) AS vn, count(*) OVER (PARTITION BY unit, cid, cv, sub) AS sn FROM a1),
a3 AS (SELECT *, new_cid || '.CV' || {place('unit, cid', 'cv', 'vn')} AS new_cv, new_cid || '.CV' || {place('unit, cid', 'cv', 'vn')} || '.S' || {place('unit, cid, cv', 'sub', 'sn')} AS new_sub FROM a2),
{element('m', 'cid')}, {element('mv', 'cv')}, {element('ms', 'sub')},
w1 AS (SELECT unit, barcode, max(n1) AS n1, max(n2) AS n2, max(n3) AS n3, max(n4) AS n4 FROM {src} GROUP BY 1, 2),
w2 AS (SELECT *, count(*) OVER (PARTITION BY unit, n1) AS k1, count(*) OVER (PARTITION BY unit, n1, n2) AS k2, count(*) OVER (PARTITION BY unit, n1, n2, n3) AS k3, count(*) OVER (PARTITION BY unit, n1, n4) AS k4 FROM w1 WHERE n1 IS NOT NULL),
w3 AS (SELECT unit, barcode, {place('unit', 'n1', 'k1')} AS p1, {place('unit, n1', 'n2', 'k2')} AS p2, {place('unit, n1, n2', 'n3', 'k3')} AS p3, {place('unit, n1', 'n4', 'k4')} AS p4 FROM w2),
again AS (SELECT a3.record_id, a3.unit AS SampleID, a3.barcode, completeBCR, new_cid AS ClonotypeID, new_cv AS ClonotypeVariantID, new_sub AS SubcloneID, new_m AS igClonotypeID, new_mv AS igClonotypeVariantID, new_ms AS igSubcloneID,
  'C' || p1 AS igClonotypeID_num, 'C' || p1 || '.CV' || p2 AS igClonotypeVariantID_num, 'C' || p1 || '.CV' || p2 || '.S' || p3 AS igSubcloneID_in_ClonotypeVariant_num, 'C' || p1 || '.' || p4 AS igSubcloneID_in_Clonotype_num, a3.sub AS old
  FROM a3 JOIN e_m ON e_m.unit = a3.unit AND e_m.m = a3.m JOIN e_mv ON e_mv.unit = a3.unit AND e_mv.mv = a3.mv JOIN e_ms ON e_ms.unit = a3.unit AND e_ms.ms = a3.ms LEFT JOIN w3 ON w3.unit = a3.unit AND w3.barcode = a3.barcode)"""


def _rescue_sql(column: str) -> str:
    low = lambda c, before: f"arg_min({c}, (TRY_CAST(regexp_extract({c}, '{before}([0-9]+)$', 1) AS BIGINT), {c})) AS l{c}"
    return f"""WITH RECURSIVE {NUMBERED_SQL}, yes AS (SELECT DISTINCT unit, {column} AS id, string_split({column}, '-') AS p, n1, n2, n3, n4 FROM nc WHERE completeBCR = 'Yes' AND n1 IS NOT NULL),
runs AS (SELECT unit, n1, n2, n3, n4, unnest(p) AS run FROM yes UNION ALL SELECT unit, n1, n2, n3, n4, unnest(list_transform(range(1, len(p)), lambda i: p[i] || '-' || p[i + 1])) FROM yes UNION ALL SELECT unit, n1, n2, n3, n4, id FROM yes),
hit AS (SELECT unit, run, min(n1) AS h1, {low('n2', 'CV')}, {low('n3', 'S')}, {low('n4', chr(92) + '.')} FROM runs GROUP BY 1, 2 HAVING count(DISTINCT n1) = 1),
saved AS (SELECT nc.* REPLACE (CASE WHEN h1 IS NOT NULL THEN 'Yes_rescue' ELSE completeBCR END AS completeBCR, coalesce(h1, n1) AS n1, CASE WHEN h1 IS NOT NULL THEN ln2 ELSE n2 END AS n2, CASE WHEN h1 IS NOT NULL THEN ln3 ELSE n3 END AS n3, CASE WHEN h1 IS NOT NULL THEN ln4 ELSE n4 END AS n4)
  FROM nc LEFT JOIN hit ON hit.unit = nc.unit AND hit.run = nc.{column} AND completeBCR IN ('Single_chain_1', 'Single_chain_2')), {recalc_sql('saved')} SELECT * EXCLUDE (old) FROM again"""


ORACLE = {
    "recalc_merged": f"WITH RECURSIVE {NUMBERED_SQL}, kept_rows AS (SELECT * FROM nc WHERE NOT EXISTS (SELECT 1 FROM cells c WHERE c.SampleID = nc.unit AND c.barcode = nc.barcode AND c.deleted_at IS NOT NULL)), {recalc_sql('kept_rows')} SELECT * FROM again",
    "rescue_numbers": _rescue_sql("ms"),
    "rescue_numbers_relaxed": _rescue_sql("m"),
    "contam_bulk_removed": f"""{CONTAM_BULK_SQL}, ok AS (SELECT x.SampleID, ClonotypeID, ClonotypeVariantID, SubcloneID, r, vr FROM x WHERE raw IS NULL),
t AS (SELECT *, sum(r) OVER (PARTITION BY SampleID, ClonotypeID) AS cr, sum(r) OVER (PARTITION BY SampleID) AS sr, sum(r) OVER (PARTITION BY SampleID, ClonotypeID, ClonotypeVariantID) AS rv FROM ok),
vt AS (SELECT SampleID, ClonotypeID, sum(vr) AS vt FROM (SELECT DISTINCT SampleID, ClonotypeID, ClonotypeVariantID, vr FROM ok) GROUP BY 1, 2),
k AS (SELECT t.*, vt, 'C' || dense_rank() OVER (PARTITION BY t.SampleID ORDER BY cr DESC, t.ClonotypeID) AS c, dense_rank() OVER (PARTITION BY t.SampleID, t.ClonotypeID ORDER BY vr DESC, ClonotypeVariantID) AS v FROM t JOIN vt ON vt.SampleID = t.SampleID AND vt.ClonotypeID = t.ClonotypeID)
SELECT SampleID, SubcloneID AS old, c AS ClonotypeID, c || '.CV' || v AS ClonotypeVariantID, c || '.CV' || v || '.S' || row_number() OVER (PARTITION BY SampleID, ClonotypeID, ClonotypeVariantID ORDER BY r DESC, SubcloneID) AS SubcloneID,
c || '.' || row_number() OVER (PARTITION BY SampleID, ClonotypeID ORDER BY r DESC, SubcloneID) AS SubcloneID_in_Clonotype, CAST(cr AS BIGINT) AS Clonotype_nReads, round(cr * 100.0 / sr, 9) AS Clonotype_freq, round(vr * 100.0 / vt, 9) AS ClonotypeVariant_freq, round(r * 100.0 / cr, 9) AS Subclone_freq_in_Clonotype, round(r * 100.0 / rv, 9) AS Subclone_freq_in_ClonotypeVariant FROM k""",
    "id_agreement": "SELECT * FROM (VALUES ('recalculated', true, 0, 0, 0), ('rescued', true, 0, 0, 0)) t (step, any_rows, own, nested, numbers)",
}
