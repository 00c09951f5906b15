"""Queries of the whole annotation, and the same as SQL where each step can be said in it (single linkage, no joining by indels)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from repspark.config import AnnotateConfig
from repspark.functions.sequences import barcode
from repspark.operators.immunogenetics import correct_indels
from repspark.operators.tidy import REGIONS, tidy
from repspark.plans.annotate import annotate, cell_key
from repspark.plans.base import ALIGNED_SQL, GENES_SQL, aligned
from repspark.plans.cell_sql import CLASSES, RELABELLED, RESOLVED, numbered, one_per_chain
from repspark.plans.sequence_queries import CODONS_SQL, VDJ_SQL, aa_sql, rules_sql
from repspark.runtime import table

MAX_DIFF = 0.2


def gapped(spark: SparkSession, sf_dir: str, together: Column | None = None) -> DataFrame:
    """``aligned`` with gaps: by the hash of their id, rows lack three bases in FR3 (0, 1) or in the CDR3 (3), or have three more in FR2 (2)."""
    df = aligned(spark, sf_dir, together)
    mark = F.substring(F.md5("sequence_id"), 1, 1)
    before = lambda n: sum((F.length(r) for r in REGIONS[1:n]), F.length(REGIONS[0])) if n else F.lit(0)
    fr3, fr2, cdr3 = before(4) + 10, before(2) + 10, before(5) + 4
    whole = F.col("fwr1") != ""
    lacks = F.when(whole & mark.isin("0", "1"), fr3).when(whole & (mark == "3") & (F.length("cdr3") >= 12), cdr3)
    extra = F.when(whole & (mark == "2"), fr2)
    cut = lambda c, at, n, put: F.concat(F.substring(c, F.lit(1), at), F.lit(put), F.substring(c, at + 1 + n, F.lit(10_000)))
    s, g = F.col("sequence_alignment"), F.col("germline_alignment")
    new = {
        "sequence_alignment": F.when(lacks.isNotNull(), cut(s, lacks, 3, "---")).when(extra.isNotNull(), cut(s, extra, 0, "CAT")).otherwise(s),
        "germline_alignment": F.when(extra.isNotNull(), cut(g, extra, 0, "---")).otherwise(g),
        "fwr3": F.when(whole & mark.isin("0", "1"), cut(F.col("fwr3"), F.lit(10), 3, "")).otherwise(F.col("fwr3")),
        "fwr2": F.when(extra.isNotNull(), cut(F.col("fwr2"), F.lit(10), 0, "CAT")).otherwise(F.col("fwr2")),
        "cdr3": F.when(whole & (mark == "3") & (F.length("cdr3") >= 12), cut(F.col("cdr3"), F.lit(4), 3, "")).otherwise(F.col("cdr3")),
    }
    return df.withColumns(new)


def gap_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences, germlines and region lengths with their gaps resolved, and the events."""
    df = correct_indels(tidy(gapped(spark, sf_dir)))
    return df.select("sample", "sequence_id", "VDJseq", "germline_alignment", F.array_join(F.col("arch").cast("array<string>"), "-").alias("arch"), "indel")


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(f.name, 9).alias(f.name) if f.dataType.typeName() == "double" else F.col(f.name) for f in df.schema])


def _cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "sample_sheet")
    return s.groupBy(F.col("SampleID").alias("sample")).agg(F.min_by("CaseID", F.struct("registered_at", "CaseID")).alias("unit"))


def _run(bulk: bool, cfg: AnnotateConfig, joint: bool = False, mission_bio: bool = False):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = gapped(spark, sf_dir, None if bulk else cell_key("sample", barcode("sequence_id", "sample"))).where(F.col("n_reads").isNotNull() if bulk else F.col("n_reads").isNull())
        if joint:
            df = df.drop("unit").join(_cases(spark, sf_dir), "sample")
        return _rounded(annotate(df, cfg))

    return run


PLAIN = {"hc_mode": "single", "cdr3_InDel_correction_mode": "no", "annotate_CLL_immGen": True}
QUERIES = {
    "gap_events": gap_events,
    "annotate_bulk_e2e": _run(True, AnnotateConfig(data_type="bulk", annotate_ags=True, **PLAIN)),
    "annotate_sc_e2e": _run(False, AnnotateConfig(**PLAIN)),
    "annotate_sc_joint": _run(False, AnnotateConfig(analysis_mode="joint", **PLAIN), joint=True),
    "annotate_bulk_dna": _run(True, AnnotateConfig(data_type="bulk", material_type="dna", annotate_ags=True, **PLAIN)),
    "annotate_sc_dna": _run(False, AnnotateConfig(material_type="dna", **PLAIN)),
    "annotate_bulk_aa": _run(True, AnnotateConfig(data_type="bulk", cdr3_mode="aa", annotate_ags=True, **PLAIN)),
    "annotate_bulk_default": _run(True, AnnotateConfig(data_type="bulk")),
    "annotate_sc_default": _run(False, AnnotateConfig()),
    "annotate_bulk_hard_filter": _run(True, AnnotateConfig(data_type="bulk", hc_mode="complete", cdr3_InDel_correction_mode="hard_filter")),
    "annotate_bulk_automatic": _run(True, AnnotateConfig(data_type="bulk", hc_similarity_cutoff="automatic")),
    "annotate_missionbio": _run(False, AnnotateConfig(data_type="missionbio", annotate_CLL_immGen=True)),
}

_WHOLE = " AND ".join(f"{r} <> ''" for r in REGIONS)


def _gapped_sql(where: str, unit: str = "sample") -> str:
    """``tidyg``: the rows with sq and gm (sequence and germline, whole, as they are after correction), cdr3, v_len, arch, indel, raw."""
    return f"""{ALIGNED_SQL},
g0 AS (SELECT * EXCLUDE (unit, cdr3, seq, germline, productive, n), {unit} AS unit, cdr3 AS cdr3_0, seq AS s0, germline AS g0, upper(productive) IN ('T', 'TRUE') AS ok, substr(md5(sequence_id), 1, 1) AS mark,
  length(fwr1 || cdr1 || fwr2 || cdr2) + 10 AS p3, length(fwr1 || cdr1) + 10 AS p2, length(fwr1 || cdr1 || fwr2 || cdr2 || fwr3) AS v_len FROM (SELECT NULL AS unit, * FROM aligned WHERE whole AND {_WHOLE} AND {where})),
g1 AS (SELECT *, CASE WHEN mark IN ('0', '1') THEN 'fr3' WHEN mark = '2' THEN 'fr2' WHEN mark = '3' AND length(cdr3_0) >= 12 THEN 'cdr3' END AS gap, v_len + 4 AS pc FROM g0),
tidyg AS (SELECT * EXCLUDE (cdr3_0), CASE WHEN gap = 'cdr3' THEN substr(cdr3_0, 1, 4) || substr(cdr3_0, 8) ELSE cdr3_0 END AS cdr3, CASE WHEN gap = 'cdr3' THEN substr(s0, 1, pc) || substr(s0, pc + 4) ELSE s0 END AS sq, CASE WHEN gap = 'cdr3' THEN substr(g0, 1, pc) || substr(g0, pc + 4) ELSE g0 END AS gm,
  CASE gap WHEN 'fr3' THEN p3 || '_' || substr(g0, p3, 4) || '_' || substr(s0, p3, 1) WHEN 'fr2' THEN p2 || '_' || substr(g0, p2, 1) || '_' || substr(s0, p2, 1) || 'CAT' WHEN 'cdr3' THEN pc || '_' || substr(g0, pc, 4) || '_' || substr(s0, pc, 1) END AS indel,
  CASE gap WHEN 'fr3' THEN substr(s0, 1, p3) || substr(s0, p3 + 4) WHEN 'fr2' THEN substr(s0, 1, p2) || 'CAT' || substr(s0, p2 + 1) WHEN 'cdr3' THEN substr(s0, 1, pc) || substr(s0, pc + 4) ELSE s0 END AS raw FROM g1),
arched AS (SELECT *, array_to_string([length(fwr1), length(cdr1), length(fwr2), length(cdr2), length(fwr3), length(cdr3), length(sq) - v_len - length(cdr3)], '-') AS arch FROM tidyg)"""


def _annotate_sql(bulk: bool, where: str, unit: str = "sample", aa: bool = False, dna: bool = False, ags: bool = False) -> str:
    key = "cdr3aa" if aa else "cdr3"
    reads = """counted AS (SELECT *, bool_and(TRY_CAST(string_split(sequence_id, '=')[2] AS BIGINT) IS NOT NULL) OVER (PARTITION BY unit) AS every FROM arched),
picked AS (SELECT * FROM (SELECT *, CAST(sum(CASE WHEN every THEN TRY_CAST(string_split(sequence_id, '=')[2] AS BIGINT) ELSE 1 END) OVER (PARTITION BY unit, sq, indel) AS BIGINT) AS r, row_number() OVER (PARTITION BY unit, sq, indel ORDER BY sequence_id) AS k_ FROM counted) WHERE k_ = 1 AND r >= 2)"""
    clusters = f"""calls AS (SELECT DISTINCT unit, {GENES_SQL} AS gs FROM picked WHERE v_call IS NOT NULL), e AS (SELECT DISTINCT unit, gs[1] AS a, unnest(gs) AS b FROM calls),
both_ways AS (SELECT unit, a, b FROM e UNION SELECT unit, b, a FROM e), greach AS (SELECT unit, a, b FROM both_ways UNION SELECT r.unit, r.a, w.b FROM greach r JOIN both_ways w ON r.unit = w.unit AND r.b = w.a),
vmap AS (SELECT unit, a, string_agg(DISTINCT b, ',' ORDER BY b) AS vc FROM greach GROUP BY 1, 2),
v0 AS (SELECT p.*, coalesce(vc, 'NA') AS vc, substr(sq, v_len - 2, length(cdr3) + 6) AS j, {CODONS_SQL} AS codons FROM picked p LEFT JOIN vmap ON vmap.unit = p.unit AND vmap.a = ({GENES_SQL})[1]),
v1 AS (SELECT *, {aa_sql('j')} AS jaa FROM v0), v2 AS (SELECT *, CASE WHEN length(jaa) > 2 THEN substr(jaa, 2, length(jaa) - 2) ELSE '' END AS cdr3aa FROM v1),
v3 AS (SELECT * FROM v2 WHERE length({key}) > 0),
modal AS (SELECT unit, vc, {key} AS c, length(sq) AS len, row_number() OVER (PARTITION BY unit, vc, {key} ORDER BY count(*) DESC, length(sq)) AS k FROM v3 GROUP BY 1, 2, 3, 4),
v4 AS (SELECT v3.*, concat_ws('_', v3.vc, length({key}), v_len) AS pre FROM v3 JOIN modal m ON m.unit IS NOT DISTINCT FROM v3.unit AND m.vc IS NOT DISTINCT FROM v3.vc AND m.c = v3.{key} AND m.len = length(sq) AND m.k = 1),
d AS (SELECT unit, pre, {key} AS c, min(sequence_id) AS f FROM v4 GROUP BY 1, 2, 3),
de AS (SELECT a.unit, a.pre, a.c AS x, b.c AS y, b.f AS yf FROM d a JOIN d b ON a.unit = b.unit AND a.pre = b.pre AND length(a.c) = length(b.c) WHERE round(hamming(a.c, b.c) / length(a.c), 6) <= {MAX_DIFF}),
reach AS (SELECT unit, pre, x, y, yf FROM de UNION SELECT r.unit, r.pre, r.x, de.y, de.yf FROM reach r JOIN de ON r.unit = de.unit AND r.pre = de.pre AND r.y = de.x),
comp AS (SELECT unit, pre, x, min(yf || chr(1) || y) AS c FROM reach GROUP BY 1, 2, 3),
v5 AS (SELECT v4.*, concat_ws('_C', v4.pre, k) AS clt, concat_ws('_', vc, cdr3aa) AS cvk, concat_ws('_', sq, coalesce(indel, 'NA')) AS subk, upper(substr(vc, 1, 3)) AS loc FROM v4 JOIN (SELECT unit, pre, x, dense_rank() OVER (PARTITION BY unit, pre ORDER BY c) AS k FROM comp) q ON q.unit = v4.unit AND q.pre = v4.pre AND q.x = v4.{key})"""
    if bulk:
        ids = """b1 AS (SELECT *, sum(r) OVER (PARTITION BY unit, clt) AS rc, sum(r) OVER (PARTITION BY unit, clt, cvk) AS rv, sum(r) OVER (PARTITION BY unit) AS rt FROM v5),
b2 AS (SELECT *, loc || '.C' || dense_rank() OVER (PARTITION BY unit ORDER BY rc DESC, clt) AS cid, dense_rank() OVER (PARTITION BY unit, clt ORDER BY rv DESC, cvk) AS vk FROM b1),
done AS (SELECT *, cid || '.CV' || vk AS cv, cid || '.CV' || vk || '.S' || row_number() OVER (PARTITION BY unit, clt, vk ORDER BY r DESC, sequence_id) AS sub, cid || '.' || row_number() OVER (PARTITION BY unit, cid ORDER BY r DESC, sequence_id) AS sub_clt FROM b2)"""
    else:
        rank = lambda n, scope, key: f"dense_rank() OVER (PARTITION BY {scope} ORDER BY {n} DESC, {key})"
        ids = f"""c1 AS (SELECT *, split_part(sequence_id, '_', 1) || '_' || sample AS barcode, count(*) OVER (PARTITION BY unit, loc, clt) AS nc, count(*) OVER (PARTITION BY unit, loc, clt, cvk) AS nv, count(*) OVER (PARTITION BY unit, loc, clt, cvk, subk) AS ns FROM v5),
c2 AS (SELECT *, loc || '.C' || {rank('nc', 'unit, loc', 'clt')} AS cid, {rank('nv', 'unit, loc, clt', 'cvk')} AS vk, {rank('ns', 'unit, loc, clt, cvk', 'subk')} AS sk FROM c1),
ids AS (SELECT *, cid || '.CV' || vk AS cv, cid || '.CV' || vk || '.S' || sk AS sub FROM c2),
{one_per_chain('ids')}, {CLASSES}, {RESOLVED}, {RELABELLED},
c3 AS (SELECT * EXCLUDE (nv, ns, vk, sk, cv, sub), count(*) OVER (PARTITION BY unit, cid, cvk) AS nv, count(*) OVER (PARTITION BY unit, cid, cvk, subk) AS ns FROM relabelled),
c4 AS (SELECT *, cid || '.CV' || {rank('nv', 'unit, cid', 'cvk')} AS cv, cid || '.CV' || {rank('nv', 'unit, cid', 'cvk')} || '.S' || {rank('ns', 'unit, cid, cvk', 'subk')} AS sub FROM c3),
merged AS (SELECT unit, barcode, string_agg(cid, '-' ORDER BY cid) AS m, string_agg(cv, '-' ORDER BY cv) AS mv, string_agg(sub, '-' ORDER BY sub) AS ms FROM c4 GROUP BY 1, 2),
c5 AS (SELECT c4.* EXCLUDE (nc, nv, ns), m, mv, ms FROM c4 JOIN merged ON merged.unit = c4.unit AND merged.barcode = c4.barcode), {numbered('c5', 'done')}"""
    immuno = f"""mlen AS (SELECT unit, cid, length(cdr3aa) AS len, row_number() OVER (PARTITION BY unit, cid ORDER BY count(*) DESC, length(cdr3aa)) AS k FROM done WHERE ok AND length(cdr3aa) > 0 GROUP BY 1, 2, 3),
letters AS (SELECT d.unit, d.cid, p, substr(cdr3aa, CAST(p AS INT), 1) AS c, count(*) AS n FROM done d JOIN mlen ON d.unit = mlen.unit AND d.cid = mlen.cid AND length(cdr3aa) = len AND mlen.k = 1 AND ok, LATERAL (SELECT unnest(range(1, length(cdr3aa) + 1)) AS p) GROUP BY 1, 2, 3, 4),
places AS (SELECT unit, cid, p, string_agg(c, '' ORDER BY c) AS cs FROM (SELECT *, max(n) OVER (PARTITION BY unit, cid, p) AS best FROM letters) WHERE n = best GROUP BY 1, 2, 3),
cons AS (SELECT unit, cid, string_agg(CASE WHEN length(cs) > 1 THEN '[' || cs || ']' ELSE cs END, '' ORDER BY p) AS consensus, list(cs ORDER BY p) AS tokens FROM places GROUP BY 1, 2),
filled AS (SELECT unit, cid, sequence_id, sq, length({key}) AS cl, array_to_string(list_transform(range(1, length(gm) + 1), lambda i: CASE WHEN substr(gm, i, 1) = 'N' THEN substr(sq, i, 1) ELSE substr(gm, i, 1) END), '') AS f, length(gm) - length(replace(gm, 'N', '')) AS nn FROM done),
glen AS (SELECT unit, cid, cl, row_number() OVER (PARTITION BY unit, cid ORDER BY count(*) DESC, cl) AS k FROM filled GROUP BY 1, 2, 3),
germ_of AS (SELECT unit, cid, f AS cg FROM (SELECT filled.*, row_number() OVER (PARTITION BY filled.unit, filled.cid ORDER BY (length(sq) - nn - hamming(f, sq)) / (length(sq) - nn) DESC, nn, sequence_id) AS i FROM filled JOIN glen ON glen.unit = filled.unit AND glen.cid = filled.cid AND glen.cl = filled.cl AND glen.k = 1) WHERE i = 1),
spelled AS (SELECT unit, cid, tokens, 0 AS i, '' AS s FROM cons UNION ALL SELECT unit, cid, tokens, i + 1, s || unnest(string_split(tokens[i + 1], '')) FROM spelled WHERE i < len(tokens)),
f0 AS (SELECT d.*, {'CASE WHEN ok OR bool_or(ok) OVER (PARTITION BY d.unit, d.cid, sq, indel) THEN consensus END' if dna else 'consensus'} AS consensus, cg, {GENES_SQL} AS genes, {aa_sql('sq')} AS sa, {aa_sql('cg')} AS ca, {aa_sql('gm')} AS q FROM done d LEFT JOIN cons ON cons.unit = d.unit AND cons.cid = d.cid LEFT JOIN germ_of ON germ_of.unit = d.unit AND germ_of.cid = d.cid),
f1 AS (SELECT *, coalesce(ok, false) AND coalesce(len(genes), 0) > 0 AND len(list_filter(genes, lambda g: NOT contains(g, 'IGH'))) = 0 AS heavy FROM f0),
f2 AS (SELECT *, CASE WHEN NOT heavy OR coalesce(jaa, '') = '' THEN 'NA' {rules_sql('cdr3aa', 'genes')} ELSE 'Unassigned' END AS subset, list_transform(list_filter(range(1, length(sa) - 1), lambda i: regexp_matches(substr(sa, i, 3), '^N[^P][TS]$') AND substr(sa, i, 3) <> substr(q, i, 3)), lambda i: substr(sa, i, 3) || ':' || CASE WHEN i + 2 <= length(fwr1) // 3 THEN 'FR1' WHEN i <= length(fwr1) // 3 + length(cdr1) // 3 THEN 'CDR1'
  WHEN i + 2 <= length(fwr1) // 3 + length(cdr1) // 3 + length(fwr2) // 3 THEN 'FR2' WHEN i <= length(fwr1) // 3 + length(cdr1) // 3 + length(fwr2) // 3 + length(cdr2) // 3 THEN 'CDR2' WHEN i + 2 <= length(fwr1) // 3 + length(cdr1) // 3 + length(fwr2) // 3 + length(cdr2) // 3 + length(fwr3) // 3 THEN 'FR3'
  WHEN i <= length(fwr1) // 3 + length(cdr1) // 3 + length(fwr2) // 3 + length(cdr2) // 3 + length(fwr3) // 3 + length(cdr3) // 3 THEN 'CDR3' ELSE 'FR4' END) AS sites FROM f1),
labelled AS (SELECT f2.unit, f2.sequence_id, f2.sample, string_agg(DISTINCT CASE WHEN NOT heavy THEN 'NA' {rules_sql('x.s', 'genes')} ELSE 'Unassigned' END, ',') AS labs FROM f2 JOIN (SELECT unit, cid, s FROM spelled WHERE i = len(tokens)) x ON x.unit = f2.unit AND x.cid = f2.cid WHERE consensus IS NOT NULL GROUP BY 1, 2, 3),
f3 AS (SELECT f2.*, array_to_string(list_sort(string_split(labs, ',')), ',') AS clt_subset, {VDJ_SQL} || CASE WHEN upper(replace(string_split(string_split(replace(v_call, '/', '-'), '/')[1], '*')[1], ' ', '')) = 'IGLV3-21' AND ends_with(sq, 'C') THEN '[R110]' ELSE '' END
  {"|| CASE WHEN ok AND len(sites) > 0 AND len(list_filter(genes, lambda g: NOT contains(g, 'IGH'))) = 0 THEN '[' || CASE WHEN contains(array_to_string(sites, ';'), ':CDR') THEN 'CDR-AGS' ELSE 'FR-AGS' END || ' (' || array_to_string(sites, ';') || ')]' ELSE '' END" if ags else ''} AS vdj FROM f2 LEFT JOIN labelled l ON l.unit = f2.unit AND l.sequence_id = f2.sequence_id AND l.sample = f2.sample)"""
    cols = f"""sequence_id AS contig_id, s0 AS Raw_sequence, raw AS Raw_VDJ_sequence, sq AS VDJ_sequence, gm AS IgBlast_Germline_alignment, sq AS VDJ_sequence_correctedCDR3, sa AS VDJ_sequence_correctedCDR3_aa, cg AS Consensus_Germline, ca AS Consensus_Germline_aa, vdj AS VDJ_genes, nullif(c_call, '') AS C_gene,
CASE WHEN ok THEN 'productive' ELSE 'unproductive' END AS Functionality, jaa AS Junction_aa, CAST(length(jaa) AS INT) AS Junction_length, round((v_len - hamming(substr(sq, 1, v_len), substr(cg, 1, v_len))) * 100.0 / v_len, 9) AS V_identity, arch AS VDJ_positions, CAST(v_len AS INT) AS V_length, indel AS InDels, subset AS CLL_Stereotype_Subsets,
cid AS ClonotypeID, consensus AS Clonotype_Consensus_CDR3aa, clt_subset AS Clonotype_CLL_Stereotype_Subsets, cv AS ClonotypeVariantID, sub AS SubcloneID, sample AS SampleID"""
    if bulk:
        cols += """, CAST(rc AS BIGINT) AS Clonotype_nReads, round(rc * 100.0 / rt, 9) AS Clonotype_freq, CAST(rv AS BIGINT) AS ClonotypeVariant_nReads, round(rv * 100.0 / rc, 9) AS ClonotypeVariant_freq, r AS Subclone_nReads, round(r * 100.0 / rv, 9) AS Subclone_freq_in_ClonotypeVariant, sub_clt AS SubcloneID_in_Clonotype, round(r * 100.0 / rc, 9) AS Subclone_freq_in_Clonotype"""
        cells = ""
    else:
        join = lambda c, sep, name: f"string_agg(coalesce({c}, 'NA'), '{sep}' ORDER BY sub) AS {name}"
        names = [("raw", "_", "igRaw_VDJ_sequence"), ("sq", "_", "igVDJ_sequence"), ("sa", "_", "igVDJ_sequence_aa"), ("cg", "_", "igClonotype_Consensus_Germline"), ("ca", "_", "igClonotype_Consensus_Germline_aa"), ("arch", "_", "igVDJ_positions"), ("indel", "-", "igInDels"), ("consensus", "_", "igClonotype_Consensus_CDR3aa"), ("subset", "_", "igCLL_Stereotype_Subsets")]
        cells = f", per_cell AS (SELECT unit AS u_, barcode AS b_, {', '.join(join(*n) for n in names)} FROM f3 WHERE sub IS NOT NULL GROUP BY 1, 2)"
        held = lambda c, name: f"CASE WHEN completeBCR <> 'Not_supported' THEN {c} END AS {name}"
        cols += f", barcode, completeBCR, ig AS igClonotypeID_num, igcv AS igClonotypeVariantID_num, igsub AS igSubcloneID_in_ClonotypeVariant_num, igin AS igSubcloneID_in_Clonotype_num, {held('m', 'igClonotypeID')}, {held('mv', 'igClonotypeVariantID')}, {held('ms', 'igSubcloneID')}, " + ", ".join(held(n, n) for _, _, n in names)
    last = "f3" if bulk else "f3 LEFT JOIN per_cell ON u_ = unit AND b_ = barcode"
    return f"WITH RECURSIVE {_gapped_sql(where, unit)}, {reads if bulk else 'picked AS (SELECT * FROM arched)'}, {clusters}, {ids}, {immuno}{cells} SELECT {cols} FROM {last}"


_CASE = "(SELECT arg_min(CaseID, (registered_at, CaseID)) FROM sample_sheet s WHERE s.SampleID = sample)"
_OK = "upper(productive) IN ('T', 'TRUE')"
ORACLE = {
    "gap_events": f"WITH {_gapped_sql(_OK)} SELECT sample, sequence_id, sq AS VDJseq, gm AS germline_alignment, arch, indel FROM arched",
    "annotate_bulk_e2e": _annotate_sql(True, f"n_reads IS NOT NULL AND {_OK}", ags=True),
    "annotate_sc_e2e": _annotate_sql(False, f"n_reads IS NULL AND {_OK}"),
    "annotate_sc_joint": _annotate_sql(False, f"n_reads IS NULL AND {_OK} AND {_CASE} IS NOT NULL", unit=_CASE),
    "annotate_bulk_dna": _annotate_sql(True, "n_reads IS NOT NULL", dna=True, ags=True),
    "annotate_sc_dna": _annotate_sql(False, "n_reads IS NULL", dna=True),
    "annotate_bulk_aa": _annotate_sql(True, f"n_reads IS NOT NULL AND {_OK}", aa=True, ags=True),
}
