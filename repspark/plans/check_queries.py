"""Queries of single steps that the larger ones go through: near pairs by indels, linkage held against its definition, CDR3 length, cells joined, group keys of several columns, side tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repspark.functions.missing import present
from repspark.functions.sequences import sorted_join
from repspark.kernels.linkage import distances, encode
from repspark.operators import contamination, recalc
from repspark.operators.clonotypes import cdr3_clusters, distance_histogram, near_clonotypes, nearest_distances
from repspark.operators.immunogenetics import correct_cdr3_length, possible_cdr3
from repspark.operators.tidy import tidy
from repspark.plans.after_queries import NUMBERED_SQL, SHOWN, numbered_contigs, recalc_sql
from repspark.plans.base import CONTIGS_SQL, aligned, latest_contigs
from repspark.plans.domain_queries import CELLTABLE_SQL, CONTAM_CELLS_SQL, KEYED_SQL, ORACLE as DOMAIN_SQL
from repspark.plans.domain_queries import cell_table, consensus_cdr3_query, keyed, sample_cases, single_cell
from repspark.plans.sequence_queries import TIDY_SQL
from repspark.plans.workflow import combine, remove_contaminated_cells
from repspark.runtime import map_groups, scratch, written
from repspark.sources.germline import read_germline, read_j_frames

MAX_DIFF, NEAR = 0.2, 0.1


def indel_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct CDR3 of a V gene whose lengths differ and that are near but for one gap; a quarter of them also stand without three bases."""
    own = keyed(spark, sf_dir).select("unit", "v_cluster", "cdr3")
    cut = own.where(F.substring(F.md5("cdr3"), 1, 1).isin("0", "1", "2", "3") & (F.length("cdr3") >= 36)).withColumn("cdr3", F.concat(F.substring("cdr3", 1, 13), F.substring("cdr3", 17, 10_000)))
    seqs = own.unionByName(cut).distinct().withColumn("Clonotype", F.col("cdr3"))
    return near_clonotypes(written(seqs, "cdr3"), ["unit", "v_cluster"], "cdr3", NEAR)


def _linkage_holds(mode: str):
    """(unit, v_cluster, len, n_cdr3, joined, apart): whether all of a cluster belong together, and no two clusters could still be joined."""
    keys = ["unit", "v_cluster", "len"]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        got = cdr3_clusters(keyed(spark, sf_dir), keys, "cdr3", MAX_DIFF, mode)

        def hold(g: dict[str, list]) -> list[tuple]:
            groups: dict[int, list[str]] = {}
            for s, c in zip(g["cdr3"], g["cluster"]):
                groups.setdefault(c, []).append(s)
            codes = [encode(v) for v in groups.values()]
            far = (lambda d: d.max()) if mode == "complete" else (lambda d: d.mean())
            joined = mode == "average" or all(round(float(distances(x, x).max()), 6) <= MAX_DIFF for x in codes)
            apart = all(round(float(far(distances(x, y).astype("float64"))), 6) > MAX_DIFF for i, x in enumerate(codes) for y in codes[i + 1 :])
            return [(*[g[k][0] for k in keys], len(g["cdr3"]), bool(joined), bool(apart))]

        return map_groups(got, keys, hold, "unit string, v_cluster string, len int, n_cdr3 bigint, joined boolean, apart boolean")

    return run


def cdr3_length_corrected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences three bases shorter or longer than their clonotype's consensus germline, brought to it."""
    df = tidy(aligned(spark, sf_dir)).where(F.length("cdr3") >= 12)
    s, at = F.col("VDJseq"), F.col("len_no_CDR3") + 4
    short = F.concat(F.substring(s, F.lit(1), at), F.substring(s, at + 4, F.lit(10_000)))
    rows = df.select("sample", "sequence_id", F.explode(F.array(F.struct(F.lit("lacks").alias("kind"), short.alias("own"), s.alias("consensus")), F.struct(F.lit("more").alias("kind"), s.alias("own"), short.alias("consensus")))).alias("x")).select("sample", "sequence_id", "x.*")
    got = correct_cdr3_length(rows.withColumn("germline", F.col("own")), "own", "germline", "consensus", F.length("own") != F.length("consensus"))
    return got.select("sample", "sequence_id", "kind", "VDJseq_correctedCDR3", F.size(F.split("indel_CDR3", ",")).alias("n_events"))


def consensus_expanded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every CDR3 that the consensus of a clonotype stands for, of those with at most three tied places."""
    few = consensus_cdr3_query(spark, sf_dir).where(F.size(F.split("consensus", r"\[")) <= 4)
    return few.select("sample", "Clonotype", F.explode(possible_cdr3("consensus")).alias("cdr3"))


def cutoff_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The histogram of nearest distances that the automatic cutoff is taken from."""
    return distance_histogram(nearest_distances(keyed(spark, sf_dir), ["unit", "v_cluster", "len"], "cdr3"))


def tag_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = cell_table(spark, sf_dir).withColumn("Sample_Tag", present("Sample_Tag")).withColumn("c", F.concat_ws("|", "SampleID", "clone"))
    return contamination.tag_table(df, "c", ["Multiplet", "Undetermined"])


def combined_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cell registry with the fields and chain slots of its contigs; cells without contigs stay."""
    contigs = numbered_contigs(spark, sf_dir)
    cells = cell_table_all(spark, sf_dir)
    got = combine(cells, contigs)
    return got.select("SampleID", "barcode", "kind", "completeBCR", "igClonotypeID", "igClonotypeID_num", "igSubcloneID_in_Clonotype_num", "igSubcloneID_all", "IGH1_ClonotypeID", "IGH2_ClonotypeID", "IGL1_SubcloneID", "IGL2_SubcloneID")


def cell_table_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    from repspark.runtime import table

    c = table(spark, sf_dir, "cells").select(present("SampleID").alias("SampleID"), "barcode", F.col("completeBCR")).where(F.col("SampleID").isNotNull() & F.col("barcode").isNotNull())
    return c.groupBy("SampleID", "barcode").agg(F.max("completeBCR").alias("kind")).withColumn("completeBCR", F.lit("old"))


def recalc_by_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chain ids anew within case and batch together."""
    df = written(single_cell(spark, sf_dir).join(sample_cases(spark, sf_dir), "SampleID"), "contigs")
    return recalc.recalculate_cells(df, ["CaseID", "BatchID"]).select("record_id", "ClonotypeID", "ClonotypeVariantID", "SubcloneID")


def contam_cells_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contigs of the cells free of contamination, all ids anew."""
    flagged = contamination.flag_cells(written(cell_table(spark, sf_dir), "cells"), ["seq"], "subclone", "clone", "SampleID", case="CaseID", cutoff=2.0)
    return remove_contaminated_cells(numbered_contigs(spark, sf_dir), flagged).select(*SHOWN)


def source_germline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Germline genes of a FASTA with annotated headers, with the frame and CDR3 end of a J gene table."""
    genes = latest_contigs(spark, sf_dir, ["j_call", "junction"]).where(F.col("j_call").startswith("IG")).groupBy(F.col("j_call").alias("gene")).agg(F.max("junction").alias("s")).where("s is not null and gene not like '% %' and gene not like '%|%'")
    fasta, aux = scratch(spark, "germline"), scratch(spark, "frames")
    gapped = F.concat(F.substring("s", 1, 5), F.lit("..."), F.substring(F.col("s"), F.lit(6), F.lit(10_000)))
    genes.select(F.concat(F.lit(">X1|"), "gene", F.lit("|Homo sapiens|F|\n"), F.lower(gapped))).write.text(fasta)
    frames = genes.select(F.concat(F.lit("# gene, frame, kind, end of the CDR3, more\n"), F.col("gene"), F.lit("\t"), (F.length("s") % 3).cast("string"), F.lit("\t"), F.substring("gene", 3, 2), F.lit("  "), F.length("s").cast("string"), F.lit("\t1")))
    frames.write.text(aux)
    return read_germline(spark, fasta).join(read_j_frames(spark, aux), "gene").select("gene", "sequence", "frame", "kind", "cdr3_end", "extra")


QUERIES = {
    "indel_pairs": indel_pairs, "average_linkage_holds": _linkage_holds("average"), "complete_linkage_holds": _linkage_holds("complete"), "cdr3_length_corrected": cdr3_length_corrected, "consensus_expanded": consensus_expanded, "cutoff_histogram": cutoff_histogram,
    "tag_counts": tag_counts, "combined_cells": combined_cells, "recalc_by_case": recalc_by_case, "contam_cells_removed": contam_cells_removed, "source_germline": source_germline,
}

_HOLDS = f"WITH {KEYED_SQL} SELECT unit, v_cluster, CAST(len AS INT) AS len, count(DISTINCT cdr3) AS n_cdr3, true AS joined, true AS apart FROM keyed GROUP BY 1, 2, 3"
_WIDE = ", ".join(f"max({c}) FILTER (slot = '{s}') AS {s}_{c}" for s in ("IGH1", "IGH2", "IGL1", "IGL2") for c in ("cid", "sub"))
ORACLE = {
    "indel_pairs": f"""WITH {KEYED_SQL}, both_kinds AS (SELECT unit, v_cluster, cdr3 FROM keyed UNION SELECT unit, v_cluster, substr(cdr3, 1, 13) || substr(cdr3, 17) FROM keyed WHERE substr(md5(cdr3), 1, 1) IN ('0', '1', '2', '3') AND length(cdr3) >= 36),
p AS (SELECT a.unit, a.v_cluster, a.cdr3 AS x, b.cdr3 AS y, length(a.cdr3) AS n, length(b.cdr3) AS m FROM both_kinds a JOIN both_kinds b ON a.unit = b.unit AND a.v_cluster = b.v_cluster AND length(a.cdr3) > length(b.cdr3) AND length(b.cdr3) - 10 - 4 * (length(a.cdr3) - length(b.cdr3)) > 0),
q AS (SELECT *, list_min(list_transform(range(0, m + 1), lambda k: CASE WHEN k = 0 THEN 0 ELSE hamming(substr(x, 1, CAST(k AS INT)), substr(y, 1, CAST(k AS INT))) END + CASE WHEN k = m THEN 0 ELSE hamming(substr(x, CAST(k + n - m + 1 AS INT)), substr(y, CAST(k + 1 AS INT))) END)) AS one FROM p)
SELECT DISTINCT unit, v_cluster, least(x, y) AS a, greatest(x, y) AS b FROM q WHERE (one + 1) / n <= {NEAR} + 1e-9 AND m - 2 * one - 10 - 4 * (n - m) > 0""",
    "average_linkage_holds": _HOLDS, "complete_linkage_holds": _HOLDS,
    "cdr3_length_corrected": f"WITH {TIDY_SQL}, t AS (SELECT sample, sequence_id, seq AS s, substr(seq, 1, v_len + 4) || substr(seq, v_len + 8) AS short FROM tidy WHERE length(cdr3) >= 12) SELECT sample, sequence_id, 'lacks' AS kind, s AS VDJseq_correctedCDR3, 1 AS n_events FROM t UNION ALL SELECT sample, sequence_id, 'more', short, 1 FROM t",
    "consensus_expanded": f"""WITH RECURSIVE c AS ({DOMAIN_SQL['consensus_cdr3']}), k AS (SELECT *, regexp_extract_all(consensus, '\\[[^\\]]*\\]|.') AS tokens FROM c WHERE len(string_split(consensus, '[')) <= 4),
s AS (SELECT sample, Clonotype, tokens, 0 AS i, '' AS cdr3 FROM k UNION ALL SELECT sample, Clonotype, tokens, i + 1, cdr3 || unnest(string_split(regexp_replace(tokens[i + 1], '[\\[\\]]', '', 'g'), '')) FROM s WHERE i < len(tokens)) SELECT sample, Clonotype, cdr3 FROM s WHERE i = len(tokens)""",
    "cutoff_histogram": f"SELECT CAST(round(distance * 1000) AS INT) AS cell, count(*) AS n FROM ({DOMAIN_SQL['nn_distance']}) WHERE distance IS NOT NULL GROUP BY 1",
    "tag_counts": f"WITH {CELLTABLE_SQL} SELECT concat_ws('|', SampleID, clone) AS c, count(*) FILTER (Sample_Tag = 'Multiplet') AS Multiplet, count(*) FILTER (Sample_Tag = 'Undetermined') AS Undetermined FROM ct GROUP BY 1",
    "combined_cells": f"""WITH RECURSIVE {NUMBERED_SQL}, t1 AS (SELECT *, CASE WHEN substr(cid, 1, 3) = 'IGH' THEN 'IGH' WHEN substr(cid, 1, 3) IN ('IGK', 'IGL') THEN 'IGL' END AS kind FROM nc), t2 AS (SELECT *, kind || row_number() OVER (PARTITION BY unit, barcode, kind ORDER BY cid) AS slot FROM t1),
own AS (SELECT unit, barcode, max(completeBCR) AS completeBCR, max(m) AS m, max(n1) AS n1, max(n4) AS n4, string_agg(sub, '-' ORDER BY sub) AS subs, {_WIDE} FROM t2 GROUP BY 1, 2),
reg AS (SELECT SampleID, barcode, max(completeBCR) AS kind FROM cells WHERE SampleID NOT IN ('', 'NA') AND barcode IS NOT NULL GROUP BY 1, 2)
SELECT SampleID, reg.barcode, reg.kind, own.completeBCR, m AS igClonotypeID, n1 AS igClonotypeID_num, n4 AS igSubcloneID_in_Clonotype_num, subs AS igSubcloneID_all, IGH1_cid AS IGH1_ClonotypeID, IGH2_cid AS IGH2_ClonotypeID, IGL1_sub AS IGL1_SubcloneID, IGL2_sub AS IGL2_SubcloneID FROM reg LEFT JOIN own ON own.unit = reg.SampleID AND own.barcode = reg.barcode""",
    "recalc_by_case": DOMAIN_SQL["recalc_cells"].replace("FROM sc)", "FROM sc JOIN cases USING (SampleID))").replace("PARTITION BY SampleID", "PARTITION BY CaseID, BatchID"),
    "contam_cells_removed": f"WITH RECURSIVE {NUMBERED_SQL}, {CONTAM_CELLS_SQL}, good AS (SELECT SampleID, barcode FROM y WHERE NOT coalesce(share >= 80, false) AND raw IS NULL), left_rows AS (SELECT nc.* FROM nc JOIN good ON good.SampleID = nc.unit AND good.barcode = nc.barcode), {recalc_sql('left_rows')} SELECT * EXCLUDE (old) FROM again",
    "source_germline": f"WITH {CONTIGS_SQL}, g AS (SELECT j_call AS gene, max(junction) AS s FROM contigs WHERE j_call LIKE 'IG%' AND j_call NOT LIKE '% %' AND j_call NOT LIKE '%|%' GROUP BY 1) SELECT gene, upper(s) AS sequence, CAST(length(s) % 3 AS INT) AS frame, substr(gene, 3, 2) AS kind, CAST(length(s) AS INT) AS cdr3_end, 1 AS extra FROM g WHERE s IS NOT NULL",
}
