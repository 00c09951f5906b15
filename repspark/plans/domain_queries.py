"""Queries of the domain operators: clonotypes, ids, cells, contamination, recalculation, rescue, export."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from repspark.functions.missing import present
from repspark.functions.sequences import barcode, cdr3_aa, locus, sorted_join, v_genes
from repspark.operators import cells as C
from repspark.operators import contamination, ids, recalc
from repspark.operators.airr import FIELDS, to_airr
from repspark.operators.clonotypes import cdr3_clusters, merge_indel_clonotypes, nearest_distances, v_cluster_map, with_clonotypes
from repspark.operators.immunogenetics import consensus_cdr3, consensus_germline
from repspark.operators.tidy import first_gene, tidy, unique_sequences
from repspark.operators.trees import abundances
from repspark.operators.wide import SLOTS, cells_long, cells_wide, with_unsupported
from repspark.plans.cell_sql import CLASSES, RELABELLED, RESOLVED, numbered, one_per_chain
from repspark.plans.base import ALIGNED_SQL, CONTIGS_SQL, GENES_SQL, aligned, latest_contigs
from repspark.plans.sequence_queries import CALL_SQL
from repspark.plans.sequence_queries import CODONS_SQL as _CODONS
from repspark.plans.sequence_queries import TIDY_SQL as _TIDY
from repspark.plans.sequence_queries import aa_sql as _aa
from repspark.runtime import table, written

MAX_DIFF = 0.2


def clonotype_freq_by_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contigs and percent of each clonotype in its sample: the flagship."""
    df = latest_contigs(spark, sf_dir, ["clonotypeID"]).where(F.col("clonotypeID").isNotNull())
    n = df.groupBy("sample", "clonotypeID").agg(F.count(F.lit(1)).alias("n"))
    total = n.groupBy("sample").agg(F.sum("n").alias("t"))
    return n.join(total, "sample").select("sample", "clonotypeID", "n", F.round(F.col("n") * 100.0 / F.col("t"), 9).alias("freq"))


def keyed(spark: SparkSession, sf_dir: str, columns: tuple[str, ...] = ("junction", "v_call")) -> DataFrame:
    """Contigs with unit, first gene as V cluster, CDR3 and its length."""
    df = latest_contigs(spark, sf_dir, list(columns)).where((F.length("junction") >= 9) & F.col("v_call").isNotNull()).withColumn("unit", F.col("sample")).withColumn("v_cluster", first_gene("v_call"))
    return df.withColumn("cdr3", F.col("junction")).withColumn("len", F.length("junction")).where(F.col("v_cluster").isNotNull())


def v_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v_cluster_map(latest_contigs(spark, sf_dir, ["v_call"]).withColumn("unit", F.col("sample")).where(F.col("v_call").isNotNull()))


def clonotypes_single_linkage(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = cdr3_clusters(keyed(spark, sf_dir), ["unit", "v_cluster", "len"], "cdr3", MAX_DIFF, "single")
    label = F.min("cdr3").over(Window.partitionBy("unit", "v_cluster", "len", "cluster"))
    return got.select("unit", "v_cluster", "cdr3", label.alias("label"))


def _linkage(mode: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return cdr3_clusters(keyed(spark, sf_dir), ["unit", "v_cluster", "len"], "cdr3", MAX_DIFF, mode)

    return run


def indel_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = with_clonotypes(keyed(spark, sf_dir).select("unit", "v_cluster", "cdr3", "sequence_id", F.lit(0).alias("len_no_CDR3")), mode="single")
    df = written(df.drop("sequence_id", "Pre_Clonotype"), "clusters")
    return merge_indel_clonotypes(df).select("unit", "Clonotype", "CorrectClt").distinct()


def nn_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_distances(keyed(spark, sf_dir), ["unit", "v_cluster", "len"], "cdr3").select("unit", "v_cluster", "cdr3", F.round("distance", 9).alias("distance"))


_USED = ["n_reads", "Clonotype", "junction", "junction_aa", "v_call"]


def _bulk(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = latest_contigs(spark, sf_dir, _USED).where(F.col("n_reads").isNotNull() & F.col("Clonotype").isNotNull() & F.col("junction").isNotNull() & F.col("v_call").isNotNull())
    df = df.select(F.col("sample").alias("unit"), "sequence_id", F.col("Clonotype").alias("CorrectClt"), first_gene("v_call").alias("v_cluster"), cdr3_aa("junction_aa").alias("cdr3_aa"), "junction", "n_reads").where(F.col("v_cluster").isNotNull() & F.col("cdr3_aa").isNotNull())
    return unique_sequences(df, ["unit"], ["junction"], 2)


def bulk_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ids.bulk_ids(_bulk(spark, sf_dir)).select("unit", "sequence_id", F.col("clonotypeID").alias("clt"), F.col("clonotypeVariantID_in_Cltp").alias("cv"), F.col("subcloneID_in_CV").alias("sub"), F.col("subcloneID_in_Clt").alias("sub_clt"))


def bulk_freqs(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = ids.bulk_frequencies(ids.bulk_ids(_bulk(spark, sf_dir)))
    r = lambda c: F.round(c, 9).alias(c)
    return df.select("unit", "sequence_id", "clonotypeID_nreads", r("clonotypeID_freq"), r("clonotypeVariant_freq"), r("subclone_freq_in_CV"), r("subclone_freq"))


def _cells_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = latest_contigs(spark, sf_dir, _USED).where(F.col("n_reads").isNull() & F.col("Clonotype").isNotNull() & F.col("junction").isNotNull() & F.col("v_call").isNotNull())
    df = df.select(F.col("sample").alias("unit"), "sequence_id", "Clonotype", first_gene("v_call").alias("v_cluster"), cdr3_aa("junction_aa").alias("cdr3_aa"), F.col("junction").alias("VDJseq"), F.lit(None).cast("string").alias("indel"), barcode("sequence_id", "sample").alias("barcode"))
    return ids.cell_ids(df.where(F.col("v_cluster").isNotNull() & F.col("cdr3_aa").isNotNull()), clonotype="Clonotype")


def sc_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cells_in(spark, sf_dir).select("unit", "sequence_id", F.col("clonotypeID").alias("clt"), F.col("clonotypeVariantID_in_Cltp").alias("cv"), F.col("Unique_SequenceID").alias("sub"))


def _chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.initial_class(C.merged_ids(C.drop_repeated_chains(_cells_in(spark, sf_dir))))


def cell_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chains(spark, sf_dir).select("unit", "barcode", "merge_clonotypeID", "merge_clonotypeVariantID", "merge_subcloneID", "completeBCR")


def complete_bcr_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.resolve_classes(_chains(spark, sf_dir)).select("unit", "barcode", "completeBCR", "igclonotypeID")


def chain_relabel(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = written(C.drop_repeated_chains(_cells_in(spark, sf_dir)), "chains")
    cell = C.resolve_classes(C.initial_class(C.merged_ids(rows))).select("unit", "barcode", "completeBCR", "igclonotypeID")
    return C.relabel_chains(rows.join(cell, ["unit", "barcode"], "left")).select("unit", "sequence_id", "clonotypeID")


def cell_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = C.numbered(written(C.resolve_classes(_chains(spark, sf_dir)), "cells"))
    return got.select("unit", "barcode", "igclonotypeID", "igclonotypeVariantID", "igsubcloneID_in_clonotypeVariant", "igsubcloneID_in_clonotype")


def chain_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = written(C.drop_repeated_chains(_cells_in(spark, sf_dir)), "chains")
    return C.chain_values(rows.join(C.initial_class(C.merged_ids(rows)).select("unit", "barcode", "completeBCR"), ["unit", "barcode"]), ["VDJseq", "cdr3_aa"])


def consensus_cdr3_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = latest_contigs(spark, sf_dir, ["Clonotype", "junction_aa"]).where(F.col("Clonotype").isNotNull()).withColumn("cdr3", cdr3_aa("junction_aa"))
    return consensus_cdr3(df, ["sample", "Clonotype"], "cdr3")


def consensus_germline_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = tidy(aligned(spark, sf_dir), extra=("Clonotype",))
    df = df.where(F.col("Clonotype").isNotNull())
    return consensus_germline(df, ["sample", "Clonotype"], "VDJseq", "germline_alignment", "junction", "sequence_id").drop("modal_cdr3")


# --- annotated contigs ---


_ROW = ["SampleID", "ClonotypeID", "ClonotypeVariantID", "SubcloneID", "VDJ_genes", "Junction_aa"]


def annotated(spark: SparkSession, sf_dir: str, columns: list[str]) -> DataFrame:
    """annotated_contigs with these columns, each record once, as it was loaded last (of equal times the greatest)."""
    df, rest = table(spark, sf_dir, "annotated_contigs"), columns
    out = df.groupBy("record_id").agg(F.max(F.struct("loaded_at", *[c for c in rest if c != "loaded_at"])).alias("r")).select("record_id", *[f"r.{c}" for c in rest])
    return out.withColumn("SampleID", present("SampleID")).where(F.col("SampleID").isNotNull() & F.col("ClonotypeID").isNotNull())


def bulk_annotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bulk rows as one per subclone, its reads the rows' clonotype reads, with case and batch of the sample's first registration."""
    df = annotated(spark, sf_dir, [*_ROW, "Clonotype_nReads"]).where(F.col("Clonotype_nReads").isNotNull() & F.col("SubcloneID").isNotNull() & F.col("ClonotypeVariantID").isNotNull())
    rows = df.groupBy("SampleID", "ClonotypeID", "ClonotypeVariantID", "SubcloneID").agg(F.min("VDJ_genes").alias("VDJ_genes"), F.min("Junction_aa").alias("Junction_aa"), F.sum("Clonotype_nReads").alias("Subclone_nReads"))
    cv = rows.groupBy("SampleID", "ClonotypeID", "ClonotypeVariantID").agg(F.sum("Subclone_nReads").alias("ClonotypeVariant_nReads"))
    clt = cv.groupBy("SampleID", "ClonotypeID").agg(F.sum("ClonotypeVariant_nReads").alias("_t"))
    cv = cv.join(clt, ["SampleID", "ClonotypeID"]).withColumn("ClonotypeVariant_freq", F.col("ClonotypeVariant_nReads") * 100.0 / F.col("_t")).drop("_t")
    return rows.join(cv, ["SampleID", "ClonotypeID", "ClonotypeVariantID"]).join(sample_cases(spark, sf_dir), "SampleID")


def sample_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "sample_sheet")
    return s.groupBy("SampleID").agg(F.min_by("CaseID", "registered_at").alias("CaseID"), F.min_by("BatchID", "registered_at").alias("BatchID"))


def contam_bulk(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = contamination.flag_bulk(written(bulk_annotated(spark, sf_dir), "bulk"), ["VDJ_genes", "Junction_aa"], case="CaseID")
    return got.select("SampleID", "SubcloneID", "Contamination_FLAG", "Contamination_raw", "Contamination_Sample")


def recalc_bulk(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = written(bulk_annotated(spark, sf_dir).withColumn("old", F.col("SubcloneID")), "bulk")
    got = recalc.recalculate_bulk(old)
    return got.select("SampleID", "old", "ClonotypeID", "ClonotypeVariantID", "SubcloneID", "SubcloneID_in_Clonotype", "Clonotype_nReads", F.round("Clonotype_freq", 9).alias("Clonotype_freq"))


def single_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = annotated(spark, sf_dir, [*_ROW, "barcode"]).where(present("barcode").isNotNull() & F.col("ClonotypeVariantID").isNotNull() & present("SubcloneID").isNotNull())
    return df


def recalc_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recalc.recalculate_cells(written(single_cell(spark, sf_dir), "contigs")).select("record_id", "ClonotypeID", "ClonotypeVariantID", "SubcloneID")


def cell_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid cells (first registration) with the merged ids of their contigs; a barcode's class and tag are those of the cell table."""
    c = table(spark, sf_dir, "cells").withColumn("SampleID", present("SampleID")).where(F.col("SampleID").isNotNull())
    first = c.groupBy("SampleID", "barcode").agg(F.min_by(F.struct("completeBCR", "Sample_Tag"), F.struct("registered_at", "record_id")).alias("r")).select("SampleID", "barcode", "r.*")
    rows = single_cell(spark, sf_dir).withColumn("seq", F.concat_ws("|", "VDJ_genes", "Junction_aa"))
    m = rows.groupBy("SampleID", "barcode").agg(sorted_join("ClonotypeID").alias("clone"), sorted_join("SubcloneID").alias("subclone"), sorted_join("seq").alias("seq"))
    return first.join(m, ["SampleID", "barcode"]).join(sample_cases(spark, sf_dir), "SampleID")


def contam_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = contamination.flag_cells(written(cell_table(spark, sf_dir), "cells"), ["seq"], "subclone", "clone", "SampleID", case="CaseID", cutoff=2.0)
    return got.select("SampleID", "barcode", "Contamination_FLAG", "Contamination_Sample")


def contam_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = contamination.flag_tags(written(cell_table(spark, sf_dir), "cells").withColumn("Sample_Tag", present("Sample_Tag")), "clone", group=["SampleID"], cutoff=1.5)
    return got.select("SampleID", "barcode", "SampleTag_FLAG", "SampleTag_Ratio")


def _rescue(column: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = written(cell_table(spark, sf_dir), "cells").withColumn("num", F.when(F.col("completeBCR") == "Yes", F.col("clone")))
        return recalc.rescue_single_chains(df, "SampleID", column, "num").select("SampleID", "barcode", "completeBCR", "num")

    return run


WIDE = ["ClonotypeID", "VDJ_genes", "Junction_aa"]


def cells_wide_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells_wide(_one_per_chain(spark, sf_dir), WIDE, ["SampleID", "barcode"])


def _one_per_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = single_cell(spark, sf_dir)
    return rows.groupBy("SampleID", "barcode", "ClonotypeID").agg(F.min_by(F.struct("VDJ_genes", "Junction_aa"), "record_id").alias("r")).select("SampleID", "barcode", "ClonotypeID", "r.*")


def cells_long_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells_long(cells_wide_query(spark, sf_dir), WIDE, ["SampleID", "barcode"])


def mb_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    all_cells = table(spark, sf_dir, "cells").select(present("SampleID").alias("SampleID"), "barcode").where(F.col("SampleID").isNotNull() & F.col("barcode").isNotNull())
    wide = cells_wide_query(spark, sf_dir).select("SampleID", "barcode", "n_contigs", "IGH1_ClonotypeID", "IGL1_ClonotypeID")
    return with_unsupported(wide, all_cells, ["SampleID", "barcode"]).withColumn("n_contigs", F.coalesce("n_contigs", F.lit(0).cast("bigint")))


def gctree_abundance(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = single_cell(spark, sf_dir).withColumn("clone", F.concat_ws("|", "SampleID", "ClonotypeID"))
    return abundances(df, "clone", "SubcloneID")


def gctree_idmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = single_cell(spark, sf_dir)
    return df.groupBy("SampleID", "ClonotypeID", "SubcloneID").agg(F.count(F.lit(1)).alias("abundance"), F.array_join(F.array_sort(F.collect_list("barcode")), ":").alias("members"))


def public_bulk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bulk rows under their public names."""
    df = tidy(aligned(spark, sf_dir).where(F.col("n_reads").isNotNull()), extra=("clonotypeID", "n_reads"))
    return df.select(
        F.col("sequence_id").alias("contig_id"), F.col("sequence").alias("Raw_sequence"), F.col("VDJ").alias("VDJ_genes"), F.col("productive").alias("Functionality"), F.col("VDJseq").alias("VDJ_sequence_correctedCDR3"), F.col("germline_alignment").alias("IgBlast_Germline_alignment"),
        F.col("junction_aa").alias("Junction_aa"), F.col("c_call").alias("C_gene"), F.array_join(F.col("arch").cast("array<string>"), "-").alias("VDJ_positions"), F.col("n_reads").alias("Subclone_nReads"), F.col("clonotypeID").alias("ClonotypeID"), F.col("sample").alias("SampleID"),
    )


def airr_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_airr(public_bulk(spark, sf_dir))


def public_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single-cell rows under their public names; a cell's merged id is that of its contigs' clonotypes."""
    df = tidy(aligned(spark, sf_dir).where(F.col("n_reads").isNull()), extra=("clonotypeID", "unit")).withColumn("barcode", barcode("sequence_id", "sample"))
    merged = df.groupBy("sample", "barcode").agg(sorted_join("clonotypeID").alias("igClonotypeID"))
    return df.join(merged, ["sample", "barcode"]).select(
        F.col("sequence_id").alias("contig_id"), F.col("sequence").alias("Raw_sequence"), F.col("VDJ").alias("VDJ_genes"), F.col("productive").alias("Functionality"), F.col("VDJseq").alias("VDJ_sequence_correctedCDR3"), F.col("germline_alignment").alias("Consensus_Germline"),
        F.col("junction_aa").alias("Junction_aa"), F.col("c_call").alias("C_gene"), F.array_join(F.col("arch").cast("array<string>"), "-").alias("VDJ_positions"), F.col("sample").alias("SampleID"), "igClonotypeID", "barcode", F.lit("Yes").alias("completeBCR"),
    )


def airr_export_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 51 fields of single cells, with the consensus germline and one metadata column."""
    return to_airr(public_cells(spark, sf_dir), germline="consensus", metadata=["completeBCR"])


QUERIES = {
    "clonotype_freq_by_sample": clonotype_freq_by_sample, "v_clusters": v_clusters, "clonotypes_single_linkage": clonotypes_single_linkage, "clonotypes_average": _linkage("average"), "clonotypes_complete": _linkage("complete"),
    "indel_merge": indel_merge, "nn_distance": nn_distance, "bulk_ids": bulk_ids, "bulk_freqs": bulk_freqs, "sc_ids": sc_ids, "cell_chains": cell_chains, "complete_bcr_resolved": complete_bcr_resolved, "chain_relabel": chain_relabel,
    "cell_numbers": cell_numbers, "chain_values": chain_values, "consensus_cdr3": consensus_cdr3_query, "consensus_germline": consensus_germline_query, "contam_bulk": contam_bulk, "contam_cells": contam_cells, "contam_tags": contam_tags,
    "recalc_bulk": recalc_bulk, "recalc_cells": recalc_cells, "rescue_strict": _rescue("subclone"), "rescue_relaxed": _rescue("clone"), "cells_wide": cells_wide_query, "cells_long": cells_long_query, "mb_cells": mb_cells,
    "gctree_abundance": gctree_abundance, "gctree_idmap": gctree_idmap, "airr_export": airr_export, "airr_export_cells": airr_export_cells,
}


KEYED_SQL = f"""{CONTIGS_SQL}, keyed AS (SELECT DISTINCT sample AS unit, {GENES_SQL}[1] AS v_cluster, junction AS cdr3, length(junction) AS len FROM contigs WHERE length(junction) >= 9 AND v_call IS NOT NULL AND {GENES_SQL}[1] IS NOT NULL)"""
_AA = "CASE WHEN length(junction_aa) > 2 THEN substr(junction_aa, 2, length(junction_aa) - 2) WHEN junction_aa IS NOT NULL THEN '' END"
_BULK = f"""{CONTIGS_SQL}, b AS (SELECT sample AS unit, sequence_id, Clonotype AS clt, {GENES_SQL}[1] AS v, {_AA} AS aa, junction, n_reads FROM contigs WHERE n_reads IS NOT NULL AND Clonotype IS NOT NULL AND junction IS NOT NULL AND v_call IS NOT NULL),
u AS (SELECT unit, junction, min(sequence_id) AS sequence_id, arg_min(clt, sequence_id) AS clt, arg_min(v, sequence_id) AS v, arg_min(aa, sequence_id) AS aa, CAST(sum(n_reads) AS BIGINT) AS r FROM b WHERE v IS NOT NULL AND aa IS NOT NULL GROUP BY 1, 2 HAVING sum(n_reads) >= 2),
s AS (SELECT *, v || '_' || aa AS cvk, sum(r) OVER (PARTITION BY unit, clt) AS rc, sum(r) OVER (PARTITION BY unit, clt, v || '_' || aa) AS rv FROM u),
k AS (SELECT *, substr(v, 1, 3) || '.C' || dense_rank() OVER (PARTITION BY unit ORDER BY rc DESC, clt) AS cid, dense_rank() OVER (PARTITION BY unit, clt ORDER BY rv DESC, cvk) AS vk FROM s),
i AS (SELECT *, cid || '.CV' || vk AS cv FROM k),
t AS (SELECT *, cv || '.S' || row_number() OVER (PARTITION BY unit, cv ORDER BY r DESC, sequence_id) AS sub, cid || '.' || row_number() OVER (PARTITION BY unit, cid ORDER BY r DESC, sequence_id) AS sub_clt FROM i)"""
_CELLS = f"""{CONTIGS_SQL}, b AS (SELECT sample AS unit, sequence_id, Clonotype AS clt, {GENES_SQL}[1] AS v, {_AA} AS aa, junction, split_part(sequence_id, '_', 1) || '_' || sample AS barcode FROM contigs WHERE n_reads IS NULL AND Clonotype IS NOT NULL AND junction IS NOT NULL AND v_call IS NOT NULL),
s AS (SELECT *, substr(v, 1, 3) AS loc, v || '_' || aa AS cvk, count(*) OVER (PARTITION BY unit, substr(v, 1, 3), clt) AS rc, count(*) OVER (PARTITION BY unit, substr(v, 1, 3), clt, v || '_' || aa) AS rv, count(*) OVER (PARTITION BY unit, substr(v, 1, 3), clt, v || '_' || aa, junction) AS rs FROM b WHERE v IS NOT NULL AND aa IS NOT NULL),
k AS (SELECT *, dense_rank() OVER (PARTITION BY unit, loc ORDER BY rc DESC, clt) AS ck, dense_rank() OVER (PARTITION BY unit, loc, clt ORDER BY rv DESC, cvk) AS vk, dense_rank() OVER (PARTITION BY unit, loc, clt, cvk ORDER BY rs DESC, junction) AS sk FROM s),
ids AS (SELECT *, loc || '.C' || ck AS cid, loc || '.C' || ck || '.CV' || vk AS cv, loc || '.C' || ck || '.CV' || vk || '.S' || sk AS sub FROM k)"""
_SOLVED = f"{_CELLS}, {one_per_chain('ids')}, {CLASSES}, {RESOLVED}"
_ANN = """ann AS (SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY loaded_at DESC) AS k FROM annotated_contigs) WHERE k = 1 AND SampleID NOT IN ('', 'NA') AND ClonotypeID IS NOT NULL),
cases AS (SELECT SampleID, arg_min(CaseID, registered_at) AS CaseID, arg_min(BatchID, registered_at) AS BatchID FROM sample_sheet GROUP BY 1)"""
BULKANN_SQL = f"""{_ANN}, g AS (SELECT SampleID, ClonotypeID, ClonotypeVariantID, SubcloneID, min(VDJ_genes) AS VDJ_genes, min(Junction_aa) AS Junction_aa, CAST(sum(Clonotype_nReads) AS BIGINT) AS r FROM ann WHERE Clonotype_nReads IS NOT NULL AND SubcloneID IS NOT NULL AND ClonotypeVariantID IS NOT NULL GROUP BY 1, 2, 3, 4),
rws AS (SELECT g.*, CaseID, CAST(sum(r) OVER (PARTITION BY SampleID, ClonotypeID, ClonotypeVariantID) AS BIGINT) AS vr, CAST(sum(r) OVER (PARTITION BY SampleID, ClonotypeID) AS BIGINT) AS cr FROM g JOIN cases USING (SampleID))"""
SC_SQL = f"{_ANN}, sc AS (SELECT * FROM ann WHERE barcode NOT IN ('', 'NA') AND ClonotypeVariantID IS NOT NULL AND SubcloneID NOT IN ('', 'NA'))"
CELLS_ONLY_SQL = """firsts AS (SELECT SampleID, barcode, completeBCR, Sample_Tag FROM (SELECT *, row_number() OVER (PARTITION BY SampleID, barcode ORDER BY registered_at, record_id) AS k FROM cells WHERE SampleID NOT IN ('', 'NA')) WHERE k = 1),
m AS (SELECT SampleID, barcode, string_agg(ClonotypeID, '-' ORDER BY ClonotypeID) AS clone, string_agg(SubcloneID, '-' ORDER BY SubcloneID) AS subclone, string_agg(concat_ws('|', VDJ_genes, Junction_aa), '-' ORDER BY concat_ws('|', VDJ_genes, Junction_aa)) AS seq FROM sc GROUP BY 1, 2),
ct AS (SELECT * FROM firsts JOIN m USING (SampleID, barcode) JOIN cases USING (SampleID))"""
CELLTABLE_SQL = f"{SC_SQL}, {CELLS_ONLY_SQL}"
_SLOTS = f"""{SC_SQL}, one AS (SELECT SampleID, barcode, ClonotypeID, VDJ_genes, Junction_aa FROM (SELECT *, row_number() OVER (PARTITION BY SampleID, barcode, ClonotypeID ORDER BY record_id) AS k FROM sc) WHERE k = 1),
numbered AS (SELECT *, CASE WHEN substr(ClonotypeID, 1, 3) = 'IGH' THEN 'IGH' WHEN substr(ClonotypeID, 1, 3) IN ('IGK', 'IGL') THEN 'IGL' END AS kind FROM one),
slots AS (SELECT *, kind || row_number() OVER (PARTITION BY SampleID, barcode, kind ORDER BY ClonotypeID) AS slot FROM numbered)"""


def _slot(slot: str, column: str) -> str:
    return f"max({column}) FILTER (slot = '{slot}') AS {slot}_{column}"


def _airr_sql(cells: bool = False) -> str:
    names = ["fwr1", "cdr1", "fwr2", "cdr2", "fwr3", "cdr3", "fwr4"]
    cols, before = [], "0"
    for n in names:
        end = f"({before} + length({n}))" if n != "fwr4" else "length(seq)"
        aa_end = f"({end} // 3)" if n != "fwr4" else "length(aa)"
        cols += [f"{n}", f"substr(aa, {before} // 3 + 1, greatest(0, {aa_end} - {before} // 3)) AS {n}_aa", f"CAST({before} + 1 AS INT) AS {n}_start", f"CAST({end} AS INT) AS {n}_end"]
        before = end
    call = lambda c: f"coalesce({CALL_SQL[c]}, '')"
    last = "n_reads AS duplicate_count, clonotypeID AS clone_id, sample AS sample_id"
    if cells:
        one = "split_part(sequence_id, '_', 1) || '_' || sample"
        last = f"CAST(1 AS BIGINT) AS duplicate_count, coalesce((SELECT string_agg(o.clonotypeID, '-' ORDER BY o.clonotypeID) FROM a o WHERE o.sample = a.sample AND split_part(o.sequence_id, '_', 1) = split_part(a.sequence_id, '_', 1)), '') AS clone_id, sample AS sample_id, {one} AS cell_id, 'Yes' AS completeBCR"
    return f"""WITH {_TIDY}, c AS (SELECT *, {_CODONS} AS codons FROM tidy WHERE n_reads IS {'' if cells else 'NOT '}NULL), a AS (SELECT *, {_aa('seq')} AS aa, {_aa('germline')} AS gaa FROM c)
SELECT sequence_id, seq AS sequence, upper(substr({call('v_call')}, 1, 3)) AS locus, 'T' AS productive, 'F' AS rev_comp, substr(seq, v_len - 2, length(cdr3) + 6) AS junction, junction_aa, CAST(length(cdr3) + 6 AS INT) AS junction_length,
{call('v_call')} AS v_call, {call('d_call')} AS d_call, {call('j_call')} AS j_call, c_call, seq AS sequence_alignment, aa AS sequence_alignment_aa, germline AS germline_alignment, gaa AS germline_alignment_aa,
'' AS v_cigar, '' AS d_cigar, '' AS j_cigar, {', '.join(cols)}, {last} FROM a"""


def _rescue_sql(column: str) -> str:
    return f"""WITH {CELLTABLE_SQL}, full_cells AS (SELECT DISTINCT SampleID, clone AS num, {column} AS id, string_split({column}, '-') AS p FROM ct WHERE completeBCR = 'Yes'),
runs AS (SELECT SampleID, num, unnest(p) AS run FROM full_cells UNION SELECT SampleID, num, unnest(list_transform(range(1, len(p)), lambda i: p[i] || '-' || p[i + 1])) FROM full_cells UNION SELECT SampleID, num, id FROM full_cells),
known AS (SELECT SampleID, run, min(num) AS num FROM runs GROUP BY 1, 2 HAVING count(DISTINCT num) = 1)
SELECT ct.SampleID, ct.barcode, CASE WHEN known.num IS NOT NULL THEN 'Yes_rescue' ELSE completeBCR END AS completeBCR, coalesce(known.num, CASE WHEN completeBCR = 'Yes' THEN clone END) AS num
FROM ct LEFT JOIN known ON ct.SampleID = known.SampleID AND known.run = ct.{column} AND completeBCR IN ('Single_chain_1', 'Single_chain_2')"""


CONTAM_CELLS_SQL = f"""{CELLS_ONLY_SQL}, n AS (SELECT seq, SampleID, CaseID, subclone, count(*) AS n FROM ct GROUP BY 1, 2, 3, 4), p AS (SELECT seq, SampleID, CaseID, max(n) AS n FROM n GROUP BY 1, 2, 3),
d AS (SELECT p.*, max(n) OVER (PARTITION BY seq) AS top, first_value(SampleID) OVER (PARTITION BY seq ORDER BY n DESC, SampleID) AS ts, first_value(CaseID) OVER (PARTITION BY seq ORDER BY n DESC, SampleID) AS tc FROM p WHERE seq IN (SELECT seq FROM p GROUP BY seq HAVING count(DISTINCT CaseID) > 1 AND max(n) > 1)),
w AS (SELECT *, max(CASE WHEN CaseID <> tc AND top < 2 * n THEN 1 ELSE 0 END) OVER (PARTITION BY seq) AS doubt FROM d),
z AS (SELECT seq, SampleID, ts, CASE WHEN CaseID <> tc AND top >= 2 * n THEN 'OUT' WHEN CaseID <> tc THEN 'OUT_X' WHEN doubt = 1 AND SampleID = ts THEN 'OUT_X' END AS raw FROM w),
x AS (SELECT ct.SampleID, barcode, clone, z.raw, z.ts FROM ct LEFT JOIN z ON ct.seq = z.seq AND ct.SampleID = z.SampleID AND z.raw IS NOT NULL),
y AS (SELECT *, count(*) FILTER (raw = 'OUT') OVER (PARTITION BY SampleID, clone) * 100.0 / count(*) OVER (PARTITION BY SampleID, clone) AS share FROM x)"""
CONTAM_BULK_SQL = f"""WITH {BULKANN_SQL}, q AS (SELECT *, coalesce(VDJ_genes, 'NA') || chr(1) || coalesce(Junction_aa, 'NA') AS key FROM rws), v AS (SELECT SampleID, ClonotypeVariantID, max(vr) AS vr FROM q GROUP BY 1, 2),
f AS (SELECT SampleID, ClonotypeVariantID, vr * 100.0 / sum(vr) OVER (PARTITION BY SampleID) AS freq FROM v), p AS (SELECT key, SampleID, CaseID, max(freq) AS freq FROM q JOIN f USING (SampleID, ClonotypeVariantID) GROUP BY 1, 2, 3),
d AS (SELECT p.*, max(freq) OVER (PARTITION BY key) AS top, first_value(SampleID) OVER (PARTITION BY key ORDER BY freq DESC, SampleID) AS ts, first_value(CaseID) OVER (PARTITION BY key ORDER BY freq DESC, SampleID) AS tc FROM p WHERE key IN (SELECT key FROM p GROUP BY key HAVING count(DISTINCT CaseID) > 1)),
w AS (SELECT *, max(CASE WHEN CaseID <> tc AND top < 10 * freq THEN 1 ELSE 0 END) OVER (PARTITION BY key) AS doubt FROM d),
z AS (SELECT key, SampleID, ts, CASE WHEN CaseID <> tc AND top >= 10 * freq THEN 'OUT' WHEN CaseID <> tc THEN 'OUT_X' WHEN doubt = 1 AND SampleID = ts THEN 'OUT_X' END AS raw FROM w),
x AS (SELECT q.*, z.raw, CASE WHEN z.raw IS NOT NULL THEN ts END AS ts FROM q LEFT JOIN z ON q.key = z.key AND q.SampleID = z.SampleID AND z.raw IS NOT NULL),
bad AS (SELECT SampleID, ClonotypeID, sum(f) AS bad FROM (SELECT SampleID, ClonotypeID, ClonotypeVariantID, max(vr * 100.0 / cr) AS f FROM x WHERE raw IS NOT NULL GROUP BY 1, 2, 3) GROUP BY 1, 2)"""

ORACLE = {
    "clonotype_freq_by_sample": f"WITH {CONTIGS_SQL} SELECT sample, clonotypeID, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY sample), 9) AS freq FROM contigs WHERE clonotypeID IS NOT NULL GROUP BY 1, 2",
    "v_clusters": f"""WITH RECURSIVE {CONTIGS_SQL}, calls AS (SELECT DISTINCT sample AS unit, {GENES_SQL} AS g FROM contigs WHERE v_call IS NOT NULL), e AS (SELECT DISTINCT unit, g[1] AS a, unnest(g) AS b FROM calls),
both_ways AS (SELECT unit, a, b FROM e UNION SELECT unit, b, a FROM e), reach AS (SELECT unit, a, b FROM both_ways UNION SELECT r.unit, r.a, w.b FROM reach r JOIN both_ways w ON r.unit = w.unit AND r.b = w.a)
SELECT unit, a AS gene, string_agg(DISTINCT b, ',' ORDER BY b) AS v_cluster FROM reach GROUP BY 1, 2""",
    "clonotypes_single_linkage": f"""WITH RECURSIVE {KEYED_SQL}, e AS (SELECT a.unit, a.v_cluster, a.cdr3 AS x, b.cdr3 AS y FROM keyed a JOIN keyed b ON a.unit = b.unit AND a.v_cluster = b.v_cluster AND a.len = b.len WHERE round(hamming(a.cdr3, b.cdr3) / a.len, 6) <= {MAX_DIFF}),
reach AS (SELECT unit, v_cluster, x, y FROM e UNION SELECT r.unit, r.v_cluster, r.x, e.y FROM reach r JOIN e ON r.unit = e.unit AND r.v_cluster = e.v_cluster AND r.y = e.x)
SELECT unit, v_cluster, x AS cdr3, min(y) AS label FROM reach GROUP BY 1, 2, 3""",
    "nn_distance": f"""WITH {KEYED_SQL} SELECT a.unit, a.v_cluster, a.cdr3, round(min(hamming(a.cdr3, b.cdr3) / a.len), 9) AS distance FROM keyed a LEFT JOIN keyed b ON a.unit = b.unit AND a.v_cluster = b.v_cluster AND a.len = b.len AND a.cdr3 <> b.cdr3 GROUP BY 1, 2, 3""",
    "bulk_ids": f"WITH {_BULK} SELECT unit, sequence_id, cid AS clt, cv, sub, sub_clt FROM t",
    "bulk_freqs": f"""WITH {_BULK} SELECT unit, sequence_id, CAST(sum(r) OVER (PARTITION BY unit, cid) AS BIGINT) AS clonotypeID_nreads, round(sum(r) OVER (PARTITION BY unit, cid) * 100.0 / sum(r) OVER (PARTITION BY unit), 9) AS clonotypeID_freq,
round(sum(r) OVER (PARTITION BY unit, cv) * 100.0 / sum(r) OVER (PARTITION BY unit, cid), 9) AS clonotypeVariant_freq, round(r * 100.0 / sum(r) OVER (PARTITION BY unit, cv), 9) AS subclone_freq_in_CV, round(r * 100.0 / sum(r) OVER (PARTITION BY unit, cid), 9) AS subclone_freq FROM t""",
    "sc_ids": f"WITH {_CELLS} SELECT unit, sequence_id, cid AS clt, cv, sub FROM ids",
    "cell_chains": f"""WITH {_CELLS}, one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY unit, barcode, cid ORDER BY sequence_id) AS n FROM ids) WHERE n = 1),
c AS (SELECT unit, barcode, string_agg(cid, '-' ORDER BY cid) AS merge_clonotypeID, string_agg(cv, '-' ORDER BY cv) AS merge_clonotypeVariantID, string_agg(sub, '-' ORDER BY sub) AS merge_subcloneID, count(*) AS n, count(*) FILTER (loc = 'IGH') AS h, count(*) FILTER (loc IN ('IGK', 'IGL')) AS l FROM one GROUP BY 1, 2)
SELECT unit, barcode, merge_clonotypeID, merge_clonotypeVariantID, merge_subcloneID, CASE WHEN n = 1 THEN 'Single_chain_1' WHEN n > 4 THEN 'Not_supported' WHEN h = 0 OR l = 0 THEN CASE WHEN n = 2 THEN 'Single_chain_2' ELSE 'Not_supported' END WHEN h > 2 OR l > 2 THEN CASE WHEN n = 4 THEN 'Not_supported' ELSE 'Yes' END ELSE 'Yes' END AS completeBCR FROM c""",
    "complete_bcr_resolved": f"WITH RECURSIVE {_SOLVED} SELECT unit, barcode, completeBCR, ig AS igclonotypeID FROM solved",
    "chain_relabel": f"WITH RECURSIVE {_SOLVED}, {RELABELLED} SELECT unit, sequence_id, cid AS clonotypeID FROM relabelled",
    "cell_numbers": f"WITH RECURSIVE {_SOLVED}, {numbered('solved', 'ranked')} SELECT unit, barcode, ig AS igclonotypeID, igcv AS igclonotypeVariantID, igsub AS igsubcloneID_in_clonotypeVariant, igin AS igsubcloneID_in_clonotype FROM ranked",
    "chain_values": f"""WITH {_CELLS}, {one_per_chain('ids')}, {CLASSES}, v AS (SELECT unit, barcode, string_agg(coalesce(junction, 'NA'), '_' ORDER BY sub, junction, aa) AS VDJseq, string_agg(coalesce(aa, 'NA'), '_' ORDER BY sub, junction, aa) AS cdr3_aa FROM one GROUP BY 1, 2)
SELECT v.unit, v.barcode, CASE WHEN class <> 'Not_supported' THEN VDJseq END AS VDJseq, CASE WHEN class <> 'Not_supported' THEN cdr3_aa END AS cdr3_aa FROM v JOIN classed c ON c.unit = v.unit AND c.barcode = v.barcode""",
    "consensus_cdr3": f"""WITH {CONTIGS_SQL}, b AS (SELECT sample, Clonotype, {_AA} AS s FROM contigs WHERE Clonotype IS NOT NULL),
m AS (SELECT sample, Clonotype, length(s) AS len, row_number() OVER (PARTITION BY sample, Clonotype ORDER BY count(*) DESC, length(s)) AS k FROM b WHERE length(s) > 0 GROUP BY 1, 2, 3),
l AS (SELECT b.sample, b.Clonotype, p, substr(s, CAST(p AS INT), 1) AS c, count(*) AS n FROM b JOIN m ON b.sample = m.sample AND b.Clonotype = m.Clonotype AND length(s) = len AND k = 1, LATERAL (SELECT unnest(range(1, length(s) + 1)) AS p) GROUP BY 1, 2, 3, 4),
t AS (SELECT sample, Clonotype, p, string_agg(c, '' ORDER BY c) AS cs FROM (SELECT *, max(n) OVER (PARTITION BY sample, Clonotype, p) AS best FROM l) WHERE n = best GROUP BY 1, 2, 3)
SELECT sample, Clonotype, string_agg(CASE WHEN length(cs) > 1 THEN '[' || cs || ']' ELSE cs END, '' ORDER BY p) AS consensus FROM t GROUP BY 1, 2""",
    "consensus_germline": f"""WITH {ALIGNED_SQL}, b AS (SELECT sample, Clonotype, sequence_id, junction, seq, germline, array_to_string(list_transform(range(1, length(germline) + 1), lambda i: CASE WHEN substr(germline, i, 1) = 'N' THEN substr(seq, i, 1) ELSE substr(germline, i, 1) END), '') AS filled, length(germline) - length(replace(germline, 'N', '')) AS n
  FROM aligned WHERE whole AND fwr1 <> '' AND cdr3 <> '' AND upper(productive) IN ('T', 'TRUE') AND Clonotype IS NOT NULL),
m AS (SELECT sample, Clonotype, length(junction) AS len, row_number() OVER (PARTITION BY sample, Clonotype ORDER BY count(*) DESC, length(junction)) AS k FROM b GROUP BY 1, 2, 3),
r AS (SELECT b.sample, b.Clonotype, filled, row_number() OVER (PARTITION BY b.sample, b.Clonotype ORDER BY round((length(seq) - n - hamming(filled, seq)) / (length(seq) - n), 12) DESC, n, sequence_id) AS i FROM b JOIN m ON b.sample = m.sample AND b.Clonotype = m.Clonotype AND length(junction) = len AND k = 1)
SELECT sample, Clonotype, filled AS consensus_germline FROM r WHERE i = 1""",
    "contam_bulk": f"""{CONTAM_BULK_SQL}
SELECT x.SampleID, SubcloneID, CASE WHEN raw IS NULL THEN 'PASS' WHEN bad >= 80 THEN 'OUT_CLONOTYPE' ELSE 'OUT_CLONOTYPEVARIANT' END AS Contamination_FLAG, coalesce(raw, 'PASS') AS Contamination_raw, ts AS Contamination_Sample FROM x LEFT JOIN bad ON x.SampleID = bad.SampleID AND x.ClonotypeID = bad.ClonotypeID""",
    "contam_cells": f"""WITH {SC_SQL}, {CONTAM_CELLS_SQL}
SELECT SampleID, barcode, CASE WHEN share >= 80 THEN 'OUT_CLONOTYPE' ELSE coalesce(raw, 'PASS') END AS Contamination_FLAG, ts AS Contamination_Sample FROM y""",
    "contam_tags": f"""WITH {CELLTABLE_SQL}, n AS (SELECT SampleID, clone, Sample_Tag, count(*) AS n FROM ct WHERE Sample_Tag NOT IN ('', 'NA', 'Multiplet', 'Undetermined') GROUP BY 1, 2, 3),
t AS (SELECT *, sum(n) OVER w AS total, max(n) OVER w AS top, first_value(Sample_Tag) OVER (PARTITION BY SampleID, clone ORDER BY n DESC, Sample_Tag) AS best FROM n WINDOW w AS (PARTITION BY SampleID, clone)),
f AS (SELECT *, total > 1 AND Sample_Tag <> best AND top > 1.5 * n AS bad FROM t)
SELECT ct.SampleID, barcode, CASE WHEN bad THEN 'OUT' WHEN bad IS NOT NULL THEN 'PASS' END AS SampleTag_FLAG, CASE WHEN bad THEN n || ':' || top END AS SampleTag_Ratio FROM ct LEFT JOIN f ON ct.SampleID = f.SampleID AND ct.clone = f.clone AND ct.Sample_Tag = f.Sample_Tag""",
    "recalc_bulk": f"""WITH {BULKANN_SQL}, k AS (SELECT *, 'C' || dense_rank() OVER (PARTITION BY SampleID ORDER BY cr DESC, ClonotypeID) AS c, dense_rank() OVER (PARTITION BY SampleID, ClonotypeID ORDER BY vr DESC, ClonotypeVariantID) AS v FROM rws)
SELECT SampleID, SubcloneID AS old, c AS ClonotypeID, c || '.CV' || v AS ClonotypeVariantID, c || '.CV' || v || '.S' || row_number() OVER (PARTITION BY SampleID, ClonotypeVariantID ORDER BY r DESC, SubcloneID) AS SubcloneID,
c || '.' || row_number() OVER (PARTITION BY SampleID, ClonotypeID ORDER BY r DESC, SubcloneID) AS SubcloneID_in_Clonotype, cr AS Clonotype_nReads, round(cr * 100.0 / sum(r) OVER (PARTITION BY SampleID), 9) AS Clonotype_freq FROM k""",
    "recalc_cells": f"""WITH {SC_SQL}, a AS (SELECT *, substr(ClonotypeID, 1, 3) AS loc, regexp_replace(ClonotypeID, 'x(NA)?[0-9]+$', '') AS base, regexp_extract(ClonotypeID, '(x(?:NA)?[0-9]+)$', 1) AS suf FROM sc),
n AS (SELECT *, count(*) OVER (PARTITION BY SampleID, loc, base) AS bn FROM a), k AS (SELECT *, loc || '.C' || dense_rank() OVER (PARTITION BY SampleID, loc ORDER BY bn DESC, base) || suf AS cid FROM n),
s AS (SELECT *, count(*) OVER (PARTITION BY SampleID, cid, ClonotypeVariantID) AS vn, count(*) OVER (PARTITION BY SampleID, cid, ClonotypeVariantID, SubcloneID) AS sn FROM k),
t AS (SELECT *, cid || '.CV' || dense_rank() OVER (PARTITION BY SampleID, cid ORDER BY vn DESC, ClonotypeVariantID) AS cv, dense_rank() OVER (PARTITION BY SampleID, cid, ClonotypeVariantID ORDER BY sn DESC, SubcloneID) AS sk FROM s)
SELECT record_id, cid AS ClonotypeID, cv AS ClonotypeVariantID, cv || '.S' || sk AS SubcloneID FROM t""",
    "rescue_strict": _rescue_sql("subclone"),
    "rescue_relaxed": _rescue_sql("clone"),
    "cells_wide": f"WITH {_SLOTS} SELECT SampleID, barcode, count(*) AS n_contigs, {', '.join(_slot(s, c) for s in SLOTS for c in WIDE)} FROM slots GROUP BY 1, 2",
    "cells_long": f"""WITH {_SLOTS} SELECT SampleID, barcode, barcode || '_' || CASE slot WHEN 'IGH1' THEN 1 WHEN 'IGH2' THEN 2 WHEN 'IGL1' THEN 3 ELSE 4 END AS contig_id, slot, ClonotypeID, VDJ_genes, Junction_aa FROM slots WHERE slot IN ('IGH1', 'IGH2', 'IGL1', 'IGL2')""",
    "mb_cells": f"""WITH {_SLOTS}, wide AS (SELECT SampleID, barcode, count(*) AS n_contigs, {_slot('IGH1', 'ClonotypeID')}, {_slot('IGL1', 'ClonotypeID')} FROM slots GROUP BY 1, 2)
SELECT * FROM wide UNION ALL SELECT DISTINCT SampleID, barcode, CAST(0 AS BIGINT), CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR) FROM cells c WHERE SampleID NOT IN ('', 'NA') AND barcode IS NOT NULL AND NOT EXISTS (SELECT 1 FROM wide w WHERE w.SampleID = c.SampleID AND w.barcode = c.barcode)""",
    "airr_export": _airr_sql(),
    "airr_export_cells": _airr_sql(True),
    "gctree_abundance": f"""WITH {SC_SQL}, n AS (SELECT SampleID || '|' || ClonotypeID AS clone, SubcloneID AS subclone, count(*) AS abundance FROM sc GROUP BY 1, 2), big AS (SELECT clone FROM n GROUP BY 1 HAVING sum(abundance) > 1)
SELECT n.* FROM n JOIN big USING (clone) UNION ALL SELECT clone, 'GL', 0 FROM big""",
    "gctree_idmap": f"WITH {SC_SQL} SELECT SampleID, ClonotypeID, SubcloneID, count(*) AS abundance, string_agg(barcode, ':' ORDER BY barcode) AS members FROM sc GROUP BY 1, 2, 3",
}
