"""The annotation pipeline: aligner rows in, annotated contigs out."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repspark.config import AnnotateConfig
from repspark.functions.missing import na_text
from repspark.functions.sequences import barcode, cdr3_aa, cdr3_nt, junction_from, translate_nt, v_identity
from repspark.functions.subsets import stereotype_subset
from repspark.operators import cells as C
from repspark.operators import ids
from repspark.operators.clonotypes import automatic_cutoff, merge_indel_clonotypes, nearest_distances, nested_ranks, with_clonotypes, with_v_cluster
from repspark.operators.immunogenetics import annotate_features, best_germline, chain_sequences, clonotype_subset, consensus_cdr3, consensus_germline, correct_cdr3_length, correct_indels, joined_events
from repspark.operators.tidy import modal_length, tidy, unique_sequences, with_read_counts
from repspark.runtime import bucketed, frugal, written

log = logging.getLogger("repspark")

#: Working names and the public names of the product.
PUBLIC = {
    "sequence_id": "contig_id", "sequence": "Raw_sequence", "raw_VDJseq": "Raw_VDJ_sequence", "VDJseq": "VDJ_sequence", "germline_alignment": "IgBlast_Germline_alignment",
    "VDJseq_correctedCDR3": "VDJ_sequence_correctedCDR3", "VDJseq_correctedCDR3_aa": "VDJ_sequence_correctedCDR3_aa", "consensus_germline": "Consensus_Germline", "consensus_germline_aa": "Consensus_Germline_aa",
    "VDJ": "VDJ_genes", "c_call": "C_gene", "productive": "Functionality", "junction_aa": "Junction_aa", "junction_aa_length": "Junction_length", "v_identity": "V_identity", "len_no_CDR3": "V_length", "indel": "InDels",
    "IGHsubset": "CLL_Stereotype_Subsets", "clonotypeID": "ClonotypeID", "consensus": "Clonotype_Consensus_CDR3aa", "Clonotype_Subset": "Clonotype_CLL_Stereotype_Subsets",
    "clonotypeID_nreads": "Clonotype_nReads", "clonotypeID_freq": "Clonotype_freq", "clonotypeVariantID_in_Cltp": "ClonotypeVariantID", "clonotypeVariant_nreads": "ClonotypeVariant_nReads", "clonotypeVariant_freq": "ClonotypeVariant_freq",
    "subcloneID_in_CV": "SubcloneID", "Unique_SequenceID": "SubcloneID", "total_reads_unique_seq": "Subclone_nReads", "subclone_freq_in_CV": "Subclone_freq_in_ClonotypeVariant", "subcloneID_in_Clt": "SubcloneID_in_Clonotype",
    "subclone_freq": "Subclone_freq_in_Clonotype", "igclonotypeID": "igClonotypeID_num", "merge_clonotypeID": "igClonotypeID", "igclonotypeVariantID": "igClonotypeVariantID_num", "merge_clonotypeVariantID": "igClonotypeVariantID",
    "igsubcloneID_in_clonotypeVariant": "igSubcloneID_in_ClonotypeVariant_num", "igsubcloneID_in_clonotype": "igSubcloneID_in_Clonotype_num", "merge_subcloneID": "igSubcloneID",
    "V1": "igRaw_VDJ_sequence", "V2": "igVDJ_sequence", "V3": "igVDJ_sequence_aa", "V4": "igClonotype_Consensus_Germline", "V5": "igClonotype_Consensus_Germline_aa", "V6": "igVDJ_positions", "V7": "igInDels", "V8": "igClonotype_Consensus_CDR3aa", "V9": "igCLL_Stereotype_Subsets",
    "sample": "SampleID",
}


#: The fields of the tidy table that no step works on; they wait for the result in the written tidy table.
CARRIED = ["sequence", "raw_VDJseq", "germline_alignment", "VDJ", "c_call", "VDJ_positions"]
#: Joined per cell in the order of its subclones, as V1 to V9; gap events are joined by '-', the others by '_'.
CELL_VALUES = ["raw_VDJseq", "VDJseq_correctedCDR3", "VDJseq_correctedCDR3_aa", "consensus_germline", "consensus_germline_aa", "VDJ_positions", "indel", "consensus", "IGHsubset"]
#: The fields of single cell and mission-bio rows, in order.
CELL_COLUMNS = [
    "barcode", "clonotypeID", "sample", "sequence_id", "VDJseq", "indel", "len_no_CDR3", "junction_aa", "junction_aa_length", "productive", "clonotypeVariantID_in_Cltp", "Unique_SequenceID", "completeBCR", "igclonotypeID",
    "merge_clonotypeID", "merge_clonotypeVariantID", "merge_subcloneID", "igclonotypeVariantID", "igsubcloneID_in_clonotypeVariant", "igsubcloneID_in_clonotype", "sequence", "raw_VDJseq", "germline_alignment", "VDJ", "c_call", "VDJ_positions",
    "consensus", "consensus_germline", "VDJseq_correctedCDR3", "v_identity", "VDJseq_correctedCDR3_aa", "consensus_germline_aa", "IGHsubset", "Clonotype_Subset", *[f"V{i}" for i in range(1, 10)],
]


def to_public(df: DataFrame) -> DataFrame:
    """The fields of the product under their public names; an empty string becomes null."""
    kept = [f for f in df.schema if f.name in PUBLIC or f.name in ("completeBCR", "barcode", "VDJ_positions")]
    out = [(F.nullif(F.col(f.name), F.lit("")) if f.dataType.typeName() == "string" else F.col(f.name)).alias(PUBLIC.get(f.name, f.name)) for f in kept]
    return df.select(*out)


def cdr3_of(cfg: AnnotateConfig) -> dict[str, Column]:
    """The CDR3 by cdr3_mode, and its amino acids."""
    return {"cdr3": cdr3_nt("junction") if cfg.cdr3_mode == "nt" else cdr3_aa("junction_aa"), "cdr3_aa": cdr3_aa("junction_aa")}


def with_cdr3(df: DataFrame, cfg: AnnotateConfig, seq: str | Column = "VDJseq") -> DataFrame:
    """The rows that have a CDR3 and (but for mission-bio) the modal length of sequence among those of their unit, V cluster and CDR3."""
    df = df.where(F.length("cdr3") > 0)
    return df if cfg.data_type == "missionbio" else modal_length(df, ["unit", "v_cluster", "cdr3"], seq)


def assign_clonotypes(df: DataFrame, cfg: AnnotateConfig) -> DataFrame:
    """Rows of ``with_cdr3`` with Clonotype and CorrectClt; the lineage is cut after the Python steps."""
    mb = cfg.data_type == "missionbio"
    cutoff = cfg.hc_similarity_cutoff
    if cutoff == "automatic":
        keyed = df.withColumn("_pre", F.concat_ws("_", "v_cluster", F.length("cdr3").cast("string")))
        cutoff = automatic_cutoff(nearest_distances(keyed, ["unit", "_pre"], "cdr3"), cfg.cdr3_mode)
    df = written(with_clonotypes(df, cutoff=float(cutoff), mode=cfg.hc_mode, by_v_length=not mb), "clusters")
    return merge_indel_clonotypes(df, cutoff=float(cutoff), mode=cfg.cdr3_InDel_correction_mode, by_v_length=not mb)


def immunogenetics(df: DataFrame, cfg: AnnotateConfig) -> DataFrame:
    """Bulk rows with V_identity, consensus CDR3 and germline of their clonotype, corrected CDR3 and, if asked for, subsets and marks.

    Identity is over the V positions against the clonotype's consensus germline. The
    consensus CDR3 is that of the clonotype's productive rows; an unproductive row has it if a productive row of its
    clonotype has the same sequence and gaps.
    """
    keys = ["unit", "clonotypeID"]
    ok = F.col("productive") == "productive"
    df = df.join(consensus_cdr3(df.where(ok), keys, "cdr3_aa"), keys, "left")
    if cfg.material_type == "dna":
        same = [*keys, "VDJseq", "indel"]
        seen = df.where(ok).select(*[F.col(c).alias(f"_{c}") for c in same]).distinct()
        on = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in same]
        df = df.join(seen, on, "left").withColumn("consensus", F.when(ok | F.col("_unit").isNotNull(), F.col("consensus"))).drop(*[f"_{c}" for c in same])
    df = df.join(consensus_germline(df, keys, "VDJseq", "germline_alignment", "cdr3", "sequence_id"), keys, "left")
    df = correct_cdr3_length(df, "VDJseq", "germline_alignment", "consensus_germline", F.length("cdr3") != F.col("modal_cdr3"))
    df = df.withColumn("indel", joined_events("indel", "indel_CDR3")).drop("indel_CDR3", "modal_cdr3")
    df = df.withColumns({"v_identity": v_identity("VDJseq", "consensus_germline", "len_no_CDR3"), "VDJseq_correctedCDR3_aa": translate_nt("VDJseq_correctedCDR3"), "consensus_germline_aa": translate_nt("consensus_germline")})
    df = annotate_features(df, cfg.annotate_CLL_immGen, cfg.annotate_satellite_subsets, cfg.annotate_ags)
    if cfg.annotate_CLL_immGen:
        df = df.withColumn("Clonotype_Subset", clonotype_subset(ok, "VDJ", "consensus", cfg.annotate_satellite_subsets))
    return df


def cell_key(unit: Column | str, cell: Column | str) -> Column:
    """Unit and barcode as one string, by which the tidy table is bucketed."""
    one = lambda c: F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("\2"))
    return F.concat(one(unit), F.lit("\1"), one(cell))


def annotate(aligned: DataFrame, cfg: AnnotateConfig = AnnotateConfig()) -> DataFrame:
    """Annotated contigs (public names) of aligner rows with ``sample`` and ``unit``.

    The tidy rows are written once, whole; the steps up to the final ids carry only what they work on and the row's
    number, by which sequences and germline are joined back at the end.
    """
    cells = cfg.data_type != "bulk"
    if cells:  # rows are numbered before they are filtered, so that filters don't spell the regions once more
        aligned = aligned.withColumn("_row", F.monotonically_increasing_id())
    df = correct_indels(tidy(aligned, cfg.material_type, cfg.primer, extra=("unit", *["_row"] * cells)).withColumn("raw_VDJseq", F.regexp_replace("VDJseq", "-", "")))
    df = df.withColumns({"len_no_CDR3": F.aggregate(F.slice("arch", 1, 5), F.lit(0), lambda a, x: a + x), "VDJ_positions": F.array_join(F.col("arch").cast("array<string>"), "-")})
    df = df.withColumn("junction", junction_from("VDJseq", F.col("arch"))).withColumn("junction_aa", translate_nt("junction")).withColumn("junction_aa_length", F.length("junction_aa"))
    return to_public(_cells(df, cfg) if cells else _bulk(df, cfg))


def _step(cfg: AnnotateConfig, done: str) -> None:
    log.info("%s annotation: %s", cfg.data_type, done)


#: The fields of the tidy table that the steps need, beside ``CARRIED``.
KEPT = ["unit", "sample", "sequence_id", "v_call", "VDJseq", "indel", "arch", "len_no_CDR3", "junction", "junction_aa", "junction_aa_length", "productive"]


def _bulk(df: DataFrame, cfg: AnnotateConfig) -> DataFrame:
    scope = ["unit", "sample"] if cfg.dedupe_scope == "sample" else ["unit"]
    df = unique_sequences(with_read_counts(df, ["unit"]), scope, ["VDJseq", "indel"], cfg.min_reads)
    kept = [*KEPT, "total_reads_unique_seq"]
    whole = written(df.select(F.monotonically_increasing_id().alias("_row"), *kept, *CARRIED), "tidy")
    _step(cfg, "tidy rows written, clonotypes begin")
    df = assign_clonotypes(with_cdr3(with_v_cluster(whole.select("_row", *kept)).drop("v_call").withColumns(cdr3_of(cfg)), cfg), cfg)
    _step(cfg, "clonotypes assigned, ids begin")
    return immunogenetics(written(ids.bulk_frequencies(ids.bulk_ids(df)).join(whole.select("_row", *CARRIED), "_row"), "ids"), cfg)


def _cells(df: DataFrame, cfg: AnnotateConfig) -> DataFrame:
    """Single cell and mission-bio. Between the tidy table and the result no row has a sequence, but numbers in the order of
    its subclone's sequence and its variant; each step is written, and what it was made from is removed.
    """
    mb = cfg.data_type == "missionbio"
    with frugal(df.sparkSession) as release:
        # rows of one gene lie together, which makes the table several times smaller; rows of a cell are in one bucket and stay there
        whole = bucketed(df.select("_row", *KEPT, *CARRIED, cell_key("unit", barcode("sequence_id", "sample")).alias("_cell")), "tidy", "_cell", ["v_call", "junction"])
        _step(cfg, "tidy rows written, clonotypes begin")
        cell = barcode("sequence_id", "sample").alias("barcode")
        df = whole.withColumns(cdr3_of(cfg)).select("_row", "unit", "sequence_id", cell, "v_call", "len_no_CDR3", "cdr3", "cdr3_aa", F.length("VDJseq").alias("_length"), F.concat_ws("_", "VDJseq", na_text("indel")).alias("_text"))
        df = written(df.withColumn("_sub", F.dense_rank().over(Window.partitionBy("unit", "cdr3_aa").orderBy("_text"))).drop("_text"), "rows")
        df = written(with_cdr3(with_v_cluster(df).drop("v_call"), cfg, F.col("_length")).drop("_length"), "clustered")
        release(whole, df)
        df = assign_clonotypes(df, cfg).select("_row", "unit", "sequence_id", "barcode", "v_cluster", "cdr3_aa", "_sub", "CorrectClt")
        df = written(df, "clonotypes")
        release(whole, df)
        _step(cfg, "clonotypes assigned, ids begin")
        df = ids.numbered_cell_ids(df, "_sub").drop("v_cluster", "cdr3_aa", "CorrectClt")
        first = F.row_number().over(Window.partitionBy("unit", "barcode", "clonotypeID").orderBy("sequence_id", "_cvk", "_sub", "_row"))
        df = df.repartition("unit", "barcode").withColumn("_first", first).where(F.col("clonotypeID").isNull() | (F.col("_first") == 1)).drop("_first")
        df = written(df, "ids")
        release(whole, df)
        _step(cfg, "ids written, cells begin")
        classes = C.resolve_classes(C.initial_class(C.merged_ids(df), mb), mission_bio=mb).select("unit", "barcode", "completeBCR", "igclonotypeID")
        df = written(C.relabel_chains(df.join(classes, ["unit", "barcode"], "left")), "relabelled")
        release(whole, df)
        df = ids.dotted_ids(nested_ranks(df.drop("clonotypeVariantID_in_Cltp", "Unique_SequenceID", "sequence_id").withColumnRenamed("_cvk", "_cv"), ["unit", "clonotypeID"], "_cv", "_sub", False))
        df = written(df.drop("_cv", "_cvk", "_sub"), "chains")
        release(whole, df)
        _step(cfg, "chains labelled, numbers and immunogenetics begin")
        one = [F.max(c).alias(c) for c in ("completeBCR", "igclonotypeID")]
        cells = written(C.numbered(C.merged_ids(df, also=(F.count(F.lit(1)).alias("_rows"), *one)).drop("n_chains", "heavy", "light"), by="_rows").drop("_rows"), "numbered")
        chains = _consensus(df.drop("completeBCR", "igclonotypeID"), whole, cfg, lambda *keep: release(whole, cells, *keep))
        release(whole, cells, chains)
    return _annotated(whole, chains, cells, cfg)


def _beside(df: DataFrame, whole: DataFrame) -> DataFrame:
    """Rows of ``df`` (unit, barcode, _row) with the columns of their row of ``whole`` (_cell, _row, ...); only ``df`` is shuffled."""
    same = F.col("_row") - F.col("_of") == 0  # not a key of the join, whose keys have to be those of the buckets
    df = df.withColumnRenamed("_row", "_of").withColumn("_in", cell_key("unit", "barcode"))
    return df.join(whole.hint("merge"), (F.col("_in") == F.col("_cell")) & same).drop("_of", "_in", "_cell")


def _consensus(df: DataFrame, whole: DataFrame, cfg: AnnotateConfig, release: Callable[..., None]) -> DataFrame:
    """``df`` with the consensus CDR3 and (but for mission-bio) the consensus germline of its clonotypes; as in ``immunogenetics``.

    Rows are shuffled by clonotype once, without sequences. A clonotype of one row has no germline here, but _own: it's made of the row itself.
    """
    mb, dna, keys = cfg.data_type == "missionbio", cfg.material_type == "dna", ["unit", "clonotypeID"]
    look = {"_ok": F.col("productive") == "productive", "_n": F.length("cdr3"), "_both": F.col("VDJseq").isNotNull() & F.col("germline_alignment").isNotNull()}
    if dna:
        look["_same"] = F.unhex(F.md5(F.concat(F.coalesce("VDJseq", F.lit("\1")), F.lit("\2"), F.coalesce("indel", F.lit("\1")))))
    df = written(_beside(df, whole.withColumns(cdr3_of(cfg)).withColumns(look).select("_cell", "_row", "cdr3_aa", *look)), "parts")
    release(df)
    got = df.drop("cdr3_aa").join(consensus_cdr3(df.where("_ok"), keys, "cdr3_aa"), keys, "left")
    if dna:
        got = got.withColumn("_seen", F.max("_ok").over(Window.partitionBy(*keys, "_same"))).withColumn("consensus", F.when(F.col("_ok") | F.col("_seen"), F.col("consensus"))).drop("_seen", "_same")
    if mb:
        return written(got.drop("_ok", "_n", "_both"), "consensus")
    of_key = Window.partitionBy(*keys)
    got = got.withColumn("_t", F.count_if("_both").over(Window.partitionBy(*keys, "_n"))).withColumn("_rows", F.count(F.lit(1)).over(of_key))
    got = got.withColumn("_modal", F.max(F.when(F.col("_both"), F.struct("_t", (-F.col("_n")).alias("_n")))).over(of_key))
    got = got.withColumns({"_differs": F.col("_n") != -F.col("_modal._n"), "_own": F.col("_both") & (F.col("_rows") == 1) & F.col("clonotypeID").isNotNull()})
    got = written(got.drop("_ok", "_t", "_n", "_modal"), "modal")
    release(got)
    candidates = got.where("_rows > 1 AND _both AND NOT _differs AND clonotypeID IS NOT NULL").select("_row", "barcode", *keys)
    germline = written(best_germline(_beside(candidates, whole.select("_cell", "_row", "sequence_id", "VDJseq", "germline_alignment")), keys, "VDJseq", "germline_alignment", "sequence_id"), "germlines")
    several = F.col("_rows") > 1
    alone = got.where(~several).withColumn("consensus_germline", F.lit(None).cast("string"))
    return written(alone.unionByName(got.where(several).join(germline, keys, "left")).drop("_both", "_rows"), "consensus")


def _annotated(whole: DataFrame, chains: DataFrame, cells: DataFrame, cfg: AnnotateConfig) -> DataFrame:
    """The rows of ``chains`` with all fields of their row of ``whole`` and of their cell, and the joined values of the cell.

    Sequences aren't shuffled: ``whole`` is bucketed by cell. All chains of a cell are one row until its values are joined.
    """
    mb, ok = cfg.data_type == "missionbio", F.col("productive") == "productive"
    own = [c for c in chains.columns if c not in ("unit", "barcode")]
    narrow = chains.select(cell_key("unit", "barcode").alias("_cell"), F.struct(*own).alias("_n")).repartition("_cell").groupBy("_cell").agg(F.collect_list("_n").alias("_n"))
    wide = whole if not cfg.annotate_CLL_immGen else whole.withColumn("IGHsubset", stereotype_subset(ok, "VDJ", "junction_aa", cfg.annotate_satellite_subsets))
    wide = wide.drop("v_call", "junction", "junction_aa_length", *([] if cfg.annotate_ags else ["arch"]))
    fields = [c for c in wide.columns if c not in ("unit", "_row", "_cell")]
    wide = wide.select("_cell", F.struct("_row", *fields).alias("_w")).groupBy("_cell").agg(F.collect_list("_w").alias("_w"))
    df = narrow.join(wide.hint("merge"), "_cell").join(cells.withColumn("_cell", cell_key("unit", "barcode")).drop("unit"), "_cell", "left")
    own.remove("_row")
    row = lambda n: F.filter("_w", lambda w: w["_row"] == n["_row"])[0]
    df = df.withColumn("_x", F.transform("_n", lambda n: F.struct(row(n).alias("w"), n.alias("n")))).drop("_w", "_n")
    germline = (lambda x: x["w"]["germline_alignment"]) if mb else (lambda x: x["n"]["consensus_germline"])
    flag = lambda x, c: F.lit(False) if mb else x["n"][c]
    sent = F.transform("_x", lambda x: F.struct(x["w"]["VDJseq"].alias("seq"), x["w"]["germline_alignment"].alias("germ"), germline(x).alias("cons"), flag(x, "_differs").alias("differs"), flag(x, "_own").alias("own"), x["w"]["len_no_CDR3"].alias("n")))
    made = lambda x, y: {
        "consensus_germline": y["cons"], "VDJseq_correctedCDR3": y["seq"], "VDJseq_correctedCDR3_aa": y["aa"], "consensus_germline_aa": y["cons_aa"], "v_identity": y["identity"],
        "indel": x["w"]["indel"] if mb else joined_events(x["w"]["indel"], y["indel"]),
    }
    new = ["consensus_germline", "VDJseq_correctedCDR3", "VDJseq_correctedCDR3_aa", "consensus_germline_aa", "v_identity", "indel"]
    taken = [c for c in fields if c not in new]
    whole_row = lambda x, y: F.struct(*[x["w"][c].alias(c) for c in taken], *[x["n"][c].alias(c) for c in own if c not in (*new, "_differs", "_own")], *[v.alias(c) for c, v in made(x, y).items()])
    df = df.withColumn("_y", chain_sequences(sent)).withColumn("_x", F.zip_with("_x", "_y", whole_row)).drop("_y")
    values = [c for c in CELL_VALUES if c in new + taken + own]
    lost = F.coalesce(F.col("completeBCR") == "Not_supported", F.lit(False))
    text = lambda x: F.struct(x["Unique_SequenceID"].alias("_s"), *[F.coalesce(x[c].cast("string"), F.lit("NA")).alias(c) for c in values])
    df = df.withColumn("_v", F.array_sort(F.transform(F.filter("_x", lambda x: x["Unique_SequenceID"].isNotNull()), text)))
    df = df.withColumns({f"V{i}": F.when(~lost, F.array_join(F.col(f"_v.{c}"), "-" if c == "indel" else "_")) for i, c in enumerate(CELL_VALUES, 1) if c in values})
    df = df.withColumns({c: F.when(~lost, F.col(c)) for c in ("merge_clonotypeID", "merge_clonotypeVariantID", "merge_subcloneID")}).drop("_v")
    df = df.withColumn("_x", F.explode_outer("_x")).select("_x.*", *[c for c in df.columns if c not in ("_x", "_cell")])
    df = df.withColumn("junction_aa_length", F.length("junction_aa"))
    df = annotate_features(df, cfg.annotate_CLL_immGen, cfg.annotate_satellite_subsets, cfg.annotate_ags)
    if cfg.annotate_CLL_immGen:
        df = df.withColumn("Clonotype_Subset", clonotype_subset(ok, "VDJ", "consensus", cfg.annotate_satellite_subsets))
    return df.select(*[c for c in CELL_COLUMNS if c in df.columns])
