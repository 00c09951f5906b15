"""From files to annotated tables, and the steps after annotation that touch contigs and cells together."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repspark.config import AnnotateConfig
from repspark.functions.sequences import sorted_join
from repspark.operators.contamination import keep_passed
from repspark.operators.ranks import columns
from repspark.operators.recalc import NUMBERS, recalculate_bulk, recalculate_cells, rescue_single_chains
from repspark.operators.tidy import require_columns
from repspark.operators.wide import cells_wide, with_unsupported
from repspark.plans.annotate import PUBLIC, annotate
from repspark.sources.aligner import read_aligned, run_aligner, write_annotated
from repspark.runtime import written
from repspark.sources.raw import expand_paths, read_table

log = logging.getLogger("repspark")

#: Contig columns that each chain slot of the cell table holds.
SLOT_COLUMNS = ["VDJ_genes", "C_gene", "Junction_aa", "Junction_length", "Functionality", "V_length", "V_identity", "CLL_Stereotype_Subsets", "ClonotypeID", "Clonotype_Consensus_CDR3aa", "Clonotype_CLL_Stereotype_Subsets", "ClonotypeVariantID", "SubcloneID", "Raw_sequence", "Raw_VDJ_sequence", "VDJ_sequence", "IgBlast_Germline_alignment", "VDJ_sequence_correctedCDR3", "VDJ_sequence_correctedCDR3_aa", "Consensus_Germline", "Consensus_Germline_aa", "VDJ_positions", "InDels"]
#: Fields of the cell itself.
CELL_COLUMNS = ["completeBCR", "igClonotypeID_num", "igClonotypeID", "igClonotypeVariantID_num", "igClonotypeVariantID", "igSubcloneID_in_ClonotypeVariant_num", "igSubcloneID_in_Clonotype_num", "igSubcloneID", *[PUBLIC[f"V{i}"] for i in range(1, 10)]]


def annotate_folder(spark: SparkSession, folder: str, cfg: AnnotateConfig = AnnotateConfig(), samples: list[str] | None = None, cases: dict[str, str] | None = None, out: str | None = None) -> DataFrame:
    """Annotated contigs of the aligner's files; joint mode needs the case of each sample; written to ``out`` if given."""
    if cfg.analysis_mode == "joint" and not cases:
        raise ValueError("joint mode needs cases")
    log.info("annotating %s as %s", folder, cfg)
    got = annotate(read_aligned(spark, folder, samples, cases if cfg.analysis_mode == "joint" else None), cfg)
    if cfg.rescue_single_chain and cfg.data_type != "bulk":
        got = rescue_contigs(got, relaxed=cfg.relaxed_rescue)
    if out:
        write_annotated(got, out)
        log.info("written to %s", out)
        return spark.read.parquet(out)
    return got


def full_workflow(spark: SparkSession, paths: list[str], input_format: str, program: str, database: dict[str, str], cfg: AnnotateConfig = AnnotateConfig(), evalue: float | None = None, cases: dict[str, str] | None = None) -> DataFrame:
    """Raw files to annotated contigs, with the aligner run on the executors."""
    raw = read_table(spark, expand_paths(paths), input_format, cfg.data_type)
    unit = F.col("sample")
    if cfg.analysis_mode == "joint":
        unit = F.try_element_at(F.create_map(*[F.lit(x) for kv in (cases or {}).items() for x in kv]), F.col("sample"))
    got = annotate(run_aligner(raw, program, database, evalue).withColumn("unit", unit), cfg)
    return rescue_contigs(got, relaxed=cfg.relaxed_rescue) if cfg.rescue_single_chain and cfg.data_type != "bulk" else got


#: What stands before the rank in each number of a cell.
RANK_AFTER = {"igClonotypeVariantID_num": "CV", "igSubcloneID_in_ClonotypeVariant_num": "S", "igSubcloneID_in_Clonotype_num": r"\."}


def rescue_contigs(contigs: DataFrame, group: str | list[str] = "SampleID", relaxed: bool = False) -> DataFrame:
    """Annotated contigs with single-chain cells assigned to the one complete clonotype that holds them, then all ids anew.

    A rescued cell takes the clone and, of the complete cells that hold its chains, the variant and subclones of lowest rank.
    """
    g = columns(group)
    merged = "igClonotypeID" if relaxed else "igSubcloneID"
    fields = ["completeBCR", *NUMBERS]
    one = contigs.where(F.col("barcode").isNotNull()).groupBy(*g, "barcode").agg(*[F.max(c).alias(c) for c in (*fields, merged)])
    got = rescue_single_chains(one, g, merged, NUMBERS[0], numbers=RANK_AFTER).drop(merged)
    rescued = contigs.drop(*fields).join(got, [*g, "barcode"], "left").select(*contigs.columns)
    return recalculate_cells(written(rescued, "rescued"), g)


def combine(cells: DataFrame, contigs: DataFrame, cell_sample: str = "SampleID", contig_sample: str = "SampleID", barcode: str = "barcode") -> DataFrame:
    """The cell table with its cells' fields and four chain slots; every cell stays, one without contigs has nulls."""
    require_columns(contigs, [contig_sample, "barcode", "ClonotypeID"])
    slots = [c for c in SLOT_COLUMNS if c in contigs.columns]
    fields = [c for c in CELL_COLUMNS if c in contigs.columns]
    wide = cells_wide(contigs, slots, [contig_sample, "barcode"])
    own = contigs.where(F.col("barcode").isNotNull()).groupBy(contig_sample, "barcode").agg(*[F.max(c).alias(c) for c in fields], sorted_join("SubcloneID").alias("igSubcloneID_all"))
    both = own.join(wide, [contig_sample, "barcode"], "left").withColumnsRenamed({contig_sample: "_sample", "barcode": "_barcode"})
    clash = [c for c in both.columns if c in cells.columns]
    return cells.drop(*clash).join(both, (F.col(cell_sample) == F.col("_sample")) & (F.col(barcode) == F.col("_barcode")), "left").drop("_sample", "_barcode")


def mission_bio_cells(contigs: DataFrame, barcodes: DataFrame) -> DataFrame:
    """One row per barcode: its class and the chain slots of supported cells, nulls for the others (Not_supported if their contigs say so)."""
    keys = ["SampleID", "barcode"]
    lost = F.coalesce(F.col("completeBCR") == "Not_supported", F.lit(False))
    wide = cells_wide(contigs.where(F.col("completeBCR").isNotNull() & ~lost), [c for c in SLOT_COLUMNS if c in contigs.columns], keys)
    kinds = contigs.where(F.col("barcode").isNotNull()).groupBy(*keys).agg(F.max("completeBCR").alias("completeBCR"))
    return with_unsupported(wide, barcodes, keys).join(kinds, keys, "left")


def recalculate(df: DataFrame, group: str | list[str] = "SampleID") -> DataFrame:
    """New ranks and frequencies after rows were removed: bulk if it has reads, else cells."""
    return recalculate_bulk(df, group) if "Subclone_nReads" in df.columns else recalculate_cells(df, group)


def remove_contamination(flagged: DataFrame, group: str | list[str] = "SampleID") -> DataFrame:
    """Only the rows flagged PASS, with their ids and frequencies anew within ``group``."""
    return recalculate(written(keep_passed(flagged), "passed"), group)


def remove_contaminated_cells(contigs: DataFrame, flagged: DataFrame, group: str | list[str] = "SampleID") -> DataFrame:
    """Contigs of the cells flagged PASS (rows without a barcode go), with all their ids anew."""
    keys = [*columns(group), "barcode"]
    left = contigs.join(keep_passed(flagged).select(*keys).distinct(), keys, "left_semi")
    return recalculate_cells(written(left, "passed"), group)
