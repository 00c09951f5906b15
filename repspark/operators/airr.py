"""The AIRR rearrangement table of annotated contigs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repspark.functions.sequences import locus, region_bounds, slice_string, translate_nt

#: The fields of the table, in order.
FIELDS = [
    "sequence_id", "sequence", "locus", "productive", "rev_comp", "junction", "junction_aa", "junction_length", "v_call", "d_call", "j_call", "c_call",
    "sequence_alignment", "sequence_alignment_aa", "germline_alignment", "germline_alignment_aa", "v_cigar", "d_cigar", "j_cigar",
    "fwr1", "fwr1_aa", "cdr1", "cdr1_aa", "fwr2", "fwr2_aa", "cdr2", "cdr2_aa", "fwr3", "fwr3_aa", "cdr3", "cdr3_aa", "fwr4", "fwr4_aa",
    "fwr1_start", "fwr1_end", "cdr1_start", "cdr1_end", "fwr2_start", "fwr2_end", "cdr2_start", "cdr2_end", "fwr3_start", "fwr3_end", "cdr3_start", "cdr3_end", "fwr4_start", "fwr4_end",
    "duplicate_count", "clone_id", "sample_id",
]


def to_airr(df: DataFrame, germline: str = "masked", sample: str = "SampleID", metadata: list[str] | None = None) -> DataFrame:
    """50 fields (51 with cell_id for cells) and the metadata columns; each row keeps its own counts, clone and sample.

    Marks after a gene call ([R110], [... AGS ...]) are cut from it. Null positions give null regions.
    """
    if germline not in ("masked", "consensus"):
        raise ValueError("germline is masked or consensus")
    unknown = [c for c in metadata or [] if c not in df.columns]
    if unknown:
        raise ValueError(f"unknown metadata columns: {', '.join(unknown)}")
    bulk, single = "Subclone_nReads" in df.columns, "completeBCR" in df.columns
    if not bulk and not single:
        raise ValueError("neither bulk (Subclone_nReads) nor single-cell (completeBCR) fields")
    seq, germ = F.col("VDJ_sequence_correctedCDR3"), F.col("IgBlast_Germline_alignment" if germline == "masked" else "Consensus_Germline")
    # columns of their own, so that the regions are cut from them and don't translate again
    df = df.withColumns({"_aa": translate_nt(seq), "_germ_aa": translate_nt(germ), "_arch": F.transform(F.split("VDJ_positions", "-"), lambda x: x.try_cast("int"))})
    aa, arch = F.col("_aa"), F.col("_arch")
    calls = F.split(F.regexp_replace("VDJ_genes", r"\[.*$", ""), "/")
    second, third = F.try_element_at(calls, F.lit(2)), F.try_element_at(calls, F.lit(3))
    short = F.coalesce(second.rlike("IG[HKL]J"), F.lit(False))
    out = {
        "sequence_id": F.col("contig_id"), "sequence": F.col("Raw_sequence"), "locus": locus(calls[0]), "productive": F.when(F.col("Functionality") == "productive", "T").otherwise("F"), "rev_comp": F.lit("F"),
        "junction_aa": F.col("Junction_aa"), "v_call": calls[0], "d_call": F.when(short, F.lit("")).otherwise(F.coalesce(second, F.lit(""))), "j_call": F.when(short, second).otherwise(F.coalesce(third, F.lit(""))),
        "c_call": F.col("C_gene"), "sequence_alignment": seq, "sequence_alignment_aa": aa, "germline_alignment": germ, "germline_alignment_aa": F.col("_germ_aa"),
        "v_cigar": F.lit(""), "d_cigar": F.lit(""), "j_cigar": F.lit(""), "sample_id": F.col(sample),
    }
    bounds = region_bounds(arch)
    last = F.lit(0)
    for name, start, end in bounds:
        end = F.length(seq) if name == "fwr4" else end
        out |= {f"{name}_start": start, f"{name}_end": end, name: slice_string(seq, start, end)}
        aa_end = F.length(aa) if name == "fwr4" else F.floor(end / 3)
        out[f"{name}_aa"] = slice_string(aa, F.floor(last / 3) + 1, aa_end)
        last = end
    cdr3 = bounds[5]
    out["junction"] = slice_string(seq, F.greatest(F.lit(1), cdr3[1] - 3), cdr3[2] + 3)
    out["junction_length"] = F.length(out["junction"])
    out["duplicate_count"] = F.col("Subclone_nReads").cast("bigint") if bulk else F.lit(1).cast("bigint")
    out["clone_id"] = F.col("ClonotypeID") if bulk else F.col("igClonotypeID")
    extra = [] if bulk else [F.col("barcode").alias("cell_id")]
    return df.select(*[out[f].alias(f) for f in FIELDS], *extra, *(metadata or []))
