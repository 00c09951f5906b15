"""From aligner output to the working table: projection, filters, composition, unique sequences.

Nulls: a missing region counts as empty, a missing boolean as false. Empty tables stay empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repspark.functions.sequences import as_bool, compose_vdj, read_count, v_genes

#: The regions in order, the columns that the aligner's output must have, and the primer sets.
REGIONS = ["fwr1", "cdr1", "fwr2", "cdr2", "fwr3", "cdr3", "fwr4"]
REQUIRED = ["sequence_id", "productive", "complete_vdj", "v_call", "d_call", "j_call", "c_call", *REGIONS, "v_identity", "junction", "junction_aa", "junction_aa_length", "sequence", "sequence_alignment", "germline_alignment", "sample"]
PRIMERS = ("full_length", "fr1", "fr2", "fr3", "missionbio")


def require_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by ``order`` (then by all other columns); a null key is a key. Aggregated, so no group is sorted."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    best = df.groupBy(*keys).agg(F.min(F.struct(*order, *rest)).alias("_r"))
    return best.select(*[c if c in keys else F.col(f"_r.{c}").alias(c) for c in df.columns])


def primer_complete(mode: str) -> Column:
    """Whether the regions that the primer set should cover are there, and complete_vdj fits."""
    has = {r: F.coalesce(F.trim(F.col(r)) != "", F.lit(False)) for r in REGIONS}
    whole = F.coalesce(as_bool("complete_vdj"), F.lit(False))

    def all_of(names: list[str], want: bool) -> Column:
        out = F.lit(True)
        for n in names:
            out = out & (has[n] if want else ~has[n])
        return out

    if mode == "full_length":
        return all_of(REGIONS, True) & whole
    if mode == "fr1":
        return all_of(REGIONS, True) & ~whole
    if mode == "fr2":
        return all_of(REGIONS[:2], False) & all_of(REGIONS[2:], True) & ~whole
    if mode == "fr3":
        return all_of(REGIONS[:4], False) & all_of(REGIONS[4:], True) & ~whole
    if mode == "missionbio":
        return F.coalesce(F.trim(F.col("v_call")) != "", F.lit(False)) | has["cdr3"]
    raise ValueError(f"v_primer is one of {', '.join(PRIMERS)}")


def tidy(df: DataFrame, material_type: str = "rna", v_primer: str = "full_length", extra: tuple[str, ...] = ()) -> DataFrame:
    """The working table: productive rows (rna or mission-bio), complete for the primer, with VDJ, VDJseq, arch and lengths."""
    if "c_call" not in df.columns:
        df = df.withColumn("c_call", F.lit(None).cast("string"))
    df = require_columns(df, REQUIRED).where(primer_complete(v_primer))
    ok = F.coalesce(as_bool("productive"), F.lit(False))
    if material_type == "rna" or v_primer == "missionbio":
        df = df.where(ok)
    elif material_type != "dna":
        raise ValueError("material_type is dna or rna")
    length = lambda r: F.coalesce(F.length(r), F.lit(0))
    six = [length(r) for r in REGIONS[:6]]
    before = sum(six[1:], six[0])
    arch = F.array(*six, F.greatest(F.lit(0), F.coalesce(F.length("sequence_alignment"), F.lit(0)) - before))
    return df.select(
        *[c for c in REQUIRED if c not in ("sequence_alignment", "productive")], *extra, F.col("sequence_alignment").alias("VDJseq"), compose_vdj("v_call", "d_call", "j_call").alias("VDJ"),
        arch.alias("arch"), (before - six[5]).alias("len_no_CDR3"), before.alias("len_yes_CDR3"), F.when(ok, "productive").otherwise("unproductive").alias("productive"),
    )


def with_read_counts(df: DataFrame, unit: list[str]) -> DataFrame:
    """n_reads from the id, if every id of the unit has one; else 1 for all of the unit. Whether it has is aggregated per unit and joined back."""
    n = read_count("sequence_id")
    lacking = df.where(n.isNull()).select(*[F.col(u).alias(f"_u{i}") for i, u in enumerate(unit)]).distinct().withColumn("_lacks", F.lit(True))
    on = F.lit(True)
    for i, u in enumerate(unit):
        on = on & F.col(u).eqNullSafe(F.col(f"_u{i}"))
    return df.join(lacking, on, "left").withColumn("n_reads", F.when(F.col("_lacks").isNull(), n).otherwise(F.lit(1).cast("bigint"))).drop("_lacks", *[f"_u{i}" for i in range(len(unit))])


def unique_sequences(df: DataFrame, unit: list[str], key: list[str], min_reads: int = 2) -> DataFrame:
    """One row per unit and sequence key with the reads of all its rows, the row of smallest id; fewer than ``min_reads`` drops it.

    A null part of the key is its own value. The reads are summed before the shuffle.
    """
    keys = [*unit, *key]
    others = [c for c in df.columns if c not in keys and c not in ("n_reads", "sequence_id")]
    first = F.min_by(F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(others)]), "sequence_id").alias("r") if others else F.lit(None).alias("r")
    out = df.groupBy(*keys).agg(F.sum("n_reads").alias("total_reads_unique_seq"), F.min("sequence_id").alias("sequence_id"), first)
    return out.where(F.col("total_reads_unique_seq") >= min_reads).select("sequence_id", *keys, *[F.col(f"r.c{i}").alias(c) for i, c in enumerate(others)], "total_reads_unique_seq")


def modal_length(df: DataFrame, group: list[str], seq: str | Column) -> DataFrame:
    """Rows whose sequence (a column's name, or an expression of its length) has the most frequent length of the group; of tied lengths the smallest."""
    df = df.withColumn("_len", F.length(seq) if isinstance(seq, str) else seq)
    counts = df.groupBy(*group, "_len").agg(F.count(F.lit(1)).alias("_n"))
    best = counts.groupBy(*group).agg(F.max_by("_len", F.struct("_n", -F.col("_len"))).alias("_len"))
    on = [df[g].eqNullSafe(best[g]) for g in group]
    cond = df["_len"].eqNullSafe(best["_len"])
    for c in on:
        cond = cond & c
    return df.join(best, cond, "left_semi").drop("_len")


def first_gene(v_call: Column | str) -> Column:
    return F.try_element_at(v_genes(v_call), F.lit(1))
