"""Cells: chains per cell, their combinations, completeness, igclonotypes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repspark.functions.sequences import sorted_join
from repspark.kernels.cells import resolve
from repspark.operators.clonotypes import dotted, rank_set
from repspark.operators.ranks import numbered as ranked
from repspark.operators.tidy import first_per_key
from repspark.runtime import map_groups, written


def drop_repeated_chains(df: DataFrame, unit: str = "unit", order: str = "sequence_id") -> DataFrame:
    """Per cell and chain clonotype the first contig; rows without a barcode or clonotype stay."""
    keyed = F.col("barcode").isNotNull() & F.col("clonotypeID").isNotNull()
    return first_per_key(df.where(keyed), [unit, "barcode", "clonotypeID"], [order]).unionByName(df.where(~keyed))


def merged_ids(df: DataFrame, unit: str = "unit", also: tuple[Column, ...] = ()) -> DataFrame:
    """(unit, barcode, merge_clonotypeID, merge_clonotypeVariantID, merge_subcloneID, n_chains, heavy, light, the aggregates ``also``): one row per cell."""
    lead = F.substring("clonotypeID", 1, 3)
    return df.where(F.col("barcode").isNotNull()).groupBy(unit, "barcode").agg(
        sorted_join("clonotypeID").alias("merge_clonotypeID"), sorted_join("clonotypeVariantID_in_Cltp").alias("merge_clonotypeVariantID"), sorted_join("Unique_SequenceID").alias("merge_subcloneID"),
        F.count("clonotypeID").alias("n_chains"), F.count_if(lead == "IGH").alias("heavy"), F.count_if(lead.isin("IGK", "IGL")).alias("light"), *also,
    )


def initial_class(cells: DataFrame, mission_bio: bool = False) -> DataFrame:
    """Cells with completeBCR from the number of chains and their kinds."""
    n, h, lt = F.col("n_chains"), F.col("heavy"), F.col("light")
    both = (h > 0) & (lt > 0)
    c = (
        F.when(n == 1, "Single_chain_1").when((n == 2) & ~both, "Single_chain_2").when(n.isin(3, 4) & ~both, "Not_supported")
        .when((n == 4) & ((h > 2) | (lt > 2)), "Not_supported").when(n > 4, "Not_supported").otherwise("Yes")
    )
    if mission_bio:
        c = F.when((h > 1) & (c != "Not_supported"), "Potential_MB_doublet").otherwise(c)
    return cells.withColumn("completeBCR", c)


def resolve_classes(cells: DataFrame, unit: str = "unit", mission_bio: bool = False) -> DataFrame:
    """Cells with the final completeBCR and igclonotypeID; only the distinct combinations of a unit, with their contig counts, reach Python."""
    cells = written(cells, "cells")
    combos = cells.groupBy(unit, "merge_clonotypeID", "completeBCR").agg(F.sum("n_chains").alias("n"))

    def run(g: dict[str, list]) -> list[tuple]:
        got = resolve(list(zip(g["merge_clonotypeID"], g["completeBCR"], g["n"])), mission_bio)
        return [(g[unit][0], *k, *got[k]) for k in sorted(got)]

    out = written(map_groups(combos, [unit], run, f"{unit} string, merge_clonotypeID string, completeBCR string, igclonotypeID string, _final string"), "classes")
    return cells.join(out, [unit, "merge_clonotypeID", "completeBCR"], "left").withColumn("completeBCR", F.coalesce("_final", "completeBCR")).drop("_final")


def relabel_chains(df: DataFrame, unit: str = "unit") -> DataFrame:
    """Contigs (with completeBCR and igclonotypeID of their cell) whose chain clonotype serves several igclonotypes, split into x1, x2, ...

    The igclonotypes that a chain has among Yes cells are numbered by contigs, then name; every contig of such
    an igclonotype takes its number, other Yes contigs keep their id. A contig left takes the label most Yes
    contigs of its variant have; a tie gives xNA and a number within the variant. A contig whose variant no
    Yes cell has, taken by sequence_id: the id itself if its chain has at most one label, but from the first
    Single_chain_1 on that meets one label, all before become x1 and the rest x2, x3, ...; if the chain has
    n > 1 labels they become x(n+1), x(n+2), ...
    """
    cols = df.columns
    chain, variant = [unit, "clonotypeID"], [unit, "clonotypeID", "clonotypeVariantID_in_Cltp"]
    yes = F.coalesce(F.col("completeBCR") == "Yes", F.lit(False))
    label = lambda *x: F.concat(F.col("clonotypeID"), *[F.lit(c) if isinstance(c, str) else c.cast("string") for c in x])
    # 1, 2: labels by igclonotype
    counts = df.where(yes & F.col("igclonotypeID").isNotNull()).groupBy(*chain, "igclonotypeID").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*chain)
    numbers = counts.withColumn("_k", F.row_number().over(w.orderBy(F.col("_n").desc(), "igclonotypeID"))).withColumn("_of", F.count(F.lit(1)).over(w)).where("_of > 1").drop("_n", "_of")
    df = df.join(numbers, [*chain, "igclonotypeID"], "left")
    df = written(df.withColumn("_new", F.when(F.col("_k").isNotNull(), label("x", F.col("_k"))).when(yes, F.col("clonotypeID"))).drop("_k"), "labels")
    # 3: labels by the votes of the variant
    votes = df.where(yes & F.col("_new").isNotNull()).groupBy(*variant, "_new").agg(F.count(F.lit(1)).alias("_n"))
    best = votes.groupBy(*variant).agg(F.max("_n").alias("_max"))
    v = votes.join(best, variant).where("_n = _max").groupBy(*variant).agg(F.count(F.lit(1)).alias("_tied"), F.min("_new").alias("_vote"))
    df = df.join(v, variant, "left").withColumn("_new", F.coalesce("_new", F.when(F.col("_tied") == 1, F.col("_vote"))))
    order = [F.col("sequence_id")]
    tie = F.col("_new").isNull() & F.coalesce(F.col("_tied") > 1, F.lit(False))
    tied = ranked(df.where(tie), variant, order, "_i").withColumn("_new", label("xNA", F.col("_i"))).drop("_i")
    df = df.where(~tie).unionByName(tied).drop("_tied", "_vote")
    # 4: the rest, in order within the chain
    known = df.where(F.col("_new").isNotNull()).select(*chain, "_new").distinct().groupBy(*chain).agg(F.count(F.lit(1)).alias("_labels"))
    df = df.join(known, chain, "left").withColumn("_labels", F.coalesce("_labels", F.lit(0)))
    left = F.col("_new").isNull() & F.col("clonotypeID").isNotNull()
    rest = ranked(df.where(left), chain, order, "_i")
    few = F.col("_labels") <= 1
    turn = rest.where(few & (F.col("completeBCR") == "Single_chain_1") & (F.col("_i") + F.col("_labels") > 1)).groupBy(*chain).agg(F.min("_i").alias("_s"))
    df = df.where(~left).withColumn("_i", F.lit(None).cast("int")).unionByName(rest).join(turn, chain, "left")
    named = (
        F.when(F.col("_i").isNotNull() & ~few, label("x", F.col("_labels") + F.col("_i")))
        .when(F.col("_i").isNotNull() & (F.col("_i") >= F.col("_s")), label("x", F.col("_i") - F.col("_s") + 2))
        .when(few & F.col("_s").isNotNull(), label("x1"))
        .otherwise(F.coalesce("_new", "clonotypeID"))
    )
    return df.withColumn("clonotypeID", named).select(*cols)


def numbered(df: DataFrame, unit: str = "unit", by: str | None = None) -> DataFrame:
    """Rows with the ranks of variants and subclones of igclonotypes (C1.CV1, C1.CV1.S1, C1.1) by rows, or by summed ``by`` (the contigs of a row's cell); null without an igclonotype."""
    has = F.col("igclonotypeID").isNotNull()
    key = lambda c: F.when(has, F.col(c))
    df = df.withColumn("_v", key("merge_clonotypeVariantID")).withColumn("_s", key("merge_subcloneID"))
    top = [unit, "igclonotypeID"]
    df = rank_set(df, [(top, "_v", "_cv", "CV"), ([*top, "_v"], "_s", "_sc", "S"), (top, "_s", "_sn", "")], by)
    df = df.withColumn("igclonotypeVariantID", dotted("igclonotypeID", "_cv"))
    df = df.withColumn("igsubcloneID_in_clonotypeVariant", dotted("igclonotypeVariantID", "_sc")).withColumn("igsubcloneID_in_clonotype", dotted("igclonotypeID", "_sn"))
    return df.drop("_v", "_s", "_cv", "_sc", "_sn")


def chain_values(contigs: DataFrame, columns: list[str], unit: str = "unit", unsupported: str = "Not_supported", separators: dict[str, str] | None = None) -> DataFrame:
    """(unit, barcode, one joined string per column): per cell the values of its own chains in subclone order, a null as NA; null for unsupported cells.

    Values are joined by '_', those of a column in ``separators`` by what stands there.
    """
    ok = F.col("completeBCR").isNull() | (F.col("completeBCR") != unsupported)
    rows = contigs.where(F.col("barcode").isNotNull() & F.col("Unique_SequenceID").isNotNull()).groupBy(unit, "barcode").agg(
        F.array_sort(F.collect_list(F.struct("Unique_SequenceID", *[F.coalesce(F.col(c).cast("string"), F.lit("NA")).alias(c) for c in columns]))).alias("x"), F.max("completeBCR").alias("completeBCR")
    )
    return rows.select(unit, "barcode", *[F.when(ok, F.array_join(F.col(f"x.{c}"), (separators or {}).get(c, "_"))).alias(c) for c in columns])
