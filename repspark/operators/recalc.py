"""Ranks and frequencies anew after rows were removed, and rescue of single-chain cells.

A ``group`` is one column or several, taken together. Totals are aggregated per key and joined back, so a hot group
is never in one task; places of subclones are taken by ``ranks.numbered``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repspark.operators.clonotypes import dotted, rank_set
from repspark.operators.ranks import columns, join_same, numbered
from repspark.runtime import written


def recalculate_bulk(df: DataFrame, group: str | list[str] = "SampleID", reads: str = "Subclone_nReads", keep_locus: bool = False) -> DataFrame:
    """Rows with clonotype reads and frequencies recomputed and ids renumbered in the group, by reads descending, then old id.

    Needs one row per subclone. The new clonotype id has no locus unless ``keep_locus``. Variant
    frequencies use the old ClonotypeVariant_nReads, each variant counted once.
    """
    g = columns(group)
    variants = df.groupBy(*g, "ClonotypeID", "ClonotypeVariantID").agg(F.sum(reads).alias("_rv"), F.max("ClonotypeVariant_nReads").alias("_vr"))
    variants = written(variants, "variants")
    clones = variants.groupBy(*g, "ClonotypeID").agg(F.sum("_rv").alias("_r"), F.sum("_vr").alias("_vt"))
    totals = clones.groupBy(*g).agg(F.sum("_r").alias("_t"))
    w = Window.partitionBy(*g).orderBy(F.col("_r").desc(), "ClonotypeID")
    clones = join_same(clones, totals, g).withColumn("_c", F.concat(F.lit("C"), F.row_number().over(w).cast("string")))
    clones = clones.withColumn("_new", dotted(F.substring_index("ClonotypeID", ".", 1), "_c") if keep_locus else F.col("_c"))
    w = Window.partitionBy(*g, "ClonotypeID").orderBy(F.col("_vr").desc(), "ClonotypeVariantID")
    both = join_same(variants, clones, [*g, "ClonotypeID"]).withColumn("_cv", F.concat("_new", F.lit(".CV"), F.row_number().over(w).cast("string"))).drop("_c")
    order = [F.col(reads).desc(), F.col("SubcloneID")]
    rows = numbered(numbered(df, [*g, "ClonotypeID", "ClonotypeVariantID"], order, "_s"), [*g, "ClonotypeID"], order, "_k")
    rows = join_same(rows, both, [*g, "ClonotypeID", "ClonotypeVariantID"])
    percent = lambda part, whole: part * 100.0 / whole
    new = {
        "Clonotype_nReads": F.col("_r"), "Clonotype_freq": percent(F.col("_r"), F.col("_t")), "ClonotypeVariant_freq": percent(F.col("_vr"), F.col("_vt")), "Subclone_freq_in_Clonotype": percent(F.col(reads), F.col("_r")),
        "Subclone_freq_in_ClonotypeVariant": percent(F.col(reads), F.col("_rv")), "ClonotypeID": F.col("_new"), "ClonotypeVariantID": F.col("_cv"), "SubcloneID": F.concat("_cv", F.lit(".S"), F.col("_s").cast("string")),
        "SubcloneID_in_Clonotype": F.concat("_new", F.lit("."), F.col("_k").cast("string")),
    }
    return rows.withColumns(new).drop("_rv", "_vr", "_r", "_vt", "_t", "_new", "_cv", "_s", "_k")


def base_id(clonotype: Column) -> Column:
    return F.regexp_replace(clonotype, "x(NA)?[0-9]+$", "")


MERGED = {"igClonotypeID": ("ClonotypeID", "_new"), "igClonotypeVariantID": ("ClonotypeVariantID", "_newcv"), "igSubcloneID": ("SubcloneID", "_newsub")}
NUMBERS = ["igClonotypeID_num", "igClonotypeVariantID_num", "igSubcloneID_in_ClonotypeVariant_num", "igSubcloneID_in_Clonotype_num"]


def new_chain_ids(df: DataFrame, group: str | list[str] = "SampleID") -> DataFrame:
    """(group, ClonotypeID, ClonotypeVariantID, SubcloneID, _new, _newcv, _newsub): the new chain ids of each old one.

    Chains are re-ranked per locus by contigs; ids of one base keep one new number with x1..xn by contigs, xNA stays;
    variants and subclones follow their parent. A null ClonotypeID has no new ids.
    """
    g = columns(group)
    n = df.where(F.col("ClonotypeID").isNotNull()).groupBy(*g, "ClonotypeID", "ClonotypeVariantID", "SubcloneID").agg(F.count(F.lit(1)).alias("_n"))
    c = F.col("ClonotypeID")
    n = n.withColumns({"_base": base_id(c), "_locus": F.substring(c, 1, 3), "_suffix": F.regexp_extract(c, "(x(?:NA)?[0-9]+)$", 1)})
    n = rank_set(n, [([*g, "_locus"], "_base", "_c", "C")], by="_n")
    parts = n.where(F.col("_suffix").rlike("^x[0-9]+$")).groupBy(*g, "_base", "_suffix").agg(F.sum("_n").alias("_p"))
    w = Window.partitionBy(*g, "_base")
    parts = parts.withColumn("_x", F.row_number().over(w.orderBy(F.col("_p").desc(), "_suffix"))).withColumn("_of", F.count(F.lit(1)).over(w)).drop("_p")
    n = n.join(parts, [*g, "_base", "_suffix"], "left")
    suffix = F.when(F.col("_suffix").startswith("xNA"), F.col("_suffix")).when(F.col("_of") > 1, F.concat(F.lit("x"), F.col("_x").cast("string"))).otherwise("")
    n = n.withColumn("_new", F.concat("_locus", F.lit("."), "_c", suffix))
    n = rank_set(n, [([*g, "_new"], "ClonotypeVariantID", "_v", "CV"), ([*g, "_new", "ClonotypeVariantID"], "SubcloneID", "_s", "S")], by="_n")
    n = n.withColumn("_newcv", dotted("_new", "_v")).withColumn("_newsub", dotted("_newcv", "_s"))
    return n.select(*g, "ClonotypeID", "ClonotypeVariantID", "SubcloneID", "_new", "_newcv", "_newsub")


def recalculate_cells(df: DataFrame, group: str | list[str] = "SampleID") -> DataFrame:
    """Contigs with all their ids anew: the chain's own (``new_chain_ids``), the merged ones and the numbers of the cell.

    Needs ClonotypeID, ClonotypeVariantID, SubcloneID and barcode. Of the merged ids (igClonotypeID, igClonotypeVariantID,
    igSubcloneID) that are there, each element is replaced by its new id, in the old order; one that no row of the group
    has any more is written NA. The numbers (NUMBERS), where there, are re-ranked by distinct cells (``recalculate_numbers``).
    """
    g = columns(group)
    ids = written(new_chain_ids(df, g), "new-ids")
    old = ["ClonotypeID", "ClonotypeVariantID", "SubcloneID"]
    out = join_same(df, ids, [*g, *old])
    for name, (part, new) in MERGED.items():
        if name not in df.columns:
            continue
        own = ids.where(F.col(part).isNotNull()).groupBy(*g, F.col(part).alias("_x")).agg(F.min(new).alias("_to"))
        each = df.where(F.col(name).isNotNull()).select(*g, name).distinct().select(*g, name, F.posexplode(F.split(name, "-")).alias("_i", "_x"))
        new_name = join_same(each, own, [*g, "_x"]).groupBy(*g, name).agg(F.array_sort(F.collect_list(F.struct("_i", F.coalesce("_to", F.lit("NA")).alias("t")))).alias("_l"))
        new_name = new_name.select(*g, name, F.array_join(F.col("_l.t"), "-").alias("_merged"))
        out = join_same(out, new_name, [*g, name]).withColumn(name, F.col("_merged")).drop("_merged")
    out = out.withColumns({"ClonotypeID": F.col("_new"), "ClonotypeVariantID": F.col("_newcv"), "SubcloneID": F.col("_newsub")}).drop("_new", "_newcv", "_newsub")
    if not set(NUMBERS) <= set(df.columns):
        return out
    cells = df.where(F.col("barcode").isNotNull()).groupBy(*g, "barcode").agg(*[F.max(c).alias(c) for c in NUMBERS])
    return join_same(out.drop(*NUMBERS), recalculate_numbers(cells, g), [*g, "barcode"]).select(*df.columns)


def recalculate_numbers(cells: DataFrame, group: str | list[str], clone: str = NUMBERS[0], variant: str = NUMBERS[1], in_variant: str = NUMBERS[2], in_clone: str | None = NUMBERS[3]) -> DataFrame:
    """Cells (one row each) with the numbers of clone, variant and subclone re-ranked by cells, ties by old number: C1, C1.CV1, C1.CV1.S1, C1.1; null stays null."""
    g = columns(group)
    ranks = [(g, clone, "_c", "C"), ([*g, clone], variant, "_v", "CV"), ([*g, clone, variant], in_variant, "_s", "S")]
    if in_clone:
        ranks.append(([*g, clone], in_clone, "_k", ""))
    out = rank_set(cells, ranks)
    out = out.withColumn("_cv", dotted("_c", "_v"))
    new = {clone: F.col("_c"), variant: F.col("_cv"), in_variant: dotted("_cv", "_s")} | ({in_clone: dotted("_c", "_k")} if in_clone else {})
    return out.withColumns(new).drop("_c", "_v", "_cv", "_s", "_k")


def rescue_single_chains(cells: DataFrame, group: str | list[str], merged: str, clone: str, single: tuple[str, ...] = ("Single_chain_1", "Single_chain_2"), numbers: dict[str, str] | None = None) -> DataFrame:
    """Cells whose single-chain combination lies in complete (Yes) cells of exactly one clone get it and Yes_rescue.

    ``merged`` is the combination compared: subclone ids joined by '-', or clonotype ids when relaxed. Two
    chains must stand side by side in the complete one. All runs of one and two chains of the complete
    combinations are spelled out (at most 7 each), so the match is an equi-join of distinct combinations.
    ``numbers`` maps a column to what stands before its rank; of those of the complete cells that hold the combination
    the one of lowest rank is taken.
    """
    g, numbers = columns(group), numbers or {}
    full = cells.where((F.col("completeBCR") == "Yes") & F.col(clone).isNotNull() & F.col(merged).isNotNull()).select(*g, merged, clone, *numbers).distinct()
    parts = F.split(merged, "-")
    runs = F.concat(parts, F.when(F.size(parts) > 1, F.zip_with(F.slice(parts, F.lit(1), F.size(parts) - 1), F.slice(parts, F.lit(2), F.size(parts) - 1), lambda a, b: F.concat_ws("-", a, b))).otherwise(F.array().cast("array<string>")))
    known = full.select(*g, F.explode(F.array_distinct(F.concat(runs, F.array(F.col(merged))))).alias("_run"), clone, *numbers)
    rank = lambda c, before: F.regexp_extract(c, f"{before}([0-9]+)$", 1).try_cast("bigint")
    lowest = [F.min_by(c, F.struct(F.coalesce(rank(c, before), F.lit(1 << 62)), F.col(c))).alias(f"_n{i}") for i, (c, before) in enumerate(numbers.items())]
    one = known.groupBy(*g, "_run").agg(F.min(clone).alias("_clone"), F.max(clone).alias("_last"), *lowest).where("_clone = _last").drop("_last")
    want = F.when(F.col("completeBCR").isin(*single), F.col(merged))
    joined = cells.withColumn("_run", want).join(one, [*g, "_run"], "left")
    hit = F.col("_clone").isNotNull()
    new = {clone: F.coalesce("_clone", clone), "completeBCR": F.when(hit, "Yes_rescue").otherwise(F.col("completeBCR"))}
    new |= {c: F.when(hit, F.col(f"_n{i}")).otherwise(F.col(c)) for i, c in enumerate(numbers)}
    return joined.withColumns(new).drop("_run", "_clone", *[f"_n{i}" for i in range(len(numbers))])
