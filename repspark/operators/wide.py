"""Contigs to one row per cell with four chain slots, and back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLOTS = ["IGH1", "IGH2", "IGL1", "IGL2"]


def cells_wide(contigs: DataFrame, columns: list[str], keys: list[str], chain_id: str = "ClonotypeID") -> DataFrame:
    """One row per cell: the first two heavy and the first two light chains in id order, their columns prefixed with the slot; empty slots are null."""
    item = F.struct(F.col(chain_id).alias("_id"), *[F.col(c) for c in columns])
    heavy = F.substring(chain_id, 1, 3) == "IGH"
    light = F.substring(chain_id, 1, 3).isin("IGK", "IGL")
    fit = contigs.where(F.col(keys[-1]).isNotNull() & F.col(chain_id).isNotNull())
    cells = fit.groupBy(*keys).agg(F.array_sort(F.collect_list(F.when(heavy, item))).alias("h"), F.array_sort(F.collect_list(F.when(light, item))).alias("l"), F.count(F.lit(1)).alias("n_contigs"))
    slot = {"IGH1": F.try_element_at("h", F.lit(1)), "IGH2": F.try_element_at("h", F.lit(2)), "IGL1": F.try_element_at("l", F.lit(1)), "IGL2": F.try_element_at("l", F.lit(2))}
    return cells.select(*keys, "n_contigs", *[x[c].alias(f"{s}_{c}") for s, x in slot.items() for c in columns])


def cells_long(cells: DataFrame, columns: list[str], keys: list[str]) -> DataFrame:
    """The inverse: one row per filled slot, contig_id = the cell and its place."""
    slots = F.array(*[F.struct(F.lit(i + 1).alias("k"), F.lit(s).alias("slot"), *[F.col(f"{s}_{c}").alias(c) for c in columns]) for i, s in enumerate(SLOTS)])
    rows = cells.select(*keys, F.explode(F.filter(slots, lambda x: x[columns[0]].isNotNull())).alias("x"))
    return rows.select(*keys, F.concat_ws("_", keys[-1], F.col("x.k").cast("string")).alias("contig_id"), "x.slot", *[f"x.{c}" for c in columns])


def with_unsupported(cells: DataFrame, barcodes: DataFrame, keys: list[str]) -> DataFrame:
    """Cells, and a row of nulls for each barcode that has none (the per-barcode table of mission-bio)."""
    missing = barcodes.select(*keys).distinct().join(cells.select(*keys), keys, "left_anti")
    return cells.unionByName(missing, allowMissingColumns=True)
