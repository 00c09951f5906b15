"""Places of rows within groups of any size, and group columns given as one name or several."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repspark.runtime import written


def columns(group: str | list[str]) -> list[str]:
    """The columns of a group key; several together are one key, equal where each is."""
    return [group] if isinstance(group, str) else list(group)


def join_same(df: DataFrame, other: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """``df`` joined to ``other`` where all ``keys`` are the same, null to null; ``other`` brings its other columns only."""
    names = {k: f"_same{i}" for i, k in enumerate(keys)}
    on = F.lit(True)
    for k, n in names.items():
        on = on & F.col(k).eqNullSafe(F.col(n))
    return df.join(other.withColumnsRenamed(names), on, how).drop(*names.values())


def numbered(df: DataFrame, keys: list[str], order: list[Column], name: str) -> DataFrame:
    """Rows with ``name``: their place from 1 within ``keys`` in a total ``order``; a null key is a key.

    Rows are range-partitioned by keys and order and written, so a group of any size is spread over tasks. Of each
    partition only the first group can have begun in an earlier one, so at most one offset per partition is broadcast.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = written(df.repartitionByRange(n, *[F.col(k) for k in keys], *order).withColumn("_part", F.spark_partition_id()), "order")
    counts = laid.groupBy("_part", *keys).agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.withColumn("_before", F.sum("_n").over(earlier)).where("_before > 0")
    before = before.select(F.col("_part").alias("_p"), "_before")
    first = Window.partitionBy("_part", *keys).orderBy(*order)
    rows = laid.withColumn("_place", F.row_number().over(first))
    # the group that goes on from an earlier partition is the one that stands first in this one
    began = counts.groupBy("_part").agg(F.min(F.struct(*keys)).alias("_first")).withColumnRenamed("_part", "_p")
    offsets = F.broadcast(before.join(began, "_p"))
    cond = (F.col("_part") == F.col("_p")) & F.struct(*keys).eqNullSafe(F.col("_first"))
    return rows.join(offsets, cond, "left").withColumn(name, (F.col("_place") + F.coalesce("_before", F.lit(0))).cast("int")).drop("_part", "_p", "_place", "_before", "_first")
