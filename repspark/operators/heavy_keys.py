"""Per-key results when a few keys hold most rows.

``detect_heavy`` finds every key above a share of the rows with a mergeable frequent-items sketch.
``per_key_summary`` sends rows of those keys through a broadcast join and a two-level aggregation
keyed by (key, spread column), all other rows through an ordinary shuffle, and unions both.
``skew_join`` joins any per-key table to the rows in the same way.

Nulls: a null key is no key and gives no result row. Empty tables give empty results. Ties and
repeated rows count as they stand: every row counts.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Slots of the sketch. Its error is below 3.5 / SKETCH_ITEMS of the rows, so it finds each key above that share.
SKETCH_ITEMS = 10_000


def detect_heavy(df: DataFrame, key: str, share: float, items: int = SKETCH_ITEMS) -> list[tuple]:
    """[(key, estimated rows)] of each key that at least ``share`` of the rows with a key hold.

    One pass; partial sketches are merged, so no key's rows meet in one task. The sketch never
    estimates too low among the keys it lists, so no key of that share is missed; keys slightly
    below may be listed too. At most 1 / share + 3.5 * items keys can pass, so the list is bounded.
    """
    if share * items < 7:
        raise ValueError("share is below what a sketch of this size can tell")
    top = min(items, 4 * math.ceil(1 / share))
    got = df.where(F.col(key).isNotNull()).agg(F.expr(f"approx_top_k(`{key}`, {top}, {items})").alias("t"), F.count(F.lit(1)).alias("n")).first()
    return [(r[0], r[1]) for r in got["t"] or [] if r[0] is not None and r[1] >= share * got["n"]]


def per_key_summary(df: DataFrame, key: str, measure: str, spread: str, share: float = 0.01) -> DataFrame:
    """(key, n_rows, sum, n_distinct, heavy) for every key of ``df``.

    n_rows counts rows, sum adds ``measure`` (null if a key has no value), n_distinct counts the
    distinct non-null values of ``spread``; heavy says which way the key went.
    """
    spark = df.sparkSession
    rows = df.select(F.col(key).alias("k"), F.col(measure).alias("m"), F.col(spread).alias("s")).where(F.col("k").isNotNull())
    heavy = [k for k, _ in detect_heavy(rows, "k", share)]
    light_rows = rows
    heavy_out = None
    if heavy:
        keys = F.broadcast(spark.createDataFrame([(k,) for k in heavy], rows.select("k").schema))
        heavy_out = (
            rows.join(keys, "k", "left_semi")
            .groupBy("k", "s")
            .agg(F.count(F.lit(1)).alias("n"), F.sum("m").alias("m"))
            .groupBy("k")
            .agg(F.sum("n").alias("n_rows"), F.sum("m").alias("sum"), F.count("s").alias("n_distinct"))
            .withColumn("heavy", F.lit(True))
        )
        light_rows = rows.join(keys, "k", "left_anti")
    light = (
        light_rows.groupBy("k").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("m").alias("sum"), F.count_distinct("s").alias("n_distinct")).withColumn("heavy", F.lit(False))
    )
    out = light if heavy_out is None else light.unionByName(heavy_out)
    return out.withColumnRenamed("k", key)


def skew_join(rows: DataFrame, per_key: DataFrame, key: str, share: float = 0.01, how: str = "inner") -> DataFrame:
    """``rows`` joined to ``per_key``, which has at most one row a key.

    Rows of heavy keys meet their (few, hence broadcast) partners where they stand; all other rows
    are joined by an ordinary shuffle. ``how`` is inner or left; a row with a null key has no partner.
    """
    if how not in ("inner", "left"):
        raise ValueError("how is inner or left")
    heavy = [k for k, _ in detect_heavy(rows, key, share)]
    if not heavy:
        return rows.join(per_key, key, how)
    keys = F.broadcast(rows.sparkSession.createDataFrame([(k,) for k in heavy], rows.select(key).schema))
    few = F.broadcast(per_key.join(keys, key, "left_semi"))
    return rows.join(keys, key, "left_semi").join(few, key, how).unionByName(rows.join(keys, key, "left_anti").join(per_key.join(keys, key, "left_anti"), key, how))


def keyed_fields(df: DataFrame, fields: list[str], others: list[str]) -> DataFrame:
    """One row per row and field: (field_name, key_value, keyed, *others); keyed is null where the value is."""
    named = F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).cast("string").alias("key_value")) for f in fields])).alias("x")
    return df.select(named, *others).select("x.*", *others).where(F.col("key_value").isNotNull()).withColumn("keyed", F.concat_ws("\u0001", "field_name", "key_value"))
