"""Bulk reads before alignment: joining pairs, length filter, collapse of identical reads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repspark.functions.sequences import revcomp
from repspark.operators.ranks import numbered


def concat_pairs(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """Read 1 followed by the reverse complement of read 2; pairs joined on their keys, never by position in a file."""
    two = second.select(*keys, F.col("sequence").alias("_r2"))
    return first.join(two, keys).withColumn("sequence", F.concat("sequence", revcomp("_r2"))).drop("_r2")


def merge_pairs(first: DataFrame, second: DataFrame, keys: list[str], min_overlap: int = 10, max_overlap: int = 200, mismatch: float = 0.1) -> DataFrame:
    """(keys, sequence, merged): pairs joined at the longest overlap with at most ``mismatch`` differing bases; others stay apart (merged false, read 1)."""
    pairs = first.select(*keys, F.col("sequence").alias("a")).join(second.select(*keys, revcomp("sequence").alias("b")), keys)
    longest = F.least(F.length("a"), F.length("b"), F.lit(max_overlap))
    sizes = F.reverse(F.sequence(F.lit(min_overlap), F.greatest(longest, F.lit(min_overlap))))

    def differ(n):
        x = F.split(F.substring(F.col("a"), F.length("a") - n + 1, n), "")
        y = F.split(F.substring(F.col("b"), F.lit(1), n), "")
        return F.size(F.filter(F.zip_with(x, y, lambda p, q: p != q), lambda d: d))

    fit = F.filter(sizes, lambda n: (n <= longest) & (differ(n) <= n * mismatch))
    n = F.try_element_at(fit, F.lit(1))
    return pairs.select(*keys, F.when(n.isNotNull(), F.concat(F.col("a"), F.substring(F.col("b"), n + 1, F.length("b")))).otherwise(F.col("a")).alias("sequence"), n.isNotNull().alias("merged"))


def long_enough(df: DataFrame, shortest: int = 250) -> DataFrame:
    return df.where(F.length("sequence") >= shortest)


def collapse(df: DataFrame, sample: str = "sample") -> DataFrame:
    """(sample, sequence, n): identical reads counted, upper case; an empty or null read is none."""
    return df.where(F.length("sequence") > 0).groupBy(sample, F.upper("sequence").alias("sequence")).agg(F.count(F.lit(1)).alias("n"))


def numbered_reads(collapsed: DataFrame, sample: str = "sample") -> DataFrame:
    """Collapsed reads named read<i>_n=<count> per sample, by count descending, then sequence; a sample may be of any size."""
    rows = numbered(collapsed, [sample], [F.col("n").desc(), F.col("sequence")], "_i")
    return rows.select(sample, F.concat(F.lit("read"), F.col("_i").cast("string"), F.lit("_n="), F.col("n").cast("string")).alias("sequence_id"), "sequence", "n")
