"""Cross-sample contamination: bulk, single cell, and between sample tags.

A sequence in several cases belongs to the sample where it is most frequent (ties: the smaller sample
name); elsewhere it is contamination (OUT) if that frequency is ``cutoff`` times as high, else in
doubt on both sides (OUT_X). Rows with a null sample or sequence are PASS.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from repspark.runtime import written


def _batched(df: DataFrame, batch: str | None) -> tuple[DataFrame, str]:
    return (df, batch) if batch else (df.withColumn("_batch", F.lit("all")), "_batch")


def flag_bulk(df: DataFrame, sequence: list[str], sample: str = "SampleID", case: str | None = None, batch: str | None = None, cutoff: float = 10.0, clone_cutoff: float = 80.0) -> DataFrame:
    """Rows with Contamination_FLAG (PASS, OUT_CLONOTYPE, OUT_CLONOTYPEVARIANT), the raw flag, and the dominant sample and its frequency.

    ``sequence`` names the columns that make a sequence the same. Frequencies are of variant reads in the
    sample's distinct variants. Flagged variants that hold ``clone_cutoff`` percent of their clonotype
    make it OUT_CLONOTYPE. Aggregates only: rows are joined to the few sequences met in several cases.
    """
    case = case or sample
    df, b = _batched(df, batch)
    key = F.concat_ws("\u0001", *[F.coalesce(F.col(c).cast("string"), F.lit("NA")) for c in sequence])
    rows = df.withColumn("_key", key)
    named = rows.where(F.col(sample).isNotNull())
    variants = named.groupBy(b, sample, "ClonotypeVariantID").agg(F.max("ClonotypeVariant_nReads").alias("_r"))
    totals = variants.groupBy(b, sample).agg(F.sum("_r").alias("_t"))
    freq = variants.join(totals, [b, sample]).select(b, sample, "ClonotypeVariantID", (F.col("_r") * 100.0 / F.col("_t")).alias("_freq"))
    seen = named.select(b, "_key", sample, F.col(case).alias("_case"), "ClonotypeVariantID").distinct()
    # one small row per sequence and sample; all flags are taken on these
    per_case = written(seen.join(freq, [b, sample, "ClonotypeVariantID"]).groupBy(b, "_key", sample, "_case").agg(F.max("_freq").alias("_freq")), "per-case")
    first = F.min(F.struct((-F.col("_freq")).alias("f"), F.col(sample).alias("s"), F.col("_case").alias("c"))).alias("_top")
    top = per_case.groupBy(b, "_key").agg(F.min("_case").alias("_a"), F.max("_case").alias("_z"), first).where("_a <> _z").drop("_a", "_z")
    cand = per_case.join(top, [b, "_key"]).withColumn("_max", -F.col("_top.f"))
    foreign = F.col("_case") != F.col("_top.c")
    weak = F.coalesce(foreign & (F.col("_max") < cutoff * F.col("_freq")), F.lit(False))
    raw = F.when(foreign & (F.col("_max") >= cutoff * F.col("_freq")), "OUT").when(foreign, "OUT_X")
    doubt = F.max(weak).over(Window.partitionBy(b, "_key"))
    flags = cand.withColumn("_raw", F.coalesce(raw, F.when(doubt & (F.col(sample) == F.col("_top.s")), "OUT_X")))
    flags = written(flags.where(F.col("_raw").isNotNull()).select(b, "_key", sample, "_raw", F.col("_top.s").alias("Contamination_Sample"), F.col("_max").alias("Contamination_Freq")).distinct(), "flags")
    bad = rows.select(b, "_key", sample, "ClonotypeID", "ClonotypeVariantID", "ClonotypeVariant_freq").join(flags.select(b, "_key", sample), [b, "_key", sample], "left_semi")
    clones = bad.groupBy(b, sample, "ClonotypeID", "ClonotypeVariantID").agg(F.max("ClonotypeVariant_freq").alias("_f")).groupBy(b, sample, "ClonotypeID").agg(F.sum("_f").alias("_bad"))
    rows = rows.join(flags, [b, "_key", sample], "left").join(clones, [b, sample, "ClonotypeID"], "left")
    final = F.when(F.col("_raw").isNull(), "PASS").when(F.col("_bad") >= clone_cutoff, "OUT_CLONOTYPE").otherwise("OUT_CLONOTYPEVARIANT")
    return rows.withColumn("Contamination_FLAG", final).withColumn("Contamination_raw", F.coalesce("_raw", F.lit("PASS"))).drop("_key", "_raw", "_bad", "_batch")


def flag_cells(cells: DataFrame, sequence: list[str], subclone: str, clone: str, sample: str, case: str | None = None, batch: str | None = None, cutoff: float = 10.0, clone_cutoff: float = 80.0) -> DataFrame:
    """Cells with Contamination_FLAG (PASS, OUT, OUT_X, OUT_CLONOTYPE), ratio 'count|max' and dominant sample.

    Counts cells per sample and subclone; a sequence whose largest count is 1, or that one case holds, is
    left alone. A clone with ``clone_cutoff`` percent of its cells OUT is OUT_CLONOTYPE as a whole.
    """
    case = case or sample
    df, b = _batched(cells, batch)
    rows = df.withColumn("_key", F.when(F.col(sample).isNotNull() & F.col(subclone).isNotNull(), F.concat_ws("\u0001", *[F.coalesce(F.col(c).cast("string"), F.lit("NA")) for c in sequence])))
    n = rows.where(F.col("_key").isNotNull()).groupBy(b, "_key", sample, F.col(case).alias("_case"), subclone).agg(F.count(F.lit(1)).alias("_n"))
    per = written(n.groupBy(b, "_key", sample, "_case").agg(F.max("_n").alias("_n")), "per-sample")
    top = per.groupBy(b, "_key").agg(F.count_distinct("_case").alias("_cases"), F.min(F.struct((-F.col("_n")).alias("n"), F.col(sample).alias("s"), F.col("_case").alias("c"))).alias("_top")).where((F.col("_cases") > 1) & (F.col("_top.n") < -1))
    per = per.join(top, [b, "_key"]).withColumn("_max", -F.col("_top.n"))
    foreign = F.col("_case") != F.col("_top.c")
    weak = foreign & (F.col("_max") < cutoff * F.col("_n"))
    doubt = F.max(weak).over(Window.partitionBy(b, "_key"))
    raw = F.when(foreign & ~weak, "OUT").when(weak, "OUT_X").when(doubt & (F.col(sample) == F.col("_top.s")), "OUT_X")
    flags = per.withColumn("_raw", raw).where(F.col("_raw").isNotNull()).groupBy(b, "_key", sample).agg(F.min("_raw").alias("_raw"), F.min(F.concat_ws("|", F.col("_n").cast("string"), F.col("_max").cast("string"))).alias("Contamination_Ratio"), F.min("_top.s").alias("Contamination_Sample"))
    rows = rows.join(flags, [b, "_key", sample], "left")
    share = rows.where(F.col(clone).isNotNull()).groupBy(b, sample, clone).agg((F.count_if(F.col("_raw") == "OUT") * 100.0 / F.count(F.lit(1))).alias("_share"))
    rows = rows.join(share, [b, sample, clone], "left")
    final = F.when(F.col("_share") >= clone_cutoff, "OUT_CLONOTYPE").otherwise(F.coalesce("_raw", F.lit("PASS")))
    return rows.withColumn("Contamination_FLAG", final).drop("_key", "_raw", "_share", "_batch")


def flag_tags(cells: DataFrame, clone: str, tag: str = "Sample_Tag", group: list[str] | None = None, cutoff: float = 10.0, ignored: tuple[str, ...] = ("Multiplet", "Undetermined")) -> DataFrame:
    """Cells with SampleTag_FLAG (PASS, OUT) and ratio 'other:max' per clone and tag; null for ignored tags and cells without tag or clone.

    Of a clone with more than one cell, a tag is OUT if the largest tag holds more than ``cutoff`` times its cells.
    """
    keys = [*(group or []), clone]
    fit = F.col(tag).isNotNull() & ~F.col(tag).isin(*ignored) & F.col(clone).isNotNull()
    n = cells.where(fit).groupBy(*keys, tag).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*keys)
    n = n.withColumns({"_total": F.sum("_n").over(w), "_max": F.max("_n").over(w), "_best": F.min_by(tag, F.struct(-F.col("_n"), F.col(tag))).over(w)})
    out = (F.col("_total") > 1) & (F.col(tag) != F.col("_best")) & (F.col("_max") > cutoff * F.col("_n"))
    n = n.select(*keys, tag, F.when(out, "OUT").otherwise("PASS").alias("SampleTag_FLAG"), F.when(out, F.concat_ws(":", F.col("_n").cast("string"), F.col("_max").cast("string"))).alias("SampleTag_Ratio"))
    return cells.join(n, [*keys, tag], "left")


def keep_passed(df: DataFrame, flag: str = "Contamination_FLAG") -> DataFrame:
    return df.where(F.col(flag) == "PASS")


def tag_table(cells: DataFrame, clone: str, tags: list[str], tag: str = "Sample_Tag") -> DataFrame:
    """(clone, one count per tag): cells per clone and tag, 0 where there are none; for display."""
    return cells.where(F.col(clone).isNotNull()).groupBy(clone).pivot(tag, tags).agg(F.count(F.lit(1))).na.fill(0, tags)
