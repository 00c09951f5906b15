from datetime import datetime, timedelta

from repspark.streaming.arrivals import clonotype_counts, distinct_contigs, read_arrivals

T0 = datetime(2025, 1, 1)


def test_copies_are_dropped_and_days_counted(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "sample string, sequence_id string, clonotypeID string, loaded_at timestamp"
    first = [("s", "a", "C1", T0), ("s", "a", "C1", T0 + timedelta(hours=1)), ("s", "b", "C1", T0), ("s", "c", None, T0)]
    spark.createDataFrame(first, schema).coalesce(1).write.parquet(src)
    df = clonotype_counts(distinct_contigs(read_arrivals(spark, src, spark.read.parquet(src).schema)))
    run = lambda: df.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(120)
    run()
    spark.createDataFrame([("s", "z", "C9", T0 + timedelta(days=9))], schema).coalesce(1).write.mode("append").parquet(src)
    run()
    got = [tuple(r)[1:] for r in spark.read.parquet(out).collect()]
    assert got == [("s", "C1", 2)]
