from datetime import datetime, timedelta

from repspark.streaming.arrivals import clonotype_counts, read_arrivals, store_contigs, stored_contigs

T0 = datetime(2025, 6, 1)
SCHEMA = "sample string, sequence_id string, clonotypeID string, loaded_at timestamp"


def test_rows_months_late_and_out_of_order_are_counted_once(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    day = lambda d: T0 + timedelta(days=d)
    loads = [
        [("s", "a", "C1", day(0)), ("s", "b", "C1", day(0)), ("s", "z", "C9", day(9)), (None, "a", "C1", day(0))],
        [("s", "c", "C1", day(-120)), ("s", "d", "C1", day(-120)), ("s", "a", "C1", day(0))],
        [("s", "a", "C2", day(40)), ("s", "b", "C1", day(-200)), ("t", "a", None, day(-3)), ("s", "e", "C1", day(-1))],
    ]
    for rows in loads:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(src)
        stream = store_contigs(read_arrivals(spark, src, spark.read.parquet(src).schema), out)
        assert stream.trigger(availableNow=True).start().awaitTermination(120)
    kept = stored_contigs(spark, out)
    assert kept.columns == ["sample", "sequence_id", "clonotypeID", "loaded_at"]
    got = sorted(tuple(r) for r in clonotype_counts(kept).collect())
    assert got == sorted([(day(-120), "s", "C1", 2), (day(-1), "s", "C1", 1), (day(0), "s", "C1", 1), (day(9), "s", "C9", 1), (day(40), "s", "C2", 1)])
    assert kept.count() == 7
