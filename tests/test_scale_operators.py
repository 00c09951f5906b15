"""The general problems: heavy keys (3) and orphan references (4), with their edge cases."""

from collections import Counter, defaultdict
from datetime import datetime, timedelta

import pytest

from repspark.operators.heavy_keys import detect_heavy, per_key_summary, skew_join
from repspark.operators.orphans import bounded_key, composite_key, find_orphans, orphan_report
from pyspark.sql import functions as F

T0 = datetime(2025, 1, 1)


def test_heavy_keys_are_found_and_counted(spark):
    data = [("hot", i % 7, f"s{i % 3}") for i in range(600)] + [(f"k{i}", i, f"s{i % 5}") for i in range(400)] + [(None, 1, "s1")] * 5 + [("k1", None, None)] * 3
    df = spark.createDataFrame(data, "key string, v bigint, s string").withColumn("k", F.lit("clash")).withColumn("n", F.lit(0))
    assert [k for k, _ in detect_heavy(df, "key", 0.05)] == ["hot"]
    got = {r["key"]: r for r in per_key_summary(df, "key", "v", "s", share=0.05).collect()}
    n, total, spread = Counter(), defaultdict(list), defaultdict(set)
    for k, v, s in data:
        if k is not None:
            n[k] += 1
            total[k] += [v] * (v is not None)
            spread[k] |= {s} - {None}
    assert {k: (r["n_rows"], r["sum"], r["n_distinct"]) for k, r in got.items()} == {k: (n[k], sum(total[k]), len(spread[k])) for k in n}
    assert got["hot"]["heavy"] and not got["k1"]["heavy"]
    with pytest.raises(ValueError):
        detect_heavy(df, "key", 1e-6)


def test_heavy_keys_of_empty_and_null_tables(spark):
    empty = spark.createDataFrame([], "key string, v bigint, s string")
    assert detect_heavy(empty, "key", 0.1) == [] and per_key_summary(empty, "key", "v", "s").count() == 0
    nulls = spark.createDataFrame([(None, None, None)] * 4, "key string, v bigint, s string")
    assert per_key_summary(nulls, "key", "v", "s").count() == 0


@pytest.mark.parametrize("how", ["inner", "left"])
def test_skew_join_is_the_plain_join(spark, how):
    rows = spark.createDataFrame([("hot", i) for i in range(300)] + [(f"k{i}", i) for i in range(50)] + [(None, 1)], "key string, v bigint")
    side = spark.createDataFrame([("hot", 1.0), ("k3", 2.0), ("k4", None), ("other", 3.0)], "key string, w double")
    plain = sorted(map(tuple, rows.join(side, "key", how).collect()), key=repr)
    assert sorted(map(tuple, skew_join(rows, side, "key", 0.1, how).collect()), key=repr) == plain


def _brute(refs, parents):
    out = set()
    for src, field, rid, key, at in refs:
        if key is None:
            continue
        ok = any(k == key and r is not None and at is not None and r <= at and (d is None or d > at) for k, r, d in parents)
        if not ok:
            out.add((src, field, rid))
    return out


def test_orphans_against_brute_force(spark):
    day = lambda n: T0 + timedelta(days=n)
    long = "x" * 300
    parents = [("a", day(0), None), ("b", day(5), day(10)), ("b", day(12), None), ("a ", day(0), day(1)), ("c", None, None), (long, day(1), None), ("hot", day(3), None), ("b", day(5), day(10))]
    refs = [("t", "f", i, k, day(d)) for i, (k, d) in enumerate([("a", 0), ("a", -1), ("b", 5), ("b", 10), ("b", 11), ("b", 12), ("A", 3), ("a ", 0), ("a ", 1), ("c", 3), ("zz", 3), (None, 3), ("", 3), (long, 2), (long + "y", 2)])]
    refs += [("t", "f", 100, "a", None), ("t", "f", 3, "b", day(10))] + [("t", "hot", 1000 + i, "hot", day(i % 6)) for i in range(500)]
    r = spark.createDataFrame(refs, "src_table string, ref_field string, record_id bigint, key string, at timestamp_ntz").withColumn("salt", F.lit("clash"))
    p = spark.createDataFrame(parents, "key string, registered_at timestamp_ntz, deleted_at timestamp_ntz").withColumn("tag", F.lit(9))
    got = {(x["src_table"], x["ref_field"], x["record_id"]) for x in find_orphans(r, p, share=0.1).collect()}
    assert got == _brute(refs, parents)
    report = {(x["ref_field"], x["month"]): (x["n_refs"], x["n_orphans"]) for x in orphan_report(r, find_orphans(r, p)).collect()}
    assert report[("hot", "2025-01")] == (500, len([1 for i in range(500) if i % 6 < 3]))


def test_orphans_of_empty_tables(spark):
    r = spark.createDataFrame([], "src_table string, ref_field string, record_id bigint, key string, at timestamp_ntz")
    p = spark.createDataFrame([], "key string, registered_at timestamp_ntz, deleted_at timestamp_ntz")
    assert find_orphans(r, p).count() == 0
    one = spark.createDataFrame([("t", "f", 1, "a", T0)], r.schema)
    assert find_orphans(one, p).count() == 1


def test_keys(spark):
    df = spark.createDataFrame([("a", "bc"), ("ab", "c"), (None, "c")], "x string, y string").select(composite_key(F.col("x"), F.col("y")).alias("k"), bounded_key(F.lit("é" * 60)).alias("b"))
    ks = [r["k"] for r in df.collect()]
    assert ks[0] != ks[1] and ks[2] is None
    assert len(df.first()["b"].encode()) <= 96
