"""Keys of many CDR3 are compared in blocks: the same clusters and distances as in one task."""

import random

import pytest
from pyspark.sql import functions as F

from repspark.kernels.linkage import encode, forest
from repspark.operators.clonotypes import cdr3_clusters, nearest_distances
from repspark.operators.ranks import numbered


def _rows(spark, n=260):
    random.seed(12)
    base = ["".join(random.choice("ACGT") for _ in range(30)) for _ in range(8)]
    out = []
    for i in range(n):
        s = "".join(c if random.random() > 0.1 else random.choice("ACGT") for c in random.choice(base))
        out.append(("hot" if i % 5 else "cold", None if i % 2 else "v", s, f"id{i:04d}"))
    return spark.createDataFrame(out, "unit string, v string, cdr3 string, sequence_id string")


@pytest.mark.parametrize("mode", ["single", "average", "complete"])
def test_blocks_give_the_same_clusters(spark, mode):
    df = _rows(spark)
    rows = lambda **k: sorted(map(tuple, cdr3_clusters(df, ["unit", "v"], "cdr3", 0.2, mode, **k).collect()), key=repr)
    assert rows(local=30, block=16) == rows()
    assert len({r[-1] for r in rows()}) > 3


def test_blocks_give_the_same_nearest_distances(spark):
    df = _rows(spark, 150).unionByName(spark.createDataFrame([("alone", "v", "A" * 30, "x")], "unit string, v string, cdr3 string, sequence_id string"))
    rows = lambda **k: sorted(map(tuple, nearest_distances(df, ["unit", "v"], "cdr3", **k).collect()), key=repr)
    assert rows(local=10, block=8) == rows() and rows()[0][-1] is None


def test_a_forest_ties_what_all_near_pairs_tie():
    a = encode(["AAAA", "AAAC", "AACC", "GGGG", "TTTT"])
    assert sorted(forest(a, None, 0.25)) == [(1, 0), (2, 0)]
    assert sorted(forest(a[:2], a[2:], 0.25)) == [(2, 1)] and forest(a[:1], a[3:], 0.25) == []
    dense = encode(["A" * 10] * 700)
    assert len(forest(dense, None, 0.2)) == 699


def test_places_in_a_hot_group(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 > 0, "hot").when(F.col("id") % 7 > 0, "cold").alias("g"), (F.col("id") % 10).alias("n"), F.col("id"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        got = sorted(map(tuple, numbered(df, ["g"], [F.col("n").desc(), F.col("id")], "k").select("g", "id", "k").collect()), key=repr)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    rows, want = [(r["g"], r["n"], r["id"]) for r in df.collect()], []
    for g in ("hot", "cold", None):
        want += [(g, i, k) for k, (_, i) in enumerate(sorted(((-n, i) for h, n, i in rows if h == g)), 1)]
    assert got == sorted(want, key=repr)
    assert numbered(df.limit(0), ["g"], [F.col("id")], "k").count() == 0
