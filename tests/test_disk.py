"""What the annotation leaves on disk: only the tables that its result is read from."""

from pathlib import Path

import pytest

from pyspark.sql import functions as F

from repspark.functions.sequences import v_identity
from repspark.operators import immunogenetics as I
from repspark.plans import registry
from repspark.runtime import bucketed, frugal, shared_dir, written


def tables(spark):
    return {p.name.rpartition("-")[0]: p for p in (Path(shared_dir(spark).removeprefix("file:")) / "repspark").glob("*")}


@pytest.mark.parametrize("name", ["annotate_missionbio", "annotate_sc_dna"])
def test_cells_keep_the_tables_of_the_result_only(spark, small, name):
    before = {p for p in tables(spark).values()}
    df = registry.QUERIES[name](spark, small)
    left = [n for n, p in tables(spark).items() if p not in before]
    assert sorted(left) == ["consensus", "numbered", "tidy"]
    assert df.count() > 100


def test_frugal_removes_what_is_not_named_and_leaves_the_session_as_it_was(spark):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(key)
    other = written(spark.range(3), "other")
    with frugal(spark) as release:
        a, b = written(spark.range(5), "a"), written(spark.range(7).groupBy("id").count(), "b")
        release(b)
        assert "a" not in tables(spark) and {"b", "other"} <= set(tables(spark))
    assert spark.conf.get(key) == was and b.count() == 7 and other.count() == 3 and a is not b


def shuffled(df):
    """The plan below each shuffle of ``df``."""
    lines = df._jdf.queryExecution().executedPlan().toString().split("\n")
    depth = [next((i for i, c in enumerate(x) if c.isalnum() or c == "*"), 0) for x in lines]
    for i, x in enumerate(lines):
        if "Exchange" in x:
            below = next((j for j in range(i + 1, len(lines)) if depth[j] <= depth[i]), len(lines))
            yield "\n".join(lines[i:below])


@pytest.mark.parametrize("name", ["annotate_missionbio", "annotate_sc_dna"])
def test_sequences_are_not_shuffled_for_the_result(spark, small, name):
    below = list(shuffled(registry.QUERIES[name](spark, small)))
    assert below and not [x for x in below if "germline_alignment" in x or "VDJseq" in x]


def test_only_cdr3_that_differ_within_a_key_are_taken_apart(spark):
    rows = [("a", "CARD")] * 3 + [("a", "CAR"), ("b", "CAR"), ("b", "CAT"), ("c", "CW"), ("c", "CAWW"), (None, "CQ")]
    seen, whole = [], I.map_groups
    try:
        I.map_groups = lambda df, *more: (seen.append(df), whole(df, *more))[1]
        got = {r["k"]: r["consensus"] for r in I.consensus_cdr3(spark.createDataFrame(rows, "k string, s string"), ["k"], "s").collect()}
    finally:
        I.map_groups = whole
    assert {k: v for k, v in got.items() if k} == {"a": "CARD", "b": "CA[RT]", "c": "CW"}
    assert sorted({r["k"] for r in seen[0].collect()}) == ["b"]


def test_identity_of_the_kernel_is_that_of_the_expression(spark):
    rows = [("ACGT", "ACGA", 4), ("ACGT", "AC", 4), ("ACGTAC", "TCGTAC", 3), ("ÄCGT", "ÄCTT", 4), (None, "A", 1), ("A", None, 1), ("A", "A", 0)]
    df = spark.createDataFrame(rows, "a string, b string, n int")
    want = [r[0] for r in df.select(v_identity("a", "b", "n")).collect()]
    x = F.array(F.struct(F.col("a").alias("seq"), F.col("b").alias("germ"), F.col("b").alias("cons"), F.lit(False).alias("differs"), F.lit(False).alias("own"), "n"))
    assert [r[0][0]["identity"] for r in df.select(I.chain_sequences(x)).collect()] == want


def test_bucketed_rows_stay_and_their_table_is_dropped(spark):
    rows = spark.range(200).selectExpr("concat('k', id % 9) AS _cell", "id AS x")
    with frugal(spark) as release:
        t = bucketed(rows, "buckets", "_cell", ["x"])
        assert sorted(map(tuple, t.collect())) == sorted(map(tuple, rows.collect()))
        assert not list(shuffled(t.groupBy("_cell").count()))
        name = t._written.rpartition("/")[2]
        known = len(spark.catalog.listTables())
        release()
        assert len(spark.catalog.listTables()) == known - 1 and name not in {p.name for p in tables(spark).values()}
