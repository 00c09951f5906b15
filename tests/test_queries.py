import pytest
from oracle import connect, same

from repspark.plans import registry


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_against_sql(spark, small, con, name):
    got, want = same(registry.QUERIES[name](spark, small), registry.ORACLE[name], con)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE)))
def test_runs(spark, small, name):
    df = registry.QUERIES[name](spark, small)
    assert df.count() > 0
    assert len(set(df.columns)) == len(df.columns)


@pytest.mark.parametrize("name", ["contam_bulk", "contam_cells", "contam_tags", "recalc_bulk", "recalc_cells", "chain_relabel", "cell_numbers"])
def test_each_table_is_read_at_most_twice(spark, small, name):
    plan = registry.QUERIES[name](spark, small)._jdf.queryExecution().executedPlan().toString()
    for t in ("annotated_contigs", "tidy_contigs", "cells", "sample_sheet"):
        assert plan.count(f"/{t}.parquet") <= 2


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
