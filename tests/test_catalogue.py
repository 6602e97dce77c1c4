import numpy as np
import pytest

from tileweave.plans.catalogue import all_queries

from .compare import assert_same

QUERIES, SQL = all_queries()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, sf_dir, name):
    assert_same(spark, sf_dir, QUERIES[name], SQL[name])


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
    assert set(QUERIES) <= set(e.queries())


def test_window_filter_reaches_the_scan(spark, sf_dir):
    plan = QUERIES["window_chip"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(vec_id), GreaterThanOrEqual(vec_id,10), LessThanOrEqual(vec_id,41)]" in plan
    assert "label" not in plan.split("ReadSchema")[1]


@pytest.mark.parametrize("name", ["overview_level", "image_error", "window_chips"])
def test_samples_close_to_a_half(spark, tmp_path, name):
    """Samples whose thousandfold is a tie as a float and none as a double."""
    samples = ((np.arange(-512, 512) + 0.5) / 1000).astype(np.float32)
    assert (np.round(samples * np.float32(1000)) != np.round(samples.astype(float) * 1000)).sum() > 100
    rows = [(i, [float(v) for v in line]) for i, line in enumerate(samples.reshape(16, 64))]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1).write.parquet(f"{tmp_path}/written")
    spark.createDataFrame([(c, c % 25) for c in range(80)], "c_custkey long, c_nationkey int").coalesce(1).write.parquet(f"{tmp_path}/written_customer")
    for folder, table in (("written", "embeddings"), ("written_customer", "customer")):
        next((tmp_path / folder).glob("*.parquet")).rename(tmp_path / f"{table}.parquet")
    assert_same(spark, str(tmp_path), QUERIES[name], SQL[name])
