"""Every query with SQL gives DuckDB's rows on the smallest tables."""

import pytest
from compare import compare

from townsheet.queries import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_like_duckdb(spark, name):
    assert compare(spark, FOLDER, name, QUERIES[name], SQL[name]) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0


def test_random_order_changes_nothing(spark, tmp_path):
    """Order-dependent queries depend on stated order alone."""
    for t in ("events",):
        spark.read.parquet(f"{FOLDER}/{t}.parquet").orderBy("value").repartition(7).write.parquet(f"{tmp_path}/{t}.parquet")
    for name in ("venue_as_of", "timed_entries", "pipeline_outcomes", "day_band_counts"):
        a, b = (sorted(map(tuple, QUERIES[name](spark, d).collect()), key=repr) for d in (FOLDER, str(tmp_path)))
        assert a == b
