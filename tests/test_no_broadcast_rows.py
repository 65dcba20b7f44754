"""Tables that grow with the input are shuffled however small their files look; each of these was broadcast whole."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from sitewright.operators import rank


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture()
def rows(spark, tmp_path):
    path = str(tmp_path / "rows")
    spark.createDataFrame([(i, float(i % 7), float(i % 5), i % 3) for i in range(200)], "id long, a double, b double, block long").write.parquet(path)
    return spark.read.parquet(path)


def test_mid_ranks_shuffle_their_rows(spark, rows):
    got = rank.mid_ranks(rows, "a")
    assert "SortMergeJoin" in plan(got)
    assert {r["mid"] for r in got.filter("a = 0").collect()} == {15.0}


def test_neighbour_counts_join_no_table_of_roofs(spark, sf):
    text = plan(entry.queries()["agg7_neighbour_counts"](spark, sf))
    assert "BroadcastHashJoin" not in text and text.split("Initial Plan")[-1].count("Join") == 1
