"""Queries over edges read and assemble the ways once, and shuffle edges once to their pair of nodes."""

import pytest

import __spark_entry__ as entry


@pytest.mark.parametrize("name", ["gra2_edges", "gra3_parallel_minimum", "gra4_directed_minutes", "gra5_season_minutes"])
def test_ways_are_read_once(spark, sf, name):
    plan = entry.queries()[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [l_orderkey") == 1
    assert plan.count("Aggregate") == 2  # lines to ways, edges to the result
