"""Stress runs in arrays against the same runs by rows, for small regions and for regions over the bound."""

import random

import pytest
from pyspark.sql import functions as F

from sitewright.operators import stress

LEVELS = {"production": [30], "location": [25, 60], "facility": [0, 50, 100]}


@pytest.mark.parametrize("large", [3, 1000])
def test_arrays_against_rows(spark, large):
    rng = random.Random(12)
    totals = [(r, None if r == 4 else rng.uniform(20, 60)) for r in range(9)]  # region 8 has no node
    nodes = [(k, None if k % 11 == 0 else rng.randrange(8), None if k % 9 == 0 else rng.choice([0.0, 2.0, 3.0, 5.0, 8.0])) for k in range(60)]
    t, n = spark.createDataFrame(totals, "region long, total double"), spark.createDataFrame(nodes, "node long, region long, limit double")
    need = lambda c: F.when(c.isNotNull(), c * 2 + 1)
    rows, rest = stress.by_region(t, n, need, LEVELS, 2, 5, large)
    got = stress.measured_by_run(rows, rest, stress.runs_of(LEVELS, 2), 5, 1e-9)
    want = stress.measured(*stress.screened(*stress.degraded(t, n, LEVELS, 2, 5), need), 5, 1e-9)
    shown = lambda df: {tuple(r)[:3]: tuple(None if v is None else round(v, 9) for v in tuple(r)[3:]) for r in df.collect()}
    assert shown(got) == shown(want)
    assert len(shown(want)) == 10  # a run that hides all facilities has no nodes


def test_query_ranks_no_row_a_run(spark, monkeypatch):
    """Neither picks nor allocations of small regions are laid out as a row a node and run."""
    for name in ("picks", "degraded", "screened"):
        monkeypatch.setattr(stress, name, lambda *_: pytest.fail("rows of all runs"))
    t, n = spark.createDataFrame([(1, 9.0)], "region long, total double"), spark.createDataFrame([(1, 1, 4.0), (2, 1, None)], "node long, region long, limit double")
    got = stress.stress(t, n, lambda c: c, LEVELS, 2, 1).filter("mechanism = 'location' AND percent = 60 AND measure = 'ranked'").first()
    assert (got.runs, got.mean) == (2, 1.0)


def test_cuts_widen_their_band(spark, monkeypatch):
    rows = spark.range(500).select(F.col("id").alias("node"))
    runs = [("location", p, r) for p in (0, 1, 50, 100) for r in (0, 1)]
    want = {tuple(r) for r in stress.picks(rows, "node", spark.createDataFrame(runs, "mechanism string, percent int, rep int"), 3).collect()}
    last = stress.cuts(rows, "node", runs, 3)
    at = stress.hidden(list(range(500)), runs, last, 3)
    assert {(*r, k) for j, r in enumerate(runs) for k in range(500) if at[k, j]} == want
