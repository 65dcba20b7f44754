"""Searches among points: ties go to the smaller id, and no side is broadcast that cells have multiplied."""

import math
import random

from sitewright.operators import spatial

KIND = "id long, x double, y double"


def test_ties_against_plain(spark):
    rng = random.Random(8)
    left = [(k, float(rng.randrange(30)), float(rng.randrange(30))) for k in range(60)]
    right = [(k, float(rng.randrange(30)), float(rng.randrange(30))) for k in range(90)] + [(200, 90.0, 90.0)]
    got = {r.id: (r.other, r.d) for r in spatial.nearest(spark.createDataFrame([*left, (99, 70.0, 70.0)], KIND), spark.createDataFrame(right, KIND), 8.0, 1.0).collect()}
    for k, x, y in left:
        d, other = min((math.dist((x, y), p[1:]), p[0]) for p in right)
        assert got[k] == ((other, d) if d < 8 else (None, None))
    assert got[99] == (None, None)


def test_points_in_cells_are_not_broadcast(spark, tmp_path):
    spark.createDataFrame([(k, float(k), 0.0) for k in range(20)], KIND).write.parquet(f"{tmp_path}/p")
    p = spark.read.parquet(f"{tmp_path}/p")
    assert "Broadcast" not in spatial.pairs_within(p, p, 2.0)._jdf.queryExecution().executedPlan().toString()


def test_reach_of_a_row(spark):
    p = spark.createDataFrame([(k, float(k), 0.0, float(k % 3)) for k in range(9)], KIND + ", far double")
    got = {(r.id, r.other) for r in spatial.pairs_within(p, p, 5.0, reach="far").collect()}
    assert got == {(a, b) for a in range(9) for b in range(9) if abs(a - b) <= a % 3}
