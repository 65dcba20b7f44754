"""Pieces of roads, and distances from cells to points that are never written, against plain Python."""

import math
import random

from pyspark.sql import functions as F

from sitewright.operators.spatial import nearest_from_cells
from sitewright.plans.places import agg5, geo9, pieces_of

EDGE = "way long, highway string, pos int, ax double, ay double, bx double, by double"


def test_pieces_against_plain(spark):
    rows = [(1, "track", 1, 0.0, 0.0, 250.0, 0.0), (1, "track", 2, 5.0, 5.0, 5.0, 5.0), (2, "primary", 1, 10.0, 20.0, 10.0, -80.0)]
    got = sorted((r.way, r.pos, r.s, round(r.x, 6), round(r.y, 6), round(r.length, 6)) for r in pieces_of(spark.createDataFrame(rows, EDGE)).collect())
    third = round(250 / 3, 6)
    assert got == [(1, 1, 0, round(250 / 6, 6), 0.0, third), (1, 1, 1, 125.0, 0.0, third), (1, 1, 2, round(1250 / 6, 6), 0.0, third), (1, 2, 0, 5.0, 5.0, 0.0), (2, 1, 0, 10.0, -30.0, 100.0)]


def test_pieces_are_compiled_and_never_joined(spark, sf):
    for q in (agg5, geo9):
        plan = q(spark, sf)._jdf.queryExecution().executedPlan().toString()
        at = plan.index("Generate explode(sequence")
        assert "Join" not in plan[:at]
        assert "transform(" not in plan[:at]  # a lambda is interpreted for each piece


def test_distances_from_cells(spark):
    rng = random.Random(4)
    for n, cap in ((0, 9.0), (1, 9.0), (12, 25.0), (400, 25.0)):
        points = [(rng.uniform(0, 40), rng.uniform(0, 40)) for _ in range(n)]
        own = {(i, j): None for i in range(0, 44, 3) for j in range(-5, 44, 3)}
        for x, y in points:
            at = (math.floor(x / 2), math.floor(y / 2))
            d = math.dist((x, y), ((at[0] + 0.5) * 2, (at[1] + 0.5) * 2))
            own[at] = min(d, own[at]) if own.get(at) is not None else d
        cells = spark.createDataFrame([(*k, v) for k, v in own.items()], "i long, j long, own double")
        p = spark.createDataFrame(points, "x double, y double").select(F.floor(F.col("x") / 2).alias("i"), F.floor(F.col("y") / 2).alias("j"), "x", "y")
        got = {(r.i, r.j): round(r.d, 9) for r in nearest_from_cells(cells, p, 2.0, cap).collect()}
        want = {k: min((math.dist(q, ((k[0] + 0.5) * 2, (k[1] + 0.5) * 2)) for q in points), default=cap) for k in own}
        assert got == {k: round(d, 9) for k, d in want.items() if d < cap}
