"""Nearest points of several layers against plain search."""

from __future__ import annotations

import random

from sitewright.operators.spatial import nearest_layers

CAPS = {"road": 30.0, "grid": 80.0, "none": 40.0}


def test_nearest_of_each_layer_below_its_cap(spark):
    r = random.Random(8)
    left = [(i, r.uniform(0, 400), r.uniform(0, 400)) for i in range(60)] + [(60, 5.0, 5.0)]
    right = [(r.choice(["road", "grid", "other"]), i, r.uniform(0, 400), r.uniform(0, 400)) for i in range(80)]
    right += [("road", 90, 5.0, 8.0), ("road", 91, 5.0, 2.0), ("grid", 92, 5.0, 85.0)]  # a tie, and a point at the cap itself
    points = spark.createDataFrame(right, "layer string, id int, x double, y double")
    got = nearest_layers(spark.createDataFrame(left, "id int, x double, y double"), points, CAPS, 7.0).collect()
    assert len(got) == len(left) * len(CAPS)
    for g in got:
        x, y = next((a, b) for i, a, b in left if i == g["id"])
        near = sorted((((a - x) ** 2 + (b - y) ** 2) ** 0.5, i) for k, i, a, b in right if k == g["layer"])
        near = [n for n in near if n[0] < CAPS[g["layer"]]]
        assert g["other"] == (near[0][1] if near else None)
        assert g["d"] is None if not near else abs(g["d"] - near[0][0]) < 1e-9


def test_no_points_and_nothing_asked(spark):
    none = spark.createDataFrame([], "layer string, id int, x double, y double")
    left = spark.createDataFrame([(1, 0.0, 0.0)], "id int, x double, y double")
    assert [(r["layer"], r["d"]) for r in nearest_layers(left, none, {"road": 9.0}, 20.0).collect()] == [("road", None)]
    assert nearest_layers(left.limit(0), none, {"road": 9.0}, 20.0).count() == 0
