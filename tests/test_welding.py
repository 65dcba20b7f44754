"""Welding and links against plain versions, and components of chains, stars and rings."""

import random

from pyspark.sql import functions as F

from sitewright.operators import graph, welding


def roots(pairs, ids):
    parent = {i: i for i in ids}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in pairs:
        a, b = sorted((top(a), top(b)))
        parent[b] = a
    return {i: top(i) for i in ids}


def test_components(spark):
    rng = random.Random(3)
    pairs = [(i, i + 1) for i in range(200)] + [(300, 301 + i) for i in range(60)] + [(400 + i, 400 + (i + 1) % 30) for i in range(30)] + [(rng.randrange(500, 600), rng.randrange(500, 600)) for _ in range(70)]
    rng.shuffle(pairs)
    df = spark.createDataFrame(pairs + [(None, 3), (7, 7), pairs[0]], "u long, v long")
    want = roots(pairs, {x for p in pairs if p[0] != p[1] for x in p})
    assert {r.u: r.root for r in graph.components(df).collect()} == want
    assert graph.components(df.limit(0)).collect() == []


def plain_weld(points, reach):
    close = [(a, b) for a, (ax, ay) in points.items() for b, (bx, by) in points.items() if a < b and abs(ax - bx) <= reach and abs(ay - by) <= reach]
    return roots(close, points)


def test_weld(spark):
    """Dense and sparse points, across sides and corners of cells, below zero, with repeats."""
    rng = random.Random(8)
    points = {i: (rng.uniform(-20, 20), rng.uniform(-20, 20)) for i in range(260)} | {300 + i: (100 + 1.5 * i, -50.0) for i in range(9)} | {400 + i: (7.0, 7.0) for i in range(5)} | {500: (200.0, 200.0), 501: (201.4, 201.4), 502: (199.0, 201.4), 503: (210.0, 210.0)}
    df = spark.createDataFrame([(k, *v) for k, v in points.items()], "id long, x double, y double")
    got = {r.id: r for r in welding.weld(df, 1.5).collect()}
    assert {k: r.vertex for k, r in got.items()} == plain_weld(points, 1.5)
    assert all((r.x, r.y) == points[r.vertex] for r in got.values())
    assert welding.weld(df.limit(0), 1.5).collect() == []


def test_links(spark):
    """Cut ends take the nearest other cut end, else the nearest vertex; never their own vertex, nor another segment's."""
    rng = random.Random(5)
    rows, i = [], 0
    for segment in range(12):
        for piece in range(4):
            n, x, y = rng.randrange(2, 6), rng.uniform(0, 600), rng.uniform(0, 120)
            for pos in range(n):
                end = 0 if pos == 0 else 1 if pos == n - 1 else None
                rows.append((segment, piece, pos, i, x + pos * rng.uniform(20, 300), y + rng.uniform(0, 30), end, end is not None and rng.random() < 0.5))
                i += 1
    first = next(r for r in rows if r[7])
    rows.append((first[0], 9, 0, i, first[4] + 1, first[5], 0, True))  # welded to the end itself: no link
    df = spark.createDataFrame(rows, "segment long, piece long, pos long, id long, x double, y double, end int, cut boolean")
    at = {r[3]: (r[4], r[5]) for r in rows}
    vertex = plain_weld(at, 1.5)
    want = {}
    for s, p, _, k, _, _, end, cut in rows:
        if not cut:
            continue
        v = vertex[k]
        far = lambda w: ((at[w][0] - at[v][0]) ** 2 + (at[w][1] - at[v][1]) ** 2) ** 0.5
        others = [(far(vertex[r[3]]), vertex[r[3]], r[7]) for r in rows if r[0] == s and r[1] != p and vertex[r[3]] != v]
        best = min([(d, w) for d, w, c in others if c and d < 250], default=None) or min([(d, w) for d, w, _ in others if d < 80], default=None)
        if best:
            want[s, p, end] = (v, best[1], round(best[0], 6))
    links = welding.tile_links(df)[1]
    assert {(r.segment, r.piece, r.end): (r.v, r.other, round(r.metres, 6)) for r in links.collect()} == want
    assert any(d > 80 for *_, d in want.values()) and links.filter(F.col("metres") < 80).count() > 0
