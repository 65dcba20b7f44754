"""Queries that have no SQL against plain Python over the same tables, and rules at their edges."""

import hashlib
import heapq
from collections import defaultdict

import numpy as np
import pandas as pd
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from sitewright.functions import geo, rules, text
from sitewright.operators import allocation, checks, rank, spatial
from sitewright.sources import files


def frame(sf, name):
    return pq.read_table(f"{sf}/{name}.parquet").to_pandas()


def places(sf):
    """Buildings and sites as rows of (id, x, y)."""
    c, s = frame(sf, "customer"), frame(sf, "supplier")
    b = pd.DataFrame({"id": c.c_custkey, "x": (c.c_custkey * 7919 % 20011).astype(float), "y": (c.c_custkey * 104729 % 20021).astype(float), "roof": c.c_acctbal.abs().astype(float) / 10, "nation": c.c_nationkey})
    t = pd.DataFrame({"id": s.s_suppkey, "x": (s.s_suppkey * 6151 % 20011).astype(float), "y": (s.s_suppkey * 15013 % 20021).astype(float), "kind": s.s_suppkey % 8})
    return b, t


def apart(a, b):
    return np.sqrt((a.x.to_numpy()[:, None] - b.x.to_numpy()) ** 2 + (a.y.to_numpy()[:, None] - b.y.to_numpy()) ** 2)


def run(spark, sf, name):
    return entry.queries()[name](spark, sf).collect()


def test_duplicate_places(spark):
    sf = "/root/testdata/sf0.01"  # ten times as many sites, some of which go
    _, s = places(sf)
    name = [None if i % 4 == 0 else f"Place {i % 9}" for i in s.id]
    d, kept = apart(s, s), []
    for i in range(len(s)):
        reach = 6000 if s.kind[i] >= 6 else 3000
        if not any(d[i, k] <= reach and (s.kind[i] == s.kind[k] or (name[i] is not None and name[i] == name[k])) for k in kept):
            kept.append(i)
    assert sorted((r.id, r.kind, r.name) for r in run(spark, sf, "joi12_duplicate_places")) == [(s.id[i], s.kind[i], name[i]) for i in kept]
    assert 0 < len(kept) < len(s)


def greedy(sf):
    """Edges within 4 km in order of time, origin and node; what each origin gives and each site takes."""
    b, s = places(sf)
    d = apart(b, s)
    mass, room = dict(zip(b.id, b.roof.map(lambda v: float(int(v + 0.5))))), {i: float(2000 + i % 13 * 300) for i in s.id if i % 7}
    near = [(round(d[i, k] / 66.0, 3), b.id[i], s.id[k]) for i in range(len(b)) for k in range(len(s)) if d[i, k] <= 4000]
    left, free, given = dict(mass), dict(room), {}
    for _, o, n in sorted(near):
        if n in free and (t := min(left[o], free[n])) > 0:
            given[o, n] = t
            left[o] -= t
            free[n] -= t
    return mass, near, given, left


def test_nearest_first_and_reasons(spark, sf):
    mass, near, given, left = greedy(sf)
    got = {(r.origin, r.node): r.tonnes for r in run(spark, sf, "alo4_nearest_first")}
    assert got == pytest.approx(given)
    around = defaultdict(set)
    for _, o, n in near:
        around[o].add(n)
    for r in run(spark, sf, "alo5_balance_reasons"):
        assert r.mass == mass[r.origin] and r.assigned + r.unserved == pytest.approx(r.mass) and r.unserved == pytest.approx(left[r.origin])
        want = None if r.unserved <= 0 else "no_reachable_candidate" if not around[r.origin] else "candidate_capacity_unknown" if all(n % 7 == 0 for n in around[r.origin]) else "capacity_exhausted"
        assert r.reason == want


def roads(sf):
    """Fastest minutes of each directed edge, and the vertices' places."""
    line = frame(sf, "lineitem")
    rows = line[["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus"]].drop_duplicates()
    part = frame(sf, "part").p_partkey
    at = {k: (float(k * 7351 % 20011), float(k * 9293 % 20021)) for k in part}
    out = {}
    for _, g in rows.sort_values(["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]).groupby("l_orderkey"):
        speed = {"A": 50, "N": 30}.get(g.l_returnflag.min(), 15)
        nodes = g.l_partkey.tolist()
        for a, b in zip(nodes, nodes[1:]):
            if a != b:
                t = np.hypot(at[a][0] - at[b][0], at[a][1] - at[b][1]) / (speed * 1000 / 60)
                for e in ((a, b), (b, a)):
                    out[e] = min(out.get(e, np.inf), t)
    return out, at


def test_travel_matrix(spark, sf):
    edges, at = roads(sf)
    b, s = places(sf)
    nodes = pd.DataFrame([(k, *v) for k, v in at.items()], columns=["id", "x", "y"]).sort_values("id", ignore_index=True)
    to = defaultdict(list)
    for (a, c), t in edges.items():
        to[c].append((a, t))

    def snap(points, cap):
        d = apart(points, nodes)
        return {i: (nodes.id[k], d[n, k] * 1.3 / (4000 / 60)) for n, (i, k) in enumerate(zip(points.id, d.argmin(1))) if d[n, k] < cap}

    origins = b[b.id % 20 == 0].reset_index(drop=True)
    start, ends = snap(origins, 1500), snap(s, 3000)
    want = {}
    for site, (v, t) in ends.items():
        best, heap = {}, [(t, v)]
        while heap:
            t, v = heapq.heappop(heap)
            if v in best or t > 60:
                continue
            best[v] = t
            for a, m in to[v]:
                heapq.heappush(heap, (t + m, a))
        for o in origins.id:
            if o not in start:
                want[o, site] = ("snap_failure", None)
            else:
                v, w = start[o]
                m = best[v] + w if v in best else None
                want[o, site] = ("reachable", round(m, 6)) if m is not None and m <= 60 else ("unreachable_or_over_budget", None)
    got = {(r.origin, r.site): (r.status, r.minutes) for r in run(spark, sf, "gra9_travel_matrix")}
    assert got.keys() == want.keys() and {s for s, _ in want.values()} >= {"reachable"}
    for k, (status, minutes) in want.items():
        assert got[k][0] == status and (minutes is None or abs(got[k][1] - minutes) < 1e-5)


def test_pinned_sources(spark, sf, tmp_path):
    for name, body in (("a.txt", b"one"), ("b.txt", b"two"), ("c.txt", b"three"), ("d.txt", b"x")):
        (tmp_path / name).write_bytes(body)
    digest = lambda b: hashlib.sha256(b).hexdigest()
    manifest = spark.createDataFrame([("a.txt", digest(b"one"), False), ("b.txt", digest(b"other"), False), ("c.txt", None, True), ("e.txt", digest(b""), False)], "name string, sha256 string, restricted boolean")
    got = {r.name: (r.size, r.status) for r in files.pinned(spark, f"file://{tmp_path}/*.txt", manifest).collect()}
    assert got == {"a.txt": (3, "ok"), "b.txt": (3, "mismatch"), "c.txt": (5, "skipped"), "d.txt": (1, "not listed"), "e.txt": (None, "missing")}
    assert [(r.status, r.bytes > 0) for r in run(spark, sf, "src1_pinned_sources")] == [("ok", True)]


def plain_cells(sf):
    b, _ = places(sf)
    g = b.assign(block=b.nation % 6, i=b.x // 1000, j=b.y // 1000).groupby(["block", "i", "j"])
    c = g.agg(n=("id", "size"), big=("roof", lambda r: (r >= 600).sum()), amax=("roof", "max"), mx=("x", "min")).reset_index()
    x = pd.DataFrame({"log_n": np.log1p(c.n), "log_big": np.log1p(c.big), "log_roof": np.log1p(c.amax), "edge": np.minimum(c.mx / 1000, 15), "share": c.big / c.n})
    y = (((c.i * 7 + c.j * 3) % 5 == 0) | (c.amax > 900)).astype(int)
    return c, x.to_numpy(), y.to_numpy()


def newton(x, y):
    """Ridge logistic with both classes of equal weight, on standardised features."""
    mean, sd = x.mean(0), x.std(0)
    sd[sd < 1e-12] = 1
    z = np.c_[np.ones(len(x)), (x - mean) / sd]
    w = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    beta, ridge = np.zeros(z.shape[1]), np.diag([0.0, *[1.0] * x.shape[1]])
    for _ in range(60):
        p = 1 / (1 + np.exp(-z @ beta))
        beta = beta + np.linalg.lstsq(z.T @ (z * (w * p * (1 - p))[:, None]) + ridge, z.T @ (w * (y - p)) - ridge @ beta, rcond=None)[0]
    return beta, mean, sd


def margins(model, x):
    beta, mean, sd = model
    return beta[0] + ((x - mean) / sd) @ beta[1:]


def test_models_and_their_scores(spark, sf):
    """Coefficients by fold, presence against background, scores of held-out blocks, signs, probabilities and percentiles."""
    c, x, y = plain_cells(sf)
    names = ["intercept", "log_n", "log_big", "log_roof", "edge", "share"]
    models = {f: newton(x[c.block != f], y[c.block != f]) for f in sorted(c.block.unique())}
    got = {(r.fold, r.feature): r.coefficient for r in run(spark, sf, "eva4_ridge_logistic")}
    assert got == pytest.approx({(f, n): v for f, m in models.items() for n, v in zip(names, m[0])}, abs=2e-4)
    both = newton(np.r_[x[y == 1], x], np.r_[np.ones(y.sum(), int), np.zeros(len(y), int)])
    assert {r.feature: r.coefficient for r in run(spark, sf, "eva5_presence_background")} == pytest.approx(dict(zip(names, both[0])), abs=2e-4)
    scores = {(b, i, j): margins(models[b], x[k : k + 1])[0] for k, (b, i, j) in enumerate(zip(c.block, c.i, c.j))}
    arms = defaultdict(dict)
    for r in run(spark, sf, "eva7_leave_one_block_out"):
        arms[r.arm][r.block, r.i, r.j] = r.score
    assert arms["model"] == pytest.approx(scores, abs=2e-3) and arms["people"] == {(b, i, j): n for b, i, j, n in zip(c.block, c.i, c.j, c.n)}
    signs = {r.feature: r.positive_share for r in run(spark, sf, "eva12_sign_stability")}
    assert signs == pytest.approx({n: np.mean([m[0][k] > 0 for m in models.values()]) for k, n in enumerate(names) if k}, abs=1e-6)
    whole = margins(newton(x, y), x)
    order = sorted(range(len(c)), key=lambda k: (-round(whole[k], 9), c.block[k], c.i[k], c.j[k]))
    place = {k: 1 - n / (len(c) - 1) for n, k in enumerate(order)}
    top = {(r.block, r.i, r.j): (r.p, r.percentile) for r in run(spark, sf, "eva13_apply_model")}
    want = {(c.block[k], c.i[k], c.j[k]): (1 / (1 + np.exp(-whole[k])), place[k]) for k in order if place[k] >= 0.8}
    assert len(top.keys() & want.keys()) >= len(want) - 2 and len(top) == len(want)
    assert all(abs(top[k][0] - want[k][0]) < 1e-3 for k in top.keys() & want.keys())
    best = defaultdict(float)
    for k in order:
        best[c.i[k], c.j[k]] = max(best[c.i[k], c.j[k]], place[k])
    _, s = places(sf)
    for r in run(spark, sf, "eva14_point_percentile"):
        cell = (s.x[r.id] // 1000, s.y[r.id] // 1000)
        assert (r.percentile is None) == (cell not in best) and (r.percentile is None or abs(r.percentile - best[cell]) < 0.02)


@pytest.mark.parametrize("name", ["eva9_cluster_bootstrap", "eva10_block_mean_bootstrap", "eva11_verdict", "eva24_label_audit", "sim5_monte_carlo_ranks", "sim12_variance_shares", "sim13_rank_exits"])
def test_seeded_queries_give_the_same_rows_again(spark, sf, name):
    """The draws are functions of seed and place, so partitions don't matter."""
    one = sorted(map(str, run(spark, sf, name)))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        again = sorted(map(str, run(spark, sf, name)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert one == again and one


def test_ranks_within_groups(spark):
    rng = np.random.default_rng(3)
    rows = [(int(rng.integers(0, 4)), int(rng.integers(0, 9)), i) for i in range(500)]
    df = spark.createDataFrame(rows, "g long, v long, id long")
    got = {r.id: r.k for r in rank.ranked_within(df, ["g"], [F.desc("v"), "id"], "k").collect()}
    want = {}
    for g in range(4):
        for k, (_, _, i) in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2])), 1):
            want[i] = k
    assert got == want


def test_nearest_of_another_group(spark):
    rng = np.random.default_rng(5)
    a = [(i, float(x), float(y), int(g)) for i, (x, y, g) in enumerate(zip(rng.integers(0, 5000, 80), rng.integers(0, 5000, 80), rng.integers(0, 3, 80)))]
    df = spark.createDataFrame(a, "id long, x double, y double, g long")
    got = {r.id: (r.other, r.d) for r in spatial.nearest(df, df, 4000, 300, unlike="g").collect()}
    for i, x, y, g in a:
        d, o = min((np.hypot(x - u, y - v), k) for k, u, v, h in a if h != g)
        assert got[i] == ((o, pytest.approx(d)) if d < 4000 else (None, None))


def test_one_to_one_fails_on_either_side(spark):
    t = lambda rows: spark.createDataFrame(rows, "k long, v string")
    good = checks.one_to_one(t([(1, "a"), (2, "b")]), t([(1, "x"), (2, "y")]).withColumnRenamed("v", "w"), "k")
    assert sorted(tuple(r) for r in good.collect()) == [(1, "a", "x"), (2, "b", "y")]
    for left, right in (([(1, "a")], [(1, "x"), (2, "y")]), ([(1, "a"), (2, "b")], [(1, "x")]), ([(1, "a"), (1, "b")], [(1, "x")]), ([(1, "a")], [(1, "x"), (1, "y")]), ([(None, "a")], [(None, "x")])):
        with pytest.raises(Exception, match="one to one"):
            checks.one_to_one(t(left), t(right).withColumnRenamed("v", "w"), "k").collect()


def test_point_statuses(spark):
    points = spark.createDataFrame([(1, 0, False), (2, 0, False), (3, 0, True), (4, 0, False), (5, 0, True), (6, 0, None)], "id long, province int, conflict boolean")
    found = spark.createDataFrame([(1, 7, 0), (2, 7, 0), (2, 8, 0), (3, 7, 0), (4, 9, 1), (4, 7, 0)], "id long, zone long, province int")
    got = {r.id: (r.zones, r["keys"], r.status) for r in spatial.match_status(points, found).collect()}
    assert got == {1: (1, "7", "matched"), 2: (2, "7|8", "ambiguous"), 3: (1, "7", "location_conflict"), 4: (2, "7|9", "province_conflict"), 5: (0, "", "location_conflict"), 6: (0, "", "unmatched")}


def test_modes_of_transport(spark):
    def policy(tags, **how):
        df = spark.createDataFrame([(tags,)], "t map<string,string>")
        p = df.select(text.way_policy(F.col("t"), "dry", **how).alias("p")).first().p
        return p.status, p.forward, p.backward, p.forward_kph

    path = {"highway": "path", "oneway": "yes"}
    assert policy(path, mode="foot")[0] == "pedestrian_oneway_ambiguous" and policy(path)[:3] == ("retained", True, False)
    assert policy({"highway": "residential", "oneway": "yes"}, mode="foot")[:3] == ("retained", True, True)
    assert policy({"highway": "steps", "oneway": "-1"}, mode="foot")[:3] == ("retained", False, True)
    assert policy({"highway": "path", "oneway": "yes", "oneway:foot": "no"}, mode="foot")[:3] == ("retained", True, True)
    assert policy({"highway": "primary"}, missing_access="exclude")[0] == "access_unknown"
    assert policy({"highway": "primary", "access": "no", "foot": "yes"}, mode="foot")[0] == "retained"
    assert policy({"highway": "primary", "access": "no", "foot": "yes"})[0] == "access_restricted_or_unresolved"
    assert policy({"highway": "primary", "motorcycle": "no"}, mode="motorbike")[0] == "access_restricted_or_unresolved" and policy({"highway": "primary", "motorcycle": "no"}, mode="bicycle")[0] == "retained"
    assert policy({"highway": "primary", "maxspeed": "signals"})[0] == "maxspeed_unresolved" and policy({"highway": "primary", "maxspeed": "signals"}, mode="bicycle")[0] == "retained"


def test_names_and_listings(spark):
    df = spark.createDataFrame([("\t one \n two  ",)], "n string")
    assert df.select(text.normal_name(F.col("n"))).first()[0] == "ONE TWO"
    cases = [("Plain", "shop", ["food", "grain_mill"], "mill"), ("Plain", "shop", ["grain_mill", "food"], None), ("Plain", "warehouse", [], None), ("Maize hub", "warehouse", [], "warehouse"), ("Umuhuza Cooperative", "professional_service", [], "cooperative"), ("Umuhuza Cooperative", "hotel", [], None), ("Grand Hotel", "dairy", [], None)]
    rows = spark.createDataFrame([(i, n, c, h) for i, (n, c, h, _) in enumerate(cases)], "id long, n string, c string, h array<string>")
    got = [r.k for r in rows.select("id", text.listing_kind(F.col("n"), F.col("c"), F.lit(0.9), F.col("h")).alias("k")).orderBy("id").collect()]
    assert got == [k for *_, k in cases]


def test_rules_at_their_edges(spark):
    df = spark.range(1)
    one = lambda c: df.select(c.alias("v")).first().v
    n, s = lambda v: F.lit(v).cast("double"), lambda v: F.lit(v).cast("string")
    assert one(rules.unit_consistent(s("kWh"), s("energy"), s(None))) is False and one(rules.unit_consistent(s("kWh"), s("energy"), s("year"))) is True and one(rules.unit_consistent(s("lb"), s("mass"), s(None))) is None
    assert one(rules.converted(n(2), s("kt"), s("t"))) == 2000 and one(rules.converted(n(2), s("t"), s("kWh"))) is None
    assert one(rules.comparable_difference(n(3), n(1), (s("t"), s("t")))) == 2 and one(rules.comparable_difference(n(3), n(1), (s("t"), s(None)))) is None
    assert one(rules.airflow(n(1), s("bushel_60lb"))).value == pytest.approx(0.0173411) and one(rules.airflow(n(1), s(None))).reason == "basis unknown" and one(rules.airflow(n(None), s("bushel_60lb"))).reason == "value unknown"
    assert [one(rules.storage_state(n(v))).state for v in (None, float("nan"), -1, 0, 5)] == ["unknown", "unknown", "unknown", "unresolved", "known"]
    assert [one(rules.adopted(n(a), n(b), n(c))) for a, b, c in ((0.03, 0.001, 0.01), (0.029, 1, 0), (1, 0, 0), (1, 1, 0.011), (None, 1, 0))] == ["ADOPT", *["KEEP CURRENT"] * 4]
    assert one(rules.reproduced(n(1.0), n(1.05), 0.1)) is True and one(rules.reproduced(n(None), n(1), 9)) is False
    q = one(rules.question(F.lit(True), s("max_travel_min"), s("grid_near"), s("thin")))
    assert (q.main, q.more) == ("how far farmers travel", ["volume", "connection size and outages", "other places nearby"])
    assert one(rules.question(F.lit(True), s("cop"), s("unknown"), s("well"))).more == []
    box = F.struct(n(29).alias("west"), n(-3).alias("south"), n(31).alias("east"), n(-1).alias("north"))
    status = lambda lon, lat, a, b: one(geo.coordinate_status(n(lon), n(lat), box, n(a), n(b), 0.01))
    assert [status(30, -2, 30, -2), status(30, -2, 30.02, -2), status(30, -2, None, -2.02), status(32, -2, 32, -2), status(float("nan"), -2, 1, 1), status(None, -2, 1, 1)] == ["reported", "conflict", "conflict", "unknown", "unknown", "unknown"]


def test_areas_of_units(spark):
    cells = lambda z, xs, ys: [(z, i, j) for i in xs for j in ys]
    areas = spark.createDataFrame(cells(1, range(0, 4), range(4)) + cells(2, range(6, 12), range(4)) + cells(3, range(30, 33), range(2)), "zone long, i long, j long")
    units = spark.createDataFrame(cells(10, range(0, 8), range(4)) + cells(11, range(8, 20), range(4)), "unit long, i long, j long")
    got = {r.zone: (r.unit, r.outside_m2, r.status, r.touched) for r in spatial.unit_of_areas(areas, units, 10.0).collect()}
    assert got == {1: (10, 0.0, "matched", "10"), 2: (11, 800.0, "spatial_review_required", "10|11"), 3: (None, None, "spatial_review_required", "")}


def test_large_region_in_shares(spark):
    """A region with all nodes, over several ranges, against the level by bisection."""
    rng = np.random.default_rng(11)
    limits = [(7, i, float(v) / 4) for i, v in enumerate(rng.integers(0, 200, 3000))]
    total = sum(v for *_, v in limits) * 0.6
    s, b = allocation.bounded_equal_shares(spark.createDataFrame([(7, total)], "region long, total double"), spark.createDataFrame(limits, "region long, node long, limit double"))
    low, high = 0.0, 50.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(v, mid) for *_, v in limits) < total else (low, mid)
    assert {r.node: r.share for r in s.collect()} == pytest.approx({i: min(v, low) for _, i, v in limits}, abs=1e-6) and b.first().unserved == pytest.approx(0, abs=1e-6)
