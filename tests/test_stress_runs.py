"""Stress runs against a plain version that fills shares by bisection, run after run."""

import hashlib
import random

from pyspark.sql import functions as F

from sitewright.operators import stress

LEVELS = {"production": [30], "location": [25, 60], "facility": [50]}


def picked(keys, run, seed, percent):
    h = lambda k: int(hashlib.md5(":".join(map(str, (seed, *run, k))).encode()).hexdigest()[:12], 16)
    return set(sorted(keys, key=lambda k: (h(k), k))[: round(percent * len(keys) / 100)])


def filled(total, limits):
    if not limits or sum(limits.values()) <= total:
        return dict(limits)
    low, high = 0.0, total + 1
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(mid, x) for x in limits.values()) < total else (low, mid)
    return {k: min(high, x) for k, x in limits.items()}


def needs(totals, nodes, hidden, mechanism):
    """{node: need or None} and the largest residual."""
    known = {r: t for r, t in totals.items() if t is not None and not (mechanism == "production" and r in hidden)}
    kept = {k: (None if mechanism == "location" and k in hidden else r, lim) for k, (r, lim) in nodes.items() if not (mechanism == "facility" and k in hidden)}
    out = dict.fromkeys(kept)
    for r, t in known.items():
        out |= filled(t, {k: 1e12 if lim is None else lim for k, (own, lim) in kept.items() if own == r})
    return {k: None if v is None else v * 2 for k, v in out.items()}


def best(kw, size):
    ranked = sorted((v for v in kw.values() if v is not None), reverse=True)
    return {k for k, v in kw.items() if v is not None and v >= ranked[min(size, len(ranked)) - 1] - 1e-6} if ranked else set()


def test_runs_against_plain(spark):
    rng = random.Random(11)
    totals = {r: None if r == 4 else rng.uniform(20, 60) for r in range(7)}
    nodes = {k: (None if k % 11 == 0 else rng.randrange(8), None if k % 9 == 0 else rng.choice([2.0, 3.0, 5.0, 8.0])) for k in range(40)}
    t = spark.createDataFrame(list(totals.items()), "region long, total double")
    n = spark.createDataFrame([(k, *v) for k, v in nodes.items()], "node long, region long, limit double")
    screened = stress.screened(*stress.degraded(t, n, LEVELS, 3, 5), lambda c: c * 2)
    got = {(r.mechanism, r.percent, r.rep): r for r in stress.measured(*screened, 5, 1e-6).collect()}
    base = needs(totals, nodes, set(), None)
    top0 = best(base, 5)
    runs = stress.runs_of(LEVELS, 3)
    assert set(got) == set(runs) and len(runs) == 12
    for run in runs:
        keys = [r for r, x in totals.items() if x is not None] if run[0] == "production" else list(nodes)
        kw = needs(totals, nodes, picked(keys, run, 5, run[1]), run[0])
        top, ranked, r = best(kw, 5), {k for k, v in kw.items() if v is not None}, got[run]
        assert (r.ranked, r.reported_unknown, r.top_size, r.entrants) == (len(ranked), len(kw) - len(ranked), len(top), len(top - top0))
        assert abs(r.retention - len(top & top0) / len(top0)) < 1e-9
        alive = top0 & ranked
        assert r.retention_among_surviving is None if not alive else abs(r.retention_among_surviving - len(top & alive) / len(alive)) < 1e-9
        assert r.entrants_inflated == sum(1 for k in top - top0 if base[k] is not None and kw[k] > base[k] + 1e-6)
        assert abs(r.max_inflation - (max([kw[k] / base[k] for k in ranked if base[k]], default=1) - 1)) < 1e-6
        assert r.abstention_violations == 0 and r.max_residual < 1e-9


def test_measures_can_fail_and_empty_tables(spark):
    """A ranked node that is hidden, or tonnes that are lost, show; without nodes there is nothing to retain."""
    rows = [(stress.BASE, 0, 0, 1, 5.0, False), (stress.BASE, 0, 0, 2, 4.0, False), ("location", 50, 0, 1, None, True), ("location", 50, 0, 2, 6.0, True)]
    n = spark.createDataFrame(rows, "mechanism string, percent int, rep int, node long, kw double, gone boolean")
    b = spark.createDataFrame([("location", 50, 0, 3, 10.0, 6.0, 1.0)], "mechanism string, percent int, rep int, region long, total double, assigned double, unserved double")
    r = stress.measured(n, b, 1, 1e-9).first()
    assert (r.abstention_violations, r.max_residual, r.retention, r.retention_among_surviving, r.entrants_inflated, r.max_inflation) == (1, 3, 0, None, 1, 0.5)
    t, m = spark.createDataFrame([], "region long, total double"), spark.createDataFrame([], "node long, region long, limit double")
    assert stress.stress(t, m, lambda c: c, LEVELS, 2, 1).collect() == []


def test_quantiles_are_the_lower_place(spark):
    rows = spark.createDataFrame([("location", 10, i, float(i * i)) for i in range(7)] + [("location", 20, 0, None)], "mechanism string, percent int, rep int, a double")
    got = {r.percent: r for r in stress.summary(rows.withColumn("b", F.lit(1.0)), ["a", "b"]).filter("measure = 'a'").collect()}
    assert (got[10].p05, got[10].p95, got[10].least, got[10].most, got[10].runs) == (0, 36, 0, 36, 7)
    assert got[20].p05 is None and got[20].runs == 0
