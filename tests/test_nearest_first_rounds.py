"""Allocation in order of edges: many origins of a node are settled in a round, with results as one by one."""

import random

from sitewright.operators import allocation


def one_by_one(edges, mass, room):
    m, c, out = dict(mass), dict(room), {}
    for o, n, _ in sorted(edges, key=lambda e: (e[2], e[0], e[1])):
        give = m[o] if c[n] is None else min(m[o], c[n])
        if give > 0:
            out[(o, n)] = give
            m[o] -= give
            c[n] = None if c[n] is None else c[n] - give
    return out


def tables(spark, edges, mass, room):
    return spark.createDataFrame(edges, "origin long, node long, minutes double"), spark.createDataFrame(list(mass.items()), "origin long, mass double"), spark.createDataFrame(list(room.items()), "node long, capacity double")


def test_crowded_nodes_take_few_rounds(spark, monkeypatch):
    """Forty origins around one node were forty rounds."""
    rounds, kept = [], allocation.saved
    monkeypatch.setattr(allocation, "saved", lambda df, name: (rounds.append(name), kept(df, name))[1])
    edges = [(o, 0, float(o)) for o in range(40)] + [(o, 1, 50.0 + o) for o in range(40)]
    mass, room = {o: 2.0 for o in range(40)}, {0: 31.0, 1: None}
    got = allocation.nearest_first(*tables(spark, edges, mass, room))
    assert {(r.origin, r.node): r.tonnes for r in got.collect()} == one_by_one(edges, mass, room)
    assert rounds.count("settled") <= 3


def test_ties_and_blocked_offers_as_one_by_one(spark):
    rng = random.Random(8)
    for _ in range(3):
        edges = [(o, n, float(rng.randint(1, 4))) for o in range(14) for n in range(6) if rng.random() < 0.7]
        mass, room = {o: float(rng.randint(0, 9)) for o in range(14)}, {n: None if n == 5 and rng.random() < 0.5 else float(rng.randint(0, 25)) for n in range(6)}
        got = allocation.nearest_first(*tables(spark, edges, mass, room))
        assert {(r.origin, r.node): r.tonnes for r in got.collect()} == one_by_one(edges, mass, room)
