"""People in reach and keyed shortest times against plain versions."""

from __future__ import annotations

import heapq
import random

import pytest

from sitewright.operators.catchments import minute_counts, people_within
from sitewright.operators.graph import shortest


@pytest.fixture(scope="module")
def owners():
    r = random.Random(5)
    rows = [(r.choice("ab"), r.choice([1, 2, 3]), round(r.uniform(0, 35), 2), r.choice([True, False, None])) for _ in range(400)]
    return rows + [("a", 1, 12.5, False), ("a", 1, 12.0, True), ("a", 2, 0.0, False), ("b", None, None, True), ("b", 3, 30.0, True)]


SITES = [("a", 1), ("a", 2), ("a", 9), ("b", 1), ("b", 3), ("b", 3)]
OWNERS, PLACES = "season string, owner int, t double, urban boolean", "season string, site int"


def test_people_within_limits_as_counted_one_by_one(spark, owners):
    asked = [(0, 12.5), (1, 12.0), (2, 12.5), (3, 0.0), (4, 30.0), (5, -1.0), (6, None), (7, 17.34)]
    got = people_within(spark.createDataFrame(owners, OWNERS), spark.createDataFrame(SITES, PLACES), spark.createDataFrame(asked, "draw int, limit double"), 30, 0.15, ("season",))
    got = {(g["season"], g["site"], g["draw"]): (g["rural"], g["urban"], g["weighted"]) for g in got.collect()}
    assert len(got) == len(set(SITES)) * len(asked)
    for season, site in set(SITES):
        for draw, limit in asked:
            if limit is None:
                assert got[season, site, draw] == (None, None, None)
                continue
            mine = [u for s, o, t, u in owners if s == season and o == site and t <= limit]
            town = sum(u is True for u in mine)
            assert got[season, site, draw] == (len(mine) - town, town, len(mine) - town + 0.15 * town)


def test_a_limit_beyond_the_search_raises_and_empty_tables_count_nothing(spark, owners):
    limits = lambda *x: spark.createDataFrame([(float(v),) for v in x], "limit double")
    sites = spark.createDataFrame(SITES, PLACES)
    with pytest.raises(Exception, match="beyond the search"):
        people_within(spark.createDataFrame(owners, OWNERS), sites, limits(31), 30, 0.15, ("season",)).collect()
    none = people_within(spark.createDataFrame([], OWNERS), sites, limits(7), 30, 0.15, ("season",)).collect()
    assert len(none) == 5 and all(r["weighted"] == 0 for r in none)
    assert people_within(spark.createDataFrame(owners, OWNERS), sites.limit(0), limits(7), 30, 0.15, ("season",)).count() == 0
    assert minute_counts(spark.createDataFrame(owners, OWNERS), sites, 30, ("season",)).count() == 5 * 32


@pytest.mark.parametrize("merge", [1, 3, 12])
def test_searches_by_key_on_edges_of_their_own(spark, merge):
    r = random.Random(merge)
    edges = [(k, r.randrange(30), r.randrange(30), float(r.randrange(1, 9))) for k in ("dry", "rainy") for _ in range(70)]
    sources = [(k, r.randrange(30), float(r.randrange(3)), o) for k in ("dry", "rainy") for o in (4, 7, 9)] + [("dry", 2, 99.0, 1)]
    got = shortest(spark.createDataFrame(edges, "season string, src int, dst int, minutes double"), spark.createDataFrame(sources, "season string, v int, t double, owner int"), 20.0, ("season",), merge)
    want = {}
    for key in ("dry", "rainy"):
        heap, seen = [(t, o, v) for k, v, t, o in sources if k == key and t <= 20], {}
        heapq.heapify(heap)
        while heap:
            t, o, v = heapq.heappop(heap)
            if v in seen:
                continue
            seen[v] = (t, o)
            for k, a, b, m in edges:
                if k == key and a == v and t + m <= 20:
                    heapq.heappush(heap, (t + m, o, b))
        want |= {(key, v): x for v, x in seen.items()}
    assert {(g["season"], g["v"]): (g["t"], g["owner"]) for g in got.collect()} == want
