"""The travel matrix has every building as an origin, against plain searches."""

import heapq
from collections import Counter, defaultdict

from tests.test_plain import apart, places, roads, run


def test_every_building_is_an_origin(spark, sf):
    edges, at = roads(sf)
    b, s = places(sf)
    spots, to = sorted(at), defaultdict(list)
    nodes = b.iloc[:0][["id", "x", "y"]].reindex(range(len(spots))).assign(id=spots, x=[at[k][0] for k in spots], y=[at[k][1] for k in spots])
    for (a, c), t in edges.items():
        to[c].append((a, t))

    def snap(points, cap):
        d = apart(points, nodes)
        return {i: (spots[k], d[n, k] * 1.3 / (4000 / 60)) for n, (i, k) in enumerate(zip(points.id, d.argmin(1))) if d[n, k] < cap}

    start, want = snap(b, 1500), {}
    for site, (v, t) in snap(s, 3000).items():
        best, heap = {}, [(t, v)]
        while heap:
            t, v = heapq.heappop(heap)
            if v in best or t > 60:
                continue
            best[v] = t
            for a, m in to[v]:
                heapq.heappush(heap, (t + m, a))
        for o in b.id:
            v, w = start.get(o, (None, 0.0))
            m = best[v] + w if v in best else None
            want[o, site] = (None if m is None or m > 60 else m, "snap_failure" if v is None else "reachable" if m is not None and m <= 60 else "unreachable_or_over_budget")
    got = {(r.origin, r.site): (r.minutes, r.status) for r in run(spark, sf, "gra9_travel_matrix")}
    assert got.keys() == want.keys() and {o for o, _ in got} == set(b.id)
    assert Counter(x for _, x in want.values())["reachable"] > 0
    for k, (minutes, status) in want.items():
        assert got[k][1] == status and (minutes is None or abs(got[k][0] - minutes) < 1e-5)
