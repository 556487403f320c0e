"""Ways stitched between places, and traced lines, against plain searches over (way, end)."""

import heapq
import random

from wayfold.operators import routing, stitching
from wayfold.operators.cleaning import _km

POINTS, PAIRS = "way long, seq int, lng double, lat double", "pair long, a_lng double, a_lat double, b_lng double, b_lat double"


def length(w):
    return sum(_km(*p, *q) for p, q in zip(w, w[1:], strict=False))


def plain(ways, a, b, snap, tol):
    """The line of a pair by Dijkstra over the ends at which ways are left, clipped at both places."""
    if _km(*a, *b) < 0.5:
        return [a, b]
    near = [min(((_km(*p, *v), w, i) for w, pts in ways.items() for i, v in enumerate(pts))) for p in (a, b)]
    if max(n[0] for n in near) > snap:
        return None
    first, last = near[0][1], near[1][1]
    best, came, todo = {}, {}, [(0.0, first, 0, None), (0.0, first, 1, None)]
    while todo:
        c, w, side, before = heapq.heappop(todo)
        if (w, side) in best:
            continue
        best[w, side], came[w, side] = c, before
        x, y = ways[w][-1 if side else 0]
        for o, pts in ways.items():
            for s, (ox, oy) in ((0, pts[0]), (1, pts[-1])):
                if o != w and ((x - ox) ** 2 + (y - oy) ** 2) ** 0.5 < tol and (o, 1 - s) not in best:
                    heapq.heappush(todo, (c + length(pts), o, 1 - s, (w, side)))
    ends = [(best[last, s], s) for s in (0, 1) if (last, s) in best]
    if not ends:
        return None
    if first == last:
        line = list(ways[first])
    else:
        at, path = (last, min(ends)[1]), []
        while at:
            path.append(at)
            at = came[at]
        line = []
        for w, side in reversed(path):
            pts = ways[w] if side == 1 else ways[w][::-1]
            line += pts[1:] if line else pts
    cut = sorted(min(range(len(line)), key=lambda i: _km(*line[i], *p)) for p in (a, b))
    return line[cut[0] : cut[1] + 1] if cut[1] > cut[0] else line


def test_lines_equal_a_plain_search(spark):
    rng = random.Random(6)
    node = {(x, y): (100 + x / 20 + rng.uniform(-1, 1) / 300, 30 + y / 20 + rng.uniform(-1, 1) / 300) for x in range(5) for y in range(5)}
    ways, near = {}, lambda p: (p[0] + rng.uniform(-1, 1) / 900, p[1] + rng.uniform(-1, 1) / 900)
    for (x, y), p in node.items():
        for q in ((x + 1, y), (x, y + 1)):
            if q in node and rng.random() < 0.75:
                a, b = (near(p), near(node[q])) if rng.random() < 0.5 else (near(node[q]), near(p))
                ways[len(ways)] = [a, ((a[0] + b[0]) / 2, (a[1] + b[1]) / 2 + rng.uniform(-1, 1) / 100), b]
    ways[90] = [(102.0, 33.0), (102.05, 33.0)]  # apart from all others
    pairs = {i: (rng.choice(list(node.values())), rng.choice(list(node.values()))) for i in range(25)}
    pairs |= {50: ((102.0, 33.0), (102.05, 33.0)), 51: ((102.0, 33.0), node[1, 1]), 52: ((105.0, 35.0), node[1, 1]), 53: (node[2, 2], (node[2, 2][0] + 0.001, node[2, 2][1]))}
    want = {i: line for i, (a, b) in pairs.items() if (line := plain(ways, a, b, 8.0, 0.012))}
    points = spark.createDataFrame([(w, i, *p) for w, pts in ways.items() for i, p in enumerate(pts)], POINTS)
    out = stitching.stitched_lines(points, spark.createDataFrame([(i, *a, *b) for i, (a, b) in pairs.items()], PAIRS))
    got = {}
    for r in out.orderBy("pair", "i").collect():
        got.setdefault(r["pair"], []).append((r["lng"], r["lat"]))
    assert got == want and 50 in got and 51 not in got and 52 not in got and len(got[53]) == 2


def test_traces_pass_all_controls(spark):
    """Two parts of a graph: within a part the line goes on, between them it stops at the nearest node and a gap follows."""
    nodes = [(i, 100 + i / 50, 30.0, True) for i in range(6)] + [(10 + i, 100.3 + i / 50, 30.0, True) for i in range(4)]
    edges = [(0, i, i + 1, 1.0, 1.0, 0) for i in range(5)] + [(0, 10 + i, 11 + i, 1.0, 1.0, 0) for i in range(3)]
    n = spark.createDataFrame(nodes, "node long, lng double, lat double, main boolean")
    e = routing.with_ids(spark.createDataFrame(edges, "g int, a long, b long, w double, km double, line long"))
    at = {i: (x, y) for i, x, y, _ in nodes}
    controls = [(1, 0, *at[1]), (1, 1, *at[3]), (1, 2, 120.0, 40.0), (1, 3, *at[12]), (1, 4, *at[10]), (1, 5, *at[10]), (2, 0, *at[2])]
    steps, gaps = stitching.traces(spark.createDataFrame(controls, "line long, seq int, lng double, lat double"), n, e)
    got = {}
    for r in steps.orderBy("line", "leg", "back").collect():
        got.setdefault((r["line"], r["leg"]), []).append(r["node"])
    assert got == {(1, 1): [3, 2, 1], (1, 2): [5, 4, 3], (1, 3): [10, 11, 12], (1, 4): [10]}
    assert [(r["line"], r["leg"], r["from_node"], r["to_node"]) for r in gaps.collect()] == [(1, 2, 5, 12)]
