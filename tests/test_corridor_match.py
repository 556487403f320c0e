"""Corridor matching and slicing against plain loops over all stops and corridors."""

import math
import random
import re

from wayfold.operators import corridor_match as cm
from wayfold.operators.cleaning import _km

STOPS, RAILS, STATIONS = "trip long, idx int, name string, lng double, lat double", "corridor long, seq int, lng double, lat double", "corridor long, pos int, name string"


def plain(n):
    return re.sub("站$", "", n).strip()


def stem(n):
    return re.sub("[东西南北]$", "", n)


def match(a, b):
    a, b = plain(a), plain(b)
    if not a or not b:
        return False
    if a == b:
        return True
    if stem(a) == stem(b) and len(stem(a)) >= 2 and (stem(a) != a or stem(b) != b):
        return False
    return a in b or b in a


def rival(name, hints):
    n = plain(name)
    if any(plain(h) == n for h in hints) or len(stem(n)) < 2:
        return False
    return any(plain(h) != n and stem(plain(h)) == stem(n) and (stem(plain(h)) != plain(h) or stem(n) != n) for h in hints)


def project(line, x, y):
    best, cum, whole = None, 0.0, sum(_km(*a, *b) for a, b in zip(line, line[1:], strict=False))
    for (ax, ay), (bx, by) in zip(line, line[1:], strict=False):
        k = 111.32 * math.cos(math.radians((ay + by) / 2))
        ux, uy, px, py = (bx - ax) * k, (by - ay) * 110.574, (x - ax) * k, (y - ay) * 110.574
        t = max(0, min(1, (px * ux + py * uy) / (ux * ux + uy * uy)))
        d = math.hypot(px - ux * t, py - uy * t)
        if best is None or d < best[0] - 1e-12:
            best = (d, cum + _km(ax, ay, bx, by) * t, _km(x, y, ax + (bx - ax) * t, ay + (by - ay) * t))
        cum += _km(ax, ay, bx, by)
    return best[2], best[1], whole


def score(stops, line, hints):
    n = len(stops)
    if len(set(hints)) < 2 or n < 2:
        return None
    named = [any(match(s[0], h) for h in hints) for s in stops]
    near, let = [], []
    for _, x, y in stops:
        off, along, whole = project(line, x, y) if x is not None else (1e9, 0, 1)
        tip = min(_km(x, y, *line[0]), _km(x, y, *line[-1])) if x is not None else 1e9
        near.append(off)
        let.append(off <= 15 and (tip <= 12 or 0.03 <= along / whole <= 0.97))
    rivals = [rival(s[0], hints) for s in stops]
    for i in (0, n - 1):
        if not (named[i] or (let[i] if rivals[i] else near[i] <= 15)):
            return None
    placed = [i for i in range(n) if stops[i][1] is not None]
    eligible = [i for i in placed if not rivals[i] or let[i]]
    geo = sum(let[i] if rivals[i] else near[i] <= 20 for i in eligible) / len(eligible) if len(placed) > 1 and len(eligible) > 1 else 0.0
    hit = sum(named)
    if sum(r and not k for r, k in zip(rivals, let, strict=True)) / n >= 0.2 and hit < max(3, math.ceil(n * 0.25)):
        return None
    if not (geo >= 0.5 or (named[0] and named[-1] and hit >= 2) or (hit >= 3 and hit / n >= 0.35)):
        return None
    return geo * 0.65 + hit / n * 0.35, hit


def world(seed):
    rng = random.Random(seed)
    towns = [f"{a}{b}" for a in "安宁江" for b in "州城山"]
    names = towns + [t + s for t in towns[:5] for s in "东北"]
    rails, hints = {}, {}
    for c in range(8):
        x, y = 110 + rng.uniform(0, 0.6), 30 + rng.uniform(0, 0.6)
        rails[c] = [(x + i * rng.uniform(0.1, 0.2), y + i * rng.uniform(-0.05, 0.05)) for i in range(rng.randint(4, 9))]
        hints[c] = rng.sample(names, rng.randint(2, 5))
    trips = {}
    for t in range(40):
        c = rng.randrange(8)
        picks = sorted(rng.sample(range(len(rails[c])), rng.randint(2, min(4, len(rails[c])))), reverse=rng.random() < 0.4)
        stops = []
        for i in picks:
            x, y = rails[c][i]
            far = rng.choice([0.0, 0.01, 0.05, 0.12, 0.9])
            stops.append((rng.choice(hints[c] + names + ["外站"]), None if rng.random() < 0.12 else x + rng.uniform(-far, far), y + rng.uniform(-far, far)))
        trips[t] = stops
    return rails, hints, trips


def tables(spark, rails, hints, trips):
    s = [(t, i, n, x, None if x is None else y) for t, stops in trips.items() for i, (n, x, y) in enumerate(stops)]
    r = [(c, i, *p) for c, line in rails.items() for i, p in enumerate(line)]
    h = [(c, i, n) for c, names in hints.items() for i, n in enumerate(names)]
    return spark.createDataFrame(s, STOPS), spark.createDataFrame(r, RAILS), spark.createDataFrame(h, STATIONS)


def test_scores_and_choice(spark):
    rails, hints, trips = world(4)
    stops, r, h = tables(spark, rails, hints, trips)
    want, best = {}, {}
    for t, s in trips.items():
        for c, line in rails.items():
            got = score(s, line, hints[c])
            if got:
                want[t, c] = (round(got[0], 9), got[1])
                b = best.get(t)
                if b is None or got[0] > b[1] + 0.05 or (abs(got[0] - b[1]) <= 0.05 and (len(line) < b[3] or got[1] > b[2])):
                    best[t] = (c, got[0], got[1], len(line))
    scores = cm.match_scores(stops, r, h)
    assert {(x["trip"], x["corridor"]): (round(x["score"], 9), x["hits"]) for x in scores.collect()} == want and len(want) > 20
    assert {x["trip"]: x["corridor"] for x in cm.best_corridor(scores).collect()} == {t: b[0] for t, b in best.items()}
    assert cm.match_scores(stops.limit(0), r, h).count() == 0 == cm.match_scores(stops, r.limit(0), h).count()


def cut(stops, line, hints):
    def end(i, terminal, tip):
        name, x, y = stops[i]
        called = any(match(name, h) for h in terminal)
        if x is None:
            return tip if called else None
        return tip if called and project(line, x, y)[0] > 25 else (x, y)

    a, b = end(0, hints[:2], line[0]), end(-1, hints[-2:], line[-1])
    if not a or not b:
        return "no_end", None
    (offa, ka, whole), (offb, kb, _) = project(line, *a), project(line, *b)
    if max(offa, offb) > 45:
        return "off_line", None
    lo, hi = sorted((ka, kb))
    if (hi - lo) / whole < 0.0005:
        return "no_length", None
    cum, out = 0.0, []
    for i, p in enumerate(line):
        cum += _km(*line[i - 1], *p) if i else 0.0
        if lo < cum < hi:
            out.append(p)

    def at(km):
        cum = 0.0
        for p, q in zip(line, line[1:], strict=False):
            d = _km(*p, *q)
            if km < cum + d or q == line[-1]:
                t = (km - cum) / d
                return p[0] + (q[0] - p[0]) * t, p[1] + (q[1] - p[1]) * t
            cum += d

    out = [at(lo), *out, at(hi)]
    out = out[::-1] if ka > kb else out
    s, t = out[0], out[-1]
    out = [(round(a[0], 6), round(a[1], 6))] * (0.2 < _km(*a, *s) < 8) + out + [(round(b[0], 6), round(b[1], 6))] * (0.2 < _km(*b, *t) < 8)
    placed = [a, *[(x, y) for _, x, y in stops[1:-1] if x is not None], b]
    if sum(project(out, *p)[0] <= 40 for p in placed) < math.ceil(len(placed) * 0.55):
        return "stops", None
    chord = sum(_km(*p, *q) for p, q in zip(placed, placed[1:], strict=False))
    if chord > 80 and project(out, *a)[2] < chord * 0.45:
        return "length", None
    return "ok", out


def test_slices(spark):
    rails, hints, trips = world(9)
    rng = random.Random(1)
    chosen = {t: rng.randrange(8) if rng.random() < 0.3 else min(rails, key=lambda c: min(_km(*p, s[1], s[2]) for p in rails[c] for s in trips[t] if s[1] is not None) if any(s[1] is not None for s in trips[t]) else 0) for t in trips}  # noqa: B023
    stops, r, h = tables(spark, rails, hints, trips)
    points, verdicts = cm.slices(stops, spark.createDataFrame(list(chosen.items()), "trip long, corridor long"), r, h)
    want = {t: cut(trips[t], rails[c], hints[c]) for t, c in chosen.items()}
    assert {x["trip"]: x["stage"] for x in verdicts.collect()} == {t: w[0] for t, w in want.items()}
    got = {}
    for x in points.orderBy("trip", "i").collect():
        got.setdefault(x["trip"], []).append((round(x["lng"], 6), round(x["lat"], 6)))
    assert got == {t: [(round(x, 6), round(y, 6)) for x, y in w[1]] for t, w in want.items() if w[1]}
    assert {"ok", "no_end"} <= {w[0] for w in want.values()}
