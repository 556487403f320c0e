"""Cleaning rules against loops that start over after every change."""

import math
import random

import numpy as np
import pytest

from wayfold.operators import cleaning as c


def km(p, q):
    return c._km(*p, *q)


def wiggle(seed, n=60, step=0.03):
    rng = random.Random(seed)
    out, x, y = [], 100.0, 30.0
    for _ in range(n):
        x, y = x + rng.uniform(-0.4, 1) * step, y + rng.uniform(-0.8, 0.8) * step
        out.append((round(x, 6), round(y, 6)))
        if rng.random() < 0.15:
            out.append((round(x + rng.uniform(-6, 6) * step, 6), round(y + rng.uniform(-6, 6) * step, 6)))
        if rng.random() < 0.15 and len(out) > 4:
            out += out[-2:-5:-1]
    return out


def start_over(pts, first_bad):
    pts = list(enumerate(pts))
    while (cut := first_bad([p for _, p in pts])) is not None:
        del pts[cut]
    return [i for i, _ in pts]


def first_spike(p):
    for i in range(1, len(p) - 1):
        ab, bc, ac = km(p[i - 1], p[i]), km(p[i], p[i + 1]), km(p[i - 1], p[i + 1])
        if ab >= 0.08 and bc >= 0.08 and c._turn(*p[i - 1], *p[i], *p[i + 1]) >= 145 and ac < max(ab, bc) * 1.08:
            return slice(i, i + 1)


def first_protrusion(p):
    for i in range(2, len(p) - 2):
        for w in (1, 2, 3, 4):
            if i - w < 0 or i + w >= len(p):
                continue
            ab, bc, ac = km(p[i - w], p[i]), km(p[i], p[i + w]), km(p[i - w], p[i + w]) or 1e-6
            s = (ab + bc + ac) / 2
            if 2 * math.sqrt(max(0, s * (s - ab) * (s - bc) * (s - ac))) / ac >= 2 and ab + bc - ac >= 2.5:
                return slice(i, i + 1)


def first_retrace(p):
    for i in range(2, len(p) - 3):
        if c._turn(*p[i - 1], *p[i], *p[i + 1]) < 160:
            continue
        jump = next((j for j in range(i + 3, min(len(p) - 1, i + 25) + 1) if km(p[j - 1], p[j]) > 3.5), None)
        if jump and sum(km(p[i], q) < 8 for q in p[i + 1 : jump]) >= 2:
            return slice(i + 1, jump)


@pytest.mark.parametrize("seed", range(12))
@pytest.mark.parametrize("rule, naive", [(c.spike_free, first_spike), (c.protrusion_free, first_protrusion), (c.retrace_free, first_retrace)])
def test_rules_reach_the_fixed_point(rule, naive, seed):
    pts = wiggle(seed, step=[0.004, 0.01, 0.03][seed % 3])
    xy = np.array(pts)
    assert rule(xy[:, 0], xy[:, 1]) == start_over(pts, naive)


def test_the_rules_find_something():
    found = {rule.__name__: sum(len(w) - len(rule(*np.array(w).T)) for w in (wiggle(s, step=[0.004, 0.01, 0.03][s % 3]) for s in range(12))) for rule in (c.spike_free, c.protrusion_free, c.retrace_free)}
    assert all(found.values()), found


def test_loops_out_and_back_go_and_rings_stay():
    out = [(100 + i / 20, 30.0) for i in range(8)]
    spur = [(100.2, 30.0 + i / 20) for i in range(1, 5)]
    line = out[:5] + spur + spur[-2::-1] + out[4:]  # 20 km up and back at the fifth point
    kept = c.loop_free(*np.array(line).T)
    # The middle of the spur is apart from the way there, so the spur counts as a ring; a way back on the line itself does not.
    assert len(kept) == len(line)
    back = out + out[-2::-1] + [(99.9, 30.0)]
    assert [back[i] for i in c.loop_free(*np.array(back).T)][-1] == (99.9, 30.0)
    ring = [(100 + math.cos(t / 10) / 2, 30 + math.sin(t / 10) / 2) for t in range(63)]
    ring.append(ring[0])
    assert len(c.loop_free(*np.array(ring).T)) == len(ring)
    there_and_back = [(100.0, 30.0), (100.1, 30.0), (100.1001, 30.0), (100.2, 30.0), (100.1001, 30.0), (100.1, 30.0), (100.0, 30.0), (99.5, 30.0)]
    assert c.loop_free(*np.array(there_and_back).T)[-1] == 7


def lines(spark, seeds):
    rows = [(s, i, *p) for s in seeds for i, p in enumerate(wiggle(s))]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "line_id long, seq long, lng double, lat double"), {s: wiggle(s) for s in seeds}


def kept(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["line_id"], []).append(r["seq"])
    return {k: sorted(v) for k, v in out.items()}


def test_lines_in_tables(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)  # lines go over several batches
    try:
        df, pts = lines(spark, range(9))
        for op, rule in ((c.without_spikes, c.spike_free), (c.without_protrusions, c.protrusion_free), (c.without_retraces, c.retrace_free), (c.without_loops, c.loop_free)):
            assert kept(op(df)) == {s: rule(*np.array(p).T) for s, p in pts.items()}
        want = {}
        for s, p in pts.items():
            keep = [0]
            for i in range(1, len(p)):
                if km(p[keep[-1]], p[i]) >= 2.0:
                    keep.append(i)
            if keep[-1] != len(p) - 1 and max(abs(p[keep[-1]][0] - p[-1][0]), abs(p[keep[-1]][1] - p[-1][1])) > 0.0001:
                keep.append(len(p) - 1)
            want[s] = keep
        assert kept(c.spaced(df, 2.0)) == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10000)
    assert c.spaced(df.limit(0)).count() == 0 == c.without_spikes(df.limit(0)).count()


def test_revisits(spark):
    df, pts = lines(spark, range(6))
    want = {}
    for s, p in pts.items():
        arc = [0.0]
        for a, b in zip(p, p[1:], strict=False):
            arc.append(arc[-1] + km(a, b))
        keep = [0]
        for i in range(1, len(p) - 1):
            if not any(arc[i] - arc[j] >= 25 and km(p[i], p[j]) < 1.5 for j in keep):
                keep.append(i)
        want[s] = [*keep, len(p) - 1]
    assert kept(c.without_revisits(df)) == want


def test_zigzags(spark):
    rng = random.Random(2)
    trips = {t: [(rng.uniform(100, 108), rng.uniform(28, 33)) if rng.random() < 0.85 else None for _ in range(9)] for t in range(30)}
    rows = [(t, i, *(p or (None, None))) for t, s in trips.items() for i, p in enumerate(s)]
    want = set()
    for t, s in trips.items():
        s = list(s)
        for _ in range(8):
            for i in range(1, len(s) - 1):
                if s[i - 1] and s[i] and s[i + 1]:
                    direct, via = km(s[i - 1], s[i + 1]), km(s[i - 1], s[i]) + km(s[i], s[i + 1])
                    if direct > 40 and via > 1.75 * direct and via - direct > 50:
                        s[i] = None
        want |= {(t, i) for i, p in enumerate(s) if p}
    got = c.scrub_zigzags(spark.createDataFrame(rows, "trip long, seq long, lng double, lat double"))
    assert {(r["trip"], r["seq"]) for r in got.where("lng IS NOT NULL").collect()} == want and got.count() == len(rows)
