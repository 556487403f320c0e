"""Per-trip operators whose steps depend on each other: isotonic mileage, simplification, fusion and sampling.

Each has a small step function in Python; Spark groups by trip or line, so a group is one trip.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wayfold.operators.lines import line_stats, segments
from wayfold.operators.spatial import nearest_segment


def pool_adjacent(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Weighted non-decreasing fit with least squares; weights not above 0 count as 1, values that are not finite as 0."""
    w = np.where(weights > 0, weights, 1.0)
    v = np.where(np.isfinite(values), values, 0.0)
    mean, weight, count = [], [], []
    for x, y in zip(v, w, strict=True):
        mean.append(x), weight.append(y), count.append(1)
        while len(mean) > 1 and mean[-1] < mean[-2]:
            x2, y2, n2 = mean.pop(), weight.pop(), count.pop()
            mean[-1] = (mean[-1] * weight[-1] + x2 * y2) / (weight[-1] + y2)
            weight[-1] += y2
            count[-1] += n2
    return np.repeat(mean, count)


def with_per_key(rows: DataFrame, key: str, order: str, added: dict[str, str], step: Callable[[dict[str, np.ndarray]], tuple]) -> DataFrame:
    """Add columns that a step over each key's rows in order gives: step(columns) returns an array, or one value, for each added column.

    A partition is sorted and read as a stream, many keys a batch; what is held is a batch and the rows of the key
    that goes on in the next one. Columns of rows named like added ones are replaced.
    """
    rows = rows.drop(*added)
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names, types = rows.columns, {"double": pa.float64(), "string": pa.string(), "long": pa.int64()}

    def finish(table: pa.Table, bounds: list[int]) -> pa.RecordBatch:
        columns = {n: table.column(n).to_numpy() for n in names}
        out: dict[str, list] = {n: [] for n in added}
        for a, b in zip(bounds, bounds[1:], strict=False):
            for (n, held), got in zip(out.items(), step({c: v[a:b] for c, v in columns.items()}), strict=True):
                held.extend(got.tolist() if isinstance(got, np.ndarray) else [got] * (b - a))
        whole = table.slice(0, bounds[-1]).combine_chunks()
        extra = [pa.array(out[n], types[t], from_pandas=True) for n, t in added.items()]
        return pa.RecordBatch.from_arrays([*(c.combine_chunks() for c in whole.columns), *extra], names=[*names, *added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            codes = pa.chunked_array([b.column(names.index(key)) for b in held]).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
            ends = (np.flatnonzero(codes[1:] != codes[:-1]) + 1).tolist()
            if ends:
                table = pa.Table.from_batches(held)
                yield finish(table, [0, *ends])
                held = table.slice(ends[-1]).to_batches()
        if held:
            table = pa.Table.from_batches(held)
            yield finish(table, [0, table.num_rows])

    schema = ", ".join([f"`{n}` {t}" for n, t in rows.dtypes] + [f"{n} {t}" for n, t in added.items()])
    return rows.repartition(parts, key).sortWithinPartitions(key, order).mapInArrow(run, schema)


def isotonic(rows: DataFrame, key: str, order: str, value: str, weight: str) -> DataFrame:
    """Add fitted, the isotonic regression of value over order within each key."""
    return with_per_key(rows, key, order, {"fitted": "double"}, lambda c: (pool_adjacent(c[value].astype(float), c[weight].astype(float)),))


#: Metres between stops at least; metres off the line of a stop without a place, and what is added to it in a weight.
LEAST_M, UNKNOWN_M, WEIGHT_M = 200.0, 1000.0, 200.0


def _filled(raw: np.ndarray, time: np.ndarray) -> np.ndarray:
    """Fill what is not finite between known values in proportion to time, else to position; beyond them the nearest holds, or 0."""
    known = np.flatnonzero(np.isfinite(raw))
    out = raw.copy()
    for i in np.flatnonzero(~np.isfinite(raw)).tolist():
        k = int(np.searchsorted(known, i))
        if 0 < k < len(known):
            a, b = known[k - 1], known[k]
            timed = np.isfinite(time[[a, i, b]]).all() and time[b] != time[a]
            out[i] = raw[a] + (raw[b] - raw[a]) * ((time[i] - time[a]) / (time[b] - time[a]) if timed else (i - a) / (b - a))
        elif len(known):
            out[i] = raw[known[0] if k == 0 else known[-1]]
        else:
            out[i] = 0.0
    return out


def axis_of(along: np.ndarray, off: np.ndarray, time: np.ndarray, placed: np.ndarray, length: float) -> tuple:
    """Metres of a trip's stops along its line, their metres off it, their weights, and how the axis is degraded.

    along, off: metres of the stops' projections, NaN where a stop has no place; time: seconds, NaN if unknown; placed: which stops have a
    place; length: metres of the line, NaN or 0 if there is none. The first stop is at 0, the last at the end; others keep their order and
    lie at least 200 m apart, as far as there is room.
    """
    n = len(along)
    even = np.arange(n) / max(1, n - 1) * (length if length > 0 else 0.0)
    if not length > 0:
        return even, np.zeros(n), np.ones(n), "zero_length"
    if not placed.any():
        return even, np.zeros(n), np.ones(n), "all_missing"
    raw, dist = along.astype(float).copy(), off.astype(float).copy()
    raw[0], dist[0] = 0.0, 0.0
    if n > 1:
        raw[-1], dist[-1] = length, 0.0
    weights = 1 / (np.where(np.isfinite(dist), dist, UNKNOWN_M) + WEIGHT_M)
    fit = pool_adjacent(_filled(raw, time), weights)
    fit[0] = 0.0
    fit[-1] = length if n > 1 else 0.0
    fit = spread_apart(fit, LEAST_M)
    falls = int((np.diff(fit) < -1).sum())
    return fit, dist, weights, "severe_disorder" if falls > n * 0.3 else "none"


def mileage_axis(stops: DataFrame, points: DataFrame) -> DataFrame:
    """Lay each trip's stops on one axis: stops with axis_m, off_m (null without a place), weight and degradation.

    stops: trip, idx, at (a time, may be null), lng, lat; points: line_id (the trip), seq, lng, lat. Stops are projected onto their trip's
    line, gaps are filled by the timetable, order is restored by isotonic regression with less weight for
    stops off the line, ends are pinned and neighbours spread. A trip without a line has zero length, one without any place is even.
    """
    total = line_stats(points).where("n_points > 1").select(F.col("line_id").alias("trip"), (F.col("length_km") * 1000).alias("_length"))
    inner = stops.where("lng IS NOT NULL AND lat IS NOT NULL").select(F.col("trip").alias("line_id"), "idx", "lng", "lat")
    on = nearest_segment(inner.join(segments(points), "line_id"), ["line_id", "idx"], ["lng", "lat"], rounded=False).select(F.col("line_id").alias("trip"), "idx", (F.col("along_km") * 1000).alias("_along"), (F.col("dist_km") * 1000).alias("_off"))
    j = stops.join(on, ["trip", "idx"], "left").join(total, "trip", "left")
    j = j.withColumns({"_time": F.col("at").cast("double"), "_placed": (F.col("lng").isNotNull() & F.col("lat").isNotNull()).cast("double"), "_length": F.coalesce("_length", F.lit(0.0))})

    def step(c: dict[str, np.ndarray]) -> tuple:
        return axis_of(c["_along"].astype(float), c["_off"].astype(float), c["_time"].astype(float), c["_placed"] > 0, float(c["_length"][0]))

    keep = ["trip", "idx", "_along", "_off", "_time", "_placed", "_length"]
    out = with_per_key(j.select(*keep), "trip", "idx", {"axis_m": "double", "off_m": "double", "weight": "double", "degradation": "string"}, step)
    return stops.join(out.select("trip", "idx", "axis_m", "off_m", "weight", "degradation"), ["trip", "idx"])


def spread_apart(values: np.ndarray, least: float) -> np.ndarray:
    """Push neighbours at least so far apart, shrinking what follows so that the end stays where it was."""
    out = values.astype(float).copy()
    if len(out) < 2 or out[-1] <= out[0]:
        return out
    for i in range(1, len(out)):
        gap = out[i] - out[i - 1]
        if gap < least:
            old, new = out[i], out[i - 1] + least
            rest = out[-1] - old
            if rest > least - gap:
                out[i + 1 :] = new + (out[i + 1 :] - old) * (rest - (least - gap)) / rest
            out[i] = new
    return out


def fill_by_time(rows: DataFrame, key: str, order: str, value: str, time: str) -> DataFrame:
    """Fill missing values between known ones in proportion to time, else to position; ends take the nearest known value, or 0."""
    w = Window.partitionBy(key).orderBy(order)
    at = F.row_number().over(w)
    r = rows.withColumn("_n", at)
    known = F.when(F.col(value).isNotNull(), F.struct(F.col(value).alias("v"), F.col(time).cast("double").alias("t"), F.col("_n").alias("n")))
    r = r.withColumn("_a", F.last(known, ignorenulls=True).over(w)).withColumn("_b", F.first(known, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)))
    t = F.col(time).cast("double")
    by_time = (t - F.col("_a.t")) / F.when(F.col("_b.t") != F.col("_a.t"), F.col("_b.t") - F.col("_a.t"))
    by_place = (F.col("_n") - F.col("_a.n")) / F.when(F.col("_b.n") != F.col("_a.n"), F.col("_b.n") - F.col("_a.n"))
    between = F.col("_a.v") + (F.col("_b.v") - F.col("_a.v")) * F.coalesce(by_time, by_place)
    return r.withColumn("filled", F.coalesce(F.col(value), between, F.col("_a.v"), F.col("_b.v"), F.lit(0.0))).drop("_n", "_a", "_b")


def _km(lng1, lat1, lng2, lat2):
    a, b = np.radians(lat1), np.radians(lat2)
    h = np.sin((b - a) / 2) ** 2 + np.cos(a) * np.cos(b) * np.sin(np.radians(np.subtract(lng2, lng1)) / 2) ** 2
    return 2 * 6371.0 * np.arcsin(np.sqrt(np.minimum(1.0, h)))


def simplify_line(lng: np.ndarray, lat: np.ndarray, tolerance_m: float) -> np.ndarray:
    """Mark the points that keep a line within a tolerance (Douglas and Peucker), in a plane in metres at each chord."""
    keep = np.zeros(len(lng), dtype=bool)
    keep[[0, -1]] = True
    todo = [(0, len(lng) - 1)]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        kx = 111_320.0 * math.cos(math.radians((lat[a] + lat[b]) / 2))
        x, y = (lng[a + 1 : b] - lng[a]) * kx, (lat[a + 1 : b] - lat[a]) * 110_574.0
        dx, dy = (lng[b] - lng[a]) * kx, (lat[b] - lat[a]) * 110_574.0
        t = np.clip((x * dx + y * dy) / (dx * dx + dy * dy or 1.0), 0, 1)
        off = np.hypot(x - dx * t, y - dy * t)
        far = int(off.argmax())
        if off[far] > tolerance_m:
            keep[a + 1 + far] = True
            todo += [(a, a + 1 + far), (a + 1 + far, b)]
    return keep


def simplify(points: DataFrame, tolerance_m: float) -> DataFrame:
    """Simplify each line; ends always stay."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq")
        return pdf[simplify_line(pdf["lng"].to_numpy(float), pdf["lat"].to_numpy(float), tolerance_m)]

    return points.groupBy("line_id").applyInPandas(run, points.schema)


def thin_crowded(spots: DataFrame, group: Column, radius_km: float = 1.0, most: int = 2) -> DataFrame:
    """Keep spots by score so that no kept spot has `most` better kept ones within the radius in its group. spots: id, lng, lat, score."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["score", "id"], ascending=[False, True])
        lng, lat, kept = pdf["lng"].to_numpy(float), pdf["lat"].to_numpy(float), []
        for i in range(len(pdf)):
            if (_km(lng[i], lat[i], lng[kept], lat[kept]) <= radius_km).sum() < most:
                kept.append(i)
        return pdf.iloc[kept]

    return spots.withColumn("_g", group).groupBy("_g").applyInPandas(lambda pdf: run(pdf.drop(columns="_g")), spots.schema)


# State of a fused position: place (m), speed (m/s), time (s), covariance p00 p01 p11, seconds without a fix, last place.
STATE = ("s", "v", "t", "p00", "p01", "p11", "gap", "last_s")
STATE_SCHEMA = ", ".join(f"{n} double" for n in STATE)


def fuse(state: tuple | None, fix: dict[str, Any], v_cap: float, plan_v: float) -> tuple[tuple, str]:
    """Predict to a fix's time and update with its place unless a gate holds it back; return the new state and what was done.

    fix: t (s), z (m, may be NaN), accuracy (m), off (m). Gates: off the line; too far from the prediction (taken
    with ten times the variance); a speed below 0 or over 1.3 times the cap. Places never go back.
    """
    z, has = fix["z"], not math.isnan(fix["z"])
    if state is None:
        start = z if has else 0.0
        return (start, plan_v, fix["t"], 100.0, 0.0, 10.0, 0.0, start), "start"
    s, v, t, p00, p01, p11, gap, last = state
    dt = max(0.0, fix["t"] - t)
    q = 0.0225 * (1 if has else 4)
    s, v_new = s + v * dt, v + (0.05 if has else 0.15) * (plan_v - v) * dt
    p00, p01, p11 = p00 + 2 * dt * p01 + dt * dt * p11 + q * dt**4 / 4, p01 + dt * p11 + q * dt**3 / 2, p11 + q * dt * dt
    v, gap, did = v_new, 0.0 if has else gap + dt, "predicted"
    if has:
        r = max(fix["accuracy"], 15.0) ** 2 + 300.0**2
        if fix["off"] > min(max(3 * max(fix["accuracy"], 1.0) + 500, 800), 5000):
            did = "off_line"
        else:
            soft = abs(z - s) > 3 * math.sqrt(p00 + r)
            speed = (z - last) / dt if dt > 0 else 0.0
            if not soft and (speed < 0 or speed > 1.3 * v_cap):
                did = "too_fast"
            else:
                r *= 10 if soft else 1
                k0, k1 = p00 / (p00 + r), p01 / (p00 + r)
                gain = z - s
                s, v = max(s + k0 * gain, last), min(max(v + k1 * gain, 0.0), 1.3 * v_cap)
                p00, p01, p11 = (1 - k0) * p00, (1 - k0) * p01, p11 - k1 * p01
                last, did = s, "soft" if soft else "updated"
    return (s, v, fix["t"], p00, p01, p11, gap, last), did


FUSED_SCHEMA = "trip long, t double, s double, v double, gap double, did string"


def fuse_rows(trip: int, pdf: pd.DataFrame, state: tuple | None, v_cap: float, plan_v: float) -> tuple[pd.DataFrame, tuple | None]:
    out = []
    for fix in pdf.sort_values(["t", "z"]).to_dict("records"):
        state, did = fuse(state, fix, v_cap, plan_v)
        out.append((trip, fix["t"], state[0], state[1], state[6], did))
    return pd.DataFrame(out, columns=["trip", "t", "s", "v", "gap", "did"]), state


def fused(fixes: DataFrame, v_cap: float, plan_v: float) -> DataFrame:
    """Fuse all fixes of each trip in time order. fixes: trip, t, z, accuracy, off."""
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return fuse_rows(key[0], pdf, None, v_cap, plan_v)[0]

    return fixes.groupBy("trip").applyInPandas(run, FUSED_SCHEMA)


SAMPLE_SCHEMA = "trip long, type string, ts long, along_km double, ref string, dwell_min long"


class Sampler:
    """Key points of a track: start, check-ins at highlights, chapters, passes, stays. Its fields are its whole state."""

    def __init__(self, highlights: list[tuple[str, float]], chapters: list[tuple[str, float, float]], pass_m: float = 500, pass_s: float = 120, slow_kmh: float = 5, stay_ms: int = 300_000, reach_m: float = 100):
        self.highlights, self.chapters = highlights, chapters
        self.limits = (pass_m, pass_s, slow_kmh, stay_ms, reach_m)
        self.state: dict[str, Any] = {"pass": None, "slow_since": None, "chapter": -1, "seen": []}

    def feed(self, f: dict[str, Any]) -> list[tuple]:
        """Take a sample (ts, lng, lat, speed, along_km); return its key points in fixed order. Missing speed counts as moving."""
        pass_m, pass_s, slow_kmh, stay_ms, reach_m = self.limits
        s, out = self.state, []
        km = None if f["along_km"] is None or math.isnan(f["along_km"]) else f["along_km"]
        point = lambda kind, ref=None, dwell=None: out.append((kind, f["ts"], km, ref, dwell))
        if s["pass"] is None:
            point("start")
            s["pass"] = [f["lng"], f["lat"], f["ts"]]
        hit = next((h for h, at in self.highlights if km and h not in s["seen"] and abs(at - km) * 1000 <= reach_m), None)
        if hit:
            s["seen"].append(hit)
            point("checkin", hit)
        chapter = -1 if km is None or not self.chapters else next((i for i, (_, a, b) in enumerate(self.chapters) if a <= km < b), len(self.chapters) - 1)
        if chapter >= 0 and chapter != s["chapter"]:
            s["chapter"] = chapter
            point("chapter", self.chapters[chapter][0])
        lng, lat, since = s["pass"]
        if _km(lng, lat, f["lng"], f["lat"]) * 1000 >= pass_m and (f["ts"] - since) / 1000 >= pass_s:
            point("pass")
            s["pass"] = [f["lng"], f["lat"], f["ts"]]
        if f["speed"] is not None and f["speed"] < slow_kmh:
            s["slow_since"] = f["ts"] if s["slow_since"] is None else s["slow_since"]
            if f["ts"] - s["slow_since"] >= stay_ms:
                point("stay", None, math.floor((f["ts"] - s["slow_since"]) / 60000 + 0.5))
                s["slow_since"] = None
        else:
            s["slow_since"] = None
        return out


def key_points(samples: DataFrame, highlights: list[tuple[str, float]], chapters: list[tuple[str, float, float]]) -> DataFrame:
    """Sample each trip's track in time order, with an end at its last sample. samples: trip, ts (ms), lng, lat, speed, along_km."""
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        sampler, out = Sampler(highlights, chapters), []
        for f in pdf.sort_values(["ts", "along_km"]).to_dict("records"):
            out += sampler.feed(f)
        out.append(("end", int(pdf["ts"].max()), out[-1][2], None, None))
        return pd.DataFrame([(key[0], *p) for p in out], columns=["trip", "type", "ts", "along_km", "ref", "dwell_min"])

    return samples.groupBy("trip").applyInPandas(run, SAMPLE_SCHEMA)


def batches(rows: Iterator[pd.DataFrame]) -> pd.DataFrame:
    """Put a state call's batches together."""
    parts = list(rows)
    return pd.concat(parts) if parts else pd.DataFrame()
