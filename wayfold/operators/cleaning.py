"""Cleaning of lines: flying stops, spacing, spikes, protrusions, retraces at stations, revisits and loops.

Lines are rows (line_id, seq, lng, lat). Rules that look at neighbours only are window functions; greedy
ones carry what they kept over sorted partitions; revisits meet in cells.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wayfold.functions.geo import EARTH_KM, KM_PER_LAT, KM_PER_LNG, cell, haversine_km, in_box
from wayfold.operators.lines import with_cum_km
from wayfold.operators.matching import greedy_keep
from wayfold.sources.scratch import stored

#: A stop is taken for misplaced where the way over it is so many times the direct one, that is at least so long, and the detour is.
ZIGZAG_TIMES, ZIGZAG_KM, ZIGZAG_DETOUR_KM = 1.75, 40.0, 50.0
#: Least spacing of points, degrees and km of spikes, and how much longer than its sides a spike's base may be.
SPACING_KM, SPIKE_DEG, SPIKE_KM, SPIKE_BASE = 0.45, 145.0, 0.08, 1.08
#: Fixed value: sides shorter than this make no turn.
SHORT_KM = 0.25
#: Km of a protrusion to the side and of its detour, and the neighbours that it is looked for with.
SIDE_KM, DETOUR_KM, REACH = 2.0, 2.5, (1, 2, 3, 4)
#: A retrace turns by so many degrees, jumps so far within so many points, and keeps so many points so near.
RETRACE_DEG, RETRACE_JUMP_KM, RETRACE_POINTS, RETRACE_NEAR_KM, RETRACE_LEAST = 160.0, 3.5, 25, 8.0, 2
#: Km along the line from which on a point close to an earlier one is a revisit, and how close.
REVISIT_KM, REVISIT_NEAR_KM = 25.0, 1.5
#: Km of a loop that is trimmed, metres between its middle and the way there, digits by which places are the same, degrees by which points are.
LOOP_KM, LOOP_NEAR_M, LOOP_DIGITS, SAME_DEG = 15.0, 500.0, 4, 1e-6


def scrub_zigzags(stops: DataFrame, plausible: Column | None = None) -> DataFrame:
    """Take the coordinates of stops that the way makes a zigzag over: lng and lat become null, all other columns stay.

    stops: trip, seq, lng, lat. A stop is judged with the two beside it, from the first on, and not if one of them
    lacks a plausible place or just lost it; so of a run of such stops every other one is scrubbed, and a second pass would find nothing more.
    """
    order = Window.partitionBy("trip").orderBy("seq")
    sound = in_box(F.col("lng"), F.col("lat")) if plausible is None else plausible
    s = stops.withColumn("_ok", F.coalesce(sound, F.lit(False)))
    near = {f"_{n}{c}": f(c).over(order) for n, f in (("a", F.lag), ("c", F.lead)) for c in ("lng", "lat", "_ok")}
    s = s.withColumns(near)
    direct = haversine_km(F.col("_alng"), F.col("_alat"), F.col("_clng"), F.col("_clat"))
    via = haversine_km(F.col("_alng"), F.col("_alat"), F.col("lng"), F.col("lat")) + haversine_km(F.col("lng"), F.col("lat"), F.col("_clng"), F.col("_clat"))
    s = s.withColumns({"_direct": direct, "_via": via})
    bad = F.col("_ok") & F.col("_a_ok") & F.col("_c_ok") & (F.col("_direct") > ZIGZAG_KM) & (F.col("_via") > F.col("_direct") * ZIGZAG_TIMES) & (F.col("_via") - F.col("_direct") > ZIGZAG_DETOUR_KM)
    s = s.withColumn("_bad", F.coalesce(bad, F.lit(False)))
    s = s.withColumn("_nr", F.row_number().over(order))
    # Places since the last stop that was in order: odd ones of a run go.
    last_good = F.max(F.when(~F.col("_bad"), F.col("_nr"))).over(order.rowsBetween(Window.unboundedPreceding, 0))
    gone = F.col("_bad") & ((F.col("_nr") - F.coalesce(last_good, F.lit(0))) % 2 == 1)
    s = s.withColumn("_gone", gone)
    keep = [F.when(~F.col("_gone"), F.col(c)).alias(c) if c in ("lng", "lat") else F.col(c) for c in stops.columns]
    return s.select(*keep)


def _km(lng1: float, lat1: float, lng2: float, lat2: float) -> float:
    p, q = math.radians(lat1), math.radians(lat2)
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(lng2 - lng1) / 2) ** 2
    return 2 * EARTH_KM * math.asin(math.sqrt(min(1.0, h)))


def _in_order(points: DataFrame) -> DataFrame:
    """Points that have all of id, place in line and coordinates, a line's together and in order."""
    parts = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    p = points.select("line_id", "seq", F.col("lng").cast("double").alias("lng"), F.col("lat").cast("double").alias("lat")).dropna()
    return p.repartition(parts, "line_id").sortWithinPartitions("line_id", "seq")


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def spaced(points: DataFrame, least_km: float = SPACING_KM) -> DataFrame:
    """Keep points at least so far from the last one kept; a line's last point stays unless it lies where the last kept one does.

    A task holds one point of the line it reads, not the line.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = last = None  # the last point kept, and the last one read unless it was kept: line_id, seq, lng, lat

        def close() -> list[tuple]:
            return [last] if last and max(abs(last[2] - kept[2]), abs(last[3] - kept[3])) > 0.0001 else []

        for batch in batches:
            out: list[tuple] = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if kept is None or row[0] != kept[0]:
                    out += close()
                    kept, last = row, None
                    out.append(row)
                elif _km(kept[2], kept[3], row[2], row[3]) >= least_km:
                    kept, last = row, None
                    out.append(row)
                else:
                    last = row
            yield _rows(out, batch.schema)
            schema = batch.schema
        if kept:
            yield _rows(close(), schema)

    p = _in_order(points)
    return p.mapInArrow(run, p.schema)


def _line_by_line(points: DataFrame, choose: Callable[[np.ndarray, np.ndarray], list[int]]) -> DataFrame:
    """Keep the points of each line that `choose` returns the places of. A task holds one line at a time."""
    p = _in_order(points)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                line = pa.Table.from_batches(held).combine_chunks()
                keep = choose(line.column("lng").to_numpy(), line.column("lat").to_numpy())
                yield from line.take(pa.array(keep, pa.int64())).to_batches()
                held.clear()

        key = object()
        for batch in batches:
            ids = batch.column(0).to_pylist()
            start = 0
            for i in range(1, len(ids) + 1):
                if i == len(ids) or ids[i] != ids[start]:
                    if ids[start] != key:
                        yield from flush()
                        key = ids[start]
                    held.append(batch.slice(start, i - start))
                    start = i
        yield from flush()

    return p.mapInArrow(run, p.schema)


def _turn(ax: float, ay: float, bx: float, by: float, cx: float, cy: float) -> float:
    """Degrees by which the way a to c turns at b, in the plane of degrees; 0 where a side is too short to tell."""
    if _km(ax, ay, bx, by) < SHORT_KM or _km(bx, by, cx, cy) < SHORT_KM:
        return 0.0
    turn = abs(math.degrees(math.atan2(cy - by, cx - bx) - math.atan2(by - ay, bx - ax)))
    return 360 - turn if turn > 180 else turn


def spike_free(lng: np.ndarray, lat: np.ndarray) -> list[int]:
    """Places left after removing spikes, the first one first, until there is none.

    Removing a point changes only what its neighbours see, so it is enough to look back over the points kept.
    """
    kept: list[int] = []
    for i in range(len(lng)):
        while len(kept) > 1:
            a, b = kept[-2], kept[-1]
            ab, bc, ac = _km(lng[a], lat[a], lng[b], lat[b]), _km(lng[b], lat[b], lng[i], lat[i]), _km(lng[a], lat[a], lng[i], lat[i])
            if ab < SPIKE_KM or bc < SPIKE_KM or ac >= max(ab, bc) * SPIKE_BASE or _turn(lng[a], lat[a], lng[b], lat[b], lng[i], lat[i]) < SPIKE_DEG:
                break
            kept.pop()
        kept.append(i)
    return kept


def protrusion_free(lng: np.ndarray, lat: np.ndarray) -> list[int]:
    """Places left after removing points that stand far out to the side of their neighbours, the first one first, until there is none."""
    kept, i = list(range(len(lng))), 2
    while i < len(kept) - 2:
        for w in REACH:
            if i - w < 0 or i + w >= len(kept):
                continue
            a, b, c = kept[i - w], kept[i], kept[i + w]
            ab, bc, ac = _km(lng[a], lat[a], lng[b], lat[b]), _km(lng[b], lat[b], lng[c], lat[c]), _km(lng[a], lat[a], lng[c], lat[c]) or 1e-6
            s = (ab + bc + ac) / 2
            if 2 * math.sqrt(max(0.0, s * (s - ab) * (s - bc) * (s - ac))) / ac >= SIDE_KM and ab + bc - ac >= DETOUR_KM:
                del kept[i]
                i = max(2, i - max(REACH)) - 1  # what lies before saw other neighbours
                break
        i += 1
    return kept


def retrace_free(lng: np.ndarray, lat: np.ndarray) -> list[int]:
    """Places left after removing what a line goes back from a station before it jumps on, the first one first, until there is none."""
    kept, i = list(range(len(lng))), 2
    while i < len(kept) - 3:
        a, b, c = kept[i - 1 : i + 2]
        if _turn(lng[a], lat[a], lng[b], lat[b], lng[c], lat[c]) >= RETRACE_DEG:
            jump = next((j for j in range(i + 3, min(len(kept) - 1, i + RETRACE_POINTS) + 1) if _km(lng[kept[j - 1]], lat[kept[j - 1]], lng[kept[j]], lat[kept[j]]) > RETRACE_JUMP_KM), None)
            if jump and sum(_km(lng[b], lat[b], lng[k], lat[k]) < RETRACE_NEAR_KM for k in kept[i + 1 : jump]) >= RETRACE_LEAST:
                del kept[i + 1 : jump]
                i = max(2, i - RETRACE_POINTS) - 1
        i += 1
    return kept


def loop_free(lng: np.ndarray, lat: np.ndarray) -> list[int]:
    """Places left after trimming loops that go out and back the same way; rings whose middle lies apart from the way there stay.

    A place met again (4 decimals) closes a loop. Points where the last kept one is are passed over.
    """
    cum = np.r_[0.0, np.cumsum([_km(lng[i - 1], lat[i - 1], lng[i], lat[i]) for i in range(1, len(lng))])]
    seen: dict[tuple, int] = {}
    kept: list[int] = []
    for i in range(len(lng)):
        key = (f"{lng[i]:.{LOOP_DIGITS}f}", f"{lat[i]:.{LOOP_DIGITS}f}")
        at = seen.get(key)
        if at is not None and at < len(kept) - 1 and cum[kept[-1]] - cum[kept[at]] >= LOOP_KM:
            middle = kept[(at + len(kept) - 1) // 2]
            there = np.array(kept[: at + 1])
            # Only points in the middle's latitude band can be near it.
            close = there[np.abs(lat[there] - lat[middle]) * KM_PER_LAT * 1000 < LOOP_NEAR_M * 1.01]
            if any(_km(lng[t], lat[t], lng[middle], lat[middle]) * 1000 < LOOP_NEAR_M for t in close.tolist()):
                del kept[at + 1 :]
        seen[key] = len(kept)
        if kept and abs(lng[kept[-1]] - lng[i]) < SAME_DEG and abs(lat[kept[-1]] - lat[i]) < SAME_DEG:
            continue
        kept.append(i)
    return kept


def without_spikes(points: DataFrame) -> DataFrame:
    return _line_by_line(points, spike_free)


def without_protrusions(points: DataFrame) -> DataFrame:
    return _line_by_line(points, protrusion_free)


def without_retraces(points: DataFrame) -> DataFrame:
    return _line_by_line(points, retrace_free)


def without_loops(points: DataFrame) -> DataFrame:
    return _line_by_line(points, loop_free)


def without_revisits(points: DataFrame, along_km: float = REVISIT_KM, near_km: float = REVISIT_NEAR_KM) -> DataFrame:
    """Drop points that come back close to a kept point from which the line has gone far; the first and last point stay.

    Points of a line meet in cells as wide as the distance; who is dropped is settled in rounds, so no line is
    one task's. Adds cum_km.
    """
    p = with_cum_km(points.dropna(subset=["line_id", "seq", "lng", "lat"]))
    p = p.withColumns({"_id": F.xxhash64("line_id", "seq"), "_last": F.max("seq").over(Window.partitionBy("line_id")) == F.col("seq")})
    p = stored(p, "line")
    size = near_km / KM_PER_LAT
    pad = F.lit(near_km) / (KM_PER_LNG * 0.99 * F.cos(F.radians(F.least(F.abs("lat") + 2 * size, F.lit(88.0)))))
    around = lambda c, d: F.explode(F.sequence(cell(F.col(c) - d, -180.0, size), cell(F.col(c) + d, -180.0, size)))
    own = p.where("NOT _last").select("line_id", F.col("_id").alias("a"), F.col("cum_km").alias("a_km"), "lng", "lat").withColumn("x", around("lng", pad)).withColumn("y", around("lat", F.lit(size)))
    other = p.where("NOT _last").select("line_id", F.col("_id").alias("b"), F.col("cum_km").alias("b_km"), F.col("lng").alias("o_lng"), F.col("lat").alias("o_lat"), cell(F.col("lng"), -180.0, size).alias("x"), cell(F.col("lat"), -180.0, size).alias("y"))
    met = own.join(other, ["line_id", "x", "y"]).where((F.col("b_km") - F.col("a_km") >= along_km) & (haversine_km(F.col("lng"), F.col("lat"), F.col("o_lng"), F.col("o_lat")) < near_km))
    met = stored(met.select("a", "b"), "revisits")
    kept = greedy_keep(p.select(F.col("_id").alias("id"), F.col("cum_km").alias("rank")), met).where("kept_by IS NULL").select(F.col("id").alias("_id"))
    return p.join(kept, "_id", "left_semi").drop("_id", "_last")
