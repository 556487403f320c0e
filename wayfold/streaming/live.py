"""Structured Streaming twins of the per-trip operators, with keyed state, and windowed counts with a watermark."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from wayfold.operators.trips import FUSED_SCHEMA, SAMPLE_SCHEMA, STATE_SCHEMA, Sampler, batches, fuse_rows

#: Samples older than so much behind the newest are dropped, as a position that old no longer counts.
STALE = "2 minutes"


def fuse_stream(fixes: DataFrame, v_cap: float, plan_v: float) -> DataFrame:
    """Fuse a stream of fixes (trip, t, z, accuracy, off) with a trip's filter as its state.

    Fixes of one micro-batch are taken in time order; one that is older than the state counts with no time passed.
    """
    def run(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out, new = fuse_rows(key[0], batches(rows), tuple(state.get) if state.exists else None, v_cap, plan_v)
        state.update(new)
        yield out

    return fixes.groupBy("trip").applyInPandasWithState(run, FUSED_SCHEMA, STATE_SCHEMA, "append", GroupStateTimeout.NoTimeout)


def key_point_stream(samples: DataFrame, highlights: list[tuple[str, float]], chapters: list[tuple[str, float, float]], idle_ms: int | None = None) -> DataFrame:
    """Sample a stream of positions (trip, ts, lng, lat, speed, along_km); a trip ends when idle for idle_ms of processing time."""
    def run(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        sampler = Sampler(highlights, chapters)
        last = None
        if state.exists:
            sampler.state, last = json.loads(state.get[0])
        out = []
        if state.hasTimedOut:
            out.append(("end", last[0], last[1], None, None))
            state.remove()
        else:
            pdf = batches(rows).sort_values(["ts", "along_km"])
            for f in pdf.to_dict("records"):
                points = sampler.feed(f)
                out += points
                last = [f["ts"], points[-1][2] if points else last[1]]
            state.update((json.dumps([sampler.state, last]),))
            if idle_ms:
                state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame([(key[0], *p) for p in out], columns=["trip", "type", "ts", "along_km", "ref", "dwell_min"])

    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout
    return samples.groupBy("trip").applyInPandasWithState(run, SAMPLE_SCHEMA, "state string", "append", timeout)


def counts_per_minute(events: DataFrame, time: str, key: str, minutes: int = 1, late: str = STALE) -> DataFrame:
    """Count rows per key and tumbling window; on a stream, windows close once the watermark has passed them."""
    return events.withWatermark(time, late).groupBy(F.window(time, f"{minutes} minutes").alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), key, "n")
