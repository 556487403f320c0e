"""Column functions on timetables: train profiles, trapezoid speed curves, delays and arrival estimates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Fixed values, by train class: top speed km/h, acceleration and braking m/s2, delay growth min/h, base spread min, spread growth, recovery cap min.
PROFILES = {
    "G": (310.0, 0.30, 0.45, 0.4, 1.0, 0.35, 8.0), "D": (250.0, 0.35, 0.50, 0.6, 1.5, 0.45, 10.0), "C": (200.0, 0.45, 0.60, 0.8, 1.5, 0.5, 5.0), "Z": (160.0, 0.18, 0.25, 1.5, 2.5, 0.8, 5.0),
    "T": (140.0, 0.16, 0.22, 2.0, 3.0, 1.0, 5.0), "K": (120.0, 0.14, 0.20, 3.0, 3.5, 1.2, 3.0), "OTHER": (100.0, 0.12, 0.18, 4.0, 4.0, 1.4, 0.0),
}
FIELDS = ("v_cap", "a_acc", "a_dec", "mu", "sigma0", "gamma", "recover_cap")
TAU_H = 0.42


def profile(train_class: Column, single_line: Column | None = None, mountains: Column | None = None, night: Column | None = None, hub: Column | None = None, high_speed: Column | None = None) -> dict[str, Column]:
    """Return the profile columns of a class (v_cap in m/s), changed by the conditions that hold."""
    no = F.lit(False)
    c = F.when(F.coalesce(high_speed, no) & train_class.isin("Z", "T", "K"), "D").otherwise(train_class) if high_speed is not None else train_class
    out = {}
    for i, name in enumerate(FIELDS):
        value = F.lit(PROFILES["OTHER"][i])
        for key, row in PROFILES.items():
            value = F.when(c == key, F.lit(row[i])).otherwise(value)
        out[name] = value
    out["v_cap"] = out["v_cap"] / 3.6
    for name, when, factor in (("mu", single_line, 1.8), ("recover_cap", single_line, 0.4), ("sigma0", mountains, 1.5), ("mu", night, 1.3), ("v_cap", hub, 0.6)):
        if when is not None:
            out[name] = out[name] * F.when(when, F.lit(factor)).otherwise(1.0)
    return out


def trapezoid() -> list[dict[str, Column]]:
    """Steps of columns that solve a section from ds (m), dt (s), v_cap, a_acc and a_dec.

    Adds v, s_acc, s_dec, t_acc, t_dec, degraded, slack and total_s: the cruising speed is the lesser
    root of beta v^2 - dt v + ds, capped at v_cap; sections that cannot be run in time go at constant speed.
    """
    ds, dt, beta, disc, v0 = (F.col(c) for c in ("ds", "dt", "_beta", "_disc", "_v0"))
    void = (ds <= 0) | (dt <= 0)
    flat = void | (disc < 0)
    capped = v0 > F.col("v_cap")
    v1 = F.when(capped, F.col("v_cap")).otherwise(v0)
    triangle = ~flat & (v1 * v1 / 2 * (1 / F.col("a_acc") + 1 / F.col("a_dec")) > ds)
    v = F.when(void, 0.0).when(flat, ds / dt).when(triangle, F.sqrt(ds / beta)).otherwise(v1)
    part = lambda c: F.when(flat, 0.0).otherwise(c)
    slack = F.when(flat | ~capped, 0.0).otherwise(F.greatest(F.lit(0.0), dt - (ds / F.col("v_cap") + beta * F.col("v_cap"))))
    total = F.when(void, 0.0).when(flat, dt).otherwise(F.col("t_acc") + (ds - F.col("s_acc") - F.col("s_dec")) / F.col("v") + F.col("t_dec"))
    return [
        {"_beta": (1 / F.col("a_acc") + 1 / F.col("a_dec")) / 2},
        {"_disc": dt * dt - 4 * beta * ds},
        {"_v0": (dt - F.sqrt(F.greatest(disc, F.lit(0.0)))) / (2 * beta)},
        {"v": v, "degraded": flat, "slack": slack},
        {"s_acc": part(F.col("v") * F.col("v") / (2 * F.col("a_acc"))), "s_dec": part(F.col("v") * F.col("v") / (2 * F.col("a_dec"))), "t_acc": part(F.col("v") / F.col("a_acc")), "t_dec": part(F.col("v") / F.col("a_dec"))},
        {"total_s": total},
    ]


def tau(x: Column) -> Column:
    """Seconds from the start of a solved section to x metres into it."""
    ds = F.col("ds")
    run = F.when(x <= 0, 0.0).when(x >= ds, F.col("total_s")).when(x <= F.col("s_acc"), F.sqrt(2 * x / F.col("a_acc"))).when(x >= ds - F.col("s_dec"), F.col("total_s") - F.sqrt(2 * (ds - x) / F.col("a_dec")))
    run = run.otherwise(F.col("t_acc") + (x - F.col("s_acc")) / F.col("v"))
    return F.when(F.col("degraded"), F.when(F.col("v") > 0, x / F.col("v")).otherwise(0.0)).otherwise(run)


def tau_inverse(t: Column) -> Column:
    """Metres into a solved section after t seconds."""
    left = F.col("total_s") - t
    run = F.when(t <= 0, 0.0).when(left <= 0, F.col("ds")).when(t <= F.col("t_acc"), 0.5 * F.col("a_acc") * t * t).when(left <= F.col("t_dec"), F.col("ds") - 0.5 * F.col("a_dec") * left * left)
    run = run.otherwise(F.col("s_acc") + F.col("v") * (t - F.col("t_acc")))
    return F.when(F.col("degraded"), F.when(F.col("v") > 0, t * F.col("v")).otherwise(0.0)).otherwise(run)


def speed_at(x: Column) -> Column:
    run = F.when((x <= 0) | (x >= F.col("ds")), 0.0).when(x <= F.col("s_acc"), F.sqrt(2 * F.col("a_acc") * x)).when(x >= F.col("ds") - F.col("s_dec"), F.sqrt(2 * F.col("a_dec") * (F.col("ds") - x)))
    return F.when(F.col("degraded"), F.col("v")).otherwise(run.otherwise(F.col("v")))


def min_section_time(ds: Column, v_cap: Column, a_acc: Column, a_dec: Column) -> Column:
    beta = (1 / a_acc + 1 / a_dec) / 2
    return F.when(ds <= 0, 0.0).when(ds >= beta * v_cap * v_cap, ds / v_cap + beta * v_cap).otherwise(2 * F.sqrt(ds * beta))


def geo_sigma(source: Column, ds: Column) -> Column:
    """Error of a mileage in metres by the quality of its geometry."""
    return F.when(source.isin("precise", "corridor"), 150.0).when(source == "local", 300.0).when(source == "soft", 500.0).when(source == "station", 0.12 * ds).otherwise(300.0)


def eta_sigma(sigma0: Column, gamma: Column, plan_h: Column, geo: Column, v: Column, gap_s: Column) -> Column:
    """Half width of an arrival estimate in minutes: of the plan, of the geometry, and of time without position."""
    plan = sigma0 + gamma * F.sqrt(F.greatest(plan_h, F.lit(0.0)))
    place, gap = geo / F.greatest(v, F.lit(5.0)) / 60, gap_s / 60 * 0.15
    return F.sqrt(plan * plan + place * place + gap * gap)


def confidence(sigma: Column) -> Column:
    return F.when(sigma <= 3, "high").when(sigma <= 10, "mid").otherwise("low")


def speed_band(kmh: Column) -> Column:
    return F.when(kmh > 80, "fast").when(kmh < 40, "slow").otherwise("cruise")


def lookahead_km(kmh: Column) -> Column:
    return F.least(F.lit(15.0), F.greatest(F.lit(3.0), kmh * 0.05))


def cruise_altitude_m(km: Column) -> Column:
    return F.when(km < 800, 8600).when(km < 1800, 9800).when(km < 3500, 10700).otherwise(11300)


def flight_minutes(km: Column) -> Column:
    return F.when(km <= 0, 0).otherwise(F.floor(km / 820 * 60 + 25 + 0.5)).cast("long")


def blended_progress(plan: Column, fix: Column, age_s: Column, accuracy_m: Column, off_km: Column) -> Column:
    """Progress of a trip: the plan's alone where a fix is missing, old, rough or off the line, else 65 % the fix's."""
    usable = fix.isNotNull() & (F.coalesce(age_s, F.lit(1e9)) <= 120) & (F.coalesce(accuracy_m, F.lit(1e9)) <= 300)
    gate_km = F.least(F.greatest(3 * F.greatest(accuracy_m, F.lit(1.0)) + 500, F.lit(800.0)), F.lit(5000.0)) / 1000
    return F.when(usable & (off_km <= gate_km), fix * 0.65 + plan * 0.35).otherwise(plan)


def planned_km(ride: str, clock: Column, timetable: DataFrame, rides: DataFrame) -> DataFrame:
    """Place of each ride by its timetable, in a straight line between calls: rides has ride and clock, timetable ride, at and km, in ascending order of at.

    Before the first call it is at the first, after the last at the last. A window over both tables' rows finds the calls around each clock.
    """
    call = timetable.select(ride, F.col("at").cast("double").alias("_t"), F.struct(F.col("at").cast("double").alias("t"), "km").alias("_c"), F.lit(None).cast("long").alias("_id"), F.lit(0).alias("_kind"))
    ask = rides.select(ride, clock.cast("double").alias("_t"), F.lit(None).cast("struct<t:double,km:double>").alias("_c"), F.col("id").cast("long").alias("_id"), F.lit(1).alias("_kind"))
    rows = call.unionByName(ask)
    w = Window.partitionBy(ride).orderBy("_t", "_kind")
    rows = rows.withColumns({"_a": F.last("_c", ignorenulls=True).over(w), "_b": F.first("_c", ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))}).where("_kind = 1")
    span = F.col("_b.t") - F.col("_a.t")
    km = F.when(F.col("_a").isNull(), F.col("_b.km")).when(F.col("_b").isNull() | (span <= 0), F.col("_a.km")).otherwise(F.col("_a.km") + (F.col("_b.km") - F.col("_a.km")) * (F.col("_t") - F.col("_a.t")) / span)
    return rows.select(F.col("_id").alias("id"), km.alias("km"))
