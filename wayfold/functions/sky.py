"""Column functions on sun, moon and sky: positions, phases and viewing scores. Times are epoch milliseconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Noon of 2000-01-01 and the new moon of 2000-01-06 in epoch ms, a day in ms, the synodic month in days.
J2000_MS, NEW_MOON_MS, DAY_MS, SYNODIC_DAYS = 946728000000.0, 947182440000.0, 86400000.0, 29.530588853
#: Yearly meteor showers: name, month, day, hourly rate at the zenith.
SHOWERS = (("Quadrantids", 1, 4, 110), ("Lyrids", 4, 22, 18), ("Eta Aquariids", 5, 6, 50), ("Perseids", 8, 13, 100), ("Orionids", 10, 21, 20), ("Leonids", 11, 17, 15), ("Geminids", 12, 14, 150), ("Ursids", 12, 22, 10))
#: Least light score of each class of night sky, 9 the brightest.
BORTLE = ((3.2, 9), (2.2, 8), (1.4, 7), (0.85, 6), (0.45, 5), (0.22, 4), (0.09, 3), (0.03, 2))


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def _turn(x: Column) -> Column:
    return (x % 360 + 360) % 360


def _sin(x: Column) -> Column:
    return F.sin(F.radians(x))


def _cos(x: Column) -> Column:
    return F.cos(F.radians(x))


def _days(ms: Column) -> Column:
    return (ms.cast("double") - J2000_MS) / DAY_MS


def sun_equatorial(ms: Column) -> tuple[Column, Column]:
    """Right ascension and declination of the sun in degrees, by the low-precision almanac formulas."""
    d = _days(ms)
    anomaly = _turn(357.528 + 0.9856003 * d)
    lon = _turn(280.46 + 0.9856474 * d) + 1.915 * _sin(anomaly) + 0.02 * _sin(2 * anomaly)
    tilt = 23.439 - 0.0000004 * d
    return F.degrees(F.atan2(_cos(tilt) * _sin(lon), _cos(lon))), F.degrees(F.asin(_sin(tilt) * _sin(lon)))


def moon_equatorial(ms: Column) -> tuple[Column, Column]:
    """Right ascension and declination of the moon in degrees, main terms only."""
    d = _days(ms)
    sun, moon, gap, node = _turn(357.529 + 0.98560028 * d), _turn(134.963 + 13.064993 * d), _turn(297.850 + 12.190749 * d), _turn(93.272 + 13.229350 * d)
    terms = ((6.289, moon), (1.274, 2 * gap - moon), (0.658, 2 * gap), (0.214, 2 * moon), (-0.186, sun), (-0.114, 2 * node))
    lon = sum((k * _sin(x) for k, x in terms), _turn(218.316 + 13.176396 * d))
    lat = sum((k * _sin(x) for k, x in ((5.128, node), (0.281, moon + node), (0.278, moon - node), (0.173, 2 * gap - node))), F.lit(0.0))
    tilt = 23.439 - 0.0000004 * d
    ra = F.atan2(_sin(lon) * _cos(tilt) - F.tan(F.radians(lat)) * _sin(tilt), _cos(lon))
    return _turn(F.degrees(ra)), F.degrees(F.asin(_sin(lat) * _cos(tilt) + _cos(lat) * _sin(tilt) * _sin(lon)))


def altitude(lng: Column, lat: Column, ms: Column, body: tuple[Column, Column]) -> Column:
    """Altitude above the horizon in degrees of a body given by right ascension and declination."""
    ra, dec = body
    hour = 280.46061837 + 360.98564736629 * _days(ms) + lng - ra
    return F.degrees(F.asin(clamp(_sin(dec) * _sin(lat) + _cos(dec) * _cos(lat) * _cos(hour), -1.0, 1.0)))


def moon_age(ms: Column) -> Column:
    days = (ms.cast("double") - NEW_MOON_MS) / DAY_MS
    return (days % SYNODIC_DAYS + SYNODIC_DAYS) % SYNODIC_DAYS


def moon_light(ms: Column) -> Column:
    """Share of the moon's face that is lit."""
    return (1 - F.cos(2 * F.pi() * moon_age(ms) / SYNODIC_DAYS)) / 2


def moon_phase(ms: Column) -> Column:
    """Number of the eighth of the month: 0 new, 2 first quarter, 4 full, 6 last quarter."""
    return (F.floor(moon_age(ms) / SYNODIC_DAYS * 8 + 0.5) % 8).cast("int")


def day_of_year(date: Column) -> Column:
    return F.dayofyear(date)


def sun_hours(lng: Column, lat: Column, day: Column) -> tuple[Column, Column]:
    """Hours (UTC, may leave 0 to 24) of sunrise and sunset on a day of the year; equal in polar night, a day apart under a midnight sun."""
    declination = 23.45 * F.sin(F.radians(360.0 * (284 + day) / 365))
    c = -F.tan(F.radians(lat)) * F.tan(F.radians(declination))
    half = F.degrees(F.acos(clamp(c, -1.0, 1.0))) / 15
    noon = 12 - lng / 15
    return F.when(c > 1, noon).otherwise(noon - half), F.when(c > 1, noon).otherwise(noon + half)


def _index(score: Column) -> Column:
    return F.floor(clamp(score, 0.0, 100.0) + 0.5).cast("int")


def band(score: Column) -> Column:
    return F.when(score >= 75, "excellent").when(score >= 55, "good").when(score >= 35, "fair").otherwise("poor")


def glow_index(low: Column, mid: Column, high: Column, total: Column, visibility: Column, humidity: Column, rain: Column) -> Column:
    """Score of a red sky: some middle and high cloud, little low cloud, clear and dry air. Nulls take usual values."""
    m, h = F.coalesce(mid, F.lit(0.0)), F.coalesce(high, F.lit(0.0))
    screen = clamp((m + h) / 2 + F.greatest(m, h) / 2)
    cloud = F.when(screen < 0.15, 25.0).when(screen <= 0.9, 60 + 40 * ((screen - 0.15) / 0.75)).otherwise(35.0)
    score = cloud - clamp((F.coalesce(low, total, F.lit(0.5)) - 0.55) / 0.45) * 55 + clamp((F.coalesce(visibility, F.lit(15.0)) - 2) / 18) * 25
    return _index(score - clamp((F.coalesce(humidity, F.lit(0.6)) - 0.75) / 0.25) * 18 - clamp(F.coalesce(rain, F.lit(0.0))) * 45)


def star_index(total: Column, visibility: Column, sun_alt: Column, moon_share: Column, moon_alt: Column, bortle: Column) -> Column:
    moon = F.when(moon_alt > 0, clamp(moon_share) * clamp(moon_alt / 45) * 32).otherwise(0.0)
    score = 28 + clamp((-sun_alt - 12) / 6) * 30 + clamp((F.coalesce(visibility, F.lit(10.0)) - 4) / 16) * 12
    return _index(score - moon - clamp((bortle - 1) / 8.0) * 30 - clamp(total) * 35)


def rainbow_index(total: Column, rain: Column, sun_alt: Column) -> Column:
    p = clamp(F.coalesce(rain, F.lit(0.0)))
    sun = F.when(sun_alt < 42, clamp((40 - sun_alt) / 40) * 35).otherwise(0.0)
    wet = F.when((p >= 0.2) & (p <= 0.85), 45 * clamp(p / 0.6)).when(p > 0.85, 10.0).otherwise(0.0)
    return F.when(sun_alt <= 1, 0).otherwise(_index(sun + wet - clamp((clamp(F.coalesce(total, F.lit(0.5))) - 0.85) / 0.15) * 25))


def moon_index(total: Column, moon_share: Column, moon_alt: Column) -> Column:
    return _index(20 + clamp(moon_share) * 45 + clamp(moon_alt / 50) * 35 - clamp(F.coalesce(total, F.lit(0.5))) * 40)


def cloud_sea_index(low: Column, humidity: Column, wind: Column, freezing: Column) -> Column:
    score = clamp(F.coalesce(low, F.lit(0.5))) * 40 + clamp((clamp(F.coalesce(humidity, F.lit(0.6))) - 0.6) / 0.4) * 30 + (1 - clamp(F.coalesce(wind, F.lit(3.0)) / 8)) * 15
    return _index(score + F.when(freezing > 800, 10.0).otherwise(5.0))


def rime_index(temp: Column, humidity: Column, wind: Column, rain: Column) -> Column:
    t = F.coalesce(temp, F.lit(10.0))
    score = clamp((3 - t) / 8) * 45 + clamp((clamp(F.coalesce(humidity, F.lit(0.6))) - 0.75) / 0.25) * 30 + clamp((F.coalesce(wind, F.lit(2.0)) - 1) / 5) * F.when(t <= 2, 12.0).otherwise(0.0)
    return _index(score - clamp(F.coalesce(rain, F.lit(0.0))) * 25)


def view_hint(poor_weather: Column, visibility: Column, cloud: Column, rain: Column, distant: Column) -> Column:
    """poor, fair or good view; distant sights ask for more."""
    no = lambda c: F.coalesce(c, F.lit(False))
    return (
        F.when(no(poor_weather) | no(visibility < 5) | no(rain >= 0.6), "poor").when(no(visibility < 10), F.when(distant, "poor").otherwise("fair")).when(no(rain >= 0.35), "fair")
        .when(distant & (no(cloud >= 0.7) | no(visibility < 15)), "fair").otherwise("good")
    )


def bortle_class(light: Column) -> Column:
    out = F.when(light >= BORTLE[0][0], BORTLE[0][1])
    for least, name in BORTLE[1:]:
        out = out.when(light >= least, name)
    return out.otherwise(1)
