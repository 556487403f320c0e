"""Column functions on coordinates in degrees and distances in kilometres."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Earth radius; kilometres per degree of latitude and of longitude at the equator; side and buffer limits.
EARTH_KM, KM_PER_LAT, KM_PER_LNG = 6371.0, 110.574, 111.32
BUFFER_KM = {"roadside": 0.3, "detour5": 3.0, "detour20": 12.0, "distant": 35.0}
BOTH_SIDES_KM, OUTSIDE_KM = 0.08, 1.0
LAND_BOX = (73.5, 17.5, 134.77, 53.56)


def js_round(x: Column, digits: int = 0) -> Column:
    """Round halves up towards plus infinity."""
    scale = float(10**digits)
    return F.floor(x * scale + 0.5) / scale


def haversine_km(lng1: Column, lat1: Column, lng2: Column, lat2: Column, radius: float = EARTH_KM) -> Column:
    """Great-circle distance; null where a coordinate is null."""
    s = lambda a, b: F.pow(F.sin(F.radians(b - a) / 2), 2)
    h = s(lat1, lat2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * s(lng1, lng2)
    return 2 * radius * F.asin(F.sqrt(F.when(h > 1, 1.0).otherwise(h)))


def bearing_deg(lng1: Column, lat1: Column, lng2: Column, lat2: Column) -> Column:
    """Initial bearing, 0 to 360, clockwise from north."""
    a, b, d = F.radians(lat1), F.radians(lat2), F.radians(lng2 - lng1)
    deg = F.degrees(F.atan2(F.sin(d) * F.cos(b), F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(d)))
    return (deg + 360) % 360


def cell(x: Column, origin: float, size: float) -> Column:
    return F.floor((x - origin) / size).cast("long")


def in_box(lng: Column, lat: Column, box: tuple[float, float, float, float] = LAND_BOX) -> Column:
    """Inside a box, edges included; false for null and NaN."""
    inside = lng.between(box[0], box[2]) & lat.between(box[1], box[3]) & ~F.isnan(lng) & ~F.isnan(lat)
    return F.coalesce(inside, F.lit(False))


def detour_km(dist: Column) -> Column:
    """Kilometres of detour: none at the roadside, else there and back, down to half kilometres."""
    return F.when(dist <= 0.15, 0.0).otherwise(F.greatest(F.lit(0.5), F.floor((dist * 2 - 0.3) / 0.5) * 0.5))


def along_class(dist: Column) -> Column:
    return F.when(dist <= 1, "pass").when(dist <= 12, "detour").otherwise("spur")


def buffer_km(visibility: Column, cap: float = 35.0) -> Column:
    """Search radius of a point by its visibility; unknown or null counts as detour20."""
    km = F.lit(BUFFER_KM["detour20"])
    for name, value in BUFFER_KM.items():
        km = F.when(visibility == name, F.lit(value)).otherwise(km)
    return F.least(km, F.lit(cap))


def category_matches(category: Column, prefixes: list[str]) -> Column:
    """Equal to a prefix or below it in a dotted name; a null category is `other`."""
    c = F.coalesce(category, F.lit("other"))
    hit = F.lit(False)
    for p in prefixes:
        hit = hit | (c == p) | c.startswith(p + ".")
    return hit


def direction(heading: Column, tangent: Column) -> Column:
    """forward, backward or unknown, by the angle between a heading and a line's tangent."""
    diff = ((heading - tangent) % 360 + 360) % 360
    diff = F.when(diff > 180, 360 - diff).otherwise(diff)
    return F.when(heading.isNull() | F.isnan(heading), "unknown").when(diff < 90, "forward").otherwise("backward")


def flip_side(side: Column, backward: Column) -> Column:
    return F.when(backward & (side == "left"), "right").when(backward & (side == "right"), "left").otherwise(side)


def _shift(lng: Column, lat: Column, lat_y_sign: int) -> tuple[Column, Column]:
    """Offsets in degrees of the published regional datum transform; lat_y_sign chooses between two forms in use."""
    import math

    x, y, pi = lng - 105.0, lat - 35.0, math.pi
    wave = lambda v, amp, parts: sum((F.sin(v / d * pi) * k for d, k in parts), F.lit(0.0)) * (amp * 2.0 / 3.0)
    common = (F.sin(6.0 * x * pi) * 20.0 + F.sin(2.0 * x * pi) * 20.0) * 2.0 / 3.0
    root = F.sqrt(F.abs(x))
    d_lat = -100.0 + 2.0 * x + lat_y_sign * 3.0 * y + 0.2 * y * y + 0.1 * x * y + 0.2 * root + common
    d_lat = d_lat + wave(y, 1.0, ((1.0, 20.0), (3.0, 40.0))) + wave(y, 1.0, ((12.0, 160.0), (30.0, 320.0)))
    d_lng = 300.0 + x + 2.0 * y + 0.1 * x * x + 0.1 * x * y + 0.1 * root + common
    d_lng = d_lng + wave(x, 1.0, ((1.0, 20.0), (3.0, 40.0))) + wave(x, 1.0, ((12.0, 150.0), (30.0, 300.0)))
    a, ee = 6378245.0, 0.00669342162296594323
    magic = 1 - ee * F.pow(F.sin(F.radians(lat)), 2)
    d_lat = d_lat * 180.0 / ((a * (1 - ee)) / (magic * F.sqrt(magic)) * pi)
    d_lng = d_lng * 180.0 / (a / F.sqrt(magic) * F.cos(F.radians(lat)) * pi)
    return d_lng, d_lat


def wgs84_to_gcj02(lng: Column, lat: Column, lat_y_sign: int = 1) -> tuple[Column, Column]:
    d_lng, d_lat = _shift(lng, lat, lat_y_sign)
    return lng + d_lng, lat + d_lat


def gcj02_to_wgs84(lng: Column, lat: Column, lat_y_sign: int = 1) -> tuple[Column, Column]:
    """Inverse of the shift, by one step of refinement."""
    g_lng, g_lat = wgs84_to_gcj02(lng, lat, lat_y_sign)
    w_lng, w_lat = lng * 2 - g_lng, lat * 2 - g_lat
    g_lng, g_lat = wgs84_to_gcj02(w_lng, w_lat, lat_y_sign)
    return w_lng + lng - g_lng, w_lat + lat - g_lat


def rail_side(dist: Column, cross: Column, outside: Column, span_from: Column, span_to: Column) -> Column:
    """Side of a rail line a sight is on: unknown beyond the ends, both within 0.3 km or where it spans over 10 km of line."""
    wide = F.coalesce(F.abs(span_to - span_from) > 10, F.lit(False))
    return F.when(outside, "unknown").when((js_round(dist, 2) <= 0.3) | wide, "both").when(cross > 0, "left").otherwise("right")


def in_approach(along: Column, span_to: Column, here: Column, lead: float = 5.0, trail: float = 2.0) -> Column:
    """Tell whether a place on the line is inside a sight's notice window."""
    return here.between(along - lead, F.coalesce(span_to, along) + trail)


def weather_cell(x: Column, size: float) -> Column:
    """Number of the grid line nearest to a coordinate."""
    return F.floor(x / size + 0.5).cast("long")
