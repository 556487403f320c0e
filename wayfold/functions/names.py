"""Column functions on road numbers, train codes, station names and search text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Road classes by the letter of their numbers, and by a map's highway value.
LETTER_CLASS = {"S": "provincial", "X": "county", "Y": "township", "C": "village"}
HIGHWAY_CLASS = {
    "motorway": "expressway", "motorway_link": "expressway", "trunk": "expressway", "trunk_link": "expressway", "primary": "national", "primary_link": "national",
    "secondary": "provincial", "secondary_link": "provincial", "tertiary": "county", "tertiary_link": "county", "unclassified": "township", "residential": "township",
    "living_street": "township", "road": "township", "track": "village", "service": "village",
}


def road_class(ref: Column) -> Column:
    """Class of a road number, or null where it has no valid form."""
    r = F.upper(F.trim(ref))
    number = F.try_to_number(F.regexp_extract(r, r"^G(\d{1,3})$", 1), F.lit("999"))
    out = F.when(r.rlike(r"^G\d{1,3}$"), F.when(number < 100, "expressway").otherwise("national"))
    out = out.when(r.rlike(r"^G\d{4}$") | r.rlike(r"^G\d{1,2}[WEN]$"), "expressway")
    for letter, name in LETTER_CLASS.items():
        out = out.when(r.rlike(rf"^{letter}\d{{1,4}}$"), name)
    return out


def canonical_ref(ref: Column) -> Column:
    """Road number without zero padding; G and four digits stay, as they are a class of their own."""
    r = F.upper(F.trim(F.coalesce(ref, F.lit(""))))
    g, other = r"^G0*(\d{1,3})$", r"^([SXYC])0*(\d{1,4})$"
    return F.when(r.rlike(r"^G\d{4}$"), r).when(r.rlike(g), F.regexp_replace(r, g, "G$1")).when(r.rlike(other), F.regexp_replace(r, other, "$1$2")).otherwise(r)


def normalize_refs(raw: Column) -> Column:
    """Split a list of road numbers, canonicalise, drop blanks and repeats, keep the order; null gives an empty array."""
    pieces = F.transform(F.split(F.coalesce(raw, F.lit("")), r"[;,、，/|]+"), lambda p: canonical_ref(F.regexp_replace(p, r"[\s　]+", "")))
    return F.array_distinct(F.filter(pieces, lambda p: p != ""))


def road_key(ref: Column, province: Column, county: Column) -> Column:
    """Key of a road: its number where that is unique in the country, else province (and county) in front; null if it cannot be made."""
    c, some = road_class(ref), F.coalesce(province, F.lit("")) != ""
    small = c.isin("township", "village") & (F.coalesce(county, F.lit("")) != "")
    return F.when(c.isin("national", "expressway"), ref).when(c.isNotNull() & some, F.when(small, F.concat_ws(":", province, county, ref)).otherwise(F.concat_ws(":", province, ref)))


def infer_class(highway: Column, ref_class: Column) -> Column:
    out = F.lit("other")
    for value, name in HIGHWAY_CLASS.items():
        out = F.when(highway == value, name).otherwise(out)
    return F.coalesce(ref_class, out)


def train_class(code: Column) -> Column:
    first = F.substring(F.upper(F.trim(F.coalesce(code, F.lit("")))), 1, 1)
    return F.when(first.isin("G", "D", "C", "Z", "T", "K"), first).otherwise("OTHER")


def is_train_code(text: Column) -> Column:
    return F.upper(F.trim(text)).rlike(r"^[GDCZTKYS]?\d{1,5}$")


def text_score(field: Column, query: str, scale: float = 1.0) -> Column:
    """Search score of a field: 100 equal, 86 prefix, 68 contained, case and outer blanks aside; else 0."""
    t, q = F.lower(F.trim(F.coalesce(field, F.lit("")))), query.strip().lower()
    if not q:
        return F.lit(0.0)
    return F.when(t == q, 100.0 * scale).when(t.startswith(q), 86.0 * scale).when(t.contains(q), 68.0 * scale).otherwise(0.0)


def suggest_score(name: Column, query: str) -> Column:
    """Suggestion score of a name, case-sensitive: 100 equal, 80 prefix, 50 contained; else 0."""
    return F.when(name == query, 100).when(name.startswith(query), 80).when(name.contains(query), 50).otherwise(0)


def _station(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, "站$", ""))


def same_station(a: Column, b: Column) -> Column:
    """Tell whether two station names mean one station: equal without the word for station, or one within the other unless only a compass suffix sets them apart."""
    x, y = _station(a), _station(b)
    side = "[东西南北]$"
    stem = lambda c: F.regexp_replace(c, side, "")
    apart = (stem(x) == stem(y)) & (F.char_length(stem(x)) >= 2) & (x.rlike(side) | y.rlike(side))
    some = (F.coalesce(x, F.lit("")) != "") & (F.coalesce(y, F.lit("")) != "")
    return some & ((x == y) | (~apart & (x.contains(y) | y.contains(x))))


def same_stop(a: Column, b: Column) -> Column:
    """Tell whether two names mean one stop of a journey: equal, or without the word for station one starts with the other."""
    x, y = F.trim(_station(a)), F.trim(_station(b))
    some = (F.coalesce(a, F.lit("")) != "") & (F.coalesce(b, F.lit("")) != "")
    return some & ((a == b) | ((x != "") & (y != "") & (x.startswith(y) | y.startswith(x))))


def station_score(name: Column, pinyin: Column, short: Column, telecode: Column, query: str) -> Column:
    """Suggestion score of a station: 100 name or code, 80 start of the name, 70 of its spelling, 50 in the name, 40 in the spelling; null if none."""
    q = query.strip().lower()
    n, p, s, t = (F.lower(F.coalesce(c, F.lit(""))) for c in (name, pinyin, short, telecode))
    return F.when((n == q) | (t == q), 100).when(n.startswith(q), 80).when(s.startswith(q) | p.startswith(q), 70).when(n.contains(q), 50).when(p.contains(q) | s.contains(q), 40)


def road_sign(ref: Column) -> Column:
    """Kind of sign of a road number; whatever is no number gets the sign of a national highway."""
    r = F.upper(F.trim(F.coalesce(ref, F.lit(""))))
    letter, three = F.substring(r, 1, 1), F.length(r) == 4
    coded = F.when(letter == "G", F.when(three, "national-highway").otherwise("national-expressway")).when(letter == "S", F.when(three, "provincial-highway").otherwise("provincial-expressway"))
    coded = coded.when(letter == "X", "county").when(letter == "Y", "township").otherwise("village")
    return F.when(r.rlike(r"^(?:此生必驾|必驾)\s*\d{2,3}$"), "scenic").when(r.rlike(r"^[GSXYC]\d{1,4}$"), coded).otherwise("national-highway")


def spur_reason(honors: Column, level: Column, km: Column) -> Column:
    """Say why a place far from the route is worth the way; null without an honour or a level."""
    why = F.when(F.coalesce(F.size(honors), F.lit(0)) > 0, F.array_join(honors, "、")).otherwise(F.when(level != "", level))
    return F.concat(F.lit("距本次路线 "), F.floor(km + 0.5).cast("string"), F.lit(" km，需专程绕行；"), why, F.lit("，值得为它单独安排时间"))


def offset_label(ms: Column) -> Column:
    """Say a shift of a timetable in whole minutes: on time, late or early."""
    m = F.floor(ms / 60_000 + 0.5).cast("long")
    return F.when(m == 0, "准点").when(m > 0, F.concat(F.lit("晚点 "), m.cast("string"), F.lit(" 分钟"))).otherwise(F.concat(F.lit("早点 "), F.abs(m).cast("string"), F.lit(" 分钟")))


def stop_anchor(kind: Column, at: Column, arrive: Column, depart: Column, prefer: str = "auto") -> Column:
    """The time that a stop goes by: of a first stop its own, of a last one its own, else the departure; or what is preferred first."""
    if prefer == "depart":
        return F.coalesce(depart, at, arrive)
    if prefer == "arrive":
        return F.coalesce(arrive, at, depart)
    return F.when(kind == "depart", F.coalesce(at, depart, arrive)).when(kind == "arrive", F.coalesce(at, arrive, depart)).otherwise(F.coalesce(depart, arrive, at))


def near_arrival(now_ms: Column, anchor_ms: Column, window_ms: int = 45 * 60_000) -> Column:
    """Tell whether a clock is within 45 minutes of a stop's time; a stop without one is never near."""
    return F.coalesce(F.abs(now_ms - anchor_ms) <= window_ms, F.lit(False))


def flight_number(raw: Column) -> Column:
    """Flight number in capitals, without leading underscores and zeros after the carrier."""
    r = F.upper(F.regexp_replace(F.trim(raw), r"^_+", ""))
    return F.regexp_replace(r, r"^([A-Z0-9]{2})0+(\d)", "$1$2")


def months_text(months: Column) -> Column:
    """Months as runs: three or more in a row as a-b, others one by one; none or all twelve is the whole year."""
    m = F.array_sort(F.array_distinct(months))
    starts = F.filter(m, lambda x: ~F.array_contains(m, x - 1))
    run_end = lambda s: F.array_min(F.filter(m, lambda e: (e >= s) & ~F.array_contains(m, e + 1)))
    text = F.transform(starts, lambda s: F.when(run_end(s) - s >= 2, F.concat(s.cast("string"), F.lit("-"), run_end(s).cast("string"))).otherwise(F.array_join(F.transform(F.sequence(s, run_end(s)), lambda x: x.cast("string")), "、")))
    return F.when(F.coalesce(F.size(months), F.lit(0)).isin(0, 12), "全年").otherwise(F.concat(F.array_join(text, "、"), F.lit(" 月")))
