"""Readers for the files of a travel-geometry store: corridors, road geometry, indexes, boards, stations, trains, graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.operators.catalogue import first_by_priority
from wayfold.operators.lines import with_cum_km

POINTS = "array<array<double>>"
CORRIDOR = f"id string, name string, source string, sourceNames array<string>, stationsHint array<string>, railway {POINTS}, note string"
GEOMETRY = f"key string, ref string, class string, points {POINTS}, totalKm double, precision string"
ROAD = "key string, ref string, class string, provinces array<string>, lengthKm double, hasGeom boolean, precision string, status string"
BOARD = "id string, title string, itemCount bigint, items array<struct<rank: bigint, name: string, roadKeys: array<string>, province: array<string>, lengthKm: double>>"


def json_files(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Read JSON documents, one a file, with the file's name; broken files are left out."""
    rows = spark.read.schema(f"{schema}, _corrupt_record string").json(path, multiLine=True, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt_record")
    rows = rows.withColumn("file", F.element_at(F.split("_metadata.file_path", "/"), -1))
    return rows.where("_corrupt_record IS NULL").drop("_corrupt_record")


def corridors(spark: SparkSession, path: str) -> DataFrame:
    """Read corridors of two points or more; files named with a leading or double underscore are not corridors."""
    rows = json_files(spark, path, CORRIDOR)
    return rows.where(~F.col("file").startswith("_") & ~F.col("file").contains("__") & (F.size("railway") >= 2))


def polyline(rows: DataFrame, key: str, points: str) -> DataFrame:
    """Explode a column of [lng, lat] pairs to line_id, seq, lng, lat."""
    p = rows.select(F.col(key).alias("line_id"), F.posexplode(points).alias("seq", "p"))
    return p.select("line_id", "seq", F.get("p", F.lit(0)).alias("lng"), F.get("p", F.lit(1)).alias("lat"))


def road_geometry(spark: SparkSession, path: str) -> DataFrame:
    """Read road lines with mileage worked out anew, as stored mileages are in metres in some files and in km in others."""
    rows = json_files(spark, path, GEOMETRY).where(F.size("points") >= 2)
    return with_cum_km(polyline(rows, "key", "points"))


def road_index(spark: SparkSession, path: str, with_geometry: DataFrame | None = None) -> DataFrame:
    """Read the shards of a road index; hasGeom follows the keys that have geometry (a table with key) when they are given."""
    roads = json_files(spark, path, f"roads array<struct<{_struct(ROAD)}>>").select(F.inline("roads"))
    if with_geometry is None:
        return roads
    keys = with_geometry.select("key", F.lit(True).alias("_has")).distinct()
    return roads.join(keys, "key", "left").withColumn("hasGeom", F.coalesce("_has", F.lit(False))).drop("_has")


def _struct(ddl: str) -> str:
    return ", ".join(f"{n}: {t}" for n, t in (f.strip().split(" ", 1) for f in ddl.split(",")))


def official_lengths(parts: list[DataFrame]) -> DataFrame:
    """Union tables of official lengths (key, province, ref, km), earlier ones first; a missing key is province:ref, or ref."""
    key = F.coalesce("key", F.when(F.col("province").isNotNull(), F.concat_ws(":", "province", "ref")).otherwise(F.col("ref")))
    rows = None
    for i, p in enumerate(parts):
        p = p.select(key.alias("key"), "km", F.lit(i).alias("part"))
        rows = p if rows is None else rows.unionByName(p)
    return first_by_priority(rows, ["key"], [F.col("part"), F.col("km")]).drop("part")


def boards(spark: SparkSession, path: str) -> DataFrame:
    """Read ranking boards, a row per item."""
    return json_files(spark, path, BOARD).select(F.col("id").alias("board"), "title", F.inline("items"))


def boards_by_road(items: DataFrame) -> DataFrame:
    """Index the boards of each road key."""
    return items.select("board", F.explode("roadKeys").alias("key")).groupBy("key").agg(F.array_sort(F.collect_set("board")).alias("boards"))


def stations(lines: DataFrame, text: str = "value") -> DataFrame:
    """Parse a station script: records after `@`, fields by `|`; records of less than four fields are passed over."""
    records = lines.select(F.explode(F.split(text, "@")).alias("record"))
    r = records.select(F.split("record", r"\|").alias("f")).where(F.size("f") >= 4)
    return r.select(*[F.get("f", F.lit(i)).alias(n) for i, n in enumerate(("short", "name", "telecode", "pinyin"))])


def train_rows(lines: DataFrame, text: str = "value") -> DataFrame:
    """Parse query rows of 30 fields or more, parted by `|`."""
    r = lines.select(F.split(text, r"\|").alias("f")).where(F.size("f") >= 30)
    return r.select(*[F.get("f", F.lit(i)).alias(n) for i, n in ((2, "train_no"), (3, "code"), (6, "from_telecode"), (7, "to_telecode"), (8, "depart"), (9, "arrive"), (10, "duration"))])


def quality_counts(spark: SparkSession, path: str) -> DataFrame:
    """Count the rows of a CSV by its fifth column."""
    rows = spark.read.csv(path, header=True)
    return rows.groupBy(F.col(rows.columns[4]).alias("status")).agg(F.count("*").alias("n"))


def rail_ways(spark: SparkSession, path: str) -> DataFrame:
    """Read lines of a GeoJSON collection as ways: way, fast, points."""
    schema = "features array<struct<properties: map<string, string>, geometry: struct<type: string, coordinates: string>>>"
    f = json_files(spark, path, schema).select("file", F.posexplode("features").alias("nr", "f"))
    many = F.col("f.geometry.type") == "MultiLineString"
    paths = F.when(many, F.from_json("f.geometry.coordinates", f"array<{POINTS}>")).otherwise(F.array(F.from_json("f.geometry.coordinates", POINTS)))
    fast = F.coalesce(F.try_element_at("f.properties", F.lit("highspeed")) == "yes", F.lit(False))
    ways = f.where(F.col("f.geometry.type").isin("LineString", "MultiLineString")).select("file", "nr", fast.alias("fast"), F.posexplode(paths).alias("part", "points"))
    return ways.where(F.size("points") >= 2).select(F.concat_ws(":", "file", "nr", "part").alias("way"), "fast", "points")


def last_wins(rows: DataFrame, key: str, order: str = "file") -> DataFrame:
    """Of documents with one key keep the one of the last file."""
    return first_by_priority(rows, [key], [F.col(order).desc()])


def is_fast_line(name: Column, source: Column) -> Column:
    """Tell high-speed corridors by source or name."""
    return F.coalesce(source.rlike("(?i)hsr|high.?speed"), F.lit(False)) | F.coalesce(name.rlike("高铁|高速|客运专线|城际"), F.lit(False))
