"""Sharding by jump consistent hashing, in DataFrame functions only.

The hash needs no ring table: from a key and the number of shards it walks a pseudo-random series of
jumps. Growing from n to n + 1 shards moves about 1 / (n + 1) of the keys, all of them to the new shard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: Multiplier of the published algorithm's linear congruential generator, 2 ** 31.
MULTIPLIER, TWO_31 = 2862933555777941757, 2147483648.0
#: Bits of a limb: products of two limbs, and sums of three such, fit in a long.
LIMB = 22
#: Jumps that nearly every key needs at most; their mean number is the logarithm of the number of shards.
JUMPS = 32
#: Offsets that are broadcast, at most.
MOST_BROADCAST = 500_000


def jump_hash(key: Column, shards: int) -> Column:
    """Return the shard (int, from 0) of a 64-bit integer key, taken as unsigned; a null key counts as 0.

    The generator multiplies modulo 2 ** 64 in limbs of 22, 22 and 20 bits. The few keys that are not
    done after JUMPS jumps go on, up to one jump per shard.
    """
    if shards < 1:
        raise ValueError("shards must be 1 or more")
    low, top = F.lit((1 << LIMB) - 1).cast("long"), F.lit((1 << 64 - 2 * LIMB) - 1).cast("long")
    m0, m1, m2 = (F.lit(MULTIPLIER >> s & (1 << LIMB) - 1).cast("long") for s in (0, LIMB, 2 * LIMB))
    seed = F.coalesce(key.cast("long"), F.lit(0).cast("long"))
    start = F.struct(
        seed.bitwiseAND(low).alias("a"), F.shiftrightunsigned(seed, LIMB).bitwiseAND(low).alias("b"), F.shiftrightunsigned(seed, 2 * LIMB).alias("c"),
        F.lit(-1).cast("long").alias("at"), F.lit(0).cast("long").alias("next"),
    )

    def jump(s: Column) -> Column:
        t0 = s["a"] * m0 + F.lit(1)
        t1 = s["a"] * m1 + s["b"] * m0 + F.shiftright(t0, LIMB)
        t2 = s["a"] * m2 + s["b"] * m1 + s["c"] * m0 + F.shiftright(t1, LIMB)
        b, c = t1.bitwiseAND(low), t2.bitwiseAND(top)
        high = (F.shiftleft(c, 31 - 64 + 2 * LIMB) + F.shiftright(b, 33 - LIMB)).cast("double")
        after = F.floor((s["next"] + F.lit(1)).cast("double") * (F.lit(TWO_31) / (high + F.lit(1.0)))).cast("long")
        return F.struct(t0.bitwiseAND(low).alias("a"), b.alias("b"), c.alias("c"), s["next"].alias("at"), after.alias("next"))

    def jumps(state: Column, n: int) -> Column:
        return F.aggregate(F.sequence(F.lit(1), F.lit(n)), state, lambda s, _: F.when(s["next"] >= shards, s).otherwise(jump(s)))

    if shards <= JUMPS:
        return jumps(start, shards)["at"].cast("int")
    # A one-element array carries the state, so that it is worked out once.
    rest = F.transform(F.array(jumps(start, JUMPS)), lambda s: F.when(s["next"] >= shards, s["at"]).otherwise(jumps(s, shards - JUMPS)["at"]))
    return rest[0].cast("int")


def key_hash(df: DataFrame, key: str) -> Column:
    """Return the 64-bit hash of a key of any type; a null key hashes as 0 if numbers are keys, else as an empty text."""
    kind = df.schema[key].dataType
    if isinstance(kind, T.IntegralType):
        return F.xxhash64(F.coalesce(F.col(key).cast("long"), F.lit(0).cast("long")))
    return F.xxhash64(F.coalesce(F.col(key) if isinstance(kind, T.StringType) else F.to_json(F.struct(F.col(key))), F.lit("")))


def shard_rows(df: DataFrame, key: str, shards: int, shard_col: str = "shard", slot_col: str = "slot", grown_col: str | None = "grown_shard", salts: int | None = None) -> DataFrame:
    """Add each row's shard, its gapless place in the shard, and its shard were there one more.

    Keys are of any type. Placing rows needs no shard in one task: rows are counted per (shard, salt), counts become
    offsets, and rows are numbered within a salt. df must give the same rows when read again.
    Null keys count as one key; equal keys share a shard; ties in a salt are ordered by the other columns,
    and rows equal in all columns take neighbouring slots in any order. An empty table gives an empty one.
    """
    salts = salts or max(64, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    mixed = key_hash(df, key)
    # Copies of a key may be many rows, so the salt comes from the whole row.
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in df.columns if not isinstance(df.schema[c].dataType, T.MapType)]), F.lit(salts)).cast("int")
    placed = df.withColumns({shard_col: jump_hash(mixed, shards), "_salt": salt} | ({grown_col: jump_hash(mixed, shards + 1)} if grown_col else {}))
    counts = df.select(jump_hash(mixed, shards).alias("_s"), salt.alias("_t")).groupBy("_s", "_t").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("_s").orderBy("_t").rowsBetween(Window.unboundedPreceding, -1)
    # At most shards * salts rows, whatever the size of df.
    offsets = counts.select("_s", "_t", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    offsets = F.broadcast(offsets) if shards * salts <= MOST_BROADCAST else offsets
    order = Window.partitionBy(shard_col, "_salt").orderBy(F.col(key), *[F.col(c) for c in df.columns if c != key and not isinstance(df.schema[c].dataType, T.MapType)])
    rows = placed.withColumn("_nr", F.row_number().over(order))
    rows = rows.join(offsets, (F.col(shard_col) == F.col("_s")) & (F.col("_salt") == F.col("_t")))
    return rows.withColumn(slot_col, (F.col("_offset") + F.col("_nr") - 1).cast("long")).drop("_s", "_t", "_salt", "_nr", "_offset")


def op9_sharding(documents: DataFrame, shards: int = 8) -> DataFrame:
    """Shard all documents by doc_id. Null texts are of 0 bytes; the text itself is read once, for size and checksum."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = documents.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    out = shard_rows(rows, "doc_id", shards)
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
