"""Near duplicates of places against a comparison of all pairs."""

import math
import random
import time

from pyspark.sql import functions as F

from wayfold.operators import poi


def _km(a, b):
    h = math.sin(math.radians(b[1] - a[1]) / 2) ** 2 + math.cos(math.radians(a[1])) * math.cos(math.radians(b[1])) * math.sin(math.radians(b[0] - a[0]) / 2) ** 2
    return 2 * 6371.0 * math.asin(math.sqrt(h))


def _groups(rows):
    """rows: id, name, lng, lat, category; names end in 景区 or in nothing."""
    top = {r[0]: r[0] for r in rows}

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for n, a in enumerate(rows):
        for b in rows[:n]:
            km, x, y = _km(a[2:4], b[2:4]), a[1].removesuffix("景区"), b[1].removesuffix("景区")
            inside = x in y or y in x
            same = (a[1] == b[1] and a[1] and km <= 2) or (x == y and len(x) >= 2 and km <= 1.5) or (len(x) >= 3 and len(y) >= 3 and inside and km <= 1)
            same = same or (a[4] == b[4] == "nature.mountain" and len(x) >= 2 and len(y) >= 2 and inside and km <= 2.5)
            if same:
                i, j = sorted((root(a[0]), root(b[0])))
                top[j] = i
    return {r[0]: root(r[0]) for r in rows}


def test_groups_are_those_of_all_pairs(spark):
    rng = random.Random(3)
    names = ["", "寺", "寺景区", "云山", "云山景区", "大云山", "大云山顶", "东湖", "东湖公园", "大东湖公园"]
    rows = []
    for lat, wide, n in ((30.0, 0.25, 260), (30.5, 0.06, 120), (-0.01, 0.05, 60), (79.5, 0.6, 60)):
        rows += [(len(rows) + i, rng.choice(names), 100 + rng.random() * wide, lat + rng.random() * min(wide, 0.12), rng.choice(["nature.mountain", "food", None])) for i in range(n)]
    df = spark.createDataFrame(rows, "id long, name string, lng double, lat double, category string")
    want = _groups(rows)
    assert {r["id"]: r["group"] for r in poi.near_duplicates(df).collect()} == want and len(set(want.values())) > 20


def test_ten_thousand_spots_of_a_name_make_no_pairs_of_all(spark):
    df = spark.range(10_000).select("id", F.lit("poi").alias("name"), (100 + (F.col("id") % 97) / 10000).alias("lng"), (30 + (F.col("id") % 89) / 10000).alias("lat"))
    began = time.time()
    groups = poi.near_duplicates(df)
    assert groups.select("group").distinct().count() == 1 and time.time() - began < 60
    best = poi.best_of_groups(df.withColumn("score", F.when(F.col("id") != 7, (F.col("id") % 5).cast("double"))), groups).collect()
    assert [r.id for r in best] == [4]
