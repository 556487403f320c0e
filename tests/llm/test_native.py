"""URL filters, sharding and mixing against plain Python."""

import re
import zlib

import pytest
from pyspark.sql import functions as F

from wayfold.llm import mixing, sharding, url_filter

URLS = [None, "", "no scheme", "http://a.org", "http://a.org/", "https://X.example.ORG/es/1", "https://example.org/en/15?x=1#y",
        "http://example.org/en/2", "http://b.com/fr/9", "http://b.com/de/", "http://b.com/De/", "http://casino-win.net/x", "http://mycasino.net/x",
        "ftp://n.net/a?casino", "http://evilexample.org/es/", "http://cheap-red-pills.net", "http://a.org?ads", "x://y://casino.org/es/"]


def brute(url):
    rest = url.partition("://")[2] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = []
    for r in url_filter.CONTRACT_RULES:
        h, _, p = r.name.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            fits.append((len(r.name), r.name, r.verdict))
    if fits:
        return host, path, max(fits)[1], max(fits)[2]
    bad = any(re.search(r.regex, rest.lower()) for r in url_filter.PATTERN_RULES)
    return host, path, None, "block" if bad else "allow"


@pytest.mark.parametrize("inline", [2000, 0])
def test_urls(spark, inline):
    rows = [(i, u, "kept") for i, u in enumerate(URLS + URLS[:8])]
    df = spark.createDataFrame(rows, "page_id long, url string, host string")
    always = url_filter.Rule("zz", "allow", "zzz", (), "url", False)
    out = url_filter.judge_urls(df, [*url_filter.CONTRACT_RULES, *url_filter.PATTERN_RULES, always], max_inline_rules=inline)
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in out.collect()}
    assert got == {i: brute(u) for i, u, _ in rows}


def test_urls_empty_and_no_rules(spark):
    df = spark.createDataFrame([], "page_id long, url string")
    assert url_filter.op5_url_filter(df).count() == 0
    df = spark.createDataFrame([(1, "http://casino.net")], "page_id long, url string")
    assert url_filter.judge_urls(df, []).first()["verdict"] == "allow"


def jump(key, n):
    key &= 2**64 - 1
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump_hash(spark):
    keys = [0, 1, -1, 2**63 - 1, -(2**63), 12345, None] + list(range(50, 400))
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    for n in (1, 8, 9, 32, 33, 37, 10_000):
        got = [r[0] for r in df.select(sharding.jump_hash(F.col("k"), n)).collect()]
        assert got == [jump(k or 0, n) for k in keys]
    with pytest.raises(ValueError):
        sharding.jump_hash(F.col("k"), 0)


def test_sharding(spark):
    rows = [(i, "x" * (i % 7), "clash") for i in range(500)] + [(3, "xxx", "a"), (None, None, None), (7, "é\U0001f600", "b"), (None, "", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard string")
    out = sharding.op9_sharding(df).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["size"], r["text_crc32"]) for r in out) == sorted(
        (d is None, d or 0, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, _ in rows)
    for s in range(8):
        assert sorted(r["slot"] for r in out if r["shard"] == s) == list(range(sum(r["shard"] == s for r in out)))
    assert all(r["grown_shard"] in (r["shard"], 8) for r in out)
    assert sharding.op9_sharding(df.limit(0)).count() == 0
    clash = sharding.shard_rows(spark.createDataFrame([(1, 2)], "doc_id long, slot int"), "doc_id", 4).first()
    assert clash["slot"] == 0


def test_keys_of_other_types(spark):
    rows = [("a", 1.5), ("b", None), (None, 2.0), ("a", 1.5), ("é", 0.0)]
    df = spark.createDataFrame(rows, "k string, x double")
    for key in ("k", "x"):
        out = sharding.shard_rows(df, key, 3).collect()
        assert len(out) == 5 and all(len({r["shard"] for r in out if r[key] == v}) == 1 for v in {r[key] for r in out})
        assert all(sorted(r["slot"] for r in out if r["shard"] == s) == list(range(sum(r["shard"] == s for r in out))) for s in range(3))


def water(sizes, weights=(5, 2, 1), most=3.0):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        rest = total - sum(most * sizes[s] for s in capped)
        share = sum(w[s] for s in names if s not in capped)
        t = {s: most * sizes[s] if s in capped else rest * w[s] / share for s in names}
        over = {s for s in names if s not in capped and t[s] > most * sizes[s]}
        if not over:
            return t
        capped |= over


def test_mixing(spark):
    rows = [(i, "w " * (i * 7 % 50), ["a", "b", "c", None, "é"][min(i % 9, 4)]) for i in range(600)]
    rows += [(1000, None, "a"), (1001, "", "z"), (5, "w " * 35, "b"), (5, "w " * 35, "b"), (None, "x\u00a0y z", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mix_documents(df).collect()
    assert len(out) == len(rows)
    sizes, taken = {}, {}
    for r in out:
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        assert 0 <= r["taken"] <= 3 * r["size"]
    goal = water(sizes)
    for r in out:
        assert r["target"] == pytest.approx(goal[r["source"]]) and r["source_size"] == sizes[r["source"]]
    assert all(abs(taken[s] - goal[s]) <= 1 for s in goal)
    again = mixing.mix_documents(df.repartition(7)).collect()
    assert sorted(map(str, out)) == sorted(map(str, again))
    assert mixing.mix_documents(df.limit(0)).count() == 0


def test_mixed_texts(spark):
    rows = [(i, "w " * (1 + i % 20), "ab"[i % 4 == 0], i) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    docs = mixing.mixed_texts(df)
    assert docs.columns == df.columns
    times = {r["doc_id"]: r["copies"] for r in mixing.mix_documents(df).collect()}
    got = {r["doc_id"]: r["count"] for r in docs.groupBy("doc_id").count().collect()}
    assert got == {k: v for k, v in times.items() if v}


def test_unequal_weights(spark):
    rows = [(i, "s", 10, 1.0 + 3.0 * (i % 2)) for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, size long, w double")
    out = mixing.mix(df, mixing.source_targets(df, total=8000), weight_col="w", slices=64).collect()
    heavy = sum(r["copies"] for r in out if r["w"] == 4) / sum(r["copies"] for r in out)
    assert 0.75 < heavy < 0.85 and sum(r["taken"] for r in out) == 8000


def test_many_sources(spark, monkeypatch):
    """Sources in several ranges, and rows joined to them by a shuffle, give the same mix as the broadcast of a few."""
    rows = [(i, "w " * (1 + i * 7 % 50), None if i % 40 == 39 else f"host{i % 40:03}.example") for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    few = sorted(map(str, mixing.mix_documents(df).collect()))
    monkeypatch.setattr(mixing, "RANGE_ROWS", 10)
    monkeypatch.setattr(mixing, "MOST_BROADCAST", 5)
    assert sorted(map(str, mixing.mix_documents(df).collect())) == few


def test_longer_documents_are_likelier_and_equal_rows_alike(spark):
    rows = [(i, "s", 4 if i % 2 else 64, None) for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, size long, x string").withColumn("w", mixing.richness(F.col("size")))
    out = mixing.mix(df, mixing.source_targets(df, total=20_000), weight_col="w").collect()
    long, short = (sum(r["copies"] for r in out if r["size"] == n) for n in (64, 4))
    assert 1.9 < long / short < 2.9 and sum(r["taken"] for r in out) == 20_000  # 7 digits to 3
    same = spark.createDataFrame([(1, "s", 10)] * 7 + [(2, "s", 5)], "doc_id long, source string, size long")
    out = mixing.mix(same, mixing.source_targets(same, total=40)).collect()
    assert len(out) == 8 and len({r["taken"] for r in out if r["doc_id"] == 1}) == 1 and 33 < sum(r["taken"] for r in out) <= 40
