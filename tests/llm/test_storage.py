"""Fingerprints, packing and media columns against brute force and exact round trips."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from wayfold.llm import fingerprint as fp
from wayfold.llm import media, packing
from wayfold.llm.scratch import new_folder, saved

TEXTS = [None, "", "a", "One. Two! Three?\nFour | five\n\n", "x" * 5000, "é\U0001f600 " * 300, "same text. twice", "same text. twice",
         " \n\t ", "<|endoftext|> in a text", "word " * 6000, "l.\n" * 3000]


def docs(spark, texts=TEXTS):
    rows = [(i, t, 5, "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, `offset` int, _bucket string").repartition(3)


def test_sketch_recovers_all_differences():
    rng = np.random.default_rng(1)
    a, b = [], []
    for same, only_a, only_b in [(0, 0, 0), (50, 0, 0), (0, 3, 0), (1000, 5, 9), (10, 400, 30), (3, 0, 2000)]:
        keys = rng.integers(0, 2**64, same + only_a + only_b, dtype=np.uint64)
        a.append(np.unique(keys[: same + only_a])), b.append(np.unique(np.r_[keys[:same], keys[same + only_a :]]))
    for x, y, (p, q) in zip(a, b, fp.differences(a, b), strict=True):
        assert set(p) == set(x) - set(y) and set(q) == set(y) - set(x)


def test_fingerprint(spark):
    out = {r["doc_id"]: r for r in fp.op3_fingerprint(docs(spark), buckets=5).collect()}
    assert len(out) == len(TEXTS)
    texts = [t or "" for t in TEXTS]
    for i, t in enumerate(texts):
        nxt = texts[(i + 1) % len(texts)]
        n = len(t) // 4
        changed = t[: len(t) - n] + nxt[:n]
        like = lambda x, y: 1.0 if not (x | y) else len(x & y) / len(x | y)
        own = set(fp.paragraphs(t).tolist())
        r = out[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(changed.encode()).hexdigest())
        assert r["near_edited"] == pytest.approx(like(own, set(fp.paragraphs(changed).tolist())))
        assert r["near_next"] == pytest.approx(like(own, set(fp.paragraphs(nxt).tolist())))
    assert out[6]["fingerprint"] == out[7]["fingerprint"]


def test_fingerprint_edges(spark):
    assert fp.op3_fingerprint(docs(spark).limit(0)).count() == 0
    one = fp.op3_fingerprint(docs(spark, ["only. one"])).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (1, "a"), (None, "z"), (2, None)], "doc_id long, text string")
    assert fp.op3_fingerprint(rows, buckets=3).count() == 5


def check_plan(counts, capacity):
    places = Counter()
    bins = {}
    for size, first, each, times, number, at in packing.plan(counts, capacity):
        assert first == places[size]
        places[size] += each * times
        for b in {number, number + times - 1}:
            bins.setdefault(b, []).append((at, each * size))
    assert dict(places) == {s: n for s, n in counts.items() if n}
    total = 0
    for _, first, each, times, number, _ in packing.plan(counts, capacity):
        total = max(total, number + times)
    for spans in bins.values():
        at = 0
        for start, length in sorted(spans):
            assert start == at
            at += length
        assert at <= capacity
    return total


def best(items, capacity):
    """Fewest bins, by trying all."""
    items, found = sorted(items, reverse=True), [len(items)]

    def go(i, rooms):
        if len(rooms) >= found[0]:
            return
        if i == len(items):
            found[0] = len(rooms)
            return
        for k in range(len(rooms)):
            if rooms[k] >= items[i] and rooms[k] not in rooms[:k]:
                go(i + 1, [*rooms[:k], rooms[k] - items[i], *rooms[k + 1 :]])
        go(i + 1, [*rooms, capacity - items[i]])

    go(0, [])
    return found[0]


def lower_bound(counts, capacity):
    """Fewest bins that any packing needs, by pieces over half a bin and what the rest leaves over."""
    most = -(-sum(s * n for s, n in counts.items()) // capacity)
    for a in range(1, capacity // 2 + 1):
        alone = sum(n for s, n in counts.items() if s > capacity - a)
        half = {s: n for s, n in counts.items() if capacity // 2 < s <= capacity - a}
        rest = sum(s * n for s, n in counts.items() if a <= s <= capacity // 2) - sum((capacity - s) * n for s, n in half.items())
        most = max(most, alone + sum(half.values()) + max(0, -(-rest // capacity)))
    return most


def test_plan_keeps_the_optimum_where_it_reduces():
    rng = random.Random(3)
    for _ in range(150):
        cap = rng.randint(5, 40)
        items = [rng.randint(1, cap) for _ in range(rng.randint(1, 9))]
        n = check_plan(Counter(items), cap)
        fixed, stock = packing.reduce_instance(Counter(items), cap)
        rest = [s for s in stock.sizes for _ in range(stock.count[s])]
        assert sum(t for _, t in fixed) + best(rest, cap) == best(items, cap)
        assert n <= best(items, cap) + 1
    big = {rng.randint(1, 2048): rng.randint(1, 10**6) for _ in range(1500)}
    bins = check_plan(big, 2048)
    assert bins <= 1.005 * lower_bound(big, 2048) + 1
    assert len(packing.plan(big, 2048)) < 50_000


def test_packing(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out = packing.op4_packing(docs(spark)).collect()
    by_doc, by_seq = {}, {}
    for r in out:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
    for i, t in enumerate(TEXTS):
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4")
        at = 0
        for n, r in enumerate(sorted(by_doc[i], key=lambda r: r["piece"])):
            assert (r["piece"], r["start"]) == (n, at)
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            assert n == 0 or r["length"] == 2048
            at += r["length"]
        assert at == len(ids)
    for rows in by_seq.values():
        at = 0
        for r in sorted(rows, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
    assert packing.op4_packing(docs(spark).limit(0)).count() == 0
    sizes = saved(spark.createDataFrame([(i, 0, 5, "x") for i in range(500)] + [(1, 0, 5, "x")], "doc_id long, piece int, length long, _x string"), "t")
    assert packing.pack(sizes, 10).select("sequence_id", "offset").distinct().count() == 501
    with pytest.raises(ValueError):
        packing.pack(spark.createDataFrame([(1, 0, 11)], "doc_id long, piece int, length long"), 10)


def test_media(spark):
    df = docs(spark)
    root = new_folder(spark, "media-test")
    rows = saved(media.store_texts(df, root), "rows")
    heads = {r["doc_id"]: r for r in media.header_columns(rows).collect()}
    out = {r["doc_id"]: r for r in media.op6_media(df).collect()}
    assert len(out) == len(TEXTS)
    for i, t in enumerate(TEXTS):
        data = (t or "").encode()
        payload = data + bytes(-len(data) % 64 if data else 64)
        r = out[i]
        assert (r["n_bytes"], r["payload_bytes"]) == (len(data), len(payload))
        assert r["payload_sha256"] == r["digest"] == hashlib.sha256(payload).hexdigest()
        assert r["tail_crc32"] == zlib.crc32(payload[-64:])
        image = media.to_png(payload)
        assert media.from_png(image) == payload
        assert (r["media_bytes"], r["media_sha256"]) == (len(image), hashlib.sha256(image).hexdigest())
        assert (heads[i]["width"], heads[i]["height"], heads[i]["depth"]) == (64, len(payload) // 64, 8)
    assert out[6]["feature"] == out[7]["feature"] and out[0]["feature"] == out[1]["feature"]
    assert media.op6_media(df.limit(0)).count() == 0


def test_shards_are_tar_files_with_each_payload_once(spark):
    import tarfile
    from pathlib import Path

    root = new_folder(spark, "media-tar")
    saved(media.store_texts(docs(spark, ["same"] * 40).coalesce(1), root), "rows")
    (path,) = Path(root.removeprefix("file://")).glob("*.tar")
    with tarfile.open(path) as tar:
        assert len(tar.getnames()) == 1


@pytest.mark.parametrize("text", [" " * 2_000_000, "a" + "\n" * 2_000_000 + "b", "x" * 500_000, "word " * 100_000, "\t \n" * 500_000 + "end <|endoftext|>"])
def test_ids_of_very_long_runs(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert packing.token_ids(text, packing.default_vocabulary()) == tok.encode(text, add_special_tokens=False).ids
