"""The pipeline's stages, one after another, against plain Python on a small corpus."""

import random
import re

import numpy as np
import pytest

import corpus_pipeline
from tests.llm.test_near_dup import brute
from tests.llm.test_native import water

HEX = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(12)
    vocabulary = ["".join(rng.choice("aeinrstlou") for _ in range(rng.randint(2, 8))) for _ in range(600)]
    docs, labels = [], []
    for i in range(500):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(20, 120))]
        toxic = i % 7 == 0
        if toxic:
            for _ in range(3):
                words.insert(rng.randint(0, len(words)), rng.choice(["idiot", "moron", "scumbag"]))
        if i % 9 == 1:
            words[3:3] = ["token", "=", f'"{HEX}"']
        docs.append([i, " ".join(words), "en", ["a", "b", "c", None][min(i % 5, 3)]])
        labels.append((i, 1, int(toxic)))
    for i in range(500, 560):
        base = docs[(i - 500) * 5 + 1]
        words = base[1].split()
        if i % 3 and len(words) > 60:
            words[len(words) // 2] = "changed"
        docs.append([i, " ".join(words), "en", "c"])
    docs += [[600, None, None, None], [601, "", "en", "a"], [602, "word " * 9000, "en", "b"]]
    folder = str(tmp_path_factory.mktemp("sf"))
    rows = [(d, t, lang, s, len(t or "")) for d, t, lang, s in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, rows


def test_stages(spark, corpus):
    folder, rows = corpus
    df = spark.read.parquet(f"{folder}/documents.parquet")
    columns, seen = df.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        df = stage(spark, df, folder)
        df.write.mode("overwrite").parquet(f"{folder}/out-{name}")
        df = spark.read.parquet(f"{folder}/out-{name}")
        seen[name] = df.collect()
        assert name == "packing" or df.columns == columns
    toxic = re.compile(r"\b(idiot|moron|scumbag)\b")
    clean = {r[0]: r[1] for r in rows if not toxic.search(r[1] or "")}
    assert {r["doc_id"]: r["text"] for r in seen["toxicity"]} == clean
    groups = brute(list(clean.items()), 80)
    assert sorted(r["doc_id"] for r in seen["near_dup"]) == sorted(d for d, (_, c) in groups.items() if c == d)
    before = {r["doc_id"]: r["text"] for r in seen["near_dup"]}
    for r in seen["secret_scan"]:
        want = before[r["doc_id"]] and before[r["doc_id"]].replace(HEX, "[secret]")
        assert r["text"] == want and r["n_chars"] == len(want or "")
    texts = {r["doc_id"]: r["text"] for r in seen["secret_scan"]}
    source = {r["doc_id"]: r["source"] for r in seen["secret_scan"]}
    words = {d: len((t or "").split()) for d, t in texts.items()}
    sizes, taken, times = {}, {}, {}
    for d, n in words.items():
        sizes[source[d]] = sizes.get(source[d], 0) + n
    for r in seen["mixing"]:
        assert r["text"] == texts[r["doc_id"]]
        taken[r["source"]] = taken.get(r["source"], 0) + words[r["doc_id"]]
        times[r["doc_id"]] = times.get(r["doc_id"], 0) + 1
    assert max(times.values()) <= 3
    longest = max(words.values())
    for s, goal in water(sizes).items():
        assert goal - longest - 1 <= taken.get(s, 0) <= goal + 1
    by_seq, length = {}, {}
    for r in seen["packing"]:
        by_seq.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        length[r["doc_id"]] = length.get(r["doc_id"], 0) + r["length"]
    assert set(length) == set(times)
    for spans in by_seq.values():
        ends = np.cumsum([n for _, n in sorted(spans)])
        assert [at for at, _ in sorted(spans)] == [0, *ends[:-1]] and ends[-1] <= 2048


def test_run(spark, corpus):
    folder, _ = corpus
    out = corpus_pipeline.run(spark, folder)
    assert {"doc_id", "piece", "sequence_id"} <= set(out.columns) and out.count() > 0
