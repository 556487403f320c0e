"""Encoding and decoding against the sentencepiece library."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor

from wayfold.llm import piece_bpe as pb

DATA = "/root/testdata/sf0.001/documents.parquet"


@pytest.fixture(scope="module")
def library():
    return SentencePieceProcessor(model_file=pb.default_model())


@pytest.fixture(scope="module")
def model():
    return pb.piece_model(pb.default_model())


def made_texts():
    rng = random.Random(7)
    parts = ["a", "b", "ab", "the", "ing", " ", "  ", "\n", "\t", "é", "日本", "語", "ñ", "0", "12", "▁", "\U0001f600", "é", "\x00", "return", "signal", "PyObject", "language", "﻿", "</s>", "<0x41>"]
    mixed = ["".join(rng.choices(parts, k=rng.randint(0, 120))) for _ in range(3000)]
    letters = ["".join(rng.choices("abcdeinrstlo", k=rng.randint(1, 600))) for _ in range(800)]
    runs = [c * n + tail for c in ("a", "ab", " ", "=", "日", "\n") for n in (*range(40), 300) for tail in ("", "the")]
    return mixed + letters + runs


def test_encodes_as_the_library(library, model):
    texts = made_texts()
    ours = [ids.tolist() for start in range(0, len(texts), 700) for ids in model.encode(texts[start : start + 700])]
    assert ours == library.encode(texts, add_eos=True, num_threads=1)
    assert [model.decode(ids) for ids in ours] == library.decode(ours)


def test_runs_of_spaces(library, model):
    for n in [*range(2, 200), 4097, 100_000]:
        assert list(model.run(n)) == library.encode(" " * (n - 1))


def test_general_rounds_need_no_special_runs(library, monkeypatch):
    """With tied scores in the rounds, a word's merges wait for one another and still come out right."""
    own = pb.PieceModel(pb.default_model())
    table = sorted((own.run_ids[a] * own.size + own.run_ids[b], 1 << 30, own.run_ids[a + b]) for a in own.run_ids for b in own.run_ids if a + b in own.run_ids)
    rows = sorted([*zip(own.keys[:-1].tolist(), own.ranks[:-1].tolist(), own.merged[:-1].tolist(), strict=True), *table])
    for name, column in zip(("keys", "ranks", "merged"), zip(*rows, (1 << 62, int(pb.NONE), 0), strict=True), strict=True):
        monkeypatch.setattr(own, name, pb.np.array(column, dtype=pb.np.int64))
    own.runs_last = False
    texts = [" " * n + "the" for n in range(60)]
    assert [x.tolist() for x in own.encode(texts)] == library.encode(texts, add_eos=True)


def test_decodes_any_ids(library, model):
    rng = random.Random(3)
    for _ in range(5000):
        ids = [rng.randrange(model.size) if rng.random() < 0.3 else rng.randrange(300) for _ in range(rng.randint(0, 9))]
        assert model.decode(ids) == library.decode(ids)


def test_long_texts(library, model):
    texts = ["x" * 300_000, " " * 300_000, "wort " * 60_000, "abcdefgh" * 20_000]
    assert [x.tolist() for x in model.encode(texts)] == library.encode(texts, add_eos=True)


def test_query(spark, library):
    docs = spark.read.parquet(DATA).unionByName(spark.createDataFrame([(None, None, "x", "y", 0), (7, "", "x", "y", 0), (7, "", "x", "y", 0), (8, " a  b\n", None, None, None)], "doc_id long, text string, lang string, source string, n_chars long"))
    got = sorted(map(tuple, pb.op12_piece_tokens(docs.withColumn("ids_sha256", F.lit("clash"))).collect()), key=str)
    want = []
    for r in docs.collect():
        ids = library.encode(r["text"] or "", add_eos=True)
        want.append((r["doc_id"], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert pb.op12_piece_tokens(docs.limit(0)).count() == 0


def test_round_trip_of_columns(spark):
    rows = spark.createDataFrame([(1, "a b  c\n", 5, "x"), (2, None, 6, "y"), (2, None, 6, "y")], "doc_id long, text string, ids int, other string")
    tokens = pb.encode_pieces(rows)
    assert tokens.columns == ["doc_id", "text", "other", "ids"] and tokens.where("doc_id = 2").first()["ids"] == [2]
    back = pb.decode_pieces(tokens).orderBy("doc_id").collect()
    assert [(r["doc_id"], r["text"], r["other"]) for r in back] == [(1, "a b  c\n", "x"), (2, "", "y"), (2, "", "y")]
    assert pb.decode_pieces(spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")).first()["text"] is None
