"""Toxicity against an edit-distance brute force and held-out labels."""

import random
import zlib

from wayfold.llm import toxicity as tox


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_automaton_accepts_exactly_the_words_near_a_term():
    rng = random.Random(2)
    terms = ["scum", "idiot", "loser", "losers", "worthless", "disgusting", "cab", "abba", "abbab"]
    trie = tox.Lexicon(terms)
    words = ["", "a"] + ["".join(rng.choice("abcdilorst") for _ in range(rng.randint(1, 7))) for _ in range(500)]
    for t in terms:
        for _ in range(150):
            w = list(t)
            for _ in range(rng.randint(0, 3)):
                i = rng.randint(0, len(w))
                op = rng.randint(0, 2)
                w[i : i + (op > 0)] = [] if op == 1 else [rng.choice("abdigst")]
            words.append("".join(w))
    for w in words:
        near = [(distance(w, t), t) for t in terms if distance(w, t) <= tox.edits_allowed(t)]
        got = trie.match(w)
        assert got == ((min(near)[1], min(near)[0]) if near else None), w
    assert trie.find("l0ser") == ("loser", 1) and trie.find("1d10t") == ("idiot", 1)


def test_quotation():
    t = 'He said "you idiot" and left.\nYou idiot'
    first, second = t.index("idiot"), t.rindex("idiot")
    assert tox.is_quoted(t, first, first + 5) and not tox.is_quoted(t, second, second + 5)
    assert tox.is_quoted("the word idiot is rude", 9, 14)
    assert not tox.is_quoted('"fine" you idiot "fine"', 11, 16)


def corpus(n=900, seed=4):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("aeinrst") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(20, 80))]
        toxic = i % 6 == 0
        if toxic:
            for _ in range(rng.randint(2, 4)):
                words.insert(rng.randint(0, len(words)), rng.choice(["idiot", "moron", "scumbag"]))
        elif i % 10 == 1:
            words[5:5] = ["he", "said", '"you', 'moron"', "twice"]
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return rows, labels


def test_scores(spark):
    rows, labels = corpus()
    extra = [(10_000, None), (10_001, ""), (10_002, "you idi0t and you morron " + "x " * 30000), (None, "idiot moron"), (0, rows[0][1])]
    docs = spark.createDataFrame([(*r, "s") for r in rows + extra], "doc_id long, text string, score string")
    table = spark.createDataFrame(labels + [(0, 1), (5, None)], "doc_id long, toxic int")
    out = tox.op8_toxicity(docs, table).collect()
    assert len(out) == len(rows) + len(extra)
    truth = dict(labels)
    held = [r for r in out if r["held_out"] and r["doc_id"] in truth]
    assert held and all(zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1 for r in held)
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) >= 0.98 * len(held)
    by = {r["doc_id"]: r for r in out}
    assert by[10_000]["predicted"] == by[10_001]["predicted"] == 0 and by[10_002]["predicted"] == 1 and by[None]["predicted"] == 1
    kept = tox.without_toxic(docs, table)
    assert kept.columns == docs.columns and kept.count() == sum(r["predicted"] == 0 for r in out)


def test_held_out_labels_are_not_read(spark):
    rows, labels = corpus(300)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    flipped = [(d, 1 - t if zlib.crc32(str(d).encode()) % 3 == 1 else t) for d, t in labels]
    a, b = (sorted(map(tuple, tox.op8_toxicity(docs, spark.createDataFrame(x, "doc_id long, toxic int")).collect())) for x in (labels, flipped))
    assert a == b


def test_no_labels_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "idiot"), (2, None)], "doc_id long, text string")
    empty = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r["predicted"] for r in tox.op8_toxicity(docs, empty).collect()} == {0}
    assert tox.op8_toxicity(docs.limit(0), empty).count() == 0


def test_no_term_and_no_clean_word_is_left_out(spark):
    """450 terms, each in all toxic rows, and 2,700 clean words an edit away from one, each in three clean rows."""
    rng = random.Random(6)
    letters = "abcdefghijklmnopqrstuvwxyz"
    terms = sorted({"".join(rng.choice(letters) for _ in range(8)) for _ in range(450)})
    near = sorted({t[:i] + c + t[i + 1 :] for t in terms for i, c in zip(range(1, 7), rng.sample(letters, 6), strict=True) if t[i] != c} - set(terms))
    assert len(terms) > 400 and len(near) > 2_000
    clean = [[] for _ in range(160)]
    for i, w in enumerate(near):
        for k in range(3):
            clean[(i + k) % len(clean)].append(w)
    rows = [(" ".join(rng.sample(terms, len(terms))), 1) for _ in range(40)] + [(" ".join(rng.sample(words, len(words))), 0) for words in clean]
    got, known = tox.learn_lexicon(spark.createDataFrame(rows, "text string, toxic int").repartition(4))
    assert sorted(got) == terms and known == set(near)


def test_held_out_labels_of_the_table(spark):
    """Ranking of the held-out labelled documents of a driver's table: area under the curve, and no clean document over the threshold."""
    root = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{root}/labels.parquet")
    rows = tox.op8_toxicity(spark.read.parquet(f"{root}/documents.parquet"), labels).where("held_out").join(labels, "doc_id").where("toxic IN (0, 1)").collect()
    bad, good = ([r["score"] for r in rows if r["toxic"] == t] for t in (1, 0))
    area = sum((b > g) + 0.5 * (b == g) for b in bad for g in good) / (len(bad) * len(good))
    assert area > 0.85 and sum(b >= 0.7 for b in bad) >= 0.75 * len(bad) and sum(g >= 0.7 for g in good) <= 0.01 * len(good)


def test_repeated_documents_teach_once(spark):
    docs = spark.createDataFrame([(1, "b")] * 50 + [(1, "a"), (2, None), (3, "c")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (3, None), (None, 1)], "doc_id long, toxic int")
    got = sorted(map(tuple, tox.training_rows(docs, labels).collect()))
    held = {d for d in (1, 2, 3) if zlib.crc32(str(d).encode()) % 3 == 1}
    assert got == sorted((t, y) for d, t, y in ((1, "a", 1), (2, "", 0)) if d not in held)
