"""Toxicity: a learned lexicon, matched with misspellings, scored by the words around each match.

The lexicon is a trie. A Levenshtein automaton per term, run over the trie as one automaton whose
states are sets of (node, edits), accepts all words within one edit of a term (two edits for long terms). Each match
gets a context score from the quotation marks and the reporting words near it, which tells quoted
from direct use; a logistic model makes a document's score of the matches.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.llm.scratch import bounded_batches, saved

#: Labelled rows that the lexicon and the model are fitted on, at most; the ones with the least hash of doc_id.
FIT_ROWS = 10_000
THRESHOLD = 0.7

WORD = re.compile(r"[^\W_]+(?:[@$!*'][^\W_]+)*|[@$][^\W_]+")
SPACED_WORD = re.compile(r"[^\x20\x09-\x0D]+")
CONTEXT = 90  # characters on each side that can hold quotation marks or reporting words
#: Look-alike characters and what they stand for; quotation marks; words that report what others say.
LOOK_ALIKE = str.maketrans("013457@$!", "oieastasi")
OPENING, CLOSING = "\"“«„‘", "\"”»“’"
REPORTING = frozenset(
    "called calls calling cited cites mentioned phrase quote quoted quotes quoting reported said saying says shouted slur term translated word words wrote writes "
    "appelé cite citation cité disait dit écrit mot terme citado cita dice dijo escribió palabra término begriff genannt sagte schrieb wort zitat zitiert".split()
)
#: What the model holds before it has seen a label: bias, direct, misspelt, quoted, distinct terms, density.
PRIOR = np.array([-3.0, 3.0, 3.2, 0.3, 1.0, 0.5])
PRIOR_STRENGTH = np.array([0.05, 0.05, 0.6, 1.0, 0.3, 0.3])


def edits_allowed(term: str) -> int:
    """Return how many edits of a term still count: none under 5 letters, one under 10, else two."""
    return 0 if len(term) < 5 else 1 if len(term) < 10 else 2


@dataclass
class Node:
    next: dict[str, int] = field(default_factory=dict)
    term: str | None = None
    allowed: int = 0  # edits allowed to any term below


class Lexicon:
    """The trie of all terms with its automaton, which is built state by state as words ask for it."""

    #: States and transitions kept; beyond, the automaton starts anew.
    MOST_KEPT = 200_000

    def __init__(self, terms: list[str]):
        self.nodes = [Node()]
        for term in terms:
            at = 0
            for c in term:
                self.nodes[at].allowed = max(self.nodes[at].allowed, edits_allowed(term))
                if c not in self.nodes[at].next:
                    self.nodes.append(Node())
                    self.nodes[at].next[c] = len(self.nodes) - 1
                at = self.nodes[at].next[c]
            self.nodes[at].term, self.nodes[at].allowed = term, max(self.nodes[at].allowed, edits_allowed(term))
        self._clear()

    def _clear(self) -> None:
        self.start = self._closed({0: 0})
        self.steps: dict[tuple, tuple] = {}
        self.words: dict[str, tuple[str, int] | None] = {}

    def _closed(self, state: dict[int, int]) -> tuple:
        """Add what leaving out letters of terms reaches; state: trie node -> fewest edits."""
        todo = list(state)
        while todo:
            node = todo.pop()
            for child in self.nodes[node].next.values():
                edits = state[node] + 1
                if edits <= self.nodes[child].allowed and edits < state.get(child, 99):
                    state[child] = edits
                    todo.append(child)
        return tuple(sorted(state.items()))

    def _step(self, state: tuple, c: str) -> tuple:
        out: dict[int, int] = {}

        def reach(node: int, edits: int) -> None:
            if edits <= self.nodes[node].allowed and edits < out.get(node, 99):
                out[node] = edits

        for node, edits in state:
            reach(node, edits + 1)  # c is too much
            for letter, child in self.nodes[node].next.items():
                reach(child, edits + (letter != c))
        return self._closed(out)

    def match(self, word: str) -> tuple[str, int] | None:
        """Return the nearest term within its allowed edits and the edits, or None; the first letter, if not left out, may differ too."""
        if word in self.words:
            return self.words[word]
        state = self.start
        for c in word:
            key = (state, c)
            if key not in self.steps:
                if len(self.steps) + len(self.words) > self.MOST_KEPT:
                    self._clear()
                self.steps[key] = self._step(state, c)
            state = self.steps[key]
            if not state:
                break
        found = [(edits, self.nodes[n].term) for n, edits in state if self.nodes[n].term and edits <= edits_allowed(self.nodes[n].term)]
        best = min(found) if found else None
        if len(self.words) > self.MOST_KEPT:
            self.words.clear()
        self.words[word] = (best[1], best[0]) if best else None
        return self.words[word]

    def find(self, word: str) -> tuple[str, int] | None:
        """Match a lower-case word as written, else with look-alike characters replaced, which counts as one edit."""
        found = self.match(word)
        if found is None and not word.isalpha():
            plain = self.match(word.translate(LOOK_ALIKE).replace("'", ""))
            found = (plain[0], max(1, plain[1])) if plain else None
        return found


def is_quoted(text: str, start: int, end: int) -> bool:
    """Tell whether a match stands between quotation marks on its line, or beside a reporting word."""
    left = text[max(0, start - CONTEXT) : start].rpartition("\n")[2]
    right = text[end : end + CONTEXT].partition("\n")[0]
    for a, b in zip(OPENING, CLOSING, strict=True):
        inside = left.count(a) % 2 == 1 if a == b else left.rfind(a) > left.rfind(b)
        if inside and b in right:
            return True
    near = WORD.findall(left.lower())[-4:] + WORD.findall(right.lower())[:2]
    return any(w in REPORTING for w in near)


def document_features(text: str, lexicon: Lexicon, known: frozenset[str]) -> list[float] | None:
    """Return the model's inputs for a text, or None if nothing matches. known: clean words that are no misspellings."""
    lower = text.lower()
    if len(lower) != len(text):  # a few letters grow in lower case, and positions must stay
        lower = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    hits = {}
    for word in set(WORD.findall(lower)):
        found = lexicon.find(word)
        if found and not (found[1] and word in known):
            hits[word] = found
    if not hits:
        return None
    direct = misspelt = quoted = words = 0
    terms = set()
    for m in WORD.finditer(lower):
        words += 1
        found = hits.get(m[0])
        if found:
            if is_quoted(text, m.start(), m.end()):
                quoted += 1
            else:
                terms.add(found[0])
                if found[1]:
                    misspelt += 1
                else:
                    direct += 1
    return [1.0, min(1, direct) + math.log1p(direct), min(1, misspelt) + math.log1p(misspelt), math.log1p(quoted), math.log1p(max(0, len(terms) - 1)), math.log1p(100 * (direct + misspelt) / words)]


def fit_logistic(x: np.ndarray, y: np.ndarray, prior: np.ndarray = PRIOR, strength: np.ndarray = PRIOR_STRENGTH) -> np.ndarray:
    """Fit weights by Newton's method, drawn to the prior where labels say little."""
    w = prior.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + strength * (w - prior)
        hessian = (x * (p * (1 - p))[:, None]).T @ x + np.diag(strength)
        step = np.linalg.solve(hessian, gradient)
        w -= step * min(1.0, 3.0 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-8:
            break
    return w


def held_out(doc_id: Column) -> Column:
    """True for the documents whose labels are never learnt from; a null doc_id counts as held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(True))


def training_rows(documents: DataFrame, labels: DataFrame, most: int = FIT_ROWS) -> DataFrame:
    """Return text and toxic (0 or 1) of the labelled rows to learn from: at most so many label rows by hash of doc_id, each once.

    Rows of documents that share a doc_id give one row, with the least text; null texts count as empty.
    """
    known = labels.select(F.col("doc_id").alias("_id"), F.col("toxic").cast("int").alias("toxic")).where(F.col("toxic").isin(0, 1) & ~held_out(F.col("_id")))
    chosen = known.distinct().orderBy(F.xxhash64("_id"), "_id", "toxic").limit(most)
    rows = documents.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))
    return rows.groupBy("_id", "toxic").agg(F.min(F.coalesce("text", F.lit(""))).alias("text")).select("text", "toxic")


def learn_lexicon(rows: DataFrame) -> tuple[list[str], frozenset[str]]:
    """Learn the words of toxic documents, and the clean words that lie within an edit of them.

    A word's evidence is the number of different documents it is in, near copies counted once (by
    the least hash of their five-word sequences), as a likelihood ratio against the share of toxic
    documents; it must outweigh what the best of all words would reach by chance in one corpus of twenty.
    All words that do are terms, and all clean words near them are returned; the rows, FIT_ROWS at most, bound both.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, toxic in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                lower = text.as_py().lower()
                parts = SPACED_WORD.findall(lower)
                group = min((xxhash.xxh3_64_intdigest(" ".join(parts[i : i + 5])) for i in range(max(1, len(parts) - 4))), default=0) >> 1
                words = list(set(WORD.findall(lower)))
                n = len(words)
                yield pa.record_batch([pa.array(words, pa.string()), pa.array([toxic] * n, pa.int32()), pa.array([group] * n, pa.int64())], names=["word", "toxic", "seen"])

    words = rows.mapInArrow(run, "word string, toxic int, seen long")
    words = words.where(F.char_length("word").between(3, 40)).groupBy("word", "seen").agg(F.max("toxic").alias("toxic"))
    counts = words.groupBy("word").agg(F.sum("toxic").cast("long").alias("t"), F.sum(1 - F.col("toxic")).cast("long").alias("c"))
    counts = saved(counts, "words")
    groups = rows.groupBy("toxic").count().collect()
    n = {r["toxic"]: r["count"] for r in groups}
    toxic, clean = n.get(1, 0), n.get(0, 0)
    if not toxic or not clean:
        return [], frozenset()
    base = toxic / (toxic + clean)
    share = (F.col("t") + 0.5) / (F.col("t") + F.col("c") + 1.0)
    gain = F.col("t") * F.log(share / base) + F.col("c") * F.log((1 - share) / (1 - base))
    chance = F.lit(math.log(max(counts.count(), 1)) + math.log(20.0))
    best = counts.where((share > 0.6) & (gain > chance)).orderBy(gain.desc(), "word").collect()
    terms = [r["word"] for r in best]
    if not terms:
        return [], frozenset()
    # Words near a term that clean documents use, all of them: one left out would count as a misspelt term everywhere.
    trie = Lexicon(terms)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [w for w in batch.column(0).to_pylist() if (found := trie.match(w)) and found[1]]
            yield pa.record_batch([pa.array(keep, pa.string())], names=["word"])

    clean_words = counts.where((F.col("c") >= 2) & (F.col("t") <= F.col("c"))).select("word").mapInArrow(near, "word string").collect()
    return terms, frozenset(r["word"] for r in clean_words)


@dataclass
class Model:
    terms: list[str]
    known: frozenset[str]
    weights: np.ndarray


def _features(rows: DataFrame, terms: list[str], known: frozenset[str], keep: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(terms)
        for batch in batches:
            found = [document_features(t.as_py() or "", lexicon, known) for t in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array(found, pa.list_(pa.float64()))], names=[keep, "found"])

    return rows.mapInArrow(run, f"{keep} long, found array<double>")


def fit(documents: DataFrame, labels: DataFrame, most: int = FIT_ROWS) -> Model:
    """Fit lexicon and weights on labelled rows that are not held out. Without labels of both kinds nothing is toxic."""
    bounded_batches(documents.sparkSession)
    rows = saved(training_rows(documents, labels, most), "toxic-train")
    terms, known = learn_lexicon(rows)
    found = _features(rows.select(F.col("toxic").cast("long").alias("toxic"), "text"), terms, known, "toxic").collect()
    x = np.array([r["found"] or [1.0, 0, 0, 0, 0, 0] for r in found], dtype=float).reshape(-1, len(PRIOR))
    y = np.array([r["toxic"] for r in found], dtype=float)
    return Model(terms, known, fit_logistic(x, y) if len(y) else PRIOR)


def score(documents: DataFrame, model: Model) -> DataFrame:
    """Return doc_id and score for every row, from its whole text; null texts count as empty."""
    rows = _features(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model.terms, model.known, "doc_id")
    bias, *weights = (float(w) for w in model.weights)
    z = F.lit(bias)
    for i, w in enumerate(weights, 1):
        z = z + F.lit(w) * F.col("found")[i]
    p = lambda v: 1 / (1 + F.exp(-v))
    return rows.select("doc_id", F.when(F.col("found").isNull(), p(F.lit(bias))).otherwise(p(z)).alias("score"))


def without_toxic(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Drop the documents that score the threshold or more; all others stay as they are, with all columns.

    Null and empty texts hold no term and stay, as do rows without doc_id; repeated rows are scored alike.
    """
    model = fit(documents, labels)
    bias, *weights = (float(w) for w in model.weights)
    terms, known = model.terms, model.known

    @F.pandas_udf("double")
    def toxic_score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        lexicon = Lexicon(terms)
        for part in texts:
            found = [document_features(t or "", lexicon, known) for t in part]
            yield pd.Series([1 / (1 + math.exp(-(bias + (sum(w * v for w, v in zip(weights, f[1:], strict=True)) if f else 0.0)))) for f in found], dtype=float)

    return documents.where(toxic_score(F.coalesce("text", F.lit(""))) < threshold)


def op8_toxicity(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Score every document; labels of held-out documents are never read into the model."""
    scores = score(documents, fit(documents, labels))
    return scores.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
