"""Toxicity by a weighted lexicon, matched with Aho-Corasick on folded text.

Folding lowers a text, turns homoglyphs and digit or sign substitutions into the letters they stand for, drops signs
that end a word, and leaves words apart by one space. The lexicon is learned from labelled documents: words and
beginnings of words (stems, written with a '*' behind) whose document counts are far from chance (G2) and much likelier
in toxic ones, weighted by their log odds; of terms that contain one another the one farthest from chance stays. Word pairs with
a lexicon word that labelled documents show to be harmless are exception phrases: a match inside one doesn't count.
A document's matched weight, whole and per length, goes through a logistic curve fitted on the same documents.

Fitting uses at most `sample` labelled documents, in order of a hash of (doc_id, text); their keys, at most that many, are
broadcast. Scoring reads nothing but the text. Null and empty texts have no match and get the score of such.
Repeated rows score alike. Labels of unknown documents and null labels are ignored; without labels of both kinds
nothing is learned and every score is 0. Extra columns are kept; results come in one struct column, whose name the
caller gives.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from narraplan.llm.common import blocks, cut, refuse

# Letters that look like a-z, and the letters that digits and signs stand for.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "е": "e", "ѕ": "s", "і": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o",
    "р": "p", "т": "t", "у": "y", "х": "x", "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o",
    "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɡ": "g", "ⅼ": "l", "ⅰ": "i",
}
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i"}

_HIDDEN = {ord(c): None for c in "­​‌‍⁠﻿"}
_WIDE = {0xFF01 + k: chr(0x21 + k).lower() for k in range(94)}
_TABLE = (
    {ord(c): " " for c in map(chr, range(128)) if not c.isalnum()} | _HIDDEN | _WIDE
    | {ord(k): v for k, v in (HOMOGLYPHS | SUBSTITUTES).items()}
)
STEMS = range(3, 8)
_ENDING = re.compile(r"[$@!]+(?!\w)")


def folded(text: str) -> str:
    """Words in folded form, one space around each."""
    text = text.lower()
    if "$" in text or "!" in text or "@" in text:
        text = _ENDING.sub(" ", text)
    return f" {' '.join(text.translate(_TABLE).split())} "


def terms_of(word: str) -> list[str]:
    """The word and its stems, which are shorter than it."""
    return [word, *(word[:k] + "*" for k in STEMS if k < len(word))]


def _apart(ranked: list[tuple[str, float]], size: int) -> dict[str, float]:
    """The first `size` terms of a ranking that neither begin with a stem before them nor are the beginning of a term before them."""
    kept: dict[str, float] = {}
    within: set[str] = set()
    for term, weight in ranked:
        if len(kept) == size:
            break
        stem = term.rstrip("*")
        if term in within or any(stem[:k] + "*" in kept for k in STEMS if k <= len(stem)):
            continue
        kept[term] = weight
        within.update(terms_of(stem))
    return kept


@dataclass
class Lexicon:
    weights: dict[str, float] = field(default_factory=dict)
    exceptions: frozenset[str] = frozenset()
    curve: tuple[float, float, float] = (-40.0, 0.0, 0.0)

    def matcher(self):
        import ahocorasick

        machine = ahocorasick.Automaton()
        for phrase in self.exceptions:
            machine.add_word(f" {phrase} ", (len(phrase) + 2, 0.0))
        for term, weight in self.weights.items():
            form = f" {term[:-1]}" if term.endswith("*") else f" {term} "
            machine.add_word(form, (len(form), weight))
        if len(machine):
            machine.make_automaton()
        return machine

    def features(self, machine, text: str | None) -> tuple[float, float]:
        """Matched weight and the same per 100 words, both damped."""
        text = folded(text or "")
        total = 0.0
        if len(machine):
            found = [(end - size + 1, end, weight) for end, (size, weight) in machine.iter(text)]
            safe = [(a, b) for a, b, w in found if not w]
            total = sum(w for a, b, w in found if w and not any(x <= a and b <= y for x, y in safe))
        return float(np.log1p(total)), float(np.log1p(100 * total / max(1, text.count(" ") - 1)))

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.curve[0] + x @ np.array(self.curve[1:]), -40, 40)))


def _curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Logistic regression by Newton steps, lightly held back."""
    design = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -40, 40)))
        hess = (design * (p * (1 - p))[:, None]).T @ design + 0.1 * np.eye(3)
        step = np.linalg.solve(hess, design.T @ (y - p) - 0.1 * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return tuple(float(v) for v in w)


def labelled(docs: DataFrame, labels: DataFrame, keep, sample: int) -> DataFrame:
    """(text, toxic) of at most `sample` distinct labelled (id, text) that `keep` admits, one label an id."""
    own = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).where(keep).groupBy(
        F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("key", F.xxhash64("doc_id", "text"))
    # Drawn by id and text, as one id can have any number of rows; only keys are joined and sorted.
    chosen = cut(texts.select("doc_id", "key").distinct().join(own, "doc_id").orderBy(F.xxhash64("key"), "doc_id").limit(sample))
    return texts.join(F.broadcast(chosen), ["doc_id", "key"]).dropDuplicates(["doc_id", "key"]).select("text", "toxic")


def fit(docs: DataFrame, labels: DataFrame, keep, sample: int = 20_000, size: int = 2_000, least_g2: float = 30.0,
        exceptions: tuple[str, ...] = ()) -> Lexicon:
    """Learn a lexicon of at most `size` terms, its exceptions and the curve. keep: condition on labels' doc_id."""
    rows = cut(labelled(docs, labels, keep, sample))  # read three times, and bounded

    def count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text"):
            bad, good = Counter(), Counter()
            for text, toxic in zip(block.column("text").to_pylist(), block.column("toxic").to_pylist()):
                (bad if toxic else good).update({t for word in set(folded(text or "").split()) for t in terms_of(word)})
                (bad if toxic else good)[""] += 1
            terms = list(bad | good)
            yield pa.record_batch({"term": pa.array(terms, pa.string()), "bad": pa.array([bad[t] for t in terms], pa.int64()),
                                   "good": pa.array([good[t] for t in terms], pa.int64())})

    counts = rows.mapInArrow(count_terms, "term string, bad long, good long").groupBy("term").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    total = counts.where("term = ''").first()
    if total is None or not total["bad"] or not total["good"]:
        return Lexicon(exceptions=frozenset(exceptions))
    bad_all, good_all = float(total["bad"]), float(total["good"])
    odds = F.log((F.col("bad") + 0.5) / (bad_all + 1)) - F.log((F.col("good") + 0.5) / (good_all + 1))

    def part(n, expected):
        return F.when(n > 0, n * F.log(n / expected)).otherwise(0.0)

    n = F.col("bad") + F.col("good")
    share = bad_all / (bad_all + good_all)
    g2 = 2 * (part(F.col("bad"), n * share) + part(F.col("good"), n * (1 - share)))
    best = counts.where("term != ''").withColumn("odds", odds).withColumn("g2", g2).where((F.col("odds") > 1.5) & (F.col("g2") >= least_g2))
    # A term has at most len(STEMS) stems, so so many times `size` leave enough after _apart or are all there are.
    ranked = best.orderBy(F.desc("g2"), F.col("term").endswith("*"), F.desc(F.length("term")), "term").limit(size * (len(STEMS) + 1)).collect()
    weights = _apart([(r["term"], float(r["odds"])) for r in ranked], size)

    def count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text"):
            bad, good = Counter(), Counter()
            for text, toxic in zip(block.column("text").to_pylist(), block.column("toxic").to_pylist()):
                words = folded(text or "").split()
                at = {k for k, w in enumerate(words) if any(t in weights for t in terms_of(w))}
                pairs = {" ".join(words[a:a + 2]) for k in at for a in (k - 1, k) if 0 <= a < len(words) - 1}
                (bad if toxic else good).update(pairs)
            terms = list(bad | good)
            yield pa.record_batch({"term": pa.array(terms, pa.string()), "bad": pa.array([bad[t] for t in terms], pa.int64()),
                                   "good": pa.array([good[t] for t in terms], pa.int64())})

    pairs = rows.mapInArrow(count_pairs, "term string, bad long, good long").groupBy("term").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    safe = pairs.where("good >= 3 and good >= 9 * bad").orderBy(F.desc("good"), "term").limit(size).collect()
    learned = Lexicon(weights, frozenset([*(r["term"] for r in safe), *(folded(e).strip() for e in exceptions)]))
    data = rows.mapInArrow(_features(learned), "a double, b double, toxic int").toPandas()
    learned.curve = _curve(data[["a", "b"]].to_numpy(), data["toxic"].to_numpy(float))
    return learned


def _features(lexicon: Lexicon):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = lexicon.matcher()
        for block in blocks(batches, "text"):
            x = np.array([lexicon.features(machine, t) for t in block.column("text").to_pylist()]).reshape(-1, 2)
            yield pa.record_batch([pa.array(x[:, 0]), pa.array(x[:, 1]), block.column("toxic")], names=["a", "b", "toxic"])

    return make


def scored(docs: DataFrame, lexicon: Lexicon, result: str = "toxicity") -> DataFrame:
    """docs with a struct column `result`: score and predicted (1 from 0.5)."""
    columns = docs.columns
    refuse(columns, result)
    held = docs.sparkSession.sparkContext.broadcast(lexicon)
    at = columns.index("text")  # texts come once, inside the row

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        machine = own.matcher()
        for block in (b for rows in batches for b in blocks(iter([rows.append_column("_text", rows.column("_row").field(at))]), "_text")):
            x = np.array([own.features(machine, t) for t in block.column("_text").to_pylist()]).reshape(-1, 2)
            p = own.score(x)
            yield pa.record_batch([block.column("_row"), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=["_row", "score", "predicted"])

    row = F.struct(*columns).alias("_row")
    schema = f"_row {docs.select(row).schema[0].dataType.simpleString()}, score double, predicted int"
    return docs.select(row).mapInArrow(make, schema).select("_row.*", F.struct("score", "predicted").alias(result))
