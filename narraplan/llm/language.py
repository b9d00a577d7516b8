"""Language identification by nearest centroid.

A text becomes counts of its letter n-grams of two to four bytes (a-z and two-byte Latin letters lowered, other
ASCII a gap), hashed to `DIMENSIONS`, damped, weighted by inverse document frequency and scaled to length 1. Each
language has several centroids from spherical k-means. The language of the nearest centroid by cosine is the
prediction and the cosine the score. A text is rejected if it has no letter, or if it has enough n-grams to tell
(2^`BANDS_SHORT` - 1) and lies far outside the distance that texts of its length had in fitting, by a margin.

Fitting uses at most about `sample` texts per language, chosen by a hash of (doc_id, text); k-means runs per language. The
model has 64 kB of centroids a language, whatever the number of texts.
Null, empty and letterless texts are `und` with score 0. Ties go to the language first in order. Repeated rows get
equal results. Without any labelled text all are `und`. Extra columns are kept; results come in one struct column, whose
name the caller gives.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from narraplan.llm.common import blocks, cut, raw, refuse, sized

DIMENSIONS = 4096
BANDS = 24
BANDS_SHORT = 6
_LETTER = regex.compile(r"\p{L}")
_LOWER = np.full(256, 32, np.uint8)
_LOWER[97:123] = np.arange(97, 123)
_LOWER[65:91] = np.arange(97, 123)
_LOWER[128:] = np.arange(128, 256)
_HASH = np.random.default_rng(11).integers(1, 2**31, 4, dtype=np.uint32) | np.uint32(1)


def has_letter(text: str | None) -> bool:
    """Whether a text has a letter: a sign of a Unicode category L. Signs of numbers (½, Ⅷ) are none."""
    return bool(text) and _LETTER.search(text) is not None


def ngram_counts(column: pa.Array) -> np.ndarray:
    """rows x DIMENSIONS counts of n-grams that touch a letter; n-grams don't cross rows."""
    data, off = raw(column)
    rows = len(off) - 1
    b = _LOWER[data]
    if len(b) > 1:
        upper = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        b[1:][upper] += 32
    row = np.repeat(np.arange(rows), np.diff(off))
    out = np.zeros(rows * DIMENSIONS, np.float32)
    code = b.astype(np.uint32)
    gram = code * _HASH[0]
    for size in (2, 3, 4):
        n = len(b) - size + 1
        if n <= 0:
            break
        gram = gram[:n] * np.uint32(0x01000193) + code[size - 1:] * _HASH[size - 1]
        good = (row[:n] == row[size - 1:]) & ((b[:n] != 32) | (b[size - 1:] != 32))
        slot = (gram ^ (gram >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(20)
        out += np.bincount((row[:n] * DIMENSIONS + slot)[good], minlength=len(out)).astype(np.float32)
    return out.reshape(rows, DIMENSIONS)


@dataclass
class Model:
    languages: list[str]  # of each centroid
    centroids: np.ndarray
    idf: np.ndarray
    floor: np.ndarray  # least cosine by band of length

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        x = np.log1p(counts) * self.idf
        return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-12)


def band(counts: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(counts.sum(1) + 1).astype(np.int64), BANDS - 1)


def _kmeans(x: np.ndarray, k: int, rounds: int = 15) -> np.ndarray:
    """Spherical k-means from farthest-first seeds."""
    mean = x.mean(0)
    seeds = [int(np.argmax(x @ mean))]
    while len(seeds) < min(k, len(x)):
        seeds.append(int(np.argmin((x @ x[seeds].T).max(1))))
    c = x[seeds]
    for _ in range(rounds):
        nearest = np.argmax(x @ c.T, axis=1)
        sums = np.array([x[nearest == j].sum(0) if (nearest == j).any() else c[j] for j in range(len(c))])
        c = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return c.astype(np.float32)


def drawn(docs: DataFrame, sample: int) -> DataFrame:
    """(lang, text) of about `sample` distinct (id, text) a language."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    # Copies (same id and text) count once and are drawn once; texts of one id are drawn apart, so a repeated id is no unbounded group.
    key = F.xxhash64(F.col("doc_id").cast("string"), F.col("text"))
    sizes = known.select("lang", key.alias("key")).distinct().groupBy("lang").agg(F.count("*").alias("n"))
    place = F.pmod(key, F.lit(1 << 30))
    # In doubles, as the product of place and n leaves 64 bits from about 2^33 texts of a language on.
    share = F.lit(float(sample << 30)) / F.col("n")
    return known.join(sized(cut(sizes)), "lang").where(place < share).dropDuplicates(["lang", "doc_id", "text"]).select("lang", "text")


def fit(docs: DataFrame, sample: int = 500, clusters: int = 4, margin: float = 0.5) -> Model | None:
    """Learn from docs (doc_id, text, lang) with a lang."""
    some = drawn(docs, sample)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text", 1 << 18, 256):
            keep = np.array([has_letter(t) for t in block.column("text").to_pylist()])
            c = ngram_counts(block.column("text"))[keep]
            if len(c):
                yield pa.record_batch([block.column("lang").filter(pa.array(keep)), pa.array(list(c), pa.list_(pa.float32()))], names=["lang", "counts"])

    counted = some.mapInArrow(count, "lang string, counts array<float>").cache()
    df = counted.select(F.posexplode("counts").alias("at", "n")).where("n > 0").groupBy("at").count().collect()
    total = counted.count()
    if not total:
        return None
    idf = np.zeros(DIMENSIONS, np.float32)
    idf[[r["at"] for r in df]] = [np.log((1 + total) / (1 + r["count"])) + 1 for r in df]

    def cluster(pdf):
        import pandas as pd

        own = Model([], np.zeros(0), idf, np.zeros(0))
        counts = np.array(pdf["counts"].tolist(), np.float32)
        x = own.vectors(counts)
        order = np.lexsort(x[:, np.argsort(-idf, kind="stable")[:8]].T)
        x, counts = x[order], counts[order]
        c = _kmeans(x, clusters)
        best = (x @ c.T).max(1)
        floor = np.full(BANDS, 2.0)
        np.minimum.at(floor, band(counts), best)
        return pd.DataFrame({"lang": pdf["lang"].iloc[0], "centroid": list(c), "floor": [floor] * len(c)})

    got = counted.groupBy("lang").applyInPandas(cluster, "lang string, centroid array<float>, floor array<double>").toPandas()
    counted.unpersist()
    got = got.sort_values("lang", kind="stable")
    floor = np.min(np.array(got["floor"].tolist()), axis=0)
    floor = np.minimum.accumulate(floor[::-1])[::-1]  # shorter texts lie no nearer
    floor = np.where((floor > 1) | (np.arange(BANDS) < BANDS_SHORT), 0, floor) * margin
    return Model(got["lang"].tolist(), np.array(got["centroid"].tolist(), np.float32), idf, floor)


def identified(docs: DataFrame, model: Model | None, result: str = "language") -> DataFrame:
    """docs with a struct column `result`: lang_pred, score and rejected."""
    columns = docs.columns
    refuse(columns, result)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        for rows in batches:
            # Texts come once, inside the row.
            texts = rows.column("_row").field(columns.index("text"))
            yield from (judged(own, block) for block in blocks(iter([rows.append_column("_text", texts)]), "_text", 1 << 19, 256))

    def judged(own: Model | None, block: pa.RecordBatch) -> pa.RecordBatch:
        letter = np.array([has_letter(t) for t in block.column("_text").to_pylist()], bool)
        name, score, out = np.full(len(letter), "und", object), np.zeros(len(letter)), ~letter
        if own is None:
            out[:] = True
        elif letter.any():
            counts = ngram_counts(block.column("_text"))
            near = own.vectors(counts) @ own.centroids.T
            best = near.argmax(1)
            name[letter] = np.array(own.languages, object)[best[letter]]
            score[letter] = np.clip(near.max(1)[letter], 0, 1)
            out |= score < own.floor[band(counts)]
        return pa.record_batch([block.column("_row"), pa.array(name, pa.string()), pa.array(score), pa.array(out)],
                              names=["_row", "lang_pred", "score", "rejected"])

    row = F.struct(*columns).alias("_row")
    schema = f"_row {docs.select(row).schema[0].dataType.simpleString()}, lang_pred string, score double, rejected boolean"
    return docs.select(row).mapInArrow(make, schema).select("_row.*", F.struct("lang_pred", "score", "rejected").alias(result))
