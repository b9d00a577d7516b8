"""Line dedup: two Bloom filters find suspected repeats; only these shuffle, for exact confirmation.

A line's key is the line without white space at its ends, A-Z lowered. Keys of at least `shortest` code points that
occur in at least two documents keep their lines in the smallest doc_id only. Steps:

1. Every task has a pair of Bloom filters over 64-bit hashes of its keys: once-seen and twice-seen. A key of a later
   document that the first filter knows goes into the second. Tasks hand on the filters in compressed segments;
   segments meet by an order-free rule: twice = either twice, or both once. A key of two documents is therefore
   always in the merged second filter, wherever its documents are; a key of one document is there by chance only.
2. With the second filter (broadcast, at most MOST_BITS), a second pass sends suspected keys on: doc_id, the SHA-256 of the
   key, the numbers of its lines. Least and greatest doc_id per digest, aggregated before the shuffle, confirm a key
   and give its keeper. A suspicion by chance ends here.
3. Confirmed digests go back to their documents. Digests of more than one row in HEAVY are broadcast (there are fewer
   than HEAVY), so that no very common line is a hot join key. What comes out is the lines to drop, per document.
4. A third Bloom filter, of documents with lines to drop, lets every other text pass without a shuffle.

Filters have about 12 bits a line (estimated by line ends), up to MOST_BITS. Beyond that, more keys are suspected by
chance and pass to step 2, which stays exact: what grows is its shuffle (about 50 bytes a line), never the result.

A document is a doc_id: rows of one id are parts of the same document, so a key held only by them stays. A null id is
a document after all others. Null and empty texts are one empty line. Extra columns are kept; `n_lines`, `n_dropped` and
`kept` come in one struct column, whose name the caller gives. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from narraplan.llm.common import Spans, blocks, cut, mixed, written

SHORTEST = 10
BITS_A_LINE = 12
PROBES = 4
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 29
SEGMENT = 1 << 20
HEAVY = 4096
_WHITE = np.zeros(256, bool)
_WHITE[[32, 9, 10, 11, 12, 13]] = True
RESULT = "n_lines long, n_dropped long, kept string"
SEGMENTS = "segment long, once binary, twice binary"


class Lines(Spans):
    """Lines of a run of texts: `row` of each, its number in the row, `low` and `high` of its key in the bytes, `points` of it, `hash`."""

    def __init__(self, column: pa.Array):
        super().__init__(column)
        data, off = self.data, self.offsets
        breaks = np.flatnonzero(data == 10)
        # One line starts with each text and one behind each line end.
        row = np.concatenate([np.arange(len(off) - 1), np.searchsorted(off, breaks, "right") - 1])
        start = np.concatenate([off[:-1], breaks + 1])
        order = np.lexsort((start, row))
        self.row, start = row[order], start[order]
        first = np.searchsorted(self.row, np.arange(len(off)))
        self.count = np.diff(first)
        self.number = np.arange(len(start)) - first[self.row]
        end = np.append(start[1:] - 1, self.size) if len(start) else start
        last = self.number == self.count[self.row] - 1
        end[last] = off[self.row[last] + 1]
        solid = np.flatnonzero(~_WHITE[data])
        a, b = np.searchsorted(solid, start), np.searchsorted(solid, end)
        some = b > a
        self.low, self.high = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
        self.low[some], self.high[some] = solid[a[some]], solid[b[some] - 1] + 1
        leads = np.append(0, np.cumsum((data & 0xC0) != 0x80))
        self.points = leads[self.high] - leads[self.low]
        self.hash = self.spans(self.low, self.high)

    def digest(self, at: int) -> bytes:
        """SHA-256 of a line's key, whose only change of bytes is that of A-Z."""
        return hashlib.sha256(self.data[self.low[at]:self.high[at]].tobytes().lower()).digest()


class Filter:
    """A Bloom filter of 2^k bits, one word of a uint64 array holding 64 of them."""

    def __init__(self, bits: int, words: np.ndarray | None = None, probes: int = PROBES):
        self.bits, self.probes = bits, probes
        self.words = np.zeros(bits // 64, np.uint64) if words is None else words

    def _places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        step = mixed(hashes) | np.uint64(1)
        at = (hashes[:, None] + step[:, None] * np.arange(self.probes, dtype=np.uint64)) & np.uint64(self.bits - 1)
        return (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63))

    def add(self, hashes: np.ndarray) -> None:
        word, bit = self._places(hashes)
        np.bitwise_or.at(self.words, word.ravel(), bit.ravel())

    def has(self, hashes: np.ndarray) -> np.ndarray:
        word, bit = self._places(hashes)
        return ((self.words[word] & bit) != 0).all(1)


def tell_twice(once: Filter, twice: Filter, hashes: np.ndarray) -> None:
    """Note a run's hashes, one of each row that has it: those seen before, here or earlier, go into the second filter."""
    keys, rows = np.unique(hashes, return_counts=True)
    twice.add(keys[(rows > 1) | once.has(keys)])
    once.add(keys)


def segments(once: Filter, twice: Filter) -> Iterator[pa.RecordBatch]:
    size = min(SEGMENT, once.bits) // 64
    for k in range(0, len(once.words), size):
        a, b = once.words[k:k + size], twice.words[k:k + size]
        if a.any():
            yield pa.record_batch({"segment": pa.array([k // size], pa.int64()), "once": pa.array([zlib.compress(a.tobytes(), 1)], pa.binary()),
                                   "twice": pa.array([zlib.compress(b.tobytes(), 1)], pa.binary())})


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments sorted by number become one each: twice = either twice, or both once."""
    at, once, twice = None, None, None

    def out():
        return pa.record_batch({"segment": pa.array([at], pa.int64()), "twice": pa.array([twice.tobytes()], pa.binary())})

    for batch in batches:
        for k, a, b in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
            a, b = (np.frombuffer(zlib.decompress(x.as_buffer()), np.uint64) for x in (a, b))
            if k != at:
                if at is not None:
                    yield out()
                at, once, twice = k, a, b
            else:
                twice = twice | b | (once & a)
                once = once | a
    if at is not None:
        yield out()


def filter_bits(lines: int, most: int | None = None) -> int:
    return max(LEAST_BITS, min(most or MOST_BITS, 1 << max(1, int(lines * BITS_A_LINE) - 1).bit_length()))


def _long(lines: Lines, shortest: int) -> np.ndarray:
    """Places of the lines whose keys are long enough."""
    return np.flatnonzero(lines.points >= max(shortest, 1))


def merged_words(parts: DataFrame, bits: int) -> np.ndarray:
    """Words of the merged second filter, at most MOST_BITS, from the segments of all tasks."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _merge(batches):
            packed = [zlib.compress(x.as_buffer(), 1) for x in batch.column("twice")]
            yield pa.record_batch({"segment": batch.column("segment"), "twice": pa.array(packed, pa.binary())})

    whole = parts.repartition("segment").sortWithinPartitions("segment").mapInArrow(merge, "segment long, twice binary")
    words = np.zeros(bits // 64, np.uint64)
    size = min(SEGMENT, bits) // 64
    for r in whole.collect():
        words[r["segment"] * size:(r["segment"] + 1) * size] = np.frombuffer(zlib.decompress(r["twice"]), np.uint64)
    return words


def own_words(marks: DataFrame, bits: int) -> DataFrame:
    """Segments of the tasks' Bloom filters over a column of 64-bit marks."""

    def note(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Filter(bits)
        for batch in batches:
            known.add(batch.column(0).to_numpy().view(np.uint64))
        yield from segments(known, known)

    return marks.mapInArrow(note, SEGMENTS)


def twice_seen(docs: DataFrame, bits: int, shortest: int) -> np.ndarray:
    """Words of a Bloom filter that has every key of two or more rows."""

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = Filter(bits), Filter(bits)
        for block in blocks(batches, "text"):
            lines = Lines(block.column("text"))
            use = _long(lines, shortest)
            order = use[np.lexsort((lines.row[use], lines.hash[use]))]
            h, row = lines.hash[order], lines.row[order]
            other = np.append(True, h[1:] != h[:-1])[:len(h)]
            again = ~other & np.append(True, row[1:] != row[:-1])[:len(h)]
            keys = h[other]
            twice.add(h[again])
            twice.add(keys[once.has(keys)])
            once.add(keys)
        yield from segments(once, twice)

    return merged_words(docs.select("text").mapInArrow(seen, SEGMENTS), bits)


def suspects(docs: DataFrame, words: np.ndarray, bits: int, shortest: int) -> DataFrame:
    """(doc_id, text_hash, digest, numbers) of keys that the filter knows: one row per key of a row of docs."""
    held = docs.sparkSession.sparkContext.broadcast(words)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Filter(bits, held.value)
        for block in blocks(batches, "text"):
            lines = Lines(block.column("text"))
            use = _long(lines, shortest)
            use = use[known.has(lines.hash[use])] if len(use) else use
            order = np.lexsort((lines.number[use], lines.hash[use], lines.row[use]))
            use = use[order]
            h, row = lines.hash[use], lines.row[use]
            edge = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (row[1:] != row[:-1]))) if len(use) else np.zeros(0, np.int64)
            upto = np.append(edge, len(use))
            at = pa.array(row[edge])
            yield pa.record_batch({
                "doc_id": block.column("doc_id").take(at), "text_hash": block.column("text_hash").take(at),
                "digest": pa.array([lines.digest(k) for k in use[edge].tolist()], pa.binary()),
                "numbers": pa.ListArray.from_arrays(pa.array(upto, pa.int32()), pa.array(lines.number[use], pa.int64()))})

    return docs.select("doc_id", "text", "text_hash").mapInArrow(make, "doc_id long, text_hash binary, digest binary, numbers array<long>")


def lines_to_drop(docs: DataFrame, shortest: int = SHORTEST) -> DataFrame:
    """(doc_id, text_hash, numbers): which lines of a text go, from docs (doc_id, text, text_hash)."""
    n_lines = F.coalesce(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))), F.lit(0)) + 1
    bits = filter_bits(docs.agg(F.sum(n_lines)).first()[0] or 0)
    rows = written(suspects(docs, twice_seen(docs, bits, shortest), bits, shortest), "suspects")
    last = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id")
    keys = rows.groupBy("digest").agg(F.min(last).alias("first"), F.max(last).alias("last"), F.count("*").alias("n"))
    keys = cut(keys.where(F.col("first") != F.col("last")).select("digest", "first", "n"))
    least = max(1, rows.count() // HEAVY)
    heavy = F.broadcast(keys.where(F.col("n") > least).select(F.col("digest").alias("common"), F.col("first").alias("keeper")))
    marked = rows.join(heavy, F.col("digest") == F.col("common"), "left")
    known = marked.where("common is not null").select("doc_id", "text_hash", "numbers", F.col("keeper").alias("first"))
    others = marked.where("common is null").join(keys.where(F.col("n") <= least).drop("n"), "digest")
    gone = known.unionByName(others.select("doc_id", "text_hash", "numbers", "first")).where(last != F.col("first"))
    # Copies of a row have the same lines to drop; a list holds lines of one text only.
    return cut(gone.groupBy("doc_id", "text_hash").agg(F.flatten(F.collect_set("numbers")).alias("numbers")))


def _finished(block: pa.RecordBatch, drops: list[list[int] | None]) -> pa.RecordBatch:
    total, dropped, kept = [], [], []
    for text, drop in zip(block.column("text").to_pylist(), drops):
        text = text or ""
        total.append(text.count("\n") + 1)
        dropped.append(len(drop or ()))
        if drop:
            gone = set(drop)
            text = "\n".join([x for k, x in enumerate(text.split("\n")) if k not in gone])
        kept.append(text)
    return pa.record_batch({"others": block.column("others"), "text": block.column("text"), "n_lines": pa.array(total, pa.int64()),
                            "n_dropped": pa.array(dropped, pa.int64()), "kept": pa.array(kept, pa.string())})


def without_repeats(docs: DataFrame, result: str = "lines", shortest: int = SHORTEST) -> DataFrame:
    """docs with a struct column `result`: n_lines, n_dropped, and kept, the text without repeated lines."""
    columns = docs.columns
    if result in columns:
        raise ValueError(f"documents have a column {result}: give `result` another name")
    others = F.struct(F.lit(0), *[c for c in columns if c != "text"])
    keyed = docs.select(others.alias("others"), F.col("doc_id").cast("long").alias("doc_id"), "text",
                        F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("text_hash"))
    drops = lines_to_drop(keyed.select("doc_id", "text", "text_hash"), shortest)
    bits = filter_bits(drops.count())
    mark = F.xxhash64(F.coalesce("doc_id", F.lit(-1)), "text_hash").alias("mark")

    held = docs.sparkSession.sparkContext.broadcast(merged_words(own_words(drops.select(mark), bits), bits))

    def parted(batches: Iterator[pa.RecordBatch], hit: bool) -> Iterator[pa.RecordBatch]:
        known = Filter(bits, held.value)
        for batch in batches:
            yield batch.filter(pa.array(known.has(batch.column("mark").to_numpy().view(np.uint64)) == hit))

    def touched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parted(batches, True):
            yield batch.drop_columns(["mark"])

    def untouched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(parted(batches, False), "text"):
            yield _finished(block, [None] * block.num_rows)

    def mend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text"):
            yield _finished(block, block.column("numbers").to_pylist())

    rest = keyed.schema["others"].dataType.simpleString()
    out = f"others {rest}, text string, {RESULT}"
    clean = keyed.select("others", "text", mark).mapInArrow(untouched, out)
    some = keyed.select("others", "doc_id", "text", "text_hash", mark).mapInArrow(
        touched, f"others {rest}, doc_id long, text string, text_hash binary")
    same = some["doc_id"].eqNullSafe(drops["doc_id"]) & (some["text_hash"] == drops["text_hash"])
    mended = some.join(drops, same, "left").select("others", "text", "numbers").mapInArrow(mend, out)
    whole = clean.unionByName(mended)
    return whole.select(*[F.col("text") if c == "text" else F.col(f"others.`{c}`") for c in columns],
                        F.struct("n_lines", "n_dropped", "kept").alias(result))


ORACLE = r"""
with lines as (
  select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as seq
  from documents),
keyed as (
  select doc_id, line, seq, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from lines),
repeats as (
  select key, min(doc_id) as keeper from keyed where length(key) >= 10 group by key having count(distinct doc_id) >= 2),
marked as (select k.*, r.key is not null and doc_id != keeper as gone from keyed k left join repeats r on k.key = r.key)
select doc_id, count(*)::bigint as n_lines, count(*) filter (gone)::bigint as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by seq) filter (not gone), '')) as kept_sha256
from marked group by doc_id
"""
