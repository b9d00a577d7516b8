"""Document fingerprints: a Merkle tree over sections, paragraphs and segments.

Blank lines part sections, line ends part paragraphs, and words whose hash falls on a step part segments of about
`STEP` words, wherever they stand; none is longer than `LONGEST` words, and a text's first `OPENING` stand alone. A segment's hash covers its exact bytes with the space behind it, a paragraph's
its segments, a section's its paragraphs, the root its sections. A fingerprint is written as the root in hex, then the segments'
codes (24 bits in four letters) with ':' between paragraphs and '/' between sections, so that the tree can be rebuilt:
equal roots mean equal texts; `differing` goes down where branches differ and names the segments. `likeness` is
2 |common segments| / (all segments), 1 for equal roots.

Null and empty texts have the same fingerprint. The next document follows in order of doc_id, null first, equal ids
by text; after the last comes the first; a lone document follows itself. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from narraplan.llm.common import Words, blocks, mixed, written

STEP = 6
LONGEST = 24
OPENING = 8
_SIGNS = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_", np.uint8)
_COLUMNS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _folded(values: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """Hash of each run of values that starts at an edge; order counts."""
    if not len(edge):
        return np.zeros(0, np.uint64)
    at = np.arange(len(values)) - np.repeat(edge, np.diff(np.append(edge, len(values))))
    return mixed(np.add.reduceat(mixed(values + at.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)), edge) + np.uint64(1))


def trees(texts: list[str]) -> list[tuple[str, np.ndarray]]:
    """(fingerprint, segment codes) of each text."""
    words = Words(pa.array(texts, pa.large_string()), fold=False)
    gap_from, gap_to = words.end, np.append(words.start[1:], words.size)
    lines = np.append(0, np.cumsum(words.data == 10))
    ends = lines[gap_to] - lines[gap_from]
    first = np.zeros(len(words.hash) + 1, bool)
    first[words.first] = True
    first = first[:len(words.hash)]
    after = np.append(0, ends[:-1]) if len(ends) else ends
    section, paragraph = first | (after > 1), first | (after > 0)
    cut = paragraph | np.append(False, words.hash[:-1] % np.uint64(STEP) == 0)[:len(first)]
    at = np.arange(len(cut))
    cut |= at - np.repeat(words.first[:-1], np.diff(words.first)) <= OPENING
    since = at - np.maximum.accumulate(np.where(cut, at, 0))
    cut |= (since > 0) & (since % LONGEST == 0)
    edge = np.flatnonzero(cut)
    rows = len(texts)
    owner = np.searchsorted(words.first, edge, "right") - 1
    # A segment runs to the next one's first word; a text's first also takes the space before it.
    start = words.start[edge].copy()
    opens = np.append(True, owner[1:] != owner[:-1])[:len(edge)]
    start[opens] = words.offsets[owner[opens]]
    stop = np.minimum(np.append(start[1:], words.size)[:len(edge)], words.offsets[owner + 1])
    leaf = words.spans(start, stop)
    code = leaf & np.uint64(0xFFFFFF)
    letters = _SIGNS[((code[:, None] >> np.array([18, 12, 6, 0], np.uint64)) & np.uint64(63)).astype(np.int64)].tobytes().decode()
    is_section, is_paragraph = section[edge], paragraph[edge]
    p_edge = np.flatnonzero(is_paragraph)
    p_hash = _folded(leaf, p_edge)
    s_edge = np.flatnonzero(is_section[p_edge])
    s_hash = _folded(p_hash, s_edge)
    s_owner = owner[p_edge][s_edge] if len(s_edge) else s_edge
    r_edge = np.flatnonzero(np.append(True, s_owner[1:] != s_owner[:-1])[:len(s_owner)])
    root = dict(zip(s_owner[r_edge].tolist(), _folded(s_hash, r_edge).tolist()))
    bounds = np.searchsorted(owner, np.arange(rows + 1))
    p_bounds = np.searchsorted(p_edge, bounds)
    out = []
    blank = {}
    for r in range(rows):
        a, b = bounds[r], bounds[r + 1]
        if a == b:  # no word: the bytes themselves
            text = texts[r]
            if text not in blank:
                blank[text] = hashlib.sha256(b"blank" + text.encode("utf-8", "surrogatepass")).hexdigest()[:16] + "."
            out.append((blank[text], code[a:b]))
            continue
        parts = []
        ps = p_edge[p_bounds[r]:p_bounds[r + 1]].tolist()
        for k, (x, y) in enumerate(zip(ps, [*ps[1:], b])):
            parts.append(("/" if is_section[x] else ":") if k else "")
            parts.append(letters[4 * x:4 * y])
        out.append((f"{root[r]:016x}." + "".join(parts), code[a:b]))
    return out


def _near(one: tuple[str, np.ndarray], other: tuple[str, np.ndarray]) -> float:
    if one[0][:16] == other[0][:16]:
        return 1.0
    total = len(one[1]) + len(other[1])
    if not total:
        return 0.0
    common = Counter(one[1].tolist()) & Counter(other[1].tolist())
    return 2 * sum(common.values()) / total


def _codes(fingerprint: str) -> list[list[list[str]]]:
    body = fingerprint[17:]
    return [[[p[k:k + 4] for k in range(0, len(p), 4)] for p in s.split(":")] for s in body.split("/")] if body else []


def likeness(one: str, other: str) -> float:
    """0 to 1 from two fingerprints alone."""
    a, b = ((f, np.array([hash(c) for s in _codes(f) for p in s for c in p], np.int64)) for f in (one, other))
    return _near(a, b)


def differing(one: str, other: str) -> list[tuple[int, int, int]]:
    """(section, paragraph, segment) places in which the trees differ, found from the top down."""
    if one[:16] == other[:16]:
        return []
    out = []
    a, b = _codes(one), _codes(other)
    for s in range(max(len(a), len(b))):
        x, y = a[s] if s < len(a) else [], b[s] if s < len(b) else []
        if x == y:
            continue
        for p in range(max(len(x), len(y))):
            u, v = x[p] if p < len(x) else [], y[p] if p < len(y) else []
            if u != v:
                out += [(s, p, k) for k in range(max(len(u), len(v))) if u[k:k + 1] != v[k:k + 1]]
    return out


def _rows(ids: list, texts: list[str], following: list[str], later: list[tuple[str, np.ndarray]] | None = None) -> dict:
    edited = []
    for text, nxt in zip(texts, following):
        half = len(text) // 2
        edited.append(text[:len(text) - half] + nxt[:half])
    own, changed = trees(texts), trees(edited)
    after = [*own[1:], *trees(following[-1:])] if later is None else later
    return {
        "doc_id": pa.array(ids, pa.int64()), "n_chars": pa.array([len(t) for t in texts], pa.int64()),
        "edited_sha256": pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
        "fingerprint": pa.array([f for f, _ in own], pa.string()), "edited_fingerprint": pa.array([f for f, _ in changed], pa.string()),
        "near_edited": pa.array([_near(a, b) for a, b in zip(own, changed)], pa.float64()),
        "near_next": pa.array([_near(a, b) for a, b in zip(own, after)], pa.float64()),
    }


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every document.

    Documents are range partitioned by doc_id. A partition's last document needs the first of the next partition:
    firsts and lasts, one each per partition, are set aside and joined afterwards.
    """

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()

        def aside(kind, name, text):
            empty = {c.split()[0]: pa.array([None], t) for c, t in zip(_COLUMNS.split(", ")[1:], [pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 2])}
            return pa.record_batch({"kind": pa.array([kind], pa.int32()), "shard": pa.array([shard], pa.int32()), "doc_id": pa.array([name], pa.int64()),
                                    **empty, "text": pa.array([text], pa.string())})

        def done(ids, texts, following):
            n = len(ids)
            return pa.record_batch({"kind": pa.array([0] * n, pa.int32()), "shard": pa.array([shard] * n, pa.int32()),
                                    **_rows(ids, texts, following), "text": pa.array([None] * n, pa.string())})

        ids, texts = [], []
        for block in blocks(batches, "text"):
            new, more = block.column("doc_id").to_pylist(), [t or "" for t in block.column("text").to_pylist()]
            if not ids:
                yield aside(1, new[0], more[0])
            ids, texts = ids + new, texts + more
            if len(ids) > 1:
                yield done(ids[:-1], texts[:-1], texts[1:])
                ids, texts = ids[-1:], texts[-1:]
        if ids:
            yield aside(2, ids[0], texts[0])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    made = written(rows.mapInArrow(make, f"kind int, shard int, {_COLUMNS}, text string"), "fingerprints")
    heads = made.where("kind = 1").select("shard", "text")
    order = Window.orderBy("shard")
    follow = heads.select("shard").select("shard", F.coalesce(F.lead("shard").over(order), F.min("shard").over(Window.partitionBy(F.lit(1)))).alias("next"))
    heads = heads.select(F.col("shard").alias("next"), F.col("text").alias("following"))
    lasts = made.where("kind = 2").select("shard", "doc_id", "text").join(follow, "shard").join(heads, "next").select("doc_id", "text", "following")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text"):
            texts, following = block.column("text").to_pylist(), block.column("following").to_pylist()
            yield pa.record_batch(_rows(block.column("doc_id").to_pylist(), texts, following, trees(following)))

    names = [c.split()[0] for c in _COLUMNS.split(", ")]
    return made.where("kind = 0").select(*names).union(lasts.mapInArrow(finish, _COLUMNS))
