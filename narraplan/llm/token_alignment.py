"""Cross-tokenizer alignment: which tokens of one vocabulary cover the bytes of which tokens of another.

Vocabulary A is a byte-level BPE of the tokenizers library and reads a space and the text; vocabulary B is a
sentencepiece model, which adds that space itself. Steps, on Arrow columns of a block of documents:

1. Ids are list columns. Flattened, with their parent indices, they take their tokens' bytes from the vocabulary; a
   cumulative sum of byte lengths, less its value at the document's start, is each token's end in its document.
2. A full outer Acero hash join of both sides on (document, end) gives every end once. Sorted, with gaps filled from
   behind, each row is a stretch of bytes inside one A token and one B token, so rows are exactly the overlapping
   pairs (links). Rows found on both sides are cuts: they end a group.
3. Id pairs of a document are counted by Table.group_by. One row a document is written: counts, the digest of its
   groups, its distinct pairs and how often each is linked. Texts are encoded once.
4. A second pass over these rows counts, again by Table.group_by within a task, how many documents hold a pair, and
   Spark sums the partial counts. A third looks the sums up. The most frequent pairs, at most PAIRS of them, are
   broadcast as sorted arrays; rarer ones, if there are more, meet their counts in a shuffled join, which no frequent
   pair enters, so it has no hot key.

Memory in a task: a block (about 1 MiB of text, or one longer text), its columns, and the broadcast pairs.

Null and empty texts, and texts whose joined token bytes are not space + text on both sides, have no tokens: zeros
and an empty digest. Repeated rows and ids are rows of their own, and each counts as a document. A null doc_id stays
null. Extra columns are ignored, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from narraplan.llm.common import blocks, cut, written
from narraplan.llm.tokens import encoder

#: Most id pairs that are broadcast.
PAIRS = 1 << 22
#: Partial counts that a task holds before it hands them on.
HELD = 1 << 20
_MADE: dict = {}
_ENDS = (",", "|", ";", "")
COUNTS = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"


def byte_level_tokens(path: str) -> pa.Array:
    """Bytes of each entry of a byte-level vocabulary. Its alphabet: printable bytes are themselves, the others follow from 256 on."""
    from tokenizers import Tokenizer

    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in plain}
    letters |= {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
    vocabulary = Tokenizer.from_file(path)
    entries = [vocabulary.id_to_token(k) or "" for k in range(vocabulary.get_vocab_size())]
    return pa.array([bytes(letters[c] for c in t) if all(c in letters for c in t) else t.encode() for t in entries], pa.large_binary())


def piece_tokens(model) -> pa.Array:
    """Bytes of each piece of a sentencepiece model: U+2581 is a space, <0xHH> a byte."""
    pieces = [(model.id_to_piece(k), model.is_byte(k)) for k in range(model.get_piece_size())]
    return pa.array([bytes([int(p[3:5], 16)]) if byte else p.replace("▁", " ").encode() for p, byte in pieces], pa.large_binary())


class Aligner:
    """Both vocabularies, loaded once a worker process."""

    def __init__(self, byte_path: str, piece_path: str):
        import sentencepiece

        self.a = encoder(byte_path, True)
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        self.bytes_a, self.bytes_b = byte_level_tokens(byte_path), piece_tokens(self.b)
        self.most = max(len(self.bytes_a), len(self.bytes_b))
        if self.most > 1 << 16:
            raise ValueError("a vocabulary has more than 65,536 ids")
        self.decimals = pa.array([f"{k}{end}".encode() for end in _ENDS for k in range(self.most)], pa.large_binary())

    def lists(self, texts: list[str | None]) -> tuple[pa.Array, pa.Array]:
        """Ids of A and of B as list columns; null and empty texts have none."""
        some = [k for k, t in enumerate(texts) if t]
        ids_a = [b""] * len(texts)
        ids_b: list = [()] * len(texts)
        for k, a, b in zip(some, self.a.encode([" " + texts[k] for k in some]), self.b.encode([texts[k] for k in some], num_threads=1)):
            ids_a[k], ids_b[k] = a, b
        sizes_a, sizes_b = [len(x) // 2 for x in ids_a], [len(x) for x in ids_b]
        flat_b = np.fromiter((i for x in ids_b for i in x), np.uint16, sum(sizes_b))
        return _lists(np.frombuffer(b"".join(ids_a), "<u2"), sizes_a), _lists(flat_b, sizes_b)


def aligner(byte_path: str, piece_path: str) -> Aligner:
    if (byte_path, piece_path) not in _MADE:
        _MADE[byte_path, piece_path] = Aligner(byte_path, piece_path)
    return _MADE[byte_path, piece_path]


def _lists(flat: np.ndarray, sizes: list[int]) -> pa.Array:
    return pa.LargeListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes, dtype=np.int64))), pa.array(flat))


def _data(tokens: pa.Array) -> memoryview:
    """The bytes of a binary column, end to end."""
    data = tokens.buffers()[2]
    return memoryview(data).cast("B")[:pc.sum(pc.binary_length(tokens)).as_py() or 0] if data is not None else memoryview(b"")


def _ends(lists: pa.Array, vocabulary: pa.Array) -> tuple[pa.Table, np.ndarray, memoryview]:
    """(doc, end, at, id) of the tokens, each document's end in the joined bytes, and these bytes."""
    ids, doc = pc.list_flatten(lists), pc.list_parent_indices(lists)
    tokens = pc.take(vocabulary, ids)
    upto = np.append(0, pc.cumulative_sum(pc.binary_length(tokens)).to_numpy()).astype(np.int64)
    bounds = upto[lists.offsets.to_numpy()]
    end = upto[1:] - bounds[doc.to_numpy()]
    table = pa.table({"doc": doc, "end": pa.array(end), "at": pa.array(np.arange(len(end))), "id": ids})
    return table, bounds, _data(tokens)


def _whole(texts: list[str | None], bounds_a, data_a, bounds_b, data_b) -> np.ndarray:
    """Which texts have tokens on both sides that join to space + text."""
    out = np.zeros(len(texts), bool)
    for k, text in enumerate(texts):
        if text:
            want = (" " + text).encode()
            out[k] = data_a[bounds_a[k]:bounds_a[k + 1]] == want and data_b[bounds_b[k]:bounds_b[k + 1]] == want
    return out


def aligned(tool: Aligner, texts: list[str | None]) -> dict[str, pa.Array]:
    """Per text: n_a, n_b, n_groups, n_links, groups_sha256, pairs (a << 16 | b, ascending) and times of each, as little-endian unsigned 32-bit."""
    n = len(texts)
    lists_a, lists_b = tool.lists(texts)
    (ends_a, bounds_a, data_a), (ends_b, bounds_b, data_b) = _ends(lists_a, tool.bytes_a), _ends(lists_b, tool.bytes_b)
    good = _whole(texts, bounds_a, data_a, bounds_b, data_b)
    if not good.all():
        keep = pa.array(good)
        ends_a, ends_b = (t.filter(pc.take(keep, t.column("doc"))) for t in (ends_a, ends_b))
        ends_a, ends_b = (t.set_column(2, "at", pa.array(np.arange(t.num_rows))) for t in (ends_a, ends_b))
    links = ends_a.rename_columns(["doc", "end", "a_at", "a"]).join(
        ends_b.rename_columns(["doc", "end", "b_at", "b"]), ["doc", "end"], join_type="full outer", use_threads=False)
    links = links.sort_by([("doc", "ascending"), ("end", "ascending")]).combine_chunks()
    doc = links.column("doc").to_numpy()
    cut_here = pc.and_(links.column("a_at").is_valid(), links.column("b_at").is_valid()).to_numpy()
    group = np.cumsum(cut_here) - cut_here
    a, b = (pc.fill_null_backward(links.column(c)).to_numpy().astype(np.uint32) for c in ("a", "b"))
    per_doc = lambda rows: np.bincount(rows, minlength=n).astype(np.int64)
    counted = pa.table({"doc": doc, "pair": a << np.uint32(16) | b}).group_by(["doc", "pair"], use_threads=False).aggregate([([], "count_all")])
    counted = counted.sort_by([("doc", "ascending"), ("pair", "ascending")])
    pair_ends = np.append(0, np.cumsum(per_doc(counted.column("doc").to_numpy()))) * 4
    columns = {"n_a": per_doc(ends_a.column("doc").to_numpy()), "n_b": per_doc(ends_b.column("doc").to_numpy()),
               "n_groups": per_doc(doc[cut_here]), "n_links": per_doc(doc)}
    digests = _digests(tool, n, ends_a, ends_b, links, group)
    columns = {name: pa.array(value) for name, value in columns.items()} | {"groups_sha256": pa.array(digests, pa.string())}
    for name, source in (("pairs", "pair"), ("times", "count_all")):
        data = counted.column(source).to_numpy().astype("<u4").tobytes()
        columns[name] = pa.array([data[s:e] for s, e in zip(pair_ends[:-1], pair_ends[1:])], pa.binary())
    return columns


def _digests(tool: Aligner, n: int, ends_a: pa.Table, ends_b: pa.Table, links: pa.Table, group: np.ndarray) -> list[str]:
    """SHA-256 of `a1,a2|b1;a3|b2,b3` a document. The written tokens are taken from a table of decimals with the sign behind each."""
    if not len(group):
        return [""] * n
    group_a, group_b = (group[links.column(c).is_valid().to_numpy()] for c in ("a_at", "b_at"))
    in_a, in_b = np.bincount(group_a), np.bincount(group_b)
    upto_a, upto_b = np.cumsum(in_a), np.cumsum(in_b)
    at_a = np.arange(len(group_a)) + (upto_b - in_b)[group_a]
    at_b = np.arange(len(group_b)) + upto_a[group_b]
    doc_a, doc_b = ends_a.column("doc").to_numpy(), ends_b.column("doc").to_numpy()
    last = lambda x: np.append(x[1:] != x[:-1], True)
    sign_a = last(group_a).astype(np.int64)
    sign_b = np.where(last(doc_b), 3, np.where(last(group_b), 2, 0))
    which = np.empty(len(at_a) + len(at_b), np.int64)
    which[at_a] = ends_a.column("id").to_numpy() + sign_a * tool.most
    which[at_b] = ends_b.column("id").to_numpy() + sign_b * tool.most
    signs = pc.take(tool.decimals, pa.array(which))
    upto = np.append(0, pc.cumulative_sum(pc.binary_length(signs)).to_numpy())
    ends = upto[np.append(0, np.cumsum(np.bincount(doc_a, minlength=n) + np.bincount(doc_b, minlength=n)))]
    data = _data(signs)
    return [hashlib.sha256(data[s:e]).hexdigest() if e > s else "" for s, e in zip(ends[:-1], ends[1:])]


def alignments(docs: DataFrame, byte_path: str, piece_path: str) -> DataFrame:
    """One row a document: uid (unique once written), doc_id, counts, groups_sha256, pairs, times."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, at = aligner(byte_path, piece_path), TaskContext.get().partitionId() << 33
        for block in blocks(batches, "text"):
            columns = aligned(tool, block.column("text").to_pylist())
            uid = pa.array(np.arange(at, at + block.num_rows))
            at += block.num_rows
            yield pa.record_batch({"uid": uid, "doc_id": block.column("doc_id")} | columns)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(make, f"uid long, doc_id long, {COUNTS}, pairs binary, times binary")


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All 32-bit values of a binary column and each row's start, one more than rows."""
    off = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8)[off[0]:off[-1]].view("<u4") if data is not None else np.zeros(0, np.uint32), (off - off[0]) // 4


def pair_counts(rows: DataFrame) -> DataFrame:
    """(pair, n, best): how many documents hold a pair, and whether this is the most of all pairs of its A id."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            flat = pa.table({"pair": _flat(batch.column(0))[0].astype(np.int64)})
            flat = flat.append_column("n", pa.array(np.ones(flat.num_rows, np.int64)))
            held = flat if held is None else pa.concat_tables([held, flat])
            held = held.group_by("pair", use_threads=False).aggregate([("n", "sum")]).rename_columns(["pair", "n"])
            if held.num_rows > HELD:
                yield from held.to_batches()
                held = None
        if held is not None:
            yield from held.to_batches()

    counts = rows.select("pairs").mapInArrow(partial, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    counts = cut(counts.withColumn("a", F.shiftright("pair", 16)))
    most = counts.groupBy("a").agg(F.max("n").alias("most"))
    return cut(counts.join(most, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best")))


def _frequent(counts: DataFrame) -> int:
    """The least count that is broadcast: 1 if all pairs may be, else the smallest power of 2 that leaves at most PAIRS."""
    sizes = {r["k"]: r["pairs"] for r in counts.groupBy(F.floor(F.log2("n")).alias("k")).agg(F.count("*").alias("pairs")).collect()}
    above, least = 0, 63
    for k in range(63, -1, -1):
        above += sizes.get(k, 0)
        if above > PAIRS:
            break
        least = k
    return 1 << least


def linked_counts(docs: DataFrame, byte_path: str, piece_path: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row of docs (doc_id, text)."""
    rows = written(alignments(docs, byte_path, piece_path), "alignments")
    counts = pair_counts(rows)
    least = _frequent(counts)
    known = counts.where(F.col("n") >= least).toPandas().sort_values("pair")
    held = docs.sparkSession.sparkContext.broadcast(
        (known["pair"].to_numpy(np.uint32), known["n"].to_numpy(np.int64), known["best"].to_numpy(bool)))

    def found(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        """Pairs, times and starts of a batch, where each pair stands among the known ones, and whether it does."""
        pairs, start = _flat(batch.column("pairs"))
        times = _flat(batch.column("times"))[0].astype(np.int64)
        keys = held.value[0]
        at = np.minimum(np.searchsorted(keys, pairs), max(len(keys) - 1, 0))
        return pairs, times, start, at, keys[at] == pairs if len(keys) else np.zeros(len(pairs), bool)

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, n, best = held.value
        for batch in batches:
            _, times, start, at, hit = found(batch)
            sums = []
            for value in (best, n):
                values = np.where(hit, value[at] * times, 0) if len(value) else np.zeros(len(times), np.int64)
                upto = np.append(0, np.cumsum(values))
                sums.append(pa.array(upto[start[1:]] - upto[start[:-1]]))
            yield pa.record_batch([*(batch.column(c) for c in names), *sums], names=[*names, "n_best", "count_sum"])

    def missed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs, times, start, _, hit = found(batch)
            uid = np.repeat(batch.column("uid").to_numpy(), np.diff(start))
            yield pa.record_batch({"uid": pa.array(uid[~hit]), "pair": pa.array(pairs[~hit].astype(np.int64)), "times": pa.array(times[~hit])})

    names = ["uid", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    out = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    known_sums = rows.mapInArrow(look_up, f"uid long, doc_id long, {COUNTS}, n_best long, count_sum long")
    if least == 1:
        return known_sums.select(*out)
    rest = rows.select("uid", "pairs", "times").mapInArrow(missed, "uid long, pair long, times long")
    rest = rest.join(counts.where(F.col("n") < least), "pair").groupBy("uid").agg(
        F.sum(F.col("times") * F.col("best").cast("long")).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more"))
    both = known_sums.join(rest, "uid", "left")
    for name, more in (("n_best", "more_best"), ("count_sum", "more")):
        both = both.withColumn(name, F.col(name) + F.coalesce(more, F.lit(0)))
    return both.select(*out)
