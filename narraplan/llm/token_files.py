"""Token-id files: frequency-ranked ids in byte-aligned variable-length coding with separate control bytes.

A file holds blocks of documents in ascending doc_id order, one Parquet row a block, so that any store and Spark's
commit protocol serve. A block has the ids that occur in it, most frequent first (`ranking`); every id is written as
its rank in one to four bytes (`data`), and `control` has two bits an id, four ids a byte, with that number less one.
A block is decoded without a loop over ids: a table of 256 rows turns control bytes into lengths, a mask puts the
bytes in their places, and the ranking turns ranks into ids. Blocks are small and self-contained: writer and reader
hold one at a time, and no pass over the corpus is needed before writing.

A null or empty text is the end id alone. Rows with null doc_id come first; rows of equal doc_id are ordered by
text and stay next to each other. Extra columns are ignored. An empty table writes no block.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from narraplan.llm.common import blocks, shared_folder
from narraplan.llm.tokens import encoded

BLOCK_IDS = 1 << 20
SCHEMA = "shard int, block long, tokens long, doc_ids array<long>, lengths array<long>, ranking binary, control binary, data binary"
_LENGTHS = np.array([[1 + (b >> 2 * k & 3) for k in range(4)] for b in range(256)], np.int64)
_PLACE = np.arange(4)


def encode_ids(ids: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """ranking, control, data of a block of ids."""
    counts = np.bincount(ids)
    values = np.flatnonzero(counts)
    order = np.lexsort((values, -counts[values]))
    rank = np.zeros(len(counts), "<u4")
    rank[values[order]] = np.arange(len(values), dtype="<u4")
    ranks = rank[ids]
    size = 1 + (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    data = ranks.view(np.uint8).reshape(-1, 4)[_PLACE < size[:, None]]
    two = np.zeros(-(-len(ids) // 4) * 4, np.uint8)
    two[:len(ids)] = size - 1
    control = (two.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(1, dtype=np.uint8)
    return values[order].astype("<u4").tobytes(), control.tobytes(), data.tobytes()


def decode_ids(ranking: bytes, control: bytes, data: bytes, n: int) -> np.ndarray:
    size = _LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    wide = np.zeros((n, 4), np.uint8)
    wide[_PLACE < size[:, None]] = np.frombuffer(data, np.uint8)
    return np.frombuffer(ranking, "<u4")[wide.view("<u4")[:, 0]]


def write_token_files(docs: DataFrame, path: str, folder: str, end_id: int = 2, spaces: bool = False, block_ids: int = BLOCK_IDS) -> None:
    """Encode all documents and write their ids to `folder`, in ascending doc_id order from file to file."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, number = TaskContext.get().partitionId(), 0
        held: list[np.ndarray] = []
        names: list[int | None] = []

        def flush():
            ids = np.concatenate(held)
            ranking, control, data = encode_ids(ids)
            return pa.record_batch([
                pa.array([shard], pa.int32()), pa.array([number], pa.int64()), pa.array([len(ids)], pa.int64()),
                pa.array([names], pa.list_(pa.int64())), pa.array([[len(x) for x in held]], pa.list_(pa.int64())),
                pa.array([ranking], pa.binary()), pa.array([control], pa.binary()), pa.array([data], pa.binary()),
            ], names=["shard", "block", "tokens", "doc_ids", "lengths", "ranking", "control", "data"])

        total = 0
        for block in blocks(batches, "text", 2 << 20):
            for name, ids in zip(block.column("doc_id").to_pylist(), encoded(path, spaces, block.column("text").to_pylist())):
                held.append(np.append(ids, np.uint32(end_id)).astype("<u4"))
                names.append(name)
                total += len(held[-1])
                if total >= block_ids:
                    yield flush()
                    held, names, total, number = [], [], 0, number + 1
        if held:
            yield flush()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(make, SCHEMA).write.parquet(folder)


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """Per document from the files: doc_id, start (ids before it), n_tokens, ids array."""
    return _read(spark, folder, lambda ids: ids, "ids array<int>", pa.list_(pa.int32()))


def token_digests(spark: SparkSession, folder: str) -> DataFrame:
    """Per document from the files: doc_id, start, n_tokens, ids_crc32."""
    return _read(spark, folder, lambda ids: zlib.crc32(ids.astype("<u4").tobytes()), "ids_crc32 long", pa.int64())


def _read(spark: SparkSession, folder: str, of, column: str, kind: pa.DataType) -> DataFrame:
    files = spark.read.schema(SCHEMA).parquet(folder)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                shard, block, tokens, doc_ids, lengths, ranking, control, data = (batch.column(c)[row] for c in range(8))
                ids = decode_ids(ranking.as_py(), control.as_py(), data.as_py(), tokens.as_py())
                size = lengths.values.to_numpy()
                end = np.cumsum(size)
                yield pa.record_batch([
                    pa.array(np.full(len(size), shard.as_py(), np.int32)), pa.array(np.full(len(size), block.as_py(), np.int64)),
                    doc_ids.values, pa.array(end - size), lengths.values,
                    pa.array([of(ids[a:b]) for a, b in zip(end - size, end)], kind),
                ], names=["shard", "block", "doc_id", "within", "n_tokens", column.split()[0]])

    held = files.mapInArrow(make, f"shard int, block long, doc_id long, within long, n_tokens long, {column}")
    runs = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    inner = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = files.select("shard", "block", "tokens")
    whole = sizes.groupBy("shard").agg(F.sum("tokens").alias("all")).select("shard", F.coalesce(F.sum("all").over(runs), F.lit(0)).alias("base"))
    base = sizes.select("shard", "block", F.coalesce(F.sum("tokens").over(inner), F.lit(0)).alias("first")).join(whole, "shard")
    return held.join(base, ["shard", "block"]).select(
        "doc_id", (F.col("base") + F.col("first") + F.col("within")).alias("start"), "n_tokens", column.split()[0])


def new_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/token-files-{uuid.uuid4().hex}"
