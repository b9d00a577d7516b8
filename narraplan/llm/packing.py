"""Harmonic packing of token sequences.

A document's ids, with an end id, are cut where that helps: whole sequences of `capacity`, then halves, quarters
and so on down to `grain`, then a tail shorter than `grain`. A piece of length L belongs to the class
j = capacity div L, that is capacity / (j + 1) < L <= capacity / j, and a sequence of class j takes a fixed number
of pieces, j. Halves, quarters and the like fill their sequences without a gap; only tails leave padding, at most
capacity / (j + 1) < grain + 1 in a sequence. Pieces are numbered within their class by workers independently; one
prefix sum over the workers' counts makes the numbers run through, so that a class has one open sequence at most.

A null or empty text has the end id alone. Repeated rows and equal ids are packed as often as they come. Extra
columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from narraplan.llm.common import blocks, cut
from narraplan.llm.tokens import encoded


def cuts(n: int, capacity: int, grain: int) -> list[int]:
    """Lengths of the pieces of n ids, in order."""
    out = [capacity] * (n // capacity)
    rest, size = n % capacity, capacity
    while size % 2 == 0 and size // 2 >= grain:
        size //= 2
        if rest >= size:
            out.append(size)
            rest -= size
    return [*out, rest] if rest else out


def token_pieces(docs: DataFrame, path: str, capacity: int = 1024, grain: int = 64, end_id: int = 0) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text", 2 << 20):
            doc, start, length, crc, total = [], [], [], [], []
            for name, ids in zip(block.column("doc_id").to_pylist(), encoded(path, True, block.column("text").to_pylist())):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                at = 0
                for size in cuts(len(ids), capacity, grain):
                    doc.append(name), start.append(at), length.append(size), total.append(len(ids))
                    crc.append(zlib.crc32(ids[at:at + size].tobytes()))
                    at += size
            yield pa.record_batch({
                "doc_id": pa.array(doc, pa.int64()), "start": pa.array(start, pa.int64()), "length": pa.array(length, pa.int64()),
                "ids_crc32": pa.array(crc, pa.int64()), "doc_tokens": pa.array(total, pa.int64())})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        make, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def pack(pieces: DataFrame, capacity: int = 1024, grain: int = 64, workers: int | None = None) -> DataFrame:
    """Add sequence_id and offset to pieces cut by `cuts` with the same capacity and grain."""
    workers = workers or int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pieces = cut(pieces.withColumn("j", F.expr(f"{capacity} div length")).withColumn(
        "worker", F.expr(f"pmod(xxhash64(doc_id, start, ids_crc32), {workers})")))
    before = Window.partitionBy("j").orderBy("worker").rowsBetween(Window.unboundedPreceding, -1)
    counts = pieces.groupBy("j", "worker").count().select(
        "j", "worker", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    own = Window.partitionBy("j", "worker").orderBy("doc_id", "start", "ids_crc32")
    ranked = pieces.withColumn("own", F.row_number().over(own) - 1).join(counts, ["j", "worker"]).withColumn(
        "rank", F.col("base") + F.col("own")).withColumn("bin", F.expr("rank div j"))
    ranked = cut(ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "j", "rank",
                               (F.col("bin") * (capacity + 1) + F.col("j")).alias("sequence_id")))
    exact = ranked.where(f"j < {capacity // grain}").withColumn("offset", F.expr("(rank % j) * length"))
    earlier = Window.partitionBy("sequence_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    tails = ranked.where(f"j >= {capacity // grain}").withColumn("offset", F.coalesce(F.sum("length").over(earlier), F.lit(0)))
    return exact.unionByName(tails).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def pack_documents(docs: DataFrame, path: str, capacity: int = 1024, grain: int = 64) -> DataFrame:
    """Pieces of all documents with their place in a sequence."""
    return pack(token_pieces(docs, path, capacity, grain), capacity, grain)
