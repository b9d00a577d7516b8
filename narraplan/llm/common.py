"""Helpers that several operators share: cut lineage, components of a link graph, words of Arrow text columns.

Text enters tasks as Arrow batches. `blocks` cuts them into runs of rows of bounded size, and `Words` hashes
every word of such a run with numpy, so no Python loop touches single words.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK_BYTES = 1 << 20
PART_ROWS = 20_000


def release() -> None:
    """Give freed memory of a worker process back to the system; workers live on from task to task."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def free_name(columns: list[str], name: str) -> str:
    """A column name that is none of `columns`."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def refuse(columns: list[str], name: str) -> None:
    """Results come in one struct column; its name must be free."""
    if name.lower() in {c.lower() for c in columns}:
        raise ValueError(f"documents have a column {name}: give `result` another name")


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share. Only a local master gets one of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="narraplan-llm-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the rows are kept in the shared folder and the lineage ends there."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table into the shared folder and read it back."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sized(df: DataFrame, most: int = 50_000) -> DataFrame:
    """A cut table of few rows with a hint to broadcast it; a longer one as it is, to be joined by shuffle."""
    return F.broadcast(df) if df.count() <= most else df


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of an undirected graph (a, b): the smallest node reachable. Large and small stars in turn.

    A node's neighbours are never gathered: minima are partial aggregates joined back. Nodes without a link to
    another node get no row; null ends are left out. Links too few to fill the session's shuffle partitions are
    dealt to as many as they fill, so that a round doesn't write thousands of empty blocks.
    """
    most = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    stars = cut(
        edges.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
        .where("a is not null and b is not null and hi > lo").distinct()
    )
    mark = None
    while True:
        now = stars.agg(F.count("*"), F.expr("bit_xor(xxhash64(hi, lo))")).first()
        if now[0] == 0 or now == mark:
            break
        mark = now
        parts = now[0] // PART_ROWS + 1

        def dealt(df: DataFrame, key: str, parts: int = parts) -> DataFrame:
            return df.repartition(parts, key) if parts < most else df

        both = stars.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(stars.select("lo", "hi"))
        both = dealt(both, "u")
        least = both.groupBy("u").agg(F.least(F.first("u"), F.min("v")).alias("m"))
        large = dealt(both.join(least, "u").where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")), "hi").distinct()
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(low, "hi").where("lo != m").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).union(low.select("hi", "m"))
        stars = cut(dealt(small, "hi").distinct())
    roots = stars.select(F.col("lo").alias("node")).distinct()
    return stars.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(
        roots.select("node", F.col("node").alias("component")))


# Fixed random values of the hash: one per byte, with A-Z folded to a-z.
_RANDOM = np.random.default_rng(20240607)
_BYTE = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_EXACT = _BYTE.copy()
_BYTE[65:91] = _BYTE[97:123]
_STEP = np.uint64(0x9E3779B97F4A7C15)
_STEP_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
SLOTS = _RANDOM.integers(1, 2**63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_POWERS: list[np.ndarray] = []


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (splitmix finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> list[np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        n = max(n, BLOCK_BYTES + BLOCK_BYTES // 4)
        made = []
        for step in (_STEP, _STEP_BACK):
            p = np.full(n, step, np.uint64)
            p[0] = 1
            made.append(np.cumprod(p, dtype=np.uint64))
        _POWERS[:] = made
    return _POWERS


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and each row's start in them, one entry more than rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    if not len(off):
        off = np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8)[off[0]:off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return data, off - off[0]


def blocks(batches: Iterator[pa.RecordBatch], column: str, size: int = BLOCK_BYTES, rows: int = 1 << 14) -> Iterator[pa.RecordBatch]:
    """Cut batches into runs of at most `rows` rows with about `size` bytes of text; a longer text stands alone."""
    for batch in batches:
        _, off = raw(batch.column(column))
        at = 0
        while at < batch.num_rows:
            to = min(at + rows, max(at + 1, int(np.searchsorted(off, off[at] + size, "right")) - 1))
            yield batch.slice(at, to - at)
            at = to


def by_tile(batches: Iterator[pa.RecordBatch], make: Callable[[list[pa.Table]], pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Call make with the tables of whole tiles, from batches sorted by `tile`."""
    rest: list[pa.RecordBatch] = []

    def parts(whole: bool) -> list[pa.Table]:
        table = pa.Table.from_batches(rest).combine_chunks()
        tile = table.column("tile").to_numpy()
        edge = np.flatnonzero(np.append(True, tile[1:] != tile[:-1])).tolist()
        rest[:] = [] if whole else table.slice(edge[-1]).to_batches()
        return [table.slice(a, b - a) for a, b in zip(edge, [*edge[1:], len(tile)] if whole else edge[1:])]

    for batch in batches:
        if not batch.num_rows:
            continue
        rest.append(batch)
        if rest[0].column("tile")[0].as_py() != batch.column("tile")[-1].as_py():
            yield make(parts(False))
    if rest:
        yield make(parts(True))


class Spans:
    """Bytes of a run of texts (`data`, rows at `offsets`), any range of which can be hashed at once, with A-Z lowered if fold."""

    def __init__(self, column: pa.Array, fold: bool = True):
        self.data, self.offsets = raw(column)
        n = self.size = len(self.data)
        forth, self._back = _powers(n + 1)
        self._total = np.zeros(n + 1, np.uint64)
        np.cumsum((_BYTE if fold else _EXACT)[self.data] * forth[:n], out=self._total[1:])

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of byte ranges, wherever they stand."""
        return mixed((self._total[end] - self._total[start]) * self._back[start] + (end - start).astype(np.uint64))


class Words(Spans):
    """Words `[^\\x20\\x09-\\x0D]+` of a run of texts: `hash` of each, with A-Z lowered if fold; `first` word of each row."""

    def __init__(self, column: pa.Array, fold: bool = True):
        super().__init__(column, fold)
        n, off = self.size, self.offsets
        edge = np.zeros(n + 1, bool)
        edge[off] = True
        space = _SPACE[self.data]
        before = np.ones(n + 1, bool)
        before[1:] = space
        self.start = np.flatnonzero(~space & (before[:-1] | edge[:-1]))
        self.end = np.flatnonzero(~space & (np.append(space[1:], True)[:n] | edge[1:])) + 1
        self.first = np.searchsorted(self.start, off)
        self.hash = self.spans(self.start, self.end)

    def shingles(self, size: int) -> Iterator[np.ndarray]:
        """Per row, the sorted distinct hashes of runs of `size` words; of the whole text if it has fewer words."""
        first, h = self.first, self.hash
        rows = len(first) - 1
        total = np.zeros(len(h), np.uint64)
        end = np.repeat(first[1:], np.diff(first))
        at = np.arange(len(h))
        for k in range(size):
            with_k = at + k < end
            total[with_k] += h[at[with_k] + k] * SLOTS[k]
        short = np.minimum(end - at, size)
        total += (size - short).astype(np.uint64) * SLOTS[-1]
        total = mixed(total)
        for r in range(rows):
            a, b = first[r], first[r + 1]
            yield np.unique(total[a:max(min(a + 1, b), b - size + 1)])
