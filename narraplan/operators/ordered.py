"""Order-dependent work that stays parallel when one key holds most of the rows.

Two shapes are used, chosen by what bounds a group:

* A group that is one script is bounded by one text cell, so a plain window or
  ``ordered_scan`` (sorted partitions, streamed batches, constant memory) is enough.
* A group that is a log key (provider, query, recording) has no bound. ``running_sum``
  and ``carry`` cut such a group into blocks by a column expression, aggregate each
  block map-side, combine the small block table, and finish inside the blocks, so no
  task ever holds more than one block. ``spaced_accepts`` sends only the times of its
  blocks along a key.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type


def _shared_folder(df: DataFrame) -> str:
    """The session's checkpoint folder, which all executors share; only a local master gets one of its own."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        shared = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if shared is None:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder all executors share")
            shared = tempfile.mkdtemp(prefix="narraplan-")
        sc.setCheckpointDir(shared)
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the session's shared folder; survives lost executors."""
    _shared_folder(df)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """As ``cut_lineage``, in columns and compressed, which takes a fraction of the disk where rows are many."""
    return _stored(df, f"{_shared_folder(df)}/rows-{uuid.uuid4().hex}")


def _stored(df: DataFrame, path: str) -> DataFrame:
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def written_for(*tables: DataFrame) -> Iterator[list[DataFrame]]:
    """As ``written``, one table after another, removed at the end: for rows that are read inside only."""
    paths = [f"{_shared_folder(df)}/rows-{uuid.uuid4().hex}" for df in tables]
    spark = tables[0].sparkSession
    try:
        yield [_stored(df, path) for df, path in zip(tables, paths)]
    finally:
        for path in map(spark._jvm.org.apache.hadoop.fs.Path, paths):
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


# -- blocked windows -----------------------------------------------------------


def running_sum(df: DataFrame, keys: Sequence[str], order: Sequence[str], block: Column,
                value: Column, name: str, total: str | None = None) -> DataFrame:
    """Inclusive running sum of ``value`` per key. ``block`` must rise with ``order``.

    ``total`` names a column for the key's whole sum, which the block table gives for free.
    """
    blocked = df.withColumn("_blk", block).withColumn("_val", value)
    totals = blocked.groupBy(*keys, "_blk").agg(F.sum("_val").alias("_tot"))
    whole = Window.partitionBy(*keys)
    earlier = whole.orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    extra = [F.sum("_tot").over(whole).alias(total)] if total else []
    before = totals.select(
        *keys, "_blk", F.coalesce(F.sum("_tot").over(earlier), F.lit(0)).alias("_before"), *extra
    )
    inside = Window.partitionBy(*keys, "_blk").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        blocked.join(before, [*keys, "_blk"])
        .withColumn(name, F.col("_before") + F.sum("_val").over(inside))
        .drop("_blk", "_val", "_before")
    )


def carry(df: DataFrame, keys: Sequence[str], order: Sequence[str], block: Column,
          value: Column, name: str, backward: bool = False) -> DataFrame:
    """Latest non-null ``value`` at or before each row; with ``backward`` the next one."""
    blocked = df.withColumn("_blk", block).withColumn("_val", value)
    rank = F.struct(*order)
    pick = F.min_by if backward else F.max_by
    ends = (
        blocked.where(F.col("_val").isNotNull())
        .groupBy(*keys, "_blk")
        .agg(pick("_val", rank).alias("_end"))
    )
    # every block needs a row, also those without a value
    ends = (
        blocked.select(*keys, "_blk").distinct().join(ends, [*keys, "_blk"], "left")
    )
    direction = F.col("_blk").desc() if backward else F.col("_blk").asc()
    earlier = Window.partitionBy(*keys).orderBy(direction).rowsBetween(Window.unboundedPreceding, -1)
    outside = ends.select(
        *keys, "_blk", F.last("_end", ignorenulls=True).over(earlier).alias("_outside")
    )
    inner_order = [F.col(c).desc() if backward else F.col(c).asc() for c in order]
    inside = (
        Window.partitionBy(*keys, "_blk").orderBy(*inner_order)
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    return (
        blocked.join(outside, [*keys, "_blk"])
        .withColumn(name, F.coalesce(F.last("_val", ignorenulls=True).over(inside), "_outside"))
        .drop("_blk", "_val", "_outside")
    )


def row_positions(df: DataFrame, keys: Sequence[str], order: Sequence[str], block: Column,
                  name: str) -> DataFrame:
    """1-based position per key; ``order`` must be unique within a key."""
    return running_sum(df, keys, order, block, F.lit(1).cast("bigint"), name)


def exact_percentile(df: DataFrame, keys: Sequence[str], value: str, q: float, block: Column,
                     name: str) -> DataFrame:
    """Linear-interpolated percentile per key, from counted values and blocked ranks."""
    counted = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    ranked = running_sum(counted, keys, [value], block, F.col("_n"), "_cum", total="_size")
    at = (F.col("_size") - 1) * F.lit(q)
    low, high = F.floor(at), F.ceil(at)
    return (
        ranked.groupBy(*keys)
        .agg(
            F.max("_size").alias("_size"),
            F.min(F.when(F.col("_cum") > low, F.col(value))).alias("_lo"),
            F.min(F.when(F.col("_cum") > high, F.col(value))).alias("_hi"),
        )
        .select(*keys, (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * (at - low)).alias(name))
    )


# -- sequential scan of sorted partitions --------------------------------------


def ordered_scan(df: DataFrame, keys: Sequence[str], order: Sequence[str],
                 reads: Sequence[str], adds: T.StructType,
                 step: Callable[..., tuple[object, tuple]], keeps: Sequence[str] | None = None) -> DataFrame:
    """Append columns computed by ``step(state, *reads) -> (state, outputs)`` in order.

    ``keeps``: columns that come back beside the new ones; all, if not given.

    ``state`` is None at the first row of each key. Rows arrive as sorted Arrow batches,
    so a task holds one batch and one state, never a whole group.
    """
    keys, reads = list(keys), list(reads)
    kept = list(df.columns if keeps is None else keeps)
    schema = T.StructType([df.schema[c] for c in kept] + adds.fields)
    arrow_types = [to_arrow_type(f.dataType) for f in adds.fields]
    names = [f.name for f in schema.fields]

    def run(batches):
        current, state = object(), None
        for batch in batches:
            if not batch.num_rows:
                continue
            ident = list(zip(*[batch.column(k).to_pylist() for k in keys]))
            rows = zip(*[batch.column(c).to_pylist() for c in reads])
            out = []
            for key, row in zip(ident, rows):
                if key != current:
                    current, state = key, None
                state, made = step(state, *row)
                out.append(made)
            made_cols = [pa.array(col, type=t) for col, t in zip(zip(*out), arrow_types)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *made_cols], names=names)

    return (
        df.repartition(*keys)
        .sortWithinPartitions(*keys, *order)
        .mapInArrow(run, schema)
    )


# -- greedy spacing ------------------------------------------------------------


def spaced_scan(df: DataFrame, keys: Sequence[str], at: str, order: Sequence[str], gap: int,
                strict: bool, name: str) -> DataFrame:
    """Mark rows kept when each must follow the last kept one of its key by ``gap`` (more, if strict)."""
    adds = T.StructType([T.StructField(name, T.BooleanType())])

    def step(last, moment):
        if last is None or (moment - last > gap if strict else moment - last >= gap):
            return moment, (True,)
        return last, (False,)

    return ordered_scan(df, keys, order, [at], adds, step)


def _kept_moments(moments: DataFrame, keys: list[str], gap: int, strict: bool) -> DataFrame:
    """(keys, _at) kept of (keys, _blk, _times), blocks of sorted times read in order of a key.

    A block is entered with the last kept time and left with a later one or the same, which
    takes one binary search for each kept time in it; blocks compose in this way along a
    key, with nothing held but the present block.
    """
    fields = [f for f in moments.schema.fields if f.name in keys]
    schema = T.StructType([*fields, T.StructField("_at", T.LongType())])

    def run(batches):
        current, last = object(), None
        for batch in batches:
            idents = list(zip(*[batch.column(k).to_pylist() for k in keys]))
            found, kept = [], []
            for i, key in enumerate(idents):
                times = batch.column("_times")[i].values.to_numpy()
                if key != current:
                    current, last = key, None
                at = 0 if last is None else int(np.searchsorted(times, last + gap, "right" if strict else "left"))
                while at < len(times):
                    last = int(times[at])
                    found.append(i)
                    kept.append(last)
                    at = int(np.searchsorted(times, last + gap, "right" if strict else "left"))
            rows = pa.array(found, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(f.name).take(rows) for f in fields), pa.array(kept, pa.int64())], names=schema.names)

    return moments.repartition(*keys).sortWithinPartitions(*keys, "_blk").mapInArrow(run, schema)


def spaced_accepts(df: DataFrame, keys: Sequence[str], at: str, order: Sequence[str], gap: int,
                   strict: bool, name: str) -> DataFrame:
    """``spaced_scan`` for log keys, which nothing bounds; one way for all sizes, without a job beforehand.

    ``at`` is an integer column and the first entry of ``order``. Rows are cut into blocks of a
    thousandth of the gap, and only the distinct times of a block, 8 bytes each, go on, in one
    array a block. A key's arrays are read in order by one task, which looks into a block only
    where the next kept time can be. Rows get their mark by a join on (key, time), so the
    rows of a hot key stay spread.
    """
    keys, order = list(keys), list(order)
    width = F.lit(max(gap // 1024, 1))
    moments = df.select(*keys, F.col(at).cast("bigint").alias("_at")).groupBy(
        *keys, F.floor(F.col("_at") / width).alias("_blk")).agg(F.array_sort(F.collect_set("_at")).alias("_times"))
    kept = _kept_moments(moments, keys, gap, strict)
    same = [df[k].eqNullSafe(kept[k]) for k in keys] + [df[at] == kept["_at"]]
    found = df.join(kept, reduce(lambda x, y: x & y, same), "left_semi")
    # of several rows at one moment only the first in order is kept
    first = found.groupBy(*keys, at).agg(F.min(F.struct(*order)).alias("_first")).select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
        *[F.col(f"_first.{c}").alias(f"_o{i}") for i, c in enumerate(order)], F.lit(True).alias("_chosen"))
    match = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)] + [
        F.col(c).eqNullSafe(F.col(f"_o{i}")) for i, c in enumerate(order)]
    marked = df.join(first, reduce(lambda x, y: x & y, match), "left")
    return marked.select(*df.columns, F.coalesce("_chosen", F.lit(False)).alias(name))
