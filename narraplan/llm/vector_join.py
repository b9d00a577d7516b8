"""Near-duplicate vectors by an epsilon grid order join.

Cosine c of unit vectors is a distance: |x - y|^2 = 2 - 2c. Vectors are turned onto their principal directions, laid
on a grid with cells as wide as the greatest distance of a link, and sorted by the cells of the leading directions.
The sequence is cut into intervals of `BLOCK` vectors. Starting from the whole sequence joined with itself, pairs of
intervals are split and joined recursively; a pair whose boxes are provably farther apart than a link is skipped
with all below it. Pairs of blocks that remain are compared in full, in double precision.

Equal vectors are one node with a count. A pair of blocks returns, per vector, its number of links and the smallest
node it is connected to within the pair, never a list of pairs.

Vectors that are null, empty, zero or hold null or non-finite components link with nothing, nor do vectors of
different lengths. Rows with null vec_id take part; their class is the smallest id reachable, and they are never
kept. Repeated rows count as links of each other. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from narraplan.llm.common import by_tile, components, cut

BLOCK = 2048
SORTED = 8
BOXED = 16
SPLIT = 3  # an interval has 2^SPLIT parts
SLACK = 1e-9


def _unit(column: pa.Array, width: int) -> np.ndarray:
    """Rows scaled to length 1, padded with zeros."""
    out = np.zeros((len(column), width))
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    size = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out[np.repeat(np.arange(len(size)), size), np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    out /= np.abs(out).max(1, initial=1e-300, keepdims=True)  # keeps squares finite
    return out / np.sqrt((out * out).sum(1, keepdims=True))


def principal(classes: DataFrame, width: int) -> np.ndarray:
    """Directions of the vectors' second moments, leading first; summed over all vectors, width x width values."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            x = _unit(batch.column("embedding"), width)
            total += x.T @ x
        yield pa.record_batch({"i": pa.array(range(width), pa.int64()), "sums": pa.array(list(total), pa.list_(pa.float64()))})

    rows = classes.select("embedding").mapInArrow(moments, "i long, sums array<double>")
    got = rows.select("i", F.posexplode("sums").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v")).toPandas()
    m = np.zeros((width, width))
    m[got["i"], got["j"]] = got["v"]
    return np.linalg.eigh((m + m.T) / 2)[1][:, ::-1]


def near_vectors(vectors: DataFrame, least: float = 0.95) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of vectors (vec_id, embedding)."""
    kind = vectors.schema["embedding"].dataType.elementType.simpleString()
    sound = F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.forall(
        "embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    plain = F.transform("embedding", lambda x: F.when(x == 0, F.lit(0.0).cast(kind)).otherwise(x))
    rows = cut(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(F.coalesce(sound, F.lit(False)), plain).alias("embedding")).withColumn(
        "node", F.when(F.col("embedding").isNotNull(), F.xxhash64("embedding"))))
    classes = rows.where("node is not null").groupBy("node").agg(F.count("*").alias("n"), F.first("embedding").alias("embedding"))
    classes = cut(classes)
    width = classes.agg(F.max(F.size("embedding"))).first()[0] or 0
    if not width:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    far = math.sqrt(max(0.0, 2 - 2 * least)) + SLACK
    turn = principal(classes, width)
    held = vectors.sparkSession.sparkContext.broadcast(turn)
    sorted_by, boxed = min(SORTED, width), min(BOXED, width)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                p = _unit(batch.column("embedding"), width) @ held.value[:, :boxed]
                size = batch.column("embedding").value_lengths().to_numpy(zero_copy_only=False).astype(np.float64)
                p = np.column_stack([size * 4, p])  # vectors of different lengths are far apart
                cell = np.floor(p[:, :sorted_by + 1] / far).astype(np.int64)
                yield pa.record_batch([*(batch.column(c) for c in ("node", "n", "embedding")), pa.array(list(cell), pa.list_(pa.int64())),
                                       pa.array(list(p), pa.list_(pa.float64()))], names=["node", "n", "embedding", "cell", "place"])

    laid = classes.mapInArrow(project, f"node long, n long, embedding array<{kind}>, cell array<long>, place array<double>")
    order = [F.col("cell")[k] for k in range(sorted_by + 1)]

    def interval(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            number = (at + np.arange(batch.num_rows)) // BLOCK
            at += batch.num_rows
            yield pa.record_batch([*(batch.column(c) for c in ("node", "n", "embedding", "place")), pa.array(np.full(batch.num_rows, shard, np.int32)),
                                   pa.array(number)], names=["node", "n", "embedding", "place", "shard", "number"])

    laid = cut(laid.repartitionByRange(*order, "node").sortWithinPartitions(*order, "node").mapInArrow(
        interval, f"node long, n long, embedding array<{kind}>, place array<double>, shard int, number long"))
    spans = laid.groupBy("shard").agg((F.max("number") + 1).alias("blocks"))
    base = spans.select("shard", F.coalesce(F.sum("blocks").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    laid = laid.join(base, "shard").select("node", "n", "embedding", "place", (F.col("base") + F.col("number")).alias("block"))
    sides = [f(F.col("place")[k]).alias(f"{name}{k}") for k in range(boxed + 1) for name, f in (("lo", F.min), ("hi", F.max))]
    boxes = cut(laid.groupBy("block").agg(*sides))

    def level(shift: int) -> DataFrame:
        again = [(F.min if name == "lo" else F.max)(f"{name}{k}").alias(f"{name}{k}") for k in range(boxed + 1) for name in ("lo", "hi")]
        return boxes if not shift else boxes.groupBy(F.shiftright("block", shift).alias("block")).agg(*again)

    def sided(at: DataFrame, side: str) -> DataFrame:
        return at.select(F.col("block").alias(side), F.struct(*[c for c in at.columns if c != "block"]).alias(f"{side}_box"))

    top = boxes.agg(F.max("block")).first()[0]
    shift = 0
    while top >> shift:
        shift += SPLIT
    pairs = vectors.sparkSession.range(1).select(F.col("id").alias("a"), F.col("id").alias("b"))
    gap = sum((F.pow(F.greatest(F.lit(0.0), F.col(f"b_box.lo{k}") - F.col(f"a_box.hi{k}"), F.col(f"a_box.lo{k}") - F.col(f"b_box.hi{k}")), 2)
               for k in range(boxed + 1)), F.lit(0.0))
    while shift:
        shift -= SPLIT
        parts = F.sequence(F.lit(0), F.lit((1 << SPLIT) - 1))
        pairs = pairs.select(F.explode(F.transform(parts, lambda x: F.col("a") * (1 << SPLIT) + x)).alias("a"), "b")
        pairs = pairs.select("a", F.explode(F.transform(parts, lambda x: F.col("b") * (1 << SPLIT) + x)).alias("b")).where("a <= b")
        here = level(shift)
        pairs = cut(pairs.join(sided(here, "a"), "a").join(sided(here, "b"), "b").where(gap <= far * far).select("a", "b"))
    if not top:
        pairs = vectors.sparkSession.range(1).select(F.col("id").alias("a"), F.col("id").alias("b"))
    tiles = pairs.select(F.xxhash64("a", "b").alias("tile"), "a", F.explode(F.array_distinct(F.array("a", "b"))).alias("block"))
    tiles = tiles.select("tile", "block", (F.col("block") == F.col("a")).alias("one")).join(laid.drop("place"), "block").select("tile", "one", "node", "n", "embedding")

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def make(tables):
            nodes, counts, roots = [], [], []
            for t in tables:
                one = t.column("one").to_numpy()
                node, n = t.column("node").to_numpy(), t.column("n").to_numpy()
                column = t.column("embedding").combine_chunks()
                x, size = _unit(column, width), column.value_lengths().to_numpy(zero_copy_only=False)
                rank = np.argsort(~one, kind="stable")
                node, n, x, size, m = node[rank], n[rank], x[rank], size[rank], int(one.sum())
                if m == len(node):  # a block with itself
                    linked = x @ x.T >= least
                    np.fill_diagonal(linked, False)
                else:
                    half = x[:m] @ x[m:].T >= least
                    if not half.any():
                        continue
                    linked = np.zeros((len(node), len(node)), bool)
                    linked[:m, m:], linked[m:, :m] = half, half.T
                if (size != size[0]).any():
                    linked &= size[:, None] == size[None]
                some = np.flatnonzero(linked.any(1))
                if not len(some):
                    continue
                linked = linked[np.ix_(some, some)]
                label = node[some].copy()
                while True:
                    new = np.minimum(label, np.where(linked, label[None], np.iinfo(np.int64).max).min(1))
                    if (new == label).all():
                        break
                    label = new
                nodes.append(node[some]), counts.append(linked @ n[some]), roots.append(label)
            empty = [np.zeros(0, np.int64)]
            return pa.record_batch({"node": pa.array(np.concatenate(nodes or empty)), "links": pa.array(np.concatenate(counts or empty)),
                                    "root": pa.array(np.concatenate(roots or empty))})

        yield from by_tile(batches, make)

    found = cut(tiles.repartition("tile").sortWithinPartitions("tile").mapInArrow(links, "node long, links long, root long"))
    class_of = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    sums = found.groupBy("node").agg(F.sum("links").alias("links"))
    facts = classes.select("node", "n").join(sums, "node", "left").join(class_of, "node", "left").select(
        "node", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "node").alias("class"))
    named = rows.select("vec_id", "node").join(facts, "node", "left")
    first = named.where("class is not null").groupBy("class").agg(F.min("vec_id").alias("first"))
    component = F.when(F.col("class").isNull(), F.col("vec_id")).otherwise(F.col("first"))
    return named.join(first, "class", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


ORACLE = """
with recursive v as (select vec_id, embedding::double[] as e from embeddings),
pairs as (select a.vec_id as a, b.vec_id as b from v a join v b on a.vec_id != b.vec_id and list_cosine_similarity(a.e, b.e) >= 0.95),
reach as (select vec_id as a, vec_id as b from v union select r.a, p.b from reach r join pairs p on r.b = p.a),
least as (select a, min(b) as component_id from reach group by a),
links as (select a, count(*) as n from pairs group by a)
select l.a as vec_id, coalesce(n, 0)::bigint as n_links, component_id, l.a = component_id as kept from least l left join links on links.a = l.a
"""
