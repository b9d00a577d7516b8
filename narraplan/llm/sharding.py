"""Sharding by extendible hashing.

Rows are hashed to 60 bits. The directory is indexed by the first bits: a bucket over the byte limit splits on one
more bit, and only such buckets do, until every bucket fits. The directory is built from a histogram of hash
prefixes, a few bits finer than an even split would need: sums of all shorter prefixes come from it, and a bucket is
the shortest prefix that fits. Prefixes still too large in the histogram go on, alone, with more bits.

Bits cannot part rows of one key. A bucket with a single row that is larger than the limit stays as it is. Where all
60 bits are used up, rows of the same hash are dealt into buckets and chained in numbered parts that fit, by size in a bucket. Null keys hash
as the text 'null'; null texts have 0 bytes. Extra columns are kept, whatever their names; a row's shard comes in one struct
column, whose name the caller gives. An empty table gives no shard.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from narraplan.llm.common import cut, free_name, refuse, shared_folder, sized

BITS = 60
CHAIN_SHARDS = 64
CHAIN_ROWS = 1 << 17


def key_hash(key: str) -> Column:
    text = F.coalesce(F.col(key).cast("string"), F.lit("null"))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def _prefix(bits: int) -> Column:
    return F.shiftright("hash", BITS - bits)


def directory(rows: DataFrame, limit: int, finer: int = 4) -> DataFrame:
    """Shards of rows (hash, bytes): bits, cell (hash prefix of that many bits), depth, prefix, shard_bytes, shard_rows.

    One row per filled cell; cells of the same (depth, prefix) make up one shard.
    """
    total = rows.agg(F.sum("bytes")).first()[0] or 0
    low, high = 0, min(BITS, finer + max(0, math.ceil(math.log2(max(1, total / limit)))))
    found = None
    while True:
        cells = cut(rows.groupBy(_prefix(high).alias("cell")).agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n")))
        lines = cells.select("cell", "bytes", "n", F.explode(F.sequence(F.lit(low), F.lit(high))).alias("depth"))
        lines = lines.withColumn("prefix", F.expr(f"shiftright(cell, cast({high} - depth as int))"))
        sums = lines.groupBy("depth", "prefix").agg(F.sum("bytes").alias("shard_bytes"), F.sum("n").alias("shard_rows"))
        fits = sums.where((F.col("shard_bytes") <= limit) | (F.col("shard_rows") == 1) | (F.col("depth") == BITS))
        leaf = lines.join(fits, ["depth", "prefix"]).groupBy("cell").agg(
            F.min(F.struct("depth", "prefix", "shard_bytes", "shard_rows")).alias("leaf"))
        leaf = cut(leaf.select(F.lit(high).alias("bits"), "cell", "leaf.*"))
        found = leaf if found is None else found.union(leaf)
        rest = cells.join(leaf, "cell", "left_anti").select("cell")
        if high == BITS or rest.isEmpty():
            return found
        rows = cut(rows.withColumn("cell", _prefix(high)).join(rest, "cell").select("hash", "bytes"))
        low, high = high, min(BITS, high + 2 * finer)


def assign(docs: DataFrame, key: str = "doc_id", size: Column | None = None, limit: int = 1 << 20, result: str = "shard") -> DataFrame:
    """docs with a struct column `result`: depth, prefix and part name the shard, shard_bytes is its size. size: bytes of a row, by default of its text."""
    columns = docs.columns
    refuse(columns, result)
    shard = F.struct("depth", "prefix", "part", "shard_bytes").alias(result)
    size = F.octet_length("text") if size is None else size
    rows = docs.select(F.struct(*columns).alias("doc"), key_hash(key).alias("hash"), F.coalesce(size, F.lit(0)).cast("long").alias("bytes"))
    # One row a shard, not a cell: it stays small enough to broadcast for longer, as texts go through this join.
    shards = sized(cut(directory(rows.select("hash", "bytes"), limit).select("depth", "prefix", "shard_bytes", "shard_rows").distinct()))
    levels = [r[0] for r in shards.select("depth").distinct().collect()]  # at most BITS + 1 values
    choices = F.array(*[F.struct(F.lit(b).alias("depth"), _prefix(b).alias("prefix")) for b in sorted(levels)]) if levels else F.array()
    if not levels:
        none = rows.withColumns({"depth": F.lit(0), **{c: F.lit(0).cast("long") for c in ("prefix", "part", "shard_bytes")}})
        return none.select("doc.*", shard)
    placed = rows.withColumn("at", F.explode(choices)).select("doc", "hash", "bytes", "at.*").join(shards, ["depth", "prefix"])
    full = (F.col("depth") == BITS) & (F.col("shard_bytes") > limit) & (F.col("shard_rows") > 1)
    open_ = placed.where(~full).withColumn("part", F.lit(0).cast("long"))
    if shards.where(full).isEmpty():
        return open_.select("doc.*", shard)
    chained = _chained(placed.where(full), limit)
    return open_.unionByName(chained).select("doc.*", shard)


def _chained(rows: DataFrame, limit: int) -> DataFrame:
    """Parts of hashes that alone exceed the limit. A hash is dealt into buckets of bounded size; each has parts of its own."""
    buckets = F.ceil(F.col("shard_bytes") / (CHAIN_SHARDS * limit)) + F.floor(F.col("shard_rows") / CHAIN_ROWS)
    # Cut, as copies can only be told apart by their place.
    rows = cut(rows.withColumn("bucket", F.pmod(F.xxhash64(F.monotonically_increasing_id()), buckets)))

    def step(upto):
        return F.greatest(F.lit(0), F.floor((upto - 1) * 2 / limit)).cast("long")

    # Greedy filling is serial; half-limit steps of the running sum fit instead, as no row but a lone one exceeds the limit.
    chain = Window.partitionBy("hash", "bucket").orderBy("bytes").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    stepped = rows.withColumn("step", step(F.sum("bytes").over(chain))).withColumn(
        "shard_bytes", F.sum("bytes").over(Window.partitionBy("hash", "bucket", "step")))
    earlier = Window.partitionBy("hash").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = rows.groupBy("hash", "bucket").agg((step(F.sum("bytes")) + 1).alias("steps")).select(
        "hash", "bucket", F.coalesce(F.sum("steps").over(earlier), F.lit(0)).alias("first"))
    return stepped.join(first, ["hash", "bucket"]).withColumn("part", F.col("first") + F.col("step")).drop("bucket", "step", "first")


def write_shards(docs: DataFrame, path: str, **how) -> None:
    """Write documents into one folder a shard."""
    own = free_name(docs.columns, "shard")
    rows = assign(docs, result=own, **how).withColumn(own, F.concat_ws("-", f"{own}.depth", f"{own}.prefix", f"{own}.part"))
    rows.repartition(own).write.partitionBy(own).parquet(path)


def read_shards(spark: SparkSession, path: str, schema: T.StructType, size: Column) -> DataFrame:
    """Rows of written shards, of this schema, with a struct column like that of `assign`, named shard or, if taken, with signs behind;
    bytes are summed from the rows read."""
    names = schema.fieldNames()
    own, n_bytes, total = (free_name(names, n) for n in ("shard", "row_bytes", "shard_bytes"))
    rows = spark.read.schema(T.StructType([*schema.fields, T.StructField(own, T.StringType())])).parquet(path)
    rows = rows.withColumn(n_bytes, F.coalesce(size, F.lit(0)).cast("long"))
    sums = rows.groupBy(own).agg(F.sum(n_bytes).alias(total))
    name = F.split(own, "-")
    return rows.join(sums, own).select(*[F.col(f"`{c}`") for c in names], F.struct(
        name[0].cast("int").alias("depth"), name[1].cast("long").alias("prefix"), name[2].cast("long").alias("part"), F.col(total).alias("shard_bytes")).alias(own))


def new_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/shards-{uuid.uuid4().hex}"


ORACLE = """
with hashed as (
  select doc_id, coalesce(strlen(text), 0)::bigint as n_bytes, ('0x' || substr(md5(coalesce(doc_id::varchar, 'null')), 1, 15))::bigint as hash from documents),
spread as (select *, d.d, hash >> (60 - d.d)::int as prefix from hashed, range(0, 61) d(d)),
sums as (select d, prefix, sum(n_bytes)::bigint as shard_bytes, count(*) as n from spread group by all),
leaf as (
  select doc_id, n_bytes, min_by((s.d, s.prefix, t.shard_bytes), s.d) as leaf from spread s join sums t on s.d = t.d and s.prefix = t.prefix
  where t.shard_bytes <= 1048576 or t.n = 1 or s.d = 60 group by doc_id, n_bytes)
select doc_id, n_bytes, leaf[1]::int as depth, leaf[2]::bigint as prefix, 0::bigint as part, leaf[3]::bigint as shard_bytes from leaf
"""
