"""N-gram Jaccard join: size-banded tiles, bitmap bounds, then exact sorted-array intersection.

Two texts link when their sets of distinct word shingles have a Jaccard similarity of at least num / den. The
join is exact but for equal 64-bit hashes. Its steps:

1. Texts with equal sets are one node (their set's hash), so copies cost nothing further.
2. A set of n shingles can only reach the similarity with a set that shares one of its n - ceil(t n) + 1 rarest
   shingles. "Rare" is any common order; here by counts in a table of 2^18 hashed counters over all texts, so
   passages that many texts share come last. The table's size is fixed, so it is collected and broadcast.
   A pair of Bloom filters (once-seen and twice-seen, merged over tasks, at most SHARED_BITS each) finds the shingles
   that may be among the rarest of two nodes; the others, most of them, are not sent. Once the filter is full
   (from about 60 million shingles on) it lets more and more pass: links stay the same, the shuffle grows.
3. Nodes that share such a shingle form a group. Groups are cut into tiles of bounded size; in a tile nodes are
   in bands of size, and a pair is compared only within num / den of its sizes. Bitmaps of hashed shingles (at
   least two bits a shingle, folded to a common length) bound the overlap from above:
   |x & y| <= |x| - bits of x missing in y. Pairs that pass join candidate blocks by union-find.
4. Blocks, cut into tiles of a bounded number of shingles, carry the sorted sets: pairs that still pass the
   bound are intersected exactly, and only pairs not connected yet, so a tile returns fewer links than nodes.
   No pair list of a group is ever made.

Tiles of a large group: first each chunk with its neighbour. Only if that leaves a group in several components
are the other pairs of chunks compared, and of these only pairs across components.

Null, empty or blank texts have no shingles and link with nothing. Texts with fewer words than a shingle have
one, the whole sequence. Repeated rows and ties of ids are copies. Extra columns are ignored. Rows whose id is
null take part; their component is the smallest id there is among those reachable, or null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from narraplan.llm.common import Words, blocks, by_tile, components, cut, mixed, release, sized, written
from narraplan.llm.line_dedup import SEGMENTS, Filter, filter_bits, merged_words, own_words, segments, tell_twice

COUNTERS = 1 << 18
MARKS = 1 << 24
MET = 1 << 18
#: Most bits of the filter of shared shingles.
SHARED_BITS = 1 << 27
SHARED_PROBES = 1
GROUP_TILE = 256
BLOCK_TILE = 1 << 20
LONGEST_BITMAP = 1 << 17


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def _needed(n: np.ndarray, num: int, den: int) -> np.ndarray:
    """Least overlap that a set of n shingles needs with any partner: ceil(n num / den)."""
    return -(-n * num // den)


def shingle_counts(docs: DataFrame, size: int) -> np.ndarray:
    """Counts of all shingles of all texts in COUNTERS hashed counters."""
    shift = np.uint64(64 - int(COUNTERS).bit_length() + 1)
    width = 1 << 14

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.int64)
        for block in blocks(batches, "text"):
            rows = list(Words(block.column("text")).shingles(size))
            if rows:
                total += np.bincount((np.concatenate(rows) >> shift).astype(np.int64), minlength=COUNTERS)
        for k in range(0, COUNTERS, width):
            part = total[k:k + width]
            if part.any():
                yield pa.record_batch({"at": pa.array([k], pa.int64()), "n": pa.array([part], pa.list_(pa.int64()))})

    parts = docs.select("text").mapInArrow(count, "at long, n array<long>")
    sums = parts.select("at", F.posexplode("n").alias("pos", "n")).where("n > 0").groupBy((F.col("at") + F.col("pos")).alias("at")).agg(F.sum("n").alias("n"))
    table = np.zeros(COUNTERS, np.int64)
    got = sums.toPandas()
    table[got["at"].to_numpy()] = got["n"].to_numpy()
    return table


def _bitmap(shingles: np.ndarray) -> np.ndarray:
    """2^k bits, at least two a shingle and 64 in all; halves can be folded onto each other."""
    bits = min(max(64, 1 << int(2 * len(shingles) - 1).bit_length()), LONGEST_BITMAP)
    out = np.zeros(bits, np.uint8)
    out[(mixed(shingles) & np.uint64(bits - 1)).astype(np.int64)] = 1
    return np.packbits(out, bitorder="little").view(np.uint64)


def _node(shingles: np.ndarray) -> int:
    """A set's hash."""
    return int(_signed(mixed(mixed(shingles).sum(keepdims=True) + np.uint64(len(shingles))))[0])


def _rarest(shingles: np.ndarray, rank: np.ndarray, num: int, den: int) -> np.ndarray:
    """The n - ceil(t n) + 1 rarest shingles of a set, by counters, then by value."""
    shift = np.uint64(64 - int(COUNTERS).bit_length() + 1)
    order = np.argsort((rank[shingles >> shift] << np.uint64(44)) | (shingles >> np.uint64(20)), kind="stable")
    return shingles[order[:len(shingles) - int(_needed(len(shingles), num, den)) + 1]]


class _Met(set):
    """Nodes that a task has met of late, at most MET: copies in its part are treated once."""

    def first(self, node: int) -> bool:
        if node in self:
            return False
        if len(self) >= MET:
            self.clear()
        self.add(node)
        return True


def shared_words(docs: DataFrame, rank, bits: int, size: int, num: int, den: int) -> np.ndarray:
    """Words of a Bloom filter that has every shingle which is among the rarest of two or more nodes."""

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice, met = Filter(bits, probes=SHARED_PROBES), Filter(bits, probes=SHARED_PROBES), _Met()
        for block in blocks(batches, "text"):
            sets = [s for s in Words(block.column("text")).shingles(size) if len(s) and met.first(_node(s))]
            if sets:
                tell_twice(once, twice, np.concatenate([_rarest(s, rank.value, num, den) for s in sets]))
        yield from segments(once, twice)
        release()

    return merged_words(docs.select("text").mapInArrow(seen, SEGMENTS), bits)


def features(docs: DataFrame, counts: np.ndarray, size: int, num: int, den: int) -> DataFrame:
    """Per row: doc_id, text_hash, n, node (hash of the set, null without shingles). Where a task first meets a node that may share
    one of its rarest shingles with another, also its bitmap and these shingles.
    """
    context = docs.sparkSession.sparkContext
    rank = context.broadcast(np.minimum(counts, (1 << 20) - 1).astype(np.uint64))
    bits = filter_bits(int(counts.sum()) * (den - num) // den + 1, SHARED_BITS)
    shared = context.broadcast(shared_words(docs, rank, bits, size, num, den))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, met = Filter(bits, shared.value, SHARED_PROBES), _Met()
        for block in blocks(batches, "text"):
            n, node, sign, first = [], [], [], []
            for s in Words(block.column("text")).shingles(size):
                n.append(len(s))
                node.append(_node(s) if len(s) else None)
                sign.append(None), first.append(None)
                if len(s) and met.first(node[-1]):
                    rarest = _rarest(s, rank.value, num, den)
                    rarest = rarest[known.has(rarest)]
                    if len(rarest):
                        sign[-1], first[-1] = _bitmap(s).tobytes(), _signed(rarest)
            yield pa.record_batch([
                block.column("doc_id"), block.column("text_hash"), pa.array(n, pa.int64()), pa.array(node, pa.int64()),
                pa.array(sign, pa.binary()), pa.array(first, pa.list_(pa.int64())),
            ], names=["doc_id", "text_hash", "n", "node", "bitmap", "rarest"])
        release()

    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(
        make, "doc_id long, text_hash long, n long, node long, bitmap binary, rarest array<long>")


def shared_groups(nodes: DataFrame) -> DataFrame:
    """(grp, node) for rare shingles of several nodes. Groups that fit a tile are named by their members, so equal ones fall together."""
    spread = nodes.select(F.explode("rarest").alias("token"), "node")
    spread = spread.repartition("token").sortWithinPartitions("token", "node")

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest_t = rest_n = np.zeros(0, np.int64)
        long = None

        def out(t, n, last):
            """Emit whole runs; of a run that exceeds a tile at once, under its token."""
            nonlocal long
            edge = np.flatnonzero(np.append(True, t[1:] != t[:-1])) if len(t) else np.zeros(0, np.int64)
            size = np.diff(np.append(edge, len(t)))
            name = _signed(mixed(np.add.reduceat(mixed(n.view(np.uint64)), edge))) if len(edge) else edge
            big = size > GROUP_TILE
            if long is not None and len(edge) and t[0] == long:
                big[0] = True
            name = np.where(big, t[edge], name)
            use = np.repeat((size > 1) | big, size)
            if last and len(edge):
                long = t[-1] if big[-1] else None
            return pa.record_batch({"grp": pa.array(np.repeat(name, size)[use]), "node": pa.array(n[use])})

        for batch in batches:
            t = np.concatenate([rest_t, batch.column(0).to_numpy()])
            n = np.concatenate([rest_n, batch.column(1).to_numpy()])
            if not len(t):
                continue
            # Copies are folded before a run is measured: a run that is cut has more nodes than a tile and bears its token's name.
            keep = np.ones(len(t), bool)
            keep[1:] = (t[1:] != t[:-1]) | (n[1:] != n[:-1])
            t, n = t[keep], n[keep]
            whole = int(np.searchsorted(t, t[-1], "left"))
            if len(t) - whole > 4 * GROUP_TILE:
                whole = len(t)
            yield out(t[:whole], n[:whole], whole == len(t))
            rest_t, rest_n = t[whole:], n[whole:]
        yield out(rest_t, rest_n, False)

    return spread.mapInArrow(runs, "grp long, node long").distinct()


def _folded(maps: list[np.ndarray]) -> dict[int, np.ndarray]:
    """Per bitmap length of the tile, the bitmaps of that length or longer, folded, under the rows' own places."""
    sizes = np.array([len(m) for m in maps])
    out = {}
    for length in np.unique(sizes):
        at = int(np.argmax(sizes >= length))
        table = np.zeros((len(maps), length), np.uint64)
        for r in range(at, len(maps)):
            table[r] = np.bitwise_or.reduce(maps[r].reshape(-1, length), axis=0)
        out[int(length)] = table
    return out


def _pairs(n: np.ndarray, maps: list[np.ndarray], label: np.ndarray, num: int, den: int, exact: Callable | None) -> list[tuple[int, int]]:
    """Links of one tile, its rows in rising size, that connect what `label` keeps apart. label is changed."""
    folded = _folded(maps)
    found = []
    upto = np.searchsorted(n, n * den // num, "right")
    for i in range(len(n) - 1):
        js = np.arange(i + 1, upto[i])
        js = js[label[js] != label[i]]
        if not len(js):
            continue
        table = folded[len(maps[i])]
        least = -(-(n[i] + n[js]) * num // (num + den))
        one, other = table[i], table[js]
        bound = np.minimum(n[i] - np.bitwise_count(one & ~other).sum(1, dtype=np.int64), n[js] - np.bitwise_count(other & ~one).sum(1, dtype=np.int64))
        js, least = js[bound >= least], least[bound >= least]
        if exact is not None and len(js):
            js = js[exact(i, js) >= least]
        for j in js:
            if label[j] != label[i]:
                found.append((i, int(j)))
                label[label == label[j]] = label[i]
    return found


def _paired(tiles: DataFrame, payload: DataFrame, num: int, den: int) -> DataFrame:
    """Rows of tiles (tile, node, label) but for nodes without another of num / den of their size in their tile, and for tiles of
    one label. Sizes alone travel for it, so only nodes that can link take their data along.
    """
    known = tiles.join(payload.select("node", "n"), "node")
    whole = Window.partitionBy("tile")
    by_size = whole.orderBy("n", "node")
    near = known.withColumns({
        "less": F.lag("n").over(by_size), "more": F.lead("n").over(by_size),
        "lo": F.min("label").over(whole), "hi": F.max("label").over(whole)})
    return near.where((F.col("lo") < F.col("hi")) & (
        (F.col("less") * den >= F.col("n") * num) | (F.col("n") * den >= F.col("more") * num))).select("tile", "node", "label")


def compare(tiles: DataFrame, payload: DataFrame, num: int, den: int, exact: bool) -> DataFrame:
    """Links (a, b) of tiles (tile, node, label); payload has (node, n, data): bitmaps, maybe repeated, or sorted sets if exact."""
    if not exact:
        payload = payload.groupBy("node").agg(F.first("n").alias("n"), F.first("data").alias("data"))

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def make(tables):
            ends = []
            for t in tables:
                node, n, label = (t.column(c).to_numpy() for c in ("node", "n", "label"))
                if len(node) < 2 or (label == label[0]).all():
                    continue
                order = np.lexsort((node, n))
                node, n, label = node[order], n[order], label[order].copy()
                data = t.column("data")
                data = [np.frombuffer(data[int(r)].as_buffer(), np.uint64) for r in order]
                test = None
                maps = data
                if exact:
                    maps = [_bitmap(x) for x in data]
                    if len(data) == 2:
                        test = lambda i, js, d=data: np.array([len(np.intersect1d(d[0], d[1], assume_unique=True))])
                    else:
                        words, ids = np.unique(np.concatenate(data), return_inverse=True)
                        at = np.append(0, np.cumsum(n))
                        mark = np.zeros(len(words), bool)

                        def test(i, js, ids=ids, at=at, mark=mark, n=n):
                            mine = ids[at[i]:at[i + 1]]
                            mark[mine] = True
                            take = np.repeat(at[js], n[js]) + np.arange(n[js].sum()) - np.repeat(np.cumsum(n[js]) - n[js], n[js])
                            out = np.add.reduceat(mark[ids[take]].astype(np.int64), np.cumsum(n[js]) - n[js])
                            mark[mine] = False
                            return out

                for i, j in _pairs(n, maps, label, num, den, test):
                    ends.append((node[i], node[j]))
            ends = np.array(ends, np.int64).reshape(-1, 2)
            return pa.record_batch({"a": pa.array(ends[:, 0]), "b": pa.array(ends[:, 1])})

        yield from by_tile(batches, make)
        release()

    rows = _paired(tiles, payload, num, den).join(payload.select("node", "n", "data"), "node").select("tile", "node", "label", "n", "data")
    return rows.repartition("tile").sortWithinPartitions("tile").mapInArrow(links, "a long, b long").distinct()


def linked(members: DataFrame, payload: DataFrame, limit: int, num: int, den: int, exact: bool) -> DataFrame:
    """Links within groups (grp, node, weight), enough to connect what is connected, in tiles of about `limit` weight."""
    members = cut(members)
    total = members.groupBy("grp").agg(F.ceil(F.sum("weight") / limit).alias("chunks"))
    dealt = cut(members.join(total, "grp").select("grp", "node", "weight", "chunks", F.expr("pmod(xxhash64(node), chunks)").alias("chunk")))
    near = F.when(F.col("chunks") > 1, F.array("chunk", F.expr("pmod(chunk + chunks - 1, chunks)"))).otherwise(F.array("chunk"))
    first = dealt.select(F.explode(near).alias("chunk"), "grp", "node").select(
        F.xxhash64("grp", "chunk").alias("tile"), "node", F.col("node").alias("label")).distinct()
    links = cut(compare(first, payload, num, den, exact))
    large = dealt.where("chunks > 1")
    if large.isEmpty():
        return links
    known = components(links)
    labelled = large.join(known, "node", "left").select("grp", "node", "weight", F.coalesce("component", "node").alias("label"))
    open_ = labelled.groupBy("grp").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("grp")
    labelled = cut(labelled.join(open_, "grp"))
    if labelled.isEmpty():
        return links
    own = labelled.groupBy("grp", "label").agg(F.sum("weight").alias("w"))
    many = own.groupBy("grp").agg(F.sum(F.when(F.col("w") < limit, F.col("w")).otherwise(0)).alias("small"))
    parts = own.join(many, "grp").select(
        "grp", "label",
        F.when(F.col("w") < limit, F.lit(None).cast("long")).otherwise(F.col("label")).alias("pure"),
        F.when(F.col("w") < limit, F.greatest(F.lit(1), F.ceil(F.col("small") / limit))).otherwise(F.ceil(F.col("w") / limit)).alias("k"))
    placed = labelled.join(parts, ["grp", "label"]).select(
        "grp", "node", "label", "pure", F.expr("pmod(xxhash64(if(pure is null, label, node)), k)").alias("chunk"))
    placed = cut(placed.withColumn("part", F.xxhash64("pure", "chunk")))
    chunks = placed.select("grp", "pure", "part").distinct()
    other = chunks.select("grp", F.col("pure").alias("pure2"), F.col("part").alias("part2"))
    pairs = chunks.join(other, "grp").where("part <= part2 and (pure is null or pure2 is null or pure != pure2)")
    pairs = pairs.select("grp", F.xxhash64("grp", "part", "part2").alias("tile"), F.explode(F.array_distinct(F.array("part", "part2"))).alias("part"))
    second = placed.join(pairs, ["grp", "part"]).select("tile", "node", "label").distinct()
    # only what is still open takes its payload along
    again = payload.join(sized(cut(placed.select("node").distinct())), "node", "left_semi")
    return cut(links.union(compare(second, again, num, den, exact)))


def _sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(node, n, data) with the sorted shingles of the wanted (text_hash, node). A bitmap of MARKS bits spares most other texts the shuffle."""
    bits = wanted.select(F.expr(f"pmod(text_hash, {MARKS})").alias("bit")).groupBy((F.col("bit") / 62).cast("long").alias("at")).agg(
        F.expr("bit_or(shiftleft(1L, cast(bit % 62 as int)))").alias("bits")).toPandas()
    table = np.zeros(MARKS // 62 + 1, np.int64)
    table[bits["at"].to_numpy(np.int64)] = bits["bits"].to_numpy(np.int64)
    held = docs.sparkSession.sparkContext.broadcast(table)

    @F.arrow_udf("boolean")
    def chosen(hashes: Iterator[pa.Array]) -> Iterator[pa.Array]:
        """Marked texts, of copies in a task the first; texts themselves don't leave the JVM."""
        met: set[int] = set()
        for batch in hashes:
            h = batch.to_numpy(zero_copy_only=False)
            bit = h % MARKS
            use = (held.value[bit // 62] >> (bit % 62)) & 1 == 1
            for k in np.flatnonzero(use).tolist():
                use[k] = h[k] not in met
                met.add(h[k])
            if len(met) > MET:
                met.clear()
            yield pa.array(use)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text"):
            sets = list(Words(block.column("text")).shingles(size))
            yield pa.record_batch([block.column("node"), pa.array([len(s) for s in sets], pa.int64()),
                                   pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "n", "data"])

    some = docs.select("text", F.xxhash64("text").alias("text_hash")).where(chosen.asNondeterministic()("text_hash"))
    return some.join(wanted, "text_hash").dropDuplicates(["text_hash"]).select("node", "text").mapInArrow(make, "node long, n long, data binary")


def jaccard_classes(docs: DataFrame, size: int = 5, num: int = 75, den: int = 100) -> DataFrame:
    """doc_id, text_hash, n_shingles and class (null without shingles) of every row of docs (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    base = written(features(docs, shingle_counts(docs, size), size, num, den), "shingles")
    nodes = base.where("node is not null").groupBy("node").agg(F.min("text_hash").alias("text_hash"), F.first("n").alias("n"))
    groups = shared_groups(base.where("rarest is not null")).select("grp", "node", F.lit(1).alias("weight"))
    maps = base.where("bitmap is not null").select("node", "n", F.col("bitmap").alias("data"))
    bounds = components(linked(groups, maps, GROUP_TILE, num, den, False))
    members = cut(bounds.join(nodes, "node").select(F.col("component").alias("grp"), "node", F.col("n").alias("weight"), "text_hash"))
    sets = cut(_sets(docs, members.select("text_hash", "node"), size))
    links = linked(members.select("grp", "node", "weight"), sets, BLOCK_TILE, num, den, True)
    return base.select("doc_id", "text_hash", "n", "node").join(components(links), "node", "left").select(
        "doc_id", "text_hash", F.col("n").alias("n_shingles"), F.coalesce("component", "node").alias("class"))


def jaccard_components(docs: DataFrame, size: int = 5, num: int = 75, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs (doc_id, text)."""
    named = jaccard_classes(docs, size, num, den)
    least = named.where("class is not null").groupBy("class").agg(F.min("doc_id").alias("least"))
    return named.join(least, "class", "left").select(
        "doc_id", "n_shingles", F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"))


def _known(keys: DataFrame):
    """Broadcast Bloom filter over (doc_id, text_hash), of a bounded size."""
    bits = filter_bits(keys.count())
    marks = keys.select(_mark("doc_id", "text_hash"))
    return bits, keys.sparkSession.sparkContext.broadcast(merged_words(own_words(marks, bits), bits))


def _mark(doc_id, text_hash):
    return F.xxhash64(F.coalesce(doc_id, F.lit(-1)), text_hash)


def deduplicated(docs: DataFrame, size: int = 5, num: int = 75, den: int = 100) -> DataFrame:
    """One row of each class, with all columns of docs: the smallest doc_id, null last, then text hash. Rows without shingles all stay.

    Two Bloom filters over row keys let nearly all texts stay or go where they are: a key that the filter of kept keys
    doesn't know goes, one that the filter of other and of repeated keys doesn't know stays. The few in both are decided
    by an exact join.
    """
    columns = docs.columns
    classes = cut(jaccard_classes(docs, size, num, den).where("class is not null"))
    first = classes.groupBy("class").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("first"))
    keep = cut(first.select("first.doc_id", "first.text_hash"))
    rows = classes.groupBy("doc_id", "text_hash").agg(F.count("*").alias("n"))
    same = rows["doc_id"].eqNullSafe(keep["doc_id"]) & (rows["text_hash"] == keep["text_hash"])
    others = cut(rows.join(keep.withColumn("kept", F.lit(True)), same, "left").where("kept is null or n > 1").select(
        rows["doc_id"], rows["text_hash"]))
    (keep_bits, kept), (other_bits, other) = _known(keep), _known(others)

    @F.arrow_udf("int")
    def fate(marks: Iterator[pa.Array]) -> Iterator[pa.Array]:
        """0 goes, 1 stays, 2 is in both filters."""
        stays, goes = Filter(keep_bits, kept.value), Filter(other_bits, other.value)
        for batch in marks:
            h = batch.to_numpy(zero_copy_only=False).view(np.uint64)
            yield pa.array(np.where(stays.has(h), 1 + goes.has(h), 0).astype(np.int32))

    keyed = docs.select(F.struct(*columns).alias("_row"), F.col("doc_id").cast("long").alias("_id"), F.xxhash64("text").alias("_hash"),
                        F.coalesce("text", F.lit("")).rlike(r"^[\x20\x09-\x0D]*$").alias("_blank"))
    keyed = keyed.withColumn("_fate", fate(_mark(F.col("_id"), F.col("_hash"))))
    sure = keyed.where(F.col("_blank") | (F.col("_fate") == 1))
    open_ = keyed.where(~F.col("_blank") & (F.col("_fate") == 2))
    wanted = keep.select(F.col("doc_id").alias("_kept"), F.col("text_hash").alias("_kept_hash"))
    found = open_.join(wanted, open_["_id"].eqNullSafe(wanted["_kept"]) & (open_["_hash"] == wanted["_kept_hash"]), "left_semi")
    return sure.select("_row.*").union(found.dropDuplicates(["_id", "_hash"]).select("_row.*"))


ORACLE = r"""
with recursive words as (
  select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
grams as (
  select distinct doc_id, unnest(case when len(w) < 5 then [array_to_string(w, ' ')]
    else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end) as g
  from words where len(w) > 0),
sizes as (select doc_id, count(*) as n from grams group by doc_id),
shared as (select a.doc_id as a, b.doc_id as b, count(*) as k from grams a join grams b on a.g = b.g and a.doc_id != b.doc_id group by all),
links as (
  select a, b from shared join sizes x on x.doc_id = a join sizes y on y.doc_id = b where 100 * k >= 75 * (x.n + y.n - k)),
reach as (select doc_id as a, doc_id as b from documents union select r.a, l.b from reach r join links l on r.b = l.a),
least as (select a, min(b) as component_id from reach group by a)
select a as doc_id, coalesce(n, 0)::bigint as n_shingles, component_id from least left join sizes on doc_id = a
"""
