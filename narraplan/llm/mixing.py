"""Mixing sources to target weights by Pareto order sampling.

Targets: sources share a total by weight; a target stops at `most` times its source's size, and what is over is
shared anew among the others until none is above. A source whose target is f times its size gives every document
floor(f) whole copies. The rest is a sample of fixed size without replacement: documents are ranked by
(u / (1 - u)) / (p / (1 - p)), u uniform from an MD5 of seed, doc_id, text and number among equal rows, p the inclusion probability, here f - floor(f),
with odds times the document's own `odds` if given; they are taken in rank order as long as they fit the remaining
words, and one more, the best fit, closes the gap if that brings the total nearer.

No source is ordered as a whole. Sizes are summed per (source, rank bucket), so that only the bucket in which the
target falls is ranked, and the outcome is a threshold per source that every row is held against on its own.

A null or blank text has size 0. The null source comes last and counts as a source. Rows of one doc_id (also null) with
different texts are ranked apart; rows equal in id, text, source (and odds) are numbered, and each number has a rank of its own,
so targets are met with any repeats. In the mix itself one of equal rows stands for all of them, with their copies. Extra
columns are kept. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from narraplan.llm.common import cut, sized

BUCKETS = 4096
NUMBERED = 1 << 16
WORDS = r"[^\x20\x09-\x0D]+"


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """(source, source_size, target) from (source, source_size); weights repeat in code point order, null last."""
    place = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(w).cast("long") for w in weights])
    got = sizes.withColumn("place", F.row_number().over(place)).withColumn(
        "w", F.element_at(cycle, (F.pmod(F.col("place") - 1, F.lit(len(weights))) + 1).cast("int")))
    order = Window.orderBy(F.col("source_size") / F.col("w"), "place")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.partitionBy(F.lit(1))
    got = got.withColumn("left", F.sum("source_size").over(every) - most * F.coalesce(F.sum("source_size").over(before), F.lit(0)))
    got = got.withColumn("share", F.sum("w").over(onward))
    first = F.when(F.col("left") * F.col("w") <= most * F.col("source_size") * F.col("share"), F.struct(
        F.col("source_size") / F.col("w"), "place", (F.col("left") / F.col("share")).alias("per")))
    got = got.withColumn("per", F.min(first).over(every)["per"])
    cap = (most * F.col("source_size")).cast("double")
    return got.select("source", "source_size", F.coalesce(F.least(cap, F.col("per") * F.col("w")), cap).alias("target"))


def _facts(docs: DataFrame, odds: str | None) -> list:
    """doc_id, source, size, digest of the text and odds of each row."""
    return [F.col("doc_id").cast("long").alias("doc_id"), F.col("source").alias("source"),
            F.coalesce(F.regexp_count("text", F.lit(WORDS)), F.lit(0)).cast("long").alias("size"),
            F.md5(F.coalesce("text", F.lit(""))).alias("digest"), (F.col(odds).cast("double") if odds else F.lit(1.0)).alias("odds")]


def _draw(seed: str) -> F.Column:
    """u of a row, uniform between 0 and 1, from an MD5 of the seed, its id, its text and its number among equal rows."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"), "digest", F.lit(":"), F.col("nth").cast("string"))
    return (F.conv(F.substring(F.md5(name), 1, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << 52))


def _numbered(docs: DataFrame, seed: str, odds: str | None) -> DataFrame:
    """Facts of all rows, equal ones counted map-side and then numbered; blocks of NUMBERED of them go to tasks of their own."""
    same = ["doc_id", "source", "size", "digest", "odds"]
    groups = docs.select(*_facts(docs, odds)).groupBy(*same).agg(F.count("*").alias("equal"))
    blocks = groups.withColumn("block", F.explode(F.expr(f"sequence(0L, (equal - 1) div {NUMBERED})"))).repartition("digest", "block")
    nth = F.explode(F.expr(f"sequence(block * {NUMBERED} + 1, least(equal, (block + 1) * {NUMBERED}))"))
    return cut(blocks.withColumn("nth", nth).withColumn("u", _draw(seed)).drop("block"))


def _ranked(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Rows with their source's facts, their rank key and its bucket."""
    got = rows.join(sources, F.col("source").eqNullSafe(F.col("its")), "left")
    got = got.withColumn("key", F.when(F.col("p") > 0, (F.col("u") / (1 - F.col("u"))) / (F.col("p") / (1 - F.col("p")) * F.col("odds"))))
    return got.withColumn("bucket", F.floor(F.col("key") / (1 + F.col("key")) * BUCKETS)).withColumn(
        "row", F.struct("key", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("id"), "digest", "nth"))


def _within() -> F.Column:
    """Whether a row's rank lies in the part of its source that is taken."""
    at = F.col("row") <= F.col("edge")
    return F.col("open").isNull() | (F.col("bucket") < F.col("open")) | ((F.col("bucket") == F.col("open")) & F.coalesce(at, F.lit(False)))


def thresholds(light: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """One row a source, from the facts of all rows: target, whole copies, p and where the sample ends."""
    sources = source_targets(light.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
    sources = sized(cut(sources.withColumn("f", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)).select(
        F.col("source").alias("its"), "source_size", "target", F.floor("f").alias("whole"), (F.col("f") - F.floor("f")).alias("p"))))
    drawn = _ranked(light, sources).where("p > 0")
    sums = drawn.groupBy("its", "bucket").agg(F.sum("size").alias("words"), F.first(F.col("target") - F.col("whole") * F.col("source_size")).alias("need"))
    sums = sums.withColumn("upto", F.sum("words").over(Window.partitionBy("its").orderBy("bucket")))
    fits = sized(cut(sums.groupBy(F.col("its").alias("of")).agg(
        F.first("need").alias("need"), F.coalesce(F.max(F.when(F.col("upto") <= F.col("need"), F.col("upto"))), F.lit(0)).alias("base"),
        F.min(F.when(F.col("upto") > F.col("need"), F.col("bucket"))).alias("open"))))
    same = F.col("its").eqNullSafe(F.col("of"))
    run = F.sum("size").over(Window.partitionBy("its").orderBy("row"))
    opened = drawn.join(fits, same).where("bucket = open").withColumn("upto", F.col("base") + run).where("upto <= need")
    ends = opened.groupBy(F.col("of").alias("at")).agg(F.max("upto").alias("got"), F.max("row").alias("edge"))
    ends = sized(cut(fits.join(ends, F.col("of").eqNullSafe(F.col("at")), "left").select(
        "of", "open", "edge", (F.col("need") - F.coalesce("got", "base")).alias("gap"))))
    miss = F.abs(F.col("gap") - F.col("size"))
    fill = drawn.join(ends, same).where(~_within()).where(miss < F.col("gap")).groupBy(F.col("of").alias("at")).agg(F.min(F.struct(miss.alias("miss"), "row")).alias("fill"))
    ends = ends.join(fill, F.col("of").eqNullSafe(F.col("at")), "left").select(
        "of", "open", "edge", F.col("fill.row").alias("fill"))
    return cut(sources.join(ends, same, "left").drop("of"))


def with_copies(rows: DataFrame, ends: DataFrame) -> DataFrame:
    """Rows that have the facts, with source_size, target and copies."""
    sampled = F.col("key").isNotNull() & (_within() | F.coalesce(F.col("row") == F.col("fill"), F.lit(False)))
    return _ranked(rows, sized(ends)).withColumn("copies", F.col("whole") + F.coalesce(sampled, F.lit(False)).cast("long"))


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: str = "mix", odds: str | None = None) -> DataFrame:
    """The mix itself: each row of docs as often as it is taken, with the columns of docs.

    A row without an equal one is decided where it is. Repeated rows meet the number of copies of all rows equal to them in a
    join, by broadcast while few rows are repeated; one of them stands for all.
    """
    light = _numbered(docs, seed, odds)
    ends = cut(thresholds(light, weights, most))
    again = cut(with_copies(light.where("equal > 1"), ends).groupBy("doc_id", "source", "digest").agg(
        F.sum("copies").alias("all_copies"), F.lit(True).alias("repeated")))
    rows = docs.select(F.struct(*docs.columns).alias("_row"), *_facts(docs, odds), F.lit(1).cast("long").alias("nth")).withColumn("u", _draw(seed))
    rows = with_copies(rows, ends).select("_row", "doc_id", "source", "digest", "copies")
    same = [rows[c].eqNullSafe(again[c]) for c in ("doc_id", "source", "digest")]
    rows = rows.join(sized(again), same[0] & same[1] & same[2], "left").select(
        "_row", *[rows[c] for c in ("doc_id", "source", "digest", "copies")], "all_copies", "repeated")
    one = rows.where("repeated").dropDuplicates(["doc_id", "source", "digest"]).select("_row", F.col("all_copies").alias("copies"))
    chosen = rows.where("repeated is null").select("_row", "copies").unionByName(one)
    return chosen.where("copies > 0").select("_row", F.explode(F.expr("array_repeat(0, cast(copies as int))"))).select("_row.*")


def mix_report(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: str = "mix", odds: str | None = None) -> DataFrame:
    """doc_id, size, source_size, target, taken for every document."""
    light = _numbered(docs, seed, odds)
    rows = with_copies(light, thresholds(light, weights, most))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


ORACLE = """
with sized as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::bigint as size,
    ((('0x' || substr(md5('mix:' || coalesce(doc_id::varchar, 'null') || ':' || h || ':' || nth::varchar), 1, 13))::bigint) + 0.5::double) / 4503599627370496::double as u, h, nth
  from (select *, row_number() over (partition by doc_id, source, h) as nth from (select *, md5(coalesce(text, '')) as h from documents))),
sums as (select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) as place from sized group by source),
weighed as (select *, [1, 2, 3][(place - 1) % 3 + 1]::bigint as w from sums),
filled as (
  select *, (sum(source_size) over () - 3 * coalesce(sum(source_size) over (order by source_size::double / w, place rows between unbounded preceding and 1 preceding), 0))::bigint as spare,
    (sum(w) over (order by source_size::double / w, place rows between current row and unbounded following))::bigint as share
  from weighed),
rate as (select arg_min(spare::double / share, (source_size::double / w, place)) as per from filled where spare * w <= 3 * source_size * share),
targets as (
  select source, source_size, coalesce(least((3 * source_size)::double, per * w), (3 * source_size)::double) as target from filled, rate),
parts as (
  select *, case when source_size > 0 then target / source_size::double else 0.0::double end as f from targets),
keyed as (
  select s.doc_id, s.source, h, nth, size, source_size, target, floor(f)::bigint as whole, target - floor(f) * source_size as need,
    (u / (1 - u)) / ((f - floor(f)) / (1 - (f - floor(f)))) as key, f - floor(f) as p
  from sized s join parts p on s.source is not distinct from p.source),
run as (select *, case when p > 0 then sum(size) over (partition by source, p > 0 order by key, doc_id, h, nth) end as upto from keyed),
gaps as (select source, max(need) - coalesce(max(case when upto <= need then upto end), 0) as gap from run where p > 0 group by source),
best as (
  select r.source, arg_min((doc_id, h, nth), (abs(gap - size), key, doc_id, h, nth)) as fill from run r join gaps g on r.source is not distinct from g.source
  where p > 0 and upto > need and abs(gap - size) < gap group by r.source)
select r.doc_id, size, source_size, target, (size * (whole + case when p > 0 and (upto <= need or (doc_id, h, nth) = fill) then 1 else 0 end))::bigint as taken
from run r left join best b on r.source is not distinct from b.source
"""
