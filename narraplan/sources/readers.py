"""Scans: script corpora, transcripts, provider payloads, plans. All schemas are explicit."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import lexicon as lx

TRANSCRIPT = T.ArrayType(T.StructType([
    T.StructField("word", T.StringType()),
    T.StructField("start", T.DoubleType()),
    T.StructField("end", T.DoubleType()),
]))
PLAN_ROW = T.StructType([
    T.StructField("scene", T.LongType()),
    T.StructField("start", T.DoubleType()),
    T.StructField("end", T.DoubleType()),
    T.StructField("text", T.StringType()),
    T.StructField("keywords", T.ArrayType(T.StringType())),
])
_FILE_A = "array<struct<file_type:string,link:string,width:int,height:int>>"
PAYLOAD_A = (
    "videos array<struct<id:bigint,url:string,image:string,duration:double,"
    f"video_files:{_FILE_A},video_pictures:array<struct<picture:string>>>>"
)
_FILE_B = "struct<url:string,width:int,height:int,thumbnail:string>"
PAYLOAD_B = (
    "hits array<struct<id:bigint,tags:string,duration:double,"
    f"videos:struct<large:{_FILE_B},medium:{_FILE_B}>>>"
)


def stem_id(path: Column) -> Column:
    """A hash of the file's name without folder and extension: a script, its transcript and its
    plan share it. Give the readers another ``key`` where names repeat in different folders."""
    return F.xxhash64(F.regexp_extract(path, r"([^/]*?)(\.[^./]*)?$", 1))


def _files(spark: SparkSession, path: str, key: Callable[[Column], Column], name: str) -> DataFrame:
    named = spark.read.text(path, wholetext=True).select(
        F.input_file_name().alias("path"), F.col("value").alias(name))
    return named.select(key(F.col("path")).alias("script_id"), "path", name)


def read_scripts(spark: SparkSession, path: str, key: Callable[[Column], Column] = stem_id) -> DataFrame:
    """Text files, one script each: (script_id, path, text)."""
    return _files(spark, path, key, "text")


def scripts_from(table: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    return table.select(F.col(key).alias("script_id"), F.col(text).alias("text"))


def spread(scripts: DataFrame) -> DataFrame:
    """Hash scripts over all cores if their files give fewer partitions than cores.

    Text work costs far more than moving a small input once. A large input is left as read.
    """
    cores = scripts.sparkSession.sparkContext.defaultParallelism
    if scripts.rdd.getNumPartitions() >= cores:
        return scripts
    return scripts.repartition(cores, "script_id")


def transcript_words(transcripts: DataFrame) -> DataFrame:
    """(script_id, words JSON string) to (script_id, asr_idx, token, start_ms, end_ms)."""
    parsed = transcripts.select("script_id", F.from_json("words", TRANSCRIPT).alias("w"))
    trimmed = F.filter(
        F.transform("w", lambda x: F.struct(
            F.regexp_replace(x["word"], r"^\s+|\s+$", "").alias("word"), x["start"].alias("start"),
            x["end"].alias("end"))),
        lambda x: x["word"] != "",
    )
    opened = parsed.select("script_id", F.posexplode_outer(trimmed).alias("asr_idx", "x"))
    return opened.where(F.col("x").isNotNull()).select(
        "script_id",
        F.col("asr_idx").cast("bigint").alias("asr_idx"),
        F.col("x.word").alias("token"),
        F.round(F.col("x.start") * 1000).cast("bigint").alias("start_ms"),
        F.round(F.col("x.end") * 1000).cast("bigint").alias("end_ms"),
    )


def read_transcripts(spark: SparkSession, path: str, key: Callable[[Column], Column] = stem_id) -> DataFrame:
    """One JSON array file per recording, as a word-timing model writes it."""
    return transcript_words(_files(spark, path, key, "words"))


def catalog_a(payloads: DataFrame) -> DataFrame:
    """Nested payload A (column ``payload``) to catalogue rows.

    Takes the landscape mp4 rendition nearest the target width, the first on ties; videos
    without one are dropped.
    """
    video = payloads.select(F.explode_outer(F.from_json("payload", PAYLOAD_A)["videos"]).alias("v"))
    usable = F.filter("v.video_files", lambda f: (
        (f["file_type"] == "video/mp4") & (f["width"] > 0) & (f["height"] > 0)
        & (f["width"] > f["height"])
    ))
    ranked = F.transform(usable, lambda f, i: F.struct(
        F.abs(f["width"] - F.lit(lx.TARGET_WIDTH)).alias("off"), i.alias("pos"), f.alias("file")))
    n = F.size("v.video_pictures")
    middle = F.floor(n / 2).cast("int")
    pictures = F.when(n > 0, F.array(
        F.try_element_at("v.video_pictures", middle + 1)["picture"],
        F.when(n - 1 != middle, F.try_element_at("v.video_pictures", n)["picture"]),
    )).otherwise(F.array().cast("array<string>"))
    thumbs = F.filter(
        F.concat(F.array(F.col("v.image")), pictures), lambda t: t.isNotNull() & (t != "")
    )
    return (
        video.withColumn("_f", F.array_min(ranked)["file"])
        .where(F.col("_f").isNotNull())
        .select(
            F.lit("A").alias("source"),
            F.col("v.id").cast("string").alias("video_id"),
            F.col("_f.link").alias("url"),
            F.col("_f.width").alias("width"),
            F.col("_f.height").alias("height"),
            F.coalesce("v.duration", F.lit(0.0)).alias("duration_s"),
            F.coalesce("v.url", F.lit("")).alias("desc"),
            F.slice(thumbs, 1, 3).alias("thumbs"),
        )
    )


def catalog_b(payloads: DataFrame) -> DataFrame:
    """Nested payload B to catalogue rows: the large rendition, else the medium one."""
    hit = payloads.select(F.explode_outer(F.from_json("payload", PAYLOAD_B)["hits"]).alias("h"))
    return (
        hit.withColumn("_f", F.coalesce("h.videos.large", "h.videos.medium"))
        .where((F.col("_f.url") != "")
               & (F.coalesce("_f.width", F.lit(0)) > F.coalesce("_f.height", F.lit(0))))
        .select(
            F.lit("B").alias("source"),
            F.col("h.id").cast("string").alias("video_id"),
            F.col("_f.url").alias("url"),
            F.col("_f.width").alias("width"),
            F.coalesce("_f.height", F.lit(0)).alias("height"),
            F.coalesce("h.duration", F.lit(0.0)).alias("duration_s"),
            F.coalesce("h.tags", F.lit("")).alias("desc"),
            F.array(F.coalesce("_f.thumbnail", F.lit(""))).alias("thumbs"),
        )
    )


def union_catalogs(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b)


def plan_entries(plans: DataFrame) -> DataFrame:
    """(script_id, plan JSON array) to rows with their position, which is what edits join on."""
    rows = plans.select(
        "script_id", F.posexplode_outer(F.from_json("plan", T.ArrayType(PLAN_ROW))).alias("pos", "p")
    ).where(F.col("p").isNotNull())
    return rows.select("script_id", F.col("pos").cast("bigint").alias("plan_pos"), "p.*")


def read_plans(spark: SparkSession, path: str, key: Callable[[Column], Column] = stem_id) -> DataFrame:
    """Plan files, one script's JSON array each."""
    return plan_entries(_files(spark, path, key, "plan"))


def read_plan_export(spark: SparkSession, path: str, id_type: str = "bigint") -> DataFrame:
    """What ``sinks.write_plan`` wrote, one object a line, perhaps edited since; rows as ``plan_entries`` gives.

    The position is the rank by scene number, so renumbered scenes keep their order.
    """
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in PLAN_ROW)
    by_scene = Window.partitionBy("script_id").orderBy("scene")
    return spark.read.schema(f"script_id {id_type}, {columns}").json(path).select(
        "script_id", (F.row_number().over(by_scene) - 1).cast("bigint").alias("plan_pos"), *PLAN_ROW.names)
