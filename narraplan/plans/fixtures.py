"""Tables derived by Spark from the given ones, as inputs of the registered queries.

The corpus is invented prose, so word lists made for English narration are replaced by
short lists of words that occur in it. Everything here covers whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import ordered, requests, scripts
from ..operators.concepts import Concept
from ..sources import readers

CONCEPTS = [
    Concept("erwh", "river at dawn aerial", "river"),
    Concept("attion", "city traffic timelapse", "city"),
    Concept("onre", "forest path walking", "forest"),
    Concept(r"eres\b", "waves on rocky shore", "shore"),
    Concept("onon", "mountain peak clouds", "mountain"),
    Concept("erble", "marble statue close up", "statue"),
    Concept("anan", "market stall fruit", "market"),
    Concept("ersh|ernt", "train passing station", "train"),
    Concept("erea", "field of wheat wind", "field"),
    Concept("ertion", "workshop hands tools", "workshop"),
    Concept("of the", "open book pages", "book"),
    Concept("that", "person walking street", "street"),
]
ALTERNATES = {
    "river at dawn aerial": ["river at dawn aerial", "river bend boats", "slow river reeds"],
    "open book pages": ["open book pages", "reading lamp desk", "library shelf hands"],
}
TERMS = ["ering", "retion", "thanea", "apache", "license"]
NUMBERS = {
    "small": ["the", "of", "is"], "big": ["with", "that"], "connectors": ["and", "by"],
    "units": ["it", "are", "be"],
}
CARD_CUES = ["the", "and", "of th"]
PERSONS, ANIMALS = ["gizmo", "widget"], ["anvil", "rod"]
FRAME_MS = 1000
RATE_WINDOW_S, RATE_MAX = 3600, 5
MONTH_LIMIT = 1500
TTL_S = 24 * 3600
CUE_GAP_MS = 2 * 3600 * 1000
TIME_BLOCK_US = 600 * requests.US


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def corpus(spark, sf) -> DataFrame:
    return readers.spread(readers.scripts_from(table(spark, sf, "documents")))


def scenes(spark, sf) -> DataFrame:
    return scripts.bucket_scenes(corpus(spark, sf))


def word_times(spark, sf) -> DataFrame:
    """400 ms a word and a 600 ms pause after each sentence."""
    start = F.col("word_idx") * 400 + F.col("sent_idx") * 600
    return scripts.script_words(corpus(spark, sf)).select(
        "*", start.alias("start_ms"), (start + 380).alias("end_ms")
    )


def heard_words(spark, sf) -> DataFrame:
    """(script_id, heard): what a transcript has of a script's words, an array of (word_idx, token, start_ms, end_ms, noise).

    Scripts travel as texts and are opened in their row; texts that share an id make one transcript.
    """
    texts = corpus(spark, sf).groupBy("script_id").agg(F.collect_list("text").alias("_texts"))

    def words(text):
        of_sentence = F.transform(tx.sentences(text), lambda s, i: F.transform(
            tx.tokens(s), lambda t: F.struct(i.cast("bigint").alias("sent"), t.alias("token"))))

        def timed(w, i):
            start = i.cast("bigint") * 400 + w["sent"] * 600
            return F.struct(
                i.cast("bigint").alias("word_idx"), w["token"].alias("token"), start.alias("start_ms"),
                (start + 380).alias("end_ms"),
                F.pmod(i.cast("bigint") * 7919 + F.col("script_id"), F.lit(23)).alias("noise"))

        return F.filter(F.transform(F.flatten(of_sentence), timed), lambda w: w["noise"] != 3)

    every = F.flatten(F.transform("_texts", words))
    return texts.select("script_id", F.when(F.size("_texts") > 1, F.array_sort(every)).otherwise(every).alias("heard"))


def asr_words(spark, sf) -> DataFrame:
    """A transcript that misses some script words and mishears others."""
    word = F.col("_w")
    token = F.when(word["noise"] == 7, F.concat(F.lit("zz"), word["word_idx"])).otherwise(word["token"])
    return heard_words(spark, sf).select("script_id", F.posexplode_outer("heard").alias("_n", "_w")).where(
        word.isNotNull()).select(
        "script_id", F.col("_n").cast("bigint").alias("asr_idx"), token.alias("token"),
        word["start_ms"].alias("start_ms"), word["end_ms"].alias("end_ms"))


def event_frames(spark, sf) -> DataFrame:
    """A user's events in time order are the frames of a recording."""
    ev = table(spark, sf, "events").select(
        F.col("user_id").alias("rec_id"), "event_id", "value", requests.micros(F.col("ts")).alias("us")
    )
    numbered = ordered.row_positions(
        ev, ["rec_id"], ["us", "event_id"], F.floor(F.col("us") / F.lit(TIME_BLOCK_US)), "_n"
    )
    frames = numbered.select("rec_id", (F.col("_n") - 1).alias("frame_no"),
                             (F.col("value") / 500.0).alias("rms"))
    # stands for a stored table: its readers should not number the events again
    return ordered.cut_lineage(frames)


def event_samples(spark, sf) -> DataFrame:
    f = event_frames(spark, sf)
    return f.select("rec_id", F.col("frame_no").alias("pos"), F.col("rms").alias("value"))


def request_log(spark, sf) -> DataFrame:
    """Events as requests: the type is the provider, the user the query."""
    return table(spark, sf, "events").select(
        "event_id", F.col("event_type").alias("provider"),
        F.col("user_id").cast("string").alias("query"), "ts",
    )


KINDS = {"click": "impact", "view": "key", "error": "hiss", "signup": "card", "purchase": "whoosh"}


def event_cues(spark, sf) -> DataFrame:
    kind = F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv])
    return table(spark, sf, "events").select(
        F.col("user_id").alias("script_id"), F.col("event_id").alias("seq"),
        F.try_element_at(kind, F.col("event_type")).alias("kind"),
        F.floor(requests.micros(F.col("ts")) / 1000).alias("at_ms"),
    )


WIDTHS = [1280, 1920, 2560, 3840]


def clip_catalog(spark, sf) -> DataFrame:
    """Parts as clips of two providers."""
    key = F.col("p_partkey")
    width = F.element_at(F.array(*map(F.lit, WIDTHS)), (key % 4 + 1).cast("int"))
    return table(spark, sf, "part").select(
        F.when(key % 2 == 0, "A").otherwise("B").alias("source"),
        key.cast("string").alias("video_id"),
        F.concat(F.lit("clip://"), key).alias("url"),
        width.alias("width"),
        (width * 9 / 16).cast("int").alias("height"),
        F.col("p_size").cast("double").alias("duration_s"),
        F.lower(F.concat_ws(" ", "p_name", "p_type")).alias("desc"),
        key.alias("source_rank"),
    )


SCRIPT_ORDERS = 16


def request_scenes(spark, sf) -> DataFrame:
    """Orders as scenes: sixteen neighbouring ones make a script, a part's words the keywords.

    A script so has at most sixteen scenes whatever the data, and numbering them needs no
    window.
    """
    parts = table(spark, sf, "part").select("p_partkey", "p_name", "p_type")
    n_parts = parts.agg((F.max("p_partkey") + 1).alias("_parts"))  # one row
    key = F.col("o_orderkey")
    orders = table(spark, sf, "orders").select("o_orderkey").crossJoin(F.broadcast(n_parts))
    words = F.split("p_name", " ")
    single = F.array_append(words, F.lower("p_type"))
    return (
        orders.withColumn("p_partkey", key * 17 % F.col("_parts"))
        .join(parts, "p_partkey")
        .select(
            F.floor(key / SCRIPT_ORDERS).alias("script_id"),
            (key % SCRIPT_ORDERS).alias("scene_idx"),
            F.concat_ws(" ", F.lit("order"), key, "p_name").alias("text"),
            F.when(key % 5 == 0, single).otherwise(F.concat(F.array("p_name"), words)).alias("keywords"),
            (F.lit(4000) + key % 9 * 1000).cast("bigint").alias("needed_ms"),
        )
    )


def _clip_count(spark, sf) -> DataFrame:
    return table(spark, sf, "embeddings").agg((F.floor(F.max("vec_id") / 3) + 1).alias("_clips"))


def frame_embeddings(spark, sf) -> DataFrame:
    """Three vectors a clip; a catalogue clip takes the vectors at its key modulo their number."""
    frames = table(spark, sf, "embeddings").select(
        F.floor(F.col("vec_id") / 3).alias("_clip"), "embedding"
    )
    clips = clip_catalog(spark, sf).crossJoin(F.broadcast(_clip_count(spark, sf)))
    return clips.select(
        "source", "video_id", (F.col("source_rank") % F.col("_clips")).alias("_clip")
    ).join(frames, "_clip").drop("_clip")


def query_embeddings(spark, sf, queries: DataFrame) -> DataFrame:
    """A query takes the vector whose id is its length-weighted letter count modulo their number."""
    n = table(spark, sf, "embeddings").agg((F.max("vec_id") + 1).alias("_n"))
    vec = table(spark, sf, "embeddings").select("vec_id", "embedding")
    code = F.length("query") * 31 + F.ascii("query") * 7
    return (
        queries.select("query").distinct().crossJoin(F.broadcast(n))
        .withColumn("vec_id", (code % F.col("_n")).cast("bigint"))
        .join(vec, "vec_id").select("query", "embedding")
    )
