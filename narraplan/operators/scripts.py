"""Scripts to sentences, words and timed scenes. One row per script in, no shuffle.

Arrays made from text are opened with the outer form of explode: for the plain form the
optimizer infers a filter on the array and so would make it twice.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import folds
from ..functions import lexicon as lx
from ..functions import text as tx


def split_sentences(scripts: DataFrame, breaks: tx.Breaks | None = None) -> DataFrame:
    """(script_id, text) to (script_id, sent_idx, text, n_words). ``breaks``: see ``abbreviations.learn_breaks``."""
    return scripts.select(
        "script_id", F.posexplode_outer(tx.sentences(F.col("text"), breaks)).alias("sent_idx", "text")
    ).where(F.col("text").isNotNull()).select(
        "script_id",
        F.col("sent_idx").cast("bigint").alias("sent_idx"),
        "text",
        tx.word_count(F.col("text")).cast("bigint").alias("n_words"),
    )


def script_words(scripts: DataFrame, breaks: tx.Breaks | None = None) -> DataFrame:
    """(script_id, text) to (script_id, word_idx, sent_idx, token); indexes from 0."""
    per_sentence = F.transform(
        tx.sentences(F.col("text"), breaks),
        lambda s, i: F.transform(tx.tokens(s), lambda t: F.struct(i.alias("s"), t.alias("t"))),
    )
    return scripts.select(
        "script_id", F.posexplode_outer(F.flatten(per_sentence)).alias("word_idx", "w")
    ).where(F.col("w").isNotNull()).select(
        "script_id",
        F.col("word_idx").cast("bigint").alias("word_idx"),
        F.col("w.s").cast("bigint").alias("sent_idx"),
        F.col("w.t").alias("token"),
    )


def bucket_scenes(scripts: DataFrame, target_ms: int = lx.TARGET_SCENE_MS,
                  words_per_second: float = lx.WORDS_PER_SECOND,
                  keep: Sequence[str] = (), breaks: tx.Breaks | None = None) -> DataFrame:
    """Scenes of about ``target_ms`` at a speaking pace, timed end to end.

    ``keep`` names script columns to copy to every scene.
    """
    limit = target_ms / 1000.0 * words_per_second
    with_spans = scripts.select(
        "script_id", *keep, tx.sentences(F.col("text"), breaks).alias("_s")
    ).withColumn(
        "_span", folds.scene_spans(F.transform("_s", lambda s: tx.word_count(s)), limit)
    )
    def to_ms(words: Column) -> Column:
        return F.round(words * F.lit(1000.0) / F.lit(words_per_second)).cast("bigint")

    # a scene takes its own sentences along, not the script's: rows wait on disk where Python reads them
    cut = F.transform("_span", lambda x: F.struct(
        F.array_join(tx.part(F.col("_s"), x["first"], x["size"]), " ").alias("text"),
        x["first"].alias("first"), x["size"].alias("size"), x["before"].alias("before"), x["total"].alias("total")))
    return with_spans.select(
        "script_id", *keep, F.posexplode_outer(cut).alias("scene_idx", "_x")
    ).where(F.col("_x").isNotNull()).select(
        "script_id",
        *keep,
        F.col("scene_idx").cast("bigint").alias("scene_idx"),
        F.col("_x.text").alias("text"),
        F.col("_x.first").alias("first_sent"),
        F.col("_x.size").alias("n_sents"),
        F.col("_x.before").alias("first_word"),
        F.col("_x.total").alias("n_words"),
        to_ms(F.col("_x.before")).alias("start_ms"),
        to_ms(F.col("_x.before") + F.col("_x.total")).alias("end_ms"),
    )


def scene_counts(scripts: DataFrame, target_ms: int = lx.TARGET_SCENE_MS,
                 words_per_second: float = lx.WORDS_PER_SECOND) -> DataFrame:
    """Add n_scenes to every script, in its row."""
    limit = target_ms / 1000.0 * words_per_second
    counts = F.transform(tx.sentences(F.col("text")), lambda s: tx.word_count(s))
    return scripts.withColumn("n_scenes", F.size(folds.scene_spans(counts, limit)).cast("bigint"))


def running_timeline(scenes: DataFrame, duration: str = "duration_ms") -> DataFrame:
    """Start and end of each scene from the durations before it."""
    upto = (
        Window.partitionBy("script_id").orderBy("scene_idx")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    end = F.sum(duration).over(upto)
    return scenes.withColumn("end_ms", end).withColumn("start_ms", F.col("end_ms") - F.col(duration))


def tile_timeline(scenes: DataFrame) -> DataFrame:
    """End every scene where the next begins; the last keeps its own end."""
    ordered = Window.partitionBy("script_id").orderBy("scene_idx")
    return scenes.withColumn("end_ms", F.coalesce(F.lead("start_ms").over(ordered), "end_ms"))


def scene_totals(scenes: DataFrame) -> DataFrame:
    """Scene count, spoken milliseconds and minutes per script."""
    return scenes.groupBy("script_id").agg(
        F.count(F.lit(1)).alias("n_scenes"),
        F.sum(F.col("end_ms") - F.col("start_ms")).alias("total_ms"),
        F.round(F.sum(F.col("end_ms") - F.col("start_ms")) / 60000.0, 2).alias("minutes"),
    )


def first_scenes(scenes: DataFrame, n: int) -> DataFrame:
    """The first n scenes of every script; a plain filter, so it reaches the scan."""
    return scenes.where(F.col("scene_idx") < n)


def expand_shots(scenes: DataFrame, max_shot_ms: int,
                 max_shots: int = lx.MAX_SHOTS_PER_SCENE,
                 overlap_ms: int = lx.SHOT_OVERLAP_MS) -> DataFrame:
    """One row per shot; shots of a scene overlap, so their lengths sum to more than it."""
    duration = F.col("end_ms") - F.col("start_ms")
    if max_shot_ms > 0:
        n = F.least(F.lit(max_shots), F.greatest(F.lit(1), F.ceil(duration / F.lit(max_shot_ms))))
    else:
        n = F.lit(1)
    n = n.cast("bigint")
    return (
        scenes.withColumn("n_shots", n)
        .withColumn(
            "shot_ms",
            F.round((duration + F.lit(overlap_ms) * (F.col("n_shots") - 1)) / F.col("n_shots"), 3),
        )
        .withColumn("shot_idx", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_shots") - 1)))
    )
