"""Recordings: frame energy, silences, and sentence bounds snapped to pauses.

A recording is a log key of no known size, so its windows run in blocks of frames.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import lexicon as lx
from .ordered import exact_percentile, ordered_scan, running_sum

FRAME_BLOCK = 65_536
SPEECH_BLOCK_MS = 600_000


def frame_energy(samples: DataFrame, block: int) -> DataFrame:
    """(rec_id, pos, value) to (rec_id, frame_no, rms); a short last frame is dropped."""
    return (
        samples.groupBy("rec_id", F.floor(F.col("pos") / F.lit(block)).alias("frame_no"))
        .agg(F.count(F.lit(1)).alias("_n"), F.avg(F.col("value") * F.col("value")).alias("_ms"))
        .where(F.col("_n") == block)
        .select("rec_id", "frame_no", F.sqrt(F.col("_ms") + F.lit(1e-12)).alias("rms"))
    )


def decibels(rms: Column) -> Column:
    """Rounded to 9 dp: the last digits of a logarithm differ between engines."""
    return F.round(F.lit(20.0) * F.log10(rms + F.lit(1e-12)), 9)


def silence_thresholds(frames: DataFrame) -> DataFrame:
    """(rec_id, threshold_db): 26 dB under the loud frames, but at least the fixed level."""
    loud = exact_percentile(
        frames.select("rec_id", decibels(F.col("rms")).alias("db")), ["rec_id"], "db", 0.92,
        F.floor("db"), "_p92",
    )
    return loud.select(
        "rec_id",
        F.greatest(F.lit(lx.SILENCE_DB), F.col("_p92") - lx.SILENCE_HEADROOM_DB).alias("threshold_db"),
    )


def recordings(frames: DataFrame, frame_ms: int) -> DataFrame:
    """(rec_id, duration_ms)."""
    return frames.groupBy("rec_id").agg(
        ((F.max("frame_no") + 1) * F.lit(frame_ms)).cast("bigint").alias("duration_ms")
    )


def detect_silences(frames: DataFrame, thresholds: DataFrame, frame_ms: int,
                    min_ms: int = lx.MIN_SILENCE_MS) -> DataFrame:
    """Maximal runs of quiet frames of at least ``min_ms``: (rec_id, start_ms, end_ms).

    The number of loud frames so far names the run a quiet frame belongs to.
    """
    quiet = frames.join(thresholds, "rec_id").select(
        "rec_id", "frame_no", (decibels(F.col("rms")) < F.col("threshold_db")).alias("_quiet")
    )
    runs = running_sum(
        quiet, ["rec_id"], ["frame_no"], F.floor(F.col("frame_no") / F.lit(FRAME_BLOCK)),
        F.when(F.col("_quiet"), 0).otherwise(1), "_run",
    )
    start, end = F.min("frame_no") * frame_ms, (F.max("frame_no") + 1) * frame_ms
    return (
        runs.where("_quiet").groupBy("rec_id", "_run")
        .agg(start.cast("bigint").alias("start_ms"), end.cast("bigint").alias("end_ms"))
        .where(F.col("end_ms") - F.col("start_ms") >= min_ms)
        .drop("_run")
    )


def speech_totals(recs: DataFrame, silences: DataFrame) -> DataFrame:
    """(rec_id, duration_ms, silence_ms, speech_ms)."""
    quiet = silences.groupBy("rec_id").agg(F.sum(F.col("end_ms") - F.col("start_ms")).alias("_q"))
    return recs.join(quiet, "rec_id", "left").select(
        "rec_id",
        "duration_ms",
        F.coalesce("_q", F.lit(0)).cast("bigint").alias("silence_ms"),
        F.greatest(F.col("duration_ms") - F.coalesce("_q", F.lit(0)), F.lit(0)).cast("bigint").alias("speech_ms"),
    )


def speech_before(silences: DataFrame) -> DataFrame:
    """Add speech_ms: what is spoken before each silence."""
    length = F.col("end_ms") - F.col("start_ms")
    block = F.floor(F.col("start_ms") / F.lit(SPEECH_BLOCK_MS))
    summed = running_sum(silences, ["rec_id"], ["start_ms"], block, length, "_quiet")
    return summed.withColumn(
        "speech_ms", (F.col("start_ms") - (F.col("_quiet") - length)).cast("bigint")
    ).drop("_quiet")


def speech_to_wall(targets: DataFrame, silences: DataFrame, recs: DataFrame) -> DataFrame:
    """Add wall_ms to (rec_id, ..., target_ms): the clock time by which so much is spoken.

    A target passes every silence with less speech before it. Targets and silences are put
    on one line and the silence lengths summed along it: no range join, no pairs.
    """
    extra = [c for c in targets.columns if c not in ("rec_id", "target_ms")]
    quiet = speech_before(silences).select(
        "rec_id", F.col("speech_ms").alias("_pos"), F.lit(1).alias("_side"),
        (F.col("end_ms") - F.col("start_ms")).alias("_len"),
        *[F.lit(None).cast(targets.schema[c].dataType).alias(c) for c in extra],
    )
    line = targets.select(
        "rec_id", F.col("target_ms").alias("_pos"), F.lit(0).alias("_side"),
        F.lit(0).cast("bigint").alias("_len"), *extra,
    ).unionByName(quiet)
    block = F.floor(F.col("_pos") / F.lit(SPEECH_BLOCK_MS))
    summed = running_sum(line, ["rec_id"], ["_pos", "_side"], block, F.col("_len"), "_skipped")
    return summed.where(F.col("_side") == 0).join(recs, "rec_id").select(
        "rec_id", *extra, F.col("_pos").alias("target_ms"),
        F.least(F.col("_pos") + F.col("_skipped"), F.col("duration_ms")).cast("bigint").alias("wall_ms"),
    )


def nearby_pauses(bounds: DataFrame, silences: DataFrame, window_ms: int = lx.SNAP_MS) -> DataFrame:
    """Add pauses: (distance, mid) of silences whose middle is closer than ``window_ms``.

    Middles go to cells of the window's width and a bound looks into three cells: an equi
    join. Silences cannot overlap, so a bound meets only a few. Times are doubled to keep
    half-millisecond middles exact.
    """
    wide = 2 * window_ms
    mids = silences.select(
        "rec_id", (F.col("start_ms") + F.col("end_ms")).alias("_mid2")
    ).withColumn("_cell", F.floor(F.col("_mid2") / F.lit(wide)))
    cell = F.floor(F.col("wall_ms") * 2 / F.lit(wide))
    probes = bounds.withColumn("_cell", F.explode(F.array(cell - 1, cell, cell + 1)))
    off = F.abs(F.col("_mid2") - F.col("wall_ms") * 2)
    joined = probes.join(mids, ["rec_id", "_cell"], "left").withColumn(
        "_near", F.when(off < wide, F.struct(off.alias("off2"), F.col("_mid2").alias("mid2")))
    )
    names = [c for c in bounds.columns]
    return joined.groupBy(*names).agg(F.array_sort(F.collect_list("_near")).alias("pauses"))


def _read_out(df: DataFrame) -> list[str]:
    """What a bound belongs to: a recording, or a script where several are read out over one."""
    return [c for c in ("rec_id", "script_id") if c in df.columns]


def clamp_bounds(bounds: DataFrame) -> DataFrame:
    """Add bound_us: snap to the nearest usable pause, then at least 0.3 s after the last bound.

    A pause is usable when its middle lies more than 0.4 s after the last bound.
    """
    adds = T.StructType([T.StructField("bound_us", T.LongType())])

    def step(last, wall_ms, mids):
        last = 0 if last is None else last
        usable = [m for m in mids if m * 500 > last + lx.SNAP_AFTER_PREVIOUS_MS * 1000]
        snapped = usable[0] * 500 if usable else wall_ms * 1000
        bound = max(snapped, last + lx.MIN_BOUND_STEP_MS * 1000)
        return bound, (bound,)

    with_mids = bounds.withColumn("_mids", F.transform("pauses", lambda p: p["mid2"])).drop("pauses")
    return ordered_scan(
        with_mids, _read_out(bounds), ["bound_idx"], ["wall_ms", "_mids"], adds, step
    ).drop("_mids")


def bound_targets(sentences: DataFrame, totals: DataFrame) -> DataFrame:
    """(rec_id, sent_idx, n_words) to inner bounds with their place in speech time.

    Bound k closes sentence k; the last sentence closes with the recording. With a
    script_id beside rec_id any number of scripts may have the same recording.
    """
    script = Window.partitionBy(*_read_out(sentences))
    upto = script.orderBy("sent_idx").rowsBetween(Window.unboundedPreceding, 0)
    return (
        sentences.withColumn("_words", F.sum("n_words").over(upto))
        .withColumn("_all", F.sum("n_words").over(script))
        .withColumn("_last", F.max("sent_idx").over(script))
        .where(F.col("sent_idx") < F.col("_last"))
        .join(totals, "rec_id")
        .select(
            *_read_out(sentences), F.col("sent_idx").alias("bound_idx"),
            # speech share rounded half up, in whole numbers
            F.expr("(2 * _words * speech_ms + _all) div (2 * _all)").alias("target_ms"),
        )
    )


def pause_aligned_spans(sentences: DataFrame, silences: DataFrame, recs: DataFrame) -> DataFrame:
    """(rec_id, sent_idx, start_us, end_us), with script_id if given: sentences tile the recording at its pauses."""
    own = _read_out(sentences)
    targets = bound_targets(sentences, speech_totals(recs, silences))
    walls = speech_to_wall(targets, silences, recs).select(*own, "bound_idx", "wall_ms")
    bounds = clamp_bounds(nearby_pauses(walls, silences))
    ends = bounds.select(*own, F.col("bound_idx").alias("sent_idx"), "bound_us")
    w = Window.partitionBy(*own).orderBy("sent_idx")
    return (
        sentences.select(*own, "sent_idx").join(ends, [*own, "sent_idx"], "left")
        .join(recs, "rec_id")
        .select(
            *own,
            "sent_idx",
            F.coalesce(F.lag("bound_us").over(w), F.lit(0)).cast("bigint").alias("start_us"),
            F.coalesce("bound_us", F.col("duration_ms") * 1000).alias("end_us"),
        )
    )


