"""The end-to-end jobs: each is one lazily built plan from input tables to a result table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as lx
from ..functions import text as tx
from ..operators import alignment, captions, catalog, concepts, cues, pauses, planedits, requests, scripts
from ..operators.ordered import cut_lineage
from ..sources import sinks


def planned_scenes(corpus: DataFrame, table: Sequence[concepts.Concept],
                   alternates: Mapping[str, Sequence[str]],
                   target_ms: int = lx.TARGET_SCENE_MS, breaks: tx.Breaks | None = None) -> DataFrame:
    """Scripts to timed scenes with keyword ladders; one shuffle, by script."""
    topics = concepts.script_topics(corpus, table)
    scenes = scripts.bucket_scenes(topics, target_ms, keep=["topic_visual", "topic_anchor"], breaks=breaks)
    return concepts.scene_queries(scenes, table, alternates)


def script_plan(corpus: DataFrame, table, alternates, breaks: tx.Breaks | None = None) -> DataFrame:
    return sinks.plan_export(planned_scenes(corpus, table, alternates, breaks=breaks))


def transcript_plan(corpus: DataFrame, asr: DataFrame, paused: DataFrame | None = None,
                    target_ms: int = lx.TARGET_SCENE_MS) -> DataFrame:
    """Scenes on spoken time with the script's pace, share of matched words and timing (words,
    pauses or pace): a script whose words match nothing is timed by the next way that works.

    The sentence spans feed several readers; ``timed_spans`` has them written.
    """
    spans = alignment.timed_spans(corpus, asr, paused)
    scenes = alignment.bucket_timed_scenes(corpus, spans, target_ms)
    per_script = spans.groupBy("script_id").agg(
        F.round(F.sum("n_words") / F.greatest(F.max_by("end_ms", "sent_idx") / 1000.0, F.lit(1e-6)), 6).alias("pace"),
        F.round(F.sum("n_matched") / F.sum("n_words"), 6).alias("rate"),
        F.first("timing").alias("timing"),
    )
    return scenes.join(per_script, "script_id")


def scored_ladder(scenes: DataFrame, clips: DataFrame, per_query: int | None = lx.RESULTS_PER_QUERY,
                  **classes) -> tuple[DataFrame, DataFrame]:
    """Groups tried per scene signature, and every result scored for every distinct request of them.

    ``per_query`` is the length of a provider's answer; None keeps whatever a search finds. Where
    ``clips`` has a query column, its rows are answers and are scored as they are, without a search.
    """
    # both feed several branches and hold distinct values only, so they are written once
    ladder = cut_lineage(catalog.ladder_rows(catalog.signatures(scenes)))
    if "query" in clips.columns:
        results = catalog.answer_results(clips, **classes)
    else:
        results = catalog.search(ladder, clips, per_query, **classes)
    return ladder, cut_lineage(catalog.score_results(ladder, results))


REQUEST = ["query", "source", "needed_ms"]
FOUND = ["query", "source", "video_id", "score", "result_no"]


def _weak_choices(ladder: DataFrame, scored: DataFrame) -> DataFrame:
    """Results below the floor, in order of preference."""
    passing = F.col("rel") >= catalog.relevance_floor(F.col("query"))
    return catalog.weak_preferences(ladder.select("sig", "group_rank", *REQUEST).join(scored.where(~passing), REQUEST).select(
        "sig", F.lit(1).alias("kind"), "group_rank", *FOUND,
        F.lit("weak").alias("tier"), F.lit(None).cast("double").alias("sim"),
    ))


def scene_choices(scenes: DataFrame, clips: DataFrame, query_emb=None, frame_emb=None,
                  per_query: int | None = lx.RESULTS_PER_QUERY, **classes) -> DataFrame:
    """Ranked clip choices of every scene signature, with similarity when embeddings are given.

    With similarity they are the choices while no clip is used yet; ``unrepeated_picks`` slides on.
    ``query_emb`` is a function from distinct queries to (query, embedding).
    """
    ladder, scored = scored_ladder(scenes, clips, per_query, **classes)
    rows = ladder.select("sig", "group_rank", *REQUEST)
    if query_emb is None:
        ranked = catalog.top_candidates(scored, None)
        first = catalog.text_preferences(rows.join(ranked, REQUEST))
        first = first.withColumn("sim", F.lit(None).cast("double"))
    else:
        top = catalog.top_candidates(scored)
        sims = catalog.frame_similarity(top, query_emb(ladder), frame_emb)
        seen = top.join(sims, ["query", "source", "video_id"])
        first = catalog.similarity_preferences(rows.join(seen, REQUEST))
    strong = first.select("sig", F.lit(0).alias("kind"), "group_rank", *FOUND, "tier", "sim", "pref")
    return strong.unionByName(_weak_choices(ladder, scored))


def unrepeated_picks(scenes: DataFrame, shots: DataFrame, clips: DataFrame, query_emb, frame_emb, seeded: DataFrame | None = None,
                     per_query: int | None = lx.RESULTS_PER_QUERY, **classes) -> DataFrame:
    """The clip of every shot by similarity, without repeats within a script."""
    ladder, scored = scored_ladder(scenes, clips, per_query, **classes)
    ranked = catalog.top_candidates(scored, None)
    sims = catalog.frame_similarity(ranked, query_emb(ladder), frame_emb)
    passing = ladder.select("sig", "group_rank", *REQUEST).join(
        ranked.join(sims, ["query", "source", "video_id"]), REQUEST)
    return catalog.assign_by_similarity(passing, _weak_choices(ladder, scored), scenes, shots, seeded)


def resumed_picks(scenes: DataFrame, shots: DataFrame, clips: DataFrame, query_emb, frame_emb, runs: DataFrame,
                  progress: DataFrame, **classes) -> DataFrame:
    """The clips of scenes that are still to do under their run (script_id, fingerprint), none that the run has used.

    ``progress``: rows of ``sinks.read_progress``. Clips of scenes done under another identity don't count.
    """
    own = ["script_id", "fingerprint"]
    keyed = scenes.join(runs.select(*own), "script_id")
    pending = cut_lineage(planedits.pending_scenes(keyed, progress).drop("fingerprint"))
    seeded = sinks.used_clips(progress).join(runs.select(*own), own, "left_semi").drop("fingerprint")
    left = shots.join(pending.select("script_id", "scene_idx"), ["script_id", "scene_idx"], "left_semi")
    return unrepeated_picks(pending, left, clips, query_emb, frame_emb, seeded, **classes)


def picked_clips(picks: DataFrame) -> DataFrame:
    """(script_id, scene_idx, used_clips) of picks, for a progress table."""
    clip = F.when(F.col("video_id").isNotNull(), F.concat_ws(":", "source", "video_id"))
    return picks.groupBy("script_id", "scene_idx").agg(F.collect_set(clip).alias("used_clips"))


def clip_audit(scenes: DataFrame, clips: DataFrame, query_emb, frame_emb, max_shot_ms: int,
               cues_: Sequence[str], **classes) -> DataFrame:
    """Scenes to picked clips to audit lines; cards take no clip, and a clip listed twice makes one line."""
    timed = scenes.withColumn("n_words", tx.word_count(F.col("text")))
    open_scenes = cues.plan_cards(timed, cues=cues_).where(~F.col("is_card"))
    shots = scripts.expand_shots(
        open_scenes.select("script_id", "scene_idx", F.lit(0).alias("start_ms"),
                           F.col("needed_ms").alias("end_ms")), max_shot_ms)
    picks = unrepeated_picks(scenes, shots, clips, query_emb, frame_emb, **classes)
    described = (
        picks.join(clips.groupBy("source", "video_id").agg(F.min("desc").alias("desc")), ["source", "video_id"])
        .join(scenes.select("script_id", "scene_idx", "text"), ["script_id", "scene_idx"])
        .withColumn("sim", F.coalesce("sim", F.lit(-1.0)))
    )
    return sinks.audit_report(described)


def timed_terms(scenes: DataFrame, word_times: DataFrame | None, terms: Sequence[str],
                keeps: Sequence[str] | None = None) -> DataFrame:
    """Add term (none on cards) and term_ms.

    ``keeps``: columns that go along, written once with the terms; all, if not given.
    """
    termed = scenes.withColumn("term", F.when(~F.col("is_card"), tx.key_term(F.col("text"), terms)))
    return _timed(termed if keeps is None else cut_lineage(termed.select(*keeps, "term")), word_times)


def _timed(termed: DataFrame, word_times: DataFrame | None) -> DataFrame:
    """Add term_ms to scenes with their term."""
    if word_times is None:
        return termed.withColumn("term_ms", F.lit(lx.TERM_DEFAULT_MS).cast("bigint"))
    return captions.term_starts(termed, word_times)


def cue_schedule(scenes: DataFrame, word_times: DataFrame | None = None,
                 terms: Sequence[str] = (), card_cues: Sequence[str] = ()) -> DataFrame:
    """Scenes to the sound cues that remain after spacing, with lead-in times.

    Cards, boundaries and terms feed several branches. Their scenes are written once, without the texts.
    """
    termed = scenes.withColumn("term", tx.key_term(F.col("text"), terms))
    carded = cut_lineage(cues.plan_cards(
        termed, cues=card_cues, keeps=["script_id", "scene_idx", "start_ms", "end_ms", "term"]))
    shown = carded.withColumn("term", F.when(~F.col("is_card"), F.col("term")))
    typed = captions.type_schedule(_timed(shown, word_times))
    spoken = cues.boundary_cues(cues.plan_boundaries(carded), carded)
    return cues.filter_cues(spoken.unionByName(cues.key_cues(typed)))


def caption_schedule(scenes: DataFrame, word_times: DataFrame | None = None) -> DataFrame:
    """Word windows of every caption; estimated where no full word times exist."""
    lengths = scenes.withColumn("duration_ms", F.col("end_ms") - F.col("start_ms"))
    chunks = captions.chunk_captions(lengths, keep=["duration_ms"])
    if word_times is None:
        return captions.clamp_windows(captions.estimated_windows(chunks))
    return captions.scheduled_windows(chunks, word_times)


def pause_plan(sentences: DataFrame, frames: DataFrame, frame_ms: int, min_silence_ms: int) -> DataFrame:
    """Frames and sentences of a recording to sentence times snapped to its pauses."""
    levels = cut_lineage(pauses.silence_thresholds(frames))
    quiet = cut_lineage(pauses.detect_silences(frames, levels, frame_ms, min_silence_ms))
    return pauses.pause_aligned_spans(sentences, quiet, pauses.recordings(frames, frame_ms))


def request_report(log: DataFrame, window_s: int, max_requests: int, month_limit: int,
                   ttl_s: int, tiebreak: str) -> DataFrame:
    """Per provider: requests, throttled ones, refused ones, cache hits and misses."""
    rate = requests.trailing_rate(log, window_s, max_requests, tiebreak).groupBy("provider").agg(
        F.count(F.lit(1)).alias("requests"), F.max("in_window").alias("peak"),
        F.count_if("throttled").alias("throttled"),
    )
    budget = requests.monthly_usage(log, month_limit).groupBy("provider").agg(
        F.sum("refused").alias("refused")
    )
    cache = requests.cache_report(requests.cache_lookups(log, tiebreak, ttl_s))
    return rate.join(budget, "provider").join(cache, "provider")
