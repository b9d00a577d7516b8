"""Registered queries: one per operator, each over whole tables. (spark, folder) -> DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import (
    abbreviations, alignment, captions, catalog, concepts, cues, ordered, pauses, planedits, requests, scripts,
)
from ..sources import readers, sinks
from ..streaming import jobs
from . import fixtures as fx
from . import pipelines

CLASSES = {"person": fx.PERSONS, "animal": fx.ANIMALS}
SETTINGS = "4.0|2.5|4.5|varied"
MAX_SHOT_MS = 4500


def _joined(col) -> F.Column:
    return F.array_join(col, "|")


def _planned(spark, sf) -> DataFrame:
    return pipelines.planned_scenes(fx.corpus(spark, sf), fx.CONCEPTS, fx.ALTERNATES)


def _tagged(spark, sf) -> DataFrame:
    return concepts.tag_concepts(fx.scenes(spark, sf), fx.CONCEPTS)


# -- sources and sinks -----------------------------------------------------------


def src1_script_scan(spark, sf):
    return fx.corpus(spark, sf).select(
        "script_id", F.length("text").cast("bigint").alias("n_chars"), F.md5("text").alias("text_md5")
    )


def _transcripts(spark, sf):
    """Transcript files as JSON: one array a script, some of its words blank."""
    def file(heard):
        return F.when(F.size(heard) > 0, F.array(F.to_json(F.transform(heard, lambda x: F.struct(
            F.when(x["noise"] == 7, F.lit("  ")).otherwise(x["token"]).alias("word"),
            (x["start_ms"] / 1000.0).alias("start"), (x["end_ms"] / 1000.0).alias("end"))))))

    return fx.heard_words(spark, sf).select(
        "script_id", F.explode_outer(tx.bound(F.col("heard"), file)).alias("words")).where(F.col("words").isNotNull())


def src2_transcript_scan(spark, sf):
    return readers.transcript_words(_transcripts(spark, sf))


def _parts(spark, sf):
    return fx.table(spark, sf, "part").withColumn("k", F.col("p_partkey"))


def _file(kind, link, width, height):
    return F.struct(F.lit(kind).alias("file_type"), F.concat(F.lit(link), "k").alias("link"),
                    width.cast("int").alias("width"), height.cast("int").alias("height"))


def _payload_a(spark, sf):
    """Parts as payloads of provider A: four renditions, up to four pictures, some blank."""
    k = F.col("k")
    wide = F.element_at(F.array(*map(F.lit, fx.WIDTHS)), (k % 4 + 1).cast("int"))
    small = F.lit(960) + k % 3 * 640
    files = F.array(
        _file("video/mp4", "tall", F.lit(1080), F.lit(1920)),
        _file("video/webm", "web", F.lit(1920), F.lit(1080)),
        _file("video/mp4", "wide", wide, F.when(k % 10 == 9, F.lit(None)).otherwise(wide * 9 / 16)),
        _file("video/mp4", "small", small, F.when(k % 10 >= 8, F.lit(0)).otherwise(F.lit(540))),
    )
    pics = F.transform(
        F.slice(F.array(*[F.lit(i) for i in range(5)]), F.lit(1), (k % 5).cast("int")),
        lambda i: F.struct(
            F.when((i + k) % 4 == 0, "").otherwise(F.concat_ws("-", F.lit("pic"), k, i)).alias("picture")))
    video = F.struct(
        k.alias("id"), F.concat(F.lit("https://clips.test/"), F.replace("p_name", F.lit(" "), F.lit("-"))).alias("url"),
        F.when(k % 7 == 0, "").otherwise(F.concat(F.lit("img"), k)).alias("image"),
        F.col("p_size").cast("double").alias("duration"), files.alias("video_files"),
        pics.alias("video_pictures"))
    return _parts(spark, sf).select(F.to_json(F.struct(F.array(video).alias("videos"))).alias("payload"))


def _payload_b(spark, sf):
    k = F.col("k")
    wide = F.element_at(F.array(*map(F.lit, fx.WIDTHS)), (k % 4 + 1).cast("int"))

    def rendition(link, width, height):
        return F.struct(
            F.when(k % 11 == 0, "").otherwise(F.concat(F.lit(link), k)).alias("url"),
            width.cast("int").alias("width"), height.cast("int").alias("height"),
            F.concat(F.lit("thumb"), k).alias("thumbnail"))

    large = F.when(k % 3 != 0, rendition("large", wide, F.when(k % 5 == 0, wide * 2).otherwise(wide * 9 / 16)))
    hit = F.struct(k.alias("id"), F.replace("p_name", F.lit(" "), F.lit(", ")).alias("tags"),
                   F.col("p_size").cast("double").alias("duration"),
                   F.struct(large.alias("large"), rendition("medium", F.lit(1280), F.lit(720)).alias("medium")).alias("videos"))
    return _parts(spark, sf).select(F.to_json(F.struct(F.array(hit).alias("hits"))).alias("payload"))


def _flat(clips):
    return clips.select(
        "source", "video_id", "url", F.col("width").cast("bigint").alias("width"),
        F.col("height").cast("bigint").alias("height"), "duration_s", "desc", _joined("thumbs").alias("thumbs"))


def src3_catalog_a(spark, sf):
    return _flat(readers.catalog_a(_payload_a(spark, sf)))


def src4_catalog_b(spark, sf):
    return _flat(readers.catalog_b(_payload_b(spark, sf)))


def src5_catalog_union(spark, sf):
    both = readers.union_catalogs(
        readers.catalog_a(_payload_a(spark, sf)), readers.catalog_b(_payload_b(spark, sf)))
    return both.groupBy("source", "width").agg(
        F.count(F.lit(1)).alias("n_clips"), F.sum("duration_s").alias("seconds"))


def _flat_plan(plan):
    return plan.select("script_id", "scene", "start", "end", "text", _joined("keywords").alias("keywords"))


def _plan_json(spark, sf):
    plan = pipelines.script_plan(fx.corpus(spark, sf), fx.CONCEPTS, fx.ALTERNATES)
    row = F.struct("scene", "start", "end", "text", "keywords")
    return plan.groupBy("script_id").agg(F.to_json(F.array_sort(F.collect_list(row))).alias("plan"))


def src6_plan_reader(spark, sf):
    rows = readers.plan_entries(_plan_json(spark, sf))
    return rows.select("script_id", "plan_pos", "scene", "start", "end", "text",
                       _joined("keywords").alias("keywords"))


def snk1_plan_export(spark, sf):
    return _flat_plan(sinks.plan_export(_planned(spark, sf)))


def snk2_audit_report(spark, sf):
    return _audit(spark, sf)


def snk3_progress_sink(spark, sf):
    """A first batch, the same retried, changed outputs before and after the batches are gathered; the newest are read back."""
    path = jobs.scratch_folder(spark, "progress")
    done = ordered.cut_lineage(_completed(spark, sf).withColumn("output", F.concat_ws("_", F.lit("scene"), "scene_idx")))
    first = done.withColumn("output", F.concat_ws("_", F.lit("zz"), "scene_idx"))
    sinks.write_progress(first, path, 0)
    sinks.write_progress(first, path, 0)
    sinks.write_progress(done.where(F.col("scene_idx") % 3 == 0), path, 1)
    sinks.compact_progress(spark, path, 1)
    sinks.write_progress(done.where(F.col("scene_idx") % 2 == 0), path, 2)
    return sinks.read_progress(spark, path).drop("used_clips")


# -- projections -----------------------------------------------------------------


def p1_sentence_split(spark, sf):
    """With abbreviations and sentence starters learned from the whole corpus."""
    corpus = fx.corpus(spark, sf)
    return scripts.split_sentences(corpus, abbreviations.learn_breaks(corpus))


def p2_word_tokens(spark, sf):
    return scripts.script_words(fx.corpus(spark, sf))


def p3_token_norm(spark, sf):
    token = F.col("token")
    return (
        scripts.script_words(fx.corpus(spark, sf)).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
        .select("token", "n", tx.norm_word(token).alias("norm"), tx.caption_word(token).alias("caption"),
                tx.letters_only(token).alias("letters"))
    )


def p4_first_keywords(spark, sf):
    return fx.scenes(spark, sf).select(
        "script_id", "scene_idx", _joined(tx.first_keywords(F.col("text"))).alias("keywords"))


def p5_highlight_words(spark, sf):
    return _planned(spark, sf).select(
        "script_id", "scene_idx", _joined(tx.highlight_words(F.col("keywords"))).alias("highlight"),
        _joined(tx.phrase_words(F.col("keywords"))).alias("words"))


def p6_key_term(spark, sf):
    return fx.scenes(spark, sf).select(
        "script_id", "scene_idx", tx.key_term(F.col("text"), fx.TERMS).alias("term"))


def p7_proper_noun(spark, sf):
    return fx.scenes(spark, sf).select(
        "script_id", "scene_idx", tx.proper_noun(F.col("text")).alias("name"))


def p8_number_phrase(spark, sf):
    return fx.scenes(spark, sf).select(
        "script_id", "scene_idx", tx.number_phrase(F.col("text"), **fx.NUMBERS).alias("phrase"),
        tx.callout(F.col("text"), **fx.NUMBERS).alias("callout"))


def p9_technical_score(spark, sf):
    needed = F.explode(F.sequence(F.lit(4), F.lit(12))).alias("needed_s")
    return fx.clip_catalog(spark, sf).select("source", "video_id", "width", "duration_s", needed).select(
        "source", "video_id", F.col("needed_s").cast("bigint").alias("needed_s"),
        F.round(catalog.technical_score(F.col("width"), F.col("duration_s"), F.col("needed_s").cast("double")), 6)
        .alias("score"))


def _ladder(spark, sf):
    return catalog.ladder_rows(fx.request_scenes(spark, sf))


def p10_relevance_floor(spark, sf):
    return _ladder(spark, sf).groupBy("query").agg(F.count(F.lit(1)).alias("n")).select(
        "query", "n", catalog.relevance_floor(F.col("query")).alias("floor"))


def p11_query_ladder(spark, sf):
    return fx.request_scenes(spark, sf).select(
        "script_id", "scene_idx", F.posexplode(catalog.query_ladder(F.col("keywords"))).alias("step", "query")
    ).select("script_id", "scene_idx", F.col("step").cast("bigint").alias("step"), "query")


def p12_provider_order(spark, sf):
    return fx.request_scenes(spark, sf).select(
        "script_id", "scene_idx", _joined(catalog.provider_order(F.col("scene_idx"))).alias("providers"))


def p13_shot_expansion(spark, sf):
    return scripts.expand_shots(fx.scenes(spark, sf), MAX_SHOT_MS).select(
        "script_id", "scene_idx", "shot_idx", "n_shots", "shot_ms")


def _termed(spark, sf):
    plain = fx.scenes(spark, sf).withColumn("is_card", F.lit(False))
    needed = ["script_id", "scene_idx", "start_ms", "end_ms", "first_word", "first_sent", "n_sents"]
    return pipelines.timed_terms(plain, fx.word_times(spark, sf), fx.TERMS, keeps=needed)


def p14_term_start(spark, sf):
    return _termed(spark, sf).select("script_id", "scene_idx", "term", "term_ms")


def p15_type_schedule(spark, sf):
    plain = fx.scenes(spark, sf).withColumn("is_card", F.lit(False))
    return captions.type_schedule(pipelines.timed_terms(plain, None, fx.TERMS)).select(
        "script_id", "scene_idx", "char_idx", "char", "at_ms")


def p16_card_eligible(spark, sf):
    return fx.scenes(spark, sf).select(
        "script_id", "scene_idx", "n_words",
        tx.card_eligible(F.col("scene_idx"), F.col("text"), F.col("n_words"), fx.CARD_CUES).alias("eligible"))


def _fingerprints(spark, sf):
    """One fingerprint a script, with its planned keywords."""
    corpus = fx.corpus(spark, sf)
    return planedits.run_identity(corpus, pipelines.planned_scenes(corpus, fx.CONCEPTS, fx.ALTERNATES), SETTINGS)


def p17_fingerprint(spark, sf):
    return _fingerprints(spark, sf)


# -- joins -----------------------------------------------------------------------


def j1_token_overlap(spark, sf):
    return catalog.token_overlap(_ladder(spark, sf), fx.clip_catalog(spark, sf), **CLASSES).select(
        "query", "source", _joined("words").alias("words"), "rel")


def j2_class_conflict(spark, sf):
    rel = catalog.token_overlap(_ladder(spark, sf), fx.clip_catalog(spark, sf), **CLASSES)
    return rel.where("conflict").groupBy("query", "source").agg(
        F.count(F.lit(1)).alias("n_sets"), F.min("rel").alias("lowest"))


def _answers(spark, sf):
    """What providers answered to the ladder's queries: some of their clips, alike to the query or not.

    Queries of one remainder get the same clips, so clips are numbered before they meet the queries.
    """
    asked = _ladder(spark, sf).select("query", "source").distinct().withColumn("_r", F.length("query") % 97)
    clips = fx.clip_catalog(spark, sf).select(*catalog.CLIP, (F.col("source_rank") % 97).alias("_r"))
    place = Window.partitionBy("source", "_r").orderBy("source_rank")
    numbered = clips.withColumn("result_no", F.row_number().over(place).cast("bigint"))
    return asked.join(numbered, ["source", "_r"]).drop("_r")


def j1_answer_relevance(spark, sf):
    """Relevance of given answers, in the row; an answer without a common word keeps 0 or the penalty."""
    return catalog.answer_results(_answers(spark, sf), **CLASSES).select("query", "source", "video_id", "result_no", "rel")


def j3_concept_tags(spark, sf):
    return _tagged(spark, sf).select("script_id", "scene_idx", "visual", "anchor", "second_visual")


def j4_alternates(spark, sf):
    return concepts.rotate_visuals(_tagged(spark, sf), fx.ALTERNATES).where(
        F.col("visual").isNotNull()).select("script_id", "scene_idx", "visual", "primary")


def _flat_keys(scenes):
    return scenes.select("script_id", "scene_idx", _joined("keywords").alias("keywords"))


def j5_plan_override(spark, sf):
    """The plan written to files, read back, its keywords reversed and applied by position."""
    path = jobs.scratch_folder(spark, "plan-export")
    sinks.write_plan(sinks.plan_export(_planned(spark, sf)), path, buckets=16)
    plan = readers.read_plan_export(spark, path).withColumn("keywords", F.reverse("keywords"))
    return _flat_keys(planedits.override_by_position(_planned(spark, sf), plan))


def _edits(scenes):
    """One scene in five is edited, every tenth edit is blank."""
    at = F.col("script_id") + F.col("scene_idx")
    return scenes.where(at % 5 == 0).select(
        "script_id", "scene_idx",
        F.when(at % 10 == 0, "  ").otherwise(F.concat_ws(" ", F.lit(" edit"), "scene_idx")).alias("edit"))


def j6_first_keyword_edit(spark, sf):
    planned = _planned(spark, sf)
    return _flat_keys(planedits.edit_first_keyword(planned, _edits(fx.scenes(spark, sf))))


def j7_shot_list(spark, sf):
    shot_list = fx.scenes(spark, sf).select(
        "script_id", "scene_idx",
        F.array(F.concat_ws(" ", F.lit("shot"), "scene_idx"), F.lit("backup shot")).alias("shots"))
    return _flat_keys(planedits.apply_shot_list(_planned(spark, sf), shot_list))


def j8_sentence_spans(spark, sf):
    return alignment.sentence_spans(fx.word_times(spark, sf)).select(
        "script_id", "sent_idx", "start_ms", "end_ms", "n_words")


def j9_scene_word_times(spark, sf):
    return alignment.scene_word_times(fx.scenes(spark, sf), fx.word_times(spark, sf)).select(
        "script_id", "scene_idx", "token_idx", "start_ms", "end_ms")


def j10_alignment(spark, sf):
    return alignment.match_words(fx.corpus(spark, sf), fx.asr_words(spark, sf)).select(
        "script_id", "word_idx", "asr_idx")


def _silences(spark, sf, frames):
    levels = ordered.cut_lineage(pauses.silence_thresholds(frames))
    return ordered.cut_lineage(
        pauses.detect_silences(frames, levels, fx.FRAME_MS, 2 * fx.FRAME_MS))


def _rec_sentences(spark, sf):
    """Every document is read out over a recording, in turn by its id."""
    users = fx.table(spark, sf, "events").agg(F.count_distinct("user_id").alias("_users"))
    return scripts.split_sentences(fx.corpus(spark, sf)).crossJoin(F.broadcast(users)).select(
        F.pmod("script_id", "_users").alias("rec_id"), "script_id", "sent_idx", "n_words")


def _walls(spark, sf):
    frames = fx.event_frames(spark, sf)
    silences = _silences(spark, sf, frames)
    recs = pauses.recordings(frames, fx.FRAME_MS)
    targets = pauses.bound_targets(_rec_sentences(spark, sf), pauses.speech_totals(recs, silences))
    return pauses.speech_to_wall(targets, silences, recs), silences


def j11_speech_to_wall(spark, sf):
    return _walls(spark, sf)[0].select("rec_id", "script_id", "bound_idx", "target_ms", "wall_ms")


def j12_nearest_pause(spark, sf):
    walls, silences = _walls(spark, sf)
    near = pauses.nearby_pauses(walls.select("rec_id", "script_id", "bound_idx", "wall_ms"), silences)
    return near.select(
        "rec_id", "script_id", "bound_idx", F.size("pauses").cast("bigint").alias("n_near"),
        F.try_element_at("pauses", F.lit(1))["mid2"].alias("nearest_mid2"))


def _query_vectors(spark, sf):
    return lambda queries: fx.query_embeddings(spark, sf, queries)


def _top(spark, sf):
    ladder = _ladder(spark, sf)
    results = catalog.search(ladder, fx.clip_catalog(spark, sf), **CLASSES)
    return catalog.top_candidates(catalog.score_results(ladder, results))


def j13_similarity(spark, sf):
    pairs = _top(spark, sf).select("query", "source", "video_id")
    return catalog.frame_similarity(
        pairs, fx.query_embeddings(spark, sf, _ladder(spark, sf)), fx.frame_embeddings(spark, sf))


def _completed(spark, sf):
    """Labelled scripts are completed: good ones under their fingerprint, the rest under an old one."""
    labels = fx.table(spark, sf, "labels").select(F.col("doc_id").alias("script_id"), "quality")
    old = F.substring(F.sha2(F.col("fingerprint"), 256), 1, 16)
    return (
        fx.scenes(spark, sf).select("script_id", "scene_idx")
        .join(_fingerprints(spark, sf), "script_id").join(labels, "script_id")
        .select("script_id", F.when(F.col("quality") == 1, F.col("fingerprint")).otherwise(old).alias("fingerprint"),
                "scene_idx")
    )


def j14_pending_work(spark, sf):
    todo = fx.scenes(spark, sf).select("script_id", "scene_idx").join(_fingerprints(spark, sf), "script_id")
    return planedits.pending_scenes(todo, _completed(spark, sf)).select("script_id", "scene_idx", "fingerprint")


def _request_shots(spark, sf):
    timed = fx.request_scenes(spark, sf).select(
        "script_id", "scene_idx", F.lit(0).alias("start_ms"), F.col("needed_ms").alias("end_ms"))
    return scripts.expand_shots(timed, MAX_SHOT_MS)


def j15_no_repeat(spark, sf):
    scenes = fx.request_scenes(spark, sf)
    choices = pipelines.scene_choices(scenes, fx.clip_catalog(spark, sf), **CLASSES)
    return catalog.assign_unrepeated(choices, scenes, _request_shots(spark, sf)).select(
        "script_id", "scene_idx", "shot_idx", "query", "source", "video_id", "tier")


def j16_cache_hits(spark, sf):
    return requests.cache_lookups(fx.request_log(spark, sf), "event_id", fx.TTL_S).select(
        "provider", "query", "event_id", "hit")


# -- aggregations ----------------------------------------------------------------


def a1_dominant_topic(spark, sf):
    return concepts.script_topics(fx.corpus(spark, sf), fx.CONCEPTS).select(
        "script_id", "topic_visual", "topic_anchor")


def a2_match_histogram(spark, sf):
    return catalog.similarity_histogram(j13_similarity(spark, sf), ["source"])


def a3_scene_totals(spark, sf):
    return scripts.scene_totals(fx.scenes(spark, sf))


def a4_speaking_pace(spark, sf):
    return alignment.speaking_pace(alignment.sentence_spans(fx.word_times(spark, sf)))


def a5_mean_similarity(spark, sf):
    """Mean similarity of every query's candidates."""
    return j13_similarity(spark, sf).groupBy("query").agg(
        F.count("sim").alias("n_clips"), F.round(F.avg("sim"), 10).alias("mean_sim"))


def a6_speech_totals(spark, sf):
    frames = fx.event_frames(spark, sf)
    return pauses.speech_totals(pauses.recordings(frames, fx.FRAME_MS), _silences(spark, sf, frames))


def a7_threshold(spark, sf):
    return pauses.silence_thresholds(fx.event_frames(spark, sf)).select(
        "rec_id", F.round("threshold_db", 6).alias("threshold_db"))


def a8_frame_energy(spark, sf):
    return pauses.frame_energy(fx.event_samples(spark, sf), 4).select(
        "rec_id", F.col("frame_no").cast("bigint").alias("frame_no"), F.round("rms", 8).alias("rms"),
        F.round(pauses.decibels(F.col("rms")), 6).alias("db"))


def a9_monthly_budget(spark, sf):
    return requests.monthly_budget(fx.request_log(spark, sf), fx.MONTH_LIMIT, "event_id").select(
        "provider", "month", "event_id", "request_no", "allowed")


def a10_plan_counters(spark, sf):
    """Typed terms, the first five of them and the card scenes of every script."""
    carded = cues.plan_cards(fx.scenes(spark, sf), cues=fx.CARD_CUES)
    return captions.plan_counters(
        pipelines.timed_terms(carded, None, fx.TERMS)
    ).select("script_id", "n_terms", _joined("first_terms").alias("first_terms"),
             _joined("card_scenes").alias("card_scenes"))


def a11_alignment_rate(spark, sf):
    return alignment.alignment_rate(alignment.timed_spans(fx.corpus(spark, sf), fx.asr_words(spark, sf)))


def _aligned(spark, sf):
    return alignment.align_words(fx.corpus(spark, sf), fx.asr_words(spark, sf))


# -- windows ---------------------------------------------------------------------


def w1_running_timeline(spark, sf):
    lengths = fx.scenes(spark, sf).select(
        "script_id", "scene_idx", (F.col("end_ms") - F.col("start_ms")).alias("duration_ms"))
    return scripts.running_timeline(lengths).select("script_id", "scene_idx", "start_ms", "end_ms")


def w2_timeline_tiling(spark, sf):
    spans = alignment.sentence_spans(fx.word_times(spark, sf)).withColumnRenamed("sent_idx", "scene_idx")
    return scripts.tile_timeline(spans).select("script_id", "scene_idx", "start_ms", "end_ms")


def w3_topic_carry(spark, sf):
    return _flat_keys(_planned(spark, sf))


def w4_usage_rotation(spark, sf):
    return concepts.rotate_visuals(_tagged(spark, sf), fx.ALTERNATES).where(
        F.col("visual").isNotNull()).select("script_id", "scene_idx", "visual", "use_no")


def w5_silences(spark, sf):
    return _silences(spark, sf, fx.event_frames(spark, sf))


def w6_gap_filling(spark, sf):
    return _aligned(spark, sf).select(
        "script_id", "word_idx", "matched", "start_ms", "end_ms")


def _chunks(spark, sf):
    lengths = fx.scenes(spark, sf).withColumn("duration_ms", F.col("end_ms") - F.col("start_ms"))
    return captions.chunk_captions(lengths, keep=["duration_ms"])


def w7_estimated_windows(spark, sf):
    return captions.estimated_windows(_chunks(spark, sf)).select(
        "script_id", "scene_idx", "chunk_idx", "word_idx",
        F.round("start_ms", 4).alias("start_ms"), F.round("end_ms", 4).alias("end_ms"))


def w8_timed_windows(spark, sf):
    relative = alignment.scene_word_times(fx.scenes(spark, sf), fx.word_times(spark, sf))
    return captions.timed_windows(_chunks(spark, sf), relative).drop("word")


def w9_trailing_rate(spark, sf):
    return requests.trailing_rate(fx.request_log(spark, sf), fx.RATE_WINDOW_S, fx.RATE_MAX, "event_id").select(
        "provider", "event_id", "in_window", "throttled")


def w10_speech_before(spark, sf):
    return pauses.speech_before(_silences(spark, sf, fx.event_frames(spark, sf)))


# -- top-k and sets --------------------------------------------------------------


def t1_first_scenes(spark, sf):
    return scripts.first_scenes(fx.scenes(spark, sf), 5).select("script_id", "scene_idx", "start_ms", "end_ms")


def t2_top_candidates(spark, sf):
    return _top(spark, sf).select("query", "source", "needed_ms", "cand_rank", "video_id", "rel", "score")


def t3_first_and_best(spark, sf):
    """First keyword, most used visual and longest scene of every script."""
    w = Window.partitionBy("script_id")
    planned = _planned(spark, sf)
    uses = F.count(F.lit(1)).over(Window.partitionBy("script_id", "visual"))
    return planned.select(
        "script_id", "scene_idx", "keywords", "n_words",
        F.when(F.col("visual").isNotNull(), F.struct(uses.alias("uses"), F.col("visual"))).alias("_v"),
    ).groupBy("script_id").agg(
        F.min_by(F.col("keywords")[0], "scene_idx").alias("first_keyword"),
        F.max("_v")["visual"].alias("top_visual"),
        F.max_by("scene_idx", F.struct("n_words", -F.col("scene_idx"))).alias("longest_scene"))


def t4_tiered_pick(spark, sf):
    scenes = fx.request_scenes(spark, sf)
    choices = pipelines.scene_choices(
        scenes, fx.clip_catalog(spark, sf), _query_vectors(spark, sf),
        fx.frame_embeddings(spark, sf), **CLASSES)
    return catalog.best_pick(choices, scenes)


def t5_cue_order(spark, sf):
    return cues.cue_order(fx.event_cues(spark, sf)).select("script_id", "seq", "cue_no")


def _cue_union(spark, sf):
    carded = cues.plan_cards(fx.scenes(spark, sf), cues=fx.CARD_CUES)
    typed = captions.type_schedule(pipelines.timed_terms(carded, None, fx.TERMS))
    spoken = cues.boundary_cues(cues.plan_boundaries(fx.scenes(spark, sf)), carded)
    return spoken.unionByName(cues.key_cues(typed))


def u1_cue_union(spark, sf):
    return _cue_union(spark, sf).select("script_id", "kind", "at_ms")


def u2_ordered_distinct(spark, sf):
    words = F.array_distinct(F.transform(tx.tokens(F.col("text")), tx.norm_word))
    return fx.scenes(spark, sf).select(
        "script_id", "scene_idx", F.md5(F.array_join(words, " ")).alias("distinct_md5"),
        F.size(words).cast("bigint").alias("n_distinct"))


def _scene_candidates(spark, sf, top):
    """The candidates of every scene; scenes go to their script with one list a request, which is opened there."""
    request = ["query", "source", "needed_ms"]
    rows = _ladder(spark, sf).select("script_id", "scene_idx", "group_rank", *request)
    lists = top.groupBy(*request).agg(F.collect_list(F.struct(*[c for c in top.columns if c not in request])).alias("_top"))
    return rows.join(lists, request).repartition("script_id").select(
        "script_id", "scene_idx", "group_rank", *request, F.explode("_top").alias("_x")).select("*", "_x.*").drop("_x")


def u3_unused_candidates(spark, sf):
    """Parts delivered by a script's orders count as clips it has used; those that are no candidate at all can be left out."""
    part = F.col("l_partkey")
    top = ordered.cut_lineage(_top(spark, sf).select("query", "source", "needed_ms", "video_id", "score"))
    used = fx.table(spark, sf, "lineitem").select(
        F.floor(F.col("l_orderkey") / fx.SCRIPT_ORDERS).alias("script_id"),
        F.when(part % 2 == 0, "A").otherwise("B").alias("source"),
        part.cast("string").alias("video_id")).join(top.select("source", "video_id").distinct(), ["source", "video_id"], "left_semi")
    return catalog.without_used(_scene_candidates(spark, sf, top), used).groupBy(
        "script_id", "scene_idx").agg(F.count(F.lit(1)).alias("n_left"), F.max("score").alias("best"))


def u4_shared_words(spark, sf):
    words = F.array_intersect(catalog.query_words(F.col("query")), catalog.desc_words(F.col("text")))
    return _ladder(spark, sf).select(
        "script_id", "scene_idx", "group_rank", _joined(words).alias("shared"))


# -- folds -----------------------------------------------------------------------


def g1_scene_bucketing(spark, sf):
    return fx.scenes(spark, sf).select(
        "script_id", "scene_idx", "text", "n_sents", "n_words", "start_ms", "end_ms")


def g2_timed_bucketing(spark, sf):
    spans = alignment.sentence_spans(fx.word_times(spark, sf))
    return alignment.bucket_timed_scenes(fx.corpus(spark, sf), spans).select(
        "script_id", "scene_idx", "text", "start_ms", "end_ms", "n_sents")


def g3_caption_chunks(spark, sf):
    return _chunks(spark, sf).select(
        "script_id", "scene_idx", "chunk_idx", "first_token", F.array_join("words", " ").alias("words"))


def g4_card_spacing(spark, sf):
    return cues.plan_cards(fx.scenes(spark, sf), cues=fx.CARD_CUES).select("script_id", "scene_idx", "is_card")


def g5_cue_spacing(spark, sf):
    return cues.filter_cues(fx.event_cues(spark, sf), min_gap_ms=fx.CUE_GAP_MS).select(
        "script_id", "seq", "kind", "at_ms", "start_ms")


def g6_labels(spark, sf):
    scenes = fx.scenes(spark, sf)
    styles = cues.plan_boundaries(scenes).select("script_id", "scene_idx", "style")
    return cues.plan_motion(scenes).join(styles, ["script_id", "scene_idx"], "left")


def g7_bound_clamp(spark, sf):
    walls, silences = _walls(spark, sf)
    near = pauses.nearby_pauses(walls.select("rec_id", "script_id", "bound_idx", "wall_ms"), silences)
    return pauses.clamp_bounds(near).select("rec_id", "script_id", "bound_idx", "bound_us")


# -- streams ---------------------------------------------------------------------


def st1_request_rate(spark, sf):
    rates = jobs.run_request_rate(spark, sf, window_s=3600, slide_s=1800, limit=fx.RATE_MAX)
    return rates.select("provider", F.unix_seconds("window_start").alias("window_start_s"), "n", "alert")


def st1_trailing_rate(spark, sf):
    """The exact rate of w9, request by request, as a stream."""
    return jobs.run_trailing_rate(spark, sf, fx.RATE_WINDOW_S, fx.RATE_MAX).withColumnRenamed("seq", "event_id")


def st2_admission(spark, sf):
    """The decisions of a9, request by request, as a stream."""
    return jobs.run_monthly_admission(spark, sf, fx.MONTH_LIMIT).withColumnRenamed("seq", "event_id")


def st6_silence_runs(spark, sf):
    """The silences of w5 as a stream: strictly adjacent frames."""
    levels = ordered.cut_lineage(pauses.silence_thresholds(fx.event_frames(spark, sf)))
    return jobs.run_quiet_runs(spark, sf, levels, fx.FRAME_MS, 2 * fx.FRAME_MS)


def st2_budget_count(spark, sf):
    return jobs.run_budget_count(spark, sf)


def st3_ttl_suppression(spark, sf):
    return jobs.run_spacing(spark, sf, "lookups", fx.TTL_S * 1000, strict=True)


def st4_cool_down(spark, sf):
    return jobs.run_spacing(spark, sf, "cues", fx.CUE_GAP_MS, strict=False)


def st5_incremental_plan(spark, sf):
    return _flat_plan(jobs.run_incremental_plan(spark, sf, fx.CONCEPTS, fx.ALTERNATES))


def st6_silence_sessions(spark, sf):
    return jobs.run_silence_sessions(spark, sf, pauses.silence_thresholds(fx.event_frames(spark, sf)))


# -- pipelines -------------------------------------------------------------------


def c1_script_plan(spark, sf):
    return _flat_plan(pipelines.script_plan(fx.corpus(spark, sf), fx.CONCEPTS, fx.ALTERNATES))


def c2_transcript_plan(spark, sf):
    return pipelines.transcript_plan(fx.corpus(spark, sf), fx.asr_words(spark, sf)).select(
        "script_id", "scene_idx", "text", F.round("start_ms", 3).alias("start_ms"),
        F.round("end_ms", 3).alias("end_ms"), "pace", "rate", "timing")


def _audit(spark, sf):
    return pipelines.clip_audit(
        fx.request_scenes(spark, sf), fx.clip_catalog(spark, sf), _query_vectors(spark, sf),
        fx.frame_embeddings(spark, sf), MAX_SHOT_MS, fx.CARD_CUES, **CLASSES)


def c3_clip_audit(spark, sf):
    return catalog.similarity_histogram(_audit(spark, sf), ["script_id"])


def c4_cue_schedule(spark, sf):
    return pipelines.cue_schedule(fx.scenes(spark, sf), None, fx.TERMS, fx.CARD_CUES).select(
        "script_id", "kind", "at_ms", "start_ms")


def c4_caption_schedule(spark, sf):
    relative = alignment.scene_word_times(fx.scenes(spark, sf), fx.word_times(spark, sf))
    return pipelines.caption_schedule(fx.scenes(spark, sf), relative).select(
        "script_id", "scene_idx", "chunk_idx", "word_idx", "start_ms", "end_ms")


def c5_pause_timing(spark, sf):
    return pipelines.pause_plan(
        _rec_sentences(spark, sf), fx.event_frames(spark, sf), fx.FRAME_MS, 2 * fx.FRAME_MS)


def c6_request_report(spark, sf):
    return pipelines.request_report(
        fx.request_log(spark, sf), fx.RATE_WINDOW_S, fx.RATE_MAX, fx.MONTH_LIMIT, fx.TTL_S, "event_id")


QUERIES = {
    f.__name__: f for name, f in list(globals().items())
    if name.split("_")[0].rstrip("0123456789") in
    {"src", "snk", "p", "j", "a", "w", "t", "u", "g", "st", "c"} and name[-1] != "_"
    and callable(f) and any(ch.isdigit() for ch in name.split("_")[0])
}
