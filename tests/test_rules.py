"""Hand-computed answers for the rules, and properties that hold on any input."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from narraplan.functions import text as tx
from narraplan.operators import (
    alignment, captions, catalog, concepts, cues, ordered, planedits, requests, scripts,
)
from narraplan.plans import fixtures as fx
from narraplan.plans import queries
from narraplan.sources import sinks


def value(spark, column_of, text):
    return spark.createDataFrame([(text,)], "t string").select(column_of(F.col("t"))).first()[0]


def sentence(n):
    return " ".join(["word"] * n) + "."


def scripts_df(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "script_id long, text string")


def test_scene_bucketing(spark):
    df = scripts_df(spark, " ".join(map(sentence, [4, 6, 1, 12, 3])), "", "  \n ")
    got = [(r.scene_idx, r.n_words, r.start_ms, r.end_ms)
           for r in scripts.bucket_scenes(df).orderBy("scene_idx").collect()]
    assert got == [(0, 10, 0, 4000), (1, 1, 4000, 4400), (2, 12, 4400, 9200), (3, 3, 9200, 10400)]


def test_scenes_keep_every_sentence(spark):
    corpus = fx.corpus(spark, "/root/testdata/sf0.001")
    whole = corpus.select("script_id", F.array_join(tx.sentences(F.col("text")), " ").alias("a"))
    scenes = scripts.bucket_scenes(corpus).groupBy("script_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("scene_idx", "text"))), lambda s: s["text"]), " ").alias("b"))
    assert whole.join(scenes, "script_id").where("a <> b").isEmpty()


@pytest.mark.parametrize("text, want", [
    ("Your kidneys and melatonin", "melatonin"), ("Your kidneys are fine", "kidney"),
    ("we flew over Nevada today", "Nevada"), ("It ended. Nevada is hot", None), ("nothing here", None),
])
def test_key_term(spark, text, want):
    assert value(spark, lambda t: tx.key_term(t, ["melatonin", "kidney"]), text) == want


@pytest.mark.parametrize("text, want", [
    ("He went to Arizona.", "ARIZONA"), ("Done. Arizona is hot", None), ("Go to Élan now", "ÉLAN"),
    ("drink twelve to sixteen ounces daily", "TWELVE TO SIXTEEN OUNCES"), ("two three", None),
    ("one or many", None), ("wait one hour", "ONE HOUR"), ("at ten -- thirty", None),
    ("ten thirty or five minutes", "TEN THIRTY OR FIVE MINUTES"),
])
def test_callout(spark, text, want):
    assert value(spark, tx.callout, text) == want


def test_technical_score(spark):
    df = spark.createDataFrame([(1920, 5.0, 4.0), (1280, 3.0, 4.0)], "w int, d double, n double")
    got = [r[0] for r in df.select(catalog.technical_score(F.col("w"), F.col("d"), F.col("n"))).collect()]
    assert got == pytest.approx([8.0, -4 + 1 - 1 / 3])


def test_class_conflict(spark):
    q = spark.createDataFrame([("man drinking water",)], "query string")
    clips = spark.createDataFrame([("A", "dog drinking water"), ("A", "man, water")], "source string, desc string")
    got = {tuple(r.words): r.rel for r in catalog.token_overlap(q, clips).collect()}
    assert got == {("dog", "drinking", "water"): -2.0, ("man", "water"): 6.0}


def test_query_ladder(spark):
    rows = [(["a b", "c"],), (["x", "y", "z"],), (["x"],), ([],)]
    df = spark.createDataFrame(rows, "k array<string>").select(catalog.query_ladder(F.col("k")))
    assert [r[0] for r in df.collect()] == [["a b", "c"], ["x y z", "x y", "x"], ["x"], []]


def test_concepts_and_accents(spark):
    table = [concepts.Concept(r"\btea\b", "tea cup", "tea"), concepts.Concept("mit", "campus", "university")]
    df = scripts_df(spark, "étea", "a tea", "submit tea")
    got = [r.v for r in df.select(concepts.concept_ids(F.col("text"), table).alias("v")).collect()]
    assert got == [[], [0], [0, 1]]


def test_topic_carry(spark):
    table = [concepts.Concept("sea", "waves", "ocean"), concepts.Concept("sky", "clouds", "sky")]
    alts = {"waves": ["waves", "surf"]}
    rows = [(0, 0, "none"), (0, 1, "sea sky"), (0, 2, "sea"), (0, 3, "none")]
    df = spark.createDataFrame(rows, "script_id long, scene_idx long, text string")
    df = df.withColumn("topic_visual", F.lit("waves")).withColumn("topic_anchor", F.lit("ocean"))
    got = [r.keywords for r in concepts.scene_queries(df, table, alts).orderBy("scene_idx").collect()]
    assert got == [["waves", "ocean"], ["waves", "clouds", "ocean"], ["surf", "waves", "ocean"],
                   ["surf", "waves", "ocean"]]


def test_shots(spark):
    df = spark.createDataFrame([(0, 0, 0, 10_000)], "script_id long, scene_idx long, start_ms long, end_ms long")
    got = scripts.expand_shots(df, 4500).collect()
    assert len(got) == 3 and {r.shot_ms for r in got} == {3500.0}
    assert scripts.expand_shots(df, 0).count() == 1


def test_card_spacing(spark):
    df = spark.createDataFrame([(0, i, "short line", 2) for i in range(10)],
                               "script_id long, scene_idx long, text string, n_words long")
    got = cues.plan_cards(df, cues=[]).where("is_card").select("scene_idx").orderBy("scene_idx").collect()
    assert [r[0] for r in got] == [1, 5, 9]


def test_cue_spacing(spark):
    rows = [(0, 0, "impact", 0), (0, 1, "impact", 1000), (0, 2, "impact", 1200), (0, 3, "key", 1300), (0, 4, "hiss", 9000)]
    df = spark.createDataFrame(rows, "script_id long, seq long, kind string, at_ms long")
    got = [(r.kind, r.at_ms, r.start_ms) for r in cues.filter_cues(df).orderBy("at_ms").collect()]
    assert got == [("impact", 0, 0), ("impact", 1200, 1140), ("key", 1300, 1240)]


def test_cache_ttl(spark):
    hours = [0, 20, 24, 25, 40]
    df = spark.createDataFrame([("A", "q", i, h * 3600) for i, h in enumerate(hours)],
                               "provider string, query string, id long, s long").withColumn("ts", F.timestamp_seconds("s"))
    got = requests.cache_lookups(df, "id").orderBy("id").collect()
    assert [r.hit for r in got] == [False, True, True, False, True]


@pytest.mark.parametrize("strict", [True, False])
@pytest.mark.parametrize("gap", [40, 5000])
def test_block_jumps_give_the_spacing_of_a_scan(spark, strict, gap):
    """A hot key, a null one, ties; only times go along a key, and no job runs before the plan does."""
    rng = random.Random(5)
    rows = [(0 if rng.random() < 0.6 else rng.choice([1, 2, 3, None]), rng.randrange(6000), i) for i in range(1500)]
    df = spark.createDataFrame(rows, "k long, at long, seq long").repartition(5)
    before = spark.sparkContext.statusTracker().getJobIdsForGroup()
    blocks = ordered.spaced_accepts(df, ["k"], "at", ["at", "seq"], gap, strict, "ok")
    assert spark.sparkContext.statusTracker().getJobIdsForGroup() == before
    scan = ordered.spaced_scan(df, ["k"], "at", ["at", "seq"], gap, strict, "ok")
    key = lambda d: sorted(map(repr, d.select("k", "at", "seq", "ok").collect()))
    assert key(blocks) == key(scan)
    assert ordered.spaced_accepts(df.where("k = 9"), ["k"], "at", ["at", "seq"], gap, strict, "ok").count() == 0


@pytest.mark.parametrize("width", [1, 7, 10_000])
def test_blocked_windows_equal_plain_ones(spark, width):
    rng = random.Random(3)
    rows = [(rng.randrange(3), i, rng.randrange(10), rng.randrange(100) if rng.random() < 0.3 else None) for i in range(400)]
    df = spark.createDataFrame(rows, "k long, i long, v long, c long")
    block = F.floor(F.col("i") / width)
    w = Window.partitionBy("k").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy("k").orderBy(F.col("i").desc()).rowsBetween(Window.unboundedPreceding, 0)
    got = ordered.running_sum(df, ["k"], ["i"], block, F.col("v"), "s", total="t")
    got = ordered.carry(got, ["k"], ["i"], block, F.col("c"), "f")
    got = ordered.carry(got, ["k"], ["i"], block, F.col("c"), "b", backward=True)
    want = df.select("*", F.sum("v").over(w).alias("s"), F.sum("v").over(Window.partitionBy("k")).alias("t"),
                     F.last("c", True).over(w).alias("f"), F.last("c", True).over(down).alias("b"))
    key = lambda r: (r["k"], r["i"])
    cols = ["k", "i", "s", "t", "f", "b"]
    assert sorted(got.select(cols).collect(), key=key) == sorted(want.select(cols).collect(), key=key)


def test_percentile_is_exact(spark):
    values = [random.Random(1).uniform(-60, 0) for _ in range(101)] + [-5.0] * 7
    df = spark.createDataFrame([(0, v) for v in values], "k long, v double")
    got = ordered.exact_percentile(df, ["k"], "v", 0.92, F.floor("v"), "p").first().p
    assert got == pytest.approx(np.percentile(values, 92), abs=1e-12)


def test_gap_filling(spark):
    # words 0-2 and 5-7 are heard, 3 and 4 are not
    text = "aa bb cc xx yy dd ee ff"
    heard = [("aa", 0, 200), ("bb", 300, 500), ("cc", 600, 1000), ("dd", 4000, 4200), ("ee", 4300, 4500), ("ff", 4600, 4800)]
    asr = spark.createDataFrame([(0, i, w, s, e) for i, (w, s, e) in enumerate(heard)],
                                "script_id long, asr_idx long, token string, start_ms long, end_ms long")
    got = alignment.align_words(scripts_df(spark, text, "never heard at all"), asr).orderBy("word_idx").collect()
    assert [r.matched for r in got] == [True] * 3 + [False] * 2 + [True] * 3
    assert [(r.start_ms, r.end_ms) for r in got[3:5]] == [(2000.0, 3000.0), (3000.0, 4000.0)]


def test_repeated_phrase_keeps_times_in_order(spark):
    asr = spark.createDataFrame([(0, i, w, i * 100, i * 100 + 90) for i, w in enumerate("x y z u".split())],
                                "script_id long, asr_idx long, token string, start_ms long, end_ms long")
    got = alignment.match_words(scripts_df(spark, "x y z y z u"), asr).orderBy("word_idx").collect()
    assert [r.asr_idx for r in got] == sorted({r.asr_idx for r in got})


def test_caption_chunks(spark):
    df = spark.createDataFrame([(0, 0, "One. Two three. " + " ".join("abcdefgh") + " " + "w" * 30 + " " + "v" * 30 + " " + "u" * 30)],
                               "script_id long, scene_idx long, text string")
    got = [len(r.words) for r in captions.chunk_captions(df).orderBy("chunk_idx").collect()]
    # "One." alone does not close a chunk; seven words do; a third line moves on
    assert got == [3, 7, 3, 1]


def test_plan_override_errors(spark):
    scenes = spark.createDataFrame([(0, 0, ["a"]), (0, 1, ["b"])], "script_id long, scene_idx long, keywords array<string>")
    plan = spark.createDataFrame([(0, 0, 9, ["z"])], "script_id long, plan_pos long, scene long, keywords array<string>")
    with pytest.raises(planedits.PlanMismatch):
        planedits.override_by_position(scenes, plan)
    with pytest.raises(planedits.PlanMismatch):
        planedits.apply_shot_list(scenes, scenes.limit(1).withColumnRenamed("keywords", "shots"))


def test_no_repeat_assignment(spark):
    choices = spark.createDataFrame(
        [(s, 0, p, 10.0 - p, "q", "A", c, "text", None) for s in ("s",) for p, c in enumerate(["1", "2"])],
        "sig string, kind int, pref long, score double, query string, source string, video_id string, tier string, sim double")
    scenes = spark.createDataFrame([(0, i, ["k"], 4000) for i in (0, 2, 4)], "script_id long, scene_idx long, keywords array<string>, needed_ms long")
    sig = catalog.signed(scenes).first().sig
    choices = choices.withColumn("sig", F.lit(sig))
    shots = scenes.select("script_id", "scene_idx")
    got = [(r.video_id, r.tier) for r in catalog.assign_unrepeated(choices, scenes, shots).orderBy("scene_idx").collect()]
    assert got == [("1", "text"), ("2", "text"), ("1", "used")]
    seed = spark.createDataFrame([(0, "A", "1")], "script_id long, source string, video_id string")
    got = [(r.video_id, r.tier) for r in catalog.assign_unrepeated(choices, scenes, shots, seed).orderBy("scene_idx").collect()]
    assert got == [("2", "text"), ("1", "used"), ("1", "used")]


def test_similarity_picks_slide_as_clips_are_used(spark):
    scenes = spark.createDataFrame([(0, i, ["k"], 4000) for i in range(0, 12, 2)], "script_id long, scene_idx long, keywords array<string>, needed_ms long")
    sig = catalog.signed(scenes).first().sig
    # two groups; the second clip of the first group has no frame, its last is strong but out of the three looked at
    found = [(0, "A", "a1", 9.0, 1, 0.20), (0, "A", "a2", 8.0, 2, None), (0, "A", "a3", 7.0, 3, 0.21), (0, "A", "a4", 6.0, 4, 0.30),
             (1, "B", "b1", 9.5, 1, 0.22)]
    passing = spark.createDataFrame([(sig, g, "q", s, v, score, rank, sim) for g, s, v, score, rank, sim in found],
                                    "sig string, group_rank long, query string, source string, video_id string, score double, cand_rank long, sim double")
    weak = spark.createDataFrame([(sig, "q", "A", "w", 1.0, 1)], "sig string, query string, source string, video_id string, score double, pref long")
    shots = scenes.select("script_id", "scene_idx")

    def picks(**how):
        got = catalog.assign_by_similarity(passing, weak, scenes, shots, k=3, **how).orderBy("scene_idx").collect()
        return [(r.video_id, r.tier, r.sim) for r in got]

    assert picks() == [("b1", "ok", 0.22), ("a3", "ok", 0.21), ("a4", "strong", 0.30), ("a1", "ok", 0.20), ("b1", "used", None), ("b1", "used", None)]
    seed = spark.createDataFrame([(0, "A", "a1")], "script_id long, source string, video_id string")
    assert picks(seeded=seed)[:2] == [("a4", "strong", 0.30), ("b1", "ok", 0.22)]
    frameless = passing.withColumn("sim", F.lit(None).cast("double"))
    got = catalog.assign_by_similarity(frameless, weak, scenes, shots).orderBy("scene_idx").collect()
    assert [(r.video_id, r.tier) for r in got][:2] == [("w", "weak"), (None, "none")]


def test_throttle_counts_earlier_requests_only(spark):
    from narraplan.operators import requests

    rows = spark.sql("SELECT 'a' AS provider, timestamp_seconds(id) AS ts, id FROM range(4)")
    got = {r.id: r.throttled for r in requests.trailing_rate(rows, 60, 3, "id").collect()}
    assert got == {0: False, 1: False, 2: False, 3: True}


def test_requests_of_one_moment_come_one_after_another(spark):
    """Six at one microsecond with a limit of five: the sixth waits. A window later all have left."""
    from narraplan.operators import requests

    rows = spark.sql("SELECT 'a' AS provider, timestamp_micros(1000000 + 60000000 * (id div 6)) AS ts, id FROM range(12)")
    got = {r.id: (r.in_window, r.throttled) for r in requests.trailing_rate(rows, 60, 5, "id").collect()}
    assert got == {k: (k % 6 + 1, k % 6 == 5) for k in range(12)}


def test_more_times_than_tokens_are_estimated(spark):
    """The numbers of times and tokens must be equal, as nothing tells which time is surplus."""
    scenes = spark.createDataFrame([(0, 0, "one two three", 3000), (1, 0, "one two three", 3000)],
                                   "script_id long, scene_idx long, text string, duration_ms long")
    times = [(s, 0, k, k * 500) for s, n in ((0, 3), (1, 4)) for k in range(n)]
    times = spark.createDataFrame(times, "script_id long, scene_idx long, token_idx long, start_ms long")
    got = captions.timed_windows(captions.chunk_captions(scenes, keep=["duration_ms"]), times).collect()
    assert {r.script_id for r in got} == {0} and len(got) == 3


def test_listed_term_with_capital(spark):
    row = spark.range(1).select(tx.key_term(F.lit("your melatonin dose"), terms=["Melatonin"]).alias("t")).first()
    assert row.t == "Melatonin"


def test_patterns_with_and_without_seeds():
    from narraplan.functions.patterns import Finder

    finder = Finder(["cat", r"\btea", "(dog|wolf)s", "owl|bat", "kidn.*stone", "[xyz]q"])
    assert finder.first("étea cats and dogs, a bat", 9) == [0, 2, 3]
    assert finder.first("tea, kidney or stone", 2) == [1, 4]
    assert finder.most("bat owl dogs cat") == 3 and finder.most("cat dogs") == 0 and finder.most("none") is None
    assert finder.first(None, 2) == [] and Finder([]).most("x") is None


@pytest.mark.parametrize("name", ["c1_script_plan", "g4_card_spacing", "w9_trailing_rate", "j16_cache_hits"])
def test_partition_independence(spark, name):
    seen = []
    for n in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        df = queries.QUERIES[name](spark, "/root/testdata/sf0.001")
        seen.append(df.select(F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)"))).first()[0])
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert seen[0] == seen[1]


def test_files_of_one_script_share_its_id(spark, tmp_path):
    from narraplan.sources import readers

    for folder, name, body in (("s", "x.txt", "One. Two."), ("t", "x.json", '[{"word": " One.", "start": 0.1, "end": 0.4}]'),
                               ("p", "x.json", '[{"scene": 1, "start": 0, "end": 1.5, "text": "One.", "keywords": ["a"]}]')):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / name).write_text(body)
    script = readers.read_scripts(spark, str(tmp_path / "s")).first()
    heard = readers.read_transcripts(spark, str(tmp_path / "t")).first()
    plan = readers.read_plans(spark, str(tmp_path / "p")).first()
    assert script.script_id == heard.script_id == plan.script_id
    assert (heard.token, heard.start_ms, plan.plan_pos, plan.keywords) == ("One.", 100, 0, ["a"])
    named = readers.read_scripts(spark, str(tmp_path / "s"), key=lambda p: F.regexp_extract(p, r"([^/]+)$", 1)).first()
    assert (named.script_id, named.text) == ("x.txt", "One. Two.")


def test_exported_plan_reads_back(spark, tmp_path):
    from narraplan.sources import readers

    path = str(tmp_path / "plan")
    rows = [(5, 1, 0.0, 1.0, "a\nb", ["k"]), (5, 2, 1.0, 2.0, "c", ["l", "m"]), (9, 1, 0.0, 3.5, "d", [])]
    plan = spark.createDataFrame(rows, "script_id long, scene long, start double, end double, text string, keywords array<string>")
    sinks.write_plan(plan, path, buckets=4)
    back = readers.read_plan_export(spark, path)
    assert sorted(tuple(r) for r in back.drop("plan_pos").collect()) == rows
    scenes = plan.select("script_id", (F.col("scene") - 1).alias("scene_idx"), F.array(F.lit("old")).alias("keywords"))
    edited = planedits.override_by_position(scenes, back)
    assert sorted((r.script_id, r.scene_idx, r.keywords) for r in edited.collect()) == [(5, 0, ["k"]), (5, 1, ["l", "m"]), (9, 0, [])]


def test_scenes_without_a_choice_stay(spark):
    scenes = spark.createDataFrame([(0, 0, ["k"], 4000), (0, 1, ["z"], 4000), (0, 2, ["k"], 4000)],
                                   "script_id long, scene_idx long, keywords array<string>, needed_ms long")
    sig = catalog.signed(scenes).where("scene_idx = 0").first().sig
    choices = spark.createDataFrame([(sig, 1, 1, 1.0, "k", "A", "1", "weak", None)], "sig string, kind int, pref long, "
                                    "score double, query string, source string, video_id string, tier string, sim double")
    assert sorted((r.scene_idx, r.tier, r.video_id) for r in catalog.best_pick(choices, scenes).collect()) == [
        (0, "weak", "1"), (1, "none", None), (2, "weak", "1")]
    got = catalog.assign_unrepeated(choices, scenes, scenes.select("script_id", "scene_idx"))
    assert sorted((r.scene_idx, r.tier, r.video_id) for r in got.collect()) == [(0, "weak", "1"), (1, "none", None), (2, "none", None)]


def test_given_answers_are_scored_without_a_shared_word(spark):
    rows = [("man drinking water", "A", "1", "dog drinking water"), ("lake", "A", "2", "a hill"), ("lake", "A", "3", "LAKE, dawn")]
    answers = spark.createDataFrame(rows, "query string, source string, video_id string, desc string")
    got = {r.video_id: r.rel for r in catalog.answer_results(answers).collect()}
    assert got == {"1": -2.0, "2": 0.0, "3": 3.0}


def heard(spark, script, words):
    rows = [(script, i, w, i * 100, i * 100 + 90) for i, w in enumerate(words.split())]
    return spark.createDataFrame(rows, "script_id long, asr_idx long, token string, start_ms long, end_ms long")


def test_repeated_triples_anchor_scripts_without_a_unique_one(spark):
    text = "go on and go on and go on and"
    got = alignment.match_words(scripts_df(spark, text), heard(spark, 0, text)).orderBy("word_idx").collect()
    assert [(r.word_idx, r.asr_idx) for r in got] == [(i, i) for i in range(9)]


def test_every_script_gets_spans(spark):
    corpus = scripts_df(spark, "aa bb cc dd.", "No words match. Not one.", "Read out slowly. In pauses.", "", "Hi.")
    asr = heard(spark, 0, "aa bb cc dd").unionByName(heard(spark, 1, "zz yy xx ww vv"))
    paused = spark.createDataFrame([(2, 0, 0, 5000), (2, 1, 5000, 9000), (1, 0, 0, 700)], "script_id long, sent_idx long, start_ms long, end_ms long")
    got = {(r.script_id, r.sent_idx): (r.timing, r.start_ms, r.end_ms) for r in alignment.timed_spans(corpus, asr, paused).collect()}
    assert got == {
        (0, 0): ("words", 0.0, 390.0), (1, 0): ("pace", 0.0, 1200.0), (1, 1): ("pace", 1200.0, 2000.0),
        (2, 0): ("pauses", 0.0, 5000.0), (2, 1): ("pauses", 5000.0, 9000.0), (4, 0): ("pace", 0.0, 400.0)}


def test_span_mismatch_is_an_error(spark):
    spans = spark.createDataFrame([(0, 0, 0.0, 900.0, 0, 2)], "script_id long, sent_idx long, start_ms double, end_ms double, first_word long, n_words long")
    with pytest.raises(alignment.SpanMismatch):
        alignment.bucket_timed_scenes(scripts_df(spark, "One two. Three."), spans)


def test_one_key_inside_one_gap(spark):
    df = spark.range(5000).select(F.lit(0).alias("k"), (F.col("id") % 3000).alias("at"), F.col("id").alias("seq"))
    got = ordered.spaced_accepts(df, ["k"], "at", ["at", "seq"], 1_000_000, True, "ok")
    assert [tuple(r) for r in got.where("ok").select("at", "seq").collect()] == [(0, 0)] and got.count() == 5000


def matched(spark, script, words):
    rows = alignment.match_words(scripts_df(spark, script), heard(spark, 0, words)).collect()
    got = sorted((r.word_idx, r.asr_idx) for r in rows)
    assert [b for _, b in got] == sorted({b for _, b in got})
    return got


def test_a_stray_anchor_costs_its_own_words_only(spark):
    words = [f"w{k}" for k in range(60)]
    # words 0-2 are garbled and said at the end
    got = matched(spark, " ".join(words), " ".join(["xx", "yy", "zz", *words[3:], *words[:3]]))
    assert got == [(k, k) for k in range(3, 60)]
    # one word said too early
    got = matched(spark, " ".join(words), " ".join(["w59", *words[:59]]))
    assert got == [(k, k + 1) for k in range(59)]


def test_scripts_that_share_runs_are_matched(spark):
    assert matched(spark, "go " * 60, "go " * 57) == [(k, k) for k in range(57)]
    assert matched(spark, "a b c d", "a c d") == [(0, 0), (2, 1), (3, 2)]
    intro = "hello and welcome to the show "
    got = matched(spark, intro + "today we talk about water " + intro, intro + "today we talk of water " + intro)
    assert len(got) == 16 and (10, 10) in got and (9, 9) not in got
    assert matched(spark, "aa bb", "cc dd") == []


def test_longest_rising_chain():
    r = random.Random(6)
    for _ in range(300):
        places = [r.randrange(12) for _ in range(r.randrange(10))]
        best = [1] * len(places)
        for i in range(len(places)):
            best[i] += max((best[j] for j in range(i) if places[j] < places[i]), default=0)
        got = [places[k] for k in alignment.rising(places)]
        assert len(got) == max(best, default=0) and got == sorted(set(got))


def test_pattern_fragments():
    from narraplan.functions import patterns

    of = lambda p: set(patterns.fragments(p) or ())
    assert of(r"\x61bcd") == {"abcd"} and of(r"\u00e9t\u00e9") == {"été"}
    assert of(r"(?:sleep|rest)ing") == {"sleeping", "resting"} and of(r"colou?r") == {"color", "colour"}
    assert of(r"\bwater\b.*(drink|glass)") == {"water"} and of(r"\d+ (mg|ml)") == {" mg", " ml"}
    assert of(r"[^a]bc") == {"bc"} and of(r"(?:a|b*)c?") == set() and of(r".*") == set()
    assert patterns.Finder([r"\x61bcd", r"x|.*"]).first("abcd", 2) == [0, 1]


def test_fragments_never_miss():
    from narraplan.functions import patterns

    r = random.Random(8)
    parts = ["a", "b", "c", "ab", "[ab]", "[a-c]", "[^a]", ".", r"\w", "(ab|c)", "(?:a|bc)", "a?", "b*", "c+", "(ab)?", "(a|b){2}", r"\b", "^", "$", "(a|)", "(?=a)", "(?!b)", "a{0,2}"]
    n = 0
    for _ in range(3000):
        p = "|".join("".join(r.choices(parts, k=r.randrange(1, 6))) for _ in range(r.choice([1, 1, 2])))
        one, search = patterns.Finder([p]), re.compile(p)
        for _ in range(4):
            t = "".join(r.choices("abc d", k=r.randrange(7)))
            assert one.first(t, 1) == ([0] if search.search(t) else []), (p, t)
            n += search.search(t) is not None
    assert n > 1000


@pytest.mark.parametrize("head", [None, 1])
def test_search_without_all_pairs(spark, head, monkeypatch):
    """The best results are those of all pairs, whatever the heads of the lists hold."""
    r = random.Random(12)
    words = ["man", "dog", "cat", "water", "sea", *[f"rare{c}" for c in "abcdefghij"]]
    weights = [30, 20, 10, 40, 20, *[1] * 10]
    clips = [("AB"[k % 2], str(k), 1920, 5.0, " ".join(r.choices(words, weights, k=r.randrange(1, 6))), k) for k in range(900)]
    clips = spark.createDataFrame(clips, "source string, video_id string, width int, duration_s double, desc string, source_rank long")
    asked = [(" ".join(r.sample(words, r.randrange(1, 5))),) for _ in range(60)] + [("man dog water",), ("rarea rareb",), ("nothing",), ("man sea zz",)]
    asked = spark.createDataFrame(asked, "query string")
    monkeypatch.setattr(catalog, "LIST_HEAD", head or 256)
    columns = ["query", "source", "video_id", "rel", "conflict", "result_no"]
    for k in (1, 4, 30):
        got = catalog.search(asked, clips, k, person=["man"], animal=["dog", "cat"]).select(*columns).collect()
        want = catalog.search(asked, clips, None, person=["man"], animal=["dog", "cat"]).where(F.col("result_no") <= k).select(*columns).collect()
        assert sorted(got) == sorted(want) and want


def counted(df, column, times):
    """The frame, whose rows add to ``times`` when ``column`` is read."""
    def read(x):
        times.add(1)
        return x

    return df.withColumn(column, F.udf(read, "string")(F.col(column)))


def test_sentence_model_reads_texts_once(spark):
    from narraplan.operators import abbreviations

    texts = [f"We saw Dr. Lee{i % 7}. The end (of it.) came! He left by {i} roads? The rest stays." for i in range(40)]
    plain, times = scripts_df(spark, *texts, None, ""), spark.sparkContext.accumulator(0)
    model = abbreviations.learn_breaks(counted(plain, "text", times))
    assert times.value == 42
    assert model == abbreviations.learn_breaks(plain)


def test_learned_abbreviations(spark):
    from narraplan.operators import abbreviations

    r = random.Random(2)
    names = ["Young", "Stone", "Marlow", "Reed", "Hale"]
    filler = ["river", "town", "market", "garden", "bridge", "letter", "winter", "morning"]
    lines = []
    for k in range(400):
        body = " ".join(r.choices(filler, k=6))
        lines.append(f"The {body} near the {r.choice(filler)}.")
        lines.append(f"Then dr. {r.choice(names)} met Dr. {r.choice(names)} by the {r.choice(filler)}." if k % 4 == 0 else f"He saw the {body} again!")
    scripts_ = scripts_df(spark, *[" ".join(lines[k:k + 8]) for k in range(0, len(lines), 8)])
    model = abbreviations.learn_breaks(scripts_)
    assert model.abbreviations == {"dr"} and {"the", "he"} <= model.starters and not model.starters & set(filler)
    text = 'Yes, Dr. Young said "so." The U.S. navy and J. R. Reed came. Was it vitamin C. The dr. left? (Dr. Stone) Ok.'
    got = [x.text for x in scripts.split_sentences(scripts_df(spark, text), model).orderBy("sent_idx").collect()]
    assert got == ['Yes, Dr. Young said "so."', "The U.S. navy and J. R. Reed came.", "Was it vitamin C.", "The dr. left?", "(Dr. Stone) Ok."]
    plain = [x.text for x in scripts.split_sentences(scripts_df(spark, text)).collect()]
    assert len(plain) > len(got) and " ".join(plain).split() == " ".join(got).split()
    for t in ("", "Dr.", " A. ", "no end", None):
        rows = scripts.split_sentences(scripts_df(spark, t), model).collect()
        assert [x.text for x in rows] == ([t.strip()] if t else [])
    assert abbreviations.learn_breaks(scripts_df(spark, "")) == tx.Breaks(frozenset(), frozenset())
    words = scripts.script_words(scripts_df(spark, text), model).collect()
    assert [w.token for w in sorted(words, key=lambda w: w.word_idx)] == text.split()


def test_cosines(spark):
    r = np.random.default_rng(3)
    a, b = r.normal(size=(40, 8)), r.normal(size=(40, 8))
    vectors = [(k, x.tolist(), y.tolist()) for k, (x, y) in enumerate(zip(a, b))]
    odd = [(100, None, a[0].tolist()), (101, [], []), (102, [0.0] * 8, a[0].tolist()), (103, a[0].tolist(), b[0].tolist()[:5]), (104, a[0].tolist(), a[0].tolist())]
    df = spark.createDataFrame(vectors + odd, "id long, a array<float>, b array<double>").repartition(3)
    got = {x.id: x.c for x in df.select("id", F.arrow_udf(catalog._cosines, "double")("a", "b").alias("c")).collect()}
    for k in range(40):
        assert got[k] == pytest.approx(a[k] @ b[k] / np.linalg.norm(a[k]) / np.linalg.norm(b[k]), abs=1e-6)
    assert [got[k] for k in (100, 101, 102, 103)] == [None] * 4 and got[104] == pytest.approx(1, abs=1e-6)


def _carried(df):
    """What each step that opens an array copies to every row of it."""
    plan = df._jdf.queryExecution().sparkPlan().toString()
    return re.findall(r"Generate .*\), \[([^\]]*)\], (?:true|false), \[", plan)


def test_opened_rows_leave_the_whole_text_behind(spark):
    """Else a script of n scenes would be copied n times, and wait on disk so where Python reads the scenes."""
    corpus = scripts_df(spark, "One two. Three four five. Six.")
    scenes = scripts.bucket_scenes(corpus).withColumn("duration_ms", F.col("end_ms") - F.col("start_ms"))
    rows = [concepts.tag_concepts(scenes, fx.CONCEPTS), captions.chunk_captions(scenes, keep=["duration_ms"])]
    rows.append(alignment.bucket_timed_scenes(corpus, spark.createDataFrame(
        [(0, i, i * 1000, i * 1000 + 900, i, 1) for i in range(3)],
        "script_id long, sent_idx long, start_ms long, end_ms long, first_word long, n_words long")))
    for df in rows:
        assert _carried(df) and not any("_s#" in c or "_t#" in c for c in _carried(df))


def test_scenes_and_chunks_take_their_own_words(spark):
    rng = random.Random(5)
    text = " ".join(sentence(rng.randint(1, 30)).replace("word", f"w{i}") for i in range(300))
    scenes = scripts.bucket_scenes(scripts_df(spark, text)).orderBy("scene_idx")
    assert " ".join(r.text for r in scenes.collect()) == text
    chunks = captions.chunk_captions(scenes).orderBy("scene_idx", "chunk_idx").collect()
    assert " ".join(" ".join(r.words) for r in chunks) == text


def test_cues_and_terms_read_scenes_once(spark):
    from narraplan.plans import pipelines

    texts = ["He saw Nevada first. It rained on Utah there. The license went to Maine soon. No. Of the end."] * 4
    scenes = scripts.bucket_scenes(scripts_df(spark, *texts)).localCheckpoint()
    n, times = scenes.count(), spark.sparkContext.accumulator(0)
    cues_ = pipelines.cue_schedule(counted(scenes, "text", times), None, ["license"], ["of"])
    kinds = {r.kind: r["count"] for r in cues_.groupBy("kind").count().collect()}
    assert times.value == n and kinds["key"] == 4 * len("Nevadalicense")


def test_term_times_join_words_once(spark):
    from narraplan.plans import pipelines

    corpus = scripts_df(spark, "He saw Nevada first. It rained on Utah there. Then Maine came.", "Plain words. No name here.")
    scenes = scripts.bucket_scenes(corpus, target_ms=1000).withColumn("is_card", F.lit(False)).localCheckpoint()
    words = scripts.script_words(corpus).withColumn("start_ms", F.col("word_idx") * 400).withColumn(
        "end_ms", F.col("start_ms") + 380).localCheckpoint()
    times = spark.sparkContext.accumulator(0)
    got = pipelines.timed_terms(scenes, counted(words, "token", times), [])
    old = pipelines.timed_terms(scenes, alignment.scene_word_times(scenes, words), [])
    names = ["script_id", "scene_idx", "term", "term_ms"]
    rows = sorted(map(tuple, got.select(names).collect()))
    assert rows == sorted(map(tuple, old.select(names).collect())) and {r[2] for r in rows} == {"Nevada", "Utah", "Maine", None}


@pytest.mark.parametrize("text", [
    "He met Nevada", "It ended. Nevada", 'A "Nevada" sign', "a ... 'Nevada", "Nevada here", "x \u2028Nevada", "b.\u2028 Nevada is", "é Évora Nevada",
    "5-Nevada", "a 5-Nevada", "a nEVADA", "a?) Nevada", "", "a\n\tNevada",
])
def test_inner_capital_guard(spark, text):
    from narraplan.functions import lexicon as lx

    toks = [t for t in re.split(r"[ \t\n\x0b\f\r]+", text) if t]
    good = [c for p, w in zip(toks, toks[1:]) if re.search("^[^A-Za-z]*[A-Z]", w) and not re.search("[.!?]\u2028?$", p)
            for c in [re.sub("[^A-Za-z]", "", w)] if len(c) >= 4 and c.lower() not in lx.TERM_STOP]
    assert value(spark, lambda t: tx.key_term(t, []), text) == (good[0] if good else None)


def test_texts_of_a_batch_become_strings_by_steps():
    import pyarrow as pa

    from narraplan.functions import patterns

    texts = pa.array([f"t{i}" if i % 5 else None for i in range(patterns.STEP * 2 + 7)])
    assert patterns._each(texts, lambda t: t) == texts.to_pylist() and patterns._each(texts[:0], len) == []


def test_long_runs_of_number_words(spark):
    """A run takes no stack, however long it is."""
    run = ["twelve", "or"] * 20_000 + ["sixteen", "hundred"]
    text = "and one or " + " ".join(run) + " hours or so"
    assert value(spark, tx.number_phrase, text) == "ONE OR " + " ".join(run).upper() + " HOURS"


def test_matching_of_many_texts_at_once():
    """As the rule is written: rounds of runs, voting places, the longest rising chain of each gap."""
    def runs(words, low, high, size):
        found = {}
        for k in range(low, high - size + 1):
            if "" not in words[k:k + size]:
                found.setdefault(tuple(words[k:k + size]), []).append(k)
        return found

    def by_rule(script, said):
        kept = []
        for size, rule in alignment.ROUNDS:
            more = []
            edges = [(-1, -1), *kept, (len(script), len(said))]
            for (a, b), (c, d) in zip(edges, edges[1:]):
                votes, theirs = {}, runs(said, b + 1, d, size)
                for run, mine in runs(script, a + 1, c, size).items():
                    other = theirs.get(run, [])
                    if rule == "least" or len(mine) == len(other) and (rule == "equal" or len(mine) == 1):
                        for i, j in zip(mine, other):
                            for k in range(size):
                                votes.setdefault(i + k, []).append(j + k)
                words = sorted(votes)
                places = [min(votes[w], key=lambda p: (-votes[w].count(p), p)) for w in words]
                more += [(words[k], places[k]) for k in alignment.rising(places)]
            kept = sorted(kept + more)
        return kept

    r, texts = random.Random(4), []
    for _ in range(300):
        few = r.choice([2, 5, 30])
        script = [r.choice(["", *"abcdefghijklmnopqrstuvwxyzABCD"[:few]]) for _ in range(r.randrange(40))]
        said = [w if r.random() > 0.1 else "zz" for w in script if r.random() > 0.1]
        texts.append((script, said[len(said) // 2:] + said[:len(said) // 2] if r.random() < 0.2 else said))
    number = {w: k for k, w in enumerate(["zz", *"abcdefghijklmnopqrstuvwxyzABCD"])} | {"": -1}
    coded = [tuple(np.array([number[w] for w in side], np.int64) for side in t) for t in texts]
    got = [[tuple(x) for x in places.T.tolist()] for places in alignment._places_of(coded)]
    assert got == [by_rule(*t) for t in texts] == [alignment.matched_places(*t) for t in texts]


def test_lines_of_a_script_stay_together_in_small_blocks(monkeypatch):
    import pyarrow as pa

    ids = [k for k in range(40) for _ in range(k % 7 + 1)]
    batch = pa.record_batch({"script_id": ids, "line": list(range(len(ids)))})
    monkeypatch.setattr(alignment, "AT_ONCE", 5)
    blocks = list(alignment._blocks(batch.slice(at, 3) for at in range(0, len(ids), 3)))
    assert pa.Table.from_batches(blocks).to_pydict() == batch.to_pydict() and len(blocks) > 10
    firsts = [b.column("script_id")[0].as_py() for b in blocks]
    assert len(set(firsts)) == len(blocks) and all(a.column("script_id")[-1] != b.column("script_id")[0] for a, b in zip(blocks, blocks[1:]))


def test_texts_are_aligned_in_one_shuffle_and_read_for_words_and_sentences(spark):
    r = random.Random(8)
    texts = [(k % 25, " ".join(sentence(r.randint(1, 9)).replace("word", f"w{r.randrange(60)}") for _ in range(r.randint(0, 9)))) for k in range(30)]
    corpus = spark.createDataFrame([*texts, (26, None), (None, "no id"), *texts[:2]], "script_id long, text string").repartition(4).localCheckpoint()
    said = {}
    for k, t in texts:
        said.setdefault(k, []).extend(w for w in t.split() if r.random() > 0.2)
    rows = [(k, i, w if i % 9 else "zz", i * 500, i * 500 + 400) for k, words in said.items() for i, w in enumerate(words)]
    asr = spark.createDataFrame(rows, "script_id long, asr_idx long, token string, start_ms long, end_ms long").localCheckpoint()
    words = alignment.align_words(corpus, asr)
    spans, want = (df.select("script_id", "sent_idx", "start_ms", "end_ms", "first_word", "n_words", "n_matched") for df in (
        alignment.align_sentences(corpus, asr), alignment.sentence_spans(words)))
    got = sorted(map(tuple, spans.collect()))
    assert got == sorted(map(tuple, want.collect())) and len(got) > 50
    once = words.where("matched").join(corpus.groupBy("script_id").count().where("count = 1"), "script_id")
    hits = alignment.match_words(corpus, asr).join(once, ["script_id", "word_idx"]).select(once.start_ms - F.col("asr_idx") * 500)
    assert {x[0] for x in hits.collect()} == {0.0}
    for df in (words, spans):
        plan = df._jdf.queryExecution().sparkPlan().toString()
        assert "Window" not in plan and plan.count("Generate") == 1


def test_sentence_model_has_every_word_that_reaches_its_score(spark):
    from itertools import islice, product

    from narraplan.operators import abbreviations

    short = ["".join(x) for x in islice(product("abcdefghijklmnopqrstuvwxyz", repeat=3), 10_500)]
    lines = [f"{' '.join(['some plain words go'] * 12)} {w}. {w}. {w}. {w}. {w}. {w}. {w}. {w}. on" for w in short]
    corpus = scripts_df(spark, *[" ".join(lines[k:k + 50]) for k in range(0, len(lines), 50)])
    model = abbreviations.learn_breaks(corpus)
    assert model.abbreviations == set(short)
    cut = scripts.split_sentences(scripts_df(spark, f"He met {short[0]}. and {short[-1]}. here. There."), model).orderBy("sent_idx")
    assert [r.text for r in cut.collect()] == [f"He met {short[0]}. and {short[-1]}. here.", "There."]


def test_caption_words_travel_with_their_scene(spark):
    """Chunks and times are shuffled once each, a row a scene, and scenes whose times don't agree are guessed in the same pass."""
    from narraplan.plans import pipelines

    texts = ["One two three. Four five six seven eight nine. Ten eleven.", "Aa bb cc. Dd ee.", "Ff gg. Hh."]
    scenes = scripts.bucket_scenes(scripts_df(spark, *texts)).withColumn("duration_ms", F.col("end_ms") - F.col("start_ms"))
    chunks = captions.chunk_captions(scenes, keep=["duration_ms"])
    times = [(0, 0, i, i * 300) for i in range(9)] + [(0, 1, i, i * 100) for i in range(2)]
    times += [(1, 0, i, i * 200) for i in (0, 0, 1, 2, 3)] + [(2, 0, 0, 0), (2, 0, 1, None), (2, 0, 2, 500)]
    given = spark.createDataFrame(times, "script_id long, scene_idx long, token_idx long, start_ms long").localCheckpoint()
    timed = captions.timed_windows(chunks, given)
    rows = {}
    for r in timed.collect():
        rows.setdefault((r.script_id, r.scene_idx), []).append((r.word, r.start_ms, r.end_ms))
    assert sorted(rows[0, 0])[:2] == [("Four", 900, 1200), ("One", 0, 300)] and len(rows[0, 0]) == 9
    assert sorted(rows[0, 1]) == [("Ten", 0, 100), ("eleven.", 100, 800)]
    # five times for five words count as given, though one word has two and one none
    assert sorted(rows[1, 0])[:3] == [("Aa", 0, 30), ("Aa", 0, 200), ("Dd", 600, 2000)] and len(rows[1, 0]) == 6 and (2, 0) not in rows
    every = pipelines.caption_schedule(scenes, given)
    got = {(r.script_id, r.scene_idx, r.word, r.start_ms) for r in every.collect()}
    assert {(k[0], k[1], w, float(s)) for k, v in rows.items() for w, s, _ in v} <= got and {w for k, _, w, _ in got if k == 2} == {"Ff", "gg.", "Hh."}
    for df in (timed, every):
        plan = df.select("*")._jdf.queryExecution().executedPlan().toString()
        assert not re.search(r"\bWindow \[|LeftAnti", plan) and plan.count("Exchange hashpartitioning") == 2, plan
