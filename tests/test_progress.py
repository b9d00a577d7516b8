"""The progress table, run identity, resumed work."""

import os

import pytest
from pyspark.sql import functions as F

from narraplan.operators import planedits
from narraplan.plans import fixtures as fx
from narraplan.plans import pipelines
from narraplan.plans.queries import CLASSES, MAX_SHOT_MS, QUERIES
from narraplan.operators import scripts
from narraplan.sources import sinks
from narraplan.streaming import jobs

SF = "/root/testdata/sf0.001"
ROWS = "script_id long, fingerprint string, scene_idx long, output string"


def rows(spark, *data):
    return spark.createDataFrame([(s, f, i, o) for s, f, i, o in data], ROWS)


def read(spark, path, **how):
    return {(r.script_id, r.fingerprint, r.scene_idx): r.output for r in sinks.read_progress(spark, path, **how).collect()}


def test_the_newest_row_counts(spark, tmp_path):
    path = str(tmp_path / "progress")
    assert read(spark, path) == {}
    first = rows(spark, (1, "00aa", 0, "a"), (1, "00aa", 1, "b"), (2, "1e5b", 0, "c"), (3, "00aa", 0, "d"))
    for batch, part in ((0, first), (0, first), (1, rows(spark, (1, "00aa", 0, "A")))):
        sinks.write_progress(part, path, batch)
    want = {(1, "00aa", 0): "A", (1, "00aa", 1): "b", (2, "1e5b", 0): "c", (3, "00aa", 0): "d"}
    assert read(spark, path) == want
    assert read(spark, path, before=1)[1, "00aa", 0] == "a"
    asked = spark.createDataFrame([("1e5b",), ("ffff",)], "fingerprint string")
    assert read(spark, path, fingerprints=asked) == {(2, "1e5b", 0): "c"}
    plan = sinks.read_progress(spark, path, fingerprints=asked)._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "bucket" in plan[plan.index("PartitionFilters"):][:120]


def test_compaction(spark, tmp_path):
    path = str(tmp_path / "progress")
    for batch in range(4):
        sinks.write_progress(rows(spark, (1, "00aa", batch % 2, f"o{batch}"), (batch, "7777", 0, "x")), path, batch)
    want = read(spark, path)
    sinks.compact_progress(spark, path, 2)
    assert sorted(os.listdir(path)) == ["base=2", "batch=3"] and read(spark, path) == want
    sinks.compact_progress(spark, path, 2)
    assert read(spark, path) == want
    sinks.write_progress(rows(spark, (1, "00aa", 0, "new")), path, 4)
    sinks.compact_progress(spark, path, 4)
    assert os.listdir(path) == ["base=4"] and read(spark, path) == want | {(1, "00aa", 0): "new"}


@pytest.mark.parametrize("step", ["while the base is written", "before anything is removed", "while batches are removed"])
def test_a_crash_loses_nothing(spark, tmp_path, step):
    path = str(tmp_path / "progress")
    for batch in range(3):
        sinks.write_progress(rows(spark, (batch, "00aa", 0, f"o{batch}")), path, batch)
    want = read(spark, path)
    if step == "while the base is written":
        sinks._write_part(sinks.read_progress(spark, path), f"{path}/base=2")
        os.remove(f"{path}/base=2/_SUCCESS")
    else:
        sinks._write_part(sinks.read_progress(spark, path), f"{path}/base=2")
        if step == "while batches are removed":
            os.remove(f"{path}/batch=0/_SUCCESS")
    assert read(spark, path) == want
    sinks.compact_progress(spark, path, 2)
    assert read(spark, path) == want and "base=2" in os.listdir(path)


def test_a_batch_reads_little_history(spark, tmp_path):
    """Files opened for one fingerprint don't grow with the batches that were gathered."""
    path = str(tmp_path / "progress")

    def opened():
        asked = spark.createDataFrame([("0a00",)], "fingerprint string")
        return len(sinks.read_progress(spark, path, fingerprints=asked).inputFiles())

    sizes = []
    for batch in range(9):
        sinks.write_progress(rows(spark, *[(k, f"{(k + batch) % 16:x}a{batch:02d}", 0, "x") for k in range(16)]), path, batch)
        if batch % 4 == 3:
            sinks.compact_progress(spark, path, batch)
            sizes.append(opened())
    assert sizes[0] == sizes[1] == 1 or sizes[0] == sizes[1]


def test_keywords_are_part_of_the_identity(spark):
    corpus = spark.createDataFrame([(1, "a text"), (2, "a text")], "script_id long, text string")
    scenes = spark.createDataFrame([(1, 0, ["k", "l"]), (1, 1, ["m"]), (2, 0, ["k", "l"]), (2, 1, ["m"])], "script_id long, scene_idx long, keywords array<string>")
    runs = {r.script_id: r for r in planedits.run_identity(corpus, scenes, "s").collect()}
    assert runs[1].fingerprint == runs[2].fingerprint and runs[1].n_scenes == 2
    edits = spark.createDataFrame([(1, 1, "edited")], "script_id long, scene_idx long, edit string")
    edited = planedits.edit_first_keyword(scenes, edits)
    again = {r.script_id: r.fingerprint for r in planedits.run_identity(corpus, edited, "s").collect()}
    assert again[1] != runs[1].fingerprint and again[2] == runs[2].fingerprint
    done = scenes.join(planedits.run_identity(corpus, scenes, "s"), "script_id").select("script_id", "fingerprint", "scene_idx")
    left = planedits.pending_scenes(edited.join(planedits.run_identity(corpus, edited, "s"), "script_id"), done)
    assert sorted((r.script_id, r.scene_idx) for r in left.collect()) == [(1, 0), (1, 1)]


def test_stream_plans_what_is_pending(spark, tmp_path):
    """Plan rows equal the batch plan's; a second run does nothing; an edit makes one script pending."""
    got = sorted(map(repr, QUERIES["st5_incremental_plan"](spark, SF).collect()))
    assert got == sorted(map(repr, QUERIES["c1_script_plan"](spark, SF).collect())) and got
    source, progress = str(tmp_path / "in"), str(tmp_path / "progress")
    texts = ["One erwh two. Three attion four five six seven eight nine ten eleven.", "Another that. And more onre words to say here now."]
    spark.createDataFrame(list(enumerate(texts)), "script_id long, text string").coalesce(1).write.parquet(source)

    def run(name, edits=None):
        stream = spark.readStream.schema("script_id long, text string").parquet(source)
        jobs.start_incremental_plan(stream, fx.CONCEPTS, fx.ALTERNATES, "s", progress, str(tmp_path / name), edits).awaitTermination()
        return sinks.read_progress(spark, progress).count()

    first = run("one")
    assert first > 2 and run("two") == first
    edits = spark.createDataFrame([(1, 0, "edited")], "script_id long, scene_idx long, edit string")
    n = sinks.read_progress(spark, progress).where("script_id = 1").count()
    assert run("three", edits) == first + n
    new = jobs.planned_rows(sinks.read_progress(spark, progress)).where("keywords[0] = 'edited'")
    assert new.count() == 1


def test_resumed_picks_go_on_without_repeats(spark):
    """Scenes done before seed the picks of the rest, which are then those of one whole run."""
    scenes = fx.request_scenes(spark, SF).where("script_id < 40")
    shots = scripts.expand_shots(scenes.select("script_id", "scene_idx", F.lit(0).alias("start_ms"), F.col("needed_ms").alias("end_ms")), MAX_SHOT_MS)
    clips, frames = fx.clip_catalog(spark, SF), fx.frame_embeddings(spark, SF)
    vectors = lambda q: fx.query_embeddings(spark, SF, q)
    whole = pipelines.unrepeated_picks(scenes, shots, clips, vectors, frames, **CLASSES).cache()
    runs = scenes.select("script_id", F.lit("f").alias("fingerprint")).distinct()
    before = pipelines.picked_clips(whole.where("scene_idx < 6")).withColumns({"fingerprint": F.lit("f"), "output": F.lit("x")})
    other = before.withColumns({"fingerprint": F.lit("older"), "scene_idx": F.col("scene_idx") + 6})
    rest = pipelines.resumed_picks(scenes, shots, clips, vectors, frames, runs, before.unionByName(other), **CLASSES)
    order = sorted(whole.columns)
    want = sorted(map(repr, whole.where("scene_idx >= 6").select(*order).collect()))
    assert sorted(map(repr, rest.select(*order).collect())) == want and want


def test_audit_is_written(spark, tmp_path):
    """The report of the audit pipeline, as JSON lines with its fields."""
    from narraplan.plans.queries import _audit

    report = _audit(spark, SF)
    sinks.write_audit(report, str(tmp_path / "audit"))
    back = spark.read.schema(report.schema).json(str(tmp_path / "audit"))
    assert back.columns == report.columns == ["script_id", "scene", "shot", "text", "query", "clip", "sim", "desc"]
    assert back.count() > 0 and back.where("length(text) > 90 or length(desc) > 100 or scene < 1 or shot < 1").isEmpty()


def test_tables_of_a_batch_go_with_it(spark):
    from narraplan.operators import ordered

    scenes = spark.createDataFrame([(k % 7 if k % 11 else None, k % 5, f"t{k}", ["a", None]) for k in range(120)], "script_id long, scene_idx long, text string, keywords array<string>")
    with ordered.written_for(scenes, scenes.select("text")) as (a, b):
        paths = [f.removeprefix("file://").rsplit("/", 1)[0] for df in (a, b) for f in df.inputFiles()]
        assert sorted(map(repr, a.collect())) == sorted(map(repr, scenes.collect())) and a.schema == scenes.schema and all(map(os.path.isdir, paths))
    assert paths and not any(map(os.path.exists, paths))


def test_a_planned_batch_leaves_its_progress_only(spark, tmp_path):
    from narraplan.operators import ordered

    shared = ordered._shared_folder(spark.range(1)).removeprefix("file:")
    before = set(os.listdir(shared))
    spark.createDataFrame([(k, "One two three four. Five six. " * 9) for k in range(6)], "script_id long, text string").write.parquet(f"{tmp_path}/in")
    arriving = spark.readStream.schema("script_id long, text string").parquet(f"{tmp_path}/in")
    jobs.start_incremental_plan(arriving, fx.CONCEPTS, fx.ALTERNATES, "4.0", f"{tmp_path}/progress", f"{tmp_path}/c").awaitTermination()
    assert jobs.planned_rows(sinks.read_progress(spark, f"{tmp_path}/progress")).count() > 6
    new = [d for d in set(os.listdir(shared)) - before if d.startswith("rows-") or any(f.startswith("part-") for f in os.listdir(f"{shared}/{d}"))]
    assert new == []
