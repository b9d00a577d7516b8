"""Streams against their batch twins, row by row, on the events table and on hand-made logs."""

import random

import pytest
from pyspark.sql import functions as F

from narraplan.plans.queries import QUERIES
from narraplan.streaming import inorder, jobs

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(repr, df.select(*sorted(df.columns)).collect()))


def test_trailing_rate_equals_batch(spark):
    assert rows(QUERIES["st1_trailing_rate"](spark, SF)) == rows(QUERIES["w9_trailing_rate"](spark, SF))


def test_admission_equals_batch(spark):
    assert rows(QUERIES["st2_admission"](spark, SF)) == rows(QUERIES["a9_monthly_budget"](spark, SF))


def test_silence_runs_equal_batch(spark):
    got = rows(QUERIES["st6_silence_runs"](spark, SF))
    assert got == rows(QUERIES["w5_silences"](spark, SF)) and got


def test_repeat_suppression_equals_batch(spark):
    stream = QUERIES["st3_ttl_suppression"](spark, SF).select("seq", (~F.col("kept")).alias("hit"))
    batch = QUERIES["j16_cache_hits"](spark, SF).select(F.col("event_id").alias("seq"), "hit")
    assert rows(stream) == rows(batch)


def test_cool_down_equals_batch(spark):
    stream = QUERIES["st4_cool_down"](spark, SF).where("kept").select("seq", "at_ms")
    assert rows(stream) == rows(QUERIES["g5_cue_spacing"](spark, SF).select("seq", "at_ms"))


def write(spark, folder, part, log):
    df = spark.createDataFrame(log, "provider string, us long, seq long, quiet boolean")
    df.select("provider", F.timestamp_micros("us").alias("ts"), "seq", "quiet").coalesce(1).write.mode("append").parquet(f"{folder}/{part}")


def replay(spark, folder, log, build, name):
    """Several files, one a trigger, each in any order; then a closing row far ahead."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", jobs.ROCKSDB)
    r = random.Random(3)
    parts = [log[k::1][:0] for k in range(4)]
    size = -(-len(log) // 4)
    for k in range(4):
        parts[k] = log[k * size:(k + 1) * size]
        r.shuffle(parts[k])
    out = []
    for k, part in enumerate([*parts, [("end", 10**15, -1, True)]]):
        write(spark, folder, "in", part)
        stream = build(spark.readStream.schema("provider string, ts timestamp, seq long, quiet boolean").option("maxFilesPerTrigger", 1).parquet(f"{folder}/in"))
        query = stream.writeStream.format("parquet").option("path", f"{folder}/{name}").option(
            "checkpointLocation", f"{folder}/{name}-state").trigger(availableNow=True).start()
        query.awaitTermination()
        schema = stream.schema
    return spark.read.schema(schema).parquet(f"{folder}/{name}")


def hand_made(seed, n=300, span=400_000_000):
    r = random.Random(seed)
    times = sorted(r.choice([r.randrange(span), r.randrange(span // 50) * 1000]) for _ in range(n))
    return [(r.choice("abb"), t + 10**12, k, r.random() < 0.6) for k, t in enumerate(times)]


def test_rate_over_several_triggers(spark, tmp_path):
    """Ties at one microsecond, windows across triggers, blocks without items."""
    log = hand_made(7)
    got = replay(spark, tmp_path, log, lambda s: jobs.trailing_rate(s, 60, 5), "rate").where("provider != 'end'").collect()
    want = {}
    for p, t, k, _ in log:
        n = sum(q == p and t - 60_000_000 < u and (u, j) <= (t, k) for q, u, j, _ in log)
        want[k] = (p, n, n > 5)
    assert {x.seq: (x.provider, x.in_window, x.throttled) for x in got} == want and len(got) == len(log)


def test_runs_over_several_triggers(spark, tmp_path):
    log = hand_made(9)
    got = replay(spark, tmp_path, log, lambda s: jobs.quiet_runs(s.withColumnRenamed("provider", "rec_id"), 10, 20, 1000, 7), "runs")
    want = []
    for p in "ab":
        quiet = [q for r, _, _, q in log if r == p] + [False]
        start = None
        for k, q in enumerate(quiet):
            if q and start is None:
                start = k
            elif not q and start is not None:
                if k - start >= 2:
                    want.append((p, start * 10, k * 10))
                start = None
    assert sorted((x.rec_id, x.start_ms, x.end_ms) for x in got.where("rec_id != 'end'").collect()) == sorted(want) and want


@pytest.mark.parametrize("strict", [True, False])
def test_spacing_over_several_triggers(spark, tmp_path, strict):
    log = hand_made(11)
    items = lambda s: s.select(F.col("provider").alias("stream_key"), "ts", F.unix_micros("ts").alias("at_us"), "seq",
                               (F.col("seq") % 10 == 0).cast("bigint").alias("mark"))
    got = replay(spark, tmp_path, log, lambda s: inorder.in_order(items(s), inorder.Spacing(["stream_key"], 5_000_000, strict)), "spaced")
    want, last = set(), {}
    for p, t, k, _ in log:
        gap = t - last.get(p, -10**18)
        if k % 10 == 0:
            want.add(k)
        elif gap > 5_000_000 or (gap == 5_000_000 and not strict):
            want.add(k)
            last[p] = t
    assert {x.seq for x in got.where("kept and stream_key != 'end'").collect()} == want
