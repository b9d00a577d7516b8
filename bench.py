"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR names the tables, BENCH_CPUS the local cores. Each query is run to the noop
sink once to warm up and once timed, so no result travels to the driver.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

HEADLINE = [
    "p1_sentence_split", "p6_key_term", "p8_number_phrase", "g1_scene_bucketing", "j3_concept_tags",
    "a1_dominant_topic", "g3_caption_chunks", "w7_estimated_windows", "j10_alignment", "j15_no_repeat",
    "w5_silences", "w9_trailing_rate", "j16_cache_hits", "c1_script_plan", "c2_transcript_plan",
    "c3_clip_audit", "c4_cue_schedule", "c5_pause_timing", "c6_request_report",
]


SOUNDS = ["er", "wh", "att", "ion", "on", "re", "es", "an", "en", "th", "st", "ly", "ou", "ing", "ed", "at", "or"]


def invented_patterns(n: int = 134) -> list[str]:
    """As many patterns as a large dictionary has, by a rule: plain, word ends, groups, classes, gaps, alternatives."""
    made = []
    for k in range(n):
        a, b, c = (SOUNDS[(k * step + k // len(SOUNDS)) % len(SOUNDS)] for step in (1, 5, 7))
        made.append([f"{a}{b}{c}", f"{a}{b}\\b", f"(?:{a}|{b}){c}{a}", f"\\b{a}[{b[0]}{c[0]}]{b}", f"{a}{b}{c}.*{c}{b}", f"{a}{b}{b}|{c}{a}{a}"][k % 6])
    return made


def dictionary_queries() -> dict:
    """Tags of all scenes and topics of all scripts by 134 patterns."""
    from narraplan.operators import concepts
    from narraplan.plans import fixtures as fx

    table = [concepts.Concept(p, f"visual {k}", f"anchor{k}") for k, p in enumerate(invented_patterns())]
    return {
        "j3_with_134_patterns": lambda spark, sf: concepts.tag_concepts(fx.scenes(spark, sf), table),
        "a1_with_134_patterns": lambda spark, sf: concepts.script_topics(fx.corpus(spark, sf), table),
    }


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("narraplan-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from narraplan.plans.queries import QUERIES

    timed = QUERIES | dictionary_queries()
    names = os.environ.get("BENCH_QUERIES", ",".join([*HEADLINE, *dictionary_queries()])).split(",")
    times = {}
    for name in names:
        for _ in range(2):
            start = time.perf_counter()
            timed[name](spark, sf).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
