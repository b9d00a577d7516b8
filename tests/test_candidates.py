"""Candidates against a script's used clips, and answers numbered before they meet their queries."""

from narraplan.operators import catalog
from narraplan.plans import queries

SF = "/root/testdata/sf0.001"


def test_without_used(spark):
    rows = [(1, "A", "7"), (1, "A", "7"), (1, "B", "7"), (2, "A", "7"), (None, "A", "7"), (1, None, "7"), (1, "A", None), (3, "A", "9")]
    used = [(1, "A", "7"), (1, "A", "8"), (1, "A", "8"), (None, "A", "7"), (1, None, "7"), (1, "A", None), (2, "B", "7")]
    schema = "script_id long, source string, video_id string"
    left = catalog.without_used(spark.createDataFrame(rows, schema), spark.createDataFrame(used, schema))
    assert sorted(map(str, map(tuple, left.collect()))) == sorted(map(str, [
        (1, "B", "7"), (2, "A", "7"), (None, "A", "7"), (1, None, "7"), (1, "A", None), (3, "A", "9")]))


def test_candidates_at_their_script_are_not_sent_again(spark):
    schema = "script_id long, source string, video_id string"
    rows = spark.createDataFrame([(1, "A", "7")], schema)
    plan = catalog.without_used(rows.repartition("script_id"), rows)._jdf.queryExecution().optimizedPlan().toString()
    join = next(x for x in plan.splitlines() if "Join" in x)
    assert "script_id" in join and "video_id" not in join


def test_answers_are_numbered_before_the_join(spark):
    plan = queries._answers(spark, SF)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    depth = lambda word: next(i for i, x in enumerate(plan) if word in x)
    assert depth("Window") > depth("Join")
    got = queries._answers(spark, SF).groupBy("query", "source").agg({"result_no": "max", "*": "count"}).collect()
    assert got and all(r["max(result_no)"] == r["count(1)"] for r in got)
