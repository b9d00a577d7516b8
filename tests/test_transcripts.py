"""Transcripts derived from scripts: which rows, and what is shuffled for them."""

from narraplan.plans import fixtures as fx
from narraplan.plans.queries import QUERIES


def stored(spark, folder, rows):
    """Many files, so that the corpus is read as it is."""
    spark.createDataFrame(rows, "doc_id long, text string").repartition(16).write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def test_texts_travel_not_words(spark, tmp_path):
    texts = [(k, " ".join(f"w{k}x{i}" for i in range(30)) + ".") for k in range(40)]
    texts += [(3, "Second text of three. It has more words."), (41, None), (42, ""), (None, "no id here")]
    sf = stored(spark, tmp_path, texts)
    want = []
    for k in range(41):
        words = sorted((i, w) for d, t in texts if d == k for i, w in enumerate(t.split()))
        heard = [(i, w) for i, w in words if (i * 7919 + k) % 23 != 3]
        want += [(k, n, w) for n, w in enumerate(w for i, w in heard if (i * 7919 + k) % 23 != 7)]
    got = QUERIES["src2_transcript_scan"](spark, sf)
    assert sorted((r.script_id, r.asr_idx, r.token) for r in got.collect()) == want
    assert fx.asr_words(spark, sf).where("token not like 'zz%'").count() == len(want)
    for words in (QUERIES["src2_transcript_scan"](spark, sf), fx.asr_words(spark, sf)):
        plan = words._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" in plan and "Generate" not in plan[plan.index("Exchange"):]
