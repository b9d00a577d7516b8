"""Documents whose columns have the names that operators use."""

import regex
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from narraplan.llm import language, mixing, ngram_join, sharding, toxicity
from narraplan.llm.common import free_name

SF = "/root/testdata/sf0.001"
NAMES = ["rejected", "score", "predicted", "lang_pred", "language", "toxicity", "_row", "_text", "_id", "_hash", "_blank", "_fate", "_kept", "node"]


@pytest.fixture
def crowded(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    return docs.select("*", *[F.col("doc_id").cast("string").alias(n) for n in NAMES])


def test_stages_keep_every_column(spark, crowded):
    left = crowded
    for _, stage in corpus_pipeline.STAGES[:-1]:
        left = corpus_pipeline.written(stage(spark, left, SF), "crowded")
        assert left.columns == crowded.columns
        rows = left.collect()
        assert rows and all(x[n] == str(x.doc_id) for x in rows for n in NAMES)


def test_results_refuse_a_taken_name(crowded):
    with pytest.raises(ValueError, match="language"):
        language.identified(crowded, None)
    with pytest.raises(ValueError, match="toxicity"):
        toxicity.scored(crowded, toxicity.Lexicon())
    assert free_name(["language", "Language_"], "language") == "language__"
    assert language.identified(crowded, None, "found").columns == [*crowded.columns, "found"]


def test_pipeline_on_odd_rows(spark, docs_of, odd):
    for rows in (odd, []):
        left = docs_of(rows)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            left = corpus_pipeline.written(stage(spark, left, SF), "odd")
            assert left.columns == docs_of([]).columns
            if name == "language_id":
                assert not {0, 1, 2} & {x.doc_id for x in left.collect()}
        pieces = corpus_pipeline.STAGES[-1][1](spark, left, SF)
        assert (pieces.count() > 0) == (left.count() > 0)


def test_letters_are_of_category_l():
    assert not language.has_letter("½ ²") and not language.has_letter("Ⅷ") and not language.has_letter("12_3 !") and not language.has_letter(None)
    assert language.has_letter("é") and language.has_letter("中") and language.has_letter("ª") and language.has_letter("١ a")
    assert all(language.has_letter(chr(c)) == bool(regex.match(r"\p{L}", chr(c))) for c in range(0x3000) if not 0xD800 <= c < 0xE000)


def test_kept_rows_are_exact_with_full_filters(docs_of, odd, monkeypatch):
    """Where the filters know everything, the join decides all rows."""
    from narraplan.llm import line_dedup

    texts = [t for _, t in odd] + [f"text number {k % 7} with some more words in it" for k in range(40)]
    rows = [*enumerate(texts), (3, texts[3]), (20, texts[20]), (20, texts[20])]
    want = sorted(str(x.doc_id) for x in ngram_join.deduplicated(docs_of(rows)).collect())
    monkeypatch.setattr(line_dedup, "LEAST_BITS", 64)
    monkeypatch.setattr(line_dedup, "MOST_BITS", 64)
    assert sorted(str(x.doc_id) for x in ngram_join.deduplicated(docs_of(rows)).collect()) == want
    assert len(want) == len(set(want))


def test_shards_keep_every_column(spark, crowded, tmp_path):
    """A user's columns named as the shard's own come back as they were."""
    docs = crowded.select("doc_id", "text", *[F.col("doc_id").cast("string").alias(n) for n in ("shard", "depth", "prefix", "part", "shard_bytes", "row_bytes")])
    sharding.write_shards(docs, str(tmp_path / "shards"), limit=100_000)
    got = sharding.read_shards(spark, str(tmp_path / "shards"), docs.schema, F.octet_length("text"))
    assert got.columns == [*docs.columns, "shard_"]
    rows = got.collect()
    assert len(rows) == docs.count() and all(x[n] == str(x.doc_id) for x in rows for n in docs.columns[2:])
    assert len({x.shard_ for x in rows}) > 1
    with pytest.raises(ValueError, match="shard"):
        sharding.assign(docs)


def plain_mix(rows, weights=(1, 2, 3), most=3):
    """Targets by water filling in plain Python, from (doc_id, text, source)."""
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + len((text or "").split())
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    total, target, free = sum(sizes.values()), {}, set(order)
    while True:
        left = total - sum(target.values())
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if share[s] > most * sizes[s]}
        if not over:
            return target | share
        for s in over:
            target[s] = most * sizes[s]
        free -= over
        if not free:
            return target


@pytest.mark.parametrize("ids", ["one id", "null ids", "one id and texts", "two of each"])
def test_mix_with_repeated_ids(spark, ids, monkeypatch):
    """1,500 rows of ten words, most under one id: targets are met within a document, no row is taken more than three times."""
    monkeypatch.setattr(mixing, "NUMBERED", 100)
    rows = []
    for k in range(1500):
        hot = k % 5 != 0
        i = {"one id": 7, "null ids": None, "one id and texts": 7, "two of each": 10_000 + k // 2}[ids] if hot else k
        text = " ".join(f"w{0 if ids == 'one id and texts' and hot else k // 2 if ids == 'two of each' else k}" for _ in range(10))
        rows.append((i, text, f"s{(k // 2) % 3}"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = plain_mix(rows)
    report = mixing.mix_report(docs).collect()
    assert len(report) == 1500 and all(x.taken <= 3 * x.size for x in report)
    taken = {}
    for x in report:
        taken[x.target] = taken.get(x.target, 0) + x.taken
    assert sorted(taken) == sorted(want.values()) and all(abs(t - n) <= 10 for t, n in taken.items())
    again = mixing.mix_report(docs.repartition(7)).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, report))
    mix = mixing.mixed_documents(docs.withColumn("row", F.lit(1)))
    assert mix.columns == ["doc_id", "text", "source", "row"] and mix.count() * 10 == sum(x.taken for x in report)
