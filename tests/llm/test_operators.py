"""Each operator against a brute-force version, and on null, empty, long, tied and repeated rows."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from narraplan.llm import edit_counts, fingerprints, language, mixing, ngram_join, packing, sharding, token_files, toxicity, vector_join
from narraplan.llm.common import components
from narraplan.llm.queries import BYTE_VOCABULARY, ORACLE, QUERIES, WORD_VOCABULARY
from narraplan.llm.tokens import Encoder

SF = "/root/testdata/sf0.001"


def fold(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", fold(text))
    return {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def classes(n, linked):
    at = list(range(n))
    for a, b in linked:
        x, y = at[a], at[b]
        at = [min(x, y) if v in (x, y) else v for v in at]
    return at


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_statement(spark, name):
    import compare

    assert compare.compare(spark, compare.duck(SF), SF, name, QUERIES[name], ORACLE[name]) is None


def test_components(spark):
    r = random.Random(5)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(1000 + k, 1001 + k) for k in range(40)]
    got = {x.node: x.component for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    at = classes(1100, edges)
    assert got == {v: at[v] for v in {v for e in edges if e[0] != e[1] for v in e}}


@pytest.fixture(params=[(256, 1 << 20), (4, 200)], ids=["one tile", "many tiles"])
def tiles(request, monkeypatch):
    monkeypatch.setattr(ngram_join, "GROUP_TILE", request.param[0])
    monkeypatch.setattr(ngram_join, "BLOCK_TILE", request.param[1])


def test_jaccard_join(docs_of, odd, tiles):
    r = random.Random(1)
    passage = [f"p{k}" for k in range(30)]
    base = [f"b{k}" for k in range(60)]
    texts = [t for _, t in odd]
    for k in range(45):  # a chain of near copies, and texts that share a passage only
        base = list(base)
        base[r.randrange(60)] = f"x{k}"
        texts += [" ".join(base), " ".join([*passage, *(f"q{k}_{j}" for j in range(40))])]
    sets = [shingles(t) for t in texts]
    pairs = [(a, b) for a, b in itertools.combinations(range(len(texts)), 2)
             if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    at = classes(len(texts), pairs)
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in ngram_join.jaccard_components(docs_of(texts)).collect()}
    assert got == {i: (len(s), at[i]) for i, s in enumerate(sets)}
    kept = ngram_join.deduplicated(docs_of(texts)).collect()
    assert sorted(x.doc_id for x in kept) == [i for i in range(len(texts)) if at[i] == i]


def test_jaccard_join_odd_ids(docs_of, odd):
    rows = ngram_join.jaccard_components(docs_of(odd)).collect()
    assert len(rows) == len(odd)
    got = {(x.doc_id, x.component_id) for x in rows}
    assert {(0, 0), (1, 1), (2, 2), (3, 3), (4, 3), (5, 5), (6, 5), (None, 7), (7, 7), (8, 8)} - {(8, 8)} <= got
    assert sum(x.doc_id == 5 for x in ngram_join.deduplicated(docs_of(odd)).collect()) == 1
    assert ngram_join.jaccard_components(docs_of([])).count() == 0


def test_only_nodes_that_can_link_travel(spark):
    sizes = spark.createDataFrame([(1, 100), (2, 75), (3, 74), (4, 40), (5, 30)], "node long, n long")
    rows = [(9, k, k) for k in range(1, 5)] + [(8, 1, 7), (8, 2, 7), (6, 4, 4), (6, 5, 5)]
    tiles = spark.createDataFrame(rows, "tile long, node long, label long")
    got = ngram_join._paired(tiles, sizes, 75, 100).collect()
    assert sorted((x.tile, x.node) for x in got) == [(6, 4), (6, 5), (9, 1), (9, 2), (9, 3)]


def test_groups_of_many_copies(spark):
    """Three nodes share a shingle; copies of each go over several Arrow batches."""
    rows = [(node, [7]) for node, copies in [(1, 1500), (2, 1500), (3, 10)] for _ in range(copies)]
    nodes = spark.createDataFrame(rows, "node long, rarest array<long>")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "400")
    try:
        got = ngram_join.shared_groups(nodes).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert sorted(x.node for x in got) == [1, 2, 3] and len({x.grp for x in got}) == 1


def test_sharding(spark, docs_of, odd):
    texts = [(k, "x" * (k * 37 % 900)) for k in range(300)] + [(777, "y" * 400)] * 20 + [(None, "z" * 5000)]
    rows = sharding.assign(docs_of(texts), limit=3000).select("*", "shard.*").collect()
    assert len(rows) == len(texts) and "extra" in rows[0].asDict()
    sums = {}
    for x in rows:
        key = (x.depth, x.prefix, x.part)
        sums.setdefault(key, []).append(len(x.text))
        assert x.shard_bytes == sum(len(y.text) for y in rows if (y.depth, y.prefix, y.part) == key)
    assert all(sum(v) <= 3000 or len(v) == 1 for v in sums.values())
    leaves = {(d, p) for d, p, _ in sums}
    assert not any(d2 > d1 and p2 >> (d2 - d1) == p1 for d1, p1 in leaves for d2, p2 in leaves)
    assert sharding.assign(docs_of(odd)).count() == len(odd) and sharding.assign(docs_of([])).count() == 0


def test_shards_are_written(spark, docs_of, odd, tmp_path, monkeypatch):
    size = F.octet_length("text")
    for k, rows in enumerate([odd, []]):
        docs, path = docs_of(rows), str(tmp_path / f"shards{k}")
        sharding.write_shards(docs, path, limit=3000)
        got = sharding.read_shards(spark, path, docs.schema, size)
        assert sorted(map(repr, got.collect())) == sorted(map(repr, sharding.assign(docs, limit=3000).collect()))
    monkeypatch.setattr(sharding, "new_folder", lambda spark: str(tmp_path / "query"))
    n = QUERIES["op2_sharding"](spark, SF).count()
    written = spark.read.parquet(str(tmp_path / "query"))
    whole = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    assert n == whole.count() and whole.exceptAll(written.select("doc_id", "text")).isEmpty()


def test_hot_key_is_dealt(docs_of, monkeypatch):
    """One key with many copies and sizes: no window holds all its rows, and every part fits."""
    docs = docs_of([(1, "y" * (k * 37 % 2000)) for k in range(600)] + [(1, "z" * 300)] * 400 + [(1, None)] * 50 + [(1, "x" * 5000)])
    plan = sharding.assign(docs, limit=3000)._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition(hash" in plan and not re.search(r"windowspecdefinition\(hash#\d+L, bytes#", plan)
    monkeypatch.setattr(sharding, "CHAIN_ROWS", 100)
    rows = sharding.assign(docs, limit=3000).select("*", "shard.*").collect()
    parts = {}
    for x in rows:
        parts.setdefault(x.part, []).append((len(x.text or ""), x.shard_bytes))
    assert len(rows) == 1051 and all(n == sum(a for a, _ in v) for v in parts.values() for _, n in v)
    assert all(sum(a for a, _ in v) <= 3000 or len(v) == 1 for v in parts.values())


def test_samples_with_repeated_ids(spark, docs_of):
    """One id, or none, with many texts and copies: samples are bounded and hold other ids too."""
    rows = [(i, f"own text {k}") for k in range(600) for i in (5, None)] + [(5, "one copy")] * 300 + [(100 + k, f"other {k}") for k in range(600)]
    docs = docs_of(rows)
    labels = spark.createDataFrame([(i, 1) for i in [5, *range(100, 700)]], "doc_id long, toxic int")
    got = toxicity.labelled(docs, labels, F.lit(True), 200).collect()
    assert len(got) == len({x.text for x in got}) == 200 and {x.text.split()[0] for x in got} >= {"own", "other"}
    assert len(toxicity.labelled(docs, labels, F.lit(True), 5000).collect()) == 1201
    texts = [x.text for x in language.drawn(docs, 100).collect()]
    assert 50 < len(texts) < 150 and sum(t.startswith("other") for t in texts) > 10
    assert sum(x.text == "one copy" for x in language.drawn(docs, 5000).collect()) == 1


def test_folding():
    assert toxicity.folded("You 1d10t!! ІDІОT, c1ow-n $$$") == " you idiot idiot ciow n "
    assert toxicity.folded("") == "  "


def test_toxicity(spark, docs_of, odd):
    r = random.Random(3)
    words = [f"word{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(400)]
    texts, labels = [], []
    for k in range(600):
        t, bad = r.choices(words, k=60), k % 5 == 0
        if bad:
            t[r.randrange(60)] = r.choice(["vile", "v1le", "nasty"])
        elif k % 100 == 2:
            t[10:12] = ["nasty", "weather"]
        texts.append(" ".join(t))
        labels.append((k, int(bad)))
    docs, labels = docs_of(texts), spark.createDataFrame([*labels, (None, 1), (9999, None)], "doc_id long, toxic int")
    lexicon = toxicity.fit(docs, labels, F.col("doc_id") % 2 == 0)
    assert "vile" in lexicon.weights and "nasty weather" in lexicon.exceptions
    got = {x.doc_id: x.toxicity.predicted for x in toxicity.scored(docs, lexicon).collect()}
    assert sum(got[k] == (k % 5 == 0) for k in range(600)) >= 595
    rows = toxicity.scored(docs_of([*odd, (50, "so vile")]), lexicon).collect()
    assert len(rows) == len(odd) + 1 and all(0 <= x.toxicity.score <= 1 for x in rows)
    assert [x.toxicity.predicted for x in rows if x.doc_id in (0, 1, 50)] == [0, 0, 1]
    assert toxicity.scored(docs_of([]), toxicity.fit(docs_of([]), labels, F.lit(True))).count() == 0


def test_toxicity_stems(docs_of, spark):
    """Words of one beginning that each occur rarely are learned as a stem; a term within another isn't counted twice."""
    assert toxicity.terms_of("abcde") == ["abcde", "abc*", "abcd*"]
    assert toxicity._apart([("vile*", 2.0), ("vileness", 3.0), ("vil*", 1.0), ("vilify", 1.0)], 9) == {"vile*": 2.0, "vilify": 1.0}
    r = random.Random(5)
    words = [f"word{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(400)]
    texts, labels = [], []
    for k in range(600):
        t = r.choices(words, k=60)
        if k % 5 == 0:
            t[r.randrange(60)] = "grub" + "".join(r.choices("aeiou", k=4))
        texts.append(" ".join(t))
        labels.append((k, int(k % 5 == 0)))
    lexicon = toxicity.fit(docs_of(texts), spark.createDataFrame(labels, "doc_id long, toxic int"), F.col("doc_id") % 2 == 0)
    assert list(lexicon.weights) == ["grub*"]
    got = {x.doc_id: x.toxicity.predicted for x in toxicity.scored(docs_of(texts), lexicon).collect()}
    assert all(got[k] == (k % 5 == 0) for k in range(600))


def test_packing(spark, docs_of, odd):
    rows = packing.pack_documents(docs_of([(i, t) for i, (_, t) in enumerate(odd * 3)]), BYTE_VOCABULARY).collect()
    whole = Encoder(BYTE_VOCABULARY, True)
    docs, seqs = {}, {}
    for x in rows:
        docs.setdefault(x.doc_id, []).append(x)
        seqs.setdefault(x.sequence_id, []).append(x)
    for i, (_, t) in enumerate(odd * 3):
        ids = np.append(np.frombuffer(whole.one(t), "<u2") if t else [], 0).astype("<u4")
        at = 0
        for x in sorted(docs[i], key=lambda x: x.start):
            assert (x.start, x.doc_tokens, x.ids_crc32) == (at, len(ids), zlib.crc32(ids[at:at + x.length].tobytes()))
            at += x.length
        assert at == len(ids)
    for xs in seqs.values():
        at = 0
        for x in sorted(xs, key=lambda x: x.offset):
            assert x.offset == at
            at += x.length
        assert at <= 1024
    assert packing.pack_documents(docs_of([]), BYTE_VOCABULARY).count() == 0


@pytest.mark.parametrize(("path", "spaces"), [(BYTE_VOCABULARY, True), (WORD_VOCABULARY, False)])
def test_encoder_equals_whole_calls(path, spaces):
    r = random.Random(3)
    signs = ["a", "B", "é", " ", "  ", "\n", "\t", "\xa0", "\x1c", "'s", "'", "1", "23", "|", "!", "<|endoftext|>", "ñ", "中", "é", "İ", "Σ", "\r\n", "x", "​"]
    texts = ["".join(r.choices(signs, k=r.randint(0, 12))) for _ in range(3000)]
    known = Encoder(path, spaces)
    assert [x for x, y in zip(texts, known.encode(texts)) if y != known.one(x)] == []


def test_fingerprints(docs_of, odd):
    texts = [t for _, t in odd] + ["same text here.\nAnd more of it, yes."] * 2 + ["x", "Same text here.\nAnd more of it, yes."]
    got = {x.doc_id: x for x in fingerprints.fingerprints(docs_of(texts)).collect()}
    for i, t in enumerate(texts):
        t, nxt = t or "", texts[(i + 1) % len(texts)] or ""
        edited = t[:len(t) - len(t) // 2] + nxt[:len(t) // 2]
        assert (got[i].n_chars, got[i].edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert got[i].edited_fingerprint == fingerprints.trees([edited])[0][0]
        assert got[i].near_next == fingerprints.likeness(got[i].fingerprint, got[(i + 1) % len(texts)].fingerprint)
    for a, b in itertools.combinations(range(len(texts)), 2):
        assert (got[a].fingerprint == got[b].fingerprint) == ((texts[a] or "") == (texts[b] or ""))
    one, other = (fingerprints.trees([t])[0][0] for t in ("a b c d e\nf g h i", "a b c d e\nf g h j"))
    assert {x[:2] for x in fingerprints.differing(one, other)} == {(0, 1)} and fingerprints.differing(one, one) == []
    assert fingerprints.fingerprints(docs_of([])).count() == 0 and fingerprints.fingerprints(docs_of(odd)).count() == len(odd)


def test_language(spark, docs_of, odd):
    rows = spark.read.parquet(f"{SF}/documents.parquet")
    fit = language.fit(rows.where("doc_id % 2 = 0"))
    got = language.identified(rows.where("doc_id % 2 = 1"), fit).select("*", "language.*").collect()
    assert sum(x.lang == x.lang_pred for x in got) >= 0.97 * len(got) and not any(x.rejected for x in got if x.n_chars > 200 and x.lang == x.lang_pred and x.score > 0.6)
    rows = {x.doc_id: x for x in language.identified(docs_of([*odd, (60, "12 34 !?"), (61, "qzx" * 4000)]), fit).select("*", "language.*").collect()}
    assert all(rows[i].lang_pred == "und" and rows[i].rejected and rows[i].score == 0 for i in (0, 1, 2, 60))
    assert rows[61].rejected and all(0 <= x.score <= 1 for x in rows.values())
    assert {x.lang_pred for x in language.identified(docs_of(odd), language.fit(docs_of([]))).select("language.*").collect()} == {"und"}


@pytest.mark.parametrize("block", [2048, 16])
def test_vector_join(spark, monkeypatch, block):
    monkeypatch.setattr(vector_join, "BLOCK", block)
    r = np.random.default_rng(2)
    centres = r.normal(size=(20, 16))
    x = (centres[r.integers(0, 20, 200)] + 0.15 * r.normal(size=(200, 16))).astype(np.float32)
    vectors = [v.tolist() for v in x] + [x[0].tolist()] * 3 + [None, [], [0.0] * 16, [float("nan")] * 16, [None] * 16, [float("inf")] + [1.0] * 15, x[0].tolist()[:8]]
    good = [v is not None and len(v) > 0 and all(c is not None and np.isfinite(c) for c in v) and any(v) for v in vectors]
    pairs = []
    for a, b in itertools.combinations(range(len(vectors)), 2):
        if good[a] and good[b] and len(vectors[a]) == len(vectors[b]):
            p, q = np.array(vectors[a], float), np.array(vectors[b], float)
            if p @ q / np.sqrt((p @ p) * (q @ q)) >= 0.95:
                pairs.append((a, b))
    at = classes(len(vectors), pairs)
    links = [sum(i in p for p in pairs) for i in range(len(vectors))]
    df = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<float>")
    got = {y.vec_id: (y.n_links, y.component_id, y.kept) for y in vector_join.near_vectors(df).collect()}
    assert got == {i: (links[i], at[i], at[i] == i) for i in range(len(vectors))}
    assert vector_join.near_vectors(df.limit(0)).count() == 0


def test_edit_counts(spark, docs_of, odd):
    r = random.Random(4)
    texts = [t for _, t in odd] + ["".join(r.choices("ab c.\n'é1 ", k=r.randrange(900))) for _ in range(60)]
    edits = {i: [(r.randrange(1000), r.randrange(40), "".join(r.choices("xy z\n's ", k=r.randrange(9)))) for _ in range(4)] for i in range(len(texts))}
    docs = docs_of(texts)
    todo = spark.createDataFrame([(i, e) for i, e in edits.items()], "doc_id long, edits array<struct<at:long,cut:long,put:string>>")
    known = Encoder(BYTE_VOCABULARY, True)
    for x in edit_counts.counts_after_edits(docs.join(todo, "doc_id"), "edits", BYTE_VOCABULARY, span=32).collect():
        text = texts[x.doc_id] or ""
        assert x.n_tokens == len(known.one(text)) // 2
        for at, cut, put in edits[x.doc_id]:
            at = min(at, len(text))
            text = text[:at] + put + text[at + cut:]
        assert (x.edited_chars, x.edited_tokens) == (len(text), len(known.one(text)) // 2)
        if len(text) > 100_000:
            assert x.reencoded_chars < 2000


def test_mixing_cases(spark, docs_of, odd):
    docs = docs_of([*odd, *((100 + k, "w " * (k % 7 + 1)) for k in range(200))])
    docs = docs.withColumn("source", F.when(F.col("doc_id") % 4 == 3, None).otherwise(F.col("source")))
    rows = mixing.mix_report(docs).collect()
    assert len(rows) == docs.count() and all(x.taken <= 3 * x.size for x in rows)
    assert abs(sum({x.source_size: x.target for x in rows}.values()) - sum(x.size for x in rows)) < 1
    assert sorted(map(tuple, mixing.mix_report(docs.repartition(5)).collect()), key=repr) == sorted(map(tuple, rows), key=repr)
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns and mixed.select(F.sum(F.regexp_count("text", F.lit(mixing.WORDS)))).first()[0] == sum(x.taken for x in rows)
    assert mixing.mix_report(docs_of([])).count() == 0 and mixing.mixed_documents(docs_of([])).count() == 0


def test_token_files(spark, docs_of, odd, tmp_path):
    docs = docs_of([*odd, *((1000 - k, f"text {k} words") for k in range(50))])
    folder = str(tmp_path / "ids")
    token_files.write_token_files(docs, WORD_VOCABULARY, folder, block_ids=500)
    known, at = Encoder(WORD_VOCABULARY, False), 0
    expected = []
    for x in sorted(docs.collect(), key=lambda x: (x.doc_id is not None, x.doc_id, x.text is not None, x.text)):
        ids = np.append(np.frombuffer(known.one(x.text), "<u2") if x.text else [], 2).astype("<u4")
        expected.append((x.doc_id, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    got = [tuple(x) for x in token_files.token_digests(spark, folder).orderBy("start").collect()]
    assert got == expected
    assert all(len(x.ids) == x.n_tokens for x in token_files.read_token_files(spark, folder).collect())
    token_files.write_token_files(docs_of([]), WORD_VOCABULARY, str(tmp_path / "none"))
    assert token_files.token_digests(spark, str(tmp_path / "none")).count() == 0


def test_id_coding():
    ids = np.random.default_rng(0).zipf(1.3, 5000).clip(0, 1 << 22).astype("<u4")
    ids = np.append(ids, np.arange(70_000)).astype("<u4")
    for part in (ids, ids[:1], ids[:7], np.zeros(3, "<u4")):
        assert (token_files.decode_ids(*token_files.encode_ids(part), len(part)) == part).all()


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {x.doc_id: x for x in docs.collect()}
    left, stages = docs, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        left = corpus_pipeline.written(stage(spark, left, SF), "test-stage")
        assert left.columns == docs.columns
        stages.append(left.collect())
    language_kept, clean, single, mix = ([x.doc_id for x in s] for s in stages)
    assert set(language_kept) >= {i for i, x in texts.items() if x.n_chars > 20} - {i for i, x in texts.items() if len(set(x.text.split())) < 20}
    toxic = {x.doc_id for x in spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 1").collect()}
    assert len(set(language_kept) - set(clean) - toxic) <= 0.02 * len(clean)
    sets = [shingles(texts[i].text) for i in sorted(clean)]
    pairs = [(a, b) for a, b in itertools.combinations(range(len(sets)), 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    at = classes(len(sets), pairs)
    assert sorted(single) == [i for k, i in enumerate(sorted(clean)) if at[k] == k]
    report = {x.doc_id: x for x in mixing.mix_report(docs.where(F.col("doc_id").isin(single))).collect()}
    assert all(mix.count(i) * x.size == x.taken for i, x in report.items())
    pieces = corpus_pipeline.run(spark, SF).collect()
    assert sum(x.length for x in pieces) == sum(x.doc_tokens for x in pieces if x.start == 0)
    assert sorted(x.doc_id for x in pieces if x.start == 0) == sorted(mix)
