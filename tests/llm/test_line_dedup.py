"""Line dedup against a plain version; filters, odd rows, clashing names."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from narraplan.llm import line_dedup
from narraplan.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def key_of(line):
    return re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))


def brute(rows):
    """(doc_id, n_lines, n_dropped, kept) of each row; a null id comes last."""
    holds = defaultdict(set)
    order = lambda i: (i is None, i or 0)
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(key_of(line)) >= 10:
                holds[key_of(line)].add(i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(holds[key_of(x)]) < 2 or i == min(holds[key_of(x)], key=order)]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=lambda r: (order(r[0]), r[1:]))


def got(df):
    rows = [(x.doc_id, x.lines.n_lines, x.lines.n_dropped, x.lines.kept) for x in df.collect()]
    return sorted(rows, key=lambda r: ((r[0] is None, r[0] or 0), r[1:]))


def corpus(seed):
    r = random.Random(seed)
    lines = [f"line number {k} of this text" for k in range(25)] + ["short", "", "   ", "nine char", "ten chars!", "é" * 9, "é" * 10, "\r", "中文" * 6]
    vary = [lambda x: x, str.upper, lambda x: f" \t{x}\r", lambda x: x + "\x0b", lambda x: "\xa0" + x]
    texts = ["\n".join(r.choice(vary)(r.choice(lines)) for _ in range(r.randrange(1, 12))) for _ in range(60)]
    return [(k, t) for k, t in enumerate(texts)] + [(3, texts[0]), (3, texts[5]), (None, texts[7]), (None, texts[7]), (70, None), (71, ""), (72, "\n\n")]


@pytest.mark.parametrize("bits", [1 << 20, 64], ids=["sparse filter", "full filter"])
def test_against_plain(docs_of, monkeypatch, bits):
    monkeypatch.setattr(line_dedup, "LEAST_BITS", bits)
    monkeypatch.setattr(line_dedup, "MOST_BITS", bits)
    monkeypatch.setattr(line_dedup, "HEAVY", 8)
    for seed in (1, 2):
        rows = corpus(seed)
        assert got(line_dedup.without_repeats(docs_of(rows).repartition(5))) == brute(rows)


def test_odd_rows(docs_of, odd):
    df = line_dedup.without_repeats(docs_of(odd))
    assert df.columns == [*docs_of([]).columns, "lines"]
    assert got(df) == brute(odd)
    assert line_dedup.without_repeats(docs_of([])).count() == 0


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "the same line here", 5, "x", 0), (2, "the same line here", 6, "y", 1)],
                                 "doc_id long, text string, others int, numbers string, kept int")
    rows = sorted(line_dedup.without_repeats(docs).collect())
    assert [(x.others, x.numbers, x.kept, x.lines.kept) for x in rows] == [(5, "x", 0, "the same line here"), (6, "y", 1, "")]
    with pytest.raises(ValueError, match="lines"):
        line_dedup.without_repeats(docs.withColumnRenamed("others", "lines"))
    renamed = line_dedup.without_repeats(docs.withColumnRenamed("others", "lines"), "found")
    assert renamed.columns[-1] == "found"


def test_lines_of_a_block():
    r = random.Random(4)
    texts = ["".join(r.choices(["a", "B", " ", "\n", "é", "\t", "中"], k=r.randrange(12))) for _ in range(300)] + [None, "", "\n"]
    lines = line_dedup.Lines(pa.array(texts))
    at = 0
    for row, text in enumerate(texts):
        for number, line in enumerate((text or "").split("\n")):
            key = key_of(line)
            assert (lines.row[at], lines.number[at], lines.points[at]) == (row, number, len(key))
            assert lines.digest(at) == hashlib.sha256(key.encode()).digest()
            at += 1
    assert at == len(lines.row)
    same = {}
    for k in range(at):
        assert same.setdefault(lines.digest(k), lines.hash[k]) == lines.hash[k]
    assert len(set(same.values())) == len(same)


def test_filters_miss_nothing():
    r = np.random.default_rng(1)
    h = r.integers(0, 2**63, 5000).astype(np.uint64)
    one, two = line_dedup.Filter(1 << 16), line_dedup.Filter(1 << 16)
    one.add(h[:3000]), two.add(h[2500:])
    parts = [b for f in (one, two) for b in line_dedup.segments(f, line_dedup.Filter(1 << 16))]
    (merged,) = line_dedup._merge(iter(sorted(parts, key=lambda b: b.column(0)[0].as_py())))
    both = line_dedup.Filter(1 << 16, np.frombuffer(merged.column(1)[0].as_py(), np.uint64))
    assert both.has(h[2500:3000]).all() and both.has(h[:2500]).mean() < 0.05


def test_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    want = [(i, n, d, hashlib.sha256(t.encode()).hexdigest()) for i, n, d, t in brute([(x.doc_id, x.text) for x in docs])]
    rows = sorted(tuple(x) for x in QUERIES["op13_line_dedup"](spark, SF).select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect())
    assert rows == want and sum(x[2] for x in rows) > 0
