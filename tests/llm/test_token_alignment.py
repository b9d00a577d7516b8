"""Alignment of two tokenizers against a plain version, token by token."""

import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from narraplan.llm import token_alignment
from narraplan.llm.queries import BYTE_VOCABULARY, QUERIES

SF = "/root/testdata/sf0.001"
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def brute(texts):
    """Rows of the contract, by loops over tokens and all pairs of a document."""
    a_lib = Tokenizer.from_file(BYTE_VOCABULARY)
    a_lib.encode_special_tokens = True
    b_lib = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    plain = [b for b in range(256) if 33 <= b < 127 or 161 <= b < 173 or b >= 174]
    letter = {b: chr(b) for b in plain}
    for k, b in enumerate(x for x in range(256) if x not in plain):
        letter[b] = chr(256 + k)
    byte = {c: b for b, c in letter.items()}
    rows, holds = [], Counter()
    for text in texts:
        a = b = []
        if text:
            a = [(t, bytes(byte[c] for c in a_lib.id_to_token(t))) for t in a_lib.encode(" " + text, add_special_tokens=False).ids]
            b = [(t, bytes([int(b_lib.id_to_piece(t)[3:5], 16)]) if b_lib.is_byte(t) else b_lib.id_to_piece(t).replace("▁", " ").encode())
                 for t in b_lib.encode(text)]
            want = (" " + text).encode()
            if b"".join(x for _, x in a) != want or b"".join(x for _, x in b) != want:
                a = b = []
        spans = []
        for side in (a, b):
            at, made = 0, []
            for t, x in side:
                made.append((t, at, at + len(x)))
                at += len(x)
            spans.append(made)
        links = [(x[0], y[0]) for x in spans[0] for y in spans[1] if x[1] < y[2] and y[1] < x[2]]
        cuts = sorted({x[2] for x in spans[0]} & {x[2] for x in spans[1]})
        groups, low = [], 0
        for high in cuts:
            groups.append("|".join(",".join(str(t) for t, _, e in side if low < e <= high) for side in spans))
            low = high
        holds.update(set(links))
        rows.append((len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""))
    most = defaultdict(int)
    for (x, _), n in holds.items():
        most[x] = max(most[x], n)
    return [(na, nb, ng, len(ls), sum(holds[p] == most[p[0]] for p in ls), sum(holds[p] for p in ls), sha) for na, nb, ng, ls, sha in rows]


def shape(rows):
    return [(x.n_a, x.n_b, x.n_groups, x.n_links, x.n_best, x.count_sum, x.groups_sha256) for x in rows]


def texts_of(seed):
    r = random.Random(seed)
    signs = ["the ", "word", " ", "  ", "\n", "\t", "é", "中文", "😀", "▁", "<s>", "<|endoftext|>", "ing ", "tion", "…", "\x00", "ﬁ", "é", "123 456", "<0x41>"]
    return ["".join(r.choices(signs, k=r.randrange(1, 40))) for _ in range(60)] + [None, "", " ", "a", "the the the", "the the the"]


@pytest.mark.parametrize("pairs", [1 << 22, 20], ids=["all pairs broadcast", "rare pairs joined"])
def test_against_plain(docs_of, monkeypatch, pairs):
    monkeypatch.setattr(token_alignment, "PAIRS", pairs)
    monkeypatch.setattr(token_alignment, "HELD", 50)
    texts = texts_of(3)
    rows = sorted(token_alignment.linked_counts(docs_of(texts), BYTE_VOCABULARY, PIECES).collect(), key=lambda x: x.doc_id)
    assert [x.doc_id for x in rows] == list(range(len(texts)))
    assert shape(rows) == brute(texts)
    assert any(x.n_a for x in rows) and any(t and not x.n_a for t, x in zip(texts, rows))


def test_odd_rows(docs_of, odd):
    rows = token_alignment.linked_counts(docs_of([*odd, (3, None)]), BYTE_VOCABULARY, PIECES).collect()
    assert len(rows) == len(odd) + 1
    same = [x for x in rows if x.doc_id == 5]
    assert len(same) == 2 and same[0] == same[1]
    assert {x.groups_sha256 for x in rows if x.doc_id in (0, 1)} == {""} and sum(x.doc_id is None for x in rows) == 1
    assert sum(x.n_a > 60_000 for x in rows) == 2
    assert token_alignment.linked_counts(docs_of([]), BYTE_VOCABULARY, PIECES).count() == 0


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a text", 5, "x", 3)], "doc_id long, text string, uid int, pairs string, n_a int")
    row = token_alignment.linked_counts(docs, BYTE_VOCABULARY, PIECES).first()
    assert row.doc_id == 1 and shape([row]) == brute(["a text"])


def test_query(spark):
    got = {x.doc_id: x for x in QUERIES["op11_token_alignment"](spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    short = [d for d in docs if len(d.text or "") < 1500]
    assert len(got) == len(docs)
    for d, want in zip(short, brute([d.text for d in short])):
        x = got[d.doc_id]
        assert (x.n_a, x.n_b, x.n_groups, x.n_links, x.groups_sha256) == (*want[:4], want[6])
        assert x.count_sum >= want[5]
