"""Conversation repair against a search over all edits, and on odd rows."""

import hashlib
import heapq
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from narraplan.llm import conversation_repair as cr
from narraplan.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
TURNS = "conv_id long, turn long, role string, text string"
EMPTY = hashlib.sha256(b"").hexdigest()


def cheapest(turns):
    """(cost, audit, repaired) by best-first search over edits on the regular expression itself; no automaton, nothing is merged but equal outputs."""
    heap, done = [(0, "", 0, ())], set()
    while heap:
        cost, audit, at, out = heapq.heappop(heap)
        letters = "".join(r[:1] if r[:1] in ("s", "u", "a") else "?" for r, _ in out)
        if not re.fullmatch("(s?(ua)*u?)?", letters):
            continue
        if at == len(turns) and re.fullmatch("(s?(ua)+)?", letters):
            return cost, audit, out
        # Of what was made, only the last letter and whether anything was made can matter further on.
        mark = (at, letters[-1:], len(letters) == 1 and letters == "s", bool(letters))
        if mark in done:
            continue
        done.add(mark)
        for role in ("user", "assistant"):
            heapq.heappush(heap, (cost + 2, audit + "I", at, (*out, (role, ""))))
        if at < len(turns):
            role, text, bad, cut = turns[at]
            heapq.heappush(heap, (cost + 3, audit + "D", at + 1, out))
            if not bad:
                heapq.heappush(heap, (cost + cut, audit + "K", at + 1, (*out, (role, text))))
                for new in ("user", "assistant"):
                    heapq.heappush(heap, (cost + 2 + cut, audit + "R", at + 1, (*out, (new, text))))


def brute(rows):
    """Report rows from (conv_id, turn, role, text), already damaged."""
    found = {}
    for c in {r[0] for r in rows}:
        mine = sorted(((t is not None, t or 0, r if r is not None else " ", x if x is not None else " ") for i, t, r, x in rows if i == c))
        seen, flags, counts = set(), [], [0, 0, 0]
        for _, _, role, text in mine:
            blank, duplicate = not text.strip(cr.WHITE), (role, text) in seen
            seen.add((role, text))
            cut = not blank and not duplicate and text.rstrip(cr.WHITE)[-1] not in ".!?"
            for k, f in enumerate((blank, duplicate and not blank, cut)):
                counts[k] += f
            flags.append((role, text, blank or duplicate, int(cut)))
        numbers = {t for some, t, _, _ in mine if some}
        gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(flags, flags[1:]))
        cost, audit, out = cheapest(flags)
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()
        found[c] = (gaps, *counts, illegal, cost, audit, sha, [(r, t) for r, t in out])
    return found


def report(df):
    return {x.conv_id: (x.gaps, x.blank, x.duplicate, x.truncated, x.illegal, x.cost, x.audit, x.repaired_sha256) for x in df.collect()}


def conversations(seed, n=120, longest=11):
    r = random.Random(seed)
    texts = ["Yes.", "No!", "cut off", "", " \n", "So?  ", "What", "é.", "Yes."]
    return [(c, r.choice([*range(longest), None]), r.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]),
             r.choice([*texts, f"text {r.random()}.", None]))
            for c in range(n) for _ in range(r.randrange(1, longest))]


@pytest.mark.parametrize("replay", [1, 32])
def test_against_search(spark, monkeypatch, replay):
    monkeypatch.setattr(cr, "REPLAY", replay)
    rows = conversations(5)
    turns = spark.createDataFrame(rows, TURNS)
    want = brute(rows)
    assert report(cr.repair_report(turns)) == {c: w[:-1] for c, w in want.items()}
    made = {}
    for x in sorted(cr.repaired_turns(turns).collect()):
        assert x.position == len(made.setdefault(x.conv_id, []))
        made[x.conv_id].append((x.role, x.text))
    assert made == {c: w[-1] for c, w in want.items() if w[-1]}


def test_hand_made(spark):
    def one(*turns):
        rows = [(1, k, r, t) for k, (r, t) in enumerate(turns)]
        return report(cr.repair_report(spark.createDataFrame(rows, TURNS)))[1][5:7]

    u, a, s = ("user", "Hi."), ("assistant", "Yes."), ("system", "Be kind.")
    assert one(s, u, a) == (0, "KKK")
    assert one(u, ("user", "More.")) == (2, "KR")
    assert one(a, ("user", "More.")) == (4, "IKKI")
    assert one(u) == (2, "KI") and one(s) == (3, "D")
    assert one(u, a, a) == (3, "KKD")
    assert one(u, ("assistant", "cut")) == (1, "KK")
    assert one(u, ("assistant", " ")) == (5, "KDI")


def test_long_conversation_is_not_held():
    """Turns that all parses agree on are let go."""
    out = []
    held = cr.Conversation(lambda *row: out.append(row))
    most = 0
    for k in range(20_000):
        held.turn(k, "user" if k % 2 == 0 else "assistant", f"turn {k}." if k % 7 else "same.")
        most = max(most, len(held.waiting), *(len(t.audit) for t in held.tops.values()))
    cost, audit = held.finish()
    assert most < 100 and cost > 0 and len(out) == sum(e != "D" for e in audit)
    letters = "".join(r[0] for r, _, _ in out)
    assert letters == "ua" * (len(letters) // 2)


def test_odd_rows(spark):
    rows = [(None, 0, "user", "A."), (None, 1, "assistant", "B."), (1, None, None, None), (2, 0, "user", "x" * 3_000_000 + "."),
            (2, 0, "user", "x" * 3_000_000 + "."), (3, 5, "user", "Q?"), (3, 5, "assistant", "A."), (3, None, "system", "S.")]
    got = report(cr.repair_report(spark.createDataFrame(rows, TURNS)))
    assert got == {c: w[:-1] for c, w in brute(rows).items()}
    assert got[None][5:7] == (0, "KK") and got[1] == (0, 1, 0, 0, 0, 3, "D", EMPTY)
    assert cr.repair_report(spark.createDataFrame([], TURNS)).count() == 0
    assert cr.repaired_turns(spark.createDataFrame([], TURNS)).count() == 0
    extra = spark.createDataFrame([(1, 0, "user", "A.", "x", 7)], TURNS + ", audit string, position int")
    assert report(cr.repair_report(extra)) == {1: (0, 0, 0, 0, 0, 2, "KI", hashlib.sha256(b"user:A.\nassistant:").hexdigest())}
    assert cr.repaired_turns(extra).count() == 2


def harm(rows):
    out = []
    for c, t, r, x in rows:
        code = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = " " if r is None else r, " " if x is None else x
        x = "" if code == 1 else re.sub("[.!?]", "", x) if code == 2 else x
        out += [(c, t, "user" if code == 4 else r, x)] * (0 if code == 0 else 2 if code == 3 else 1)
    return out


def test_damage(spark):
    rows = [(k % 37 if k % 5 else None, k if k % 7 else None, "assistant", f"Text {k}. And?") for k in range(400)]
    got = cr.damaged(spark.createDataFrame(rows, TURNS)).where("present").select("conv_id", "turn", "role", "text").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, harm(rows)))


def test_query(spark):
    whole = [tuple(x) for x in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    want = {c: w[:-1] for c, w in brute(harm(whole)).items()}
    ids = {r[0] for r in whole}
    want |= {c: (0, 0, 0, 0, 0, 0, "", EMPTY) for c in ids - set(want)}
    assert report(QUERIES["op12_conversation_repair"](spark, SF)) == want


def test_present_rows_only(spark):
    rows = spark.createDataFrame([(1, 0, "user", "A.", False), (2, 0, "user", "A.", None)], TURNS + ", present boolean")
    got = report(cr.repair_report(rows))
    assert got[1] == (0, 0, 0, 0, 0, 0, "", EMPTY) and got[2][6] == "KI"
    assert cr.repaired_turns(rows.withColumn("present", F.lit(False))).count() == 0
