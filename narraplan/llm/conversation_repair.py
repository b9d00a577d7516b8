"""Conversation structure repair: generalised LR parsing of roles with weighted edits.

Role grammar, over the first letters of roles:  C -> (nothing) | D    D -> P | s P | D P    P -> u a
A conversation is read once, turn by turn. All parses are kept at once in a graph-structured stack: a top is an LR state
with the states below it, and equal tops are merged, the least (cost, audit) staying. Every turn is deleted, kept or
re-roled on every top; between turns the missing role may be inserted. Merging is exact: an audit's letters fix its cost
(given the turns) and two audits of equal cost over the same turns are never one the beginning of the other, so the
lesser of two stays the lesser with any continuation. A top whose cost exceeds the least by more than MARGIN can't be in the
best parse, since every state does what another can with edits of at most 5 more; it goes.

Parses soon agree on all but the last turns. The beginning that all tops share is replayed and let go, so a task holds few
turns, whatever a conversation's length; besides them the audit, one letter an edit, and 16 bytes for each different turn.
A conversation is hashed and numbered in its order, which is serial work: one task reads it, sorted, in a stream. Conversations
run in parallel, dealt by conv_id.

Faults, the first of a turn counting: blank (no visible sign), duplicate (role and text seen earlier in the conversation),
truncated (last visible sign is not . ! ?). Blank and duplicate turns are deleted. Costs: Keep 0, Rerole 2, Delete 3,
Insert 2, and 1 for a truncated turn that stays. Ties: the audit that is least in ASCII.

Null role or text is one space (so blank, or a role that can't stay). Turns are ordered by turn, nulls first, then role and
text, so ties and repeated rows have one order. Rows with null conv_id are one conversation. Other columns are ignored. A
conversation without turns has zeros, an empty audit, the digest of the empty string. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from os.path import commonprefix
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
MARGIN = 6
REPLAY = 32
WHITE = " \t\n\x0b\x0c\r"
ROLES = {"u": "user", "a": "assistant"}

# LR states: nothing read, s read, u read (of a pair), pairs read.
START, SYSTEM, USER, PAIRS = range(4)
SHIFT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (PAIRS, "u"): USER}
#: State after P, by the state below the pair: START P and SYSTEM P and PAIRS P all reduce to D on START.
AFTER_PAIR = {START: PAIRS, SYSTEM: PAIRS, PAIRS: PAIRS}
BELOW = {SYSTEM: frozenset([START]), PAIRS: frozenset([START])}
ACCEPTS = (START, PAIRS)


class Top(NamedTuple):
    """A merged top of the stack."""

    cost: int
    audit: str
    below: frozenset


def moves(state: int, top: Top, letter: str) -> list[tuple[int, frozenset]]:
    """Tops after a role's letter: it is shifted, or completes a pair, which is reduced over every state below."""
    if (state, letter) in SHIFT:
        after = SHIFT[state, letter]
        return [(after, BELOW.get(after) or frozenset([state]))]
    if state == USER and letter == "a":
        return [(s, BELOW[s]) for s in {AFTER_PAIR[b] for b in top.below}]
    return []


def offer(tops: dict[int, Top], state: int, cost: int, audit: str, below: frozenset) -> bool:
    """Merge into the top of this state; say whether it became better."""
    old = tops.get(state)
    if old is None:
        tops[state] = Top(cost, audit, below)
        return True
    better = (cost, audit) < (old.cost, old.audit)
    if better or not below <= old.below:
        tops[state] = Top(*((cost, audit) if better else old[:2]), old.below | below)
    return better


def inserted(tops: dict[int, Top]) -> dict[int, Top]:
    """Insert roles until no top gets better. Each costs something, so this ends."""
    again = list(tops)
    while again:
        state = again.pop()
        for letter in ROLES:
            for after, below in moves(state, tops[state], letter):
                if offer(tops, after, tops[state].cost + INSERT, tops[state].audit + "I", below):
                    again.append(after)
    return tops


def read(tops: dict[int, Top], letter: str, bad: bool, cut: bool) -> dict[int, Top]:
    """Tops after one turn: bad ones are deleted, cut ones are truncated."""
    new: dict[int, Top] = {}
    for state, top in tops.items():
        offer(new, state, top.cost + DELETE, top.audit + "D", top.below)
        if bad:
            continue
        more = TRUNCATED if cut else 0
        for after, below in moves(state, top, letter):
            offer(new, after, top.cost + KEEP + more, top.audit + "K", below)
        for role in ROLES:
            for after, below in moves(state, top, role):
                offer(new, after, top.cost + REROLE + more, top.audit + "R", below)
    inserted(new)
    least = min(t.cost for t in new.values())
    return {s: t for s, t in new.items() if t.cost <= least + MARGIN}


class Conversation:
    """One conversation, turn by turn; `emit` gets each repaired (role, text, edit) in order, as soon as all parses agree on it."""

    def __init__(self, emit: Callable[[str, str, str], None]):
        self.emit = emit
        self.tops = inserted({START: Top(0, "", frozenset())})
        self.waiting: list[tuple[str, str]] = []
        self.state = START
        self.seen: set[bytes] = set()
        self.audit: list[str] = []
        self.last_turn = self.least_turn = self.before = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0

    def turn(self, turn: int | None, role: str, text: str) -> None:
        if turn is not None and turn != self.last_turn:
            self.turns += 1
            self.least_turn = turn if self.least_turn is None else self.least_turn
            self.last_turn = turn
        if self.before is not None and self.before + role[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        self.before = role[:1]
        visible = text.rstrip(WHITE)
        mark = hashlib.blake2b(f"{len(role)}:{role}{text}".encode(), digest_size=16).digest()
        blank, duplicate = not visible, mark in self.seen
        self.seen.add(mark)
        cut = not blank and not duplicate and visible[-1] not in ".!?"
        self.blank += blank
        self.duplicate += duplicate and not blank
        self.truncated += cut
        self.waiting.append((role, text))
        self.tops = read(self.tops, role[:1], blank or duplicate, cut)
        if len(self.waiting) >= REPLAY:
            self._replay(commonprefix([t.audit for t in self.tops.values()]))

    def _replay(self, audit: str) -> None:
        """Do the edits that all tops share and take them off the tops."""
        if not audit:
            return
        at = 0
        for edit in audit:
            role, text = ("", "") if edit == "I" else self.waiting[at]
            at += edit != "I"
            if edit == "D":
                continue
            letter = role[:1] if edit == "K" else "a" if self.state == USER else "u"
            self.state = PAIRS if self.state == USER else SHIFT[self.state, letter]
            self.emit(role if edit == "K" else ROLES[letter], text, edit)
        del self.waiting[:at]
        self.audit.append(audit)
        self.tops = {s: t._replace(audit=t.audit[len(audit):]) for s, t in self.tops.items()}

    def finish(self) -> tuple[int, str]:
        """(cost, audit) of the best parse."""
        best = min(self.tops[s][:2] for s in ACCEPTS if s in self.tops)
        self._replay(best[1])
        return best[0], "".join(self.audit)

    @property
    def gaps(self) -> int:
        return self.last_turn - self.least_turn + 1 - self.turns if self.turns else 0


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(whether a conversation begins, conv_id, turn, role, text) of sorted rows; turn rows without `present` only name it."""
    name, first = None, True
    for batch in batches:
        for conv_id, present, turn, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "present", "turn", "role", "text"))):
            begins = first or conv_id != name
            name, first = conv_id, False
            yield begins, conv_id, (turn, role, text) if present else None


def _sorted(turns: DataFrame) -> DataFrame:
    present = F.col("present") if "present" in turns.columns else F.lit(True)
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.coalesce(present, F.lit(True)).alias("present"),
                        F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    # Nulls come first in Spark's ascending order.
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def repair_report(turns: DataFrame, rows: int = 4096) -> DataFrame:
    """Per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    turns has conv_id, turn, role, text, and may have a boolean `present`: rows where it is false are no turns, but their
    conversation is reported.
    """
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    kinds = [pa.int64()] * 7 + [pa.string()] * 2

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        held = name = digest = None

        def emit(role, text, edit):
            digest.update((("" if emit.first else "\n") + f"{role}:{text}").encode())
            emit.first = False

        def end():
            cost, audit = held.finish()
            out.append((name, held.gaps, held.blank, held.duplicate, held.truncated, held.illegal, cost, audit, digest.hexdigest()))

        def batch():
            made = pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)
            out.clear()
            return made

        for begins, conv_id, row in _scanned(batches):
            if begins:
                if held is not None:
                    end()
                    if len(out) >= rows:
                        yield batch()
                held, name, digest, emit.first = Conversation(emit), conv_id, hashlib.sha256(), True
            if row is not None:
                held.turn(*row)
        if held is not None:
            end()
            yield batch()

    return _sorted(turns).mapInArrow(make, ", ".join(f"{n} {'string' if k == pa.string() else 'long'}" for n, k in zip(names, kinds)))


def repaired_turns(turns: DataFrame, rows: int = 4096) -> DataFrame:
    """The repaired conversations: conv_id, position from 0, role, text, edit (K kept, R re-roled, I inserted)."""
    names = ["conv_id", "position", "role", "text", "edit"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        held = name = None

        def emit(role, text, edit):
            out.append((name, emit.at, role, text, edit))
            emit.at += 1

        def batch():
            made = pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)
            out.clear()
            return made

        for begins, conv_id, row in _scanned(batches):
            if begins:
                if held is not None:
                    held.finish()
                held, name, emit.at = Conversation(emit), conv_id, 0
            if row is not None:
                held.turn(*row)
            if len(out) >= rows:
                yield batch()
        if held is not None:
            held.finish()
        if out:
            yield batch()

    return _sorted(turns).mapInArrow(make, "conv_id long, position long, role string, text string, edit string")


def damaged(turns: DataFrame) -> DataFrame:
    """turns with test damage by crc32 of `conv_id:turn` modulo 20: 0 drops a row (present is false), 1 empties its text, 2 removes
    its end marks, 3 repeats it, 4 makes its role user. Null is one space."""
    def filled(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    code = F.crc32(F.concat(filled("conv_id"), F.lit(":"), filled("turn")).cast("binary")) % 20
    text = F.when(code == 1, "").when(code == 2, F.regexp_replace(filled("text"), "[.!?]", "")).otherwise(filled("text"))
    return turns.select(
        "conv_id", "turn", (code != 0).alias("present"), F.when(code == 4, "user").otherwise(filled("role")).alias("role"), text.alias("text"),
        F.explode(F.when(code == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy")).drop("_copy")


def _sql_more(top: str, cost: str, edit: str) -> str:
    """Tops are texts: nine digits of cost, then the audit, so the least text is the least (cost, audit)."""
    return f"(lpad((substr({top}, 1, 9)::int + {cost})::varchar, 9, '0') || substr({top}, 10) || '{edit}')"


def _sql_step() -> dict[str, str]:
    stay = {s: _sql_more(f"t{s}", "3", "D") for s in range(4)}
    keep = {s: _sql_more(f"t{s}", "cut", "K") for s in range(4)}
    role = {s: _sql_more(f"t{s}", "2 + cut", "R") for s in range(4)}
    to_user = ", ".join(f"case when not bad and letter = 'u' then {keep[s]} end, case when not bad then {role[s]} end" for s in (0, 1, 3))
    return {
        "n0": stay[0],
        "n1": f"least({stay[1]}, case when not bad and letter = 's' then {keep[0]} end)",
        "n2": f"least({stay[2]}, {to_user})",
        "n3": f"least({stay[3]}, case when not bad and letter = 'a' then {keep[2]} end, case when not bad then {role[2]} end)",
    }


_STEP = ", ".join(f"{v} as {k}" for k, v in _sql_step().items())
_USER = f"least(n2, {_sql_more('n0', '2', 'I')}, {_sql_more('n1', '2', 'I')}, {_sql_more('n3', '2', 'I')})"
ORACLE = rf"""
with recursive bits as (
  select b, b as c, 0 as k from range(256) t(b)
  union all select b, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, k + 1 from bits where k < 8),
crc as (select list(c order by b) as tab from bits where k = 8),
coded as (
  select *, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as name from conversations),
hit as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
    xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(name, ''), lambda x: ascii(x)::bigint)),
      lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295::bigint) % 20 as code from coded, crc),
rows_ as (
  select conv_id, turn, case when code = 4 then 'user' else role end as role,
    case code when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text
  from hit, range(2) c(copy) where code != 0 and (copy = 0 or code = 3)),
placed as (
  select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as seq,
    rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as visible from rows_),
turns as (
  select conv_id, turn, role, text, seq, substr(role, 1, 1) as letter, visible = '' as blank, visible != '' and nth > 1 as dup,
    (visible != '' and nth = 1 and substr(visible, length(visible), 1) not in ('.', '!', '?'))::int as cut
  from (select *, row_number() over (partition by conv_id, role, text order by seq) as nth from placed)),
flags as (select *, blank or dup as bad, lag(letter) over (partition by conv_id order by seq) as before from turns),
facts as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0)::bigint as gaps, count(*) filter (blank) as blank,
    count(*) filter (dup) as duplicate, sum(cut)::bigint as truncated,
    count(*) filter (before is not null and before || letter not in ('su', 'ua', 'au')) as illegal, count(*) as n from flags group by conv_id),
parse as (
  select conv_id, 0::bigint as seq, '000000000' as t0, null::varchar as t1, '000000002I' as t2, '000000004II' as t3 from facts
  union all
  select conv_id, seq, n0, n1, u2, least(n3, {_sql_more('u2', '2', 'I')}) from (
    select *, {_USER} as u2 from (
      select p.conv_id, f.seq, {_STEP} from parse p join flags f on f.conv_id is not distinct from p.conv_id and f.seq = p.seq + 1))),
best as (
  select p.conv_id, least(t0, t3) as top from parse p join facts f on f.conv_id is not distinct from p.conv_id and f.n = p.seq),
edits as (
  select conv_id, unnest(string_split(substr(top, 10), '')) as edit, generate_subscripts(string_split(substr(top, 10), ''), 1) as k from best),
dealt as (select *, sum((edit != 'I')::int) over (partition by conv_id order by k) as seq from edits),
kept as (
  select d.conv_id, d.k, d.edit, f.role, case when d.edit = 'I' then '' else f.text end as text, f.letter,
    row_number() over (partition by d.conv_id order by d.k) - 1 as place
  from dealt d left join flags f on f.conv_id is not distinct from d.conv_id and f.seq = d.seq where d.edit in ('K', 'R', 'I')),
led as (select *, coalesce(max((place = 0 and edit = 'K' and letter = 's')::int) over (partition by conv_id), 0) as system from kept),
digests as (
  select conv_id, sha256(string_agg(case when edit = 'K' then role when (place - system) % 2 = 0 then 'user' else 'assistant' end || ':' || text,
    chr(10) order by k)) as sha from led group by conv_id)
select i.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate,
  coalesce(truncated, 0)::bigint as truncated, coalesce(illegal, 0)::bigint as illegal, coalesce(substr(top, 1, 9)::bigint, 0)::bigint as cost,
  coalesce(substr(top, 10), '') as audit, coalesce(sha, sha256('')) as repaired_sha256
from (select distinct conv_id from conversations) i
left join facts f on f.conv_id is not distinct from i.conv_id
left join best b on b.conv_id is not distinct from i.conv_id
left join digests d on d.conv_id is not distinct from i.conv_id
"""
