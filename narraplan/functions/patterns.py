"""Many patterns against one text: required fragments by Aho-Corasick, regular expressions only where they occur.

A pattern's parse tree gives literal fragments of which one must stand in any text it matches: a sequence needs what
any one of its parts needs, so the most telling part is taken; alternatives need what either needs. Groups, small
character classes and repeats are followed. All fragments of all patterns go into one automaton, so the cost of a text is
linear in its length whatever the number of patterns. Only a pattern without any literal (all wildcards or wide classes)
is tried on every text.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Most fragments that stand for one pattern part, and most signs of a class that are spelled out.
FRAGMENTS, CLASS_SIGNS = 32, 4
#: Longest fragment; a longer one would not tell more.
LONGEST = 24
Needs = frozenset[str] | None


def _better(one: Needs, other: Needs) -> Needs:
    """The more telling of two: its shortest fragment is longer, or it has fewer fragments."""
    if one is None or other is None:
        return one if other is None else other
    rank = lambda x: (min(map(len, x)), -len(x))
    return max(one, other, key=rank)


def _signs(tree: list) -> list[str] | None:
    """The signs of a small class, or None."""
    found: list[str] = []
    for kind, value in tree:
        name = str(kind)
        if name == "LITERAL":
            found.append(chr(value))
        elif name == "RANGE" and value[1] - value[0] < CLASS_SIGNS:
            found += map(chr, range(value[0], value[1] + 1))
        else:
            return None
    return found if len(found) <= CLASS_SIGNS else None


def _exact(kind: str, value) -> frozenset[str] | None:
    """All texts a part can stand for, if they are few."""
    if kind == "LITERAL":
        return frozenset([chr(value)])
    if kind == "IN":
        signs = _signs(value)
        return frozenset(signs) if signs else None
    if kind == "AT":
        return frozenset([""])
    if kind == "SUBPATTERN" and not value[1] and not value[2]:
        return _exact_run(value[3])
    if kind == "BRANCH":
        ways = [_exact_run(x) for x in value[1]]
        if all(w is not None for w in ways):
            both = frozenset().union(*ways)
            return both if len(both) <= FRAGMENTS else None
    if kind == "MAX_REPEAT" and value[0] == 0 and value[1] == 1:
        once = _exact_run(value[2])
        return once | {""} if once is not None and len(once) < FRAGMENTS else None
    return None


def _exact_run(tree) -> frozenset[str] | None:
    out = frozenset([""])
    for kind, value in tree:
        part = _exact(str(kind), value)
        if part is None or len(part) * len(out) > FRAGMENTS:
            return None
        out = frozenset(a + b for a in out for b in part)
        if max(map(len, out)) > LONGEST:
            return None
    return out


def _need(tree) -> Needs:
    """Fragments of which one is in every match of a sequence of parts."""
    best: Needs = None
    run = frozenset([""])

    def close():
        nonlocal best, run
        if "" not in run:
            best = _better(best, run)
        run = frozenset([""])

    for kind, value in tree:
        name = str(kind)
        part = _exact(name, value)
        if part is not None and len(part) * len(run) <= FRAGMENTS and max(map(len, run)) + max(map(len, part)) <= LONGEST:
            # An optional part may also end the run: take what stands before it, then go on with both.
            if "" in part and "" not in run and part != {""}:
                best = _better(best, run)
            run = frozenset(a + b for a in run for b in part)
            continue
        close()
        if part is not None and "" not in part:
            run = part
        elif name == "SUBPATTERN" and not value[1] and not value[2]:
            best = _better(best, _need(value[3]))
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and value[0] > 0:
            best = _better(best, _need(value[2]))
        elif name == "BRANCH":
            ways = [_need(x) for x in value[1]]
            if all(w is not None for w in ways):
                both = frozenset().union(*ways)
                best = _better(best, both if len(both) <= FRAGMENTS else None)
    close()
    return best


@lru_cache(maxsize=4096)
def fragments(pattern: str) -> Needs:
    """Literals of which one must occur wherever the pattern matches, or None."""
    import re._parser as parser

    tree = parser.parse(pattern)
    if tree.state.flags & (re.IGNORECASE | re.VERBOSE):
        return None
    return _need(tree)


class Finder:
    def __init__(self, patterns: Sequence[str]):
        import ahocorasick

        owners: dict[str, set[int]] = {}
        self.always, self.plain = [], set()
        for i, p in enumerate(patterns):
            own = fragments(p)
            if own is None:
                self.always.append(i)
                continue
            for s in own:
                owners.setdefault(s, set()).add(i)
            if set(p.split("|")) == own and p == re.sub(r"[^a-z0-9 |]", "", p):  # its own fragments: no regex needed
                self.plain.add(i)
        self.machine = ahocorasick.Automaton()
        for s, ids in owners.items():
            self.machine.add_word(s, frozenset(ids))
        if owners:
            self.machine.make_automaton()
        self.search = [re.compile(p) for p in patterns]

    def _candidates(self, text: str) -> list[int]:
        hit = set().union(*{ids for _, ids in self.machine.iter(text)}) if len(self.machine) else set()
        return sorted(hit.union(self.always))

    def first(self, text: str | None, limit: int) -> list[int]:
        """The first `limit` patterns that occur, in order."""
        out: list[int] = []
        for i in self._candidates(text or ""):
            if i in self.plain or self.search[i].search(text or ""):
                out.append(i)
                if len(out) == limit:
                    break
        return out

    def most(self, text: str | None) -> int | None:
        """The pattern with most matches, the earlier on ties."""
        best = None
        for i in self._candidates(text or ""):
            n = sum(1 for _ in self.search[i].finditer(text or ""))
            if n and (best is None or n > best[0]):
                best = (n, i)
        return best and best[1]


@lru_cache(maxsize=4)
def finder(patterns: tuple[str, ...]) -> Finder:
    """One automaton a worker process, kept from task to task."""
    return Finder(patterns)


#: Texts of a batch that are Python strings at a time.
STEP = 256


def _each(batch: pa.Array, find: Callable) -> list:
    """``find`` of every text of a batch."""
    return [find(t) for at in range(0, len(batch), STEP) for t in batch.slice(at, STEP).to_pylist()]


def first_found(low: Column, patterns: Sequence[str], limit: int) -> Column:
    """array<int> of the first patterns found in lower-case text."""
    patterns = tuple(patterns)

    @F.arrow_udf("array<int>")
    def found(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tool = finder(patterns)
        for batch in texts:
            yield pa.array(_each(batch, lambda t: tool.first(t, limit)), pa.list_(pa.int32()))

    return found(low)


def most_found(low: Column, patterns: Sequence[str]) -> Column:
    """int: the pattern with most matches in lower-case text, null when none matches."""
    patterns = tuple(patterns)

    @F.arrow_udf("int")
    def found(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tool = finder(patterns)
        for batch in texts:
            yield pa.array(_each(batch, tool.most), pa.int32())

    return found(low)
