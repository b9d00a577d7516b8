"""Token counts that follow edits: a segment tree over each document's pre-token runs.

A text is cut into runs of about `span` code points at places where the vocabulary always starts a new token: before
a single space between two non-spaces. Counts of runs add up. The tree's nodes hold the code points and tokens below
them. An edit walks down to the runs it touches, joins them, takes in neighbours while an edge is no such place (the
boundary context), encodes that region alone and updates the sums on the way up.

Null and empty texts count 0. An edit's place and length are clipped to the text; a null edit list changes nothing,
a null insertion is empty. Repeated rows and ties give equal rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from narraplan.llm.common import blocks
from narraplan.llm.tokens import encoder

SPAN = 256


def is_edge(left: str, right: str) -> bool:
    """Whether a token always starts between the two."""
    return bool(left) and len(right) > 1 and right[0] == " " and not left[-1].isspace() and not right[1].isspace()


def runs(text: str, span: int = SPAN) -> list[str]:
    out, at = [], 0
    while at < len(text):
        to = at + span
        while to < len(text) and not (text[to] == " " and is_edge(text[to - 1], text[to:to + 2])):
            to = text.find(" ", to + 1)
            to = len(text) if to < 0 else to
        out.append(text[at:to])
        at = to
    return out


class SegmentTree:
    """Runs of one text with sums of code points and tokens."""

    def __init__(self, parts: list[str], counts: list[int], count: Callable[[list[str]], list[int]]):
        self.count = count
        self.leaves = 1
        while self.leaves < max(1, len(parts)):
            self.leaves *= 2
        self.parts = [*parts, *[""] * (self.leaves - len(parts))]
        self.chars = [0] * self.leaves + [len(p) for p in self.parts]
        self.tokens = [0] * self.leaves + [*counts, *[0] * (self.leaves - len(counts))]
        for k in range(self.leaves - 1, 0, -1):
            self.chars[k] = self.chars[2 * k] + self.chars[2 * k + 1]
            self.tokens[k] = self.tokens[2 * k] + self.tokens[2 * k + 1]
        self.encoded = 0

    def find(self, at: int) -> tuple[int, int]:
        """Leaf that holds code point `at`, and the place in it; the end of the text is in the last filled leaf."""
        at = min(at, self.chars[1])
        k = 1
        while k < self.leaves:
            k *= 2
            if at > self.chars[k] or at == self.chars[k] and self.chars[k + 1]:
                at -= self.chars[k]
                k += 1
        return k - self.leaves, at

    def _put(self, leaf: int, text: str, tokens: int) -> None:
        self.parts[leaf] = text
        k = leaf + self.leaves
        chars, tokens = len(text) - self.chars[k], tokens - self.tokens[k]
        while k:
            self.chars[k] += chars
            self.tokens[k] += tokens
            k //= 2

    def edit(self, at: int, cut: int, put: str) -> None:
        """Replace `cut` code points from `at` by `put`; encode only what that touches."""
        at = max(0, min(at, self.chars[1]))
        cut = max(0, min(cut, self.chars[1] - at))
        lo, first = self.find(at)
        hi, last = self.find(at + cut)
        region = self.parts[lo][:first] + put + self.parts[hi][last:]
        while lo > 0 and not (region and is_edge(self.parts[lo - 1], region)):
            lo -= 1
            region = self.parts[lo] + region
        while hi + 1 < self.leaves and self.parts[hi + 1] == "":
            hi += 1
        while hi + 1 < self.leaves and not is_edge(region, self.parts[hi + 1]):
            hi += 1
            region += self.parts[hi]
        for leaf in range(lo + 1, hi + 1):
            if self.parts[leaf]:
                self._put(leaf, "", 0)
        self.encoded += len(region)
        self._put(lo, region, self.count([region])[0])


def counts_after_edits(docs: DataFrame, edits: str, path: str, span: int = SPAN) -> DataFrame:
    """doc_id, n_tokens, edited_chars, edited_tokens, reencoded_chars.

    edits: column of array<struct<at, cut, put>>, applied one after the other, in code points of the text as it is then.
    """

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = encoder(path, True)

        def count(texts: list[str]) -> list[int]:
            return [len(ids) // 2 for ids in known.encode(texts)]

        for block in blocks(batches, "text", 2 << 20):
            texts = [t or "" for t in block.column("text").to_pylist()]
            parts = [runs(t, span) for t in texts]
            sums = iter(count([p for ps in parts for p in ps]))
            rows = []
            for ps, todo in zip(parts, block.column("edits").to_pylist()):
                tree = SegmentTree(ps, [next(sums) for _ in ps], count)
                before = tree.tokens[1]
                for e in todo or []:
                    tree.edit(e["at"] or 0, e["cut"] or 0, e["put"] or "")
                rows.append((before, tree.chars[1], tree.tokens[1], tree.encoded))
            n, chars, tokens, again = zip(*rows)
            yield pa.record_batch([block.column("doc_id"), *(pa.array(x, pa.int64()) for x in (n, chars, tokens, again))],
                                  names=["doc_id", "n_tokens", "edited_chars", "edited_tokens", "reencoded_chars"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text",
                       F.col(edits).cast("array<struct<at:long,cut:long,put:string>>").alias("edits"))
    return rows.mapInArrow(make, "doc_id long, n_tokens long, edited_chars long, edited_tokens long, reencoded_chars long")
