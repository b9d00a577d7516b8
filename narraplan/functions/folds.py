"""Greedy grouping inside one row.

A script's sentences sit in one array, so grouping them needs no shuffle. Only integer
arrays cross to Python, in Arrow batches; the work is linear in their length.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql.functions import arrow_udf

SPAN = "array<struct<first:bigint,size:bigint,before:bigint,total:bigint>>"


def _spans(codes: pa.Array, cut: Callable[[list[int]], list[int]],
           weight: Callable[[int], int]) -> pa.Array:
    offsets = [0]
    cols: tuple[list[int], ...] = ([], [], [], [])
    for values in codes.to_pylist():
        values = values or []
        before = 0
        starts = cut(values)
        for first, stop in zip(starts, [*starts[1:], len(values)]):
            total = sum(map(weight, values[first:stop]))
            for col, v in zip(cols, (first, stop - first, before, total)):
                col.append(v)
            before += total
        offsets.append(len(cols[0]))
    items = pa.StructArray.from_arrays(
        [pa.array(c, pa.int64()) for c in cols], names=["first", "size", "before", "total"]
    )
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), items)


def scene_spans(word_counts: Column, limit_words: float) -> Column:
    """Group sentences while their words stay within ``limit_words``; never split one."""

    def cut(counts):
        starts, held = [], 0
        for i, n in enumerate(counts):
            if not starts or held + n > limit_words:
                starts.append(i)
                held = 0
            held += n
        return starts

    @arrow_udf(SPAN)
    def fold(counts: pa.Array) -> pa.Array:
        return _spans(counts, cut, lambda n: n)

    return fold(word_counts)


def caption_spans(token_codes: Column, line_chars: int, max_lines: int, max_words: int) -> Column:
    """Group tokens into captions. A code is twice the token length, plus one at a stop."""

    def cut(codes):
        starts, n, lines, width = [], 0, 1, 0
        for i, code in enumerate(codes):
            length, stop = divmod(code, 2)
            if n == 0:
                starts.append(i)
                lines, width = 1, length
            elif width + 1 + length > line_chars:
                lines, width = lines + 1, length
            else:
                width += 1 + length
            n += 1
            if lines > max_lines:
                starts.append(i)
                n, lines, width = 1, 1, length
            elif n >= max_words or (stop and n >= 2):
                n = 0
        return starts

    @arrow_udf(SPAN)
    def fold(codes: pa.Array) -> pa.Array:
        return _spans(codes, cut, lambda code: code // 2)

    return fold(token_codes)
