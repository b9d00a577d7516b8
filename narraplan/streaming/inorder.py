"""Order-dependent rules over streams: a key's items wait until their block of time has passed and are taken in order.

An item waits until the watermark has passed its block, so batch and stream agree whatever the
order of arrival within the watermark's delay. A timer takes all blocks that have passed, so the calls
to the state grow with keys, spans and triggers, not with blocks. What waits lies in one entry while it is little,
the rest in one entry a span of ``SPAN`` blocks; one span at a time is in memory. Items are rows of one numpy array, packed in a
binary column.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Blocks that wait in one entry.
SPAN = 64
#: Items that wait together whatever their time, and the entry they wait in.
FEW, FEW_SPAN = 1024, -(2**62)
#: Arriving items held before they are put into the state.
HELD = 1 << 20
#: Items: (at_us, seq, mark) a row.
NONE = np.zeros((0, 3), np.int64)


def _unpacked(value: tuple | None) -> np.ndarray:
    return NONE if value is None else np.frombuffer(bytes(value[0]), np.int64).reshape(-1, 3)


def _sorted(items: np.ndarray) -> np.ndarray:
    return items[np.lexsort((items[:, 1], items[:, 0]))]


class InOrder(StatefulProcessor):
    """Base of rules that need a key's items (at_us, seq, mark) in order of (at_us, seq).

    ``rule`` gets the key's tally (a tuple of longs, ``START`` at first) and the next items, and
    gives the new tally and output columns. Blocks are ``width_us`` long, whole milliseconds.
    """

    START: tuple[int, ...] = ()
    COLUMNS: tuple[tuple[str, T.DataType], ...] = ()

    def __init__(self, keys: list[str], width_us: int):
        self.keys, self.width = keys, max(width_us // 1000 * 1000, 2000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "span bigint", "items binary")
        if self.START:
            self.tally = handle.getValueState("tally", ", ".join(f"t{k} bigint" for k in range(len(self.START))))

    def rule(self, tally: tuple[int, ...], items: np.ndarray) -> tuple[tuple[int, ...], dict[str, np.ndarray]]:
        raise NotImplementedError

    def arrived(self, last_us: int) -> None:
        """Called with the last time of a batch of items, before any is taken."""

    def moments(self, upto_ms: int) -> list[int]:
        """Moments of the key's other timers up to this one, in order."""
        return []

    def ended(self, tally: tuple[int, ...], moment_ms: int) -> tuple[tuple[int, ...], dict[str, np.ndarray]]:
        """The rule of such a moment."""
        return tally, {}

    def _wait(self, span: int, items: np.ndarray) -> None:
        self.waiting.updateValue((span,), (items.tobytes(),))

    def _keep(self, items: np.ndarray) -> None:
        few = _unpacked(self.waiting.getValue((FEW_SPAN,)))
        if len(few) + len(items) <= FEW:
            self._wait(FEW_SPAN, np.concatenate([few, items]))
        else:
            spans = items[:, 0] // (self.width * SPAN)
            order = np.argsort(spans, kind="stable")
            found, first = np.unique(spans[order], return_index=True)
            for span, part in zip(found.tolist(), np.split(items[order], first[1:])):
                self._wait(span, np.concatenate([_unpacked(self.waiting.getValue((span,))), part]))
        self._wake(int(items[:, 0].min()) // self.width)

    def _wake(self, block: int) -> None:
        self.handle.registerTimer((block + 1) * self.width // 1000)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        parts, last = [], None
        for pdf in rows:
            if not len(pdf):
                continue
            parts.append(pdf[["at_us", "seq", "mark"]].to_numpy(np.int64))
            top = int(parts[-1][:, 0].max())
            last = top if last is None else max(last, top)
            if sum(map(len, parts)) >= HELD:
                self._keep(np.concatenate(parts))
                parts = []
        if parts:
            self._keep(np.concatenate(parts))
        if last is not None:
            self.arrived(last)
        return iter(())

    def _taken(self, upto_ms: int) -> Iterator[np.ndarray]:
        """Takes the items of all blocks that end by this moment, in order, a span at a time."""
        edge = upto_ms * 1000 // self.width * self.width
        spans = sorted(s for (s,) in self.waiting.keys())
        early, after = NONE, []

        def cut(span: int) -> np.ndarray:
            items = _sorted(_unpacked(self.waiting.getValue((span,))))
            n = int(np.searchsorted(items[:, 0], edge))
            if n < len(items):
                after.append(int(items[n, 0]) // self.width)
            if n == len(items):
                self.waiting.removeKey((span,))
            elif n:
                self._wait(span, items[n:])
            return items[:n]

        if spans and spans[0] == FEW_SPAN:
            early = cut(spans.pop(0))
        for span in spans:
            start, stop = span * SPAN * self.width, (span + 1) * SPAN * self.width
            if start >= edge:
                after.append(span * SPAN)
                break
            n = int(np.searchsorted(early[:, 0], stop))
            items = _sorted(np.concatenate([early[:n], cut(span)]))
            early = early[n:]
            if len(items):
                yield items
        if len(early):
            yield early
        if after:
            self._wake(min(after))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        expiry = expiredTimerInfo.getExpiryTimeInMs()
        upto = max(expiry, timerValues.getCurrentWatermarkInMs())
        tally = old = (self.tally.get() or self.START) if self.START else ()
        for moment in [*self.moments(upto), None]:
            for items in self._taken(upto if moment is None else moment):
                tally, out = self.rule(tuple(tally), items)
                yield from self._rows(key, out)
            if moment is not None:
                tally, out = self.ended(tuple(tally), moment)
                yield from self._rows(key, out)
        if tuple(tally) != tuple(old):
            self.tally.update(tuple(int(x) for x in tally))

    def _rows(self, key, out: dict[str, np.ndarray]) -> Iterator[pd.DataFrame]:
        n = len(next(iter(out.values()))) if out else 0
        if n:
            yield pd.DataFrame({k: [v] * n for k, v in zip(self.keys, key)} | out)

    def close(self) -> None:
        pass


class Spacing(InOrder):
    """kept: the item follows the key's last kept one by the gap (more, if strict). Marked items
    are kept and don't count."""

    START = (0, 0)
    COLUMNS = (("at_us", T.LongType()), ("seq", T.LongType()), ("kept", T.BooleanType()))

    def __init__(self, keys: list[str], gap_us: int, strict: bool):
        super().__init__(keys, gap_us // 16)
        self.gap, self.side = gap_us, "right" if strict else "left"

    def rule(self, tally, items):
        at, seq, mark = items.T
        kept = mark == 1
        plain = np.flatnonzero(mark == 0)
        times = at[plain]
        some, last = tally
        k = int(np.searchsorted(times, last + self.gap, self.side)) if some else 0
        while k < len(times):
            kept[plain[k]] = True
            some, last = 1, int(times[k])
            k = int(np.searchsorted(times, last + self.gap, self.side))
        return (some, last), {"at_us": at, "seq": seq, "kept": kept}


class Admission(InOrder):
    """request_no within the key and allowed: it is at most the limit."""

    START = (0,)
    COLUMNS = (("seq", T.LongType()), ("request_no", T.LongType()), ("allowed", T.BooleanType()))

    def __init__(self, keys: list[str], limit: int, width_us: int = 3_600_000_000):
        super().__init__(keys, width_us)
        self.limit = limit

    def rule(self, tally, items):
        number = tally[0] + np.arange(1, len(items) + 1)
        return (int(number[-1]),), {"seq": items[:, 1], "request_no": number, "allowed": number <= self.limit}


class TrailingRate(InOrder):
    """in_window: the key's items in (now - window, now] up to this one; throttled: more than the limit.

    The times of the last window stay in the state.
    """

    COLUMNS = (("seq", T.LongType()), ("in_window", T.LongType()), ("throttled", T.BooleanType()))

    def __init__(self, keys: list[str], window_s: int, limit: int):
        super().__init__(keys, window_s * 1_000_000 // 60)
        self.window, self.limit = window_s * 1_000_000, limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.recent = handle.getValueState("recent", "at binary")

    def _left(self, at: np.ndarray, now: np.ndarray) -> np.ndarray:
        """How many times lie before the window of each moment; nothing is earlier than a missing time, the least long."""
        low = np.iinfo(np.int64).min + self.window
        return np.where(now < low, 0, np.searchsorted(at, np.maximum(now, low) - self.window, "right"))

    def rule(self, tally, items):
        held = self.recent.get()
        before = np.frombuffer(bytes(held[0]), np.int64) if held else np.zeros(0, np.int64)
        at = np.concatenate([before, items[:, 0]])
        first = self._left(at, items[:, 0])
        inside = np.arange(len(before) + 1, len(at) + 1) - first
        self.recent.update((at[first[-1]:].tobytes(),))
        return tally, {"seq": items[:, 1], "in_window": inside, "throttled": inside > self.limit}


class QuietRuns(InOrder):
    """Maximal runs of marked (quiet) frames: first_frame and end_frame, by the key's own frame count.

    A run closes at the next frame that isn't quiet. A key ends when nothing came for
    ``ends_after_us``; its open run closes there.
    """

    START = (0, -1, 0)
    COLUMNS = (("first_frame", T.LongType()), ("end_frame", T.LongType()))

    def __init__(self, keys: list[str], least_frames: int, width_us: int, ends_after_us: int):
        super().__init__(keys, width_us)
        self.least, self.after = least_frames, ends_after_us

    def _runs(self, first: np.ndarray, end: np.ndarray) -> dict[str, np.ndarray]:
        use = end - first >= self.least
        return {"first_frame": first[use], "end_frame": end[use]}

    def rule(self, tally, items):
        n, open_, _ = tally
        quiet = np.concatenate([[open_ >= 0], items[:, 2] == 1])
        first = n + np.flatnonzero(~quiet[:-1] & quiet[1:])
        end = n + np.flatnonzero(quiet[:-1] & ~quiet[1:])
        if open_ >= 0:
            first = np.append(open_, first)
        still = int(first[-1]) if len(first) > len(end) else -1
        return (n + len(items), still, int(items[-1, 0])), self._runs(first[:len(end)].astype(np.int64), end)

    def arrived(self, last_us):
        self.handle.registerTimer(self._end_ms(last_us))

    def _end_ms(self, last_us: int) -> int:
        """A moment that is no block's end."""
        return ((last_us + self.after) // self.width + 1) * self.width // 1000 + 1

    def moments(self, upto_ms):
        return sorted(t for t in self.handle.listTimers() if t <= upto_ms and t * 1000 % self.width)

    def ended(self, tally, moment_ms):
        n, open_, last = tally
        if open_ < 0 or self._end_ms(last) != moment_ms:
            return tally, {}
        return (n, -1, last), self._runs(np.array([open_]), np.array([n]))


def in_order(items: DataFrame, processor: InOrder, delay: str = "0 seconds") -> DataFrame:
    """Run a rule over (its keys, ts TIMESTAMP, at_us, seq, mark); gives its keys and columns."""
    output = T.StructType([*(items.schema[k] for k in processor.keys), *(T.StructField(n, t) for n, t in processor.COLUMNS)])
    return (
        items.withWatermark("ts", delay).groupBy(*processor.keys)
        .transformWithStateInPandas(
            statefulProcessor=processor, outputStructType=output, outputMode="Append", timeMode="EventTime")
    )
