"""Waiting items of the ordered streams against plain loops, with a state that counts its calls."""

import random
from types import SimpleNamespace

import pandas as pd
import pytest

from narraplan.streaming import inorder


class State:
    """Stands for one key's state: a map, values and timers."""

    def __init__(self):
        self.calls, self.maps, self.values, self.timers = 0, {}, {}, set()

    def getMapState(self, name, *_):
        m = self.maps.setdefault(name, {})

        def called(f):
            def run(*a):
                self.calls += 1
                return f(*a)
            return run

        return SimpleNamespace(
            getValue=called(m.get), updateValue=called(m.__setitem__), removeKey=called(lambda k: m.pop(k, None)),
            containsKey=called(m.__contains__), keys=called(lambda: list(m)))

    def getValueState(self, name, *_):
        v = self.values

        def put(x):
            self.calls += 1
            v[name] = x

        return SimpleNamespace(get=lambda: v.get(name), exists=lambda: name in v, update=put)

    def registerTimer(self, ms):
        self.calls += 1
        self.timers.add(ms)

    def listTimers(self):
        return iter(sorted(self.timers))


def run(processor, triggers):
    """Each trigger's items, then its watermark, as Spark gives them; the state and all output rows."""
    state, out = State(), []
    processor.init(state)
    for items, watermark in triggers:
        if items:
            frame = pd.DataFrame(items, columns=["at_us", "seq", "mark"])
            out += [*processor.handleInputRows(("k",), iter([frame]), None)]
        for t in sorted(x for x in state.timers if x <= watermark):
            state.timers.discard(t)
            out += [*processor.handleExpiredTimer(
                ("k",), SimpleNamespace(getCurrentWatermarkInMs=lambda: watermark), SimpleNamespace(getExpiryTimeInMs=lambda: t))]
    out = [x for x in out if len(x)]
    return state, pd.concat(out).to_dict("records") if out else []


def log(n, span_us, seed):
    r = random.Random(seed)
    times = sorted(r.choice([r.randrange(span_us), r.randrange(span_us // 5000) * 5000]) for _ in range(n))
    return [(10**12 + t, k, int(r.random() < 0.6)) for k, t in enumerate(times)]


def triggers(items, n, seed):
    """Shuffled parts, each followed by the last time seen as the watermark, and the end."""
    r, size, out = random.Random(seed), -(-len(items) // n), []
    for k in range(n):
        part = items[k * size:(k + 1) * size]
        out.append((r.sample(part, len(part)), part[-1][0] // 1000))
    return [*out, ([], 10**13)]


@pytest.mark.parametrize("n,parts", [(600, 5), (5000, 1), (5000, 4)])
def test_waiting_items_leave_in_order(n, parts):
    items = log(n, 3_600_000_000, n)
    replay = triggers(items, parts, 1)

    _, got = run(inorder.TrailingRate(["k"], 60, 5), replay)
    want = [sum(t - 60_000_000 < u for u, _, _ in items[max(0, k - 300):k + 1]) for k, (t, _, _) in enumerate(items)]
    assert [(x["seq"], x["in_window"], x["throttled"]) for x in got] == [(k, w, w > 5) for k, w in enumerate(want)]

    _, got = run(inorder.Spacing(["k"], 5_000_000, True), replay)
    last, kept = -10**18, []
    for t, _, mark in items:
        kept.append(bool(mark) or t - last > 5_000_000)
        last = t if kept[-1] and not mark else last
    assert [(x["seq"], x["kept"]) for x in got] == list(enumerate(kept))

    _, got = run(inorder.QuietRuns(["k"], 2, 7_000_000, 10_000_000_000), replay)
    quiet = [False, *(m == 1 for _, _, m in items), False]
    first = [k for k in range(n + 1) if quiet[k + 1] and not quiet[k]]
    end = [k for k in range(n + 1) if quiet[k] and not quiet[k + 1]]
    assert [(x["first_frame"], x["end_frame"]) for x in got] == [(a, b) for a, b in zip(first, end) if b - a >= 2]


@pytest.mark.filterwarnings("ignore:invalid value")
def test_missing_times_come_first_and_are_numbered():
    items = [(None, 7, 0), (10**12, 1, 0), (None, 5, 0), (10**12 + 1, 2, 0), (None, 6, 0)]
    _, got = run(inorder.TrailingRate(["k"], 60, 2), [(items, 0), ([], 10**13)])
    assert [(x["seq"], x["in_window"], x["throttled"]) for x in got] == [
        (5, 1, False), (6, 2, False), (7, 3, True), (1, 1, False), (2, 2, False)]


def test_a_key_that_pauses_for_long_ends_there():
    """Both parts wait when the watermark passes them: the run of the first still closes where its recording ended."""
    quiet = [(10**12 + k * 1_000_000, k, 1) for k in range(3)]
    later = [(10**13 + k * 1_000_000, 3 + k, 1) for k in range(3)]
    _, got = run(inorder.QuietRuns(["k"], 2, 7_000_000, 60_000_000), [(quiet, 0), (later, 0), ([], 10**12)])
    assert [(x["first_frame"], x["end_frame"]) for x in got] == [(0, 3), (3, 6)]


@pytest.mark.parametrize("processor", [
    inorder.TrailingRate(["k"], 60, 5), inorder.Spacing(["k"], 60_000_000, True), inorder.QuietRuns(["k"], 2, 1_000_000, 10**10)])
def test_calls_to_the_state_do_not_grow_with_blocks(processor):
    """A thousand items, each in a block of its own: before, every block had a timer and some ten calls."""
    items = [(10**12 + k * 60_000_000, k, k % 2) for k in range(1000)]
    state, _ = run(processor, [(items, 0), ([], 10**13)])
    assert state.calls < 20 and not state.maps["waiting"]
