"""Script words to spoken times: anchors, gap filling, sentence spans, timed scenes.

Every group is one script, which is one text cell, so windows by script are bounded.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import lexicon as lx
from ..functions import text as tx
from .ordered import ordered_scan, written
from .scripts import split_sentences

#: Rounds of matching: words in a run, and which runs may pair. "once": runs found once on both sides of a gap;
#: "equal": runs found equally often, in order; "least": as many as the side with fewer has, in order.
ROUNDS = ((3, "once"), (3, "equal"), (2, "once"), (1, "least"))
#: Rows of a batch that Python returns; lines whose places are found together.
STEP, AT_ONCE = 50_000, 200_000


def rising(places: list[int]) -> list[int]:
    """Longest strictly rising subsequence, as positions, by patience sorting.

    Each element goes on the first pile whose top is not below it and points to the top of
    the pile before, so of several longest ones the latest in every pile is taken.
    """
    tops: list[int] = []
    at: list[int] = []
    back: list[int] = []
    for k, place in enumerate(places):
        pile = bisect_left(tops, place)
        back.append(at[pile - 1] if pile else -1)
        if pile == len(tops):
            tops.append(place)
            at.append(k)
        else:
            tops[pile], at[pile] = place, k
    found = []
    k = at[-1] if at else -1
    while k >= 0:
        found.append(k)
        k = back[k]
    return found[::-1]


def _numbered(columns: Sequence[np.ndarray]) -> np.ndarray:
    """A number from 0 on for each different row of the columns, all from 0 on."""
    key, below = columns[0], int(columns[0].max()) + 1
    for column in columns[1:]:
        most = int(column.max()) + 1
        if below * most >= 1 << 62:
            key = pa.array(key).dictionary_encode().indices.to_numpy().astype(np.int64)
            below = int(key.max()) + 1
        key, below = key * most + column, below * most
    return pa.array(key).dictionary_encode().indices.to_numpy().astype(np.int64)


def _pairs(mine: np.ndarray, heard: np.ndarray, kept: np.ndarray, size: int, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Places of runs that pair, by words' codes; no run reaches over a word that is kept, and pairs lie in one gap."""
    starts, gaps = [], []
    for codes, own in ((mine, kept[0]), (heard, kept[1])):
        free = codes >= 0
        free[own] = False
        whole = np.logical_and.reduce([free[k:len(free) - size + 1 + k] for k in range(size)]) if len(free) >= size else free[:0]
        starts.append(np.flatnonzero(whole))
        gaps.append(np.searchsorted(own, starts[-1]))
    n = len(starts[0])
    if not n or not len(starts[1]):
        return starts[0][:0], starts[1][:0]
    key = _numbered([np.concatenate(gaps), *[
        np.concatenate([mine[starts[0] + k], heard[starts[1] + k]]) for k in range(size)]])
    a, b, top = key[:n], key[n:], int(key.max()) + 1
    many, theirs = np.bincount(a, minlength=top), np.bincount(b, minlength=top)
    may = (many > 0) & (theirs > 0)
    if rule != "least":
        may &= (many == theirs) & ((many == 1) | (rule == "equal"))
    found = []
    for keys, places in ((a, starts[0]), (b, starts[1])):
        keys, places = keys[may[keys]], places[may[keys]]
        order = np.argsort(keys, kind="stable")
        keys, places = keys[order], places[order]
        if rule == "least" and len(keys):
            first = np.maximum.accumulate(np.where(np.r_[True, keys[1:] != keys[:-1]], np.arange(len(keys)), 0))
            places = places[np.arange(len(keys)) - first < np.minimum(many, theirs)[keys]]
        found.append(places)
    return found[0], found[1]


def _voted(i: np.ndarray, j: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Words of the runs that begin at ``i``, and where most of their runs, which pair with ``j``, put them; the earlier place on ties."""
    words = np.unique(np.concatenate([i + k for k in range(size)])) if size > 1 else np.sort(i)
    votes = np.full((size, len(words)), -1)
    for k in range(size):
        votes[k, np.searchsorted(words, i + k)] = j + k
    if size == 1:
        return words, votes[0]
    n = np.array([(votes == votes[k]).sum(0) for k in range(size)])
    n[votes < 0] = 0
    best = np.where(n == n.max(0), votes, np.iinfo(np.int64).max).min(0)
    return words, best


def _places(mine: np.ndarray, heard: np.ndarray, kept: np.ndarray) -> np.ndarray:
    """Script words and heard words that match, two rows of places, by words' codes; below 0 is no word.

    ``kept``: places that hold from the start, rising in both rows; nothing matches across them.
    """
    for size, rule in ROUNDS:
        i, j = _pairs(mine, heard, kept, size, rule)
        if not len(i):
            continue
        words, places = _voted(i, j, size)
        gaps = np.searchsorted(kept[0], words)
        stay = np.ones(len(words), bool)
        # most gaps rise as they are
        for gap in np.unique(gaps[1:][np.diff(places) <= 0]):
            at, to = np.searchsorted(gaps, [gap, gap + 1])
            stay[at:to] = False
            stay[at + np.array(rising(places[at:to].tolist()), np.int64)] = True
        kept = np.concatenate([kept, [words[stay], places[stay]]], 1)
        kept = kept[:, np.argsort(kept[0], kind="stable")]
    return kept


def _places_of(texts: Sequence[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """``_places`` of each (script, heard), found together: a word that is none stands behind each and is kept."""
    mine, heard = (np.concatenate([x for t in texts for x in (t[side], [-1])]).astype(np.int64) for side in (0, 1))
    ends = np.cumsum([[len(a) + 1, len(b) + 1] for a, b in texts], 0).T - 1
    found = _places(mine, heard, ends)
    cuts = np.searchsorted(found[0], ends[0])
    begins = np.concatenate([[[0], [0]], ends[:, :-1] + 1], 1)
    return [found[:, at:to] - begins[:, [k]] for k, (at, to) in enumerate(zip(np.r_[0, cuts[:-1] + 1], cuts))]


def _codes(mine: pa.Array, heard: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A number for each different word, the same on both sides; below 0 for empty ones."""
    coded = pa.concat_arrays([mine, heard]).dictionary_encode()
    codes = coded.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    codes[codes == pc.index(coded.dictionary, "").as_py()] = -1
    return codes[:len(mine)], codes[len(mine):]


def matched_places(script: Sequence[str], heard: Sequence[str]) -> list[tuple[int, int]]:
    """(script word, heard word) that match, rising on both sides.

    Each round looks into the gaps that the rounds before left. Runs that pair vote for the
    places of their words; a word goes where most of its runs put it, the earlier place on
    ties, and the longest rising chain of a gap stays. So a stray run costs its own words only.
    """
    found = _places_of([_codes(pa.array(script, pa.string()), pa.array(heard, pa.string()))])[0]
    return [tuple(x) for x in found.T.tolist()]


def _lines(scripts: DataFrame, asr: DataFrame, words: Callable[[Column], Column]) -> DataFrame:
    """(script_id, _total, _text, sent_idx, token, norm, asr_idx, start_ms, end_ms): the words of a script's texts, one text after another,
    and behind them its transcript, where _text is -1.

    A script's lines follow each other, in order; both sides are bounded by a script. Texts travel as texts and meet the transcript
    in one row; opened rows are narrow, so few bytes wait for Python. Texts that share an id share a transcript.
    """
    word = F.struct(F.col("asr_idx").cast("bigint").alias("asr_idx"), tx.norm_word(F.col("token")).alias("norm"), "start_ms", "end_ms")
    heard = asr.groupBy("script_id").agg(
        F.array_sort(F.collect_list(word)).alias("_h"), F.max_by("end_ms", "asr_idx").cast("bigint").alias("_total"))
    texts = scripts.groupBy("script_id").agg(F.collect_list("text").alias("_texts"))
    none = {f.name: F.lit(None).cast(f.dataType).alias(f.name) for f in asr.schema}

    def line(text: Column, sent: Column, token: Column, norm: Column, *times: Column) -> Column:
        return F.struct(text.cast("int").alias("_text"), sent.cast("int").alias("sent_idx"), token.cast("string").alias("token"), norm.alias("norm"), *times)

    mine = F.flatten(F.transform("_texts", lambda t, k: F.transform(words(t), lambda w: line(
        k, w["sent_idx"], w["token"], tx.norm_word(w["token"]), F.lit(None).cast("bigint").alias("asr_idx"), none["start_ms"], none["end_ms"]))))
    said = F.transform("_h", lambda h: line(
        F.lit(-1), F.lit(None), F.lit(None), h["norm"], h["asr_idx"].alias("asr_idx"), h["start_ms"].alias("start_ms"), h["end_ms"].alias("end_ms")))
    return texts.join(heard, "script_id").select(
        "script_id", "_total", F.explode_outer(F.concat(mine, said)).alias("_l")).select("script_id", "_total", "_l.*")


def _starts(block: pa.RecordBatch, *columns: str) -> np.ndarray:
    """Rows at which one of the columns, none of them null, begins a new value, and behind them the number of rows."""
    n, new = block.num_rows, np.zeros(max(block.num_rows - 1, 0), bool)
    for c in columns:
        values = block.column(c)
        new |= pc.not_equal(values.slice(1), values.slice(0, max(n - 1, 0))).to_numpy(zero_copy_only=False)
    return np.r_[[0] * (n > 0), np.flatnonzero(new) + 1, n]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of whole scripts, about ``AT_ONCE`` at once or one script's."""
    held: list[pa.RecordBatch] = []
    rows, upto = 0, AT_ONCE
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= upto:
            block = pa.concat_batches(held)
            cut = int(_starts(block, "script_id")[-2])
            if cut:
                yield block.slice(0, cut)
            held, rows = [block.slice(cut)], len(block) - cut
            upto = max(2 * rows, AT_ONCE)
    if rows:
        yield pa.concat_batches(held)
    pa.default_memory_pool().release_unused()


def _found(block: pa.RecordBatch) -> Iterator[tuple[int, list[tuple[int, int]], list[np.ndarray]]]:
    """(first line of the transcript, first line and the one behind the last of each text, places of each text) of every script."""
    coded = block.column("norm").dictionary_encode()
    codes = coded.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    codes[codes == pc.index(coded.dictionary, "").as_py()] = -1
    text, parts, scripts, own = block.column("_text").to_numpy(), _starts(block, "script_id", "_text"), [], []
    for at, to in zip(parts, parts[1:]):
        if text[at] >= 0:
            own.append((int(at), int(to)))
        else:
            scripts.append((int(at), int(to), own))
            own = []
    pairs = [(codes[a:b], codes[at:to]) for at, to, own in scripts for a, b in own]
    places = iter(_places_of(pairs) if pairs else [])
    for at, _, own in scripts:
        if own:
            yield at, own, [next(places) for _ in own]


def _in_steps(columns: Sequence[pa.Array], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    table = pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)
    for at in range(0, table.num_rows, STEP):
        yield table.slice(at, STEP)


def match_words(scripts: DataFrame, asr: DataFrame) -> DataFrame:
    """(script_id, word_idx, asr_idx, start_ms, end_ms): script words found in the transcript.

    A script's words and its transcript meet in one row, both bounded by one text, and cross to Python
    as lines; what comes back is one row a match. See ``matched_places``.
    """
    lines = _lines(scripts, asr, lambda t: F.transform(tx.tokens(t), lambda w: F.struct(F.lit(0).alias("sent_idx"), w.alias("token"))))
    kinds = {f.name: f.dataType for f in lines.schema}
    schema = T.StructType([T.StructField(c, kinds.get(c, T.LongType())) for c in ("script_id", "word_idx", "asr_idx", "start_ms", "end_ms")])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            found = [(at, said + first) for first, _, places in _found(block) for at, said in places]
            if found:
                words, said = (np.concatenate(x) for x in zip(*found))
                heard = block.take(pa.array(said))
                yield from _in_steps([heard.column("script_id"), pa.array(words), *[heard.column(c) for c in arrow.names[2:]]], arrow)

    return lines.select("script_id", "_text", "norm", "asr_idx", "start_ms", "end_ms").mapInArrow(run, schema)


def _sentence_words(text: Column) -> Column:
    return F.flatten(F.transform(tx.sentences(text), lambda s, i: F.transform(
        tx.tokens(s), lambda t: F.struct(i.alias("sent_idx"), t.alias("token")))))


#: What a word has of the matches around it: the nearest one at or before it, the nearest at or behind it.
AROUND = ["_lo_at", "_lo_start", "_lo_end", "_hi_at", "_hi_start"]


def _around(block: pa.RecordBatch) -> Iterator[tuple[np.ndarray, ...]]:
    """(line, word_idx, lo_at, line of lo, hi_at, line of hi, last word_idx) of a script's words, with its scripts that match; -1 for none."""
    for first, own, places in _found(block):
        at, said = np.concatenate(places, 1)
        if not len(at):
            continue
        order = np.lexsort((said, at))
        at, said = at[order], said[order] + first
        idx = np.concatenate([np.arange(b - a) for a, b in own])
        lo, hi = np.searchsorted(at, idx, "right") - 1, np.searchsorted(at, idx)
        ahead = hi < len(at)
        hi = np.minimum(hi, len(at) - 1)
        yield (np.concatenate([np.arange(a, b) for a, b in own]), idx, at[lo], np.where(lo >= 0, said[lo], -1),
               at[hi], np.where(ahead, said[hi], -1), np.full(len(idx), max(b - a for a, b in own) - 1))


def _times_around(block: pa.RecordBatch, lo_at: np.ndarray, lo: np.ndarray, hi_at: np.ndarray, hi: np.ndarray) -> list[pa.Array]:
    """The columns ``AROUND``."""
    lo_in, hi_in = pa.array(lo, mask=lo < 0), pa.array(hi, mask=hi < 0)
    begun, ended = block.column("start_ms"), block.column("end_ms")
    return [pa.array(lo_at, mask=lo < 0), begun.take(lo_in), ended.take(lo_in), pa.array(hi_at, mask=hi < 0), begun.take(hi_in)]


def _spread(mark: str, word_idx: str) -> tuple[Column, Column]:
    """Start and end of a word from the columns ``AROUND``, their names with ``mark`` behind, and _n and _end."""
    lo_at, lo_start, lo_end, hi_at, hi_start = (F.col(f"{c}{mark}") for c in AROUND)
    tail = F.when(F.col("_n") == 0, F.lit(1)).otherwise(F.col("_n"))
    lo, hi = F.coalesce(lo_at, F.lit(0)), F.coalesce(hi_at, tail)
    t0 = F.coalesce(lo_end, F.lit(0)).cast("double")
    t1 = F.coalesce(hi_start, F.col("_end")).cast("double")
    steps = F.greatest(hi - lo, F.lit(1)).cast("double")
    at = (F.col(word_idx) - lo).cast("double")
    matched = F.coalesce(lo_at == F.col(word_idx), F.lit(False))

    def share(k: int) -> Column:
        return F.round(t0 + (t1 - t0) * ((at + F.lit(float(k))) / steps), 3)

    return (F.when(matched, lo_start.cast("double")).otherwise(share(0)), F.when(matched, lo_end.cast("double")).otherwise(share(1)))


def _aligned(scripts: DataFrame, asr: DataFrame, columns: Sequence[str],
             made: Callable[[pa.RecordBatch, tuple[np.ndarray, ...]], Sequence[pa.Array]]) -> DataFrame:
    """What ``made`` makes of lines and their ``_around``: script_id first, then ``columns``, numbers but for token."""
    lines = _lines(scripts, asr, _sentence_words).drop("asr_idx").withColumns(
        {c: F.col(c).cast("bigint") for c in ("start_ms", "end_ms")})
    kinds = {f.name: f.dataType for f in lines.schema if f.name in ("script_id", "token")}
    schema = T.StructType([T.StructField(c, kinds.get(c, T.LongType())) for c in ("script_id", *columns)])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            parts = list(_around(block))
            if parts:
                yield from _in_steps(made(block, tuple(np.concatenate(x) for x in zip(*parts))), arrow)

    return lines.mapInArrow(run, schema)


def align_words(scripts: DataFrame, asr: DataFrame) -> DataFrame:
    """(script_id, word_idx, sent_idx, token, matched, start_ms, end_ms) for every script word.

    Unmatched words between matched ones share the time between them in proportion; the
    first word of a gap starts one step after the left word's end. Scripts without any match
    give no rows. A script's texts are shuffled once, as texts; each word finds the nearest matches
    on both sides among its script's lines.
    """
    def made(block, around):
        line, idx, lo_at, lo, hi_at, hi, n = around
        words = pa.array(line)
        return [block.column("script_id").take(words), pa.array(idx), block.column("sent_idx").take(words), block.column("token").take(words),
                *_times_around(block, lo_at, lo, hi_at, hi), pa.array(n), block.column("_total").take(words)]

    start, end = _spread("", "word_idx")
    return _aligned(scripts, asr, ["word_idx", "sent_idx", "token", *AROUND, "_n", "_end"], made).select(
        "script_id", "word_idx", "sent_idx", "token", F.coalesce(F.col("_lo_at") == F.col("word_idx"), F.lit(False)).alias("matched"),
        start.alias("start_ms"), end.alias("end_ms"))


def align_sentences(scripts: DataFrame, asr: DataFrame) -> DataFrame:
    """``sentence_spans`` of ``align_words``. Of a sentence only its first and last word leave their script's lines."""
    def made(block, around):
        line, idx, lo_at, lo, hi_at, hi, n = around
        sent = block.column("sent_idx").take(pa.array(line)).to_numpy().astype(np.int64)
        # lines of a script have its transcript behind them, so scripts are told apart by their first line
        script = np.searchsorted(_starts(block, "script_id"), line, "right")
        order = np.lexsort((idx, sent, script))
        line, idx, lo_at, lo, hi_at, hi, n, sent, script = (x[order] for x in (line, idx, lo_at, lo, hi_at, hi, n, sent, script))
        first = np.flatnonzero(np.r_[True, (np.diff(sent) != 0) | (np.diff(script) != 0)])
        count = np.diff(np.r_[first, len(sent)])
        last = first + count - 1
        matched = np.add.reduceat(((lo >= 0) & (lo_at == idx)).astype(np.int64), first)
        words = pa.array(line[first])
        return [block.column("script_id").take(words), pa.array(sent[first]), pa.array(idx[first]), pa.array(idx[last]), pa.array(count), pa.array(matched),
                *[x for k in (first, last) for x in _times_around(block, lo_at[k], lo[k], hi_at[k], hi[k])],
                pa.array(n[first]), block.column("_total").take(words)]

    names = ["sent_idx", "first_word", "_last", "n_words", "n_matched", *[f"{c}{mark}" for mark in ("_1", "_2") for c in AROUND], "_n", "_end"]
    return _aligned(scripts, asr, names, made).select(
        "script_id", "sent_idx", F.when(F.col("sent_idx") == 0, F.lit(0)).otherwise(_spread("_1", "first_word")[0]).alias("start_ms"),
        _spread("_2", "_last")[1].alias("end_ms"), "first_word", "n_words", "n_matched")


def timed_spans(scripts: DataFrame, asr: DataFrame, paused: DataFrame | None = None,
                words_per_second: float = lx.WORDS_PER_SECOND) -> DataFrame:
    """Sentence spans of every script that has a sentence, with ``timing``: words where the
    transcript matches anywhere; else pauses where ``paused`` (script_id, sent_idx, start_ms,
    end_ms) covers the script; else pace, from the number of words alone.

    The spans feed several readers, so they are written once. Whether a script has any from words is asked of
    its row, before its sentences are opened.
    """
    heard = written(align_sentences(scripts, asr))
    found = heard.select("script_id").distinct()
    counts = scripts.select("script_id", F.transform(tx.sentences(F.col("text")), tx.word_count).alias("_counts"))
    sents = counts.join(found, "script_id", "left_anti").select(
        "script_id", F.posexplode_outer("_counts").alias("sent_idx", "n_words")).where(F.col("n_words").isNotNull()).select(
        "script_id", F.col("sent_idx").cast("bigint").alias("sent_idx"), F.col("n_words").cast("bigint").alias("n_words"))
    upto = Window.partitionBy("script_id").orderBy("sent_idx").rowsBetween(Window.unboundedPreceding, 0)
    ms = 1000.0 / words_per_second
    rest = (
        sents.withColumn("_upto", F.sum("n_words").over(upto))
        .withColumn("first_word", F.col("_upto") - F.col("n_words"))
        .withColumn("n_matched", F.lit(0).cast("bigint"))
        .withColumn("timing", F.lit("pace"))
        .withColumn("start_ms", F.col("first_word") * ms)
        .withColumn("end_ms", F.col("_upto") * ms)
    )
    if paused is not None:
        at = paused.select("script_id", "sent_idx", F.col("start_ms").cast("double").alias("_from"),
                           F.col("end_ms").cast("double").alias("_to"))
        rest = rest.join(at, ["script_id", "sent_idx"], "left").withColumn(
            "_all", F.every(F.col("_from").isNotNull()).over(Window.partitionBy("script_id"))
        ).withColumns({
            "timing": F.when(F.col("_all"), "pauses").otherwise("pace"),
            "start_ms": F.when(F.col("_all"), F.col("_from")).otherwise(F.col("start_ms")),
            "end_ms": F.when(F.col("_all"), F.col("_to")).otherwise(F.col("end_ms")),
        })
    heard = heard.withColumn("timing", F.lit("words"))
    return heard.unionByName(written(rest.select(*heard.columns)))


def alignment_rate(spans: DataFrame) -> DataFrame:
    """Matched words, all words and their ratio per script, from spans with n_matched."""
    hits, n = F.sum("n_matched"), F.sum("n_words")
    return spans.groupBy("script_id").agg(
        hits.alias("n_matched"), n.alias("n_words"), F.round(hits / n, 6).alias("rate")
    )


def sentence_spans(word_times: DataFrame) -> DataFrame:
    """First word's start to last word's end per sentence; the first one starts at 0.

    Also first_word, n_words and, where words carry ``matched``, n_matched.
    """
    matched = [F.count_if("matched").alias("n_matched")] if "matched" in word_times.columns else []
    spans = word_times.groupBy("script_id", "sent_idx").agg(
        F.min_by("start_ms", "word_idx").alias("start_ms"),
        F.max_by("end_ms", "word_idx").alias("end_ms"),
        F.min("word_idx").alias("first_word"),
        F.count(F.lit(1)).alias("n_words"),
        *matched,
    )
    return spans.withColumn(
        "start_ms", F.when(F.col("sent_idx") == 0, F.lit(0)).otherwise(F.col("start_ms")))


def speaking_pace(spans: DataFrame) -> DataFrame:
    """Words per second up to the last sentence's end, from sentence spans."""
    last_end = F.max_by("end_ms", "sent_idx") / 1000.0
    n = F.sum("n_words")
    return spans.groupBy("script_id").agg(
        n.alias("n_words"), F.round(n / F.greatest(last_end, F.lit(1e-6)), 6).alias("pace")
    )


class SpanMismatch(ValueError):
    """Some script has a different number of sentences and of time spans."""


def span_mismatches(sentences: DataFrame, spans: DataFrame) -> DataFrame:
    """Scripts whose sentences and spans differ in number."""
    a = sentences.groupBy("script_id").agg(F.count(F.lit(1)).alias("n_sentences"))
    b = spans.groupBy("script_id").agg(F.count(F.lit(1)).alias("n_spans"))
    return a.join(b, "script_id", "left").where(
        F.col("n_sentences") != F.coalesce("n_spans", F.lit(0))
    )


def timed_scene_index(spans: DataFrame, target_ms: int = lx.TARGET_SCENE_MS) -> DataFrame:
    """Add scene_idx: close a scene when the next end would lie past start + target."""
    adds = T.StructType([T.StructField("scene_idx", T.LongType())])

    def step(state, start, end):
        if state is None:
            state = (0, start)
        elif end - state[1] > target_ms:
            state = (state[0] + 1, start)
        return state, (state[0],)

    return ordered_scan(spans, ["script_id"], ["sent_idx"], ["start_ms", "end_ms"], adds, step)


def bucket_timed_scenes(scripts: DataFrame, spans: DataFrame,
                        target_ms: int = lx.TARGET_SCENE_MS, check: bool = True) -> DataFrame:
    """Scenes from spoken sentence times; each ends where the next begins.

    The scenes of a script, a few numbers each, travel to its text, which is cut in its row.
    """
    if check and not span_mismatches(split_sentences(scripts), spans).isEmpty():
        raise SpanMismatch("sentences and time spans differ in number")
    needed = spans.select("script_id", "sent_idx", "start_ms", "end_ms", "first_word", "n_words")
    scenes = timed_scene_index(needed, target_ms).groupBy("script_id", "scene_idx").agg(
        F.min_by("start_ms", "sent_idx").alias("start_ms"),
        F.max_by("end_ms", "sent_idx").alias("end_ms"),
        F.min("sent_idx").alias("first_sent"),
        F.count(F.lit(1)).alias("n_sents"),
        F.min("first_word").alias("first_word"),
        F.sum("n_words").alias("n_words"),
    )
    w = Window.partitionBy("script_id").orderBy("scene_idx")
    tiled = scenes.withColumn("end_ms", F.coalesce(F.lead("start_ms").over(w), "end_ms"))
    names = [c for c in tiled.columns if c != "script_id"]
    whole = tiled.groupBy("script_id").agg(F.collect_list(F.struct(*names)).alias("_scenes"))
    # a scene takes its own sentences along, not the script's
    cut = F.transform("_scenes", lambda x: F.struct(
        F.array_join(tx.part(F.col("_s"), x["first_sent"], x["n_sents"]), " ").alias("text"), x.alias("scene")))
    return (
        scripts.join(whole, "script_id")
        .select("script_id", tx.sentences(F.col("text")).alias("_s"), "_scenes")
        .select("script_id", F.explode_outer(cut).alias("_x")).where(F.col("_x").isNotNull())
        .select("script_id", "_x.text", *[F.col(f"_x.scene.{c}").alias(c) for c in names])
    )


def scene_word_times(scenes: DataFrame, word_times: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Word times relative to their scene: (script_id, scene_idx, token_idx, token, ...).

    ``keep`` names scene columns to copy to every word.

    Scenes are opened into their sentences and joined on (script_id, sent_idx): an equi
    join, so no word meets a scene it is not in.
    """
    sents = scenes.select(
        "script_id", "scene_idx", *keep, F.col("start_ms").alias("_origin"), "first_word",
        F.explode(F.sequence("first_sent", F.col("first_sent") + F.col("n_sents") - 1)).alias("sent_idx"),
    )
    return word_times.drop("first_word").join(sents, ["script_id", "sent_idx"]).select(
        "script_id",
        "scene_idx",
        *keep,
        (F.col("word_idx") - F.col("first_word")).alias("token_idx"),
        "word_idx",
        "token",
        F.greatest(F.lit(0), F.col("start_ms") - F.col("_origin")).alias("start_ms"),
        F.greatest(F.lit(50), F.col("end_ms") - F.col("_origin")).alias("end_ms"),
    )
