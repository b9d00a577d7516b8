"""Where sentences end, learned from a corpus without labels: abbreviations and words that start sentences.

After Kiss and Strunk, Unsupervised Multilingual Sentence Boundary Detection (2006). A word is
an abbreviation if a full stop follows it far more often than chance has it (log likelihood
ratio), weighed by shortness, by inner full stops, and against uses without a stop. A word starts
sentences if it follows sentence ends far more often than other places. Counts are partial
aggregates over all words of the corpus, in one pass; the model is a list, of all words that reach their score, that
goes into the row's expression as a hashed set.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from .ordered import cut_lineage

#: Constants of the paper: the least score of an abbreviation, the share of full stops an
#: abbreviation is expected to have, the least log likelihood of a sentence starter.
ABBREVIATION, STOPPED, STARTER = 0.3, 0.99, 30.0


def _word_facts(token: Column) -> tuple[Column, Column, Column]:
    """(word, whether a full stop follows it, whether it may end a sentence)."""
    core = tx.bare_token(token)
    stop = core.endswith(".")
    word = F.when(stop, F.substr(core, F.lit(1), F.length(core) - 1)).otherwise(F.regexp_replace(core, "[,;:!?]+$", ""))
    return F.lower(word), stop, core.rlike("[.!?]$")


def _words(scripts: DataFrame) -> DataFrame:
    """(word, stop, before, n): tokens of the corpus, counted, with the token before them where that may end a sentence.

    The texts are read once. Tokens are counted as they stand, so their facts are found for different ones only.
    """
    marks = [F.contains("x.before", F.lit(m)) for m in ".!?"]
    tokens = scripts.select(tx.tokens(F.col("text")).alias("token"))
    rows = tokens.select("token", F.concat(F.array(F.lit(None).cast("string")), "token").alias("before")).select(
        F.explode_outer(F.arrays_zip("token", "before")).alias("x"))
    seen = cut_lineage(rows.where(F.col("x.token").isNotNull()).groupBy(
        F.col("x.token").alias("token"), F.when(marks[0] | marks[1] | marks[2], F.col("x.before")).alias("before")
    ).agg(F.count(F.lit(1)).alias("n")))
    word, stop, _ = _word_facts(F.col("token"))
    return seen.select(word.alias("word"), stop.alias("stop"), "before", "n")


def _times(n: Column, p: Column) -> Column:
    """n log p, 0 where n is 0."""
    return F.when(n > 0, n * F.log(p)).otherwise(F.lit(0.0))


def abbreviation_scores(counts: DataFrame, n: float, stops: float) -> DataFrame:
    """Add score to (word, n, n_stop): words of letters, with full stops inside at most."""
    a, ab = F.col("n").cast("double"), F.col("n_stop").cast("double")
    p = stops / n
    null = _times(ab, F.lit(p)) + _times(a - ab, F.lit(1 - p))
    alt = _times(ab, F.lit(STOPPED)) + _times(a - ab, F.lit(1 - STOPPED))
    inner = F.length("word") - F.length(F.replace("word", F.lit("."), F.lit("")))
    letters = (F.length("word") - inner + 1).cast("double")
    score = -2 * (null - alt) * F.exp(-letters) * (inner + 1) * F.pow(letters, -(a - ab))
    return counts.where((F.col("n_stop") > 0) & F.col("word").rlike(r"^[\p{L}.]*\p{L}[\p{L}.]*$")).withColumn(
        "score", F.round(score, 6))


def starter_scores(counts: DataFrame, n: float, ends: float) -> DataFrame:
    """Add score and often to (word, n, n_start); often: it starts sentences more than its share."""
    b, ab = F.col("n").cast("double"), F.col("n_start").cast("double")
    a, p = F.lit(ends), b / n
    rest = F.lit(n) - a - b + ab
    p1, p2 = ab / a, (b - ab) / (F.lit(n) - a)
    ll = -2 * (_times(ab, p) + _times(a - ab, 1 - p) + _times(b - ab, p) + _times(rest, 1 - p)
               - _times(ab, p1) - _times(a - ab, 1 - p1) - _times(b - ab, p2) - _times(rest, 1 - p2))
    return counts.where(F.col("word").rlike(r"\p{L}")).withColumns({
        "score": F.round(ll, 6), "often": ab * n > b * ends})


def learn_breaks(scripts: DataFrame) -> tx.Breaks:
    """The model of a corpus (script_id, text); runs its aggregations at once. All words that reach their score are in it."""
    words = _words(scripts)
    counts = cut_lineage(words.groupBy("word").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("stop"), F.col("n")).otherwise(0)).alias("n_stop")))
    totals = counts.agg(F.sum("n"), F.sum("n_stop")).first()
    n, stops = float(totals[0] or 0), float(totals[1] or 0)
    if not stops or stops == n:
        return tx.Breaks(frozenset(), frozenset())
    best = abbreviation_scores(counts, n, stops).where(F.col("score") >= ABBREVIATION)
    abbreviations = frozenset(r.word for r in best.select("word").collect())

    before, before_stop, may_end = _word_facts(F.col("before"))
    short = before.rlike(tx.INITIALS) | (before.isin(sorted(abbreviations)) if abbreviations else F.lit(False))
    starts = cut_lineage(words.where(may_end & ~(before_stop & short)).groupBy("word").agg(F.sum("n").alias("n_start")))
    ends = float(starts.agg(F.sum("n_start")).first()[0] or 0)
    if not 0 < ends < n:
        return tx.Breaks(abbreviations, frozenset())
    found = starter_scores(counts.join(starts, "word"), n, ends).where(
        (F.col("score") >= STARTER) & F.col("often"))
    starters = frozenset(r.word for r in found.select("word").collect())
    return tx.Breaks(abbreviations, starters)
