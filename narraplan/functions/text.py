"""Column expressions over text. All JVM-side: no Python runs per row."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicon as lx

SENTENCE_END = r"""([.!?]["')]*)\s+"""
EDGE_SPACE = r"^\s+|\s+$"
#: Holds wherever a word that opens no sentence has a capital as its first letter.
INNER_CAPITAL = r"[^.!?\s]\s+[^A-Za-z\s]*[A-Z]"
OPENING = r"""^["'(\[]*"""
OUTER = r"""^["'(\[]+|["')\]]+$"""
INITIALS = r"^\p{L}(\.\p{L})*$"
NOT_WORD = r"[^\p{L}\p{N}_]"
NOT_WORD_APOS = r"[^\p{L}\p{N}_']"
NOT_WORD_APOS_DASH = r"[^\p{L}\p{N}_'-]"


def _non_empty(arr: Column) -> Column:
    return F.filter(arr, lambda x: x != "")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, EDGE_SPACE, "")


class Breaks(NamedTuple):
    """Lower-case words whose full stop belongs to them, and words that start sentences."""

    abbreviations: frozenset[str]
    starters: frozenset[str]


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def part(items: Column, first: Column, size: Column) -> Column:
    """``size`` (1 at least) elements from position ``first`` on, counted from 0; reads these alone, also inside a lambda,
    where ``slice`` would go through the whole array."""
    return F.transform(F.sequence(first, first + size - 1), lambda i: F.get(items, i.cast("int")))


def bare_token(token: Column) -> Column:
    """A token without the quotes and brackets around it."""
    return F.regexp_replace(token, OUTER, "")


def sentences(text: Column, breaks: Breaks | None = None) -> Column:
    """ARRAY<STRING> of sentences: split after end punctuation followed by space.

    With ``breaks`` there is no end behind an abbreviation or initials, unless a capitalised
    sentence starter follows; the white space there becomes one space.
    """
    marked = F.regexp_replace(strip(text), SENTENCE_END, "$1\u0001")
    pieces = _non_empty(F.split(marked, "\u0001"))
    if breaks is None:
        return pieces

    def glue(piece: Column, after: Column) -> Column:
        last = bare_token(F.regexp_extract(piece, r"(\S+)$", 1))
        word = F.lower(F.regexp_replace(last, r"\.$", ""))
        short = last.endswith(".") & (word.rlike(INITIALS) | _among(word, breaks.abbreviations))
        opener = F.lower(F.regexp_extract(after, OPENING + r"([\p{L}\p{N}_'-]+)", 1))
        starts = after.rlike(OPENING + r"\p{Lu}") & _among(opener, breaks.starters)
        return F.concat(piece, F.when(after.isNull(), "").when(short & ~starts, " ").otherwise("\u0001"))

    glued = bound(pieces, lambda p: F.array_join(F.zip_with(p, F.slice(p, 2, F.greatest(F.size(p), F.lit(1))), glue), ""))
    return _non_empty(F.split(glued, "\u0001"))


def _among(word: Column, words: frozenset[str]) -> Column:
    return word.isin(sorted(words)) if words else F.lit(False)


def tokens(text: Column) -> Column:
    """ARRAY<STRING> of whitespace tokens, no empties."""
    return _non_empty(F.split(text, r"\s+"))


def word_count(text: Column) -> Column:
    return F.size(tokens(text))


def norm_word(word: Column) -> Column:
    """Lower case, letters digits underscore and apostrophe only."""
    return F.regexp_replace(F.lower(word), NOT_WORD_APOS, "")


def caption_word(word: Column) -> Column:
    """As norm_word, and hyphens stay."""
    return F.regexp_replace(F.lower(word), NOT_WORD_APOS_DASH, "")


def letters_only(word: Column) -> Column:
    return F.regexp_replace(F.lower(word), "[^a-z]", "")


def word_array(words: Sequence[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def first_keywords(text: Column, stop: Sequence[str] = lx.KEYWORD_STOP, k: int = 3) -> Column:
    """First k distinct content words, in text order."""
    words = F.transform(tokens(F.lower(text)), lambda w: F.regexp_replace(w, NOT_WORD, ""))
    kept = F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(list(stop)))
    return F.slice(F.array_distinct(kept), 1, k)


def highlight_words(keywords: Column, filler: Sequence[str] = lx.CAPTION_FILLER) -> Column:
    """Distinct words of all phrases, at least four long and not filler."""
    words = tokens(F.lower(F.array_join(keywords, " ")))
    clean = F.transform(words, lambda w: F.regexp_replace(w, NOT_WORD_APOS_DASH, ""))
    return F.array_distinct(
        F.filter(clean, lambda w: (F.length(w) >= 4) & ~w.isin(list(filler)))
    )


def phrase_words(keywords: Column) -> Column:
    """Distinct lower-case words of all phrases, nothing cleaned or dropped."""
    return F.array_distinct(tokens(F.lower(F.array_join(keywords, " "))))


def key_term(text: Column, terms: Sequence[str],
             stop: Sequence[str] = lx.TERM_STOP) -> Column:
    """First listed term found at a word start, else the first name-like word, else null."""
    low = F.lower(text)
    known = [
        F.when(F.contains(low, F.lit(t.lower())) & low.rlike(rf"\b{re.escape(t.lower())}"), F.lit(t))
        for t in terms
    ]
    return F.coalesce(*known, _name_like(text, stop))


def _with_previous(toks: Column) -> Column:
    """ARRAY<STRUCT<w, prev>>; the first token's prev is empty.

    Zipped, not looked up by index: a lambda would make the token array anew per element.
    """
    shifted = F.concat(F.array(F.lit("")), toks)
    pairs = F.zip_with(toks, shifted, lambda w, p: F.struct(w.alias("w"), p.alias("prev")))
    return F.filter(pairs, lambda s: s["w"].isNotNull())


def _name_like(text: Column, stop: Sequence[str]) -> Column:
    toks = tokens(text)
    # most tokens fail the capital test, so only the survivors are cleaned
    capital = F.filter(
        _with_previous(toks),
        lambda s: (s["prev"] != "")
        & s["w"].rlike("^[^A-Za-z]*[A-Z]")
        & ~s["prev"].rlike("[.!?]$"),
    )
    words = F.transform(capital, lambda s: F.regexp_replace(s["w"], "[^A-Za-z]", ""))
    good = F.filter(words, lambda w: (F.length(w) >= 4) & ~F.lower(w).isin(list(stop)))
    # one search of the text spares the tokens of those without any
    return F.when(text.rlike(INNER_CAPITAL), F.try_element_at(good, F.lit(1)))


def proper_noun(text: Column, stop: Sequence[str] = lx.CALLOUT_STOP) -> Column:
    """First capitalised all-letter word that does not open a sentence, upper-cased."""
    toks = tokens(text)
    inner = F.filter(
        _with_previous(toks),
        lambda s: (s["prev"] != "") & s["w"].rlike(r"\p{Lu}") & ~s["prev"].rlike(r"""[.!?"]$"""),
    )
    words = F.transform(inner, lambda s: F.regexp_replace(s["w"], NOT_WORD, ""))
    good = F.filter(words, lambda w: w.rlike(r"^\p{Lu}\p{L}{2,}$") & ~w.isin(list(stop)))
    return F.upper(F.try_element_at(good, F.lit(1)))


def number_phrase(text: Column, small: Sequence[str] = lx.SMALL_NUMBERS,
                  big: Sequence[str] = lx.BIG_NUMBERS,
                  connectors: Sequence[str] = lx.NUMBER_CONNECTORS,
                  units: Sequence[str] = lx.NUMBER_UNITS) -> Column:
    """Longest substantive run of number words with an optional unit, upper-cased.

    Every token is wrapped as <token>, so tokens that clean to nothing stay as breaks. A run is repeated possessively,
    which is matched in a loop: what follows it may be empty, so nothing is ever given back, and a greedy group would
    take stack for each word of the run.
    """
    single = F.regexp_replace(strip(F.lower(text)), r"\s+", " ")
    clean = F.regexp_replace(single, r"[^\p{L}\p{N}_' -]", "")
    wrapped = F.concat(F.lit("<"), F.replace(clean, F.lit(" "), F.lit("><")), F.lit(">"))
    num = "<(?:" + "|".join([*small, *big]) + ")>"
    large = "<(?:" + "|".join(big) + ")>"
    link = "<(?:" + "|".join(connectors) + ")>"
    unit = "<(?:" + "|".join(units) + ")>"
    runs = F.regexp_extract_all(wrapped, F.lit(f"{num}(?:{num}|{link}{num})*+(?:{unit})?"), F.lit(0))
    kept = F.filter(
        F.transform(
            runs,
            lambda r, i: F.struct(
                F.regexp_count(r, F.lit("<")).alias("size"), (-i).alias("order"), r.alias("run")
            ),
        ),
        lambda s: s["run"].rlike(f"{unit}$")
        | ((F.regexp_count(s["run"], F.lit(num)) >= 2) & s["run"].rlike(large)),
    )
    best = F.array_max(kept)["run"]
    return F.upper(F.regexp_replace(F.replace(best, F.lit("><"), F.lit(" ")), "[<>]", ""))


def callout(text: Column, **numbers) -> Column:
    """The proper noun, else the number phrase."""
    return F.coalesce(proper_noun(text), number_phrase(text, **numbers))


def card_eligible(scene_idx: Column, text: Column, n_words: Column,
                  cues: Sequence[str]) -> Column:
    """A short line, or a line of at most ten words that opens with a cue; never scene 0."""
    low = F.lower(text)
    opens = F.lit(False)
    for cue in cues:
        opens = opens | low.startswith(cue)
    return (scene_idx > 0) & (n_words <= lx.CARD_MAX_WORDS) & (opens | (n_words <= lx.CARD_SHORT_WORDS))


def keyed_settings(settings: Column, ladders: Column) -> Column:
    """Settings with a signature of all scenes' keywords: an edited ladder changes a run's identity.

    ``ladders``: one array of keywords a scene, in order.
    """
    joined = F.array_join(F.transform(ladders, lambda k: F.array_join(k, ",")), "|")
    return F.concat(settings, F.lit("|kw="), F.substring(F.sha2(joined, 256), 1, 12))


def run_fingerprint(text: Column, scene_count: Column, settings: Column) -> Column:
    joined = F.concat(text, F.lit("|"), scene_count.cast("string"), F.lit("|"), settings)
    return F.substring(F.sha2(joined, 256), 1, 16)
