"""DuckDB statements that give the registered queries' results from the same tables.

They restate the rules in plain SQL: greedy folds as recursive CTEs, everything else as
joins and windows over whole tables.
"""

from __future__ import annotations

from ..functions import lexicon as lx
from ..operators.alignment import ROUNDS
from . import fixtures as fx
from .queries import MAX_SHOT_MS, SETTINGS


def _quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _list(words) -> str:
    return "[" + ", ".join(_quote(w) for w in words) + "]"


def _tokens(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '\\s+'), lambda t: t <> '')"


def _norm(x: str) -> str:
    return f"regexp_replace(lower({x}), '[^\\p{{L}}\\p{{N}}_'']', '', 'g')"


def _word(x: str) -> str:
    return f"regexp_replace({x}, '[^\\p{{L}}\\p{{N}}_]', '', 'g')"


def _upper(x: str) -> str:
    return f"upper(replace({x}, 'ß', 'SS'))"


def _ascii(x: str) -> str:
    """Accented letters as underscores: RE2 ends words at them, other engines do not."""
    return f"regexp_replace(lower({x}), '[\\x{{00C0}}-\\x{{024F}}]', '_', 'g')"


DOCS = """docs AS MATERIALIZED (
  SELECT doc_id AS script_id, text, list_filter(string_split(regexp_replace(
    regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '([.!?]["'')]*)\\s+', '\\1' || chr(1), 'g'), chr(1)),
    lambda s: s <> '') AS s FROM documents)"""
OPENING = """^["''(\\[]*"""


def _bare(x: str) -> str:
    return f"""regexp_replace({x}, '^["''(\\[]+|["'')\\]]+$', '', 'g')"""


def _times(n: str, p: str) -> str:
    return f"(CASE WHEN {n} > 0 THEN {n} * ln({p}) ELSE 0 END)"


LETTERS = "^[\\p{L}.]*\\p{L}[\\p{L}.]*$"
INITIALS = "^\\p{L}(\\.\\p{L})*$"
#: The unsupervised sentence model: abbreviations and starters by log likelihood ratios, then pieces glued where a stop belongs to a word.
LEARNED = f""", tokens AS MATERIALIZED (
  SELECT {_bare('t[k]')} AS core, CASE WHEN k > 1 THEN {_bare('t[k - 1]')} END AS before
  FROM (SELECT t, unnest(range(1, len(t) + 1)) AS k FROM (SELECT {_tokens('text')} AS t FROM docs)))
, tokened AS MATERIALIZED (
  SELECT ends_with(core, '.') AS stop, lower(CASE WHEN ends_with(core, '.') THEN substr(core, 1, length(core) - 1) ELSE regexp_replace(core, '[,;:!?]+$', '') END) AS word,
    regexp_matches(before, '[.!?]$') AS ended, ends_with(before, '.') AS stop_before, lower(substr(before, 1, length(before) - 1)) AS word_before FROM tokens)
, word_counts AS MATERIALIZED (SELECT word, count(*)::DOUBLE AS n, count_if(stop)::DOUBLE AS n_stop FROM tokened GROUP BY word)
, totals AS (SELECT sum(n) AS n_all, sum(n_stop) AS stops FROM word_counts)
, abbreviation_scores AS (
  SELECT word, round(-2 * ({_times('n_stop', 'stops / n_all')} + {_times('(n - n_stop)', '1 - stops / n_all')} - {_times('n_stop', '0.99::DOUBLE')} - {_times('(n - n_stop)', '1 - 0.99::DOUBLE')})
      * exp(-letters) * (inner_stops + 1) * pow(letters, -(n - n_stop)), 6) AS score
  FROM (SELECT *, (length(word) - inner_stops + 1)::DOUBLE AS letters FROM (
    SELECT *, length(word) - length(replace(word, '.', '')) AS inner_stops FROM word_counts, totals WHERE n_stop > 0 AND regexp_matches(word, '{LETTERS}'))))
, short_words AS (SELECT coalesce(list(word), []) AS short FROM abbreviation_scores WHERE score >= 0.3)
, starts AS MATERIALIZED (
  SELECT word, count(*)::DOUBLE AS n_start FROM tokened, short_words
  WHERE ended AND NOT (stop_before AND (regexp_matches(word_before, '{INITIALS}') OR list_contains(short, word_before))) GROUP BY word)
, starter_scores AS (
  SELECT word, n_start * n_all > n * a AS often, round(-2 * (
      {_times('n_start', 'n / n_all')} + {_times('(a - n_start)', '1 - n / n_all')} + {_times('(n - n_start)', 'n / n_all')} + {_times('(n_all - a - n + n_start)', '1 - n / n_all')}
      - {_times('n_start', 'n_start / a')} - {_times('(a - n_start)', '1 - n_start / a')}
      - {_times('(n - n_start)', '(n - n_start) / (n_all - a)')} - {_times('(n_all - a - n + n_start)', '1 - (n - n_start) / (n_all - a)')}), 6) AS score
  FROM word_counts JOIN starts USING (word), totals, (SELECT sum(n_start) AS a FROM starts) WHERE regexp_matches(word, '\\p{{L}}'))
, starter_words AS (SELECT coalesce(list(word), []) AS opens FROM starter_scores WHERE score >= 30 AND often)
, glued AS MATERIALIZED (
  SELECT script_id, list_filter(string_split(array_to_string(list_transform(range(1, len(s) + 1), lambda i: s[i] || CASE
      WHEN i = len(s) THEN '' WHEN ends_with(lasts[i], '.') AND (regexp_matches(regexp_replace(lasts[i], '\\.$', ''), '{INITIALS}') OR list_contains(short, regexp_replace(lasts[i], '\\.$', '')))
        AND NOT (regexp_matches(s[i + 1], '{OPENING}\\p{{Lu}}') AND list_contains(opens, firsts[i + 1])) THEN ' ' ELSE chr(1) END), ''), chr(1)), lambda x: x <> '') AS g
  FROM (SELECT *, list_transform(s, lambda x: lower({_bare("regexp_extract(x, '(\\S+)$', 1)")})) AS lasts,
      list_transform(s, lambda x: lower(regexp_extract(x, '{OPENING}([\\p{{L}}\\p{{N}}_''-]+)', 1))) AS firsts FROM docs), short_words, starter_words)"""
SENTS = DOCS + f""", sents AS MATERIALIZED (
  SELECT script_id, i - 1 AS sent_idx, s[i] AS text, len({_tokens('s[i]')}) AS n_words
  FROM (SELECT script_id, s, unnest(range(1, len(s) + 1)) AS i FROM docs))"""
SCENES = SENTS + """, fold AS (
  SELECT script_id, sent_idx, n_words AS held, 0::BIGINT AS scene_idx FROM sents WHERE sent_idx = 0
  UNION ALL
  SELECT s.script_id, s.sent_idx,
    CASE WHEN (f.held + s.n_words) * 400 > 4000 THEN s.n_words ELSE f.held + s.n_words END,
    f.scene_idx + CASE WHEN (f.held + s.n_words) * 400 > 4000 THEN 1 ELSE 0 END
  FROM fold f JOIN sents s ON s.script_id = f.script_id AND s.sent_idx = f.sent_idx + 1
), scenes AS MATERIALIZED (
  SELECT *, (sum(n_words) OVER w * 400)::BIGINT AS end_ms,
    ((sum(n_words) OVER w - n_words) * 400)::BIGINT AS start_ms,
    (sum(n_words) OVER w - n_words)::BIGINT AS first_word
  FROM (SELECT f.script_id, f.scene_idx, string_agg(s.text, ' ' ORDER BY s.sent_idx) AS text,
      min(s.sent_idx) AS first_sent, count(*) AS n_sents, sum(s.n_words)::BIGINT AS n_words
    FROM fold f JOIN sents s USING (script_id, sent_idx) GROUP BY ALL)
  WINDOW w AS (PARTITION BY script_id ORDER BY scene_idx))"""
WORDS = f""", words AS MATERIALIZED (
  SELECT script_id, sent_idx, token, row_number() OVER (PARTITION BY script_id ORDER BY sent_idx, k) - 1 AS word_idx
  FROM (SELECT script_id, sent_idx, t[k] AS token, k FROM (
    SELECT script_id, sent_idx, t, unnest(range(1, len(t) + 1)) AS k
    FROM (SELECT script_id, sent_idx, {_tokens('text')} AS t FROM sents))))
, word_times AS MATERIALIZED (
  SELECT *, word_idx * 400 + sent_idx * 600 AS start_ms, word_idx * 400 + sent_idx * 600 + 380 AS end_ms FROM words)"""
SPANS = """, spans AS MATERIALIZED (
  SELECT script_id, sent_idx, CASE WHEN sent_idx = 0 THEN 0 ELSE min(start_ms) END AS start_ms,
    max(end_ms) AS end_ms, count(*) AS n_words FROM word_times GROUP BY script_id, sent_idx)"""
ASR = """, asr AS MATERIALIZED (
  SELECT script_id, row_number() OVER (PARTITION BY script_id ORDER BY word_idx) - 1 AS asr_idx,
    CASE WHEN h = 7 THEN 'zz' || word_idx ELSE token END AS token, start_ms, end_ms
  FROM (SELECT *, (word_idx * 7919 + script_id) % 23 AS h FROM word_times) WHERE h <> 3)"""
CONCEPTS = ", concepts(priority, pattern, visual, anchor) AS (VALUES " + ", ".join(
    f"({i}, {_quote(c.pattern)}, {_quote(c.visual)}, {_quote(c.anchor)})" for i, c in enumerate(fx.CONCEPTS)) + ")"
ALTS = ", alternates(visual, alts) AS (VALUES " + ", ".join(
    f"({_quote(k)}, {_list(v)})" for k, v in fx.ALTERNATES.items()) + ")"
TAGS = CONCEPTS + f""", hits AS MATERIALIZED (
  SELECT s.script_id, s.scene_idx, c.visual, c.anchor,
    row_number() OVER (PARTITION BY s.script_id, s.scene_idx ORDER BY c.priority) AS n
  FROM (SELECT script_id, scene_idx, {_ascii('text')} AS low FROM scenes) s JOIN concepts c
    ON regexp_matches(s.low, c.pattern))
, tags AS MATERIALIZED (
  SELECT s.*, a.visual, a.anchor, b.visual AS second_visual FROM scenes s
  LEFT JOIN hits a ON a.script_id = s.script_id AND a.scene_idx = s.scene_idx AND a.n = 1
  LEFT JOIN hits b ON b.script_id = s.script_id AND b.scene_idx = s.scene_idx AND b.n = 2)"""
TOPICS = f""", topics AS MATERIALIZED (
  SELECT d.script_id, coalesce(t.visual, {_quote(lx.DEFAULT_TOPIC[0])}) AS topic_visual,
    coalesce(t.anchor, {_quote(lx.DEFAULT_TOPIC[1])}) AS topic_anchor
  FROM docs d LEFT JOIN (
    SELECT script_id, visual, anchor FROM (
      SELECT d.script_id, c.*, len(regexp_extract_all(d.low, c.pattern)) AS hits
      FROM (SELECT script_id, {_ascii('text')} AS low FROM docs) d CROSS JOIN concepts c)
    WHERE hits > 0
    QUALIFY row_number() OVER (PARTITION BY script_id ORDER BY hits DESC, priority) = 1) t USING (script_id))"""
ROTATED = ALTS + """, rotated AS MATERIALIZED (
  SELECT t.*, coalesce(a.alts[(use_no % len(a.alts)) + 1], t.visual) AS prim FROM (
    SELECT *, CASE WHEN visual IS NOT NULL THEN
      row_number() OVER (PARTITION BY script_id, visual ORDER BY scene_idx) - 1 END AS use_no FROM tags) t
  LEFT JOIN alternates a ON a.visual = t.visual)"""
PLANNED = SCENES + TAGS + TOPICS + ROTATED + """, planned AS MATERIALIZED (
  SELECT *, list_filter([k1, k2, k3], lambda x, i: list_position([k1, k2, k3], x) = i) AS keywords FROM (
    SELECT r.*, t.topic_visual, t.topic_anchor,
      coalesce(last_value(prim IGNORE NULLS) OVER upto, topic_visual) AS k1,
      CASE WHEN prim IS NOT NULL THEN coalesce(second_visual,
        last_value(prim IGNORE NULLS) OVER before, topic_visual) ELSE topic_visual END AS k2,
      coalesce(last_value(anchor IGNORE NULLS) OVER upto, topic_anchor) AS k3
    FROM rotated r JOIN topics t USING (script_id)
    WINDOW upto AS (PARTITION BY script_id ORDER BY scene_idx ROWS UNBOUNDED PRECEDING),
      before AS (PARTITION BY script_id ORDER BY scene_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)))"""
ELIGIBLE = "scene_idx > 0 AND n_words <= 10 AND (n_words <= 6 OR " + " OR ".join(
    f"starts_with(lower(text), {_quote(c)})" for c in fx.CARD_CUES) + ")"
CARDS = f""", eligible AS MATERIALIZED (SELECT *, {ELIGIBLE} AS ok FROM scenes)
, carding AS (
  SELECT script_id, scene_idx, ok AS is_card, CASE WHEN ok THEN scene_idx ELSE -4 END AS last_card
  FROM eligible WHERE scene_idx = 0
  UNION ALL
  SELECT e.script_id, e.scene_idx, e.ok AND e.scene_idx - c.last_card >= 4,
    CASE WHEN e.ok AND e.scene_idx - c.last_card >= 4 THEN e.scene_idx ELSE c.last_card END
  FROM carding c JOIN eligible e ON e.script_id = c.script_id AND e.scene_idx = c.scene_idx + 1)
, cards AS MATERIALIZED (SELECT script_id, scene_idx, is_card FROM carding)"""


def _bits(seed: int) -> str:
    return f"('0x' || substr(md5('{seed}|' || script_id || '|' || scene_idx), 1, 8))::BIGINT"


_POOL = _list([label for label, weight in lx.BOUNDARY_WEIGHTS for _ in range(weight)])
STYLES = f""", edges AS MATERIALIZED (SELECT script_id, scene_idx, start_ms, {_bits(42)} AS bits FROM scenes WHERE scene_idx > 0)
, styling AS (
  SELECT script_id, scene_idx, start_ms, {_POOL}[bits % 20 + 1] AS style FROM edges WHERE scene_idx = 1
  UNION ALL
  SELECT e.script_id, e.scene_idx, e.start_ms,
    list_filter({_POOL}, lambda x: x = 'cut' OR x <> s.style)[e.bits % len(list_filter({_POOL}, lambda x: x = 'cut' OR x <> s.style)) + 1]
  FROM styling s JOIN edges e ON e.script_id = s.script_id AND e.scene_idx = s.scene_idx + 1)
, styles AS MATERIALIZED (SELECT * FROM styling)"""
_MOTIONS = _list(lx.MOTION_LABELS)
MOTIONS = f""", turns AS MATERIALIZED (SELECT script_id, scene_idx, {_bits(7)} AS bits FROM scenes)
, moving AS (
  SELECT script_id, scene_idx, {_MOTIONS}[bits % 5 + 1] AS motion FROM turns WHERE scene_idx = 0
  UNION ALL
  SELECT t.script_id, t.scene_idx, list_filter({_MOTIONS}, lambda x: x <> m.motion)[t.bits % 4 + 1]
  FROM moving m JOIN turns t ON t.script_id = m.script_id AND t.scene_idx = m.scene_idx + 1)"""


def _term(x: str) -> str:
    known = " ".join(
        f"WHEN regexp_matches({_ascii(x)}, '\\b{t}') THEN {_quote(t)}" for t in fx.TERMS)
    toks = _tokens(x)
    # pairs of a token and the one before it
    pairs = f"list_zip({toks}, list_prepend('', {toks}))"
    names = (
        f"list_filter(list_transform(list_filter({pairs}, lambda p: p[1] IS NOT NULL AND p[2] <> '' "
        f"AND regexp_matches(p[1], '^[^A-Za-z]*[A-Z]') AND NOT regexp_matches(p[2], '[.!?]$')), "
        f"lambda p: regexp_replace(p[1], '[^A-Za-z]', '', 'g')), "
        f"lambda w: length(w) >= 4 AND NOT list_contains({_list(lx.TERM_STOP)}, lower(w)))"
    )
    return f"CASE {known} ELSE ({names})[1] END"


def _name(x: str) -> str:
    toks = _tokens(x)
    pairs = f"list_zip({toks}, list_prepend('', {toks}))"
    names = (
        f"list_filter(list_transform(list_filter({pairs}, lambda p: p[1] IS NOT NULL AND p[2] <> '' "
        f"AND NOT regexp_matches(p[2], '[.!?\"]$')), lambda p: {_word('p[1]')}), "
        f"lambda w: regexp_matches(w, '^\\p{{Lu}}\\p{{L}}{{2,}}$') AND NOT list_contains({_list(lx.CALLOUT_STOP)}, w))"
    )
    return _upper(f"({names})[1]")


def _phrase(x: str) -> str:
    n = fx.NUMBERS
    num = "<(?:" + "|".join([*n["small"], *n["big"]]) + ")>"
    big = "<(?:" + "|".join(n["big"]) + ")>"
    link = "<(?:" + "|".join(n["connectors"]) + ")>"
    unit = "<(?:" + "|".join(n["units"]) + ")>"
    single = f"regexp_replace(regexp_replace(lower({x}), '^\\s+|\\s+$', '', 'g'), '\\s+', ' ', 'g')"
    clean = f"regexp_replace({single}, '[^\\p{{L}}\\p{{N}}_'' -]', '', 'g')"
    wrapped = f"'<' || replace({clean}, ' ', '><') || '>'"
    runs = f"regexp_extract_all({wrapped}, '{num}(?:{num}|{link}{num})*(?:{unit})?')"
    kept = (
        f"list_filter({runs}, lambda r: regexp_matches(r, '{unit}$') OR "
        f"(len(regexp_extract_all(r, '{num}')) >= 2 AND regexp_matches(r, '{big}')))"
    )
    # the longest by tokens, the first on ties
    best = (
        f"list_reduce({kept}, lambda a, b: CASE WHEN len(string_split(b, '><')) > "
        f"len(string_split(a, '><')) THEN b ELSE a END)"
    )
    return (
        f"CASE WHEN len({kept}) > 0 THEN {_upper(f'regexp_replace(replace({best}, ' + _quote('><') + ', ' + _quote(' ') + '), ' + _quote('[<>]') + ', ' + _quote('') + ', ' + _quote('g') + ')')} END"
    )


RELATIVE = """, relative AS MATERIALIZED (
  SELECT s.script_id, s.scene_idx, w.word_idx - s.first_word AS token_idx, w.token,
    greatest(0, w.start_ms - s.start_ms) AS start_ms, greatest(50, w.end_ms - s.start_ms) AS end_ms
  FROM word_times w JOIN scenes s ON s.script_id = w.script_id
    AND w.sent_idx >= s.first_sent AND w.sent_idx < s.first_sent + s.n_sents)"""

CAPTION_TOKENS = f""", ctokens AS MATERIALIZED (
  SELECT script_id, scene_idx, end_ms - start_ms AS duration_ms, t, len(t) AS n_tokens,
    list_transform(t, lambda x: length(x)) AS lens,
    list_transform(t, lambda x: regexp_matches(x, '[.!?]$')) AS stops
  FROM (SELECT *, {_tokens('text')} AS t FROM scenes))
, next_chunk AS (
  SELECT script_id, scene_idx, 1::BIGINT AS i, 0::BIGINT AS chunk_idx, 1::BIGINT AS n, 1::BIGINT AS lines, lens[1] AS width,
    false AS closed, lens, stops, n_tokens FROM ctokens WHERE n_tokens > 0
  UNION ALL
  SELECT script_id, scene_idx, i + 1, chunk_idx + (CASE WHEN fresh OR rolled THEN 1 ELSE 0 END),
    n2, CASE WHEN rolled THEN 1 ELSE lines2 END, CASE WHEN rolled THEN lens[i + 1] ELSE width2 END,
    NOT rolled AND (n2 >= 7 OR (stops[i + 1] AND n2 >= 2)), lens, stops, n_tokens
  FROM (SELECT *, NOT fresh AND lines2 > 2 AS rolled,
      CASE WHEN fresh OR lines2 > 2 THEN 1 ELSE n + 1 END AS n2 FROM (
    SELECT *, closed AS fresh,
      CASE WHEN closed THEN 1 WHEN width + 1 + lens[i + 1] > 40 THEN lines + 1 ELSE lines END AS lines2,
      CASE WHEN closed THEN lens[i + 1] WHEN width + 1 + lens[i + 1] > 40 THEN lens[i + 1]
        ELSE width + 1 + lens[i + 1] END AS width2
    FROM next_chunk WHERE i < n_tokens)))
, chunked AS MATERIALIZED (
  SELECT c.script_id, c.scene_idx, c.chunk_idx, c.i - 1 AS token_idx, t.t[c.i] AS word, length(t.t[c.i]) AS len,
    t.duration_ms, t.n_tokens,
    row_number() OVER (PARTITION BY c.script_id, c.scene_idx, c.chunk_idx ORDER BY c.i) - 1 AS word_idx
  FROM (SELECT script_id, scene_idx, i, chunk_idx FROM next_chunk) c JOIN ctokens t USING (script_id, scene_idx))"""
ESTIMATED = """, sums AS (
  SELECT *, sum(len) OVER scene AS total, sum(len) OVER chunk AS chars,
    coalesce(sum(len) OVER (PARTITION BY script_id, scene_idx, chunk_idx ORDER BY token_idx
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS upto,
    coalesce(sum(len) OVER (PARTITION BY script_id, scene_idx ORDER BY token_idx
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before_word
  FROM chunked WINDOW scene AS (PARTITION BY script_id, scene_idx),
    chunk AS (PARTITION BY script_id, scene_idx, chunk_idx))
, estimated AS MATERIALIZED (
  SELECT script_id, scene_idx, chunk_idx, word_idx, s + upto::DOUBLE / chars * l AS start_ms,
    s + (upto + len)::DOUBLE / chars * l AS end_ms, duration_ms
  FROM (SELECT *, (before_word - upto)::DOUBLE / total * duration_ms AS s,
    greatest(50.0::DOUBLE, (before_word - upto + chars)::DOUBLE / total * duration_ms
      - (before_word - upto)::DOUBLE / total * duration_ms) AS l FROM sums))"""
TIMED = """, timed AS MATERIALIZED (
  SELECT script_id, scene_idx, chunk_idx, word_idx, s2 AS start_ms,
    least(greatest(e, s2 + 30), duration_ms)::BIGINT AS end_ms FROM (
    SELECT *, least(greatest(s, 0), greatest(duration_ms - 30, 0))::BIGINT AS s2 FROM (
      SELECT *, greatest(coalesce(follow, duration_ms), s + 30) AS e FROM (
        SELECT *, CASE WHEN word_idx = 0 AND chunk_idx = 0 THEN 0 ELSE at_ms END AS s,
          CASE WHEN next_chunk_idx = chunk_idx THEN next_at
            ELSE coalesce(nullif(next_at, 0), duration_ms) END AS follow FROM (
          SELECT c.*, r.start_ms AS at_ms, lead(r.start_ms) OVER w AS next_at, lead(c.chunk_idx) OVER w AS next_chunk_idx,
            count(r.start_ms) OVER (PARTITION BY c.script_id, c.scene_idx) AS n_timed, max(n_times) OVER (PARTITION BY c.script_id, c.scene_idx) AS n_given
          FROM chunked c LEFT JOIN (SELECT *, count(*) OVER (PARTITION BY script_id, scene_idx) AS n_times FROM relative) r USING (script_id, scene_idx, token_idx)
          WINDOW w AS (PARTITION BY c.script_id, c.scene_idx ORDER BY c.token_idx))
        WHERE n_timed = n_tokens AND n_given = n_tokens))))"""

TERMS = f""", terms AS MATERIALIZED (SELECT *, {_term('text')} AS term FROM scenes)"""
CARD_TERMS = f""", terms AS MATERIALIZED (
  SELECT s.*, c.is_card, CASE WHEN NOT c.is_card THEN {_term('s.text')} END AS term
  FROM scenes s JOIN cards c USING (script_id, scene_idx))"""
TYPED = """, typed AS MATERIALIZED (
  SELECT script_id, scene_idx, k AS char_idx, substr(term, k + 1, 1) AS char, start_ms + 400 + k * 75 AS at_ms
  FROM (SELECT *, unnest(range(0, length(term))) AS k FROM terms WHERE term IS NOT NULL))"""
CUES = """, cues AS MATERIALIZED (
  SELECT script_id, seq, kind, at_ms FROM (
    SELECT s.script_id, s.scene_idx AS seq, s.start_ms AS at_ms,
      CASE WHEN c.is_card THEN 'card' WHEN style IN ('punch', 'zoompunch') THEN 'impact'
        WHEN style = 'white' THEN 'whoosh' WHEN style = 'black' THEN 'whoosh_soft' END AS kind
    FROM styles s JOIN cards c USING (script_id, scene_idx)) WHERE kind IS NOT NULL
  UNION ALL
  SELECT script_id, (scene_idx + 1) * 1000000000 + char_idx, 'key', at_ms FROM typed)"""


def _spaced(source: str, keys: str, at: str, seq: str, gap: str, op: str) -> str:
    """Greedy spacing over ``source`` as a recursion along each group; gives ``spaced``."""
    on = " AND ".join(f"n.{k} = p.{k}" for k in keys.split(", "))
    cols = ", ".join(f"n.{k}" for k in keys.split(", "))
    return f""", line AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {at}, {seq}) AS pos FROM {source})
, walk AS (
  SELECT {keys}, {seq}, pos, {at} AS last_at, true AS kept FROM line WHERE pos = 1
  UNION ALL
  SELECT {cols}, n.{seq}, n.pos, CASE WHEN n.{at} - p.last_at {op} {gap} THEN n.{at} ELSE p.last_at END,
    n.{at} - p.last_at {op} {gap}
  FROM walk p JOIN line n ON {on} AND n.pos = p.pos + 1)
, spaced AS MATERIALIZED (SELECT l.*, w.kept FROM line l JOIN walk w USING ({keys}, {seq}, pos))"""


EVENT_CUES = ", event_cues AS MATERIALIZED (SELECT user_id AS script_id, event_id AS seq, CASE event_type " + " ".join(
    f"WHEN {_quote(k)} THEN {_quote(v)}" for k, v in fx.KINDS.items()) + (
    " END AS kind, epoch_us(ts) // 1000 AS at_ms FROM events)")
LEAD = "greatest(at_ms - CASE WHEN kind IN ('riser', 'card') THEN 900 ELSE 60 END, 0)"
LOG = ", log AS MATERIALIZED (SELECT event_id, event_type AS provider, user_id::VARCHAR AS query, ts, epoch_us(ts) AS us FROM events)"

# -- clips ---------------------------------------------------------------------

CATALOG = f"""clips AS MATERIALIZED (
  SELECT CASE WHEN p_partkey % 2 = 0 THEN 'A' ELSE 'B' END AS source, p_partkey::VARCHAR AS video_id,
    [1280, 1920, 2560, 3840][p_partkey % 4 + 1] AS width, p_size::DOUBLE AS duration_s,
    lower(p_name || ' ' || p_type) AS descr, p_partkey AS source_rank,
    list_sort(list_distinct(list_filter(regexp_split_to_array(lower(p_name || ' ' || p_type), '[^a-z]+'), lambda w: length(w) > 2))) AS words
  FROM part)
, requests AS MATERIALIZED (
  SELECT o_orderkey // 16 AS script_id, o_orderkey % 16 AS scene_idx,
    'order ' || o_orderkey || ' ' || p_name AS text,
    CASE WHEN o_orderkey % 5 = 0 THEN list_append(string_split(p_name, ' '), lower(p_type))
      ELSE list_prepend(p_name, string_split(p_name, ' ')) END AS keywords,
    4000 + o_orderkey % 9 * 1000 AS needed_ms
  FROM orders JOIN part ON p_partkey = o_orderkey * 17 % (SELECT max(p_partkey) + 1 FROM part))
, ladders AS MATERIALIZED (
  SELECT *, list_filter(qs, lambda x, i: list_position(qs, x) = i) AS queries FROM (
    SELECT *, list_filter(CASE WHEN len(list_filter(keywords, lambda k: contains(k, ' '))) > 0 THEN keywords
      ELSE [array_to_string(keywords, ' '), array_to_string(keywords[1:2], ' '), keywords[1]] END, lambda q: q <> '') AS qs
    FROM requests))
, ladder AS MATERIALIZED (
  SELECT script_id, scene_idx, text, needed_ms, queries[i] AS query, p.source, (i - 1) * 2 + p.k AS group_rank
  FROM (SELECT *, unnest(range(1, len(queries) + 1)) AS i FROM ladders) l
  JOIN (VALUES (0, 0, 'A'), (0, 1, 'B'), (1, 0, 'B'), (1, 1, 'A')) p(parity, k, source) ON p.parity = l.scene_idx % 2)
, queries AS MATERIALIZED (
  SELECT query, list_distinct(list_filter(regexp_split_to_array(lower(query), '\\s+'), lambda w: length(w) > 2)) AS qw,
    CASE WHEN len(list_filter(regexp_split_to_array(lower(query), '\\s+'),
      lambda w: length(w) > 2 AND NOT list_contains({_list(lx.QUERY_FILLER)}, w))) >= 2 THEN 3.0 ELSE 0.0 END::DOUBLE AS floor
  FROM (SELECT DISTINCT query FROM ladder))
, overlap AS MATERIALIZED (
  SELECT query, source, words, (3.0 * len(list_intersect(qw, words)) - CASE WHEN list_has_any(qw, {_list(fx.PERSONS)})
      AND list_has_any(words, {_list(fx.ANIMALS)}) AND NOT list_has_any(words, {_list(fx.PERSONS)}) THEN 8.0 ELSE 0.0 END)::DOUBLE AS rel,
    list_has_any(qw, {_list(fx.PERSONS)}) AND list_has_any(words, {_list(fx.ANIMALS)}) AND NOT list_has_any(words, {_list(fx.PERSONS)}) AS conflict
  FROM queries JOIN (SELECT DISTINCT source, words FROM clips) ON list_has_any(qw, words))
, results AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY query, source ORDER BY rel DESC, source_rank) AS result_no
  FROM overlap JOIN clips USING (source, words) QUALIFY result_no <= 30)
, scored AS MATERIALIZED (
  SELECT r.*, n.needed_ms, q.floor, round(
    CASE WHEN duration_s >= needed_ms / 1000.0::DOUBLE THEN 6.0 ELSE -4.0 * (needed_ms / 1000.0::DOUBLE - duration_s) END::DOUBLE
    + CASE WHEN width >= 1920 THEN 2.0 WHEN width >= 1280 THEN 1.0 ELSE 0.0 END::DOUBLE
    - abs(width - 1920) / 1920.0::DOUBLE + rel, 6) AS score
  FROM (SELECT DISTINCT query, source, needed_ms FROM ladder) n JOIN results r USING (query, source) JOIN queries q USING (query))
, ranked AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY query, source, needed_ms ORDER BY score DESC, result_no) AS cand_rank
  FROM scored WHERE rel >= floor)
, top AS MATERIALIZED (SELECT * FROM ranked WHERE cand_rank <= 6)"""
_SIMS = """, n_clips AS (SELECT max(vec_id) // 3 + 1 AS n, max(vec_id) + 1 AS v FROM embeddings)
, qvec AS MATERIALIZED (
  SELECT query, embedding::DOUBLE[] AS qv FROM queries, n_clips
  JOIN embeddings ON vec_id = (length(query) * 31 + ascii(query) * 7) % v)
, fvec AS MATERIALIZED (
  SELECT source, video_id, embedding::DOUBLE[] AS fv FROM clips, n_clips
  JOIN embeddings ON vec_id // 3 = source_rank % n)
, sims AS MATERIALIZED (
  SELECT query, source, video_id, CASE WHEN sim = 0 THEN 0.0 ELSE sim END AS sim FROM (
    SELECT p.query, p.source, p.video_id, round(avg(list_cosine_similarity(qv, fv)), 4) AS sim
    FROM (SELECT DISTINCT query, source, video_id FROM {}) p
    LEFT JOIN qvec USING (query) LEFT JOIN fvec USING (source, video_id) GROUP BY ALL))"""
SIMS = _SIMS.format("top")
WEAK = """, weak AS MATERIALIZED (
  SELECT l.script_id, l.scene_idx, l.group_rank, s.*, row_number() OVER (
    PARTITION BY l.script_id, l.scene_idx ORDER BY score DESC, group_rank, result_no) AS pref
  FROM ladder l JOIN scored s USING (query, source, needed_ms) WHERE rel < floor)"""
TEXT_PREFS = """, choices AS MATERIALIZED (
  SELECT l.script_id, l.scene_idx, 0 AS kind, row_number() OVER (
    PARTITION BY l.script_id, l.scene_idx ORDER BY group_rank, cand_rank) AS pref, r.query, source, video_id, score, 'text' AS tier
  FROM ladder l JOIN ranked r USING (query, source, needed_ms)
  UNION ALL SELECT script_id, scene_idx, 1, pref, query, source, video_id, score, 'weak' FROM weak)"""
SIM_PREFS = """, choices AS MATERIALIZED (
  SELECT script_id, scene_idx, 0 AS kind, row_number() OVER (PARTITION BY script_id, scene_idx
    ORDER BY tier_no, CASE WHEN tier_no = 0 THEN group_rank ELSE -1 END, sim DESC, group_rank, cand_rank) AS pref,
    query, source, video_id, score, ['strong', 'ok', 'low'][tier_no + 1] AS tier
  FROM (SELECT l.script_id, l.scene_idx, l.group_rank, t.query, t.source, t.video_id, t.score, t.cand_rank, m.sim,
      CASE WHEN sim >= 0.24 THEN 0 WHEN sim >= 0.19 THEN 1 ELSE 2 END AS tier_no
    FROM ladder l JOIN top t USING (query, source, needed_ms) JOIN sims m USING (query, source, video_id)
    WHERE sim IS NOT NULL)
  UNION ALL SELECT script_id, scene_idx, 1, pref, query, source, video_id, score, 'weak' FROM weak)"""


def _assign(open_scenes: str) -> str:
    """Serial picks along each script; ``open_scenes`` selects the scenes that take clips."""
    return f""", options AS MATERIALIZED (
  SELECT script_id, scene_idx, list(source || ':' || video_id ORDER BY kind, pref) AS clips,
    list(query ORDER BY kind, pref) AS qs, list(tier ORDER BY kind, pref) AS tiers, count_if(kind = 0) AS n_pass,
    arg_max(query, (score, -pref)) FILTER (kind = 0) AS again_q,
    arg_max(source || ':' || video_id, (score, -pref)) FILTER (kind = 0) AS again_c
  FROM choices GROUP BY ALL)
, shots AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY script_id ORDER BY scene_idx, shot_idx) AS pos FROM (
    SELECT script_id, scene_idx, unnest(range(0, least(3, greatest(1, ceil(needed_ms / {MAX_SHOT_MS}.0)))::BIGINT)) AS shot_idx
    FROM ({open_scenes})) s LEFT JOIN options o USING (script_id, scene_idx))
, picking AS (
  SELECT script_id, 0::BIGINT AS pos, []::VARCHAR[] AS used, NULL::BIGINT AS scene_idx, NULL::BIGINT AS shot_idx,
    NULL::VARCHAR AS query, NULL::VARCHAR AS clip, NULL::VARCHAR AS tier FROM (SELECT DISTINCT script_id FROM shots)
  UNION ALL
  SELECT script_id, pos, CASE WHEN free IS NULL THEN used ELSE list_append(used, clips[free]) END, scene_idx, shot_idx,
    CASE WHEN free IS NOT NULL THEN qs[free] WHEN n_pass > 0 THEN again_q END,
    CASE WHEN free IS NOT NULL THEN clips[free] WHEN n_pass > 0 THEN again_c END,
    CASE WHEN free IS NOT NULL THEN tiers[free] WHEN n_pass > 0 THEN 'used' ELSE 'none' END
  FROM (SELECT s.*, p.used, list_filter(range(1, (CASE WHEN n_pass > 0 THEN n_pass ELSE coalesce(len(clips), 0) END + 1)::BIGINT),
      lambda i: NOT list_contains(p.used, s.clips[i]))[1] AS free
    FROM picking p JOIN shots s ON s.script_id = p.script_id AND s.pos = p.pos + 1))
, picks AS MATERIALIZED (
  SELECT script_id, scene_idx, shot_idx, query, string_split(clip, ':')[1] AS source, string_split(clip, ':')[2] AS video_id, tier
  FROM picking WHERE pos > 0)"""


# cards among the request scenes: four-word texts are all eligible from scene 1 on
REQUEST_CARDS = f""", open_requests AS MATERIALIZED (
  SELECT r.* FROM requests r WHERE NOT (scene_idx > 0 AND (scene_idx - 1) % 4 = 0))"""
# of each group the six best-ranked unused clips are looked at; the first group with a strong match ends the search
SLIDING = REQUEST_CARDS + f""", grouped AS MATERIALIZED (
  SELECT l.script_id, l.scene_idx, l.group_rank, list({{'g': l.group_rank, 'r': r.cand_rank, 'clip': r.source || ':' || r.video_id,
      'q': r.query, 'score': r.score, 'sim': m.sim}} ORDER BY r.cand_rank) AS members
  FROM ladder l JOIN ranked r USING (query, source, needed_ms) LEFT JOIN sims m USING (query, source, video_id) GROUP BY ALL)
, options AS MATERIALIZED (SELECT script_id, scene_idx, list(members ORDER BY group_rank) AS groups FROM grouped GROUP BY ALL)
, below AS MATERIALIZED (
  SELECT script_id, scene_idx, list({{'clip': source || ':' || video_id, 'q': query}} ORDER BY pref) AS weaks FROM weak GROUP BY ALL)
, shots AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY script_id ORDER BY scene_idx, shot_idx) AS pos FROM (
    SELECT script_id, scene_idx, unnest(range(0, least(3, greatest(1, ceil(needed_ms / {MAX_SHOT_MS}.0)))::BIGINT)) AS shot_idx
    FROM open_requests) s LEFT JOIN options USING (script_id, scene_idx) LEFT JOIN below USING (script_id, scene_idx))
, picking AS (
  SELECT script_id, 0::BIGINT AS pos, []::VARCHAR[] AS used, NULL::BIGINT AS scene_idx, NULL::BIGINT AS shot_idx,
    NULL::VARCHAR AS query, NULL::VARCHAR AS clip, NULL::DOUBLE AS sim FROM (SELECT DISTINCT script_id FROM shots)
  UNION ALL
  SELECT script_id, pos, CASE WHEN best IS NULL AND again IS NOT NULL THEN used
      WHEN coalesce(best.clip, free.clip) IS NULL THEN used ELSE list_append(used, coalesce(best.clip, free.clip)) END,
    scene_idx, shot_idx, coalesce(best.q, again.q, free.q), coalesce(best.clip, again.clip, free.clip), best.sim
  FROM (SELECT *, list_sort(list_transform(list_filter(seen, lambda o: strong IS NULL OR o.g = strong),
        lambda o: {{'a': -o.sim, 'g': o.g, 'r': o.r, 'clip': o.clip, 'q': o.q, 'sim': o.sim}}))[1] AS best
    FROM (SELECT *, list_min(list_transform(list_filter(seen, lambda o: o.sim >= 0.24), lambda o: o.g)) AS strong
      FROM (SELECT s.*, p.used,
          list_filter(flatten(list_transform(coalesce(s.groups, []), lambda x: list_filter(x, lambda o: NOT list_contains(p.used, o.clip))[1:6])),
            lambda o: o.sim IS NOT NULL) AS seen,
          list_sort(list_transform(list_filter(flatten(coalesce(s.groups, [])), lambda o: list_contains(p.used, o.clip)),
            lambda o: {{'a': -o.score, 'g': o.g, 'r': o.r, 'clip': o.clip, 'q': o.q}}))[1] AS again,
          list_filter(coalesce(s.weaks, []), lambda o: NOT list_contains(p.used, o.clip))[1] AS free
        FROM picking p JOIN shots s ON s.script_id = p.script_id AND s.pos = p.pos + 1))))
, picks AS MATERIALIZED (
  SELECT script_id, scene_idx, shot_idx, query, string_split(clip, ':')[1] AS source, string_split(clip, ':')[2] AS video_id, sim
  FROM picking WHERE pos > 0)"""
AUDIT = CATALOG + _SIMS.format("ranked") + WEAK + SLIDING + """, audit AS MATERIALIZED (
  SELECT p.script_id, p.scene_idx + 1 AS scene, p.shot_idx + 1 AS shot, substr(r.text, 1, 90) AS text, p.query,
    p.source || ':' || p.video_id AS clip, round_even(coalesce(p.sim, -1.0), 3) AS sim, substr(c.descr, 1, 100) AS "desc"
  FROM picks p JOIN requests r USING (script_id, scene_idx) JOIN clips c USING (source, video_id))"""

# -- recordings ------------------------------------------------------------------

FRAMES = """frames AS MATERIALIZED (
  SELECT user_id AS rec_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame_no, value / 500.0 AS rms FROM events)
, levels AS MATERIALIZED (SELECT *, round(20 * log10(rms + 1e-12), 9) AS db FROM frames)
, thresholds AS MATERIALIZED (SELECT rec_id, greatest(-38.0, quantile_cont(db, 0.92) - 26.0) AS threshold_db FROM levels GROUP BY rec_id)
, recs AS MATERIALIZED (SELECT rec_id, (max(frame_no) + 1) * 1000 AS duration_ms FROM frames GROUP BY rec_id)
, silences AS MATERIALIZED (
  SELECT rec_id, min(frame_no) * 1000 AS start_ms, (max(frame_no) + 1) * 1000 AS end_ms FROM (
    SELECT rec_id, frame_no, frame_no - row_number() OVER (PARTITION BY rec_id ORDER BY frame_no) AS island
    FROM levels JOIN thresholds USING (rec_id) WHERE db < threshold_db)
  GROUP BY rec_id, island HAVING count(*) >= 2)
, totals AS MATERIALIZED (
  SELECT rec_id, duration_ms, coalesce(q, 0)::BIGINT AS silence_ms, greatest(duration_ms - coalesce(q, 0), 0)::BIGINT AS speech_ms
  FROM recs LEFT JOIN (SELECT rec_id, sum(end_ms - start_ms) AS q FROM silences GROUP BY rec_id) USING (rec_id))
, speech AS MATERIALIZED (
  SELECT *, (start_ms - coalesce(sum(end_ms - start_ms) OVER (PARTITION BY rec_id ORDER BY start_ms
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS speech_ms FROM silences)"""
WALLS = FRAMES + ", " + SENTS + """, read_out AS MATERIALIZED (SELECT *, script_id % (SELECT count(DISTINCT user_id) FROM events) AS rec_id FROM sents)
, targets AS MATERIALIZED (
  SELECT s.rec_id, s.script_id, s.sent_idx AS bound_idx, ((2 * w * speech_ms + a) // (2 * a))::BIGINT AS target_ms, duration_ms FROM (
    SELECT rec_id, script_id, sent_idx, sum(n_words) OVER (PARTITION BY script_id ORDER BY sent_idx) AS w,
      sum(n_words) OVER (PARTITION BY script_id) AS a, max(sent_idx) OVER (PARTITION BY script_id) AS last FROM read_out) s
  JOIN totals USING (rec_id) WHERE sent_idx < last)
, skipped AS MATERIALIZED (
  SELECT rec_id, script_id, bound_idx, sum(len) OVER (PARTITION BY rec_id ORDER BY pos, side) AS gone, side FROM (
    SELECT rec_id, script_id, bound_idx, target_ms AS pos, 0 AS side, 0 AS len FROM targets
    UNION ALL SELECT rec_id, NULL, NULL, speech_ms, 1, end_ms - start_ms FROM speech))
, walls AS MATERIALIZED (
  SELECT t.rec_id, t.script_id, t.bound_idx, t.target_ms, least(t.target_ms + gone, t.duration_ms)::BIGINT AS wall_ms
  FROM targets t JOIN skipped USING (script_id, bound_idx))
, near AS MATERIALIZED (
  SELECT w.rec_id, w.script_id, w.bound_idx, w.wall_ms, list(s.start_ms + s.end_ms ORDER BY abs(s.start_ms + s.end_ms - 2 * w.wall_ms), s.start_ms + s.end_ms)
    FILTER (s.start_ms IS NOT NULL) AS mids
  FROM walls w LEFT JOIN silences s ON s.rec_id = w.rec_id AND abs(s.start_ms + s.end_ms - 2 * w.wall_ms) < 2200 GROUP BY ALL)
, clamping AS (
  SELECT rec_id, script_id, -1::BIGINT AS bound_idx, 0::BIGINT AS bound_us FROM (SELECT DISTINCT rec_id, script_id FROM near)
  UNION ALL
  SELECT n.rec_id, n.script_id, n.bound_idx, greatest(coalesce(list_filter(n.mids, lambda m: m * 500 > c.bound_us + 400000)[1] * 500,
    n.wall_ms * 1000), c.bound_us + 300000)::BIGINT
  FROM clamping c JOIN near n ON n.script_id = c.script_id AND n.bound_idx = c.bound_idx + 1)
, bounds AS MATERIALIZED (SELECT * FROM clamping WHERE bound_idx >= 0)"""

# -- alignment -------------------------------------------------------------------


def _norms(source: str, idx: str) -> str:
    return f"SELECT script_id, {idx} AS pos, {_norm('token')} AS norm FROM {source}"


def _gap_runs(source: str, side: str, idx: str, size: int, before: str) -> str:
    """Runs of non-empty words inside the gaps of earlier rounds, with how often and as which one they stand there."""
    lead = [f"lead(norm, {k}) OVER w" for k in range(size)]
    return f"""SELECT *, count(*) OVER g AS n, row_number() OVER (g ORDER BY pos) AS k FROM (
      SELECT script_id, gap, pos, {" || ' ' || ".join(lead)} AS run, {" AND ".join(f"{x} <> ''" for x in lead)} AS whole
      FROM (SELECT script_id, s.pos, norm, m.{idx} IS NOT NULL AS hit, count(m.{idx}) OVER (PARTITION BY script_id ORDER BY s.pos) AS gap
        FROM {source} s LEFT JOIN (SELECT script_id, {idx}, {idx} AS pos FROM {before}) m USING (script_id, pos)) WHERE NOT hit
      WINDOW w AS (PARTITION BY script_id, gap ORDER BY pos)) WHERE whole WINDOW g AS (PARTITION BY script_id, gap, run)"""


def _match_round(r: int, size: int, rule: str) -> str:
    """Runs that pair vote for the places of their words; of each gap the longest rising chain is kept (patience sorting:
    an element's pile is one more than the number of piles with lower tops; from the end, the latest of each pile)."""
    how = {"once": "s.n = 1 AND h.n = 1", "equal": "s.n = h.n", "least": "true"}[rule]
    return f""", s{r} AS ({_gap_runs("mine", "s", "word_idx", size, f"m{r - 1}")})
, h{r} AS ({_gap_runs("theirs", "h", "asr_idx", size, f"m{r - 1}")})
, v{r} AS (
  SELECT script_id, gap, s.pos + o AS word_idx, h.pos + o AS place, count(*) AS v
  FROM s{r} s JOIN h{r} h USING (script_id, gap, run, k), range({size}) t(o) WHERE {how} GROUP BY ALL)
, c{r} AS MATERIALIZED (
  SELECT script_id, gap, list(word_idx ORDER BY word_idx) AS words, list(place ORDER BY word_idx) AS places
  FROM (SELECT * FROM v{r} QUALIFY row_number() OVER (PARTITION BY script_id, word_idx ORDER BY v DESC, place) = 1) GROUP BY ALL)
, p{r} AS MATERIALIZED (
  SELECT *, list_reduce(list_transform(places, lambda x: {{'place': x, 'tops': []::BIGINT[], 'piles': []::BIGINT[]}}), lambda s, x: {{
      'place': x.place,
      'tops': list_concat(list_filter(s.tops, lambda t: t < x.place), list_concat([x.place], s.tops[len(list_filter(s.tops, lambda t: t < x.place)) + 2:])),
      'piles': list_append(s.piles, len(list_filter(s.tops, lambda t: t < x.place)) + 1)}},
    {{'place': 0::BIGINT, 'tops': []::BIGINT[], 'piles': []::BIGINT[]}}).piles AS piles FROM c{r})
, m{r} AS MATERIALIZED (
  SELECT * FROM m{r - 1} UNION ALL
  SELECT script_id, words[nth] AS word_idx, places[nth] AS asr_idx FROM (
    SELECT script_id, words, places, unnest(list_reduce(
      list_transform(list_reverse(range(1, len(piles) + 1)), lambda i: {{'want': piles[i], 'at': i, 'taken': []::BIGINT[]}}),
      lambda s, x: CASE WHEN x.want = s.want THEN {{'want': s.want - 1, 'at': s.at, 'taken': list_prepend(x.at, s.taken)}} ELSE s END,
      {{'want': list_max(piles), 'at': 0::BIGINT, 'taken': []::BIGINT[]}}).taken) AS nth FROM p{r}))"""


MATCHED = SENTS + WORDS + ASR + f""", mine AS MATERIALIZED ({_norms('words', 'word_idx')})
, theirs AS MATERIALIZED ({_norms('asr', 'asr_idx')})
, m0 AS MATERIALIZED (SELECT script_id, word_idx, word_idx AS asr_idx FROM words WHERE false)""" + "".join(
    _match_round(r, size, rule) for r, (size, rule) in enumerate(ROUNDS, 1)) + f", matches AS (SELECT * FROM m{len(ROUNDS)})"
ALIGNED = MATCHED + """, hitlines AS MATERIALIZED (
  SELECT w.script_id, w.word_idx, w.sent_idx, w.token, a.start_ms, a.end_ms, a.start_ms IS NOT NULL AS matched
  FROM words w LEFT JOIN matches m USING (script_id, word_idx) LEFT JOIN asr a USING (script_id, asr_idx))
, around AS MATERIALIZED (
  SELECT *, last_value(CASE WHEN matched THEN word_idx END IGNORE NULLS) OVER back AS lo,
    first_value(CASE WHEN matched THEN word_idx END IGNORE NULLS) OVER ahead AS hi,
    last_value(end_ms IGNORE NULLS) OVER back AS t0, first_value(start_ms IGNORE NULLS) OVER ahead AS t1,
    max(word_idx) OVER (PARTITION BY script_id) AS n
  FROM hitlines WINDOW back AS (PARTITION BY script_id ORDER BY word_idx ROWS UNBOUNDED PRECEDING),
    ahead AS (PARTITION BY script_id ORDER BY word_idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
, aligned AS MATERIALIZED (
  SELECT script_id, word_idx, sent_idx, token, matched,
    CASE WHEN matched THEN start_ms::DOUBLE ELSE round(s + (e - s) * (k / steps), 3) END AS start_ms,
    CASE WHEN matched THEN end_ms::DOUBLE ELSE round(s + (e - s) * ((k + 1) / steps), 3) END AS end_ms
  FROM (SELECT a.*, coalesce(t0, 0)::DOUBLE AS s, coalesce(t1, total)::DOUBLE AS e, (word_idx - coalesce(lo, 0))::DOUBLE AS k,
      greatest(coalesce(hi, CASE WHEN n = 0 THEN 1 ELSE n END) - coalesce(lo, 0), 1)::DOUBLE AS steps
    FROM around a JOIN (SELECT script_id, arg_max(end_ms, asr_idx) AS total FROM asr GROUP BY script_id) USING (script_id)
    WHERE lo IS NOT NULL OR hi IS NOT NULL))"""
TIMED_FOLD = """, bucketing AS (
  SELECT script_id, sent_idx, start_ms AS opened, 0::BIGINT AS scene_idx FROM spans WHERE sent_idx = 0
  UNION ALL
  SELECT s.script_id, s.sent_idx, CASE WHEN s.end_ms - b.opened > 4000 THEN s.start_ms ELSE b.opened END,
    b.scene_idx + CASE WHEN s.end_ms - b.opened > 4000 THEN 1 ELSE 0 END
  FROM bucketing b JOIN spans s ON s.script_id = b.script_id AND s.sent_idx = b.sent_idx + 1)
, timed_scenes AS MATERIALIZED (
  SELECT * REPLACE (coalesce(lead(start_ms) OVER (PARTITION BY script_id ORDER BY scene_idx), end_ms) AS end_ms) FROM (
    SELECT b.script_id, b.scene_idx, string_agg(t.text, ' ' ORDER BY b.sent_idx) AS text, arg_min(s.start_ms, b.sent_idx) AS start_ms,
      arg_max(s.end_ms, b.sent_idx) AS end_ms, count(*) AS n_sents
    FROM bucketing b JOIN spans s USING (script_id, sent_idx) JOIN sents t USING (script_id, sent_idx) GROUP BY b.script_id, b.scene_idx))"""
PRINTS = f""", prints AS MATERIALIZED (
  SELECT script_id, n_scenes, substr(sha256(text || '|' || n_scenes || '|' || {_quote(SETTINGS)} || '|kw=' || substr(sha256(ladders), 1, 12)), 1, 16) AS fingerprint
  FROM docs JOIN (SELECT script_id, count(*) AS n_scenes, string_agg(array_to_string(keywords, ','), '|' ORDER BY scene_idx) AS ladders
    FROM planned GROUP BY script_id) USING (script_id))
, completed AS MATERIALIZED (
  SELECT script_id, CASE WHEN quality = 1 THEN fingerprint ELSE substr(sha256(fingerprint), 1, 16) END AS fingerprint, scene_idx
  FROM scenes JOIN prints USING (script_id) JOIN labels ON doc_id = script_id)"""

_K = "array_to_string(keywords, '|')"
_THUMBS = """list_filter(list_concat([CASE WHEN k % 7 = 0 THEN '' ELSE 'img' || k END],
    CASE WHEN k % 5 = 0 THEN [] ELSE list_transform(list_distinct([(k % 5) // 2, k % 5 - 1]),
      lambda i: CASE WHEN (i + k) % 4 = 0 THEN '' ELSE 'pic-' || k || '-' || i END) END), lambda t: t <> '')"""
SRC_A = f"""parts AS (SELECT p_partkey AS k, p_name, p_size FROM part)
, a AS MATERIALIZED (
  SELECT 'A' AS source, k::VARCHAR AS video_id, kind || k AS url, width, height, p_size::DOUBLE AS duration_s,
    'https://clips.test/' || replace(p_name, ' ', '-') AS "desc", array_to_string(
      list_sort(list_filter({_THUMBS}, lambda t: starts_with(t, 'img'))) || list_sort(list_filter({_THUMBS}, lambda t: NOT starts_with(t, 'img'))), '|') AS thumbs
  FROM (SELECT * FROM (
      SELECT *, 'wide' AS kind, 2 AS pos, w AS width, CASE WHEN k % 10 = 9 THEN NULL ELSE w * 9 // 16 END AS height
      FROM (SELECT *, [1280, 1920, 2560, 3840][k % 4 + 1]::BIGINT AS w FROM parts)
      UNION ALL
      SELECT *, 0, 'small', 3, 960 + k % 3 * 640, CASE WHEN k % 10 >= 8 THEN 0 ELSE 540 END FROM parts)
    WHERE height > 0 AND width > height
    QUALIFY row_number() OVER (PARTITION BY k ORDER BY abs(width - 1920), pos) = 1))
"""
SRC_A = SRC_A.replace("SELECT *, 0, 'small', 3,", "SELECT *, 0::BIGINT, 'small', 3,")
SRC_B = """, b AS MATERIALIZED (
  SELECT 'B' AS source, k::VARCHAR AS video_id, kind || k AS url, width::BIGINT AS width, height::BIGINT AS height,
    p_size::DOUBLE AS duration_s, replace(p_name, ' ', ', ') AS "desc", 'thumb' || k AS thumbs
  FROM (SELECT *, CASE WHEN k % 3 <> 0 THEN 'large' ELSE 'medium' END AS kind, CASE WHEN k % 3 <> 0 THEN w ELSE 1280 END AS width,
      CASE WHEN k % 3 = 0 THEN 720 WHEN k % 5 = 0 THEN w * 2 ELSE w * 9 // 16 END AS height
    FROM (SELECT *, [1280, 1920, 2560, 3840][k % 4 + 1]::BIGINT AS w FROM parts))
  WHERE k % 11 <> 0 AND width > height)"""


def _with(ctes: str, body: str) -> str:
    return f"WITH RECURSIVE {ctes} {body}"


_PLAN = f"""SELECT script_id, scene_idx + 1 AS scene, round_even(start_ms / 1000.0::DOUBLE, 2) AS "start",
  round_even(end_ms / 1000.0::DOUBLE, 2) AS "end", text, {_K} AS keywords FROM planned"""

ORACLE: dict[str, str] = {
    "src1_script_scan": "SELECT doc_id AS script_id, length(text) AS n_chars, md5(text) AS text_md5 FROM documents",
    "src2_transcript_scan": _with(SENTS + WORDS, """SELECT script_id, row_number() OVER (PARTITION BY script_id ORDER BY word_idx) - 1 AS asr_idx,
      token, start_ms, end_ms FROM (SELECT *, (word_idx * 7919 + script_id) % 23 AS h FROM word_times) WHERE h NOT IN (3, 7)"""),
    "src3_catalog_a": _with(SRC_A, "SELECT * FROM a"),
    "src4_catalog_b": _with(SRC_A + SRC_B, "SELECT * FROM b"),
    "src5_catalog_union": _with(SRC_A + SRC_B, """SELECT source, width::INTEGER AS width, count(*) AS n_clips, sum(duration_s) AS seconds
      FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY ALL"""),
    "src6_plan_reader": _with(PLANNED, f"SELECT p.*, scene - 1 AS plan_pos FROM ({_PLAN}) p"),
    "snk1_plan_export": _with(PLANNED, _PLAN),
    "snk2_audit_report": _with(AUDIT, "SELECT * FROM audit"),
    "snk3_progress_sink": _with(PLANNED + PRINTS, """SELECT DISTINCT script_id, fingerprint, scene_idx, CASE WHEN scene_idx % 2 = 0 OR scene_idx % 3 = 0 THEN 'scene_' ELSE 'zz_' END || scene_idx AS output FROM completed"""),
    "p1_sentence_split": _with(DOCS + LEARNED, f"""SELECT script_id, i - 1 AS sent_idx, g[i] AS text, len({_tokens('g[i]')}) AS n_words
      FROM (SELECT script_id, g, unnest(range(1, len(g) + 1)) AS i FROM glued)"""),
    "p2_word_tokens": _with(SENTS + WORDS, "SELECT script_id, word_idx, sent_idx, token FROM words"),
    "p3_token_norm": _with(SENTS + WORDS, f"""SELECT token, n, {_norm('token')} AS norm,
      regexp_replace(lower(token), '[^\\p{{L}}\\p{{N}}_''-]', '', 'g') AS caption, regexp_replace(lower(token), '[^a-z]', '', 'g') AS letters
      FROM (SELECT token, count(*) AS n FROM words GROUP BY token)"""),
    "p4_first_keywords": _with(SCENES, f"""SELECT script_id, scene_idx, array_to_string(list_filter(k, lambda x, i: list_position(k, x) = i)[1:3], '|') AS keywords
      FROM (SELECT *, list_filter(list_transform({_tokens('lower(text)')}, lambda w: {_word('w')}),
        lambda w: length(w) > 2 AND NOT list_contains({_list(lx.KEYWORD_STOP)}, w)) AS k FROM scenes)"""),
    "p5_highlight_words": _with(PLANNED, f"""SELECT script_id, scene_idx,
      array_to_string(list_filter(h, lambda x, i: list_position(h, x) = i), '|') AS highlight,
      array_to_string(list_filter(w, lambda x, i: list_position(w, x) = i), '|') AS words
      FROM (SELECT *, list_filter(list_transform(w, lambda x: regexp_replace(x, '[^\\p{{L}}\\p{{N}}_''-]', '', 'g')),
        lambda x: length(x) >= 4 AND NOT list_contains({_list(lx.CAPTION_FILLER)}, x)) AS h
        FROM (SELECT *, {_tokens("lower(array_to_string(keywords, ' '))")} AS w FROM planned))"""),
    "p6_key_term": _with(SCENES + TERMS, "SELECT script_id, scene_idx, term FROM terms"),
    "p7_proper_noun": _with(SCENES, f"SELECT script_id, scene_idx, {_name('text')} AS name FROM scenes"),
    "p8_number_phrase": _with(SCENES, f"""SELECT script_id, scene_idx, phrase, coalesce(name, phrase) AS callout
      FROM (SELECT script_id, scene_idx, {_phrase('text')} AS phrase, {_name('text')} AS name FROM scenes)"""),
    "p9_technical_score": _with(CATALOG, """SELECT source, video_id, needed_s, round(
      CASE WHEN duration_s >= needed_s THEN 6.0 ELSE -4.0 * (needed_s - duration_s) END::DOUBLE
      + CASE WHEN width >= 1920 THEN 2.0 WHEN width >= 1280 THEN 1.0 ELSE 0.0 END::DOUBLE - abs(width - 1920) / 1920.0::DOUBLE, 6) AS score
      FROM clips, range(4, 13) t(needed_s)"""),
    "p10_relevance_floor": _with(CATALOG, "SELECT query, n, floor FROM (SELECT query, count(*) AS n FROM ladder GROUP BY query) JOIN queries USING (query)"),
    "p11_query_ladder": _with(CATALOG, """SELECT script_id, scene_idx, i AS step, queries[i + 1] AS query
      FROM (SELECT *, unnest(range(0, len(queries))) AS i FROM ladders)"""),
    "p12_provider_order": _with(CATALOG, "SELECT script_id, scene_idx, CASE WHEN scene_idx % 2 = 0 THEN 'A|B' ELSE 'B|A' END AS providers FROM requests"),
    "p13_shot_expansion": _with(SCENES, f"""SELECT script_id, scene_idx, shot_idx, n_shots, round((d + 250 * (n_shots - 1)) / n_shots, 3) AS shot_ms
      FROM (SELECT *, unnest(range(0, n_shots)) AS shot_idx FROM (SELECT script_id, scene_idx, (end_ms - start_ms)::DOUBLE AS d,
        least(3, greatest(1, ceil((end_ms - start_ms) / {MAX_SHOT_MS}.0)))::BIGINT AS n_shots FROM scenes))"""),
    "p14_term_start": _with(SCENES + WORDS + RELATIVE + TERMS, """SELECT t.script_id, t.scene_idx, t.term,
      CASE WHEN a.at_ms IS NULL THEN 400 ELSE greatest(200, least(a.at_ms, greatest(t.end_ms - t.start_ms - 1200, 200))) END::BIGINT AS term_ms
      FROM terms t LEFT JOIN (SELECT r.script_id, r.scene_idx, arg_min(r.start_ms, r.token_idx) AS at_ms FROM relative r
        JOIN terms t USING (script_id, scene_idx) WHERE t.term IS NOT NULL AND contains(regexp_replace(lower(r.token), '[^a-z]', '', 'g'), lower(t.term))
        GROUP BY ALL) a USING (script_id, scene_idx)"""),
    "p15_type_schedule": _with(SCENES + TERMS + TYPED, "SELECT * FROM typed"),
    "p16_card_eligible": _with(SCENES, f"SELECT script_id, scene_idx, n_words, {ELIGIBLE} AS eligible FROM scenes"),
    "p17_fingerprint": _with(PLANNED + PRINTS, "SELECT * FROM prints"),
    "j1_token_overlap": _with(CATALOG, "SELECT query, source, array_to_string(words, '|') AS words, rel FROM overlap"),
    "j1_answer_relevance": _with(CATALOG, f"""SELECT query, source, video_id, result_no,
      (3.0 * len(list_intersect(qw, words)) - CASE WHEN list_has_any(qw, {_list(fx.PERSONS)}) AND list_has_any(words, {_list(fx.ANIMALS)})
        AND NOT list_has_any(words, {_list(fx.PERSONS)}) THEN 8.0 ELSE 0.0 END)::DOUBLE AS rel FROM (
      SELECT l.query, c.*, row_number() OVER (PARTITION BY l.query, source ORDER BY source_rank) AS result_no
      FROM (SELECT DISTINCT query, source FROM ladder) l JOIN clips c USING (source) WHERE source_rank % 97 = length(l.query) % 97)
      JOIN queries USING (query)"""),
    "j2_class_conflict": _with(CATALOG, "SELECT query, source, count(*) AS n_sets, min(rel) AS lowest FROM overlap WHERE conflict GROUP BY ALL"),
    "j3_concept_tags": _with(SCENES + TAGS, "SELECT script_id, scene_idx, visual, anchor, second_visual FROM tags"),
    "j4_alternates": _with(SCENES + TAGS + ROTATED, 'SELECT script_id, scene_idx, visual, prim AS "primary" FROM rotated WHERE visual IS NOT NULL'),
    "j5_plan_override": _with(PLANNED, "SELECT script_id, scene_idx, array_to_string(list_reverse(keywords), '|') AS keywords FROM planned"),
    "j6_first_keyword_edit": _with(PLANNED, f"""SELECT script_id, scene_idx, CASE WHEN (script_id + scene_idx) % 5 = 0 AND (script_id + scene_idx) % 10 <> 0
      THEN array_to_string(list_prepend('edit ' || scene_idx, keywords[2:]), '|') ELSE {_K} END AS keywords FROM planned"""),
    "j7_shot_list": _with(SCENES, "SELECT script_id, scene_idx, 'shot ' || scene_idx || '|backup shot' AS keywords FROM scenes"),
    "j8_sentence_spans": _with(SENTS + WORDS + SPANS, "SELECT * FROM spans"),
    "j9_scene_word_times": _with(SCENES + WORDS + RELATIVE, "SELECT script_id, scene_idx, token_idx, start_ms, end_ms FROM relative"),
    "j10_alignment": _with(MATCHED, "SELECT script_id, word_idx, asr_idx FROM matches"),
    "j11_speech_to_wall": _with(WALLS, "SELECT rec_id, script_id, bound_idx, target_ms, wall_ms FROM walls"),
    "j12_nearest_pause": _with(WALLS, "SELECT rec_id, script_id, bound_idx, coalesce(len(mids), 0) AS n_near, mids[1] AS nearest_mid2 FROM near"),
    "j13_similarity": _with(CATALOG + SIMS, "SELECT * FROM sims"),
    "j14_pending_work": _with(PLANNED + PRINTS, """SELECT script_id, scene_idx, fingerprint FROM scenes JOIN prints USING (script_id)
      WHERE NOT EXISTS (SELECT 1 FROM completed c WHERE c.script_id = scenes.script_id AND c.fingerprint = prints.fingerprint AND c.scene_idx = scenes.scene_idx)"""),
    "j15_no_repeat": _with(CATALOG + WEAK + TEXT_PREFS + _assign("SELECT * FROM requests"), "SELECT * FROM picks"),
    "j16_cache_hits": _with(LOG[2:] + _spaced("log", "provider, query", "us", "event_id", str(fx.TTL_S * 1_000_000), ">"),
                            "SELECT provider, query, event_id, NOT kept AS hit FROM spaced"),
    "a1_dominant_topic": _with(DOCS + CONCEPTS + TOPICS, "SELECT * FROM topics"),
    "a2_match_histogram": _with(CATALOG + SIMS, """SELECT source, count(*) AS n_picks, count_if(s >= 0.24) AS n_strong,
      count_if(s >= 0.19 AND s < 0.24) AS n_ok, count_if(s < 0.19) AS n_weak
      FROM (SELECT source, round_even(coalesce(sim, -1.0), 3) AS s FROM sims) GROUP BY source"""),
    "a3_scene_totals": _with(SCENES, """SELECT script_id, count(*) AS n_scenes, sum(end_ms - start_ms)::BIGINT AS total_ms,
      round(sum(end_ms - start_ms) / 60000.0, 2) AS minutes FROM scenes GROUP BY script_id"""),
    "a4_speaking_pace": _with(SENTS + WORDS, """SELECT script_id, count(*) AS n_words,
      round(count(*) / greatest(max(end_ms) / 1000.0::DOUBLE, 1e-6), 6) AS pace FROM word_times GROUP BY script_id"""),
    "a5_mean_similarity": _with(CATALOG + SIMS, "SELECT query, count(sim) AS n_clips, round(avg(sim), 10) AS mean_sim FROM sims GROUP BY query"),
    "a6_speech_totals": _with(FRAMES, "SELECT * FROM totals"),
    "a7_threshold": _with(FRAMES, "SELECT rec_id, round(threshold_db, 6) AS threshold_db FROM thresholds"),
    "a8_frame_energy": _with(FRAMES, """SELECT rec_id, frame_no, round(r, 8) AS rms, round(20 * log10(r + 1e-12), 6) AS db FROM (
      SELECT rec_id, frame_no // 4 AS frame_no, sqrt(avg(rms * rms) + 1e-12) AS r FROM frames GROUP BY ALL HAVING count(*) = 4)"""),
    "a9_monthly_budget": _with(LOG[2:], f"""SELECT provider, month, event_id, request_no, request_no <= {fx.MONTH_LIMIT} AS allowed FROM (
      SELECT *, row_number() OVER (PARTITION BY provider, month ORDER BY us, event_id) AS request_no
      FROM (SELECT *, strftime(ts, '%Y-%m') AS month FROM log))"""),
    "a10_plan_counters": _with(SCENES + CARDS + CARD_TERMS, """SELECT script_id, count(term) AS n_terms,
      coalesce(array_to_string((list(upper(term) ORDER BY scene_idx) FILTER (term IS NOT NULL))[1:5], '|'), '') AS first_terms,
      coalesce(array_to_string(list(scene_idx + 1 ORDER BY scene_idx) FILTER (is_card), '|'), '') AS card_scenes
      FROM terms GROUP BY script_id"""),
    "a11_alignment_rate": _with(ALIGNED, """SELECT script_id, count_if(matched) AS n_matched, count(*) AS n_words,
      round(count_if(matched) / count(*), 6) AS rate FROM hitlines GROUP BY script_id"""),
    "w1_running_timeline": _with(SCENES, "SELECT script_id, scene_idx, start_ms, end_ms FROM scenes"),
    "w2_timeline_tiling": _with(SENTS + WORDS + SPANS, """SELECT script_id, sent_idx AS scene_idx, start_ms,
      coalesce(lead(start_ms) OVER (PARTITION BY script_id ORDER BY sent_idx), end_ms) AS end_ms FROM spans"""),
    "w3_topic_carry": _with(PLANNED, f"SELECT script_id, scene_idx, {_K} AS keywords FROM planned"),
    "w4_usage_rotation": _with(SCENES + TAGS + ROTATED, "SELECT script_id, scene_idx, visual, use_no FROM rotated WHERE visual IS NOT NULL"),
    "w5_silences": _with(FRAMES, "SELECT * FROM silences"),
    "w6_gap_filling": _with(ALIGNED, "SELECT script_id, word_idx, matched, start_ms, end_ms FROM aligned"),
    "w7_estimated_windows": _with(SCENES + CAPTION_TOKENS + ESTIMATED, """SELECT script_id, scene_idx, chunk_idx, word_idx,
      round(start_ms, 4) AS start_ms, round(end_ms, 4) AS end_ms FROM estimated"""),
    "w8_timed_windows": _with(SCENES + WORDS + RELATIVE + CAPTION_TOKENS + TIMED, "SELECT * FROM timed"),
    "w9_trailing_rate": _with(LOG[2:], f"""SELECT provider, event_id, in_window, in_window > {fx.RATE_MAX} AS throttled FROM (
      SELECT *, count(*) OVER (PARTITION BY provider ORDER BY us RANGE BETWEEN {fx.RATE_WINDOW_S * 1_000_000 - 1} PRECEDING AND CURRENT ROW)
        - count(*) OVER (PARTITION BY provider, us) + row_number() OVER (PARTITION BY provider, us ORDER BY event_id) AS in_window FROM log)"""),
    "w10_speech_before": _with(FRAMES, "SELECT * FROM speech"),
    "t1_first_scenes": _with(SCENES, "SELECT script_id, scene_idx, start_ms, end_ms FROM scenes WHERE scene_idx < 5"),
    "t2_top_candidates": _with(CATALOG, "SELECT query, source, needed_ms, cand_rank, video_id, rel, score FROM top"),
    "t3_first_and_best": _with(PLANNED, """SELECT script_id, arg_min(keywords[1], scene_idx) AS first_keyword,
      max(struct_pack(u := uses, v := visual)) FILTER (visual IS NOT NULL).v AS top_visual,
      arg_max(scene_idx, struct_pack(n := n_words, i := -scene_idx)) AS longest_scene
      FROM (SELECT *, count(*) OVER (PARTITION BY script_id, visual) AS uses FROM planned) GROUP BY script_id"""),
    "t4_tiered_pick": _with(CATALOG + SIMS + WEAK + SIM_PREFS, """SELECT script_id, scene_idx, coalesce(tier, 'none') AS tier, query, source, video_id, score
      FROM requests LEFT JOIN (SELECT * FROM choices
        QUALIFY row_number() OVER (PARTITION BY script_id, scene_idx ORDER BY kind, pref) = 1) USING (script_id, scene_idx)"""),
    "t5_cue_order": _with(EVENT_CUES[2:], """SELECT script_id, seq, row_number() OVER (PARTITION BY script_id ORDER BY at_ms, seq) - 1 AS cue_no FROM event_cues"""),
    "u1_cue_union": _with(SCENES + CARDS + CARD_TERMS + STYLES + TYPED + CUES, "SELECT script_id, kind, at_ms FROM cues"),
    "u2_ordered_distinct": _with(SCENES, f"""SELECT script_id, scene_idx, md5(array_to_string(d, ' ')) AS distinct_md5, len(d) AS n_distinct FROM (
      SELECT *, list_filter(n, lambda x, i: list_position(n, x) = i) AS d FROM (
        SELECT *, list_transform({_tokens('text')}, lambda w: {_norm('w')}) AS n FROM scenes))"""),
    "u3_unused_candidates": _with(CATALOG, """SELECT l.script_id, l.scene_idx, count(*) AS n_left, max(score) AS best
      FROM ladder l JOIN top t USING (query, source, needed_ms)
      WHERE NOT EXISTS (SELECT 1 FROM lineitem
        WHERE l_orderkey // 16 = l.script_id AND l_partkey::VARCHAR = t.video_id) GROUP BY ALL"""),
    "u4_shared_words": _with(CATALOG, """SELECT script_id, scene_idx, group_rank, array_to_string(list_filter(q.qw2,
      lambda w: list_contains(regexp_split_to_array(lower(text), '[^a-z]+'), w)), '|') AS shared
      FROM ladder JOIN (SELECT query, list_filter(qt, lambda w, i: list_position(qt, w) = i) AS qw2 FROM (
        SELECT query, list_filter(regexp_split_to_array(lower(query), '\\s+'), lambda w: length(w) > 2) AS qt FROM queries)) q USING (query)"""),
    "g1_scene_bucketing": _with(SCENES, "SELECT script_id, scene_idx, text, n_sents, n_words, start_ms, end_ms FROM scenes"),
    "g2_timed_bucketing": _with(SENTS + WORDS + SPANS + TIMED_FOLD, "SELECT script_id, scene_idx, text, start_ms, end_ms, n_sents FROM timed_scenes"),
    "g3_caption_chunks": _with(SCENES + CAPTION_TOKENS, """SELECT script_id, scene_idx, chunk_idx, min(token_idx) AS first_token,
      string_agg(word, ' ' ORDER BY token_idx) AS words FROM chunked GROUP BY ALL"""),
    "g4_card_spacing": _with(SCENES + CARDS, "SELECT * FROM cards"),
    "g5_cue_spacing": _with(EVENT_CUES[2:] + ", plain AS (SELECT * FROM event_cues WHERE kind IN ('impact', 'card', 'whoosh'))"
                            + _spaced("plain", "script_id", "at_ms", "seq", str(fx.CUE_GAP_MS), ">="),
                            f"""SELECT script_id, seq, kind, at_ms, {LEAD} AS start_ms FROM (
      SELECT script_id, seq, kind, at_ms FROM spaced WHERE kept UNION ALL SELECT * FROM event_cues WHERE kind = 'key')"""),
    "g6_labels": _with(SCENES + STYLES + MOTIONS, """SELECT m.script_id, m.scene_idx, m.motion, s.style FROM moving m
      LEFT JOIN styles s USING (script_id, scene_idx)"""),
    "g7_bound_clamp": _with(WALLS, "SELECT * FROM bounds"),
    "c1_script_plan": _with(PLANNED, _PLAN),
    "c2_transcript_plan": _with(ALIGNED + """, all_times AS MATERIALIZED (
      SELECT script_id, word_idx, sent_idx, matched, start_ms, end_ms, 'words' AS timing FROM aligned
      UNION ALL SELECT script_id, word_idx, sent_idx, false, word_idx * 400.0::DOUBLE, (word_idx + 1) * 400.0::DOUBLE, 'pace'
      FROM words WHERE script_id NOT IN (SELECT script_id FROM aligned))""" + SPANS.replace("word_times", "all_times") + TIMED_FOLD,
      """SELECT t.script_id, scene_idx, text, round(t.start_ms, 3) AS start_ms, round(t.end_ms, 3) AS end_ms, pace, rate, timing
      FROM timed_scenes t JOIN (SELECT script_id, round(count(*) / greatest(arg_max(end_ms, word_idx) / 1000.0::DOUBLE, 1e-6), 6) AS pace,
        round(count_if(matched) / count(*), 6) AS rate, any_value(timing) AS timing FROM all_times GROUP BY script_id) USING (script_id)"""),
    "c3_clip_audit": _with(AUDIT, """SELECT script_id, count(*) AS n_picks, count_if(sim >= 0.24) AS n_strong,
      count_if(sim >= 0.19 AND sim < 0.24) AS n_ok, count_if(sim < 0.19) AS n_weak FROM audit GROUP BY script_id"""),
    "c4_cue_schedule": _with(SCENES + CARDS + CARD_TERMS + STYLES + TYPED + CUES
                             + ", plain AS (SELECT * FROM cues WHERE kind <> 'key')"
                             + _spaced("plain", "script_id", "at_ms", "seq", "1200", ">="),
                             f"""SELECT script_id, kind, at_ms, {LEAD} AS start_ms FROM (
      SELECT script_id, kind, at_ms FROM spaced WHERE kept UNION ALL SELECT script_id, kind, at_ms FROM cues WHERE kind = 'key')"""),
    "c4_caption_schedule": _with(SCENES + WORDS + RELATIVE + CAPTION_TOKENS + TIMED,
                                 "SELECT * REPLACE (start_ms::DOUBLE AS start_ms, end_ms::DOUBLE AS end_ms) FROM timed"),
    "c5_pause_timing": _with(WALLS, """SELECT s.rec_id, s.script_id, s.sent_idx, coalesce(lag(bound_us) OVER w, 0) AS start_us,
      coalesce(bound_us, duration_ms * 1000) AS end_us FROM read_out s JOIN recs USING (rec_id)
      LEFT JOIN bounds b ON b.script_id = s.script_id AND b.bound_idx = s.sent_idx
      WINDOW w AS (PARTITION BY s.script_id ORDER BY s.sent_idx)"""),
    "c6_request_report": _with(LOG[2:] + _spaced("log", "provider, query", "us", "event_id", str(fx.TTL_S * 1_000_000), ">"), f"""
      SELECT * FROM (SELECT provider, count(*) AS requests, max(n) AS peak, count_if(n > {fx.RATE_MAX}) AS throttled FROM (
        SELECT *, count(*) OVER (PARTITION BY provider ORDER BY us RANGE BETWEEN {fx.RATE_WINDOW_S * 1_000_000 - 1} PRECEDING AND CURRENT ROW)
          - count(*) OVER (PARTITION BY provider, us) + row_number() OVER (PARTITION BY provider, us ORDER BY event_id) AS n FROM log)
        GROUP BY provider)
      JOIN (SELECT provider, sum(greatest(n - {fx.MONTH_LIMIT}, 0))::BIGINT AS refused FROM (
        SELECT provider, strftime(ts, '%Y-%m') AS month, count(*) AS n FROM log GROUP BY ALL) GROUP BY provider) USING (provider)
      JOIN (SELECT provider, count_if(NOT kept) AS hits, count_if(kept) AS misses FROM spaced GROUP BY provider) USING (provider)"""),
    "st1_request_rate": f"""SELECT provider, w AS window_start_s, count(*) AS n, count(*) > {fx.RATE_MAX} AS alert FROM (
      SELECT event_type AS provider, epoch_us(ts) AS us, unnest([epoch_us(ts) // 1800000000 * 1800 - 1800, epoch_us(ts) // 1800000000 * 1800]) AS w FROM events) GROUP BY ALL""",
    "st3_ttl_suppression": _with(
        "items AS MATERIALIZED (SELECT event_type || '|' || user_id AS stream_key, epoch_us(ts) AS us, epoch_us(ts) // 1000 AS at_ms, event_id AS seq FROM events)"
        + _spaced("items", "stream_key", "us", "seq", str(fx.TTL_S * 1_000_000), ">"),
        "SELECT stream_key, at_ms, seq, kept FROM spaced"),
    "st4_cool_down": _with(
        """items AS MATERIALIZED (SELECT user_id::VARCHAR AS stream_key, epoch_us(ts) // 1000 AS at_ms, event_id AS seq
          FROM events WHERE event_type IN ('click', 'signup', 'purchase'))"""
        + _spaced("items", "stream_key", "at_ms", "seq", str(fx.CUE_GAP_MS), ">="),
        """SELECT stream_key, at_ms, seq, kept FROM spaced UNION ALL
      SELECT user_id::VARCHAR, epoch_us(ts) // 1000, event_id, true FROM events WHERE event_type = 'view'"""),
    "st5_incremental_plan": _with(PLANNED, _PLAN),
    "st6_silence_sessions": _with(FRAMES, """, quiet AS (SELECT rec_id, epoch_us(ts) AS us FROM events JOIN thresholds ON rec_id = user_id
        WHERE round(20 * log10(value / 500.0 + 1e-12), 9) < threshold_db)
      , marked AS (SELECT *, sum(CASE WHEN us - prev < 21600000000 THEN 0 ELSE 1 END) OVER (PARTITION BY rec_id ORDER BY us) AS session
        FROM (SELECT *, lag(us) OVER (PARTITION BY rec_id ORDER BY us) AS prev FROM quiet))
      SELECT rec_id, count(*) AS n_frames, min(us) AS first_us, max(us) AS last_us FROM marked GROUP BY rec_id, session
      HAVING count(*) >= 2"""),
    "st2_budget_count": "SELECT event_type AS provider, strftime(ts, '%Y-%m') AS month, count(*) AS n FROM events GROUP BY ALL",
}
for _stream, _batch in (("st1_trailing_rate", "w9_trailing_rate"), ("st2_admission", "a9_monthly_budget"), ("st6_silence_runs", "w5_silences")):
    ORACLE[_stream] = ORACLE[_batch]
