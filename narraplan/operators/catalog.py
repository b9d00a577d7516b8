"""Clip search and selection: query ladders, token overlap, scores, tiers, no repeats.

Scenes repeat their queries heavily, so every expensive step runs on distinct values:
overlap on distinct queries against distinct token sets, scores on distinct
(query, needed length), similarity on distinct (query, clip), preference lists on distinct
scene signatures.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import lexicon as lx
from ..functions import text as tx
from .ordered import cut_lineage, ordered_scan

CLIP = ["source", "video_id", "width", "duration_s", "desc", "source_rank"]


# -- projections ---------------------------------------------------------------


def query_words(query: Column) -> Column:
    return F.array_distinct(F.filter(tx.tokens(F.lower(query)), lambda w: F.length(w) > 2))


def desc_words(desc: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(desc), "[^a-z]+"), lambda w: F.length(w) > 2))


def technical_score(width: Column, duration_s: Column, needed_s: Column) -> Column:
    """Long enough, then HD, then near the target width."""
    length = F.when(duration_s >= needed_s, F.lit(6.0)).otherwise(F.lit(-4.0) * (needed_s - duration_s))
    size = F.when(width >= 1920, F.lit(2.0)).when(width >= 1280, F.lit(1.0)).otherwise(F.lit(0.0))
    return length + size - F.abs(width - F.lit(lx.TARGET_WIDTH)) / F.lit(1920.0)


def relevance_floor(query: Column, filler: Sequence[str] = lx.QUERY_FILLER) -> Column:
    """3 for queries with two content words, 0 for shorter ones."""
    content = F.filter(
        tx.tokens(F.lower(query)), lambda w: (F.length(w) > 2) & ~w.isin(list(filler))
    )
    return F.when(F.size(content) >= 2, F.lit(3.0)).otherwise(F.lit(0.0))


def query_ladder(keywords: Column) -> Column:
    """Phrases are searched as they are; single words as all joined, first two, first."""
    phrases = F.exists(keywords, lambda k: F.contains(k, F.lit(" ")))
    words = F.array(
        F.array_join(keywords, " "), F.array_join(F.slice(keywords, 1, 2), " "),
        F.coalesce(F.try_element_at(keywords, F.lit(1)), F.lit("")),
    )
    return F.array_distinct(
        F.filter(F.when(phrases, keywords).otherwise(words), lambda q: q.isNotNull() & (q != ""))
    )


def provider_order(scene_idx: Column) -> Column:
    """Providers in the order a scene tries them; scenes alternate."""
    a, b = F.lit("A"), F.lit("B")
    return F.when(F.pmod(scene_idx, F.lit(2)) == 0, F.array(a, b)).otherwise(F.array(b, a))


def ladder_rows(scenes: DataFrame) -> DataFrame:
    """One row per (scene, query, provider) with group_rank, the order of trial."""
    ladder = scenes.select("*", F.posexplode(query_ladder(F.col("keywords"))).alias("_q", "query"))
    tried = ladder.select("*", F.posexplode(provider_order(F.col("scene_idx"))).alias("_p", "source"))
    return tried.withColumn("group_rank", (F.col("_q") * 2 + F.col("_p")).cast("bigint")).drop("_q", "_p")


# -- token overlap ---------------------------------------------------------------


def token_overlap(queries: DataFrame, catalog: DataFrame,
                  person: Sequence[str] = lx.PERSON_WORDS,
                  animal: Sequence[str] = lx.ANIMAL_WORDS) -> DataFrame:
    """(query, source, words, rel, conflict) for distinct queries and distinct clip token sets.

    rel is 3 per shared token, less 8 when the query names a person and the clip only an
    animal (conflict). An equi join on the token; pairs without a shared token have rel 0 and are not
    made. Partial counts fold before the shuffle.
    """
    persons, animals = tx.word_array(person), tx.word_array(animal)
    q = (
        queries.select("query").distinct()
        .withColumn("_qw", query_words(F.col("query")))
        .withColumn("_asks", F.arrays_overlap("_qw", persons))
    )
    d = (
        catalog.select("source", F.array_sort(desc_words(F.col("desc"))).alias("words")).distinct()
        .withColumn("_clash", F.arrays_overlap("words", animals) & ~F.arrays_overlap("words", persons))
    )
    shared = q.select("query", "_asks", F.explode("_qw").alias("token")).join(
        d.select("source", "words", "_clash", F.explode("words").alias("token")), "token"
    )
    penalty = F.when(F.col("_asks") & F.col("_clash"), F.lit(8.0)).otherwise(F.lit(0.0))
    return (
        shared.groupBy("query", "source", "words", "_asks", "_clash")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select("query", "source", "words", (F.lit(3.0) * F.col("_n") - penalty).alias("rel"),
                (F.col("_asks") & F.col("_clash")).alias("conflict"))
    )


def answer_results(answers: DataFrame, person: Sequence[str] = lx.PERSON_WORDS,
                   animal: Sequence[str] = lx.ANIMAL_WORDS) -> DataFrame:
    """Add rel to what providers answered: (query, source, video_id, width, duration_s, desc, result_no).

    The same relevance as ``token_overlap``, in the row and without a join, so answers that
    share no word with their query keep rel 0 (or the penalty) and pass a floor of 0.
    """
    persons, animals = tx.word_array(person), tx.word_array(animal)
    asked, words = query_words(F.col("query")), desc_words(F.col("desc"))
    clash = F.arrays_overlap(asked, persons) & F.arrays_overlap(words, animals) & ~F.arrays_overlap(words, persons)
    shared = F.size(F.array_intersect(asked, words))
    return answers.withColumn("rel", F.lit(3.0) * shared - F.when(clash, F.lit(8.0)).otherwise(F.lit(0.0)))


#: Clips of every inverted list that a search looks at first, at least.
LIST_HEAD = 256


def _clip_sets(catalog: DataFrame, persons: Column, animals: Column) -> DataFrame:
    """(source, words, clash, set_rank) per distinct token set; its best clip's rank names it within its source."""
    words = F.array_sort(desc_words(F.col("desc"))).alias("words")
    sets = catalog.select("source", words, "source_rank").groupBy("source", "words").agg(
        F.min("source_rank").alias("set_rank"))
    return sets.withColumn("clash", F.arrays_overlap("words", animals) & ~F.arrays_overlap("words", persons))


def best_overlaps(queries: DataFrame, catalog: DataFrame, k: int, head: int | None = None,
                  person: Sequence[str] = lx.PERSON_WORDS,
                  animal: Sequence[str] = lx.ANIMAL_WORDS) -> DataFrame:
    """(query, source, set_rank, rel, conflict): the k best token sets of a source by rel, then rank.

    What ``token_overlap`` would rank first, without its pairs. A token's inverted list is in
    rank order. First every query meets the ``head`` first entries of its tokens' lists. A
    set not met there is behind the head in every list that has it, so it can have no more
    words in common than the query has longer lists; where the k-th best found is not below
    that, the query is done. Else a set that could still enter needs some number of common
    words, so it is in one of the rarest longer lists, all but that number less one, and
    only these are read whole. Sets that conflict with a query that names a person are searched
    apart, as they rank by another scale. Lists are cut before their shuffle.
    """
    persons, animals = tx.word_array(person), tx.word_array(animal)
    head = max(head or LIST_HEAD, k)
    lists = _clip_sets(catalog, persons, animals).withColumn("token", F.explode("words"))
    key = ["source", "clash", "token"]
    in_order = Window.partitionBy(*key).orderBy("set_rank")
    heads = lists.withColumn("_pos", F.row_number().over(in_order)).where(F.col("_pos") <= head)
    ends = lists.groupBy(*key).agg(F.count(F.lit(1)).alias("_df")).join(
        heads.groupBy(*key).agg(F.max("set_rank").alias("_end")), key)
    asked = queries.select("query").distinct().withColumn("_qw", query_words(F.col("query")))
    terms = asked.select("query", "_qw", F.explode("_qw").alias("token")).join(ends, "token")
    search_of = ["query", "source", "clash"]
    shared = F.size(F.array_intersect("_qw", "words")).alias("_n")
    best = Window.partitionBy(*search_of).orderBy(F.col("_n").desc(), "set_rank")

    def first_k(found: DataFrame) -> DataFrame:
        met = found.groupBy(*search_of, "set_rank").agg(F.first("_n").alias("_n"))
        return met.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= k)

    met = first_k(terms.join(heads.select(*key, "set_rank", "words"), key).select(*search_of, "set_rank", shared))
    last = met.groupBy(*search_of).agg(F.max_by(F.struct("_n", "set_rank"), "_r").alias("_last"), F.count(F.lit(1)).alias("_found"))
    # lists that go on behind the head, rarest first; a list's place by where its head ends tells from which rank on
    # a set can have how many words
    longer = terms.where(F.col("_df") > head).withColumns({
        "_rarity": F.row_number().over(Window.partitionBy(*search_of).orderBy("_df", "token")),
        "_open": F.count(F.lit(1)).over(Window.partitionBy(*search_of)),
        "_ends": F.array_sort(F.collect_list("_end").over(Window.partitionBy(*search_of))),
    }).join(last, search_of)
    n = F.col("_last._n")
    ties = (F.col("_open") >= n) & (F.try_element_at("_ends", n) < F.col("_last.set_rank"))
    need = F.when(F.col("_found") < k, F.lit(1)).when(ties, n).otherwise(n + 1)
    left = longer.withColumn("_need", need).where(
        (F.col("_need") <= F.col("_open")) & (F.col("_rarity") <= F.col("_open") - F.col("_need") + 1))
    more = left.join(lists.select(*key, "set_rank", "words"), key).select(*search_of, "set_rank", shared, "_need").where(
        F.col("_n") >= F.col("_need")).drop("_need")
    found = first_k(met.drop("_r").unionByName(more))
    conflict = F.arrays_overlap(query_words(F.col("query")), persons) & F.col("clash")
    rated = found.withColumn("conflict", conflict).withColumn(
        "rel", F.lit(3.0) * F.col("_n") - F.when(F.col("conflict"), F.lit(8.0)).otherwise(F.lit(0.0)))
    both = Window.partitionBy("query", "source").orderBy(F.col("rel").desc(), "set_rank")
    return rated.withColumn("_r", F.row_number().over(both)).where(F.col("_r") <= k).select(
        "query", "source", "set_rank", "rel", "conflict")


def search(queries: DataFrame, catalog: DataFrame, per_query: int | None = lx.RESULTS_PER_QUERY,
           **classes) -> DataFrame:
    """A provider's answer: the ``per_query`` best clips of a source by overlap, then rank; None keeps all.

    The best clips are among those of the ``per_query`` best token sets, and of each set its
    own best-ranked ones; see ``best_overlaps``. With None all pairs are made.
    """
    keyed = catalog.select(*CLIP, F.array_sort(desc_words(F.col("desc"))).alias("words"))
    best = Window.partitionBy("query", "source").orderBy(F.col("rel").desc(), "source_rank")
    number = F.row_number().over(best).cast("bigint")
    if per_query is None:
        overlap = token_overlap(queries, catalog, **classes)
        return overlap.join(keyed, ["source", "words"]).drop("words").withColumn("result_no", number)
    same = Window.partitionBy("source", "words").orderBy("source_rank")
    heads = keyed.withColumn("set_rank", F.min("source_rank").over(same)).withColumn(
        "_r", F.row_number().over(same)).where(F.col("_r") <= per_query).drop("_r", "words")
    found = best_overlaps(queries, catalog, per_query, **classes).join(heads, ["source", "set_rank"]).drop("set_rank")
    return found.withColumn("result_no", number).where(F.col("result_no") <= per_query)


def score_results(requests: DataFrame, results: DataFrame) -> DataFrame:
    """Every search result scored for every distinct (query, source, needed_ms) request."""
    needed = requests.select("query", "source", "needed_ms").distinct()
    return needed.join(results, ["query", "source"]).withColumn(
        "score",
        F.round(
            technical_score(F.col("width"), F.col("duration_s"), F.col("needed_ms") / 1000.0)
            + F.col("rel"), 6),
    )


def top_candidates(scored: DataFrame, k: int | None = lx.TOP_CANDIDATES) -> DataFrame:
    """The k best (None: all) passing results per (query, source, needed_ms); ties keep source order."""
    w = Window.partitionBy("query", "source", "needed_ms").orderBy(F.col("score").desc(), "result_no")
    ranked = scored.where(F.col("rel") >= relevance_floor(F.col("query"))).withColumn(
        "cand_rank", F.row_number().over(w).cast("bigint"))
    return ranked if k is None else ranked.where(F.col("cand_rank") <= k)


def without_used(candidates: DataFrame, used: DataFrame) -> DataFrame:
    """Candidates whose clip (script_id, source, video_id) is not used yet.

    A script's used clips are one set, so candidates meet it by their script alone, wherever that has them already.
    """
    clip = F.struct("source", "video_id")
    taken = used.where(F.col("source").isNotNull() & F.col("video_id").isNotNull()).groupBy("script_id").agg(
        F.collect_set(clip).alias("_used"))
    return candidates.join(taken, "script_id", "left").where(
        F.col("_used").isNull() | ~F.array_contains("_used", clip)).drop("_used")


# -- similarity ------------------------------------------------------------------


def _rows_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Components of a list column end to end in doubles, each row's start and its length, -1 where it is null."""
    length = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.list_flatten(column).cast(pa.float64()).to_numpy(zero_copy_only=False)
    start = np.append(0, np.cumsum(np.maximum(length, 0)))
    return flat, start[:-1], length


def _cosines(one: pa.Array, other: pa.Array) -> pa.Array:
    """Cosine of each row's two vectors, a batch as one product; null for null, empty, zero or unequal ones."""
    (a, a_at, a_n), (b, b_at, b_n) = _rows_of(one), _rows_of(other)
    good = np.flatnonzero((a_n == b_n) & (a_n > 0))
    out = np.full(len(a_n), np.nan)
    if len(good):
        size = a_n[good]
        start = np.append(0, np.cumsum(size))[:-1]
        inner = np.arange(size.sum()) - np.repeat(start, size)
        x, y = a[np.repeat(a_at[good], size) + inner], b[np.repeat(b_at[good], size) + inner]
        dot, xx, yy = (np.add.reduceat(v, start) for v in (x * y, x * x, y * y))
        with np.errstate(divide="ignore", invalid="ignore"):
            out[good] = dot / (np.sqrt(xx) * np.sqrt(yy))
    return pa.array(out, mask=~np.isfinite(out))


def frame_similarity(pairs: DataFrame, query_emb: DataFrame, frame_emb: DataFrame) -> DataFrame:
    """Mean cosine over a clip's frames for (query, source, video_id) pairs; null if no frame.

    Vectors go to numpy in Arrow batches in their own type; a batch of pairs is one product.
    """
    q = query_emb.select("query", F.col("embedding").alias("_qv"))
    f = frame_emb.select("source", "video_id", F.col("embedding").alias("_fv"))
    cosine = F.arrow_udf(_cosines, "double")("_qv", "_fv")
    wanted = pairs.select("query", "source", "video_id").distinct()
    return (
        wanted.join(q, "query", "left").join(f, ["source", "video_id"], "left")
        .select("query", "source", "video_id", cosine.alias("_cos"))
        .groupBy("query", "source", "video_id")
        .agg(F.round(F.avg("_cos"), 4).alias("sim"))
    )


# -- picks -----------------------------------------------------------------------


def signed(scenes: DataFrame) -> DataFrame:
    """Add sig: scenes with equal keywords, provider order and needed length share it.

    Everything a scene's choices depend on is in its signature, so choices are made once
    per signature, however many scenes carry it.
    """
    parity = F.pmod(F.col("scene_idx"), F.lit(2))
    return scenes.withColumn(
        "sig", F.concat_ws("\u0001", "keywords", parity.cast("string"), F.col("needed_ms").cast("string")))


def signatures(scenes: DataFrame) -> DataFrame:
    """Distinct (sig, keywords, scene_idx, needed_ms); scene_idx stands for its parity."""
    return signed(scenes).select(
        "sig", "keywords", F.pmod(F.col("scene_idx"), F.lit(2)).alias("scene_idx"), "needed_ms"
    ).distinct()


def similarity_preferences(candidates: DataFrame, keys: Sequence[str] = ("sig",)) -> DataFrame:
    """Order the top candidates of ``keys`` by what their frames show; adds tier and pref.

    strong: the best of the first group that has a strong match; ok: the best seen anywhere
    above the minimum; low: the best of the rest. Candidates without a frame are skipped.
    """
    tier = (
        F.when(F.col("sim") >= lx.STRONG_SIMILARITY, F.lit(0))
        .when(F.col("sim") >= lx.MIN_SIMILARITY, F.lit(1)).otherwise(F.lit(2))
    )
    group = F.when(F.col("_tier") == 0, F.col("group_rank")).otherwise(F.lit(-1))
    w = Window.partitionBy(*keys).orderBy(
        "_tier", group, F.col("sim").desc(), "group_rank", "cand_rank"
    )
    return (
        candidates.where(F.col("sim").isNotNull())
        .withColumn("_tier", tier)
        .withColumn("pref", F.row_number().over(w).cast("bigint"))
        .withColumn("tier", F.element_at(
            F.array(F.lit("strong"), F.lit("ok"), F.lit("low")), F.col("_tier") + 1))
        .drop("_tier")
    )


def text_preferences(candidates: DataFrame, keys: Sequence[str] = ("sig",)) -> DataFrame:
    """Order passing candidates without similarity: first group, then score."""
    w = Window.partitionBy(*keys).orderBy("group_rank", "cand_rank")
    return candidates.withColumn("pref", F.row_number().over(w).cast("bigint")).withColumn(
        "tier", F.lit("text")
    )


def weak_preferences(weak: DataFrame, keys: Sequence[str] = ("sig",)) -> DataFrame:
    """Order results below the floor: by score over all groups, earliest on ties."""
    w = Window.partitionBy(*keys).orderBy(F.col("score").desc(), "group_rank", "result_no")
    return weak.withColumn("pref", F.row_number().over(w).cast("bigint"))


def best_pick(choices: DataFrame, scenes: DataFrame) -> DataFrame:
    """The first choice of every scene, repeats allowed: a passing clip before a weak one.

    A scene without any choice stays, with tier 'none'.
    """
    w = Window.partitionBy("sig").orderBy("kind", "pref")
    first = choices.withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1)
    return signed(scenes).select("script_id", "scene_idx", "sig").join(
        first.select("sig", "tier", "query", "source", "video_id", "score"), "sig", "left"
    ).drop("sig").withColumn("tier", F.coalesce("tier", F.lit("none")))


def assign_unrepeated(choices: DataFrame, scenes: DataFrame, shots: DataFrame,
                      seeded: DataFrame | None = None) -> DataFrame:
    """Give each shot, in scene order, its best clip not yet used in the script.

    ``choices`` holds, per signature, kind 0 (passes the floor) and kind 1 (below it; serves
    only signatures without kind 0) in order of pref. A scene whose passing clips are all
    taken repeats the best-scored one (tier 'used'); one that found nothing, or whose weak clips
    are all taken, has shots without a clip (tier 'none'). ``seeded`` lists clips (script_id,
    source, video_id) that earlier runs used.

    A signature has at most queries x providers x results choices. A scene reads only as many
    of them as its script can have used before it, which cannot change a pick.
    """
    facts = ["clip", "score", "query", "tier", "sim"]
    named = choices.withColumn("clip", F.concat_ws(":", "source", "video_id"))
    per_clip = (
        named.repartition("sig").groupBy("sig", "kind", "clip")
        # of a clip found by several queries the first counts, for repeats the best-scored
        .agg(F.min(F.struct("pref", *[c for c in facts if c != "clip"], "clip")).alias("_o"),
             F.max(F.struct("score", (-F.col("pref")).alias("order"), F.struct(*facts).alias("option"))).alias("_b"))
    )
    passing = F.array_sort(F.collect_list(F.when(F.col("kind") == 0, F.col("_o"))))
    weak = F.array_sort(F.collect_list(F.when(F.col("kind") == 1, F.col("_o"))))
    per_sig = per_clip.groupBy("sig").agg(
        passing.alias("_passing"), weak.alias("_weak"),
        F.max(F.when(F.col("kind") == 0, F.col("_b")))["option"].alias("_again"),
    ).select(
        "sig", "_again",
        F.when(F.size("_passing") > 0, F.col("_passing")).otherwise(F.col("_weak")).alias("_options"),
    )
    per_sig = cut_lineage(per_sig)  # read for the scan and for its picks
    script = Window.partitionBy("script_id")
    counts = (
        shots.groupBy("script_id", "scene_idx").agg(F.count(F.lit(1)).alias("n_shots"))
        .withColumn("_limit", F.sum("n_shots").over(script))
    )
    if seeded is not None:
        used = seeded.groupBy("script_id").agg(
            F.collect_set(F.concat_ws(":", "source", "video_id")).alias("_seed"))
        counts = counts.join(used, "script_id", "left")
    else:
        counts = counts.withColumn("_seed", F.lit(None).cast("array<string>"))
    seeds = F.coalesce(F.size("_seed"), F.lit(0))
    seeds = F.when(F.col("_seed").isNull(), F.lit(0)).otherwise(seeds)
    first = Window.partitionBy("script_id").orderBy("scene_idx")
    work = (
        counts.withColumn("_reach", (F.col("_limit") + seeds).cast("int"))
        .withColumn("_seed", F.when(F.row_number().over(first) == 1, F.col("_seed")))
        .join(signed(scenes).select("script_id", "scene_idx", "sig"), ["script_id", "scene_idx"])
        .join(per_sig, "sig", "left")
        .select("script_id", "scene_idx", "sig", "n_shots", "_seed", F.col("_again").isNotNull().alias("_repeats"),
                F.slice(F.transform(F.coalesce("_options", F.array()), lambda o: o["clip"]), F.lit(1), F.col("_reach")).alias("_clips"))
    )
    adds = T.StructType([T.StructField("_picks", T.ArrayType(T.IntegerType()))])

    def step(used, clips, n_shots, repeats, seed):
        """Picks as 1-based positions in the options, 0 for the repeated clip, -1 for none."""
        used = set() if used is None else used
        used.update(seed or ())
        made = []
        for _ in range(n_shots):
            at = next((i for i, c in enumerate(clips) if c not in used), None)
            if at is not None:
                used.add(clips[at])
                made.append(at + 1)
            else:
                made.append(0 if repeats else -1)
        return used, (made,)

    picked = ordered_scan(
        work, ["script_id"], ["scene_idx"], ["_clips", "n_shots", "_repeats", "_seed"], adds, step,
        keeps=["script_id", "scene_idx", "sig"],
    )
    # only picks, not options, travel with the scenes; what they stand for is joined by signature and place
    options = per_sig.select("sig", F.posexplode("_options").alias("_p", "_x")).select(
        "sig", (F.col("_p") + 1).alias("_at"), F.struct(*[F.col(f"_x.{c}").alias(c) for c in facts]).alias("_o"))
    repeats = per_sig.where("_again is not null").select("sig", F.lit(0).alias("_at"), F.col("_again").alias("_o"))
    return (
        picked.select("script_id", "scene_idx", "sig", F.posexplode("_picks").alias("shot_idx", "_at"))
        .join(options.unionByName(repeats), ["sig", "_at"], "left")
        .select(
            "script_id",
            "scene_idx",
            F.col("shot_idx").cast("bigint").alias("shot_idx"),
            F.col("_o.query").alias("query"),
            F.substring_index("_o.clip", ":", 1).alias("source"),
            F.expr("substring(_o.clip, instr(_o.clip, ':') + 1)").alias("video_id"),
            F.when(F.col("_at") == 0, "used").when(F.col("_at") < 0, "none").otherwise(F.col("_o.tier")).alias("tier"),
            F.col("_o.sim").alias("sim"),
        )
    )


def assign_by_similarity(passing: DataFrame, weak: DataFrame, scenes: DataFrame, shots: DataFrame,
                         seeded: DataFrame | None = None, k: int = lx.TOP_CANDIDATES) -> DataFrame:
    """Give each shot, in scene order, what its frames show best among clips not yet used in the script.

    Of each group (query and provider, in order of trial) the ``k`` best-ranked unused clips are looked at,
    so further ones move up as clips are used. The first group with a strong match ends the search
    (tier 'strong'); else the best seen anywhere is taken ('ok', or 'low' below the minimum); else the
    best-scored used clip, without a similarity ('used'); else the best unused one below the floor ('weak');
    else none. Clips without a frame are looked at and passed over.

    ``passing``: (sig, group_rank, query, source, video_id, score, cand_rank, sim); ``weak``: (sig, query, source,
    video_id, score, pref). A signature has at most queries x providers x results of them. ``seeded`` as in
    ``assign_unrepeated``.
    """
    clip = F.concat_ws(":", "source", "video_id").alias("clip")
    options = passing.groupBy("sig").agg(F.array_sort(F.collect_list(
        F.struct("group_rank", "cand_rank", clip, "score", "query", "sim"))).alias("_passing"))
    below = weak.groupBy("sig").agg(F.array_sort(F.collect_list(F.struct("pref", clip, "query"))).alias("_weak"))
    per_sig = cut_lineage(options.join(below, "sig", "full"))  # read for the scan and for its picks
    script = Window.partitionBy("script_id")
    counts = shots.groupBy("script_id", "scene_idx").agg(F.count(F.lit(1)).alias("n_shots")).withColumn(
        "_reach", F.sum("n_shots").over(script))
    if seeded is not None:
        used = seeded.groupBy("script_id").agg(F.collect_set(clip).alias("_seed"))
        counts = counts.join(used, "script_id", "left")
    else:
        counts = counts.withColumn("_seed", F.lit(None).cast("array<string>"))
    seeds = F.when(F.col("_seed").isNull(), F.lit(0)).otherwise(F.size("_seed"))
    empty = F.array()
    work = (
        counts.withColumn("_reach", (F.col("_reach") + seeds).cast("int"))
        .withColumn("_seed", F.when(F.row_number().over(script.orderBy("scene_idx")) == 1, F.col("_seed")))
        .join(signed(scenes).select("script_id", "scene_idx", "sig"), ["script_id", "scene_idx"])
        .join(per_sig, "sig", "left")
        .select("script_id", "scene_idx", "sig", "n_shots", "_seed", F.coalesce("_passing", empty).alias("_passing"),
                F.slice(F.coalesce("_weak", empty), F.lit(1), F.col("_reach")).alias("_weak"))
        .select("script_id", "scene_idx", "sig", "n_shots", "_seed", F.col("_passing.clip").alias("_clips"),
                F.col("_passing.group_rank").alias("_groups"), F.col("_passing.sim").alias("_sims"),
                F.col("_passing.score").alias("_scores"), F.col("_weak.clip").alias("_below"))
    )
    adds = T.StructType([T.StructField("_picks", T.ArrayType(T.LongType()))])

    def look(used, clips, groups, sims, scores):
        """Places of the clip that the search ends with and of the best-scored used one."""
        best = again = group = None
        seen = 0
        for i, c in enumerate(clips):
            if groups[i] != group:
                if best is not None and sims[best] >= lx.STRONG_SIMILARITY:
                    break
                group, seen = groups[i], 0
            if c in used:
                if again is None or scores[i] > scores[again]:
                    again = i
            elif seen < k:
                seen += 1
                if sims[i] is not None and (best is None or sims[i] > sims[best]):
                    best = i
        return best, again

    def step(used, clips, groups, sims, scores, below, n_shots, seed):
        """Picks as 3 times the place, and 1 more for a used clip, 2 more for a weak one; -1 for none."""
        used = set() if used is None else used
        used.update(seed or ())
        made = []
        for _ in range(n_shots):
            best, again = look(used, clips, groups, sims, scores)
            if best is not None:
                used.add(clips[best])
                made.append(3 * best)
            elif again is not None:
                made.append(3 * again + 1)
            else:
                at = next((i for i, c in enumerate(below) if c not in used), None)
                if at is not None:
                    used.add(below[at])
                made.append(-1 if at is None else 3 * at + 2)
        return used, (made,)

    picked = ordered_scan(work, ["script_id"], ["scene_idx"],
                          ["_clips", "_groups", "_sims", "_scores", "_below", "n_shots", "_seed"], adds, step,
                          keeps=["script_id", "scene_idx", "sig"])
    picks = picked.select("script_id", "scene_idx", "sig", F.posexplode("_picks").alias("shot_idx", "_at")).withColumns({
        "_place": F.floor(F.col("_at") / 3).cast("int"), "_way": F.pmod(F.col("_at"), F.lit(3))}).withColumn(
        "_list", F.when(F.col("_at") >= 0, F.when(F.col("_way") == 2, 1).otherwise(0)))
    # only picks, not options, travel with the scenes; what they stand for is joined by signature, list and place
    seen = per_sig.select("sig", F.lit(0).alias("_list"), F.posexplode("_passing").alias("_place", "_x")).select(
        "sig", "_list", "_place", "_x.query", "_x.clip", "_x.sim")
    last = per_sig.select("sig", F.lit(1).alias("_list"), F.posexplode("_weak").alias("_place", "_x")).select(
        "sig", "_list", "_place", "_x.query", "_x.clip", F.lit(None).cast("double").alias("sim"))
    found = F.when(F.col("_way") == 0, F.col("sim"))
    return picks.join(seen.unionByName(last), ["sig", "_list", "_place"], "left").select(
        "script_id", "scene_idx", F.col("shot_idx").cast("bigint").alias("shot_idx"), "query",
        F.substring_index("clip", ":", 1).alias("source"), F.expr("substring(clip, instr(clip, ':') + 1)").alias("video_id"),
        F.when(F.col("_at") < 0, "none").when(F.col("_way") == 1, "used").when(F.col("_way") == 2, "weak")
        .when(found >= lx.STRONG_SIMILARITY, "strong").when(found >= lx.MIN_SIMILARITY, "ok").otherwise("low").alias("tier"),
        F.when(F.col("_at") >= 0, found).alias("sim"),
    )


def similarity_histogram(picks: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Strong, ok and weak picks on the 3-dp similarity; unscored picks count as weak."""
    sim = F.bround(F.coalesce("sim", F.lit(-1.0)), 3)
    strong, least = F.lit(lx.STRONG_SIMILARITY), F.lit(lx.MIN_SIMILARITY)
    return picks.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_picks"),
        F.count_if(sim >= strong).alias("n_strong"),
        F.count_if((sim >= least) & (sim < strong)).alias("n_ok"),
        F.count_if(sim < least).alias("n_weak"),
    )
