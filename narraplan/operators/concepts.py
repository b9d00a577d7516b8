"""Concept tagging, script topics and the per-scene query ladder."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon as lx
from ..functions import patterns


class Concept(NamedTuple):
    """A pattern searched in lower-case text, the shot it stands for and a one-word anchor.

    The order of a list of concepts is their priority.
    """

    pattern: str
    visual: str
    anchor: str


def concepts_from(df: DataFrame) -> list[Concept]:
    """Read a topic's dictionary (priority, pattern, visual, anchor); its patterns go to every task."""
    return [Concept(r.pattern, r.visual, r.anchor) for r in df.orderBy("priority").collect()]


def concept_ids(text: Column, concepts: Sequence[Concept], limit: int = 2) -> Column:
    """Priorities of the first ``limit`` concepts found in the text."""
    return patterns.first_found(F.lower(text), [c.pattern for c in concepts], limit)


def topic_id(text: Column, concepts: Sequence[Concept]) -> Column:
    """Priority of the concept with most hits, the earlier on ties; null when none."""
    return patterns.most_found(F.lower(text), [c.pattern for c in concepts])


def _pick(values: Sequence[str], index: Column) -> Column:
    return F.try_element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def script_topics(scripts: DataFrame, concepts: Sequence[Concept],
                  default: tuple[str, str] = lx.DEFAULT_TOPIC) -> DataFrame:
    """Add topic_visual and topic_anchor; computed in the row, no shuffle."""
    return (
        scripts.withColumn("_topic", topic_id(F.col("text"), concepts))
        .withColumn(
            "topic_visual",
            F.coalesce(_pick([c.visual for c in concepts], F.col("_topic")), F.lit(default[0])),
        )
        .withColumn(
            "topic_anchor",
            F.coalesce(_pick([c.anchor for c in concepts], F.col("_topic")), F.lit(default[1])),
        )
        .drop("_topic")
    )


def tag_concepts(scenes: DataFrame, concepts: Sequence[Concept]) -> DataFrame:
    """Add the first and second visual and the first anchor found in each scene."""
    visuals, anchors = [c.visual for c in concepts], [c.anchor for c in concepts]
    one = F.try_element_at(F.col("_ids"), F.lit(1))
    two = F.try_element_at(F.col("_ids"), F.lit(2))
    return (
        scenes.withColumn("_ids", concept_ids(F.col("text"), concepts))
        .withColumn("visual", _pick(visuals, one))
        .withColumn("anchor", _pick(anchors, one))
        .withColumn("second_visual", _pick(visuals, two))
        .drop("_ids")
    )


def rotate_visuals(tagged: DataFrame, alternates: Mapping[str, Sequence[str]]) -> DataFrame:
    """nth use of a visual in a script takes its alternate n modulo their number."""
    uses = Window.partitionBy("script_id", "visual").orderBy("scene_idx")
    table = F.create_map(*[
        x for k, v in alternates.items() for x in (F.lit(k), F.array(*[F.lit(a) for a in v]))
    ]) if alternates else F.lit(None).cast("map<string,array<string>>")
    with_use = tagged.withColumn(
        "use_no",
        F.when(F.col("visual").isNotNull(), F.row_number().over(uses).cast("bigint") - 1),
    )
    alts = F.try_element_at(table, F.col("visual"))
    rotated = F.try_element_at(alts, (F.pmod(F.col("use_no"), F.size(alts)) + 1).cast("int"))
    return with_use.withColumn("primary", F.coalesce(rotated, F.col("visual")))


def carry_topics(rotated: DataFrame) -> DataFrame:
    """Scenes without a concept inherit the running visual; adds the keyword ladder.

    Needs primary, anchor, second_visual, topic_visual and topic_anchor.
    """
    upto = Window.partitionBy("script_id").orderBy("scene_idx")
    before = upto.rowsBetween(Window.unboundedPreceding, -1)
    upto = upto.rowsBetween(Window.unboundedPreceding, 0)
    running = F.last("primary", ignorenulls=True)
    out = rotated.select(
        "*",
        F.coalesce(running.over(upto), "topic_visual").alias("_first"),
        F.coalesce(running.over(before), "topic_visual").alias("_held"),
        F.coalesce(F.last("anchor", ignorenulls=True).over(upto), "topic_anchor").alias("_anchor"),
    )
    second = F.when(
        F.col("primary").isNotNull(), F.coalesce("second_visual", "_held")
    ).otherwise(F.col("topic_visual"))
    return out.withColumn(
        "keywords", F.array_distinct(F.array("_first", second, "_anchor"))
    ).drop("_first", "_held", "_anchor")


def scene_queries(scenes: DataFrame, concepts: Sequence[Concept],
                  alternates: Mapping[str, Sequence[str]]) -> DataFrame:
    """Keyword ladders for scenes that carry their script's topic columns: one shuffle."""
    tagged = tag_concepts(scenes, concepts).repartition("script_id")
    return carry_topics(rotate_visuals(tagged, alternates))
