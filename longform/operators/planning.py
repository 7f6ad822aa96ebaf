"""Planning operators: per-event decomposition fan-out, parent override, story-wide id resolution and order,
chapters, and the assembled story plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from longform import schemas
from longform.functions.ids import resolve_ids
from longform.functions.records import ordered_list
from longform.functions.seq import seq_number


def plan_fanout(events: DataFrame) -> DataFrame:
    """One decomposition request per accepted event; each depends on premise, graph and target only."""
    return events.select("story_id", "event_seq", F.col("event_id").alias("target_event_id"))


def parent_override(sub_events: DataFrame) -> DataFrame:
    """The parent id the model wrote is replaced by the event the request asked about (``target_event_id``)."""
    return (sub_events.withColumnRenamed("parent_event_id", "model_parent_id")
            .withColumn("parent_event_id", F.col("target_event_id")))


def sub_event_order(sub_events: DataFrame) -> DataFrame:
    """Story-wide order: event order first, then the element position inside the response."""
    return seq_number(sub_events, ["story_id"], ["pos"], "sub_seq", block=[F.col("event_seq")])


def resolve_sub_event_ids(sub_events: DataFrame) -> DataFrame:
    """Sub-event ids collide across the whole story; resolve in ``sub_seq`` order."""
    r = resolve_ids(sub_events, ["story_id"], "sub_event_id", "sub_seq", "_lf_resolved")
    return (r.withColumnRenamed("sub_event_id", "natural_sub_event_id")
            .withColumnRenamed("_lf_resolved", "sub_event_id"))


def story_plan(stories: DataFrame, graph: DataFrame, sub_events: DataFrame, chapters: DataFrame) -> DataFrame:
    """One row per story: premise, event graph, sub-events in plan order, chapters in list order.

    Lists without members are empty."""
    se = sub_events.groupBy("story_id").agg(ordered_list(
        F.struct(*[F.col(c) for c in schemas.SUB_EVENT_FIELDS]), F.col("sub_seq")).alias("sub_events"))
    ch = chapters.groupBy("story_id").agg(ordered_list(
        F.struct(*[F.col(c) for c in schemas.CHAPTER_FIELDS]), F.col("chapter_pos")).alias("chapters"))
    none_of = {n: F.coalesce(n, F.array().cast(d.schema[n].dataType)).alias(n)
               for n, d in (("sub_events", se), ("chapters", ch))}
    return (stories.join(graph, "story_id").join(se, "story_id", "left").join(ch, "story_id", "left")
            .select("story_id", "premise", F.struct("nodes", "edges").alias("event_graph"), none_of["sub_events"],
                    none_of["chapters"]))
