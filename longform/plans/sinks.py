"""Sinks S4-S7: nested JSON exports, one row per story (not a folder per story: no small-file storm), and run
counters. A story's export is one value by definition."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from longform.functions.records import ordered_text
from longform.operators.outline import match_verdicts
from longform.schemas import PASSAGE_TS_FORMAT


def outline_rows(graph: DataFrame) -> DataFrame:
    """``(story_id, outline_json)`` from the event graph."""
    return graph.select("story_id", F.to_json(F.struct("nodes", "edges"), {"ignoreNullFields": "false"})
                        .alias("outline_json"))


def write_json(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write export rows as JSON lines (non-ASCII kept)."""
    rows.write.mode(mode).json(path)


def passage_timestamp(ts: F.Column) -> F.Column:
    """W15 export form of a passage time stamp (UTC)."""
    return F.date_format(ts, PASSAGE_TS_FORMAT)


def run_counters(counts: DataFrame) -> DataFrame:
    """Counts per (stage, story) with per-stage and overall totals (rollup)."""
    return counts.rollup("stage", "story_id").agg(F.sum("n").alias("n"))


def round_counters(candidates: DataFrame, verdicts: DataFrame, played: DataFrame) -> DataFrame:
    """S7 of the outline, ``(stage, story_id, round, n)`` for each round that was played (``outline.played_batches``): seed
    candidates, accepted, events in all after the round, to revise and revised candidates."""
    batch = ["story_id", "round", "val_iter"]
    c = match_verdicts(candidates, verdicts, "left").join(played, batch)
    r = c.groupBy("story_id", "round").agg(
        F.count_if(F.col("val_iter") == 0).alias("candidates"), F.count_if("valid").alias("accepted"),
        F.min("n_before").alias("_before"), F.count_if(~F.col("valid")).alias("to_revise"),
        F.count_if(F.col("val_iter") > 0).alias("revised"))
    return r.select("story_id", "round", F.expr(
        "stack(5, 'candidates', candidates, 'accepted', accepted, 'total', _before + accepted, 'to_revise', to_revise, "
        "'revised', revised) AS (stage, n)"))


def plan_rows(plan: DataFrame) -> DataFrame:
    """``(story_id, plan_json)`` from the story plan."""
    return plan.select("story_id", F.to_json(F.struct("premise", "event_graph", "sub_events", "chapters"),
                                             {"ignoreNullFields": "false"}).alias("plan_json"))


def chapter_rows(stories: DataFrame, chapters: DataFrame) -> DataFrame:
    """``(story_id, chapters_json)`` from the chapters with their passages (W17); a story without chapters has an
    empty list."""
    one = F.to_json(F.struct("chapter_id", "title", "summary", "sub_event_ids", "passages"),
                    {"ignoreNullFields": "false"})
    c = chapters.groupBy("story_id").agg(ordered_text(one, F.col("chapter_pos"), ",").alias("body"))
    return stories.select("story_id").join(c, "story_id", "left").select(
        "story_id", F.concat(F.lit("["), F.coalesce("body", F.lit("")), F.lit("]")).alias("chapters_json"))
