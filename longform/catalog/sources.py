"""Source and sink queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from longform.catalog import register
from longform.catalog.common import MAX_EVENTS, MAX_VAL, RUN_ID, fx
from longform.catalog.outline import Q_GRAPH, Q_STOP, graph_frame
from longform.catalog.planning import Q_PLAN
from longform.catalog.writing import Q_CHAPTERS
from longform.operators import outline as O
from longform.operators import writing as W
from longform.operators.planning import story_plan as story_plan_frame
from longform.plans import sinks as S
from longform.sources import premises as P


@register("src_premises", "SELECT c_custkey AS story_id, concat(c_name, ' in ', c_mktsegment) AS premise FROM customer")
def src_premises(spark, sf):
    c = fx(spark, sf).t("customer").select(F.col("c_custkey").alias("story_id"),
                                           F.concat("c_name", F.lit(" in "), "c_mktsegment").alias("premise"))
    return c


@register("story_identity", f"""
SELECT story_id, sha256(concat_ws('|', '{RUN_ID}', premise)) AS story_key FROM fx_stories""")
def story_identity(spark, sf):
    return P.story_identity(fx(spark, sf).stories, RUN_ID).select("story_id", "story_key")


@register("sink_outline", "WITH " + Q_GRAPH.strip() + "\nSELECT story_id, graph_json AS outline_json FROM q_graph")
def sink_outline(spark, sf):
    return S.outline_rows(graph_frame(spark, sf))


@register("run_counters", """
SELECT stage, story_id, CAST(sum(n) AS BIGINT) AS n FROM (
  SELECT 'candidates' AS stage, story_id, count(*) AS n FROM fx_candidates GROUP BY story_id
  UNION ALL SELECT 'events', story_id, count(*) FROM fx_events GROUP BY story_id
  UNION ALL SELECT 'sub_events', story_id, count(*) FROM fx_sub_events GROUP BY story_id
  UNION ALL SELECT 'chapters', story_id, count(*) FROM fx_chapters GROUP BY story_id
  UNION ALL SELECT 'passages', story_id, count(*) FROM fx_passages GROUP BY story_id) c
GROUP BY ROLLUP (stage, story_id)""")
def run_counters(spark, sf):
    """S7. Events and passages are counted by their rows, whose texts are neither made nor kept for it."""
    f = fx(spark, sf)
    parts = [("candidates", f.candidates), ("events", f.event_rows), ("sub_events", f.sub_events),
             ("chapters", f.chapters), ("passages", f.passage_rows)]
    counts = None
    for name, d in parts:
        c = d.groupBy("story_id").agg(F.count(F.lit(1)).alias("n")).withColumn("stage", F.lit(name))
        counts = c if counts is None else counts.unionByName(c)
    return S.run_counters(counts).select("stage", "story_id", "n")


@register("sink_plan", "WITH " + Q_PLAN.strip() + "\nSELECT story_id, plan_json FROM q_plan")
def sink_plan(spark, sf):
    f = fx(spark, sf)
    return S.plan_rows(story_plan_frame(f.stories, graph_frame(spark, sf), f.sub_events, f.chapters))


@register("sink_chapters", "WITH " + Q_CHAPTERS.strip() + """
SELECT s.story_id, concat('[', coalesce(c.body, ''), ']') AS chapters_json
FROM fx_stories s LEFT JOIN (SELECT story_id, string_agg(chapter_json, ',' ORDER BY chapter_pos) AS body
                             FROM q_chapter GROUP BY story_id) c ON c.story_id = s.story_id""")
def sink_chapters(spark, sf):
    f = fx(spark, sf)
    return S.chapter_rows(f.stories, W.chapter_text(f.chapters, f.passages))


@register("run_counters_rounds", "WITH " + Q_STOP.strip() + """,
q_rounds AS (
  SELECT c.story_id, c.round, count(*) FILTER (WHERE c.val_iter = 0) AS candidates,
         count(*) FILTER (WHERE v.valid) AS accepted, count(*) FILTER (WHERE NOT v.valid) AS to_revise,
         count(*) FILTER (WHERE c.val_iter > 0) AS revised
  FROM q_cand_dedup c
  JOIN q_live l ON l.story_id = c.story_id AND l.round = c.round AND l.val_iter = c.val_iter AND l.live
  JOIN q_stop s ON s.story_id = c.story_id AND c.round < s.stop_round
  LEFT JOIN q_verd_dedup v ON v.story_id = c.story_id AND v.round = c.round AND v.val_iter = c.val_iter
   AND v.event_id = c.event_id
  GROUP BY c.story_id, c.round)
SELECT 'candidates' AS stage, story_id, round, candidates AS n FROM q_rounds
UNION ALL SELECT 'accepted', story_id, round, accepted FROM q_rounds
UNION ALL SELECT 'total', story_id, round, CAST(sum(accepted) OVER (PARTITION BY story_id ORDER BY round) AS BIGINT)
          FROM q_rounds
UNION ALL SELECT 'to_revise', story_id, round, to_revise FROM q_rounds
UNION ALL SELECT 'revised', story_id, round, revised FROM q_rounds
UNION ALL SELECT 'relations', story_id, NULL, count(*) FROM fx_relations GROUP BY story_id
UNION ALL SELECT 'sub_events', story_id, NULL, count(*) FROM fx_sub_events GROUP BY story_id
UNION ALL SELECT 'chapters', story_id, NULL, count(*) FROM fx_chapters GROUP BY story_id
UNION ALL SELECT 'passages', story_id, NULL, count(*) FROM fx_passages GROUP BY story_id""")
def run_counters_rounds(spark, sf):
    """The nine counters of a run, those of the outline by round."""
    f = fx(spark, sf)
    c = f.candidates.select("story_id", "round", "val_iter", "pos", "event_id", "event_key")
    played = O.played_batches(c, f.verdicts, f.completeness, MAX_EVENTS, MAX_VAL)
    out = S.round_counters(c, f.verdicts, played).select("stage", "story_id", "round", "n")
    for name, d in [("relations", f.relations), ("sub_events", f.sub_events), ("chapters", f.chapters),
                    ("passages", f.passages)]:
        out = out.unionByName(d.groupBy("story_id").agg(F.count(F.lit(1)).alias("n")).select(
            F.lit(name).alias("stage"), "story_id", F.lit(None).cast("int").alias("round"), "n"))
    return out
