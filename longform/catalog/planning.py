"""Planning queries (P1-P4, P6) over fixtures F5-F7."""

from __future__ import annotations

from pyspark.sql import functions as F

from longform.catalog import register
from longform.catalog.common import fx
from longform.catalog.outline import EVENT_JSON_SQL, Q_GRAPH, graph_frame
from longform.operators import planning as P


@register("plan_fanout", "SELECT story_id, event_seq, event_id AS target_event_id FROM fx_events")
def plan_fanout(spark, sf):
    return P.plan_fanout(fx(spark, sf).events)


@register("plan_parent_override", """
SELECT story_id, sub_seq, regexp_extract(sub_event_id, '^([^_]+)', 1) AS model_parent_id,
       parent_event_id FROM fx_sub_events_raw""")
def plan_parent_override(spark, sf):
    s = fx(spark, sf).sub_events_raw
    model = s.select("story_id", "sub_seq", F.col("parent_event_id").alias("target_event_id"),
                     F.regexp_extract("sub_event_id", r"^([^_]+)", 1).alias("parent_event_id"))
    return P.parent_override(model).select("story_id", "sub_seq", "model_parent_id", "parent_event_id")


@register("sub_event_id_suffix", "SELECT story_id, sub_seq, sub_event_id FROM fx_sub_events")
def sub_event_id_suffix(spark, sf):
    return fx(spark, sf).sub_events.select("story_id", "sub_seq", "sub_event_id")


@register("sub_event_order", """
SELECT story_id, parent_event_id, event_seq, pos,
       row_number() OVER (PARTITION BY story_id ORDER BY event_seq, pos) AS sub_seq
FROM (SELECT story_id, parent_event_id, o_seq AS event_seq,
             row_number() OVER (PARTITION BY story_id, o_seq ORDER BY l_linenumber, l_partkey, l_suppkey) AS pos
      FROM fx_sub_events_raw) s""")
def sub_event_order(spark, sf):
    from longform.functions.seq import window_number
    s = fx(spark, sf).sub_events_raw.select("story_id", "parent_event_id", F.col("o_seq").alias("event_seq"),
                                            "l_linenumber", "l_partkey", "l_suppkey")
    s = window_number(s, ["story_id", "event_seq"], ["l_linenumber", "l_partkey", "l_suppkey"], "pos")
    return P.sub_event_order(s).select("story_id", "parent_event_id", "event_seq", "pos", "sub_seq")


SUB_JSON_SQL = ("to_json({'sub_event_id': s.sub_event_id, 'parent_event_id': s.parent_event_id, "
                "'title': s.title, 'summary': s.summary, 'characters': s.characters})")


Q_PLAN = Q_GRAPH.strip() + f""",
q_se AS (SELECT story_id, count(*) AS n_sub_events,
                string_agg({SUB_JSON_SQL}, ',' ORDER BY s.sub_seq) AS se_json
         FROM fx_sub_events s GROUP BY story_id),
q_ch AS (SELECT story_id, count(*) AS n_chapters,
                string_agg(to_json({{'chapter_id': c.chapter_id, 'title': c.title, 'summary': c.summary,
                                    'sub_event_ids': c.sub_event_ids}}), ',' ORDER BY c.chapter_pos) AS ch_json
         FROM fx_chapters c GROUP BY story_id),
q_plan AS (
  SELECT s.story_id, g.n_nodes, g.n_edges, coalesce(se.n_sub_events, 0) AS n_sub_events,
         coalesce(ch.n_chapters, 0) AS n_chapters,
         concat('{{"premise":', to_json(s.premise), ',"event_graph":', g.graph_json, ',"sub_events":[',
                coalesce(se.se_json, ''), '],"chapters":[', coalesce(ch.ch_json, ''), ']}}') AS plan_json
  FROM fx_stories s JOIN q_graph g ON g.story_id = s.story_id
  LEFT JOIN q_se se ON se.story_id = s.story_id LEFT JOIN q_ch ch ON ch.story_id = s.story_id)"""


@register("story_plan", "WITH " + Q_PLAN + """
SELECT story_id, n_nodes, n_edges, n_sub_events, n_chapters, md5(plan_json) AS plan_md5 FROM q_plan""")
def story_plan(spark, sf):
    f = fx(spark, sf)
    p = P.story_plan(f.stories, graph_frame(spark, sf), f.sub_events, f.chapters)
    return p.select("story_id", F.size("event_graph.nodes").cast("long").alias("n_nodes"),
                    F.size("event_graph.edges").cast("long").alias("n_edges"),
                    F.size("sub_events").cast("long").alias("n_sub_events"),
                    F.size("chapters").cast("long").alias("n_chapters"),
                    F.md5(F.to_json(F.struct("premise", "event_graph", "sub_events", "chapters"),
                                    {"ignoreNullFields": "false"})).alias("plan_md5"))


__all__ = ["EVENT_JSON_SQL"]
