"""Prompt request queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from longform.catalog import register
from longform.catalog.common import K_CANDIDATES, MAX_EVENTS, MAX_VAL, fx
from longform.catalog.outline import EVENT_JSON_SQL, Q_GRAPH, Q_STOP, graph_frame
from longform.catalog.planning import SUB_JSON_SQL
from longform.catalog.writing import Q_CONTEXT
from longform.operators import outline as O
from longform.operators import prompts as T
from longform.operators import writing as W

EVENTS_TEXT_SQL = f"""
q_evtext AS (SELECT e.story_id, string_agg({EVENT_JSON_SQL}, chr(10) ORDER BY e.event_seq) AS events
             FROM fx_events e GROUP BY e.story_id)"""
CAND_JSON_SQL = EVENT_JSON_SQL.replace("e.", "c.")


def _out(df, keys):
    return df.select("stage", *keys, "prompt_hash", F.length("prompt").cast("long").alias("prompt_len"))


def _sql_out(stage, keys, prompt_sql, src):
    return f"""SELECT '{stage}' AS stage, {keys}, sha256(p) AS prompt_hash, CAST(length(p) AS BIGINT) AS prompt_len
FROM (SELECT {keys}, {prompt_sql} AS p FROM {src}) x"""


REQ_COMPLETENESS_SQL = "WITH " + EVENTS_TEXT_SQL.strip() + "\n" + _sql_out(
    "completeness", "story_id", T.render_sql("completeness", {"premise": "s.premise", "events": "t.events"}),
    "fx_stories s LEFT JOIN q_evtext t USING (story_id)")


@register("req_completeness", REQ_COMPLETENESS_SQL)
def req_completeness(spark, sf):
    f = fx(spark, sf)
    return _out(T.req_completeness(f.stories, f.events), ["story_id"])


@register("req_validate", "WITH " + EVENTS_TEXT_SQL.strip() + f""",
q_cand AS (SELECT c.story_id, c.round, c.val_iter, string_agg({CAND_JSON_SQL}, chr(10) ORDER BY c.pos) AS candidates
           FROM fx_candidate_records c GROUP BY c.story_id, c.round, c.val_iter)
""" + _sql_out("validate", "story_id, round, val_iter",
               T.render_sql("validate", {"premise": "s.premise", "events": "t.events", "candidates": "q.candidates"}),
               "q_cand q JOIN fx_stories s USING (story_id) LEFT JOIN q_evtext t USING (story_id)"))
def req_validate(spark, sf):
    f = fx(spark, sf)
    r = T.req_validate(f.stories, f.events, f.candidate_records, ["story_id", "round", "val_iter"])
    return _out(r, ["story_id", "round", "val_iter"])


@register("req_relations", "WITH " + EVENTS_TEXT_SQL.strip() + "\n" + _sql_out(
    "relations", "story_id", T.render_sql("relations", {"premise": "s.premise", "events": "t.events"}),
    "fx_stories s LEFT JOIN q_evtext t USING (story_id)"))
def req_relations(spark, sf):
    f = fx(spark, sf)
    return _out(T.req_relations(f.stories, f.events), ["story_id"])


def _graph_json(spark, sf):
    g = graph_frame(spark, sf)
    return g.select("story_id", F.to_json(F.struct("nodes", "edges"), {"ignoreNullFields": "false"})
                    .alias("graph_json"))


@register("req_subevents", "WITH " + Q_GRAPH.strip() + "\n" + _sql_out(
    "subevents", "story_id, event_seq, target_event_id",
    T.render_sql("subevents", {"premise": "s.premise", "graph": "g.graph_json", "target": "target_event_id"}),
    "(SELECT story_id, event_seq, event_id AS target_event_id FROM fx_events) e JOIN fx_stories s USING (story_id) "
    "JOIN q_graph g USING (story_id)"))
def req_subevents(spark, sf):
    f = fx(spark, sf)
    r = T.req_subevents(f.stories, _graph_json(spark, sf), f.events)
    return _out(r, ["story_id", "event_seq", "target_event_id"])


@register("req_weave", "WITH " + Q_GRAPH.strip() + f""",
q_subs AS (SELECT s.story_id, string_agg({SUB_JSON_SQL}, chr(10) ORDER BY s.sub_seq) AS subs
           FROM fx_sub_events s GROUP BY s.story_id)
""" + _sql_out("weave", "story_id",
               T.render_sql("weave", {"premise": "s.premise", "graph": "g.graph_json", "sub_events": "q.subs"}),
               "fx_stories s JOIN q_graph g USING (story_id) LEFT JOIN q_subs q USING (story_id)"))
def req_weave(spark, sf):
    f = fx(spark, sf)
    return _out(T.req_weave(f.stories, _graph_json(spark, sf), f.sub_events), ["story_id"])


Q_ACCEPTED = Q_STOP.strip() + f""",
q_acc AS (SELECT e.story_id, e.round, e.val_iter, e.event_seq, {EVENT_JSON_SQL} AS event_json
          FROM (SELECT f.story_id, f.round, f.val_iter, f.event_seq, f.event_id, r.* EXCLUDE (story_id, round, val_iter, event_id)
                FROM q_fold f JOIN fx_candidate_records r ON r.story_id = f.story_id AND r.round = f.round
                 AND r.val_iter = f.val_iter AND r.event_key = f.event_key) e)"""


def _accepted(spark, sf):
    """Accepted events (O17) with their records, round and pass."""
    f = fx(spark, sf)
    cands = f.candidates.select("story_id", "round", "val_iter", "pos", "event_id", "event_key")
    fold = O.outline_fold(cands, f.verdicts, f.completeness, MAX_EVENTS, MAX_VAL).select(
        "story_id", "round", "val_iter", "event_key", "event_seq", "event_id")
    rec = f.candidate_records.drop("event_id", "pos", "o_orderkey")
    return fold.join(rec, ["story_id", "round", "val_iter", "event_key"])


@register("req_seed", "WITH " + Q_ACCEPTED + """,
q_pre AS (SELECT c.story_id, c.round, string_agg(a.event_json, chr(10) ORDER BY a.event_seq) AS events
          FROM fx_completeness c JOIN q_acc a ON a.story_id = c.story_id AND a.round < c.round
          GROUP BY c.story_id, c.round)
""" + _sql_out("seed", "story_id, round",
               T.render_sql("seed", {"premise": "s.premise", "events": "q.events", "reason": "c.reason",
                                     "missing": "c.missing_elements", "k": str(K_CANDIDATES)}),
               "(SELECT * FROM fx_completeness WHERE NOT complete) c JOIN fx_stories s USING (story_id) "
               "LEFT JOIN q_pre q USING (story_id, round)"))
def req_seed(spark, sf):
    f = fx(spark, sf)
    return _out(T.req_seed(f.stories, _accepted(spark, sf), f.completeness, K_CANDIDATES), ["story_id", "round"])


@register("req_revise", "WITH " + Q_ACCEPTED + f""",
q_rej AS (SELECT c.story_id, c.round, c.val_iter, string_agg({CAND_JSON_SQL}, chr(10) ORDER BY m.first_pos) AS candidates,
                 string_agg(concat(c.event_id, ': ', m.suggestion), chr(10) ORDER BY m.first_pos) AS feedback
          FROM q_match m JOIN fx_candidate_records c ON c.story_id = m.story_id AND c.round = m.round
           AND c.val_iter = m.val_iter AND c.event_key = m.event_key
          WHERE NOT m.valid AND m.val_iter + 1 < {MAX_VAL} GROUP BY c.story_id, c.round, c.val_iter),
q_pre AS (SELECT c.story_id, c.round, c.val_iter, string_agg(a.event_json, chr(10) ORDER BY a.event_seq) AS events
          FROM q_rej c JOIN q_acc a ON a.story_id = c.story_id
           AND (a.round < c.round OR a.round = c.round AND a.val_iter <= c.val_iter)
          GROUP BY c.story_id, c.round, c.val_iter)
""" + _sql_out("revise", "story_id, round, val_iter",
               T.render_sql("revise", {"premise": "s.premise", "events": "q.events", "feedback": "r.feedback",
                                       "candidates": "r.candidates"}),
               "q_rej r JOIN fx_stories s USING (story_id) LEFT JOIN q_pre q USING (story_id, round, val_iter)"))
def req_revise(spark, sf):
    f = fx(spark, sf)
    rejected = O.revise_queue(f.candidate_records, f.verdicts)
    r = T.req_revise(f.stories, _accepted(spark, sf), rejected, MAX_VAL)
    return _out(r, ["story_id", "round", "val_iter"])


def _contexts(spark, sf):
    f = fx(spark, sf)
    slots = W.reading_order(f.chapters).select("story_id", "pos", "sub_event_id")
    return W.context_text(slots, f.sub_events, f.events, O.relations_valid(f.relations, f.events), f.passages)


@register("req_compress", "WITH " + Q_CONTEXT.strip() + "\n" + _sql_out(
    "compress", "story_id, pos",
    T.render_sql("compress", {"premise": "st.premise", "history": "c.context", "sub_event": SUB_JSON_SQL}),
    "q_parent p JOIN fx_sub_events s USING (story_id, sub_event_id) JOIN fx_stories st USING (story_id) "
    "LEFT JOIN q_ctx c USING (story_id, pos)"))
def req_compress(spark, sf):
    f = fx(spark, sf)
    return _out(T.req_compress(f.stories, _contexts(spark, sf), f.sub_events), ["story_id", "pos"])


@register("req_write", f"""
WITH q_titles AS (SELECT story_id, chapter_pos, title AS chapter_title,
                         coalesce(lead(title) OVER (PARTITION BY story_id ORDER BY chapter_pos),
                                  '{W.NO_MORE_CHAPTERS}') AS next_title FROM fx_chapters)
""" + _sql_out("write", "story_id, pos",
               T.render_sql("write", {"premise": "st.premise", "summary": "p.summary_text", "chapter": "t.chapter_title",
                                      "next_chapter": "t.next_title", "sub_event": SUB_JSON_SQL}),
               "fx_passages p JOIN fx_sub_events s USING (story_id, sub_event_id) "
               "JOIN q_titles t USING (story_id, chapter_pos) JOIN fx_stories st USING (story_id)"))
def req_write(spark, sf):
    f = fx(spark, sf)
    slots = W.reading_order(f.chapters).select("story_id", "pos", "chapter_pos", "sub_event_id")
    summaries = f.passages.select("story_id", "pos", "summary_text")
    r = T.req_write(f.stories, slots, summaries, W.next_chapter_title(f.chapters), f.sub_events)
    return _out(r, ["story_id", "pos"])


@register("req_revise_passage", "WITH " + Q_GRAPH.strip() + "\n" + _sql_out(
    "revise_passage", "story_id, pos",
    T.render_sql("revise_passage", {"premise": "st.premise", "graph": "g.graph_json", "sub_event": SUB_JSON_SQL,
                                    "summary": "p.summary_text", "raw_text": "p.raw_text"}),
    "fx_passages p JOIN fx_sub_events s USING (story_id, sub_event_id) JOIN fx_stories st USING (story_id) "
    "JOIN q_graph g USING (story_id)"))
def req_revise_passage(spark, sf):
    f = fx(spark, sf)
    return _out(T.req_revise_passage(f.stories, _graph_json(spark, sf), f.passages, f.sub_events), ["story_id", "pos"])


@register("req_completeness_rounds", "WITH " + Q_ACCEPTED + """,
q_rounds AS (SELECT DISTINCT story_id, round FROM fx_completeness),
q_pre AS (SELECT c.story_id, c.round, string_agg(a.event_json, chr(10) ORDER BY a.event_seq) AS events
          FROM q_rounds c JOIN q_acc a ON a.story_id = c.story_id AND a.round < c.round
          GROUP BY c.story_id, c.round)
""" + _sql_out("completeness", "story_id, round",
               T.render_sql("completeness", {"premise": "s.premise", "events": "q.events"}),
               "q_rounds c JOIN fx_stories s USING (story_id) LEFT JOIN q_pre q USING (story_id, round)"))
def req_completeness_rounds(spark, sf):
    f = fx(spark, sf)
    return _out(T.req_completeness_rounds(f.stories, _accepted(spark, sf), f.completeness), ["story_id", "round"])


@register("req_validate_rounds", "WITH " + Q_ACCEPTED + f""",
q_cand AS (SELECT c.story_id, c.round, c.val_iter, string_agg({CAND_JSON_SQL}, chr(10) ORDER BY c.pos) AS candidates
           FROM fx_candidate_records c GROUP BY c.story_id, c.round, c.val_iter),
q_pre AS (SELECT c.story_id, c.round, c.val_iter, string_agg(a.event_json, chr(10) ORDER BY a.event_seq) AS events
          FROM q_cand c JOIN q_acc a ON a.story_id = c.story_id
           AND (a.round < c.round OR a.round = c.round AND a.val_iter < c.val_iter)
          GROUP BY c.story_id, c.round, c.val_iter)
""" + _sql_out("validate", "story_id, round, val_iter",
               T.render_sql("validate", {"premise": "s.premise", "events": "t.events", "candidates": "q.candidates"}),
               "q_cand q JOIN fx_stories s USING (story_id) LEFT JOIN q_pre t USING (story_id, round, val_iter)"))
def req_validate_rounds(spark, sf):
    f = fx(spark, sf)
    r = T.req_validate_rounds(f.stories, _accepted(spark, sf), f.candidate_records)
    return _out(r, ["story_id", "round", "val_iter"])
