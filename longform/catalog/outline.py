"""Outline queries (O1-O17) over fixtures F2-F5."""

from __future__ import annotations

from pyspark.sql import functions as F

from longform.catalog import register
from longform.catalog.common import GATE_EVENTS, MAX_EVENTS, MAX_VAL, fx
from longform.functions.records import event_json, relation_json
from longform.operators import outline as O
from longform.session import written

CAND = "SELECT story_id, round, val_iter, pos, event_id, event_key FROM fx_candidates"

# ---- shared oracle fragments -------------------------------------------------------------------------------
Q_CAND_DEDUP = """
q_cand_dedup AS (
  SELECT story_id, round, val_iter, event_id, min(pos) AS first_pos, max(pos) AS last_pos,
         arg_max(event_key, pos) AS event_key
  FROM fx_candidates GROUP BY story_id, round, val_iter, event_id)"""
Q_VERD_DEDUP = """
q_verd_dedup AS (
  SELECT story_id, round, val_iter, event_id, arg_max(valid, pos) AS valid, arg_max(suggestion, pos) AS suggestion
  FROM fx_verdicts GROUP BY story_id, round, val_iter, event_id)"""
Q_MATCH = Q_CAND_DEDUP + "," + Q_VERD_DEDUP + """,
q_match AS (
  SELECT c.*, v.valid, v.suggestion FROM q_cand_dedup c JOIN q_verd_dedup v
    ON v.story_id = c.story_id AND v.round = c.round AND v.val_iter = c.val_iter AND v.event_id = c.event_id)"""
Q_LIVE = Q_MATCH + """,
q_batches AS (
  SELECT b.story_id, b.round, b.val_iter, coalesce(m.n_matched, 0) AS n_matched,
         coalesce(m.n_accepted, 0) AS n_accepted, coalesce(m.n_invalid, 0) AS n_invalid
  FROM (SELECT DISTINCT story_id, round, val_iter FROM fx_candidates) b
  LEFT JOIN (SELECT story_id, round, val_iter, count(*) AS n_matched,
                    CAST(sum(CASE WHEN valid THEN 1 ELSE 0 END) AS BIGINT) AS n_accepted,
                    CAST(sum(CASE WHEN valid THEN 0 ELSE 1 END) AS BIGINT) AS n_invalid
             FROM q_match GROUP BY story_id, round, val_iter) m
    ON m.story_id = b.story_id AND m.round = b.round AND m.val_iter = b.val_iter),
q_live AS (
  SELECT *, coalesce(min(CASE WHEN n_invalid > 0 THEN 1 ELSE 0 END) OVER (
              PARTITION BY story_id, round ORDER BY val_iter ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) = 1
            AND val_iter = row_number() OVER (PARTITION BY story_id, round ORDER BY val_iter) - 1
            AND val_iter < {max_val} AS live
  FROM q_batches)""".replace("{max_val}", str(MAX_VAL))
_STOP = Q_LIVE + """,
q_round_acc AS (
  SELECT r.story_id, r.round, coalesce(a.n_accepted, 0) AS n_accepted
  FROM (SELECT DISTINCT story_id, round FROM fx_candidates WHERE val_iter = 0) r
  LEFT JOIN (SELECT story_id, round, CAST(sum(n_accepted) AS BIGINT) AS n_accepted FROM q_live WHERE live GROUP BY story_id, round) a
    ON a.story_id = r.story_id AND a.round = r.round),
q_cap AS (
  SELECT story_id, round, n_accepted,
         CAST(coalesce(sum(n_accepted) OVER (PARTITION BY story_id ORDER BY round
                                        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS accepted_before
  FROM q_round_acc),
q_empty AS (
  SELECT story_id, CAST(sum(CASE WHEN round = rn THEN 1 ELSE 0 END) AS INTEGER) AS empty_round
  FROM (SELECT story_id, round, row_number() OVER (PARTITION BY story_id ORDER BY round) - 1 AS rn
        FROM (SELECT DISTINCT story_id, round FROM fx_candidates WHERE val_iter = 0) s) x GROUP BY story_id),
q_stop AS (
  SELECT s.story_id,
         least(coalesce(c.complete_round, {cap}), coalesce(e.empty_round, 0), coalesce(m.cap_round, {cap}), {cap})
           AS stop_round
  FROM (SELECT DISTINCT story_id FROM fx_candidates) s
  LEFT JOIN (SELECT story_id, min(round) AS complete_round FROM fx_completeness WHERE complete GROUP BY story_id) c
    ON c.story_id = s.story_id
  LEFT JOIN q_empty e ON e.story_id = s.story_id
  LEFT JOIN (SELECT story_id, min(round) AS cap_round FROM q_cap WHERE accepted_before >= {max_events}
             GROUP BY story_id) m ON m.story_id = s.story_id),
q_play AS (
  SELECT m.* FROM q_match m
  JOIN q_live l ON l.story_id = m.story_id AND l.round = m.round AND l.val_iter = m.val_iter AND l.live
  JOIN q_stop s ON s.story_id = m.story_id AND m.round < s.stop_round
  WHERE m.valid),
q_seq AS (
  SELECT *, row_number() OVER (PARTITION BY story_id ORDER BY round, val_iter, first_pos) AS event_seq FROM q_play),
q_fold AS (
  SELECT story_id, event_seq, event_key, round, val_iter, event_id AS natural_id,
         CASE WHEN k = 1 THEN event_id ELSE concat(event_id, '_', CAST(k - 1 AS VARCHAR)) END AS event_id
  FROM (SELECT *, row_number() OVER (PARTITION BY story_id, event_id ORDER BY event_seq) AS k FROM q_seq) x)"""


def _stop(max_events: int) -> str:
    return _STOP.replace("{cap}", str(O.round_cap(max_events, MAX_VAL))).replace("{max_events}", str(max_events))


Q_STOP, Q_GATE = _stop(MAX_EVENTS), _stop(GATE_EVENTS)


def _with(ctes: str, body: str) -> str:
    return "WITH " + ctes.strip() + "\n" + body


# ---- queries -----------------------------------------------------------------------------------------------
@register("candidates_dedupe", _with(Q_CAND_DEDUP, "SELECT * FROM q_cand_dedup"))
def candidates_dedupe(spark, sf):
    c = fx(spark, sf).candidates.select("story_id", "round", "val_iter", "pos", "event_id", "event_key")
    return O.dedupe_candidates(c)


@register("verdicts_dedupe", _with(Q_VERD_DEDUP, "SELECT * FROM q_verd_dedup"))
def verdicts_dedupe(spark, sf):
    return O.dedupe_verdicts(fx(spark, sf).verdicts)


def _cv(spark, sf):
    f = fx(spark, sf)
    return f.candidates.select("story_id", "round", "val_iter", "pos", "event_id", "event_key"), f.verdicts


@register("match_verdicts", _with(Q_MATCH, "SELECT * FROM q_match"))
def match_verdicts(spark, sf):
    return O.match_verdicts(*_cv(spark, sf))


@register("unvalidated_candidates", _with(Q_CAND_DEDUP + "," + Q_VERD_DEDUP, """
SELECT c.* FROM q_cand_dedup c WHERE NOT EXISTS (
  SELECT 1 FROM q_verd_dedup v WHERE v.story_id = c.story_id AND v.round = c.round AND v.val_iter = c.val_iter
    AND v.event_id = c.event_id)"""))
def unvalidated_candidates(spark, sf):
    return O.unvalidated_candidates(*_cv(spark, sf))


@register("accepted_events", _with(Q_MATCH, "SELECT * FROM q_match WHERE valid"))
def accepted_events(spark, sf):
    return O.accepted_split(*_cv(spark, sf))


@register("revise_queue", _with(Q_MATCH, "SELECT * FROM q_match WHERE NOT valid"))
def revise_queue(spark, sf):
    return O.revise_queue(*_cv(spark, sf))


@register("validation_live_iters", _with(Q_LIVE, "SELECT * FROM q_live"))
def validation_live_iters(spark, sf):
    return O.validation_live_iters(*_cv(spark, sf), MAX_VAL)


@register("outline_gate_complete", """
SELECT story_id, min(round) AS complete_round FROM fx_completeness WHERE complete GROUP BY story_id""")
def outline_gate_complete(spark, sf):
    return O.gate_complete(fx(spark, sf).completeness)


@register("outline_gate_max_events", _with(Q_GATE, f"""
SELECT story_id, round, n_accepted, accepted_before, accepted_before >= {GATE_EVENTS} AS at_cap FROM q_cap"""))
def outline_gate_max_events(spark, sf):
    return O.gate_max_events(*_cv(spark, sf), GATE_EVENTS, MAX_VAL)


@register("outline_gate_no_candidates", _with(Q_STOP, "SELECT * FROM q_empty"))
def outline_gate_no_candidates(spark, sf):
    return O.gate_no_candidates(fx(spark, sf).candidates)


@register("outline_round_cap", _with(Q_GATE, "SELECT * FROM q_stop"))
def outline_round_cap(spark, sf):
    """Stop round per story: min of complete, max-events and empty rounds and the round cap."""
    f = fx(spark, sf)
    c, v = _cv(spark, sf)
    return O.stop_rounds(c, v, f.completeness, GATE_EVENTS, MAX_VAL)


@register("append_accepted", _with(Q_STOP, """
SELECT story_id, round, val_iter, first_pos, event_id, event_key, event_seq FROM q_seq"""))
def append_accepted(spark, sf):
    f = fx(spark, sf)
    c, v = _cv(spark, sf)
    acc = O.accepted_in_play(c, v, f.completeness, MAX_EVENTS, MAX_VAL)
    return O.append_accepted(acc).select("story_id", "round", "val_iter", "first_pos", "event_id", "event_key",
                                         "event_seq")


@register("event_id_suffix", _with(Q_STOP, "SELECT story_id, event_seq, natural_id, event_id FROM q_fold"))
def event_id_suffix(spark, sf):
    f = fx(spark, sf)
    c, v = _cv(spark, sf)
    ev = O.accepted_events(c, v, f.completeness, MAX_EVENTS, MAX_VAL).select("story_id", "event_seq", "event_id")
    return O.resolve_event_ids(written(ev))


@register("outline_fold", _with(Q_STOP, "SELECT * FROM q_fold"))
def outline_fold(spark, sf):
    f = fx(spark, sf)
    c, v = _cv(spark, sf)
    r = O.outline_fold(c, v, f.completeness, MAX_EVENTS, MAX_VAL)
    return r.select("story_id", "event_seq", "event_key", "round", "val_iter", "natural_id", "event_id")


@register("relations_valid", """
SELECT r.story_id, r.rel_seq, r.type, r.source_event_id, r.target_event_id, r.rationale FROM fx_relations r
WHERE EXISTS (SELECT 1 FROM fx_events e WHERE e.story_id = r.story_id AND e.event_id = r.source_event_id)
  AND EXISTS (SELECT 1 FROM fx_events e WHERE e.story_id = r.story_id AND e.event_id = r.target_event_id)""")
def relations_valid(spark, sf):
    f = fx(spark, sf)
    return O.relations_valid(f.relations, f.events)


EVENT_JSON_SQL = ("to_json({'event_id': e.event_id, 'title': e.title, 'summary': e.summary, 'time': e.time, "
                  "'location': e.location, 'characters': e.characters, 'goal': e.goal, 'conflict': e.conflict, "
                  "'novelty_score': e.novelty_score, 'coherence_score': e.coherence_score})")
REL_JSON_SQL = ("to_json({'type': r.type, 'source_event_id': r.source_event_id, "
                "'target_event_id': r.target_event_id, 'rationale': r.rationale})")
Q_VALID_REL = """
q_valid_rel AS (
  SELECT r.* FROM fx_relations r
  WHERE EXISTS (SELECT 1 FROM fx_events e WHERE e.story_id = r.story_id AND e.event_id = r.source_event_id)
    AND EXISTS (SELECT 1 FROM fx_events e WHERE e.story_id = r.story_id AND e.event_id = r.target_event_id))"""
Q_GRAPH = Q_VALID_REL + f""",
q_nodes AS (SELECT story_id, count(*) AS n_nodes,
                   string_agg({EVENT_JSON_SQL}, ',' ORDER BY e.event_seq) AS nodes_json
            FROM fx_events e GROUP BY story_id),
q_edges AS (SELECT story_id, count(*) AS n_edges,
                   string_agg({REL_JSON_SQL}, ',' ORDER BY r.rel_seq) AS edges_json
            FROM q_valid_rel r GROUP BY story_id),
q_graph AS (
  SELECT s.story_id, coalesce(n.n_nodes, 0) AS n_nodes, coalesce(d.n_edges, 0) AS n_edges,
         concat('{{"nodes":[', coalesce(n.nodes_json, ''), '],"edges":[', coalesce(d.edges_json, ''), ']}}') AS graph_json
  FROM fx_stories s LEFT JOIN q_nodes n ON n.story_id = s.story_id LEFT JOIN q_edges d ON d.story_id = s.story_id)"""


def graph_frame(spark, sf):
    f = fx(spark, sf)
    return O.event_graph(f.events, O.relations_valid(f.relations, f.events), f.stories)


@register("event_graph", _with(Q_GRAPH, "SELECT * FROM q_graph"))
def event_graph(spark, sf):
    g = graph_frame(spark, sf)
    return g.select("story_id", F.size("nodes").cast("long").alias("n_nodes"),
                    F.size("edges").cast("long").alias("n_edges"),
                    F.to_json(F.struct("nodes", "edges"), {"ignoreNullFields": "false"}).alias("graph_json"))


__all__ = ["event_json", "relation_json", "CAND"]
