"""Writing queries (W1-W11, W15-W19) over fixtures F5-F8."""

from __future__ import annotations

from pyspark.sql import functions as F

from longform.catalog import register
from longform.catalog.common import fx
from longform.catalog.outline import EVENT_JSON_SQL, Q_VALID_REL
from longform.catalog.planning import SUB_JSON_SQL
from longform.operators import outline as O
from longform.operators import writing as W

RANGE_LO, RANGE_HI = 1994, 1996


def _parts(spark, sf):
    f = fx(spark, sf)
    slots = W.reading_order(f.chapters)
    rel = O.relations_valid(f.relations, f.events)
    return f, slots, rel


@register("event_lookup", """
SELECT s.story_id, s.sub_event_id, s.parent_event_id, e.event_seq, e.title AS event_title
FROM fx_sub_events s LEFT JOIN fx_events e ON e.story_id = s.story_id AND e.event_id = s.parent_event_id""")
def event_lookup(spark, sf):
    f = fx(spark, sf)
    return W.event_lookup(f.sub_events.select("story_id", "sub_event_id", "parent_event_id"), f.events)


Q_ADJ = Q_VALID_REL + """,
q_adj AS (SELECT DISTINCT story_id, source_event_id AS event_id, target_event_id AS neighbour_id FROM q_valid_rel
          UNION SELECT DISTINCT story_id, target_event_id, source_event_id FROM q_valid_rel)"""


@register("event_adjacency", "WITH " + Q_ADJ.strip() + "\nSELECT * FROM q_adj")
def event_adjacency(spark, sf):
    _, _, rel = _parts(spark, sf)
    return W.event_adjacency(rel)


@register("reading_order", "SELECT story_id, pos, chapter_pos, chapter_id, idx, sub_event_id FROM fx_reading")
def reading_order(spark, sf):
    return W.reading_order(fx(spark, sf).chapters)


@register("sub_event_lookup", """
SELECT r.story_id, r.pos, r.sub_event_id, s.sub_seq, s.parent_event_id
FROM fx_reading r JOIN fx_sub_events s ON s.story_id = r.story_id AND s.sub_event_id = r.sub_event_id""")
def sub_event_lookup(spark, sf):
    f, slots, _ = _parts(spark, sf)
    return W.sub_event_lookup(slots.select("story_id", "pos", "sub_event_id"),
                              f.sub_events.select("story_id", "sub_event_id", "sub_seq", "parent_event_id"))


@register("unknown_sub_events", """
SELECT r.story_id, r.pos, r.sub_event_id FROM fx_reading r
WHERE NOT EXISTS (SELECT 1 FROM fx_sub_events s WHERE s.story_id = r.story_id AND s.sub_event_id = r.sub_event_id)""")
def unknown_sub_events(spark, sf):
    f, slots, _ = _parts(spark, sf)
    return W.unknown_sub_events(slots.select("story_id", "pos", "sub_event_id"), f.sub_events)


@register("chapter_range", f"""
SELECT story_id, chapter_pos, chapter_id, title FROM fx_chapters WHERE chapter_id BETWEEN {RANGE_LO} AND {RANGE_HI}""")
def chapter_range(spark, sf):
    c = W.chapter_range(fx(spark, sf).chapters, RANGE_LO, RANGE_HI)
    return c.select("story_id", "chapter_pos", "chapter_id", "title")


@register("next_chapter_title", f"""
SELECT story_id, chapter_pos, chapter_id, title,
       coalesce(lead(title) OVER (PARTITION BY story_id ORDER BY chapter_pos), '{W.NO_MORE_CHAPTERS}') AS next_title
FROM fx_chapters WHERE chapter_id BETWEEN {RANGE_LO} AND {RANGE_HI}""")
def next_chapter_title(spark, sf):
    return W.next_chapter_title(W.chapter_range(fx(spark, sf).chapters, RANGE_LO, RANGE_HI))


Q_SLOTS = f"""
q_slot AS (
  SELECT r.story_id, r.pos, r.sub_event_id, s.parent_event_id FROM fx_reading r
  JOIN fx_sub_events s ON s.story_id = r.story_id AND s.sub_event_id = r.sub_event_id),
q_parent AS (
  SELECT q.*, CASE WHEN e.event_id IS NULL THEN NULL ELSE {EVENT_JSON_SQL} END AS parent_json FROM q_slot q
  LEFT JOIN fx_events e ON e.story_id = q.story_id AND e.event_id = q.parent_event_id)"""


@register("context_parent", "WITH " + Q_SLOTS.strip() + "\nSELECT * FROM q_parent")
def context_parent(spark, sf):
    f, slots, _ = _parts(spark, sf)
    return W.context_parent(slots.select("story_id", "pos", "sub_event_id"), f.sub_events, f.events)


Q_NEIGH = Q_SLOTS + "," + Q_ADJ + f""",
q_neigh AS (
  SELECT p.story_id, p.pos, p.parent_event_id, a.neighbour_id, e.event_seq AS neighbour_seq,
         {EVENT_JSON_SQL} AS neighbour_json
  FROM q_parent p JOIN q_adj a ON a.story_id = p.story_id AND a.event_id = p.parent_event_id
  JOIN fx_events e ON e.story_id = a.story_id AND e.event_id = a.neighbour_id
  WHERE p.parent_json IS NOT NULL)"""


@register("context_neighbours", "WITH " + Q_NEIGH.strip() + """
SELECT story_id, pos, parent_event_id, neighbour_id, neighbour_seq FROM q_neigh""")
def context_neighbours(spark, sf):
    f, slots, rel = _parts(spark, sf)
    n = W.context_neighbours(slots.select("story_id", "pos", "sub_event_id"), f.sub_events, f.events, rel)
    return n.select("story_id", "pos", "parent_event_id", "neighbour_id", "neighbour_seq")


PASSAGE_JSON_SQL = ("to_json({'sub_event_id': p.sub_event_id, 'context_snapshot': {'summary_text': p.summary_text, "
                    "'relevance_score': p.relevance_score}, 'raw_text': p.raw_text, 'revision_result': "
                    "{'suggestions': p.suggestions, 'issues': p.issues, 'revised_text': p.revised_text, "
                    "'confidence': p.confidence}, 'timestamp': CAST(NULL AS VARCHAR)})")
Q_SIBS = Q_NEIGH + f""",
q_pairs AS (
  SELECT p.story_id, p.pos, p.sub_event_id, p.parent_event_id, s.sub_event_id AS sibling_id,
         s.sub_seq AS sibling_seq, {SUB_JSON_SQL} AS sibling_json
  FROM q_parent p JOIN fx_sub_events s ON s.story_id = p.story_id AND s.parent_event_id = p.parent_event_id
  WHERE p.parent_json IS NOT NULL AND s.sub_event_id <> p.sub_event_id),
q_vis AS (
  SELECT q.story_id, q.pos, q.sibling_id, max(p.pos) AS visible_pos, arg_max({PASSAGE_JSON_SQL}, p.pos) AS visible_json
  FROM q_pairs q JOIN fx_passages p ON p.story_id = q.story_id AND p.sub_event_id = q.sibling_id AND p.pos < q.pos
  GROUP BY q.story_id, q.pos, q.sibling_id),
q_sibs AS (
  SELECT q.*, v.visible_pos, v.visible_json FROM q_pairs q
  LEFT JOIN q_vis v ON v.story_id = q.story_id AND v.pos = q.pos AND v.sibling_id = q.sibling_id)"""


@register("context_siblings", "WITH " + Q_SIBS.strip() + """
SELECT story_id, pos, sub_event_id, parent_event_id, sibling_id, sibling_seq, visible_pos FROM q_sibs""")
def context_siblings(spark, sf):
    f, slots, _ = _parts(spark, sf)
    s = W.context_siblings(slots.select("story_id", "pos", "sub_event_id"), f.sub_events, f.events, f.passages)
    return s.select("story_id", "pos", "sub_event_id", "parent_event_id", "sibling_id", "sibling_seq",
                    "visible_pos")


Q_CONTEXT = Q_SIBS.strip() + """,
q_parts AS (
  SELECT story_id, pos, 0 AS part, 0 AS seq, 0 AS sub, parent_json AS text FROM q_parent WHERE parent_json IS NOT NULL
  UNION ALL SELECT story_id, pos, 1, neighbour_seq, 0, neighbour_json FROM q_neigh
  UNION ALL SELECT story_id, pos, 2, sibling_seq, 0, sibling_json FROM q_sibs
  UNION ALL SELECT story_id, pos, 2, sibling_seq, 1, visible_json FROM q_sibs WHERE visible_json IS NOT NULL),
q_ctx AS (SELECT story_id, pos, string_agg(text, chr(10) ORDER BY part, seq, sub) AS context FROM q_parts
          GROUP BY story_id, pos)"""


@register("context_text", "WITH " + Q_CONTEXT + """
SELECT p.story_id, p.pos, p.sub_event_id, md5(coalesce(c.context, '')) AS context_md5,
       length(coalesce(c.context, '')) AS context_len
FROM q_parent p LEFT JOIN q_ctx c ON c.story_id = p.story_id AND c.pos = p.pos""")
def context_text(spark, sf):
    f, slots, rel = _parts(spark, sf)
    c = W.context_text(slots.select("story_id", "pos", "sub_event_id"), f.sub_events, f.events, rel, f.passages)
    return c.select("story_id", "pos", "sub_event_id", F.md5("context").alias("context_md5"),
                    F.length("context").cast("long").alias("context_len"))


@register("passage_latest", """
SELECT story_id, sub_event_id, pos,
       lag(pos) OVER (PARTITION BY story_id, sub_event_id ORDER BY pos) AS prev_pos,
       lead(pos) OVER (PARTITION BY story_id, sub_event_id ORDER BY pos) IS NULL AS is_latest
FROM fx_reading""")
def passage_latest(spark, sf):
    _, slots, _ = _parts(spark, sf)
    return W.passage_latest(slots)


@register("writing_waves", """
SELECT r.story_id, r.pos, r.sub_event_id, s.parent_event_id,
       row_number() OVER (PARTITION BY r.story_id, s.parent_event_id ORDER BY r.pos) AS wave
FROM fx_reading r JOIN fx_sub_events s ON s.story_id = r.story_id AND s.sub_event_id = r.sub_event_id""")
def writing_waves(spark, sf):
    f, slots, _ = _parts(spark, sf)
    return W.writing_waves(slots.select("story_id", "pos", "sub_event_id"), f.sub_events)


@register("passage_record", f"SELECT p.story_id, p.pos, {PASSAGE_JSON_SQL} AS passage_json FROM fx_passages p")
def passage_record(spark, sf):
    p = fx(spark, sf).passages
    return p.select("story_id", "pos", W.passage_json(False).alias("passage_json"))


Q_CHAPTERS = f"""
q_p AS (SELECT story_id, chapter_pos, count(*) AS n_passages,
                    string_agg({PASSAGE_JSON_SQL}, ',' ORDER BY p.pos) AS pj
             FROM fx_passages p GROUP BY story_id, chapter_pos),
q_chapter AS (
  SELECT c.story_id, c.chapter_pos, c.chapter_id, coalesce(q.n_passages, 0) AS n_passages,
         concat('{{"chapter_id":', CAST(c.chapter_id AS VARCHAR), ',"title":', to_json(c.title), ',"summary":',
                to_json(c.summary), ',"sub_event_ids":', to_json(c.sub_event_ids), ',"passages":[',
                coalesce(q.pj, ''), ']}}') AS chapter_json
  FROM fx_chapters c LEFT JOIN q_p q ON q.story_id = c.story_id AND q.chapter_pos = c.chapter_pos)"""


@register("chapter_text", "WITH " + Q_CHAPTERS.strip() + "\nSELECT * FROM q_chapter")
def chapter_text(spark, sf):
    f = fx(spark, sf)
    c = W.chapter_text(f.chapters, f.passages)
    return c.select("story_id", "chapter_pos", "chapter_id", F.size("passages").cast("long").alias("n_passages"),
                    F.to_json(F.struct("chapter_id", "title", "summary", "sub_event_ids", "passages"),
                              {"ignoreNullFields": "false"}).alias("chapter_json"))


@register("final_text", """
SELECT story_id, count(*) AS n_passages,
       string_agg(coalesce(nullif(revised_text, ''), raw_text), chr(10) || chr(10) ORDER BY pos) AS final_text
FROM fx_passages GROUP BY story_id""")
def final_text(spark, sf):
    return W.final_text(fx(spark, sf).passages)
