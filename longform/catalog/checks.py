"""Quality check queries (Q1, Q2, Q4-Q25)."""

from __future__ import annotations

from pyspark.sql import functions as F

from longform.catalog import register
from longform.catalog.common import K_CANDIDATES, fx
from longform.catalog.outline import Q_VALID_REL
from longform.catalog.writing import Q_SIBS
from longform.operators import checks as Q
from longform.operators import outline as O
from longform.operators import writing as W

MENTIONS_SQL = """
q_m AS (SELECT story_id, event_id, event_seq, CAST(i - 1 AS INTEGER) AS cpos, characters[i].name AS name,
               characters[i].state AS state
        FROM (SELECT *, unnest(range(1, len(characters) + 1)) AS i FROM fx_events) x)"""
TOK = "list_distinct(list_filter(regexp_split_to_array(lower({x}), '[^a-z0-9]+'), lambda t: t <> ''))"


@register("chk_missing_elements", """
SELECT round, element, count(*) AS n
FROM (SELECT round, unnest(list_filter(string_split(missing_elements, ','), lambda x: x <> '')) AS element
      FROM fx_completeness) x GROUP BY round, element""")
def chk_missing_elements(spark, sf):
    c = fx(spark, sf).completeness.withColumn(
        "missing", F.filter(F.split("missing_elements", ","), lambda x: x != ""))
    return Q.missing_elements(c)


def _required(spark, sf):
    """Required cast of a story: the suppliers of the customer's nation."""
    c = fx(spark, sf).t("customer").select(F.col("c_custkey").alias("story_id"), "c_nationkey")
    s = fx(spark, sf).t("supplier").select("s_suppkey", F.col("s_nationkey").alias("c_nationkey"))
    return c.join(s, "c_nationkey").select(
        "story_id", F.concat(F.lit("Supplier "), F.col("s_suppkey").cast("string")).alias("name"))


@register("chk_character_coverage", "WITH " + MENTIONS_SQL.strip() + """
SELECT c.c_custkey AS story_id, concat('Supplier ', CAST(s.s_suppkey AS VARCHAR)) AS name
FROM customer c JOIN supplier s ON s.s_nationkey = c.c_nationkey
WHERE NOT EXISTS (SELECT 1 FROM q_m m WHERE m.story_id = c.c_custkey
                  AND m.name = concat('Supplier ', CAST(s.s_suppkey AS VARCHAR)))""")
def chk_character_coverage(spark, sf):
    return Q.character_coverage(_required(spark, sf), fx(spark, sf).events)


def _rel(spark, sf):
    f = fx(spark, sf)
    return O.relations_valid(f.relations, f.events)


@register("chk_isolated_events", "WITH " + Q_VALID_REL.strip() + """
SELECT e.story_id, e.event_id FROM fx_events e
WHERE NOT EXISTS (SELECT 1 FROM q_valid_rel r WHERE r.story_id = e.story_id
                  AND (r.source_event_id = e.event_id OR r.target_event_id = e.event_id))""")
def chk_isolated_events(spark, sf):
    return Q.isolated_events(fx(spark, sf).events, _rel(spark, sf))


@register("chk_components", "WITH RECURSIVE " + Q_VALID_REL.strip() + """,
q_link AS (SELECT r.story_id, a.event_seq AS x, b.event_seq AS y FROM q_valid_rel r
           JOIN fx_events a ON a.story_id = r.story_id AND a.event_id = r.source_event_id
           JOIN fx_events b ON b.story_id = r.story_id AND b.event_id = r.target_event_id),
q_both AS (SELECT story_id, x, y FROM q_link UNION SELECT story_id, y, x FROM q_link),
q_reach AS (SELECT story_id, event_seq AS x, event_seq AS y FROM fx_events
            UNION SELECT r.story_id, r.x, b.y FROM q_reach r JOIN q_both b ON b.story_id = r.story_id AND b.x = r.y),
q_part AS (SELECT story_id, x, min(y) AS first_seq, count(*) AS n_events FROM q_reach GROUP BY story_id, x)
SELECT e.story_id, e.event_id, p.first_seq, p.n_events FROM fx_events e
JOIN q_part p ON p.story_id = e.story_id AND p.x = e.event_seq""")
def chk_components(spark, sf):
    return Q.graph_components(fx(spark, sf).events, _rel(spark, sf))


@register("chk_dead_then_alive", "WITH " + MENTIONS_SQL.strip() + """,
q_d AS (SELECT story_id, name, min(event_seq) AS dead_seq FROM q_m WHERE state = 'dead' GROUP BY story_id, name)
SELECT m.story_id, m.name, m.event_seq, m.state, d.dead_seq FROM q_m m
JOIN q_d d ON d.story_id = m.story_id AND d.name = m.name WHERE m.event_seq > d.dead_seq AND m.state <> 'dead'""")
def chk_dead_then_alive(spark, sf):
    return Q.dead_then_alive(fx(spark, sf).events)


@register("chk_causal_order", "WITH " + Q_VALID_REL.strip() + """
SELECT r.story_id, r.rel_seq, r.source_event_id, r.target_event_id, s.event_seq AS src_seq, t.event_seq AS tgt_seq
FROM q_valid_rel r JOIN fx_events s ON s.story_id = r.story_id AND s.event_id = r.source_event_id
JOIN fx_events t ON t.story_id = r.story_id AND t.event_id = r.target_event_id
WHERE r.type = 'causal' AND s.event_seq > t.event_seq""")
def chk_causal_order(spark, sf):
    return Q.causal_order(fx(spark, sf).events, _rel(spark, sf))


@register("chk_state_transitions", "WITH " + MENTIONS_SQL.strip() + """
SELECT story_id, name, event_seq, prev_event_seq, prev_state, state FROM (
  SELECT *, lag(state) OVER w AS prev_state, lag(event_seq) OVER w AS prev_event_seq FROM q_m
  WINDOW w AS (PARTITION BY story_id, name ORDER BY event_seq, cpos)) x
WHERE prev_state IS NOT NULL AND state <> prev_state""")
def chk_state_transitions(spark, sf):
    return Q.state_transitions(fx(spark, sf).events)


@register("chk_score_range", """
SELECT story_id, event_id, score_name, score FROM (
  SELECT story_id, event_id, 'novelty_score' AS score_name, novelty_score AS score FROM fx_events
  UNION ALL SELECT story_id, event_id, 'coherence_score', coherence_score FROM fx_events) u
WHERE score < 0 OR score > 1""")
def chk_score_range(spark, sf):
    return Q.score_range(fx(spark, sf).events)


@register("chk_required_fields", """
SELECT story_id, event_id, field FROM (
  SELECT story_id, event_id, 'time' AS field, trim(time) = '' AS empty FROM fx_events
  UNION ALL SELECT story_id, event_id, 'location', trim(location) = '' FROM fx_events
  UNION ALL SELECT story_id, event_id, 'goal', trim(goal) = '' FROM fx_events
  UNION ALL SELECT story_id, event_id, 'conflict', trim(conflict) = '' FROM fx_events
  UNION ALL SELECT story_id, event_id, 'characters', len(characters) = 0 FROM fx_events) u WHERE empty""")
def chk_required_fields(spark, sf):
    return Q.required_fields(fx(spark, sf).events)


@register("chk_candidate_cap", f"""
SELECT story_id, round, val_iter, count(*) AS n, count(*) > {K_CANDIDATES} AS over_cap
FROM fx_candidates GROUP BY story_id, round, val_iter""")
def chk_candidate_cap(spark, sf):
    return Q.candidate_cap(fx(spark, sf).candidates, K_CANDIDATES)


@register("chk_duplicate_relations", """
SELECT story_id, source_event_id, target_event_id, type, count(*) AS n FROM fx_relations
GROUP BY story_id, source_event_id, target_event_id, type HAVING count(*) > 1""")
def chk_duplicate_relations(spark, sf):
    return Q.duplicate_relations(fx(spark, sf).relations)


@register("chk_one_verdict", """
SELECT coalesce(c.story_id, v.story_id) AS story_id, coalesce(c.round, v.round) AS round,
       coalesce(c.val_iter, v.val_iter) AS val_iter, coalesce(c.event_id, v.event_id) AS event_id,
       coalesce(c.n, 0) AS n_candidates, coalesce(v.n, 0) AS n_verdicts
FROM (SELECT story_id, round, val_iter, event_id, count(*) AS n FROM fx_candidates GROUP BY ALL) c
FULL JOIN (SELECT story_id, round, val_iter, event_id, count(*) AS n FROM fx_verdicts GROUP BY ALL) v
  ON v.story_id = c.story_id AND v.round = c.round AND v.val_iter = c.val_iter AND v.event_id = c.event_id
WHERE coalesce(c.n, 0) <> coalesce(v.n, 0) OR coalesce(v.n, 0) <> 1""")
def chk_one_verdict(spark, sf):
    f = fx(spark, sf)
    return Q.one_verdict(f.candidates, f.verdicts)


@register("chk_sub_event_count", """
SELECT e.story_id, e.event_id, coalesce(n.n, 0) AS n_sub_events,
       CASE WHEN coalesce(n.n, 0) < 3 THEN 'too few' ELSE 'too many' END AS verdict
FROM fx_events e LEFT JOIN (SELECT story_id, parent_event_id, count(*) AS n FROM fx_sub_events GROUP BY ALL) n
  ON n.story_id = e.story_id AND n.parent_event_id = e.event_id
WHERE coalesce(n.n, 0) < 3 OR coalesce(n.n, 0) > 5""")
def chk_sub_event_count(spark, sf):
    f = fx(spark, sf)
    return Q.sub_event_count(f.events, f.sub_events)


@register("chk_sub_event_characters", """
SELECT s.story_id, s.sub_event_id, unnest(list_filter(list_distinct(list_transform(s.characters, lambda c: c.name)),
       lambda x: NOT list_contains(list_transform(e.characters, lambda c: c.name), x))) AS name
FROM fx_sub_events s JOIN fx_events e ON e.story_id = s.story_id AND e.event_id = s.parent_event_id""")
def chk_sub_event_characters(spark, sf):
    f = fx(spark, sf)
    return Q.sub_event_characters(f.sub_events, f.events)


@register("chk_plan_coverage", """
SELECT coalesce(s.story_id, r.story_id) AS story_id, coalesce(s.sub_event_id, r.sub_event_id) AS sub_event_id,
       coalesce(r.n, 0) AS n_slots,
       CASE WHEN s.sub_event_id IS NULL THEN 'unknown' WHEN coalesce(r.n, 0) = 0 THEN 'unplaced' ELSE 'repeated' END AS status
FROM fx_sub_events s
FULL JOIN (SELECT story_id, sub_event_id, count(*) AS n FROM fx_reading GROUP BY ALL) r
  ON r.story_id = s.story_id AND r.sub_event_id = s.sub_event_id
WHERE s.sub_event_id IS NULL OR coalesce(r.n, 0) <> 1""")
def chk_plan_coverage(spark, sf):
    f = fx(spark, sf)
    return Q.plan_coverage(f.sub_events, W.reading_order(f.chapters))


@register("chk_nonlinear_order", """
SELECT story_id, pos, sub_seq, prior_max FROM (
  SELECT r.story_id, r.pos, s.sub_seq,
         max(s.sub_seq) OVER (PARTITION BY r.story_id ORDER BY r.pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
           AS prior_max
  FROM fx_reading r JOIN fx_sub_events s ON s.story_id = r.story_id AND s.sub_event_id = r.sub_event_id) x
WHERE sub_seq < prior_max""")
def chk_nonlinear_order(spark, sf):
    f = fx(spark, sf)
    slots = W.reading_order(f.chapters).join(f.sub_events.select("story_id", "sub_event_id", "sub_seq"),
                                             ["story_id", "sub_event_id"])
    return Q.nonlinear_order(slots.select("story_id", "pos", "sub_seq"))


@register("chk_chapter_sizes", """
SELECT story_id, count(*) AS n_chapters, min(len(sub_event_ids)) AS min_size, max(len(sub_event_ids)) AS max_size,
       round(avg(len(sub_event_ids)), 6) AS avg_size
FROM fx_chapters GROUP BY story_id""")
def chk_chapter_sizes(spark, sf):
    return Q.chapter_sizes(fx(spark, sf).chapters)


@register("chk_repeated_sentences", """
SELECT story_id, pos, sentence, count(*) AS n FROM (
  SELECT story_id, pos, regexp_replace(trim(unnest(string_split(raw_text, '. '))), '\\.$', '') AS sentence
  FROM fx_passages) x GROUP BY story_id, pos, sentence HAVING count(*) > 1""")
def chk_repeated_sentences(spark, sf):
    return Q.repeated_sentences(fx(spark, sf).passages)


@register("chk_wrong_names", "WITH " + MENTIONS_SQL.strip() + """,
q_named AS (SELECT DISTINCT story_id, pos, sub_event_id,
                   unnest(regexp_extract_all(raw_text, '(Supplier [0-9]+)', 1)) AS name FROM fx_passages)
SELECT n.story_id, n.pos, n.sub_event_id, n.name FROM q_named n
WHERE EXISTS (SELECT 1 FROM q_m m WHERE m.story_id = n.story_id AND m.name = n.name)
  AND NOT EXISTS (SELECT 1 FROM fx_sub_events s WHERE s.story_id = n.story_id AND s.sub_event_id = n.sub_event_id
                  AND list_contains(list_transform(s.characters, lambda c: c.name), n.name))""")
def chk_wrong_names(spark, sf):
    f = fx(spark, sf)
    return Q.wrong_names(f.passages, f.sub_events, f.events).select("story_id", "pos", "sub_event_id", "name")


# Names of one, two and three words, by the last digit of the supplier.
RENAMES = ((r"Supplier ([0-9]*[012])\b", "S"), (r"Supplier ([0-9]*[6-9])\b", "Old Supplier "))


def _renamed_sql(x: str) -> str:
    for pattern, to in RENAMES:
        x = f"regexp_replace({x}, '{pattern}', '{to}\\1', 'g')"
    return x


def _renamed(x):
    for pattern, to in RENAMES:
        x = F.regexp_replace(x, pattern, f"{to}$1")
    return x


@register("chk_wrong_names_any", "WITH " + MENTIONS_SQL.strip() + f""",
q_cast AS (SELECT DISTINCT story_id, {_renamed_sql('name')} AS name FROM q_m),
q_text AS (SELECT story_id, pos, sub_event_id,
                  concat(' ', regexp_replace({_renamed_sql('raw_text')}, '[^A-Za-z0-9]+', ' ', 'g'), ' ') AS t FROM fx_passages)
SELECT p.story_id, p.pos, p.sub_event_id, c.name FROM q_text p JOIN q_cast c ON c.story_id = p.story_id
 AND contains(p.t, concat(' ', c.name, ' '))
WHERE NOT EXISTS (SELECT 1 FROM fx_sub_events s WHERE s.story_id = p.story_id AND s.sub_event_id = p.sub_event_id
  AND list_contains(list_transform(s.characters, lambda x: {_renamed_sql('x.name')}), c.name))""")
def chk_wrong_names_any(spark, sf):
    """Q22 with names of one to three words."""
    f = fx(spark, sf)
    cast = F.transform("characters", lambda c: c.withField("name", _renamed(c["name"])))
    p = f.passages.withColumn("raw_text", _renamed(F.col("raw_text")))
    r = Q.wrong_names(p, f.sub_events.withColumn("characters", cast), f.events.withColumn("characters", cast))
    return r.select("story_id", "pos", "sub_event_id", "name")


@register("chk_edit_size", f"""
SELECT story_id, pos, CAST(len(list_filter(a, lambda x: NOT list_contains(b, x))) AS BIGINT) AS n_removed,
       CAST(len(list_filter(b, lambda x: NOT list_contains(a, x))) AS BIGINT) AS n_added
FROM (SELECT story_id, pos, {TOK.format(x='raw_text')} AS a, {TOK.format(x='revised_text')} AS b
      FROM fx_passages WHERE revised_text <> '') x""")
def chk_edit_size(spark, sf):
    return Q.edit_size(fx(spark, sf).passages)


@register("chk_issue_tally", "SELECT issue, count(*) AS n FROM (SELECT unnest(issues) AS issue FROM fx_passages) x "
                             "GROUP BY issue")
def chk_issue_tally(spark, sf):
    return Q.issue_tally(fx(spark, sf).passages)


@register("chk_low_confidence", "SELECT story_id, pos, sub_event_id, confidence FROM fx_passages WHERE confidence < 0.3")
def chk_low_confidence(spark, sf):
    return Q.low_confidence(fx(spark, sf).passages, 0.3)


@register("chk_realization", f"""
SELECT p.story_id, p.pos,
       round(len(list_filter(w.want, lambda x: list_contains(p.have, x))) / len(w.want), 6) AS coverage
FROM (SELECT story_id, pos, sub_event_id, {TOK.format(x='raw_text')} AS have FROM fx_passages) p
JOIN (SELECT story_id, sub_event_id, {TOK.format(x='summary')} AS want FROM fx_sub_events) w
  ON w.story_id = p.story_id AND w.sub_event_id = p.sub_event_id""")
def chk_realization(spark, sf):
    f = fx(spark, sf)
    return Q.realization(f.passages, f.sub_events)


@register("chk_near_duplicates", f"""
WITH q_w AS (SELECT story_id, event_seq, event_id,
                    {TOK.format(x="concat_ws(' ', title, summary, location, goal, conflict)")} AS w FROM fx_events),
q_p AS (SELECT a.story_id, a.event_id AS event_a, b.event_id AS event_b, len(a.w) + len(b.w) AS total,
               len(list_intersect(a.w, b.w)) AS shared
        FROM q_w a JOIN q_w b ON b.story_id = a.story_id AND b.event_seq > a.event_seq)
SELECT story_id, event_a, event_b, shared, total - shared AS words FROM q_p WHERE shared * 10 > (total - shared) * 8""")
def chk_near_duplicates(spark, sf):
    return Q.near_duplicate_events(fx(spark, sf).events)


def _siblings(spark, sf):
    f = fx(spark, sf)
    slots = W.reading_order(f.chapters).select("story_id", "pos", "sub_event_id")
    return slots, W.context_siblings(slots, f.sub_events, f.events, f.passages)


Q_HISTORY = Q_SIBS.strip() + """,
q_hist AS (SELECT q.story_id, q.pos, q.sub_event_id, q.sibling_seq, p.raw_text AS history FROM q_sibs q
           JOIN fx_passages p ON p.story_id = q.story_id AND p.pos = q.visible_pos)"""


@register("chk_repeated_in_context", "WITH " + Q_SIBS.strip() + """,
q_s AS (SELECT DISTINCT story_id, pos, regexp_replace(trim(unnest(string_split(raw_text, '. '))), '\\.$', '') AS sentence
        FROM fx_passages)
SELECT a.story_id, a.pos, a.sentence, count(*) AS n_earlier FROM q_s a
JOIN q_sibs q ON q.story_id = a.story_id AND q.pos = a.pos AND q.visible_pos IS NOT NULL
JOIN q_s b ON b.story_id = a.story_id AND b.pos = q.visible_pos AND b.sentence = a.sentence
GROUP BY a.story_id, a.pos, a.sentence""")
def chk_repeated_in_context(spark, sf):
    """Q21 against the passages that a slot can see."""
    _, sib = _siblings(spark, sf)
    return Q.repeated_in_context(fx(spark, sf).passages, sib)


@register("extract_summary", "WITH " + Q_HISTORY + f""",
q_sent AS (SELECT *, unnest(string_split(history, '. ')) AS sentence,
                  unnest(range(0, len(string_split(history, '. ')))) AS idx FROM q_hist),
q_want AS (SELECT story_id, sub_event_id, {TOK.format(x="concat_ws(' ', title, summary)")} AS want FROM fx_sub_events),
q_score AS (SELECT q.*, len(w.want) AS n, len(list_intersect({TOK.format(x='q.sentence')}, w.want)) AS shared
            FROM q_sent q JOIN q_want w USING (story_id, sub_event_id)),
q_top AS (SELECT *, row_number() OVER (PARTITION BY story_id, pos ORDER BY shared DESC, sibling_seq, idx) AS k
          FROM q_score WHERE shared > 0)
SELECT story_id, pos, count(*) AS n_sentences, string_agg(sentence, ' | ' ORDER BY sibling_seq, idx) AS summary,
       max(shared / n) AS relevance FROM q_top WHERE k <= 3 GROUP BY story_id, pos""")
def extract_summary(spark, sf):
    f = fx(spark, sf)
    slots, sib = _siblings(spark, sf)
    return Q.extract_summary(sib, f.passages, slots, f.sub_events)


@register("chk_summary_new_facts", "WITH " + Q_HISTORY + f""",
q_known AS (SELECT DISTINCT story_id, pos, unnest({TOK.format(x='history')}) AS word FROM q_hist),
q_said AS (SELECT story_id, pos, unnest({TOK.format(x='summary_text')}) AS word FROM fx_passages),
q_n AS (SELECT s.story_id, s.pos, count(*) AS n_words, count(*) - count(k.word) AS n_new FROM q_said s
        LEFT JOIN q_known k ON k.story_id = s.story_id AND k.pos = s.pos AND k.word = s.word
        GROUP BY s.story_id, s.pos)
SELECT story_id, pos, n_words, n_new, n_new / n_words AS new_share FROM q_n""")
def chk_summary_new_facts(spark, sf):
    _, sib = _siblings(spark, sf)
    return Q.summary_new_facts(sib, fx(spark, sf).passages)


@register("chk_causal_chain", "WITH RECURSIVE " + Q_VALID_REL.strip() + """,
q_link AS (SELECT DISTINCT r.story_id, a.event_seq AS seq_from, b.event_seq AS seq_to FROM q_valid_rel r
           JOIN fx_events a ON a.story_id = r.story_id AND a.event_id = r.source_event_id
           JOIN fx_events b ON b.story_id = r.story_id AND b.event_id = r.target_event_id
           WHERE r.type = 'causal' AND a.event_seq < b.event_seq),
q_chain AS (SELECT story_id, seq_from AS seq_at, CAST(0 AS BIGINT) AS n FROM q_link
            UNION SELECT c.story_id, l.seq_to, c.n + 1 FROM q_chain c
            JOIN q_link l ON l.story_id = c.story_id AND l.seq_from = c.seq_at)
SELECT story_id, max(n) AS n_links, max(n) + 1 AS n_events FROM q_chain GROUP BY story_id""")
def chk_causal_chain(spark, sf):
    return Q.causal_chain(_rel(spark, sf), fx(spark, sf).events)


@register("chk_passage_scores", """
SELECT story_id, pos, score_name, score FROM (
  SELECT story_id, pos, 'relevance_score' AS score_name, relevance_score AS score FROM fx_passages
  UNION ALL SELECT story_id, pos, 'confidence', confidence FROM fx_passages) u
WHERE score < 0 OR score > 1""")
def chk_passage_scores(spark, sf):
    return Q.passage_score_range(fx(spark, sf).passages)


@register("chk_order_jumps", """
SELECT * FROM (
  SELECT story_id, pos, sub_seq, coalesce(sub_seq < prior_max, false) AS flashback,
         coalesce(sub_seq > later_min, false) AS flash_forward FROM (
    SELECT r.story_id, r.pos, s.sub_seq,
           max(s.sub_seq) OVER (PARTITION BY r.story_id ORDER BY r.pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
             AS prior_max,
           min(s.sub_seq) OVER (PARTITION BY r.story_id ORDER BY r.pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)
             AS later_min
    FROM fx_reading r JOIN fx_sub_events s ON s.story_id = r.story_id AND s.sub_event_id = r.sub_event_id) x) y
WHERE flashback OR flash_forward""")
def chk_order_jumps(spark, sf):
    f = fx(spark, sf)
    slots = W.reading_order(f.chapters).join(f.sub_events.select("story_id", "sub_event_id", "sub_seq"),
                                             ["story_id", "sub_event_id"])
    return Q.order_jumps(slots.select("story_id", "pos", "sub_seq"))


@register("chk_chapter_spread", """
SELECT story_id, count(*) AS n_chapters, round(stddev_pop(len(sub_event_ids)), 6) AS stddev_size,
       round(quantile_cont(len(sub_event_ids), 0.5), 6) AS median_size,
       round(quantile_cont(len(sub_event_ids), 0.9), 6) AS p90_size
FROM fx_chapters GROUP BY story_id""")
def chk_chapter_spread(spark, sf):
    return Q.chapter_spread(fx(spark, sf).chapters)
