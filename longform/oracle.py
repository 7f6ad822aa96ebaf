"""DuckDB oracle SQL: the fixture views as CTEs plus one statement per registered query.

Each oracle statement is written independently of the Spark operators (window functions and joins in plain
SQL), over the same driver tables. ``sql(name)`` returns a single ``WITH … SELECT`` statement carrying only the
fixture CTEs the query needs.
"""

from __future__ import annotations

import re

STATE = "CASE l_returnflag WHEN 'R' THEN 'dead' WHEN 'A' THEN 'wounded' ELSE 'healthy' END"

FIXTURE_CTES: dict[str, str] = {
    "fx_stories": """
SELECT c_custkey AS story_id, concat(c_name, ' in ', c_mktsegment) AS premise FROM customer""",
    "fx_orders": """
SELECT o_custkey AS story_id, o_orderkey, o_orderstatus, o_orderdate, o_orderpriority,
       concat('E', CAST(o_orderkey AS VARCHAR)) AS event_key,
       concat('E', CAST(o_orderkey % 7 AS VARCHAR)) AS event_id,
       row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS event_seq
FROM orders""",
    "fx_event_cast": f"""
SELECT l_orderkey, list({{'name': concat('Supplier ', CAST(l_suppkey AS VARCHAR)), 'role': l_linestatus,
                         'state': {STATE}}} ORDER BY l_linenumber, l_partkey, l_suppkey) AS characters
FROM lineitem GROUP BY l_orderkey""",
    "fx_event_detail": """
SELECT o.o_orderkey, o.o_orderpriority AS title,
       concat('Order ', CAST(o.o_orderkey AS VARCHAR), ' placed by customer ', CAST(o.o_custkey AS VARCHAR)) AS summary,
       CAST(CAST(o.o_orderdate AS DATE) AS VARCHAR) AS time,
       CASE WHEN o.o_orderkey % 13 = 0 THEN '' ELSE concat('Port ', CAST(o.o_orderkey % 9 AS VARCHAR)) END AS location,
       coalesce(c.characters, CAST([] AS STRUCT(name VARCHAR, role VARCHAR, state VARCHAR)[])) AS characters,
       concat('Deliver order ', CAST(o.o_orderkey AS VARCHAR)) AS goal,
       CASE WHEN o.o_orderkey % 17 = 0 THEN '' WHEN o.o_orderstatus = 'F' THEN 'none'
            WHEN o.o_orderstatus = 'O' THEN 'delay' ELSE 'dispute' END AS conflict,
       CAST(o.o_orderkey % 101 AS DOUBLE) / 100 AS novelty_score,
       CAST(o.o_orderkey % 113 AS DOUBLE) / 100 AS coherence_score
FROM orders o LEFT JOIN fx_event_cast c ON c.l_orderkey = o.o_orderkey""",
    "fx_candidates": """
SELECT story_id, CAST(floor((event_seq - 1) / 3) AS INTEGER) AS round, 0 AS val_iter,
       CAST((event_seq - 1) % 3 AS INTEGER) AS pos, event_id, event_key, o_orderkey
FROM fx_orders
UNION ALL
SELECT story_id, CAST(floor((event_seq - 1) / 3) AS INTEGER), 1, CAST((event_seq - 1) % 3 AS INTEGER),
       event_id, event_key, o_orderkey
FROM fx_orders WHERE o_orderstatus = 'O' AND o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM')""",
    "fx_candidate_records": """
SELECT c.story_id, c.round, c.val_iter, c.pos, c.event_id, c.event_key, c.o_orderkey,
       CASE WHEN c.val_iter > 0 THEN concat(d.title, ' (revised)') ELSE d.title END AS title,
       d.summary, d.time, d.location, d.characters, d.goal, d.conflict, d.novelty_score, d.coherence_score
FROM fx_candidates c JOIN fx_event_detail d ON d.o_orderkey = c.o_orderkey""",
    "fx_verdicts": """
SELECT *, CASE WHEN valid THEN '' ELSE concat('rework ', event_id) END AS suggestion FROM (
SELECT story_id, CAST(floor((event_seq - 1) / 3) AS INTEGER) AS round, 0 AS val_iter,
       CAST((event_seq - 1) % 3 AS INTEGER) AS pos, event_id, o_orderstatus = 'F' AS valid
FROM fx_orders WHERE o_orderstatus <> 'P'
UNION ALL
SELECT story_id, CAST(floor((event_seq - 1) / 3) AS INTEGER), 1, CAST((event_seq - 1) % 3 AS INTEGER),
       event_id, o_orderkey % 3 <> 0
FROM fx_orders WHERE o_orderstatus = 'O' AND o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM')) v""",
    "fx_completeness": """
SELECT story_id, round, complete,
       CASE WHEN complete THEN 'arc closed' ELSE concat('round ', CAST(round AS VARCHAR), ' open') END AS reason,
       missing_elements
FROM (SELECT DISTINCT story_id, round, (story_id * 7919 + round * 31) % 11 = 0 AS complete,
             CASE (story_id + round) % 4 WHEN 0 THEN '' WHEN 1 THEN 'climax' WHEN 2 THEN 'climax,resolution'
               ELSE 'character arcs' END AS missing_elements
      FROM fx_candidates) c""",
    "fx_part_events": """
SELECT story_id, l_partkey, event_key, event_seq, o_orderpriority,
       row_number() OVER (PARTITION BY story_id, l_partkey ORDER BY event_seq) AS k
FROM (SELECT DISTINCT o.story_id, l.l_partkey, o.event_key, o.event_seq, o.o_orderpriority
      FROM fx_orders o JOIN (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) l
        ON l.l_orderkey = o.o_orderkey) x""",
    "fx_relations_base": """
SELECT a.story_id, CASE WHEN a.l_partkey % 2 = 0 THEN 'causal' ELSE 'temporal' END AS type,
       a.event_key AS source_event_id, b.event_key AS target_event_id,
       concat('part ', CAST(a.l_partkey AS VARCHAR)) AS rationale,
       a.event_seq AS src_seq, b.event_seq AS tgt_seq, a.l_partkey, a.o_orderpriority AS src_priority
FROM fx_part_events a JOIN fx_part_events b
  ON b.story_id = a.story_id AND b.l_partkey = a.l_partkey AND b.k = a.k + 1""",
    "fx_relations": """
SELECT story_id, row_number() OVER (PARTITION BY story_id ORDER BY src_seq, tgt_seq, l_partkey, variant) AS rel_seq,
       type, source_event_id, target_event_id, rationale
FROM (
  SELECT story_id, type, source_event_id, target_event_id, rationale, src_seq, tgt_seq, l_partkey, 0 AS variant
  FROM fx_relations_base
  UNION ALL
  SELECT story_id, type, source_event_id, target_event_id, rationale, src_seq, tgt_seq, l_partkey, 1
  FROM fx_relations_base WHERE src_priority = '1-URGENT'
  UNION ALL
  SELECT story_id, type, target_event_id, source_event_id, rationale, src_seq, tgt_seq, l_partkey, 2
  FROM fx_relations_base WHERE src_priority = '2-HIGH'
  UNION ALL
  SELECT story_id, 'causal', event_key, event_key, 'loop', event_seq, event_seq, 0, 3
  FROM fx_orders WHERE event_seq = 1 AND o_orderpriority = '5-LOW' AND o_orderstatus = 'F') r""",
    "fx_events": """
SELECT o.story_id, o.o_orderkey, o.event_key AS event_id,
       row_number() OVER (PARTITION BY o.story_id ORDER BY o.event_seq) AS event_seq,
       d.title, d.summary, d.time, d.location, d.characters, d.goal, d.conflict, d.novelty_score, d.coherence_score
FROM fx_orders o JOIN fx_event_detail d ON d.o_orderkey = o.o_orderkey
WHERE o.o_orderstatus <> 'P'""",
    "fx_sub_events_raw": f"""
SELECT o.story_id, o.event_key AS parent_event_id, o.event_seq AS o_seq,
       concat('E', CAST(l.l_orderkey % 7 AS VARCHAR), '_S', CAST(l.l_linenumber AS VARCHAR)) AS sub_event_id,
       concat('Line ', CAST(l.l_linenumber AS VARCHAR), ' of ', o.event_key) AS title,
       concat('Supplier ', CAST(l.l_suppkey AS VARCHAR), ' ships part ', CAST(l.l_partkey AS VARCHAR)) AS summary,
       [{{'name': concat('Supplier ', CAST(l.l_suppkey AS VARCHAR)), 'role': l.l_linestatus,
          'state': {STATE}}}] AS characters,
       l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_shipdate, l.l_quantity, year(l.l_shipdate) AS chapter_id,
       row_number() OVER (PARTITION BY o.story_id ORDER BY o.event_seq, l.l_linenumber, l.l_partkey, l.l_suppkey) AS sub_seq
FROM lineitem l JOIN fx_orders o ON o.o_orderkey = l.l_orderkey""",
    "fx_sub_events": """
SELECT * REPLACE (CASE WHEN k = 1 THEN sub_event_id ELSE concat(sub_event_id, '_', CAST(k - 1 AS VARCHAR)) END
                  AS sub_event_id)
FROM (SELECT *, row_number() OVER (PARTITION BY story_id, sub_event_id ORDER BY sub_seq) AS k
      FROM fx_sub_events_raw) s""",
    "fx_plan_members": """
SELECT story_id, chapter_id, sub_event_id, l_shipdate, sub_seq, 0 AS variant FROM fx_sub_events WHERE l_quantity <> 1
UNION ALL
SELECT story_id, chapter_id + 1, sub_event_id, l_shipdate, sub_seq, 1 FROM fx_sub_events WHERE l_quantity = 50
UNION ALL
SELECT story_id, chapter_id, concat(sub_event_id, '_x'), l_shipdate, sub_seq, 2 FROM fx_sub_events WHERE l_quantity = 2""",
    "fx_chapters": """
SELECT story_id,
       row_number() OVER (PARTITION BY story_id
                          ORDER BY CASE WHEN story_id % 4 = 0 THEN -chapter_id ELSE chapter_id END) AS chapter_pos,
       CAST(chapter_id AS INTEGER) AS chapter_id, concat('Chapter ', CAST(chapter_id AS VARCHAR)) AS title,
       concat('Lines shipped in ', CAST(chapter_id AS VARCHAR)) AS summary, sub_event_ids
FROM (SELECT story_id, chapter_id, list(sub_event_id ORDER BY l_shipdate, sub_seq, variant) AS sub_event_ids
      FROM fx_plan_members GROUP BY story_id, chapter_id) c""",
    "fx_reading": """
SELECT story_id, row_number() OVER (PARTITION BY story_id ORDER BY chapter_pos, idx) AS pos,
       chapter_pos, chapter_id, idx, sub_event_id
FROM (SELECT story_id, chapter_pos, chapter_id, unnest(sub_event_ids) AS sub_event_id,
             unnest(range(1, len(sub_event_ids) + 1)) AS idx
      FROM fx_chapters) r""",
    "fx_passages": """
SELECT r.story_id, r.pos, r.chapter_pos, r.chapter_id, r.sub_event_id, s.sub_seq,
       concat('Earlier, ', p.p_name, ' was seen.') AS summary_text,
       CAST(s.sub_seq % 120 AS DOUBLE) / 100 AS relevance_score,
       concat(p.p_name, ' met ', s.characters[1].name, '. ', p.p_type, '.', ' Supplier ',
              CAST(s.l_suppkey + CASE WHEN s.sub_seq % 5 = 0 THEN 1 ELSE 0 END AS VARCHAR), ' left. ',
              p.p_name, ' met ', s.characters[1].name, '.') AS raw_text,
       concat('tighten ', p.p_type) AS suggestions,
       CASE s.sub_seq % 4 WHEN 0 THEN CAST([] AS VARCHAR[]) WHEN 1 THEN ['repetition']
            ELSE ['wrong name', 'repetition'] END AS issues,
       CASE WHEN s.sub_seq % 3 = 0 THEN '' ELSE concat(p.p_name, ' met ', s.characters[1].name, '. ', p.p_type, '.')
            END AS revised_text,
       CAST(s.sub_seq * 37 % 110 AS DOUBLE) / 100 AS confidence
FROM fx_reading r JOIN fx_sub_events s ON s.story_id = r.story_id AND s.sub_event_id = r.sub_event_id
JOIN part p ON p.p_partkey = s.l_partkey""",
    "fx_responses": """
SELECT event_id AS request_id, CASE event_id % 5
  WHEN 0 THEN props
  WHEN 1 THEN concat('```json ', props, ' ```')
  WHEN 2 THEN concat('[', props, ',{"k":"x"},7]')
  WHEN 3 THEN substr(props, 1, 4)
  ELSE concat('Sure: ', props) END AS response_text
FROM events""",
}

_NAME_RE = re.compile(r"\b(fx_[a-z_]+|q_[a-z_0-9]+)\b")


def _deps(text: str, ctes: dict[str, str]) -> list[str]:
    return [n for n in dict.fromkeys(_NAME_RE.findall(text)) if n in ctes]


def with_fixtures(body: str, extra: dict[str, str] | None = None) -> str:
    """Prefix ``body`` with the CTEs it needs (transitively), in dependency order."""
    ctes = dict(FIXTURE_CTES)
    ctes.update(extra or {})
    order: list[str] = []

    def visit(name: str, seen: set[str]) -> None:
        if name in order or name in seen:
            return
        seen.add(name)
        for d in _deps(ctes[name], ctes):
            if d != name:
                visit(d, seen)
        order.append(name)

    for n in _deps(body, ctes):
        visit(n, set())
    body = body.strip()
    if not order:
        return body
    parts = [f"{n} AS ({ctes[n].strip()})" for n in order]
    if body[:15].upper() == "WITH RECURSIVE ":
        return "WITH RECURSIVE " + ",\n".join(parts) + ",\n" + body[15:].lstrip()
    if body[:5].upper() == "WITH ":
        return "WITH " + ",\n".join(parts) + ",\n" + body[5:].lstrip()
    return "WITH " + ",\n".join(parts) + "\n" + body
