"""Ledger queries (M1-M3) on the completeness requests of every story, with the md5 stand-in model."""

from __future__ import annotations

from pyspark.sql import functions as F

from longform.catalog import register
from longform.catalog.common import fx
from longform.catalog.prompts import EVENTS_TEXT_SQL
from longform.operators import ledger as M
from longform.operators import prompts as T

FAKE_SQL = ("concat('{\"stage\":\"', stage, '\",\"ok\":', CASE WHEN substr(md5(p), 1, 1) IN "
            "('0','1','2','3','4','5','6','7') THEN 'true' ELSE 'false' END, ',\"tag\":\"', substr(md5(p), 1, 8), '\"}')")
REQ_SQL = "WITH " + EVENTS_TEXT_SQL.strip() + f""",
q_req AS (SELECT 'completeness' AS stage, s.story_id, s.premise,
                 {T.render_sql('completeness', {'premise': 's.premise', 'events': 't.events'})} AS p
          FROM fx_stories s LEFT JOIN q_evtext t USING (story_id)),
q_resp AS (SELECT stage, sha256(p) AS prompt_hash, 1 AS response_seq, {FAKE_SQL} AS response_text FROM q_req
           WHERE premise NOT LIKE '%MACHINERY'
           UNION ALL
           SELECT stage, sha256(p), 2, concat('retry ', {FAKE_SQL}) FROM q_req WHERE premise LIKE '%BUILDING')
"""


def _fake_col(stage, prompt):
    h = F.md5(prompt)
    ok = F.when(F.substring(h, 1, 1).isin(*"01234567"), F.lit("true")).otherwise(F.lit("false"))
    return F.concat(F.lit('{"stage":"'), stage, F.lit('","ok":'), ok, F.lit(',"tag":"'), F.substring(h, 1, 8),
                    F.lit('"}'))


def _req_resp(spark, sf):
    f = fx(spark, sf)
    req = T.req_completeness(f.stories, f.events).join(f.stories.select("story_id", "premise"), "story_id")
    r1 = req.where(~F.col("premise").endswith("MACHINERY")).select(
        "stage", "prompt_hash", F.lit(1).alias("response_seq"), _fake_col(F.col("stage"), F.col("prompt"))
        .alias("response_text"))
    r2 = req.where(F.col("premise").endswith("BUILDING")).select(
        "stage", "prompt_hash", F.lit(2).alias("response_seq"),
        F.concat(F.lit("retry "), _fake_col(F.col("stage"), F.col("prompt"))).alias("response_text"))
    return req.drop("premise"), r1.unionByName(r2)


@register("ledger_pending", REQ_SQL + """
SELECT q.stage, q.story_id, sha256(q.p) AS prompt_hash FROM q_req q
WHERE NOT EXISTS (SELECT 1 FROM q_resp r WHERE r.stage = q.stage AND r.prompt_hash = sha256(q.p))""")
def ledger_pending(spark, sf):
    req, resp = _req_resp(spark, sf)
    return M.pending(req, resp).select("stage", "story_id", "prompt_hash")


@register("ledger_replay", REQ_SQL + """
SELECT q.stage, q.story_id, r.prompt_hash, r.response_text FROM q_req q
JOIN (SELECT stage, prompt_hash, arg_max(response_text, response_seq) AS response_text FROM q_resp
      GROUP BY stage, prompt_hash) r ON r.stage = q.stage AND r.prompt_hash = sha256(q.p)""")
def ledger_replay(spark, sf):
    req, resp = _req_resp(spark, sf)
    return M.replay(req, resp).select("stage", "story_id", "prompt_hash", "response_text")


@register("ledger_call_fake", REQ_SQL + f"""
SELECT stage, story_id, sha256(p) AS prompt_hash, {FAKE_SQL} AS response_text FROM q_req""")
def ledger_call_fake(spark, sf):
    f = fx(spark, sf)
    req = T.req_completeness(f.stories, f.events)
    out = M.call(req.select("stage", "story_id", "prompt_hash", "prompt"), M.fake_model)
    return out.select("stage", "story_id", "prompt_hash", "response_text")
