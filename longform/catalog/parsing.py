"""Parsing queries (R1-R11, S8). Responses are rendered from fixture rows as a model would send them: a JSON list
per batch, in four wrappings (plain, fenced, with chatter, cut off), with some elements of the wrong shape."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from longform.catalog import register
from longform.catalog.common import fx
from longform.operators import parse as R

JS = {"ignoreNullFields": "false"}


# ---- response rendering (Spark) ----------------------------------------------------------------------------
def _wrap(text: Column, shape: Column) -> Column:
    return (F.when(shape == 0, text)
            .when(shape == 1, F.concat(F.lit("```json\n"), text, F.lit("\n```")))
            .when(shape == 2, F.concat(F.lit("Here you go: "), text, F.lit(" Hope it helps.")))
            .otherwise(F.expr("substring(_t, 1, length(_t) - 3)")))


def _responses(df, keys, elem: Column, order: str, shape: Column):
    from longform.functions.records import ordered_text
    g = df.withColumn("_e", elem).groupBy(*keys).agg(ordered_text(F.col("_e"), F.col(order), ",").alias("_b"),
                                                      F.first(shape).alias("_shape"))
    g = g.withColumn("_t", F.concat(F.lit("["), F.col("_b"), F.lit("]")))
    return g.select(*keys, _wrap(F.col("_t"), F.col("_shape")).alias("response_text"))


# ---- response rendering (DuckDB) ---------------------------------------------------------------------------
def _resp_sql(src: str, keys: str, elem: str, order: str, shape: str) -> str:
    return f"""
SELECT {keys}, CASE shape WHEN 0 THEN t WHEN 1 THEN concat('```json' || chr(10), t, chr(10) || '```')
         WHEN 2 THEN concat('Here you go: ', t, ' Hope it helps.') ELSE substr(t, 1, length(t) - 3) END AS response_text
FROM (SELECT {keys}, concat('[', string_agg({elem}, ',' ORDER BY {order}), ']') AS t, first({shape}) AS shape
      FROM {src} GROUP BY {keys}) r"""


def _dkind(e: str, path: str) -> str:
    jt = f"json_type({e}, '{path}')"
    return (f"(CASE WHEN {jt} IS NULL THEN NULL WHEN {jt} = 'VARCHAR' THEN 'string' WHEN {jt} = 'BOOLEAN' "
            f"THEN 'boolean' WHEN {jt} = 'OBJECT' THEN 'object' WHEN {jt} = 'ARRAY' THEN 'array' "
            f"WHEN {jt} = 'NULL' THEN 'null' ELSE 'number' END)")


def _drule(e: str, name: str, kind: str) -> tuple[str, str]:
    p = f"$.{name}"
    k = _dkind(e, p)
    s = f"json_extract_string({e}, '{p}')"
    if kind == "str":
        return f"({k} = 'string')", s
    if kind == "float":
        v = (f"(CASE {k} WHEN 'number' THEN CAST(json_extract({e}, '{p}') AS DOUBLE) WHEN 'boolean' THEN "
             f"(CASE WHEN CAST(json_extract({e}, '{p}') AS BOOLEAN) THEN 1.0 ELSE 0.0 END) "
             f"WHEN 'string' THEN TRY_CAST(trim({s}) AS DOUBLE) END)")
        return f"({v} IS NOT NULL)", v
    if kind == "bool":
        tw = ", ".join(f"'{w}'" for w in R.TRUE_WORDS)
        fw = ", ".join(f"'{w}'" for w in R.FALSE_WORDS)
        d = f"CAST(json_extract({e}, '{p}') AS DOUBLE)"
        v = (f"(CASE WHEN {k} = 'boolean' THEN CAST(json_extract({e}, '{p}') AS BOOLEAN) "
             f"WHEN {k} = 'number' AND {d} = 1 THEN true WHEN {k} = 'number' AND {d} = 0 THEN false "
             f"WHEN {k} = 'string' AND lower(trim({s})) IN ({tw}) THEN true "
             f"WHEN {k} = 'string' AND lower(trim({s})) IN ({fw}) THEN false END)")
        return f"({v} IS NOT NULL)", v
    if kind == "int":
        d = f"CAST(json_extract({e}, '{p}') AS DOUBLE)"
        v = (f"(CASE WHEN {k} = 'number' AND {d} = floor({d}) THEN CAST({d} AS BIGINT) "
             f"WHEN {k} = 'boolean' THEN (CASE WHEN CAST(json_extract({e}, '{p}') AS BOOLEAN) THEN 1 ELSE 0 END) "
             f"WHEN {k} = 'string' THEN TRY_CAST(trim({s}) AS BIGINT) END)")
        return f"({v} IS NOT NULL)", v
    if kind == "list_str":
        items = f"json_extract({e}, '{p}[*]')"
        ok = (f"({k} = 'array' AND coalesce(list_bool_and(list_transform({items}, "
              f"lambda y: json_type(y) = 'VARCHAR')), true))")
        return ok, f"list_transform({items}, lambda y: json_extract_string(y, '$'))"
    if kind == "characters":
        items = f"json_extract({e}, '{p}[*]')"
        one = ("lambda y: coalesce(json_type(y) = 'OBJECT' AND json_type(y, '$.name') = 'VARCHAR' "
               "AND json_type(y, '$.role') = 'VARCHAR' AND json_type(y, '$.state') = 'VARCHAR', false)")
        ok = f"({k} = 'array' AND coalesce(list_bool_and(list_transform({items}, {one})), true))"
        return ok, f"list_transform({items}, lambda y: json_extract_string(y, '$.name'))"
    raise ValueError(kind)


def _dvalidate(e: str, spec) -> tuple[str, str, dict[str, str]]:
    oks, vals = [], {}
    for name, kind in spec:
        optional = kind.endswith("?")
        ok, val = _drule(e, name, kind.rstrip("?"))
        if optional:
            missing = f"(json_type({e}, '$.{name}') IS NULL)"
            ok = f"({missing} OR coalesce({ok}, false))"
            val = f"(CASE WHEN {missing} THEN CAST([] AS VARCHAR[]) ELSE {val} END)"
        oks.append((name, f"coalesce({ok}, false)"))
        vals[name] = val
    is_obj = f"(json_type({e}) = 'OBJECT')"
    all_ok = " AND ".join([is_obj] + [o for _, o in oks])
    reason = "CASE WHEN NOT " + is_obj + " THEN 'not an object' " + " ".join(
        f"WHEN NOT {o} THEN 'bad {n}'" for n, o in oks) + " END"
    return all_ok, reason, vals


TIER1_SQL = "CASE WHEN cleaned <> '' AND json_valid(cleaned) THEN CAST(cleaned AS JSON) END"
# The fixture's cut-off lists end inside the last field of their last element: it is kept when closing the list makes
# JSON of it, else dropped.
CUT_SQL = "regexp_replace(response_text, ',[^,]*$', '') || '}]'"
V_SQL = f"""CASE WHEN cleaned <> '' AND json_valid(cleaned) THEN CAST(cleaned AS JSON)
  WHEN left(response_text, 1) = '[' AND json_valid(response_text || '}}]') THEN CAST(response_text || '}}]' AS JSON)
  WHEN left(response_text, 1) = '[' AND json_valid({CUT_SQL}) THEN CAST({CUT_SQL} AS JSON) END"""


def _elems_sql(resp: str, keys: str, repair: bool = True) -> str:
    return f"""
q_clean AS (SELECT {keys}, response_text, regexp_extract(response_text, '(?s)([\\[{{].*[\\]}}])', 1) AS cleaned
            FROM ({resp}) r),
q_v AS (SELECT *, {V_SQL if repair else TIER1_SQL} AS v FROM q_clean),
q_el AS (
  SELECT {keys}, unnest(range(CAST(json_array_length(v) AS BIGINT))) AS pos, unnest(json_extract(v, '$[*]')) AS e
  FROM q_v WHERE json_type(v) = 'ARRAY'
  UNION ALL
  SELECT {keys}, 0 AS pos, v AS e FROM q_v WHERE v IS NOT NULL AND json_type(v) <> 'ARRAY')"""


# ---- R1, R2 on the raw response fixture ----------------------------------------------------------------------
@register("parse_clean", """
SELECT request_id, regexp_extract(response_text, '(?s)([\\[{].*[\\]}])', 1) AS cleaned,
       regexp_extract(response_text, '(?s)([\\[{].*[\\]}])', 1) <> ''
         AND json_valid(regexp_extract(response_text, '(?s)([\\[{].*[\\]}])', 1)) AS ok
FROM fx_responses""")
def parse_clean(spark, sf):
    p = R.parse_clean(fx(spark, sf).responses)
    return p.select("request_id", "cleaned", F.col("v").isNotNull().alias("ok"))


@register("parse_explode", "WITH " + _elems_sql("SELECT * FROM fx_responses", "request_id", repair=False).strip() + """
SELECT request_id, CAST(pos AS BIGINT) AS pos,
       CASE WHEN json_type(e) = 'VARCHAR' THEN 'string' WHEN json_type(e) = 'BOOLEAN' THEN 'boolean'
            WHEN json_type(e) = 'OBJECT' THEN 'object' WHEN json_type(e) = 'ARRAY' THEN 'array'
            WHEN json_type(e) = 'NULL' THEN 'null' ELSE 'number' END AS elem_kind,
       CASE WHEN json_type(e, '$.k') IN ('BIGINT', 'UBIGINT') THEN CAST(json_extract(e, '$.k') AS BIGINT) END AS k
FROM q_el""")
def parse_explode(spark, sf):
    x = R.parse_explode(R.parse_clean(fx(spark, sf).responses), ["request_id"])
    k = F.when(F.schema_of_variant(F.try_variant_get("e", "$.k", "variant")) == "BIGINT",
               F.try_variant_get("e", "$.k", "bigint"))
    return x.select("request_id", F.col("pos").cast("long").alias("pos"), "elem_kind", k.alias("k"))


# ---- R3 events ------------------------------------------------------------------------------------------------
EV_FIELDS = ["event_id", "title", "summary", "time", "location", "characters", "goal", "conflict", "novelty_score",
             "coherence_score"]


def _event_elem_spark() -> Column:
    sel = F.col("o_orderkey") % 11

    def js(**over):
        cols = []
        for f in EV_FIELDS:
            if f in over:
                if over[f] is None:
                    continue
                cols.append(over[f].alias(f))
            else:
                cols.append(F.col(f))
        if "mood" in over:
            cols.append(over["mood"].alias("mood"))
        return F.to_json(F.struct(*cols), JS)

    no_state = F.transform("characters", lambda c: F.struct(c["name"].alias("name"), c["role"].alias("role")))
    return (F.when(sel == 0, js(event_id=F.col("o_orderkey")))
            .when(sel == 1, js(novelty_score=F.col("novelty_score").cast("string")))
            .when(sel == 2, js(goal=None))
            .when(sel == 3, js(mood=F.lit("calm")))
            .when(sel == 4, js(coherence_score=F.lit(True)))
            .when(sel == 5, js(characters=no_state))
            .otherwise(js()))


def _event_elem_sql() -> str:
    def js(**over):
        parts = []
        for f in EV_FIELDS:
            if f in over:
                if over[f] is None:
                    continue
                parts.append(f"'{f}': {over[f]}")
            else:
                parts.append(f"'{f}': {f}")
        if "mood" in over:
            parts.append(f"'mood': {over['mood']}")
        return "to_json({" + ", ".join(parts) + "})"
    no_state = "list_transform(characters, lambda c: {'name': c.name, 'role': c.role})"
    return (f"CASE o_orderkey % 11 WHEN 0 THEN {js(event_id='o_orderkey')} "
            f"WHEN 1 THEN {js(novelty_score='CAST(novelty_score AS VARCHAR)')} WHEN 2 THEN {js(goal=None)} "
            f"WHEN 3 THEN {js(mood=chr(39) + 'calm' + chr(39))} WHEN 4 THEN {js(coherence_score='true')} "
            f"WHEN 5 THEN {js(characters=no_state)} ELSE {js()} END")


BATCH = "story_id, round, val_iter"
EV_RESP_SQL = _resp_sql("fx_candidate_records", BATCH, _event_elem_sql(), "pos", "story_id % 4")
_EV_OK, _EV_REASON, _EV_VALS = _dvalidate("e", R.EVENT_SPEC)


def _event_responses(spark, sf):
    c = fx(spark, sf).candidate_records
    return _responses(c, ["story_id", "round", "val_iter"], _event_elem_spark(), "pos", F.col("story_id") % 4)


@register("parse_events", "WITH " + _elems_sql(EV_RESP_SQL, BATCH).strip() + f"""
SELECT {BATCH}, CAST(pos AS BIGINT) AS pos, {_EV_VALS['event_id']} AS event_id, {_EV_VALS['title']} AS title,
       {_EV_VALS['novelty_score']} AS novelty_score, {_EV_VALS['coherence_score']} AS coherence_score,
       CAST(len({_EV_VALS['characters']}) AS BIGINT) AS n_characters,
       array_to_string({_EV_VALS['characters']}, '|') AS character_names
FROM q_el WHERE {_EV_OK}""")
def parse_events(spark, sf):
    good, _ = R.parse_records(_event_responses(spark, sf), ["story_id", "round", "val_iter"], R.EVENT_SPEC)
    return good.select("story_id", "round", "val_iter", F.col("pos").cast("long").alias("pos"), "event_id", "title",
                       "novelty_score", "coherence_score", F.size("characters").cast("long").alias("n_characters"),
                       F.array_join(F.transform("characters", lambda c: c["name"]), "|").alias("character_names"))


@register("parse_salvage", "WITH " + _elems_sql(EV_RESP_SQL, BATCH).strip() + f"""
SELECT {BATCH}, CAST(json_array_length(v) AS BIGINT) AS n_elements FROM q_v
WHERE ({TIER1_SQL}) IS NULL AND v IS NOT NULL""")
def parse_salvage(spark, sf):
    """Event responses that parse only after repair, with the number of elements found in them."""
    p = R.parse_repaired(_event_responses(spark, sf)).where(F.col("repaired").isNotNull())
    x = R.parse_explode(p, ["story_id", "round", "val_iter"])
    return x.groupBy("story_id", "round", "val_iter").agg(F.count(F.lit(1)).alias("n_elements"))


@register("reject_log", "WITH " + _elems_sql(EV_RESP_SQL, BATCH).strip() + f""",
q_bad_text AS (SELECT {BATCH} FROM q_v WHERE v IS NULL)
SELECT {BATCH}, CAST(pos AS BIGINT) AS pos, {_EV_REASON} AS reason FROM q_el WHERE NOT ({_EV_OK})
UNION ALL SELECT {BATCH}, CAST(NULL AS BIGINT), 'no JSON' FROM q_bad_text""")
def reject_log(spark, sf):
    _, bad = R.parse_records(_event_responses(spark, sf), ["story_id", "round", "val_iter"], R.EVENT_SPEC)
    return bad.select("story_id", "round", "val_iter", F.col("pos").cast("long").alias("pos"), "reason")


# ---- R4 verdicts ---------------------------------------------------------------------------------------------
def _verdict_elem_spark() -> Column:
    sel = (F.col("pos") + F.col("round")) % 6
    valid = (F.when(sel == 1, F.when(F.col("valid"), F.lit("yes")).otherwise(F.lit("no")))
             .when(sel == 2, F.col("valid").cast("int").cast("string")))
    base = lambda v: F.to_json(F.struct(F.col("event_id"), F.col("suggestion"), v.alias("valid")), JS)
    return (F.when(sel == 1, base(valid)).when(sel == 2, base(F.col("valid").cast("int")))
            .when(sel == 3, base(F.lit(2)))
            .when(sel == 4, F.to_json(F.struct(F.length("event_id").alias("event_id"), F.col("suggestion"),
                                               F.col("valid")), JS))
            .otherwise(base(F.col("valid"))))


VERDICT_ELEM_SQL = """CASE (pos + round) % 6
  WHEN 1 THEN to_json({'event_id': event_id, 'suggestion': suggestion, 'valid': CASE WHEN valid THEN 'yes' ELSE 'no' END})
  WHEN 2 THEN to_json({'event_id': event_id, 'suggestion': suggestion, 'valid': CAST(valid AS INTEGER)})
  WHEN 3 THEN to_json({'event_id': event_id, 'suggestion': suggestion, 'valid': 2})
  WHEN 4 THEN to_json({'event_id': length(event_id), 'suggestion': suggestion, 'valid': valid})
  ELSE to_json({'event_id': event_id, 'suggestion': suggestion, 'valid': valid}) END"""
VD_RESP_SQL = _resp_sql("fx_verdicts", BATCH, VERDICT_ELEM_SQL, "pos", "(story_id + 1) % 4")
_VD_OK, _VD_REASON, _VD_VALS = _dvalidate("e", R.VERDICT_SPEC)


@register("parse_verdicts", "WITH " + _elems_sql(VD_RESP_SQL, BATCH).strip() + f"""
SELECT {BATCH}, CAST(pos AS BIGINT) AS pos, {_VD_VALS['event_id']} AS event_id, {_VD_VALS['valid']} AS valid
FROM q_el WHERE {_VD_OK}""")
def parse_verdicts(spark, sf):
    v = fx(spark, sf).verdicts
    resp = _responses(v, ["story_id", "round", "val_iter"], _verdict_elem_spark(), "pos", (F.col("story_id") + 1) % 4)
    good, _ = R.parse_records(resp, ["story_id", "round", "val_iter"], R.VERDICT_SPEC)
    return good.select("story_id", "round", "val_iter", F.col("pos").cast("long").alias("pos"), "event_id", "valid")


# ---- R5 relations, R6 sub-events, R7 chapters ---------------------------------------------------------------
REL_ELEM_SQL = """CASE WHEN rel_seq % 9 = 0
  THEN to_json({'type': type, 'source_event_id': source_event_id, 'target_event_id': target_event_id})
  ELSE to_json({'type': type, 'source_event_id': source_event_id, 'target_event_id': target_event_id,
                'rationale': rationale}) END"""


@register("parse_relations", "WITH " + _elems_sql(_resp_sql("fx_relations", "story_id", REL_ELEM_SQL, "rel_seq",
                                                            "story_id % 3"), "story_id").strip() + f"""
SELECT story_id, CAST(pos AS BIGINT) AS pos, {_dvalidate('e', R.RELATION_SPEC)[2]['source_event_id']} AS source_event_id,
       {_dvalidate('e', R.RELATION_SPEC)[2]['target_event_id']} AS target_event_id
FROM q_el WHERE {_dvalidate('e', R.RELATION_SPEC)[0]}""")
def parse_relations(spark, sf):
    r = fx(spark, sf).relations
    full = F.to_json(F.struct("type", "source_event_id", "target_event_id", "rationale"), JS)
    short = F.to_json(F.struct("type", "source_event_id", "target_event_id"), JS)
    elem = F.when(F.col("rel_seq") % 9 == 0, short).otherwise(full)
    resp = _responses(r, ["story_id"], elem, "rel_seq", F.col("story_id") % 3)
    good, _ = R.parse_records(resp, ["story_id"], R.RELATION_SPEC)
    return good.select("story_id", F.col("pos").cast("long").alias("pos"), "source_event_id", "target_event_id")


SUB_ELEM_SQL = ("to_json({'sub_event_id': sub_event_id, 'parent_event_id': parent_event_id, 'title': title, "
                "'summary': summary, 'characters': characters})")
_SE = _dvalidate("e", R.SUB_EVENT_SPEC)


@register("parse_subevents", "WITH " + _elems_sql(_resp_sql("fx_sub_events_raw", "story_id, parent_event_id",
                                                            SUB_ELEM_SQL, "sub_seq", "o_seq % 3"),
                                                  "story_id, parent_event_id").strip() + f"""
SELECT story_id, parent_event_id AS target_event_id, CAST(pos AS BIGINT) AS pos, {_SE[2]['sub_event_id']} AS sub_event_id,
       array_to_string({_SE[2]['characters']}, '|') AS character_names
FROM q_el WHERE {_SE[0]}""")
def parse_subevents(spark, sf):
    s = fx(spark, sf).sub_events_raw.withColumn("target_event_id", F.col("parent_event_id"))
    elem = F.to_json(F.struct("sub_event_id", "parent_event_id", "title", "summary", "characters"), JS)
    resp = _responses(s, ["story_id", "target_event_id"], elem, "sub_seq", F.col("o_seq") % 3)
    good, _ = R.parse_records(resp, ["story_id", "target_event_id"], R.SUB_EVENT_SPEC)
    return good.select("story_id", "target_event_id",
                       F.col("pos").cast("long").alias("pos"), "sub_event_id",
                       F.array_join(F.transform("characters", lambda c: c["name"]), "|").alias("character_names"))


CH_ELEM_SQL = """CASE chapter_pos % 4
  WHEN 1 THEN to_json({'chapter_id': CAST(chapter_id AS VARCHAR), 'title': title, 'summary': summary, 'sub_event_ids': sub_event_ids})
  WHEN 2 THEN to_json({'chapter_id': CAST(chapter_id AS DOUBLE) + 0.5, 'title': title, 'summary': summary, 'sub_event_ids': sub_event_ids})
  ELSE to_json({'chapter_id': chapter_id, 'title': title, 'summary': summary, 'sub_event_ids': sub_event_ids}) END"""
_CH = _dvalidate("e", R.CHAPTER_SPEC)


@register("parse_chapters", "WITH " + _elems_sql(_resp_sql("fx_chapters", "story_id", CH_ELEM_SQL, "chapter_pos",
                                                           "story_id % 3"), "story_id").strip() + f"""
SELECT story_id, CAST(pos AS BIGINT) + 1 AS chapter_pos, CAST({_CH[2]['chapter_id']} AS INTEGER) AS chapter_id,
       {_CH[2]['title']} AS title, array_to_string({_CH[2]['sub_event_ids']}, '|') AS sub_event_ids
FROM q_el WHERE {_CH[0]}""")
def parse_chapters(spark, sf):
    """The weave response gives chapters in list order; ``chapter_pos`` is the element position."""
    c = fx(spark, sf).chapters
    js = lambda cid: F.to_json(F.struct(cid.alias("chapter_id"), "title", "summary", "sub_event_ids"), JS)  # noqa
    sel = F.col("chapter_pos") % 4
    elem = (F.when(sel == 1, js(F.col("chapter_id").cast("string")))
            .when(sel == 2, js(F.col("chapter_id").cast("double") + 0.5)).otherwise(js(F.col("chapter_id"))))
    resp = _responses(c, ["story_id"], elem, "chapter_pos", F.col("story_id") % 3)
    good, _ = R.parse_records(resp, ["story_id"], R.CHAPTER_SPEC)
    return good.select("story_id", (F.col("pos").cast("long") + 1).alias("chapter_pos"), "chapter_id", "title",
                       F.array_join("sub_event_ids", "|").alias("sub_event_ids"))


# ---- R8 completeness, R9 compress, R10 revision, R11 passage text ------------------------------------------
COMP_SQL = """
SELECT story_id, round, CASE (story_id + round) % 5
  WHEN 0 THEN 'Sorry, I cannot judge this outline.'
  WHEN 1 THEN CAST(to_json({'complete': CASE WHEN complete THEN 'yes' ELSE 'no' END, 'reason': reason}) AS VARCHAR)
  WHEN 2 THEN concat('```json', chr(10), CAST(to_json({'complete': complete, 'reason': reason,
                      'missing_elements': list_filter(string_split(missing_elements, ','), lambda x: x <> '')}) AS VARCHAR),
                     chr(10), '```')
  WHEN 3 THEN CAST(to_json({'complete': complete, 'reason': 7}) AS VARCHAR)
  ELSE CAST(to_json({'complete': complete, 'reason': reason,
                'missing_elements': list_filter(string_split(missing_elements, ','), lambda x: x <> '')}) AS VARCHAR)
  END AS response_text
FROM fx_completeness"""
_CO = _dvalidate("v", R.COMPLETENESS_SPEC)


@register("parse_completeness", f"""
WITH q_clean AS (SELECT story_id, round, regexp_extract(response_text, '(?s)([\\[{{].*[\\]}}])', 1) AS cleaned
                 FROM ({COMP_SQL}) r),
q_v AS (SELECT *, CASE WHEN cleaned <> '' AND json_valid(cleaned) THEN CAST(cleaned AS JSON) END AS v FROM q_clean)
SELECT story_id, round, coalesce({_CO[0]}, false) AS parsed_ok,
       CASE WHEN coalesce({_CO[0]}, false) THEN {_CO[2]['complete']} ELSE false END AS complete,
       CASE WHEN coalesce({_CO[0]}, false) THEN {_CO[2]['reason']} ELSE 'Parse error' END AS reason,
       CASE WHEN coalesce({_CO[0]}, false) THEN array_to_string({_CO[2]['missing_elements']}, '|')
            ELSE 'unknown' END AS missing_elements
FROM q_v""")
def parse_completeness(spark, sf):
    c = fx(spark, sf).completeness
    k = (F.col("story_id") + F.col("round")) % 5
    miss = F.filter(F.split("missing_elements", ","), lambda x: x != "")
    text = (F.when(k == 0, F.lit("Sorry, I cannot judge this outline."))
            .when(k == 1, F.to_json(F.struct(F.when(F.col("complete"), "yes").otherwise("no").alias("complete"),
                                              "reason"), JS))
            .when(k == 2, F.concat(F.lit("```json\n"), F.to_json(F.struct("complete", "reason",
                                                                        miss.alias("missing_elements")), JS),
                                   F.lit("\n```")))
            .when(k == 3, F.to_json(F.struct("complete", F.lit(7).alias("reason")), JS))
            .otherwise(F.to_json(F.struct("complete", "reason", miss.alias("missing_elements")), JS)))
    r = c.select("story_id", "round", text.alias("response_text"))
    p = R.parse_completeness(r, ["story_id", "round"])
    return p.select("story_id", "round", "parsed_ok", "complete", "reason",
                    F.array_join("missing_elements", "|").alias("missing_elements"))


_CP = _dvalidate("v", R.COMPRESS_SPEC)
_RV = _dvalidate("v", R.REVISION_SPEC)


@register("parse_compress", f"""
WITH q_r AS (SELECT story_id, pos, CASE WHEN sub_seq % 7 = 0 THEN 'no summary today'
               ELSE concat('Result: ', to_json({{'summary_text': summary_text, 'relevance_score':
                    CASE WHEN sub_seq % 7 = 1 THEN CAST(relevance_score AS VARCHAR) ELSE CAST(relevance_score AS VARCHAR) END}}))
               END AS response_text FROM fx_passages),
q_v AS (SELECT *, regexp_extract(response_text, '(?s)([\\[{{].*[\\]}}])', 1) AS cleaned FROM q_r),
q_j AS (SELECT *, CASE WHEN cleaned <> '' AND json_valid(cleaned) THEN CAST(cleaned AS JSON) END AS v FROM q_v)
SELECT story_id, pos, coalesce({_CP[0]}, false) AS parsed_ok,
       CASE WHEN coalesce({_CP[0]}, false) THEN {_CP[2]['summary_text']} ELSE 'Parse error' END AS summary_text,
       CASE WHEN coalesce({_CP[0]}, false) THEN {_CP[2]['relevance_score']} ELSE 0.0 END AS relevance_score
FROM q_j""")
def parse_compress(spark, sf):
    p = fx(spark, sf).passages
    text = F.when(F.col("sub_seq") % 7 == 0, F.lit("no summary today")).otherwise(F.concat(
        F.lit("Result: "), F.to_json(F.struct("summary_text",
                                              F.col("relevance_score").cast("string").alias("relevance_score")), JS)))
    r = p.select("story_id", "pos", text.alias("response_text"))
    return R.parse_compress(r, ["story_id", "pos"])


@register("parse_revision", f"""
WITH q_r AS (SELECT story_id, pos, CASE WHEN sub_seq % 6 = 0
               THEN to_json({{'suggestions': suggestions, 'issues': array_to_string(issues, ','), 'revised_text': revised_text, 'confidence': confidence}})
               ELSE to_json({{'suggestions': suggestions, 'issues': issues, 'revised_text': revised_text, 'confidence': confidence}})
               END AS response_text FROM fx_passages),
q_v AS (SELECT *, regexp_extract(response_text, '(?s)([\\[{{].*[\\]}}])', 1) AS cleaned FROM q_r),
q_j AS (SELECT *, CASE WHEN cleaned <> '' AND json_valid(cleaned) THEN CAST(cleaned AS JSON) END AS v FROM q_v)
SELECT story_id, pos, coalesce({_RV[0]}, false) AS parsed_ok,
       CASE WHEN coalesce({_RV[0]}, false) THEN {_RV[2]['revised_text']} ELSE '' END AS revised_text,
       CASE WHEN coalesce({_RV[0]}, false) THEN array_to_string({_RV[2]['issues']}, '|') ELSE '' END AS issues,
       CASE WHEN coalesce({_RV[0]}, false) THEN {_RV[2]['confidence']} ELSE 0.0 END AS confidence
FROM q_j""")
def parse_revision(spark, sf):
    p = fx(spark, sf).passages
    bad = F.to_json(F.struct("suggestions", F.array_join("issues", ",").alias("issues"), "revised_text",
                             "confidence"), JS)
    good = F.to_json(F.struct("suggestions", "issues", "revised_text", "confidence"), JS)
    r = p.select("story_id", "pos", F.when(F.col("sub_seq") % 6 == 0, bad).otherwise(good).alias("response_text"))
    out = R.parse_revision(r, ["story_id", "pos"])
    return out.select("story_id", "pos", "parsed_ok", "revised_text", F.array_join("issues", "|").alias("issues"),
                      "confidence")


@register("parse_passage_text", """
SELECT story_id, pos, raw_text, trim(coalesce(raw_text, '')) = '' AS empty FROM fx_passages""")
def parse_passage_text(spark, sf):
    p = fx(spark, sf).passages.select("story_id", "pos", F.col("raw_text").alias("response_text"))
    return R.passage_text(p).select("story_id", "pos", "raw_text", "empty")
