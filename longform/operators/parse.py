"""Response parsing: clean model text to JSON, explode to elements, validate elements against a record spec.

Tier 1 is all JVM: the outermost ``[...]``/``{...}`` span is cut out (drops code fences and chatter) and parsed
with ``try_parse_json`` to VARIANT. Texts still unparsable are repaired in Arrow batches (close open brackets, drop a
cut-off element, trailing commas, single quotes, repeated keys) and parsed again; what still fails is quarantined.

Validation follows the record model's lax coercion: a string field takes only JSON strings (a number is rejected);
a float field takes numbers, numeric strings and booleans; a bool field takes booleans, 0/1 and the usual yes/no
words; an int field takes integral numbers, integer strings and booleans; lists must be JSON arrays whose elements
pass their own rule; missing or null required fields reject the element. Unknown keys are ignored.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from longform import schemas

SPAN_RE = r"(?s)([\[{].*[\]}])"
OPENING_RE = re.compile(r"[\[{]")
TRUE_WORDS = ("true", "yes", "on", "1", "t", "y")
FALSE_WORDS = ("false", "no", "off", "0", "f", "n")
NUMBER_TYPES = ("BIGINT", "INT", "SMALLINT", "TINYINT", "DOUBLE", "FLOAT")

# Record specs: (field, kind). kind: str, float, bool, int, list_str, characters.
EVENT_SPEC = [("event_id", "str"), ("title", "str"), ("summary", "str"), ("time", "str"), ("location", "str"),
              ("characters", "characters"), ("goal", "str"), ("conflict", "str"), ("novelty_score", "float"),
              ("coherence_score", "float")]
VERDICT_SPEC = [("event_id", "str"), ("suggestion", "str"), ("valid", "bool")]
RELATION_SPEC = [("type", "str"), ("source_event_id", "str"), ("target_event_id", "str"), ("rationale", "str")]
SUB_EVENT_SPEC = [("sub_event_id", "str"), ("parent_event_id", "str"), ("title", "str"), ("summary", "str"),
                  ("characters", "characters")]
CHAPTER_SPEC = [("chapter_id", "int"), ("title", "str"), ("summary", "str"), ("sub_event_ids", "list_str")]
COMPLETENESS_SPEC = [("complete", "bool"), ("reason", "str"), ("missing_elements", "list_str?")]
COMPRESS_SPEC = [("summary_text", "str"), ("relevance_score", "float")]
REVISION_SPEC = [("suggestions", "str"), ("issues", "list_str"), ("revised_text", "str"), ("confidence", "float")]

SPECS = {"event": EVENT_SPEC, "verdict": VERDICT_SPEC, "relation": RELATION_SPEC, "sub_event": SUB_EVENT_SPEC,
         "chapter": CHAPTER_SPEC, "completeness": COMPLETENESS_SPEC, "compress": COMPRESS_SPEC,
         "revision": REVISION_SPEC}


# ---- tier 1: clean and parse ---------------------------------------------------------------------------------
def clean_text(text: Column) -> Column:
    return F.regexp_extract(text, SPAN_RE, 1)


def parse_clean(responses: DataFrame, text_col: str = "response_text") -> DataFrame:
    """Adds ``cleaned`` (the JSON span, '' if none) and ``v`` (VARIANT, null if it does not parse)."""
    cleaned = clean_text(F.col(text_col))
    return (responses.withColumn("cleaned", cleaned)
            .withColumn("v", F.when(F.col("cleaned") != "", F.try_parse_json(F.col("cleaned")))))


KINDS = {"OBJECT": "object", "ARRAY": "array", "STRING": "string", "BOOLEAN": "boolean", "VOID": "null"}


def _list(v: Column) -> Column:
    """The elements of a JSON array (null for any other value)."""
    return F.try_variant_get(v, "$", "array<variant>")


def _leaf(v: Column) -> Column:
    """Type name of a variant; cheap for values that hold no others."""
    return F.schema_of_variant(v)


def _kind(v: Column) -> Column:
    """JSON kind of a variant: object, array, string, number, boolean, null (missing gives null)."""
    names = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])
    kind = F.coalesce(names[F.substring_index(_leaf(v), "<", 1)], F.lit("number"))
    return (F.when(v.isNull(), F.lit(None))
            .when(F.try_variant_get(v, "$", "map<string,variant>").isNotNull(), F.lit("object"))
            .when(_list(v).isNotNull(), F.lit("array")).otherwise(kind))


def parse_explode(parsed: DataFrame, keys: list[str]) -> DataFrame:
    """R2: a single value becomes a one-element list; elements are numbered from 0."""
    arr = F.coalesce(_list(F.col("v")), F.array(F.col("v")))
    x = parsed.where(F.col("v").isNotNull()).select(*keys, F.posexplode(arr).alias("pos", "e"))
    return x.withColumn("elem_kind", _kind(F.col("e")))


# ---- field rules ---------------------------------------------------------------------------------------------
def _get(e: Column, path: str) -> Column:
    return F.try_variant_get(e, path, "variant")


def _str_rule(x: Column) -> tuple[Column, Column]:
    return _leaf(x) == "STRING", F.try_variant_get(x, "$", "string")


def _float_rule(x: Column) -> tuple[Column, Column]:
    s = F.trim(F.try_variant_get(x, "$", "string"))
    val = (F.when(_leaf(x) == "STRING", s.try_cast("double"))
           .otherwise(F.try_variant_get(x, "$", "double")))  # numbers and booleans; null for objects and arrays
    return val.isNotNull(), val


def _bool_rule(x: Column) -> tuple[Column, Column]:
    k = _kind(x)
    s = F.lower(F.trim(F.try_variant_get(x, "$", "string")))
    num = F.try_variant_get(x, "$", "double")
    val = (F.when(k == "boolean", F.try_variant_get(x, "$", "boolean"))
           .when((k == "number") & (num == 1), F.lit(True)).when((k == "number") & (num == 0), F.lit(False))
           .when((k == "string") & s.isin(*TRUE_WORDS), F.lit(True))
           .when((k == "string") & s.isin(*FALSE_WORDS), F.lit(False)))
    return val.isNotNull(), val


def _int_rule(x: Column) -> tuple[Column, Column]:
    k = _kind(x)
    num = F.try_variant_get(x, "$", "double")
    s = F.trim(F.try_variant_get(x, "$", "string"))
    whole = F.regexp_replace(s, r"\.0+$", "")  # "1.0" is the integer 1
    val = (F.when((k == "number") & (num == F.floor(num)), num.try_cast("int"))
           .when(k == "boolean", F.try_variant_get(x, "$", "boolean").cast("int"))
           .when(k == "string", whole.try_cast("int")))
    return val.isNotNull(), val


def _list_str_rule(x: Column) -> tuple[Column, Column]:
    arr = _list(x)
    ok = arr.isNotNull() & F.forall(F.coalesce(arr, F.array()), lambda y: _leaf(y) == "STRING")
    return ok, F.when(ok, F.transform(arr, lambda y: F.try_variant_get(y, "$", "string")))


def _characters_rule(x: Column) -> tuple[Column, Column]:
    arr = _list(x)

    def one_ok(y: Column) -> Column:  # a path into anything but an object gives null
        return F.coalesce((_leaf(_get(y, "$.name")) == "STRING") & (_leaf(_get(y, "$.role")) == "STRING")
                          & (_leaf(_get(y, "$.state")) == "STRING"), F.lit(False))

    ok = arr.isNotNull() & F.forall(F.coalesce(arr, F.array()), one_ok)
    val = F.transform(arr, lambda y: F.struct(
        F.try_variant_get(y, "$.name", "string").alias("name"),
        F.try_variant_get(y, "$.role", "string").alias("role"),
        F.try_variant_get(y, "$.state", "string").alias("state")))
    return ok, F.when(ok, val)


RULES = {"str": _str_rule, "float": _float_rule, "bool": _bool_rule, "int": _int_rule, "list_str": _list_str_rule,
         "characters": _characters_rule}


@lru_cache(maxsize=64)
def _checks(app_id: str, spec: tuple[tuple[str, str], ...]) -> tuple[Column, Column, list[Column]]:
    """(every field passes, first failing field, typed fields) of an element ``e``; built once a session, since loops parse
    many tables with the same rules."""
    e, is_obj = F.col("e"), F.col("elem_kind") == "object"
    all_ok, reason, vals = is_obj, F.when(~is_obj, F.lit("not an object")), []
    for name, kind in spec:
        x = _get(e, f"$.{name}")
        ok, val = RULES[kind.rstrip("?")](x)
        if kind.endswith("?"):  # absent means the default (empty list); present must still be valid
            ok = x.isNull() | ok
            val = F.when(x.isNull(), F.array().cast("array<string>")).otherwise(val)
        ok = F.coalesce(ok, F.lit(False))
        all_ok, reason = all_ok & ok, reason.when(~ok, F.lit(f"bad {name}"))
        vals.append(val.alias(name))
    return all_ok, reason, vals


def validate(elements: DataFrame, spec: list[tuple[str, str]], keys: list[str]) -> DataFrame:
    """Adds ``ok`` (every required field passes), ``reason`` (first failing field) and one column per field."""
    all_ok, reason, vals = _checks(elements.sparkSession.sparkContext.applicationId, tuple(spec))
    pos = [] if "pos" in keys else ["pos"]
    return elements.select(*keys, *pos, all_ok.alias("_ok"), reason.alias("_reject_reason"),
                           F.to_json(F.col("e")).alias("_raw"), *vals)


def parse_records(responses: DataFrame, keys: list[str], spec: list[tuple[str, str]],
                  text_col: str = "response_text") -> tuple[DataFrame, DataFrame]:
    """(valid elements with typed fields, rejected elements/texts for the quarantine)."""
    parsed = parse_repaired(responses, text_col)
    checked = validate(parse_explode(parsed, keys), spec, keys)
    good = checked.where(F.col("_ok")).drop("_ok", "_reject_reason", "_raw")
    bad_elems = checked.where(~F.col("_ok")).select(*keys, "pos", F.col("_reject_reason").alias("reason"),
                                                   F.col("_raw").alias("raw"))
    bad_text = parsed.where(F.col("v").isNull()).select(
        *keys, F.lit(None).cast("int").alias("pos"), F.lit("no JSON").alias("reason"),
        F.col(text_col).alias("raw"))
    return good, bad_elems.unionByName(bad_text)


def parse_object(responses: DataFrame, keys: list[str], spec: list[tuple[str, str]], default: tuple,
                 text_col: str = "response_text") -> DataFrame:
    """One object per response; anything that does not validate becomes the default record."""
    parsed = parse_repaired(responses, text_col).withColumn("elem_kind", _kind(F.col("v"))).withColumn(
        "e", F.col("v"))
    if "pos" not in keys:
        parsed = parsed.withColumn("pos", F.lit(0))
    checked = validate(parsed, spec, keys)
    out = [F.col(k) for k in keys] + [F.col("_ok").alias("parsed_ok")]
    for (name, _), dflt in zip(spec, default):
        if isinstance(dflt, list):
            d = F.array(*[F.lit(x) for x in dflt]).cast("array<string>")
        else:
            d = F.lit(dflt)
        out.append(F.when(F.col("_ok"), F.col(name)).otherwise(d).alias(name))
    return checked.select(*out)


def parse_completeness(responses: DataFrame, keys: list[str], text_col: str = "response_text") -> DataFrame:
    """Completeness; a response that does not validate counts as incomplete."""
    return parse_object(responses, keys, COMPLETENESS_SPEC, schemas.COMPLETENESS_DEFAULT, text_col)


def parse_compress(responses: DataFrame, keys: list[str], text_col: str = "response_text") -> DataFrame:
    """Compression result with its default."""
    return parse_object(responses, keys, COMPRESS_SPEC, schemas.COMPRESS_DEFAULT, text_col)


def parse_revision(responses: DataFrame, keys: list[str], text_col: str = "response_text") -> DataFrame:
    """Revision result with its default."""
    return parse_object(responses, keys, REVISION_SPEC, schemas.REVISION_DEFAULT, text_col)


def passage_text(responses: DataFrame, text_col: str = "response_text") -> DataFrame:
    """The passage is the raw response text; empty ones are flagged."""
    return responses.withColumn("raw_text", F.col(text_col)).withColumn(
        "empty", F.trim(F.coalesce(F.col(text_col), F.lit(""))) == "")


# ---- repair (per row, only for texts tier 1 could not parse) -----------------------------------------------
def _close_span(text: str, start: int) -> tuple[list[str], int]:
    """Candidate JSON texts for the value that opens at ``start``, and where the scan stopped: strings in either quote,
    trailing commas dropped; if the text ends early, what is open is closed, or all after the last complete element
    dropped first."""
    out: list[str] = []
    stack: list[str] = []
    safe: tuple[int, str] | None = None  # length of ``out`` after the last complete element, and what closes it
    quote, esc, end = "", False, len(text)
    for i in range(start, len(text)):
        ch = text[i]
        if quote:
            if esc:
                esc = False
                if ch == "'":  # not an escape of JSON
                    out[-1] = ch
                    continue
            elif ch == "\\":
                esc = True
            elif ch == quote:
                quote, ch = "", '"'
            elif ch == '"':
                ch = '\\"'
            out.append(ch)
            continue
        if ch in "]}":
            while out and out[-1] in ", \t\r\n":
                out.pop()
            if not stack or stack.pop() != ch:
                end = i + 1
                break
            out.append(ch)
            safe = (len(out), "".join(reversed(stack)))
            if not stack:
                end = i + 1
                break
            continue
        if ch == "," and stack:
            safe = (len(out), "".join(reversed(stack)))
        if ch in "\"'":
            quote, ch = ch, '"'
        out.append(ch)
        if ch in "[{":
            stack.append("]" if ch == "[" else "}")
            if safe is None:
                safe = (len(out), "".join(reversed(stack)))
    whole = "".join(out).rstrip(", \t\r\n") + "".join(reversed(stack))
    return [whole, "".join(out[:safe[0]]) + safe[1] if safe else ""], end


def salvage_json(text: str) -> str | None:
    """Repair of a cut-off or sloppy JSON text in one pass over its bracketed spans: the first span that holds an object
    (chatter like ``[note]`` is passed over), else the first that parses. Returns compact JSON text or None."""
    first, pos = None, 0
    while text and (opening := OPENING_RE.search(text, pos)):
        candidates, pos = _close_span(text, opening.start())
        for fixed in candidates:
            try:
                value = json.loads(fixed)
            except (ValueError, RecursionError):
                continue
            found = json.dumps(value, separators=(",", ":"))
            if isinstance(value, dict) or any(isinstance(x, dict) for x in value):
                return found
            first = first or found
            break
    return first


@F.pandas_udf(T.StringType())
def _repair_udf(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: salvage_json(t) if isinstance(t, str) else None).astype(object)


# Not to be evaluated again for a filter on its result: the optimizer pushes no condition through it.
_repair = _repair_udf.asNondeterministic()


def parse_repaired(responses: DataFrame, text_col: str = "response_text") -> DataFrame:
    """R1 with repair: as ``parse_clean``; texts it could not parse, or found no object in (the parser stops after a
    leading ``[1]`` of chatter), are repaired in Arrow batches and parsed again. All other texts cross to Python as
    nulls. ``repaired`` is the repaired text (null: none was needed or found)."""
    parsed = parse_clean(responses, text_col)
    no_object = F.coalesce(F.forall(_list(F.col("v")), lambda y: _kind(y) != "object"), F.lit(False))
    fixed = parsed.withColumn("repaired", _repair(F.when(F.col("v").isNull() | no_object, F.col(text_col))))
    return fixed.withColumn("v", F.coalesce(F.try_parse_json("repaired"), F.col("v")))
