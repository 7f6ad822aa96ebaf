"""Record types of the story data model, as Spark DDL and StructTypes.

Field order matters: records are rendered to JSON in this order for prompts and exports.
"""

from __future__ import annotations

from pyspark.sql import types as T

CHARACTER = "name STRING, role STRING, state STRING"
EVENT_FIELDS = ("event_id", "title", "summary", "time", "location", "characters", "goal", "conflict",
                "novelty_score", "coherence_score")
EVENT = (f"event_id STRING, title STRING, summary STRING, time STRING, location STRING, "
         f"characters ARRAY<STRUCT<{CHARACTER}>>, goal STRING, conflict STRING, novelty_score DOUBLE, "
         f"coherence_score DOUBLE")
VERDICT_FIELDS = ("event_id", "suggestion", "valid")
VERDICT = "event_id STRING, suggestion STRING, valid BOOLEAN"
COMPLETENESS_FIELDS = ("complete", "reason", "missing_elements")
COMPLETENESS = "complete BOOLEAN, reason STRING, missing_elements ARRAY<STRING>"
RELATION_FIELDS = ("type", "source_event_id", "target_event_id", "rationale")
RELATION = "type STRING, source_event_id STRING, target_event_id STRING, rationale STRING"
SUB_EVENT_FIELDS = ("sub_event_id", "parent_event_id", "title", "summary", "characters")
SUB_EVENT = (f"sub_event_id STRING, parent_event_id STRING, title STRING, summary STRING, "
             f"characters ARRAY<STRUCT<{CHARACTER}>>")
CHAPTER_FIELDS = ("chapter_id", "title", "summary", "sub_event_ids")
CHAPTER = "chapter_id INT, title STRING, summary STRING, sub_event_ids ARRAY<STRING>"
COMPRESS_FIELDS = ("summary_text", "relevance_score")
COMPRESS = "summary_text STRING, relevance_score DOUBLE"
REVISION_FIELDS = ("suggestions", "issues", "revised_text", "confidence")
REVISION = "suggestions STRING, issues ARRAY<STRING>, revised_text STRING, confidence DOUBLE"
PASSAGE = (f"sub_event_id STRING, context_snapshot STRUCT<{COMPRESS}>, raw_text STRING, "
           f"revision_result STRUCT<{REVISION}>, timestamp STRING")

# Defaults substituted when a whole-object response does not parse (fixed values of the data model).
COMPLETENESS_DEFAULT = (False, "Parse error", ["unknown"])
COMPRESS_DEFAULT = ("Parse error", 0.0)
REVISION_DEFAULT = ("", [], "", 0.0)

# Passage time stamps are exported in this layout (day/month/year, 24 hour clock).
PASSAGE_TS_FORMAT = "dd/MM/yyyy, HH:mm:ss"


def struct_type(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)
