"""Column expressions that render records as compact JSON text, nulls kept (as the data model prints them)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from longform import schemas

JSON_OPTS = {"ignoreNullFields": "false"}


def record_json(fields: Sequence[str], prefix: str | None = None) -> Column:
    cols = [F.col(f"{prefix}.{f}" if prefix else f).alias(f) for f in fields]
    return F.to_json(F.struct(*cols), JSON_OPTS)


def event_json(prefix: str | None = None) -> Column:
    return record_json(schemas.EVENT_FIELDS, prefix)


def sub_event_json(prefix: str | None = None) -> Column:
    return record_json(schemas.SUB_EVENT_FIELDS, prefix)


def verdict_json(prefix: str | None = None) -> Column:
    return record_json(schemas.VERDICT_FIELDS, prefix)


def relation_json(prefix: str | None = None) -> Column:
    return record_json(schemas.RELATION_FIELDS, prefix)


def ordered_text(value: Column | str, order: Column | str, sep: str = "\n") -> Column:
    """``listagg(value, sep) WITHIN GROUP (ORDER BY order)`` as an aggregate column (nulls skipped)."""
    v = F.col(value) if isinstance(value, str) else value
    o = F.col(order) if isinstance(order, str) else order
    return F.array_join(ordered_list(v, o), sep)


def ordered_list(value: Column, order: Column) -> Column:
    """Array of ``value`` sorted by ``order`` (order must be unique inside a group)."""
    pairs = F.collect_list(F.struct(order.alias("o"), value.alias("v")))
    return F.transform(F.array_sort(pairs), lambda x: x["v"])
