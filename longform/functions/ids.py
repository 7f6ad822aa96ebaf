"""Id collision rule shared by events and sub-events.

Rule (sequential): walk the rows in order; an id already taken gets the smallest free ``<id>_<n>``, n >= 1.

The k-th occurrence of an id simply becomes ``<id>_<k-1>`` unless that name is also given by the model: two ids never
generate the same name, so only a given id ``<b>_<n>`` whose ``<b>`` occurs more than ``n`` times makes a hit. Ids
interact only inside a *family* (the id with every trailing ``_<digits>`` stripped), so families without a hit take
the occurrence number, and the rows of families with one are replayed in order with ``applyInPandas``.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from longform.functions.seq import block_of, seq_number

FAMILY_RE = r"(_[0-9]+)+$"
GENERATED_RE = r"(?s)^(.*)_([1-9][0-9]*)$"


def _sequential(id_col: str, out_col: str, order_names: list[str]):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order_names, kind="mergesort")
        taken: set[str] = set()
        out = []
        for eid in pdf[id_col]:
            new = eid
            if new in taken:
                n = 1
                while f"{eid}_{n}" in taken:
                    n += 1
                new = f"{eid}_{n}"
            taken.add(new)
            out.append(new)
        pdf[out_col] = out
        return pdf
    return run


def _hit_families(df: DataFrame, keys: list[str], id_col: str) -> DataFrame:
    """Families in which a generated name equals a given id: an id occurs more often than the smallest suffix with
    which it is also given. Every id meets the ids that it is the base of in one aggregation."""
    n = df.groupBy(*keys, id_col).agg(F.count(F.lit(1)).alias("_lf_n"))
    suffix = F.regexp_extract(id_col, GENERATED_RE, 2).try_cast("long")
    roles = F.array(F.struct(F.col(id_col).alias("base"), F.col("_lf_n").alias("n"), F.lit(None).cast("long").alias("suffix")),
                    F.struct(F.regexp_extract(id_col, GENERATED_RE, 1).alias("base"), F.lit(0).cast("long").alias("n"),
                             suffix.alias("suffix")))
    r = n.select(*keys, F.explode(roles).alias("_lf_r")).where((F.col("_lf_r.n") > 0) | F.col("_lf_r.suffix").isNotNull())
    r = r.groupBy(*keys, F.col("_lf_r.base").alias("_lf_base")).agg(
        F.max("_lf_r.n").alias("_lf_n"), F.min("_lf_r.suffix").alias("_lf_suffix"))
    return (r.where(F.col("_lf_n") > F.col("_lf_suffix"))
            .select(*keys, F.regexp_replace("_lf_base", FAMILY_RE, "").alias("_lf_fam")).distinct())


def resolve_ids(df: DataFrame, keys: Sequence[str], id_col: str, order: str, out_col: str) -> DataFrame:
    """Adds ``out_col``, the resolved id. ``order`` is the row's whole-number position within ``keys``."""
    keys = list(keys)
    numbered = seq_number(df, keys + [id_col], [order], "_lf_k", block=[block_of(order)])
    simple = F.when(F.col("_lf_k") == 1, F.col(id_col)).otherwise(
        F.concat(F.col(id_col), F.lit("_"), (F.col("_lf_k") - 1).cast("string")))
    narrow = (df.select(*keys, order, id_col, F.regexp_replace(id_col, FAMILY_RE, "").alias("_lf_fam"))
              .join(_hit_families(df, keys, id_col), keys + ["_lf_fam"], "left_semi"))
    schema = T.StructType(narrow.schema.fields + [T.StructField("_lf_replayed", T.StringType())])
    replayed = (narrow.groupBy(*keys, "_lf_fam")
                .applyInPandas(_sequential(id_col, "_lf_replayed", [order]), schema)
                .select(*keys, order, "_lf_replayed"))
    return (numbered.join(replayed, keys + [order], "left")
            .select(*df.columns, F.coalesce(F.col("_lf_replayed"), simple).alias(out_col)))
