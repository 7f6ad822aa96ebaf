"""Order within a story, computed so that one huge story cannot land in one task.

``seq_number`` is ``row_number() OVER (PARTITION BY keys ORDER BY order)`` in two levels: rows are numbered inside a
*block* of their key (a batch, an event, or ``BLOCK_ROWS`` neighbouring positions; any columns that never decrease
along the order), and shifted by the counts of the key's earlier blocks. The block counts are a partial aggregation,
and the prefix sum sees one small row per block, so no window holds more than a block of rows. It is one declarative
plan for every size: no sampling, no threshold, and no job while a query is built.

Everything else that looks at a neighbour row (``lag``/``lead``) is an equi-join on ``(keys, seq ± 1)``, which
hash-partitions evenly however big a story is. Running aggregates use fixed-size blocks of ``seq``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS = 4096


def _cols(cols: Sequence[str | Column]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in cols]


def block_of(position: str) -> Column:
    """Block of a whole-number position: ``BLOCK_ROWS`` neighbouring positions share one."""
    return F.floor((F.col(position) - 1) / BLOCK_ROWS).cast("long")


def window_number(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], name: str = "seq") -> DataFrame:
    """Plain ``row_number()`` per key: one shuffle, one task per key."""
    w = Window.partitionBy(*list(keys)).orderBy(*_cols(order))
    return df.withColumn(name, F.row_number().over(w).cast("long"))


def seq_number(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], name: str = "seq", *,
               block: Sequence[Column]) -> DataFrame:
    """1-based position of each row within its key, by ``order`` (which must be unique within a key). ``block`` columns
    must not decrease along ``order``. Null keys are a key of their own."""
    keys, columns = list(keys), df.columns
    fields = [f"_lf_b{i}" for i in range(len(block))]
    # A struct compares null blocks as equal, and rows of a null key form one block, whose offset is 0: the join below is a
    # plain equi-join on the columns of the window, which keeps the rows where the window has put them.
    known = F.lit(True)
    for c in keys:
        known = known & F.col(c).isNotNull()
    tagged = df.select("*", F.struct(*[c.alias(b) for c, b in zip(block, fields)]).alias("_lf_own"))
    tagged = tagged.withColumn("_lf_b", F.when(known, F.col("_lf_own")))
    local = tagged.withColumn("_lf_ln", F.row_number().over(
        Window.partitionBy(*keys, "_lf_b").orderBy("_lf_own", *_cols(order))))
    counts = tagged.where(known).groupBy(*keys, "_lf_b").agg(F.count(F.lit(1)).alias("_lf_n"))
    earlier = Window.partitionBy(*keys).orderBy("_lf_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, "_lf_b", F.sum("_lf_n").over(earlier).alias("_lf_off"))
    return local.join(offsets, [*keys, "_lf_b"], "left").select(
        *columns, (F.col("_lf_ln") + F.coalesce("_lf_off", F.lit(0))).cast("long").alias(name))


def with_neighbour(df: DataFrame, keys: Sequence[str], seq: str, cols: Sequence[str], step: int = 1,
                   suffix: str = "_next") -> DataFrame:
    """Attach ``cols`` of the row at ``seq + step`` (lead for +1, lag for -1) by an equi-join."""
    keys = list(keys)
    other = df.select(*keys, (F.col(seq) - step).alias(seq), *[F.col(c).alias(c + suffix) for c in cols])
    return df.join(other, keys + [seq], "left")


def running_max_before(df: DataFrame, keys: Sequence[str], seq: str, value: str, name: str) -> DataFrame:
    """max(value) over rows of the same key with a smaller ``seq`` (null for the first row).

    Two levels so that no window sees more than one block of a story: maxima of whole earlier blocks, then a
    window inside the row's own block.
    """
    keys = list(keys)
    blk = F.floor((F.col(seq) - 1) / BLOCK_ROWS).cast("long")
    tagged = df.withColumn("_lf_blk", blk)
    per_block = tagged.groupBy(*keys, "_lf_blk").agg(F.max(value).alias("_lf_bmax"))
    prior = Window.partitionBy(*keys).orderBy("_lf_blk").rowsBetween(Window.unboundedPreceding, -1)
    per_block = per_block.select(*keys, "_lf_blk", F.max("_lf_bmax").over(prior).alias("_lf_prior"))
    inside = Window.partitionBy(*keys, "_lf_blk").orderBy(seq).rowsBetween(Window.unboundedPreceding, -1)
    out = (tagged.withColumn("_lf_in", F.max(value).over(inside))
           .join(per_block, keys + ["_lf_blk"], "left"))
    return (out.withColumn(name, F.greatest("_lf_in", "_lf_prior"))
            .drop("_lf_blk", "_lf_in", "_lf_prior"))


def running_min_after(df: DataFrame, keys: Sequence[str], seq: str, value: str, name: str) -> DataFrame:
    """min(value) over rows of the same key with a larger ``seq`` (null for the last row)."""
    keys = list(keys)
    blk = F.floor((F.col(seq) - 1) / BLOCK_ROWS).cast("long")
    tagged = df.withColumn("_lf_blk", blk)
    per_block = tagged.groupBy(*keys, "_lf_blk").agg(F.min(value).alias("_lf_bmin"))
    later = Window.partitionBy(*keys).orderBy("_lf_blk").rowsBetween(1, Window.unboundedFollowing)
    per_block = per_block.select(*keys, "_lf_blk", F.min("_lf_bmin").over(later).alias("_lf_later"))
    inside = Window.partitionBy(*keys, "_lf_blk").orderBy(seq).rowsBetween(1, Window.unboundedFollowing)
    out = (tagged.withColumn("_lf_in", F.min(value).over(inside))
           .join(per_block, keys + ["_lf_blk"], "left"))
    return (out.withColumn(name, F.least("_lf_in", "_lf_later"))
            .drop("_lf_blk", "_lf_in", "_lf_later"))


def chunk_of(seq: str, rows: int = BLOCK_ROWS) -> Column:
    """Chunk index for nested exports: no exported group holds more than ``rows`` elements."""
    return F.floor((F.col(seq) - 1) / rows).cast("long")
