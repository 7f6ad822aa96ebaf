"""Mixing sources to target weights, in DataFrame operations only.

Sizes (words) are summed per source; every source has a weight, and the sources share the total of all sizes in
proportion, but none gets more than ``max_repeat`` times its own size: what is beyond that is shared again by weight
among the others until nobody is above. A document of a source with rate ``target / size`` is emitted ``floor(rate)``
times plus once more if a hash of the seed and its id, as a number in [0, 1), is below the fraction.

The sources below their cap all get ``level * weight``; the caps reached are those with the smallest
``cap / weight``. The loop finds the level from two sums per round, so that only scalars reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from longform.llm.common import WORD, free_name, materialize, own_columns

SEED = "mix-1"
UNIT = 16 ** 13


def word_count(col: str):
    return F.coalesce(F.regexp_count(F.col(col), F.lit(WORD)), F.lit(0)).cast("long")


def source_rank(sources: DataFrame) -> DataFrame:
    """0-based ``rank`` of ``source`` by code point, null last, without one task that sorts them all.

    Sources are range-partitioned and written; a partition's first rank is the count of rows in earlier partitions, a
    table of one row per partition.
    """
    order = [F.col("source").isNull().asc(), F.col("source").asc()]
    n = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = materialize(sources.repartitionByRange(n, *order).withColumn("part", F.spark_partition_id()))
    counts = parts.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    starts = counts.select("part", F.coalesce(F.sum("n").over(
        Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    local = F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1
    return (parts.withColumn("local", local).join(starts, "part")
            .withColumn("rank", (F.col("start") + F.col("local")).cast("long")).drop("part", "local", "start"))


def _reached(left: int, share: int):
    """cap / weight <= left / share, in whole numbers."""
    wide = "decimal(19,0)"
    return (F.col("cap").cast(wide) * F.lit(share).cast(wide)) <= (F.col("w").cast(wide) * F.lit(left).cast(wide))


def source_targets(sized: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_repeat: int = 3) -> DataFrame:
    """``(source, source_size, target)`` from ``(source, size)`` rows; ``weights`` repeat over the sorted sources."""
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]),
                          (F.col("rank") % len(weights) + 1).cast("int")).cast("long")
    src = materialize(source_rank(sizes).withColumn("w", weight).withColumn("cap", F.col("source_size") * max_repeat))
    total = src.agg(F.sum("source_size")).first()[0] or 0
    left, share = total, (src.agg(F.sum("w")).first()[0] or 1)
    while True:
        capped = _reached(left, share)
        row = src.agg(F.sum(F.when(capped, F.col("cap"))), F.sum(F.when(~capped, F.col("w")))).first()
        now = (total - (row[0] or 0), row[1] or 0)
        if now == (left, share) or now[1] == 0:
            break
        left, share = now
    full = F.lit(now[1] == 0) | _reached(left, share)
    target = F.when(full, F.col("cap").cast("double")).otherwise(
        (F.col("w") * F.lit(left)).cast("double") / F.lit(share).cast("double"))
    return src.select("source", "source_size", target.alias("target"))


def _copies(id_col, rate, seed: str):
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(id_col.cast("string"), F.lit("")))), 1, 13),
                  16, 10).cast("long")
    whole = F.floor(rate)
    return (whole + F.when(draw.cast("double") < (rate - whole) * F.lit(float(UNIT)), 1).otherwise(0)).cast("long")


def mix_plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
             weights: tuple[int, ...] = (1, 2, 3), max_repeat: int = 3, seed: str = SEED) -> DataFrame:
    """One row per row of ``docs``: ``(doc_id, size, source_size, target, copies, taken)``.

    Size is the number of words (null and empty texts: 0). A null source is a source of its own, after all others.
    Sources without words have target 0 and their documents no copy. Rows of one id draw alike. Other columns are not
    read, so their names cannot clash.
    """
    sized = materialize(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
                                    word_count(text_col).alias("size")))
    targets = source_targets(sized, weights, max_repeat)
    named = targets.withColumnRenamed("source", "_src")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return (sized.join(named, F.col("source").eqNullSafe(F.col("_src")))
            .withColumn("copies", _copies(F.col("doc_id"), rate, seed))
            .select("doc_id", "size", "source_size", "target", "copies",
                    (F.col("size") * F.col("copies")).alias("taken")))


def emit_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
             weights: tuple[int, ...] = (1, 2, 3), max_repeat: int = 3, seed: str = SEED) -> DataFrame:
    """The mix itself: all columns of ``docs``, each row as often as the plan takes it.

    Null and empty texts have size 0, sources without words are not taken. Repeated rows are taken alike, each as often
    as its id's draw says; an empty table gives an empty mix. Columns of any name pass through.
    """
    sized = docs.select(F.col(source_col).alias("source"), word_count(text_col).alias("size"))
    targets = source_targets(sized, weights, max_repeat)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    of, per, n, copy = (free_name(x, docs) for x in ("_of", "_per", "_n", "_copy"))
    rates = targets.select(F.col("source").alias(of), rate.alias(per))
    return (docs.join(rates, docs[source_col].eqNullSafe(F.col(of)))
            .withColumn(n, _copies(docs[id_col], F.col(per), seed).cast("int"))
            .where(F.col(n) > 0).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(n))))
            .select(*own_columns(docs)))
