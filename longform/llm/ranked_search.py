"""Ranked lexical search with norm buckets (LEMP): impact vectors by length, pruned before they are scored.

A document's impact on a query term is the term's weight times its saturated frequency, so a score is the inner product of the
document's impact vector with the query's 0/1 vector. Impact vectors over the terms of a block of items are ordered by length
and cut into buckets. A bucket is passed over for an item if Cauchy-Schwarz, sqrt(terms of the item) times the bucket's longest
vector, stays below the item's tenth best score so far. Inside a bucket, a few focus coordinates of the item bound what a
vector can reach: its exact part on them plus Cauchy-Schwarz on the rest of its length. Survivors are scored exactly, in
64-bit integers.

The items are the stated query set: they are read in blocks of bounded size, each searched against all documents. The longest
vectors are scored first; the scores they reach are a floor for the others, which also prunes whole files of the ordered table.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce
from heapq import nsmallest
from math import ceil, floor, log, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from longform.llm.common import bounded_batches, materialize, shared_path

TOP = 10
BUCKET = 2048
FOCUS = 8
BLOCK_BYTES = 1 << 20
SLACK = 1 + 1e-9  # bounds are doubles; a survivor too many costs a little, one too few would be wrong
_TERM = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def terms(text: str | None) -> list[bytes]:
    """Runs of ASCII letters, digits and all characters beyond ASCII, in order; only A-Z are lower-cased."""
    return (text or "").encode("utf-8", "replace").translate(_TERM).split()


def weight(n_docs: int, df: int) -> int:
    return floor(1000 * log((2 * n_docs + 2) / (2 * df + 1)))


def length_norms(n_terms: np.ndarray, n_docs: int, total: int) -> np.ndarray:
    """m of documents with these numbers of terms; Python integers where 64 bits could overflow."""
    if len(n_terms) and 90 * int(n_terms.max()) * n_docs >= 1 << 63:
        return np.array([10 + 90 * int(n) * n_docs // total for n in n_terms], np.int64)
    return 10 + 90 * n_terms * n_docs // total


def saturated(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


def _sum_rows(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    run = np.concatenate((np.zeros(1, values.dtype), np.cumsum(values)))
    return np.diff(run[np.concatenate(([0], ends))])


class Bucket:
    """Impact vectors of like length, by document and by term."""

    def __init__(self, lengths: np.ndarray, ends: np.ndarray, term: np.ndarray, impact: np.ndarray):
        self.lengths, self.squares = lengths, lengths * lengths
        self.ends, self.term, self.impact = ends, term, impact
        order = np.argsort(term, kind="stable")
        self.row = np.repeat(np.arange(len(ends)), np.diff(np.concatenate(([0], ends))))[order]
        self.by_term, self.value = term[order], impact[order]

    def column(self, t: int) -> tuple[np.ndarray, np.ndarray]:
        lo, hi = np.searchsorted(self.by_term, (t, t + 1))
        return self.row[lo:hi], self.value[lo:hi]

    def survivors(self, focus: list[int], n_rest: int, least: int) -> np.ndarray:
        """Documents that may reach ``least``: the exact part on the focus coordinates, Cauchy-Schwarz on the rest."""
        part, seen = np.zeros(len(self.ends)), np.zeros(len(self.ends))
        for t in focus:
            rows, values = self.column(t)
            part[rows] += values
            seen[rows] += values.astype(np.float64) ** 2
        # the difference of squares is widened by its own rounding error, relative to the whole length
        rest = np.sqrt(np.maximum(self.squares - seen, 0) + 1e-9 * self.squares)
        return np.flatnonzero((part + sqrt(n_rest) * rest) * SLACK >= least)

    def scores(self, rows: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """Exact scores of some documents; ``wanted`` marks the item's terms."""
        starts = np.concatenate(([0], self.ends))[rows]
        sizes = self.ends[rows] - starts
        before = np.cumsum(sizes) - sizes
        at = np.arange(int(sizes.sum())) + np.repeat(starts - before, sizes)
        return _sum_rows(np.where(wanted[self.term[at]], self.impact[at], 0), np.cumsum(sizes))


class ItemBlock:
    """Terms of a block of items and, once counted, their weights."""

    def __init__(self, items: list[tuple[object, str | None]]):
        words = [sorted(set(terms(text))) for _, text in items]
        self.ids = [i for i, _ in items]
        self.number = {t: n for n, t in enumerate(sorted(set().union(*words)))}
        self.terms = [[self.number[t] for t in w] for w in words]
        self.weights = np.zeros(len(self.number), np.int64)

    def weigh(self, n_docs: int, dfs: dict[int, int]) -> None:
        # a term that no document holds keeps weight 0: it adds nothing to any score
        for t, df in dfs.items():
            self.weights[t] = weight(n_docs, df)
        self.focus = [sorted(ts, key=lambda t: (-self.weights[t], t))[:FOCUS] for ts in self.terms]


def best_of(block: ItemBlock, buckets: Iterable[tuple[list, Bucket]], floors: list[int], top: int) -> list[list[tuple]]:
    """For each item its best (-score, id is null, id) among the buckets, with scores of at least its floor."""
    best: list[list[tuple]] = [[] for _ in block.terms]
    marks = []
    for ts in block.terms:
        mark = np.zeros(len(block.number), bool)
        mark[ts] = True
        marks.append(mark)
    for ids, bucket in buckets:
        longest = float(bucket.lengths.max()) if len(bucket.lengths) else 0.0
        for q, ts in enumerate(block.terms):
            least = max(floors[q], -best[q][-1][0] if len(best[q]) == top else 1)
            if not ts or sqrt(len(ts)) * longest * SLACK < least:
                continue
            rows = bucket.survivors(block.focus[q], len(ts) - len(block.focus[q]), least)
            if not len(rows):
                continue
            scores = bucket.scores(rows, marks[q])
            good = np.flatnonzero(scores >= least)
            if len(good):
                new = ((-int(scores[g]), ids[rows[g]] is None, ids[rows[g]]) for g in good)
                best[q] = nsmallest(top, [*best[q], *new])
    return best


def _count_terms(src: DataFrame, block: ItemBlock, id_type: str) -> DataFrame:
    """``(doc_id, n, term, tf)`` of every document with a term: the length, and the block's terms in it with their
    occurrences, as arrays."""
    number = block.number

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            keep, sizes, found, times = [], [], [], []
            for i, text in enumerate(rb.column("text").to_pylist()):
                words = terms(text)
                if not words:
                    continue
                held: dict[int, int] = {}
                for t in map(number.get, words):
                    if t is not None:
                        held[t] = held.get(t, 0) + 1
                keep.append(i)
                sizes.append(len(words))
                found.append(list(held))
                times.append(list(held.values()))
            yield pa.RecordBatch.from_arrays(
                [rb.column("doc_id").take(pa.array(keep, pa.int64())), pa.array(sizes, pa.int64()),
                 pa.array(found, pa.list_(pa.int32())), pa.array(times, pa.list_(pa.int32()))],
                ["doc_id", "n", "term", "tf"])

    return src.mapInArrow(run, f"doc_id {id_type}, n bigint, term array<int>, tf array<int>")


def _impacts(counted: DataFrame, block: ItemBlock, n_docs: int, total: int, id_type: str) -> DataFrame:
    """``(doc_id, length, term, impact)``: impact vectors of documents with a term of the block, and their lengths."""
    weights = block.weights

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            term, tf = rb.column("term"), rb.column("tf")
            sizes = np.diff(term.offsets.to_numpy())
            flat = term.flatten().to_numpy().astype(np.int64)
            m = np.repeat(length_norms(rb.column("n").to_numpy(), n_docs, total), sizes)
            impact = weights[flat] * saturated(tf.flatten().to_numpy().astype(np.int64), m)
            lengths = np.sqrt(_sum_rows(impact.astype(np.float64) ** 2, np.cumsum(sizes)))
            yield pa.RecordBatch.from_arrays(
                [rb.column("doc_id"), pa.array(lengths), term,
                 pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()),
                                          pa.array(impact))], ["doc_id", "length", "term", "impact"])

    return counted.where(F.size("term") > 0).mapInArrow(
        run, f"doc_id {id_type}, length double, term array<int>, impact array<bigint>")


def _buckets(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[list, Bucket]]:
    """Buckets of rows as they come, longest vectors first."""
    for rb in batches:
        for at in range(0, rb.num_rows, BUCKET):
            part = rb.slice(at, BUCKET)
            term = part.column("term")
            offsets = term.offsets.to_numpy()
            yield part.column("doc_id").to_pylist(), Bucket(
                part.column("length").to_numpy(), (offsets[1:] - offsets[0]).astype(np.int64),
                term.flatten().to_numpy().astype(np.int64), part.column("impact").flatten().to_numpy())


def _search(vectors: DataFrame, block: ItemBlock, floors: list[int], top: int, id_type: str) -> DataFrame:
    """``(item, doc_id, score)``: each task's best documents of each item."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, kept = pa.int64(), []

        def watched() -> Iterator[pa.RecordBatch]:
            nonlocal kind
            for rb in batches:
                kind = rb.schema.field("doc_id").type
                yield rb

        for q, rows in enumerate(best_of(block, _buckets(watched()), floors, top)):
            kept += [(q, r[2], -r[0]) for r in rows]
        yield pa.RecordBatch.from_arrays([pa.array([k[c] for k in kept], t) for c, t in
                                          ((0, pa.int32()), (1, kind), (2, pa.int64()))], ["item", "doc_id", "score"])

    return vectors.mapInArrow(run, f"item int, doc_id {id_type}, score bigint")


def _ranked(found: DataFrame, top: int) -> DataFrame:
    """Ranks within an item; equal scores by ascending id, null ids last."""
    w = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def search(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id",
           item_text_col: str = "text", top: int = TOP, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: each item's ``top`` documents with a score above 0, best first.

    Null and empty texts have no terms: such documents are not counted and such items find nothing. Equal scores are
    ordered by ascending id, null ids last. Every row is a document, or an item, of its own, also with a repeated id: a
    repeated item's result appears as often as the item does. Empty tables give no rows; other columns are not read. Items
    are read in blocks of about ``block_bytes``, each a pass over the documents; the driver holds one block and its counts.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    query = items.select(F.col(item_id_col).alias("item_id"), F.col(item_text_col).alias("text"))
    size = query.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = max(1, ceil(size / block_bytes))
    id_type, item_type = (f.schema[c].dataType.simpleString() for f, c in ((src, "doc_id"), (query, "item_id")))
    results = []
    for b in range(n_blocks):
        part = query.where(F.pmod(F.xxhash64("text", "item_id"), F.lit(n_blocks)) == b)
        block = ItemBlock([tuple(r) for r in part.toLocalIterator()])
        found = _search_block(src, block, top, id_type)
        names = spark.createDataFrame(list(enumerate(block.ids)), f"item int, item_id {item_type}")
        results.append(found.join(names, "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id",
                                                        "score"))
    return reduce(DataFrame.union, results)


def _search_block(src: DataFrame, block: ItemBlock, top: int, id_type: str) -> DataFrame:
    spark = src.sparkSession
    path = shared_path(spark, "impacts")
    _count_terms(src, block, id_type).write.parquet(f"{path}/counts")
    counted = spark.read.parquet(f"{path}/counts")
    n_docs, total = counted.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    dfs = counted.select(F.explode("term").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df"))
    block.weigh(n_docs, {r["t"]: r["df"] for r in dfs.toLocalIterator()})
    # the id spreads equal lengths (copies of one document) over the ranges
    (_impacts(counted, block, n_docs, total, id_type)
     .repartitionByRange(F.desc("length"), F.asc("doc_id")).sortWithinPartitions(F.desc("length"), F.asc("doc_id"))
     .write.parquet(f"{path}/vectors"))
    vectors = spark.read.parquet(f"{path}/vectors")
    # floors: what the longest vectors reach, at least ``top`` of them and at most a bucket
    longest = vectors.orderBy(F.desc("length"), F.asc_nulls_last("doc_id")).limit(BUCKET)
    first = _ranked(_search(longest, block, [1] * len(block.ids), top, id_type), top)
    floors = [1] * len(block.ids)
    for r in first.where(F.col("rank") == top).toLocalIterator():
        floors[r["item"]] = r["score"]
    reach = [f / (sqrt(len(ts)) * SLACK) for f, ts in zip(floors, block.terms) if ts]
    able = vectors.where(F.col("length") >= (min(reach) * (1 - 1e-9) if reach else 0.0))
    return _ranked(materialize(_search(able, block, floors, top, id_type)), top)
