"""SimHash near-duplicates with bit-sliced comparison.

Fingerprints are 64 bits over word shingles. Two fingerprints within ``radius`` bits agree on at least
``blocks - radius`` of ``blocks`` bit ranges, so each fingerprint is filed once per choice of that many ranges (exact:
no pair is lost). Rows of one file key are compared in bit-sliced form: bit plane ``b`` holds bit ``b`` of 64
fingerprints in one machine word, distances of 64 pairs are counted at once with carry-save adders, and words in which
every pair is beyond the radius are abandoned. A file key with many fingerprints (a third of all rows, say) is dealt
into blocks, and each pair of blocks is a group of its own. A group returns the links of a spanning forest, never its
pairs, so its output grows with its rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from longform.llm.common import byte_texts, free_name, materialize, own_columns, small_batches
from longform.llm.components import connected_components

SEED = 42
BLOCK_ROWS = 1024
_ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """64-bit SimHash of the lower-cased (A-Z) words of ``text``; 0 without words."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = np.concatenate(([0], ends[:-shingle])).tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[s:e], SEED) for s, e in zip(starts, (ends[shingle - 1:] - 1).tolist())]
    ones = np.zeros(64, np.int64)
    values = np.array(hashes, "<u8")
    for i in range(0, len(values), 1 << 16):
        part = values[i:i + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(0, np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(values), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """``(doc_id, fp, txt)``: the fingerprint as a signed long and a 64-bit hash of the text."""
    small_batches(docs.sparkSession)
    src = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("txt"),
                      F.col(text_col).alias("text"))
    id_type = src.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            fps = np.array([fingerprint(t, shingle) for t in byte_texts(rb.column("text"))], np.uint64)
            yield pa.RecordBatch.from_arrays([rb.column("doc_id"), pa.array(fps.view(np.int64)), rb.column("txt")],
                                             ["doc_id", "fp", "txt"])

    return src.mapInArrow(run, f"doc_id {id_type}, fp bigint, txt bigint")


def _planes(fp: np.ndarray) -> np.ndarray:
    """(64, words + 2) bit planes; two empty words let any shift read past the end."""
    words = -(-len(fp) // 64) + 2
    bits = np.unpackbits(fp.astype("<u8").view(np.uint8).reshape(len(fp), 8), axis=1, bitorder="little").T
    out = np.zeros((64, words * 8), np.uint8)
    packed = np.packbits(bits, axis=1, bitorder="little")
    out[:, :packed.shape[1]] = packed
    return out.view("<u8")


def _lanes(mask: np.ndarray, words: int) -> np.ndarray:
    out = np.zeros(words * 8, np.uint8)
    packed = np.packbits(mask, bitorder="little")
    out[:len(packed)] = packed
    return out.view("<u8")


def _join(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Merge the trees of each pair; the smallest row of a tree is its root."""
    while True:
        x, y = root[i], root[j]
        open_ = x != y
        if not open_.any():
            return root
        i, j = i[open_], j[open_]
        np.minimum.at(root, np.maximum(x, y)[open_], np.minimum(x, y)[open_])
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up


def bit_sliced_forest(fp: np.ndarray, group: np.ndarray, side: np.ndarray, cross: np.ndarray,
                      radius: int) -> np.ndarray:
    """Root row of each row: rows of one group (adjacent) are linked within ``radius`` bits.

    ``cross`` marks groups that compare only rows of unlike ``side``. Pairs already in one tree are skipped: they cannot
    change the forest.
    """
    n = len(fp)
    root = np.arange(n)
    planes = _planes(fp)
    width = (radius).bit_length()
    head = (1 << width) - 1 - radius          # counters start here, so that radius + 1 differences overflow them
    for off in range(1, n):
        same = group[off:] == group[:-off]
        if not same.any():
            break
        alive = same & (root[off:] != root[:-off]) & (~cross[:-off] | (side[off:] != side[:-off]))
        over = ~_lanes(alive, planes.shape[1] - 2)
        at = np.flatnonzero(over != _ONES)
        if not len(at):
            continue
        over = over[at]
        up, shift = off // 64, np.uint64(off % 64)
        back = np.uint64(64) - shift
        count = [np.full(len(at), _ONES if head >> k & 1 else np.uint64(0), np.uint64) for k in range(width)]
        hit = True
        for b in range(64):
            row = planes[b]
            lo, hi = np.minimum(at + up, len(row) - 1), np.minimum(at + up + 1, len(row) - 1)
            other = row[lo] >> shift | row[hi] << back if shift else row[lo]
            carry = row[at] ^ other
            for k in range(width):
                count[k], carry = count[k] ^ carry, count[k] & carry
            over = over | carry
            if b % 8 == 7:
                keep = over != _ONES
                if not keep.any():
                    hit = False
                    break
                if keep.mean() < 0.7:
                    at, over, count = at[keep], over[keep], [c[keep] for c in count]
        if hit:
            word, bit = np.nonzero(np.unpackbits((~over).astype("<u8").view(np.uint8).reshape(len(at), 8), axis=1,
                                                 bitorder="little"))
            i = at[word] * 64 + bit
            root = _join(root, i, i + off)
    return root


def _complete_groups(batches: Iterable[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
    """Sorted rows in runs that end where a group ends."""
    held: dict[str, np.ndarray] | None = None
    for rb in batches:
        cols = {n: rb.column(n).to_numpy(zero_copy_only=False) for n in rb.schema.names}
        if held:
            cols = {n: np.concatenate((held[n], cols[n])) for n in cols}
        key = np.stack([cols[n] for n in ("t", "key", "x", "y")])
        cut = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0))
        if not len(cut):
            held = cols
            continue
        end = cut[-1] + 1
        yield {n: v[:end] for n, v in cols.items()}
        held = {n: v[end:] for n, v in cols.items()}
    if held:
        yield held


def link_fingerprints(fps: DataFrame, radius: int = 3, blocks: int = 5, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Links ``(a, b)`` between distinct fingerprints (``fp``) whose components are those of all pairs in ``radius``."""
    if blocks <= radius:
        raise ValueError("blocks must exceed radius")
    edges = [64 * i // blocks for i in range(blocks + 1)]
    ranges = [((1 << edges[i + 1]) - (1 << edges[i])) for i in range(blocks)]
    masks = [sum(c) for c in combinations(ranges, blocks - radius)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    filed = fps.select("fp", F.explode(F.array(*[
        F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key"))
        for t, m in enumerate(signed)])).alias("f")).select("fp", "f.t", "f.key")
    sizes = filed.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    dealt = (filed.join(sizes, ["t", "key"])
             .withColumn("nb", F.ceil(F.col("n") / block_rows).cast("int"))
             .withColumn("side", F.pmod(F.xxhash64("fp"), F.col("nb").cast("long")).cast("int"))
             .withColumn("o", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
             .select("t", "key", F.least("side", "o").alias("x"), F.greatest("side", "o").alias("y"), "side", "fp")
             .repartition("t", "key", "x", "y").sortWithinPartitions("t", "key", "x", "y", "fp"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols in _complete_groups(batches):
            key = np.stack([cols[n] for n in ("t", "key", "x", "y")])
            group = np.concatenate(([0], np.cumsum((key[:, 1:] != key[:, :-1]).any(0))))
            fp = cols["fp"].astype(np.int64).view(np.uint64)
            root = bit_sliced_forest(fp, group, cols["side"], cols["x"] != cols["y"], radius)
            linked = root != np.arange(len(root))
            yield pa.RecordBatch.from_arrays([pa.array(cols["fp"][linked], pa.int64()),
                                              pa.array(cols["fp"][root[linked]], pa.int64())], ["a", "b"])

    return dealt.mapInArrow(run, "a bigint, b bigint")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                   radius: int = 3) -> DataFrame:
    """``(doc_id, txt, fingerprint, component_id)``, one row per row of ``docs``.

    Whole texts are read. Null and empty texts have fingerprint zero and are linked like any other; repeated rows each
    get a row; null ids belong to a component but never name it while another id is there. Other columns of ``docs``
    are not read, so their names cannot clash. ``txt`` is a hash of the text that tells rows of one id apart.
    """
    docs_fp = materialize(fingerprints(docs, id_col, text_col, shingle))
    classes = docs_fp.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    comps = connected_components(link_fingerprints(classes.select("fp"), radius))
    named = (classes.join(comps.withColumnRenamed("node", "fp"), "fp", "left")
             .withColumn("root", F.coalesce("root", "fp")))
    ids = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    by_fp = named.join(ids, "root").select("fp", "root", "component_id")
    return (docs_fp.join(by_fp, "fp")
            .select("doc_id", "txt", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id",
                    F.col("root").alias("group_key")))


def keep_one_per_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                       radius: int = 3) -> DataFrame:
    """``docs`` with one row of each near-duplicate group: the one with the smallest id (then text hash).

    Columns of any name pass through. Null ids count after all others; of rows that repeat id and text one stays. Null
    and empty texts are near duplicates of each other; an empty table stays empty.
    """
    groups = simhash_groups(docs, id_col, text_col, shingle, radius)
    pick = F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "txt")
    reps = groups.groupBy("group_key").agg(F.min(pick).alias("p"), F.count(F.lit(1)).alias("n"))
    same = (groups.select("group_key", pick.alias("p")).join(reps.select("group_key", "p"), ["group_key", "p"])
            .groupBy("group_key", "p").agg(F.count(F.lit(1)).alias("n")))
    rep, txt, n = (free_name(x, docs) for x in ("_rep", "_txt", "_n"))
    reps = materialize(same.select(F.col("p.doc_id").alias(rep), F.col("p.txt").alias(txt), F.col("n").alias(n)))
    chosen = docs.join(reps, F.col(rep).eqNullSafe(docs[id_col]) & (F.col(txt) == F.xxhash64(docs[text_col])))
    once = chosen.where(F.col(n) == 1).select(*own_columns(docs))
    again = chosen.where(F.col(n) > 1).dropDuplicates([rep, txt]).select(*own_columns(docs))
    return once.unionByName(again)
