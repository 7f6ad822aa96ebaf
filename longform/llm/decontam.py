"""Benchmark decontamination: size-partitioned MinHash containment search.

Items (short) are partitioned by their number of shingles into classes [q, 2q). For a class, documents are cut into
windows of 2q shingles, so that both sides of a comparison have like sizes however long the document is, and every
window gets one minimum for each of ``k`` hash functions (bands of one row). A window's minimum equals an item's with
probability |W & Q| / |W | Q|, so over a document that holds the share ``t`` of the item's shingles, in one passage or
scattered, no function agrees with probability at most exp(-k t q / (2q + q)); ``k`` is derived from the recall asked
for. Items that share a minimum with some window are verified: the exact share of their distinct shingles that the whole
document holds.

The benchmark is the query set: it is read in blocks of bounded size, and a block's signatures and shingles travel with
the tasks. Documents are never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from longform.llm.common import byte_texts, chunks, free_name, materialize, small_batches

SHINGLE = 5
THRESHOLD = 0.8
MISS = 1e-5
BLOCK_BYTES = 16 << 20
_SEPARATE = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def normal(text: str | None) -> bytes:
    """Lower-cased words (ASCII letters, digits and all beyond ASCII), joined by one blank."""
    return b" ".join((text or "").lower().encode("utf-8", "replace").translate(_SEPARATE).split())


def shingles(words: list[bytes], n: int) -> set[bytes]:
    return {b" ".join(words[i:i + n]) for i in range(len(words) - n + 1)}


def shingle_hashes(norm: bytes, n: int) -> np.ndarray:
    """32-bit hashes of the n-word shingles of normalised text, in order: differences of a running polynomial."""
    if not norm:
        return np.zeros(0, np.uint32)
    raw = np.frombuffer(norm, np.uint8)
    blanks = np.flatnonzero(raw == 32)
    starts = np.concatenate(([0], blanks + 1))
    if len(starts) < n:
        return np.zeros(0, np.uint32)
    ends = np.concatenate((blanks, [len(raw)]))[n - 1:]
    starts = starts[:len(ends)]
    with np.errstate(over="ignore"):
        powers = _powers(_BASE, len(raw) + 1)
        run = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * powers[:-1], out=run[1:])
        h = (run[ends] - run[starts]) * _powers(_BASE_INVERSE, len(raw) + 1)[starts]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        return (h >> np.uint64(32)).astype(np.uint32)


_POWERS: dict[int, np.ndarray] = {}


def _powers(base: np.uint64, n: int) -> np.ndarray:
    have = _POWERS.get(int(base))
    if have is None or len(have) < n:
        with np.errstate(over="ignore"):
            have = np.full(max(n, 1 << 16), base, np.uint64)
            have[0] = 1
            have = np.cumprod(have)
        if n <= 1 << 22:
            _POWERS[int(base)] = have
    return have[:n]


def n_functions(threshold: float, miss: float) -> int:
    """Hash functions with which a window of 2q shingles misses an item of q at the threshold with ``miss`` at most."""
    return ceil(3 * log(1 / miss) / threshold)


def _functions(k: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(6)
    return rng.integers(0, 1 << 32, k, np.uint32), rng.integers(0, 1 << 31, k, np.uint32) * np.uint32(2) + np.uint32(1)


class ItemBlock:
    """Signatures and shingles of one block of benchmark items, by class (shingle length, window)."""

    def __init__(self, items: list[tuple[object, str | None]], threshold: float, miss: float, shingle: int):
        self.threshold, self.k = threshold, n_functions(threshold, miss)
        self.xor, self.mul = _functions(self.k)
        self.items: list[tuple[object, int, set[bytes]]] = []
        classes: dict[tuple[int, int], list[tuple[int, np.ndarray]]] = {}
        for item_id, text in items:
            norm = normal(text)
            if not norm:
                continue
            words = norm.split(b" ")
            n = min(shingle, len(words))
            found = shingles(words, n)
            self.items.append((item_id, n, found))
            window = 2 << (len(found).bit_length() - 1)
            classes.setdefault((n, window), []).append((len(self.items) - 1, np.unique(shingle_hashes(norm, n))))
        self.classes = {}
        for key, members in classes.items():
            tables = []
            for a, m in zip(self.xor, self.mul):
                low = np.array([((h ^ a) * m).min() for _, h in members], np.uint32)
                order = np.argsort(low, kind="stable")
                bits = max(16, min(24, len(low).bit_length() + 8))
                seen = np.zeros(1 << bits, bool)
                seen[low & np.uint32((1 << bits) - 1)] = True
                tables.append((low[order], np.array([i for i, _ in members])[order], seen))
            self.classes[key] = tables

    def candidates(self, norms: list[bytes]) -> set[tuple[int, int]]:
        """(text, item) pairs with a common minimum."""
        out: set[tuple[int, int]] = set()
        hashes: dict[int, list[np.ndarray]] = {}
        for (n, window), tables in self.classes.items():
            if n not in hashes:
                hashes[n] = [shingle_hashes(t, n) for t in norms]
            own = hashes[n]
            rows = [-(-len(h) // window) for h in own]
            if not sum(rows):
                continue
            grid = np.concatenate([np.pad(h, (0, r * window - len(h)), "edge") for h, r in zip(own, rows) if r])
            grid = np.ascontiguousarray(grid.reshape(-1, window).T)
            text = np.repeat(np.arange(len(own)), rows)
            for (low, members, seen), a, m in zip(tables, self.xor, self.mul):
                mins = ((grid ^ a) * m).min(0)
                at = np.flatnonzero(seen[mins & np.uint32(len(seen) - 1)])
                lo, hi = np.searchsorted(low, mins[at], "left"), np.searchsorted(low, mins[at], "right")
                for w, s, e in zip(at, lo, hi):
                    out.update((int(text[w]), int(members[x])) for x in range(s, e))
        return out

    def search(self, texts: list[str | None]) -> Iterator[tuple[int, object, int, int]]:
        """(text, item id, item shingles, shared) of the items contained in each text."""
        norms = [normal(t) for t in texts]
        for s, e in chunks(norms, 1 << 20):
            have: dict[tuple[int, int], set[bytes]] = {}
            for t, i in sorted(self.candidates(norms[s:e])):
                item_id, n, wanted = self.items[i]
                if (t, n) not in have:
                    have[t, n] = shingles(norms[s + t].split(b" "), n)
                shared = len(wanted & have[t, n])
                if shared >= self.threshold * len(wanted):
                    yield s + t, item_id, len(wanted), shared


def contained_items(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    item_id_col: str = "item_id", item_text_col: str = "text", threshold: float = THRESHOLD,
                    miss: float = MISS, shingle: int = SHINGLE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``(doc_id, item_id, n_shingles, n_shared, containment)`` for each document and item at or above the threshold.

    Items of fewer than ``shingle`` words are one shingle of all their words; items without words match nothing, as do
    null and empty documents. Rows of one id are searched each and reported once per distinct result. Items are read in
    blocks of about ``block_bytes``, each a pass over the documents whose result is kept in the shared folder. Other
    columns are not read.
    """
    small_batches(docs.sparkSession)
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    query = items.select(F.col(item_id_col).alias("item_id"), F.col(item_text_col).alias("text"))
    total = query.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = max(1, ceil(total / block_bytes))
    d_type, i_type = (f.schema[c].dataType.simpleString() for f, c in ((src, "doc_id"), (query, "item_id")))
    schema = f"doc_id {d_type}, item_id {i_type}, n_shingles bigint, n_shared bigint"
    item_type = to_arrow_type(query.schema["item_id"].dataType)
    results = []
    for b in range(n_blocks):
        part = query.where(F.pmod(F.xxhash64("text", "item_id"), F.lit(n_blocks)) == b)
        block = ItemBlock([tuple(r) for r in part.toLocalIterator()], threshold, miss, shingle)

        def run(batches: Iterable[pa.RecordBatch], block: ItemBlock = block) -> Iterator[pa.RecordBatch]:
            for rb in batches:
                ids = rb.column("doc_id")
                hits = list(block.search(rb.column("text").to_pylist()))
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array([h[0] for h in hits], pa.int64()))]
                    + [pa.array([h[c] for h in hits], t) for c, t in
                       ((1, item_type), (2, pa.int64()), (3, pa.int64()))],
                    ["doc_id", "item_id", "n_shingles", "n_shared"])

        results.append(materialize(src.mapInArrow(run, schema)))
    found = reduce(DataFrame.union, results).distinct()
    return found.withColumn("containment", F.col("n_shared") / F.col("n_shingles"))


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """``docs`` without the documents that contain an item.

    Rows of one id go together, null ids too. Null and empty texts contain nothing and stay, repeated rows stay repeated,
    an empty table of documents or items changes nothing. Columns of any name pass through.
    """
    bad_id = free_name("_bad", docs)
    bad = contained_items(docs, items, id_col=id_col, **options).select(F.col("doc_id").alias(bad_id)).distinct()
    return docs.join(bad, docs[id_col].eqNullSafe(F.col(bad_id)), "left_anti")
