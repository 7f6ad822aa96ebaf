"""Toxicity by compression distance.

Two Zstandard dictionaries are trained, on ordinary text and on toxic text. A window of a document is compressed with
each; the difference of the two lengths says which kind of text it is closer to. A document's share of windows at each
difference, against thresholds calibrated on labelled documents that the dictionaries have not seen, gives its score.

Both dictionaries begin with the segments that ``zstandard.train_dictionary`` picks from ordinary documents. The toxic
one goes on with those picked from the toxic documents' distinctive word stems (stems that occur in far more toxic than
ordinary documents, by the likelihood ratio statistic), the ordinary one with as many zero bytes: all else being equal
in position and content, a shorter code can only come from the toxic part.

Learning reads the whole texts of all labelled rows, each text of a class once. Spark tasks count stems and pieces, train
dictionaries of 4 MB of texts each, which are merged into one, and sum what calibration needs; what reaches the driver is
bounded by the sizes of the dictionaries and of the curve, not by the number of documents.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from math import log
from zlib import crc32

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from longform.functions.seq import seq_number
from longform.llm.common import bounded_batches, byte_texts, materialize, shared_path, small_batches

EXCERPT_BYTES = 16384
GROUP_BYTES = 4 << 20  # texts that one partial dictionary is trained on
MERGED = 64  # partial dictionaries that are merged at once
SAMPLES = 20000  # pieces that the toxic dictionary is trained on, in proportion to their counts
FITTING = 4096  # stems from which they are taken, the most frequent first: some fifty times what the dictionary holds
HELD_DOCS = 4096  # so many calibration documents are fitted on the driver, more in tasks
WINDOW = 64
ORDINARY_BYTES = 4096
TOXIC_BYTES = 1024
STEM = 4
LONGEST_STEM = 24
STATISTICS = (15.0, 25.0, 40.0, 60.0, 150.0, 400.0)  # the statistic of a telling stem grows with the documents
THRESHOLD = 0.3
BINS = 24
_LETTERS = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


def words(text: bytes) -> list[bytes]:
    """Lower-cased (A-Z) runs of ASCII letters and bytes beyond ASCII."""
    return text.lower().translate(_LETTERS).split()


def windows(text: bytes) -> list[bytes]:
    """The whole text in runs of words of ``WINDOW`` bytes; a long word is cut."""
    joined = b" " + b" ".join(words(text))
    out, at, end = [], 0, len(joined)
    while at < end:
        cut = joined.find(b" ", at + WINDOW, at + 2 * WINDOW)
        if cut < 0:
            cut = min(end, at + 2 * WINDOW)
        out.append(joined[at:cut])
        at = cut
    return out


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    params = zstandard.ZstdCompressionParameters(
        window_log=17, hash_log=13, chain_log=13, search_log=4, min_match=4, target_length=32,
        strategy=zstandard.STRATEGY_LAZY2, write_content_size=False, write_checksum=False, write_dict_id=False,
        format=zstandard.FORMAT_ZSTD1_MAGICLESS)
    return zstandard.ZstdCompressor(compression_params=params, dict_data=zstandard.ZstdCompressionDict(
        content, dict_type=zstandard.DICT_TYPE_RAWCONTENT))


def _dictionary(samples: list[bytes], size: int, **options) -> bytes:
    """Segments that the trainer picks; all samples in order where it finds them too few to choose from."""
    try:
        return zstandard.train_dictionary(size, samples, **options).as_bytes()
    except zstandard.ZstdError:
        return b"".join(dict.fromkeys(samples))[-size:]


def _stems(text: bytes) -> set[bytes]:
    return {w[:k] for w in set(words(text)) for k in range(STEM, min(len(w), LONGEST_STEM) + 1)}


def _statistic(a: int, n: int, b: int, m: int) -> float:
    """Likelihood ratio of a stem in ``a`` of ``n`` toxic and ``b`` of ``m`` ordinary documents; 0 unless 4 x denser."""
    if a < 3 or a * m <= 4 * b * n:
        return 0.0
    k, total = a + b, n + m
    cells = ((a, k * n), (b, k * m), (n - a, (total - k) * n), (m - b, (total - k) * m))
    return 2 * sum(x * log(x * total / e) for x, e in cells if x)


class Distance:
    """The two dictionaries as window compressors."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        self.ordinary, self.toxic = ordinary, toxic
        self._pair = None

    def __getstate__(self):
        return {"ordinary": self.ordinary, "toxic": self.toxic, "_pair": None}

    def counts(self, text: bytes) -> np.ndarray:
        """Number of the text's windows at each length difference from 0 to BINS - 1."""
        if self._pair is None:
            self._pair = (_compressor(self.ordinary + bytes(len(self.toxic))).compress,
                          _compressor(self.ordinary + self.toxic).compress)
        plain, toxic = self._pair
        diff = np.fromiter((len(plain(w)) - len(toxic(w)) for w in windows(text)), np.int64)
        return np.bincount(np.clip(diff, 0, BINS - 1), minlength=BINS)


def _toxic_part(pieces: list[tuple[bytes, int]], total: int, size: int) -> bytes:
    """The toxic dictionary of the most frequent stems with their counts; ``total`` is the count of all stems. Stems that fit
    are all in it, the most frequent at its end; of more the trainer picks segments."""
    if sum(_piece_bytes(stem) for stem, _ in pieces) <= TOXIC_BYTES:
        return b"".join((b" " + stem) * (_piece_bytes(stem) // (len(stem) + 1)) for stem, _ in reversed(pieces))
    each = []
    for stem, n in pieces:
        piece = b" " + stem
        copies = n * (1 + SAMPLES // total) if total <= SAMPLES else max(1, round(n * SAMPLES / total))
        # copies lie at even distances, since the trainer takes its segments from successive stretches of the samples
        each += [((i + 0.5) / copies, piece * (1 + 12 // len(piece))) for i in range(copies)]
    return _dictionary([piece for _, piece in sorted(each)], size, k=16, d=6)


def _piece_bytes(stem: bytes) -> int:
    """Bytes of a stem's piece: a blank and the stem, as often as reaches 12 bytes."""
    return (len(stem) + 1) * (1 + 12 // (len(stem) + 1))


def _toxic_bytes(piece_bytes: int) -> int:
    return min(TOXIC_BYTES, max(256, 3 * piece_bytes))


def _content(dictionary: bytes) -> bytes:
    """The segments of a trained dictionary, without the tables before them, which end with three fixed offsets."""
    head, ends, rest = dictionary.partition(b"\x01\0\0\0\x04\0\0\0\x08\0\0\0")
    return rest if ends and head.startswith(b"\x37\xa4\x30\xec") else dictionary


def merged_dictionary(parts: list[bytes]) -> bytes:
    """One dictionary of the size of each of ``parts``, from the segments that most of them share."""
    if len(parts) == 1:
        return parts[0]
    own = [_content(p) for p in parts]
    slices = [[p[i:i + WINDOW] for i in range(0, len(p), WINDOW)] for p in own]
    rows = max(map(len, slices))
    return _dictionary([x[i] for i in range(rows) for x in slices if i < len(x)], ORDINARY_BYTES)


def best_stem(word: bytes, good: dict[bytes, float]) -> bytes | None:
    own = [word[:k] for k in range(STEM, min(len(word), LONGEST_STEM) + 1) if word[:k] in good]
    return max(own, key=lambda s: (good[s], len(s))) if own else None


def train_distance(toxic: list[bytes], ordinary: list[bytes], statistic: float) -> Distance:
    """The two dictionaries of lists of texts; ``train_distances`` does the same for tables."""
    a, b = Counter(), Counter()
    for t in toxic:
        a.update(_stems(t))
    for t in ordinary:
        b.update(_stems(t))
    good = {s: v for s in a if (v := _statistic(a[s], len(toxic), b[s], len(ordinary))) > statistic}
    pieces = Counter(s for t in toxic for w in words(t) if (s := best_stem(w, good)))
    part = _toxic_part(sorted(pieces.items(), key=lambda x: (-x[1], x[0]))[:FITTING], sum(pieces.values()),
                       _toxic_bytes(sum(map(_piece_bytes, pieces))))
    return Distance(_dictionary([b" " + b" ".join(words(t)) for t in ordinary], ORDINARY_BYTES), part)


def _features(counts: np.ndarray) -> np.ndarray:
    """Windows at or above each difference (as count and share) and the number of windows."""
    n = counts.sum(1, keepdims=True)
    above = np.cumsum(counts[:, ::-1], 1)[:, ::-1][:, 1:13]
    return np.hstack([np.log1p(above), 8 * above / np.maximum(n, 1), np.log1p(n)])


class Held:
    """Calibration documents as arrays: window counts of each distance, labels, and how often each row stands."""

    def __init__(self, counts: list[np.ndarray], labels: np.ndarray, times: np.ndarray | None = None):
        self.counts, self.labels = counts, np.asarray(labels)
        self.times = np.ones(len(self.labels)) if times is None else times

    def sums(self, f: Callable[[Held], np.ndarray]) -> np.ndarray:
        return f(self)

    def cells(self, raw: Callable[[int, np.ndarray], np.ndarray]) -> list[np.ndarray]:
        """For each distance the values of ``raw``, ascending: lowest and highest of a cell, toxic and ordinary documents."""
        out = []
        for i, own in enumerate(self.counts):
            values, at = np.unique(raw(i, own), return_inverse=True)
            out.append(np.stack([values, values, *(np.bincount(at, (self.labels == y) * self.times, len(values))
                                                   for y in (1, 0))], 1))
        return out


class HeldTable:
    """Calibration documents as a table ``(toxic, counts, times)`` with the counts of all distances in one array: every sum
    is made in tasks, and values are put in cells of 1/256."""

    def __init__(self, rows: DataFrame, n: int):
        self.rows, self.n = rows, n

    def _mapped(self, f: Callable[[Iterator[Held]], Iterable[tuple]], schema: str) -> DataFrame:
        n, names = self.n, [c.split()[0] for c in schema.split(",")]

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def blocks() -> Iterator[Held]:
                for rb in batches:
                    if rb.num_rows:
                        counts = rb.column("counts").flatten().to_numpy().reshape(rb.num_rows, n, BINS)
                        yield Held([counts[:, i] for i in range(n)], rb.column("toxic").to_numpy(),
                                   rb.column("times").to_numpy().astype(float))
            for rows in f(blocks()):
                yield pa.RecordBatch.from_pydict(dict(zip(names, rows)))

        return self.rows.mapInArrow(run, schema)

    def sums(self, f: Callable[[Held], np.ndarray]) -> np.ndarray:
        def total(blocks: Iterator[Held]) -> Iterator[tuple]:
            own = None
            for held in blocks:
                x = f(held)
                own = x if own is None else own + x
            if own is not None:
                yield [own.ravel().tolist()], [list(own.shape)]

        found = self._mapped(total, "v array<double>, shape array<bigint>").collect()
        return sum(np.array(r["v"]).reshape(r["shape"]) for r in found)

    def cells(self, raw: Callable[[int, np.ndarray], np.ndarray]) -> list[np.ndarray]:
        def of(blocks: Iterator[Held]) -> Iterator[tuple]:
            for held in blocks:
                for i, own in enumerate(held.cells(raw)):
                    cell, at = np.unique(np.floor(np.clip(own[:, 0], -32, 32) * 256).astype(np.int64), return_index=True)
                    ends = np.append(at[1:], len(own)) - 1
                    sums = np.add.reduceat(own[:, 2:], at, 0)
                    yield [i] * len(cell), *(x.tolist() for x in (cell, own[at, 0], own[ends, 1], *sums.T))

        cells = self._mapped(of, "i bigint, cell bigint, lo double, hi double, toxic double, ordinary double")
        found = cells.groupBy("i", "cell").agg(F.min("lo"), F.max("hi"), F.sum("toxic"), F.sum("ordinary")).collect()
        own = sorted(tuple(r) for r in found)
        return [np.array([r[2:] for r in own if r[0] == i]) for i in range(self.n)]


def _raw(counts: np.ndarray, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray) -> np.ndarray:
    x = (_features(counts) - mean) / scale
    return np.hstack([x, np.ones((len(x), 1))]) @ weights


def _cut(cells: np.ndarray, each: np.ndarray, none: float) -> float:
    """Where the curve is cut: where recall and a lower confidence bound of precision are best together (their harmonic mean),
    of what the calibration documents stand for (``each``: of a toxic and of an ordinary one). The bound is the lower end of a
    one-sided 95 % Wilson interval, for as many documents as their weights are worth. If it does not beat the share of toxic
    documents, the curve ranks nothing and the cut lies above every value (``none`` is that of a text without windows)."""
    mass = cells[:, 2:] * each
    above, worth = mass[::-1].cumsum(0)[::-1], (mass * each).sum(1)[::-1].cumsum()[::-1]
    total, hit = above.sum(1), above[:, 0]
    n, p, z = total ** 2 / worth, hit / total, 1.645
    low = (p + z * z / (2 * n) - z * np.sqrt(p * (1 - p) / n + (z / (2 * n)) ** 2)) / (1 + z * z / n)
    recall = hit / max(hit[0], 1e-9)
    both = 2 * low * recall / np.maximum(low + recall, 1e-9)
    at = len(both) - 1 - int(np.argmax(both[::-1]))
    if low[at] <= hit[0] / total[0]:
        best, below = max(cells[-1, 1], none) + 30, cells[-1:, 1]
    else:
        best, below = cells[at, 0], cells[:at, 1][-1:]
    return (best + below[0]) / 2 if len(below) else best


def curves(held: Held | HeldTable, threshold: float, totals: tuple[int, int] | None = None) -> list[tuple]:
    """Logistic curve of each distance over its window counts: ``(mean, scale, weights, shift, quality)``. ``quality`` is the
    rank statistic (area under the curve) on the calibration documents, where equal values count as misses."""
    # the first sum holds documents of each class, then sums of features, a row for each distance
    first = held.sums(lambda h: np.stack([np.hstack([h.times @ (h.labels == 1), h.times @ (h.labels == 0),
                                                     h.times @ _features(c)]) for c in h.counts]))
    sizes, n = first[0, :2], first[0, :2].sum()
    mean = first[:, 2:] / n
    spread_of = held.sums(lambda h: np.stack([h.times @ (_features(c) - m) ** 2 for c, m in zip(h.counts, mean)]))
    scale = np.sqrt(spread_of / n) + 1e-6
    each = np.array(sizes if totals is None else totals, float) / np.maximum(sizes, 1)
    each = each / ((each * sizes).sum() / n)
    w = np.zeros((len(mean), mean.shape[1] + 1))

    def newton(h: Held, w: np.ndarray) -> np.ndarray:
        """Gradient (first row) and matrix of second derivatives of each distance."""
        mass, out = np.where(h.labels == 1, *each) * h.times, []
        for c, m, s, own in zip(h.counts, mean, scale, w):
            z = np.hstack([(_features(c) - m) / s, np.ones((len(c), 1))])
            p = 1 / (1 + np.exp(-np.clip(z @ own, -30, 30)))
            out.append(np.vstack([z.T @ (mass * (p - h.labels)), (z * (mass * p * (1 - p))[:, None]).T @ z]))
        return np.stack(out)

    for _ in range(30):
        sums = held.sums(lambda h, w=w: newton(h, w)) / n
        step = np.stack([np.linalg.solve(x[1:] + 0.01 * np.eye(len(own)), x[0] + 0.01 * own) for x, own in zip(sums, w)])
        w = w - step
        if np.abs(step).max() < 1e-9:
            break
    out = []
    for i, cells in enumerate(held.cells(lambda i, c: _raw(c, mean[i], scale[i], w[i]))):
        none = _raw(np.zeros((1, BINS), np.int64), mean[i], scale[i], w[i])[0]
        shift = log(threshold / (1 - threshold)) - _cut(cells, each, none)
        under = cells[:, 3].cumsum() - cells[:, 3]
        out.append((mean[i], scale[i], w[i], shift, (cells[:, 2] * under).sum() / max(sizes[0] * sizes[1], 1)))
    return out


class Toxicity:
    """Distances with their calibration: a logistic curve over the window thresholds."""

    def __init__(self, distance: Distance, counts: np.ndarray, labels: np.ndarray, threshold: float,
                 totals: tuple[int, int] | None = None, curve: tuple | None = None):
        """``totals``: toxic and ordinary documents that the calibration documents stand for, by default their own number.
        ``curve``: one that is fitted already."""
        self.distance = distance
        curve = curve or curves(Held([counts], labels), threshold, totals)[0]
        self.mean, self.scale, self.weights, self.shift, self.quality = curve

    def _raw(self, counts: np.ndarray) -> np.ndarray:
        return _raw(counts, self.mean, self.scale, self.weights)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        counts = np.stack([self.distance.counts(t) for t in texts])
        return 1 / (1 + np.exp(-np.clip(self._raw(counts) + self.shift, -30, 30)))


def fit(toxic: list[bytes], ordinary: list[bytes], threshold: float = THRESHOLD,
        totals: tuple[int, int] | None = None) -> Toxicity | None:
    """Dictionaries from one half of the documents, calibration on the other; ``None`` if a half lacks a class.

    ``totals``: toxic and ordinary documents of which these are a sample; calibration weighs each class accordingly.
    """
    toxic, ordinary = list(dict.fromkeys(toxic)), list(dict.fromkeys(ordinary))
    seen, kept = (toxic[::2], ordinary[::2]), (toxic[1::2], ordinary[1::2])
    if not all(seen) or not all(kept):
        return None
    labels = np.repeat([1.0, 0.0], [len(kept[0]), len(kept[1])])
    distances = [train_distance(*seen, statistic) for statistic in STATISTICS]
    counts = [np.stack([d.counts(t) for t in kept[0] + kept[1]]) for d in distances]
    return calibrate(distances, counts, labels, threshold, totals)


def calibrate(distances: list[Distance], counts: list[np.ndarray] | HeldTable, labels: np.ndarray | None, threshold: float,
              totals: tuple[int, int] | None) -> Toxicity:
    """The distance that ranks the calibration documents best, with its curve; ``counts`` as arrays or as a table that holds
    the labels too."""
    held = counts if isinstance(counts, HeldTable) else Held(counts, labels)
    found = curves(held, threshold, totals)
    best = max(range(len(distances)), key=lambda i: (found[i][-1], -i))
    return Toxicity(distances[best], None, None, threshold, totals, found[best])


def spread(text: bytes) -> bytes:
    """An excerpt of at most ``EXCERPT_BYTES``: of a longer text, pieces at even distances. Learning reads whole texts."""
    if len(text) <= EXCERPT_BYTES:
        return text
    step, piece = len(text) // 16, EXCERPT_BYTES // 16
    return b" ".join(text[i * step:i * step + piece] for i in range(16))


def class_sizes(known: DataFrame) -> tuple[int, int]:
    """Toxic and ordinary rows of ``(doc_id, toxic)``."""
    sizes = {r[0]: r[1] for r in known.groupBy("toxic").count().collect()}
    return sizes.get(1, 0), sizes.get(0, 0)


def sample(known: DataFrame, max_docs: int, sizes: tuple[int, int] | None = None) -> DataFrame:
    """At most ``max_docs`` ids of each class of ``(doc_id, toxic)``, the first by a hash, for a caller who asks for it.

    A hash range first leaves about twice as many as are kept, however many rows there are.
    """
    draw = F.pmod(F.xxhash64(F.lit(4), "doc_id"), F.lit(1 << 40))
    parts = []
    for label, n in zip((1, 0), sizes or class_sizes(known)):
        span = int(min(1.0, 2 * max_docs / max(n, 1)) * (1 << 40))
        parts.append(known.where((F.col("toxic") == label) & (draw < F.lit(span))).orderBy(draw, "doc_id").limit(max_docs))
    return parts[0].union(parts[1])


def _window_counts(rows: DataFrame, distances: list[Distance], key: str) -> DataFrame:
    """``key`` with the window counts of the whole text at each distance, in one array."""
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            counts = [np.concatenate([d.counts(t) for d in distances]).tolist() for t in byte_texts(rb.column("text"))]
            yield pa.RecordBatch.from_arrays([rb.column(key), pa.array(counts, pa.list_(pa.int64()))], [key, "counts"])

    return rows.select(key, "text").mapInArrow(run, f"{key} {kind}, counts array<bigint>")


def calibration_counts(rows: DataFrame, distances: list[Distance]) -> list[np.ndarray]:
    """For each of ``distances`` the window counts of the whole texts of ``(k, text)``, in order of ``k``."""
    small_batches(rows.sparkSession)
    found = sorted(_window_counts(rows, distances, "k").collect())
    return np.split(np.array([r["counts"] for r in found], np.int64).reshape(-1, len(distances) * BINS), len(distances), axis=1)


def calibration_table(rows: DataFrame, distances: list[Distance]) -> HeldTable:
    """The window counts of the whole texts of ``(toxic, text)``, equal rows once with their number, as a table."""
    counts = _window_counts(rows, distances, "toxic").groupBy("toxic", "counts").agg(F.count(F.lit(1)).alias("times"))
    return HeldTable(_written(counts), len(distances))


def _written(df: DataFrame) -> DataFrame:
    path = shared_path(df.sparkSession, "toxicity")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _counted(rows: DataFrame, of: Callable[[bytes], Iterable[bytes]], wanted: bytes | None = None) -> DataFrame:
    """``(item, n)``: how often ``of`` gives each item, over all texts. ``wanted`` is a table of bits by crc32 that passes the
    items wanted, and a few others."""
    size = 8 * len(wanted) if wanted else 0

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def table() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(n.keys(), pa.binary()), pa.array(n.values(), pa.int64())], ["item", "n"])

        n = Counter()
        for rb in batches:
            for t in byte_texts(rb.column("text")):
                items = of(t)
                if size:
                    items = [x for x in items if wanted[(at := crc32(x) % size) >> 3] >> (at & 7) & 1]
                n.update(items)
                if len(n) > 200_000:
                    yield table()
                    n = Counter()
        if n:
            yield table()

    return rows.select("text").mapInArrow(run, "item binary, n bigint").groupBy("item").agg(F.sum("n").alias("n"))


def _bits(items: DataFrame, size: int = 1 << 20) -> bytes:
    """A table of ``size`` bits with those of the crc32 of ``items`` set."""
    at = F.crc32("item") % size
    rows = items.select((at / 32768).cast("int").alias("b"), (at % 32768).cast("long").alias("at")).groupBy("b").agg(
        F.bitmap_construct_agg("at").alias("bits")).collect()
    own = {r["b"]: bytes(r["bits"]) for r in rows}
    return b"".join(own.get(b, bytes(4096)) for b in range(size // 32768))


def good_stems(toxic: DataFrame, ordinary: DataFrame, sizes: tuple[int, int]) -> DataFrame:
    """``(item, value)`` of the stems whose statistic exceeds the least of ``STATISTICS``, from all texts. Stems that could not
    reach it if they were in no ordinary document are not looked for there."""
    n, m = sizes
    least = next((a for a in range(3, n + 1) if _statistic(a, n, 0, m) > STATISTICS[0]), n + 1)
    a = materialize(_counted(toxic, _stems).where(F.col("n") >= least).withColumnRenamed("n", "a"))
    b = _counted(ordinary, _stems, _bits(a)).withColumnRenamed("n", "b")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            value = [_statistic(x, n, y, m) for x, y in zip(rb.column("a").to_pylist(), rb.column("b").to_pylist())]
            yield pa.RecordBatch.from_arrays([rb.column("item"), pa.array(value, pa.float64())], ["item", "value"])

    both = a.join(b, "item", "left").select("item", "a", F.coalesce("b", F.lit(0)).cast("long").alias("b"))
    return materialize(both.mapInArrow(run, "item binary, value double").where(F.col("value") > STATISTICS[0]))


def piece_counts(toxic: DataFrame, good: DataFrame) -> DataFrame:
    """``(item, value, n)``: how many words of all toxic texts have a good stem as their best one, which is the same for every
    statistic that it exceeds."""
    said = _counted(toxic, lambda t: [w for w in words(t) if len(w) >= STEM]).withColumnRenamed("item", "word")
    ends = F.transform(F.sequence(F.lit(STEM), F.least(F.length("word"), F.lit(LONGEST_STEM))),
                       lambda k: F.substring(F.col("word"), F.lit(1), k))
    of = said.select("word", "n", F.explode(ends).alias("item")).join(good, "item")
    best = of.groupBy("word").agg(F.max(F.struct("value", F.length("item").alias("len"), "item")).alias("s"), F.max("n").alias("n"))
    return materialize(best.groupBy(F.col("s.item").alias("item"), F.col("s.value").alias("value")).agg(F.sum("n").alias("n")))


def ordinary_dictionary(rows: DataFrame) -> bytes:
    """The dictionary of all texts of ``(digest, text)``: one for each group of about ``GROUP_BYTES``, merged in rounds."""
    spark = rows.sparkSession
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-size // GROUP_BYTES))
    grouped = rows.select(F.pmod(F.xxhash64("digest"), F.lit(n)).alias("g"), "digest", "text")

    def trained(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def one() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"g": [g], "i": [i], "part": [_dictionary(texts, ORDINARY_BYTES)]},
                                              pa.schema([("g", pa.int64()), ("i", pa.int64()), ("part", pa.binary())]))

        g, i, held, texts = None, 0, 0, []
        for rb in batches:
            for own, t in zip(rb.column("g").to_pylist(), byte_texts(rb.column("text"))):
                if texts and (own != g or held > 2 * GROUP_BYTES):
                    yield one()
                    i, held, texts = i + 1 if own == g else 0, 0, []
                g = own
                texts.append(b" " + b" ".join(words(t)))
                held += len(t)
        if texts:
            yield one()

    def merged(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            parts = [merged_dictionary(p) for p in rb.column("parts").to_pylist()]
            yield pa.RecordBatch.from_arrays([rb.column("g"), pa.array([0] * len(parts), pa.int64()),
                                              pa.array(parts, pa.binary())], ["g", "i", "part"])

    bounded_batches(spark)
    schema = "g bigint, i bigint, part binary"
    parts = materialize(grouped.repartition(min(n, 4096), "g").sortWithinPartitions("g", "digest").mapInArrow(trained, schema))
    while n > MERGED:
        n = -(-n // MERGED)
        lists = parts.groupBy(F.pmod("g", F.lit(n)).alias("g")).agg(F.transform(F.array_sort(F.collect_list(
            F.struct(F.col("g").alias("h"), "i", "part"))), lambda x: x["part"]).alias("parts"))
        parts = materialize(lists.mapInArrow(merged, schema))
    return merged_dictionary([bytes(r["part"]) for r in parts.orderBy("g", "i").collect()] or [b""])


def train_distances(toxic: DataFrame, ordinary: DataFrame, sizes: tuple[int, int]) -> list[Distance]:
    """The dictionaries of the whole texts of two tables ``(digest, text)`` for each of ``STATISTICS``, equal ones once."""
    pieces = piece_counts(toxic, good_stems(toxic, ordinary, sizes))
    width = F.length("item") + 1
    plain, out = ordinary_dictionary(ordinary), []
    for statistic in STATISTICS:
        own = pieces.where(F.col("value") > statistic)
        total, size = own.agg(F.sum("n"), F.sum(width * (1 + (F.lit(12) / width).cast("int")))).first()
        first = own.orderBy(F.desc("n"), "item").limit(FITTING).collect()
        part = _toxic_part([(bytes(r["item"]), r["n"]) for r in first], total, _toxic_bytes(size or 0))
        if all(part != d.toxic for d in out):
            out.append(Distance(plain, part))
    return out


def train(docs: DataFrame, labels: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "toxic", max_docs: int | None = None, threshold: float = THRESHOLD) -> Toxicity | None:
    """Fit on the whole texts of all documents that ``labels`` covers and ``usable`` (a condition on ``doc_id``) admits.

    Of rows that repeat an id one text is taken, that of the smallest digest, and a text of a class once. Every second text of
    a class by its digest is for calibration, the others for the dictionaries. Labels meet digests first, so that texts are
    shuffled once. Calibration weighs each class by all of its labelled rows. ``max_docs`` learns from so many documents of each
    class only, for callers who ask for it.
    """
    small_batches(docs.sparkSession)
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).alias("toxic")).where(
        F.col("toxic").isin(0, 1) & usable).select("doc_id", F.col("toxic").cast("int").alias("toxic")).distinct()
    totals = class_sizes(known)
    if max_docs is not None:
        known = sample(known, max_docs, totals)
    digest = F.sha2(F.concat(F.lit("4:"), F.col("text")), 256)
    text = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where(
        F.col("text").isNotNull() & usable).withColumn("digest", digest)
    # nothing here is broadcast, since all of it grows with the labels
    once = (text.select("doc_id", "digest").join(known.hint("merge"), "doc_id")
            .groupBy("doc_id", "toxic").agg(F.min("digest").alias("digest"))
            .groupBy("toxic", "digest").agg(F.min("doc_id").alias("doc_id")))
    place = materialize(seq_number(once, ["toxic"], ["digest"], "r", block=[F.substring("digest", 1, 3)]))
    n = {(r["toxic"], r["part"]): r["n"] for r in place.groupBy("toxic", (F.col("r") % 2).alias("part")).agg(
        F.count(F.lit(1)).alias("n")).collect()}
    if not all(n.get((y, part)) for y in (1, 0) for part in (1, 0)):
        return None
    roles = place.groupBy("doc_id", "digest").agg(F.collect_list(F.struct("toxic", "r")).alias("roles"))
    both = text.join(roles.hint("merge"), ["doc_id", "digest"]).groupBy("doc_id", "digest").agg(
        F.first("text").alias("text"), F.first("roles").alias("roles"))
    rows = _written(both.select("digest", "text", F.inline("roles")))
    seen = [rows.where((F.col("toxic") == y) & (F.col("r") % 2 == 1)) for y in (1, 0)]
    kept = rows.where(F.col("r") % 2 == 0)
    distances = train_distances(*seen, (n[1, 1], n[0, 1]))
    if n[1, 0] + n[0, 0] > HELD_DOCS:
        return calibrate(distances, calibration_table(kept, distances), None, threshold, totals)
    key = F.when(F.col("toxic") == 1, F.col("r")).otherwise(F.col("r") + F.lit(1 << 40)).cast("long").alias("k")
    of = np.repeat([1.0, 0.0], [n[1, 0], n[0, 0]])
    return calibrate(distances, calibration_counts(kept.select(key, "text").repartition("k"), distances), of, threshold, totals)


def score_documents(docs: DataFrame, model: Toxicity | None, text_col: str = "text", score_col: str = "score"
                    ) -> DataFrame:
    """``docs`` with ``score_col`` (0 to 1) as its last column, which takes the place of a column of that name.

    Null and empty texts have no window, which the curve scores like any other count of windows; without a model every
    score is 0. Repeated rows are scored alike, an empty table gives an empty one, all other columns pass through.
    """
    small_batches(docs.sparkSession)
    docs = docs.drop(score_col)
    schema = StructType([*docs.schema.fields, StructField(score_col, DoubleType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            texts = byte_texts(rb.column(text_col))
            score = model.scores(texts) if model else np.zeros(len(texts))
            yield pa.RecordBatch.from_arrays([*rb.columns, pa.array(score, pa.float64())], [*rb.schema.names, score_col])

    return docs.mapInArrow(run, schema)
