"""Language identification with a byte convolutional network trained in numpy.

A text is cut into windows of ``WINDOW`` bytes. Bytes are mapped to symbols (letters in either case alike, other ASCII
as blank, bytes beyond ASCII by value), filters of widths 2, 3 and 4 slide over the window, each filter's largest
response is kept, and a softmax layer turns these into language probabilities; a document's prediction is the mean log
probability of all of its windows. As a filter is a sum of one table entry for each position, widths are evaluated from
tables of symbol pairs: two look-ups for width 4.

Training uses at most ``MAX_TRAIN_DOCS`` labelled documents (one a language if there are more languages), the first by a hash of their id and text for each language,
and ``WINDOWS_PER_DOC`` windows of each at places drawn by a hash.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from longform.llm.common import byte_texts, chunks, small_batches

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 8
MAX_TRAIN_DOCS = 2000
WINDOWS_PER_DOC = 4
EPOCHS = 12
SEED = 10
UNKNOWN = "und"


def _symbols() -> np.ndarray:
    """0 for blank and all other ASCII, 1-26 letters, then one symbol for two bytes beyond ASCII."""
    table = np.zeros(256, np.uint8)
    for i in range(26):
        table[65 + i] = table[97 + i] = 1 + i
    table[128:] = 27 + np.arange(128) // 2
    return table


SYMBOLS = _symbols()
N_SYMBOLS = int(SYMBOLS.max()) + 1


def windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(windows, WINDOW + 3) symbols and each window's text; the tail is padded with blanks."""
    rows = [max(1, -(-len(t) // WINDOW)) for t in texts]
    flat = np.zeros((sum(rows), WINDOW + 3), np.uint8)
    at = 0
    for t, r in zip(texts, rows):
        body = np.zeros(r * WINDOW + 3, np.uint8)
        body[:len(t)] = SYMBOLS[np.frombuffer(t, np.uint8)]
        flat[at:at + r, :WINDOW] = body[:r * WINDOW].reshape(r, WINDOW)
        flat[at:at + r, WINDOW:] = np.stack([body[(i + 1) * WINDOW:(i + 1) * WINDOW + 3] for i in range(r)])
        at += r
    return flat, np.repeat(np.arange(len(texts)), rows)


class ByteConvNet:
    """Embedding-free convolution (a table for each filter position), max pooling and softmax."""

    def __init__(self, labels: list[str], seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.labels = labels
        self.tables = [rng.normal(0, 0.3, (w, N_SYMBOLS, FILTERS)).astype(np.float32) for w in WIDTHS]
        n = FILTERS * len(WIDTHS)
        self.out = rng.normal(0, 0.3, (n, len(labels))).astype(np.float32)
        self.bias = np.zeros(len(labels), np.float32)

    def _pairs(self) -> list[np.ndarray]:
        """For each width the responses to symbol pairs at its offsets 0 and 2 (width 3: pair and single)."""
        two = [(t[0][:, None] + t[1][None]).reshape(-1, FILTERS) for t in self.tables]
        rest = [None if t.shape[0] == 2 else
                (t[2][:, None] + (t[3][None] if t.shape[0] == 4 else 0 * t[2][None])).reshape(-1, FILTERS)
                for t in self.tables]
        first = np.concatenate(two, 1)
        second = np.concatenate([np.zeros_like(two[0]) if r is None else r for r in rest], 1)
        return [np.ascontiguousarray(first), np.ascontiguousarray(second)]

    def pool(self, x: np.ndarray, where: bool = False):
        """Largest response of each filter in each window (and its position)."""
        first, second = self._pairs()
        pair = x[:, :-1].astype(np.int32) * N_SYMBOLS + x[:, 1:]
        vals = np.empty((len(x), first.shape[1]), np.float32)
        pos = np.empty(vals.shape, np.int32) if where else None
        step = 64
        for s in range(0, len(x), step):
            p = pair[s:s + step]
            r = first.take(p[:, :WINDOW].ravel(), 0)
            r += second.take(p[:, 2:WINDOW + 2].ravel(), 0)
            r = r.reshape(len(p), WINDOW, -1)
            if where:
                pos[s:s + step] = r.argmax(1)
            vals[s:s + step] = r.max(1)
        return (vals, pos) if where else vals

    def log_prob(self, x: np.ndarray) -> np.ndarray:
        z = np.maximum(self.pool(x), 0) @ self.out + self.bias
        z -= z.max(1, keepdims=True)
        return z - np.log(np.exp(z).sum(1, keepdims=True))

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, rate: float = 0.02, batch: int = 64,
            seed: int = SEED) -> ByteConvNet:
        rng = np.random.default_rng(seed)
        params = [*self.tables, self.out, self.bias]
        moment = [np.zeros_like(p) for p in params]
        square = [np.zeros_like(p) for p in params]
        weight = (len(y) / (len(self.labels) * np.maximum(np.bincount(y, minlength=len(self.labels)), 1))).astype(np.float32)
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(y))
            for s in range(0, len(y), batch):
                at = order[s:s + batch]
                xb, yb = x[at], y[at]
                vals, pos = self.pool(xb, True)
                act = np.maximum(vals, 0)
                z = act @ self.out + self.bias
                z -= z.max(1, keepdims=True)
                p = np.exp(z)
                p /= p.sum(1, keepdims=True)
                p[np.arange(len(yb)), yb] -= 1
                p *= (weight[yb] / len(yb))[:, None]
                grads = [np.zeros_like(t) for t in self.tables]
                back = (p @ self.out.T) * (vals > 0)
                for k, w in enumerate(WIDTHS):
                    cols = slice(k * FILTERS, (k + 1) * FILTERS)
                    f = np.broadcast_to(np.arange(FILTERS), (len(yb), FILTERS))
                    for o in range(w):
                        sym = np.take_along_axis(xb, pos[:, cols] + o, 1)
                        np.add.at(grads[k][o], (sym, f), back[:, cols])
                grads += [act.T @ p, p.sum(0)]
                step += 1
                for q, g, m, v in zip(params, grads, moment, square):
                    m += 0.1 * (g - m)
                    v += 0.01 * (g * g - v)
                    q -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-6)
        return self


def train(labelled: DataFrame, max_docs: int = MAX_TRAIN_DOCS) -> ByteConvNet | None:
    """Fit on ``(text, lang)``: at most ``max_docs`` documents, as many of each language; ``None`` without any.

    Every language is learned, with one document each if there are more than ``max_docs``.
    """
    # Hash ranges keep the rows that reach the per-language choice bounded: about eight times what is kept, and always
    # the first text of a language. The counts have one row a label, as the network has.
    labelled = labelled.withColumn("draw", F.pmod(F.xxhash64(F.lit(3), "text"), F.lit(1 << 30)))
    counts = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min("draw").alias("first"))
    n_langs = counts.count()
    if not n_langs:
        return None
    share = max(1, max_docs // n_langs)
    order = F.xxhash64("text")
    some = (labelled.join(F.broadcast(counts), "lang")
            .where((F.col("draw") * F.col("n") <= F.lit(8 * share << 30)) | (F.col("draw") == F.col("first")))
            .select("lang", "text"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(order))
    start = F.pmod(F.xxhash64("i", "text"), F.greatest(F.floor(F.length("text") / WINDOW), F.lit(1))) * WINDOW + 1
    rows = (some.withColumn("r", rank).where(F.col("r") <= share)
            .withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(WINDOWS_PER_DOC))))
            .select("lang", F.substr("text", start.cast("int"), F.lit(WINDOW)).alias("text")).distinct()
            .orderBy("lang", "text").collect())
    labels = sorted({r["lang"] for r in rows})
    x, text = windows([r["text"].encode() for r in rows])
    place = {lang: i for i, lang in enumerate(labels)}
    y = np.array([place[r["lang"]] for r in rows])[text]
    return ByteConvNet(labels).fit(x, y)


def predict(docs: DataFrame, net: ByteConvNet | None, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)
            ) -> DataFrame:
    """``keep`` columns, ``lang_pred`` and ``score`` (probability of the prediction) for every row.

    The whole text is read. ``und`` with score 0 if the text is null or holds no letter, or nothing was learned.
    """
    small_batches(docs.sparkSession)
    src = docs.select(*[F.col(c) for c in keep], F.col(text_col).alias("_lf_text"),
                      F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)).alias("_lf_any"))
    types = {f.name: f.dataType.simpleString() for f in src.schema.fields}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            texts = byte_texts(rb.column("_lf_text"))
            known = np.array(rb.column("_lf_any").to_pylist(), bool)
            pred, score = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
            for s, e in chunks(texts, 1 << 20) if net else ():
                x, at = windows(texts[s:e])
                total = np.zeros((e - s, len(net.labels)))
                step = max(1, (1 << 20) // len(net.labels))
                for w in range(0, len(x), step):
                    np.add.at(total, at[w:w + step], net.log_prob(x[w:w + step]))
                total /= np.bincount(at, minlength=e - s)[:, None]
                p = np.exp(total - total.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                pred[s:e] = np.array(net.labels, object)[p.argmax(1)]
                score[s:e] = p.max(1)
            pred[~known], score[~known] = UNKNOWN, 0.0
            yield pa.RecordBatch.from_arrays([*[rb.column(c) for c in keep], pa.array(pred, pa.string()), pa.array(score)],
                                             [*keep, "lang_pred", "score"])

    return src.mapInArrow(run, ", ".join(f"{c} {types[c]}" for c in keep) + ", lang_pred string, score double")


def identify(docs: DataFrame, held_out, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id",
             max_docs: int = MAX_TRAIN_DOCS) -> DataFrame:
    """Train on the rows that are not ``held_out`` and have a language, then predict every row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"),
                       held_out.alias("held_out"))
    labelled = rows.where(~F.col("held_out") & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    return predict(rows, train(labelled.select("lang", "text"), max_docs), "text", ("doc_id", "held_out"))
