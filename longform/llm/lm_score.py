"""Masked pseudo-likelihood with a bidirectional window network trained in numpy.

Tokens are lower-cased words. The most frequent words of the whole corpus have ids of their own, all others share hash
buckets. The network sees the embeddings of ``SIDE`` tokens on either side of a position, never the token itself, and
gives its probability as that of the id's upper half times that of its lower half given the upper one. A document's
score is the sum over all of its tokens of their conditional log probabilities. A word without an id of its own has the
probability of its bucket times its share of the bucket's tokens, ``count(word) / count(bucket)``, over the whole corpus,
so that the probabilities of all words of the corpus add up to one.

The counts of all words are a table that grows with the corpus. Fewer than ``LOCAL`` of the most frequent words, and those
with ids, are looked up in the scoring tasks; all others are counted within each document and joined with the table by
word. A word that is joined is at most one token in ``LOCAL``, so no word makes a join task large. The count that parts
the two is found by counting words in slices of counts, so that no task sends its own most frequent words to the driver.

Training covers every token of every document once. Documents are dealt into ``rounds`` by a hash; in each round every
task goes on from the shared weights over its documents of the round, and the results are averaged, weighted by tokens,
with a Spark aggregate over blocks of weights. Word counts and weight sums grow with the corpus; the driver sees fewer
than ``LOCAL`` words, the tokens of each bucket and one set of weights.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from longform.llm.common import byte_texts, chunks, materialize, small_batches

HALF = 32
VOCABULARY = HALF * HALF
BUCKETS = 128
LOCAL = 1 << 17
SLICES = 4096
SIDE = 2
OFFSETS = (*range(-SIDE, 0), *range(1, SIDE + 1))
EMBED = 8
HIDDEN = 24
ROUNDS = 3
BATCH = 2048
RATE = 0.05
BLOCK = 64
SEED = 9
FLUSH_WORDS = 200_000
SHAPES = {"embed": (VOCABULARY + 1, EMBED), "enter": (2 * SIDE, EMBED, HIDDEN), "enter_bias": (HIDDEN,),
          "upper": (HIDDEN, HALF), "upper_bias": (HALF,), "given": (HALF, HIDDEN), "lower": (HIDDEN, HALF),
          "lower_bias": (HALF,)}
N_WEIGHTS = sum(int(np.prod(s)) for s in SHAPES.values())


class Vocabulary(dict):
    """Word to id; a word that is not listed goes to a bucket, remembered up to a bound."""

    def __init__(self, words: list[bytes]):
        super().__init__((w, i) for i, w in enumerate(words))

    def __missing__(self, word: bytes) -> int:
        i = VOCABULARY - BUCKETS + zlib.crc32(word) % BUCKETS
        if len(self) < 500_000:
            self[word] = i
        return i


class Codes(dict):
    """Word to its place in a list of words; a word that is not listed to the length of the list plus its bucket."""

    def __init__(self, words: list[bytes]):
        super().__init__((w, i) for i, w in enumerate(words))
        self.listed = len(words)

    def __missing__(self, word: bytes) -> int:
        return self.listed + zlib.crc32(word) % BUCKETS


def tokens(texts: list[bytes], vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of all texts with ``SIDE`` border ids around each; the positions of real tokens and their text."""
    return bordered([np.fromiter(map(vocabulary.__getitem__, t.lower().split()), np.int32) for t in texts])


def bordered(own: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One array of the ids of all texts, as ``tokens`` returns it."""
    sizes = np.array([len(x) for x in own])
    border = np.full(SIDE, VOCABULARY, np.int32)
    ids = np.concatenate([border] + [y for x in own for y in (x, border)]) if own else border
    starts = SIDE + np.concatenate(([0], np.cumsum(sizes + SIDE)[:-1])) if own else sizes
    at = np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
    return ids, at, np.repeat(np.arange(len(own)), sizes)


def initial() -> np.ndarray:
    rng = np.random.default_rng(SEED)
    return np.concatenate([(np.zeros(s) if n.endswith("bias") else rng.normal(0, 0.15, s)).ravel()
                           for n, s in SHAPES.items()]).astype(np.float32)


class WindowNet:
    """The network over one flat weight vector."""

    def __init__(self, flat: np.ndarray):
        self.flat = flat.astype(np.float32).copy()
        self.parts, at = {}, 0
        for name, shape in SHAPES.items():
            n = int(np.prod(shape))
            self.parts[name] = self.flat[at:at + n].reshape(shape)
            at += n
        self.square = None

    def _hidden(self, ids: np.ndarray, at: np.ndarray):
        p = self.parts
        around = np.stack([ids[at + o] for o in OFFSETS], 1)
        x = p["embed"].take(around, 0).reshape(len(at), -1)
        h = np.tanh(x @ p["enter"].reshape(-1, HIDDEN) + p["enter_bias"])
        hi, lo = np.divmod(ids[at], HALF)
        return around, x, h, hi, lo, h + p["given"].take(hi, 0)

    def _logits(self, part: str, state: np.ndarray) -> np.ndarray:
        """A row for each choice and a column for each position, so that sums and maxima run along memory."""
        z = self.parts[part].T @ state.T
        z += self.parts[f"{part}_bias"][:, None]
        z -= z.max(0)
        return z

    @staticmethod
    def _log_softmax_at(z: np.ndarray, picked: np.ndarray) -> np.ndarray:
        chosen = z[picked, np.arange(len(picked))]
        return chosen - np.log(np.exp(z, out=z).sum(0))

    @staticmethod
    def _softmax_error(z: np.ndarray, picked: np.ndarray) -> np.ndarray:
        """Gradient of the mean log loss by the logits."""
        np.exp(z, out=z)
        z /= z.sum(0) * len(picked)
        z[picked, np.arange(len(picked))] -= 1 / len(picked)
        return z

    def log_prob(self, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Log probability of the token at each position from both sides."""
        out = np.empty(len(at))
        for s in range(0, len(at), BATCH):
            _, _, h, hi, lo, g = self._hidden(ids, at[s:s + BATCH])
            out[s:s + len(hi)] = (self._log_softmax_at(self._logits("upper", h), hi)
                                  + self._log_softmax_at(self._logits("lower", g), lo))
        return out

    def learn(self, ids: np.ndarray, at: np.ndarray, rate: float = RATE) -> None:
        """One pass over the positions in batches (Adagrad)."""
        p = self.parts
        if self.square is None:
            self.square = np.full(len(self.flat), 1e-4, np.float32)
        for s in range(0, len(at), BATCH):
            around, x, h, hi, lo, g = self._hidden(ids, at[s:s + BATCH])
            up = self._softmax_error(self._logits("upper", h), hi)
            low = self._softmax_error(self._logits("lower", g), lo)
            dg = low.T @ p["lower"].T
            dz = (up.T @ p["upper"].T + dg) * (1 - h * h)
            dx = dz @ p["enter"].reshape(-1, HIDDEN).T
            cell = (around.reshape(-1, 1) * EMBED + np.arange(EMBED)).ravel()
            picked = np.zeros((HALF, len(hi)), np.float32)
            picked[hi, np.arange(len(hi))] = 1
            grad = np.concatenate([
                np.bincount(cell, dx.ravel(), (VOCABULARY + 1) * EMBED), (x.T @ dz).ravel(), dz.sum(0),
                (up @ h).T.ravel(), up.sum(1), (picked @ dg).ravel(), (low @ g).T.ravel(), low.sum(1)]
            ).astype(np.float32)
            self.square += grad * grad
            self.flat -= rate * grad / np.sqrt(self.square)


def _src(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``(word, n)``: every word of all documents with its number of tokens."""
    small_batches(docs.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())],
                                             ["word", "n"])
            seen.clear()
            return out

        for rb in batches:
            for t in byte_texts(rb.column(0)):
                seen.update(t.lower().split())
                if len(seen) >= FLUSH_WORDS:
                    yield flush()
        yield flush()

    return (docs.select(F.col(text_col).alias("text")).mapInArrow(run, "word binary, n bigint")
            .groupBy("word").agg(F.sum("n").alias("n")))


def count_cut(counts: DataFrame, n: int) -> int:
    """Count of the ``n``-th most frequent word, 0 if there are fewer words, by narrowing the range of counts.

    A pass counts the words in at most ``SLICES`` slices of the range and goes on in the slice that holds the word.
    """
    words, low, high = counts.agg(F.count("*"), F.coalesce(F.min("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    if words < n:
        return 0
    above = 0
    while low < high:
        width = (high - low) // SLICES + 1
        in_slice = dict(counts.where(F.col("n").between(low, high)).groupBy(F.expr(f"(n - {low}) div {width}").alias("s"))
                        .agg(F.count("*")).collect())
        for at in sorted(in_slice, reverse=True):
            if above + in_slice[at] >= n:
                low, high = low + at * width, min(high, low + (at + 1) * width - 1)
                break
            above += in_slice[at]
    return low


def words_above(counts: DataFrame, cut: int) -> list[tuple[bytes, int]]:
    """Words that occur more often than ``cut``, by count and then by their bytes."""
    return sorted(((bytes(r[0]), r[1]) for r in counts.where(F.col("n") > cut).collect()), key=lambda x: (-x[1], x[0]))


def most_frequent(counts: DataFrame, n: int) -> list[tuple[bytes, int]]:
    """The ``n`` most frequent words and their counts, ties by their bytes."""
    cut = count_cut(counts, n)
    top = words_above(counts, cut)
    ties = counts.where(F.col("n") == cut).orderBy("word").limit(n - len(top)).collect() if len(top) < n else []
    return top + [(bytes(r[0]), r[1]) for r in ties]


def vocabulary(docs: DataFrame, text_col: str = "text") -> list[bytes]:
    """The words that have ids of their own."""
    return [w for w, _ in most_frequent(word_counts(docs, text_col), VOCABULARY - BUCKETS)]


def bucket_sizes(counts: DataFrame, top: list[tuple[bytes, int]]) -> np.ndarray:
    """Tokens of each bucket: of all words but those of ``top``, which have ids of their own."""
    sizes = np.zeros(BUCKETS, np.int64)
    for b, n in counts.groupBy((F.crc32("word") % BUCKETS).alias("b")).agg(F.sum("n")).collect():
        sizes[b] = n
    for w, n in top:
        sizes[zlib.crc32(w) % BUCKETS] -= n
    return sizes


def train(docs: DataFrame, words: list[bytes], text_col: str = "text", rounds: int = ROUNDS) -> np.ndarray:
    """Shared weights after ``rounds`` rounds that together cover every document once."""
    flat = initial()
    src = docs.select(F.col(text_col).alias("text"))
    cells = [f"v{i}" for i in range(BLOCK)]
    padded = -(-N_WEIGHTS // BLOCK) * BLOCK
    for r in range(rounds):
        part = src.where(F.pmod(F.xxhash64(F.lit(SEED), "text"), F.lit(rounds)) == r)

        def run(batches: Iterable[pa.RecordBatch], start: np.ndarray = flat) -> Iterator[pa.RecordBatch]:
            net, known, seen = WindowNet(start), Vocabulary(words), 0
            for rb in batches:
                texts = byte_texts(rb.column(0))
                for s, e in chunks(texts, 1 << 20):
                    ids, at, _ = tokens(texts[s:e], known)
                    net.learn(ids, at)
                    seen += len(at)
            if seen:
                grid = np.zeros(padded)
                grid[:N_WEIGHTS] = net.flat
                grid = grid.reshape(-1, BLOCK) * seen
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(len(grid)), pa.int32()), pa.array(np.full(len(grid), float(seen))),
                     *[pa.array(grid[:, i]) for i in range(BLOCK)]], ["block", "w", *cells])

        sums = part.mapInArrow(run, "block int, w double, " + ", ".join(f"{c} double" for c in cells)).groupBy("block").agg(
            *[(F.sum(c) / F.sum("w")).alias(c) for c in cells]).collect()
        if sums:
            grid = np.zeros((padded // BLOCK, BLOCK))
            for row in sums:
                grid[row[0]] = row[1:]
            flat = np.round(grid.ravel()[:N_WEIGHTS], 7).astype(np.float32)
    return flat


def pseudo_likelihood(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS,
                      local: int = LOCAL) -> DataFrame:
    """``(doc_id, n_tokens, log_prob, mean_log_prob)``, one row per row of ``docs``.

    Null and empty texts have no tokens: sum 0 and a null mean. Whole texts are read and scored; other columns are not
    read. An empty table trains nothing and returns nothing. Words that occur more often than the ``local``-th word are
    looked up in place and all others joined, with the same result.
    """
    src = _src(docs, id_col, text_col)
    counts = materialize(word_counts(src))
    top = most_frequent(counts, VOCABULARY - BUCKETS)
    words = [w for w, _ in top]
    sizes = bucket_sizes(counts, top)
    # Words that are looked up, with their id and log share of the bucket; a word with an id has one of its own.
    listed = dict(top)
    listed.update(words_above(counts, count_cut(counts, local)) if local else [])
    near = list(listed)
    bucket = np.array([zlib.crc32(w) % BUCKETS for w in near], np.int32)
    beyond = np.arange(len(near)) >= len(words)
    ids_of = np.concatenate((np.where(beyond, VOCABULARY - BUCKETS + bucket, np.arange(len(near))),
                             VOCABULARY - BUCKETS + np.arange(BUCKETS))).astype(np.int32)
    shares = np.concatenate((np.where(beyond, np.log(np.array(list(listed.values())) / np.maximum(sizes[bucket], 1)), 0.0),
                             np.zeros(BUCKETS)))
    flat = train(src, words, rounds=rounds)
    id_type = src.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A document's rows are its joined words; the first one has its sums, with a word of blanks if there is none."""
        net, codes = WindowNet(flat), Codes(near)
        for rb in batches:
            texts = byte_texts(rb.column("text"))
            for s, e in chunks(texts, 1 << 20):
                split = [t.lower().split() for t in texts[s:e]]
                own = [np.fromiter(map(codes.__getitem__, x), np.int32, len(x)) for x in split]
                ids, at, text = bordered([ids_of[x] for x in own])
                code = np.concatenate(own)
                n = np.bincount(text, minlength=e - s)
                total = np.bincount(text, net.log_prob(ids, at) + shares[code], e - s)
                far = np.flatnonzero(code >= len(near))
                flat_words = list(chain.from_iterable(split))
                pairs = Counter(zip(text[far].tolist(), map(flat_words.__getitem__, far.tolist())))
                bare = np.flatnonzero(np.bincount(text[far], minlength=e - s) == 0).tolist()
                pairs.update({(i, f" {rb.column('hash')[s + i]} {rb.column('doc_id')[s + i]}".encode()): 0 for i in bare})
                row = np.fromiter((i for i, _ in pairs), np.int64, len(pairs))
                first = np.zeros(len(row), bool)
                first[np.unique(row, return_index=True)[1]] = True
                index = pa.array(row + s)
                yield pa.RecordBatch.from_arrays(
                    [rb.column("doc_id").take(index), rb.column("hash").take(index), pa.array(first.astype(np.int64)),
                     pa.array(np.where(first, n[row], 0)), pa.array(np.where(first, total[row], 0.0)),
                     pa.array([w for _, w in pairs], pa.binary()), pa.array(list(pairs.values()), pa.int64())],
                    ["doc_id", "hash", "copies", "n_tokens", "log_prob", "word", "times"])

    rows = src.withColumn("hash", F.xxhash64("text")).mapInArrow(
        run, f"doc_id {id_type}, hash bigint, copies bigint, n_tokens bigint, log_prob double, word binary, times bigint")
    size = F.element_at(F.array(*[F.lit(int(x)) for x in sizes]), (F.crc32("word") % BUCKETS + 1).cast("int"))
    share = counts.select("word", F.log(F.col("n") / F.greatest(size, F.lit(1))).alias("share"))
    # Rows of equal id and text have equal sums: one group, given out as often as it occurs.
    return (rows.join(share, "word", "left")
            .withColumn("log_prob", F.col("log_prob") + F.when(F.col("times") > 0, F.col("times") * F.col("share")).otherwise(0.0))
            .groupBy("doc_id", "hash").agg(*[F.sum(c).alias(c) for c in ("copies", "n_tokens", "log_prob")])
            .withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
            .select("doc_id", F.expr("n_tokens div copies").alias("n_tokens"),
                    (F.col("log_prob") / F.col("copies")).alias("log_prob"))
            .withColumn("mean_log_prob", F.when(F.col("n_tokens") > 0, F.col("log_prob") / F.col("n_tokens"))))
