"""Alignment of two tokenizers: groups of tokens between the byte offsets at which both have a token end.

Both id lists are laid over the same bytes. The cumulative ends of either side are kept in an end-to-index dictionary; the
intersection of their keys, sorted, cuts both lists into groups, and the links of a group are its pairs of tokens whose byte
ranges overlap. Neither tokenizer merges across a blank that follows a word, so the new words of a batch are laid end to end
and aligned together, and a word's alignment is kept; texts with other white space are aligned whole, in the same way.

How many documents hold an id pair linked is counted over the corpus: tasks write blocks of documents with the distinct
pairs of each block, pairs are summed and the best of each first id found by joins on the pair, and the answers go back
to their blocks. Only distinct pairs of a block are shuffled, not the links of its documents.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from longform.llm.common import bounded_batches, chunks, materialize
from longform.llm.tokens import JOINED, LONG_WORD, MAX_WORDS, PLAIN, byte_bpe, public_path

BLOCK_LINKS = 1 << 20
BLOCK_DOCS = 1 << 14
BLANK = "▁"  # how pieces write a blank


def piece_bytes(piece: str) -> bytes:
    """Bytes of a piece: U+2581 is a blank, ``<0xHH>`` one byte, all else UTF-8."""
    if len(piece) == 6 and piece.startswith("<0x") and piece.endswith(">"):
        return bytes([int(piece[3:5], 16)])
    return piece.replace(BLANK, " ").encode("utf-8")


def common_slices(a_ends: list[int], b_ends: list[int]) -> tuple[list[int], list[int], list[int]]:
    """The common ends of two token lists over the same bytes, sorted, and how many tokens of either list end there or
    before: the slices of both lists that make the groups."""
    at_a = dict(zip(a_ends, range(1, len(a_ends) + 1)))
    at_b = dict(zip(b_ends, range(1, len(b_ends) + 1)))
    ends = sorted(at_a.keys() & at_b.keys())
    return ends, list(map(at_a.__getitem__, ends)), list(map(at_b.__getitem__, ends))


def links_of(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links of all slices: the bytes between two neighbouring ends of either list lie in one token of each, and two
    tokens that overlap share one such stretch. Its end and the index of its token in each list."""
    ends = np.sort(np.concatenate((a_ends, b_ends)), kind="stable")  # two sorted runs: a merge
    ends = ends[np.diff(ends, prepend=-1) > 0]
    return ends, np.searchsorted(a_ends, ends), np.searchsorted(b_ends, ends)


class Aligner:
    """Alignments of words (a text is the word of its own if it cannot be split), in growing arrays by number."""

    def __init__(self, bpe_path: str, piece_path: str):
        import sentencepiece
        self.bpe = byte_bpe(bpe_path, plain=True)
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        names = [self.pieces.id_to_piece(i) for i in range(self.pieces.get_piece_size())]
        self.piece_of = [piece_bytes(n) for n in names]
        self.by_word = self.bpe.by_word and not any(BLANK in n.lstrip(BLANK) for n in names)
        self.a_lengths, self.b_lengths = (np.array([len(x) for x in t], np.int64)
                                          for t in (self.bpe.bytes_of, self.piece_of))
        self.names = [str(i) for i in range(max(len(self.bpe.bytes_of), len(names)))]
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.texts: list[str] = []  # the groups of a word, written out
        self.sizes = array("q")  # tokens a, tokens b, groups, links; -1 tokens: the bytes differ
        self.pair_at = array("q", [0])
        self.pairs = array("q")  # id a << 32 | id b of every link

    def add(self, words: list[str], b_lists: list[list[int]]) -> None:
        """Align words, each with the blank before it, laid end to end: a word's end is an end of both sides."""
        whole = [b" " + w.encode("utf-8") for w in words]
        a = np.frombuffer(self.bpe.encode(" " + " ".join(words)), "<u4").astype(np.int64)
        b = np.array(list(chain.from_iterable(b_lists)), np.int64)
        a_list, b_list, text = a.tolist(), b.tolist(), b"".join(whole)
        if not (b"".join(map(self.bpe.bytes_of.__getitem__, a_list)) == text
                == b"".join(map(self.piece_of.__getitem__, b_list))):
            if len(words) > 1:
                middle = len(words) // 2
                self.add(words[:middle], b_lists[:middle])
                self.add(words[middle:], b_lists[middle:])
                return
            self.texts.append("")
            self.sizes.extend((-1, 0, 0, 0))
            self.pair_at.append(len(self.pairs))
            return
        a_ends, b_ends = np.cumsum(self.a_lengths[a]), np.cumsum(self.b_lengths[b])
        ends, a_to, b_to = common_slices(a_ends.tolist(), b_ends.tolist())
        a_names, b_names = ([self.names[i] for i in ids] for ids in (a_list, b_list))
        groups = [",".join(a_names[p:q]) + "|" + ",".join(b_names[r:t])
                  for p, q, r, t in zip([0, *a_to], a_to, [0, *b_to], b_to)]
        link_ends, link_a, link_b = links_of(a_ends, b_ends)
        word_ends = np.cumsum([len(w) for w in whole])
        of_word = np.stack([np.searchsorted(e, word_ends) + 1 for e in (a_ends, b_ends, np.array(ends), link_ends)], 1)
        last_group = of_word[:, 2].tolist()
        self.texts += [";".join(groups[p:q]) for p, q in zip([0, *last_group], last_group)]
        self.sizes.frombytes(np.diff(of_word, axis=0, prepend=0).tobytes())
        self.pair_at.frombytes((of_word[:, 3] + len(self.pairs)).tobytes())
        self.pairs.frombytes((a[link_a] << 32 | b[link_b]).tobytes())

    def words_of(self, texts: list[str]) -> list[np.ndarray]:
        """Numbers of the words of each (non-empty) text."""
        split = [t.split(" ") if self.by_word else [t] for t in texts]
        new: list[str] = []
        if self.by_word:
            new = sorted(set().union(*split).difference(self.number))
            joined = " ".join(new)
            if PLAIN.fullmatch(joined) and not any(c in joined for c in "\t\n\r"):
                new = [w for w in new if 0 < len(w) <= LONG_WORD]
            else:  # words of the faster encoder are laid together
                new = sorted(filter(self.bpe.splits, new), key=lambda w: PLAIN.fullmatch(w) is None)
        for i in range(0, len(new), JOINED):
            some, first = new[i:i + JOINED], len(self.texts)
            self.add(some, self.pieces.encode(some, num_threads=1))
            self.number.update(zip(some, range(first, len(self.texts))))
        out = []
        for t, words in zip(texts, split):
            try:
                out.append(np.array(list(map(self.number.__getitem__, words)), np.int64))
            except KeyError:
                out.append(np.array([len(self.texts)], np.int64))
                self.add([t], [self.pieces.encode(t)])
        return out


_LOADED: dict[tuple[str, str], Aligner] = {}


def _aligner(bpe_path: str, piece_path: str) -> Aligner:
    key = (bpe_path, piece_path)
    if key not in _LOADED:
        _LOADED[key] = Aligner(*key)
    return _LOADED[key]


def _pack(values: np.ndarray, kind: str) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(values.astype(kind).tobytes())


def _unpack(raw: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), kind)


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of all ranges [start, start + size), one after the other."""
    before = np.cumsum(sizes) - sizes
    return np.arange(int(sizes.sum())) + np.repeat(starts - before, sizes)


class Block:
    """Documents of one block: digests, and the words of each with their times."""

    def __init__(self):
        self.rows: list[tuple] = []
        self.docs: list[np.ndarray] = []
        self.links = 0

    def add(self, key: object, words: np.ndarray, aligner: Aligner) -> None:
        sizes = np.frombuffer(aligner.sizes, np.int64).reshape(-1, 4)[words]
        if not len(words) or (sizes[:, 0] < 0).any():
            self.rows.append((key, 0, 0, 0, 0, ""))
            self.docs.append(words[:0])
            return
        total = sizes.sum(0).tolist()
        text = ";".join(map(aligner.texts.__getitem__, words.tolist()))
        self.rows.append((key, *total, hashlib.sha256(text.encode()).hexdigest()))
        self.docs.append(words)
        self.links += total[3]

    def record(self, block: int, aligner: Aligner, kind: pa.DataType) -> pa.RecordBatch:
        doc = np.repeat(np.arange(len(self.docs)), [len(d) for d in self.docs])
        words, word = np.unique(np.concatenate([*self.docs, np.zeros(0, np.int64)]), return_inverse=True)
        held, times = np.unique(doc * max(1, len(words)) + word, return_counts=True)
        doc, word = held // max(1, len(words)), held % max(1, len(words))
        at = np.frombuffer(aligner.pair_at, np.int64)
        lengths = at[words + 1] - at[words]
        all_pairs = np.frombuffer(aligner.pairs, np.int64)[_ranges(at[words], lengths)]
        pairs, pair = np.unique(all_pairs, return_inverse=True)
        starts = np.cumsum(lengths) - lengths
        linked = pair[_ranges(starts[word], lengths[word])]
        both = np.unique(np.repeat(doc, lengths[word]) * max(1, len(pairs)) + linked)
        n_docs = np.bincount(both % max(1, len(pairs)), minlength=len(pairs))
        doc_ends = np.searchsorted(doc, np.arange(len(self.docs)), "right")
        keys, *digests = (list(c) for c in zip(*self.rows))
        lists = [pa.array([keys], pa.list_(kind)), *(pa.array([d], pa.list_(pa.int64())) for d in digests[:4]),
                 pa.array([digests[4]], pa.list_(pa.string())), pa.array([pairs], pa.list_(pa.int64())),
                 pa.array([n_docs], pa.list_(pa.int64()))]
        packed = [pa.array([_pack(v, k)], pa.binary()) for v, k in (
            (doc_ends, "<i4"), (word, "<i4"), (times, "<i4"), (lengths, "<i4"), (pair, "<i4"))]
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), *lists, *packed], BLOCK_COLUMNS)


DIGESTS = ["n_a", "n_b", "n_groups", "n_links"]
BLOCK_COLUMNS = ["block", "doc_id", *DIGESTS, "groups_sha256", "pairs", "n_docs", "doc_ends", "words", "times",
                 "word_pairs", "pair_of"]


def _blocks(src: DataFrame, bpe_path: str, piece_path: str, id_type: str, block_links: int) -> DataFrame:
    schema = (f"block bigint, doc_id array<{id_type}>, " + ", ".join(f"{d} array<bigint>" for d in DIGESTS)
              + ", groups_sha256 array<string>, pairs array<bigint>, n_docs array<bigint>, doc_ends binary, words binary, "
              "times binary, word_pairs binary, pair_of binary")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, number = _aligner(bpe_path, piece_path), TaskContext.get().partitionId() << 33
        block, kind = Block(), pa.int64()
        for rb in batches:
            kind = rb.schema.field("doc_id").type
            keys, texts = rb.column("doc_id").to_pylist(), [t or "" for t in rb.column("text").to_pylist()]
            for s, e in chunks(texts, 1 << 20):
                if len(aligner.texts) > MAX_WORDS:
                    if block.rows:
                        yield block.record(number, aligner, kind)
                        block, number = Block(), number + 1
                    aligner.clear()
                filled = iter(aligner.words_of([t for t in texts[s:e] if t]))
                for key, text in zip(keys[s:e], texts[s:e]):
                    block.add(key, next(filled) if text else np.zeros(0, np.int64), aligner)
                    if block.links >= block_links or len(block.rows) >= BLOCK_DOCS:
                        yield block.record(number, aligner, kind)
                        block, number = Block(), number + 1
        if block.rows:
            yield block.record(number, aligner, kind)

    return src.mapInArrow(run, schema)


def align_documents(docs: DataFrame, bpe: str | None = None, pieces: str | None = None, id_col: str = "doc_id",
                    text_col: str = "text", block_links: int = BLOCK_LINKS) -> DataFrame:
    """One row a document: ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``.

    ``bpe`` (A) encodes a blank and the text, ``pieces`` (B) the text, to which it adds the blank itself; strings of special
    tokens are plain text. Texts that are null, empty, or whose bytes either side does not give back have no tokens:
    zeros and ''. An id pair counts the documents (rows) that hold it linked; ``n_best`` are a document's links with the
    highest count of their A id, ties included. Every row is a document of its own, also with a repeated or null id. Other
    columns are not read; an empty table gives no rows.
    """
    bounded_batches(docs.sparkSession)
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type = src.schema["doc_id"].dataType.simpleString()
    blocks = materialize(_blocks(src, bpe or public_path("byte_bpe_50k.json"),
                                 pieces or public_path("piece_bpe_32k.model"), id_type, block_links))
    seen = blocks.select("block", F.posexplode(F.arrays_zip("pairs", "n_docs")).alias("at", "p")).select(
        "block", "at", F.col("p.pairs").alias("pair"), F.col("p.n_docs").alias("n_docs"))
    counts = seen.groupBy("pair").agg(F.sum("n_docs").alias("count"))
    # an A id has at most as many partners as the other vocabulary has ids
    of_a = Window.partitionBy(F.shiftright("pair", 32))
    counts = counts.withColumn("best", F.col("count") == F.max("count").over(of_a))
    answers = seen.join(counts, "pair").select(F.col("block").alias("of_block"), "at", "count", "best")
    schema = f"doc_id {id_type}, " + ", ".join(f"{d} bigint" for d in DIGESTS) + (
        ", n_best bigint, count_sum bigint, groups_sha256 string")

    def answer(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.select(["doc_ends", "words", "times", "word_pairs", "pair_of"]).to_pylist()[0]
        doc_ends, word, times, lengths, pair = (_unpack(row[k], "<i4").astype(np.int64) for k in row)
        order = np.argsort(right.column("at").to_numpy())
        count = right.column("count").to_numpy()[order]
        best = right.column("best").to_numpy(zero_copy_only=False)[order].astype(np.int64)
        word_ends = np.cumsum(lengths)
        sums = []
        for value in (best, count):
            run = np.concatenate(([0], np.cumsum(value[pair])))
            of_word = run[word_ends] - run[word_ends - lengths]
            run = np.concatenate(([0], np.cumsum(of_word[word] * times)))
            sums.append(run[doc_ends] - run[np.concatenate(([0], doc_ends[:-1]))])
        flat = {c: left.column(c).combine_chunks().flatten() for c in ["doc_id", *DIGESTS, "groups_sha256"]}
        return pa.table([flat["doc_id"], *(flat[d] for d in DIGESTS), pa.array(sums[0]), pa.array(sums[1]),
                         flat["groups_sha256"]], ["doc_id", *DIGESTS, "n_best", "count_sum", "groups_sha256"])

    return (blocks.drop("pairs", "n_docs").groupBy("block").cogroup(answers.groupBy("of_block"))
            .applyInArrow(answer, schema))
