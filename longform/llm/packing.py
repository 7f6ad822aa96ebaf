"""Packing documents into training sequences: best-fit decreasing over a segment tree of open windows.

Every task packs the documents of its own partition, so texts and ids are never shuffled. A document longer than the
window is first cut into full windows, each a sequence of its own; what remains of it, and all shorter documents, are
pieces. Pieces are packed in groups of bounded size, longest first: a segment tree indexed by remaining capacity finds the
tightest open window that still holds the piece, in a number of steps that depends on the window length only. At the end of a
group the emptiest windows are opened again and their pieces cut to fill the gaps of the others; what is left goes on
to the next group. The last leftover of a partition is cut into sequences whose lengths are powers of two, which need
no padding.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from longform.llm.common import bounded_batches, chunks
from longform.llm.tokens import byte_bpe, public_path

WINDOW = 1024
END_ID = 0
GROUP = 8192
LEAST_CUT = 8

# (document, first id, ids as bytes): a run of one document's ids. ``document`` is an index into the task's list.
Piece = tuple[int, int, bytes]


class OpenWindows:
    """Open windows by remaining capacity: a segment tree of counts over the capacities, and a stack for each."""

    def __init__(self, window: int):
        self.size = 1 << window.bit_length()
        self.count = [0] * (2 * self.size)
        self.stacks: list[list[list[Piece]]] = [[] for _ in range(window + 1)]

    def put(self, room: int, pieces: list[Piece]) -> None:
        self.stacks[room].append(pieces)
        i = room + self.size
        while i:
            self.count[i] += 1
            i >>= 1

    def take(self, need: int) -> tuple[int, list[Piece]] | None:
        """The window with the least room of at least ``need``, taken out; None if there is none."""
        i = need + self.size
        if not self.count[i]:
            while i > 1 and (i & 1 or not self.count[i + 1]):
                i >>= 1
            if i == 1:
                return None
            i += 1
            while i < self.size:
                i = 2 * i if self.count[2 * i] else 2 * i + 1
        room = i - self.size
        while i:
            self.count[i] -= 1
            i >>= 1
        return room, self.stacks[room].pop()

    def by_room(self) -> Iterator[tuple[int, list[Piece]]]:
        """All windows, fullest first."""
        for room, stack in enumerate(self.stacks):
            for pieces in stack:
                yield room, pieces


def best_fit(pieces: list[Piece], window: int) -> list[tuple[int, list[Piece]]]:
    """(room, pieces) of each window, fullest first, by best-fit decreasing."""
    open_ = OpenWindows(window)
    for piece in sorted(pieces, key=lambda p: (-len(p[2]), p[0], p[1])):
        need = len(piece[2]) // 4
        room, members = open_.take(need) or (window, [])
        members.append(piece)
        open_.put(room - need, members)
    return list(open_.by_room())


def fill_gaps(windows: list[tuple[int, list[Piece]]], least: int) -> tuple[list[list[Piece]], list[Piece]]:
    """(sequences, pieces left over). The emptiest windows give their pieces, cut where needed, to the gaps of at least
    ``least`` ids in the fuller ones; the last receiver, if it has such a gap, is left over."""
    done: list[list[Piece]] = []
    i, j, loose = 0, len(windows), []
    while i < j or loose:
        if i < j:
            room, members = windows[i]
            i += 1
        else:
            return done, loose
        while room >= least:
            if not loose:
                if i == j:
                    return done, members
                j -= 1
                loose = list(windows[j][1])
            doc, start, ids = loose.pop()
            cut = min(room, len(ids) // 4)
            members.append((doc, start, ids[:4 * cut]))
            room -= cut
            if 4 * cut < len(ids):
                loose.append((doc, start + cut, ids[4 * cut:]))
        done.append(members)
    return done, loose


def powers_of_two(pieces: list[Piece]) -> list[list[Piece]]:
    """Sequences of all the pieces whose lengths are powers of two, longest first (less than a window in all)."""
    left = sum(len(p[2]) // 4 for p in pieces)
    out, rest = [], list(reversed(pieces))
    while left:
        room = 1 << (left.bit_length() - 1)
        left -= room
        members = []
        while room:
            doc, start, ids = rest.pop()
            cut = min(room, len(ids) // 4)
            members.append((doc, start, ids[:4 * cut]))
            room -= cut
            if 4 * cut < len(ids):
                rest.append((doc, start + cut, ids[4 * cut:]))
        out.append(members)
    return out


def pack_documents(docs: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text",
                   window: int = WINDOW, end_id: int = END_ID, group: int = GROUP, least_cut: int = LEAST_CUT) -> DataFrame:
    """One row a piece: ``doc_id``, ``start`` (the document's ids before it), ``length``, ``ids`` (binary, little-endian
    unsigned 32-bit), ``doc_tokens``, ``sequence_id``, ``offset`` (in the sequence, without gaps from 0).

    A document is its text's ids and ``end_id``; a null text is empty, so it and an empty one are one piece of one id.
    Every row is a document of its own: repeated rows and rows of one id or of null ids are packed each. Other columns are
    not read; an empty table gives no rows. A group holds at most ``group`` pieces shorter than a window; gaps of fewer
    than ``least_cut`` ids stay padding. Sequence ids are unique and the same in a task that runs again.
    """
    bounded_batches(docs.sparkSession)
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    path = tokenizer or public_path("byte_bpe_50k.json")
    id_type = src.schema["doc_id"].dataType.simpleString()
    schema = (f"doc_id {id_type}, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, "
              "offset bigint")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, end = byte_bpe(path), end_id.to_bytes(4, "little")
        next_id = TaskContext.get().partitionId() << 33
        names, sizes, pieces, kind = [], [], [], pa.int64()

        def rows(sequences: list[list[Piece]]) -> pa.RecordBatch:
            nonlocal next_id
            cols: list[list] = [[], [], [], [], [], [], []]
            for members in sequences:
                lengths = [len(p[2]) // 4 for p in members]
                for (doc, start, ids), n, at in zip(members, lengths, accumulate(lengths, initial=0)):
                    for c, v in zip(cols, (names[doc], start, n, ids, sizes[doc], next_id, at)):
                        c.append(v)
                next_id += 1
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, (kind, pa.int64(), pa.int64(), pa.binary(), pa.int64(),
                                                       pa.int64(), pa.int64()))],
                ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

        def close() -> tuple[list[list[Piece]], list[Piece]]:
            return fill_gaps(best_fit(pieces, window), least_cut)

        for rb in batches:
            kind = rb.schema.field("doc_id").type
            keys, texts = rb.column("doc_id").to_pylist(), [t or "" for t in rb.column("text").to_pylist()]
            for s, e in chunks(texts, 4 << 20):
                full = []
                for key, ids in zip(keys[s:e], map(bpe.encode, texts[s:e])):
                    ids += end
                    doc, n = len(names), len(ids) // 4
                    names.append(key)
                    sizes.append(n)
                    whole = n - n % window
                    full += [[(doc, i, ids[4 * i:4 * (i + window)])] for i in range(0, whole, window)]
                    if whole < n:
                        pieces.append((doc, whole, ids[4 * whole:]))
                yield rows(full)
                if len(pieces) >= group:
                    done, pieces = close()
                    yield rows(done)
                    # documents of the leftover alone are still needed
                    names, sizes, pieces = ([names[p[0]] for p in pieces], [sizes[p[0]] for p in pieces],
                                            [(i, p[1], p[2]) for i, p in enumerate(pieces)])
        done, pieces = close()
        yield rows(done)
        yield rows(powers_of_two(pieces))

    return src.mapInArrow(run, schema)


def sequences(pieces: DataFrame, window: int = WINDOW, pad_id: int = END_ID) -> DataFrame:
    """``(sequence_id, ids, n_ids, doc_ids)``: each sequence's ids, padded to ``window`` unless their number is a power of
    two. A sequence is at most ``window`` ids, so a group is bounded."""
    one = F.struct("offset", "ids", "doc_id")
    s = pieces.groupBy("sequence_id").agg(F.array_sort(F.collect_list(one)).alias("m"), F.sum("length").alias("n_ids"))
    parts = F.transform("m", lambda x: F.hex(x["ids"]))
    pad = F.when(F.bit_count("n_ids") == 1, F.lit(0)).otherwise(F.lit(window) - F.col("n_ids")).cast("int")
    padded = F.unhex(F.concat(F.array_join(parts, ""), F.repeat(F.lit(pad_id.to_bytes(4, "little").hex()), pad)))
    return s.select("sequence_id", padded.alias("ids"), "n_ids", F.transform("m", lambda x: x["doc_id"]).alias("doc_ids"))
