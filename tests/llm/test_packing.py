"""Best-fit decreasing packing: exact ids, gapless sequences, little padding, and the tree against a plain search."""

import random
import zlib

import numpy as np
import pytest

from longform.llm import packing
from longform.llm.tokens import byte_bpe, public_path

TEXTS = ["", None, "a", "Hello  world", " lead", "trail ", "a\n b\n\n c", "x <|endoftext|> y", "été 　 wide",
         "word " * 3000, "z" * 5000, "你好" * 700, "tab\t tab", "one two", "one two"]


@pytest.fixture(scope="module")
def direct():
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(public_path("byte_bpe_50k.json"))
    return lambda text: t.encode(text or "", add_special_tokens=False).ids + [0]


def test_ids_of_texts_and_words(direct):
    bpe, rng = byte_bpe(public_path("byte_bpe_50k.json")), random.Random(3)
    alphabet = ["a", "b", "'s", "9", ".", " ", " ", "  ", "\n", "\t", "\xa0", "ß", "好", "᠎", "\x1c", "<|endoftext|>"]
    texts = [t or "" for t in TEXTS] + ["".join(rng.choices(alphabet, k=rng.randrange(40))) for _ in range(3000)]
    texts += [" " * 400000 + "x", " \n" * 300000]
    for text in texts:
        assert np.frombuffer(bpe.encode(text), "<u4").tolist() + [0] == direct(text), repr(text)[:80]
    words = sorted({w for t in texts for w in t.split(" ") if bpe.splits(w)})
    for w, ids in zip(words, bpe.encode_words(words)):
        assert np.frombuffer(ids, "<u4").tolist() + [0] == direct(" " + w), repr(w)


def test_both_encoders_agree_on_every_text(direct):
    """All texts and all words of a table, and random letters, through the rank encoder and the file's own library."""
    import duckdb
    bpe, rng = byte_bpe(public_path("byte_bpe_50k.json")), random.Random(4)
    assert bpe.ranks is not None
    texts = [r[0] or "" for r in duckdb.sql("SELECT text FROM read_parquet('/root/testdata/sf0.01/documents.parquet')").fetchall()]
    latin = [chr(c) for c in (*range(33, 127), *range(161, 592))]
    texts += ["".join(rng.choices(latin, k=rng.randrange(30))) for _ in range(20000)]
    texts += ["".join(rng.choices("etaoinshr", k=rng.randrange(30))) for _ in range(20000)]
    ids = bpe.tokenizer.encode_batch(texts, add_special_tokens=False)
    for t, e in zip(texts, ids):
        assert np.frombuffer(bpe.encode(t), "<u4").tolist() == e.ids, repr(t)[:80]


def test_best_fit_equals_a_plain_search():
    rng = random.Random(5)
    for _ in range(30):
        pieces = [(i, 0, bytes(4 * rng.randrange(1, 64))) for i in range(rng.randrange(1, 200))]
        rooms: list[int] = []
        for p in sorted(pieces, key=lambda p: -len(p[2])):
            need = len(p[2]) // 4
            fits = [r for r in rooms if r >= need]
            if fits:
                rooms.remove(min(fits))
            rooms.append((min(fits) if fits else 64) - need)
        got = packing.best_fit(pieces, 64)
        assert [r for r, _ in got] == sorted(rooms)
        assert all(64 - r == sum(len(p[2]) // 4 for p in m) for r, m in got)
        assert sorted(p for _, m in got for p in m) == sorted(pieces)


def check(rows, texts, direct, window):
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
        assert len(r["ids"]) == 4 * r["length"] > 0
    for i, text in texts.items():
        mine = sorted(by_doc.pop(i), key=lambda r: r["start"])
        want = direct(text)
        assert [r["start"] for r in mine] == [0, *np.cumsum([r["length"] for r in mine])[:-1]]
        assert np.frombuffer(b"".join(r["ids"] for r in mine), "<u4").tolist() == want
        assert {r["doc_tokens"] for r in mine} == {len(want)}
    assert not by_doc
    padding = total = 0
    for members in by_seq.values():
        members.sort(key=lambda r: r["offset"])
        n = sum(r["length"] for r in members)
        assert [r["offset"] for r in members] == [0, *np.cumsum([r["length"] for r in members])[:-1]] and n <= window
        total += n
        padding += 0 if n & (n - 1) == 0 else window - n
    return padding / total


def test_every_id_once_and_little_padding(spark, direct):
    rng = random.Random(7)
    texts = dict(enumerate(TEXTS + [" ".join(rng.choices(["alpha", "beta", "gam", "x", "delta9"], k=rng.randrange(700)))
                                    for _ in range(400)]))
    df = spark.createDataFrame([(i, t, "own") for i, t in texts.items()], "doc_id long, text string, length string")
    for window, group in ((1024, 8192), (64, 50)):
        rows = packing.pack_documents(df.repartition(3), window=window, group=group).collect()
        assert check(rows, texts, direct, window) < 0.02


def test_edges(spark, direct):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack_documents(empty).count() == 0
    one = packing.pack_documents(spark.createDataFrame([(None, None)], "doc_id string, text string")).collect()
    assert [(r["doc_id"], r["start"], r["length"], r["doc_tokens"], r["offset"]) for r in one] == [(None, 0, 1, 1, 0)]
    twice = packing.pack_documents(spark.createDataFrame([(1, "a b"), (1, "a b")], "doc_id int, text string")).collect()
    assert sum(r["length"] for r in twice) == 2 * len(direct("a b"))


def test_sequences_are_padded(spark, direct):
    df = spark.createDataFrame([(i, "w " * (37 * i)) for i in range(60)], "doc_id long, text string").coalesce(1)
    pieces = packing.pack_documents(df, window=128)
    n = 0
    for s in packing.sequences(pieces, 128).collect():
        n += s["n_ids"]
        width = len(s["ids"]) // 4
        assert width == (s["n_ids"] if s["n_ids"] & (s["n_ids"] - 1) == 0 else 128)
        assert not any(s["ids"][4 * s["n_ids"]:])
    assert n == sum(len(direct("w " * (37 * i))) for i in range(60))


def test_query(spark, direct):
    import duckdb

    from longform.llm import queries
    sf = "/root/testdata/sf0.001"
    docs = dict(duckdb.sql(f"SELECT doc_id, text FROM read_parquet('{sf}/documents.parquet')").fetchall())
    df = queries.queries()["op12_packing"](spark, sf)
    rows = df.collect()
    assert {r["doc_id"] for r in rows} == set(docs)
    for i, text in docs.items():
        ids = np.array(direct(text), "<u4")
        for r in (r for r in rows if r["doc_id"] == i):
            assert r["ids_crc32"] == zlib.crc32(ids[r["start"]:r["start"] + r["length"]].tobytes())
            assert r["doc_tokens"] == len(ids)
