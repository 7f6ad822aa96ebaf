"""Norm-bucket search against scoring every document."""

import random
from collections import Counter
from math import floor, log

import numpy as np
import pytest

from longform.llm import ranked_search


def brute(docs, items, top=10):
    """(item id, rank, doc id, score) for every item row."""
    tfs = [(i, Counter(ranked_search.terms(t))) for i, t in docs]
    tfs = [(i, c) for i, c in tfs if c]
    n_docs, total = len(tfs), sum(c.total() for _, c in tfs)
    df = Counter(t for _, c in tfs for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c in tfs:
            m = 100 - 90 + 90 * c.total() * n_docs // total
            s = sum(floor(1000 * log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m))
                    for t in set(ranked_search.terms(text)) if c[t])
            if s > 0:
                scored.append((-s, i is None, i))
        out += [(item, r, i, -s) for r, (s, _, i) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out, key=str)


def rows_of(df):
    assert df.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_terms():
    assert ranked_search.terms("It's ÉTÉ_9\x00Ä-b　c") == [
        b"it", b"s", "ÉtÉ".encode(), b"9", "Ä".encode(), "b　c".encode()]
    assert ranked_search.terms(None) == ranked_search.terms(" \t.") == []


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(13)
    words = [f"w{i}" for i in range(400)] + ["ÉTÉ", "été", "The", "the"]
    weights = [1 / (i + 1) for i in range(len(words))]
    docs = [(i, " ".join(rng.choices(words, weights, k=rng.randrange(1, 90)))) for i in range(900)]
    docs += [(900 + i, "The w7 w30 w301 w399") for i in range(60)] + [(2000, "w5 " * 30000), (2001, ""), (2002, None),
                                                                      (2003, "...")]
    items = [(i, " ".join(rng.choices(words, weights, k=rng.randrange(1, 30)))) for i in range(25)]
    items += [(40, "w7, W30! w301 w399"), (41, None), (42, ""), (43, "nowhere"), (44, "the"), (40, "w7, W30! w301 w399")]
    return docs, items


def test_equals_brute_force(spark, corpus, monkeypatch):
    docs, items = corpus
    d = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, score int").repartition(3)
    q = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id int, text string, term string")
    want = brute(docs, items)
    assert rows_of(ranked_search.search(d, q)) == want
    monkeypatch.setattr(ranked_search, "BUCKET", 16)
    assert rows_of(ranked_search.search(d, q, block_bytes=300)) == want


def test_buckets_prune_and_lose_nothing(corpus):
    """The bound on the focus coordinates holds for every document, and spares documents the exact score."""
    docs, items = corpus
    block = ranked_search.ItemBlock([i for i in items if i[0] < 40])
    held = []
    for _, text in docs:
        words = [w for w in ranked_search.terms(text) if w in block.number]
        held.append((Counter(block.number[w] for w in words), len(ranked_search.terms(text))))
    block.weigh(len(docs), Counter(t for c, _ in held for t in c))
    dense = np.zeros((len(docs), len(block.number)), np.int64)
    for row, (c, n) in zip(dense, held):
        for t, tf in c.items():
            row[t] = block.weights[t] * (10**9 * tf // (1000 * tf + 8 * (10 + 2 * n)))
    dense = dense[np.argsort(-np.sqrt((dense.astype(float) ** 2).sum(1)))]
    rows, cols = np.nonzero(dense)
    lengths = np.sqrt((dense.astype(float) ** 2).sum(1))
    bucket = ranked_search.Bucket(lengths, np.cumsum(np.bincount(rows, minlength=len(docs))), cols, dense[rows, cols])
    kept = total = 0
    for ts, focus in zip(block.terms, block.focus):
        wanted = np.zeros(len(block.number), bool)
        wanted[ts] = True
        exact = dense[:, ts].sum(1)
        assert (bucket.scores(np.arange(len(docs)), wanted) == exact).all()
        least = int(np.sort(exact)[-10])
        some = bucket.survivors(focus, len(ts) - len(focus), least)
        assert set(np.flatnonzero(exact >= least)) <= set(some)
        kept, total = kept + len(some), total + len(docs)
    assert kept < 0.8 * total


def test_edges(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert ranked_search.search(docs, items).count() == 0
    full = spark.createDataFrame([(None, "a x"), ("k", "a x"), ("k", "a x"), (None, "a x"), ("j", "y")],
                                 "doc_id string, text string")
    assert ranked_search.search(full, items.limit(0)).count() == 0
    got = rows_of(ranked_search.search(full, items, top=3))
    assert got == brute([(r[0], r[1]) for r in full.collect()], [(1, "a b")], 3)
    assert [r[2] for r in sorted(got, key=lambda r: r[1])] == ["k", "k", None]


def test_large_numbers_do_not_overflow():
    n, n_docs, total = np.array([10**6, 3]), 10**12, 10**15
    assert ranked_search.length_norms(n, n_docs, total).tolist() == [10 + 90 * int(x) * n_docs // total for x in n]
