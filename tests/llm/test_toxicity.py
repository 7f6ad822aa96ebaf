"""Compression distance on held-out text, and odd rows."""

import random

import pytest
from pyspark.sql import functions as F

from longform.llm import toxicity
from longform.llm.toxicity import WINDOW, fit, score_documents, spread, train, windows, words

SCHEMA = "doc_id bigint, text string, toxic string, score double, held_out string"


def corpus(n, seed, share=0.15):
    rng = random.Random(seed)
    syl = ["an", "er", "th", "in", "on", "sh", "re", "ti", "ed", "ha", "en", "st"]
    bad = ["idiot", "scum", "moron", "worthless", "veqo"]
    out = []
    for _ in range(n):
        toxic = rng.random() < share
        ws = ["".join(rng.choice(syl) for _ in range(rng.randrange(1, 5))) for _ in range(rng.randrange(30, 300))]
        if toxic:
            for _ in range(2 + len(ws) // 40):
                w = rng.choice(bad)
                ws[rng.randrange(len(ws))] = w + rng.choice(syl) if w == "veqo" else w
        out.append((" ".join(ws), int(toxic)))
    return out


@pytest.fixture(scope="module")
def model():
    rows = corpus(1500, 1)
    return fit([t.encode() for t, y in rows if y], [t.encode() for t, y in rows if not y])


def test_held_out(model):
    rows = corpus(500, 2)
    got = [s >= 0.3 for s in model.scores([t.encode() for t, _ in rows])]
    hit = sum(g and y for g, (_, y) in zip(got, rows))
    assert hit >= 0.85 * sum(y for _, y in rows) and hit >= 0.85 * sum(got)


def test_insults_at_the_end_of_a_long_text(model):
    plain = " ".join(t for t, y in corpus(40, 3, 0)) + " "
    insult = "you idiot scum worthless moron " * 40
    low, high = model.scores([plain.encode(), (plain + insult).encode()])
    assert low < 0.3 <= high


def test_rows(spark, model):
    df = spark.createDataFrame([(1, None, "1", 9.0, "x"), (2, "", "0", 9.0, "x"), (3, "idiot scum moron " * 9, "0", 9.0, "x"),
                                (3, "idiot scum moron " * 9, "0", 9.0, "x"), (None, "th er in", None, None, None),
                                (5, "x" * 100_000, "0", 9.0, "y")], SCHEMA)
    out = score_documents(df, model)
    rows = out.collect()
    assert sorted(out.columns) == sorted(df.columns) and len(rows) == 6
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert {r["score"] >= 0.3 for r in rows if r["doc_id"] == 3} == {True}
    assert {r["score"] for r in score_documents(df, None).collect()} == {0.0}
    assert score_documents(df.limit(0), model).count() == 0


def test_training_uses_the_admitted_labels_only(spark):
    rows = corpus(300, 4)
    docs = spark.createDataFrame([(i, t, "x", 0.0, "y") for i, (t, _) in enumerate(rows)], SCHEMA)
    labels = spark.createDataFrame([(i, y, "z") for i, (_, y) in enumerate(rows)] + [(7, None, "z"), (None, 1, "z"), (8, 5, "z")],
                                   "doc_id bigint, toxic int, text string")
    assert train(docs, labels, F.col("doc_id") >= 0) is not None
    assert train(docs, labels, F.col("doc_id") < 0) is None
    assert train(docs.limit(0), labels, F.lit(True)) is None
    a, b = (train(docs, labels, F.col("doc_id") % 2 == 0).scores([t.encode() for t, _ in rows[:20]]) for _ in range(2))
    assert list(a) == list(b)


def test_windows_hold_the_whole_text():
    for t in (b"", b"one", b"a b c " * 500, b"x" * 1000 + b" y", "É ß 1 2 ö!".encode() * 50):
        assert b"".join(windows(t)) == b" " + b" ".join(words(t))
        assert all(len(w) <= 2 * WINDOW for w in windows(t))
    assert len(spread(b"abc " * 100_000)) <= 16384 + 15


def test_calibration_holds_for_the_mix_of_all_labelled_rows(spark):
    """A sample of equal classes from 1:12 documents gives a stricter cut than one that stands for itself."""
    rng = random.Random(6)
    rows = [(" ".join(t.split()[:40]) + (" scum idiot" if y or rng.random() < 0.1 else ""), y) for t, y in corpus(5000, 7, 0.08)]
    toxic, ordinary = ([t.encode() for t, y in rows if y == k] for k in (1, 0))
    n = min(len(toxic), 300)
    own, whole = fit(toxic[:n], ordinary[:n]), fit(toxic[:n], ordinary[:n], totals=(len(toxic), len(ordinary)))
    rest = ordinary[n:]
    assert (whole.scores(rest) >= 0.3).sum() < (own.scores(rest) >= 0.3).sum()
    docs = spark.createDataFrame([(i, t, "x", 0.0, "y") for i, (t, _) in enumerate(rows)], SCHEMA)
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(rows)], "doc_id bigint, toxic int")
    model = train(docs, labels, F.lit(True), max_docs=100)
    wide = fit(toxic[:100], ordinary[:100])
    assert (model.scores(rest) >= 0.3).sum() < (wide.scores(rest) >= 0.3).sum()


def test_calibration_counts_whole_texts(spark, monkeypatch):
    """Long texts whose only insults lie between the pieces that the dictionaries see."""
    plain = " ".join(t for t, y in corpus(120, 8, 0))
    long = plain[:60_000] + " "
    step = len(long) // 16
    at = step * 3 + 2000
    hidden = [long[:at] + "scum idiot moron " * 20 + long[at:] + str(i) for i in range(4)]
    assert b"scum" not in spread(hidden[0].encode())
    rows = corpus(200, 9) + [(t, 1) for t in hidden]
    docs = spark.createDataFrame([(i, t, "x", 0.0, "y") for i, (t, _) in enumerate(rows)], SCHEMA)
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(rows)], "doc_id bigint, toxic int")
    got = []
    whole = toxicity.calibrate
    monkeypatch.setattr(toxicity, "calibrate", lambda d, c, y, *rest: got.append((d, c, y)) or whole(d, c, y, *rest))
    assert train(docs, labels, F.lit(True)) is not None
    (distances, counts, y), = got
    assert len(y) == sum(n // 2 for n in (sum(k for _, k in rows), sum(not k for _, k in rows)))
    texts = {k: {tuple(distances[0].counts(t.encode())) for t, c in rows if c == k} for k in (0, 1)}
    assert all(tuple(c) in texts[int(k)] for c, k in zip(counts[0], y))
    assert counts[0].sum(1).max() > 16384 / WINDOW


def test_a_curve_that_ranks_nothing_flags_nothing():
    """Counts that say nothing about the label: every score stays below the threshold; with telling counts it does not."""
    import numpy as np
    rng = np.random.default_rng(2)
    labels = np.repeat([1.0, 0.0], [4, 60])
    blind = np.zeros((64, 24), np.int64)
    blind[:, 0] = 20
    model = toxicity.Toxicity(None, blind, labels, 0.3)
    curve = 1 / (1 + np.exp(-(model._raw(blind) + model.shift)))
    assert (curve < 0.3).all()
    telling = blind + (labels[:, None] * rng.integers(3, 6, (64, 24))).astype(np.int64)
    model = toxicity.Toxicity(None, telling, labels, 0.3)
    curve = 1 / (1 + np.exp(-(model._raw(telling) + model.shift)))
    assert ((curve >= 0.3) == (labels == 1)).all()


def learned(spark, monkeypatch, rows):
    docs = spark.createDataFrame([(i, t, "x", 0.0, "y") for i, (t, _) in enumerate(rows)], SCHEMA)
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(rows)], "doc_id bigint, toxic int")
    got, whole = [], toxicity.calibrate
    monkeypatch.setattr(toxicity, "calibrate", lambda d, c, y, *rest: got.append((d, y)) or whole(d, c, y, *rest))
    train(docs, labels, F.lit(True))
    return got[0]


def test_learning_reads_whole_texts(spark, monkeypatch):
    """A stem that stands between the pieces of an excerpt is learned."""
    plain = " ".join(t for t, y in corpus(120, 10, 0))[:60_000]
    at = plain.index(" ", len(plain) // 16 * 3 + 2000)
    hidden = [plain[:at] + " zorgle" * 5 + plain[at:] + f" {i}" for i in range(16)]
    assert b"zorgle" not in spread(hidden[0].encode())
    distances, _ = learned(spark, monkeypatch, [(f"{plain} {i}", 0) for i in range(16)] + [(t, 1) for t in hidden])
    assert b"zorg" in distances[0].toxic


def test_learning_reads_all_labelled_rows(spark, monkeypatch):
    rows = [(f"th er in an {i:x} " * 2, 0) for i in range(6200)] + [(f"scum idiot {i:x}", 1) for i in range(16)]
    _, y = learned(spark, monkeypatch, rows)
    assert [int((y == k).sum()) for k in (1, 0)] == [8, 3100]


def test_calibration_in_tasks_equals_that_on_the_driver(spark, monkeypatch):
    rows = corpus(400, 11)
    docs = spark.createDataFrame([(i, t, "x", 0.0, "y") for i, (t, _) in enumerate(rows)], SCHEMA)
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(rows)], "doc_id bigint, toxic int")
    here = train(docs, labels, F.lit(True))
    monkeypatch.setattr(toxicity, "HELD_DOCS", 0)
    tasks = train(docs, labels, F.lit(True))
    texts = [t.encode() for t, _ in corpus(100, 12)]
    assert here.distance.toxic == tasks.distance.toxic and here.distance.ordinary == tasks.distance.ordinary
    assert abs(here.scores(texts) - tasks.scores(texts)).max() < 0.01


def test_dictionaries_of_many_groups_are_merged(spark, monkeypatch):
    """Rounds of merging, in whatever order rows come; segments that all parts share stay."""
    rows = [(f"{i:064x}", " ".join(t for t, _ in corpus(10, i, 0))) for i in range(60)]
    docs = spark.createDataFrame(rows, "digest string, text string")
    monkeypatch.setattr(toxicity, "GROUP_BYTES", 32768)
    monkeypatch.setattr(toxicity, "MERGED", 4)
    got = toxicity.ordinary_dictionary(docs)
    assert len(got) == toxicity.ORDINARY_BYTES and got == toxicity.ordinary_dictionary(docs.repartition(7))
    rng = random.Random(5)
    parts = [b"".join(rng.choice([b" lorem ipsum dolor", b" %x" % rng.getrandbits(72)]) for _ in range(220)) for _ in range(8)]
    assert b"lorem ipsum" in toxicity.merged_dictionary(parts)
