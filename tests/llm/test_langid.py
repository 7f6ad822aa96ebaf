"""Byte network: held-out accuracy, gradients, odd rows."""

import random

import numpy as np
from pyspark.sql import functions as F

from longform.llm.common import crc_fold
from longform.llm.langid import FILTERS, WIDTHS, WINDOW, ByteConvNet, identify, train, windows

SCHEMA = "doc_id bigint, text string, lang string, held_out string, score string, lang_pred string"
SYLLABLES = {"en": ["th", "er", "ing", "and", "ou"], "de": ["sch", "ung", "ein", "ü", "ß"], "fr": ["eau", "que", "é", "ç", "oi"]}


def text(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def test_documents(spark):
    rng = random.Random(1)
    rows = [(i, text(rng, lang, rng.randrange(3, 120)), lang) for i in range(400) for lang in [rng.choice(list(SYLLABLES))]]
    odd = [(1000, None, "en"), (1001, "", "en"), (1002, "12 34 !?", "de"), (1003, text(rng, "de", 20_000), None),
           (None, "and thing", "en"), (1004, "and thing", None), (1004, "and thing", None)]
    df = spark.createDataFrame([(*r, "h", "s", "p") for r in rows + odd], SCHEMA)
    out = identify(df, crc_fold("doc_id", 5) == 0)
    got = out.collect()
    assert out.columns == ["doc_id", "held_out", "lang_pred", "score"] and len(got) == len(rows) + len(odd)
    by = {r["doc_id"]: r for r in got}
    right = [by[i]["lang_pred"] == lang for i, _, lang in rows if by[i]["held_out"]]
    assert len(right) > 40 and np.mean(right) >= 0.95
    assert all(by[i]["lang_pred"] == "und" and by[i]["score"] == 0 for i in (1000, 1001, 1002))
    assert by[1003]["lang_pred"] == "de" and by[1004]["lang_pred"] == "en"
    assert all(0 <= r["score"] <= 1 for r in got)
    nothing = identify(df.withColumn("lang", F.lit(None).cast("string")), crc_fold("doc_id", 5) == 0)
    assert {r["lang_pred"] for r in nothing.collect()} == {"und"}
    assert identify(df.limit(0), crc_fold("doc_id", 5) == 0).count() == 0


def test_windows_cover_every_byte():
    x, at = windows([b"", b"ab" * WINDOW, b"a" * (2 * WINDOW + 1)])
    assert list(at) == [0, 1, 1, 2, 2, 2] and x.shape == (6, WINDOW + 3)
    assert (x[1, WINDOW:] == x[2, :3]).all() and x[5, 0] == 1 and (x[5, 1:] == 0).all()


def test_pooling_equals_plain_convolution():
    net = ByteConvNet(["a", "b"])
    x, _ = windows([b"Some text here, and more of it. " * 20])
    vals = net.pool(x)
    for k, w in enumerate(WIDTHS):
        plain = np.max([sum(net.tables[k][o][x[:, t + o]] for o in range(w)) for t in range(WINDOW)], axis=0)
        assert np.allclose(vals[:, k * FILTERS:(k + 1) * FILTERS], plain, atol=1e-5)


def test_every_language_is_learned(spark):
    rows = [(f"word {i} of it", f"l{i:03d}") for i in range(300)] + [("the same text", "copies")] * 200
    df = spark.createDataFrame(rows, "text string, lang string")
    assert train(df, max_docs=100).labels == sorted({lang for _, lang in rows})
    assert train(df.limit(0)) is None
