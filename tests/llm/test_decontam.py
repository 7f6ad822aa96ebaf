"""MinHash containment search against exact containment of all pairs."""

import random

from longform.llm.decontam import contained_items, drop_contaminated, normal, shingle_hashes, shingles

DOCS = "doc_id bigint, text string, item_id string, containment int, n_shared string"
ITEMS = "item_id bigint, text string, doc_id string"


def brute(docs, items):
    out = set()
    for i, q in items:
        qw = normal(q).split()
        if not qw:
            continue
        n = min(5, len(qw))
        want = shingles(qw, n)
        for d, t in docs:
            shared = len(want & shingles(normal(t).split(), n))
            if shared >= 0.8 * len(want):
                out.add((d, i, len(want), shared))
    return out


def data():
    rng = random.Random(1)
    word = [f"w{rng.randrange(10**6)}" for _ in range(5000)]
    text = lambda n: " ".join(rng.choice(word) for _ in range(n))
    items = [(i, text(n)) for i, n in enumerate([5, 6, 8, 12, 15, 16, 17, 30, 33, 57, 64, 65, 300, 3, 1])]
    items += [(90, None), (91, ""), (92, "!?"), (93, items[5][1]), (94, "Über: ÉCOLE straße (vier) fünf")]
    docs = []
    for i, q in items:
        words = (q or "").split()
        docs.append((1000 + i, f"{text(3000)} {q} {text(2000)}"))
        docs.append((2000 + i, f"{text(40)} {(q or '').upper().replace(' ', ', ')} {text(7)}"))
        cut = max(1, len(words) * 9 // 10)
        docs.append((3000 + i, f"{text(500)} {' '.join(words[:cut])} {text(5)}"))
        docs.append((4000 + i, f"{text(500)} {' '.join(words[:max(1, len(words) // 2)])} {text(5)}"))
    # The shingles of one item, scattered over a long document.
    parts = items[12][1].split()
    docs.append((5000, " ".join(f"{' '.join(parts[k:k + 30])} {text(200)}" for k in range(0, 300, 20))))
    docs += [(None, None), (6000, ""), (6001, "w"), (None, items[3][1]), (6002, items[4][1]), (6002, items[4][1]),
             (7000, text(60_000) + " " + items[9][1])]
    return docs, items


def frames(spark, docs, items):
    return (spark.createDataFrame([(i, t, "a", 1, "b") for i, t in docs], DOCS),
            spark.createDataFrame([(i, t, "c") for i, t in items], ITEMS))


def test_equals_all_pairs(spark):
    docs, items = data()
    d, q = frames(spark, docs, items)
    want = brute(docs, items)
    assert len(want) > 40
    for size in (1 << 20, 700):  # one block of items, and many
        got = contained_items(d, q, block_bytes=size).collect()
        assert {tuple(r)[:4] for r in got} == want and len(got) == len(want)
        assert all(r["containment"] == r["n_shared"] / r["n_shingles"] for r in got)


def test_drop(spark):
    docs, items = data()
    d, q = frames(spark, docs, items)
    bad = {x[0] for x in brute(docs, items)}
    kept = drop_contaminated(d, q)
    assert kept.columns == d.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(i) for i, _ in docs if i not in bad)


def test_empty(spark):
    docs, items = data()
    d, q = frames(spark, docs, items)
    assert contained_items(d.limit(0), q).count() == 0
    assert contained_items(d, q.limit(0)).count() == 0
    assert drop_contaminated(d, q.limit(0)).count() == len(docs)


def test_rolling_hashes_depend_on_the_shingle_alone():
    a, b = normal("x " * 70000 + "one two three four five six"), normal("one two three four five six")
    assert list(shingle_hashes(a, 5)[-2:]) == list(shingle_hashes(b, 5))
    assert len(set(shingle_hashes(a, 5))) == 7


def test_clashing_names_and_types_of_ids(spark):
    text = "one two three four five six seven"
    df = spark.createDataFrame([("p", text, "x", "d"), ("q", "other words", "x", "d")], "doc_id string, text string, _BAD string, `a.b` string")
    for kind in ("date", "decimal(9,2)", "smallint"):
        items = spark.createDataFrame([("7", text)], "k string, text string").selectExpr(
            "date'2024-01-02' AS item_id" if kind == "date" else f"CAST(k AS {kind}) AS item_id", "text")
        assert [r["item_id"] for r in contained_items(df, items).collect()] == [items.first()["item_id"]]
    kept = drop_contaminated(df, items)
    assert kept.columns == df.columns and [r["doc_id"] for r in kept.collect()] == ["q"]
