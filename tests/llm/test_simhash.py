"""Bit-sliced SimHash against brute force."""

import random

import numpy as np
import pytest
import xxhash

from longform.llm.simhash import bit_sliced_forest, fingerprint, keep_one_per_group, link_fingerprints, simhash_groups

SCHEMA = "doc_id bigint, text string, fp string, component_id string, t int, key string"


def slow_fingerprint(text, k=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words, cur = [], ""
    for c in low + " ":
        if c in "\x20\x09\x0a\x0b\x0c\x0d":
            if cur:
                words.append(cur)
            cur = ""
        else:
            cur += c
    if not words:
        return 0
    grams = [words] if len(words) < k else [words[i:i + k] for i in range(len(words) - k + 1)]
    hashes = [xxhash.xxh64(" ".join(g).encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(values, radius):
    root = list(range(len(values)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a
    for i in range(len(values)):
        for j in range(i):
            if bin(values[i] ^ values[j]).count("1") <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


@pytest.mark.parametrize("text", ["", " \t\x0b", "One", "a B", "a b c", "Ä É x y z A", "w x y z q", "a b c a b c a b c"])
def test_fingerprint(text):
    assert fingerprint(text.encode()) == slow_fingerprint(text)


@pytest.mark.parametrize("radius", [1, 2, 3, 5])
def test_forest_equals_brute_force(radius):
    rng = random.Random(radius)
    groups, fps = [], []
    for g, size in enumerate([1, 2, 70, 3, 150, 1, 64]):
        centre = rng.getrandbits(64)
        for _ in range(size):
            x = centre
            for _ in range(rng.randrange(8)):
                x ^= 1 << rng.randrange(64)
            fps.append(x)
            groups.append(g)
    n = len(fps)
    root = bit_sliced_forest(np.array(fps, np.uint64), np.array(groups), np.zeros(n, int), np.zeros(n, bool), radius)
    at = 0
    for size in [1, 2, 70, 3, 150, 1, 64]:
        assert [r - at for r in root[at:at + size]] == components(fps[at:at + size], radius)
        at += size


def test_links_with_blocks_smaller_than_a_bucket(spark):
    rng = random.Random(5)
    values = list({x for _ in range(6) for c in [rng.getrandbits(64)] for _ in range(60)
                   for x in [c ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64)]})
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    edges = link_fingerprints(spark.createDataFrame([(v,) for v in signed], "fp bigint"), block_rows=16).collect()
    index = {v: i for i, v in enumerate(signed)}
    root = list(range(len(values)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a
    for a, b in edges:
        assert bin(values[index[a]] ^ values[index[b]]).count("1") >= 1
        x, y = find(index[a]), find(index[b])
        root[max(x, y)] = min(x, y)
    assert [find(i) for i in range(len(values))] == components(values, 3)


def documents(spark):
    long = " ".join(f"w{i % 997}" for i in range(30000))
    rows = [(5, "the quick brown fox"), (3, "THE quick  brown\nfox"), (9, None), (8, ""), (7, " \t "), (4, long),
            (2, long + " tail"), (None, "alone here now"), (5, "the quick brown fox"), (None, "the quick brown fox")]
    return spark.createDataFrame([(i, t, "a", "b", 1, "k") for i, t in rows], SCHEMA)


def test_groups(spark):
    got = {(r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash_groups(documents(spark)).collect()}
    assert {(r["doc_id"], r["component_id"]) for r in simhash_groups(documents(spark)).collect()} == {
        (5, 3), (3, 3), (None, 3), (9, 7), (8, 7), (7, 7), (4, 2), (2, 2), (None, None)}
    assert {f for i, f, _ in got if i in (7, 8, 9)} == {"0" * 16}


def test_one_per_group(spark):
    kept = keep_one_per_group(documents(spark))
    assert kept.columns == documents(spark).columns
    assert sorted((r["doc_id"] or -1, (r["text"] or "")[:5]) for r in kept.collect()) == [
        (-1, "alone"), (2, "w0 w1"), (3, "THE q"), (7, " \t ")]
    again = keep_one_per_group(documents(spark).where("doc_id = 5"))
    assert again.count() == 1


def test_empty(spark):
    empty = documents(spark).limit(0)
    assert simhash_groups(empty).count() == 0 and keep_one_per_group(empty).count() == 0


def test_clashing_names(spark):
    df = spark.createDataFrame([(1, "a b", "x", "y", "z", "d"), (1, "a b", "x", "y", "z", "d")],
                               "doc_id bigint, text string, _rep string, _txt string, _N string, `a.b` string")
    kept = keep_one_per_group(df)
    assert kept.columns == df.columns and kept.collect() == df.limit(1).collect()
