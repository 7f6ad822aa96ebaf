"""Window network: gradients by finite differences, probabilities, and what training does."""

import random
import zlib
from collections import Counter

import numpy as np

from longform.llm.lm_score import (BUCKETS, HALF, SIDE, VOCABULARY, Vocabulary, WindowNet, initial, pseudo_likelihood, tokens,
                                   train, vocabulary)

SCHEMA = "doc_id bigint, text string, log_prob string, n_tokens string, word string, n int"


def test_tokens_keep_documents_apart():
    ids, at, text = tokens([b"A b", b"", b"b \x0bc"], Vocabulary([b"a", b"b"]))
    bucket = Vocabulary([b"a", b"b"])[b"c"]
    assert list(ids[at]) == [0, 1, 1, bucket] and list(text) == [0, 0, 2, 2]
    assert bucket >= VOCABULARY - BUCKETS
    assert all(ids[p + o] == VOCABULARY for p, o in ((at[0], -1), (at[0], -2), (at[1], 1), (at[2], -1), (at[3], 2)))
    assert len(ids) >= at[-1] + SIDE + 1


def test_probabilities_sum_to_one():
    net = WindowNet(initial())
    ids = np.array([VOCABULARY] * 2 + [3, 0, 5] + [VOCABULARY] * 2, np.int32)
    total = 0.0
    for v in range(VOCABULARY):
        ids[3] = v
        total += np.exp(net.log_prob(ids, np.array([3]))[0])
    assert abs(total - 1) < 1e-4


def test_gradient():
    """A step of Adagrad moves against the gradient: compare with finite differences of the loss."""
    rng = np.random.default_rng(0)
    ids = rng.integers(0, VOCABULARY, 300).astype(np.int32)
    at = np.arange(2, 298)
    net = WindowNet(initial())
    before = net.flat.copy()
    net.learn(ids, at, rate=1.0)
    grad = np.sqrt(net.square - 1e-4) * np.sign(before - net.flat)
    for i in rng.choice(np.flatnonzero(np.abs(grad) > 2e-3), 12, replace=False):
        loss = []
        for d in (1e-2, -1e-2):
            w = before.copy()
            w[i] += d
            loss.append(-WindowNet(w).log_prob(ids, at).mean())
        assert abs((loss[0] - loss[1]) / 2e-2 - grad[i]) < 0.1 * abs(grad[i]) + 2e-4
    assert HALF * HALF == VOCABULARY


def test_scores(spark):
    rng = random.Random(1)
    # Every second word follows from its neighbours.
    def text(n):
        out = []
        for _ in range(n):
            k = rng.randrange(8)
            out += [f"a{k}", f"b{k}"]
        return " ".join(out)
    rows = [(i, text(60)) for i in range(400)]
    shuffled = [(1000 + i, " ".join(rng.sample(t.split(), len(t.split())))) for i, t in rows[:40]]
    odd = [(None, "a1 b1"), (5000, None), (5001, ""), (5002, text(30_000)), (5003, "a1 b1"), (5003, "a1 b1")]
    df = spark.createDataFrame([(*r, "l", "n", "w", 1) for r in rows + shuffled + odd], SCHEMA)
    out = pseudo_likelihood(df).collect()
    assert len(out) == len(rows) + len(shuffled) + len(odd)
    by = {r["doc_id"]: r for r in out}
    assert by[5000]["log_prob"] == 0 and by[5001]["mean_log_prob"] is None and by[5002]["n_tokens"] == 60_000
    good = np.mean([by[i]["mean_log_prob"] for i, _ in rows[:40]])
    bad = np.mean([by[i]["mean_log_prob"] for i, _ in shuffled])
    assert good > bad + 0.3 and good > np.log(1 / 16)
    assert abs(by[7]["log_prob"] / by[7]["n_tokens"] - by[7]["mean_log_prob"]) < 1e-9
    assert vocabulary(df)[:16] and pseudo_likelihood(df.limit(0)).count() == 0


def test_words_of_a_bucket_have_probabilities_of_their_own(spark):
    """Two words of one bucket differ by the log ratio of their counts, looked up or joined; sums equal brute force."""
    rng = random.Random(5)
    common = [f"c{i}" for i in range(VOCABULARY - BUCKETS)]
    rare = [f"r{i}" for i in range(3000)]
    bucket = {}
    for w in rare:
        bucket.setdefault(zlib.crc32(w.encode()) % BUCKETS, []).append(w)
    often, once = next(b for b in bucket.values() if len(b) > 1)[:2]
    texts = [" ".join(common) for _ in range(40)] + [" ".join(rng.sample(rare, 300)) for _ in range(20)]
    texts += [f"{often} {often}"] * 7 + [f"c1 c2 {often} c3 c4", f"c1 c2 {once} c3 c4", "c1 c2", None, f"{once} {once}"]
    df = spark.createDataFrame([(i, t, "l", "n", "w", 1) for i, t in enumerate(texts)], SCHEMA)
    counts = Counter(w for t in texts for w in (t or "").split())
    top = {w for w, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:VOCABULARY - BUCKETS]}
    size = Counter()
    for w, n in counts.items():
        if w not in top:
            size[zlib.crc32(w.encode()) % BUCKETS] += n
    out = [{r["doc_id"]: r for r in pseudo_likelihood(df, local=n).collect()} for n in (0, 1500, 8192)]
    n = len(texts)
    words = vocabulary(df)
    net, known = WindowNet(train(df, words)), Vocabulary(words)
    for by in out:
        assert len(by) == n
        assert abs(by[n - 5]["log_prob"] - by[n - 4]["log_prob"] - np.log(counts[often] / counts[once])) < 1e-6
        for i, t in enumerate(texts):
            ids, at, _ = tokens([(t or "").encode()], known)
            want = net.log_prob(ids, at).sum() + sum(np.log(counts[w] / size[zlib.crc32(w.encode()) % BUCKETS])
                                                     for w in (t or "").split() if w not in top)
            assert abs(by[i]["log_prob"] - want) < 1e-3 + 1e-5 * abs(want)
