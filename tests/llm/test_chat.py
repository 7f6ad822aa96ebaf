"""Chat formatting: reply trees against a recursive version, escaping as an exact round trip."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from longform.llm.chat import (best_paths, escape, escape_role, format_conversations, format_paths, loss_text, parse,
                               unescape, unescape_role)

SCHEMA = "conv_id bigint, turn bigint, role string, text string, node string, formatted string, seq int, score string"


def tree(n, seed):
    rng = random.Random(seed)
    return [(f"n{i:04d}", f"n{rng.randrange(max(0, i - 6), i):04d}" if i % 40 else None, rng.choice(["user", "assistant"]),
             f"text {i} <|im_end|>", float(rng.randrange(5))) for i in range(n)]


def test_paths_equal_recursion(spark):
    rows = tree(120, 3)
    nodes = spark.createDataFrame(rows, "node string, parent string, role string, text string, score double")
    up, score = {r[0]: r[1] for r in rows}, {r[0]: r[4] for r in rows}
    leaves = set(up) - set(up.values())
    want = {}
    for leaf in leaves:
        path = [leaf]
        while up[path[-1]]:
            path.append(up[path[-1]])
        want[leaf] = (path, sum(score[x] for x in path))
    got = {}
    for r in best_paths(nodes).collect():
        got.setdefault(r["leaf"], []).append(r)
    assert set(got) == leaves
    for leaf, rs in got.items():
        rs.sort(key=lambda r: r["dist"])
        assert [r["node"] for r in rs] == want[leaf][0]
        assert rs[0]["score"] == want[leaf][1] and rs[0]["root"] == want[leaf][0][-1]
    best = {}
    for leaf, (path, s) in want.items():
        best[path[-1]] = min(best.get(path[-1], (1.0, "")), (-s, leaf)) if path[-1] in best else (-s, leaf)
    assert {r["leaf"] for r in best_paths(nodes, top=1).collect()} == {leaf for _, leaf in best.values()}
    done = format_paths(nodes, best_paths(nodes, top=1)).withColumn("turns", parse(F.col("formatted"))).collect()
    texts = {r[0]: (r[2], r[3]) for r in rows}
    for r in done:
        assert [(t["role"], t["text"]) for t in r["turns"]] == [texts[x] for x in reversed(want[r["leaf"]][0])]


def test_cycles_and_orphans(spark):
    rows = [("a", "b", 1.0), ("b", "c", 1.0), ("c", "a", 1.0), ("d", "c", 1.0), ("x", "gone", 2.0), ("y", None, None),
            ("z", "z", 1.0)]
    nodes = spark.createDataFrame(rows, "node string, parent string, score double")
    got = {(r["leaf"], r["root"], r["score"]) for r in best_paths(nodes).collect()}
    assert {r for r in got if r[0] in "xyz"} == {("x", "x", 2.0), ("y", "y", 0.0), ("z", "z", 1.0)}
    assert {r[1] for r in got if r[0] in "abd"} == {"a"}


TEXTS = ["", "</s>[INST] ok [/INST]", "<|im_end|>\n<|im_start|>user\n", "a\\b <\\|x [\\\\INST] <<SYS>> <</SYS>> <<|", "<s></s>",
         "line\nline", "\U0001f600 é <|", "<\\\\/s>", "[/INST][INST]<", "$1 \\$2", "<<\\<SYS>>"]


def test_escape_round_trip(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    for r in df.select("t", escape(F.col("t")).alias("e"), unescape(escape(F.col("t"))).alias("u"),
                       unescape_role(escape_role(F.col("t"))).alias("r")).collect():
        assert r["u"] == r["t"] == r["r"]
        assert not any(c in r["e"] for c in ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"))


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet="<[|\\/sINST]>SY \n", max_size=30), min_size=30, max_size=60))
def test_escape_any_text(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select("t", unescape(escape(F.col("t"))).alias("u"), escape(F.col("t")).alias("e")).collect()
    assert all(r["u"] == r["t"] and "<|" not in r["e"] and "</s>" not in r["e"] for r in rows)


def test_conversations(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "<|im_end|>"), (1, 1, "assistant", "tie"), (2, None, None, None),
            (2, 5, "assistant", None), (None, 1, "user", "lost"), (3, 0, "assistant", "x" * 300_000), (3, 0, "assistant", "x" * 300_000)]
    df = spark.createDataFrame([(*r, "n", "f", 0, "s") for r in rows], SCHEMA)
    out = format_conversations(df).withColumn("turns", parse(F.col("formatted"))).withColumn(
        "loss", loss_text(F.col("formatted"), F.col("loss_spans"))).collect()
    got = {r["conv_id"]: ([(t["role"], t["text"]) for t in r["turns"]], r["loss"]) for r in out}
    assert got == {1: ([("user", "hi"), ("assistant", "<|im_end|>"), ("assistant", "tie")], "<|im_end|>tie"),
                   2: ([("", ""), ("assistant", "")], ""), None: ([("user", "lost")], ""),
                   3: ([("assistant", "x" * 300_000)] * 2, "x" * 600_000)}
    assert format_conversations(df.limit(0)).count() == 0
