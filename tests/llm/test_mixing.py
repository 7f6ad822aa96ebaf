"""Mixing against the iterative definition."""

import hashlib
import re
from fractions import Fraction

from longform.llm.mixing import emit_mix, mix_plan

SCHEMA = "doc_id bigint, text string, source string, size string, target string, cap int, w int, part int"


def brute(rows):
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _ in rows]
    total = {}
    for (_, _, s), n in zip(rows, size):
        total[s] = total.get(s, 0) + n
    names = sorted(total, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    target = {s: Fraction(0) for s in names}
    rest, free = Fraction(sum(size)), list(names)
    while rest and free:
        share = sum(weight[s] for s in free)
        for s in free:
            target[s] += rest * weight[s] / share
        rest = sum((target[s] - 3 * total[s] for s in free if target[s] > 3 * total[s]), Fraction(0))
        for s in free:
            target[s] = min(target[s], Fraction(3 * total[s]))
        free = [s for s in free if target[s] < 3 * total[s]]
    out = []
    for (i, _, s), n in zip(rows, size):
        rate = float(target[s]) / total[s] if total[s] else 0.0
        draw = int(hashlib.md5(f"mix-1:{'' if i is None else i}".encode()).hexdigest()[:13], 16)
        copies = int(rate) + (draw < (rate - int(rate)) * 16 ** 13)
        out.append((str(i), n, total[s], round(float(target[s]), 6), n * copies))
    return sorted(out), names


ROWS = ([(i, "a b c " * (1 + i % 4), "hot") for i in range(60)] + [(100 + i, "x y", "b") for i in range(3)]
        + [(200 + i, "q\x0br\xa0s \t t", "éz") for i in range(8)] + [(300, None, "b"), (301, "", "void"), (302, "", "void"),
           (303, "n n n", None), (None, "k k", None), (303, "n n n", None), (400, "word " * 50000, "long")])


def frame(spark, rows):
    return spark.createDataFrame([(*r, "1", "2", 3, 4, 5) for r in rows], SCHEMA)


def test_plan(spark):
    got = sorted((str(r["doc_id"]), r["size"], r["source_size"], round(r["target"], 6), r["taken"])
                 for r in mix_plan(frame(spark, ROWS)).collect())
    assert got == brute(ROWS)[0]


def test_emitted_rows_are_the_plan(spark):
    df = frame(spark, ROWS)
    out = emit_mix(df)
    assert out.columns == df.columns
    assert out.count() == sum(r["copies"] for r in mix_plan(df).collect())
    assert sorted(map(str, out.collect())) == sorted(map(str, emit_mix(df).collect()))


def test_empty(spark):
    assert mix_plan(frame(spark, ROWS).limit(0)).count() == 0 and emit_mix(frame(spark, ROWS).limit(0)).count() == 0


def test_clashing_names(spark):
    df = spark.createDataFrame([(1, "a b", "s", "x", "y", "z", "k", "d")],
                               "doc_id bigint, text string, source string, _of string, _PER string, _n string, _copy string, `a.b` string")
    assert set(map(tuple, emit_mix(df).collect())) <= set(map(tuple, df.collect()))
    assert emit_mix(df).columns == df.columns
