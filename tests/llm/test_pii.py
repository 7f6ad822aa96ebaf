"""Feistel pseudonyms against a plain Python version of the network, and their properties."""

import datetime
import hashlib
import random
import re

from pyspark.sql import functions as F

from longform.llm.pii import KEY, KEY_SETTING, ROUNDS, permute, pseudonymize

SCHEMA = "doc_id bigint, text string, found string, kind string, gaps int"


def network(symbols, kind, key=KEY):
    v, m = [list(x) for x in zip(*symbols)]
    half = len(v) // 2
    for r in range(1, ROUNDS + 1):
        first = r % 2 == 0
        still = ",".join(str(x) for i, x in enumerate(v) if (i < half) != first)
        seed = f"{key}:{kind}:{r}:{len(v)}:{still}"
        v = [(x + int(hashlib.md5(f"{seed}#{i}".encode()).hexdigest()[:12], 16)) % m[i] if (i < half) == first else x
             for i, x in enumerate(v)]
    return v


def chars(value, kind):
    sym = [(int(c), 10) if c.isdigit() and c.isascii() else (ord(c) - 97, 26) if "a" <= c <= "z" else
           (ord(c) - 65, 26) if "A" <= c <= "Z" else (0, 1) for c in value]
    return "".join(str(v) if m == 10 else c if m == 1 else chr(v + (97 if c.islower() else 65))
                   for c, v, (_, m) in zip(value, network(sym, kind), sym))


def refill(value, core):
    new = iter(core)
    return "".join(next(new) if c.isdigit() else c for c in value)


def luhn(d):
    return sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (c > "4") for i, c in enumerate(reversed(d))) % 10 == 0


def card(value):
    d = re.sub("[^0-9]", "", value)
    body = chars(d[:-1], "card")
    return refill(value, body + next(c for c in "0123456789" if luhn(body + c)))


def date(d):
    n = (d - datetime.date(1900, 1, 1)).days
    a, b = network([(n // 4297, 17), (n % 4297, 4297)], "date")
    return datetime.date(1900, 1, 1) + datetime.timedelta(a * 4297 + b)


def mod97(s):
    return int("".join(str(int(c, 36)) for c in s)) % 97


def iban(value):
    p = value.replace(" ", "")
    body = chars(p[4:], "iban")
    new = iter(p[:2] + f"{98 - mod97(body + p[:2] + '00'):02d}" + body)
    return "".join(c if c == " " else next(new) for c in value)


def make_card(rng, n=16):
    body = "".join(rng.choice("0123456789") for _ in range(n - 1))
    return body + next(c for c in "0123456789" if luhn(body + c))


def rewrite(spark, texts):
    df = spark.createDataFrame([(i, t, "x", "y", 1) for i, t in enumerate(texts)], SCHEMA)
    return [(r["text"], r["n"]) for r in pseudonymize(df, found_col="n").orderBy("doc_id").collect()]


def test_network(spark):
    rng = random.Random(2)
    for n in (1, 2, 3, 7, 16):
        sym = [(rng.randrange(m), m) for m in (rng.choice([1, 2, 10, 26, 256]) for _ in range(n))]
        col = F.array(*[F.struct(F.lit(v).cast("long").alias("v"), F.lit(m).cast("long").alias("m")) for v, m in sym])
        got = spark.range(1).select(permute(col, KEY, "k").alias("p")).first()[0]
        assert [x["v"] for x in got] == network(sym, "k")


def test_network_is_a_bijection():
    for sizes in [(10, 10), (17, 43), (5,), (3, 4, 5)]:
        every = [()]
        for m in sizes:
            every = [(*e, v) for e in every for v in range(m)]
        assert len({tuple(network(list(zip(e, sizes)), "b")) for e in every}) == len(every)


def test_values_equal_the_python_version(spark):
    rng = random.Random(4)
    c = [make_card(rng) for _ in range(6)]
    spaced = " ".join(c[2][i:i + 4] for i in range(0, 16, 4))
    dates = [datetime.date(1999, 12, 31), datetime.date(2024, 2, 29), datetime.date(1900, 1, 1), datetime.date(2099, 12, 31)]
    body = "370400440532013000"
    plain = f"DE{98 - mod97(body + 'DE00'):02d}{body}"
    values = [(x, card(x)) for x in (*c, spaced)]
    values += [(d.isoformat(), date(d).isoformat()) for d in dates]
    values += [(f"{d:%d.%m.%Y}", f"{date(d):%d.%m.%Y}") for d in dates if d.day > 12 or d.month < 13]
    values += [(plain, iban(plain)), (" ".join(plain[i:i + 4] for i in range(0, 22, 4)),) * 1 + (
        iban(" ".join(plain[i:i + 4] for i in range(0, 22, 4))),)]
    values += [("+1 (017) 555-7713", "+1" + refill(" (017) 555-7713", chars("0175557713", "phone"))),
               ("the.72@mail3.example.com", chars("the.72@mail3.example", "email") + ".com"),
               ("10.0.255.1", ".".join(map(str, network([(10, 256), (0, 256), (255, 256), (1, 256)], "ip"))))]
    got = rewrite(spark, [f"on {a}, then" for a, _ in values])
    assert got == [(f"on {b}, then", 1) for _, b in values]
    assert all(a != b for a, b in values)
    joined = rewrite(spark, [" ".join(a for a, _ in values)])
    assert joined == [(" ".join(b for _, b in values), len(values))]


def test_results_validate_again(spark):
    rng = random.Random(8)
    cards = [make_card(rng, n) for n in (13, 15, 16, 19) for _ in range(20)]
    out = [t for t, _ in rewrite(spark, cards)]
    assert all(luhn(x) for x in out) and len(set(out)) == len(set(cards)) and [len(x) for x in out] == [len(x) for x in cards]
    month_first = [f"{m:02d}/{d:02d}/{y}" for m, d, y in [(12, 25, 1999), (2, 29, 2000), (1, 31, 1950), (2, 28, 2001)]]
    for t, n in rewrite(spark, month_first):
        assert n == 1 and datetime.datetime.strptime(t, "%m/%d/%Y").day > 12
    for t, n in rewrite(spark, ["123-45-6789", "667-01-0001", "899-99-9999", "001-01-0001"]):
        a, g, s = map(int, t.split("-"))
        assert n == 1 and 0 < a < 900 and a != 666 and g and s


def test_unvalidated_text_stays(spark):
    texts = ["4111111111111112", "999.1.1.1", "2023-02-30", "31.02.2020", "000-12-3456", "DE00370400440532013000", "1.2.3.4.5",
             "x4111111111111111", "token = \"ab8ca1b325bc4f85\"", "version 2.0 and 4.0.", "", "plain words", "12/2020", "a@b"]
    assert rewrite(spark, texts) == [(t, 0) for t in texts]


def test_edges(spark):
    long = "word " * 100_000 + "the.72@mail3.example.com" + " word" * 1000
    got = rewrite(spark, [None, "", "a.b@c.de", "a.b@c.de a.b@c.de", long])
    assert got[:2] == [(None, 0), ("", 0)]
    assert got[3] == (f"{got[2][0]} {got[2][0]}", 2)
    assert got[4][1] == 1 and len(got[4][0]) == len(long)
    df = spark.createDataFrame([(1, "a.b@c.de", "x", "y", 1)], SCHEMA)
    assert pseudonymize(df).columns == df.columns and pseudonymize(df.limit(0)).count() == 0
    assert pseudonymize(df).drop("text").collect() == df.drop("text").collect()


def test_values_inside_and_after_forms_that_fail(spark):
    c = "4111 1111 1111 1111"
    i = "ES91 2100 0418 4502 0005 1332"
    groups = ["+44 7911 123456", "+33 6 12 34 56 78"]
    local = "555 123 4567"
    d = date(datetime.date(2024, 3, 5)).isoformat()
    cases = [(f"in 2021 {c} paid", f"in 2021 {card(c)} paid"), (f"{i} EUR", f"{iban(i)} EUR"),
             (f"REF AB12 {i} PAID EUR", f"REF AB12 {iban(i)} PAID EUR"), (f"{c} 2021", f"{card(c)} 2021"),
             ("2024-03-05T10:00:00Z", f"{d}T10:00:00Z"),
             (local, refill(local, chars("5551234567", "phone")))]
    for g in groups:
        country, rest = g.split(" ", 1)
        cases.append((f"call {g}.", f"call {country} " + refill(rest, chars(re.sub("[^0-9]", "", rest), "phone")) + "."))
    assert rewrite(spark, [a for a, _ in cases]) == [(b, 1) for _, b in cases]
    many = " ; ".join(f"2021 {c}" for _ in range(1500))
    assert rewrite(spark, [many]) == [(" ; ".join(f"2021 {card(c)}" for _ in range(1500)), 1500)]


def test_a_telephone_number_is_one_value_in_all_layouts(spark):
    layouts = ["+15551234567", "+1 555 123 4567", "+1-555-123-4567", "+1 (555) 123-4567", "(555) 123-4567", "555-123-4567",
               "555.123.4567", "555 123 4567"]
    want = chars("5551234567", "phone")
    for a, (b, n) in zip(layouts, rewrite(spark, layouts)):
        assert n == 1 and re.sub("[0-9]", "#", b) == re.sub("[0-9]", "#", a)
        assert re.sub("[^0-9]", "", b) == ("1" if a[0] == "+" else "") + want
    (a, _), (b, _) = rewrite(spark, ["+447911123456", "+44 7911 123456"])
    assert a == b.replace(" ", "") and a.startswith("+44") and a != "+447911123456"
    (a, _), (b, _) = rewrite(spark, ["+420601123456", "+420 601 123 456"])
    assert a == b.replace(" ", "") and a.startswith("+420")


def test_key_of_the_session(spark):
    df = spark.createDataFrame([(1, "a.b@c.de", "x", "y", 1)], SCHEMA)
    spark.conf.set(KEY_SETTING, "another")
    try:
        assert pseudonymize(df).collect() == pseudonymize(df, key="another").collect() != pseudonymize(df, key=KEY).collect()
    finally:
        spark.conf.unset(KEY_SETTING)


def test_clashing_names(spark):
    df = spark.createDataFrame([(1, "a.b@c.de", "x", "y")], "doc_id bigint, text string, _new string, `a.b` string")
    row = pseudonymize(df).first()
    assert row["_new"] == "x" and row["a.b"] == "y" and row["text"] != "a.b@c.de"
