"""Format-preserving Feistel pseudonyms for personal data, in DataFrame functions only.

Values are found by one pattern, tried at every position, and validated; the leftmost valid ones are kept: payment cards by their Luhn digit, IBANs by mod 97, IPv4 octets, calendar
dates from 1900 to 2099, social security numbers by their assigned ranges, telephone numbers and e-mail addresses by
form. A value's variable parts become symbols with a modulus each (a digit 10, a letter 26, an octet 256, a date one
index of 73,049 = 17 x 4297 days), and a keyed Feistel network permutes them: in turn each half is shifted, symbol by
symbol modulo its size, by digests of the key, the round and the other half. That is a bijection on each format, so
equal values get equal pseudonyms in all documents, unlike values unlike ones, and check digits are set anew so that the
result validates as the original did. Separators do not count as part of a value. What fails validation stays as it is.
A telephone number keeps its country code, which its digits tell with and without a separator after it; the national
digits are permuted, so that one number has one pseudonym in all layouts, with and without the code.

Whoever has the key can undo the permutation. It comes from the caller or from the session's ``KEY_SETTING``; without
either, the key in this file is used with a warning, which is fit for tests only.

Not found: cards of 17 to 19 digits written in groups, IBANs in lower case, IPv6 addresses.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from longform.llm.common import free_name

KEY = "longform-pii-key"
KEY_SETTING = "spark.longform.pii.key"
ROUNDS = 10

# Forms of values: fixed patterns. Every quantifier is bounded.
_LEFT, _RIGHT = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"
EMAIL = (r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}][\p{L}\p{N}._%+-]{0,63}@[\p{L}\p{N}-]{1,63}(?:\.[\p{L}\p{N}-]{1,63}){0,4}"
         r"\.[A-Za-z]{2,24}" + _RIGHT)
IBAN = r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?"
IP = r"(?<!\d\.)\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\.\d)"
YMD = r"\d{4}-\d{1,2}-\d{1,2}|\d{4}/\d{1,2}/\d{1,2}|\d{4}\.\d{1,2}\.\d{1,2}"
DMY = r"\d{1,2}-\d{1,2}-\d{4}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}\.\d{1,2}\.\d{4}"
SSN = r"\d{3}-\d{2}-\d{4}"
PHONE = (r"\+\d{1,3}[ .-]?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]\d{3,4}|\+\d{1,3}(?:-\d{2,4}){2,4}|\+\d{1,3}(?: \d{2,4}){2,4}"
         r"|\+\d{8,15}|\d{3} \d{3} \d{4}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}-\d{3}-\d{4}|\d{3}\.\d{3}\.\d{4}")
# Groups of 1 to 6 digits by one separator; 7 to 15 digits in all, which is tested after the match.
GROUPS = "|".join(rf"\+\d{{1,3}}(?:{sep}\d{{1,6}}){{2,6}}" for sep in (" ", "-", r"\."))
CARD = r"\d{4}(?:[ -]\d{4}){3}|\d{4}[ -]\d{6}[ -]\d{5}|\d{13,19}"
# Country codes of international telephone numbers: those of one and two digits, all others have three. Fixed values.
COUNTRY = r"^(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"
_TIME = r"(?=[Tt]\d{2}:?\d{2})"
PATTERN = (EMAIL + "|" + _LEFT + "(?:(?:" + YMD + ")" + _TIME + "|(?:" + "|".join((IBAN, IP, YMD, DMY, SSN, GROUPS, PHONE, CARD))
           + ")" + _RIGHT + ")")
# A match at every position, also inside other matches.
AHEAD = "(?=(" + PATTERN + "))"
BLOCK = 512
DAY_PARTS = (17, 4297)
FIRST_DAY = "1900-01-01"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _symbol(value: Column, size: Column | int) -> Column:
    size = F.lit(size) if isinstance(size, int) else size
    return F.struct(value.cast("long").alias("v"), size.cast("long").alias("m"))


def permute(symbols: Column, key: str, kind: str) -> Column:
    """Feistel network over ``array<struct<v, m>>``: a bijection for any sizes ``m`` and any length."""
    half = F.floor(F.size(symbols) / 2).cast("int")

    def turn(state: Column, r: Column) -> Column:
        first = r % 2 == 0
        still = F.filter(F.transform(state, lambda x, i: F.when((i < half) != first, x["v"])), lambda v: v.isNotNull())
        seed = F.concat_ws(":", F.lit(key), F.lit(kind), r.cast("string"), F.size(state).cast("string"),
                           F.array_join(still.cast("array<string>"), ","))
        return _let(seed, lambda s: F.transform(state, lambda x, i: F.when((i < half) == first, F.struct(
            ((x["v"] + F.conv(F.substring(F.md5(F.concat(s, F.lit("#"), i.cast("string"))), 1, 12), 16, 10).cast("long"))
             % x["m"]).alias("v"), x["m"].alias("m"))).otherwise(x)))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), symbols, turn)


def _chars(value: Column) -> Column:
    return F.filter(F.split(value, ""), lambda c: c != "")


def _permute_chars(value: Column, key: str, kind: str) -> Column:
    """Letters (A-Z, a-z) and digits of ``value`` permuted in their classes; letters alike in either case."""
    def sym(c: Column) -> Column:
        code = F.ascii(c)
        return (F.when(c.rlike("[0-9]"), _symbol(code - 48, 10)).when(c.rlike("[a-z]"), _symbol(code - 97, 26))
                .when(c.rlike("[A-Z]"), _symbol(code - 65, 26)).otherwise(_symbol(F.lit(0), 1)))
    return _let(_chars(value), lambda cs: F.array_join(F.zip_with(
        cs, permute(F.transform(cs, sym), key, kind),
        lambda c, s: F.when(c.rlike("[0-9]"), s["v"].cast("string")).when(c.rlike("[a-z]"), F.char(s["v"] + 97))
        .when(c.rlike("[A-Z]"), F.char(s["v"] + 65)).otherwise(c)), ""))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _refill(value: Column, core: Column, keep: str = "[^0-9]") -> Column:
    """``value`` with the characters that do not match ``keep`` replaced by those of ``core`` in order."""
    return _let(core, lambda new: F.array_join(F.transform(_chars(value), lambda c, i: F.when(c.rlike(keep), c).otherwise(
        F.substr(new, F.length(F.regexp_replace(F.substr(value, F.lit(1), i + 1), keep, "")), F.lit(1)))), ""))


def _luhn_sum(digits: Column) -> Column:
    """Luhn sum; the last digit is not doubled."""
    cs = F.reverse(_chars(digits))
    return F.aggregate(F.transform(cs, lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(
        (c.cast("int") * 2) % 10 + F.floor(c.cast("int") / 5).cast("int"))), F.lit(0), lambda a, x: a + x)


def luhn_valid(digits: Column) -> Column:
    return _luhn_sum(digits) % 10 == 0


def _card(value: Column, key: str) -> Column:
    def build(d: Column) -> Column:
        body = _permute_chars(F.substr(d, F.lit(1), F.length(d) - 1), key, "card")
        return _let(body, lambda b: F.concat(b, ((10 - _luhn_sum(F.concat(b, F.lit("0"))) % 10) % 10).cast("string")))
    return _refill(value, _let(_digits(value), build))


def _mod97(text: Column) -> Column:
    """Remainder of digits and letters (A = 10 ... Z = 35) read as one number."""
    return F.aggregate(_chars(text), F.lit(0), lambda a, c: F.when(
        c.rlike("[0-9]"), (a * 10 + F.ascii(c) - 48) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97))


def _plain_iban(value: Column) -> Column:
    return F.replace(value, F.lit(" "), F.lit(""))


def iban_valid(value: Column) -> Column:
    p = _plain_iban(value)
    return F.length(p).between(15, 34) & (_mod97(F.concat(F.substr(p, F.lit(5)), F.substr(p, F.lit(1), F.lit(4)))) == 1)


def _iban(value: Column, key: str) -> Column:
    def build(p: Column) -> Column:
        return _let(_permute_chars(F.substr(p, F.lit(5)), key, "iban"), lambda b: F.concat(
            F.substr(p, F.lit(1), F.lit(2)),
            F.lpad((98 - _mod97(F.concat(b, F.substr(p, F.lit(1), F.lit(2)), F.lit("00")))).cast("string"), 2, "0"), b))
    return _refill(value, _let(_plain_iban(value), build), "[ ]")


def _octets(value: Column) -> Column:
    return F.split(value, r"\.").cast("array<int>")


def ip_valid(value: Column) -> Column:
    return F.forall(_octets(value), lambda o: o <= 255)


def _ip(value: Column, key: str) -> Column:
    return F.array_join(F.transform(permute(F.transform(_octets(value), lambda o: _symbol(o, 256)), key, "ip"),
                                    lambda s: s["v"].cast("string")), ".")


def _part(value: Column, i: int) -> Column:
    return F.element_at(F.split(value, r"[-/.]"), i)


def _date(year: Column, month: Column, day: Column) -> Column:
    """The date if it exists and lies in 1900-2099."""
    d = F.try_to_date(F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0")), "yyyy-MM-dd")
    return F.when(F.year(d).between(1900, 2099), d)


def _shift_date(date: Column, key: str) -> Column:
    index = F.datediff(date, F.to_date(F.lit(FIRST_DAY)))
    moved = permute(F.array(_symbol(F.floor(index / DAY_PARTS[1]), DAY_PARTS[0]),
                            _symbol(index % DAY_PARTS[1], DAY_PARTS[1])), key, "date")
    return _let(moved, lambda s: F.date_add(F.to_date(F.lit(FIRST_DAY)),
                                            (F.element_at(s, 1)["v"] * DAY_PARTS[1] + F.element_at(s, 2)["v"]).cast("int")))


def _padded(number: Column, like: Column) -> Column:
    return F.when(F.length(like) == 2, F.lpad(number.cast("string"), 2, "0")).otherwise(number.cast("string"))


def _ymd(value: Column, date: Column, key: str) -> Column:
    sep = F.substr(value, F.lit(5), F.lit(1))
    return _let(_shift_date(date, key), lambda d: F.concat(
        F.year(d).cast("string"), sep, _padded(F.month(d), _part(value, 2)), sep, _padded(F.dayofmonth(d), _part(value, 3))))


def _dmy(value: Column, date: Column, key: str) -> Column:
    sep = F.regexp_extract(value, "[-/.]", 0)
    return _let(_shift_date(date, key), lambda d: F.concat(
        _padded(F.dayofmonth(d), _part(value, 1)), sep, _padded(F.month(d), _part(value, 2)), sep, F.year(d).cast("string")))


def _mdy(value: Column, date: Column, key: str) -> Column:
    """Month first, which only a day above 12 shows; the result keeps such a day, so both readings stay apart."""
    sep = F.regexp_extract(value, "[-/.]", 0)
    leap = (F.month(date) == 2) & (F.dayofmonth(date) == 29)
    free = F.dayofmonth(date) <= 28
    year = F.year(date)
    moved = (F.when(leap, permute(F.array(_symbol((year - 1904) / 4, 49)), key, "leap"))
             .when(free, permute(F.array(_symbol(F.month(date) - 1, 12), _symbol(F.dayofmonth(date) - 13, 16),
                                         _symbol(year - 1900, 200)), key, "mdy"))
             .otherwise(permute(F.array(_symbol(year - 1900, 200)), key, "year")))
    return _let(moved, lambda s: F.concat(
        _padded(F.when(free, F.element_at(s, 1)["v"] + 1).otherwise(F.month(date)), _part(value, 1)), sep,
        F.when(free, F.try_element_at(s, F.lit(2))["v"] + 13).otherwise(F.dayofmonth(date)).cast("string"), sep,
        F.when(leap, F.element_at(s, 1)["v"] * 4 + 1904).otherwise(F.element_at(s, -1)["v"] + 1900).cast("string")))


def ssn_valid(value: Column) -> Column:
    a, g, s = (_part(value, i).cast("int") for i in (1, 2, 3))
    return a.between(1, 899) & (a != 666) & (g > 0) & (s > 0)


def _ssn(value: Column, key: str) -> Column:
    a, g, s = (_part(value, i).cast("int") for i in (1, 2, 3))
    area = a - F.when(a > 666, 2).otherwise(1)
    moved = permute(F.array(_symbol(area, 898), _symbol(g - 1, 99), _symbol(s - 1, 9999)), key, "ssn")
    return _let(moved, lambda m: F.concat_ws(
        "-", F.lpad((F.element_at(m, 1)["v"] + F.when(F.element_at(m, 1)["v"] >= 665, 2).otherwise(1)).cast("string"), 3, "0"),
        F.lpad((F.element_at(m, 2)["v"] + 1).cast("string"), 2, "0"),
        F.lpad((F.element_at(m, 3)["v"] + 1).cast("string"), 4, "0")))


def _phone(value: Column, key: str) -> Column:
    def build(d: Column) -> Column:
        code = F.when(F.startswith(value, F.lit("+")), F.length(F.regexp_extract(d, COUNTRY, 0))).otherwise(0)
        return _let(code, lambda n: F.concat(F.substr(d, F.lit(1), n), _permute_chars(F.substr(d, n + 1), key, "phone")))
    return _refill(value, _let(_digits(value), build))


def _email(value: Column, key: str) -> Column:
    tail = F.concat(F.lit("."), F.substring_index(value, ".", -1))
    return F.concat(_permute_chars(F.substr(value, F.lit(1), F.length(value) - F.length(tail)), key, "email"), tail)


def _is(value: Column, pattern: str) -> Column:
    return value.rlike(f"^(?:{pattern})$")


def kind_of(value: Column) -> Column:
    """Kind of a found value, null if it fails validation."""
    y, m, d = (_part(value, i) for i in (1, 2, 3))
    return (F.when(F.contains(value, F.lit("@")), F.lit("email"))
            .when(_is(value, IBAN), F.when(iban_valid(value), F.lit("iban")))
            .when(_is(value, r"\d{1,3}(?:\.\d{1,3}){3}"), F.when(ip_valid(value), F.lit("ip")))
            .when(_is(value, YMD), F.when(_date(y, m, d).isNotNull(), F.lit("date")))
            .when(_is(value, DMY), F.when(_date(d, m, y).isNotNull(), F.lit("day_first"))
                  .when(_date(d, y, m).isNotNull(), F.lit("month_first")))
            .when(_is(value, SSN), F.when(ssn_valid(value), F.lit("ssn")))
            .when(_is(value, PHONE), F.lit("phone"))
            .when(_is(value, GROUPS), F.when(F.length(_digits(value)).between(7, 15), F.lit("phone")))
            .when(luhn_valid(_digits(value)), F.lit("card")))


def pseudonym(value: Column, kind: Column, key: str = KEY) -> Column:
    y, m, d = (_part(value, i) for i in (1, 2, 3))
    return (F.when(kind == "email", _email(value, key)).when(kind == "iban", _iban(value, key))
            .when(kind == "ip", _ip(value, key)).when(kind == "date", _ymd(value, _date(y, m, d), key))
            .when(kind == "day_first", _dmy(value, _date(d, m, y), key))
            .when(kind == "month_first", _mdy(value, _date(d, y, m), key)).when(kind == "ssn", _ssn(value, key))
            .when(kind == "phone", _phone(value, key)).when(kind == "card", _card(value, key)).otherwise(value))


def _valid(value: Column) -> Column:
    """``struct<v, k>``: the value and its kind; of an IBAN or telephone form that fails, the longest valid part from its
    start that ends at a separator. ``k`` is null if nothing is valid."""
    def shorter(v: Column) -> Column:
        ends = F.filter(F.sequence(F.length(v) - 1, F.lit(1), F.lit(-1)),
                        lambda n: F.substr(v, n + 1, F.lit(1)).rlike("[ .-]") & ~F.substr(v, n, F.lit(1)).rlike("[ .-]"))
        parts = F.transform(ends, lambda n: _let(F.substr(v, F.lit(1), n), lambda p: F.struct(
            p.alias("v"), F.when(_is(p, IBAN + "|" + GROUPS + "|" + PHONE), kind_of(p)).alias("k"))))
        return F.coalesce(F.try_element_at(F.filter(parts, lambda x: x["k"].isNotNull()), F.lit(1)),
                          F.struct(v.alias("v"), F.lit(None).cast("string").alias("k")))
    return _let(value, lambda v: _let(kind_of(v), lambda k: F.when(
        k.isNull() & v.rlike(r"^(?:[A-Z]{2}\d|\+)") & (F.length(v) > 2), shorter(v)).otherwise(
        F.struct(v.alias("v"), k.alias("k")))))


def _rewrite(text: Column, key: str) -> Column:
    """``struct<text, found>``: the text with its values replaced, and the number of values replaced.

    The text is cut at every position where a form begins; a form that is valid and does not begin inside the valid one
    kept before it is replaced. The state of the fold is the number of characters that the kept value still covers.
    """
    starts = F.transform(F.regexp_extract_all(text, F.lit(AHEAD), F.lit(1)), lambda c: _let(_valid(c), lambda x: F.struct(
        F.length(x["v"]).alias("n"), pseudonym(x["v"], x["k"], key).alias("v"), x["k"].alias("k"))))
    # A line feed before the text makes the first piece the one before all forms.
    pieces = F.split(F.concat(F.lit("\n"), text), AHEAD, -1)

    def state(covered: Column, found: Column, out: Column) -> Column:
        return F.struct(covered.cast("int").alias("covered"), found.cast("long").alias("found"), out.alias("out"))

    def step(s: Column, x: Column) -> Column:
        size = F.length(x["piece"])
        keep = (s["covered"] == 0) & x["k"].isNotNull()
        over = F.when(keep, x["n"]).otherwise(s["covered"])
        left = F.substr(x["piece"], over + 1)
        return state(F.greatest(over - size, F.lit(0)), s["found"] + keep.cast("long"), F.concat(
            s["out"], F.array(F.when(keep, F.concat(x["v"], left)).otherwise(left))))

    nothing = F.array().cast("array<string>")

    def fold(all_: Column) -> Column:
        def block(s: Column, at: Column) -> Column:
            return _let(F.aggregate(F.slice(all_, at, BLOCK), state(s["covered"], s["found"], nothing), step),
                        lambda d: state(d["covered"], d["found"], F.concat(s["out"], F.array(F.array_join(d["out"], "")))))
        return F.aggregate(F.sequence(F.lit(1), F.size(all_), F.lit(BLOCK)), state(F.lit(0), F.lit(0), nothing), block)

    done = _let(pieces, lambda ps: _let(F.zip_with(F.slice(ps, F.lit(2), F.size(ps) - 1), starts, lambda p, x: F.struct(
        p.alias("piece"), x["n"].alias("n"), x["v"].alias("v"), x["k"].alias("k"))), lambda xs: _let(fold(xs), lambda s: F.struct(
            F.concat(F.substr(F.element_at(ps, 1), F.lit(2)), F.array_join(s["out"], "")).alias("text"), s["found"].alias("found")))))
    return F.when(text.rlike(PATTERN), done).otherwise(F.struct(text.alias("text"), F.lit(0).cast("long").alias("found")))


def session_key(spark: SparkSession) -> str:
    """The session's key; without one that of this file, with a warning."""
    key = spark.conf.get(KEY_SETTING, None)
    if key is None:
        warnings.warn(f"{KEY_SETTING} is not set: pseudonyms made with the key of the source can be undone by anyone")
    return key or KEY


def pseudonymize(docs: DataFrame, text_col: str = "text", key: str | None = None, found_col: str | None = None) -> DataFrame:
    """``docs`` with the values in ``text_col`` replaced; all other columns pass through, whatever their names.

    Null texts stay null, empty ones empty, repeated rows stay alike, an empty table stays empty. ``found_col`` adds the
    number of replaced values (null text: 0). Without ``key`` the session's is used.
    """
    new = free_name("_new", docs)
    done = docs.withColumn(new, _rewrite(F.col(f"`{text_col}`"), key or session_key(docs.sparkSession)))
    cols = [F.col(new)["text"].alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns]
    if found_col:
        cols.append(F.coalesce(F.col(new)["found"], F.lit(0)).alias(found_col))
    return done.select(*cols)
