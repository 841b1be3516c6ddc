"""Format-preserving pseudonyms for personal data, in DataFrame functions only.

Validated numbers and dates are permuted within their own format by a keyed Feistel network, so that equal values stay equal
across documents and the pseudonym is again a valid value of the same format:

* card numbers: 13-19 digits, spaces or hyphens between them allowed, with a right check digit: all other digits are
  permuted and the check digit is computed anew;
* phone numbers: +C (AAA) EEE-NNNN and the like: the ten digits after the country code;
* IPv4 addresses with parts up to 255: the 32 bits;
* dates YYYY-MM-DD, DD.MM.YYYY, DD/MM/YYYY, or MM/DD/YYYY where that alone is a date, of the years 1900 to 2099: year and day of
  the year. Days and months of one digit, of two, or with a leading zero stay so; 29 February stays one, in another leap year;
* social security numbers AAA-GG-SSSS in the assigned ranges: the 887 million of them.

Of e-mail addresses the local part is replaced by a keyed digest, which cannot be undone; the others can (``restore``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 10
_MARK = "\x01"
#: Card numbers in one piece, or in the groups that cards have.
_GROUPS = r"(?:\d{13,19}|\d{4} \d{4} \d{4} \d{4}|\d{4}-\d{4}-\d{4}-\d{4}|\d{4} \d{6} \d{5}|\d{4}-\d{6}-\d{5})"
#: Fixed formats.
FORMATS = {
    # starts where a run of its characters starts, and never gives one back: a run without @ is read once
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,126}\.[A-Za-z]{2,63}",
    "card": r"(?<![\d.-])\d(?:[ -]?\d){12,18}(?![\d-])",
    "phone": r"(?<!\d)(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\d)",
    "date": r"(?<![\d.])(?:\d{4}-\d{2}-\d{2}|\d{1,2}\.\d{1,2}\.\d{4}|\d{1,2}/\d{1,2}/\d{4})(?![\d])",
    "ip": r"(?<![\d.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\d|\.\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
}
#: A number in a card's groups, but for one before one to three digits of its own: these may belong to it, so ``_pieces`` decides.
_CARD = rf"(?<![\d.-]){_GROUPS}(?![\d-])"
_CARD_ALONE = rf"{_CARD}(?![ -]\d{{1,3}}(?![ ./-]?\d))"
#: What is tried, in this order, and what is tried within a match of digits in other groups.
ANY = "|".join(f"(?:{p})" for p in (FORMATS["email"], FORMATS["date"], FORMATS["phone"], FORMATS["ssn"], FORMATS["ip"], _CARD_ALONE, FORMATS["card"]))
_WITHIN = "|".join(f"(?:{p})" for p in (FORMATS["date"], FORMATS["phone"], FORMATS["ssn"], FORMATS["ip"], _CARD))
_YEARS = (1900, 2099)


def _days_of_year() -> Column:
    """Month * 100 + day of all days of a year but 29 February."""
    days = (m * 100 + d for m in range(1, 13) for d in range(1, (28 if m == 2 else 30 if m in (4, 6, 9, 11) else 31) + 1))
    return F.split(F.lit(",".join(map(str, days))), ",").cast("array<int>")


def _feistel(left: Column, right: Column, a: Column, b: Column, key: str, kind: str, inverse: bool) -> Column:
    """(left, right) permuted within [0, a) x [0, b): each round adds a keyed digest of one half to the other."""

    def digest(r: Column, half: Column, most: Column) -> Column:
        text = F.concat_ws("|", F.lit(key), F.lit(kind), a.cast("string"), b.cast("string"), r.cast("string"), half.cast("string"))
        return F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 15), 16, 10).cast("long") % most

    def step(s: Column, r: Column) -> Column:
        sign = -1 if inverse else 1
        even = F.struct(F.pmod(s["l"] + sign * digest(r, s["r"], a), a).alias("l"), s["r"].alias("r"))
        odd = F.struct(s["l"].alias("l"), F.pmod(s["r"] + sign * digest(r, s["l"], b), b).alias("r"))
        return F.when(r % 2 == 0, even).otherwise(odd)

    rounds = F.array(*(F.lit(r) for r in (reversed(range(ROUNDS)) if inverse else range(ROUNDS))))
    return F.aggregate(rounds, F.struct(left.cast("long").alias("l"), right.cast("long").alias("r")), step)


def _ten_to(n: Column) -> Column:
    return F.pow(F.lit(10), n).cast("long")


def _digits(value: Column, key: str, kind: str, inverse: bool) -> Column:
    """A string of 2 to 18 digits permuted within its length."""
    n = F.length(value)
    u = F.floor(n / 2).cast("int")
    halves = _feistel(F.substr(value, F.lit(1), u).cast("long"), F.substr(value, u + 1).cast("long"), _ten_to(u), _ten_to(n - u), key, kind, inverse)
    return F.transform(F.array(halves), lambda s: F.concat(F.lpad(s["l"].cast("string"), u, "0"), F.lpad(s["r"].cast("string"), n - u, "0")))[0]


def _poured(shape: Column, digits: Column) -> Column:
    """``shape`` with its digits replaced, in order, by ``digits``."""
    parts = F.split(shape, "")
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))
    step = lambda s, c: F.when(c.rlike("[0-9]"), F.struct(F.concat(s["out"], F.substr(digits, s["at"], F.lit(1))).alias("out"), (s["at"] + 1).alias("at"))).otherwise(F.struct(F.concat(s["out"], c).alias("out"), s["at"].alias("at")))
    return F.aggregate(parts, start, step, lambda s: s["out"])


def _check_digit(payload: Column) -> Column:
    """The digit that makes payload + digit pass the mod-10 card check."""

    def part(c: Column, i: Column) -> Column:
        d = c.cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return F.when(i % 2 == 0, twice).otherwise(d)

    total = F.aggregate(F.transform(F.split(F.reverse(payload), ""), part), F.lit(0), lambda a, x: a + x)
    return ((10 - total % 10) % 10).cast("string")


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with ``value`` computed once however often it is used."""
    return F.transform(F.array(value), use)[0]


def _day(year: Column, month: Column, day: Column) -> Column:
    """Month * 100 + day, or null if that is no day of the year."""
    n = month * 100 + day
    leap = (year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0))
    longest = F.when(month == 2, F.when(leap, 29).otherwise(28)).when(month.isin(4, 6, 9, 11), 30).otherwise(31)
    return F.when(month.between(1, 12) & (day >= 1) & (day <= longest), n)


def _date(value: Column, key: str, inverse: bool) -> Column:
    """A date of the same form. Its day is one of those that are written with the same digits' places, and in MM/DD one that
    isn't also a date in DD/MM: so each form is permuted within itself."""
    iso = value.contains("-")
    first, last = _YEARS

    def read(t: Column) -> Column:
        """(y, d, m, by_day, by_month): year, the texts of day and month if the day is first, and the day of the year by either reading."""
        y, d, m = F.when(iso, t[0]).otherwise(t[2]).cast("int"), F.when(iso, t[2]).otherwise(t[0]), t[1]
        by_month = F.when(value.contains("/"), _day(y, d.cast("int"), m.cast("int")))
        return F.struct(y.alias("y"), d.alias("d"), m.alias("m"), _day(y, m.cast("int"), d.cast("int")).alias("by_day"), by_month.alias("by_month"))

    def chosen(s: Column) -> Column:
        """(y, d, m, n, swapped): the texts of day and month as read, and the day of the year."""
        swapped = s["by_day"].isNull()
        d, m = F.when(swapped, s["m"]).otherwise(s["d"]), F.when(swapped, s["d"]).otherwise(s["m"])
        return F.struct(s["y"].alias("y"), d.alias("d"), m.alias("m"), F.coalesce(s["by_day"], s["by_month"]).alias("n"), swapped.alias("swapped"))

    def like(n: Column, text: Column) -> Column:
        """Whether a number is written as ``text`` is: with one digit, a leading zero, or two digits."""
        return F.when(F.length(text) == 2, text.startswith("0") == (n < 10)).otherwise(n < 10)

    def put(s: Column, y: Column, n: Column) -> Column:
        sep = F.regexp_extract(value, "[-./]", 0)
        m, d = F.lpad(F.floor(n / 100).cast("string"), F.length(s["m"]), "0"), F.lpad((n % 100).cast("string"), F.length(s["d"]), "0")
        return F.when(iso, F.concat_ws("-", y, m, d)).otherwise(F.concat(F.when(s["swapped"], m).otherwise(d), sep, F.when(s["swapped"], d).otherwise(m), sep, y))

    def moved(s: Column, days: Column) -> Column:
        halves = _feistel(s["y"] - first, F.array_position(days, s["n"]) - 1, F.lit(last - first + 1), F.size(days), key, "date", inverse)
        return _let(halves, lambda h: put(s, (h["l"] + first).cast("string"), F.element_at(days, (h["r"] + 1).cast("int"))))

    def replaced(s: Column) -> Column:
        both = (F.length(s["d"]) == 2) & (F.length(s["m"]) == 2)
        days = F.filter(_days_of_year(), lambda t: (both | like(F.floor(t / 100), s["m"]) & like(t % 100, s["d"])) & (~s["swapped"] | (t % 100 > 12)))
        leap = _feistel(F.floor((s["y"] - 1904) / 28), F.floor((s["y"] - 1904) / 4) % 7, F.lit(7), F.lit(7), key, "leap", inverse)
        extra = _let(leap, lambda h: put(s, (h["l"] * 28 + h["r"] * 4 + 1904).cast("string"), F.lit(229)))
        return F.when(s["y"].between(first, last) & s["n"].isNotNull(), F.when(s["n"] == 229, extra).otherwise(_let(days, lambda x: moved(s, x))))

    return _let(_let(_let(F.split(value, "[-./]"), read), chosen), replaced)


def _one(value: Column, key: str, inverse: bool) -> Column:
    """What takes the place of one match; null if it isn't a valid value."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    n = F.length(digits)
    payload = F.substr(digits, F.lit(1), n - 1)
    card = F.when(F.substr(digits, n) == _check_digit(payload), F.transform(F.array(_digits(payload, key, "card", inverse)), lambda p: _poured(value, F.concat(p, _check_digit(p))))[0])
    phone = F.concat(F.substr(value, F.lit(1), F.length(value) - F.length(F.regexp_extract(value, r"\(?\d{3}\)?[ .-]?\d{3}[ .-]\d{4}$", 0))), _poured(F.regexp_extract(value, r"\(?\d{3}\)?[ .-]?\d{3}[ .-]\d{4}$", 0), _digits(F.right(digits, F.lit(10)), key, "phone", inverse)))
    octets = F.transform(F.split(value, r"\."), lambda x: x.cast("int"))
    moved = F.transform(F.array(_feistel(octets[0] * 256 + octets[1], octets[2] * 256 + octets[3], F.lit(65536), F.lit(65536), key, "ip", inverse)), lambda s: F.concat_ws(".", F.floor(s["l"] / 256), s["l"] % 256, F.floor(s["r"] / 256), s["r"] % 256))[0]
    ip = F.when(F.forall(octets, lambda x: x < 256), moved)

    dates = _date(value, key, inverse)
    area = F.substr(digits, F.lit(1), F.lit(3)).cast("int")
    group, serial = F.substr(digits, F.lit(4), F.lit(2)).cast("int"), F.substr(digits, F.lit(6), F.lit(4)).cast("int")
    index = F.when(area > 666, area - 2).otherwise(area - 1)
    moved = _feistel(index * 99 + group - 1, serial - 1, F.lit(898 * 99), F.lit(9999), key, "ssn", inverse)

    def written(s: Column) -> Column:
        i = F.floor(s["l"] / 99)
        return F.concat_ws("-", F.lpad(F.when(i > 664, i + 2).otherwise(i + 1).cast("string"), 3, "0"), F.lpad((s["l"] % 99 + 1).cast("string"), 2, "0"), F.lpad((s["r"] + 1).cast("string"), 4, "0"))

    ssn = F.when(area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0), F.transform(F.array(moved), written)[0])
    # signs before the first letter or digit are the text's, not the address's
    signs, address = F.regexp_extract(value, "^[._%+-]*", 0), F.regexp_replace(value, "^[._%+-]+(?!@)", "")
    hidden = F.concat(signs, F.lit("u"), F.substring(F.sha2(F.concat(F.lit(f"{key}|email|"), F.lower(address)).cast("binary"), 256), 1, 12), F.lit("@"), F.substring_index(value, "@", -1))
    email = value if inverse else F.when(F.substring(address, 1, 1).rlike("[A-Za-z0-9]"), hidden)
    kind = _kind(value)
    return F.when(kind == "email", email).when(kind == "card", card).when(kind == "phone", phone).when(kind == "date", dates).when(kind == "ip", ip).when(kind == "ssn", ssn)


def _kind(value: Column) -> Column:
    out = F.when(value.contains("@"), "email")
    for kind in ("phone", "date", "ssn", "ip", "card"):
        out = out.when(value.rlike(f"^(?:{FORMATS[kind]})$"), kind)
    return out


def _valid_card(value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    n = F.length(digits)
    return F.substr(digits, n) == _check_digit(F.substr(digits, F.lit(1), n - 1))


def _pieces(gap: Column, value: Column) -> Column:
    """The matches in one match, each with the text before it: itself, or what lies within digits that make no card or hold one."""
    inner, gaps = F.regexp_extract_all(value, F.lit(_WITHIN), F.lit(0)), F.split(value, _WITHIN, -1)
    holds = F.exists(inner, lambda v: v.rlike(f"^{_GROUPS}$") & (v != value) & _valid_card(v))
    parts = F.transform(inner, lambda v, i: F.struct(F.concat(F.when(i == 0, gap).otherwise(""), gaps[i]).alias("gap"), v.alias("was")))
    parts = F.concat(parts, F.array(F.struct(F.element_at(gaps, -1).alias("gap"), F.lit("").alias("was"))))
    split = (_kind(value) == "card") & (F.size(inner) > 0) & (holds | ~_valid_card(value))
    return F.when(split, parts).otherwise(F.array(F.struct(gap.alias("gap"), value.alias("was"))))


def _count(kind: str) -> Column:
    return F.size(F.filter("values", lambda v: (v["kind"] == kind) & v["now"].isNotNull())).cast("long").alias(f"n_{kind}")


def _rewritten(docs: DataFrame, key: str, inverse: bool, id_col: str, text_col: str) -> DataFrame:
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    # one scan puts a mark on either side of each match; a mark that the text has itself becomes a match without text
    parts = F.split(F.regexp_replace("text", F.lit(f"({ANY})|{_MARK}"), F.lit(f"{_MARK}$1{_MARK}")), _MARK, -1)
    rows = rows.withColumn("parts", F.when(F.size(parts) > 1, parts).otherwise(F.array().cast("array<string>")))
    pairs = F.when(F.size("parts") > 1, F.sequence(F.lit(1), F.size("parts") - 1, F.lit(2))).otherwise(F.array().cast("array<int>"))
    # one entry for each match: its kind, and its pseudonym if it is valid
    part = lambda i: F.element_at("parts", i.cast("int"))
    pieces = F.flatten(F.transform(pairs, lambda i: F.when(part(i + 1) == "", F.array(F.struct(part(i).alias("gap"), F.lit(_MARK).alias("was")))).otherwise(_pieces(part(i), part(i + 1)))))
    rows = rows.withColumn("values", F.transform(pieces, lambda v: F.struct(v["gap"].alias("gap"), v["was"].alias("was"), _kind(v["was"]).alias("kind"), _one(v["was"], key, inverse).alias("now"))))
    tail = F.transform("values", lambda v: F.concat(v["gap"], F.coalesce(v["now"], v["was"])))
    text = F.when(F.size("values") == 0, F.col("text")).otherwise(F.concat(F.array_join(tail, ""), F.element_at("parts", -1)))
    counts = [_count(kind) for kind in FORMATS]
    return rows.select("doc_id", text.alias("text"), *counts)


def pseudonymise(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, n_email, n_card, n_phone, n_date, n_ip, n_ssn): each whole text with its personal data replaced.

    Matches are the leftmost ones; a match that isn't a valid value (card check, calendar, parts of an address) stays as it is
    and isn't counted, but other values within digits that make no card are found. A date with slashes is read day first if
    that is a date. Very long texts without spaces are read once. A null text stays null with counts of 0, null ids stay. Repeated rows each give a row; other columns are ignored; an empty table gives an empty result.
    """
    return _rewritten(docs, key, False, id_col, text_col)


def restore(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The inverse of ``pseudonymise`` for numbers and dates; e-mail pseudonyms stay."""
    return _rewritten(docs, key, True, id_col, text_col)
