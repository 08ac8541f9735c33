"""PII: format-preserving Feistel pseudonyms.

One pattern finds candidates; each is validated (check digit, octets, numbering rules, calendar) and then permuted, under a key,
within its own format, so equal values get equal pseudonyms in all documents and different values of a format
different ones:

- card numbers: the first digit stays, the digits between it and the check digit are permuted, the check digit is computed anew;
- phone numbers of ten digits, told by +1, brackets or separators: the country code and the leading digits of area and exchange
  stay, the others are permuted; other numbers written with a plus: all after the first three digits. Digit groups one blank, dot or
  hyphen apart belong to such a number, up to 15 digits;
- IPv4 addresses: both halves of the 32 bits; US social numbers: within the valid numbers;
- dates, 1900 to 2099: year first, by year and day of year, with day 366 permuted among leap years; year last, day before month or
  month before a day above 12, by year and by day and month among those written with as many digits, 29 February among leap years;
- mail addresses: letters and digits of the local part, each within its class; the domain stays.

All are Feistel networks: the two halves change in turn by a keyed hash of the other half, so every step can be undone
(``reveal``) without a table. Separators and letter case stay as they are. Values that fail validation stay untouched.

Everything is DataFrame functions on one row at a time: no shuffle, whole texts.

Defined cases: null text stays null with counts 0; empty text stays empty. Repeated rows give equal rows. Extra columns
are ignored by ``pseudonymize`` and kept by ``with_pseudonyms``. Candidates do not overlap; the leftmost wins.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT_KEY = "public-demonstration-key"
ROUNDS = 8

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_TEN_DIGITS = (
    r"(?:\+?1[ .-]?)?\(\d{3}\)[ .-]{0,2}\d{3}[ .-]?\d{4}|\+1[ .-]?\d{3}[ .-]?\d{3}[ .-]?\d{4}|\d{3}(?:[.-]\d{3}[ .-]| \d{3}[.-])\d{4}"
)
_WITH_BLANKS = r"\d{3} \d{3} \d{4}"
# Blanks alone may as well separate numbers of a table: a word for telephones must stand in front.
_AFTER_A_WORD = r"(?<=\b(?i:call|tel|phone|telephone|mobile|cell|fax)\b[.:]? {1,2})"
_WITH_PLUS = r"\+[1-9](?:[ .-]?\(?\d\)?){6,14}(?!\d)"
_MONTH, _DAY = r"(?:0[1-9]|1[0-2])", r"(?:0[1-9]|[12]\d|3[01])"
_YEAR_FIRST = r"(?<![\d-])(?:19|20)\d{2}(?:" + "|".join(f"{mark}{_MONTH}{mark}{_DAY}" for mark in ("-", "/", r"\.")) + r")(?![\d-])"
_YEAR_LAST = (
    r"(?<![\d./-])(?:" + "|".join(rf"\d{{1,2}}{mark}\d{{1,2}}{mark}" for mark in ("-", "/", r"\.")) + r")(?:19|20)\d{2}(?![\d-])"
)
# Fixed forms of the values, in the order in which they are tried at a place.
FORMS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "phone": rf"(?<![\d+])(?:(?:{_TEN_DIGITS}|{_WITH_BLANKS})(?!\d)|{_WITH_PLUS})",
    "card": r"(?<!\d)(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{4}|\d{4} \d{6} \d{4,5}|\d{4}-\d{6}-\d{4,5})(?!\d)",
    "ip": rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\d|\.\d)",
    "ssn": r"(?<![\d-])(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}(?![\d-])",
    "date": rf"{_YEAR_FIRST}|{_YEAR_LAST}",
}
# The forms as they are searched for in a text.
ANY = "|".join(f"(?:{form})" for form in FORMS.values()).replace(_WITH_BLANKS, _AFTER_A_WORD + _WITH_BLANKS)

_DIGIT, _LOWER = "0123456789", "abcdefghijklmnopqrstuvwxyz"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is named."""
    return F.transform(F.array(value), use)[0]


def _hash(key: str, *parts: Column) -> Column:
    """A whole number below 2**60 from the key and the parts."""
    text = F.concat_ws("|", F.lit(key), *(p.cast("string") for p in parts))
    return F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("long")


def _shifted(char: Column, by: Column) -> Column:
    """A digit or lower-case letter moved ``by`` places round its class; any other character as it is."""
    moved = char
    for alphabet in (_DIGIT, _LOWER):
        place = F.call_function("instr", F.lit(alphabet), char)
        target = F.pmod(place - 1 + by, F.lit(len(alphabet)).cast("long")) + 1
        moved = F.when(place > 0, F.call_function("substring", F.lit(alphabet), target.cast("int"), F.lit(1))).otherwise(moved)
    return moved


def permute_text(text: Column, key: str, kind: str, back: bool = False) -> Column:
    """Feistel over a string of digits and lower-case letters; each character keeps its class and place."""
    return let(text, lambda whole: _permuted(whole, key, kind, back))


def _permuted(text: Column, key: str, kind: str, back: bool) -> Column:
    half = F.floor(F.length(text) / 2).cast("int")
    sign = -1 if back else 1

    def moved(part: Column, other: Column, round_: Column) -> Column:
        chars = F.filter(F.split(part, ""), lambda c: c != "")
        return F.array_join(
            F.transform(chars, lambda c, k: _shifted(c, F.lit(sign) * (_hash(key, F.lit(kind), round_, k, other) % 260))), ""
        )

    def step(pair: Column, round_: Column) -> Column:
        odd = round_ % 2 == 1
        return F.struct(
            F.when(odd, moved(pair["a"], pair["b"], round_)).otherwise(pair["a"]).alias("a"),
            F.when(odd, pair["b"]).otherwise(moved(pair["b"], pair["a"], round_)).alias("b"),
        )

    first = F.struct(F.substring(text, F.lit(1), half).alias("a"), F.call_function("substring", text, half + 1).alias("b"))
    return F.aggregate(_rounds(back), first, step, lambda pair: F.concat(pair["a"], pair["b"]))


def _rounds(back: bool) -> Column:
    numbers = range(1, ROUNDS + 1)
    return F.array(*map(F.lit, reversed(numbers) if back else numbers))


def permute_pair(x: Column, y: Column, m_x: int, m_y: int, key: str, kind: str, back: bool = False) -> Column:
    """Feistel over a pair of numbers below ``m_x`` and ``m_y``; a struct of x and y."""
    sign = -1 if back else 1

    def step(pair: Column, round_: Column) -> Column:
        odd = round_ % 2 == 1
        by = lambda other: F.lit(sign) * _hash(key, F.lit(kind), round_, other)
        return F.struct(
            F.when(odd, F.pmod(pair["x"] + by(pair["y"]), F.lit(m_x).cast("long"))).otherwise(pair["x"]).alias("x"),
            F.when(odd, pair["y"]).otherwise(F.pmod(pair["y"] + by(pair["x"]), F.lit(m_y).cast("long"))).alias("y"),
        )

    return F.aggregate(_rounds(back), F.struct(x.cast("long").alias("x"), y.cast("long").alias("y")), step)


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def refill(value: Column, digits: Column) -> Column:
    """``value`` with its digits replaced, in order, by ``digits``."""
    return F.array_join(
        F.transform(
            F.split(value, "(?<=.)(?=.)"),
            lambda c, k: F.when(
                c.between("0", "9"),
                F.call_function("substring", digits, F.length(digits_of(F.call_function("substring", value, F.lit(1), k + 1))), F.lit(1)),
            ).otherwise(c),
        ),
        "",
    )


def luhn_sum(digits: Column) -> Column:
    """Check sum of a digit string; a valid one leaves 0 by 10."""
    n = F.length(digits)
    doubled = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)

    def value(k: Column) -> Column:
        d = F.call_function("substring", digits, k, F.lit(1)).cast("int")
        return F.when((n - k) % 2 == 1, doubled(d)).otherwise(d)

    return F.aggregate(F.transform(F.sequence(F.lit(1), n), value), F.lit(0), lambda total, d: total + d)


def _card(value: Column, key: str, back: bool) -> Column:
    def new(digits: Column) -> Column:
        inner = permute_text(F.call_function("substring", digits, F.lit(2), F.length(digits) - 2), key, "card", back)
        checked = lambda body: F.concat(body, F.pmod(-luhn_sum(F.concat(body, F.lit("0"))), F.lit(10)).cast("string"))
        whole = let(F.concat(F.substring(digits, 1, 1), inner), checked)
        return F.when(luhn_sum(digits) % 10 == 0, let(whole, lambda d: refill(value, d)))

    return let(digits_of(value), new)


def _phone(value: Column, key: str, back: bool) -> Column:
    def new(digits: Column) -> Column:
        head = F.length(digits) - 10
        at = lambda start, width: F.call_function("substring", digits, head + start, F.lit(width))
        whole = lambda free: F.concat(
            F.call_function("substring", digits, F.lit(1), head), at(1, 1), F.substring(free, 1, 2), at(4, 1), F.substring(free, 3, 6)
        )
        ten = let(let(permute_text(F.concat(at(2, 2), at(5, 6)), key, "phone", back), whole), lambda d: refill(value, d))
        rest = permute_text(F.call_function("substring", digits, F.lit(4)), key, "phone abroad", back)
        abroad = let(F.concat(F.substring(digits, 1, 3), rest), lambda d: refill(value, d))
        return F.when(value.startswith("+") & ~((F.length(digits) == 11) & digits.startswith("1")), abroad).otherwise(ten)

    return let(digits_of(value), new)


def _ip(value: Column, key: str, back: bool) -> Column:
    octet = lambda k: F.split(value, r"\.")[k].cast("long")
    pair = permute_pair(octet(0) * 256 + octet(1), octet(2) * 256 + octet(3), 65536, 65536, key, "ip", back)
    text = lambda v: F.concat_ws(".", *(part.cast("string") for c in "xy" for part in (F.floor(v[c] / 256), v[c] % 256)))
    return let(pair, text)


def _ssn(value: Column, key: str, back: bool) -> Column:
    area, group, serial = (F.split(value, "-")[k].cast("long") for k in range(3))
    # Areas 1 to 665 and 667 to 899.
    place = area - 1 - (area > 666).cast("long")
    pair = permute_pair(place * 99 + group - 1, serial - 1, 898 * 99, 9999, key, "ssn", back)
    pad = lambda v, n: F.lpad(v.cast("string"), n, "0")

    def text(v: Column) -> Column:
        place = F.floor(v["x"] / 99)
        return F.concat_ws("-", pad(place + 1 + (place >= 665).cast("long"), 3), pad(v["x"] % 99 + 1, 2), pad(v["y"] + 1, 4))

    return let(pair, text)


def _leap_moved(year: Column, key: str, back: bool) -> Column:
    """A leap year for a leap year, of the 49 from 1904 to 2096."""
    sign = -1 if back else 1
    return F.pmod(F.floor((year - 1904) / 4) + sign * _hash(key, F.lit("leap")), F.lit(49).cast("long")) * 4 + 1904


def _year_first(value: Column, key: str, back: bool) -> Column:
    day = F.call_function("try_to_date", F.regexp_replace(value, "[/.]", "-"), F.lit("yyyy-MM-dd"))
    pair = permute_pair(F.year(day) - 1900, F.dayofyear(day) - 1, 200, 365, key, "date", back)
    usual = let(pair, lambda v: F.date_add(F.make_date((v["x"] + 1900).cast("int"), F.lit(1), F.lit(1)), v["y"].cast("int")))
    last = F.make_date(_leap_moved(F.year(day), key, back).cast("int"), F.lit(12), F.lit(31))
    new = F.date_format(F.when(F.dayofyear(day) == 366, last).otherwise(usual), "yyyy-MM-dd")
    return F.when(day.isNotNull(), F.replace(new, F.lit("-"), F.call_function("substring", value, F.lit(5), F.lit(1))))


def _days_as_written() -> dict[str, list[str]]:
    """Days and months, 29 February aside, by order and widths: day/month, and month/day where the day is above 12."""
    lengths = (31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)
    wide = lambda n: [f"{n:02d}", *([str(n)] if n < 10 else [])]
    found: dict[str, list[str]] = {}
    for month, length in enumerate(lengths, 1):
        for day in range(1, length + 1):
            for d in wide(day):
                for m in wide(month):
                    found.setdefault(f"dm{len(d)}{len(m)}", []).append(f"{d}/{m}")
                    if day > 12:
                        found.setdefault(f"md{len(m)}{len(d)}", []).append(f"{m}/{d}")
    return found


DAYS_AS_WRITTEN = _days_as_written()


def _year_last(value: Column, key: str, back: bool) -> Column:
    year = F.call_function("right", value, F.lit(4)).cast("int")
    mark = F.regexp_extract(value, "[/.-]", 0)
    head = F.array_join(F.slice(F.split(value, "[/.-]"), 1, 2), "/")

    def written(head: Column) -> Column:
        dated = lambda day, year: F.concat(F.replace(day, F.lit("/"), mark), mark, year.cast("string"))

        def moved(name: str, days: list[str]) -> Column:
            listed = F.array(*map(F.lit, days))
            at = F.array_position(listed, head)
            pair = permute_pair(year - 1900, at - 1, 200, len(days), key, f"date {name}", back)
            return F.when(at > 0, let(pair, lambda v: dated(F.get(listed, v["y"].cast("int")), v["x"] + 1900)))

        leap = head.isin("29/02", "29/2", "02/29", "2/29") & (year % 4 == 0) & (year != 1900)
        return F.coalesce(*(moved(*group) for group in DAYS_AS_WRITTEN.items()), F.when(leap, dated(head, _leap_moved(year, key, back))))

    return let(head, written)


def _date(value: Column, key: str, back: bool) -> Column:
    return F.when(value.rlike(r"\A\d{4}"), _year_first(value, key, back)).otherwise(_year_last(value, key, back))


def _email(value: Column, key: str, back: bool) -> Column:
    local = F.substring_index(value, "@", 1)
    new = permute_text(F.lower(local), key, "email", back)
    cased = lambda text: F.array_join(
        F.transform(
            F.split(text, "(?<=.)(?=.)"),
            lambda c, k: F.when(F.call_function("substring", local, k + 1, F.lit(1)).between("A", "Z"), F.upper(c)).otherwise(c),
        ),
        "",
    )
    return F.concat(let(new, cased), F.call_function("substring", value, F.length(local) + 1))


PERMUTE: dict[str, Callable[[Column, str, bool], Column]] = {
    "email": _email, "phone": _phone, "card": _card, "ip": _ip, "ssn": _ssn, "date": _date,
}


def _handled(value: Column, key: str, back: bool) -> Column:
    """kind and new value of a candidate; both null where it fails validation."""
    kind = F.coalesce(*(F.when(value.rlike(rf"\A(?:{form})\z"), F.lit(name)) for name, form in FORMS.items()))

    def told(kind: Column) -> Column:
        new = F.coalesce(*(F.when(kind == name, PERMUTE[name](value, key, back)) for name in FORMS))
        return let(new, lambda n: F.struct(F.when(n.isNotNull(), kind).alias("kind"), F.coalesce(n, value).alias("new")))

    return let(kind, told)


def with_pseudonyms(docs: DataFrame, key: str = DEFAULT_KEY, reveal: bool = False) -> DataFrame:
    """``docs`` with ``text`` rewritten and ``_kinds``, the kinds of the values replaced, in order."""
    text = F.col("text")
    # A value holds a digit or an at sign; texts without either need no further look.
    found = F.when(text.rlike("[0-9@]") & text.rlike(ANY), F.regexp_extract_all("text", F.lit(ANY), F.lit(0)))
    handled = F.transform(F.col("_found"), lambda value: _handled(value, key, reveal))
    pieces = F.split("text", ANY, -1)
    joined = F.array_join(
        F.transform(pieces, lambda piece, k: F.concat(piece, F.coalesce(F.get(F.col("_new"), k)["new"], F.lit("")))), ""
    )
    return (
        docs.withColumn("_found", found)
        .withColumn("_new", handled)
        .withColumn("text", F.when(F.col("_found").isNotNull(), joined).otherwise(text))
        .withColumn("_kinds", F.coalesce(F.filter(F.transform("_new", lambda v: v["kind"]), lambda k: k.isNotNull()), F.array().cast("array<string>")))
        .drop("_found", "_new")
    )


def pseudonymize(docs: DataFrame, key: str = DEFAULT_KEY) -> DataFrame:
    """doc_id, text with pseudonyms, and how many values of each kind were replaced."""
    done = with_pseudonyms(docs.select("doc_id", "text"), key)
    return done.select("doc_id", "text", *(_count(name).alias(f"n_{name}") for name in FORMS))


def _count(name: str) -> Column:
    return F.size(F.filter("_kinds", lambda kind: kind == name)).cast("long")
