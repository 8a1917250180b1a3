"""Format-preserving pseudonyms for validated numbers and dates, by keyed Feistel rounds.

A value is changed within its own format: a card number becomes another one with
a valid check digit, a date another date. The same key maps equal values to
equal pseudonyms in every document, however they are punctuated, and different
values to different ones; with the key the mapping can be undone (but for a date
written month first, whose pseudonym may read as day first). All of it is SQL functions, evaluated only for texts in which something was found.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
# How each kind is written. A group that may repeat without end is possessive: backtracking into it would
# take stack for each turn, and nothing follows it that could match there.
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9](?:[A-Za-z0-9-]*+[A-Za-z0-9]*)(?:\.[A-Za-z0-9-]++)++"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
DATE = r"(?<![0-9./-])(?:(?:19|20)[0-9]{2}([-/])[0-9]{2}\1[0-9]{2}|[0-9]{2}([./])[0-9]{2}\2(?:19|20)[0-9]{2})(?![0-9/-]|\.[0-9])"
IP = r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
PHONE = r"(?<![0-9+])\+[0-9]{1,3}(?:[ .-]?\([0-9]{1,4}\))?(?:[ .-]?[0-9]{2,4}){2,5}(?![0-9])"
CARD = r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9])"
_DIGIT = "^[0-9]$"


def _joined(parts: list[str]) -> str:
    """All kinds as one pattern; the group numbers of the dates stay right as they come first."""
    return "|".join(parts)


FOUND = _joined([DATE, EMAIL, IBAN, IP, SSN, PHONE, CARD])


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is used, also inside of lambdas."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _round_digest(key: str, kind: str, turn: Column, other: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), turn.cast("string"), other.cast("string")), 256)


def _hex(digest: Column, start: Column, n: int) -> Column:
    return F.conv(F.substr(digest, start, F.lit(n)), 16, 10).cast("long")


def _turns(undo: bool) -> Column:
    return F.sequence(F.lit(ROUNDS - 1), F.lit(0)) if undo else F.sequence(F.lit(0), F.lit(ROUNDS - 1))


def _moved(char: Column, by: Column) -> Column:
    """A digit or letter moved on within its class; any other character as it is."""
    code = F.ascii(char)

    def within(low: int, n: int) -> Column:
        return F.char(low + F.pmod(code - low + by, F.lit(n)))

    return F.when(code.between(48, 57), within(48, 10)).when(code.between(97, 122), within(97, 26)) \
        .when(code.between(65, 90), within(65, 26)).otherwise(char)


def permuted_text(value: Column, key: str, kind: str, undo: bool = False) -> Column:
    """A string of the same length and character classes: the halves in turn move each other's characters."""
    half = F.floor(F.length(value) / 2).cast("int")
    sign = -1 if undo else 1

    def moved(part: Column, other: Column, turn: Column) -> Column:
        chars = _let(_round_digest(key, kind, turn, other), lambda digest: F.array_join(F.transform(
            F.sequence(F.lit(1), F.length(part)), lambda i: _moved(
                F.substr(part, i, F.lit(1)), sign * _hex(digest, 2 * ((i - 1) % 32) + 1, 2))), ""))
        return F.when(F.length(part) > 0, chars).otherwise(part)

    def step(halves: Column, turn: Column) -> Column:
        a, b = halves["a"], halves["b"]
        even = turn % 2 == 0
        return F.struct(F.when(even, moved(a, b, turn)).otherwise(a).alias("a"),
                        F.when(even, b).otherwise(moved(b, a, turn)).alias("b"))

    start = F.struct(F.substr(value, F.lit(1), half).alias("a"), F.substr(value, half + 1).alias("b"))
    return F.aggregate(_turns(undo), start, step, lambda halves: F.concat(halves["a"], halves["b"]))


def permuted_number(value: Column, a: int, b: int, key: str, kind: str, undo: bool = False) -> Column:
    """A permutation of 0 .. a * b - 1: remainder and quotient by ``a`` move each other."""
    sign = -1 if undo else 1

    def moved(part: Column, other: Column, turn: Column, n: int) -> Column:
        return F.pmod(part + sign * (_hex(_round_digest(key, kind, turn, other), F.lit(1), 12) % n), F.lit(n))

    def step(halves: Column, turn: Column) -> Column:
        low, high = halves["low"], halves["high"]
        even = turn % 2 == 0
        return F.struct(F.when(even, moved(low, high, turn, a)).otherwise(low).alias("low"),
                        F.when(even, high).otherwise(moved(high, low, turn, b)).alias("high"))

    value = value.cast("long")
    start = F.struct((value % a).alias("low"), F.floor(value / a).cast("long").alias("high"))
    return F.aggregate(_turns(undo), start, step, lambda halves: halves["low"] + halves["high"] * a)


def _filled(pattern: Column, values: Column, place: str) -> Column:
    """``pattern`` with its characters of the class ``place`` taken from ``values`` in order."""
    start = F.struct(F.lit(1).alias("i"), F.lit("").alias("out"))

    def filled(known: Column) -> Column:
        def step(acc: Column, char: Column) -> Column:
            hit = char.rlike(place)
            return F.struct(F.when(hit, acc["i"] + 1).otherwise(acc["i"]).alias("i"), F.concat(
                acc["out"], F.when(hit, F.substr(known, acc["i"], F.lit(1))).otherwise(char)).alias("out"))
        return F.aggregate(F.split(pattern, ""), start, step, lambda acc: acc["out"])

    return _let(values, filled)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """The Luhn sum; a multiple of ten for a valid number."""
    def summed(known: Column) -> Column:
        def weighted(i: Column) -> Column:
            twice = F.substr(known, i, F.lit(1)).cast("int") * (1 + (F.length(known) - i) % 2)
            return F.when(twice > 9, twice - 9).otherwise(twice)
        return F.aggregate(F.sequence(F.lit(1), F.length(known)), F.lit(0), lambda total, i: total + weighted(i))

    return _let(digits, summed)


def mod97(text: Column) -> Column:
    """The text as a number, letters counting from 10, modulo 97."""
    def step(acc: Column, char: Column) -> Column:
        code = F.ascii(char)
        return F.when(char == "", acc).when(code.between(48, 57), (acc * 10 + code - 48) % 97) \
            .otherwise((acc * 100 + code - 55) % 97)

    return F.aggregate(F.split(text, ""), F.lit(0), step)


def _card(value: Column, key: str, undo: bool) -> Column:
    def checked(body: Column) -> Column:
        return F.concat(body, F.pmod(10 - luhn(F.concat(body, F.lit("0"))) % 10, F.lit(10)).cast("string"))

    def changed(digits: Column) -> Column:
        body = permuted_text(F.substr(digits, F.lit(1), F.length(digits) - 1), key, "card", undo)
        return F.when(luhn(digits) % 10 == 0, _filled(value, _let(body, checked), _DIGIT))

    return _let(_digits(value), changed)


def _phone(value: Column, key: str, undo: bool) -> Column:
    """The country code stays: one digit for 1 and 7, else two, whatever the punctuation."""
    def changed(digits: Column) -> Column:
        code = F.when(digits.rlike("^[17]"), 1).otherwise(2)
        new = F.concat(F.substr(digits, F.lit(1), code), permuted_text(F.substr(digits, code + 1), key, "phone", undo))
        return F.when(F.length(digits).between(8, 15), _filled(value, new, _DIGIT))

    return _let(_digits(value), changed)


def _iban(value: Column, key: str, undo: bool) -> Column:
    compact = F.regexp_replace(value, " ", "")
    country, rest = F.substr(compact, F.lit(1), F.lit(2)), F.substr(compact, F.lit(5))

    def checked(new: Column) -> Column:
        return F.concat(country, F.lpad((98 - mod97(F.concat(new, country, F.lit("00")))).cast("string"), 2, "0"), new)

    valid = (mod97(F.concat(rest, F.substr(compact, F.lit(1), F.lit(4)))) == 1) & F.length(compact).between(15, 34)
    return F.when(valid, _filled(
        value, _let(permuted_text(rest, key, "iban", undo), checked), "^[0-9A-Z]$"))


def _ip(value: Column, key: str, undo: bool) -> Column:
    parts = F.transform(F.split(value, r"\."), lambda x: x.cast("long"))
    number = F.aggregate(parts, F.lit(0).cast("long"), lambda total, x: total * 256 + x)
    new = permuted_number(number, 1 << 16, 1 << 16, key, "ip", undo)
    return F.when(F.forall(parts, lambda x: x <= 255), _let(new, lambda known: F.array_join(
        F.transform(F.array(F.lit(24), F.lit(16), F.lit(8), F.lit(0)),
                    lambda k: F.floor(known / F.pow(F.lit(2), k)).cast("long") % 256), ".")))


def _ssn(value: Column, key: str, undo: bool) -> Column:
    """Area 001 to 899 without 666, group 01 to 99, serial 0001 to 9999."""
    area, group, serial = (F.substr(value, F.lit(at), F.lit(n)).cast("long") for at, n in ((1, 3), (5, 2), (8, 4)))
    place = F.when(area > 666, area - 2).otherwise(area - 1)
    new = permuted_number(place + 898 * ((group - 1) + 99 * (serial - 1)), 898, 99 * 9999, key, "ssn", undo)
    new_area, rest = new % 898, F.floor(new / 898).cast("long")
    out = F.concat_ws("-", F.lpad(F.when(new_area >= 665, new_area + 2).otherwise(new_area + 1).cast("string"), 3, "0"),
                      F.lpad((rest % 99 + 1).cast("string"), 2, "0"),
                      F.lpad((F.floor(rest / 99).cast("long") + 1).cast("string"), 4, "0"))
    return F.when((area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0), out)


def _date(value: Column, key: str, undo: bool) -> Column:
    """Days of 1900 to 2099, 17 x 4297 of them. With slashes the day comes first, or the month where only that gives a date."""
    first = F.lit("1900-01-01").cast("date")
    out = F.lit(None).cast("string")
    for form, order in reversed((("yyyy-MM-dd", "^....-"), ("yyyy/MM/dd", "^..../"), ("dd.MM.yyyy", r"^..\."),
                                 ("dd/MM/yyyy", "^../"), ("MM/dd/yyyy", "^../"))):
        day = F.to_date(F.try_to_timestamp(value, F.lit(form)))
        new = F.date_add(first, permuted_number(F.datediff(day, first), 17, 4297, key, "date", undo).cast("int"))
        out = F.when(value.rlike(order) & day.isNotNull(), F.date_format(new, form)).otherwise(out)
    return out


def _email(value: Column, key: str, undo: bool) -> Column:
    at = F.instr(value, "@")
    return F.concat(permuted_text(F.substr(value, F.lit(1), at - 1), key, "email", undo), F.substr(value, at))


KINDS: dict[str, tuple[str, Callable[[Column, str, bool], Column]]] = {
    "date": (DATE, _date), "email": (EMAIL, _email), "iban": (IBAN, _iban), "ip": (IP, _ip), "ssn": (SSN, _ssn),
    "phone": (PHONE, _phone), "card": (CARD, _card)}


def pseudonym(value: Column, key: str, undo: bool = False) -> Column:
    """The pseudonym of one found value, or null where it is not a valid one."""
    cases = [F.when(value.rlike(f"^(?:{pattern})$"), change(value, key, undo)) for pattern, change in KINDS.values()]
    return F.coalesce(*cases)


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text", undo: bool = False) -> DataFrame:
    """``docs`` with pseudonyms in the text, and ``n_replaced`` and ``n_invalid``.

    Found are e-mail addresses, IBANs, card numbers, IPv4 addresses, US social
    security numbers, international phone numbers and dates of 1900 to 2099. What
    has the form but not the check digit, the range or the calendar day stays as
    it is and counts as invalid. A null text stays null with null counts; an
    empty one has zero. Each row is changed for itself, so ties and repeated rows
    get equal results. Other columns stay; the two counts replace columns of
    their names. ``undo`` restores the texts.
    """
    text = F.col(text_col)
    # Every kind has a digit or an at sign; most texts have neither and stop at that plain search.
    found = docs.withColumn("__found", F.when(text.rlike("[0-9@]") & text.rlike(FOUND), F.regexp_extract_all(text, F.lit(FOUND), F.lit(0))))
    found = found.withColumn("__new", F.transform("__found", lambda v: pseudonym(v, key, undo)))
    put = F.zip_with("__found", "__new", lambda old, new: F.coalesce(new, old))
    rest = F.zip_with(F.split(text, FOUND, -1), put, lambda gap, value: F.concat(gap, F.coalesce(value, F.lit(""))))
    valid = F.size(F.filter("__new", lambda v: v.isNotNull()))
    return found.withColumns({
        text_col: F.when(F.col("__found").isNull(), text).otherwise(F.array_join(rest, "")),
        "n_replaced": F.when(text.isNotNull(), F.when(F.col("__found").isNull(), 0).otherwise(valid)),
        "n_invalid": F.when(text.isNotNull(), F.when(F.col("__found").isNull(), 0).otherwise(F.size("__found") - valid)),
    }).drop("__found", "__new")
