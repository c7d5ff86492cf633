"""Pseudonyms for personal data that keep its format, by a keyed Feistel network.

A candidate found by pattern is replaced only if it is valid: a card number passes
the Luhn test and an IBAN the test of its check digits, a date is in the calendar, an address part is at most 255, a social
security number is in an assigned range. It is permuted within all values of the same form
by a Feistel network keyed by a secret, and check digits are made anew. So a pseudonym is
valid as well and of the same form, equal values get equal pseudonyms in all documents, and the key's
holder can undo all but those of e-mail addresses (``restore``). Where a form has values that are no value, the network is walked
on until one comes up. All steps are column expressions; candidates are replaced in one pass, so no
pseudonym is replaced again.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Rounds of the network; even, so that both halves come back to their places.
ROUNDS = 8
#: Turns of a walk at most. A turn fails with a chance of 0.85 at most, by the form; beyond them the job fails, and no value is ever let through.
TURNS = 512
#: The secret. A parameter of every function; this one is for tests and the registered query only.
KEY = "recallspark-demo-key"

# Forms of personal data.
EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}][\p{L}\p{N}._%+-]{0,63}+@(?:[\p{L}\p{N}-]{1,63}\.){1,8}\p{L}{2,24}(?![\p{L}\p{N}])"
IPV6 = (
    r"(?<![\w:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|[0-9A-Fa-f]{3,4}(?::[0-9A-Fa-f]{1,4}){0,5}::(?:[0-9A-Fa-f]{1,4}:){0,5}[0-9A-Fa-f]{1,4})(?![\w:])"
)
IPV4 = r"(?<![\w.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\w|\.\d)"
DATE = r"(?<![\w/.-])(?:\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}\.\d{1,2}\.\d{4})(?=T\d\d:|(?![\w/-]|\.\d))"
SSN = r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"
IBAN = r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)"
PHONE = r"(?<![\w+])\+\d{1,3}(?:[ .-]?\(?\d{1,4}\)?){2,5}(?!\w)"
NATIONAL = r"(?<![\w.+-])(?:\(\d{3}\) ?|\d{3}[-.])\d{3}[-.]\d{4}(?![\w-]|\.\d)"
CARD = r"(?<!\w)(?:\d{13,19}|\d{4} \d{4} \d{4} \d{1,7}|\d{4}-\d{4}-\d{4}-\d{1,7}|\d{4} \d{6} \d{5}|\d{4}-\d{6}-\d{5})(?!\w)"
ANY = "|".join([EMAIL, IPV6, IPV4, DATE, SSN, IBAN, PHONE, NATIONAL, CARD])

#: Dates are permuted among those from 1900-01-01 on, so many days.
FIRST_DAY, DAYS = "1900-01-01", 73_000


def _digest(key: str, *parts: Column) -> Column:
    """A long from 0 to 2^60 - 1 from the key and the parts."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), *parts).cast("binary"), 256), 1, 15), 16, 10).cast("long")


def _network(a: Column, b: Column, u: Column, v: Column, key: str, tweak: str, inverse: bool) -> Column:
    """Struct (a, b) that the pair a < u, b < v is permuted to; with ``inverse`` the one that it comes from."""

    def keyed(i: Column, modulus: Column, half: Column) -> Column:
        return _digest(key, F.lit(tweak), i.cast("string"), modulus.cast("string"), half.cast("string")) % modulus

    def turn(s: Column, i: Column) -> Column:
        # (a, b) below u and v becomes (b, a + f(b)), below v and u
        return F.struct(s["b"].alias("a"), ((s["a"] + keyed(i, s["u"], s["b"])) % s["u"]).alias("b"), s["v"].alias("u"), s["u"].alias("v"))

    def back(s: Column, i: Column) -> Column:
        return F.struct(((s["b"] + s["v"] - keyed(i, s["v"], s["a"])) % s["v"]).alias("a"), s["a"].alias("b"), s["v"].alias("u"), s["u"].alias("v"))

    start = F.struct(a.alias("a"), b.alias("b"), u.cast("long").alias("u"), v.cast("long").alias("v"))
    rounds = F.sequence(F.lit(ROUNDS), F.lit(1)) if inverse else F.sequence(F.lit(1), F.lit(ROUNDS))
    return F.aggregate(rounds, start, back if inverse else turn)


def permute_digits(digits: Column, key: str, tweak: str, inverse: bool = False, base: int = 10) -> Column:
    """Another string of as many digits (2 to 36 in base 10, 2 to 16 in base 16); a bijection for each length, key and tweak."""
    n = F.length(digits)
    left = (n / 2).cast("int")
    power = F.array(*[F.lit(base**i).cast("long") for i in range(19 if base == 10 else 9)])
    half = [F.conv(x, base, 10).cast("long") for x in (F.substr(digits, F.lit(1), left), F.substr(digits, left + 1, n - left))]
    new = _network(*half, F.element_at(power, left + 1), F.element_at(power, n - left + 1), key, tweak, inverse)

    def text(s: Column) -> Column:
        parts = [F.lpad(F.lower(F.conv(s[x].cast("string"), 10, base)), size, "0") for x, size in (("a", left), ("b", n - left))]
        return F.concat(*parts)

    return F.element_at(F.transform(F.array(new), text), 1)


def permute_below(value: Column, limit: int, key: str, tweak: str, inverse: bool = False, ok=None) -> Column:
    """A bijection of the numbers 0 .. limit - 1, or of those of them for which ``ok`` holds.

    The network works on pairs, about as many as the limit, and is walked on until a value is below the limit and ``ok``.
    As the walk from such a value comes back to one, no two values end in the same.
    """
    u = math.isqrt(limit - 1) + 1
    v = -(-limit // u)

    def once(x: Column) -> Column:
        new = _network(((x - x % v) / v).cast("long"), x % v, F.lit(u), F.lit(v), key, tweak, inverse)
        return F.element_at(F.transform(F.array(new), lambda s: s["a"] * v + s["b"]), 1)

    def on(s: Column, _: Column) -> Column:
        # one turn of the walk; the array lets the turn's result be named and used twice
        def state(y: Column) -> Column:
            return F.struct(y.alias("x"), ((y < limit) & (ok(y) if ok else F.lit(True))).alias("done"))

        return F.when(s["done"], s).otherwise(F.element_at(F.transform(F.array(once(s["x"])), state), 1))

    start = F.struct(value.cast("long").alias("x"), F.lit(False).alias("done"))
    lost = F.raise_error(F.lit("a walk found no value")).cast("long")
    return F.aggregate(F.sequence(F.lit(1), F.lit(TURNS)), start, on, lambda s: F.when(s["done"] | s["x"].isNull(), s["x"]).otherwise(lost))


def luhn_sum(digits: Column) -> Column:
    """Sum of the digits, every second one from the right doubled and cast out by nines."""

    def value(i: Column) -> Column:
        d = F.substr(digits, F.length(digits) - i, F.lit(1)).cast("int")
        return F.when(i % 2 == 0, d).otherwise(2 * d - F.when(d > 4, 9).otherwise(0))

    return F.aggregate(F.transform(F.sequence(F.lit(0), F.length(digits) - 1), value), F.lit(0), lambda a, x: a + x)


def refill(form: Column, digits: Column, kind: str = "0-9") -> Column:
    """The form with its digits, characters of ``kind``, replaced by the given ones, in order."""

    def place(p: Column) -> Column:
        c = F.substr(form, p, F.lit(1))
        so_far = F.length(F.regexp_replace(F.substr(form, F.lit(1), p), f"[^{kind}]", ""))
        return F.when(c.rlike(f"[{kind}]"), F.substr(digits, so_far, F.lit(1))).otherwise(c)

    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(form)), place), "")


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _card(m: Column, key: str, inverse: bool) -> Column:
    digits = _digits(m)
    body = permute_digits(F.substr(digits, F.lit(1), F.length(digits) - 1), key, "card", inverse)
    check = (10 - luhn_sum(F.concat(body, F.lit("0"))) % 10) % 10
    return F.when(luhn_sum(digits) % 10 == 0, refill(m, F.concat(body, check.cast("string"))))


def _mod97(text: Column) -> Column:
    """The number that a text of digits and capital letters (A is 10) stands for, modulo 97."""

    def add(total: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code < 65, (total * 10 + code - 48) % 97).otherwise((total * 100 + code - 55) % 97)

    return F.aggregate(F.split(text, ""), F.lit(0), lambda total, c: F.when(F.length(c) == 0, total).otherwise(add(total, c)))


def _iban(m: Column, key: str, inverse: bool) -> Column:
    """The account's digits are permuted, country and letters stay, the check digits are those of the new account."""
    whole = F.regexp_replace(m, " ", "")
    country, account = F.substring(whole, 1, 2), F.substr(whole, F.lit(5), F.length(whole))
    digits = permute_digits(_digits(account), key, "iban", inverse)
    check = F.lpad((98 - _mod97(F.concat(refill(account, digits), country, F.lit("00")))).cast("string"), 2, "0")
    valid = (F.length(_digits(account)) >= 2) & (_mod97(F.concat(account, F.substring(whole, 1, 4))) == 1)
    return F.when(valid, refill(m, F.concat(check, digits)))


def _phone(m: Column, key: str, inverse: bool) -> Column:
    country = F.regexp_extract(m, r"^\+\d{1,3}", 0)
    rest = F.substr(m, F.length(country) + 1, F.length(m))
    digits = F.length(_digits(m))
    return F.when((digits >= 7) & (digits <= 15), F.concat(country, refill(rest, permute_digits(_digits(rest), key, "phone", inverse))))


def _national(m: Column, key: str, inverse: bool) -> Column:
    """North American numbers: area and exchange from 200 to 999."""
    digits = _digits(m)
    area, exchange, line = (F.substring(digits, a, n).cast("long") for a, n in ((1, 3), (4, 3), (7, 4)))
    new = permute_below(((area - 200) * 800 + exchange - 200) * 10_000 + line, 800 * 800 * 10_000, key, "national", inverse)

    def text(y: Column) -> Column:
        return F.concat((F.floor(y / 8_000_000) + 200).cast("string"), (F.floor(y / 10_000) % 800 + 200).cast("string"), F.lpad((y % 10_000).cast("string"), 4, "0"))

    return F.when((area >= 200) & (exchange >= 200), refill(m, F.element_at(F.transform(F.array(new), text), 1)))


def _ipv4(m: Column, key: str, inverse: bool) -> Column:
    """Addresses as they are usually written, and, as a form of their own, those with three digits in each octet of which one begins with 0. Other leading zeros are no address."""
    texts = F.split(m, r"\.")
    parts = F.transform(texts, lambda x: x.cast("long"))
    number = F.aggregate(parts, F.lit(0).cast("long"), lambda a, x: a * 256 + x)
    octets = [F.lit(256**i) for i in (3, 2, 1, 0)]

    def below_hundred(y: Column) -> Column:
        return F.least(*[F.floor(y / o) % 256 for o in octets]) < 100

    def text(new: Column, width: int) -> Column:
        def told(y: Column) -> Column:
            each = [(F.floor(y / o) % 256).cast("string") for o in octets]
            return F.concat_ws(".", *[F.lpad(x, width, "0") if width else x for x in each])

        return F.element_at(F.transform(F.array(new), told), 1)

    zero = F.exists(texts, lambda x: (F.length(x) > 1) & x.startswith("0"))
    padded = zero & F.forall(texts, lambda x: F.length(x) == 3)
    usual = F.when(~zero, text(permute_below(number, 1 << 32, key, "ipv4", inverse), 0))
    other = F.when(padded, text(permute_below(number, 1 << 32, key, "ipv4-padded", inverse, below_hundred), 3))
    return F.when(F.array_max(parts) <= 255, F.coalesce(usual, other))


def _ipv6(m: Column, key: str, inverse: bool) -> Column:
    """The hexadecimal digits are permuted, each half of them by itself; colons and the number of digits between them stay."""
    digits = F.regexp_replace(m, ":", "")
    half = (F.length(digits) / 2).cast("int")
    parts = F.substr(digits, F.lit(1), half), F.substr(digits, half + 1, F.length(digits) - half)
    new = F.concat(*[permute_digits(F.lower(x), key, f"ipv6-{i}", inverse, 16) for i, x in enumerate(parts)])
    same_case = refill(m, F.when(F.lower(m) == m, new).otherwise(F.upper(new)), "0-9A-Fa-f")
    few = F.size(F.split(m, ":", -1)) <= 8
    return F.when((F.length(digits) >= 4) & few, same_case)


def _ssn(m: Column, key: str, inverse: bool) -> Column:
    area, group, serial = (F.substring(m, a, n).cast("long") for a, n in ((1, 3), (5, 2), (8, 4)))
    valid = (area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0)
    index = ((area - 1 - F.when(area > 666, 1).otherwise(0)) * 99 + group - 1) * 9999 + serial - 1
    new = permute_below(index, 898 * 99 * 9999, key, "ssn", inverse)

    def text(y: Column) -> Column:
        a = F.floor(y / (99 * 9999))
        parts = [(a + 1 + F.when(a >= 665, 1).otherwise(0), 3), (F.floor(y / 9999) % 99 + 1, 2), (y % 9999 + 1, 4)]
        return F.concat_ws("-", *[F.lpad(x.cast("string"), n, "0") for x, n in parts])

    return F.when(valid, F.element_at(F.transform(F.array(new), text), 1))


def _date(m: Column, key: str, inverse: bool) -> Column:
    """Dates by day, each form within itself.

    A form's dates are those that are written in it and in no form before it: with slashes, day first, and month first only
    where that is no date, so from the 13th on; without leading zeros only where the day or the month has one digit. The whole forms share one permutation.
    """
    first = F.lit(FIRST_DAY).cast("date")
    numbers = F.split(m, "[-/.]")

    def date(y: Column) -> Column:
        return F.date_add(first, y.cast("int"))

    def short(y: Column) -> Column:
        return (F.day(date(y)) < 10) | (F.month(date(y)) < 10)

    def late(y: Column) -> Column:
        return F.day(date(y)) > 12

    def short_and_late(y: Column) -> Column:
        return (F.day(date(y)) > 12) & (F.month(date(y)) < 10)

    def by(form: str, places: tuple[int, int, int], tweak: str = "date", ok=None) -> Column:
        year, month, day = (F.element_at(numbers, p) for p in places)
        iso = F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0"))
        value = F.datediff(F.try_to_timestamp(iso, F.lit("yyyy-MM-dd")).cast("date"), first).cast("long")
        valid = (value >= 0) & (value < DAYS) & (ok(value) if ok else F.lit(True))
        return F.when(valid, F.date_format(date(permute_below(value, DAYS, key, tweak, inverse, ok)), form))

    dm, md = (3, 2, 1), (3, 1, 2)
    slashed = F.coalesce(by("dd/MM/yyyy", dm), by("MM/dd/yyyy", md, "date-month-first", late))
    slashed_short = F.coalesce(by("d/M/yyyy", dm, "date-short", short), by("M/d/yyyy", md, "date-short-month-first", short_and_late))
    return (
        F.when(m.rlike(r"^\d{4}-"), by("yyyy-MM-dd", (1, 2, 3)))
        .when(m.rlike(r"^\d\d/\d\d/"), slashed)
        .when(m.rlike(r"^\d\d\.\d\d\."), by("dd.MM.yyyy", dm))
        .when(m.rlike(r"^[1-9]\d?/[1-9]\d?/"), slashed_short)
        .when(m.rlike(r"^[1-9]\d?\.[1-9]\d?\."), by("d.M.yyyy", dm, "date-short", short))
    )


def _email(m: Column, key: str, inverse: bool) -> Column:
    if inverse:
        return F.lit(None).cast("string")
    domain = F.regexp_extract(m, "@(.*)$", 1)
    return F.concat(F.lit("u"), F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit("email"), F.lower(m)).cast("binary"), 256), 1, 12), F.lit("@"), domain)


def pseudonym(m: Column, key: str = KEY, inverse: bool = False) -> Column:
    """(kind, new) of a candidate; new is null where the candidate isn't valid and stays."""

    def of(kind: str, new) -> Column:
        return F.struct(F.lit(kind).alias("kind"), new(m, key, inverse).alias("new"))

    return (
        F.when(m.contains("@"), of("email", _email))
        .when(m.contains(":"), of("ipv6", _ipv6))
        .when(m.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), of("ipv4", _ipv4))
        .when(m.rlike(r"^(\d{4}-\d{2}-\d{2}|\d{1,2}[/.]\d{1,2}[/.]\d{4})$"), of("date", _date))
        .when(m.rlike(r"^\d{3}-\d{2}-\d{4}$"), of("ssn", _ssn))
        .when(m.rlike("^[A-Z]"), of("iban", _iban))
        .when(m.startswith("+"), of("phone", _phone))
        .when(m.rlike(r"^\(?\d{3}[-.)] ?\d{3}[-.]\d{4}$"), of("phone", _national))
        .otherwise(of("card", _card))
    )


def pseudonymize(docs: DataFrame, key: str = KEY, inverse: bool = False) -> DataFrame:
    """All columns of the documents with ``text`` rewritten, and ``pii``: an array of (kind, new) in text order.

    A null text stays null with an empty array. Candidates that fail their test stay as they are: they
    are not in the array. E-mail addresses have no check to keep; their local part becomes a keyed name. A column
    ``pii`` in the input is replaced. Texts of any length are searched whole. Rows are independent of each other, so nothing is shuffled
    and repeated rows or ids come out as they are.
    """
    text = F.col("text")
    none = F.array().cast("array<string>")
    found = docs.withColumn("__m", F.when(text.rlike("[0-9@]"), F.regexp_extract_all(text, F.lit(f"({ANY})"), 1)).otherwise(none))
    found = found.withColumn("__p", F.transform("__m", lambda m: F.struct(m.alias("old"), pseudonym(m, key, inverse).alias("p"))))
    new = F.transform("__p", lambda x: F.coalesce(x["p"]["new"], x["old"]))
    joined = F.array_join(F.zip_with(F.split(text, ANY, -1), new, lambda part, x: F.concat(part, F.coalesce(x, F.lit("")))), "")
    found = found.withColumn("text", F.when(F.size("__m") > 0, joined).otherwise(text))
    kept = F.filter(F.transform("__p", lambda x: x["p"]), lambda p: p["new"].isNotNull())
    return found.withColumn("pii", kept).drop("__m", "__p")


def restore(docs: DataFrame, key: str = KEY) -> DataFrame:
    """The documents with the values that their pseudonyms stand for; keyed names of e-mail addresses stay, as they have no inverse."""
    return pseudonymize(docs, key, inverse=True).drop("pii")


def op9_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = pseudonymize(common.read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    kinds = F.array_join(F.transform("pii", lambda p: p["kind"]), ",")
    return docs.select("doc_id", "text", F.size("pii").cast("long").alias("n_found"), kinds.alias("kinds"))
