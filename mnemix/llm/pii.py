"""PII: format-preserving Feistel pseudonyms, as column expressions only.

Values are found by one pattern, validated by kind, and replaced by a keyed permutation within their format: a digit
stays a digit, a date a date, a card number keeps its check digit's validity, an IBAN stays valid, an address stays an
address. The permutation depends on key, kind and value alone, so equal values get equal pseudonyms in every document,
and different values different ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8

# The formats that are looked for.
EMAIL = r"[\p{L}\p{N}](?:[\p{L}\p{N}._%+-]*[\p{L}\p{N}_%+-])?@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)+"
SECRET = r"(?<![\p{L}\p{N}])(?:[0-9a-f]{32,128}|[0-9A-F]{32,128})(?![\p{L}\p{N}])"
IBAN = r"(?<![\p{L}\p{N}])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])"
IP = r"(?<![\p{N}.])(?:(?:0|[1-9][0-9]{0,2})\.){3}(?:0|[1-9][0-9]{0,2})(?![\p{N}]|\.[\p{N}])"
DATE = r"(?<![\p{N}./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})(?![\p{N}]|[./-][\p{N}])"
SSN = r"(?<![\p{N}-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\p{N}]|-[\p{N}])"
PHONE = r"(?<![\p{L}\p{N}])\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[ .-]?[0-9]{2,4}){1,4}(?!\p{N})|(?<![\p{L}\p{N}])\(?[0-9]{3}\)?[ .-][0-9]{3}[.-][0-9]{4}(?!\p{N})"
NUMBER = r"(?<![\p{L}\p{N}])(?:[0-9]{13,19}|(?:[0-9]{4} ){3}[0-9]{4}|(?:[0-9]{4}-){3}[0-9]{4}|[0-9](?:[ -]?[0-9]){12,18})(?!\p{N})"
ANY = "|".join((EMAIL, SECRET, IBAN, IP, DATE, SSN, PHONE, NUMBER))
QUICK = r"@|[0-9][^\n]{0,3}[0-9]|[0-9a-f]{32}|[0-9A-F]{32}"  # every text with a match of ANY has one of this

DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
FIRST_DAY, DAYS = "1800-01-01", (189, 773)  # whose product is the number of days from 1800 to 2199
FIRST_YEAR, MONTHS, LATE = 1800, 4800, 19  # the same years in months, and the days from 13 to 31


def _number(hexes: Column) -> Column:
    return F.conv(hexes, 16, 10).cast("long")


def _tag(key: str, kind: str, i: Column, *parts: Column) -> Column:
    return F.sha2(F.concat_ws("\x1f", F.lit(key), F.lit(kind), i.cast("string"), *[p.cast("string") for p in parts]), 256)


def permuted_pair(left: Column, right: Column, a: int, b: int, key: str, kind: str) -> Column:
    """(l, r) of a Feistel network over pairs below a and b: each round adds to one side a keyed hash of the other."""

    def step(acc: Column, i: Column) -> Column:
        l = F.pmod(acc["l"] + _number(F.substring(_tag(key, kind, i, F.lit("r"), acc["r"]), 1, 15)), F.lit(a))
        r = F.pmod(acc["r"] + _number(F.substring(_tag(key, kind, i, F.lit("l"), l), 1, 15)), F.lit(b))
        return F.struct(l.alias("l"), r.alias("r"))

    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS // 2)), start, step)


def _turned(c: Column, by: Column, alphabets: tuple[str, ...]) -> Column:
    out = c
    for letters in alphabets:
        at = F.instr(F.lit(letters), c)
        out = F.when(at > 0, F.substr(F.lit(letters), (at - 1 + by) % len(letters) + 1, F.lit(1))).otherwise(out)
    return out


def permuted_text(value: Column, key: str, kind: str, alphabets: tuple[str, ...] = (DIGITS, LOWER, UPPER)) -> Column:
    """A Feistel network over the halves of a string; each character is turned within its own alphabet, others stay."""

    def step(acc: Column, i: Column) -> Column:
        chars = F.split(acc["l"], "")
        new = F.transform(chars, lambda c, j: _turned(c, _number(F.substring(_tag(key, kind, i, j, acc["r"], F.length(acc["l"])), 1, 12)), alphabets))
        return F.struct(acc["r"].alias("l"), F.when(acc["l"] == "", F.lit("")).otherwise(F.array_join(new, "")).alias("r"))

    half = F.floor(F.length(value) / 2).cast("int")
    start = F.struct(F.substr(value, F.lit(1), half).alias("l"), F.substr(value, half + 1).alias("r"))
    end = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step)
    return F.concat(end["l"], end["r"])


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def put_back(value: Column, digits: Column) -> Column:
    """value with its digits replaced in turn by those of the other column."""
    place = lambda j: F.length(digits_of(F.substr(value, F.lit(1), j + 1)))
    return F.array_join(F.transform(F.split(value, ""), lambda c, j: F.when(c.between("0", "9"), F.substr(digits, place(j), F.lit(1))).otherwise(c)), "")


def luhn(digits: Column) -> Column:
    """The Luhn sum modulo 10 of a string of digits; 0 is valid."""

    def add(acc: Column, c: Column) -> Column:
        d = c["d"].cast("int") * F.when(c["twice"], 2).otherwise(1)
        return acc + F.when(d > 9, d - 9).otherwise(d)

    each = F.transform(F.split(F.reverse(digits), ""), lambda c, j: F.struct(c.alias("d"), (j % 2 == 1).alias("twice")))
    return F.aggregate(each, F.lit(0), add) % 10


def mod97(text: Column) -> Column:
    """The number that letters (A = 10) and digits spell, modulo 97."""
    value = lambda c: F.when(c.between("0", "9"), c.cast("int")).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.split(text, ""), F.lit(0), lambda acc, c: (acc * F.when(c.between("0", "9"), 10).otherwise(100) + value(c)) % 97)


def _email(m: Column, key: str) -> Column:
    local = F.substring_index(m, "@", 1)
    return F.concat(permuted_text(local, key, "email"), F.lit("@"), F.substring_index(m, "@", -1))


def _ip(m: Column, key: str) -> Column:
    o = F.split(m, r"\.")
    n = lambda i: F.get(o, F.lit(i)).cast("int")
    p = permuted_pair(n(0) * 256 + n(1), n(2) * 256 + n(3), 65536, 65536, key, "ip")
    new = F.transform(F.array(p), lambda x: F.concat_ws(".", *[v.cast("string") for v in (F.floor(x["l"] / 256), x["l"] % 256, F.floor(x["r"] / 256), x["r"] % 256)]))
    valid = (n(0) < 256) & (n(1) < 256) & (n(2) < 256) & (n(3) < 256)
    return F.when(valid, F.get(new, F.lit(0))).otherwise(m)


def _date(m: Column, key: str, form: str) -> Column:
    day = F.datediff(F.try_to_timestamp(m, F.lit(form)).cast("date"), F.lit(FIRST_DAY).cast("date"))
    a, b = DAYS
    p = permuted_pair(F.floor(day / b), day % b, a, b, key, "date")
    new = F.transform(F.array(p), lambda x: F.date_format(F.date_add(F.lit(FIRST_DAY).cast("date"), (x["l"] * b + x["r"]).cast("int")), form))
    return F.when(day.between(0, a * b - 1), F.get(new, F.lit(0))).otherwise(m)


def _late_date(m: Column, key: str) -> Column:
    """A dd/MM/yyyy date that cannot be read as MM/dd/yyyy, so of a day after the twelfth, among those of its kind.

    Months and late days are permuted as a pair, again and again until the pair is a day of the calendar: whichever day
    the walk starts from, the walk back finds it.
    """
    day, month, year = (F.substring(m, at, n).cast("int") for at, n in ((1, 2), (4, 2), (7, 4)))
    place = lambda x: F.make_date((F.lit(FIRST_YEAR) + F.floor(x["l"] / 12)).cast("int"), (x["l"] % 12 + 1).cast("int"), F.lit(1))
    real = lambda x: x["r"] + 13 <= F.dayofmonth(F.last_day(place(x)))
    once = lambda x: permuted_pair(x["l"], x["r"], MONTHS, LATE, key, "late date")
    start = F.struct(((year - FIRST_YEAR) * 12 + month - 1).cast("long").alias("l"), (day - 13).cast("long").alias("r"))
    walk = lambda x, i: F.when((i > 1) & real(x), x).otherwise(once(x))
    # one pair in thirty is no day, so a walk of forty steps that has not met one would need a chance of 1e-60
    end = F.aggregate(F.sequence(F.lit(1), F.lit(40)), start, walk)
    text = lambda x: F.concat_ws("/", F.lpad((x["r"] + 13).cast("string"), 2, "0"), F.date_format(place(x), "MM/yyyy"))
    inside = F.try_to_timestamp(m, F.lit("dd/MM/yyyy")).isNotNull() & year.between(FIRST_YEAR, FIRST_YEAR + MONTHS // 12 - 1)
    return F.when(inside, F.get(F.transform(F.array(end), text), F.lit(0))).otherwise(m)


def _ssn(m: Column, key: str) -> Column:
    area, group, serial = (F.substring(m, at, n).cast("int") for at, n in ((1, 3), (5, 2), (8, 4)))
    p = permuted_pair(area - F.when(area > 666, 2).otherwise(1), (group - 1) * 9999 + serial - 1, 898, 99 * 9999, key, "ssn")
    new = F.transform(F.array(p), lambda x: F.format_string("%03d-%02d-%04d", x["l"] + F.when(x["l"] >= 665, 2).otherwise(1), F.floor(x["r"] / 9999) + 1, x["r"] % 9999 + 1))
    return F.when(area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0), F.get(new, F.lit(0))).otherwise(m)


def _phone(m: Column, key: str) -> Column:
    """The country code stays."""
    code = F.regexp_extract(m, r"^\+[0-9]{1,3}(?=[ .(-])[ .-]?|^\+", 0)
    rest = F.substr(m, F.length(code) + 1)
    return F.concat(code, put_back(rest, permuted_text(digits_of(rest), key, "phone")))


def _number_of(m: Column, key: str) -> Column:
    """A number of 13 to 19 digits whose Luhn sum is valid: all digits but the last are permuted, the last makes the sum valid again."""
    d = digits_of(m)
    body = permuted_text(F.substr(d, F.lit(1), F.length(d) - 1), key, "number")
    new = F.transform(F.array(body), lambda x: F.concat(x, F.pmod(-luhn(F.concat(x, F.lit("0"))), F.lit(10)).cast("string")))
    return F.when(luhn(d) == 0, put_back(m, F.get(new, F.lit(0)))).otherwise(m)


def _iban(m: Column, key: str) -> Column:
    plain = F.replace(m, F.lit(" "), F.lit(""))
    land, body = F.substring(plain, 1, 2), F.substr(plain, F.lit(5))
    new = F.transform(F.array(permuted_text(body, key, "iban")), lambda x: F.concat(land, F.lpad((98 - mod97(F.concat(x, land, F.lit("00")))).cast("string"), 2, "0"), x))
    spaced = F.when(F.contains(m, F.lit(" ")), F.rtrim(F.regexp_replace(F.get(new, F.lit(0)), "(.{4})", "$1 "))).otherwise(F.get(new, F.lit(0)))
    return F.when(mod97(F.concat(body, F.substring(plain, 1, 4))) == 1, spaced).otherwise(m)


def pseudonym(m: Column, key: str) -> Column:
    """The pseudonym of one match, or the match itself where it fails its kind's validation."""
    whole = lambda p: m.rlike(rf"^(?:{p})$")
    return (
        F.when(F.contains(m, F.lit("@")), _email(m, key))
        .when(m.rlike("^[0-9a-f]{32,}$"), permuted_text(m, key, "secret", ("0123456789abcdef",)))
        .when(m.rlike("^[0-9A-F]{32,}$"), permuted_text(m, key, "secret", ("0123456789ABCDEF",)))
        .when(whole(IBAN), _iban(m, key))
        .when(whole(IP), _ip(m, key))
        .when(m.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), _date(m, key, "yyyy-MM-dd"))
        .when(m.rlike("^[0-9]{2}/[0-9]{2}/[0-9]{4}$"), F.when(F.try_to_timestamp(m, F.lit("MM/dd/yyyy")).isNotNull(), _date(m, key, "MM/dd/yyyy")).otherwise(_late_date(m, key)))
        .when(m.rlike(r"^[0-9]{2}\.[0-9]{2}\.[0-9]{4}$"), _date(m, key, "dd.MM.yyyy"))
        .when(m.rlike("^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), _ssn(m, key))
        .when(whole(PHONE), _phone(m, key))
        .otherwise(_number_of(m, key))
    )


def pseudonymize(docs: DataFrame, key: str, column: str = "text") -> DataFrame:
    """docs with the values in column replaced under the secret key, and n_values, how many were found in it by their form, valid or not.

    A null text stays null with 0 values, an empty one empty. Rows are independent; very long texts are cut at their
    values only. Other columns stay as they are, but for one named n_values, which is replaced. Dates outside 1800 to
    2199, addresses with a number above 255, long numbers with a wrong Luhn sum and IBANs with wrong check digits are
    left alone. Dates with slashes are MM/dd/yyyy where they can be, else dd/MM/yyyy, and stay what they are.
    """
    t = F.col(column)
    some = F.coalesce(t.rlike(QUICK), F.lit(False))
    found = F.when(some, F.regexp_extract_all(t, F.lit(ANY), F.lit(0)))
    d = docs.select(F.struct(*docs.columns).alias("doc"), t.alias("t"), found.alias("found"))
    new = F.transform("found", lambda m: pseudonym(m, key))
    parts = F.zip_with(F.split("t", ANY, -1), new, lambda gap, m: F.concat(gap, F.coalesce(m, F.lit(""))))
    hit = F.coalesce(F.size("found") > 0, F.lit(False))
    text = F.when(hit, F.array_join(parts, "")).otherwise(F.col("t"))
    n = F.when(hit, F.size("found")).otherwise(0).cast("long")
    return d.select(*[text.alias(c) if c == column else F.col(f"doc.`{c}`") for c in docs.columns if c != "n_values"], n.alias("n_values"))
