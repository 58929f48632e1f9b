"""Format-preserving pseudonyms for private values, with column functions only.

E-mail addresses, payment card numbers (Luhn-checked), IPv4 addresses, phone and social security numbers, access keys
and dates are found in whole texts. Each is permuted by a keyed Feistel network inside its format: a half's characters
move within their class (digit, lower, upper) by an amount keyed by the other half, so equal values get equal
pseudonyms in every document and different ones never meet. Only digits of cards and phones move and separators are put back; a social security number is permuted among the
numbers that can be one, and a date as a day, so a value stays linked however it is written. Cards get a new check digit,
addresses move within 32 bits, dates within the 72,800 days from 1900-01-01 and all others from year 1 to 9999 among
themselves, both parts of e-mail addresses but the last label. Who has the key can undo all of it (`undo`). The key stands
in the plan, so name it in spark.redaction.regex where plans and event logs are read by others.

Values that fail their check stay: octets over 255 or with leading zeros, no such day, numbers that no social security
number has. Dates are ISO, day/month/year, or day, English month and year. Null text stays null, with nothing found. Rows
are independent: repeated rows and other columns change nothing; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS, ACROSS, DOWN = 4, 280, 260
AREAS, REST = 898, 99 * 9999  # of social security numbers: 001 to 899 without 666; groups and serials without those of zeros
BEFORE = -693_595  # the first day of year 1, from 1900-01-01
NEAR_DAYS, FAR_DAYS = ACROSS * DOWN, 3_652_059 - ACROSS * DOWN  # days from 1900-01-01; all other days of the years 1 to 9999
FAR_ACROSS, FAR_DOWN = 1004, 3565  # their product is FAR_DAYS or 1 more
# The formats.
KINDS = {
    "email": r"[A-Za-z0-9_%+\-][A-Za-z0-9._%+\-]*@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)+",
    "date": r"(?<![0-9\-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9\-])",
    "slash": r"(?<![0-9/])[0-9]{2}/[0-9]{2}/[0-9]{4}(?![0-9/])",
    "written": r"(?<![0-9])[0-9]{1,2} (?:January|February|March|April|May|June|July|August|September|October|November|December) [0-9]{4}(?![0-9])",
    "ipv4": r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?!\.?[0-9])",
    "ssn": r"(?<![0-9\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9\-])",
    "phone": r"(?:\+[0-9]{1,3}[ .\-]?)?(?:\([0-9]{3}\) ?|(?<![0-9])[0-9]{3}[ .\-])[0-9]{3}[.\-][0-9]{4}(?![0-9])",
    "card": r"(?<![0-9])(?:[0-9]{4}(?:[ \-][0-9]{4}){3}|[0-9]{4}[ \-][0-9]{6}[ \-][0-9]{5}|[0-9]{13,19})(?![0-9])",
    "key": r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])",
}
DAYS = {"date": "yyyy-MM-dd", "slash": "dd/MM/yyyy", "written": "d MMMM yyyy"}
ANY = "|".join(KINDS.values())


def _number(key: Column, round_: Column, half: Column, at: Column | None = None) -> Column:
    digest = F.sha2(F.concat_ws("/", key, round_.cast("string"), half.cast("string"), (F.floor(at / 8) if at is not None else F.lit(0)).cast("string")), 256)
    place = (F.pmod(at, F.lit(8)) * 8 + 1) if at is not None else F.lit(1)
    return F.conv(F.substring(digest, place.cast("int"), F.lit(7)), 16, 10).cast("long")


def _moved(chars: Column, by) -> Column:
    def one(c: Column, i: Column) -> Column:
        shift = lambda low, n: F.char(F.lit(low) + F.pmod(F.ascii(c) - low + by(i), F.lit(n)))
        return F.when(c.between("0", "9"), shift(48, 10)).when(c.between("a", "z"), shift(97, 26)).when(c.between("A", "Z"), shift(65, 26)).otherwise(c)

    return F.transform(chars, one)


def _rounds(undo: bool) -> Column:
    return F.sequence(F.lit(ROUNDS - 1), F.lit(0)) if undo else F.sequence(F.lit(0), F.lit(ROUNDS - 1))


def feistel_text(value: Column, key: Column, undo: bool = False) -> Column:
    """A permutation of the strings of value's format: characters keep their class and place. undo is its inverse."""
    chars = F.split(value, "")
    cut = F.floor(F.length(value) / 2).cast("int")
    start = F.struct(F.slice(chars, F.lit(1), cut).alias("l"), F.slice(chars, cut + 1, F.length(value)).alias("r"))
    sign = -1 if undo else 1

    def step(s: Column, i: Column) -> Column:
        even = i % 2 == 0
        other = F.array_join(F.when(even, s["r"]).otherwise(s["l"]), "")
        move = lambda half: _moved(half, lambda at: sign * _number(key, i, other, at))
        return F.struct(F.when(even, move(s["l"])).otherwise(s["l"]).alias("l"), F.when(even, s["r"]).otherwise(move(s["r"])).alias("r"))

    return F.aggregate(_rounds(undo), start, step, lambda s: F.array_join(F.concat(s["l"], s["r"]), ""))


def feistel_pair(left: Column, right: Column, a: int, b: int, key: Column, undo: bool = False) -> Column:
    """A permutation of the pairs below (a, b), as struct l, r of longs. undo is its inverse."""
    sign = -1 if undo else 1

    def step(s: Column, i: Column) -> Column:
        even = i % 2 == 0
        l = F.when(even, F.pmod(s["l"] + sign * _number(key, i, s["r"]), F.lit(a))).otherwise(s["l"])
        r = F.when(even, s["r"]).otherwise(F.pmod(s["r"] + sign * _number(key, i, s["l"]), F.lit(b)))
        return F.struct(l.cast("long").alias("l"), r.cast("long").alias("r"))

    return F.aggregate(_rounds(undo), F.struct(left.cast("long").alias("l"), right.cast("long").alias("r")), step)


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def refilled(value: Column, digits: Column) -> Column:
    """value with its digits, in order, replaced by others; all else stays."""
    nth = lambda i: F.length(digits_of(F.substring(value, F.lit(1), i + 1)))
    return F.array_join(F.transform(F.split(value, ""), lambda c, i: F.when(c.between("0", "9"), F.substring(digits, nth(i), F.lit(1))).otherwise(c)), "")


def luhn_sum(digits: Column, doubled: int) -> Column:
    """The Luhn sum of a string of digits; from the right, places i with i % 2 == doubled are doubled."""
    each = F.transform(F.reverse(F.split(digits, "")), lambda c, i: F.when(i % 2 == doubled, F.when(c.cast("int") > 4, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2)).otherwise(c.cast("int")))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x)


def day_of(value: Column, kind: str) -> Column:
    """Days since 1900-01-01, from year 1 to 9999; null for no day, or one that is written otherwise in this format."""
    day = F.try_to_timestamp(value, F.lit(DAYS[kind])).cast("date")
    return F.when(F.date_format(day, DAYS[kind]) == value, F.datediff(day, F.lit("1900-01-01").cast("date")))


def kind_of(value: Column) -> Column:
    """The kind of a matched value, null if it fails its check."""
    whole = lambda kind: value.rlike(f"^(?:{KINDS[kind]})$")
    out = F.when(F.contains(value, F.lit("@")), F.lit("email"))
    for kind in DAYS:
        out = out.when(whole(kind), F.when(day_of(value, kind).between(BEFORE, FAR_DAYS + NEAR_DAYS + BEFORE - 1), F.lit(kind)))
    return (
        out.when(whole("ipv4"), F.when(F.forall(F.split(value, r"\."), lambda o: (o.cast("int") <= 255) & (o.cast("int").cast("string") == o)), F.lit("ipv4")))
        .when(whole("ssn"), F.when(~value.rlike("^(?:000|666|9)|-00-|-0000$"), F.lit("ssn")))
        .when(whole("phone"), F.lit("phone"))
        .when(whole("card"), F.when(luhn_sum(F.translate(value, " -", ""), 1) % 10 == 0, F.lit("card")))
        .when(whole("key"), F.lit("key"))
    )


def moved_day(day: Column, key: Column, undo: bool) -> Column:
    """A permutation of the days of the years 1 to 9999: of the near ones, and of the far ones.

    The far days are FAR_DAYS numbers, the pairs that are permuted a few more: a number that falls on one of those few is
    permuted again, which ends within as many steps and is undone the same way.
    """
    near = feistel_pair(F.floor(day / DOWN), F.pmod(day, F.lit(DOWN)), ACROSS, DOWN, F.concat(key, F.lit("date")), undo)
    at = F.when(day < 0, day - BEFORE).otherwise(day - NEAR_DAYS - BEFORE).cast("long")
    step = lambda n: F.transform(F.array(feistel_pair(F.floor(n / FAR_DOWN), F.pmod(n, F.lit(FAR_DOWN)), FAR_ACROSS, FAR_DOWN, F.concat(key, F.lit("far")), undo)), lambda s: s["l"] * FAR_DOWN + s["r"])[0]
    again = F.sequence(F.lit(1), F.lit(FAR_ACROSS * FAR_DOWN - FAR_DAYS + 1))
    far = F.aggregate(again, F.struct(at.alias("n"), F.lit(False).alias("done")), lambda s, _: F.transform(F.array(F.when(s["done"], s["n"]).otherwise(step(s["n"]))), lambda n: F.struct(n.alias("n"), (n < FAR_DAYS).alias("done")))[0])["n"]
    far = F.transform(F.array(far), lambda n: F.when(n < -BEFORE, n + BEFORE).otherwise(n + NEAR_DAYS + BEFORE))[0]
    return F.when(day.between(0, NEAR_DAYS - 1), F.transform(F.array(near), lambda s: s["l"] * DOWN + s["r"])[0]).otherwise(far).cast("int")


def moved_ssn(digits: Column, key: Column, undo: bool) -> Column:
    """A permutation of the numbers that can be social security numbers."""
    part = lambda at, n: F.substring(digits, at, n).cast("long")
    area = part(1, 3) - F.when(part(1, 3) > 666, 2).otherwise(1)
    rest = (part(4, 2) - 1) * 9999 + part(6, 4) - 1
    place = lambda x, n: F.lpad(x.cast("string"), n, "0")
    back = lambda s: F.concat(place(s["l"] + F.when(s["l"] >= 665, 2).otherwise(1), 3), place(F.floor(s["r"] / 9999) + 1, 2), place(s["r"] % 9999 + 1, 4))
    return F.transform(F.array(feistel_pair(area, rest, AREAS, REST, F.concat(key, F.lit("ssn")), undo)), back)[0]


def pseudonym(value: Column, kind: Column, secret: Column, undo: bool = False) -> Column:
    """The pseudonym of a value of a kind; undo gives the value of a pseudonym."""
    one = lambda x, f: F.transform(F.array(x), f)[0]  # noqa: E731  x is worked out once
    text = lambda x, name: feistel_text(x, F.concat(secret, F.lit(name)), undo)
    pair = lambda x, y, a, b, name: feistel_pair(x, y, a, b, F.concat(secret, F.lit(name)), undo)
    plain = digits_of(value)
    body = text(F.substring(plain, F.lit(1), F.length(plain) - 1), "card")
    card = one(body, lambda b: refilled(value, F.concat(b, F.pmod(-luhn_sum(b, 0), F.lit(10)).cast("string"))))
    octet = lambda i: F.split(value, r"\.")[i].cast("long")
    ip = one(pair(octet(0) * 256 + octet(1), octet(2) * 256 + octet(3), 65536, 65536, "ipv4"), lambda s: F.concat_ws(".", *[x.cast("long").cast("string") for h in ("l", "r") for x in (F.floor(s[h] / 256), s[h] % 256)]))
    prefix = F.regexp_extract(value, r"^\+[0-9]{1,3}[ .\-]?", 0)
    rest = F.substring(value, F.length(prefix) + 1, F.length(value))
    phone = F.concat(prefix, one(text(digits_of(rest), "phone"), lambda d: refilled(rest, d)))
    ssn = one(moved_ssn(plain, secret, undo), lambda d: refilled(value, d))
    name, host = F.substring_index(value, "@", 1), F.substring_index(value, "@", -1)
    label, last = F.regexp_extract(host, r"^(.*)\.[^.]*$", 1), F.regexp_extract(host, r"(\.[^.]*)$", 1)
    email = F.concat(text(name, "email"), F.lit("@"), text(label, "host"), last)
    access = F.concat(F.substring(value, 1, 4), text(F.substring(value, F.lit(5), F.length(value)), "key"))
    out = F.when(kind == "card", card).when(kind == "ipv4", ip).when(kind == "phone", phone).when(kind == "email", email).when(kind == "key", access).when(kind == "ssn", ssn)
    for name_, form in DAYS.items():
        day = one(day_of(value, name_), lambda d: moved_day(d, secret, undo))
        out = out.when(kind == name_, F.date_format(one(day, lambda d: F.date_add(F.lit("1900-01-01").cast("date"), d)), form))
    return out.otherwise(value)


def pseudonymised(docs: DataFrame, key: str, undo: bool = False) -> DataFrame:
    """doc_id, text (values replaced), n_found, kinds (sorted, with repeats). undo: texts with pseudonyms get their values back."""
    text, secret = F.col("text"), F.lit(key)
    found = F.when(text.rlike(ANY), F.regexp_extract_all(text, F.lit(f"({ANY})"), F.lit(0)))
    marked = docs.select("doc_id", "text", F.transform(found, lambda v: F.struct(v.alias("v"), kind_of(v).alias("k"))).alias("found"))
    gaps = F.split(text, ANY, -1)
    new = F.concat(F.transform("found", lambda x: pseudonym(x["v"], x["k"], secret, undo)), F.array(F.lit("")))
    whole = F.array_join(F.flatten(F.zip_with(gaps, new, lambda g, p: F.array(g, p))), "")
    kinds = F.array_sort(F.transform(F.filter("found", lambda x: x["k"].isNotNull()), lambda x: x["k"]))
    kinds = F.coalesce(kinds, F.array().cast("array<string>"))
    return marked.select("doc_id", F.when(F.col("found").isNull(), text).otherwise(whole).alias("text"), F.size(kinds).cast("long").alias("n_found"), kinds.alias("kinds"))
