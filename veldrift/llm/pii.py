"""PII: format-preserving pseudonyms by a keyed Feistel permutation, in DataFrame functions only.

Found values are validated (Luhn digit, octets, calendar, issued ranges) and permuted within their format: a card stays a
card of the same leading digit with a right check digit, an SSN one that could be issued, a date a date, an address an
address. Each permutation is of the set of valid values itself, so every pseudonym passes the validation that its value
passed. It depends on the caller's key and the value alone (rounds are SHA-256), so equal values stay linked across
documents, whatever their separators; dates month first are permuted among those of a day over 12. E-mail names and secrets, which are not numbers, become keyed digests. Values that
fail validation stay as they are.

Found are e-mail addresses, secrets after a name such as ``token =``, IPv4 addresses, dates from 1900-01-01 to 2099-12-31
(2020-12-25, 25/12/2020, or 12/25/2020 where no such day and month exist the other way round), phone numbers with a
country code or in the form of North America, SSNs, and cards. Not found: IPv6 addresses, other dates, names, addresses.

Defined results: null text stays null with counts 0; an empty table gives no rows; repeated rows are repeated; a value of
any length is replaced whole, and no text is too long, since no pattern backtracks over an unbounded part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "secret", "ip", "date", "phone", "ssn", "card")
NAME = r"\p{L}\p{N}._%+\-"
#: What each kind looks like, in order of preference at a place.
LOOKS = {
    "email": rf"(?<![{NAME}])[{NAME}]++@[A-Za-z0-9\-]++(?:\.[A-Za-z0-9\-]++)++",
    "secret": r"(?i:token|secret|api[_ -]?key|password|passwd)\s{0,3}[=:]\s{0,3}[\x22\x27]?[A-Za-z0-9_\-/+]{16,}+",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\.?[0-9])",
    "date": r"(?<![0-9\-/])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4})(?![0-9\-/])",
    "phone": r"\+[0-9]{1,3}[ \-]?\([0-9]{2,4}\)[ \-]?[0-9]{3}[ \-]?[0-9]{4}(?![0-9])|(?<![0-9])\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}(?![0-9])|\+[0-9]{1,3}(?:[ \-][0-9]{2,4}){3,4}(?![0-9])|(?<![0-9\-])[0-9]{3}-[0-9]{3}-[0-9]{4}(?![0-9\-])|(?<![\p{L}\p{N}+])\+[1-9][0-9]{7,14}(?![0-9])",
    "ssn": r"(?<![0-9\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9\-])",
    "card": r"(?<![0-9])[0-9](?:[ \-]?[0-9]){12,18}(?![0-9])",
}
PATTERN = "|".join(LOOKS.values())
#: What a text must hold for a kind to be found in it.
NEEDS = {"email": "@", "secret": "[=:]"} | dict.fromkeys(("ip", "date", "phone", "ssn", "card"), "[0-9]")
#: Country codes, which only their first digits tell apart in unseparated numbers.
COUNTRY = r"\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"
ROUNDS = 8
#: Dates from 1900-01-01 to 2099-12-31, as 17 x 4297 days.
DAYS = (17, 4297)
#: Permutations of a date read month first until its day is over 12; that 100 do not do has a chance of 1 in 10 ** 40.
WALK = 100
#: SSNs that could be issued, as areas (001 to 899 without 666) x groups 01 to 99 and serials 0001 to 9999.
SSNS = (898, 99 * 9999)


def _power(n: Column) -> Column:
    return F.element_at(F.array(*[F.lit(10**k) for k in range(11)]), n + 1)


def feistel(left: Column, right: Column, left_size: Column, right_size: Column, key: str) -> Column:
    """Permute the pair (left < left_size, right < right_size): each half in turn is shifted by a keyed hash of the
    other, modulo its size. The result is a struct of a and b."""
    start = F.struct(left.cast("long").alias("a"), right.cast("long").alias("b"))

    def shift(i: Column, x: Column, size: Column) -> Column:
        digest = F.sha2(F.concat(F.lit(f"{key}/"), i.cast("string"), F.lit("/"), x.cast("string")), 256)
        return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long") % size

    def step(acc: Column, i: Column) -> Column:
        even = i % 2 == 0
        return F.struct(
            F.when(even, (acc["a"] + shift(i, acc["b"], left_size)) % left_size).otherwise(acc["a"]).cast("long").alias("a"),
            F.when(even, acc["b"]).otherwise((acc["b"] + shift(i, acc["a"], right_size)) % right_size).cast("long").alias("b"),
        )

    return F.aggregate(F.array(*[F.lit(i) for i in range(ROUNDS)]), start, step)


def permute_digits(digits: Column, key: str) -> Column:
    """A string of 2 to 20 digits to another of the same length, one to one."""
    u = F.floor(F.length(digits) / 2).cast("int")
    v = F.length(digits) - u
    pair = feistel(F.substring(digits, F.lit(1), u), F.substring(digits, u + 1, v), _power(u), _power(v), key)
    return F.transform(
        F.array(F.struct(pair.alias("p"), u.alias("u"), v.alias("v"))),
        lambda x: F.concat(F.lpad(x["p"]["a"].cast("string"), x["u"], F.lit("0")), F.lpad(x["p"]["b"].cast("string"), x["v"], F.lit("0"))),
    )[0]


def _chars(text: Column) -> Column:
    return F.split(text, "")


def luhn_sum(digits: Column) -> Column:
    """Sum of Luhn's digits, the last digit counting once."""
    turned = F.transform(_chars(F.reverse(digits)), lambda c, i: F.struct(c.cast("int").alias("d"), (i % 2).alias("odd")))
    each = lambda x: F.when(x["odd"] == 0, x["d"]).when(x["d"] > 4, 2 * x["d"] - 9).otherwise(2 * x["d"])
    return F.aggregate(turned, F.lit(0), lambda acc, x: acc + each(x))


def _refill(template: Column, digits: Column) -> Column:
    """The template with its digits replaced, in order, by ``digits``."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("k"))
    return F.aggregate(
        _chars(template),
        start,
        lambda acc, c: F.struct(
            F.concat(acc["out"], F.when(c.rlike("^[0-9]$"), F.substring(digits, acc["k"], F.lit(1))).otherwise(c)).alias("out"),
            (acc["k"] + F.when(c.rlike("^[0-9]$"), 1).otherwise(0)).alias("k"),
        ),
        lambda acc: acc["out"],
    )


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.transform(F.array(value), use)[0]


#: Forms of dates; of those with slashes the first that gives a day counts.
DATES = ("yyyy-MM-dd", "dd/MM/yyyy", "MM/dd/yyyy")


def _date(m: Column, form: str) -> Column:
    return F.try_to_timestamp(m, F.lit(form)).cast("date")


def kind_of(m: Column) -> Column:
    """The kind of a found value that passes validation, else null."""
    looks = lambda k: m.rlike(rf"^(?:{LOOKS[k]})$")
    octets = F.forall(F.split(m, r"\."), lambda o: F.try_to_number(F.lpad(o, 3, "0"), F.lit("999")) <= 255)
    date = F.coalesce(*[_date(m, f) for f in DATES])
    day = F.datediff(date, F.lit("1900-01-01").cast("date"))
    return (
        F.when(looks("email"), "email")
        .when(looks("secret"), "secret")
        .when(looks("ip"), F.when(octets, F.lit("ip")))
        .when(looks("date"), F.when(day.between(0, DAYS[0] * DAYS[1] - 1), F.lit("date")))
        .when(looks("phone"), "phone")
        .when(looks("ssn"), F.when(~m.rlike("^(000|666|9..)|-00-|-0000$"), F.lit("ssn")))
        .when(looks("card"), _let(_digits(m), lambda d: F.when((luhn_sum(d) % 10 == 0) & ~d.startswith("0"), F.lit("card"))))
    )


def pseudonym(m: Column, kind: Column, key: str) -> Column:
    """The value that stands for a found value of a kind; null kind: the value itself."""
    email = F.concat(F.lit("u"), F.substring(F.sha2(F.concat(F.lit(key), F.lower(F.regexp_extract(m, "^([^@]+)@", 1))), 256), 1, 26), F.regexp_extract(m, "(@.*)$", 1))
    value = F.regexp_extract(m, r"([A-Za-z0-9_\-/+]+)$", 1)
    blocks = _let(
        F.sha2(value, 256),  # a long value is read once
        lambda v: F.transform(F.sequence(F.lit(0), F.floor(F.length(value) / 64).cast("int")), lambda i: F.sha2(F.concat(F.lit(f"{key}/"), i.cast("string"), F.lit("/"), v), 256)),
    )
    digest = F.array_join(blocks, "")
    secret = F.concat(F.substring(m, F.lit(1), F.length(m) - F.length(value)), F.substring(digest, F.lit(1), F.length(value)))
    octet = lambda i: F.split(m, r"\.")[i].cast("int")
    ip = _let(
        feistel(octet(0) * 256 + octet(1), octet(2) * 256 + octet(3), F.lit(65536), F.lit(65536), f"{key}/ip"),
        lambda p: F.concat_ws(".", F.floor(p["a"] / 256), p["a"] % 256, F.floor(p["b"] / 256), p["b"] % 256),
    )
    forms = [_date(m, f) for f in DATES]
    start = F.lit("1900-01-01").cast("date")
    swap = lambda n: _let(
        feistel(F.floor(n / DAYS[1]), n % DAYS[1], F.lit(DAYS[0]), F.lit(DAYS[1]), f"{key}/date"), lambda p: (p["a"] * DAYS[1] + p["b"]).cast("int")
    )
    # A date read month first is one of a day over 12, and so must its pseudonym be: permuted on until it is.
    legible = lambda n: forms[0].isNotNull() | forms[1].isNotNull() | (F.dayofmonth(F.date_add(start, n)) > 12)
    walk = lambda n: F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), n, lambda acc, _: F.when(legible(acc), acc).otherwise(swap(acc)))
    other = _let(_let(_let(F.datediff(F.coalesce(*forms), start), swap), walk), lambda n: F.date_add(start, n))
    day = _let(other, lambda x: F.coalesce(*[F.when(d.isNotNull(), F.date_format(x, f)) for d, f in zip(forms, DATES, strict=True)]))
    # The country code stays; the rest of a phone number is permuted.
    lead = F.when(m.rlike("^\\+[0-9]+$"), F.regexp_extract(m, f"^({COUNTRY})", 1)).otherwise(F.regexp_extract(m, r"^(\+[0-9]{1,3}[ \-]?|)", 1))
    rest = F.substring(m, F.length(lead) + 1, F.length(m))
    phone = F.concat(lead, _refill(rest, permute_digits(_digits(rest), f"{key}/phone")))
    area, rest9 = F.substring(_digits(m), 1, 3).cast("int"), F.substring(_digits(m), 4, 6).cast("int")
    ssn = _let(
        feistel(area - 1 - (area > 666).cast("int"), (F.floor(rest9 / 10000) - 1) * 9999 + rest9 % 10000 - 1, F.lit(SSNS[0]), F.lit(SSNS[1]), f"{key}/ssn"),
        lambda p: F.concat_ws("-", F.lpad((p["a"] + 1 + (p["a"] >= 665).cast("int")).cast("string"), 3, "0"),
                              F.lpad((F.floor(p["b"] / 9999) + 1).cast("string"), 2, "0"), F.lpad((p["b"] % 9999 + 1).cast("string"), 4, "0")),
    )
    card = _let(
        _let(_digits(m), lambda d: F.concat(F.substring(d, 1, 1), permute_digits(F.substring(d, F.lit(2), F.length(d) - 2), f"{key}/card"))),
        lambda d: _refill(m, F.concat(d, ((10 - luhn_sum(F.concat(d, F.lit("0"))) % 10) % 10).cast("string"))),
    )
    return (
        F.when(kind.isNull(), m).when(kind == "email", email).when(kind == "secret", secret).when(kind == "ip", ip)
        .when(kind == "date", day).when(kind == "phone", phone).when(kind == "ssn", ssn).otherwise(card)
    )


def _pattern(text: Column) -> Column:
    """The kinds' regexes joined, without those that a text cannot match; empty if it can match none."""
    needs = {need: [LOOKS[k] for k in KINDS if NEEDS[k] == need] for need in dict.fromkeys(NEEDS.values())}
    return F.concat_ws("|", *[F.when(text.rlike(need), F.lit("|".join(looks))) for need, looks in needs.items()])


def replaced(text: Column, pattern: Column, key: str) -> Column:
    """Struct of the new text and the kinds of the values replaced, in order."""
    found = F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), lambda m: F.struct(m.alias("m"), kind_of(m).alias("kind")))
    fresh = F.transform(found, lambda x: F.struct(pseudonym(x["m"], x["kind"], key).alias("new"), x["kind"].alias("kind")))
    parts = F.struct(F.split(text, pattern, -1).alias("gaps"), fresh.alias("fresh"))
    return _let(
        parts,
        lambda p: F.struct(
            F.array_join(F.transform(p["gaps"], lambda g, i: F.concat(g, F.coalesce(F.get(p["fresh"], i)["new"], F.lit("")))), "").alias("text"),
            F.filter(F.transform(p["fresh"], lambda x: x["kind"]), lambda k: k.isNotNull()).alias("kinds"),
        ),
    )


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """One row per row of ``docs``: doc_id, text with pseudonyms, n_<kind> for each kind, and n_found.

    ``key``: the secret that makes pseudonyms; who holds it can undo those of numbers and dates.
    """
    d = docs.select("doc_id", "text", _pattern(F.col("text")).alias("pattern"))
    r = F.when((F.col("pattern") != "") & F.rlike("text", F.col("pattern")), replaced(F.col("text"), F.col("pattern"), key))
    d = d.select("doc_id", "text", r.alias("r"))
    count = lambda k: F.coalesce(F.size(F.filter("r.kinds", lambda x: x == k)), F.lit(0))
    counts = [F.greatest(count(k), F.lit(0)).cast("long").alias(f"n_{k}") for k in KINDS]
    return d.select("doc_id", F.coalesce("r.text", "text").alias("text"), *counts).withColumn("n_found", sum((F.col(f"n_{k}") for k in KINDS), F.lit(0).cast("long")))
