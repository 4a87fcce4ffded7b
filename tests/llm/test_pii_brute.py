"""Pseudonyms against a reference written with integers and ``hashlib``."""

import datetime
import hashlib
import re

import regex
from pyspark.sql import functions as F

from veldrift.llm import pii

from .cases import SCHEMA, documents, frame

KEY = "a key"
START = datetime.date(1900, 1, 1)


def feistel(a, b, m, n, key):
    for i in range(8):
        h = lambda x: int(hashlib.sha256(f"{key}/{i}/{x}".encode()).hexdigest()[:15], 16)  # noqa: B023, E731
        if i % 2 == 0:
            a = (a + h(b)) % m
        else:
            b = (b + h(a)) % n
    return a, b


def permuted(digits, key):
    u = len(digits) // 2
    v = len(digits) - u
    a, b = feistel(int(digits[:u]), int(digits[u:]), 10**u, 10**v, key)
    return f"{a:0{u}}{b:0{v}}"


def luhn(d):
    return sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(map(int, d[::-1])))


def refilled(template, digits):
    it = iter(digits)
    return re.sub("[0-9]", lambda _: next(it), template)


def day_of(m):
    for form in ("%Y-%m-%d", "%d/%m/%Y", "%m/%d/%Y"):
        try:
            return datetime.datetime.strptime(m, form).date(), form
        except ValueError:
            pass
    return None, None


def expected(m):
    """The kind and pseudonym of a found value, or None twice."""
    kind = next(k for k in pii.KINDS if regex.fullmatch(pii.LOOKS[k], m))
    digits = re.sub("[^0-9]", "", m)
    if kind == "email":
        name, at, host = m.partition("@")
        return kind, "u" + hashlib.sha256((KEY + name.lower()).encode()).hexdigest()[:26] + at + host
    if kind == "secret":
        value = re.search(r"[A-Za-z0-9_\-/+]+$", m)[0]
        once = hashlib.sha256(value.encode()).hexdigest()
        digest = "".join(hashlib.sha256(f"{KEY}/{i}/{once}".encode()).hexdigest() for i in range(len(value) // 64 + 1))
        return kind, m[: -len(value)] + digest[: len(value)]
    if kind == "ip":
        o = list(map(int, m.split(".")))
        if max(o) > 255:
            return None, None
        a, b = feistel(o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536, f"{KEY}/ip")
        return kind, f"{a // 256}.{a % 256}.{b // 256}.{b % 256}"
    if kind == "date":
        day, form = day_of(m)
        if day is None or not 0 <= (day - START).days < 73049:
            return None, None
        n, new = (day - START).days, None
        while new is None or (form == "%m/%d/%Y" and new.day <= 12):
            a, b = feistel(*divmod(n, 4297), 17, 4297, f"{KEY}/date")
            n = a * 4297 + b
            new = START + datetime.timedelta(n)
        return kind, new.strftime(form)
    if kind == "phone":
        lead = re.match(pii.COUNTRY, m)[0] if re.fullmatch(r"\+[0-9]+", m) else re.match(r"(\+[0-9]{1,3}[ \-]?|)", m)[0]
        return kind, lead + refilled(m[len(lead) :], permuted(re.sub("[^0-9]", "", m[len(lead) :]), f"{KEY}/phone"))
    if kind == "ssn":
        area, group, serial = map(int, m.split("-"))
        if area in (0, 666) or area >= 900 or not group or not serial:
            return None, None
        areas = [x for x in range(1, 900) if x != 666]
        a, b = feistel(areas.index(area), (group - 1) * 9999 + serial - 1, 898, 989901, f"{KEY}/ssn")
        return kind, f"{areas[a]:03}-{b // 9999 + 1:02}-{b % 9999 + 1:04}"
    if luhn(digits) % 10 or digits[0] == "0":
        return None, None
    body = digits[0] + permuted(digits[1:-1], f"{KEY}/card")
    return kind, refilled(m, body + str(-luhn(body + "0") % 10))


def reference(text):
    kinds = []

    def swap(found):
        kind, new = expected(found[0])
        kinds.extend([kind] if kind else [])
        return found[0] if kind is None else new

    return (None if text is None else regex.sub(pii.PATTERN, swap, text)), kinds


FORMS = [
    "4111 1111 1111 1111", "5500-0000-0000-0004", "340000000000009", "0000000000000000", "a.b@c.example.org.", "é@x.de", "a@b",
    "10.0.255.1", "256.1.1.1", "2021-02-29", "2020-02-29", "29/02/2020", "12/25/2020", "25/12/2020", "13/13/2020", "1899-12-31", "2099-12-31", "2100-01-01",
    "123-45-6789", "666-45-6789", "899-99-9999", "001-01-0001", "900-45-6789", "+49 (30) 1234567", "+49 30 1234 5678", "+442071838750", "555-123-4567", "(555) 123-4567",
    "password: hunter2hunter2hunter2", "api_key=" + "Az9" * 60, "x" * 50 + "@" + "y." * 40 + "z",
]


def test_every_text_equals_the_reference(spark):
    rows = documents() + [(7000 + i, f"<{v}> and {v}, {v}.\n{v}", "en", "s", 0, "c", 1, "v", 1) for i, v in enumerate(FORMS)]
    got = pii.pseudonymise(frame(spark, rows), KEY).collect()
    want = sorted(((r[0], *reference(r[1])) for r in rows), key=repr)
    counts = sorted(((r.doc_id, r.text, [k for k in pii.KINDS for _ in range(r[f"n_{k}"])], r.n_found) for r in got), key=lambda r: repr(r[:2]))
    assert [(i, t, k, len(k)) for i, t, k in ((i, t, sorted(k, key=pii.KINDS.index)) for i, t, k in want)] == counts
    assert {k for _, _, kinds in want for k in kinds} == set(pii.KINDS)
    assert pii.pseudonymise(spark.createDataFrame([], SCHEMA), KEY).count() == 0


def test_every_pseudonym_is_valid_again(spark):
    n = F.col("id")
    ssn = F.concat_ws("-", F.lpad((n * 37 % 999).cast("string"), 3, "0"), F.lpad((n * 7 % 100).cast("string"), 2, "0"), F.lpad((n * 61 % 10000).cast("string"), 4, "0"))
    body = F.lpad((n * 7919 + 10**14).cast("string"), 15, "4")
    card = F.concat(body, ((10 - pii.luhn_sum(F.concat(body, F.lit("0"))) % 10) % 10).cast("string"))
    day = F.date_format(F.date_add(F.lit("1900-01-01").cast("date"), (n * 3).cast("int")), "MM/dd/yyyy")
    d = spark.range(20_000).select(F.explode(F.array(ssn, card, day)).alias("m"))
    d = d.withColumn("kind", pii.kind_of(F.col("m"))).filter("kind is not null").withColumn("new", pii.pseudonym(F.col("m"), F.col("kind"), KEY))
    r = d.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum((pii.kind_of(F.col("new")) == F.col("kind")).cast("int")).alias("ok"), F.countDistinct("m").alias("a"), F.countDistinct("new").alias("b")).collect()
    assert {x.kind for x in r} == {"ssn", "card", "date"} and all(x.n == x.ok and x.a == x.b for x in r if x.kind != "date")
    assert all(x.n == x.ok for x in r)


def test_dates_are_one_to_one_as_strings(spark):
    """Every date in every form: no two strings get one pseudonym, and each is read in the form of its value."""
    day = F.date_add(F.lit("1900-01-01").cast("date"), F.col("id").cast("int"))
    d = spark.range(17 * 4297).select(F.explode(F.array(*[F.date_format(day, f) for f in pii.DATES])).alias("m")).distinct()
    d = d.withColumn("new", pii.pseudonym(F.col("m"), F.lit("date"), KEY))
    form = lambda c: F.when(F.col(c).contains("-"), 0).when(F.substring(c, 4, 2).cast("int") > 12, 2).otherwise(1)
    r = d.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("new").alias("new"), F.sum((form("m") == form("new")).cast("int")).alias("same")).first()
    assert r.n == r.new == r.same == 2 * 17 * 4297 + 44249


def test_long_texts_end(spark):
    long = ["a@" + "b." * 300_000, "a" * 500_000 + "@", "+1 " * 200_000, "1-" * 300_000, "token=" + "x" * 500_000, "." * 500_000 + "@x"]
    rows = [(i, t, "en", "s", 0, "c", 1, "v", 1) for i, t in enumerate(long)]
    got = {r.doc_id: r for r in pii.pseudonymise(frame(spark, rows), KEY).collect()}
    assert got[0].n_email == 1 and got[4].n_secret == 1 and len(got[4].text) == len(long[4])
    assert all(got[i].text == long[i] for i in (1, 2, 3))
