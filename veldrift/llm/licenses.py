"""License scans with ordered signature rules, in DataFrame functions only.

A rule is a regex over the text's words (lower-cased A-Z, joined by one space), with a keyword, a label and a priority.
A text is searched for the keywords first, and only for the rules whose keyword and statement's literal it holds. The
words of such a text are numbered, so each match tells its interval of words and the work grows with the text alone. An
interval that lies inside another of the same or a higher priority is suppressed, and of equal intervals the later rule's
stays: rules go from general to specific names. No row leaves its partition.

Base phrases are found apart from the rules: every place where a phrase's words stand one after another.

Defined results: null text has no words, places or labels and score 0.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower

#: Between words: ASCII other than digits and lower-case letters (of lower-cased text).
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Base phrases and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Names of licenses as regexes over words, the keyword that each holds, the label.
NAMES = [
    ("mit", "mit", "mit"),
    ("expat", "expat", "mit"),
    ("x11", "x11", "x11"),
    ("apache", "apache(?: software)?", "apache"),
    ("apache", "apache(?: software)?(?: license)?(?: version)? 1(?: 0)?", "apache-1"),
    ("apache", "apache(?: software)?(?: license)?(?: version)? 1 1", "apache-1.1"),
    ("apache", "apache(?: software)?(?: license)?(?: version)? 2(?: 0)?", "apache-2"),
    ("gnu", "gnu general public", "gpl"),
    ("gnu", "gnu general public license(?: version)? 2(?: 0)?", "gpl-2"),
    ("gnu", "gnu general public license(?: version)? 3(?: 0)?", "gpl-3"),
    ("gpl", "gpl", "gpl"),
    ("gpl", "gpl ?v?2(?: 0)?", "gpl-2"),
    ("gpl", "gpl ?v?3(?: 0)?", "gpl-3"),
    ("gnu", "gnu (?:lesser|library) general public", "lgpl"),
    ("lgpl", "lgpl", "lgpl"),
    ("lgpl", "lgpl ?v?2 1", "lgpl-2.1"),
    ("lgpl", "lgpl ?v?3(?: 0)?", "lgpl-3"),
    ("gnu", "gnu affero general public", "agpl"),
    ("agpl", "agpl ?v?3?(?: 0)?", "agpl-3"),
    ("gnu", "gnu free documentation", "gfdl"),
    ("gfdl", "gfdl", "gfdl"),
    ("bsd", "bsd", "bsd"),
    ("bsd", "(?:0|zero) clause bsd", "0bsd"),
    ("bsd", "(?:2|two) clause bsd|bsd (?:2|two) clause|simplified bsd", "bsd-2-clause"),
    ("bsd", "(?:3|three) clause bsd|bsd (?:3|three) clause|(?:new|modified|revised) bsd", "bsd-3-clause"),
    ("bsd", "(?:4|four) clause bsd|bsd (?:4|four) clause|original bsd", "bsd-4-clause"),
    ("isc", "isc", "isc"),
    ("zlib", "zlib(?: libpng)?", "zlib"),
    ("libpng", "libpng", "libpng"),
    ("mozilla", "mozilla public", "mpl"),
    ("mozilla", "mozilla public license(?: version)? 1 1", "mpl-1.1"),
    ("mozilla", "mozilla public license(?: version)? 2(?: 0)?", "mpl-2"),
    ("mpl", "mpl(?: v?2(?: 0)?)?", "mpl-2"),
    ("eclipse", "eclipse public", "epl"),
    ("eclipse", "eclipse public license(?: version)? 2(?: 0)?", "epl-2"),
    ("eclipse", "eclipse distribution", "bsd-3-clause"),
    ("cddl", "cddl", "cddl"),
    ("common", "common development and distribution", "cddl"),
    ("common", "common public", "cpl"),
    ("ibm", "ibm public", "ipl"),
    ("artistic", "artistic", "artistic"),
    ("artistic", "artistic license(?: version)? 2(?: 0)?", "artistic-2"),
    ("perl", "same terms as perl(?: itself)?", "artistic"),
    ("python", "python(?: software foundation)?", "psf-2"),
    ("psf", "psf", "psf-2"),
    ("ruby", "ruby", "ruby"),
    ("php", "php", "php"),
    ("zend", "zend engine", "zend"),
    ("boost", "boost software", "bsl"),
    ("unlicense", "(?:the )?unlicense", "unlicense"),
    ("wtfpl", "wtfpl", "wtfpl"),
    ("openssl", "openssl", "openssl"),
    ("postgresql", "postgresql", "postgresql"),
    ("vim", "vim", "vim"),
    ("sleepycat", "sleepycat", "sleepycat"),
    ("beerware", "beerware", "beerware"),
    ("curl", "curl", "curl"),
    ("universal", "universal permissive", "upl"),
    ("microsoft", "microsoft public", "ms-pl"),
    ("microsoft", "microsoft reciprocal", "ms-rl"),
    ("european", "european union public", "eupl"),
    ("eupl", "eupl", "eupl"),
    ("academic", "academic free", "afl"),
    ("open", "open software", "osl"),
    ("open", "open database", "odbl"),
    ("open", "open data commons attribution", "odc-by"),
    ("open", "open data commons public domain", "pddl"),
    ("sil", "sil open font", "ofl"),
    ("ofl", "ofl", "ofl"),
    ("cecill", "cecill(?: b| c)?", "cecill"),
    ("mulan", "mulan psl", "mulan-psl-2"),
    ("server", "server side public", "sspl"),
    ("elastic", "elastic", "elastic"),
    ("business", "business source", "busl"),
    ("commons", "commons clause", "commons-clause"),
    ("creative", "creative commons", "cc"),
    ("creative", "creative commons attribution", "cc-by"),
    ("creative", "creative commons attribution share ?alike", "cc-by-sa"),
    ("creative", "creative commons attribution no ?deriv(?:ative)?s?", "cc-by-nd"),
    ("creative", "creative commons attribution non ?commercial", "cc-by-nc"),
    ("creative", "creative commons attribution non ?commercial share ?alike", "cc-by-nc-sa"),
    ("creative", "creative commons attribution non ?commercial no ?deriv(?:ative)?s?", "cc-by-nc-nd"),
    ("creative", "creative commons zero", "cc0"),
    ("cc0", "cc0", "cc0"),
    ("cc", "cc by", "cc-by"),
    ("cc", "cc by sa", "cc-by-sa"),
    ("cc", "cc by nd", "cc-by-nd"),
    ("cc", "cc by nc", "cc-by-nc"),
    ("cc", "cc by nc sa", "cc-by-nc-sa"),
    ("cc", "cc by nc nd", "cc-by-nc-nd"),
]

#: How a license is stated around its name; priority and confidence of such a statement, and what each holds.
STATEMENTS = [
    (3, 1.0, "spdx license identifier ", r"spdx license identifier (?:{})(?: or later| only)?"),
    (2, 0.9, " under ", r"(?:licensed|released|distributed|available|published|provided|covered) under (?:the )?(?:terms of the )?(?:{})(?: (?:public )?licen[cs]e)?(?: (?:version |v)?[0-9](?: [0-9])?)?(?: international)?"),
    (1, 0.7, " licen", r"(?:{})(?: public)? licen[cs]e(?: (?:version |v)?[0-9](?: [0-9])?)?"),
]

#: Rules that name no license by a statement: keyword, regex, label, priority, confidence.
CLAUSES = [
    ("permission", "permission is hereby granted free of charge to any person obtaining a copy of this software", "mit", 2, 0.9),
    ("redistribution", "redistribution and use in source and binary forms with or without modification are permitted", "bsd", 2, 0.8),
    ("contributors", "neither the name of .{1,80} nor the names of its contributors", "bsd-3-clause", 2, 0.8),
    ("advertising", "all advertising materials mentioning features or use of this software", "bsd-4-clause", 2, 0.8),
    ("permission", "permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee", "isc", 2, 0.9),
    ("altered", "altered source versions must be plainly marked as such", "zlib", 2, 0.8),
    ("unencumbered", "this is free and unencumbered software released into the public domain", "unlicense", 2, 1.0),
    ("domain", "(?:dedicated|released|placed) (?:in)?to the public domain", "public-domain", 1, 0.6),
    ("rights", "all rights reserved", "proprietary", 1, 0.3),
    ("proprietary", "proprietary and confidential", "proprietary", 2, 0.8),
    ("unlicensed", "unlicensed", "proprietary", 1, 0.3),
]


@dataclass(frozen=True)
class Rule:
    keyword: str
    pattern: str
    label: str
    priority: int
    confidence: float
    also: str = ""


def rules() -> list[Rule]:
    """All rules in order: the statements of every name, then the clauses."""
    out = [Rule(k, s.format(name), label, p, c, also) for p, c, also, s in STATEMENTS for k, name, label in NAMES]
    return out + [Rule(*c) for c in CLAUSES]


def _words(text: Column) -> Column:
    """Number of words in joined words."""
    text = F.trim(text)
    return F.when(text == "", 0).otherwise(F.octet_length(text) - F.octet_length(F.replace(text, F.lit(" "), F.lit(""))) + 1)


def _at_words(pattern: str) -> str:
    return rf"(?<=^| )(?:{pattern})(?= |$)"


def numbered(pattern: str) -> str:
    """A rule's regex for words that each follow their number and a colon, which no word holds."""
    spaced = pattern.replace(".{", "(?:[^ ]| ){").replace(" ?", "(?: )?")
    inner = spaced.replace("[^ ]", "\0").replace(" ", " [0-9]++:").replace("\0", "[^ ]")
    return rf"(?<![^ ])[0-9]++:(?:{inner})(?![^ ])"


def _intervals(text: Column, pattern: Column) -> Column:
    """Matches of a regex in numbered words as structs of start and end (in words)."""
    return F.transform(
        F.regexp_extract_all(text, pattern, F.lit(0)),
        lambda m: F.struct(F.substring_index(m, ":", 1).cast("int").alias("start"), (F.regexp_extract(m, "([0-9]+):[^ ]*$", 1).cast("int") + 1).alias("end")),
    )


def scan(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score,
    detections (array of label, start, end, priority, confidence, kept or not)."""
    every = rules()
    keywords = sorted({k for r in every for k in (r.keyword, r.also)})
    listed_rules = [{"k": r.keyword, "also": r.also, "re": numbered(r.pattern), "label": r.label, "p": r.priority, "c": r.confidence, "order": -i} for i, r in enumerate(every)]
    # One literal: Spark reads it once when it plans.
    table = F.from_json(F.lit(json.dumps(listed_rules)), "array<struct<k:string,also:string,re:string,label:string,p:int,c:double,order:int>>")
    text = F.concat(F.lit(" "), F.regexp_replace(ascii_lower(F.coalesce("text", F.lit(""))), GAP, " "), F.lit(" "))
    d = docs.select("doc_id", text.alias("words")).withColumn("words", F.trim("words"))
    d = d.withColumn("n_words", _words(F.col("words")).cast("long"))
    words = F.col("words")

    places = {}
    for phrase in BASE:
        places[phrase] = F.when(words.contains(phrase), F.split(words, _at_words(phrase), -1))
    d = d.withColumns({f"at{i}": p for i, p in enumerate(places.values())})
    n, firsts, lasts, base = F.lit(0), [], [], []
    for i, (phrase, label) in enumerate(BASE.items()):
        parts = F.col(f"at{i}")
        count = F.coalesce(F.size(parts) - 1, F.lit(0))
        n = n + F.greatest(count, F.lit(0))
        some = F.size(parts) > 1
        firsts.append(F.when(some, _words(F.get(parts, F.lit(0)))))
        lasts.append(F.when(some, F.col("n_words") - _words(F.element_at(parts, -1)) - len(phrase.split())))
        base.append(F.when(some, F.lit(label)))
    d = d.withColumns({
        "n_base": n.cast("long"), "first_word": F.least(*firsts).cast("long"), "last_word": F.greatest(*lasts).cast("long"),
        "base": F.array_compact(F.array(*base)),
    })

    held = F.filter(F.array(*[F.lit(k) for k in keywords]), lambda k: words.contains(k))
    active = F.filter(table, lambda r: F.array_contains(F.col("held"), r["k"]) & F.array_contains(F.col("held"), r["also"]))
    d = d.withColumn("held", held).withColumn("active", F.when(F.size("held") > 0, active))
    by_number = F.array_join(F.transform(F.split(words, " "), lambda w, i: F.concat(i.cast("string"), F.lit(":"), w)), " ")
    # The text is numbered once, as the only element of an array, not once for each rule.
    hits = F.flatten(F.flatten(
        F.transform(
            F.array(by_number),
            lambda t: F.transform(
                "active",
                lambda r: F.transform(
                    _intervals(t, r["re"]),
                    lambda x: F.struct(x["start"].alias("start"), (-x["end"]).alias("back"), (-r["p"]).alias("low"), r["order"].alias("order"), r["label"].alias("label"), r["c"].alias("c")),
                ),
            ),
        )
    ))
    d = d.withColumn("hits", F.when(F.size("active") > 0, F.array_sort(hits)))
    none = F.array().cast("array<string>")
    start = F.struct(F.lit(-1).alias("e1"), F.lit(-1).alias("e2"), F.lit(-1).alias("e3"), none.alias("labels"), F.lit(1.0).alias("miss"))

    def step(acc: Column, x: Column) -> Column:
        # Hits come by start, longest first: one lies inside another if that one's end was as far already.
        end, p = -x["back"], -x["low"]
        inside = end <= F.when(p == 1, acc["e1"]).when(p == 2, acc["e2"]).otherwise(acc["e3"])
        far = lambda e, low: F.when(p >= low, F.greatest(e, end)).otherwise(e)
        return F.struct(
            far(acc["e1"], 1).alias("e1"), far(acc["e2"], 2).alias("e2"), far(acc["e3"], 3).alias("e3"),
            F.when(inside, acc["labels"]).otherwise(F.array_union(acc["labels"], F.array(x["label"]))).alias("labels"),
            F.when(inside, acc["miss"]).otherwise(F.least(acc["miss"], F.lit(1.0) - x["c"])).alias("miss"),
        )

    d = d.withColumn("found", F.when(F.size("hits") > 0, F.aggregate("hits", start, step)))
    score = F.when(F.size("base") > 0, F.lit(1.0)).otherwise(F.coalesce(F.lit(1.0) - F.col("found.miss"), F.lit(0.0)))
    listed = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    return d.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", listed(F.col("base")).alias("base_labels"),
        listed(F.concat("base", F.coalesce("found.labels", none))).alias("labels"), score.alias("score"),
        F.coalesce(F.transform("hits", lambda x: F.struct(x["label"].alias("label"), x["start"].alias("start"), (-x["back"]).alias("end"), (-x["low"]).alias("priority"))),
                   F.array().cast("array<struct<label:string,start:int,end:int,priority:int>>")).alias("detections"),
    )
