"""The keyword gate of license scans changes no result."""

import dataclasses
import re
import time
from re import _constants as c
from re import _parser

import pytest

from veldrift.llm import licenses

from .cases import frame

VERBS = ("licensed", "released", "distributed", "available", "published", "provided", "covered")


def example(tokens, most):
    """A shortest or longest text that a pattern matches; of alternatives the first or the last."""
    out = ""
    for op, arg in tokens:
        if op is c.LITERAL:
            out += chr(arg)
        elif op is c.ANY:
            out += "x"
        elif op is c.IN:
            out += chr(arg[0][1] if arg[0][0] is c.LITERAL else arg[0][1][0])
        elif op is c.MAX_REPEAT:
            out += example(arg[2], most) * (min(arg[1], 2) if most else arg[0])
        elif op is c.SUBPATTERN:
            out += example(arg[3], most)
        else:
            assert op is c.BRANCH
            out += example(arg[1][-1 if most else 0], most)
    return out


def texts():
    out = []
    for r in licenses.rules():
        for most in (False, True):
            out.append(example(_parser.parse(r.pattern), most))
            assert re.fullmatch(r.pattern, out[-1])
    return out + [f"this is {v} under {tail}" for v in VERBS for tail in ("mit", "the terms of the bsd 3 clause", "apache 2 0", "creative commons attribution", "the unlicense")]


def test_every_rule_holds_its_keywords():
    for r in licenses.rules():
        for most in (False, True):
            text = example(_parser.parse(r.pattern), most)
            assert r.keyword in text and r.also in text


def test_gated_results_equal_ungated(spark, monkeypatch):
    some = sorted(set(texts()))
    rows = [(i, t, "en", "s", 0, "c", 1, "v", 1) for i, t in enumerate(some)]
    gated = {r.doc_id: r for r in licenses.scan(frame(spark, rows)).collect()}
    assert all(r.labels for r in gated.values())
    every = licenses.rules()
    monkeypatch.setattr(licenses, "rules", lambda: [dataclasses.replace(r, keyword="", also="") for r in every])
    assert {r.doc_id: r for r in licenses.scan(frame(spark, rows)).collect()} == gated


@pytest.mark.parametrize("verb", VERBS)
def test_each_verb_is_found(spark, verb):
    rows = [(1, f"this library is {verb} under mit", "en", "s", 0, "c", 1, "v", 1)]
    assert licenses.scan(frame(spark, rows)).first().labels == "mit"


def test_a_long_text_of_statements_takes_time_in_proportion(spark):
    one = "Licensed under the GNU General Public License, version 3. Released under the MIT License. CC BY-NC 4.0; bsd license. "
    took = []
    for n in (1, 1000, 4000):
        began = time.time()
        r = licenses.scan(frame(spark, [(1, one * n, "en", "s", 0, "c", 1, "v", 1)])).collect()[0]
        took.append(time.time() - began)
        assert (r.n_base, r.labels, len(r.detections) % n) == (2 * n, "bsd,cc-by-nc,gpl-3,mit", 0)
    assert took[2] < 10 * took[1]
