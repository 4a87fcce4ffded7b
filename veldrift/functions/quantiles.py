"""Exact order statistics of many columns at once, without a task that holds a column's values.

Every wanted rank has a range of values that holds it. One aggregation a round counts, for all of them, the rows below and
within the range and sketches the values within; the sketch's known error narrows the range about 5,000-fold. Once a range
holds at most ``EXACT`` rows the sketch is exact. So two rounds do for 25 million rows and four for 10 ** 14; each reads the
columns once, and no row is shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Accuracy of the sketches: ranks are right to a row in so many.
ACCURACY = 10_000
#: Rows of which a sketch is exact: its error is less than a rank.
EXACT = 5_000
#: Columns of a sketch in one aggregation.
AT_ONCE = 24
#: Rows whose values of a column one task may hold; more are refined.
ALONE = 1_000_000


@dataclass
class Range:
    """Values from ``low`` to ``high`` of a column hold the ranks ``first`` to ``last`` (from 1) among its non-null values."""

    column: int
    first: int
    last: int
    low: float | None = None
    high: float | None = None


def _is_number(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x)


def order_statistics(df: DataFrame, columns: list[Column], ranks: list[list[int]], accuracy: int = ACCURACY, exact: int = EXACT) -> list[dict[int, float]]:
    """For each column the values at its ``ranks`` (from 1, among its values that are neither null nor NaN)."""
    names = [f"_q{i}" for i in range(len(columns))]
    d = df.select(*[c.cast("double").alias(n) for c, n in zip(columns, names, strict=True)])
    return _narrowed(d, names, [Range(i, r, r) for i, wanted in enumerate(ranks) for r in sorted(set(wanted))], accuracy, exact)


def _narrowed(d: DataFrame, names: list[str], ranges: list[Range], accuracy: int, exact: int) -> list[dict[int, float]]:
    todo: list[Range] = []
    for t in ranges:  # neighbouring ranks share a range, if none has been found for them
        if todo and t.low is None and todo[-1].low is None and todo[-1].column == t.column and t.first - todo[-1].last <= 1:
            todo[-1].last = t.last
        else:
            todo.append(t)
    out: list[dict[int, float]] = [{} for _ in names]
    while todo:
        rest: list[Range] = []
        for k in range(0, len(todo), AT_ONCE):
            rest += _round(d, names, todo[k : k + AT_ONCE], out, accuracy, exact)
        todo = rest
    return out


def _round(d: DataFrame, names: list[str], todo: list[Range], out: list[dict[int, float]], accuracy: int, exact: int) -> list[Range]:
    """Narrow each range once; ranks found go to ``out``. Rows equal to an end of a range are counted apart, so a value
    that many rows share is found or left out, and every round leaves fewer values."""
    inner, counts = [], []
    for i, t in enumerate(todo):
        x = F.col(names[t.column])
        ends = [F.lit(False)] * 3 if t.low is None else [x < t.low, x == t.low, x == t.high]
        inner.append(_is_number(x) & (F.lit(True) if t.low is None else (x > t.low) & (x < t.high)))
        below, low, high = (F.sum((_is_number(x) & e).cast("long")) for e in ends)
        counts += [below.alias(f"b{i}"), low.alias(f"l{i}"), high.alias(f"h{i}"), F.sum(inner[-1].cast("long")).alias(f"n{i}")]
    seen = d.agg(*counts).first()
    sketches, asked = [], []
    for i, t in enumerate(todo):
        below, low, n = (seen[f"{c}{i}"] or 0 for c in "bln")
        inside = []
        for r in range(t.first, t.last + 1):
            if r <= below + low:
                out[t.column][r] = t.low
            elif r > below + low + n:
                out[t.column][r] = t.high
            else:
                inside.append(r)
        if inside:
            places = [r - below - low for r in inside]
            if n > exact:
                places = [places[0] - n / accuracy - 1, places[-1] + n / accuracy + 1]
            shares = F.array(*[F.lit(min(1.0, max(0.0, (p - 0.5) / n))) for p in places])
            sketches.append(F.percentile_approx(F.when(inner[i], F.col(names[t.column])), shares, F.lit(accuracy)).alias(f"p{i}"))
            asked.append((i, t, n, inside))
    if not asked:
        return []
    found, rest = d.agg(*sketches).first(), []
    for i, t, n, inside in asked:
        if n <= exact:
            out[t.column] |= dict(zip(inside, found[f"p{i}"], strict=True))
        else:
            rest.append(Range(t.column, inside[0], inside[-1], *found[f"p{i}"]))
    return rest


def percentiles(df: DataFrame, columns: list[Column], shares: list[float], accuracy: int = ACCURACY, exact: int = EXACT, alone: int = ALONE) -> list[list[float | None]]:
    """For each column the percentiles at ``shares``, between neighbouring values by a straight line; None without values.

    Up to ``alone`` rows the built-in percentile does the same in one pass. Beyond, the first round takes the numbers of values
    and one sketch for a column, which gives all of its first ranges."""
    names = [f"_q{i}" for i in range(len(columns))]
    d = df.select(*[F.when(_is_number(c.cast("double")), c.cast("double")).alias(n) for c, n in zip(columns, names, strict=True)])
    if d.limit(alone + 1).count() <= alone:
        row = d.agg(*[F.percentile(n, F.array(*[F.lit(s) for s in shares])).alias(n) for n in names]).first()
        return [row[n] or [None] * len(shares) for n in names]
    slack = 1 / accuracy + 3 / exact  # of the sketch, and of the two ranks beside a share
    around = F.array(*[F.lit(min(1.0, max(0.0, s + x))) for s in shares for x in (-slack, slack)])
    seen = d.agg(*[F.count(n).alias(f"n{n}") for n in names], *[F.percentile_approx(n, around, F.lit(accuracy)).alias(f"s{n}") for n in names]).first()
    ranges, places = [], []
    for i, name in enumerate(names):
        n = seen[f"n{name}"]
        at = [(n - 1) * s for s in shares] if n else []
        places.append(at)
        for k, p in enumerate(at):
            first, last = int(p) + 1, min(int(p) + 2, n)
            low, high = (None, None) if n <= exact else (seen[f"s{name}"][2 * k], seen[f"s{name}"][2 * k + 1])
            ranges.append(Range(i, first, last, low, high))
    found = _narrowed(d, names, sorted(ranges, key=lambda t: (t.column, t.first)), accuracy, exact)
    out: list[list[float | None]] = []
    for at, values in zip(places, found, strict=True):
        row: list[float | None] = []
        for p in at:
            low = values[int(p) + 1]
            high = values.get(int(p) + 2, low)
            row.append(low + (high - low) * (p - int(p)) if high != low else low)
        out.append(row or [None] * len(shares))
    return out
