"""Kelly stakes, bankroll growth and drawdown, ruin by simulation, and mean-variance weights."""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions.prefix import TreeSum, written

#: Fraction, least and largest stake, largest exposure.
FRACTION, LEAST, MOST, EXPOSURE = 0.10, 0.005, 0.03, 0.15


def kelly_pct(p: Column, odds: Column, confidence: Column, fraction: float = FRACTION) -> Column:
    """Share of the bankroll by fractional Kelly, by confidence, within the least and the largest; 0 without an edge."""
    b = odds - 1
    full = F.when(odds > 1, (p * b - (1 - p)) / b).otherwise(0.0)
    by = F.when(confidence == "ALTA", 1.0).when(confidence == "BAJA", 0.5).otherwise(0.85)
    return F.when(full > 0, F.greatest(F.lit(LEAST), F.least(F.lit(MOST), full * fraction * by))).otherwise(0.0)


def stakes(bets: DataFrame, bankroll: float, fraction: float = FRACTION) -> DataFrame:
    """Adds kelly_pct, kelly_stake and ev_per_unit; stakes shrink alike if they exceed the largest exposure."""
    p = F.coalesce(F.col("p_conservative"), F.col("p_model")) if "p_conservative" in bets.columns else F.col("p_model")
    pct = F.when(F.col("bet_signal"), kelly_pct(p, F.col("odds_market"), F.col("confidence"), fraction)).otherwise(0.0)
    d = bets.withColumn("kelly_pct", pct)
    total = d.agg((F.sum("kelly_pct") * bankroll).alias("_total"))  # one row
    scale = F.when(F.col("_total") > bankroll * EXPOSURE, bankroll * EXPOSURE / F.col("_total")).otherwise(1.0)
    d = d.crossJoin(F.broadcast(total)).withColumn("kelly_pct", F.col("kelly_pct") * scale).drop("_total")
    d = d.withColumn("kelly_stake", F.col("kelly_pct") * bankroll)
    return d.withColumn("ev_per_unit", F.col("kelly_stake") * (F.col("ev") if "ev" in bets.columns else F.lit(0.0)))


def bet_returns(bets: DataFrame) -> DataFrame:
    """Adds ret = won * odds - 1. Text counts as won if it is true, 1 or yes; odds up to 1 are an error."""
    won = F.col("won")
    if dict(bets.dtypes)["won"] == "string":
        won = F.lower("won").isin("true", "1", "yes")
    odds = F.when(F.col("odds_market") <= 1, F.raise_error(F.lit("odds must be over 1"))).otherwise(F.col("odds_market"))
    return bets.withColumn("ret", won.cast("int") * odds - 1)


def growth(returns: DataFrame, fractions: list[float]) -> DataFrame:
    """Mean log growth of each fraction: (fraction, growth); -1e20 if some factor is not positive."""
    d = returns.select("ret", F.explode(F.array(*[F.lit(float(f)) for f in fractions])).alias("fraction"))
    x = 1 + F.col("fraction") * F.col("ret")
    safe = F.log(F.when(x > 0, x))
    return d.groupBy("fraction").agg(F.when(F.min(x) <= 0, -1e20).otherwise(F.avg(safe)).alias("growth"))


def trajectory(returns: DataFrame, fraction: float, order: str, key: str, initial: float = 1000.0) -> DataFrame:
    """Bankroll after each bet of a key, its peak so far and its drawdown. From a wipe-out on it is 1e-12 and grows from there.

    Log factors are summed in the order in which DuckDB's windows add: sums of doubles in a row lose the ninth digit over some
    100,000 bets, and exact ones part from the SQL's at the last digits. A task reads a key's bets in order, in pieces.
    """
    s = W.partitionBy(key).orderBy(order)
    x = 1 + fraction * F.col("ret")
    d = returns.withColumns({"_n": F.row_number().over(s), "_hits": F.coalesce(F.sum((x <= 0).cast("int")).over(s.rowsBetween(W.unboundedPreceding, 0)), F.lit(0))})
    d = d.withColumn("_run", F.row_number().over(W.partitionBy(key, "_hits").orderBy(order)))
    names = returns.columns
    kind = StructType([*returns.schema.fields, *(StructField(c, DoubleType()) for c in ("bankroll", "peak", "drawdown"))])

    def followed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, peak = TreeSum(), initial
        for b in batches:
            x = 1 + fraction * b.column("ret").to_numpy(zero_copy_only=False).astype(float)
            first, run, hits = (b.column(c).to_numpy(zero_copy_only=False) for c in ("_n", "_run", "_hits"))
            values, at = np.unique(np.where(x > 0, x, 1.0), return_inverse=True)
            log = np.array([math.log(v) for v in values])[at]  # as the SQL's; numpy's differs by a bit at times
            sums = np.empty(len(x))
            edges = [0, *(i for i in np.flatnonzero(run == 1).tolist() if i), len(x)]
            for i, j in zip(edges, edges[1:], strict=False):
                if i < j:
                    tree = TreeSum() if run[i] == 1 else tree
                    sums[i:j] = tree.push(log[i:j])
            with np.errstate(over="ignore", invalid="ignore"):
                bankroll = np.where(hits > 0, 1e-12, initial) * np.exp(sums)
                high = np.empty(len(x))
                edges = [0, *(i for i in np.flatnonzero(first == 1).tolist() if i), len(x)]
                for i, j in zip(edges, edges[1:], strict=False):
                    if i < j:
                        peak = initial if first[i] == 1 else peak
                        high[i:j] = np.maximum.accumulate(np.maximum(bankroll[i:j], peak))
                        peak = high[j - 1]
                fall = 1 - bankroll / high
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), *(pa.array(v) for v in (bankroll, high, fall))], names=[*names, "bankroll", "peak", "drawdown"])

    return d.mapInArrow(followed, kind)


def growth_and_drawdown(returns: DataFrame, fractions: list[float] | DataFrame, order: str, key: str, initial: float = 1000.0) -> DataFrame:
    """Growth and largest drawdown of each key at each fraction, in one pass. Fractions are a list or a small table (key,
    fractions array).

    Bets are dealt out once by ranges of key and order; a task turns each run of a key into a row for each fraction, and the
    runs of a key follow each other.
    """
    runs = _ranges(returns, order, key)
    if not isinstance(fractions, DataFrame):
        fractions = runs.select(key).distinct().withColumn("fractions", F.array(*[F.lit(float(f)) for f in fractions]))
    return _by_fraction(runs, fractions, key)


def _ranges(returns: DataFrame, order: str, key: str) -> DataFrame:
    """Bets in written files of ranges of (key, order): (key, run, rets), where rets are the bets of an Arrow batch in order."""
    d = returns.select(key, order, "ret").repartitionByRange(F.col(key), F.col(order)).sortWithinPartitions(key, order)
    kind = f"{key} {returns.schema[key].dataType.simpleString()}, run long, rets array<double>"
    d = d.select(key, F.spark_partition_id().alias("part"), F.col("ret").cast("double").alias("ret"))

    def gathered(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = 0
        for f in frames:
            # A null key is a key of its own.
            new = (f[key] != f[key].shift()) & ~(f[key].isna() & f[key].shift().isna())
            edges = [0, *(x for x in np.flatnonzero(new).tolist() if x)] if len(f) else []
            for a, b in zip(edges, [*edges[1:], len(f)], strict=False):
                run = int(f["part"].iloc[a]) * 10**9 + n
                n += 1
                yield pd.DataFrame({key: [f[key].iloc[a]], "run": [run], "rets": [f["ret"].iloc[a:b].to_numpy()]})

    return written(d.mapInPandas(gathered, kind), "ranges")


def _by_fraction(runs: DataFrame, fractions: DataFrame, key: str) -> DataFrame:
    kind = f"{key} {runs.schema[key].dataType.simpleString()}, run long, fraction double, n long, good long, total double, high double, low double, fall double"

    def measured(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for k, run, rets, of in zip(f[key], f["run"], f["rets"], f["fractions"], strict=True):
                ret = np.asarray(rets, float)
                for fraction in of:
                    x = 1 + fraction * ret
                    log = np.cumsum(np.log(x[x > 0]))  # bets that lose all, and null ones, move nothing
                    if len(log):
                        out.append((k, run, fraction, len(ret), len(log), log[-1], log.max(), log.min(), (np.maximum.accumulate(log) - log).max()))
                    else:
                        out.append((k, run, fraction, len(ret), 0, 0.0, None, None, None))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in kind.split(", ")])

    met = runs.withColumn("_key", F.col(key)).drop(key).join(F.broadcast(fractions), F.col("_key").eqNullSafe(F.col(key))).select(key, "run", "rets", "fractions")
    d = met.mapInPandas(measured, kind)
    before = W.partitionBy(key, "fraction").orderBy("run").rowsBetween(W.unboundedPreceding, -1)  # a row for each run
    d = d.withColumn("_start", F.coalesce(F.sum("total").over(before), F.lit(0.0)))
    d = d.withColumn("_peak", F.greatest(F.lit(0.0), F.max(F.col("_start") + F.col("high")).over(before)))
    d = d.withColumn("_fall", F.greatest("fall", F.col("_peak") - F.col("_start") - F.col("low")))
    growth = F.when(F.sum("good") < F.sum("n"), -1e20).otherwise(F.sum("total") / F.sum("good"))
    return d.groupBy(key, "fraction").agg(growth.alias("growth"), (1 - F.exp(-F.max("_fall"))).alias("max_drawdown"))


def risk_constrained(returns: DataFrame, order: str, key: str, weight: float = 0.5, low: float = 0.005, high: float = 0.15, points: int = 30, passes: int = 3) -> DataFrame:
    """The fraction of each key within ``low`` and ``high`` that minimises weight * R / R* - G / G*; R* and G* are those at
    the best growth of the first grid.

    Each pass lays a grid of ``points`` between the neighbours of the best fraction so far, so three find it to about
    (high - low) / points ** 3. The bets are dealt out once; each pass reads them where they lie.
    """
    grid = [low + (high - low) * k / (points - 1) for k in range(points)]
    runs = _ranges(returns, order, key)
    keys = runs.select(key).distinct().withColumn("fractions", F.array(*[F.lit(f) for f in grid]))
    g = written(_by_fraction(runs, keys, key), "growth")
    top = g.groupBy(key).agg(F.max_by(F.struct("growth", "max_drawdown"), F.struct("growth", -F.col("fraction"))).alias("_b"))
    score = weight * F.try_divide(F.col("max_drawdown"), F.col("_b.max_drawdown")) - F.try_divide(F.col("growth"), F.abs("_b.growth"))
    first = F.min_by(F.struct("fraction", "growth", "max_drawdown", "score"), F.struct(F.round("score", 12).alias("s"), "fraction"))
    best = written(g.join(top, key).withColumn("score", score).groupBy(key).agg(first.alias("b")), "best")
    step = (high - low) / (points - 1)
    for _ in range(passes - 1):
        ends = [F.greatest(F.col("b.fraction") - step, F.lit(low)), F.least(F.col("b.fraction") + step, F.lit(high))]
        finer = F.array(*[ends[0] + (ends[1] - ends[0]) * (k / (points - 1)) for k in range(points)])
        again = _by_fraction(runs, best.select(key, finer.alias("fractions")), key)
        every = again.join(top, key).withColumn("score", score).select(key, "fraction", "growth", "max_drawdown", "score").unionByName(best.select(key, "b.*"))
        best = written(every.groupBy(key).agg(first.alias("b")), "best")
        step = 2 * step / (points - 1)
    return best.select(key, "b.*")


WALK = "rep int, block long, _sum double, _high double, _low double, _fall double"


def _walk(x: np.ndarray) -> tuple[float, float, float, float]:
    """Of log factors in order: their sum, the highest and the lowest sum on the way, and the largest fall from a sum."""
    log = np.cumsum(x)
    return log[-1], log.max(), log.min(), (np.maximum.accumulate(log) - log).max()


def cvar_drawdown(returns: DataFrame, fraction: float, alpha: float = 0.10, resamples: int = 200, seed: int = 42, block: int = 10_000, most: int = 1_000_000) -> DataFrame:
    """Mean of the largest drawdowns over bootstrap resamples: value at risk and the mean beyond it.

    A bet's place in the draw is that of its log factor, so the different factors and how often they occur are all a task
    needs to draw a block of a path; paths are summed by blocks. Up to ``most`` different factors are sent to every task, and
    no draw is shuffled. Of more, tasks hold a part of the factors each: see ``_walks_by_parts``.
    """
    spark = returns.sparkSession
    x = F.log(F.greatest(1 + fraction * F.col("ret"), F.lit(1e-12))).cast("double")
    factors = written(returns.select(x.alias("x")).groupBy("x").agg(F.count(F.lit(1)).alias("n")), "factors")
    size = factors.agg(F.count(F.lit(1)).alias("d"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    blocks = _walks(spark, factors, size.n, resamples, seed, block) if size.d <= most else _walks_by_parts(factors, size.n, -(-2 * size.d // most), resamples, seed, max(block, most))
    before = W.partitionBy("rep").orderBy("block").rowsBetween(W.unboundedPreceding, -1)  # one row per block
    blocks = blocks.withColumn("_start", F.coalesce(F.sum("_sum").over(before), F.lit(0.0)))
    blocks = blocks.withColumn("_peak", F.greatest(F.lit(0.0), F.max(F.col("_start") + F.col("_high")).over(before)))
    fall = F.greatest("_fall", F.col("_peak") - F.col("_start") - F.col("_low"))
    worst = written(blocks.groupBy("rep").agg((1 - F.exp(-F.max(fall))).alias("dd")), "drawdowns")
    cut = worst.agg(F.percentile("dd", 1 - alpha).alias("var"))
    return worst.crossJoin(F.broadcast(cut)).filter("dd >= var").agg(F.first("var").alias("value_at_risk"), F.avg("dd").alias("cvar"))


def _walks(spark: SparkSession, factors: DataFrame, n: int, resamples: int, seed: int, block: int) -> DataFrame:
    """A row for each block of each resample; a block draws by a seed of its own, so the tasks do not matter."""
    f = factors.toPandas().sort_values("x")
    held = spark.sparkContext.broadcast((f["x"].to_numpy(float), np.cumsum(f["n"].to_numpy("int64"))))
    blocks = -(-n // block)

    def walked(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        values, upto = held.value
        for frame in frames:
            out = []
            for i in frame["id"].tolist():
                rep, at = divmod(i, blocks)
                picks = np.random.default_rng([seed, rep, at]).integers(n, size=min(block, n - at * block))
                out.append((rep, at, *_walk(values[np.searchsorted(upto, picks, side="right")])))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in WALK.split(", ")])

    pairs = resamples * blocks
    parts = max(1, min(pairs, max(spark.sparkContext.defaultParallelism, -(-pairs // 256))))
    return spark.range(0, pairs, numPartitions=parts).mapInPandas(walked, WALK)


def _walks_by_parts(factors: DataFrame, n: int, parts: int, resamples: int, seed: int, block: int) -> DataFrame:
    """The same where no task can hold all factors. How many draws of a block fall to each part of the factors is drawn first,
    alike in every task; a task draws those of its part, 8 bytes each, and the block's task puts all in random order.
    """
    dealt = factors.withColumn("part", F.pmod(F.xxhash64("x"), F.lit(parts)))
    sizes = {r.part: r.n for r in dealt.groupBy("part").agg(F.sum("n").alias("n")).collect()}  # a row for each part
    names = sorted(sizes)
    shares = np.array([sizes[k] for k in names], float) / n
    blocks = -(-n // block)

    def drawn(key: tuple[Any, ...], frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, f = names.index(key[0]), pd.concat(list(frames)).sort_values("x")
        values, upto = f["x"].to_numpy(float), np.cumsum(f["n"].to_numpy("int64"))
        for rep in range(resamples):
            for b in range(blocks):
                k = np.random.default_rng([seed, rep, b]).multinomial(min(block, n - b * block), shares)[at]
                picks = np.random.default_rng([seed, rep, b, at + 1]).integers(upto[-1], size=k)
                yield pd.DataFrame({"rep": [rep], "block": [b], "part": [at], "x": [values[np.searchsorted(upto, picks, side="right")].tobytes()]})

    def walked(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        x = np.concatenate([np.frombuffer(v) for v in f.sort_values("part")["x"]])
        order = np.random.default_rng([seed, *(int(k) for k in key), 0, 0]).permutation(len(x))
        return pd.DataFrame([(*key, *_walk(x[order]))], columns=[c.split()[0] for c in WALK.split(", ")])

    draws = dealt.groupBy("part").applyInPandas(drawn, "rep int, block long, part int, x binary")
    return draws.groupBy("rep", "block").applyInPandas(walked, WALK)


def ruin(spark: SparkSession, p: float, odds: float, fraction: float, n_sims: int = 10_000, n_bets: int = 500, seed: int = 42, ruin_at: float = 0.5, parts: int = 8) -> DataFrame:
    """One row of P(ruin), P(drawdown over 30 and 50 %), and final bankroll statistics, over simulated runs of bets.

    Simulations are spread over tasks; each has a seed of its own, so the result does not depend on the partitions.
    """
    if not (0 < p < 1 and odds > 1 and fraction > 0):
        return spark.range(1).select(F.lit(0.0).alias("p_ruin"), F.lit(0.0).alias("p_dd30"), F.lit(0.0).alias("p_dd50"), F.lit(1.0).alias("mean_final"), F.lit(1.0).alias("median_final"), F.lit(1.0).alias("p5_final"), F.lit(1.0).alias("p95_final"), F.lit(0.0).alias("sharpe"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for i in f["id"]:
                won = np.random.default_rng([seed, i]).random(n_bets) < p
                log = np.cumsum(np.log(np.where(won, 1 + fraction * (odds - 1), max(1 - fraction, 1e-12))))
                peak = np.maximum.accumulate(np.maximum(log, 0))
                out.append((np.exp(log[-1]), 1 - np.exp((log - peak).min()), np.exp(log.min())))
            yield pd.DataFrame(out, columns=["final", "dd", "low"])

    sims = spark.range(0, n_sims, numPartitions=parts).mapInPandas(run, "final double, dd double, low double")
    return sims.agg(
        F.avg((F.col("low") <= 1 - ruin_at).cast("double")).alias("p_ruin"), F.avg((F.col("dd") > 0.3).cast("double")).alias("p_dd30"),
        F.avg((F.col("dd") > 0.5).cast("double")).alias("p_dd50"), F.avg("final").alias("mean_final"), F.percentile("final", 0.5).alias("median_final"),
        F.percentile("final", 0.05).alias("p5_final"), F.percentile("final", 0.95).alias("p95_final"),
        F.when(F.stddev_samp("final") > 1e-12, (F.avg("final") - 1) / F.stddev_samp("final")).otherwise(0.0).alias("sharpe"),
    )


def acceptable(p_ruin: Column, p_dd30: Column) -> Column:
    return (p_ruin <= 0.001) & (p_dd30 <= 0.10)


def ruin_report(row: DataFrame) -> DataFrame:
    """Adds whether the risk is acceptable and one line of text that says so with the figures."""
    ok = acceptable(F.col("p_ruin"), F.col("p_dd30"))
    said = F.format_string(
        "%s: ruin %.4f, drawdown over 30 %% %.4f, over 50 %% %.4f, final mean %.4f, median %.4f, 5 to 95 %% %.4f to %.4f, Sharpe %.4f",
        F.when(ok, "acceptable").otherwise("not acceptable"), "p_ruin", "p_dd30", "p_dd50", "mean_final", "median_final", "p5_final", "p95_final", "sharpe",
    )
    return row.withColumns({"accepted": ok, "report": said})


def largest_safe_fraction(spark: SparkSession, p: float, odds: float, target: float = 0.10, kelly: float = 1.0, steps: int = 15, **kw) -> DataFrame:
    """The largest share of the Kelly stake whose P(drawdown over 30 %) stays within the target, by bisection between 0
    and ``kelly``: (share, fraction, p_dd30). Simulations share their seeds, so the risk grows with the share."""
    full = max(0.0, p - (1 - p) / (odds - 1))
    low, high, risk = 0.0, kelly, 0.0
    for _ in range(steps if full > 0 else 0):
        mid = (low + high) / 2
        found = ruin(spark, p, odds, full * mid, **kw).first().p_dd30
        if found <= target:
            low, risk = mid, found
        else:
            high = mid
    return spark.createDataFrame([(low, full * low, float(risk))], "share double, fraction double, p_dd30 double")


def moments(returns: DataFrame, key: str = "ticker", time: str = "timestamp", x: str = "return") -> DataFrame:
    """Means and sample covariances of every pair of keys: (a, b, mean_a, mean_b, cov), joined on time."""
    r = returns.select(key, time, x).filter(F.col(x).isNotNull())
    a, b = r.toDF("a", "t", "x"), r.toDF("b", "t", "y")
    return a.join(b, "t").groupBy("a", "b").agg(F.avg("x").alias("mean_a"), F.avg("y").alias("mean_b"), F.covar_samp("x", "y").alias("cov"))


def moment_arrays(pairs: DataFrame, most: int = 500) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Names, means and covariances of ``moments``, for an optimiser on the driver: over ``most`` keys are refused."""
    if pairs.select("a").distinct().limit(most + 1).count() > most:
        raise ValueError(f"more than {most} assets at once")
    m = pairs.toPandas()
    names = sorted(m.a.unique())
    table = m.pivot(index="a", columns="b", values="cov").loc[names, names].fillna(0.0)
    return names, m[m.a == m.b].set_index("a").mean_a.loc[names].to_numpy(float), table.to_numpy(float)


def project_simplex(v: np.ndarray, cap: float) -> np.ndarray:
    """Nearest weights within 0 and ``cap`` that sum to 1."""
    lo, hi = v.min() - 1, v.max()
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if np.clip(v - mid, 0, cap).sum() > 1 else (lo, mid)
    return np.clip(v - (lo + hi) / 2, 0, cap)


def max_sharpe(mean: np.ndarray, cov: np.ndarray, cap: float = 0.4, steps: int = 3000) -> np.ndarray:
    """Weights of the highest Sharpe ratio under a cap, by projected gradient from several starts; the numbers of assets
    bound this step on the driver."""
    n = len(mean)
    if n == 1:
        return np.ones(1)
    if (mean <= 0).all():
        return np.full(n, 1 / n)
    cap = max(cap, 1 / n + 0.01)
    sharpe = lambda w: w @ mean / np.sqrt(w @ cov @ w + 1e-18)
    best = np.full(n, 1 / n)
    for s in range(5):
        w = project_simplex(np.random.default_rng(s).random(n) if s else np.full(n, 1 / n), cap)
        for k in range(steps):
            v = w @ cov @ w + 1e-18
            g = mean / np.sqrt(v) - (w @ mean) * (cov @ w) / v**1.5
            w = project_simplex(w + 0.05 / np.sqrt(k + 1) * g / (np.linalg.norm(g) + 1e-12), cap)
        best = max((best, w), key=sharpe)
    return best


def least_variance(mean: np.ndarray, cov: np.ndarray, target: float, cap: float) -> np.ndarray | None:
    """Weights from 0 to ``cap`` that sum to 1 and return ``target``, of the least variance; None if there are none.

    An active set of weights at a bound: the others solve the equations of the least variance. A step that leaves the bounds
    stops at the first and holds it; at a solution the bound that costs most is let go, until none costs anything.
    """
    n = len(mean)

    def greedy(order: np.ndarray) -> np.ndarray:
        w, left = np.zeros(n), 1.0
        for i in order:
            w[i] = min(cap, left)
            left -= w[i]
        return w

    low, high = greedy(np.argsort(mean, kind="stable")), greedy(np.argsort(-mean, kind="stable"))
    spread = (high - low) @ mean
    if n * cap < 1 - 1e-12 or not low @ mean - 1e-12 <= target <= high @ mean + 1e-12:
        return None
    w = low + (high - low) * (np.clip((target - low @ mean) / spread, 0, 1) if spread > 1e-15 else 0.0)
    scale = np.trace(cov) / n or 1.0
    q, rows = cov / scale, np.stack([np.ones(n), mean / max(np.abs(mean).max(), 1e-300)])
    held = np.where(w <= 1e-12, -1, np.where(w >= cap - 1e-12, 1, 0))
    for _ in range(100 * n):
        free = np.flatnonzero(held == 0)
        step = np.zeros(n)
        kkt = np.block([[q[np.ix_(free, free)], rows[:, free].T], [rows[:, free], np.zeros((2, 2))]])
        found = np.linalg.lstsq(kkt, np.append(-(q @ w)[free], [0.0, 0.0]), rcond=1e-13)[0]
        step[free] = found[: len(free)]
        if np.abs(step).max(initial=0) < 1e-11:
            # With few free weights the two multipliers are those that fit them best.
            gradient = q @ w + rows.T @ found[len(free) :]
            cost = np.where(held < 0, gradient, np.where(held > 0, -gradient, 0.0))
            if cost.min(initial=0) >= -1e-10:
                return w
            held[cost.argmin()] = 0
            continue
        room = np.where(step > 0, (cap - w) / np.where(step > 0, step, 1), np.where(step < 0, -w / np.where(step < 0, step, -1), np.inf))
        room[free] = np.maximum(room[free], 0)
        first = free[room[free].argmin()]
        if room[first] < 1:
            w = w + room[first] * step
            held[first] = 1 if step[first] > 0 else -1
            w[first] = cap if step[first] > 0 else 0.0
        else:
            w = w + step
    return w


def frontier(mean: np.ndarray, cov: np.ndarray, points: int = 20, cap: float = 0.3, risk_free: float = 0.0) -> pd.DataFrame:
    """(target, volatility, sharpe, weights): the least volatility at each of ``points`` target returns from the least to the
    largest mean. No weight exceeds ``cap`` (or a little over an equal share, if that is more); targets that the cap puts out
    of reach are left out. One asset has no frontier."""
    n = len(mean)
    rows = []
    cap = max(cap, 1 / n + 0.01) if n else cap
    for target in np.linspace(mean.min(), mean.max(), points) if n > 1 else ():
        w = least_variance(mean, cov, float(target), cap)
        if w is not None:
            sd = float(np.sqrt(max(w @ cov @ w, 0.0)))
            rows.append((float(target), sd, float((target - risk_free) / sd) if sd > 1e-8 else 0.0, w.tolist()))
    return pd.DataFrame(rows, columns=["target", "volatility", "sharpe", "weights"])


def bet_correlation(bets: DataFrame, rho: float = 0.10, most: int = 10_000) -> DataFrame:
    """Pairs of bets of the same league and day with their assumed correlation, and each bet's volatility edge / 1.5.

    The rows grow with the square of a group. A group of more than ``most`` bets is dealt into parts by hash, and every pair of
    parts is a block of its own, so neither a task's memory nor its pairs grow with the group. A merge join keeps a group's
    pairs together, where their columns take a fraction of the bytes once written.
    """
    group = ["league", "date"]
    b = bets.filter("bet_signal").select("bet_id", *group, (F.abs("ev") / 1.5).alias("sd"))
    large = b.groupBy(group).agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias("parts")).filter("parts > 1")  # at most a row for ``most`` bets
    b = b.join(F.broadcast(large), group, "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    part, every = F.pmod(F.xxhash64("bet_id"), F.col("parts")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    one = b.select("bet_id", *group, "sd", part.alias("i"), every.alias("j"))
    other = b.select(F.col("bet_id").alias("other"), *group, F.col("sd").alias("sd_other"), part.alias("j"), every.alias("i"))
    return one.join(other.hint("merge"), [*group, "i", "j"]).filter("bet_id < other").select("bet_id", "other", (F.col("sd") * F.col("sd_other") * rho).alias("cov"))


def signal_portfolio(bets: DataFrame, bankroll: float, rho: float = 0.10, cap: float = 0.4, most: int | None = None) -> DataFrame:
    """Stakes of the signalled bets with the highest Sharpe ratio: (bet_id, weight, stake). A bet's mean is its edge, at
    least 0.001, and its deviation that over 1.5; two of the same league and day correlate by ``rho``. More than ``most``
    signals are refused, if that is given.

    With y = weight * edge and Y the sum of y over a group, a bet that is neither at 0 nor at the cap has (1 - rho) y + rho Y
    = a + b / edge, where b is 0 unless some bet is at the cap. So sums by group give a and b, and those the bets at a bound;
    this is repeated until they stay. The driver holds one row.
    """
    spark, same = bets.sparkSession, F.col("league").isNotNull() & F.col("date").isNotNull()
    group = F.struct(F.when(same, F.col("league")).alias("league"), F.when(same, F.col("date")).alias("date"), F.when(~same, F.col("bet_id")).alias("bet_id"))
    edge = F.greatest(F.coalesce("ev", F.lit(0.0)), F.lit(0.001))
    rows = written(bets.filter("bet_signal").select(F.col("bet_id").cast("long").alias("bet_id"), group.alias("g"), edge.cast("double").alias("e"), F.lit(0).alias("at")), "signals")
    n = rows.count()
    if most is not None and n > most:
        raise ValueError(f"more than {most} signals at once")
    if not n:
        return spark.createDataFrame([], "bet_id long, weight double, stake double")
    cap = max(cap, 1 / n + 0.01)
    cap *= 1 + 1e-9 if abs(1 / cap - round(1 / cap)) < 1e-9 else 1  # else bets at the cap could leave nothing to the others
    one, e = 1 - rho, F.col("e")
    on = lambda where, x: F.sum(F.when(F.col("at") == where, x).otherwise(0.0))
    for _ in range(100):
        groups = rows.groupBy("g").agg(
            on(0, F.lit(1.0)).alias("n"), on(0, 1 / e).alias("s1"), on(0, 1 / (e * e)).alias("s2"),
            on(1, F.lit(1.0)).alias("m"), on(1, e).alias("c1"), on(1, e * e).alias("c2"),
        )
        under = one + rho * F.col("n")  # Y = a * ya + b * yb + y0
        groups = written(groups.withColumns({"ya": F.col("n") / under, "yb": F.col("s1") / under, "y0": cap * one * F.col("c1") / under}), "groups")
        t = groups.agg(
            F.sum(F.expr(f"s1 - {rho}D * s1 * ya")).alias("a1"), F.sum(F.expr(f"s2 - {rho}D * s1 * yb")).alias("b1"), F.sum(F.expr(f"{rho}D * s1 * y0")).alias("r1"), F.sum("m").alias("m"),
            F.sum(F.expr(f"c1 - {rho}D * c1 * ya")).alias("a2"), F.sum(F.expr(f"{rho}D * c1 * yb")).alias("b2"), F.sum(F.expr(f"{one * cap}D * c2 + {rho}D * c1 * y0")).alias("r2"),
        ).first()
        # The weights' sum is 1; b is the cap times what the cap costs the bets at it.
        sums = [[t.a1 / one, t.b1 / one], [cap * t.a2, cap * (t.m - t.b2) - 1]]
        a, b = np.linalg.solve(sums, [1 - t.m * cap + t.r1 / one, cap * t.r2]) if t.m else (one / t.a1, 0.0)
        y = (F.lit(float(a)) + F.lit(float(b)) / e - rho * (F.lit(float(a)) * F.col("ya") + F.lit(float(b)) * F.col("yb") + F.col("y0"))) / one
        w = F.when(F.col("at") == 1, cap).when(F.col("at") == -1, 0.0).otherwise(y / e)
        now = F.when(y > cap * e * (1 + 1e-12), 1).when(y < -1e-15, -1).otherwise(0)
        rows = written(rows.join(groups.select("g", "ya", "yb", "y0"), "g").select("bet_id", "g", "e", now.alias("at"), (now != F.col("at")).alias("moved"), w.alias("weight")), "weights")
        if rows.filter("moved").isEmpty():
            return rows.select("bet_id", "weight", (F.col("weight") * bankroll * EXPOSURE).alias("stake"))
    raise RuntimeError("the bets at a bound do not settle")


def spread_stakes(bets: DataFrame, weights: DataFrame, bankroll: float) -> DataFrame:
    """Stakes weight * bankroll * largest exposure back on the bets; 0 for bets without a weight."""
    return bets.join(weights, "bet_id", "left").withColumn("stake", F.coalesce("weight", F.lit(0.0)) * bankroll * EXPOSURE)
