"""Choosing among models, looking into them, and scoring the last row of each series.

A model here is a spark.ml pipeline of ``learning``. Choices are made from areas under the curve of test rows, as tables.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.prefix import written
from . import evaluation as ev
from . import grouped, learning


def candidates(d: DataFrame, trees: int = 200, rounds: int = 100) -> DataFrame:
    """Test areas of four models: a forest of technical features, one with sentiment if there is some, boosting, and a
    stack: (model, auc, accuracy, brier, majority)."""
    d = written(d, "candidates")
    plain = d.drop(*learning.SENTIMENT)
    out = learning.scored(plain, "forest", trees=trees)
    out = out.unionByName(learning.scored(plain, "boosted", rounds=rounds)).unionByName(learning.stacked(plain))
    if all(c in d.columns for c in learning.SENTIMENT):
        out = out.unionByName(learning.scored(d, "forest", trees=trees).withColumn("model", F.lit("forest_sentiment")))
    return out


def best_of(scores: DataFrame, key: list[str] | None = None, metric: str = "auc") -> DataFrame:
    """Scores (model, metric) with the rank of each model of a key; of equals the first by name."""
    order = W.partitionBy(*(key or [F.lit(1)])).orderBy(F.desc_nulls_last(F.round(metric, 9)), "model")
    return scores.withColumn("rank", F.row_number().over(order)).withColumn("chosen", F.col("rank") == 1)


def overfit(train: Column, test: Column, gap: float = 0.1) -> Column:
    """``overfitting`` if training beats test by more than the gap, ``suspect`` the other way round, else ``ok``."""
    return F.when(train - test > gap, "overfitting").when(train - test < -gap, "suspect").otherwise("ok")


def overfit_check(d: DataFrame, p: str = "p", y: str = "y", part: str = "part", gap: float = 0.1) -> DataFrame:
    """Areas of the rows of parts ``train`` and ``test``, their difference and the verdict."""
    area = lambda name: ev.auc(d.filter(F.col(part) == name), p, y).select(F.col("auc").alias(f"auc_{name}"))
    s = area("train").crossJoin(area("test"))
    return s.withColumns({"gap": F.col("auc_train") - F.col("auc_test"), "verdict": overfit(F.col("auc_train"), F.col("auc_test"), gap)})


def inspect(model: PipelineModel, names: list[str]) -> list[tuple[str, str, float | None]]:
    """(what, name, value) of a fitted pipeline: class, number of features and classes, parameters that are numbers, and
    importances or absolute coefficients from the largest down."""
    last = model.stages[-1]
    out: list[tuple[str, str, float | None]] = [("class", type(last).__name__, None), ("features", "number", float(last.numFeatures)), ("classes", "number", float(getattr(last, "numClasses", 0)))]
    for q, v in sorted(last.extractParamMap().items(), key=lambda x: x[0].name):
        if isinstance(v, (int, float)) and not isinstance(v, bool):
            out.append(("parameter", q.name, float(v)))
    values = getattr(last, "featureImportances", None)
    values = values if values is not None else getattr(last, "coefficients", None)
    if values is not None:
        out += [("importance", n, v) for n, v in sorted(zip(names, map(abs, map(float, values.toArray())), strict=True), key=lambda x: (-x[1], x[0]))]
    return out


def inspected(d: DataFrame, kind: str = "forest", **kw) -> DataFrame:
    """``inspect`` of a model of the training rows, as a table."""
    model = learning.fit(d.filter("part <> 'test'"), kind, **kw)
    return d.sparkSession.createDataFrame(inspect(model, learning.resolve(d.columns)), "what string, name string, value double")


def last_rows(d: DataFrame, names: list[str]) -> DataFrame:
    """The last complete row of each ticker."""
    whole = d.dropna(subset=names)
    return whole.groupBy("ticker").agg(F.max_by(F.struct(*whole.columns), "timestamp").alias("r")).select("r.*")


def latest(d: DataFrame, routes: DataFrame, kind: str = "ridge", up: float = 0.5) -> DataFrame:
    """(ticker, timestamp, route, p, up) of each ticker's last complete row: by its own model or the pooled one, as
    ``routes`` (ticker, route) say; a ticker without a route has the pool. Models are fit on the labelled rows of ``d``."""
    names = learning.resolve(d.columns)
    labelled = written(d.filter(F.col("label").isNotNull()), "labelled")
    rows = last_rows(d, names).join(routes.select("ticker", "route"), "ticker", "left").withColumn("route", F.coalesce("route", F.lit("pool")))
    rows = written(rows.drop("p"), "last")
    own, pooled = rows.filter("route = 'own'"), rows.filter("route <> 'own'")
    out = None if pooled.isEmpty() else learning.with_p(learning.fit(labelled, kind), pooled)
    if not own.isEmpty():
        mine = labelled.join(own.select("ticker"), "ticker", "left_semi")
        one = grouped.with_p(own, grouped.fit(mine, "ticker", names), "ticker", names)
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out.select("ticker", "timestamp", "route", "p", (F.col("p") >= up).alias("up"))


def compare(base: DataFrame, other: DataFrame, key: list[str], metrics: list[str]) -> DataFrame:
    """Metrics of two runs by key and their differences, other less base, to 4 digits."""
    b = other.select(*key, *[F.col(m).alias(f"{m}_other") for m in metrics])
    return base.select(*key, *metrics).join(b, key).withColumns({f"{m}_delta": F.round(F.col(f"{m}_other") - F.col(m), 4) for m in metrics})


def horizon_sweep(bars: DataFrame, scores: list[str], horizons: tuple[int, ...] = (1, 5, 10, 20), close: str = "close") -> DataFrame:
    """(horizon, score, n, auc): how well a single column tells whether the close rises over each horizon."""
    by = W.partitionBy("ticker").orderBy("timestamp")
    d = bars.withColumns({f"_y{h}": (F.lead(close, h).over(by) > F.col(close)).cast("int") for h in horizons})
    d = written(d.select(*scores, *[f"_y{h}" for h in horizons]), "horizons")
    out = None
    for h in horizons:
        for c in scores:
            some = d.filter(F.col(c).isNotNull() & F.col(f"_y{h}").isNotNull())
            row = ev.auc(some, c, f"_y{h}").select(F.lit(h).alias("horizon"), F.lit(c).alias("score"), "auc").crossJoin(some.agg(F.count(F.lit(1)).alias("n")))
            out = row if out is None else out.unionByName(row)
    return out


def volatility_ablation(d: DataFrame, variants: dict[str, tuple[str, ...]], horizon: int = 10, trees: int = 200) -> DataFrame:
    """Metrics of the volatility forest with each set of features: (variant, r2, mae, spearman), beside persistence."""
    d, out = written(d, "ablation"), None
    for name, names in variants.items():
        both = learning.volatility(d, horizon, trees, names)
        rows = both.filter("model = 'forest'").withColumn("variant", F.lit(name))
        rows = rows if out is not None else rows.unionByName(both.filter("model = 'persistence'").withColumn("variant", F.lit("persistence")))
        out = rows if out is None else out.unionByName(rows)
    return out.drop("model", "annualise")


def annualised(d: DataFrame, x: str, days: float = 252.0) -> DataFrame:
    """Adds a daily volatility's value for a year."""
    return d.withColumn(f"{x}_year", F.col(x) * F.sqrt(F.lit(days)))
