"""Models over features by spark.ml: classifiers, regressors, calibration, ensembles, routing, importance, resampling.

Training rows come before test rows in time. Weights that combine models are chosen on a validation slice, never on
test rows, and a meta-learner sees out-of-fold predictions only.
"""

from __future__ import annotations

import itertools
import math

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.prefix import running_sum, written
from . import evaluation as ev
from . import grouped

DECLARED = ["return", "volatility", "rsi", "hl_range", "oc_range", "log_volume", "vwap_ratio", "lag_1", "lag_5", "lag_20", "momentum_10", "momentum_21", "day_of_week", "quarter"]
SENTIMENT = ["sentiment_score", "sentiment_ma5", "sentiment_vol"]


def resolve(columns: list[str], declared: list[str] | None = None, sentiment: list[str] | None = None) -> list[str]:
    """The declared features that are there; those of sentiment all or none."""
    extra = SENTIMENT if sentiment is None else sentiment
    out = [c for c in (declared or DECLARED) if c in columns]
    return out + (extra if all(c in columns for c in extra) else [])


def prepare(d: DataFrame, y: str = "target") -> DataFrame:
    """Complete rows with label and part (train, validate, test) in time order. They are written once, since every fit
    and every metric reads them again."""
    names = resolve(d.columns)
    out = d.dropna(subset=[*names, y]).withColumn("label", F.col(y).cast("double"))
    return written(ev.class_weights(ev.temporal_split(out, 0.8, 0.2), "label"), "prepared")


def estimator(kind: str, trees: int = 200, rounds: int = 100, depth: int = 5, reg: float = 0.1, mix: float = 0.5, seed: int = 42):
    """A forest of ``trees``, ``rounds`` of boosting, or a logistic model with penalty ``reg``, ``mix`` of it on absolute
    values; depth is that of the trees."""
    common = {"featuresCol": "features", "labelCol": "label", "weightCol": "weight"}
    if kind == "forest":
        return RandomForestClassifier(numTrees=trees, maxDepth=depth, minInstancesPerNode=50, featureSubsetStrategy="sqrt", seed=seed, **common)
    if kind == "boosted":
        return GBTClassifier(maxIter=rounds, maxDepth=depth, stepSize=0.1, minInstancesPerNode=10, seed=seed, **common)
    if kind == "elastic":
        return LogisticRegression(regParam=reg, elasticNetParam=mix, **common)
    if kind == "ridge":
        return LogisticRegression(regParam=1.0, elasticNetParam=0.0, **common)
    raise ValueError(f"unknown model {kind!r}")


def pipeline(names: list[str], kind: str, **kw) -> Pipeline:
    """Assemble, scale by the training rows' mean and deviation, and fit."""
    steps = [VectorAssembler(inputCols=names, outputCol="raw"), StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True), estimator(kind, **kw)]
    return Pipeline(stages=steps)


def with_p(model, d: DataFrame, name: str = "p") -> DataFrame:
    """Rows with the probability of the positive class."""
    out = model.transform(d)
    return out.withColumn(name, vector_to_array("probability")[1]).drop("raw", "features", "rawPrediction", "probability", "prediction")


def fit(d: DataFrame, kind: str, **kw):
    return pipeline(resolve(d.columns), kind, **kw).fit(d)


def scored(d: DataFrame, kind: str, **kw) -> DataFrame:
    """Metrics of a model on the test rows: model, auc, accuracy, brier, majority."""
    model = fit(d.filter("part <> 'test'"), kind, **kw)
    return ev.auc(with_p(model, d.filter("part = 'test'")), "p", "label").withColumn("model", F.lit(kind))


def elastic_grid(d: DataFrame, regs: tuple[float, ...] = (0.01, 0.1, 1.0), mixes: tuple[float, ...] = (0.0, 0.5, 1.0)) -> DataFrame:
    """Each penalty and mix with its area on the validation rows, and whether it is the best (the first of equals)."""
    train, validate = written(d.filter("part = 'train'"), "train"), written(d.filter("part = 'validate'"), "validate")
    out = None
    for i, (reg, mix) in enumerate(itertools.product(regs, mixes)):
        area = ev.auc(with_p(fit(train, "elastic", reg=reg, mix=mix), validate), "p", "label").select("auc")
        row = area.select(F.lit(i).alias("i"), F.lit(reg).alias("reg"), F.lit(mix).alias("mix"), "auc")
        out = row if out is None else out.unionByName(row)
    out = written(out, "grid")
    best = out.agg(F.max_by("i", F.struct(F.round("auc", 9).alias("a"), -F.col("i"))).alias("best"))
    return out.crossJoin(best).select("reg", "mix", "auc", (F.col("i") == F.col("best")).alias("best"))


def calibrated(d: DataFrame, kind: str = "forest") -> DataFrame:
    """Calibration error and area on test rows of a model, raw and after isotonic and sigmoid regression on the
    validation rows, and which is adopted: the least error of those that lose under 0.02 of area, else raw."""
    model = fit(d.filter("part = 'train'"), kind)
    v, t = (written(with_p(model, d.filter(f"part = '{p}'")).select("p", "label"), p) for p in ("validate", "test"))
    iso = IsotonicRegression(featuresCol="p", labelCol="label").fit(v)
    logit = F.log(F.greatest("p", F.lit(1e-6)) / F.greatest(1 - F.col("p"), F.lit(1e-6)))
    wide = VectorAssembler(inputCols=["z"], outputCol="features")
    sigmoid = LogisticRegression(featuresCol="features", labelCol="label").fit(wide.transform(v.withColumn("z", logit)))
    after = iso.transform(t).withColumn("q", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("prediction")))).drop("prediction")
    after = sigmoid.transform(wide.transform(after.withColumn("z", logit))).withColumn("r", vector_to_array("probability")[1])
    after = written(after.select("p", "q", "r", "label"), "calibrated")
    out = None
    for name, c in (("raw", "p"), ("isotonic", "q"), ("sigmoid", "r")):
        one = ev.ece(after, p=c, y="label").toDF(f"ece_{name}").crossJoin(ev.auc(after, c, "label").select(F.col("auc").alias(f"auc_{name}")))
        out = one if out is None else out.crossJoin(one)
    good = lambda name: F.col(f"auc_{name}") > F.col("auc_raw") - 0.02
    low = F.least("ece_raw", *[F.when(good(n), F.col(f"ece_{n}")) for n in ("isotonic", "sigmoid")])
    adopted = F.when(F.col("ece_raw") <= low, "raw").when(good("isotonic") & (F.col("ece_isotonic") <= low), "isotonic").otherwise("sigmoid")
    return out.withColumn("adopted", adopted)


def members(d: DataFrame, kinds: list[str], train: str, apply_to: str) -> DataFrame:
    """Rows of a part with the probabilities p_<kind> of models fit on another."""
    rows = d.filter(apply_to)
    fit_on = d.filter(train)
    for k in kinds:
        rows = with_p(fit(fit_on, k), rows, f"p_{k}")
    return rows


def ensemble(d: DataFrame, kinds: tuple[str, ...] = ("forest", "boosted", "ridge"), step: float = 0.1) -> DataFrame:
    """Weights on the simplex, by area on the validation rows: the best, and its area and the equal mean's on test, with
    the share of test rows whose members all vote alike and the mean margin of votes.

    Mixed probabilities are counted to 4 digits before they are ranked, so a weight's ranks are of at most 10,001 values.
    """
    kinds = list(kinds)
    both = written(members(d, kinds, "part = 'train'", "part <> 'train'").select("part", "label", *[f"p_{k}" for k in kinds]), "members")
    n = round(1 / step)
    grid = [w for w in itertools.product(range(n + 1), repeat=len(kinds)) if sum(w) == n]
    table = d.sparkSession.createDataFrame([(i, [x / n for x in w]) for i, w in enumerate(grid)], "w int, weights array<double>")
    mixed = both.filter("part = 'validate'").crossJoin(F.broadcast(table))  # one row per step of the grid
    p = sum((F.col(f"p_{k}") * F.col("weights")[i] for i, k in enumerate(kinds)), F.lit(0.0))
    counts = mixed.groupBy("w", F.round(p, 4).alias("p")).agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("pos"))
    upto = W.partitionBy("w").orderBy("p").rowsBetween(W.unboundedPreceding, 0)
    ranks = counts.withColumn("r", F.sum("n").over(upto) - (F.col("n") - 1) / 2)
    pos = F.sum("pos")
    neg = F.sum("n") - pos
    areas = ranks.groupBy("w").agg(F.try_divide(F.sum(F.col("r") * F.col("pos")) - pos * (pos + 1) / 2, pos * neg).alias("auc"))
    areas = areas.join(F.broadcast(table), "w")
    best = written(areas.agg(F.max_by("weights", F.struct(F.round("auc", 9).alias("a"), -F.col("w"))).alias("weights"), F.max("auc").alias("auc_validate")), "best")
    test = both.filter("part = 'test'").crossJoin(F.broadcast(best))
    test = test.withColumns({"p": p, "p_equal": sum((F.col(f"p_{k}") for k in kinds), F.lit(0.0)) / len(kinds)})
    votes = sum(((F.col(f"p_{k}") >= 0.5).cast("double") for k in kinds), F.lit(0.0)) / len(kinds)
    margin = test.agg(F.avg(F.abs(2 * votes - 1)).alias("vote_margin"), F.avg((F.abs(2 * votes - 1) == 1).cast("double")).alias("unanimous"))
    return (
        best.crossJoin(ev.auc(test, "p", "label").select(F.col("auc").alias("auc_weighted")))
        .crossJoin(ev.auc(test, "p_equal", "label").select(F.col("auc").alias("auc_equal"))).crossJoin(margin)
    )


def stacked(d: DataFrame, kinds: tuple[str, ...] = ("forest", "ridge"), folds: int = 2) -> DataFrame:
    """A logistic meta-learner on walk-forward out-of-fold probabilities, scored on test rows."""
    names = [f"p_{k}" for k in kinds]
    rest = d.filter("part <> 'test'").drop("part")
    used = written(ev.walk_forward(rest, folds=folds, start=0.6), "folds")
    out = None
    for f in range(folds):
        part = members(used.filter(F.col("fold") == f), list(kinds), "part = 'train'", "part = 'test'").select("label", "weight", *names)
        out = part if out is None else out.unionByName(part)
    meta = Pipeline(stages=[VectorAssembler(inputCols=names, outputCol="features"), LogisticRegression(featuresCol="features", labelCol="label", weightCol="weight", regParam=0.01)]).fit(out)
    test = members(d, list(kinds), "part <> 'test'", "part = 'test'")
    return ev.auc(with_p(meta, test), "p", "label").withColumn("model", F.lit("stacked"))


HAR = ("har_d", "har_w", "har_m", "har_dw", "har_wm", "volatility")


def volatility(d: DataFrame, horizon: int = 10, trees: int = 200, names: tuple[str, ...] = HAR) -> DataFrame:
    """R2, MAE and rank correlation of a forest of HAR features for forward volatility, beside persistence."""
    names = list(names)
    y = f"future_vol_{horizon}"
    d = ev.temporal_split(d.dropna(subset=[*names, y, f"persistence_{horizon}"]), 0.8)
    forest = RandomForestRegressor(featuresCol="features", labelCol=y, numTrees=trees, maxDepth=5, minInstancesPerNode=20, seed=42)
    model = Pipeline(stages=[VectorAssembler(inputCols=names, outputCol="features"), forest]).fit(d.filter("part = 'train'"))
    test = model.transform(d.filter("part = 'test'")).select(y, f"persistence_{horizon}", F.col("prediction").alias("p"))
    a = ev.regression(test, y, "p").withColumn("model", F.lit("forest"))
    return a.unionByName(ev.regression(test, y, f"persistence_{horizon}").withColumn("model", F.lit("persistence"))).withColumn("annualise", F.sqrt(F.lit(252.0)))


def by_regime(d: DataFrame, column: str = "regime", least: int = 30, kind: str = "forest", **kw) -> DataFrame:
    """A model for each regime of at least ``least`` training rows of both classes, and one for all: regime, n, auc on
    the regime's test rows (null without both classes there)."""
    train, test = d.filter("part <> 'test'"), d.filter("part = 'test'")
    train, test = written(train, "train"), written(test, "test")
    sizes = {r[column]: r for r in train.groupBy(column).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("label").alias("classes")).collect()}  # a row per regime
    out = ev.auc(with_p(fit(train, kind, **kw), test), "p", "label").select(F.lit("all").alias("regime"), F.lit(sum(r.n for r in sizes.values())).cast("long").alias("n"), "auc")
    for value, r in sorted(sizes.items(), key=lambda x: str(x[0])):
        if r.n >= least and r.classes > 1 and value is not None:
            m = fit(train.filter(F.col(column) == value), kind, **kw)
            row = ev.auc(with_p(m, test.filter(F.col(column) == value)), "p", "label").select(F.lit(str(value)).alias("regime"), F.lit(r.n).cast("long").alias("n"), "auc")
            out = out.unionByName(row)
    return out


def one_hot(d: DataFrame, column: str, values: list[str]) -> DataFrame:
    """Dummies of the sorted values but the first."""
    return d.withColumns({f"{column}_{v}": (F.col(column) == v).cast("double") for v in sorted(values)[1:]})


def routing(d: DataFrame, weak: float = 0.55) -> DataFrame:
    """Own and pooled model by ticker; a ticker goes to the pool if its own is weak and the pool's is better. The own models
    are fitted together, so the number of jobs does not depend on the number of tickers."""
    tickers = sorted(r[0] for r in d.select("ticker").distinct().collect())
    wide = one_hot(d, "ticker", tickers)
    names = [*resolve(d.columns), *[f"ticker_{t}" for t in tickers[1:]]]
    pool = pipeline(names, "ridge").fit(wide.filter("part <> 'test'"))
    test = with_p(pool, wide.filter("part = 'test'"), "p_pool")
    plain = resolve(d.columns)
    own = grouped.fit(d.filter("part <> 'test'"), "ticker", plain)
    test = written(grouped.with_p(test, own, "ticker", plain, "p_own").select("ticker", "label", "p_own", "p_pool"), "routed")
    area = lambda c: grouped.auc_by(test, "ticker", f"p_{c}", "label").select("ticker", F.col("auc").alias(f"auc_{c}"))
    out = area("own").join(area("pool"), "ticker")
    pooled = (F.col("auc_own") < weak) & (F.col("auc_pool") > F.col("auc_own"))
    return out.withColumn("route", F.when(pooled, "pool").otherwise("own"))


def importance(d: DataFrame, top: int = 10) -> DataFrame:
    """The most important features of a forest by impurity."""
    names = resolve(d.columns)
    model = fit(d.filter("part <> 'test'"), "forest").stages[-1]
    rows = sorted(zip(names, map(float, model.featureImportances.toArray()), strict=True), key=lambda r: (-r[1], r[0]))[:top]
    return d.sparkSession.createDataFrame(rows, "feature string, importance double")


def permutation_importance(d: DataFrame, kind: str = "ridge", top: int = 10, seed: int = 42, parts: int = 64) -> DataFrame:
    """The features whose values matter most to a model: its area on test rows less that with one feature's values
    exchanged. Rows are dealt into ``parts`` by a hash, and each takes the value of the next in its part, so no task
    orders all rows."""
    names = resolve(d.columns)
    model = fit(d.filter("part <> 'test'"), kind)
    test = d.filter("part = 'test'").withColumn("_h", F.xxhash64(F.lit(seed), "ticker", "timestamp"))
    near = W.partitionBy(F.pmod("_h", F.lit(parts))).orderBy("_h", "timestamp")
    moved = written(test.withColumns({f"_{c}": F.coalesce(F.lead(c).over(near), F.first(c).over(near)) for c in names}), "moved")
    whole = ev.auc(with_p(model, moved), "p", "label").select(F.col("auc").alias("whole"))
    out = None
    for c in names:
        row = ev.auc(with_p(model, moved.drop(c).withColumnRenamed(f"_{c}", c)), "p", "label").select(F.lit(c).alias("feature"), "auc")
        out = row if out is None else out.unionByName(row)
    return out.crossJoin(whole).select("feature", (F.col("whole") - F.col("auc")).alias("importance")).orderBy(F.desc("importance"), "feature").limit(top)


def majority(d: DataFrame, y: str = "label") -> DataFrame:
    return d.agg(F.greatest(F.avg(y), 1 - F.avg(y)).alias("majority"))


#: Pairs that a join of all rows with all may make.
ALL_PAIRS = 5_000_000


def _nearest(pairs: DataFrame, names: tuple[str, ...], k: int) -> DataFrame:
    """The k nearest of pairs (i, names, q, at j, label_b): combined by parts of ``q`` first, so no task holds a row's all."""
    gap = sum((F.pow(F.col(c) - F.col(f"{c}_b"), F.lit(2)) for c in names), F.lit(0.0))
    first = W.partitionBy("i", "q").orderBy("gap", "j")
    cut = pairs.withColumn("gap", gap).withColumn("n", F.row_number().over(first)).filter(F.col("n") <= k)
    return cut.withColumn("n", F.row_number().over(W.partitionBy("i").orderBy("gap", "j"))).filter(F.col("n") <= k).drop("q")


def _neighbours(a: DataFrame, b: DataFrame, names: tuple[str, ...], k: int, all_pairs: int = ALL_PAIRS) -> DataFrame:
    """The k nearest rows of b (j, names, label) for each row of a (i, names), by squared distance; of alike ones the
    least j. Rows with a null in ``names`` are left out.

    Cells of a grid meet their neighbours by equality. A row whose k-th neighbour lies within one cell's width is done;
    the others try again with cells twice as wide, until few enough are left to meet every row. Of rows alike in all
    names the k + 1 least j are enough for any other row.
    """
    whole = lambda d: d.dropna(subset=list(names))
    a, b = written(whole(a), "query"), whole(b)
    alike = W.partitionBy(*names, "label").orderBy("i")
    b = b.withColumn("_nth", F.row_number().over(alike)).filter(F.col("_nth") <= k + 1).drop("_nth")
    other = written(b.toDF("j", *[f"{c}_b" for c in names], "label_b"), "others")
    size = other.agg(F.count(F.lit(1)).alias("n"), *[(F.max(f"{c}_b") - F.min(f"{c}_b")).alias(c) for c in names]).first()
    spans = [size[c] for c in names if size[c]]
    width = math.prod(spans) ** (1 / len(spans)) * (k / max(size.n, 1)) ** (1 / len(spans)) / 4 if spans else 1.0
    out, rest, left = None, a, a.count()
    while left:
        last = left * size.n <= all_pairs or not spans or width > 2 * max(spans)
        if last:
            pairs = rest.crossJoin(other.withColumn("q", F.pmod("j", F.lit(16)))).filter(F.col("i") != F.col("j"))
        else:
            cell = lambda c: F.floor(F.col(c) / width)  # noqa: E731, B023
            ask = rest.select("*", *[F.explode(F.array(*[cell(c) + x for x in (-1, 0, 1)])).alias(f"c{m}") if m == 0 else cell(c).alias(f"c{m}") for m, c in enumerate(names)])
            for m in range(1, len(names)):
                ask = ask.withColumn(f"c{m}", F.explode(F.array(*[F.col(f"c{m}") + x for x in (-1, 0, 1)])))
            held = other.select("*", *[cell(f"{c}_b").alias(f"c{m}") for m, c in enumerate(names)])
            cells = [f"c{m}" for m in range(len(names))]
            pairs = ask.join(held, cells).filter(F.col("i") != F.col("j")).withColumn("q", F.xxhash64(*cells)).drop(*cells)
        near = written(_nearest(pairs, names, k), "near")
        if not last:
            done = near.filter((F.col("n") == k) & (F.col("gap") < width * width * (1 - 1e-9))).select("i")
            near = near.join(done, "i", "left_semi")
            rest = written(rest.join(done, "i", "left_anti"), "rest")
            left = rest.count()
        else:
            left = 0
        out = near if out is None else out.unionByName(near)
        width *= 2
    return out if out is not None else _nearest(a.crossJoin(other.withColumn("q", F.lit(0))), names, k)


def resample(d: DataFrame, method: str, **kw) -> DataFrame:
    """Rows or weights against imbalance: balanced, smote, adasyn or focal."""
    if method == "balanced":
        return ev.class_weights(d.drop("weight"), kw.get("y", "label"))
    if method == "focal":
        return ev.focal_weights(d.drop("weight"), y=kw.get("y", "label"))
    if method not in ("smote", "adasyn"):
        raise ValueError(f"unknown method {method!r}")
    return smote(d, adaptive=method == "adasyn", **kw)


def smote(d: DataFrame, k: int = 5, y: str = "label", names: tuple[str, ...] = ("return", "rsi", "log_volume"), seed: int = 42, adaptive: bool = False) -> DataFrame:
    """New rows of the minority class, by interpolation to one of the k nearest of it, until the classes are even.

    ``adaptive``: rows with more of the other class among their k nearest get more new ones. Rows with a null
    in ``names`` have no neighbours and are no neighbours.
    """
    counts = {r[y]: r["count"] for r in d.groupBy(y).count().collect()}
    few = min(counts, key=lambda c: (counts[c], c))
    need = max(counts.values()) - counts[few]
    numbered = d.select(F.struct("timestamp", "ticker").alias("_at"), *names, F.col(y).alias("label"), F.lit(1).alias("_one"))
    every = written(running_sum(numbered, "_at", "_one", "i").select("i", *names, "label"), "numbered")
    own = every.filter(F.col("label") == few)
    near = _neighbours(own.drop("label"), own, names, k)
    if adaptive:
        hard = _neighbours(own.drop("label"), every, names, k).groupBy("i").agg(F.avg((F.col("label_b") != few).cast("double")).alias("hard"))
        near = near.join(hard, "i").filter("hard > 0")
    else:
        near = near.withColumn("hard", F.lit(1.0))
    # Rows are taken in turns: a row's t-th turn comes at (t - 1/2) / its share.
    turns = near.withColumn("turn", F.explode(F.sequence(F.lit(1), F.lit(max(1, -(-need // max(counts[few], 1)) * 2)))))
    key = (F.col("turn") + (F.col("n") - 1) / k) / F.col("hard")
    step = F.pmod(F.xxhash64(F.lit(seed), "i", "j", "turn"), F.lit(10_000)) / 10_000
    turns = turns.withColumns({"_key": F.struct(key.alias("k"), F.xxhash64(F.lit(seed), "j", "i").alias("h"), "i", "j", "turn"), "_one": F.lit(1)})
    new = running_sum(turns, "_key", "_one", "_o").filter(F.col("_o") <= need)
    return new.select(F.lit(few).alias(y), *[(F.col(c) + step * (F.col(f"{c}_b") - F.col(c))).alias(c) for c in names])


def search(d: DataFrame, trials: list[dict], kind: str = "forest", folds: int = 2) -> DataFrame:
    """Mean walk-forward area of each parameter set: (trial, auc), a driver loop over a few trials."""
    used = written(ev.walk_forward(d.filter("part <> 'test'").drop("part"), folds=folds), "folds")
    out = None
    for i, params in enumerate(trials):
        for f in range(folds):
            one = used.filter(F.col("fold") == f)
            model = fit(one.filter("part = 'train'"), kind, **params)
            row = ev.auc(with_p(model, one.filter("part = 'test'")), "p", "label").select(F.lit(i).alias("trial"), "auc")
            out = row if out is None else out.unionByName(row)
    return out.groupBy("trial").agg(F.avg("auc").alias("auc"))
