"""Queries for splits, evaluation and models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import probability
from ..operators import evaluation as ev
from ..operators import indicators as ind
from ..operators import boosting, explain, learning, selection, tuning
from .adapters import PROBS, table
from .features import S, base, with_macro, with_sentiment
from .markets import probs
from .registry import Registry

R = Registry()
NUM = PROBS + f', num AS (SELECT *, row_number() OVER ({S}) - 1 AS n, count(*) OVER (PARTITION BY ticker) AS total FROM probs)'

R.table(
    "temporal_split", lambda s, d: ev.temporal_split(probs(s, d), 0.8, 0.2).groupBy("ticker", "part").agg(F.count(F.lit(1)).alias("n"), F.min("timestamp").alias("first"), F.max("timestamp").alias("last")), NUM,
    """(SELECT ticker, part, count(*) AS n, min("timestamp") AS "first", max("timestamp") AS "last" FROM (SELECT *, CASE WHEN n < floor(floor(total * 0.8) * 0.8) THEN 'train' WHEN n < floor(total * 0.8) THEN 'validate' ELSE 'test' END AS part FROM num) GROUP BY 1, 2)""",
    dict.fromkeys(["ticker", "part", "n", "first", "last"]),
)


def _folds(df: DataFrame) -> DataFrame:
    return df.groupBy("ticker", "fold", "part").agg(F.count(F.lit(1)).alias("n"), F.min("timestamp").alias("first"), F.max("timestamp").alias("last"))


FOLD_COLUMNS = dict.fromkeys(["ticker", "fold", "part", "n", "first", "last"])
WALK = NUM + """, f AS (SELECT num.*, fold, floor(total * 0.6) + fold * floor((total - floor(total * 0.6)) / 5) AS b, CASE WHEN fold = 4 THEN total ELSE floor(total * 0.6) + (fold + 1) * floor((total - floor(total * 0.6)) / 5) END AS e FROM num, (SELECT CAST(unnest(range(5)) AS INTEGER) AS fold))"""
for name, expand, low in (("walk_forward", True, "0"), ("walk_forward_rolling", False, "b - floor(total * 0.6)")):
    R.table(
        name, lambda s, d, x=expand: _folds(ev.walk_forward(probs(s, d), expand=x)), WALK,
        f"""(SELECT ticker, fold, part, count(*) AS n, min("timestamp") AS "first", max("timestamp") AS "last" FROM (SELECT *, CASE WHEN n >= b AND n < e THEN 'test' WHEN n < b AND n >= {low} THEN 'train' END AS part FROM f) WHERE part IS NOT NULL GROUP BY 1, 2, 3)""",
        FOLD_COLUMNS,
    )
PURGE = NUM + """, f AS (SELECT num.*, fold, fold * (total // 5) + least(fold, total % 5) AS b, (fold + 1) * (total // 5) + least(fold + 1, total % 5) AS e FROM num, (SELECT CAST(unnest(range(5)) AS INTEGER) AS fold))"""
for name, as_is, test, train in (
    ("purged_folds", False, "n >= b AND n < e", "n < b - floor((total // 5) * 0.05) OR n >= e + 5"),
    ("purged_folds_as_is", True, "n >= b + 5 + greatest(1, floor((e - b - 5) * 0.05)) AND n < e AND e = total", "NOT (n >= b AND n < e) AND e = total"),
):
    R.table(
        name, lambda s, d, x=as_is: _folds(ev.purged_folds(probs(s, d), as_is=x)), PURGE,
        f"""(SELECT ticker, fold, part, count(*) AS n, min("timestamp") AS "first", max("timestamp") AS "last" FROM (SELECT *, CASE WHEN {test} THEN 'test' WHEN {train} THEN 'train' END AS part FROM f) WHERE part IS NOT NULL GROUP BY 1, 2, 3)""",
        FOLD_COLUMNS,
    )

R.table(
    "auc", lambda s, d: ev.auc(probs(s, d)), PROBS + ", r AS (SELECT *, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS rk FROM probs), t AS (SELECT sum(rk) FILTER (y = 1)::DOUBLE AS s, sum(y)::DOUBLE AS pos, sum(1 - y)::DOUBLE AS neg, avg(CASE WHEN CAST(p >= 0.5 AS INTEGER) = y THEN 1.0 ELSE 0 END) AS accuracy, avg(pow(p - y, 2)) AS brier, avg(y) AS br FROM r)",
    "(SELECT (s - pos * (pos + 1) / 2) / (pos * neg) AS auc, accuracy, brier, greatest(br, 1 - br) AS majority FROM t)", {"auc": 6, "accuracy": 6, "brier": 6, "majority": 6},
)
R.table(
    "confusion", lambda s, d: ev.confusion(probs(s, d), "ticker"), PROBS + ", t AS (SELECT ticker, count(*) FILTER (p >= 0.5 AND y = 1) AS tp, count(*) FILTER (p >= 0.5 AND y = 0) AS fp, count(*) FILTER (p < 0.5 AND y = 1) AS fn, count(*) FILTER (p < 0.5 AND y = 0) AS tn FROM probs GROUP BY 1)",
    '(SELECT *, tp / (tp + fp) AS "precision", tp / (tp + fn) AS recall, 2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)) AS f1 FROM t)', {"ticker": None, "tp": None, "fp": None, "fn": None, "tn": None, "precision": 6, "recall": 6, "f1": 6},
)
CAL = PROBS + ", cal AS (SELECT least(CAST(floor(p * 20) AS INTEGER), 19) AS bin, count(*) AS n, avg(p) AS mean_p, avg(y) AS frequency FROM probs GROUP BY 1)"
R.table("calibration", lambda s, d: ev.calibration(probs(s, d)), CAL, "cal", {"bin": None, "n": None, "mean_p": 6, "frequency": 6})
R.table("calibration_error", lambda s, d: ev.ece(probs(s, d)), CAL, "(SELECT sum(n * abs(mean_p - frequency)) / sum(n) AS ece FROM cal)", {"ece": 6})
R.table(
    "confidence_buckets", lambda s, d: ev.confidence_buckets(probs(s, d)), PROBS + ", c AS (SELECT greatest(p, 1 - p) AS s, CASE WHEN CAST(p >= 0.5 AS INTEGER) = y THEN 1.0 ELSE 0 END AS ok FROM probs), b(bucket, lo, hi) AS (VALUES (0, 0.5::DOUBLE, 0.55::DOUBLE), (1, 0.55, 0.6), (2, 0.6, 0.7), (3, 0.7, 1.01))",
    "(SELECT bucket, lo, hi, count(s) AS n, avg(ok) AS \"precision\", 100 * count(s) / (SELECT count(*) FROM c) AS pct_days FROM b LEFT JOIN c ON s >= lo AND s < hi GROUP BY 1, 2, 3)", {"bucket": None, "lo": None, "hi": None, "n": None, "precision": 6, "pct_days": 6},
)
R.table(
    "top_quintile", lambda s, d: ev.top_share_precision(probs(s, d), "ticker"), PROBS + ', r AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY round(p, 9) DESC, "timestamp") AS r, greatest(floor(count(*) OVER (PARTITION BY ticker) * 0.2), 1) AS k FROM probs)',
    '(SELECT ticker, count(*) AS k, avg(y) AS "precision" FROM r WHERE r <= k GROUP BY 1)', {"ticker": None, "k": None, "precision": 6},
)
R.table(
    "best_f1_threshold", lambda s, d: ev.thresholds(probs(s, d)), PROBS + ", g AS (SELECT unnest([" + ", ".join(str(round(0.1 + 0.05 * k, 2)) for k in range(16)) + "])::DOUBLE AS threshold), t AS (SELECT threshold, count(*) FILTER (p >= threshold AND y = 1) AS tp, count(*) FILTER (p >= threshold AND y = 0) AS fp, count(*) FILTER (p < threshold AND y = 1) AS fn FROM probs, g GROUP BY 1), f AS (SELECT threshold, coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1 FROM t)",
    "(SELECT arg_max(threshold, (round(f1, 9), -threshold)) AS threshold, max(f1) AS score FROM f)", {"threshold": None, "score": 6},
)


def classes(s, d: str) -> DataFrame:
    """Three class probabilities from p, with the label; the first 60 % of each series calibrates."""
    p = ev.numbered(probs(s, d))
    p = p.withColumn("probs", F.array(F.col("p") * 0.8, (1 - F.col("p")) * 0.9, F.lit(1.0) - F.col("p") * 0.8 - (1 - F.col("p")) * 0.9))
    return p.withColumns({"y": F.when(F.col("_n") % 11 == 0, 2).otherwise(1 - F.col("y")), "cal": F.col("_n") < F.floor(F.col("_all") * 0.6)})


CLASSES = NUM + ", cl AS (SELECT [p * 0.8, (1 - p) * 0.9, 1.0 - p * 0.8 - (1 - p) * 0.9] AS probs, CASE WHEN n % 11 = 0 THEN 2 ELSE 1 - y END AS y, n < floor(total * 0.6) AS cal FROM num)"


def sets(method: str):
    def query(s, d: str) -> DataFrame:
        c = classes(s, d)
        return ev.coverage(ev.conformal(c.filter("cal"), c.filter("not cal"), 0.1, method))

    return query


def _conformal_sql(score: str, inside: str) -> str:
    return f""", q AS (SELECT s AS qhat FROM (SELECT s, row_number() OVER (ORDER BY s) AS r, count(*) OVER () AS n FROM (SELECT {score} AS s FROM cl WHERE cal)) WHERE r = least(ceil((n + 1) * (1 - 0.1)), n)),
    st AS (SELECT y, qhat, [{inside.format(k=1)}, {inside.format(k=2)}, {inside.format(k=3)}] AS st FROM cl, q WHERE NOT cal)"""


COVER = "(SELECT avg(CAST(st[y + 1] AS INTEGER)) AS coverage, avg(len(list_filter(st, lambda v: v))) AS mean_size, min(qhat) AS qhat FROM st)"
R.table("conformal_lac", sets("lac"), CLASSES + _conformal_sql("1 - probs[y + 1]", "probs[{k}] >= 1 - qhat"), COVER, {"coverage": 6, "mean_size": 6, "qhat": 6})
R.table(
    "conformal_aps", sets("aps"),
    CLASSES + _conformal_sql("list_sum(list_filter(probs, lambda v: v > probs[y + 1])) + probs[y + 1]", "coalesce(list_sum(list_filter(probs, lambda v: v > probs[{k}])), 0) <= qhat").replace("list_sum(list_filter(probs, lambda v: v > probs[y + 1])) +", "coalesce(list_sum(list_filter(probs, lambda v: v > probs[y + 1])), 0) +"),
    COVER, {"coverage": 6, "mean_size": 6, "qhat": 6},
)
R.table(
    "conformal_gate", lambda s, d: ev.gate(probs(s, d).withColumn("volatility", F.col("volatility") / 100)), PROBS + ", v AS (SELECT greatest(0.5, least(0.8, 0.6 - 0.5 * avg(volatility / 100))) AS t FROM probs)",
    "(SELECT min(t) AS threshold, count(*) FILTER (p >= t) AS passed, count(*) FILTER (p < t) AS filtered, avg(y) FILTER (p >= 0.6) AS precision_estimate, avg(CASE WHEN p < t THEN 1.0 ELSE 0 END) AS volume_impact FROM probs, v)",
    {"threshold": 6, "passed": None, "filtered": None, "precision_estimate": 6, "volume_impact": 6},
)


def _mi_sql(x: str) -> str:
    return f"""(SELECT sum(n / total * ln(n * total / (nb * nc))) FROM (SELECT n, sum(n) OVER (PARTITION BY b)::DOUBLE AS nb, sum(n) OVER (PARTITION BY y)::DOUBLE AS nc, sum(n) OVER ()::DOUBLE AS total FROM
      (SELECT least(CAST(floor((x - lo) / ((hi - lo) / 10)) AS INTEGER), 9) AS b, y, count(*) AS n FROM (SELECT {x} AS x, y, min({x}) OVER () AS lo, max({x}) OVER () AS hi FROM mi) WHERE x IS NOT NULL GROUP BY 1, 2)))"""


def mi_input(s, d: str) -> DataFrame:
    return probs(s, d).select("y", F.log("close").alias("a"), F.col("p").alias("b"))


R.table("mutual_information", lambda s, d: ev.mutual_information(mi_input(s, d), "a", "y"), PROBS + ", mi AS (SELECT y, ln(close) AS a, p AS b FROM probs)", f"(SELECT {_mi_sql('a')} AS mi)", {"mi": 6})
R.table(
    "interaction_discovery", lambda s, d: ev.interactions(mi_input(s, d), [("a", "b")], "y"), PROBS + ", mi AS (SELECT y, ln(close) AS a, p AS b FROM probs)",
    f"(SELECT 'a' AS a, 'b' AS b, {_mi_sql('a * b')} - greatest({_mi_sql('a')}, {_mi_sql('b')}) AS gain)", {"a": None, "b": None, "gain": 6},
)
FOCAL = "CASE WHEN y = 1 THEN 0.25 * pow(1 - p, 2) ELSE 0.75 * pow(p, 2) END"
R.table("focal_weights", lambda s, d: ev.focal_weights(probs(s, d)), PROBS, f"(SELECT ticker, \"timestamp\", {FOCAL} / (SELECT avg({FOCAL}) FROM probs) AS weight FROM probs)", {"ticker": None, "timestamp": None, "weight": 6})
R.table(
    "class_weights", lambda s, d: ev.class_weights(probs(s, d), "y").select("y", "weight").distinct(), PROBS,
    "(SELECT y, (SELECT count(*) FROM probs) / (2.0 * count(*)) AS weight FROM probs GROUP BY 1)", {"y": None, "weight": 6},
)
R.table(
    "recency_weights", lambda s, d: ev.recency_weights(probs(s, d), 250.0), PROBS, '(SELECT ticker, "timestamp", pow(0.5, (row_number() OVER (PARTITION BY ticker ORDER BY "timestamp" DESC) - 1) / 250.0) AS weight FROM probs)', {"ticker": None, "timestamp": None, "weight": 8},
)
R.table(
    "decayed_performance", lambda s, d: ev.decayed_performance(probs(s, d), "p", key="ticker"), PROBS + """, a AS (SELECT ticker, p, row_number() OVER (PARTITION BY ticker ORDER BY "timestamp" DESC) - 1 AS a FROM probs), m AS (SELECT ticker, sum(p * pow(0.9, a)) / sum(pow(0.9, a)) AS mean FROM a WHERE a < 20 GROUP BY 1)""",
    "(SELECT ticker, mean, (mean - min(mean) OVER () + 1e-6) / sum(mean - low + 1e-6) OVER () AS weight FROM m, (SELECT min(mean) AS low FROM m))", {"ticker": None, "mean": 6, "weight": 6},
)
R.table(
    "persistence_baseline", lambda s, d: ev.regression(ind.add_har(ind.add_labels(base(s, d))), "future_vol_10", "persistence_10"), PROBS + """, v AS (SELECT CASE WHEN count("return") OVER a = 10 THEN stddev_samp("return") OVER a END AS y, CASE WHEN count("return") OVER b = 10 THEN stddev_samp("return") OVER b END AS p FROM base
      WINDOW a AS (PARTITION BY ticker ORDER BY "timestamp" ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING), b AS (PARTITION BY ticker ORDER BY "timestamp" ROWS 9 PRECEDING)),
      r AS (SELECT *, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS rp FROM v WHERE y IS NOT NULL AND p IS NOT NULL)""",
    "(SELECT 1 - sum(pow(y - p, 2)) / (var_pop(y) * count(*)) AS r2, avg(abs(y - p)) AS mae, corr(ry, rp) AS spearman FROM r)", {"r2": 5, "mae": 5, "spearman": 6},
)
R.table(
    "probability_functions",
    lambda s, d: probability.applied(table(s, d, "lineitem").groupBy(F.col("l_linenumber").cast("int").alias("k"), (F.col("l_discount").cast("double") * 50).alias("mu")).agg(F.count(F.lit(1)).alias("n"))),
    "g AS (SELECT CAST(l_linenumber AS INTEGER) AS k, l_discount::DOUBLE * 50 AS mu, count(*) AS n FROM lineitem GROUP BY 1, 2)",
    "(SELECT k, mu, n, CASE WHEN mu <= 0 THEN CASE WHEN k = 0 THEN 1 ELSE 0 END ELSE exp(-mu + k * ln(mu) - lgamma(k + 1)) END AS pmf, 1 - exp(-mu * 0.8) AS saturating, 1 - exp(-mu / 0.03) AS over_under, greatest(0.05, least(0.95, 0.5 + 0.01 * k)) AS bounded FROM g)",
    {"k": None, "mu": 6, "n": None, "pmf": 8, "saturating": 8, "over_under": 8, "bounded": 8},
)

# Models: seeds and algorithms decide the values, so only rows are compared.


def features(s, d: str) -> DataFrame:
    return learning.prepare(ind.add_labels(base(s, d)))


def with_regime(s, d: str) -> DataFrame:
    """Features with the market regime of their day."""
    return learning.prepare(ind.add_labels(with_macro(s, d)))


def with_news(s, d: str) -> DataFrame:
    return learning.prepare(ind.add_labels(with_sentiment(s, d)))


R.rows_only("forest_classifier", lambda s, d: learning.scored(features(s, d), "forest"))
R.rows_only("boosted_classifier", lambda s, d: learning.scored(features(s, d), "boosted", rounds=20))
R.rows_only("elastic_net_classifier", lambda s, d: learning.scored(features(s, d), "elastic"))
R.rows_only("elastic_net_grid", lambda s, d: learning.elastic_grid(features(s, d)))
R.rows_only("calibrated_classifier", lambda s, d: learning.calibrated(features(s, d)))
R.rows_only("ensemble_weights", lambda s, d: learning.ensemble(features(s, d), ("forest", "elastic", "ridge")))
R.rows_only("stacked_classifier", lambda s, d: learning.stacked(features(s, d)))
R.rows_only("volatility_regressor", lambda s, d: learning.volatility(ind.add_har(ind.add_labels(base(s, d)))))
R.rows_only("regime_models", lambda s, d: learning.by_regime(with_regime(s, d)))
R.rows_only("pooled_routing", lambda s, d: learning.routing(features(s, d)))
R.rows_only("feature_importance", lambda s, d: learning.importance(features(s, d)))
R.rows_only("permutation_importance", lambda s, d: learning.permutation_importance(features(s, d)))
R.rows_only("smote", lambda s, d: learning.smote(learning.prepare(ind.add_labels(base(s, d), rise=0.05)).filter("part <> 'test'")))
R.rows_only("boosted_by_leaves", lambda s, d: boosting.scored(features(s, d), boosting.Settings(rounds=5, leaves=8, rate=0.2)))
R.rows_only("shap_importance", lambda s, d: explain.forest_importance(features(s, d), trees=50))
R.rows_only("hyperparameter_search", lambda s, d: learning.search(features(s, d), [{"reg": r, "mix": 0.0} for r in (0.01, 0.1, 1.0)], "elastic"))
R.rows_only("tpe_search", lambda s, d: tuning.search(features(s, d), {"reg": tuning.Number(1e-3, 10, log=True), "mix": tuning.Number(0, 1)}, "elastic", trials=8, folds=2))
R.rows_only("best_of_four", lambda s, d: selection.best_of(selection.candidates(with_news(s, d), rounds=20)))
R.rows_only("model_inspection", lambda s, d: selection.inspected(features(s, d)))
R.rows_only("latest_predictions", lambda s, d: selection.latest(features(s, d).unionByName(ind.add_labels(base(s, d)).filter("target is null"), allowMissingColumns=True), learning.routing(features(s, d))))
R.rows_only(
    "volatility_ablation",
    lambda s, d: selection.volatility_ablation(ind.add_har(ind.add_labels(base(s, d))), {"har": learning.HAR[:3], "har_ratios": learning.HAR[:5], "all": learning.HAR}),
)


def sentiment_runs(s, d: str) -> DataFrame:
    f = with_news(s, d)
    run = lambda x: learning.scored(x, "ridge").select("model", "auc", "accuracy")
    return selection.compare(run(f.drop(*learning.SENTIMENT)), run(f), ["model"], ["auc", "accuracy"])


R.rows_only("sentiment_comparison", sentiment_runs)

AREA = "((sum(rk) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * sum(1 - y)::DOUBLE))"
R.table(
    "overfit_check", lambda s, d: selection.overfit_check(ev.temporal_split(probs(s, d), 0.75), gap=0.01),
    NUM + """, sp AS (SELECT p, y, CASE WHEN n < floor(total * 0.75) THEN 'train' ELSE 'test' END AS part FROM num), rk AS (SELECT *, rank() OVER (PARTITION BY part ORDER BY p) + (count(*) OVER (PARTITION BY part, p) - 1) / 2.0 AS rk FROM sp)""",
    f"(SELECT *, CASE WHEN gap > 0.01 THEN 'overfitting' WHEN gap < -0.01 THEN 'suspect' ELSE 'ok' END AS verdict FROM (SELECT *, auc_train - auc_test AS gap FROM (SELECT {AREA} AS auc_train FROM rk WHERE part = 'train'), (SELECT {AREA} AS auc_test FROM rk WHERE part = 'test')))",
    {"auc_train": 6, "auc_test": 6, "gap": 6, "verdict": None},
)
SCORES = ["rsi", "volatility", "momentum_10"]


def sweep(s, d: str) -> DataFrame:
    return selection.horizon_sweep(base(s, d), SCORES)


SWEEP = PROBS + ", ys AS (SELECT *, " + ", ".join(f'CAST(lead(close, {h}) OVER ({S}) > close AS INTEGER) AS y{h}' for h in (1, 5, 10, 20)) + " FROM base), sw AS (" + " UNION ALL ".join(
    f"SELECT {h} AS horizon, '{c}' AS score, {AREA} AS auc, count(*) AS n FROM (SELECT y{h} AS y, rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS rk FROM ys WHERE {c} IS NOT NULL AND y{h} IS NOT NULL)" for h in (1, 5, 10, 20) for c in SCORES
) + ")"
R.table("horizon_sweep", sweep, SWEEP, "sw", {"horizon": None, "score": None, "auc": 6, "n": None})
R.table(
    "best_score_by_horizon", lambda s, d: selection.best_of(sweep(s, d).withColumnRenamed("score", "model"), ["horizon"]).filter("chosen"), SWEEP,
    "(SELECT * FROM (SELECT horizon, score AS model, auc, n, row_number() OVER (PARTITION BY horizon ORDER BY round(auc, 9) DESC, score) AS rank FROM sw) WHERE rank = 1)", {"horizon": None, "model": None, "auc": 6, "n": None},
)
CONF = ", " + ", ".join(f'{n} AS (SELECT ticker, count(*) FILTER (p >= {t} AND y = 1) / nullif(count(*) FILTER (p >= {t}), 0) AS "precision", count(*) FILTER (p >= {t} AND y = 1) / nullif(count(*) FILTER (y = 1), 0) AS recall FROM probs GROUP BY 1)' for n, t in (("lo", 0.5), ("hi", 0.55)))
R.table(
    "run_comparison", lambda s, d: selection.compare(ev.confusion(probs(s, d), "ticker"), ev.confusion(probs(s, d), "ticker", threshold=0.55), ["ticker"], ["precision", "recall"]), PROBS + CONF,
    '(SELECT lo.ticker, lo."precision", hi."precision" AS precision_other, round(hi."precision" - lo."precision", 4) AS precision_delta, lo.recall, hi.recall AS recall_other, round(hi.recall - lo.recall, 4) AS recall_delta FROM lo JOIN hi USING (ticker))',
    {"ticker": None, "precision": 6, "precision_other": 6, "precision_delta": 3, "recall": 6, "recall_other": 6, "recall_delta": 3},
)
R.table(
    "annual_volatility", lambda s, d: selection.annualised(ind.add_har(base(s, d)).select("ticker", "timestamp", "volatility"), "volatility"), PROBS,
    '(SELECT ticker, "timestamp", volatility * sqrt(252.0::DOUBLE) AS volatility_year FROM base)', {"ticker": None, "timestamp": None, "volatility_year": 6},
)
R.table(
    "group_means", lambda s, d: ev.group_means(probs(s, d).withColumn("variant", F.dayofmonth("timestamp") % 3), ["variant"], ["p", "y"]), PROBS,
    '(SELECT CAST(day("timestamp") % 3 AS INTEGER) AS variant, avg(p) AS p, avg(y) AS y FROM probs GROUP BY 1)', {"variant": None, "p": 4, "y": 4},
)
