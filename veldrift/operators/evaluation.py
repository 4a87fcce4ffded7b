"""Temporal splits, folds, and the evaluation of probabilities: ranking, calibration, conformal sets, thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.prefix import running_sum
from .profiling import average_ranks


def numbered(d: DataFrame, key: str = "ticker", time: str = "timestamp") -> DataFrame:
    """Adds the row number from 0 (_n) and the number of rows (_all) of each key."""
    return d.withColumns({"_n": F.row_number().over(W.partitionBy(key).orderBy(time)) - 1, "_all": F.count(F.lit(1)).over(W.partitionBy(key))})


def temporal_split(d: DataFrame, train: float = 0.8, validate: float = 0.0, key: str = "ticker", time: str = "timestamp") -> DataFrame:
    """Adds part: the first rows of each key train, the last ``validate`` of those validate, the rest test."""
    d = numbered(d, key, time)
    cut = F.floor(F.col("_all") * train)
    inner = F.floor(cut * (1 - validate))
    return d.withColumn("part", F.when(F.col("_n") < inner, "train").when(F.col("_n") < cut, "validate").otherwise("test")).drop("_n", "_all")


def walk_forward(d: DataFrame, folds: int = 5, start: float = 0.6, least_train: int = 100, least_test: int = 15, expand: bool = True, key: str = "ticker", time: str = "timestamp") -> DataFrame:
    """A row for each row's use in each fold: fold, part. Tests follow one another after ``start``; the last takes the
    rest. Training is all that comes before, or, rolling, as many rows as the first fold's. Folds too small are left out."""
    d = numbered(d, key, time).withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
    first = F.floor(F.col("_all") * start)
    step = F.floor((F.col("_all") - first) / folds)
    begin = first + F.col("fold") * step
    end = F.when(F.col("fold") == folds - 1, F.col("_all")).otherwise(begin + step)
    low = F.lit(0) if expand else begin - first
    part = F.when((F.col("_n") >= begin) & (F.col("_n") < end), "test").when((F.col("_n") < begin) & (F.col("_n") >= low), "train")
    ok = (begin - low >= least_train) & (end - begin >= least_test)
    return d.withColumn("part", part).filter(ok & F.col("part").isNotNull()).drop("_n", "_all")


def purged_folds(d: DataFrame, folds: int = 5, embargo: int = 5, purge: float = 0.05, as_is: bool = False, key: str = "ticker", time: str = "timestamp") -> DataFrame:
    """K folds in time order. Rows up to ``purge`` of a fold before a test, and ``embargo`` rows after it, do not train.

    ``as_is``: all other rows train; tests keep only rows over ``embargo`` rows past the last training row, without the
    first ``purge`` of them, which leaves tests in the last fold alone.
    """
    d = numbered(d, key, time).withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
    size, extra = F.floor(F.col("_all") / folds), F.col("_all") % folds  # the first folds take one more
    begin = F.col("fold") * size + F.least(F.col("fold").cast("long"), extra)
    end = begin + size + (F.col("fold") < extra).cast("int")
    inside = (F.col("_n") >= begin) & (F.col("_n") < end)
    if as_is:
        left = end - begin - embargo
        test = inside & (end == F.col("_all")) & (F.col("_n") >= begin + embargo + F.greatest(F.lit(1), F.floor(left * purge)))
        train = ~inside & (end == F.col("_all"))
    else:
        test = inside
        train = (F.col("_n") < begin - F.floor(size * purge)) | (F.col("_n") >= end + embargo)
    return d.withColumn("part", F.when(test, "test").when(train, "train")).filter("part is not null").drop("_n", "_all")


def auc(d: DataFrame, p: str = "p", y: str = "y") -> DataFrame:
    """Area under the curve by average ranks, accuracy at 0.5, Brier score, base rate: one row."""
    r = average_ranks(d.filter(F.col(p).isNotNull() & F.col(y).isNotNull()), p)
    s = r.agg(
        F.sum(F.when(F.col(y) == 1, F.col("rank"))).alias("s"), F.sum((F.col(y) == 1).cast("double")).alias("pos"), F.sum((F.col(y) == 0).cast("double")).alias("neg"),
        F.avg(((F.col(p) >= 0.5).cast("int") == F.col(y)).cast("double")).alias("accuracy"), F.avg(F.pow(F.col(p) - F.col(y), F.lit(2))).alias("brier"), F.avg(y).alias("base_rate"),
    )
    area = F.try_divide(F.col("s") - F.col("pos") * (F.col("pos") + 1) / 2, F.col("pos") * F.col("neg"))
    return s.select(area.alias("auc"), "accuracy", "brier", F.greatest("base_rate", 1 - F.col("base_rate")).alias("majority"))


def group_means(d: DataFrame, by: list[str], metrics: list[str], digits: int = 4) -> DataFrame:
    """Means of metrics by variant, rounded."""
    return d.groupBy(*by).agg(*[F.round(F.avg(m), digits).alias(m) for m in metrics])


def confusion(d: DataFrame, key: str, p: str = "p", y: str = "y", threshold: float = 0.5) -> DataFrame:
    """Counts, precision, recall and F1 of the positive class by key."""
    hit = F.col(p) >= threshold
    n = lambda c: F.sum(c.cast("long"))
    s = d.groupBy(key).agg(n(hit & (F.col(y) == 1)).alias("tp"), n(hit & (F.col(y) == 0)).alias("fp"), n(~hit & (F.col(y) == 1)).alias("fn"), n(~hit & (F.col(y) == 0)).alias("tn"))
    s = s.withColumns({"precision": F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), "recall": F.try_divide(F.col("tp"), F.col("tp") + F.col("fn"))})
    return s.withColumn("f1", F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def calibration(d: DataFrame, bins: int = 20, p: str = "p", y: str = "y") -> DataFrame:
    """Counts, mean probability and frequency of each bin."""
    at = F.least(F.floor(F.col(p) * bins).cast("int"), F.lit(bins - 1))
    return d.groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("mean_p"), F.avg(y).alias("frequency"))


def ece(d: DataFrame, bins: int = 20, p: str = "p", y: str = "y") -> DataFrame:
    c = calibration(d, bins, p, y)
    return c.agg((F.sum(F.col("n") * F.abs(F.col("mean_p") - F.col("frequency"))) / F.sum("n")).alias("ece"))


#: Confidence buckets, from and to.
BUCKETS = [(0.50, 0.55), (0.55, 0.60), (0.60, 0.70), (0.70, 1.01)]


def confidence_buckets(d: DataFrame, p: str = "p", y: str = "y") -> DataFrame:
    """n, precision and share of days of each bucket of confidence; empty buckets stay, without a precision."""
    sure = F.greatest(F.col(p), 1 - F.col(p))
    right = ((F.col(p) >= 0.5).cast("int") == F.col(y)).cast("double")
    spark = d.sparkSession
    table = spark.createDataFrame([(i, lo, hi) for i, (lo, hi) in enumerate(BUCKETS)], "bucket int, lo double, hi double")
    at = F.coalesce(*[F.when((sure >= lo) & (sure < hi), i) for i, (lo, hi) in enumerate(BUCKETS)])
    got = d.select(at.alias("bucket"), right.alias("right")).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.avg("right").alias("precision"))
    total = got.agg(F.sum("n").alias("total"))
    return table.join(F.broadcast(got), "bucket", "left").crossJoin(F.broadcast(total)).select("bucket", "lo", "hi", F.coalesce("n", F.lit(0)).alias("n"), "precision", (100 * F.coalesce("n", F.lit(0)) / F.col("total")).alias("pct_days"))


def top_share_precision(d: DataFrame, key: str, share: float = 0.2, p: str = "p", y: str = "y", time: str = "timestamp") -> DataFrame:
    """Precision among each key's most probable rows, at least one."""
    w = W.partitionBy(key)
    r = d.withColumns({"_r": F.row_number().over(w.orderBy(F.desc(F.round(p, 9)), time)), "_k": F.greatest(F.floor(F.count(F.lit(1)).over(w) * share), F.lit(1))})
    return r.filter("_r <= _k").groupBy(key).agg(F.count(F.lit(1)).alias("k"), F.avg(y).alias("precision"))


def thresholds(d: DataFrame, p: str = "p", y: str = "y", by: str = "f1") -> DataFrame:
    """The first best threshold of 0.10 to 0.85 in steps of 0.05 by f1, accuracy, precision or recall."""
    grid = F.array(*[F.lit(round(0.10 + 0.05 * k, 2)) for k in range(16)])
    d = d.select(F.col(p).alias("p"), F.col(y).alias("y"), F.explode(grid).alias("threshold")).withColumn("hit", F.col("p") >= F.col("threshold"))
    n = lambda c: F.sum(c.cast("double"))
    s = d.groupBy("threshold").agg(n(F.col("hit") & (F.col("y") == 1)).alias("tp"), n(F.col("hit") & (F.col("y") == 0)).alias("fp"), n(~F.col("hit") & (F.col("y") == 1)).alias("fn"), F.count(F.lit(1)).alias("n"))
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    s = s.withColumns({"precision": zero(F.try_divide(F.col("tp"), F.col("tp") + F.col("fp"))), "recall": zero(F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")))})
    s = s.withColumns({"f1": zero(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))), "accuracy": 1 - (F.col("fp") + F.col("fn")) / F.col("n")})
    return s.agg(F.max_by(F.struct("threshold", F.col(by).alias("score")), F.struct(F.round(by, 9).alias("s"), (-F.col("threshold")).alias("t"))).alias("b")).select("b.*")


# Conformal prediction over arrays of class probabilities


def order_statistic(scores: DataFrame, alpha: float) -> DataFrame:
    """The ceil((n + 1)(1 - alpha))-th smallest score, at most the largest: (qhat)."""
    n = scores.agg(F.count(F.lit(1)).alias("_n"))
    # Scores are counted by value, so only different values are ordered.
    by = scores.groupBy("score").agg(F.count(F.lit(1)).alias("c"))
    k = F.least(F.ceil((F.col("_n") + 1) * (1 - alpha)), F.col("_n"))
    return running_sum(by, "score", "c", "_at").crossJoin(F.broadcast(n)).filter(F.col("_at") >= k).agg(F.min("score").alias("qhat"))


def aps_score(probs: Column, y: Column) -> Column:
    """Sum of the probabilities from the largest down to the true class."""
    own = F.get(probs, y)
    order = F.array_sort(F.transform(probs, lambda p, i: F.struct((-p).alias("p"), i.alias("i"))))
    upto = F.filter(order, lambda s: (s["p"] < -own) | ((s["p"] == -own) & (s["i"] <= y)))
    return F.aggregate(upto, F.lit(0.0), lambda a, s: a - s["p"])


def lac_score(probs: Column, y: Column) -> Column:
    return 1 - F.get(probs, y)


def prediction_set(probs: Column, qhat: Column, method: str) -> Column:
    """Booleans by class. lac: probability at least 1 - qhat. aps: from the largest down until the sum passes qhat."""
    if method == "lac":
        return F.transform(probs, lambda p: p >= 1 - qhat)
    order = lambda: F.array_sort(F.transform(probs, lambda p, i: F.struct((-p).alias("p"), i.alias("i"))))
    before = lambda p, i: F.aggregate(F.filter(order(), lambda s: (s["p"] < -p) | ((s["p"] == -p) & (s["i"] < i))), F.lit(0.0), lambda a, s: a - s["p"])
    return F.transform(probs, lambda p, i: before(p, i) <= qhat)


def conformal(calibrate: DataFrame, test: DataFrame, alpha: float = 0.1, method: str = "lac") -> DataFrame:
    """Test rows (probs, y) with their sets, from scores of calibration rows."""
    if method not in ("lac", "aps"):
        raise ValueError(f"method must be lac or aps, not {method!r}")
    score = lac_score if method == "lac" else aps_score
    q = order_statistic(calibrate.select(score(F.col("probs"), F.col("y")).alias("score")), alpha)
    return test.crossJoin(F.broadcast(q)).withColumn("set", prediction_set(F.col("probs"), F.col("qhat"), method))


def coverage(sets: DataFrame) -> DataFrame:
    size = F.size(F.filter("set", lambda x: x))
    return sets.agg(F.avg(F.get("set", F.col("y")).cast("double")).alias("coverage"), F.avg(size).alias("mean_size"), F.first("qhat").alias("qhat"))


def gate(d: DataFrame, p: str = "p", y: str = "y", vol: str = "volatility", base: float = 0.6) -> DataFrame:
    """passed, filtered, precision at the base threshold, and the counts at the volatility-adjusted one."""
    mean = d.agg(F.avg(vol).alias("_v"))
    adjusted = F.greatest(F.lit(0.5), F.least(F.lit(0.8), base - 0.5 * F.col("_v")))
    d = d.crossJoin(F.broadcast(mean)).withColumns({"_base": F.col(p) >= base, "_adj": F.col(p) >= adjusted, "_t": adjusted})
    return d.agg(
        F.first("_t").alias("threshold"), F.sum(F.col("_adj").cast("long")).alias("passed"), F.sum((~F.col("_adj")).cast("long")).alias("filtered"),
        F.coalesce(F.avg(F.when(F.col("_base"), F.col(y).cast("double"))), F.lit(0.0)).alias("precision_estimate"), F.avg((~F.col("_adj")).cast("double")).alias("volume_impact"),
    )


def mutual_information(d: DataFrame, x: str, y: str, bins: int = 10) -> DataFrame:
    """Mutual information in nats of equal-width bins of x and of y."""
    ends = d.agg(F.min(x).alias("_lo"), F.max(x).alias("_hi"))
    at = F.when(F.col("_hi") == F.col("_lo"), 0).otherwise(F.least(F.floor((F.col(x) - F.col("_lo")) / ((F.col("_hi") - F.col("_lo")) / bins)).cast("int"), F.lit(bins - 1)))
    c = d.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).crossJoin(F.broadcast(ends)).groupBy(at.alias("b"), F.col(y).alias("c")).agg(F.count(F.lit(1)).alias("n"))
    w = W.partitionBy
    c = c.withColumns({"nb": F.sum("n").over(w("b")), "nc": F.sum("n").over(w("c")), "all": F.sum("n").over(w(F.lit(1)))})
    return c.agg(F.sum(F.col("n") / F.col("all") * F.log(F.col("n") * F.col("all") / (F.col("nb") * F.col("nc")))).alias("mi"))


def interactions(d: DataFrame, pairs: list[tuple[str, str]], y: str) -> DataFrame:
    """Gain of each pair's product over the better of its columns in mutual information: (a, b, gain)."""
    out = None
    for a, b in pairs:
        one = mutual_information(d, a, y).toDF("ma").crossJoin(mutual_information(d, b, y).toDF("mb"))
        both = mutual_information(d.withColumn("_ab", F.col(a) * F.col(b)), "_ab", y).toDF("mab")
        row = one.crossJoin(both).select(F.lit(a).alias("a"), F.lit(b).alias("b"), (F.col("mab") - F.greatest("ma", "mb")).alias("gain"))
        out = row if out is None else out.unionByName(row)
    return out


def focal_weights(d: DataFrame, p: str = "p", y: str = "y", gamma: float = 2.0, alpha: float = 0.25) -> DataFrame:
    """alpha (1 - p_true)^gamma, scaled to mean 1: the scale is one aggregated number."""
    pt = F.when(F.col(y) == 1, F.col(p)).otherwise(1 - F.col(p))
    raw = F.when(F.col(y) == 1, alpha).otherwise(1 - alpha) * F.pow(1 - pt, F.lit(gamma))
    mean = d.agg(F.avg(raw).alias("_m"))
    return d.crossJoin(F.broadcast(mean)).withColumn("weight", raw / F.col("_m")).drop("_m")


def class_weights(d: DataFrame, y: str) -> DataFrame:
    """n / (classes * n of the class) as a column."""
    by = d.groupBy(y).agg(F.count(F.lit(1)).alias("_c"))
    by = by.crossJoin(F.broadcast(by.agg(F.sum("_c").alias("_n"), F.count(F.lit(1)).alias("_k")))).select(y, (F.col("_n") / (F.col("_k") * F.col("_c"))).alias("weight"))
    return d.join(F.broadcast(by), y)


def recency_weights(d: DataFrame, halflife: float, key: str = "ticker", time: str = "timestamp") -> DataFrame:
    age = F.row_number().over(W.partitionBy(key).orderBy(F.desc(time))) - 1
    return d.withColumn("weight", F.pow(F.lit(0.5), age / halflife))


def decayed_performance(d: DataFrame, score: str, alpha: float = 0.9, window: int = 20, key: str = "model", time: str = "timestamp") -> DataFrame:
    """Weight of each model: the mean of its last scores with weights alpha^age, shifted to positive and normalised."""
    age = F.row_number().over(W.partitionBy(key).orderBy(F.desc(time))) - 1
    r = d.filter(F.col(score).isNotNull()).withColumn("_a", age).filter(F.col("_a") < window)
    m = r.groupBy(key).agg((F.sum(F.col(score) * F.pow(F.lit(alpha), F.col("_a"))) / F.sum(F.pow(F.lit(alpha), F.col("_a")))).alias("mean"))
    every = W.partitionBy(F.lit(1))
    m = m.withColumn("_s", F.col("mean") - F.min("mean").over(every) + 1e-6)
    return m.select(key, "mean", (F.col("_s") / F.sum("_s").over(every)).alias("weight"))


def paired_folds(a: DataFrame, b: DataFrame, key: str = "fold", x: str = "auc") -> DataFrame:
    """Mean difference of two fold tables with its 95 % bounds and the share of folds won."""
    d = a.select(key, F.col(x).alias("xa")).join(b.select(key, F.col(x).alias("xb")), key).withColumn("d", F.col("xa") - F.col("xb"))
    se = F.stddev_samp("d") / F.sqrt(F.count(F.lit(1)))
    m = F.avg("d")
    return d.agg(m.alias("mean"), (m - 1.96 * se).alias("low"), (m + 1.96 * se).alias("high"), F.avg((F.col("d") > 0).cast("double")).alias("won"))


def regression(d: DataFrame, y: str, p: str) -> DataFrame:
    """R2, mean absolute error and Spearman's rho of predictions."""
    d = d.filter(F.col(y).isNotNull() & F.col(p).isNotNull())
    mean = d.agg(F.avg(y).alias("_m"))
    s = d.crossJoin(F.broadcast(mean)).agg(
        (1 - F.sum(F.pow(F.col(y) - F.col(p), F.lit(2))) / F.sum(F.pow(F.col(y) - F.col("_m"), F.lit(2)))).alias("r2"), F.avg(F.abs(F.col(y) - F.col(p))).alias("mae")
    )
    from .profiling import spearman

    return s.crossJoin(spearman(d, y, p).select(F.col("statistic").alias("spearman")))
