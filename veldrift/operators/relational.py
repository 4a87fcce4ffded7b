"""Row, join and set operators that features and reports are built from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: The columns of a finished feature table, in order.
ML_READY = [
    "timestamp", "close", "high", "low", "open", "volume", "return", "volatility", "rsi", "hl_range", "oc_range", "ma_50", "ma_200",
    "log_volume", "vwap", "vwap_ratio", "lag_1", "lag_5", "lag_20", "target",
]


def ml_ready(features: DataFrame, key: str = "ticker") -> DataFrame:
    """The fixed columns with their key: complete rows that have a future."""
    return features.select(key, *ML_READY).dropna()


def sample(df: DataFrame, n: int, key: list[str], seed: int = 42) -> DataFrame:
    """n rows, the same ones in every run: the least by a hash of their key."""
    return df.orderBy(F.xxhash64(F.lit(seed), *key), *key).limit(n)


def tidy_names(df: DataFrame) -> DataFrame:
    """Lower-case names with underscores for other characters."""
    import re

    return df.toDF(*[re.sub(r"[^a-z0-9]+", "_", c.lower()).strip("_") for c in df.columns])


def flatten(df: DataFrame, sep: str = "_") -> DataFrame:
    """Fields of struct columns as columns of their own."""
    cols: list[Column] = []
    for f in df.schema:
        if f.dataType.typeName() == "struct":
            cols += [F.col(f"`{f.name}`")[g].alias(f"{f.name}{sep}{g}") for g in f.dataType.names]
        else:
            cols.append(F.col(f"`{f.name}`"))
    return df.select(*cols)


def clean(df: DataFrame, fill: float = 0.0) -> DataFrame:
    """NaN, infinities and nulls of float columns as ``fill``."""
    floats = [c for c, t in df.dtypes if t in ("double", "float")]
    bad = lambda c: F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    return df.withColumns({c: F.when(bad(c), fill).otherwise(F.col(c)) for c in floats})


def forward_fill(df: DataFrame, columns: list[str], key: str, time: str, default: float = 0.0) -> DataFrame:
    cum = W.partitionBy(key).orderBy(time).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumns({c: F.coalesce(F.last(c, ignorenulls=True).over(cum), F.lit(default)) for c in columns})


def one_hot(df: DataFrame, column: str) -> DataFrame:
    """A 0/1 column for each value but the first in order. The values are the column's distinct ones, a few."""
    values = [r[0] for r in df.select(column).distinct().filter(F.col(column).isNotNull()).orderBy(column).limit(1001).collect()]
    if len(values) > 1000:
        raise ValueError(f"{column} has over 1000 values")
    return df.withColumns({f"{column}_{v}": F.when(F.col(column) == v, 1).otherwise(0) for v in values[1:]})


def standardise(df: DataFrame, columns: list[str], train: Column) -> DataFrame:
    """Columns less the training rows' mean, by their population deviation; a constant column becomes 0."""
    stats = df.filter(train).agg(*[f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    out = df.crossJoin(F.broadcast(stats))  # one row
    scaled = {c: F.when(F.col(f"_s_{c}") > 0, (F.col(c) - F.col(f"_m_{c}")) / F.col(f"_s_{c}")).otherwise(0.0) for c in columns}
    return out.withColumns(scaled).select(*df.columns)


def binned(df: DataFrame, x: str, bins: int = 10) -> DataFrame:
    """Equal-width bins from the least to the largest value, both included."""
    ends = df.agg(F.min(x).alias("_lo"), F.max(x).alias("_hi"))
    at = F.when(F.col("_lo") == F.col("_hi"), 0).otherwise(F.least(F.floor((F.col(x) - F.col("_lo")) / ((F.col("_hi") - F.col("_lo")) / bins)).cast("int"), F.lit(bins - 1)))
    return df.crossJoin(F.broadcast(ends)).withColumn(f"{x}_bin", at).drop("_lo", "_hi")


def union_keep_first(frames: list[DataFrame], subset: list[str], order: list[Column]) -> DataFrame:
    """All rows, of those alike in ``subset`` the first by order; earlier frames come first."""
    out = None
    for i, f in enumerate(frames):
        f = f.withColumn("_frame", F.lit(i))
        out = f if out is None else out.unionByName(f, allowMissingColumns=True)
    w = W.partitionBy(*subset).orderBy("_frame", *order)
    return out.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n", "_frame")


def not_in(df: DataFrame, key: str, other: DataFrame, other_key: str) -> DataFrame:
    """Rows whose key is not among the other table's, as NOT IN has it: a null there keeps none, a null key is kept only if
    the other table is empty."""
    keys = other.select(F.col(other_key).alias("_key"))
    has = keys.agg(F.count(F.lit(1)).alias("_n"), F.count("_key").alias("_known"))  # one row
    out = df.join(keys, F.col(key) == F.col("_key"), "left_anti").crossJoin(F.broadcast(has))
    return out.filter((F.col("_n") == 0) | ((F.col("_n") == F.col("_known")) & F.col(key).isNotNull())).drop("_n", "_known")


def last_rows(df: DataFrame, n: int, key: str = "ticker", time: str = "timestamp") -> DataFrame:
    w = W.partitionBy(key).orderBy(F.desc(time))
    return df.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n).drop("_n")


def capped(df: DataFrame, by: str, order: list[Column], most: int) -> DataFrame:
    """At most ``most`` rows of each group, by order."""
    w = W.partitionBy(by).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= most).drop("_n")


def export(df: DataFrame, key: str = "ticker", time: str = "timestamp", columns: list[str] | None = None) -> DataFrame:
    """One JSON array of each key's points in time order; a series is one value, so keep series bounded."""
    fields = columns or [c for c in df.columns if c not in (key, time)]
    points = F.array_sort(F.collect_list(F.struct(time, *fields)))
    return df.groupBy(key).agg(F.to_json(points).alias("series"))


def compare(a: DataFrame, b: DataFrame, on: str, columns: list[str]) -> DataFrame:
    """Both tables' columns side by side with differences."""
    left = a.select(on, *[F.col(c).alias(f"{c}_a") for c in columns])
    right = b.select(on, *[F.col(c).alias(f"{c}_b") for c in columns])
    return left.join(right, on).withColumns({f"{c}_delta": F.round(F.col(f"{c}_b") - F.col(f"{c}_a"), 4) for c in columns})
