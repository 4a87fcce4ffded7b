"""Lexicon sentiment of news, its daily mean, and backward-looking features of a bar.

The score is the sum of a text's lexicon weights s as s / sqrt(s * s + 15). The lexicon is a table (word, weight) that
is joined to the words of the texts; the one here is bounded and broadcast. News of days without a bar are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import windows as w

#: Market terms and their weights.
MARKET = {
    "bullish": 2.5, "bearish": -2.5, "outperform": 2.2, "underperform": -2.2, "upgrade": 2.0, "downgrade": -2.0, "beat": 1.8,
    "miss": -1.8, "rally": 2.3, "selloff": -2.0, "surge": 2.0, "plunge": -2.2, "soar": 2.2, "tumble": -2.0, "skyrocket": 2.5,
    "crash": -3.0, "boom": 2.0, "slump": -2.0, "record": 1.5, "weakness": -1.2, "strong": 1.5, "weak": -1.2, "profit": 1.5,
    "loss": -1.5, "growth": 1.5, "decline": -1.5, "exceed": 1.5, "fell": -1.5, "raised": 1.3, "cut": -1.3, "guidance": 0.4,
    "earnings": 0.3, "revenue": 0.3, "eps": 0.3,
}
#: Words that turn the next ones around, and by how much; words that strengthen or weaken them.
NEGATIONS = (
    "aint", "arent", "cannot", "cant", "couldnt", "didnt", "doesnt", "dont", "hadnt", "hasnt", "havent", "isnt", "neither", "never", "no",
    "none", "nope", "nor", "not", "nothing", "nowhere", "rarely", "seldom", "shouldnt", "wasnt", "werent", "without", "wont", "wouldnt",
)
TURN = -0.74
STRONGER = ("absolutely", "completely", "considerably", "deeply", "enormously", "especially", "extremely", "greatly", "highly", "hugely", "incredibly", "intensely", "particularly", "really", "remarkably", "so", "substantially", "totally", "tremendously", "unusually", "very")
WEAKER = ("almost", "barely", "hardly", "less", "little", "marginally", "occasionally", "partly", "scarcely", "slightly", "somewhat")
BOOST = 0.293
#: How much a word counts one, two and three places before.
FADES = (1.0, 0.95, 0.9)


def lexicon(spark, words: dict[str, float] | None = None) -> DataFrame:
    return spark.createDataFrame(sorted((words or MARKET).items()), "word string, weight double")


def score(news: DataFrame, words: dict[str, float] | None = None) -> DataFrame:
    """News with counts of positive and negative words, their difference and the compound score."""
    spark = news.sparkSession
    text = F.lower(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("body", F.lit(""))))
    terms = news.select("doc_id", "ticker", "date", F.explode_outer(F.split(text, r"[\x20\x09-\x0D]+")).alias("t"))
    terms = terms.select("doc_id", "ticker", "date", F.regexp_replace("t", r"[^\p{L}]", "").alias("word"))
    joined = terms.join(F.broadcast(lexicon(spark, words)), "word", "left")
    s = F.coalesce(F.round(F.sum("weight"), 6), F.lit(0.0)) + 0.0
    out = joined.groupBy("doc_id", "ticker", "date").agg(
        F.sum(F.when(F.col("weight") > 0, 1).otherwise(0)).cast("long").alias("n_positive"),
        F.sum(F.when(F.col("weight") < 0, 1).otherwise(0)).cast("long").alias("n_negative"),
        s.alias("_s"),
    )
    return out.withColumns({"delta": F.col("n_positive") - F.col("n_negative"), "compound": F.col("_s") / F.sqrt(F.col("_s") * F.col("_s") + 15)}).drop("_s")


def polarity(news: DataFrame, words: dict[str, float] | None = None) -> DataFrame:
    """News with neg, neu, pos and compound by rules: of the three words before a scored one, those that strengthen or
    weaken it add or take ``BOOST`` (less from farther away), and each negation turns it by ``TURN``. The shares count a
    scored word as its score and one, any other as one. Not read: capitals, punctuation, emoticons, "but" and idioms.

    No text has shares of 0; a word joins the lexicon by a broadcast, and a text's words meet in its own task first.
    """
    text = F.lower(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("body", F.lit(""))))
    terms = F.filter(F.transform(F.split(text, r"[\x20\x09-\x0D]+"), lambda t: F.regexp_replace(t, r"[^\p{L}]", "")), lambda t: t != "")
    d = news.select("doc_id", "ticker", "date", terms.alias("_t"))
    before = lambda i, k: F.when(i >= k, F.get("_t", i - k))
    each = F.transform("_t", lambda t, i: F.struct(t.alias("word"), *[before(i, k).alias(f"b{k}") for k in (1, 2, 3)]))
    d = d.select("doc_id", "ticker", "date", F.explode_outer(each).alias("w")).select("doc_id", "ticker", "date", "w.*")
    d = d.join(F.broadcast(lexicon(news.sparkSession, words)), "word", "left")
    boost, turn = F.lit(0.0), F.lit(1.0)
    for k, fade in zip((1, 2, 3), FADES, strict=True):
        w = F.coalesce(F.col(f"b{k}"), F.lit(""))
        boost = boost + F.when(w.isin(*STRONGER), BOOST * fade).when(w.isin(*WEAKER), -BOOST * fade).otherwise(0.0)
        turn = turn * F.when(w.isin(*NEGATIONS), TURN).otherwise(1.0)
    d = d.withColumn("_s", (F.col("weight") + F.signum("weight") * boost) * turn)
    some = lambda c: F.coalesce(F.round(F.sum(c), 9), F.lit(0.0))
    g = d.groupBy("doc_id", "ticker", "date").agg(
        some("_s").alias("_sum"), some(F.when(F.col("_s") > 0, F.col("_s") + 1)).alias("_pos"), some(F.when(F.col("_s") < 0, 1 - F.col("_s"))).alias("_neg"),
        F.sum((F.col("word").isNotNull() & (F.coalesce("_s", F.lit(0.0)) == 0)).cast("double")).alias("_neu"),
    )
    total = F.col("_pos") + F.col("_neg") + F.col("_neu")
    share = lambda c: F.when(total > 0, F.round(F.col(c) / total, 3)).otherwise(0.0)
    return g.select("doc_id", "ticker", "date", share("_neg").alias("neg"), share("_neu").alias("neu"), share("_pos").alias("pos"), (F.col("_sum") / F.sqrt(F.col("_sum") * F.col("_sum") + 15)).alias("compound"))


def daily(scored: DataFrame) -> DataFrame:
    """Mean score and number of news by ticker and date."""
    return scored.groupBy("ticker", "date").agg(F.avg("compound").alias("compound"), F.count(F.lit(1)).alias("n"))


def add_features(bars: DataFrame, per_day: DataFrame) -> DataFrame:
    """Join the day's sentiment (0 where there is none) and add 15 features that look back only."""
    small = per_day.select(F.col("ticker").alias("_t"), F.col("date").alias("_date"), "compound", "n")
    d = bars.join(small, (F.col("ticker") == F.col("_t")) & (F.col("timestamp") == F.col("_date")), "left")
    d = d.withColumns({"sentiment_score": F.coalesce("compound", F.lit(0.0)), "sentiment_noticias": F.coalesce("n", F.lit(0)).cast("long")})
    at = w.trailing
    d = d.withColumns({
        "_change": F.col("sentiment_score") - w.lag("sentiment_score"), "_n": F.row_number().over(w.series()).cast("double"),
        "_crown": F.col("sentiment_score") * F.coalesce("return", F.lit(0.0)),
    })
    d = d.withColumns({
        "_up": F.coalesce(F.greatest("_change", F.lit(0.0)), F.lit(0.0)), "_down": F.coalesce(F.greatest(-F.col("_change"), F.lit(0.0)), F.lit(0.0)),
        "sentiment_change": F.coalesce("_change", F.lit(0.0)), "news_volume": F.col("sentiment_noticias"),
    })
    d = d.withColumns({
        "sentiment_ma5": F.avg("sentiment_score").over(at(5)), "sentiment_ma20": F.avg("sentiment_score").over(at(20)),
        "sentiment_ma60": F.avg("sentiment_score").over(at(60)), "sentiment_vol": F.coalesce(F.stddev_samp("sentiment_score").over(at(7)), F.lit(0.0)),
        "_sd20": F.coalesce(F.stddev_samp("sentiment_score").over(at(20)), F.lit(0.0)),
        "sentiment_trend": F.when(F.col("_n") >= 10, F.regr_slope("sentiment_score", "_n").over(at(10))).otherwise(0.0),
        "sentiment_rsi": 100 - 100 / (1 + F.avg("_up").over(at(14)) / (F.avg("_down").over(at(14)) + 1e-9)),
        "sentiment_crown": F.sum("_crown").over(at(5)), "news_volume_ma5": F.avg("sentiment_noticias").over(at(5)),
        "sentiment_extreme": F.sum((F.abs("sentiment_score") > 0.5).cast("long")).over(at(20)),
        "sentiment_change_ma5": F.avg("sentiment_change").over(at(5)),
    })
    d = d.withColumns({
        "sentiment_zscore": (F.col("sentiment_score") - F.col("sentiment_ma20")) / (F.col("_sd20") + 1e-9),
        "sentiment_vol_ratio": F.col("sentiment_vol") / (F.abs("sentiment_ma20") + 1e-9),
    })
    return d.drop("compound", "n", *[c for c in d.columns if c.startswith("_")])


def lexicon_sql(words: dict[str, float]) -> str:
    return "lexicon AS (SELECT * FROM (VALUES " + ", ".join(f"('{k}', {v}::DOUBLE)" for k, v in sorted(words.items())) + ") t(word, weight))"


def scored_sql(words: dict[str, float]) -> str:
    return lexicon_sql(words) + """, terms AS (
  SELECT doc_id, ticker, date, regexp_replace(unnest(regexp_split_to_array(lower(coalesce(title, '') || ' ' || coalesce(body, '')), '[\\x20\\x09-\\x0D]+')), '[^\\p{L}]', '', 'g') AS word FROM news
), s0 AS (
  SELECT doc_id, ticker, date, CAST(sum(CASE WHEN weight > 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_positive, CAST(sum(CASE WHEN weight < 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_negative,
    coalesce(round(sum(weight), 6), 0) + 0.0 AS s FROM terms LEFT JOIN lexicon USING (word) GROUP BY 1, 2, 3
), scored AS (SELECT *, n_positive - n_negative AS delta, s / sqrt(s * s + 15) AS compound FROM s0)"""


def polarity_sql(words: dict[str, float]) -> str:
    listed = lambda ws: "(" + ", ".join(f"'{w}'" for w in ws) + ")"
    boost = " + ".join(f"CASE WHEN b{k} IN {listed(STRONGER)} THEN {BOOST * f}::DOUBLE WHEN b{k} IN {listed(WEAKER)} THEN {-BOOST * f}::DOUBLE ELSE 0 END" for k, f in zip((1, 2, 3), FADES, strict=True))
    turn = " * ".join(f"CASE WHEN b{k} IN {listed(NEGATIONS)} THEN {TURN}::DOUBLE ELSE 1 END" for k in (1, 2, 3))
    return lexicon_sql(words) + f""", w0 AS (
  SELECT doc_id, ticker, date, list_filter(list_transform(regexp_split_to_array(lower(coalesce(title, '') || ' ' || coalesce(body, '')), '[\\x20\\x09-\\x0D]+'), lambda t: regexp_replace(t, '[^\\p{{L}}]', '', 'g')), lambda t: t <> '') AS w FROM news
), w1 AS (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM w0), w2 AS (SELECT doc_id, w[i] AS word, CASE WHEN i > 1 THEN w[i - 1] END AS b1, CASE WHEN i > 2 THEN w[i - 2] END AS b2, CASE WHEN i > 3 THEN w[i - 3] END AS b3 FROM w1),
w3 AS (SELECT doc_id, (weight + sign(weight) * ({boost})) * ({turn}) AS s FROM w2 LEFT JOIN lexicon USING (word)),
w4 AS (SELECT doc_id, coalesce(round(sum(s), 9), 0) AS total, coalesce(round(sum(s + 1) FILTER (s > 0), 9), 0) AS p, coalesce(round(sum(1 - s) FILTER (s < 0), 9), 0) AS n, count(*) FILTER (coalesce(s, 0) = 0) AS u FROM w3 GROUP BY 1),
polar AS (SELECT w0.doc_id, w0.ticker, w0.date, coalesce(round(n / nullif(p + n + u, 0), 3), 0) AS neg, coalesce(round(u / nullif(p + n + u, 0), 3), 0) AS neu, coalesce(round(p / nullif(p + n + u, 0), 3), 0) AS pos, coalesce(total / sqrt(total * total + 15), 0) AS compound FROM w0 LEFT JOIN w4 USING (doc_id))"""


DAILY_SQL = "daily AS (SELECT ticker, date, avg(compound) AS compound, count(*) AS n FROM scored GROUP BY 1, 2)"


def features_sql(over) -> str:
    return f"""q0 AS (SELECT base.*, coalesce(compound, 0) AS sentiment_score, coalesce(n, 0) AS sentiment_noticias FROM base LEFT JOIN daily ON base.ticker = daily.ticker AND base."timestamp" = daily.date),
q1 AS (SELECT *, sentiment_score - lag(sentiment_score) OVER s AS ch, CAST(row_number() OVER s AS DOUBLE) AS n, sentiment_score * coalesce("return", 0) AS cr FROM q0 {over()}),
q2 AS (SELECT *, coalesce(greatest(ch, 0), 0) AS up, coalesce(greatest(-ch, 0), 0) AS down, coalesce(ch, 0) AS sentiment_change, sentiment_noticias AS news_volume FROM q1),
q3 AS (SELECT *, avg(sentiment_score) OVER w5 AS sentiment_ma5, avg(sentiment_score) OVER w20 AS sentiment_ma20, avg(sentiment_score) OVER w60 AS sentiment_ma60,
  coalesce(stddev_samp(sentiment_score) OVER w7, 0) AS sentiment_vol, coalesce(stddev_samp(sentiment_score) OVER w20, 0) AS sd20,
  CASE WHEN n >= 10 THEN regr_slope(sentiment_score, n) OVER w10 ELSE 0 END AS sentiment_trend,
  100 - 100 / (1 + avg(up) OVER w14 / (avg(down) OVER w14 + 1e-9)) AS sentiment_rsi, sum(cr) OVER w5 AS sentiment_crown, avg(sentiment_noticias) OVER w5 AS news_volume_ma5,
  CAST(sum(CAST(abs(sentiment_score) > 0.5 AS INTEGER)) OVER w20 AS BIGINT) AS sentiment_extreme, avg(sentiment_change) OVER w5 AS sentiment_change_ma5 FROM q2 {over(5, 7, 10, 14, 20, 60)}),
features AS (SELECT *, (sentiment_score - sentiment_ma20) / (sd20 + 1e-9) AS sentiment_zscore, sentiment_vol / (abs(sentiment_ma20) + 1e-9) AS sentiment_vol_ratio FROM q3)"""
