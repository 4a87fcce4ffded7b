"""Quality rules: fixed limits, then gradient-boosted trees over document statistics.

The trees are grown here in numpy on a bounded sample of labelled rows (``max_labelled``), with monotonic
constraints on chosen statistics, and flattened into node arrays that score a batch of documents at once.
Statistics come from whole texts. Null text: no words. An empty or missing label table leaves the fixed limits alone.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_chunks, fresh

WINDOW = 8
SYMBOLS = b"#*$%&|<>"
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
#: Model inputs; -1: the score may only fall as the input grows.
FEATURES = {
    "log_words": 0, "word_length": 0, "symbols": -1, "dup_lines": -1, "repeats": -1,
    "digits": -1, "upper": 0, "punctuation": 0, "lines": 0, "distinct_words": 0,
}


def _repeated(words: list[bytes], owner: np.ndarray, n_docs: int) -> np.ndarray:
    """Words of each document that lie in windows found twice or more in the same document."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return np.zeros(n_docs, np.int64)
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    w = np.zeros(n, np.uint64)
    for k in range(WINDOW):
        w = w * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n]
    w ^= owner[:n].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    at = np.flatnonzero(owner[:n] == owner[WINDOW - 1 :])
    order = at[np.argsort(w[at])]
    s = w[order]
    same = s[1:] == s[:-1]
    hit = np.zeros(len(s), bool)
    hit[1:] = same
    hit[:-1] |= same
    step = np.zeros(len(words) + 1, np.int64)
    np.add.at(step, order[hit], 1)
    np.add.at(step, order[hit] + WINDOW, -1)
    return np.bincount(owner, weights=np.cumsum(step[:-1]) > 0, minlength=n_docs).astype(np.int64)


def document_statistics(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Counts (one row per text, columns as in ``STATS``) and model inputs (columns as in ``FEATURES``)."""
    counts, inputs = [np.zeros((0, 5), np.int64)], [np.zeros((0, len(FEATURES)))]
    for chunk in byte_chunks([b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]):
        split = [b.split() for b in chunk]
        sizes = np.array([len(x) for x in split], np.int64)
        c = np.zeros((len(chunk), 5), np.int64)
        x = np.zeros((len(chunk), len(FEATURES)))
        c[:, 0] = sizes
        c[:, 4] = _repeated([w for ws in split for w in ws], np.repeat(np.arange(len(chunk)), sizes), len(chunk))
        for i, b in enumerate(chunk):
            of = np.bincount(np.frombuffer(b, np.uint8), minlength=256)
            points = of[:128].sum() + of[192:].sum()
            c[i, 1] = points - of[list(SPACES)].sum()
            c[i, 2] = of[list(SYMBOLS)].sum()
            lines = [line for line in b.split(b"\n") if line.strip(SPACES)]
            c[i, 3] = len(lines) - len(set(lines))
            letters = of[65:91].sum() + of[97:123].sum() + of[192:].sum()
            x[i, 5:] = (
                of[48:58].sum() / max(points, 1), of[65:91].sum() / max(letters, 1),
                (of[33:48].sum() + of[58:65].sum() - of[list(SYMBOLS)].sum()) / max(points, 1),
                len(lines) / max(sizes[i], 1), len(set(split[i])) / max(sizes[i], 1),
            )
            x[i, 3] = c[i, 3] / max(len(lines), 1)
        n = np.maximum(sizes, 1)
        x[:, 0] = np.log1p(sizes)
        x[:, 1] = c[:, 1] / n
        x[:, 2] = c[:, 2] / np.maximum(c[:, 1], 1)
        x[:, 4] = c[:, 4] / n
        counts.append(c)
        inputs.append(x)
    return np.concatenate(counts), np.concatenate(inputs)


@dataclass(frozen=True)
class Trees:
    """Flattened trees: one row per tree, one column per node of a complete binary tree."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    depth: int
    base: float
    threshold: float

    def score(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for f, c, v in zip(self.feature, self.cut, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, f[node]] > c[node])
            out += v[node]
        return 1 / (1 + np.exp(-out))


def fit_trees(
    x: np.ndarray, y: np.ndarray, monotone: np.ndarray, rounds: int = 40, depth: int = 3, rate: float = 0.2,
    bins: int = 64, l2: float = 1.0, max_lost: float = 0.005,
) -> Trees:
    """Boosted trees for log loss. A split that breaks a constraint is refused, and children keep to its sides.

    The verdict's threshold is the largest up to 0.5 that loses at most ``max_lost`` of the good rows.
    """
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T, strict=True)], axis=1)
    p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(p / (1 - p)))
    raw = np.full(len(y), base)
    nodes = 2 ** (depth + 1) - 1
    trees = []
    for _ in range(rounds):
        prob = 1 / (1 + np.exp(-raw))
        g, h = prob - y, prob * (1 - prob)
        feature, cut, value = np.zeros(nodes, np.int64), np.full(nodes, np.inf), np.zeros(nodes)
        todo = [(0, np.arange(len(y)), -np.inf, np.inf, 0)]
        while todo:
            node, rows, lo, hi, level = todo.pop()
            weight = lambda G, H: np.clip(-G / (H + l2), lo, hi)  # noqa: B023, E731, N803
            value[node] = weight(g[rows].sum(), h[rows].sum())
            best = (1e-6, None)
            for f in range(x.shape[1]) if level < depth else ():
                G = np.cumsum(np.bincount(binned[rows, f], g[rows], len(cuts[f]) + 1))
                H = np.cumsum(np.bincount(binned[rows, f], h[rows], len(cuts[f]) + 1))
                left, right = weight(G[:-1], H[:-1]), weight(G[-1] - G[:-1], H[-1] - H[:-1])
                loss = lambda w, G, H: G * w + (H + l2) * w * w / 2  # noqa: E731, N803
                gain = loss(value[node], G[-1], H[-1]) - loss(left, G[:-1], H[:-1]) - loss(right, G[-1] - G[:-1], H[-1] - H[:-1])
                ok = (H[:-1] > 1) & (H[-1] - H[:-1] > 1) & ((right - left) * monotone[f] >= 0)
                gain = np.where(ok, gain, -np.inf)
                if len(gain) and gain.max() > best[0]:
                    k = int(gain.argmax())
                    best = (gain[k], (f, k, left[k], right[k]))
            if best[1] is None:  # the rows go left all the way down, to this node's value
                down = node
                for _ in range(level, depth):
                    down = 2 * down + 1
                    value[down] = value[node]
                continue
            f, k, left, right = best[1]
            feature[node], cut[node] = f, cuts[f][k]
            mid, goes = (left + right) / 2, binned[rows, f] > k
            lo_left, hi_left, lo_right, hi_right = lo, hi, lo, hi
            if monotone[f] < 0:
                lo_left, hi_right = mid, mid
            elif monotone[f] > 0:
                hi_left, lo_right = mid, mid
            todo += [(2 * node + 1, rows[~goes], lo_left, hi_left, level + 1), (2 * node + 2, rows[goes], lo_right, hi_right, level + 1)]
        trees.append((feature, cut, value * rate))
        t = Trees(*(np.array([a]) for a in trees[-1]), depth, 0.0, 0.5)
        s = t.score(x)
        raw += np.log(s / (1 - s))
    model = Trees(*(np.array(a) for a in zip(*trees, strict=True)), depth, base, 0.5)
    good = np.sort(model.score(x[y > 0.5]))
    threshold = min(0.5, float(good[int(max_lost * len(good))])) if len(good) else 0.0
    return Trees(model.feature, model.cut, model.value, depth, base, threshold)


def statistics_udf(model: Trees | None, model_inputs: bool = False):
    """Arrow UDF: text to its counts, the model's score and the verdicts (and the inputs, for fitting)."""
    schema = STATS + ", base_failed boolean, score double, kept boolean" + (", x array<double>" if model_inputs else "")

    @F.pandas_udf(schema)
    def stats(texts: pd.Series) -> pd.DataFrame:
        c, x = document_statistics(texts.tolist())
        failed = (c[:, 0] < 20) | (100 * c[:, 4] > 30 * c[:, 0])
        score = np.ones(len(x)) if model is None else model.score(x)
        out = pd.DataFrame(c, columns=[f.split()[0] for f in STATS.split(", ")])
        out["base_failed"], out["score"] = failed, score
        out["kept"] = ~failed & (True if model is None else score >= model.threshold)
        return out.assign(x=list(x)) if model_inputs else out

    return stats


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = 20_000) -> Trees | None:
    """Fit on at most ``max_labelled`` labelled documents, chosen by a hash of doc_id; None without both classes."""
    some = (
        labels.filter("doc_id is not null and quality in (0, 1)")
        .groupBy("doc_id").agg(F.min("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    )
    rows = (
        docs.select("doc_id", "text").join(F.broadcast(some), "doc_id")
        .select("quality", "doc_id", statistics_udf(None, True)("text").alias("s"))
        .select("quality", "doc_id", "s.x")
        .orderBy(F.xxhash64("doc_id"), "doc_id", F.col("x")).limit(2 * max_labelled).toPandas()
    )
    if rows.quality.nunique() < 2:
        return None
    return fit_trees(np.stack(rows.x), rows.quality.to_numpy(float), np.array(list(FEATURES.values())))


def score_documents(docs: DataFrame, labels: DataFrame, max_labelled: int = 20_000) -> DataFrame:
    """Statistics and verdict of every document, one row per row. Null text has no words, so it fails.

    Columns: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score, kept.
    """
    model = fit(docs, labels, max_labelled)
    return docs.select("doc_id", statistics_udf(model)("text").alias("s")).select("doc_id", "s.*")


def keep_good(docs: DataFrame, labels: DataFrame, max_labelled: int = 20_000) -> DataFrame:
    """The documents whose verdict is kept, with their columns."""
    model = fit(docs, labels, max_labelled)
    (name,) = fresh(docs, "verdict")
    return docs.withColumn(name, statistics_udf(model)("text")["kept"]).filter(F.col(name)).select(*[f"`{c}`" for c in docs.columns])
