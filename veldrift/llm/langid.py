"""Language identification by a byte convolutional network.

Bytes are embedded, filters of several widths slide over fixed-length windows, each filter keeps its maximum in a
window, and a softmax layer gives the languages' probabilities. Filters move by ``STRIDE`` bytes. The network is trained
here in numpy, on a bounded sample of labelled documents. A text is cut into windows that cover all of it; its probabilities are the windows' mean,
weighted by their bytes. Nothing but the text is an input.

Defined results: null text, and text without a letter, is ``und`` with score 0; a text shorter than a window is padded;
without labelled documents all are ``und``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

WINDOW = 256
STRIDE = 2
#: Widths of the filters and how many of each.
FILTERS = {3: 12, 5: 20}
EMBEDDING = 8
SPREAD = 4
LETTER = regex.compile(r"\p{L}")


@dataclass
class Network:
    embed: np.ndarray  # 256 x EMBEDDING
    filters: np.ndarray  # widest width * EMBEDDING x filters; narrower filters are zero at the end
    bias: np.ndarray
    dense: np.ndarray
    dense_bias: np.ndarray
    classes: list[str]

    def forward(self, windows: np.ndarray) -> tuple[np.ndarray, ...]:
        """windows: n x WINDOW bytes. The patches, each filter's best place and value, and the probabilities."""
        wide = max(FILTERS)
        e = self.embed[windows]
        p = sliding_window_view(e.reshape(len(e), -1), wide * EMBEDDING, axis=1)[:, :: STRIDE * EMBEDDING]
        p = np.ascontiguousarray(p).reshape(-1, wide * EMBEDDING)
        conv = (p @ self.filters).reshape(len(windows), -1, len(self.bias))
        best = conv.max(axis=1) + self.bias
        hidden = np.maximum(best, 0)
        z = hidden @ self.dense + self.dense_bias
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return p, conv, hidden, z / z.sum(axis=1, keepdims=True)


def windows_of(data: bytes, width: int = WINDOW) -> np.ndarray:
    """All of a text in windows; the last one is padded with zeros."""
    n = max(1, -(-len(data) // width))
    return np.frombuffer(data.ljust(n * width, b"\0"), np.uint8).reshape(n, width)


def some_windows(data: bytes) -> np.ndarray:
    """At most ``SPREAD`` windows, spread evenly over the text."""
    w = windows_of(data)
    return w[np.unique(np.linspace(0, len(w) - 1, SPREAD).astype(int))]


def train(windows: list[np.ndarray], langs: list[str], epochs: int = 6, batch: int = 64, rate: float = 4e-3, seed: int = 0) -> Network:
    """Adam on cross-entropy over the windows of each text; languages count alike."""
    rng = np.random.default_rng(seed)
    classes = sorted(set(langs))
    x = np.concatenate(windows)
    y = np.repeat([classes.index(lang) for lang in langs], [len(w) for w in windows])
    weight = (len(y) / (len(classes) * np.maximum(np.bincount(y, minlength=len(classes)), 1)))[y].astype(np.float32)
    wide, count = max(FILTERS), sum(FILTERS.values())
    mask = np.zeros((wide * EMBEDDING, count), np.float32)
    at = 0
    for width, k in FILTERS.items():
        mask[: width * EMBEDDING, at : at + k] = 1
        at += k
    normal = lambda *shape, s: rng.normal(0, s, shape).astype(np.float32)
    net = Network(
        normal(256, EMBEDDING, s=0.5), normal(wide * EMBEDDING, count, s=0.2) * mask, np.zeros(count, np.float32),
        normal(count, len(classes), s=0.2), np.zeros(len(classes), np.float32), classes,
    )
    names = ["embed", "filters", "bias", "dense", "dense_bias"]
    m, v = ({k: np.zeros_like(getattr(net, k)) for k in names} for _ in range(2))
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for s in range(0, len(y), batch):
            rows = order[s : s + batch]
            w = x[rows]
            p, conv, hidden, prob = net.forward(w)
            d = prob.copy()
            d[np.arange(len(rows)), y[rows]] -= 1
            d *= weight[rows, None] / len(rows)
            dh = (d @ net.dense.T) * (hidden > 0)
            place = conv.argmax(axis=1)  # rows x filters
            patch = p.reshape(len(rows), -1, wide * EMBEDDING)[np.arange(len(rows))[:, None], place]
            g = {
                "dense": hidden.T @ d, "dense_bias": d.sum(0), "bias": dh.sum(0),
                "filters": np.einsum("rf,rfp->pf", dh, patch) * mask, "embed": np.zeros_like(net.embed),
            }
            back = (dh[:, :, None] * net.filters.T[None]).reshape(-1, wide, EMBEDDING)
            bytes_at = w[np.arange(len(rows))[:, None, None], place[:, :, None] * STRIDE + np.arange(wide)].reshape(-1, wide)
            np.add.at(g["embed"], bytes_at, back)
            step += 1
            for k in names:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                a = rate * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                setattr(net, k, (getattr(net, k) - a * m[k] / (np.sqrt(v[k]) + 1e-8)).astype(np.float32))
    return net


def predict(net: Network | None, texts: list[str | None], rows: int = 256) -> tuple[list[str], np.ndarray]:
    """Language and its probability for each text; ``rows`` windows at a time."""
    langs, scores = ["und"] * len(texts), np.zeros(len(texts))
    if net is None:
        return langs, scores
    mean = np.zeros((len(texts), len(net.classes)))
    todo: list[np.ndarray] = []
    owner: list[np.ndarray] = []
    held = 0

    def flush() -> None:
        nonlocal held
        if held:
            w, of = np.concatenate(todo), np.concatenate(owner)
            for s in range(0, len(w), rows):
                size = (w[s : s + rows] != 0).sum(axis=1, keepdims=True)
                np.add.at(mean, of[s : s + rows], net.forward(w[s : s + rows])[3] * size)
            todo.clear()
            owner.clear()
            held = 0

    lettered = [t is not None and LETTER.search(t) is not None for t in texts]
    for i, t in enumerate(texts):
        if lettered[i]:
            w = windows_of(t.encode("utf-8", "surrogatepass"))
            todo.append(w)
            owner.append(np.full(len(w), i))
            held += len(w)
            if held > 8192:
                flush()
    flush()
    for i in np.flatnonzero(lettered):
        k = int(mean[i].argmax())
        langs[i] = net.classes[k]
        scores[i] = mean[i, k] / max(mean[i].sum(), 1e-12)
    return langs, np.clip(scores, 0, 1)


def held_out(doc_id) -> object:
    """True for documents kept from training: crc32 of doc_id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, max_labelled: int = 3000, max_rows: int = 60_000) -> Network | None:
    """Train on a bounded sample: of each language at most ``max_labelled`` documents, least by a hash of doc_id, or
    ``max_rows`` divided by the number of languages if that is less, and of each document at most ``SPREAD`` windows
    spread over the whole text. Every language is learned, from one document at least.

    The least are taken by language and part of the hash's range first, so no task sorts a whole language.
    """
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    n_langs = rows.agg(F.countDistinct("lang")).first()[0]
    if not n_langs:
        return None
    most = max(1, min(max_labelled, max_rows // n_langs))
    first = lambda *by: F.row_number().over(W.partitionBy("lang", *by).orderBy("h", "doc_id"))
    ids = rows.select("lang", "doc_id", F.xxhash64("doc_id").alias("h")).withColumn("part", F.pmod("h", F.lit(64)))
    ids = ids.withColumn("n", first("part")).filter(F.col("n") <= most)  # at most 64 times the sample
    ids = ids.withColumn("n", first()).filter(F.col("n") <= most).select("doc_id").distinct()

    def spread(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: some_windows(t.encode("utf-8", "surrogatepass")).tobytes() if LETTER.search(t) else None)

    windows = F.pandas_udf(spread, "binary")
    some = rows.select("lang", "doc_id", "text").join(F.broadcast(ids), "doc_id")  # at most max_rows ids, or one a language
    sample = some.select("lang", "doc_id", windows("text").alias("w")).filter("w is not null").toPandas()
    if not len(sample):
        return None
    sample = sample.sort_values(["doc_id", "lang", "w"])
    return train([np.frombuffer(w, np.uint8).reshape(-1, WINDOW) for w in sample.w], sample.lang.tolist())


def identify(docs: DataFrame, max_labelled: int = 3000) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, lang_pred, score."""
    net = fit(docs, max_labelled)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            langs, scores = predict(net, texts.tolist())
            yield pd.DataFrame({"lang_pred": langs, "score": scores})

    guess = F.pandas_udf(run, "lang_pred string, score double")
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), guess("text").alias("p")).select(
        "doc_id", "held_out", "p.*"
    )
