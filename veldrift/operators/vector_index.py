"""Approximate vector search: an inverted file of k-means cells with product codes of the residuals, re-ranked exactly.

Vectors are scaled to length 1. Cells and codebooks are fit on a bounded sample; every vector is indexed. A query visits its
``probes`` nearest cells; there a vector's score is looked up from its code, a byte for each of ``pieces`` parts of the
residual. The best ``refine`` times k of a query then get their exact score. Both numbers are tuned on some queries.
A task holds about ``PART`` codes of all cells and a block of queries. ``retrieval.vector_search`` is the exact
way.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.prefix import written
from .retrieval import dot, top, unit, vector_search

PART = 50_000
#: Rows that cells and codebooks are fit on at most, and cells at most.
SAMPLE, CELLS = 20_000, 4096


@dataclass(frozen=True)
class Index:
    """``rows``: cell, part, id, code, v (of length 1). ``centres``: cells x dim; ``books``: pieces x codes x dim of a piece."""

    rows: DataFrame
    centres: np.ndarray
    books: np.ndarray
    parts: np.ndarray


def codebook(x: np.ndarray, codes: int, rounds: int = 10, seed: int = 0) -> np.ndarray:
    """Lloyd's rounds from rows of ``x``; fewer different rows than codes are all kept."""
    rng = np.random.default_rng(seed)
    c = np.unique(x[rng.permutation(len(x))[: 4 * codes]], axis=0)
    c = c[rng.permutation(len(c))[:codes]]
    for _ in range(rounds):
        near = closest(x, c)
        n = np.bincount(near, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return np.concatenate([c, np.repeat(c[:1], codes - len(c), axis=0)])


def closest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((c * c).sum(axis=1) / 2 - x @ c.T).argmin(axis=1)


def _pieces(x: np.ndarray, count: int) -> np.ndarray:
    """Rows x pieces x dim of a piece; the last piece is filled up with zeros."""
    wide = -(-x.shape[1] // count)
    return np.pad(x, ((0, 0), (0, wide * count - x.shape[1]))).reshape(len(x), count, wide)


def build(vectors: DataFrame, cells: int | None = None, pieces: int = 8, codes: int = 256, seed: int = 42) -> Index:
    """An index of (id, v): about as many cells as the root of the number of vectors. Null and empty vectors are left out;
    so are those of another length than the first by id."""
    rows = written(vectors.filter("id is not null and size(v) > 0").select("id", unit(F.col("v")).alias("v")), "unit")
    first = rows.agg(F.count(F.lit(1)).alias("n"), F.min_by(F.size("v"), "id").alias("dim")).first()
    if not first["n"]:
        raise ValueError("nothing to index")
    rows = rows.filter(F.size("v") == first["dim"])
    share = F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, SAMPLE / first["n"]))
    sample = written(rows.filter(share).limit(2 * SAMPLE), "sample")
    k = min(cells or max(1, round(first["n"] ** 0.5)), CELLS, sample.count())
    fitted = KMeans(k=max(k, 2), maxIter=10, seed=seed, initMode="random", featuresCol="f").fit(sample.select(array_to_vector("v").alias("f")))
    centres = np.array(fitted.clusterCenters())
    x = np.array([r.v for r in sample.select("v").collect()])  # at most twice SAMPLE rows
    books = np.stack([codebook(p, codes, seed=seed) for p in _pieces(x - centres[closest(x, centres)], pieces).transpose(1, 0, 2)])

    @F.pandas_udf("cell int, code binary")
    def coded(v: pd.Series) -> pd.DataFrame:
        a = np.stack(v.to_numpy())
        cell = closest(a, centres)
        residual = _pieces(a - centres[cell], pieces)
        code = np.stack([closest(residual[:, j], books[j]) for j in range(pieces)], axis=1).astype(np.uint8)
        return pd.DataFrame({"cell": cell.astype(np.int32), "code": [c.tobytes() for c in code]})

    placed = written(rows.select("id", "v", coded("v").alias("c")).select("id", "v", "c.*"), "cells")
    sizes = {r.cell: r["count"] for r in placed.groupBy("cell").count().collect()}  # a row for each cell
    parts = np.array([max(1, -(-sizes.get(c, 0) // PART)) for c in range(len(centres))])
    number = F.element_at(F.array(*[F.lit(int(p)) for p in parts]), F.col("cell") + 1)
    return Index(placed.withColumn("part", F.pmod(F.xxhash64("id"), number).cast("int")), centres, books, parts)


def tuned(index: Index, queries: DataFrame, k: int, block: int, aim: float = 0.96, trials: int = 200) -> tuple[int, int]:
    """Probes and refine that reach a recall of ``aim`` on up to ``trials`` of the queries, held against the exact search of
    the indexed rows: the cells that hold the exact rows tell the probes, then refine doubles until the recall is there."""
    some = written(queries.orderBy(F.xxhash64("query_id"), "query_id").limit(trials), "trials")
    exact = written(vector_search(index.rows.select("id", "v"), some, k).select("query_id", "id"), "exact")
    cells = exact.join(index.rows.select("id", "cell"), "id").join(some.select("query_id", unit(F.col("q")).alias("q")), "query_id")
    held = cells.filter(F.size("q") == index.centres.shape[1]).select("q", "cell").collect()  # at most trials * k rows
    if not held:
        return 16, 10
    scores = np.stack([r.q for r in held]) @ index.centres.T
    own = scores[np.arange(len(held)), [r.cell for r in held]]
    places = np.sort((scores > own[:, None]).sum(axis=1))
    probes = max(16, int(places[min(len(places) - 1, int(np.ceil((aim + 1) / 2 * len(places))))]) + 1)
    refine, n = 10, index.rows.count()
    while refine * k < n:
        found = search(index, some, k, probes, refine, block=block)
        if recall(found, exact).first()["recall"] >= aim:
            break
        refine *= 2
    return probes, refine


def search(index: Index, queries: DataFrame, k: int, probes: int | None = None, refine: int | None = None, keep: Column | None = None, block: int = 2048) -> DataFrame:
    """(query_id, id, score, rank): the cosine top k of (query_id, q) among the cells visited; ``keep`` filters rows first.
    Probes and refine that are not given are ``tuned`` to the data."""
    if probes is None or refine is None:
        found = tuned(index, queries, k, block)
        probes, refine = probes or found[0], refine or found[1]
    centres, books = index.centres, index.books

    @F.pandas_udf("array<int>")
    def visited(q: pd.Series) -> pd.Series:
        near = np.argsort(-(np.stack(q.to_numpy()) @ centres.T), axis=1, kind="stable")[:, :probes]
        return pd.Series(list(near.astype(np.int32)))

    asked = queries.select("query_id", unit(F.col("q")).alias("q")).filter(F.size("q") == centres.shape[1])
    asked = written(asked, "asked")
    # A block of queries meets a share of the rows, of all cells, at a time; so a task keeps the best of many cells.
    shares, blocks = (F.lit(max(1, -(-n // most))) for n, most in ((index.rows.count(), PART), (asked.count(), block)))
    visits = asked.select("query_id", "q", visited("q").alias("cells"), F.pmod(F.xxhash64("query_id"), blocks).cast("int").alias("block"))
    visits = written(visits, "visits").withColumn("share", F.explode(F.sequence(F.lit(0), shares.cast("int") - 1)))
    held = index.rows if keep is None else index.rows.filter(keep)
    held = held.select("cell", "id", "code", F.pmod(F.xxhash64("id"), shares).cast("int").alias("share"))
    held = held.withColumn("block", F.explode(F.sequence(F.lit(0), blocks.cast("int") - 1)))
    most = refine * k
    kinds = f"query_id {queries.schema['query_id'].dataType.simpleString()}, id {index.rows.schema['id'].dataType.simpleString()}, guess double"

    def looked_up(q: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if q.empty or rows.empty:
            return pd.DataFrame({"query_id": [], "id": [], "guess": []})
        rows = rows.sort_values("cell")
        cell, ids = rows["cell"].to_numpy(), rows["id"].to_numpy()
        starts, ends = (np.searchsorted(cell, np.arange(len(centres)), side) for side in ("left", "right"))
        code = np.frombuffer(b"".join(rows["code"]), np.uint8).reshape(len(rows), -1)
        out = []
        for query, v, cells in zip(q["query_id"], q["q"], q["cells"], strict=True):
            table = np.einsum("pd,pcd->pc", _pieces(v[None], len(books))[0], books)
            at = np.concatenate([np.arange(starts[c], ends[c]) for c in cells])
            if not len(at):
                continue
            guess = (centres @ v)[cell[at]] + table[np.arange(len(books)), code[at]].sum(axis=1)
            # Equal vectors have equal guesses, so all ties of the last are there to choose from by id.
            best = np.flatnonzero(guess >= np.partition(guess, -most)[-most]) if len(guess) > most else np.arange(len(guess))
            best = best[np.lexsort((ids[at[best]], -guess[best]))][:most]
            out.append(pd.DataFrame({"query_id": query, "id": ids[at[best]], "guess": guess[best]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "id": [], "guess": []})

    near = visits.groupBy("share", "block").cogroup(held.groupBy("share", "block")).applyInPandas(looked_up, kinds)
    order = W.partitionBy("query_id").orderBy(F.desc("guess"), "id")
    near = written(near.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= most).select("query_id", "id"), "near")
    exact = near.join(index.rows.select("id", "v"), "id").join(asked, "query_id")
    return top(exact.select("query_id", "id", dot(F.col("v"), F.col("q")).alias("score")), k)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: the number of queries and the share of the exact rows (query_id, id) that were found."""
    hit = exact.select("query_id", "id").join(found.select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left")
    return hit.agg(F.count_distinct("query_id").alias("queries"), F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))
