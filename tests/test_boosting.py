"""Leaf-wise boosting against a plain grower that splits one leaf at a time on all rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from veldrift.operators import boosting, explain

NAMES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(0)
    x = np.round(rng.normal(size=(700, 3)), 1)
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 0) | (rng.random(700) < 0.1)).astype(float)
    rows = [(i, *map(float, v), float(t), 1.0 + i % 3, "train" if i < 500 else "test") for i, (v, t) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(rows, "id int, a double, b double, c double, label double, weight double, part string").repartition(3).cache()


def plain_tree(x, g, h, features, s):
    """(path, feature, bin) of the splits in order, and the leaves' (path, value)."""
    worth = lambda a, b: boosting.shrunk(a, s.l1) ** 2 / (b + s.l2)

    def best(rows, path):
        top = (0.0, -1, -1)
        for f in features if len(path) < s.depth else ():
            for k in range(s.bins - 1):
                left = rows & (x[:, f] <= k)
                right = rows & (x[:, f] > k)
                if min(left.sum(), right.sum()) < s.least_rows or min(h[left].sum(), h[right].sum()) < s.least_hessian:
                    continue
                gain = round(worth(g[left].sum(), h[left].sum()) + worth(g[right].sum(), h[right].sum()) - worth(g[rows].sum(), h[rows].sum()), 9)
                if gain > max(top[0], 1e-9):
                    top = (gain, f, k)
        return top

    leaves = {"": np.ones(len(x), bool)}
    gains = {"": best(leaves[""], "")}
    splits = []
    while len(leaves) < s.leaves:
        path = min(leaves, key=lambda p: (-gains[p][0], p))
        gain, f, k = gains[path]
        if gain <= 0:
            break
        rows = leaves.pop(path)
        splits.append((path, f, k))
        for side, part in (("0", rows & (x[:, f] <= k)), ("1", rows & (x[:, f] > k))):
            leaves[path + side] = part
            gains[path + side] = best(part, path + side)
    return splits, {p: float(-s.rate * boosting.shrunk(g[r].sum(), s.l1) / (h[r].sum() + s.l2)) for p, r in leaves.items()}


def paths(nodes, root):
    """(path, feature, cut) of inner nodes, and (path, value) of leaves."""
    inner, ends, todo = [], {}, [(root, "")]
    while todo:
        n, p = todo.pop()
        if nodes.feature[n] < 0:
            ends[p] = nodes.value[n]
        else:
            inner.append((p, int(nodes.feature[n]), nodes.cut[n]))
            todo += [(nodes.left[n], p + "0"), (nodes.right[n], p + "1")]
    return sorted(inner), ends


@pytest.mark.parametrize("share", [1.0, 0.7])
def test_trees_equal_the_plain_grower(data, share):
    s = boosting.Settings(rounds=4, leaves=7, depth=5, rate=0.3, bins=12, row_share=share, feature_share=0.7, keep=2)
    model = boosting.fit(data, NAMES, s, ("id",))
    d = data.select("id", F.xxhash64("id").alias("h"), *NAMES, "label", "weight").orderBy("id").toPandas()
    x = d[NAMES].to_numpy()
    cuts = [np.unique(np.quantile(c, np.arange(1, 12) / 12)) for c in x.T]
    bins = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T, strict=True)], axis=1)
    y, w = d.label.to_numpy(), d.weight.to_numpy()
    base = np.log((y * w).sum() / (w.sum() - (y * w).sum()))
    raw = np.full(len(y), base)
    rng = np.random.default_rng(s.seed)
    for t, root in enumerate(model.roots):
        features = np.sort(rng.choice(3, 2, replace=False))
        use = boosting.seen(d.h.to_numpy(), t, s)
        g, h = boosting.gradients(raw, y, w)
        splits, leaves = plain_tree(bins[use], g[use], h[use], features, s)
        inner, ends = paths(model, root)
        assert inner == sorted((p, f, cuts[f][k]) for p, f, k in splits) and len(splits) > 2
        assert ends.keys() == leaves.keys() and all(abs(ends[p] - leaves[p]) < 1e-9 for p in ends)
        one = explain.Nodes(model.feature, model.cut, model.left, model.right, model.value, model.cover, np.array([root]))
        raw += one.predict(x)
    assert np.allclose(raw, model.predict(x))


def test_model_learns_and_is_explained(data):
    s = boosting.Settings(rounds=12, leaves=8, rate=0.3, bins=16)
    train = data.filter("part = 'train'")
    model = boosting.fit(train, NAMES, s, ("id",))
    test = data.filter("part = 'test'").withColumn("p", boosting.probability(model, NAMES)).toPandas()
    assert ((test.p > 0.5) == (test.label == 1)).mean() > 0.75  # a tenth of the labels is noise, and half of it changes sides
    got = {r.feature: r.mean_abs_shap for r in explain.importance(data, NAMES, model).collect()}
    assert min(got["a"], got["b"]) > got["c"]
    phi = np.array([r.shap for r in explain.shap_values(data.filter("id < 20"), NAMES, model, NAMES).collect()])
    x = np.array(data.filter("id < 20").select(*NAMES).collect())
    assert np.allclose(np.sort(phi.sum(axis=1) + explain.mean_prediction(model)), np.sort(model.predict(x)))


def test_one_class_is_refused(data):
    with pytest.raises(ValueError):
        boosting.fit(data.filter("label = 1"), NAMES, boosting.Settings(rounds=1), ("id",))
