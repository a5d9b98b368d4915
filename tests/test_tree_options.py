from __future__ import annotations

import numpy as np
import pytest

from tidemark.operators import tree


def long(spark, x, y):
    rows = [(i, f"f{j}", float(v), float(y[i])) for i, r in enumerate(x) for j, v in enumerate(r)]
    return spark.createDataFrame(rows, "id int, feature string, x double, y double")


# y is the exclusive or of two columns: no single cut gains, two levels do
XOR = np.array([[a, b, c] for a in (0, 1) for b in (0, 1) for c in (0, 1, 2)], float)
TARGET = np.array([float(a != b) for a, b, _ in XOR])


def test_look_ahead_finds_what_one_level_misses(spark):
    d = long(spark, XOR, TARGET)
    assert len(tree.fit(d, 2, 1e-9).nodes) == 1
    t = tree.fit(d, 2, 1e-9, look_ahead=1)
    assert t.nodes[0].feature == "f0" and t.nodes[0].decrease == pytest.approx(3.0)
    assert [t.predict_one({"f0": a, "f1": b, "f2": c}) for a, b, c in XOR] == list(TARGET)


def test_look_is_the_best_of_all_cuts():
    rng = np.random.default_rng(4)
    x, y = rng.integers(0, 4, (9, 2)).astype(float), rng.normal(size=9)

    def worth(rows, ahead):
        best = 0.0 if ahead < 0 else -np.inf
        if ahead < 0:
            return best
        for f in (0, 1):
            v = np.unique(x[rows, f])
            for t in (v[1:] + v[:-1]) / 2:
                left, right = [r for r in rows if x[r, f] <= t], [r for r in rows if x[r, f] > t]
                gain = tree._error(y[rows], "mse") - tree._error(y[left], "mse") - tree._error(y[right], "mse")
                best = max(best, gain + (max(worth(left, ahead - 1), 0) + max(worth(right, ahead - 1), 0) if ahead else 0))
        return best

    for ahead in (0, 1):
        assert tree.look(x, y, ahead)[0] == pytest.approx(worth(list(range(9)), ahead))


def test_criterion_of_the_node(spark):
    x, y = np.arange(6.0)[:, None], np.array([0, 0, 1, 9, 9, 30.0]) / 100
    square, absolute = (tree.fit(long(spark, x, y), 1, criterion=c) for c in tree.CRITERIA)
    assert absolute.nodes[0].threshold == square.nodes[0].threshold == 4.5
    below = ((y[:5] - y[:5].mean()) ** 2).sum()
    assert square.nodes[0].decrease == pytest.approx(((y - y.mean()) ** 2).sum() - below)
    assert absolute.nodes[0].decrease == pytest.approx(np.abs(y - 0.01).sum() - below)
    with pytest.raises(ValueError):
        tree.fit(long(spark, x, y), criterion="entropy")


def test_best_cut_of_repeated_values(spark):
    d = long(spark, np.array([[1], [1], [2], [2], [2], [5]], float), np.array([0, 0, 0, 0, 0, 6.0])).selectExpr("0 as node", "*")
    (r,) = tree.best_by_feature(d).collect()
    assert (r.pos, r.threshold) == (5, 3.5) and r.gain == pytest.approx(30.0)
