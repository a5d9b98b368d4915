"""Exact regression trees, grown level by level.

Samples stay long: ``(id, feature, x, y)``. A level is one shuffle on (node, feature): cumulative
sums give every cut's gain, ``max_by`` the best: equal values of a feature are added up first, so
that a node's window holds its different values, not its samples. Only the node table comes to the
driver. With look-ahead a cut is worth what the best cuts below it gain too: that is a search over
combinations, done for each node's samples at once in its own task, and meant for few samples.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.stage import cut

CRITERIA, LEAVES = ("mse", "absolute_error"), ("mean", "median")


def impurity(df: DataFrame, keys: Sequence[str], criterion: str = "mse", y: str = "y") -> DataFrame:
    """Squared or absolute error of each group; absolute error is from the lower median."""
    if criterion not in CRITERIA:
        raise ValueError(f"criterion must be one of {CRITERIA}")
    if criterion == "mse":
        return df.groupBy(*keys).agg((F.sum(F.col(y) * F.col(y)) - F.sum(y) * F.sum(y) / F.count("*")).alias("impurity"))
    middle = df.groupBy(*keys).agg(F.expr(f"percentile_disc(0.5) within group (order by {y})").alias("median"))
    return df.join(middle, list(keys)).groupBy(*keys).agg(F.sum(F.abs(F.col(y) - F.col("median"))).alias("impurity"), F.first("median").alias("median"))


def leaf(kind: str, y: str = "y") -> Column:
    if kind not in LEAVES:
        raise ValueError(f"leaf value must be one of {LEAVES}")
    return F.coalesce(F.avg(y) if kind == "mean" else F.expr(f"percentile_disc(0.5) within group (order by {y})"), F.lit(0.0))


def best_by_feature(samples: DataFrame) -> DataFrame:
    """``(node, feature, gain, threshold, pos)`` of the best cut of ``samples(node, id, feature, x, y)``:
    most squared error removed, ties to the first position, which counts the samples up to the cut.
    Cuts lie between different values. No rows in, no rows out; a feature of one value has no cut."""
    y = F.col("y")
    values = samples.groupBy("node", "feature", "x").agg(F.count("*").alias("c"), F.sum("y").alias("s1"), F.sum(y * y).alias("q1"))
    whole = W.partitionBy("node", "feature")
    by = whole.orderBy("x")
    run = by.rowsBetween(W.unboundedPreceding, 0)
    c = values.select(
        "node", "feature", "x", F.lead("x").over(by).alias("nx"),
        F.sum("c").over(run).alias("nl"), F.sum("s1").over(run).alias("sl"), F.sum("q1").over(run).alias("ql"),
        F.sum("c").over(whole).alias("n"), F.sum("s1").over(whole).alias("s"), F.sum("q1").over(whole).alias("q"),
    ).where("nx is not null")
    gain = F.expr("(q - s * s / n) - (ql - sl * sl / nl) - ((q - ql) - (s - sl) * (s - sl) / (n - nl))")
    cuts = c.select("node", "feature", F.col("nl").alias("pos"), ((F.col("x") + F.col("nx")) / 2).alias("threshold"), gain.alias("gain"))
    best = F.max(F.struct("gain", (-F.col("pos")).alias("back"), "threshold"))
    found = cuts.groupBy("node", "feature").agg(best.alias("b"))
    return found.select("node", "feature", "b.gain", "b.threshold", (-F.col("b.back")).cast("int").alias("pos"))


def _error(y: np.ndarray, criterion: str) -> float:
    if not len(y):
        return 0.0
    return float(((y - y.mean()) ** 2).sum() if criterion == "mse" else np.abs(y - np.sort(y)[(len(y) - 1) // 2]).sum())


def look(x: np.ndarray, y: np.ndarray, ahead: int, criterion: str = "mse") -> tuple[float, int, float]:
    """``(worth, feature, threshold)`` of the best cut of the rows ``x``: what it gains by ``criterion``, and
    ``ahead`` levels of best cuts on both its sides with it. The last level's sides are weighed by squared
    error whatever the criterion, as :func:`best_by_feature` weighs them. Feature -1 where no cut is left."""
    best, own = (-np.inf, -1, np.nan), _error(y, criterion)
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for threshold in (values[1:] + values[:-1]) / 2:
            left = x[:, f] <= threshold
            if ahead == 0:
                worth = own - _error(y[left], "mse") - _error(y[~left], "mse")
            else:
                worth = own - _error(y[left], criterion) - _error(y[~left], criterion)
                worth += sum(max(look(x[side], y[side], ahead - 1, criterion)[0], 0.0) if side.sum() > 1 else 0.0 for side in (left, ~left))
            if worth > best[0] + 1e-12:
                best = (worth, f, float(threshold))
    return best


def best_ahead(samples: DataFrame, features: Sequence[str], ahead: int, criterion: str) -> DataFrame:
    """``(node, gain, feature, threshold)`` by :func:`look`; nodes without a cut are left out."""

    def search(key, rows: pd.DataFrame) -> pd.DataFrame:
        wide = rows.pivot_table(index="id", columns="feature", values="x", aggfunc="first")[list(features)]
        y = rows.groupby("id")["y"].first().reindex(wide.index).to_numpy(float)
        worth, f, threshold = look(wide.to_numpy(float), y, ahead, criterion)
        found = [(int(key[0]), worth, features[f], threshold)] if f >= 0 else []
        return pd.DataFrame(found, columns=["node", "gain", "feature", "threshold"])

    return samples.groupBy("node").applyInPandas(search, "node int, gain double, feature string, threshold double")


@dataclass(frozen=True)
class Node:
    id: int
    parent: int | None
    feature: str | None
    threshold: float | None
    value: float
    decrease: float
    n: int
    left: int | None
    right: int | None


class Tree:
    def __init__(self, nodes: Sequence[Node]):
        self.nodes = {x.id: x for x in nodes}

    def copy(self) -> "Tree":
        return Tree(list(self.nodes.values()))

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(x.id, x.parent, x.feature, x.threshold, x.value, x.decrease, x.n, x.feature is None) for x in self.nodes.values()]
        return spark.createDataFrame(rows, "node int, parent int, feature string, threshold double, value double, decrease double, n long, is_leaf boolean")

    def predict(self, at: int = 0) -> Column:
        """The prediction as one nested CASE over columns named like the features."""
        if not self.nodes:
            raise ValueError("the tree is not fitted")
        x = self.nodes[at]
        if x.feature is None:
            return F.lit(x.value)
        return F.when(F.col(x.feature) <= x.threshold, self.predict(x.left)).otherwise(self.predict(x.right))

    def predict_one(self, row: dict[str, float]) -> float:
        x = self.nodes[0]
        while x.feature is not None:
            x = self.nodes[x.left if row[x.feature] <= x.threshold else x.right]
        return x.value

    def prune(self, least: float) -> "Tree":
        """From the leaves up: a split of decrease at most ``least`` becomes a leaf, whatever is below."""
        out = dict(self.nodes)

        def drop(i: int) -> None:
            x = out.pop(i)
            for c in (x.left, x.right):
                if c is not None and c in out:
                    drop(c)

        for i in sorted(self.nodes, reverse=True):
            x = out.get(i)
            if x is not None and x.feature is not None and x.decrease <= least:
                for c in (x.left, x.right):
                    if c in out:
                        drop(c)
                out[i] = replace(x, feature=None, threshold=None, left=None, right=None, decrease=0.0)
        return Tree(list(out.values()))

    def text(self, max_depth: int = 10, spacing: int = 3, decimals: int = 2) -> str:
        lines: list[str] = []

        def show(i: int, depth: int) -> None:
            x, pad = self.nodes[i], ("|" + " " * spacing) * depth + "|" + "-" * spacing
            if x.feature is None:
                lines.append(f"{pad} value: {x.value:.{decimals}f}")
            elif depth > max_depth:
                lines.append(f"{pad} ...")
            else:
                lines.append(f"{pad} {x.feature} <= {x.threshold:.{decimals}f}")
                show(x.left, depth + 1)
                lines.append(f"{pad} {x.feature} >  {x.threshold:.{decimals}f}")
                show(x.right, depth + 1)

        show(0, 0)
        return "\n".join(lines)


def fit(
    samples: DataFrame, max_depth: int = 8, min_decrease: float = 0.0, leaf_value: str = "mean", criterion: str = "mse", look_ahead: int = 0
) -> Tree:
    """Grow while the depth allows, a node has two samples and its best gain exceeds ``min_decrease``.

    ``samples(id, feature, x, y)`` with every feature of every id. Ties go to the first position, then
    the first feature by name. A gain is the node's error by ``criterion`` less its sides' squared
    errors; with ``look_ahead`` what :func:`look` says. The loop runs once a level; nodes are few,
    samples stay distributed.
    """
    if criterion not in CRITERIA:
        raise ValueError(f"criterion must be one of {CRITERIA}")
    rows = cut(samples.withColumn("node", F.lit(0)))
    order = [r["feature"] for r in rows.select("feature").distinct().orderBy("feature").collect()]
    nodes: dict[int, Node] = {}
    parent: dict[int, int | None] = {0: None}
    count = 1
    for depth in range(max_depth + 1):
        one = rows.where(F.col("feature") == order[0]) if order else rows
        stats = {r["node"]: r for r in one.groupBy("node").agg(F.count("*").alias("n"), leaf(leaf_value).alias("v")).collect()}
        if depth == max_depth:
            found = {}
        elif look_ahead:
            found = {r["node"]: r for r in best_ahead(rows, order, look_ahead, criterion).collect()}
        else:
            best = best_by_feature(rows).groupBy("node").agg(F.collect_list(F.struct("gain", "pos", "feature", "threshold")).alias("all"))
            if criterion != "mse":  # the node's own error, in place of its squared one
                more = impurity(one, ["node"], criterion).join(impurity(one, ["node"]).toDF("node", "square"), "node")
                best = best.join(more.select("node", (F.col("impurity") - F.col("square")).alias("by")), "node").withColumn(
                    "all", F.transform("all", lambda c: c.withField("gain", c["gain"] + F.col("by")))
                )
            found = {r["node"]: min(r["all"], key=lambda c: (-c["gain"], c["pos"], c["feature"])) for r in best.collect()}
        moves = []
        for i, s in sorted(stats.items()):
            b = found.get(i)
            if b is not None and s["n"] >= 2 and b["gain"] > min_decrease:
                nodes[i] = Node(i, parent[i], b["feature"], b["threshold"], s["v"], b["gain"], s["n"], count, count + 1)
                parent[count] = parent[count + 1] = i
                moves.append((i, b["feature"], b["threshold"], count, count + 1))
                count += 2
            else:
                nodes[i] = Node(i, parent[i], None, None, s["v"], 0.0, s["n"], None, None)
        if not moves:
            break
        split = rows.sparkSession.createDataFrame(moves, "node int, feature string, t double, l int, r int")
        sides = rows.join(F.broadcast(split), ["node", "feature"]).select("id", "node", F.when(F.col("x") <= F.col("t"), F.col("l")).otherwise(F.col("r")).alias("new"))
        rows = cut(rows.join(sides, ["id", "node"]).withColumn("node", F.col("new")).drop("new"))
    return Tree(list(nodes.values()))


def tune(samples: DataFrame, folds: DataFrame, max_depth: int = 8, min_decrease: float = 0.0, **how) -> tuple[float, Tree]:
    """The least decrease with the smallest cross-validated squared error, and the pruned tree.

    ``folds(repeat, id, fold)``. Candidates are the middles of the sorted decreases of the full tree, the
    current ``min_decrease`` and infinity; ties go to the smallest. ``how`` goes to :func:`fit`.
    """
    full = fit(samples, max_depth, min_decrease, **how)
    drops = sorted({x.decrease for x in full.nodes.values() if x.feature is not None})
    candidates = sorted({min_decrease, *[(a + b) / 2 for a, b in zip(drops, drops[1:])], float("inf")})
    errors = dict.fromkeys(candidates, 0.0)
    names = [r["feature"] for r in samples.select("feature").distinct().orderBy("feature").collect()]
    for r in folds.select("repeat", "fold").distinct().orderBy("repeat", "fold").collect():
        test = folds.where((F.col("repeat") == r["repeat"]) & (F.col("fold") == r["fold"])).select("id")
        grown = fit(samples.join(test, "id", "left_anti"), max_depth, min_decrease, **how)
        wide = samples.join(test, "id", "left_semi").groupBy("id", "y").pivot("feature", names).agg(F.first("x"))
        pruned = [grown.prune(c) for c in candidates]
        got = wide.agg(*[F.avg(F.pow(t.predict() - F.col("y"), 2)).alias(f"e{i}") for i, t in enumerate(pruned)]).first()
        for i, c in enumerate(candidates):
            errors[c] += got[f"e{i}"] or 0.0
    best = min(candidates, key=lambda c: (errors[c], c))
    return best, full.prune(best)
