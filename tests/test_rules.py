from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import rules, tree
from tidemark.plans import mining


def date(i):
    return dt.date(2022, 1, 3) + dt.timedelta(i)


@pytest.fixture
def long(spark):
    rng = np.random.default_rng(1)
    rows = [(date(i), n, float(np.round(rng.normal(), 2))) for i in range(120) for n in ("a", "b")]
    return spark.createDataFrame(rows, "day date, name string, value double")


def test_granularity(spark):
    d = spark.createDataFrame([(date(i), "a", v) for i, v in enumerate((1.1, 1.2, 1.3, 1.4))], "day date, name string, value double")
    t = rules.thresholds(d, 1, {"a": 0.25}).orderBy("direction").collect()
    assert [(r.direction, r.threshold, r.n) for r in t] == [("left", 1.25, 2), ("right", 1.25, 2)]


def test_min_samples_and_most(long):
    t = rules.thresholds(long, 40)
    assert t.agg(F.min("n")).first()[0] >= 40
    few = rules.thresholds(long, 40, most=3)
    assert few.groupBy("name", "direction").count().agg(F.max("count")).first()[0] <= 3
    assert rules.thresholds(long, 40, left_only=["a"]).where("name = 'a' and direction = 'right'").count() == 0


def test_masks_pack_and_count(spark):
    m = spark.createDataFrame([(0, i) for i in range(0, 200, 3)] + [(1, i) for i in range(0, 200, 2)], "s int, i int")
    p = rules.pack(m, ["s"], "i", 200)
    a, b = (r.mask for r in p.orderBy("s").collect())
    got = spark.createDataFrame([(a, b)], "a array<bigint>, b array<bigint>").select(rules.count_bits(rules.both(F.col("a"), F.col("b")))).first()[0]
    assert got == len(range(0, 200, 6)) and [r.n for r in p.orderBy("s").collect()] == [67, 100]


def test_merge_and_children(spark):
    rows = [(0, [7], 3, 1.0, ["x"], [[0]]), (1, [7], 3, 1.0, ["y"], [[1]]), (2, [14], 3, 2.0, ["z"], [[2]]), (3, [1], 1, 0.0, ["w"], [[3]])]
    s = spark.createDataFrame(rows, "split_id int, mask array<bigint>, n int, score double, filters array<string>, parents array<array<int>>")
    m = {r.split_id: r for r in rules.merge_identical(s).collect()}
    assert m[0].filters == ["x", "y"] and m[0].parents == [[0], [1]] and set(m) == {0, 2, 3}
    c = rules.children(s, s, 2).collect()
    assert sorted((r.a_id, r.b_id, r.mask, r.n) for r in c) == [(0, 2, [6], 2), (1, 2, [6], 2)]
    assert rules.without_known(s.select("mask", "split_id"), s.where("split_id = 0")).count() == 2
    assert [r.split_id for r in rules.top(s.withColumn("score", F.when(F.col("split_id") != 2, F.col("score"))), 3).collect()] == [0, 1, 3]


def test_parent_sets(spark):
    d = spark.createDataFrame([([[1], [2]], [[2], [3]])], "a array<array<int>>, b array<array<int>>")
    assert d.select(rules.parent_sets(F.col("a"), F.col("b"))).first()[0] == [[1, 2], [1, 3], [2], [2, 3]]


@pytest.mark.parametrize("embargo", [0, 0.2])
@pytest.mark.parametrize("least", [0.2, 0.3])
def test_folds_never_leak(spark, embargo, least):
    offsets = spark.createDataFrame([(0, 20), (1, 13)], "repeat int, offset int")
    f = rules.purged_folds(offsets, 100, 5, 0.1, embargo, least).collect()
    assert f
    for r in f:
        assert r.test_start - r.train_end >= max(1, int(20 * 0.1)) + int(20 * embargo) and r.train_end >= 100 * least and r.test_end <= 100
    assert rules.k_folds(spark.range(10).select(F.col("id").alias("i")), 5, 2).groupBy("repeat", "fold").count().where("count <> 2").count() == 0


def test_errors(spark):
    d = spark.createDataFrame([(date(0), 1.0, 1), (date(0), None, 2)], "date date, v double, k int")
    with pytest.raises(Exception, match="conflicting"):
        rules.one_a_date(d, "date", "v", "k").collect()
    t = spark.createDataFrame([(date(1),)], "date date")
    with pytest.raises(Exception, match="no filters"):
        rules.align(d.select("date"), t).collect()


def test_computed_columns(spark):
    t = spark.createDataFrame([(dt.date(2022, 1, 10 + i), r) for i, r in enumerate((100.0, 200.0, 150.0))], "date date, risk double")
    got = rules.computed_columns(t, 20.0).orderBy("date").collect()
    assert [round(r.reward_per_risk, 3) for r in got] == [19, 9, 12.333] and [r.premium for r in got] == [1900, 1800, 1850]
    assert [(r.is_monday, r.is_tuesday, r.is_wednesday) for r in got] == [(1, 0, 0), (0, 1, 0), (0, 0, 1)]


def test_search(spark, long):
    trades = long.where("name = 'a'").select("day", F.lit(1.0).alias("risk"), F.col("value").alias("profit"))
    found = rules.SplitSearch(min_samples=20, depth=2, keep=8, most=4).run(trades, long).collect()
    best = max(found, key=lambda r: r.score)
    assert best.score > 0.5 and all(r.n >= 20 for r in found)
    assert len({tuple(r.mask) for r in found}) == len(found) and {r.depth for r in found} == {1, 2}


def test_describe():
    names = {0: [("x", "left", 2.0)], 1: [("x", "left", 1.0)], 2: [("y", "right", 3.0)]}
    assert rules.describe([[0, 1, 2]], names) == "(x <= 1) & (y >= 3)"
    assert rules.describe([[0], [1], [2]], names, 1).endswith("2 more")


def test_kelly_and_weights():
    assert rules.kelly(np.array([1.0, -1.0, 1.0])) == pytest.approx(1 / 3, abs=1e-4)
    assert rules.kelly(np.array([-1.0, 0.5])) == 0
    w = rules.log_growth_weights(np.array([[1.0, 0.0], [-1.0, 0.0], [1.0, 0.0]]))
    assert w[0] == pytest.approx(1 / 3, abs=1e-3) and w.sum() <= 1 + 1e-9


def test_kelly_without_a_loss(spark, tmp_path):
    assert rules.kelly(np.array([0.5, 0.0])) == float("inf")
    assert rules.kelly(np.array([1.0, np.nan, -1.0, 1.0])) == pytest.approx(1 / 3, abs=1e-9)
    # Mondays only win, on Tuesdays two of three do
    lines = [(1, 1.0, 100.0, 0.1, 0.0), (8, 1.0, 100.0, 0.2, 0.0), (2, 1.0, 100.0, 1.0, 0.0), (9, 1.0, 100.0, 0.0, 1.0), (16, 1.0, 100.0, 1.0, 0.0)]
    made = spark.createDataFrame(lines, "day int, l_quantity double, l_extendedprice double, l_discount double, l_tax double")
    made.selectExpr("make_timestamp(2024, 1, day, 0, 0, 0) as l_shipdate", "l_quantity", "l_extendedprice", "l_discount", "l_tax").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {r.weekday: r.fraction for r in mining.kelly(spark, str(tmp_path)).collect()}
    assert got == {0: 0.0, 1: pytest.approx(1 / 300, abs=1e-4)}


@pytest.fixture
def samples(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 2)).round(1)
    y = np.where(x[:, 0] <= 0.2, 1.0, np.where(x[:, 1] <= -0.1, 3.0, 5.0))
    rows = [(i, f, float(x[i, j]), float(y[i])) for i in range(60) for j, f in enumerate("ab")]
    return spark.createDataFrame(rows, "id int, feature string, x double, y double")


def test_tree_fits_predicts_prunes(spark, samples):
    t = tree.fit(samples, 3)
    wide = samples.groupBy("id", "y").pivot("feature", ["a", "b"]).agg(F.first("x"))
    assert wide.where(t.predict() != F.col("y")).count() == 0
    row = wide.first()
    assert t.predict_one({"a": row.a, "b": row.b}) == row.y
    assert t.nodes[0].feature == "a" and len(t.prune(1e9).nodes) == 1 and "value: " in t.text()
    with pytest.raises(ValueError):
        tree.Tree([]).predict()
    with pytest.raises(ValueError):
        tree.impurity(samples, ["id"], "gini")


def test_impurity(spark):
    d = spark.createDataFrame([("g", y) for y in (1.0, 2.0, 3.0)] + [("h", y) for y in (1.0, 2.0, 3.0, 10.0)], "g string, y double")
    assert {r.g: r.impurity for r in tree.impurity(d, ["g"]).collect()}["g"] == 2
    got = {r.g: (r.impurity, r.median) for r in tree.impurity(d, ["g"], "absolute_error").collect()}
    assert got == {"g": (2, 2), "h": (10, 2)}


def test_tune(spark, samples):
    folds = samples.select("id").distinct().select(F.lit(0).alias("repeat"), "id", (F.col("id") % 2).alias("fold"))
    best, t = tree.tune(samples, folds, 2)
    assert best < float("inf") and t.nodes[0].feature == "a"
