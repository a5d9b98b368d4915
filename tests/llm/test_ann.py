"""Nearest neighbours on vectors that make it hard: no clusters, ties, offsets, hot buckets."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import ann


def table(spark, x, ids=None):
    return spark.createDataFrame([(int(i), [float(v) for v in r]) for i, r in zip(range(len(x)) if ids is None else ids, x)], "vec_id long, embedding array<double>")


def brute(x, queries, k=10):
    out = {}
    for q in queries:
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        out[q] = list(np.lexsort((np.arange(len(x)), d))[:k])
    return out


def answers(found):
    return {q: list(g.sort_values("rank").vec_id) for q, g in found.toPandas().groupby("query_id")}


@pytest.mark.parametrize("width", [1, 2, 3])
def test_recall_on_isotropic_vectors_at_each_width(spark, width):
    x = np.random.default_rng(width).normal(size=(3000, 8 if width == 3 else 16))
    got = answers(ann.search(table(spark, x), F.col("vec_id") % 60 == 0, width=width, part=500))
    want = brute(x, got)
    assert len(got) == 50 and sum(len(set(want[q]) & set(got[q])) for q in got) / 500 >= 0.9


def test_fit_reaches_its_recall_outside_the_sample():
    rng = np.random.default_rng(5)
    x, k = rng.normal(size=(4000, 32)), 10
    for w in (1, 2):
        signs = ann.rotations(32, ann.TABLES * w).reshape(ann.TABLES, w, 3, -1)
        probes = ann.needed_probes(x[:2000], signs, k) or ann.MOST_PROBES
        own = np.stack([ann.buckets(x, s, 1)[:, 0] for s in signs])
        hit = 0
        for q in range(3000, 3050):
            near = brute(x, [q])[q]
            probed = [set(ann.buckets(x[q : q + 1], s, probes)[0].tolist()) for s in signs]
            hit += sum(any(own[t][i] in p for t, p in enumerate(probed)) for i in near)
        assert hit / 500 >= 0.9


def test_ties_go_to_the_smaller_id(spark):
    got = ann.search(table(spark, np.eye(127)), F.col("vec_id") == 60)
    assert answers(got) == {60: list(range(10))} and {round(r.score, 12) for r in got.collect()} == {round(2**0.5, 12)}


def test_offsets_and_sizes_keep_the_order():
    rng = np.random.default_rng(2)
    import pandas as pd

    for x in (1e8 + rng.normal(size=(300, 6)), 1e200 * rng.normal(size=(300, 6)), 1e-200 * rng.normal(size=(300, 6)), rng.normal(size=(300, 6)) * 10.0 ** rng.integers(-6, 6, (300, 1))):
        right = pd.DataFrame({"entry": np.arange(300), "low": np.arange(300), "vec": list(x)})
        left = pd.DataFrame({"query": [7, 8], "vec": [x[7], x[8]]})
        got = ann._rank(left, right, 10)
        for q in (7, 8):
            m = np.abs(x).max()
            d = np.sqrt((((x - x[q]) / m) ** 2).sum(axis=1))
            assert list(got[got["query"] == q].sort_values(["score", "low"]).entry) == list(np.lexsort((np.arange(300), d))[:11])


def test_keys_with_several_vectors_and_clashing_columns(spark):
    rows = [(5, [1.0, 0.0]), (5, [0.0, 1.0]), (6, [1.0, 0.1]), (7, [0.1, 1.0]), (8, [-1.0, 0.0])]
    d = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], "vec_id long, embedding array<double>, id string, vec string, rank string")
    got = ann.search(d, F.col("vec_id").isin(5, 8), k=3).collect()
    # each vector of 5 takes a place: among the four nearest of a query are its own, 5 twice, and one or two others
    assert sorted((r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in got) == [
        (5, 1, 6, 0.1), (5, 2, 7, 0.1), (8, 1, 5, round(2**0.5, 9)), (8, 2, 7, round((1.1**2 + 1) ** 0.5, 9)),
    ]
