"""Lists of any length and hot tokens keep all entries that may link."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from tidemark.llm import jaccard


def _rows(spark, rows):
    return spark.createDataFrame(rows, "node long, n long, prefix array<long>, parts array<int>")


def test_one_list_of_many_entries(spark):
    n = 30_000
    rows = [(i, 40 + i % 3, [7], [1]) for i in range(n)] + [(n + 1, 9000, [7, 8], [1, 1]), (n + 2, 50, [9], [1])]
    got = jaccard._entries(_rows(spark, rows), 90)
    assert got.where("token <> 7").count() == 0 and got.where(f"node < {n}").count() == n


def test_dealt_lists_keep_lone_entries(spark):
    rows = [(i, 10 * 3**i, [5, 6], [100, 1]) for i in range(4)]
    got = jaccard._entries(_rows(spark, rows), 90).collect()
    assert sorted((r.token, r.node, r.pos) for r in got) == [(5, i, 0) for i in range(4)]


def test_parts_of_frequent_tokens():
    heavy = (np.array([3, 9], np.uint64), np.array([10, 5 * jaccard.SORTED]))
    assert jaccard._parts(np.array([1, 3, 9], np.uint64), heavy).tolist() == [1, 1, 6]


def test_useful_neighbours():
    b = pa.RecordBatch.from_pydict({"token": [1, 1, 1, 2, 3, 3], "part": [0] * 6, "n": [10, 11, 30, 5, 9, 99]})
    assert jaccard._useful(b, 6, 90, 0).tolist() == [True, True, False, False, False, False]
    assert jaccard._useful(b, 6, 90, 3).tolist() == [True, True, True, False, False, False]


def test_repeated_keys_and_sets(spark):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(5, a), (5, b), (5, b), (3, b + " more"), (None, a + " more"), (None, a + " more"), (9, "alone")]
    got = jaccard.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id or 0), r.component_id) for r in got) == [(0, 5), (0, 5), (3, 3), (5, 3), (5, 3), (5, 5), (9, 9)]
