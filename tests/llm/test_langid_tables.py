"""Language tables made on executors, and what of them and of the texts passes through the driver and workers."""

from __future__ import annotations

import tracemalloc
from collections import Counter

import numpy as np

from tidemark.llm import langid


def test_few_words_of_the_sample_pass_through_the_driver(spark):
    rng = np.random.default_rng(5)
    rows = [(i, " ".join("".join(chr(97 + c) for c in w) for w in rng.integers(0, 26, (400, 9))), ("de", "en")[i % 2]) for i in range(150)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    tracemalloc.start()
    model = langid.train(d)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    by: dict[str, Counter] = {}
    held = {r.doc_id for r in d.where(langid.held_out()).collect()}
    for i, text, lang in rows:
        if i not in held:
            by.setdefault(lang, Counter()).update(langid.words_of(text))
    want = langid.Model.of(by)
    assert (model.langs, model.words, model.grams) == (want.langs, want.words, want.grams)
    assert np.array_equal(model.rows, want.rows)
    assert peak < 40e6, peak


def test_no_text_comes_back_from_the_workers(spark, sf):
    plan = langid.op4(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and "text" not in plan
