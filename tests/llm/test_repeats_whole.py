from __future__ import annotations

from tidemark.llm import suffixes


def test_copy_groups_that_share_a_passage(spark):
    shared = " ".join(f"s{i}" for i in range(55))
    one, two = (" ".join(f"{c}{i}" for i in range(20)) for c in "ab")
    rows = [(1, f"{one} {shared} {one}"), (2, f"{one} {shared} {one}"), (10, f"{two} {shared} {two}"), (11, f"{two} {shared} {two}")]
    got = suffixes.repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.start_word, r.end_word, r.first_doc_id) for r in got} == {(i, 0, 95, 1) for i in (1, 2, 10, 11)}
