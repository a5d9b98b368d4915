"""Line dedup against brute force on edit similarity alone, and on lines that make it hard."""

from __future__ import annotations

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import common, lines

LONG = " ".join(f"word{i}x" for i in range(40))
ALIKE = [
    ("Hello, world of friends", "Hello world of friends"),
    ("Subscribe to our newsletter", "Subscribe to our newsleter"),
    (LONG, LONG.replace("word20x", "other")),
    ("天地玄黄宇宙洪荒日月盈昃辰宿列张寒来暑往秋收冬藏闰余成岁律吕调阳云腾致雨露结为霜金生丽水玉出昆冈剑号巨阙珠称夜光",
     "天地玄黄宇宙洪荒日月盈昃辰宿列张寒来暑往秋收冬藏闰余成岁律吕调阳云腾致雨露结为霜金生丽水玉出昆冈剑号巨阙珠称夜明"),
]


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_alike_in_characters(spark):
    rows = [(i, x) for i, x in enumerate([a for a, _ in ALIKE] + [b for _, b in ALIKE] + ["Home page", "Hope page", "-----", "-----\n====="])]
    got = {r.doc_id: r.n_removed for r in lines.dedup(table(spark, rows)).collect()}
    n = len(ALIKE)
    assert [got[i] for i in range(n)] == [0] * n and [got[i] for i in range(n, 2 * n)] == [1] * n
    assert [got[i] for i in range(2 * n, 2 * n + 4)] == [0] * 4


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def alike(a, b):
    if max(len(a), len(b)) > lines.LONG:
        a, b = a.split(), b.split()
    return edits(a, b) <= 0.1 * max(len(a), len(b)) + 1e-9


def words(rng, n):
    return ["".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(2, 9))) for _ in range(n)]


#: What is changed of a line of so many words: whole words, or single characters of different words.
KINDS = [(6, "typo", 1), (8, "typo", 2), (20, "word", 1), (20, "typo", 2), (40, "word", 2), (40, "typo", 4), (60, "word", 1), (60, "word", 3), (60, "word", 6), (100, "word", 5), (100, "word", 10)]


@pytest.fixture(scope="module")
def recall(spark):
    """Isolated pairs of edited lines; of those alike by edit similarity alone, how many were found."""
    rng, rows, pairs = np.random.default_rng(11), [], []
    for kind, (n, how, many) in enumerate(KINDS):
        for _ in range(60):
            a = words(rng, n)
            b = list(a)
            for i in rng.choice(n, many, replace=False):
                b[i] = words(rng, 1)[0] if how == "word" else b[i][:1] + chr(97 + int(rng.integers(0, 26))) + b[i][2:]
            a, b = " ".join(a), " ".join(b)
            if alike(a, b):
                pairs.append((kind, len(rows), len(rows) + 1))
            rows += [(len(rows), a), (len(rows) + 1, b)]
    gone = {r.doc_id for r in lines.dedup(table(spark, rows)).where("n_removed > 0").collect()}
    found = {}
    for kind, a, b in pairs:
        found.setdefault(KINDS[kind], []).append(b in gone)
    return found, gone, {b for _, _, b in pairs}


def test_recall_of_isolated_pairs(recall):
    found, gone, true = recall
    for kind, hits in found.items():
        print(kind, len(hits), round(sum(hits) / len(hits), 3))
    every = [h for hits in found.values() for h in hits]
    assert sum(every) / len(every) >= 0.9 and gone <= true
    assert all(sum(h) / len(h) >= 0.9 for (n, how, many), h in found.items() if how == "word")


@pytest.mark.parametrize(("block", "cell"), [(24, 512), (8, 8)])
def test_large_groups_and_hot_grams(spark, monkeypatch, block, cell):
    monkeypatch.setattr(lines, "BLOCK", block)
    monkeypatch.setattr(lines, "CELL", cell)
    rng = np.random.default_rng(8)
    base = [words(rng, 40) for _ in range(4)]
    rows = []
    for i in range(120):
        w = list(base[i % 4])
        for _ in range(int(rng.integers(0, 4))):
            w[int(rng.integers(0, 40))] = words(rng, 1)[0]
        rows.append((i, " ".join(w)))
    # lines that share a phrase and nothing else are no copies
    rows += [(1000 + i, " ".join(["all", "rights", "reserved", *words(rng, 30)])) for i in range(80)]
    d = table(spark, rows)
    at = common.materialise(lines.dedup(d))
    text = dict(rows)
    up = {i: i for i in text}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(text, 2):
        if a % 4 == b % 4 and alike(text[a], text[b]):
            up[max(root(a), root(b))] = min(root(a), root(b))
    want = {i for i in text if root(i) != i}
    got = {r.doc_id for r in at.where("n_removed > 0").collect()}
    assert got == want and len(want) > 100


def test_awkward_lines(spark):
    wide = "x" * 300_000 + " tail"
    rows = [(1, wide + "\n" + "many words here " * 30_000), (2, wide), (None, "same line of words"), (None, "same line of words"), (3, "Same line of WORDS!"), (4, None), (5, ""), (6, "\n\n"), (7, "\r\n \t")]
    d = table(spark, rows).withColumns({c: F.lit("x") for c in ("th", "gone", "row", "di", "tj", "t", "lid", "n_lines")})
    got = lines.dedup(d).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows) and all(r.th == r.gone == r.row == r.lid == "x" for r in got)
    assert (by[1].n_removed, by[2].n_removed, by[3].n_removed, by[4].text, by[4].n_lines, by[5].n_lines, by[6].n_lines) == (0, 1, 0, None, 0, 1, 3)
    assert [r.n_removed for r in got if r.doc_id is None] == [1, 1] and by[7].text == "\r\n \t"


def test_lines_alike_that_share_one_hot_key_only(spark):
    """Of a block of 200 lines two are alike; each has another key besides, that only unlike lines share."""
    rng = np.random.default_rng(21)
    a = words(rng, 30)
    b = [*a[:12], *words(rng, 1), *a[13:]]
    rows = [(i, " ".join(w)) for i, w in enumerate([a, b, *[words(rng, 30) for _ in range(202)]])]
    d = table(spark, rows)
    every = lines._lines(d, "text")
    keys = {0: [1, 2], 1: [1, 3], 2: [2], 3: [3]}
    m = spark.createDataFrame([(i, *(keys.get(i, [1]) + [None] * 4)[:5]) for i, _ in rows], "doc_id long, " + ", ".join(f"m{i} long" for i in range(5)))
    firsts = every.select("lid", "len", "doc_id", "th", "no").join(m, "doc_id")
    firsts = common.materialise(firsts.select("lid", "len", F.struct("doc_id", "th", "no").alias("p"), *[f"m{i}" for i in range(5)]))
    got = lines.links(d, every, firsts, "text").join(firsts, F.col("node") == F.col("lid")).select("p.doc_id", "root").collect()
    assert {r.doc_id for r in got} == {0, 1} and len({r.root for r in got}) == 1


def test_signatures_are_a_bound(spark):
    rng = np.random.default_rng(22)
    rows = []
    for i in range(300):
        x = " ".join(words(rng, int(rng.integers(1, 30))))
        y = list(x)
        for _ in range(int(rng.integers(0, 6))):
            at = int(rng.integers(0, len(y) + 1))
            y[at : at + int(rng.integers(0, 2))] = ["é", "a", " ", ""][int(rng.integers(0, 4))]
        rows.append((x, "".join(y), edits(x, "".join(y))))
    d = spark.createDataFrame(rows, "x string, y string, n int")
    d = d.select("n", F.struct(*lines._signature(F.col("x"))).alias("a"), F.struct(*lines._signature(F.col("y"))).alias("b"))
    bits = sum((F.bit_count(F.col(f"a.{c}").bitwiseXOR(F.col(f"b.{c}"))) for c in lines.SIG), F.lit(0))
    assert d.where(bits > 2 * F.col("n")).count() == 0


def test_pipeline_finds_pairs_that_share_a_hot_gram_only(spark):
    """All lines begin with the words whose gram has the least hash of many; typos hit most other grams of a pair."""
    from corpus_pipeline import unique_lines

    last = spark.range(50_000).select(F.concat(F.lit("w"), "id").alias("w"))
    last = last.orderBy(F.xxhash64(F.lit("all"), F.lit("of"), "w")).first().w
    rng, rows, more = np.random.default_rng(23), [], []
    for _ in range(100):
        a = words(rng, 14)
        b = list(a)
        for i in (2, 6, 10):
            b[i] = chr(97 + (ord(b[i][0]) - 96) % 26) + b[i][1:]
        rows += [(len(rows), f"all of {last} {' '.join(a)}"), (len(rows) + 1, f"all of {last} {' '.join(b)}")]
        more += [" ".join([*words(rng, 20), *x]) for x in (a, b)]
    assert all(alike(rows[i][1], rows[i + 1][1]) for i in range(0, 200, 2))
    # unlike lines give each of a pair further keys, which the other one lacks
    rows += [(1000 + i, x) for i, x in enumerate(more)]
    d = table(spark, rows).selectExpr("doc_id", "text", "'en' as lang", "'s' as source", "length(text) as n_chars")
    assert {r.doc_id for r in unique_lines(spark, d, "").collect() if r.doc_id < 1000} == set(range(0, 200, 2))


def test_unlike_lines_of_a_block_are_not_written_as_pairs(spark, monkeypatch):
    """200 lines of the same words in another order, which letter counts cannot tell apart, and one alike."""
    rng = np.random.default_rng(24)
    base, last = words(rng, 16), words(rng, 3)
    rows = [(i, " ".join([*rng.permutation(base), *last])) for i in range(200)]
    rows.append((200, rows[150][1].replace(base[3], base[3][:-1] + "é")))
    d = table(spark, rows)
    every = lines._lines(d, "text")
    firsts = every.select("lid", "len", F.struct("doc_id", "th", "no").alias("p"), F.lit(1).cast("long").alias("m0"), *[F.lit(None).cast("long").alias(f"m{i}") for i in range(1, 5)])
    firsts, sizes = common.materialise(firsts), []

    def written(df, parts=None):
        out = common.materialise(df, parts)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(lines, "materialise", written)
    got = lines.links(d, every, firsts, "text").join(firsts, F.col("node") == F.col("lid")).select("p.doc_id", "root").collect()
    assert {r.doc_id for r in got} == {150, 200} and len({r.root for r in got}) == 1
    assert max(sizes) <= 4 * len(rows), sizes


def joined(spark, after):
    """The rows of each join in the executions after this one."""
    store, made = spark._jsparkSession.sharedState().statusStore(), []
    runs = store.executionsList()
    for at in (runs.apply(i).executionId() for i in range(runs.size())):
        if at > after:
            values, nodes = store.executionMetrics(at), store.planGraph(at).allNodes()
            for node in (nodes.apply(i) for i in range(nodes.size())):
                metrics = node.metrics() if "Join" in node.name() else None
                for m in (metrics.apply(i) for i in range(metrics.size())) if metrics else ():
                    if m.name() == "number of output rows" and values.contains(m.accumulatorId()):
                        made.append(int(values.apply(m.accumulatorId()).replace(",", "")))
    return made


def test_lines_like_many_of_a_block_do_not_meet_them_all(spark):
    """A block of 600 lines: one in ten is like all others, which are like no other one."""
    rng = np.random.default_rng(25)
    base, rows = words(rng, 60), []
    for i in range(600):
        w = list(base)
        for at in rng.choice(60, 1 if i % 10 == 0 else 5, replace=False):
            w[at] = words(rng, 1)[0]
        rows.append((i, " ".join(w)))
    d = table(spark, rows)
    every = lines._lines(d, "text")
    firsts = every.select("lid", "len", F.struct("doc_id", "th", "no").alias("p"), F.lit(1).cast("long").alias("m0"), *[F.lit(None).cast("long").alias(f"m{i}") for i in range(1, 5)])
    firsts = common.materialise(firsts)
    runs = spark._jsparkSession.sharedState().statusStore().executionsList()
    last = max(runs.apply(i).executionId() for i in range(runs.size()))
    got = lines.links(d, every, firsts, "text").join(firsts, F.col("node") == F.col("lid")).select("p.doc_id", "root").collect()
    assert {r.doc_id for r in got} == set(range(600)) and len({r.root for r in got}) == 1
    assert max(joined(spark, last)) <= 10 * len(rows), sorted(joined(spark, last))[-5:]


def test_signatures_tell_halves_apart(spark):
    row = spark.range(1).select(F.struct(*lines._signature(F.lit("a" * 10 + "b" * 11))).alias("a"), F.struct(*lines._signature(F.lit("b" * 11 + "a" * 10))).alias("b"))
    bits = sum((F.bit_count(F.col(f"a.{c}").bitwiseXOR(F.col(f"b.{c}"))) for c in lines.SIG), F.lit(0))
    assert row.select(bits).first()[0] > 2 * 2
