"""The training-data operators against brute force, and on awkward rows."""

from __future__ import annotations

import hashlib
import itertools
import math
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import ann, common, jaccard, langid, licences, lines, mixing, nearvec, packing, personal, queries, suffixes

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
DOC = "doc_id long, text string, lang string, source string, extra string"


def docs(spark, rows):
    return spark.createDataFrame([(*r, *[None] * (5 - len(r))) for r in rows], DOC)


AWKWARD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one"), (4, "one"), (None, "no id here at all"), (5, "é" * 3000 + " end"),
    (6, "word " * 5000), (7, " odd  marks"), (8, "line one\n\nline one\n"), (None, None), (9, "x" * 20000),
]


#: Names that operators might use for themselves.
CLASH = ("rn", "_b", "_s", "_k0", "_n", "_in", "_before", "h", "key", "row", "salt", "_passes", "batch", "_t", "_th", "_di", "_gone", "_key", "_base", "_more", "base0", "lid")


def clashing(df):
    return df.withColumns({c: F.lit("x") for c in CLASH})


@pytest.fixture(scope="module")
def awkward(spark):
    return docs(spark, AWKWARD)


@pytest.fixture(scope="module")
def table(spark, sf):
    return common.documents(spark, sf)


@pytest.fixture(scope="module")
def texts(table):
    return {r.doc_id: r.text for r in table.select("doc_id", "text").collect()}


def groups(n, pairs):
    up = {x: x for x in n}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {x: root(x) for x in n}


# ---------------------------------------------------------------- shared pieces


def test_components(spark):
    rng = np.random.default_rng(0)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (300, 2))] + [(i, i + 1) for i in range(1000, 1100)] + [(5000, 5000 + i) for i in range(1, 60)]
    want = {k: v for k, v in groups({x for e in edges for x in e}, edges).items() if any(k in e for e in edges if e[0] != e[1])}
    got = {r.node: r.root for r in common.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == want
    assert common.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_release(spark):
    d = common.materialise(spark.range(3))
    assert d.count() == 3
    kept, common._MADE[:] = common._MADE[:-1], common._MADE[-1:]
    common.release(spark)
    with pytest.raises(Exception):
        d.count()
    common._MADE[:] = kept


@pytest.mark.parametrize("alike", [10_000, 20])
def test_numbered(spark, alike):
    d = spark.range(600).select(
        F.when(F.col("id") >= 500, F.lit(7)).otherwise(F.col("id")).alias("x"), F.when(F.col("id") < 400, F.lit(None).cast("string")).otherwise("b").alias("g"), (F.col("id") % 5).alias("salt")
    )
    got = defaultdict(list)
    for r in common.numbered(common.materialise(d), ["g"], ["x"], 7, alike).collect():
        got[r.g].append(r.rn)
    assert sorted(got[None]) == list(range(1, 401)) and sorted(got["b"]) == list(range(1, 201))


def test_word_hasher():
    h = common.WordHasher()
    texts = [b"A b\tc", None, b"", b"a  B", b"x" * (1 << 21), b"q " * (1 << 20), "é É".encode()]
    got = list(h(texts))
    assert [len(x) for x in got] == [3, 0, 0, 2, 1, 1 << 20, 2]
    assert got[0][0] == got[3][0] and got[0][1] == got[3][1] and got[6][0] != got[6][1] and len(set(got[5])) == 1
    assert list(common.WordHasher(lower=False)([b"A a"]))[0][0] != got[0][0]
    many = list(h([f"w{i}".encode() for i in range(20000)]))
    assert len({int(x[0]) for x in many}) == 20000


# ---------------------------------------------------------------- 1 and 10: vectors


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")


def test_neighbours_recall_and_scores(spark, sf):
    table = common.embeddings(spark, sf)
    got = ann.search(table, F.col("vec_id") % 20 == 0).toPandas()
    rows = table.orderBy("vec_id").toPandas()
    x = np.array(rows.embedding.tolist(), dtype=float)
    ids = rows.vec_id.to_numpy()
    hit = total = 0
    for q, g in got.groupby("query_id"):
        d = np.sqrt(((x - x[ids == q]) ** 2).sum(axis=1))
        d[ids == q] = np.inf
        best = ids[np.lexsort((ids, d))[:10]]
        hit, total = hit + len(set(best) & set(g.vec_id)), total + 10
        g = g.sort_values("rank")
        assert list(g["rank"]) == list(range(1, 11)) and np.allclose(g.score, d[np.searchsorted(ids, g.vec_id)], atol=1e-12)
        assert list(g.score) == sorted(g.score)
    assert hit / total >= 0.9


def test_neighbours_of_awkward_vectors(spark):
    rows = [(i, [1.0, 2.0, 0.0], 0) for i in range(30)] + [(100, [0.0, 0.0, 0.0], 0), (101, None, 0), (102, [1.0, None, 2.0], 0), (103, [float("nan"), 1.0, 1.0], 0), (104, [], 0), (105, [1.0], 0), (200, [3.0, 2.0, 0.0], 0)]
    got = ann.search(vectors(spark, rows + rows[:3]), F.col("vec_id").isin(0, 12, 200, 101), k=10).toPandas()
    by = {q: list(g.sort_values("rank").vec_id) for q, g in got.groupby("query_id")}
    assert by == {0: [*range(1, 11)], 12: [*range(10)], 200: [*range(10)]}
    few = ann.search(vectors(spark, [(0, [1.0, 0.0], 0), (1, [0.0, -1.0], 0)]), F.col("vec_id") == 0).collect()
    assert [(r.query_id, r["rank"], r.vec_id) for r in few] == [(0, 1, 1)]
    assert ann.search(vectors(spark, []), F.col("vec_id") == 0).count() == 0


def test_hadamard_keeps_lengths():
    x = np.random.default_rng(0).normal(size=(5, 16))
    assert np.allclose((ann._hadamard(x) ** 2).sum(axis=1), 16 * (x**2).sum(axis=1))


def test_near_vectors(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(40, 24))
    x = np.concatenate([base, base[:5].repeat(20, axis=0) + 0.12 * rng.normal(size=(100, 24)), base[:3], base[:1] * 2.5, np.repeat(base[7:8], 30, axis=0)])
    rows = [(i, [float(v) for v in r], 0) for i, r in enumerate(x)] + [(900, None, 0), (901, [0.0] * 24, 0), (902, [float("inf")] * 24, 0), (903, [1.0], 0)]
    got = {r.vec_id: r for r in nearvec.dedup(vectors(spark, rows), block=50).collect()}
    cos = (x @ x.T) / np.outer(np.linalg.norm(x, axis=1), np.linalg.norm(x, axis=1))
    link = cos >= 0.9
    np.fill_diagonal(link, False)
    want = groups(range(len(x)), zip(*np.nonzero(link)))
    assert [got[i].n_links for i in range(len(x))] == link.sum(axis=1).tolist()
    assert {i: got[i].component_id for i in range(len(x))} == want
    assert all(got[i].kept == (want[i] == i) for i in range(len(x)))
    assert all((got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True) for i in (900, 901, 902, 903))
    assert nearvec.dedup(vectors(spark, [])).count() == 0 and nearvec.dedup(vectors(spark, rows[-4:])).count() == 4


def test_near_vectors_awkward(spark):
    rows = [(5, [1.0, 0.0]), (5, [0.0, 1.0]), (6, [2.0, 0.0]), (6, [2.0, 0.0]), (7, [0.0, 3.0]), (None, [1.0, 0.01]), (None, None), (8, [-1.0, 0.0])]
    d = vectors(spark, [(*r, 0) for r in rows]).withColumns({c: F.lit("x") for c in ("id", "vec", "node", "links", "kept", "block")})
    got = sorted(((r.vec_id is None, r.vec_id or 0), r.n_links, r.component_id, r.kept) for r in nearvec.dedup(d, block=2).collect())
    # 5 is in two groups, by each of its vectors: rows, not keys, are compared
    assert got == [
        ((False, 5), 1, 5, True), ((False, 5), 3, 5, True), ((False, 6), 3, 5, False), ((False, 6), 3, 5, False), ((False, 7), 1, 5, False), ((False, 8), 0, 8, True),
        ((True, 0), 0, None, True), ((True, 0), 3, 5, True),
    ]


# ---------------------------------------------------------------- 2: repeats


def repeats(texts, length):
    seen = defaultdict(list)
    for i, t in texts.items():
        w = WORDS.findall(t or "")
        for p in range(len(w) - length + 1):
            seen[tuple(w[p : p + length])].append((i, p))
    hit = defaultdict(dict)
    for at in seen.values():
        if len(at) > 1:
            for i, p in at:
                hit[i][p] = min(x for x, _ in at)
    out = set()
    for i, ps in hit.items():
        now = None
        for p in sorted(ps):
            if now and p <= now[1]:
                now = [now[0], p + length, min(now[2], ps[p])]
            else:
                if now:
                    out.add((i, *now))
                now = [p, p + length, ps[p]]
        out.add((i, *now))
    return out


def test_repeats_on_the_tables(table, texts):
    got = {(r.doc_id, r.start_word, r.end_word, r.first_doc_id) for r in suffixes.repeats(table).collect()}
    assert got == repeats(texts, 50) and got


@pytest.mark.parametrize(("length", "gram"), [(8, 3), (12, 4)])
def test_repeats_random(spark, length, gram):
    rng = np.random.default_rng(length)
    base = [f"w{x}" for x in rng.integers(0, 60, 400)]
    texts = {}
    for i in range(40):
        w = [f"w{x}" for x in rng.integers(0, 9, rng.integers(0, 60))]
        for _ in range(3):
            a, n = rng.integers(0, 380), rng.integers(3, 20)
            w += base[a : a + n] + [f"w{rng.integers(0, 60)}"]
        texts[i] = " ".join(w)
    got = {(r.doc_id, r.start_word, r.end_word, r.first_doc_id) for r in suffixes.repeats(docs(spark, texts.items()), length=length, gram=gram).collect()}
    assert got == repeats(texts, length)


def test_repeats_awkward(awkward, spark):
    got = suffixes.repeats(awkward).collect()
    assert {(r.doc_id, r.start_word, r.end_word) for r in got} == {(6, 0, 5000)}
    assert suffixes.repeats(docs(spark, [])).count() == 0


# ---------------------------------------------------------------- 3: lines


def test_lines_removed(spark, awkward):
    d = docs(spark, [(2, "Same line here\nown text"), (1, "same LINE\there \nother\n\nother"), (3, "Same line here"), (3, "Same line here")])
    got = sorted((r.doc_id, r.text, r.n_lines, r.n_removed) for r in lines.dedup(d).collect())
    assert got == [(1, "same LINE\there \nother\n", 4, 1), (2, "own text", 2, 1), (3, "", 1, 1), (3, "", 1, 1)]
    back = lines.dedup(awkward.withColumn("n_lines", F.lit("clash"))).collect()
    assert len(back) == len(AWKWARD) and back[0].asDict().keys() >= {"extra", "n_lines", "n_removed"}
    by = {r.doc_id: r for r in back if r.doc_id is not None}
    assert by[1].text is None and by[1].n_lines == 0 and by[2].n_lines == 1 and by[8].text == "line one\n\n" and by[8].n_removed == 1
    assert lines.dedup(docs(spark, [])).count() == 0


# ---------------------------------------------------------------- 4: language


def test_language_held_out(spark, sf):
    d = common.documents(spark, sf.replace("sf0.001", "sf0.01"))
    model = langid.train(d)
    got = langid.predict(d.select("doc_id", "text", "lang", langid.held_out().alias("h")), model).where("h")
    assert got.where("lang_pred = lang").count() / got.count() > 0.97
    assert got.where("score < 0 or score > 1").count() == 0


def test_language_awkward(spark, awkward, table):
    got = langid.predict(awkward.withColumn("score", F.lit("x")), langid.train(table)).collect()
    assert len(got) == len(AWKWARD) and all(r.lang_pred == "und" and r.score == 0 for r in got if r.text is None or not any(c.isalpha() for c in r.text))
    empty = langid.predict(awkward, langid.train(docs(spark, [])))
    assert {r.lang_pred for r in empty.collect()} == {"und"}
    assert langid.predict(docs(spark, []), langid.train(table)).count() == 0


def test_rare_languages_and_late_words_are_learnt(spark):
    rows = [(i, f"the house and tree number{i}", "en") for i in range(1500)] + [(5000 + i, "la maison " * 4000 + "arbre foret riviere", "fr") for i in range(7)]
    rows += [(9000, "wiederholt und wiederholt", "de")] * 300
    model = langid.train(docs(spark, rows), sample=50)
    s = model.scorer()
    assert model.langs == ["de", "en", "fr"] and s("foret")[0] == "fr" and s("tree")[0] == "en" and s("wiederholt")[0] == "de"


def test_backoff_goes_from_words_to_short_grams():
    m = langid.Model.fit([("haus haus baum baum", "de"), ("house house tree tree", "en")])
    s = m.scorer()
    assert s("haus")[0] == "de" and s("haush")[0] == "de" and s("treez")[0] == "en" and s("123")[0] == "und"


# ---------------------------------------------------------------- 5: licences


def test_licences(spark, sf, awkward):
    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{sf}/documents.parquet'")
    want = sorted(map(tuple, c.sql(licences.sql()).fetchall()))
    assert sorted(map(tuple, queries.QUERIES["op5_licence_scans"](spark, sf).select("doc_id", "sentence_ids", "licences", "n_rules").collect())) == want
    assert sum(bool(r[2]) for r in want) > 3
    back = licences.scan(clashing(awkward).withColumn("licences", F.lit(1))).collect()
    assert {(r.licences, r.n_rules) for r in back} == {("", 0)} and len(back) == len(AWKWARD) and {r.row for r in back} == {"x"}
    assert licences.scan(docs(spark, [])).count() == 0


def wrapped(text, width, prefix=""):
    out, line = [], ""
    for w in text.split():
        if len(line) + len(w) + 1 > width and line:
            out.append(prefix + line)
            line = w
        else:
            line = f"{line} {w}".strip()
    return "\n".join([*out, prefix + line])


MIT, BSD3, APACHE = (licences.TEXTS[x].replace("*", "") for x in ("MIT", "BSD-3-Clause", "Apache-2.0"))
NOTICES = [
    ("MIT License\n\nCopyright (c) 2020 A Person\n\n" + "\n\n".join(wrapped(p, 78) for p in MIT.split("\n")), {"MIT"}),
    (MIT.replace("\n", " "), {"MIT"}),
    ("The MIT License (MIT)\n" + wrapped(MIT.replace("\n", " "), 72, " * "), {"MIT"}),
    ("Copyright 2001. All rights reserved.\n\n" + "\n".join(f"{i}. " * (i in (1, 2, 3)) + wrapped(p, 70) for i, p in enumerate(BSD3.split("\n"))), {"BSD-3-Clause", "proprietary"}),
    (wrapped(BSD3.rsplit("\n", 1)[0].replace("\n", " "), 75, "# "), {"BSD-2-Clause"}),
    ("\n\n".join(wrapped(p, 60, "// ") for p in APACHE.replace("License at\n", "License at\n\nhttp://www.apache.org/licenses/LICENSE-2.0\n\n").split("\n")), {"Apache-2.0"}),
    ("code\n// SPDX-License-Identifier: GPL-2.0-or-later\nmore code", {"GPL-2.0-or-later"}),
    ("Some prose here\nReleased under the MIT License\nand more prose", {"MIT"}),
    ("Released under the Apache License, Version 2.0. Licensed under CC BY-SA 4.0.", {"Apache-2.0", "CC-BY-SA-4.0"}),
    ("The permission to use the software is granted by nobody. A license is a license.", set()),
]


def test_licence_texts_wrapped_and_unwrapped(spark):
    got = {r.doc_id: r for r in licences.scan(docs(spark, [(i, t) for i, (t, _) in enumerate(NOTICES)])).collect()}
    assert {i: set(filter(None, r.licences.split(","))) for i, r in got.items()} == {i: want for i, (_, want) in enumerate(NOTICES)}
    c = duckdb.connect()
    c.execute("create table documents (doc_id bigint, text varchar)")
    c.executemany("insert into documents values (?, ?)", [(i, t) for i, (t, _) in enumerate(NOTICES)])
    assert sorted(c.sql(licences.sql()).fetchall()) == [(i, r.sentence_ids, r.licences, r.n_rules) for i, r in sorted(got.items())]


def test_a_match_leaves_a_gap(spark):
    hope = licences.TEXTS["GPL"].replace("*", "").split("\n")
    got = licences.scan(docs(spark, [(1, f"{hope[0]} {MIT} {hope[1]}".replace("\n", " ")), (2, " ".join(hope))])).collect()
    rules = {r.doc_id: (r.licences, r.n_rules) for r in got}
    assert rules[2] == ("GPL", 1) and rules[1] == ("MIT,GPL", 2)


def test_the_tables_tell_enough_licences():
    assert len({n for n, _ in licences.RULES}) >= 40


# ---------------------------------------------------------------- 6: packing


def test_boundaries_are_optimal():
    rng = np.random.default_rng(0)
    for _ in range(40):
        m = int(rng.integers(1, 9))
        lengths, counts = np.sort(rng.choice(60, m, replace=False)), rng.integers(1, 20, m)
        for k in range(1, 5):
            ends = packing.boundaries(lengths, counts, k)
            cost = lambda e: sum(int(c) * min(x for x in e if x >= v) for v, c in zip(lengths, counts))  # noqa: E731, B023
            best = min(cost([*c, int(lengths[-1])]) for r in range(min(k, m)) for c in itertools.combinations(map(int, lengths[:-1]), r))
            assert len(ends) <= k and ends[-1] == lengths[-1] and cost(ends) == best


def test_batches(spark, table, awkward):
    got = packing.pack(table, buckets=5, budget=4000).collect()
    assert len(got) == table.count()
    batches = defaultdict(list)
    for r in got:
        assert r.n_tokens == len(WORDS.findall(r.text)) <= r.bucket_len
        batches[(r.bucket, r.batch)].append(r)
    for rows in batches.values():
        assert sorted(r.slot for r in rows) == list(range(len(rows)))
        assert len(rows) == 1 or rows[0].bucket_len * len(rows) <= 4000
    back = packing.pack(clashing(awkward)).collect()
    assert len(back) == len(AWKWARD) and all([r[c] for c in CLASH if c != "batch"] == ["x"] * (len(CLASH) - 1) for r in back)
    slots = defaultdict(list)
    for r in back:
        assert r.n_tokens == len(WORDS.findall(r.text or "")) <= r.bucket_len
        slots[(r.bucket, r.batch)].append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert packing.pack(docs(spark, [])).count() == 0


# ---------------------------------------------------------------- 7: Jaccard


def shingles(t, size):
    w = WORDS.findall((t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()


def jaccard_brute(texts, size, percent):
    sets = {i: shingles(t, size) for i, t in texts.items()}
    pairs = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    return {i: (len(sets[i]), r) for i, r in groups(sets, pairs).items()}


@pytest.mark.parametrize(("size", "percent"), [(3, 90), (5, 80)])
def test_jaccard_on_the_tables(table, texts, size, percent):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(table, size=size, percent=percent).collect()}
    assert got == jaccard_brute(texts, size, percent)


def test_jaccard_large_groups(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "LIST_PART", 16)
    monkeypatch.setattr(jaccard, "SHORT", 4)
    rng = np.random.default_rng(3)
    base = [[f"v{x}" for x in rng.integers(0, 300, 70)] for _ in range(3)]
    texts = {}
    for i in range(150):
        w = list(base[i % 3])
        for _ in range(int(rng.integers(0, 4))):
            w[rng.integers(0, 70)] = f"new{rng.integers(0, 9999)}"
        texts[i] = " ".join(w)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(docs(spark, texts.items())).collect()}
    assert got == jaccard_brute(texts, 3, 90)


def test_jaccard_awkward(awkward, spark):
    got = jaccard.join(awkward).collect()
    assert len(got) == len(AWKWARD)
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert (by[1].n_shingles, by[1].component_id, by[3].n_shingles, by[4].n_shingles, by[4].component_id) == (0, 1, 0, 1, 4)
    assert by[6].n_shingles == 1 and {r.component_id for r in got if r.doc_id is None} == {None}
    same = jaccard.join(docs(spark, [(5, "A b"), (3, "a  B"), (7, "a")])).collect()
    assert {(r.doc_id, r.component_id) for r in same} == {(5, 3), (3, 3), (7, 7)}
    assert jaccard.join(docs(spark, [])).count() == 0


# ---------------------------------------------------------------- 8: personal data

BASE = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def luhn(digits):
    return sum(sum(divmod(int(c) * 2, 10)) if i % 2 else int(c) for i, c in enumerate(reversed(digits))) % 10 == 0


def base_spans(text):
    out = []
    for k, (name, pattern) in enumerate(BASE):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            if name == "ip" and any(int(x) > 255 for x in m.group().split(".")):
                continue
            if name == "card" and not (14 <= len(digits) <= 19 and luhn(digits)):
                continue
            if name == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), k, f"{name}:{m.start()}:{m.end()}"))
    return [x[2] for x in sorted(out)]


HARD = [
    "a@b.c.d@e.f g", "a@b.c_d@e.f", "x..y@z-1.co.uk.", "@a.b c@d", "a@b..c", "1.2.3.4.5.6.7.8", "001.002.255.256 1.1.1.1", "999.1.1.1 0000255.1.1.1",
    "4111 1111 1111 1111", "4111-1111-1111-1111 4111  1111 1111 1111", "41111111111111111 5", "+1 (555) 123-4567 +12", "+1+2 345 678 9012", "é😀 a@b.cd +49 30 1234567 é",
    "@b.c ab@c.d 41111111", "tel +1.555.123.4567.", "a" * 5000 + "@b.c", "1 " * 4000, "1" * 4000, "a@" + "b." * 3000 + "c", "0.0.0.0 a%+-._@b-.c-",
]


def test_base_spans(spark, texts):
    rows = [*enumerate(HARD, 10_000), *texts.items(), (-1, None)]
    d = docs(spark, rows)
    got = {r.doc_id: r.j for r in personal.base_spans(d).select("doc_id", personal._joined(F.col("_base")).alias("j")).collect()}
    assert got == {i: ",".join(base_spans(t)) for i, t in rows}


def test_disclosing_terms(spark):
    rows = [(i, f"Filler text number {i} of common words and more") for i in range(200)]
    rows += [(300 + i, f"Zebulon wrote {'to' if i % 2 else 'about'} zed@corp.example case{i} common words and filler Zebulon") for i in range(4)]
    rows += [(400, "Zebulon common words"), (401, "a b zed@corp.example"), (402, None)]
    found = personal.find(docs(spark, rows).withColumn("spans", F.lit(1)))
    got = {r.doc_id: r for r in found.select("doc_id", "text", personal._joined(F.col("base")).alias("b"), personal._joined(F.col("spans")).alias("s")).collect()}
    assert got[300].b == "email:20:36" and got[300].s.split(",")[0] == "term:0:7" and got[300].s.count("term") == 4 and got[300].text[0:7] == "Zebulon"
    assert "term" not in got[5].s and got[400].s == "term:0:7" and got[401].s == got[401].b and got[402].s == ""
    clean = {r.doc_id: r.text for r in personal.sanitise(found).select("doc_id", "text").collect()}
    assert "zed@" not in clean[301] and "Zebulon" not in clean[301] and "<email>" in clean[301] and clean[7] == rows[7][1]
    assert clean[400] == " common words" and clean[402] is None


def test_disclosure_by_definition(spark):
    """Term spans against counts in plain Python, over texts with entities of different spread."""
    rng = np.random.default_rng(3)
    words = [f"{a}{b}{c}" for a in "bcdfg" for b in "aeiou" for c in "lmnrs"]
    rows = []
    for i in range(300):
        w = list(rng.choice(words, 12))
        if i % 9 == 0:
            w += [f"mail u{i % 4}@site{i % 4}.example", f"nick{'abcd'[i % 4]}"]
        if i % 60 == 7:
            w.append("nicka")
        rows.append((i, " ".join(w)))
    got = {r.doc_id: r.s.split(",") if r.s else [] for r in personal.find(docs(spark, rows)).select("doc_id", personal._joined(F.col("spans")).alias("s")).collect()}
    texts = {t for _, t in rows}
    entities = {t: {m.group() for m in re.finditer(BASE[0][1], t)} for t in texts}
    terms = {t: {w.lower() for w in re.findall(r"[^\W\d_]{3,}", re.sub(BASE[0][1], " ", t))} for t in texts}
    in_all = Counter(w for t in texts for w in {w.lower() for w in re.findall(r"[^\W\d_]{3,}", t)})
    told, n = set(), len(texts)
    for e, n_e in Counter(e for t in texts for e in entities[t]).items():
        for w, n_et in Counter(w for t in texts if e in entities[t] for w in terms[t]).items():
            if n_e >= 3 and n_et >= 3 and math.log(n * n_et / (n_e * in_all[w])) >= 0.9 * math.log(n / n_e):
                told.add(w)
    assert told and told < set(words) | {f"nick{c}" for c in "abcd"}
    for i, t in rows:
        inside = [m.span() for m in re.finditer(BASE[0][1], t)]
        want = [f"term:{m.start()}:{m.end()}" for m in re.finditer(r"(?<![^\W\d_])[^\W\d_]+(?![^\W\d_])", t) if m.group().lower() in told and not any(m.start() < e and s < m.end() for s, e in inside)]
        assert [x for x in got[i] if x.startswith("term")] == want


def test_overlapping_spans_are_cut_as_one(spark):
    rows = [(1, "write to bob@10.0.0.1 today please"), (2, "4111 1111 1111 1111, a@b.cd é"), (3, None), (4, "")]
    found = personal.find(clashing(docs(spark, rows)))
    got = {r.doc_id: r for r in personal.sanitise(found).collect()}
    assert got[1].text == "write to <email> today please" and got[2].text == "<card>, <email> é"
    assert got[3].text is None and got[4].text == "" and got[1]._base == "x" and got[1]._key == "x"


def test_personal_query(spark, sf, texts):
    got = {r.doc_id: r for r in queries.QUERIES["op8_personal_data"](spark, sf).collect()}
    for i, t in texts.items():
        want = base_spans(t)
        assert got[i].base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [got[i][f"n_{k}"] for k, _ in BASE] == [sum(x.startswith(k) for x in want) for k, _ in BASE]
        assert set(want) <= set(got[i].spans.split(",")) | {""}


def test_personal_awkward(awkward, spark):
    assert personal.find(awkward).where("size(spans) > 0").count() == 0 and personal.find(awkward).count() == len(AWKWARD)
    assert personal.find(docs(spark, [])).count() == 0


# ---------------------------------------------------------------- 9: mixing


def reshared(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    names = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    out, budget, free = {}, share * sum(sizes.values()), set(names)
    while True:
        total = sum(w[s] for s in free)
        over = {s for s in free if budget * w[s] / total > most * sizes[s]} if total else set()
        if not over:
            return out | {s: budget * w[s] / total for s in free}
        for s in over:
            out[s] = most * sizes[s]
            budget -= out[s]
            free.discard(s)


def test_mix(spark, sf):
    d = common.documents(spark, sf)
    got = mixing.mix(d).collect()
    size, taken, target, each = Counter(), Counter(), {}, defaultdict(list)
    for r in got:
        assert r.size == len(WORDS.findall(r.text)) and r.taken <= 2 * r.size and (r.size == 0 or r.taken % r.size == 0)
        size[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
        each[r.source].append(r.size)
    want = reshared(size)
    for s in size:
        sums, (passes, left) = 1, divmod(target[s], size[s])
        for x in each[s]:
            sums |= sums << x
        best = next(b for b in range(round(left), -1, -1) if sums >> b & 1)
        assert math.isclose(target[s], want[s], rel_tol=1e-12) and taken[s] == passes * size[s] + best
    again = {(r.doc_id, r.taken) for r in mixing.mix(d.repartition(7)).collect()}
    assert again == {(r.doc_id, r.taken) for r in got}


def test_mix_awkward(spark, awkward):
    got = mixing.mix(clashing(awkward).withColumn("taken", F.lit("clash"))).collect()
    assert len(got) == len(AWKWARD) and all(r.source_size == sum(x.size for x in got) for r in got)
    assert all([r[c] for c in CLASH] == ["x"] * len(CLASH) for r in got)
    total = sum(r.size for r in got)  # half of the text of 5000 words can't be taken, all others can once more
    assert all(r.taken in (r.size, 2 * r.size) for r in got) and sum(r.taken for r in got) == 2 * total - 5000
    assert mixing.mix(docs(spark, [])).count() == 0
    blank = mixing.mix(docs(spark, [(1, None, None, "a"), (2, "x y", None, "b"), (3, "z", None, None)])).collect()
    assert {(r.doc_id, r.target, r.taken) for r in blank} == {(1, 0.0, 0), (2, 3.0, 2), (3, 1.5, 1)}


def test_mix_of_one_text_very_often(spark, monkeypatch):
    monkeypatch.setattr(common, "ALIKE", 20)
    d = docs(spark, [(1, "a b", None, "s")] * 500 + [(i, "a b c", None, "s") for i in range(2, 100)])
    got = mixing.mix(d).collect()
    assert len(got) == 598 and sum(r.taken for r in got) == 1.5 * (1000 + 3 * 98)


def test_knapsack_reaches_what_can_be_reached():
    lengths = np.array([1, *range(10, 10009, 2)])
    assert (mixing.fit(lengths, np.ones(len(lengths), int), 32767) * lengths).sum() == 32767
    take = mixing._knapsack(np.arange(3, 90, 2), np.ones(44, int), 400, segment=3)
    assert (take * np.arange(3, 90, 2)).sum() == 400 and take.max() == 1


def test_fit_is_exact_when_it_can_be():
    rng = np.random.default_rng(1)
    for _ in range(60):
        lengths = np.sort(rng.choice(np.arange(1, 40), 5, replace=False))
        counts = rng.integers(1, 6, 5)
        budget = int(rng.integers(0, (lengths * counts).sum() + 1))
        take = mixing.fit(lengths, counts, budget)
        assert (take >= 0).all() and (take <= counts).all() and (lengths * take).sum() <= budget
    take = mixing.fit(np.array([3, 5]), np.array([100, 100]), 401)
    assert (np.array([3, 5]) * take).sum() == 401


# ---------------------------------------------------------------- the pipeline


def test_pipeline(spark, sf):
    import corpus_pipeline as cp

    stages = dict(cp.STAGES)
    raw = common.documents(spark, sf)
    a = common.materialise(stages["language ID"](spark, raw, sf))
    assert a.columns == list(cp.COLUMNS) and a.count() >= 0.97 * raw.count()
    b = common.materialise(stages["line dedup"](spark, a, sf))
    assert b.columns == list(cp.COLUMNS) and b.where("n_chars <> length(text)").count() == 0
    seen = Counter(line for r in b.collect() for line in r.text.split("\n") if re.search(r"\w", line))
    assert max(seen.values()) == 1
    c = common.materialise(stages["n-gram Jaccard join"](spark, b, sf))
    left = {r.doc_id: r.text for r in b.collect()}
    want = {i for i, (n, root) in jaccard_brute(left, 5, 80).items() if i == root}
    assert {r.doc_id for r in c.collect()} == want
    d = common.materialise(stages["mixing"](spark, c, sf))
    assert d.columns == list(cp.COLUMNS)
    mixed = {r.doc_id: r.taken // max(r.size, 1) for r in mixing.mix(c).collect()}
    assert Counter(r.doc_id for r in d.collect()) == Counter({i: n for i, n in mixed.items() if n})
    assert stages["packing"](spark, d, sf).count() == d.count()
    assert cp.run(spark, sf).count() == d.count()


def test_pipeline_awkward(spark):
    """Each stage on nulls, empty and long texts, repeated rows and keys, clashing columns; and on no rows."""
    import corpus_pipeline as cp

    long = " ".join(f"word{i % 900} und" for i in range(30_000))
    rows = [*AWKWARD, (20, long, "de", "s"), (20, long, "de", "s"), (21, long + " end", "de", None), (None, "der text ohne nummer hier", "de", "s"), (22, "the plain text of one line", "en", "t"), (22, "another text of that number", "en", "t")]
    d = docs(spark, rows).withColumn("n_chars", F.length("text").cast("long"))
    d = common.materialise(d.withColumns({c: F.lit("x") for c in ("row", "lid", "_t", "rn", "key", "node")}))
    empty = d.limit(0).select(*cp.COLUMNS)
    for i, (name, stage) in enumerate(cp.STAGES):
        before = d.count()
        d = common.materialise(stage(spark, d, "unused"))
        last = i == len(cp.STAGES) - 1
        assert last or d.columns == list(cp.COLUMNS), name
        assert name == "mixing" or d.count() <= before, name
        none = common.materialise(stage(spark, empty, "unused"))
        assert none.count() == 0 and (last or none.columns == list(cp.COLUMNS)), name
        if name == "language ID":
            assert d.where("text is null or trim(text) = ''").count() == 0
        if name == "n-gram Jaccard join":
            assert sorted(r.doc_id for r in d.where("doc_id in (20, 21, 22)").select("doc_id").collect()) == [20, 22]


def test_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert [n for n in names if n.startswith("op")] and {int(n[2:].split("_")[0]) for n in names if n.startswith("op")} == set(range(1, 11))
    assert "pipeline" in names
