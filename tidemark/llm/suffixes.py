"""Suffix-array dedup on sparse suffixes.

Suffixes are kept only at minimiser positions: of the k-word grams of every window of ``LENGTH``
words the one of least hash. Equal windows choose the same position, so each repeat of ``LENGTH``
words or more holds a kept suffix. Suffixes are ordered by the hash of their leading words, and
only those with an equal neighbour go on. Their matches are extended left and right: first over
all windows that chose the suffix at once, and where that stretch of text is unlike all others,
window by window.

The result is exact for what it defines: a word is repeated if it lies in a window of ``LENGTH``
words that occurs at two places of the corpus at least (two documents, or two places of one).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordHasher, documents, materialise, mix, slices

#: Words that a repeat has at least, and words of a gram.
LENGTH = 50
GRAM = 8
#: Tables of up to so many rows are broadcast; beyond, the joins are shuffles.
BROADCAST_ROWS = 1_000_000
_U = np.uint64
_B = _U(0xD6E8FEB86659FD93)


class _Text:
    """Hashes of ranges of one text's words."""

    def __init__(self, words: np.ndarray, hasher: WordHasher):
        n = len(words)
        hasher._room(n + 1)
        self.inverse = hasher.inverse
        self.sum = np.zeros(n + 1, dtype=_U)
        np.cumsum(words * hasher.powers[:n], out=self.sum[1:])

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sum[end] - self.sum[start]) * self.inverse[start])


def minimisers(words: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """``(key, at, first, last)`` of each run of windows that share a minimiser: the gram's hash,
    its position, and the first and last window. Of equal hashes the rightmost is chosen."""
    none = np.zeros(0, dtype=np.int64)
    if len(words) < length:
        return none.view(_U), none, none, none
    value = np.zeros(len(words) - gram + 1, dtype=_U)
    for i in range(gram):
        value = value * _B + words[i : len(words) - gram + 1 + i]
    grams = value = mix(value)
    at, size, width = np.arange(len(value)), 1, length - gram + 1

    def lower(v, x, by):
        right = v[by:] <= v[:-by]
        return np.where(right, v[by:], v[:-by]), np.where(right, x[by:], x[:-by])

    while size * 2 <= width:
        value, at = lower(value, at, size)
        size *= 2
    if width > size:
        value, at = lower(value, at, width - size)
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    last = np.r_[first[1:], len(at)] - 1
    return grams[at[first]], at[first], first, last


def _suffixes(docs: DataFrame, text: str, length: int, gram: int, keys_only: bool) -> DataFrame:
    """The kept suffixes: ``key``, or with where they are and the hash of all that their windows span."""

    def run(batches):
        hasher = WordHasher(lower=False)
        for b in slices(batches):
            t = b.column("t").to_pylist()
            keys, whole, first_, last_, owner = [], [], [], [], []
            for i, words in enumerate(hasher(t)):
                key, at, first, last = minimisers(words, length, gram)
                if not len(key):
                    continue
                if keys_only:
                    keys.append(key)
                    continue
                keys.append(key)
                span = _Text(words, hasher).hash(first, last + length)
                whole.append(mix(span ^ ((at - first).astype(_U) << _U(32)) ^ (last - first).astype(_U)))
                first_.append(first)
                last_.append(last)
                owner.append(np.full(len(key), i))
            cat = lambda x, d=np.int64: np.concatenate(x).astype(d) if x else np.zeros(0, d)
            key = pa.array(cat(keys, _U).view(np.int64))
            if keys_only:
                yield pa.RecordBatch.from_arrays([key], names=["key"])
            else:
                of = pa.array(cat(owner))
                yield pa.RecordBatch.from_arrays(
                    [key, pa.array(cat(whole, _U).view(np.int64)), b.column("doc_id").take(of), b.column("th").take(of),
                     pa.array(cat(first_).astype(np.int32)), pa.array(cat(last_).astype(np.int32))],
                    names=["key", "span", "doc_id", "th", "first", "last"],
                )

    t = F.col(text).cast("binary").alias("t")
    if keys_only:
        return docs.select(t).mapInArrow(run, "key long")
    return docs.select("doc_id", F.xxhash64(text).alias("th"), t).mapInArrow(
        run, "key long, span long, doc_id long, th long, first int, last int"
    )


def _windows(asked: DataFrame, length: int) -> DataFrame:
    """``(window, span, doc_id, th, at)`` for the asked runs of windows of each text."""

    def run(batches):
        hasher = WordHasher(lower=False)
        for b in slices(batches):
            asked_runs = b.column("runs").to_pylist()
            hashes, starts, spans, owner = [], [], [], []
            for i, words in enumerate(hasher(b.column("t").to_pylist())):
                at = np.concatenate([np.arange(r["first"], r["last"] + 1) for r in asked_runs[i]])
                spans.append(np.concatenate([np.full(r["last"] - r["first"] + 1, r["span"]) for r in asked_runs[i]]))
                hashes.append(_Text(words, hasher).hash(at, at + length))
                starts.append(at)
                owner.append(np.full(len(at), i))
            if not hashes:
                continue
            of = pa.array(np.concatenate(owner))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(hashes).view(np.int64)), pa.array(np.concatenate(spans)), b.column("doc_id").take(of), b.column("th").take(of),
                 pa.array(np.concatenate(starts).astype(np.int32))],
                names=["window", "span", "doc_id", "th", "at"],
            )

    return asked.select("doc_id", "th", "runs", "t").mapInArrow(
        run, "window long, span long, doc_id long, th long, at int"
    )


def _small(df: DataFrame) -> DataFrame:
    """``df``, materialised, to be broadcast if it has few rows."""
    df = materialise(df)
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def repeats(docs: DataFrame, text: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``(doc_id, start_word, end_word, n_words, first_doc_id)``: each longest stretch of repeated
    words of each document, positions from 0, end exclusive.

    ``first_doc_id`` is the smallest doc_id that holds one of the stretch's windows. Words are
    compared as they are, whatever stands between them. Null texts and texts of fewer than
    ``length`` words have no repeats. Rows with equal doc_id and text count as one document. A null
    doc_id is reported as null and comes first in order. Other columns are ignored. No rows in, no
    rows out.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))
    keys = _suffixes(docs, "text", length, gram, True)
    again = _small(keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"))
    suffixes = materialise(_suffixes(docs, "text", length, gram, False).join(again, "key"))
    place = F.struct("doc_id", "th", "first")
    classes = suffixes.groupBy("key", "span").agg(F.min(place).alias("lo"), F.max(place).alias("hi"))
    classes = materialise(classes.withColumn("alike", ~F.col("lo").eqNullSafe(F.col("hi"))))

    # stretches that occur twice as a whole are repeated; where a gram has several kinds of stretches
    # around it, one of each is compared window by window: kinds may share a passage and its holder
    mixed = classes.groupBy("key").agg(F.count("*").alias("kinds")).where("kinds > 1")
    ask = materialise(classes.join(materialise(mixed.select("key")), "key").select("key", "span", "lo"))
    ends = suffixes.select("key", "span", "doc_id", "th", "first", "last").dropDuplicates()
    runs = ends.join(ask, ["key", "span"]).where(F.struct("doc_id", "th", "first").eqNullSafe(F.col("lo")))
    by_doc = materialise(runs.groupBy("doc_id", "th").agg(F.collect_list(F.struct("span", "first", "last")).alias("runs")))
    held = by_doc.select(F.col("doc_id").alias("di"), F.col("th").alias("tj"), "runs")
    held = F.broadcast(held) if ask.count() <= BROADCAST_ROWS else held.hint("shuffle_hash")
    here = docs.select("doc_id", F.xxhash64("text").alias("th"), F.col("text").cast("binary").alias("t"))
    asked = here.join(held, here["doc_id"].eqNullSafe(F.col("di")) & (here["th"] == F.col("tj")))
    windows = materialise(_windows(asked, length))
    spot = F.struct("doc_id", "th", "at")
    twice = windows.groupBy("window").agg(F.min(spot).alias("lo"), F.max(spot).alias("hi"))
    twice = materialise(twice.where(~F.col("lo").eqNullSafe(F.col("hi"))).select("window", F.col("lo.doc_id").alias("lead")))

    single = materialise(windows.join(twice, "window"))
    sooner = single.groupBy("span").agg(F.min("lead").alias("sooner"))
    leads = classes.where("alike").join(sooner, "span", "left")
    leads = materialise(leads.select("key", "span", F.least("lo.doc_id", "sooner").alias("lead")))
    whole = ends.join(leads, ["key", "span"])
    found = whole.select("doc_id", "th", F.col("first").alias("s"), (F.col("last") + length).alias("e"), "lead")
    single = single.select("doc_id", "th", F.col("at").alias("s"), (F.col("at") + length).alias("e"), "lead")
    return _merged(found.union(single))


def _merged(spans: DataFrame) -> DataFrame:
    """Join spans of a document that overlap or touch. A document's spans are at most its windows."""
    one = spans.groupBy("doc_id", "th").agg(F.array_sort(F.collect_set(F.struct("s", "e", "lead"))).alias("x"))
    none = F.array().cast("array<struct<s:int,e:int,lead:bigint>>")
    state = F.struct(none.alias("out"), F.get("x", F.lit(0)).alias("now"))
    step = lambda a, x: F.when(
        x["s"] <= a["now"]["e"],
        F.struct(
            a["out"].alias("out"),
            F.struct(
                a["now"]["s"].alias("s"), F.greatest(a["now"]["e"], x["e"]).alias("e"), F.least(a["now"]["lead"], x["lead"]).alias("lead")
            ).alias("now"),
        ),
    ).otherwise(F.struct(F.concat(a["out"], F.array(a["now"])).alias("out"), x.alias("now")))
    merged = F.aggregate("x", state, step, lambda a: F.concat(a["out"], F.array(a["now"])))
    each = one.select("doc_id", F.explode(merged).alias("m"))
    return each.select(
        "doc_id",
        F.col("m.s").cast("long").alias("start_word"),
        F.col("m.e").cast("long").alias("end_word"),
        (F.col("m.e") - F.col("m.s")).cast("long").alias("n_words"),
        F.col("m.lead").alias("first_doc_id"),
    )


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats(documents(spark, sf_dir))
