"""Language ID: word-first backoff.

Known words are scored by their per-language log frequency. An unseen word falls back to its
longest character n-grams that any language knows, from five characters down to one. The tables
come from a sample of labelled texts bounded for each language (``SAMPLE`` different texts, read
whole, and ``WORDS``/``GRAMS`` entries); every document is then scored over its whole text. Words of
the sample and their n-grams are counted on executors, and only the tables' entries reach the driver.
"""

from __future__ import annotations

import functools
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import documents, materialise, slices, small

#: Bounds of the fit for each language: different labelled texts, words and n-grams of the tables, and
#: words that n-grams are learnt from.
SAMPLE = 1000
WORDS = 30_000
GRAMS = 20_000
LEARNT = 60_000
LONGEST = 5
UNKNOWN = "und"
_WORD = re.compile(r"[^\W\d_]+")
_CACHE = 150_000


def words_of(text: str) -> list[str]:
    """The lower-cased runs of letters."""
    return _WORD.findall(text.lower())


def grams_of(word: str, n: int) -> list[str]:
    """Character n-grams of a word with its edges marked; single characters are unmarked."""
    w = word if n == 1 else f"^{word}$"
    return [w[i : i + n] for i in range(len(w) - n + 1)]


class Model:
    """Log-frequency tables: ``words`` and ``grams[n]`` map an entry to a row of ``rows``, one score a
    language."""

    def __init__(self, langs: list[str]):
        self.langs, self.words, self.grams = langs, {}, {}
        self.rows = self.prior = np.zeros(len(langs))

    @classmethod
    def fit(cls, rows: list[tuple[str, str]], words: int = WORDS, grams: int = GRAMS) -> "Model":
        """``rows`` of (text, lang)."""
        by: dict[str, Counter] = {}
        for text, lang in rows:
            by.setdefault(lang, Counter()).update(words_of(text))
        return cls.of(by, words, grams)

    @classmethod
    def of(cls, by: dict[str, Counter], words: int = WORDS, grams: int = GRAMS) -> "Model":
        """From the counts of each language's words."""
        by = {k: c for k, c in by.items() if c}
        out, parts = cls(sorted(by)), []
        # words seen once say little about unseen text and are left to the n-grams
        often = {k: Counter({w: n for w, n in c.items() if n > 1} or c) for k, c in by.items()}
        out.words = out._logs(often, words, parts)
        for n in range(LONGEST, 0, -1):
            counts = {k: Counter(g for w in c for g in grams_of(w, n)) for k, c in by.items()}
            out.grams[n] = out._logs(counts, grams, parts)
        out.rows = np.concatenate(parts) if parts else np.zeros((0, len(out.langs)))
        return out

    def _logs(self, counts: dict[str, Counter], most: int, parts: list[np.ndarray]) -> dict[str, int]:
        """Add-one smoothed log frequencies of the ``most`` frequent entries of each language."""
        known = sorted({x for c in counts.values() for x, _ in sorted(c.items(), key=lambda p: (-p[1], p[0]))[:most]})
        base = sum(len(p) for p in parts)
        table = np.array([[counts[k][x] + 1 for k in self.langs] for x in known], dtype=float).reshape(len(known), len(self.langs))
        parts.append(np.log(table) - np.log([sum(counts[k].values()) + len(known) + 1 for k in self.langs]))
        return {x: base + i for i, x in enumerate(known)}

    def unseen(self, word: str) -> np.ndarray:
        for n in range(LONGEST, 0, -1):
            table = self.grams[n]
            found = [table[g] for g in grams_of(word, n) if g in table]
            if found:
                return self.rows[found].mean(axis=0)
        return self.prior

    def scorer(self):
        """A function from a text to (language, score). Scores of words once met are kept, up to a bound."""
        ids: dict[str, int] = {}
        rows = np.zeros((1024, max(1, len(self.langs))))

        def score(text: str | None) -> tuple[str, float]:
            nonlocal rows
            found = words_of(text) if text else []
            if not found or not self.langs:
                return UNKNOWN, 0.0
            if len(ids) > _CACHE:
                ids.clear()
                rows = rows[:1024]
            n = len(ids)
            for w in found:
                if w not in ids:
                    if n == len(rows):
                        rows = np.concatenate([rows, np.zeros_like(rows)])
                    v = self.words.get(w)
                    rows[n] = self.unseen(w) if v is None else self.rows[v]
                    ids[w] = n
                    n += 1
            total = rows[np.fromiter((ids[w] for w in found), dtype=np.int64, count=len(found))].sum(axis=0)
            best = int(total.argmax())
            return self.langs[best], float(1 / np.exp(total - total[best]).sum())

        return score


def train(docs: DataFrame, sample: int = SAMPLE, learnt: int = LEARNT) -> Model:
    """Fit on the ``sample`` different labelled texts of lowest hash of each language; never on held-out rows.

    A copy of a text counts once, so a text repeated very often is learnt as one and never collected as
    many. The first count says for each language below which hash about twice as many rows lie; those are
    ranked, and the words of the lowest counted; ``learnt`` words of a language are learnt from.
    """
    labelled = docs.where(~held_out()).where("lang is not null and text is not null").select("text", "lang", F.xxhash64("text").alias("h"))
    sizes = labelled.groupBy("lang").agg(F.approx_count_distinct("h").alias("n"))
    top = F.when(F.col("n") > 2 * sample, F.floor(F.lit(2.0**64 * 2 * sample) / F.col("n")) - F.lit(2.0**63)).otherwise(F.lit(2.0**63))
    # one row a language
    limit = materialise(sizes.select(F.col("lang").alias("l"), top.alias("top")))
    low = labelled.join(small(limit), F.col("lang") == F.col("l")).where(F.col("h") <= F.col("top")).groupBy("lang", "h").agg(F.min("text").alias("text"))
    rank = F.row_number().over(W.partitionBy("lang").orderBy("h"))
    chosen = low.withColumn("r", rank).where(F.col("r") <= sample).select("lang", "text")

    def count(batches):
        by: dict[str, Counter] = {}
        for b in slices(batches, 250):
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                by.setdefault(lang, Counter()).update(words_of(text))
        for lang, c in by.items():
            words = list(c)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(words), pa.string()), pa.array(words, pa.string()), pa.array([c[w] for w in words], pa.int64())], names=["lang", "word", "n"])

    words = chosen.mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    first = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "word"))
    return _tables(materialise(words.withColumn("r", first).where(F.col("r") <= learnt).select("lang", "word", "n")))


def _tables(learnt: DataFrame, words: int = WORDS, grams: int = GRAMS) -> Model:
    """:meth:`Model.of` of a written table ``(lang, word, n)``, with counts and ranks on executors: the driver
    gets the entries of the tables only."""
    most = learnt.groupBy("lang").agg(F.max("n").alias("m")).withColumnRenamed("lang", "l")
    often = learnt.join(F.broadcast(most), F.col("lang") == F.col("l")).where("n > 1 or m = 1")
    parts = [often.select("lang", F.lit(0).alias("size"), F.col("word").alias("x"), "n")]
    for n in range(LONGEST, 0, -1):
        marked = F.col("word") if n == 1 else F.concat(F.lit("^"), "word", F.lit("$"))
        w = learnt.select("lang", marked.alias("w")).where(F.length("w") >= n)
        at = w.select("lang", "w", F.explode(F.sequence(F.lit(1), F.length("w") - n + 1)).alias("at"))
        parts.append(at.select("lang", F.lit(n).alias("size"), F.substr("w", F.col("at"), F.lit(n)).alias("x"), F.lit(1).cast("long").alias("n")))
    counts = materialise(functools.reduce(DataFrame.union, parts).groupBy("lang", "size", "x").agg(F.sum("n").alias("n")))
    rank = F.row_number().over(W.partitionBy("size", "lang").orderBy(F.desc("n"), "x"))
    known = counts.withColumn("r", rank).where(F.col("r") <= F.when(F.col("size") == 0, words).otherwise(grams)).select("size", "x").distinct()
    found = counts.join(known, ["size", "x"], "left_semi").orderBy("size", "x").select("size", "x", "lang", "n").toArrow()
    totals = {(r["size"], r["lang"]): r["n"] for r in counts.groupBy("size", "lang").agg(F.sum("n").alias("n")).collect()}
    model, logs = Model(sorted(r["l"] for r in most.collect())), []
    for n in [0, *range(LONGEST, 0, -1)]:
        part = found.filter(pc.equal(found["size"], n))
        entries = pc.unique(part["x"])
        table = np.ones((len(entries), len(model.langs)))
        table[pc.index_in(part["x"], entries).to_numpy(), pc.index_in(part["lang"], pa.array(model.langs, pa.string())).to_numpy()] += part["n"].to_numpy()
        base = sum(len(p) for p in logs)
        logs.append(np.log(table) - np.log([totals.get((n, k), 0) + len(entries) + 1 for k in model.langs]))
        ids = {x: base + i for i, x in enumerate(entries.to_pylist())}
        if n:
            model.grams[n] = ids
        else:
            model.words = ids
    model.rows = np.concatenate(logs)
    return model


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def predict(docs: DataFrame, model: Model, with_text: bool = True) -> DataFrame:
    """Add ``lang_pred`` and ``score`` to every row of ``docs`` from ``text`` alone.

    ``und`` with score 0 for a null text, one without letters, or a model without languages. The
    score is the posterior of the chosen language under equal priors. Ties go to the first
    language by name. Repeated rows get equal results; the two added names replace columns of the
    same names, other columns pass through, whatever their names. ``with_text=False`` leaves the texts
    out, which then aren't sent back from the workers.
    """
    docs = docs.drop("lang_pred", "score")
    kept = [f for f in docs.schema if with_text or f.name != "text"]
    names = [f.name for f in kept]
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        score = held.value.scorer()
        for b in slices(batches, 250):
            found = [score(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*(c for c, n in zip(b.columns, b.schema.names) if n in names), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())],
                names=[*names, "lang_pred", "score"],
            )

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return docs.mapInArrow(run, f"{fields}, lang_pred string, score double")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = train(docs.select("doc_id", "text", "lang"))
    # written here, where Arrow batches are bounded in bytes
    return materialise(predict(docs.select("doc_id", "text", held_out().alias("held_out")), model, with_text=False))
