"""Mixing sources to target weights: subset-sum budget fitting.

Each source gets a word target from its weight. Whole passes over the source use up as much of
the target as they can. What is left is fitted on the histogram of exact document lengths: every
length gives the same share of its documents, the remaining budget is filled with further whole
documents, the last of it by bounded-knapsack dynamic programming over the lengths. Which
documents of a length are taken is a seeded choice.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import documents, materialise, numbered, parts_for, sized, small

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
SEED = 42
#: The dynamic programme fits what is left below so many words (one Python integer of as many bits).
DP_WORDS = 1 << 15


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``sizes(source, source_size)``, one row a source, to ``(source, source_size, target)``.

    Weights repeat over the sources by code point, null last. Water filling: with the sources in
    order of the level at which they stop, the first level that no later source exceeds is the
    one at which nothing is above its limit. The rows are one a source, whatever they weigh; they are
    sorted in one task, which is good for some millions of sources.
    """
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    i = (F.row_number().over(by_name) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (i + 1).cast("int"))
    s = sizes.withColumn("_w", weight).withColumn("_cap", F.col("source_size") * F.lit(most))
    s = s.withColumn("_stop", F.col("_cap") / F.col("_w"))
    by_stop = W.orderBy("_stop", F.col("source").asc_nulls_last())
    before = by_stop.rowsBetween(W.unboundedPreceding, -1)
    after = by_stop.rowsBetween(0, W.unboundedFollowing)
    budget = F.sum("source_size").over(W.partitionBy()) * F.lit(share)
    left = budget - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))
    s = s.withColumn("_level", left / F.sum("_w").over(after))
    level = F.max(F.when(F.col("_level") <= F.col("_stop"), F.col("_level"))).over(W.partitionBy())
    return s.withColumn("_all", level).select(
        "source",
        "source_size",
        F.least("_cap", F.coalesce(F.col("_all"), F.lit(float("inf"))) * F.col("_w")).alias("target"),
    )


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int, dp_words: int = DP_WORDS) -> np.ndarray:
    """How many documents of each length to take so that their words come to ``budget``, or as
    near below it as whole documents allow. ``lengths`` are distinct and positive."""
    take = np.zeros(len(lengths), dtype=np.int64)
    total = int((lengths * counts).sum())
    if budget <= 0 or not total:
        return take
    if budget >= total:
        return counts.copy()
    take = (counts.astype(object) * budget // total).astype(np.int64)
    left = budget - int((lengths * take).sum())
    order = np.argsort(-lengths, kind="stable")
    for i in order:  # whole documents, long ones first, until the programme can take over
        if left <= dp_words:
            break
        more = min(int(counts[i] - take[i]), (left - dp_words) // int(lengths[i]) + 1, left // int(lengths[i]))
        take[i] += more
        left -= more * int(lengths[i])
    for i in order[::-1]:  # a few short documents back, so that the programme can choose among them
        if left >= dp_words:
            break
        less = min(int(take[i]), max(1, (dp_words - left) // (4 * int(lengths[i]))))
        take[i] -= less
        left += less * int(lengths[i])
    if left > 0:
        take += _knapsack(lengths, counts - take, left)
    return take


def _knapsack(lengths: np.ndarray, free: np.ndarray, budget: int, segment: int = 256) -> np.ndarray:
    """Bounded subset sum: the reachable sums are the bits of one integer; counts go in by powers of two.

    Sums are kept once a ``segment`` of items and made again on the way back, so that memory is
    bounded by 2 * segment integers for any number of lengths below the budget, without a cap.
    """
    mask = (1 << (budget + 1)) - 1
    items = []
    for i in np.argsort(-lengths, kind="stable"):
        n, step = min(int(free[i]), budget // int(lengths[i])), 1
        while n > 0:
            step = min(step, n)
            items.append((int(i), step, step * int(lengths[i])))
            n -= step
            step *= 2
    reach, kept, used = 1, [1], 0
    for i, _, words in items:
        if reach >> budget & 1:
            break
        reach |= reach << words & mask
        used += 1
        if used % segment == 0:
            kept.append(reach)
    best = reach.bit_length() - 1
    take = np.zeros(len(lengths), dtype=np.int64)
    for at in range((used - 1) // segment, -1, -1):
        some = items[at * segment : min((at + 1) * segment, used)]
        sums = [kept[at]]
        for _, _, words in some:
            sums.append(sums[-1] | sums[-1] << words & mask)
        for before, (i, step, words) in zip(sums[-2::-1], some[::-1]):
            if not before >> best & 1:
                take[i] += step
                best -= words
    return take


def _fit_source(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("size", kind="stable")
    size, n = rows["size"].to_numpy(np.int64), rows["n"].to_numpy(np.int64)
    total, target = int((size * n).sum()), float(rows["target"].iloc[0])
    passes = int(target // total) if total else 0
    take = fit(size, n, int(round(target - passes * total)))
    return rows[["source", "size"]].assign(_passes=passes, _extra=take)


def mix(
    docs: DataFrame, seed: int = SEED, text: str = "text", source: str = "source", key: str = "doc_id", columns: list[str] | None = None, **kw
) -> DataFrame:
    """Add ``size``, ``source_size``, ``target`` and ``taken`` to ``columns`` (all) of every row of ``docs``.

    A null or blank text has size 0 and is taken 0 times. A null source is a source of its own,
    last in order. Repeated rows count each; of rows alike in doc_id and length any may be taken,
    which makes no difference where rows are alike. Extra columns pass through, whatever their
    names; the four added names replace columns of the same names. No rows in, no rows out.
    """
    added = ("size", "source_size", "target", "taken")
    kept = [c for c in columns or docs.columns if c not in added]
    table = sized(docs, text, list(dict.fromkeys([*kept, source, key])))
    rows = table.select("row", "size", "salt", F.col(f"row.`{source}`").cast("string").alias("source"), F.col(f"row.`{key}`").alias("key"))
    hist = materialise(rows.groupBy("source", "size").agg(F.count("*").alias("n")))
    goal = materialise(targets(hist.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).cast("long").alias("source_size")), **kw))
    plan = hist.where("size > 0").join(goal, hist["source"].eqNullSafe(goal["source"])).select(hist["source"], "size", "n", "target")
    plan = materialise(plan.groupBy("source").applyInPandas(_fit_source, "source string, size long, _passes long, _extra long"))
    plan = small(plan.select(F.col("source").alias("_ps"), F.col("size").alias("_pz"), "_passes", "_extra"))
    total = hist.agg(F.sum("n")).first()[0] or 0
    ordered = rows.withColumn("h", F.xxhash64(F.lit(seed), "key"))
    ranked = numbered(ordered, ["source", "size"], ["h", "key"], parts_for(total))
    same = F.col("source").eqNullSafe(F.col("_ps")) & (F.col("size") == F.col("_pz"))
    g = small(goal.select(F.col("source").alias("_s"), "source_size", "target"))
    picked = ranked.join(plan, same, "left").join(g, F.col("source").eqNullSafe(F.col("_s")))
    times = F.col("_passes") + F.when(F.col("rn") <= F.col("_extra"), 1).otherwise(0)
    taken = F.coalesce(F.col("size") * times, F.lit(0)).cast("long")
    return picked.select(*[F.col(f"row.`{c}`") for c in kept], "size", "source_size", "target", taken.alias("taken"))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir), columns=["doc_id"])
