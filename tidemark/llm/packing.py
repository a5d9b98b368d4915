"""Packing: optimal length buckets, then batches under a token budget inside each bucket."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, numbered, parts_for, sized

BUCKETS = 16
BUDGET = 65_536
SEED = 42


def boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int = BUCKETS) -> list[int]:
    """The upper ends of at most ``buckets`` length ranges that pad the fewest tokens in all.

    ``lengths`` are distinct and ascending. Padding is sum(end * documents) less a constant, so
    the best split up to length j with one bucket more is
    ``min_i best[i] + lengths[j] * (cum[j] - cum[i])``: lines of falling slope asked at rising
    points, a hull kept in a queue. O(buckets * lengths), exact.
    """
    m = len(lengths)
    if not m:
        return []
    cum = [0, *np.cumsum(counts).tolist()]
    ends = [int(x) for x in lengths]
    best = [0, *[None] * m]
    back: list[list[int]] = []
    for _ in range(min(buckets, m)):
        hull: list[int] = []
        head, new, frm = 0, [None] * (m + 1), [0] * (m + 1)
        for j in range(1, m + 1):
            i = j - 1
            if best[i] is not None:
                while len(hull) - head >= 2:
                    a, b = hull[-2], hull[-1]
                    # b is never lowest if the crossing of a and i lies left of that of a and b
                    if (best[i] - best[a]) * (cum[b] - cum[a]) <= (best[b] - best[a]) * (cum[i] - cum[a]):
                        hull.pop()
                    else:
                        break
                hull.append(i)
            x = ends[j - 1]
            while len(hull) - head >= 2 and best[hull[head + 1]] - x * cum[hull[head + 1]] <= best[hull[head]] - x * cum[hull[head]]:
                head += 1
            if head < len(hull):
                new[j], frm[j] = best[hull[head]] + x * (cum[j] - cum[hull[head]]), hull[head]
        best = new
        back.append(frm)
    cuts, j = [], m
    for frm in reversed(back):
        cuts.append(ends[j - 1])
        j = frm[j]
        if j == 0:
            break
    return cuts[::-1]


def pack(docs: DataFrame, buckets: int = BUCKETS, budget: int = BUDGET, seed: int = SEED, text: str = "text", key: str = "doc_id", columns: list[str] | None = None) -> DataFrame:
    """Add ``n_tokens, bucket, bucket_len, batch, slot`` to ``columns`` (all) of every row of ``docs``.

    Tokens are words. The histogram of all lengths decides the bucket ends; its rows on the driver
    are bounded by the number of distinct lengths, at most sqrt(2 * all tokens). A batch holds
    floor(budget / bucket_len) documents of one bucket, at least one, so that padded it stays in
    the budget; a document over the budget is a batch of its own. Null and blank texts have
    length 0 and share the bucket they fall in. Repeated rows are packed each. Extra columns pass
    through, whatever their names; the five added names replace columns of the same names. No rows
    in, no rows out.
    """
    added = ("n_tokens", "bucket", "bucket_len", "batch", "slot")
    kept = [c for c in columns or docs.columns if c not in added]
    table = sized(docs, text, list(dict.fromkeys([*kept, key])))
    hist = sorted((r["size"], r["n"]) for r in table.groupBy("size").agg(F.count("*").alias("n")).collect())
    total = sum(h[1] for h in hist)
    ends = boundaries(np.array([h[0] for h in hist], dtype=np.int64), np.array([h[1] for h in hist], dtype=np.int64), buckets)
    ends_ = F.array(*[F.lit(int(e)).cast("long") for e in ends]) if ends else F.array(F.lit(0).cast("long"))
    placed = table.withColumn("bucket", F.size(F.filter(ends_, lambda e: e < F.col("size"))).cast("long"))
    placed = placed.withColumn("bucket_len", F.get(ends_, F.col("bucket").cast("int")))
    placed = placed.withColumn("key", F.col(f"row.`{key}`")).withColumn("h", F.xxhash64(F.lit(seed), "key", "size"))
    ranked = numbered(placed, ["bucket"], ["h", "key", "size"], parts_for(total))
    room = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest(F.col("bucket_len"), F.lit(1)))).cast("long")
    at = F.col("rn") - 1
    return ranked.select(
        *[F.col(f"row.`{c}`") for c in kept], F.col("size").alias("n_tokens"), "bucket", "bucket_len",
        F.floor(at / room).cast("long").alias("batch"),
        (at % room).cast("long").alias("slot"),
    )


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), columns=["doc_id"])
