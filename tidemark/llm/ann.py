"""Approximate nearest neighbours: cross-polytope hashing.

Unit vectors go through seeded pseudo-rotations (three rounds of random signs and a fast Hadamard
transform) and are hashed to the nearest signed axis. Each table has its own rotation, two or three
of them where that is worth it; a query probes the axes it lies nearest to, in order of closeness.
What lies in probed buckets is ranked exactly by Euclidean distance of the original vectors.

How many buckets are probed, and how many axes name a bucket, is fitted: on a bounded sample of
vectors (``FIT_ROWS``), neighbours are found by brute force, and the fewest probes are taken that
meet ``RECALL`` of them. In the whole table neighbours are nearer than in a sample, and nearer
vectors share buckets more often, so the sample errs towards more probes. All buckets may be probed.

Equal vectors are one entry with its smallest ids, which is all that a top-k can show of it.
Buckets beyond ``PART`` entries, or that more than ``PART`` queries probe, are dealt into cells, so a
hot bucket is no hot task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import embeddings, materialise, nothing, small
from .vectors import matrix, usable

TABLES = 6
K = 10
SEED = 17
PART = 8192
#: The fit: neighbours to be met, vectors and queries of the sample, probes of a table of two axes or more.
RECALL = 0.95
FIT_ROWS = 20_000
FIT_QUERIES = 256
MOST_PROBES = 4096
#: From so many different vectors on, tables of two axes are tried too, and of three.
WIDER = (4_000_000, 500_000_000)


def _hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of each row; the row length is a power of two."""
    n, h = x.shape[1], 1
    while h < n:
        y = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(len(x), n)
        h *= 2
    return x


def rotations(dim: int, tables: int = TABLES, seed: int = SEED) -> np.ndarray:
    """Random signs for three rounds of each table, for vectors padded to a power of two."""
    size = 1 << max(1, (dim - 1).bit_length())
    return np.random.default_rng(seed).choice([-1.0, 1.0], size=(tables, 3, size))


def near_axes(vectors: np.ndarray, signs: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``most`` nearest signed axes of each row after one pseudo-rotation, and how near they are;
    axis i is i, its negative is i + size."""
    size = signs.shape[1]
    x = np.zeros((len(vectors), size))
    x[:, : vectors.shape[1]] = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    for s in signs:
        x = _hadamard(x * s) / np.sqrt(size)
    both = np.concatenate([x, -x], axis=1)
    order = both.argmax(axis=1)[:, None] if most == 1 else np.argsort(-both, axis=1, kind="stable")[:, :most]
    return order, np.take_along_axis(both, order, axis=1)


def buckets(vectors: np.ndarray, signs: np.ndarray, probes: int) -> np.ndarray:
    """The ``probes`` nearest buckets of one table: a bucket is one axis for each of the table's
    rotations, its nearness the sum of theirs. ``signs`` has the rotations of the table."""
    base = 2 * signs.shape[2]
    if len(signs) == 1:
        return near_axes(vectors, signs[0], min(base, probes))[0]
    if probes > 64 and len(vectors) > 64:  # bounds the table of sums
        return np.concatenate([buckets(vectors[i : i + 64], signs, probes) for i in range(0, len(vectors), 64)])
    most = min(base, probes)
    code, near = near_axes(vectors, signs[0], most)
    for s in signs[1:]:
        more, value = near_axes(vectors, s, most)
        n = len(vectors)
        code = (code[:, :, None] * base + more[:, None, :]).reshape(n, -1)
        near = (near[:, :, None] + value[:, None, :]).reshape(n, -1)
        best = np.argsort(-near, axis=1, kind="stable")[:, :probes]
        code, near = np.take_along_axis(code, best, axis=1), np.take_along_axis(near, best, axis=1)
    return code


def needed_probes(sample: np.ndarray, signs: np.ndarray, k: int, recall: float = RECALL, queries: int = FIT_QUERIES) -> int | None:
    """The fewest probes a table that meet ``recall`` of the k nearest neighbours inside ``sample``, by
    brute force; None if ``MOST_PROBES`` of a table of several axes don't. ``signs`` has the rotations of all tables."""
    k = min(k, len(sample) - 1)
    if k < 1:
        return 1
    asked = sample[:queries]
    # a neighbour's place in a table is how many buckets are probed before its own
    base, width = 2 * signs.shape[3], signs.shape[1]
    limit = base if width == 1 else min(MOST_PROBES, base**width)
    own = np.stack([buckets(sample, t, 1)[:, 0] for t in signs])
    order = np.stack([_nearest(x, i, sample, k) for i, x in enumerate(asked)])
    met = np.full(order.shape, limit + 1)
    for t, s in enumerate(signs):
        probed = buckets(asked, s, limit)
        for q in range(len(asked)):
            place = {b: i + 1 for i, b in enumerate(probed[q].tolist())}
            met[q] = np.minimum(met[q], [place.get(b, limit + 1) for b in own[t][order[q]].tolist()])
    at = np.sort(met.ravel())[int(np.ceil(recall * met.size)) - 1]
    return int(at) if at <= limit else None


def _nearest(x: np.ndarray, own: int, sample: np.ndarray, k: int) -> np.ndarray:
    d = ((sample - x) ** 2).sum(axis=1)
    d[own] = np.inf
    return np.argpartition(d, k - 1)[:k]


def _hashed(classes: DataFrame, dim: int, tables: int, width: int, probes: int, seed: int, carry: list[str]) -> DataFrame:
    """A row for each of ``classes``, table and probed axis: ``bucket`` and the ``carry`` columns."""
    signs = rotations(dim, tables * width, seed).reshape(tables, width, 3, -1)
    size = (2 * signs.shape[3]) ** width

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            vec = matrix(b.column("vec"))
            for t in range(tables):  # bucket numbers of a table follow those of the one before
                found = buckets(vec, signs[t], probes)
                rows = np.repeat(np.arange(len(vec)), found.shape[1])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(t * size + found.ravel(), pa.int64()), *[b.column(c).take(pa.array(rows)) for c in carry]],
                    names=["bucket", *carry],
                )

    kinds = dict(classes.dtypes)
    fields = ", ".join(f"{c} {kinds[c]}" for c in carry)
    return classes.select("vec", *[c for c in carry if c != "vec"]).mapInArrow(run, f"bucket long, {fields}")


def _distances(v: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Euclidean distances in double precision; scaled where squares would over- or underflow."""
    diff = v - x
    with np.errstate(over="ignore"):
        out = np.sqrt((diff * diff).sum(axis=1))
    odd = np.flatnonzero(~np.isfinite(out) | (out < 1e-140))
    if len(odd):
        big = np.abs(diff[odd]).max(axis=1)
        unit = diff[odd] / np.where(big > 0, big, 1)[:, None]
        out[odd] = big * np.sqrt((unit * unit).sum(axis=1))
    return out


_NEAR = "query long, entry long, low long, score double"


def _rank(left: pd.DataFrame, right: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k + 1 nearest entries of one cell for each query, ties to the smaller key.

    Products sort out what is too far: their rounding error is bounded, and whatever may be among the
    nearest within that bound is ranked by exact differences.
    """
    if not len(left) or not len(right):
        return pd.DataFrame({"query": [], "entry": [], "low": [], "score": []}).astype({"query": "int64", "entry": "int64", "low": "int64", "score": "float64"})
    q, v = np.stack(left["vec"].to_numpy()), np.stack(right["vec"].to_numpy())
    ids, lows, names = right["entry"].to_numpy(), right["low"].to_numpy(), left["query"].to_numpy()
    take = min(len(v), k + 1)
    middle, scale = v[0], max(np.abs(v).max(), np.abs(q).max())
    moved = v / scale - middle / scale  # a common shift leaves distances as they are
    norms = (moved * moved).sum(axis=1)
    slack = 8 * (v.shape[1] + 8) * np.finfo(float).eps
    far = np.sqrt(norms.max())
    out = []
    for at in range(0, len(q), 128):
        block = q[at : at + 128] / scale - middle / scale
        own = (block * block).sum(axis=1)
        near = norms[None, :] - 2 * (block @ moved.T)
        kth = np.partition(near, take - 1, axis=1)[:, take - 1]
        # dividing and shifting round once each, relative to the largest component, which is 1
        error = slack * ((np.sqrt(own) + far) ** 2 + (np.sqrt(own) + far) * np.sqrt(v.shape[1]))
        close = near <= (kth + 2 * error)[:, None]
        for i in range(len(block)):
            cols = np.flatnonzero(close[i])
            exact = _distances(v[cols], q[at + i])
            order = np.lexsort((lows[cols], exact))[:take]
            out.append((np.full(len(order), names[at + i]), ids[cols][order], lows[cols][order], exact[order]))
    return pd.DataFrame({name: np.concatenate([o[c] for o in out]) for c, name in enumerate(("query", "entry", "low", "score"))})


def _fitted(classes: DataFrame, dim: int, n: int, tables: int, seed: int, k: int, width: int | None) -> tuple[int, int]:
    """Axes and probes a table: what meets the recall on the sample with the smallest share of all entries."""
    some = classes.select("vec", F.xxhash64("vec", F.lit(seed)).alias("h"))
    if n > 2 * FIT_ROWS:
        some = some.where(F.col("h") < (2 * FIT_ROWS << 64) // n - (1 << 63))
    rows = some.orderBy("h").limit(FIT_ROWS).collect()
    sample = np.array([r["vec"] for r in rows], dtype=float)
    sample /= np.abs(sample).max()
    best = None
    for w in [width] if width else [w for w, least in enumerate((0, *WIDER), 1) if n >= least]:
        signs = rotations(dim, tables * w, seed).reshape(tables, w, 3, -1)
        probes = needed_probes(sample, signs, k)
        if probes is not None:
            share = probes / (2 * signs.shape[3]) ** w
            best = min(best, (share, w, probes)) if best else (share, w, probes)
    if best is None:  # no probes up to the bound do on this table: all axes of one rotation
        return 1, needed_probes(sample, rotations(dim, tables, seed).reshape(tables, 1, 3, -1), k)
    return best[1], best[2]


def search(
    table: DataFrame, queries, k: int = K, vector: str = "embedding", key: str = "vec_id",
    tables: int = TABLES, probes: int | None = None, width: int | None = None, seed: int = SEED, part: int = PART,
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each row of ``table`` that the condition ``queries``
    holds for, its k nearest other rows found, nearest first, ties to the smaller ``key``.

    Vectors that are null, empty, zero or hold null or non-finite components, rows with a null key,
    and vectors not of the commonest length take no part. A key with several vectors is asked for and
    found by its nearest one; each of them takes a place among a query's k + 1 nearest vectors, so that
    fewer than k keys may be found. A query never finds its own key. A query whose probes
    find fewer than k rows is ranked against all entries. ``probes`` and ``width`` are fitted unless
    given. Other columns are ignored, whatever their names. No rows in, no rows out.
    """
    base = usable(table.select(F.col(key).alias("id"), F.col(vector).alias("v"), queries.alias("asks")), "v").where("id is not null")
    common = base.groupBy(F.size("vec").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if common is None:
        return table.sparkSession.createDataFrame([], schema)
    dim = common["d"]
    base = base.where(F.size("vec") == dim)
    by = W.partitionBy("vec").orderBy("id")
    few = base.select("vec", "id").distinct().withColumn("r", F.row_number().over(by)).where(F.col("r") <= k + 1)
    # a key may have several vectors: entries and queries get numbers, which the written tables keep
    number = F.monotonically_increasing_id()
    classes = few.groupBy("vec").agg(F.min("id").alias("low"), F.array_sort(F.collect_list("id")).alias("ids"))
    classes = materialise(classes.withColumn("entry", number))
    asked = materialise(base.where("asks").select("vec", "id").distinct())
    asking = materialise(asked.select("vec").distinct().withColumn("query", number))

    n = classes.count()
    if width is None or probes is None:
        fit = _fitted(classes, dim, n, tables, seed, k, width)
        width, probes = fit[0], probes or fit[1]
    index = _hashed(classes, dim, tables, width, 1, seed, ["entry", "low", "vec"])
    wanted = _hashed(asking, dim, tables, width, probes, seed, ["query", "vec"])
    # cells of a bucket: parts of entries by parts of queries, both counted
    sizes = index.groupBy("bucket").agg(F.count("*").alias("n"))
    loads = wanted.groupBy("bucket").agg(F.count("*").alias("m"))
    cells = materialise(
        sizes.join(loads, "bucket").select("bucket", F.ceil(F.col("n") / part).cast("int").alias("parts"), F.ceil(F.col("m") / part).cast("int").alias("turns"))
    )
    cells = small(cells)
    each = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    deal = lambda c, by: F.pmod(F.xxhash64(c), F.col(by)).cast("int")
    dealt = index.join(cells, "bucket").withColumn("part", deal("entry", "parts")).withColumn("turn", each("turns"))
    probed = wanted.join(cells, "bucket").withColumn("turn", deal("query", "turns")).withColumn("part", each("parts"))

    def rank(_, left, right):
        return _rank(left, right, k)

    cell = ["bucket", "part", "turn"]
    near = probed.select(*cell, "query", "vec").groupBy(*cell).cogroup(dealt.select(*cell, "entry", "low", "vec").groupBy(*cell)).applyInPandas(rank, _NEAR)
    near = materialise(near.distinct())
    return _answers(near, classes, asking, asked, k, part)


def _answers(near: DataFrame, classes: DataFrame, asking: DataFrame, asked: DataFrame, k: int, part: int) -> DataFrame:
    ids = classes.select("entry", "ids")
    own = asking.join(asked, "vec").select("query", F.col("id").alias("query_id"))

    def top(found: DataFrame) -> DataFrame:
        best = W.partitionBy("query").orderBy("score", "low")
        # k + 1 entries hold k rows besides the query's own
        few = found.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1).drop("r")
        rows = few.join(ids, "entry").select("query", "score", F.explode("ids").alias("vec_id"))
        each = rows.join(own, "query").where("vec_id <> query_id").groupBy("query_id", "vec_id").agg(F.min("score").alias("score"), F.min("query").alias("query"))
        order = W.partitionBy("query_id").orderBy("score", "vec_id")
        return each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    found = materialise(top(near))
    short = own.join(found.groupBy("query_id").agg(F.count("*").alias("n")), "query_id", "left")
    short = materialise(short.where(F.coalesce("n", F.lit(0)) < k).select("query").distinct())
    if not nothing(short):
        # few queries, against all entries in parts, both dealt
        left = asking.join(small(short), "query")
        n, m = (max(1, -(-x.count() // part)) for x in (classes, short))
        at = lambda c, x: F.pmod(F.xxhash64(c), F.lit(x)).cast("int")
        spread = left.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("turn", at("query", m))
        all_ = classes.select("entry", "low", "vec", at("entry", n).alias("part"), F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias("turn"))
        full = spread.groupBy("part", "turn").cogroup(all_.groupBy("part", "turn")).applyInPandas(lambda _, a, b: _rank(a, b, k), _NEAR)
        again = materialise(top(full))
        found = found.join(again.select("query_id").distinct(), "query_id", "left_anti").unionByName(again)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(embeddings(spark, sf_dir), F.col("vec_id") % 100 == 0)
