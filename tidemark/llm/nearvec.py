"""Embedding near-dedup: PCA-ordered tiled comparison.

Unit vectors are turned onto their principal axes, so that the leading dimensions carry most of
every product. Tiles of them are compared in pairs: the leading dimensions are summed first, what
the rest can add is bounded by the product of the suffix norms, and pairs that cannot reach the
threshold are dropped before more dimensions are summed. The principal axes come from one matrix of
dimension * dimension sums over all vectors.

The work is the pairs of blocks of vectors along the first axis. A block meets another only if
their ranges leave room for the threshold. Rows are replicated to the blocks they meet, pairs are
counted where they meet and never emitted: a task returns a count a row and the edges of a
spanning forest.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, embeddings, materialise, nothing
from .vectors import matrix, usable

THRESHOLD = 0.9
#: Vectors a block is meant to hold, and blocks up to which they stay so small: beyond, blocks grow,
#: since each row goes to all blocks that its own meets, until LARGEST is what a task can hold.
BLOCK = 6000
FEW_BLOCKS = 64
LARGEST = 200_000
#: Bytes of a block's vectors in double precision; a task holds two blocks, each in three forms.
BLOCK_BYTES = 32 << 20
#: The first sum takes so many dimensions that on average the rest adds at most threshold - REST.
REST = 0.4
_TILE = 512


def _moments(vectors: DataFrame, dim: int) -> np.ndarray:
    """The sum of the outer products of all unit vectors."""

    def run(batches):
        total = np.zeros((dim, dim))
        for b in batches:
            if b.num_rows:
                u = _unit(matrix(b.column(0)))
                total += u.T @ u
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim * dim)), pa.array(total.ravel())], names=["at", "x"])

    sums = vectors.select("vec").mapInArrow(run, "at long, x double").groupBy("at").agg(F.sum("x").alias("x")).toPandas()
    out = np.zeros(dim * dim)
    out[sums["at"].to_numpy(int)] = sums["x"].to_numpy(float)
    return out.reshape(dim, dim)


def _unit(x: np.ndarray) -> np.ndarray:
    big = np.abs(x).max(axis=1, keepdims=True)
    x = x / big
    return x / np.linalg.norm(x, axis=1, keepdims=True)


class _Ordered:
    """Unit vectors on principal axes in single precision, with the norms of what follows each step."""

    def __init__(self, turned: np.ndarray, steps: tuple[int, ...]):
        self.x = turned.astype(np.float32)
        self.steps = steps
        self.rest = [np.sqrt(np.maximum(0, (turned[:, s:] ** 2).sum(axis=1))).astype(np.float32) for s in steps]


def _close(a: _Ordered, s: slice, b: _Ordered, t: slice, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of rows of two tiles whose cosine may reach the threshold: leading dimensions
    first, the rest bounded by suffix norms. The slack covers single precision."""
    x, y, steps, least = a.x[s], b.x[t], a.steps, np.float32(threshold - 1e-4)
    head = x[:, : steps[0]] @ y[:, : steps[0]].T
    i, j = np.nonzero(head + a.rest[0][s][:, None] * b.rest[0][t] >= least)
    head = head[i, j]
    for k in range(1, len(steps)):
        if not len(i):
            break
        head = head + np.einsum("ij,ij->i", x[i, steps[k - 1] : steps[k]], y[j, steps[k - 1] : steps[k]])
        keep = head + a.rest[k][s][i] * b.rest[k][t][j] >= least
        i, j, head = i[keep], j[keep], head[keep]
    return i, j


def leading(values: np.ndarray, most: float) -> tuple[int, ...]:
    """Where sums stop: after as many leading dimensions as leave at most ``most`` of all energy
    behind, halfway through the rest, and at the end. ``values`` are eigenvalues, greatest first."""
    left = 1 - np.cumsum(values) / values.sum()
    first = min(len(values), int(np.argmax(left <= most)) + 1)
    return tuple(sorted({first, (first + len(values)) // 2, len(values)}))


class _Forest:
    """Union-find over the rows of one task."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, pairs: np.ndarray):
        """Join many pairs; returns those that joined something. Pairs go in by the label of their
        ends, one of each pair of labels, so a dense group costs its rows and not its pairs."""
        made = []
        while len(pairs):
            label = np.array([self.root(x) for x in range(len(self.up))]) if len(pairs) > len(self.up) else None
            ends = label[pairs] if label is not None else np.array([[self.root(x), self.root(y)] for x, y in pairs])
            open_ = ends[:, 0] != ends[:, 1]
            pairs, ends = pairs[open_], ends[open_]
            if not len(pairs):
                break
            _, first = np.unique(ends[:, 0], return_index=True)
            for k in first:
                x, y = self.root(int(ends[k, 0])), self.root(int(ends[k, 1]))
                if x != y:
                    self.up[max(x, y)] = min(x, y)
                    made.append(pairs[k])
            pairs = np.delete(pairs, first, axis=0)
        return made


def _block(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names, numbers of rows and vectors of one block, as arrays and not as objects."""
    held = rows["vec"].to_numpy()
    out = np.empty((len(rows), len(held[0]) if len(held) else 0))
    for i, v in enumerate(held):
        out[i] = v
    return rows["node"].to_numpy(np.int64), rows["n"].to_numpy(np.int64), out


def _compare(rows: pd.DataFrame, lo: int, hi: int, axes: np.ndarray, steps: tuple[int, ...], threshold: float) -> pd.DataFrame:
    """Counts and forest edges of the pairs between block ``lo`` and block ``hi``."""
    same = lo == hi
    # the rows of the first block in front
    first = rows["block"].to_numpy() == lo
    node, weight, original = _block(rows.iloc[np.r_[np.flatnonzero(first), np.flatnonzero(~first)]])
    na = len(node) if same else int(first.sum())
    if not len(node):
        return pd.DataFrame({"u": [], "v": [], "n": []}).astype("int64")
    turned = _Ordered(_unit(original) @ axes, steps)
    links = np.zeros(len(node), dtype=np.int64)
    forest, edges = _Forest(len(node)), []
    base = 0 if same else na
    for s in range(0, na, _TILE):
        for t in range(s if same else base, len(node), _TILE):
            i, j = _close(turned, slice(s, min(s + _TILE, na)), turned, slice(t, t + _TILE), threshold)
            i, j = i + s, j + t
            if same:
                later = i < j
                i, j = i[later], j[later]
            if not len(i):
                continue
            exact = _cosine(original, i, j) >= threshold
            i, j = i[exact], j[exact]
            np.add.at(links, i, weight[j])
            np.add.at(links, j, weight[i])
            edges += forest.join(np.stack([i, j], axis=1))
    some = np.flatnonzero(links)
    u = [*node[some], *[node[x] for x, _ in edges]]
    v = [*node[some], *[node[y] for _, y in edges]]
    n = [*links[some], *[0] * len(edges)]
    return pd.DataFrame({"u": np.array(u, dtype=np.int64), "v": np.array(v, dtype=np.int64), "n": np.array(n, dtype=np.int64)})


def _cosine(x: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    out = np.empty(len(i))
    for at in range(0, len(i), 65536):
        p, q = x[i[at : at + 65536]], x[j[at : at + 65536]]
        out[at : at + 65536] = (p * q).sum(axis=1) / (np.sqrt((p * p).sum(axis=1)) * np.sqrt((q * q).sum(axis=1)))
    return out


def dedup(
    table: DataFrame, threshold: float = THRESHOLD, vector: str = "embedding", key: str = "vec_id", block: int = BLOCK
) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)``, one row for each row of ``table``.

    Vectors link if their cosine in double precision reaches ``threshold``. Vectors that are null,
    empty, zero, hold null or non-finite components, and vectors not of the commonest length link
    with nothing. Equal vectors are compared once and linked with each other. Rows with equal keys
    are rows of their own and share a component if their vectors do. Null keys stay null and name
    no component. Other columns are ignored, whatever their names. Different vectors are told apart by
    64-bit hashes: with N of them two meet by chance with odds N * N / 2**65. No rows in, no rows out.
    """
    rows = table.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v"))
    base = usable(rows, "v")
    common = base.groupBy(F.size("vec").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    if common is None:
        return _result(rows.select("id", F.lit(None).cast("long").alias("node")), None)
    dim = common["d"]
    named = materialise(
        base.where(F.size("vec") == dim).groupBy("vec").agg(F.count("*").alias("n"), F.min("id").alias("low"))
    )
    classes = materialise(named.select(F.xxhash64("vec").alias("node"), "vec", "n", "low"))
    total = classes.count()
    values, turn = np.linalg.eigh(_moments(classes, dim))
    axes = turn[:, ::-1].copy()
    steps = leading(np.maximum(values[::-1], 0), threshold - REST)

    # blocks along the first axis: ends from approximate quantiles, any ends are right
    along = F.aggregate(
        F.zip_with("vec", F.array(*[F.lit(float(x)) for x in axes[:, 0]]), lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x
    ) / F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x))
    largest = max(1, min(LARGEST, BLOCK_BYTES // (8 * dim)))
    blocks = max(-(-total // largest), min(FEW_BLOCKS, -(-total // block)))
    placed = classes.withColumn("x", along)
    ends = placed.approxQuantile("x", [i / blocks for i in range(1, blocks)], 0.2 / blocks) if blocks > 1 else []
    ends = sorted(set(ends))
    where = F.lit(0)
    if ends:
        where = F.size(F.filter(F.array(*[F.lit(e) for e in ends]), lambda e: e < F.col("x")))
    placed = placed.withColumn("block", where)
    ranges = {r["block"]: (r["lo"], r["hi"]) for r in placed.groupBy("block").agg(F.min("x").alias("lo"), F.max("x").alias("hi")).collect()}
    # ranges follow each other, so what a block meets is a run of blocks
    first, last = [0] * blocks, [-1] * blocks
    for p in ranges:
        met_ = [q for q in ranges if _reach(ranges[p], ranges[q]) >= threshold - 1e-9]
        first[p], last[p] = min(met_), max(met_)
    ends_of = lambda x: F.element_at(F.array(*[F.lit(v) for v in x]), F.col("block") + 1)
    sent = placed.withColumn("other", F.explode(F.sequence(ends_of(first), ends_of(last))))
    sent = sent.select(F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "node", "n", "vec")
    held = table.sparkSession.sparkContext.broadcast(axes)

    def run(key_, part):
        return _compare(part, int(key_[0]), int(key_[1]), held.value, steps, threshold)

    met = materialise(sent.groupBy("lo", "hi").applyInPandas(run, "u long, v long, n long"))
    counts = met.where("u = v").groupBy("u").agg(F.sum("n").alias("links")).withColumnRenamed("u", "node")
    edges = met.where("u <> v").select("u", "v")
    groups = components(edges) if not nothing(edges) else None
    known = classes.select("node", "n", "low").join(counts, "node", "left")
    known = known.select("node", "low", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("links"))
    known = known.withColumn("root", F.col("node")) if groups is None else known.join(groups, "node", "left").withColumn("root", F.coalesce("root", "node"))
    known = materialise(known)
    least = materialise(known.groupBy("root").agg(F.min("low").alias("component")))
    known = materialise(known.join(least, "root").select("node", "links", "component"))
    return _result(_with_node(rows, dim), known)


def _reach(p: tuple[float, float], q: tuple[float, float]) -> float:
    """The greatest cosine of unit vectors whose first coordinates lie in two ranges."""
    if p[0] <= q[1] and q[0] <= p[1]:
        return 1.0
    x, y = (p[1], q[0]) if p[1] < q[0] else (q[1], p[0])
    x, y = max(-1.0, min(1.0, x)), max(-1.0, min(1.0, y))
    return x * y + float(np.sqrt((1 - x * x) * (1 - y * y)))


def _with_node(rows: DataFrame, dim: int) -> DataFrame:
    vec = F.col("v").cast("array<double>")
    inf = float("inf")
    fine = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (x != inf) & (x != -inf)) & F.exists(vec, lambda x: x != 0)
    ok = F.coalesce(fine, F.lit(False)) & (F.size(vec) == dim)
    return rows.select("id", F.when(ok, F.xxhash64(vec)).alias("node"))


def _result(rows: DataFrame, known: DataFrame | None) -> DataFrame:
    if known is None:
        found = rows.select("id", F.lit(None).cast("long").alias("links"), F.lit(None).cast("long").alias("component"))
    else:
        # rows without a vector match nothing: dealt out instead of meeting in one task
        at = rows.withColumn("none", F.col("node").isNull()).withColumn("node", F.coalesce("node", F.xxhash64("id")))
        found = at.join(known, "node", "left")
        found = found.select("id", *[F.when(~F.col("none"), F.col(c)).alias(c) for c in ("links", "component")])
    component = F.coalesce("component", "id")
    return found.select(
        F.col("id").alias("vec_id"),
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
    )


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(embeddings(spark, sf_dir))
