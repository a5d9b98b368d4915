"""Shared pieces of the training-data operators.

* :func:`materialise` cuts lineage by writing a Parquet table in the shared checkpoint folder.
* :func:`components` finds connected components with star contraction, DataFrame functions only.
* :func:`sized` and :func:`numbered` count words once and number rows inside groups of any size
  without putting a group into one task.
* :class:`WordHasher` hashes the words of many texts at once with numpy (used inside Arrow UDFs).
"""

from __future__ import annotations

import contextlib
import functools
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates words in the contracts: space and 0x09-0x0D.
WORD = r"[^\x20\x09-\x0D]+"
_MADE: list[str] = []


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Without one, a local
    session makes a temporary folder; on a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    jvm_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
    if jvm_dir.isDefined():
        return jvm_dir.get()
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    made = tempfile.mkdtemp(prefix="tidemark-")  # one machine, one process
    spark.sparkContext.setCheckpointDir(made)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def parts_for(rows: int, each: int = 100_000) -> int:
    """Tasks that so many small rows are worth."""
    return max(1, -(-rows // each))


@contextlib.contextmanager
def settings(spark: SparkSession, held: dict) -> Iterator[None]:
    """Settings of the session for a while, for what is written then."""
    before = {k: spark.conf.get(k, None) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def materialise(df: DataFrame, parts: int | None = None) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back; by ``parts`` tasks if its
    size is known to be worth no more.

    Unlike ``localCheckpoint`` the table outlives any executor, and unlike ``checkpoint`` it is
    columnar, compressed and prunable.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/tidemark/{uuid.uuid4().hex}"
    # workers hold whole Arrow batches: bounded in bytes, however long the texts are
    with settings(spark, {_BATCH: BATCH_BYTES}):
        (df.coalesce(parts) if parts else df).write.parquet(path)
    _MADE.append(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes of an Arrow batch that Python workers are sent.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"

#: Rows up to which a written table is broadcast.
BROADCAST_ROWS = 1_000_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A written table, to be broadcast if it has at most ``rows`` rows; else as it is, to be shuffled."""
    return F.broadcast(df) if df.count() <= rows else df


def made() -> int:
    """How many tables :func:`materialise` has written in this process and not deleted."""
    return len(_MADE)


def keep(path: str) -> None:
    """Have :func:`release` delete this table too."""
    _MADE.append(path)


def made_since(before: int) -> list[str]:
    return _MADE[before:]


def forget(spark: SparkSession, paths: list[str]) -> None:
    """Delete tables that :func:`materialise` wrote. Results that read them and were not yet written
    or collected can no longer be read."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for name in paths:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(conf).delete(path, True)
        if name in _MADE:
            _MADE.remove(name)


def release(spark: SparkSession) -> None:
    """Delete all of them, for instance between jobs of a long session."""
    forget(spark, list(_MADE))


def nothing(df: DataFrame) -> bool:
    return not df.take(1)


def components(edges: DataFrame, local: bool = False) -> DataFrame:
    """``edges(u, v)`` of longs to ``(node, root)``: root is the smallest node that is reachable.

    Alternates large-star and small-star steps. Minima come from map-side combined aggregates and
    go through a written table, so that both sides of each join are plain exchanges and adaptive
    execution can split a node with very many edges. Nodes without an edge are not returned.
    """
    now = materialise(
        edges.where("u is not null and v is not null and u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
    )
    parts = parts_for(now.count())
    while True:
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = materialise(both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m")), parts)
        big = (
            both.where("v > u")
            .join(low, "u")
            .where("v <> m")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .distinct()
        )
        big = materialise(big, parts)
        low = materialise(big.groupBy("u").agg(F.min("v").alias("m")), parts)
        small = (
            big.join(low, "u")
            .where("v <> m")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(low.select("u", F.col("m").alias("v")))
            .distinct()
        )
        now = materialise(small, parts)
        # done once every node has one neighbour, which has none
        ends = now.select("u", F.lit(1).alias("low"), F.lit(0).alias("high")).union(now.selectExpr("v", "0", "1"))
        ends = ends.groupBy("u").agg(F.sum("low").alias("low"), F.max("high").alias("high"))
        if nothing(ends.where("low > 1 or low = 1 and high = 1")):
            break
    root = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return root.union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


#: Rows alike beyond so many are dealt into SALTS parts.
ALIKE = 10_000
SALTS = 64


def numbered(df: DataFrame, keys: list[str], order: list[str], buckets: int, alike: int | None = None) -> DataFrame:
    """Add ``rn``: 1, 2, ... inside each group of ``keys``, in order of a hash bucket of ``order`` and
    then of ``order`` itself. ``df`` is a written table with column names of our own; its ``salt``, a
    number below :data:`SALTS`, tells rows of equal order apart.

    A group may hold any share of all rows, and so may rows of equal order: a group is dealt into
    hash buckets, and what comes more often than ``alike`` into salted buckets of its own, each numbered
    alone and shifted by the sizes of those before it. Which of rows of equal order comes first is open.
    """
    from pyspark.sql import Window as W

    match = lambda names, by: [F.col(k).eqNullSafe(F.col(f"_{by}{i}")) for i, k in enumerate(names)]
    both = lambda tests: functools.reduce(lambda x, y: x & y, tests)
    name = [*keys, *order]
    hot = df.groupBy(*name).agg(F.count("*").alias("_n")).where(F.col("_n") > (ALIKE if alike is None else alike))
    hot = materialise(hot.select(*[F.col(k).alias(f"_h{i}") for i, k in enumerate(name)], F.lit(True).alias("_hot")))
    bucket, salt = F.pmod(F.xxhash64(*order), F.lit(buckets)), F.lit(0)
    if not nothing(hot):
        df = df.join(small(hot), both(match(name, "h")), "left").drop(*[f"_h{i}" for i in range(len(name))])
        bucket, salt = F.when(F.col("_hot"), F.lit(buckets) + F.pmod(F.xxhash64(*order), F.lit(1 << 40))).otherwise(bucket), F.when(F.col("_hot"), F.col("salt")).otherwise(0)
    df = df.withColumns({"_b": bucket, "_s": salt}).drop("_hot")
    cell = [*keys, "_b", "_s"]
    sizes = df.groupBy(*cell).agg(F.count("*").alias("_n"))
    before = W.partitionBy(*keys).orderBy("_b", "_s").rowsBetween(W.unboundedPreceding, -1)
    shift = sizes.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(cell)], F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(W.partitionBy(*cell).orderBy(*order))
    found = df.withColumn("_in", inside).join(shift, both(match(cell, "k"))).withColumn("rn", (F.col("_in") + F.col("_before")).cast("long"))
    return found.drop("_b", "_s", "_in", "_before", *[f"_k{i}" for i in range(len(cell))])


def sized(docs: DataFrame, text: str, columns: list[str]) -> DataFrame:
    """A written table ``(row, size, salt)``: ``columns`` of ``docs`` as one struct, which no name can clash
    with; the number of words of the text, counted once (0 for a null text); and a number for
    :func:`numbered`, which stays as it is however often the table is read."""
    row = F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row")
    size = F.coalesce(F.regexp_count(F.col(f"`{text}`"), F.lit(WORD)), F.lit(0)).cast("long")
    return materialise(docs.select(row, size.alias("size"), F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int").alias("salt")))


def slices(batches, rows: int = 1000):
    """Arrow batches in pieces of few rows, so that a worker holds few texts as Python objects."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


# ---------------------------------------------------------------- hashing words with numpy

_U = np.uint64
#: An odd multiplier and its inverse modulo 2**64.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_PIECE = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit integers (the public splitmix64 constants)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class WordHasher:
    """Word hashes of texts given as UTF-8 bytes. Words are the maximal runs of bytes other than
    space and 0x09-0x0D; A-Z are lower-cased if ``lower``. Texts go through in pieces of about
    1 MB cut between words, so memory stays bounded however long a text is."""

    def __init__(self, lower: bool = True):
        table = np.arange(256, dtype=np.uint8)
        if lower:
            table[65:91] += 32
        self.table = table
        self.sep = np.zeros(256, dtype=bool)
        self.sep[[9, 10, 11, 12, 13, 32]] = True
        self.powers = np.zeros(0, dtype=_U)
        self.inverse = np.zeros(0, dtype=_U)

    def _room(self, n: int) -> None:
        if len(self.powers) < n:
            n = max(n, _PIECE + (1 << 16))
            for name, base in (("powers", _BASE), ("inverse", _INVERSE)):
                p = np.full(n, base, dtype=_U)
                p[0] = 1
                setattr(self, name, np.multiply.accumulate(p))

    def _piece(self, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes, starts and ends of the words of ``data``."""
        raw = np.frombuffer(data, dtype=np.uint8)
        gap = np.ones(len(raw) + 2, dtype=bool)
        gap[1:-1] = self.sep[raw]
        turn = np.flatnonzero(gap[1:] != gap[:-1])
        start, end = turn[0::2], turn[1::2]
        self._room(len(raw) + 1)
        total = np.zeros(len(raw) + 1, dtype=_U)
        np.cumsum((self.table[raw].astype(_U) + _U(1)) * self.powers[: len(raw)], out=total[1:])
        value = (total[end] - total[start]) * self.inverse[start]
        return mix(value ^ ((end - start).astype(_U) << _U(40))), start, end

    def _cut(self, text: bytes) -> Iterator[bytes]:
        at = 0
        while len(text) - at > _PIECE:
            to = at + _PIECE
            while to > at and not self.sep[text[to - 1]]:
                to -= 1
            if to == at:  # one word longer than a piece stays whole
                to = at + _PIECE
                while to < len(text) and not self.sep[text[to]]:
                    to += 1
            yield text[at:to]
            at = to
        yield text[at:]

    def __call__(self, texts: Iterable[bytes | None]) -> Iterator[np.ndarray]:
        """The hashes of each text's words, in order; an empty array for a null text."""
        waiting: list[bytes] = []
        length = 0
        for text in texts:
            text = text or b""
            if len(text) > _PIECE:
                yield from self._several(waiting)
                waiting, length = [], 0
                yield np.concatenate([self._piece(p)[0] for p in self._cut(text)])
                continue
            waiting.append(text)
            length += len(text) + 1
            if length > _PIECE:
                yield from self._several(waiting)
                waiting, length = [], 0
        yield from self._several(waiting)

    def _several(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        if not texts:
            return
        found, start, _ = self._piece(b"\n".join(texts))
        ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts)))
        yield from np.split(found, np.searchsorted(start, ends)[:-1])
