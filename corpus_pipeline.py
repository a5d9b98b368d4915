"""From raw documents to packed training batches: five stages, each on all that its predecessor kept.

What the stages make of awkward rows: a document without a text, or whose text has no letters, has no
language and goes in the first. Null and repeated doc_ids, repeated rows, ties and very long texts are
kept as each operator's docstring says; rows of one doc_id that survive line dedup are one document
for the Jaccard stage, rows without a doc_id are documents of their own. An empty table stays empty.
Only the columns of ``documents`` are read, so others may have any names; they don't come out.
"""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import common, jaccard, langid, lines, mixing, packing
from tidemark.llm.common import WORD, shared_dir

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Documents whose language is chosen with less than this are rejected, as are those without any.
LEAST_SCORE = 0.3

_OPEN: list[str] = []


def stage(f):
    """A stage is called when its predecessor is written: the tables in between that the
    predecessor's plan read are no longer needed then and go."""

    @functools.wraps(f)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        common.forget(spark, _OPEN)
        before = common.made()
        out = f(spark, docs, sf_dir)
        _OPEN[:] = common.made_since(before)
        return out

    return run


@stage
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a known language; ``lang`` becomes the predicted one."""
    found = langid.predict(docs.select(*COLUMNS), langid.train(docs))
    kept = found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE))
    return kept.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


@stage
def unique_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines removed; documents of which no word is left go."""
    found = lines.dedup(docs.select(*COLUMNS))
    kept = found.where((F.col("n_removed") == 0) | F.col("text").rlike(WORD))
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


@stage
def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five words a shingle, similarity 0.8."""
    groups = jaccard.join(docs, size=5, percent=80)
    first = groups.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    keep = common.materialise(first.groupBy(F.col("doc_id").alias("_k")).agg(F.count("*").alias("_n")))
    kept = docs.join(common.small(keep), docs["doc_id"].eqNullSafe(F.col("_k")), "left_semi").select(*COLUMNS)
    if common.nothing(keep.where("_n > 1 and _k is not null")):
        return kept
    # rows of one doc_id are one document
    return kept.where("doc_id is null").union(kept.where("doc_id is not null").dropDuplicates(["doc_id"]))


@stage
def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    mixed = mixing.mix(docs.select(*COLUMNS))
    times = F.floor(F.col("taken") / F.greatest(F.col("size"), F.lit(1))).cast("int")
    return mixed.where("taken > 0").withColumn("_t", F.explode(F.array_repeat(F.lit(1), times))).select(*COLUMNS)


@stage
def batches(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's bucket, batch and slot."""
    packed = packing.pack(docs.select(*COLUMNS))
    return packed.select("doc_id", "lang", "source", "n_tokens", "bucket", "bucket_len", "batch", "slot")


STAGES = [
    ("language ID", language),
    ("line dedup", unique_lines),
    ("n-gram Jaccard join", near_copies),
    ("mixing", mixture),
    ("packing", batches),
]

#: The stages' decisions cannot be written as SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again. A stage's table goes once
    the next one is written; the last one goes with :func:`tidemark.llm.common.release`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    at = f"{shared_dir(spark).rstrip('/')}/pipeline/{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{i}")
        docs = spark.read.parquet(f"{at}/{i}")
        common.forget(spark, _OPEN)
        if i:
            common.forget(spark, [f"{at}/{i - 1}"])
    common.keep(f"{at}/{len(STAGES) - 1}")
    return docs
