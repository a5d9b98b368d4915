"""Bar and quote files: CSV plain or zipped, paths, canonical Parquet tables."""

from __future__ import annotations

import io
import zipfile
from pathlib import PurePosixPath

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Instrument
from ..operators import bars
from ..session import BARS, RAW_BARS, RAW_TICKS

EXTENSIONS = {"raw": ".zip", "processed": ".zip", "bars": ".parquet", "bars_backadjusted": ".parquet", "meta": ".yml"}


def table_path(root: str, source: str, kind: str, interval: str, symbol: str) -> str:
    return str(PurePosixPath(root) / source / kind / interval / (symbol + EXTENSIONS[source]))


def instrument_path(root: str, source: str, instrument: Instrument) -> str:
    return table_path(root, source, instrument.type, instrument.interval, instrument.file_symbol)


def url(scheme: str, source: str, kind: str, interval: str, symbol: str, extension: str | None = None) -> str:
    """``scheme:source/kind/interval/symbol.ext``; an extension other than the source's is an error."""
    want = EXTENSIONS[source]
    if extension is not None and f".{extension.lstrip('.')}" != want:
        raise ValueError(f"{source} files end in {want}")
    return f"{scheme}:{source}/{kind}/{interval}/{symbol}{want}"


def instrument_url(scheme: str, source: str, instrument: Instrument) -> str:
    """With the contract code, so that contracts don't fall together."""
    return url(scheme, source, instrument.type, instrument.interval, instrument.file_symbol)


def read_zipped_csv(spark: SparkSession, path: str, schema) -> DataFrame:
    """Zip is no Hadoop codec: each archive is one task, its members stream through in pieces."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    names, kinds = schema.fieldNames(), {f.name: str for f in schema if f.dataType.typeName() == "string"}

    def unzip(parts):
        for rows in parts:
            for content in rows["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for member in z.namelist():
                        with z.open(member) as f:
                            yield from pd.read_csv(f, header=None, names=names, dtype=kinds, chunksize=100_000)

    return files.mapInPandas(unzip, schema)


def read_bars(spark: SparkSession, path: str, raw: bool = True, zipped: bool = False) -> DataFrame:
    """Raw bars with ``ts``, or canonical bars; files have no header."""
    schema = RAW_BARS if raw else BARS
    df = read_zipped_csv(spark, path, schema) if zipped else spark.read.schema(schema).csv(path)
    if not raw:
        return df
    return df.select(F.concat_ws(" ", "date", "time").try_cast("timestamp_ntz").alias("ts"), "open", "high", "low", "close", "volume")


def write_bars(df: DataFrame, path: str) -> None:
    """Canonical bars as Parquet, in order, so that row groups prune by day."""
    df.select(*BARS.fieldNames()).sortWithinPartitions("ord_trade_date", "offset_time_seconds").write.mode("overwrite").parquet(path)


def read_quotes(spark: SparkSession, path: str) -> DataFrame:
    """A quote file with header; ``seq`` orders rows within a file."""
    df = spark.read.schema(RAW_TICKS).option("header", True).csv(path)
    return df.withColumn("seq", F.monotonically_increasing_id())


def line_count(spark: SparkSession, path: str) -> int:
    return spark.read.text(path).count()


def most_decimals(spark: SparkSession, path: str, columns: tuple[str, ...] = ("Bid", "Ask", "Price"), first: int = 100_000) -> int:
    """The most digits after the point among the first rows of a quote file."""
    df = spark.read.option("header", True).csv(path).limit(first)
    got = df.agg(*[F.max(bars.decimals(F.col(c))).alias(c) for c in columns]).first()
    return max(x or 0 for x in got)


def aggregate_quotes(spark: SparkSession, path: str, out: str) -> None:
    """Quotes to second bars, written as CSV with a header."""
    bars.quote_bars(read_quotes(spark, path), decimals=most_decimals(spark, path)).write.mode("overwrite").option("header", True).csv(out)


def list_paths(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """``(path, modified, length)`` under a root of any store that Spark reads."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(root)
    return files.select("path", F.col("modificationTime").alias("modified"), "length")


class HadoopStore:
    """Existence, times, removal, renaming and listing in any store of Spark's Hadoop configuration."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _at(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{path.lstrip('/')}")
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def mtime(self, path: str) -> float | None:
        fs, p = self._at(path)
        return fs.getFileStatus(p).getModificationTime() / 1000 if fs.exists(p) else None

    def remove(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)

    def rename(self, old: str, new: str) -> None:
        fs, p = self._at(old)
        q = self._at(new)[1]
        fs.mkdirs(q.getParent())
        fs.rename(p, q)

    def put(self, local: str, path: str) -> None:
        fs, p = self._at(path)
        fs.copyFromLocalFile(False, True, self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(local), p)

    def get(self, path: str, local: str) -> None:
        fs, p = self._at(path)
        fs.copyToLocalFile(False, p, self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(local), True)

    def list(self, prefix: str) -> list[str]:
        fs, top = self._at("")
        if not fs.exists(top):
            return []
        found, it, base = [], fs.listFiles(top, True), fs.makeQualified(top).toString().rstrip("/") + "/"
        while it.hasNext():
            name = it.next().getPath().toString()[len(base) :]
            if name.startswith(prefix):
                found.append(name)
        return sorted(found)


def parse_repository_url(text: str) -> tuple[str, str, str]:
    """``github:owner/repo/path`` to its parts."""
    scheme, _, rest = text.partition(":")
    parts = rest.split("/", 2)
    if scheme != "github" or len(parts) < 3 or not all(parts):
        raise ValueError(f"not a repository URL: {text}")
    return parts[0], parts[1], parts[2]
