"""Session defaults and the schemas of stored tables."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession
from pyspark.sql import types as T

RAW_BARS = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("date", "time")]
    + [T.StructField(n, T.DoubleType()) for n in ("open", "high", "low", "close")]
    + [T.StructField("volume", T.IntegerType())]
)
BARS = T.StructType(
    [
        T.StructField("ord_date", T.IntegerType()),
        T.StructField("time_seconds", T.IntegerType()),
        T.StructField("ord_trade_date", T.IntegerType()),
        T.StructField("offset_time_seconds", T.IntegerType()),
        *[T.StructField(n, T.DoubleType()) for n in ("open", "high", "low", "close")],
        T.StructField("volume", T.IntegerType()),
    ]
)
RAW_TICKS = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("Date", "Time")]
    + [T.StructField(n, T.DoubleType()) for n in ("Bid", "Ask", "Price")]
    + [T.StructField("Size", T.LongType())]
)


def session(app: str = "tidemark", cpus: int | None = None, **conf: str) -> SparkSession:
    """A local session with the defaults that the library is tested with; on a cluster use your own."""
    cpus = cpus or os.cpu_count() or 4
    builder = SparkSession.builder.appName(app).master(f"local[{cpus}]")
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": str(cpus),
        "spark.sql.adaptive.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
    }
    for k, v in (defaults | conf).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
