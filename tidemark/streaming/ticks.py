"""Second bars from a stream of ticks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_bars(ticks: DataFrame, keys: list[str], seconds: int = 1, late: str = "0 seconds") -> DataFrame:
    """Bars of closed windows of ``ticks(*keys, seq, ts timestamp, price, size)``.

    The newest window stays open until a later event closes it, as a held-back second would; rows
    later than the watermark are dropped. First and last go by ``seq``.
    """
    window = F.window("ts", f"{seconds} seconds")
    bars = ticks.withWatermark("ts", late).groupBy(*keys, window.alias("w")).agg(
        F.min_by("price", "seq").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.max_by("price", "seq").alias("close"), F.sum("size").cast("long").alias("volume"),
    )
    return bars.select(*keys, F.col("w.start").alias("start"), "open", "high", "low", "close", "volume")
