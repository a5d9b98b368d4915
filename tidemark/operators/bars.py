"""Ticks to bars, session columns, densifying, complete days, resampling.

Everything is grouping and windows on declared keys, so Catalyst combines before shuffles and prunes
columns. ``first`` and ``last`` always go by an explicit sequence column, never by row order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: The ordinal of 1970-01-01 when 0001-01-01 is day 1.
EPOCH_ORDINAL = 719_163


def second_of_day(ts: Column | str) -> Column:
    return (F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)).cast("int")


def bars_from_ticks(
    ticks: DataFrame, keys: Sequence[str], seq: str = "seq", price: str = "price", size: str = "size", decimals: int = 4
) -> DataFrame:
    """First, highest, lowest and last price, volume and volume-weighted price of each group of
    ``keys``; ticks without a price are not first or last. The weighted price is the last price where no
    size traded; it rounds half to even."""
    weighted = F.try_divide(F.sum(F.col(price) * F.col(size)), F.sum(size))
    priced = F.when(F.col(price).isNotNull(), F.col(seq))
    return ticks.groupBy(*keys).agg(
        F.min_by(price, priced).alias("open"),
        F.max(price).alias("high"),
        F.min(price).alias("low"),
        F.max_by(price, priced).alias("close"),
        F.sum(size).cast("long").alias("volume"),
        F.bround(F.coalesce(weighted, F.max_by(price, priced)), decimals).alias("vwap"),
    )


def quote_bars(quotes: DataFrame, keys: Sequence[str] = ("Date", "Time"), seq: str = "seq", decimals: int = 4) -> DataFrame:
    """The same for bid, ask and price of a quote file, each with its own four prices."""
    aggs = []
    for c in ("Bid", "Ask", "Price"):
        aggs += [
            F.bround(f(c), decimals).alias(f"{c}_{n}")
            for n, f in (
                ("open", lambda x: F.min_by(x, seq)),
                ("high", F.max),
                ("low", F.min),
                ("close", lambda x: F.max_by(x, seq)),
            )
        ]
    weighted = F.try_divide(F.sum(F.col("Price") * F.col("Size")), F.sum("Size"))
    return quotes.groupBy(*keys).agg(
        *aggs,
        F.sum("Size").cast("long").alias("volume"),
        F.bround(F.coalesce(weighted, F.max_by("Price", seq)), decimals).alias("vwap"),
    )


def session_columns(df: DataFrame, start: int, ts: str = "ts") -> DataFrame:
    """``trade_date`` and ``offset_s`` of a session that starts ``start`` seconds after midnight; a
    negative start counts an evening to the next day."""
    shifted = F.col(ts) - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(start))
    return df.withColumn("trade_date", F.to_date(shifted)).withColumn(
        "offset_s", F.pmod(second_of_day(ts) - F.lit(start), F.lit(86_400)).cast("int")
    )


def ordinal(day: Column | str) -> Column:
    return (F.datediff(day, F.lit("1970-01-01")) + EPOCH_ORDINAL).cast("int")


def final_columns(df: DataFrame, start: int) -> DataFrame:
    """The canonical four time columns from ``trade_date`` and ``offset_s``."""
    at = F.col("offset_s") + F.lit(start)
    return (
        df.withColumn("ord_trade_date", ordinal("trade_date"))
        .withColumn("time_seconds", F.pmod(at, F.lit(86_400)).cast("int"))
        .withColumn("ord_date", (F.col("ord_trade_date") + F.floor(at / 86_400)).cast("int"))
    )


def keep_days(df: DataFrame, day: str = "trade_date", start=None, remove: Sequence = (), weekdays: Sequence[int] = range(7)) -> DataFrame:
    """Days from ``start`` on, not among ``remove``, on ``weekdays`` (Monday is 0)."""
    kept = df.where(F.weekday(day).isin(*weekdays))
    if start is not None:
        kept = kept.where(F.col(day) >= F.lit(start))
    return kept.where(~F.col(day).isin(*remove)) if len(remove) else kept


def densify(bars: DataFrame, keys: Sequence[str], end: int, step: int, offset: str = "offset_s") -> DataFrame:
    """Every grid offset 0, step, ..., end of each group of ``keys``.

    The grid is joined outside, so rows off the grid stay. A missing close is the close before it,
    in front the first open; missing open, high, low take the next of them in that order, at last
    the close; a missing volume is 0.
    """
    grid = bars.select(*keys).distinct().withColumn(offset, F.explode(F.sequence(F.lit(0), F.lit(end), F.lit(step))))
    full = grid.join(bars, [*keys, offset], "full")
    by = W.partitionBy(*keys).orderBy(F.asc_nulls_last(offset))
    before = by.rowsBetween(W.unboundedPreceding, 0)
    whole = by.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    close = F.coalesce(F.last("close", True).over(before), F.first("open", True).over(whole))
    full = full.withColumn("close", close)
    return full.select(
        *keys,
        offset,
        F.coalesce("open", "high", "low", "close").alias("open"),
        F.coalesce("high", "low", "close").alias("high"),
        F.coalesce("low", "close").alias("low"),
        "close",
        F.coalesce("volume", F.lit(0)).alias("volume"),
    )


def complete_days(bars: DataFrame, keys: Sequence[str], total: int, value: str = "open") -> DataFrame:
    """Groups of ``keys`` that hold exactly ``total`` rows with a value."""
    n = F.count(value).over(W.partitionBy(*keys))
    return bars.withColumn("_n", n).where(F.col("_n") == total).drop("_n")


def process(bars: DataFrame, keys: Sequence[str], start: int, end: int, step: int, days: dict | None = None) -> DataFrame:
    """Raw bars with ``ts`` to canonical bars: session columns, day filters, grid, clip, complete days."""
    df = keep_days(session_columns(bars, start), **(days or {}))
    dense = densify(df.select(*keys, "trade_date", "offset_s", "open", "high", "low", "close", "volume"), [*keys, "trade_date"], end, step)
    clipped = dense.where(F.col("offset_s").between(0, end))
    return final_columns(complete_days(clipped, [*keys, "trade_date"], end // step + 1), start)


def resample(bars: DataFrame, keys: Sequence[str], index: str, k: int, name: str = "k") -> DataFrame:
    """``k`` bars of a day to one: first open, highest, lowest, last close, summed volume."""
    return bars.groupBy(*keys, F.floor(F.col(index) / k).cast("long").alias(name)).agg(
        F.min_by("open", index).alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", index).alias("close"),
        F.sum("volume").cast("long").alias("volume"),
    )


def bar_ids(bars: DataFrame, keys: Sequence[str], day: str = "trade_date", offset: str = "offset_s") -> DataFrame:
    """``date_idx`` and ``time_idx``, both from 0, of dense bars."""
    if keys:
        by_day, in_day = W.partitionBy(*keys).orderBy(day), W.partitionBy(*keys, day).orderBy(offset)
    else:
        by_day, in_day = W.orderBy(day), W.partitionBy(day).orderBy(offset)
    return bars.withColumn("date_idx", F.dense_rank().over(by_day) - 1).withColumn("time_idx", F.row_number().over(in_day) - 1)


def next_bar(date_idx: Column, time_idx: Column, steps: int) -> tuple[Column, Column]:
    bar = date_idx * steps + time_idx + 1
    return F.floor(bar / steps).cast("long"), F.pmod(bar, F.lit(steps)).cast("long")


def previous_bar(date_idx: Column, time_idx: Column, steps: int) -> tuple[Column, Column]:
    bar = date_idx * steps + time_idx - 1
    return F.floor(bar / steps).cast("long"), F.pmod(bar, F.lit(steps)).cast("long")


def completed_coarse(date_idx: Column, time_idx: Column, steps: int, ratio: int) -> tuple[Column, Column]:
    """The last completed coarse bar seen from a fine bar: next fine bar, divided, one coarse bar back."""
    day, at = next_bar(date_idx, time_idx, steps)
    coarse = -(-steps // ratio)
    return previous_bar(day, F.floor(at / ratio).cast("long"), coarse)


def decimals(text: Column) -> Column:
    """Digits after the point of a number in text, 0 without a point."""
    t = F.trim(text)
    dot = F.instr(t, ".")
    return F.when(dot > 0, F.length(t) - dot).otherwise(0).cast("int")


def short_number(x: Column, most: int) -> Column:
    """At most ``most`` decimals, without trailing zeros and point; empty for null."""
    t = F.format_string(f"%.{most}f", x)
    return F.when(x.isNull(), F.lit("")).otherwise(F.regexp_replace(t, r"\.?0+$", "") if most > 0 else t)
