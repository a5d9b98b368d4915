"""The market tables that the queries read out of the star-schema tables, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bars

START = -21_600  # the session starts at 18:00 of the day before
STEP = 1_800
STEPS = 48


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def half_away(x: Column, digits: int) -> Column:
    """``round(x, digits)`` of the SQL twins: the scaled double is rounded, not the decimals that show it.
    What rounds to zero keeps its sign."""
    scaled = x * F.lit(10.0**digits)
    whole = F.when(F.abs(scaled) < 0.5, x * F.lit(0.0)).otherwise(F.round(scaled) / F.lit(10.0**digits))
    return F.when(F.abs(scaled) < float("inf"), whole).otherwise(x)


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_type").alias("symbol"),
        F.col("event_id").alias("seq"),
        "ts",
        F.col("value").alias("price"),
        (1 + F.col("event_id") % 10).alias("size"),
    )


def bar30(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half-hour bars of each symbol and trade date, where anything traded; ``k`` counts from 0."""
    t = bars.session_columns(ticks(spark, sf_dir), START)
    t = t.withColumn("k", F.floor(F.col("offset_s") / STEP).cast("long"))
    return bars.bars_from_ticks(t, ["symbol", "trade_date", "k"]).drop("vwap")


def dense30(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars.densify(bar30(spark, sf_dir), ["symbol", "trade_date"], STEPS - 1, 1, "k")


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One trade a ship date: risk and profit out of the lines of that day."""
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    return l.groupBy(F.to_date("l_shipdate").alias("day")).agg(
        F.round(F.sum("l_extendedprice") / 100, 2).alias("risk"),
        F.round(F.sum((F.col("l_discount") - F.col("l_tax")) * F.col("l_extendedprice")), 2).alias("profit"),
        F.sum("l_quantity").alias("qty"),
    )


def filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(day, name, value)``: four filters a ship date, long."""
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    wide = l.groupBy(F.to_date("l_shipdate").alias("day")).agg(
        F.round(F.avg("l_quantity"), 2).alias("quantity"),
        F.round(F.avg("l_discount"), 4).alias("discount"),
        F.round(F.avg("l_tax"), 4).alias("tax"),
        F.count("*").cast("double").alias("lines"),
    )
    return wide.unpivot(["day"], ["quantity", "discount", "tax", "lines"], "name", "value")


TICK = """tick AS (SELECT event_type AS symbol, event_id AS seq, ts, value AS price, 1 + event_id % 10 AS size FROM events)"""
BAR30 = (
    TICK
    + """,
sess AS (SELECT *, CAST(ts + INTERVAL 6 HOUR AS DATE) AS trade_date,
  (hour(ts) * 3600 + minute(ts) * 60 + second(ts) + 21600) % 86400 AS offset_s FROM tick),
bar30 AS (SELECT symbol, trade_date, offset_s // 1800 AS k, arg_min(price, seq) AS open, max(price) AS high,
  min(price) AS low, arg_max(price, seq) AS close, CAST(sum(size) AS BIGINT) AS volume
  FROM sess GROUP BY symbol, trade_date, offset_s // 1800)"""
)
DENSE30 = (
    BAR30
    + """,
grid AS (SELECT symbol, trade_date, k FROM (SELECT DISTINCT symbol, trade_date FROM bar30), range(48) AS r(k)),
wide AS (SELECT symbol, trade_date, k, open, high, low, close, volume FROM grid FULL JOIN bar30 USING (symbol, trade_date, k)),
dense0 AS (SELECT *, coalesce(
    last_value(close IGNORE NULLS) OVER (PARTITION BY symbol, trade_date ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
    first_value(open IGNORE NULLS) OVER (PARTITION BY symbol, trade_date ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS c FROM wide),
dense30 AS (SELECT symbol, trade_date, CAST(k AS BIGINT) AS k, coalesce(open, high, low, c) AS open, coalesce(high, low, c) AS high,
  coalesce(low, c) AS low, c AS close, coalesce(volume, 0) AS volume FROM dense0)"""
)
TRADES = """trades AS (SELECT CAST(l_shipdate AS DATE) AS day, round(sum(l_extendedprice) / 100, 2) AS risk,
  round(sum((l_discount - l_tax) * l_extendedprice), 2) AS profit, sum(l_quantity) AS qty FROM lineitem GROUP BY 1)"""
FILTERS = """wide AS (SELECT CAST(l_shipdate AS DATE) AS day, round(avg(l_quantity), 2) AS quantity,
  round(avg(l_discount), 4) AS discount, round(avg(l_tax), 4) AS tax, CAST(count(*) AS DOUBLE) AS lines FROM lineitem GROUP BY 1),
filters AS (SELECT day, 'quantity' AS name, quantity AS value FROM wide UNION ALL SELECT day, 'discount', discount FROM wide
  UNION ALL SELECT day, 'tax', tax FROM wide UNION ALL SELECT day, 'lines', lines FROM wide)"""
