"""Queries over positions, stops, rollouts, planning, pages and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import bars, planner, policies, simulate
from ..sources import html
from ..streaming import ticks as stream
from .stage import shared
from .views import DENSE30, STEPS, TICK, dense30, table, ticks

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
COSTS = simulate.Costs(commission=0.02, min_commission=0.05, max_commission_pct=0.01, slippage=0.1, min_slippage=0.01, reference_price=100.0, contract_multiplier=5.0)


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


_ALGEBRA = """q AS (SELECT *, p + a AS new, (sign(a) <> sign(p) AND a <> 0 AND p <> 0) AS closing FROM x),
q2 AS (SELECT *, closing AND abs(a) > abs(p) AS switch FROM q),
q3 AS (SELECT *, CASE WHEN switch THEN p WHEN closing THEN p - new ELSE 0 END AS closed,
  CASE WHEN switch THEN new WHEN (a > 0 AND p >= 0) OR (a < 0 AND p <= 0) THEN new - p ELSE 0 END AS opened,
  CASE WHEN switch THEN 0 ELSE least(abs(p), abs(new)) * sign(p) END AS kept FROM q2)"""


@query(f"""WITH x AS (SELECT CAST(p AS INTEGER) AS p, CAST(a AS INTEGER) AS a FROM range(-3, 4) AS t(p), range(-4, 5) AS u(a)), {_ALGEBRA}
SELECT p, a, CAST(new AS DOUBLE) AS new, CAST(closed AS DOUBLE) AS closed, CAST(opened AS DOUBLE) AS opened, CAST(kept AS DOUBLE) AS kept FROM q3""")
def positions_algebra(spark: SparkSession, d: str) -> DataFrame:
    p = spark.range(-3, 4).select(F.col("id").cast("int").alias("p"))
    x = p.withColumn("a", F.explode(F.sequence(F.lit(-4), F.lit(4))))
    return x.select("p", "a", *[c.cast("double").alias(n) for n, c in simulate.positions(F.col("p"), F.col("a")).items()])


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, round(CASE WHEN qty = 0 THEN 0 ELSE least(greatest(qty * 0.02, 0.05), l_extendedprice * qty * 0.01) END, 6) AS fee
FROM (SELECT *, CASE WHEN l_linenumber = 1 THEN 0 ELSE l_quantity END AS qty FROM lineitem)""")
def commission(spark: SparkSession, d: str) -> DataFrame:
    l = table(spark, d, "lineitem")  # noqa: E741
    qty = F.when(F.col("l_linenumber") == 1, 0.0).otherwise(F.col("l_quantity"))
    fee = F.round(simulate.commission(qty, F.col("l_extendedprice"), COSTS), 6)
    return l.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", fee.alias("fee"))


_STEP = f"""WITH {DENSE30}, x AS (SELECT symbol, trade_date, k, open, high, low, close, volume <> 0 AS valid,
  coalesce(lag(close) OVER (PARTITION BY symbol ORDER BY trade_date, k), open) AS prev, (k % 5) - 2 AS p,
  CASE WHEN volume <> 0 THEN (k % 3) - 1 ELSE 0 END AS a, CASE WHEN volume <> 0 THEN open * (0.7 + (k % 7) * 0.1) END AS stop FROM dense30), {_ALGEBRA},
s1 AS (SELECT *, greatest(open * 0.1 / 100.0, 0.01) AS slide, sign(new) AS side FROM q3),
s2 AS (SELECT *, open + slide * sign(a) AS execution, coalesce(CASE WHEN side > 0 THEN stop > low WHEN side < 0 THEN high > stop END, false) AS hit FROM s1),
s3 AS (SELECT *, CASE WHEN hit THEN new ELSE 0 END AS stopped, CASE WHEN abs(a) = 0 THEN 0 ELSE least(greatest(abs(a) * 0.02, 0.05), execution * abs(a) * 0.01) END AS fee FROM s2),
s4 AS (SELECT *, CASE WHEN side >= 0 THEN least(stop, open) ELSE greatest(stop, open) END - slide * sign(stopped) AS fill FROM s3),
s5 AS (SELECT *, CASE WHEN hit AND stopped <> 0 THEN least(greatest(abs(stopped) * 0.02, 0.05), fill * abs(stopped) * 0.01) ELSE 0 END AS stop_fee, CASE WHEN hit THEN fill ELSE close END AS last FROM s4)
SELECT symbol, trade_date, k, CAST(new - stopped AS DOUBLE) AS position, round(execution, 6) AS execution,
  round(((execution - prev) * closed + (last - execution) * opened + (last - prev) * kept) * 5 - fee - stop_fee, 5) AS profit,
  round((execution * (closed - opened) + CASE WHEN hit THEN fill * stopped ELSE 0 END) * 5 - fee - stop_fee, 5) AS cashflow FROM s5"""


@query(_STEP)
def execution(spark: SparkSession, d: str) -> DataFrame:
    b = dense30(spark, d)
    before = F.lag("close").over(W.partitionBy("symbol").orderBy("trade_date", "k"))
    bar = {c: F.col(c) for c in ("open", "high", "low", "close")}
    bar |= {"prev": F.coalesce("prev", "open"), "multiplier": F.lit(1.0), "valid": F.col("volume") != 0}
    b = b.withColumn("prev", before)
    got = simulate.step(F.col("k") % 5 - 2, F.col("k") % 3 - 1, F.col("open") * (F.lit(0.7) + (F.col("k") % 7) * 0.1), bar, COSTS)
    digits = {"position": 6, "execution": 6, "profit": 5, "cashflow": 5}
    return b.select("symbol", "trade_date", "k", *[F.round(c, digits[n]).alias(n) for n, c in got.items()])


@query(f"""WITH {DENSE30}, s AS (SELECT *, row_number() OVER w AS n, max(high * 0.6) OVER (PARTITION BY symbol, trade_date ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS stop
  FROM dense30 WINDOW w AS (PARTITION BY symbol, trade_date ORDER BY k)), h AS (SELECT *, n > 1 AND coalesce(stop > low, false) AS hit FROM s)
SELECT symbol, trade_date, max(open) FILTER (n = 2) AS entry, coalesce(min(k) FILTER (hit), -1) AS exit_at, round(arg_min(least(stop, open), k) FILTER (hit), 6) AS fill, arg_max(close, k) AS last FROM h GROUP BY 1, 2""")
def stop_first_hit(spark: SparkSession, d: str) -> DataFrame:
    b = dense30(spark, d).withColumn("stop", F.col("high") * 0.6)
    x = simulate.first_hit(b, ["symbol"], "trade_date", "k", "stop")
    return x.withColumns({"fill": F.round("fill", 6), "exit_at": F.coalesce("exit_at", F.lit(-1).cast("long"))})


def _episodes(spark: SparkSession, d: str, maintain: policies.Policy) -> DataFrame:
    b = bars.bar_ids(dense30(spark, d), ["symbol"], "trade_date", "k")
    b = b.select("symbol", "date_idx", "time_idx", "open", "high", "low", "close", "volume")
    policy = policies.TradingPolicy(policies.OpenOnce(1), policies.ArtrStop(1.5), maintain, policies.SingleTrade())
    episodes = b.where(f"time_idx < {STEPS - 1}").select("symbol", (F.col("date_idx") * STEPS + F.col("time_idx")).cast("long").alias("episode"), "date_idx", "time_idx")
    x = simulate.rollout(episodes, b, policy, COSTS, ["symbol"], max_steps=96)
    return x.withColumns({n: F.round(n, 6) for n in ("profit", "profit_percent")})


@query()
def rollout_single_entry(spark: SparkSession, d: str) -> DataFrame:
    return _episodes(spark, d, policies.TrailingArtr(1.5))


@query()
def rollout_scaled(spark: SparkSession, d: str) -> DataFrame:
    return _episodes(spark, d, policies.ScaledArtr((1, 4), 1.5))


@query()
def rollout_percent_gain(spark: SparkSession, d: str) -> DataFrame:
    return _episodes(spark, d, policies.PercentGain(1.5, keep=0.4))


_REL = {
    "pre": [("a", "p"), ("b", "q"), ("c", "p"), ("c", "r"), ("d", "s")],
    "add": [("a", "q"), ("b", "r"), ("c", "s"), ("d", "p")],
    "dele": [("a", "p"), ("b", "s"), ("d", "r")],
    "mut": [("q", "s"), ("s", "q")],
}
_VALUES = ", ".join(f"{n}({'x, y' if n == 'mut' else 'action, prop'}) AS (VALUES {', '.join(map(str, v))})" for n, v in _REL.items())


@query(f"""WITH {_VALUES}, m AS (SELECT l.action AS a, r.action AS b FROM add l JOIN dele r USING (prop) UNION ALL SELECT l.action, r.action FROM dele l JOIN pre r USING (prop)
  UNION ALL SELECT l.action, r.action FROM pre l JOIN mut ON l.prop = mut.x JOIN pre r ON r.prop = mut.y)
SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b FROM m WHERE a <> b""")
def plan_mutex(spark: SparkSession, d: str) -> DataFrame:
    rel = {n: spark.createDataFrame(v, "action string, prop string") for n, v in _REL.items()}
    return planner.action_mutex(rel["pre"], rel["add"], rel["dele"], rel["mut"].toDF("p", "q"))


@query(r"""WITH c AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '<!--.*?-->', '', 'gs'), '(<script[^>]*>).*?</script>', '\1', 'gs'), '(<style[^>]*>).*?</style>', '\1', 'gs') AS h FROM pages),
t AS (SELECT page_id, h, regexp_extract(h, '<title[^>]*>([^<]*)', 1) AS title FROM c)
SELECT page_id, len(regexp_extract_all(h, '<a\s[^>]*href')) AS n_links, len(regexp_extract_all(h, '<[A-Za-z]')) AS n_tags,
  trim(regexp_replace(replace(replace(replace(replace(title, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '\s+', ' ', 'g')) AS title FROM t""")
def html_parse(spark: SparkSession, d: str) -> DataFrame:
    return html.page_outline(table(spark, d, "pages"))


@query(f"""WITH {TICK} SELECT symbol, CAST(date_trunc('second', ts) AS TIMESTAMP) AS start, arg_min(price, seq) AS open, max(price) AS high, min(price) AS low,
  arg_max(price, seq) AS close, CAST(sum(size) AS BIGINT) AS volume FROM tick GROUP BY 1, 2""")
def second_stream(spark: SparkSession, d: str) -> DataFrame:
    """One-second windows of the tick stream, fed as several files. As in batches the last second stays
    open until a later event closes it, a last row far ahead, of a symbol of its own, closes all others."""
    at = f"{shared(spark)}/stream-{uuid.uuid4().hex}"
    t = ticks(spark, d).withColumn("ts", F.col("ts").cast("timestamp"))
    # files come in order of time; each is written by a task of its own
    t.repartitionByRange(4, "ts").write.parquet(f"{at}/in")
    end = t.agg(F.lit("~").alias("symbol"), F.max("seq").alias("seq"), (F.max("ts") + F.expr("INTERVAL 9 DAYS")).alias("ts"), F.lit(0.0).alias("price"), F.lit(0).cast("long").alias("size"))
    end.write.mode("append").parquet(f"{at}/in")
    # the files of a trigger are one batch, in which nothing is late
    made = stream.stream_bars(spark.readStream.schema(t.schema).parquet(f"{at}/in"), ["symbol"], 1, "1 day")
    run = made.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(made.schema).parquet(f"{at}/out")
