"""Queries over calendars and continuous futures."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..operators import futures
from .views import DENSE30, dense30, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def _cal_sql(name: str, kind: str, first: int, last: int) -> str:
    """The same calendar as SQL; the holidays are literals."""
    days = ", ".join(f"DATE '{d}'" for d in sorted(cal.holidays(kind, range(first - 1, last + 2))))
    return f"""{name} AS (SELECT d, is_bd, CAST(sum(is_bd::INT) OVER (ORDER BY d) AS INTEGER) AS bd_no,
  max(CASE WHEN is_bd THEN d END) OVER (ORDER BY d) AS prev_bd FROM (SELECT CAST(r AS DATE) AS d,
  isodow(r) < 6 AND CAST(r AS DATE) NOT IN ({days}) AS is_bd FROM range(DATE '{first}-01-01', DATE '{last + 1}-01-01', INTERVAL 1 DAY) AS t(r)))"""


@query(f"""WITH {_cal_sql('us', cal.US, 1994, 2003)}, {_cal_sql('uk', cal.UK, 1994, 2003)}
SELECT o_orderkey, us.is_bd AS us_bd, us.prev_bd AS us_prev, uk.is_bd AS uk_bd, uk.prev_bd AS uk_prev,
  CAST(us.bd_no AS INTEGER) AS us_no FROM orders JOIN us ON us.d = CAST(o_orderdate AS DATE) JOIN uk ON uk.d = us.d""")
def business_day(spark: SparkSession, d: str) -> DataFrame:
    days = cal.calendar_table(spark, 1994, 2003, (cal.US, cal.UK))
    o = table(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("d"))
    pick = lambda k, p: F.broadcast(days.where(F.col("calendar") == k).select("d", F.col("is_bd").alias(f"{p}_bd"), F.col("prev_bd").alias(f"{p}_prev"), F.col("bd_no").alias(f"{p}_no")))
    return o.join(pick(cal.US, "us"), "d").join(pick(cal.UK, "uk"), "d").select("o_orderkey", "us_bd", "us_prev", "uk_bd", "uk_prev", "us_no")


def _expiry_sql() -> str:
    bd = lambda c, ref, off: f"(SELECT x.d FROM {c} x WHERE x.is_bd AND x.bd_no = (SELECT y.bd_no FROM {c} y WHERE y.d = {ref}) + {off})"
    wd = lambda n, dow: f"CAST(m + ((({dow} - isodow(m)) % 7 + 7) % 7 + {7 * (n - 1)}) * INTERVAL 1 DAY AS DATE)"
    end = lambda x: f"CAST(date_trunc('month', {x}) + INTERVAL 1 MONTH - INTERVAL 1 DAY AS DATE)"
    minus = lambda x, n: f"CAST({x} - {n} * INTERVAL 1 DAY AS DATE)"
    d25 = "CAST(m - INTERVAL 1 MONTH + INTERVAL 24 DAY AS DATE)"
    on25 = f"(SELECT z.is_bd FROM us z WHERE z.d = {d25})"
    london = f"CASE WHEN m <= DATE '2016-02-01' THEN {bd('uk', minus('m', 16), 0)} WHEN month(m) = 2 THEN {bd('uk', end('m - INTERVAL 2 MONTH'), -1)} ELSE {bd('uk', end('m - INTERVAL 2 MONTH'), 0)} END"
    last = f"CASE WHEN month(m) = 11 THEN {minus(wd(4, 4), 7)} ELSE {minus(end('m'), '((isodow(' + end('m') + ') - 4 + 7) % 7)')} END"
    no = lambda x: f"(SELECT y.bd_no FROM us y WHERE y.d = {x})"
    steps = "".join(
        f" WHEN {no(minus('t0', 7 * j))} - {no(minus('t0', 7 * j + (7 if j == 0 else 2)))} = {5 if j == 0 else 2} THEN {minus('t0', 7 * j)}" for j in range(5)
    )
    rules = {
        "LAST_BUSINESS_DAY_CONTRACT_MONTH": bd("us", end("m"), 0),
        "THIRD_LAST_BUSINESS_DAY_CONTRACT_MONTH": bd("us", end("m"), -2),
        "SEVEN_BUSINESS_DAYS_PRIOR_LAST_BUS_DAY": bd("us", end("m"), -7),
        "TENTH_BUSINESS_DAY_CONTRACT_MONTH": bd("us", minus("m", 1), 10),
        "LAST_BUSINESS_DAY_PRIOR_MONTH": bd("us", minus("m", 1), 0),
        "THIRD_LAST_BUSINESS_DAY_PRIOR_MONTH": bd("us", minus("m", 1), -2),
        "THIRD_FRIDAY_CONTRACT_MONTH": bd("us", wd(3, 5), 0),
        "ONE_BUSINESS_DAY_PRIOR_THIRD_WEDNESDAY": bd("us", minus(wd(3, 3), 1), 0),
        "TWO_BUSINESS_DAYS_PRIOR_THIRD_WEDNESDAY": bd("us", minus(wd(3, 3), 1), -1),
        "THREE_BUSINESS_DAYS_BEFORE_25TH_PRIOR_MONTH": f"CASE WHEN {on25} THEN {bd('us', minus(d25, 1), -2)} ELSE {bd('us', minus(d25, 1), -3)} END",
        "FOUR_BUSINESS_DAYS_BEFORE_25TH_PRIOR_MONTH": f"CASE WHEN {on25} THEN {bd('us', minus(d25, 1), -3)} ELSE {bd('us', minus(d25, 1), -4)} END",
        "BUSINESS_DAY_PRIOR_15TH": bd("us", "CAST(m + INTERVAL 13 DAY AS DATE)", 0),
        "FEB_LONDON_SPECIAL_RULE": london,
        "LAST_THURSDAY_SPECIAL_RULE": f"CASE{steps} END",
        "THURSDAY_PRIOR_SECOND_FRIDAY_CON_MONTH": bd("us", minus(wd(2, 5), 1), 0),
        "FIRST_BUSINESS_DAY_AFTER_FIRST_FRIDAY": bd("us", wd(1, 5), 1),
    }
    parts = " UNION ALL ".join(f"SELECT code, '{k}' AS rule, CAST({v} AS DATE) AS expiry FROM months" for k, v in rules.items())
    return f"""WITH {_cal_sql('us', cal.US, 2013, 2021)}, {_cal_sql('uk', cal.UK, 2013, 2021)},
m0 AS (SELECT CAST(r AS DATE) AS m FROM range(DATE '2015-01-01', DATE '2020-01-01', INTERVAL 1 MONTH) AS t(r)),
months AS (SELECT m, substr('{cal.MONTH_LETTERS}', CAST(month(m) AS INT), 1) || substr(CAST(year(m) AS VARCHAR), 3, 2) AS code, {last} AS t0 FROM m0)
{parts}"""


@query(_expiry_sql())
def expiry_rules(spark: SparkSession, d: str) -> DataFrame:
    codes = [(f"{cal.MONTH_LETTERS[m]}{y}", r, "Energy") for y in range(15, 20) for m in range(12) for r in cal.RULES]
    contracts = spark.createDataFrame(codes, "code string, rule string, asset_class string")
    return cal.expirations(contracts, cal.calendar_table(spark, 2013, 2021)).select("code", "rule", "expiry")


_STATS = f"""WITH {DENSE30}, days AS (SELECT symbol, trade_date, coalesce(sum(volume) FILTER (k < 20), 0) AS b,
  coalesce(sum(volume) FILTER (k >= 20), 0) AS a, max(open) FILTER (k = 20) AS price FROM dense30 GROUP BY 1, 2),
stats AS (SELECT symbol, trade_date AS day, CAST(coalesce(lag(a) OVER (PARTITION BY symbol ORDER BY trade_date), 0) + b AS DOUBLE) AS liquidity, price FROM days)"""


@query(f"{_STATS} SELECT symbol, day, liquidity, price FROM stats")
def rollover_daily_stats(spark: SparkSession, d: str) -> DataFrame:
    s = futures.daily_stats(dense30(spark, d), "symbol", "trade_date", "k", 20)
    return s.withColumnRenamed("trade_date", "day")


_CONTRACTS = [("click", 0, "2024-01-08"), ("error", 1, "2024-01-14"), ("purchase", 2, None), ("signup", 3, "2024-01-26"), ("view", 4, None)]
_CONTRACTS_SQL = "contracts(symbol, idx, forced) AS (VALUES " + ", ".join(f"('{s}', {i}, {f'DATE {chr(39)}{f}{chr(39)}' if f else 'CAST(NULL AS DATE)'})" for s, i, f in _CONTRACTS) + ")"
_PATH = (
    _STATS.replace("WITH ", "WITH RECURSIVE ", 1)
    + f""", {_CONTRACTS_SQL}, st AS (SELECT idx, day, liquidity AS v, price AS p, forced FROM stats JOIN contracts USING (symbol)),
cal AS (SELECT day, row_number() OVER (ORDER BY day) AS pos, count(*) OVER () AS n FROM (SELECT DISTINCT day FROM st)),
walk AS (
  SELECT 0 AS pos, CAST(NULL AS DATE) AS day, (SELECT arg_min(idx, (-v, idx)) FROM st WHERE day = (SELECT min(day) FROM cal)) AS active, CAST(NULL AS DOUBLE) AS ratio
  UNION ALL
  SELECT c.pos, c.day, CASE WHEN g.go THEN w.active + 1 ELSE w.active END, CASE WHEN g.go AND g.p <> 0 THEN g.np / g.p END
  FROM walk w JOIN cal c ON c.pos = w.pos + 1,
  LATERAL (SELECT c.pos < c.n AND nx.v IS NOT NULL AND ((k.forced IS NOT NULL AND c.day >= k.forced) OR
      ((k.forced IS NULL OR datediff('day', c.day, k.forced) <= 4) AND coalesce(cu.v, 0) * 1.1 < nx.v)) AS go, cu.p AS p, nx.p AS np
    FROM (SELECT forced FROM contracts WHERE idx = w.active) k LEFT JOIN st cu ON cu.idx = w.active AND cu.day = c.day
    LEFT JOIN st nx ON nx.idx = w.active + 1 AND nx.day = c.day) g)"""
)


def _path(spark: SparkSession, d: str) -> DataFrame:
    rows = [("r", s, i, dt.date.fromisoformat(f) if f else None) for s, i, f in _CONTRACTS]
    contracts = spark.createDataFrame(rows, "root string, symbol string, idx int, forced date")
    stats = futures.daily_stats(dense30(spark, d), "symbol", "trade_date", "k", 20).withColumnRenamed("trade_date", "day")
    index = spark.createDataFrame([r[:3] for r in rows], "root string, symbol string, idx int")
    stats = stats.join(F.broadcast(index), "symbol")
    return futures.roll(stats.drop("symbol"), contracts.drop("symbol"), 1.1, 4)


@query(f"{_PATH} SELECT day, active, round(ratio, 6) AS ratio FROM walk WHERE pos > 0")
def rollover_path(spark: SparkSession, d: str) -> DataFrame:
    return _path(spark, d).select("day", "active", F.round("ratio", 6).alias("ratio"))


@query(f"""{_PATH}, p AS (SELECT *, lag(active) OVER (ORDER BY pos) AS before, coalesce(product(coalesce(ratio, 1.0)) OVER (ORDER BY pos DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1.0) AS multiplier FROM walk WHERE pos > 0)
SELECT day AS start_date, active, round(multiplier, 6) AS multiplier FROM p WHERE before IS NULL OR before <> active""")
def rollover_spec(spark: SparkSession, d: str) -> DataFrame:
    return futures.roll_spec(_path(spark, d)).select("start_date", "active", F.round("multiplier", 6).alias("multiplier"))


_SPEC = [("click", "2024-01-03", 1.5), ("error", "2024-01-10", 1.25), ("view", "2024-01-20", 1.0)]
_SPEC_SQL = "spec(symbol, start_date, multiplier) AS (VALUES " + ", ".join(f"('{s}', DATE '{x}', CAST({m} AS DOUBLE))" for s, x, m in _SPEC) + ")"


def _spec(spark: SparkSession) -> DataFrame:
    rows = [("r", s, dt.date.fromisoformat(x), m) for s, x, m in _SPEC]
    return spark.createDataFrame(rows, "root string, symbol string, start_date date, multiplier double")


@query(f"""WITH {DENSE30}, {_SPEC_SQL}, b AS (SELECT *, trade_date + k * INTERVAL 30 MINUTE AS at FROM dense30)
SELECT b.symbol, b.trade_date, b.k, coalesce(s.multiplier, 1.5) AS multiplier
FROM b ASOF LEFT JOIN (SELECT start_date + INTERVAL 600 MINUTE AS at, multiplier FROM spec) s ON b.at >= s.at""")
def multiplier_asof(spark: SparkSession, d: str) -> DataFrame:
    b = dense30(spark, d)
    spec = _spec(spark).select(F.explode(F.array(*[F.lit(s) for s in ("click", "error", "purchase", "signup", "view")])).alias("symbol"), "start_date", "multiplier")
    return futures.multiplier_asof(b, spec, ["symbol"], "trade_date", "k", 20).select("symbol", "trade_date", "k", "multiplier")


@query(f"""WITH {DENSE30}, {_SPEC_SQL}, seg AS (SELECT *, lead(start_date) OVER (ORDER BY start_date) AS until FROM spec)
SELECT b.symbol, b.trade_date, b.k, round(b.open * s.multiplier, 6) AS open, round(b.close * s.multiplier, 6) AS close, b.volume
FROM dense30 b JOIN seg s ON b.symbol = s.symbol AND (b.trade_date, b.k) >= (s.start_date, 20)
  AND (s.until IS NULL OR (b.trade_date, b.k) < (s.until, 20))""")
def backadjust(spark: SparkSession, d: str) -> DataFrame:
    b = dense30(spark, d).withColumn("root", F.lit("r"))
    x = futures.back_adjust(b, _spec(spark), "root", "symbol", "trade_date", "k", 20)
    return x.select("symbol", "trade_date", "k", F.round("open", 6).alias("open"), F.round("close", 6).alias("close"), "volume")


@query(f"""WITH {DENSE30}, r AS (SELECT symbol, trade_date, max(close) / min(close) AS x FROM dense30 WHERE close > 1 GROUP BY 1, 2)
SELECT symbol, trade_date, round(ln(product(x) OVER (PARTITION BY symbol ORDER BY trade_date DESC)), 6) AS factor FROM r""")
def reverse_cumprod(spark: SparkSession, d: str) -> DataFrame:
    r = dense30(spark, d).where("close > 1").groupBy("symbol", "trade_date").agg((F.max("close") / F.min("close")).alias("x"))
    return futures.reverse_product(r, ["symbol"], "trade_date", "x").select("symbol", "trade_date", F.round(F.ln("factor"), 6).alias("factor"))
