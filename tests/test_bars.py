from __future__ import annotations

import datetime as dt

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark.operators import bars, futures, indicators
from tidemark.plans import market
from tidemark.streaming import ticks


def near(a, b):
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert (x is None) == (y is None)
        assert x is None or x == pytest.approx(y, rel=1e-4)


@pytest.fixture
def vector(spark):
    return spark.createDataFrame([("s", i, float(i)) for i in range(1, 6)], "s string, i int, x double")


def test_sma(vector):
    near([r.sma for r in indicators.sma(vector, ["s"], "i", "x", 3).orderBy("i").collect()], [1, 1.5, 2, 3, 4])


def test_ema(vector):
    near([r.ema for r in indicators.ema(vector, ["s"], ["i"], "x", 0.5).orderBy("i").collect()], [1, 1.5, 2.25, 3.125, 4.0625])


def test_masked_round_trip(vector):
    v = vector.withColumn("valid", F.col("i") % 2 == 1)
    packed = indicators.compress(v, ["s"], "i", "valid")
    assert [(r.i, r.slot) for r in packed.orderBy("i").collect()] == [(1, 0), (3, 1), (5, 2)]
    back = indicators.masked(v, ["s", "i"], "valid", lambda x: x.withColumn("y", F.col("x")), ["y"])
    near([r.y for r in back.orderBy("i").collect()], [1, None, 3, None, 5])


def test_masked_sma(vector):
    v = vector.withColumn("valid", F.col("i") % 2 == 1)
    m = indicators.masked(v, ["s", "i"], "valid", lambda x: indicators.sma(x, ["s"], "i", "x", 2), ["sma"])
    near([r.sma for r in m.orderBy("i").collect()], [1, None, 2, None, 4])


def test_ffill(spark):
    d = spark.createDataFrame([("s", 1, None), ("s", 2, 2.0), ("s", 3, None), ("s", 4, 4.0), ("s", 5, None)], "s string, i int, x double")
    near([r.filled for r in indicators.ffill(d, ["s"], "i", "x", "x is not null").orderBy("i").collect()], [None, 2, 2, 4, 4])


@pytest.fixture
def days(spark):
    one = [(10, 12, 8, 10), (11, 13, 9, 12), (12, 14, 10, 13)]
    rows = [("s", d, t, *map(float, b)) for d in range(2) for t, b in enumerate(one)]
    return spark.createDataFrame(rows, "s string, d int, t int, open double, high double, low double, close double")


def test_rtr_restarts_each_day(days):
    r = indicators.rtr(days, ["s"], "d", "t").orderBy("d", "t").collect()
    near([x.rtr for x in r], [0.5, 13 / 9 - 1, 0.4] * 2)


@pytest.fixture
def zeros(spark):
    rows = [("s", 0, 0, 2.0, 0.0, 1.0, True), ("s", 0, 1, 3.0, 1.0, 2.0, True), ("s", 0, 2, 0.0, 0.0, 0.0, False), ("s", 1, 0, 0.0, 0.0, 0.0, True), ("s", 1, 1, 3.0, 2.0, 2.0, True)]
    return spark.createDataFrame(rows, "s string, d int, t int, high double, low double, close double, valid boolean")


def test_rtr_of_a_low_of_zero(zeros):
    r = indicators.rtr(zeros, ["s"], "d", "t").orderBy("d", "t").collect()
    assert [str(x.rtr) for x in r] == ["inf", "2.0", "inf", "nan", "inf"]


def test_masked_rtr_of_a_low_of_zero(zeros):
    m = indicators.masked(zeros, ["s", "d", "t"], "valid", lambda x: indicators.rtr(x, ["s"], "d", "t"), ["rtr"])
    assert [str(x.rtr) for x in m.orderBy("d", "t").collect()] == ["inf", "2.0", "None", "nan", "inf"]


def test_artr_stays_infinite_over_days(zeros):
    r = indicators.artr(zeros, ["s"], "d", "t", 0.5, True).orderBy("d", "t").collect()
    assert [str(x.artr) for x in r] == ["inf", "inf", "inf", "nan", "nan"]


def test_ema_keeps_null_and_nan_apart(spark):
    d = spark.createDataFrame([("a", 0, 1.0), ("a", 1, None), ("a", 2, 3.0), ("b", 0, float("nan")), ("b", 1, 2.0)], "s string, i int, x double")
    assert [str(r.ema) for r in indicators.ema(d, ["s"], ["i"], "x", 0.5).orderBy("s", "i").collect()] == ["1.0", "None", "None", "nan", "nan"]


def test_masked_artr_stays_infinite(zeros):
    over = lambda x: indicators.artr(x, ["s"], "d", "t", 0.5, True)
    m = indicators.masked(zeros.where("t < 2 or not valid"), ["s", "d", "t"], "valid", over, ["artr"])
    assert [str(x.artr) for x in m.where("d = 0").orderBy("t").collect()] == ["inf", "inf", "None"]


def test_artr_within_days_forgets_at_the_next(zeros):
    r = indicators.artr(zeros.where("d = 0 or t = 1"), ["s"], "d", "t", 0.5, False).orderBy("d", "t").collect()
    assert [str(x.artr) for x in r] == ["inf", "inf", "inf", "0.5"]


def test_rounds_as_the_twins_do(spark):
    x = [262.3133405, -262.3133405, 34.0421875 - 1, float("inf"), 1e305]
    want = duckdb.sql(f"select {', '.join(f'round({v!r}::double, 6)' for v in x[:3])}").fetchall()[0]
    got = market.rounded(spark.createDataFrame([(v,) for v in x], "x double"), "x").collect()
    assert [r.x for r in got] == [*want, *x[3:]]


@pytest.mark.parametrize("across", [False, True])
def test_artr(days, across):
    r = [x.artr for x in indicators.artr(days, ["s"], "d", "t", 0.5, across).orderBy("d", "t").collect()]
    y, want = None, []
    for i, x in enumerate([0.5, 13 / 9 - 1, 0.4] * 2):
        y = x if y is None or (i == 3 and not across) else 0.5 * y + 0.5 * x
        want.append(y)
    near(r, want)


@pytest.mark.parametrize(("n", "last"), [(4, None), (5, [4, 4.5, 3.5, 5, 5])])
def test_resample(spark, n, last):
    rows = [("s", 0, i, i + 0.0, i + 0.5, i - 0.5, i + 1.0, i + 1) for i in range(n)]
    d = spark.createDataFrame(rows, "s string, day int, t int, open double, high double, low double, close double, volume int")
    got = bars.resample(d, ["s", "day"], "t", 2).orderBy("k").collect()
    values = [[r.open, r.high, r.low, r.close, r.volume] for r in got]
    assert values[:2] == [[0, 1.5, -0.5, 2, 3], [2, 3.5, 1.5, 4, 7]]
    assert last is None or values[2] == last


def test_vwap_falls_back_to_close_and_rounds_half_even(spark):
    t = spark.createDataFrame([("a", 1, 2.0, 0), ("a", 2, 2.5, 0), ("b", 1, 0.5, 1), ("b", 2, 2.5, 1), ("b", 3, 4.5, 1)], "g string, seq int, price double, size int")
    got = {r.g: r for r in bars.bars_from_ticks(t, ["g"], decimals=0).collect()}
    assert got["a"].vwap == 2.0 and got["a"].close == 2.5 and got["b"].vwap == 2.0


def test_densify_keeps_rows_off_the_grid(spark):
    d = spark.createDataFrame([("s", 0, None, 11.0, 9.0, None, None), ("s", 60, 5.0, 6.0, 4.0, 5.5, 3), ("s", 61, 7.0, 7.0, 7.0, 7.0, 1)], "s string, offset_s int, open double, high double, low double, close double, volume int")
    got = bars.densify(d, ["s"], 120, 60).orderBy("offset_s").collect()
    assert [r.offset_s for r in got] == [0, 60, 61, 120]
    assert [(r.open, r.high, r.low, r.close, r.volume) for r in got] == [(11, 11, 9, 5, 0), (5, 6, 4, 5.5, 3), (7, 7, 7, 7, 1), (7, 7, 7, 7, 0)]


def test_process_keeps_complete_days(spark):
    base = dt.datetime(2020, 1, 1, 18)
    rows = [("s", base + dt.timedelta(minutes=30 * i), 1.0, 1.0, 1.0, 1.0, 1) for i in (0, 2)]
    rows += [("s", dt.datetime(2020, 1, 5, 19), 1.0, 1.0, 1.0, 1.0, 1)]
    d = spark.createDataFrame(rows, "s string, ts timestamp_ntz, open double, high double, low double, close double, volume int")
    got = bars.process(d, ["s"], -21600, 3600, 1800, {"weekdays": range(5)}).orderBy("offset_s").collect()
    assert [(r.offset_s, r.ord_date, r.time_seconds, r.ord_trade_date, r.volume) for r in got[::2]][:1] == [(0, 737425, 64800, 737426, 1)]
    assert len(got) == 6


def test_final_columns_of_ordinals(spark):
    d = spark.createDataFrame([(dt.date(2020, 1, 1), 0), (dt.date(2020, 1, 1), 25000)], "trade_date date, offset_s int")
    got = bars.final_columns(d, -21600).orderBy("offset_s").collect()
    assert [(r.ord_trade_date, r.ord_date, r.time_seconds) for r in got] == [(737425, 737424, 64800), (737425, 737425, 3400)]


def test_decimals_and_short_numbers(spark):
    d = spark.createDataFrame([("1.50", 1.5), ("2", 2.0), (" 3.125 ", None)], "s string, x double")
    got = d.select(bars.decimals(F.col("s")).alias("n"), bars.short_number(F.col("x"), 3).alias("t")).collect()
    assert [(r.n, r.t) for r in got] == [(2, "1.5"), (0, "2"), (3, "")]


def test_rollover(spark):
    d = [dt.date(2020, 1, 1 + i) for i in range(4)]
    stats = [("r", 0, x, float(v), 10.0) for x, v in zip(d, (100, 80, 60, 40))] + [("r", 1, x, float(v), 10.0) for x, v in zip(d, (10, 90, 100, 110))]
    stats = spark.createDataFrame(stats, "root string, idx int, day date, liquidity double, price double")
    terms = spark.createDataFrame([("r", 0, d[0] + dt.timedelta(4)), ("r", 1, d[0] + dt.timedelta(35))], "root string, idx int, forced date")
    path = futures.roll(stats, terms, 1.0, 15).orderBy("day").collect()
    assert [r.active for r in path] == [0, 1, 1, 1]
    assert [r.ratio for r in path] == [None, 1.0, None, None]


def test_multiplier_asof(spark):
    b = spark.createDataFrame([("s", dt.date(2020, 1, x), o) for x in (1, 2) for o in (0, 60, 120)], "s string, d date, o int")
    spec = spark.createDataFrame([("s", dt.date(2020, 1, 1), 1.0), ("s", dt.date(2020, 1, 2), 2.0)], "s string, start_date date, multiplier double")
    got = futures.multiplier_asof(b, spec, ["s"], "d", "o", 60).orderBy("d", "o").collect()
    assert [r.multiplier for r in got] == [1, 1, 1, 1, 2, 2]
    one = futures.multiplier_asof(b, spark.createDataFrame([("s", dt.date(2021, 1, 1), 2.5)], "s string, start_date date, multiplier double"), ["s"], "d", "o", 60)
    assert {r.multiplier for r in one.collect()} == {2.5}


def test_stream_matches_batch(spark, sf, tmp_path):
    from tidemark.plans.views import ticks as read

    t = read(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
    t.coalesce(1).write.parquet(f"{tmp_path}/in")
    s = spark.readStream.schema(t.schema).parquet(f"{tmp_path}/in")
    q = ticks.stream_bars(s, ["symbol"], 1).writeStream.format("memory").queryName("bars").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    late = spark.table("bars").count()
    want = bars.bars_from_ticks(t.withColumn("start", F.date_trunc("second", "ts")), ["symbol", "start"])
    # what is newest stays open
    assert late <= want.count() and spark.table("bars").join(want, ["symbol", "start", "open", "high", "low", "close", "volume"]).count() == late
