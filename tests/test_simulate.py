from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import policies, simulate
from tidemark.operators.policies import Bars


def make(open_, high=None, low=None, close=None, steps=None, multiplier=None, volume=None):
    n = len(open_)
    o = np.array(open_, float)
    return Bars.of(
        pd.DataFrame({
            "open": o, "high": o + 1 if high is None else high, "low": o - 1 if low is None else low, "close": o if close is None else close,
            "volume": np.ones(n, int) if volume is None else volume, "multiplier": np.ones(n) if multiplier is None else multiplier,
        }),
        steps or n,
    )


def test_multiplied_buy():
    b = make([100, 100.5, 101, 101.5], [101, 102, 102.5, 103], [99, 99.5, 100, 100.5], [100.5, 101, 101.5, 102], 2, [1, 1.5, 2, 2.5])
    got = simulate.advance(np.zeros(1), np.ones(1), np.full(1, np.nan), np.array([3]), b, simulate.Costs(commission=1, slippage=0.1, reference_price=100))
    assert got["execution"][0] == pytest.approx(101.75375) and got["cashflow"][0] == pytest.approx(-104.25375)


def test_step_expressions_equal_arrays(spark):
    rng = np.random.default_rng(3)
    n = 300
    o = 100 + rng.normal(size=n).cumsum()
    rows = pd.DataFrame({"i": range(n), "open": o, "high": o + rng.random(n), "low": o - rng.random(n), "close": o + rng.normal(size=n) / 3, "volume": rng.integers(0, 3, n), "p": rng.integers(-2, 3, n).astype(float), "a": rng.integers(-3, 4, n).astype(float), "stop": np.where(rng.random(n) < 0.3, np.nan, o + rng.normal(size=n))})
    costs = simulate.Costs(0.3, 0.5, 0.02, 0.2, 0.05, 90, 7)
    want = simulate.advance(rows.p.to_numpy(), rows.a.to_numpy(), rows.stop.to_numpy(), np.arange(n), Bars.of(rows, n), costs)
    d = spark.createDataFrame(rows).withColumn("stop", F.when(~F.isnan("stop"), F.col("stop")))
    d = d.withColumn("prev", F.expr("coalesce(lag(close) over (order by i), open)"))
    bar = {c: F.col(c) for c in ("open", "high", "low", "close", "prev")} | {"multiplier": F.lit(1.0), "valid": F.col("volume") != 0}
    got = d.select("i", *[c.alias(k) for k, c in simulate.step(F.col("p"), F.col("a"), F.col("stop"), bar, costs).items()]).orderBy("i").toPandas()
    for k, v in want.items():
        assert np.allclose(got[k], v), k


def test_no_quantity_costs_nothing(spark):
    c = simulate.Costs(commission=1, min_commission=5)
    assert spark.range(1).select(simulate.commission(F.lit(0.0), F.lit(10.0), c)).first()[0] == 0


def test_rollout_profit_and_end():
    b = make([10, 10, 11, 12], close=[10, 10.5, 11, 12])
    p = policies.TradingPolicy(policies.OpenOnce(1), policies.ArtrStop(50.0))
    got = simulate.run_episodes(np.array([0]), b, p, simulate.Costs()).iloc[0]
    assert got.profit == pytest.approx(2) and got.profit_percent == pytest.approx(0.2) and got.done_at == 3


def test_done_freezes():
    class Stop(policies.Policy):
        def __call__(self, state, bars):
            return state["at"] >= 2

    b = make([10, 10, 11, 12])
    got = simulate.run_episodes(np.array([0]), b, policies.TradingPolicy(policies.AlwaysOpen(1), policies.ArtrStop(50.0), done=Stop()), simulate.Costs()).iloc[0]
    assert got.done_at == 2 and got.steps == 2


def test_stop_fills_and_single_trade_is_done():
    b = make([100, 100, 100, 90, 80], [101, 101, 101, 91, 81], [99, 99, 99, 85, 79], [100, 100, 100, 86, 80])
    p = policies.TradingPolicy(policies.OpenOnce(1), policies.ArtrStop(2.0), policies.TrailingArtr(2.0), policies.SingleTrade())
    got = simulate.run_episodes(np.array([0]), b, p, simulate.Costs()).iloc[0]
    assert got.position == 0 and got.done_at == 3 and got.profit == pytest.approx(-10)  # the open is below the stop


def test_closed_form_equals_fold(spark):
    rng = np.random.default_rng(5)
    n = 60
    o = 100 + rng.normal(size=n).cumsum()
    rows = pd.DataFrame({"s": "x", "d": 0, "t": range(n), "open": o, "high": o + 0.6, "low": o - 0.6, "close": o + rng.normal(size=n) / 5, "volume": 1})
    b = Bars.of(rows, n)
    m = 1.5
    rows["stop"] = np.where(np.arange(n) == 0, b.open / (1 + m * b.artr), b.high / (1 + m * b.artr))
    x = simulate.first_hit(spark.createDataFrame(rows), ["s"], "d", "t", "stop").first()
    p = policies.TradingPolicy(policies.OpenOnce(1), policies.ArtrStop(m), policies.TrailingArtr(m), policies.SingleTrade())
    got = simulate.run_episodes(np.array([0]), b, p, simulate.Costs()).iloc[0]
    assert got.profit == pytest.approx((x["fill"] if x["fill"] is not None else x["last"]) - x["entry"])


def test_policies_check_their_terms():
    with pytest.raises(ValueError):
        policies.ScaledArtr((2, 4))
    with pytest.raises(ValueError):
        policies.ScaledArtr((1, 4, 6))
    with pytest.raises(ValueError):
        policies.PercentGain(anchor="nothing")
    with pytest.raises(ValueError):
        policies.PercentGain(skip_stage1=True, anchor="artificial_stage2")


@pytest.mark.parametrize("anchor", policies.ANCHORS)
def test_percent_gain_only_tightens(anchor):
    o = np.r_[np.linspace(100, 120, 40), np.linspace(120, 90, 40)]
    b = make(o, o + 0.5, o - 0.5)
    seen = []

    class Watch(policies.PercentGain):
        def __call__(self, state, bars, action, stop):
            out = super().__call__(state, bars, action, stop)
            seen.append(out[0] if state["position"][0] else np.nan)
            return out

    p = policies.TradingPolicy(policies.OpenOnce(1), policies.ArtrStop(3.0), Watch(3.0, anchor=anchor), policies.SingleTrade())
    got = simulate.run_episodes(np.array([0]), b, p, simulate.Costs()).iloc[0]
    stops = [x for x in seen if not np.isnan(x)]
    assert stops == sorted(stops) and got.profit > 5


def test_scaled_stages_promote():
    o = np.r_[np.linspace(100, 140, 96), np.linspace(140, 100, 48)]
    b = make(o, o + 0.3, o - 0.3, steps=48)
    stage = []

    class Watch(policies.ScaledArtr):
        def __call__(self, state, bars, action, stop):
            out = super().__call__(state, bars, action, stop)
            stage.append(int(state["stage"][0]))
            return out

    p = policies.TradingPolicy(policies.OpenOnce(1), policies.ArtrStop(2.0), Watch((1, 4, 8), 2.0), policies.SingleTrade())
    got = simulate.run_episodes(np.array([3]), b, p, simulate.Costs()).iloc[0]
    assert max(stage) == 2 and got.profit > 10


def test_completed_bars():
    b = make(np.arange(12.0) + 10, steps=6)
    assert list(b.completed(np.arange(12), 2)) == [-1, 0, 0, 1, 1, 2, 2, 3, 3, 4, 4, 5]
