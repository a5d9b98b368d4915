"""Trading one market over bars: position algebra, execution, commission, stops, rollouts.

The rules of one step are written once, over few operations that columns and arrays both have: as
DataFrame expressions they price given positions bar by bar inside codegen; as numpy they advance all
episodes of a task together, since a rollout is a recursion over bars. Episodes are independent: an
instrument's are dealt over tasks, each of which gets its bars.

What the steps do where the bars leave a choice: an invalid bar ignores action and stop; a stop above
the open of a long fills at the open; no quantity costs no commission; a policy sees bar t and is
executed on bar t + 1; the first bar that is done is the one before the step.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .policies import Bars, TradingPolicy


@dataclass(frozen=True)
class Costs:
    commission: float = 0.0
    min_commission: float = 0.0
    max_commission_pct: float = 0.0
    slippage: float = 0.0
    min_slippage: float = 0.0
    reference_price: float = 1.0
    contract_multiplier: float = 1.0


# ---------------------------------------------------------------- one bar, over columns or arrays


class _Columns:
    """What a step needs, as DataFrame expressions; a missing stop is null, which extremes skip."""

    sign, size, most, least = staticmethod(F.signum), staticmethod(F.abs), staticmethod(F.greatest), staticmethod(F.least)
    value = staticmethod(F.lit)
    pick = staticmethod(lambda test, yes, no: F.when(test, yes).otherwise(no))
    sure = staticmethod(lambda test: F.coalesce(test, F.lit(False)))
    missing = None


class _Arrays:
    """The same with numpy; a missing stop is NaN."""

    sign, size, most, least, pick = np.sign, np.abs, np.fmax, np.fmin, np.where
    value = sure = staticmethod(lambda x: x)
    missing = np.nan


def _positions(x, p, a) -> dict:
    """What stays of a position is what old and new have in common; the rest of the old one is closed, the
    rest of the new one opened."""
    new = p + a
    kept = x.pick(x.sign(p) == x.sign(new), x.sign(p) * x.least(x.size(p), x.size(new)), x.value(0.0))
    return {"new": new, "closed": p - kept, "opened": new - kept, "kept": kept}


def _fee(x, quantity, price, costs: Costs):
    fee = x.most(quantity * costs.commission, x.value(costs.min_commission))
    if costs.max_commission_pct > 0:
        fee = x.least(fee, price * quantity * costs.max_commission_pct)
    return x.pick(quantity == 0, x.value(0.0), fee)


def _step(x, position, action, stop, bar: dict, costs: Costs) -> dict:
    a, s = x.pick(bar["valid"], action, x.value(0.0)), x.pick(bar["valid"], stop, x.value(x.missing))
    q = _positions(x, position, a)
    slide = x.most(bar["open"] * costs.slippage / costs.reference_price, x.value(costs.min_slippage)) * bar["multiplier"]
    price = bar["open"] + slide * x.sign(a)
    fee = _fee(x, x.size(a), price, costs) * bar["multiplier"]
    side = x.sign(q["new"])
    hit = x.sure(((side > 0) & (s > bar["low"])) | ((side < 0) & (bar["high"] > s)))
    stopped = x.pick(hit, q["new"], x.value(0.0))
    fill = x.pick(side >= 0, x.least(s, bar["open"]), x.most(s, bar["open"])) - slide * x.sign(stopped)
    stop_fee = x.pick(hit, _fee(x, x.size(stopped), fill, costs) * bar["multiplier"], x.value(0.0))
    last = x.pick(hit, fill, bar["close"])
    gain = (price - bar["prev"]) * q["closed"] + (last - price) * q["opened"] + (last - bar["prev"]) * q["kept"]
    cash = price * (q["closed"] - q["opened"]) + x.pick(hit, fill * stopped, x.value(0.0))
    return {
        "position": q["new"] - stopped, "execution": price,
        "profit": gain * costs.contract_multiplier - fee - stop_fee, "cashflow": cash * costs.contract_multiplier - fee - stop_fee,
    }


def positions(position: Column, action: Column) -> dict[str, Column]:
    """``new, closed, opened, kept`` of taking ``action`` in ``position``."""
    return _positions(_Columns, position, action)


def commission(quantity: Column, price: Column, costs: Costs) -> Column:
    """Per contract, at least the minimum, at most the cap; none without quantity."""
    return _fee(_Columns, quantity, price, costs)


def step(position: Column, action: Column, stop: Column, bar: dict[str, Column], costs: Costs) -> dict[str, Column]:
    """One bar: ``bar`` has open, high, low, close, prev (close before), multiplier, valid."""
    return _step(_Columns, position.cast("double"), action.cast("double"), stop.cast("double"), bar, costs)


def advance(position: np.ndarray, action: np.ndarray, stop: np.ndarray, at: np.ndarray, bars: Bars, c: Costs) -> dict[str, np.ndarray]:
    """:func:`step` for many episodes at flat bar numbers ``at``; a missing stop is NaN."""
    bar = {k: getattr(bars, k)[at] for k in ("open", "high", "low", "close", "multiplier", "valid")}
    bar["prev"] = np.where(at > 0, bars.close[np.maximum(at - 1, 0)], bar["open"])
    with np.errstate(invalid="ignore"):
        return _step(_Arrays, position, action, stop, bar, c)


def first_hit(bars: DataFrame, keys: list[str], day: str, order: str, stop: str, side: int = 1) -> DataFrame:
    """The trailing stop in closed form: ``stop`` decided on a bar acts on the next; the running
    best stop from the first bar on is hit on the first later bar whose low (high) passes it.

    One row a group: entry, exit (null if never hit), where, and the fill before slippage.
    """
    by = W.partitionBy(*keys, day).orderBy(order)
    best = F.max if side > 0 else F.min
    level = best(stop).over(by.rowsBetween(W.unboundedPreceding, -1))
    hit = (F.col("_s") > F.col("low")) if side > 0 else (F.col("_s") < F.col("high"))
    fill = F.least("_s", "open") if side > 0 else F.greatest("_s", "open")
    marked = bars.withColumn("_s", level).withColumn("_hit", F.coalesce(hit, F.lit(False))).withColumn("_fill", fill)
    entry = F.min_by("open", F.when(F.col("_n") == 2, F.lit(0)).otherwise(F.lit(1)))
    marked = marked.withColumn("_n", F.row_number().over(by))
    return marked.groupBy(*keys, day).agg(
        entry.alias("entry"),
        F.min(F.when(F.col("_hit") & (F.col("_n") > 1), F.col(order))).alias("exit_at"),
        F.min_by(F.when(F.col("_hit") & (F.col("_n") > 1), F.col("_fill")), F.when(F.col("_hit") & (F.col("_n") > 1), F.col(order))).alias("fill"),
        F.max_by("close", order).alias("last"),
    )


# ---------------------------------------------------------------- episodes, all of a task at once


def run_episodes(start: np.ndarray, bars: Bars, policy: TradingPolicy, costs: Costs, max_steps: int | None = None) -> pd.DataFrame:
    """All episodes from flat bar numbers ``start`` until done, the last bar or ``max_steps``."""
    n = len(start)
    state = {
        "at": start.astype(np.int64), "position": np.zeros(n), "entry_price": np.full(n, np.nan), "entry_position": np.zeros(n),
        "done": np.zeros(n, bool), "had": np.zeros(n, bool), "stop": np.full(n, np.nan), "steps": np.zeros(n, np.int64),
        "profit": np.zeros(n), "profit_percent": np.zeros(n), "done_at": np.full(n, -1, np.int64), "entry_at": np.full(n, -1, np.int64),
    }
    state |= policy.start(n)
    for _ in range(max_steps if max_steps is not None else len(bars.open)):
        if state["done"].all():
            break
        action, stop, done = policy(state, bars)
        newly = done & ~state["done"]
        state["done_at"] = np.where(newly & (state["done_at"] < 0), state["at"], state["done_at"])
        state["done"] = state["done"] | done
        live = ~state["done"]
        nxt = np.minimum(state["at"] + 1, len(bars.open) - 1)
        got = advance(state["position"], np.where(live, action, 0.0), stop, nxt, bars, costs)
        a, p = np.where(bars.valid[nxt], action, 0.0), state["position"]
        entering = live & (p == 0) & (a != 0)
        adding = live & (p != 0) & (np.sign(a) == np.sign(p)) & (a != 0)
        with np.errstate(invalid="ignore", divide="ignore"):
            mixed = (state["entry_price"] * np.abs(p) + got["execution"] * np.abs(a)) / (np.abs(p) + np.abs(a))
        entry = np.where(entering, got["execution"], np.where(adding, mixed, state["entry_price"]))
        held = np.where(entering | adding, p + a, state["entry_position"])
        cost = np.nan_to_num(np.abs(entry * held)) * costs.contract_multiplier
        state["entry_at"] = np.where(entering, nxt, state["entry_at"])
        flat = got["position"] == 0
        state["profit"] = state["profit"] + np.where(live, got["profit"], 0.0)
        percent = np.divide(got["profit"], cost, out=np.zeros(n), where=cost > 0)
        state["profit_percent"] = state["profit_percent"] + np.where(live, percent, 0.0)
        state["had"] = state["had"] | (live & (a != 0))
        state["position"] = np.where(live, got["position"], p)
        state["entry_price"] = np.where(live & flat, np.nan, np.where(live, entry, state["entry_price"]))
        state["entry_position"] = np.where(live & flat, 0.0, np.where(live, held, state["entry_position"]))
        state["stop"] = np.where(live, np.where(flat, np.nan, stop), state["stop"])
        state["steps"] = state["steps"] + live
        state["at"] = np.where(live, nxt, state["at"])
    return pd.DataFrame({k: state[k] for k in ("profit", "profit_percent", "steps", "done_at", "position")})


def rollout(
    episodes: DataFrame, bars: DataFrame, policy: TradingPolicy, costs: Costs, keys: list[str], max_steps: int | None = None, each: int = 100_000
) -> DataFrame:
    """``(*keys, episode, profit, profit_percent, steps, done_date, done_time)``. ``keys`` name an instrument;
    ``episodes(*keys, episode, date_idx, time_idx)``; ``bars`` are dense bars with ``date_idx, time_idx``.

    A task takes one instrument's bars (a 15-year minute series is 60 MB) and at most about ``each`` of its
    episodes: those of an instrument are dealt into parts, to each of which its bars go.
    """
    steps = int(bars.agg(F.max("time_idx")).first()[0] or 0) + 1
    parts = episodes.groupBy(*keys).agg(F.ceil(F.count("*") / each).cast("int").alias("_parts"))
    same = [F.col(f"_k{i}").eqNullSafe(F.col(k)) for i, k in enumerate(keys)]
    parts = parts.toDF(*[f"_k{i}" for i in range(len(keys))], "_parts")
    drop = [f"_k{i}" for i in range(len(keys))]
    dealt = episodes.join(parts, same).withColumn("_part", F.pmod(F.xxhash64("episode"), F.col("_parts"))).drop(*drop, "_parts")
    sent = bars.join(parts, same).withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts").cast("long") - 1))).drop(*drop, "_parts")
    # both may come from one table: columns of their own
    sent = sent.select(*[F.col(c).alias(c) for c in sent.columns])

    def run(key, rows: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values(["date_idx", "time_idx"], kind="stable")
        start = (rows["date_idx"] * steps + rows["time_idx"]).to_numpy()
        out = run_episodes(start, Bars.of(own, steps), policy, costs, max_steps)
        done = out["done_at"].to_numpy()
        return pd.DataFrame({k: rows[k].to_numpy() for k in keys} | {
            "episode": rows["episode"].to_numpy(), "profit": out["profit"], "profit_percent": out["profit_percent"], "steps": out["steps"],
            "done_date": pd.Series(np.where(done < 0, None, done // steps), dtype="Int64"), "done_time": pd.Series(np.where(done < 0, None, done % steps), dtype="Int64"),
        })

    fields = ", ".join(f"`{k}` {episodes.schema[k].dataType.simpleString()}" for k in keys)
    made = f"{fields}, episode long, profit double, profit_percent double, steps long, done_date long, done_time long"
    return dealt.groupBy(*keys, "_part").cogroup(sent.groupBy(*keys, "_part")).applyInPandas(run, made)


def best_episode(found: DataFrame, by: str = "profit_percent") -> DataFrame:
    """The row of the best episode of a rollout; ties go to the smaller episode."""
    return found.orderBy(F.desc_nulls_last(by), "episode").limit(1)
