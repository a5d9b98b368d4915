"""Trading policies: who opens, where the stop goes, how it is maintained, when an episode is done.

A policy works on all episodes of a task at once, as numpy arrays. Write your own by subclassing
:class:`Policy`: ``start(n)`` gives its own state, ``__call__`` one decision.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd

ANCHORS = ("entry", "initial_stop", "artificial", "last_stage1_stop", "artificial_stage2")


@dataclass
class Bars:
    """Dense bars of one instrument as arrays, with the average relative true range."""

    open: np.ndarray
    high: np.ndarray
    low: np.ndarray
    close: np.ndarray
    valid: np.ndarray
    multiplier: np.ndarray
    steps: int
    artr: np.ndarray = field(default=None)

    @classmethod
    def of(cls, rows: pd.DataFrame, steps: int, alpha: float = 1 / 14) -> "Bars":
        get = lambda c: rows[c].to_numpy(float)
        m = get("multiplier") if "multiplier" in rows else np.ones(len(rows))
        out = cls(get("open"), get("high"), get("low"), get("close"), rows["volume"].to_numpy() != 0, m, steps)
        out.artr = out.average_range(alpha)
        return out

    def average_range(self, alpha: float) -> np.ndarray:
        """Over valid bars, across days; the range itself restarts each day."""
        day = np.arange(len(self.open)) // self.steps
        at = np.flatnonzero(self.valid)
        out = np.full(len(self.open), np.nan)
        if not len(at):
            return out
        prev = np.r_[np.nan, self.close[at][:-1]]
        prev[np.r_[True, day[at][1:] != day[at][:-1]]] = np.nan
        high, low = np.fmax(self.high[at], prev), np.fmin(self.low[at], prev)
        ranges = np.divide(high, low, out=np.full(len(at), np.nan), where=low != 0) - 1
        out[at] = pd.Series(ranges).ewm(alpha=alpha, adjust=False).mean().to_numpy()
        return out

    def coarser(self, ratio: int) -> "Bars":
        """``ratio`` bars of a day as one."""
        n = len(self.open) // self.steps
        coarse = -(-self.steps // ratio)
        pad = lambda x, fill: np.concatenate([x.reshape(n, self.steps), np.full((n, coarse * ratio - self.steps), fill)], axis=1).reshape(n * coarse, ratio)
        out = Bars(
            pad(self.open, np.nan)[:, 0], np.nanmax(pad(self.high, np.nan), axis=1), np.nanmin(pad(self.low, np.nan), axis=1),
            np.array([r[~np.isnan(r)][-1] for r in pad(self.close, np.nan)]), pad(self.valid.astype(float), 0).any(axis=1), pad(self.multiplier, np.nan)[:, 0], coarse,
        )
        out.artr = out.average_range(1 / 14)
        return out

    def completed(self, at: np.ndarray, ratio: int) -> np.ndarray:
        """The last completed coarse bar seen from each fine bar, -1 in front of the first."""
        coarse = -(-self.steps // ratio)
        nxt = at + 1
        return nxt // self.steps * coarse + nxt % self.steps // ratio - 1


class Policy:
    """One decision of many episodes. Subclasses use and may write their own keys of ``state``."""

    def start(self, n: int) -> dict[str, np.ndarray]:
        return {}


@dataclass
class AlwaysOpen(Policy):
    direction: int = 1

    def __call__(self, state, bars):
        return np.where((state["position"] == 0) & ~state["done"], float(self.direction), 0.0)


@dataclass
class OpenOnce(Policy):
    direction: int = 1

    def __call__(self, state, bars):
        return np.where((state["position"] == 0) & ~state["had"] & ~state["done"], float(self.direction), 0.0)


def artr_stop(bars: Bars, at: np.ndarray, position: np.ndarray, action: np.ndarray, prev: np.ndarray, multiple: float, flat: np.ndarray | None = None) -> np.ndarray:
    """The ratchet: reference / (1 + multiple * ARTR) for a long, times it for a short, never looser
    than before; as before where there is no direction or no range."""
    side = np.sign(position + action)
    if flat is None:
        flat = position == 0
    ref = np.where(flat, bars.open[at], np.where(side > 0, bars.high[at], bars.low[at]))
    k = 1 + multiple * bars.artr[at]
    level = np.where(side > 0, ref / k, ref * k)
    moved = np.where(side > 0, np.fmax(prev, level), np.fmin(prev, level))
    return np.where((side == 0) | np.isnan(level), prev, moved)


@dataclass
class ArtrStop(Policy):
    """The ARTR stop while opening; the initial stop of a position."""

    multiple: float = 3.0

    def __call__(self, state, bars, action):
        opening = (state["position"] == 0) & (action != 0)
        fresh = artr_stop(bars, state["at"], state["position"], action, np.full(len(action), np.nan), self.multiple)
        return np.where(opening, fresh, state["stop"])


@dataclass
class KeepStop(Policy):
    def __call__(self, state, bars, action, stop):
        return stop


@dataclass
class TrailingArtr(Policy):
    multiple: float = 3.0

    def __call__(self, state, bars, action, stop):
        return artr_stop(bars, state["at"], state["position"], action, stop, self.multiple)


@dataclass
class ScaledArtr(Policy):
    """Stages of coarser bars: from stage 0 to 1 past breakeven (or after time alone), then on to the
    next ratio whenever its stop improves enough and a later coarse bar than the entry's completed."""

    ratios: tuple[int, ...] = (1, 4)
    multiple: float = 3.0
    wait_for_breakeven: bool = True
    minimum_improvement: float = 0.0

    def __post_init__(self):
        if not self.ratios or self.ratios[0] != 1:
            raise ValueError("the first stage must be the base interval")
        if any(b % a for a, b in zip(self.ratios, self.ratios[1:])):
            raise ValueError("each stage must divide the next")

    def start(self, n):
        return {"stage": np.zeros(n, np.int64), "base": np.full(n, np.nan)}

    def __call__(self, state, bars, action, stop):
        if not hasattr(self, "_levels") or self._of is not bars:
            self._levels, self._of = [bars, *[bars.coarser(r) for r in self.ratios[1:]]], bars
        at, p = state["at"], state["position"]
        opening = (p == 0) & (action != 0)
        state["stage"] = np.where(opening, 0, state["stage"])
        base = np.where(opening, np.nan, state["base"])
        state["base"] = np.where(np.isnan(base), state["entry_price"] if self.wait_for_breakeven else stop, base)
        side = np.sign(p + action)
        for s, ratio in enumerate(self.ratios):
            here = (state["stage"] == s) & (p != 0)
            coarse = bars.completed(at, ratio) if s else at
            ok = here & (coarse >= 0)
            level = artr_stop(self._levels[s], np.maximum(coarse, 0), p, action, stop, self.multiple, flat=np.zeros(len(p), bool))
            last = s + 1 == len(self.ratios)
            later = np.zeros(len(p), bool) if last else bars.completed(at, self.ratios[s + 1]) > bars.completed(state["entry_at"], self.ratios[s + 1])
            better = side * (level - stop)
            if s == 0 and self.wait_for_breakeven:
                go = ok & later & (side * (level - state["entry_price"]) > 0)
                stop = np.where(go, level, stop)
            elif s == 0:
                go = ok & later
            else:
                need = self.minimum_improvement * np.abs(state["base"] - stop)
                improves = ok & (better > np.nan_to_num(need))
                stop = np.where(improves & (later | last), level, stop)
                go = improves & later
            state["stage"] = np.where(go & (not last), s + 1, state["stage"])
        return stop


@dataclass
class PercentGain(Policy):
    """Stage 1 trails by ARTR until its stop passes the entry; stage 2 keeps a share of the gain from
    an anchor."""

    multiple: float = 3.0
    trailing: bool = True
    skip_stage1: bool = False
    keep: float = 0.5
    anchor: str = "entry"

    def __post_init__(self):
        if self.anchor not in ANCHORS:
            raise ValueError(f"anchor must be one of {ANCHORS}")
        if not 0 <= self.keep < 1:
            raise ValueError("keep must be in [0, 1)")
        if self.skip_stage1 and self.anchor in ("last_stage1_stop", "artificial_stage2"):
            raise ValueError("this anchor needs stage 1")

    def start(self, n):
        return {"gain_stage": np.full(n, 2 if self.skip_stage1 else 1), "anchor": np.full(n, np.nan)}

    def __call__(self, state, bars, action, stop):
        at, p = state["at"], state["position"]
        opening = (p == 0) & (action != 0)
        state["gain_stage"] = np.where(opening, 2 if self.skip_stage1 else 1, state["gain_stage"])
        state["anchor"] = np.where(opening, np.nan, state["anchor"])
        held, side = p != 0, np.sign(p)
        ref = np.where(side > 0, bars.high[at], bars.low[at])
        made = (stop - self.keep * ref) / (1 - self.keep)
        first = {"entry": state["entry_price"], "initial_stop": stop, "artificial": made}.get(self.anchor)
        if first is not None:
            state["anchor"] = np.where(held & np.isnan(state["anchor"]), first, state["anchor"])
        one = held & (state["gain_stage"] == 1)
        level = artr_stop(bars, at, p, action, stop, self.multiple)
        passed = one & (side * (level - state["entry_price"]) > 0)
        if self.trailing:
            stop = np.where(one, level, stop)
        if self.anchor == "last_stage1_stop":
            state["anchor"] = np.where(passed, stop, state["anchor"])
        elif self.anchor == "artificial_stage2":
            state["anchor"] = np.where(passed, (stop - self.keep * ref) / (1 - self.keep), state["anchor"])
        two = held & (state["gain_stage"] == 2)
        share = state["anchor"] + self.keep * (ref - state["anchor"])
        kept = np.where(side > 0, np.fmax(stop, share), np.fmin(stop, share))
        state["gain_stage"] = np.where(passed, 2, state["gain_stage"])
        return np.where(two, kept, stop)


@dataclass
class NeverDone(Policy):
    def __call__(self, state, bars):
        return state["done"].copy()


@dataclass
class SingleTrade(Policy):
    def __call__(self, state, bars):
        return state["done"] | ((state["position"] == 0) & state["had"])


@dataclass
class TradingPolicy:
    """Done, open, initial stop, maintenance, in this order; the last bar is done for all."""

    open: Policy
    initial: Policy = field(default_factory=ArtrStop)
    maintain: Policy = field(default_factory=KeepStop)
    done: Policy = field(default_factory=NeverDone)

    def start(self, n: int) -> dict[str, np.ndarray]:
        out: dict[str, np.ndarray] = {}
        for p in (self.open, self.initial, self.maintain, self.done):
            out |= p.start(n)
        return out

    def __call__(self, state, bars):
        done = self.done(state, bars) | (state["at"] >= len(bars.open) - 1)
        action = np.where(done, 0.0, self.open(state, bars))
        stop = self.initial(state, bars, action)
        return action, self.maintain(state, bars, action, stop), done
