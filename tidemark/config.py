"""Instruments and brokers: records from YAML, derived intervals and contracts."""

from __future__ import annotations

import datetime as dt
import os
from dataclasses import dataclass, field, replace
from pathlib import Path

import yaml

DAY = 86_400
_UNITS = {"s": 1, "m": 60, "h": 3600, "d": DAY, "w": 7 * DAY}


def seconds(text: str | int) -> int:
    """``-06:00:00`` to seconds."""
    if isinstance(text, int):
        return text
    sign, parts = (-1, text[1:]) if text.startswith("-") else (1, text)
    h, m, s = (int(x) for x in parts.split(":"))
    return sign * (h * 3600 + m * 60 + s)


def interval_seconds(text: str) -> int:
    try:
        return int(text[:-1]) * _UNITS[text[-1]]
    except (KeyError, ValueError):
        raise ValueError(f"bad interval: {text}") from None


@dataclass(frozen=True)
class Instrument:
    symbol: str
    interval: str
    type: str = "futures"
    currency: str = "USD"
    description: str = ""
    trading_start: int = 0
    trading_end: int = DAY
    liquid_start: int = 0
    liquid_end: int = DAY
    regular_start: int = 0
    regular_end: int = DAY
    contract_multiplier: float = 1.0
    tick_size: float = 0.01
    start_date: dt.date | None = None
    days_of_week: tuple[int, ...] = (0, 1, 2, 3, 4)
    remove_dates: tuple[dt.date, ...] = ()
    rollover_time: int | None = None
    rollover_vol_alpha: float = 1.0
    rollover_max_days: int | None = None
    traded_months: str | None = None
    last_trade_day_rule: str | None = None
    first_notice_day_rule: str | None = None
    asset_class: str | None = None
    contract_code: str | None = None
    intervals: tuple[str, ...] = ()
    parent: "Instrument | None" = field(default=None, compare=False)

    def __post_init__(self):
        off = self.rollover_offset
        if off is not None and not 0 <= off <= self.trading_end - self.trading_start:
            raise ValueError(f"{self.symbol}: the rollover time is outside the session")

    @property
    def time_step(self) -> int:
        return interval_seconds(self.interval)

    @property
    def end_time(self) -> int:
        """The last step strictly below the session's length."""
        length = self.trading_end - self.trading_start
        return (length - 1) // self.time_step * self.time_step

    @property
    def total_steps(self) -> int:
        return self.end_time // self.time_step + 1

    @property
    def rollover_offset(self) -> int | None:
        return None if self.rollover_time is None else self.rollover_time - self.trading_start

    @property
    def file_symbol(self) -> str:
        return f"{self.symbol}-{self.contract_code}" if self.contract_code else self.symbol


@dataclass(frozen=True)
class Broker:
    symbol: str
    broker_symbol: str
    margin: float = 0.0
    commission: float = 0.0
    min_commission: float = 0.0
    max_commission_pct: float = 0.0
    slippage: float = 0.0
    min_slippage: float = 0.0
    reference_price: float = 1.0


@dataclass(frozen=True)
class Traded:
    """An instrument at a broker."""

    instrument: Instrument
    broker: Broker
    broker_name: str


_TIMES = ("trading_start", "trading_end", "liquid_start", "liquid_end", "regular_start", "regular_end", "rollover_time")


def _snake(name: str) -> str:
    return "".join(f"_{c.lower()}" if c.isupper() else c for c in name)


def _record(raw: dict) -> dict:
    out = {_snake(k): v for k, v in raw.items()}
    for k in _TIMES:
        if out.get(k) is not None:
            out[k] = seconds(out[k])
    day = lambda x: x if isinstance(x, dt.date) else dt.date.fromisoformat(x)
    if out.get("start_date"):
        out["start_date"] = day(out["start_date"])
    out["remove_dates"] = tuple(day(x) for x in out.get("remove_dates") or ())
    for k in ("days_of_week", "intervals"):
        if k in out:
            out[k] = tuple(out[k])
    return out


class Config:
    """Reads both files, and reads them again when they change on disk."""

    def __init__(self, instruments: str | os.PathLike, brokers: str | os.PathLike):
        self.paths = Path(instruments), Path(brokers)
        self._seen: tuple[float, ...] | None = None
        self.reload()

    def reload(self) -> bool:
        now = tuple(p.stat().st_mtime for p in self.paths)
        if now == self._seen:
            return False
        self._instruments, self._brokers = (yaml.safe_load(p.read_text()) for p in self.paths)
        self._seen = now
        return True

    def instrument(self, symbol: str, interval: str, contract_code: str | None = None) -> Instrument:
        """The template's values under the instrument's own; an interval that is not listed derives from
        the largest listed one that divides it."""
        known = self._instruments["instruments"]
        if symbol not in known:
            raise KeyError(symbol)
        raw = dict(known[symbol])
        raw = dict((self._instruments.get("templates") or {}).get(raw.pop("template", None), {})) | raw
        record = _record(raw)
        allowed = record.get("intervals", ())
        if interval in allowed:
            base = Instrument(**record | {"interval": interval})
        else:
            base = derive(Instrument(**record | {"interval": self.parent_interval(allowed, interval)}), interval)
        return derive(base, None, contract_code) if contract_code else base

    @staticmethod
    def parent_interval(allowed, interval: str) -> str:
        step = interval_seconds(interval)
        fits = [x for x in allowed if step % interval_seconds(x) == 0]
        if not fits:
            raise ValueError(f"no interval of {list(allowed)} divides {interval}")
        return max(fits, key=interval_seconds)

    def broker(self, name: str) -> dict[str, Broker]:
        if name not in self._brokers:
            raise KeyError(name)
        raw = self._brokers[name]
        defaults = raw.get("defaults") or {}
        out = {}
        for symbol, own in raw["instruments"].items():
            values = {_snake(k): v for k, v in (defaults | own).items()}
            values["symbol"] = values.pop("instrument_symbol", symbol)
            out[values["symbol"]] = Broker(**values)
        return out

    def traded(self, broker: str, symbol: str, interval: str, contract_code: str | None = None) -> Traded:
        return self.at(self.instrument(symbol, interval, contract_code), broker)

    def at(self, instrument: Instrument, broker: str) -> Traded:
        terms = self.broker(broker)
        if instrument.symbol not in terms:
            raise KeyError(f"{instrument.symbol} at {broker}")
        b = terms[instrument.symbol]
        return Traded(instrument, replace(b, broker_symbol=b.broker_symbol + (instrument.contract_code or "")), broker)


def derive(base: Instrument, interval: str | None = None, contract_code: str | None = None) -> Instrument:
    """A coarser interval, or a contract of a future."""
    if interval is not None and interval != base.interval:
        step = interval_seconds(interval)
        if step % base.time_step or (DAY % step and step % DAY):
            raise ValueError(f"{interval} does not follow from {base.interval}")
        base = replace(base, interval=interval, parent=base)
    if contract_code:
        if base.type != "futures":
            raise ValueError(f"{base.symbol} is no future")
        base = replace(base, contract_code=contract_code, type="futures_individual")
    return base
