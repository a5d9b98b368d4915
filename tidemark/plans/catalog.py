"""Every registered query with its SQL twin."""

from __future__ import annotations

from . import futures, market, mining, trading

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for _part in (market, futures, mining, trading):
    QUERIES |= _part.QUERIES
    ORACLES |= _part.ORACLES
