from __future__ import annotations

from tidemark.plans import trading
from tidemark.plans.views import dense30


def test_every_symbol_is_rolled_out(spark, sf):
    want = {r.symbol for r in dense30(spark, sf).select("symbol").distinct().collect()}
    assert len(want) > 1 and {r.symbol for r in trading.rollout_single_entry(spark, sf).select("symbol").distinct().collect()} == want
