"""Continuous futures: liquidity per day, the roll walk, specs, multipliers and back-adjusting."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def daily_stats(bars: DataFrame, contract: str, day: str, offset: str, cutoff: int) -> DataFrame:
    """``(contract, day, liquidity, price)``: yesterday's volume from the cutoff on plus today's before
    it, and the open at the cutoff. Yesterday is the contract's own day before."""
    at = F.col(offset)
    daily = bars.groupBy(contract, day).agg(
        F.coalesce(F.sum(F.when(at < cutoff, F.col("volume"))), F.lit(0)).alias("_before"),
        F.coalesce(F.sum(F.when(at >= cutoff, F.col("volume"))), F.lit(0)).alias("_after"),
        F.max(F.when(at == cutoff, F.col("open"))).alias("price"),
        F.sum((at == cutoff).cast("int")).alias("_n"),
    )
    one = F.when(F.col("_n") != 1, F.raise_error("the cutoff bar is missing or repeated").cast("double")).otherwise(F.col("price"))
    earlier = F.coalesce(F.lag("_after").over(W.partitionBy(contract).orderBy(day)), F.lit(0))
    return daily.select(contract, day, (earlier + F.col("_before")).cast("double").alias("liquidity"), one.alias("price"))


def roll(stats: DataFrame, contracts: DataFrame, alpha: float, most_days: int | None, root: str = "root") -> DataFrame:
    """``(root, day, active, ratio)``. ``stats(root, idx, day, liquidity, price)``; ``contracts(root,
    idx, forced)`` with idx from 0 in order of expiry.

    The walk over days is sequential, one small group a root: a day can only leave the contract that
    the day before chose. It starts on the most liquid contract of the first day; each day but the
    last moves to the next contract if that trades and either the forced date is reached, or the day
    is within ``most_days`` of it and the next is the more liquid by ``alpha``.
    """

    def walk(key: tuple, days: pd.DataFrame, terms: pd.DataFrame) -> pd.DataFrame:
        n = int(terms["idx"].max()) + 1
        forced = {int(i): f for i, f in zip(terms["idx"], terms["forced"]) if not pd.isna(f)}
        vol = days.pivot(index="day", columns="idx", values="liquidity").reindex(columns=range(n)).sort_index()
        price = days.pivot(index="day", columns="idx", values="price").reindex(columns=range(n)).sort_index()
        v, p, order = vol.to_numpy(), price.to_numpy(), list(vol.index)
        now = int(np.argmax(np.nan_to_num(v[0])))
        active, ratio = [], []
        for i, day in enumerate(order):
            r = np.nan
            if i < len(order) - 1 and now + 1 < n and not np.isnan(v[i, now + 1]):
                due = forced.get(now)
                go = due is not None and day >= due
                if not go:
                    near = due is None or most_days is None or (due - day).days <= most_days
                    go = near and np.nan_to_num(v[i, now]) * alpha < v[i, now + 1]
                if go:
                    if not np.isnan(p[i, now]) and p[i, now] != 0:
                        r = p[i, now + 1] / p[i, now]
                    now += 1
            active.append(now)
            ratio.append(None if np.isnan(r) else r)
        return pd.DataFrame({root: key[0], "day": order, "active": active, "ratio": pd.Series(ratio, dtype=float)})

    kind = dict(stats.dtypes)[root]
    terms = contracts.select(root, "idx", "forced").toDF(root, "idx", "forced")
    return stats.select(root, "idx", "day", "liquidity", "price").groupBy(root).cogroup(terms.groupBy(root)).applyInPandas(walk, f"{root} {kind}, day date, active int, ratio double")


def roll_spec(path: DataFrame, root: str = "root", day: str = "day") -> DataFrame:
    """``(root, start_date, active, multiplier)``: one row for each stretch of an active contract;
    its multiplier is the product of all later ratios."""
    by = W.partitionBy(root).orderBy(day)
    starts = path.withColumn("_new", F.coalesce(F.lag("active").over(by) != F.col("active"), F.lit(True))).where("_new")
    later = W.partitionBy(root).orderBy(F.desc(day)).rowsBetween(W.unboundedPreceding, -1)
    factor = F.coalesce(F.product(F.coalesce("ratio", F.lit(1.0))).over(later), F.lit(1.0))
    return starts.select(root, F.col(day).alias("start_date"), "active", factor.alias("multiplier"))


def reverse_product(df: DataFrame, keys: Sequence[str], order: str, value: str, name: str = "factor") -> DataFrame:
    """The product of ``value`` from each row to the last."""
    by = W.partitionBy(*keys).orderBy(F.desc(order)).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumn(name, F.product(value).over(by))


def multiplier_asof(bars: DataFrame, spec: DataFrame, keys: Sequence[str], day: str, offset: str, at: int) -> DataFrame:
    """The multiplier of the last spec row (start date, offset ``at``) up to each bar; the first also
    holds before its start. A union and one window: no range join, one sort on the bars' own keys."""
    marks = spec.select(*keys, F.col("start_date").alias(day), F.lit(at).alias(offset), F.col("multiplier").alias("_m")).withColumn("_kind", F.lit(0))
    rows = bars.withColumn("_kind", F.lit(1))
    both = rows.unionByName(marks, allowMissingColumns=True)
    by = W.partitionBy(*keys).orderBy(day, offset, "_kind")
    seen = F.last("_m", True).over(by.rowsBetween(W.unboundedPreceding, 0))
    first = F.first("_m", True).over(by.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    return both.withColumn("multiplier", F.coalesce(seen, first)).where("_kind = 1").drop("_m", "_kind")


def back_adjust(bars: DataFrame, spec: DataFrame, root: str, contract: str, day: str, offset: str, at: int) -> DataFrame:
    """Bars of each contract while it is the active one, prices times its multiplier. ``spec(root,
    contract, start_date, multiplier)``; a stretch runs from its start at offset ``at`` to the next."""
    by = W.partitionBy(root).orderBy("start_date")
    seg = spec.withColumn("_to", F.lead("start_date").over(by))
    b, s = bars.alias("b"), F.broadcast(seg.alias("s"))
    after = (F.col(f"b.{day}") > F.col("s.start_date")) | ((F.col(f"b.{day}") == F.col("s.start_date")) & (F.col(f"b.{offset}") >= at))
    before = F.col("s._to").isNull() | (F.col(f"b.{day}") < F.col("s._to")) | ((F.col(f"b.{day}") == F.col("s._to")) & (F.col(f"b.{offset}") < at))
    hit = b.join(s, (F.col(f"b.{root}") == F.col(f"s.{root}")) & (F.col(f"b.{contract}") == F.col(f"s.{contract}")) & after & before)
    price = {c: F.col(f"b.{c}") * F.col("s.multiplier") for c in ("open", "high", "low", "close")}
    return hit.select(*[price.get(c, F.col(f"b.{c}")).alias(c) for c in bars.columns])
