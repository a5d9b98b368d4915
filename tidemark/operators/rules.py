"""Rule mining on trade logs: filter tables, thresholds, masks, scores, children, cross-validation.

Filters stay long: ``(day, name, value)``. A split is a row; its mask is packed into an array of
63-bit words, so that equal masks are one group key, intersections are ``zip_with`` and counts
``bit_count``. Nothing is compared on the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

LEFT, RIGHT = "left", "right"
WORD_BITS = 63
DAYS_A_YEAR = 365.25


# ---------------------------------------------------------------- filter tables


def outer_join(tables: Sequence[DataFrame], on: str = "date") -> DataFrame:
    """All filter columns on every date of any of them; missing values are 0."""
    return reduce(lambda a, b: a.join(b, on, "full"), tables).na.fill(0)


def pivot(long: DataFrame, names: Sequence[str], on: str = "day") -> DataFrame:
    """The same from the long form, with one shuffle for any number of filters."""
    return long.groupBy(on).pivot("name", list(names)).agg(F.first("value")).na.fill(0)


def one_a_date(df: DataFrame, date: str, value: str, seq: str) -> DataFrame:
    """One row a date; dates with different values (null is one) are an error."""
    kinds = F.count_distinct(value) + F.max(F.col(value).isNull().cast("int"))
    merged = df.groupBy(date).agg(F.min_by(value, seq).alias(value), kinds.alias("_k"))
    bad = F.raise_error(F.concat(F.lit("conflicting values on "), F.col(date).cast("string")))
    return merged.select(date, F.when(F.col("_k") > 1, bad.cast(df.schema[value].dataType)).otherwise(F.col(value)).alias(value))


def align(filters: DataFrame, trades: DataFrame, date: str = "date") -> DataFrame:
    """Filters of the trade dates; a trade date without filters is an error, which names the first of them."""
    missing = trades.select(date).join(filters.select(date), date, "left_anti")
    bad = missing.agg(F.count("*").alias("n"), F.min(date).alias("d"))
    text = F.concat(F.lit("no filters on "), F.col("d").cast("string"), F.lit(" and "), (F.col("n") - 1).cast("string"), F.lit(" more"))
    # one row by construction
    guard = bad.select(F.when(F.col("n") > 0, F.raise_error(text)).alias("_ok"))
    return filters.join(trades.select(date).distinct(), date, "left_semi").join(F.broadcast(guard)).where("_ok is null").drop("_ok")


def computed_columns(trades: DataFrame, width: float, date: str = "date", risk: str = "risk", start: str | None = None) -> DataFrame:
    """Reward per risk, premium, a flag for each weekday and minutes since midnight of the open."""
    out = trades.withColumn("reward_per_risk", F.try_divide(width * 100 - F.col(risk), F.col(risk))).withColumn("premium", width * 100 - F.col(risk))
    for i, name in enumerate(("monday", "tuesday", "wednesday", "thursday", "friday")):
        out = out.withColumn(f"is_{name}", (F.weekday(date) == i).cast("int"))
    return out.withColumn("open_minutes", F.coalesce(F.col(start), F.lit(0)) if start else F.lit(0))


WEEKDAYS = tuple(f"is_{d}" for d in ("monday", "tuesday", "wednesday", "thursday", "friday"))
#: Granularities of the computed columns; flags can only be excluded, reward per risk only be asked for.
GRAINS = {"reward_per_risk": 0.001, "premium": 1.0, "open_minutes": 5.0} | dict.fromkeys(WEEKDAYS, 1.0)
COMPUTED_LEFT, COMPUTED_RIGHT = WEEKDAYS, ("reward_per_risk",)


def with_computed(long: DataFrame, trades: DataFrame, width: float, date: str = "day", risk: str = "risk", start: str | None = None) -> DataFrame:
    """Filters ``long(day, name, value)`` and the computed columns of the trades as further ones."""
    names = ["reward_per_risk", "premium", *WEEKDAYS, "open_minutes"]
    wide = computed_columns(trades, width, date, risk, start).select(date, *[F.col(n).cast("double").alias(n) for n in names])
    return long.unionByName(wide.unpivot([date], names, "name", "value"))


# ---------------------------------------------------------------- thresholds and splits


def thresholds(
    long: DataFrame, min_samples: int, granularity: dict[str, float] | None = None, default: float = 0.01, most: int | None = None,
    left_only: Sequence[str] = (), right_only: Sequence[str] = (),
) -> DataFrame:
    """``(name, direction, threshold, n)``: candidate splits of each filter.

    Values are rounded up (left) or down (right) to the granularity; a threshold is the middle of two
    neighbours, rounded down or up. A left split keeps values up to it, a right split from it on;
    both need ``min_samples``. Of more than ``most`` the ones nearest to even counts are kept.
    """
    grain = F.lit(default)
    if granularity:
        pairs = [F.lit(x) for k, v in granularity.items() for x in (k, float(v))]
        grain = F.coalesce(F.try_element_at(F.create_map(*pairs), F.col("name")), grain)
    base = long.withColumn("_g", grain)
    both = []
    for side, step, back in ((LEFT, F.ceil, F.floor), (RIGHT, F.floor, F.ceil)):
        u = base.withColumn("_u", step(F.col("value") / F.col("_g")) * F.col("_g")).groupBy("name", "_g", "_u").agg(F.count("*").alias("_c"))
        by = W.partitionBy("name").orderBy("_u")
        up_to = F.sum("_c").over(by)
        total = F.sum("_c").over(W.partitionBy("name"))
        u = u.withColumn("_left", up_to).withColumn("_total", total).withColumn("_next", F.lead("_u").over(by)).where("_next is not null")
        n = F.col("_left") if side == LEFT else F.col("_total") - F.col("_left")
        t = back((F.col("_u") + F.col("_next")) / 2 / F.col("_g")) * F.col("_g")
        u = u.select("name", F.lit(side).alias("direction"), t.alias("threshold"), n.alias("n"), "_left", "_total").where(F.col("n") >= min_samples)
        skip = right_only if side == LEFT else left_only
        both.append(u.where(~F.col("name").isin(*skip)) if skip else u)
    out = both[0].unionByName(both[1])
    if most is not None:
        out = out.groupBy("name", "direction").applyInPandas(_evenly(most, min_samples), out.schema)
    return out.drop("_left", "_total")


def _evenly(most: int, min_samples: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def pick(rows: pd.DataFrame) -> pd.DataFrame:
        if len(rows) <= most:
            return rows
        rows = rows.sort_values("_left", kind="stable").reset_index(drop=True)
        left, total = rows["_left"].to_numpy(float), float(rows["_total"].iloc[0])
        chosen: list[int] = []
        for j in range(1, most + 1):
            want = min_samples + j * (total - min_samples) / (most + 1)
            at = int(np.argmin(np.abs(left - want)))
            if at not in chosen:
                chosen.append(at)
        return rows.iloc[chosen]

    return pick


#: Rows up to which a table of splits, folds or days is broadcast.
FEW = 100_000


def _few(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if len(df.limit(FEW + 1).select(F.lit(1)).take(FEW + 1)) <= FEW else df


def members(splits: DataFrame, long: DataFrame) -> DataFrame:
    """``(name, direction, threshold, day)``: the samples that each split keeps."""
    keeps = F.when(F.col("direction") == LEFT, F.col("value") <= F.col("threshold")).otherwise(F.col("value") >= F.col("threshold"))
    return long.join(_few(splits), "name").where(keeps).select("name", "direction", "threshold", "day")


def pack(membership: DataFrame, keys: Sequence[str], sample: str, samples: int) -> DataFrame:
    """``(*keys, mask, n)``: mask is an array of 63-bit words over samples 0, 1, ..."""
    words = -(-samples // WORD_BITS)
    bits = membership.groupBy(*keys, F.floor(F.col(sample) / WORD_BITS).cast("int").alias("_w")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, cast({sample} % {WORD_BITS} as int))")).alias("_b"), F.count("*").alias("_n")
    )
    by_word = F.map_from_entries(F.collect_list(F.struct("_w", "_b")))
    got = bits.groupBy(*keys).agg(by_word.alias("_m"), F.sum("_n").alias("n"))
    mask = F.transform(F.sequence(F.lit(0), F.lit(words - 1)), lambda i: F.coalesce(F.try_element_at("_m", i), F.lit(0).cast("long")))
    return got.select(*keys, mask.alias("mask"), "n")


def both(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.bitwiseAND(y))


def count_bits(mask: Column) -> Column:
    return F.aggregate(mask, F.lit(0), lambda a, x: a + F.bit_count(x))


def merge_identical(splits: DataFrame) -> DataFrame:
    """Splits of equal mask as one: the first id, all filters in order of id, all parent sets once."""
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("split_id", "filters"))), lambda x: x["filters"])
    parents = F.array_sort(F.array_distinct(F.flatten(F.collect_list("parents"))))
    return splits.groupBy("mask").agg(
        F.min("split_id").alias("split_id"),
        F.flatten(in_order).alias("filters"),
        parents.alias("parents"),
        F.min("n").alias("n"),
        F.min_by("score", "split_id").alias("score"),
    )


def parent_sets(a: Column, b: Column) -> Column:
    """Every union of a set of ``a`` with a set of ``b``, sorted, once."""
    pairs = F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: F.array_sort(F.array_distinct(F.concat(x, y))))))
    return F.array_distinct(pairs)


def excluded(mask_a: Column, mask_b: Column, n_a: Column, n_b: Column, min_samples: int) -> Column:
    """Too few samples in common, or one holds the other."""
    n = count_bits(both(mask_a, mask_b))
    return (n < min_samples) | (n == n_a) | (n == n_b)


def tested(a: DataFrame, b: DataFrame, min_samples: int) -> DataFrame:
    """``(a_id, b_id, excluded)`` of each pair with a_id below b_id, of ``(split_id, mask, n)`` tables."""
    x, y = a.select("split_id", "mask", "n").toDF("a_id", "ma", "na"), b.select("split_id", "mask", "n").toDF("b_id", "mb", "nb")
    pairs = x.join(_few(y), F.col("a_id") < F.col("b_id"))
    return pairs.select("a_id", "b_id", excluded(F.col("ma"), F.col("mb"), F.col("na"), F.col("nb"), min_samples).alias("excluded"))


def children(a: DataFrame, b: DataFrame, min_samples: int) -> DataFrame:
    """``(a_id, b_id, mask, n, parents)`` of each unordered pair that is not excluded. ``b`` is the
    depth-one set, which is small; each pair is met once, from its smaller id where both sets hold it."""
    x = a.select(*[F.col(c).alias(f"a_{c}") for c in ("split_id", "mask", "n", "parents")])
    y = b.select(*[F.col(c).alias(f"b_{c}") for c in ("split_id", "mask", "n", "parents")])
    same = F.array_contains(F.flatten("a_parents"), F.col("b_split_id"))
    pairs = x.join(_few(y), (F.col("a_split_id") < F.col("b_split_id")) & ~same)
    kept = pairs.where(~excluded(F.col("a_mask"), F.col("b_mask"), F.col("a_n"), F.col("b_n"), min_samples))
    mask = both(F.col("a_mask"), F.col("b_mask"))
    return kept.select(
        F.col("a_split_id").alias("a_id"), F.col("b_split_id").alias("b_id"), mask.alias("mask"),
        count_bits(mask).cast("long").alias("n"), parent_sets(F.col("a_parents"), F.col("b_parents")).alias("parents"),
    )


def without_known(new: DataFrame, old: DataFrame) -> DataFrame:
    return new.join(old.select("mask"), "mask", "left_anti")


def top(splits: DataFrame, k: int, score: str = "score", order: str = "split_id") -> DataFrame:
    """The k best; a missing score is the worst; ties go to the smaller id."""
    return splits.orderBy(F.coalesce(F.col(score), F.lit(float("-inf"))).desc(), order).limit(k)


# ---------------------------------------------------------------- scores


def sharpe(n: Column, total: Column, squares: Column, days: Column | int) -> Column:
    """Annualised Sharpe ratio of returns padded with zeros to calendar days, from sums only."""
    days = F.lit(days) if isinstance(days, int) else days
    mean = total / days
    var = F.greatest((squares - days * mean * mean) / (days - 1), F.lit(0.0))
    return mean / (F.sqrt(var) + F.lit(2e-8)) * F.lit(DAYS_A_YEAR**0.5)


def score(membership: DataFrame, returns: DataFrame, keys: Sequence[str], days: int) -> DataFrame:
    """``(*keys, n, mean, std, sharpe)`` of each split's samples; ``returns(day, r)``."""
    sums = membership.join(returns, "day").groupBy(*keys).agg(
        F.count("*").alias("n"), F.sum("r").alias("_s"), F.sum(F.col("r") * F.col("r")).alias("_q"),
        F.avg("r").alias("mean"), F.coalesce(F.stddev_samp("r"), F.lit(0.0)).alias("std"),
    )
    return sums.select(*keys, "n", "mean", "std", sharpe(F.col("n"), F.col("_s"), F.col("_q"), days).alias("sharpe"))


def sharpe_by_slices(membership: DataFrame, returns: DataFrame, slices: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The worst slice's Sharpe ratio. ``slices(slice, from_day, to_day)``, few, ends exclusive."""
    s = F.broadcast(slices)
    inside = membership.join(returns, "day").join(s, (F.col("day") >= F.col("from_day")) & (F.col("day") < F.col("to_day")))
    sums = inside.groupBy(*keys, "slice", "from_day", "to_day").agg(F.count("*").alias("_n"), F.sum("r").alias("_s"), F.sum(F.col("r") * F.col("r")).alias("_q"))
    days = F.datediff("to_day", "from_day").cast("double")
    each = sums.withColumn("_x", sharpe(F.col("_n"), F.col("_s"), F.col("_q"), days))
    # a slice without samples has return 0
    n = slices.count()
    worst = F.min("_x")
    return each.groupBy(*keys).agg(F.when(F.count("*") < n, F.least(worst, F.lit(0.0))).otherwise(worst).alias("sharpe"))


# ---------------------------------------------------------------- cross-validation


def purged_folds(offsets: DataFrame, samples: int, folds: int, purge: float, embargo: float, min_train: float) -> DataFrame:
    """``(repeat, fold, train_end, test_start, test_end)`` of expanding windows; ``offsets(repeat,
    offset)`` says where the first test of a repeat starts, so results can be reproduced.

    A test holds samples / folds rows; between training and test lie at least one purged row and the
    embargo. Folds whose training holds too few rows, or whose test runs over the end, are left out.
    """
    test = samples // folds
    gap = max(1, int(test * purge)) + int(test * embargo)
    f = offsets.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
    start = (F.col("offset") + F.col("fold") * test).cast("int")
    f = f.select("repeat", "fold", (start - gap).alias("train_end"), start.alias("test_start"), (start + test).alias("test_end"))
    return f.where((F.col("train_end") >= max(1, int(samples * min_train))) & (F.col("test_end") <= samples))


def fold_masks(folds: DataFrame, samples: int) -> DataFrame:
    """``(repeat, fold, i, part)``: the rows of each fold, ``train`` or ``test``."""
    i = folds.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))
    part = F.when(F.col("i") < F.col("train_end"), "train").when(F.col("i").between(F.col("test_start"), F.col("test_end") - 1), "test")
    return i.select("repeat", "fold", "i", part.alias("part")).where("part is not null")


def k_folds(samples: DataFrame, folds: int, repeats: int, seed: int = 0) -> DataFrame:
    """``(repeat, i, fold)`` of plain shuffled folds; the shuffle is a hash of seed and row."""
    r = samples.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    by = W.partitionBy("repeat").orderBy(F.xxhash64(F.lit(seed), "repeat", "i"), "i")
    return r.select("repeat", "i", (F.ntile(folds).over(by) - 1).alias("fold"))


Score = Callable[[Column, Column, Column], Column]


def mean_score(n: Column, total: Column, squares: Column) -> Column:
    return F.try_divide(total, n)


def sharpe_score(days: int) -> Score:
    """The annualised Sharpe ratio over so many calendar days, as a score."""
    return lambda n, total, squares: sharpe(n, total, squares, days)


def _sums_up_to(rows: DataFrame, keys: Sequence[str], bounds: DataFrame) -> DataFrame:
    """``(*keys, bound, n, s, q)``: count, sum and sum of squares of ``rows(*keys, i, r)`` with i below each of
    ``bounds(bound)``: rows are added up by i, then one running sum over them and the bounds."""
    r = F.col("r")
    data = rows.groupBy(*keys, "i").agg(F.count("r").alias("n"), F.sum("r").alias("s"), F.sum(r * r).alias("q"))
    zero = F.lit(0.0)
    asked = rows.select(*keys).distinct().crossJoin(F.broadcast(bounds)).select(*keys, (F.col("bound") - 0.5).alias("at"), F.lit(0).cast("long").alias("n"), zero.alias("s"), zero.alias("q"), "bound")
    data = data.select(*keys, F.col("i").cast("double").alias("at"), "n", F.coalesce("s", zero).alias("s"), F.coalesce("q", zero).alias("q"), F.lit(None).cast("int").alias("bound"))
    run = W.partitionBy(*keys).orderBy("at").rowsBetween(W.unboundedPreceding, 0) if keys else W.orderBy("at").rowsBetween(W.unboundedPreceding, 0)
    summed = data.unionByName(asked.withColumn("bound", F.col("bound").cast("int"))).select(*keys, "bound", *[F.sum(c).over(run).alias(c) for c in ("n", "s", "q")])
    return summed.where("bound is not null")


def _by_fold(rows: DataFrame, keys: Sequence[str], folds: DataFrame, score: Score) -> DataFrame:
    """``(*keys, repeat, fold, train, test)``: scores of the training and the test rows of each fold."""
    ends = folds.select("repeat", "fold", F.explode(F.array(*[F.struct(F.lit(c).alias("role"), F.col(c).cast("int").alias("bound")) for c in ("train_end", "test_start", "test_end")])).alias("e"))
    ends = ends.select("repeat", "fold", "e.role", "e.bound")
    up_to = _sums_up_to(rows, keys, ends.select("bound").distinct())
    at = up_to.join(F.broadcast(ends), "bound")
    pick = lambda role, c: F.max(F.when(F.col("role") == role, F.col(c)))
    each = at.groupBy(*keys, "repeat", "fold").agg(*[pick(role, c).alias(f"{role}_{c}") for role in ("train_end", "test_start", "test_end") for c in ("n", "s", "q")])
    train = score(*[F.col(f"train_end_{c}") for c in ("n", "s", "q")])
    test = score(*[F.col(f"test_end_{c}") - F.col(f"test_start_{c}") for c in ("n", "s", "q")])
    return each.select(*keys, "repeat", "fold", train.alias("train"), test.alias("test"))


def evaluate(membership: DataFrame, returns: DataFrame, folds: DataFrame, least: float = 0.0, score: Score = mean_score) -> DataFrame:
    """``(name, direction, gain, std, drop, n, above)`` of each filter and side.

    ``membership(split_id, name, direction, n_all, i)``, ``returns(i, r)``, ``folds`` few. In each fold the
    split with the best training score is tried on the test rows and held against all test rows; a
    split without rows there scores 0. Ties, to ten digits, go to the smaller split_id. Scores come from
    counts, sums and sums of squares, so that a fold costs look-ups in running sums and no pass over rows.
    """
    keys = ["name", "direction", "split_id", "n_all"]
    s = _by_fold(membership.join(returns, "i").select(*keys, "i", "r"), keys, folds, score)
    base = _by_fold(returns.select(F.lit(0).alias("one"), "i", "r"), ["one"], folds, score).select("repeat", "fold", F.col("test").alias("base"))
    best = W.partitionBy("repeat", "fold", "name", "direction").orderBy(F.round("train", 10).desc_nulls_last(), "split_id")
    won = s.withColumn("_r", F.row_number().over(best)).where("_r = 1").join(F.broadcast(base), ["repeat", "fold"])
    test = F.coalesce("test", F.lit(0.0))
    won = won.withColumn("_gain", test - F.col("base")).withColumn("_drop", F.col("train") - test)
    return won.groupBy("name", "direction").agg(
        F.avg("_gain").alias("gain"),
        F.coalesce(F.stddev_samp("_gain"), F.lit(0.0)).alias("std"),
        F.avg("_drop").alias("drop"),
        F.floor(F.avg("n_all") + 0.5).cast("long").alias("n"),
        (F.avg((F.col("_gain") >= least - 1e-12).cast("double")) * 100).alias("above"),
    )


# ---------------------------------------------------------------- the whole search


@dataclass
class SplitSearch:
    """Rules up to ``depth`` filters from trades and filters, scored by ``score`` (mean return).

    ``width`` adds the computed columns of a spread so wide as filters, with their granularities and
    sides, which ``granularity``, ``left_only`` and ``right_only`` add to. ``folds`` is what
    :func:`purged_folds` gives for as many repeats as are wanted.
    """

    min_samples: int = 30
    depth: int = 2
    keep: int | None = 64
    most: int | None = 10
    granularity: dict[str, float] = field(default_factory=dict)
    folds: DataFrame | None = None
    least_gain: float = 0.0
    score: Score = mean_score
    width: float | None = None
    left_only: Sequence[str] = ()
    right_only: Sequence[str] = ()
    start: str | None = None

    def run(self, trades: DataFrame, long: DataFrame) -> DataFrame:
        """``(split_id, depth, filters, parents, mask, n, score)``; trades(day, risk, profit)."""
        from ..plans.stage import cut

        # days are numbered once; a trade log is one row a day
        days = cut(trades.select("day", F.try_divide("profit", "risk").alias("r")).withColumn("i", F.row_number().over(W.orderBy("day")) - 1))
        samples = days.count()
        left, right, grains = list(self.left_only), list(self.right_only), dict(self.granularity)
        if self.width is not None:
            long = with_computed(long, trades, self.width, start=self.start)
            left, right, grains = left + list(COMPUTED_LEFT), right + list(COMPUTED_RIGHT), GRAINS | grains
        used = long.join(days.select("day"), "day", "left_semi")
        t = thresholds(used, self.min_samples, grains, most=self.most, left_only=left, right_only=right)
        t = cut(t.withColumn("split_id", F.row_number().over(W.orderBy("name", "direction", "threshold")) - 1))
        held = members(t, used).join(_few(t), ["name", "direction", "threshold"]).join(days, "day")
        if self.folds is not None:
            seen = evaluate(held.select("split_id", "name", "direction", F.col("n").alias("n_all"), "i"), days.select("i", "r"), self.folds, self.least_gain, self.score)
            good = seen.where(F.col("gain") >= self.least_gain).select("name", "direction")
            if good.take(1):
                held = held.join(_few(good), ["name", "direction"], "left_semi")
        label = F.array(F.struct("name", "direction", "threshold"))
        packed = pack(held, ["split_id"], "i", samples).join(t.select("split_id", label.alias("filters")), "split_id")
        one = packed.join(self._sums(held.select("split_id", "r")), "split_id").withColumn("parents", F.array(F.array("split_id")))
        level = cut(self._best(merge_identical(one)).withColumn("depth", F.lit(1)))
        first, found = level, level
        for depth in range(2, self.depth + 1):
            made = children(level, first, self.min_samples)
            made = without_known(made.groupBy("mask").agg(F.min("n").alias("n"), F.min(F.struct("a_id", "b_id")).alias("_o"), F.flatten(F.collect_list("parents")).alias("parents")), found)
            base = found.agg(F.max("split_id")).first()[0]
            made = made.withColumn("split_id", (F.row_number().over(W.orderBy("_o")) + base).cast("int"))
            scored = self._scored(made.withColumn("parents", F.array_distinct("parents")), days)
            level = cut(self._best(scored).withColumn("depth", F.lit(depth)))
            if not level.take(1):
                break
            found = cut(found.unionByName(level.select(*found.columns)))
        return found

    def _best(self, splits: DataFrame) -> DataFrame:
        return splits if self.keep is None else top(splits, self.keep)

    def _sums(self, rows: DataFrame) -> DataFrame:
        r = F.col("r")
        return rows.groupBy("split_id").agg(self.score(F.count(r), F.sum(r), F.sum(r * r)).alias("score"))

    def _scored(self, splits: DataFrame, days: DataFrame) -> DataFrame:
        # a mask's bits as rows, by word: the days they stand for are joined by number
        word = splits.select("split_id", F.posexplode("mask").alias("w", "bits")).where("bits <> 0")
        bit = word.select("split_id", F.explode(F.expr(f"filter(transform(sequence(0, {WORD_BITS - 1}), b -> if(shiftright(bits, b) & 1 = 1, w * {WORD_BITS} + b, null)), x -> x is not null)")).alias("i"))
        means = self._sums(bit.join(days.select("i", "r"), "i").select("split_id", "r"))
        filters = F.array().cast("array<struct<name:string,direction:string,threshold:double>>")
        return splits.join(means, "split_id").select("mask", "split_id", filters.alias("filters"), "parents", "n", "score")


def show(found: DataFrame, depth: int, rows: int = 20) -> str:
    """The splits of a depth as a text table, best score first."""
    best = found.where(F.col("depth") == depth).orderBy(F.desc_nulls_last("score"), "split_id").limit(rows)
    lines = [f"depth {depth}"] + [f"{r['split_id']:>6}  n={r['n']:<6}  score={r['score'] if r['score'] is not None else float('nan'):.6f}" for r in best.select("split_id", "n", "score").collect()]
    return "\n".join(lines)


def describe(parents: list[list[int]], names: dict[int, list[tuple[str, str, float]]], most: int = 3) -> str:
    """A rule as text: alternatives of conjunctions, each in canonical order, equal sides merged."""
    terms = set()
    for group in parents:
        options: list[list[tuple[str, str, float]]] = [[]]
        for p in sorted(group):
            options = [o + [f] for o in options for f in names[p]]
        for o in options:
            merged: dict[tuple[str, str], float] = {}
            for name, side, t in o:
                pick = min if side == LEFT else max
                merged[(name, side)] = pick(merged.get((name, side), t), t)
            terms.add(tuple(sorted((n, s, t) for (n, s), t in merged.items())))
    text = [" & ".join(f"({n} {'<=' if s == LEFT else '>='} {t:g})" for n, s, t in term) for term in sorted(terms)]
    more = f" | ... {len(text) - most} more" if len(text) > most else ""
    return " | ".join(text[:most]) + more


# ---------------------------------------------------------------- money management


def kelly(profits: np.ndarray, halvings: int = 50) -> float:
    """The fraction that maximises mean log growth, by halving where growth still rises; 0 where nothing
    is won on average, infinite where something is and nothing ever lost. Missing profits don't count."""
    x = np.asarray(profits, dtype=float)
    x = x[~np.isnan(x)]
    if not len(x) or x.mean() <= 0:
        return 0.0
    worst = x.min()
    if worst >= 0:
        return float("inf")
    lo, hi = 0.0, 1.0 / -worst * (1 - 1e-9)
    for _ in range(halvings):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if (x / (1 + mid * x)).sum() > 0 else (lo, mid)
    return (lo + hi) / 2


def log_growth_weights(returns: np.ndarray, steps: int = 500, tol: float = 1e-9) -> np.ndarray:
    """Weights x >= 0 with sum at most 1 that maximise the sum of log(1 + returns @ x), by conditional
    gradients with backtracking."""
    a = np.asarray(returns, dtype=float)
    x = np.zeros(a.shape[1])
    value = lambda w: np.log1p(a @ w).sum() if (a @ w > -1).all() else -np.inf
    for _ in range(steps):
        grad = a.T @ (1 / (1 + a @ x))
        best = int(grad.argmax())
        target = np.zeros_like(x)
        if grad[best] > 0:
            target[best] = 1.0
        way = target - x
        gap = float(grad @ way)
        if gap <= tol:
            break
        step, now = 1.0, value(x)
        while step > 1e-12 and value(x + step * way) < now + 1e-4 * step * gap:
            step /= 2
        x = x + step * way
    return x
