"""Business calendars and futures expiry rules as joins on a calendar table.

Holidays are built from their rules, a few rows a year. A calendar row numbers business days, so
"n business days before" is arithmetic on that number and one equi-join.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

US, US_FX, UK, PLAIN = "US", "US_FX", "UK", "PLAIN"
#: Asset classes that also rest on Columbus Day and Veterans Day.
FX_CLASSES = ("FX", "Interest Rate")
#: Futures month letters, January to December.
MONTH_LETTERS = "FGHJKMNQUVXZ"

# Exchange closures and bank holidays outside the yearly rules.
_US_ONCE = (
    "2001-09-11 2001-09-12 2001-09-13 2001-09-14 2004-06-11 2007-01-02 2012-10-29 2012-10-30 2018-12-05 2025-01-09"
)
_UK_ONCE = "2002-06-03 2011-04-29 2012-06-05 2022-06-03 2022-09-19 2023-05-08"
_UK_MOVED_SPRING = {2002: (6, 4), 2012: (6, 4), 2022: (6, 2)}
_UK_MOVED_MAY = {1995: (5, 8), 2020: (5, 8)}


def easter(year: int) -> dt.date:
    """Gregorian Easter Sunday (the anonymous computus)."""
    a, (b, c) = year % 19, divmod(year, 100)
    d, e = divmod(b, 4)
    g = (8 * b + 13) // 25
    h = (19 * a + b - d - g + 15) % 30
    i, k = divmod(c, 4)
    m = (32 + 2 * e + 2 * i - h - k) % 7
    n = (a + 11 * h + 22 * m) // 451
    month, day = divmod(h + m - 7 * n + 114, 31)
    return dt.date(year, month, day + 1)


def weekday_of_month(year: int, month: int, weekday: int, n: int) -> dt.date:
    """The n-th weekday (Monday is 0), from the end if n is negative; ``ValueError`` if there is none."""
    if n > 0:
        first = dt.date(year, month, 1)
        day = first + dt.timedelta((weekday - first.weekday()) % 7 + 7 * (n - 1))
    else:
        last = dt.date(year + month // 12, month % 12 + 1, 1) - dt.timedelta(1)
        day = last - dt.timedelta((last.weekday() - weekday) % 7 - 7 * (n + 1))
    if day.month != month:
        raise ValueError(f"month {year}-{month:02d} has no weekday {weekday} number {n}")
    return day


def _nearest(day: dt.date) -> dt.date:
    return day + dt.timedelta({5: -1, 6: 1}.get(day.weekday(), 0))


def _forward(day: dt.date, taken: set[dt.date]) -> dt.date:
    while day.weekday() > 4 or day in taken:
        day += dt.timedelta(1)
    return day


def holidays(calendar: str, years: Iterable[int]) -> set[dt.date]:
    out: set[dt.date] = set()
    for y in years:
        if calendar in (US, US_FX):
            new_year = dt.date(y, 1, 1)
            if new_year.weekday() != 5:  # on a Saturday it is not observed, the year before is over
                out.add(_nearest(new_year))
            out |= {weekday_of_month(y, 2, 0, 3), weekday_of_month(y, 5, 0, -1), weekday_of_month(y, 9, 0, 1)}
            out |= {weekday_of_month(y, 11, 3, 4), _nearest(dt.date(y, 7, 4)), _nearest(dt.date(y, 12, 25))}
            out.add(easter(y) - dt.timedelta(2))
            if y >= 1998:
                out.add(weekday_of_month(y, 1, 0, 3))
            if y >= 2022:
                out.add(_nearest(dt.date(y, 6, 19)))
        if calendar == US_FX:
            out |= {weekday_of_month(y, 10, 0, 2), _nearest(dt.date(y, 11, 11))}
        if calendar == UK:
            e = easter(y)
            out |= {e - dt.timedelta(2), e + dt.timedelta(1), weekday_of_month(y, 8, 0, -1)}
            out.add(_forward(dt.date(y, 1, 1), set()))
            out.add(dt.date(y, *_UK_MOVED_MAY[y]) if y in _UK_MOVED_MAY else weekday_of_month(y, 5, 0, 1))
            out.add(dt.date(y, *_UK_MOVED_SPRING[y]) if y in _UK_MOVED_SPRING else weekday_of_month(y, 5, 0, -1))
            christmas = [d for d in (dt.date(y, 12, 25), dt.date(y, 12, 26)) if d.weekday() < 5]
            for d in (dt.date(y, 12, 25), dt.date(y, 12, 26)):
                if d.weekday() > 4:
                    christmas.append(_forward(d, set(christmas)))
            out |= set(christmas)
        for text in {US: _US_ONCE, US_FX: _US_ONCE, UK: _UK_ONCE}.get(calendar, "").split():
            if int(text[:4]) == y:
                out.add(dt.date.fromisoformat(text))
    return out


def calendar_table(spark: SparkSession, first: int, last: int, calendars: Iterable[str] = (US, US_FX, UK, PLAIN)) -> DataFrame:
    """``(calendar, d, is_bd, bd_no, prev_bd)`` for every day of the years; ``bd_no`` counts business
    days up to d, ``prev_bd`` is d itself or the business day before."""
    rows = [(c, d) for c in calendars for d in sorted(holidays(c, range(first - 1, last + 2)))]
    closed = spark.createDataFrame(rows, "calendar string, d date").withColumn("closed", F.lit(True))
    days = spark.createDataFrame([(c,) for c in calendars], "calendar string").select(
        "calendar", F.explode(F.sequence(F.lit(dt.date(first, 1, 1)), F.lit(dt.date(last, 12, 31)))).alias("d")
    )
    days = days.join(F.broadcast(closed), ["calendar", "d"], "left")
    days = days.select("calendar", "d", ((F.weekday("d") < 5) & F.col("closed").isNull()).alias("is_bd"))
    by = W.partitionBy("calendar").orderBy("d")
    return days.select(
        "calendar", "d", "is_bd",
        F.sum(F.col("is_bd").cast("int")).over(by).cast("int").alias("bd_no"),
        F.last(F.when(F.col("is_bd"), F.col("d")), True).over(by).alias("prev_bd"),
    )


def calendar_of(asset_class: Column) -> Column:
    return F.when(asset_class.isin(*FX_CLASSES), F.lit(US_FX)).otherwise(F.lit(US))


def contract_month(code: Column) -> Column:
    """``G15`` to 2015-02-01; an unknown month letter or a code too short is an error."""
    month = F.instr(F.lit(MONTH_LETTERS), F.upper(F.substring(code, 1, 1)))
    bad = F.raise_error(F.concat(F.lit("bad contract code: "), code)).cast("date")
    good = (F.length(code) >= 2) & (month > 0) & (F.substring(code, 1, 1) != "")
    return F.when(good, F.make_date(F.lit(2000) + F.expr("cast(substring(_code, 2) as int)"), month, F.lit(1))).otherwise(bad)


def nth_weekday(month: Column, day: str, n: int) -> Column:
    """The n-th weekday of the month that ``month`` is the first of."""
    return F.date_add(F.next_day(F.date_sub(month, 1), day), 7 * (n - 1))


#: Rules: the day that is looked up, and by how many business days the answer is off its count.
def _rules(m: Column, us: Column) -> dict[str, tuple[Column, Column, Column]]:
    prior = F.add_months(m, -1)
    d25 = F.date_add(prior, 24)
    uk, zero = F.lit(UK), F.lit(0)
    early = (F.year(m) < 2016) | ((F.year(m) == 2016) & (F.month(m) <= 2))
    third_wed = nth_weekday(m, "WED", 3)
    return {
        "LAST_BUSINESS_DAY_CONTRACT_MONTH": (us, F.last_day(m), zero),
        "THIRD_LAST_BUSINESS_DAY_CONTRACT_MONTH": (us, F.last_day(m), F.lit(-2)),
        "SEVEN_BUSINESS_DAYS_PRIOR_LAST_BUS_DAY": (us, F.last_day(m), F.lit(-7)),
        "TENTH_BUSINESS_DAY_CONTRACT_MONTH": (us, F.date_sub(m, 1), F.lit(10)),
        "LAST_BUSINESS_DAY_PRIOR_MONTH": (us, F.last_day(prior), zero),
        "THIRD_LAST_BUSINESS_DAY_PRIOR_MONTH": (us, F.last_day(prior), F.lit(-2)),
        "THIRD_FRIDAY_CONTRACT_MONTH": (us, nth_weekday(m, "FRI", 3), zero),
        "ONE_BUSINESS_DAY_PRIOR_THIRD_WEDNESDAY": (us, F.date_sub(third_wed, 1), zero),
        "TWO_BUSINESS_DAYS_PRIOR_THIRD_WEDNESDAY": (us, F.date_sub(third_wed, 1), F.lit(-1)),
        "THREE_BUSINESS_DAYS_BEFORE_25TH_PRIOR_MONTH": (us, F.date_sub(d25, 1), F.when(F.col("_bd25"), -2).otherwise(-3)),
        "FOUR_BUSINESS_DAYS_BEFORE_25TH_PRIOR_MONTH": (us, F.date_sub(d25, 1), F.when(F.col("_bd25"), -3).otherwise(-4)),
        "BUSINESS_DAY_PRIOR_15TH": (us, F.date_add(m, 13), zero),
        "FEB_LONDON_SPECIAL_RULE": (
            uk,
            F.when(early, F.date_sub(m, 16)).otherwise(F.last_day(F.add_months(m, -2))),
            F.when(~early & (F.month(m) == 2), -1).otherwise(0),
        ),
        "THURSDAY_PRIOR_SECOND_FRIDAY_CON_MONTH": (us, F.date_sub(nth_weekday(m, "FRI", 2), 1), zero),
        "FIRST_BUSINESS_DAY_AFTER_FIRST_FRIDAY": (us, nth_weekday(m, "FRI", 1), F.lit(1)),
    }


LAST_THURSDAY = "LAST_THURSDAY_SPECIAL_RULE"
RULES = (
    "LAST_BUSINESS_DAY_CONTRACT_MONTH", "THIRD_LAST_BUSINESS_DAY_CONTRACT_MONTH", "SEVEN_BUSINESS_DAYS_PRIOR_LAST_BUS_DAY",
    "TENTH_BUSINESS_DAY_CONTRACT_MONTH", "LAST_BUSINESS_DAY_PRIOR_MONTH", "THIRD_LAST_BUSINESS_DAY_PRIOR_MONTH",
    "THIRD_FRIDAY_CONTRACT_MONTH", "ONE_BUSINESS_DAY_PRIOR_THIRD_WEDNESDAY", "TWO_BUSINESS_DAYS_PRIOR_THIRD_WEDNESDAY",
    "THREE_BUSINESS_DAYS_BEFORE_25TH_PRIOR_MONTH", "FOUR_BUSINESS_DAYS_BEFORE_25TH_PRIOR_MONTH", "BUSINESS_DAY_PRIOR_15TH",
    "FEB_LONDON_SPECIAL_RULE", LAST_THURSDAY, "THURSDAY_PRIOR_SECOND_FRIDAY_CON_MONTH", "FIRST_BUSINESS_DAY_AFTER_FIRST_FRIDAY",
)


def expirations(contracts: DataFrame, cal: DataFrame) -> DataFrame:
    """Add ``expiry`` to ``contracts(code, rule, asset_class)``; an unknown rule is an error."""
    c = contracts.withColumn("_code", F.col("code")).withColumn("_m", contract_month(F.col("code"))).withColumn("_us", calendar_of(F.col("asset_class")))
    days = F.broadcast(cal.select(F.col("calendar").alias("_c"), F.col("d").alias("_d"), "is_bd", "bd_no"))
    d25 = F.date_add(F.add_months(F.col("_m"), -1), 24)
    c = c.join(days, (F.col("_us") == F.col("_c")) & (d25 == F.col("_d"))).withColumn("_bd25", F.col("is_bd")).drop("_c", "_d", "is_bd", "bd_no")
    ref = delta = which = None
    for name, (calendar, day, off) in _rules(F.col("_m"), F.col("_us")).items():
        hit = F.col("rule") == name
        which = F.when(hit, calendar) if which is None else which.when(hit, calendar)
        ref = F.when(hit, day) if ref is None else ref.when(hit, day)
        delta = F.when(hit, off) if delta is None else delta.when(hit, off)
    fail = F.raise_error(F.concat(F.lit("unknown rule: "), F.col("rule")))
    simple = c.where(F.col("rule") != LAST_THURSDAY)
    simple = simple.select("*", F.coalesce(which, fail.cast("string")).alias("_cal"), ref.alias("_ref"), delta.alias("_off"))
    simple = simple.join(days, (F.col("_cal") == F.col("_c")) & (F.col("_ref") == F.col("_d"))).withColumn("_no", F.col("bd_no") + F.col("_off")).drop("_c", "_d", "is_bd", "bd_no")
    bd = F.broadcast(cal.where("is_bd").select(F.col("calendar").alias("_c"), F.col("bd_no").alias("_k"), F.col("d").alias("expiry")))
    keep = [*contracts.columns, "expiry"]
    simple = simple.join(bd, (F.col("_cal") == F.col("_c")) & (F.col("_no") == F.col("_k"))).select(*keep)
    return simple.unionByName(_last_thursday(c.where(F.col("rule") == LAST_THURSDAY), cal, contracts.columns))


def _last_thursday(c: DataFrame, cal: DataFrame, keep: list[str]) -> DataFrame:
    """The last Thursday (in November the one before Thanksgiving) if it and the four weekdays before
    are business days, else the latest Thursday before it that is one like the day before it."""
    first = F.when(F.month("_m") == 11, F.date_add(nth_weekday(F.col("_m"), "THU", 4), -7)).otherwise(
        F.date_sub(F.next_day(F.last_day("_m"), "THU"), 7)
    )
    tries = c.withColumn("_j", F.explode(F.array(*[F.lit(j) for j in range(9)]))).withColumn("_t", F.date_sub(first, 7 * F.col("_j")))
    by = W.partitionBy("calendar").orderBy("d")
    flags = cal.select(
        F.col("calendar").alias("_c"), F.col("d").alias("_d"),
        (F.col("bd_no") - F.lag("bd_no", 7).over(by) == 5).alias("_five"),
        (F.col("bd_no") - F.lag("bd_no", 2).over(by) == 2).alias("_two"),
    )
    hit = tries.join(F.broadcast(flags), (F.col("_us") == F.col("_c")) & (F.col("_t") == F.col("_d")))
    hit = hit.where(F.when(F.col("_j") == 0, F.col("_five")).otherwise(F.col("_two")))
    return hit.groupBy(*keep).agg(F.max("_t").alias("expiry"))


def last_traded(day: Column, days: DataFrame, requests: DataFrame, name: str = "day") -> DataFrame:
    """As-of: the last of ``days(d)`` up to ``requests.name``; the day itself if it is before all."""
    marks = days.select(F.col("d").alias("_at"), F.col("d").alias("_v")).withColumn("_kind", F.lit(0))
    asks = requests.select(F.col(name).alias("_at")).distinct().withColumn("_v", F.lit(None).cast("date")).withColumn("_kind", F.lit(1))
    seen = F.last("_v", True).over(W.orderBy("_at", "_kind").rowsBetween(W.unboundedPreceding, 0))
    found = marks.unionByName(asks).withColumn("_seen", seen).where("_kind = 1")
    return requests.join(F.broadcast(found.select(F.col("_at").alias(name), F.coalesce("_seen", "_at").alias("last_traded"))), name)


def forced_roll(expiry: Column, notice: Column) -> Column:
    """The earlier of expiry and first notice; either may be missing."""
    return F.least(expiry, notice)
