"""Parsing the texts of trade and filter logs: money, times, metrics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# How each metric is written in a log's description.
METRICS = {
    "gap": r"Gap:\s*(-?[0-9,]*\.?[0-9]+)",
    "gex": r":\s*(-?[0-9,]*\.?[0-9]+)",
    "change_percent": r"Below min:\s*(-?[0-9,]*\.?[0-9]+)",
    "change_stdev": r"Change Std Devs:\s*(-?[0-9,]*\.?[0-9]+)",
    "open_change": r"Open Chg %:\s*(-?[0-9,]*\.?[0-9]+)",
    "vix_change": r"VIX Change:\s*(-?[0-9,]*\.?[0-9]+)",
}


def number(text: Column, pattern: str, group: int = 1) -> Column:
    """A group of a pattern as a number, thousands separators removed; null without a match."""
    found = F.regexp_extract(text, pattern, group)
    return F.regexp_replace(F.nullif(found, F.lit("")), ",", "").try_cast("double")


def dollars(text: Column) -> Column:
    """``-$1,234.50`` to a number; 0 for anything else."""
    value = F.coalesce(number(text, r"\$([0-9,]*\.?[0-9]+)"), F.lit(0.0))
    return F.when(F.trim(text).startswith("-"), -value).otherwise(value)


def metric(text: Column, kind: str) -> Column:
    return number(text, METRICS[kind])


def indicator(text: Column) -> Column:
    """A description that is a number; blank is 0."""
    return F.coalesce(F.regexp_replace(F.nullif(F.trim(text), F.lit("")), ",", "").try_cast("double"), F.lit(0.0))


def above_average(text: Column) -> Column:
    """1 if the price of "Price: $x, SMA: $y" is above the average, else 0."""
    price, mean = number(text, r"Price:\s*\$?([0-9,]*\.?[0-9]+)"), number(text, r"[SE]?MA:\s*\$?([0-9,]*\.?[0-9]+)")
    return (price > mean).cast("int")


def range_width(text: Column) -> Column:
    """(high - low) / high of "Opening Range: a - b"; 0 if the high is 0."""
    a, b = number(text, r"([0-9,]*\.?[0-9]+)\s*-\s*([0-9,]*\.?[0-9]+)", 1), number(text, r"([0-9,]*\.?[0-9]+)\s*-\s*([0-9,]*\.?[0-9]+)", 2)
    high, low = F.greatest(a, b), F.least(a, b)
    return F.when(high == 0, F.lit(0.0)).otherwise((high - low) / high)


def minutes_of_day(text: Column) -> Column:
    """``3:47pm`` to minutes since midnight; null if it is no time."""
    at = F.try_to_timestamp(F.upper(F.trim(text)), F.lit("h:mma"))
    return F.hour(at) * 60 + F.minute(at)


def us_date(text: Column) -> Column:
    """The first token of a text as a month-first date, or null."""
    return F.try_to_date(F.split(F.trim(text), r"\s+")[0], "M/d/yyyy")


def log_date(text: Column) -> Column:
    return F.try_to_date(F.trim(text), "MMM d, yyyy")
