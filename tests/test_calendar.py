from __future__ import annotations

import datetime as dt

import pytest

from tidemark.functions import calendar as cal


def day(text):
    return dt.date.fromisoformat(text)


@pytest.mark.parametrize(
    ("kind", "text", "closed"),
    [
        (cal.US, "2020-04-10", True), (cal.US, "2020-07-03", True), (cal.US, "2021-12-24", True), (cal.US, "2021-12-31", False),
        (cal.US, "2020-10-12", False), (cal.US_FX, "2020-10-12", True), (cal.US_FX, "2018-11-12", True), (cal.US, "2022-06-20", True),
        (cal.UK, "2020-05-08", True), (cal.UK, "2020-05-04", False), (cal.UK, "2021-12-27", True), (cal.UK, "2021-12-28", True),
        (cal.UK, "2022-06-03", True), (cal.UK, "2016-12-27", True), (cal.US, "2012-10-29", True),
    ],
)
def test_holidays(kind, text, closed):
    assert (day(text) in cal.holidays(kind, [day(text).year])) == closed


def test_nth_weekday():
    assert cal.weekday_of_month(2020, 11, 3, 4) == day("2020-11-26")
    with pytest.raises(ValueError):
        cal.weekday_of_month(2020, 2, 0, 5)


@pytest.mark.parametrize(
    ("code", "rule", "want"),
    [
        ("H20", "THIRD_FRIDAY_CONTRACT_MONTH", "2020-03-20"),
        ("M20", "THREE_BUSINESS_DAYS_BEFORE_25TH_PRIOR_MONTH", "2020-05-19"),
        ("G15", "THIRD_LAST_BUSINESS_DAY_CONTRACT_MONTH", "2015-02-25"),
        ("H20", "TWO_BUSINESS_DAYS_PRIOR_THIRD_WEDNESDAY", "2020-03-16"),
        ("N20", "LAST_BUSINESS_DAY_PRIOR_MONTH", "2020-06-30"),
        ("X20", "LAST_THURSDAY_SPECIAL_RULE", "2020-11-19"),
    ],
)
def test_expiry(spark, code, rule, want):
    c = spark.createDataFrame([(code, rule, "Energy")], "code string, rule string, asset_class string")
    assert cal.expirations(c, cal.calendar_table(spark, 2014, 2021)).first()["expiry"] == day(want)


def test_bad_codes(spark):
    for code, rule in (("?20", "BUSINESS_DAY_PRIOR_15TH"), ("H", "BUSINESS_DAY_PRIOR_15TH"), ("H20", "NO_RULE")):
        c = spark.createDataFrame([(code, rule, "Energy")], "code string, rule string, asset_class string")
        with pytest.raises(Exception):
            cal.expirations(c, cal.calendar_table(spark, 2019, 2021)).collect()


def test_last_traded(spark):
    days = spark.createDataFrame([(day("2020-01-03"),), (day("2020-01-07"),)], "d date")
    asks = spark.createDataFrame([(day("2020-01-06"),), (day("2020-01-01"),)], "day date")
    got = {r.day: r.last_traded for r in cal.last_traded(None, days, asks).collect()}
    assert got == {day("2020-01-06"): day("2020-01-03"), day("2020-01-01"): day("2020-01-01")}
