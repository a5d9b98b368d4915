from __future__ import annotations

import datetime as dt
import os
import time
import zipfile

import duckdb
import pytest
import yaml
from pyspark.sql import functions as F

from tidemark import config, refresh
from tidemark.functions import strings
from tidemark.operators import planner
from tidemark.plans import trading
from tidemark.sources import files, html, rest

INSTRUMENTS = """
templates:
  fut: {type: futures, tradingStart: "-06:00:00", tradingEnd: "17:00:00", intervals: ["30m"], startDate: "2020-01-01", daysOfWeek: [0, 1, 2, 3, 4],
    rolloverTime: "15:30:00", rolloverVolAlpha: 0.5, rolloverMaxDays: 15, tradedMonths: FGHJKMNQUVXZ}
instruments:
  CL: {template: fut, symbol: CL, contractMultiplier: 1000, tickSize: 0.01, assetClass: Energy, removeDates: ["2020-04-02", "2020-04-21"]}
  EQ: {type: stock, symbol: EQ, tradingStart: "09:30:00", tradingEnd: "16:00:00", intervals: ["1m"]}
"""
BROKERS = "B: {name: Broker, defaults: {margin: 5}, instruments: {CL: {instrumentSymbol: CL, brokerSymbol: CL, commission: 0.5, referencePrice: 20.0}}}"


@pytest.fixture
def conf(tmp_path):
    (tmp_path / "i.yml").write_text(INSTRUMENTS)
    (tmp_path / "b.yml").write_text(BROKERS)
    return config.Config(tmp_path / "i.yml", tmp_path / "b.yml")


def test_config(conf):
    i = conf.instrument("CL", "30m")
    assert (i.total_steps, i.end_time, i.rollover_offset) == (46, 81000, 77400) and len(i.remove_dates) == 2
    h = conf.instrument("CL", "1h", "F24")
    assert (h.total_steps, h.file_symbol, h.type, h.parent.interval) == (23, "CL-F24", "futures_individual", "30m")
    t = conf.traded("B", "CL", "30m", None)
    assert (t.broker.margin, t.broker.commission, t.broker.broker_symbol) == (5, 0.5, "CL")
    for bad in (lambda: conf.instrument("CL", "45m"), lambda: conf.instrument("EQ", "1m", "F24"), lambda: conf.instrument("CL", "7x")):
        with pytest.raises(ValueError):
            bad()
    for bad in (lambda: conf.traded("B", "EQ", "1m"), lambda: conf.broker("C"), lambda: conf.instrument("ZZ", "1m")):
        with pytest.raises(KeyError):
            bad()
    assert not conf.reload()
    conf.paths[0].write_text(INSTRUMENTS.replace("1000", "999"))
    os.utime(conf.paths[0], (time.time() + 5,) * 2)
    assert conf.reload() and conf.instrument("CL", "30m").contract_multiplier == 999


def test_minutes_of_a_session():
    i = config.Instrument("X", "1m", trading_start=-21600, trading_end=61200)
    assert i.total_steps == 1380
    with pytest.raises(ValueError):
        config.Instrument("X", "1m", trading_end=3600, rollover_time=7200)


CALLS: list = []


def fetch(symbol, code=None, **_):
    CALLS.append(("fetch", symbol, code))
    with open(f"{os.environ['TM_TMP']}/mid/{symbol}-{code}.txt", "w") as f:
        f.write("x")


def expand(symbol, **_):
    return [{"code": "A"}, {"code": "B"}]


def combine(symbol, codes, **_):
    CALLS.append(("combine", symbol, codes))
    with open(f"{os.environ['TM_TMP']}/out/{symbol}.txt", "w") as f:
        f.write("x")


def test_refresh(tmp_path, monkeypatch):
    monkeypatch.setenv("TM_TMP", str(tmp_path))
    CALLS.clear()
    for d in ("mid", "out"):
        (tmp_path / d).mkdir()
    here = __name__
    mid, out = f"file:{tmp_path}/mid/{{symbol}}-{{code}}.txt", f"file:{tmp_path}/out/{{symbol}}.txt"
    rules = {
        "dependency_rules": [
            {"dependent": mid, "refresh_function": f"{here}.fetch", "no_cleanup": True},
            {"dependent": out, "depends_on": [{"pattern": mid, "expansion_function": f"{here}.expand"}], "refresh_function": {"name": f"{here}.combine", "list_args": {"codes": "code"}}},
        ]
    }
    r = refresh.Refresher(rules)
    url = f"file:{tmp_path}/out/S.txt"
    r.refresh(url)
    assert CALLS == [("fetch", "S", "A"), ("fetch", "S", "B"), ("combine", "S", ["A", "B"])]
    assert len(r.dependencies(url)) == 2 and r.newest_dependency(url) is not None
    again = refresh.Refresher(rules)
    assert again.up_to_date(url)
    again.refresh(url)
    assert len(CALLS) == 3
    os.utime(tmp_path / "mid" / "S-A.txt", (time.time() + 9,) * 2)
    assert not refresh.Refresher(rules).up_to_date(url)
    with pytest.raises(ValueError):
        r.node("file:/nothing")


def test_patterns():
    assert refresh.match("s3:{source}/{kind}/{symbol}-{code}.zip", "s3:raw/x/CL-F24.zip") == {"source": "raw", "kind": "x", "symbol": "CL", "code": "F24"}
    assert refresh.match("file:{a:[0-9]+}/{a}", "file:12/12") == {"a": "12"} and refresh.match("file:{a:[0-9]+}/{a}", "file:12/13") is None
    assert refresh.substitute("x/{a}/{b}", {"a": "1"}, partly=True) == "x/1/{b}" and refresh.literal_prefix("x/{a}") == "x/"
    with pytest.raises(ValueError):
        refresh.substitute("{b}", {})
    assert refresh.where_matches([{"type": "foo"}, {"interval": ["1m", "5m"]}], {"type": "foo", "interval": "5m"})
    assert not refresh.where_matches({"type": "bar"}, {"type": "foo"})


# a kettle: the valve has three positions, water rises step by step, the heater needs a lid that is shut
KETTLE = """
goals: [tea_ready, "level_eq_2"]
initial: [valve_eq_shut, level_eq_0, lid_open, cold]
actions:
  - {name: open_valve, var_precond: ["valve == shut"], set: [[valve, full]]}
  - {name: fill_one, var_precond: ["valve != shut", "level == 0"], set: [[level, 1]]}
  - {name: fill_two, var_precond: ["valve != shut", "level >= 1", "level <= 1"], set: [[level, 2]]}
  - {name: shut_lid, preconds: [lid_open], add: [lid_shut], del: [lid_open]}
  - {name: heat, preconds: [lid_shut], neg_preconds: [dry], var_precond: ["level == 2"], add: [hot], del: [cold]}
  - {name: brew, preconds: [hot], add: [tea_ready]}
variables:
  valve: {type: enum, values: [shut, half, full]}
  level: {type: int, min_value: 0, max_value: 2}
"""


def problem(initial, goals, **actions):
    return planner.Problem.load({"initial": initial.split(), "goals": goals.split(), "actions": [{"name": n, **what} for n, what in actions.items()]})


def test_planner_orders_what_depends_on_each_other():
    steps = planner.plan(planner.Problem.load(yaml.safe_load(KETTLE)))
    at = {a: i for i, step in enumerate(steps) for a in step}
    order = ["open_valve", "fill_one", "fill_two", "heat", "brew"]
    assert [at[a] for a in order] == sorted(at[a] for a in order) and len(steps) == 5
    assert at["shut_lid"] < at["heat"]


def test_planner_gives_up_a_first_choice():
    # the quick way to the boat burns the bridge that the other goal needs
    crossing = problem("shore bridge timber", "boat far_side", burn={"preconds": ["timber"], "add": ["boat"], "del": ["bridge"]}, build={"preconds": ["timber"], "add": ["boat"]},
                       walk={"preconds": ["bridge"], "add": ["far_side"], "del": ["timber"]}, run={"preconds": ["bridge"], "add": ["far_side"]})
    (step,) = planner.plan(crossing)
    assert sorted(step) == ["build", "run"]


def test_planner_takes_either_key():
    door = {"open": {"preconds": [["brass_key", "steel_key"], ["hand", "glove", "tongs"]], "add": ["inside"]}}
    for held in ("steel_key tongs", "brass_key glove"):
        (step,) = planner.plan(problem(held, "inside", **door))
        assert len(step) == 1 and step[0].startswith("open")
    with pytest.raises(planner.Unreachable):
        planner.plan(problem("steel_key", "inside", **door))


def trade_row(symbol, kind, date, times, status, risk, pnl):
    cell = lambda name, *spans: f'<div class="cell {name}">' + "".join(f"<span>{s}</span>" for s in spans) + "</div>"
    when = f'<div class="cell closeTime"><div class="clip">{date}</div><div class="clip">{times}</div></div>'
    who = f'<div class="cell symbol"><div class="clip"><span class="sym">{symbol}</span><span>{kind}</span></div></div>'
    return f'<row><bd>{who}{when}<div class="cell status"><span class="lbl">{status}</span></div>{cell("risk", risk)}{cell("pnl", pnl)}</bd></row>'


def test_trade_logs(spark):
    rows = [trade_row("QQQ", "Put Spread", "Mar 3, 2021", "9:45am → 12:30pm", "Closed", "$1,205", "$88"), trade_row("IWM", "Iron Butterfly", "Mar 4, 2021", "11:05am → 3:59pm", "Expired", "$64", "-$64")]
    read = lambda page: html.trade_log(spark.createDataFrame([(f"<grid>{page}<row></row></grid>",)], "html string")).collect()
    assert sorted(tuple(r) for r in read("".join(rows))) == [
        (dt.date(2021, 3, 3), "QQQ", "Put Spread", 585, 750, "Closed", 1205.0, 88.0), (dt.date(2021, 3, 4), "IWM", "Iron Butterfly", 665, 959, "Expired", 64.0, -64.0),
    ]
    with pytest.raises(Exception, match="date comes twice"):
        read(rows[0] * 2)


def test_filter_logs(spark, tmp_path):
    entry = lambda date, what: f'<div class="flex"><div style="width:12rem;">{date}</div><div style="flex:1;">{what}</div></div>'
    (tmp_path / "CPI_DAYS.txt").write_text('<div class="list">' + entry("Aug 10, 2021", "Consumer prices") + entry("soon", "nothing yet") + entry("Sep 14, 2021", "Consumer prices") + "</div>")
    (tmp_path / "HALF_DAYS.txt").write_text(entry("Nov 26, 2021", "Early close"))
    got = {tuple(r) for r in html.read_filter_files(spark, str(tmp_path)).collect()}
    assert got == {("CPI_DAYS", dt.date(2021, 8, 10), "Consumer prices", ""), ("CPI_DAYS", dt.date(2021, 9, 14), "Consumer prices", ""), ("HALF_DAYS", dt.date(2021, 11, 26), "Early close", "")}


def test_contract_pages(spark):
    page = lambda *cells: "<table>" + "".join(f"<tr><td>{n}</td><td>{v}</td></tr>" for n, v in cells) + "</table>"
    pages = [page(("Contract Size", "5,000 bushels"), ("Expiration Date", "07/14/2023"), ("First Notice Date", "06/30/2023")), page(("Expiration Date", "12/18/2023")), "", None]
    got = [tuple(r) for r in html.contract_dates(spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "i int, html string").select("html")).select("first_notice", "expiration").collect()]
    assert got == [(dt.date(2023, 6, 30), dt.date(2023, 7, 14)), (None, dt.date(2023, 12, 18)), (None, None), (None, None)]


def test_texts(spark):
    d = spark.createDataFrame([("-$1,234.50", "Gap: -0.5", "3:47pm"), ("x", None, "none")], "m string, g string, t string")
    got = d.select(strings.dollars(F.col("m")), strings.metric(F.col("g"), "gap"), strings.minutes_of_day(F.col("t"))).collect()
    assert [tuple(r) for r in got] == [(-1234.5, -0.5, 947), (0.0, None, None)]


def test_files(spark, tmp_path):
    text = "01/02/2020,18:00:00,1,2,0.5,1.5,7\n"
    with zipfile.ZipFile(tmp_path / "x.zip", "w") as z:
        z.writestr("x.csv", text.replace("01/02/2020", "2020-01-02"))
    r = files.read_bars(spark, str(tmp_path / "x.zip"), zipped=True).first()
    assert (r.ts, r.close, r.volume) == (dt.datetime(2020, 1, 2, 18), 1.5, 7)
    q = tmp_path / "q.csv"
    q.write_text("Date,Time,Bid,Ask,Price,Size\n1,a,1.25,2,1.5,10\n1,a,1,3,2.5,30\n1,b,1,3,2,0\n")
    assert files.most_decimals(spark, str(q)) == 2 and files.line_count(spark, str(q)) == 4
    files.aggregate_quotes(spark, str(q), str(tmp_path / "out"))
    got = {r.Time: r for r in spark.read.option("header", True).option("inferSchema", True).csv(str(tmp_path / "out")).collect()}
    assert (got["a"].vwap, got["a"].Bid_open, got["a"].Ask_high, got["b"].vwap) == (2.25, 1.25, 3, 2)
    s = files.HadoopStore(spark, f"file://{tmp_path}/store")
    s.put(str(q), "a/q.csv")
    assert s.exists("a/q.csv") and s.list("a/") == ["a/q.csv"] and s.mtime("a/q.csv")
    s.rename("a/q.csv", "b/q.csv")
    s.get("b/q.csv", str(tmp_path / "copy.csv"))
    s.remove("b/q.csv")
    assert not s.exists("b/q.csv") and s.mtime("b/q.csv") is None and (tmp_path / "copy.csv").exists()
    with pytest.raises(ValueError):
        files.url("s3", "raw", "futures", "1m", "CL", ".txt")
    assert files.parse_repository_url("github:o/r/a/b.yml") == ("o", "r", "a/b.yml")
    with pytest.raises(ValueError):
        files.parse_repository_url("github:o/r")
    b = spark.createDataFrame([(1, 0, 1, 0, 1.0, 1.0, 1.0, 1.0, 1)], files.BARS)
    files.write_bars(b, str(tmp_path / "bars"))
    assert spark.read.parquet(str(tmp_path / "bars")).collect() == b.collect()


def test_rest(spark, tmp_path):
    assert len(rest.ENDPOINTS) == 53
    path, query = rest.request("option_list_contracts", {"request_type": "trade", "symbol": "S", "expiration": "20240101"})
    assert path == "/option/list/contracts/trade" and query == {"symbol": "S", "expiration": "20240101", "right": "both", "strike": "*", "format": "csv"}
    for bad in (("stock_history_eod", {"symbol": "S"}, "csv"), ("nothing", {}, "csv"), ("stock_list_symbols", {}, "xml")):
        with pytest.raises(ValueError):
            rest.request(*bad)
    seen = []
    c = rest.Client(transport=lambda base, path, q: seen.append((path, q)) or '[{"a": 1}]')
    assert c.stock_snapshot_quote("json", symbol="X")["a"].tolist() == ["1"] and seen[0][1]["venue"] == "nqb"
    assert rest.parse("", "csv") == [] and rest.parse("a,b\n1,2\n", "csv") == [{"a": "1", "b": "2"}]
    for s, close in (("X", "1.5"), ("Y", "2.5")):
        (tmp_path / f"stock_history_eod_{s}.csv").write_text(f"date,close\n20240102,{close}\n")
    d = rest.read(spark, "stock_history_eod", "date string, close double", symbol="X,Y", start_date="20240101", end_date="20240131", fixtures=str(tmp_path))
    assert sorted(r.close for r in d.collect()) == [1.5, 2.5]


def test_titles_keep_references_that_are_cut_off(spark, tmp_path):
    titles = ["ver&amp;&amp", "a &copy; b&lt", "x &amp;lt; &quot;y&quot;\n z\u00a0", "a<b>c</b>", "&#65;&lt;i&gt;"]
    made = spark.createDataFrame([(i, f"<html><title>{t}</title><a href='/?a&b'>l</a></html>") for i, t in enumerate(titles)] + [(9, None)], "page_id long, html string")
    made.write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted(map(tuple, trading.html_parse(spark, str(tmp_path)).select("page_id", "n_links", "n_tags", "title").collect()))
    duck = duckdb.connect()
    duck.sql(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    assert got == sorted(duck.sql(f"select page_id, n_links, n_tags, title from ({trading.ORACLES['html_parse']})").fetchall())
    assert got[0][3] == "ver&&amp"
