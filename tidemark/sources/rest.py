"""A REST market-data source: endpoints as a table, a Python Data Source, fixtures instead of a network.

``spark.read.format("market_rest").option("endpoint", "stock_history_eod").option("symbol", "X")``.
The transport is the HTTP library of the standard distribution, or, with option ``fixtures``, files
named like the endpoint's path in a folder that the executors can read.
"""

from __future__ import annotations

import csv
import io
import json
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

BASE = "http://localhost:25503/v3"
TIMEOUT = 60
# Defaults that endpoints take where a parameter is left out.
DEFAULTS = {"right": "both", "strike": "*", "start_time": "09:30:00", "end_time": "16:00:00", "venue": "nqb", "exclusive": "true"}

_GREEKS = ("implied_volatility", "all", "first_order", "second_order", "third_order")


def _endpoints() -> dict[str, tuple[str, tuple[str, ...]]]:
    """Name to (path, parameters), built from the families that the endpoints come in."""
    out: dict[str, tuple[str, tuple[str, ...]]] = {}

    def put(path: str, *params: str) -> None:
        name = "_".join(p for p in path.strip("/").split("/") if not p.startswith("{"))
        out[name] = (path, params)

    session, contract = ("start_time", "end_time"), ("symbol", "expiration")
    chosen = ("right", "strike")
    put("/index/list/symbols")
    put("/index/list/dates", "symbol")
    for k in ("ohlc", "price"):
        put(f"/index/snapshot/{k}", "symbol")
    put("/index/history/eod", "symbol", "start_date", "end_date")
    put("/index/history/ohlc", "symbol", "start_date", "end_date", "interval", *session)
    put("/index/history/price", "symbol", "start_date", "end_date", *session)
    put("/index/at_time/price", "symbol", "date", "time")

    put("/option/list/symbols")
    put("/option/list/dates/{request_type}", "symbol")
    put("/option/list/expirations", "symbol")
    put("/option/list/strikes", *contract, "right")
    put("/option/list/contracts/{request_type}", *contract, *chosen)
    for k in ("ohlc", "trade", "quote", "open_interest", *(f"greeks/{g}" for g in _GREEKS)):
        put(f"/option/snapshot/{k}", *contract, *chosen)
    for k in ("eod", "open_interest", "greeks/eod"):
        put(f"/option/history/{k}", *contract, "start_date", "end_date", *chosen)
    for k in ("ohlc", *(f"greeks/{g}" for g in _GREEKS)):
        put(f"/option/history/{k}", *contract, "date", "interval", *chosen, *session)
    for k in ("trade", "quote", *(f"trade_greeks/{g}" for g in _GREEKS)):
        put(f"/option/history/{k}", *contract, "date", *chosen, *session)
    put("/option/history/trade_quote", *contract, "date", *chosen, *session, "exclusive")
    for k in ("trade", "quote"):
        put(f"/option/at_time/{k}", *contract, "date", "time", *chosen)

    put("/stock/list/symbols")
    put("/stock/list/dates/{request_type}", "symbol")
    for k in ("ohlc", "trade", "quote"):
        put(f"/stock/snapshot/{k}", "symbol", "venue")
    put("/stock/history/eod", "symbol", "start_date", "end_date", "venue")
    put("/stock/history/ohlc", "symbol", "date", "interval", *session, "venue")
    for k in ("trade", "quote"):
        put(f"/stock/history/{k}", "symbol", "date", *session, "venue")
    put("/stock/history/trade_quote", "symbol", "date", *session, "venue", "exclusive")
    for k in ("trade", "quote"):
        put(f"/stock/at_time/{k}", "symbol", "date", "time", "venue")
    return out


ENDPOINTS = _endpoints()


def request(endpoint: str, params: dict[str, str], output_format: str = "csv") -> tuple[str, dict[str, str]]:
    """The path and the query of an endpoint; missing parameters without a default are an error."""
    if output_format not in ("csv", "json"):
        raise ValueError(f"unknown format: {output_format}")
    if endpoint not in ENDPOINTS:
        raise ValueError(f"unknown endpoint: {endpoint}")
    path, names = ENDPOINTS[endpoint]
    if "{request_type}" in path:
        path = path.format(request_type=params["request_type"])
    query = {n: params.get(n, DEFAULTS.get(n)) for n in names}
    missing = [n for n, v in query.items() if v is None]
    if missing:
        raise ValueError(f"{endpoint} needs {', '.join(missing)}")
    return path, query | {"format": output_format}


def http(base: str, path: str, query: dict[str, str]) -> str:
    with urllib.request.urlopen(f"{base}{path}?{urllib.parse.urlencode(query)}", timeout=TIMEOUT) as r:
        return r.read().decode()


def parse(text: str, output_format: str) -> list[dict[str, str]]:
    """Rows of a CSV or JSON response as texts; blank or empty is no rows."""
    if output_format == "csv":
        return list(csv.DictReader(io.StringIO(text.strip()))) if text.strip() else []
    found = json.loads(text) if text.strip() else []
    found = found.get("response", found) if isinstance(found, dict) else found
    if isinstance(found, dict):  # columns of lists
        names = list(found)
        return [dict(zip(names, map(str, row))) for row in zip(*found.values())] if found else []
    return [{k: None if v is None else str(v) for k, v in row.items()} for row in found]


class Client:
    """The same on the driver, as pandas."""

    def __init__(self, base: str = BASE, transport: Callable[[str, str, dict], str] = http):
        self.base, self.transport = base, transport

    def get(self, endpoint: str, output_format: str = "csv", **params: str) -> pd.DataFrame:
        path, query = request(endpoint, params, output_format)
        return pd.DataFrame(parse(self.transport(self.base, path, query), output_format))

    def __getattr__(self, name: str):
        if name not in ENDPOINTS:
            raise AttributeError(name)
        return lambda output_format="csv", **params: self.get(name, output_format, **params)


class _Symbol(InputPartition):
    def __init__(self, symbol: str | None):
        self.symbol = symbol


class RestReader(DataSourceReader):
    """One task a symbol of a comma-separated list; rows come as the declared columns, as texts."""

    def __init__(self, schema, options: dict[str, str]):
        self.names, self.options = schema.fieldNames(), dict(options)

    def partitions(self):
        return [_Symbol(s.strip()) for s in self.options["symbol"].split(",")] if self.options.get("symbol") else [_Symbol(None)]

    def read(self, partition) -> Iterator[tuple]:
        form = self.options.get("output_format", "csv")
        params = {k: v for k, v in self.options.items() if k != "symbol"}
        if partition.symbol:
            params["symbol"] = partition.symbol
        path, query = request(self.options["endpoint"], params, form)
        folder = self.options.get("fixtures")
        if folder:
            name = "_".join([*path.strip("/").split("/"), *([partition.symbol] if partition.symbol else [])])
            with open(f"{folder}/{name}.{form}") as f:
                text = f.read()
        else:
            text = http(self.options.get("base", BASE), path, query)
        for row in parse(text, form):
            yield tuple(row.get(n) for n in self.names)


class RestSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "market_rest"

    def schema(self) -> str:
        raise ValueError("declare the endpoint's columns with .schema(), all as string")

    def reader(self, schema) -> RestReader:
        return RestReader(schema, self.options)


def read(spark: SparkSession, endpoint: str, columns: str, **options: str) -> DataFrame:
    """The endpoint's rows cast to ``columns``, a DDL string."""
    from pyspark.sql import functions as F
    from pyspark.sql.types import StructType

    want = StructType.fromDDL(columns)
    spark.dataSource.register(RestSource)
    raw = spark.read.format("market_rest").schema(", ".join(f"`{f.name}` string" for f in want)).option("endpoint", endpoint).options(**options).load()
    return raw.select(*[F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) for f in want])
