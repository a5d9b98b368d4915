"""The refresh engine: which tables depend on which, and which job makes a stale one.

Rules are ordered; the first whose pattern and ``where`` fit a URL applies. The graph is metadata on
the driver, each node's job is a Spark job.
"""

from __future__ import annotations

import importlib
import os
import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from functools import lru_cache
from pathlib import Path

_NAME = re.compile(r"\{(\w+)(?::([^{}]+))?\}")


def pattern_to_regex(pattern: str) -> re.Pattern[str]:
    """``{name}`` stands for anything but a slash, ``{name:regex}`` for what the regex says; a name
    that comes again must stand for the same."""
    out, at, seen = "", 0, set()
    for m in _NAME.finditer(pattern):
        name, own = m.groups()
        out += re.escape(pattern[at : m.start()])
        out += f"(?P={name})" if name in seen else f"(?P<{name}>{own or '[^/]+?'})"
        seen.add(name)
        at = m.end()
    return re.compile(out + re.escape(pattern[at:]) + r"\Z")


def literal_prefix(pattern: str) -> str:
    return pattern.partition("{")[0]


def match(pattern: str, url: str) -> dict[str, str] | None:
    found = pattern_to_regex(pattern).match(url)
    return found.groupdict() if found else None


def substitute(pattern: str, values: dict[str, str], partly: bool = False) -> str:
    def fill(m: re.Match) -> str:
        if m[1] in values:
            return str(values[m[1]])
        if partly:
            return m[0]
        raise ValueError(f"no value for {m[1]} in {pattern}")

    return _NAME.sub(fill, pattern)


def where_matches(where, values: dict[str, str]) -> bool:
    """All of the conditions: a value, or a list that holds the value."""
    parts = [where] if isinstance(where, dict) else list(where or [])
    return all(
        values.get(k) in ([str(x) for x in want] if isinstance(want, list) else [str(want)]) for p in parts for k, want in p.items()
    )


@lru_cache(maxsize=None)
def import_function(name: str) -> Callable:
    module, _, attribute = name.rpartition(".")
    return getattr(importlib.import_module(module), attribute)


class Store:
    """Files by URL ``scheme:path``; other schemes by an object with exists, mtime, remove, list."""

    def __init__(self, schemes: dict[str, object] | None = None):
        self.schemes, self._cache = schemes or {}, {}

    def _split(self, url: str) -> tuple[str, str]:
        scheme, _, path = url.partition(":")
        return scheme, path

    def exists(self, url: str) -> bool:
        return self.mtime(url) is not None

    def mtime(self, url: str) -> float | None:
        if url not in self._cache:
            scheme, path = self._split(url)
            if scheme == "file":
                self._cache[url] = os.stat(path).st_mtime_ns / 1e9 if os.path.exists(path) else None
            else:
                self._cache[url] = self.schemes[scheme].mtime(path)
        return self._cache[url]

    def remove(self, url: str) -> None:
        scheme, path = self._split(url)
        self._cache.pop(url, None)
        if scheme == "file":
            Path(path).unlink(missing_ok=True)
        else:
            self.schemes[scheme].remove(path)

    def list(self, prefix: str) -> Iterable[str]:
        scheme, path = self._split(prefix)
        if scheme != "file":
            return [f"{scheme}:{p}" for p in self.schemes[scheme].list(path)]
        base = Path(path if os.path.isdir(path) else os.path.dirname(path))
        return [f"file:{p}" for p in base.rglob("*") if p.is_file() and str(p).startswith(path)]

    def forget(self, url: str) -> None:
        self._cache.pop(url, None)


@dataclass
class Node:
    url: str
    values: dict[str, str]
    job: object = None
    extra: dict = field(default_factory=dict)
    list_args: dict[str, str] = field(default_factory=dict)
    job_needs: list[str] = field(default_factory=list)
    keep: bool = False
    needs: list[str] = field(default_factory=list)


class Refresher:
    def __init__(self, rules: dict, store: Store | None = None):
        self.rules, self.store = rules, store or Store()
        self.nodes: dict[tuple[str, str], Node] = {}
        self._fresh: dict[str, bool] = {}
        self._made: list[str] = []

    # ---- graph

    def node(self, url: str, kind: str = "dependency_rules") -> Node:
        """The node of the first rule that fits, with what it directly needs."""
        if (kind, url) in self.nodes:
            return self.nodes[(kind, url)]
        for rule in self.rules.get(kind) or []:
            values = match(rule["dependent"], url)
            if values is None or not where_matches(rule.get("where"), values):
                continue
            n = Node(url, values, keep=bool(rule.get("no_cleanup")))
            f = rule.get("refresh_function")
            if isinstance(f, dict):
                n.job, n.extra, n.list_args = f["name"], f.get("additional_args") or {}, f.get("list_args") or {}
                n.job_needs = [substitute(x, values) for x in f.get("depends_on") or []]
            else:
                n.job = f
            self.nodes[(kind, url)] = n
            for entry in rule.get("depends_on") or []:
                n.needs += [u for u in self.expand(entry, values) if u not in n.needs]
            return n
        raise ValueError(f"no rule for {url}")

    def expand(self, entry, values: dict[str, str]) -> list[str]:
        """URLs of one entry: a pattern, or one with names filled from a function or a listing."""
        if isinstance(entry, str):
            return [substitute(entry, values)]
        pattern = substitute(entry["pattern"], values, partly=True)
        if "wildcard_expansion" in entry:
            like = substitute(entry["wildcard_expansion"], values, partly=True)
            found = [match(like, u) for u in self.store.list(literal_prefix(like))]
            return sorted({substitute(pattern, values | f) for f in found if f is not None})
        f = entry["expansion_function"]
        name = f if isinstance(f, str) else f["name"]
        for need in [] if isinstance(f, str) else f.get("depends_on") or []:
            self.refresh(substitute(need, values), top=False)
        got = import_function(name)(**values | ({} if isinstance(f, str) else f.get("additional_args") or {}))
        free = [m[1] for m in _NAME.finditer(pattern)]
        return [substitute(pattern, values | (x if isinstance(x, dict) else {free[0]: x})) for x in got]

    def dependencies(self, url: str) -> list[str]:
        return self.node(url).needs

    def newest_dependency(self, url: str, kind: str = "dependency_rules", scheme: str | None = None) -> float | None:
        times = [self.store.mtime(u) for u in self.node(url, kind).needs if scheme is None or u.startswith(f"{scheme}:")]
        return max((t for t in times if t is not None), default=None)

    # ---- freshness

    def up_to_date(self, url: str) -> bool:
        """It exists, all it needs is up to date, and it is strictly newer than each of that."""
        if url not in self._fresh:
            at = self.store.mtime(url)
            needs = self.node(url).needs
            ok = at is not None and all(self.up_to_date(u) for u in needs)
            self._fresh[url] = ok and all((self.store.mtime(u) or 0) < at for u in needs)
        return self._fresh[url]

    def refresh(self, url: str, reset: bool = False, top: bool = True) -> None:
        if not reset and self.up_to_date(url):
            return
        for u in self.node(url).needs:
            self.refresh(u, reset, top=False)
        self._fresh.pop(url, None)
        if not reset and self.up_to_date(url):
            return
        n = self._maker(url, reset)
        for u in n.job_needs:
            self.refresh(u, reset, top=False)
        if n.job is None:
            if not self.store.exists(url):
                raise FileNotFoundError(url)
        else:
            args = n.values | n.extra
            for name, of in n.list_args.items():
                found = [v[of] for u in n.needs for r in self.rules["dependency_rules"] if (v := match(r["dependent"], u)) and of in v]
                args[name] = list(dict.fromkeys(found))
            there = self.store.exists(url)
            job = import_function(n.job) if isinstance(n.job, str) else n.job
            job(**args)
            self.store.forget(url)
            if not self.store.exists(url):
                raise FileNotFoundError(f"{n.job} did not make {url}")
            if url.startswith("file:") and not there and not n.keep:
                self._made.append(url)
        self._fresh[url] = True
        if top:
            self.clean(keep=url)

    def _maker(self, url: str, reset: bool) -> Node:
        """The dependency rule's own job if it has one, else the refresh rules' node and its needs."""
        n = self.node(url)
        if n.job is not None or not any(match(r["dependent"], url) is not None and where_matches(r.get("where"), match(r["dependent"], url)) for r in self.rules.get("refresh_rules") or []):
            return n
        n = self.node(url, "refresh_rules")
        for u in n.needs:
            self.refresh(u, reset, top=False)
        return n

    def clean(self, keep: str | None = None) -> None:
        """Remove the files made on the way."""
        for u in self._made:
            if u != keep:
                self.store.remove(u)
        self._made = []
