"""Query registry: a Spark callable and, where SQL can say it, the oracle for the same tables."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import configure
from .fixtures import SQL_VIEWS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def compose(sql: str) -> str:
    """Put the SQL twins of the derived views a statement reads in front of it."""
    body = sql.strip()
    own = ""
    m = re.match(r"with\s+(recursive\s+)?", body, re.I)
    if m:
        own, body = body[m.end():], ""
    text = own or body
    needed: list[str] = []

    def visit(fragment: str) -> None:
        for view, definition in SQL_VIEWS.items():
            if view not in needed and re.search(rf"\b{view}\b", fragment):
                visit(definition)
                if view not in needed:
                    needed.append(view)

    visit(text)
    ctes = ", ".join(f"{v} AS ({SQL_VIEWS[v]})" for v in needed)
    if own:
        return f"WITH RECURSIVE {ctes + ', ' if ctes else ''}{own}"
    return f"WITH {ctes} {body}" if ctes else body


def query(name: str, sql: str | None = None):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(configure(spark), sf_dir)

        run.__name__, run.__doc__ = fn.__name__, fn.__doc__
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = compose(sql)
        return fn

    return register
