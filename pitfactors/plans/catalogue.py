"""Registry of runnable queries and the DuckDB SQL that checks them.

The SQL names domain views (``bars``, ``income``, …); the views a statement uses are put
in front of it as common table expressions.  ``digits`` lists double columns as
``"name"`` (six places) or ``"name:places"``; both sides are rounded alike.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitfactors import ship
from pitfactors.plans.oracle_views import VIEWS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, digits: str = "", views: dict[str, str] | None = None):
    places = _places(digits)

    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            df = fn(spark, sf_dir)
            return df.withColumns({c: rounded(c, n) for c, n in places.items()}) if places else df

        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = statement(sql, places, views or {})
        return fn

    return register


def statement(sql: str, places: dict[str, int], extra: dict[str, str]) -> str:
    known = {**VIEWS, **extra}
    order: list[str] = []
    active: set[str] = set()

    def visit(text: str) -> None:
        for view, body in known.items():
            if view in order or view in active or not re.search(rf"\b{view}\b", text):
                continue
            active.add(view)
            visit(body)
            active.discard(view)
            order.append(view)

    visit(sql)
    head = ",\n".join(f"{v} AS ({known[v]})" for v in order)
    head = f"WITH RECURSIVE {head}\n" if order else ""
    replace = ", ".join(f"floor({c}::DOUBLE * 1e{n} + 0.5) / 1e{n} AS {c}" for c, n in places.items())
    body = f"SELECT * REPLACE ({replace}) FROM ({sql}) AS answer" if replace else sql
    return head + body


def rounded(c: str, places: int):
    """Round half up in binary arithmetic that every engine repeats bit for bit."""
    return F.floor(F.col(c).cast("double") * F.lit(10.0**places) + 0.5) / F.lit(10.0**places)


def _places(digits: str) -> dict[str, int]:
    out = {}
    for item in digits.split():
        name, _, n = item.partition(":")
        out[name] = int(n or 6)
    return out
