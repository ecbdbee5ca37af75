"""Lookup queries: screens, searches, histories, dashboards, sandboxed SQL."""

from __future__ import annotations

import re
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pitfactors.functions.columns import between_dates, ratio

SORTABLE = ("market_cap", "symbol", "name", "sector", "industry")
DATE_COLUMNS = {"insider_trades": "transaction_date"}  # fixed value: date columns not called date
ROW_CAP, LEDGER_CAP = 500, 200  # fixed values: result caps of the sandbox and the ledger query


def prices(bars: DataFrame, symbol: str, start=None, end=None) -> DataFrame:
    return between_dates(bars.filter(F.col("symbol") == symbol), start, end).orderBy("date")


def screen(profiles: DataFrame, sector=None, industry=None, country=None, exchange=None, min_cap=None, max_cap=None, active=None) -> DataFrame:
    """Profiles that match all given filters; text compares without case."""
    for col, v in (("sector", sector), ("industry", industry), ("country", country), ("exchange", exchange)):
        if v is not None:
            profiles = profiles.filter(F.lower(col) == v.lower())
    if min_cap is not None:
        profiles = profiles.filter(F.col("market_cap") >= min_cap)
    if max_cap is not None:
        profiles = profiles.filter(F.col("market_cap") <= max_cap)
    return profiles if active is None else profiles.filter(F.col("active") == active)


def page(df: DataFrame, sort: str, descending: bool = True, limit: int = 50, offset: int = 0, tie: str = "symbol") -> DataFrame:
    """One page of a result with the total row count."""
    if sort not in SORTABLE:
        raise ValueError(f"cannot sort by {sort!r}")
    key = F.col(sort).desc_nulls_last() if descending else F.col(sort).asc_nulls_last()
    total = df.agg(F.count(F.lit(1))).scalar()
    return df.orderBy(key, tie).offset(offset).limit(limit).withColumn("total", total)


def search(profiles: DataFrame, text: str, limit: int = 20) -> DataFrame:
    """Symbol or name contains the text: exact symbol, then prefix, then the rest by size."""
    q = text.lower()
    sym, name = F.lower("symbol"), F.lower("name")
    hit = profiles.filter(sym.contains(q) | name.contains(q))
    order = F.when(sym == q, 0).when(sym.startswith(q), 1).otherwise(2)
    return hit.withColumn("match", order).orderBy("match", F.col("market_cap").desc_nulls_last(), "symbol").limit(limit)


def history(df: DataFrame, symbol: str, limit: int = 20, offset: int = 0) -> DataFrame:
    """Statements of one symbol, newest first."""
    return df.filter(F.col("symbol") == symbol).orderBy(F.desc("date")).offset(offset).limit(limit)


def events_of(df: DataFrame, symbol: str, kind_col: str, kinds: Sequence[str] = (), date: str = "date") -> DataFrame:
    """Insider trades by type or grades by action, newest first."""
    out = df.filter(F.col("symbol") == symbol)
    if kinds:
        out = out.filter(F.col(kind_col).isin(list(kinds)))
    return out.orderBy(F.desc(date))


def by_identifier(profiles: DataFrame, value: str) -> DataFrame:
    """Profile with that ISIN, CUSIP or CIK (padded to ten digits)."""
    v = F.lit(value)
    return profiles.filter((F.col("isin") == v) | (F.col("cusip") == v) | (F.col("cik") == F.lpad(v, 10, "0")))


def resolve_identifiers(values: DataFrame, profiles: DataFrame) -> DataFrame:
    """Bulk form: ``(value)`` joined to every kind of identifier."""
    ids = profiles.select("symbol", F.inline(F.array(
        F.struct(F.lit("isin").alias("kind"), F.col("isin").alias("id")), F.struct(F.lit("cusip").alias("kind"), F.col("cusip").alias("id")),
        F.struct(F.lit("cik").alias("kind"), F.col("cik").alias("id")))))
    padded = values.select("value", F.explode(F.array_distinct(F.array(F.col("value"), F.lpad("value", 10, "0")))).alias("id"))
    return padded.join(ids, "id").select("value", "kind", "symbol").distinct()


def row_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in tables.items():
        one = df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table"), "rows")
        out = one if out is None else out.unionByName(one)
    return out


def catalogue(macro: DataFrame) -> DataFrame:
    return macro.groupBy("series").agg(F.count(F.lit(1)).alias("rows"), F.min("date").alias("first"), F.max("date").alias("last"))


def macro_range(raw: DataFrame, derived: DataFrame, series: Sequence[str], start=None, end=None) -> DataFrame:
    """Values of several raw and derived series."""
    both = raw.select("date", "series", "value").withColumn("kind", F.lit("raw")).unionByName(
        derived.select("date", "series", "value").withColumn("kind", F.lit("derived")))
    return between_dates(both.filter(F.col("series").isin(list(series))), start, end)


def latest(macro: DataFrame) -> DataFrame:
    return macro.groupBy("series").agg(F.max("date").alias("date"), F.max_by("value", "date").alias("value"))


def dashboard(macro: DataFrame) -> DataFrame:
    """Latest value and change against 5 and 21 observations back (or the oldest there is)."""
    group = Window.partitionBy("series")
    r = macro.filter(F.col("value").isNotNull()).withColumns({
        "_i": F.row_number().over(group.orderBy(F.desc("date"))) - 1, "_n": F.count(F.lit(1)).over(group)})
    at = lambda k: F.max(F.when(F.col("_i") == F.least(F.lit(k), F.col("_n") - 1), F.col("value")))
    a = r.filter(F.col("_i") <= 21).groupBy("series").agg(at(0).alias("value"), at(5).alias("_w"), at(21).alias("_m"), F.max("_n").alias("_n"))
    many = F.col("_n") > 1
    change = lambda old: F.when(many, ratio(F.col("value") - F.col(old), F.abs(old)) * 100)
    return a.select("series", "value", change("_w").alias("change_1w"), change("_m").alias("change_1m"))


def ledger(trades: DataFrame, start=None, end=None, equal: Mapping[str, object] | None = None, min_pnl=None, max_pnl=None, cap: int = LEDGER_CAP) -> DataFrame:
    """Trades that pass the given filters, newest first, with a flag when the cap cut rows."""
    t = between_dates(trades, start, end)
    for c, v in (equal or {}).items():
        t = t.filter(F.col(c).isin(list(v)) if isinstance(v, (list, tuple, set)) else F.col(c) == v)
    if min_pnl is not None:
        t = t.filter(F.col("pnl") >= min_pnl)
    if max_pnl is not None:
        t = t.filter(F.col("pnl") <= max_pnl)
    order = [F.desc("date"), F.col("trade_key")]
    top = t.orderBy(*order).limit(cap + 1)  # the row beyond the cap tells whether it cut
    top = top.withColumns({"_i": F.row_number().over(Window.orderBy(*order)), "_n": F.count(F.lit(1)).over(Window.partitionBy())})
    return top.filter(F.col("_i") <= cap).withColumn("truncated", F.col("_n") > cap).drop("_i", "_n")


def with_features(trades: DataFrame, panel: DataFrame) -> DataFrame:
    """Trades with the feature snapshot of their date."""
    return trades.join(panel, ["symbol", "date"], "left")


def alert_feed(alerts: DataFrame, executions: DataFrame, deployments: DataFrame) -> DataFrame:
    """Alerts with their execution and deployment, if any."""
    return alerts.join(executions, "alert_id", "left").join(deployments, "book", "left")


def recall(claims: DataFrame, limit: int = 20, **equal) -> DataFrame:
    """Claims by filter, most promoted first, then newest."""
    for c, v in equal.items():
        claims = claims.filter(F.col(c) == v)
    return claims.orderBy(F.desc("promotions"), F.desc("created"), "id").limit(limit)


#: Leaves without stored rows: a select without FROM, literal rows, a name defined by WITH.
_HARMLESS = ("OneRowRelation", "LocalRelation", "ResolvedInlineTable", "UnresolvedInlineTable", "CTERelationRef")
_CODE = ("CallMethodViaReflection", "TryReflect")  # expressions that run foreign code


def _seq(items) -> list:
    return [items.apply(i) for i in range(items.size())]


def _kind(node) -> str:
    return node.getClass().getSimpleName().rstrip("$")


def _named(plan, known: set[str]) -> None:
    """Refuse a parsed statement that names anything but ``known`` relations, before a name is looked up anywhere."""
    if _kind(plan) == "UnresolvedWith":
        known = known | {str(c.alias()).lower() for c in _seq(plan.innerChildren())}
    if _kind(plan) == "UnresolvedRelation":
        parts = [str(x) for x in _seq(plan.multipartIdentifier())]
        if len(parts) != 1 or parts[0].lower() not in known:
            raise ValueError(f"no such table here: {'.'.join(parts)}")
    elif "TableValuedFunction" in _kind(plan):
        raise ValueError("table functions are not allowed")
    for inner in [*_seq(plan.children()), *_seq(plan.subqueries()), *(_seq(plan.innerChildren()) if _kind(plan) == "UnresolvedWith" else [])]:
        _named(inner, known)


def _expressions(e):
    yield e
    for c in _seq(e.children()):
        yield from _expressions(c)


def _allowed(plan, views: set[str]) -> None:
    """Refuse an analysed plan with a leaf that is not one of the given views."""
    if _kind(plan) == "View":
        if str(plan.desc().identifier().table()).lower() not in views:
            raise ValueError("only the given tables can be read")
        return
    for e in _seq(plan.expressions()):
        for x in _expressions(e):
            if _kind(x) in _CODE:
                raise ValueError("functions that call code are not allowed")
    below = _seq(plan.children())
    if not below and _kind(plan) not in _HARMLESS:
        raise ValueError(f"only the given tables can be read, not {_kind(plan)}")
    for inner in [*below, *_seq(plan.subqueries())]:
        _allowed(inner, views)


def sandbox(tables: Mapping[str, DataFrame], sql: str, stop, sectors: Sequence[str] | None = None, profiles: DataFrame | None = None, benchmarks: Sequence[str] = (), cap: int = ROW_CAP, dates: Mapping[str, str] | None = None) -> DataFrame:
    """Run read-only SQL on tables cut at a date and to permitted sectors; ``truncated`` tells whether the cap cut rows.

    A statement names its tables as ``{prices}``.  It can read these and nothing else: names
    are checked on the parsed statement before anything is looked up, and every leaf of the
    analysed plan must be a table that was passed.  Files, catalog tables, other views, table
    functions and functions that call code are refused, and so are commands: the statement
    must parse alone and again as a subquery, where the grammar has none.

    ``dates`` names the date column of tables that call it neither ``date`` nor as in
    ``DATE_COLUMNS``; tables without one are not cut.
    """
    named = {**DATE_COLUMNS, **(dates or {})}
    cut = {}
    for name, df in tables.items():
        day = named.get(name, "date")
        if day in df.columns:
            df = df.filter(F.col(day) <= F.lit(stop).cast("date"))
        elif name in named:
            raise ValueError(f"{name} has no column {day!r}")
        if sectors is not None and "symbol" in df.columns:
            ok = profiles.filter(F.col("sector").isin(list(sectors)) | F.col("symbol").isin(list(benchmarks))).select("symbol")
            df = df.join(ok, "symbol", "left_semi")
        cut[name] = df
    if not sql.lstrip().lower().startswith(("select", "with")):
        raise ValueError("only queries are allowed")
    unknown = {n for n in re.findall(r"\{(\w*)\}", sql)} - set(cut)
    if unknown:
        raise ValueError(f"no such table here: {', '.join(sorted(unknown))}")
    session = next(iter(tables.values())).sparkSession
    views = {name: f"sandbox_{uuid.uuid4().hex}" for name in cut}
    text = re.sub(r"\{(\w+)\}", lambda m: views[m[1]], sql)
    inner = set(views.values())
    try:
        for name, df in cut.items():
            df.createTempView(views[name])
        parser = session._jsparkSession.sessionState().sqlParser()
        _named(parser.parsePlan(text), inner)
        whole = f"SELECT * FROM (\n{text}\n) LIMIT {int(cap) + 1}"
        _named(parser.parsePlan(whole), inner)
        found = session.sql(whole)
        _allowed(found._jdf.queryExecution().analyzed(), inner)
    finally:
        for view in inner:
            session.catalog.dropTempView(view)
    # at most one row beyond the cap is here: it tells whether the cap cut
    return found.withColumn("truncated", F.count(F.lit(1)).over(Window.partitionBy()) > cap).limit(cap)


def score_series(panel: DataFrame, symbol: str) -> DataFrame:
    return panel.filter(F.col("symbol") == symbol).orderBy("date")
