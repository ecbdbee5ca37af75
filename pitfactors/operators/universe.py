"""Universes and index membership on a date."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def in_sector(profiles: DataFrame, sector: str) -> DataFrame:
    """Symbols whose sector or industry equals the name, ignoring case."""
    name = sector.lower()
    return profiles.filter((F.lower("sector") == name) | (F.lower("industry") == name)).select("symbol").distinct()


def members_as_of(log: DataFrame, snapshot: DataFrame, day) -> DataFrame:
    """Members on a day: the snapshot with later changes undone.

    Per symbol only the earliest later event matters: added later means not yet in,
    removed later means still in.  On one day ``removed`` decides.
    """
    later = log.filter(F.col("event_date") > F.lit(day).cast("date"))
    tie = F.when(F.col("action") == "removed", 0).otherwise(1)
    first = later.groupBy("symbol").agg(F.min_by("action", F.struct("event_date", tie)).alias("next_action"))
    now = snapshot.select("symbol").distinct().withColumn("now", F.lit(True))
    merged = first.join(now, "symbol", "full")
    member = F.coalesce(F.col("next_action") == "removed", F.col("now"))
    return merged.filter(member).select("symbol")


def members_by_replay(log: DataFrame, day) -> DataFrame:
    """Members on a day by replaying the log forward: the last event is ``added``."""
    seen = log.filter(F.col("event_date") <= F.lit(day).cast("date"))
    tie = F.when(F.col("action") == "removed", 1).otherwise(0)
    last = seen.groupBy("symbol").agg(F.max_by("action", F.struct("event_date", tie)).alias("action"))
    return last.filter(F.col("action") == "added").select("symbol")


def ever_members(log: DataFrame, snapshot: DataFrame, start, end) -> DataFrame:
    """Symbols that were members at any time in ``[start, end]``."""
    inside = log.filter(F.col("event_date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    parts = [members_as_of(log, snapshot, start), members_as_of(log, snapshot, end), inside.select("symbol")]
    return reduce(DataFrame.union, parts).distinct()


def membership_spans(log: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Half-open membership intervals ``[start, end)``; NULL means open on that side.

    Between two consecutive events of a symbol the later one decides, after the last
    event the snapshot decides.
    """
    day = log.groupBy("symbol", "event_date").agg(F.max("action").alias("action"))  # removed > added
    w = Window.partitionBy("symbol").orderBy("event_date")
    until = day.select(
        "symbol",
        F.lag("event_date").over(w).alias("start"),
        F.col("event_date").alias("end"),
        (F.col("action") == "removed").alias("member"),
    )
    now = snapshot.select("symbol").distinct().withColumn("now", F.lit(True))
    tail = day.groupBy("symbol").agg(F.max("event_date").alias("start")).join(now, "symbol", "full")
    tail = tail.select("symbol", "start", F.lit(None).cast("date").alias("end"), F.coalesce("now", F.lit(False)).alias("member"))
    return until.union(tail).filter("member").drop("member")


def members_by_date(log: DataFrame, snapshot: DataFrame, dates: Column) -> DataFrame:
    """Membership on every date; ``dates`` is a sorted array (``calendars.date_array``)."""
    spans = membership_spans(log, snapshot)
    inside = F.filter(
        F.col("dates"),
        lambda d: (F.col("start").isNull() | (d >= F.col("start"))) & (F.col("end").isNull() | (d < F.col("end"))),
    )
    return spans.withColumn("dates", dates).select("symbol", F.explode(inside).alias("date"))


def members_only(facts: DataFrame, log: DataFrame, snapshot: DataFrame, date: str = "date") -> DataFrame:
    """Fact rows whose symbol was a member on their date (interval join on the symbol)."""
    spans = membership_spans(log, snapshot).select("symbol", F.col("start").alias("_from"), F.col("end").alias("_to"))
    j = facts.join(spans, "symbol")
    inside = (F.col("_from").isNull() | (F.col(date) >= F.col("_from"))) & (F.col("_to").isNull() | (F.col(date) < F.col("_to")))
    return j.filter(inside).drop("_from", "_to")


def resolve(
    kind: str,
    *,
    profiles: DataFrame | None = None,
    bars: DataFrame | None = None,
    log: DataFrame | None = None,
    snapshot: DataFrame | None = None,
    symbols: Sequence[str] = (),
    sectors: Sequence[str] = (),
    start=None,
    end=None,
    anchored: bool = False,
    exclude: Sequence[str] = (),
) -> DataFrame:
    """Universe of one kind: ``symbols``, ``sector``, ``index`` or ``all``."""
    if kind == "symbols":
        base = profiles if profiles is not None else bars
        out = base.filter(F.col("symbol").isin(list(symbols))).select("symbol").distinct()
    elif kind == "sector":
        wanted = [s.lower() for s in sectors]
        out = profiles.filter(F.lower("sector").isin(wanted) | F.lower("industry").isin(wanted)).select("symbol").distinct()
        if anchored:
            out = out.intersect(ever_members(log, snapshot, start, end))
    elif kind == "index":
        out = ever_members(log, snapshot, start, end)
    elif kind == "all":
        out = bars.select("symbol").distinct()
    else:
        raise ValueError(f"unknown universe {kind!r}")
    return out.filter(~F.col("symbol").isin(list(exclude))) if exclude else out


def merged(universes: Sequence[DataFrame]) -> DataFrame:
    """Union of sleeve universes."""
    return reduce(DataFrame.union, universes).distinct()


def missing(members: DataFrame, bars: DataFrame) -> DataFrame:
    """Members without any bar."""
    return members.select("symbol").distinct().join(bars.select("symbol").distinct(), "symbol", "left_anti")


def sector_counts(symbols: DataFrame, profiles: DataFrame) -> DataFrame:
    return symbols.join(profiles.select("symbol", "sector"), "symbol").groupBy("sector").agg(F.count(F.lit(1)).alias("n"))


def modal_sector(symbols: DataFrame, profiles: DataFrame) -> DataFrame:
    """Most common sector of a set, the alphabetically first on a tie."""
    best = F.min_by("sector", F.struct(-F.col("n"), "sector"))
    return sector_counts(symbols, profiles).agg(best.alias("sector"), F.max("n").alias("n"))
