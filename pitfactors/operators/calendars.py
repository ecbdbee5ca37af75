"""Trading calendars and walk-forward windows.  A calendar holds one row per date."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Trading rows per horizon unit.
HORIZON_ROWS = {"d": 1, "w": 5, "m": 21, "y": 252}
#: Calendar days per duration unit.
DURATION_DAYS = {"y": 365, "m": 30, "w": 7, "d": 1}
UNITS = {"y": "y", "yr": "y", "year": "y", "years": "y", "m": "m", "mo": "m", "month": "m", "months": "m",
         "w": "w", "wk": "w", "week": "w", "weeks": "w", "d": "d", "day": "d", "days": "d"}


def calendar(bars: DataFrame) -> DataFrame:
    """Distinct dates with their 1-based position; the one unpartitioned window is here."""
    dates = bars.select("date").distinct()
    return dates.withColumn("idx", F.row_number().over(Window.orderBy("date")))


def date_array(dates: DataFrame):
    """All dates of a calendar as one sorted array (a scalar subquery).

    Duplicates go in a shuffled ``distinct`` first, so the one collecting task receives
    each date once.
    """
    return dates.select("date").distinct().agg(F.sort_array(F.collect_list("date")).alias("dates")).scalar()


def month_starts(dates: DataFrame) -> DataFrame:
    """First trading date of every month."""
    return dates.groupBy(F.trunc("date", "month").alias("month")).agg(F.min("date").alias("date")).select("date")


def spaced(dates: DataFrame, min_days: int) -> DataFrame:
    """First date, then every date at least ``min_days`` after the previous pick."""
    ordered = dates.select("date").distinct().agg(F.sort_array(F.collect_list("date")).alias("d"))
    empty = F.array().cast("array<date>")
    picked = F.aggregate(
        "d",
        empty,
        lambda acc, x: F.when(
            (F.size(acc) == 0) | (F.datediff(x, F.element_at(acc, -1)) >= min_days), F.concat(acc, F.array(x))
        ).otherwise(acc),
    )
    guarded = F.when(F.size("d") > 0, picked)
    return ordered.select(F.explode(guarded).alias("date"))


def trading_rows(horizon: str | int) -> int:
    """``'21d'``, ``'3m'``, ``'12m'`` → number of trading rows."""
    if isinstance(horizon, int):
        return horizon
    found = re.fullmatch(r"\s*(\d+)\s*([dwmy])\s*", horizon.lower())
    if not found:
        raise ValueError(f"bad horizon {horizon!r}")
    return int(found[1]) * HORIZON_ROWS[found[2]]


def duration_days(text: str) -> int | None:
    """``'1y'``, ``'6m'``, ``'90d'``, ``'3mo'``, ``'2w'`` → calendar days."""
    found = re.fullmatch(r"(\d+)\s*([a-z]+)", text.strip().lower())
    if not found or found[2] not in UNITS:
        return None
    return int(found[1]) * DURATION_DAYS[UNITS[found[2]]]


def calendar_to_rows(days: int) -> int:
    """Calendar days → trading rows."""
    return max(1, round(days * 5 / 7))


def add_months(day: dt.date, n: int) -> dt.date:
    month = day.month - 1 + n
    year, month = day.year + month // 12, month % 12 + 1
    last = (dt.date(year + month // 12, month % 12 + 1, 1) - dt.timedelta(days=1)).day
    return dt.date(year, month, min(day.day, last))


def shift(day: dt.date, text: str) -> dt.date:
    """Move a date by ``'2y'``, ``'6m'``, ``'3w'`` or ``'10d'``."""
    found = re.fullmatch(r"(-?\d+)\s*([ymwd])[a-z]*", text.strip().lower())
    if not found:
        raise ValueError(f"bad duration {text!r}")
    n, unit = int(found[1]), found[2]
    if unit in "ym":
        return add_months(day, n * (12 if unit == "y" else 1))
    return day + dt.timedelta(days=n * (7 if unit == "w" else 1))


def walk_forward(start: dt.date, end: dt.date, window: str, overlap: str) -> list[tuple[str, dt.date, dt.date]]:
    """Windows of equal length; each starts ``overlap`` before the previous one ends."""
    out, first = [], start
    while shift(first, window) <= end:
        last = shift(first, window)
        out.append((f"w{len(out) + 1}", first, last))
        step = shift(last, f"-{overlap}")
        if step <= first:
            raise ValueError("overlap must be shorter than the window")
        first = step
    return out


def in_windows(df: DataFrame, windows: list[tuple[str, dt.date, dt.date]]) -> DataFrame:
    """Rows repeated for every window that holds their date (``label``, ``start``, ``end``)."""
    spans = F.array(*[F.struct(F.lit(n).alias("label"), F.lit(a).alias("start"), F.lit(b).alias("end")) for n, a, b in windows])
    inside = F.filter(spans, lambda w: (F.col("date") >= w["start"]) & (F.col("date") <= w["end"]))
    return df.select("*", F.inline(inside))
