"""Column helpers shared by every operator."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

COMPARISONS = {
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
}


def by_symbol(*extra: str) -> WindowSpec:
    """Bars of one symbol in date order; bounded by the length of the calendar."""
    return Window.partitionBy("symbol", *extra).orderBy("date")


def so_far(spec: WindowSpec | None = None) -> WindowSpec:
    """Frame from the first row to the current one."""
    return (spec or by_symbol()).rowsBetween(Window.unboundedPreceding, 0)


def rows(n_back: int, n_last: int = 0, spec: WindowSpec | None = None) -> WindowSpec:
    """Frame from ``n_back`` rows before to ``n_last`` rows before the current row."""
    return (spec or by_symbol()).rowsBetween(-n_back, -n_last)


def ratio(a: Column, b: Column) -> Column:
    """``a / b``; NULL when ``b`` is zero or either side is NULL."""
    return a / F.nullif(b, F.lit(0.0))


def positive(c: Column) -> Column:
    """``c`` where it is above zero, else NULL."""
    return F.when(c > 0, c)


def half_up(c: Column, places: int) -> Column:
    """Round half up in plain double arithmetic; used where rounding feeds logic."""
    scale = F.lit(10.0**places)
    return F.floor(c * scale + 0.5) / scale


def keep(c: Column, low: float, high: float) -> Column:
    """``c`` where it lies strictly between the bounds, else NULL."""
    return F.when((c > low) & (c < high), c)


def clip(c: Column, low, high) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def compare(c: Column, op: str, value) -> Column:
    if op not in COMPARISONS:
        raise ValueError(f"unknown operator {op!r}")
    return COMPARISONS[op](c, F.lit(value) if not isinstance(value, Column) else value)


def full(agg: Column, spec: WindowSpec, n: int, col: Column) -> Column:
    """Rolling aggregate that is NULL until the frame holds ``n`` non-null values."""
    return F.when(F.count(col).over(spec) == n, agg.over(spec))


def between_dates(df: DataFrame, start=None, end=None, col: str = "date") -> DataFrame:
    if start is not None:
        df = df.filter(F.col(col) >= F.lit(start).cast("date"))
    if end is not None:
        df = df.filter(F.col(col) <= F.lit(end).cast("date"))
    return df


def meta(**cols: Column) -> Column:
    """Metadata map ``string -> string`` of a signal; NULL values are left out."""
    pairs = [F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in cols.items()]
    return F.map_from_entries(F.filter(F.array(*pairs), lambda p: p["value"].isNotNull()))


def names(cols: str | Sequence[str]) -> list[str]:
    return [cols] if isinstance(cols, str) else list(cols)
