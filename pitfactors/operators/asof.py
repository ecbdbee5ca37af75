"""Point-in-time joins.

Two exact plans.  ``timeline`` unions both sides and carries the last right row forward
in one window per key: one shuffle, linear, right for panels that hold one row per key
and date.  ``interval`` turns the right side into validity ranges and range-joins on the
key; a hot key on the left is then split by the adaptive skew join, so it suits raw fact
rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitfactors.functions.columns import names


def last_per_date(right: DataFrame, on: Sequence[str], date: str, tie: str | None) -> DataFrame:
    """One right row per key and date: the largest ``tie`` wins."""
    if tie is None:
        return right
    rest = [c for c in right.columns if c not in (*on, date)]
    best = F.max_by(F.struct(*rest), F.col(tie)).alias("_best")
    return right.groupBy(*on, date).agg(best).select(*on, date, "_best.*")


def backward(
    left: DataFrame,
    right: DataFrame,
    on: str | Sequence[str] = "symbol",
    left_date: str = "date",
    right_date: str = "date",
    cols: Sequence[str] | None = None,
    tie: str | None = None,
    inclusive: bool = True,
    max_age_days: int | None = None,
    strategy: str = "timeline",
) -> DataFrame:
    """Left rows with the latest right row at or before (``inclusive``) their date.

    The matched date is returned as ``asof_date``; a match older than ``max_age_days``
    counts as missing.
    """
    on = names(on)
    cols = list(cols if cols is not None else [c for c in right.columns if c not in (*on, right_date)])
    right = last_per_date(right.select(*on, right_date, *dict.fromkeys([*cols, *([tie] if tie else [])])), on, right_date, tie)
    value = F.struct(F.col(right_date).alias("asof_date"), *cols)
    if strategy == "timeline":
        out = _carry(left, right.select(*on, F.col(right_date).alias("_d"), value.alias("_m")), on, left_date,
                     right_first=inclusive, forward=False)
    elif strategy == "interval":
        following = Window.partitionBy(*on).orderBy(right_date)
        spans = right.select(
            *on, F.col(right_date).alias("_from"), F.lead(right_date).over(following).alias("_to"), value.alias("_m")
        )
        d = F.col(f"l.{left_date}")
        if inclusive:
            inside = (d >= F.col("r._from")) & (F.col("r._to").isNull() | (d < F.col("r._to")))
        else:
            inside = (d > F.col("r._from")) & (F.col("r._to").isNull() | (d <= F.col("r._to")))
        keys = [F.col(f"l.{c}") == F.col(f"r.{c}") for c in on]
        out = left.alias("l").join(spans.alias("r"), [*keys, inside], "left").select("l.*", "r._m")
    else:
        raise ValueError(f"unknown strategy {strategy!r}")
    if max_age_days is not None:
        fresh = F.datediff(F.col(left_date), F.col("_m.asof_date")) <= max_age_days
        out = out.withColumn("_m", F.when(fresh, F.col("_m")))
    return out.select(*left.columns, "_m.asof_date", *[F.col(f"_m.{c}").alias(c) for c in cols])


def forward(
    left: DataFrame,
    right: DataFrame,
    on: str | Sequence[str] = "symbol",
    left_date: str = "date",
    right_date: str = "date",
    cols: Sequence[str] = (),
    inclusive: bool = True,
) -> DataFrame:
    """Left rows with the earliest right row at or after their date."""
    on = names(on)
    value = F.struct(F.col(right_date).alias("next_date"), *cols)
    right = right.select(*on, F.col(right_date).alias("_d"), value.alias("_m"))
    out = _carry(left, right, on, left_date, right_first=inclusive, forward=True)
    return out.select(*left.columns, "_m.next_date", *[F.col(f"_m.{c}").alias(c) for c in cols])


def _carry(left, right, on, left_date, right_first, forward):
    body = [c for c in left.columns if c not in on]
    a = left.select(*on, F.col(left_date).alias("_d"), F.lit(1).alias("_side"), F.struct(*body).alias("_l"))
    b = right.select(*on, "_d", F.lit(0 if right_first else 2).alias("_side"), "_m")
    date = F.col("_d").desc() if forward else F.col("_d")
    w = Window.partitionBy(*on).orderBy(date, "_side").rowsBetween(Window.unboundedPreceding, 0)
    line = a.unionByName(b, allowMissingColumns=True)
    return (
        line.withColumn("_m", F.last("_m", ignorenulls=True).over(w))
        .filter(F.col("_side") == 1)
        .select(*on, "_l.*", "_m")
    )


def available_from(statements: DataFrame, earnings: DataFrame, window_days: int = 60, fallback_days: int = 45) -> DataFrame:
    """Day a statement became public: first report within the window, else a filing lag."""
    reports = earnings.select("symbol", "date").distinct()
    found = forward(statements, reports, inclusive=True)
    known = F.when(F.datediff("next_date", "date") <= window_days, F.col("next_date"))
    return found.withColumn("available_from", F.coalesce(known, F.date_add("date", fallback_days))).drop("next_date")


def validity(df: DataFrame, on: str | Sequence[str] = "symbol", date: str = "available_from") -> DataFrame:
    """Add ``valid_to`` (exclusive): the next available date of the same key."""
    w = Window.partitionBy(*names(on)).orderBy(date)
    return df.withColumn("valid_to", F.lead(date).over(w))


def last_on(df: DataFrame, day, on: str = "symbol", date: str = "date", value: str = "close") -> DataFrame:
    """Latest value per key on or before one day; aggregated map-side, no window."""
    return (
        df.filter(F.col(date) <= F.lit(day).cast("date"))
        .groupBy(on)
        .agg(F.max(date).alias("asof_date"), F.max_by(value, date).alias(value))
    )


def range_overlap(a: DataFrame, b: DataFrame, on: str) -> DataFrame:
    """Pairs of windows of one key ``on`` that overlap strictly: ``a.start < b.end and b.start < a.end``."""
    x, y = a.alias("a"), b.alias("b")
    test = (F.col(f"a.{on}") == F.col(f"b.{on}")) & (F.col("a.start") < F.col("b.end")) & (F.col("b.start") < F.col("a.end"))
    return x.join(y, test)


def same_period_last_year(quarters: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Quarter joined to the same fiscal period one year earlier (``prior_*`` columns)."""
    prior = quarters.select(
        "symbol", "period", (F.col("fiscal_year") + 1).alias("fiscal_year"), *[F.col(c).alias(f"prior_{c}") for c in cols]
    )
    return quarters.join(prior, ["symbol", "period", "fiscal_year"], "left")


def aligned(a: DataFrame, b: DataFrame, on: str = "date", names_: tuple[str, str] = ("a", "b"), value: str = "value") -> DataFrame:
    """Two series on their common dates."""
    left = a.select(on, F.col(value).alias(names_[0]))
    return left.join(b.select(on, F.col(value).alias(names_[1])), on)


def month_key_join(daily: DataFrame, monthly: DataFrame, value: str = "value", name: str = "monthly") -> DataFrame:
    """Daily rows with the last monthly observation of the same month."""
    key = F.date_format("date", "yyyy-MM")
    last = monthly.groupBy(key.alias("month")).agg(F.max_by(value, "date").alias(name))
    return daily.withColumn("month", key).join(last, "month")


def month_index(date) -> Column:
    d = F.col(date) if isinstance(date, str) else date
    return F.year(d) * 12 + F.month(d)


def within(left: DataFrame, right: DataFrame, on: str, start: str, end: str, date: str) -> DataFrame:
    """Pairs with ``start < date <= end`` and equal ``on``, joined per key and month.

    Left rows are repeated for the months they span, so a pair is only compared inside a
    month: the work grows with the span of a row, not with the history of its key.
    """
    months = F.explode(F.sequence(month_index(start), month_index(end)))
    a = left.withColumn("_month", months)
    b = right.withColumn("_month", month_index(date))
    inside = (F.col(date) > F.col(start)) & (F.col(date) <= F.col(end))
    return a.join(b, [on, "_month"]).filter(inside).drop("_month")
