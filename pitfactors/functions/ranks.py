"""Exact ranks inside groups, with a plan for groups too big for one task.

A group is a cross-section (one date, one feature and date, …).  The usual plan is one
window per group.  When a group is larger than one task should sort, the rows are range
partitioned by group and order first, so a hot group spans as many pieces as its rows need;
every piece is ranked on its own, and the counts of the earlier pieces of its group are
added.  Both plans give the same rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitfactors.functions import scale


def plan(df: DataFrame, by: Sequence[str]) -> str:
    """The strategy for several ranks over the groups ``by``, so that they are counted once."""
    return "split" if scale.has_large_group(df, list(by)) else "window"


def ordinal(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    rank: str = "rn",
    count: str | None = None,
    descending: bool = False,
    strategy: str = "auto",
    group_rows: int = scale.GROUP_ROWS,
) -> DataFrame:
    """Add the 1-based position in the group; ``order`` must end in a unique column.

    ``descending`` reverses the first order column only, NULLs always come last.
    """
    by, order = list(by), list(order)
    split = strategy == "split" or (strategy == "auto" and scale.has_large_group(df, by))
    if split:
        return _split_ordinal(df, by, order, rank, count, descending, group_rows)
    group = Window.partitionBy(*by)
    out = df.withColumn(rank, F.row_number().over(group.orderBy(*_sort(order, descending))))
    return out if count is None else out.withColumn(count, F.count(F.lit(1)).over(group))


def average(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    tie: str,
    rank: str = "rank",
    count: str | None = None,
    strategy: str = "auto",
) -> DataFrame:
    """Add the average rank of ``value`` in its group (ties share their mean position)."""
    by = list(by)
    if strategy == "split" or (strategy == "auto" and scale.has_large_group(df, by)):
        placed = scale.stable(ordinal(df, by, [value, tie], "_rn", count, strategy="split"))
        shared = placed.groupBy(*by, value).agg(((F.min("_rn") + F.max("_rn")) / 2.0).alias(rank))
        keys = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in [*by, value]]
        joined = placed.alias("l").join(shared.alias("r"), keys)
        return joined.select("l.*", F.col(f"r.{rank}")).drop("_rn")
    group = Window.partitionBy(*by)
    ties = Window.partitionBy(*by, value)
    position = F.rank().over(group.orderBy(F.col(value).asc_nulls_last()))
    out = df.withColumn(rank, position + (F.count(F.lit(1)).over(ties) - 1) / 2.0)
    return out if count is None else out.withColumn(count, F.count(F.lit(1)).over(group))


def moments(df: DataFrame, by: Sequence[str], value: str, mean: str, sd: str, strategy: str = "auto") -> DataFrame:
    """Add mean and population deviation of the group.

    Next to a rank the rows already sit together by group, so a window costs no shuffle;
    groups too big for one task are aggregated map-side and joined back.
    """
    by = list(by)
    if strategy == "split" or (strategy == "auto" and scale.has_large_group(df, by)):
        m = df.groupBy(*by).agg(F.avg(value).alias(mean), F.stddev_pop(value).alias(sd))
        keys = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in by]
        return df.alias("l").join(m.alias("r"), keys).select("l.*", F.col(f"r.{mean}"), F.col(f"r.{sd}"))
    group = Window.partitionBy(*by)
    return df.withColumns({mean: F.avg(value).over(group), sd: F.stddev_pop(value).over(group)})


def _split_ordinal(df, by, order, rank, count, descending, group_rows):
    df = scale.stable(df)
    sort = _sort(order, descending)
    pieces = max(2, 4 * (df.count() // max(1, group_rows) + 1))
    # The range partitioner orders pieces as the window orders rows; written once, so a row keeps its piece.
    placed = scale.stable(df.repartitionByRange(pieces, *by, *sort).withColumn("_piece", F.spark_partition_id()))
    sizes = placed.groupBy(*by, "_piece").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.partitionBy(*by).orderBy("_piece")
    sizes = sizes.withColumn(
        "_before", F.coalesce(F.sum("_size").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ).withColumn("_total", F.sum("_size").over(Window.partitionBy(*by)))
    inside = Window.partitionBy(*by, "_piece").orderBy(*sort)
    ranked = placed.withColumn("_rn", F.row_number().over(inside))
    keys = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in [*by, "_piece"]]
    joined = ranked.alias("l").join(sizes.alias("r"), keys)
    keep = [F.col(f"l.{c}") for c in df.columns]
    extra = [(F.col("l._rn") + F.col("r._before")).cast("int").alias(rank)]
    if count is not None:
        extra.append(F.col("r._total").alias(count))
    return joined.select(*keep, *extra)


def _sort(order: Sequence[str], descending: bool) -> list[Column]:
    """One order for both plans, whatever the type of the first column."""
    first = F.col(order[0])
    return [first.desc_nulls_last() if descending else first.asc_nulls_last(), *map(F.col, order[1:])]


def bucket(rn: Column, n: Column, buckets: int) -> Column:
    """Quantile bucket 0…B-1 with edges at ``int(n*b/B)``; remainders are spread."""
    return F.floor((F.lit(buckets) * rn - 1) / n).cast("int")


def quantiles(df: DataFrame, by: Sequence[str], value: str, tie: str, probs: dict[str, float], extra: Sequence[Column] = ()) -> DataFrame:
    """Exact linearly interpolated quantiles per group, read off ordinal ranks.

    ``extra`` aggregates are taken over the same rows (those with a value).
    """
    ranked = ordinal(df.filter(F.col(value).isNotNull()), by, [value, tie], "_rn", "_n")
    out = []
    for name, p in probs.items():
        spot = (F.col("_n") - 1) * F.lit(float(p)) + 1
        low = F.max(F.when(F.col("_rn") == F.floor(spot), F.col(value)))
        high = F.max(F.when(F.col("_rn") == F.ceil(spot), F.col(value)))
        share = F.max(spot - F.floor(spot))
        out.append((low + (high - low) * share).alias(name))
    return ranked.groupBy(*by).agg(*out, *extra)
