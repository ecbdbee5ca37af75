"""First row of a series at which a level is crossed.

A table of range minima and maxima over a symbol's closes (one level per power of two) lets a
query skip to its answer in as many steps as the table has levels, for all queries of a
symbol at once.  Nothing is made for the rows in between, so a query costs the same whether
its answer is the next bar or years away, or never comes.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitfactors.functions import scale

#: Queries that one task holds; the queries of a symbol with more are cut into pieces, each with its bars.
PIECE_ROWS = 1_000_000


class Track:
    """Closes of one symbol in date order, with range minima and maxima."""

    def __init__(self, days: np.ndarray, close: np.ndarray):
        order = np.argsort(days, kind="stable")
        self.days, self.close, self.n, self.order = days[order], close[order], len(days), order
        self._levels: dict[str, list[np.ndarray]] = {}

    def levels(self, kind: str) -> list[np.ndarray]:
        """Extremes of 1, 2, 4, … rows from each row on; missing closes are passed over."""
        if kind not in self._levels:
            pick, rows = (np.fmin if kind == "min" else np.fmax), [self.close]
            while 2 << (len(rows) - 1) <= self.n:
                half = 1 << (len(rows) - 1)
                rows.append(pick(rows[-1][:-half], rows[-1][half:]))
            self._levels[kind] = rows
        return self._levels[kind]

    def after(self, days: np.ndarray) -> np.ndarray:
        """First row behind each day."""
        return np.searchsorted(self.days, days, side="right")

    def at_or_after(self, days: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.days, days, side="left")

    def first(self, kind: str, start: np.ndarray, test: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
        """First row at or behind ``start`` that passes ``test(close, query)``, or ``n``.

        ``test`` must be monotone: a range passes through its minimum (or maximum) if any row does.
        """
        at = np.array(start, dtype=np.int64)
        levels = self.levels(kind)
        with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
            for k in range(len(levels) - 1, -1, -1):
                who = np.flatnonzero(at + (1 << k) <= self.n)
                none = ~test(levels[k][at[who]], who)
                at[who[none]] += 1 << k
        return at

    def fall_from_peak(self, keep: float) -> np.ndarray:
        """Per row: first row whose close is at most ``keep`` times the highest close from this row to it, or ``n``.

        Until a higher close the peak is the row's own, and from there on the peak is that
        close's: either the fall comes first, or the row shares the answer of the higher one.
        """
        rows = np.arange(self.n)
        higher = self.first("max", rows + 1, lambda x, q: x > self.close[q])
        fall = self.first("min", rows, lambda x, q: x <= self.close[q] * keep)
        settled = (fall < higher) | (higher == self.n)
        answer = np.append(np.where(fall < higher, fall, self.n), self.n)
        to = np.append(np.where(settled, rows, higher), self.n)
        for _ in range(self.n.bit_length()):
            to = to[to]
        return answer[to[: self.n]]


def per_symbol(rows: DataFrame, bars: DataFrame, fn: Callable[[pa.Table, Track, pa.Table], dict[str, pa.Array]], out: str, key: str = "symbol") -> DataFrame:
    """Add columns ``out`` to ``rows``: ``fn(queries, track, bars in date order)`` answers the queries of one symbol.

    ``bars`` has the key, ``date``, ``close`` and at most one row per key and date, so a
    symbol's bars are bounded by the calendar; its queries are not, and are cut into pieces.
    """
    rows, bars = rows.withColumn("_piece", F.lit(0)), bars.withColumnRenamed(key, "_key").withColumn("_piece", F.lit(0))
    if scale.has_large_group(rows.select(key), [key], PIECE_ROWS):
        size = max(PIECE_ROWS, rows.count() // 1000)
        hot = rows.groupBy(key).count().where(F.col("count") > size)
        hot = F.broadcast(hot.select(key, F.ceil(F.col("count") / size).cast("int").alias("_pieces")))  # at most 1000 keys
        one = F.coalesce("_pieces", F.lit(1))
        rows = rows.drop("_piece").join(hot, key, "left").withColumn("_piece", F.pmod(F.xxhash64(F.monotonically_increasing_id()), one).cast("int")).drop("_pieces")
        bars = bars.drop("_piece").join(hot.withColumnRenamed(key, "_key"), "_key", "left").withColumn("_piece", F.explode(F.sequence(F.lit(0), one - 1))).drop("_pieces")
    added = [c.strip().split()[0] for c in out.split(",")]
    schema = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes if n != "_piece") + ", " + out

    def run(queries: pa.Table, series: pa.Table) -> pa.Table:
        queries = queries.drop_columns(["_piece"])
        series = series.sort_by("date")
        track = Track(days_of(series.column("date")), doubles(series.column("close")))
        found = fn(queries, track, series)
        for name in added:
            queries = queries.append_column(name, found[name])
        return queries

    return rows.groupBy(key, "_piece").cogroup(bars.groupBy("_key", "_piece")).applyInArrow(run, schema)


def days_of(column: pa.ChunkedArray) -> np.ndarray:
    """Dates as days; a missing one lies behind all others."""
    return column.cast(pa.int32()).cast(pa.int64()).fill_null(1 << 40).to_numpy()


def doubles(column: pa.ChunkedArray) -> np.ndarray:
    """Numbers as doubles, a missing one as NaN."""
    return column.cast(pa.float64()).to_numpy()


def taken(series: pa.Table, column: str, at: np.ndarray) -> pa.Array:
    """Values of ``column`` at rows ``at``; no value for the row behind the last."""
    return series.column(column).combine_chunks().take(pa.array(np.where(at < len(series), at, 0), mask=at >= len(series))) if len(series) else pa.nulls(len(at), series.schema.field(column).type)
