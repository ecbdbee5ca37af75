"""Incremental work as Structured Streaming jobs.

Batch functions do the row work; the jobs here only bind them to a stream, a checkpoint
and a sink.  Batches may be replayed after a failure, so every sink step is idempotent.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import TimerValues

from pitfactors.operators.regimes import step
from pitfactors.sources import sinks


def files(spark: SparkSession, folder: str, schema, glob: str = "*.parquet", per_batch: int | None = None) -> DataFrame:
    """Stream of Parquet files dropped into a folder."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    if per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", per_batch)
    return reader.parquet(folder)


def _each(stream: DataFrame, checkpoint: str, work: Callable[[DataFrame, int], None]) -> DataStreamWriter:
    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(work)


def upserts(stream: DataFrame, path: str, checkpoint: str, keys: Sequence[str], order: Sequence[str], date: str = "date") -> DataStreamWriter:
    """Upsert each micro-batch by key: last write wins, late corrections overwrite."""
    return _each(stream, checkpoint, lambda batch, _: sinks.upsert_table(batch, path, keys, order, date))


def corrections(stream: DataFrame, path: str, checkpoint: str, kind: str, order: Sequence[str] = ()) -> DataStreamWriter:
    """Re-sent records of a document kind overwrite the stored ones by natural key.

    Without ``order`` the record loaded last wins: the later file, and in a file the later row.
    """
    return upserts(stream if order else sinks.in_load_order(stream), path, checkpoint, sinks.MERGE_KEYS[kind], order)


def feature_refresh(stream: DataFrame, checkpoint: str, build: Callable[[], DataFrame], path: str, days: int = 7) -> DataStreamWriter:
    """Each batch of new bars rewrites the last days of the panel.

    ``build`` returns the panel computed on full history; only the touched dates are
    written.
    """
    def work(batch: DataFrame, _: int) -> None:
        last = batch.agg(F.max("date").alias("d")).first()["d"]
        if last is None:
            return
        rows = build().filter(F.col("date").between(F.date_sub(F.lit(last), days), F.lit(last)))
        sinks.overwrite_partitions(rows, path, ["date"])

    return _each(stream, checkpoint, work)


def carried_refresh(
    stream: DataFrame, checkpoint: str, build: Callable[[DataFrame], DataFrame], path: str, state: str,
    days: int = 7, history: int = 252, order: Sequence[str] = (),
) -> DataStreamWriter:
    """Each batch of bars rewrites the last ``days`` of the panel from a carried tail instead of full history.

    ``build`` makes the panel of the bars it is given.  The tail holds, per symbol, the bars
    of the last days, ``history`` bars before them and the highest close before those.  That
    is all that windows of up to ``history`` bars and running maxima can see, so the result
    equals the panel of all bars; recursive features (``rsi_14``) remember more and need
    ``feature_refresh``.  Bars are corrected by (symbol, date), the last loaded wins.

    * The first batch is built whole.  An empty one, or one without dates, changes nothing.
    * Bars older than the days rewritten are not lost: they go to ``late`` in the folder
      ``state``, for the next full build.
    * Tails alternate between two folders, so a batch that is replayed finds the one it read.
    """
    def work(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = (batch if order else sinks.in_load_order(batch)).filter("symbol is not null and date is not null")
        plain = batch.drop(sinks.LOADED)
        tail = spark.read.schema(plain.schema).parquet(f"{state}/tail-{(number - 1) % 2}") if number else plain.filter(F.lit(False))
        last = tail.agg(F.max("date").alias("d")).first()["d"]
        if last is not None:
            since = F.date_sub(F.lit(last), days)
            late = new.filter(F.col("date") < since).drop(sinks.LOADED)
            late.write.mode("overwrite").parquet(f"{state}/late/batch={number}")
            new = new.filter(F.col("date") >= since)
        sinks.upsert(tail, new, ["symbol", "date"], order).write.mode("overwrite").parquet(f"{state}/bars")
        bars = spark.read.schema(plain.schema).parquet(f"{state}/bars")
        rows = build(bars) if last is None else build(bars).filter(F.col("date") >= since)
        sinks.overwrite_partitions(rows.repartition("date"), path, ["date"])
        _tail(bars, days, history).write.mode("overwrite").parquet(f"{state}/tail-{number % 2}")

    return _each(stream if order else sinks.in_load_order(stream), checkpoint, work)


def _tail(bars: DataFrame, days: int, history: int) -> DataFrame:
    """Bars of the last ``days``, ``history`` priced ones before them, and the highest close before those."""
    last = bars.agg(F.max("date").alias("d")).first()["d"]
    old = F.col("date") < F.date_sub(F.lit(last).cast("date"), days)
    back = Window.partitionBy("symbol").orderBy(F.desc("date")).rowsBetween(Window.unboundedPreceding, 0)
    placed = bars.filter(~old | F.col("close").isNotNull()).withColumn("_old", F.count_if(old).over(back))
    far = placed.filter(F.col("_old") > history).groupBy("symbol").agg(F.max_by(F.struct(*bars.columns), F.struct("close", "date")).alias("bar"))
    return placed.filter(F.col("_old") <= history).select(*bars.columns).unionByName(far.select("bar.*"))


def score_append(stream: DataFrame, checkpoint: str, build: Callable[[], DataFrame], path: str) -> DataStreamWriter:
    """Append score-panel dates after the stored maximum."""
    return _each(stream, checkpoint, lambda batch, _: sinks.append_after_last(build(), path))


def unique_alerts(stream: DataFrame, path: str, checkpoint: str, keys: Sequence[str] = ("alert_id",)) -> DataStreamWriter:
    """Each alert once, for ever: ids stored already are left as they are, however late they come again."""
    return _each(stream, checkpoint, lambda batch, _: sinks.insert_absent(batch.dropDuplicates(list(keys)), path, keys))


def windowed(stream: DataFrame, time: str, keys: Sequence[str], width: str, delay: str) -> DataFrame:
    """Bars per event-time window with late data up to ``delay``."""
    return stream.withWatermark(time, delay).groupBy(F.window(time, width), *keys).agg(
        F.min_by("price", time).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.max_by("price", time).alias("close"), F.count(F.lit(1)).alias("n"))


REGIME_OUT = "regime string, date date, active boolean"
REGIME_STATE = "phase int, run int, days int, seen date"
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Machine(StatefulProcessor):
    """One regime's machine: its state is a typed value, which a batch snapshot may start."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._state = handle.getValueState("machine", REGIME_STATE)

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues: TimerValues) -> None:
        first = initialState.iloc[0]
        self._state.update((int(first["phase"]), int(first["run"]), int(first["days"]), first["seen"]))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        phase, length, days, seen = self._state.get() or (0, 0, 0, None)
        out = []
        for r in pd.concat(list(rows)).sort_values("date").itertuples(index=False):  # one regime: one row per day
            if seen is not None and r.date <= seen:
                continue
            (phase, length, days), (active, *_) = step((phase, length, days), r.entry, r.leave, r.hold, r.need_in, r.need_out)
            seen = r.date
            out.append((key[0], r.date, bool(active)))
        self._state.update((phase, length, days, seen))
        yield pd.DataFrame(out, columns=["regime", "date", "active"])

    def close(self) -> None:
        pass


def regime_states(flags: DataFrame, start: DataFrame | None = None) -> DataFrame:
    """Regime state carried from day to day: the streaming twin of ``regimes.stateful``.

    Rows of a micro-batch are applied in date order; dates already seen are skipped, so a
    replayed day changes nothing.  ``start`` (``regimes.carried`` of a batch table) continues
    where the batch ended; regimes it does not name start switched off.
    """
    given = None if start is None else start.groupBy("regime")
    return flags.groupBy("regime").transformWithStateInPandas(Machine(), REGIME_OUT, "append", "none", given)


def run_to_folder(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Process everything available and write it to Parquet.

    Typed state needs the RocksDB store; a query keeps the settings it is started with, so
    the session's own setting comes back at once.
    """
    conf = stream.sparkSession.conf
    before = conf.get(STORE, None)
    conf.set(STORE, ROCKS_DB)
    try:
        query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(
            availableNow=True).start()
    finally:
        conf.unset(STORE) if before is None else conf.set(STORE, before)
    query.awaitTermination()
