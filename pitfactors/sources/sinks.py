"""Writers: upsert by key, insert if absent, replace per partition.

The row logic (``latest``, ``absent``) is separate from the writing, so batch and stream
share it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException


def latest(rows: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """One row per key, the last by ``order``; a NULL part of a key is a value like any other.

    The row limit is applied before the shuffle as well, so many versions of one hot key
    shrink to one per task first.
    """
    w = Window.partitionBy(*keys).orderBy(*[F.desc(o) if isinstance(o, str) else o.desc() for o in order])
    return rows.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


LOADED = "load_order"


def in_load_order(rows: DataFrame) -> DataFrame:
    """Rows with ``load_order``: their file by time of change and name, their place in it.

    Rows that come from no file keep the order in which the frame holds them.  A stream gets
    the file only; its micro-batches add the place.
    """
    parts = [F.col(LOADED)] if LOADED in rows.columns else []
    hidden = rows._jdf.queryExecution().analyzed().metadataOutput()
    if not parts and "_metadata" in [hidden.apply(i).name() for i in range(hidden.size())]:
        parts = ["_metadata.file_modification_time", "_metadata.file_path", "_metadata.file_block_start"]
    if not rows.isStreaming:
        parts = [*parts, F.monotonically_increasing_id().alias("row")]
    return rows.withColumn(LOADED, F.struct(*parts))


def upsert(existing: DataFrame, updates: DataFrame, keys: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """Union of both sides, updates win; among updates of one key ``order`` decides, or else the order of loading."""
    old = existing.withColumn("_new", F.lit(0))
    new = (updates if order or LOADED in updates.columns else in_load_order(updates)).withColumn("_new", F.lit(1))
    merged = latest(old.unionByName(new, allowMissingColumns=True), keys, ["_new", *(order or [LOADED])])
    return merged.drop("_new", LOADED)


def absent(existing: DataFrame, candidates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Candidates whose key is not stored yet; published rows are never changed."""
    stored = existing.select(*[F.col(k).alias(f"_stored_{k}") for k in keys]).distinct()
    same = [candidates[k].eqNullSafe(F.col(f"_stored_{k}")) for k in keys]
    return candidates.join(stored, same, "left_anti")


def replace_symbols(existing: DataFrame, fresh: DataFrame) -> DataFrame:
    """Delete-then-insert per symbol."""
    kept = existing.join(fresh.select("symbol").distinct(), "symbol", "left_anti")
    return kept.unionByName(fresh, allowMissingColumns=True)


def news_key() -> Column:
    """Key of a news record: its address, else publication date and title."""
    return F.coalesce(F.nullif("url", F.lit("")), F.concat_ws("|", "publishedDate", "title"))


# Natural keys of the merged document kinds.
MERGE_KEYS = {
    "prices": ("symbol", "date"), "income": ("symbol", "date"), "earnings": ("symbol", "date"), "dividends": ("symbol", "date"),
    "splits": ("symbol", "date"), "analyst_grades": ("symbol", "date", "grading_company"),
    "insider_trades": ("symbol", "transaction_date", "reporting_name", "transaction_type"), "news": ("symbol", "news_key"),
}


def merge_history(stored: DataFrame, fetched: DataFrame, kind: str) -> DataFrame:
    """Add new records to stored ones by the kind's key; old records are never lost, fetched ones without a date drop.

    Of several fetched records with one key, the one loaded last stays (``in_load_order``).
    """
    fetched = fetched if LOADED in fetched.columns else in_load_order(fetched)
    dated = {"insider_trades": "transaction_date", "news": "publishedDate"}.get(kind, "date")
    fetched = fetched.dropna(subset=[dated]) if dated in fetched.columns else fetched
    if kind == "news":
        stored, fetched = (d.withColumn("news_key", news_key()) for d in (stored, fetched))
    return upsert(stored, fetched, MERGE_KEYS[kind])


def tagged(trades: DataFrame, source_type: str, source_id: str, window: str | None = None) -> DataFrame:
    """Ledger rows with their source tags and a content id."""
    t = trades.withColumns({"source_type": F.lit(source_type), "source_id": F.lit(source_id), "window_label": F.lit(window).cast("string")})
    parts = ["source_type", "source_id", "sleeve", F.coalesce("window_label", F.lit("")), F.col("date").cast("string"), "symbol", "action", "trade_key"]
    return t.withColumn("id", F.substring(F.md5(F.concat_ws(":", *parts)), 1, 12))


# ---------------------------------------------------------------- partitioned Parquet tables


def read_or_empty(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    try:
        return spark.read.schema(like.schema).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], like.schema)


def upsert_table(updates: DataFrame, path: str, keys: Sequence[str], order: Sequence[str] = (), date: str = "date") -> None:
    """Upsert into a Parquet table partitioned by year; only touched years are rewritten.

    The partition list is a handful of years; the rows stay distributed.  A failed write
    leaves the old partitions, so the step can be repeated.  Rows without a date have a
    partition of their own, which is rewritten like any other.
    """
    spark = updates.sparkSession
    new = (updates if order else in_load_order(updates)).withColumn("year", F.year(date))
    stored = read_or_empty(spark, path, new.drop(LOADED))
    touched = new.select(F.col("year").alias("_touched")).distinct()
    old = stored.join(touched, stored["year"].eqNullSafe(F.col("_touched")), "left_semi")
    merged = upsert(old, new, keys, order)
    merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("year").parquet(path)


def insert_absent(candidates: DataFrame, path: str, keys: Sequence[str]) -> None:
    """Append rows whose key is new."""
    stored = read_or_empty(candidates.sparkSession, path, candidates)
    absent(stored, candidates, keys).write.mode("append").parquet(path)


def overwrite_partitions(df: DataFrame, path: str, partitions: Sequence[str]) -> None:
    """Replace exactly the partitions present in ``df``."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partitions).parquet(path)


def append_after_last(panel: DataFrame, path: str, date: str = "date") -> None:
    """Append only dates later than the last stored one."""
    stored = read_or_empty(panel.sparkSession, path, panel)
    last = stored.agg(F.coalesce(F.max(date), F.lit("0001-01-01").cast("date"))).scalar()
    panel.filter(F.col(date) > last).write.mode("append").parquet(path)
