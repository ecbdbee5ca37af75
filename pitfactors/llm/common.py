"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pitfactors.functions.scale import stable

#: A word, and the white space between words (fixed by the contract of the queries).
WORD = r"[^\x20\x09-\x0D]+"
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def whole(text: str | Column) -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def unit(*parts: Column, seed: int = 0) -> Column:
    """A non-negative pseudorandom long that depends on ``parts`` alone."""
    return F.xxhash64(F.lit(seed), *parts).bitwiseAND(F.lit((1 << 62) - 1))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def short_hash(text: Column) -> Column:
    """First 16 bytes of the SHA-256 of a string or binary column."""
    return F.unhex(F.substring(F.sha2(text, 256), 1, 32))


def lookup(rows: DataFrame, facts: DataFrame, key: str, hot: int = 1024, least: int = 64) -> DataFrame:
    """Left join of ``rows`` to ``facts`` (one row per key) that splits hot keys.

    A key is hot when it holds ``least`` rows and more than one in ``hot`` of all, so there
    are fewer than ``hot`` such keys at any size: they are named in a filter, their facts are broadcast and
    their rows stay where they are.  All other rows are shuffled by key; without hot keys it
    is a plain join.  ``rows`` is read again for each step, so it should be a stored table; a
    null key finds nothing.
    """
    total = rows.count()
    counts = rows.where(F.col(key).isNotNull()).groupBy(key).count()
    keys = [r[0] for r in counts.where((F.col("count") >= least) & (F.col("count") * hot > total)).select(key).collect()]
    found = [*rows.columns, *(c for c in facts.columns if c != key)]
    if not keys:
        return rows.join(facts, key, "left").select(*found)
    # a null key is not hot
    is_hot = F.coalesce(F.col(key).isin(keys), F.lit(False))
    split = rows.where(is_hot).join(F.broadcast(facts.where(is_hot)), key, "left")
    rest = rows.where(~is_hot).join(facts, key, "left")
    return split.select(*found).unionByName(rest.select(*found))
