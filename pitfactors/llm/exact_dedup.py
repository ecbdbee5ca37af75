"""Exact deduplication by skew-safe combining.

Equal texts are found in three steps: map-side aggregation removes the copies inside each
task, salted (digest, content) groups merge the rest, and the salt winners merge into one
winner per content.  The grouping key holds the full normalised content beside its digest in
each step, so texts are equal only when their bytes are.  A hot text never meets in one task
before it has shrunk to one row per salt.

A first narrow pass counts digests; a text whose digest nobody shares has nothing to be
compared with, so its content never leaves its task's row.
"""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitfactors.functions.scale import stable
from pitfactors.llm.common import SPACES, lookup, whole

_LAST_ID = (1 << 63) - 1


def normalised(text: Column) -> Column:
    """The text without the characters ``[\\x20\\x09-\\x0D]``."""
    return F.regexp_replace(text, f"[{SPACES}]+", "")


def _number(value: int) -> Column:
    return F.lit(Decimal(value)).cast("decimal(20,0)")


def _better(chars: str, doc_id: str) -> Column:
    """One number that is larger for the row to keep: more code points, then the smaller id, a null id last.

    Decimals live in fixed-width aggregation buffers, so the groups stay hash aggregates.
    The id takes the places 1 to 2^64, null takes 0.
    """
    place = F.coalesce(_number(_LAST_ID + 1) - F.col(doc_id).cast("decimal(19,0)"), _number(0))
    return (F.col(chars).cast("decimal(10,0)") * _number((1 << 64) + 1) + place).cast("decimal(38,0)")


def _kept_id(best: Column) -> Column:
    place = F.pmod(best, _number((1 << 64) + 1).cast("decimal(38,0)"))
    return F.when(place > 0, _number(_LAST_ID + 1) - place).cast("long")


def _winners(rows: DataFrame, salts: int) -> DataFrame:
    """Best row and size of each (digest, content): inside tasks, per salt, then over salts."""
    salted = rows.select("digest", "body", F.pmod(F.xxhash64("doc_id", "n_chars"), F.lit(salts)).alias("salt"), _better("n_chars", "doc_id").alias("best"))
    salted = salted.groupBy("digest", "body", "salt").agg(F.max("best").alias("best"), F.count(F.lit(1)).alias("n"))
    return salted.groupBy("digest", "body").agg(F.max("best").alias("best"), F.sum("n").alias("group_size"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16, digest: Callable[[Column], Column] | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256, and n_chars of the original.

    * A null text counts as empty; empty texts form a group like any other.
    * Ties in length go to the smallest id, a null id last.  Of rows that repeat id and length
      in one group, one is kept (by a hash of the original text); all carry the same keep_id.
    * Other columns of ``docs`` are ignored; an empty table gives an empty result.

    ``digest`` maps the normalised text to its grouping digest (SHA-256 by default).  Contents
    that share a digest are kept apart; tests use a weak digest to show it.
    """
    digest = digest or (lambda body: F.unhex(F.sha2(body, 256)))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole(text_col).alias("full"))
    texts = texts.withColumn("n_chars", F.length("full")).withColumn("ticket", F.coalesce("doc_id", F.xxhash64("n_chars", "full")))

    def with_body(part: DataFrame) -> DataFrame:
        part = part.withColumn("body", normalised(F.col("full")))
        return part.withColumn("digest", digest(F.col("body")))

    rows = with_body(texts).select("doc_id", "n_chars", "ticket", "digest", F.sha2("body", 256).alias("text_sha256"), F.xxhash64("full").alias("mark"))
    rows = stable(rows)
    several = rows.groupBy("digest").count().where("count > 1")
    tickets = lookup(rows.select("digest", "ticket"), several, "digest").where("count > 1").select("ticket").distinct()
    rivals = with_body(texts.join(tickets, "ticket", "left_semi"))
    groups = stable(_winners(rivals, salts).select("digest", "best", "group_size"))
    shared = groups.groupBy("digest").count().where("count > 1").select("digest")

    if shared.isEmpty():
        out = lookup(rows, groups, "digest")
    else:  # different contents under one digest: those rows are joined by content
        twins = rivals.join(shared, "digest", "left_semi")
        named = twins.withColumn("text_sha256", F.sha2("body", 256)).withColumn("mark", F.xxhash64("full"))
        named = named.join(_winners(twins, salts), ["digest", "body"]).drop("body", "full")
        out = lookup(rows.join(shared, "digest", "left_anti"), groups, "digest").unionByName(named)

    own = _better("n_chars", "doc_id")
    out = out.withColumn("best", F.coalesce("best", own)).withColumn("wins", own == F.col("best"))
    # rows that win together repeat an id and a length: number them, spread by id so that a hot text does not meet again
    copy = F.row_number().over(Window.partitionBy("doc_id", "n_chars", "digest").orderBy("mark"))
    out = out.repartition("doc_id", "n_chars", "digest").withColumn("copy", copy)
    return out.select(
        "doc_id", _kept_id(F.col("best")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (F.col("wins") & (F.col("copy") == 1)).alias("kept"), "text_sha256", "n_chars", "mark",
    )
