"""Chat formatting with cumulative-snapshot collapse.

Chat logs often hold a conversation again and again, each time with a few more turns.  A
rolling hash over the turns gives every prefix of a conversation a key; a conversation whose
whole key is a proper prefix of another one is dropped by an anti-join, equal conversations
leave one, and what remains is rendered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Turn frame of the rendered text.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def _turn(role: Column, text: Column) -> Column:
    """One turn as an unambiguous string: nulls and lengths are part of it."""
    sized = [F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.length(c).cast("string"), F.lit(":"), c)) for c in (role, text)]
    return F.concat(*sized)


def conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: conv_id, turns (ordered role and text), keys (hash of each prefix)."""
    rows = turns.select(F.col(conv_col).alias("conv_id"), F.struct(F.col(turn_col).isNull().alias("late"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text")).alias("t"))
    rows = rows.where(F.col("conv_id").isNotNull())
    rows = rows.groupBy("conv_id").agg(F.sort_array(F.collect_set("t")).alias("turns"))  # repeats shrink map-side

    def roll(keys: Column, t: Column) -> Column:
        before = F.coalesce(F.try_element_at(keys, F.lit(-1)), F.lit("").cast("binary"))
        return F.concat(keys, F.array(F.unhex(F.sha2(F.concat(before, _turn(t["role"], t["text"]).cast("binary")), 256))))

    keys = F.aggregate("turns", F.array().cast("array<binary>"), roll)
    return rows.select("conv_id", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"), keys.alias("keys"))


def maximal(convs: DataFrame) -> DataFrame:
    """Conversations that are no proper prefix of another; of equal ones the smallest id, with the number of copies."""
    convs = convs.withColumn("key", F.element_at("keys", -1))
    prefixes = convs.select(F.explode(F.slice("keys", 1, F.size("keys") - 1)).alias("key")).distinct()
    first = convs.groupBy("key").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("copies"))
    kept = first.join(prefixes, "key", "left_anti")
    return convs.select("conv_id", "turns").join(kept.select("conv_id", "copies"), "conv_id")


def render(turns: Column) -> Column:
    """The conversation as one string; a null role renders as ``unknown``, a null text as empty."""
    one = lambda t: F.concat(F.lit(OPEN), F.coalesce(t["role"], F.lit("unknown")), F.lit("\n"), F.coalesce(t["text"], F.lit("")), F.lit(CLOSE + "\n"))
    return F.array_join(F.transform(turns, one), "")


def chat_format(turns: DataFrame, **columns: str) -> DataFrame:
    """One row per kept conversation: conv_id, n_turns, copies, text.

    * Turns are ordered by number (null last), then role and text (null first); rows repeated
      in all four columns count once.  Rows without a conversation id are left out, since
      nothing says which conversation they belong to.
    * Turns compare by role and text, not by number; null and empty differ.
    * Equal conversations keep the smallest id and count in ``copies``.
    * An empty table gives no rows; other columns are ignored.

    A conversation is one row of the result, so its turns meet in one task by definition.
    All branches group by conversation, so they read one exchange and texts move once.
    """
    kept = maximal(conversations(turns, **columns))
    return kept.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.col("copies").cast("long").alias("copies"), render(F.col("turns")).alias("text"))
