"""Recursions over keyed, dated rows as two-level compositions of maps, in Spark expressions.

A row turns a state into the next one.  Rows are grouped by key and block of days; the maps
of a block compose to one map, blocks are folded to the state each starts with, and every
block then runs on its own from there.  A block holds at most ``BLOCK_DAYS`` rows and a key
as many blocks as the calendar has, so a key is worked on in parallel and nothing grows with
its number of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK_DAYS = 4096
CHUNK = 64  # states that are appended one by one; longer runs are appended chunk by chunk


def in_blocks(rows: DataFrame, keys: Sequence[str], date: str = "date") -> DataFrame:
    """One row per key and block: ``block``, ``next`` (the key's following block, if any) and ``rows``, in date order (one per key and date)."""
    rest = [date, *[c for c in rows.columns if c not in (*keys, date)]]
    block = F.floor(F.unix_date(date) / BLOCK_DAYS).alias("block")
    cut = rows.groupBy(*keys, block).agg(F.sort_array(F.collect_list(F.struct(*rest))).alias("rows"))
    return cut.withColumn("next", F.lead("block").over(Window.partitionBy(*keys).orderBy("block")))


def let(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` bound to ``value``, which is computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def scan(items: str, start: str, step: Callable[[str, str], str]) -> str:
    """SQL of the states after each item of a bounded array, beginning with ``step(start, first item)``."""
    none = f"filter(array({start}), none_ -> false)"
    add = lambda all_, new: f"named_struct('state', {new}.state, 'all', concat({all_}, array({new}.all)))"
    one = let(step("one_.state", "item_"), "new_", "named_struct('state', new_, 'all', concat(one_.all, array(new_)))")
    chunk = f"aggregate(chunk_, named_struct('state', many_.state, 'all', {none}), (one_, item_) -> {one})"
    many = let(chunk, "part_", add("many_.all", "part_"))
    # an empty array has no chunk
    chunks = f"transform(filter(sequence(0, greatest(0, (size({items}) - 1) div {CHUNK})), i_ -> i_ * {CHUNK} < size({items})), i_ -> slice({items}, cast(i_ * {CHUNK} + 1 AS int), {CHUNK}))"
    return f"flatten(aggregate({chunks}, named_struct('state', {start}, 'all', filter(array({none}), none_ -> false)), (many_, chunk_) -> {many}).all)"


def block_starts(blocks: DataFrame, keys: Sequence[str], change: str, apply: Callable[[str, str], str], start: str, name: str) -> DataFrame:
    """State before each later block: (keys, block, name).

    ``blocks`` are those that others follow, with ``change``, the composed map of a block; a
    key's first block begins with ``start`` and is not listed.
    """
    line = blocks.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("block", "next", F.col(change).alias("m")))).alias("line"))
    states = F.expr(scan("line", start, lambda s, b: apply(f"{b}.m", s)))
    pairs = F.arrays_zip(F.transform("line", lambda b: b["next"]).alias("block"), states.alias(name))
    return line.select(*keys, F.inline(pairs))
