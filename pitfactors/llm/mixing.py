"""Mixing sources to target weights.

The words of each source form one stream, cut into blocks of a fixed number of words.  The
mix is a row of slots, one block each, dealt to output shards.  Every shard draws its source
counts multinomially; a draw above a source's quota is handed to a source below its own, so
the totals are exact.  The n-th slot of a source takes the block that a keyed permutation
assigns to n (one permutation for each pass over the source), and slots meet blocks in an
equi-join on (source, block).  All work is DataFrame expressions; no step sorts or collects a
source as a whole.  What several branches read (draws, counts, numbered rows; a few bytes a
slot or document) is stored, so that no plan holds the same steps many times.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitfactors.functions.scale import stable
from pitfactors.llm.common import unit, whole, word_count


@dataclass(frozen=True)
class MixPlan:
    """Weights repeat over the sources in code-point order, a null source last."""

    weights: tuple[int, ...] = (5, 2, 1)
    share: float = 1.5  # size of the mix against all input words
    most: int = 2  # no source, and so no document, is taken more often
    block_words: int = 256
    shard_slots: int = 4096
    buckets: int = 4096  # of one source, in prefix sums
    bins: int = 4096  # of ticket ranges
    seed: int = 7


def source_targets(rows: DataFrame, plan: MixPlan) -> DataFrame:
    """One row per source: sid, source, source_size, target, quota, blocks, slots, ticket range.

    Targets fill up like water: a source's target is the smaller of ``most`` times its size
    and its weight times one common level.  Sources in the order of that limit per weight
    reach it first, so the level follows from running sums over one row per source.
    """
    one = Window.orderBy(F.col("source").asc_nulls_last())
    s = rows.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("sid", F.row_number().over(one))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in plan.weights]), F.pmod(F.col("sid") - 1, F.lit(len(plan.weights))) + 1)
    s = s.withColumn("weight", weight).withColumn("limit", (F.col("source_size") * plan.most).cast("double"))
    full = Window.orderBy(F.col("limit") / F.col("weight"), "sid")
    before, every = full.rowsBetween(Window.unboundedPreceding, -1), full.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.sum("source_size").over(every) * F.lit(plan.share)
    left = total - F.coalesce(F.sum("limit").over(before), F.lit(0.0))
    weights = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    s = s.withColumn("level", F.when(weights > 0, left / weights))
    s = s.withColumn("stops", F.col("limit") <= F.col("weight") * F.col("level"))
    # the level of the first source that does not stop holds for all that follow it
    level = F.first(F.when(~F.col("stops"), F.col("level")), ignorenulls=True).over(every)
    s = s.withColumn("target", F.when(F.col("stops"), F.col("limit")).otherwise(F.least(F.col("limit"), F.col("weight") * level)))
    s = s.withColumn("quota", F.least(F.round("target").cast("long"), F.col("source_size") * plan.most))
    size, b = F.col("source_size"), plan.block_words
    passes = F.when(size > 0, F.expr("quota div source_size")).otherwise(F.lit(0))
    s = s.withColumn("blocks", F.expr(f"(source_size + {b - 1}) div {b}")).withColumn("full_blocks", F.expr(f"source_size div {b}")).withColumn("passes", passes)
    s = s.withColumn("slots", F.col("passes") * F.col("blocks") + F.expr(f"(quota - passes * source_size + {b - 1}) div {b}"))
    s = s.withColumn("hi", F.sum("slots").over(one.rowsBetween(Window.unboundedPreceding, 0)))
    return s.select("sid", "source", "source_size", "target", "quota", "blocks", "full_blocks", "passes", "slots", (F.col("hi") - F.col("slots")).alias("lo"), "hi")


def _place(points: DataFrame, at: str, ranges: DataFrame, end: int, bins: int) -> DataFrame:
    """Join each point to the range [lo, hi) that holds it: an equi-join on bins of the axis."""
    width = max(1, -(-end // bins))
    cut = ranges.where("hi > lo").withColumn("_bin", F.explode(F.sequence(F.expr(f"lo div {width}"), F.expr(f"(hi - 1) div {width}"))))
    points = points.withColumn("_bin", F.expr(f"{at} div {width}"))
    return points.join(cut, "_bin").where((F.col(at) >= F.col("lo")) & (F.col(at) < F.col("hi"))).drop("_bin", "lo", "hi")


def _prefix(counts: DataFrame, key: str, step: str, value: str, out: str, chunk: int = 1024) -> DataFrame:
    """Exclusive running sum of ``value`` per ``key`` in the order of ``step``, in two levels of bounded windows."""
    counts = counts.withColumn("_chunk", F.expr(f"{step} div {chunk}"))
    inner = Window.partitionBy(key, "_chunk").orderBy(step).rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy(key).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    totals = counts.groupBy(key, "_chunk").agg(F.sum(value).alias("_sum"))
    totals = totals.select(key, "_chunk", F.coalesce(F.sum("_sum").over(outer), F.lit(0)).alias("_base"))
    counts = counts.withColumn("_in", F.coalesce(F.sum(value).over(inner), F.lit(0)))
    return counts.join(totals, [key, "_chunk"]).withColumn(out, F.col("_in") + F.col("_base")).drop("_chunk", "_in", "_base")


def permuted(index: Column, size: Column, key: Column, rounds: int = 24) -> Column:
    """A keyed pseudorandom permutation of [0, size): swap-or-not rounds, for any size.

    Each round pairs x with (k - x) mod size and swaps the pair or not by a bit that both
    members share, so every round, and hence the whole, is a bijection.
    """

    def step(x: Column, r: Column) -> Column:
        twin = F.pmod(F.pmod(unit(key, r, F.lit(1)), size) - x, size)
        swap = unit(key, r, F.greatest(x, twin)).bitwiseAND(F.lit(1)) == 1
        return F.when(swap, twin).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), index.cast("long"), step)


def numbered(rows: DataFrame) -> DataFrame:
    """Number the repeats of each row (``nth``, from 1), so that a row's place depends on its content alone.

    Repeats are equal, so it is of no account which gets which number; they are counted by the
    partition that read them, and a row that fills the table is spread over all of these.
    """
    rows = rows.withColumn("part", F.shiftright("row", 33))
    here = F.row_number().over(Window.partitionBy("same", "part").orderBy("row"))
    earlier = Window.partitionBy("same").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = rows.groupBy("same", "part").agg(F.count(F.lit(1)).alias("n")).select("same", "part", F.sum("n").over(earlier).alias("before")).where("before > 0")
    rows = rows.withColumn("nth", here).join(before, ["same", "part"], "left")
    return rows.withColumn("nth", F.col("nth") + F.coalesce("before", F.lit(0))).drop("part", "before")


def blocks(rows: DataFrame, plan: MixPlan) -> DataFrame:
    """Parts of documents by (sid, block): row, doc_id, first word in the document, place in the block, words."""
    b = plan.block_words
    rows = rows.where("size > 0").withColumn("bucket", F.pmod(F.xxhash64(F.lit(plan.seed), "same", "nth"), F.lit(plan.buckets)))
    totals = _prefix(rows.groupBy("sid", "bucket").agg(F.sum("size").alias("n")), "sid", "bucket", "n", "base")
    within = Window.partitionBy("sid", "bucket").orderBy("doc_id", "same", "nth").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inside", F.coalesce(F.sum("size").over(within), F.lit(0))).join(totals.select("sid", "bucket", "base"), ["sid", "bucket"])
    rows = rows.select("sid", "row", "doc_id", "size", (F.col("inside") + F.col("base")).alias("start"))
    rows = rows.withColumn("block", F.explode(F.sequence(F.expr(f"start div {b}"), F.expr(f"(start + size - 1) div {b}"))))
    low, high = F.greatest("start", F.col("block") * b), F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * b)
    return rows.select("sid", "block", "row", "doc_id", (low - F.col("start")).alias("first"), (low - F.col("block") * b).alias("place"), (high - low).alias("words"))


def deal(sources: DataFrame, spark, n_slots: int, plan: MixPlan) -> DataFrame:
    """Slots of the mix: shard, slot, sid, pass, block, and the words to take from the block's start."""
    slots = spark.range(n_slots).withColumnRenamed("id", "slot").withColumn("shard", F.expr(f"slot div {plan.shard_slots}"))
    slots = slots.withColumn("ticket", F.pmod(unit(F.col("slot"), seed=plan.seed), F.lit(max(1, n_slots))))
    drawn = stable(_place(slots, "ticket", sources.select("sid", "lo", "hi"), n_slots, plan.bins).drop("ticket"))
    counts = _prefix(drawn.groupBy("sid", "shard").agg(F.count(F.lit(1)).alias("n")), "sid", "shard", "n", "before")
    counts = stable(counts)
    rank = F.row_number().over(Window.partitionBy("sid", "shard").orderBy("slot")) - 1
    drawn = drawn.withColumn("rank", rank).join(counts.select("sid", "shard", "before"), ["sid", "shard"])
    drawn = stable(drawn.select("shard", "slot", "sid", (F.col("rank") + F.col("before")).alias("nth")))
    # settle: draws above a quota take the places that are still free, in order of the sources
    drew = counts.groupBy("sid").agg(F.sum("n").alias("drew"))
    book = sources.join(drew, "sid", "left").withColumn("drew", F.coalesce("drew", F.lit(0)))
    order = Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, -1)
    over, under = F.greatest(F.col("drew") - F.col("slots"), F.lit(0)), F.greatest(F.col("slots") - F.col("drew"), F.lit(0))
    book = book.withColumn("over_from", F.coalesce(F.sum(over).over(order), F.lit(0))).withColumn("lo", F.coalesce(F.sum(under).over(order), F.lit(0)))
    book = stable(book.withColumn("hi", F.col("lo") + under))
    drawn = drawn.join(book.select("sid", "slots", "over_from"), "sid")
    kept = drawn.where("nth < slots").select("shard", "slot", "sid", "nth")
    moved = drawn.where("nth >= slots").select("shard", "slot", (F.col("nth") - F.col("slots") + F.col("over_from")).alias("spare"))
    moved = _place(moved, "spare", book.select("sid", "drew", "lo", F.col("lo").alias("from"), "hi"), n_slots, plan.bins)
    moved = moved.select("shard", "slot", "sid", (F.col("drew") + F.col("spare") - F.col("from")).alias("nth"))
    out = kept.unionByName(moved).join(sources.select("sid", "blocks", "full_blocks", "slots", "quota", "source_size", "passes"), "sid")
    out = out.withColumn("pass", F.expr("nth div blocks")).withColumn("at", F.expr("nth % blocks"))
    mixed = permuted(F.col("at"), F.col("full_blocks"), F.struct(F.lit(plan.seed), F.col("sid"), F.col("pass")))
    out = out.withColumn("block", F.when(F.col("at") < F.col("full_blocks"), mixed).otherwise(F.col("at")))  # the short block ends each pass
    b = plan.block_words
    last = F.col("quota") - F.col("passes") * F.col("source_size") - F.col("at") * b  # words still open in the pass that is cut
    take = F.when(F.col("pass") < F.col("passes"), F.lit(b)).otherwise(F.least(F.lit(b), last))
    return out.select("shard", "slot", "sid", "pass", "block", take.alias("take"))


def mix(docs: DataFrame, plan: MixPlan = MixPlan(), id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", keep: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The mix of ``docs``: (rows, sources, slices).

    The mix depends on the rows alone, not on their order, files or partitions.

    ``rows`` has each input row with its size and a row number, ``sources`` the targets,
    ``slices`` what the mix takes: shard, slot, sid, pass, block, row, doc_id, first (word in
    the document), words.  Size is the number of words; a null text has none and is never
    taken.  A null source is a source of its own.  Repeated rows are separate documents.
    Columns named in ``keep`` stay in ``rows``; all others are ignored.  An empty table, or
    one without words, gives an empty mix and targets of 0.
    """
    named = dict.fromkeys((id_col, source_col, text_col, *keep))
    read = [docs[f"`{c}`"] for c in named if "map<" not in docs.schema[c].dataType.simpleString()]  # Spark does not hash maps
    same = F.xxhash64(*read, F.array(*[c.isNull() for c in read]))
    rows = docs.select(
        docs[f"`{id_col}`"].cast("long").alias("doc_id"), docs[f"`{source_col}`"].alias("source"), word_count(whole(docs[f"`{text_col}`"])).alias("size"),
        F.monotonically_increasing_id().alias("row"), same.alias("same"), *[docs[f"`{c}`"].alias(f"kept_{c}") for c in keep],
    )
    rows = stable(rows)
    sources = stable(source_targets(rows, plan))
    n_slots = sources.agg(F.max("hi")).first()[0] or 0
    named = sources.select("sid", F.col("source").alias("_s"))
    known = numbered(rows.select("doc_id", "source", "size", "row", "same")).join(named, F.col("source").eqNullSafe(F.col("_s"))).drop("_s", "source")
    slots = deal(sources, docs.sparkSession, n_slots, plan)
    slices = slots.join(blocks(stable(known), plan), ["sid", "block"])
    slices = slices.withColumn("words", F.least("words", F.col("take") - F.col("place"))).where("words > 0")
    return rows, sources, slices.select("shard", "slot", "sid", "pass", "block", "row", "doc_id", "first", "place", "words")


def mix_report(docs: DataFrame, plan: MixPlan = MixPlan(), **columns: str) -> DataFrame:
    """Per input row: doc_id, size, source_size, target of its source, and the words the mix takes of it."""
    rows, sources, slices = mix(docs, plan, **columns)
    taken = slices.groupBy("row").agg(F.sum("words").alias("taken"))
    named = sources.select(F.col("source").alias("_s"), "source_size", "target")
    out = rows.join(named, F.col("source").eqNullSafe(F.col("_s"))).join(taken, "row", "left")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, plan: MixPlan = MixPlan()) -> DataFrame:
    """The mix as documents: one row per document and pass with the words taken, in order, white space before each word kept."""
    others = [c for c in docs.columns if c not in ("doc_id", "source")]
    rows, _, slices = mix(docs, plan, keep=tuple(others))
    parts = slices.groupBy("row", "pass").agg(F.sort_array(F.collect_list(F.struct("first", "words"))).alias("parts"), F.sum("words").alias("n"))
    out = parts.join(rows, "row")
    words = F.regexp_extract_all("kept_text", F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), 0)
    cut = F.array_join(F.flatten(F.transform("parts", lambda p: F.slice("words", (p["first"] + 1).cast("int"), p["words"].cast("int")))), "")
    text = F.when(F.col("n") == F.col("size"), F.col("kept_text")).otherwise(cut)
    out = out.withColumn("words", F.when(F.col("n") < F.col("size"), words)).withColumn("text", text)
    fields = {c: F.col(f"`kept_{c}`") for c in others} | {"doc_id": F.col("doc_id"), "source": F.col("source"), "text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return out.select(*[fields[c].alias(c) for c in docs.columns])
