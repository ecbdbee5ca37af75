"""Prefix trie of conversations by fixed-length block hashing.

A conversation is cut into blocks of a few turns, and each block has one digest.  The digests
of successive blocks, summed position by position, give every block the identity of the path
that leads to it, so conversations are grouped block by block in one shuffle.  Only where a
path is followed by different blocks (siblings diverge) are these blocks, once each and not
once per conversation, opened and their turns compared; a block without siblings is a chain
whose turns all have the members of the block.

Three facts make subtree figures plain sums over members, without walking the tree.  Each
node belongs to its smallest member; a conversation owns the end of its own path from some
depth on; and of the tokens that a subtree saves, a conversation accounts for those on its
path from the subtree's top to the depth where it starts to own.

Texts never move: they are hashed where they are read.  Turns are numbered over sorted ranges
that may cut a conversation anywhere, blocks and path sums are grouped by parts of a
conversation, and lookups by a key that may be hot broadcast the few hot keys.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitfactors.functions.scale import stable
from pitfactors.llm.common import lookup, short_hash, whole


@dataclass(frozen=True)
class Trie:
    block: int = 4  # turns of a block
    chunk: int = 512  # blocks of one part of a conversation, in path sums
    ids: int = 4096  # conversation ids in one piece of text to be hashed


# --- numbering ---------------------------------------------------------------------------


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number the rows of each conversation within the sorted partition."""
    part, last, held = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        conv = batch.column("conv_id").to_numpy()
        at = np.arange(len(conv))
        first = np.flatnonzero(np.concatenate([[True], conv[1:] != conv[:-1]]))
        run = np.repeat(first, np.diff(np.append(first, len(conv))))
        place = at - run + 1
        if conv[0] == last:
            place[run == 0] += held
        last, held = conv[-1], int(place[-1])
        yield pa.RecordBatch.from_arrays(
            [batch.column("conv_id"), pa.array(np.full(len(conv), part), pa.int32()), pa.array(place, pa.int64()), batch.column("digest"), batch.column("bytes")],
            names=["conv_id", "part", "place", "digest", "bytes"],
        )


def numbered(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Turns of each conversation in order: conv_id, pos (from 1), digest of role and text, bytes of the text.

    Ranges of (conversation, turn) are sorted apart, so a conversation of any size is spread;
    a range starts inside at most one conversation, so fewer offsets than ranges are broadcast.
    """
    role, text = whole(role_col), whole(text_col)
    digest = short_hash(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))
    rows = turns.where(F.col(conv_col).isNotNull()).select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), digest.alias("digest"), F.octet_length(text).cast("long").alias("bytes"))
    spread = F.xxhash64(F.monotonically_increasing_id())  # rows that agree in all else may fall to any range
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("digest"), F.col("spread")]
    rows = rows.withColumn("spread", spread).repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "digest", "bytes")
    rows = stable(rows.mapInArrow(_number, "conv_id long, part int, place long, digest binary, bytes long"))
    held = rows.groupBy("conv_id", "part").agg(F.max("place").alias("held"))
    before = F.sum("held").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    moved = held.select("conv_id", "part", before.alias("before")).where("before > 0")
    rows = rows.join(F.broadcast(moved), ["conv_id", "part"], "left")
    return rows.select("conv_id", (F.col("place") + F.coalesce("before", F.lit(0))).alias("pos"), "digest", "bytes")


def conversations(turns: DataFrame) -> DataFrame:
    """Numbered turns as conversations for ``trie``: conv_id, length, depth, digest, bytes."""
    sizes = stable(turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("length")))
    return lookup(turns, sizes, "conv_id").select("conv_id", "length", F.col("pos").alias("depth"), "digest", "bytes")


def rebuilt(turns: DataFrame, group: int = 5, heads: int = 9) -> tuple[DataFrame, DataFrame]:
    """Conversations that share heads: (conversations with their length, rows like ``conversations``).

    Conversation c takes the first h turns of conversation c - c % group, h being the CRC-32
    of its decimal id modulo ``heads`` (fewer if that has fewer, none if it is absent), then
    its own turns behind its first h.  ``%`` keeps the sign of c.
    """
    head = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(heads))
    convs = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).withColumn("head", head).withColumn("base", F.col("conv_id") - F.col("conv_id") % group)
    convs = stable(convs)
    bases = convs.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    taken = F.least("head", F.coalesce("base_n", F.lit(0)))
    convs = convs.join(bases, "base", "left").withColumn("taken", taken)
    length = F.col("taken") + F.greatest(F.col("n") - F.col("head"), F.lit(0))
    convs = stable(convs.select("conv_id", "base", "taken", length.alias("length"), (F.col("head") - F.col("taken")).alias("shift")))
    heads_of = turns.where(F.col("pos") < heads).withColumnRenamed("conv_id", "base").join(convs.where("taken > 0"), "base").where("pos <= taken")
    own = lookup(turns.where(F.col("pos") > head), convs.select("conv_id", "length", "shift"), "conv_id")
    rows = heads_of.select("conv_id", "length", F.col("pos").alias("depth"), "digest", "bytes")
    return convs.select("conv_id", "length"), rows.unionByName(own.select("conv_id", "length", (F.col("pos") - F.col("shift")).alias("depth"), "digest", "bytes"))


# --- blocks ------------------------------------------------------------------------------

_SLICES = ("s0", "s1", "s2", "s3")


def _path(k: Column, *sums: Column) -> Column:
    """Identity of a path of k blocks: the sum of its position-keyed digests, 128 bits in four slices."""
    return short_hash(F.concat_ws(",", k.cast("string"), *[F.pmod(s, F.lit(1 << 32)).cast("string") for s in sums]))


def _inside(path: Column, digests: Column) -> Column:
    """Identity of a node inside the block behind ``path``, from the digests up to it."""
    return short_hash(F.aggregate(digests, path, lambda a, d: F.concat(a, d)))


def blocks(rows: DataFrame, t: Trie) -> DataFrame:
    """Blocks of conversations: conv_id, k, turns, path, after (path behind a full block), edge, start (bytes before), size, ends, end_key."""
    b = F.expr(f"(depth - 1) div {t.block}")
    cut = rows.withColumn("k", b).groupBy("conv_id", "k").agg(F.sort_array(F.collect_list(F.struct("depth", "digest", "bytes"))).alias("turns"), F.max("length").alias("length"))
    digests = F.transform("turns", lambda x: x["digest"])
    cut = cut.withColumn("digest", short_hash(F.aggregate(digests, F.lit("").cast("binary"), lambda a, d: F.concat(a, d))))
    cut = cut.withColumn("size", F.aggregate("turns", F.lit(0).cast("long"), lambda a, x: a + x["bytes"]))
    low = lambda x: x.bitwiseAND(F.lit((1 << 32) - 1))
    keyed = [F.xxhash64(F.lit(seed), "k", "digest") for seed in (1, 2)]
    slices = [low(keyed[0]), low(F.shiftrightunsigned(keyed[0], 32)), low(keyed[1]), low(F.shiftrightunsigned(keyed[1], 32))]
    cut = cut.select("*", *[s.alias(n) for n, s in zip(_SLICES, slices)], F.expr(f"k div {t.chunk}").alias("chunk"))
    summed = [*_SLICES, "size"]
    # sums before each block: inside its chunk of the conversation, and over the chunks before
    totals = cut.groupBy("conv_id", "chunk").agg(*[F.sum(c).alias(c) for c in summed])
    earlier = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("conv_id", "chunk", *[F.sum(c).over(earlier).alias(f"{c}_far") for c in summed]).where("chunk > 0")
    inside = Window.partitionBy("conv_id", "chunk").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    cut = cut.select("*", *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"{c}_near") for c in summed]).join(totals, ["conv_id", "chunk"], "left")
    before = {c: F.col(f"{c}_near") + F.coalesce(F.col(f"{c}_far"), F.lit(0)) for c in summed}
    path = _path(F.col("k"), *[before[c] for c in _SLICES])
    after = _path(F.col("k") + 1, *[before[c] + F.col(c) for c in _SLICES])
    cut = cut.select("conv_id", "k", "turns", path.alias("path"), after.alias("after"), "digest", before["size"].alias("start"), "size", (F.col("k") == F.expr(f"(length - 1) div {t.block}")).alias("ends"))
    end = F.when(F.size("turns") == t.block, F.col("after")).otherwise(_inside(F.col("path"), F.transform("turns", lambda x: x["digest"])))
    return cut.select("conv_id", "k", "turns", "path", "after", short_hash(F.concat("path", "digest")).alias("edge"), "start", "size", "ends", end.alias("end_key"))


def _opened(edges: DataFrame, t: Trie) -> DataFrame:
    """One row per turn of each distinct block: edge, alone, key, parent, depth, bytes, before (bytes of the path above)."""
    digests = F.transform("turns", lambda x: x["digest"])

    def key(i: Column) -> Column:
        return F.when(i == 0, F.col("path")).when(i == t.block, F.col("after")).otherwise(_inside(F.col("path"), F.slice(digests, 1, i)))

    def node(x: Column, i: Column) -> Column:
        above = F.aggregate(F.slice("turns", 1, i), F.col("start"), lambda a, y: a + y["bytes"])
        return F.struct(key(i + 1).alias("key"), key(i).alias("parent"), x["depth"].alias("depth"), x["bytes"].alias("bytes"), above.alias("before"))

    return edges.select("edge", "alone", F.explode(F.transform("turns", node)).alias("n")).select("edge", "alone", "n.*")


def _nodes(opened: DataFrame, figures: DataFrame, sums: dict[str, Column]) -> DataFrame:
    """Nodes with figures of their blocks: taken over where a block has no siblings, combined by turn where it has."""
    rows = opened.join(figures, "edge")
    fixed = ["parent", "depth", "bytes", "before"]
    chain = rows.where("alone").select("key", *fixed, *sums)
    refined = rows.where(~F.col("alone")).groupBy("key").agg(*[F.first(c).alias(c) for c in fixed], *[s.alias(c) for c, s in sums.items()])
    return chain.unionByName(refined)


# --- ends --------------------------------------------------------------------------------


def _pieces(size: int):
    """Ids of each key, joined in order, in pieces of at most ``size`` ids; the rows come sorted by key and id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, out = None, [], []

        def flush():
            if ids:
                out.append((key, ids[0], ",".join(map(str, ids))))

        for batch in batches:
            for k, c in zip(batch.column("key").to_pylist(), batch.column("conv_id").to_pylist()):
                if k != key or len(ids) == size:
                    flush()
                    key, ids = k, []
                ids.append(c)
            yield _batch(out)
            out = []
        flush()
        yield _batch(out)

    def _batch(rows):
        a, b, c = zip(*rows) if rows else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.int64()), pa.array(c, pa.string())], names=["key", "first", "text"])

    return run


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each key's pieces, comma-joined, as they stream by in order."""
    key, state, out = None, None, []
    for batch in batches:
        for k, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist()):
            if k != key:
                if state:
                    out.append((key, state.hexdigest()))
                key, state = k, sha256(text.encode())
            else:
                state.update(f",{text}".encode())
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.binary()), pa.array([x for _, x in out], pa.string())], names=["key", "ends_sha256"])
        out = []
    if state:
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([state.hexdigest()])], names=["key", "ends_sha256"])


def end_hashes(ends: DataFrame, t: Trie) -> DataFrame:
    """key, ends_sha256 of rows (key, conv_id).

    A SHA-256 is computed from front to back, so the ids of one node must pass through one
    task; they do so as a stream of pieces built in parallel, never as a group in memory.
    """
    pieces = ends.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id").mapInArrow(_pieces(t.ids), "key binary, first long, text string")
    return pieces.repartition("key").sortWithinPartitions("key", "first").mapInArrow(_hashes, "key binary, ends_sha256 string")


# --- trie --------------------------------------------------------------------------------


def trie(convs: DataFrame, rows: DataFrame, t: Trie = Trie()) -> DataFrame:
    """Nodes of the trie over conversations (conv_id, length) with turns (conv_id, length, depth, digest, bytes).

    Per node: conv_id (smallest member), depth, parent_conv_id (null for the root), n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256 and key.  Conversations without turns are
    members of the root.  Without any conversation there is no node.
    """
    cut = stable(blocks(rows, t))
    shape = ["path", "after", "turns", "start"]
    edges = cut.groupBy("edge").agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id"), *[F.first(c).alias(c) for c in shape])
    edges = stable(edges)
    alone = edges.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.min("edge").alias("edge")).where("n = 1").select("edge", F.lit(True).alias("alone"))
    opened = stable(_opened(edges.join(alone, "edge", "left").withColumn("alone", F.col("alone").isNotNull()), t))
    members = {"n_convs": F.sum("n_convs"), "conv_id": F.min("conv_id")}
    nodes = _nodes(opened, edges.select("edge", *members), members)
    top = short_path(rows.sparkSession)
    every = convs.agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id")).where("n_convs > 0")
    root = every.select(F.lit(top).alias("key"), F.lit(None).cast("binary").alias("parent"), *[F.lit(0).cast("long").alias(c) for c in ("depth", "bytes", "before")], "n_convs", "conv_id")
    nodes = stable(nodes.unionByName(root))
    children = nodes.where(F.col("parent").isNotNull()).groupBy(F.col("parent").alias("key")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = stable(nodes.join(children, "key", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))))

    # what each conversation adds to the nodes above the depth from which it owns its path
    owned = nodes.groupBy("conv_id").agg(F.min(F.struct("depth", "before"))["before"].alias("owned_from"), F.max((F.col("n_children") == 0).cast("long")).alias("leaf"))
    whole_path = cut.where("ends").select("conv_id", (F.col("start") + F.col("size")).alias("bytes"))
    shares = convs.select("conv_id").join(owned, "conv_id", "left").join(whole_path, "conv_id", "left")
    shares = stable(shares.select("conv_id", F.coalesce("owned_from", "bytes", F.lit(0)).alias("shared"), F.coalesce("leaf", F.lit(0)).alias("leaf")))
    known = lookup(cut.select("conv_id", "edge"), shares, "conv_id")
    total = {"shared": F.sum("shared"), "n_leaves": F.sum("n_leaves"), "least": F.min("least")}
    per_edge = known.withColumn("n_leaves", F.col("leaf")).withColumn("least", F.struct("conv_id", F.col("shared").alias("own")))
    per_edge = per_edge.groupBy("edge").agg(*[s.alias(c) for c, s in total.items()])
    sums = _nodes(opened, per_edge, total).select("key", *total)
    at_root = shares.agg(F.sum("shared").alias("shared"), F.sum("leaf").alias("n_leaves"), F.min(F.struct("conv_id", F.col("shared").alias("own"))).alias("least"))
    sums = sums.unionByName(at_root.where("shared IS NOT NULL").select(F.lit(top).alias("key"), *total))

    ends = cut.where("ends").select(F.col("end_key").alias("key"), "conv_id").unionByName(convs.where("length = 0").select(F.lit(top).alias("key"), "conv_id"))
    saved = F.col("shared") - F.col("least.own") - (F.col("n_convs") - 1) * F.col("before")
    out = nodes.join(sums, "key").join(end_hashes(ends, t), "key", "left")
    out = out.select(
        "key", "parent", "conv_id", "depth", "n_convs", "n_children", "n_leaves", saved.alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(sha256().hexdigest())).alias("ends_sha256"),
    )
    parents = nodes.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    return lookup(stable(out), parents, "parent").select("key", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def short_path(spark) -> bytes:
    """Key of the root: the path of no block."""
    return bytes(spark.range(1).select(_path(F.lit(0), *[F.lit(0)] * 4).alias("x")).first()["x"])


def prefix_trie(turns: DataFrame, t: Trie = Trie(), **columns: str) -> DataFrame:
    """Trie of the conversations as they are logged; see ``trie`` for the columns and ``shared_trie`` for the cases."""
    rows = conversations(numbered(turns, **columns))
    sizes = rows.groupBy("conv_id").agg(F.max("length").alias("length"))
    return trie(stable(sizes), rows, t)


def shared_trie(turns: DataFrame, t: Trie = Trie(), **columns: str) -> DataFrame:
    """Trie of conversations rebuilt with shared heads (``rebuilt``).

    * Turns are ordered by number, null first; rows that share a number by the hash of role
      and text.  Repeated rows are turns of their own.  A null role or text counts as empty,
      and a turn is equal to another in role and text, not in number.
    * Rows without a conversation id belong to no conversation and are left out.
    * A rebuilt conversation without turns is a member of the root.  Equal conversations share
      all nodes.  Texts of any length count by their UTF-8 bytes.
    * Other columns are ignored; an empty table gives no rows.
    """
    return trie(*rebuilt(numbered(turns, **columns)), t)
