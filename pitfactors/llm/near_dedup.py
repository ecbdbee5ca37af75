"""Near-duplicate documents by a signature-coordinate inverted join.

Every document becomes a set of word shingles and a MinHash signature.  Equal sets collapse
to one node first.  A node is posted under coordinate-value pairs of its signature; two nodes
at the threshold agree almost surely in ``least`` coordinates or more, so it suffices to post
the rarest ``coordinates - least + shared`` pairs of each node: any two such nodes then meet
in ``shared`` lists (prefix filter).  What many documents have in common, such as a shared
passage, is frequent and stays out of the prefix.

Lists of up to ``small`` members count the lists in which two nodes meet.  Longer lists are
not expanded into pairs: each links its members to a centre, a second round takes other
centres, and members that are still in different components after it are compared in blocks.
Wherever a pair comes from, too few collisions of the signatures skip it, and the others are
confirmed on the full shingle sets.  Two nodes that meet in a long list are compared there,
two that meet in short lists only have all their meetings counted, so no link is lost.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitfactors.functions.scale import stable
from pitfactors.llm.common import lookup, whole

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


@dataclass(frozen=True)
class Near:
    shingle: int = 5
    percent: int = 80  # links have 100 * |A and B| >= percent * |A or B|
    coordinates: int = 64
    least: int = 36  # collisions of a pair; at 80 % fewer happen with a probability near 1e-6
    shared: int = 4  # lists in which such a pair meets at least
    small: int = 8  # members of a list that is counted pair by pair
    counters: int = 1 << 18  # of the frequency sketch, whatever the input's size
    block: int = 2048  # members of a list compared at once in the last round
    dense: int = 4  # pairs a member from which a meeting is confirmed in place
    seed: int = 13

    @property
    def prefix(self) -> int:
        return self.coordinates - self.least + self.shared


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Shingler:
    """64-bit hashes of the shingles of UTF-8 texts, in pieces of bounded memory."""

    PIECE = 1 << 20

    def __init__(self, n: int):
        self.n = n
        self._up = self._down = np.ones(1, np.uint64)

    def _powers(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self._up) < size:
            self._up = np.cumprod(np.r_[np.uint64(1), np.full(size, _BASE)])
            self._down = np.cumprod(np.r_[np.uint64(1), np.full(size, _BACK)])
        return self._up, self._down

    def _words(self, data: np.ndarray) -> np.ndarray:
        """Hash of each word: a polynomial of its bytes, from prefix sums modulo 2^64."""
        gap = _SPACE[data]
        edge = np.flatnonzero(np.diff(np.r_[True, gap, True].view(np.int8)))
        start, end = edge[::2], edge[1::2]
        if not len(start):
            return np.empty(0, np.uint64)
        up, down = self._powers(len(data) + 1)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((_LOWER[data].astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
        return _mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def words(self, data: np.ndarray) -> np.ndarray:
        parts, at = [], 0
        while len(data) - at > self.PIECE:
            stop = at + self.PIECE
            while stop < len(data) and not _SPACE[data[stop]]:
                stop += 1
            parts.append(self._words(data[at:stop]))
            at = stop
        parts.append(self._words(data[at:]))
        return np.concatenate(parts) if len(parts) > 1 else parts[0]

    def set_of(self, data: np.ndarray) -> np.ndarray:
        """Sorted distinct shingles; with fewer words than a shingle, the whole sequence as one; none without words."""
        w = self.words(data)
        n = min(self.n, len(w))
        if not n:
            return w
        h = np.full(len(w) - n + 1, n, np.uint64)
        for i in range(n):
            h = _mix(h * _BASE + w[i : len(w) - n + 1 + i])
        return np.unique(h)


def _bytes(scalar: pa.Scalar) -> np.ndarray:
    return np.frombuffer(scalar.as_buffer() or b"", np.uint8)


def signature(shingles: np.ndarray, p: Near) -> np.ndarray:
    """Least value of each coordinate's hash, its upper 32 bits."""
    r = np.random.default_rng(p.seed)
    a = r.integers(0, 1 << 63, p.coordinates, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    b = r.integers(0, 1 << 63, p.coordinates, dtype=np.uint64)
    least = np.full(p.coordinates, np.iinfo(np.uint64).max)
    for at in range(0, len(shingles), 4096):
        part = shingles[at : at + 4096]
        np.minimum(least, (a[:, None] * part[None, :] + b[:, None]).min(axis=1), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)


def _keys(sigs: np.ndarray) -> np.ndarray:
    """Coordinate-value pairs as one long each."""
    return (np.arange(sigs.shape[1], dtype=np.uint64) << np.uint64(32) | sigs.astype(np.uint64)).astype(np.int64)


def _sign(p: Near):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(p.shingle)
        for batch in batches:
            sizes, ids, sigs = [], [], []
            for text in batch.column("text"):
                found = shingler.set_of(_bytes(text))
                sizes.append(len(found))
                ids.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest() if len(found) else None)
                sigs.append(signature(found, p).tobytes() if len(found) else None)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("ticket"), pa.array(sizes, pa.int64()), pa.array(ids, pa.binary()), pa.array(sigs, pa.binary())], names=["doc_id", "ticket", "n_shingles", "digest", "sig"])

    return run


def _matrix(column: pa.ChunkedArray | pa.Array, p: Near) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, p.coordinates)


def _counter_of(keys: np.ndarray, p: Near) -> np.ndarray:
    return (_mix(keys.astype(np.uint64)) & np.uint64(p.counters - 1)).astype(np.int64)


def _sketch(nodes: DataFrame, p: Near) -> np.ndarray:
    """How often coordinate-value pairs occur, in a fixed number of hashed counters; summed in two levels."""

    def count(batches):
        total = np.zeros(p.counters, np.int64)
        for batch in batches:
            if batch.num_rows:
                total += np.bincount(_counter_of(_keys(_matrix(batch.column("sig"), p)).ravel(), p), minlength=p.counters)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["counts"])

    def add(batches):
        total = np.zeros(p.counters, np.int64)
        for batch in batches:
            for row in batch.column("counts"):
                total += np.frombuffer(row.as_buffer(), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["counts"])

    parts = nodes.select("sig").mapInArrow(count, "counts binary").repartition(16).mapInArrow(add, "counts binary")
    return np.frombuffer(parts.coalesce(1).mapInArrow(add, "counts binary").first()["counts"], np.int64)


def _post(sketch, p: Near):
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = _keys(_matrix(batch.column("sig"), p))
            order = np.lexsort((keys, sketch.value[_counter_of(keys, p)]), axis=1)[:, : p.prefix]
            node = np.repeat(batch.column("node").to_numpy(), p.prefix)
            yield pa.RecordBatch.from_arrays([pa.array(np.take_along_axis(keys, order, axis=1).ravel()), pa.array(node)], names=["key", "node"])

    return run


def _weigh(sketch, p: Near):
    """How frequent a node's signature is as a whole."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                often = sketch.value[_counter_of(_keys(_matrix(batch.column("sig"), p)), p)].sum(axis=1)
                yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(often)], names=["node", "weight"])

    return run


def _collide(p: Near):
    """Keeps the pairs whose signatures agree in enough coordinates and whose sizes allow a link."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                same = (_matrix(batch.column("sig_a"), p) == _matrix(batch.column("sig_b"), p)).sum(axis=1)
                n, m = batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy()
                fits = (same >= p.least) & (100 * np.minimum(n, m) >= p.percent * np.maximum(n, m))
                yield batch.select(["a", "b"]).filter(pa.array(fits))

    return run


def _collisions(pairs: DataFrame, marks: DataFrame, p: Near) -> DataFrame:
    """The pairs (a, b) above the match threshold; ``marks`` has node, sig, n_shingles."""
    for side in ("a", "b"):
        pairs = pairs.join(marks.select(F.col("node").alias(side), F.col("sig").alias(f"sig_{side}"), F.col("n_shingles").alias(f"n_{side}")), side)
    return pairs.mapInArrow(_collide(p), "a long, b long")


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    low, high = sorted((len(a), len(b)))
    if 100 * low < percent * high:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _stars(p: Near):
    """Streams rows sorted by centre and group, the centre first: keeps one set, compares those that follow."""

    def run(batches):
        shingler, held, own = Shingler(p.shingle), None, None
        for batch in batches:
            left, right = [], []
            for a, part, b, text in zip(*(batch.column(c).to_pylist() for c in ("a", "part", "b")), batch.column("text")):
                found = shingler.set_of(_bytes(text))
                if a == b:
                    held, own = (a, part), found
                elif held == (a, part) and _linked(own, found, p.percent):
                    left.append(a)
                    right.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

    return run


def _confirm(pairs: DataFrame, texts: DataFrame, p: Near, group: int = 128) -> DataFrame:
    """Links among the pairs (a, b).  A node with many partners is copied to groups of bounded size."""
    sizes = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / group).cast("int").alias("parts"))
    pairs = pairs.join(sizes, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"))
    pairs = pairs.unionByName(pairs.select("a", "part").distinct().withColumn("b", F.col("a")))
    rows = pairs.join(texts.withColumnRenamed("node", "b"), "b").withColumn("first", F.col("a") != F.col("b"))
    rows = rows.repartition("a", "part").sortWithinPartitions("a", "part", "first").select("a", "part", "b", "text")
    return rows.mapInArrow(_stars(p), "a long, b long")


class _Forest:
    """Components of one meeting, to leave out pairs that are linked already."""

    def __init__(self, labels: np.ndarray):
        self.up = {c: c for c in labels.tolist()}

    def find(self, c: int) -> int:
        while self.up[c] != c:
            self.up[c] = self.up[self.up[c]]
            c = self.up[c]
        return c

    def join(self, a: int, b: int) -> None:
        self.up[self.find(a)] = self.find(b)


def _meet(p: Near, exact: bool):
    """Streams rows sorted by meeting and compares its members across components.

    A pair counts in the list of the first coordinate in which both are in one long list, and
    only with enough collisions.  Without ``exact`` the pairs are put out, but a meeting with
    more than ``dense`` of them for each member only by its name; with ``exact`` (rows have
    texts) the pairs are confirmed here and the links that merge components are put out.
    """

    def compare(key: int, rows: list[tuple]):
        _, comp, sig, size, lists, side, *_ = zip(*rows)
        sigs = np.frombuffer(b"".join(sig), np.uint32).reshape(-1, p.coordinates)
        side, size, lists, comp = np.array(side), np.array(size), np.array(lists, np.int64), np.array(comp)
        long = (lists[:, None] >> np.arange(p.coordinates) & 1).astype(bool)
        others = np.flatnonzero(side != 0)
        for i in np.flatnonzero(side != 1):
            rest = others[(comp[others] != comp[i]) & ((side[others] == 1) | (others > i))]
            rest = rest[100 * np.minimum(size[rest], size[i]) >= p.percent * np.maximum(size[rest], size[i])]
            same = sigs[rest] == sigs[i]
            rest, same = rest[hit := same.sum(axis=1) >= p.least], same[hit]
            if len(rest):
                yield i, rest[np.argmax(same & long[rest] & long[i], axis=1) == key >> 32]

    def result(place: tuple, rows: list[tuple], shingler: Shingler) -> list[tuple]:
        out: list[tuple] = []
        if exact:
            forest = _Forest(np.arange(len(rows)))
            first: dict[int, int] = {}
            for i, row in enumerate(rows):
                forest.join(i, first.setdefault(row[1], i))
            sets: dict[int, np.ndarray] = {}

            def shingles(i: int) -> np.ndarray:
                if i not in sets:
                    sets[i] = shingler.set_of(np.frombuffer(rows[i][6].encode(), np.uint8))
                return sets[i]

        for i, near in compare(place[0], rows):
            for j in near.tolist():
                if exact:
                    if forest.find(i) == forest.find(j) or not _linked(shingles(i), shingles(j), p.percent):
                        continue
                    forest.join(i, j)
                out.append((*place, rows[i][0], rows[j][0]))
                if not exact and len(out) > p.dense * len(rows):
                    return [(*place, None, None)]
        return out

    names = ["key", "kind", "x", "y", "a", "b"]
    types = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
    members = ["node", "comp", "sig", "n_shingles", "lists", "side", *(["text"] if exact else [])]

    def packed(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out)) or [()] * 6, types)], names=names)

    def run(batches):
        at, held, shingler = None, [], Shingler(p.shingle)
        for batch in batches:
            out: list[tuple] = []
            for row in zip(*(batch.column(c).to_pylist() for c in names[:4] + members)):
                if row[:4] != at:
                    if len(held) > 1:
                        out += result(at, held, shingler)
                    at, held = row[:4], []
                held.append(row[4:])
            yield packed(out)
        if len(held) > 1:
            yield packed(result(at, held, shingler))

    return run


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b) that is not a root; root is the least node of its component.

    Alternating large-star and small-star steps, until every node has one edge and to a root;
    each round writes its edges to the shared folder.
    """

    def star(pairs: DataFrame, large: bool) -> DataFrame:
        near = pairs.select(F.col("a").alias("u"), F.col("b").alias("v"))
        if large:
            near = near.unionByName(near.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = near.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        joined = near.join(low, "u")
        if large:
            return joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))  # repeats fall to the next step
        out = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(low.select(F.col("u").alias("a"), F.col("m").alias("b")))
        return out.where("a != b").distinct()

    def settled(pairs: DataFrame) -> bool:
        ends = pairs.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
        ends = ends.unionByName(pairs.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        found = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
        return found.where("up > 1 OR (up = 1 AND down = 1)").isEmpty()

    pairs = stable(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct())
    for _ in range(rounds):
        if settled(pairs):
            break
        pairs = stable(star(star(pairs, True), False))
    else:
        raise RuntimeError("components did not settle")
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_groups(docs: DataFrame, p: Near = Near(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id (least doc_id reachable by links), kept, ticket (hash of id and text).

    Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z.  ``kept`` marks the rows whose id
    is the component's.

    * A null, empty or blank text has no shingles and is linked with nothing.
    * Repeated rows share a component, and so do rows of any ids with one set.
    * A null id counts as larger than any other: it names a component only if no row in it has an id.
    * Other columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole(text_col).alias("text"))
    texts = texts.select("doc_id", F.xxhash64("doc_id", "text").alias("ticket"), "text")
    rows = stable(texts.mapInArrow(_sign(p), "doc_id long, ticket long, n_shingles long, digest binary, sig binary"))
    sets = rows.where("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("low"), F.min("ticket").alias("ticket"), F.min("n_shingles").alias("n_shingles"), F.first("sig").alias("sig"))
    nodes = stable(sets.withColumn("node", F.monotonically_increasing_id()))
    marks = nodes.select("node", "sig", "n_shingles")
    sketch = spark.sparkContext.broadcast(_sketch(nodes, p))
    posted = stable(nodes.select("node", "sig").mapInArrow(_post(sketch, p), "key long, node long"))
    sizes = posted.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    lists = stable(lookup(posted, sizes, "key").where("n is not null"))

    short = lists.where(F.col("n") <= p.small).select("key", "node")
    met = short.withColumnRenamed("node", "a").join(short.withColumnRenamed("node", "b"), "key").where("a < b")  # at most small - 1 partners a posting
    met = met.groupBy("a", "b").agg(F.count(F.lit(1)).alias("times")).where(F.col("times") >= p.shared).select("a", "b")
    counted = stable(_collisions(met, marks, p))

    long = lists.where(F.col("n") > p.small).select("key", "node")
    mask = F.expr("bit_or(shiftleft(1L, cast(shiftright(key, 32) as int)))")
    members = stable(long.groupBy("node").agg(mask.alias("lists")))
    weights = marks.join(members.select("node"), "node", "left_semi").select("node", "sig").mapInArrow(_weigh(sketch, p), "node long, weight long")
    used = members.select("node").unionByName(counted.select(F.col("a").alias("node"))).unionByName(counted.select(F.col("b").alias("node"))).distinct()
    wanted = nodes.select("node", "ticket").join(used, "node")
    bodies = stable(texts.select("ticket", "text").join(wanted, "ticket").dropDuplicates(["node"]).select("node", "text"))
    label = stable(used.select("node", F.col("node").alias("root")).join(weights, "node", "left"))

    def merged(found: DataFrame) -> DataFrame:
        """The labels after the links ``found``; those before stand for all earlier links."""
        every = found.unionByName(label.select(F.col("node").alias("a"), F.col("root").alias("b")))
        named = label.drop("root").join(components(every), "node", "left").withColumn("root", F.coalesce("root", "node"))
        return stable(named)

    for turn in range(2):
        here = stable(long.join(label, "node"))
        # the centre of a list: the member with the most frequent signature (copies share more with
        # their original than with each other), then any; its component comes along
        order = F.struct(F.col("weight") if turn == 0 else F.xxhash64(F.lit(turn), "node"), F.col("node").alias("a"), F.col("root").alias("ra"))
        centre = here.groupBy("key").agg(F.max(order).alias("best"), F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 != r1").select("key", "best.a", "best.ra")
        pairs = lookup(here, stable(centre), "key").where(F.col("root") != F.col("ra")).select("a", F.col("node").alias("b")).distinct()
        pairs = _collisions(pairs, marks, p)
        if turn == 0:
            pairs = pairs.unionByName(counted)
        label = merged(_confirm(stable(pairs), bodies, p))

    here = long.join(label.select("node", "root"), "node")
    # members of a list's largest component meet the others only; those meet each other too
    split = here.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"))
    top = split.groupBy("key").agg(F.max(F.struct("n", "root")).alias("top"), F.count(F.lit(1)).alias("roots"), F.sum("n").alias("members")).where("roots > 1")
    top = top.select("key", F.col("top.root").alias("main"), F.ceil(F.col("top.n") / p.block).cast("int").alias("main_blocks"), F.ceil((F.col("members") - F.col("top.n")) / p.block).cast("int").alias("rest_blocks"))
    apart = here.join(top, "key").withColumn("in_main", F.col("root") == F.col("main"))
    apart = apart.withColumn("place", F.pmod(F.xxhash64("node"), F.when(F.col("in_main"), F.col("main_blocks")).otherwise(F.col("rest_blocks"))).cast("int"))

    def meeting(part: DataFrame, blocks: str, kind: int, x, y, side) -> DataFrame:
        part = part.withColumn("other", F.explode(F.sequence(F.lit(0), F.col(blocks) - 1)))
        return part.select("key", "node", F.col("root").alias("comp"), F.lit(kind).alias("kind"), x.alias("x"), y.alias("y"), side.alias("side"))

    own, other = F.col("place"), F.col("other")
    within = F.when(own == other, 2).when(own < other, 0).otherwise(1)
    meetings = meeting(apart.where("in_main"), "rest_blocks", 1, own, other, F.lit(1))
    meetings = meetings.unionByName(meeting(apart.where("not in_main"), "main_blocks", 1, other, own, F.lit(0)))
    meetings = stable(meetings.unionByName(meeting(apart.where("not in_main"), "rest_blocks", 0, F.least(own, other), F.greatest(own, other), within)))
    place, schema = ["key", "kind", "x", "y"], "key long, kind int, x int, y int, a long, b long"
    full = meetings.join(marks.join(members, "node"), "node")
    dealt = stable(full.repartition(*place).sortWithinPartitions(*place).mapInArrow(_meet(p, False), schema))
    pairs = dealt.where("a is not null").select("a", "b").distinct()
    dense = full.join(dealt.where("a is null").select(*place), place).join(bodies, "node").repartition(*place).sortWithinPartitions(*place)
    found = _confirm(pairs, bodies, p).unionByName(dense.mapInArrow(_meet(p, True), schema).select("a", "b"))
    label = merged(found)

    named = nodes.select("digest", "node", "low").join(label.select("node", "root"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    ids = named.groupBy("root").agg(F.min("low").alias("component_id"))
    out = rows.join(named.join(ids, "root").select("digest", "component_id"), "digest", "left")
    component = F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), "ticket")


def without_near_copies(docs: DataFrame, p: Near = Near()) -> DataFrame:
    """The rows of ``docs``, all columns, that stand for their near-duplicate group."""
    kept = near_groups(docs, p).where("kept").select("ticket").distinct()
    ticket = F.xxhash64(docs["doc_id"].cast("long"), whole(docs["text"]))
    return docs.join(kept, ticket == kept["ticket"], "left_semi")
