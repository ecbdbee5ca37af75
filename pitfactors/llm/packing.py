"""Packing by concatenate and cut.

Pass 1 tokenises each document once and writes its ids with its place inside its partition.
Partition totals (one row per partition) give every partition a global offset.  Pass 2 adds
the offset, cuts the stream into fixed windows and emits a record for each piece, so a
document that crosses a boundary has several.  No row moves between partitions.
"""

from __future__ import annotations

import functools
import json
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pitfactors.functions.scale import stable
from pitfactors.llm.common import whole

#: Pre-tokenisation pattern of the byte-level vocabulary (a fixed value of its public format), without backtracking.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
#: Characters of a text that are encoded at once.
PIECE_CHARS = 1 << 20
#: Text bytes handed to a Python task at once, and the size of one output batch.
BATCH_IDS = 4_000_000


class Tokeniser:
    """Byte-level BPE ids as little-endian unsigned 32-bit bytes.

    A blank followed by a character that is not white space always starts a new token group,
    so long texts are cut before such blanks.  Strings of ``added`` tokens become their own ids
    wherever they stand, of several that start at one place the longest.
    """

    _cut = re.compile(r" (?=\S)")

    def __init__(self, vocabulary: dict[str, int], added: dict[str, int] | None = None):
        import tiktoken

        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        letter = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in set(plain))}
        byte = {c: b for b, c in letter.items()}
        ranks = {bytes(byte[c] for c in word): i for word, i in vocabulary.items() if all(c in byte for c in word)}
        self._plain = tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._added = {word: np.array([i], "<u4").tobytes() for word, i in (added or {}).items()}
        self._split = re.compile("(" + "|".join(map(re.escape, sorted(self._added, key=len, reverse=True))) + ")") if added else None

    @classmethod
    def load(cls, path: str, added: bool = False) -> Tokeniser:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        extra = spec.get("added_tokens", [])
        if added and any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in extra):
            raise ValueError("added tokens that depend on what stands around them are not supported")
        special = {t["content"]: t["id"] for t in extra}
        return cls({w: i for w, i in spec["model"]["vocab"].items() if w not in special}, special if added else None)

    def _ordinary(self, text: str) -> bytes:
        out, at = [], 0
        while at < len(text):
            cut = self._cut.search(text, at + PIECE_CHARS)
            stop = cut.start() if cut else len(text)
            out.append(np.array(array("I", self._plain.encode_ordinary(text[at:stop])), "<u4").tobytes())
            at = stop
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        if self._split and self._split.search(text):
            return b"".join(self._added.get(part) or self._ordinary(part) for part in self._split.split(text) if part)
        return self._ordinary(text)


@functools.lru_cache(maxsize=2)
def _tokeniser(path: str, added: bool) -> Tokeniser:
    """One for all tasks of a worker."""
    return Tokeniser.load(path, added)


def _tokens(path: str, end_id: int, added: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokeniser, part, at = _tokeniser(path, added), TaskContext.get().partitionId(), 0
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            ids: list[bytes] = []
            keys: list = []
            starts: list[int] = []
            held = 0

            def out():
                size = pa.array([len(b) // 4 for b in ids], pa.int64())
                return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([part] * len(ids), pa.int32()), pa.array(starts, pa.int64()), size, pa.array(ids, pa.binary())], names=["doc_id", "part", "start", "doc_tokens", "ids"])

            for key, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                doc = tokeniser.encode(text.as_py()) + end
                keys.append(key)
                ids.append(doc)
                starts.append(at)
                at += len(doc) // 4
                held += len(doc) // 4
                if held >= BATCH_IDS:
                    yield out()
                    ids, keys, starts, held = [], [], [], 0
            if ids:
                yield out()

    return run


def _cut(length: int):
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for key, start, size, ids in zip(batch.column("doc_id").to_pylist(), batch.column("start").to_pylist(), batch.column("doc_tokens").to_pylist(), batch.column("ids")):
                data = ids.as_buffer()
                for seq in range(start // length, (start + size - 1) // length + 1):
                    a, b = max(start, seq * length), min(start + size, (seq + 1) * length)
                    piece = data.slice((a - start) * 4, (b - a) * 4).to_pybytes()
                    rows.append((key, a - start, b - a, zlib.crc32(piece), size, seq, a - seq * length, piece))
            columns = list(zip(*rows)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if n == "ids" else pa.int64()) for n, c in zip(names, columns)], names=names)

    return run


def pack(docs: DataFrame, tokenizer: str, length: int = 1024, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", added: bool = False) -> DataFrame:
    """Pieces of the packed stream: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids, padded.

    ``ids`` are the token ids of the piece (little-endian unsigned 32-bit), ``padded`` the
    length its sequence gets: only the last sequence can be short; it is padded to ``length``
    unless it already ends at a power of two.  Each document is its ids and then ``end_id``.

    * A null or empty text is one piece that holds ``end_id`` alone.
    * Repeated rows, and rows without id, are documents of their own; other columns are ignored.
    * An empty table gives no pieces.
    * With ``added``, the strings of the vocabulary's added tokens become their ids, as the
      ``tokenizers`` package does by default; without, they are ordinary text.
    * The order of documents is the order of the input's partitions.

    ``tokenizer`` is the path of a byte-level vocabulary; workers need it at the same place.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole(text_col).alias("text"))
    ids = stable(rows.mapInArrow(_tokens(tokenizer, end_id, added), "doc_id long, part int, start long, doc_tokens long, ids binary"))
    totals = ids.groupBy("part").agg(F.sum("doc_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    # one row per partition of the input: a few megabytes even for a million partitions
    placed = ids.join(F.broadcast(totals), "part")
    total = ids.agg(F.sum("doc_tokens")).first()[0] or 0
    last, short = total // length, total % length
    cut = placed.select("doc_id", (F.col("start") + F.col("base")).alias("start"), "doc_tokens", "ids")
    pieces = cut.mapInArrow(_cut(length), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary")
    end = short if short & (short - 1) == 0 else length
    return pieces.withColumn("padded", F.when(F.col("sequence_id") == last, F.lit(end)).otherwise(F.lit(length)))
