"""Mixing, packing, chat, search and the pipeline."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pitfactors.llm import ann, chat, mixing, packing, queries


def filled(size, weight):
    """Targets by resharing the excess again and again."""
    left, stop = 1.5 * sum(size), {}
    while True:
        w = sum(x for i, x in enumerate(weight) if i not in stop)
        over = [i for i in range(4) if i not in stop and left * weight[i] / w > 2 * size[i]]
        if not over:
            break
        for i in over:
            stop[i] = 2 * size[i]
        left = 1.5 * sum(size) - sum(stop.values())
    return [stop.get(i, left * weight[i] / w) for i in range(4)]


def test_mix(spark):
    rows = [(i, "w " * (n // 5), s, "z") for s, n in (("a", 10), ("b", 1000), ("c", 500), (None, 40)) for i in range(5)]
    docs = spark.createDataFrame(rows + [(9, None, "c", "z"), (9, " ", "c", "z")], "doc_id long, text string, source string, taken string")
    plan = mixing.MixPlan(block_words=16, shard_slots=8)
    got = mixing.mix_report(docs, plan).collect()
    again = mixing.mix_report(docs, plan).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again)) and len(got) == 22 and all(r.taken <= 2 * r["size"] for r in got)
    by = {r.source_size: (r.target, sum(x.taken for x in got if x.source_size == r.source_size)) for r in got}
    for size, want in zip((10, 1000, 500, 40), filled([10, 1000, 500, 40], [5, 2, 1, 5])):
        assert by[size][0] == pytest.approx(want) and abs(by[size][1] - want) <= 1
    assert mixing.mix_report(docs.where("false")).count() == 0


def test_permutation(spark):
    for n in (1, 2, 7, 100):
        out = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n), F.lit(5)).alias("x")).collect()
        assert sorted(r.x for r in out) == list(range(n))


def test_mixed_documents_keep_words(spark):
    docs = spark.createDataFrame([(1, " a\tb  c\n", "s", 8, "en"), (2, "d e f g", "s", 7, "de")], "doc_id long, text string, source string, n_chars long, lang string")
    out = mixing.mixed_documents(docs, mixing.MixPlan(block_words=2))
    rows = out.collect()
    assert out.columns == docs.columns and sum(len(r.text.split()) for r in rows) == 11  # 150 % of 7 words, half up
    assert " a\tb  c\n" in [r.text for r in rows] and all(r.n_chars == len(r.text) for r in rows)


def test_pack_round_trip(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.vocabulary())
    t.encode_special_tokens = True
    texts = [None, "", " ", "a  b\n c", "the <|endoftext|> x", "é漢 字" * 40, "word " * 3000, "a" * 4000]
    docs = spark.createDataFrame([(i, x, 1) for i, x in enumerate(texts)] + [(3, texts[3], 1)], "doc_id long, text string, ids int").repartition(3)
    pieces = packing.pack(docs, queries.vocabulary()).collect()
    want = {i: [*t.encode(x or "", add_special_tokens=False).ids, 0] for i, x in enumerate(texts)}
    place = 0
    found = {}
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        assert p.sequence_id * 1024 + p.offset == place and p.length > 0 and p.offset + p.length <= 1024
        place += p.length
        ids = want[p.doc_id][p.start : p.start + p.length]
        assert p.doc_tokens == len(want[p.doc_id]) and p.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        found[p.doc_id] = found.get(p.doc_id, 0) + p.length
    assert found == {i: len(x) * (2 if i == 3 else 1) for i, x in want.items()}
    assert packing.pack(docs.where("false"), queries.vocabulary()).count() == 0


def test_chat(spark):
    rows = [
        (1, 0, "user", "a"), (2, 0, "user", "a"), (2, 1, "assistant", "b"), (3, 0, "user", "a"), (3, 1, "assistant", "b"), (3, 1, "assistant", "b"),
        (4, 5, "user", None), (4, None, None, "z"), (5, 0, "user", ""), (None, 0, "user", "q"),
    ]
    docs = spark.createDataFrame([(*r, "k") for r in rows], "conv_id long, turn long, role string, text string, key string")
    got = {r.conv_id: (r.n_turns, r.copies, r.text) for r in chat.chat_format(docs).collect()}
    assert set(got) == {2, 4, 5} and got[2][:2] == (2, 2) and got[4][2] == "<|im_start|>user\n<|im_end|>\n<|im_start|>unknown\nz<|im_end|>\n"
    assert chat.chat_format(docs.where("false")).count() == 0


def test_search_recall_and_ties(spark):
    r = np.random.default_rng(1)
    v = r.standard_normal((900, 24))
    v[100:140] = v[100]
    rows = [(i, [float(x) for x in row], "s") for i, row in enumerate(v)] + [(1000, None, "s"), (1001, [0.0] * 24, "s"), (1020, [float("nan")] * 24, "s"), (1040, [None] * 24, "s"), (1060, [1.0], "s")]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    got = ann.search(docs, F.col("vec_id") % 20 == 0, ann.Search(neighbours=5, block=200, query_block=16)).collect()
    hits = 0
    for q in range(0, 900, 20):
        score = [sum(a * b for a, b in zip(v[q], x)) for x in v]
        want = sorted((i for i in range(900) if i != q), key=lambda i: (-score[i], i))[:5]
        mine = [g.vec_id for g in sorted(got, key=lambda g: g["rank"]) if g.query_id == q]
        assert len(mine) == 5
        hits += len(set(mine) & set(want))
    assert hits >= 0.99 * 225 and {g.query_id for g in got} == set(range(0, 900, 20))
    assert ann.search(docs.where("false"), F.lit(True)).count() == 0


def test_pipeline(spark, sf):
    docs, seen = spark.read.parquet(f"{sf}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        if name != "packing":
            assert out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), out.schema)
        seen.append(docs.count())
    assert len(seen) == 5 and seen[0] >= seen[1] >= seen[2] > 0 and seen[4] >= seen[3]


def test_pack_gives_added_tokens_their_ids_like_the_package(spark, tmp_path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.vocabulary())
    texts = ["x<|endoftext|>y", "<|endoftext|>", "a  <|endoftext|> b <|endoftext|><|endoftext|>", "<|endoftext", "no token here", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    want = {i: [*t.encode(x or "", add_special_tokens=False).ids, 0] for i, x in enumerate(texts)}
    assert 50256 in want[0]
    for rows in (packing.pack(docs, queries.vocabulary(), added=True).collect(), queries.QUERIES["op9_pack"](spark, str(tmp_path)).collect()):
        assert {r.doc_id: (r.doc_tokens, r.ids_crc32) for r in rows} == {i: (len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in want.items()}


def test_pack_encodes_a_text_at_once_and_loads_the_vocabulary_once(monkeypatch):
    """Neither a call for each word nor a load for each task; long texts are cut only where token groups part."""
    t = packing.Tokeniser.load(queries.vocabulary(), added=True)
    text = "one  two\n three\t 's four<|endoftext|> five\u3000 six 漢字 " * 20
    want, plain, calls = t.encode(text), t._plain, []

    class Counting:
        def encode_ordinary(self, text):
            calls.append(text)
            return plain.encode_ordinary(text)

    t._plain = Counting()
    assert t.encode("all words of a text " * 50) and len(calls) == 1
    for size in (1, 7, 40):
        monkeypatch.setattr(packing, "PIECE_CHARS", size)
        assert t.encode(text) == want
    assert packing._tokeniser(queries.vocabulary(), True) is packing._tokeniser(queries.vocabulary(), True)


def test_mixing_plans_hold_each_step_once(spark):
    """Draws, counts and numbered rows are stored, so that the driver plans none of them for each reader."""
    docs = spark.createDataFrame([(i, "w x y z " * 9, s) for s in "abc" for i in range(9)], "doc_id long, text string, source string")
    plan = mixing.mixed_documents(docs, mixing.MixPlan(block_words=16, shard_slots=8))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") <= 8 and plan.count("Window ") <= 3
