"""Exact and near duplicates against brute force, with ties, nulls, repeats and empty tables."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from pitfactors.llm import near_dedup as near
from pitfactors.llm.common import lookup
from pitfactors.llm.exact_dedup import exact_dedup

SCHEMA = "doc_id long, text string, digest string, best string"


@pytest.fixture(scope="module")
def copies(spark):
    rows = [(1, "a b"), (2, "ab"), (3, "ba"), (None, None), (None, ""), (5, " "), (1, "a b"), (7, "ab   "), (8, "a  b\n"), (9, "c" * 50_000)]
    return rows, spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)


@pytest.mark.parametrize("digest", [None, F.length])
def test_exact_groups(copies, digest):
    rows, docs = copies
    got = exact_dedup(docs, digest=digest).collect()
    assert len(got) == len(rows)
    groups = {}
    for doc_id, text in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", text or ""), []).append((-len(text or ""), doc_id is None, doc_id or 0, doc_id))
    want = {hashlib.sha256(b.encode()).hexdigest(): (min(g)[3], len(g)) for b, g in groups.items()}
    for r in got:
        assert (r.keep_id, r.group_size) == want[r.text_sha256]
    assert sum(r.kept for r in got) == len(groups)


def test_empty_tables(spark, copies):
    none = copies[1].where("false")
    assert exact_dedup(none).count() == 0 and near.near_groups(none).count() == 0


def brute(rows, n, percent):
    sets = []
    for doc_id, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        sets.append({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), doc_id), doc_id)
    return sorted((doc_id, len(s), least[find(i)]) for i, ((doc_id, _), s) in enumerate(zip(rows, sets)))


@pytest.mark.parametrize("small, dense", [(8, 4), (2, 0)])
def test_near_groups_equal_brute_force(spark, small, dense):
    """Long lists, blocks and in-place confirmation are forced by the second setting."""
    r = random.Random(2)
    words = [f"w{i}" for i in range(400)]
    base = [[r.choice(words) for _ in range(r.choice((3, 30, 90, 300)))] for _ in range(12)]
    rows = [(i, " ".join(base[i % 12])) for i in range(12)]
    for i in range(12, 170):
        text = list(r.choice(base[:5] if i % 3 else base))
        for _ in range(r.choice((0, 1, 1, 2, 3, 6))):
            text[r.randrange(len(text))] = r.choice(words)
        rows.append((i, (" ".join(text)).title() if i % 7 == 0 else "\n".join(text)))
    rows += [(200, ""), (201, None), (202, "  "), (203, "one"), (204, "ONE"), (204, "ONE")]
    p = near.Near(shingle=4, small=small, dense=dense, block=16)
    got = near.near_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), p)
    assert sorted((x.doc_id, x.n_shingles, x.component_id) for x in got.collect()) == brute(rows, 4, 80)


def test_shingles_do_not_depend_on_pieces():
    import numpy as np

    data = np.frombuffer(("Ab  cd\té f " * 300).encode(), np.uint8)
    whole, cut = near.Shingler(3), near.Shingler(3)
    cut.PIECE = 64
    assert (whole.set_of(data) == cut.set_of(data)).all() and len(whole.set_of(data)) == 4


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (5, 5)], "a long, b long")
    got = {r.node: r.root for r in near.components(edges).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {101: 100}


def test_stars_take_no_round(spark, monkeypatch):
    """Edges that all lead to roots are stored once and left as they are."""
    calls, store = [], near.stable
    monkeypatch.setattr(near, "stable", lambda df: calls.append(1) or store(df))
    edges = spark.createDataFrame([(7, 1), (1, 8), (9, 1), (1, 9), (20, 30), (5, 5)], "a long, b long")
    assert {(r.node, r.root) for r in near.components(edges).collect()} == {(7, 1), (8, 1), (9, 1), (30, 20)} and len(calls) == 1


@pytest.mark.parametrize("least, joins", [(3, 2), (100, 1)])
def test_lookup_joins_each_row_once(spark, least, joins):
    """Hot rows meet broadcast facts, the rest is shuffled; no join runs over all rows to tell them apart."""
    rows = spark.createDataFrame([(k, i) for i, k in enumerate(["a"] * 20 + ["b"] * 5 + ["c", "d", None, None, None])], "k string, i long")
    facts = spark.createDataFrame([("a", 1), ("c", 3), ("z", 9), (None, 7)], "k string, fact long")
    out = lookup(rows, facts, "k", hot=10, least=least)
    assert sorted((r.i, r.fact or 0) for r in out.collect()) == [(i, 1 if i < 20 else 3 if i == 25 else 0) for i in range(30)]
    assert out.columns == ["k", "i", "fact"] and out._jdf.queryExecution().optimizedPlan().toString().count("Join") == joins
