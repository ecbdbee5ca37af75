import random

import pandas as pd
import pytest

from pitfactors.functions import ranks, scale


@pytest.fixture
def skewed(spark):
    """One group holds most rows and one value most of its ties; some values are missing."""
    rng = random.Random(3)
    rows = []
    for i in range(4000):
        g = "hot" if i % 3 else f"g{i % 5}"
        v = None if i % 97 == 0 else (0.0 if rng.random() < 0.4 else rng.gauss(0, 1))
        rows.append((g, f"s{i:05d}", v))
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "g string, symbol string, v double").repartition(7)


@pytest.mark.parametrize("descending", [False, True])
def test_split_ordinal_equals_window(skewed, descending):
    a = ranks.ordinal(skewed, ["g"], ["v", "symbol"], "rn", "n", descending, "window")
    b = ranks.ordinal(skewed, ["g"], ["v", "symbol"], "rn", "n", descending, "split", group_rows=200)
    x, y = (d.orderBy("symbol").toPandas() for d in (a, b))
    pd.testing.assert_frame_equal(x, y[x.columns], check_dtype=False)


def test_split_average_equals_window(skewed):
    ok = skewed.dropna()
    a = ranks.average(ok, ["g"], "v", "symbol", "r", "n", "window").orderBy("symbol").toPandas()
    b = ranks.average(ok, ["g"], "v", "symbol", "r", "n", "split").orderBy("symbol").toPandas()
    pd.testing.assert_frame_equal(a, b[a.columns], check_dtype=False)
    want = ok.toPandas()
    want["r"] = want.groupby("g")["v"].rank(method="average")
    assert (want.sort_values("symbol")["r"].to_numpy() == a["r"].to_numpy()).all()


def test_moments_agree(skewed):
    ok = skewed.dropna()
    a = ranks.moments(ok, ["g"], "v", "m", "s", "window").orderBy("symbol").toPandas()
    b = ranks.moments(ok, ["g"], "v", "m", "s", "split").orderBy("symbol").toPandas()
    pd.testing.assert_frame_equal(a, b[a.columns])


def test_quantiles_match_numpy(skewed):
    import numpy as np

    q = ranks.quantiles(skewed, ["g"], "v", "symbol", {"p10": 0.1, "med": 0.5, "p99": 0.99}).toPandas().set_index("g")
    for g, part in skewed.dropna().toPandas().groupby("g"):
        assert np.allclose(q.loc[g, ["p10", "med", "p99"]].to_numpy(float), np.percentile(part["v"], [10, 50, 99]))


def test_bucket_spreads_remainders(spark):
    n, b = 13, 5
    edges = [int(n * i / b) for i in range(b + 1)]
    want = [next(k for k in range(b) if edges[k] <= i < edges[k + 1]) for i in range(n)]
    from pyspark.sql import functions as F

    got = spark.range(1, n + 1).select(ranks.bucket(F.col("id"), F.lit(n), b).alias("b")).collect()
    assert [r["b"] for r in got] == want


def test_large_group_check_is_free_for_small_files(spark, sf):
    df = spark.read.parquet(f"{sf}/lineitem.parquet")
    assert 0 < scale.input_bytes(df) < scale.SMALL_INPUT_BYTES
    assert not scale.has_large_group(df, ["l_suppkey"])
    kept = scale.stable(df.select("l_suppkey"))
    assert scale.input_bytes(kept) < scale.SMALL_INPUT_BYTES and kept.count() == df.count()
