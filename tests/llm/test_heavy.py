from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from keystrata.llm.heavy import SketchShape, heavy_hitters, sketch


def test_all_heavy_keys_with_exact_counts(spark):
    rng = np.random.default_rng(3)
    keys = ["hot"] * 4_000 + [f"k{int(x)}" for x in rng.zipf(1.2, 8_000) % 5_000] + [None] * 500 + [""] * 60
    df = spark.createDataFrame([(k, 1) for k in keys], "key string, n int").repartition(6)
    held = Counter(k for k in keys if k is not None)
    total = sum(held.values())
    got = {r.key: (r.n, r.total) for r in heavy_hitters(df, F.col("key"), 0.003).collect()}
    assert got == {k: (n, total) for k, n in held.items() if n >= 0.003 * total}


def test_estimates_are_near(spark):
    df = spark.createDataFrame([(f"k{i % 50}",) for i in range(5_000)], "key string")
    assert all(abs(r.approx_count - r.n) <= 10 for r in heavy_hitters(df, F.col("key"), 0.01).collect())


def test_ties_empty_and_sums(spark):
    df = spark.createDataFrame([("a",), ("b",), ("a",), ("b",)], "key string")
    assert sorted(r.key for r in heavy_hitters(df, F.col("key"), 0.5).collect()) == ["a", "b"]
    empty = spark.createDataFrame([], "key string")
    assert heavy_hitters(empty, F.col("key"), 0.1).count() == 0
    shape = SketchShape(depth=3, width_bits=8)
    assert shape.total(sketch(df, F.col("key"), shape)) == 4


def test_the_sketch_is_as_wide_as_the_share_needs(spark, monkeypatch):
    from keystrata.llm import heavy

    shapes = []
    whole = heavy.sketch
    monkeypatch.setattr(heavy, "sketch", lambda df, key, shape: shapes.append(shape.width_bits) or whole(df, key, shape))
    rows = [b"a"] * 900 + [b"b"] * 500 + [f"k{i % 4000}".encode() for i in range(20_000)]
    df = spark.createDataFrame([(k,) for k in rows], "key binary").repartition(6)
    narrow = heavy.SketchShape(5, 6)
    got = {r.key: r.n for r in heavy.heavy_hitters(df, F.col("key"), 0.01, shape=narrow).collect()}
    assert got == {b"a": 900, b"b": 500} and shapes[0] == 6 < shapes[-1]
    assert heavy.SketchShape.for_share(0.003).width_bits == 14 and heavy.SketchShape.for_share(1e-5).width_bits == 20
    monkeypatch.setattr(heavy.SketchShape, "MOST_BITS", 8)
    with pytest.raises(ValueError):
        heavy.heavy_hitters(df, F.col("key"), 0.002, shape=narrow)
    with pytest.raises(ValueError):
        heavy.heavy_hitters(df, F.col("key"), 0.0)
