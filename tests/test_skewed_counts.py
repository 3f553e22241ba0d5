from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from factloom.operators import skewed_counts as S

SCHEMA = "a string, b string, d string, n_rows int, key string"


def counted(df):
    return S.skewed_counts(df, F.col("a"), F.col("b"), F.col("d"), ("a", "b"))


def brute(data):
    n, d = defaultdict(int), defaultdict(set)
    for a, b, c, *_ in data:
        if a and b:
            n[a, b] += 1
            if c is not None:
                d[a, b].add(c)
    return sorted((a, b, n[a, b], len(d[a, b])) for a, b in n)


def test_a_key_with_a_third_of_all_rows(spark):
    data = [("hot", "m", f"c{i % 97}", 1, "x") for i in range(4000)] + [(f"k{i % 900}", f"m{i % 7}", f"c{i % 11}", 1, "x") for i in range(8000)]
    got = counted(spark.createDataFrame(data, SCHEMA).repartition(5))
    assert sorted(map(tuple, got.collect())) == brute(data)


@pytest.mark.parametrize(
    "data",
    [
        [],
        [(None, "m", "c", 1, "x"), ("a", None, "c", 1, "x"), ("", "m", "c", 1, "x"), ("a", "", "c", 1, "x")],
        [("a", "m", None, 1, None)] * 3,
        [("a", "bc", "x", 1, "x"), ("ab", "c", "x", 1, "x"), ("1:a", "b", "x", 1, "x"), ("é漢", "😀", "x", 1, "x")],
        [("a" * 70_000, "m", "c", 1, "x")] * 2,
    ],
)
def test_defined_cases(spark, data):
    assert sorted(map(tuple, counted(spark.createDataFrame(data, SCHEMA)).collect())) == brute(data)


def test_small_split_dictionaries_change_nothing(spark, monkeypatch):
    data = [(f"k{i % 300}", "m", f"c{i % 13}", 1, "x") for i in range(3000)]
    acc = S.DenseAccumulator()
    import numpy as np
    import pyarrow as pa

    for at in range(0, 3000, 100):
        acc.add(pa.array([r[0] for r in data[at : at + 100]]), np.zeros(100, np.int32), 1, None)
        acc.merge()
    (block,) = acc.blocks()
    assert dict(zip(block.column("keys").flatten().to_pylist(), block.column("n_rows").flatten().to_pylist())) == {f"k{i}": 10 for i in range(300)}


def test_heavy_keys_keep_ties(spark, rows):
    df = spark.createDataFrame([("a", "m", 10, 1), ("b", "m", 10, 1), ("c", "m", 9, 1)], "a string, b string, n_rows bigint, n_distinct bigint")
    assert [r[0] for r in rows(S.heavy_keys(df, 1000, 100))] == ["a", "b"]
