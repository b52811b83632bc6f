"""Whitening against exact integers in Python and numpy's covariance."""

import math
import random

import numpy as np
import pandas as pd
import pytest

from ladle.llm import queries
from ladle.llm import whitening as W

SF = "/root/testdata/sf0.001"


def integers(vector):
    return [math.floor(1024 * c) + 100_000 for c in vector]


def check(got, rows, most):
    """got: (key, component) -> row; rows: key -> vector that counts."""
    x = {k: integers(v) for k, v in rows.items()}
    n, dim = len(x), len(next(iter(x.values())))
    sums = [sum(v[j] for v in x.values()) for j in range(dim)]
    centred = np.array([[(n * v[j] - sums[j]) / n for j in range(dim)] for v in x.values()])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    size = min(most, dim)
    assert set(got) == {(k, c) for k in x for c in range(1, size + 1)}
    assert len({r["identity_error"] for r in got.values()}) == 1
    for c in range(size):
        real = values[c] > 1e-12 * values.sum()
        want = centred @ vectors[:, c] / math.sqrt(values[c]) if real else np.zeros(n)
        own = np.array([got[k, c + 1]["whitened"] for k in x])
        sign = 1 if own @ want >= 0 else -1
        assert own * sign == pytest.approx(want, abs=1e-6)
    for k, v in x.items():
        r = got[k, 1]
        assert (r["n"], r["deviation"]) == (n, sum((n * a - s) ** 2 for a, s in zip(v, sums)))
        assert r["explained"] == pytest.approx(values[0] / values.sum())


def test_op13(spark):
    data = pd.read_parquet(f"{SF}/embeddings.parquet")
    rows = {i: [float(c) for c in v] for i, v in zip(data["vec_id"].tolist(), data["embedding"])}
    got = {(r["vec_id"], r["component"]): r for r in queries.queries()["op13_whitening"](spark, SF).collect()}
    check(got, rows, 8)
    assert all(r["identity_error"] <= 1e-4 for r in got.values())


def test_odd_rows_and_names(spark):
    rng = random.Random(4)
    rows = {i: [rng.gauss(0, 1), rng.gauss(5, 3), rng.uniform(-1000, 1000), -0.25] for i in range(300)}
    rows |= {1000 + i: [1.5, 2.0, 3.0, -0.25] for i in range(150)}
    odd = [(2000, None), (2001, []), (2002, [1.0, None, 2.0, 3.0]), (2003, [1.0, float("nan"), 2.0, 3.0]), (2004, [float("inf"), 0.0, 0.0, 0.0]), (2005, [1.0, 2.0])]
    data = [(i, v, "t", i, None, "x") for i, v in [*rows.items(), *odd]]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, whitened string, `my col` long, `n` int, `tick``s` string").repartition(5)
    got = W.whitened(df)
    assert got.columns == ["vec_id", "my col", "tick`s", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    found = {(r["vec_id"], r["component"]): r for r in got.collect()}
    check(found, rows, 8)
    assert all(r["my col"] == r["vec_id"] for r in found.values())
    assert {(r["vec_id"], r["component"]) for r in W.whitened(df, most=2).collect()} == {(i, c) for i in rows for c in (1, 2)}


def test_repeated_rows_null_ids_and_empty_tables(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [3.0, -2.0]), (None, [0.5, 0.0])], "vec_id long, embedding array<float>")
    got = W.whitened(df).collect()
    assert len(got) == 8 and {r["n"] for r in got} == {4} and max(r["identity_error"] for r in got) < 1e-9
    assert W.whitened(df.where("false")).collect() == []
    assert W.whitened(df.selectExpr("vec_id", "CAST(NULL AS ARRAY<FLOAT>) AS embedding")).collect() == []
    same = W.whitened(df.where("vec_id = 1")).collect()
    assert {(r["deviation"], r["whitened"], r["explained"]) for r in same} == {(0, 0.0, 0.0)}


def test_cross_products():
    rng = np.random.default_rng(3)
    for size, low, high in ((1, 0, 1), (63, -5, 5), (64, 0, 2**40), (200, -(2**50), 2**50)):
        values = rng.integers(low, high, (size, 4))
        want = [[sum(int(a) * int(b) for a, b in zip(values[:, i], values[:, j])) for j in range(4)] for i in range(4)]
        assert W.cross_products(values).tolist() == want
    assert W.cross_products(np.full((5, 2), 7)).tolist() == [[245, 245], [245, 245]]


def test_very_large_entries(spark):
    df = spark.createDataFrame([(1, [1e300, 1.0]), (2, [-1e300, 2.0]), (3, [2.0**55, 0.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="range of doubles"):
        W.whitened(df).collect()
    got = W.whitened(df.where("vec_id = 3").union(spark.createDataFrame([(4, [0.0, 1.0])], df.schema))).collect()
    assert {r["deviation"] for r in got} == {None} and {round(abs(r["whitened"]), 6) for r in got if r["component"] == 1} == {1.0}
