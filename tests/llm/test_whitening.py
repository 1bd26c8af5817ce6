"""Whitening against an eigendecomposition of the covariance in one piece."""

import math

import numpy as np
import pyarrow.parquet as pq
import pytest
from plumbline.llm import queries, whitening

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, label int, n int, component string"


def table(spark, rows):
    """Vectors with columns whose names clash with those of the result."""
    return spark.createDataFrame([(i, v, 0, 1, "c") for i, v in rows], SCHEMA)


def grid(vector):
    return [math.floor(64.0 * float(np.float32(c))) + 1_000_000 for c in vector]


def expected(rows):
    """(n, exact sums, eigenvalues, eigenvectors, trace) of the distinct grid vectors."""
    x = np.array(sorted({tuple(grid(v)) for _, v in rows}), dtype=object)
    n, sums = len(x), x.sum(axis=0)
    centred = ((x * n - sums) / n).astype(float)
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    return n, sums, values[::-1], vectors[:, ::-1], values.sum()


def check(rows, result, components=16):
    n, sums, values, vectors, trace = expected(rows)
    by_component = {}
    for r in result:
        by_component.setdefault(r["component"], []).append(r)
    assert set(by_component) == set(range(1, min(components, len(values)) + 1))
    vector_of = dict(rows)
    for k, found in by_component.items():
        assert len(found) == len(rows)
        want = {i: float(((np.array(grid(v), dtype=object) * n - sums) / n).astype(float) @ vectors[:, k - 1]) / math.sqrt(values[k - 1]) for i, v in rows}
        sign = np.sign(sum(r["whitened"] * want[r["vec_id"]] for r in found))
        for r in found:
            assert r["n"] == n
            assert r["deviation"] == int(((np.array(grid(vector_of[r["vec_id"]]), dtype=object) * n - sums) ** 2).sum())
            assert r["explained"] == pytest.approx(values[k - 1] / trace, rel=1e-9)
            assert r["whitened"] == pytest.approx(sign * want[r["vec_id"]], abs=1e-7)
            assert r["identity_error"] < 1e-9


def test_matches_eigendecomposition(spark):
    t = pq.read_table(f"{SF}/embeddings.parquet").to_pandas()
    rows = [(i, list(v)) for i, v in zip(t["vec_id"], t["embedding"]) if v is not None and np.isfinite(np.array(v, dtype=float)).all()]
    check(rows, queries.QUERIES["op12_embedding_whitening"](spark, SF).collect())


@pytest.mark.parametrize("spread", [1.0, 1e4])
def test_copies_count_once_and_scales_differ(spark, spread):
    """A third of all rows is one vector; dimensions differ in scale up to ``spread``."""
    rng = np.random.default_rng(1)
    base = rng.normal(size=(300, 5)) * np.geomspace(1, spread, 5) @ np.linalg.qr(rng.normal(size=(5, 5)))[0]
    rows = [(i, [float(np.float32(c)) for c in base[max(0, i - 150)]]) for i in range(450)]
    check(rows, whitening.whitened_vectors(table(spark, rows)).collect())


def test_fewer_components_are_asked_for(spark):
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(np.random.default_rng(2).normal(size=(80, 6)))]
    check(rows, whitening.whitened_vectors(table(spark, rows), components=3).collect(), components=3)


def test_dependent_and_constant_dimensions(spark):
    rng = np.random.default_rng(4)
    a, b = rng.integers(-40, 40, (2, 200)) / 64
    rows = [(i, [float(x), float(y), float(x + 2 * y), 0.5, float(-x)]) for i, (x, y) in enumerate(zip(a, b))]
    result = whitening.whitened_vectors(table(spark, rows)).collect()
    _, _, values, _, trace = expected(rows)
    assert {r["component"] for r in result} == {1, 2} and len(result) == 400
    for r in result:
        assert r["explained"] == pytest.approx(values[r["component"] - 1] / trace, rel=1e-9)
        assert r["identity_error"] < 1e-9


def test_nearly_dependent_dimensions_keep_their_component(spark):
    """Variances 10 orders of magnitude apart: the squared condition number would drown the smallest one."""
    rng = np.random.default_rng(6)
    a, b = rng.integers(-(10**6), 10**6, 400), rng.integers(-3, 4, 400)
    rows = [(i, [float(x) / 64, float(x + y) / 64]) for i, (x, y) in enumerate(zip(a, b))]
    result = whitening.whitened_vectors(table(spark, rows)).collect()
    assert {r["component"] for r in result} == {1, 2}
    assert max(r["identity_error"] for r in result) < 1e-6


def test_left_out_vectors(spark):
    nan, inf = float("nan"), float("inf")
    good = [(i, [float(i % 5), float(i % 3), float(i % 7)]) for i in range(40)]
    bad = [(100, None), (101, [nan, 0.0, 0.0]), (102, [0.0, inf, 0.0]), (103, [None, 1.0, 1.0]), (104, []), (105, [1.0, 2.0]), (106, [3e38, 0.0, 0.0])]
    result = whitening.whitened_vectors(table(spark, good + bad)).collect()
    check(good, result)
    assert {r["vec_id"] for r in result} == set(range(40))


def test_null_and_repeated_ids(spark):
    rows = [(None, [1.0, 2.0]), (None, [1.0, 2.0]), (3, [4.0, 1.0]), (3, [0.0, 0.0]), (4, [2.0, 7.0])]
    result = whitening.whitened_vectors(table(spark, rows)).collect()
    assert sorted(str(r["vec_id"]) for r in result) == sorted(["None"] * 4 + ["3"] * 4 + ["4"] * 2)
    assert {r["n"] for r in result} == {4}


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, [])]])
def test_nothing_to_whiten(spark, rows):
    result = whitening.whitened_vectors(table(spark, rows))
    assert result.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert result.count() == 0


def test_large_numbers_are_exact(spark):
    rows = [(1, [2.0**40, 0.0]), (2, [0.0, 2.0**20]), (3, [-(2.0**40), 5.0]), (4, [3.0, 4.0])]
    result = {r["vec_id"]: r["deviation"] for r in whitening.whitened_vectors(table(spark, rows)).collect()}
    n, sums, *_ = expected(rows)
    for i, v in rows:
        want = int(((np.array(grid(v), dtype=object) * n - sums) ** 2).sum())
        assert result[i] == (want if want < 1 << 63 else None)


def test_triangular_solve():
    rng = np.random.default_rng(0)
    r = np.triu(rng.normal(size=(6, 6))) + 4 * np.eye(6)
    rows = rng.normal(size=(9, 6))
    assert np.allclose(whitening.triangular_solve(rows, r) @ r, rows)
