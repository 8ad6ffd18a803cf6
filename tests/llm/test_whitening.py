import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from kindling.llm import whitening as W
from kindling.llm.queries import op13_whitening


def by_definition(rows):
    """(x of each kept row, n, deviations, V's eigenvalues, eigenvectors, trace) with exact integers and a plain eigendecomposition."""
    kept = [(i, [math.floor(64 * float(c)) + 1_000_000 for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in kept})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    deviation = [sum((n * c - s) ** 2 for c, s in zip(x, sums)) for _, x in kept]
    centred = np.array([[(n * c - s) / n for c, s in zip(x, sums)] for x in fit])
    e, vec = np.linalg.eigh(centred.T @ centred / n)
    whole = np.array([[(n * c - s) / n for c, s in zip(x, sums)] for _, x in kept])
    return [i for i, _ in kept], n, deviation, e[::-1], vec[:, ::-1], whole


def check(spark, rows, got, components=16):
    ids, n, deviation, e, vec, centred = by_definition(rows)
    k = min(components, int((e > 1e-9 * max(e[0], 1e-300)).sum()))
    at = {}
    for r in got:
        at.setdefault(r.vec_id, []).append(r)
    assert sorted(r.vec_id for r in got) == sorted(i for i in ids for _ in range(k))
    want = centred @ vec[:, :k] / np.sqrt(e[:k])
    for j in range(k):
        ours = {r.vec_id: r.whitened for r in got if r.component == j + 1}
        theirs = dict(zip(ids, want[:, j]))
        first = max(theirs, key=lambda i: abs(theirs[i]))
        sign = np.sign(ours[first] * theirs[first])
        assert max(abs(ours[i] - sign * theirs[i]) for i in ids) < 1e-6
    told = dict(zip(ids, deviation))
    for r in got:
        assert r.n == n and r.deviation == told[r.vec_id]
        assert r.explained == pytest.approx(e[r.component - 1] / e.sum(), rel=1e-9)
        assert r.identity_error < 1e-9


def test_query_equals_the_definition(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    out = op13_whitening(spark, sf)
    assert [f"{f.name} {f.dataType.simpleString()}" for f in out.schema] == ["vec_id bigint", "component int", "n bigint", "deviation bigint", "whitened double", "explained double", "identity_error double"]
    check(spark, rows, out.collect())


def test_less_than_full_rank_and_ill_conditioned(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(300, 3)) * [1e6, 10, 1e-1]
    rows = [(i, [float(a), float(b), float(c), 0.5, float(np.floor(a * 64) / 64 * 2)]) for i, (a, b, c) in enumerate(base)]  # a constant, and a multiple
    got = W.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)).collect()
    assert {r.component for r in got} == {1, 2, 3}
    assert max(r.identity_error for r in got) < 1e-6
    x = np.floor(np.array([v for _, v in rows]) * 64)
    s = np.linalg.svd(x - x.mean(axis=0), compute_uv=False) ** 2  # a plain covariance does not tell the third from rounding
    assert [r.explained for r in sorted(got, key=lambda r: r.component)[::300]] == pytest.approx(s[:3] / s.sum(), rel=1e-6)


def test_factors_of_a_nearly_singular_matrix(spark):
    rng = np.random.default_rng(2)
    x = rng.integers(-1_000_000, 1_000_000, size=(400, 6))
    x[:, 5] = x[:, 4] * 3 + rng.integers(0, 2, size=400)  # one part in a million
    df = spark.createDataFrame([(r.tolist(),) for r in x], "x array<long>")
    fit = W.fit_whitening(df, 6)
    s = np.linalg.svd(x - x.mean(axis=0), compute_uv=False)
    assert np.allclose(np.sqrt(fit.eigenvalues * 400), s, rtol=1e-7)


def test_copies_odd_vectors_and_clashing_names(spark):
    v = [[1.0, 2.0], [1.001, 2.0], [-3.0, 0.5], [0.0, -7.25], [1.0, 2.0]]
    rows = [(i, x) for i, x in enumerate(v)] + [(4, v[4]), (None, [1.0, 2.0])]
    odd = [(7, None), (8, [1.0, None]), (9, [1.0, float("nan")]), (10, [float("inf"), 1.0]), (11, []), (12, [1.0, 2.0, 3.0]), (13, [1e300, 0.0])]
    df = spark.createDataFrame([(i, x, 0, 0, 0) for i, x in rows + odd], "vec_id long, embedding array<double>, x int, key int, n int").repartition(3)
    got = W.whiten(df).collect()
    assert len(got) == 2 * len(rows)
    assert {r.vec_id for r in got} == {0, 1, 2, 3, 4, None}
    assert {r.n for r in got} == {3}  # 1.001 and 1.0 are one x
    same = {(r.component, r.whitened, r.deviation) for r in got if r.vec_id in (0, 1, 4, None)}
    assert len(same) == 2
    check(spark, [r for r in rows[:4]], [r for r in got if r.vec_id is not None and r.vec_id < 4])


def test_large_deviations_are_exact_or_null():
    fit = W.Fit(10**9, [0], [1], np.eye(1), np.ones(1), 1.0)
    x = np.array([[3], [-2], [9_000_000_000]])
    d = [10**9 * int(v) - 1 for v in x[:, 0]]
    assert fit.deviations(x)[:, 0].tolist() == d
    assert W.squares(fit.deviations(x)) == [d[0] ** 2 if d[0] ** 2 < 1 << 63 else None, d[1] ** 2, None]


def test_nothing_to_fit(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert W.whiten(empty).count() == 0
    one = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<float>")
    assert W.whiten(one).count() == 0
    assert W.whiten(one.where("false").unionByName(one.limit(0))).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_hot_vector_counts_once(spark):
    hot = spark.range(3000).select(F.col("id").alias("vec_id"), F.when(F.col("id") % 3 == 0, F.array(F.lit(1.0), F.lit(2.0))).otherwise(F.array(F.col("id") / 7.0, -F.col("id") / 3.0 + F.col("id") % 5)).alias("embedding"))
    got = W.whiten(hot)
    assert got.count() == 6000
    assert got.first().n == 2001
