import numpy as np
import pytest
from pyspark.sql import functions as F

from kindling.operators import discovery, ideas
from kindling.operators.pivots import Cells, Tiles, farthest_first

ROWS, QUERIES = "row long, v array<double>", "query long, v array<double>"


def clustered(n, of, dim, seed):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(of, dim))
    return middle[rng.integers(of, size=n)] + 0.05 * rng.normal(size=(n, dim))


def wanted(rows, queries, k):
    """Per query key the k best (cosine to six places, row key) over all pairs of vectors of one length."""
    out = {}
    unit = lambda v: np.array(v) / max(np.linalg.norm(v), 1e-300)
    rows = [(i, unit(v)) for i, v in rows]
    for q, v in queries:
        u = unit(v)
        found = [(-round(float(u @ x), 6) + 0.0, i) for i, x in rows if len(x) == len(u)]
        out[q] = sorted(out.get(q, []) + sorted(found)[:k])[:k]
    return out


def given(found, k):
    out = {}
    for r in found.collect():
        out.setdefault(r.query, []).append((-round(r.cosine, 6) + 0.0, r.row))
    return {q: sorted(x)[:k] for q, x in out.items()}


@pytest.fixture
def tiny(monkeypatch):
    for name, value in (("MAX_QUERIES", 16), ("TILE_ROWS", 40), ("LEAST_ROWS", 10), ("TILES", 20), ("MAX_CELLS", 500)):
        monkeypatch.setattr(discovery, name, value)


@pytest.mark.parametrize("k", [1, 7])
@pytest.mark.parametrize("kind", ["clusters", "noise", "copies"])
def test_search_by_brute_force(spark, tiny, kind, k):
    v = np.random.default_rng(4).normal(size=(500, 8)) if kind == "noise" else clustered(500, 12, 8, 4)
    if kind == "copies":
        v[:200] = v[0]  # a tile of equal rows is cut by a hash
    v = [x.tolist() for x in v] + [[0.0] * 8] * 3 + [[1.0, 2.0, 3.0], [0.0, 0.0, 0.0], [-3.0, 1.0, 2.0], [2.0]]
    rows = [(3 * i % 1009, x) for i, x in enumerate(v)] + [(5, v[5]), (5, v[5])]
    queries = [(i, x) for i, x in enumerate(v) if i % 2 or i > 490] + [(1, v[400]), (1, v[0])] + [(900, [1.0] * 5)]
    got = given(discovery.search(spark.createDataFrame(rows, ROWS).repartition(5), spark.createDataFrame(queries, QUERIES).repartition(3), k), k)
    want = {q: x for q, x in wanted(rows, queries, k).items() if x}
    assert set(got) == set(want)
    for q, x in want.items():
        assert [c for c, _ in got[q]] == pytest.approx([c for c, _ in x], abs=1.1e-6)
    assert sum(got[q] == x for q, x in want.items()) >= 0.99 * len(want)  # a last place may be rounded otherwise


def test_most_tiles_are_passed_over_in_clusters(spark, tiny):
    v = clustered(2000, 20, 16, 1)
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], ROWS)
    cells, each = discovery._cells_of(rows, 2000)
    tiled, tiles = discovery._tiled(rows, cells, each)
    assert tiled.groupBy("tile").count().agg(F.max("count")).first()[0] <= 3 * each
    queries = tiled.select(F.col("row").alias("query"), "v").where("query % 3 = 0")
    first = discovery._visits(queries, tiles, 5)
    later = discovery._visits(first.select("query", "v", F.col("tiles").alias("seen"), F.lit(0.97).alias("least")), tiles, 5)
    met = later.select(F.avg(F.size("seen") + F.size("tiles"))).first()[0]
    assert met < 0.25 * len(tiles.cell)


def test_bounds_hold_for_every_row():
    rng = np.random.default_rng(0)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    rows, queries = unit(rng.normal(size=(400, 5))), unit(rng.normal(size=(50, 5)))
    cells = Cells({5: farthest_first(rows[:60], 9)})
    cell, angle = cells.place(5, rows)
    of = [np.flatnonzero(cell == c) for c in range(9)]
    tiles = Tiles(cells, list(range(9)), [len(x) for x in of], [angle[x].min() for x in of], [angle[x].max() for x in of])
    at, bound, _ = tiles.bounds(5, queries)
    for t in at:
        assert (np.cos(bound[:, t]) + 1e-9 >= (queries @ rows[of[t]].T).max(axis=1)).all()
    assert len(tiles.bounds(4, np.ones((1, 4)))[0]) == 0
    assert len(farthest_first(np.array([[1.0, 0.0]] * 4), 3)) == 1  # copies are one pivot


def test_many_centers_are_dealt(spark, tiny):
    v, c = clustered(300, 10, 6, 2), clustered(90, 10, 6, 3)
    c[40:60] = c[3]
    centers = [(i, x.tolist()) for i, x in enumerate(c)] + [(200, [0.0] * 6), (201, None)]
    vectors = [(i, x.tolist()) for i, x in enumerate(v)] + [(500, [0.0] * 6), (501, [1.0, float("inf")] * 3), (None, [1.0] * 6), (502, [1.0])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    got = {r.vec_id: (-r.cosine + 0.0, r.problem_id) for r in discovery.assign_problem(df, spark.createDataFrame(centers, "problem_id int, embedding array<double>")).collect()}
    want = wanted(centers[:-1], [x for x in vectors if x[0] is not None and x[0] < 501], 1)
    assert got == {q: x[0] for q, x in want.items()} and got[500] == (0.0, 0)


def test_search_in_empty_tables(spark, tiny):
    rows = spark.createDataFrame([(1, [1.0, 0.0])], ROWS)
    many = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(40)], QUERIES)
    assert discovery.search(rows.limit(0), many, 2).count() == 0
    assert discovery.search(rows, many.limit(0), 2).count() == 0
    assert discovery.search(rows, many, 2).count() == 40
    named = many.withColumnsRenamed({"query": "problem_id", "v": "embedding"})
    assert ideas.idea_problem_match(named, rows.limit(0).withColumnsRenamed({"row": "idea_id", "v": "embedding"}), 2).count() == 0
