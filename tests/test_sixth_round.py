"""Parks on slanted sides and repeated rows; k-means of cells in squares by tiles."""

import duckdb
import numpy as np
import pytest

from tidemark.operators import graph, select_points, shapes, spatial, squares
from tidemark.plans.registry import ORACLES, QUERIES


@pytest.mark.parametrize("lean", [1, -1])
def test_slanted_sides_miss_reference_points(spark, lean):
    """A side of slope 1 or -1 between corners of cells passes through no cell's reference point."""
    ring = [(0.0, 0.0), (50.0, 50.0 * lean), (0.0, 50.0 * lean)]
    table = spark.createDataFrame([(1, [[[{"x": x, "y": y} for x, y in ring]]])], "key int, parts array<array<array<struct<x:double,y:double>>>>")
    points = spark.createDataFrame([(float(x), float(y * lean)) for x in range(-3, 54) for y in range(-3, 54)], "x double, y double")
    got = shapes.points_in_shapes(points, shapes.sides(shapes.tidy(table), "key"), "key", size=10.0).collect()
    assert sorted((r.x, r.y * lean) for r in got) == [(float(x), float(y)) for x in range(1, 50) for y in range(x + 1, 50)]


@pytest.fixture(scope="module")
def repeated(spark, sf_dir, tmp_path_factory):
    """The small tables with some rows of cells and sites twice or three times."""
    where = tmp_path_factory.mktemp("repeated")
    for name, key in (("part", "p_partkey"), ("supplier", "s_suppkey")):
        t = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        t.unionByName(t.filter(f"{key} % 3 = 0")).unionByName(t.filter(f"{key} % 6 = 0")).write.parquet(f"{where}/{name}.parquet")
    return str(where)


@pytest.mark.parametrize("name", ["jn11_points_in_parts", "jn12_points_near_parts"])
def test_parts_of_repeated_rows(spark, repeated, name):
    got = sorted((r.park_num, r.geography) for r in QUERIES[name](spark, repeated).collect())
    with duckdb.connect() as con:
        for t in ("part", "supplier"):
            con.execute(f"create view {t} as select * from '{repeated}/{t}.parquet/*.parquet'")
        want = sorted((park, cell) for park, cell in con.execute(f"select park_num, geography from ({ORACLES[name]})").fetchall())
    assert want and got == want


def test_k_means_of_squares(spark):
    """Tiles give what the rounds over all points give; a site of several squares and one without points are among them."""
    rng = np.random.default_rng(5)
    cells = spark.createDataFrame([(f"g{k}", float(x), float(y)) for k, (x, y) in enumerate(rng.integers(0, 90, (1500, 2)))], "geography string, x double, y double")
    sites = [(n, float(x), float(y), float(h)) for n, (x, y, h) in enumerate(rng.integers(2, 40, (25, 3)))] + [(3, 70.0, 70.0, 12.0), (30, 500.0, 500.0, 5.0), (31, 45.0, 45.0, 1.0)]
    sites = spark.createDataFrame(sites, "park_num int, x double, y double, h double")
    got = squares.clustered_cells(cells, sites, 3).collect()
    want = select_points.k_means(spatial.placed_cells(cells, sites), "park_num", 3).select("park_num", "x", "y", "cluster", "chosen").collect()
    assert want and sorted(got) == sorted(want)


@pytest.mark.parametrize("k", [1, 2, 3, 5])
def test_k_means_levels(k):
    """Trying only points that can have changed gives what trying all gives."""
    rng = np.random.default_rng(k)
    for n in [1, 2, 3, 7, 400, 3000]:
        p = np.unique(rng.integers(0, 200, (n, 2)).astype(float), axis=0)
        x, y = p[:, 0].copy(), p[:, 1].copy()
        seeds = np.sort(squares.spread_out(x, y, k))
        cx, cy, cluster = x[seeds], y[seeds], np.arange(len(seeds))
        while True:
            d = np.stack([squares.squared(x, y, a, b) for a, b in zip(cx, cy)])
            label = d.argmin(0)
            there = np.bincount(label, minlength=len(cx)) > 0
            nx, ny = (np.array([v[label == j].mean() for j in np.flatnonzero(there)]) for v in (x, y))
            if there.all() and (np.hypot(nx - cx, ny - cy) <= 1e-6).all():
                break
            cx, cy, cluster = nx, ny, cluster[there]
        got = squares.k_means(x, y, k, 1e-6)
        assert [r[0] for r in got] == list(cluster) and np.allclose([r[1:3] for r in got], np.column_stack([cx, cy]), atol=1e-9)
        assert all(label[r[3]] == j and d[j, r[3]] == d[j, label == j].min() for j, r in enumerate(got))


def test_k_means_writes_no_rounds(spark, sf_dir, monkeypatch):
    """The steps run within tiles: the query writes no table a step."""
    written, put = [], graph.Rounds.put
    monkeypatch.setattr(graph.Rounds, "put", lambda self, df: written.append(self.stem) or put(self, df))
    assert QUERIES["sel4_k_means"](spark, sf_dir).count() > 0 and len(written) <= 2, written
