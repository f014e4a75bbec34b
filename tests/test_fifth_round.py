"""Queries whose rows are pairs of cells and sites: same pairs, fewer steps."""

import itertools

from tests.test_third_round import ODD_CELLS, ODD_SITES, SUPPLIER, made, same
from tidemark.operators import spatial


def offsets(spark, h=100.0, d=5.0):
    """Cells round the side and the corner of one square, on the border too."""
    steps = [0.0, 50.0, *(h + k for k in (-1.0, 0.0, 1.0, 3.0, 4.0, 4.5, 4.9, 5.0, 6.0))]
    places = [(300.0 + a * x, 300.0 + b * y) for x, y in itertools.product(steps, steps) for a in (-1, 1) for b in (-1, 1)]
    cells = spark.createDataFrame([(f"{k:04}", x, y) for k, (x, y) in enumerate(places)] + [("none", None, 300.0)], "geography string, x double, y double")
    sites = spark.createDataFrame([(1, 300.0, 300.0, h), (1, 300.0, 300.0, h), (2, None, 300.0, h), (3, 300.0, 300.0, None)], "park_num int, x double, y double, h double")
    return places, cells, sites


def test_cells_near_a_corner(spark):
    """Offsets of 3 and 4 are exactly 5 from the corner, so they are not nearer than 5."""
    places, cells, sites = offsets(spark)
    over = lambda v: max(abs(v - 300.0) - 100.0, 0.0)
    want = [f"{k:04}" for k, (x, y) in enumerate(places) if (over(x) ** 2 + over(y) ** 2) ** 0.5 < 5.0]
    got = [(r.park_num, r.geography) for r in spatial.cells_near_sites(cells, sites, 5.0).collect()]
    assert sorted(got) == sorted(2 * [(1, g) for g in want])


def test_near_pairs_are_few_beside_those_found(spark, monkeypatch):
    """Squares of the fixtures' widths on evenly spread cells: at most twice the pairs that are found are tried."""
    cells = spark.range(20000).selectExpr("cast(id as string) as geography", "cast(id*7919 % 10007 as double) as x", "cast(id*104729 % 10009 as double) as y")
    sites = spark.range(100).selectExpr("cast(id as int) as park_num", "cast(1500 + id*6151 % 7000 as double) as x", "cast(1500 + id*12289 % 7000 as double) as y", "150.0d + (id % 7)*75 as h")
    tried = []
    meet = spatial.meet
    monkeypatch.setattr(spatial, "meet", lambda *a: tried.append(meet(*a)) or tried[-1])
    found = spatial.cells_near_sites(cells, sites, 5.0)
    condition = str(found._jdf.queryExecution().optimizedPlan().toString())
    assert tried[0].count() < 2 * found.count()
    assert "greatest" not in condition


def test_near_sites_with_repeated_keys(spark, tmp_path):
    same(spark, made(tmp_path, supplier=SUPPLIER.format(ODD_SITES), part=ODD_CELLS), "jn12_points_near_polygons")
