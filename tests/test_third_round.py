"""Findings of the third round: queries on tables made for them, against their SQL."""

import duckdb
import pytest

from pyspark.sql import functions as F

from tests.test_queries import plain
from tidemark.operators import lines, spatial
from tidemark.plans.registry import ORACLES, QUERIES


def same(spark, folder, name):
    """The query and its SQL on the folder's tables."""
    con = duckdb.connect()
    for p in folder.glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    df, found = QUERIES[name](spark, str(folder)), con.sql(ORACLES[name])
    columns = sorted(df.columns)
    at = [found.columns.index(c) for c in columns]
    got = sorted(repr([plain(r[c]) for c in columns]) for r in df.collect())
    assert got and got == sorted(repr([plain(r[i]) for i in at]) for r in found.fetchall())


def made(folder, **tables):
    for name, sql in tables.items():
        duckdb.sql(f"copy ({sql}) to '{folder}/{name}.parquet' (format parquet)")
    return folder


SUPPLIER = "select k as s_suppkey, 'Supplier ' || k as s_name, (k % 25)::int as s_nationkey, (k % 100) / 8.0::double as s_acctbal from (select unnest([{}])::bigint as k)"


def test_equal_p_values(spark, tmp_path):
    """Suppliers 997 apart have equal p."""
    same(spark, made(tmp_path, supplier=SUPPLIER.format("0, 997, 1994, 1, 998, 2, 40")), "win6_benjamini_hochberg")


def test_many_access_points(spark, tmp_path):
    """A site with more than fifteen own cells that are 150 apart keeps them all."""
    part = "select k::bigint as p_partkey from range(0, 280000) r(k) where k % 40 = 0"
    customer = "select k::bigint as c_custkey, (k % 25)::int as c_nationkey from range(0, 300) r(k)"
    same(spark, made(tmp_path, supplier=SUPPLIER.format("6, 13, 27"), part=part, customer=customer), "sel3_access_fallback")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["jn23_visible_area_mask", "agg20_agg21_zonal"])
def test_discs_are_not_broadcast(spark, name):
    """Observers are few bytes before an explode makes thousands of rows of each."""
    assert "BroadcastHashJoin" not in plan(QUERIES[name](spark, "/root/testdata/sf0.001"))


def test_pieces_of_lines_are_not_broadcast(spark):
    streets = spark.range(50).select("id", (F.col("id") * 100.0).alias("ax"), F.lit(0.0).alias("ay"), (F.col("id") * 100.0 + 150).alias("bx"), F.lit(0.0).alias("by"))
    ends = streets.select(F.col("ax").alias("x"), F.col("ay").alias("y"))
    near = spatial.points_near_segments(ends, streets, 1e-6, 200.0)
    assert "BroadcastHashJoin" not in plan(near) and near.count() == 99  # its own start, and the start after it
    assert "BroadcastHashJoin" not in plan(lines.crossing_places(streets, 200.0))
    assert lines.noded(streets, 200.0).count() == 99  # cut at each start and end


def test_hours_of_squares(spark):
    """Sums over squares are those of the join: cells of two sites, of two places, of none; repeated rows, missing values."""
    import datetime

    from tidemark.operators import panel

    day = datetime.date
    cells = spark.createDataFrame([("a", 0.0, 0.0), ("a", 1.0, 1.0), ("b", 10.0, 0.0), ("b", 10.0, 0.0), ("c", 900.0, -900.0), ("d", 5.0, 5.0), ("e", None, 1.0)], "geography string, x double, y double")
    sites = spark.createDataFrame([(1, 0.0, 0.0, 10.0), (2, 8.0, 2.0, 5.0), (3, -500.0, 0.0, 20.0), (4, 0.0, 0.0, 0.0), (5, 899.5, -900.0, 1.0), (6, None, 0.0, 3.0)], "park_num int, x double, y double, h double")
    activity = [(g, day(2023, m, 1) if m else None, d, t, v) for g in "abcde" for m in (1, 2, None) for d in (0, 1) for t in (5, 6, 20, 21) for v in (0.5, m and 1.25 * m, 0.125)]
    activity = spark.createDataFrame(activity, "geography string, start_date date, agg_day_period int, agg_time_period int, activity_index_total double")
    want = panel.site_hours(activity, spatial.points_in_polygons(cells.filter("x is not null").distinct(), spatial.site_rings(sites.filter("x is not null"))).select("park_num", "geography"))
    got = panel.square_hours(activity, cells, sites, 3)
    assert got.columns == want.columns
    rows = lambda df: sorted(map(repr, df.collect()))
    both = rows(got)
    # a cell of two places in one site is two records of the join each time
    assert both and both == rows(want)
    assert {r.park_num for r in got.collect()} == {1, 2, 5}


def test_neighbours_of_dense_points(spark):
    """Two hundred points in one bucket of the size given: few pairs are made, and the nearest are right."""
    import math

    points = {k: (k * 37 % 101 * 1.0, k * 53 % 97 * 1.0) for k in range(200)} | {1000: (5e5, 5e5)}
    got = spatial.nearest_points(spark.createDataFrame([(k, *p) for k, p in points.items()], "id long, x double, y double"), 3, 1000.0).collect()
    want = {(i, j, r + 1) for i in points for r, (_, j) in enumerate(sorted((math.dist(points[i], points[j]), j) for j in points if j != i)[:3])}
    assert {(r.i, r.j, r["rank"]) for r in got} == want


def test_lookup_checks_with_repeated_keys(spark, tmp_path):
    """Pairs repeat where a site or a cell has several rows; sites of 1 to 600 metres, some without cells."""
    part = "select k::bigint as p_partkey from range(0, 6000) r(k) where k % 3 <> 1 union all select k from range(0, 600) r(k) where k % 50 = 0"
    supplier = "select * from (" + SUPPLIER.format(", ".join(map(str, [*range(60), 6, 13, 27, 27]))) + ")"
    same(spark, made(tmp_path, supplier=supplier, part=part), "cmp11_lookup_tables")


def test_squares_are_counted_without_pairs(spark):
    """Of two thousand cells in each of twenty overlapping squares no pair is a row."""
    from tidemark.operators import scores, squares

    cells = spark.range(2000).select(F.lpad(F.col("id").cast("string"), 10, "0").alias("geography"), (F.col("id") % 50 / 10).alias("x"), F.floor(F.col("id") / 50).cast("double").alias("y"))
    sites = spark.range(1, 21).select(F.col("id").cast("int").alias("park_num"), F.lit(0.0).alias("x"), F.lit(20.0).alias("y"), (F.col("id") + 49.0).alias("h"))
    assert squares.counts(cells, sites).count() < 2000 * 20 / 2
    got = {(r.report, r.item): r.value for r in scores.square_checks(cells, sites).collect()}
    assert got["matches", "pairs"] == 40_000 and got["cells in several sites", "0000000007"] == 20 and got["cells per site", "median"] == 2000
    few = squares.by_tile(cells.select("x", "y"), sites, squares_seen, "n int", most=3).collect()
    assert sum(r.n for r in few) == 20 and len(few) > 5  # chunks of a tile share its squares out


def squares_seen(points, squares):
    import pyarrow as pa

    return pa.table({"n": pa.array([squares.num_rows], pa.int32())})


#: Sites of one and of several squares, cells of one and of two rows.
ODD_SITES = ", ".join(map(str, [*range(60), 6, 13, 27, 27]))
ODD_CELLS = "select k::bigint as p_partkey from range(0, 30000) r(k) where k % 3 <> 1 union all select k from range(0, 3000) r(k) where k % 50 = 0"


@pytest.mark.parametrize("name", ["sel1_thinned_cells", "sel2_sel3_sel5_farthest"])
def test_choices_with_repeated_keys(spark, tmp_path, name):
    same(spark, made(tmp_path, supplier=SUPPLIER.format(ODD_SITES), part=ODD_CELLS), name)


@pytest.mark.parametrize("name", ["sel1_thinned_cells", "sel2_sel3_sel5_farthest"])
def test_choices_make_no_pairs(spark, tmp_path, name, monkeypatch):
    """Neither pairs of cells and sites nor of neighbouring cells are joined where a site is one square."""
    from tidemark.operators import select_points, squares

    def never(*_):
        raise AssertionError("rows of pairs")

    for module in (select_points, spatial, squares):
        for f in ("meet", "placed_cells"):
            monkeypatch.setattr(module, f, never, raising=False)
    same(spark, made(tmp_path, supplier=SUPPLIER.format("1, 2, 6, 13, 20, 27"), part=ODD_CELLS), name)


def test_choice_of_points_is_the_fold(spark):
    """Thinning, farthest points and supplement of one site against plain loops."""
    import math
    import random

    import numpy as np

    from tidemark.operators import squares

    rng = random.Random(5)
    for _ in range(30):
        points = sorted((float(rng.randint(0, 30)), float(rng.randint(0, 30))) for _ in range(rng.randint(1, 120)))
        x, y = np.array(points).T
        thin = []
        for p in points:
            if all(math.dist(p, q) >= 6 for q in thin):
                thin.append(p)
        kept = squares.greedy(x, y, 6.0)
        assert [points[k] for k in kept] == thin
        far = thin[:1]
        while len(far) < min(4, len(thin)):
            far.append(max(thin, key=lambda p: (min(math.dist(p, q) for q in far), -thin.index(p))))
        far = thin if len(thin) <= 4 else far
        first = kept[squares.spread_out(x[kept], y[kept], 4)]
        assert [points[k] for k in first] == far
        full = list(far)
        for p in points:
            if len(full) < 7 and all(math.dist(p, q) >= 3 for q in full):
                full.append(p)
        assert [points[k] for k in squares.supplemented(x, y, first, 3.0, 7)] == full
