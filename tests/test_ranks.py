"""Distributed ranks, quantiles and q-values against plain Python; shapes with holes and viewsheds against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import contracts, ranks, raster, select_points, shapes
from tidemark.plans.lines import ADMITTED
from tidemark.plans.quality import EXPECTED


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    return [(rng.choice(["a", "a", "a", "b", None]), rng.choice([rng.randint(0, 30) / 7, 2.0, 2.0, None])) for _ in range(600)]


@pytest.fixture(scope="module")
def table(spark, rows):
    return spark.createDataFrame(rows, "g string, n double").repartition(5)


def groups(rows):
    out = {}
    for g, v in rows:
        if v is not None:
            out.setdefault(g, []).append(v)
    return out


@pytest.mark.parametrize("ties", ["average", "min"])
def test_ranks(table, rows, ties):
    held = groups(rows)
    place = {g: {v: (sum(x < v for x in vs) + (sum(x == v for x in vs) + 1) / 2 if ties == "average" else 1 + sum(x < v for x in vs)) for v in set(vs)} for g, vs in held.items()}
    got = ranks.with_rank(table, "n", "rank", "g", ties=ties).collect()
    assert len(got) == len(rows)
    assert all(r["rank"] == (None if r["n"] is None else place[r["g"]][r["n"]]) for r in got)


def test_quantiles(table, rows):
    got = {r["g"]: (r["low"], r["mid"]) for r in ranks.quantiles(table, "n", {"low": 0.1, "mid": 0.5}, "g").collect()}
    assert got.keys() == groups(rows).keys()
    for g, vs in groups(rows).items():
        assert got[g] == pytest.approx(tuple(np.quantile(vs, [0.1, 0.5])))
    whole = ranks.quantiles(table, "n", {"mid": 0.5}).first()["mid"]
    assert whole == pytest.approx(np.median([v for _, v in rows if v is not None]))


def test_one_family_runs_in_many_tasks(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so small a table would be one range
    c = ranks.counted(spark.range(20_000).select((F.col("id") / 20_001).alias("p"), F.lit(1).alias("f")), "p", "f")
    assert c.select("part").distinct().count() > 1
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    top = c.orderBy(F.desc("p")).first()
    assert (top["before"], top["total"]) == (19_999, 20_000)


def test_adjusted(table, rows):
    held = {g: [v / 5 for v in vs] for g, vs in groups(rows).items()}
    got = ranks.adjusted(table.withColumn("p", F.col("n") / 5), "p", "g").filter("p is not null").collect()
    for r in got:
        vs = held[r["g"]]
        want = min(1.0, min(p * len(vs) / sum(x <= p for x in vs) for p in vs if p >= r["p"]))
        assert r["q"] == pytest.approx(want)


def test_sample_sizes(spark):
    # the studies' own numbers, not the fixture's
    assert list(EXPECTED.values()) == [103, 98, 76, 103] and ADMITTED == {5: 90, 10: 105, 20: 112, 30: 114}
    sites = spark.range(103).select(F.lit(True).alias("activity_available"), (F.col("id") < 98).alias("main_model_eligible"), F.when(F.col("id") < 76, True).alias("coverage90_model_eligible"), F.lit(True).alias("population20_sensitivity_eligible"))
    assert all(r["ok"] for r in contracts.sample_sizes(sites, EXPECTED).collect())
    assert not all(r["ok"] for r in contracts.sample_sizes(sites.filter("main_model_eligible"), EXPECTED).collect())


def odd(x, y, rings):
    hits = 0
    for ring in rings:
        for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
            if (ay > y) != (by > y) and x < ax + (y - ay) * (bx - ax) / (by - ay):
                hits += 1
    return hits % 2 == 1


def distance(x, y, rings):
    best = math.inf
    for ring in rings:
        for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
            dx, dy = bx - ax, by - ay
            t = max(0, min(1, ((x - ax) * dx + (y - ay) * dy) / (dx * dx + dy * dy)))
            best = min(best, math.hypot(x - ax - t * dx, y - ay - t * dy))
    return best


@pytest.mark.parametrize("size", [3.0, 17.0, 400.0])
def test_points_in_shapes(spark, size):
    rng = np.random.default_rng(3)
    star = lambda cx, cy, r, n: [(cx + rng.uniform(0.3, 1) * r * math.cos(6.2831853 * k / n), cy + rng.uniform(0.3, 1) * r * math.sin(6.2831853 * k / n)) for k in range(n)]
    made = {1: [[star(0, 0, 60, 40), star(0, 0, 12, 9)], [star(0, 0, 4, 5)]], 2: [[star(-30, 20, 25, 12)], [[(50.0, 50.0), (90.0, 50.0), (90.0, 90.0), (50.0, 90.0)]]]}
    table = spark.createDataFrame([(k, [[[{"x": float(x), "y": float(y)} for x, y in ring] for ring in part] for part in parts]) for k, parts in made.items()], "key int, parts array<array<array<struct<x:double,y:double>>>>")
    points = [(k, float(x), float(y)) for k, (x, y) in enumerate(rng.uniform(-80, 100, (600, 2)))] + [(600, 50.0, 70.0), (601, 50.0, 50.0), (602, 70.0, 70.0)]
    rings = {k: [ring for part in parts for ring in part] for k, parts in made.items()}
    sides = shapes.sides(shapes.tidy(table), "key")
    df = spark.createDataFrame(points, "id int, x double, y double")
    got = {(r["id"], r["key"]) for r in shapes.points_in_shapes(df, sides, "key", size=size).collect()}
    assert got == {(i, k) for i, x, y in points for k in rings if odd(x, y, rings[k]) and distance(x, y, rings[k]) > 0}
    near = {(r["id"], r["key"]) for r in shapes.points_in_shapes(df, sides, "key", near=3.0, size=size).collect()}
    assert near == {(i, k) for i, x, y in points for k in rings if odd(x, y, rings[k]) or distance(x, y, rings[k]) < 3}


def test_no_ring_in_border_cells(spark):
    n = 5_000
    ring = [{"x": 1e4 * math.cos(6.2831853 * k / n), "y": 1e4 * math.sin(6.2831853 * k / n)} for k in range(n)]
    sides = shapes.sides(spark.createDataFrame([(1, [[ring]])], "key int, parts array<array<array<struct<x:double,y:double>>>>"), "key")
    border, inner = shapes.cover(sides, "key", 500.0)
    assert border.agg(F.max(F.size("sides"))).first()[0] < 200
    assert inner.count() > 1_000
    m = shapes.measures(sides, "key").first()
    assert m["area"] == pytest.approx(math.pi * 1e8, rel=1e-5)


def test_tidy_drops_what_is_broken(spark):
    sq = [{"x": 0.0, "y": 0.0}, {"x": 1.0, "y": 0.0}, {"x": 1.0, "y": 1.0}]
    flat = [{"x": 0.0, "y": 0.0}, {"x": 1.0, "y": 0.0}, {"x": 2.0, "y": 0.0}]
    rows = [(1, [[sq, flat, []]]), (2, [[flat]]), (3, None), (4, []), (5, [[[]], [sq]])]
    got = {r["key"]: [len(p) for p in r["parts"]] for r in shapes.tidy(spark.createDataFrame(rows, "key int, parts array<array<array<struct<x:double,y:double>>>>")).collect()}
    assert got == {1: [1], 5: [1]}


def test_viewshed_by_rays(spark):
    rng = np.random.default_rng(1)
    elev = {(r, c): float(rng.uniform(0, 9)) for r in range(-9, 14) for c in range(-12, 9) if (r, c) not in {(2, 2), (-3, 4)}}
    cells = spark.createDataFrame([(r, c, v, 1 if (r + c) % 2 else None) for (r, c), v in elev.items()], "r int, c int, elev double, water int")
    looks = [(1, 3.4, 8.8), (2, -40.0, 21.0), (3, 900.0, 900.0), (4, 12.5, 12.5)]
    got = {tuple(r) for r in raster.viewshed(spark.createDataFrame(looks, "id int, x double, y double"), cells, 5.0, 32.0, 1.6, "water = 1", side=4).collect()}
    want = set()
    for i, x, y in looks:
        here = (math.floor(y / 5), math.floor(x / 5))
        for (r, c), v in elev.items():
            d = math.hypot((c + 0.5) * 5 - x, (r + 0.5) * 5 - y)
            if here not in elev or not (r + c) % 2 or d > 32:
                continue
            eye, worst = elev[here] + 1.6, -math.inf
            for k in range(1, max(1, math.ceil(d / 5))):
                p = (math.floor((y + k * 5 / d * ((r + 0.5) * 5 - y)) / 5), math.floor((x + k * 5 / d * ((c + 0.5) * 5 - x)) / 5))
                if p != (r, c) and p in elev:
                    worst = max(worst, (elev[p] - eye) / (k * 5))
            if d == 0 or worst <= (v - eye) / d:
                want.add((i, r, c))
    assert got == want


def test_sweep_on_plain_ground_and_behind_a_wall(spark):
    flat = spark.range(61 * 61).select((F.floor(F.col("id") / 61) - 30).cast("int").alias("r"), (F.col("id") % 61 - 30).cast("int").alias("c"), F.lit(0.0).alias("elev"))
    look = spark.createDataFrame([(1, 0.5, 0.5)], "id int, x double, y double")
    see = lambda cells, **more: {(r["r"], r["c"]) for r in raster.viewshed(look, cells, 1.0, 20.0, 1.6, "true", sweep=True, **more).collect()}
    disc = {(r, c) for r in range(-20, 21) for c in range(-20, 21) if r * r + c * c <= 400}
    assert see(flat) == disc
    wall = flat.withColumn("elev", F.when(F.col("c") == 5, 50.0).otherwise(0.0))
    assert see(wall) == {(r, c) for r, c in disc if c <= 5}
    # on an earth of ten metres' radius the ground is lost to sight within a few metres
    assert max(r * r + c * c for r, c in see(flat, earth=10.0)) < 100


def test_thinning_in_rounds_is_the_greedy_fold(spark):
    rng = random.Random(8)
    points = [(rng.choice(["a", "b"]), float(rng.randint(0, 40)), float(rng.randint(0, 40))) for _ in range(500)]
    points += [("line", float(k), 0.0) for k in range(30)]
    extra = [(rng.choice(["a", "b", "c", "line"]), float(rng.randint(0, 60)), float(rng.randint(0, 60))) for _ in range(60)]

    def greedy(ps, apart, kept=(), most=10**9):
        out = list(kept)
        for p in sorted(set(ps)):
            if len(out) < most and all(math.dist(p, q) >= apart for q in out):
                out.append(p)
        return out

    schema = "k string, x double, y double"
    df, more = spark.createDataFrame(points, schema), spark.createDataFrame(extra, schema)
    by = lambda rows: {k: sorted((r["x"], r["y"]) for r in rows if r["k"] == k) for k in {r["k"] for r in rows}}
    own = {k: [(x, y) for g, x, y in points if g == k] for k in ("a", "b", "line")}
    want = {k: greedy(ps, 3.0) for k, ps in own.items()}
    thin = select_points.thinned(df, "k", 3.0)
    assert by(thin.collect()) == {k: sorted(v) for k, v in want.items()}
    full = select_points.supplemented(thin.filter("k <> 'a'"), more, "k", 5.0, 12)
    filled = {k: greedy([(x, y) for g, x, y in extra if g == k], 5.0, want.get(k, []) if k != "a" else [], max(12, len(want.get(k, [])) if k != "a" else 0)) for k in ("a", "b", "c", "line")}
    assert by(full.collect()) == {k: sorted(v) for k, v in filled.items() if v}

    def spread(ps, most):
        ps, out = sorted(ps), [min(ps)]
        while len(out) < min(most, len(ps)):
            out.append(max(ps, key=lambda p: (min(math.dist(p, q) for q in out), -ps.index(p))))
        return out if len(ps) > most else ps

    assert by(select_points.spread_out(thin, "k", 7).collect()) == {k: sorted(spread(v, 7)) for k, v in want.items()}
