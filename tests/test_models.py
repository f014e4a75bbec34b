"""Identities of the statistics, and hand-computed geometry."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import contracts as C
from tidemark.operators import graph as G
from tidemark.operators import models as M
from tidemark.operators import raster as RA
from tidemark.operators import select_points as SE
from tidemark.operators import spatial as S
from tidemark.operators import windows as W


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(3)
    rows, site = [], rng.normal(size=12) * 2
    for s in range(12):
        for k in range(10):
            x = float(rng.normal())
            rows.append((s, x, float(rng.normal() + x), float(1 + 2 * x + site[s] + rng.normal())))
    return spark.createDataFrame(rows, "site int, x double, z double, y double").withColumn("id", F.col("site") * 10 + F.row_number().over(__import__("pyspark").sql.Window.partitionBy("site").orderBy("x")) - 1).cache()


@pytest.fixture(scope="module")
def ring_weights(spark):
    n = 120
    return spark.createDataFrame([(i, (i + d) % n, 0.5) for i in range(n) for d in (-1, 1)], "i long, j long, w double").cache()


def arrays(panel):
    p = panel.orderBy("id").toPandas()
    return np.column_stack([np.ones(len(p)), p.x, p.z]), p.y.to_numpy(), p.site.to_numpy()


def test_least_squares_and_hc3(panel):
    x, y, _ = arrays(panel)
    beta, *_ = np.linalg.lstsq(x, y, rcond=None)
    rows = {r.term: r for r in M.fit_groups(panel, "y", ["x", "z"]).collect()}
    assert np.allclose([rows[t].estimate for t in ("intercept", "x", "z")], beta)
    assert rows["x"].aic == pytest.approx(2 * 4 - 2 * rows["x"].loglik)
    inv = np.linalg.inv(x.T @ x)
    h = np.einsum("ij,jk,ik->i", x, inv, x)
    e = (y - x @ beta) / (1 - h)
    b, cov = M.hc3(panel, "y", ["x", "z"])
    assert np.allclose(b, beta) and np.allclose(cov, inv @ (x.T * e**2) @ x @ inv)


def test_vif(panel):
    x, _, _ = arrays(panel)
    r = np.corrcoef(x[:, 1], x[:, 2])[0, 1]
    assert M.vif(panel, ["x", "z"])["x"] == pytest.approx(1 / (1 - r * r))


def test_t_tail():
    assert M.t_tail(2.2281388519649385, 10) == pytest.approx(0.05, abs=1e-9)
    assert M.t_tail(0.0, 5) == pytest.approx(1.0)


def test_moran_against_matrices(panel, ring_weights):
    x, y, _ = arrays(panel)
    n = len(y)
    w = np.zeros((n, n))
    for i in range(n):
        w[i, (i + 1) % n] = w[i, (i - 1) % n] = 0.5
    z = y - y.mean()
    got = M.morans_i(panel.select("id", "y"), ring_weights, "y")
    assert got["i"] == pytest.approx(n / w.sum() * (z @ w @ z) / (z @ z))
    assert got["expected"] == pytest.approx(-1 / (n - 1))
    full = M.residual_moran(panel, ring_weights, "y", ["x", "z"])
    m = np.eye(n) - x @ np.linalg.inv(x.T @ x) @ x.T
    s = (w + w.T) / 2
    e = y - x @ np.linalg.lstsq(x, y, rcond=None)[0]
    a, k = m @ s @ m, n - x.shape[1]
    tr1, tr2 = np.trace(a), np.trace(a @ a)
    assert full["i"] == pytest.approx(n / w.sum() * (e @ w @ e) / (e @ e))
    assert full["expected"] == pytest.approx(n / w.sum() * tr1 / k)
    assert full["variance"] == pytest.approx((n / w.sum()) ** 2 * 2 * (tr2 - tr1**2 / k) / (k * (k + 2)))


def test_spatial_models_find_their_parameter(spark, ring_weights):
    n, rho = 120, 0.5
    rng = np.random.default_rng(5)
    w = np.zeros((n, n))
    for i in range(n):
        w[i, (i + 1) % n] = w[i, (i - 1) % n] = 0.5
    x = rng.normal(size=n)
    y = np.linalg.solve(np.eye(n) - rho * w, 1 + 2 * x + 0.3 * rng.normal(size=n))
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))], "id long, x double, y double")
    spectrum = M.Spectrum(ring_weights)
    for v in (-0.9, 0.3, 0.7, 0.97):
        inverse = np.linalg.inv(np.eye(n) - v * w)
        assert spectrum.log_det(v) == pytest.approx(np.linalg.slogdet(np.eye(n) - v * w)[1])
        assert spectrum.direct(v) == pytest.approx(np.trace(inverse) / n)
    fit = M.spatial_lag_model(df, ring_weights, "y", ["x"], spectrum)
    assert fit["rho"] == pytest.approx(rho, abs=0.08) and fit["beta"][1] == pytest.approx(2, abs=0.1)
    assert fit["impacts"]["x"]["total"] == pytest.approx(fit["beta"][1] / (1 - fit["rho"]))
    err = M.spatial_error_model(df, ring_weights, "y", ["x"])
    assert -1 < err["lambda"] < 1


def test_probed_spectrum(spark):
    """Traces of neighbour weights by probes against the eigenvalues."""
    xy = np.random.default_rng(3).uniform(size=(400, 2))
    d = np.hypot(*(xy[:, None] - xy[None]).transpose(2, 0, 1)) + 9 * np.eye(400)
    w = spark.createDataFrame([(i, int(j), 1 / 6) for i in range(400) for j in d[i].argsort()[:6]], "i long, j long, w double")
    exact, probed = M.Spectrum(w), M.Spectrum(w, dense=10)
    for v in (-0.5, 0.4, 0.8):
        assert probed.log_det(v) == pytest.approx(exact.log_det(v), rel=0.1)
        assert probed.direct(v) == pytest.approx(exact.direct(v), rel=0.02)


def test_correlation_p(spark):
    df = spark.createDataFrame([(0.5, 12), (-0.2, 30), (1.0, 5), (0.3, 2)], "r double, n int")
    got = [r.p for r in df.select(M.correlation_p(F.col("r"), F.col("n")).alias("p")).collect()]
    assert got[0] == pytest.approx(M.t_tail(0.5 * math.sqrt(10 / 0.75), 10)) and got[1] == pytest.approx(0.2893, abs=1e-4)
    assert got[2] == 0 and (got[3] is None or math.isnan(got[3]))


def test_scaling_by_group(spark):
    df = spark.createDataFrame([(1, 2.0), (1, 4.0), (1, None), (None, 5.0), (2, 7.0), (2, 7.0)], "g int, v double")
    got = sorted((r.g or 0, r.v or 0.0, r.s, r.z) for r in W.z_score(W.min_max(df, {"s": "v"}, "g"), {"z": "v"}, "g").collect() if r.v is not None)
    assert [x[2] for x in got] == [0.0, 0.0, 1.0, 0.0, 0.0] and got[0][3] is None and got[3][3] is None
    assert got[1][3] == pytest.approx(-math.sqrt(0.5))


def test_mixed_model_balanced_anova(panel):
    """A balanced one-way layout has closed-form REML estimates."""
    m = M.mixed_model(panel, "y", [], "site")
    p = panel.toPandas()
    means = p.groupby("site").y.mean()
    within = ((p.y - p.site.map(means)) ** 2).sum() / (120 - 12)
    between = 10 * ((means - p.y.mean()) ** 2).sum() / 11
    assert m["sigma2"] == pytest.approx(within, rel=1e-4)
    assert m["site_variance"] == pytest.approx((between - within) / 10, rel=1e-3)
    assert m["icc"] == pytest.approx(m["site_variance"] / (m["site_variance"] + m["sigma2"]))


def test_filtered_model_runs(spark, panel):
    points = spark.createDataFrame([(s, float(s % 4), float(s // 4)) for s in range(12)], "id int, x double, y double")
    m = M.filtered_mixed_model(panel, points, "y", ["x"], "site", 5)
    assert m["vectors"] <= 5 and m["beta"][1] == pytest.approx(2, abs=0.4)


def test_published_formulas():
    assert 100 * (math.exp(0.49492) - 1) == pytest.approx(64.037, abs=1e-3)


def test_benjamini_hochberg(spark):
    df = spark.createDataFrame([(1, p) for p in (0.01, 0.02, 0.03, 0.5)], "f int, p double")
    assert [round(r.q, 6) for r in W.bh_table(df, "p", "f").orderBy("p").collect()] == [0.04, 0.04, 0.04, 0.5]


def test_coordinates_round_trip(spark):
    df = spark.createDataFrame([(480000.0, 5450000.0), (512345.6, 5461234.5)], "x double, y double")
    lon, lat = S.to_lonlat(F.col("x"), F.col("y"))
    back = df.select("x", "y", lon.alias("lon"), lat.alias("lat"))
    x, y = S.to_utm(F.col("lon"), F.col("lat"))
    rows = back.select("lon", "lat", F.hypot(x - F.col("x"), y - F.col("y")).alias("d")).collect()
    assert all(r.d < 1e-3 and -124 < r.lon < -122 and 49 < r.lat < 50 for r in rows)


def test_polygon_with_notch(spark):
    ring = "array(struct(0.0D x,0.0D y),struct(4.0D x,0.0D y),struct(4.0D x,4.0D y),struct(2.0D x,1.0D y),struct(0.0D x,4.0D y))"
    df = spark.sql(f"select {ring} ring, 2.0D x, 0.5D y, 2.0D x2, 3.0D y2, 0.0D bx")
    r = df.select(S.inside(F.col("x"), F.col("y"), F.col("ring")).alias("a"), S.inside(F.col("x2"), F.col("y2"), F.col("ring")).alias("b"), S.inside(F.col("bx"), F.col("y"), F.col("ring")).alias("c"), S.area(F.col("ring")).alias("area")).first()
    assert (r.a, r.b, r.c, r.area) == (True, False, False, 10.0)


def test_slope_and_sight(spark):
    plane = spark.createDataFrame([(r, c, float(c), int(c == 4)) for r in range(3) for c in range(5)], "r int, c int, elev double, water int")
    inner = RA.slope(plane, 1.0).filter("slope is not null").collect()
    assert len(inner) == 3 and all(x.slope == pytest.approx(45.0) for x in inner)
    wall = plane.withColumn("elev", F.when(F.col("c") == 2, 9.0).otherwise(0.0))
    eye = spark.createDataFrame([(1, 0.5, 1.5)], "id int, x double, y double")
    assert RA.line_of_sight(eye, wall, 1.0, 10.0, 1.6, "water = 1").count() == 0
    assert RA.line_of_sight(eye, wall.withColumn("elev", F.lit(0.0)), 1.0, 10.0, 1.6, "water = 1").count() == 3


def test_paths_and_components(spark):
    edges = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0), (1, 3, 5.0), (4, 5, 1.0)], "u long, v long, len double")
    start = spark.createDataFrame([(1, 1, 0.0)], "source long, node long, dist double")
    assert {(r.node, r.dist) for r in G.reach(start, edges, 10.0).collect()} == {(1, 0.0), (2, 1.0), (3, 2.0)}
    assert {(r.node, r.component) for r in G.connected(edges).collect()} == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 4)}


def test_selection(spark):
    df = spark.sql("select array(struct(0.0D x,0.0D y),struct(1.0D x,0.0D y),struct(10.0D x,0.0D y),struct(5.0D x,0.0D y)) p")
    r = df.select(SE.thin(F.col("p"), 3.0).alias("t"), SE.farthest(F.col("p"), 2).alias("f"), SE.supplement(F.slice("p", 1, 1), F.col("p"), 1.0, 2).alias("s")).first()
    assert [q.x for q in r.t] == [0.0, 5.0, 10.0] and [q.x for q in r.f] == [0.0, 10.0] and [q.x for q in r.s] == [0.0, 1.0]


def test_contract_raises(spark):
    df = spark.createDataFrame([(1,), (1,)], "k int")
    with pytest.raises(ValueError):
        C.require(C.unique_key(df, "k"))
    C.require(C.row_count(df, 2))


def test_nearest_at_any_distance(spark):
    points = spark.createDataFrame([(1, 0.0, 5.0), (2, 9000.0, 0.0), (3, -50.0, 0.0), (4, 100.0, -70000.0)], "stop_id int, x double, y double")
    segments = spark.createDataFrame([(7, 0.0, 0.0, 100.0, 0.0), (8, 0.0, 100.0, 100.0, 100.0)], "id int, ax double, ay double, bx double, by double")
    got = {r.stop_id: (r.id, r.distance) for r in S.nearest_segment(points, segments, "stop_id", ["id"], 100.0).collect()}
    assert got == {1: (7, 5.0), 2: (7, 8900.0), 3: (7, 50.0), 4: (7, 70000.0)}
    nodes = spark.createDataFrame([(5, 0.0, 0.0), (6, 100.0, 0.0)], "node int, x2 double, y2 double")
    got = {r.stop_id: (r.node, r.distance) for r in S.nearest_point(points, nodes, "stop_id", ["node"], 20.0).collect()}
    assert got == {1: (5, 5.0), 2: (6, 8900.0), 3: (5, 50.0), 4: (6, 70000.0)}
    assert S.nearest_segment(points, segments.limit(0), "stop_id", ["id"], 100.0).count() == 0


def test_k_means_settles(spark):
    rng = np.random.default_rng(11)
    xy = [rng.uniform(size=(n, 2)) * 1000 for n in (500, 60, 2)]
    points = spark.createDataFrame([(k, float(x), float(y)) for k, p in enumerate(xy) for x, y in p], "park_num int, x double, y double")
    got = SE.k_means(points, "park_num", 3).toPandas()
    assert len(got) == 562 and (got.groupby("park_num").chosen.sum() == [3, 3, 2]).all()
    for _, g in got.groupby("park_num"):
        centre = g.groupby("cluster")[["x", "y"]].mean()
        d = np.hypot(g.x.to_numpy()[:, None] - centre.x.to_numpy(), g.y.to_numpy()[:, None] - centre.y.to_numpy())
        assert (centre.index.to_numpy()[d.argmin(axis=1)] == g.cluster).all()


def test_connecting_k(spark):
    """Two far towns of 14 points need the fourteenth neighbour; one town needs six at most."""
    from tidemark.plans.models import connecting_k

    towns = [(t * 100 + k, t * 30000.0 + k % 4 * 10.0, k // 4 * 10.0) for t in (0, 1) for k in range(14)]
    points = spark.createDataFrame(towns, "id int, x double, y double")
    assert connecting_k(points) == 14
    assert connecting_k(points.filter("id < 100")) == 6


def test_filtered_model_takes_all_vectors(spark):
    rng = np.random.default_rng(5)
    sites = [(k, float(x), float(y)) for k, (x, y) in enumerate(rng.uniform(size=(300, 2)) * 1000)]
    points = spark.createDataFrame(sites, "id int, x double, y double")
    rows = spark.createDataFrame([(k, float(a), float(a + rng.normal())) for k, _, _ in sites for a in rng.normal(size=2)], "site int, a double, b double")
    vectors = len(M.moran_basis(points)[1])
    assert 50 < vectors <= 200 and M.filtered_mixed_model(rows, points, "b", ["a"], "site")["vectors"] == vectors


def test_site_intercepts_and_residuals(panel):
    """A balanced layout shrinks site means by one factor; residuals take intercepts and fixed effects off."""
    m = M.mixed_model(panel, "y", [], "site")
    p = panel.toPandas()
    shrink = 10 * m["site_variance"] / (10 * m["site_variance"] + m["sigma2"])
    expected = shrink * (p.groupby("site").y.mean() - p.y.mean())
    assert {r.site: r.blup for r in m["blup"].collect()} == pytest.approx(expected.to_dict())
    got = m["residuals"].orderBy("id").toPandas().residual.to_numpy()
    p = p.sort_values("id")
    dense = (p.y - p.y.mean() - p.site.map(expected)).to_numpy()
    assert got == pytest.approx(dense)
    assert m["residual_skewness"] == pytest.approx(((dense - dense.mean()) ** 3).mean() / dense.std(ddof=1) ** 3)


def test_mixed_model_uneven_sites_against_matrices(spark, panel):
    p = panel.filter("id % 10 < site % 4 + 3").toPandas().sort_values("id")
    m = M.mixed_model(panel.filter("id % 10 < site % 4 + 3"), "y", ["x"], "site")
    x, y = np.column_stack([np.ones(len(p)), p.x]), p.y.to_numpy()
    z = (p.site.to_numpy()[:, None] == np.arange(12)).astype(float)
    assert (*m["beta"], m["loglik"]) == pytest.approx(_dense_reml(x, y, z @ z.T * m["site_variance"] / m["sigma2"]))


def _dense_reml(x, y, spread):
    """Coefficients and restricted log-likelihood for the covariance I + spread, sigma profiled."""
    v = np.eye(len(y)) + spread
    vx, n, k = np.linalg.solve(v, x), *x.shape
    g = x.T @ vx
    beta = np.linalg.solve(g, vx.T @ y)
    s2 = (y - x @ beta) @ np.linalg.solve(v, y - x @ beta) / (n - k)
    return (*beta, -0.5 * ((n - k) * (math.log(2 * math.pi * s2) + 1) + np.linalg.slogdet(v)[1] + np.linalg.slogdet(g)[1]))


def test_filtered_model_against_matrices(spark, panel):
    """Uneven sites; coefficients, likelihood, site effects and residuals from the full covariance."""
    rows = panel.filter("id % 10 < site % 4 + 3")
    points = spark.createDataFrame([(s, float(s % 4) + s * 0.01, float(s // 4)) for s in range(12)], "id int, x double, y double")
    m = M.filtered_mixed_model(rows, points, "y", ["x"], "site", 4)
    basis, values = M.moran_basis(points, 4)
    e = np.array([r.e for r in basis.orderBy("id").collect()])
    spread = math.exp(m["theta"][0]) * (values / values.sum()) ** math.exp(m["theta"][1]) * len(values)
    by_site = e * spread @ e.T + np.eye(12) * math.exp(m["theta"][2])
    p = rows.toPandas().sort_values("id")
    site, x, y = p.site.to_numpy(), np.column_stack([np.ones(len(p)), p.x]), p.y.to_numpy()
    cover = by_site[np.ix_(site, site)]
    assert (*m["beta"], m["loglik"]) == pytest.approx(_dense_reml(x, y, cover))
    effect = by_site[:, site] @ np.linalg.solve(np.eye(len(y)) + cover, y - x @ m["beta"])
    assert {r.site: r.effect for r in m["site_effect"].collect()} == pytest.approx(dict(enumerate(effect.tolist())))
    assert m["residuals"].orderBy("id").toPandas().residual.to_numpy() == pytest.approx(y - x @ m["beta"] - effect[site])


def test_moran_basis_exact_and_extended(spark):
    """With all sites as knots the vectors are those of the kernel; with half of them they span nearly the same space."""
    rng = np.random.default_rng(9)
    xy = rng.uniform(size=(160, 2)) * 1000
    points = spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in enumerate(xy)], "id long, x double, y double").repartition(3)
    basis, values = M.moran_basis(points, 10)
    e = np.array([r.e for r in basis.orderBy("id").collect()])
    k = np.exp(-np.hypot(*(xy[:, None] - xy[None]).transpose(2, 0, 1)) / M.longest_tree_edge(xy))
    np.fill_diagonal(k, 0)
    centre = np.eye(160) - 1 / 160
    assert centre @ k @ centre @ e == pytest.approx(e * values, abs=1e-8) and e.T @ e == pytest.approx(np.eye(10), abs=1e-8)
    part = np.array([r.e for r in M.moran_basis(points, 10, 80)[0].orderBy("id").collect()])
    leading = np.linalg.svd(np.linalg.qr(part)[0].T @ e[:, :4])[1]
    assert part.shape == (160, 10) and leading.min() > 0.9
