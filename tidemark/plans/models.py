"""Spatial weights, Moran tests and regressions as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import expr as X
from tidemark.operators import graph as G
from tidemark.operators import models as M
from tidemark.operators import panel as P
from tidemark.operators import spatial as S
from tidemark.operators import sweeps as SW
from tidemark.operators import windows as W
from tidemark.plans.panels import CORR_P
from tidemark.plans.registry import query
from tidemark.plans.spatials import _KNN, site_neighbours
from tidemark.sources.fixtures import Inputs

R = "round({} + 1.0e-9, 6)"
_VALUES = "v as (select s.park_num as id, cast(coalesce(n,0) as double) as y, h/100 as size, cast(muni_key as double)/10 as muni from v_sites s left join (select park_num, count(*) as n from v_lookup group by park_num) l on l.park_num = s.park_num)"


def values(i: Inputs) -> DataFrame:
    n = P.count_by(i.lookup, "park_num")
    return G.written(i.sites.join(n, "park_num", "left").select(F.col("park_num").alias("id"), F.coalesce("n", F.lit(0)).cast("double").alias("y"), (F.col("h") / 100).alias("size"), (F.col("muni_key").cast("double") / 10).alias("muni"), "x", F.col("y").alias("yy")), "values")


def site_weights(i: Inputs, k: int = 6) -> DataFrame:
    return G.written(M.weights(site_neighbours(i, k)), "weights")


@query(f"select i, j, round(1.0e0/6+1e-9,6) as w from ({_KNN}) k")
def sta1_weights(i: Inputs) -> DataFrame:
    return M.weights(site_neighbours(i)).select("i", "j", X.steady(F.col("w")).alias("w"))


@query(f"with {_VALUES} select k.i as id, {R.format('sum(v.y/6)')} as lag_y, {R.format('sum(v.size/6)')} as lag_size from ({_KNN}) k join v on v.id = k.j group by k.i")
def sta2_spatial_lag(i: Inputs) -> DataFrame:
    return M.lag(values(i), site_weights(i), "y", "size").select("id", X.steady(F.col("lag_y")).alias("lag_y"), X.steady(F.col("lag_size")).alias("lag_size"))


_MORAN = f"""with {_VALUES}, z as (select id, y - avg(y) over () as z from v), w as (select i, j, 1.0e0/6 as w from ({_KNN}) k),
m as (select count(*) as n, sum(z*z) as z2, sum(power(z,4)) as z4 from z),
x as (select sum(w*a.z*b.z) as cross_, sum(w) as s0 from w join z a on a.id = w.i join z b on b.id = w.j),
p as (select sum(power(coalesce(a.w,0) + coalesce(b.w,0), 2))/2 as s1 from w a full join w b on a.i = b.j and a.j = b.i),
q as (select sum(power(coalesce(r,0) + coalesce(c,0), 2)) as s2 from (select i as id, sum(w) as r from w group by i) a full join (select j as id, sum(w) as c from w group by j) b using (id)),
t as (select n/s0*cross_/z2 as i, -1.0e0/(n-1) as expected, (n*((n*n-3*n+3)*s1 - n*s2 + 3*s0*s0) - n*z4/(z2*z2)*((n*n-n)*s1 - 2*n*s2 + 6*s0*s0))/((n-1.0e0)*(n-2)*(n-3)*s0*s0) - 1.0e0/power(n-1,2) as variance from m, x, p, q),
u as (select *, abs(i - expected)/sqrt(2*variance) as e from t)
select {R.format('i')} as i, {R.format('expected')} as expected, {R.format('variance')} as variance,
 {R.format("case when e > 4.3 then 0 else 1 - 2/sqrt(pi())*list_sum(list_transform(range(0, 120), lambda k: (1 - 2*(k % 2))*power(e, 2*k + 1)/(exp(lgamma(k + 1.0e0))*(2*k + 1)))) end")} as p from u"""


@query(_MORAN)
def sta3_morans_i(i: Inputs) -> DataFrame:
    s = M.morans_i(values(i).select("id", "y"), site_weights(i), "y")
    names = ("i", "expected", "variance", "p")
    row = i.sites.sparkSession.createDataFrame([tuple(float(s[k]) for k in names)], ", ".join(f"{k} double" for k in names))
    return row.select(*[X.steady(F.col(k)).alias(k) for k in names])


@query(f"with {_VALUES} select 'size' as term, round(regr_slope(y, size)+1e-9,4) as estimate, count(*) as n from v union all select 'intercept', round(regr_intercept(y, size)+1e-9,4), count(*) from v")
def sta5_least_squares(i: Inputs) -> DataFrame:
    return M.fit_groups(values(i), "y", ["size"]).select("term", X.steady(F.col("estimate"), 4).alias("estimate"), "n")


#: Measures of the sweep, and its scenarios: walk time, least coverage, whether site types are controls, outcome.
MEASURES = ["pct_low_income", "pct_visible_minority", "pct_bachelors_and_above", "pct_indigenous_identity"]
SWEEP = {"main": (10, 0, True, "log_activity"), "coverage90": (10, 90, True, "log_activity"), "population20": (20, 0, True, "log_activity"), "no_site_type": (10, 0, False, "log_activity"), "raw_outcome": (10, 0, True, "site_activity_index")}

_SWEEP = f"""with c as (select park_num, 100.0e0*count(*)/360 as cover from v_hours group by park_num),
g as ({" union all ".join(f"select '{k}' as scenario, {w} as w, {c} as least, {t} as types, '{y}' as outcome" for k, (w, c, t, y) in SWEEP.items())}),
m as ({" union all ".join(f"select park_num, walktime_min, '{c}' as measure, {c} as x from v_census where hasdata = 1" for c in MEASURES)}),
l as (select scenario, measure, case when types then site_type else 'all' end as k, case when outcome = 'log_activity' then ln(site_activity_index) else site_activity_index end as y, m.x
 from v_hours h join c using (park_num) join v_sites s using (park_num) join m using (park_num) join g on g.w = m.walktime_min and cover >= least),
d as (select scenario, measure, x - avg(x) over p as x, y - avg(y) over p as y from l window p as (partition by scenario, measure, k))
select scenario, measure, count(*) as n, {R.format('sum(x*y)/sum(x*x)')} as estimate from d group by scenario, measure"""


@query(_SWEEP)
def sta8_scenario_sweep(i: Inputs) -> DataFrame:
    """Activity on each measure under each scenario, site types as controls; the twin takes the means of types off."""
    types = ["lakefront", "riverfront", "coastal waterfront without beach"]
    cover = P.count_by(i.stored_hours, "park_num").select("park_num", (F.col("n") * 100.0 / P.POSSIBLE).alias("cover"))
    dummies = {f"type_{k}": (F.col("site_type") == t).cast("double") for k, t in enumerate(types)}
    site = cover.join(i.sites.select("park_num", "site_type"), "park_num").withColumns(dummies)
    census = i.census.filter("hasdata = 1").select("park_num", "walktime_min", *MEASURES)
    rows = i.stored_hours.select("park_num", "site_activity_index", F.ln("site_activity_index").alias("log_activity")).join(site.join(census, "park_num"), "park_num")
    keep = {k: ((F.col("walktime_min") == w) & (F.col("cover") >= c), y, list(dummies) if t else []) for k, (w, c, t, y) in SWEEP.items()}
    return M.fit_scenarios(rows, keep, MEASURES).select("scenario", "measure", "n", X.steady(F.col("estimate")).alias("estimate"))


@query("with l as (select walktime_min, predictor, outcome, a, b from (select walktime_min, 'low_income' as predictor, pct_low_income as a, 'minority' as outcome, pct_visible_minority as b from v_census union all select walktime_min, 'education', pct_bachelors_and_above, 'minority', pct_visible_minority from v_census union all select walktime_min, 'low_income', pct_low_income, 'indigenous', pct_indigenous_identity from v_census union all select walktime_min, 'education', pct_bachelors_and_above, 'indigenous', pct_indigenous_identity from v_census) q) select predictor, outcome, n, round(r+1e-9,6) as r, round(" + CORR_P + "+1e-9,6) as p from (select predictor, outcome, count(*) as n, corr(a,b) as r from l group by predictor, outcome) q")
def sta17_correlation_grid(i: Inputs) -> DataFrame:
    c = i.census.select("park_num", "walktime_min", F.col("pct_low_income").alias("low_income"), F.col("pct_bachelors_and_above").alias("education"), F.col("pct_visible_minority").alias("minority"), F.col("pct_indigenous_identity").alias("indigenous"))
    left = c.unpivot(["minority", "indigenous"], ["low_income", "education"], "predictor", "a")
    long = left.unpivot(["predictor", "a"], ["minority", "indigenous"], "outcome", "b")
    found = long.groupBy("predictor", "outcome").agg(F.count("*").alias("n"), F.corr("a", "b").alias("r"))
    return found.select("predictor", "outcome", "n", X.steady(F.col("r")).alias("r"), X.steady(M.correlation_p(F.col("r"), F.col("n"))).alias("p"))


@query("select outcome, family, aic from (select *, row_number() over (partition by outcome order by k, family) as r from (select *, (case when family = 'ols' and moran_p >= 0.05 then 0 when family <> 'ols' and moran_p >= 0.05 then 1 else 2 end)*1e9 + aic as k from (select park_num as outcome, f.family, 100.0e0 + (park_num * f.n) % 13 as aic, ((park_num * f.n) % 20)/100.0e0 as moran_p from v_sites, (select 'ols' as family, 3 as n union all select 'lag', 5 union all select 'error', 7) f) c) q) z where r = 1")
def sta12_choose_family(i: Inputs) -> DataFrame:
    families = F.explode(F.array(*[F.struct(F.lit(f).alias("family"), F.lit(n).alias("n")) for f, n in (("ols", 3), ("lag", 5), ("error", 7))]))
    c = i.sites.select(F.col("park_num").alias("outcome"), families.alias("f")).select("outcome", "f.family", (F.lit(100.0) + F.col("outcome") * F.col("f.n") % 13).alias("aic"), ((F.col("outcome") * F.col("f.n") % 20) / F.lit(100.0)).alias("moran_p"))
    return M.choose_family(c)


_FIT = """m as (select count(*) as n, avg(size) as mx, avg(y) as my, var_pop(size)*count(*) as sxx, covar_pop(size, y)*count(*) as sxy, var_pop(y)*count(*) as syy from v),
f as (select *, sxy/sxx as b, my - sxy/sxx*mx as a, syy - sxy*sxy/sxx as rss from m),
g as (select *, sqrt(rss/(n-2)/sxx) as se_b, sqrt(rss/(n-2)*(1.0e0/n + mx*mx/sxx)) as se_a, -n/2.0e0*(ln(2*pi()) + ln(rss/n) + 1) as loglik from f),
h as (select 'size' as term, b as estimate, se_b as se, n, loglik from g union all select 'intercept', a, se_a, n, loglik from g),
k as (select *, estimate/se/sqrt(power(estimate/se, 2) + n - 2) as r from h)"""


@query(f"with {_VALUES}, {_FIT} select term, n, {R.format('estimate')} as estimate, {R.format('se')} as std_error, {R.format(CORR_P)} as p_value, round(loglik + 1e-9, 4) as loglik, round(6 - 2*loglik + 1e-9, 4) as aic from k")
def sta5_fit_statistics(i: Inputs) -> DataFrame:
    fit = M.fit_groups(values(i), "y", ["size"])
    return fit.select("term", "n", *[X.steady(F.col(c)).alias(c) for c in ("estimate", "std_error", "p_value")], *[X.steady(F.col(c), 4).alias(c) for c in ("loglik", "aic")])


_ROBUST = """m as (select count(*) as n, avg(size) as m1, avg(muni) as m2, avg(y) as my, var_pop(size)*count(*) as s11, var_pop(muni)*count(*) as s22, covar_pop(size,muni)*count(*) as s12, covar_pop(size,y)*count(*) as s1, covar_pop(muni,y)*count(*) as s2, corr(size,muni) as c from v),
b as (select *, s11*s22 - s12*s12 as d, (s1*s22 - s2*s12)/(s11*s22 - s12*s12) as b1, (s2*s11 - s1*s12)/(s11*s22 - s12*s12) as b2 from m),
e as (select b.*, (s22*(size-m1) - s12*(muni-m2))/d as a1, (s11*(muni-m2) - s12*(size-m1))/d as a2, y - my - b1*(size-m1) - b2*(muni-m2) as res, size - m1 as x1, muni - m2 as x2 from v, b),
q as (select *, res/(1 - 1.0e0/n - a1*x1 - a2*x2) as u, 1.0e0/n - m1*a1 - m2*a2 as a0 from e)"""


@query(
    f"with {_VALUES}, {_ROBUST} select 'hc3' as model, 'intercept' as term, {R.format('sqrt(sum(power(a0*u, 2)))')} as value from q union all select 'hc3', 'size', {R.format('sqrt(sum(power(a1*u, 2)))')} from q union all select 'hc3', 'muni', {R.format('sqrt(sum(power(a2*u, 2)))')} from q"
    f" union all select 'vif', 'size', {R.format('1/(1-c*c)')} from m union all select 'vif', 'muni', {R.format('1/(1-c*c)')} from m"
)
def sta6_sta7_robust_errors(i: Inputs) -> DataFrame:
    """HC3 standard errors and variance inflation of two predictors."""
    v = values(i)
    _, cov = M.hc3(v, "y", ["size", "muni"])
    rows = [("hc3", t, cov[k, k] ** 0.5) for k, t in enumerate(["intercept", "size", "muni"])] + [("vif", t, x) for t, x in M.vif(v, ["size", "muni"]).items()]
    return _terms(i, rows).withColumn("value", X.steady(F.col("value")))


def _terms(i: Inputs, rows: list[tuple]) -> DataFrame:
    return i.sites.sparkSession.createDataFrame([(a, b, float(c)) for a, b, c in rows], "model string, term string, value double")


@query()
def sta4_sta6_sta7_residual_tests(i: Inputs) -> DataFrame:
    v, w = values(i), site_weights(i)
    moran = M.residual_moran(v, w, "y", ["size", "muni"])
    beta, cov = M.hc3(v, "y", ["size", "muni"])
    rows = [("moran", k, x) for k, x in moran.items()] + [("hc3", t, cov[k, k] ** 0.5) for k, t in enumerate(["intercept", "size", "muni"])]
    return _terms(i, rows + [("vif", t, x) for t, x in M.vif(v, ["size", "muni"]).items()])


@query()
def sta9_to_sta11_spatial_models(i: Inputs) -> DataFrame:
    v, w = values(i), site_weights(i)
    spectrum = M.Spectrum(w)
    lag, err = M.spatial_lag_model(v, w, "y", ["size"], spectrum), M.spatial_error_model(v, w, "y", ["size"], spectrum)
    rows = [("lag", k, lag[k]) for k in ("rho", "se_rho", "aic")] + [("lag impact", k, x) for k, x in lag["impacts"]["size"].items()]
    return _terms(i, rows + [("error", k, err[k]) for k in ("lambda", "aic")])


def _mixed(i: Inputs) -> dict:
    """Site-hours with two predictors under random intercepts of sites."""
    size = i.sites.select("park_num", (F.col("h") / 100).alias("size"))
    rows = i.stored_hours.withColumn("cells", F.col("unique_cells_used").cast("double")).join(size, "park_num")
    return M.mixed_model(rows.select(*P.KEYS, "site_activity_index", "size", "cells"), "site_activity_index", ["size", "cells"], "park_num")


@query()
def sta13_sta14_mixed_model(i: Inputs) -> DataFrame:
    m = _mixed(i)
    out = [("fixed", t, b) for t, b in zip(m["term"], m["beta"])] + [("se", t, b) for t, b in zip(m["term"], m["se"])]
    return _terms(i, out + [("model", k, m[k]) for k in ("site_variance", "sigma2", "icc", "loglik", "aic", "bic", "residual_skewness")])


@query()
def sta14_site_intercepts(i: Inputs) -> DataFrame:
    """The predicted intercept of each site."""
    return _mixed(i)["blup"].select("park_num", X.steady(F.col("blup")).alias("intercept"))


def _filtered(i: Inputs) -> dict:
    points = G.written(i.sites.join(i.stored_hours.select("park_num").distinct(), "park_num").select(F.col("park_num").alias("id"), "x", "y"), "points")
    rows = i.stored_hours.join(i.sites.select("park_num", (F.col("h") / 100).alias("size")), "park_num")
    return M.filtered_mixed_model(rows.select(*P.KEYS, "site_activity_index", "size"), points, "site_activity_index", ["size"], "park_num")


@query()
def sta15_sta16_filtered_model(i: Inputs) -> DataFrame:
    m = _filtered(i)
    return _terms(i, [("fixed", t, b) for t, b in zip(m["term"], m["beta"])] + [("model", k, m[k]) for k in ("sigma2", "loglik", "vectors")])


@query()
def sta16_residuals(i: Inputs) -> DataFrame:
    """The residual of every site-hour under the filtered model."""
    return _filtered(i)["residuals"].select(*P.KEYS, X.steady(F.col("residual"), 4).alias("residual"))


def connecting_k(points: DataFrame, least: int = 6, most: int = 12) -> int:
    """The least number of neighbours, from ``least`` on, that connects all points (id, x, y). As more neighbours keep
    what fewer connect, the number fetched doubles until it connects, then halving finds the least."""
    total = points.count()

    def connects(near: DataFrame, k: int) -> bool:
        pairs = near.filter(F.col("rank") <= k).select(F.col("i").alias("u"), F.col("j").alias("v"), F.lit(1.0).alias("len"))
        return k >= total - 1 or G.connected(pairs).select("component").distinct().count() <= 1

    low = least - 1  # does not connect, or is not asked for
    while True:
        near = G.written(S.nearest_points(points, most, 1000.0), "near")
        if connects(near, most):
            break
        low, most = most, most * 2
    while most - low > 1:
        k = (low + most) // 2
        low, most = (low, k) if connects(near, k) else (k, most)
    return most


_GRF8 = """with recursive k as (select a.park_num as i, b.park_num as j, row_number() over (partition by a.park_num order by sqrt(power(a.x-b.x,2)+power(a.y-b.y,2)), b.park_num) as r from v_sites a join v_sites b on a.park_num <> b.park_num),
e as (select i, j, r from k where r <= 40 union all select j, i, r from k where r <= 40),
c as (select g.k, (select min(park_num) from v_sites) as node from (select unnest(range(6, 41)) as k) g union select c.k, e.j from c join e on e.i = c.node and e.r <= c.k),
n as (select count(*) as sites from v_sites), f as (select k, count(*) as found from c group by k)
select sites, cast(min(f.k) as int) as k from n, f where found = sites or f.k >= sites - 1 group by sites"""


@query(_GRF8)
def grf8_smallest_connecting_k(i: Inputs) -> DataFrame:
    """The least number of neighbours, from six on, that connects all sites."""
    found = connecting_k(i.sites.select(F.col("park_num").alias("id"), "x", "y"))
    return i.sites.agg(F.count("*").alias("sites")).withColumn("k", F.lit(found))


#: Predictors, and the controls of site type (against beach) and size.
PREDICTORS = {"shelter": "shelter_expenditures_principal", "low_income": "pct_low_income", "bachelors": "pct_bachelors_and_above", "minority": "pct_visible_minority", "indigenous": "pct_indigenous_identity"}
TYPES = {"no_beach": "coastal waterfront without beach", "lakefront": "lakefront", "riverfront": "riverfront"}
OUTCOMES = ["pedestrian", "transit", "visual", "haptic", "physical", "multidimensional"]


def access_models(i: Inputs, k: int = 6) -> DataFrame:
    """All families of the access models: four walk times, six outcomes, with and without controls. A site stands in each
    walk time's sample by its own number, far from the other samples, so one search finds the neighbours of all."""
    near = S.within(i.stops, i.sites.select("park_num", F.col("x").alias("x2"), F.col("y").alias("y2")), 1800.0).select("park_num", "distance")
    times = i.census.select("walktime_min").distinct()
    stops = near.join(F.broadcast(times)).filter("distance <= 60 * walktime_min").groupBy("park_num", "walktime_min").agg(F.count("*").alias("stops"), F.avg("distance").alias("far"))
    cells = i.placed.groupBy("park_num").agg(F.count("*").alias("cells"), F.avg(F.col("x") % 97).alias("shade"))
    base = i.census.filter("hasdata = 1").dropna(subset=list(PREDICTORS.values())).join(i.sites.select("park_num", "site_type", "h", "x", "y"), "park_num")
    base = base.join(stops, ["park_num", "walktime_min"], "left").join(cells, "park_num", "left")
    zero = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    raw = {"pedestrian": zero("stops") + F.col("pct_low_income") / 50, "transit": zero("far"), "visual": zero("shade"), "haptic": zero("cells") / F.col("h")}
    full = base.select("park_num", "walktime_min", "x", "y", "site_type", F.log(4 * F.col("h") * F.col("h")).alias("log_area"), *[v.alias(n) for n, v in raw.items()], *[F.col(c).alias(n) for n, c in PREDICTORS.items()])
    full = W.min_max(G.written(full, "raw"), {f"{c}_scaled": c for c in raw}, "walktime_min")
    full = full.withColumn("physical", (F.col("pedestrian_scaled") + F.col("transit_scaled")) / 2).withColumn("multidimensional", (F.col("physical") + F.col("visual_scaled") + F.col("haptic_scaled")) / 3)
    scaled = W.z_score(G.written(full, "outcomes"), {f"z_{c}": c for c in [*OUTCOMES, *PREDICTORS, "log_area"]}, "walktime_min")
    rows = scaled.withColumn("id", F.col("park_num").cast("long") * 100 + F.col("walktime_min")).withColumns({n: (F.col("site_type") == t).cast("double") for n, t in TYPES.items()})
    rows = G.written(rows.fillna(0.0, subset=[f"z_{c}" for c in OUTCOMES]), "rows")  # a constant outcome
    places = rows.select("id", (F.col("x") + F.col("walktime_min") * 1e7).alias("x"), "y")
    w = G.written(M.weights(S.nearest_points(places, k, 1000.0)), "weights")
    baseline = [f"z_{c}" for c in PREDICTORS]
    found = SW.family_candidates(rows, w, "walktime_min", [f"z_{c}" for c in OUTCOMES], {"baseline": baseline, "controlled": [*baseline, *TYPES, "z_log_area"]})
    return found.withColumn("outcome", F.substring("outcome", 3, 99))


@query()
def sta8_access_models(i: Inputs) -> DataFrame:
    """Every model's size, AIC, residual Moran p and spatial parameter (0 for least squares)."""
    return access_models(i).select("walktime_min", "outcome", "specification", "family", "n", X.steady(F.col("aic"), 4).alias("aic"), X.steady(F.col("moran_p")).alias("moran_p"), F.nanvl("spatial", F.lit(0.0)).alias("spatial"))


@query()
def sta12_access_families(i: Inputs) -> DataFrame:
    """The family of each walk time and outcome, chosen from the fits, and again under controls where residuals ask for it."""
    found = SW.choose_and_recheck(access_models(i), "walktime_min")
    return found.select("walktime_min", "outcome", "baseline_family", "baseline_reason", "rechecked", "final_family", *[X.steady(F.col(c)).alias(c) for c in ("baseline_p", "controlled_p", "final_p")])
