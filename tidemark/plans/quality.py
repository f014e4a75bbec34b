"""Report tables of the site pipelines: lookup checks, pairs of dimensions, shoreline proxies, eligibility, statuses."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import expr as X
from tidemark.operators import contracts as C
from tidemark.operators import models as M
from tidemark.operators import panel as P
from tidemark.operators import scores as SC
from tidemark.operators import spatial as S
from tidemark.operators import windows as W
from tidemark.plans.panels import CORR_P, R
from tidemark.plans.registry import query
from tidemark.plans.scores import _PAIRS, DIMENSIONS
from tidemark.plans.spatials import _D, streets
from tidemark.sources.fixtures import Inputs


@query(
    "with n as (select park_num, count(*) as cells from v_lookup group by park_num),"
    " d as (select park_num, geography, count(*) as k from v_lookup group by park_num, geography having count(*) > 1)"
    " select 'matches' as report, 'pairs' as item, count(*)::double as value from v_lookup"
    " union all select 'matches', 'cells', count(distinct geography) from v_lookup"
    " union all select 'matches', 'sites', count(distinct park_num) from v_lookup"
    " union all select 'cells per site', 'minimum', min(cells) from n union all select 'cells per site', 'maximum', max(cells) from n"
    " union all select 'cells per site', 'median', quantile_cont(cells, 0.5) from n"
    " union all select 'cells per site', park_num::varchar, cells from n"
    " union all select 'sites without cells', park_num::varchar, 0 from v_sites where park_num not in (select park_num from n)"
    " union all select 'cells in several sites', geography, count(distinct park_num) from v_lookup group by geography having count(distinct park_num) > 1"
    " union all select 'repeated pairs', park_num::varchar || ' ' || geography, k from d"
)
def cmp11_lookup_tables(i: Inputs) -> DataFrame:
    """The five checks of a cell lookup in one long table: matches, cells per site, sites without cells, cells of several
    sites, repeated pairs."""
    return SC.square_checks(i.cells, i.sites)


_LONG = " union all ".join(f"select park_num, walktime_min, '{a}' as first, '{b}' as second, {a} as x, {b} as y from v_census where hasdata = 1" for a, b in _PAIRS)
_RANKS = f"""l as ({_LONG}), k as (select *, rank() over (p order by x) + (count(*) over (partition by walktime_min, first, second, x) - 1)/2.0e0 as a,
 rank() over (p order by y) + (count(*) over (partition by walktime_min, first, second, y) - 1)/2.0e0 as b from l window p as (partition by walktime_min, first, second)),
g as (select walktime_min, first, second, count(*) as n, corr(x,y) as pearson, corr(a,b) as spearman, quantile_cont(x,0.5) as x_median, quantile_cont(y,0.5) as y_median from k group by walktime_min, first, second)"""


def _P(r: str) -> str:  # noqa: N802
    return re.sub(r"\br\b", r, CORR_P)


def pairs_of(i: Inputs) -> DataFrame:
    return SC.dimension_pairs(i.census.filter("hasdata = 1"), list(DIMENSIONS), ["park_num", "walktime_min"])


@query(
    f"with {_RANKS} select walktime_min, first, second, n, {R.format('pearson')} as pearson_r, {R.format(_P("pearson"))} as pearson_p,"
    f" {R.format('spearman')} as spearman_rho, {R.format(_P("spearman"))} as spearman_p, x_median, y_median from g"
)
def cmp12_pair_correlations(i: Inputs) -> DataFrame:
    """Pearson and Spearman with p-values, and both medians, for every pair of dimensions at every walk time."""
    s = SC.pair_statistics(pairs_of(i), ["walktime_min", "first", "second"])
    p = lambda r: X.steady(M.correlation_p(F.col(r), F.col("n")))
    return s.select(
        "walktime_min", "first", "second", "n", X.steady(F.col("pearson_r")).alias("pearson_r"), p("pearson_r").alias("pearson_p"),
        X.steady(F.col("spearman_rho")).alias("spearman_rho"), p("spearman_rho").alias("spearman_p"), "x_median", "y_median",
    )


_Z = f"""l as ({_LONG}), z as (select *, (x - avg(x) over p)/nullif(stddev_samp(x) over p, 0) as xz, (y - avg(y) over p)/nullif(stddev_samp(y) over p, 0) as yz from l window p as (partition by walktime_min, first, second)),
d as (select *, abs(xz - yz) as gap, row_number() over (partition by walktime_min, first, second order by round(abs(xz - yz), 9) desc, park_num) as place from z where xz is not null and yz is not null)"""


@query(f"with {_Z} select walktime_min, first, second, cast(place as int) as place, park_num, x, y, {R.format('xz')} as x_z, {R.format('yz')} as y_z, {R.format('gap')} as gap from d where place <= 5")
def cmp12_extreme_sites(i: Inputs) -> DataFrame:
    """The five sites of each pair whose standardised values are farthest apart."""
    d = SC.divergence(pairs_of(i), ["walktime_min", "first", "second"])
    top = W.top_per_group(d, 5, ["walktime_min", "first", "second"], F.desc(F.round("gap", 9)), F.col("park_num"))
    return top.select("walktime_min", "first", "second", F.col("rank").cast("int").alias("place"), "park_num", "x", "y", *[X.steady(F.col(c)).alias(c) for c in ("x_z", "y_z", "gap")])


#: Shoreline pieces are streets of the lattice; stops are the features that may touch them, by kind.
KINDS = ("barrier", "bridge", "beach")
_SIDE = "(vx-ux)*(y-uy) - (vy-uy)*(x-ux) >= 0"
_TOUCH = f"t as (select u*100000+v as id, stop_id, case stop_id % 3 when 0 then 'barrier' when 1 then 'bridge' else 'beach' end as kind from v_network n join v_stops s on {_D} <= 10 and {_SIDE})"
_PIECE = "p as (select u*100000+v as id, cast(u % 97 as int) as park_num, len, coalesce(case when (u+v) % 13 <> 0 then cast((u*7+v) % 12 as double) end <= 5.710593137499643, false) as gentle from v_network)"


def pieces(i: Inputs) -> DataFrame:
    u, v = F.col("u"), F.col("v")
    slope = F.when((u + v) % 13 != 0, ((u * 7 + v) % 12).cast("double"))
    gentle = F.coalesce(slope <= F.degrees(F.atan(F.lit(0.10))), F.lit(False))
    return streets(i).select("id", (u % 97).cast("int").alias("park_num"), "len", "ax", "ay", "bx", "by", gentle.alias("gentle"))


def touching(i: Inputs) -> DataFrame:
    """Features within ten metres on the land side (left) of a piece, with their kind."""
    side = (F.col("bx") - F.col("ax")) * (F.col("y") - F.col("ay")) - (F.col("by") - F.col("ay")) * (F.col("x") - F.col("ax"))
    near = S.points_near_segments(i.stops, pieces(i), 10.0).filter(side >= 0)
    k = F.col("stop_id") % 3
    return near.select("id", "stop_id", F.when(k == 0, "barrier").when(k == 1, "bridge").otherwise("beach").alias("kind")).distinct()


@query(f"with {_TOUCH} select id, stop_id, kind from t")
def jn17_land_side_features(i: Inputs) -> DataFrame:
    return touching(i)


_F = {"barrier_affected": "barrier", "bridge_affected": "bridge", "beach_sand": "beach", "approachable": "gentle or beach", "unobstructed_approachable": "(gentle or beach) and not barrier", "barrier_on_approachable": "(gentle or beach) and barrier"}


@query(
    f"with {_TOUCH}, {_PIECE}, f as (select p.*, {', '.join(f'coalesce(bool_or(kind = {k!r}), false) as {k}' for k in KINDS)}, count(t.stop_id) as n from p left join t using (id) group by all)"
    f" select park_num, count(*) as segment_count, sum(len) as shoreline_length_m, cast(sum(n) as bigint) as feature_count,"
    f" {', '.join(f'{R.format(f'count(*) filter (where {c})*1.0e0/count(*)')} as {k}_segment_ratio, {R.format(f'coalesce(sum(len) filter (where {c}), 0)/sum(len)')} as {k}_shoreline_ratio' for k, c in _F.items())},"
    f" {R.format(f'coalesce(sum(len) filter (where {_F['unobstructed_approachable']}), 0)/sum(len)')} as haptic_access_proxy_score from f group by park_num"
)
def cmp6_haptic_proxy(i: Inputs) -> DataFrame:
    """Twelve clipped ratios and the score of every site, from shoreline pieces, their slope and the features that touch
    their land side; bridges are counted and not scored."""
    flags = touching(i).groupBy("id").agg(*[F.bool_or(F.col("kind") == k).alias(k) for k in KINDS], F.count("*").alias("n"))
    full = pieces(i).drop("ax", "ay", "bx", "by").join(flags, "id", "left")
    full = full.withColumns({k: F.coalesce(k, F.lit(False)) for k in KINDS} | {"n": F.coalesce("n", F.lit(0))})
    return SC.haptic_proxy(full, "park_num", "len")


@query(
    f"select h.park_num, count(*) as hours, {R.format('100.0e0*count(*)/360')} as coverage_pct, bool_or(a.hasdata = 1) as main_model_eligible, bool_or(a.hasdata = 1) and 100.0e0*count(*)/360 >= 90 as coverage90_model_eligible,"
    " bool_or(b.hasdata = 1) as population20_sensitivity_eligible from v_hours h left join v_census a on a.park_num = h.park_num and a.walktime_min = 10 left join v_census b on b.park_num = h.park_num and b.walktime_min = 20 group by h.park_num"
)
def cnd6_model_eligibility(i: Inputs) -> DataFrame:
    """Which models a site's rows may enter: main, well covered, and by the population at twenty minutes."""
    return SC.eligibility(P.count_by(i.hours, "park_num", name="hours"), i.census, P.POSSIBLE)


# Waterfronts with activity, and those that each model's column admits.
EXPECTED = {"activity_available": 103, "main_model_eligible": 98, "coverage90_model_eligible": 76, "population20_sensitivity_eligible": 103}
_ELIGIBLE = "e as (select h.park_num, true as activity_available, bool_or(a.hasdata = 1) as main_model_eligible, bool_or(a.hasdata = 1) and 100.0e0*count(*)/360 >= 90 as coverage90_model_eligible, bool_or(b.hasdata = 1) as population20_sensitivity_eligible from v_hours h left join v_census a on a.park_num = h.park_num and a.walktime_min = 10 left join v_census b on b.park_num = h.park_num and b.walktime_min = 20 group by h.park_num)"


@query(
    f"with {_ELIGIBLE}, c as ({' union all '.join(f'select {k!r} as eligible, count(*) filter (where {k}) as sites, cast({n} as bigint) as expected from e' for k, n in EXPECTED.items())}) select *, sites = expected as ok from c"
)
def flt6_val3_scenario_samples(i: Inputs) -> DataFrame:
    """Sites that each scenario's named column admits, against the sizes that the published models expect."""
    e = SC.eligibility(P.count_by(i.hours, "park_num", name="hours"), i.census, P.POSSIBLE)
    return C.sample_sizes(e.withColumn("activity_available", F.lit(True)), EXPECTED)


_STATUS = "case when s.h <= 1 then 'park polygon not found' when coalesce(n_local,0) = 0 then 'no local network found' when coalesce(n_walk,0) = 0 then 'no walkable local network found' when coalesce(n_out,0) = 0 then 'no outside linework' when coalesce(n_graph,0) = 0 then 'outside graph could not be built' when coalesce(n_origin,0) = 0 then 'no routing origin points' else 'processed' end"
_COUNTS = {"n_local": "true", "n_walk": "(u+v) % 4 <> 0", "n_out": "(u+v) % 4 <> 0 and u % 3 <> 0", "n_graph": "(u+v) % 4 <> 0 and u % 3 <> 0 and v % 5 <> 0", "n_origin": "(u+v) % 4 <> 0 and u % 3 <> 0 and v % 5 <> 0 and u % 7 = 1"}


@query(
    f"select s.park_num, {', '.join(f'cast(case when s.h <= 1 then 0 else coalesce({k},0) end as bigint) as {k}' for k in _COUNTS)}, {_STATUS} as status from v_sites s left join (select cast(u % 150 as int) as park_num, {', '.join(f'count(*) filter (where {c}) as {k}' for k, c in _COUNTS.items())} from v_network where u % 11 <> 0 group by 1) n using (park_num)"
)
def cnd9_site_statuses(i: Inputs) -> DataFrame:
    """A row for every site, with zero counts and the first step that found nothing."""
    near = i.network.filter("u % 11 <> 0").groupBy((F.col("u") % 150).cast("int").alias("park_num")).agg(*[F.count_if(F.expr(c)).alias(k) for k, c in _COUNTS.items()])
    return SC.site_statuses(i.sites.select("park_num", (F.col("h") > 1).alias("has_polygon")), near, "park_num")


#: Sites with a notch from the north: the centroid lies in the notch, so that the inside point is on a leg.
_U = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (2.5, 4.0), (2.5, 1.0), (1.0, 1.0), (1.0, 4.0), (0.0, 4.0)]


#: Sites of sloping sides.
_TRAPEZIUM = [(0.0, 0.0), (2.0, 0.0), (1.0, 2.0), (0.0, 2.0)]


@query(
    f"select park_num, {R.format('22*h')} as perimeter, {R.format('11.5e0*h*h')} as area, {R.format('x + 3.25e0*h')} as inside_x, {R.format('y + 20.75e0/11.5e0*h')} as inside_y from v_sites where park_num % 2 = 0"
    f" union all select park_num, {R.format('(5 + sqrt(5.0e0))*h')}, {R.format('3*h*h')}, {R.format('x + 7.0e0/9*h')}, {R.format('y + 8.0e0/9*h')} from v_sites where park_num % 2 = 1"
)
def geo2_geo3_other_polygons(i: Inputs) -> DataFrame:
    """Perimeter, area and inside point of notched polygons and of trapeziums."""
    ring = lambda corners: F.array(*[F.struct((F.col("x") + a * F.col("h")).alias("x"), (F.col("y") + b * F.col("h")).alias("y")) for a, b in corners])
    shape = i.sites.select("park_num", F.when(F.col("park_num") % 2 == 0, ring(_U)).otherwise(ring(_TRAPEZIUM)).alias("ring"))
    r = F.col("ring")
    full = shape.select("park_num", S.perimeter(r).alias("perimeter"), S.area(r).alias("area"), S.inside_point(r).alias("p"))
    return full.select("park_num", *[X.steady(F.col(c)).alias(n) for n, c in (("perimeter", "perimeter"), ("area", "area"), ("inside_x", "p.x"), ("inside_y", "p.y"))])
