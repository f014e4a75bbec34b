"""Linework, sample sizes and report tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import expr as X
from tidemark.operators import contracts as C
from tidemark.operators import lines as L
from tidemark.operators import models as M
from tidemark.operators import spatial as S
from tidemark.operators import windows as W
from tidemark.plans.panels import CORR_P
from tidemark.plans.registry import query
from tidemark.plans.spatials import _ALONG, _D, BOXES, boxes, streets
from tidemark.sources.fixtures import Inputs


@query(f"select park_num, round(sum(len - case when across then greatest(0, inside) else 0 end)+1e-9,6) as outside_m from ({_ALONG.format(BOXES=BOXES)}) l where across and inside >= 0 and len - greatest(0, inside) > 0.001 group by park_num")
def jn15_lines_outside(i: Inputs) -> DataFrame:
    lines = streets(i).select("id", "ax", "ay", "bx", "by")
    return S.split_inside(lines, boxes(i), "park_num", False).groupBy("park_num").agg(X.steady(F.sum("length")).alias("outside_m"))


@query(f"select distinct u*100000+v as id, stop_id, cast(stop_id % 3 as int) as kind from v_network n join v_stops s on {_D} <= 10")
def jn17_features_near_segments(i: Inputs) -> DataFrame:
    """One row for each segment and feature within ten metres, with the feature's kind."""
    near = S.points_near_segments(i.stops, streets(i), 10.0)
    return near.select("id", "stop_id", (F.col("stop_id") % 3).cast("int").alias("kind")).distinct()


@query(f"select n.u*100000+n.v as id, count(*) as land_cells from v_network n join (select (c+0.5e0)*25 as x, (r+0.5e0)*25 as y from v_raster where water = 0) s on {_D} <= 15 group by n.u*100000+n.v")
def jn22_land_side_cells(i: Inputs) -> DataFrame:
    centres = i.raster.filter("water = 0").select(((F.col("c") + 0.5) * 25).alias("x"), ((F.col("r") + 0.5) * 25).alias("y"))
    return S.points_near_segments(centres, streets(i), 15.0).groupBy("id").agg(F.count("*").alias("land_cells"))


def diagonals(i: Inputs) -> DataFrame:
    """Streets and, every so often, a diagonal that crosses them."""
    s = streets(i).select("id", "ax", "ay", "bx", "by")
    extra = s.filter("id % 7 = 0").select((-F.col("id")).alias("id"), (F.col("ax") + 50).alias("ax"), (F.col("ay") - 50).alias("ay"), (F.col("ax") + 150).alias("bx"), (F.col("ay") + 50).alias("by"))
    return s.unionByName(extra)


_NODED = """with s as (select u*100000+v as id, ux as ax, uy as ay, vx as bx, vy as "by" from v_network), l as (select * from s union all select -id, ax+50, ay-50, ax+150, ay+50 from s where id % 7 = 0),
x as (select a.id, round(((b.ax-a.ax)*(b.by-b.ay)-(b.ay-a.ay)*(b.bx-b.ax))/d, 9) as t, round(((b.ax-a.ax)*(a.by-a.ay)-(b.ay-a.ay)*(a.bx-a.ax))/d, 12) as w
 from (select a, b, (a.bx-a.ax)*(b.by-b.ay)-(a.by-a.ay)*(b.bx-b.ax) as d from l a join l b on a.id <> b.id and least(a.ax,a.bx) <= greatest(b.ax,b.bx) and least(b.ax,b.bx) <= greatest(a.ax,a.bx) and least(a.ay,a.by) <= greatest(b.ay,b.by) and least(b.ay,b.by) <= greatest(a.ay,a.by)) q where d <> 0),
m as (select id, ((x-ax)*(bx-ax)+(y-ay)*("by"-ay))/((bx-ax)*(bx-ax)+("by"-ay)*("by"-ay)) as t, sqrt(power(bx-ax,2)+power("by"-ay,2)) as len, ax, ay, bx, "by", x, y from l, v_stops where x between least(ax,bx)-1 and greatest(ax,bx)+1 and y between least(ay,"by")-1 and greatest(ay,"by")+1),
t as (select id, t from x where t between 0 and 1 and w between 0 and 1 union select id, round(t, 9) from m where sqrt(power(x-ax-t*(bx-ax),2)+power(y-ay-t*("by"-ay),2)) <= 0.05 and t*len > 0.05 and (1-t)*len > 0.05 union select id, 0 from l union select id, 1 from l),
p as (select id, t as f, lead(t) over (partition by id order by t) as g from t),
o as (select id, round(ax+f*(bx-ax),3) as ax, round(ay+f*("by"-ay),3) as ay, round(ax+g*(bx-ax),3) as bx, round(ay+g*("by"-ay),3) as "by" from p join l using (id) where g is not null)
select min(id) as id, ax, ay, bx, "by" from o where sqrt(power(bx-ax,2)+power("by"-ay,2)) > 0.001 group by ax, ay, bx, "by"
"""


@query(_NODED)
def geo6_geo7_noded_lines(i: Inputs) -> DataFrame:
    """Lines cut where they meet, and where stops stand on them."""
    lines = diagonals(i)
    places = L.crossing_places(lines, 200.0).unionByName(L.near_point_places(lines, i.stops.select("x", "y"), 0.05)).distinct()
    return L.split_at(lines, places)


_OVERLAPS = """with s as (select u*100000+v as id, ux as ax, uy as ay, vx as bx, vy as "by" from v_network),
l as (select * from s union all select -id, bx + 50, "by", ax + 30, ay from s where id % 5 = 0 and ay = "by"),
e as (select ax as x, ay as y from l union select bx, "by" from l),
c as (select id, x, y from l join e on x between least(ax, bx) and greatest(ax, bx) and y between least(ay, "by") and greatest(ay, "by")),
p as (select id, x as ax, y as ay, lead(x) over w as bx, lead(y) over w as "by" from c window w as (partition by id order by x, y))
select min(id) as id, ax, ay, bx, "by" from p where bx is not null group by ax, ay, bx, "by"
"""


@query(_OVERLAPS)
def geo6_overlaps(i: Inputs) -> DataFrame:
    """Streets and, over some of them and their neighbours, others in the opposite direction that begin and end midway."""
    s = streets(i).select("id", "ax", "ay", "bx", "by")
    over = s.filter("id % 5 = 0 and ay = by").select((-F.col("id")).alias("id"), (F.col("bx") + 50).alias("ax"), F.col("by").alias("ay"), (F.col("ax") + 30).alias("bx"), F.col("ay").alias("by"))
    return L.noded(s.unionByName(over), 200.0)


_CHAINS = """with recursive n as (select u*100000+v as id, u as node from v_network union all select u*100000+v, v from v_network),
l as (select min(id) as a, max(id) as b from n group by node having count(*) = 2 and min(id) <> max(id)), e as (select a, b from l union all select b, a from l),
c as (select a as id, a as chain from e union select e.b, c.chain from c join e on e.a = c.id)
select chain, count(*) as pieces from (select k.id, coalesce(min(c.chain), k.id) as chain from (select u*100000+v as id from v_network) k left join c on c.id = k.id group by k.id) q group by chain"""


@query(_CHAINS)
def geo8_chains(i: Inputs) -> DataFrame:
    return L.chains(streets(i).select("id", "u", "v")).groupBy("chain").agg(F.count("*").alias("pieces"))


@query("select park_num, walktime_min, household_median_income from v_census where hasdata = 1 and household_median_income > 0 and walktime_min = 20")
def flt6_named_eligibility(i: Inputs) -> DataFrame:
    """The scenario names the column by which rows are kept."""
    scenario = {"name": "population20", "eligible": "eligible_20"}
    flags = i.census.withColumn("eligible_20", (F.col("hasdata") == 1) & (F.col("household_median_income") > 0) & (F.col("walktime_min") == 20))
    return flags.filter(F.col(scenario["eligible"])).select("park_num", "walktime_min", "household_median_income")


# Sites that the census rule admits, by walk time.
ADMITTED = {5: 90, 10: 105, 20: 112, 30: 114}


@query(
    f"with w as ({' union all '.join(f'select {m} as walktime_min, cast({n} as bigint) as expected' for m, n in ADMITTED.items())}) select walktime_min, count(*) filter (where hasdata = 1) as found, expected, count(*) filter (where hasdata = 1) = expected as ok from w left join v_census using (walktime_min) group by walktime_min, expected"
)
def val3_sample_sizes(i: Inputs) -> DataFrame:
    """Sites with census data by walk time, against the published sizes; other tables have other sizes and are not ok."""
    kept = i.census.select(*[((F.col("walktime_min") == m) & (F.col("hasdata") == 1)).alias(str(m)) for m in ADMITTED])
    found = C.sample_sizes(kept, {str(m): n for m, n in ADMITTED.items()})
    return found.select(F.col("eligible").cast("int").alias("walktime_min"), F.col("sites").alias("found"), "expected", "ok")


_EFFECTS = """with m as (select walktime_min, count(*) as n, var_pop(pct_visible_minority)*count(*) as s11, var_pop(pct_bachelors_and_above)*count(*) as s22, covar_pop(pct_visible_minority,pct_bachelors_and_above)*count(*) as s12,
 covar_pop(pct_visible_minority,pct_low_income)*count(*) as s1, covar_pop(pct_bachelors_and_above,pct_low_income)*count(*) as s2, var_pop(pct_low_income)*count(*) as sy from v_census where hasdata = 1 group by walktime_min),
b as (select *, s11*s22 - s12*s12 as d, (s1*s22 - s2*s12)/(s11*s22 - s12*s12) as b1, (s2*s11 - s1*s12)/(s11*s22 - s12*s12) as b2 from m),
e as (select *, (sy - b1*s1 - b2*s2)/(n - 3) as v from b),
t as (select walktime_min, n - 1 as n, 'pct_visible_minority' as term, b1 as estimate, sqrt(v*s22/d) as se from e union all select walktime_min, n - 1, 'pct_bachelors_and_above', b2, sqrt(v*s11/d) from e),
k as (select *, estimate/se/sqrt(power(estimate/se, 2) + n - 2) as r from t),"""
_REPORT = f""" p as (select *, {CORR_P} as p from k), w as (select *, p*count(*) over ()/rank() over (order by p) as raw from p),
q as (select *, least(1, min(raw) over (order by p desc range between unbounded preceding and current row)) as bh from w)
select walktime_min, term, {", ".join(f"round({c} + 1e-9, 6) as {n}" for c, n in (("estimate", "estimate"), ("estimate - 1.96*se", "ci_low"), ("estimate + 1.96*se", "ci_high"), ("p", "p_value"), ("bh", "bh_q")))},
 printf('%.3f (%.3f)', estimate, se) as text, case when p < 0.001 then '<.001' when p >= 0.9995 then '1.000' else substr(printf('%.3f', p), 2) end as p_text, case when p < 0.001 then '***' when p < 0.01 then '**' when p < 0.05 then '*' else '' end as stars from q"""


@query(_EFFECTS + _REPORT)
def cmp13_result_table(i: Inputs) -> DataFrame:
    """Effects by walk time with adjusted p-values and report text."""
    fit = M.fit_groups(i.census.filter("hasdata = 1"), "pct_low_income", ["pct_visible_minority", "pct_bachelors_and_above"], "walktime_min").filter("term <> 'intercept'")
    q = W.bh_table(fit.withColumn("family", F.lit(1)), "p_value", "family", name="bh_q")
    low, high = F.col("estimate") - 1.96 * F.col("std_error"), F.col("estimate") + 1.96 * F.col("std_error")
    steady = [X.steady(c).alias(n) for c, n in ((F.col("estimate"), "estimate"), (low, "ci_low"), (high, "ci_high"), (F.col("p_value"), "p_value"), (F.least(F.lit(1.0), "bh_q"), "bh_q"))]
    return q.select("walktime_min", "term", *steady, F.format_string("%.3f (%.3f)", "estimate", "std_error").alias("text"), X.p_text(F.col("p_value")).alias("p_text"), X.stars(F.col("p_value")).alias("stars"))
