"""The flagship panel, aggregations and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import expr as X
from tidemark.operators import graph as G
from tidemark.operators import models as M
from tidemark.operators import panel as P
from tidemark.operators import ranks
from tidemark.operators import windows as W
from tidemark.plans.registry import query
from tidemark.sources.fixtures import Inputs

R = "round({} + 1.0e-9, 6)"

#: Two-sided p of a correlation r of n pairs: Student's distribution as a finite sum of powers of cos t = sqrt(1 - r * r).
CORR_P = """case when abs(r) >= 1 then 0.0e0 when (n - 2) % 2 = 0 then
 1 - abs(r) * list_sum(list_transform(range(0, (n - 2) // 2), lambda k: exp(lgamma(k + 0.5e0) - lgamma(k + 1.0e0)) / sqrt(pi()) * power(1 - r * r, k)))
 else 1 - 2 / pi() * (asin(abs(r)) + abs(r) * coalesce(list_sum(list_transform(range(1, (n - 1) // 2), lambda k: sqrt(pi()) / 2 * exp(lgamma(k * 1.0e0) - lgamma(k + 0.5e0)) * power(1 - r * r, k - 0.5e0))), 0)) end"""


@query("select *, lpad(cast(agg_time_period as varchar),2,'0') || ':00-' || lpad(cast(agg_time_period+1 as varchar),2,'0') || ':00' as hour_label, case agg_day_period when 0 then 'Weekday' else 'Weekend' end as day_type from v_hours")
def site_hour_activity(i: Inputs) -> DataFrame:
    """Cells are matched to sites, the hour filter reaches the scan, partial sums run before the one large shuffle."""
    return i.hours.withColumn("hour_label", X.hour_label(F.col("agg_time_period"))).withColumn("day_type", X.day_type(F.col("agg_day_period")))


@query("select park_num, count(*) as temporal_records, min(site_activity_index) as min_activity, round(avg(site_activity_index)+1e-9,6) as mean_activity, max(site_activity_index) as max_activity, min(unique_cells_used) as min_cells_used, max(unique_cells_used) as max_cells_used, 360 - count(*) as missing_temporal_records from v_hours group by park_num")
def agg2_site_quality(i: Inputs) -> DataFrame:
    return P.site_quality(i.hours)


@query("select park_num, count(*) as cells from v_lookup group by park_num")
def agg3_count_by_site(i: Inputs) -> DataFrame:
    return P.count_by(i.lookup, "park_num", name="cells")


@query("select geography, count(*) as sites from v_lookup group by geography having count(*) > 1")
def agg4_cells_of_several_sites(i: Inputs) -> DataFrame:
    return P.more_than_once(i.lookup, "geography", name="sites")


@query("select count(distinct geography) as cells, count(distinct park_num) as sites, count(*) as pairs from v_lookup")
def agg5_distinct_counts(i: Inputs) -> DataFrame:
    return i.lookup.agg(F.count_distinct("geography").alias("cells"), F.count_distinct("park_num").alias("sites"), F.count("*").alias("pairs"))


@query("select walktime_min, count(*) as n, count(*) filter (where hasdata = 1) as with_data, count(*) filter (where household_median_income = 0) as zero_income, count(*) filter (where hasdata = 1 and household_median_income > 0) as eligible from v_census group by walktime_min")
def agg6_conditional_counts(i: Inputs) -> DataFrame:
    data, zero = F.col("hasdata") == 1, F.col("household_median_income") == 0
    return i.census.groupBy("walktime_min").agg(F.count("*").alias("n"), F.count_if(data).alias("with_data"), F.count_if(zero).alias("zero_income"), F.count_if(data & (F.col("household_median_income") > 0)).alias("eligible"))


@query("select cast(floor(ux/1000) as bigint) as bx, sum(len) as length_m from v_network group by cast(floor(ux/1000) as bigint)")
def agg7_sum_by_key(i: Inputs) -> DataFrame:
    return i.network.groupBy(F.floor(F.col("ux") / 1000).alias("bx")).agg(F.sum("len").alias("length_m"))


#: Shoreline segments made of the network: slope and beach by whole numbers.
SEGMENTS = "select u*2 + (v - u) % 2 as segment, cast(u % 97 as int) as park_num, 20.0e0 + (u % 5) as length, case when (u + v) % 13 = 0 then null else cast((u*7 + v) % 12 as double) end as slope, (u % 4 = 0) as beach, (v % 3 = 0) as barrier from v_network"


def segments(i: Inputs) -> DataFrame:
    u, v = F.col("u"), F.col("v")
    return i.network.select((u * 2 + (v - u) % 2).alias("segment"), (u % 97).cast("int").alias("park_num"), (F.lit(20.0) + u % 5).alias("length"), F.when((u + v) % 13 != 0, ((u * 7 + v) % 12).cast("double")).alias("slope"), (u % 4 == 0).alias("beach"), (v % 3 == 0).alias("barrier"))


def gentle_slope() -> Column:
    """At most ten percent, as degrees."""
    return F.col("slope") <= F.degrees(F.atan(F.lit(0.10)))


@query(f"select park_num, sum(length) as total, coalesce(sum(length) filter (where slope <= 5.710593137499643), 0) as gentle, sum(length) - coalesce(sum(length) filter (where slope <= 5.710593137499643), 0) as steep_or_unknown, {R.format('avg(slope)')} as mean_slope, count(*) as segments, {R.format('coalesce(sum(length) filter (where slope <= 5.710593137499643), 0)/sum(length)')} as gentle_ratio from ({SEGMENTS}) s group by park_num")
def agg8_length_weighted_classes(i: Inputs) -> DataFrame:
    """Gentle shoreline by site: a segment without a slope is not gentle."""
    gentle = F.coalesce(F.sum(F.when(gentle_slope(), F.col("length"))), F.lit(0.0))
    total = F.sum("length")
    return segments(i).groupBy("park_num").agg(total.alias("total"), gentle.alias("gentle"), (total - gentle).alias("steep_or_unknown"), X.steady(F.avg("slope")).alias("mean_slope"), F.count("*").alias("segments"), X.steady(gentle / total).alias("gentle_ratio"))


@query(f"with seg as ({SEGMENTS}), hit as (select s.park_num, s.segment, s.length, k.f from seg s, (select 0 as f union all select 1 union all select 2) k where (s.segment + k.f) % 4 = 0 or s.segment % 5 = k.f), one as (select park_num, count(*) as affected, sum(length) as affected_m from (select distinct park_num, segment, length from hit) d group by park_num), two as (select park_num, count(*) as features, sum(length) as overlap_m from hit group by park_num) select one.*, features, overlap_m from one join two using (park_num)")
def agg9_distinct_then_sum(i: Inputs) -> DataFrame:
    hit = segments(i).withColumn("f", F.explode(F.array(*map(F.lit, (0, 1, 2))))).filter("(segment + f) % 4 = 0 or segment % 5 = f")
    one = hit.dropDuplicates(["park_num", "segment"]).groupBy("park_num").agg(F.count("*").alias("affected"), F.sum("length").alias("affected_m"))
    return one.join(hit.groupBy("park_num").agg(F.count("*").alias("features"), F.sum("length").alias("overlap_m")), "park_num")


@query(f"select park_num, count(*) as segments, sum(length) as length_m, count(*) filter (where gentle) as gentle, count(*) filter (where beach) as beach, count(*) filter (where gentle or beach) as approachable, count(*) filter (where (gentle or beach) and not barrier) as unobstructed, coalesce(sum(length) filter (where (gentle or beach) and not barrier), 0) as unobstructed_m, count(*) filter (where slope is null) as no_slope from (select *, coalesce(slope <= 5.710593137499643, false) as gentle from ({SEGMENTS}) s) t group by park_num")
def agg10_cnd7_approachable(i: Inputs) -> DataFrame:
    gentle = F.coalesce(gentle_slope(), F.lit(False))
    s = segments(i).withColumn("gentle", gentle).withColumn("approach", F.col("gentle") | F.col("beach")).withColumn("free", F.col("approach") & ~F.col("barrier"))
    count = lambda c: F.count_if(F.col(c))
    return s.groupBy("park_num").agg(
        F.count("*").alias("segments"), F.sum("length").alias("length_m"), count("gentle").alias("gentle"), count("beach").alias("beach"), count("approach").alias("approachable"), count("free").alias("unobstructed"),
        F.coalesce(F.sum(F.when(F.col("free"), F.col("length"))), F.lit(0.0)).alias("unobstructed_m"), F.count_if(F.col("slope").isNull()).alias("no_slope"),
    )


_LONG = "(select 'activity' as variable, site_activity_index as value from v_hours union all select 'cells', cast(unique_cells_used as double) from v_hours)"


@query(f"select variable, count(value) as n, {R.format('avg(value)')} as mean, {R.format('stddev_samp(value)')} as sd, {R.format('quantile_cont(value,0.5)')} as median, {R.format('quantile_cont(value,0.25)')} as q1, {R.format('quantile_cont(value,0.75)')} as q3, {R.format('min(value)')} as min, {R.format('max(value)')} as max from {_LONG} l group by variable")
def agg11_describe(i: Inputs) -> DataFrame:
    return P.describe(i.hours.select(F.col("site_activity_index").alias("activity"), F.col("unique_cells_used").alias("cells")), ["activity", "cells"])


@query(f"select agg_time_period, {R.format('quantile_cont(site_activity_index,0.5)')} as median_activity from v_hours group by agg_time_period")
def agg12_median_by_hour(i: Inputs) -> DataFrame:
    found = ranks.quantiles(i.hours, "site_activity_index", {"median": 0.5}, "agg_time_period")
    return found.select("agg_time_period", X.steady(F.col("median")).alias("median_activity"))


@query(f"select agg_time_period, n, {R.format('r')} as r, {R.format(CORR_P)} as p from (select agg_time_period, count(*) as n, corr(site_activity_index, cast(unique_cells_used as double)) as r from v_hours group by agg_time_period) q")
def agg13_pearson(i: Inputs) -> DataFrame:
    found = i.hours.groupBy("agg_time_period").agg(F.count("*").alias("n"), F.corr("site_activity_index", F.col("unique_cells_used").cast("double")).alias("r"))
    return found.select("agg_time_period", "n", X.steady(F.col("r")).alias("r"), X.steady(M.correlation_p(F.col("r"), F.col("n"))).alias("p"))


@query(
    "with k as (select walktime_min, rank() over (partition by walktime_min order by pct_low_income) + (count(*) over (partition by walktime_min, pct_low_income) - 1)/2.0e0 as a, rank() over (partition by walktime_min order by pct_visible_minority) + (count(*) over (partition by walktime_min, pct_visible_minority) - 1)/2.0e0 as b from v_census)"
    f" select walktime_min, n, {R.format('r')} as rho, {R.format(CORR_P)} as p from (select walktime_min, count(*) as n, corr(a,b) as r from k group by walktime_min) q"
)
def agg14_win10_spearman(i: Inputs) -> DataFrame:
    ranked = ranks.with_rank(ranks.with_rank(i.census, "pct_low_income", "a", "walktime_min"), "pct_visible_minority", "b", "walktime_min")
    found = ranked.groupBy("walktime_min").agg(F.count("*").alias("n"), F.corr("a", "b").alias("r"))
    return found.select("walktime_min", "n", X.steady(F.col("r")).alias("rho"), X.steady(M.correlation_p(F.col("r"), F.col("n"))).alias("p"))


@query("with m as (select agg_time_period, avg(site_activity_index) as m, stddev_samp(site_activity_index) as s from v_hours group by agg_time_period) select agg_time_period, round(avg(power(site_activity_index-m,3))/power(any_value(s),3)+1e-9,4) as skewness from v_hours join m using (agg_time_period) group by agg_time_period")
def agg15_skewness(i: Inputs) -> DataFrame:
    """Third central moment over the cube of the sample sd, from power sums of one pass about the overall mean."""
    centre = i.stored_hours.agg(F.avg("site_activity_index")).first()[0] or 0.0
    v = F.col("site_activity_index") - F.lit(centre)
    s = i.stored_hours.groupBy("agg_time_period").agg(F.avg(v).alias("m"), F.avg(v * v).alias("m2"), F.avg(v * v * v).alias("m3"), F.stddev_samp("site_activity_index").alias("sd"))
    third = F.col("m3") - 3 * F.col("m") * F.col("m2") + 2 * F.pow("m", F.lit(3))
    return s.select("agg_time_period", X.steady(third / F.pow("sd", F.lit(3)), 4).alias("skewness"))


_SEASON = "case when month(start_date) in (12,1,2) then 'Winter' when month(start_date) <= 5 then 'Spring' when month(start_date) <= 8 then 'Summer' else 'Fall' end"


@query(f"with s as (select park_num, dimension, category, avg(site_activity_index) as m from (select park_num, site_activity_index, 'season' as dimension, {_SEASON} as category from v_hours union all select park_num, site_activity_index, 'day', case agg_day_period when 0 then 'Weekday' else 'Weekend' end from v_hours) x group by park_num, dimension, category) select dimension, category, count(*) as sites, {R.format('avg(m)')} as mean, {R.format('stddev_samp(m)')} as sd, {R.format('quantile_cont(m,0.5)')} as median, {R.format('stddev_samp(m)/sqrt(count(*))')} as se, {R.format('avg(m)-1.96*stddev_samp(m)/sqrt(count(*))')} as low, {R.format('avg(m)+1.96*stddev_samp(m)/sqrt(count(*))')} as high from s group by dimension, category")
def agg16_site_balanced_means(i: Inputs) -> DataFrame:
    long = i.hours.select("park_num", "site_activity_index", X.season(F.month("start_date")).alias("season"), X.day_type(F.col("agg_day_period")).alias("day")).unpivot(["park_num", "site_activity_index"], ["season", "day"], "dimension", "category")
    site = G.written(long.groupBy("park_num", "dimension", "category").agg(F.avg("site_activity_index").alias("m")), "means")
    m, se = F.avg("m"), F.stddev_samp("m") / F.sqrt(F.count("*"))
    median = ranks.quantiles(site, "m", {"median": 0.5}, "dimension", "category").withColumn("median", X.steady(F.col("median")))
    found = site.groupBy("dimension", "category").agg(F.count("*").alias("sites"), X.steady(m).alias("mean"), X.steady(F.stddev_samp("m")).alias("sd"), X.steady(se).alias("se"), X.steady(m - 1.96 * se).alias("low"), X.steady(m + 1.96 * se).alias("high"))
    return found.join(median, ["dimension", "category"])


_COVER = "(select park_num, 100.0e0*count(*)/360 as pct from v_hours group by park_num)"


@query(f"select g as coverage_group, count(pct) as sites from (select '>=90%' as g, 90 as lo, 1000 as hi union all select '75-<90%', 75, 90 union all select '50-<75%', 50, 75 union all select '<50%', -1, 50) k left join {_COVER} c on pct >= lo and pct < hi group by g")
def agg17_fixed_categories(i: Inputs) -> DataFrame:
    groups = i.sites.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, (">=90%", "75-<90%", "50-<75%", "<50%")))).alias("coverage_group"))
    counts = P.count_by(i.hours, "park_num").select(X.coverage_group(F.col("n") * 100.0 / P.POSSIBLE).alias("coverage_group")).groupBy("coverage_group").agg(F.count("*").alias("sites"))
    return groups.join(counts, "coverage_group", "left").select("coverage_group", F.coalesce("sites", F.lit(0)).alias("sites"))


@query(f"select cast(t as double) as threshold, count(*) filter (where pct >= t) as retained, count(*) filter (where pct < t) as excluded from {_COVER} c, (select 50 as t union all select 75 union all select 80 union all select 90 union all select 95) k group by t")
def agg18_threshold_sweep(i: Inputs) -> DataFrame:
    return P.threshold_sweep(P.count_by(i.hours, "park_num").select((F.col("n") * 100.0 / P.POSSIBLE).alias("pct")), "pct", [50, 75, 80, 90, 95])


@query("select h.park_num, any_value(s.site_type) as site_type, count(*) as hours from v_hours h join v_sites s using (park_num) group by h.park_num")
def agg19_first_value(i: Inputs) -> DataFrame:
    return i.hours.join(i.sites.select("park_num", "site_type"), "park_num").groupBy("park_num").agg(F.min("site_type").alias("site_type"), F.count("*").alias("hours"))


@query("select min(x-h) - 100 as x0, min(y-h) - 100 as y0, max(x+h) + 100 as x1, max(y+h) + 100 as y1 from v_sites")
def agg23_extent(i: Inputs) -> DataFrame:
    from tidemark.operators.spatial import site_rings

    v = site_rings(i.sites).select(F.explode("ring").alias("p"))
    return v.agg((F.min("p.x") - 100).alias("x0"), (F.min("p.y") - 100).alias("y0"), (F.max("p.x") + 100).alias("x1"), (F.max("p.y") + 100).alias("y1"))


@query(f"select muni_key, site_type, count(*) as n, {R.format('100.0e0*count(*)/sum(count(*)) over (partition by muni_key)')} as percent from v_sites group by muni_key, site_type")
def agg24_win9_share(i: Inputs) -> DataFrame:
    n = P.count_by(i.sites, "muni_key", "site_type")
    return n.withColumn("percent", X.steady(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy("muni_key"))))


@query("select 'park_num' as column_name, count(*) filter (where park_num is null) as nulls from v_census union all select 'income', count(*) filter (where hasdata <> 1) from v_census")
def agg25_null_counts(i: Inputs) -> DataFrame:
    return P.null_counts(i.census.select("park_num", F.when(F.col("hasdata") == 1, F.col("household_median_income")).alias("income")))


@query("select park_num, max(abs(pct_low_income - pct_visible_minority)) as divergence from v_census group by park_num order by divergence desc, park_num limit 6")
def agg26_most_divergent(i: Inputs) -> DataFrame:
    d = F.abs(F.col("pct_low_income") - F.col("pct_visible_minority"))
    return i.census.groupBy("park_num").agg(F.max(d).alias("divergence")).orderBy(F.desc("divergence"), "park_num").limit(6)


@query("with m as (select regr_slope(site_activity_index, cast(unique_cells_used as double)) as b, regr_intercept(site_activity_index, cast(unique_cells_used as double)) as a from v_hours) select park_num, round(avg(site_activity_index - a - b*unique_cells_used)+1e-9,6) as mean_residual, count(*) as n from v_hours, m group by park_num")
def agg27_mean_residual(i: Inputs) -> DataFrame:
    x = F.col("unique_cells_used").cast("double")
    fit = i.stored_hours.agg(F.regr_slope("site_activity_index", x).alias("b"), F.regr_intercept("site_activity_index", x).alias("a"))
    res = F.col("site_activity_index") - F.col("a") - F.col("b") * x
    return i.stored_hours.join(F.broadcast(fit)).groupBy("park_num").agg(X.steady(F.avg(res)).alias("mean_residual"), F.count("*").alias("n"))


@query(f"select count(*) filter (where h > 300) as wide, {R.format('avg(h)')} as mean_h, max(h) as max_h from v_sites")
def agg28_pooled_summary(i: Inputs) -> DataFrame:
    return i.sites.agg(F.count_if(F.col("h") > 300).alias("wide"), X.steady(F.avg("h")).alias("mean_h"), F.max("h").alias("max_h"))


@query("select park_num, walktime_min, round(case when max(v) over w = min(v) over w then case when v is not null then 0 end else (v - min(v) over w)/(max(v) over w - min(v) over w) end + 1e-9, 6) as scaled from (select park_num, walktime_min, case when hasdata=1 then pct_low_income end as v from v_census) c window w as (partition by walktime_min)")
def win1_min_max(i: Inputs) -> DataFrame:
    v = F.when(F.col("hasdata") == 1, F.col("pct_low_income"))
    out = W.min_max(i.census.select("park_num", "walktime_min", v.alias("v")), {"scaled": "v"}, "walktime_min")
    return out.select("park_num", "walktime_min", X.steady(F.col("scaled")).alias("scaled"))


@query("select park_num, walktime_min, round((v - avg(v) over w)/nullif(stddev_samp(v) over w,0)+1e-9,6) as z from (select park_num, walktime_min, case when hasdata=1 then pct_low_income end as v from v_census) c window w as (partition by walktime_min)")
def win2_z_score(i: Inputs) -> DataFrame:
    v = F.when(F.col("hasdata") == 1, F.col("pct_low_income"))
    out = W.z_score(i.census.select("park_num", "walktime_min", v.alias("v")), {"z": "v"}, "walktime_min")
    return out.select("park_num", "walktime_min", X.steady(F.col("z")).alias("z"))


@query("select h.park_num, h.start_date, h.agg_day_period, h.agg_time_period, round((s.h - m)/sd+1e-9,6) as z_h from v_hours h join v_sites s using (park_num), (select avg(h) as m, stddev_samp(h) as sd from v_sites where park_num in (select park_num from v_hours)) p")
def win3_reference_population(i: Inputs) -> DataFrame:
    """Mean and sd over the distinct sites of the panel, applied to every row of it."""
    rows = i.hours.select(*P.KEYS).join(i.sites.select("park_num", "h"), "park_num")
    sites = rows.select("park_num", "h").distinct()
    return W.z_against(rows, sites, ["h"]).select(*P.KEYS, X.steady(F.col("z_h")).alias("z_h"))


@query("select park_num, walktime_min, d, cast(r as int) as rank from (select park_num, walktime_min, abs(pct_low_income-pct_visible_minority) as d, row_number() over (partition by walktime_min order by abs(pct_low_income-pct_visible_minority) desc, park_num) as r from v_census) c where r <= 5")
def win4_win5_top_divergence(i: Inputs) -> DataFrame:
    d = F.abs(F.col("pct_low_income") - F.col("pct_visible_minority"))
    return W.top_per_group(i.census.select("park_num", "walktime_min", d.alias("d")), 5, ["walktime_min"], F.desc("d"), "park_num")


@query("select c_nationkey as nation, c_custkey as stop_id, x, y from (select c_nationkey, c_custkey, c_custkey*7919 % 400 as x, c_custkey*104729 % 53 as y, row_number() over (partition by c_custkey*7919 % 400, c_custkey*104729 % 53 order by c_custkey) as r from customer) c where r = 1")
def win7_first_of_duplicates(i: Inputs) -> DataFrame:
    c = F.col("c_custkey")
    p = i.table("customer").select(F.col("c_nationkey").alias("nation"), c.alias("stop_id"), (c * 7919 % 400).alias("x"), (c * 104729 % 53).alias("y"))
    return W.first_of(p, ["x", "y"], F.col("stop_id"))


@query("with c as (select park_num, k.rung, cast((park_num * k.rung) % 7 as int) as n from v_sites, (select 1 as rung union all select 2 union all select 3) k) select park_num, coalesce(min(rung) filter (where n >= 3), max(rung)) as rung from c group by park_num")
def win8_ladder(i: Inputs) -> DataFrame:
    from tidemark.operators.select_points import ladder

    rungs = i.sites.withColumn("rung", F.explode(F.array(*map(F.lit, (1, 2, 3))))).select("park_num", "rung", (F.col("park_num") * F.col("rung") % 7).alias("n"))
    return ladder(rungs, "park_num", 3)


@query("select park_num, arg_min(walktime_min, v) as walktime_min, min(v) as best from (select park_num, walktime_min, pct_low_income*1000 + walktime_min as v from v_census) c group by park_num")
def win11_least_by_group(i: Inputs) -> DataFrame:
    v = F.col("pct_low_income") * 1000 + F.col("walktime_min")
    return i.census.withColumn("v", v).groupBy("park_num").agg(F.min_by("walktime_min", "v").alias("walktime_min"), F.min("v").alias("best"))


@query("select park_num, geography, cast(row_number() over (partition by park_num order by geography) as int) as observer_number from v_lookup")
def win12_numbers(i: Inputs) -> DataFrame:
    return i.lookup.withColumn("observer_number", F.row_number().over(Window.partitionBy("park_num").orderBy("geography")))
