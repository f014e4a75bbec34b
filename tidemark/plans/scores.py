"""Score pipelines, decisions and contracts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import expr as X
from tidemark.operators import contracts as C
from tidemark.operators import models as M
from tidemark.operators import panel as P
from tidemark.operators import ranks
from tidemark.operators import scores as SC
from tidemark.operators import spatial as S
from tidemark.operators import windows as W
from tidemark.plans.panels import CORR_P, R, segments
from tidemark.plans.registry import query
from tidemark.sources.fixtures import Inputs

_METRICS = "select park_num, walktime_min, case when hasdata=1 then pct_low_income end as pedestrian, pct_visible_minority as transit, pct_bachelors_and_above as visual, case when park_num % 7 = 0 then null else pct_indigenous_identity end as haptic from v_census"


def metrics(i: Inputs) -> DataFrame:
    return i.census.select("park_num", "walktime_min", F.when(F.col("hasdata") == 1, F.col("pct_low_income")).alias("pedestrian"), F.col("pct_visible_minority").alias("transit"), F.col("pct_bachelors_and_above").alias("visual"), F.when(F.col("park_num") % 7 != 0, F.col("pct_indigenous_identity")).alias("haptic"))


def _scaled(c: str) -> str:
    return f"case when max({c}) over w = min({c}) over w then case when {c} is not null then 0.0e0 end else ({c}-min({c}) over w)/(max({c}) over w-min({c}) over w) end"


def _mean(*c: str) -> str:
    return f"({'+'.join(f'coalesce({x},0)' for x in c)})/nullif({'+'.join(f'(case when {x} is null then 0 else 1 end)' for x in c)},0)"


_SCORES = f"s0 as (select park_num, walktime_min, {', '.join(f'{_scaled(c)} as {c}_s' for c in ('pedestrian', 'transit', 'visual', 'haptic'))} from ({_METRICS}) m window w as (partition by walktime_min)), s1 as (select *, {_mean('pedestrian_s', 'transit_s')} as physical from s0), s2 as (select *, {_mean('physical', 'visual_s', 'haptic_s')} as multi from s1)"


@query(f"with {_SCORES} select park_num, walktime_min, {R.format('physical')} as physical_access_score, {R.format('visual_s')} as visual_access_score, {R.format('haptic_s')} as haptic_access_score, {R.format('multi')} as multidimensional_access_score from s2")
def cmp2_access_scores(i: Inputs) -> DataFrame:
    s = SC.access_scores(metrics(i))
    return s.select("park_num", "walktime_min", *[X.steady(F.col(a)).alias(b) for a, b in (("physical_access_score",) * 2, ("visual_scaled", "visual_access_score"), ("haptic_scaled", "haptic_access_score"), ("multidimensional_access_score",) * 2)])


@query(f"with {_SCORES} select s2.park_num, s2.walktime_min, site_name, site_type, {R.format('multi')} as score, hasdata = 1 and household_median_income > 0 as eligible from s2 join v_census c on c.park_num = s2.park_num and c.walktime_min = s2.walktime_min join v_sites s on s.park_num = s2.park_num")
def cmp3_catchment_table(i: Inputs) -> DataFrame:
    flags = i.census.select("park_num", "walktime_min", ((F.col("hasdata") == 1) & (F.col("household_median_income") > 0)).alias("eligible"))
    s = SC.access_scores(metrics(i)).select("park_num", "walktime_min", X.steady(F.col("multidimensional_access_score")).alias("score"))
    return s.join(flags, ["park_num", "walktime_min"]).join(i.sites.select("park_num", "site_name", "site_type"), "park_num")


@query(f"with {_SCORES} select park_num, {R.format('physical')} as physical_access_score, {R.format('multi')} as multidimensional_access_score from s2 where walktime_min = 10")
def cmp10_handoff(i: Inputs) -> DataFrame:
    return cmp2_access_scores(i).filter("walktime_min = 10").select("park_num", "physical_access_score", "multidimensional_access_score")


_POINTS = "(select park_num, count(*) as access_points from v_lookup group by park_num)"


@query(f"select s.park_num, coalesce(access_points, 0) as access_points, 8*h/1000 as perimeter_km, {R.format('coalesce(access_points,0)/(8*h/1000)')} as points_per_km, {R.format('x/nullif(case when s.park_num % 6 = 0 then 0 else y end, 0)')} as visual_ratio from v_sites s left join {_POINTS} p on p.park_num = s.park_num")
def cmp1_mth8_site_metrics(i: Inputs) -> DataFrame:
    ring = S.site_rings(i.sites).select("park_num", (S.perimeter(F.col("ring")) / 1000).alias("perimeter_km"))
    points = P.count_by(i.lookup, "park_num", name="access_points")
    out = i.sites.join(points, "park_num", "left").join(ring, "park_num").withColumn("access_points", F.coalesce("access_points", F.lit(0)))
    water = F.when(F.col("park_num") % 6 == 0, 0.0).otherwise(F.col("y"))
    return out.select("park_num", "access_points", "perimeter_km", X.steady(X.ratio(F.col("access_points").cast("double"), F.col("perimeter_km"))).alias("points_per_km"), X.steady(X.ratio(F.col("x"), water)).alias("visual_ratio"))


@query(f"select s.park_num, coalesce(length_m,0) as shoreline_m, {R.format('coalesce(length_m,0)/(8*h)')} as ratio from v_sites s left join (select cast(u % 97 as int) as park_num, sum(20.0e0 + (u % 5)) as length_m from v_network group by cast(u % 97 as int)) n on n.park_num = s.park_num")
def cmp4_shoreline_ratio(i: Inputs) -> DataFrame:
    length = segments(i).groupBy("park_num").agg(F.sum("length").alias("length_m"))
    ring = S.site_rings(i.sites).select("park_num", S.perimeter(F.col("ring")).alias("perimeter"))
    out = ring.join(length, "park_num", "left").fillna({"length_m": 0.0})
    return out.select("park_num", F.col("length_m").alias("shoreline_m"), X.steady(F.col("length_m") / F.col("perimeter")).alias("ratio"))


@query(f"select park_num, {R.format('least(1,greatest(0,coalesce(sum(length) filter (where (coalesce(slope <= 5.710593137499643,false) or beach) and not barrier)/nullif(sum(length),0),0)))')} as unobstructed_ratio, {R.format('least(1,greatest(0,coalesce(sum(length) filter (where barrier)/nullif(sum(length),0),0)))')} as barrier_ratio from (select cast(u % 97 as int) as park_num, 20.0e0 + (u % 5) as length, case when (u + v) % 13 = 0 then null else cast((u*7 + v) % 12 as double) end as slope, (u % 4 = 0) as beach, (v % 3 = 0) as barrier from v_network) s group by park_num")
def cmp5_cmp6_proxy_ratios(i: Inputs) -> DataFrame:
    gentle = F.coalesce(F.col("slope") <= F.degrees(F.atan(F.lit(0.10))), F.lit(False))
    part = lambda c: X.ratio_or_zero(F.coalesce(F.sum(F.when(c, F.col("length"))), F.lit(0.0)), F.sum("length"))
    return segments(i).groupBy("park_num").agg(X.steady(part((gentle | F.col("beach")) & ~F.col("barrier"))).alias("unobstructed_ratio"), X.steady(part(F.col("barrier"))).alias("barrier_ratio"))


_SEGMENTS = "(select cast(u % 97 as int) as park_num, 20.0e0 + (u % 5) as length, case when (u + v) % 13 = 0 then null else cast((u*7 + v) % 12 as double) end as slope, (u % 4 = 0) as beach, (v % 3 = 0) as barrier from v_network)"


@query(f"select park_num, count(*) as segments, count(*) filter (where slope <= 5.710593137499643) as gentle_segments, {R.format('count(*) filter (where slope <= 5.710593137499643)*1.0e0/count(*)')} as gentle_segment_ratio, {R.format('coalesce(sum(length) filter (where slope <= 5.710593137499643), 0)/sum(length)')} as gentle_length_ratio from {_SEGMENTS} s group by park_num")
def cmp5_gentle_ratios(i: Inputs) -> DataFrame:
    """The terrain proxy itself: shares of a site's shore with a slope of at most one in ten, by pieces and by length."""
    gentle = F.coalesce(F.col("slope") <= F.degrees(F.atan(F.lit(0.10))), F.lit(False))
    sums = segments(i).groupBy("park_num").agg(F.count("*").alias("segments"), F.count_if(gentle).alias("gentle_segments"), F.sum(F.when(gentle, F.col("length")).otherwise(0.0)).alias("gentle"), F.sum("length").alias("length"))
    share = {"gentle_segment_ratio": X.ratio_or_zero(F.col("gentle_segments"), F.col("segments")), "gentle_length_ratio": X.ratio_or_zero(F.col("gentle"), F.col("length"))}
    return sums.select("park_num", "segments", "gentle_segments", *[X.steady(c).alias(n) for n, c in share.items()])


#: Income brackets of the fixture: whole numbers, some missing.
BRACKETS = range(1, 9)
_BRACKET = "case when hasdata = 1 and (park_num + walktime_min + {k}) % 5 <> 0 then cast((park_num*({k} + 2) + walktime_min) % 40 as double) end"


@query(
    f"select park_num, walktime_min, {' + '.join(f'coalesce(b{k}, 0)' for k in BRACKETS)} + case when {' and '.join(f'b{k} is null' for k in BRACKETS)} then null else 0 end as low_income, case when c is null and d is null then null else coalesce(c,0)+coalesce(d,0) end as education, household_median_income"
    f" from (select park_num, walktime_min, household_median_income, {', '.join(_BRACKET.format(k=k) + f' as b{k}' for k in BRACKETS)}, case when park_num%3=0 then pct_bachelors_and_above end as c, case when park_num%5=0 then pct_indigenous_identity end as d from v_census) q"
)
def cmp7_census_clean(i: Inputs) -> DataFrame:
    """Direct copies, low income from eight brackets, education from its levels."""
    p, w = F.col("park_num"), F.col("walktime_min")
    bracket = lambda k: F.when((F.col("hasdata") == 1) & ((p + w + k) % 5 != 0), ((p * (k + 2) + w) % 40).cast("double"))
    raw = i.census.select("park_num", "walktime_min", "household_median_income", *[bracket(k).alias(f"b{k}") for k in BRACKETS], F.when(p % 3 == 0, F.col("pct_bachelors_and_above")).alias("c"), F.when(p % 5 == 0, F.col("pct_indigenous_identity")).alias("d"))
    return SC.census_clean(raw, [f"b{k}" for k in BRACKETS], ["c", "d"]).select("park_num", "walktime_min", "low_income", "education", "household_median_income")


@query("select s.park_num, cast(coalesce(n,0) as int) as reach_cells, cast(coalesce(k,0) as int) as shared_cells from v_sites s left join (select park_num, count(*) as n from v_lookup group by park_num) a on a.park_num = s.park_num left join (select l.park_num, count(*) as k from v_lookup l where geography in (select geography from v_lookup group by geography having count(*) > 1) group by l.park_num) b on b.park_num = s.park_num")
def cmp8_reach_table(i: Inputs) -> DataFrame:
    several = P.more_than_once(i.lookup, "geography")
    shared = P.count_by(i.lookup.join(several, "geography", "left_semi"), "park_num", name="shared_cells")
    out = i.sites.select("park_num").join(P.count_by(i.lookup, "park_num", name="reach_cells"), "park_num", "left").join(shared, "park_num", "left")
    return out.select("park_num", *[F.coalesce(c, F.lit(0)).cast("int").alias(c) for c in ("reach_cells", "shared_cells")])


@query(f"with {_SCORES} select h.park_num, h.start_date, h.agg_day_period, h.agg_time_period, h.site_activity_index, {R.format('ln(h.site_activity_index)')} as log_activity, {R.format('100.0e0*q.n/360')} as coverage_pct, {R.format('multi')} as score, s.site_type, {R.format('ln(4*s.h*s.h)')} as log_site_area, {R.format('household_median_income/(4*s.h*s.h/1e6)')} as density, hasdata = 1 and 100.0e0*q.n/360 >= 50 as eligible from v_hours h join (select park_num, count(*) as n from v_hours group by park_num) q on q.park_num = h.park_num join s2 on s2.park_num = h.park_num and s2.walktime_min = 10 join v_sites s on s.park_num = h.park_num join v_census c on c.park_num = h.park_num and c.walktime_min = 10")
def cmp9_model_dataset(i: Inputs) -> DataFrame:
    """The panel with coverage, scores, metadata, density and eligibility: one site table, then one join onto the rows."""
    area = 4 * F.col("h") * F.col("h")
    hours = i.stored_hours
    cover = P.count_by(hours, "park_num").select("park_num", (F.col("n") * 100.0 / P.POSSIBLE).alias("coverage"))
    score = SC.access_scores(metrics(i)).filter("walktime_min = 10").select("park_num", X.steady(F.col("multidimensional_access_score")).alias("score"))
    census = i.census.filter("walktime_min = 10").select("park_num", "hasdata", "household_median_income")
    site = i.sites.join(cover, "park_num").join(score, "park_num").join(census, "park_num")
    site = site.select("park_num", X.steady(F.col("coverage")).alias("coverage_pct"), "score", "site_type", X.steady(F.ln(area)).alias("log_site_area"), X.steady(F.col("household_median_income") / (area / 1e6)).alias("density"), ((F.col("hasdata") == 1) & (F.col("coverage") >= 50)).alias("eligible"))
    return hours.select(*P.KEYS, "site_activity_index", X.steady(F.ln("site_activity_index")).alias("log_activity")).join(site, "park_num")


@query("select 'pairs' as item, count(*) as n from v_lookup union all select 'cells', count(distinct geography) from v_lookup union all select 'sites', count(distinct park_num) from v_lookup union all select 'cells in several sites', count(*) from (select geography from v_lookup group by geography having count(*) > 1) a union all select 'sites without cells', count(*) from v_sites where park_num not in (select park_num from v_lookup)")
def cmp11_lookup_report(i: Inputs) -> DataFrame:
    lookup = i.lookup
    one = lookup.agg(F.count("*").alias("pairs"), F.count_distinct("geography").alias("cells"), F.count_distinct("park_num").alias("sites")).unpivot([], ["pairs", "cells", "sites"], "item", "n")
    several = P.more_than_once(lookup, "geography").agg(F.lit("cells in several sites").alias("item"), F.count("*").alias("n"))
    none = i.sites.join(lookup, "park_num", "left_anti").agg(F.lit("sites without cells").alias("item"), F.count("*").alias("n"))
    return one.unionByName(several).unionByName(none)


_Q = "q as (select park_num, walktime_min, pct_low_income as a, pct_visible_minority as b, quantile_cont(pct_low_income,0.5) over (partition by walktime_min) as ma, quantile_cont(pct_visible_minority,0.5) over (partition by walktime_min) as mb from v_census)"


@query(f"with {_Q} select park_num, walktime_min, (case when a >= ma then 'H' else 'L' end) || (case when b >= mb then 'H' else 'L' end) as quadrant from q")
def cnd5_quadrants(i: Inputs) -> DataFrame:
    a, b = "pct_low_income", "pct_visible_minority"
    full = ranks.with_quantile(ranks.with_quantile(i.census, a, "ma", 0.5, "walktime_min"), b, "mb", 0.5, "walktime_min")
    return full.select("park_num", "walktime_min", X.quadrant(*[F.col(c) for c in (a, b, "ma", "mb")]).alias("quadrant"))


#: Dimensions that are compared two by two.
DIMENSIONS = ("pct_low_income", "pct_visible_minority", "pct_bachelors_and_above", "pct_indigenous_identity")
_PAIRS = [(a, b) for k, a in enumerate(DIMENSIONS) for b in DIMENSIONS[k + 1 :]]

_PAIRWISE = f"""with l as ({" union all ".join(f"select park_num, walktime_min, '{a}' as first, '{b}' as second, {a} as a, {b} as b from v_census" for a, b in _PAIRS)}),
m as (select *, quantile_cont(a,0.5) over p as ma, quantile_cont(b,0.5) over p as mb from l window p as (partition by walktime_min, first, second)),
k as (select *, (case when a >= ma then 'H' else 'L' end) || (case when b >= mb then 'H' else 'L' end) as quadrant from m),
c as (select walktime_min, first, second, count(*) as n, corr(a,b) as r from l group by walktime_min, first, second)
select walktime_min, first, second, quadrant, sites, percent, mean_gap, most_divergent, n, {R.format('r')} as r, {R.format(CORR_P)} as p from c join
 (select walktime_min, first, second, quadrant, count(*) as sites, {R.format('100.0e0*count(*)/sum(count(*)) over (partition by walktime_min, first, second)')} as percent, {R.format('avg(a-b)')} as mean_gap, arg_max(park_num, abs(a-b) - park_num/1.0e6) as most_divergent from k group by walktime_min, first, second, quadrant) q using (walktime_min, first, second)"""


@query(_PAIRWISE)
def cmp12_pairwise_dimensions(i: Inputs) -> DataFrame:
    """All pairs of dimensions: correlation with n and p, and by quadrant the sites, their share, mean gap and most
    divergent site. Medians are one row per walk time and dimension, joined back."""
    long = i.census.unpivot(["walktime_min"], list(DIMENSIONS), "dimension", "value")
    medians = ranks.quantiles(long, "value", {"median": 0.5}, "walktime_min", "dimension")
    pairs = F.explode(F.array(*[F.struct(F.lit(a).alias("first"), F.lit(b).alias("second"), F.col(a).alias("a"), F.col(b).alias("b")) for a, b in _PAIRS]))
    rows = i.census.select("park_num", "walktime_min", pairs.alias("p")).select("park_num", "walktime_min", "p.*")
    for side, m in (("first", "ma"), ("second", "mb")):
        rows = rows.join(medians.select("walktime_min", F.col("dimension").alias(side), F.col("median").alias(m)), ["walktime_min", side])
    key, gap = ["walktime_min", "first", "second"], F.col("a") - F.col("b")
    q = rows.withColumn("quadrant", X.quadrant(F.col("a"), F.col("b"), F.col("ma"), F.col("mb"))).groupBy(*key, "quadrant")
    q = q.agg(F.count("*").alias("sites"), X.steady(F.avg(gap)).alias("mean_gap"), F.max_by("park_num", F.abs(gap) - F.col("park_num") / 1.0e6).alias("most_divergent"))
    found = rows.groupBy(*key).agg(F.count("*").alias("n"), F.corr("a", "b").alias("r"))
    found = found.select(*key, "n", X.steady(F.col("r")).alias("r"), X.steady(M.correlation_p(F.col("r"), F.col("n"))).alias("p"))
    return q.join(found, key).withColumn("percent", X.steady(F.col("sites") * 100.0 / F.col("n")))


@query(f"select park_num, walktime_min, {R.format('a/t')} as share_a, {R.format('b/t')} as share_b, {R.format('(b + c/2)/t')} as ternary_x, {R.format('c/t*sqrt(3)/2')} as ternary_y from (select park_num, walktime_min, pct_low_income as a, pct_visible_minority as b, pct_bachelors_and_above as c, case when pct_low_income+pct_visible_minority+pct_bachelors_and_above > 0 then pct_low_income+pct_visible_minority+pct_bachelors_and_above end as t from v_census) q")
def mth10_ternary(i: Inputs) -> DataFrame:
    a, b, c = F.col("pct_low_income"), F.col("pct_visible_minority"), F.col("pct_bachelors_and_above")
    t = F.when(a + b + c > 0, a + b + c)
    return i.census.select("park_num", "walktime_min", X.steady(a / t).alias("share_a"), X.steady(b / t).alias("share_b"), X.steady((b + c / 2) / t).alias("ternary_x"), X.steady(c / t * F.sqrt(F.lit(3.0)) / 2).alias("ternary_y"))


@query("select park_num, case when m then 'keep' when node is null then 'remove' when j > 0 then 'keep' when sh > 1 then 'review' when e > 0 then 'review' else 'remove' end as decision, case when m then 'manual' when node is null then 'none' when j > 0 then 'junction' when sh > 1 then 'shared' when e > 0 then 'edge' else 'none' end as join_type from (select park_num, park_num % 9 = 0 as m, case when park_num % 8 > 0 then park_num end as node, park_num % 4 as j, park_num % 5 as sh, park_num % 3 as e from v_sites) s")
def cnd8_access_point_rules(i: Inputs) -> DataFrame:
    p = F.col("park_num")
    d = SC.access_point_decision(p % 9 == 0, F.when(p % 8 > 0, p), p % 4, p % 5, p % 3)
    return i.sites.select("park_num", d.alias("d")).select("park_num", "d.decision", "d.join_type")


@query("select s.park_num, cast(coalesce(n,0) as bigint) as cells, case when n is null and h <= 1 then 'site too small' when n is null then 'no cells' else 'ok' end as status from v_sites s left join (select park_num, count(*) as n from v_lookup group by park_num) l on l.park_num = s.park_num")
def cnd9_fallback_rows(i: Inputs) -> DataFrame:
    n = P.count_by(i.lookup, "park_num")
    return i.sites.join(n, "park_num", "left").select("park_num", F.coalesce("n", F.lit(0)).alias("cells"), F.when(F.col("n").isNull() & (F.col("h") <= 1), "site too small").when(F.col("n").isNull(), "no cells").otherwise("ok").alias("status"))


@query("select 'census' as tbl, count(*) as rows, (select count(*) from v_sites)*4 as expected, count(*) = (select count(*) from v_sites)*4 as ok from v_census")
def val1_row_count(i: Inputs) -> DataFrame:
    return C.row_count(i.census, i.sites.count() * 4).withColumn("tbl", F.lit("census"))


@query("select count(*) filter (where n > 1) as duplicate_keys, count(*) filter (where n > 1) = 0 as ok from (select count(*) as n from v_hours group by park_num, start_date, agg_day_period, agg_time_period) h")
def val2_unique_key(i: Inputs) -> DataFrame:
    return C.unique_key(i.hours, *P.KEYS)


@query("select 'income' as column_name, count(*) filter (where hasdata <> 1) as bad from v_census union all select 'pct_low_income', count(*) filter (where pct_low_income is null) from v_census")
def val4_no_nulls(i: Inputs) -> DataFrame:
    return C.no_nulls(i.census.select(F.when(F.col("hasdata") == 1, F.col("household_median_income")).alias("income"), "pct_low_income"), ["income", "pct_low_income"])


@query("select count(*) filter (where walktime_min not in (5,10,20)) as outside, count(*) filter (where walktime_min not in (5,10,20)) = 0 as ok from v_census")
def val5_allowed_values(i: Inputs) -> DataFrame:
    return C.in_set(i.census, "walktime_min", [5, 10, 20])


@query("select 'value' as column_name, 0.0e0 as max_difference, cast(0 as bigint) as null_mismatches, true as ok")
def val6_recompute(i: Inputs) -> DataFrame:
    """Scaling by joined limits against its recomputation with each group's limits collected (four groups)."""
    a = W.min_max(i.census.select("park_num", "walktime_min", "pct_low_income"), {"value": "pct_low_income"}, "walktime_min")
    limits = {r.walktime_min: (r.lo, r.hi) for r in i.census.groupBy("walktime_min").agg(F.min("pct_low_income").alias("lo"), F.max("pct_low_income").alias("hi")).collect()}
    value = F.lit(None).cast("double")
    for minutes, (lo, hi) in limits.items():
        value = F.when(F.col("walktime_min") == minutes, (F.col("pct_low_income") - lo) / (hi - lo)).otherwise(value)
    b = i.census.select("park_num", "walktime_min", value.alias("value"))
    return C.same(a, b, ["park_num", "walktime_min"], ["value"])
