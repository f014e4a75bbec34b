"""Views over the driver's tables that stand in for the private inputs: the same text runs in Spark and in DuckDB."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

#: name -> (tables or views that it reads, body)
VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "v_cells": (("part",), "select lpad(cast(p_partkey as string),10,'0') as geography, cast(p_partkey*7919 % 10007 as double) as x, cast(p_partkey*104729 % 10009 as double) as y from {part}"),
    "v_sites": (
        ("supplier",),
        "select cast(s_suppkey as int) as park_num, s_name as site_name, cast(s_nationkey as int) as muni_key, case s_suppkey % 4 when 0 then 'riverfront' when 1 then 'beach' when 2 then 'lakefront' else 'coastal waterfront without beach' end as site_type, cast(s_suppkey*6151 % 10007 as double) as x, cast(s_suppkey*12289 % 10009 as double) as y, case when s_suppkey % 20 = 0 then 1.0e0 else 150.0e0 + (s_suppkey % 7)*75 end as h from {supplier}",
    ),
    "v_activity": (
        ("lineitem",),
        "select lpad(cast(l_partkey as string),10,'0') as geography, cast(date_trunc('month', l_shipdate) as date) as start_date, case when dayofweek(l_shipdate) - dayofweek(timestamp '2023-01-01 00:00:00') in (0,6) then 1 else 0 end as agg_day_period, cast(l_quantity as int) % 24 as agg_time_period, l_extendedprice/1.0e5 as activity_index_total from {lineitem}",
    ),
    "v_times": ((), "select 5 as walktime_min union all select 10 union all select 20 union all select 30"),
    "v_census": (
        ("v_sites", "v_times"),
        "select s.park_num, w.walktime_min, case when (s.park_num + w.walktime_min) % 19 = 0 then 0 else 1 end as hasdata, cast((s.park_num*97 + w.walktime_min) % 53 as double)*1000 as household_median_income, cast((s.park_num*31 + w.walktime_min) % 89 as double) as shelter_expenditures_principal, cast((s.park_num*37 + w.walktime_min) % 101 as double) as pct_low_income, cast((s.park_num*41 + w.walktime_min) % 101 as double) as pct_bachelors_and_above, cast((s.park_num*43 + w.walktime_min) % 101 as double) as pct_visible_minority, cast((s.park_num*47 + w.walktime_min) % 101 as double) as pct_indigenous_identity from {v_sites} s cross join {v_times} w",
    ),
    "v_network": (
        ("part",),
        "select cast(p_partkey as bigint) as u, cast(p_partkey + d as bigint) as v, 100.0e0 as len, cast(p_partkey % 40 as double)*100 as ux, cast(floor(p_partkey/40.0e0)*100 as double) as uy, cast((p_partkey + d) % 40 as double)*100 as vx, cast(floor((p_partkey + d)/40.0e0)*100 as double) as vy from {part} cross join (select 1 as d union all select 40) k where p_partkey + d < (select count(*) from {part}) and not (d = 1 and p_partkey % 40 = 39) and (p_partkey*7919 + d) % 3 <> 0",
    ),
    "v_stops": (("customer",), "select cast(c_custkey as bigint) as stop_id, cast(c_custkey*7919 % 4000 as double) as x, cast(c_custkey*104729 % 5003 as double) as y from {customer}"),
    "v_raster": (("part",), "select cast(floor(p_partkey/40.0e0) as int) as r, cast(p_partkey % 40 as int) as c, cast(p_partkey*6151 % 97 as double)*0.3e0 as elev, case when p_partkey % 40 >= 30 then 1 else 0 end as water from {part}"),
    # brute force; the Spark side finds the same pairs by buckets
    "v_lookup": (("v_cells", "v_sites"), "select park_num, geography from {v_cells} c join {v_sites} s on abs(c.x-s.x) < h and abs(c.y-s.y) < h"),
    "v_hours": (
        ("v_activity", "v_lookup"),
        "select park_num, start_date, agg_day_period, agg_time_period, round(avg(activity_index_total) + 1.0e-9, 6) as site_activity_index, count(geography) as contributing_cell_records, count(distinct geography) as unique_cells_used from {v_activity} join {v_lookup} using (geography) where agg_time_period between 6 and 20 group by park_num, start_date, agg_day_period, agg_time_period",
    ),
}


def twin(body: str) -> str:
    """DuckDB text: the views that the body names, as common table expressions, and the body."""
    needed: list[str] = []

    def visit(name: str) -> None:
        if name in VIEWS and name not in needed:
            for x in VIEWS[name][0]:
                visit(x)
            needed.append(name)

    for name in VIEWS:
        if name in body:
            visit(name)
    names = {n: n for n in [*VIEWS, "part", "supplier", "lineitem", "customer"]}
    parts = [f"{n} as ({VIEWS[n][1].format(**names)})" for n in needed]
    body = body.strip()
    if body.lower().startswith("with recursive"):
        return "with recursive " + ", ".join([*parts, body[len("with recursive") :].strip()])
    if body.lower().startswith("with "):
        return "with " + ", ".join([*parts, body[len("with ") :].strip()])
    return ("with " + ", ".join(parts) + " " if parts else "") + body


class Inputs:
    """The tables of one folder and the views over them, as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def view(self, name: str) -> DataFrame:
        needs, body = VIEWS[name]
        return self.spark.sql(body, **{n: self.view(n) if n in VIEWS else self.table(n) for n in needs})

    cells = cached_property(lambda self: self.view("v_cells"))
    sites = cached_property(lambda self: self.view("v_sites"))
    activity = cached_property(lambda self: self.view("v_activity"))
    census = cached_property(lambda self: self.view("v_census"))
    network = cached_property(lambda self: self.view("v_network"))
    stops = cached_property(lambda self: self.view("v_stops"))
    raster = cached_property(lambda self: self.view("v_raster"))

    @cached_property
    def lookup(self) -> DataFrame:
        from tidemark.operators.spatial import cells_in_sites

        return cells_in_sites(self.cells, self.sites)

    @cached_property
    def placed(self) -> DataFrame:
        """The lookup with the places of its cells."""
        from tidemark.operators.spatial import placed_cells

        return placed_cells(self.cells, self.sites)

    @cached_property
    def hours(self) -> DataFrame:
        from tidemark.operators.panel import square_hours

        return square_hours(self.activity, self.cells, self.sites)

    @cached_property
    def stored_hours(self) -> DataFrame:
        """The panel as a table of the shared folder, for queries that read it more than once."""
        from tidemark.operators.graph import written

        return written(self.hours, "hours")
