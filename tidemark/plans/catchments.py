"""Walk-time catchments in full, and what access points the components of the network have."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import graph as G
from tidemark.operators import spatial as S
from tidemark.plans.registry import query
from tidemark.plans.spatials import _COMP, _D, _EDGES, streets
from tidemark.sources.fixtures import Inputs

# Metres of each walk time, and the buffer round the edges reached.
WALKS = {5: 400, 10: 800, 20: 1600, 30: 2400}
BUFFER = 15
#: Metres within which an access point belongs to the nearest node.
SNAP = 60

_ORIGINS = "select park_num as source, cast(park_num*k % (select count(*) from part) as bigint) as node from v_sites, (select unnest([37, 41]) as k) q"
_BANDS = " union all ".join(f"select {m} as minutes, {d} as distance_m" for m, d in WALKS.items())
_TABLE = f"""with recursive {_EDGES}, o as (select distinct source, node from ({_ORIGINS}) s where node in (select u from e)),
p as (select source, node, cast(0 as bigint) as dist from o union select p.source, e.v, p.dist + e.len from p join e on p.node = e.u where p.dist + e.len <= {max(WALKS.values())}),
t as (select source, node, min(dist) as dist from p group by source, node), k as ({_BANDS}),
n as (select source, minutes, count(*) as nodes from t join k on dist <= distance_m group by source, minutes),
r as (select a.source, n.u, n.v, n.len, greatest(a.dist, b.dist) as need from v_network n join t a on a.node = n.u join t b on b.node = n.v and b.source = a.source),
l as (select source, minutes, count(*) as edges, sum(len) as length_m from r join k on need <= distance_m group by source, minutes),
d as (select distinct u, v, stop_id from v_network n join v_stops s on {_D} <= {BUFFER}),
c as (select source, minutes, count(distinct stop_id) as stops from r join d using (u, v) join k on need <= distance_m group by source, minutes)
select a.source, k.minutes, cast(k.distance_m as int) as distance_m, {BUFFER} as edge_buffer_m, a.origin_nodes, coalesce(nodes, 0) as nodes, coalesce(edges, 0) as edges, coalesce(length_m, 0.0e0) as length_m, coalesce(stops, 0) as stops
from (select source, count(*) as origin_nodes from o group by source) a cross join k left join n on n.source = a.source and n.minutes = k.minutes left join l on l.source = a.source and l.minutes = k.minutes left join c on c.source = a.source and c.minutes = k.minutes"""


@query(_TABLE)
def grf7_jn21_catchment_table(i: Inputs) -> DataFrame:
    """Every site and walk time: distance, buffer, origins, nodes, edges and their length, stops near the edges reached.

    An edge is reached at the larger distance of its ends, a stop at the least of the edges near it; so each edge and
    stop of a site is one row, whatever the number of walk times, and these are counts under conditions."""
    count = i.table("part").count()
    origins = i.sites.select(F.col("park_num").alias("source"), F.explode(F.array(F.lit(37), F.lit(41))).alias("k"))
    origins = origins.select("source", (F.col("source") * F.col("k") % count).cast("long").alias("node")).distinct()
    origins = G.written(origins.join(G.both_ways(i.network).select(F.col("u").alias("node")).distinct(), "node", "left_semi"), "origins")
    reached = G.reach(origins.withColumn("dist", F.lit(0.0)), i.network.select("u", "v", "len"), float(max(WALKS.values())))
    at = lambda end: reached.select("source", F.col("node").alias(end), F.col("dist").alias(f"d{end}"))
    edges = G.written(i.network.select("u", "v", "len").join(at("u"), "u").join(at("v"), ["source", "v"]).select("source", "u", "v", "len", F.greatest("du", "dv").alias("need")), "reached")
    near = S.points_near_segments(i.stops, streets(i), float(BUFFER)).select("u", "v", "stop_id").distinct()
    stops = edges.join(near, ["u", "v"]).groupBy("source", "stop_id").agg(F.min("need").alias("need"))

    def upto(df: DataFrame, need: str, **sums) -> DataFrame:
        return df.groupBy("source").agg(*[f(F.col(need) <= d).alias(f"{name}_{m}") for m, d in WALKS.items() for name, f in sums.items()])

    full = origins.groupBy("source").agg(F.count("*").alias("origin_nodes")).join(upto(reached, "dist", nodes=F.count_if), "source", "left")
    full = full.join(upto(edges, "need", edges=F.count_if, length=lambda c: F.sum(F.when(c, F.col("len")).otherwise(0.0))), "source", "left").join(upto(stops, "need", stops=F.count_if), "source", "left")
    band = lambda m, d: F.struct(F.lit(m).alias("minutes"), F.lit(d).alias("distance_m"), F.lit(BUFFER).alias("edge_buffer_m"), *[F.coalesce(f"{c}_{m}", F.lit(0).cast("long")).alias(c) for c in ("nodes", "edges", "stops")], F.coalesce(f"length_{m}", F.lit(0.0)).alias("length_m"))
    return full.select("source", "origin_nodes", F.explode(F.array(*[band(m, d) for m, d in WALKS.items()])).alias("b")).select("source", "origin_nodes", "b.*")


_NODES = "(select distinct u as node, ux, uy from v_network)"


@query(
    f"with recursive {_COMP}, l as (select node, min(component) as component from c group by node), a as (select stop_id, node from (select stop_id, node, sqrt(power(x-ux,2)+power(y-uy,2)) as d, row_number() over (partition by stop_id order by sqrt(power(x-ux,2)+power(y-uy,2)), node) as r from v_stops, {_NODES} n) q where r = 1 and d <= {SNAP}),"
    " d as (select u as node, count(*) as degree from e group by u), s as (select component, count(*) as node_count, count(*) filter (where degree >= 3) as junction_count from l join d using (node) group by component)"
    " select s.component, node_count, junction_count, junction_count > 0 as has_junction, count(stop_id) as access_points from s left join (select component, stop_id from a join l using (node)) q on q.component = s.component group by s.component, node_count, junction_count"
)
def grf5_access_points(i: Inputs) -> DataFrame:
    """Components with their nodes, junctions and the access points whose nearest node, if near enough, is theirs."""
    labels = G.connected(i.network)
    nodes = i.network.select(F.col("u").alias("node"), F.col("ux").alias("x2"), F.col("uy").alias("y2")).distinct()
    near = S.nearest_point(i.stops, nodes, "stop_id", ["node"], 200.0).filter(F.col("distance") <= SNAP)
    points = near.join(labels, "node").groupBy("component").agg(F.count("*").alias("access_points"))
    stats = G.component_stats(i.network, labels).select("component", "node_count", "junction_count")
    return stats.join(points, "component", "left").select("component", "node_count", "junction_count", (F.col("junction_count") > 0).alias("has_junction"), F.coalesce("access_points", F.lit(0).cast("long")).alias("access_points"))
