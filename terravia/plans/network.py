"""Queries on networks."""

from pyspark.sql import functions as F

from terravia import fixtures as fx
from terravia.catalog import register
from terravia.fixtures import oracle
from terravia.operators import graph as G
from terravia.operators import routing as R


OUTING = R.WEIGHTS["outing"]


def farthest(spark, d) -> str:
    """The vertex that is dearest to reach from S1."""
    return R.distances(fx.edges(spark, d), "S1", OUTING).agg(F.max_by("node", F.struct("cost", "node")).alias("n")).first()["n"]


@register("shortest_paths")
def shortest_paths(spark, d):
    return R.distances(fx.edges(spark, d), "S1", OUTING).withColumn("cost", F.round("cost", 6))


@register("shortest_path_edges")
def shortest_path_edges(spark, d):
    """The way from S1 to the vertex that is dearest to reach."""
    return R.farthest_way(fx.edges(spark, d), "S1", OUTING)


def nation_trips(spark, d):
    """A trip for each nation, from its first supplier to its last; every seventh goes to a place that is nowhere."""
    per = fx.table(spark, d, "supplier").groupBy("s_nationkey").agg(F.min("s_suppkey").alias("a"), F.max("s_suppkey").alias("b"))
    k = F.col("n_nationkey")
    shape = F.element_at(F.array(*map(F.lit, R.SHAPES)), (k % 3 + 1).cast("int"))
    of = lambda c: F.concat(F.lit("S"), F.coalesce(c, F.lit(1)).cast("string"))
    rows = fx.table(spark, d, "nation").join(per, k == F.col("s_nationkey"), "left")
    return rows.select(F.col("n_name").alias("trip"), of("a").alias("start"), F.when(k % 7 == 3, F.lit("nowhere")).otherwise(of("b")).alias("goal"), shape.alias("shape"))


@register("loop_share")
def loop_share(spark, d):
    """How much of the way out each nation's trip takes again on a way back that avoids it; 0 where start and goal are one."""
    loops = nation_trips(spark, d).withColumn("shape", F.lit("loop"))
    return R.trips(fx.edges(spark, d), loops)[0].select("trip", F.round("shared", 6).alias("share"))


@register("trip_shape")
def trip_shape(spark, d):
    """How each nation's trip came out."""
    summary, _ = R.trips(fx.edges(spark, d), nation_trips(spark, d))
    return summary.select("trip", "reachable", "shape", F.round("shared", 6).alias("shared"), F.round("share_4wd", 6).alias("share_4wd"), F.round("length_m", 3).alias("length_m"))


@register("trip_legs")
def trip_legs(spark, d):
    return R.trips(fx.edges(spark, d), nation_trips(spark, d))[1]


@register("road_vertices", oracle("fx_edges", body="SELECT DISTINCT node FROM (SELECT src AS node FROM fx_edges WHERE class = 'road' UNION ALL SELECT dst FROM fx_edges WHERE class = 'road')"))
def road_vertices(spark, d):
    return G.road_vertices(fx.edges(spark, d))


@register("class_counts", oracle("fx_edges", body="SELECT class, count(*) AS n FROM fx_edges GROUP BY class"))
def class_counts(spark, d):
    return G.class_counts(fx.edges(spark, d))


@register(
    "edge_of_pair",
    oracle("fx_edges", body="SELECT src, dst, min(eid) AS eid FROM fx_edges GROUP BY src, dst"),
)
def edge_of_pair(spark, d):
    e = fx.edges(spark, d)
    return G.edge_of_pair(e, e.select("src", "dst").distinct())


@register(
    "network_edges",
    oracle("fx_users", body="""r AS (SELECT track_id, vidx, round(x / 1000) * 1000 AS x, round(y / 1000) * 1000 AS y FROM fx_users), n AS (SELECT *, lead(x) OVER w AS x1, lead(y) OVER w AS y1 FROM r WINDOW w AS (PARTITION BY track_id ORDER BY vidx))
  SELECT track_id || '-' || vidx AS eid, round(sqrt((x1 - x) * (x1 - x) + (y1 - y) * (y1 - y)), 3) AS len_m FROM n WHERE x1 IS NOT NULL AND NOT (x = x1 AND y = y1)"""),
)
def network_edges(spark, d):
    ways = fx.points(spark, d, by_user=True).select(F.col("track_id").alias("way"), "vidx", "x", "y", F.lit("road").alias("class"))
    return G.from_ways(ways, -3).select("eid", F.round("len_m", 3).alias("len_m"))


_BUDGET = "\n  ".join(f"s{k} AS (SELECT CASE WHEN n > 18000 THEN s * 1.02::DOUBLE * n / 18000 ELSE s END AS s FROM (SELECT s, sum(least(4200, greatest(2, CAST(floor(length_m / s) AS BIGINT)))) AS n FROM lengths, s{k - 1} GROUP BY s))," for k in range(1, 5))


@register(
    "trips_in_budget",
    f"""WITH lengths AS (SELECT o_custkey AS trip, sum(o_totalprice) AS length_m FROM orders GROUP BY o_custkey), s0 AS (SELECT 15.0::DOUBLE AS s),
  {_BUDGET}
  points AS (SELECT trip, least(4200, greatest(2, CAST(floor(length_m / s) AS INTEGER))) AS n_points, s FROM lengths, s4)
  SELECT trip, n_points, round(s, 3) AS spacing FROM points""",
)
def trips_in_budget(spark, d):
    """A customer's orders are a trip of as many metres: all trips stay, set coarser together."""
    lengths = fx.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("trip")).agg(F.sum("o_totalprice").alias("length_m"))
    spacing, sized = R.within_budget(lengths, R.LEAST_SPACING_M)
    return sized.select("trip", "n_points", F.lit(round(spacing, 3)).alias("spacing"))


@register("trip_spacing", oracle("fx_specs", body="SELECT k, greatest(15.0::DOUBLE, native_m * 1.5::DOUBLE) AS spacing_m FROM fx_specs"))
def trip_spacing(spark, d):
    return fx.specs(spark, d).select("k", R.spacing_m(F.col("native_m")).alias("spacing_m"))
