"""Queries on what regions are baked from."""

from pyspark.sql import functions as F

from terravia import fixtures as fx
from terravia.catalog import register
from terravia.fixtures import oracle
from terravia.operators import bakes as B
from terravia.plans.sky import _series

_CODES = ("390", "436", "361", "LakePond ", "reservoir", "Playa", "SwampMarsh", None, "12")


@register(
    "water_types",
    "SELECT p_partkey, CASE p_partkey % 9 WHEN 0 THEN true WHEN 1 THEN true WHEN 3 THEN true WHEN 4 THEN true WHEN 7 THEN true ELSE false END AS water, p_partkey % 9 IN (2, 5) AS dry FROM part",
)
def water_types(spark, d):
    code = F.get(F.array(*(F.lit(x).cast("string") for x in _CODES)), (F.col("p_partkey") % 9).cast("int"))
    return fx.table(spark, d, "part").select("p_partkey", B.is_water(code).alias("water"), B.is_dry_lake(code).alias("dry"))


def _lonlat_points(spark, d):
    """Vertices in degrees, some twice in a row, some without a place."""
    p = fx.points(spark, d)
    i = F.col("event_id")
    return p.select("track_id", "vidx", "event_id", F.when(i % 19 != 0, -121.0 + (i % 7) * 0.01).alias("lon"), (40.0 + (i % 3) * 0.01).alias("lat"))


@register(
    "ways_projected",
    oracle("fx_points", body="""g AS (SELECT track_id AS way, vidx, event_id, event_id % 7 AS a, event_id % 3 AS b FROM fx_points WHERE event_id % 19 <> 0),
  m AS (SELECT *, lag(a) OVER w AS pa, lag(b) OVER w AS pb FROM g WINDOW w AS (PARTITION BY way ORDER BY vidx)),
  k AS (SELECT *, count(*) OVER (PARTITION BY way) AS n FROM m WHERE pa IS NULL OR pa <> a OR pb <> b)
  SELECT way, row_number() OVER (PARTITION BY way ORDER BY vidx) - 1 AS vidx, a, b, CASE abs(hash_way) WHEN 0 THEN 'trail' WHEN 1 THEN '4wd' ELSE 'road' END AS class
  FROM (SELECT *, length(way) % 3 AS hash_way FROM k WHERE n >= 2)"""),
)
def ways_projected(spark, d):
    """Each way comes from two tiles; places are told by their steps of a hundredth of a degree."""
    p = _lonlat_points(spark, d)
    kind = F.get(F.array(F.lit("cycleway"), F.lit("track"), F.lit("primary")), F.length("track_id") % 3)
    rows = p.select(F.explode(F.array(F.lit(3), F.lit(8))).alias("tile"), F.col("track_id").alias("way"), kind.alias("highway"), "vidx", "lon", "lat")
    done = B.ways(rows, 10)
    from terravia.functions.geodesy import lonlat

    lon, lat = lonlat(F.col("x"), F.col("y"), 10)
    return done.select("way", "vidx", F.round((lon + 121.0) * 100).cast("long").alias("a"), F.round((lat - 40.0) * 100).cast("long").alias("b"), "class")


@register(
    "landform_filter",
    "SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN 'range' WHEN 1 THEN 'summit' WHEN 2 THEN 'gap' WHEN 3 THEN 'valley' END AS kind, CASE p_partkey % 8 WHEN 0 THEN 100 WHEN 1 THEN 70 WHEN 2 THEN 55 ELSE 40 END AS rank FROM part WHERE p_partkey % 8 < 4 AND p_partkey % 5 <> 0",
)
def landform_filter(spark, d):
    k = F.col("p_partkey")
    kinds = F.get(F.array(*map(F.lit, ("Range", "Summit", "Gap", "Valley", "Ridge", "range", "Lake", ""))), (k % 8).cast("int"))
    rows = fx.table(spark, d, "part").select(F.when(k % 5 == 0, "  ").otherwise(F.concat(F.lit(" n"), k.cast("string"))).alias("name"), kinds.alias("class"), F.array(F.array(F.lit(1.0), F.lit(2.0))).alias("points"))
    return B.landforms(rows).select(F.substring("name", 2, 20).cast("long").alias("p_partkey"), "kind", "rank")


@register(
    "tile_plan",
    """WITH b AS (SELECT n_nationkey, n_nationkey % 6 AS wide, n_nationkey % 4 AS high FROM nation), s AS (SELECT *, CASE WHEN wide = 0 OR high = 0 THEN 1 ELSE wide END AS nx, CASE WHEN wide = 0 OR high = 0 THEN 1 ELSE high END AS ny FROM b),
  t AS (SELECT *, unnest(range(0, nx * ny)) AS nth FROM s)
  SELECT n_nationkey, CAST(nth AS INTEGER) AS nth, CAST(10 + nth // nx * CASE WHEN ny = high THEN 1 ELSE 0 END AS DOUBLE) AS s, CAST(-120 + nth % nx AS DOUBLE) AS w FROM t""",
)
def tile_plan(spark, d):
    n = fx.table(spark, d, "nation").select("n_nationkey", F.lit(-120.0).alias("w"), F.lit(10.0).alias("s"), (F.col("n_nationkey") % 6 - 120).cast("double").alias("e"), (F.col("n_nationkey") % 4 + 10).cast("double").alias("n"))
    return B.tiles(n, "n_nationkey").select("n_nationkey", F.col("nth").cast("int").alias("nth"), "s", "w")


@register(
    "region_readiness",
    """SELECT r_name AS region_id, r_regionkey <> 4 AS dem_present, CASE WHEN r_regionkey <> 4 THEN round(r_regionkey * 7.25::DOUBLE, 2) END AS drift_m, r_regionkey <> 4 AND r_regionkey * 7.25::DOUBLE <= 15 AS bounds_match, r_regionkey <> 4 AND r_regionkey <> 1 AS crs_match,
  r_regionkey <> 4 AND r_regionkey <> 1 AND r_regionkey * 7.25::DOUBLE <= 15 AS ready FROM region""",
)
def region_readiness(spark, d):
    r = fx.regions(spark, d).join(fx.table(spark, d, "region").select(F.col("r_name").alias("region_id"), "r_regionkey"), "region_id").withColumn("crs", F.lit("EPSG:32610"))
    found = r.where("r_regionkey <> 4").select("region_id", F.when(F.col("r_regionkey") == 1, "EPSG:32611").otherwise(F.col("crs")).alias("crs"), (F.col("min_x") - F.col("r_regionkey") * 7.25).alias("min_x"), "min_y", "max_x", "max_y", "res_m")
    return B.readiness(r, found)


@register(
    "publish_guard",
    "SELECT n_nationkey, CASE WHEN n_regionkey = 3 OR n_regionkey = 2 THEN 'unverified' WHEN n_regionkey = 1 THEN 'synthetic' END AS refused, CASE WHEN n_regionkey = 3 THEN 'none' WHEN n_regionkey = 2 THEN 'unverified' ELSE 'known' END AS record FROM nation",
)
def publish_guard(spark, d):
    nations = fx.table(spark, d, "nation").select("n_nationkey", F.col("n_regionkey").alias("region_id"))
    records = fx.table(spark, d, "region").where("r_regionkey <> 3").select(F.col("r_regionkey").alias("region_id"), F.when(F.col("r_regionkey") != 2, F.col("r_regionkey") == 1).alias("synthetic"), F.lit(True).alias("known"))
    done = B.may_publish(nations, records).join(records, "region_id", "left")
    return done.select("n_nationkey", "refused", B.terrain_record(F.col("synthetic"), F.col("known")).alias("record"))


@register("lonlat_boxes", "SELECT r_name AS region_id, true AS holds FROM region")
def lonlat_boxes(spark, d):
    """The box of the corners holds the region's middle and has its width in degrees to a hundredth."""
    from terravia.functions.geodesy import lonlat

    b = B.lonlat_box(fx.regions(spark, d), 10)
    lon, lat = lonlat((F.col("min_x") + F.col("max_x")) / 2, (F.col("min_y") + F.col("max_y")) / 2, 10)
    wide = (F.col("east") - F.col("west")) * 111320.0 * F.cos(F.radians(lat))
    return b.select("region_id", (lon.between(F.col("west"), F.col("east")) & lat.between(F.col("south"), F.col("north")) & (F.abs(wide / 22000.0 - 1) < 0.1)).alias("holds"))


@register(
    "waters_baked",
    oracle("fx_points", body="""b AS (SELECT track_id, count(*) AS n FROM fx_points WHERE event_id % 19 <> 0 GROUP BY track_id) SELECT length(track_id) % 3 AS part, count(*) AS features FROM fx_points JOIN b USING (track_id) WHERE vidx = 0 AND length(track_id) % 3 <> 2 AND n > 1
   AND track_id IN (SELECT track_id FROM (SELECT track_id, event_id % 7 AS a, event_id % 3 AS b FROM fx_points WHERE event_id % 19 <> 0) GROUP BY track_id HAVING count(DISTINCT a * 10 + b) > 1) GROUP BY 1"""),
)
def waters_baked(spark, d):
    """Features by their part, of the lakes and reservoirs; those that come to one place are gone."""
    p = _lonlat_points(spark, d)
    part = F.length("track_id") % 3
    f = p.select(F.col("track_id").alias("feature"), part.alias("part"), F.lit(None).cast("string").alias("name"), F.when(part == 0, "390").when(part == 1, "Reservoir").otherwise("361").alias("ftype"), "vidx", "lon", "lat")
    return B.waters(f, 10).groupBy("part").agg(F.count_distinct("feature").alias("features"))


_PLACE = "-123.9::DOUBLE + ((event_id * 7919) % 5003) / 2000.0::DOUBLE AS lon, 36.0::DOUBLE + ((event_id * 104729) % 4001) / 1000.0::DOUBLE AS lat"


@register(
    "hydro_baked",
    oracle(
        "fx_points",
        body=f"""ll AS (SELECT event_id, t, {_PLACE} FROM fx_points), {_series().replace("SELECT event_id, round(", ", gx AS (SELECT event_id, round(", 1)}),
  f AS (SELECT CAST(split_part(track_id, '-', 1) AS INTEGER) AS feature, CAST(right(track_id, 2) AS INTEGER) AS part, vidx, gx.x, gx.y, count(*) OVER (PARTITION BY track_id) AS n FROM fx_points JOIN gx USING (event_id))
  SELECT CASE WHEN feature % 2 = 1 THEN 'river' WHEN feature % 6 = 4 THEN 'playa' ELSE 'lake' END AS kind, feature, part, 'w' || feature AS name, CASE WHEN feature % 2 = 1 THEN feature % 5 END AS stream_order, vidx, round(x, 1) AS x, round(y, 1) AS y FROM f
  WHERE n > 1 AND (feature % 2 = 0 OR feature % 5 >= 3)""",
    ),
)
def hydro_baked(spark, d):
    """Users as waters, a day of theirs a part: lakes, dry lakes, and rivers of the third order and up, all vertices in metres: nothing is simplified away here, which SQL could not follow."""
    i, u = F.col("event_id"), F.substring_index("track_id", "-", 1).cast("int")
    p = fx.points(spark, d).select(u.alias("feature"), F.substring("track_id", -2, 2).cast("int").alias("part"), F.concat(F.lit("w"), u.cast("string")).alias("name"), "vidx", (-123.9 + (i * 7919) % 5003 / 2000.0).alias("lon"), (36.0 + (i * 104729) % 4001 / 1000.0).alias("lat"))
    code = F.when(F.col("feature") % 6 == 4, " playa ").when(F.col("feature") % 6 == 2, "Reservoir").otherwise("390")
    areas = p.where("feature % 2 = 0").withColumn("ftype", code)
    lines = p.where("feature % 2 = 1").withColumn("stream_order", F.col("feature") % 5)
    out = lambda kind, rows, order: rows.select(F.lit(kind).alias("kind"), "feature", "part", "name", order.cast("int").alias("stream_order"), "vidx", F.round(F.round("x", 3), 1).alias("x"), F.round(F.round("y", 3), 1).alias("y"))
    none = F.lit(None)
    return out("lake", B.waters(areas, 10, 0.001), none).unionByName(out("playa", B.dry_lakes(areas, 10, 0.001), none)).unionByName(out("river", B.rivers(lines, 10, tolerance_m=0.001), F.col("stream_order")))
