"""Views that give the star-schema tables the shapes of journeys, regions, rasters, networks and assets.

All arithmetic is on integers, so Spark and the oracle derive the same rows. SQL holds
the same views for DuckDB, to be put in front of an oracle query.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BOUNDS = (664030.0, 4447820.0, 726030.0, 4525010.0)
EPOCH = "TIMESTAMP_NTZ '1970-01-01 00:00:00'"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seconds(ts: str = "ts") -> Column:
    return F.expr(f"timestampdiff(MICROSECOND, {EPOCH}, CAST({ts} AS TIMESTAMP_NTZ))") / 1000000.0


def points(spark: SparkSession, sf_dir: str, by_user: bool = False) -> DataFrame:
    """track_id, day, vidx, t, x, y, ele, event_id: a track is a user's day, or all of a user's events."""
    day = F.date_format("ts", "yyyy-MM-dd")
    track = F.col("user_id").cast("string") if by_user else F.concat_ws("-", F.col("user_id").cast("string"), day)
    rows = table(spark, sf_dir, "events").select(
        track.alias("track_id"),
        F.when(F.col("event_type") != "error", day).alias("day"),
        seconds().alias("t"),
        (664030 + (F.col("event_id") * 7919) % 62000).cast("double").alias("x"),
        (4447820 + (F.col("event_id") * 104729) % 77190).cast("double").alias("y"),
        (1214 + (F.col("event_id") * 31) % 986).cast("double").alias("ele"),
        "event_id",
    )
    order = Window.partitionBy("track_id").orderBy("t", "event_id")
    return rows.withColumn("vidx", (F.row_number().over(order) - 1).cast("long"))


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "region").selectExpr(
        "r_name AS region_id", "CAST(664030 + r_regionkey * 10000 AS DOUBLE) AS min_x", "CAST(4447820 AS DOUBLE) AS min_y",
        "CAST(686030 + r_regionkey * 10000 AS DOUBLE) AS max_x", "CAST(4525010 AS DOUBLE) AS max_y", "10 AS res_m",
    )


def raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """row, col, v; v is null where there is no data."""
    cells = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row"), F.posexplode("embedding").alias("col", "e"))
    whole = F.col("e").cast("double") * 100000
    v = F.when((F.col("row") * 64 + F.col("col")) % 97 != 0, F.when(whole < 0, -F.floor(-whole).cast("double")).otherwise(F.floor(whole).cast("double")))  # as trunc, with -0.0
    return cells.select("row", F.col("col").cast("long").alias("col"), v.alias("v"))


def filled_raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster(spark, sf_dir).withColumn("v", F.coalesce("v", F.lit(0.0)))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """eid, src, dst, class, len_m: a network with parallel edges."""
    lines = table(spark, sf_dir, "lineitem")
    kinds = F.create_map(*(F.lit(x) for x in ("A", "trail", "N", "road", "R", "4wd")))
    pairs = lines.select("l_suppkey", "l_partkey", "l_returnflag").distinct()
    return pairs.select(
        F.concat_ws("-", "l_suppkey", "l_partkey", "l_returnflag").alias("eid"),
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("src"),
        F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("dst"),
        kinds[F.col("l_returnflag")].alias("class"),
        (100 + (F.col("l_suppkey") * 37 + F.col("l_partkey") * 101) % 900).cast("long").alias("len_m"),
    )


def assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        F.col("source").alias("bundle"), F.col("doc_id").cast("string").alias("name"), F.sha2("text", 256).alias("sha"), F.col("n_chars").alias("bytes"), F.col("doc_id").alias("seq")
    )


def specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k and the columns of a composition, some of them out of bounds."""
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(
        k.alias("k"), (664030 + (k * 37) % 20000).cast("double").alias("x0"), (4447820 + (k * 53) % 20000).cast("double").alias("y0"),
        (6 + k % 20).cast("double").alias("print_w"), (8 + k % 25).cast("double").alias("print_h"), ((k % 5) * 0.125).alias("bleed"),
        F.when(k % 41 == 0, "poster").when(k % 4 == 3, "wallpaper").otherwise("print").alias("kind"), (60 + k % 600).cast("double").alias("ppi"),
        F.when(k % 3 == 0, 6.0).otherwise(10.0).alias("native_m"), ((k % 37) / 100).alias("top_clear"), ((k % 56) / 10 + 0.8).alias("track_width_pt"),
        F.when(k % 53 == 0, "noon").when(k % 2 == 0, "journey").otherwise("archival").alias("light_mode"), (k % 1010).cast("int").alias("edition"),
        F.concat(F.repeat(F.lit("x"), (k % 210).cast("int")), F.when(k % 29 == 0, "é").otherwise("")).alias("credit"), F.array((k % 260).cast("int"), F.lit(10), F.lit(20)).alias("track_rgb"),
    )
    ground = (5 + F.col("k") % 9) * 300.0
    x1 = F.when(F.col("k") % 31 == 0, float("nan")).when(F.col("k") % 67 == 0, F.col("x0") - 1).otherwise(F.col("x0") + F.col("print_w") * ground)
    y1 = F.col("y0") + F.col("print_h") * ground * F.when(F.col("k") % 7 == 0, 1.05).otherwise(1.0)
    return rows.withColumns({"x1": x1, "y1": y1})


def lakes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """poly, ring, vidx, x, y: a pentagon for each part, some with a hole and some with a neighbour that shares an edge, most of them off the raster."""
    n = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select(n.alias("n"), ((n * 37) % 128 / 2.0).alias("cx"), ((n * 53) % 4000 / 2.0).alias("cy"), (1 + n % 4).cast("double").alias("a"), (1 + n % 6).cast("double").alias("b"))
    cx, cy, a, b = (F.col(c) for c in ("cx", "cy", "a", "b"))
    ring = lambda poly, nth, *corners: F.struct(poly.alias("poly"), F.lit(nth).alias("ring"), F.array(*(F.struct(x.alias("x"), y.alias("y")) for x, y in corners)).alias("v"))
    own, twin = F.col("n") * 2, F.col("n") * 2 + 1
    rings = F.array(
        ring(own, 0, (cx - a, cy - b), (cx + a, cy - b + 0.5), (cx + a + 1, cy + b), (cx, cy + b + 1.5), (cx - a, cy + b)),
        F.when(F.col("n") % 3 == 0, ring(own, 1, (cx - 0.5, cy - 0.5), (cx - 0.5, cy + 0.5), (cx + 0.5, cy + 0.5), (cx + 0.5, cy - 0.5))),
        F.when(F.col("n") % 5 == 0, ring(twin, 0, (cx - a, cy - b), (cx - a, cy + b), (cx - a - 2, cy + b), (cx - a - 2, cy - b))),
    )
    each = rows.select(F.explode(rings).alias("r")).where("r IS NOT NULL").select("r.poly", "r.ring", F.posexplode("r.v").alias("vidx", "p"))
    return each.select("poly", "ring", "vidx", "p.x", "p.y")


SQL = {
    "fx_lakes": """fx_lakes AS (SELECT poly, ring, unnest(range(len(v))) AS vidx, unnest(v)[1] AS x, unnest(v)[2] AS y FROM (
      SELECT n * 2 AS poly, 0 AS ring, [[cx - a, cy - b], [cx + a, cy - b + 0.5], [cx + a + 1, cy + b], [cx, cy + b + 1.5], [cx - a, cy + b]] AS v FROM lake_centres UNION ALL
      SELECT n * 2, 1, [[cx - 0.5, cy - 0.5], [cx - 0.5, cy + 0.5], [cx + 0.5, cy + 0.5], [cx + 0.5, cy - 0.5]] FROM lake_centres WHERE n % 3 = 0 UNION ALL
      SELECT n * 2 + 1, 0, [[cx - a, cy - b], [cx - a, cy + b], [cx - a - 2, cy + b], [cx - a - 2, cy - b]] FROM lake_centres WHERE n % 5 = 0))""",
    "lake_centres": """lake_centres AS (SELECT p_partkey AS n, (p_partkey * 37) % 128 / 2.0::DOUBLE AS cx, (p_partkey * 53) % 4000 / 2.0::DOUBLE AS cy, CAST(1 + p_partkey % 4 AS DOUBLE) AS a, CAST(1 + p_partkey % 6 AS DOUBLE) AS b FROM part)""",
    "fx_specs": """fx_specs AS (SELECT *, CASE WHEN k % 31 = 0 THEN 'nan'::DOUBLE WHEN k % 67 = 0 THEN x0 - 1 ELSE x0 + print_w * ((5 + k % 9) * 300.0::DOUBLE) END AS x1, y0 + print_h * ((5 + k % 9) * 300.0::DOUBLE) * CASE WHEN k % 7 = 0 THEN 1.05::DOUBLE ELSE 1.0::DOUBLE END AS y1 FROM (
      SELECT o_orderkey AS k, CAST(664030 + (o_orderkey * 37) % 20000 AS DOUBLE) AS x0, CAST(4447820 + (o_orderkey * 53) % 20000 AS DOUBLE) AS y0, CAST(6 + o_orderkey % 20 AS DOUBLE) AS print_w, CAST(8 + o_orderkey % 25 AS DOUBLE) AS print_h,
        (o_orderkey % 5) * 0.125::DOUBLE AS bleed, CASE WHEN o_orderkey % 41 = 0 THEN 'poster' WHEN o_orderkey % 4 = 3 THEN 'wallpaper' ELSE 'print' END AS kind, CAST(60 + o_orderkey % 600 AS DOUBLE) AS ppi,
        CASE WHEN o_orderkey % 3 = 0 THEN 6.0::DOUBLE ELSE 10.0::DOUBLE END AS native_m, (o_orderkey % 37) / 100.0::DOUBLE AS top_clear, (o_orderkey % 56) / 10.0::DOUBLE + 0.8::DOUBLE AS track_width_pt,
        CASE WHEN o_orderkey % 53 = 0 THEN 'noon' WHEN o_orderkey % 2 = 0 THEN 'journey' ELSE 'archival' END AS light_mode, CAST(o_orderkey % 1010 AS INTEGER) AS edition,
        repeat('x', CAST(o_orderkey % 210 AS INTEGER)) || CASE WHEN o_orderkey % 29 = 0 THEN 'é' ELSE '' END AS credit, [o_orderkey % 260, 10, 20] AS track_rgb FROM orders))""",
    "fx_points": """fx_points AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY t, event_id) - 1 AS vidx FROM (
      SELECT user_id || '-' || strftime(ts, '%Y-%m-%d') AS track_id, CASE WHEN event_type <> 'error' THEN strftime(ts, '%Y-%m-%d') END AS day,
        epoch_us(ts) / 1000000.0::DOUBLE AS t, CAST(664030 + (event_id * 7919) % 62000 AS DOUBLE) AS x, CAST(4447820 + (event_id * 104729) % 77190 AS DOUBLE) AS y,
        CAST(1214 + (event_id * 31) % 986 AS DOUBLE) AS ele, event_id FROM events))""",
    "fx_users": """fx_users AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY t, event_id) - 1 AS vidx FROM (
      SELECT CAST(user_id AS VARCHAR) AS track_id, CASE WHEN event_type <> 'error' THEN strftime(ts, '%Y-%m-%d') END AS day,
        epoch_us(ts) / 1000000.0::DOUBLE AS t, CAST(664030 + (event_id * 7919) % 62000 AS DOUBLE) AS x, CAST(4447820 + (event_id * 104729) % 77190 AS DOUBLE) AS y,
        CAST(1214 + (event_id * 31) % 986 AS DOUBLE) AS ele, event_id FROM events))""",
    "fx_regions": """fx_regions AS (SELECT r_name AS region_id, CAST(664030 + r_regionkey * 10000 AS DOUBLE) AS min_x, CAST(4447820 AS DOUBLE) AS min_y,
      CAST(686030 + r_regionkey * 10000 AS DOUBLE) AS max_x, CAST(4525010 AS DOUBLE) AS max_y, 10 AS res_m FROM region)""",
    "fx_raster": """fx_raster AS (SELECT r AS row, CAST(i - 1 AS BIGINT) AS col, CASE WHEN (r * 64 + i - 1) % 97 <> 0 THEN trunc(CAST(e AS DOUBLE) * 100000) END AS v
      FROM (SELECT vec_id AS r, unnest(embedding) AS e, generate_subscripts(embedding, 1) AS i FROM embeddings))""",
    "fx_filled": "fx_filled AS (SELECT row, col, coalesce(v, 0.0::DOUBLE) AS v FROM fx_raster)",
    "fx_edges": """fx_edges AS (SELECT l_suppkey || '-' || l_partkey || '-' || l_returnflag AS eid, 'S' || l_suppkey AS src, 'P' || l_partkey AS dst,
      CASE l_returnflag WHEN 'A' THEN 'trail' WHEN 'N' THEN 'road' ELSE '4wd' END AS class, CAST(100 + (l_suppkey * 37 + l_partkey * 101) % 900 AS BIGINT) AS len_m
      FROM (SELECT DISTINCT l_suppkey, l_partkey, l_returnflag FROM lineitem))""",
    "fx_assets": "fx_assets AS (SELECT source AS bundle, CAST(doc_id AS VARCHAR) AS name, sha256(text) AS sha, n_chars AS bytes, doc_id AS seq FROM documents)",
}


def oracle(*views: str, body: str, recursive: bool = False) -> str:
    """SQL of the named views and a body that may go on with further views after a comma, or start with SELECT."""
    needs = {"fx_filled": "fx_raster", "fx_lakes": "lake_centres"}
    names = [v for name in views for v in ([needs[name], name] if name in needs else [name])]
    head = ", ".join(SQL[v] for v in dict.fromkeys(names))
    body = body.strip()
    return f"WITH {'RECURSIVE ' if recursive else ''}{head}{', ' if not body.upper().startswith('SELECT') else ' '}{body}"
