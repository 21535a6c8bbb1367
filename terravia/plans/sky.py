"""Queries on geodesy and the sun."""

import re

from pyspark.sql import functions as F

from terravia import fixtures as fx
from terravia.catalog import register
from terravia.fixtures import oracle
from terravia.functions import geodesy as G
from terravia.functions import solar as S

_LL = "ll AS (SELECT event_id, t, -123.0::DOUBLE + (event_id % 600) / 100.0::DOUBLE AS lon, 30.0::DOUBLE + (event_id % 2500) / 100.0::DOUBLE AS lat FROM fx_points)"


def _lonlat(spark, d):
    p = fx.points(spark, d)
    return p.select("event_id", "t", (-123.0 + (F.col("event_id") % 600) / 100.0).alias("lon"), (30.0 + (F.col("event_id") % 2500) / 100.0).alias("lat"))


def _series():
    d = lambda v: f"{v!r}::DOUBLE"
    x = " + ".join(["eta", *(f"{d(a)} * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j, a in enumerate(G.ALPHA, 1))])
    y = " + ".join(["xi", *(f"{d(a)} * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j, a in enumerate(G.ALPHA, 1))])
    r = d(G.K0 * G.RADIUS)
    return f"""tt AS (SELECT *, radians(lon + 123) AS dl, sinh(atanh(sin(radians(lat))) - {d(G.E)} * atanh({d(G.E)} * sin(radians(lat)))) AS q FROM ll),
  xe AS (SELECT *, atan2(q, cos(dl)) AS xi, atanh(sin(dl) / sqrt(1 + q * q)) AS eta FROM tt)
  SELECT event_id, round(500000 + {r} * ({x}), 3) AS x, round({r} * ({y}), 3) AS y FROM xe"""


@register("project_utm", oracle("fx_points", body=_LL + ", " + _series()))
def project_utm(spark, d):
    x, y = G.utm(F.col("lon"), F.col("lat"), 10)
    return _lonlat(spark, d).select("event_id", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"))


@register("unproject_utm", oracle("fx_points", body=_LL + " SELECT event_id, round(lon, 6) AS lon, round(lat, 6) AS lat FROM ll"))
def unproject_utm(spark, d):
    """There and back again: the oracle is the input."""
    x, y = G.utm(F.col("lon"), F.col("lat"), 10)
    there = _lonlat(spark, d).select("event_id", x.alias("x"), y.alias("y"))
    lon, lat = G.lonlat(F.col("x"), F.col("y"), 10)
    return there.select("event_id", F.round(lon, 6).alias("lon"), F.round(lat, 6).alias("lat"))


@register("overview_pixels", oracle("fx_points", body="SELECT event_id, round((x - 664030) / 62000 * 1124, 4) AS px, round((4525010 - y) / 77190 * 1400, 4) AS py FROM fx_points"))
def overview_pixels(spark, d):
    box = tuple(map(F.lit, fx.BOUNDS))
    px, py = G.to_pixels(F.col("x"), F.col("y"), box, 1124, 1400)
    return fx.points(spark, d).select("event_id", F.round(px, 4).alias("px"), F.round(py, 4).alias("py"))


_BOX = "bx AS (SELECT event_id, lon AS w, lat AS s, lon + (event_id % 7) / 10.0::DOUBLE AS e, lat + (event_id % 5) / 10.0::DOUBLE AS n FROM ll)"


def _boxes(spark, d):
    i = F.col("event_id")
    return _lonlat(spark, d).select("event_id", F.col("lon").alias("w"), F.col("lat").alias("s"), (F.col("lon") + (i % 7) / 10.0).alias("e"), (F.col("lat") + (i % 5) / 10.0).alias("n"))


US = [(-125.0, 24.0, -66.0, 50.0), (-170.0, 51.0, -129.0, 72.0), (-161.0, 18.0, -154.0, 23.0)]


@register(
    "bbox_plan",
    oracle("fx_points", body=_LL + ", " + _BOX + """, pd AS (SELECT *, greatest(0.2::DOUBLE * (e - w), 3000 / (111320.0::DOUBLE * greatest(0.2::DOUBLE, cos(radians((s + n) / 2))))) AS pl, greatest(0.2::DOUBLE * (n - s), 3000 / 111320.0::DOUBLE) AS pa FROM bx)
  SELECT event_id, round(w - pl, 6) AS west, round(s - pa, 6) AS south, round(e + pl, 6) AS east, round(n + pa, 6) AS north, w - pl >= -125 AND e + pl <= -66 AND s - pa >= 24 AND n + pa <= 50 AS covered,
   32600 + greatest(1, least(60, CAST(floor(((w - pl + e + pl) / 2 + 180) / 6) AS INTEGER) + 1)) AS epsg FROM pd"""),
)
def bbox_plan(spark, d):
    box = G.padded_box(*(F.col(c) for c in "wsen"))
    return _boxes(spark, d).select("event_id", *(F.round(v, 6).alias(n) for v, n in zip(box, ("west", "south", "east", "north"), strict=True)), G.covered(*box, US).alias("covered"), G.padded_zone_epsg(*(F.col(c) for c in "wsen")).alias("epsg"))


@register(
    "build_plan",
    """WITH g AS (SELECT o_orderkey, 1000.0::DOUBLE * (o_orderkey % 400 + 2) AS w, 900.0::DOUBLE * (o_orderkey % 350 + 2) AS h FROM orders),
  c AS (SELECT *, r, greatest(0, floor((w - 500) / r) - ceil(500.0::DOUBLE / r)) * greatest(0, floor((h - 500) / r) - ceil(500.0::DOUBLE / r)) AS px FROM g, (SELECT unnest([10, 30, 60]) AS r)),
  p AS (SELECT o_orderkey, coalesce(min(r) FILTER (px <= 200000000), 60) AS res FROM c GROUP BY o_orderkey)
  SELECT o_orderkey, CAST(res AS INTEGER) AS res, CAST(greatest(1, ceil(px / 40000000)) AS BIGINT) AS slices, round(px * 4 / 1e6::DOUBLE, 3) AS est_mb FROM p JOIN c USING (o_orderkey) WHERE c.r = p.res""",
)
def build_plan(spark, d):
    o = fx.table(spark, d, "orders").select("o_orderkey", (1000.0 * (F.col("o_orderkey") % 400 + 2)).alias("w"), (900.0 * (F.col("o_orderkey") % 350 + 2)).alias("h"))
    px = lambda r: G.snapped_count(F.lit(0.0), F.col("w"), r) * G.snapped_count(F.lit(0.0), F.col("h"), r)
    res = F.when(px(10) <= 200000000, 10).when(px(30) <= 200000000, 30).otherwise(60)
    chosen = o.withColumn("res", res).withColumn("px", F.when(F.col("res") == 10, px(10)).when(F.col("res") == 30, px(30)).otherwise(px(60)))
    return chosen.select("o_orderkey", "res", F.greatest(F.lit(1), F.ceil(F.col("px") / 40000000)).cast("long").alias("slices"), F.round(F.col("px") * 4 / 1e6, 3).alias("est_mb"))


_CROP = "cr AS (SELECT event_id, x - 500 - (event_id % 40) * 100 AS x0, y - 400 - (event_id % 30) * 100 AS y0, x + 500 + (event_id % 40) * 100 AS x1, y + 400 + (event_id % 30) * 100 AS y1 FROM fx_points)"


@register(
    "from_pixels",
    oracle("fx_points", body="SELECT event_id, round(664030 + (event_id % 1124) / 1124.0::DOUBLE * 62000, 3) AS x, round(4525010 - (event_id % 1400) / 1400.0::DOUBLE * 77190, 3) AS y FROM fx_points"),
)
def from_pixels(spark, d):
    i = F.col("event_id")
    x, y = G.from_pixels((i % 1124).cast("double"), (i % 1400).cast("double"), tuple(map(F.lit, fx.BOUNDS)), 1124, 1400)
    return fx.points(spark, d).select("event_id", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"))


@register(
    "sheet_pixels",
    oracle("fx_points", body="SELECT event_id, round((x - 670000) / 20000 * 900 + 54, 4) AS px, round((4500000 - y) / 30000 * 1350 + 81, 4) AS py FROM fx_points"),
)
def sheet_pixels(spark, d):
    """A crop of twenty by thirty kilometres with its margin of six hundredths."""
    crop = tuple(map(F.lit, (670000.0, 4470000.0, 690000.0, 4500000.0)))
    px, py = G.sheet_pixels(F.col("x"), F.col("y"), crop, 900, 1350, 54, 81)
    return fx.points(spark, d).select("event_id", F.round(px, 4).alias("px"), F.round(py, 4).alias("py"))


@register(
    "ordered_boxes",
    oracle("fx_points", body="SELECT event_id, least(x, 700000 + vidx) AS x0, least(y, 4480000.0::DOUBLE) AS y0, greatest(x, 700000 + vidx) AS x1, greatest(y, 4480000.0::DOUBLE) AS y1 FROM fx_points"),
)
def ordered_boxes(spark, d):
    """Boxes drawn from any corner."""
    box = G.ordered_box(F.col("x"), F.col("y"), (F.col("vidx") + 700000).cast("double"), F.lit(4480000.0))
    return fx.points(spark, d).select("event_id", *(v.alias(n) for v, n in zip(box, ("x0", "y0", "x1", "y1"), strict=True)))


@register(
    "refit_crop",
    oracle("fx_points", body=_CROP + """, w AS (SELECT event_id, (x0 + x1) / 2 AS cx, (y0 + y1) / 2 AS cy, least(least(greatest(sqrt(greatest((x1 - x0) * (y1 - y0), 1) * 0.75::DOUBLE), 3000 * (1 + 1e-6::DOUBLE)), 62000), 77190 * 0.75::DOUBLE) AS w FROM cr),
  p AS (SELECT event_id, w, w / 0.75::DOUBLE AS h, least(greatest(cx - w / 2, 664030), 726030 - w) AS x0, least(greatest(cy - w / 0.75::DOUBLE / 2, 4447820), 4525010 - w / 0.75::DOUBLE) AS y0 FROM w)
  SELECT event_id, round(x0, 3) AS x0, round(y0, 3) AS y0, round(x0 + w, 3) AS x1, round(y0 + h, 3) AS y1 FROM p"""),
)
def refit_crop(spark, d):
    i, x, y = F.col("event_id"), F.col("x"), F.col("y")
    dx, dy = 500 + (i % 40) * 100, 400 + (i % 30) * 100
    c = fx.points(spark, d).select("event_id", (x - dx).alias("x0"), (y - dy).alias("y0"), (x + dx).alias("x1"), (y + dy).alias("y1"))
    out = G.refit_crop(tuple(F.col(n) for n in ("x0", "y0", "x1", "y1")), 0.75, tuple(map(F.lit, fx.BOUNDS)), 3000.0)
    return c.select("event_id", *(F.round(v, 3).alias(n) for v, n in zip(out, ("x0", "y0", "x1", "y1"), strict=True)))


@register(
    "starter_crop",
    oracle("fx_users", body="""a AS (SELECT track_id, avg(x) AS cx, avg(y) AS cy, max(x) - min(x) AS sw, max(y) - min(y) AS sh FROM fx_users GROUP BY track_id),
  w AS (SELECT *, least(least(greatest(greatest(3 * sw, 3 * sh * 0.75::DOUBLE), 54000), 62000), 77190 * 0.75::DOUBLE) AS w FROM a),
  p AS (SELECT track_id, w, w / 0.75::DOUBLE AS h, least(greatest(cx - w / 2, 664030), 726030 - w) AS x0, least(greatest(cy - w / 0.75::DOUBLE / 2, 4447820), 4525010 - w / 0.75::DOUBLE) AS y0 FROM w)
  SELECT track_id, round(x0, 3) AS x0, round(y0, 3) AS y0, round(x0 + w, 3) AS x1, round(y0 + h, 3) AS y1 FROM p"""),
)
def starter_crop(spark, d):
    a = fx.points(spark, d, by_user=True).groupBy("track_id").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"), (F.max("x") - F.min("x")).alias("sw"), (F.max("y") - F.min("y")).alias("sh"))
    out = G.starter_crop(F.col("cx"), F.col("cy"), F.col("sw"), F.col("sh"), 0.75, tuple(map(F.lit, fx.BOUNDS)), 54000.0)
    return a.select("track_id", *(F.round(v, 3).alias(n) for v, n in zip(out, ("x0", "y0", "x1", "y1"), strict=True)))


def _sun(t, lat, lon, src, keys):
    """The published series again, term by term, for DuckDB."""
    m = lambda a, b: f"({a} - floor({a} / {b}) * {b})"
    return f"""s0 AS (SELECT *, ({t} / 86400.0::DOUBLE + 2440587.5::DOUBLE - 2451545.0::DOUBLE) / 36525.0::DOUBLE AS jc FROM {src}),
  s1 AS (SELECT *, radians({m('(280.46646::DOUBLE + jc * (36000.76983::DOUBLE + jc * 0.0003032::DOUBLE))', '360.0::DOUBLE')}) AS ml, radians(357.52911::DOUBLE + jc * (35999.05029::DOUBLE - 0.0001537::DOUBLE * jc)) AS ma,
    0.016708634::DOUBLE - jc * (0.000042037::DOUBLE + 0.0000001267::DOUBLE * jc) AS ec, radians(125.04::DOUBLE - 1934.136::DOUBLE * jc) AS om FROM s0),
  s2 AS (SELECT *, radians(degrees(ml) + sin(ma) * (1.914602::DOUBLE - jc * (0.004817::DOUBLE + 0.000014::DOUBLE * jc)) + sin(2 * ma) * (0.019993::DOUBLE - 0.000101::DOUBLE * jc) + sin(3 * ma) * 0.000289::DOUBLE - 0.00569::DOUBLE - 0.00478::DOUBLE * sin(om)) AS lam,
    radians(23 + (26 + (21.448::DOUBLE - jc * (46.815::DOUBLE + jc * (0.00059::DOUBLE - jc * 0.001813::DOUBLE))) / 60) / 60 + 0.00256::DOUBLE * cos(om)) AS ep FROM s1),
  s3 AS (SELECT *, asin(sin(ep) * sin(lam)) AS de, tan(ep / 2) * tan(ep / 2) AS yy FROM s2),
  s4 AS (SELECT *, ({m(t, '86400.0::DOUBLE')}) / 60 + 4 * degrees(yy * sin(2 * ml) - 2 * ec * sin(ma) + 4 * ec * yy * sin(ma) * cos(2 * ml) - 0.5::DOUBLE * yy * yy * sin(4 * ml) - 1.25::DOUBLE * ec * ec * sin(2 * ma)) + 4 * {lon} AS mi FROM s3),
  s5 AS (SELECT *, {m('mi', '1440.0::DOUBLE')} / 4 - 180 AS ha FROM s4),
  s6 AS (SELECT *, least(greatest(sin(radians({lat})) * sin(de) + cos(radians({lat})) * cos(de) * cos(radians(ha)), -1), 1) AS cz FROM s5),
  s7 AS (SELECT *, degrees(acos(least(greatest((sin(radians({lat})) * cz - sin(de)) / (cos(radians({lat})) * sin(acos(cz))), -1), 1))) AS arc FROM s6),
  sun AS (SELECT {keys}, CASE WHEN ha > 0 THEN {m('(arc + 180)', '360.0::DOUBLE')} ELSE {m('(540 - arc)', '360.0::DOUBLE')} END AS az, 90 - degrees(acos(cz)) AS alt FROM s7)"""


@register("solar_positions", oracle("fx_points", body=_LL + ", " + _sun("t", "lat", "lon", "ll", "event_id") + " SELECT event_id, round(az, 5) AS azimuth, round(alt, 5) AS altitude FROM sun"))
def solar_positions(spark, d):
    s = S.with_position(_lonlat(spark, d), "t", "lat", "lon")
    return s.select("event_id", F.round("sun_az", 5).alias("azimuth"), F.round("sun_alt", 5).alias("altitude"))


_EDGE = """bx AS (SELECT n_nationkey AS k, -123.9::DOUBLE + n_nationkey * 0.05::DOUBLE AS w, 36.0::DOUBLE + n_nationkey * 0.4::DOUBLE AS s, -123.9::DOUBLE + n_nationkey * 0.05::DOUBLE + (1 + n_nationkey % 5) * 0.3::DOUBLE AS e, 36.0::DOUBLE + n_nationkey * 0.4::DOUBLE + (n_nationkey % 4) * 0.25::DOUBLE AS n FROM nation),
  ed AS (SELECT k, unnest([1, 2, 3, 4]) AS side, w, s, e, n FROM bx),
  ll AS (SELECT k * 1000 + side * 100 + i AS event_id, 0 AS t, CASE side WHEN 3 THEN w WHEN 4 THEN e ELSE w + (e - w) * i / 40 END AS lon, CASE side WHEN 1 THEN s WHEN 2 THEN n ELSE s + (n - s) * i / 40 END AS lat FROM ed, (SELECT unnest(range(0, 41)) AS i))"""


@register(
    "target_grid",
    f"""WITH {_EDGE}, {_series().replace("SELECT event_id, round(", ", gx AS (SELECT event_id, round(", 1)}),
  sp AS (SELECT event_id // 1000 AS k, min(x) + 500 AS lx, max(x) - 500 AS hx, min(y) + 500 AS ly, max(y) - 500 AS hy FROM gx GROUP BY 1),
  sn AS (SELECT k, round_even(lx / 10, 0) * 10 AS x0, round_even(ly / 10, 0) * 10 AS y0, hx, hy FROM sp)
  SELECT k, x0, y0, CAST(greatest(0, floor((hx - x0) / 10)) AS BIGINT) AS cols, CAST(greatest(0, floor((hy - y0) / 10)) AS BIGINT) AS rows FROM sn""",
)
def target_grid(spark, d):
    k = F.col("n_nationkey")
    w, s = -123.9 + k * 0.05, 36.0 + k * 0.4
    boxes = fx.table(spark, d, "nation").select(k.alias("k"), w.alias("w"), s.alias("s"), (w + (1 + k % 5) * 0.3).alias("e"), (s + (k % 4) * 0.25).alias("n"))
    return G.target_grid(boxes, "k", 10, 10.0).select(F.col("k").cast("long").alias("k"), "x0", "y0", "cols", "rows")


@register(
    "golden_hour",
    oracle(
        "fx_users",
        body="""f AS (SELECT track_id, min(event_id) AS e, min(t) AS t FROM fx_users GROUP BY track_id),
  pl AS (SELECT track_id, 30.0::DOUBLE + (e % 2500) / 100.0::DOUBLE AS lat, -123.0::DOUBLE + (e % 600) / 100.0::DOUBLE AS lon, floor(t / 86400) * 86400 - (-123.0::DOUBLE + (e % 600) / 100.0::DOUBLE) * 240 AS start FROM f),
  mi AS (SELECT track_id, lat, lon, minute, start + minute * 60 AS tt FROM pl, (SELECT unnest(range(0, 1441)) AS minute)), """ + _sun("tt", "lat", "lon", "mi", "track_id, minute, tt") + """,
  pr AS (SELECT *, lag(alt) OVER (PARTITION BY track_id ORDER BY minute) AS before FROM sun)
  SELECT track_id, round(coalesce(min(tt) FILTER (minute > 60 AND before >= 12 AND alt < 12), first(tt ORDER BY alt DESC, minute)), 3) AS golden_t FROM pr GROUP BY track_id""",
    ),
)
def golden_hour(spark, d):
    """Where and on the day that each recording began."""
    first = fx.points(spark, d, by_user=True).groupBy("track_id").agg(F.min("event_id").alias("e"), F.min("t").alias("t"))
    places = first.select("track_id", (30.0 + (F.col("e") % 2500) / 100.0).alias("lat"), (-123.0 + (F.col("e") % 600) / 100.0).alias("lon"), (F.floor(F.col("t") / 86400) * 86400.0).alias("midnight"))
    return S.golden_hour(places, "track_id", "midnight", "lat", "lon").withColumn("golden_t", F.round("golden_t", 3))


@register(
    "sun_schedule",
    oracle("fx_users", body="""an AS (SELECT track_id, min(t) AS a, max(t) AS b, 40.5::DOUBLE AS lat, -121.5::DOUBLE AS lon FROM fx_users GROUP BY track_id),
  fr AS (SELECT track_id, lat, lon, frame, a + frame / 11.0::DOUBLE * (CASE WHEN b <= a THEN a + 3600 ELSE b END - a) AS tt FROM an, (SELECT CAST(unnest(range(0, 12)) AS INTEGER) AS frame)), """ + _sun("tt", "lat", "lon", "fr", "track_id, frame") + """
  SELECT track_id, frame, round(az, 4) AS azimuth, round(least(greatest(alt, 8), 80), 4) AS altitude FROM sun"""),
)
def sun_schedule(spark, d):
    a = fx.points(spark, d, by_user=True).groupBy("track_id").agg(F.min("t").alias("a"), F.max("t").alias("b")).withColumns({"lat": F.lit(40.5), "lon": F.lit(-121.5)})
    return S.diurnal_schedule(a, "track_id", "a", "b", "lat", "lon", 12).select("track_id", "frame", F.round("azimuth", 4).alias("azimuth"), F.round("altitude", 4).alias("altitude"))


@register(
    "seasonal_days",
    oracle("fx_users", body="""ds AS (SELECT track_id, list_sort(list(DISTINCT day)) AS days FROM fx_users WHERE day IS NOT NULL GROUP BY track_id), ks AS (SELECT CAST(unnest(range(0, 12)) AS INTEGER) AS frame)
  SELECT track_id, frame, days[CAST(round_even(frame / 11.0::DOUBLE * (len(days) - 1), 0) AS INTEGER) + 1] AS day FROM ds, ks"""),
)
def seasonal_days(spark, d):
    days = fx.points(spark, d, by_user=True).where("day IS NOT NULL").groupBy("track_id").agg(F.sort_array(F.collect_set("day")).alias("days"))
    return days.select("track_id", F.explode(S.seasonal_days(F.col("days"), 12)).alias("f")).select("track_id", "f.frame", "f.day")


@register("local_hours", oracle("fx_points", body=_LL + " SELECT event_id, round(((t + lon * 240) - floor((t + lon * 240) / 86400) * 86400) / 3600, 4) AS hour, round(t / 86400 + 2440587.5::DOUBLE + 1e-8::DOUBLE, 4) AS jd FROM ll"))
def local_hours(spark, d):
    return _lonlat(spark, d).select("event_id", F.round(S.local_hour(F.col("t"), F.col("lon")), 4).alias("hour"), F.round(S.julian_day(F.col("t")) + 1e-8, 4).alias("jd"))


@register(
    "journey_light",
    oracle(
        "fx_users",
        body="""an AS (SELECT track_id, CAST(track_id AS INTEGER) AS u, max(t) AS tt, arg_max(t, ele * 1e7::DOUBLE - vidx) AS st, 30.0::DOUBLE + CAST(track_id AS INTEGER) % 25 AS lat, -123.0::DOUBLE + CAST(track_id AS INTEGER) % 6 AS lon FROM fx_users GROUP BY track_id),
  da AS (SELECT *, CASE WHEN u % 4 > 0 THEN floor(tt / 86400.0::DOUBLE) * 86400 END AS midnight, CASE WHEN u % 3 = 0 THEN st END AS summit, CASE WHEN u % 5 = 0 THEN u % 24 + 0.25::DOUBLE END AS asked FROM an),
  mi AS (SELECT track_id, lat, lon, minute, midnight - lon * 240 + minute * 60 AS tm FROM da, (SELECT unnest(range(0, 1441)) AS minute) WHERE midnight IS NOT NULL), """
        + _sun("tm", "lat", "lon", "mi", "track_id, minute, tm").replace("sun AS", "day_sun AS")
        + """,
  pr AS (SELECT *, lag(alt) OVER (PARTITION BY track_id ORDER BY minute) AS before FROM day_sun),
  go AS (SELECT track_id, coalesce(min(tm) FILTER (minute > 60 AND before >= 12 AND alt < 12), first(tm ORDER BY alt DESC, minute)) AS golden FROM pr GROUP BY track_id),
  mo AS (SELECT track_id, lat, lon, CASE WHEN midnight IS NOT NULL THEN coalesce(midnight + asked * 3600 - lon * 240, summit, golden) END AS tx FROM da LEFT JOIN go USING (track_id)), """
        + re.sub(r"\bs(\d)\b", r"z\1", _sun("tx", "lat", "lon", "mo", "track_id, lon, tx"))
        + """
  SELECT track_id, tx IS NOT NULL AS available, CASE WHEN tx IS NOT NULL THEN round(az, 4) END AS azimuth, CASE WHEN tx IS NOT NULL THEN round(least(greatest(alt, 8), 80), 4) END AS altitude,
    CASE WHEN tx IS NOT NULL THEN round(floor((tx + lon * 240) - floor((tx + lon * 240) / 86400) * 86400) / 3600, 3) END AS hour FROM sun""",
    ),
)
def journey_light(spark, d):
    """Each recording: a quarter without times, a third with a highest point, a fifth at an hour that is asked for, the rest at the golden hour of its last day."""
    u = F.col("track_id").cast("int")
    a = fx.points(spark, d, by_user=True).groupBy("track_id").agg(F.max("t").alias("t"), F.max_by("t", F.col("ele") * 1e7 - F.col("vidx")).alias("st"))
    a = a.select("track_id", F.when(u % 4 > 0, F.date_format(F.timestamp_seconds("t"), "yyyy-MM-dd")).alias("last_day"), F.when(u % 3 == 0, F.col("st")).alias("summit_t"), (30.0 + u % 25).alias("lat"), (-123.0 + u % 6).alias("lon"))
    done = S.journey_light(a, "track_id", F.when(u % 5 == 0, u % 24 + 0.25))
    return done.select("track_id", "available", F.round("azimuth", 4).alias("azimuth"), F.round("altitude", 4).alias("altitude"), "hour")


@register(
    "sun_vectors",
    """SELECT o_orderkey AS k, round(sin(radians(a)) * cos(radians(e)), 6) + 0.0::DOUBLE AS x, round(cos(radians(a)) * cos(radians(e)), 6) + 0.0::DOUBLE AS y, round(sin(radians(e)), 6) AS z, round(3.0::DOUBLE * sin(6.283185307179586::DOUBLE * (o_orderkey % 100) / 100), 6) + 0.0::DOUBLE AS yaw, round(111320.0::DOUBLE * cos(radians(e)), 3) AS m_per_deg
  FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderkey % 360 AS DOUBLE) ELSE 315.0::DOUBLE END AS a, CASE WHEN o_orderkey % 2 = 0 THEN CAST(8 + o_orderkey % 70 AS DOUBLE) ELSE 45.0::DOUBLE END AS e FROM orders)""",
)
def sun_vectors(spark, d):
    k = F.col("o_orderkey")
    sun = S.light(F.when(k % 2 == 0, "journey").otherwise("archival"), k % 360, 8 + k % 70, F.lit(None).cast("double"), F.lit(None).cast("double"))
    o = fx.table(spark, d, "orders").select(k.alias("k"), sun.alias("s")).withColumn("v", S.towards(F.col("s.azimuth"), F.col("s.altitude")))
    r = lambda c: F.round(c, 6) + 0.0
    return o.select("k", r("v.x").alias("x"), r("v.y").alias("y"), F.round("v.z", 6).alias("z"), r(S.yaw(F.col("k") % 100, 3.0, 100)).alias("yaw"), F.round(S.metres_a_degree(F.col("s.altitude")), 3).alias("m_per_deg"))
