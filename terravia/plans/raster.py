"""Queries on rasters."""

from pyspark.sql import functions as F

from terravia import fixtures as fx
from terravia.catalog import register
from terravia.fixtures import oracle
from terravia.operators import raster as R

RES = 100.0
_DIFF = """CASE WHEN lag({c}) OVER {w} IS NULL AND lead({c}) OVER {w} IS NULL THEN 0 WHEN lag({c}) OVER {w} IS NULL THEN lead({v}) OVER {w} - {v}
  WHEN lead({c}) OVER {w} IS NULL THEN {v} - lag({v}) OVER {w} ELSE (lead({v}) OVER {w} - lag({v}) OVER {w}) / 2 END"""
_W = "WINDOW r AS (PARTITION BY row ORDER BY col), c AS (PARTITION BY col ORDER BY row)"
GRAD = f"gr AS (SELECT *, {_DIFF.format(c='col', w='r', v='v')} AS dx, {_DIFF.format(c='row', w='c', v='v')} AS dy FROM fx_filled {_W})"
SLOPE = GRAD + ", sl AS (SELECT *, pi() / 2 - atan(sqrt(dx * dx / 10000.0::DOUBLE + dy * dy / 10000.0::DOUBLE)) AS slope, atan2(-dx / 100.0::DOUBLE, dy / 100.0::DOUBLE) AS aspect FROM gr)"


def _lambert(az, alt=45):
    return f"least(greatest(sin(radians({alt})) * sin(slope) + cos(radians({alt})) * cos(slope) * cos(radians({az}) - aspect), 0), 1)"


def _filled(spark, d):
    return fx.filled_raster(spark, d)


@register("slope_aspect", oracle("fx_filled", body=SLOPE + " SELECT row, col, round(slope, 6) AS slope, round(aspect, 6) AS aspect FROM sl"))
def slope_aspect(spark, d):
    return R.slope_aspect(_filled(spark, d), RES).select("row", "col", F.round("slope", 6).alias("slope"), F.round("aspect", 6).alias("aspect"))


@register("hillshade", oracle("fx_filled", body=SLOPE + f" SELECT row, col, round({_lambert(315)}, 6) AS shade FROM sl"))
def hillshade(spark, d):
    return R.hillshade(_filled(spark, d), RES).select("row", "col", F.round("shade", 6).alias("shade"))


_FIVE = " + ".join(f"{w}::DOUBLE * {_lambert(az)}" for az, w in ((315, 1), (270, 0.5), (360, 0.5), (225, 0.25), (405, 0.25)))


@register("multidir_hillshade", oracle("fx_filled", body=SLOPE + f" SELECT row, col, round(({_FIVE}) / 2.5::DOUBLE, 6) AS shade FROM sl"))
def multidir_hillshade(spark, d):
    return R.multidirectional(_filled(spark, d), RES).select("row", "col", F.round("shade", 6).alias("shade"))


@register(
    "cast_shadow_row",
    oracle("fx_filled", body="""ln AS (SELECT *, max(v + col * 1000.0::DOUBLE) OVER (PARTITION BY row ORDER BY col ROWS UNBOUNDED PRECEDING) - col * 1000.0::DOUBLE - v AS depth FROM fx_filled)
  SELECT row, col, round(depth, 3) + 0.0::DOUBLE AS depth, round(least(greatest(depth / 40.0::DOUBLE, 0), 1), 6) AS shadow FROM ln"""),
)
def cast_shadow_row(spark, d):
    return R.cast_shadow(_filled(spark, d), 1000.0, 270, 45.0).select("row", "col", (F.round("depth", 3) + 0.0).alias("depth"), F.round("shadow", 6).alias("shadow"))


@register(
    "cast_shadow_diagonal",
    oracle("fx_filled", body="""ln AS (SELECT *, max(v + col * 1000.0::DOUBLE * sqrt(2.0::DOUBLE)) OVER (PARTITION BY row - col ORDER BY col ROWS UNBOUNDED PRECEDING) - col * 1000.0::DOUBLE * sqrt(2.0::DOUBLE) - v AS depth FROM fx_filled)
  SELECT row, col, round(depth, 3) + 0.0::DOUBLE AS depth FROM ln"""),
)
def cast_shadow_diagonal(spark, d):
    return R.cast_shadow(_filled(spark, d), 1000.0, 315, 45.0).select("row", "col", (F.round("depth", 3) + 0.0).alias("depth"))


@register(
    "painter_winner",
    oracle("fx_filled", body="""lo AS (SELECT row, col, CAST(round_even(row - 0.0001::DOUBLE * v, 0) AS BIGINT) AS lo FROM fx_filled),
  sp AS (SELECT *, greatest(lo, coalesce(lead(lo) OVER (PARTITION BY col ORDER BY row), lo + 1) - 1) AS hi FROM lo)
  SELECT target, col, max(row) AS winner FROM (SELECT row, col, unnest(range(lo, hi + 1)) AS target FROM sp) GROUP BY target, col"""),
)
def painter_winner(spark, d):
    return R.painter(_filled(spark, d), 0.0001)


@register(
    "contour_levels",
    oracle("fx_filled", body=f"""u AS (SELECT row, col, v / 2500.0::DOUBLE AS v FROM fx_filled), g AS (SELECT *, {_DIFF.format(c='col', w='r', v='v')} AS dx, {_DIFF.format(c='row', w='c', v='v')} AS dy FROM u {_W})
  SELECT row, col, CAST(round_even(v, 0) AS BIGINT) AS level, round(CASE WHEN sqrt(dx * dx + dy * dy) > 1e-6::DOUBLE THEN abs(v - round_even(v, 0)) / sqrt(dx * dx + dy * dy) END, 6) AS dist, CAST(round_even(v, 0) AS BIGINT) % 5 = 0 AS index_line FROM g"""),
)
def contour_levels(spark, d):
    return R.contours(_filled(spark, d), 2500.0).withColumn("dist", F.round("dist", 6))


@register(
    "contour_interval",
    """SELECT o_orderkey, coalesce((SELECT min(iv) FROM (SELECT unnest([5, 10, 20, 25, 50, 100, 200, 250, 500, 1000]) AS iv) WHERE iv >= 0.02::DOUBLE * (o_orderkey % 3000) AND o_totalprice / 100 / iv <= 40), 2000) AS iv FROM orders""",
)
def contour_interval(spark, d):
    return fx.table(spark, d, "orders").select("o_orderkey", R.contour_interval(F.col("o_totalprice") / 100, F.col("o_orderkey") % 3000).alias("iv"))


@register("elevation_percentiles", oracle("fx_raster", body="SELECT round(quantile_cont(v, 0.005), 4) AS p0, round(quantile_cont(v, 0.5), 4) AS p1, round(quantile_cont(v, 0.995), 4) AS p2 FROM fx_raster"))
def elevation_percentiles(spark, d):
    p = R.percentiles(fx.raster(spark, d), (0.005, 0.5, 0.995))
    return p.select(*(F.round(c, 4).alias(c) for c in p.columns))


_MEAN = """rs AS (SELECT *, sum(v) OVER r AS s, count(v) OVER r AS n FROM {t} WINDOW r AS (PARTITION BY row ORDER BY col ROWS BETWEEN {k} PRECEDING AND {k} FOLLOWING)),
 mn AS (SELECT row, col, v, sum(s) OVER c / sum(n) OVER c AS mean FROM rs WINDOW c AS (PARTITION BY col ORDER BY row ROWS BETWEEN {k} PRECEDING AND {k} FOLLOWING))"""


@register("valley_percentile", oracle("fx_filled", body=_MEAN.format(t="fx_filled", k=4) + " SELECT round(quantile_cont(greatest(mean - v, 0), 0.99), 3) AS p99, round(stddev_pop(v - mean), 3) AS texture_std FROM mn"))
def valley_percentile(spark, d):
    m = R.box_mean(_filled(spark, d), 4)
    deep = R.percentiles(m.select(F.greatest(F.col("mean") - F.col("v"), F.lit(0.0)).alias("v")), [0.99])
    spread = m.agg(F.round(F.stddev_pop(F.col("v") - F.col("mean")), 3).alias("texture_std"))
    return deep.select(F.round("p0", 3).alias("p99")).join(F.broadcast(spread))  # one row by one row


@register("box_mean", oracle("fx_raster", body=_MEAN.format(t="fx_raster", k=2) + " SELECT row, col, round(mean, 4) AS mean FROM mn"))
def box_mean(spark, d):
    return R.box_mean(fx.raster(spark, d), 2).select("row", "col", F.round("mean", 4).alias("mean"))


def _occlusion():
    views, last = [], "fx_filled"
    for k in (1, 4, 16):
        views.append(f"""a{k} AS (SELECT *, sum(v) OVER r AS s{k}, count(v) OVER r AS n{k} FROM {last} WINDOW r AS (PARTITION BY row ORDER BY col ROWS BETWEEN {k} PRECEDING AND {k} FOLLOWING)),
 b{k} AS (SELECT *, sum(s{k}) OVER c / sum(n{k}) OVER c AS m{k} FROM a{k} WINDOW c AS (PARTITION BY col ORDER BY row ROWS BETWEEN {k} PRECEDING AND {k} FOLLOWING))""")
        last = f"b{k}"
    total = " + ".join(f"{w}::DOUBLE * least(greatest((m{k} - v) / {k * 100000 * 0.15}::DOUBLE, 0), 1)" for k, w in ((1, 0.5), (4, 0.3), (16, 0.2)))
    return ", ".join(views) + f" SELECT row, col, round({total} + 1e-8::DOUBLE, 5) AS occlusion FROM {last}"


@register("sky_occlusion", oracle("fx_filled", body=_occlusion()))
def sky_occlusion(spark, d):
    return R.sky_occlusion(_filled(spark, d), 100000.0).select("row", "col", F.round(F.col("occlusion") + 1e-8, 5).alias("occlusion"))


def _gauss():
    w = {k: 2.718281828459045 ** (-0.5 * (k / 1.5) ** 2) for k in range(-4, 5)}
    t = lambda c, o: " + ".join(f"coalesce({'lag' if k >= 0 else 'lead'}({c}, {abs(k)}) OVER {o}, 0) * {w[k]!r}::DOUBLE" for k in w)
    return f"""a AS (SELECT row, col, coalesce(v, 0) AS n, CAST(v IS NOT NULL AS DOUBLE) AS d FROM fx_raster), b AS (SELECT row, col, {t('n', 'r')} AS n, {t('d', 'r')} AS d FROM a {_W}),
 e AS (SELECT row, col, {t('n', 'c')} AS n, {t('d', 'c')} AS d FROM b {_W}) SELECT row, col, round(CASE WHEN d > 0 THEN n / d END, 3) AS blurred FROM e"""


@register("gaussian_blur", oracle("fx_raster", body=_gauss()))
def gaussian_blur(spark, d):
    return R.gaussian(fx.raster(spark, d), 1.5).select("row", "col", F.round("blurred", 3).alias("blurred"))


@register(
    "nodata_fill",
    oracle("fx_raster", body="""m AS (SELECT row, col FROM fx_raster WHERE v IS NULL), g AS (SELECT row AS r, col AS c, v FROM fx_raster WHERE v IS NOT NULL)
  SELECT row, col, v + 0.0::DOUBLE AS filled FROM fx_raster WHERE v IS NOT NULL UNION ALL
  SELECT row, col, arg_min(v, ((row - r) * (row - r) + (col - c) * (col - c)) * 100000000 + r * 1000 + c) + 0.0::DOUBLE AS filled FROM m, g GROUP BY row, col"""),
)
def nodata_fill(spark, d):
    return R.fill_nodata(fx.raster(spark, d)).select("row", "col", (F.col("filled") + 0.0).alias("filled"))


@register("nodata_fraction", oracle("fx_raster", body="SELECT round(avg(CAST(v IS NULL AS INT)), 6) AS share, avg(CAST(v IS NULL AS INT)) > 0.01 AS refused FROM fx_raster"))
def nodata_fraction(spark, d):
    probe = fx.raster(spark, d)
    share = F.avg(F.col("v").isNull().cast("int"))
    return probe.agg(F.round(share, 6).alias("share"), (share > 0.01).alias("refused"))


STOPS = ((0.0, (70, 120, 176)), (0.5, (214, 158, 58)), (1.0, (188, 74, 60)))


@register(
    "ramp_interp",
    oracle("fx_raster", body="""u AS (SELECT row, col, least(greatest(coalesce((v + 30000) / 60000, 0), 0), 1) AS u FROM fx_raster)
  SELECT row, col, CAST(round_even(CASE WHEN u <= 0.5 THEN 70 + 144 * (u / 0.5::DOUBLE) ELSE 214 - 26 * ((u - 0.5::DOUBLE) / 0.5::DOUBLE) END, 0) AS INTEGER) AS r,
   CAST(round_even(CASE WHEN u <= 0.5 THEN 120 + 38 * (u / 0.5::DOUBLE) ELSE 158 - 84 * ((u - 0.5::DOUBLE) / 0.5::DOUBLE) END, 0) AS INTEGER) AS g,
   CAST(round_even(CASE WHEN u <= 0.5 THEN 176 - 118 * (u / 0.5::DOUBLE) ELSE 58 + 2 * ((u - 0.5::DOUBLE) / 0.5::DOUBLE) END, 0) AS INTEGER) AS b FROM u"""),
)
def ramp_interp(spark, d):
    return fx.raster(spark, d).select("row", "col", R.ramp((F.col("v") + 30000) / 60000, STOPS).alias("c")).select("row", "col", "c.*")


@register(
    "class_tint",
    oracle("fx_raster", body="""c AS (SELECT row, col, CAST(coalesce(v, 0) AS BIGINT) % 4 AS code FROM fx_raster)
  SELECT row, col, CASE code WHEN 1 THEN 10 WHEN 2 THEN 200 END AS r, CASE code WHEN 1 THEN 20 WHEN 2 THEN 190 END AS g, CASE code WHEN 1 THEN 30 WHEN 2 THEN 180 END AS b, CAST(code IN (1, 2) AS INTEGER) AS weight FROM c"""),
)
def class_tint(spark, d):
    cells = fx.raster(spark, d).withColumn("code", (F.coalesce("v", F.lit(0.0)).cast("long") % 4).cast("int"))
    return R.class_tint(cells, {1: (10, 20, 30), 2: (200, 190, 180)}).select("row", "col", "tint.r", "tint.g", "tint.b", "weight")


@register(
    "sample_points",
    oracle("fx_points", "fx_raster", body="""p AS (SELECT event_id, CAST(floor((4525010 - y) / 150) AS BIGINT) AS row, CAST(floor((x - 664030) / 900) AS BIGINT) AS col FROM fx_points)
  SELECT event_id, v FROM p LEFT JOIN fx_raster USING (row, col)"""),
)
def sample_points(spark, d):
    return R.sample_nearest(fx.points(spark, d), fx.raster(spark, d), (4525010 - F.col("y")) / 150, (F.col("x") - 664030) / 900).select("event_id", "v")


@register(
    "sample_bilinear",
    oracle("fx_points", "fx_raster", body="""p AS (SELECT event_id, (4525010 - y) / 160 AS fr, (x - 664030) / 1000 AS fc FROM fx_points),
  k AS (SELECT event_id, fr, fc, floor(fr) + a AS r, floor(fc) + b AS c FROM p, (SELECT unnest([0, 1]) AS a), (SELECT unnest([0, 1]) AS b)),
  m AS (SELECT event_id, (1 - abs(fr - r)) * (1 - abs(fc - c)) AS w, v FROM k JOIN fx_raster ON row = r AND col = c WHERE v IS NOT NULL)
  SELECT event_id, round(CASE WHEN sum(w) > 0 THEN sum(w * v) / sum(w) END + 1e-5::DOUBLE, 2) AS z FROM m GROUP BY event_id"""),
)
def sample_bilinear(spark, d):
    p = fx.points(spark, d).select("event_id", ((4525010 - F.col("y")) / 160).alias("fr"), ((F.col("x") - 664030) / 1000).alias("fc"))
    return R.sample_bilinear(p, fx.raster(spark, d), "event_id").withColumn("z", F.round(F.col("z") + 1e-5, 2))


@register("coarsen", oracle("fx_raster", body="SELECT row // 8 AS row, col // 8 AS col, round(avg(v), 4) AS v, count(v) AS n FROM fx_raster GROUP BY 1, 2"))
def coarsen(spark, d):
    return R.coarsen(fx.raster(spark, d), 8).withColumn("v", F.round("v", 4))


@register(
    "block_sum_best_window",
    oracle("fx_filled", body="""b AS (SELECT row // 8 AS br, col // 8 AS bc, sum(v) AS v FROM fx_filled GROUP BY 1, 2),
  w AS (SELECT a.br, a.bc, sum(b.v) AS t, count(*) AS n FROM b a JOIN b ON b.br BETWEEN a.br AND a.br + 3 AND b.bc BETWEEN a.bc AND a.bc + 2 GROUP BY a.br, a.bc)
  SELECT br AS block_row, bc AS block_col, t AS total FROM w WHERE n = 12 ORDER BY t DESC, br, bc LIMIT 1"""),
)
def block_sum_best_window(spark, d):
    return R.best_block_window(_filled(spark, d), 8, 4, 3)


@register("sparse_support", oracle("fx_raster", body="SELECT row, col, v FROM fx_raster WHERE v <> 0"))
def sparse_support(spark, d):
    return R.sparse(fx.raster(spark, d))


@register("cast_shadow_any", oracle("fx_filled", body="""ln AS (SELECT *, row - round_even(col * -0.57735026919::DOUBLE, 0) AS line FROM fx_filled),
  h AS (SELECT row, col, v, max(v + col * 1000.0::DOUBLE * sqrt(1 + 0.57735026919::DOUBLE * 0.57735026919::DOUBLE)) OVER (PARTITION BY line ORDER BY col ROWS UNBOUNDED PRECEDING) - col * 1000.0::DOUBLE * sqrt(1 + 0.57735026919::DOUBLE * 0.57735026919::DOUBLE) - v AS depth FROM ln)
  SELECT row, col, round(depth, 1) + 0.0::DOUBLE AS depth FROM h"""))
def cast_shadow_any(spark, d):
    """The sun stands in the west-south-west, thirty degrees off the grid."""
    return R.cast_shadow(_filled(spark, d), 1000.0, 240.0, 45.0).select("row", "col", (F.round("depth", 1) + 0.0).alias("depth"))


@register("order_statistics", oracle("fx_raster", body="""n AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS r FROM fx_raster WHERE v IS NOT NULL)
  SELECT r AS rank, v FROM n WHERE r IN (0, 1, 777, 5000, 5001)"""))
def order_statistics(spark, d):
    ranks = [0, 1, 777, 5000, 5001]
    values = R.order_statistics(fx.raster(spark, d).where("v IS NOT NULL").select("v"), ranks, 64)
    return spark.createDataFrame(list(zip(ranks, values, strict=True)), "rank long, v double")
