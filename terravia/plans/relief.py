"""Queries on relief colour."""

from pyspark.sql import functions as F

from terravia import fixtures as fx
from terravia.catalog import register
from terravia.fixtures import oracle
from terravia.operators import raster as R
from terravia.operators import relief as E
from terravia.operators.polygons import mask

_U = lambda x: f"least(greatest({x}, 0), 1)"
_NORM = f"nm AS (SELECT row, col, v, {_U('(v + 30000.0::DOUBLE) / (60000.0::DOUBLE + 1e-9::DOUBLE)')} AS norm FROM fx_filled)"


def _ramp(k):
    out = f"{float(E.HEIGHT_STOPS[-1][1][k])}::DOUBLE"
    for (a, ca), (b, cb) in reversed(list(zip(E.HEIGHT_STOPS, E.HEIGHT_STOPS[1:], strict=False))):
        out = f"CASE WHEN norm <= {b}::DOUBLE THEN {ca[k]} + {cb[k] - ca[k]} * ((norm - {a}::DOUBLE) / {b - a}::DOUBLE) ELSE {out} END"
    return f"(({out}) * 0.94::DOUBLE + {E.PAPER[k]} * 0.06::DOUBLE) / 255.0::DOUBLE"


_BASE = _NORM + f", bc AS (SELECT row, col, norm, {', '.join(f'{_ramp(k)} AS {c}' for k, c in enumerate('rgb'))} FROM nm)"


def _rounded(df):
    return df.select("row", "col", *(F.round(F.col(c) + 1e-9, 5).alias(c) for c in "rgb"))


_OUT = "SELECT row, col, " + ", ".join(f"round({c} + 1e-9::DOUBLE, 5) AS {c}" for c in "rgb")


def _base(spark, d):
    return E.base_colour(fx.filled_raster(spark, d), -30000.0, 30000.0)


@register("base_colour", oracle("fx_filled", body=f"{_BASE} {_OUT} FROM bc"))
def base_colour(spark, d):
    return _rounded(_base(spark, d))


_TINT = (0.2, 0.7, 0.4)


@register(
    "cover_tint",
    oracle("fx_filled", body=f"""{_BASE}, w AS (SELECT *, CASE WHEN row % 3 = 0 THEN 0.8::DOUBLE ELSE 0 END * 0.55::DOUBLE * {_U('(0.88::DOUBLE - norm) / 0.18::DOUBLE')} AS w, ((r + g + b) / 3) / ((0.2::DOUBLE + 0.7::DOUBLE + 0.4::DOUBLE) / 3 + 1e-6::DOUBLE) AS l FROM bc),
  m AS (SELECT row, col, {', '.join(f'{c} * (1 - w) + least(greatest({t}::DOUBLE * l, 0), 1) * w AS {c}' for c, t in zip('rgb', _TINT, strict=True))} FROM w) {_OUT} FROM m"""),
)
def cover_tint(spark, d):
    tint = F.struct(*(F.lit(t).alias(c) for c, t in zip("rgb", _TINT, strict=True)))
    cells = fx.filled_raster(spark, d).withColumns({"tint": tint, "weight": F.when(F.col("row") % 3 == 0, 0.8).otherwise(0.0)})
    return _rounded(E.base_colour(cells, -30000.0, 30000.0, cover=True))


def _towards(source, colour, weight):
    return f"SELECT row, col, norm, {', '.join(f'{c} * (1 - {weight}) + {colour[k]} / 255.0::DOUBLE * {weight} AS {c}' for k, c in enumerate('rgb'))} FROM {source}"


@register("haze", oracle("fx_filled", body=f"{_BASE}, hz AS ({_towards('bc', E.HAZE, '(0.30::DOUBLE * 0.5::DOUBLE * pow(1 - norm, 1.5::DOUBLE))')}) {_OUT} FROM hz"))
def haze(spark, d):
    return _rounded(E.haze(_base(spark, d), 0.5))


@register(
    "tonal_finish",
    oracle("fx_filled", body=f"""{_BASE}, cv AS (SELECT row, col, {', '.join(f'{c} * 0.7::DOUBLE + {c} * {c} * (3 - 2 * {c}) * 0.3::DOUBLE AS {c}' for c in 'rgb')} FROM bc),
  y AS (SELECT *, 0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b AS y FROM cv), ft AS (SELECT row, col, {', '.join(f'least(greatest(({c} - y) * 1.2::DOUBLE + y, 0), 1) AS {c}' for c in 'rgb')} FROM y) {_OUT} FROM ft"""),
)
def tonal_finish(spark, d):
    return _rounded(E.finish(_base(spark, d)))


@register(
    "salt_atmosphere",
    oracle("fx_filled", body=f"""{_BASE}, a1 AS ({_towards('bc', E.HAZE, '(0.18::DOUBLE * pow(1 - norm, 1.5::DOUBLE))')}),
  tx AS (SELECT *, (row + col) % 11 / 10.0::DOUBLE AS t FROM a1), sw AS (SELECT *, 0.55::DOUBLE * {_U('(0.16::DOUBLE - norm) / 0.16::DOUBLE')} * {_U('1 - abs(t - 0.5::DOUBLE) * 4')} AS w FROM tx), a2 AS ({_towards('sw', E.SALT, 'w')}) {_OUT} FROM a2"""),
)
def salt_atmosphere(spark, d):
    return _rounded(E.atmosphere(_base(spark, d).withColumn("texture", (F.col("row") + F.col("col")) % 11 / 10.0), 1.0))


@register("luminance", oracle("fx_filled", body="SELECT row, col, round((0.2126::DOUBLE * (row % 256) + 0.7152::DOUBLE * col + 0.0722::DOUBLE * 9) / 255.0::DOUBLE, 6) AS y FROM fx_filled"))
def luminance(spark, d):
    return fx.filled_raster(spark, d).select("row", "col", F.round(E.luminance(F.col("row") % 256, F.col("col"), F.lit(9)), 6).alias("y"))


def _gauss(sigma, source, into):
    reach = max(1, round(3 * sigma))
    w = {k: 2.718281828459045 ** (-0.5 * (k / sigma) ** 2) for k in range(-reach, reach + 1)}
    t = lambda c, o: " + ".join(f"coalesce({'lag' if k >= 0 else 'lead'}({c}, {abs(k)}) OVER {o}, 0) * {w[k]!r}::DOUBLE" for k in w)
    over = "WINDOW r AS (PARTITION BY row ORDER BY col), c AS (PARTITION BY col ORDER BY row)"
    return f"""{into}0 AS (SELECT *, 1.0::DOUBLE AS d FROM {source}), {into}1 AS (SELECT *, {t('v', 'r')} AS n1, {t('d', 'r')} AS d1 FROM {into}0 {over}), {into} AS (SELECT row, col, v, v - ({t('n1', 'c')}) / ({t('d1', 'c')}) AS h FROM {into}1 {over})"""


@register(
    "multiscale_texture",
    oracle("fx_filled", body=", ".join(_gauss(0.5 * m, "fx_filled", f"g{k}") for k, (m, _) in enumerate(E.OCTAVES)) + ", sd AS (SELECT " + ", ".join(f"(SELECT stddev_pop(h) + 1e-9::DOUBLE FROM g{k}) AS s{k}" for k in range(3)) + """)
  SELECT g0.row, g0.col, round(""" + " + ".join(f"{w}::DOUBLE * {_U(f'0.5::DOUBLE + g{k}.h / (4 * s{k})')}" for k, (_, w) in enumerate(E.OCTAVES)) + """ + 1e-9::DOUBLE, 5) AS texture FROM g0 JOIN g1 USING (row, col) JOIN g2 USING (row, col), sd"""),
)
def multiscale_texture(spark, d):
    return E.multiscale_texture(fx.filled_raster(spark, d), 0.5).select("row", "col", F.round(F.col("texture") + 1e-9, 5).alias("texture"))


@register(
    "lake_depth",
    oracle("fx_filled", body="""w AS (SELECT row, col FROM fx_filled WHERE (row // 6 + col // 6) % 5 = 0), s AS (SELECT row AS r, col AS c FROM fx_filled WHERE (row // 6 + col // 6) % 5 <> 0),
  d AS (SELECT row, col, min((row - r) * (row - r) + (col - c) * (col - c)) AS d2 FROM w JOIN s ON r BETWEEN row - 12 AND row + 12 AND c BETWEEN col - 12 AND col + 12 GROUP BY row, col)
  SELECT row, col, round(pow(least(1, sqrt(d2) * 200 / 900.0::DOUBLE), 0.75::DOUBLE), 6) AS depth FROM d"""),
)
def lake_depth(spark, d):
    water = (F.floor(F.col("row") / 6) + F.floor(F.col("col") / 6)) % 5 == 0
    return E.lake_depth(fx.filled_raster(spark, d).withColumn("water", water), 200.0).withColumn("depth", F.round("depth", 6))


#: Each cell's middle against each edge: an odd number of crossings to its left is inside.
_WATER = """e AS (SELECT poly, x, y, coalesce(lead(x) OVER w, first(x) OVER w) AS x1, coalesce(lead(y) OVER w, first(y) OVER w) AS y1 FROM fx_lakes
    WINDOW w AS (PARTITION BY poly, ring ORDER BY vidx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
  u AS (SELECT poly, least(y, y1) AS ya, greatest(y, y1) AS yb, CASE WHEN y < y1 THEN x ELSE x1 END AS xa, CASE WHEN y < y1 THEN x1 ELSE x END AS xb FROM e WHERE y <> y1),
  inside AS (SELECT row, col, poly FROM fx_raster JOIN u ON row + 0.5 >= ya AND row + 0.5 < yb WHERE xa + (row + 0.5::DOUBLE - ya) * (xb - xa) / (yb - ya) <= col + 0.5 GROUP BY row, col, poly HAVING count(*) % 2 = 1),
  w AS (SELECT DISTINCT row, col FROM inside)"""


@register("lake_mask", oracle("fx_raster", "fx_lakes", body=_WATER + " SELECT row, col, (row, col) IN (SELECT (row, col) FROM w) AS water FROM fx_raster"))
def lake_mask(spark, d):
    return mask(fx.raster(spark, d), fx.lakes(spark, d)).select("row", "col", "water")


@register(
    "lake_depth_of_rings",
    oracle("fx_raster", "fx_lakes", body=_WATER + """, s AS (SELECT row AS r, col AS c FROM fx_raster WHERE (row, col) NOT IN (SELECT (row, col) FROM w)),
  d AS (SELECT row, col, min((row - r) * (row - r) + (col - c) * (col - c)) AS d2 FROM w JOIN s ON r BETWEEN row - 40 AND row + 40 GROUP BY row, col)
  SELECT row, col, round(pow(least(1, sqrt(d2) * 200 / 900.0::DOUBLE), 0.75::DOUBLE), 6) AS depth FROM d"""),
)
def lake_depth_of_rings(spark, d):
    return E.lakes(fx.raster(spark, d), fx.lakes(spark, d), 200.0).withColumn("depth", F.round("depth", 6))


_LIFT = """wn AS (SELECT target, col, max(row) AS winner FROM (SELECT row, col, unnest(range(lo, hi + 1)) AS target FROM (SELECT *, greatest(lo, coalesce(lead(lo) OVER (PARTITION BY col ORDER BY row), lo + 1) - 1) AS hi FROM (SELECT row, col, CAST(round_even(row - 0.0005::DOUBLE * v, 0) AS BIGINT) AS lo FROM fx_filled))) GROUP BY target, col)"""


@register(
    "draped_ink",
    oracle("fx_filled", body=_LIFT + """, ink AS (SELECT row, col, 1 + (row + col) % 3 AS covered FROM fx_filled WHERE (row * 7 + col) % 13 = 0), sh AS (SELECT row, col, CAST(round_even(row - 0.0005::DOUBLE * v, 0) AS BIGINT) AS target FROM fx_filled),
  a AS (SELECT target, wn.col, CAST(covered AS DOUBLE) AS ink FROM wn JOIN ink ON ink.row = winner AND ink.col = wn.col UNION ALL
   SELECT sh.target, ink.col, covered * 0.25::DOUBLE FROM ink JOIN sh ON sh.row = ink.row AND sh.col = ink.col JOIN wn ON wn.target = sh.target AND wn.col = sh.col WHERE winner > ink.row + 2)
  SELECT target, col, max(ink) AS ink FROM a GROUP BY target, col"""),
)
def draped_ink(spark, d):
    cells = fx.filled_raster(spark, d)
    visits = F.explode(F.sequence(F.lit(0).cast("long"), (F.col("row") + F.col("col")) % 3))
    crossed = cells.where((F.col("row") * 7 + F.col("col")) % 13 == 0).withColumn("journey", visits)
    ink = E.coverage(crossed.unionByName(crossed).select("journey", "row", "col"))
    shown = cells.select("row", "col", F.rint(F.col("row") - 0.0005 * F.col("v")).cast("long").alias("target"))
    return E.draped(ink, R.painter(cells, 0.0005), shown, 2)


@register(
    "lifted_points",
    oracle("fx_filled", body=_LIFT + """, sr AS (SELECT 12.0::DOUBLE / (max(v) - min(v)) AS s, min(v) AS f FROM fx_filled),
  p AS (SELECT row * 64 + col AS id, row, col, row - least(s * greatest(v - f, 0), 12.0::DOUBLE) AS up FROM fx_filled, sr WHERE (row + col) % 17 = 0)
  SELECT id, round(up, 4) AS shown_py, coalesce(winner > row + 3, false) AS occluded FROM p LEFT JOIN wn ON wn.target = CAST(round_even(up, 0) AS BIGINT) AND wn.col = p.col"""),
)
def lifted_points(spark, d):
    cells = fx.filled_raster(spark, d)
    one = E.shear_of(cells, 12.0).first()
    p = cells.where((F.col("row") + F.col("col")) % 17 == 0).select((F.col("row") * 64 + F.col("col")).alias("id"), F.col("col").cast("double").alias("px"), F.col("row").cast("double").alias("py"))
    shown = E.lifted(p, cells, one["shear"], one["floor"], 12.0)
    return shown.join(E.occluded(shown, R.painter(cells, 0.0005), 3), "id").select("id", F.round("shown_py", 4).alias("shown_py"), "occluded")


@register("shaded_relief")
def shaded_relief(spark, d):
    return E.shaded_relief(
        fx.raster(spark, d), 5000.0, -30000.0, 30000.0, depth=0.6, shadow=0.8, sun=(250.0, 30.0), golden=0.5, soft=0.35, haze_knob=0.2, radius=2.0, valley_radius=6.0, work_res_m=10000.0
    )


@register(
    "height_field",
    oracle("fx_raster", body=f"""l AS (SELECT row, col, (0.2126::DOUBLE * (row * 7 % 256) + 0.7152::DOUBLE * (col * 4) + 0.0722::DOUBLE * ((row + col) % 200)) / 255.0::DOUBLE AS l FROM fx_raster),
  p AS (SELECT quantile_cont(l, {E.LUMINANCE_SHARES[0]}::DOUBLE) AS a, quantile_cont(l, {E.LUMINANCE_SHARES[1]}::DOUBLE) AS b FROM l)
  SELECT row, col, round(least(greatest((l - a) / greatest(b - a, 1e-6::DOUBLE), 0), 1), 6) AS height FROM l, p"""),
)
def height_field(spark, d):
    cells = fx.raster(spark, d).select("row", "col", (F.col("row") * 7 % 256).alias("r"), (F.col("col") * 4).alias("g"), ((F.col("row") + F.col("col")) % 200).alias("b"))
    return E.height_field(cells).select("row", "col", F.round("height", 6).alias("height"))


_CLASSES = {1: (120, 140, 90), 2: (60, 90, 70), 4: (200, 180, 140)}
_KERNEL = [2.718281828459045 ** (-0.5 * (k / 1.2) ** 2) for k in range(5)]


def _blur(value: str, source: str, axis: str, into: str) -> str:
    """One pass of the kernel along an axis, over the cells that are there."""
    w = " + ".join(f"coalesce(lag({value}, {k}) OVER w * {_KERNEL[k]!r}::DOUBLE, 0) + coalesce(lead({value}, {k}) OVER w * {_KERNEL[k]!r}::DOUBLE, 0)" for k in range(1, 5))
    n = " + ".join(f"(CASE WHEN lag(1, {k}) OVER w IS NULL THEN 0 ELSE {_KERNEL[k]!r}::DOUBLE END) + (CASE WHEN lead(1, {k}) OVER w IS NULL THEN 0 ELSE {_KERNEL[k]!r}::DOUBLE END)" for k in range(1, 5))
    part, order = ("row", "col") if axis == "row" else ("col", "row")
    return f"({value} + {w}) / (1.0::DOUBLE + {n}) AS {into}"


_TINTED = " ".join(f"WHEN {c} THEN [{', '.join(f'{v}.0::DOUBLE' for v in rgb)}]" for c, rgb in _CLASSES.items())


@register(
    "blurred_cover",
    oracle("fx_raster", body=f"""c AS (SELECT row, col, CASE (row // 5 + col // 7) % 6 {_TINTED} END AS t FROM fx_raster),
  p AS (SELECT row, col, coalesce(t[1], 0.0::DOUBLE) AS r, coalesce(t[2], 0.0::DOUBLE) AS g, coalesce(t[3], 0.0::DOUBLE) AS b, CASE WHEN t IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS w0 FROM c),
  x AS (SELECT row, col, {', '.join(_blur(v, 'p', 'row', f'{v}x') for v in ('r', 'g', 'b', 'w0'))} FROM p WINDOW w AS (PARTITION BY row ORDER BY col)),
  y AS (SELECT row, col, {', '.join(_blur(f'{v}x', 'x', 'col', f'{v}y') for v in ('r', 'g', 'b', 'w0'))} FROM x WINDOW w AS (PARTITION BY col ORDER BY row))
  SELECT row, col, round(ry / (w0y + 1e-6::DOUBLE), 5) AS r, round(gy / (w0y + 1e-6::DOUBLE), 5) AS g, round(by_ / (w0y + 1e-6::DOUBLE), 5) AS b, round(w0y, 6) AS weight FROM y""".replace("AS by,", "AS by_,")),
)
def blurred_cover(spark, d):
    code = (F.floor(F.col("row") / 5) + F.floor(F.col("col") / 7)) % 6
    tinted = R.class_tint(fx.raster(spark, d).select("row", "col", code.cast("int").alias("code")), _CLASSES)
    out = R.blurred_tint(tinted, 1.2)
    return out.select("row", "col", *(F.round(f"tint.{c}", 5).alias(c) for c in "rgb"), F.round("weight", 6).alias("weight"))


@register(
    "sheet_view",
    oracle("fx_raster", body="""px AS (SELECT r AS row, c AS col, 100 + (r + 0.5::DOUBLE) * 2.5::DOUBLE - 0.5::DOUBLE AS fr, 10 + (c + 0.5::DOUBLE) * 1.25::DOUBLE - 0.5::DOUBLE AS fc FROM (SELECT unnest(range(-2, 44)) AS r), (SELECT unnest(range(-2, 34)) AS c)),
  k AS (SELECT row, col, fr, fc, floor(fr) + a AS rr, floor(fc) + b AS cc FROM px, (SELECT unnest([0, 1]) AS a), (SELECT unnest([0, 1]) AS b)),
  m AS (SELECT k.row, k.col, sum((1 - abs(fr - rr)) * (1 - abs(fc - cc)) * v) / nullif(sum((1 - abs(fr - rr)) * (1 - abs(fc - cc))), 0) AS v FROM k JOIN fx_raster f ON f.row = rr AND f.col = cc WHERE v IS NOT NULL GROUP BY k.row, k.col)
  SELECT row, col, round(v + 1e-5::DOUBLE, 2) AS v FROM px LEFT JOIN m USING (row, col)"""),
)
def sheet_view(spark, d):
    """A crop of a hundred rows and forty columns at forty by thirty-two pixels, with its margin and two rows more to the south."""
    return E.view(fx.raster(spark, d), (100.0, 10.0, 200.0, 50.0), 32, 40, 0.05, 2).withColumn("v", F.round(F.col("v") + 1e-5, 2))


@register("finite_envelope")
def finite_envelope(spark, d):
    cells = fx.raster(spark, d)
    return E.finite_envelope(cells.withColumn("v", F.when((F.col("row") >= 7) & (F.col("col") < 60), F.coalesce("v", F.lit(0.0)))))


@register(
    "probe_grid",
    oracle("fx_raster", body="""g AS (SELECT i, j, CAST(floor(-20 + (i + 0.5::DOUBLE) * 5.0::DOUBLE) AS BIGINT) AS row, CAST(floor(3 + (j + 0.5::DOUBLE) * 1.25::DOUBLE) AS BIGINT) AS col FROM (SELECT unnest(range(0, 64)) AS i), (SELECT unnest(range(0, 64)) AS j))
  SELECT i, j, v FROM g LEFT JOIN fx_raster USING (row, col)"""),
)
def probe_grid(spark, d):
    return E.probe(fx.raster(spark, d), (-20.0, 3.0, 300.0, 83.0), 64)


@register("overview", oracle("fx_raster", body="""q AS (SELECT quantile_cont(v, 0.01) AS a, quantile_cont(v, 0.99) AS b FROM fx_raster)
  SELECT row, col, CAST(floor(least(greatest((coalesce(v, a) - a) / (b - a), 0), 1) * 255 + 1e-9::DOUBLE) AS INTEGER) AS grey FROM fx_raster, q"""))
def overview(spark, d):
    return E.overview(fx.raster(spark, d))
