"""Queries on rasters as tiles."""

from pyspark.sql import functions as F

from terravia import fixtures as fx
from terravia.catalog import register
from terravia.fixtures import oracle
from terravia.operators import tiles as T
from terravia.plans.raster import RES, SLOPE, _lambert
from terravia.shared import discard, fresh_path, kept

SIZE, BLOCK = 32, 2
_KERNEL = [2.718281828459045 ** (-0.5 * (k / 1.2) ** 2) for k in range(5)]


def _pass(values: tuple[str, ...], axis: str) -> str:
    """Weighted sums along an axis of what is there."""
    one = lambda v: " + ".join([v, *(f"coalesce({f}({v}, {k}) OVER w, 0) * {_KERNEL[k]!r}::DOUBLE" for k in range(1, 5) for f in ("lag", "lead"))])
    part, order = ("row", "col") if axis == "row" else ("col", "row")
    return ", ".join(f"{one(v)} AS {v}" for v in values) + f" FROM {{}} WINDOW w AS (PARTITION BY {part} ORDER BY {order})"


_CHAIN = (
    "a AS (SELECT row, col, coalesce(v, 0.0::DOUBLE) AS n, CASE WHEN v IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS d FROM fx_raster), "
    f"b AS (SELECT row, col, {_pass(('n', 'd'), 'row').format('a')}), c AS (SELECT row, col, {_pass(('n', 'd'), 'col').format('b')}), "
    "e AS (SELECT row, col, sum(n / d) OVER w AS s, count(*) OVER w AS k FROM c WINDOW w AS (PARTITION BY row ORDER BY col ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)), "
    "fx_filled AS (SELECT row, col, sum(s) OVER w / sum(k) OVER w AS v FROM e WINDOW w AS (PARTITION BY col ORDER BY row ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)), "
)


@register("tiled_shade", oracle("fx_raster", body=_CHAIN + SLOPE + f" SELECT row, col, round({_lambert(315)}, 6) AS shade FROM sl"))
def tiled_shade(spark, d):
    """Blur, mean and light of the whole raster, in one exchange of strips."""
    cells = fx.raster(spark, d)
    bounds = T.bounds_of(cells)
    done = T.chain(T.to_tiles(cells, SIZE), bounds, [T.gaussian(1.2), T.box_mean(2), T.hillshade(RES)], SIZE)
    return T.to_cells(done, bounds, SIZE).select("row", "col", F.round("v", 6).alias("shade"))


@register(
    "terrain_window",
    oracle("fx_raster", body="""px AS (SELECT r AS row, c AS col, 100 + (r + 0.5::DOUBLE) * 2.5::DOUBLE - 0.5::DOUBLE AS fr, 30 + (c + 0.5::DOUBLE) * 1.25::DOUBLE - 0.5::DOUBLE AS fc FROM (SELECT unnest(range(-2, 44)) AS r), (SELECT unnest(range(-2, 34)) AS c)),
  k AS (SELECT row, col, fr, fc, floor(fr) + a AS rr, floor(fc) + b AS cc FROM px, (SELECT unnest([0, 1]) AS a), (SELECT unnest([0, 1]) AS b)),
  m AS (SELECT k.row, k.col, sum((1 - abs(fr - rr)) * (1 - abs(fc - cc)) * v) / nullif(sum((1 - abs(fr - rr)) * (1 - abs(fc - cc))), 0) AS v FROM k JOIN fx_raster f ON f.row = rr AND f.col = cc WHERE v IS NOT NULL GROUP BY k.row, k.col),
  s AS (SELECT row, col, v FROM px LEFT JOIN m USING (row, col)), g AS (SELECT row AS r, col AS c, v AS w FROM s WHERE v IS NOT NULL)
  SELECT row, col, round(arg_min(w, ((row - r) * (row - r) + (col - c) * (col - c)) * 100000000 + (r + 100) * 1000 + c) + 1e-5::DOUBLE, 2) AS v FROM s, g GROUP BY row, col"""),
)
def terrain_window(spark, d):
    """A crop that sticks out of the raster to the east, read from tiles on disk and repaired."""
    cells = fx.raster(spark, d)
    bounds, path = T.bounds_of(cells), fresh_path(spark, "tiles")
    T.write(T.to_tiles(cells, SIZE), path, BLOCK)
    out = kept(T.terrain_window(spark, path, bounds, (100.0, 30.0, 200.0, 70.0), 32, 40, 0.05, 2, SIZE, BLOCK))
    discard(path)
    return out.withColumn("v", F.round(F.col("v") + 1e-5, 2))
