"""Geodesy as column expressions: transverse Mercator, boxes, crops."""

from __future__ import annotations

from math import sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# WGS 84 and the Krüger series to the third order
A, FLATTENING, K0 = 6378137.0, 1 / 298.257223563, 0.9996
N = FLATTENING / (2 - FLATTENING)
RADIUS = A / (1 + N) * (1 + N**2 / 4 + N**4 / 64)
E = 2 * sqrt(N) / (1 + N)
ALPHA = (N / 2 - 2 * N**2 / 3 + 5 * N**3 / 16, 13 * N**2 / 48 - 3 * N**3 / 5, 61 * N**3 / 240)
BETA = (N / 2 - 2 * N**2 / 3 + 37 * N**3 / 96, N**2 / 48 + N**3 / 15, 17 * N**3 / 480)
DELTA = (2 * N - 2 * N**2 / 3 - 2 * N**3, 7 * N**2 / 3 - 8 * N**3 / 5, 56 * N**3 / 15)
M_PER_DEG = 111320.0


def zone_epsg(west: Column, east: Column) -> Column:
    """EPSG code of the northern UTM zone at the middle of a box."""
    return _zone_of(west + east)


def _zone_of(both: Column) -> Column:
    zone = F.floor((both / 2 + 180) / 6).cast("int") + 1
    return F.lit(32600) + F.greatest(F.lit(1), F.least(F.lit(60), zone))


def utm(lon: Column, lat: Column, zone: int) -> tuple[Column, Column]:
    """Easting and northing; null beyond 30 degrees from the zone's meridian."""
    off = lon - (6 * zone - 183)
    near = F.radians(F.when(F.abs(off) <= 30, off))  # null here makes both null; a choice around them would hide their common parts, to be worked out over and over
    phi = F.radians(lat)
    t = F.sinh(F.atanh(F.sin(phi)) - E * F.atanh(E * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(near)), F.atanh(F.sin(near) / F.sqrt(1 + t * t))
    x, y = eta, xi
    for j, a in enumerate(ALPHA, 1):
        x = x + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        y = y + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return 500000 + K0 * RADIUS * x, K0 * RADIUS * y


def lonlat(x: Column, y: Column, zone: int) -> tuple[Column, Column]:
    """Longitude and latitude of a UTM point."""
    xi, eta = y / (K0 * RADIUS), (x - 500000) / (K0 * RADIUS)
    u, v = xi, eta
    for j, b in enumerate(BETA, 1):
        u = u - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        v = v - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(u) / F.cosh(v))
    phi = chi
    for j, d in enumerate(DELTA, 1):
        phi = phi + d * F.sin(2 * j * chi)
    return F.degrees(F.atan2(F.sinh(v), F.cos(u))) + (6 * zone - 183), F.degrees(phi)


def to_pixels(x: Column, y: Column, box: tuple[Column, Column, Column, Column], width: Column | int, height: Column | int) -> tuple[Column, Column]:
    """Metres to pixels of a box; y grows southwards."""
    x0, y0, x1, y1 = box
    return (x - x0) / (x1 - x0) * width, (y1 - y) / (y1 - y0) * height


def from_pixels(px: Column, py: Column, box: tuple[Column, Column, Column, Column], width: Column | int, height: Column | int) -> tuple[Column, Column]:
    x0, y0, x1, y1 = box
    return x0 + px / width * (x1 - x0), y1 - py / height * (y1 - y0)


def sheet_pixels(x: Column, y: Column, crop: tuple[Column, Column, Column, Column], width: Column | int, height: Column | int, pad_x: Column | int = 0, pad_y: Column | int = 0) -> tuple[Column, Column]:
    """Metres to pixels of a sheet that shows the crop inside a margin: the crop's upper left corner is (pad_x, pad_y), and width and height are the crop's own, without the margin."""
    px, py = to_pixels(x, y, crop, width, height)
    return px + pad_x, py + pad_y


def padded_box(w: Column, s: Column, e: Column, n: Column, share: float = 0.20, least_m: float = 3000.0) -> tuple[Column, Column, Column, Column]:
    """A box grown on each side by a share of its span, a distance at least."""
    lon, lat = _padding(w, s, e, n, share, least_m)
    return w - lon, s - lat, e + lon, n + lat


def _padding(w: Column, s: Column, e: Column, n: Column, share: float, least_m: float) -> tuple[Column, Column]:
    squeeze = F.greatest(F.lit(0.2), F.cos(F.radians((s + n) / 2)))
    return F.greatest(share * (e - w), least_m / (M_PER_DEG * squeeze)), F.greatest(share * (n - s), F.lit(least_m / M_PER_DEG))


def padded_zone_epsg(w: Column, s: Column, e: Column, n: Column, share: float = 0.20, least_m: float = 3000.0) -> Column:
    """EPSG code of the zone at the middle of a padded box; the sum goes in the order w, padding, e, padding, which decides for a middle on the border of two zones."""
    lon, _ = _padding(w, s, e, n, share, least_m)
    return _zone_of(w - lon + e + lon)


def covered(w: Column, s: Column, e: Column, n: Column, envelopes: list[tuple[float, float, float, float]]) -> Column:
    """Whether a box lies in one of the envelopes."""
    out = F.lit(False)
    for ew, es, ee, en in envelopes:
        out = out | ((w >= ew) & (e <= ee) & (s >= es) & (n <= en))
    return out


def slide(centre: Column, size: Column, low: Column, high: Column) -> Column:
    """Start of an interval of a size around a centre, moved inside [low, high]."""
    return F.least(F.greatest(centre - size / 2, low), high - size)


def fitted_width(wanted: Column, aspect: float | Column, bounds: tuple[Column, Column, Column, Column]) -> Column:
    """The widest that a box of an aspect may be inside the bounds."""
    x0, y0, x1, y1 = bounds
    return F.least(wanted, x1 - x0, (y1 - y0) * aspect)


def refit_crop(crop: tuple[Column, Column, Column, Column], aspect: float, bounds: tuple[Column, Column, Column, Column], least_w: float = 0.0) -> tuple[Column, Column, Column, Column]:
    """A crop of another aspect with the same centre and, as far as it goes, area."""
    cx, cy = (crop[0] + crop[2]) / 2, (crop[1] + crop[3]) / 2
    area = F.greatest((crop[2] - crop[0]) * (crop[3] - crop[1]), F.lit(1.0))
    w = fitted_width(F.greatest(F.sqrt(area * aspect), F.lit(least_w * (1 + 1e-6))), aspect, bounds)
    h = w / aspect
    x, y = slide(cx, w, bounds[0], bounds[2]), slide(cy, h, bounds[1], bounds[3])
    return x, y, x + w, y + h


def starter_crop(cx: Column, cy: Column, span_w: Column, span_h: Column, aspect: float, bounds: tuple[Column, Column, Column, Column], least_w: float) -> tuple[Column, Column, Column, Column]:
    """A generous first crop: tracks in its middle third, never below the zoom floor if the region allows."""
    w = fitted_width(F.greatest(3 * span_w, 3 * span_h * aspect, F.lit(least_w)), aspect, bounds)
    h = w / aspect
    x, y = slide(cx, w, bounds[0], bounds[2]), slide(cy, h, bounds[1], bounds[3])
    return x, y, x + w, y + h


def snapped_count(low: Column, high: Column, res_m: Column | float, inset_m: float = 500.0) -> Column:
    """Whole cells between two edges moved inwards and snapped to the resolution."""
    a, b = F.ceil((low + inset_m) / res_m), F.floor((high - inset_m) / res_m)
    return F.greatest(F.lit(0), b - a)


def ordered_box(x0: Column, y0: Column, x1: Column, y1: Column) -> tuple[Column, Column, Column, Column]:
    """A box whatever corners it was drawn from."""
    return F.least(x0, x1), F.least(y0, y1), F.greatest(x0, x1), F.greatest(y0, y1)


def target_grid(boxes: DataFrame, key: str, zone: int, res_m: float, samples: int = 41, inset_m: float = 500.0) -> DataFrame:
    """key, x0, y0, x1, y1, cols, rows: the grid in metres of a box in degrees (w, s, e, n).

    The edges are projected at `samples` points each, as they curve; their extremes, moved inwards, bound the grid; its lower left corner is
    rounded to the resolution, half to even, and it has as many whole cells as fit from there, none in a box that is too small.
    """
    along = F.explode(F.sequence(F.lit(0), F.lit(samples - 1)))
    c = F.col
    at = lambda a, b: c(a) + (c(b) - c(a)) * c("k__") / (samples - 1)
    sides = F.explode(F.array(*(F.struct(lon.alias("lon"), lat.alias("lat")) for lon, lat in ((at("w", "e"), c("s")), (at("w", "e"), c("n")), (c("w"), at("s", "n")), (c("e"), at("s", "n"))))))
    edge = boxes.select(key, "w", "s", "e", "n").withColumn("k__", along).withColumn("p__", sides)
    x, y = utm(c("p__.lon"), c("p__.lat"), zone)
    span = edge.withColumns({"x__": F.round(x, 3), "y__": F.round(y, 3)}).groupBy(key).agg(F.min("x__").alias("lx"), F.max("x__").alias("hx"), F.min("y__").alias("ly"), F.max("y__").alias("hy"))
    snapped = lambda v: F.rint((c(v) + inset_m) / res_m) * res_m
    cornered = span.withColumns({"x0": snapped("lx"), "y0": snapped("ly")})
    fit = lambda high, low: F.greatest(F.lit(0), F.floor((c(high) - inset_m - c(low)) / res_m)).cast("long")
    counted = cornered.withColumns({"cols": fit("hx", "x0"), "rows": fit("hy", "y0")})
    return counted.select(key, "x0", "y0", (c("x0") + c("cols") * res_m).alias("x1"), (c("y0") + c("rows") * res_m).alias("y1"), "cols", "rows")
