"""Rasters as tables of tiles.

A tile holds size x size cells as one array (tile_r, tile_c, v; null where a cell has no data or lies off the
raster), the tile (0, 0) beginning at row 0 and column 0. `write` lays tiles out in
folders of BLOCK tiles, so a window reads the files of the blocks it touches and no others. `chain` runs
passes over neighbourhoods, blur after shading after blur, on arrays: each tile sends the strips along its edges, as
wide as all passes together reach, to its neighbours once, and every pass then works inside a tile, whereas rows of
single cells would be shuffled twice for every pass. What is sent is a share of about 4 * reach / size of the raster.

Passes see which cells are on the raster, and so end at its edges as the passes on single cells do. A raster is a rectangle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from math import cos, radians, sin

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terravia.operators.raster import fill_nodata
from terravia.operators.relief import view

SIZE, BLOCK = 256, 16
TILE = "tile_r long, tile_c long, v array<double>"


@dataclass(frozen=True)
class Bounds:
    """The cells of a raster, ends excluded."""

    row0: int
    row1: int
    col0: int
    col1: int


def bounds_of(cells: DataFrame) -> Bounds | None:
    low_r, high_r, low_c, high_c = cells.agg(F.min("row"), F.max("row"), F.min("col"), F.max("col")).first()
    return None if low_r is None else Bounds(low_r, high_r + 1, low_c, high_c + 1)


def to_tiles(cells: DataFrame, size: int = SIZE) -> DataFrame:
    """Tiles of cells (row, col, v); a tile is a group of size * size cells at most."""
    at = lambda c: F.floor(F.col(c) / size).cast("long")
    keyed = cells.where("v IS NOT NULL").select(at("row").alias("tile_r"), at("col").alias("tile_c"), (F.pmod("row", F.lit(size)) * size + F.pmod("col", F.lit(size))).cast("int").alias("k"), F.col("v").cast("double").alias("v"))

    def gather(tile: pd.DataFrame) -> pd.DataFrame:
        v = np.full(size * size, np.nan)
        v[tile["k"].to_numpy()] = tile["v"].to_numpy()
        return pd.DataFrame({"tile_r": tile["tile_r"].iloc[:1], "tile_c": tile["tile_c"].iloc[:1], "v": [_listed(v)]})

    return keyed.groupBy("tile_r", "tile_c").applyInPandas(gather, TILE)


def _listed(v: np.ndarray) -> list[float | None]:
    out = v.astype(object)
    out[np.isnan(v)] = None
    return out.tolist()


def to_cells(tiles: DataFrame, bounds: Bounds, size: int = SIZE) -> DataFrame:
    """row, col, v: the cells of the tiles that lie on the raster; v is null without data."""
    each = tiles.select("tile_r", "tile_c", F.posexplode("v").alias("k", "v"))
    cells = each.select((F.col("tile_r") * size + F.floor(F.col("k") / size)).alias("row"), (F.col("tile_c") * size + F.col("k") % size).alias("col"), "v")
    return cells.where((F.col("row") >= bounds.row0) & (F.col("row") < bounds.row1) & (F.col("col") >= bounds.col0) & (F.col("col") < bounds.col1))


def write(tiles: DataFrame, path: str, block: int = BLOCK) -> None:
    """Write tiles into a folder for each block x block of them."""
    of = lambda c: F.floor(F.col(c) / block).cast("long")
    placed = tiles.withColumns({"block_r": of("tile_r"), "block_c": of("tile_c")})
    placed.repartition("block_r", "block_c").sortWithinPartitions("block_r", "block_c", "tile_r", "tile_c").write.partitionBy("block_r", "block_c").parquet(path)


def read(spark: SparkSession, path: str, row0: int, row1: int, col0: int, col1: int, size: int = SIZE, block: int = BLOCK) -> DataFrame:
    """The tiles that hold cells of a window (its ends excluded): folders are pruned by block, row groups by tile."""
    (tr0, tr1), (tc0, tc1) = (row0 // size, (row1 - 1) // size), (col0 // size, (col1 - 1) // size)
    inside = lambda c, a, b: F.col(c).between(a, b)
    kept = spark.read.parquet(path).where(inside("block_r", tr0 // block, tr1 // block) & inside("block_c", tc0 // block, tc1 // block) & inside("tile_r", tr0, tr1) & inside("tile_c", tc0, tc1))
    return kept.select("tile_r", "tile_c", "v")


@dataclass(frozen=True)
class Pass:
    """A pass: how many cells around a cell it looks at, and what it makes of an array (NaN: no data) and of where the raster is."""

    reach: int
    run: Callable[[np.ndarray, np.ndarray], np.ndarray]


def _shifted(a: np.ndarray, by: int, axis: int, fill: float) -> np.ndarray:
    """a moved by some cells along an axis; what comes in at the end is fill."""
    if by == 0:
        return a
    out = np.full_like(a, fill)
    to, of = [slice(None), slice(None)], [slice(None), slice(None)]
    to[axis], of[axis] = (slice(by, None), slice(None, -by)) if by > 0 else (slice(None, by), slice(-by, None))
    out[tuple(to)] = a[tuple(of)]
    return out


def gaussian(sigma: float) -> Pass:
    """Separable, normalised over the cells that have data."""
    reach = max(1, round(3 * sigma))

    def run(v: np.ndarray, on: np.ndarray) -> np.ndarray:
        parts = [np.where(np.isnan(v), 0.0, v), (~np.isnan(v)).astype(float)]
        for axis in (1, 0):
            parts = [sum(_shifted(p, k, axis, 0.0) * 2.718281828459045 ** (-0.5 * (k / sigma) ** 2) for k in range(-reach, reach + 1)) for p in parts]
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(parts[1] > 0, parts[0] / parts[1], np.nan)

    return Pass(reach, run)


def box_mean(radius: int) -> Pass:
    """Mean over a square of 2 * radius + 1 cells, of those that have data."""

    def run(v: np.ndarray, on: np.ndarray) -> np.ndarray:
        parts = [np.where(np.isnan(v), 0.0, v), (~np.isnan(v)).astype(float)]
        for axis in (1, 0):
            parts = [sum(_shifted(p, k, axis, 0.0) for k in range(-radius, radius + 1)) for p in parts]
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(parts[1] > 0, parts[0] / parts[1], np.nan)

    return Pass(radius, run)


def _difference(v: np.ndarray, on: np.ndarray, axis: int) -> np.ndarray:
    """Central difference, one-sided at the raster's ends, 0 for a single cell."""
    before, after = _shifted(v, 1, axis, np.nan), _shifted(v, -1, axis, np.nan)
    first, last = ~_shifted(on, 1, axis, False), ~_shifted(on, -1, axis, False)
    return np.where(first & last, 0.0, np.where(first, after - v, np.where(last, v - before, (after - before) / 2)))


def hillshade(res_m: float, azimuth: float = 315.0, altitude: float = 45.0, z_factor: float = 1.0) -> Pass:
    alt, az = radians(altitude), radians(azimuth)

    def run(v: np.ndarray, on: np.ndarray) -> np.ndarray:
        zx, zy = (_difference(v, on, axis) * (z_factor / res_m) for axis in (1, 0))
        slope, aspect = np.pi / 2 - np.arctan(np.hypot(zx, zy)), np.arctan2(-zx, zy)
        return np.clip(sin(alt) * np.sin(slope) + cos(alt) * np.cos(slope) * np.cos(az - aspect), 0.0, 1.0)

    return Pass(1, run)


#: Where a tile lies to the one that it sends a strip to.
_SIDES = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1)]


def _strips(size: int, reach: int, last: tuple[int, int, int, int]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Each tile as itself and as the strips that its neighbours need; last: first and last tile of the raster by row and column."""

    def part(a: np.ndarray, side: tuple[int, int]) -> np.ndarray:
        # side (1, 0): the tile above the one that it is sent to, of which the lower rows count
        cut = [slice(None) if s == 0 else slice(size - reach, None) if s == 1 else slice(None, reach) for s in side]
        return a[cut[0], cut[1]]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r, c, v in zip(frame["tile_r"], frame["tile_c"], frame["v"], strict=True):
                a = np.asarray(v, dtype=np.float64).reshape(size, size)
                sent = [(r + i, c + j, i, j) for i, j in _SIDES if last[0] <= r + i <= last[1] and last[2] <= c + j <= last[3]]
                yield pd.DataFrame([(tr, tc, i, j, part(a, (i, j)).tobytes()) for tr, tc, i, j in sent], columns=["tile_r", "tile_c", "i", "j", "part"])

    return run


def chain(tiles: DataFrame, bounds: Bounds, passes: Sequence[Pass], size: int = SIZE) -> DataFrame:
    """Tiles after all passes, in one exchange. A tile that is missing altogether has no data, and gets what passes make of that where it is on the raster."""
    reach = sum(p.reach for p in passes)
    if reach > size:
        raise ValueError(f"passes reach {reach} cells, tiles have {size}: take larger tiles")
    last = (bounds.row0 // size, (bounds.row1 - 1) // size, bounds.col0 // size, (bounds.col1 - 1) // size)
    sent = tiles.mapInPandas(_strips(size, reach, last), "tile_r long, tile_c long, i int, j int, part binary")

    def run(parts: pd.DataFrame) -> pd.DataFrame:
        r, c = int(parts["tile_r"].iloc[0]), int(parts["tile_c"].iloc[0])
        whole = np.full((size + 2 * reach, size + 2 * reach), np.nan)
        ends = {1: (0, reach), 0: (reach, reach + size), -1: (reach + size, size + 2 * reach)}
        for i, j, part in zip(parts["i"], parts["j"], parts["part"], strict=True):
            (r0, r1), (c0, c1) = ends[i], ends[j]
            whole[r0:r1, c0:c1] = np.frombuffer(part).reshape(r1 - r0, c1 - c0)
        rows, cols = np.arange(r * size - reach, (r + 1) * size + reach), np.arange(c * size - reach, (c + 1) * size + reach)
        on = np.logical_and.outer((rows >= bounds.row0) & (rows < bounds.row1), (cols >= bounds.col0) & (cols < bounds.col1))
        for p in passes:
            whole = np.where(on, p.run(whole, on), np.nan)
        core = whole[reach : reach + size, reach : reach + size].reshape(-1)
        return pd.DataFrame({"tile_r": [r], "tile_c": [c], "v": [_listed(core)]})

    return sent.groupBy("tile_r", "tile_c").applyInPandas(run, TILE)


def terrain_window(spark: SparkSession, path: str, bounds: Bounds, box: tuple[float, float, float, float], wide: int, high: int, margin: float = 0.06, south: int = 0, size: int = SIZE, block: int = BLOCK) -> DataFrame:
    """row, col, v: the heights that a sheet is painted from: the crop (row0, col0, row1, col1 in cells) at wide x high pixels with its margin, holes and what lies beyond the data taken from the nearest pixel that has some.

    Only tiles that the window touches are read; it is itself no larger than a sheet.
    """
    r0, c0, r1, c1 = box
    step_r, step_c = (r1 - r0) / high, (c1 - c0) / wide
    pad_r, pad_c = round(high * margin) + 2, round(wide * margin) + 2
    rows = (int(np.floor(r0 - pad_r * step_r)) - 1, int(np.ceil(r1 + (pad_r + south) * step_r)) + 2)
    cols = (int(np.floor(c0 - pad_c * step_c)) - 1, int(np.ceil(c1 + pad_c * step_c)) + 2)
    cells = to_cells(read(spark, path, *rows, *cols, size, block), bounds, size)
    seen = view(cells, box, wide, high, margin, south)
    return fill_nodata(seen).select("row", "col", F.col("filled").alias("v"))
