"""Tiles against the same passes on single cells, and what a window reads."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from terravia import fixtures as fx
from terravia.operators import raster, tiles
from tests.conftest import SMALL

CELLS = "row long, col long, v double"


def bumpy(spark, high=37, wide=45, row0=-5, col0=11, holes=0.05, seed=1):
    rng = np.random.default_rng(seed)
    z = rng.normal(size=(high, wide)).cumsum(0).cumsum(1)
    z[rng.random(z.shape) < holes] = np.nan
    return spark.createDataFrame([(row0 + i, col0 + j, None if np.isnan(z[i, j]) else float(z[i, j])) for i in range(high) for j in range(wide)], CELLS)


def same(got, want, column="v"):
    a = {(r.row, r.col): r[column] for r in got.collect()}
    b = {(r.row, r.col): r[1 if column not in r.asDict() else column] for r in want.collect()}
    assert a.keys() == b.keys()
    for k, v in b.items():
        assert (a[k] is None) == (v is None) and (v is None or a[k] == pytest.approx(v, abs=1e-9)), k


@pytest.mark.parametrize("size", [8, 16, 64])
def test_there_and_back(spark, size):
    cells = bumpy(spark)
    bounds = tiles.bounds_of(cells)
    same(tiles.to_cells(tiles.to_tiles(cells, size), bounds, size), cells)


@pytest.mark.parametrize("size", [8, 16, 64])
def test_chain_is_the_passes_one_after_another(spark, size):
    cells = bumpy(spark)
    bounds = tiles.bounds_of(cells)
    done = tiles.to_cells(tiles.chain(tiles.to_tiles(cells, size), bounds, [tiles.gaussian(0.7), tiles.box_mean(2), tiles.hillshade(30.0, 200.0, 30.0, 2.0)], size), bounds, size)
    soft = raster.gaussian(cells, 0.7).select("row", "col", F.col("blurred").alias("v"))
    mean = raster.box_mean(soft, 2).select("row", "col", F.col("mean").alias("v"))
    same(done, raster.hillshade(mean, 30.0, 200.0, 30.0, 2.0).select("row", "col", F.col("shade").alias("v")))


def test_shading_next_to_holes(spark):
    cells = bumpy(spark, holes=0.2)
    bounds = tiles.bounds_of(cells)
    done = tiles.to_cells(tiles.chain(tiles.to_tiles(cells, 8), bounds, [tiles.hillshade(30.0)], 8), bounds, 8)
    same(done, raster.hillshade(cells, 30.0).select("row", "col", F.col("shade").alias("v")))


def test_one_exchange_for_a_chain(spark):
    cells = bumpy(spark)
    held = tiles.to_tiles(cells, 8).checkpoint()
    passes = [tiles.gaussian(0.7), tiles.box_mean(1), tiles.hillshade(30.0)]
    plan = tiles.chain(held, tiles.bounds_of(cells), passes, 8)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hash") == 1
    with pytest.raises(ValueError, match="larger tiles"):
        tiles.chain(held, tiles.bounds_of(cells), [tiles.box_mean(9)], 8)


def test_a_window_reads_the_blocks_it_touches(spark, tmp_path):
    cells = bumpy(spark, 64, 64, 0, 0)
    path = f"file://{tmp_path}/tiles"
    tiles.write(tiles.to_tiles(cells, 8), path, block=2)
    assert len(spark.read.parquet(path).inputFiles()) == 16
    found = tiles.read(spark, path, 20, 30, 33, 41, size=8, block=2)
    where = [r[0] for r in found.select(F.input_file_name()).distinct().collect()]
    assert sorted(w.split("/tiles/")[1].rsplit("/", 1)[0] for w in where) == ["block_r=1/block_c=2"]
    assert sorted((r.tile_r, r.tile_c) for r in found.collect()) == [(2, 4), (2, 5), (3, 4), (3, 5)]
    scan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in scan and "PushedFilters: [IsNotNull(tile_r)" in scan
    same(tiles.to_cells(found, tiles.Bounds(20, 30, 33, 41), 8), cells.where("row BETWEEN 20 AND 29 AND col BETWEEN 33 AND 40"))


def test_terrain_window_is_whole(spark, tmp_path):
    cells = fx.raster(spark, SMALL)
    bounds, path = tiles.bounds_of(cells), f"file://{tmp_path}/tiles"
    tiles.write(tiles.to_tiles(cells, 16), path, 2)
    got = tiles.terrain_window(spark, path, bounds, (-30.0, 40.0, 20.0, 90.0), 10, 10, 0.1, 2, 16, 2)
    rows = got.collect()
    assert len(rows) == (10 + 2 + 2) * (10 + 2) and all(r.v is not None for r in rows)
