"""Polygons to cells, distances and envelopes, against plain loops."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from terravia.operators import bakes, graph, polygons, raster, relief

RINGS = "poly long, ring int, vidx int, x double, y double"
CELLS = "row long, col long, v double"


def ring_rows(rings):
    return [(p, k, i, float(x), float(y)) for p, k, pts in rings for i, (x, y) in enumerate(pts)]


def inside(rings, x, y):
    """Crossings to the left of a point, counted one by one."""
    odd = {}
    for p, _, pts in rings:
        for (xa, ya), (xb, yb) in zip(pts, [*pts[1:], pts[0]], strict=True):
            if ya > yb:
                xa, ya, xb, yb = xb, yb, xa, ya
            if ya <= y < yb and xa + (y - ya) * (xb - xa) / (yb - ya) <= x:
                odd[p] = not odd.get(p, False)
    return any(odd.values())


SQUARE = [(2, 2), (8, 2), (8, 8), (2, 8)]


@pytest.mark.parametrize(
    "rings",
    [
        [(1, 0, SQUARE)],
        [(1, 0, SQUARE), (1, 1, [(4, 4), (4, 6), (6, 6), (6, 4)])],
        [(1, 0, SQUARE), (2, 0, [(8, 2), (11, 2), (11, 8), (8, 8)])],
        [(1, 0, [(2.5, 2.5), (6.5, 2.5), (6.5, 6.5), (2.5, 6.5)]), (2, 0, [(6.5, 2.5), (9.5, 2.5), (9.5, 6.5), (6.5, 6.5)])],
        [(1, 0, [(5.5, 1.5), (9.5, 5.5), (5.5, 9.5), (1.5, 5.5)]), (1, 1, [(5.5, 5.5), (7.5, 5.5), (5.5, 7.5)])],
        [(1, 0, [(0, 0), (10, 10), (10, 0), (0, 10)])],
        [(1, 0, [(-50, -50), (60, -40), (70, 90), (-30, 80)])],
        [(1, 0, [(3, 3), (9, 3)]), (2, 0, [(4, 4)]), (3, 0, [(0, 5.5), (11, 5.5), (6, 5.5)])],
    ],
)
def test_mask_is_the_count_of_crossings(spark, rings):
    cells = spark.createDataFrame([(i, j, 0.0) for i in range(12) for j in range(11)], CELLS)
    got = {(r.row, r.col) for r in polygons.mask(cells, spark.createDataFrame(ring_rows(rings), RINGS)).where("water").collect()}
    assert got == {(i, j) for i in range(12) for j in range(11) if inside(rings, j + 0.5, i + 0.5)}


def test_mask_of_random_rings(spark):
    r = random.Random(3)
    rings = [(p, k, [(r.randrange(-8, 48) / 2, r.randrange(-8, 48) / 2) for _ in range(r.randrange(3, 8))]) for p in range(12) for k in range(r.randrange(1, 3))]
    cells = spark.createDataFrame([(i + 3, j + 2, 0.0) for i in range(17) for j in range(19)], CELLS)
    got = [(x.row, x.col, x.water) for x in polygons.mask(cells, spark.createDataFrame(ring_rows(rings), RINGS).repartition(4)).collect()]
    assert sorted(got) == [(i + 3, j + 2, inside(rings, j + 2.5, i + 3.5)) for i in range(17) for j in range(19)]
    plain = polygons.runs(spark.createDataFrame(ring_rows(rings), RINGS), 3, 20, 2, 21)
    assert plain.agg(F.min("row"), F.max("row"), F.min("first"), F.max("last")).first()[0] >= 3


def test_mask_without_rings_or_cells(spark):
    cells = spark.createDataFrame([(0, 0, 1.0)], CELLS)
    none = spark.createDataFrame([], RINGS)
    assert [r.water for r in polygons.mask(cells, none).collect()] == [False]
    assert polygons.mask(cells.limit(0), none).count() == 0
    odd = spark.createDataFrame([(1, 0, 0, float("nan"), 0.0), (1, 0, 1, 5.0, None), (1, 0, 2, 1.0, 1.0)], RINGS)
    assert [r.water for r in polygons.mask(cells, odd).collect()] == [False]


def nearest(z):
    some = [(i, j) for i, j in np.argwhere(~np.isnan(z)).tolist()]
    return {(i, j): min(((a - i) ** 2 + (b - j) ** 2, a, b) for a, b in some) for i in range(z.shape[0]) for j in range(z.shape[1])} if some else {}


@pytest.mark.parametrize("seed,share,shape", [(1, 0.5, (9, 13)), (2, 0.1, (14, 30)), (3, 0.02, (25, 40)), (4, 0.3, (1, 60)), (5, 0.3, (40, 1))])
def test_nearest_data(spark, seed, share, shape):
    rng = np.random.default_rng(seed)
    z = np.where(rng.random(shape) < share, rng.integers(1, 99, shape).astype(float), np.nan)
    z[0, 0] = 7.0
    cells = spark.createDataFrame([(i, j + 5, None if np.isnan(z[i, j]) else float(z[i, j])) for i in range(shape[0]) for j in range(shape[1])], CELLS)
    want = {(i, j + 5): (z[a, b], d2) for (i, j), (d2, a, b) in nearest(z).items()}
    assert {(r.row, r.col): (r.nearest, r.d2) for r in raster.nearest_data(cells).collect()} == want


def test_nearest_data_breaks_ties_on_circles(spark):
    """Many places at one distance from the middle: the smallest row, then column, wins."""
    z = np.full((21, 21), np.nan)
    for i in range(21):
        for j in range(21):
            if (i - 10) ** 2 + (j - 10) ** 2 in (25, 50):
                z[i, j] = i * 100 + j
    cells = spark.createDataFrame([(i, j, None if np.isnan(z[i, j]) else float(z[i, j])) for i in range(21) for j in range(21)], CELLS)
    assert {(r.row, r.col): (r.nearest, r.d2) for r in raster.nearest_data(cells).collect()} == {k: (z[a, b], d2) for k, (d2, a, b) in nearest(z).items()}


def test_nearest_data_makes_no_more_rows_than_cells(spark):
    """One datum in a wide strip: the rows that the plan makes are the cells."""
    cells = spark.range(40_000).select((F.col("id") / 20_000).cast("long").alias("row"), (F.col("id") % 20_000).alias("col"), F.when(F.col("id") == 5, 1.0).alias("v"))
    done = raster.nearest_data(cells)
    assert "Generate" not in done._jdf.queryExecution().executedPlan().toString()
    assert done.agg(F.count("*"), F.max("d2"), F.min("nearest")).first() == (40_000, 19_994**2 + 1, 1.0)


@pytest.mark.parametrize("batch", [3, 40, 10_000])
def test_blur_takes_lines_as_streams(spark, batch):
    """No window a weight, and the same sums, in the same order, however lines are cut into batches; cells may be missing and carry other columns."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        rng = np.random.default_rng(8)
        z = np.where(rng.random((9, 23)) < 0.8, rng.normal(0, 50, (9, 23)), np.nan)
        at = [(i, j) for i in range(9) for j in range(23) if (i + j) % 11]
        cells = spark.createDataFrame([(i, j, None if np.isnan(z[i, j]) else float(z[i, j]), [i, j]) for i, j in at], CELLS + ", name array<int>")
        weights = [2.718281828459045 ** (-0.5 * (k / 1.4) ** 2) for k in range(5)]

        def along(values, line, place):
            out = {}
            for one in {c[line] for c in at}:
                cells_of = sorted((c for c in at if c[line] == one), key=lambda c: c[place])
                for n, c in enumerate(cells_of):
                    total = 0.0
                    for k in range(-4, 5):
                        total += (values[cells_of[n - k]] if 0 <= n - k < len(cells_of) else 0.0) * weights[abs(k)]
                    out[c] = total
            return out

        parts = [{c: 0.0 if np.isnan(z[c]) else float(z[c]) for c in at}, {c: float(not np.isnan(z[c])) for c in at}]
        num, den = (along(along(p, 0, 1), 1, 0) for p in parts)
        done = raster.gaussian(cells, 1.4)
        assert "Window" not in done._jdf.queryExecution().executedPlan().toString()
        assert {(r.row, r.col): (r.blurred, r.name) for r in done.collect()} == {c: (num[c] / den[c] if den[c] > 0 else None, list(c)) for c in at}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_reading_back_is_the_bilinear_sample(spark):
    """Of every cell, off the grid's ends and beside holes as well, with one row a cell on the way."""
    rng = np.random.default_rng(9)
    grid = spark.createDataFrame([(i, j, None if (i * 5 + j) % 7 == 0 or i == 3 else float(rng.normal())) for i in range(6) for j in range(5)], CELLS)
    cells = spark.createDataFrame([(i, j, "x") for i in range(-4, 22) for j in range(19)], "row long, col long, name string")
    points = cells.select(F.struct("row", "col").alias("at"), ((F.col("row") + 0.5) / 3 - 0.5).alias("fr"), ((F.col("col") + 0.5) / 3 - 0.5).alias("fc"))
    want = {tuple(r.at): r.z for r in raster.sample_bilinear(points, grid, "at").collect() if r.z is not None}
    got = {(r.row, r.col): r.v for r in raster.read_back(cells, grid, 3, ["v"]).collect()}
    assert len(got) == 26 * 19 and {k for k, v in got.items() if v is not None} == want.keys()
    assert all(got[k] == pytest.approx(v, abs=1e-12) for k, v in want.items())


@pytest.mark.parametrize("wide", [True, False])
def test_rows_are_searched_many_at_a_time(spark, wide):
    """Rows of the raster are no groups of their own; a row wider than a batch, and than the cells looked at, is whole; columns may have gaps, and other columns are carried."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 37)
    try:
        rng = np.random.default_rng(6)
        shape = (4, 400) if wide else (60, 10)
        z = np.where(rng.random(shape) < (0.004 if wide else 0.1), rng.integers(1, 99, shape).astype(float), np.nan)
        z[0, 0] = 7.0
        step = 1 if wide else 3
        cells = spark.createDataFrame([(i, j * step, None if np.isnan(z[i, j]) else int(z[i, j]) + 2**60, f"{i}/{j}") for i in range(shape[0]) for j in range(shape[1])], "row long, col long, v long, name string")
        gapped = np.full((shape[0], shape[1] * step), np.nan)
        gapped[:, ::step] = z
        want = {(i, j): (int(gapped[a, b]) + 2**60, d2, f"{i}/{j // step}") for (i, j), (d2, a, b) in nearest(gapped).items() if j % step == 0}
        done = raster.nearest_data(cells, "name")
        assert "FlatMapGroups" not in done._jdf.queryExecution().executedPlan().toString()
        assert {(r.row, r.col): (r.nearest, r.d2, r.name) for r in done.collect()} == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_depth_leaves_out_what_is_not_known_to_be_water(spark):
    cells = spark.createDataFrame([(0, 0, False), (0, 1, True), (0, 2, None), (0, 3, True)], "row long, col long, water boolean")
    rows = {r.col: r.depth for r in relief.lake_depth(cells, 90.0).collect()}
    assert rows.keys() == {1, 3} and rows[1] == pytest.approx(0.1**0.75) and rows[3] == pytest.approx(0.3**0.75)


def brute_envelope(good, share, scale, height, width):
    """Edges taken off one by one from an array."""
    a, b, c, d = 0, good.shape[0], 0, good.shape[1]
    while a < b and c < d:
        edges = {"bottom": good[b - 1, c:d], "left": good[a:b, c], "right": good[a:b, d - 1], "top": good[a, c:d]}
        worst = min(edges, key=lambda e: edges[e].mean())
        if edges[worst].mean() >= share:
            break
        a, b, c, d = a + (worst == "top"), b - (worst == "bottom"), c + (worst == "left"), d - (worst == "right")
    if (a, b, c, d) == (0, *good.shape[:1], 0, good.shape[1]):
        return 0, height, 0, width
    return max(0, a * scale + 1), min(height, b * scale - 1), max(0, c * scale + 1), min(width, d * scale - 1)


@pytest.mark.parametrize("seed,strip", [(1, 2), (2, 3), (3, 64), (4, 1), (5, 7)])
def test_finite_envelope(spark, seed, strip):
    rng = np.random.default_rng(seed)
    good = rng.random((23, 31)) > 0.02
    good[: rng.integers(0, 6)] &= rng.random((1, 31)) > 0.5
    good[:, 31 - rng.integers(1, 9) :] = False
    good[np.add.outer(np.arange(23), np.arange(31)) < rng.integers(4, 20)] = False
    cells = spark.createDataFrame([(100 + i, 7 + j, 1.0 if good[i, j] else [None, float("nan")][j % 2]) for i in range(23) for j in range(31)], CELLS)
    for share in (0.995, 0.6):
        a, b, c, d = brute_envelope(good, share, 1, 23, 31)
        assert tuple(relief.finite_envelope(cells, share, strip=strip).first()) == (100 + a, 100 + b, 7 + c, 7 + d)


def test_finite_envelope_on_a_probe(spark):
    good = np.ones((40, 33), dtype=bool)
    good[:5] = False
    good[:, 28:] = False
    cells = spark.createDataFrame([(i, j, 1.0 if good[i, j] else None) for i in range(40) for j in range(33)], CELLS)
    scale = max(1, 40 // 12, 33 // 12)
    probed = good[scale // 2 :: scale, scale // 2 :: scale][: 40 // scale, : 33 // scale]
    assert tuple(relief.finite_envelope(cells, side=12).first()) == brute_envelope(probed, 0.995, scale, 40, 33)
    assert tuple(relief.finite_envelope(cells.withColumn("v", F.lit(1.0))).first()) == (0, 40, 0, 33)
    assert relief.finite_envelope(cells.limit(0)).count() == 0
    row0, row1, col0, col1 = relief.finite_envelope(cells.withColumn("v", F.lit(None).cast("double"))).first()
    assert row1 <= row0 or col1 <= col0, "nothing is left of a raster without data"


def test_edge_of_pair_takes_each_edge_once(spark):
    """Either way, of parallel edges the first, loops and ends that are not known too; no edge becomes two rows, and none is sorted before it is dealt."""
    edges = spark.createDataFrame([("e3", "a", "b"), ("e2", "b", "a"), ("e9", "a", "a"), ("e4", "c", None), ("e5", "c", "c")], "eid string, src string, dst string")
    pairs = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "a"), ("a", "a"), ("c", None), (None, "c"), ("a", "c")], "src string, dst string")
    done = graph.edge_of_pair(edges, pairs)
    assert "Union" not in done._jdf.queryExecution().executedPlan().toString()
    key = lambda r: tuple(x or "" for x in r)
    want = [("a", "b", "e2"), ("b", "a", "e2"), ("b", "a", "e2"), ("a", "a", "e9"), ("c", None, None), (None, "c", None), ("a", "c", None)]
    assert sorted((tuple(r) for r in done.collect()), key=key) == sorted(want, key=key)


def test_places_are_worked_out_once(spark):
    """Vertices that are nowhere and repeats around them are left out, and no filter projects again."""
    lons = [-121.0, None, -121.0, float("nan"), -121.0, -120.0, 100.0, -121.0]
    rows = spark.createDataFrame([(1, i, lon, 40.0) for i, lon in enumerate(lons)] + [(2, 0, -121.0, 40.0), (2, 1, None, 40.0)], "way long, vidx long, lon double, lat double")
    done = bakes.projected(rows, 10, ["way"], 1)
    plan = done._jdf.queryExecution().optimizedPlan().toString()
    assert not any("ATANH" in line.upper() and "Filter" in line for line in plan.splitlines())
    got = sorted((r.way, r.vidx, r.x) for r in done.collect())
    assert [g[:2] for g in got] == [(1, 0), (1, 1), (1, 2)] and got[0][2] == got[2][2] != got[1][2]
