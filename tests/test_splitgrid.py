"""Joins on a grid that is split where points crowd."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from terravia.operators import places, splitgrid

BOXES = "region_id string, min_x double, min_y double, max_x double, max_y double"


def crowd(spark, n=20_000, seed=1):
    """Nine tenths of the points around one home, a third of all on one spot, the rest anywhere."""
    r = np.random.default_rng(seed)
    x, y = r.uniform(-60_000, 60_000, n), r.uniform(-60_000, 60_000, n)
    home = r.random(n) < 0.9
    x[home], y[home] = 12_345 + r.normal(0, 300, home.sum()), -7_000 + r.normal(0, 300, home.sum())
    spot = r.random(n) < 0.33
    x[spot], y[spot] = 12_340.0, -7_001.0
    return [(i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))]


def boxes(seed=2):
    r = np.random.default_rng(seed)
    out = [("home", 12_000.0, -7_400.0, 12_600.0, -6_600.0), ("spot", 12_340.0, -7_001.0, 12_340.0, -7_001.0), ("all", -1e6, -1e6, 1e6, 1e6), ("edge", 12_340.0, -7_001.0, 40_000.0, 0.0)]
    for k in range(12):
        a, b = sorted(r.uniform(-60_000, 60_000, 2)), sorted(r.uniform(-60_000, 60_000, 2))
        out.append((f"r{k}", a[0], b[0], a[1], b[1]))
    return [tuple(float(v) if i else v for i, v in enumerate(b)) for b in out]


@pytest.mark.parametrize("most", [50, 700, None])
def test_points_meet_every_box_once(spark, most):
    points = crowd(spark, 4000)
    df = spark.createDataFrame(points, "id long, x double, y double").repartition(3)
    got = splitgrid.met(df, spark.createDataFrame(boxes(), BOXES), 20_000.0, most).groupBy("region_id").agg(F.count("*").alias("n"), F.count_distinct("id").alias("d")).collect()
    want = {k: sum(x0 <= x <= x1 and y0 <= y <= y1 for _, x, y in points) for k, x0, y0, x1, y1 in boxes()}
    assert {r.region_id: r.n for r in got} == {k: n for k, n in want.items() if n} and all(r.n == r.d for r in got)


def test_no_task_holds_the_crowd(spark):
    df = spark.createDataFrame(crowd(spark), "id long, x double, y double").repartition(4).checkpoint()
    most = 20_000 // 400
    grid = splitgrid.split_grid(df, 20_000.0, most)
    placed = grid.place(df)
    per_cell = placed.groupBy(*splitgrid.KEY).count()
    # a copy of a last cell is dealt by the number of the row, so a little unevenly
    assert per_cell.agg(F.max("count")).first()[0] <= 2 * most and placed.count() == 20_000
    tasks = [r["count"] for r in placed.repartition(16, *splitgrid.KEY).groupBy(F.spark_partition_id()).count().collect()]
    assert len(tasks) == 16 and max(tasks) <= 3 * np.median(tasks)
    assert grid.crowded.count() <= (splitgrid.DEPTH + 1) * 400
    fixed = [r["count"] for r in df.groupBy(F.floor(F.col("x") / 20_000), F.floor(F.col("y") / 20_000)).count().collect()]
    assert max(fixed) > 0.9 * 20_000, "on the grid alone one cell has them"


def test_nearest_in_a_crowd(spark):
    points = crowd(spark, 1500)
    spots = [(k, x, y) for k, (_, x, y) in enumerate(points[::37])] + [(1000, 12_340.0, -7_001.0), (900, 12_340.0, -7_001.0)]
    got = {r.id: (r.place, r.dist_m) for r in places.nearest(spark.createDataFrame(points, "id long, x double, y double"), spark.createDataFrame(spots, "place long, x double, y double"), 500.0).collect()}
    want = {}
    for i, x, y in points:
        d2, place = min(((x - a) ** 2 + (y - b) ** 2, k) for k, a, b in spots)
        if d2 <= 500.0**2:
            want[i] = (place, d2**0.5)
    assert got.keys() == want.keys() and all(got[i][0] == want[i][0] and got[i][1] == pytest.approx(want[i][1]) for i in want)


def test_no_points(spark):
    none = spark.createDataFrame([], "id long, x double, y double")
    assert splitgrid.met(none, spark.createDataFrame(boxes(), BOXES), 20_000.0).count() == 0


def test_nearest_compares_no_square_of_crowded_places(spark):
    """All within the radius of all: a round compares MEET pairs a point at most, and the result is that of all pairs."""
    import duckdb

    points = spark.range(4000).selectExpr("id", "CAST((id * 7919) % 1000 AS DOUBLE) AS x", "CAST((id * 104729) % 997 AS DOUBLE) AS y")
    spots = points.selectExpr("id AS place", "x + 0.5 AS x", "y AS y").where("place % 3 > 0")
    radius = places._radius(points, spots.withColumnsRenamed({"x": "px", "y": "py"}), 2000.0, 1e-6, places.MEET * 4000)
    cell = lambda v: F.floor(v / (2 * radius))
    a, b = points.select(cell(F.col("x")).alias("cx"), cell(F.col("y")).alias("cy")), spots.select(cell(F.col("x")).alias("cx"), cell(F.col("y")).alias("cy"))
    assert 4 * a.join(b, ["cx", "cy"]).count() <= places.MEET * 4000
    con = duckdb.connect()
    con.register("a", points.toPandas())
    con.register("b", spots.toPandas())
    want = con.sql("SELECT id, first(place ORDER BY d2, place) FROM (SELECT id, place, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS d2 FROM a, b) GROUP BY id").fetchall()
    assert sorted((r.id, r.place) for r in places.nearest(points, spots, 2000.0).collect()) == sorted(want)
