"""Operators on literal rows, and properties that hold whatever the rows."""

import math
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from terravia import fixtures as fx
from terravia.functions import geodesy, solar, text
from terravia.operators import assets, journeys, places, raster, relief, sheets
from terravia.plans import places as plans_places
from tests.conftest import SF, SMALL, duck

PTS = "track_id string, day string, vidx long, x double, y double, t double, ele double, event_id long"


def track(spark, *tracks):
    rows = [(f"t{k}", day, i, float(x), float(y), float(i * 60), float(i), k * 1000 + i) for k, (day, pts) in enumerate(tracks) for i, (x, y) in enumerate(pts)]
    return spark.createDataFrame(rows, PTS)


def test_visits_count_journeys_not_passes(spark):
    back_and_forth = [(500, 500), (2500, 500), (500, 500)]
    cells = journeys.visits(track(spark, ("2024-01-01", back_and_forth), ("2024-01-01", back_and_forth), (None, back_and_forth), ("2024-01-02", [(500, 500)])), (0, 0, 4000, 1000)).collect()
    assert sorted((c.gy, c.gx, c.visits) for c in cells) == [(0, 0, 2), (0, 1, 2), (0, 2, 2)]


def test_hotspots_are_spaced_and_greedy(spark):
    cells = spark.createDataFrame([(0, 0, 9), (0, 3, 8), (0, 7, 7), (0, 13, 7), (0, 14, 1)], "gy long, gx long, visits long")
    got = places.hotspots(cells, (0.0, 0.0, 20000.0, 1000.0), most=3).collect()
    assert [(r.rank, r.gx) for r in got] == [(1, 0), (2, 13), (3, 7)]
    assert places.hotspots(cells.limit(0), (0.0, 0.0, 20000.0, 1000.0)).count() == 0


def test_simplify_takes_many_tracks_at_once(spark):
    """Batches of rows end anywhere in a track; no track is a group of its own for Python."""
    rows = [(t, v, float(v), float((v * t * 7) % 5)) for t in range(30) for v in range(t % 9 + 1)] + [(None, v, float(v), 0.0) for v in range(4)]
    points = spark.createDataFrame(rows, "track_id long, vidx long, x double, y double")
    want = []
    for t in [*range(30), None]:
        mine = [r for r in rows if r[0] == t]
        stays = journeys._kept(np.array([r[2] for r in mine]), np.array([r[3] for r in mine]), 1.0) if len(mine) > 2 else [True] * len(mine)
        want += [r for r, k in zip(mine, stays, strict=True) if k]
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(size)
    try:
        for n in ("1", "4", before):
            spark.conf.set(size, n)
            kept = journeys.simplify(points, 1.0)
            assert sorted(map(tuple, kept.collect()), key=str) == sorted(want, key=str)
    finally:
        spark.conf.set(size, before)
    assert "MapInArrow" in kept._jdf.queryExecution().toString() and "InPandas" not in kept._jdf.queryExecution().toString()


def test_simplify_properties(spark):
    points = fx.points(spark, SF, by_user=True).where("track_id < '130'")
    kept = journeys.simplify(points, 15000.0)
    both = points.select("track_id", "vidx", "x", "y").toPandas().sort_values(["track_id", "vidx"])
    some = kept.toPandas()
    for tid, whole in both.groupby("track_id"):
        k = some[some.track_id == tid].sort_values("vidx").vidx.tolist()
        assert k[0] == 0 and k[-1] == whole.vidx.max() and len(k) <= len(whole)
        xy = whole[["x", "y"]].to_numpy()
        for a, b in zip(k, k[1:], strict=False):
            d = xy[b] - xy[a]
            for p in xy[a + 1 : b] - xy[a]:
                u = min(1, max(0, p @ d / (d @ d))) if d @ d else 0
                assert np.hypot(*(p - u * d)) <= 15000.0 + 1e-6


def test_order_of_rows_does_not_matter(spark):
    points = fx.points(spark, SF)
    shuffled = points.orderBy(F.rand(1))
    assert sorted(journeys.visits(points, fx.BOUNDS).collect()) == sorted(journeys.visits(shuffled, fx.BOUNDS).collect())


def test_reveals_end_whole(spark):
    points = track(spark, ("2024-01-02", [(i, 0) for i in range(10)]), ("2024-01-01", [(i, 0) for i in range(5)]), (None, [(i, 0) for i in range(3)]))
    shown = {(r.frame, r.track_id): r.shown for r in journeys.reveal_by_points(points, 6).collect()}
    assert [shown.get((f, "t1")) for f in (1, 2)] == [3, 5] and shown[2, "t0"] if (2, "t0") in shown else True
    last = max(f for f, _ in shown)
    assert {k: v for (f, k), v in shown.items() if f == last} == {"t0": 10, "t1": 5, "t2": 3}
    plan = lambda n, most: [r.shown for r in journeys.frame_plan(spark.createDataFrame([(n,)], "n long"), most).orderBy("frame").collect()]
    assert plan(3, 10) == [1, 2, 3] and plan(100, 5) == [25, 50, 75, 100] and plan(0, 5) == []


def test_carry_annotations(spark):
    schema = "sid string, nth int, x double, y double, label string"
    old = spark.createDataFrame([("s", 0, 0.0, 0.0, "camp"), ("s", 1, 100.0, 0.0, "lake"), ("s", 2, 90000.0, 0.0, "far"), ("s", 3, 5.0, 5.0, "")], schema)
    new = spark.createDataFrame([("s", 0, 10.0, 0.0, ""), ("s", 1, 50000.0, 0.0, ""), ("u", 0, 1.0, 1.0, "")], schema)
    got = [(r.sid, r.x, r.label) for r in places.carry_annotations(old, new, "sid").orderBy("sid", "pos").collect()]
    assert got == [("s", 10.0, "camp"), ("s", 50000.0, ""), ("s", 100.0, "lake"), ("s", 90000.0, "far"), ("u", 1.0, "")]


def test_annotations_are_carried_along_whole_tracks(spark):
    tracks = {}
    for r in fx.points(spark, SMALL, by_user=True).orderBy("track_id", "vidx").collect():
        tracks.setdefault(r.track_id, []).append(r)
    want = []
    for tid, points in tracks.items():
        acc = [[r.x, r.y, ""] for r in points if r.vidx % 2]
        for o in (r for r in points if r.vidx % 2 == 0 and r.event_id % 3 == 0):
            d2, i = min((((s[0] - o.x) ** 2 + (s[1] - o.y) ** 2, i) for i, s in enumerate(acc)), default=(math.inf, None))
            if d2 <= places.CARRY_M**2 and not acc[i][2]:
                acc[i][2] = f"L{o.event_id}"
            else:
                acc.append([o.x, o.y, f"L{o.event_id}"])
        want += [(tid, i, *s) for i, s in enumerate(acc)]
    got = plans_places.annotate_carry(spark, SMALL).collect()
    assert max(map(len, tracks.values())) > 16
    assert sorted((r.track_id, r.pos, r.x, r.y, r.label) for r in got) == sorted(want)


def test_cast_shadow_is_the_running_horizon(spark):
    z = [0.0, 100.0, 20.0, 90.0, 0.0, 0.0]
    cells = spark.createDataFrame([(0, j, v) for j, v in enumerate(z)], "row long, col long, v double")
    got = {r.col: r.depth for r in raster.cast_shadow(cells, 30.0, 270, 45.0).collect()}
    h, drop, want = -math.inf, 30.0 * math.tan(math.radians(45)), {}
    for j, v in enumerate(z):
        h = max(h - drop, v)
        want[j] = h - v
    assert got == pytest.approx(want)


def test_gradient_is_numpys(spark):
    rng = np.random.default_rng(0)
    z = rng.normal(size=(7, 5))
    cells = spark.createDataFrame([(i, j, float(z[i, j])) for i in range(7) for j in range(5)], "row long, col long, v double")
    gy, gx = np.gradient(z)
    for r in raster.gradient(cells).collect():
        assert (r.dx, r.dy) == pytest.approx((gx[r.row, r.col], gy[r.row, r.col]))


def test_pass_registry(spark):
    cells = spark.createDataFrame([(0, 0, 1.0)], "row long, col long, v double")
    passes = raster.PassRegistry()
    passes.register("finish", "double", lambda d: d.withColumn("v", F.col("v") * 2))
    passes.register("colour", "add", lambda d: d.withColumn("v", F.col("v") + 1), lambda k: k.get("add", False))
    assert passes.apply(cells, {}).first().v == 2.0 and passes.apply(cells, {"add": True}).first().v == 4.0
    passes.register("finish", "double", lambda d: d.withColumn("v", F.col("v") * 3))
    passes.unregister("colour", "add")
    assert passes.apply(cells, {"add": True}).first().v == 3.0 and passes.names("finish") == ["double"]


def test_fill_is_the_euclidean_nearest(spark):
    rng = np.random.default_rng(2)
    z = np.where(rng.random((14, 11)) < 0.15, rng.integers(1, 99, (14, 11)).astype(float), np.nan)
    z[:, 4] = np.nan
    z[6, :] = np.nan
    cells = spark.createDataFrame([(i, j, None if np.isnan(z[i, j]) else float(z[i, j])) for i in range(14) for j in range(11)], "row long, col long, v double")
    some = [(i, j) for i in range(14) for j in range(11) if not np.isnan(z[i, j])]
    want = {(i, j): z[min(some, key=lambda p: ((p[0] - i) ** 2 + (p[1] - j) ** 2, p))] for i in range(14) for j in range(11)}
    assert {(r.row, r.col): r.filled for r in raster.fill_nodata(cells).collect()} == want
    assert {r.filled for r in raster.fill_nodata(cells.withColumn("v", F.lit(None).cast("double"))).collect()} == {0.0}


def test_order_statistics_of_ties_and_extremes(spark):
    values = [5.0] * 50 + [1e308, -1e308, 0.0, 1e-300, 5.0000001]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert raster.order_statistics(df, range(len(values)), 4) == sorted(values)
    p = raster.percentiles(df, [0.0, 0.5, 1.0]).first()
    assert tuple(p) == (-1e308, 5.0, 1e308)
    assert tuple(raster.percentiles(df.limit(0), [0.5]).first()) == (None,)


def test_a_shadow_falls_away_from_the_sun(spark):
    """A tower throws its shadow to the far side, whatever the azimuth."""
    cells = spark.createDataFrame([(i, j, 50.0 if (i, j) == (10, 10) else 0.0) for i in range(21) for j in range(21)], "row long, col long, v double")
    for azimuth in (0.0, 45.0, 112.5, 180.0, 200.0, 270.0, 333.0):
        dark = [(r.row - 10, r.col - 10) for r in raster.cast_shadow(cells, 10.0, azimuth, 45.0).where("depth > 1e-6").collect()]
        a = math.radians(azimuth)
        assert dark and all(-math.sin(a) * c + math.cos(a) * r > 0 for r, c in dark)


def test_reveal_by_clock_is_common_to_all_tracks(spark):
    rows = [("a", "d", i, float(i), 0.0, float(60 * i), 0.0, i) for i in range(5)] + [("b", "d", i, float(i), 1.0, float(90_000 + 60 * i), 0.0, i) for i in range(5)] + [("c", None, i, 0.0, 0.0, None, 0.0, i) for i in range(3)]
    shown = {(r.frame, r.track_id): r.shown for r in journeys.reveal_by_clock(spark.createDataFrame(rows, PTS), 4).collect()}
    assert {f: shown.get((f, "c")) for f in range(1, 5)} == {1: 3, 2: 3, 3: 3, 4: 3}
    assert shown[4, "a"] == shown[4, "b"] == 5 and (1, "b") not in shown and shown[1, "a"] == 5


def test_no_task_numbers_most_of_the_undated_journeys(spark):
    points = spark.range(3000).select(F.concat(F.lit("t"), F.col("id").cast("string")).alias("track_id"), F.lit(None).cast("string").alias("day"), F.lit(0).cast("long").alias("vidx"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), (F.col("id") * 5000.0).alias("t"), F.lit(0.0).alias("ele"), F.col("id").alias("event_id"))
    ranked = journeys.numbered(journeys.journey_groups(points)).collect()
    assert sorted(r.nth for r in ranked) == list(range(1, 3001)) and {r.journey: r.nth for r in ranked}["__anon-t17"] == 18


def test_regions_met_on_a_grid(spark):
    boxes = spark.createDataFrame([("r", -5.0, -5.0, 50_001.0, 30_000.0), ("s", 0.0, 0.0, 0.0, 0.0)], "region_id string, min_x double, min_y double, max_x double, max_y double")
    points = spark.createDataFrame([("a", 0.0, 0.0), ("a", 50_001.0, 30_000.0), ("b", 50_002.0, 0.0), ("c", -5.0, -5.0)], "track_id string, x double, y double")
    assert dict(places.in_bounds(points, boxes).collect()) == {"r": 3, "s": 1}
    assert dict(places.outside(points, boxes).collect()) == {"r": 1, "s": 3}


def test_projection_control_and_range(spark):
    x, y = geodesy.utm(F.col("lon"), F.col("lat"), 10)
    rows = spark.createDataFrame([(-123.0, 0.0), (-60.0, 40.0)], "lon double, lat double").select(x.alias("x"), y.alias("y")).collect()
    assert (rows[0].x, rows[0].y) == pytest.approx((500000.0, 0.0)) and rows[1].x is None


def test_sun_at_a_known_moment(spark):
    """Solar noon near an equinox on the equator: the sun stands overhead."""
    rows = spark.createDataFrame([(1710936000.0, 0.0, 0.0), (1718884800.0, 40.0, -121.0)], "t double, lat double, lon double")
    a, b = solar.with_position(rows, "t", "lat", "lon").collect()
    assert a.sun_alt > 87 and 0 <= a.sun_az < 360
    assert -90 <= b.sun_alt <= 90


def test_text_rules(spark):
    one = spark.range(1)
    f = lambda c: one.select(c.alias("v")).first().v
    assert f(text.slug(F.lit("  Lassen / Été 2 "))) == "lassen_t_2" and f(text.slug(F.lit("--"))) == "region"
    assert f(text.year_span(F.array(F.lit("2023-01-01"), F.lit(None), F.lit("x"), F.lit("2021-05-05")))) == "2021–2023"
    assert f(text.symbol_icon(F.lit("Mountain Camp"))) == "peak" and f(text.symbol_icon(F.lit(None).cast("string"))) == "flag"
    assert f(text.hex_colour(F.lit("#0a10FF"))).asDict() == {"r": 10, "g": 16, "b": 255} and f(text.hex_colour(F.lit("0a10FF"))) is None
    assert f(text.iso_seconds(F.lit("1970-01-01T00:01:00Z"))) == 60.0 and f(text.iso_seconds(F.lit("never"))) is None


def test_rules_report_the_first_break(spark):
    rows = spark.createDataFrame([(1, 5.0), (2, None), (3, -1.0)], "id int, w double")
    rules = [("finite", F.col("w").isNotNull()), ("positive", F.col("w") > 0)]
    assert {r.id: r.e for r in rows.select("id", assets.first_error(rules).alias("e")).collect()} == {1: None, 2: "finite", 3: "positive"}


def test_same_sets(spark):
    of = lambda *v: spark.createDataFrame([(x,) for x in v], "x int")
    assert assets.same_sets(of(1, 2, 2, None), of(None, 2, 1, 1)) and assets.same_sets(of(), of())
    assert not assets.same_sets(of(1), of(1, None)) and not assets.same_sets(of(1, 2), of(1))


def test_sun_of_a_journey(spark):
    rows = [("none", 40.0, -121.0, None, None), ("summit", 40.0, -121.0, "2024-06-21", 1719000000.0), ("day", 40.0, -121.0, "2024-06-21", None), ("north", 80.0, 0.0, "2024-12-21", None)]
    a = spark.createDataFrame(rows, "id string, lat double, lon double, last_day string, summit_t double")
    got = {r.id: r for r in solar.journey_light(a, "id").collect()}
    assert not got["none"].available and got["none"].azimuth is None and got["none"].hour is None
    assert got["summit"].hour == round((1719000000 - 121 * 240) % 86400 / 3600, 3)
    assert 17 < got["day"].hour < 19.5 and 11 < got["day"].altitude < 12.2 and got["day"].azimuth > 270, "the evening's golden hour"
    assert got["north"].altitude == 8.0 and abs(got["north"].hour - 12) < 0.2, "where the sun never stands so high, its highest"
    at = {r.id: r for r in solar.journey_light(a, "id", F.lit(9.5)).collect()}
    assert at["summit"].hour == at["day"].hour == 9.5 and not at["none"].available


def test_archive_names(spark):
    ok = lambda names: spark.createDataFrame([(names, "r")], "n array<string>, f string").select(assets.archive_names_ok(F.col("n"), F.col("f"), ["dem.tif", "sources.json"]).alias("v")).first().v
    assert ok(["r/dem.tif", "r/sources.json"])
    assert not ok(["r/dem.tif"]) and not ok(["r/dem.tif", "r/dem.tif", "r/sources.json"]) and not ok(["r/sources.json", "x/dem.tif"]) and not ok(["r/sources.json", "r/../etc"])


def test_native_plans(spark):
    for df in (journeys.visits(fx.points(spark, SF), fx.BOUNDS), raster.hillshade(fx.filled_raster(spark, SF), 100.0), assets.verify(fx.assets(spark, SF), fx.assets(spark, SF))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_recovered_times_are_of_the_first_visit(spark):
    points = track(spark, ("d", [(0, 0), (5, 9), (9, 0), (5, 9), (0, 0)]))
    simple = journeys.simplify(points, 1.0)
    got = {r.vidx: r.t0 for r in journeys.recover_times(simple, points).collect()}
    assert got == {0: 0.0, 1: 60.0, 2: 120.0, 3: 60.0, 4: 0.0}
    moved = simple.withColumn("x", F.when(F.col("vidx") == 2, 99.0).otherwise(F.col("x")))
    assert {r.vidx: r.t0 for r in journeys.recover_times(moved, points).collect()}[2] is None


def blur(z, sigma):
    """The library's Gaussian: truncated, normalised over the cells that are there."""
    reach = max(1, round(3 * sigma))
    w = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    one = lambda a: np.apply_along_axis(lambda v: np.convolve(np.pad(v, reach), w, "valid"), 1, a)
    two = lambda a: one(one(a).T).T
    return two(z) / two(np.ones_like(z))


def plain_relief(z, res, low, high, shadow, occlusion, depth, z_factor, s, sun, golden, soft, knob, radius, valley_radius):
    """The stated formulas on arrays; shadow and occlusion are given."""
    clip = lambda a: np.clip(a, 0, 1)
    norm = clip((z - low) / (high - low + 1e-9))
    xs = [t for t, _ in relief.HEIGHT_STOPS]
    img = np.stack([np.interp(norm, xs, [c[k] for _, c in relief.HEIGHT_STOPS]) * 0.94 + relief.PAPER[k] * 0.06 for k in range(3)], -1) / 255
    fine = lambda r: (z - blur(z, r)) / (4 * (np.std(z - blur(z, r)) + 1e-9))
    tex = clip(0.5 + fine(radius))
    if depth:
        many = sum(w * clip(0.5 + fine(radius * t)) for t, w in relief.OCTAVES) / sum(w for _, w in relief.OCTAVES)
        tex = clip(tex + 0.85 * depth * (many - 0.5))
    deep = np.clip(blur(z, valley_radius) - z, 0, None)
    val = clip(deep / (np.percentile(deep, 99) + 1e-9))
    gy, gx = np.gradient(z * z_factor, res)
    slope, aspect = np.pi / 2 - np.arctan(np.hypot(gx, gy)), np.arctan2(-gx, gy)
    lamb = lambda az, alt: clip(np.sin(np.radians(alt)) * np.sin(slope) + np.cos(np.radians(alt)) * np.cos(slope) * np.cos(np.radians(az) - aspect))
    lights = sum(w * lamb(315 + t, 45) for t, w in raster.LIGHTS) / 2.5
    share = 1 - (1 - 0.55 * min(depth, 1)) * (1 - soft)
    light = (0.26 + 0.74 * (lamb(315, 45) ** 1.1 * (1 - share) + lights**1.1 * share)) * (1 - 0.3 * val)
    if s:
        light = np.maximum(light * (1 - 0.45 * s * shadow) * (1 - 0.22 * s * occlusion), 0.12)
    img = img * light[..., None]
    tint = lambda img, w, c: img * (1 - w + np.array(c) * w)
    if s:
        img = tint(img, (0.65 * s * shadow)[..., None], (0.86, 0.94, 1.10))
    if golden and sun:
        shone = lamb(*sun)
        lit, shade = shone**1.4, 1 - shone
        if s:
            lit, shade = lit * (1 - shadow), np.maximum(shade, np.maximum(shadow, occlusion))
        img = tint(tint(img, (0.5 * golden * lit)[..., None], (1.14, 1.02, 0.82)), (0.45 * golden * shade)[..., None], (0.88, 0.94, 1.12))
    img = img * (1 + 0.35 * (tex - 0.5))[..., None]
    haze = np.array(relief.HAZE) / 255
    if depth:
        w = (0.18 * depth * clip(1 - norm) ** 1.5)[..., None]
        img = img * (1 - w) + haze * w
        w = (0.55 * depth * clip((0.16 - norm) / 0.16) * clip(1 - np.abs(tex - 0.5) * 4))[..., None]
        img = img * (1 - w) + np.array(relief.SALT) / 255 * w
    if knob:
        w = (0.30 * knob * clip(1 - norm) ** 1.5)[..., None]
        img = img * (1 - w) + haze * w
    c = clip(img)
    c = c * 0.7 + c * c * (3 - 2 * c) * 0.3
    y = (c @ [0.299, 0.587, 0.114])[..., None]
    return (clip((c - y) * 1.2 + y) * 255).astype(int)


@pytest.mark.parametrize("knobs", [{}, {"depth": 0.8, "soft": 0.5, "z_factor": 2.0}, {"shadow": 0.9, "sun": (240.0, 25.0), "golden": 0.7, "depth": 0.5, "haze_knob": 0.4}])
def test_shaded_relief_is_the_stated_composition(spark, knobs):
    rng = np.random.default_rng(8)
    z = blur(rng.normal(size=(20, 24)), 1.5) * 400 + 300
    cells = spark.createDataFrame([(i, j, float(z[i, j])) for i in range(20) for j in range(24)], "row long, col long, v double")
    low, high = float(z.min()), float(z.max())
    rows = {(r.row, r.col): (r.r, r.g, r.b) for r in relief.shaded_relief(cells, 30.0, low, high, radius=1.0, valley_radius=2.0, **knobs).collect()}
    got = np.array([[rows[i, j] for j in range(24)] for i in range(20)])
    dark = {(r.row, r.col): (r.shadow, r.occlusion) for r in relief.shadow_terms(cells, 30.0, 30.0, *knobs.get("sun", (315.0, 45.0)), knobs.get("z_factor", 1.0)).collect()}
    shadow, occlusion = (np.array([[dark[i, j][k] for j in range(24)] for i in range(20)]) for k in (0, 1))
    k = {"depth": 0.0, "z_factor": 1.0, "sun": None, "golden": 0.0, "soft": 0.0} | knobs
    want = plain_relief(z, 30.0, low, high, shadow, occlusion, k["depth"], k["z_factor"], k.get("shadow", 0.0), k["sun"], k["golden"], k["soft"], k.get("haze_knob", 0.0), 1.0, 2.0)
    assert np.abs(got - want).max() <= 1 and (got == want).mean() > 0.98


def test_shaded_relief_follows_the_light_and_fills_holes(spark):
    """A ridge is brighter on the side of the sun; heights count z_factor times."""
    cells = spark.createDataFrame([(i, j, None if (i, j) == (3, 3) else 30.0 * (10 - abs(j - 10))) for i in range(16) for j in range(21)], "row long, col long, v double")
    rows = {(r.row, r.col): r for r in relief.shaded_relief(cells, 30.0, 0.0, 300.0, azimuth=270, radius=1.0, valley_radius=2.0).collect()}
    assert len(rows) == 16 * 21 and all(0 <= c <= 255 for r in rows.values() for c in (r.r, r.g, r.b))
    assert rows[8, 6].r > rows[8, 14].r
    flat = {(r.row, r.col): r for r in relief.shaded_relief(cells, 30.0, 0.0, 300.0, azimuth=270, z_factor=0.0, radius=1.0, valley_radius=2.0).collect()}
    assert abs(flat[8, 6].r - flat[8, 14].r) <= 1


def test_points_at_are_as_of_the_next_end(spark):
    """Against a search along each track, with repeated points, ends and tracks of one point."""
    rng = np.random.default_rng(4)
    tracks = [("d", [(0, 0), (0, 0), (3, 4), (3, 4), (3, 4), (9, 12), (9, 12)]), ("d", [(float(x), float(y)) for x, y in rng.integers(0, 9, (30, 2))]), ("d", [(1, 1)]), ("d", [(2, 2), (2, 2)])]
    points = track(spark, *tracks)
    wanted = [(f"t{k}", s) for k in range(5) for s in (-1.0, 0.0, 2.5, 5.0, 5.0, 7.0, 15.0, 1e9)]
    got = {(r.track_id, r.s): (r.x, r.y, r.angle) for r in journeys.points_at(points, spark.createDataFrame(wanted, "track_id string, s double")).collect()}
    want = {}
    for k, (_, pts) in enumerate(tracks):
        cum = [0.0]
        for a, b in zip(pts, pts[1:], strict=False):
            cum.append(cum[-1] + math.hypot(b[0] - a[0], b[1] - a[1]))
        for _, s in (w for w in wanted if w[0] == f"t{k}" and len(pts) > 1):
            at = min(max(s, 0.0), cum[-1])
            i = next(i for i in range(len(pts) - 1) if cum[i + 1] >= at)
            (xa, ya), (xb, yb) = pts[i], pts[i + 1]
            u = (at - cum[i]) / (cum[i + 1] - cum[i]) if cum[i + 1] > cum[i] else 0.0
            want[f"t{k}", s] = (xa + (xb - xa) * u, ya + (yb - ya) * u, math.atan2(yb - ya, xb - xa))
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    plan = journeys.points_at(points, spark.createDataFrame(wanted, "track_id string, s double"))
    assert plan._jdf.queryExecution().executedPlan().toString().count("Join") == 1, "the only join is with one row a track"


def test_sums_before_are_dealt_in_ranges(spark):
    """Names with one beginning, and all of one day, are dealt to many tasks."""
    rows = spark.range(5000).select(F.concat(F.lit("track-2024-"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("track_id"), F.lit("2024-01-01").alias("day"), F.col("id"))
    done = journeys.with_sum_before(rows.repartition(7), ["day", "track_id"], F.lit(2), "before")
    assert all(r.before == 2 * r.id for r in done.collect())
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so few rows would be put together again
    dealt = rows.repartitionByRange("day", "track_id").groupBy(F.spark_partition_id()).count().collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(dealt) >= 3 and max(r["count"] for r in dealt) < 2 * 5000 / len(dealt)


def test_bundle_digest_streams(spark):
    import hashlib

    rows = [(b, f"n{i}", f"s{i * 7 % 11}") for b, n in (("big", 3000), ("one", 1), (None, 4)) for i in range(n)]
    got = {r.bundle: r.digest for r in assets.bundle_digest(spark.createDataFrame(rows, "bundle string, name string, sha string").repartition(5)).collect()}
    want = {b: hashlib.sha256("\n".join(sorted(f"{n}:{s}" for x, n, s in rows if x == b)).encode()).hexdigest()[:12] for b in ("big", "one", None)}
    assert got == want
    assert assets.bundle_digest(spark.createDataFrame([], "bundle string, name string, sha string")).count() == 0


def test_rivers_by_their_longest_run(spark):
    rows = [(1, "R", i, x, 5.0) for i, x in enumerate([1, 2, -5, 3, 4, 5, -9, 6])] + [(2, "R", i, float(i), 5.0) for i in range(3)] + [(3, "S", 0, -1.0, 5.0), (4, " ", 0, 1.0, 1.0), (5, "T", 0, None, 5.0), (5, "T", 1, 2.0, 5.0)]
    features = spark.createDataFrame([(a, b, c, None if d is None else float(d), e) for a, b, c, d, e in rows], "id long, name string, vidx long, x double, y double")
    got = {r.name: (r.id, r.first, r.n, r.x) for r in places.longest_runs(features, 10.0, 10.0).collect()}
    assert got == {"R": (1, 3, 3, 4.0), "T": (5, 1, 1, 2.0)}


def test_nested_documents_are_read(spark):
    schema = "version INT, edition INT, spec STRUCT<title: STRING, crop: ARRAY<DOUBLE>, film: STRUCT<frames: INT, step_ms: INT>, tracks: ARRAY<STRUCT<id: STRING, at: DECIMAL(10,2)>>>"
    defaults = {"edition": F.lit(1), "spec.title": F.lit(""), "spec.film.step_ms": F.lit(120)}
    texts = ['{"version": 1, "spec": {"crop": [1, 2], "film": {"frames": 9}, "new": 1, "tracks": [{"id": "a", "at": 1.25, "x": 0}]}}', '{"version": "one", "edition": 3, "spec": {"title": 5}}', '{"spec": 4}', "{}", "[1]", "no", None, "3"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.s for r in rows.select("i", sheets.parsed(F.col("t"), schema, defaults).alias("s")).collect()}
    assert got[0].asDict(True)["spec"] == {"title": "", "crop": [1.0, 2.0], "film": {"frames": 9, "step_ms": 120}, "tracks": [{"id": "a", "at": Decimal("1.25")}]} and got[0].edition == 1
    assert (got[1].version, got[1].edition, got[1].spec.title, got[1].spec.film) == (None, 3, "5", None)
    assert (got[2].edition, got[2].spec) == (1, None) and (got[3].edition, got[3].spec) == (1, None)
    assert [got[i] for i in (4, 5, 6, 7)] == [None] * 4


def test_wide_blur_keeps_level_ground_level(spark):
    cells = spark.createDataFrame([(i, j, 5.0) for i in range(24) for j in range(24)], "row long, col long, v double")
    assert {round(r.blurred, 9) for r in relief.wide_gaussian(cells, 9.0).collect()} == {5.0}


def test_target_grid_bounds_all_edges(spark):
    box = spark.createDataFrame([("r", -121.6, 40.2, -120.9, 40.7), ("tiny", -121.0, 40.0, -120.999, 40.001)], "id string, w double, s double, e double, n double")
    r = {x.id: x for x in geodesy.target_grid(box, "id", 10, 10.0).collect()}
    g = r["r"]
    assert g.x0 % 10 == g.y0 % 10 == 0 and (g.x1, g.y1) == (g.x0 + 10 * g.cols, g.y0 + 10 * g.rows)
    edge = [(-121.6 + 0.7 * i / 40, lat) for i in range(41) for lat in (40.2, 40.7)] + [(lon, 40.2 + 0.5 * i / 40) for i in range(41) for lon in (-121.6, -120.9)]
    x, y = geodesy.utm(F.col("lon"), F.col("lat"), 10)
    at = spark.createDataFrame(edge, "lon double, lat double").select(x.alias("x"), y.alias("y")).collect()
    xs, ys = [p.x for p in at], [p.y for p in at]
    assert abs(g.x0 - min(xs) - 500) <= 5 and abs(g.y0 - min(ys) - 500) <= 5
    assert 0 <= max(xs) - 500 - g.x1 < 10 and 0 <= max(ys) - 500 - g.y1 < 10
    assert (r["tiny"].cols, r["tiny"].rows) == (0, 0)


def test_slopes_that_face_the_sun_are_the_brightest(spark):
    """A cone, lit from each quarter: the brightest of its four sides is the one towards the sun."""
    cells = spark.createDataFrame([(i, j, -float(math.hypot(i - 10, j - 10))) for i in range(21) for j in range(21)], "row long, col long, v double")
    sides = {0.0: (4, 10), 90.0: (10, 16), 180.0: (16, 10), 270.0: (10, 4)}
    for azimuth, side in sides.items():
        shade = {(r.row, r.col): r.shade for r in raster.hillshade(cells, 1.0, azimuth).collect() if (r.row, r.col) in sides.values()}
        assert max(shade, key=shade.get) == side


def test_zone_of_a_padded_box_whose_middle_is_on_the_border(spark, tmp_path):
    """lon -120 exactly: the order of the sum decides, as in the SQL; sf0.01 has no such event."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    from terravia import catalog
    from tests.conftest import same

    events = duck("/root/testdata/sf0.1").sql("SELECT * FROM events WHERE event_id IN (21295, 25495, 33895, 35700, 300)").df()
    pq.write_table(pa.Table.from_pandas(events, preserve_index=False), tmp_path / "events.parquet", coerce_timestamps="us")
    plan = catalog.entries()["bbox_plan"]
    same(plan.query(spark, str(tmp_path)), duck(str(tmp_path)), plan.oracle)


def test_aspect_on_the_cut_has_the_side_of_the_sql(spark):
    """Three rows that fall along rows only: dx is 0.0, or -0.0 where a negative zero lies on the right."""
    import pandas as pd

    from terravia.plans.raster import RES, SLOPE

    flat = [(r, c, 300.0 - 100.0 * r) for r in range(3) for c in range(3)]
    signed = [(r, c + 10, (-0.0 if c == 2 else 0.0) if r == 1 else 100.0 * (1 - r)) for r in range(3) for c in range(3)]
    cells = flat + signed
    got = {(r.row, r.col): r.aspect for r in raster.slope_aspect(spark.createDataFrame(cells, "row long, col long, v double"), RES).collect()}
    con = duck(fx_filled=pd.DataFrame(cells, columns=["row", "col", "v"]))
    want = {(r, c): a for r, c, a in con.sql(f"WITH {SLOPE} SELECT row, col, aspect FROM sl").fetchall()}
    assert got == pytest.approx(want, abs=1e-12)
    assert got[1, 1] == -math.pi and got[1, 11] == math.pi
