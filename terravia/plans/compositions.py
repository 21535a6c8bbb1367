"""Queries on compositions and recordings as JSON."""

from pyspark.sql import functions as F

from terravia import fixtures as fx
from terravia.catalog import register
from terravia.fixtures import oracle
from terravia.operators import compositions as C
from terravia.operators import sheets as S
from terravia.plans.sheets import _ERROR, _SIZED


def _full(spark, d):
    """Compositions with nested tracks and spots."""
    k = F.col("k")
    point = lambda i: F.array((k * 3 + i).cast("double") / 7, (k + 2 * i).cast("double"))
    tracks = F.array(F.transform(F.sequence(F.lit(0), (k % 4).cast("int")), point), F.array(point(F.lit(9)), point(F.lit(10))))
    photo = F.when(k % 3 == 0, F.concat(F.lit("/srv/"), k.cast("string"))).otherwise(F.concat(F.lit(S.PHOTO), F.base64(F.encode(k.cast("string"), "UTF-8"))))
    spot = F.struct((k * 1.5).alias("x"), F.lit(2.0).alias("y"), F.lit(1.0).alias("weight"), F.lit('say "hé" \\ there').alias("label"), F.lit("flag").alias("icon"), photo.alias("photo"))
    rows = fx.specs(spark, d).withColumns({"region_id": F.lit("hills"), "crs": F.lit("EPSG:32610"), "tracks": tracks, "spots": F.array(spot)})
    # JSON has no NaN
    return rows.withColumn("x1", F.when(~F.isnan("x1"), F.col("x1")))


@register(
    "composition_round_trip",
    oracle("fx_specs", body="""SELECT k, print_w, bleed, kind, ppi, edition, credit, track_rgb[1] AS red, CASE WHEN isnan(x1) THEN NULL ELSE x1 END AS x1, 7 AS seed, CAST(k % 4 + 3 AS BIGINT) AS vertices,
    round((k * 3 + k % 4) / 7.0::DOUBLE + (k * 3 + 10) / 7.0::DOUBLE, 9) AS ends, k * 1.5::DOUBLE AS spot_x, 'say "hé" \\ there' AS label, 'mat' AS frame FROM fx_specs"""),
)
def composition_round_trip(spark, d):
    """A whole composition, nested, to a manifest's text and back."""
    rows = _full(spark, d)
    text = F.to_json(F.struct(F.lit(1).alias("manifest_version"), F.lit("x").alias("later"), C.spec_struct(rows).alias("spec")))
    back = C.from_manifest(rows.select("k", text.alias("manifest")))
    last = lambda i: F.element_at(F.element_at("tracks", i), -1)[0]
    return back.where("NOT malformed").select(
        "k", "print_w", "bleed", "kind", "ppi", "edition", "credit", F.col("track_rgb")[0].alias("red"), "x1", F.col("seed").cast("int").alias("seed"), F.aggregate("tracks", F.lit(0).cast("long"), lambda a, t: a + F.size(t)).alias("vertices"),
        F.round(last(1) + last(2), 9).alias("ends"), F.col("spots")[0]["x"].alias("spot_x"), F.col("spots")[0]["label"].alias("label"), F.col("photo_frame_style").alias("frame"),
    )


@register(
    "manifest_door",
    oracle("fx_specs", body=f"""{_SIZED} SELECT k, CASE WHEN k % 8 IN (1, 2, 3, 4) THEN 'malformed' WHEN k % 16 = 5 THEN 'shape' ELSE {_ERROR} END AS error,
    CASE WHEN k % 8 IN (1, 2, 3, 4) THEN NULL WHEN k % 8 = 6 OR k % 3 = 0 THEN 0 ELSE 1 END AS photos FROM v"""),
)
def manifest_door(spark, d):
    """Manifests as text from outside: some no JSON, some without a composition, some hostile, some of an older writer."""
    k = F.col("k")
    rows = _full(spark, d)
    bad = F.array(F.array(F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0))))
    rows = rows.withColumn("tracks", F.when(k % 16 == 5, bad).otherwise(F.col("tracks"))).withColumn("x1", F.when(k % 16 == 5, F.coalesce("x1", F.lit(0.0))).otherwise(F.col("x1")))
    whole = C.spec_struct(rows)
    text = lambda spec: F.to_json(F.struct(F.lit(1).alias("manifest_version"), spec.alias("spec")))
    older = F.to_json(F.struct(F.lit(1).alias("manifest_version"), whole.dropFields("hotspots").alias("spec")))
    # as later writers might: a spot list that is a number, and a field that nobody knows
    hostile = F.replace(older, F.lit('"spec":{'), F.lit('"spec":{"hotspots":5,"unknown":{"a":[1]},'))
    made = (
        F.when(k % 8 == 1, F.lit("not json at all")).when(k % 8 == 2, F.lit('{"manifest_version":1}')).when(k % 8 == 3, F.lit('{"spec":7}'))
        .when(k % 8 == 4, text(whole.dropFields("tracks"))).when(k % 8 == 6, hostile).otherwise(text(whole))
    )
    done = C.admitted(rows.select("k", made.alias("manifest")))
    photos = F.size(F.filter("spots", lambda s: s["photo"].isNotNull()))
    return done.select("k", "error", F.when(F.coalesce(F.col("error"), F.lit("")) != "malformed", photos).alias("photos"))


@register(
    "track_round_trip",
    oracle("fx_users", body="""SELECT track_id, count(*) AS n, round(sum(x), 3) AS sx, round(sum(CASE WHEN event_id % 5 > 0 THEN t END), 3) AS st, count(*) FILTER (event_id % 5 = 0) AS untimed, CAST(min(day) AS VARCHAR) AS day, CASE WHEN CAST(track_id AS INTEGER) % 2 = 0 THEN max(ele) END AS summit FROM fx_users GROUP BY track_id"""),
)
def track_round_trip(spark, d):
    """Each recording as a document and back; a fifth of its vertices have no time, half of the recordings no summit."""
    v = F.struct("vidx", "x", "y", F.when(F.col("event_id") % 5 > 0, F.col("t")).otherwise(float("nan")).alias("t"))
    per = fx.points(spark, d, by_user=True).groupBy("track_id").agg(F.sort_array(F.collect_list(v)).alias("v"), F.min("day").alias("day"), F.max("ele").alias("top"))
    even = F.col("track_id").cast("int") % 2 == 0
    tracks = per.select("track_id", F.transform("v", lambda p: F.array(p["x"], p["y"])).alias("coords"), "day", F.transform("v", lambda p: p["t"]).alias("coords_t"), F.when(even, F.lit("2024-01-01T00:00:00Z")).alias("summit_t"), F.col("top").alias("summit_ele"))
    back = tracks.select(C.track_rows(C.track_json(tracks)).alias("t")).select("t.*")
    total = lambda values, f: F.aggregate(values, F.lit(0.0), lambda a, p: a + f(p))
    timed = F.filter("coords_t", lambda t: ~F.isnan(t))
    return back.select("track_id", F.size("coords").cast("long").alias("n"), F.round(total(F.col("coords"), lambda p: p[0]), 3).alias("sx"), F.round(total(timed, lambda t: t), 3).alias("st"), (F.size("coords_t") - F.size(timed)).cast("long").alias("untimed"), "day", F.col("summit_ele").alias("summit"))
