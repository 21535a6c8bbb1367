"""Queries on compositions, their files and their films."""

from pyspark.sql import functions as F

from terravia import fixtures as fx
from terravia.catalog import register
from terravia.fixtures import oracle
from terravia.operators import sheets as S

_GOOD = "isfinite(x1) AND x1 > x0"
_FINAL = "CASE WHEN kind = 'wallpaper' THEN ppi ELSE 300.0::DOUBLE END"


def _specs(spark, d):
    return fx.specs(spark, d)


def _good(spark, d):
    return fx.specs(spark, d).where("NOT isnan(x1) AND x1 > x0")


@register(
    "sheet_geometry",
    oracle("fx_specs", body=f"""g AS (SELECT *, bleed * (x1 - x0) / print_w AS b, CAST(round_even(bleed * 300, 0) AS BIGINT) AS cut, CAST(round_even((print_w + 2 * bleed) * 300, 0) AS BIGINT) AS w, CAST(round_even((print_h + 2 * bleed) * 300, 0) AS BIGINT) AS h FROM fx_specs WHERE {_GOOD})
  SELECT k, round(x0 - b, 4) AS px0, round(y0 - b, 4) AS py0, round(x1 + b, 4) AS px1, round(y1 + b, 4) AS py1, print_w + 2 * bleed AS paint_w, cut AS trim_x0, w - cut AS trim_x1, h - cut AS trim_y1,
   round((x1 - x0) / greatest(1, round_even(print_w * 300, 0)), 6) AS ground FROM g"""),
)
def sheet_geometry(spark, d):
    g = S.sheet_geometry(_good(spark, d), 300.0)
    edge = lambda c: F.round(f"paint.{c}", 4).alias(f"p{c}")
    return g.select("k", *map(edge, ("x0", "y0", "x1", "y1")), F.col("paint.print_w").alias("paint_w"), F.col("trim.x0").alias("trim_x0"), F.col("trim.x1").alias("trim_x1"), F.col("trim.y1").alias("trim_y1"), F.round(S.ground_per_pixel(F.lit(300.0)), 6).alias("ground"))


@register(
    "sheet_resolutions",
    oracle("fx_specs", body=f"""SELECT k, {_FINAL} AS final, round({_FINAL} * 96.0::DOUBLE / 300.0::DOUBLE, 6) AS proof,
  round(least(CASE WHEN kind = 'print' THEN 200.0::DOUBLE ELSE {_FINAL} END, sqrt(40000000.0::DOUBLE / ((print_w + 2 * bleed) * (print_h + 2 * bleed))), {_FINAL}), 6) AS refine FROM fx_specs"""),
)
def sheet_resolutions(spark, d):
    return _specs(spark, d).select("k", S.final_dpi().alias("final"), F.round(S.proof_dpi(), 6).alias("proof"), F.round(S.refine_dpi(), 6).alias("refine"))


@register(
    "scale_bar",
    oracle("fx_specs", body=f"""g AS (SELECT k, (x1 - x0) / (print_w * 300.0::DOUBLE) AS gpp FROM fx_specs WHERE {_GOOD}),
  e AS (SELECT k, gpp, mi FROM g, (SELECT unnest([{", ".join(f"{m}::DOUBLE" for m in S.NICE_MILES)}]) AS mi)),
  r AS (SELECT k, mi, mi * 1609.344::DOUBLE / gpp AS px, row_number() OVER (PARTITION BY k ORDER BY abs(mi * 1609.344::DOUBLE / gpp - 1.9::DOUBLE * 300.0::DOUBLE), mi) AS n FROM e)
  SELECT k, mi AS miles, round(px, 3) AS px FROM r WHERE n = 1"""),
)
def scale_bar(spark, d):
    return _good(spark, d).select("k", S.scale_bar(F.lit(300.0)).alias("b")).select("k", "b.miles", F.round("b.px", 3).alias("px"))


@register(
    "terrain_depth",
    oracle("fx_specs", body=f"""t AS (SELECT k, (x1 - x0) / (print_w * 96.0::DOUBLE) AS res, least(1, greatest(0, ((x1 - x0) / (print_w * 0.0254::DOUBLE) - 150000.0::DOUBLE) / 280000.0::DOUBLE)) AS t FROM fx_specs WHERE {_GOOD})
  SELECT k, round(t * t * (3 - 2 * t) * 0.8::DOUBLE, 6) AS depth, round(res, 6) AS shadow_res_m FROM t"""),
)
def terrain_depth(spark, d):
    return _good(spark, d).select("k", F.round(S.terrain_depth(F.lit(0.8)), 6).alias("depth"), F.round(S.shadow_res_m(), 6).alias("shadow_res_m"))


_SIZED = f"""v AS (SELECT *, {_FINAL} AS dpi, round_even((print_w + 2 * bleed) * {_FINAL}, 0) AS w, round_even((print_h + 2 * bleed) * {_FINAL}, 0) AS h, x1 - x0 AS cw, y1 - y0 AS ch FROM fx_specs)"""
_ERROR = """CASE WHEN NOT isfinite(x1) OR NOT isfinite(y1) THEN 'crop_not_finite' WHEN kind NOT IN ('print', 'wallpaper') THEN 'output_kind' WHEN kind = 'wallpaper' AND NOT ppi BETWEEN 72 AND 600 THEN 'screen_ppi'
  WHEN NOT top_clear BETWEEN 0 AND 0.35::DOUBLE THEN 'top_clear' WHEN bleed > 0 AND kind <> 'print' THEN 'bleed_kind' WHEN w * h > 120000000 THEN 'too_large'
  WHEN NOT track_width_pt BETWEEN 0.8::DOUBLE AND 6 THEN 'track_width_pt' WHEN light_mode NOT IN ('archival', 'journey') THEN 'light_mode' WHEN NOT edition BETWEEN 1 AND 999 THEN 'edition'
  WHEN length(credit) > 200 THEN 'credit_length' WHEN NOT regexp_full_match(credit, '[ -~]*') THEN 'credit_charset' WHEN track_rgb[1] > 255 THEN 'track_rgb' WHEN NOT (cw > 0 AND ch > 0) THEN 'crop_empty'
  WHEN abs(cw / ch - print_w / print_h) / (print_w / print_h) > 0.02::DOUBLE THEN 'aspect'
  WHEN least(cw / greatest(1, round_even(print_w * dpi, 0)), ch / greatest(1, round_even(print_h * dpi, 0))) < native_m THEN 'zoom' END"""


@register("sheet_validate", oracle("fx_specs", body=f"{_SIZED} SELECT k, {_ERROR} AS error FROM v"))
def sheet_validate(spark, d):
    return S.validate(_specs(spark, d)).select("k", "error")


@register(
    "manifest_admit",
    oracle("fx_specs", body=f"""{_SIZED} SELECT k, CASE WHEN k % 13 = 0 THEN 'shape' WHEN k % 17 = 0 THEN 'spots' ELSE {_ERROR} END AS error, CAST(CASE WHEN k % 17 = 0 THEN 65 WHEN k % 3 = 0 THEN 0 ELSE 1 END AS BIGINT) AS photos FROM v"""),
)
def manifest_admit(spark, d):
    k = F.col("k")
    point = F.when(k % 13 == 0, F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0))).otherwise(F.array(F.lit(1.0), F.lit(2.0)))
    photo = F.when((k % 3 == 0) & (k % 17 != 0), F.concat(F.lit("/srv/photos/"), k.cast("string"))).otherwise(F.concat(F.lit(S.PHOTO), F.base64(F.encode(k.cast("string"), "UTF-8"))))
    spot = F.struct(F.lit("here").alias("label"), photo.alias("photo"))
    specs = _specs(spark, d).withColumns({"tracks": F.array(F.array(point, point), F.array(point)), "spots": F.array_repeat(spot, F.when(k % 17 == 0, 65).otherwise(1))})
    return S.admit(specs).select("k", "error", F.size(F.filter("spots", lambda s: s["photo"].isNotNull())).cast("long").alias("photos"))


_BY = "CASE k % 6 WHEN 0 THEN '10' WHEN 1 THEN '500' WHEN 2 THEN 'abc' WHEN 3 THEN NULL WHEN 4 THEN '-3' ELSE '20000' END"


@register(
    "film_pacing",
    oracle("fx_specs", body=f"""p AS (SELECT k, TRY_CAST({_BY} AS INTEGER) AS n, print_w, print_h, bleed, kind, ppi FROM fx_specs)
  SELECT k, least(greatest(coalesce(n, 40), 2), 120) AS max_frames, least(greatest(coalesce(n, 220), 40), 10000) AS step_ms, CASE WHEN n > 0 AND n <= 600 THEN CAST(n AS DOUBLE) ELSE {_FINAL} END AS dpi,
   CASE WHEN n BETWEEN 2 AND 120 THEN CASE WHEN n BETWEEN 40 AND 10000 THEN NULL ELSE 'step_ms' END ELSE 'max_frames' END AS error,
   120 * round_even((print_w + 2 * bleed) * 96, 0) * round_even((print_h + 2 * bleed) * 96, 0) > 600000000 AS too_large FROM p"""),
)
def film_pacing(spark, d):
    r = F.col("k") % 6
    v = F.when(r == 0, "10").when(r == 1, "500").when(r == 2, "abc").when(r == 4, "-3").when(r == 5, "20000")
    two = {n: v for n in S.PACING}
    rows = _specs(spark, d).select("k", S.pacing(two).alias("p"), S.film_dpi(v).alias("dpi"), S.pacing_error(two).alias("error"), S.film_too_large(F.lit(120), F.lit(96.0)).alias("too_large"))
    return rows.select("k", "p.max_frames", "p.step_ms", "dpi", "error", "too_large")


@register(
    "embedded_photos",
    "SELECT doc_id, doc_id % 3 = 0 AND octet_length(encode(coalesce(text, ''))) BETWEEN 1 AND 2000 AS stays FROM documents",
)
def embedded_photos(spark, d):
    docs = fx.table(spark, d, "documents")
    data = F.regexp_replace(F.base64(F.encode(F.coalesce("text", F.lit("")), "UTF-8")), "[\r\n]", "")
    photo = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit(S.PHOTO), data)).when(F.col("doc_id") % 3 == 1, F.concat(F.lit(S.PHOTO), F.lit("%%%"))).otherwise("../photo.jpg")
    return docs.select("doc_id", S.embedded_photo(photo, 2000).isNotNull().alias("stays"))


@register(
    "manifest_json",
    """SELECT o_orderkey, '{' || CASE WHEN e >= 2 THEN '"edition":' || e || ',' ELSE '' END || '"engine":"terravia","engine_version":"1",' || CASE WHEN e >= 2 THEN '"lineage":[' || array_to_string(range(CASE WHEN n > 100 THEN n - 99 ELSE 1 END, n + 1), ',') || '],' ELSE '' END
   || '"manifest_version":1,"region_id":"' || o_orderstatus || '","sources":[{"bytes":' || n || ',"filename":"a.gpx"}],"spec":{"seed":7,"title_text":"t\\"' || e || '"}}' AS text
  FROM (SELECT o_orderkey, o_orderstatus, CAST(o_orderkey % 5 AS INTEGER) AS e, 1 + o_orderkey % 130 AS n FROM orders)""",
)
def manifest_json(spark, d):
    o = fx.table(spark, d, "orders").select("o_orderkey", "o_orderstatus", (F.col("o_orderkey") % 5).cast("int").alias("e"), (1 + F.col("o_orderkey") % 130).alias("n"))
    sources = F.array(F.struct(F.col("n").alias("bytes"), F.lit("a.gpx").alias("filename")))
    spec = F.struct(F.lit(7).alias("seed"), F.concat(F.lit('t"'), F.col("e").cast("string")).alias("title_text"))
    return o.select("o_orderkey", S.manifest(1, "terravia", F.lit("1"), F.col("o_orderstatus"), spec, sources, F.col("e"), F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("text"))


@register(
    "json_drift",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 4 <> 3 THEN o_orderkey % 7 END AS seed, CASE o_orderkey % 4 WHEN 0 THEN 'title' WHEN 3 THEN NULL ELSE '' END AS title,
   CASE o_orderkey % 4 WHEN 1 THEN 'journey' WHEN 3 THEN NULL ELSE 'archival' END AS light FROM orders""",
)
def json_drift(spark, d):
    k = F.col("o_orderkey")
    seed = F.concat(F.lit('"seed":'), (k % 7).cast("string"))
    text = F.when(k % 4 == 0, F.concat(F.lit("{"), seed, F.lit(',"title":"title","colour":[1,2],"gone":null}'))).when(k % 4 == 1, F.concat(F.lit('{"light":"journey",'), seed, F.lit("}"))).when(k % 4 == 2, F.concat(F.lit("{"), seed, F.lit("}"))).otherwise("{not json")
    schema, usual = "seed BIGINT, title STRING, light STRING", {"title": F.lit(""), "light": F.lit("archival")}
    return fx.table(spark, d, "orders").select("o_orderkey", S.parsed(text, schema, usual).alias("s")).select("o_orderkey", "s.*")


@register(
    "json_round_trip",
    oracle("fx_users", body="SELECT track_id, count(*) AS n, count(*) FILTER (event_id % 5 = 0) AS unknown, round(sum(CASE WHEN event_id % 5 <> 0 THEN t ELSE 0 END), 3) AS total FROM fx_users GROUP BY track_id"),
)
def json_round_trip(spark, d):
    p = fx.points(spark, d, by_user=True)
    t = F.when(F.col("event_id") % 5 == 0, float("nan")).otherwise(F.col("t"))
    rows = p.groupBy("track_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("vidx", t.alias("t")))), lambda s: s["t"]).alias("times"))
    text = rows.select("track_id", F.to_json(F.struct(S.nan_to_null(F.col("times")).alias("times"))).alias("j"))
    back = text.select("track_id", S.null_to_nan(F.from_json("j", "times ARRAY<DOUBLE>")["times"]).alias("times"))
    known = F.filter("times", lambda v: ~F.isnan(v))
    return back.select("track_id", F.size("times").cast("long").alias("n"), (F.size("times") - F.size(known)).cast("long").alias("unknown"), F.round(F.aggregate(known, F.lit(0.0), lambda a, v: a + v), 3).alias("total"))


DEVICES = [("phone", 1170, 2532, 460.0), ("desk", 2560, 1440, 109.0)]


@register(
    "preset_refit",
    oracle("fx_specs", body="p(id, pw, ph, dp) AS (VALUES " + ", ".join(f"('{i}', {w}, {h}, {p}::DOUBLE)" for i, w, h, p in DEVICES) + f"""),
  j AS (SELECT *, pw / CAST(ph AS DOUBLE) AS a, (x0 + x1) / 2 AS cx, (y0 + y1) / 2 AS cy, greatest((x1 - x0) * (y1 - y0), 1.0::DOUBLE) AS area FROM fx_specs, p WHERE {_GOOD}),
  w AS (SELECT *, least(greatest(sqrt(area * a), native_m * pw * 1.000001::DOUBLE), 62000.0::DOUBLE, 77190.0::DOUBLE * a) AS w FROM j),
  s AS (SELECT *, least(greatest(cx - w / 2, 664030.0::DOUBLE), 726030.0::DOUBLE - w) AS nx, least(greatest(cy - w / a / 2, 4447820.0::DOUBLE), 4525010.0::DOUBLE - w / a) AS ny FROM w)
  SELECT k, id, round(nx, 3) AS x0, round(ny, 3) AS y0, round(w, 3) AS wide, round(pw / dp, 6) AS print_w, dp AS ppi FROM s"""),
)
def preset_refit(spark, d):
    presets = spark.createDataFrame(DEVICES, "id string, px_w int, px_h int, dev_ppi double")
    bounds = tuple(map(F.lit, fx.BOUNDS))
    done = S.for_presets(_good(spark, d), presets, bounds)
    return done.select("k", "id", F.round("x0", 3).alias("x0"), F.round("y0", 3).alias("y0"), F.round(F.col("x1") - F.col("x0"), 3).alias("wide"), F.round("print_w", 6).alias("print_w"), "ppi")


@register(
    "captions",
    """SELECT o_orderkey AS k, upper(replace(name, '_', ' ')) || ' — EDITION ' || CASE WHEN ed IS NULL OR ed IN ('', '0') THEN '1' ELSE CAST(TRY_CAST(ed AS INTEGER) AS VARCHAR) END AS caption
  FROM (SELECT o_orderkey, coalesce(nullif(trim(CASE o_orderkey % 4 WHEN 0 THEN '  High_' || o_orderpriority || ' ' WHEN 1 THEN '   ' WHEN 2 THEN NULL ELSE '' END), ''), nullif(CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'dry_' || o_orderstatus END, '')) AS name,
    CASE o_orderkey % 6 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN '0' WHEN 3 THEN 'two' ELSE CAST(o_orderkey % 9 AS VARCHAR) END AS ed FROM orders)""",
)
def captions(spark, d):
    k = F.col("o_orderkey")
    title = F.when(k % 4 == 0, F.concat(F.lit("  High_"), "o_orderpriority", F.lit(" "))).when(k % 4 == 1, "   ").when(k % 4 == 3, "")
    region = F.when(k % 5 == 1, "").when(k % 5 > 1, F.concat(F.lit("dry_"), "o_orderstatus"))
    edition = F.when(k % 6 == 1, "").when(k % 6 == 2, "0").when(k % 6 == 3, "two").when(k % 6 > 3, (k % 9).cast("string"))
    return fx.table(spark, d, "orders").select(k.alias("k"), S.caption(title, region, edition).alias("caption"))


@register(
    "place_lists",
    """WITH n AS (SELECT n_regionkey, list(n_name ORDER BY n_nationkey) AS names FROM nation WHERE n_nationkey % 2 = 0 GROUP BY n_regionkey)
  SELECT r_regionkey, r_name || CASE WHEN len(names) > 0 THEN ' - ' || array_to_string(names[1:4], ', ') ELSE '' END AS places FROM region LEFT JOIN n ON r_regionkey = n_regionkey""",
)
def place_lists(spark, d):
    names = fx.table(spark, d, "nation").where("n_nationkey % 2 = 0").groupBy("n_regionkey").agg(F.transform(F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda s: s["n_name"]).alias("names"))
    r = fx.table(spark, d, "region").join(names, F.col("r_regionkey") == F.col("n_regionkey"), "left")
    return r.select("r_regionkey", S.place_list(F.col("r_name"), F.coalesce("names", F.array().cast("array<string>"))).alias("places"))
