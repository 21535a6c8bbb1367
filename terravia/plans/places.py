"""Queries on places and regions."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from terravia import fixtures as fx
from terravia.catalog import register
from terravia.fixtures import oracle
from terravia.operators import journeys as J
from terravia.operators import places as P
from terravia.plans.journeys import VISITS

INB = "inb AS (SELECT region_id, count(track_id) AS n FROM fx_regions LEFT JOIN fx_points ON x BETWEEN min_x AND max_x AND y BETWEEN min_y AND max_y GROUP BY region_id)"


@register("in_bounds_by_region", oracle("fx_points", "fx_regions", body=INB + " SELECT * FROM inb"))
def in_bounds_by_region(spark, d):
    return P.in_bounds(fx.points(spark, d), fx.regions(spark, d))


@register("best_region", oracle("fx_points", "fx_regions", body=INB + " SELECT * FROM inb WHERE n > 0 ORDER BY n DESC, region_id LIMIT 1"))
def best_region(spark, d):
    return P.best_region(fx.points(spark, d), fx.regions(spark, d))


@register(
    "outside_plate",
    oracle("fx_points", "fx_regions", body="""bx AS (SELECT track_id, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM fx_points GROUP BY track_id)
  SELECT region_id, count(*) FILTER (x0 < min_x OR x1 > max_x OR y0 < min_y OR y1 > max_y) AS tracks_outside FROM bx, fx_regions GROUP BY region_id"""),
)
def outside_plate(spark, d):
    return P.outside(fx.points(spark, d), fx.regions(spark, d))


@register(
    "hotspot_topk_spaced",
    oracle(
        "fx_points",
        body=VISITS + """, cand AS (SELECT gy, gx, visits, 664030.0::DOUBLE + (gx + 0.5::DOUBLE) * 1000 AS x, 4525010.0::DOUBLE - (gy + 0.5::DOUBLE) * 1000 AS y, row_number() OVER (ORDER BY visits DESC, gy * 62 + gx DESC) AS o FROM visits),
  pick(k, o, xs, ys, os) AS (
    SELECT 1, o, [x], [y], [o] FROM cand WHERE o = 1
    UNION ALL
    SELECT k + 1, c.o, list_append(xs, c.x), list_append(ys, c.y), list_append(os, c.o) FROM pick p, cand c
    WHERE k < 7 AND c.o = (SELECT min(c2.o) FROM cand c2 WHERE c2.o > p.o AND list_bool_and(list_transform(range(1, len(p.xs) + 1), lambda i: (c2.x - p.xs[i]) * (c2.x - p.xs[i]) + (c2.y - p.ys[i]) * (c2.y - p.ys[i]) >= 36000000))))
  SELECT CAST(k AS INTEGER) AS rank, gy, gx, visits, x, y FROM pick JOIN cand USING (o)""",
        recursive=True,
    ),
)
def hotspot_topk_spaced(spark, d):
    return P.hotspots(J.visits(fx.points(spark, d), fx.BOUNDS), fx.BOUNDS)


@register(
    "nearest_spot",
    oracle("fx_points", body="""a AS (SELECT event_id AS id, x, y FROM fx_points), b AS (SELECT event_id AS place, x, y FROM fx_points WHERE day IS NULL),
  m AS (SELECT id, place, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS d2 FROM a, b)
  SELECT id, first(place ORDER BY d2, place) AS place, round(sqrt(min(d2)), 3) AS dist_m FROM m WHERE d2 <= 4000000 GROUP BY id"""),
)
def nearest_spot(spark, d):
    p = fx.points(spark, d)
    found = P.nearest(p.select(F.col("event_id").alias("id"), "x", "y"), p.where("day IS NULL").select(F.col("event_id").alias("place"), "x", "y"), 2000.0)
    return found.withColumn("dist_m", F.round("dist_m", 3))


def _spots(p, even):
    half = p.where(F.col("vidx") % 2 == (0 if even else 1))
    return half.select("track_id", F.col("vidx").alias("nth"), "x", "y", F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("L"), F.col("event_id").cast("string"))).otherwise("").alias("label"))


@register("annotate_carry")
def annotate_carry(spark, d):
    p = fx.points(spark, d, by_user=True)
    return P.carry_annotations(_spots(p, True), _spots(p, False).withColumn("label", F.lit("")), "track_id")


@register(
    "waypoint_merge",
    oracle(
        "fx_users",
        body="""sp AS (SELECT track_id, list(struct_pack(x := x, y := y) ORDER BY vidx) AS s FROM fx_users WHERE vidx % 2 = 0 GROUP BY track_id),
  wp AS (SELECT track_id, list(struct_pack(x := x, y := y) ORDER BY vidx) AS w FROM fx_users WHERE vidx % 2 = 1 GROUP BY track_id),
  fold(track_id, i, w, acc) AS (
    SELECT sp.track_id, 0, coalesce(w, []), s FROM sp LEFT JOIN wp USING (track_id)
    UNION ALL
    SELECT track_id, i + 1, w, CASE WHEN len(list_filter(acc, lambda a: (a.x - w[i + 1].x) * (a.x - w[i + 1].x) + (a.y - w[i + 1].y) * (a.y - w[i + 1].y) < 100000000)) > 0 THEN acc ELSE list_append(acc, w[i + 1]) END FROM fold WHERE i < len(w))
  SELECT track_id, CAST(p - 1 AS INTEGER) AS pos, acc[p].x AS x, acc[p].y AS y FROM (SELECT track_id, acc, unnest(range(1, len(acc) + 1)) AS p FROM fold WHERE i = len(w))""",
        recursive=True,
    ),
)
def waypoint_merge(spark, d):
    p = fx.points(spark, d, by_user=True)
    return P.merge_waypoints(_spots(p, True).drop("label"), _spots(p, False).drop("label"), "track_id", 10000.0)


@register(
    "farthest_points",
    oracle(
        "fx_points",
        body="""inn AS (SELECT event_id AS id, x, y, least(2, greatest(0, CAST(trunc(3 * (x - 671470.0::DOUBLE) / 47120.0::DOUBLE) AS INT))) * 3 + least(2, greatest(0, CAST(trunc(3 * (y - 4457082.8::DOUBLE) / 58664.4::DOUBLE) AS INT))) AS cell
    FROM fx_points WHERE x BETWEEN 671470.0 AND 718590.0 AND y BETWEEN 4457082.8 AND 4515747.2),
  pick(k, id, ids, xs, ys, cs) AS (
    SELECT 1, id, [id], [x], [y], [cell] FROM inn WHERE id = (SELECT min(id) FROM inn)
    UNION ALL
    SELECT k + 1, c.id, list_append(ids, c.id), list_append(xs, c.x), list_append(ys, c.y), list_append(cs, c.cell) FROM pick p, inn c WHERE k < 8 AND c.id =
     (SELECT first(q.id ORDER BY NOT list_contains(p.cs, q.cell) DESC, list_min(list_transform(range(1, len(p.xs) + 1), lambda i: (q.x - p.xs[i]) * (q.x - p.xs[i]) + (q.y - p.ys[i]) * (q.y - p.ys[i]))) DESC, q.id) FROM inn q WHERE NOT list_contains(p.ids, q.id)))
  SELECT CAST(k AS INTEGER) AS nth, id, x, y FROM pick JOIN inn USING (id)""",
        recursive=True,
    ),
)
def farthest_points(spark, d):
    return P.farthest_points(fx.points(spark, d).select(F.col("event_id").alias("id"), "x", "y"), fx.BOUNDS, 8)


@register(
    "trailhead_topk",
    oracle("fx_points", body="""ds AS (SELECT event_id AS id, x, y, sqrt((x - 690000) * (x - 690000) + (y - 4480000) * (y - 4480000)) AS d FROM fx_points),
  a AS (SELECT * FROM ds WHERE d > 1000 ORDER BY abs(d - 9000), id LIMIT 25)
  SELECT id, x, y, round(d, 3) AS d FROM a ORDER BY (x - 695030) * (x - 695030) + (y - 4486415) * (y - 4486415), id LIMIT 5"""),
)
def trailhead_topk(spark, d):
    pts = fx.points(spark, d).select(F.col("event_id").alias("id"), "x", "y")
    return P.trailheads(pts, (690000.0, 4480000.0), (695030.0, 4486415.0), 9000.0).select("id", "x", "y", F.round("d", 3).alias("d"))


_LABELS = """lab AS (SELECT p_partkey // 80 AS sheet, p_name || '#' || p_partkey AS name, CASE p_size % 4 WHEN 0 THEN 'river' WHEN 1 THEN 'lake' ELSE 'peak' END AS kind, p_size AS rank,
   CAST((p_partkey * 7919) % 1000 AS DOUBLE) AS x, CAST((p_partkey * 104729) % 1000 AS DOUBLE) AS y, 8.0::DOUBLE * length(p_name) AS w, 14.0::DOUBLE AS h FROM part),
 held AS (SELECT *, row_number() OVER (PARTITION BY sheet, kind ORDER BY rank DESC, name) <= CASE kind WHEN 'lake' THEN 2 WHEN 'river' THEN 1 ELSE 0 END AS held FROM lab),
 ord AS (SELECT *, row_number() OVER (PARTITION BY sheet ORDER BY held DESC, rank DESC, name) AS nth FROM held)"""


def _label_rows(spark, d):
    """Eighty names a sheet: a map has so many, however many maps there are."""
    kind = F.when(F.col("p_size") % 4 == 0, "river").when(F.col("p_size") % 4 == 1, "lake").otherwise("peak")
    return fx.table(spark, d, "part").select(
        F.floor(F.col("p_partkey") / 80).alias("sheet"), F.concat_ws("#", "p_name", F.col("p_partkey").cast("string")).alias("name"), kind.alias("kind"), F.col("p_size").alias("rank"),
        ((F.col("p_partkey") * 7919) % 1000).cast("double").alias("x"), ((F.col("p_partkey") * 104729) % 1000).cast("double").alias("y"), (8.0 * F.length("p_name")).alias("w"), F.lit(14.0).alias("h"),
    )


@register("label_order", f"WITH {_LABELS} SELECT sheet, name, kind, rank, held, CAST(nth AS INTEGER) AS nth FROM ord")
def label_order(spark, d):
    return P.label_order(_label_rows(spark, d), {"lake": 2, "river": 2}, 9, "sheet").select("sheet", "name", "kind", "rank", "held", "nth")


@register(
    "label_place",
    f"""WITH RECURSIVE {_LABELS}, one AS (SELECT sheet, list(struct_pack(name := name, x := x, y := y, w := w, h := h) ORDER BY nth) AS c FROM ord GROUP BY sheet),
  fold(sheet, i, c, acc) AS (SELECT sheet, 0, c, c[1:0] FROM one UNION ALL
    SELECT sheet, i + 1, c, CASE WHEN len(acc) >= 9 OR len(list_filter(acc, lambda a: abs(a.x - c[i + 1].x) * 2 < a.w + c[i + 1].w AND abs(a.y - c[i + 1].y) * 2 < a.h + c[i + 1].h)) > 0 THEN acc ELSE list_append(acc, c[i + 1]) END
    FROM fold WHERE i < len(c) AND len(acc) < 9)
  SELECT sheet, b.name AS name, b.x AS x, b.y AS y, b.w AS w, b.h AS h FROM (SELECT sheet, unnest(acc) AS b FROM (SELECT sheet, i, len(c) AS n, acc FROM fold) WHERE i = n OR len(acc) = 9)""",
)
def label_place(spark, d):
    return P.place_labels(P.label_order(_label_rows(spark, d), {"lake": 2, "river": 2}, 9, "sheet"), "sheet", 9).drop("nth")


@register(
    "label_first_slot",
    """SELECT l_orderkey, CASE WHEN any_value(a) THEN 0 ELSE 1 END AS pass, slot FROM (
   SELECT l_orderkey, l_linenumber AS slot, l_returnflag = 'A' AS a, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_returnflag <> 'A', l_linenumber) AS n FROM lineitem WHERE l_quantity > 25) WHERE n = 1 GROUP BY l_orderkey, slot""",
)
def label_first_slot(spark, d):
    c = fx.table(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("slot"), (F.col("l_returnflag") == "A").alias("avoids"), (F.col("l_quantity") > 25).alias("fits"))
    return P.first_feasible(c, "l_orderkey")


@register(
    "region_routing",
    oracle(
        "fx_regions",
        body="""p AS (SELECT user_id AS k, 640000.0::DOUBLE + (event_id * 7919) % 110000 * CASE WHEN user_id % 3 = 0 THEN 0.1::DOUBLE ELSE 1.0::DOUBLE END AS x, 4440000.0::DOUBLE + (event_id * 104729) % 90000 AS y FROM events),
  h AS (SELECT k, region_id, count(*) AS n FROM p JOIN fx_regions ON x BETWEEN min_x AND max_x AND y BETWEEN min_y AND max_y GROUP BY k, region_id),
  b AS (SELECT k, first(region_id ORDER BY n DESC, region_id) AS best FROM h GROUP BY k),
  w AS (SELECT DISTINCT user_id AS k, CASE WHEN user_id % 7 = 1 THEN 'ASIA' END AS session, CASE WHEN user_id % 7 = 2 THEN 'EUROPE' WHEN user_id % 7 = 3 THEN 'MARS' END AS asked FROM events),
  j AS (SELECT w.*, best, hs.n AS sn, ha.n AS an FROM w LEFT JOIN b USING (k) LEFT JOIN h hs ON hs.k = w.k AND hs.region_id = session LEFT JOIN h ha ON ha.k = w.k AND ha.region_id = asked),
  e AS (SELECT *, CASE WHEN session IS NOT NULL AND sn IS NULL THEN 'outside_session_region' WHEN session IS NULL AND asked = 'MARS' THEN 'unknown_region' WHEN session IS NULL AND best IS NULL THEN 'outside_all_regions' END AS error FROM j)
  SELECT k AS upload, error, CASE WHEN error IS NULL THEN CASE WHEN session IS NOT NULL THEN session WHEN an IS NOT NULL THEN asked ELSE best END END AS region_id,
   CASE WHEN error IS NULL THEN CASE WHEN session IS NOT NULL THEN 'session' WHEN an IS NOT NULL THEN 'asked' WHEN asked IS NOT NULL THEN 'recovered' ELSE 'best' END END AS how FROM e""",
    ),
)
def region_routing(spark, d):
    e = fx.table(spark, d, "events")
    k = F.col("user_id")
    p = e.select(k.alias("upload"), (640000.0 + (F.col("event_id") * 7919) % 110000 * F.when(k % 3 == 0, 0.1).otherwise(1.0)).alias("x"), (4440000.0 + (F.col("event_id") * 104729) % 90000).alias("y"))
    wanted = e.select(k.alias("upload"), F.when(k % 7 == 1, "ASIA").alias("session"), F.when(k % 7 == 2, "EUROPE").when(k % 7 == 3, "MARS").alias("asked")).distinct()
    return P.routed(p, wanted, fx.regions(spark, d))


RANKS = {"range": 100, "summit": 85, "lake": 66, "river": 40}


@register(
    "label_candidates",
    oracle(
        "fx_points",
        body="""f AS (SELECT track_id AS id, CASE CAST(split_part(track_id, '-', 1) AS INTEGER) % 5 WHEN 0 THEN 'range' WHEN 1 THEN 'summit' WHEN 2 THEN 'lake' WHEN 3 THEN 'river' ELSE 'ridge' END AS kind,
   CASE WHEN day IS NULL THEN ' ' ELSE 'N' || CAST(split_part(track_id, '-', 1) AS INTEGER) % 50 END AS name, vidx, (x - 664030) / 40 AS x, (4525010 - y) / 40 AS y FROM fx_points WHERE track_id IN (SELECT track_id FROM fx_points GROUP BY track_id HAVING count(*) = count(day))),
  i AS (SELECT * FROM f WHERE kind <> 'ridge' AND x BETWEEN 0 AND 1000 AND y BETWEEN 0 AND 1200),
  g AS (SELECT id, kind, name, avg(x) AS ax, avg(y) AS ay, count(*) AS n, list(x ORDER BY vidx) AS xs, list(y ORDER BY vidx) AS ys FROM i GROUP BY id, kind, name),
  r AS (SELECT *, row_number() OVER (PARTITION BY kind, name ORDER BY n DESC, id) AS k FROM g)
  SELECT id, kind, name, CASE kind WHEN 'range' THEN 100 WHEN 'summit' THEN 85 WHEN 'lake' THEN 66 ELSE 40 END AS rank, round(CASE WHEN kind = 'river' THEN xs[n // 2 + 1] ELSE ax END, 3) AS x, round(CASE WHEN kind = 'river' THEN ys[n // 2 + 1] ELSE ay END, 3) AS y, n, kind = 'range' AND n >= 2 AS along
  FROM r WHERE kind <> 'river' OR k = 1""",
    ),
)
def label_candidates(spark, d):
    p = fx.points(spark, d)
    whole = p.groupBy("track_id").agg((F.count("*") == F.count("day")).alias("dated")).where("dated").select("track_id")
    number = F.substring_index("track_id", "-", 1).cast("int")
    kind = F.get(F.array(*map(F.lit, ("range", "summit", "lake", "river", "ridge"))), number % 5)
    f = p.join(whole, "track_id", "left_semi").select(F.col("track_id").alias("id"), kind.alias("kind"), F.when(F.col("day").isNull(), " ").otherwise(F.concat(F.lit("N"), (number % 50).cast("string"))).alias("name"), "vidx", ((F.col("x") - 664030) / 40).alias("x"), ((4525010 - F.col("y")) / 40).alias("y"))
    return P.label_candidates(f, 1000.0, 1200.0, RANKS).withColumns({"x": F.round("x", 3), "y": F.round("y", 3)})


@register(
    "river_runs",
    oracle("fx_points", body="""f AS (SELECT CAST(split_part(track_id, '-', 1) AS INTEGER) AS id, 'R' || CAST(split_part(track_id, '-', 1) AS INTEGER) % 20 AS name, row_number() OVER (PARTITION BY split_part(track_id, '-', 1) ORDER BY t, event_id) - 1 AS vidx, (x - 664030) / 40 AS x, (4525010 - y) / 40 AS y FROM fx_points),
  o AS (SELECT *, x BETWEEN 0 AND 1300 AND y BETWEEN 300 AND 1900 AS on_sheet FROM f), i AS (SELECT *, vidx - row_number() OVER (PARTITION BY id ORDER BY vidx) AS island FROM o WHERE on_sheet),
  g AS (SELECT id, name, island, min(vidx) AS first, count(*) AS n, list(x ORDER BY vidx) AS xs, list(y ORDER BY vidx) AS ys FROM i GROUP BY id, name, island),
  k AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY n DESC, id, first) AS nth FROM g)
  SELECT name, id, first, n, round(xs[n // 2 + 1], 3) AS x, round(ys[n // 2 + 1], 3) AS y FROM k WHERE nth = 1"""),
)
def river_runs(spark, d):
    """Each user's vertices are a river that leaves the sheet and comes back; some twenty names."""
    u = F.substring_index("track_id", "-", 1).cast("int")
    order = Window.partitionBy("id").orderBy("t", "event_id")
    f = fx.points(spark, d).select(u.alias("id"), F.concat(F.lit("R"), (u % 20).cast("string")).alias("name"), "t", "event_id", ((F.col("x") - 664030) / 40).alias("x"), ((4525010 - F.col("y")) / 40).alias("y"))
    f = f.withColumn("vidx", (F.row_number().over(order) - 1).cast("long")).withColumn("y", F.when(F.col("y") >= 300, F.col("y")).otherwise(-1.0))
    return P.longest_runs(f, 1300.0, 1900.0).select("name", "id", "first", "n", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"))


@register(
    "label_keep_outs",
    oracle("fx_specs", body="""s AS (SELECT k, print_w, print_h, print_w * 300 AS w, print_h * 300 AS h, bleed * 300 AS t, 300.0::DOUBLE AS dpi, least(greatest(sqrt(print_w * print_h / 432.0::DOUBLE), 0.75::DOUBLE), 2.0::DOUBLE) * (0.5::DOUBLE + k % 3 / 2.0::DOUBLE) AS fs,
    k % 2 = 0 AS ti, k % 5 = 0 AS co, k % 3 = 0 AS pr, top_clear AS tc, (k % 4) / 20.0::DOUBLE AS bc, 1.0::DOUBLE + k % 2 AS ph, CASE WHEN k % 2 = 0 OR k % 5 = 0 THEN print_h * 300 - bleed * 300 - 400 END AS st FROM fx_specs),
  p AS (SELECT *, round_even(0.35::DOUBLE * dpi * fs, 0) AS ins, least(h - t - round_even(0.35::DOUBLE * dpi * fs, 0), coalesce(st, h - t) - round_even(0.16::DOUBLE * dpi * fs, 0)) AS y1, t + round_even(0.25::DOUBLE * dpi, 0) + greatest(1, round_even(0.05::DOUBLE * dpi * fs, 0)) AS top FROM s WHERE pr),
  q AS (SELECT *, greatest(1, least(greatest(1, round_even(ph * dpi * fs, 0)), y1 - top)) AS hh FROM p)
  SELECT k, 'corner' AS part, t AS x0, h - t - round_even(2.5::DOUBLE * fs * dpi, 0) AS y0, t + round_even(3.4::DOUBLE * fs * dpi, 0) AS x1, h - t AS y1 FROM s WHERE ti OR co
  UNION ALL SELECT k, 'top', 0, 0, w, round_even(tc * h, 0) FROM s WHERE tc > 0 UNION ALL SELECT k, 'bottom', 0, h - round_even(bc * h, 0), w, h FROM s WHERE bc > 0
  UNION ALL SELECT k, 'profile', t + ins, y1 - hh, t + ins + least(w - 2 * t - 2 * ins, round_even(hh * 3.4::DOUBLE, 0)), y1 FROM q"""),
)
def label_keep_outs(spark, d):
    k, high, trim = F.col("k"), F.col("print_h") * 300, F.col("bleed") * 300
    s = fx.specs(spark, d).select(
        "k", "print_w", "print_h", (F.col("print_w") * 300).alias("width"), high.alias("height"), trim.alias("trim"), F.lit(300.0).alias("dpi"), (0.5 + k % 3 / 2.0).alias("furniture"), (k % 2 == 0).alias("has_title"), (k % 5 == 0).alias("has_compass"),
        (k % 3 == 0).alias("has_profile"), F.col("top_clear"), ((k % 4) / 20.0).alias("bottom_clear"), (1.0 + k % 2).alias("profile_in"), F.when((k % 2 == 0) | (k % 5 == 0), high - trim - 400).alias("stack_top"),
    )
    return P.keep_outs(s, "k")


@register(
    "edition_spots",
    """WITH n AS (SELECT p_type AS label, count(*) AS weight FROM part GROUP BY p_type), s AS (SELECT p_partkey, p_brand, CASE WHEN p_partkey % 4 > 0 THEN p_type ELSE '' END AS label0, CASE WHEN p_partkey % 3 > 0 THEN 'flag' END AS icon0, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS r FROM part),
  a AS (SELECT p_partkey, CASE WHEN label0 = '' THEN ['one', 'two'][r % 2 + 1] ELSE label0 END AS label, coalesce(icon0, ['peak', 'camp', 'star'][r % 3 + 1]) AS icon FROM s)
  SELECT p_partkey, label, icon, weight FROM a JOIN n USING (label)""",
)
def edition_spots(spark, d):
    part = fx.table(spark, d, "part")
    spots = part.select("p_partkey", "p_brand", F.col("p_partkey").alias("nth"), F.when(F.col("p_partkey") % 4 > 0, F.col("p_type")).otherwise("").alias("label"), F.when(F.col("p_partkey") % 3 > 0, "flag").alias("icon"))
    done = P.annotated(spots, "p_brand", ("one", "two"), ("peak", "camp", "star"))
    return P.occurrences(done, part.select(F.col("p_type").alias("name"))).select("p_partkey", "label", "icon", "weight")


@register(
    "destinations",
    oracle("fx_points", body="""f AS (SELECT event_id AS seq, 'N' || event_id % 40 AS name, event_id % 7 AS rank, x, y FROM fx_points WHERE day IS NULL), v AS (SELECT event_id AS node, x, y FROM fx_points WHERE day IS NOT NULL),
  m AS (SELECT seq, name, rank, node, (f.x - v.x) * (f.x - v.x) + (f.y - v.y) * (f.y - v.y) AS d2 FROM f, v),
  n AS (SELECT seq, name, rank, first(node ORDER BY d2, node) AS node, min(d2) AS d2 FROM m WHERE d2 <= 4000000 GROUP BY seq, name, rank),
  b AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY rank DESC, seq) AS k FROM n)
  SELECT name, rank, node, round(sqrt(d2), 3) AS dist_m FROM b WHERE k = 1"""),
)
def destinations(spark, d):
    p = fx.points(spark, d)
    i = F.col("event_id")
    f = p.where("day IS NULL").select(i.alias("seq"), F.concat(F.lit("N"), (i % 40).cast("string")).alias("name"), (i % 7).alias("rank"), "x", "y")
    return P.destinations(f, p.where("day IS NOT NULL").select(i.alias("node"), "x", "y")).withColumn("dist_m", F.round("dist_m", 3))


@register("first_order", "SELECT p_type, min(p_partkey) AS p_partkey FROM part GROUP BY p_type")
def first_order(spark, d):
    return P.in_first_order(fx.table(spark, d, "part").select("p_type", "p_partkey"), "p_type", "p_partkey")
