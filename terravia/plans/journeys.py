"""Queries on journeys."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from terravia import fixtures as fx
from terravia.catalog import register
from terravia.fixtures import oracle
from terravia.operators import journeys as J

_STEPS = """st AS (SELECT *, hypot_ AS step_m FROM (SELECT *, sqrt((x - lag(x) OVER w) * (x - lag(x) OVER w) + (y - lag(y) OVER w) * (y - lag(y) OVER w)) AS hypot_ FROM {v} WINDOW w AS (PARTITION BY track_id ORDER BY vidx))),
 arc AS (SELECT *, coalesce(sum(step_m) OVER (PARTITION BY track_id ORDER BY vidx ROWS UNBOUNDED PRECEDING), 0) AS cum_m FROM st)"""
STEPS, USER_STEPS = _STEPS.format(v="fx_points"), _STEPS.format(v="fx_users")

VISITS = """seg AS (SELECT track_id, day, vidx, x, y, lead(x) OVER w AS x1, lead(y) OVER w AS y1 FROM fx_points WINDOW w AS (PARTITION BY track_id ORDER BY vidx)),
 parts AS (SELECT *, greatest(1, CAST(trunc(sqrt((x1 - x) * (x1 - x) + (y1 - y) * (y1 - y)) / 500.0::DOUBLE) AS BIGINT)) AS n FROM seg WHERE x1 IS NOT NULL),
 dense AS (SELECT *, unnest(range(0, n + 1)) AS k FROM parts),
 samp AS (SELECT coalesce(day, '__anon-' || track_id) AS journey, CASE WHEN k = n THEN x1 ELSE x + k * ((x1 - x) / n) END AS px, CASE WHEN k = n THEN y1 ELSE y + k * ((y1 - y) / n) END AS py FROM dense),
 cells AS (SELECT journey, CAST(trunc((4525010.0::DOUBLE - py) / 1000.0::DOUBLE) AS BIGINT) AS gy, CAST(trunc((px - 664030.0::DOUBLE) / 1000.0::DOUBLE) AS BIGINT) AS gx FROM samp),
 visits AS (SELECT gy, gx, count(DISTINCT journey) AS visits FROM cells WHERE gx BETWEEN 0 AND 61 AND gy BETWEEN 0 AND 76 GROUP BY gy, gx)"""


def _points(spark, d):
    return fx.points(spark, d)


def _users(spark, d):
    return fx.points(spark, d, by_user=True)


@register("hotspot_visits", oracle("fx_points", body=VISITS + " SELECT * FROM visits"))
def hotspot_visits(spark, d):
    return J.visits(_points(spark, d), fx.BOUNDS)


@register(
    "track_summary",
    oracle(
        "fx_points",
        body=STEPS + """ SELECT track_id, count(*) AS n, min(t) AS t0, max(t) AS t1, round(avg(x), 3) AS cx, round(avg(y), 3) AS cy, round(max(cum_m), 3) AS length_m,
  max(ele) AS summit_ele, first(t ORDER BY ele DESC, vidx) AS summit_t FROM arc GROUP BY track_id""",
    ),
)
def track_summary(spark, d):
    return J.summary(_points(spark, d)).withColumns({c: F.round(c, 3) for c in ("cx", "cy", "length_m")})


@register("arc_length", oracle("fx_points", body=STEPS + " SELECT track_id, vidx, round(cum_m, 3) AS cum_m FROM arc"))
def arc_length(spark, d):
    return J.arc_length(_points(spark, d)).select("track_id", "vidx", F.round("cum_m", 3).alias("cum_m"))


@register(
    "quality_filter",
    """WITH raw AS (SELECT CAST(user_id AS VARCHAR) AS track_id, event_id, CASE WHEN event_id % 13 = 0 THEN 'nan'::DOUBLE WHEN event_id % 17 <> 0 THEN value END AS x, value * 2 AS y FROM events),
  good AS (SELECT *, x IS NOT NULL AND NOT isnan(x) AND y IS NOT NULL AS ok FROM raw),
  per AS (SELECT *, sum(CAST(ok AS INT)) OVER (PARTITION BY track_id) AS n_good, CAST(sum(CAST(NOT ok AS INT)) OVER (PARTITION BY track_id) AS BIGINT) AS dropped FROM good)
  SELECT track_id, event_id, dropped, row_number() OVER (PARTITION BY track_id ORDER BY event_id) - 1 AS vidx FROM per WHERE ok AND n_good >= 2""",
)
def quality_filter(spark, d):
    e = fx.table(spark, d, "events")
    x = F.when(F.col("event_id") % 13 == 0, float("nan")).when(F.col("event_id") % 17 != 0, F.col("value"))
    raw = e.select(F.col("user_id").cast("string").alias("track_id"), "event_id", F.col("event_id").alias("vidx"), x.alias("x"), (F.col("value") * 2).alias("y"))
    return J.clean(raw).select("track_id", "event_id", "dropped", "vidx")


@register(
    "mileage",
    oracle(
        "fx_points",
        body=STEPS + """, shapes AS (SELECT track_id, first(day ORDER BY vidx) FILTER (day IS NOT NULL) AS day, max(cum_m) AS len, string_agg(CAST(x AS VARCHAR) || ',' || CAST(y AS VARCHAR), '|' ORDER BY vidx) AS shape FROM arc GROUP BY track_id),
  once AS (SELECT day, shape, first(len) AS len FROM shapes GROUP BY day, shape)
  SELECT count(DISTINCT day) AS days, round(sum(len) / 1609.344::DOUBLE, 3) AS miles FROM once""",
    ),
)
def mileage(spark, d):
    return J.mileage(_points(spark, d)).withColumn("miles", F.round("miles", 3))


GROUPS = """per AS (SELECT track_id, first(day ORDER BY vidx) FILTER (day IS NOT NULL) AS day, min(t) AS t0, min(event_id) AS e0 FROM fx_points GROUP BY track_id),
 grp AS (SELECT coalesce(day, '__anon-' || track_id) AS journey, min(day) AS day, count(*) AS tracks, min(struct_pack(t := t0, e := e0)) AS s FROM per GROUP BY 1),
 num AS (SELECT journey, day, tracks, row_number() OVER (ORDER BY day IS NULL, day, s.t, s.e, journey) AS nth FROM grp)"""


@register("journey_groups", oracle("fx_points", body=GROUPS + " SELECT journey, day, tracks, s.t AS first_seen, s.e AS first_id FROM grp"))
def journey_groups(spark, d):
    return J.journey_groups(_points(spark, d))


@register("journey_order", oracle("fx_points", body=GROUPS + " SELECT * FROM num"))
def journey_order(spark, d):
    return J.numbered(J.journey_groups(_points(spark, d)))


@register(
    "reveal_by_journey",
    oracle(
        "fx_points",
        body=GROUPS + """, n AS (SELECT max(nth) AS n FROM num), ks AS (SELECT unnest(range(1, 24)) AS k),
  counts AS (SELECT DISTINCT CASE WHEN n <= 23 THEN k ELSE greatest(1, round_even(n * k / 23.0::DOUBLE, 0)) END AS c FROM n, ks WHERE n > 23 OR k <= n),
  frames AS (SELECT row_number() OVER (ORDER BY c) AS frame, c FROM counts)
  SELECT CAST(frame AS INTEGER) AS frame, journey FROM frames JOIN num ON nth <= c""",
    ),
)
def reveal_by_journey(spark, d):
    return J.reveal_by_journey(J.journey_groups(_points(spark, d)))


@register(
    "reveal_by_points",
    oracle(
        "fx_points",
        body="""per AS (SELECT track_id, count(*) AS len, min(day) AS day FROM fx_points GROUP BY track_id),
  bf AS (SELECT *, coalesce(sum(len) OVER (ORDER BY day IS NULL, day, track_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM per),
  tot AS (SELECT CAST(sum(len) AS BIGINT) AS total FROM per),
  bud AS (SELECT DISTINCT greatest(2, CAST(round_even(total * k / 12.0::DOUBLE, 0) AS BIGINT)) AS b FROM tot, (SELECT unnest(range(1, 13)) AS k) WHERE round_even(total * k / 12.0::DOUBLE, 0) < total UNION SELECT total FROM tot),
  fr AS (SELECT CAST(row_number() OVER (ORDER BY b) AS INTEGER) AS frame, b FROM bud)
  SELECT frame, track_id, CAST(least(len, b - before) AS BIGINT) AS shown FROM bf JOIN fr ON b > before, tot WHERE least(len, b - before) >= 2 OR b = total""",
    ),
)
def reveal_by_points(spark, d):
    return J.reveal_by_points(_points(spark, d))


ACTIVE = """ac AS (SELECT *, coalesce(sum(gap) OVER (PARTITION BY track_id ORDER BY vidx ROWS UNBOUNDED PRECEDING), 0) AS active_s FROM
 (SELECT *, CASE WHEN vidx > 0 THEN least(t - lag(t) OVER (PARTITION BY track_id ORDER BY vidx), 1800.0::DOUBLE) ELSE 0 END AS gap FROM fx_users))"""


@register("active_time", oracle("fx_users", body=ACTIVE + " SELECT track_id, vidx, round(active_s, 3) AS active_s FROM ac"))
def active_time(spark, d):
    return J.active_time(_users(spark, d)).select("track_id", "vidx", F.round("active_s", 3).alias("active_s"))


@register(
    "reveal_by_time",
    oracle(
        "fx_users",
        body=ACTIVE + """, tot AS (SELECT *, max(active_s) OVER (PARTITION BY track_id) AS total FROM ac), sp AS (SELECT *, unnest(range(1, 11)) AS frame FROM tot)
  SELECT CAST(frame AS INTEGER) AS frame, track_id, count(*) AS shown FROM sp WHERE frame = 10 OR active_s * 10 <= total * frame GROUP BY frame, track_id HAVING count(*) >= 2 OR frame = 10""",
    ),
)
def reveal_by_time(spark, d):
    return J.reveal_by_time(_users(spark, d))


@register(
    "frame_durations",
    "SELECT o_custkey, CAST(row_number() OVER w - 1 AS INTEGER) AS frame, CASE WHEN row_number() OVER w = count(*) OVER (PARTITION BY o_custkey) THEN 2500 WHEN row_number() OVER w = 1 THEN 600 ELSE 220 END AS ms FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)",
)
def frame_durations(spark, d):
    """A customer's orders are the frames of a film."""
    per = Window.partitionBy("o_custkey")
    frames = fx.table(spark, d, "orders").select("o_custkey", (F.row_number().over(per.orderBy("o_orderkey")) - 1).cast("int").alias("frame"), F.count("*").over(per).alias("n"))
    return frames.select("o_custkey", "frame", J.durations(F.col("n"), 220, 2500, 600).alias("ms"))


@register("film_ticks", "SELECT order_key, ms, CAST(unnest(range(1, greatest(1, CAST(round_even(ms / 40.0::DOUBLE, 0) AS INTEGER)) + 1)) AS INTEGER) AS tick FROM (SELECT o_orderkey AS order_key, CAST((o_orderkey * 37) % 500 AS INTEGER) AS ms FROM orders)")
def film_ticks(spark, d):
    frames = fx.table(spark, d, "orders").select(F.col("o_orderkey").alias("order_key"), ((F.col("o_orderkey") * 37) % 500).cast("int").alias("ms"))
    return J.expand_ticks(frames)


@register(
    "profile_distance_elevation",
    oracle(
        "fx_users",
        body=USER_STEPS + """, ends AS (SELECT track_id, max(cum_m) AS len FROM arc GROUP BY track_id),
  base AS (SELECT track_id, coalesce(sum(len) OVER (ORDER BY track_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base_m FROM ends)
  SELECT arc.track_id, vidx, round(base_m + cum_m, 2) AS dist_m, ele FROM arc JOIN base USING (track_id)""",
    ),
)
def profile_distance_elevation(spark, d):
    return J.profile(_users(spark, d)).withColumn("dist_m", F.round("dist_m", 2))


@register(
    "grade",
    oracle(
        "fx_points",
        body=STEPS + """, g0 AS (SELECT *, CASE WHEN step_m IS NULL THEN NULL WHEN step_m > 1e-6::DOUBLE THEN (ele - lag(ele) OVER w) / step_m ELSE 0 END AS g FROM st WINDOW w AS (PARTITION BY track_id ORDER BY vidx)),
  g1 AS (SELECT track_id, vidx, coalesce(g, lead(g) OVER (PARTITION BY track_id ORDER BY vidx), 0) AS grade FROM g0)
  SELECT track_id, vidx, round(grade, 6) AS grade, round(0.5::DOUBLE + 0.5::DOUBLE * least(greatest(grade / 0.3::DOUBLE, -1), 1), 6) AS norm FROM g1""",
    ),
)
def grade(spark, d):
    return J.grade(_points(spark, d)).select("track_id", "vidx", F.round("grade", 6).alias("grade"), F.round("norm", 6).alias("norm"))


@register("moving_average_path", oracle("fx_users", body="SELECT track_id, vidx, round(avg(x) OVER w, 4) AS sx, round(avg(y) OVER w, 4) AS sy FROM fx_users WINDOW w AS (PARTITION BY track_id ORDER BY vidx ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)"))
def moving_average_path(spark, d):
    return J.moving_average(_users(spark, d)).select("track_id", "vidx", F.round("sx", 4).alias("sx"), F.round("sy", 4).alias("sy"))


@register(
    "resample_even",
    oracle(
        "fx_users",
        body=USER_STEPS + """, sp AS (SELECT *, lead(x) OVER w AS x1, lead(y) OVER w AS y1, lead(cum_m) OVER w AS cum1 FROM arc WINDOW w AS (PARTITION BY track_id ORDER BY vidx)),
  ks AS (SELECT *, unnest(range(CAST(ceil(cum_m / 5000.0::DOUBLE) AS BIGINT), CAST(ceil(cum1 / 5000.0::DOUBLE) AS BIGINT))) AS k FROM sp WHERE cum1 > cum_m)
  SELECT track_id, k, round(x + (x1 - x) * ((k * 5000.0::DOUBLE - cum_m) / (cum1 - cum_m)), 2) AS x, round(y + (y1 - y) * ((k * 5000.0::DOUBLE - cum_m) / (cum1 - cum_m)), 2) AS y FROM ks""",
    ),
)
def resample_even(spark, d):
    return J.resample(_users(spark, d), 5000.0).withColumns({"x": F.round("x", 2), "y": F.round("y", 2)})


@register("dash_phase", oracle("fx_points", body=STEPS + " SELECT track_id, vidx, (cum_m - floor(cum_m / 5000.0::DOUBLE) * 5000.0::DOUBLE) < 3000 AS inked FROM arc"))
def dash_phase(spark, d):
    return J.dashes(_points(spark, d), 3000.0, 2000.0).select("track_id", "vidx", "inked")


@register(
    "river_taper",
    oracle("fx_points", body=STEPS + """, tt AS (SELECT *, max(cum_m) OVER (PARTITION BY track_id) AS total FROM arc WHERE step_m IS NOT NULL)
  SELECT track_id, vidx, round(0.5::DOUBLE + 1.5::DOUBLE * CASE WHEN total > 0 THEN (cum_m - step_m / 2) / total ELSE 0 END, 6) AS width FROM tt"""),
)
def river_taper(spark, d):
    return J.taper(_points(spark, d), 0.5, 2.0).select("track_id", "vidx", F.round("width", 6).alias("width"))


@register("simplify_tracks")
def simplify_tracks(spark, d):
    return J.simplify(_users(spark, d), 15000.0)


@register("recover_times")
def recover_times(spark, d):
    points = _users(spark, d)
    return J.recover_times(J.simplify(points, 15000.0), points)


@register(
    "journey_anchor",
    oracle(
        "fx_users",
        body="""per AS (SELECT track_id, avg(x) AS cx, avg(y) AS cy, min(t) AS t0, max(t) AS t1, max(ele) AS e, first(t ORDER BY ele DESC, vidx) AS st FROM fx_users GROUP BY track_id)
  SELECT round(avg(cx), 3) AS cx, round(avg(cy), 3) AS cy, min(t0) AS t_min, max(t1) AS t_max, first(st ORDER BY e DESC, st) AS summit_t,
   (SELECT list_sort(list(DISTINCT strftime(make_timestamp(CAST(t * 1000000 AS BIGINT)), '%Y-%m-%d'))) FROM fx_users) AS days FROM per""",
    ),
)
def journey_anchor(spark, d):
    return J.anchor(_users(spark, d)).withColumns({"cx": F.round("cx", 3), "cy": F.round("cy", 3)})


CLOCK = """ts AS (SELECT DISTINCT t FROM fx_users), ck AS (SELECT t, coalesce(sum(g) OVER (ORDER BY t ROWS UNBOUNDED PRECEDING), 0) AS a FROM (SELECT t, CASE WHEN lag(t) OVER (ORDER BY t) IS NOT NULL THEN least(t - lag(t) OVER (ORDER BY t), 1800.0::DOUBLE) ELSE 0 END AS g FROM ts))"""


@register("clock_times", oracle("fx_users", body=CLOCK + " SELECT t, round(a, 2) AS active_s FROM ck"))
def clock_times(spark, d):
    return J.clock(_users(spark, d)).withColumn("active_s", F.round("active_s", 2))


@register(
    "reveal_by_clock",
    oracle(
        "fx_users",
        body=CLOCK + """, fr AS (SELECT CAST(k AS INTEGER) AS frame, (SELECT min(t) FROM ck WHERE a >= (SELECT max(a) FROM ck) * (k / 10.0::DOUBLE) - 1e-6::DOUBLE) AS until FROM (SELECT unnest(range(1, 11)) AS k)),
  ct AS (SELECT frame, track_id, coalesce(min(vidx) FILTER (t > until AND frame < 10), count(*)) AS shown FROM fr, fx_users GROUP BY frame, track_id)
  SELECT frame, track_id, shown FROM ct WHERE shown >= 2 OR frame = 10""",
    ),
)
def reveal_by_clock(spark, d):
    return J.reveal_by_clock(_users(spark, d))


@register(
    "point_at",
    oracle(
        "fx_users",
        body=USER_STEPS + """, sp AS (SELECT *, lead(x) OVER w AS x1, lead(y) OVER w AS y1, lead(cum_m) OVER w AS cum1, max(cum_m) OVER (PARTITION BY track_id) AS total FROM arc WINDOW w AS (PARTITION BY track_id ORDER BY vidx)),
  q AS (SELECT *, least(greatest(k * 100000.0::DOUBLE - 50000.0::DOUBLE, 0), total) AS pos FROM sp, (SELECT unnest(range(0, 40)) AS k) WHERE x1 IS NOT NULL),
  o AS (SELECT *, row_number() OVER (PARTITION BY track_id, k ORDER BY vidx) AS n FROM q WHERE cum1 >= pos)
  SELECT track_id, k, round(x + (x1 - x) * ((pos - cum_m) / (cum1 - cum_m)), 1) AS px, round(y + (y1 - y) * ((pos - cum_m) / (cum1 - cum_m)), 1) AS py, round(atan2(y1 - y, x1 - x), 6) AS angle FROM o WHERE n = 1""",
    ),
)
def point_at(spark, d):
    p = _users(spark, d)
    wanted = p.select("track_id").distinct().withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(39)))).select("track_id", (F.col("k") * 100000.0 - 50000.0).alias("s"))
    return J.points_at(p, wanted).select("track_id", ((F.col("s") + 50000.0) / 100000.0).cast("long").alias("k"), F.round("x", 1).alias("px"), F.round("y", 1).alias("py"), F.round("angle", 6).alias("angle"))


@register(
    "smoothed_path",
    oracle(
        "fx_users",
        body="""seg AS (SELECT track_id, vidx, x, y, lead(x) OVER w AS x1, lead(y) OVER w AS y1, max(vidx) OVER (PARTITION BY track_id) - 1 AS last FROM fx_users WINDOW w AS (PARTITION BY track_id ORDER BY vidx)),
  parts AS (SELECT *, greatest(1, CAST(trunc(sqrt((x1 - x) * (x1 - x) + (y1 - y) * (y1 - y)) / 9000.0::DOUBLE) AS BIGINT)) AS n FROM seg WHERE x1 IS NOT NULL),
  d AS (SELECT *, unnest(range(0, n + CASE WHEN vidx = last THEN 1 ELSE 0 END)) AS k FROM parts),
  e AS (SELECT track_id, row_number() OVER (PARTITION BY track_id ORDER BY vidx, k) - 1 AS vidx, CASE WHEN k = n THEN x1 ELSE x + k * ((x1 - x) / n) END AS px, CASE WHEN k = n THEN y1 ELSE y + k * ((y1 - y) / n) END AS py FROM d)
  SELECT track_id, vidx, round(avg(px) OVER w, 3) AS sx, round(avg(py) OVER w, 3) AS sy FROM e WINDOW w AS (PARTITION BY track_id ORDER BY vidx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)""",
    ),
)
def smoothed_path(spark, d):
    return J.smoothed(_users(spark, d), 9000.0, 36000.0).withColumns({"sx": F.round("sx", 3), "sy": F.round("sy", 3)})


@register(
    "stats_lines",
    """SELECT o_orderkey AS k, array_to_string(list_filter([CASE WHEN e >= 2 THEN 'EDITION ' || e END, CASE WHEN e >= 2 AND y <> '' THEN y END, CASE WHEN r > 0 THEN '~1:' || format('{:,}', CAST(round_even(r / m, 0) * m AS BIGINT)) END,
    CASE WHEN o > 0 THEN 'PLAN OBLIQUE' END, CASE WHEN dy = 1 THEN '1 DAY' WHEN dy > 1 THEN dy || ' DAYS' END, CASE WHEN mi > 0 THEN CAST(round_even(mi, 0) AS BIGINT) || ' MI' END], lambda p: p IS NOT NULL), ' · ') AS line
  FROM (SELECT *, pow(10.0::DOUBLE, greatest(0, floor(log10(greatest(r, 1e-9::DOUBLE))) - 1)) AS m FROM (SELECT o_orderkey, o_orderkey % 4 AS e, CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE strftime(o_orderdate, '%Y') END AS y,
    CASE WHEN o_orderkey % 11 = 0 THEN 0.0::DOUBLE ELSE 0.5::DOUBLE + o_orderkey * 37 END AS r, o_orderkey % 5 - 2 AS o, o_orderkey % 3 AS dy, (o_orderkey % 5000) / 2.0::DOUBLE AS mi FROM orders))""",
)
def stats_lines(spark, d):
    k = F.col("o_orderkey")
    o = fx.table(spark, d, "orders")
    years = F.when(k % 7 == 0, "").otherwise(F.date_format("o_orderdate", "yyyy"))
    ratio = F.when(k % 11 == 0, 0.0).otherwise(0.5 + k * 37)
    return o.select(k.alias("k"), J.stats_line(k % 4, years, ratio, k % 3, (k % 5000) / 2.0, k % 5 - 2).alias("line"))


def _hash(key: str) -> str:
    return f"(('0x' || substr(md5({key}), 1, 6))::BIGINT / 16777216.0::DOUBLE)"


_SWAY = " + ".join(f"sin(6.283185307179586::DOUBLE * ({k} * cum / 30000.0::DOUBLE + {_hash(f"track_id || '/w{k}/5'")})) / {k}" for k in (1, 2, 3))


@register(
    "recorded_tracks",
    oracle("fx_users", body=f"""s AS (SELECT *, lead(x) OVER w AS x1, lead(y) OVER w AS y1, vidx AS i FROM fx_users WINDOW w AS (PARTITION BY track_id ORDER BY vidx)),
  l AS (SELECT *, sqrt((x1 - x) * (x1 - x) + (y1 - y) * (y1 - y)) AS len FROM s WHERE x1 IS NOT NULL), c AS (SELECT *, sum(len) OVER w AS c1, sum(len) OVER w - len AS c0 FROM l WINDOW w AS (PARTITION BY track_id ORDER BY i ROWS UNBOUNDED PRECEDING)),
  e AS (SELECT *, unnest(range(CAST(ceil(c0 / 10000.0::DOUBLE) AS BIGINT), CAST(ceil(c1 / 10000.0::DOUBLE) AS BIGINT))) AS k FROM c WHERE c1 > c0),
  p AS (SELECT track_id, k AS vidx, x + (x1 - x) * ((k * 10000.0::DOUBLE - c0) / (c1 - c0)) AS x, y + (y1 - y) * ((k * 10000.0::DOUBLE - c0) / (c1 - c0)) AS y FROM e),
  q AS (SELECT *, coalesce(lead(x) OVER w, x) - coalesce(lag(x) OVER w, x) AS dx, coalesce(lead(y) OVER w, y) - coalesce(lag(y) OVER w, y) AS dy, coalesce(sqrt((x - lag(x) OVER w) * (x - lag(x) OVER w) + (y - lag(y) OVER w) * (y - lag(y) OVER w)), 0) AS st FROM p WINDOW w AS (PARTITION BY track_id ORDER BY vidx)),
  r AS (SELECT *, sum(st) OVER (PARTITION BY track_id ORDER BY vidx ROWS UNBOUNDED PRECEDING) AS cum, sum(st) OVER (PARTITION BY track_id) AS total FROM q),
  o AS (SELECT *, CASE WHEN total > 0 THEN 800 * 4 * (cum / total) * (1 - cum / total) * ({_SWAY}) ELSE 0 END AS off, 40 * sqrt(-2 * ln(1 - {_hash("track_id || '/' || vidx || '/r/5'")})) AS ra, 6.283185307179586::DOUBLE * {_hash("track_id || '/' || vidx || '/a/5'")} AS an, sqrt(dx * dx + dy * dy) AS ln_ FROM r)
  SELECT track_id, vidx, round(x - CASE WHEN ln_ > 0 THEN dy / ln_ ELSE 0 END * off + ra * cos(an), 2) AS x, round(y + CASE WHEN ln_ > 0 THEN dx / ln_ ELSE 0 END * off + ra * sin(an), 2) AS y FROM o"""),
)
def recorded_tracks(spark, d):
    """Each user's way as a device that samples every ten kilometres might have recorded it."""
    done = J.recorded(_users(spark, d), 10_000.0, 800.0, 30_000.0, 3, 40.0, 5)
    return done.select("track_id", "vidx", F.round("x", 2).alias("x"), F.round("y", 2).alias("y"))
