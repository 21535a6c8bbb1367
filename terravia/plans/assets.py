"""Queries on files, bundles, sessions, jobs and text rules."""

from pyspark.sql import functions as F

from terravia import fixtures as fx
from terravia.catalog import register
from terravia.fixtures import oracle
from terravia.functions import text as T
from terravia.operators import assets as A
from terravia.operators import journeys as J


@register("file_dedup", oracle("fx_assets", body="SELECT sha, min(seq) AS seq FROM fx_assets GROUP BY sha"))
def file_dedup(spark, d):
    return A.first_of_each(fx.assets(spark, d).select("sha", "seq"), ["sha"], ["seq"])


@register("file_new_only", oracle("fx_assets", body="SELECT sha, min(seq) AS seq FROM fx_assets WHERE seq % 3 <> 0 AND sha NOT IN (SELECT sha FROM fx_assets WHERE seq % 3 = 0) GROUP BY sha"))
def file_new_only(spark, d):
    a = fx.assets(spark, d).select("sha", "seq")
    return A.new_only(a.where("seq % 3 <> 0"), a.where("seq % 3 = 0"), ["sha"], ["seq"])


@register(
    "track_dedup",
    oracle("fx_points", body="""k AS (SELECT track_id, sha256(coalesce(first(day ORDER BY vidx) FILTER (day IS NOT NULL), '') || '|' || string_agg(CAST(CAST(x AS BIGINT) % 4 AS VARCHAR), ',' ORDER BY vidx)) AS key, min(event_id) AS seq FROM fx_points GROUP BY track_id)
  SELECT key, min(seq) AS seq FROM k GROUP BY key"""),
)
def track_dedup(spark, d):
    p = fx.points(spark, d)
    shape = p.groupBy("track_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("vidx", (F.col("x").cast("long") % 4).cast("string").alias("c")))), lambda s: s["c"]), ",").alias("coords"), F.min("event_id").alias("seq"))
    keyed = shape.join(J.track_days(p), "track_id").select(A.content_key(F.col("day"), F.col("coords")).alias("key"), "seq")
    return A.first_of_each(keyed, ["key"], ["seq"])


@register("plate_digest", oracle("fx_assets", body="SELECT bundle, substr(sha256(string_agg(name || ':' || sha, chr(10) ORDER BY name || ':' || sha)), 1, 12) AS digest FROM fx_assets GROUP BY bundle"))
def plate_digest(spark, d):
    return A.bundle_digest(fx.assets(spark, d))


_TWO = "l AS (SELECT bundle, name, sha FROM fx_assets WHERE seq % 5 <> 0), f AS (SELECT bundle, name, CASE WHEN seq % 7 = 0 THEN 'changed' ELSE sha END AS sha FROM fx_assets WHERE seq % 11 <> 0)"


def _two(spark, d):
    a = fx.assets(spark, d)
    return a.where("seq % 5 <> 0").select("bundle", "name", "sha"), a.where("seq % 11 <> 0").select("bundle", "name", F.when(F.col("seq") % 7 == 0, "changed").otherwise(F.col("sha")).alias("sha"))


@register(
    "plate_verify",
    oracle("fx_assets", body=_TWO + """ SELECT coalesce(l.bundle, f.bundle) AS bundle, coalesce(l.name, f.name) AS name, CASE WHEN l.name IS NULL THEN 'unlisted' WHEN f.name IS NULL THEN 'missing' WHEN l.sha = f.sha THEN 'ok' ELSE 'drift' END AS verdict
  FROM l FULL JOIN f ON l.bundle = f.bundle AND l.name = f.name"""),
)
def plate_verify(spark, d):
    return A.verify(*_two(spark, d))


@register(
    "asset_drift",
    oracle("fx_assets", body=_TWO + """ SELECT l.bundle, CASE WHEN f.name IS NULL THEN 'missing' WHEN l.sha = f.sha THEN 'ok' ELSE 'drift' END AS verdict, count(*) AS n FROM l LEFT JOIN f ON l.bundle = f.bundle AND l.name = f.name GROUP BY 1, 2"""),
)
def asset_drift(spark, d):
    return A.verify(*_two(spark, d)).where("verdict <> 'unlisted'").groupBy("bundle", "verdict").agg(F.count("*").alias("n"))


@register(
    "index_merge",
    oracle("fx_assets", body="""f AS (SELECT bundle AS name, list(name) AS assets, CASE WHEN max(seq) % 2 = 0 THEN 'dem' END AS terrain FROM fx_assets WHERE bytes >= 500 AND bundle <> 'src3' GROUP BY bundle),
  p AS (SELECT bundle AS name, list(name) AS assets, 'old' AS terrain FROM fx_assets WHERE (bytes IS NULL OR bytes < 2000) AND bundle <> 'src5' GROUP BY bundle)
  SELECT coalesce(f.name, p.name) AS name, len(list_distinct(list_concat(coalesce(f.assets, []), coalesce(p.assets, [])))) AS n, coalesce(f.terrain, p.terrain) AS terrain FROM f FULL JOIN p ON f.name = p.name"""),
)
def index_merge(spark, d):
    a = fx.assets(spark, d).withColumnsRenamed({"name": "asset", "bundle": "name"})
    f, p = a.where("bytes >= 500 AND name <> 'src3'"), a.where("(bytes IS NULL OR bytes < 2000) AND name <> 'src5'")
    each = lambda rows, terrain: rows.groupBy("name").agg(terrain.alias("terrain"))
    terrain = A.merged_terrain(each(f, F.when(F.max("seq") % 2 == 0, "dem")), each(p, F.max(F.lit("old"))))
    return A.merged_assets(f, p).groupBy("name").agg(F.count("*").alias("n")).join(terrain, "name").select("name", "n", "terrain")


@register("session_latest", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def session_latest(spark, d):
    e = fx.table(spark, d, "events").select("user_id", "ts", "event_id", "event_type")
    return A.latest(e, "user_id", ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@register(
    "session_patched",
    "SELECT user_id, arg_max(value, event_id) FILTER (event_type = 'purchase') AS paid, arg_max(event_type, event_id) FILTER (event_type <> 'view') AS did FROM events GROUP BY user_id",
)
def session_patched(spark, d):
    e = fx.table(spark, d, "events").select("user_id", "event_id", F.when(F.col("event_type") == "purchase", F.col("value")).alias("paid"), F.when(F.col("event_type") != "view", F.col("event_type")).alias("did"))
    return A.patched(e, "user_id", "event_id", ["paid", "did"])


@register("job_state", "SELECT user_id AS jid, CASE event_type WHEN 'signup' THEN 'queued' WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'error' ELSE 'running' END AS state FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def job_state(spark, d):
    e = fx.table(spark, d, "events").select(F.col("user_id").alias("jid"), "ts", "event_id", "event_type")
    state = F.when(F.col("event_type") == "signup", "queued").when(F.col("event_type") == "purchase", "done").when(F.col("event_type") == "error", "error").otherwise("running")
    return A.latest(e, "jid", ["ts", "event_id"]).select("jid", state.alias("state"))


@register("ttl_evict", "SELECT event_id, user_id FROM events WHERE epoch_us(ts) / 1000000.0::DOUBLE < 1705000000 - 86400 AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 250)")
def ttl_evict(spark, d):
    e = fx.table(spark, d, "events").select("event_id", "user_id", "event_type", "value", fx.seconds().alias("t"))
    return A.expired(e, e.where("event_type = 'purchase' AND value > 250"), "user_id", "t", 1705000000.0, 86400.0).select("event_id", "user_id")


@register(
    "lineage_append",
    """WITH h AS (SELECT o_custkey, list(o_orderkey ORDER BY o_orderkey) AS h FROM orders GROUP BY o_custkey), n AS (SELECT o_custkey, list_append(h, -1) AS h FROM h)
  SELECT o_custkey, CASE WHEN len(h) > 8 THEN h[len(h) - 7:] ELSE h END AS lineage, CAST(least(999, o_custkey + 1) AS BIGINT) AS edition FROM n""",
)
def lineage_append(spark, d):
    h = fx.table(spark, d, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list("o_orderkey")).alias("h"))
    return h.select("o_custkey", A.append_lineage(F.col("h"), F.lit(-1).cast("long"), 8).alias("lineage"), A.next_edition(F.col("o_custkey")).alias("edition"))


@register(
    "spec_validate",
    """SELECT o_orderkey, CASE WHEN o_orderstatus NOT IN ('O', 'F', 'P') OR o_orderstatus = 'P' THEN 'kind' WHEN NOT (w >= 6 AND w <= 40) THEN 'width' WHEN NOT (h > 0 AND w * h * 90000 <= 120000000) THEN 'too_large'
   WHEN NOT abs(w / h - 0.75::DOUBLE) <= 0.4::DOUBLE THEN 'aspect' END AS error
  FROM (SELECT *, CAST(o_orderkey % 50 AS DOUBLE) AS w, CAST(o_orderkey % 61 AS DOUBLE) AS h FROM orders)""",
)
def spec_validate(spark, d):
    o = fx.table(spark, d, "orders").select("o_orderkey", "o_orderstatus", (F.col("o_orderkey") % 50).cast("double").alias("w"), (F.col("o_orderkey") % 61).cast("double").alias("h"))
    rules = [
        ("kind", F.col("o_orderstatus").isin("O", "F")),
        ("width", F.col("w").between(6, 40)),
        ("too_large", (F.col("h") > 0) & (F.col("w") * F.col("h") * 90000 <= 120000000)),
        ("aspect", F.abs(F.try_divide("w", "h") - 0.75) <= 0.4),
    ]
    return o.select("o_orderkey", A.first_error(rules).alias("error"))


@register(
    "manifest_bounds",
    oracle("fx_users", body="SELECT track_id, count(*) AS n, count(*) <= 70 AND bool_and(x < 720000) AS accepted FROM fx_users GROUP BY track_id"),
)
def manifest_bounds(spark, d):
    lines = fx.points(spark, d, by_user=True).groupBy("track_id").agg(F.collect_list(F.array("x", "y")).alias("coords"))
    good = (F.size("coords") <= 70) & F.forall("coords", lambda c: (F.size(c) == 2) & (F.get(c, F.lit(0)) < 720000))
    return lines.select("track_id", F.size("coords").cast("long").alias("n"), good.alias("accepted"))


@register("pack_version_ok", oracle("fx_assets", body="SELECT seq, CASE WHEN regexp_matches(substr(sha, 1, CAST(10 + seq % 4 AS INTEGER)), '^[0-9a-f]{12}$') THEN substr(sha, 1, CAST(10 + seq % 4 AS INTEGER)) END AS version FROM fx_assets"))
def pack_version_ok(spark, d):
    v = F.substring(F.col("sha"), F.lit(1), (10 + F.col("seq") % 4).cast("int"))
    return fx.assets(spark, d).select("seq", F.when(v.rlike("^[0-9a-f]{12}$"), v).alias("version"))


@register("slug_ids", "SELECT p_partkey, CASE WHEN s = '' THEN 'region' ELSE s END AS slug FROM (SELECT p_partkey, trim(regexp_replace(lower(p_name || ' & ' || p_type), '[^a-z0-9]+', '_', 'g'), '_') AS s FROM part)")
def slug_ids(spark, d):
    return fx.table(spark, d, "part").select("p_partkey", T.slug(F.concat_ws(" & ", "p_name", "p_type")).alias("slug"))


@register(
    "symbol_icon",
    "SELECT p_partkey, CASE " + " ".join(f"WHEN contains(s, '{k}') THEN '{v}'" for k, v in T.SYMBOL_ICONS) + " ELSE 'flag' END AS icon FROM (SELECT p_partkey, lower(p_type || ' ' || CASE p_partkey % 5 WHEN 0 THEN 'Summit camp' WHEN 1 THEN 'Water tent' WHEN 2 THEN 'VIEW point' ELSE '' END) AS s FROM part)",
)
def symbol_icon(spark, d):
    k = F.col("p_partkey") % 5
    sym = F.concat_ws(" ", "p_type", F.when(k == 0, "Summit camp").when(k == 1, "Water tent").when(k == 2, "VIEW point").otherwise(""))
    return fx.table(spark, d, "part").select("p_partkey", T.symbol_icon(sym).alias("icon"))


@register(
    "way_class",
    "SELECT p_partkey, CASE p_size % 7 WHEN 0 THEN 'trail' WHEN 1 THEN 'trail' WHEN 2 THEN 'trail' WHEN 3 THEN '4wd' WHEN 6 THEN 'trail' ELSE 'road' END AS class FROM part",
)
def way_class(spark, d):
    tags = F.array(*map(F.lit, ("path", "footway", "bridleway", "track", "primary", "service", "cycleway")))
    return fx.table(spark, d, "part").select("p_partkey", T.way_class(F.get(tags, F.col("p_size") % 7)).alias("class"))


CREDITS = [("src1", "Survey One"), ("src", "Other survey")]


@register("credit_line", "SELECT n_regionkey, substr(string_agg(CASE WHEN contains(n_name, 'A') THEN 'Alpha data' WHEN contains(n_name, 'E') THEN 'Echo data' ELSE n_name END, ' - ' ORDER BY n_nationkey), 1, 60) AS credit FROM nation GROUP BY n_regionkey")
def credit_line(spark, d):
    named = fx.table(spark, d, "nation").groupBy("n_regionkey").agg(F.transform(F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda s: s["n_name"]).alias("ds"))
    return named.select("n_regionkey", T.credit_line(F.col("ds"), [("A", "Alpha data"), ("E", "Echo data")], 60).alias("credit"))


@register(
    "year_spans",
    """WITH y AS (SELECT o_custkey, min(strftime(o_orderdate, '%Y')) AS a, max(strftime(o_orderdate, '%Y')) AS b FROM orders GROUP BY o_custkey)
  SELECT o_custkey, CASE WHEN a = b THEN a ELSE a || '–' || b END AS years, 'map_r' || CASE WHEN o_custkey % 3 >= 2 THEN '_edition-' || (o_custkey % 3) ELSE '' END || '_' || CASE WHEN a = b THEN a ELSE a || '-' || b END || '_film.png' AS file FROM y""",
)
def year_spans(spark, d):
    o = fx.table(spark, d, "orders").groupBy("o_custkey").agg(F.collect_list(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("days"))
    o = o.withColumn("years", T.year_span(F.col("days")))
    return o.select("o_custkey", "years", T.file_name("map", F.lit("r"), F.col("o_custkey") % 3, F.col("years"), "_film", "png").alias("file"))


@register("iso_times", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS iso, floor(epoch_us(ts) / 1000000.0::DOUBLE) AS t FROM events")
def iso_times(spark, d):
    e = fx.table(spark, d, "events").select("event_id", T.iso19(fx.seconds()).alias("iso"))
    return e.select("event_id", "iso", T.iso_seconds(F.concat("iso", F.lit("Z"))).alias("t"))


@register(
    "hex_colours",
    oracle("fx_assets", body="SELECT seq, CASE WHEN seq % 4 <> 0 THEN CAST(('0x' || substr(sha, 1, 2)) AS INTEGER) END AS r, CASE WHEN seq % 4 <> 0 THEN CAST(('0x' || substr(sha, 3, 2)) AS INTEGER) END AS g, CASE WHEN seq % 4 <> 0 THEN CAST(('0x' || substr(sha, 5, 2)) AS INTEGER) END AS b FROM fx_assets"),
)
def hex_colours(spark, d):
    text = F.concat(F.when(F.col("seq") % 4 != 0, "#").otherwise("x"), F.substring("sha", 1, 6))
    return fx.assets(spark, d).select("seq", T.hex_colour(text).alias("c")).select("seq", "c.r", "c.g", "c.b")


@register("markup_scan", "SELECT page_id, link, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS link FROM pages) GROUP BY page_id, link")
def markup_scan(spark, d):
    found = fx.table(spark, d, "pages").select("page_id", F.explode(T.links(F.col("html"), "href")).alias("link"))
    return found.groupBy("page_id", "link").agg(F.count("*").alias("n"))


@register("palette_search", "SELECT p_partkey FROM part WHERE contains(lower(p_name), 'ar') OR contains(lower(p_type), 'ar') ORDER BY p_partkey LIMIT 40")
def palette_search(spark, d):
    return fx.table(spark, d, "part").where(T.search(F.array("p_name", "p_type"), "AR")).orderBy("p_partkey").limit(40).select("p_partkey")


@register(
    "label_bake",
    "SELECT kind, name, size FROM (SELECT p_brand AS kind, lower(p_name) AS name, p_size AS size, row_number() OVER (PARTITION BY p_brand, lower(p_name) ORDER BY p_size DESC, p_partkey) AS n FROM part) WHERE n = 1",
)
def label_bake(spark, d):
    p = fx.table(spark, d, "part").select(F.col("p_brand").alias("kind"), F.lower("p_name").alias("name"), F.col("p_size").alias("size"), (-F.col("p_size")).alias("neg"), "p_partkey")
    return A.first_of_each(p, ["kind", "name"], ["neg", "p_partkey"]).select("kind", "name", "size")


@register(
    "set_ops",
    """WITH a AS (SELECT DISTINCT source FROM documents WHERE lang = 'en'), b AS (SELECT DISTINCT source FROM documents WHERE lang <> 'en')
  SELECT 'both' AS op, count(*) AS n FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'either', count(*) FROM (SELECT * FROM a UNION SELECT * FROM b) UNION ALL SELECT 'first', count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'all', (SELECT count(*) FROM a) + (SELECT count(*) FROM b)""",
)
def set_ops(spark, d):
    docs = fx.table(spark, d, "documents")
    a, b = docs.where("lang = 'en'").select("source").distinct(), docs.where("lang <> 'en'").select("source").distinct()
    sets = {"both": a.intersect(b), "either": a.union(b).distinct(), "first": a.subtract(b), "all": a.unionAll(b)}
    return J.union_all(s.agg(F.count("*").alias("n")).select(F.lit(op).alias("op"), "n") for op, s in sets.items())


PRESETS = [("phone", 1170, 2532, 460.0), ("tablet", 1640, 2360, 264.0), ("desk", 2560, 1440, 109.0), ("desk2", 2560, 1440, 109.5)]


@register(
    "preset_match",
    "WITH p(id, w, h, ppi) AS (VALUES " + ", ".join(f"('{i}', {w}, {h}, {p}::DOUBLE)" for i, w, h, p in PRESETS) + """), s AS (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 1170 WHEN 1 THEN 2560 ELSE 5 END AS w, CASE o_orderkey % 3 WHEN 0 THEN 2532 WHEN 1 THEN 1440 ELSE 5 END AS h, CASE o_orderkey % 3 WHEN 0 THEN 460.4::DOUBLE ELSE 109.2::DOUBLE END AS ppi FROM orders)
  SELECT o_orderkey, min(id) AS preset FROM s JOIN p ON s.w = p.w AND s.h = p.h AND abs(s.ppi - p.ppi) < 1 GROUP BY o_orderkey""",
)
def preset_match(spark, d):
    k = F.col("o_orderkey") % 3
    pick = lambda a, b, c: F.when(k == 0, a).when(k == 1, b).otherwise(c)
    specs = fx.table(spark, d, "orders").select("o_orderkey", pick(1170, 2560, 5).alias("w"), pick(2532, 1440, 5).alias("h"), pick(460.4, 109.2, 109.2).alias("ppi"))
    presets = spark.createDataFrame(PRESETS, "id string, w int, h int, p double")
    met = specs.join(F.broadcast(presets), ["w", "h"]).where(F.abs(F.col("ppi") - F.col("p")) < 1)  # a table of fixed size
    return met.groupBy("o_orderkey").agg(F.min("id").alias("preset"))


@register("preset_cross", "SELECT n_nationkey, id, round(w / ppi, 4) AS width_in FROM nation, (VALUES " + ", ".join(f"('{i}', {w}, {p}::DOUBLE)" for i, w, _, p in PRESETS) + ") p(id, w, ppi)")
def preset_cross(spark, d):
    presets = spark.createDataFrame(PRESETS, "id string, w int, h int, ppi double")
    return fx.table(spark, d, "nation").join(F.broadcast(presets)).select("n_nationkey", "id", F.round(F.col("w") / F.col("ppi"), 4).alias("width_in"))


@register(
    "guarded_lookups",
    """WITH s AS (SELECT c_custkey AS id, CASE WHEN c_nationkey % 6 = 5 THEN 99 ELSE c_nationkey % 6 END AS region_id, c_acctbal > 0 AS stamped FROM customer WHERE c_custkey % 5 > 0)
  SELECT o_orderkey AS request, CASE WHEN why IN ('no_session', 'no_region') THEN 404 WHEN why IS NULL THEN 200 ELSE 422 END AS status, why FROM (
   SELECT o_orderkey, CASE WHEN s.id IS NULL THEN 'no_session' WHEN r_regionkey IS NULL THEN 'no_region' WHEN NOT stamped THEN 'not_accepted' WHEN o_orderstatus NOT IN ('F', 'O') THEN 'format' END AS why
   FROM orders LEFT JOIN s ON o_custkey = s.id LEFT JOIN region ON r_regionkey = region_id)""",
)
def guarded_lookups(spark, d):
    c = fx.table(spark, d, "customer").where("c_custkey % 5 > 0")
    known = c.select(F.col("c_custkey").alias("session_id"), F.when(F.col("c_nationkey") % 6 == 5, 99).otherwise(F.col("c_nationkey") % 6).alias("region_id"), (F.col("c_acctbal") > 0).alias("stamped"), F.array(F.lit("f"), F.lit("o")).alias("formats"))
    requests = fx.table(spark, d, "orders").select(F.col("o_orderkey").alias("request"), F.col("o_custkey").alias("session_id"), F.col("o_orderstatus").alias("format"))
    return A.guarded(requests, known, fx.table(spark, d, "region").select(F.col("r_regionkey").alias("region_id")))


@register("plate_check", "SELECT o_orderkey AS file, CASE WHEN o_orderkey % 7 > 4 THEN 'no_region' WHEN o_orderkey % 3 = 1 AND o_orderkey % 7 <> 2 THEN 'mismatch' ELSE 'ok' END AS verdict FROM orders")
def plate_check(spark, d):
    k = F.col("o_orderkey")
    files = fx.table(spark, d, "orders").select(k.alias("file"), (k % 7).cast("int").alias("region_id"), F.when(k % 3 == 0, "v").when(k % 3 == 1, "w").alias("version"))
    plates = fx.table(spark, d, "region").select(F.col("r_regionkey").alias("region_id"), F.when(F.col("r_regionkey") != 2, "v").alias("version"))
    return A.plate_check(files, plates)


@register(
    "unique_ids",
    """WITH f AS (SELECT p_partkey AS nth, lower(p_brand) || p_size % 10 AS slug, row_number() OVER (PARTITION BY lower(p_brand) || p_size % 10 ORDER BY p_partkey) AS k FROM part)
  SELECT nth, CASE WHEN k > 98 THEN NULL WHEN k = 1 THEN slug ELSE slug || '_' || CASE WHEN k < 3 THEN k ELSE k + 1 END END AS id FROM f""",
)
def unique_ids(spark, d):
    """The third name of every slug is taken already. The table is read whole; nth is its key."""
    fresh = fx.table(spark, d, "part").select(F.col("p_partkey").alias("nth"), F.concat(F.lower("p_brand"), (F.col("p_size") % 10).cast("string")).alias("slug"))
    return A.unique_ids(fresh, fresh.select(F.concat("slug", F.lit("_3")).alias("id")).distinct()).select("nth", "id")


_KEYS = ("a/b.png", "a//./b.png", "a/../b.png", "../b.png", "a/../../b.png", "/etc/x", "", "..", "a/..")


@register("safe_keys", "SELECT p_partkey, CASE p_partkey % 9 WHEN 0 THEN 'a/b.png' WHEN 1 THEN 'a/b.png' WHEN 2 THEN 'b.png' END AS key FROM part")
def safe_keys(spark, d):
    key = F.get(F.array(*map(F.lit, _KEYS)), (F.col("p_partkey") % 9).cast("int"))
    return fx.table(spark, d, "part").select("p_partkey", A.safe_key(key).alias("key"))


@register(
    "grouped_jobs",
    """WITH j AS (SELECT o_orderkey AS jid, o_orderkey AS seq, CASE WHEN o_custkey % 3 > 0 THEN 'kit' || o_custkey END AS name FROM orders), g AS (SELECT name, CASE WHEN name IS NULL THEN jid END AS alone, count(*) AS members, min(seq) AS first FROM j GROUP BY 1, 2)
  SELECT name, alone, members, CAST(row_number() OVER (PARTITION BY name IS NULL ORDER BY first) AS INTEGER) AS place FROM g""",
)
def grouped_jobs(spark, d):
    o = fx.table(spark, d, "orders").select(F.col("o_orderkey").alias("jid"), F.col("o_orderkey").alias("seq"), F.when(F.col("o_custkey") % 3 > 0, F.concat(F.lit("kit"), F.col("o_custkey").cast("string"))).alias("name"))
    return A.grouped_jobs(o).select("name", "alone", "members", "place")


@register(
    "parsed_values",
    """SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 1.5::DOUBLE WHEN 1 THEN -200.0::DOUBLE END AS n, CASE p_partkey % 6 WHEN 0 THEN 2 WHEN 1 THEN 1 END AS sizes, CASE p_partkey % 6 WHEN 0 THEN 630 WHEN 1 THEN 1350 END AS last_h FROM part""",
)
def parsed_values(spark, d):
    pick = lambda *values: F.get(F.array(*(F.lit(v).cast("string") for v in values)), (F.col("p_partkey") % 6).cast("int"))
    n, s = pick("1.5", "-2e2", "nan", "Infinity", "1,5", None), pick("1080x1350, 1200x630", "1080X1350", "0x5", "5000x5", "12x", None)
    rows = fx.table(spark, d, "part").select("p_partkey", T.finite_number(n).alias("n"), T.sizes(s, 2160).alias("s"))
    return rows.select("p_partkey", "n", F.when(F.col("s").isNotNull(), F.size("s")).alias("sizes"), F.element_at("s", -1)["h"].alias("last_h"))


@register(
    "archive_names",
    """SELECT p_partkey, p_partkey % 6 IN (0, 5) AS ok FROM part""",
)
def archive_names(spark, d):
    """Member lists of archives: whole, short of the sources, with a repeat, from elsewhere, climbing out, and with the heights."""
    k = F.col("p_partkey")
    folder = F.concat(F.lit("r"), (k % 9).cast("string"))
    at = lambda *names: F.array(*(F.concat(folder, F.lit("/"), F.lit(n)) for n in names))
    lists = F.array(at("sources.json"), at("dem.tif"), at("sources.json", "dem.tif", "dem.tif"), F.concat(at("sources.json"), F.array(F.lit("elsewhere/dem.tif"))), at("sources.json", "../etc"), at("sources.json", "dem.tif"))
    names = F.get(lists, (k % 6).cast("int"))
    return fx.table(spark, d, "part").select("p_partkey", A.archive_names_ok(names, folder, ["dem.tif", "sources.json"]).alias("ok"))


@register(
    "same_sets",
    """WITH a AS (SELECT DISTINCT l_suppkey AS k FROM lineitem), b AS (SELECT s_suppkey AS k FROM supplier), c AS (SELECT DISTINCT o_custkey AS k FROM orders), e AS (SELECT c_custkey AS k FROM customer)
  SELECT 'suppliers' AS what, (SELECT count(*) FROM a ANTI JOIN b USING (k)) + (SELECT count(*) FROM b ANTI JOIN a USING (k)) = 0 AS same
  UNION ALL SELECT 'customers', (SELECT count(*) FROM c ANTI JOIN e USING (k)) + (SELECT count(*) FROM e ANTI JOIN c USING (k)) = 0""",
)
def same_sets(spark, d):
    """Whether those that lines and orders name are those that there are; names are repeated there."""
    named = lambda t, c: fx.table(spark, d, t).select(F.col(c).cast("long").alias("k"))
    rows = [("suppliers", A.same_sets(named("lineitem", "l_suppkey"), named("supplier", "s_suppkey"))), ("customers", A.same_sets(named("orders", "o_custkey"), named("customer", "c_custkey")))]
    return spark.createDataFrame(rows, "what string, same boolean")
