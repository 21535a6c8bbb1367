"""Queries that write stores and recorded pages into the shared folder and read them back."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from terravia import fixtures as fx
from terravia.catalog import register
from terravia.operators import bakes as B
from terravia.shared import discard, fresh_path, kept
from terravia.sources import blobs, documents, paged, store
from terravia.streaming import slots


@register(
    "store_round_trip",
    """WITH k AS (SELECT user_id || '/' || event_type || '.json' AS key, user_id, min_by(value, event_id) AS a, max_by(value, event_id) AS b, min(event_id) AS ia, max(event_id) AS ib FROM events GROUP BY 1, 2)
  SELECT key, CASE WHEN user_id % 3 = 0 THEN b ELSE a END AS value, CASE WHEN user_id % 3 = 0 THEN ib ELSE ia END AS at FROM k WHERE user_id % 7 <> 0 OR user_id % 3 = 0""",
)
def store_round_trip(spark, d):
    """The first value of each key, then for a third of the users the last, then a seventh of the rest taken out."""
    path = fresh_path(spark, "store")
    u = F.col("user_id")
    e = fx.table(spark, d, "events").select(F.concat(u.cast("string"), F.lit("/"), "event_type", F.lit(".json")).alias("key"), "user_id", "value", F.col("event_id").alias("at"))
    first = e.groupBy("key", "user_id").agg(F.min_by("value", "at").alias("value"), F.min("at").alias("at"))
    store.put(first.select("key", "value", "at"), path)
    store.put(e.where(u % 3 == 0).select("key", "value", "at"), path)
    store.delete(e.where((u % 7 == 0) & (u % 3 != 0)).select("key").distinct(), path)
    out = kept(store.get(spark, path).select("key", "value", "at"))
    discard(path)
    return out


_CLASS = "CASE p_size % 6 WHEN 0 THEN 'Range' WHEN 1 THEN 'Summit' WHEN 2 THEN 'Gap' WHEN 3 THEN 'Valley' WHEN 4 THEN 'Swamp' ELSE 'Flat' END"


@register(
    "paged_landforms",
    f"""WITH f AS (SELECT p_partkey, p_size % 10 AS tile, trim(CASE WHEN p_partkey % 9 = 0 THEN '  ' ELSE p_name END) AS name, {_CLASS} AS class FROM part WHERE p_size % 10 IN (1, 2, 4, 7))
  SELECT p_partkey AS id, tile, name, CASE class WHEN 'Range' THEN 'range' WHEN 'Summit' THEN 'summit' WHEN 'Gap' THEN 'gap' WHEN 'Valley' THEN 'valley' ELSE 'flat' END AS kind,
    CASE class WHEN 'Range' THEN 100 WHEN 'Summit' THEN 70 WHEN 'Gap' THEN 55 WHEN 'Valley' THEN 40 ELSE 42 END AS rank FROM f WHERE name <> '' AND class <> 'Swamp' AND p_partkey % 11 <> 0""",
)
def paged_landforms(spark, d):
    """Parts as named features of ten tiles in pages of fifty; four tiles are asked for."""
    paged.register(spark)
    path, size = fresh_path(spark, "pages"), 50
    p = fx.table(spark, d, "part")
    name = F.when(F.col("p_partkey") % 9 == 0, "  ").otherwise(F.col("p_name"))
    points = F.when(F.col("p_partkey") % 11 != 0, F.array(F.array(F.lit(-121.0), F.lit(40.0))))
    feature = F.to_json(F.struct(F.struct(F.col("p_partkey").alias("id"), name.alias("gaz_name"), F.expr(_CLASS).alias("gaz_featureclass")).alias("attributes"), F.struct(points.alias("points")).alias("geometry")))
    tile = F.col("p_size") % 10
    numbered = p.select(tile.alias("tile"), "p_partkey", feature.alias("f")).withColumn("k", F.row_number().over(Window.partitionBy("tile").orderBy("p_partkey")) - 1)
    paged_ = numbered.groupBy("tile", F.floor(F.col("k") / size).cast("int").alias("page")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "f"))), lambda s: s["f"]), ",").alias("fs"))
    last = F.max("page").over(Window.partitionBy("tile"))
    text = F.concat(F.lit('{"features":['), "fs", F.lit('],"exceededTransferLimit":'), F.when(F.col("page") < last, "true").otherwise("false"), F.lit("}"))
    paged_.select("tile", "page", text.alias("text")).write.partitionBy("tile", "page").text(path)
    raw = spark.read.format(paged.NAME).option("path", path).option("page_size", size).load().where(F.col("tile").isin(1, 2, 4, 7))
    schema = "attributes STRUCT<id: BIGINT, gaz_name: STRING, gaz_featureclass: STRING>, geometry STRUCT<points: ARRAY<ARRAY<DOUBLE>>>"
    read = raw.select("tile", F.from_json("feature", schema).alias("f")).select("tile", F.col("f.attributes.id").alias("id"), F.col("f.attributes.gaz_name").alias("name"), F.col("f.attributes.gaz_featureclass").alias("class"), F.coalesce("f.geometry.points", F.array().cast("array<array<double>>")).alias("points"))
    # landforms() keeps name, kind and rank; the id rides along in front of the name
    keyed = read.withColumn("name", F.when(F.trim("name") != "", F.concat_ws("\t", F.col("id").cast("string"), F.col("tile").cast("string"), F.trim("name"))))
    found = B.landforms(keyed).select(F.split("name", "\t").alias("n"), "kind", "rank")
    out = kept(found.select(F.col("n")[0].cast("long").alias("id"), F.col("n")[1].cast("int").alias("tile"), F.col("n")[2].alias("name"), "kind", "rank"))
    discard(path)
    return out


_JOBS = "SELECT user_id % 20 AS pool, event_id AS jid, CASE event_type WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'error' ELSE 'submit' END AS kind, epoch_us(ts) // 1000 AS moment FROM events"


@register(
    "slot_starts",
    f"""WITH e AS ({_JOBS}), c AS (SELECT *, row_number() OVER (PARTITION BY pool ORDER BY moment, jid) AS k FROM e WHERE kind = 'submit'), f AS (SELECT pool, moment AS free, row_number() OVER (PARTITION BY pool ORDER BY moment, jid) AS m FROM e WHERE kind <> 'submit')
  SELECT c.pool, jid, CASE WHEN k <= 3 THEN moment ELSE greatest(moment, free) END AS "at" FROM c LEFT JOIN f ON c.pool = f.pool AND m = k - 3 WHERE k <= 3 OR free IS NOT NULL""",
)
def slot_starts(spark, d):
    """Events of twenty pools of three slots: what is bought or fails gives a slot back, all else asks for one."""
    e = fx.table(spark, d, "events")
    kind = F.when(F.col("event_type") == "purchase", "done").when(F.col("event_type") == "error", "error").otherwise("submit")
    rows = e.select((F.col("user_id") % 20).alias("pool"), F.col("event_id").alias("jid"), kind.alias("kind"), F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts) div 1000").alias("at"))
    return slots.started(rows, 3)


@register(
    "manifest_sources",
    """WITH a AS (SELECT source AS id, count(*) AS n, sum(n_chars)::BIGINT AS b, sha256(min(text)) AS sha FROM documents GROUP BY source)
  SELECT id, 2 AS assets, CASE WHEN n % 2 = 0 THEN 2 ELSE 1 END AS sources, sha, b AS bytes, 'kept as it was' AS rebuild FROM a""",
)
def manifest_sources(spark, d):
    """A manifest for each source of documents: its labels asset is refreshed, and the labels' own source entered once, however often."""
    t = fx.table(spark, d, "documents")
    per = t.groupBy(F.col("source").alias("id")).agg(F.count("*").alias("n"), F.sum("n_chars").alias("bytes"), F.sha2(F.min("text"), 256).alias("sha"))
    before = F.when(F.col("n") % 2 == 0, F.lit('[{"dataset":"Heights","via":"x","license":"y"}]')).otherwise(F.lit('[{"dataset":"Names of Landforms","via":"old","license":"z"}]'))
    text = F.concat(F.lit('{"id":"'), "id", F.lit('","built":"2024-01-01","rebuild":"kept as it was","assets":{"dem.tif":{"sha256":"aa","bytes":5},"labels.json":{"sha256":"old","bytes":1}},"sources":'), before, F.lit("}"))
    rows = per.select("id", text.alias("manifest"), F.lit("labels.json").alias("name"), "sha", "bytes")
    once = documents.with_asset(rows, ("Names of Landforms", "pages", "public"))
    twice = documents.with_asset(once, ("Names of Landforms", "pages", "public"))
    m = F.from_json("manifest", documents.MANIFEST)
    out = twice.withColumn("m", m)
    return out.select("id", F.size("m.assets").alias("assets"), F.size("m.sources").alias("sources"), F.col("m.assets")["labels.json"]["sha256"].alias("sha"), F.col("m.assets")["labels.json"]["bytes"].alias("bytes"), F.col("m.rebuild").alias("rebuild"))


@register(
    "sidecars_read",
    """WITH c AS (SELECT n_regionkey AS k, n_nationkey AS n, n_name AS name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS i FROM nation), r AS (SELECT r_regionkey AS k, r_name AS region_id FROM region)
  SELECT region_id, 'label' AS kind, CAST(i AS INTEGER) AS nth, name, CAST(40 + n AS INTEGER) AS rank, 1 + n % 3 AS points FROM c JOIN r USING (k)
  UNION ALL SELECT region_id, 'lake', CAST(i AS INTEGER), CASE WHEN n % 2 = 0 THEN name ELSE '' END, NULL, 3 + n % 4 FROM c JOIN r USING (k) WHERE k <> 3
  UNION ALL SELECT region_id, 'river', CAST(i AS INTEGER), name, CAST(3 + n % 5 AS INTEGER), 2 + n % 4 FROM c JOIN r USING (k) WHERE k <> 3
  UNION ALL SELECT region_id, 'region', 0, 'The ' || region_id, NULL, 4 FROM r""",
)
def sidecars_read(spark, d):
    """Each region's catalogue entry, labels and waters, written as files and read; one region has no waters."""
    root = fresh_path(spark, "regions")
    n = F.col("n_nationkey")
    at = lambda count: F.transform(F.sequence(F.lit(1), count), lambda i: F.array(i.cast("double"), F.lit(40.5)))
    t = fx.table(spark, d, "nation").join(fx.table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    listed = lambda s: F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", s.alias("s")))), lambda x: x["s"])
    label = F.struct(F.col("n_name").alias("name"), F.lit("summit").alias("kind"), (40 + n).cast("int").alias("rank"), at(1 + n % 3).alias("coords"))
    lake = F.struct(at(3 + n % 4).alias("coords"), F.when(n % 2 == 0, F.col("n_name")).alias("name"))
    river = F.struct(at(2 + n % 4).alias("coords"), (3 + n % 5).cast("int").alias("order"), F.col("n_name").alias("name"))
    per = t.groupBy("r_regionkey", "r_name").agg(listed(label).alias("features"), listed(lake).alias("lakes"), listed(river).alias("rivers"))
    crs = F.lit("EPSG:32610").alias("crs")
    key = lambda name: F.concat("r_name", F.lit("/"), F.lit(name)).alias("key")
    entry = F.struct(F.col("r_name").alias("id"), F.concat(F.lit("The "), "r_name").alias("name"), crs, F.array(*(F.lit(float(v)) for v in (1, 2, 3, 4))).alias("bounds"), F.lit("later").alias("unknown"))
    files = per.select(key("labels.json"), F.to_json(F.struct(crs, "features")).alias("content"))
    files = files.unionByName(per.where("r_regionkey <> 3").select(key("hydro.json"), F.to_json(F.struct(crs, "lakes", "rivers")).alias("content")))
    files = files.unionByName(per.select(key("region.json"), F.to_json(entry).alias("content")))
    blobs.write(files, root)
    part = lambda rows, kind, rank, points: rows.select("region_id", kind.alias("kind"), "nth", "name", rank.alias("rank"), points.cast("long").alias("points"))
    labels = part(documents.labels(spark, root), F.lit("label"), F.col("rank"), F.size("coords"))
    waters = part(documents.hydro(spark, root), F.col("kind"), F.col("order"), F.size("coords"))
    entries = documents.regions(spark, root).withColumn("nth", F.lit(0))
    regions = part(entries, F.lit("region"), F.lit(None).cast("int"), sum(F.col(c).isNotNull().cast("int") for c in ("min_x", "min_y", "max_x", "max_y")))
    out = kept(labels.unionByName(waters).unionByName(regions))
    discard(root)
    return out


@register(
    "files_verified",
    """SELECT source AS bundle, CAST(doc_id AS VARCHAR) || '.txt' AS name, CASE WHEN doc_id % 7 = 0 THEN 'missing' WHEN doc_id % 5 = 0 THEN 'drift' WHEN doc_id % 3 = 0 THEN 'unlisted' ELSE 'ok' END AS verdict FROM documents""",
)
def files_verified(spark, d):
    """Documents as files; some are not written, some written otherwise, some not listed: what the files' own hashes say."""
    from terravia.operators import assets as A

    root = fresh_path(spark, "plates")
    t = fx.table(spark, d, "documents")
    i, name = F.col("doc_id"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))
    listed = t.where((i % 3 != 0) | (i % 7 == 0) | (i % 5 == 0)).select(F.col("source").alias("bundle"), name.alias("name"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha"))
    there = F.when(i % 5 == 0, F.concat(F.coalesce("text", F.lit("")), F.lit("!"))).otherwise(F.coalesce("text", F.lit("")))
    blobs.write(t.where(i % 7 != 0).select(F.concat("source", F.lit("/"), name).alias("key"), there.alias("content")), root)
    out = kept(A.verify(listed, documents.found_assets(spark, root)))
    blobs.remove(spark, root)
    return out


@register(
    "plate_cards",
    """SELECT DISTINCT 'p' || (page_id % 40) AS region_id, page_id % 40 < 25 AND page_id % 40 % 3 <> 0 AS rendered FROM pages WHERE page_id % 5 <> 4""",
)
def plate_cards(spark, d):
    """Pages show cards of forty plates; an index knows some of them, and of these some as built."""
    root = fresh_path(spark, "farm")
    k = F.col("page_id") % 40
    pages = fx.table(spark, d, "pages").select(F.when(F.col("page_id") % 5 != 4, F.concat(F.coalesce("html", F.lit("")), F.lit('<a data-plate="p'), k.cast("string"), F.lit('"></a><b data-plate=""></b>'))).otherwise("").alias("html"))
    entry = lambda i: F.concat(F.lit('"p'), i.cast("string"), F.lit('":{"glb":"'), F.when(i % 3 != 0, "x.glb").otherwise(""), F.lit('","more":1}'))
    index = fx.table(spark, d, "region").agg(F.concat(F.lit("{"), F.array_join(F.transform(F.sequence(F.lit(0), F.lit(24)), entry), ","), F.lit("}")).alias("content"))
    blobs.write(index.select(F.lit("index.json").alias("key"), "content"), root)
    out = kept(documents.cards(pages, documents.farm_index(spark, f"{root}/index.json")))
    discard(root)
    return out
