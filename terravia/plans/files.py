"""Queries that write files into the shared folder and read them back."""

import io
import struct
import zipfile
import zlib

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from terravia import fixtures as fx
from terravia.catalog import register
from terravia.fixtures import oracle
from terravia.functions.geodesy import lonlat
from terravia.shared import discard, fresh_path, kept
from terravia.sources import blobs, documents
from terravia.sources import tracks as T

_STEP = "(event_id % 600) / 100.0::DOUBLE"
_PLACED = f"ll AS (SELECT *, round(-124.0::DOUBLE + {_STEP}, 2) AS lon, round(38.0::DOUBLE + (event_id % 500) / 100.0::DOUBLE, 2) AS lat FROM fx_points), big AS (SELECT * FROM ll WHERE track_id IN (SELECT track_id FROM ll GROUP BY track_id HAVING count(*) > 1))"


def _placed(spark, d):
    i = F.col("event_id")
    p = fx.points(spark, d)
    return p.select(F.substring_index("track_id", "-", 1).alias("file"), "track_id", "vidx", "event_id", "t", F.round(-124.0 + (i % 600) / 100.0, 2).alias("lon"), F.round(38.0 + (i % 500) / 100.0, 2).alias("lat"))


def _written(texts, name):
    """One text a file, in a folder of its own: a user's upload."""
    path = fresh_path(texts.sparkSession, name)
    # little text makes many files: a fixed count keeps small partitions from being merged into one task
    dealt = texts.repartition(texts.sparkSession.sparkContext.defaultParallelism, "file")
    dealt.select(F.col("file").alias("upload"), "text").write.partitionBy("upload").option("lineSep", "\n").text(path)
    return path


@register(
    "gpx_round_trip",
    oracle("fx_points", body=_PLACED + " SELECT track_id, CAST(row_number() OVER (PARTITION BY track_id ORDER BY vidx) - 1 AS INTEGER) AS pidx, lon, lat, round(floor(t), 0) AS t FROM big"),
)
def gpx_round_trip(spark, d):
    """All tracks as GPX, a file a user, and back."""
    rows = _placed(spark, d).withColumn("time", F.concat(F.date_format(F.timestamp_seconds(F.floor("t")), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")))
    back = T.read_tracks(spark, _written(T.to_gpx(rows), "gpx"))
    return back.select(F.regexp_replace("track_id", "-[0-9]+$", "").alias("track_id"), "pidx", "lon", "lat", T.iso_seconds(F.col("time")).alias("t"))


def _kml(spark, d):
    p = _placed(spark, d)
    point = F.concat_ws(",", F.col("lon").cast("string"), F.col("lat").cast("string"), F.lit("7"))
    lines = p.groupBy("file", "track_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("vidx", point.alias("c")))), lambda s: s["c"]), " \n").alias("c"))
    marks = F.concat(F.lit("<Placemark><name>"), "track_id", F.lit("</name><!-- <LineString> --><k:LineString\n><coordinates>"), "c", F.lit("</coordinates></k:LineString></Placemark>"))
    spots = F.concat(F.lit("<Placemark><name>"), "track_id", F.lit("</name><Point><coordinates>"), F.substring_index("c", " ", 1), F.lit("</coordinates></Point></Placemark>"))
    body = lines.groupBy("file").agg(F.array_join(F.array_sort(F.collect_list(F.concat(marks, spots))), "").alias("x"))
    return body.select("file", F.concat(F.lit("<kml xmlns:k=\"urn:k\"><Document>"), "x", F.lit("</Document></kml>")).alias("text"))


@register("kml_read", oracle("fx_points", body=_PLACED + " SELECT lon, lat, count(*) AS n FROM big GROUP BY lon, lat"))
def kml_read(spark, d):
    back = T.read_tracks(spark, _written(_kml(spark, d), "kml"))
    return back.where("ele = 7").groupBy("lon", "lat").agg(F.count("*").alias("n"))


@register("kml_waypoints", oracle("fx_points", body=_PLACED + """, w AS (SELECT *, row_number() OVER (PARTITION BY split_part(track_id, '-', 1) ORDER BY track_id) AS k FROM ll WHERE vidx = 0) SELECT track_id AS label, lon, lat FROM w WHERE k <= 200"""))
def kml_waypoints(spark, d):
    """The first two hundred points of each file, projected and taken back to degrees."""
    w = T.read_waypoints(spark, _written(_kml(spark, d), "kml"), 10)
    lon, lat = lonlat(F.col("x"), F.col("y"), 10)
    return w.select("label", (F.round(lon, 2) + 0.0).alias("lon"), (F.round(lat, 2) + 0.0).alias("lat"))


_BAD = "event_id % 23 IN (0, 1, 2, 3, 4, 5)"


@register(
    "ingest_counts",
    oracle("fx_points", body=_PLACED + f""", f AS (SELECT split_part(track_id, '-', 1) AS file, track_id, count(*) AS points, count(*) FILTER (NOT {_BAD}) AS good FROM big GROUP BY track_id)
  SELECT file, sum(points)::BIGINT AS points, sum(CASE WHEN good >= 2 THEN good ELSE 0 END)::BIGINT AS kept, sum(points - CASE WHEN good >= 2 THEN good ELSE 0 END)::BIGINT AS dropped, count(*) AS tracks, count(*) FILTER (good < 2) AS dropped_tracks FROM f GROUP BY file"""),
)
def ingest_counts(spark, d):
    """Counts of the whole way from files to tracks; a quarter of the points lie where the zone has no place for them."""
    points = _placed(spark, d).withColumn("lon", F.when(F.expr(_BAD), F.lit(-60.0)).otherwise(F.col("lon")))
    _, counts = T.ingest(spark, _written(T.to_gpx(points), "gpx"), 10)
    return counts.withColumn("file", F.regexp_extract("file", "upload=([^/]+)", 1))


@register(
    "upload_extent",
    oracle("fx_points", body=_PLACED + """, n AS (SELECT split_part(track_id, '-', 1) AS u, min(track_id) AS t FROM big GROUP BY 1), k AS (SELECT u, CASE WHEN CAST(u AS INTEGER) % 4 = 1 THEN 'walks of ' || u ELSE t END AS name FROM n)
  SELECT min(lon) AS west, min(lat) AS south, max(lon) AS east, max(lat) AS north, count(DISTINCT split_part(track_id, '-', 1)) AS files, (SELECT arg_min(name, u) FROM k) AS name FROM big"""),
)
def upload_extent(spark, d):
    """The box and the name of all uploads; some have a name of their own, some a blank one, the others that of their first track."""
    u = F.col("file").cast("int")
    p = _placed(spark, d).withColumn("title", F.when(u % 4 == 1, F.concat(F.lit("walks of "), "file")).when(u % 4 == 2, F.lit("  ")))
    many = p.groupBy("track_id").count().where("count > 1").select("track_id")
    return T.read_extent(spark, _written(T.to_gpx(p.join(many, "track_id", "left_semi")), "gpx"))


@F.pandas_udf(BinaryType())
def _zipped(name: pd.Series, text: pd.Series) -> pd.Series:
    """An archive with the text under a name, after another member."""

    def one(name: str, text: str) -> bytes:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("images/readme.txt", "no track")
            z.writestr(name, text)
        return out.getvalue()

    return pd.Series([one(n, t) for n, t in zip(name, text, strict=True)])


@register(
    "kmz_read",
    oracle("fx_points", body=_PLACED + " SELECT lon, lat, count(*) AS n FROM big WHERE CAST(split_part(track_id, '-', 1) AS INTEGER) % 5 < 3 GROUP BY lon, lat"),
)
def kmz_read(spark, d):
    """Each user's tracks in an archive; a fifth of them hold no KML, a fifth are broken off in the middle."""
    root = fresh_path(spark, "kmz")
    u = F.col("file").cast("int") % 5
    name = F.when(u == 3, "notes.txt").when(u == 1, "a/other.kml").otherwise("doc.kml")
    packed = _kml(spark, d).withColumn("content", _zipped(name, F.col("text")))
    content = F.when(u == 4, F.substring("content", 1, 60)).otherwise(F.col("content"))
    blobs.write(packed.select(F.concat("file", F.lit(".kmz")).alias("key"), content.alias("content")), root)
    out = kept(T.read_tracks(spark, root).where("ele = 7").groupBy("lon", "lat").agg(F.count("*").alias("n")))
    discard(root)
    return out


@F.pandas_udf(BinaryType())
def _png(kind: pd.Series, text: pd.Series) -> pd.Series:
    """An image file of one grey pixel that carries a text, plain, packed, or not at all."""

    def chunk(name: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))

    def one(kind: int, text: str) -> bytes:
        carried = {0: lambda: chunk(b"tEXt", b"plate\0" + text.encode("latin-1")), 1: lambda: chunk(b"zTXt", b"plate\0\0" + zlib.compress(text.encode())), 2: lambda: b"", 3: lambda: chunk(b"tEXt", b"plate\0{}")}[kind]()
        return documents.PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + carried + chunk(b"IDAT", zlib.compress(b"\0\0")) + chunk(b"IEND", b"")

    return pd.Series([one(k, t) for k, t in zip(kind, text, strict=True)])


@register("png_manifests", "SELECT o_custkey AS id, count(*) AS orders, 'EPSG:' || CAST(o_custkey % 100 AS VARCHAR) AS crs FROM orders WHERE o_custkey % 4 < 2 GROUP BY o_custkey")
def png_manifests(spark, d):
    """A picture for each customer that orders; half of them carry a manifest with a composition, some of those packed."""
    root = fresh_path(spark, "png")
    per = fx.table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    k = F.col("o_custkey")
    text = F.concat(F.lit('{"id":'), k.cast("string"), F.lit(',"spec":{"orders":'), F.col("n").cast("string"), F.lit(',"crs":"EPSG:'), (k % 100).cast("string"), F.lit('"}}'))
    # a thousand pictures a folder, so that no folder grows with the table
    folder = F.floor(k / 1000).cast("string")
    blobs.write(per.select(F.concat(folder, F.lit("/"), k.cast("string"), F.lit(".png")).alias("key"), _png((k % 4).cast("int"), text).alias("content")), root)
    m = documents.manifests(spark, root, "plate")
    get = lambda path, kind: F.try_variant_get("manifest", path, kind)
    out = kept(m.select(get("$.id", "bigint").alias("id"), get("$.spec.orders", "bigint").alias("orders"), get("$.spec.crs", "string").alias("crs")))
    blobs.remove(spark, root)
    return out
