"""Readers of recorded tracks: GPX, KML and KMZ files as DataFrames.

Files are read with Spark's binaryFile source, one row a file; the XML is parsed by
Spark's own XML functions, and only opening a KMZ archive runs Python.
"""

from __future__ import annotations

import io
import lzma
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terravia.functions.geodesy import utm
from terravia.functions.text import iso_seconds, symbol_icon
from terravia.operators import journeys
from terravia.shared import Scratch



def iso_day(t: str) -> Column:
    return F.date_format(F.timestamp_seconds(t), "yyyy-MM-dd")


_POINT = "STRUCT<_lat: STRING, _lon: STRING, ele: STRING, time: STRING>"
GPX_SCHEMA = f"""STRUCT<metadata: STRUCT<name: STRING>,
  trk: ARRAY<STRUCT<name: STRING, trkseg: ARRAY<STRUCT<trkpt: ARRAY<{_POINT}>>>>>,
  rte: ARRAY<STRUCT<name: STRING, rtept: ARRAY<{_POINT}>>>,
  wpt: ARRAY<STRUCT<_lat: STRING, _lon: STRING, name: STRING, sym: STRING>>>"""
MOST_ENTRIES, MOST_TOTAL, MOST_MEMBER = 512, 200 << 20, 64 << 20
MOST_WAYPOINTS = 200


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """file, content."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "content")


def sniff(content: Column, name: Column) -> Column:
    """kmz by its magic bytes, else by the first root marker anywhere, else by extension, else gpx."""
    text = F.lower(F.decode(content, "ISO-8859-1"))
    gpx, kml = F.locate("<gpx", text), F.locate("<kml", text)
    by_mark = F.when((gpx > 0) & ((kml == 0) | (gpx < kml)), "gpx").when(kml > 0, "kml")
    by_name = F.when(F.lower(name).endswith(".kml"), "kml").when(F.lower(name).endswith(".kmz"), "kmz").otherwise("gpx")
    return F.when(F.substring(content, 1, 4) == F.lit(bytearray(b"PK\x03\x04")), "kmz").otherwise(F.coalesce(by_mark, by_name))


def open_kmz(files: DataFrame) -> DataFrame:
    """file, content: the KML inside each archive (doc.kml, else the first by name).

    Archives over the caps, damaged or encrypted ones, and ones packed in an unknown way give no row.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for name, content in zip(batch["file"], batch["content"], strict=True):
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        infos = z.infolist()
                        kml = sorted((i for i in infos if i.filename.lower().endswith(".kml")), key=lambda i: (i.filename.rsplit("/", 1)[-1].lower() != "doc.kml", infos.index(i)))
                        good = len(infos) <= MOST_ENTRIES and sum(i.file_size for i in infos) <= MOST_TOTAL and kml and kml[0].file_size <= MOST_MEMBER
                        if good:
                            out.append((name, z.read(kml[0])))
                except (zipfile.BadZipFile, zipfile.LargeZipFile, zlib.error, lzma.LZMAError, EOFError, OSError, NotImplementedError, RuntimeError, ValueError):
                    continue
            yield pd.DataFrame(out, columns=["file", "content"])

    return files.mapInPandas(run, "file string, content binary")


def gpx_points(texts: DataFrame) -> DataFrame:
    """file, track, seg, pidx, lon, lat, time, ele of every track segment and route. texts: file, text."""
    parsed = texts.select("file", F.from_xml("text", GPX_SCHEMA).alias("g"))
    tracks = parsed.select("file", F.posexplode("g.trk").alias("i", "trk")).select("file", "i", F.col("trk.name").alias("name"), F.posexplode("trk.trkseg").alias("j", "s"))
    tracks = tracks.select("file", F.lit(0).alias("part"), "i", "j", F.coalesce("name", F.lit("track")).alias("name"), F.col("s.trkpt").alias("pts"))
    routes = parsed.select("file", F.posexplode("g.rte").alias("i", "rte")).select("file", F.lit(1).alias("part"), "i", F.lit(0).alias("j"), F.coalesce("rte.name", F.lit("route")).alias("name"), F.col("rte.rtept").alias("pts"))
    each = tracks.unionByName(routes).select("file", F.struct("part", "i", "j").alias("seg"), "name", F.posexplode("pts").alias("pidx", "p"))
    number = lambda c: F.col(f"p.{c}").try_cast("double").alias(c.lstrip("_"))
    return each.select("file", "name", "seg", "pidx", number("_lon"), number("_lat"), F.col("p.time").alias("time"), number("ele"))


def with_track_ids(points: DataFrame) -> DataFrame:
    """Points of segments that keep two located points at least, with track_id name-index in file order."""
    good = points.where("lon IS NOT NULL AND lat IS NOT NULL")
    # dealt by file once; the rank counts a file's segments, not their points
    many = good.repartition("file").withColumn("n", F.count("*").over(Window.partitionBy("file", "seg"))).where("n >= 2")
    k = F.dense_rank().over(Window.partitionBy("file").orderBy("seg")) - 1
    return many.withColumn("track_id", F.concat_ws("-", "name", k.cast("string"))).drop("seg", "name", "n")


def gpx_waypoints(texts: DataFrame) -> DataFrame:
    """file, lon, lat, label, icon, weight; the first MOST_WAYPOINTS of a file."""
    parsed = texts.select("file", F.posexplode(F.from_xml("text", GPX_SCHEMA)["wpt"]).alias("i", "w"))
    located = parsed.select("file", "i", F.col("w._lon").try_cast("double").alias("lon"), F.col("w._lat").try_cast("double").alias("lat"), F.substring(F.trim(F.coalesce("w.name", F.lit(""))), 1, 60).alias("label"), symbol_icon(F.col("w.sym")).alias("icon"), F.lit(3).alias("weight"))
    first = Window.partitionBy("file").orderBy("i")
    return located.where("lon IS NOT NULL AND lat IS NOT NULL").withColumn("k", F.row_number().over(first)).where(F.col("k") <= MOST_WAYPOINTS).drop("k", "i")


_BARE = r"<(/?)[A-Za-z0-9_]+:([A-Za-z0-9_]+)"
#: Comments go, and so does the rest of the document around the elements that carry geometry.
_COMMENT = r"(?s)<!--.*?-->"
_ELEMENT = r"(?s)<(Placemark|Track)[\s>].*?</\1\s*>"
_LINE = "STRUCT<coordinates: STRING>"
_TRACK = "STRUCT<when: ARRAY<STRING>, coord: ARRAY<STRING>>"
_MANY = f"STRUCT<LineString: ARRAY<{_LINE}>, Track: ARRAY<{_TRACK}>, Point: ARRAY<{_LINE}>>"
PLACEMARK = f"STRUCT<name: STRING, LineString: ARRAY<{_LINE}>, Track: ARRAY<{_TRACK}>, Point: ARRAY<{_LINE}>, MultiGeometry: {_MANY}, MultiTrack: {_MANY}>"


def _placemarks(texts: DataFrame) -> DataFrame:
    """file, i, p: each Placemark, parsed as XML. A text with a DOCTYPE gives none. Prefixes are dropped first, so any namespace will do."""
    safe = texts.where(~F.contains(F.lower("text"), F.lit("<!doctype")))
    plain = safe.select("file", F.regexp_replace(F.regexp_replace("text", _COMMENT, ""), _BARE, "<$1$2").alias("t"))
    each = plain.select("file", F.posexplode(F.regexp_extract_all("t", F.lit(_ELEMENT), F.lit(0))).alias("i", "xml"))
    # a bare track stands for a placemark of its own
    whole = F.when(F.col("xml").startswith("<Track"), F.concat(F.lit("<Placemark>"), "xml", F.lit("</Placemark>"))).otherwise(F.col("xml"))
    return each.select("file", "i", F.from_xml(whole, PLACEMARK).alias("p")).where("p IS NOT NULL")


def _of(kind: str, element: str) -> Column:
    none = F.array().cast(f"array<{element}>")
    return F.flatten(F.array(F.coalesce(f"p.{kind}", none), F.coalesce(f"p.MultiGeometry.{kind}", none), F.coalesce(f"p.MultiTrack.{kind}", none)))


def _tuples(text: Column) -> Column:
    """Coordinates as arrays of texts; blanks around commas do not cut a tuple."""
    joined = F.regexp_replace(F.trim(F.regexp_replace(text, r"\s*,\s*", ",")), r"\s+", " ")
    return F.transform(F.split(joined, " "), lambda c: F.split(c, ","))


def _number(parts: str, i: int) -> Column:
    return F.get(parts, F.lit(i)).try_cast("double")


def kml_points(texts: DataFrame) -> DataFrame:
    """file, name, seg, pidx, lon, lat, time, ele from the LineStrings and Tracks of Placemarks. Only tuples of a Track that have their time's place are taken."""
    marks = _placemarks(texts)
    lines = marks.select("file", F.struct("i", F.lit(0).alias("k")).alias("at"), F.posexplode(_of("LineString", _LINE)).alias("j", "g"))
    lines = lines.select("file", "at", "j", F.posexplode(_tuples(F.coalesce("g.coordinates", F.lit("")))).alias("pidx", "c")).withColumn("time", F.lit(None).cast("string"))
    tracks = marks.select("file", F.struct("i", F.lit(1).alias("k")).alias("at"), F.posexplode(_of("Track", _TRACK)).alias("j", "g"))
    pairs = F.zip_with(F.coalesce("g.coord", F.array().cast("array<string>")), F.coalesce("g.when", F.array().cast("array<string>")), lambda c, w: F.struct(c.alias("c"), w.alias("w")))
    tracks = tracks.select("file", "at", "j", F.posexplode(F.filter(pairs, lambda p: p["c"].isNotNull())).alias("pidx", "p"))
    tracks = tracks.select("file", "at", "j", "pidx", F.split(F.trim("p.c"), r"\s+").alias("c"), F.trim("p.w").alias("time"))
    both = lines.unionByName(tracks)
    return both.select("file", F.lit("track").alias("name"), F.struct("at.i", "at.k", "j").alias("seg"), "pidx", _number("c", 0).alias("lon"), _number("c", 1).alias("lat"), "time", _number("c", 2).alias("ele"))


def kml_waypoints(texts: DataFrame) -> DataFrame:
    """file, lon, lat, label, icon, weight of the Points of Placemarks; the first MOST_WAYPOINTS of a file."""
    marks = _placemarks(texts).select("file", "i", F.col("p.name").alias("name"), F.posexplode(_of("Point", _LINE)).alias("j", "g"))
    parts = marks.select("file", "i", "j", "name", F.get(_tuples(F.coalesce("g.coordinates", F.lit(""))), F.lit(0)).alias("c"))
    located = parts.select("file", "i", "j", _number("c", 0).alias("lon"), _number("c", 1).alias("lat"), F.substring(F.trim(F.coalesce("name", F.lit(""))), 1, 60).alias("label"), F.lit("flag").alias("icon"), F.lit(3).alias("weight"))
    first = Window.partitionBy("file").orderBy("i", "j")
    return located.where("lon IS NOT NULL AND lat IS NOT NULL").withColumn("k", F.row_number().over(first)).where(F.col("k") <= MOST_WAYPOINTS).drop("k", "i", "j")


def _sniffed(spark: SparkSession, path: str) -> DataFrame:
    """file, content, kind of the files under a path. Each is opened once; what follows reads a few large ones that hold them all."""
    return Scratch(spark, "files").put("files", read_files(spark, path).withColumn("kind", sniff(F.col("content"), F.col("file"))))


def _texts(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The GPX and the KML documents of files, archives opened: file, text."""
    kml = files.where("kind = 'kml'").select("file", "content").unionByName(open_kmz(files.where("kind = 'kmz'").select("file", "content")))
    as_text = lambda df: df.select("file", F.try_validate_utf8(F.col("content").cast("string")).alias("text"))
    return as_text(files.where("kind = 'gpx'")), as_text(kml)


def read_tracks(spark: SparkSession, path: str) -> DataFrame:
    """file, track_id, pidx, lon, lat, time, ele of all the files under a path, whatever their format."""
    return _tracks(_sniffed(spark, path))


def _tracks(files: DataFrame) -> DataFrame:
    gpx, kml = _texts(files)
    return with_track_ids(gpx_points(gpx)).unionByName(with_track_ids(kml_points(kml)))


def read_waypoints(spark: SparkSession, path: str, zone: int) -> DataFrame:
    """file, x, y, label, icon, weight of all the files under a path, in metres; places that cannot be projected are left out."""
    gpx, kml = _texts(_sniffed(spark, path))
    both = gpx_waypoints(gpx).unionByName(kml_waypoints(kml))
    x, y = utm(F.col("lon"), F.col("lat"), zone)
    return both.withColumns({"x": x, "y": y}).where("x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x) AND NOT isnan(y)").select("file", "x", "y", "label", "icon", "weight")


def ingest(spark: SparkSession, path: str, zone: int, tolerance_m: float = 15.0) -> tuple[DataFrame, DataFrame]:
    """Files to tracks, and what was dropped on the way.

    Tracks: file, track_id, vidx, day, t, x, y, ele, in metres, simplified; day is that of a
    track's first time. Counts, one row a file: read, kept and dropped points (those that
    cannot be placed), tracks and tracks that under two points are left of.
    """
    found = read_tracks(spark, path)
    x, y = utm(F.col("lon"), F.col("lat"), zone)
    placed = found.withColumns({"x": x, "y": y, "t": iso_seconds(F.col("time")), "key": F.concat_ws("\0", "file", "track_id")})
    points = placed.select("file", F.col("track_id").alias("name"), F.col("key").alias("track_id"), F.col("pidx").cast("long").alias("vidx"), "x", "y", "t", "ele")
    points = Scratch(spark, "ingest").put("points", points)  # parsed once
    good = journeys.clean(points)
    days = good.where("t IS NOT NULL").groupBy("track_id").agg(F.min_by(iso_day("t"), "vidx").alias("day"))
    simple = journeys.simplify(good.drop("dropped"), tolerance_m).join(days, "track_id", "left")
    order = Window.partitionBy("file", "name").orderBy("vidx")
    tracks = simple.withColumn("n", (F.row_number().over(order) - 1).cast("long")).select("file", F.col("name").alias("track_id"), F.col("n").alias("vidx"), "day", "t", "x", "y", "ele")
    read = points.groupBy("file").agg(F.count("*").alias("points"), F.count_distinct("name").alias("tracks"))
    kept = good.groupBy("file").agg(F.count("*").alias("kept"), F.count_distinct("name").alias("kept_tracks"))
    counts = read.join(kept, "file", "left").select("file", "points", F.coalesce("kept", F.lit(0)).alias("kept"), (F.col("points") - F.coalesce("kept", F.lit(0))).alias("dropped"), "tracks", (F.col("tracks") - F.coalesce("kept_tracks", F.lit(0))).alias("dropped_tracks"))
    return tracks, counts


def extent(points: DataFrame) -> DataFrame:
    """One row: the box of all points and the number of files."""
    return points.agg(F.min("lon").alias("west"), F.min("lat").alias("south"), F.max("lon").alias("east"), F.max("lat").alias("north"), F.count_distinct("file").alias("files"))


def upload_name(texts: DataFrame) -> DataFrame:
    """One row, name: that of the first GPX file (by name) that has one: the file's own, else its first track's, else its first route's; null if none has. texts: file, text."""
    parsed = texts.select("file", F.from_xml("text", GPX_SCHEMA).alias("g"))
    first = lambda names: F.get(F.filter(F.transform(names, lambda n: F.trim(F.coalesce(n, F.lit("")))), lambda n: n != ""), F.lit(0))
    own = F.trim(F.col("g.metadata.name"))
    named = parsed.select("file", F.coalesce(F.when(own != "", own), first(F.col("g.trk.name")), first(F.col("g.rte.name"))).alias("name"))
    return named.agg(F.min_by("name", F.when(F.col("name").isNotNull(), F.col("file"))).alias("name"))


def read_extent(spark: SparkSession, path: str) -> DataFrame:
    """One row of what a set of files covers, and its name: west, south, east, north, files, name. A file that is broken counts for nothing and stops nothing."""
    files = _sniffed(spark, path)
    gpx = files.where("kind = 'gpx'").select("file", F.decode("content", "UTF-8").alias("text"))
    return extent(_tracks(files)).join(F.broadcast(upload_name(gpx)))  # one row by one row


def to_gpx(points: DataFrame) -> DataFrame:
    """file, text: GPX of the tracks of each file (track_id, vidx, lon, lat, time where there is one, and title, the file's own name, where that is). A file is a row, so it should hold what an upload holds."""
    timed = [F.coalesce(F.concat(F.lit("<time>"), "time", F.lit("</time>")), F.lit(""))] if "time" in points.columns else []
    point = F.concat(F.lit('<trkpt lat="'), F.col("lat").cast("string"), F.lit('" lon="'), F.col("lon").cast("string"), F.lit('">'), *timed, F.lit("</trkpt>"))
    kept = [F.max("title").alias("title")] if "title" in points.columns else []
    tracks = points.withColumn("p", F.struct("vidx", point.alias("x"))).groupBy("file", "track_id").agg(*kept, F.array_join(F.transform(F.sort_array(F.collect_list("p")), lambda p: p["x"]), "").alias("pts"))
    escaped = F.replace(F.replace(F.col("track_id"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    whole = tracks.withColumn("x", F.concat(F.lit("<trk><name>"), escaped, F.lit("</name><trkseg>"), "pts", F.lit("</trkseg></trk>")))
    title = F.coalesce(F.concat(F.lit("<metadata><name>"), F.max("title"), F.lit("</name></metadata>")), F.lit("")) if "title" in points.columns else F.lit("")
    return whole.groupBy("file").agg(F.concat(F.lit('<gpx version="1.1" creator="terravia">'), title, F.array_join(F.array_sort(F.collect_list("x")), ""), F.lit("</gpx>")).alias("text"))
