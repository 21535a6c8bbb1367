"""Readers of region catalogues, their sidecars, networks, and manifests inside PNG files."""

from __future__ import annotations

import hashlib
import struct
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terravia.sources import blobs

REGION_SCHEMA = """id STRING, name STRING, crs STRING, bounds ARRAY<DOUBLE>, overview_size ARRAY<INT>, dem_path STRING, overview_path STRING,
  hydro_path STRING, native_resolution_m DOUBLE, elevation_min DOUBLE, elevation_max DOUBLE, light_azimuth DOUBLE, light_altitude DOUBLE, z_factor DOUBLE"""
SOURCES_SCHEMA = "id STRING, built STRING, fetch_bbox_4326 ARRAY<DOUBLE>, crs STRING, rebuild STRING, assets MAP<STRING, STRUCT<sha256: STRING, bytes: BIGINT>>, sources ARRAY<STRUCT<dataset: STRING, via: STRING, license: STRING>>"
LABELS_SCHEMA = "crs STRING, features ARRAY<STRUCT<name: STRING, kind: STRING, rank: INT, coords: ARRAY<ARRAY<DOUBLE>>>>"
PLAYA_SCHEMA = "crs STRING, playas ARRAY<STRUCT<coords: ARRAY<ARRAY<DOUBLE>>, name: STRING>>"
HYDRO_SCHEMA = "crs STRING, lakes ARRAY<STRUCT<coords: ARRAY<ARRAY<DOUBLE>>, name: STRING>>, rivers ARRAY<STRUCT<coords: ARRAY<ARRAY<DOUBLE>>, order: INT, name: STRING>>"
MANIFEST = SOURCES_SCHEMA
WAYS_SCHEMA = "ways ARRAY<STRUCT<class: STRING, coords: ARRAY<ARRAY<DOUBLE>>>>"


def _json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One document a file, with the name of its folder; a path without files gives no rows."""
    files = spark.read.format("binaryFile").load(path).select("path", F.col("content").cast("string").alias("text"))
    folder = F.element_at(F.split("path", "/"), -2)
    return files.select(folder.alias("folder"), F.from_json("text", schema, {"mode": "PERMISSIVE"}).alias("d")).select("folder", "d.*")


def regions(spark: SparkSession, root: str) -> DataFrame:
    """The catalogue: regions/<id>/region.json, unknown fields left out, missing ones null."""
    r = _json(spark, f"{root}/*/region.json", REGION_SCHEMA)
    b = lambda i: F.get("bounds", F.lit(i))
    return r.select(F.coalesce("id", "folder").alias("region_id"), "name", "crs", b(0).alias("min_x"), b(1).alias("min_y"), b(2).alias("max_x"), b(3).alias("max_y"), F.get("overview_size", F.lit(0)).alias("overview_w"), F.get("overview_size", F.lit(1)).alias("overview_h"), F.col("native_resolution_m").alias("res_m"), "elevation_min", "elevation_max", "light_azimuth", "light_altitude", "z_factor")


def listed_assets(spark: SparkSession, root: str) -> DataFrame:
    """bundle, name, sha, bytes from each region's sources.json."""
    s = _json(spark, f"{root}/*/sources.json", SOURCES_SCHEMA)
    return s.select(F.col("folder").alias("bundle"), F.explode("assets").alias("name", "a")).select("bundle", "name", F.col("a.sha256").alias("sha"), F.col("a.bytes").alias("bytes"))


def datasets(spark: SparkSession, root: str) -> DataFrame:
    """region_id, datasets in their order."""
    return _json(spark, f"{root}/*/sources.json", SOURCES_SCHEMA).select(F.col("folder").alias("region_id"), F.transform("sources", lambda s: s["dataset"]).alias("datasets"))


def found_assets(spark: SparkSession, root: str) -> DataFrame:
    """bundle, name, sha, bytes of the files that are there, empty ones too; a bundle is a folder. Files are hashed as streams."""
    files = blobs.read(spark, root, lambda opened: hashlib.file_digest(opened, "sha256").hexdigest())
    bundle = F.regexp_extract("key", "^(.+)/[^/]*$", 1)
    return files.select(bundle.alias("bundle"), F.substring_index("key", "/", -1).alias("name"), F.col("value").alias("sha"), "bytes").where("bundle <> ''")


def labels(spark: SparkSession, root: str) -> DataFrame:
    """region_id, nth, name, kind, rank, coords."""
    found = _json(spark, f"{root}/*/labels.json", LABELS_SCHEMA)
    return found.select(F.col("folder").alias("region_id"), F.posexplode("features").alias("nth", "f")).select("region_id", "nth", "f.*")


def playas(spark: SparkSession, root: str) -> DataFrame:
    found = _json(spark, f"{root}/*/playa.json", PLAYA_SCHEMA)
    return found.select(F.col("folder").alias("region_id"), F.explode("playas").alias("p")).select("region_id", "p.*")


def hydro(spark: SparkSession, root: str) -> DataFrame:
    """region_id, kind (lake, river), nth, name, order (null for lakes), coords; a region without the file has no rows."""
    found = _json(spark, f"{root}/*/hydro.json", HYDRO_SCHEMA)
    of = lambda kind, many, order: found.select(F.col("folder").alias("region_id"), F.posexplode(many).alias("nth", "f")).select("region_id", F.lit(kind).alias("kind"), "nth", F.coalesce("f.name", F.lit("")).alias("name"), order.alias("order"), "f.coords")
    return of("lake", "lakes", F.lit(None).cast("int")).unionByName(of("river", "rivers", F.col("f.order")))


def with_asset(rows: DataFrame, source: tuple[str, str, str]) -> DataFrame:
    """rows whose manifest (JSON) has an asset (name, sha, bytes) set and a source (dataset, via, license) entered, unless one of that dataset is there.

    Doing it again changes nothing but the asset's hash and size. The other fields of a manifest stay; no JSON stays as it is.
    """
    m = F.from_json("manifest", MANIFEST)
    kind = "map<string,struct<sha256:string,bytes:bigint>>"
    others = F.map_filter(F.coalesce("__m.assets", F.create_map().cast(kind)), lambda k, _: k != F.col("name"))
    assets = F.map_concat(others, F.create_map(F.col("name"), F.struct(F.col("sha").alias("sha256"), F.col("bytes").cast("long").alias("bytes"))))
    known = F.coalesce("__m.sources", F.array().cast("array<struct<dataset:string,via:string,license:string>>"))
    entry = F.struct(*(F.lit(v).alias(n) for n, v in zip(("dataset", "via", "license"), source, strict=True)))
    sources = F.when(F.exists(known, lambda s: F.contains(s["dataset"], F.lit(source[0]))), known).otherwise(F.concat(known, F.array(entry)))
    folded = F.to_json(F.col("__m").withField("assets", assets).withField("sources", sources))
    return rows.withColumn("__m", m).withColumn("manifest", F.when(F.try_parse_json("manifest").isNull(), F.col("manifest")).otherwise(folded)).drop("__m")


def farm_index(spark: SparkSession, path: str) -> DataFrame:
    """region_id, rendered: the entries of an index of what is built, an object of regions; none where the file is absent or is no object."""
    files = spark.read.format("binaryFile").load(path).select(F.col("content").cast("string").alias("text"))
    entries = F.from_json("text", "MAP<STRING, STRUCT<glb: STRING>>")
    return files.select(F.explode(entries).alias("region_id", "e")).select("region_id", (F.coalesce("e.glb", F.lit("")) != "").alias("rendered"))


def cards(pages: DataFrame, index: DataFrame, html: str = "html") -> DataFrame:
    """region_id, rendered: each plate that some page shows a card of, once, and whether it is built."""
    shown = pages.select(F.explode(F.regexp_extract_all(F.col(html), F.lit('data-plate="([^"]+)"'), F.lit(1))).alias("region_id")).distinct()
    return shown.join(index, "region_id", "left").select("region_id", F.coalesce("rendered", F.lit(False)).alias("rendered"))


def ways(spark: SparkSession, path: str) -> DataFrame:
    """way, vidx, x, y, class of a cached network."""
    found = _json(spark, path, WAYS_SCHEMA).select("folder", F.posexplode("ways").alias("i", "w"))
    points = found.select(F.concat_ws("/", "folder", F.col("i").cast("string")).alias("way"), F.col("w.class").alias("class"), F.posexplode("w.coords").alias("vidx", "p"))
    return points.select("way", "vidx", F.get("p", F.lit(0)).alias("x"), F.get("p", F.lit(1)).alias("y"), "class")


PNG = b"\x89PNG\r\n\x1a\n"
#: Inflated bytes of a text chunk that are read.
MOST_TEXT = 64 << 20


def png_text(data: bytes, keyword: str) -> str | None:
    """The text chunk of a keyword, without decoding pixels; None if there is none that can be read."""
    at = 8 if data[:8] == PNG else len(data)
    while at + 12 <= len(data):
        (size,) = struct.unpack(">I", data[at : at + 4])
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + size]
        at += 12 + size
        name, _, rest = body.partition(b"\0")
        if kind in (b"tEXt", b"zTXt") and name.decode("latin-1") == keyword:
            try:
                if kind == b"tEXt":
                    return rest.decode("latin-1")
                inflater = zlib.decompressobj()
                text = inflater.decompress(rest[1:], MOST_TEXT)
                return None if inflater.unconsumed_tail else text.decode("utf-8")
            except (zlib.error, UnicodeDecodeError):
                return None
    return None


def manifests(spark: SparkSession, path: str, keyword: str) -> DataFrame:
    """file, manifest (variant): of each PNG under path, at any depth, that carries one with a spec."""
    files = blobs.read(spark, path, lambda opened: png_text(opened.read(), keyword))
    read = files.select(F.concat(F.lit(f"{path.rstrip('/')}/"), "key").alias("file"), F.try_parse_json("value").alias("manifest"))
    return read.where(F.expr("try_variant_get(manifest, '$.spec', 'variant') IS NOT NULL"))
