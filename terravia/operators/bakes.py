"""Operators that make a region's sidecars from what services return: waters, dry lakes, ways and landforms.

Geometry comes as rows (feature, part, vidx, lon, lat): one row a vertex, multi-part
features as several parts. Results are vertices in metres, parts of two vertices at least.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terravia.functions.geodesy import lonlat, utm
from terravia.functions.text import way_class
from terravia.operators.journeys import simplify

# Feature codes and names, and how landform classes become kinds with a rank.
WATER, DRY = ((390, 436), ("lakepond", "reservoir")), ((361,), ("playa",))
LANDFORMS = {"Range": ("range", 100), "Summit": ("summit", 70), "Gap": ("gap", 55), "Basin": ("basin", 45), "Flat": ("flat", 42), "Valley": ("valley", 40)}


def is_type(code: Column, kind: tuple[tuple[int, ...], tuple[str, ...]], missing: bool) -> Column:
    """Whether a type given as a number or as a name is of a kind; `missing` is the answer where there is none."""
    number = code.cast("string").try_cast("int")
    return F.when(code.isNull(), F.lit(missing)).when(number.isNotNull(), number.isin(*kind[0])).otherwise(F.lower(F.trim(code.cast("string"))).isin(*kind[1]))


def is_water(code: Column) -> Column:
    return is_type(code, WATER, True)


def is_dry_lake(code: Column) -> Column:
    return is_type(code, DRY, False)


def projected(vertices: DataFrame, zone: int, keys: Sequence[str], digits: int | None = None) -> DataFrame:
    """vertices with x and y in place of lon and lat: located ones only, repeats of the vertex before left out, parts of under two gone."""
    x, y = utm(F.col("lon"), F.col("lat"), zone)
    placed = vertices.withColumns({"x": x if digits is None else F.bround(x, digits), "y": y if digits is None else F.bround(y, digits)}).drop("lon", "lat")
    # over the window, where the places are columns: a filter below it would work them out again for each of its terms
    good = F.col("x").isNotNull() & F.col("y").isNotNull() & ~F.isnan("x") & ~F.isnan("y")
    order = Window.partitionBy(*keys).orderBy("vidx")
    before = F.last(F.when(good, F.struct("x", "y")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    moved = placed.withColumn("__before", before)
    once = moved.where(good & (F.col("__before").isNull() | (F.col("x") != F.col("__before.x")) | (F.col("y") != F.col("__before.y")))).drop("__before")
    counted = once.withColumn("__n", F.count("*").over(Window.partitionBy(*keys))).where("__n >= 2").drop("__n")
    return counted.withColumn("vidx", (F.row_number().over(order) - 1).cast("long"))


def ways(elements: DataFrame, zone: int) -> DataFrame:
    """way, class, vidx, x, y of the ways that tiles returned: one copy of each id, to a tenth of a metre. elements: tile, way, highway, vidx, lon, lat.

    A way that straddles a seam comes whole from each of its tiles; the first tile's is taken.
    """
    first = elements.groupBy("way").agg(F.min("tile").alias("tile"))
    once = elements.join(first, ["way", "tile"], "left_semi").where("lon IS NOT NULL AND lat IS NOT NULL")
    return projected(once.select("way", way_class(F.col("highway")).alias("class"), "vidx", "lon", "lat"), zone, ["way"], 1)


def bake(features: DataFrame, zone: int, keep: Column, tolerance_m: float = 30.0) -> DataFrame:
    """feature, part, name, vidx, x, y (and stream_order, where features have one) of the features that stay, simplified. features: feature, part, name, vidx, lon, lat and what `keep` needs."""
    order = [F.coalesce("stream_order", F.lit(0)).alias("stream_order")] if "stream_order" in features.columns else []
    named = features.where(keep).select("feature", "part", F.coalesce("name", F.lit("")).alias("name"), *order, "vidx", "lon", "lat")
    flat = projected(named, zone, ["feature", "part"])
    keyed = flat.withColumn("track_id", F.concat_ws("-", F.col("feature").cast("string"), F.col("part").cast("string")))
    return simplify(keyed, tolerance_m).drop("track_id")


def waters(features: DataFrame, zone: int, tolerance_m: float = 30.0) -> DataFrame:
    return bake(features, zone, is_water(F.col("ftype")), tolerance_m)


def dry_lakes(features: DataFrame, zone: int, tolerance_m: float = 30.0) -> DataFrame:
    return bake(features, zone, is_dry_lake(F.col("ftype")), tolerance_m)


def rivers(features: DataFrame, zone: int, least_order: int = 3, tolerance_m: float = 30.0) -> DataFrame:
    """Of flow lines those of the order or above; a line without one has order 0."""
    return bake(features, zone, F.coalesce(F.col("stream_order"), F.lit(0)) >= least_order, tolerance_m)


def landforms(features: DataFrame) -> DataFrame:
    """name, kind, rank, points of the features of the classes that maps name. features: name, class, points."""
    table = F.create_map(*(x for k, (kind, rank) in LANDFORMS.items() for x in (F.lit(k), F.struct(F.lit(kind).alias("kind"), F.lit(rank).alias("rank")))))
    named = features.withColumns({"name": F.trim(F.coalesce("name", F.lit(""))), "as": table[F.col("class")]})
    return named.where((F.col("name") != "") & F.col("as").isNotNull() & (F.size("points") > 0)).select("name", "as.kind", "as.rank", "points")


def tiles(boxes: DataFrame, key: str, most_deg2: float = 1.0) -> DataFrame:
    """key, nth, s, w, n, e: each box (w, s, e, n) in equal tiles of at most that size, row by row from the south-west; an empty box is one tile."""
    side = most_deg2**0.5
    wide, high = F.abs(F.col("e") - F.col("w")), F.abs(F.col("n") - F.col("s"))
    flat = (wide <= 0) | (high <= 0)
    count = lambda span: F.when(flat, 1).otherwise(F.greatest(F.lit(1), F.ceil(span / side))).cast("int")
    sized = boxes.withColumns({"nx": count(wide), "ny": count(high)})
    each = sized.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("ny") - 1))).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("nx") - 1)))
    dx, dy = (F.col("e") - F.col("w")) / F.col("nx"), (F.col("n") - F.col("s")) / F.col("ny")
    last = lambda at, n, edge, other: F.when(F.col(at) == F.col(n) - 1, F.col(edge)).otherwise(other)
    return each.select(
        key,
        (F.col("j") * F.col("nx") + F.col("i")).alias("nth"),
        (F.col("s") + F.col("j") * dy).alias("s"),
        (F.col("w") + F.col("i") * dx).alias("w"),
        last("j", "ny", "n", F.col("s") + (F.col("j") + 1) * dy).alias("n"),
        last("i", "nx", "e", F.col("w") + (F.col("i") + 1) * dx).alias("e"),
    )


def lonlat_box(regions: DataFrame, zone: int) -> DataFrame:
    """regions with west, south, east, north: the box of the four corners taken back to degrees."""
    corners = [lonlat(F.col(x), F.col(y), zone) for x in ("min_x", "max_x") for y in ("min_y", "max_y")]
    lons, lats = [a for a, _ in corners], [b for _, b in corners]
    return regions.withColumns({"west": F.least(*lons), "south": F.least(*lats), "east": F.greatest(*lons), "north": F.greatest(*lats)})


def readiness(catalogue: DataFrame, found: DataFrame) -> DataFrame:
    """region_id, dem_present, drift_m, bounds_match, crs_match, ready. catalogue and found: region_id, crs, min_x .. max_y; found also res_m.

    The heights' own bounds may stray by one and a half of their cells.
    """
    have = found.select("region_id", F.col("crs").alias("dem_crs"), *(F.col(c).alias(f"dem_{c}") for c in ("min_x", "min_y", "max_x", "max_y", "res_m")))
    both = catalogue.join(have, "region_id", "left")
    drift = F.greatest(*(F.abs(F.col(f"dem_{c}") - F.col(c)) for c in ("min_x", "min_y", "max_x", "max_y")))
    match, crs = drift <= 1.5 * F.col("dem_res_m"), F.col("dem_crs") == F.col("crs")
    present = F.col("dem_min_x").isNotNull()
    return both.select(
        "region_id", present.alias("dem_present"), F.round(drift, 2).alias("drift_m"), F.coalesce(match, F.lit(False)).alias("bounds_match"), F.coalesce(crs, F.lit(False)).alias("crs_match"), F.coalesce(match & crs, F.lit(False)).alias("ready")
    )


def terrain_record(synthetic: Column, known: Column) -> Column:
    """none, unverified or known: what is on record about where heights come from."""
    return F.when(known.isNull(), "none").when(~known | synthetic.isNull(), "unverified").otherwise("known")


def may_publish(entries: DataFrame, records: DataFrame, allow_synthetic: bool = False, allow_unverified: bool = False) -> DataFrame:
    """entries with refused: why one may not be shown (synthetic, unverified), null if it may. records: region_id, synthetic; without a record it is refused."""
    joined = entries.join(records.select("region_id", "synthetic"), "region_id", "left")
    why = F.when(F.col("synthetic").isNull(), None if allow_unverified else "unverified").when(F.col("synthetic"), None if allow_synthetic else "synthetic")
    return joined.withColumn("refused", why.cast("string")).drop("synthetic")
