"""Compositions and recordings as JSON documents, and back into rows.

A composition's document nests its crop, tracks and spots; a manifest nests the composition with what it was made from. Reading tolerates
documents of older and newer writers: fields that are missing take their usual values, unknown ones are left out, lists that are none are
empty. A document that lacks what cannot be guessed is malformed; its row stays and says so. Numbers keep every bit. JSON has no NaN: where a
vertex has no time the list has a null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terravia.operators.sheets import admit, finite

TRACK = "track_id STRING, coords ARRAY<ARRAY<DOUBLE>>, day STRING, t0 STRING, t1 STRING, lonlat ARRAY<DOUBLE>, coords_t ARRAY<DOUBLE>, summit_t STRING, summit_ele DOUBLE"
SPOT = "STRUCT<x: DOUBLE, y: DOUBLE, weight: DOUBLE, label: STRING, icon: STRING, photo: STRING>"

# The fields of a composition's document, the column that holds each, its type, and its usual value (none: it must be there).
FIELDS: tuple[tuple[str, str, str, object], ...] = (
    ("region_id", "region_id", "STRING", None),
    ("crs", "crs", "STRING", None),
    ("crop", "crop", "ARRAY<DOUBLE>", None),
    ("print_w_in", "print_w", "DOUBLE", None),
    ("print_h_in", "print_h", "DOUBLE", None),
    ("native_resolution_m", "native_m", "DOUBLE", None),
    ("tracks", "tracks", "ARRAY<ARRAY<ARRAY<DOUBLE>>>", None),
    ("hotspots", "spots", f"ARRAY<{SPOT}>", ()),
    ("seed", "seed", "BIGINT", 7),
    ("track_days", "track_days", "ARRAY<STRING>", ...),
    ("track_width_pt", "track_width_pt", "DOUBLE", 2.6),
    ("track_max_darken", "track_max_darken", "DOUBLE", 0.9),
    ("marker_diameter_in", "marker_diameter_in", "DOUBLE", 0.24),
    ("grain_cell_in", "grain_cell_in", "DOUBLE", 0.014),
    ("grain_strength", "grain_strength", "DOUBLE", 0.05),
    ("title_pt", "title_pt", "DOUBLE", 22.0),
    ("title_text", "title", "STRING", ""),
    ("label_pt", "label_pt", "DOUBLE", 13.0),
    ("photo_box_in", "photo_box_in", "DOUBLE", 1.5),
    ("contours", "contours", "BOOLEAN", False),
    ("compass", "compass", "BOOLEAN", True),
    ("biome", "biome", "BOOLEAN", False),
    ("labels", "labels", "BOOLEAN", False),
    ("track_rgb", "track_rgb", "ARRAY<INT>", (214, 158, 58)),
    ("track_halo", "track_halo", "DOUBLE", 0.7),
    ("marker_ring", "marker_ring", "DOUBLE", 0.09),
    ("photo_frame_style", "photo_frame_style", "STRING", "mat"),
    ("furniture_scale", "furniture_scale", "DOUBLE", 1.0),
    ("terrain_depth", "terrain_depth", "DOUBLE", 1.0),
    ("shadow_strength", "shadow_strength", "DOUBLE", 0.5),
    ("oblique", "oblique", "DOUBLE", 0.0),
    ("output_kind", "kind", "STRING", "print"),
    ("screen_ppi", "ppi", "DOUBLE", 0.0),
    ("keyline", "keyline", "BOOLEAN", True),
    ("top_clear_frac", "top_clear", "DOUBLE", 0.0),
    ("bottom_clear_frac", "bottom_clear", "DOUBLE", 0.0),
    ("bleed_in", "bleed", "DOUBLE", 0.0),
    ("edition", "edition", "INT", 1),
    ("credit_text", "credit", "STRING", ""),
    ("light_mode", "light_mode", "STRING", "archival"),
    ("sun_azimuth_deg", "sun_azimuth_deg", "DOUBLE", 315.0),
    ("sun_altitude_deg", "sun_altitude_deg", "DOUBLE", 45.0),
    ("golden_strength", "golden_strength", "DOUBLE", 0.7),
)
SPEC = ", ".join(f"{name}: {kind}" for name, _, kind, _ in FIELDS)
SOURCE = "STRUCT<filename: STRING, sha256: STRING, bytes: BIGINT>"
MANIFEST = f"manifest_version INT, engine STRING, region_id STRING, sources ARRAY<{SOURCE}>, edition INT, lineage ARRAY<STRING>, spec STRUCT<{SPEC}>, region_pack STRUCT<pack_version: INT, assets: MAP<STRING, STRING>>"


def _finite(values: Column) -> Column:
    return F.transform(values, lambda v: F.when(finite(v), v))


def track_json(tracks: DataFrame) -> Column:
    """The document of a recording, from the columns of TRACK; of tracks only the columns that are there. Fields that are null are left out."""
    have = {c.lower() for c in tracks.columns}
    names = [part.split()[0] for part in TRACK.split(", ")]
    summit = lambda n: F.when(F.col("summit_t").isNotNull(), F.col(n))
    value = {"coords_t": lambda: _finite(F.col("coords_t")), "summit_ele": lambda: summit("summit_ele")}
    return F.to_json(F.struct(*(value.get(n, lambda n=n: F.col(n))().alias(n) for n in names if n in have)))


def track_rows(text: Column) -> Column:
    """A struct of TRACK from a document, null where it is none or has no name or coordinates; a vertex without a time has NaN."""
    t = F.from_json(text, TRACK)
    timed = F.when(t["coords_t"].isNotNull(), F.transform(t["coords_t"], lambda v: F.coalesce(v, F.lit(float("nan")))))
    return F.when(t["track_id"].isNotNull() & t["coords"].isNotNull(), t.withField("coords_t", timed))


def spec_struct(rows: DataFrame) -> Column:
    """The document of a composition as a struct: every field, from its column, or its usual value where there is no such column."""
    have = set(rows.columns)

    def value(column: str, kind: str, usual: object) -> Column:
        if column == "crop" and "crop" not in have:
            return F.array("x0", "y0", "x1", "y1")
        return (F.col(column) if column in have else _usual(usual)).cast(kind)

    return F.struct(*(value(column, kind, usual).alias(name) for name, column, kind, usual in FIELDS))


def _usual(value: object) -> Column:
    if value is None or value is ...:
        return F.lit(None)
    if isinstance(value, tuple):
        return F.array(*map(F.lit, value))
    return F.lit(value)


def from_manifest(rows: DataFrame, text: str = "manifest") -> DataFrame:
    """rows with the columns of the composition in a manifest's text, and malformed: whether it has none that is whole."""
    m = F.from_json(F.col(text), MANIFEST)
    read = rows.withColumn("__s", m["spec"])
    s = lambda name: F.col(f"__s.{name}")
    filled = {column: F.coalesce(s(name), _usual(usual).cast(kind)) if usual not in (None, ...) else s(name) for name, column, kind, usual in FIELDS if column != "crop"}
    box = {n: F.get(s("crop"), F.lit(i)) for i, n in enumerate(("x0", "y0", "x1", "y1"))}
    must = [s(name).isNotNull() for name, _, _, usual in FIELDS if usual is None]
    good = F.col("__s").isNotNull() & (F.size(s("crop")) == 4)
    for there in must:
        good = good & there
    return read.withColumns(filled | box | {"malformed": ~F.coalesce(good, F.lit(False))}).drop("__s")


def admitted(rows: DataFrame, text: str = "manifest") -> DataFrame:
    """rows with the composition of a manifest from outside, and error: why it is refused (`malformed`, then as sheets.admit says), null if it may be painted."""
    read = from_manifest(rows, text)
    # what is malformed has nothing that rules could be asked about
    checked = admit(read)
    return checked.withColumn("error", F.when(F.col("malformed"), "malformed").otherwise(F.col("error"))).drop("malformed")
