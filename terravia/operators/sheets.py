"""Sheets: what follows from the columns of a composition, and whether it may be painted.

A composition is a row with x0, y0, x1, y1 (the crop in metres), print_w, print_h and bleed
(inches), kind (print or wallpaper), ppi, native_m (metres a cell of the data). All is
column expressions: rounding is half to even, and what cannot be decided is refused.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType

from terravia.functions.geodesy import refit_crop
from terravia.operators.assets import Rule, first_error

# Resolutions, ceilings and bounds that decide which sheets are accepted.
FINAL_DPI, PROOF_DPI, REFINE_DPI = 300.0, 96.0, 200.0
REFINE_PIXELS, MOST_PIXELS, MOST_FILM_PIXELS = 40_000_000, 120_000_000, 600_000_000
KINDS = ("print", "wallpaper")
PPI = (72.0, 600.0)
MOST_CLEAR, MOST_BLEED, MOST_EDITION, MOST_CREDIT = 0.35, 0.5, 999, 200
STYLE_BOUNDS = {
    "track_width_pt": (0.8, 6.0), "track_halo": (0.0, 0.9), "marker_diameter_in": (0.1, 0.5), "marker_ring": (0.0, 0.25), "furniture_scale": (0.6, 1.6),
    "terrain_depth": (0.0, 1.5), "shadow_strength": (0.0, 1.0), "oblique": (0.0, 1.0), "sun_azimuth_deg": (0.0, 360.0), "sun_altitude_deg": (8.0, 80.0),
    "golden_strength": (0.0, 1.0), "profile_height_in": (0.0, 2.5), "soft_light": (0.0, 1.0), "haze_strength": (0.0, 1.0), "water_depth": (0.0, 1.0),
}
CHOICES = {"photo_frame_style": ("mat", "keyline", "borderless", "polaroid"), "light_mode": ("archival", "journey"), "track_color_by": ("none", "elevation", "grade"), "label_place": ("anchor", "smart")}
NICE_MILES = (0.5, 1.0, 2.0, 3.0, 4.0, 5.0, 8.0, 10.0, 15.0, 20.0, 25.0, 30.0, 40.0, 50.0, 75.0, 100.0, 150.0, 200.0)
SCALE_BAR_IN, MILE_M = 1.9, 1609.344
PACING = {"max_frames": (2, 120, 40), "step_ms": (40, 10000, 220), "hold_ms": (40, 10000, 2500), "leader_ms": (40, 10000, 700)}
PHOTO = "data:image/jpeg;base64,"
MOST_PHOTO_BYTES, MOST_TRACKS, MOST_POINTS, MOST_SPOTS, MOST_LINEAGE = 512 * 1024, 4096, 5_000_000, 64, 100
DEEP_FROM, DEEP_TO, SHADOW_SAMPLES_IN = 150_000.0, 430_000.0, 96.0


def c(name: str) -> Column:
    return F.col(name)


def final_dpi() -> Column:
    return F.when(c("kind") == "wallpaper", c("ppi")).otherwise(FINAL_DPI)


def proof_dpi() -> Column:
    return final_dpi() * PROOF_DPI / FINAL_DPI


def refine_dpi() -> Column:
    """The finest preview: under the pixel budget, the cap of a print, and never beyond the final."""
    area = (c("print_w") + 2 * c("bleed")) * (c("print_h") + 2 * c("bleed"))
    cap = F.when(c("kind") == "print", REFINE_DPI).otherwise(final_dpi())
    return F.least(cap, F.sqrt(REFINE_PIXELS / area), final_dpi())


def pixel_size(dpi: Column) -> tuple[Column, Column]:
    """Of the whole canvas, its bleed on both sides included."""
    return F.bround((c("print_w") + 2 * c("bleed")) * dpi).cast("long"), F.bround((c("print_h") + 2 * c("bleed")) * dpi).cast("long")


def ground_per_pixel(dpi: Column) -> Column:
    return (c("x1") - c("x0")) / F.greatest(F.lit(1.0), F.bround(c("print_w") * dpi))


def sheet_geometry(specs: DataFrame, dpi: float) -> DataFrame:
    """specs with paint (the crop and print size that the painters see, grown by the bleed) and trim (its box in pixels)."""
    w, h = pixel_size(F.lit(dpi))
    ground = c("bleed") * (c("x1") - c("x0")) / c("print_w")
    cut = F.bround(c("bleed") * dpi).cast("long")
    paint = F.struct(
        (c("x0") - ground).alias("x0"), (c("y0") - ground).alias("y0"), (c("x1") + ground).alias("x1"), (c("y1") + ground).alias("y1"),
        (c("print_w") + 2 * c("bleed")).alias("print_w"), (c("print_h") + 2 * c("bleed")).alias("print_h"),
    )
    return specs.withColumns({"paint": paint, "trim": F.struct(cut.alias("x0"), cut.alias("y0"), (w - cut).alias("x1"), (h - cut).alias("y1"))})


def scale_bar(dpi: Column, scale: float = 1.0) -> Column:
    """struct<miles, px>: of the usual lengths the one nearest to the wanted length, the shorter on ties."""
    ground = (c("x1") - c("x0")) / (c("print_w") * dpi)
    each = F.transform(F.array(*map(F.lit, NICE_MILES)), lambda mi: F.struct(F.abs(mi * MILE_M / ground - SCALE_BAR_IN * scale * dpi).alias("off"), mi.alias("miles")))
    best = F.array_min(each)["miles"]
    return F.struct(best.alias("miles"), (best * MILE_M / ground).alias("px"))


def smoothstep(low: float, high: float, x: Column) -> Column:
    t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (x - low) / (high - low)))
    return t * t * (3.0 - 2.0 * t)


def terrain_depth(wanted: Column) -> Column:
    """How deep the relief is shown at the sheet's scale."""
    return smoothstep(DEEP_FROM, DEEP_TO, (c("x1") - c("x0")) / (c("print_w") * 0.0254)) * wanted


def shadow_res_m() -> Column:
    return (c("x1") - c("x0")) / (c("print_w") * SHADOW_SAMPLES_IN)


def zoom_floor_ok(dpi: Column) -> Column:
    """Whether a crop of the native resolution at all pixels fits between its bounds."""
    return F.least((c("x1") - c("x0")) / F.greatest(F.lit(1.0), F.bround(c("print_w") * dpi)), (c("y1") - c("y0")) / F.greatest(F.lit(1.0), F.bround(c("print_h") * dpi))) >= c("native_m")


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def within(x: Column, low: float, high: float) -> Column:
    return finite(x) & x.between(low, high)


def rules(columns: Sequence[str]) -> list[Rule]:
    """The chain of rules for a composition, of those that its columns allow, in the order in which they are told."""
    dpi = final_dpi()
    w, h = pixel_size(dpi)
    crop_w, crop_h = c("x1") - c("x0"), c("y1") - c("y0")
    chain: list[tuple[str, str, Column]] = [
        ("print_size_not_finite", "print_w", finite(c("print_w")) & finite(c("print_h"))),
        ("crop_not_finite", "x0", finite(c("x0")) & finite(c("y0")) & finite(c("x1")) & finite(c("y1"))),
        ("output_kind", "kind", c("kind").isin(*KINDS)),
        ("screen_ppi", "ppi", (c("kind") != "wallpaper") | within(c("ppi"), *PPI)),
        *((n, n, within(c(n), 0.0, MOST_CLEAR)) for n in ("top_clear", "bottom_clear")),
        ("bleed", "bleed", within(c("bleed"), 0.0, MOST_BLEED)),
        ("bleed_kind", "bleed", (c("bleed") == 0) | (c("kind") == "print")),
        ("print_size", "print_w", (w >= 1) & (h >= 1)),
        ("too_large", "print_w", w * h <= MOST_PIXELS),
        *((n, n, within(c(n), *b)) for n, b in STYLE_BOUNDS.items()),
        *((n, n, c(n).isin(*v)) for n, v in CHOICES.items()),
        ("edition", "edition", c("edition").between(1, MOST_EDITION)),
        ("credit_length", "credit", F.length(c("credit")) <= MOST_CREDIT),
        ("credit_charset", "credit", c("credit").rlike("^[ -~]*$")),
        ("track_rgb", "track_rgb", (F.size("track_rgb") == 3) & F.forall("track_rgb", lambda v: v.between(0, 255))),
        ("crop_empty", "x0", (crop_w > 0) & (crop_h > 0)),
        ("aspect", "x0", F.abs(crop_w / crop_h - c("print_w") / c("print_h")) / (c("print_w") / c("print_h")) <= 0.02),
        ("zoom", "native_m", zoom_floor_ok(dpi)),
    ]
    return [(code, good) for code, column, good in chain if column in columns]


def validate(specs: DataFrame) -> DataFrame:
    """specs with error: the code of the first broken rule, null for a sheet that may be painted."""
    return specs.withColumn("error", first_error(rules(specs.columns)))


def geometry_error(tracks: Column, spots: Column) -> Column:
    """Refuses more tracks, vertices or spots than a sheet may have, and vertices that are no pairs; before anything is painted."""
    return first_error(
        [
            ("tracks", F.size(tracks) <= MOST_TRACKS),
            ("shape", F.forall(tracks, lambda t: F.forall(t, lambda p: F.size(p) == 2))),
            ("points", F.aggregate(tracks, F.lit(0).cast("long"), lambda a, t: a + F.size(t)) <= MOST_POINTS),
            ("spots", F.coalesce(F.size(spots), F.lit(0)) <= MOST_SPOTS),
        ]
    )


def embedded_photo(photo: Column, most_bytes: int = MOST_PHOTO_BYTES) -> Column:
    """The photo if it is an embedded JPEG within the size, else null: no path comes through."""
    size = F.octet_length(F.try_to_binary(F.substring(photo, len(PHOTO) + 1, 1 << 30), F.lit("base64")))
    return F.when(F.startswith(photo, F.lit(PHOTO)) & size.between(1, most_bytes), photo)


def admit(specs: DataFrame, tracks: str = "tracks", spots: str = "spots") -> DataFrame:
    """The one door for compositions from outside: photos dropped, geometry bounded, rules applied; error says why a row is refused."""
    safe = specs.withColumn(spots, F.transform(F.coalesce(spots, F.array().cast(specs.schema[spots].dataType)), lambda s: s.withField("photo", embedded_photo(s["photo"]))))
    return safe.withColumn("error", F.coalesce(geometry_error(c(tracks), c(spots)), first_error(rules(specs.columns))))


def pacing(values: dict[str, Column]) -> Column:
    """struct of the film's pacing: what is no whole number becomes the default, the rest is moved inside its bounds."""
    return F.struct(*(F.least(F.greatest(F.coalesce(values[n].try_cast("int"), F.lit(usual)), F.lit(low)), F.lit(high)).alias(n) for n, (low, high, usual) in PACING.items()))


def pacing_error(values: dict[str, Column]) -> Column:
    return first_error([(n, values[n].try_cast("int").between(low, high)) for n, (low, high, _) in PACING.items()])


def film_dpi(stored: Column) -> Column:
    """The stored resolution if it is usable, else the sheet's own."""
    n = stored.try_cast("double")
    return F.when(finite(n) & (n > 0) & (n <= PPI[1]), n).otherwise(final_dpi())


def film_too_large(frames: Column, dpi: Column) -> Column:
    w, h = pixel_size(dpi)
    return frames * w * h > MOST_FILM_PIXELS


def for_presets(specs: DataFrame, presets: DataFrame, bounds: tuple[Column, Column, Column, Column]) -> DataFrame:
    """Every composition re-fitted to every device: its aspect, its pixels at its density, and no bleed. presets: id, px_w, px_h, dev_ppi (a short catalogue)."""
    # two short catalogues meet all rows: presets are at most MOST_PRESETS
    few = presets.limit(MOST_PRESETS + 1)
    if few.count() > MOST_PRESETS:
        raise ValueError(f"more than {MOST_PRESETS} presets")
    each = specs.join(F.broadcast(few))
    aspect = c("px_w") / c("px_h")
    x0, y0, x1, y1 = refit_crop((c("x0"), c("y0"), c("x1"), c("y1")), aspect, bounds, c("native_m") * c("px_w"))
    moved = each.withColumns({"nx0": x0, "ny0": y0, "nx1": x1, "ny1": y1})
    new = {"x0": c("nx0"), "y0": c("ny0"), "x1": c("nx1"), "y1": c("ny1"), "print_w": c("px_w") / c("dev_ppi"), "print_h": c("px_h") / c("dev_ppi"), "ppi": c("dev_ppi"), "kind": F.lit("wallpaper"), "bleed": F.lit(0.0)}
    return moved.withColumns(new).drop("nx0", "ny0", "nx1", "ny1")


MOST_PRESETS = 10_000


def manifest(version: int, engine: str, build: Column, region: Column, spec: Column, sources: Column, edition: Column, lineage: Column) -> Column:
    """Canonical JSON: keys in order, nothing between, parts that do not apply left out. Its bytes follow from its inputs."""
    later = edition >= 2
    newest = F.slice(lineage, F.greatest(F.lit(1), F.size(lineage) - (MOST_LINEAGE - 1)), F.lit(MOST_LINEAGE))
    return F.to_json(
        F.struct(
            F.when(later, edition).alias("edition"),
            F.lit(engine).alias("engine"),
            build.alias("engine_version"),
            F.when(later, newest).alias("lineage"),
            F.lit(version).alias("manifest_version"),
            region.alias("region_id"),
            sources.alias("sources"),
            spec.alias("spec"),
        ),
        {"ignoreNullFields": "true"},
    )


def parsed(text: Column, schema: str | StructType, defaults: dict[str, Column]) -> Column:
    """A struct read from JSON of an older or newer writer, nested as the schema is: fields it lacks are filled in from defaults (by path, `spec.edition`), fields that are unknown are left out; null where it is no JSON object.

    A field of another type is null, and so filled in, without harm to the others; a struct that is missing stays null.
    """
    kind = schema if isinstance(schema, StructType) else _struct(schema)
    found = F.from_json(text, kind)

    def filled(value: Column, kind: DataType, path: str) -> Column:
        if isinstance(kind, StructType):
            fields = [filled(value[f.name], f.dataType, f"{path}.{f.name}".lstrip(".")).alias(f.name) for f in kind.fields]
            made = F.struct(*fields)
            return F.when(value.isNotNull(), made) if path else made
        return F.coalesce(value, defaults[path]) if path in defaults else value

    whole = F.try_parse_json(text)
    return F.when(found.isNotNull() & (F.schema_of_variant(whole).startswith("OBJECT")), filled(found, kind, ""))


def _struct(ddl: str) -> StructType:
    """The type of a list of columns; types may be nested and have commas of their own."""
    return StructType.fromDDL(ddl)


def nan_to_null(values: Column) -> Column:
    """Numbers as JSON holds them: what is not finite is null."""
    return F.transform(values, lambda v: F.when(finite(v), v))


def null_to_nan(values: Column) -> Column:
    return F.transform(values, lambda v: F.coalesce(v, F.lit(float("nan"))))


def caption(title: Column, region: Column, edition: Column) -> Column:
    """The title, else the region, in capitals, and the edition, the first where none is given; null without either name or with an edition that is no number."""
    spaces = " \t\n\r\f\v"
    name = F.coalesce(F.when(F.trim(title, F.lit(spaces)) != "", F.trim(title, F.lit(spaces))), F.when(region != "", region))
    number = F.when(edition.isNull() | (edition.cast("string") == "") | (edition.cast("string") == "0"), F.lit(1)).otherwise(edition.try_cast("int"))
    return F.concat(F.replace(F.upper(name), F.lit("_"), F.lit(" ")), F.lit(" — EDITION "), number.cast("string"))


def place_list(region: Column, names: Column, most: int = 4) -> Column:
    """A region and up to `most` names in it, as alternative text."""
    return F.concat_ws(" - ", F.replace(region, F.lit("_"), F.lit(" ")), F.when(F.size(names) > 0, F.array_join(F.slice(names, 1, most), ", ")))
