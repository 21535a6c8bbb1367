"""Text rules as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Which word in a waypoint's symbol stands for which icon, in order.
SYMBOL_ICONS = (
    ("summit", "peak"), ("peak", "peak"), ("mountain", "peak"), ("camp", "camp"), ("tent", "camp"), ("shelter", "camp"), ("water", "water"),
    ("spring", "water"), ("river", "water"), ("photo", "camera"), ("camera", "camera"), ("scenic", "camera"), ("view", "camera"), ("star", "star"),
)
WAY_CLASSES = {"path": "trail", "footway": "trail", "bridleway": "trail", "cycleway": "trail", "track": "4wd"}


def first_match(text: Column, rules: Sequence[tuple[str, str]], default: Column) -> Column:
    """The value of the first rule whose key the text contains."""
    out = default
    for key, value in reversed(rules):
        out = F.when(F.contains(text, F.lit(key)), value).otherwise(out)
    return out


def symbol_icon(symbol: Column) -> Column:
    return first_match(F.lower(F.coalesce(symbol, F.lit(""))), SYMBOL_ICONS, F.lit("flag"))


def way_class(highway: Column) -> Column:
    return F.coalesce(F.create_map(*(F.lit(x) for kv in WAY_CLASSES.items() for x in kv))[highway], F.lit("road"))


def slug(name: Column, default: str = "region") -> Column:
    made = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.when(made == "", default).otherwise(made)


def year_span(days: Column) -> Column:
    """The year, or first and last year, of days written with ASCII digits; null if none."""
    years = F.array_distinct(F.transform(F.filter(days, lambda d: d.rlike("^[0-9]{4}")), lambda d: F.substring(d, 1, 4)))
    low, high = F.array_min(years), F.array_max(years)
    return F.when(low == high, low).otherwise(F.concat(low, F.lit("–"), high))


def file_name(prefix: str, region: Column, edition: Column, years: Column, kind: str, fmt: str) -> Column:
    later = F.when(edition >= 2, F.concat(F.lit("_edition-"), edition.cast("string"))).otherwise("")
    span = F.coalesce(F.concat(F.lit("_"), F.replace(years, F.lit("–"), F.lit("-"))), F.lit(""))
    return F.concat(F.lit(f"{prefix}_"), region, later, span, F.lit(f"{kind}.{fmt}"))


def credit_line(datasets: Column, rules: Sequence[tuple[str, str]], most: int = 200) -> Column:
    """Short credits of known datasets and the names of others, printable ASCII only."""
    named = F.filter(F.transform(datasets, F.trim), lambda d: d != "")
    each = F.transform(named, lambda d: first_match(d, rules, d))
    return F.substring(F.regexp_replace(F.array_join(each, " - "), "[^ -~]", ""), 1, most)


def hex_colour(text: Column) -> Column:
    """struct r, g, b of #rrggbb, null for anything else."""
    part = lambda i: F.conv(F.substring(text, i, 2), 16, 10).cast("int")
    return F.when(text.rlike("^#[0-9A-Fa-f]{6}$"), F.struct(part(2).alias("r"), part(4).alias("g"), part(6).alias("b")))


def iso_seconds(text: Column) -> Column:
    """Unix seconds of an ISO timestamp, UTC unless it says otherwise; null if it is none."""
    return F.unix_micros(F.try_to_timestamp(F.regexp_replace(text, "Z$", "+00:00"))) / 1000000.0


def iso19(t: Column) -> Column:
    return F.date_format(F.timestamp_seconds(t), "yyyy-MM-dd'T'HH:mm:ss")


def search(keys: Column, query: str) -> Column:
    """Whether one of the keys contains the query, whatever the case."""
    return F.exists(keys, lambda k: F.contains(F.lower(k), F.lit(query.lower())))


def links(html: Column, attribute: str) -> Column:
    return F.regexp_extract_all(html, F.lit(rf'{attribute}="([^"]*)"'), F.lit(1))


def finite_number(text: Column) -> Column:
    """A number that is one; null for anything else, infinities and NaN included."""
    n = text.try_cast("double")
    return F.when(~F.isnan(n) & (F.abs(n) < float("inf")), n)


def sizes(text: Column, most: int) -> Column:
    """array<struct<w, h>> of a list such as 1080x1350,1200x630; null unless every part is a size of 1 to most a side."""
    parts = F.transform(F.split(F.lower(F.regexp_replace(text, r"\s+", "")), ","), lambda p: F.struct(F.regexp_extract(p, "^([0-9]{1,6})x([0-9]{1,6})$", 1).try_cast("int").alias("w"), F.regexp_extract(p, "^([0-9]{1,6})x([0-9]{1,6})$", 2).try_cast("int").alias("h")))
    good = F.forall(parts, lambda s: F.coalesce(s["w"].between(1, most) & s["h"].between(1, most), F.lit(False)))
    return F.when(good, parts)
