"""Where the sun stands, as column expressions (the published low-accuracy series of Meeus, as NOAA uses it)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOWEST, HIGHEST = 8.0, 80.0
GOLDEN = 12.0
DAY_S = 86400.0


def julian_day(t: Column) -> Column:
    """Of seconds since 1970-01-01 UTC."""
    return t / DAY_S + 2440587.5


def with_position(rows: DataFrame, t: str, lat: str, lon: str) -> DataFrame:
    """rows with sun_az (degrees from north) and sun_alt at unix seconds t. Built up in steps, so each term is computed once."""
    sin, cos, rad = F.sin, F.cos, F.radians
    c = F.col
    d = rows.withColumn("__c", (julian_day(c(t)) - 2451545.0) / 36525.0)
    # a fixed series: mean longitude, anomaly, eccentricity, node
    d = d.withColumns(
        {
            "__l0": F.pmod(280.46646 + c("__c") * (36000.76983 + c("__c") * 0.0003032), F.lit(360.0)),
            "__m": rad(357.52911 + c("__c") * (35999.05029 - 0.0001537 * c("__c"))),
            "__e": 0.016708634 - c("__c") * (0.000042037 + 0.0000001267 * c("__c")),
            "__o": rad(125.04 - 1934.136 * c("__c")),
        }
    )
    centre = sin("__m") * (1.914602 - c("__c") * (0.004817 + 0.000014 * c("__c"))) + sin(2 * c("__m")) * (0.019993 - 0.000101 * c("__c")) + sin(3 * c("__m")) * 0.000289
    tilt = 23 + (26 + (21.448 - c("__c") * (46.815 + c("__c") * (0.00059 - c("__c") * 0.001813))) / 60) / 60
    d = d.withColumns({"__lam": rad(c("__l0") + centre - 0.00569 - 0.00478 * sin("__o")), "__eps": rad(tilt + 0.00256 * cos("__o")), "__l": rad("__l0")})
    half = F.tan(c("__eps") / 2)
    d = d.withColumns({"__dec": F.asin(sin("__eps") * sin("__lam")), "__y": half * half})
    eot = (
        c("__y") * sin(2 * c("__l"))
        - 2 * c("__e") * sin("__m")
        + 4 * c("__e") * c("__y") * sin("__m") * cos(2 * c("__l"))
        - 0.5 * c("__y") * c("__y") * sin(4 * c("__l"))
        - 1.25 * c("__e") * c("__e") * sin(2 * c("__m"))
    )
    minutes = F.pmod(c(t), F.lit(DAY_S)) / 60 + 4 * F.degrees(eot) + 4 * c(lon)
    d = d.withColumn("__ha", F.pmod(minutes, F.lit(1440.0)) / 4 - 180)
    d = d.withColumn("__cz", F.least(F.greatest(sin(rad(lat)) * sin("__dec") + cos(rad(lat)) * cos("__dec") * cos(rad("__ha")), F.lit(-1.0)), F.lit(1.0)))
    d = d.withColumn("__z", F.acos("__cz"))
    arc = F.degrees(F.acos(F.least(F.greatest((sin(rad(lat)) * c("__cz") - sin("__dec")) / (cos(rad(lat)) * sin("__z")), F.lit(-1.0)), F.lit(1.0))))
    azimuth = F.when(sin("__z") < 1e-9, 0.0).when(c("__ha") > 0, F.pmod(arc + 180, F.lit(360.0))).otherwise(F.pmod(540 - arc, F.lit(360.0)))
    d = d.withColumns({"sun_az": azimuth, "sun_alt": 90 - F.degrees("__z")})
    return d.drop(*(x for x in d.columns if x.startswith("__")))


def clamped(altitude: Column) -> Column:
    return F.least(F.greatest(altitude, F.lit(LOWEST)), F.lit(HIGHEST))


def local_hour(t: Column, lon: Column) -> Column:
    """Hour of the sun's own day at a longitude."""
    return F.pmod(t + lon * 240.0, F.lit(DAY_S)) / 3600.0


def golden_hour(places: DataFrame, key: str, midnight: str, lat: str, lon: str) -> DataFrame:
    """key, golden_t: by the minute, the first time after an hour into the solar day that the sun sinks through GOLDEN; else its highest."""
    start = F.col(midnight) - F.col(lon) * 240.0
    minutes = places.withColumn("minute", F.explode(F.sequence(F.lit(0), F.lit(1440)))).withColumn("t", start + F.col("minute") * 60.0)
    # the minute before is computed beside each minute: a window over 1,441 rows a key is not needed
    now = with_position(minutes, "t", lat, lon).withColumnsRenamed({"sun_alt": "alt"}).drop("sun_az")
    both = with_position(now.withColumn("t_before", F.col("t") - 60.0), "t_before", lat, lon)
    sinks = (F.col("minute") > 60) & (F.col("sun_alt") >= GOLDEN) & (F.col("alt") < GOLDEN)
    found = both.groupBy(key).agg(F.min(F.when(sinks, F.col("t"))).alias("crossing"), F.max_by("t", F.struct("alt", -F.col("minute"))).alias("noon"))
    return found.select(key, F.coalesce("crossing", "noon").alias("golden_t"))


def diurnal_schedule(anchors: DataFrame, key: str, t_min: str, t_max: str, lat: str, lon: str, frames: int) -> DataFrame:
    """key, frame, azimuth, altitude: the sun over a journey's own hours, in even steps."""
    last = F.when(F.col(t_max) <= F.col(t_min), F.col(t_min) + 3600.0).otherwise(F.col(t_max))
    share = F.col("frame") / (frames - 1) if frames > 1 else F.lit(1.0)
    each = anchors.withColumn("frame", F.explode(F.sequence(F.lit(0), F.lit(frames - 1)))).withColumn("t", F.col(t_min) + share * (last - F.col(t_min)))
    return with_position(each, "t", lat, lon).select(key, "frame", F.col("sun_az").alias("azimuth"), clamped(F.col("sun_alt")).alias("altitude"))


def seasonal_days(days: Column, frames: int) -> Column:
    """array<struct<frame, day>>: days picked evenly over a sorted list, rounding half to even."""
    share = lambda k: k / (frames - 1) if frames > 1 else F.lit(1.0)
    return F.transform(F.sequence(F.lit(0), F.lit(frames - 1)), lambda k: F.struct(k.alias("frame"), F.element_at(days, F.rint(share(k) * (F.size(days) - 1)).cast("int") + 1).alias("day")))


def light(mode: Column, azimuth: Column, altitude: Column, usual_azimuth: Column, usual_altitude: Column) -> Column:
    """struct<azimuth, altitude>: the journey's own sun where it has one, null where it should and has not, else the region's."""
    own = F.when(azimuth.isNotNull() & altitude.isNotNull(), F.struct(azimuth.cast("double").alias("azimuth"), altitude.cast("double").alias("altitude")))
    usual = F.struct(F.coalesce(usual_azimuth, F.lit(315.0)).alias("azimuth"), F.coalesce(usual_altitude, F.lit(45.0)).alias("altitude"))
    return F.when(mode == "journey", own).otherwise(usual)


def towards(azimuth: Column, altitude: Column) -> Column:
    """struct<x, y, z>: the unit vector to the sun; x is east, y north."""
    a, e = F.radians(azimuth), F.radians(altitude)
    return F.struct((F.sin(a) * F.cos(e)).alias("x"), (F.cos(a) * F.cos(e)).alias("y"), F.sin(e).alias("z"))


def yaw(tick: Column, most: float, ticks: int) -> Column:
    """A slow turn to and fro, by the number of the tick."""
    return most * F.sin(6.283185307179586 * tick / ticks)


def metres_a_degree(lat: Column) -> Column:
    """Of longitude."""
    return 111320.0 * F.cos(F.radians(lat))


def clock_hour(t: Column, lon: Column) -> Column:
    """Hour of the sun's own day, by whole seconds, to three places."""
    return F.round(F.floor(F.pmod(t + lon * 240.0, F.lit(DAY_S))) / 3600.0, 3)


def journey_light(anchors: DataFrame, key: str, hour: Column | None = None) -> DataFrame:
    """key, available, azimuth, altitude, hour: the sun over a journey.

    anchors: key, lat, lon, last_day (yyyy-MM-dd, null where nothing is timed), summit_t. The moment is the given hour of the
    sun's own day on the last day; without one, when the highest point was reached; without that, the golden hour of the last day. A journey
    without a day has no light. hour is that of the moment.
    """
    day = F.datediff(F.to_date("last_day"), F.to_date(F.lit("1970-01-01"))) * DAY_S
    asked = F.lit(None).cast("double") if hour is None else hour.cast("double")
    placed = anchors.withColumns({"__midnight": day, "__asked": day + asked * 3600.0 - F.col("lon") * 240.0})
    unknown = placed.where(F.col("last_day").isNotNull() & F.col("__asked").isNull() & F.col("summit_t").isNull())
    golden = golden_hour(unknown, key, "__midnight", "lat", "lon")
    at = F.when(F.col("last_day").isNotNull(), F.coalesce("__asked", F.col("summit_t").cast("double"), "golden_t"))
    lit = with_position(placed.join(golden, key, "left").withColumn("t_light", at), "t_light", "lat", "lon")
    known = F.col("t_light").isNotNull()
    turned = F.pmod(F.col("sun_az"), F.lit(360.0))
    return lit.select(key, known.alias("available"), F.when(known, turned).alias("azimuth"), F.when(known, clamped(F.col("sun_alt"))).alias("altitude"), F.when(known, clock_hour(F.col("t_light"), F.col("lon"))).alias("hour"))
