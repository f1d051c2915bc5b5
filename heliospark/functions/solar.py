"""Where the sun stands: published low-order series, with refraction and parallax."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heliospark.constants import LAT, LON, LOW_SUN_DEG, LOW_SUN_MINUTES, MAX_SHADOW, UTC_OFFSET_HOURS
from heliospark.functions.geo import let


def _sun(date: Column, minute: Column, lat: float, lon: float) -> Column:
    """struct(d, h): declination and hour angle in radians; date and minute are of the city's clock. Each term is named once, so that the expression stays small."""
    rad = F.radians

    def seen(days, t, node, long, tilt):
        ascension = F.degrees(F.atan2(F.cos(tilt) * F.sin(long), F.cos(long)))
        sidereal = 280.46061837 + 360.98564736629 * days + 0.000387933 * t * t
        return F.struct(F.asin(F.sin(tilt) * F.sin(long)).alias("d"), rad(sidereal + lon - ascension).alias("h"))

    def long_of(t, node, anomaly):
        mean_long = F.pmod(280.46646 + t * (36000.76983 + t * 0.0003032), F.lit(360.0))
        centre = F.sin(anomaly) * (1.914602 - t * (0.004817 + 0.000014 * t)) + F.sin(2 * anomaly) * (0.019993 - 0.000101 * t) + F.sin(3 * anomaly) * 0.000289
        return rad(mean_long + centre - 0.00569 - 0.00478 * F.sin(node))

    def at(days, t, node):
        tilt_of = rad(23 + (26 + (21.448 - t * (46.815 + t * (0.00059 - t * 0.001813))) / 60) / 60 + 0.00256 * F.cos(node))
        long = let(rad(357.52911 + t * (35999.05029 - 0.0001537 * t)), lambda anomaly: long_of(t, node, anomaly))
        return let(long, lambda l: let(tilt_of, lambda tilt: seen(days, t, node, l, tilt)))  # noqa: E741

    when = F.date_diff(date, F.lit("2000-01-01").cast("date")) - 0.5 + (minute - UTC_OFFSET_HOURS * 60) / 1440
    return let(when, lambda days: let((days + 69.2 / 86400) / 36525, lambda t: let(rad(125.04 - 1934.136 * t), lambda node: at(days, t, node))))


def sun_position(date: Column, minute: Column, lat: float = LAT, lon: float = LON) -> Column:
    """struct(altitude, azimuth) in degrees, azimuth from north over east, as seen from the ground."""
    phi = F.radians(F.lit(lat))

    def seen(s):
        up = F.degrees(F.asin(F.sin(phi) * F.sin(s["d"]) + F.cos(phi) * F.cos(s["d"]) * F.cos(s["h"])))
        azimuth = F.pmod(F.degrees(F.atan2(F.sin(s["h"]), F.cos(s["h"]) * F.sin(phi) - F.tan(s["d"]) * F.cos(phi))) + 180, F.lit(360.0))
        return let(up, lambda up: F.struct((up + bent(up) - 8.794 / 3600 * F.cos(F.radians(up))).alias("altitude"), azimuth.alias("azimuth")))

    # Saemundsson's refraction at 1013 hPa and 15 degrees; parallax of 8.794 seconds
    bent = lambda up: F.when(up > -1, 1.02 / F.tan(F.radians(up + 10.3 / (up + 5.11))) / 60 * (1013.25 / 1010) * (283 / 288.15)).otherwise(0.0)
    return let(_sun(date, minute, lat, lon), seen)


def daylight_minutes(date: Column, lat: float = LAT, lon: float = LON) -> Column:
    """The day's stamps: each hour, in thirds where the sun is low, as long as it is up."""
    up = lambda m: sun_position(date, m, lat, lon)["altitude"]
    hours = F.transform(F.sequence(F.lit(0), F.lit(23)), lambda h: F.when(up(h * 60) < LOW_SUN_DEG, F.transform(F.array(*map(F.lit, LOW_SUN_MINUTES)), lambda m: h * 60 + m)).otherwise(F.array(h * 60)))
    return F.filter(F.flatten(hours), lambda m: up(m) > 0)


def daylight(dates: DataFrame, date: str, lat: float = LAT, lon: float = LON) -> DataFrame:
    """The stamps of `daylight_minutes` for many dates, a row each: dates with minute and altitude."""
    tried = dates.select("*", F.explode(F.sequence(F.lit(0), F.lit(23))).alias("__h"))
    tried = tried.withColumn("__up", sun_position(F.col(date), F.col("__h") * 60, lat, lon)["altitude"])
    tried = tried.select("*", F.explode(F.when(F.col("__up") < LOW_SUN_DEG, F.transform(F.array(*map(F.lit, LOW_SUN_MINUTES)), lambda m: F.col("__h") * 60 + m)).otherwise(F.array(F.col("__h") * 60))).alias("minute"))
    return tried.withColumn("altitude", sun_position(F.col(date), F.col("minute"), lat, lon)["altitude"]).where("altitude > 0").drop("__h", "__up")


def shadow_vector(height: Column, altitude: Column, azimuth: Column, longest: float = MAX_SHADOW) -> Column:
    """struct(dx, dy) by which a roof's shadow is shifted; null without sun."""
    reach = F.least(height / F.tan(F.radians(altitude)), F.lit(longest))
    away = F.radians(azimuth + 180)
    return F.when(altitude > 0, F.struct((reach * F.sin(away)).alias("dx"), (reach * F.cos(away)).alias("dy")))


def sun_angle(lat: float, declination: Column) -> Column:
    """struct(altitude, ratio): the noon sun and how many heights a shadow is long."""
    up = 90 - F.abs(lat - declination)
    return F.struct(up.alias("altitude"), (1 / F.tan(F.radians(up))).alias("ratio"))
