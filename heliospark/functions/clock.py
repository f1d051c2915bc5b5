"""The city's clock: minutes of the day, stamps, seasons."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from heliospark.constants import LEAF_FIRST, LEAF_LAST, MINUTES_IN_DAY, UTC_OFFSET_HOURS


def to_minutes(hhmm: Column) -> Column:
    return F.substring(hhmm, 1, 2).cast("int") * 60 + F.substring(hhmm, 4, 2).cast("int")


def to_hhmm(minutes: Column) -> Column:
    return F.format_string("%02d:%02d", F.floor(minutes / 60).cast("int"), F.pmod(minutes, F.lit(60)).cast("int"))


def round_half_up(x: Column) -> Column:
    return F.floor(x + F.lit(0.5))


def clock_after(hhmm: Column, seconds: Column) -> Column:
    """The clock after a walk; it wraps at midnight."""
    return to_hhmm(F.pmod(to_minutes(hhmm) + round_half_up(seconds / 60), F.lit(MINUTES_IN_DAY)))


def nearest_stamp(minutes: Column, stamps: Column) -> Column:
    """Of an array of stamps the nearest, of two as near the earlier in the array; noon if there are none."""
    pick = F.aggregate(stamps, F.lit(None).cast("string"), lambda best, t: F.when(best.isNull() | (F.abs(to_minutes(t) - minutes) < F.abs(to_minutes(best) - minutes)), t).otherwise(best))
    return F.coalesce(pick, F.lit("12:00"))


def ends_in(hhmm: Column, seconds: Column, stamps: Column) -> Column:
    """The stamp in which a walk arrives if it is another than it left in, 'dark' after the last one, else null."""
    arriving = to_minutes(hhmm) + round_half_up(seconds / 60)
    landed = nearest_stamp(arriving, stamps)
    return F.when(F.size(stamps) == 0, None).when(arriving > to_minutes(F.element_at(stamps, -1)), "dark").when(landed != hhmm, landed)


def is_daylight(hhmm: Column, stamps: Column) -> Column:
    return F.coalesce(F.array_contains(stamps, hhmm), F.lit(True))


def slider_times(stamps: Column) -> Column:
    """Whole hours and stamps, in order."""
    hours = F.array(*[F.lit(f"{h:02d}:00") for h in range(24)])
    return F.array_sort(F.array_union(hours, F.coalesce(stamps, F.array().cast("array<string>"))))


def leaf_on(date: Column) -> Column:
    return (F.month(date) * 100 + F.dayofmonth(date)).between(LEAF_FIRST, LEAF_LAST)


def season(date: Column) -> Column:
    m = F.month(date)
    return F.when(m.isin(12, 1, 2), "winter").when(m.isin(3, 4, 5), "spring").when(m.isin(6, 7, 8), "summer").otherwise("autumn")


#: Until which minute each part of the day lasts.
PERIODS = [(300, "night"), (420, "dawn"), (660, "morning"), (840, "midday"), (1080, "afternoon"), (1230, "evening")]


def period(minutes: Column) -> Column:
    """Part of the day that a slider names."""
    out = F.lit("night")
    for until, name in reversed(PERIODS):
        out = F.when(minutes < until, name).otherwise(out)
    return out


def city_time(utc: Column) -> Column:
    return utc + F.make_dt_interval(F.lit(0), F.lit(UTC_OFFSET_HOURS))


def stamp_file_stem(hhmm: Column) -> Column:
    return F.replace(hhmm, F.lit(":"), F.lit(""))


def pretty_date(date: Column) -> Column:
    return F.date_format(date, "d MMM yyyy")


def minutes_past_midnight(ts: Column) -> Column:
    return F.hour(ts) * 60 + F.minute(ts)
