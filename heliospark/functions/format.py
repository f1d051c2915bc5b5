"""Numbers as they are shown. Halves are rounded up."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from heliospark.functions.clock import round_half_up


def percent(share: Column) -> Column:
    return F.concat(round_half_up(share * 100).cast("string"), F.lit("%"))


def metres(m: Column) -> Column:
    return F.when(m >= 1000, F.format_string("%.2f km", m / 1000)).otherwise(F.concat(round_half_up(m).cast("string"), F.lit(" m")))


def minutes(seconds: Column) -> Column:
    total = round_half_up(seconds / 60)
    rest = F.pmod(total, F.lit(60))
    hours = F.floor(total / 60)
    return F.when(total < 60, F.concat(total.cast("string"), F.lit(" min"))).when(rest == 0, F.concat(hours.cast("string"), F.lit(" h"))).otherwise(F.format_string("%d h %02d", hours, rest))


def roughly(m: Column) -> Column:
    km = m / 1000
    return (
        F.when(m < 1000, F.concat((round_half_up(m / 10) * 10).cast("string"), F.lit(" m")))
        .when(km < 10, F.format_string("%.1f km", km))
        .otherwise(F.concat(round_half_up(km).cast("string"), F.lit(" km")))
    )
