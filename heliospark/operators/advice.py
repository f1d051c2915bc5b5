"""When to leave: one verdict over the departures of a day."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliospark.constants import CHART_HEIGHT, CHART_PAD, CHART_WIDTH, TIE, USEFUL_GAIN
from heliospark.functions.clock import to_minutes
from heliospark.functions.exposure import chart_height, gain, share


def verdict(departures: DataFrame, keys: list[str]) -> DataFrame:
    """Per day: the recommended departure and the one of the largest gain.

    departures(*keys, pos, time, mode, duration_s, shade_fraction, baseline_shade_fraction, baseline_duration_s). Comparing with a
    tolerance is not transitive, so the rows are folded in their order and not ranked."""
    g = gain(F.col("shade_fraction"), F.col("baseline_shade_fraction"), F.col("mode"))
    extra = F.greatest(F.col("duration_s") - F.col("baseline_duration_s"), F.lit(0.0))
    rows = departures.withColumn("gain", g).withColumn("extra_s", extra).withColumn("share", share(F.col("shade_fraction"), F.col("mode")))
    rows = rows.withColumn("value", F.col("gain") / (1 + F.col("extra_s") / 60))
    one = F.struct("pos", "time", "gain", "extra_s", "share", "value", "duration_s")
    day = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(one)).alias("d"))

    def fold(items, better):
        return F.aggregate(F.slice(items, 2, F.greatest(F.size(items), F.lit(1))), F.element_at(items, 1), lambda a, b: F.when(better(a, b), b).otherwise(a))

    useful = F.filter("d", lambda r: r["gain"] >= USEFUL_GAIN)
    best = F.when(F.size(useful) > 0, fold(useful, lambda a, b: (b["value"] - a["value"] > TIE) | ((F.abs(b["value"] - a["value"]) <= TIE) & (b["duration_s"] < a["duration_s"])))).otherwise(
        fold(F.col("d"), lambda a, b: b["duration_s"] < a["duration_s"])
    )
    out = day.select(*keys, best.alias("b"), fold(F.col("d"), lambda a, b: b["gain"] > a["gain"]).alias("p"), (F.size(useful) > 0).alias("has_useful_detour"))
    return out.select(
        *keys, F.col("b.time").alias("best_time"), F.col("b.share").alias("best_share"), F.col("b.gain").alias("best_gain"), F.col("b.extra_s").alias("extra_s"), "has_useful_detour",
        F.col("p.time").alias("payoff_time"), F.col("p.gain").alias("payoff_gain"),
    )


def chart(departures: DataFrame, keys: list[str]) -> DataFrame:
    """Per day: xs, line, area, bands, and the direction of its exposure (sun only if every row seeks sun; mixed if modes differ)."""
    day = departures.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", "time", "shade_fraction", "mode"))).alias("d"), F.bool_and(F.col("mode") == "sun").alias("sun"), F.count_distinct("mode").alias("modes"))
    at = F.transform("d", lambda r: to_minutes(r["time"]))
    first, span = F.element_at("at", 1), F.element_at("at", -1) - F.element_at("at", 1)
    xs = F.transform("at", lambda m: F.when(span > 0, CHART_PAD + (m - first) / span * (CHART_WIDTH - 2 * CHART_PAD)).otherwise(CHART_WIDTH / 2))
    day = day.withColumn("at", at).withColumn("xs", xs).withColumn("ys", F.transform("d", lambda r: chart_height(F.when(F.col("sun"), 1 - r["shade_fraction"]).otherwise(r["shade_fraction"]))))
    line = F.array_join(F.zip_with("xs", "ys", lambda x, y: F.format_string("%.1f,%.1f", x, y)), " ")
    edge = lambda i: F.get("xs", i)
    band = F.transform(
        "xs",
        lambda x, i: F.struct(
            F.when(i == 0, 0.0).otherwise((edge(i - 1) + x) / 2).alias("x"),
            F.greatest(F.coalesce((x + edge(i + 1)) / 2, F.lit(CHART_WIDTH)) - F.when(i == 0, 0.0).otherwise((edge(i - 1) + x) / 2), F.lit(0.0)).alias("width"),
        ),
    )
    closed = F.format_string(f"%.1f,{CHART_HEIGHT:.0f} %s %.1f,{CHART_HEIGHT:.0f}", F.element_at("xs", 1), line, F.element_at("xs", -1))
    return day.select(*keys, "xs", line.alias("line"), closed.alias("area"), band.alias("bands"), F.when(F.col("modes") > 1, "mixed").when(F.col("sun"), "sun").otherwise("shade").alias("direction"))
