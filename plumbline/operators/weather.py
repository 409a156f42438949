"""Hourly cumulative weather to a dense daily table, and its summary.

Precipitation accumulates from 01:00 to the next midnight, so an hour's cycle is the day of
the hour before it.  Days are aggregated once (by day for temperature, by cycle for rain) and
meet the calendar in left joins; a day without data still is a row.  Missing is never
zero: totals are null unless the cycle is whole, and a null ends every running sum.
"""

from __future__ import annotations

import math
import re
from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.casts import strict_number, zoned_timestamp
from plumbline.operators.contracts import ContractError, both_at, require, require_columns, require_unique

TOLERANCE = 1e-9
CUMULATIVE = (("precip_mm", "cum_precip_mm"), ("gdd_base5", "cum_gdd_base5"), ("gdd_base10", "cum_gdd_base10"))
COLUMNS = (
    "date temp_steps temp_complete_24h temp_mean_c temp_min_c temp_max_c precip_steps precip_complete_24h precip_terminal_present "
    "precip_within_cycle_decreases precip_nonnegative precip_valid precip_mm precip_observed_lower_bound_mm gdd_base5 gdd_base10 "
    "hot_day_ge30c frost_day_lt0c dry_day_lt1mm cum_precip_mm cum_gdd_base5 cum_gdd_base10"
).split()


def day(text: str) -> date:
    if not re.fullmatch(r"\d{4}-\d{2}-\d{2}", text):
        raise ContractError(f"not a date: {text}")
    return date.fromisoformat(text)


def strict_hours(hourly: DataFrame, available_by: str | None = None) -> DataFrame:
    """t, temperature_k, precip_m of the hours that the cutoff lets through; the whole frame is checked first."""
    names = ["datetime", "temperature_k", "precip_m"] + (["available_at"] if available_by else [])
    raw = require_columns(hourly, names).select(*(F.col(c).cast("string").alias(f"raw_{c}") for c in names))
    df = raw.select("*", zoned_timestamp(F.col("raw_datetime")).alias("t"), *(strict_number(F.col(f"raw_{c}")).alias(c) for c in names[1:3]))
    given = lambda c: F.col(f"raw_{c}").isNotNull() & ~F.upper(F.trim(f"raw_{c}")).isin("", "NAN")
    rules = [
        ("datetime needs a valid time with zone", F.col("t").isNull()),
        ("hours must be exact", F.col("t") != F.date_trunc("HOUR", "t")),
        *((f"{c} is not a finite number", given(c) & F.col(c).isNull()) for c in names[1:3]),
        ("temperature_k is negative", F.coalesce(F.col("temperature_k") < 0, F.lit(False))),
    ]
    if available_by:
        df = df.withColumn("available", zoned_timestamp(F.col("raw_available_at")))
        rules += [("available_at needs a valid time with zone", F.col("available").isNull()), ("available_at precedes its hour", F.col("available") < F.col("t"))]
    require(df, rules)
    require_unique(df, ["t"], "hour")
    if available_by:
        cutoff = zoned_timestamp(F.lit(available_by))
        df = df.where(both_at(F.col("t"), F.col("available"), cutoff))
    return df.select("t", "temperature_k", "precip_m")


def calendar(df: DataFrame, start: date, end: date) -> DataFrame:
    return df.sparkSession.sql(f"SELECT explode(sequence(DATE'{start}', DATE'{end}', INTERVAL 1 DAY)) AS date")


def poisoned(x: Column, window) -> Column:
    """Running sum that stays null from the first null on."""
    return F.when(F.count_if(x.isNull()).over(window) == 0, F.sum(x).over(window))


def daily_weather(hourly: DataFrame, start: str, end: str, *, available_by: str | None = None) -> DataFrame:
    """A row of COLUMNS for each day from start to end."""
    first, last = day(start), day(end)
    if last < first:
        raise ContractError("end must be on or after start")
    hours = strict_hours(hourly, available_by).select("t", (F.col("temperature_k") - 273.15).alias("c"), (F.col("precip_m") * 1000.0).alias("mm"), F.to_date("t").alias("d"), F.to_date(F.col("t") - F.expr("INTERVAL 1 HOUR")).alias("cycle"))
    inside = lambda c: F.col(c).between(F.lit(first), F.lit(last))
    temp = hours.where(inside("d")).groupBy(F.col("d").alias("date")).agg(F.count("*").alias("temp_steps"), F.count("c").alias("n_c"), F.avg("c").alias("mean"), F.min("c").alias("low"), F.max("c").alias("high"))
    order = Window.partitionBy("cycle").orderBy("t")
    drops = hours.where(inside("cycle") & F.col("mm").isNotNull()).withColumn("step", F.col("mm") - F.lag("mm").over(order)).groupBy(F.col("cycle").alias("date")).agg(F.count_if(F.col("step") < -TOLERANCE).alias("drops"), F.min("mm").alias("least"), F.max_by("mm", "t").alias("last_mm"))
    midnight = F.to_date("t") > F.col("cycle")
    rain = hours.where(inside("cycle")).groupBy(F.col("cycle").alias("date")).agg(F.count("*").alias("precip_steps"), F.count("mm").alias("n_mm"), F.max(midnight).alias("terminal"), F.max(F.when(midnight, F.col("mm"))).alias("total"))
    joined = calendar(hourly, first, last).join(temp, "date", "left").join(rain, "date", "left").join(drops, "date", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    days = joined.select(
        "date", zero("temp_steps").alias("temp_steps"), (zero("n_c") == 24).alias("temp_complete_24h"), "mean", "low", "high", zero("precip_steps").alias("precip_steps"),
        (zero("n_mm") == 24).alias("precip_complete_24h"), F.coalesce("terminal", F.lit(False)).alias("precip_terminal_present"),
        zero("drops").alias("precip_within_cycle_decreases"), F.coalesce(F.col("least") >= 0, F.lit(True)).alias("precip_nonnegative"), "total", "last_mm",
    )
    sound = F.col("precip_nonnegative") & (F.col("precip_within_cycle_decreases") == 0)
    days = days.withColumn("precip_valid", F.col("precip_complete_24h") & sound).withColumn("precip_mm", F.when(F.col("precip_valid"), F.col("total")))
    whole = lambda x: F.when(F.col("temp_complete_24h"), x)
    gdd = lambda base: whole(F.greatest((F.col("high") + F.col("low")) / 2 - base, F.lit(0.0)))
    days = days.select(
        "*", whole(F.col("mean")).alias("temp_mean_c"), whole(F.col("low")).alias("temp_min_c"), whole(F.col("high")).alias("temp_max_c"),
        F.when(sound, F.col("last_mm")).alias("precip_observed_lower_bound_mm"), gdd(5.0).alias("gdd_base5"), gdd(10.0).alias("gdd_base10"),
        whole((F.col("high") >= 30).cast("int")).alias("hot_day_ge30c"), whole((F.col("low") < 0).cast("int")).alias("frost_day_lt0c"),
        F.when(F.col("precip_valid"), (F.col("precip_mm") < 1).cast("int")).alias("dry_day_lt1mm"),
    )
    running = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)  # over the calendar alone: one row a day
    return days.select("*", *(poisoned(F.col(c), running).alias(to) for c, to in CUMULATIVE)).select(*COLUMNS)


def weather_summary(daily: DataFrame) -> DataFrame:
    """One row: coverage, whole totals (null if any day lacks one) and the partial total."""
    require_columns(daily, ["precip_mm", "temp_mean_c", "gdd_base5", "precip_valid", "temp_complete_24h"])
    whole = lambda c, f: F.when((F.count("*") > 0) & (F.count("*") == F.count(c)), f(c))
    return daily.agg(
        F.count("*").alias("days"), F.count_if("precip_valid").alias("valid_precipitation_days"), F.count_if("temp_complete_24h").alias("complete_temperature_days"),
        whole("precip_mm", F.sum).alias("precipitation_total_mm"), F.sum("precip_mm").alias("precipitation_observed_valid_days_mm"),
        whole("gdd_base5", F.sum).alias("gdd_base5_total"), whole("temp_mean_c", F.avg).alias("mean_temperature_c"), F.lit(True).alias("partial_totals_are_not_full_period_totals"),
    )


def corners(area: Sequence[float]) -> list[float]:
    """north, west, south, east within WGS84, checked."""
    if len(area) != 4 or not all(map(math.isfinite, area)):
        raise ContractError("an area has four finite coordinates")
    (north, west, south, east), bounds = area, (90.0, 180.0)
    if not (south < north and west < east and max(map(abs, (north, south))) <= bounds[0] and max(map(abs, (west, east))) <= bounds[1]):
        raise ContractError("an area is north, west, south, east within WGS84")
    return [float(x) for x in area]


def request_plan(df_session, start: str, end: str, area: Sequence[float] | None = None) -> DataFrame:
    """year, month, days, times (and area, where one is given) of the hourly requests, and the boundary hour that closes the last rain cycle."""
    first, last = day(start), day(end)
    if last < first:
        raise ContractError("end must be on or after start")
    if area is not None:
        return request_plan(df_session, start, end).withColumn("area", F.array(*map(F.lit, corners(area))))
    return df_session.sql(f"""
        WITH d AS (SELECT explode(sequence(DATE'{first}', DATE'{last}', INTERVAL 1 DAY)) AS d)
        SELECT date_format(d, 'yyyy') AS year, date_format(d, 'MM') AS month, array_sort(collect_list(date_format(d, 'dd'))) AS days,
               transform(sequence(0, 23), h -> lpad(cast(h AS string), 2, '0') || ':00') AS times, 'all' AS variables
        FROM d GROUP BY 1, 2
        UNION ALL
        SELECT date_format(DATE'{last}' + 1, 'yyyy'), date_format(DATE'{last}' + 1, 'MM'), array(date_format(DATE'{last}' + 1, 'dd')), array('00:00'), 'precipitation'
        ORDER BY year, month, variables""")
