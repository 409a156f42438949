"""Cutoff-aware season features: contracts, two-clock filter, same-day collapse, features by field."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.casts import finite, zoned_timestamp
from plumbline.operators.contracts import ContractError, both_at, require, require_columns, require_unique

COUNTS = ("valid_pixels", "ndmi_valid_pixels", "geometry_pixels")


def weighted_mean(x: Column, w: Column) -> Column:
    """Over rows with a value and a positive weight; null if there is none."""
    use = finite(x).isNotNull() & (finite(w) > 0)
    return F.sum(F.when(use, x * w)) / F.nullif(F.sum(F.when(use, w)), F.lit(0.0))


def collapse(obs: DataFrame, field: str = "field_id", date: str = "date") -> DataFrame:
    """One row a field and day: weighted indices, summed counts, recomputed fraction."""
    return obs.groupBy(field, date).agg(
        weighted_mean(F.col("ndvi_mean"), F.col("valid_pixels")).alias("ndvi"), weighted_mean(F.col("ndmi_mean"), F.col("ndmi_valid_pixels")).alias("ndmi"),
        *(F.sum(c).cast("long").alias(c) for c in COUNTS), F.count("*").alias("item_count"),
    ).withColumn("clear_fraction", F.col("valid_pixels") / F.nullif(F.col("geometry_pixels"), F.lit(0))).select(field, date, "ndvi", "ndmi", *COUNTS, "clear_fraction", "item_count")


def features(good: DataFrame) -> DataFrame:
    """By field: counts, first and last day, peak (earliest tie), latest, trapezoid area in index-days."""
    order = Window.partitionBy("field_id").orderBy("date")
    steps = good.select("*", (F.datediff("date", F.lag("date").over(order)) * (F.col("ndvi") + F.lag("ndvi").over(order)) / 2).alias("area"))
    return steps.groupBy("field_id").agg(
        F.count("*").alias("good_observations"), F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.avg("clear_fraction").alias("mean_clear_fraction"),
        F.max("ndvi").alias("peak_ndvi"), F.min_by("date", F.struct((-F.col("ndvi")).alias("v"), "date")).alias("peak_ndvi_date"), F.max_by("ndvi", "date").alias("latest_ndvi"),
        F.sum("area").alias("auc_ndvi_days"), F.avg("ndmi").alias("mean_ndmi"), F.min("ndmi").alias("min_ndmi"),
    )


def cutoff_features(observations: DataFrame, cutoff: str, *, minimum_pixels: int = 1, minimum_clear_fraction: float = 0.0, require_available_at: bool = True) -> tuple[DataFrame, DataFrame]:
    """(daily, features) as known at the cutoff."""
    if type(minimum_pixels) is not int or minimum_pixels < 1:
        raise ContractError("minimum_pixels must be a positive integer")
    if not 0 <= minimum_clear_fraction <= 1:
        raise ContractError("minimum_clear_fraction must be from 0 to 1")
    names = ["field_id", "item_id", "datetime", "ndvi_mean", "ndmi_mean", *COUNTS, "clear_fraction"] + (["available_at"] if require_available_at else [])
    df = require_columns(observations, names).withColumn("t__", zoned_timestamp(F.col("datetime").cast("string")))
    rules = [("field_id and item_id are needed", F.col("field_id").isNull() | F.col("item_id").isNull()), ("datetime needs a valid time with zone", F.col("t__").isNull())]
    if require_available_at:
        df = df.withColumn("a__", zoned_timestamp(F.col("available_at").cast("string")))
        rules += [("available_at needs a valid time with zone", F.col("a__").isNull()), ("available_at precedes acquisition", F.col("a__") < F.col("t__"))]
    require(df, rules)
    require_unique(df, ["field_id", "item_id"], "field and item")
    limit = zoned_timestamp(F.lit(cutoff))
    seen = df.where(both_at(F.col("t__"), F.col("a__"), limit) if require_available_at else F.col("t__") <= limit)
    numbers = seen.select("field_id", F.to_date("t__").alias("date"), F.year("t__").alias("year"), *(F.col(c).try_cast("double").alias(c) for c in (*COUNTS, "ndvi_mean", "ndmi_mean", "clear_fraction")), *(F.col(c).isNotNull().alias(f"has_{c}") for c in ("ndvi_mean", "ndmi_mean", "clear_fraction")))
    numbers = numbers.select(*(F.when(~F.isnan(c), F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in numbers.dtypes))
    years = numbers.agg(F.count_distinct("year")).first()[0]
    if years > 1:
        raise ContractError("one season (year) at a time")
    count_ok = lambda c: finite(F.col(c)).isNotNull() & (F.col(c) >= 0) & (F.col(c) % 1 == 0)
    expected = F.col("valid_pixels") / F.nullif(F.col("geometry_pixels"), F.lit(0.0))
    near = F.abs(F.col("clear_fraction") - expected) <= 1e-8 + 1e-5 * F.abs(expected)
    false = F.lit(False)
    require(numbers, [
        *((f"{c} must be a count", ~count_ok(c)) for c in COUNTS),
        ("valid pixels exceed the geometry", (F.col("valid_pixels") > F.col("geometry_pixels")) | (F.col("ndmi_valid_pixels") > F.col("geometry_pixels"))),
        *((f"{c} is infinite", F.coalesce(F.abs(c) == float("inf"), false)) for c in ("ndvi_mean", "ndmi_mean", "clear_fraction")),
        ("clear_fraction lies outside 0 to 1", F.coalesce(~F.col("clear_fraction").between(0, 1), false)),
        ("clear_fraction differs from valid_pixels / geometry_pixels", ~F.coalesce(near, F.col("clear_fraction").isNull() & expected.isNull())),
        ("a mean without pixels", ((F.col("valid_pixels") == 0) & F.col("ndvi_mean").isNotNull()) | ((F.col("ndmi_valid_pixels") == 0) & F.col("ndmi_mean").isNotNull())),
    ])
    daily = collapse(numbers)
    good = daily.where((F.col("valid_pixels") >= minimum_pixels) & (F.col("clear_fraction") >= minimum_clear_fraction) & F.col("ndvi").isNotNull())
    out = features(good).select("field_id", F.date_format(limit, "yyyy-MM-dd'T'HH:mm:ssxxx").alias("cutoff_utc"), F.lit(require_available_at).alias("availability_filter_applied"), "good_observations", "first_date", "last_date", "mean_clear_fraction", "peak_ndvi", "peak_ndvi_date", "latest_ndvi", "auc_ndvi_days", "mean_ndmi", "min_ndmi")
    return daily, out
