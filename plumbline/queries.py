"""Registry of the engine's queries and of the SQL that they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import seasons
from plumbline.plans import applied
from plumbline.plans.dialects import DUCK, SPARK
from plumbline.plans.statements import STATEMENTS, Statement

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
Query = Callable[[SparkSession, str], DataFrame]


def declared(statement: Statement) -> Query:
    """A statement over the tables it names, which are bound to the given directory."""
    text = statement(SPARK)

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        words = set(text.replace("(", " ").replace(")", " ").replace(",", " ").split())
        for name in TABLES:
            if name in words:
                spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)
        return spark.sql(text)

    return query


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as observations: user = field, weight = event_id % 5, availability = event_id % 72 hours later."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(
        F.col("user_id").alias("field_id"), "ts", (F.col("ts") + F.make_interval(hours=(F.col("event_id") % 72).cast("int"))).alias("available"), F.to_date("ts").alias("date"),
        F.col("value").alias("ndvi_mean"), (F.col("value") / 2).alias("ndmi_mean"), (F.col("event_id") % 5).cast("double").alias("valid_pixels"), (F.col("event_id") % 3).cast("double").alias("ndmi_valid_pixels"), F.lit(5.0).alias("geometry_pixels"),
    )


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*(F.round(c, 6).alias(c) if t == "double" else F.col(c).cast("string").alias(c) if t == "date" else F.col(c) for c, t in df.dtypes))


def daily_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(seasons.collapse(observations(spark, sf_dir)))


def asof_season_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    cutoff = F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")
    seen = observations(spark, sf_dir).where((F.col("ts") <= cutoff) & (F.col("available") <= cutoff))
    daily = seasons.collapse(seen).withColumn("ndvi", F.round("ndvi", 6)).where("valid_pixels >= 1 AND ndvi IS NOT NULL")
    return _rounded(seasons.features(daily)).withColumn("auc_ndvi_days", F.round("auc_ndvi_days", 4))


COLLAPSE_SQL = """SELECT user_id AS field_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS date, sum(value * (event_id % 5)) / nullif(sum(event_id % 5), 0) AS ndvi, sum(value / 2 * (event_id % 3)) / nullif(sum(event_id % 3), 0) AS ndmi,
CAST(sum(event_id % 5) AS BIGINT) AS valid_pixels, CAST(sum(event_id % 3) AS BIGINT) AS ndmi_valid_pixels, CAST(5 * count(*) AS BIGINT) AS geometry_pixels, sum(event_id % 5) / (5.0 * count(*)) AS clear_fraction, count(*) AS item_count
FROM events {where} GROUP BY 1, 2"""
COLLAPSED = "SELECT * REPLACE (round(ndvi, 6) AS ndvi, round(ndmi, 6) AS ndmi, round(clear_fraction, 6) AS clear_fraction) FROM ({})"
FEATURES_SQL = """WITH d AS (SELECT * REPLACE (round(ndvi, 6) AS ndvi, CAST(date AS DATE) AS date) FROM ({}) WHERE valid_pixels >= 1 AND ndvi IS NOT NULL),
s AS (SELECT *, date_diff('day', lag(date) OVER w, date) * (ndvi + lag(ndvi) OVER w) / 2 AS area FROM d WINDOW w AS (PARTITION BY field_id ORDER BY date))
SELECT field_id, count(*) AS good_observations, CAST(min(date) AS VARCHAR) AS first_date, CAST(max(date) AS VARCHAR) AS last_date, round(avg(clear_fraction), 6) AS mean_clear_fraction, round(max(ndvi), 6) AS peak_ndvi,
CAST(arg_min(date, {{'a': -ndvi, 'b': date}}) AS VARCHAR) AS peak_ndvi_date, round(arg_max(ndvi, date), 6) AS latest_ndvi, round(sum(area), 4) AS auc_ndvi_days, round(avg(ndmi), 6) AS mean_ndmi, round(min(ndmi), 6) AS min_ndmi FROM s GROUP BY field_id"""

QUERIES: dict[str, Query] = {"asof_season_features": asof_season_features, "daily_collapse": daily_collapse} | {name: applied.QUERIES.get(name) or declared(s) for name, s in STATEMENTS.items()}
SQL: dict[str, str] = {
    "asof_season_features": FEATURES_SQL.format(COLLAPSE_SQL.format(where="WHERE ts <= TIMESTAMP '2024-01-20' AND ts + to_hours(event_id % 72) <= TIMESTAMP '2024-01-20'")),
    "daily_collapse": COLLAPSED.format(COLLAPSE_SQL.format(where="")),
} | {name: s(DUCK) for name, s in STATEMENTS.items()}
