"""Registered queries that run the library's operators; their SQL in `statements` is written apart from them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import book, contracts, grids, seasons
from plumbline.sources import ledger
from plumbline.streaming import pages

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _season(daily: DataFrame) -> DataFrame:
    """features() of (user_id, day, v)."""
    none = F.lit(None).cast("double")
    return seasons.features(daily.select(F.col("user_id").alias("field_id"), F.col("day").alias("date"), F.col("v").alias("ndvi"), none.alias("ndmi"), none.alias("clear_fraction")))


def peak_first_tie(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = table(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.round(F.avg("value") / 10).alias("v"))
    return _season(daily).select(F.col("field_id").alias("user_id"), F.col("peak_ndvi").alias("peak"), F.col("peak_ndvi_date").cast("string").alias("peak_day"))


def trapezoid_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    weight = F.col("event_id") % 5
    daily = table(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.round(seasons.weighted_mean(F.col("value"), weight.cast("double")), 6).alias("v")).where("v IS NOT NULL")
    return _season(daily).select(F.col("field_id").alias("user_id"), F.col("good_observations").alias("points"), F.round("auc_ndvi_days", 4).alias("auc"))


def contract_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    no = F.lit(False)
    rules = [
        ("missing", F.col("value").isNull()), ("not positive", F.coalesce(F.col("value") <= 0.5, no)), ("too large", F.coalesce(F.col("value") > 300, no)),
        ("unknown type", F.coalesce(~F.col("event_type").isin("view", "click", "purchase"), no)), ("identity", F.coalesce(F.col("user_id") % 10 == 0, no)),
    ]
    return table(spark, sf_dir, "events").groupBy(contracts.reason(rules).alias("reason")).agg(F.count("*").alias("n"))


def page_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page counts all its rows; it is accepted if good_groups leaves it."""
    rows = table(spark, sf_dir, "events").withColumn("page", F.floor(F.col("event_id") / 500))
    ok = F.col("value") > 0.1
    per = rows.groupBy("page").agg(F.count("*").alias("row_count"), F.count_if(F.col("value") <= 0.1).alias("bad_rows"))
    good = contracts.good_groups(rows, ["page"], F.coalesce(ok, F.lit(True))).select("page").distinct().withColumn("accepted", F.lit(True))
    return per.join(good, "page", "left").select("page", "row_count", "bad_rows", F.coalesce("accepted", F.lit(False)).alias("accepted"))


def key_first_writer(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = [F.col(c) for c in "l_partkey l_suppkey l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate".split()]
    first = contracts.first_writer(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], order)
    return first.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")


def key_last_writer(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = contracts.last_writer(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value", "ts"), ["user_id"], [F.col("ts"), F.col("event_id")])
    return last.select("user_id", F.col("event_id").alias("last_event"), F.col("event_type").alias("last_type"), F.col("value").alias("last_value"))


def conditional_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    priority = F.col("o_orderpriority")
    refresh = F.when(priority == "1-URGENT", ledger.REFRESH[1]).when(priority == "2-HIGH", ledger.REFRESH[2]).otherwise(ledger.REFRESH[0])
    stored = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), (F.col("o_orderstatus") == "F").alias("was"), refresh.alias("refresh"))
    incoming = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg((F.max("l_linestatus") == "F").alias("now"))
    both = stored.join(incoming, "k", "full")
    state = F.when(F.col("now").isNull(), F.col("refresh")).otherwise(ledger.registered(F.col("was"), F.col("now"), F.col("refresh")))
    return both.select("k", F.coalesce("now", "was").alias("closed"), state.alias("refresh"), F.col("was").isNull().alias("discovered"))


def category_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    trades = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("ticker"))
    none = F.lit(None).cast("string")
    markets = labels.select(F.lit("markets").alias("kind"), F.col("doc_id").cast("string").alias("id"), F.concat(F.lit("q"), "quality").alias("event_ticker"), none.alias("category"))
    events = labels.select(F.lit("events").alias("kind"), F.concat(F.lit("q"), "quality").alias("id"), none.alias("event_ticker"), F.col("quality").cast("string").alias("category")).distinct()
    return book.category_counts(trades, markets.union(events)).groupBy("category").agg(F.sum("n").alias("n"))


def pending_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    mapped = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ticker"), F.col("n_chars").alias("n"), F.lit("UNKNOWN").alias("category"))
    attempts = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("ticker"), F.col("quality").alias("last_attempt"))
    return book.pending(mapped, attempts, 60).select(F.col("ticker").alias("doc_id"), F.coalesce("last_attempt", F.lit(0)).alias("last_attempt"), F.col("n").alias("n_chars"))


def _books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A book a part: returned lines are bids, new ones asks; levels of one price are summed before they come together."""
    bid = F.col("l_returnflag") == "R"
    price = F.round(F.col("l_extendedprice") / F.col("l_quantity") * F.when(bid, 0.03).otherwise(1) / 1000)
    level = table(spark, sf_dir, "lineitem").where(F.col("l_returnflag").isin("R", "N")).groupBy(F.col("l_partkey").alias("part"), bid.alias("bid"), price.alias("price")).agg(F.sum("l_quantity").alias("size"))
    text = F.struct(F.col("price").cast("string").alias("price"), F.col("size").cast("string").alias("size"))
    return level.groupBy("part").agg(F.collect_list(F.when(F.col("bid"), text)).alias("bids"), F.collect_list(F.when(~F.col("bid"), text)).alias("asks")).select("part", "bids", "asks", F.lit("0").alias("timestamp"), F.lit("5").alias("min_order_size"))


def top_of_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = book.topped(_books(spark, sf_dir))
    sized: Callable[[str], Column] = lambda c: F.when(F.col(c).isNotNull(), F.col(f"{c}_size")).alias(f"{c}_size")
    return top.select("part", "bid", "ask", sized("bid"), sized("ask"), (F.col("ask") - F.col("bid")).alias("spread"), (F.col("bid") > F.col("ask")).alias("crossed"))


def final_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    tokens = F.to_json(F.array((cust % 5).cast("string"), (key % 5).cast("string")))
    prices = F.to_json(F.array((key % 2).cast("int"), ((key + cust % 3) % 2).cast("int")))
    status = F.when(F.col("o_orderpriority") != "5-LOW", "resolved").otherwise("open")
    return table(spark, sf_dir, "orders").select("o_orderkey", book.outcome(F.col("o_orderstatus") == "F", status, tokens, prices, (cust % 4).cast("string")).alias("outcome"))


def _meta(scale: float, offset: float) -> Column:
    return F.struct(F.lit(scale).alias("scale"), F.lit(offset).alias("offset"), F.lit(None).cast("string").alias("nodata"), F.lit(True).alias("one"))


def grid_index_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vector's halves as red and near-infrared pixels, none of them masked."""
    pixels = F.col("embedding").cast("array<double>")
    df = table(spark, sf_dir, "embeddings").select("vec_id", *(grids.scaled(F.array(F.slice(pixels, at, 32)), _meta(1.0, 0.0)).alias(name) for at, name in ((1, "red"), (33, "nir"))))
    df = df.select("vec_id", grids.ratio(F.col("nir"), F.col("red"), F.transform("red", lambda x: F.lit(True))).alias("x"))
    mean, median, valid = grids.mean_median_count(F.col("x"))
    return df.select("vec_id", valid.alias("valid"), F.round(mean, 6).alias("mean"), F.round(median, 6).alias("median"))


def band_scaling(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "embeddings").select("vec_id", grids.scaled(F.array(F.col("embedding").cast("array<double>")), _meta(2.0, 0.1)).alias("x"))
    kept = F.filter("x", lambda v: v.isNotNull())
    return df.select("vec_id", F.size(kept).cast("long").alias("valid"), F.round(F.aggregate(kept, F.lit(0.0), lambda a, b: a + b), 6).alias("total"))


def late_availability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One pass for all cutoffs."""
    known = F.col("ts") + F.make_interval(hours=(F.col("event_id") % 72).cast("int"))
    seen = pages.visible(table(spark, sf_dir, "events").withColumn("available_at", known), ["2024-01-05", "2024-01-15", "2024-01-25"])
    return seen.select("cutoff", "happened", F.col("known").alias("visible"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        peak_first_tie, trapezoid_auc, contract_reasons, page_gate, key_first_writer, key_last_writer, conditional_upsert, category_mapping, pending_topk, top_of_book, final_outcome,
        grid_index_stats, band_scaling, late_availability,
    )
}
