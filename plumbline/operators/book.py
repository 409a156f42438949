"""Order books: snapshot contract, top of book, independent diagnostics, final outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.casts import strict_number
from plumbline.operators.contracts import ContractError, reason

#: asset_id, timestamp (epoch ms), min_order_size as text; bids and asks as arrays of (price, size) texts.
SIDE = "array<struct<price:string,size:string>>"


def levels(side: Column) -> Column:
    """(price, size) as doubles; null entries where a level is not numeric."""
    return F.transform(side, lambda x: F.struct(strict_number(x["price"]).alias("price"), strict_number(x["size"]).alias("size")))


def sound(side: Column) -> Column:
    return F.coalesce((F.size(side) > 0) & F.forall(side, lambda x: F.coalesce((x["price"] > 0) & (x["price"] < 1) & (x["size"] > 0), F.lit(False))), F.lit(False))


def depth(side: Column, price: Column) -> Column:
    """Sizes at exactly that price."""
    return F.aggregate(F.filter(side, lambda x: x["price"] == price), F.lit(0.0), lambda s, x: s + x["size"])


def topped(books: DataFrame) -> DataFrame:
    df = books.select("*", levels(F.col("bids").cast(SIDE)).alias("b__"), levels(F.col("asks").cast(SIDE)).alias("a__"), (strict_number(F.col("timestamp").cast("string")) / 1000).alias("stamp__"), strict_number(F.col("min_order_size").cast("string")).alias("minimum__"))
    df = df.select("*", F.array_max(F.transform("b__", lambda x: x["price"])).alias("bid"), F.array_min(F.transform("a__", lambda x: x["price"])).alias("ask"))
    return df.select("*", depth(F.col("b__"), F.col("bid")).alias("bid_size"), depth(F.col("a__"), F.col("ask")).alias("ask_size"))


def _amount(stake: float) -> float:
    if isinstance(stake, bool) or not isinstance(stake, int | float) or not 0 < stake < float("inf"):
        raise ContractError("the diagnostic amount must be positive and finite")
    return float(stake)


def quotes(books: DataFrame, stake: float = 1.0, *, max_age: float = 120, future_tolerance: float = 5) -> DataFrame:
    """books (token, received_at, asset_id, timestamp, min_order_size, bids, asks) with bid, ask, sizes, spread and reason (null: a valid quote)."""
    stake = _amount(stake)
    if not (0 <= max_age < float("inf") and 0 <= future_tolerance < float("inf")):
        raise ContractError("age tolerances must be finite and not negative")
    age = F.col("received_at") - F.col("stamp__")
    rules = [
        ("book token mismatch", ~F.col("asset_id").cast("string").eqNullSafe(F.col("token").cast("string"))),
        ("stale or future book", ~((F.col("stamp__") > 0) & age.between(-future_tolerance, max_age))),
        ("invalid or missing book level", ~(sound(F.col("b__")) & sound(F.col("a__")))),
        ("crossed book", F.col("bid") > F.col("ask")),
        ("invalid minimum size", ~(F.col("minimum__") >= 0)),
        ("insufficient size for diagnostic amount", (F.lit(stake) / F.col("ask") < F.col("minimum__")) | (F.col("ask_size") * F.col("ask") < stake)),
    ]
    df = topped(books).withColumn("reason", reason(rules))
    ok = lambda c: F.when(F.col("reason").isNull(), F.col(c)).alias(c)
    return df.select(*books.columns, ok("bid"), ok("ask"), ok("bid_size"), ok("ask_size"), F.when(F.col("reason").isNull(), F.col("ask") - F.col("bid")).alias("spread"), "reason")


def diagnostics(books: DataFrame, stake: float = 1.0) -> DataFrame:
    """Age, minimum and depth observations that never reject."""
    stake = _amount(stake)
    df = topped(books)
    age = F.col("received_at") - F.col("stamp__")
    error = reason([("missing or invalid asks", ~sound(F.col("a__"))), ("invalid minimum or aggregate size", ~(F.col("minimum__") >= 0))])
    df = df.withColumn("size_diagnostic_error", error)
    ok = lambda x, name: F.when(F.col("size_diagnostic_error").isNull(), x).alias(name)
    ask, size, least = F.col("ask"), F.col("ask_size"), F.col("minimum__")
    return df.select(*books.columns, age.alias("age_seconds"), F.coalesce(age.between(-5, 120), F.lit(False)).alias("fresh"), ok(ask, "best_ask"), ok(size, "best_ask_shares"), ok(least, "minimum_shares"), ok(least * ask, "minimum_notional"),
                     ok(F.lit(stake) / ask >= least, "stake_meets_minimum"), ok(size * ask >= stake, "top_depth_covers_stake"), ok(size >= least, "top_depth_covers_minimum"), "size_diagnostic_error")


def fee_reason(fee: Column) -> Column:
    return reason([("invalid fee rate", ~strict_number(fee.cast("string")).between(0, 10000))])


def strings(x: Column) -> Column:
    """A JSON list, or JSON text of one, as texts; null for anything else."""
    v = F.try_parse_json(x.cast("string"))
    inner = F.when(F.schema_of_variant(v) == "STRING", F.try_parse_json(F.try_variant_get(v, "$", "string"))).otherwise(v)
    return F.try_variant_get(inner, "$", "array<string>")


def outcome(closed: Column, status: Column, tokens: Column, prices: Column, token: Column) -> Column:
    """1 or 0 once a closed, resolved two-token market has prices 0 and 1; null otherwise, never an error."""
    t, p = strings(tokens), F.transform(strings(prices), lambda x: strict_number(x))
    at = F.array_position(t, token)
    fit = closed & (status == "resolved") & (F.size(t) == 2) & (F.size(F.array_distinct(t)) == 2) & (F.size(p) == 2) & (F.array_sort(p) == F.array(F.lit(0.0), F.lit(1.0))) & (at > 0)
    return F.when(fit, F.get(p, (at - 1).cast("int")).cast("int"))


def category_counts(trades: DataFrame, objects: DataFrame) -> DataFrame:
    """Trades by category: ticker to market, market to event; without category (or an empty one) UNKNOWN.

    Trades are counted by ticker before any join, so the joins see a row a ticker.
    """
    counts = trades.groupBy("ticker").agg(F.count("*").alias("n"))
    markets = objects.where("kind = 'markets'").select(F.col("id").alias("ticker"), "event_ticker")
    events = objects.where("kind = 'events'").select(F.col("id").alias("event_ticker"), "category")
    placed = counts.join(markets, "ticker", "left").join(events, "event_ticker", "left")
    return placed.select("ticker", "event_ticker", "n", F.coalesce(F.nullif(F.col("category"), F.lit("")), F.lit("UNKNOWN")).alias("category"))


def pending(mapped: DataFrame, attempts: DataFrame, limit: int = 60) -> DataFrame:
    """Unmapped tickers to ask for next: least recently tried, then most trades, then by name."""
    unknown = mapped.where("category = 'UNKNOWN'").join(attempts, "ticker", "left")
    return unknown.orderBy(F.coalesce("last_attempt", F.lit(0.0)), F.desc("n"), "ticker").limit(limit)
