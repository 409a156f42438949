"""Trade page contract: pages of JSON text to typed trades, one bad row rejecting its page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.contracts import reason

FUTURE = 300
PAGE_COLUMNS = ("page_id", "condition", "received_at", "body")


def tag(v: Column, path: str) -> Column:
    """JSON type at path: BOOLEAN, BIGINT, DECIMAL.., DOUBLE, STRING, VOID, ARRAY.., OBJECT..; null where absent."""
    return F.schema_of_variant(F.variant_get(v, path, "variant"))


def number(v: Column, path: str) -> Column:
    """A finite number (or text of one); booleans are none."""
    d = F.try_variant_get(v, path, "double")
    return F.when((tag(v, path) != "BOOLEAN") & ~F.isnan(d) & (F.abs(d) < float("inf")), d)


def text(v: Column, path: str) -> Column:
    return F.when(tag(v, path) == "STRING", F.variant_get(v, path, "string"))


def filled(c: Column) -> Column:
    return F.coalesce(c != "", F.lit(False))


def parsed(pages: DataFrame) -> DataFrame:
    """pages with v (the body), rows (array of variants), has_more and next_cursor as they stand."""
    df = pages.withColumn("v", F.try_parse_json("body"))
    v = F.col("v")
    return df.select("*", F.try_variant_get(v, "$.data", "array<variant>").alias("rows"), tag(v, "$.data").startswith("ARRAY").alias("has_data"),
                     F.when(tag(v, "$.pagination.has_more") == "BOOLEAN", F.variant_get(v, "$.pagination.has_more", "boolean")).alias("has_more"),
                     tag(v, "$.pagination.next_cursor").alias("cursor_tag"), text(v, "$.pagination.next_cursor").alias("next_cursor"))


def trades(pages: DataFrame) -> DataFrame:
    """One row a trade: page_id, place, typed fields, raw JSON text, reason (null: sound)."""
    rows = parsed(pages).select("page_id", "condition", "received_at", F.posexplode("rows").alias("place", "row"))
    r = F.col("row")
    typed = rows.select("*", text(r, "$.condition_id").alias("condition_id"), number(r, "$.price").alias("price"), number(r, "$.size").alias("size"), text(r, "$.side").alias("side"), text(r, "$.transaction_hash").alias("transaction_hash"), text(r, "$.token_id").alias("token_id"), number(r, "$.timestamp").alias("ts"))
    rules = [
        ("condition mismatch", F.col("condition_id") != F.col("condition")),
        ("invalid trade price/size", F.col("price").isNull() | F.col("size").isNull() | ~F.col("price").between(0, 1) | (F.col("size") <= 0)),
        ("missing trade identity or side", ~(F.coalesce(F.col("side").isin("BUY", "SELL"), F.lit(False)) & filled(F.col("transaction_hash")) & filled(F.col("token_id")))),
        ("invalid trade time", F.col("ts").isNull() | (F.col("ts") % 1 != 0) | (F.col("ts") <= 0) | (F.col("ts") > F.col("received_at") + FUTURE)),
    ]
    return typed.select("page_id", "place", "condition", "token_id", "transaction_hash", F.when(F.col("ts").isNotNull(), F.col("ts").try_cast("long")).alias("ts"), "price", "size", "side", F.col("row").cast("string").alias("raw"), reason(rules).alias("reason"))


def judged(pages: DataFrame) -> DataFrame:
    """pages with row_count, the page's reason and next_cursor (null unless more follows)."""
    head = parsed(pages)
    n = F.coalesce(F.size("rows"), F.lit(0))
    rules = [
        ("unexpected trade response envelope", ~F.col("has_data")),
        ("invalid pagination", F.col("has_more").isNull()),
        ("invalid pagination cursor type", ~F.coalesce(F.col("cursor_tag").isin("STRING", "VOID"), F.lit(True))),
        ("non-advancing pagination", F.col("has_more") & (~filled(F.col("next_cursor")) | (n <= 0))),
    ]
    of_page = head.select(*PAGE_COLUMNS, F.greatest(n, F.lit(0)).cast("long").alias("row_count"), F.when(F.col("has_more"), F.col("next_cursor")).alias("next_cursor"), reason(rules).alias("page_reason"))
    bad = trades(pages).where("reason IS NOT NULL").groupBy("page_id").agg(F.min_by("reason", "place").alias("row_reason"))
    return of_page.join(bad, "page_id", "left").select(*PAGE_COLUMNS, "row_count", "next_cursor", F.coalesce("row_reason", "page_reason").alias("reason"))
