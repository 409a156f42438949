"""Pages of the second exchange: events, markets and trades as JSON text, one bad row rejecting its page."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.casts import zoned_timestamp
from plumbline.operators.contracts import reason
from plumbline.operators.trades import filled, tag, text

#: Fixed names of the interface: what identifies a row of each kind, amounts with their bounds, fields that an index keeps.
IDENTITY = {"events": "event_ticker", "markets": "ticker", "trades": "trade_id"}
AMOUNTS = ("yes_price_dollars", "no_price_dollars", "count_fp")
#: page_id, kind, body (JSON text), cursor (as asked for), raw_file
FETCHED = "page_id long, kind string, body string, cursor string, raw_file string"


def _by_kind(of) -> Column:  # noqa: ANN001
    """of(kind) for the row's own kind; null for an unknown one."""
    return reduce(lambda out, k: F.when(F.col("kind") == k, of(k)).otherwise(out), IDENTITY, F.lit(None))


def parsed(pages: DataFrame) -> DataFrame:
    df = pages.withColumn("v", F.try_parse_json("body"))
    v = F.col("v")
    rows = _by_kind(lambda k: F.try_variant_get(v, f"$.{k}", "array<variant>"))
    listed = _by_kind(lambda k: F.coalesce(tag(v, f"$.{k}").startswith("ARRAY"), F.lit(False)))
    return df.select("*", rows.alias("rows"), F.coalesce(listed, F.lit(False)).alias("listed"), F.coalesce(tag(v, "$.cursor"), F.lit("VOID")).alias("cursor_tag"), F.nullif(text(v, "$.cursor"), F.lit("")).alias("next_cursor"))


def amount(v: Column, name: str) -> Column:
    """An exact decimal from a number or text of one."""
    plain = F.when(tag(v, f"$.{name}") != "BOOLEAN", F.trim(F.try_variant_get(v, f"$.{name}", "string")))
    return plain.try_cast("decimal(38,18)")


def rows(pages: DataFrame) -> DataFrame:
    """page_id, kind, raw_file, place, id, ticker, event_ticker, created_time, row (JSON text), reason (null: sound)."""
    each = parsed(pages).select("page_id", "kind", "raw_file", F.posexplode("rows").alias("place", "row"))
    r = F.col("row")
    trade = F.col("kind") == "trades"
    identity = _by_kind(lambda k: text(r, f"$.{IDENTITY[k]}"))
    values = [amount(r, name) for name in AMOUNTS]
    sound = values[0].between(0, 1) & values[1].between(0, 1) & (values[2] > 0)
    rules = [
        ("missing identity", ~filled(identity)),
        ("missing ticker", trade & ~filled(text(r, "$.ticker"))),
        ("invalid trade time", trade & zoned_timestamp(text(r, "$.created_time")).isNull()),
        ("invalid trade value", trade & ~F.coalesce(sound, F.lit(False))),
    ]
    named = [text(r, f"$.{c}").alias(c) for c in ("ticker", "event_ticker", "created_time")]
    return each.select("page_id", "kind", "raw_file", "place", identity.alias("id"), *named, r.cast("string").alias("row"), reason(rules).alias("reason"))


def judged(pages: DataFrame) -> DataFrame:
    """page_id, row_count, next_cursor, reason: the envelope's first fault, else that of the first bad row."""
    head = parsed(pages)
    n = F.coalesce(F.size("rows"), F.lit(0))
    rules = [
        ("invalid page envelope", ~F.col("listed")),
        ("invalid cursor type", ~F.col("cursor_tag").isin("STRING", "VOID")),
        ("non-advancing pagination", F.col("next_cursor").isNotNull() & (F.col("next_cursor").eqNullSafe(F.col("cursor")) | (n <= 0))),
    ]
    of_page = head.select("page_id", F.greatest(n, F.lit(0)).alias("row_count"), "next_cursor", reason(rules).alias("page_reason"))
    bad = rows(pages).where("reason IS NOT NULL").groupBy("page_id").agg(F.min_by("reason", "place").alias("row_reason"))
    return of_page.join(bad, "page_id", "left").select("page_id", "row_count", "next_cursor", F.coalesce("page_reason", "row_reason").alias("reason"))
