"""The second exchange as a source: pages with a frozen upper bound, head passes, and metadata for what has none.

A backfill reads a path's checkpoint and moves it; its upper bound stays until the path is exhausted, then a new cycle
begins.  A head pass asks for the newest page and leaves the checkpoint alone; both meet in the same first-writer index.
"""

from __future__ import annotations

import json
import urllib.parse
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators import book
from plumbline.operators.contracts import ContractError, first_writer, last_writer
from plumbline.operators.exchange import FETCHED, IDENTITY, judged, rows
from plumbline.sources.evidence import Archive, HttpStatus
from plumbline.sources.store import Store

#: Fixed values of the interface: rows of a page by kind, fields that the index keeps of an object.
PAGE_ROWS = {"events": 100, "markets": 500, "trades": 500}
FIELDS = ("ticker", "event_ticker", "series_ticker", "category", "title", "status", "result", "open_time", "close_time", "settlement_ts")
#: Objects asked for in one run, and its seconds.
OBJECTS, SECONDS = 60, 350


class Exchange(Store):
    schemas = {
        "checkpoints": "path string, cursor string, upper_ts long, cycles long",
        "page_cursors": "path string, cursor string",
        "trades": "ticker string, trade_id string, created_time string, raw_file string",
        "objects": "kind string, id string, metadata string, raw_file string",
        "metadata_attempts": "ticker string, last_attempt double",
    }


def kept_fields(row: dict[str, Any]) -> str:
    """Those of FIELDS that the row has, as JSON; an absent one stays absent, a null stays null."""
    return json.dumps({k: row[k] for k in FIELDS if k in row})


def identified(kind: str, key: str, row: Any) -> tuple[str, str, str]:
    """(kind, id, metadata) of an object that was asked for by its id."""
    if not isinstance(row, dict) or row.get(IDENTITY[kind]) != key:
        raise ContractError("the answer is another object than was asked for")
    return kind, key, kept_fields(row)


def upserted(old: DataFrame, new: DataFrame) -> DataFrame:
    """INSERT OR REPLACE: the newer row of a kind and id."""
    both = old.withColumn("age", F.lit(0)).unionByName(new.withColumn("age", F.lit(1)))
    return last_writer(both, ["kind", "id"], [F.col("age"), F.col("metadata")]).drop("age")


def page(store: Exchange, archive: Archive, base: str, path: str, kind: str, *, head: bool = False) -> dict[str, Any]:
    """One page: evidence, contract, one commit."""
    if kind not in IDENTITY:
        raise ContractError("pages hold events, markets or trades")
    now, at = int(archive.clock()), F.col("path") == path
    held = store.read("checkpoints").where(at).first()
    cursor, upper, cycles = (held.cursor, held.upper_ts, held.cycles) if held else (None, now, 0)
    asked = None if head else cursor
    params: dict[str, Any] = {"limit": PAGE_ROWS[kind]} | ({"with_nested_markets": "false"} if kind == "events" else {}) | ({"max_ts": now if head else upper} if kind == "trades" else {}) | ({"cursor": asked} if asked else {})
    payload, _, raw = archive.fetch(base, path, params)
    fetched = store.spark.createDataFrame([(0, kind, json.dumps(payload), asked, raw)], FETCHED)
    verdict = judged(fetched).first()
    if verdict.reason:
        raise ContractError(verdict.reason)
    following, seen = verdict.next_cursor, store.read("page_cursors")
    if not head and following and not seen.where(at & (F.col("cursor") == following)).isEmpty():
        raise ContractError("the cursors run in a circle")
    found, inserted = rows(fetched), 0
    added, replaced = {}, {}
    if kind == "trades":
        new = found.select("ticker", F.col("id").alias("trade_id"), "created_time", "raw_file", "place").join(store.read("trades").select("ticker", "trade_id"), ["ticker", "trade_id"], "left_anti")
        new = first_writer(new, ["ticker", "trade_id"], [F.col("place")]).drop("place").select("ticker", "trade_id", "created_time", "raw_file").cache()
        inserted = new.count()
        added["trades"] = new
    else:
        objects = [(*identified(kind, row.get(IDENTITY[kind]), row), raw) for row in payload[kind]]
        replaced["objects"] = upserted(store.read("objects"), store.spark.createDataFrame(objects, Exchange.schemas["objects"]).dropDuplicates(["kind", "id"]))
    if not head:
        state = store.spark.createDataFrame([(path, following, upper if following else now, cycles + (following is None))], Exchange.schemas["checkpoints"])
        replaced["checkpoints"] = store.read("checkpoints").where(~at).unionByName(state)
        replaced["page_cursors"] = seen.unionByName(store.spark.createDataFrame([(path, following)], Exchange.schemas["page_cursors"])) if following else seen.where(~at)
    store.commit(added, **replaced)
    return {"path": path, "head": head, "rows": verdict.row_count, "inserted_trades": inserted, "cursor_pending": following is not None, "endpoint_exhausted": following is None}


def mapped(store: Exchange) -> DataFrame:
    """ticker, event_ticker, n, category of the indexed trades; UNKNOWN where an object or its category is missing."""
    told = F.from_json("metadata", "event_ticker string, category string")
    objects = store.read("objects").select("kind", "id", told["event_ticker"].alias("event_ticker"), told["category"].alias("category"))
    return book.category_counts(store.read("trades"), objects)


def hydrate(store: Exchange, archive: Archive, base: str, *, limit: int = OBJECTS) -> dict[str, Any]:
    """Asks for the metadata of tickers without category, at most `limit` of them and until SECONDS are spent; reports the mapping."""
    found: dict[tuple[str, str], tuple[str, str]] = {}
    tried: list[tuple[str, float]] = []
    failures: list[dict[str, str]] = []
    events: dict[str, str] = {}

    def step(ticker: str, do) -> bool:  # noqa: ANN001
        """One request; False once the time is spent.  A ticker's failure leaves the others alone."""
        if archive.clock() - archive.started > SECONDS:
            return False
        try:
            do()
        except Exception as e:  # noqa: BLE001
            failures.append({"ticker": ticker, "error": str(e)})
        return True

    def market(ticker: str, event: str | None) -> None:
        event = event or _asked(archive, base, "markets", ticker, found).get("event_ticker")
        if not event:
            raise ContractError("a market without an event")
        events[ticker] = event

    for r in book.pending(mapped(store), store.read("metadata_attempts"), limit).collect():
        at = float(archive.clock())
        if not step(r.ticker, lambda: market(r.ticker, r.event_ticker)):  # noqa: B023
            break
        tried.append((r.ticker, at))
    told = F.from_json("metadata", "category string")["category"]
    named = store.spark.createDataFrame([(e,) for e in set(events.values())], "id string")
    known = {r.id for r in store.read("objects").where("kind = 'events'").where(told != "").join(F.broadcast(named), "id", "left_semi").collect()}
    for ticker, event in events.items():
        if event not in known and ("events", event) not in found and not step(ticker, lambda: _asked(archive, base, "events", event, found)):  # noqa: B023
            break
    attempts = store.read("metadata_attempts").withColumn("age", F.lit(0)).unionByName(store.spark.createDataFrame([(t, at, 1) for t, at in tried], "ticker string, last_attempt double, age int"))
    new = store.spark.createDataFrame([(*k, *v) for k, v in found.items()], Exchange.schemas["objects"])
    store.commit(objects=upserted(store.read("objects"), new), metadata_attempts=last_writer(attempts, ["ticker"], [F.col("age")]).drop("age"))
    now = mapped(store)
    unknown = now.agg(F.count_if(F.col("category") == "UNKNOWN").alias("pending"), F.sum(F.when(F.col("category") == "UNKNOWN", F.col("n")).otherwise(0)).alias("trades")).first()
    counts = {r.category: r.n for r in now.groupBy("category").agg(F.sum("n").alias("n")).collect()}
    return {"category_trade_counts": counts, "pending_tickers": unknown.pending, "unmapped_trades": unknown.trades or 0, "failures": failures, "unknown_rows_quarantined": True}


def _asked(archive: Archive, base: str, kind: str, key: str, found: dict) -> dict[str, Any]:
    """One object by its id; a market that is not listed any more is asked for in the historical part."""
    name = urllib.parse.quote(key, safe="")
    try:
        payload, _, raw = archive.fetch(base, f"/{kind}/{name}", {"with_nested_markets": "false"} if kind == "events" else {})
    except HttpStatus as e:
        if e.code != 404 or kind != "markets":
            raise
        payload, _, raw = archive.fetch(base, f"/historical/{kind}/{name}", {})
    row = payload[kind.removesuffix("s")]
    found[kind, key] = (identified(kind, key, row)[2], raw)
    return row
