"""The trade ledger: versioned tables with one pointer.

Tables: markets (dimension and checkpoint), rows (first-writer fingerprint index), pages (commit log),
cursor_history (cursors of the traversal under way).  A failed commit leaves the pointer where it was.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from plumbline.operators import trades
from plumbline.operators.contracts import ContractError, first_writer
from plumbline.sources.evidence import Archive, canonical, sha256
from plumbline.sources.store import Store

SCHEMAS = {
    "markets": "condition string, event_id string, source_group string, closed boolean, metadata string, discovered double, last_attempt double, cursor string, exhausted boolean, closure_refresh string",
    "rows": "fingerprint string, condition string, ts long, raw_file string",
    "pages": "id long, condition string, request_cursor string, next_cursor string, raw_file string, row_count long",
    "cursor_history": "condition string, cursor string",
}
REFRESH = ("none", "pending", "active")


def registered(stored_closed: Column, incoming_closed: Column, refresh: Column) -> Column:
    """closure_refresh after a registration."""
    return F.when(stored_closed.isNull(), "none").when(~incoming_closed, "none").when(~stored_closed, "pending").otherwise(refresh)


def started(closed: Column, refresh: Column, cursor: Column) -> Column:
    """closure_refresh as a traversal starts."""
    return F.when(closed & (refresh == "pending") & cursor.isNull(), "active").otherwise(refresh)


def committed(next_cursor: Column, refresh: Column) -> Column:
    """closure_refresh after a page commit."""
    return F.when(next_cursor.isNull() & (refresh == "active"), "none").otherwise(refresh)


class Ledger(Store):
    schemas = SCHEMAS

    def read(self, name: str) -> DataFrame:
        df = super().read(name)
        if name == "markets" and "closure_refresh" not in df.columns:
            # an older ledger can't prove that a closed market was exhausted after its closure
            df = df.withColumn("closure_refresh", F.when(F.col("closed"), REFRESH[1]).otherwise(REFRESH[0]))
        return df

    def register(self, manifest: list[dict], now: float) -> None:
        """Conditional upsert: what collection has reached stays, the refresh state follows the closed flag."""
        if not isinstance(manifest, list) or not 1 <= len(manifest) <= 100:
            raise ContractError("a manifest names 1 to 100 markets")
        for m in manifest:
            if not isinstance(m, dict) or any(not isinstance(m.get(k), str) or not m[k].strip() for k in ("condition", "event_id", "source_group")) or type(m.get("closed")) is not bool:
                raise ContractError("a manifest entry lacks its names or closed state")
        if len({m["condition"] for m in manifest}) != len(manifest):
            raise ContractError("a manifest repeats a market")
        new = self.spark.createDataFrame([(m["condition"], m["event_id"], m["source_group"], m["closed"], json.dumps(m, sort_keys=True)) for m in manifest], "condition string, event_id string, source_group string, closed boolean, metadata string").alias("i")
        s = self.read("markets").alias("s")
        i = lambda c: F.coalesce(F.col(f"i.{c}"), F.col(f"s.{c}")).alias(c)
        refresh = F.when(F.col("i.condition").isNull(), F.col("s.closure_refresh")).otherwise(registered(F.col("s.closed"), F.col("i.closed"), F.col("s.closure_refresh")))
        merged = s.join(new, F.col("s.condition") == F.col("i.condition"), "full_outer").select(
            i("condition"), i("event_id"), i("source_group"), i("closed"), i("metadata"), F.coalesce("s.discovered", F.lit(float(now))).alias("discovered"), F.coalesce("s.last_attempt", F.lit(0.0)).alias("last_attempt"),
            F.col("s.cursor").alias("cursor"), F.coalesce("s.exhausted", F.lit(False)).alias("exhausted"), refresh.alias("closure_refresh"),
        )
        self.commit(markets=merged)

    def due(self) -> list[dict]:
        """Markets to collect: all but the closed, exhausted and not to be refreshed."""
        return [r.asDict() for r in self.read("markets").where("NOT (closed AND exhausted AND closure_refresh = 'none')").orderBy("condition").collect()]

    def append(self, fetched: DataFrame) -> dict[str, dict]:
        """Validates fetched pages (page_id, condition, received_at, body, request_cursor, raw_file) and commits what is good, in one version.

        A page counts only while its chain holds: all earlier ones of its market are good and its next cursor is new.
        Returns counts and the first error by market.
        """
        order = Window.partitionBy("condition").orderBy("page_id")
        history = self.read("cursor_history").groupBy("condition").agg(F.collect_set("cursor").alias("seen"))
        pages = trades.judged(fetched).join(fetched.select("page_id", "request_cursor", "raw_file"), "page_id").join(history, "condition", "left")
        before = order.rowsBetween(Window.unboundedPreceding, -1)
        seen = F.concat(F.coalesce("seen", F.array().cast("array<string>")), F.coalesce(F.collect_list("next_cursor").over(before), F.array().cast("array<string>")), F.array_compact(F.array(F.first("request_cursor").over(order))))
        pages = pages.withColumn("reason", F.when(F.col("reason").isNull() & F.array_contains(seen, F.col("next_cursor")), "repeated trade cursor").otherwise(F.col("reason")))
        pages = pages.withColumn("sound", F.coalesce(F.every(F.col("reason").isNull()).over(order.rowsBetween(Window.unboundedPreceding, 0)), F.lit(True)))
        good = pages.where("sound")
        rows = trades.trades(fetched).join(good.select("page_id", "raw_file"), "page_id")
        prints = rows.select(fingerprint_udf()("raw").alias("fingerprint"), "condition", "ts", "raw_file", "page_id", "place")
        kept, first_id = self.read("rows"), (self.read("pages").agg(F.max("id")).first()[0] or 0)
        new = first_writer(prints.join(kept.select("fingerprint"), "fingerprint", "left_anti"), ["fingerprint"], [F.col("page_id"), F.col("place")]).select("fingerprint", "condition", "ts", "raw_file", "page_id")
        log = good.select((F.col("page_id") + first_id + 1).alias("id"), "condition", "request_cursor", "next_cursor", "raw_file", "row_count")
        last = good.groupBy("condition").agg(F.max_by(F.struct("next_cursor"), "page_id")["next_cursor"].alias("next"), F.max("page_id").alias("last_page"))
        m = self.read("markets").join(last, "condition", "left")
        done = F.col("last_page").isNotNull()
        ended = F.col("next").isNull()
        markets = m.select("condition", "event_id", "source_group", "closed", "metadata", "discovered", "last_attempt", F.when(done, F.col("next")).otherwise(F.col("cursor")).alias("cursor"), F.when(done, ended).otherwise(F.col("exhausted")).alias("exhausted"), F.when(done, committed(F.col("next"), F.col("closure_refresh"))).otherwise(F.col("closure_refresh")).alias("closure_refresh"))
        fresh = good.where("next_cursor IS NOT NULL").select("condition", F.col("next_cursor").alias("cursor"))
        open_ = last.where("next IS NOT NULL").select("condition")
        closed_ = last.where("next IS NULL").select("condition")
        cursors = self.read("cursor_history").join(closed_, "condition", "left_anti").union(fresh.join(open_, "condition", "left_semi")).distinct()
        counts = pages.groupBy("condition").agg(F.count_if("sound").alias("pages"), F.sum(F.when(F.col("sound"), F.col("row_count")).otherwise(0)).alias("rows"), F.min_by("reason", F.when(F.col("reason").isNotNull(), F.col("page_id"))).alias("error"), (F.count_if(F.col("sound") & F.col("next_cursor").isNull()) > 0).alias("endpoint_exhausted"))
        counts = counts.join(new.groupBy("condition").agg(F.count("*").alias("inserted")), "condition", "left")
        out = {r["condition"]: {**r.asDict(), "identical_rows": r["rows"] - (r["inserted"] or 0)} for r in counts.collect()}
        self.commit({"rows": new.drop("page_id"), "pages": log}, markets=markets, cursor_history=cursors)
        return out


def fingerprint_udf() -> Callable[..., Column]:
    """SHA-256 of a row's canonical JSON, batch-wise."""
    @pandas_udf("string")
    def fingerprint(raw: pd.Series) -> pd.Series:
        return raw.map(lambda x: sha256(canonical(json.loads(x))))

    return fingerprint


def pull(archive: Archive, base: str, market: dict, max_pages: int, start: int) -> tuple[list[tuple], str | None]:
    """Raw pages of one market's chain as far as cursors lead; the contract judges them afterwards."""
    cursor, out, error = market["cursor"], [], None
    try:
        for k in range(max_pages):
            params = {"condition": market["condition"], "limit": 500} | ({"cursor": cursor} if cursor else {})
            payload, received, raw = archive.fetch(base, "/v2/trades", params)
            out.append((start + k, market["condition"], float(received), json.dumps(payload), cursor, raw))
            paging = payload.get("pagination") if isinstance(payload, dict) else None
            more = isinstance(paging, dict) and paging.get("has_more") is True and isinstance(paging.get("next_cursor"), str) and paging["next_cursor"]
            if not more or any(p[4] == paging["next_cursor"] for p in out):
                break
            cursor = paging["next_cursor"]
    except Exception as e:  # noqa: BLE001  a market's failure is reported and leaves the others alone
        error = str(e)
    return out, error


def collect(ledger: Ledger, archive: Archive, base: str, manifest: list[dict], *, max_pages: int = 2) -> dict:
    """One collection run: register, pull evidence, one validating commit, report."""
    if type(max_pages) is not int or not 1 <= max_pages <= 10:
        raise ContractError("max_pages must be 1 to 10")
    ledger.register(manifest, archive.clock())
    wanted = {m["condition"] for m in manifest}
    due = [m for m in ledger.due() if m["condition"] in wanted]
    names = [m["condition"] for m in due]
    touched = F.col("condition").isin(names) if names else F.lit(False)
    ledger.commit(markets=ledger.read("markets").withColumn("last_attempt", F.when(touched, F.lit(float(archive.clock()))).otherwise(F.col("last_attempt"))).withColumn("closure_refresh", F.when(touched, started(F.col("closed"), F.col("closure_refresh"), F.col("cursor"))).otherwise(F.col("closure_refresh"))))
    pages, errors = [], []
    for m in due:
        got, error = pull(archive, base, m, max_pages, len(pages))
        pages += got
        if error:
            errors.append({"stage": "trades", "condition": m["condition"], "error": error})
    counts = {}
    if pages:
        counts = ledger.append(ledger.spark.createDataFrame(pages, "page_id long, condition string, received_at double, body string, request_cursor string, raw_file string"))
        errors += [{"stage": "trades", "condition": c, "error": r["error"]} for c, r in counts.items() if r["error"]]
    index = ledger.read("rows").agg(F.count("*").alias("fingerprints"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")).first().asDict()
    inventory = [r.asDict() for r in ledger.read("markets").select("condition", "event_id", "source_group", "closed", "cursor", "exhausted", "closure_refresh").orderBy("condition").collect()]
    return {"mode": "RESEARCH_ONLY", "source_label": archive.source_label, "trades": counts, "errors": errors, "inventory": inventory, "trade_index": index, "validated_pages": ledger.read("pages").count(),
            "files": archive.files, "retries": archive.retries, "written_bytes": archive.written, "collection_complete_without_errors": not errors}
