"""Reconciliation of the ledger with the raw evidence: a union of problem frames, each from joins and windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.operators import trades
from plumbline.sources.evidence import envelopes
from plumbline.sources.ledger import Ledger, fingerprint_udf


def problems(spark: SparkSession, root: str, ledger: Ledger) -> DataFrame:
    """kind, subject, error."""
    raw = envelopes(spark, root)
    rows, pages, markets, history = (ledger.read(n) for n in ("rows", "pages", "markets", "cursor_history"))
    say = lambda df, kind, subject, error: df.select(F.lit(kind).alias("kind"), F.col(subject).cast("string").alias("subject"), F.lit(error).alias("error") if isinstance(error, str) else error.alias("error"))
    out = [say(raw.where("error IS NOT NULL"), "file", "name", F.col("error"))]
    good = raw.where("error IS NULL")
    paged = pages.join(good.withColumnRenamed("name", "raw_file").withColumnRenamed("condition", "asked"), "raw_file", "left")
    out.append(say(paged.where("body IS NULL"), "page", "id", "committed page raw response missing or invalid"))
    asked = paged.where("body IS NOT NULL").select(F.col("id").alias("page_id"), "condition", "received_at", "body", "request_cursor", F.col("next_cursor").alias("stored_next"), F.col("row_count").alias("stored_count"), "asked", "cursor")
    judged = trades.judged(asked.select(*trades.PAGE_COLUMNS)).join(asked.select("page_id", "request_cursor", "stored_next", "stored_count", "asked", "cursor"), "page_id")
    differs = F.col("reason").isNotNull() | ~F.col("next_cursor").eqNullSafe(F.col("stored_next")) | (F.col("row_count") != F.col("stored_count")) | ~F.col("cursor").eqNullSafe(F.col("request_cursor")) | ~F.col("asked").eqNullSafe(F.col("condition"))
    out.append(say(judged.where(differs), "page", "page_id", "committed page differs from raw evidence"))
    found = trades.trades(asked.select(*trades.PAGE_COLUMNS)).where("reason IS NULL").select(fingerprint_udf()("raw").alias("fingerprint"), "condition", "ts").distinct()
    held = rows.select("fingerprint", "condition", "ts")
    out.append(say(held.subtract(found), "row", "fingerprint", "indexed row not present in committed pages"))
    out.append(say(found.subtract(held), "row", "fingerprint", "committed row is not indexed"))
    for name, df in (("row", rows), ("page", pages), ("cursor", history)):
        out.append(say(df.join(markets.select("condition"), "condition", "left_anti"), name, "condition", "no such market"))
    order = Window.partitionBy("condition").orderBy("id")
    chain = pages.withColumn("expected", F.lag("next_cursor").over(order)).withColumn("ended", F.coalesce(F.lag(F.col("next_cursor").isNull().cast("int")).over(order), F.lit(0)))
    out.append(say(chain.where(~F.col("request_cursor").eqNullSafe(F.col("expected"))), "page", "id", "committed cursor chain is inconsistent"))
    traversal = chain.withColumn("traversal", F.sum("ended").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    again = traversal.where("next_cursor IS NOT NULL").groupBy("condition", "traversal", "next_cursor").count().where("count > 1")
    out.append(say(again, "page", "condition", "cursor repeats in a traversal"))
    last = pages.groupBy("condition").agg(F.max("id").alias("last"), F.max_by(F.struct("next_cursor"), "id")["next_cursor"].alias("next"))
    state = markets.join(last, "condition", "left")
    out.append(say(state.where("last IS NULL AND (cursor IS NOT NULL OR exhausted)"), "market", "condition", "checkpoint has no committed page evidence"))
    out.append(say(state.where(F.col("last").isNotNull() & (~F.col("cursor").eqNullSafe(F.col("next")) | (F.col("exhausted") != F.col("next").isNull()))), "market", "condition", "checkpoint differs from latest committed page"))
    latest = traversal.join(traversal.groupBy("condition").agg(F.max("traversal").alias("traversal"), F.max_by(F.struct("next_cursor"), "id")["next_cursor"].alias("tip")), ["condition", "traversal"])
    want = latest.where("tip IS NOT NULL AND next_cursor IS NOT NULL").select("condition", F.col("next_cursor").alias("cursor")).distinct()
    for a, b in ((want, history), (history, want)):
        out.append(say(a.select("condition", "cursor").subtract(b.select("condition", "cursor")), "market", "condition", "cursor history inconsistent with checkpoint"))
    whole = out[0]
    for df in out[1:]:
        whole = whole.unionByName(df)
    return whole


def verify(spark: SparkSession, root: str, ledger: Ledger) -> dict:
    """passed, counts and all problems; an archive without files, rows or pages does not pass."""
    from pathlib import Path

    files = len(list((Path(root.removeprefix("file://")) / "raw").glob("*.json.gz")))
    n_rows, n_pages = ledger.read("rows").count(), ledger.read("pages").count()
    found = [r.asDict() for r in problems(spark, root, ledger).orderBy("kind", "subject", "error").collect()] if files else []
    if not (files and n_rows and n_pages):
        found.append({"kind": "archive", "subject": root, "error": "archive has insufficient committed evidence"})
    return {"passed": not found, "raw_files_checked": files, "indexed_rows_checked": n_rows, "committed_pages_checked": n_pages, "problems": found, "scope": "Hash and index reconciliation only; neither completeness nor timing."}
