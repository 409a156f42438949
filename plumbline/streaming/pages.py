"""Pages as a stream: envelope files that land in a folder are validated and committed micro-batch by micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from plumbline.sources.ledger import Ledger

PAGES = "page_id long, condition string, received_at double, body string, request_cursor string, raw_file string"


def stream(spark: SparkSession, folder: str, ledger: Ledger, checkpoint: str, files_per_batch: int = 100) -> StreamingQuery:
    """Reads JSON lines of PAGES; a replayed batch commits nothing twice, as pages are known by their evidence file.

    files_per_batch is the admission control that the page budget is in batch runs.
    """

    def commit(batch: DataFrame, batch_id: int) -> None:
        new = batch.join(ledger.read("pages").select("raw_file").distinct(), "raw_file", "left_anti").select(*(c.split()[0] for c in PAGES.split(", ")))
        if not new.isEmpty():
            ledger.append(new)

    source = spark.readStream.schema(PAGES).option("maxFilesPerTrigger", files_per_batch).json(folder)
    return source.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def visible(events: DataFrame, cutoffs: list[str], event: str = "ts", available: str = "available_at") -> DataFrame:
    """Late data by the availability clock: what had happened, and what was known, at each cutoff; one pass."""
    at = [F.lit(c).cast("timestamp") for c in cutoffs]
    sums = [F.count_if((F.col(event) <= c) & (F.col(available) <= c)).alias(f"known_{i}") for i, c in enumerate(at)] + [F.count_if(F.col(event) <= c).alias(f"happened_{i}") for i, c in enumerate(at)]
    row = events.agg(*sums)
    return row.select(F.explode(F.array(*(F.struct(F.lit(c).alias("cutoff"), F.col(f"happened_{i}").alias("happened"), F.col(f"known_{i}").alias("known")) for i, c in enumerate(cutoffs)))).alias("r")).select("r.*")
