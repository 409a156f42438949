"""Tables, and the shared folder that cuts lineage."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows of an Arrow batch; as many as textblocks.blocks takes at once.
BATCH = 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; only where that is unset and all runs in one process, a temporary one.

    On a cluster every executor would write to its own disk there, so that raises.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            return held.get()
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = f"file://{tempfile.mkdtemp(prefix='plumbline-')}"
        spark.sparkContext.setCheckpointDir(at)
    return at


def new_dir(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/plumbline-{what}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, what: str) -> DataFrame:
    """df as a table in the shared folder: its lineage ends there and a lost executor costs nothing of it."""
    spark = df.sparkSession
    at = new_dir(spark, what)
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def dropped(spark: SparkSession, uri: str) -> None:
    """Removes a folder that new_dir named."""
    assert "/plumbline-" in uri
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most BATCH rows in this session from here on (a smaller setting stays).

    A JVM and a Python worker each hold the batch that passes between them, and the JVM's vectors grow by doubling; at Spark's
    10,000 rows a batch is all the texts of a task.  No row is left out and no result depends on it.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH:
        spark.conf.set(key, str(BATCH))


def unused(df: DataFrame, name: str) -> str:
    """name, with as many underscores as make it no column of df (in any case)."""
    held = {c.lower() for c in df.columns}
    while name.lower() in held:
        name += "_"
    return name


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
