"""Versioned tables with one pointer.

The pointer names, for each table, the folders that make it up.  A commit writes new folders only for what
changed (a whole table, or rows to add), then replaces the pointer; a failed commit leaves it where it was.
A table of more than ``MOST_PARTS`` folders is written anew as one.
"""

from __future__ import annotations

import json
import os
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

MOST_PARTS = 32


class Store:
    #: Schema of each table.
    schemas: dict[str, str] = {}

    def __init__(self, spark: SparkSession, root: str | Path) -> None:
        self.spark, self.root = spark, Path(root)
        self.pointer = self.root / "CURRENT"
        self.root.mkdir(parents=True, exist_ok=True)

    @property
    def version(self) -> str | None:
        """What the pointer says; writing it back restores the state."""
        return self.pointer.read_text().strip() if self.pointer.exists() else None

    def parts(self) -> dict[str, list[str]]:
        return json.loads(self.version or "{}")

    def read(self, name: str) -> DataFrame:
        held = self.parts().get(name)
        if not held:
            return self.spark.createDataFrame([], self.schemas[name])
        return self.spark.read.option("mergeSchema", "true").parquet(*(f"file://{self.root}/{x}" for x in held))

    def commit(self, added: dict[str, DataFrame] | None = None, **replaced: DataFrame) -> str:
        """replaced: whole tables; added: rows to add.  Tables that neither names keep their folders."""
        now, version = self.parts(), f"v-{uuid.uuid4().hex}"
        for name, df in replaced.items():
            df.write.parquet(f"file://{self.root}/{version}/{name}")
            now[name] = [f"{version}/{name}"]
        for name, df in (added or {}).items():
            at = f"{version}/{name}-added"
            df.write.parquet(f"file://{self.root}/{at}")
            now[name] = [*now.get(name, []), at]
            if len(now[name]) > MOST_PARTS:
                whole = f"{version}/{name}"
                self.spark.read.option("mergeSchema", "true").parquet(*(f"file://{self.root}/{x}" for x in now[name])).write.parquet(f"file://{self.root}/{whole}")
                now[name] = [whole]
        part = self.root / f"CURRENT.{version}"
        part.write_text(json.dumps(now))
        os.replace(part, self.pointer)
        return version
