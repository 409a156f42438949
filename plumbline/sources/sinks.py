"""Deterministic small outputs, written by the driver from collected result tables."""

from __future__ import annotations

import csv
import json
import math
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame


def cell(x: Any) -> str:
    """Ten significant digits for fractions, nothing for missing values."""
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return ""
    return f"{x:.10g}" if isinstance(x, float) else str(x)


def write_csv(df: DataFrame, path: str | Path, order: list[str]) -> Path:
    path = Path(path)
    with path.open("w", newline="") as f:
        out = csv.writer(f, lineterminator="\n")
        out.writerow(df.columns)
        for row in df.orderBy(*order).toLocalIterator():
            out.writerow([cell(x) for x in row])
    return path


def write_json(value: Any, path: str | Path) -> Path:
    path = Path(path)
    path.write_text(json.dumps(value, indent=2, sort_keys=True, allow_nan=False, default=str) + "\n")
    return path


def fresh_dir(path: str | Path) -> Path:
    """A directory that must not hold anything yet."""
    path = Path(path)
    if path.exists() and any(path.iterdir()):
        raise FileExistsError(f"{path} is not empty")
    path.mkdir(parents=True, exist_ok=True)
    return path
