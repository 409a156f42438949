"""Fail-closed contracts.

A rule is a name and a predicate that is true where a row violates it.  In row mode the
first violated rule of a row becomes its `reason`; in frame mode all rules are counted in
one aggregate, and the first violated one (in the order given) raises.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Rule = tuple[str, Column]


class ContractError(ValueError):
    """A frame that breaks a rule; nothing of it is used."""


def reason(rules: Sequence[Rule]) -> Column:
    """The first violated rule's name, null if none; a null predicate is a violation."""
    out = F.lit(None).cast("string")
    for name, bad in reversed(rules):
        out = F.when(F.coalesce(bad, F.lit(True)), F.lit(name)).otherwise(out)
    return out


def violations(df: DataFrame, rules: Sequence[Rule]) -> dict[str, int]:
    """Violations of each rule, in one job."""
    if not rules:
        return {}
    row = df.agg(*(F.count_if(F.coalesce(bad, F.lit(True))).alias(f"r{i}") for i, (_, bad) in enumerate(rules))).first()
    return {name: row[i] for i, (name, _) in enumerate(rules)}


def require(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    for name, n in violations(df, rules).items():
        if n:
            raise ContractError(f"{name}: {n} rows")
    return df


def require_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ContractError(f"missing columns: {', '.join(missing)}")
    return df


def require_unique(df: DataFrame, keys: Sequence[str], what: str) -> DataFrame:
    """Partial counts meet by key; one row decides."""
    if df.groupBy(*keys).count().where("count > 1").limit(1).count():
        raise ContractError(f"duplicate {what}")
    return df


def good_groups(df: DataFrame, keys: Sequence[str], ok: Column) -> DataFrame:
    """The rows of groups (pages) whose rows all are good: one bad row rejects its group."""
    bad = df.where(~F.coalesce(ok, F.lit(False))).select(*keys).distinct()
    return df.join(bad, list(keys), "left_anti")


def first_writer(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """INSERT OR IGNORE within a batch: the first row of each key."""
    return df.withColumn("nth__", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("nth__ = 1").drop("nth__")


def last_writer(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """INSERT OR REPLACE within a batch: the last row of each key, by a map-side combined maximum."""
    rest = [c for c in df.columns if c not in keys]
    packed = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*(o.alias(f"o{i}") for i, o in enumerate(order)))).alias("r__"))
    return packed.select(*keys, *(F.col("r__")[c].alias(c) for c in rest))


def with_conflicts(df: DataFrame, keys: Sequence[str], content: Column, order: Column) -> DataFrame:
    """keys, conflicting (different contents of one key), copies, first_content."""
    return df.groupBy(*keys).agg((F.min(content) != F.max(content)).alias("conflicting"), F.count("*").alias("copies"), F.min_by(content, order).alias("first_content"))


def both_at(event: Column, available: Column, cutoff: Column) -> Column:
    """Two-clock as-of filter: event time and availability are at or before the cutoff."""
    return (event <= cutoff) & (available <= cutoff)
