"""Strict conversions: what cannot be read is null here and counted by a contract, never guessed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$"
ZONED = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?\s*(Z|[+-]\d{2}:?\d{2})$"
DATE = r"^\d{4}-\d{2}-\d{2}$"


def finite(x: Column) -> Column:
    """x as a finite double, else null (NaN and infinities are missing values' impostors)."""
    d = x.try_cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) < float("inf")), d)


def strict_number(text: Column) -> Column:
    """A finite double from text of plain decimal form, else null."""
    return F.when(text.rlike(NUMBER), finite(text))


def zoned_timestamp(text: Column) -> Column:
    """An instant from ISO text that names its zone, else null."""
    t = F.trim(text)
    t = F.regexp_replace(t, r"([T ]\d{2}:\d{2})(Z|[+-]\d{2}:?\d{2})$", "$1:00$2")
    t = F.regexp_replace(t, r"([+-]\d{2})(\d{2})$", "$1:$2")
    return F.when(F.trim(text).rlike(ZONED), t.try_cast("timestamp"))


def iso_date(text: Column) -> Column:
    return F.when(text.rlike(DATE), text.try_cast("date"))
