"""Column functions on event times (epoch seconds, UTC)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RANGES_S = {"15m": 900, "1h": 3600, "6h": 21600, "24h": 86400, "7d": 604800}  # fixed values


def epoch_seconds(value: Column) -> Column:
    """A usable epoch time in seconds or NULL; values above 1e12 are milliseconds."""
    number = value.try_cast("double")
    usable = number.isNotNull() & ~F.isnan(number) & (number > 0) & (number < float("inf"))
    return F.when(usable, F.when(number > 1e12, number * 1e-3).otherwise(number))


def event_time(*candidates: Column, now: Column) -> Column:
    """The first usable of send, origin, device and ingestion time, else ``now``."""
    return F.coalesce(*[epoch_seconds(c) for c in candidates], now.cast("double"))


def millis(seconds: Column) -> Column:
    """Rounds half to even."""
    return F.bround(seconds * 1000).cast("long")


def parse_ui_time(text: Column) -> Column:
    """Number or date text to epoch seconds, NULL when it is neither."""
    clean = F.trim(text.cast("string"))
    number = F.when(clean.rlike(r"^-?[0-9]+(\.[0-9]+)?$"), clean.try_cast("double"))
    when = F.unix_micros(F.try_to_timestamp(clean)) / 1e6
    return F.when(number > 1e12, number / 1000).otherwise(F.coalesce(number, when))


def bucket_start(seconds: Column, width: int = 60) -> Column:
    return (F.floor(seconds / width) * width).cast("long")
