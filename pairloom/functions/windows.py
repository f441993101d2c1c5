"""Windows over a time series: always partitioned by the series' key and ordered by date."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

PAIR = ("ticker_a", "ticker_b")


def ordered(*keys: str, by: str = "date"):
    return Window.partitionBy(*keys).orderBy(by)


def trailing(rows: int, *keys: str, by: str = "date"):
    return ordered(*keys, by=by).rowsBetween(1 - rows, 0)


def so_far(*keys: str, by: str = "date"):
    return ordered(*keys, by=by).rowsBetween(Window.unboundedPreceding, 0)


def full(value: Column, seen: Column, rows: int, window) -> Column:
    """``value`` over the window, null until the frame has ``rows`` non-null entries of ``seen``."""
    return F.when(F.count(seen).over(window) == rows, value.over(window))


def rolling_mean(x: Column, rows: int, *keys: str) -> Column:
    return full(F.avg(x), x, rows, trailing(rows, *keys))


def rolling_std(x: Column, rows: int, *keys: str) -> Column:
    return full(F.stddev_samp(x), x, rows, trailing(rows, *keys))


def zscore(x: Column, rows: int, *keys: str) -> Column:
    return F.try_divide(x - rolling_mean(x, rows, *keys), rolling_std(x, rows, *keys))


def clean(x: Column) -> Column:
    """NaN and infinities as null."""
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)
