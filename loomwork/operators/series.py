"""Time series as tidy tables (key, ts_ms, value, seq): seq is the order of arrival."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

AGGREGATES = {
    "AVG": lambda: F.avg("value"),
    "MIN": lambda: F.min("value"),
    "MAX": lambda: F.max("value"),
    "SUM": lambda: F.sum("value"),
    "COUNT": lambda: F.count("value").cast("double"),
    "FIRST": lambda: F.min_by("value", F.struct("ts_ms", "seq")),
    "LAST": lambda: F.max_by("value", F.struct("ts_ms", "seq")),
}


def accepted(samples: DataFrame) -> DataFrame:
    """Samples whose time is no earlier than any that arrived before them."""
    before = W.partitionBy("key").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    last = F.max("ts_ms").over(before)
    return samples.withColumn("__last", last).filter(F.col("__last").isNull() | (F.col("ts_ms") >= F.col("__last"))).drop("__last")


def retained(samples: DataFrame, most: int) -> DataFrame:
    """The last ``most`` samples of each key."""
    place = F.row_number().over(W.partitionBy("key").orderBy(F.col("ts_ms").desc(), F.col("seq").desc()))
    return samples.withColumn("__place", place).filter(F.col("__place") <= most).drop("__place")


def between(samples: DataFrame, start: int, stop: int) -> DataFrame:
    return samples.filter(F.col("ts_ms").between(start, stop))


def bucket(width: int) -> Column:
    """Start of the bucket of a time; truncation is towards 0."""
    return F.col("ts_ms") - F.col("ts_ms") % width


def buckets(samples: DataFrame, width: int, *how: str, start: int | None = None, stop: int | None = None) -> DataFrame:
    """Tumbling buckets with the named aggregates in lower case; empty ones are left out.

    All aggregates are partial before the shuffle, first and last too.
    """
    rows = samples
    if start is not None or stop is not None:
        rows = between(rows, -(1 << 63) if start is None else start, (1 << 63) - 1 if stop is None else stop)
    return rows.groupBy("key", bucket(width).alias("bucket")).agg(*[AGGREGATES[h.upper()]().alias(h.lower()) for h in how])


def candles(samples: DataFrame, width: int) -> DataFrame:
    """Open, high, low and close of each bucket."""
    names = {"first": "open", "max": "high", "min": "low", "last": "close"}
    return buckets(samples, width, *names).withColumnsRenamed(names)


def lengths(samples: DataFrame) -> DataFrame:
    return samples.groupBy("key").agg(F.count(F.lit(1)).alias("n"))


def last(samples: DataFrame) -> DataFrame:
    at = F.max(F.struct("ts_ms", "seq", "value")).alias("x")
    return samples.groupBy("key").agg(at).select("key", "x.ts_ms", "x.value")
