"""Sorted sets as tidy tables (key, member, score), ordered by score and then member."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _order(reverse: bool = False) -> list[Column]:
    return [F.col("score").desc(), F.col("member").desc()] if reverse else [F.col("score").asc(), F.col("member").asc()]


def upsert(log: DataFrame) -> DataFrame:
    """The table that a log (key, member, score, seq) leaves: the last score of each member. A write of NaN has no effect, as it is refused where it comes."""
    valid = log.filter(~F.isnan("score"))
    return valid.groupBy("key", "member").agg(F.max_by("score", "seq").alias("score"))


def increments(log: DataFrame) -> DataFrame:
    """Scores that a log of (key, member, delta) adds up to."""
    return log.groupBy("key", "member").agg(F.sum("delta").alias("score"))


def ranked(zsets: DataFrame, reverse: bool = False) -> DataFrame:
    """With rank, counted from 0 within each key."""
    return zsets.withColumn("rank", F.row_number().over(W.partitionBy("key").orderBy(*_order(reverse))) - 1)


def range_by_rank(zsets: DataFrame, start: int, stop: int, reverse: bool = False) -> DataFrame:
    """Ranks start to stop, both inclusive; negative ones count from the end.

    From the front, only a bounded part of each key is ranked beyond its partition.
    """
    if start >= 0 and stop >= 0:
        out = ranked(zsets, reverse).filter(F.col("rank") <= stop)
        return out.filter(F.col("rank") >= start)
    size = zsets.groupBy("key").agg(F.count(F.lit(1)).alias("__n"))
    at = lambda i: F.lit(i) if i >= 0 else F.col("__n") + i
    return ranked(zsets, reverse).join(size, "key").filter((F.col("rank") >= at(start)) & (F.col("rank") <= at(stop))).drop("__n")


def range_by_score(zsets: DataFrame, low: float, high: float, *, offset: int = 0, limit: int | None = None, reverse: bool = False) -> DataFrame:
    """Inclusive score range in order; offset and limit apply to each key."""
    rows = zsets.filter(F.col("score").between(low, high))
    if offset == 0 and limit is None:
        return rows
    place = F.row_number().over(W.partitionBy("key").orderBy(*_order(reverse)))
    out = rows.withColumn("__place", place)
    if limit is not None:
        out = out.filter(F.col("__place") <= offset + limit)
    return out.filter(F.col("__place") > offset).drop("__place")


def count(zsets: DataFrame, low: float, high: float) -> DataFrame:
    return zsets.filter(F.col("score").between(low, high)).groupBy("key").agg(F.count(F.lit(1)).alias("n"))


def remove_by_score(zsets: DataFrame, low: float, high: float) -> DataFrame:
    return zsets.filter(~F.col("score").between(low, high))


def _combined(parts: list[tuple[DataFrame, float]], how: str) -> DataFrame:
    """(member, score, sources) over weighted sources; sets without scores count 1, and NaN becomes 0."""
    rows = None
    for i, (part, weight) in enumerate(parts):
        score = F.col("score") if "score" in part.columns else F.lit(1.0)
        weighed = part.select("member", F.nanvl(score * F.lit(float(weight)), F.lit(0.0)).alias("score"), F.lit(i).alias("source"))
        rows = weighed if rows is None else rows.unionByName(weighed)
    score = {"SUM": F.nanvl(F.sum("score"), F.lit(0.0)), "MIN": F.min("score"), "MAX": F.max("score")}[how.upper()]
    return rows.groupBy("member").agg(score.alias("score"), F.count(F.lit(1)).alias("sources"))


def union(parts: list[tuple[DataFrame, float]], how: str = "SUM") -> DataFrame:
    return _combined(parts, how).drop("sources")


def intersection(parts: list[tuple[DataFrame, float]], how: str = "SUM") -> DataFrame:
    """Members of all sources; a source listed twice counts twice, by position."""
    return _combined(parts, how).filter(F.col("sources") == len(parts)).drop("sources")
