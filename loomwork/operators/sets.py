"""Sets as tidy tables (key, member), and their algebra."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def members(sets: DataFrame, key: str) -> DataFrame:
    """Distinct members of one set; a missing key is an empty set."""
    return sets.filter(F.col("key") == key).select("member").distinct()


def union(sets: DataFrame, *keys: str) -> DataFrame:
    return sets.filter(F.col("key").isin(*keys)).select("member").distinct()


def intersection(sets: DataFrame, *keys: str) -> DataFrame:
    """Members of all sets, in one aggregation whatever the number of sets."""
    wanted = sorted(set(keys))
    counts = sets.filter(F.col("key").isin(wanted)).distinct().groupBy("member").agg(F.count(F.lit(1)).alias("n"))
    return counts.filter(F.col("n") == len(wanted)).select("member")


def difference(sets: DataFrame, first: str, *rest: str) -> DataFrame:
    """Members of the first set that are in none of the others, in one aggregation."""
    rows = sets.filter(F.col("key").isin(first, *rest))
    told = rows.groupBy("member").agg(F.bool_or(F.col("key") == first).alias("here"), F.bool_or(F.col("key").isin(*rest) if rest else F.lit(False)).alias("there"))
    return told.filter("here and not there").select("member")


def store(sets: DataFrame, destination: str, result: DataFrame) -> DataFrame:
    """All sets with ``destination`` replaced by a result; an empty result removes it."""
    return sets.filter(F.col("key") != destination).unionByName(result.select(F.lit(destination).alias("key"), "member"))


def add(sets: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The sets with (key, member) rows added, and the rows that were new."""
    fresh = new.select("key", "member").distinct().join(sets, ["key", "member"], "left_anti")
    return sets.unionByName(fresh), fresh


def remove(sets: DataFrame, gone: DataFrame) -> DataFrame:
    return sets.join(gone.select("key", "member").distinct(), ["key", "member"], "left_anti")


def cardinality(sets: DataFrame) -> DataFrame:
    return sets.distinct().groupBy("key").agg(F.count(F.lit(1)).alias("size"))


def is_member(sets: DataFrame, asked: DataFrame) -> DataFrame:
    """(key, member, found) for every row asked."""
    held = sets.select("key", "member").distinct().withColumn("found", F.lit(True))
    return asked.join(held, ["key", "member"], "left").withColumn("found", F.coalesce("found", F.lit(False)))


def pop(sets: DataFrame, key: str, count: int = 1, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Up to ``count`` members by a seeded hash, and the sets without them."""
    taken = members(sets, key).orderBy(F.xxhash64("member", F.lit(seed)), "member").limit(count)
    return taken, remove(sets, taken.withColumn("key", F.lit(key)))
