"""A keyspace: typed keys in tidy tables, with expiry against a given clock."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.functions import glob

#: Value types, with the table of each and the columns it has beside the key.
TABLES = {
    "string": "value string",
    "list": "pos long, value string",
    "hash": "field string, value string",
    "set": "member string",
    "zset": "member string, score double",
    "timeseries": "ts_ms long, value double",
    "stream": "ms long, seq long, fields map<string,string>",
}


@dataclass(frozen=True)
class Keyspace:
    """Tables by type, and (key, expires_at) in ms for keys that expire. Changes give a new keyspace."""

    spark: SparkSession
    tables: dict[str, DataFrame] = field(default_factory=dict)
    expiry: DataFrame | None = None

    def table(self, kind: str) -> DataFrame:
        return self.tables[kind] if kind in self.tables else self.spark.createDataFrame([], f"key string, {TABLES[kind]}")

    @property
    def expires(self) -> DataFrame:
        return self.expiry if self.expiry is not None else self.spark.createDataFrame([], "key string, expires_at long")

    def keys(self, now: int) -> DataFrame:
        """The KEYS relation: key, type, size, ttl in seconds (null: permanent) and value, without expired keys.

        One partial aggregation per type; a key is expired from its expiry on.
        """
        parts = []
        for kind, df in self.tables.items():
            size = F.max(F.length("value")).cast("long") if kind == "string" else F.count(F.lit(1))
            value = F.max("value") if kind == "string" else F.max(F.lit(None).cast("string"))
            parts.append(df.groupBy("key").agg(F.lit(kind).alias("type"), size.alias("size"), value.alias("value")))
        if not parts:
            return self.spark.createDataFrame([], "key string, type string, size long, ttl double, value string")
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        out = out.join(self.expires, "key", "left").filter(F.col("expires_at").isNull() | (F.col("expires_at") > now))
        return out.select("key", "type", "size", ((F.col("expires_at") - now) / 1000.0).alias("ttl"), "value")

    def live(self, kind: str, now: int) -> DataFrame:
        """One type's table without expired keys."""
        gone = self.expires.filter(F.col("expires_at") <= now).select("key")
        return self.table(kind).join(gone, "key", "left_anti")

    def scan(self, pattern: str, now: int) -> DataFrame:
        """Keys that match a glob; a pattern without special characters is a lookup."""
        exact = glob.literal(pattern)
        return self.keys(now).filter(F.col("key") == exact if exact is not None else F.col("key").rlike(glob.regex(pattern)))

    def page(self, now: int, after: tuple[int, str] | None = None, limit: int = 10) -> DataFrame:
        """Keys in hash order after a (hash, key) cursor."""
        rows = self.keys(now).select(F.xxhash64("key").alias("hash"), "key")
        if after is not None:
            rows = rows.filter((F.col("hash") > after[0]) | ((F.col("hash") == after[0]) & (F.col("key") > after[1])))
        return rows.orderBy("hash", "key").limit(limit)

    def _without(self, gone: DataFrame) -> Keyspace:
        tables = {k: df.join(gone, "key", "left_anti") for k, df in self.tables.items()}
        return replace(self, tables=tables, expiry=self.expires.join(gone, "key", "left_anti"))

    def delete(self, *keys: str) -> Keyspace:
        return self._without(self.spark.createDataFrame([(k,) for k in keys], "key string"))

    def delete_where(self, gone: DataFrame) -> Keyspace:
        return self._without(gone.select("key").distinct())

    def sweep(self, now: int) -> Keyspace:
        """Without what is expired."""
        return self._without(self.expires.filter(F.col("expires_at") <= now).select("key"))

    def rename(self, old: str, new: str) -> Keyspace:
        """Overwrites the new key; value and expiry move."""
        name = F.when(F.col("key") == old, new).otherwise(F.col("key")).alias("key")
        moved = lambda df: df.filter(F.col("key") != new).select(name, *[c for c in df.columns if c != "key"])
        return replace(self, tables={k: moved(df) for k, df in self.tables.items()}, expiry=moved(self.expires))

    def expire(self, key: str, at: int) -> Keyspace:
        other = self.expires.filter(F.col("key") != key)
        return replace(self, expiry=other.unionByName(self.spark.createDataFrame([(key, at)], "key string, expires_at long")))

    def persist(self, key: str) -> Keyspace:
        return replace(self, expiry=self.expires.filter(F.col("key") != key))

    def put(self, kind: str, rows: DataFrame) -> Keyspace:
        """Keys of new rows replace theirs in this type; a key of another type raises."""
        keys = rows.select("key").distinct()
        for other, df in self.tables.items():
            if other != kind and not df.join(keys, "key", "left_semi").isEmpty():
                raise TypeError(f"a key already holds a {other}")
        table = self.table(kind).join(keys, "key", "left_anti").unionByName(rows)
        return replace(self, tables=self.tables | {kind: table}, expiry=self.expires.join(keys, "key", "left_anti") if kind == "string" else self.expiry)

    def get_many(self, keys: list[str], now: int) -> DataFrame:
        """(pos, key, value) of texts by position, null where a key is absent or of another type."""
        asked = self.spark.createDataFrame([*enumerate(keys)], "pos int, key string")
        return asked.join(self.live("string", now), "key", "left").select("pos", "key", "value")

    def random_key(self, now: int, seed: int = 0) -> DataFrame:
        return self.keys(now).select("key").orderBy(F.xxhash64("key", F.lit(seed))).limit(1)

    def size(self, now: int) -> int:
        return self.keys(now).count()

    def save(self, path: str) -> None:
        """A snapshot: one Parquet table per type, and the expiries."""
        for kind, df in self.tables.items():
            df.write.mode("overwrite").parquet(f"{path}/{kind}")
        self.expires.write.mode("overwrite").parquet(f"{path}/expiry")

    @staticmethod
    def load(spark: SparkSession, path: str, kinds=tuple(TABLES)) -> Keyspace:
        jvm = spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(path)
        fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        there = [k for k in kinds if fs.exists(jvm.org.apache.hadoop.fs.Path(root, k))]
        return Keyspace(spark, {k: spark.read.parquet(f"{path}/{k}") for k in there}, spark.read.parquet(f"{path}/expiry"))


def string_increments(log: DataFrame) -> DataFrame:
    """Counters that a log of (key, delta) leaves, from 0."""
    return log.groupBy("key").agg(F.sum("delta").cast("string").alias("value"))


def last_writes(log: DataFrame) -> DataFrame:
    """Texts that a log (key, value, seq) leaves; a null value deletes."""
    return log.groupBy("key").agg(F.max_by("value", "seq").alias("value")).filter(F.col("value").isNotNull())


def set_if_absent(log: DataFrame) -> DataFrame:
    """Texts that a log of conditional writes leaves: the first of each key."""
    return log.groupBy("key").agg(F.min_by("value", "seq").alias("value"))
