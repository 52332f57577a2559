"""Keyspace queries over tables derived from events and customer, with equivalent SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.functions import glob
from loomwork.operators import keyspace, lists, series, sets, streams, zsets
from loomwork.plans import keyspace_sql
from loomwork.session import read_table, stored

QUERIES: dict = {}
SQL: dict = {}

#: 2024-01-15 in ms, the clock of all queries with expiry.
NOW = 1_705_276_800_000


def _query(name: str, oracle: str | None = None):
    def register(f):
        QUERIES[name] = f
        if oracle:
            SQL[name] = oracle
        return f

    return register


def _members(spark, sf_dir) -> DataFrame:
    """Users of each event type as sets."""
    return read_table(spark, sf_dir, "events").select(F.col("event_type").alias("key"), F.col("user_id").cast("string").alias("member")).distinct()


def _scores(spark, sf_dir) -> DataFrame:
    """Values of each event type by user as sorted sets."""
    e = read_table(spark, sf_dir, "events")
    return e.groupBy(F.col("event_type").alias("key"), F.col("user_id").cast("string").alias("member")).agg(F.round(F.sum("value"), 3).alias("score"))


def _samples(spark, sf_dir) -> DataFrame:
    """Values of each event type as time series."""
    e = read_table(spark, sf_dir, "events")
    return e.select(F.col("event_type").alias("key"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"), "value", F.col("event_id").alias("seq"))


def _entries(spark, sf_dir) -> DataFrame:
    """Events of each type as stream entries, with the event's number as seq."""
    e = read_table(spark, sf_dir, "events")
    fields = F.create_map(F.lit("user"), F.col("user_id").cast("string"))
    return e.select(F.col("event_type").alias("key"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"), F.col("event_id").alias("seq"), fields.alias("fields"))


def _keyspace(spark, sf_dir) -> keyspace.Keyspace:
    """customer names as texts, users as hashes, event types as sets; customers of nation 3 expire, those of nation 4 have expired."""
    c = read_table(spark, sf_dir, "customer")
    key = F.concat(F.lit("customer:"), F.col("c_custkey"))
    e = read_table(spark, sf_dir, "events")
    hashes = e.groupBy(F.concat(F.lit("user:"), F.col("user_id")).alias("key"), F.col("event_type").alias("field")).agg(F.count(F.lit(1)).cast("string").alias("value"))
    users = e.select(F.concat(F.lit("type:"), F.col("event_type")).alias("key"), F.col("user_id").cast("string").alias("member")).distinct()
    at = F.when(F.col("c_nationkey") == 3, F.lit(NOW) + 1000 * F.col("c_custkey")).when(F.col("c_nationkey") == 4, F.lit(NOW) - F.col("c_custkey"))
    expiry = c.select(key.alias("key"), at.cast("long").alias("expires_at")).filter("expires_at is not null")
    return keyspace.Keyspace(spark, {"string": c.select(key.alias("key"), F.col("c_name").alias("value")), "hash": hashes, "set": users}, expiry)


_KEYS = f"""WITH raw AS (
  SELECT 'customer:' || c_custkey AS key, 'string' AS type, length(c_name)::BIGINT AS size, c_name AS value,
         CASE c_nationkey WHEN 3 THEN {NOW} + 1000 * c_custkey WHEN 4 THEN {NOW} - c_custkey END AS expires_at FROM customer
  UNION ALL SELECT 'user:' || user_id, 'hash', count(DISTINCT event_type), NULL, NULL FROM events GROUP BY user_id
  UNION ALL SELECT 'type:' || event_type, 'set', count(DISTINCT user_id), NULL, NULL FROM events GROUP BY event_type),
keys AS (SELECT key, type, size, (expires_at - {NOW}) / 1000.0::DOUBLE AS ttl, value FROM raw WHERE expires_at IS NULL OR expires_at > {NOW}) """
_SETS = "WITH s AS (SELECT DISTINCT event_type AS key, user_id::VARCHAR AS member FROM events) "
_ZSETS = "WITH z AS (SELECT event_type AS key, user_id::VARCHAR AS member, round(sum(value), 3) AS score FROM events GROUP BY 1, 2) "
_TS = "WITH t AS (SELECT event_type AS key, (epoch_us(ts) // 1000) AS ts_ms, value, event_id AS seq FROM events) "


def _of(key: str) -> str:
    return f"SELECT member FROM s WHERE key = '{key}'"


@_query("k_sunion", _SETS + _of("click") + " UNION " + _of("purchase"))
def k_sunion(spark, sf_dir):
    return sets.union(_members(spark, sf_dir), "click", "purchase")


@_query("k_sinter", _SETS + _of("click") + " INTERSECT " + _of("purchase") + " INTERSECT " + _of("view"))
def k_sinter(spark, sf_dir):
    return sets.intersection(_members(spark, sf_dir), "click", "purchase", "view")


@_query("k_sdiff", _SETS + _of("click") + " EXCEPT " + _of("purchase"))
def k_sdiff(spark, sf_dir):
    return sets.difference(_members(spark, sf_dir), "click", "purchase")


@_query("k_sstore", _SETS + "SELECT * FROM s WHERE key <> 'view' UNION ALL SELECT 'view', member FROM (" + _of("click") + " EXCEPT " + _of("purchase") + ")")
def k_sstore(spark, sf_dir):
    s = _members(spark, sf_dir)
    return sets.store(s, "view", sets.difference(s, "click", "purchase"))


@_query("k_scard", _SETS + "SELECT key, count(*) AS size FROM s GROUP BY 1")
def k_scard(spark, sf_dir):
    return sets.cardinality(_members(spark, sf_dir))


@_query(
    "k_sadd_srem",
    "WITH s AS (SELECT DISTINCT event_type AS key, user_id::VARCHAR AS member FROM events WHERE value > 50), n AS (SELECT DISTINCT event_type AS key, user_id::VARCHAR AS member FROM events WHERE value <= 50) "
    "SELECT * FROM n EXCEPT SELECT * FROM s",
)
def k_sadd_srem(spark, sf_dir):
    e = read_table(spark, sf_dir, "events").select(F.col("event_type").alias("key"), F.col("user_id").cast("string").alias("member"), "value")
    old, new = e.filter("value > 50").select("key", "member").distinct(), e.filter("value <= 50").select("key", "member")
    after, fresh = sets.add(old, new)
    return sets.remove(after, old)


@_query("k_sismember", _SETS + "SELECT DISTINCT e.event_type AS key, c_custkey::VARCHAR AS member, s.member IS NOT NULL AS found FROM (SELECT DISTINCT event_type FROM events) e, customer LEFT JOIN s ON s.key = e.event_type AND s.member = c_custkey::VARCHAR")
def k_sismember(spark, sf_dir):
    kinds = F.explode(F.array(*[F.lit(k) for k in ("click", "error", "purchase", "signup", "view")]))
    asked = read_table(spark, sf_dir, "customer").select(kinds.alias("key"), F.col("c_custkey").cast("string").alias("member"))
    return sets.is_member(_members(spark, sf_dir), asked)


@_query("k_zrange_rank", _ZSETS + "SELECT key, member, score, rank FROM (SELECT *, (row_number() OVER (PARTITION BY key ORDER BY score, member) - 1)::INTEGER AS rank FROM z) WHERE rank BETWEEN 3 AND 12")
def k_zrange_rank(spark, sf_dir):
    return zsets.range_by_rank(_scores(spark, sf_dir), 3, 12)


@_query("k_zrevrange_negative", _ZSETS + "SELECT key, member, score, rank FROM (SELECT *, (row_number() OVER (PARTITION BY key ORDER BY score DESC, member DESC) - 1)::INTEGER AS rank, count(*) OVER (PARTITION BY key) AS n FROM z) WHERE rank >= n - 5 AND rank <= n - 2")
def k_zrevrange_negative(spark, sf_dir):
    return zsets.range_by_rank(_scores(spark, sf_dir), -5, -2, reverse=True)


@_query("k_zrangebyscore", _ZSETS + "SELECT key, member, score FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY score, member) AS n FROM z WHERE score BETWEEN 100 AND 1000) WHERE n > 2 AND n <= 7")
def k_zrangebyscore(spark, sf_dir):
    return zsets.range_by_score(_scores(spark, sf_dir), 100, 1000, offset=2, limit=5)


@_query("k_zrank", _ZSETS + "SELECT key, member, score, (row_number() OVER (PARTITION BY key ORDER BY score, member) - 1)::INTEGER AS rank FROM z")
def k_zrank(spark, sf_dir):
    return zsets.ranked(_scores(spark, sf_dir))


@_query("k_zcount", _ZSETS + "SELECT key, count(*) AS n FROM z WHERE score BETWEEN 200 AND 900 GROUP BY 1")
def k_zcount(spark, sf_dir):
    return zsets.count(_scores(spark, sf_dir), 200, 900)


@_query("k_zremrangebyscore", _ZSETS + "SELECT * FROM z WHERE NOT score BETWEEN 200 AND 900")
def k_zremrangebyscore(spark, sf_dir):
    return zsets.remove_by_score(_scores(spark, sf_dir), 200, 900)


@_query("k_zunion_weighted", _ZSETS + "SELECT member, round(sum(s), 4) AS score FROM (SELECT member, score * 2 AS s FROM z WHERE key = 'click' UNION ALL SELECT member, score * 0.5 FROM z WHERE key = 'purchase' UNION ALL SELECT DISTINCT user_id::VARCHAR, 3.0 FROM events WHERE event_type = 'view') GROUP BY 1")
def k_zunion_weighted(spark, sf_dir):
    z, s = _scores(spark, sf_dir), _members(spark, sf_dir)
    out = zsets.union([(z.filter("key = 'click'"), 2), (z.filter("key = 'purchase'"), 0.5), (s.filter("key = 'view'"), 3)])
    return out.withColumn("score", F.round("score", 4))


@_query("k_zinter_max", _ZSETS + "SELECT member, max(score) AS score FROM z WHERE key IN ('click', 'purchase') GROUP BY 1 HAVING count(*) = 2")
def k_zinter_max(spark, sf_dir):
    z = _scores(spark, sf_dir)
    return zsets.intersection([(z.filter("key = 'click'"), 1), (z.filter("key = 'purchase'"), 1)], "MAX")


@_query("k_zadd_log", "SELECT event_type AS key, user_id::VARCHAR AS member, arg_max(value, event_id) AS score FROM events GROUP BY 1, 2")
def k_zadd_log(spark, sf_dir):
    e = read_table(spark, sf_dir, "events")
    return zsets.upsert(e.select(F.col("event_type").alias("key"), F.col("user_id").cast("string").alias("member"), F.col("value").alias("score"), F.col("event_id").alias("seq")))


@_query("k_zincrby", "SELECT event_type AS key, user_id::VARCHAR AS member, sum((event_id % 7)::DOUBLE) AS score FROM events GROUP BY 1, 2")
def k_zincrby(spark, sf_dir):
    e = read_table(spark, sf_dir, "events")
    return zsets.increments(e.select(F.col("event_type").alias("key"), F.col("user_id").cast("string").alias("member"), (F.col("event_id") % 7).cast("double").alias("delta")))


def _writes(spark, sf_dir) -> DataFrame:
    """Each event writes its type to its user's key; every fifth deletes it."""
    e = read_table(spark, sf_dir, "events")
    value = F.when(F.col("event_id") % 5 != 0, F.col("event_type"))
    return e.select(F.col("user_id").cast("string").alias("key"), value.alias("value"), F.col("event_id").alias("seq"))


@_query("k_last_writes", "SELECT key, value FROM (SELECT user_id::VARCHAR AS key, CASE WHEN event_id % 5 <> 0 THEN event_type END AS value, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n = 1 AND value IS NOT NULL")
def k_last_writes(spark, sf_dir):
    return keyspace.last_writes(_writes(spark, sf_dir))


@_query("k_setnx", "SELECT user_id::VARCHAR AS key, arg_min(event_type, event_id) AS value FROM events WHERE event_id % 5 <> 0 GROUP BY 1")
def k_setnx(spark, sf_dir):
    return keyspace.set_if_absent(_writes(spark, sf_dir).filter("value is not null"))


@_query("k_spop", "SELECT count(DISTINCT c_nationkey) AS members, 3::BIGINT AS taken, count(DISTINCT c_nationkey) - 3 AS left_, 0::BIGINT AS both_ FROM customer")
def k_spop(spark, sf_dir):
    """Three members of a set, and the set without them."""
    held = read_table(spark, sf_dir, "customer").select(F.lit("s").alias("key"), F.col("c_nationkey").cast("string").alias("member")).distinct()
    taken, rest = sets.pop(held, "s", 3, seed=1)
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    both = rest.join(taken, "member", "left_semi")
    return count(held, "members").crossJoin(count(taken, "taken")).crossJoin(count(rest, "left_")).crossJoin(count(both, "both_"))


@_query("k_ttl_text", "SELECT event_id, CASE WHEN event_id % 1000 = 0 THEN (event_id // 1000)::VARCHAR ELSE regexp_replace(printf('%.3f', event_id / 1000.0), '0+$', '') END AS ttl FROM events")
def k_ttl_text(spark, sf_dir):
    e = read_table(spark, sf_dir, "events").select("event_id", (F.col("event_id") / 1000.0).alias("ttl"))
    return e.select("event_id", keyspace_sql.rendered_ttl().alias("ttl"))


def _user_lists(spark, sf_dir) -> DataFrame:
    """Event types of each user, in order of the event."""
    e = read_table(spark, sf_dir, "events")
    rows = e.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", "event_type"))).alias("x"))
    return rows.select("user_id", F.col("x.event_type").alias("v"))


_LISTS = "WITH l AS (SELECT user_id, list(event_type ORDER BY event_id) AS v FROM events GROUP BY 1) "


@_query("k_lrange", _LISTS + "SELECT user_id, array_to_string(v[3:5], ',') AS a, array_to_string(v[-2:], ',') AS b, len(v)::INTEGER AS n, v[-1] AS last_, v[1] AS first_ FROM l")
def k_lrange(spark, sf_dir):
    v = F.col("v")
    return _user_lists(spark, sf_dir).select(
        "user_id", F.array_join(lists.span(v, 2, 4), ",").alias("a"), F.array_join(lists.span(v, -2, -1), ",").alias("b"),
        F.size(v).alias("n"), lists.at(v, -1).alias("last_"), lists.at(v, 0).alias("first_"),
    )


@_query("k_lpush_lrem", _LISTS + "SELECT user_id, array_to_string(list_filter(['c', 'b', 'a'] || v, lambda x: x <> 'click'), ',') AS v FROM l")
def k_lpush_lrem(spark, sf_dir):
    return _user_lists(spark, sf_dir).select("user_id", F.array_join(lists.remove(lists.push_left(F.col("v"), "a", "b", "c"), 0, "click"), ",").alias("v"))


@_query("k_lpos", "SELECT user_id, i AS pos FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i FROM events) WHERE event_type = 'click'")
def k_lpos(spark, sf_dir):
    return _user_lists(spark, sf_dir).select("user_id", F.explode(lists.positions(F.col("v"), "click").cast("array<long>")).alias("pos"))


@_query("k_hash_ops", "SELECT user_id, count(*) FILTER (event_type = 'click')::VARCHAR AS click, (count(*) FILTER (event_type = 'view') + 10)::VARCHAR AS view_, (count(DISTINCT event_type) + CASE WHEN count(*) FILTER (event_type = 'view') = 0 THEN 1 ELSE 0 END)::INTEGER AS n FROM events GROUP BY 1 HAVING count(*) FILTER (event_type = 'click') > 0")
def k_hash_ops(spark, sf_dir):
    e = read_table(spark, sf_dir, "events")
    per = e.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).cast("string").alias("n"))
    h = per.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("h"))
    h = h.withColumn("h", lists.hash_increment(F.col("h"), "view", 10))
    got = lists.hash_get(F.col("h"), "click", "view")
    return h.filter(F.map_contains_key("h", "click")).select("user_id", got[0].alias("click"), got[1].alias("view_"), F.size("h").alias("n"))


@_query("k_string_ops", "SELECT c_custkey, strlen(c_name)::INTEGER AS n, c_name[1:3] AS head, right(c_name, 2) AS tail, 'AB' || c_name[3:] AS patched FROM customer")
def k_string_ops(spark, sf_dir):
    v = F.col("c_name")
    return read_table(spark, sf_dir, "customer").select(
        "c_custkey", lists.text_length(v).alias("n"), lists.text_range(v, 0, 2).alias("head"), lists.text_range(v, -2, -1).alias("tail"),
        lists.text_overwrite(v, 0, "AB").alias("patched"),
    )


@_query("k_counters", "SELECT event_type AS key, count(*)::VARCHAR AS value FROM events GROUP BY 1")
def k_counters(spark, sf_dir):
    return keyspace.string_increments(read_table(spark, sf_dir, "events").select(F.col("event_type").alias("key"), F.lit(1).alias("delta")))


@_query("k_keys_view", _KEYS + "SELECT key, type, size, ttl, value FROM keys")
def k_keys_view(spark, sf_dir):
    return _keyspace(spark, sf_dir).keys(NOW)


@_query("k_keys_sql", _KEYS + "SELECT key, size FROM keys WHERE (((type = 'string' AND size > 10) OR upper(type) = 'SET') AND key NOT LIKE '%7') ORDER BY key LIMIT 300 OFFSET 10")
def k_keys_sql(spark, sf_dir):
    return keyspace_sql.run(_keyspace(spark, sf_dir).keys(NOW), "SELECT key, len FROM keys WHERE type = 'string' AND size > 10 OR type = 'SET' AND key NOT LIKE '%7' ORDER BY key LIMIT 300 OFFSET 10")


@_query("k_keys_sql_ttl", _KEYS + "SELECT key, ttl FROM keys ORDER BY coalesce(ttl, 'inf'::DOUBLE), key LIMIT 50")
def k_keys_sql_ttl(spark, sf_dir):
    return keyspace_sql.run(_keyspace(spark, sf_dir).keys(NOW), "SELECT key, ttl FROM keys ORDER BY ttl LIMIT 50")


@_query("k_keys_sql_null_and_not", _KEYS + "SELECT key FROM keys WHERE coalesce(upper(value) <> 'CUSTOMER#000000001', true) AND NOT coalesce(ttl < 100, false) AND type IN ('string', 'hash')")
def k_keys_sql_null_and_not(spark, sf_dir):
    return keyspace_sql.run(_keyspace(spark, sf_dir).keys(NOW), "SELECT key FROM keys WHERE val != 'customer#000000001' AND NOT ttl < 100 AND type IN ('String', 'HASH')")


@_query("k_keys_delete", _KEYS + "SELECT key FROM keys WHERE NOT (type = 'hash' AND size < 5)")
def k_keys_delete(spark, sf_dir):
    space = _keyspace(spark, sf_dir)
    gone = keyspace_sql.run(space.keys(NOW), "DELETE FROM keys WHERE type = 'hash' AND size < 5")
    return space.delete_where(gone).keys(NOW).select("key")


@_query("k_scan_glob", _KEYS + "SELECT key FROM keys WHERE regexp_full_match(key, 'user:[1-3].|type:[^cv].*')")
def k_scan_glob(spark, sf_dir):
    space = _keyspace(spark, sf_dir)
    return space.scan("user:[1-3]?", NOW).unionByName(space.scan("type:[^cv]*", NOW)).select("key")


@_query("k_rename_expire", _KEYS + "SELECT CASE key WHEN 'customer:1' THEN 'customer:2' ELSE key END AS key, value FROM keys WHERE type = 'string' AND key NOT IN ('customer:2', 'customer:5')")
def k_rename_expire(spark, sf_dir):
    space = _keyspace(spark, sf_dir).persist("customer:1").rename("customer:1", "customer:2").expire("customer:5", NOW)
    return space.live("string", NOW)


@_query("k_ts_range", _TS + f"SELECT * FROM t WHERE ts_ms BETWEEN {NOW} AND {NOW + 86_400_000}")
def k_ts_range(spark, sf_dir):
    return series.between(_samples(spark, sf_dir), NOW, NOW + 86_400_000)


@_query("k_ts_buckets", _TS + "SELECT key, ts_ms - ts_ms % 3600000 AS bucket, round(avg(value), 4) AS avg, min(value) AS min, max(value) AS max, round(sum(value), 4) AS sum, count(*)::DOUBLE AS count FROM t GROUP BY 1, 2")
def k_ts_buckets(spark, sf_dir):
    out = series.buckets(_samples(spark, sf_dir), 3_600_000, "AVG", "MIN", "MAX", "SUM", "COUNT")
    return out.withColumn("avg", F.round("avg", 4)).withColumn("sum", F.round("sum", 4))


@_query("k_ts_ohlc", _TS + "SELECT key, ts_ms - ts_ms % 86400000 AS bucket, arg_min(value, row(ts_ms, seq)) AS open, max(value) AS high, min(value) AS low, arg_max(value, row(ts_ms, seq)) AS close FROM t GROUP BY 1, 2")
def k_ts_ohlc(spark, sf_dir):
    return series.candles(_samples(spark, sf_dir), 86_400_000)


@_query("k_ts_retention", _TS + "SELECT key, ts_ms, value, seq FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts_ms DESC, seq DESC) AS n FROM t) WHERE n <= 100")
def k_ts_retention(spark, sf_dir):
    return series.retained(_samples(spark, sf_dir), 100)


@_query("k_ts_accept", _TS + "SELECT key, ts_ms, value, seq FROM (SELECT *, max(ts_ms) OVER (PARTITION BY key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM t) WHERE m IS NULL OR ts_ms >= m")
def k_ts_accept(spark, sf_dir):
    return series.accepted(_samples(spark, sf_dir))


@_query("k_ts_last", _TS + "SELECT key, max(ts_ms) AS ts_ms, arg_max(value, row(ts_ms, seq)) AS value FROM t GROUP BY 1")
def k_ts_last(spark, sf_dir):
    return series.last(_samples(spark, sf_dir))


@_query("k_xrange", f"SELECT event_type AS key, (epoch_us(ts) // 1000) AS ms, event_id AS seq FROM events WHERE (epoch_us(ts) // 1000) BETWEEN {NOW} AND {NOW + 3_600_000}")
def k_xrange(spark, sf_dir):
    return streams.between(_entries(spark, sf_dir), str(NOW), str(NOW + 3_600_000)).drop("fields")


@_query("k_xrevrange_count", "SELECT key, ms, seq FROM (SELECT event_type AS key, (epoch_us(ts) // 1000) AS ms, event_id AS seq, row_number() OVER (PARTITION BY event_type ORDER BY (epoch_us(ts) // 1000) DESC, event_id DESC) AS n FROM events) WHERE n <= 5")
def k_xrevrange_count(spark, sf_dir):
    return streams.between(_entries(spark, sf_dir), "-", "+", count=5, reverse=True).drop("fields")


@_query("k_xread", f"SELECT event_type AS key, (epoch_us(ts) // 1000) AS ms, event_id AS seq FROM events WHERE event_type IN ('click', 'view') AND (epoch_us(ts) // 1000) > {NOW}")
def k_xread(spark, sf_dir):
    cursors = spark.createDataFrame([("click", NOW, streams.LAST), ("view", NOW, streams.LAST)], "key string, after_ms long, after_seq long")
    return streams.after(_entries(spark, sf_dir), cursors).drop("fields")


@_query("k_xadd_ids", "WITH a AS (SELECT event_type AS key, event_id AS arrival, max((epoch_us(ts) // 1000)) OVER (PARTITION BY event_type ORDER BY event_id) AS ms FROM events) SELECT key, arrival, ms, (row_number() OVER (PARTITION BY key, ms ORDER BY arrival) - 1)::INTEGER AS seq FROM a")
def k_xadd_ids(spark, sf_dir):
    return streams.numbered(_entries(spark, sf_dir).select("key", F.col("ms").alias("at_ms"), F.col("seq").alias("arrival")))


@_query("k_xinfo", "SELECT event_type AS key, count(*) AS length, min((epoch_us(ts) // 1000)) AS first_ms, max((epoch_us(ts) // 1000)) AS last_ms FROM events GROUP BY 1")
def k_xinfo(spark, sf_dir):
    return streams.info(_entries(spark, sf_dir)).select("key", "length", F.col("first.ms").alias("first_ms"), F.col("last.ms").alias("last_ms"))


def group_log(spark, sf_dir) -> DataFrame:
    """Every event is added to its type's stream and read by its user at once; those with value above 30 are acknowledged."""
    e = _entries(spark, sf_dir).join(read_table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), "value"), "seq")
    user = F.col("fields")["user"]
    base = [F.col("key").alias("stream"), F.lit("g").alias("grp")]
    ids = [F.col("seq").alias("ms"), F.lit(0).cast("long").alias("seq")]
    at = lambda k: (3 * F.col("seq") + k).alias("at")
    n = F.lit(1).cast("long").alias("n")
    none = F.lit(None).cast("string").alias("consumer")
    add = e.select(*base, at(0), F.lit("add").alias("op"), none, *ids, n)
    read = e.select(*base, at(1), F.lit("read").alias("op"), user.alias("consumer"), *ids, n)
    ack = e.filter("value > 30").select(*base, at(2), F.lit("ack").alias("op"), none, *ids, n)
    return add.unionByName(read).unionByName(ack)


@_query("k_consumer_groups", "SELECT event_type AS stream, 'g' AS grp, event_id AS ms, 0::BIGINT AS seq, user_id::VARCHAR AS consumer, 3 * event_id + 1 AS since, 1::BIGINT AS deliveries FROM events WHERE NOT value > 30")
def k_consumer_groups(spark, sf_dir):
    return streams.fold_groups(group_log(spark, sf_dir))


_STATE = "WITH p AS (SELECT event_type AS stream, event_id AS ms, user_id::VARCHAR AS consumer, 3 * event_id + 1 AS since FROM events WHERE NOT value > 30) "
_NOW = 10_000_000


def _state(spark, sf_dir) -> DataFrame:
    return stored(streams.fold_groups(group_log(spark, sf_dir)), "group-state")


@_query("k_xpending", _STATE + "SELECT stream, count(*) AS pending, min(ms) AS first_ms, max(ms) AS last_ms, count(DISTINCT consumer)::INTEGER AS consumers FROM p GROUP BY 1")
def k_xpending(spark, sf_dir):
    rows = streams.pending_summary(_state(spark, sf_dir))
    return rows.select("stream", "pending", F.col("first.ms").alias("first_ms"), F.col("last.ms").alias("last_ms"), F.size("consumers").alias("consumers"))


@_query(
    "k_xpending_range",
    _STATE + f"SELECT stream, ms, consumer, {_NOW} - since AS idle FROM (SELECT *, row_number() OVER (PARTITION BY stream ORDER BY ms) AS n FROM p WHERE ms >= 100 AND {_NOW} - since >= 9990000) WHERE n <= 7",
)
def k_xpending_range(spark, sf_dir):
    rows = streams.pending_range(_state(spark, sf_dir), _NOW, start="100", count=7, min_idle=9_990_000)
    return rows.select("stream", "ms", "consumer", "idle")


@_query(
    "k_xclaim",
    _STATE + f"SELECT event_type AS stream, event_id AS ms, CASE WHEN won THEN 'heir' ELSE user_id::VARCHAR END AS consumer, CASE WHEN won THEN {_NOW - 5} ELSE 3 * event_id + 1 END::BIGINT AS since, "
    "CASE WHEN won AND held THEN 2 ELSE 1 END::BIGINT AS deliveries, won AS claimed FROM (SELECT *, NOT value > 30 AS held, "
    f"event_id % 10 = 0 AND (value > 30 OR {_NOW} - (3 * event_id + 1) >= 9990000) AS won FROM events WHERE event_id % 70 <> 0) WHERE held OR won "
    "UNION ALL SELECT event_type, event_id, user_id::VARCHAR, 3 * event_id + 1, 1, false FROM events WHERE false",
)
def k_xclaim(spark, sf_dir):
    """Every tenth id is asked for, with FORCE and IDLE; every seventieth is no longer in its stream."""
    log = group_log(spark, sf_dir).filter("op = 'add'").select("stream", "grp", "ms", "seq")
    asked = log.filter("ms % 10 = 0").withColumn("consumer", F.lit("heir"))
    entries = log.filter("ms % 70 <> 0")
    rows = streams.claimed(_state(spark, sf_dir), asked, _NOW, min_idle=9_990_000, force=True, idle=5, entries=entries)
    return rows.select("stream", "ms", "consumer", "since", "deliveries", "claimed")


@_query(
    "k_xautoclaim",
    _STATE + f", q AS (SELECT *, row_number() OVER (PARTITION BY stream ORDER BY ms) AS n, {_NOW} - since >= 9990000 AS hit FROM p WHERE ms >= 50), "
    "s AS (SELECT *, n <= 50 AND coalesce(sum(hit::INTEGER) OVER (PARTITION BY stream ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 5 AS seen FROM q WHERE n <= 51) "
    "SELECT stream, count(*) FILTER (seen AND hit)::INTEGER AS claimed, max(ms) FILTER (seen AND hit) AS last_ms, coalesce(min(ms) FILTER (NOT seen), 0) AS next_ms FROM s GROUP BY 1",
)
def k_xautoclaim(spark, sf_dir):
    rows = streams.auto_claimed(_state(spark, sf_dir), "heir", _NOW, min_idle=9_990_000, start="50", count=5)
    return rows.select("stream", F.size("claimed").alias("claimed"), F.try_element_at("claimed", F.lit(-1))["ms"].alias("last_ms"), F.col("next.ms").alias("next_ms"))


@_query("k_xinfo_groups", "SELECT event_type AS stream, 'g' AS grp, count(DISTINCT user_id) AS consumers, count(*) FILTER (NOT value > 30) AS pending, max(event_id) AS last_ms FROM events GROUP BY 1")
def k_xinfo_groups(spark, sf_dir):
    rows = streams.group_info(group_log(spark, sf_dir), _state(spark, sf_dir))
    return rows.select("stream", "grp", "consumers", "pending", F.col("last.ms").alias("last_ms"))


@_query("k_xinfo_consumers", f"SELECT event_type AS stream, user_id::VARCHAR AS consumer, count(*) FILTER (NOT value > 30) AS pending, {_NOW} - max(3 * event_id + 1) AS idle FROM events GROUP BY 1, 2")
def k_xinfo_consumers(spark, sf_dir):
    return streams.consumer_info(group_log(spark, sf_dir), _state(spark, sf_dir), _NOW).select("stream", "consumer", "pending", "idle")


@_query("k_xtrim", "SELECT event_type AS key, event_id AS seq FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY epoch_us(ts) // 1000 DESC, event_id DESC) AS n FROM events) WHERE n <= 25")
def k_xtrim(spark, sf_dir):
    return streams.trimmed(_entries(spark, sf_dir), 25).select("key", "seq")


@_query("k_pubsub", "SELECT event_id AS message_id, (CASE WHEN event_type = 'click' THEN 1 ELSE 0 END + CASE WHEN event_type LIKE 'p%' THEN 2 ELSE 0 END + CASE WHEN event_type LIKE '_____' THEN 1 ELSE 0 END)::BIGINT AS deliveries FROM events")
def k_pubsub(spark, sf_dir):
    rows = [("a", "click", None), ("b", None, "p*"), ("c", None, "p*"), ("d", None, "?????")]
    subscriptions = spark.createDataFrame(rows, "subscriber string, channel string, pattern string")
    return streams.delivered(read_table(spark, sf_dir, "events").select(F.col("event_id").alias("message_id"), F.col("event_type").alias("channel")), subscriptions)


@_query("k_glob_match", "SELECT c_custkey, regexp_full_match(c_name, 'Customer#.*[13579]') AS odd FROM customer")
def k_glob_match(spark, sf_dir):
    return read_table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").rlike(glob.regex("Customer#*[13579]")).alias("odd"))
