"""Streams of entries (key, ms, seq, fields), consumer groups and published messages."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomwork.functions import glob
from loomwork.session import sized, stored

LAST = (1 << 63) - 1


def _id() -> Column:
    return F.struct("ms", "seq")


def numbered(appends: DataFrame) -> DataFrame:
    """Ids for appended entries (key, at_ms, arrival): strictly rising within a key, never behind the clock's last reading.

    The time of an entry is the latest so far; entries of one time are numbered from 0.
    """
    by = W.partitionBy("key").orderBy("arrival")
    rows = appends.withColumn("ms", F.max("at_ms").over(by.rowsBetween(W.unboundedPreceding, 0)))
    return rows.withColumn("seq", F.row_number().over(W.partitionBy("key", "ms").orderBy("arrival")) - 1).drop("at_ms")


def bound(text: str, low: bool) -> tuple[int, int]:
    """An id from text; without a number after the dash it is the first or last of its time. - and + are the ends."""
    if text in ("-", "+"):
        return (0, 0) if text == "-" else (LAST, LAST)
    ms, _, seq = text.partition("-")
    return int(ms), int(seq) if seq else 0 if low else LAST


def between(entries: DataFrame, start: str, stop: str, *, count: int | None = None, reverse: bool = False) -> DataFrame:
    """Inclusive range of ids in order; ``count`` applies to each key."""
    low, high = bound(start, True), bound(stop, False)
    at = lambda p: F.struct(F.lit(p[0]).cast("long").alias("ms"), F.lit(p[1]).cast("long").alias("seq"))
    rows = entries.filter((_id() >= at(low)) & (_id() <= at(high)))
    if count is None:
        return rows
    order = [F.col("ms").desc(), F.col("seq").desc()] if reverse else [F.col("ms"), F.col("seq")]
    return rows.withColumn("__n", F.row_number().over(W.partitionBy("key").orderBy(*order))).filter(F.col("__n") <= count).drop("__n")


def after(entries: DataFrame, cursors: DataFrame) -> DataFrame:
    """Entries of several streams after the (key, after_ms, after_seq) cursor of each."""
    return entries.join(cursors, "key").filter(_id() > F.struct(F.col("after_ms").alias("ms"), F.col("after_seq").alias("seq"))).drop("after_ms", "after_seq")


def trimmed(entries: DataFrame, most: int) -> DataFrame:
    """The last ``most`` entries of each stream."""
    place = F.row_number().over(W.partitionBy("key").orderBy(F.col("ms").desc(), F.col("seq").desc()))
    return entries.withColumn("__n", place).filter(F.col("__n") <= most).drop("__n")


def info(entries: DataFrame) -> DataFrame:
    """Length, first and last id of each stream."""
    return entries.groupBy("key").agg(F.count(F.lit(1)).alias("length"), F.min(_id()).alias("first"), F.max(_id()).alias("last"))


@dataclass
class Pending:
    consumer: str
    since: int
    deliveries: int


@dataclass
class Group:
    """State of one consumer group: what was read up to, and what is delivered but not acknowledged."""

    cursor: tuple[int, int] = (0, -1)
    pending: dict[tuple[int, int], Pending] = field(default_factory=dict)
    consumers: dict[str, int] = field(default_factory=dict)

    def read_new(self, entries: list[tuple[int, int]], consumer: str, now: int, count: int | None = None, acknowledge: bool = False) -> list[tuple[int, int]]:
        self.consumers[consumer] = now
        fresh = [e for e in entries if e > self.cursor][:count]
        if fresh:
            self.cursor = fresh[-1]
        if not acknowledge:
            for e in fresh:
                self.pending[e] = Pending(consumer, now, 1)
        return fresh

    def read_history(self, consumer: str, now: int, start: tuple[int, int] = (0, -1), count: int | None = None) -> list[tuple[int, int]]:
        self.consumers[consumer] = now
        mine = sorted(e for e, p in self.pending.items() if p.consumer == consumer and e > start)[:count]
        for e in mine:
            self.pending[e].since, self.pending[e].deliveries = now, self.pending[e].deliveries + 1
        return mine

    def acknowledge(self, ids: list[tuple[int, int]]) -> int:
        return sum(self.pending.pop(e, None) is not None for e in ids)

    def summary(self) -> tuple[int, dict[str, int]]:
        by: dict[str, int] = {}
        for p in self.pending.values():
            by[p.consumer] = by.get(p.consumer, 0) + 1
        return len(self.pending), by

    def waiting(self, now: int, *, min_idle: int = 0, consumer: str | None = None) -> list[tuple[tuple[int, int], Pending]]:
        return [(e, p) for e, p in sorted(self.pending.items()) if now - p.since >= min_idle and consumer in (None, p.consumer)]

    def claim(
        self, ids: list[tuple[int, int]], consumer: str, now: int, *, min_idle: int = 0, force: bool = False, just_id: bool = False,
        retries: int | None = None, idle: int | None = None, there: set[tuple[int, int]] | None = None,
    ) -> list[tuple[int, int]]:
        """Ids that change hands: pending ones idle for long enough, or any entry there is with ``force``; trimmed ones are dropped."""
        out = []
        for e in ids:
            p = self.pending.get(e)
            if there is not None and e not in there:
                self.pending.pop(e, None)
                continue
            if p is None and not force or p is not None and now - p.since < min_idle:
                continue
            deliveries = retries if retries is not None else (p.deliveries if p else 0) + (not just_id)
            self.pending[e] = Pending(consumer, now - (idle or 0), deliveries)
            self.consumers[consumer] = now
            out.append(e)
        return out

    def auto_claim(self, consumer: str, now: int, *, min_idle: int, start: tuple[int, int] = (0, 0), count: int = 100, there=None):
        """(claimed, next start): looks at no more than ten times ``count`` pending ids; those that are trimmed are dropped and counted too."""
        waiting = [e for e in sorted(self.pending) if e >= start]
        claimed: list[tuple[int, int]] = []
        dropped = 0
        for i, e in enumerate(waiting[: 10 * count]):
            if len(claimed) + dropped == count:
                return claimed, e
            dropped += there is not None and e not in there
            claimed += self.claim([e], consumer, now, min_idle=min_idle, there=there)
            last = i
        rest = waiting[last + 1 :] if waiting else []
        return claimed, rest[0] if rest else (0, 0)


EVENTS = "stream string, grp string, at long, op string, consumer string, ms long, seq long, n long"
STATE = "stream string, grp string, ms long, seq long, consumer string, since long, deliveries long"


def apply_event(group: Group, entries: list[tuple[int, int]], op: str, consumer: str, at: int, ms: int, seq: int, n: int | None) -> None:
    """One event of a group's log: add, read, history, ack, claim or setid."""
    if op == "add":
        entries.append((ms, seq))
    elif op == "read":
        group.read_new(entries, consumer, at, n)
    elif op == "history":
        group.read_history(consumer, at, count=n)
    elif op == "ack":
        group.acknowledge([(ms, seq)])
    elif op == "claim":
        group.claim([(ms, seq)], consumer, at, min_idle=n or 0)
    elif op == "setid":
        group.cursor = (ms, seq)
    else:
        raise ValueError(f"unknown event {op!r}")


def fold_groups(events: DataFrame) -> DataFrame:
    """Pending entries that a log of group events leaves, for each (stream, grp); events apply in order of time and id.

    Logs are sorted on disk and streamed; a task holds what is unread and
    pending in one group at a time.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, group, entries = None, Group(), []

        def left() -> pd.DataFrame:
            out = [(*key, *e, p.consumer, p.since, p.deliveries) for e, p in sorted(group.pending.items())] if key else []
            return pd.DataFrame(out, columns=["stream", "grp", "ms", "seq", "consumer", "since", "deliveries"])

        for rows in batches:
            for r in rows.itertuples():
                if (r.stream, r.grp) != key:
                    yield left()
                    key, group, entries = (r.stream, r.grp), Group(), []
                apply_event(group, entries, r.op, r.consumer, int(r.at), int(r.ms), int(r.seq), None if pd.isna(r.n) else int(r.n))
                if r.op == "read":
                    entries = [e for e in entries if e > group.cursor]
        yield left()

    order = ["stream", "grp", "at", "ms", "seq"]
    return events.repartition("stream", "grp").sortWithinPartitions(*order).mapInPandas(run, STATE)


_ENTRY = ["stream", "grp", "ms", "seq"]


def pending_summary(state: DataFrame) -> DataFrame:
    """Of each group's pending entries: their number, first and last id, and how many each consumer has."""
    by = state.groupBy("stream", "grp", "consumer").agg(F.count(F.lit(1)).alias("n"), F.min(_id()).alias("first"), F.max(_id()).alias("last"))
    held = F.map_from_entries(F.array_sort(F.collect_list(F.struct("consumer", "n")))).alias("consumers")
    return by.groupBy("stream", "grp").agg(F.sum("n").alias("pending"), F.min("first").alias("first"), F.max("last").alias("last"), held)


def pending_range(state: DataFrame, now: int, *, start: str = "-", stop: str = "+", count: int | None = None, consumer: str | None = None, min_idle: int = 0) -> DataFrame:
    """Pending entries of a range of ids with their idle time, the first ``count`` of each group."""
    rows = between(state.withColumn("idle", F.lit(now) - F.col("since")).filter(F.col("idle") >= min_idle), start, stop)
    rows = rows.filter(F.col("consumer") == consumer) if consumer is not None else rows
    if count is None:
        return rows
    return rows.withColumn("__n", F.row_number().over(W.partitionBy("stream", "grp").orderBy("ms", "seq"))).filter(F.col("__n") <= count).drop("__n")


def claimed(
    state: DataFrame, asked: DataFrame, now: int, *, min_idle: int = 0, force: bool = False, just_id: bool = False,
    retries: int | None = None, idle: int = 0, entries: DataFrame | None = None,
) -> DataFrame:
    """The pending entries after a claim of (stream, grp, ms, seq, consumer), with a column ``claimed``.

    Entries change hands if they are pending and idle for long enough, or, with
    ``force``, if nobody holds them. With ``entries`` (stream, ms, seq), asked
    ids that are no longer there leave the pending ones.
    """
    both = state.join(asked.withColumnRenamed("consumer", "__to"), _ENTRY, "full")
    there = F.lit(True)
    if entries is not None:
        both = both.join(entries.select("stream", "ms", "seq", F.lit(True).alias("__there")), ["stream", "ms", "seq"], "left")
        there = F.coalesce("__there", F.lit(False))
    held, wanted = F.col("since").isNotNull(), F.col("__to").isNotNull()
    won = wanted & there & F.when(held, F.lit(now) - F.col("since") >= min_idle).otherwise(F.lit(force))
    deliveries = F.lit(retries) if retries is not None else F.coalesce("deliveries", F.lit(0)) + int(not just_id)
    rows = both.filter((held | won) & ~(wanted & ~there)).withColumn("claimed", won)
    return rows.select(
        *_ENTRY, F.when(F.col("claimed"), F.col("__to")).otherwise(F.col("consumer")).alias("consumer"),
        F.when(F.col("claimed"), F.lit(now - idle)).otherwise(F.col("since")).cast("long").alias("since"),
        F.when(F.col("claimed"), deliveries).otherwise(F.col("deliveries")).cast("long").alias("deliveries"), "claimed",
    )


def auto_claimed(state: DataFrame, consumer: str, now: int, *, min_idle: int, start: str = "-", count: int = 100, entries: DataFrame | None = None) -> DataFrame:
    """Of each group (stream, grp): the ids claimed, those dropped as they are trimmed, and where the next sweep starts (0-0 at the end).

    A sweep looks at the first ten times ``count`` pending ids from ``start``
    and ends after ``count`` claimed or dropped ones, so only so many rows of a
    group are ranked, however many it has.
    """
    order = W.partitionBy("stream", "grp").orderBy("ms", "seq")
    rows = between(state, start, "+").withColumn("__n", F.row_number().over(order)).filter(F.col("__n") <= 10 * count + 1)
    there = F.lit(True)
    if entries is not None:
        rows = rows.join(entries.select("stream", "ms", "seq", F.lit(True).alias("__there")), ["stream", "ms", "seq"], "left")
        there = F.coalesce("__there", F.lit(False))
    rows = rows.withColumn("there", there).withColumn("hit", (~there | (F.lit(now) - F.col("since") >= min_idle)).cast("int"))
    rows = rows.withColumn("before", F.coalesce(F.sum("hit").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    seen = (F.col("before") < count) & (F.col("__n") <= 10 * count)
    ids = lambda test: F.array_sort(F.collect_list(F.when(seen & test, _id())))
    out = rows.groupBy("stream", "grp").agg(
        ids((F.col("hit") == 1) & F.col("there")).alias("claimed"), ids(~F.col("there")).alias("deleted"), F.min(F.when(~seen, _id())).alias("next")
    )
    none = F.struct(F.lit(0).cast("long").alias("ms"), F.lit(0).cast("long").alias("seq"))
    return out.withColumn("next", F.coalesce("next", none)).withColumn("consumer", F.lit(consumer))


def group_info(events: DataFrame, state: DataFrame) -> DataFrame:
    """Of each group in a log without setid: its consumers, pending entries and the last id that was delivered."""
    done = events.filter(F.col("op").isin("read", "history", "claim"))
    consumers = done.groupBy("stream", "grp").agg(F.countDistinct("consumer").alias("consumers"), F.max(F.when(F.col("op") == "read", _id())).alias("last"))
    pending = state.groupBy("stream", "grp").agg(F.count(F.lit(1)).alias("pending"))
    return consumers.join(pending, ["stream", "grp"], "left").withColumn("pending", F.coalesce("pending", F.lit(0)))


def consumer_info(events: DataFrame, state: DataFrame, now: int) -> DataFrame:
    """Of each consumer: its pending entries and the time since it last did anything."""
    by = ["stream", "grp", "consumer"]
    seen = events.filter(F.col("op").isin("read", "history", "claim")).groupBy(*by).agg((F.lit(now) - F.max("at")).alias("idle"))
    pending = state.groupBy(*by).agg(F.count(F.lit(1)).alias("pending"))
    return seen.join(pending, by, "left").withColumn("pending", F.coalesce("pending", F.lit(0)))


def delivered(messages: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """(message_id, deliveries): subscriptions (subscriber, channel, pattern) that each message's channel meets, 0 included.

    Exact subscriptions meet messages by equality; patterns, which are glob
    texts, are matched against the distinct channels only.
    """

    def compiled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield rows.assign(regex=[glob.regex(p) for p in rows["pattern"]])

    exact = messages.join(subscriptions.filter("channel is not null").select("subscriber", "channel"), "channel").select("message_id")
    patterns = subscriptions.filter("pattern is not null").groupBy("pattern").agg(F.count(F.lit(1)).alias("times"))
    patterns = sized(patterns.mapInPandas(compiled, "pattern string, times long, regex string"), 10_000)
    met = messages.select("channel").distinct().join(patterns, F.call_function("rlike", F.col("channel"), F.col("regex")))
    met = met.groupBy("channel").agg(F.sum("times").alias("times"))
    by_pattern = messages.join(met, "channel").select("message_id", "times")
    out = exact.withColumn("times", F.lit(1).cast("long")).unionByName(by_pattern)
    counts = out.groupBy("message_id").agg(F.sum("times").alias("deliveries"))
    return messages.select("message_id").join(counts, "message_id", "left").select("message_id", F.coalesce("deliveries", F.lit(0)).alias("deliveries"))
