"""Structured Streaming forms: tumbling buckets and consumer-group state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from loomwork.operators import streams


def buckets(events: DataFrame, width: str, *, late: str = "0 seconds", time: str = "ts", key: str = "key", value: str = "value") -> DataFrame:
    """Tumbling buckets of a stream with open, high, low, close, sum and count; samples later than the watermark are dropped."""
    rows = events.withWatermark(time, late)
    at = F.struct(F.col(time), F.col("seq")) if "seq" in events.columns else F.col(time)
    return (
        rows.groupBy(F.window(time, width), F.col(key).alias("key"))
        .agg(
            F.min_by(value, at).alias("open"), F.max(value).alias("high"), F.min(value).alias("low"), F.max_by(value, at).alias("close"),
            F.sum(value).alias("sum"), F.count(value).cast("double").alias("count"),
        )
        .select("key", F.col("window.start").alias("bucket"), "open", "high", "low", "close", "sum", "count")
    )


_STATE = "cursor_ms long, cursor_seq long, entries array<struct<ms:long,seq:long>>, pending array<struct<ms:long,seq:long,consumer:string,since:long,deliveries:long>>"


def group_pending(events: DataFrame) -> DataFrame:
    """Pending entries of each (stream, grp) after every batch of group events, from state that survives restarts."""

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        group, entries = streams.Group(), []
        if state.exists:
            ms, seq, held, pending = state.get
            group.cursor = (ms, seq)
            entries = [(int(e[0]), int(e[1])) for e in held]
            group.pending = {(int(p[0]), int(p[1])): streams.Pending(p[2], int(p[3]), int(p[4])) for p in pending}
        rows = pd.concat([*batches]).sort_values(["at", "ms", "seq"], kind="stable")
        for r in rows.itertuples():
            streams.apply_event(group, entries, r.op, r.consumer, int(r.at), int(r.ms), int(r.seq), None if pd.isna(r.n) else int(r.n))
        # what is read and acknowledged need not be kept
        entries = [e for e in entries if e > group.cursor]
        left = [(*e, p.consumer, p.since, p.deliveries) for e, p in sorted(group.pending.items())]
        state.update((*group.cursor, entries, left))
        out = [(*key, *x) for x in left] or [(*key, None, None, None, None, None)]
        yield pd.DataFrame(out, columns=["stream", "grp", "ms", "seq", "consumer", "since", "deliveries"]).astype({"ms": "Int64", "seq": "Int64", "since": "Int64", "deliveries": "Int64"})

    return events.groupBy("stream", "grp").applyInPandasWithState(run, streams.STATE, _STATE, "update", GroupStateTimeout.NoTimeout)


def run_once(df: DataFrame, name: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Everything there is now, into a table in memory."""
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def publish(messages: DataFrame, subscriptions: DataFrame, deliver, checkpoint: str) -> StreamingQuery:
    """Each batch of messages is matched with the subscriptions and given to ``deliver(counts)``; its failures are kept apart from the stream."""

    def batch(rows: DataFrame, _: int) -> None:
        counts = streams.delivered(rows, subscriptions)
        try:
            deliver(counts)
        except Exception as problem:  # a handler's failure must not end the stream
            print(f"handler failed: {problem}")

    return messages.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
