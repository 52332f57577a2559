"""Groups of alike vectors, and vectors of texts by hashing."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.operators import vectors
from loomwork.session import stored

#: Words without weight in a text's vector.
STOP_WORDS = frozenset("a an and are as at be but by for from has have in is it its of on or that the this to was were will with".split())


def connected(links: DataFrame) -> DataFrame:
    """(id, root) for all ids of links (a, b): the least id that links lead to.

    Labels spread along links and jump to their own labels, so the number of
    rounds grows with the logarithm of the longest chain. Each round is written
    to the shared folder.
    """
    both = stored(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a != b").distinct(), "links")
    labels = stored(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("root")), "labels")
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), "root"), "b").groupBy("a").agg(F.min("root").alias("m"))
        spread = labels.join(near, labels.id == near.a).select("id", F.least("root", "m").alias("root"), F.col("root").alias("old"))
        spread = stored(spread, "labels")
        jumped = spread.join(spread.select(F.col("id").alias("root"), F.col("root").alias("further")), "root", "left")
        jumped = stored(jumped.select("id", F.least("root", F.coalesce("further", "root")).alias("root"), "old"), "labels")
        labels = jumped.select("id", "root")
        if jumped.filter("root != old").isEmpty():
            return labels


def near_duplicates(base: DataFrame, threshold: float = 0.95) -> DataFrame:
    """(id, root) of all vectors: ids joined by cosines above a threshold share a root."""
    found = vectors.radius(base, base, threshold, "cosine").filter(F.col("query_id") < F.col("id"))
    roots = connected(found.select(F.col("query_id").alias("a"), F.col("id").alias("b")))
    return base.select("id").join(roots, "id", "left").select("id", F.coalesce("root", "id").alias("root"))


def _fnv(token: str) -> int:
    value = 2166136261
    for byte in token.encode():
        value = (value ^ byte) * 16777619 & 0xFFFFFFFF
    value ^= value >> 16
    return value * 0x45D9F3B & 0xFFFFFFFF


def embed(text: str, size: int = 256) -> np.ndarray:
    """Words that aren't stop words, hashed to signed components with weight 1 + log of their count, at unit length."""
    out = np.zeros(size)
    for word, n in Counter(w for w in re.findall(r"\w+", text.lower()) if w not in STOP_WORDS and len(w) > 1).items():
        h = _fnv(word)
        out[h % size] += (1 if h >> 31 else -1) * (1 + np.log(n))
    norm = np.linalg.norm(out)
    return out / norm if norm else out


def embedded(texts: DataFrame, size: int = 256) -> DataFrame:
    """(id, v) of texts (id, text), batch by batch; null counts as empty."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            rows = [embed(t or "", size) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tolist() for r in rows], pa.list_(pa.float64()))], ["id", "v"])

    return texts.select(F.col("id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "id long, v array<double>")
