"""Approximate vector indexes as tables: cells, codes, transforms, refinement, graphs, and a factory for their names."""

from __future__ import annotations

import heapq
import json
import pickle
import re
from collections.abc import Callable
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.operators import quantizers as Q
from loomwork.operators import vectors
from loomwork.session import stored

_FOUND = "query_id long, id long, distance double"


def _to_matrix(column, size: int) -> np.ndarray:
    flat = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, size) if len(flat) else np.zeros((0, size))


@dataclass
class MultiIndex:
    """Coarse cells as pairs of the centroids of two halves; cells in order of the summed distances."""

    halves: tuple[np.ndarray, np.ndarray]

    @property
    def cells(self) -> int:
        return len(self.halves[0]) * len(self.halves[1])

    def assign(self, x: np.ndarray) -> np.ndarray:
        half = self.halves[0].shape[1]
        return Q.assign(x[:, :half], self.halves[0]) * len(self.halves[1]) + Q.assign(x[:, half:], self.halves[1])

    def nearest(self, x: np.ndarray, probes: int) -> np.ndarray:
        half, out = self.halves[0].shape[1], []
        for row in x:
            a, b = (((c - part) ** 2).sum(1) for c, part in zip(self.halves, (row[:half], row[half:]), strict=True))
            i, j = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
            heap, seen, cells = [(a[i[0]] + b[j[0]], 0, 0)], {(0, 0)}, []
            while heap and len(cells) < probes:
                _, p, q = heapq.heappop(heap)
                cells.append(i[p] * len(b) + j[q])
                for n in ((p + 1, q), (p, q + 1)):
                    if n not in seen and n[0] < len(a) and n[1] < len(b):
                        seen.add(n)
                        heapq.heappush(heap, (a[i[n[0]]] + b[j[n[1]]], *n))
            out.append(cells)
        return np.asarray(out)

    def centre(self, cell: int) -> np.ndarray:
        return np.concatenate([self.halves[0][cell // len(self.halves[1])], self.halves[1][cell % len(self.halves[1])]])


@dataclass
class Centroids:
    """Coarse cells by nearest centroid; any object with these four members can stand in."""

    points: np.ndarray

    @property
    def cells(self) -> int:
        return len(self.points)

    def assign(self, x: np.ndarray) -> np.ndarray:
        return Q.assign(x, self.points)

    def nearest(self, x: np.ndarray, probes: int) -> np.ndarray:
        far = (self.points**2).sum(1)[None] - 2 * x @ self.points.T
        return np.argsort(far, axis=1, kind="stable")[:, :probes]

    def centre(self, cell: int) -> np.ndarray:
        return self.points[cell]


def in_blocks(rows: DataFrame, asked: DataFrame, *, most: int = 20_000, most_asked: int = 5_000):
    """Rows and queries of a cell, both cut in blocks by their ids; every block of rows meets every block of queries."""
    count = lambda df, most_, name: df.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / most_).cast("int").alias(name))
    sizes = stored(count(rows, most, "n").join(count(asked, most_asked, "m"), "cell"), "cell-sizes")
    own = lambda name, seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.col(name)).cast("int")
    each = lambda name: F.explode(F.sequence(F.lit(0), F.col(name) - 1))
    left = rows.join(sizes, "cell").withColumn("i", own("n", 0)).withColumn("j", each("m")).drop("n", "m")
    right = asked.join(sizes, "cell").withColumn("j", own("m", 1)).withColumn("i", each("n")).drop("n", "m")
    return left.groupBy("cell", "i", "j").cogroup(right.groupBy("cell", "i", "j"))


@dataclass
class CellIndex:
    """Rows (cell, id, v or codes) under a coarse quantizer; codes hold residuals of ``encoder``, or vectors as they are."""

    coarse: object
    size: int
    encoder: object | None = None
    residual: bool = True
    metric: str = "l2"
    table: DataFrame | None = None

    def add(self, rows: DataFrame) -> CellIndex:
        """The index with more rows; encoding is one pass without a shuffle."""
        coarse, encoder, size, residual = self.coarse, self.encoder, self.size, self.residual

        def run(batches):
            import pyarrow as pa

            for batch in batches:
                x = _to_matrix(batch.column(1), size)
                cell = coarse.assign(x) if len(x) else np.zeros(0, int)
                kept = x
                if encoder is not None and len(x):
                    base = np.stack([coarse.centre(c) for c in cell]) if residual else 0
                    kept = encoder.encode(x - base).astype(float)
                width = kept.shape[1] if len(x) else 1
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, kept.size + 1, width, dtype=np.int32)), pa.array(kept.ravel().astype(np.float32)))
                yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), batch.column(0), lists], ["cell", "id", "codes"])

        new = rows.select(F.col("id").cast("long"), "v").mapInArrow(run, "cell int, id long, codes array<float>")
        return replace(self, table=stored(new if self.table is None else self.table.unionByName(new), "cells"))

    def remove(self, where: Column) -> CellIndex:
        return replace(self, table=self.table.filter(~where))

    def statistics(self) -> DataFrame:
        """Least, greatest and mean size of the cells that hold rows, and the number of those that don't."""
        n = self.table.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
        return n.agg(F.min("n").alias("min"), F.max("n").alias("max"), F.avg("n").alias("mean"), (F.lit(self.coarse.cells) - F.count(F.lit(1))).alias("empty"))

    def _found(self, queries: DataFrame, probes: int, where: Column | None, keep: Callable) -> DataFrame:
        coarse, encoder, size, residual, metric = self.coarse, self.encoder, self.size, self.residual, self.metric
        probes = max(1, min(probes, coarse.cells))

        def probed(batches):
            import pyarrow as pa

            for batch in batches:
                x = _to_matrix(batch.column(1), size)
                cells = np.zeros((0, 1), int)
                if len(x) and metric == "ip" and isinstance(coarse, Centroids):
                    cells = np.argsort(-(x @ coarse.points.T), axis=1, kind="stable")[:, :probes]
                elif len(x):
                    cells = coarse.nearest(x, probes)
                at = pa.array(np.repeat(np.arange(len(x)), cells.shape[1]))
                yield pa.RecordBatch.from_arrays([pa.array(cells.ravel().astype(np.int32)), batch.column(0).take(at), batch.column(1).take(at)], ["cell", "id", "v"])

        def search(key, mine, asked):
            import pyarrow as pa

            schema = pa.schema([("query_id", pa.int64()), ("id", pa.int64()), ("distance", pa.float64())])
            if not mine.num_rows or not asked.num_rows:
                return schema.empty_table()
            mine = mine.sort_by("id").combine_chunks()
            ids = mine.column("id").to_numpy()
            stored_ = mine.column("codes").combine_chunks()
            codes = stored_.flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
            x = codes.astype(float)
            if encoder is not None:
                held = codes.astype(np.float16) if getattr(encoder, "kind", "") == "fp16" else codes.astype(int)
                x = encoder.decode(held) + (coarse.centre(key[0].as_py()) if residual else 0)
            out = []
            for query, q in zip(asked.column("id").to_numpy(), _to_matrix(asked.column("v"), size), strict=True):
                d = vectors._exact(metric, q[None], x)
                at = keep(d)
                out.append((np.full(len(at), query), ids[at], d[at]))
            return pa.table([np.concatenate(c) for c in zip(*out, strict=True)], schema=schema)

        rows = self.table.filter(where) if where is not None else self.table
        asked = queries.select(F.col("id").cast("long"), "v").mapInArrow(probed, "cell int, id long, v array<double>")
        return in_blocks(rows.select("cell", "id", "codes"), asked).applyInArrow(search, _FOUND)

    def search(self, queries: DataFrame, k: int, *, probes: int = 1, where: Column | None = None) -> DataFrame:
        """The k nearest rows in each query's nearest cells; all cells give the exact answer over what is stored."""
        larger = self.metric in ("ip", "cosine")

        def keep(d: np.ndarray) -> np.ndarray:
            if len(d) <= k:
                return np.arange(len(d))
            near = -d if larger else d
            limit = np.partition(near, k - 1)[k - 1]
            return np.flatnonzero(near <= limit)

        return vectors.best(self._found(queries.select("id", F.col("v").cast("array<double>").alias("v")), probes, where, keep), k, self.metric)

    def radius(self, queries: DataFrame, limit: float, *, probes: int = 1, where: Column | None = None) -> DataFrame:
        larger = self.metric in ("ip", "cosine")
        return self._found(
            queries.select("id", F.col("v").cast("array<double>").alias("v")), probes, where, lambda d: np.flatnonzero(d > limit if larger else d < limit)
        )

    def save(self, path: str) -> None:
        """Rows as Parquet by cell, and the fitted parts beside them."""
        self.table.repartition("cell").sortWithinPartitions("cell", "id").write.mode("overwrite").parquet(f"{path}/rows")
        spark = self.table.sparkSession
        parts = pickle.dumps(replace(self, table=None))
        spark.createDataFrame([(bytearray(parts),)], "model binary").coalesce(1).write.mode("overwrite").parquet(f"{path}/model")

    @staticmethod
    def load(spark: SparkSession, path: str) -> CellIndex:
        """Read back what `save` wrote; the model is a pickle, so only from a trusted place."""
        model = pickle.loads(bytes(spark.read.parquet(f"{path}/model").first()[0]))
        return replace(model, table=spark.read.parquet(f"{path}/rows"))


@dataclass
class Graph:
    """A layered neighbour graph over vectors in memory, searched by beams of many queries at once.

    Points are ordered by their height, so each layer holds the first of them. A place without a link holds the
    point itself, which counts as seen. Beams are sorted 64-bit keys: squared distance, point, and whether it is opened.
    """

    x: np.ndarray
    links: int = 16
    beam: int = 64
    seed: int = 1
    layers: list[np.ndarray] = field(default_factory=list)
    order: np.ndarray | None = None
    opened: int = 8  # points of a beam that are opened at once
    batch: int = 128  # points inserted at once
    block: int = 256  # queries walked at once

    def __post_init__(self) -> None:
        x = np.asarray(self.x, float)
        self.centre = x.mean(0) if len(x) else np.zeros(x.shape[1])
        self.scale = float(np.abs(x - self.centre).max(initial=0)) or 1.0
        self.x = self._near_origin(x)
        self.square = np.einsum("ij,ij->i", self.x, self.x)

    def _near_origin(self, x: np.ndarray) -> np.ndarray:
        """Single precision is enough for walks around the centre of the points."""
        return np.clip((x - self.centre) / self.scale, -1e15, 1e15).astype(np.float32)

    def build(self) -> Graph:
        rng = np.random.default_rng(self.seed)
        heights = np.minimum((-np.log(rng.random(len(self.x))) / np.log(self.links)).astype(int), 8)
        self.order = np.argsort(-heights, kind="stable")
        self.x, self.square, heights = self.x[self.order], self.square[self.order], heights[self.order]
        for level in range(heights[0] if len(heights) else -1, -1, -1):
            self._add_layer(int((heights >= level).sum()))
        return self

    def flat_links(self) -> tuple[np.ndarray, np.ndarray]:
        """All links of each point, lowest layer first, and where those of each point end."""
        per_point = [np.concatenate([layer[i] for layer in reversed(self.layers) if i < len(layer)]) for i in range(len(self.x))]
        return np.concatenate(per_point), np.cumsum([len(p) for p in per_point])

    def restored(self, links: np.ndarray, ends: np.ndarray) -> Graph:
        """The graph of points that are in order already, from what `flat_links` gave."""
        width, starts = 2 * self.links, np.concatenate([[0], ends[:-1]])
        held = (ends - starts) // width
        self.layers = [links[starts[held > level][:, None] + level * width + np.arange(width)] for level in range(held.max(initial=0) - 1, -1, -1)]
        self.order = np.arange(len(self.x))
        return self

    def _add_layer(self, size: int) -> None:
        """Points are inserted in growing batches; those of a batch see each other, too."""
        above, upper = list(self.layers), len(self.layers[-1]) if self.layers else 1
        layer = np.repeat(np.arange(size, dtype=np.int32)[:, None], 2 * self.links, 1)
        self.layers.append(layer)
        at = 1
        while at < size:
            end = min(size, at + max(1, min(self.batch, at // 4)), *([upper] if at < upper else []))
            new, x = np.arange(at, end), self.x[at:end]
            far, near = self._walk(x, self._descend(x, above) if at >= upper else np.zeros(len(x), int), self.beam, layer)
            earlier = new[None] < new[:, None]
            among = np.where(earlier, self.square[new][:, None] + self.square[new][None] - 2 * x @ x.T, np.inf).astype(np.float32)
            far, near = self._sorted(np.hstack([far, among]), np.hstack([near, np.where(earlier, new[None], -1)]))
            chosen = self._spread(far[:, : self.beam], near[:, : self.beam])
            layer[new, : self.links] = np.where(chosen >= 0, chosen, new[:, None])
            self._link_back(layer, new, chosen)
            at = end

    def _link_back(self, layer: np.ndarray, new: np.ndarray, chosen: np.ndarray) -> None:
        """The chosen neighbours link to the new points; those with too many links keep the best spread ones."""
        i, j = np.nonzero(chosen >= 0)
        order = np.argsort(chosen[i, j], kind="stable")
        nodes, first, count = np.unique(chosen[i, j][order], return_index=True, return_counts=True)
        held = np.where(layer[nodes] == nodes[:, None], -1, layer[nodes])
        theirs = np.full((len(nodes), held.shape[1] + count.max(initial=0)), -1, np.int64)
        theirs[:, : held.shape[1]] = held
        theirs[np.repeat(np.arange(len(nodes)), count), held.shape[1] + np.arange(len(order)) - np.repeat(first, count)] = new[i][order]
        theirs = np.take_along_axis(theirs, np.argsort(theirs < 0, axis=1, kind="stable"), 1)
        many = (theirs >= 0).sum(1) > layer.shape[1]
        fit = theirs[~many, : layer.shape[1]]
        layer[nodes[~many]] = np.where(fit >= 0, fit, nodes[~many][:, None])
        if many.any():
            nodes, theirs = nodes[many], theirs[many]
            far = self.square[theirs] + self.square[nodes][:, None] - 2 * np.matmul(self.x[theirs], self.x[nodes][:, :, None])[:, :, 0]
            kept = self._spread(*self._sorted(np.where(theirs >= 0, far, np.float32(np.inf)), theirs))
            layer[nodes] = nodes[:, None]
            layer[nodes, : self.links] = np.where(kept >= 0, kept, nodes[:, None])

    @staticmethod
    def _sorted(far: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(far, axis=1, kind="stable")
        return np.take_along_axis(far, order, 1), np.take_along_axis(near, order, 1)

    def _spread(self, far: np.ndarray, near: np.ndarray) -> np.ndarray:
        """Of each row's candidates, nearest first, those that aren't nearer to one already chosen; -1 where there are fewer."""
        x, square = self.x[near], self.square[near]
        pairs = square[:, :, None] + square[:, None] - 2 * np.matmul(x, x.transpose(0, 2, 1))
        least, count = np.full(far.shape, np.inf, np.float32), np.zeros(len(far), int)
        chosen = np.full((len(far), self.links), -1, np.int64)
        for c in range(far.shape[1]):
            rows = np.flatnonzero((near[:, c] >= 0) & (least[:, c] > far[:, c]) & (count < self.links))
            chosen[rows, count[rows]] = near[rows, c]
            count[rows] += 1
            least[rows] = np.minimum(least[rows], pairs[rows, c])
        return chosen

    def _descend(self, q: np.ndarray, layers: list[np.ndarray]) -> np.ndarray:
        start = np.zeros(len(q), int)
        for layer in layers:
            start = self._walk(q, start, 1, layer)[1][:, 0]
        return start

    def _walk(self, q: np.ndarray, start: np.ndarray, width: int, layer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squared distances and points that each query's beam ends with, nearest first; infinity and -1 in empty places."""
        n, rows, none, one, high = len(layer), np.arange(len(q)), np.uint64(2**64 - 1), np.uint64(1), np.uint64(32)
        square = np.einsum("ij,ij->i", q, q)

        def keys(row: np.ndarray, node: np.ndarray) -> np.ndarray:
            far = self.square.take(node) + square.take(row) - 2 * np.einsum("ij,ij->i", self.x.take(node, 0), q.take(row, 0))
            return np.maximum(far, np.float32(0)).view(np.uint32).astype(np.uint64) << high | node.astype(np.uint64) << one

        nodes = lambda held: (held >> one).astype(np.int64) & 0x7FFFFFFF
        beam, seen = np.full((len(q), width), none), np.zeros(len(q) * n, bool)
        beam[:, 0] = keys(rows, start)
        seen[rows * n + start] = True
        stamp, live = np.empty(len(seen), np.int32), rows
        while len(live):
            held = beam[live]
            waiting = held & one == 0
            r, c = np.nonzero(waiting & (waiting.cumsum(1, dtype=np.int32) <= self.opened))
            row, node = np.repeat(r, layer.shape[1]), layer.take(nodes(held[r, c]), 0).ravel()
            held[r, c] |= one
            place = live.take(row) * n + node
            new = np.flatnonzero(~seen.take(place))
            row, node, place = row.take(new), node.take(new), place.take(new)
            stamp[place] = np.arange(len(place), dtype=np.int32)
            new = np.flatnonzero(stamp.take(place) == np.arange(len(place)))  # once each
            row, node = row.take(new), node.take(new)
            seen[place] = True
            key = keys(live.take(row), node)
            new = np.flatnonzero(key < held[:, -1].take(row))
            row, key = row.take(new), key.take(new)
            count = np.bincount(row, minlength=len(live))
            more = np.full((len(live), int(count.max(initial=0))), none)
            more[row, np.arange(len(row)) - (np.cumsum(count) - count).take(row)] = key
            held = np.hstack([held, more])
            held.sort(1)
            beam[live] = held = held[:, :width]
            live = live[(held & one == 0).any(1)]
        empty = beam == none
        return np.where(empty, np.float32(np.inf), (beam >> high).astype(np.uint32).view(np.float32)), np.where(empty, -1, nodes(beam))

    def search(self, q: np.ndarray, width: int) -> np.ndarray:
        """For each query the points its walk of a beam ends with, nearest first; -1 where there are fewer."""
        if not len(self.x):
            return np.full((len(q), width), -1)
        found = [np.zeros((0, width), int)]
        for at in range(0, len(q), self.block):
            part = self._near_origin(q[at : at + self.block])
            found.append(self._walk(part, self._descend(part, self.layers[:-1]), width, self.layers[-1])[1])
        found = np.concatenate(found)
        return np.where(found >= 0, self.order[found], -1)


@dataclass
class GraphIndex:
    """A graph for each shard of at most ``shard`` rows, built once where the shard lies and stored; shard results are merged.

    A search deals a few shards (``together``) and a block of queries to each task.
    """

    rows: DataFrame
    size: int
    links: int = 16
    beam: int = 64
    shard: int = 5_000
    encoder: object | None = None
    metric: str = "l2"
    together: int = 4
    block: int = 10_000
    table: DataFrame | None = None

    def _walked(self, x: np.ndarray, rows: bool) -> np.ndarray:
        """Points whose squared distances order like the metric: unit vectors, or rows lifted to one length for inner products."""
        if self.metric == "cosine":
            return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
        if self.metric == "ip":
            square = (x * x).sum(1)
            return np.hstack([x, np.sqrt(square.max(initial=0) - square)[:, None] if rows else np.zeros((len(x), 1))])
        return x

    def built(self) -> DataFrame:
        """(s, at, id, v, links): each shard's points in the graph's order, with the links of all their layers."""
        if self.table is not None:
            return self.table
        import pyarrow as pa

        size, links, beam, encoder, walked = self.size, self.links, self.beam, self.encoder, replace(self, rows=None)._walked
        n = max(1, -(-self.rows.count() // self.shard))
        lists = lambda ends, flat: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(flat))

        def build(table):
            table = table.sort_by("id").combine_chunks()
            x = _to_matrix(table.column("v"), size)
            if encoder is not None:
                x = encoder.decode(encoder.encode(x))
            graph = Graph(walked(x, True), links, beam).build()
            flat, ends = graph.flat_links()
            x = x[graph.order]
            return pa.table(
                {"s": table.column("s"), "at": pa.array(np.arange(len(x), dtype=np.int32)), "id": table.column("id").take(pa.array(graph.order)),
                 "v": lists(size * np.arange(1, len(x) + 1), x.ravel()), "links": lists(ends, flat.astype(np.int32))}
            )

        rows = self.rows.select(F.pmod(F.xxhash64("id"), F.lit(n)).cast("int").alias("s"), F.col("id").cast("long"), F.col("v").cast("array<double>").alias("v"))
        self.table = stored(rows.groupBy("s").applyInArrow(build, "s int, at int, id long, v array<double>, links array<int>"), "graph")
        return self.table

    def search(self, queries: DataFrame, k: int, *, width: int = 64, where: Column | None = None) -> DataFrame:
        """``where``: the walk uses all rows, and only members are returned; where it meets too few, all members are compared."""
        import pyarrow as pa

        size, links, metric, walked = self.size, self.links, self.metric, replace(self, rows=None, table=None)._walked
        table = self.built().withColumn("m", F.lit(True))
        if where is not None:
            members = self.rows.filter(where).select(F.col("id").cast("long"), F.lit(True).alias("member")).distinct()
            table = table.join(members, "id", "left").withColumn("m", F.col("member").isNotNull())
        n = (table.agg(F.max("s")).first()[0] or 0) // self.together + 1
        n_asked = max(1, -(-queries.count() // self.block))
        each = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
        rows = table.select((F.col("s") / self.together).cast("int").alias("g"), each(n_asked).alias("a"), "s", "at", "id", "v", "links", "m")
        own = F.pmod(F.xxhash64("id"), F.lit(n_asked)).cast("int")
        asked = queries.select(each(n).alias("g2"), own.alias("a2"), F.col("id").cast("long").alias("query_id"), F.col("v").cast("array<double>").alias("q"))
        schema = pa.schema([("query_id", pa.int64()), ("id", pa.int64()), ("distance", pa.float64())])

        def restored(shard):
            x, held = _to_matrix(shard.column("v"), size), shard.column("links").combine_chunks()
            offsets = held.offsets.to_numpy()
            return Graph(walked(x, True), links).restored(held.flatten().to_numpy(), offsets[1:] - offsets[0]), x, shard.column("id").to_numpy(), shard.column("m").to_numpy()

        def of_shard(graph, x, ids, allowed, query_ids, raw):
            found = graph.search(walked(raw, False), max(width, k))
            kept = (found >= 0) & allowed[found]
            kept &= kept.cumsum(1) <= k
            members = np.flatnonzero(allowed)
            few = kept.sum(1) < min(k, len(members))
            q, c = np.nonzero(kept & ~few[:, None])
            q, at = np.concatenate([q, np.repeat(np.flatnonzero(few), len(members))]), np.concatenate([found[q, c], np.tile(members, few.sum())])
            return [query_ids[q], ids[at], vectors._exact(metric, raw[q], x[at])]

        def run(table, block):
            if not table.num_rows or not block.num_rows:
                return schema.empty_table()
            table = table.sort_by([("s", "ascending"), ("at", "ascending")]).combine_chunks()
            ends = np.flatnonzero(np.diff(table.column("s").to_numpy(), append=-1)) + 1
            query_ids, raw = block.column("query_id").to_numpy(), _to_matrix(block.column("q"), size)
            parts = []
            for start, end in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True):
                shard = restored(table.slice(start, end - start))
                parts += [of_shard(*shard, query_ids[at : at + 1_000], raw[at : at + 1_000]) for at in range(0, len(raw), 1_000)]
            return pa.table([np.concatenate(c) for c in zip(*parts, strict=True)], schema=schema)

        return vectors.best(rows.groupBy("g", "a").cogroup(asked.groupBy("g2", "a2")).applyInArrow(run, _FOUND), k, metric)


def refined(found: DataFrame, base: DataFrame, queries: DataFrame, k: int, metric: str = "l2") -> DataFrame:
    """Candidates ranked again by exact distances."""
    exact = vectors.subset_distances(found.select("query_id", "id"), base, queries, metric)
    return vectors.best(exact.filter(F.col("distance").isNotNull()), k, metric)


@dataclass
class Pipeline:
    """What a factory name describes: transforms, an index, and perhaps refinement."""

    transforms: list[Q.Linear | str]
    index: object
    base: DataFrame
    refine: bool = False
    metric: str = "l2"
    external_ids: bool = False

    def _apply(self, rows: DataFrame) -> DataFrame:
        steps = self.transforms

        def apply(x: np.ndarray) -> np.ndarray:
            for t in steps:
                n = np.linalg.norm(x, axis=1, keepdims=True) if t == "norm" else None
                x = np.divide(x, n, out=x.copy(), where=n > 0) if t == "norm" else t.apply(x)
            return x

        return Q.transformed(rows, apply) if steps else rows

    def search(self, queries: DataFrame, k: int, *, probes: int = 1, factor: float = 1.0, width: int = 64, where: Column | None = None) -> DataFrame:
        wanted = max(k, int(np.ceil(k * max(1.0, factor)))) if self.refine else k
        asked = self._apply(queries)
        if isinstance(self.index, CellIndex):
            out = self.index.search(asked, wanted, probes=probes, where=where)
        elif isinstance(self.index, GraphIndex):
            out = self.index.search(asked, wanted, width=width, where=where)
        else:
            out = vectors.knn(self.index, asked, wanted, self.metric, where)
        return refined(out, self.base, queries, k, self.metric) if self.refine else out


def factory(name: str, rows: DataFrame, *, metric: str = "l2", most: int = 65_536, seed: int = 1234) -> Pipeline:
    """An index by name, as in ``OPQ16,IVF256,PQ16,RFlat``: fitted on a sample of (id, v), filled with all rows.

    Transforms: PCAn, PCAWn, OPQm, RRn, L2norm. Cells: IVFn, IMI2xb.
    Codes: Flat, PQm[xb], SQ8, SQ4, SQfp16, RQm[xb], LSQm[xb]. Graphs: HNSWm.
    Last: RFlat or Refine(Flat). IDMap in front says that ids are the caller's.
    Other parts, as IVFn_HNSWm and Refine of codes, are not built and raise.
    """
    x = Q.sample(rows, most, seed)
    transforms: list = []
    coarse, encoder, graph, refine, flat, ids = None, None, None, False, False, False

    def coded(part: str):
        if m := re.fullmatch(r"PQ(\d+)(?:x(\d+))?", part):
            return Q.ProductQuantizer(int(m[1]), int(m[2] or 8))
        if m := re.fullmatch(r"SQ(8|4|fp16)", part):
            return Q.ScalarQuantizer("fp16" if m[1] == "fp16" else f"sq{m[1]}")
        if m := re.fullmatch(r"(RQ|LSQ)(\d+)(?:x(\d+))?", part):
            return Q.AdditiveQuantizer(int(m[2]), int(m[3] or 8), residual=m[1] == "RQ")
        return None

    for part in re.split(r",(?![^(]*\))", name):
        if part in ("IDMap", "IDMap2"):
            ids = True
        elif m := re.fullmatch(r"(PCAW?|OPQ|RR)(\d+)(?:_(\d+))?", part):
            kind, n = m[1], int(m[2])
            if kind == "OPQ":
                new = Q.opq(x, n, bits=min(8, int(np.log2(max(2, len(x) // 4)))), rounds=4, seed=seed)[0]
            else:
                new = Q.random_rotation(x.shape[1], n, seed) if kind == "RR" else Q.pca(x, n, -0.5 if kind == "PCAW" else 0.0)
            transforms.append(new)
            x = new.apply(x)
        elif part == "L2norm":
            transforms.append("norm")
            x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
        elif m := re.fullmatch(r"IVF(\d+)", part):
            coarse = Centroids(Q.kmeans(x, int(m[1]), seed=seed))
        elif m := re.fullmatch(r"IMI2x(\d+)", part):
            half = x.shape[1] // 2
            coarse = MultiIndex((Q.kmeans(x[:, :half], 1 << int(m[1]), seed=seed), Q.kmeans(x[:, half:], 1 << int(m[1]), seed=seed)))
        elif m := re.fullmatch(r"HNSW(\d+)", part):
            graph = int(m[1])
        elif part in ("RFlat", "Refine(Flat)"):
            refine = True
        elif part == "Flat":
            flat = True
        elif (encoder := coded(part)) is None:
            raise ValueError(f"unknown part {part!r} of an index name")
    if encoder is None and coarse is None and graph is None and not flat:
        raise ValueError(f"no index in {name!r}")
    if encoder is not None:
        rest = x - np.stack([coarse.centre(c) for c in coarse.assign(x)]) if coarse is not None else x
        encoder.fit(rest)
    out = Pipeline(transforms, None, rows, refine, metric, ids)
    ready = out._apply(rows)
    if graph is not None:
        if coarse is not None or metric not in ("l2", "ip", "cosine"):
            raise ValueError(f"no graph over cells or for the metric {metric!r}")
        out.index = GraphIndex(ready, x.shape[1], graph, encoder=encoder, metric=metric)
    elif coarse is None and encoder is None:
        out.index = ready
    else:
        one = Centroids(np.zeros((1, x.shape[1])))
        out.index = CellIndex(coarse or one, x.shape[1], encoder, coarse is not None, metric).add(ready)
    return out


def describe(pipeline: Pipeline) -> str:
    return json.dumps({"transforms": len(pipeline.transforms), "index": type(pipeline.index).__name__, "refine": pipeline.refine, "metric": pipeline.metric})


def binary_cells(codes: DataFrame, k: int, *, rounds: int = 10, most: int = 65_536, seed: int = 7) -> np.ndarray:
    """Centroids of binary codes (id, bits array<long>) as 0/1 rows: each bit by majority of its cell."""
    n = codes.count()
    chosen = codes if n <= most else codes.filter(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 30)) < int(most / n * (1 << 30)))
    bits = unpacked(np.asarray([r.bits for r in chosen.orderBy("id").collect()], np.int64))
    rng = np.random.default_rng(seed)
    centroids = bits[rng.choice(len(bits), min(k, len(bits)), replace=False)]
    for _ in range(rounds):
        cell = Q.assign(bits, centroids)
        count = np.bincount(cell, minlength=len(centroids))[:, None]
        sums = np.zeros_like(centroids)
        np.add.at(sums, cell, bits)
        centroids = np.where(count > 0, (2 * sums > count).astype(float), centroids)
    return centroids


def unpacked(words: np.ndarray) -> np.ndarray:
    """Bits of rows of 64-bit words, lowest first, as 0.0 and 1.0."""
    return ((words[:, :, None] >> np.arange(64)) & 1).reshape(len(words), -1).astype(float)


def binary_search(codes: DataFrame, centroids: np.ndarray, queries: DataFrame, k: int, *, probes: int = 1) -> DataFrame:
    """k nearest codes (id, bits array<long>) by differing bits within each query's nearest cells, block by block."""
    import pyarrow as pa

    points = Centroids(centroids)
    schema = pa.schema([("query_id", pa.int64()), ("id", pa.int64()), ("distance", pa.float64())])

    def cells(rows: DataFrame, width: int) -> DataFrame:
        def run(batches):
            for batch in batches:
                words = vectors._words(batch.column(1)).view(np.int64)
                near = points.nearest(unpacked(words), width) if len(words) else np.zeros((0, 1), int)
                at = pa.array(np.repeat(np.arange(len(words)), near.shape[1]))
                yield pa.RecordBatch.from_arrays([pa.array(near.ravel().astype(np.int32)), batch.column(0).take(at), batch.column(1).take(at)], ["cell", "id", "bits"])

        return rows.select(F.col("id").cast("long"), "bits").mapInArrow(run, "cell int, id long, bits array<long>")

    def search(mine, asked):
        if not mine.num_rows or not asked.num_rows:
            return schema.empty_table()
        ids, held = mine.column("id").to_numpy(), vectors._words(mine.column("bits").combine_chunks())
        out = []
        for query, q in zip(asked.column("id").to_numpy(), vectors._words(asked.column("bits").combine_chunks()), strict=True):
            far = np.bitwise_count(held ^ q).sum(1).astype(float)
            at = np.flatnonzero(far <= np.partition(far, k - 1)[k - 1]) if len(far) > k else np.arange(len(far))
            out.append((np.full(len(at), query), ids[at], far[at]))
        return pa.table([np.concatenate(x) for x in zip(*out, strict=True)], schema=schema)

    found = in_blocks(cells(codes, 1), cells(queries, probes)).applyInArrow(search, _FOUND)
    return vectors.best(found.withColumn("distance", F.col("distance").cast("int")), k)
