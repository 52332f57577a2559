"""Approximate nearest neighbours by cosine: inverted file, product-quantised residuals, exact reranking.

Vectors are scaled to unit length, so the largest cosine is the least distance.
Coarse centroids and residual codebooks are fitted on a bounded, hash-chosen
sample; every vector is then encoded and put in its nearest cell. A query
visits its nearest cells, ranks their members by asymmetric distance tables,
and reranks the best of each block by the exact cosine of the original vectors.

Cells are cut into blocks of bounded size by a hash of the id, and a cell's
queries too, so neither a popular vector nor a popular query region lands in
one task. Queries that find fewer than k members in their cells search all.

Defined results: vectors that are null, zero, of another length than most of
the sample, or hold null or non-finite components take no part, and neither do
rows with a null id; equal scores are ordered by id; repeated rows are repeated
candidates, but a query never finds its own id; an empty table gives no rows;
further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomwork.session import stored


def nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Index of each row's nearest centroid, ties to the lower."""
    half = (centroids * centroids).sum(1) / 2
    return np.concatenate([(x[i : i + 8192] @ centroids.T - half).argmax(1) for i in range(0, len(x), 8192)]) if len(x) else np.zeros(0, int)


def lloyd(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    """Centroids of at most k clusters; an empty one moves to a random row."""
    k = min(k, len(x))
    centroids = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        cell = nearest(x, centroids)
        count = np.bincount(cell, minlength=k)
        sums = np.zeros_like(centroids)
        np.add.at(sums, cell, x)
        centroids = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], x[rng.integers(0, len(x), k)])
    return centroids


@dataclass
class Index:
    """Coarse centroids, for each slice of the components its codebook, and how many cells a query should visit."""

    centroids: np.ndarray
    slices: list[slice]
    books: list[np.ndarray]
    probes: int

    @property
    def size(self) -> int:
        return self.centroids.shape[1]

    def encode(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cell = nearest(units, self.centroids)
        rest = units - self.centroids[cell]
        return cell, np.stack([nearest(rest[:, s], b) for s, b in zip(self.slices, self.books, strict=True)], 1).astype(np.uint8)

    def tables(self, query: np.ndarray, cell: int) -> np.ndarray:
        """Squared distance of the query's residual to every code of every slice."""
        rest = query - self.centroids[cell]
        out = np.full((len(self.slices), 256), np.inf, np.float32)
        for i, (s, b) in enumerate(zip(self.slices, self.books, strict=True)):
            out[i, : len(b)] = ((b - rest[s]) ** 2).sum(1)
        return out


def _valid(df: DataFrame, id_col: str, vector: str) -> DataFrame:
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    rows = df.select(F.col(id_col).cast("long").alias("id"), v.cast("array<double>").alias("v")).filter(
        F.col(id_col).isNotNull() & v.isNotNull() & (F.size(v) > 0)
    )
    return rows.filter(F.coalesce(finite, F.lit(False)) & F.exists(v, lambda x: x != 0))


def _matrix(column, size: int) -> np.ndarray:
    return column.values.to_numpy(zero_copy_only=False).reshape(-1, size) if len(column) else np.zeros((0, size))


def _units(x: np.ndarray) -> np.ndarray:
    x = x / np.maximum(np.abs(x).max(1, keepdims=True), 1e-300)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def fit(rows: DataFrame, *, sample: int = 50_000, cells: int | None = None, parts: int = 16, k: int = 5, recall: float = 0.96, seed: int = 3) -> Index | None:
    """Fit on at most about ``sample`` vectors chosen by a hash of their ids.

    ``cells``: by default the square root of the rows, but at least 32 vectors of the sample each.
    """
    n = rows.count()
    if not n:
        return None
    share = min(1.0, sample / n)
    chosen = rows.filter(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 30)) < int(share * (1 << 30))) if share < 1 else rows
    table = chosen.toArrow().sort_by("id")
    vectors = table.column("v").combine_chunks()
    lengths = np.diff(vectors.offsets.to_numpy())
    size = int(np.bincount(lengths).argmax())
    x = _units(np.stack([np.asarray(v.as_py()) for v, k in zip(vectors, lengths, strict=True) if k == size]))
    rng = np.random.default_rng(seed)
    centroids = lloyd(x, cells or int(np.clip(np.sqrt(n), 1, max(1, len(x) // 32))), rng)
    rest = x - centroids[nearest(x, centroids)]
    slices = [slice(int(i[0]), int(i[-1]) + 1) for i in np.array_split(np.arange(size), min(parts, size))]
    return Index(centroids, slices, [lloyd(rest[:, s], 256, rng) for s in slices], probes_for(x, centroids, k, recall))


def probes_for(x: np.ndarray, centroids: np.ndarray, k: int, recall: float, queries: int = 400) -> int:
    """Least number of nearest cells that hold the share ``recall`` of the true k nearest, over queries of the sample.

    Neighbours within a sample are farther than those within all rows, so the
    number errs on the large side.
    """
    asked = np.arange(len(x))[:: max(1, len(x) // queries)]
    cell, ranks = nearest(x, centroids), []
    for q in asked:
        near = x @ x[q]
        near[q] = -np.inf
        best = np.argpartition(-near, min(k, len(x) - 1))[:k] if len(x) > k else np.flatnonzero(np.isfinite(near))
        order = np.argsort(((centroids - x[q]) ** 2).sum(1), kind="stable")
        place = np.empty(len(order), int)
        place[order] = np.arange(len(order))
        ranks.append(place[cell[best]])
    flat = np.sort(np.concatenate(ranks)) if ranks else np.zeros(0, int)
    return int(flat[min(len(flat) - 1, int(np.ceil(recall * len(flat))))]) + 1 if len(flat) else 1


def build(rows: DataFrame, index: Index) -> DataFrame:
    """id, vector, cell and codes of every row."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            cell, codes = index.encode(_units(_matrix(batch.column(1), index.size)))
            flat = pa.array([c.tobytes() for c in codes], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), flat], ["id", "v", "cell", "codes"])

    right = rows.filter(F.size("v") == index.size)
    return stored(right.mapInArrow(run, "id long, v array<double>, cell int, codes binary"), "vectors")


def _probed(queries: DataFrame, index: Index, probes: int) -> DataFrame:
    """id, vector and cell, a row for each of a query's nearest cells."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            x = _units(_matrix(batch.column(1), index.size))
            far = (index.centroids**2).sum(1) / 2
            order = np.concatenate([np.argsort(far - x[i : i + 1024] @ index.centroids.T, axis=1, kind="stable")[:, :probes] for i in range(0, len(x), 1024)] or [np.zeros((0, probes), int)])
            at = pa.array(np.repeat(np.arange(len(x)), order.shape[1]))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(order.ravel().astype(np.int32))], ["id", "v", "cell"])

    small = queries.select("id", "v")
    return small.mapInArrow(run, "id long, v array<double>, cell int")


def cosines(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Cosine of q with every row, in double precision, from the vectors as they are."""
    return (x * q).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((q * q).sum()))


def _ranked(probed: DataFrame, members: DataFrame, index: Index, *, k: int, rerank: int, block: int, query_block: int) -> DataFrame:
    blocks = {r.cell: -(-r["count"] // block) for r in members.groupBy("cell").count().collect()}
    query_blocks = {r.cell: -(-r["count"] // query_block) for r in probed.groupBy("cell").count().collect()}
    n_cells = len(index.centroids)
    number = lambda held: F.get(F.array(*[F.lit(held.get(i, 1)) for i in range(n_cells)]), F.col("cell"))
    own = F.pmod(F.xxhash64("id"), number(blocks)).cast("int").alias("b")
    each = F.explode(F.sequence(F.lit(0), number(query_blocks) - 1)).alias("q")
    left = members.select("cell", own, each, "id", "v", "codes")
    own = F.pmod(F.xxhash64("id", F.lit(1)), number(query_blocks)).cast("int").alias("q")
    each = F.explode(F.sequence(F.lit(0), number(blocks) - 1)).alias("b")
    right = probed.select("cell", own, each, "id", "v")

    def run(key, mine, asked):
        import pyarrow as pa

        schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
        if not mine.num_rows or not asked.num_rows:
            return schema.empty_table()
        cell = key[0].as_py()
        mine, asked = mine.sort_by("id").combine_chunks(), asked.combine_chunks()
        ids = mine.column("id").to_numpy()
        vectors = _matrix(mine.column("v").combine_chunks(), index.size)
        codes = np.frombuffer(b"".join(mine.column("codes").to_pylist()), np.uint8).reshape(len(ids), -1).astype(np.intp)
        place = np.arange(codes.shape[1])
        raw = _matrix(asked.column("v").combine_chunks(), index.size)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for query, q, unit in zip(asked.column("id").to_numpy(), raw, _units(raw), strict=True):
            far = index.tables(unit, cell)[place, codes].sum(1)
            far[ids == query] = np.inf
            if len(far) > rerank:
                limit = np.partition(far, rerank - 1)[rerank - 1]
                near = np.flatnonzero(far <= limit)
                near = near[np.argsort(far[near], kind="stable")[:rerank]]
            else:
                near = np.arange(len(far))
            near = near[ids[near] != query]
            score = cosines(q, vectors[near])
            best = np.lexsort((ids[near], -score))[:k]
            found.append((np.full(len(best), query), ids[near][best], score[best]))
        return pa.table([np.concatenate(x) for x in zip(*found, strict=True)], schema=schema)

    hits = left.groupBy("cell", "b", "q").cogroup(right.groupBy("cell", "b", "q")).applyInArrow(run, "query_id long, vec_id long, score double")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return hits.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def search(
    vectors: DataFrame,
    is_query,
    *,
    id_col: str = "vec_id",
    vector: str = "embedding",
    k: int = 5,
    probes: int | None = None,
    rerank: int = 200,
    block: int = 20_000,
    query_block: int = 5_000,
    **fitting,
) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest rows found for each row with ``is_query``.

    ``probes``: cells that a query visits; by default as many as the fitting
    sample needs for its true neighbours. Queries are told apart by id, so an
    id's rows should hold one vector.
    """
    rows = stored(_valid(vectors, id_col, vector), "vectors-valid")
    index = fit(rows, k=k, **fitting)
    if index is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    members = build(rows, index)
    queries = members.filter(is_query(F.col("id"))).dropDuplicates(["id"])
    how = {"k": k, "rerank": rerank, "block": block, "query_block": query_block}
    probed = stored(_probed(queries, index, probes or index.probes), "vectors-probed")
    found = stored(_ranked(probed, members, index, **how), "vectors-found")
    full = found.groupBy("query_id").count().filter(F.col("count") == k)
    short = stored(queries.select("id", "v").join(full, F.col("id") == F.col("query_id"), "left_anti"), "vectors-short")
    if short.isEmpty():
        return found
    rest = _ranked(stored(_probed(short, index, len(index.centroids)), "vectors-probed"), members, index, **how)
    return found.join(full, "query_id", "left_semi").unionByName(rest)
