"""Vector queries over embeddings and documents, with equivalent SQL where results are exact.

Every row is a query against all rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.functions import distance
from loomwork.operators import grouping, indexes, quantizers, vectors
from loomwork.session import read_table
from loomwork.sources import files

QUERIES: dict = {}
SQL: dict = {}


def _query(name: str, oracle: str | None = None):
    def register(f):
        QUERIES[name] = f
        if oracle:
            SQL[name] = oracle
        return f

    return register


def _base(spark, sf_dir) -> DataFrame:
    return read_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))


def _bits(spark, sf_dir) -> DataFrame:
    """Signs of the components as binary codes."""
    return _base(spark, sf_dir).select("id", distance.binarized(F.col("v")).alias("bits"))


_PAIRS = """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
d AS (SELECT q.vec_id AS query_id, b.vec_id AS id, {} AS distance FROM e q, e b) """
_L2 = _PAIRS.format("pow(list_distance(q.v, b.v), 2)")
_IP = _PAIRS.format("list_inner_product(q.v, b.v)")
_COSINE = _PAIRS.format("list_cosine_similarity(q.v, b.v)")
_DIFF = "list_transform(list_zip(q.v, b.v), lambda z: abs(z[1] - z[2]))"
_BITS = "WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: (x > 0)::INTEGER) AS v FROM embeddings), d AS (SELECT q.vec_id AS query_id, b.vec_id AS id, list_sum(list_transform(list_zip(q.v, b.v), lambda z: abs(z[1] - z[2])))::INTEGER AS distance FROM e q, e b) "


def _top(k: int, descending: bool = False, where: str = "true") -> str:
    order = "round(distance, 9)" + " DESC" * descending
    return f"SELECT query_id, rank, id, round(distance, 4) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {order}, id)::INTEGER AS rank FROM d WHERE {where}) WHERE rank <= {k}"


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("distance", F.round("distance", 4))


@_query("v_knn_l2", _L2 + _top(10))
def v_knn_l2(spark, sf_dir):
    b = _base(spark, sf_dir)
    return _rounded(vectors.knn(b, b, 10))


@_query("v_knn_ip", _IP + _top(10, True))
def v_knn_ip(spark, sf_dir):
    b = _base(spark, sf_dir)
    return _rounded(vectors.knn(b, b, 10, "ip"))


@_query("v_knn_l1", _PAIRS.format(f"list_sum({_DIFF})") + _top(5))
def v_knn_l1(spark, sf_dir):
    b = _base(spark, sf_dir)
    return _rounded(vectors.knn(b, b, 5, "l1"))


@_query("v_knn_linf", _PAIRS.format(f"list_max({_DIFF})") + _top(5))
def v_knn_linf(spark, sf_dir):
    b = _base(spark, sf_dir)
    return _rounded(vectors.knn(b, b, 5, "linf"))


@_query("v_knn_cosine", _COSINE + _top(10, True))
def v_knn_cosine(spark, sf_dir):
    b = _base(spark, sf_dir)
    return _rounded(vectors.knn(b, b, 10, "cosine"))


@_query("v_filtered_knn", _L2 + _top(5, where="(id >= 100 AND id < 300 OR id IN (7, 11, 13)) AND NOT id IN (101, 105, 250)"))
def v_filtered_knn(spark, sf_dir):
    b, s = _base(spark, sf_dir), vectors.Selector
    members = (s.between(100, 300) | s.batch([7, 11, 13])) & ~s.where(lambda i: i.isin(101, 105, 250))
    return _rounded(vectors.knn(b, b, 5, where=members.condition))


@_query("v_radius_l2", _L2 + "SELECT query_id, id, round(distance, 4) AS distance FROM d WHERE distance < 1.4")
def v_radius_l2(spark, sf_dir):
    b = _base(spark, sf_dir)
    return _rounded(vectors.radius(b, b, 1.4))


@_query("v_radius_cosine", _COSINE + "SELECT query_id, id, round(distance, 4) AS distance FROM d WHERE distance > 0.3")
def v_radius_cosine(spark, sf_dir):
    b = _base(spark, sf_dir)
    return _rounded(vectors.radius(b, b, 0.3, "cosine"))


@_query("v_subset_distances", _L2 + "SELECT query_id, query_id + 1 AS id, round((SELECT distance FROM d x WHERE x.query_id = q.query_id AND x.id = q.query_id + 1), 4) AS distance FROM (SELECT DISTINCT query_id FROM d) q")
def v_subset_distances(spark, sf_dir):
    b = _base(spark, sf_dir)
    return _rounded(vectors.subset_distances(b.select(F.col("id").alias("query_id"), (F.col("id") + 1).alias("id")), b, b))


@_query("v_normalize", "SELECT vec_id AS id, round(list_sum(list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])))), 4) AS total, 1.0::DOUBLE AS norm FROM embeddings")
def v_normalize(spark, sf_dir):
    v = distance.normalized(F.col("v"))
    out = _base(spark, sf_dir).select("id", v.alias("v"))
    return out.select("id", F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 4).alias("total"), F.round(distance.norm(F.col("v")), 4).alias("norm"))


@_query("v_hamming_knn", _BITS + "SELECT query_id, rank, id, distance FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id)::INTEGER AS rank FROM d) WHERE rank <= 5")
def v_hamming_knn(spark, sf_dir):
    b = _bits(spark, sf_dir)
    return vectors.hamming_knn(b, b, 5)


@_query("v_hamming_radius", _BITS + "SELECT query_id, id, distance FROM d WHERE distance <= 20")
def v_hamming_radius(spark, sf_dir):
    b = _bits(spark, sf_dir)
    return vectors.hamming_radius(b, b, 20)


@_query("v_sq8_ranges", "SELECT (i - 1)::INTEGER AS dim, min(x)::DOUBLE AS low, max(x)::DOUBLE AS high FROM (SELECT unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY 1")
def v_sq8_ranges(spark, sf_dir):
    return quantizers.scalar_ranges(_base(spark, sf_dir))


_WORDS = r"WITH w AS (SELECT doc_id AS id, term AS dim, count(*)::DOUBLE AS val FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+')) AS term FROM documents) GROUP BY 1, 2) "


def _words(spark, sf_dir) -> DataFrame:
    """All words of every document, in lower case and parted by blanks."""
    d = read_table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("id"), F.regexp_extract_all(F.lower("text"), F.lit(r"[^\x20\x09-\x0D]+"), 0).alias("words"))


def _terms(spark, sf_dir) -> DataFrame:
    """Counts of all words of every document as sparse vectors."""
    words = _words(spark, sf_dir).select("id", F.explode("words").alias("dim"))
    return words.groupBy("id", "dim").agg(F.count(F.lit(1)).cast("double").alias("val"))


@_query("v_sparse_ip")
def v_sparse_ip(spark, sf_dir):
    """Tested by brute force, as SQL is too slow on the larger tables."""
    return vectors.sparse_top(vectors.sparse_counts(_words(spark, sf_dir)), None, 3)


@_query("v_sparse_normalized", _WORDS + "SELECT id, dim, round(val / sqrt(sum(val * val) OVER (PARTITION BY id)), 6) AS val FROM w")
def v_sparse_normalized(spark, sf_dir):
    return vectors.sparse_normalized(_terms(spark, sf_dir)).withColumn("val", F.round("val", 6))


@_query("v_remove_reconstruct", "SELECT vec_id AS id, round(list_sum(embedding::DOUBLE[]), 4) AS total FROM embeddings WHERE NOT vec_id BETWEEN 20 AND 60")
def v_remove_reconstruct(spark, sf_dir):
    left = vectors.remove(_base(spark, sf_dir), F.col("id").between(20, 60))
    return left.select("id", F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


def _index(spark, sf_dir, name: str) -> tuple[DataFrame, indexes.Pipeline]:
    b = _base(spark, sf_dir)
    return b, indexes.factory(name, b)


@_query("v_ivf_exact", _L2 + _top(10))
def v_ivf_exact(spark, sf_dir):
    b, index = _index(spark, sf_dir, "IVF16,Flat")
    found = index.search(b, 20, probes=16)
    return _rounded(indexes.refined(found, b, b, 10))


@_query("v_ivf_radius", _L2 + "SELECT query_id, id, round(distance, 4) AS distance FROM d WHERE distance < 1.4")
def v_ivf_radius(spark, sf_dir):
    """With all cells visited the answer is exact."""
    b, index = _index(spark, sf_dir, "IVF16,Flat")
    return _rounded(index.index.radius(b, 1.4, probes=16))


@_query("v_reconstruct", "SELECT vec_id AS id, round(list_sum(embedding::DOUBLE[]), 4) AS total FROM embeddings WHERE vec_id IN (3, 33, 333)")
def v_reconstruct(spark, sf_dir):
    rows = vectors.reconstruct(_base(spark, sf_dir), [3, 33, 333])
    return rows.select("id", F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


@_query("v_ivf_filtered", _L2 + _top(5, where="id >= 50 AND id < 450"))
def v_ivf_filtered(spark, sf_dir):
    b, index = _index(spark, sf_dir, "IVF16,Flat")
    return _rounded(indexes.refined(index.search(b, 15, probes=16, where=vectors.Selector.between(50, 450).condition), b, b, 5))


@_query("v_list_sizes", "SELECT count(*)::BIGINT AS rows, 16::BIGINT AS cells, true AS in_order FROM embeddings")
def v_list_sizes(spark, sf_dir):
    """Mean size times cells with rows is the number of rows; least, mean and greatest size are in order."""
    _, index = _index(spark, sf_dir, "IVF16,Flat")
    held = F.lit(16) - F.col("empty")
    return index.index.statistics().select(
        F.round(F.col("mean") * held).cast("long").alias("rows"), (held + F.col("empty")).cast("long").alias("cells"),
        ((F.col("min") <= F.col("mean")) & (F.col("mean") <= F.col("max")) & (F.col("empty") >= 0)).alias("in_order"),
    )


@_query("v_refine_exact", _L2 + _top(5))
def v_refine_exact(spark, sf_dir):
    """Ten times the neighbours by 8-bit codes, ranked again exactly."""
    b, index = _index(spark, sf_dir, "IVF8,SQ8,RFlat")
    return _rounded(index.search(b, 5, probes=8, factor=10.0))


def _approximate(name: str, index: str, floor: float, metric: str = "l2", **how) -> None:
    """Whether an index by name, asked with all rows, finds at least the share ``floor`` of the ten true neighbours."""

    def query(spark, sf_dir):
        b = _base(spark, sf_dir)
        found = indexes.factory(index, b, metric=metric).search(b, 10, **how)
        share = vectors.recall(found, vectors.knn(b, b, 10, metric), 10)
        return share.select(F.lit(floor).alias("floor"), (F.col("recall_at_k") >= floor).alias("reached"))

    QUERIES[name] = query
    SQL[name] = f"SELECT {floor}::DOUBLE AS floor, true AS reached"


_approximate("v_recall_ivf", "IVF16,Flat", 0.5, probes=4)
_approximate("v_recall_ivf_ip", "IVF16,Flat", 0.7, "ip", probes=8)
_approximate("v_recall_ivf_pq_refined", "IVF16,PQ16x6,RFlat", 0.65, probes=8, factor=8.0)
_approximate("v_recall_pq", "PQ16x6", 0.45)
_approximate("v_recall_sq8", "SQ8", 0.95)
_approximate("v_recall_sq4", "SQ4", 0.75)
_approximate("v_recall_sqfp16", "SQfp16", 0.99)
_approximate("v_recall_ivf_sq8", "IVF16,SQ8", 0.95, probes=16)
_approximate("v_recall_ivf_rq", "IVF16,RQ4x6,RFlat", 0.5, probes=16, factor=8.0)
_approximate("v_recall_lsq", "LSQ4x5,RFlat", 0.65, factor=8.0)
_approximate("v_recall_opq", "OPQ16,PQ16x6,RFlat", 0.85, factor=8.0)
_approximate("v_recall_pca", "PCA32,IVF16,Flat", 0.35, probes=16)
_approximate("v_recall_rotation", "RR64,L2norm,Flat", 0.99)
_approximate("v_recall_multi_index", "IMI2x3,Flat", 0.7, probes=32)
_approximate("v_recall_hnsw", "HNSW16", 0.97, width=128)
_approximate("v_recall_hnsw_sq8", "HNSW16,SQ8", 0.95, width=128)
_approximate("v_hnsw_ip", "HNSW16", 0.97, "ip", width=128)
_approximate("v_hnsw_cosine", "HNSW16", 0.97, "cosine", width=128)


def _cells(b: DataFrame, centroids) -> DataFrame:
    """Rows, cells with rows, whether each row lies in its nearest cell, and whether cells are tighter than the whole."""
    index = indexes.CellIndex(indexes.Centroids(centroids), centroids.shape[1]).add(b).table
    parts = index.select("cell", "id", F.posexplode("codes").alias("i", "x"))
    inside = parts.groupBy("cell", "i").agg((F.var_pop("x") * F.count(F.lit(1))).alias("s")).agg(F.sum("s").alias("inside"))
    whole = parts.groupBy("i").agg((F.var_pop("x") * F.count(F.lit(1))).alias("s")).agg(F.sum("s").alias("whole"))
    near = F.lit([[float(x) for x in c] for c in centroids])
    far = lambda c: F.aggregate(F.zip_with("codes", c, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda a, x: a + x)
    nearest = index.select("cell", far(F.get(near, F.col("cell"))).alias("own"), F.array_min(F.transform(near, far)).alias("least"))
    rows = nearest.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("cell").alias("cells"), F.every(F.col("own") <= F.col("least") + 1e-4).alias("nearest"))
    return rows.crossJoin(inside).crossJoin(whole).select("rows", "cells", "nearest", (F.col("inside") < F.col("whole")).alias("tighter"))


_CELLS = "SELECT count(*) AS rows, 8::BIGINT AS cells, true AS nearest, true AS tighter FROM embeddings"


@_query("v_kmeans", _CELLS)
def v_kmeans(spark, sf_dir):
    """Cells of all rows by centroids fitted on a sample."""
    b = _base(spark, sf_dir)
    return _cells(b, quantizers.kmeans(quantizers.sample(b), 8))


@_query("v_minibatch_kmeans", _CELLS)
def v_minibatch_kmeans(spark, sf_dir):
    b = _base(spark, sf_dir)
    return _cells(b, quantizers.minibatch_kmeans(quantizers.sample(b), 8))


@_query("v_pca_variance", "SELECT round(sum(var_), 6) AS total FROM (SELECT var_pop(x) AS var_ FROM (SELECT unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY i)")
def v_pca_variance(spark, sf_dir):
    """All principal components together keep the whole variance."""
    b = _base(spark, sf_dir)
    size = len(b.first().v)
    out = quantizers.transformed(b, quantizers.distributed_pca(b, size).apply)
    parts = out.select(F.posexplode("v").alias("i", "x")).groupBy("i").agg(F.var_pop("x").alias("v"))
    return parts.agg(F.round(F.sum("v"), 6).alias("total"))


@_query("v_binary_cells", SQL["v_hamming_knn"])
def v_binary_cells(spark, sf_dir):
    """With all cells visited the answer is exact."""
    b = _bits(spark, sf_dir)
    return indexes.binary_search(b, indexes.binary_cells(b, 8), b, 5, probes=8)




@_query(
    "v_near_duplicates",
    _COSINE.replace("WITH e", "WITH RECURSIVE e", 1)
    + ", link AS (SELECT query_id AS a, id AS b FROM d WHERE distance > 0.35 AND query_id <> id), reach(id, r) AS (SELECT vec_id, vec_id FROM e UNION SELECT link.b, reach.r FROM reach JOIN link ON link.a = reach.id) "
    "SELECT id, min(r) AS root FROM reach GROUP BY 1",
)
def v_near_duplicates(spark, sf_dir):
    return grouping.near_duplicates(_base(spark, sf_dir), 0.35)


@_query("v_embed_documents", "SELECT doc_id AS id, 64::INTEGER AS size, true AS unit FROM documents")
def v_embed_documents(spark, sf_dir):
    """Every document's hashed vector: its length is 1, or 0 without words."""
    docs = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    out = grouping.embedded(docs, 64)
    return out.select("id", F.size("v").alias("size"), F.round(distance.norm(F.col("v")), 6).isin(0.0, 1.0).alias("unit"))


@_query("v_synthetic", "SELECT range AS id, 8::INTEGER AS size, true AS finite FROM range(200)")
def v_synthetic(spark, sf_dir):
    rows = files.synthetic_vectors(spark, 200, 8, clusters=4)
    return rows.select(F.col("id").cast("long"), F.size("v").alias("size"), F.forall("v", lambda x: F.abs(x) < 1e6).alias("finite"))


@_query("v_new_ids", "SELECT (max(vec_id) + 1)::BIGINT AS low, (max(vec_id) + count(*))::BIGINT AS high, count(*) AS n FROM embeddings")
def v_new_ids(spark, sf_dir):
    b = _base(spark, sf_dir)
    out = vectors.with_ids(b.select("v"), b)
    return out.agg(F.min("id").alias("low"), F.max("id").alias("high"), F.countDistinct("id").alias("n"))


