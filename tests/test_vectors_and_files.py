import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwork.operators import grouping, indexes, quantizers, vectors
from loomwork.sources import files


@pytest.fixture(scope="module")
def base(spark):
    return files.synthetic_vectors(spark, 600, 16, clusters=16).cache()


@pytest.fixture(scope="module")
def matrix(base):
    return np.asarray([r.v for r in base.orderBy("id").collect()])


@pytest.mark.parametrize("metric", ["l2", "ip", "l1", "linf", "cosine"])
def test_knn_is_exact(base, matrix, metric):
    found = {(r.query_id, r["rank"]): r.id for r in vectors.knn(base, base, 4, metric).collect()}
    for q in range(0, 600, 37):
        d = np.array([vectors._exact(metric, matrix[q][None], x[None])[0] for x in matrix])
        order = np.lexsort((np.arange(600), -d if metric in ("ip", "cosine") else d))
        assert [found[q, i + 1] for i in range(4)] == order[:4].tolist()


def test_radius_is_strict(spark):
    b = spark.createDataFrame([(0, [0.0]), (1, [1.0]), (2, [2.0])], "id long, v array<double>")
    assert {(r.query_id, r.id) for r in vectors.radius(b, b, 1.0).collect()} == {(i, i) for i in range(3)}
    assert {(r.query_id, r.id) for r in vectors.radius(b, b, 1.0, "ip").collect()} == {(1, 2), (2, 1), (2, 2)}


def test_all_cells_give_the_exact_answer(base):
    index = indexes.factory("IVF8,Flat", base)
    assert index.index.statistics().first().max <= 600
    truth, found = vectors.knn(base, base, 5), index.search(base, 5, probes=8)
    row = vectors.recall(found, truth, 5).first()
    assert row.recall_at_k > 0.999 and row.recall_at_1 > 0.999


@pytest.mark.parametrize(
    "name, least, how",
    [("IVF8,PQ8x5,RFlat", 0.9, {"probes": 8, "factor": 10.0}), ("SQ8", 0.95, {}), ("HNSW12", 0.95, {"width": 100}), ("PCA12,Flat", 0.5, {}), ("RQ3x5,RFlat", 0.8, {"factor": 10.0}),
     ("IMI2x2,Flat", 0.9, {"probes": 16}), ("OPQ4,PQ4x5,RFlat", 0.8, {"factor": 10.0}), ("IDMap,L2norm,Flat", 0.3, {})],
)
def test_recall_floors(base, name, least, how):
    found = indexes.factory(name, base).search(base, 5, **how)
    assert vectors.recall(found, vectors.knn(base, base, 5), 5).first().recall_at_k >= least


def test_unknown_parts_raise(base):
    with pytest.raises(ValueError):
        indexes.factory("XYZ9", base)
    with pytest.raises(ValueError):
        indexes.factory("L2norm", base)


@pytest.mark.parametrize("name", ["IVF8_HNSW4,Flat", "IVF8,SQ8,Refine(SQ8)"])
def test_parts_that_are_not_built_raise(base, name):
    with pytest.raises(ValueError):
        indexes.factory(name, base)


def test_exact_refinement_by_either_name(base):
    assert indexes.factory("SQ8,Refine(Flat)", base).refine and indexes.factory("SQ8,RFlat", base).refine


def test_filtered_search_returns_members_only(base):
    s = vectors.Selector
    chosen = s.bitmap(bytes([0b1010])) | s.between(500, 520)
    rows = vectors.knn(base, base, 30, where=chosen.condition).collect()
    assert {r.id for r in rows} == {1, 3, *range(500, 520)}
    graph = indexes.factory("HNSW12", base).search(base.filter("id < 5"), 3, width=600, where=F.col("id") < 300)
    assert all(r.id < 300 for r in graph.collect())


def test_index_round_trip(spark, base, tmp_path):
    index = indexes.factory("IVF8,SQ8", base).index
    index.save(str(tmp_path / "i"))
    back = indexes.CellIndex.load(spark, str(tmp_path / "i"))
    a = index.search(base, 3, probes=2).orderBy("query_id", "rank").collect()
    assert a == back.search(base, 3, probes=2).orderBy("query_id", "rank").collect()
    assert index.remove(F.col("id") < 590).search(base, 3, probes=8).filter("id < 590").isEmpty()


def test_quantizers(matrix):
    for kind, slack in (("sq8", 0.02), ("sq4", 0.2), ("sq8u", 0.02), ("fp16", 0.002)):
        q = quantizers.ScalarQuantizer(kind).fit(matrix)
        assert np.abs(q.decode(q.encode(matrix)) - matrix).max() < slack
    flat = quantizers.ScalarQuantizer().fit(np.ones((3, 2)))
    assert (flat.decode(flat.encode(np.ones((3, 2)))) == 1).all()
    pq = quantizers.ProductQuantizer(4, 5).fit(matrix)
    codes = pq.encode(matrix)
    assert np.allclose(pq.distances(matrix[0], codes), ((pq.decode(codes) - matrix[0]) ** 2).sum(1))
    rq, lsq = (quantizers.AdditiveQuantizer(3, 4, residual=r).fit(matrix) for r in (True, False))
    for q in (rq, lsq):
        codes = q.encode(matrix)
        assert np.allclose(q.distances(matrix[0], codes), ((q.decode(codes) - matrix[0]) ** 2).sum(1))
        assert ((q.decode(codes) - matrix) ** 2).mean() < matrix.var(0).mean() / 3
    assert quantizers.kmeans(matrix[:3], 5).shape == (5, 16)
    turn = quantizers.random_rotation(16)
    assert np.allclose(turn.reverse(turn.apply(matrix)), matrix)
    white = quantizers.pca(matrix, 8, -0.5).apply(matrix)
    assert np.allclose(np.cov(white.T, bias=True), np.eye(8), atol=1e-6)


def test_chains_are_connected(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    roots = {r.id: r.root for r in grouping.connected(links).collect()}
    assert set(roots.values()) == {0, 100} and roots[40] == 0 and roots[101] == 100


def test_vector_files(spark, base, tmp_path):
    records = base.orderBy("id").limit(20).select(files.vector_bytes(F.col("v")).alias("r")).collect()
    (tmp_path / "a.fvecs").write_bytes(b"".join(bytes(r.r) for r in records[:12]))
    (tmp_path / "b.fvecs").write_bytes(b"".join(bytes(r.r) for r in records[12:]))
    back = files.read_vectors(spark, str(tmp_path)).orderBy("id").collect()
    assert [r.id for r in back] == [*range(20)]
    assert np.allclose([r.v for r in back], [r.v for r in base.orderBy("id").limit(20).collect()], atol=1e-6)


def test_documents_files(spark, tmp_path):
    from loomwork.plans.documents import Database

    (tmp_path / "in.csv").write_text('id,code,price,ok,day,note,list\n1,0812,+5,true,2024-01-02,"a ""b""","[1, 2]"\n2147483648,x,1.50,false,2024-01-02 10:00:00,,{bad\n')
    docs = files.read_csv(spark, str(tmp_path / "in.csv"))
    kinds = Database(spark, t=docs).query("SELECT TYPEOF(id) a, TYPEOF(code) b, TYPEOF(price) c, TYPEOF(ok) d, TYPEOF(day) e, TYPEOF(note) f, TYPEOF(list) g FROM t ORDER BY id").collect()
    assert [tuple(r) for r in kinds] == [("int", "string", "string", "bool", "datetime", "string", "array"), ("long", "string", "double", "bool", "datetime", "null", "string")]
    files.write_json_lines(docs, str(tmp_path / "out"))
    assert files.read_json_lines(spark, str(tmp_path / "out")).count() == 2
    (tmp_path / "arr.json").write_text('[{"a": 1}, {"a": 2}]')
    assert files.read_json_array(spark, str(tmp_path / "arr.json")).count() == 2
    files.write_csv(docs.select(F.to_json("doc").alias("j")), str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).count() == 2


def test_streaming(spark, tmp_path):
    from helpers import DATA

    from loomwork.operators import series, streams
    from loomwork.queries import keyspace_queries
    from loomwork.streaming import jobs

    events = spark.read.parquet(f"{DATA}/events.parquet").select(F.col("event_type").alias("key"), F.col("ts").cast("timestamp").alias("ts"), "value", F.col("event_id").alias("seq"))
    events.repartition(3).write.parquet(str(tmp_path / "e"))
    live = spark.readStream.schema(events.schema).parquet(str(tmp_path / "e"))
    jobs.run_once(jobs.buckets(live, "1 day", late="60 days"), "bars", str(tmp_path / "c1"), "update")
    bars = {(r.key, int(r.bucket.timestamp() * 1000)): (r.open, r.high, r.low, r.close) for r in spark.table("bars").collect()}
    batch = events.select("key", F.unix_millis("ts").alias("ts_ms"), "value", "seq")
    truth = {(r.key, r.bucket): (r.open, r.high, r.low, r.close) for r in series.candles(batch, 86_400_000).collect()}
    assert bars == truth
    log = keyspace_queries.group_log(spark, str(DATA))
    log.coalesce(1).write.parquet(str(tmp_path / "g"))
    jobs.run_once(jobs.group_pending(spark.readStream.schema(log.schema).parquet(str(tmp_path / "g"))), "pending", str(tmp_path / "c2"), "update")
    assert {tuple(r) for r in spark.table("pending").filter("ms is not null").collect()} == {tuple(r) for r in streams.fold_groups(log).collect()}


def test_large_query_sides_are_dealt_in_blocks(base, monkeypatch):
    want = vectors.knn(base, base, 3).orderBy("query_id", "rank").collect()
    near = {(r.query_id, r.id) for r in vectors.radius(base, base, 0.2).collect()}
    monkeypatch.setattr(vectors, "BROADCAST_VALUES", 10)
    cut = vectors._cut
    monkeypatch.setattr(vectors, "_cut", lambda table, rows, column: cut(table, 170, column))
    assert vectors.knn(base, base, 3).orderBy("query_id", "rank").collect() == want
    assert {(r.query_id, r.id) for r in vectors.radius(base, base, 0.2).collect()} == near


def test_sparse_vectors_hold_all_words(spark, tmp_path):
    from collections import Counter

    from loomwork.queries import catalog

    texts = {1: "A bee a\tcafé", 2: "bee BEE on\na café", 3: "ok", 4: "", 5: None, 6: "an ok naïve bee"}
    spark.createDataFrame([*texts.items()], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    words = {i: Counter((t or "").lower().split()) for i, t in texts.items()}
    want = []
    for q, mine in words.items():
        scores = sorted((-sum(n * other[w] for w, n in mine.items()), b) for b, other in words.items() if mine.keys() & other.keys())
        want += [(q, rank, b, -s) for rank, (s, b) in enumerate(scores[:3], 1)]
    got = catalog.QUERIES["v_sparse_ip"](spark, str(tmp_path)).select("query_id", "rank", "id", "distance").collect()
    assert sorted(map(tuple, got)) == sorted(want)
    held = catalog.QUERIES["v_sparse_normalized"](spark, str(tmp_path)).collect()
    assert Counter((r.id, r.dim) for r in held) == Counter((i, w) for i, c in words.items() for w in c)


def test_graphs_follow_their_metric(spark):
    rows = spark.createDataFrame([(0, [1.0, 0.0]), (1, [5.0, 5.0]), (2, [0.0, -1.0]), (3, [0.1, 0.1])], "id long, v array<double>")
    asked = spark.createDataFrame([(9, [0.9, 0.1])], "id long, v array<double>")
    first = {m: indexes.factory("HNSW4", rows, metric=m).search(asked, 1).first() for m in ("l2", "ip", "cosine")}
    assert {m: r.id for m, r in first.items()} == {"l2": 0, "ip": 1, "cosine": 0} and first["ip"].distance == pytest.approx(5.0)
    few = indexes.factory("HNSW4", rows).search(asked, 2, width=1, where=F.col("id").isin(1, 2))
    assert {r.id for r in few.collect()} == {1, 2}


@pytest.mark.parametrize("name", ["IVF4_HNSW8,Flat", "Flat,Refine(NONSENSE)", "IVF4,HNSW8", "XYZ"])
def test_unknown_factory_parts_are_rejected(spark, name):
    rows = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(8)], "id long, v array<double>")
    with pytest.raises(ValueError):
        indexes.factory(name, rows)


def test_sparse_search_in_many_blocks(spark):
    rows = [(i, d, float(1 + (i * d) % 3)) for i in range(40) for d in (0, 1 + i % 5, 10 + i % 7)]
    df = spark.createDataFrame(rows, "id long, dim long, val double")
    table = {}
    for i, d, v in rows:
        table.setdefault(i, {})[d] = v
    want = {(q, b, sum(v * y.get(d, 0.0) for d, v in x.items())) for q, x in table.items() for b, y in table.items()}
    got = vectors.sparse_search(df, df, block=7).collect()
    assert {(r.query_id, r.id, r.distance) for r in got} == want
    top = vectors.sparse_search(df, df, 3, block=7).collect()
    for q in table:
        best = sorted((-s, b) for a, b, s in want if a == q)[:3]
        assert sorted((r.rank, r.id, -r.distance) for r in top if r.query_id == q) == [(n, b, s) for n, (s, b) in enumerate(best, 1)]


def _kept_once(spark, base, metric, name="HNSW12"):
    """An index of many shards and blocks of queries, asked twice: the graphs are stored by the first search and read by the second."""
    index = indexes.factory(name, base, metric=metric)
    index.index.shard, index.index.together, index.index.block = 150, 2, 100
    first = index.search(base, 5, width=60)
    held = index.index.table
    again = index.search(base.filter("id % 2 = 0"), 5, width=60)
    assert index.index.table is held and held.select("s").distinct().count() == 4 and held.count() == 600
    rows = {(r.query_id, r["rank"]): (r.id, r.distance) for r in first.collect()}
    assert len(rows) == 3000 and {(r.query_id, r["rank"]): (r.id, r.distance) for r in again.collect()} == {k: v for k, v in rows.items() if k[0] % 2 == 0}
    assert vectors.recall(first, vectors.knn(base, base, 5, metric), 5).first().recall_at_k >= 0.95


def test_graphs_are_built_once_for_all_searches(spark, base):
    _kept_once(spark, base, "l2")


def test_graphs_for_inner_products_are_built_once(spark, base):
    _kept_once(spark, base, "ip")


def test_graphs_for_cosines_are_built_once(spark, base):
    _kept_once(spark, base, "cosine")


def test_graphs_of_codes_are_built_once(spark, base):
    index = indexes.factory("HNSW12,SQ8", base)
    index.index.shard, index.index.together, index.index.block = 150, 2, 100
    found = index.search(base, 5, width=60)
    assert vectors.recall(found, vectors.knn(base, base, 5), 5).first().recall_at_k >= 0.9
    assert index.index.table.select("s").distinct().count() == 4


@pytest.mark.parametrize("most", [30, 200, 100_000])
def test_sparse_search_by_falling_length(spark, monkeypatch, most):
    """Rows of very different and of equal lengths, negative values, few shared dimensions: each by blocks, and by queries sent to the rows."""
    monkeypatch.setattr(vectors, "SPARSE_VALUES", most)
    rng = np.random.default_rng(5)
    table = {i: {int(d): float(rng.integers(-2, 5) or 1) * (1 + (i % 7 == 0) * i) for d in rng.choice(40, 1 + i % 6, replace=False)} for i in range(60)} | {99: {77: 0.5}, 98: {77: 3.0}}
    df = spark.createDataFrame([(i, d, v) for i, x in table.items() for d, v in x.items()], "id long, dim long, val double")
    want = []
    for q, x in table.items():
        met = sorted((-sum(v * y.get(d, 0.0) for d, v in x.items()), b) for b, y in table.items() if x.keys() & y.keys())
        want += [(q, n, b, -s) for n, (s, b) in enumerate(met[:3], 1)]
    assert sorted(map(tuple, vectors.sparse_search(df, df, 3).collect())) == sorted(want)
    some = df.filter("id % 5 = 0")
    assert sorted(map(tuple, vectors.sparse_search(df, some, 3).collect())) == sorted(w for w in want if w[0] % 5 == 0)


def test_words_of_rows_with_one_id_count_together(spark):
    words = spark.createDataFrame([(1, ["a", "b", "a"]), (2, []), (3, None), (1, ["b"])], "id long, words array<string>")
    assert [(r.id, sorted(r.v)) for r in vectors.sparse_counts(words).collect()] == [(1, [2.0, 2.0])]
