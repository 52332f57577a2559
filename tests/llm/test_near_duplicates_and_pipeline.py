import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from helpers import DATA

from loomwork.llm import near_duplicates as nd
from loomwork.llm import queries


def bag(text, width=5):
    words = (text or "").encode().split()
    return Counter(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))) if words else Counter()


def classes_by_force(rows):
    """doc_id to the least id of its class, by comparing all pairs that share a shingle."""
    bags = [bag(r[1]) for r in rows]
    parent = [*range(len(rows))]

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    holders = defaultdict(list)
    for i, b in enumerate(bags):
        for g in b:
            holders[g].append(i)
    shared = Counter()
    for g, own in holders.items():
        for k, i in enumerate(own):
            for j in own[k + 1 :]:
                shared[i, j] += min(bags[i][g], bags[j][g])
    texts = defaultdict(list)
    for i, r in enumerate(rows):
        if r[1] is not None:
            texts[r[1]].append(i)
    pairs = [(own[0], i) for own in texts.values() for i in own[1:]]
    pairs += [(i, j) for (i, j), n in shared.items() if n / (sum(bags[i].values()) + sum(bags[j].values()) - n) >= 0.8]
    for i, j in pairs:
        a, b = find(i), find(j)
        parent[max(a, b)] = min(a, b)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return Counter((r[0], least.get(find(i))) for i, r in enumerate(rows))


def test_query_against_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    got = Counter((r.doc_id, r.class_id) for r in queries.op3_near_duplicates(spark, str(DATA)).collect())
    assert got == classes_by_force(rows)


@pytest.mark.parametrize("base_there", [True, False])
def test_large_families_without_links_between_most_members(spark, base_there):
    """Copies of one text with several changed words: many pairs are just above or below the limit."""
    rng = random.Random(4)
    base = [f"w{i}" for i in range(140)]
    rows = [(0, " ".join(base))] if base_there else []
    for d in range(1, 160):
        words = base.copy()
        for at in rng.sample(range(140), rng.choice((1, 2, 3, 4))):
            words[at] = f"x{d}y{at}"
        rows.append((d, " ".join(words)))
    shared = " ".join(f"boiler{i}" for i in range(30))
    rows += [(1000 + d, " ".join(f"own{d}w{i}" for i in range(90)) + " " + shared) for d in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter((r.doc_id, r.class_id) for r in nd.classes(df).collect()) == classes_by_force(rows)


def test_odd_rows(spark, odd, empty):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert Counter((r.doc_id, r.class_id) for r in nd.classes(odd).collect()) == classes_by_force(rows)
    first = nd.first_of_each(odd)
    assert first.columns == odd.columns
    assert Counter(r.doc_id for r in first.collect()) == Counter([1, 2, 3, None, None, 5, 6, 7, 8])
    assert nd.classes(empty).count() == 0 and nd.first_of_each(empty).count() == 0


def test_multiplicity_counts(spark):
    rows = [(1, "a b c d e " * 10), (2, "a b c d e " * 11), (3, "a b c d e " * 40)]
    got = {r.doc_id: r.class_id for r in nd.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 3}


def test_signatures_are_unbiased():
    rng = np.random.default_rng(0)
    errors = []
    for _ in range(40):
        n = rng.integers(3, 300)
        h = rng.integers(0, 2**63, n, dtype=np.uint64)
        wa = rng.integers(0, 9, n)
        wb = np.where(rng.random(n) < 0.7, wa, rng.integers(0, 9, n))
        a, b = (h[wa > 0], wa[wa > 0]), (h[wb > 0], wb[wb > 0])
        if len(a[0]) and len(b[0]):
            s = nd.signatures([a, b], 512)
            errors.append((s[0] == s[1]).mean() - nd.overlap(a, b))
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.04


@pytest.mark.parametrize("power", [6, 7, 8, 9])
def test_signatures_agree_across_powers_of_two(power):
    """Bags on either side of a power of two draw their points in other portions, but the same points."""
    rng = np.random.default_rng(power)
    agreed, exact = [], []
    for _ in range(60):
        h = rng.integers(0, 2**63, 2**power + 2, dtype=np.uint64)
        fresh = rng.integers(0, 2**63, 2**power // 10, dtype=np.uint64)
        large = (np.sort(h), np.ones(len(h), np.int64))
        small = np.sort(np.concatenate([h[: 2**power - 2 - len(fresh)], fresh]))
        small = (small, np.ones(len(small), np.int64))
        s = nd.signatures([large, small], 256)
        agreed.append((s[0] == s[1]).mean())
        exact.append(nd.overlap(large, small))
    assert abs(np.mean(agreed) - np.mean(exact)) < 0.02


def test_repeated_ids_with_other_texts(spark):
    """Two texts of one id in one class: only one row stays, whatever the order."""
    base = [f"w{i}" for i in range(100)]
    rows = [(1, " ".join(base)), (1, " ".join(base[:-1] + ["other"])), (2, " ".join(["start"] + base[1:])), (1, "a text of its own that is not like them"), (2, " ".join(base))]
    for order in (rows, rows[::-1]):
        kept = [tuple(r) for r in nd.first_of_each(spark.createDataFrame(order, "doc_id long, text string")).collect()]
        assert sorted(r[0] for r in kept) == [1, 1] and rows[3] in kept and len(set(kept) & {rows[0], rows[1]}) == 1


def test_components_of_chains(spark):
    links = spark.createDataFrame([(bytes([i]), bytes([i + 1])) for i in range(60)] + [(b"y", b"z")], "a binary, b binary")
    roots = {bytes(r.node): bytes(r.root) for r in nd.components(links.repartition(5)).collect()}
    assert set(roots.values()) == {b"\0", b"y"} or set(roots.values()) == {b"\0"} or len(set(roots.values())) == 2


def test_pipeline_stages(spark, odd, empty):
    import corpus_pipeline as p

    assert [n for n, _ in p.STAGES] == ["quality classifier", "quality rules", "near-duplicates", "mixing", "packing"]
    sf = str(DATA)
    docs = spark.read.parquet(f"{sf}/documents.parquet").cache()
    ids = {r.doc_id for r in docs.collect()}
    score = {r.doc_id: r.predicted for r in queries.op10_quality(spark, sf).collect()}
    first = p.quality_classifier(spark, docs, sf).cache()
    assert {r.doc_id for r in first.collect()} == {i for i in ids if score[i]} and first.columns == docs.columns
    from loomwork.llm import line_rules

    second = p.quality_rules(spark, first, sf).cache()
    kept = {r.doc_id for r in line_rules.judged(first).collect() if r.kept}
    assert {r.doc_id for r in second.collect()} == kept
    third = p.near_duplicate_removal(spark, second, sf).cache()
    rows = [(r.doc_id, r.text) for r in second.collect()]
    assert {r.doc_id for r in third.collect()} == {d for d, c in classes_by_force(rows) if d == c}
    fourth = p.source_mixing(spark, third, sf).cache()
    assert fourth.columns == docs.columns and max(Counter(r.doc_id for r in fourth.collect()).values()) <= 3
    last = p.sequence_packing(spark, fourth, sf)
    assert {r.doc_id for r in last.select("doc_id").distinct().collect()} == {r.doc_id for r in fourth.collect()}
    for _, stage in p.STAGES:
        assert stage(spark, empty, sf).count() == 0
        stage(spark, odd, sf).count()
