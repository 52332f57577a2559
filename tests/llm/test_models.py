import math
import zlib
from collections import Counter

import numpy as np
import pytest
from helpers import DATA
from pyspark.sql import functions as F

from loomwork.llm import hd_language, quality_model, queries, suffix_model, vector_index


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    rows = queries.op10_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    out = [r for r in rows if r.held_out]
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert np.mean([(r.predicted == r.quality) for r in out]) > 0.93
    assert np.mean([r.predicted for r in out if r.quality]) > 0.97


def test_quality_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1), (1, None), (2, 0), (5, 7), (None, 1), (7, 0), (8, 1)], "doc_id long, quality int")
    out = quality_model.with_scores(odd, labels)
    assert out.count() == odd.count() and set(out.columns) == set(odd.columns)
    assert out.filter(~F.col("score").between(0, 1) | F.col("score").isNull()).isEmpty()
    assert quality_model.classify(empty, labels).count() == 0
    assert {r.score for r in quality_model.classify(odd, labels.limit(0)).collect()} == {0.5}


def test_isotonic_rises_and_fits():
    assert quality_model.isotonic(np.array([0, 3, 1, 4]), np.array([4, 4, 4, 4])).tolist() == pytest.approx([0.1, 0.5, 0.5, 0.9])


def test_languages(spark):
    sf = "/root/testdata/sf0.01"
    rows = queries.op7_language(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert np.mean([r.lang == r.lang_pred for r in rows if r.held_out]) > 0.98
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)


def test_language_odd_rows(spark, odd, empty):
    names, profiles = hd_language.learn(odd)
    rows = hd_language.predict(odd, names, profiles).collect()
    assert names == ["de", "en", "fr"] and len(rows) == odd.count()
    for r in rows:
        assert 0 <= r.score <= 1 and (r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or ""))
    names, profiles = hd_language.learn(empty)
    assert names == [] and {r.lang_pred for r in hd_language.predict(odd, names, profiles).collect()} == {"und"}


def test_trigrams_of_windows_are_those_of_the_whole():
    body = "Ein langer Satz, mit Zahlen 123 und Äpfeln! " * 40
    want = hd_language.trigrams(body)
    kept, hd_language._WINDOW = hd_language._WINDOW, 37
    try:
        got = hd_language.trigrams(body)
    finally:
        hd_language._WINDOW = kept
    assert (want[0] == got[0]).all() and (want[1] == got[1]).all()


def lm_counts(rows):
    import re

    count = Counter()
    words = lambda t: [*re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode())), None]
    for r in rows:
        if r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 7 != 2:
            count.update(words(r.text))
    return count, words


@pytest.mark.parametrize("which", ["all", "odd"])
def test_suffix_scores(spark, odd, which):
    if which == "all":
        docs = spark.read.parquet(f"{DATA}/documents.parquet")
        rows = queries.op5_suffix_scores(spark, str(DATA)).collect()
        assert sum(r.score > r.base_score for r in rows if r.held_out) > 0.6 * sum(r.held_out for r in rows)
    else:
        from loomwork.llm import text

        docs = odd
        rows = suffix_model.score(odd, odd.filter(text.remainder(F.col("doc_id"), 7) != 2)).collect()
    count, words = lm_counts(docs.collect())
    n, v = sum(count.values()), len(count)
    want = sorted((r.doc_id or -1, len(words(r.text)), sum(count[w] > 0 for w in words(r.text)), n, sum(math.log10((count[w] + 1) / (n + v + 1)) for w in words(r.text))) for r in docs.collect())
    got = sorted((r.doc_id or -1, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in rows)
    assert [x[:4] for x in got] == [x[:4] for x in want]
    assert [x[4] for x in got] == pytest.approx([x[4] for x in want], rel=1e-9)


def test_distributions_sum_to_one(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    words = suffix_model.counted(docs)
    tree = suffix_model.grow(docs, words, evidence=2.0)
    assert tree.tokens == sum(len((r.text or "").encode().split()) + 1 for r in docs.collect())
    assert [lv.kept.any() for lv in tree.levels] == [True, True]
    everything = np.arange(len(tree.hashes))
    # the mass of words outside the alphabet, which keep their add-one counts, and of the one unknown kind
    rest = 1 - (10.0 ** tree.root(everything)).sum()
    for level in (1, 2):
        held = tree.levels[level - 1]
        for state in np.flatnonzero(held.kept)[:25]:
            code = int(held.codes[state])
            first = int(tree.levels[0].codes[code // tree.size]) if level == 2 else None
            context = [code] if level == 1 else [code % tree.size, first]
            p = tree.probability(np.tile(np.array(context), (len(everything), 1)), everything, level)
            escape = 10.0 ** held.escape[state]
            if level == 2:
                one = np.flatnonzero(tree.levels[0].codes == context[0])
                if len(one) and tree.levels[0].kept[one[0]]:
                    escape *= 10.0 ** tree.levels[0].escape[one[0]]
            assert p.sum() + escape * rest == pytest.approx(1, abs=1e-6)


@pytest.mark.parametrize("share", [5e-7, 1e-3])
def test_suffix_scores_use_every_state_of_the_tree(spark, share):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = suffix_model.score(docs, docs, context_share=share, next_share=share).collect()
    tree = suffix_model.grow(docs, suffix_model.counted(docs))
    table = suffix_model.Symbols(tree.hashes)
    want = []
    for r in docs.collect():
        symbols = table.read([r.text])[1]
        total, open_ = tree.score(symbols)
        root = np.where(symbols >= 0, tree.root(symbols), np.log10(2 / (tree.tokens + tree.kinds + 1)))
        want.append((r.doc_id, (total + np.where(open_, root, 0)).sum()))
    got = sorted((r.doc_id, r.score) for r in rows)
    assert [g[0] for g in got] == [w[0] for w in sorted(want)]
    assert [g[1] for g in got] == pytest.approx([w[1] for w in sorted(want)], rel=1e-9)


def plain_tree(training, depth=2):
    """The method by dictionaries: a function from (context, symbol) to probability."""
    counts = [Counter() for _ in range(depth + 1)]
    for words in training:
        for i in range(len(words)):
            for n in range(min(depth, i) + 1):
                counts[n][tuple(words[i - n : i + 1])] += 1
    total, kinds, states = sum(counts[0].values()), len(counts[0]), {}

    def probability(context, symbol):
        if not context:
            return (counts[0][(symbol,)] + 1) / (total + kinds + 1)
        if context not in states:
            return probability(context[1:], symbol)
        own, escape = states[context]
        return own.get(symbol, 0.0) + escape * probability(context[1:], symbol)

    for n in range(1, depth + 1):
        found = {}
        for gram, c in counts[n].items():
            if c >= 2 and counts[n - 1][gram[:-1]] >= (2 if n == 1 else 4):
                found.setdefault(gram[:-1], {})[gram[-1]] = c
        made = {}
        for context, after in found.items():
            whole = counts[n - 1][context]
            gain = sum(c * math.log(c / whole / probability(context[1:], w)) for w, c in after.items())
            if gain >= 8.0:
                own = {w: (c - 0.5) / whole for w, c in after.items()}
                made[context] = (own, max(1 - sum(own.values()), 1e-12))
        states |= made
    return probability, states


def test_suffix_scores_of_a_word_that_is_seldom_in_training_only(spark, monkeypatch):
    training = spark.createDataFrame([(k, text) for k, text in enumerate(["alpha beta", "alpha beta", *[f"gamma delta {k}" for k in range(40)]])], "doc_id long, text string")
    docs = spark.createDataFrame([(k, "alpha") for k in range(300)] + [(300, "alpha beta"), (301, "beta unseen"), (302, None)], "doc_id long, text string").coalesce(1)
    names, plain = [], suffix_model.stored

    def noted(df, name):
        names.append(name)
        return plain(df, name)

    monkeypatch.setattr(suffix_model, "stored", noted)
    results = []
    for hot in (1024, 20):
        monkeypatch.setattr(suffix_model, "_HOT", hot)
        names.clear()
        rows = suffix_model.score(docs, training, context_share=1.0, next_share=1.0, evidence=0.1).collect()
        results.append({r.doc_id: r for r in rows})
        assert names.count("lm-gained") == suffix_model._PIECES + (hot == 20)
    for k, row in results[0].items():
        other = results[1][k]
        assert (row.n_known, row.n_tokens) == (other.n_known, other.n_tokens)
        assert row.score == pytest.approx(other.score, abs=1e-9) and row.base_score == pytest.approx(other.base_score, abs=1e-9)
    assert [results[0][k].n_known for k in (0, 300, 301, 302)] == [2, 3, 2, 1]


def test_places_of_sorted_keys():
    rng = np.random.default_rng(5)
    keys = np.unique(rng.integers(-(2**63), 2**63 - 1, 5000))
    asked = np.concatenate([keys[::3], rng.integers(-(2**63), 2**63 - 1, 500), [-(2**63), 2**63 - 1]])
    for some in (keys, keys[:1], keys[:0], np.arange(200), np.array([-(2**63), 2**63 - 1])):
        assert (suffix_model.Places(some).find(asked) == suffix_model._found(some, asked)).all()


def test_suffix_scores_against_a_plain_tree(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").collect()
    words = lambda t: [*lm_counts([])[1](t)]
    probability, states = plain_tree([words(r.text) for r in docs if zlib.crc32(str(r.doc_id).encode()) % 7 != 2])
    assert {len(s) for s in states} == {1, 2}
    got = {r.doc_id: r.score for r in queries.op5_suffix_scores(spark, str(DATA)).collect()}
    for r in docs:
        own = words(r.text)
        want = sum(math.log10(probability(tuple(own[max(0, i - 2) : i]), w)) for i, w in enumerate(own))
        assert got[r.doc_id] == pytest.approx(want, rel=1e-9)


def test_languages_against_a_plain_version(spark):
    """Trigram by trigram, from texts to cosines."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet").collect()
    letters = hd_language.Vectors(1024, 5).letter

    def grams(body):
        plain = " ".join("".join(c if c.isalpha() else " " for c in (body or "").lower()).split())
        return Counter(zip(*[f" {plain} "[i:] for i in range(3)], strict=False)) if plain else Counter()

    made = {}

    def bundle(counts):
        total = np.zeros(1024)
        for (a, b, c), n in counts.items():
            if (a, b, c) not in made:
                made[a, b, c] = np.roll(letters(ord(a)), 2) * np.roll(letters(ord(b)), 1) * letters(ord(c))
            total += n * made[a, b, c]
        return total

    sums = {}
    for r in docs:
        if zlib.crc32(str(r.doc_id).encode()) % 4 != 2 and r.lang is not None:
            sums.setdefault(r.lang, Counter()).update(grams(r.text))
    profiles = {k: bundle(v) / np.linalg.norm(bundle(v)) for k, v in sorted(sums.items()) if v}
    got = {r.doc_id: r for r in queries.op7_language(spark, str(DATA)).collect()}
    for r in docs:
        own = bundle(grams(r.text))
        if not own.any():
            assert (got[r.doc_id].lang_pred, got[r.doc_id].score) == ("und", 0.0)
            continue
        cosine = {k: p @ own / np.linalg.norm(own) for k, p in profiles.items()}
        assert got[r.doc_id].lang_pred == max(cosine, key=cosine.get)
        assert got[r.doc_id].score == pytest.approx(max(0.0, *cosine.values()), abs=1e-4)


def test_quality_against_a_plain_version(spark):
    """The same random features, fitted in one place by textbook ridge and isotonic regression."""
    rows = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", F.pmod(F.xxhash64("doc_id"), F.lit(5)).alias("fold")).collect()
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA}/labels.parquet").collect() if r.quality is not None and zlib.crc32(str(r.doc_id).encode()) % 5}
    x = np.stack([quality_model.statistics(r.text) for r in rows])
    own = np.array([r.doc_id in label for r in rows])
    y, fold = np.array([label.get(r.doc_id, 0) for r in rows], float)[own], np.array([r.fold for r in rows])[own]
    mean, scale = x[own].mean(0), x[own].std(0)
    rng = np.random.default_rng(11)
    directions, phases = rng.normal(size=(x.shape[1], 160)) / 3.0, rng.uniform(0, 2 * np.pi, 160)
    z = np.clip((x - mean) / np.where(scale > 1e-9, scale, 1), -6, 6) @ directions + phases
    z = np.hstack([np.ones((len(x), 1)), np.sqrt(2 / 160) * np.cos(z)])

    def ridge(use):
        a = z[own][use]
        return np.linalg.solve(a.T @ a + 1e-3 * max(1.0, len(a)) / 161 * np.eye(161), a.T @ y[use])

    raw = np.concatenate([z[own][fold == i] @ ridge(fold != i) for i in range(5)])
    at = np.clip((raw + 0.5) / 2.0 * 2000, 0, 1999).astype(int)
    truth = np.concatenate([y[fold == i] for i in range(5)])
    bins = sorted(set(at.tolist()))
    p, t = [truth[at == b].sum() for b in bins], [(at == b).sum() for b in bins]
    # the isotonic mean of a place is the greatest least mean of blocks around it; its block's ends give the counts
    blocks = []
    for a, b in zip(p, t, strict=True):
        blocks.append([a, b, 1])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            last = blocks.pop()
            blocks[-1] = [u + v for u, v in zip(blocks[-1], last, strict=True)]
    level = np.maximum.accumulate([(a + 0.5) / (b + 1) for a, b, n in blocks for _ in range(n)])
    want = np.clip(np.interp(z @ ridge(np.ones(len(y), bool)), -0.5 + (np.array(bins) + 0.5) / 1000, level), 0, 1)
    got = {r.doc_id: r.score for r in queries.op10_quality(spark, str(DATA)).collect()}
    assert [got[r.doc_id] for r in rows] == pytest.approx(want.tolist(), abs=2e-3)


def test_suffix_scores_of_empty_tables(spark, odd, empty):
    assert suffix_model.score(empty, empty).count() == 0
    rows = suffix_model.score(odd, empty).collect()
    assert len(rows) == odd.count() and all(r.n_known == 0 and r.train_tokens == 0 and r.score == pytest.approx(0) for r in rows)


def nearest_by_force(ids, x, query, k):
    s = (x * x[query]).sum(1) / (np.linalg.norm(x, axis=1) * np.linalg.norm(x[query]))
    s[ids == ids[query]] = -np.inf
    return np.lexsort((ids, -s))[:k], s


def test_vector_recall(spark):
    sf = "/root/testdata/sf0.01"
    rows = queries.op4_vector_search(spark, sf).collect()
    table = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect()
    ids, x = np.array([r.vec_id for r in table]), np.array([r.embedding for r in table], float)
    found = {}
    for r in rows:
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    hits = 0
    for q in np.flatnonzero(ids % 50 == 0):
        best, s = nearest_by_force(ids, x, q, 5)
        mine = sorted(found[ids[q]])
        assert [m[0] for m in mine] == [1, 2, 3, 4, 5]
        for _, i, score in mine:
            assert score == pytest.approx(s[ids == i][0], abs=1e-12)
        assert mine == sorted(mine, key=lambda m: (-m[2], m[1]))
        hits += len({m[1] for m in mine} & set(ids[best]))
    assert hits / (5 * len(found)) >= 0.9


def test_vector_odd_rows(spark):
    good = [(i, [float(i % 3 + 1), 1.0, 0.5]) for i in range(0, 120)]
    bad = [(200, None), (250, [0.0, 0.0, 0.0]), (300, [1.0, None, 1.0]), (350, [float("nan"), 1.0, 1.0]), (400, [float("inf"), 1.0, 1.0]), (450, [1.0]), (None, [1.0, 1.0, 1.0]), (500, [])]
    df = spark.createDataFrame(good + bad + good[:2], "vec_id long, embedding array<float>").withColumn("score", F.lit(1)).withColumn("cell", F.lit(1))
    rows = vector_index.search(df, lambda i: i % 50 == 0).collect()
    assert {r.query_id for r in rows} == {0, 50, 100} and not {r.vec_id for r in rows} & {200, 250, 300, 350, 400, 450, 500}
    for q in (0, 50, 100):
        mine = sorted((r["rank"], r.vec_id) for r in rows if r.query_id == q)
        same = [i for i, v in good if i % 3 == q % 3 and i != q]
        if q:
            assert [m[1] for m in mine] == ([0, 0] + same[1:] if 0 in same else same if 1 not in same else [1, 1] + same[1:])[:5]
    few = vector_index.search(df.filter("vec_id < 3 or vec_id = 50"), lambda i: i % 50 == 0).collect()
    assert {(r.query_id, r.vec_id) for r in few} == {(0, 1), (0, 2), (0, 50), (50, 0), (50, 1), (50, 2)}
    assert vector_index.search(df.limit(0), lambda i: i % 50 == 0).count() == 0
