from collections import Counter

import pytest
from helpers import DATA, same_rows
from pyspark.sql import functions as F

from loomwork.llm import line_rules, mixing, queries, text


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_as_sql(spark, duck, name):
    same_rows(queries.QUERIES[name](spark, str(DATA)), duck, queries.SQL[name])


def brute(body):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", body or "")
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (body or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in body or ""), len(lines) - len(set(lines)), len(covered)


def test_statistics_of_odd_rows(spark, odd, empty):
    rows = line_rules.judged(odd).collect()
    want = Counter(brute(r.text) for r in odd.collect())
    assert Counter((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows) == want
    assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) for r in rows)
    assert not any(r.kept for r in rows if r.base_failed)
    assert line_rules.judged(empty).count() == 0
    whole = line_rules.apply_rules(odd)
    assert whole.count() == odd.count() and set(odd.columns) <= set(whole.columns)
    assert line_rules.kept_rows(odd).columns == odd.columns and line_rules.kept_rows(empty).count() == 0


def word(*numbers):
    """A word of letters for some numbers, as digits are alike to the rules."""
    return "-".join("abcdefghij"[int(c)] for n in numbers for c in str(n)) + "".join("qrstu"[len(str(n))] for n in numbers)


def test_common_lines_deplete_but_copies_do_not(spark):
    common = "\n".join(" ".join(word(i, j, 1) for j in range(10)) for i in range(8))
    own = lambda d: " ".join(word(d, j) for j in range(20))
    rows = [(d, own(d) + "\n" + common, "h") for d in range(200)]
    rows += [(1000 + d, "\n".join(" ".join(word(i, j, 2) for j in range(10)) for i in range(8)), "h") for d in range(60)]
    rows += [(2000, own(2000) + "\n" + own(2001) + "\n" + own(2002), "h"), (3000, own(3000) + "\n" + common, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = {r.doc_id: r.kept for r in line_rules.judged(df).collect()}
    assert not any(kept[d] for d in range(200))  # 80 of 100 words are common to 200 documents
    assert all(kept[1000 + d] for d in range(60)) and kept[2000] and kept[3000]


def test_documents_that_share_their_extreme_lines_count_each(spark):
    template = [" ".join(word(i, j, 3) for j in range(6)) for i in range(10)]
    pages = [(d, "\n".join([*template, " ".join(word(d, j, 4) for j in range(20))]), "h") for d in range(60)]
    # only common lines, in another order each
    pages += [(1000 + d, "\n".join(" ".join(word(i, j, 5) for j in range(6)) for i in (*range(d % 30, 30), *range(d % 30))), "g") for d in range(30)]
    df = spark.createDataFrame(pages, "doc_id long, text string, source string")
    rows = line_rules.judged(df).collect()
    assert {(r.removed_words, r.kept) for r in rows if r.doc_id < 1000} == {(60, False)}
    assert {(r.removed_words, r.kept) for r in rows if r.doc_id >= 1000} == {(180, False)}


def test_mixing_odd_rows(spark, odd, empty):
    mix = mixing.draw(odd)
    rows = mix.documents.collect()
    assert len(rows) == odd.count()
    sizes = Counter()
    for r in rows:
        sizes[r.source] += r["size"]
        assert 0 <= r.taken <= 3 * r["size"] and (r.taken > 0) == (r.first_shard is not None)
    taken = Counter()
    for r in rows:
        taken[r.source] += r.taken
        assert r.source_size == sizes[r.source] and r.target <= 3 * sizes[r.source] + 1e-6
    for r in rows:
        assert abs(taken[r.source] - r.target) <= max(2, 0.01 * r.target)
    assert sorted(map(str, rows)) == sorted(map(str, mixing.draw(odd).documents.collect()))
    assert mixing.draw(empty).documents.count() == 0 and mixing.emit(empty, mixing.draw(empty)).count() == 0
    out = mixing.emit(odd, mix)
    assert out.columns == odd.columns
    words = {r.source: r.n for r in out.groupBy("source").agg(F.sum(text.word_count(F.col("text"))).alias("n")).collect()}
    assert words == {k: v for k, v in taken.items() if v}


def test_emitted_texts_are_what_was_drawn(spark):
    """Also without n_chars; a cut text keeps its lines."""
    rows = [(d, " ".join(f"w{i}" for i in range(d % 9)) + f"\n  x{d}\ty{d} " * (d % 4), "ab"[d % 3 > 0]) for d in range(200)] + [(7, "w0 w1\n w2", "a")] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mix = mixing.draw(df, weights=(1, 5))
    want = Counter()
    for r in mix.documents.collect():
        want[r.doc_id] += r.taken
    got, texts = Counter(), {}
    for d, t, s in rows:
        texts.setdefault(d, set()).add(t)
    for r in mixing.emit(df, mix).collect():
        got[r.doc_id] += len(r.text.split())
        assert any(t.startswith(r.text) for t in texts[r.doc_id])
    assert got == Counter({k: v for k, v in want.items() if v}) and set(want.values()) != {0}


def test_shards_take_their_quotas(spark):
    """With blocks of a few words, what the documents say of their shards adds up to the shards' quotas."""
    rows = [(d, "w " * (1 + d % 7), "abc"[d % 3]) for d in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mix = mixing.draw(df, blocks=300, shards=7)
    for source in mix.sources.collect():
        own = sorted((r.start, r["size"], r.taken, r.first_shard, r.last_shard) for r in mix.documents.filter(F.col("source") == source.source).collect())
        shard = [next(s for s, q in enumerate(source.quotas, 1) if q > place) for place in range(source.quota_blocks)]
        assert len(source.quotas) == 7 and source.quotas == sorted(source.quotas) and source.quotas[-1] == source.quota_blocks
        for start, size, taken, first, last in own:
            words = [p * source.n_blocks + (start + i) // source.block_words for p in range(4) for i in range(size)]
            drawn = [x for x in words if x < source.quota_blocks]
            assert (taken, first, last) == ((len(drawn), shard[drawn[0]], shard[drawn[-1]]) if drawn else (0, None, None))


def test_targets_against_a_plain_version(spark):
    sizes = {"a": 10, "b": 100_000, "c": 50, "d": 30_000, None: 7, "e": 0}
    df = spark.createDataFrame([(k, v) for k, v in sizes.items()], "source string, size long")
    got = {r.source: r.target for r in mixing.source_targets(df).collect()}
    names = [*sorted(k for k in sizes if k is not None), None]
    weight = {k: (1, 2, 3)[i % 3] for i, k in enumerate(names)}
    fixed, total = {}, sum(sizes.values())
    while True:
        free = [k for k in names if k not in fixed]
        share = (total - sum(fixed.values())) / sum(weight[k] for k in free)
        over = [k for k in free if share * weight[k] > 3 * sizes[k]]
        if not over:
            break
        fixed |= {k: 3.0 * sizes[k] for k in over}
    assert got == pytest.approx(fixed | {k: share * weight[k] for k in free})


def test_quotas_are_the_highest_quotients(spark):
    sizes = {"a": 700, "b": 1300, "c": 41, "d": 990}
    df = spark.createDataFrame([(k, v) for k, v in sizes.items()], "source string, size long")
    targets = mixing.source_targets(df)
    rows = mixing.quotas(targets, blocks=300, shards=7).collect()
    want = {r.source: r.target for r in targets.collect() if not r.capped}
    block = rows[0].block_words
    house = round(sum(want.values()) / block)
    for shard in range(1, 8):
        n = house * shard // 7
        best = sorted(((-t / (2 * k - 1), s) for s, t in want.items() for k in range(1, house + 2)))[:n]
        assert {r.source: r.drawn for r in rows if r.shard == shard and r.source in want} == {s: sum(b[1] == s for b in best) for s in want}
    assert all(r.quota >= 0 for r in rows)
