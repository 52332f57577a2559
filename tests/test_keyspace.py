import pytest
from pyspark.sql import functions as F

from loomwork.functions import glob
from loomwork.operators import keyspace, lists, streams, zsets
from loomwork.plans import keyspace_sql
from loomwork.plans.syntax import SyntaxProblem


@pytest.mark.parametrize(
    "pattern, yes, no",
    [("a*", "abc", "ba"), ("?b", "ab", "abb"), ("[a-c]x", "bx", "dx"), ("[^a]x", "bx", "ax"), ("[!a]x", "bx", "ax"), ("\\*", "*", "a"), ("a.b", "a.b", "axb"), ("x*y", "x\ny", "xyz")],
)
def test_glob(pattern, yes, no):
    import re

    assert re.match(glob.regex(pattern), yes) and not re.match(glob.regex(pattern), no)


def test_glob_literal():
    assert glob.literal("abc") == "abc" and glob.literal("a*") is None


@pytest.fixture
def space(spark):
    strings = spark.createDataFrame([("a", "one"), ("b", "Two"), ("c", "three"), ("ABC", "x")], "key string, value string")
    zs = spark.createDataFrame([("z", "m", 1.0), ("z", "n", 2.0)], "key string, member string, score double")
    expiry = spark.createDataFrame([("b", 5000), ("c", 1000)], "key string, expires_at long")
    return keyspace.Keyspace(spark, {"string": strings, "zset": zs}, expiry)


def names(df):
    return "".join(sorted(r.key for r in df.collect()))


def test_expiry_is_from_its_time_on(space):
    assert names(space.keys(999)) == "ABCabcz"
    assert names(space.keys(1000)) == "ABCabz"
    assert space.keys(1000).filter("key = 'b'").first().ttl == 4.0
    assert names(space.persist("c").keys(9999)) == "ABCacz"
    assert names(space.sweep(9999).keys(0)) == "ABCaz"
    assert names(space.put("string", space.spark.createDataFrame([("c", "new")], "key string, value string")).keys(9999)) == "ABCacz"
    with pytest.raises(TypeError):
        space.put("set", space.spark.createDataFrame([("a", "m")], "key string, member string"))


def test_rename_moves_value_and_expiry(space):
    out = space.rename("b", "a")
    assert names(out.keys(0)) == "ABCacz" and out.keys(0).filter("key = 'a'").first().value == "Two"
    assert out.keys(1000).filter("key = 'a'").first().ttl == 4.0
    assert [r.value for r in space.get_many(["a", "none", "z", "b"], 0).orderBy("pos").collect()] == ["one", None, None, "Two"]


@pytest.mark.parametrize(
    "where, expected",
    [
        ("type = 'zset' OR type = 'string' AND key = 'a'", "a"),
        ("key = 'abc'", ""),
        ("key = 'abc' OR size > 99", "ABC"),
        ("NOT type = 'string'", "z"),
        ("value != 'one'", "ABCbcz"),
        ("value LIKE 'T%'", "b"),
        ("value IN ('TWO', 'ONE')", "ab"),
        ("ttl < 4.5 AND len > 1", "c"),
        ("(key LIKE 'a%' OR key LIKE 'b%') AND NOT size > 3", "ab"),
    ],
)
def test_keyspace_sql(space, where, expected):
    assert names(keyspace_sql.run(space.keys(500), f"SELECT key FROM keys WHERE {where}")) == expected


def test_keyspace_sql_order_and_problems(space):
    rows = keyspace_sql.run(space.keys(500), "SELECT key, ttl FROM keys ORDER BY ttl LIMIT 2").collect()
    assert [r.key for r in rows] == ["c", "b"]
    for text in ("SELECT nope FROM keys", "SELECT key FROM other", "SELECT key FROM keys WHERE key LIKE", "SELECT key FROM keys LIMIT x", "SELECT key FROM keys WHERE key NOT 5"):
        with pytest.raises(SyntaxProblem):
            keyspace_sql.run(space.keys(500), text)


def test_snapshot(space, tmp_path):
    space.save(str(tmp_path / "s"))
    back = keyspace.Keyspace.load(space.spark, str(tmp_path / "s"))
    assert names(back.keys(1000)) == names(space.keys(1000)) and set(back.tables) == {"string", "zset"}


@pytest.mark.parametrize("start, stop, expected", [(0, -1, "abcde"), (1, 2, "bc"), (-2, -1, "de"), (3, 99, "de"), (-99, 0, "a"), (4, 2, ""), (9, 12, "")])
def test_list_ranges(spark, start, stop, expected):
    v = F.array(*[F.lit(c) for c in "abcde"])
    assert "".join(spark.range(1).select(lists.span(v, start, stop).alias("x")).first().x) == expected


@pytest.mark.parametrize("count, expected", [(0, "bcd"), (1, "bacda"), (-1, "abacd"), (2, "bcda"), (-2, "abcd"), (9, "bcd")])
def test_list_remove(spark, count, expected):
    v = F.array(*[F.lit(c) for c in "abacda"])
    assert "".join(spark.range(1).select(lists.remove(v, count, "a").alias("x")).first().x) == expected


def test_positions_and_moves(spark):
    v = F.array(*[F.lit(c) for c in "abacada"])
    row = spark.range(1).select(
        lists.positions(v, "a", rank=2, count=2).alias("p"), lists.positions(v, "a", rank=-1, count=1).alias("q"), lists.positions(v, "z").alias("r"),
        lists.put(v, -1, "x").alias("s"), lists.put(v, 99, "x").alias("t"), *[c.alias(n) for n, c in zip("uv", lists.move(v, F.array(F.lit("k"))), strict=True)],
        lists.text_range(F.lit("héllo"), 0, 1).alias("cut"), lists.text_range(F.lit("héllo"), 0, 2).alias("whole"), lists.text_overwrite(F.lit("abc"), 5, "xy").alias("padded"),
    ).first()
    assert (row.p, row.q, row.r) == ([2, 4], [6], [])
    assert row.s[-1] == "x" and row.t is None and row.v == ["a", "k"] and len(row.u) == 6
    assert row.cut is None and row.whole == "hé" and row.padded == "abc\0\0xy"


def test_weighted_union_with_infinities(spark):
    a = spark.createDataFrame([("m", float("inf")), ("n", 1.0)], "member string, score double")
    b = spark.createDataFrame([("m", float("-inf")), ("o", 4.0)], "member string, score double")
    out = {r.member: r.score for r in zsets.union([(a, 1), (b, 1)]).collect()}
    assert out == {"m": 0.0, "n": 1.0, "o": 4.0}
    assert {r.member: r.score for r in zsets.union([(a, 0)]).collect()} == {"m": 0.0, "n": 0.0}
    assert zsets.intersection([(a, 1), (a, 1)]).count() == 2


def test_consumer_group_rules():
    g, entries = streams.Group(), [(i, 0) for i in range(5)]
    assert g.read_new(entries, "a", 10, 2) == [(0, 0), (1, 0)]
    assert g.read_new(entries, "b", 20) == [(2, 0), (3, 0), (4, 0)]
    assert g.read_new(entries, "c", 30) == []
    assert g.acknowledge([(0, 0), (0, 0), (9, 9)]) == 1
    assert g.summary() == (4, {"a": 1, "b": 3})
    assert g.read_history("a", 40) == [(1, 0)] and g.pending[1, 0].deliveries == 2
    assert g.claim([(2, 0), (3, 0)], "a", 45, min_idle=30) == []
    assert g.claim([(2, 0), (3, 0)], "a", 60, min_idle=30, there={(3, 0)}) == [(3, 0)] and (2, 0) not in g.pending
    assert g.claim([(0, 0)], "z", 60) == [] and g.claim([(0, 0)], "z", 60, force=True, retries=7) == [(0, 0)] and g.pending[0, 0].deliveries == 7
    assert g.auto_claim("q", 1000, min_idle=1, count=2) == ([(0, 0), (1, 0)], (3, 0))
    assert [e for e, _ in g.waiting(1000, min_idle=500)] == [(3, 0), (4, 0)]


@pytest.mark.parametrize("how", [{}, {"force": True}, {"just_id": True}, {"retries": 7, "idle": 500, "force": True}, {"min_idle": 60}])
def test_claims_as_a_table_agree_with_a_single_group(spark, how):
    group = streams.Group()
    entries = [(i, 0) for i in range(1, 13)]
    group.read_new(entries[:6], "a", 10)
    group.read_new(entries[:9], "b", 50)
    state = [("s", "g", *e, p.consumer, p.since, p.deliveries) for e, p in group.pending.items()]
    state = spark.createDataFrame(state, streams.STATE)
    asked = [(2, 0), (4, 0), (8, 0), (11, 0), (5, 0)]
    left = [e for e in entries if e != (4, 0)]
    table = spark.createDataFrame([("s", "g", *e, "c") for e in asked], "stream string, grp string, ms long, seq long, consumer string")
    got = streams.claimed(state, table, 100, entries=spark.createDataFrame([("s", *e) for e in left], "stream string, ms long, seq long"), **how).collect()
    won = group.claim(asked, "c", 100, there=set(left), **how)
    assert sorted((r.ms, r.seq) for r in got if r.claimed) == sorted(won)
    assert {(r.ms, r.seq): (r.consumer, r.since, r.deliveries) for r in got} == {e: (p.consumer, p.since, p.deliveries) for e, p in group.pending.items()}


def test_sweeps_count_what_is_trimmed(spark):
    """Two pending ids are no longer in the stream: a sweep of two ends after them, the next takes the rest."""
    entries = [(i, 0) for i in range(1, 6)]
    group = streams.Group()
    group.read_new(entries, "dead", 0)
    state = spark.createDataFrame([("s", "g", *e, p.consumer, p.since, p.deliveries) for e, p in group.pending.items()], streams.STATE)
    there = spark.createDataFrame([("s", *e) for e in entries[2:]], "stream string, ms long, seq long")
    first = streams.auto_claimed(state, "c", 300, min_idle=60, count=2, entries=there).first()
    assert not first.claimed and [tuple(x) for x in first.deleted] == entries[:2] and tuple(first.next) == (3, 0)
    claimed, start = group.auto_claim("c", 300, min_idle=60, count=2, there=set(entries[2:]))
    assert claimed == [] and start == (3, 0)
    rest = streams.auto_claimed(state, "c", 300, min_idle=60, start="3-0", count=10, entries=there).first()
    assert [tuple(x) for x in rest.claimed] == entries[2:] and tuple(rest.next) == (0, 0)
    assert group.auto_claim("c", 300, min_idle=60, start=start, count=10, there=set(entries[2:])) == (entries[2:], (0, 0))
