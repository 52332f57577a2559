"""The document dialect on schemaless rows, its parser, and the query builder."""

import pytest
from pyspark.sql import functions as F

from loomwork.plans import builder as B
from loomwork.plans import syntax
from loomwork.plans.documents import Database, DuplicateValue, documents

#: Instruments: a missing, null, whole, fractional and textual value of each kind somewhere.
ROWS = [
    {"id": 1, "name": "viola", "strings": 4, "made": {"town": "Cremona", "year": 1780}, "use": ["chamber", "orchestra"], "care": "keep 40% humid"},
    {"id": 2, "name": "drum", "strings": 0, "made": {"town": "Izmir"}, "use": "parade"},
    {"id": 3, "name": "kora", "strings": 21, "use": ["solo"], "care": None, "tunings": [{"mode": "F", "steps": 7}, {"mode": "E", "steps": 5}]},
    {"id": 4, "name": "sitar", "strings": "18 to 21", "made": {"town": None}, "use": []},
    {"id": 5, "name": "lyre", "strings": 7.5, "care": "keep 40_ humid", "bought": {"$date": "2019-03-02T10:00:00Z"}},
    {"id": 6, "name": "oud", "made": {"town": "Izmir", "year": 1931}, "tunings": [{"mode": "E", "steps": 9}]},
]


@pytest.fixture(scope="module")
def db(spark):
    return Database(spark, kit=documents(spark, ROWS).cache())


def ids(db, where, **parameters):
    rows = db.query(f"SELECT TOINT(id) AS i FROM kit WHERE {where}", parameters).collect()
    return "".join(sorted(str(r.i) for r in rows))


@pytest.mark.parametrize(
    "where, expected",
    [
        ("strings > 0", "1345"),
        ("NOT (strings > 0)", "2"),
        ("strings > 'a'", ""),
        ("strings < 'a'", "12345"),
        ("use = 'solo'", "3"),
        ("use = 'parade'", "2"),
        ("use != 'solo'", "124"),
        ("use IN ('chamber', 'parade')", "12"),
        ("care IS NULL", "2346"),
        ("care IS MISSING", "246"),
        ("care IS NOT MISSING", "135"),
        ("care = NULL", "3"),
        ("care != NULL", "15"),
        ("care NOT IN ('keep 40% humid')", "35"),
        ("NOT (strings > 1 AND care = 'zzz')", "123456"),
        ("tunings[].steps > 6 AND tunings[].mode = 'E'", "36"),
        ("tunings[0].steps = 9", "6"),
        ("tunings[-1].mode = 'E'", "36"),
        ("care LIKE 'keep 40\\%%'", "1"),
        ("care LIKE 'keep 40_ humid'", "15"),
        ("care LIKE 'keep 40\\_%'", "5"),
        ("care NOT LIKE 'keep%'", ""),
        ("care NOT LIKE 'x%'", "15"),
        ("strings NOT LIKE 'x%'", "4"),
        ("NOT (care LIKE 'x%')", "15"),
        ("name LIKE name", "123456"),
        ("care NOT LIKE name", "15"),
        ("care LIKE strings", ""),
        ("strings BETWEEN 4 AND 8", "15"),
        ("strings NOT BETWEEN 4 AND 8", "234"),
        ("bought >= '2030-01-01'", "5"),
        ("bought >= @d", ""),
        ("made.town = @town", "26"),
        ("'Izmir' = made.town", "26"),
        ("made.town = NULL", "4"),
        ("made.town IS MISSING", "35"),
        ("strings = 4.0", "1"),
        ("strings % 2 = 0", "12"),
        ("strings / 0 = 1", ""),
        ("EXISTS(care) AND LENGTH(care) = 14", "15"),
        ("-strings < -20", "3"),
        ("use", "123"),
        ("CONTAINS(use, 'solo') OR CONTAINS(care, '%')", "13"),
        ("[1, 2] = [1, 2] AND use = ['solo']", "3"),
    ],
)
def test_where(db, where, expected):
    assert ids(db, where, d={"$date": "2020-02-01T00:00:00Z"}, Town="Izmir") == expected


def test_groups_keep_missing_apart_and_sum_nothing_to_zero(db):
    rows = db.query("SELECT made.town AS town, COUNT(*) AS n, SUM(strings) AS s, AVG(strings) AS a FROM kit GROUP BY made.town ORDER BY n DESC, town").collect()
    assert [(r.n, r.s, r.a) for r in rows] == [(2, 28.5, 14.25), (2, 0.0, 0.0), (1, 0.0, 0.0), (1, 4.0, 4.0)]
    empty = db.query("SELECT COUNT(*) AS n, SUM(x) AS s, MIN(x) AS m FROM kit WHERE name = 'none'").first()
    assert (empty.n, empty.s, empty.m) == (0, 0.0, None)


def test_groups_of_large_whole_numbers_stay_apart(spark):
    rows = [{"n": 2**53}, {"n": 2**53 + 1}, {"n": 2**53 + 1}, {"n": 5}, {"n": 5.0}, {"n": -0.25}]
    found = Database(spark, t=documents(spark, rows)).query("SELECT TOSTRING(n) AS v, COUNT(*) AS c FROM t GROUP BY n").collect()
    assert sorted((r.v, r.c) for r in found) == [("-0.25", 1), ("5", 2), ("9007199254740992", 1), ("9007199254740993", 2)]


def test_order_is_by_rank_and_value(db):
    rows = db.query("SELECT TOINT(id) AS i FROM kit ORDER BY strings DESC").collect()
    assert [r.i for r in rows] == [4, 3, 5, 1, 2, 6]
    rows = db.query("SELECT TOINT(id) AS i FROM kit ORDER BY care, id").collect()
    assert [r.i for r in rows] == [2, 4, 6, 3, 1, 5]


def test_objects_drop_missing_fields(db):
    row = db.query("SELECT {a: name, b: nothing} AS o FROM kit WHERE id = 6").select(F.to_json("o").alias("o")).first()
    assert row.o == '{"a":"oud"}'


def test_changes(spark):
    db = Database(spark, kit=documents(spark, ROWS))
    assert db.execute("UPDATE kit SET name = 'x', made.shelf = 5, copy = name WHERE id = 1") == 1
    row = db.query("SELECT TOSTRING(name) AS s, TOSTRING(copy) AS c, TOINT(made.shelf) AS z, TOSTRING(made.town) AS t FROM kit WHERE id = 1").first()
    assert tuple(row) == ("x", "x", 5, "Cremona")
    assert db.execute("DELETE FROM kit WHERE made.town = 'Izmir'") == 2
    assert db.execute("INSERT INTO kit VALUES {name: 'gong', strings: 5}, {name: 'bell'}") == 2
    assert db.count_where("kit") == 6 and db.count_where("kit", "strings = 5") == 1
    assert db.execute("INSERT INTO fresh VALUES {a: 1}") == 1 and db.count_where("fresh", "a = 1") == 1
    assert db.stats("fresh")["documents"] == 1
    db.clear("fresh")
    assert db.count_where("fresh") == 0
    assert db.drop("fresh") and not db.drop("fresh")


def test_new_documents_get_an_id_that_stays(spark):
    db = Database(spark, t=documents(spark, [{"_id": "own", "a": 0}]))
    db.execute("INSERT INTO t VALUES {a: 1}, {a: 2}, {_id: 'mine', a: 3}")
    held = [[r.i for r in db.query("SELECT TOSTRING(_id) AS i FROM t ORDER BY a").collect()] for _ in range(2)]
    assert held[0] == held[1] and len(set(held[0])) == 4 and held[0][0] == "own" and held[0][3] == "mine" and len(held[0][1]) == 32
    assert db.delete_by_id("t", "mine") and not db.delete_by_id("t", "mine") and db.count_where("t") == 3


def test_unique_paths_reject_changes(spark):
    db = Database(spark, t=documents(spark, [{"a": 1, "tags": ["x", "y"]}, {"a": 2}, {"b": 0}, {"b": 1}]))
    db.create_unique("t", "a")
    for text in ("INSERT INTO t VALUES {a: 2}", "INSERT INTO t VALUES {a: 7}, {a: 7}", "UPDATE t SET a = 1"):
        with pytest.raises(DuplicateValue):
            db.execute(text)
        assert db.count_where("t") == 4 and db.count_where("t", "a = 1") == 1
    assert db.execute("INSERT INTO t VALUES {a: 3}, {b: 5}") == 2
    with pytest.raises(DuplicateValue):
        db.insert_many("t", documents(spark, [{"a": 3}]))
    with pytest.raises(DuplicateValue):
        Database(spark, t=documents(spark, [{"a": 1}, {"a": 1}])).create_unique("t", "a")


@pytest.mark.parametrize(
    "text",
    ["", "SELECT", "SELECT a FROM", "SELECT a FROM t WHERE", "SELECT a FROM t LIMIT x", "SELECT nofunc(a) FROM t", "SELECT a FROM t GROUP a", "SELECT SUM(*) FROM t",
     "SELECT a b c FROM t", "SELECT a FROM t WHERE a NOT 5", "DELETE t", "UPDATE t SET a", "INSERT INTO t VALUES 5", "SELECT a FROM t WHERE a ~ 1"],
)
def test_rejected(text):
    with pytest.raises(syntax.SyntaxProblem) as problem:
        syntax.parse(text)
    assert "^" in str(problem.value)


@pytest.mark.parametrize(
    "text",
    ["SELECT * FROM t;", "select a.b[0].c[] x from t -- note", "SELECT 'it''s', \"a\\n\" FROM t /* c */", "SELECT a FROM t WHERE a = @p AND NOT b IN [1, 2]",
     "SELECT COUNT(*) FROM t OFFSET 3", "SELECT a + 1.5e3 * -b % 2 FROM t ORDER BY a DESC, b"],
)
def test_accepted(text):
    assert syntax.parse(text)


def test_aggregates_are_rejected_in_where(db):
    with pytest.raises(ValueError, match="WHERE"):
        db.query("SELECT name FROM kit WHERE COUNT(*) > 1")
    with pytest.raises(KeyError):
        db.query("SELECT name FROM kit WHERE name = @unbound")


def test_builder(db):
    q = B.Query(db["kit"], "kit")
    assert q.where(B.startswith("care", "keep 40%")).count() == 1
    assert q.where(B.in_("name", [])).count() == 0
    assert q.where(B.eq("made.town", "Izmir")).select("name").order_by("name").take(5).take(1).skip(1).to_sql().endswith("LIMIT 1 OFFSET 1")
    assert q.all(B.ne("name", "gong")) and not q.all(B.eq("name", "oud")) and q.any(B.is_missing("strings"))
    assert q.sum("strings") == pytest.approx(32.5)
    found = q.select_many("tunings", "tuning", "name").select(F.try_variant_get("tuning", "$.mode", "string").alias("m")).orderBy("m").collect()
    assert [r.m for r in found] == ["E", "E", "F"]


@pytest.mark.parametrize("path", ["", "a b", "a = 1 OR b", "a.b; DROP", "a{0}", "1a", "a..b", "a[x]", "a)", "a--", None])
def test_builder_rejects_what_is_no_path(db, path):
    q = B.Query(db["kit"], "kit")
    for make in (lambda: B.eq(path, 1), lambda: B.in_(path, []), lambda: B.is_null(path), lambda: q.order_by(path), lambda: q.group_by(path), lambda: q.select(path), lambda: q.sum(path), lambda: B.Query(db["kit"], path)):
        if path == "a b" and "select" in make.__code__.co_names:
            continue  # an output with a name
        with pytest.raises(ValueError):
            make()


def test_builder_accepts_paths(db):
    q = B.Query(db["kit"], "kit")
    assert q.where(B.eq("tunings[0].mode", "F")).select("name AS n", "LENGTH(name)", "made.town").df().columns[0] == "n"
    assert q.where(B.gt("tunings[].steps", 6)).count() == 2 and q.group_by("made.town").select("made.town", "COUNT(*) AS n").count() == 4


def test_builder_accepts_functions_of_functions(db):
    outputs = ("made.town AS town", "ROUND(SUM(strings) / 3, 2) AS third", "ROUND(-AVG(id), 1)", "CONCAT(TOSTRING(MAX(id)), ', -- x') AS last")
    q = B.Query(db["kit"], "kit").where(B.eq("made.town", "Izmir")).group_by("made.town").select(*outputs)
    assert q.df().columns == ["town", "third", "ROUND(-AVG(id), 1)", "last"]
    assert [tuple(r)[1:] for r in q.df().collect()] == [(0.0, -4.0, "6, -- x")]


@pytest.mark.parametrize(
    "output", ["ROUND(SUM(id), 2) AS a, name", "ROUND(id) FROM kit", "ROUND(id) --", "ROUND(id) AS a --", "ROUND(id) /*", "ROUND(id", "ROUND(id))", "ROUND(id) > 1 OR ROUND(id)", "ROUND(@p1)", "NONE(id)", "ROUND(id) AS a b"]
)
def test_builder_rejects_what_reaches_out_of_a_function(db, output):
    with pytest.raises(ValueError, match="not an output"):
        B.Query(db["kit"], "kit").select(output)


def test_builder_takes_functions_in_conditions_keys_and_orders(db):
    q = B.Query(db["kit"], "kit")
    lengths = q.group_by("LENGTH(name)").select("LENGTH(name) AS size", "COUNT(*) AS n")
    assert [tuple(r) for r in lengths.where(B.gt("COUNT(*)", 1)).order_by("COUNT(*)", True).df().collect()] == [(4, 3), (5, 2)]
    assert [tuple(r) for r in lengths.where(B.between("SUM(id)", 5, 6), B.in_("MAX(id)", [4, 6])).order_by("MAX(id)").df().collect()] == [(5, 2), (3, 1)]
    assert [r.n for r in lengths.where(B.is_null("MAX(made.year)")).df().collect()] == [3]
    assert q.where(B.eq("LENGTH(name)", 4)).order_by("SUBSTR(name, 1, 1)", True).select("TOINT(id) AS i").df().collect() == [(5,), (2,), (3,)]


@pytest.mark.parametrize("path", ["COUNT(*) > 0 OR COUNT(*)", "COUNT(*) --", "COUNT(*) AS n", "COUNT(*) n", "COUNT(*), id", "COUNT(*) + 1", "COUNT(@p1)", "COUNT(*", "COUNT(*))", "NONE(id)", "*", "1"])
def test_builder_rejects_more_than_one_function(db, path):
    q = B.Query(db["kit"], "kit").group_by("name")
    for make in (lambda: B.gt(path, 1), lambda: B.in_(path, []), lambda: B.is_null(path), lambda: B.is_missing(path), lambda: q.order_by(path), lambda: q.group_by(path)):
        with pytest.raises(ValueError, match="not a path"):
            make()


def test_builder_terminals_take_functions(db):
    q = B.Query(db["kit"], "kit").where(B.lt("id", 6))
    row = q.select("COUNT(*) AS n", "ROUND(SUM(LENGTH(name)), 2) AS total", "ROUND(AVG(LENGTH(name)), 4) AS mean", "MIN(LENGTH(name)) AS low", "MAX(LENGTH(name)) AS high").df().first()
    assert tuple(row) == (5, 22, 4.4, 4, 5)
    assert (q.sum("LENGTH(name)"), q.average("LENGTH(name)"), q.min("LENGTH(name)"), q.max("LENGTH(name)")) == (22, 4.4, 4, 5)
    for path in ("LENGTH(name) AS n", "LENGTH(name)) AS x, MAX(id", "LENGTH(name) --"):
        with pytest.raises(ValueError, match="not a path"):
            q.sum(path)


def test_typed_plan_pushes_filters_down(spark, tmp_path):
    spark.range(100).selectExpr("id AS a", "id * 2 AS b", "cast(id AS string) AS c").write.parquet(str(tmp_path / "t"))
    df = Database(spark, t=spark.read.parquet(str(tmp_path / "t"))).query("SELECT a FROM t WHERE a > 90 AND a IN (91, 95)")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(a,90)" in plan and "In(a, [91,95])" in plan and "ReadSchema: struct<a:bigint>" in plan
    assert df.count() == 2


def test_missing_null_and_values_are_all_ordered(spark, duck):
    from helpers import DATA

    from loomwork.queries import catalog

    want = [r[0] for r in duck.execute(catalog.SQL["d_schemaless_order"]).fetchall()]
    assert len(want) == spark.read.parquet(f"{DATA}/events.parquet").count()
    assert [r.event_id for r in catalog.QUERIES["d_schemaless_order"](spark, str(DATA)).collect()] == want


def test_means_do_not_depend_on_the_order_of_rows(spark):
    orders = {1: [0.1, 0.05, 0.01, 0.04], 2: [0.04, 0.01, 0.05, 0.1], 3: [0.05, 0.07, 0.02, 0.09, 0.07, 0.03, 0.02], 4: [0.05, 0.051], 5: [1e300, 1e300], 6: [0.1, None]}
    rows = spark.createDataFrame([(g, x) for g, xs in orders.items() for x in xs], "g long, x double").coalesce(1)
    found = Database(spark, t=rows).query("SELECT g, AVG(x) AS mean FROM t GROUP BY g")
    assert {r.g: r.mean for r in found.collect()} == {1: 0.05, 2: 0.05, 3: 0.05, 4: 0.0505, 5: 1e300, 6: 0.1}
    assert [r.g for r in Database(spark, t=rows).query("SELECT g FROM t GROUP BY g HAVING AVG(x) > 0.05 ORDER BY g").collect()] == [4, 5, 6]
