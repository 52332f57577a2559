"""Document dialect queries over the driver's tables, with equivalent SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.functions import scalars
from loomwork.functions import values as V
from loomwork.plans import builder as B
from loomwork.plans import documents as D
from loomwork.session import read_table, scratch_path
from loomwork.sources import files

QUERIES: dict = {}
SQL: dict = {}


def _sql(name: str, table: str, text: str, oracle: str, finish=lambda df: df, **parameters) -> None:
    """Register a dialect statement over one table."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = read_table(spark, sf_dir, table)
        return finish(D.Database(spark, **{table: df}).query(text, parameters))

    QUERIES[name], SQL[name] = query, oracle


def _query(name: str, oracle: str | None = None):
    def register(f):
        QUERIES[name] = f
        if oracle:
            SQL[name] = oracle
        return f

    return register


def events_as_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as schemaless documents: props is nested, and k is an explicit null where it is a multiple of 7, absent where of 5."""
    e = read_table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    props = (
        F.when(k % 5 == 0, F.lit("{}")).when(k % 7 == 0, F.lit('{"k":null}')).otherwise(F.to_json(F.struct(k.alias("k"))))
    )
    text = F.concat(F.lit('{"event_id":'), F.col("event_id"), F.lit(',"type":"'), F.col("event_type"), F.lit('","props":'), props, F.lit("}"))
    return D.from_json_lines(e.select(text.alias("value")))


_EVENT_DOCS = """WITH e AS (SELECT event_id, event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events),
docs AS (SELECT *, k % 5 = 0 AS absent, k % 5 <> 0 AND k % 7 = 0 AS nul FROM e) """


def nested_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders with their lineitems as an array of structs, by one shuffle on the order key."""
    line = F.struct(*[F.col(c).alias(c[2:]) for c in ("l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag")])
    lines = read_table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(line)).alias("lines"))
    orders = read_table(spark, sf_dir, "orders")
    return orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").drop("l_orderkey")


_sql(
    "d_group_having", "orders",
    "SELECT o_orderstatus AS status, COUNT(*) AS n, ROUND(SUM(o_totalprice), 2) AS revenue FROM orders WHERE o_totalprice > 100000 "
    "GROUP BY o_orderstatus HAVING COUNT(*) > 10 ORDER BY revenue DESC LIMIT 5",
    "SELECT o_orderstatus AS status, count(*) AS n, round(sum(o_totalprice), 2) AS revenue FROM orders WHERE o_totalprice > 100000 "
    "GROUP BY 1 HAVING count(*) > 10 ORDER BY revenue DESC LIMIT 5",
)
_sql(
    "d_scan_project", "customer", "SELECT c_custkey, c_name AS name, c_acctbal FROM customer",
    "SELECT c_custkey, c_name AS name, c_acctbal FROM customer",
)
_sql("d_select_star", "nation", "SELECT * FROM nation WHERE n_regionkey != 2", "SELECT * FROM nation WHERE n_regionkey <> 2")
_sql(
    "d_and_or_not", "part", "SELECT p_partkey FROM part WHERE NOT (p_size > 20 AND p_retailprice > 1000) OR p_brand = 'Brand#11'",
    "SELECT p_partkey FROM part WHERE NOT (p_size > 20 AND p_retailprice > 1000) OR p_brand = 'Brand#11'",
)
_sql(
    "d_in_between_like", "part",
    "SELECT p_partkey, p_size FROM part WHERE p_size IN (1, 5, 9, 14) AND p_retailprice BETWEEN @low AND @high AND p_name NOT LIKE '%9_'",
    "SELECT p_partkey, p_size FROM part WHERE p_size IN (1, 5, 9, 14) AND p_retailprice BETWEEN 900 AND 1500 AND p_name NOT LIKE '%9_'",
    low=900, high=1500,
)
_sql("d_not_in", "customer", "SELECT c_custkey FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY')", "SELECT c_custkey FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY')")
_sql("d_point_lookup", "orders", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey = 7", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey = 7")
_sql(
    "d_distinct_order_page", "customer", "SELECT DISTINCT c_nationkey, c_mktsegment FROM customer ORDER BY c_nationkey DESC, c_mktsegment LIMIT 20 OFFSET 10",
    "SELECT DISTINCT c_nationkey, c_mktsegment FROM customer ORDER BY c_nationkey DESC, c_mktsegment LIMIT 20 OFFSET 10",
)
_sql(
    "d_order_unprojected", "orders", "SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50",
    "SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50",
)
_sql(
    "d_global_aggregate_empty", "orders", "SELECT COUNT(*) AS n, SUM(o_totalprice) AS s, AVG(o_totalprice) AS a, MIN(o_orderkey) AS lo FROM orders WHERE o_totalprice < 0",
    "SELECT count(*) AS n, coalesce(sum(o_totalprice), 0) AS s, avg(o_totalprice) AS a, min(o_orderkey) AS lo FROM orders WHERE o_totalprice < 0",
)
_sql(
    "d_expression_over_aggregates", "lineitem",
    "SELECT l_returnflag AS flag, ROUND(SUM(l_extendedprice) / COUNT(*), 4) AS mean_price, MAX(l_quantity) - MIN(l_quantity) AS spread FROM lineitem GROUP BY l_returnflag",
    "SELECT l_returnflag AS flag, round(sum(l_extendedprice) / count(*), 4) AS mean_price, max(l_quantity) - min(l_quantity) AS spread FROM lineitem GROUP BY 1",
)
_sql(
    "d_having_unprojected", "lineitem", "SELECT l_suppkey AS supp FROM lineitem GROUP BY l_suppkey HAVING AVG(l_discount) > 0.05 AND COUNT(*) > 5",
    "SELECT l_suppkey AS supp FROM lineitem GROUP BY 1 HAVING avg(l_discount) > 0.05 AND count(*) > 5",
)
_sql(
    "d_group_by_expression", "orders", "SELECT YEAR(o_orderdate) AS y, QUARTERS AS missing_key, COUNT(*) AS n FROM orders GROUP BY YEAR(o_orderdate)",
    "SELECT year(o_orderdate)::INTEGER AS y, NULL::VARCHAR AS missing_key, count(*) AS n FROM orders GROUP BY 1",
)
_sql("d_group_star", "supplier", "SELECT * FROM supplier GROUP BY s_nationkey", "SELECT s_nationkey FROM supplier GROUP BY s_nationkey")
_sql(
    "d_text_functions", "customer",
    "SELECT c_custkey, LENGTH(c_name) AS len, UPPER(c_name) AS up, LOWER(c_mktsegment) AS lo, TRIM(CONCAT('  ', c_mktsegment, ' ')) AS tr, "
    "SUBSTR(c_name, 0, 4) AS s1, SUBSTR(c_name, -3) AS s2, SUBSTR(c_name, 2, 3) AS s3, REPLACE(c_name, 'Customer', 'C') AS rep, "
    "STARTSWITH(c_name, 'Cust') AS sw, ENDSWITH(c_name, '1') AS ew, CONTAINS(c_name, '00') AS ct FROM customer",
    "SELECT c_custkey, length(c_name)::INTEGER AS len, upper(c_name) AS up, lower(c_mktsegment) AS lo, c_mktsegment AS tr, c_name[1:4] AS s1, right(c_name, 3) AS s2, "
    "c_name[3:5] AS s3, replace(c_name, 'Customer', 'C') AS rep, starts_with(c_name, 'Cust') AS sw, ends_with(c_name, '1') AS ew, contains(c_name, '00') AS ct FROM customer",
)
_sql(
    "d_split_element", "customer", "SELECT c_custkey, ELEMENT(SPLIT(c_name, '#'), 0) AS a, ELEMENT(SPLIT(c_name, '#'), -1) AS z, ARRAY_LENGTH(SPLIT(c_name, '#')) AS n FROM customer",
    "SELECT c_custkey, string_split(c_name, '#')[1] AS a, string_split(c_name, '#')[-1] AS z, len(string_split(c_name, '#'))::INTEGER AS n FROM customer",
)
_sql(
    "d_math_functions", "supplier",
    "SELECT s_suppkey, ABS(s_acctbal) AS a, FLOOR(s_acctbal) AS f, CEIL(s_acctbal) AS c, ROUND(SQRT(ABS(s_acctbal)), 6) AS r, ROUND(POW(s_nationkey, 2), 3) AS p FROM supplier",
    "SELECT s_suppkey, abs(s_acctbal) AS a, floor(s_acctbal) AS f, ceil(s_acctbal) AS c, round(sqrt(abs(s_acctbal)), 6) AS r, round(pow(s_nationkey, 2), 3) AS p FROM supplier",
)
_sql(
    "d_arithmetic", "lineitem",
    "SELECT l_orderkey, l_linenumber, l_linenumber / 2 AS half, l_linenumber % 3 AS m, l_linenumber / (l_linenumber - 1) AS d0, l_linenumber % (l_linenumber - 2) AS m0, "
    "ROUND(l_extendedprice * (1 - l_discount), 4) AS net, -l_linenumber AS neg, 'n' + l_linenumber AS txt FROM lineitem",
    "SELECT l_orderkey, l_linenumber, l_linenumber / 2 AS half, (l_linenumber % 3)::BIGINT AS m, l_linenumber / nullif(l_linenumber - 1, 0) AS d0, (l_linenumber % nullif(l_linenumber - 2, 0))::BIGINT AS m0, "
    "round(l_extendedprice * (1 - l_discount), 4) AS net, -l_linenumber AS neg, 'n' || l_linenumber AS txt FROM lineitem",
)
_sql(
    "d_date_parts", "orders",
    "SELECT o_orderkey, DATE_PART('YEAR', o_orderdate) AS y, DATE_PART('QUARTER', o_orderdate) AS q, MONTH(o_orderdate) AS mo, DATE_PART('WEEK', o_orderdate) AS w, DAY(o_orderdate) AS d, "
    "DATE_PART('DAYOFWEEK', o_orderdate) AS dow, DATE_PART('DAYOFYEAR', o_orderdate) AS doy, HOUR(o_orderdate) AS h, DATE_PART('CENTURY', o_orderdate) AS none FROM orders",
    "SELECT o_orderkey, year(o_orderdate)::INTEGER AS y, quarter(o_orderdate)::INTEGER AS q, month(o_orderdate)::INTEGER AS mo, week(o_orderdate)::INTEGER AS w, day(o_orderdate)::INTEGER AS d, "
    "dayofweek(o_orderdate)::INTEGER AS dow, dayofyear(o_orderdate)::INTEGER AS doy, hour(o_orderdate)::INTEGER AS h, NULL::VARCHAR AS none FROM orders",
)
_sql(
    "d_date_trunc", "orders",
    "SELECT o_orderkey, DATE_TRUNC('WEEK', o_orderdate) AS w, DATE_TRUNC('MONTH', o_orderdate) AS m, DATE_TRUNC('QUARTER', o_orderdate) AS q FROM orders",
    "SELECT o_orderkey, (o_orderdate::DATE - dayofweek(o_orderdate)::INTEGER)::TIMESTAMP AS w, date_trunc('month', o_orderdate)::TIMESTAMP AS m, date_trunc('quarter', o_orderdate)::TIMESTAMP AS q FROM orders",
    lambda df: df.select("o_orderkey", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("w", "m", "q")]),
)
_sql(
    "d_coalesce_typeof", "part",
    "SELECT p_partkey, COALESCE(nothing, p_name) AS c, IFNULL(NULL, p_size) AS i, TYPEOF(p_size) AS t1, TYPEOF(p_name) AS t2, TYPEOF(nothing) AS t3, TYPEOF(NULL) AS t4, "
    "TOSTRING(p_size) AS s, TONUMBER('12.5') AS n, TOINT('12.9') AS ti, TONUMBER('abc') AS bad FROM part",
    "SELECT p_partkey, p_name AS c, p_size AS i, 'int' AS t1, 'string' AS t2, 'missing' AS t3, 'null' AS t4, p_size::VARCHAR AS s, 12.5::DOUBLE AS n, 12::BIGINT AS ti, NULL::DOUBLE AS bad FROM part",
)
_sql("d_is_null_missing", "part", "SELECT p_partkey FROM part WHERE nothing IS MISSING AND nothing IS NULL AND p_name IS NOT NULL AND NOT (p_size IS MISSING)", "SELECT p_partkey FROM part")
_sql("d_null_equality", "part", "SELECT COUNT(*) AS n FROM part WHERE NULL = NULL AND NOT (nothing = 1) = FALSE OR nothing != 1", "SELECT 0::BIGINT AS n")
_sql("d_cross_type_order", "part", "SELECT COUNT(*) AS n FROM part WHERE p_name > 5 AND NOT (p_size > 'a')", "SELECT count(*) AS n FROM part")
_sql("d_aliases_params", "orders", "SELECT o_orderkey k, o_orderstatus = @s AS open_ FROM orders WHERE o_custkey IN @ids", "SELECT o_orderkey AS k, o_orderstatus = 'O' AS open_ FROM orders WHERE o_custkey IN (1, 2, 3, 4, 5)", s="O", ids=[1, 2, 3, 4, 5])


@_query(
    "d_missing_vs_null",
    _EVENT_DOCS + "SELECT event_id, absent AS missing_, absent OR nul AS null_, NOT absent AS present, CASE WHEN absent THEN 'missing' WHEN nul THEN 'null' ELSE 'int' END AS kind FROM docs",
)
def d_missing_vs_null(spark, sf_dir):
    db = D.Database(spark, events=events_as_documents(spark, sf_dir))
    out = db.query("SELECT TOINT(event_id) AS event_id, props.k IS MISSING AS missing_, props.k IS NULL AS null_, EXISTS(props.k) AS present, TYPEOF(props.k) AS kind FROM events")
    return out


@_query(
    "d_not_and_truth",
    _EVENT_DOCS + "SELECT event_id FROM docs WHERE NOT (coalesce(k > 50 AND NOT absent AND NOT nul, false) AND coalesce(event_type = 'click', false))",
)
def d_not_and_truth(spark, sf_dir):
    db = D.Database(spark, events=events_as_documents(spark, sf_dir))
    return db.query("SELECT TOINT(event_id) AS event_id FROM events WHERE NOT (props.k > 50 AND type = 'click')")


@_query(
    "d_schemaless_group",
    _EVENT_DOCS + "SELECT event_type AS type, count(*) AS n, count(CASE WHEN NOT absent AND NOT nul THEN 1 END) AS known, "
    "coalesce(sum(CASE WHEN NOT absent AND NOT nul THEN k END), 0)::DOUBLE AS total, max(CASE WHEN NOT absent AND NOT nul THEN k END)::DOUBLE AS top FROM docs GROUP BY 1",
)
def d_schemaless_group(spark, sf_dir):
    db = D.Database(spark, events=events_as_documents(spark, sf_dir))
    out = db.query("SELECT type, COUNT(*) AS n, COUNT(props.k) AS known, SUM(props.k) AS total, MAX(props.k) AS top FROM events GROUP BY type")
    return out.withColumn("type", F.try_variant_get("type", "$", "string")).withColumn("top", F.try_variant_get("top", "$", "double"))


@_query(
    "d_schemaless_order",
    _EVENT_DOCS + "SELECT event_id FROM docs ORDER BY CASE WHEN absent THEN 0 WHEN nul THEN 1 ELSE 2 END, CASE WHEN absent OR nul THEN 0 ELSE k END, event_id",
)
def d_schemaless_order(spark, sf_dir):
    """The whole table: missing, then null, then numbers."""
    db = D.Database(spark, events=events_as_documents(spark, sf_dir))
    return db.query("SELECT TOINT(event_id) AS event_id FROM events ORDER BY props.k, event_id")


@_query(
    "d_schemaless_null_comparisons",
    _EVENT_DOCS + "SELECT event_id, nul AS is_null, CASE WHEN absent THEN NULL ELSE nul END AS eq_null, CASE WHEN absent THEN NULL WHEN nul THEN NULL ELSE k < 10 END AS lt, "
    "CASE WHEN absent THEN NULL WHEN nul THEN true ELSE k NOT IN (1, 2, 3) END AS not_in FROM docs",
)
def d_schemaless_null_comparisons(spark, sf_dir):
    db = D.Database(spark, events=events_as_documents(spark, sf_dir))
    return db.query(
        "SELECT TOINT(event_id) AS event_id, props.k IS NULL AND NOT (props.k IS MISSING) AS is_null, props.k = NULL AS eq_null, props.k < 10 AS lt, props.k NOT IN (1, 2, 3) AS not_in FROM events"
    )


@_query(
    "d_nest_explode",
    "SELECT o_orderstatus AS status, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1",
)
def d_nest_explode(spark, sf_dir):
    flat = B.Query(nested_orders(spark, sf_dir)).select_many("lines", "line", "o_orderstatus")
    return B.Query(flat).group_by("o_orderstatus").select("o_orderstatus AS status", "COUNT(*) AS n", "ROUND(SUM(line.quantity), 2) AS quantity").df()


_HAS_LINES = "WITH l AS (SELECT l_orderkey, list(l_returnflag) AS flags, list(l_quantity) AS q FROM lineitem GROUP BY 1) "


@_query("d_array_any", _HAS_LINES + "SELECT o_orderkey FROM orders JOIN l ON o_orderkey = l_orderkey WHERE list_contains(flags, 'R')")
def d_array_any(spark, sf_dir):
    return B.Query(nested_orders(spark, sf_dir)).where(B.eq("lines[].returnflag", "R")).select("o_orderkey").df()


@_query("d_array_none", _HAS_LINES + "SELECT o_orderkey FROM orders JOIN l ON o_orderkey = l_orderkey WHERE NOT list_contains(flags, 'R')")
def d_array_none(spark, sf_dir):
    return B.Query(nested_orders(spark, sf_dir)).where(B.ne("lines[].returnflag", "R")).select("o_orderkey").df()


@_query(
    "d_array_independent",
    "SELECT DISTINCT a.l_orderkey AS o_orderkey FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey JOIN orders ON a.l_orderkey = o_orderkey WHERE a.l_returnflag = 'R' AND b.l_quantity > 45",
)
def d_array_independent(spark, sf_dir):
    return B.Query(nested_orders(spark, sf_dir)).where(B.eq("lines[].returnflag", "R"), B.gt("lines[].quantity", 45)).select("o_orderkey").df()


@_query(
    "d_array_same_element",
    "SELECT DISTINCT l_orderkey AS o_orderkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R' AND l_quantity > 45",
)
def d_array_same_element(spark, sf_dir):
    def test(line):
        return V.compare("=", V.step(line, "returnflag"), V.literal("R")) & V.compare(">", V.step(line, "quantity"), V.literal(45))

    return B.Query(nested_orders(spark, sf_dir)).any_element("lines", test).select("o_orderkey")


@_query(
    "d_array_index",
    "SELECT l_orderkey AS k, arg_min(l_quantity, row(l_linenumber, l_partkey, l_quantity)) AS first_q, arg_max(l_quantity, row(l_linenumber, l_partkey, l_quantity)) AS last_q, count(*)::INTEGER AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1",
)
def d_array_index(spark, sf_dir):
    q = B.Query(nested_orders(spark, sf_dir)).where(B.not_(B.is_null("lines")))
    return q.select("o_orderkey AS k", "lines[0].quantity AS first_q", "lines[-1].quantity AS last_q", "ARRAY_LENGTH(lines) AS n").df()


@_query(
    "d_update",
    "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'DEBT' ELSE c_mktsegment END AS c_mktsegment, round(CASE WHEN c_acctbal < 0 THEN 0 - c_acctbal ELSE c_acctbal END, 4) AS c_acctbal, "
    "CASE WHEN c_acctbal < 0 THEN 'DEBT!' END AS note FROM customer",
)
def d_update(spark, sf_dir):
    db = D.Database(spark, customer=read_table(spark, sf_dir, "customer"))
    db.execute("UPDATE customer SET c_mktsegment = 'DEBT', c_acctbal = 0 - c_acctbal, note = c_mktsegment + '!' WHERE c_acctbal < 0")
    return db.query("SELECT c_custkey, c_mktsegment, ROUND(c_acctbal, 4) AS c_acctbal, note FROM customer")


@_query("d_delete", "SELECT p_partkey FROM part WHERE NOT (p_size < 10 OR p_brand LIKE '%5')")
def d_delete(spark, sf_dir):
    db = D.Database(spark, part=read_table(spark, sf_dir, "part"))
    db.execute("DELETE FROM part WHERE p_size < 10 OR p_brand LIKE '%5'")
    return db.query("SELECT p_partkey FROM part")


@_query("d_insert", "SELECT r_regionkey, r_name FROM region UNION ALL SELECT 90, 'NORTH' UNION ALL SELECT 91, 'SOUTH'")
def d_insert(spark, sf_dir):
    db = D.Database(spark, region=read_table(spark, sf_dir, "region"))
    db.execute("INSERT INTO region VALUES {r_regionkey: 90, r_name: 'NORTH'}, {r_regionkey: 91, r_name: 'SOUTH'}")
    return db["region"]


@_query("d_upsert", "SELECT s_suppkey, CASE WHEN s_acctbal > 5000 THEN 'RICH' ELSE s_name END AS s_name FROM supplier")
def d_upsert(spark, sf_dir):
    supplier = read_table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    db = D.Database(spark, supplier=supplier)
    db.save_many("supplier", supplier.filter("s_acctbal > 5000").withColumn("s_name", F.lit("RICH")), "s_suppkey")
    return db["supplier"].select("s_suppkey", "s_name")


@_query("d_unique_check", "SELECT c_nationkey::VARCHAR AS value, count(*) AS documents FROM customer GROUP BY 1 HAVING count(*) > 1")
def d_unique_check(spark, sf_dir):
    out = D.Database(spark, customer=read_table(spark, sf_dir, "customer")).unique_violations("customer", "c_nationkey")
    return out.select(F.col("value").cast("string").alias("value"), "documents")


@_query(
    "d_log_replay",
    "SELECT user_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY 1 HAVING arg_max(event_type, event_id) <> 'click'",
)
def d_log_replay(spark, sf_dir):
    log = read_table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", (F.col("event_type") == "click").alias("gone"))
    return files.replayed(log, "user_id", "event_id", "gone")


@_query(
    "d_builder",
    "SELECT o_custkey AS cust, count(*) AS n FROM orders WHERE o_orderstatus IN ('O', 'F') AND NOT (o_orderpriority LIKE '1%') AND o_totalprice BETWEEN 1000 AND 200000 "
    "GROUP BY 1 HAVING count(*) > 5 ORDER BY n DESC, cust LIMIT 40 OFFSET 5",
)
def d_builder(spark, sf_dir):
    q = B.Query(read_table(spark, sf_dir, "orders"), "orders")
    q = q.where(B.in_("o_orderstatus", ["O", "F"]), ~B.startswith("o_orderpriority", "1"), B.between("o_totalprice", 1000, 200000)).group_by("o_custkey")
    return q.select("o_custkey AS cust", "COUNT(*) AS n").where(B.gt("COUNT(*)", 5)).order_by("n", True).order_by("cust").take(100).take(40).skip(2).skip(3).df()


@_query(
    "d_csv_inference",
    "SELECT c_custkey, 'int' AS key_kind, 'double' AS balance_kind, 'string' AS code_kind, 'bool' AS flag_kind, 'datetime' AS day_kind, 'null' AS empty_kind, 'array' AS json_kind FROM customer",
)
def d_csv_inference(spark, sf_dir):
    c = read_table(spark, sf_dir, "customer")
    texts = {
        "key_kind": F.col("c_custkey").cast("string"), "balance_kind": F.concat(F.col("c_custkey").cast("string"), F.lit(".25")), "code_kind": F.concat(F.lit("0"), F.col("c_custkey")),
        "flag_kind": F.lit("True"), "day_kind": F.lit("2024-02-03"), "empty_kind": F.lit(""), "json_kind": F.lit("[1, 2]"),
    }
    rows = c.select("c_custkey", *[files.inferred(t).alias(k) for k, t in texts.items()])
    return rows.select("c_custkey", *[scalars.type_name(V.of_type(F.col(k), rows.schema[k].dataType)).col.alias(k) for k in texts])


@_query("d_json_round_trip", "SELECT n_nationkey::BIGINT AS n_nationkey, n_name, n_regionkey::BIGINT AS n_regionkey FROM nation")
def d_json_round_trip(spark, sf_dir):
    docs = D.from_json_lines(files.json_texts(read_table(spark, sf_dir, "nation")))
    out = D.Database(spark, nation=docs).query("SELECT TOINT(n_nationkey) AS n_nationkey, TOSTRING(n_name) AS n_name, TOINT(n_regionkey) AS n_regionkey FROM nation")
    return out


@_query("d_linq_terminals", "SELECT count(*) AS n, round(sum(o_totalprice), 2) AS total, round(avg(o_totalprice), 4) AS mean, min(o_totalprice) AS low, max(o_totalprice) AS high FROM orders WHERE o_orderstatus = 'F'")
def d_linq_terminals(spark, sf_dir):
    q = B.Query(read_table(spark, sf_dir, "orders"), "orders").where(B.eq("o_orderstatus", "F"))
    return q.select("COUNT(*) AS n", "ROUND(SUM(o_totalprice), 2) AS total", "ROUND(AVG(o_totalprice), 4) AS mean", "MIN(o_totalprice) AS low", "MAX(o_totalprice) AS high").df()


@_query("d_like_nulls", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_type LIKE 'p%' END AS starts, event_id % 3 <> 0 AND event_type NOT LIKE 'p%' AS kept, event_id % 3 <> 0 AS own FROM events")
def d_like_nulls(spark, sf_dir):
    """LIKE and NOT LIKE over texts and nulls, and a pattern from a column."""
    label = F.when(F.col("event_id") % 3 != 0, F.col("event_type")).alias("label")
    db = D.Database(spark, events=read_table(spark, sf_dir, "events").select("event_id", label))
    rows = db.query("SELECT event_id, label LIKE 'p%' AS starts FROM events")
    for name, where in (("kept", "label NOT LIKE 'p%'"), ("own", "label LIKE label")):
        met = db.query(f"SELECT event_id, TRUE AS {name} FROM events WHERE {where}")
        rows = rows.join(met, "event_id", "left").withColumn(name, F.coalesce(F.col(name), F.lit(False)))
    return rows


@_query("d_like_kinds", _EVENT_DOCS + "SELECT count(*) AS rows, 0::BIGINT AS met FROM docs")
def d_like_kinds(spark, sf_dir):
    """Of schemaless numbers, nulls and missing values none meets LIKE or NOT LIKE."""
    db = D.Database(spark, events=events_as_documents(spark, sf_dir))
    met = db.query("SELECT COUNT(*) AS met FROM events WHERE props.k LIKE '%' OR props.k NOT LIKE '1%'")
    return db.query("SELECT COUNT(*) AS rows FROM events").crossJoin(met)


@_query("d_group_big_integers", "SELECT (9007199254740992 + o_orderkey % 4)::VARCHAR AS v, count(*) AS n FROM orders GROUP BY 1")
def d_group_big_integers(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders").select(F.concat(F.lit('{"n": '), (F.lit(2**53) + F.col("o_orderkey") % 4).cast("string"), F.lit("}")).alias("value"))
    return D.Database(spark, t=D.from_json_lines(o)).query("SELECT TOSTRING(n) AS v, COUNT(*) AS n FROM t GROUP BY n")


@_query("d_insert_ids", "SELECT count(*) + 2 AS documents, count(*) + 2 AS ids FROM nation")
def d_insert_ids(spark, sf_dir):
    """Two documents without an id are added to those that have one."""
    rows = read_table(spark, sf_dir, "nation").select(F.to_json(F.struct(F.col("n_nationkey").cast("string").alias("_id"), "n_name")).alias("value"))
    db = D.Database(spark, nation=D.from_json_lines(rows))
    db.execute("INSERT INTO nation VALUES {n_name: 'ONE'}, {n_name: 'TWO'}")
    ids = db.query("SELECT TOSTRING(_id) AS i FROM nation")
    return ids.agg(F.count(F.lit(1)).alias("documents"), F.countDistinct("i").alias("ids"))


@_query("d_unique_reject", "SELECT count(*) AS documents, true AS rejected FROM customer")
def d_unique_reject(spark, sf_dir):
    """An update and an insert that would repeat a unique value leave the collection as it was."""
    db = D.Database(spark, customer=read_table(spark, sf_dir, "customer"))
    db.create_unique("customer", "c_custkey")
    rejected = 0
    for text in ("UPDATE customer SET c_custkey = 1 WHERE c_custkey = 2", "INSERT INTO customer VALUES {c_custkey: 1, c_name: 'twice'}"):
        try:
            db.execute(text)
        except D.DuplicateValue:
            rejected += 1
    return db.query("SELECT COUNT(*) AS documents FROM customer").withColumn("rejected", F.lit(rejected == 2))


@_query("d_page", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 100")
def d_page(spark, sf_dir):
    db = D.Database(spark, orders=read_table(spark, sf_dir, "orders"))
    return db.page("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey", limit=50, offset=100)


@_query("d_compaction", "SELECT user_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY 1 HAVING arg_max(event_type, event_id) <> 'click'")
def d_compaction(spark, sf_dir):
    """A log of writes is rewritten with its live documents only, and read back."""
    e = read_table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", (F.col("event_type") == "click").alias("gone"))
    log, target = scratch_path(spark, "log"), scratch_path(spark, "compacted")
    e.write.parquet(log)
    files.compact(spark, log, target, key="user_id", seq="event_id", deleted="gone")
    return spark.read.parquet(target).select("user_id", "event_type")
