"""The document SQL dialect over DataFrames.

A collection is a DataFrame: either typed (fields are columns; SQL NULL is a
missing field) or schemaless (one VARIANT column ``doc``, which tells a missing
field from an explicit null). Statements compile to DataFrame operations, so
Catalyst prunes columns, pushes filters down and picks joins and aggregations.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwork.functions import scalars
from loomwork.functions import values as V
from loomwork.functions.values import MISSING, Value
from loomwork.plans import syntax as S

DOC = "doc"
ID = "_id"


def schemaless(df: DataFrame) -> bool:
    return df.columns == [DOC] and isinstance(df.schema[DOC].dataType, T.VariantType)


def from_json_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """A schemaless collection from a column of JSON texts."""
    return lines.select(F.parse_json(F.col(column)).alias(DOC))


class Scope:
    """What names mean in an expression: fields of a row, parameters, and values already computed."""

    def __init__(self, df: DataFrame, parameters: dict | None = None):
        self.df, self.free = df, schemaless(df)
        self.types = {f.name: f.dataType for f in df.schema.fields}
        self.parameters = {k.lower(): v for k, v in (parameters or {}).items()}
        self.known: dict = {}
        self.closed = False
        self.root = F.col(DOC)

    def path(self, steps: tuple) -> Value:
        if self.closed:
            return MISSING
        if self.free:
            return V.follow(Value(self.root, "var", T.VariantType()), steps)
        root = V.of_type(F.col(f"`{steps[0]}`"), self.types[steps[0]]) if steps[0] in self.types else MISSING
        return V.follow(root, steps[1:])

    def constant(self, node):
        if isinstance(node, S.Literal):
            return node.value
        if isinstance(node, S.Parameter):
            return self.parameter(node)
        return None

    def parameter(self, node: S.Parameter):
        if node.name not in self.parameters:
            raise KeyError(f"parameter @{node.name} is not bound")
        return self.parameters[node.name]

    def value(self, node) -> Value:
        if node in self.known:
            return self.known[node]
        match node:
            case S.Literal():
                return V.literal(node.value)
            case S.Parameter():
                return V.literal(self.parameter(node))
            case S.Path():
                return self.path(node.steps)
            case S.ArrayOf():
                return V.array([self.value(x) for x in node.items])
            case S.ObjectOf():
                return self.object(node)
            case S.Call():
                if node.name in S.AGGREGATES:
                    raise ValueError(f"{node.name} is not allowed here")
                return scalars.call(node.name, [self.value(x) for x in node.args], [self.constant(x) for x in node.args])
            case S.Unary(op="-"):
                inner = self.value(node.value)
                return Value(-V.number(inner), "num", inner.type if inner.kind == "num" else T.DoubleType())
            case S.Binary(op="+" | "-" | "*" | "/" | "%"):
                return arithmetic(node.op, self.value(node.left), self.value(node.right))
            case _:
                return Value(self.test(node), "bool", T.BooleanType())

    def object(self, node: S.ObjectOf) -> Value:
        """An object without its missing fields."""
        fields = [(k, self.value(v)) for k, v in node.fields]
        pairs = F.array(*[F.struct(F.lit(k).alias("key"), V.as_variant(v).alias("value")) for k, v in fields])
        present = F.filter(pairs, lambda x: x["value"].isNotNull())
        return Value(F.to_variant_object(F.map_from_entries(present)) if fields else F.parse_json(F.lit("{}")), "var", T.VariantType())

    def holds(self, node) -> Column:
        """Truth with unknown as false."""
        return F.coalesce(V.truthy(self.value(node)), F.lit(False))

    def keeps(self, node) -> Column:
        """A filter that keeps the same rows as `holds`: unknown needs no care there, so comparisons stay bare and reach the scan."""
        if isinstance(node, S.Binary) and node.op in ("AND", "OR"):
            left, right = self.keeps(node.left), self.keeps(node.right)
            return left & right if node.op == "AND" else left | right
        return V.truthy(self.value(node))

    def test(self, node) -> Column:
        match node:
            case S.Binary(op="AND"):
                return self.holds(node.left) & self.holds(node.right)
            case S.Binary(op="OR"):
                return self.holds(node.left) | self.holds(node.right)
            case S.Unary(op="NOT"):
                return ~V.truthy(self.value(node.value))
            case S.Binary(op="LIKE" | "NOT LIKE"):
                found = self.like(node)
                return found if node.op == "LIKE" else ~found
            case S.Binary():
                return V.compare(node.op, self.value(node.left), self.value(node.right))
            case S.In():
                return self.within(node)
            case S.Between():
                value, low, high = self.value(node.value), self.value(node.low), self.value(node.high)
                found = V._plain(">=", value, low) & V._plain("<=", value, high)
                return ~found if node.negated else found
            case S.Is():
                found = self.absent(self.value(node.value), node.what)
                return ~found if node.negated else found
        raise TypeError(f"not an expression: {node!r}")

    def like(self, node: S.Binary) -> Column:
        """Unknown where either side is no text, so such rows meet neither LIKE nor NOT LIKE."""
        text, pattern = V.string(self.value(node.left)), self.constant(node.right)
        if isinstance(pattern, str):
            plain = scalars.simple_like(pattern)
            return text.like(plain) if plain is not None else text.rlike(scalars.like_pattern(pattern))
        return F.call_function("like", text, scalars.plain_like(V.string(self.value(node.right))))

    def within(self, node: S.In) -> Column:
        value = self.value(node.value)
        items = self.parameter(node.items) if isinstance(node.items, S.Parameter) else node.items
        constants = [x if isinstance(node.items, S.Parameter) else self.constant(x) for x in items]
        simple = value.kind in ("num", "str") and all(isinstance(x, (int, float, str)) and not isinstance(x, bool) for x in constants)
        if simple and {isinstance(x, str) for x in constants} == {value.kind == "str"}:
            found = value.col.isin(constants)
        else:
            each = [V.compare("=", value, V.literal(x) if isinstance(node.items, S.Parameter) else self.value(x)) for x in items]
            found = F.lit(False)
            for test in each:
                found = found | F.coalesce(test, F.lit(False))
            found = F.when(~value.missing, found)
        return ~found if node.negated else found

    @staticmethod
    def absent(value: Value, what: str) -> Column:
        if value.kind == "null":
            return F.lit(what == "NULL")
        if value.kind == "var" and what == "NULL":
            return value.col.isNull() | F.is_variant_null(value.col)
        return value.missing


def arithmetic(op: str, a: Value, b: Value) -> Value:
    """Numbers, or text for + with a text on either side; anything else is missing, and so is division by 0."""
    if op == "+" and "str" in (a.kind, b.kind):
        return Value(F.concat(V.display(a), V.display(b)), "str", T.StringType())
    x, y = V.number(a), V.number(b)
    whole = all(isinstance(v.type, T.IntegralType) for v in (a, b)) and a.kind == b.kind == "num"
    exact = all(isinstance(v.type, (T.IntegralType, T.DecimalType)) for v in (a, b)) and not whole
    if whole:
        x, y = x.cast("long"), y.cast("long")
    elif not exact or op == "%":
        x, y = x.cast("double"), y.cast("double")
    if op == "/":
        return Value(F.try_divide(x if exact else x.cast("double"), y if exact else y.cast("double")), "num", T.DecimalType() if exact else T.DoubleType())
    if op == "%":
        return Value(F.try_mod(x, y), "num", T.LongType() if whole else T.DoubleType())
    out = {"+": x + y, "-": x - y, "*": x * y}[op]
    if op == "+" and "var" in (a.kind, b.kind):
        either = F.coalesce(V.string(a), V.string(b)).isNotNull()
        mixed = F.when(either, F.concat(V.display(a), V.display(b)).cast("variant")).otherwise(out.cast("variant"))
        return Value(mixed, "var", T.VariantType())
    return Value(out, "num", T.LongType() if whole else T.DecimalType() if exact else T.DoubleType())


def _mean(n: Column, count: Column, rough: Column) -> Column:
    """The mean of doubles: where all of a group have six decimals at most, it is summed exactly, whatever the order of rows."""
    n = n.cast("double")
    units = F.rint(n * 1e6)
    whole = F.when((F.abs(units) < 2.0**53) & (units / 1e6 == n), units.cast("long").cast("decimal(16,0)"))
    return F.when((F.count(n) > 0) & (F.count(whole) == F.count(n)), F.try_divide(F.sum(whole).cast("double"), count * 1e6)).otherwise(rough)


def aggregate(call: S.Call, scope: Scope) -> tuple[Column, Value]:
    """The aggregate as a column, and a value of its kind."""
    if call.star:
        return F.count(F.lit(1)), Value(F.lit(0), "num", T.LongType())
    if len(call.args) != 1:
        raise ValueError(f"{call.name} takes one argument")
    if S.has_aggregate(call.args[0]):
        raise ValueError("an aggregate inside an aggregate")
    v = scope.value(call.args[0])
    present = F.when(~scope.absent(v, "NULL"), F.lit(1))
    n = V.number(v)
    if call.name == "COUNT":
        return F.count(present), Value(F.lit(0), "num", T.LongType())
    if call.name == "SUM":
        kind = T.LongType() if isinstance(v.type, T.IntegralType) else v.type if isinstance(v.type, T.DecimalType) else T.DoubleType()
        return F.coalesce(F.sum(n), F.lit(0)), Value(F.lit(0), "num", kind)
    if call.name == "AVG":
        if v.kind == "num" and not isinstance(v.type, (T.DoubleType, T.FloatType)):
            return F.avg(n), Value(F.lit(0), "num", T.DoubleType())
        rough = F.avg(n) if v.kind == "num" else F.try_divide(F.coalesce(F.sum(n), F.lit(0.0)), F.count(present))
        return _mean(n, F.count(n) if v.kind == "num" else F.count(present), rough), Value(F.lit(0), "num", T.DoubleType())
    if v.kind in ("num", "str", "bool", "time"):
        return (F.min if call.name == "MIN" else F.max)(v.col), v
    held = F.when(~scope.absent(v, "NULL"), V.as_variant(v))
    order = F.when(~scope.absent(v, "NULL"), V.key(v))
    return (F.min_by if call.name == "MIN" else F.max_by)(held, order), Value(F.lit(None), "var", T.VariantType())


def output(v: Value) -> Column:
    return F.lit(None).cast("string") if v.kind in ("missing", "null") else v.col


def sort_columns(v: Value, descending: bool) -> list[Column]:
    """Missing, then null, then by rank and value, and all of it the other way round if descending."""
    if v.kind in ("missing", "null"):
        return []
    col = V.key(v) if v.kind in ("var", "arr", "obj") else v.col
    turn = Column.desc_nulls_last if descending else Column.asc_nulls_first
    if isinstance(v.type, (T.DoubleType, T.FloatType)):  # NaN is below all numbers
        return [turn(F.when(col.isNotNull(), ~F.isnan(col))), turn(col)]
    return [turn(col)]


def select(df: DataFrame, statement: S.Select, parameters: dict | None = None) -> DataFrame:
    scope = Scope(df, parameters)
    if statement.where is not None:
        if S.has_aggregate(statement.where):
            raise ValueError("an aggregate in WHERE")
        df = df.filter(scope.keeps(statement.where))
    wanted = [o.expr for o in statement.outputs] + [o.expr for o in statement.order] + [statement.having]
    calls = list(dict.fromkeys(x for node in wanted if node is not None and node != "*" for x in S.walk(node) if isinstance(x, S.Call) and x.name in S.AGGREGATES))
    grouped = bool(statement.group or calls or statement.having is not None)
    if grouped:
        df, scope = _group(df, scope, statement, calls)
        if statement.having is not None:
            df = df.filter(scope.keeps(statement.having))
    columns = _outputs(df, scope, statement, grouped)
    if statement.distinct:
        kinds = {name for name, v in columns if v.kind in ("var", "arr", "obj")}
        plain = [(V.as_variant(v) if name in kinds else output(v)) for name, v in columns]
        df = df.select(*[(F.to_json(c) if name in kinds else c).alias(name) for (name, _), c in zip(columns, plain, strict=True)]).distinct()
        df = df.select(*[(F.parse_json(F.col(f"`{n}`")) if n in kinds else F.col(f"`{n}`")).alias(n) for n, _ in columns])
        scope = Scope(df, parameters)
        names = {n: V.of_type(F.col(f"`{n}`"), df.schema[n].dataType) for n, _ in columns}
        order = []
        for o in statement.order:
            name = next((n for n, _ in columns if isinstance(o.expr, S.Path) and o.expr.steps == (n,)), None) or next(
                (x.name for x in statement.outputs if x.expr == o.expr), None
            )
            if name is None:
                raise ValueError("ORDER BY must name a selected column when DISTINCT is used")
            order += sort_columns(names[name], o.descending)
        df = df.orderBy(*order) if order else df
    else:
        by_name = dict(columns)
        order = []
        for o in statement.order:
            alias = o.expr.steps[0] if isinstance(o.expr, S.Path) and len(o.expr.steps) == 1 else None
            order += sort_columns(by_name[alias] if alias in by_name else scope.value(o.expr), o.descending)
        df = df.orderBy(*order) if order else df
        df = df.select(*[output(v).alias(name) for name, v in columns])
    if statement.offset:
        df = df.offset(statement.offset)
    return df.limit(statement.limit) if statement.limit is not None else df


def _group(df: DataFrame, scope: Scope, statement: S.Select, calls: list) -> tuple[DataFrame, Scope]:
    keys = [scope.value(g) for g in statement.group]
    columns = []
    for i, v in enumerate(keys):
        text = F.coalesce(F.when(V.variant_rank(v.col) == 3, V.number_text(v.col)), F.to_json(v.col)) if v.kind == "var" else output(v)
        columns.append(text.alias(f"__g{i}"))
    found = [aggregate(c, scope) for c in calls]
    table = df.groupBy(*columns) if columns else df.groupBy()
    # without aggregates, the groups themselves are the result
    df = table.agg(*[c.alias(f"__a{i}") for i, (c, _) in enumerate(found)]) if found else df.select(*columns).distinct()
    inner = Scope(df, scope.parameters)
    inner.closed = True
    for i, (node, v) in enumerate(zip(statement.group, keys, strict=True)):
        col = F.col(f"__g{i}")
        inner.known[node] = Value(F.parse_json(col), "var", T.VariantType()) if v.kind == "var" else Value(col, v.kind, v.type)
    for i, (node, (_, v)) in enumerate(zip(calls, found, strict=True)):
        inner.known[node] = Value(F.col(f"__a{i}"), v.kind, v.type)
    return df, inner


def _outputs(df: DataFrame, scope: Scope, statement: S.Select, grouped: bool) -> list[tuple[str, Value]]:
    out = []
    for o in statement.outputs:
        if o.expr == "*" and grouped:
            names = {S.Path: lambda g: ".".join(map(str, g.steps))}
            out += [(names.get(type(g), str)(g), scope.known[g]) for g in statement.group]
        elif o.expr == "*":
            out += [(n, V.of_type(F.col(f"`{n}`"), df.schema[n].dataType)) for n in df.columns]
        else:
            out.append((o.name, scope.value(o.expr)))
    return out


def set_field(v: Value, steps: tuple, new: Value) -> Value:
    """The value with a field at a path set; objects on the way are made where there are none."""
    if not steps:
        return new
    name, *rest = steps
    if not isinstance(name, str):
        raise ValueError("only fields can be set")
    if v.kind == "obj" and isinstance(v.type, T.StructType):
        inner = set_field(V.step(v, name), tuple(rest), new)
        return Value(v.col.withField(name, output(inner)), "obj", v.type)
    many = F.coalesce(V.get(V.as_variant(v), "$", "map<string,variant>"), F.create_map().cast("map<string,variant>"))

    def changed(fields: Column) -> Column:
        inner = set_field(Value(F.try_element_at(fields, F.lit(name)), "var", T.VariantType()), tuple(rest), new)
        null = V.as_variant(V.literal(None))
        value = null if inner.kind == "missing" else F.coalesce(V.as_variant(inner), null)
        return F.to_variant_object(F.map_concat(F.map_filter(fields, lambda k, _: k != name), F.create_map(F.lit(name), value)))

    return Value(V.once(many, changed), "var", T.VariantType())


def update(df: DataFrame, statement: S.Update, parameters: dict | None = None) -> DataFrame:
    """Assignments in order, each seeing those before it, where the condition holds."""
    hit = Scope(df, parameters).holds(statement.where) if statement.where is not None else F.lit(True)
    if schemaless(df):
        def assignment(path: S.Path, expr):
            def assigned(doc: Column) -> Column:
                scope = Scope(df, parameters)
                scope.root = doc
                return set_field(Value(doc, "var", T.VariantType()), path.steps, scope.value(expr)).col

            return assigned

        changed = F.col(DOC)
        for path, expr in statement.sets:
            changed = V.once(changed, assignment(path, expr))
        return df.select(F.when(hit, changed).otherwise(F.col(DOC)).alias(DOC))
    columns = df.columns
    df = df.withColumn("__hit", hit)
    for path, expr in statement.sets:
        plain = df.select(*[c for c in df.columns if c != "__hit"])
        scope = Scope(plain, parameters)
        new = scope.value(expr)
        name = path.steps[0]
        if name in plain.columns:
            kind = plain.schema[name].dataType
            changed = output(set_field(V.of_type(F.col(name), kind), path.steps[1:], new)).cast(kind)
            df = df.withColumn(name, F.when(F.col("__hit"), changed).otherwise(F.col(name)))
        else:
            df = df.withColumn(name, F.when(F.col("__hit"), output(new)))
            columns = [*columns, name]
    return df.select(*columns)


def insert(df: DataFrame, statement: S.Insert, parameters: dict | None = None) -> DataFrame:
    """With the documents added; a schemaless one without ``_id`` gets a new one."""
    one = df.sparkSession.range(1)
    empty = Scope(one, parameters)
    for document in statement.documents:
        if schemaless(df):
            if ID not in [k for k, _ in document.fields]:
                document = S.ObjectOf(((ID, S.Literal(uuid.uuid4().hex)), *document.fields))
            df = df.unionByName(one.select(empty.value(document).col.alias(DOC)))
        else:
            fields = {k: output(empty.value(v)) for k, v in document.fields}
            types = {f.name: f.dataType for f in df.schema.fields}
            row = one.select(*[(c.cast(types[k]) if k in types else c).alias(k) for k, c in fields.items()])
            df = df.unionByName(row, allowMissingColumns=True)
    return df


def delete(df: DataFrame, statement: S.Delete, parameters: dict | None = None) -> DataFrame:
    return df.filter(~Scope(df, parameters).holds(statement.where)) if statement.where is not None else df.limit(0)


def unique_violations(df: DataFrame, path: str) -> DataFrame:
    """Values of a path that more than one document holds; an array counts once per element, missing ones not at all."""
    value = Scope(df).value(S.expression(path))
    many = V.elements(value)
    cols = F.explode(many[0]) if many and value.kind == "arr" else output(value)
    rows = df.select(cols.alias("value"))
    rows = rows.select(F.to_json("value").alias("value")) if isinstance(rows.schema["value"].dataType, T.VariantType) else rows
    return rows.filter(F.col("value").isNotNull()).groupBy("value").agg(F.count(F.lit(1)).alias("documents")).filter(F.col("documents") > 1)


class DuplicateValue(ValueError):
    """A change that would leave two documents with one value of a unique path."""


class Database:
    """Named collections. Queries return DataFrames; changes replace a collection's DataFrame."""

    def __init__(self, spark: SparkSession, **collections: DataFrame):
        self.spark, self.collections = spark, dict(collections)
        #: unique paths of each collection
        self.unique: dict[str, list[str]] = {}

    def create_unique(self, name: str, path: str) -> None:
        """From now on changes that would repeat a value of the path are rejected; so is this call if one is repeated already."""
        self._check(name, self[name], [path])
        self.unique.setdefault(name, []).append(path)

    def _check(self, name: str, rows: DataFrame, paths: list[str]) -> None:
        for path in paths:
            repeated = unique_violations(rows, path).limit(1).collect()
            if repeated:
                raise DuplicateValue(f"{name}.{path} would hold {repeated[0].value!r} more than once")

    def _replace(self, name: str, rows: DataFrame) -> None:
        """The collection's new rows, if they meet its unique paths; else nothing changes."""
        self._check(name, rows, self.unique.get(name, []))
        self.collections[name] = rows

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self.collections:
            raise KeyError(f"no collection {name}")
        return self.collections[name]

    def query(self, text: str, parameters: dict | None = None) -> DataFrame:
        statement = S.parse(text)
        if not isinstance(statement, S.Select):
            raise ValueError("not a query")
        return select(self[statement.source], statement, parameters)

    def execute(self, text: str, parameters: dict | None = None) -> DataFrame | int:
        """A query's rows, or the number of documents a change touched."""
        statement = S.parse(text)
        if isinstance(statement, S.Select):
            return select(self[statement.source], statement, parameters)
        if isinstance(statement, S.Insert):
            start = self.collections.get(statement.target)
            if start is None:
                start = self.spark.sql(f"SELECT parse_json('{{}}') AS {DOC} LIMIT 0")
            self._replace(statement.target, insert(start, statement, parameters))
            return len(statement.documents)
        df = self[statement.target]
        touched = self.find(statement.target, statement.where, parameters).count()
        self._replace(statement.target, (update if isinstance(statement, S.Update) else delete)(df, statement, parameters))
        return touched

    def find(self, name: str, where=None, parameters: dict | None = None, limit: int | None = None) -> DataFrame:
        """Rows of a collection that meet a condition, given as text or as a tree."""
        df = self[name]
        node = S.expression(where) if isinstance(where, str) else where
        df = df.filter(Scope(df, parameters).keeps(node)) if node is not None else df
        return df.limit(limit) if limit is not None else df

    def count_where(self, name: str, where=None, parameters: dict | None = None) -> int:
        return self.find(name, where, parameters).count()

    def find_by_id(self, name: str, key, id_field: str = "_id") -> DataFrame:
        return self.find(name, S.Binary("=", S.Path((id_field,)), S.Parameter("id")), {"id": key}, 1)

    def exists(self, name: str, key, id_field: str = "_id") -> bool:
        return not self.find_by_id(name, key, id_field).isEmpty()

    def save_many(self, name: str, rows: DataFrame, id_field: str = "_id") -> None:
        """Upsert: rows of the collection with an id among the new ones are replaced."""
        old = self[name].join(rows.select(id_field).distinct(), id_field, "left_anti")
        self._replace(name, old.unionByName(rows, allowMissingColumns=True))

    def insert_many(self, name: str, rows: DataFrame) -> None:
        """Adds rows as they are."""
        self._replace(name, self[name].unionByName(rows, allowMissingColumns=True))

    def delete_by_id(self, name: str, key, id_field: str = ID) -> bool:
        there = self.exists(name, key, id_field)
        self.execute(f"DELETE FROM {name} WHERE {id_field} = @id", {"id": key})
        return there

    def clear(self, name: str) -> None:
        self.collections[name] = self[name].limit(0)

    def stats(self, name: str) -> dict:
        """Number of documents and of unique paths, and the partitions that a scan reads."""
        df = self[name]
        return {"documents": df.count(), "unique": len(self.unique.get(name, [])), "partitions": df.select(F.spark_partition_id().alias("p")).distinct().count()}

    def drop(self, name: str) -> bool:
        return self.collections.pop(name, None) is not None

    def unique_violations(self, name: str, path: str) -> DataFrame:
        return unique_violations(self[name], path)

    def explain(self, text: str, parameters: dict | None = None) -> str:
        return self.query(text, parameters)._jdf.queryExecution().toString()

    def page(self, text: str, parameters: dict | None = None, *, limit: int = 100, offset: int = 0) -> DataFrame:
        """A page of at most 10,000 rows of an ordered query."""
        statement = S.parse(text)
        if not statement.order:
            raise ValueError("a paged query needs ORDER BY")
        return select(self[statement.source], statement, parameters).offset(offset).limit(min(limit, 10_000))


def documents(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """A small schemaless collection from Python objects."""
    return from_json_lines(spark.createDataFrame([(json.dumps(r),) for r in rows], "value string"))
