"""Values of the document dialect as Spark columns.

A value has a static kind where the schema gives one, and is a VARIANT
otherwise. SQL NULL stands for a missing value; an explicit null exists only in
VARIANTs. Values of different kinds never equal but are ordered by rank:
null 1, boolean 2, number 3, string 4, binary 5, time 6, array 9, object 10.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

RANK = {"null": 1, "bool": 2, "num": 3, "str": 4, "bin": 5, "time": 6, "arr": 9, "obj": 10}


@dataclass
class Value:
    col: Column | None
    kind: str
    type: T.DataType | None = None

    @property
    def missing(self) -> Column:
        return F.lit(True) if self.kind == "missing" else self.col.isNull()


MISSING = Value(None, "missing")


def once(col: Column, body: Callable[[Column], Column]) -> Column:
    """``body(col)`` with the column computed once, however often the body uses it."""
    return F.transform(F.array(col), body)[0]


def of_type(col: Column, kind: T.DataType) -> Value:
    if isinstance(kind, T.BooleanType):
        return Value(col, "bool", kind)
    if isinstance(kind, (T.NumericType,)):
        return Value(col, "num", kind)
    if isinstance(kind, T.StringType):
        return Value(col, "str", kind)
    if isinstance(kind, T.BinaryType):
        return Value(col, "bin", kind)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return Value(col, "time", kind)
    if isinstance(kind, T.ArrayType):
        return Value(col, "arr", kind)
    if isinstance(kind, (T.StructType, T.MapType)):
        return Value(col, "obj", kind)
    if isinstance(kind, T.VariantType):
        return Value(col, "var", kind)
    return MISSING


def literal(value) -> Value:
    if value is None:
        return Value(F.parse_json(F.lit("null")), "null", T.VariantType())
    if isinstance(value, bool):
        return Value(F.lit(value), "bool", T.BooleanType())
    if isinstance(value, int):
        return Value(F.lit(value).cast("long") if abs(value) >= 1 << 31 else F.lit(value), "num", T.LongType())
    if isinstance(value, float):
        return Value(F.lit(value), "num", T.DoubleType())
    if isinstance(value, str):
        return Value(F.lit(value), "str", T.StringType())
    if isinstance(value, (list, tuple)):
        parts = [literal(v) for v in value]
        return array(parts)
    if isinstance(value, dict):
        if set(value) == {"$date"}:
            return Value(F.to_timestamp(F.lit(value["$date"])), "time", T.TimestampType())
        return Value(F.to_variant_object(F.create_map(*[x for k, v in value.items() for x in (F.lit(k), as_variant(literal(v)))])), "var", T.VariantType())
    return of_type(F.lit(value), T._infer_type(value))


def array(parts: list[Value]) -> Value:
    kinds = {p.kind for p in parts}
    if len(kinds) == 1 and kinds <= {"num", "str", "bool", "time"}:
        kind = T.DoubleType() if kinds == {"num"} and any(isinstance(p.type, T.DoubleType) for p in parts) else parts[0].type
        return Value(F.array(*[p.col for p in parts]), "arr", T.ArrayType(kind))
    if not parts:
        return Value(F.array().cast("array<string>"), "arr", T.ArrayType(T.StringType()))
    return Value(F.array(*[as_variant(p) for p in parts]), "arr", T.ArrayType(T.VariantType()))


def as_variant(v: Value) -> Column:
    if v.kind in ("var", "null"):
        return v.col
    if v.kind == "missing":
        return F.lit(None).cast("variant")
    if v.kind in ("arr", "obj"):
        return F.to_variant_object(v.col)
    return v.col.cast("variant")


def get(v: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(v, path, kind)


def variant_rank(v: Column) -> Column:
    """Rank of a VARIANT; a single-key object {"$date": text} is a time."""
    told = F.schema_of_variant(v)
    out = F.when(v.isNull(), F.lit(None).cast("int")).when(F.is_variant_null(v), 1)
    for prefix, rank in (("BOOLEAN", 2), ("STRING", 4), ("BINARY", 5), ("TIMESTAMP", 6), ("DATE", 6), ("ARRAY", 9)):
        out = out.when(told.startswith(prefix), rank)
    return out.when(told.startswith("OBJECT<`$date`") | told.startswith("OBJECT<$date"), 6).when(told.startswith("OBJECT"), 10).otherwise(3)


def number_text(v: Column) -> Column:
    """One text for each number, whole numbers exactly: 5 and 5.0 are one, 2^53 and 2^53 + 1 are not."""
    number, whole = get(v, "$", "double"), F.when(F.schema_of_variant(v) == "BIGINT", get(v, "$", "bigint").cast("string"))
    small = F.when((number == F.floor(number)) & (F.abs(number) < 2.0**53), number.cast("bigint").cast("string"))
    return F.coalesce(whole, small, number.cast("string"))


def variant_time(v: Column) -> Column:
    return F.coalesce(F.try_to_timestamp(get(v, "$['$date']", "string")), get(v, "$", "timestamp"))


def key(v: Value) -> Column:
    """(rank, number, text): equal for equal values and ordered like them."""
    number, text = F.lit(None).cast("double"), F.lit(None).cast("string")
    if v.kind == "missing":
        return F.lit(None).cast("struct<r:int,n:double,s:string>")
    if v.kind == "var":
        rank = variant_rank(v.col)
        number = (
            F.when(rank == 3, get(v.col, "$", "double")).when(rank == 2, get(v.col, "$", "boolean").cast("double"))
            .when(rank == 6, F.unix_micros(variant_time(v.col)).cast("double"))
        )
        text = F.when(rank == 4, get(v.col, "$", "string")).when(rank.isin(5, 9, 10), F.to_json(v.col))
        return F.when(v.col.isNotNull(), F.struct(rank.alias("r"), number.alias("n"), text.alias("s")))
    if v.kind in ("num", "bool"):
        number = v.col.cast("double")
    elif v.kind == "time":
        number = F.unix_micros(v.col.cast("timestamp")).cast("double")
    elif v.kind == "str":
        text = v.col
    elif v.kind == "bin":
        text = F.hex(v.col)
    elif v.kind in ("arr", "obj"):
        text = F.to_json(as_variant(v))
    return F.when(v.col.isNotNull(), F.struct(F.lit(RANK[v.kind]).alias("r"), number.alias("n"), text.alias("s")))


def elements(v: Value) -> tuple[Column, Callable[[Column], Value]] | None:
    """The elements of a value that may be an array: an array column, null for no array, and how to read one."""
    if v.kind == "arr":
        return v.col, lambda x: of_type(x, v.type.elementType)
    if v.kind == "var":
        return F.when(variant_rank(v.col) == 9, get(v.col, "$", "array<variant>")), lambda x: Value(x, "var", T.VariantType())
    return None


def _plain(op: str, a: Value, b: Value) -> Column:
    """Comparison of two values as wholes; unknown (null) if either is missing."""
    if a.kind == b.kind and a.kind in ("num", "str", "bool", "time"):
        left, right = a.col, b.col
        if a.kind == "time":
            left, right = left.cast("timestamp"), right.cast("timestamp")
        return {"=": left == right, "!=": left != right, "<": left < right, "<=": left <= right, ">": left > right, ">=": left >= right}[op]
    if "missing" in (a.kind, b.kind):
        return F.lit(None).cast("boolean")
    left, right = key(a), key(b)
    known = ~(a.missing | b.missing)
    if op in ("=", "!="):
        return F.when(known, left.eqNullSafe(right) if op == "=" else ~left.eqNullSafe(right))
    no_null = (left["r"] > 1) & (right["r"] > 1)
    return F.when(known & no_null, {"<": left < right, "<=": left <= right, ">": left > right, ">=": left >= right}[op])


def compare(op: str, a: Value, b: Value) -> Column:
    """Comparison in which an array meets a scalar element by element: any element, or for != no equal one."""
    if a.kind != "arr" and b.kind == "arr":
        flipped = {"<": ">", "<=": ">=", ">": "<", ">=": "<="}.get(op, op)
        return compare(flipped, b, a)
    found = elements(a)
    if found is None or b.kind in ("arr", "obj", "missing"):
        return _plain(op, a, b)
    many, read = found
    each = lambda o: F.coalesce(F.exists(many, lambda x: F.coalesce(_plain(o, read(x), b), F.lit(False))), F.lit(False))
    by_element = ~each("=") if op == "!=" else each(op)
    if a.kind == "arr":
        scalar = F.when(a.col.isNotNull() & ~b.missing, by_element)
        return F.when(variant_rank(b.col) == 9, _plain(op, a, b)).otherwise(scalar) if b.kind == "var" else scalar
    if b.kind == "var":
        return F.when(many.isNotNull() & (variant_rank(b.col) < 9), by_element).otherwise(_plain(op, a, b))
    return F.when(many.isNotNull(), by_element).otherwise(_plain(op, a, b))


def truthy(v: Value) -> Column:
    """Null where missing or null; else false for false, 0 and empty values."""
    if v.kind == "bool":
        return v.col
    if v.kind == "num":
        return v.col != 0
    if v.kind == "str":
        return F.length(v.col) > 0
    if v.kind == "bin":
        return F.octet_length(v.col) > 0
    if v.kind == "arr":
        return F.size(v.col) > 0
    if v.kind in ("missing", "null"):
        return F.lit(None).cast("boolean")
    if v.kind == "var":
        rank = variant_rank(v.col)
        return (
            F.when(rank == 2, get(v.col, "$", "boolean")).when(rank == 3, get(v.col, "$", "double") != 0)
            .when(rank == 4, F.length(get(v.col, "$", "string")) > 0).when(rank == 9, F.size(get(v.col, "$", "array<variant>")) > 0)
            .when(rank == 10, F.to_json(v.col) != "{}").when(rank > 1, F.lit(True))
        )
    return v.col.isNotNull()


def number(v: Value) -> Column:
    """The number, or null for any other kind."""
    if v.kind == "num":
        return v.col
    if v.kind == "var":
        return F.when(variant_rank(v.col) == 3, get(v.col, "$", "double"))
    return F.lit(None).cast("double")


def string(v: Value) -> Column:
    if v.kind == "str":
        return v.col
    if v.kind == "var":
        return F.when(variant_rank(v.col) == 4, get(v.col, "$", "string"))
    return F.lit(None).cast("string")


def time(v: Value) -> Column:
    if v.kind == "time":
        return v.col.cast("timestamp")
    if v.kind == "var":
        return F.when(variant_rank(v.col) == 6, variant_time(v.col))
    return F.lit(None).cast("timestamp")


def display(v: Value) -> Column:
    """The text of a value: times as yyyy-MM-dd HH:mm:ss, arrays and objects by size; null stays null."""
    if v.kind in ("missing", "null"):
        return F.lit(None).cast("string")
    if v.kind == "time":
        return F.date_format(v.col.cast("timestamp"), "yyyy-MM-dd HH:mm:ss")
    if v.kind == "arr":
        return F.concat(F.lit("["), F.size(v.col).cast("string"), F.lit(" items]"))
    if v.kind == "obj":
        n = len(v.type.fields) if isinstance(v.type, T.StructType) else F.size(v.col)
        return F.when(v.col.isNotNull(), F.concat(F.lit("{"), (F.lit(n) if isinstance(n, int) else n).cast("string"), F.lit(" fields}")))
    if v.kind == "var":
        rank = variant_rank(v.col)
        n = F.size(F.json_object_keys(F.to_json(v.col)))
        return (
            F.when(rank == 6, F.date_format(variant_time(v.col), "yyyy-MM-dd HH:mm:ss"))
            .when(rank == 9, F.concat(F.lit("["), F.size(get(v.col, "$", "array<variant>")).cast("string"), F.lit(" items]")))
            .when(rank == 10, F.concat(F.lit("{"), n.cast("string"), F.lit(" fields}"))).when(rank > 1, get(v.col, "$", "string"))
        )
    return v.col.cast("string")


def step(v: Value, part) -> Value:
    """One step of a path: a field name, an index (negative from the end), or None for every element."""
    if v.kind == "var":
        if part is None:
            return Value(F.when(variant_rank(v.col) == 9, get(v.col, "$", "array<variant>")), "arr", T.ArrayType(T.VariantType()))
        if isinstance(part, int):
            many = F.when(variant_rank(v.col) == 9, get(v.col, "$", "array<variant>"))
            return Value(F.get(many, part) if part >= 0 else F.try_element_at(many, F.lit(part)), "var", T.VariantType())
        return Value(F.try_variant_get(v.col, "$['" + part.replace("'", "\\'") + "']", "variant"), "var", T.VariantType())
    if v.kind == "arr":
        if part is None:
            return v
        if isinstance(part, int):
            return of_type(F.get(v.col, part) if part >= 0 else F.try_element_at(v.col, F.lit(part)), v.type.elementType)
        return MISSING
    if v.kind == "obj" and isinstance(part, str):
        if isinstance(v.type, T.StructType) and part in v.type.names:
            return of_type(v.col[part], v.type[part].dataType)
        if isinstance(v.type, T.MapType):
            return of_type(F.try_element_at(v.col, F.lit(part)), v.type.valueType)
    return MISSING


def follow(v: Value, parts: tuple) -> Value:
    """A path from a value. After [] the rest is followed in each element, and missing results are dropped."""
    for i, part in enumerate(parts):
        v = step(v, part)
        if part is None and v.kind == "arr" and i + 1 < len(parts):
            shape = follow(of_type(F.lit(None), v.type.elementType), parts[i + 1 :])
            if shape.kind == "missing":
                return Value(F.filter(F.transform(v.col, lambda x: F.lit(None).cast("string")), lambda x: x.isNotNull()), "arr", T.ArrayType(T.StringType()))
            element = v.type.elementType
            out = F.transform(v.col, lambda x: follow(of_type(x, element), parts[i + 1 :]).col)  # noqa: B023
            flat = shape.kind == "arr" and None in parts[i + 1 :]
            out = F.flatten(F.filter(out, lambda x: x.isNotNull())) if flat else F.filter(out, lambda x: x.isNotNull())
            return Value(out, "arr", shape.type if flat else T.ArrayType(shape.type))
    return v
