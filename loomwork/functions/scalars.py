"""Scalar functions of the document dialect. A wrong kind or count of arguments gives a missing value, never an error."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwork.functions import values as V
from loomwork.functions.values import MISSING, Value

_STR, _NUM, _BOOL, _TIME = T.StringType(), T.DoubleType(), T.BooleanType(), T.TimestampType()


def _s(col: Column) -> Value:
    return Value(col, "str", _STR)


def _n(col: Column, kind: T.DataType = _NUM) -> Value:
    return Value(col, "num", kind)


def _b(col: Column) -> Value:
    return Value(col, "bool", _BOOL)


def length(v: Value) -> Value:
    if v.kind == "arr":
        return _n(F.when(v.col.isNotNull(), F.size(v.col)), T.IntegerType())
    if v.kind == "bin":
        return _n(F.octet_length(v.col), T.IntegerType())
    if v.kind == "obj":
        return _n(F.when(v.col.isNotNull(), F.size(F.json_object_keys(F.to_json(v.col)))), T.IntegerType())
    if v.kind == "var":
        rank = V.variant_rank(v.col)
        out = F.when(rank == 4, F.length(V.get(v.col, "$", "string"))).when(rank == 9, F.size(V.get(v.col, "$", "array<variant>")))
        return _n(out.when(rank == 10, F.size(F.json_object_keys(F.to_json(v.col)))), T.IntegerType())
    return _n(F.length(V.string(v)), T.IntegerType())


def substr(s: Value, start: Value, n: Value | None = None) -> Value:
    """From a place counted from 0, or from the end if negative; never outside the text."""
    text, at = V.string(s), V.number(start).cast("int")
    first = F.when(at < 0, F.greatest(F.length(text) + at, F.lit(0))).otherwise(at)
    count = F.greatest(V.number(n).cast("int"), F.lit(0)) if n else F.length(text)
    return _s(F.substring(text, first + 1, count))


def concat(*parts: Value) -> Value:
    return _s(F.concat_ws("", *[V.display(p) for p in parts])) if parts else MISSING


def replace(s: Value, old: Value, new: Value) -> Value:
    text, a, b = V.string(s), V.string(old), V.string(new)
    return _s(F.when(F.length(a) > 0, F.replace(text, a, b)))


def split(s: Value, separator: Value) -> Value:
    text, by = V.string(s), V.string(separator)
    quoted = F.concat(F.lit("\\Q"), F.replace(by, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    out = F.when(text.isNotNull() & by.isNotNull(), F.when(by == "", F.array(text)).otherwise(F.split(text, quoted, -1)))
    return Value(out, "arr", T.ArrayType(_STR))


def rounded(x: Value, digits: Value | None = None) -> Value:
    """Half away from zero; digits from 0 to 15."""
    n = V.number(x).cast("double")
    if digits is None:
        return _n(F.round(n, 0))
    d = F.least(F.greatest(V.number(digits).cast("int"), F.lit(0)), F.lit(15))
    return _n(F.round(n, d))


def first_present(*parts: Value) -> Value:
    """The first value that is neither missing nor null."""
    present = [p for p in parts if p.kind not in ("missing", "null")]
    if not present:
        return MISSING
    if len({p.kind for p in present}) == 1 and present[0].kind not in ("var", "arr", "obj"):
        return Value(F.coalesce(*[p.col for p in present]), present[0].kind, present[0].type)
    parts_ = [F.when(~F.is_variant_null(V.as_variant(p)), V.as_variant(p)) if p.kind == "var" else V.as_variant(p) for p in present]
    return Value(F.coalesce(*parts_), "var", T.VariantType())


_NAMES = {
    T.BooleanType: "bool", T.IntegerType: "int", T.ShortType: "int", T.ByteType: "int", T.LongType: "long", T.DoubleType: "double", T.FloatType: "double",
    T.StringType: "string", T.BinaryType: "binary", T.ArrayType: "array", T.StructType: "object", T.MapType: "object", T.TimestampType: "datetime",
    T.TimestampNTZType: "datetime", T.DateType: "datetime", T.DecimalType: "decimal",
}


def type_name(v: Value) -> Value:
    if v.kind in ("missing", "null"):
        return _s(F.lit(v.kind))
    if v.kind != "var":
        return _s(F.when(v.col.isNull(), "missing").otherwise(_NAMES.get(type(v.type), "object")))
    told, rank = F.schema_of_variant(v.col), V.variant_rank(v.col)
    whole = V.get(v.col, "$", "long")
    small = whole.between(-(1 << 31), (1 << 31) - 1)
    out = F.when(v.col.isNull(), "missing")
    for r, name in ((1, "null"), (2, "bool"), (4, "string"), (5, "binary"), (6, "datetime"), (9, "array"), (10, "object")):
        out = out.when(rank == r, name)
    return _s(out.when(told == "BIGINT", F.when(small, "int").otherwise("long")).otherwise("double"))


def to_number(v: Value) -> Value:
    if v.kind == "bool":
        return _n(v.col.cast("double"))
    text = V.string(v)
    parsed = F.trim(text).try_cast("double") if v.kind in ("str", "var") else F.lit(None).cast("double")
    return _n(F.coalesce(V.number(v).cast("double"), parsed))


def contains(where: Value, what: Value) -> Value:
    found = V.elements(where)
    in_text = F.contains(V.string(where), V.string(what)) if where.kind in ("str", "var") else F.lit(None).cast("boolean")
    if found is None:
        return _b(in_text)
    many, read = found
    inside = F.coalesce(F.exists(many, lambda x: F.coalesce(V._plain("=", read(x), what), F.lit(False))), F.lit(False))
    return _b(F.when(many.isNotNull(), inside).otherwise(in_text))


#: Parts of a time, each by its name.
_PARTS = {
    "YEAR": F.year, "QUARTER": F.quarter, "MONTH": F.month, "WEEK": F.weekofyear, "DAY": F.dayofmonth, "DAYOFWEEK": lambda t: F.dayofweek(t) - 1,
    "DAYOFYEAR": F.dayofyear, "HOUR": F.hour, "MINUTE": F.minute, "SECOND": F.second,
}


def date_part(unit: str, v: Value) -> Value:
    """ISO weeks; days of the week from Sunday as 0."""
    return _n(_PARTS[unit.upper()](V.time(v)), T.IntegerType()) if unit.upper() in _PARTS else MISSING


def date_trunc(unit: str, v: Value) -> Value:
    """Start of a year, quarter, month, week (from Sunday), day or hour."""
    t = V.time(v)
    if unit.upper() == "WEEK":
        return Value(F.date_trunc("DAY", t) - F.make_dt_interval(F.dayofweek(t) - 1), "time", _TIME)
    return Value(F.date_trunc(unit, t), "time", _TIME) if unit.upper() in ("YEAR", "QUARTER", "MONTH", "DAY", "HOUR") else MISSING


def element(v: Value, index: Value) -> Value:
    found = V.elements(v)
    if found is None:
        return MISSING
    many, read = found
    i = V.number(index).cast("int")
    return read(F.when(i >= 0, F.get(many, i)).otherwise(F.try_element_at(many, F.when(i < 0, i))))


def keys(v: Value) -> Value:
    if v.kind == "obj" and isinstance(v.type, T.StructType):
        return Value(F.when(v.col.isNotNull(), F.array(*[F.lit(n) for n in v.type.names])), "arr", T.ArrayType(_STR))
    if v.kind == "obj":
        return Value(F.map_keys(v.col), "arr", T.ArrayType(_STR))
    if v.kind == "var":
        return Value(F.when(V.variant_rank(v.col) == 10, F.json_object_keys(F.to_json(v.col))), "arr", T.ArrayType(_STR))
    return MISSING


def _math(f):
    return lambda v: _n(f(V.number(v).cast("double")).cast("double"))


def _text(f):
    return lambda v: _s(f(V.string(v)))


def _pair(f):
    return lambda a, b: _b(f(V.string(a), V.string(b)))


#: Name: least and greatest count of arguments (None: any), and the function.
FUNCTIONS = {
    "LENGTH": (1, 1, length),
    "UPPER": (1, 1, _text(F.upper)),
    "LOWER": (1, 1, _text(F.lower)),
    "TRIM": (1, 1, _text(lambda s: F.regexp_replace(s, r"(?U)^\s+|\s+$", ""))),
    "SUBSTR": (2, 3, substr),
    "CONCAT": (1, None, concat),
    "REPLACE": (3, 3, replace),
    "SPLIT": (2, 2, split),
    "ABS": (1, 1, _math(F.abs)),
    "FLOOR": (1, 1, _math(F.floor)),
    "CEIL": (1, 1, _math(F.ceil)),
    "SQRT": (1, 1, _math(lambda x: F.when(x >= 0, F.sqrt(x)))),
    "ROUND": (1, 2, rounded),
    "POW": (2, 2, lambda a, b: _n(F.pow(V.number(a).cast("double"), V.number(b).cast("double")))),
    "COALESCE": (1, None, first_present),
    "IFNULL": (2, 2, first_present),
    "TYPEOF": (1, 1, type_name),
    "TOSTRING": (1, 1, lambda v: _s(F.coalesce(V.display(v), F.lit("")))),
    "TONUMBER": (1, 1, to_number),
    "TOINT": (1, 1, lambda v: _n(to_number(v).col.cast("long"), T.LongType())),
    "CONTAINS": (2, 2, contains),
    "STARTSWITH": (2, 2, _pair(F.startswith)),
    "ENDSWITH": (2, 2, _pair(F.endswith)),
    "NOW": (0, 0, lambda: Value(F.current_timestamp(), "time", _TIME)),
    "YEAR": (1, 1, lambda v: date_part("YEAR", v)),
    "MONTH": (1, 1, lambda v: date_part("MONTH", v)),
    "DAY": (1, 1, lambda v: date_part("DAY", v)),
    "HOUR": (1, 1, lambda v: date_part("HOUR", v)),
    "ARRAY_LENGTH": (1, 1, lambda v: length(Value(V.elements(v)[0], "arr", T.ArrayType(_STR))) if V.elements(v) else MISSING),
    "ELEMENT": (2, 2, element),
    "EXISTS": (1, 1, lambda v: _b(~v.missing)),
    "KEYS": (1, 1, keys),
}


def call(name: str, args: list[Value], literals: list) -> Value:
    """``literals``: the constant of each argument, or None."""
    if name in ("DATE_PART", "DATE_TRUNC"):
        if len(args) != 2 or not isinstance(literals[0], str):
            return MISSING
        return (date_part if name == "DATE_PART" else date_trunc)(literals[0], args[1])
    least, most, function = FUNCTIONS[name]
    return function(*args) if least <= len(args) and (most is None or len(args) <= most) else MISSING


def like_pattern(pattern: str) -> str:
    """A LIKE pattern with \\x for any x, as an anchored regular expression."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            i += 1
            out.append(re.escape(pattern[i]))
        else:
            out.append({"%": ".*", "_": "."}.get(c) or re.escape(c))
        i += 1
    return "(?s)^" + "".join(out) + "$"


def simple_like(pattern: str) -> str | None:
    """The pattern for Spark's own LIKE, which can be pushed down, if it has no odd escapes."""
    odd = re.search(r"\\(?![%_\\])", pattern)
    return None if odd else pattern


def plain_like(pattern: Column) -> Column:
    """A pattern from a column as Spark's LIKE takes it: \\x for any other x is x, and a last \\ stands for itself."""
    kept = F.regexp_replace(pattern, r"(?s)(\\[%_\\])|\\(.)", "$1$2")
    return F.regexp_replace(kept, r"(?s)^((?:[^\\]|\\.)*)\\$", r"$1\\\\")
