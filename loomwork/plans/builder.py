"""Queries built in Python: conditions that render to the dialect's text, and chained queries over a collection."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.functions import values as V
from loomwork.plans import documents
from loomwork.plans import syntax as S


@dataclass(frozen=True)
class Condition:
    """A condition's text with its parameters."""

    text: str
    parameters: dict = field(default_factory=dict)

    def __and__(self, other: Condition) -> Condition:
        return and_(self, other)

    def __or__(self, other: Condition) -> Condition:
        return or_(self, other)

    def __invert__(self) -> Condition:
        return not_(self)


_count = [0]
_NAME = r"[^\W\d][\w$]*"
_PATH = re.compile(rf"{_NAME}(?:\.{_NAME}|\[(?:-?\d+)?\])*")
_OUTPUT = re.compile(rf"(?:\*|{_PATH.pattern})(?:\s+(?:AS\s+)?{_NAME})?", re.IGNORECASE)


def checked(path: str) -> str:
    """The path, if it is one: names, indexes and [] joined by dots. Anything else could change the statement it goes into."""
    if not isinstance(path, str) or not _PATH.fullmatch(path):
        raise ValueError(f"not a path: {path!r}")
    return path


def _function(text: str) -> S.Output | None:
    """The output that a text is, if it is one function of the dialect: what its parentheses hold can't reach out of them.
    Parameters belong to conditions. Text at the end that is none of it, as a comment, would take in the x."""
    try:
        parser = S.Parser(f"{text}, x")
        first, *rest = parser.listed(parser.output)
    except ValueError:
        return None
    alone = parser.now.kind == "end" and rest == [S.Output(S.Path(("x",)), None, "x")]
    return first if alone and isinstance(first.expr, S.Call) and not any(isinstance(n, S.Parameter) for n in S.walk(first.expr)) else None


def _operand(text: str) -> str:
    """A path or a function, as COUNT(*) in a condition on groups."""
    found = _function(text) if isinstance(text, str) else None
    return text if found and found.alias is None else checked(text)


def _checked_output(output: str) -> str:
    """A path, * or a function, with or without a name."""
    if not isinstance(output, str) or not (_OUTPUT.fullmatch(output) or _function(output)):
        raise ValueError(f"not an output: {output!r}")
    return output


def _with(path: str, rest: str, *values) -> Condition:
    names = []
    for _ in values:
        _count[0] += 1
        names.append(f"p{_count[0]}")
    return Condition(f"{_operand(path)} {rest.format(*[f'@{n}' for n in names])}", dict(zip(names, values, strict=True)))


def _escaped(text: str) -> str:
    return text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


def eq(path: str, value) -> Condition:
    return _with(path, "= {}", value)


def ne(path: str, value) -> Condition:
    return _with(path, "!= {}", value)


def lt(path: str, value) -> Condition:
    return _with(path, "< {}", value)


def le(path: str, value) -> Condition:
    return _with(path, "<= {}", value)


def gt(path: str, value) -> Condition:
    return _with(path, "> {}", value)


def ge(path: str, value) -> Condition:
    return _with(path, ">= {}", value)


def in_(path: str, values: list) -> Condition:
    """No values: never true."""
    return _with(path, "IN {}", list(values)) if values else Condition("FALSE" if _operand(path) else "")


def between(path: str, low, high) -> Condition:
    return _with(path, "BETWEEN {} AND {}", low, high)


def like(path: str, pattern: str) -> Condition:
    return _with(path, "LIKE {}", pattern)


def startswith(path: str, text: str) -> Condition:
    return like(path, _escaped(text) + "%")


def endswith(path: str, text: str) -> Condition:
    return like(path, "%" + _escaped(text))


def contains(path: str, text: str) -> Condition:
    return like(path, "%" + _escaped(text) + "%")


def is_null(path: str) -> Condition:
    return Condition(f"{_operand(path)} IS NULL")


def is_missing(path: str) -> Condition:
    return Condition(f"{_operand(path)} IS MISSING")


def _joined(word: str, parts: tuple[Condition, ...]) -> Condition:
    text = f" {word} ".join(f"({p.text})" for p in parts)
    return Condition(text, {k: v for p in parts for k, v in p.parameters.items()})


def and_(*parts: Condition) -> Condition:
    return _joined("AND", parts)


def or_(*parts: Condition) -> Condition:
    return _joined("OR", parts)


def not_(part: Condition) -> Condition:
    return Condition(f"NOT ({part.text})", part.parameters)


@dataclass(frozen=True)
class Query:
    """A chained query. take is the least of all calls and skip their sum, in whatever order they come."""

    source: DataFrame
    name: str = "rows"
    outputs: tuple[str, ...] = ()
    conditions: tuple[Condition, ...] = ()
    keys: tuple[str, ...] = ()
    havings: tuple[Condition, ...] = ()
    orders: tuple[tuple[str, bool], ...] = ()
    unique: bool = False
    limit: int | None = None
    offset: int = 0

    def __post_init__(self):
        checked(self.name)

    def where(self, *conditions: Condition) -> Query:
        """After grouping, a condition on groups."""
        name = "havings" if self.keys else "conditions"
        return replace(self, **{name: getattr(self, name) + conditions})

    def select(self, *outputs: str) -> Query:
        return replace(self, outputs=tuple(map(_checked_output, outputs)))

    def group_by(self, *keys: str) -> Query:
        return replace(self, keys=tuple(map(_operand, keys)))

    def order_by(self, path: str, descending: bool = False) -> Query:
        return replace(self, orders=(*self.orders, (_operand(path), descending)))

    def distinct(self) -> Query:
        return replace(self, unique=True)

    def take(self, n: int) -> Query:
        return replace(self, limit=n if self.limit is None else min(n, self.limit))

    def skip(self, n: int) -> Query:
        return replace(self, offset=self.offset + n)

    def reverse(self) -> Query:
        if not self.orders:
            raise ValueError("reverse needs an order")
        return replace(self, orders=tuple((p, not d) for p, d in self.orders))

    @property
    def parameters(self) -> dict:
        return {k: v for c in (*self.conditions, *self.havings) for k, v in c.parameters.items()}

    def to_sql(self) -> str:
        parts = [f"SELECT {'DISTINCT ' if self.unique else ''}{', '.join(self.outputs) or '*'} FROM {self.name}"]
        if self.conditions:
            parts.append("WHERE " + (and_(*self.conditions).text if len(self.conditions) > 1 else self.conditions[0].text))
        if self.keys:
            parts.append("GROUP BY " + ", ".join(self.keys))
        if self.havings:
            parts.append("HAVING " + (and_(*self.havings).text if len(self.havings) > 1 else self.havings[0].text))
        if self.orders:
            parts.append("ORDER BY " + ", ".join(p + " DESC" * d for p, d in self.orders))
        if self.limit is not None:
            parts.append(f"LIMIT {self.limit}")
        if self.offset:
            parts.append(f"OFFSET {self.offset}")
        return " ".join(parts)

    def df(self) -> DataFrame:
        return documents.select(self.source, S.parse(self.to_sql()), self.parameters)

    def first(self):
        return self.take(1).df().first()

    def single(self):
        rows = self.take(2).df().collect()
        if len(rows) != 1:
            raise ValueError(f"{'no' if not rows else 'more than one'} row")
        return rows[0]

    def last(self):
        return self.reverse().take(1).df().first()

    def element_at(self, n: int):
        return self.skip(n).take(1).df().first()

    def count(self) -> int:
        return self.df().count()

    def any(self, *conditions: Condition) -> bool:
        return not self.where(*conditions).df().isEmpty()

    def all(self, condition: Condition) -> bool:
        """No row meets the opposite; rows for which the condition is unknown pass."""
        return not self.any(not_(condition))

    def _aggregate(self, name: str, path: str):
        return replace(self, outputs=(f"{name}({_operand(path)}) AS x",), orders=()).df().first().x

    def sum(self, path: str):
        return self._aggregate("SUM", path)

    def average(self, path: str):
        return self._aggregate("AVG", path)

    def min(self, path: str):
        return self._aggregate("MIN", path)

    def max(self, path: str):
        return self._aggregate("MAX", path)

    def select_many(self, path: str, alias: str = "item", *parents: str) -> DataFrame:
        """A row for each element of an array, with fields of its document; no array or an empty one gives none."""
        rows = replace(self, outputs=(), orders=(), limit=None, offset=0).df()
        scope = documents.Scope(rows)
        many, _ = V.elements(scope.value(S.expression(path)))
        held = [documents.output(scope.value(S.expression(p))).alias(p.split(".")[-1]) for p in parents]
        return rows.select(*held, F.explode(many).alias(alias))

    def any_element(self, path: str, test) -> DataFrame:
        """Documents of which one element meets all of a test at once."""
        rows = self.df()
        many, read = V.elements(documents.Scope(rows).value(S.expression(path)))
        return rows.filter(F.coalesce(F.exists(many, lambda x: F.coalesce(test(read(x)), F.lit(False))), F.lit(False)))
