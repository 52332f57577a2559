"""SQL over the KEYS relation: SELECT and DELETE with one table, AND and OR of equal precedence, two-valued logic."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.plans.syntax import SyntaxProblem

COLUMNS = {"key": "key", "type": "type", "size": "size", "len": "size", "length": "size", "ttl": "ttl", "value": "value", "val": "value"}
_NUMERIC = {"size", "ttl"}
_TOKEN = re.compile(r"\s*(?:(?P<text>'(?:[^']|'')*')|(?P<number>-?\d+(?:\.\d+)?)|(?P<name>\w+)|(?P<symbol><=|>=|<>|!=|[=<>(),*;]))")


class _Parser:
    def __init__(self, text: str):
        self.text, self.tokens, at = text, [], 0
        while text[at:].strip():
            m = _TOKEN.match(text, at)
            if not m:
                raise SyntaxProblem(text, at, "unexpected character")
            self.tokens.append((m.lastgroup, m[m.lastgroup], m.start(m.lastgroup)))
            at = m.end()
        self.tokens.append(("end", "", len(text)))
        self.i = 0

    def fail(self, what: str):
        raise SyntaxProblem(self.text, self.tokens[self.i][2], what)

    def take(self, *words: str) -> str | None:
        kind, text, _ = self.tokens[self.i]
        if kind in ("name", "symbol") and text.upper() in words:
            self.i += 1
            return text.upper()
        return None

    def need(self, word: str) -> None:
        if not self.take(word):
            self.fail(f"expected {word}")

    def column(self) -> str:
        kind, text, _ = self.tokens[self.i]
        if kind != "name" or text.lower() not in COLUMNS:
            self.fail("expected a column")
        self.i += 1
        return COLUMNS[text.lower()]

    def literal(self) -> str:
        kind, text, _ = self.tokens[self.i]
        if kind not in ("text", "number", "name"):
            self.fail("expected a value")
        self.i += 1
        return text[1:-1].replace("''", "'") if kind == "text" else text

    def number(self) -> int:
        text = self.literal()
        if not text.isdigit():
            self.fail("expected a whole number")
        return int(text)

    def condition(self, top: bool = True) -> Column:
        """Terms from left to right; ``top``: no OR has been met, so an equal key is compared as it is written."""
        start, only_and = self.i, top and not self._has_or()
        self.i = start
        out = self.term(only_and)
        while word := self.take("AND", "OR"):
            right = self.term(only_and)
            out = (out & right) if word == "AND" else (out | right)
        return out

    def _has_or(self) -> bool:
        depth = 0
        for kind, text, _ in self.tokens[self.i :]:
            depth += (text == "(") - (text == ")")
            if depth < 0 or kind == "end" or kind == "name" and text.upper() in ("ORDER", "LIMIT"):
                return False
            if kind == "name" and text.upper() == "OR" and depth == 0:
                return True
        return False

    def term(self, exact: bool) -> Column:
        if self.take("NOT"):
            return ~self.term(False)
        if self.take("("):
            out = self.condition(False)
            self.need(")")
            return out
        name = self.column()
        negated = bool(self.take("NOT"))
        as_text = F.col(name).cast("string")
        if self.take("LIKE"):
            pattern = self.literal().replace("\\", "\\\\")
            out = F.coalesce(as_text.like(pattern), F.lit(False))
        elif self.take("IN"):
            self.need("(")
            items = [self.literal()]
            while self.take(","):
                items.append(self.literal())
            self.need(")")
            out = F.coalesce(F.upper(as_text).isin([x.upper() for x in items]), F.lit(False))
        elif negated:
            self.fail("expected LIKE or IN")
        elif op := self.take("=", "!=", "<>", "<", "<=", ">", ">="):
            return compared(name, "!=" if op == "<>" else op, self.literal(), exact)
        else:
            self.fail("expected an operator")
        return ~out if negated else out


def compared(name: str, op: str, value: str, exact: bool) -> Column:
    """Numbers by value, texts without regard to case; of null, only != holds."""
    if name in _NUMERIC:
        left, right = F.col(name), F.lit(float(value))
    elif name == "key" and op == "=" and exact:
        left, right = F.col(name), F.lit(value)
    else:
        left, right = F.upper(F.col(name)), F.lit(value.upper())
    out = {"=": left == right, "!=": left != right, "<": left < right, "<=": left <= right, ">": left > right, ">=": left >= right}[op]
    return F.coalesce(out, F.lit(op == "!="))


def rendered_ttl() -> Column:
    """Seconds with at most three decimals, as text."""
    return F.regexp_replace(F.format_string("%.3f", "ttl"), r"\.?0+$", "")


def run(keys: DataFrame, text: str) -> DataFrame:
    """Rows of a SELECT, or of a DELETE the keys to delete."""
    p = _Parser(text)
    if p.take("DELETE"):
        columns = ["key"]
    else:
        p.need("SELECT")
        if p.take("*"):
            columns = ["key", "type", "size", "ttl", "value"]
        else:
            columns = [p.column()]
            while p.take(","):
                columns.append(p.column())
    p.need("FROM")
    p.need("KEYS")
    df = keys.filter(p.condition()) if p.take("WHERE") else keys
    if p.take("ORDER"):
        p.need("BY")
        name = p.column()
        by = F.coalesce(F.col("ttl"), F.lit(float("inf"))) if name == "ttl" else F.col(name)
        df = df.orderBy(by.desc() if p.take("DESC") else by.asc() if not p.take("ASC") else by.asc(), "key")
    if p.take("LIMIT"):
        n = p.number()
        df = (df.offset(p.number()) if p.take("OFFSET") else df).limit(n)
    p.take(";")
    if p.tokens[p.i][0] != "end":
        p.fail("unexpected text")
    return df.select(*dict.fromkeys(columns))
