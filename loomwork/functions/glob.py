"""Glob patterns (* ? [abc] [a-z] [^x] [!x] and backslash escapes) as anchored regular expressions."""

from __future__ import annotations

import re

_SPECIAL = re.compile(r"[*?\[\\]")


def literal(pattern: str) -> str | None:
    """The one text a pattern matches, if it has no special characters: then a lookup will do."""
    return None if _SPECIAL.search(pattern) else pattern


def regex(pattern: str) -> str:
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "\\" and i + 1 < len(pattern):
            i += 1
            out.append(re.escape(pattern[i]))
        elif c == "[" and (end := pattern.find("]", i + 2)) > 0:
            body, negated = pattern[i + 1 : end], ""
            if body[0] in "^!":
                body, negated = body[1:], "^"
            out.append("[" + negated + re.sub(r"([\\\[\]^&])", r"\\\1", body) + "]")
            i = end
        else:
            out.append(re.escape(c))
        i += 1
    return "(?s)^" + "".join(out) + "$"
