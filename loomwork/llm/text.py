"""Column expressions and byte helpers for whole texts.

A word is a run of characters other than space and U+0009 to U+000D, which is
also how ``bytes.split()`` divides UTF-8 text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Runs of blanks other than a single space.
_WIDE = r" [ \t-\r]+|[\t-\r][ \t-\r]*"
#: The same within a line.
_WIDE_IN_LINE = r"[ \t\x0b\f\r]{2,}|[\t\x0b\f\r]"
#: A character of a word.
WORD = r"[^ \t-\r]"


def bound(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, as Catalyst would else copy it into each use."""
    return F.transform(F.array(value), body)[0]


def squeezed(text: Column) -> Column:
    """The text's words with single spaces between; null stays null."""
    return F.trim(F.regexp_replace(text, _WIDE, " "))


def squeezed_lines(text: Column) -> Column:
    """The text with the blanks of each line made single spaces; line ends stay."""
    return F.regexp_replace(text, _WIDE_IN_LINE, " ")


def spaced_words(plain: Column) -> Column:
    """Number of words of a squeezed text."""
    return F.when(plain == "", 0).otherwise(F.length(plain) - F.length(F.replace(plain, F.lit(" "))) + 1).cast("long")


def word_array(text: Column) -> Column:
    """All words of a text in order; null gives an empty array."""
    return bound(squeezed(F.coalesce(text, F.lit(""))), lambda plain: F.when(plain == "", F.array().cast("array<string>")).otherwise(F.split(plain, " ")))


def word_count(text: Column) -> Column:
    """Number of words as a long; null gives 0."""
    return bound(squeezed(F.coalesce(text, F.lit(""))), spaced_words)


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo ``modulus``; a null id gives null."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus


def order_key(doc_id: Column, seed: int) -> Column:
    """A seeded 60-bit pseudo-random number for a document id; null ids share one."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")
