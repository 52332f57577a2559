"""Lists, hashes and texts as columns: arrays, maps and strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def push_left(values: Column, *new: str) -> Column:
    """a, b, c are pushed one by one, so c comes first."""
    return F.concat(F.array(*[F.lit(x) for x in reversed(new)]), values)


def push_right(values: Column, *new: str) -> Column:
    return F.concat(values, F.array(*[F.lit(x) for x in new]))


def bounds(values: Column, start: int, stop: int) -> tuple[Column, Column]:
    """First place and length of an inclusive range with negative ends, cut to the list."""
    n = F.size(values)
    first = F.greatest(F.lit(start) if start >= 0 else n + start, F.lit(0))
    last = F.least(F.lit(stop) if stop >= 0 else n + stop, n - 1)
    return first, F.greatest(last - first + 1, F.lit(0))


def span(values: Column, start: int, stop: int) -> Column:
    first, length = bounds(values, start, stop)
    return F.slice(values, first + 1, length)


def at(values: Column, index: int) -> Column:
    return F.get(values, index) if index >= 0 else F.try_element_at(values, F.lit(index))


def put(values: Column, index: int, new: str) -> Column:
    """The list with one place replaced; null where there is no such place."""
    place = F.lit(index) if index >= 0 else F.size(values) + index
    changed = F.transform(values, lambda x, i: F.when(i == place, F.lit(new)).otherwise(x))
    return F.when((place >= 0) & (place < F.size(values)), changed)


def remove(values: Column, count: int, value: str) -> Column:
    """Without the first ``count`` equal elements, the last for a negative count, or all for 0."""
    if count == 0:
        return F.filter(values, lambda x: x != value)
    if count < 0:
        return F.reverse(remove(F.reverse(values), -count, value))
    start = F.struct(F.lit(0).alias("n"), F.slice(values, 1, 0).alias("kept"))

    def step(held: Column, x: Column) -> Column:
        gone = (x == value) & (held["n"] < count)
        return F.struct(
            (held["n"] + F.when(gone, 1).otherwise(0)).alias("n"), F.when(gone, held["kept"]).otherwise(F.concat(held["kept"], F.array(x))).alias("kept")
        )

    return F.aggregate(values, start, step, lambda held: held["kept"])


def positions(values: Column, value: str, *, rank: int = 1, count: int = 0, most: int = 0) -> Column:
    """Places of equal elements: from the ``rank``-th match, from the end if negative; at most ``count`` (0: all) among the first ``most``."""
    n = F.size(values)
    placed = F.transform(values, lambda x, i: F.struct(x.alias("x"), i.alias("i")))
    placed = placed if rank > 0 else F.reverse(placed)
    placed = F.slice(placed, 1, F.least(n, F.lit(most))) if most else placed
    found = F.transform(F.filter(placed, lambda p: p["x"] == value), lambda p: p["i"])
    return F.slice(found, abs(rank), F.lit(count) if count else F.greatest(F.size(found), F.lit(1)))


def move(source: Column, target: Column) -> tuple[Column, Column]:
    """The last element of one list moves to the front of another."""
    has = F.size(source) > 0
    return F.when(has, F.slice(source, 1, F.size(source) - 1)).otherwise(source), F.when(has, F.concat(F.slice(source, -1, 1), target)).otherwise(target)


def hash_set(fields: Column, new: Column) -> Column:
    """The map with the fields of another put over it."""
    kept = F.map_filter(fields, lambda k, _: ~F.map_contains_key(new, k))
    return F.map_concat(kept, new)


def hash_get(fields: Column, *names: str) -> Column:
    """Values by position, null where a field is absent."""
    return F.array(*[F.try_element_at(fields, F.lit(n)) for n in names])


def hash_delete(fields: Column, *names: str) -> Column:
    return F.map_filter(fields, lambda k, _: ~k.isin(*names))


def hash_increment(fields: Column, name: str, by: int | float) -> Column:
    """A field plus a number, absent as 0; a text that isn't a number raises."""
    kind = "long" if isinstance(by, int) else "double"
    new = F.coalesce(F.try_element_at(fields, F.lit(name)).cast(kind), F.lit(0).cast(kind)) + by
    return hash_set(fields, F.create_map(F.lit(name), new.cast("string")))


def text_length(value: Column) -> Column:
    """Bytes of the UTF-8 form."""
    return F.octet_length(value)


def text_range(value: Column, start: int, stop: int) -> Column:
    """An inclusive range of bytes with negative ends, as text; a cut within a character gives null."""
    raw = value.cast("binary")
    n = F.octet_length(value)
    first = F.greatest(F.lit(start) if start >= 0 else n + start, F.lit(0))
    last = F.least(F.lit(stop) if stop >= 0 else n + stop, n - 1)
    part = F.substring(raw, first + 1, F.greatest(last - first + 1, F.lit(0)))
    return F.when(F.is_valid_utf8(part), part.cast("string"))


def text_overwrite(value: Column, offset: int, new: str) -> Column:
    """Bytes from an offset replaced, with zero bytes up to it if the text is shorter; broken characters give null."""
    raw, patch = F.coalesce(value, F.lit("")).cast("binary"), new.encode()
    padded = F.rpad(raw, F.greatest(F.octet_length(raw), F.lit(offset)), F.lit(b"\0")) if offset else raw
    out = F.concat(F.substring(padded, 1, offset), F.lit(patch), F.substring(padded, offset + len(patch) + 1, 1 << 30))
    return F.when(F.is_valid_utf8(out), out.cast("string"))
