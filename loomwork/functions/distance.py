"""Distances and vector helpers as column expressions over arrays, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Metrics whose larger values are nearer.
LARGER = {"ip", "cosine"}


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def _paired(a: Column, b: Column, f) -> Column:
    return F.zip_with(a, b, lambda x, y: f(x.cast("double"), y.cast("double")))


def inner_product(a: Column, b: Column) -> Column:
    return _sum(_paired(a, b, lambda x, y: x * y))


def l2_squared(a: Column, b: Column) -> Column:
    return _sum(_paired(a, b, lambda x, y: (x - y) * (x - y)))


def l1(a: Column, b: Column) -> Column:
    return _sum(_paired(a, b, lambda x, y: F.abs(x - y)))


def linf(a: Column, b: Column) -> Column:
    return F.array_max(_paired(a, b, lambda x, y: F.abs(x - y)))


def norm(a: Column) -> Column:
    return F.sqrt(inner_product(a, a))


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(inner_product(a, b), norm(a) * norm(b))


METRICS = {"l2": l2_squared, "ip": inner_product, "l1": l1, "linf": linf, "cosine": cosine}


def normalized(a: Column) -> Column:
    """Unit length; a zero vector stays as it is."""
    return F.transform(F.array(norm(a)), lambda n: F.when(n > 0, F.transform(a, lambda x: x.cast("double") / n)).otherwise(a.cast("array<double>")))[0]


def axpy(a: float, x: Column, y: Column) -> Column:
    return F.zip_with(x, y, lambda p, q: F.lit(float(a)) * p + q)


def binarized(a: Column, threshold: float = 0.0) -> Column:
    """Bits of components above a threshold, 64 to a long, lowest first."""
    n = F.ceil(F.size(a) / 64).cast("int")
    word = lambda w: F.aggregate(
        F.transform(F.slice(a, w * 64 + 1, F.lit(64)), lambda x, i: F.when(x > threshold, F.expr("1L")).otherwise(F.expr("0L")) * F.lit(1)),
        F.struct(F.expr("0L").alias("v"), F.lit(0).alias("i")),
        lambda s, bit: F.struct(s["v"].bitwiseOR(F.call_function("shiftleft", bit.cast("long"), s["i"])).alias("v"), (s["i"] + 1).alias("i")),
        lambda s: s["v"],
    )
    return F.transform(F.sequence(F.lit(0), n - 1), word)


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two arrays of longs."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
