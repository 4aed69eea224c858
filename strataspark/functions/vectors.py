"""Vector functions over array columns, in doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column | str) -> Column:
    return (F.col(v) if isinstance(v, str) else v).cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def l2_normalize(v: Column) -> Column:
    """Divided by the norm, or by 1e-12 if that is larger."""
    n = F.greatest(norm(v), F.lit(1e-12))
    return F.transform(v, lambda x: x / n)


def l1(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + F.abs(x))


def sigmoid(x: Column) -> Column:
    """Without overflow at either end."""
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))


def softplus(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def softmax(v: Column) -> Column:
    top = F.array_max(v)
    e = F.transform(v, lambda x: F.exp(x - top))
    total = F.aggregate(e, F.lit(0.0), lambda s, x: s + x)
    return F.transform(e, lambda x: x / total)


def argmax(v: Column) -> Column:
    """The first position (from 0) of the largest element."""
    return (F.array_position(v, F.array_max(v)) - 1).cast("int")


def safe_divide(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(a.cast("double") / b)


def mean_by(df, keys: list[str], vec: str, out: str = "embedding"):
    """The mean vector of each group: sums by position are combined in the tasks first. Keys keep their names."""
    flat = df.select(*keys, F.posexplode(doubles(vec)).alias("__pos", "__x"))
    means = flat.groupBy(*keys, "__pos").agg(F.avg("__x").alias("__x"))
    return means.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("__pos", "__x"))), lambda s: s["__x"]).alias(out))
