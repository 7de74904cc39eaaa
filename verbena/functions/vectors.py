"""Vector expressions on ARRAY<DOUBLE> columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """``body(value)`` with the value evaluated once, also where the body uses it inside a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def l2_normalised(v: Column, zero: str = "zero") -> Column:
    """The vector over its norm. A vector of norm 0 becomes zeros (``zero``) or null (``null``)."""
    other = F.transform(v, lambda x: x * 0) if zero == "zero" else F.lit(None).cast("array<double>")
    return let(norm(v), lambda n: F.when(n > 0, F.transform(v, lambda x: x / n)).otherwise(other))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - F.try_divide(dot(a, b), norm(a) * norm(b))


def distance(a: Column, b: Column, metric: str) -> Column:
    if metric == "euclidean":
        return euclidean(a, b)
    if metric == "cosine":
        return cosine_distance(a, b)
    raise ValueError(f"unknown metric: {metric}")


def pool(states: Column, mask: Column, how: str) -> Column:
    """Pool ARRAY<ARRAY<DOUBLE>> token states with a 0/1 mask: mean (masked), max (masked out as -1e9) or cls (the first)."""
    if how == "cls":
        return states[0]
    pairs = F.arrays_zip(states.alias("s"), mask.alias("m"))
    zeros = F.transform(states[0], lambda x: x * 0)
    if how == "mean":
        sums = F.aggregate(pairs, zeros, lambda acc, p: F.zip_with(acc, p["s"], lambda a, x: a + x * p["m"]))
        n = F.greatest(F.aggregate(mask, F.lit(0.0), lambda a, m: a + m), F.lit(1e-9))
        return let(n, lambda d: F.transform(sums, lambda x: x / d))
    if how == "max":
        low = F.transform(states[0], lambda x: x * 0 - 1e9)
        return F.aggregate(pairs, low, lambda acc, p: F.zip_with(acc, p["s"], lambda a, x: F.greatest(a, F.when(p["m"] > 0, x).otherwise(F.lit(-1e9)))))
    raise ValueError(f"unknown pooling: {how}")


def confidence(z: Column) -> Column:
    """Class scores -> probabilities: min-max with a margin of 1e-10, then summing to 1."""
    scaled = let(F.array_min(z) - 1e-10, lambda low: let(F.array_max(z) - low, lambda width: F.transform(z, lambda x: (x - low) / width)))
    return let(scaled, lambda u: let(total(u), lambda t: F.transform(u, lambda x: x / t)))


def entropy(p: Column) -> Column:
    return -total(F.transform(p, lambda x: F.when(x > 0, x * F.ln(x)).otherwise(0.0)))


def argmax(p: Column) -> Column:
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def smoothed_cross_entropy(logits: Column, label: Column, epsilon: float) -> Column:
    """Label-smoothing cross-entropy of one row: the target has (1 - eps), every other class eps / (C - 1)."""

    def loss(top: Column) -> Column:
        log_z = top + F.ln(total(F.transform(logits, lambda x: F.exp(x - top))))
        bias = F.lit(epsilon) / (F.size(logits) - 1)
        return let(log_z, lambda z: (F.size(logits) * z - total(logits)) * bias + (z - F.get(logits, label)) * (F.lit(1 - epsilon) - bias))

    return let(F.array_max(logits), loss)
