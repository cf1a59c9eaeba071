"""Vector expressions over array columns, the cast to DOUBLE first; all inside Catalyst."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(a: Column) -> Column:
    return F.transform(a, lambda x: x.cast("double"))


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda t, x: t + x)


def bound(value: Column, body) -> Column:
    """``body(value)`` with the value computed once for each row, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def softmax(a: Column) -> Column:
    """exp(x - max) over its sum; maximum and sum are computed once for a vector."""
    shifted = lambda top: F.transform(a, lambda x: F.exp(x - top))
    return bound(F.array_max(a), lambda top: bound(shifted(top), lambda s: bound(total(s), lambda t: F.transform(s, lambda x: x / t))))


def log_softmax(a: Column) -> Column:
    rest = lambda top: F.log(F.aggregate(a, F.lit(0.0), lambda t, x: t + F.exp(x - top)))
    return bound(F.array_max(a), lambda top: bound(top + rest(top), lambda lse: F.transform(a, lambda x: x - lse)))


def rms_norm(a: Column, eps: float = 1e-5) -> Column:
    scale = F.sqrt(F.aggregate(a, F.lit(0.0), lambda t, x: t + x * x) / F.size(a) + F.lit(eps))
    return bound(scale, lambda s: F.transform(a, lambda x: x / s))


def l2_norm(a: Column) -> Column:
    return F.sqrt(total(F.transform(a, lambda x: x * x)))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def silu(x: Column) -> Column:
    return x * sigmoid(x)


def gelu(x: Column) -> Column:
    """The tanh form."""
    return 0.5 * x * (1 + F.tanh(F.lit(0.7978845608028654) * (x + 0.044715 * x * x * x)))


def relu(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0))
