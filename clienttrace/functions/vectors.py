"""Functions on ``ARRAY`` vectors (higher-order functions, no Python)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row.

    A column used inside a lambda is evaluated for every element; passing it
    as the element of a one-item array binds it to a variable instead.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def l2_norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def l2_normalize(a: Column) -> Column:
    """Unit length; a zero vector stays zero."""
    return bind(l2_norm(a), lambda length: F.transform(
        a, lambda x: F.when(length > 0, x.cast("double") / length).otherwise(F.lit(0.0))))


def cosine_similarity(a: Column, b: Column) -> Column:
    """0 when either vector is zero."""
    return bind(l2_norm(a) * l2_norm(b), lambda scale: F.when(scale > 0, dot(a, b) / scale).otherwise(F.lit(0.0)))


def euclidean_distance(a: Column, b: Column) -> Column:
    """Distance over the dimensions both vectors have."""
    d = F.least(F.size(a), F.size(b))
    gaps = F.zip_with(F.slice(a, F.lit(1), d), F.slice(b, F.lit(1), d),
                      lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0)))
    return F.sqrt(total(gaps))


def log_sum_exp(a: Column) -> Column:
    return bind(F.array_max(a), lambda top: top + F.log(total(F.transform(a, lambda x: F.exp(x - top)))))


def log_softmax(a: Column) -> Column:
    return bind(log_sum_exp(a), lambda norm: F.transform(a, lambda x: x - norm))


def softmax(a: Column) -> Column:
    return bind(log_sum_exp(a), lambda norm: F.transform(a, lambda x: F.exp(x - norm)))


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def argmax_class(a: Column) -> Column:
    """Index of the largest value; the lowest index wins a tie."""
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def clip_and_renormalize(a: Column, low: float = 1e-6) -> Column:
    """Probabilities kept off 0 and 1, then scaled back to sum 1."""
    clipped = F.transform(a, lambda x: F.greatest(F.lit(low), F.least(F.lit(1.0 - low), x)))
    return bind(clipped, lambda c: bind(total(c), lambda mass: F.transform(c, lambda x: x / mass)))
