"""Array-of-number functions on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def logits(x: Column, weights: list[list[float]], bias: list[float]) -> Column:
    """W x + b for a small fixed model."""
    return F.array(*(dot(F.array(*map(F.lit, row)), x) + F.lit(float(b)) for row, b in zip(weights, bias)))


def softmax(x: Column) -> Column:
    """Shifted by the maximum, so it never overflows."""
    return let(let(x, lambda a: F.transform(a, lambda v: F.exp(v - F.array_max(a)))), lambda e: let(F.aggregate(e, F.lit(0.0), lambda s, v: s + v), lambda t: F.transform(e, lambda v: v / t)))


def argmax(x: Column) -> Column:
    """First place of the maximum, from 0."""
    return let(x, lambda a: (F.array_position(a, F.array_max(a)) - 1).cast("int"))


def cross_entropy(p: Column) -> Column:
    return -F.log(F.greatest(F.lit(1e-8), p))


def sound(v: Column, dim: int) -> Column:
    """Whether v has dim finite numbers."""
    return v.isNotNull() & (F.size(v) == dim) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def guard(v: Column, dim: int) -> Column:
    """v, or an error that stops the query if it is not sound."""
    return F.when(F.assert_true(sound(v, dim), F.lit(f"expected {dim} finite numbers")).isNull(), v)


def clamp(x: Column, low, high) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def template(act: Column, texts: list[str]) -> Column:
    """Text of an action; numbers outside the list go to its ends."""
    return F.element_at(F.array(*map(F.lit, texts)), (clamp(act, 0, len(texts) - 1) + 1).cast("int"))


def template_index(text: Column, texts: list[str]) -> Column:
    """Action of a text, 0 if it is none."""
    return F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, texts)), text), F.lit(0)) - 1, F.lit(0)).cast("int")


def gaussian(u1: Column, u2: Column) -> Column:
    """Box-Muller over two uniform columns."""
    return F.sqrt(-2.0 * F.log(u1)) * F.sin(2.0 * F.pi() * u2)


def draw(probabilities: Column, u: Column) -> Column:
    """First place, from 0, where the running sum reaches u (the last place if rounding never lets it)."""
    def pick(p: Column) -> Column:
        run = lambda i: F.aggregate(F.slice(p, F.lit(1), i + 1), F.lit(0.0), lambda s, x: s + x)
        below = F.size(F.filter(F.transform(p, lambda x, i: run(i)), lambda c: c < u))
        return F.least(below, F.size(p) - 1)

    return let(probabilities, pick)


def scale(v: Column) -> Column:
    """Feature scaling hook; the plain one leaves features as they are."""
    return v
