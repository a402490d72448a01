"""Vectors as arrays of float."""

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(F.transform(a, lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda s, x: s + x))


def cosine(a: Column, b: Column) -> Column:
    """Null if either vector is zero."""
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def literal(vector: list[float]) -> Column:
    return F.array(*(F.lit(float(x)) for x in vector))


def cosine_to(a: Column, vector: list[float]) -> Column:
    """Cosine to a fixed query vector, whose norm is taken once."""
    length = math.sqrt(sum(float(x) ** 2 for x in vector))
    return dot(a, literal(vector)) / F.nullif(norm(a) * F.lit(length), F.lit(0.0))


def is_zero(a: Column) -> Column:
    return F.forall(a, lambda x: x == 0)


def parse_vector(c: Column) -> Column:
    """'[x,y,...]' to an array of float; blank gives null."""
    return F.when(F.trim(F.regexp_replace(c, r"[\[\]]", "")) != "", F.from_json(c, "array<float>"))


def format_vector(a: Column) -> Column:
    return F.to_json(a)
