"""Vector arithmetic as column expressions over array columns, in double precision."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_float32(vector: Column) -> Column:
    return vector.cast("array<float>")


def literal(values: Sequence[float]) -> Column:
    """A query vector as a literal, rounded to float32 as stored vectors are."""
    return F.array(*[F.lit(float(v)) for v in values]).cast("array<float>").cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2_norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def normalize(v: Column) -> Column:
    """Unit vector; the zero vector stays zero."""
    return F.transform(F.array(F.struct(v.alias("v"), l2_norm(v).alias("n"))), lambda p: F.transform(p["v"], lambda x: F.coalesce(F.try_divide(x.cast("double"), p["n"]), F.lit(0.0))))[0]


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 where a side is zero, as the inner product of normalised vectors is."""
    return F.coalesce(F.try_divide(dot(a, b), l2_norm(a) * l2_norm(b)), F.lit(0.0))


def quantize_int8(v: Column) -> Column:
    """round(127 x / norm) of every element."""
    return F.transform(normalize(v), lambda x: F.round(x * 127).cast("tinyint"))


def int8_distance(a: Column, b: Column) -> Column:
    """Cosine distance of two quantized vectors, lower is nearer; 1 where a side is zero."""
    ints = "array<int>"
    return F.lit(1.0) - cosine(a.cast(ints), b.cast(ints))
