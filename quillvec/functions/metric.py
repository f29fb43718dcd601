"""Vector metrics as Columns over arrays.

`f32` folds in single precision from left to right, bit for bit what a scalar
loop over floats gives.  `f64` folds in double precision.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from quillvec.model import COSINE, DOT, L2, METRICS, InvalidArgument

KINDS = {"f32": "float", "f64": "double"}


def literal(vector: Sequence[float], precision: str = "f32") -> Column:
    """A query vector; one foldable literal."""
    return F.lit([float(x) for x in vector]).cast(f"array<{KINDS[precision]}>")


def fold(values: Column, kind: str) -> Column:
    return F.aggregate(values, F.lit(0).cast(kind), lambda a, x: (a + x).cast(kind))


def checked(vector: Column, dimensions: int, label: Column | None = None) -> Column:
    """`vector`, or an error that names the record if its length is wrong: `zip_with` would pad with nulls."""
    what = F.lit("stored vector dimension mismatch") if label is None else F.concat(F.lit("stored vector dimension mismatch for record "), label)
    return F.when(F.size(vector) == dimensions, vector).otherwise(F.raise_error(what))


def dot(a: Column, b: Column, precision: str = "f32") -> Column:
    kind = KINDS[precision]
    return fold(F.zip_with(a, b, lambda x, y: (x.cast(kind) * y.cast(kind)).cast(kind)), kind)


def norm(a: Column, precision: str = "f32") -> Column:
    return F.sqrt(dot(a, a, precision)).cast(KINDS[precision])


def cosine(a: Column, b: Column, precision: str = "f32") -> Column:
    """Zero if either vector is."""
    kind = KINDS[precision]
    size_a, size_b = norm(a, precision), norm(b, precision)
    return F.when((size_a == 0) | (size_b == 0), F.lit(0).cast(kind)).otherwise((dot(a, b, precision) / (size_a * size_b).cast(kind)).cast(kind))


def l2(a: Column, b: Column, precision: str = "f32") -> Column:
    kind = KINDS[precision]

    def square(x: Column, y: Column) -> Column:
        d = (x.cast(kind) - y.cast(kind)).cast(kind)
        return (d * d).cast(kind)

    return F.sqrt(fold(F.zip_with(a, b, square), kind)).cast(kind)


def value(metric: str, query: Column, vector: Column, precision: str = "f32") -> Column:
    if metric not in METRICS:
        raise InvalidArgument(f"unknown metric {metric!r}")
    return {DOT: dot, COSINE: cosine, L2: l2}[metric](query, vector, precision)


def plain_norm(vector: Sequence[float], precision: str = "f32") -> float:
    """`norm` of a vector that the driver holds, folded in the same order."""
    kind = np.float32 if precision == "f32" else np.float64
    total = kind(0)
    for x in np.asarray(vector, np.float32 if precision == "f32" else np.float64):
        total = kind(total + x * x)
    return float(kind(np.sqrt(np.float64(total))))


def to_query(metric: str, query: Sequence[float], vector: Column, precision: str = "f32", stored_norm: Column | None = None) -> Column:
    """`value` against one query vector, whose norm is taken once; a record's norm may be stored."""
    if metric != COSINE:
        return value(metric, literal(query, precision), vector, precision)
    kind = KINDS[precision]
    size = F.lit(plain_norm(query, precision)).cast(kind)
    own = norm(vector, precision) if stored_norm is None else stored_norm
    return F.when((size == 0) | (own == 0), F.lit(0).cast(kind)).otherwise((dot(literal(query, precision), vector, precision) / (size * own).cast(kind)).cast(kind))


def order(metric: str, value_col: str = "value", id_col: str = "id") -> list[Column]:
    """Best first, ties by id; among zeros the positive one is the greater, as IEEE total order has it."""
    v = F.col(value_col)
    negative_zero = (v == 0) & F.signum(v).cast("string").startswith("-")
    return [v.asc() if metric == L2 else v.desc(), negative_zero.desc() if metric == L2 else negative_zero.asc(), F.col(id_col).asc()]
