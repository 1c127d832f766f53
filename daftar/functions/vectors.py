"""Vector scalars over ``array<float>`` columns, all inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from daftar.functions.text import _col


def dot(left, right) -> Column:
    products = F.zip_with(
        _col(left), _col(right), lambda a, b: a.cast("double") * b.cast("double")
    )
    return F.aggregate(products, F.lit(0.0), lambda total, p: total + p)


def norm(vector) -> Column:
    return F.sqrt(dot(vector, vector))


def l2_normalize(vector) -> Column:
    """Unit vector; the zero vector stays as it is."""
    vector = _col(vector)
    length = F.coalesce(F.nullif(norm(vector), F.lit(0.0)), F.lit(1.0))
    return F.transform(vector, lambda x: x.cast("double") / length)


def check_dims(vector, dim: int) -> Column:
    """The vector itself, failing the job when a non-NULL one has another length."""
    vector = _col(vector)
    message = F.concat(
        F.lit(f"expected {dim} dimensions, got "), F.size(vector).cast("string")
    )
    bad = vector.isNotNull() & (F.size(vector) != dim)
    return F.when(bad, F.raise_error(message).cast("array<float>")).otherwise(vector)


def dims_reject_reason(vector, dim: int) -> Column:
    vector = _col(vector)
    return F.when(
        vector.isNotNull() & (F.size(vector) != dim),
        F.concat(F.lit("dimensions: "), F.size(vector).cast("string")),
    )


def sigmoid(x) -> Column:
    """Logistic function that never exponentiates a large positive number."""
    x = _col(x).cast("double")
    small = F.exp(-F.abs(x))
    return F.when(x >= 0, 1 / (1 + small)).otherwise(small / (1 + small))
