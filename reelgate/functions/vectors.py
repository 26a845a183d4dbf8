"""Arithmetic on embedding columns."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(vector: Column | str) -> Column:
    vector = F.col(vector) if isinstance(vector, str) else vector
    return vector.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def normalise(vector: Column) -> Column:
    """Unit length; a zero vector stays zero."""
    length = F.greatest(F.sqrt(dot(vector, vector)), F.lit(1e-12))
    return F.transform(vector, lambda x: x / length)


def mean_vector(vector: Column | str) -> Column:
    """Element-wise mean, combined on the map side like any other aggregate."""
    return vector_to_array(Summarizer.mean(array_to_vector(doubles(vector))))
