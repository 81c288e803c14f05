"""Vectors as arrays of numbers: expressions that stay in the JVM, and the codec of stored blobs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def as_double(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def normalize(a: Column) -> Column:
    """Unit length; the zero vector stays. The length is a field beside the vector, or it would be made for each element."""
    sized = F.array(F.struct(a.alias("v"), norm(a).alias("n")))
    return F.get(F.transform(sized, lambda r: F.transform(r["v"], lambda x: F.when(r["n"] > 0, x.cast("double") / r["n"]).otherwise(x.cast("double")))), F.lit(0))


def cosine(a: Column, b: Column) -> Column:
    """0 for vectors of unequal length or without length, within -1 and 1."""
    n = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (n > 0), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / n))).otherwise(0.0)


def to_blob(v: Column) -> Column:
    """Little-endian float32 bytes."""

    @F.pandas_udf("binary")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else np.asarray(x, dtype="<f4").tobytes())

    return run(v)


def from_blob(b: Column) -> Column:
    """Vector of a blob; an error if its length is no multiple of four."""

    @F.pandas_udf("array<float>")
    def run(s: pd.Series) -> pd.Series:
        def one(x):
            if x is None:
                return None
            if len(x) % 4:
                raise ValueError(f"a vector of {len(x)} bytes")
            return np.frombuffer(x, dtype="<f4")

        return s.map(one)

    return run(b)
