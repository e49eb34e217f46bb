"""Vector functions: cosine as a Column expression, and the little-endian float codec."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _doubles(v: Column | str) -> Column:
    return (F.col(v) if isinstance(v, str) else v).cast("array<double>")


def norm(v: Column | str) -> Column:
    return F.sqrt(F.aggregate(_doubles(v), F.lit(0.0), lambda s, x: s + x * x))


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(_doubles(a), _doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine similarity; 0 if either norm is 0. With vectors of different lengths: null."""
    na, nb = norm(a), norm(b)
    return F.when((na == 0) | (nb == 0), F.lit(0.0)).otherwise(dot(a, b) / F.nullif(na * nb, F.lit(0.0)))


def similarity_of_distance(distance: Column | str) -> Column:
    return F.lit(1.0) - (F.col(distance) if isinstance(distance, str) else distance)


@F.pandas_udf(T.BinaryType())
def embedding_to_bytes(v: pd.Series) -> pd.Series:
    """Little-endian 32-bit floats, one after the other."""
    return v.map(lambda x: None if x is None else np.asarray(x, "<f4").tobytes())


@F.pandas_udf(T.ArrayType(T.FloatType()))
def bytes_to_embedding(b: pd.Series) -> pd.Series:
    """Null where the length is no multiple of four; empty bytes give an empty vector."""
    return b.map(lambda x: None if x is None or len(x) % 4 else np.frombuffer(x, "<f4").tolist())
