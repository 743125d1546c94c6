"""Vector functions on array columns, in double precision."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column, zero: float = 0.0) -> Column:
    """Cosine similarity; `zero` where a norm is at most 1e-12."""
    n, m = norm(a), norm(b)
    return F.when((n <= 1e-12) | (m <= 1e-12), F.lit(zero)).otherwise(dot(a, b) / (n * m))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine between 0 and 2; 1 where a norm is zero."""
    return F.greatest(F.lit(0.0), F.least(F.lit(2.0), 1.0 - cosine(a, b)))


def unit(a: Column) -> Column:
    n = norm(a)
    return F.when(n <= 1e-12, F.transform(a, lambda x: x.cast("double"))).otherwise(F.transform(a, lambda x: x.cast("double") / n))


def composite(text: Column, math: Column, alpha: float = 0.35) -> Column:
    """Unit text and formula blocks, weighted so that their dot products mix by alpha; the whole of unit length."""
    left, right = F.transform(unit(text), lambda x: x * (1 - alpha) ** 0.5), F.transform(unit(math), lambda x: x * alpha**0.5)
    return unit(F.concat(left, right))


def adaptive_cosine(a: Column, b: Column, alpha: float = 0.35, math_dims: int = 128) -> Column:
    """Of vectors that end in a formula block: the text's cosine if either block is empty, else the larger of it and the mix."""
    n = F.size(a) - math_dims
    text = cosine(F.slice(a, 1, n), F.slice(b, 1, n))
    x, y = F.slice(a, n + 1, math_dims), F.slice(b, n + 1, math_dims)
    return F.when((norm(x) <= 1e-12) | (norm(y) <= 1e-12), text).otherwise(F.greatest(text, (1 - alpha) * text + alpha * cosine(x, y)))


def largest_gap(a: Column, b: Column) -> Column:
    return F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))))


def encode_udf(kind: str = "float16"):
    """Array to base64 of its values in float16, float32 or float64, little-endian."""
    import base64

    @F.pandas_udf("string")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda v: None if v is None else base64.b64encode(np.asarray(v, dtype=np.dtype(kind).newbyteorder("<")).tobytes()).decode())

    return encode


def decode_udf(kind: str = "float16"):
    """The array of such a text."""
    import base64

    @F.pandas_udf("array<double>")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda v: None if v is None else np.frombuffer(base64.b64decode(v), np.dtype(kind).newbyteorder("<")).astype(float))

    return decode
