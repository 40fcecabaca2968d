"""Vector operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf


def as_double(vector: Column) -> Column:
    return vector.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - a.b / sqrt(a.a * b.b) in double precision; null where a norm is zero."""
    a, b = as_double(a), as_double(b)
    norms = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(norms > 0, 1 - dot(a, b) / norms)


def vector_literal(values) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def cosine_distance_to(vector: Column, query) -> Column:
    """The same as cosine_distance to a fixed query vector, whose norm is worked out once (added up in the same order)."""
    a, b = as_double(vector), vector_literal(query)
    own = 0.0
    for v in query:
        own = own + float(v) * float(v)
    norms = F.sqrt(dot(a, a) * F.lit(own))
    return F.when(norms > 0, 1 - dot(a, b) / norms)


def cosine_distance_blocks(query) -> callable:
    """The same for one query vector over Arrow batches; for tables large enough to pay for Python workers."""
    q = np.asarray(query, np.float64)
    qq = float(q @ q)

    @pandas_udf("double")
    def distance(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            x = np.stack(batch.to_numpy()).astype(np.float64)
            norms = np.sqrt((x * x).sum(axis=1) * qq)
            yield pd.Series(np.where(norms > 0, 1 - x @ q / np.where(norms > 0, norms, 1), np.nan)).where(norms > 0)

    return distance
