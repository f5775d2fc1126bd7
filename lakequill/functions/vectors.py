"""Vector functions as column expressions."""

from __future__ import annotations

import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

EXACT = 6  # scores are compared and ordered after rounding to so many places


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity, rounded; null where a vector is null, 0 where one has no length."""
    return F.round(F.when(a.isNotNull() & b.isNotNull(), F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(0.0))), EXACT)


def literal(values) -> Column:
    return F.array(*[F.lit(float(x)) for x in values])


def let(value: Column, f) -> Column:
    """f(value), with value worked out once: lambdas would otherwise work it out for each element."""
    return F.element_at(F.transform(F.array(value), f), 1)


def embed(text: Column, dim: int = 768) -> Column:
    """Deterministic stand-in for an embedding model: counts of words hashed by crc32, at unit length.

    Texts without words get the first unit vector.
    """
    at = F.transform(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)), lambda w: (F.crc32(w.cast("binary")) % dim).cast("int"))
    unit = F.concat(F.array(F.lit(1.0)), F.array_repeat(F.lit(0.0), dim - 1))
    count = lambda places: F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.size(F.filter(places, lambda x: x == i)).cast("double"))
    scaled = lambda c: let(F.sqrt(dot(c, c)), lambda norm: F.when(norm > 0, F.transform(c, lambda x: x / norm)).otherwise(unit))
    return let(let(at, count), scaled).cast("array<float>")


def hashed(text: Column, dim: int = 768) -> Column:
    """embed in double precision, by Arrow batches: work grows with the words, not with words times dimensions."""

    @F.pandas_udf("array<double>")
    def run(texts: pd.Series) -> pd.Series:
        words, find, places = {}, re.compile("[a-z0-9]+").findall, []
        for t in texts:
            counts = np.zeros(dim)
            for w in find((t or "").lower()):
                at = words.get(w)
                if at is None:
                    at = words[w] = zlib.crc32(w.encode()) % dim
                counts[at] += 1
            norm = np.sqrt(counts @ counts)
            if norm > 0:
                counts /= norm
            else:
                counts[0] = 1.0
            places.append(counts)
        return pd.Series(places)

    return run(text)
