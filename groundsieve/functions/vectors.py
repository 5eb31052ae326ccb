"""Vectors as Column functions: the hashing embedder and L2 normalisation."""

from __future__ import annotations

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, functions as F

from groundsieve.config import HASH_DIMS
from groundsieve.functions import tokenblocks
from groundsieve.functions.spans import let
from groundsieve.functions.text import blank_tokens

# The kernels travel with the tasks instead of being imported there.
cloudpickle.register_pickle_by_value(tokenblocks)


def hash_codes(text: Column, dims: int = HASH_DIMS) -> Column:
    """The hashing embedder before summing up: per token a signed dimension number, from 1.

    The SHA-256 of the token gives both: the first four bytes the dimension,
    the parity of the fifth the sign. Summing the signs per dimension gives
    the vector, so this array is the vector in sparse, unsummed form.
    """
    def coded(words: pa.Array) -> pa.Array:
        return tokenblocks.hashed(words, dims)

    return F.arrow_udf(coded, "array<int>")(blank_tokens(F.lower(text)))


def summed_codes(codes: Column) -> Column:
    """The unit vector of hashed tokens as an array of (dim from 0, weight), zeros left out."""
    return F.arrow_udf(tokenblocks.summed, "array<struct<dim:int,weight:double>>")(codes)


def l2_normalize(vector: Column) -> Column:
    """The vector at length one; a zero vector stays as it is."""
    wide = F.transform(vector, lambda x: x.cast("double"))
    return let(wide, lambda v: let(
        F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x * x)),
        lambda norm: F.transform(v, lambda x: F.when(norm == 0, x).otherwise(x / norm)),
    ))


def cosine(left: Column, right: Column) -> Column:
    """Cosine of two vectors; zero if either is a zero vector."""
    def dot(a: Column, b: Column) -> Column:
        return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
                           F.lit(0.0), lambda acc, x: acc + x)

    return F.coalesce(
        F.try_divide(dot(left, right), F.sqrt(dot(left, left)) * F.sqrt(dot(right, right))),
        F.lit(0.0),
    )
