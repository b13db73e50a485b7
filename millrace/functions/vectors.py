"""Vector expressions over array columns, in double precision."""

from __future__ import annotations

import math
import struct
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col

EPSILON = 1e-12


def _sum(c: Column) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column | str, b: Column | str) -> Column:
    return _sum(F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column | str) -> Column:
    return F.sqrt(_sum(F.transform(col(a), lambda x: x.cast("double") * x.cast("double"))))


def normalize(a: Column | str) -> Column:
    """Unit length; a zero vector stays as it is."""
    held = F.transform(F.array(col(a)), lambda v: F.struct(v.alias("v"), norm(v).alias("n")))  # the vector and its norm, once
    part = lambda h: F.transform(h["v"], lambda x: F.when(h["n"] > 0, x.cast("double") / h["n"]).otherwise(x.cast("double")))
    return F.transform(held, part)[0]


def cosine(a: Column | str, query: Column, query_norm: float) -> Column:
    scale = norm(a) * F.lit(max(query_norm, EPSILON))
    return F.when(scale > 0, dot(a, query) / scale).otherwise(F.lit(0.0))


def rescale(score: Column | str) -> Column:
    """[-1, 1] to [0, 1]."""
    return (col(score) + 1.0) / 2.0


def is_finite(c: Column | str) -> Column:
    return ~F.isnan(col(c)) & (F.abs(col(c)) != float("inf"))


def literal(vector: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in vector])


def unit(vector: list[float]) -> list[float]:
    """``normalize`` for one vector outside a plan: squares are added in order,
    as there (``sum`` compensates, which can differ in the last bit)."""
    n = math.sqrt(reduce(lambda a, x: a + x * x, vector, 0.0))
    return [x / n for x in vector] if n > 0 else [float(x) for x in vector]


def digest_vector(text: Column | str, dim: int) -> Column:
    """Deterministic embedding: bytes of SHA-256 over 255, repeated up to ``dim``."""
    place = F.sequence(F.lit(0), F.lit(dim - 1))
    byte = lambda h: F.transform(place, lambda i: F.conv(F.substring(h, 2 * (i % 32) + 1, F.lit(2)), 16, 10).cast("double") / 255)
    return F.transform(F.array(F.sha2(col(text), 256)), byte)[0]  # one digest a row


def pack_f32(vector: list[float]) -> bytes:
    return struct.pack(f"<{len(vector)}f", *vector)


def unpack_f32(raw: bytes) -> list[float]:
    if len(raw) % 4:
        raise ValueError("packed vector length must be a multiple of 4")
    return list(struct.unpack(f"<{len(raw) // 4}f", raw))
