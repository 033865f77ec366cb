"""Vector maths as Catalyst higher-order expressions (stay in codegen, no UDF)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0), lambda acc, x: acc + x)


def norm(a) -> Column:
    return F.sqrt(F.aggregate(_c(a), F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def l2_normalise(a, eps: float = 1e-12) -> Column:
    """``v / max(||v||, eps)``."""
    n = norm(a)
    return F.transform(_c(a), lambda x: x.cast("double") / F.greatest(n, F.lit(eps)))


def cosine(a, b) -> Column:
    """Cosine similarity; NULL for a zero vector (never a hit)."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def euclidean(a, b) -> Column:
    """H30."""
    return F.sqrt(F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))),
                              F.lit(0.0), lambda acc, x: acc + x))


def manhattan(a, b) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: F.abs(x.cast("double") - y.cast("double"))),
                       F.lit(0.0), lambda acc, x: acc + x)


def sign(a) -> Column:
    """Sign of every component."""
    return F.transform(_c(a), lambda x: F.signum(x))


def adam_direction(g, m, v, beta1: float = 0.9, beta2: float = 0.999, eps: float = 1e-8) -> Column:
    """``(b1*m + (1-b1)*g) / sqrt(b2*v + (1-b2)*g^2 + eps)`` (eps inside the root, kept)."""
    gm = F.zip_with(_c(g), _c(m), lambda x, y: F.struct(x.alias("g"), y.alias("m")))
    gmv = F.zip_with(gm, _c(v), lambda s, z: (F.lit(beta1) * s["m"] + F.lit(1 - beta1) * s["g"])
                     / F.sqrt(F.lit(beta2) * z + F.lit(1 - beta2) * s["g"] * s["g"] + F.lit(eps)))
    return gmv


def flatten_nested(a) -> Column:
    """Nested vectors to one flat vector per row."""
    return F.flatten(_c(a))
