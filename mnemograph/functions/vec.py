"""Column expressions over array<float> vectors, computed as double.

Null vectors give null. A zero vector has norm 0 and stays zero when normalised.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mnemograph.functions import text

#: Cap of the distance's argument and floor of its divisors; fixed values.
EPS = 1e-8


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))


def sq_norm(v: Column) -> Column:
    return total(F.transform(doubles(v), lambda x: x * x))


def norm(v: Column) -> Column:
    return F.sqrt(sq_norm(v))


def l1_norm(v: Column) -> Column:
    return total(F.transform(doubles(v), F.abs))


def unit(v: Column) -> Column:
    return text.bound(norm(v), lambda n: F.when(n > 0, F.transform(doubles(v), lambda x: x / n)).otherwise(doubles(v)))


def scaled(v: Column, k: Column) -> Column:
    return F.transform(doubles(v), lambda x: x * k)


def cosine(a: Column, b: Column) -> Column:
    """0 if either vector is zero."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(F.lit(0.0))


def conformal_factor(v: Column, c: float = 1.0) -> Column:
    """2 / (1 - c|v|^2); null at or past the boundary."""
    rest = 1 - c * sq_norm(v)
    return F.when(rest > 0, 2 / rest)


def mobius_add(u: Column, v: Column, c: float = 1.0) -> Column:
    uv, uu, vv = dot(u, v), sq_norm(u), sq_norm(v)
    base = 1 + 2 * c * uv + c * c * uu * vv + EPS
    left, right = (1 + 2 * c * uv + c * vv) / base, (1 - c * uu) / base
    return F.zip_with(doubles(u), doubles(v), lambda x, y: left * x + right * y)


def poincare_distance(uu: Column, vv: Column, uv: Column, c: float = 1.0) -> Column:
    """From |u|^2, |v|^2 and <u,v>: 2/sqrt(c) * atanh(sqrt(c) * |(-u) + v|), the argument capped at 1 - EPS."""
    base = 1 - 2 * c * uv + c * c * uu * vv + EPS
    left, right = (1 - 2 * c * uv + c * vv) / base, (1 - c * uu) / base
    sq = F.greatest(left * left * uu - 2 * left * right * uv + right * right * vv, F.lit(0.0))
    return 2 / F.sqrt(F.lit(c)) * F.atanh(F.least(F.sqrt(F.lit(c)) * F.sqrt(sq), F.lit(1 - EPS)))


def ball_norm(radius: Column, c: float = 1.0) -> Column:
    """Euclidean norm of a point at hyperbolic radius."""
    return F.tanh(F.sqrt(F.lit(c)) * radius / 2) / F.sqrt(F.lit(c))


def to_ball(direction: Column, radius: Column, c: float = 1.0) -> Column:
    return scaled(unit(direction), ball_norm(radius, c))


def hyperbolic_radius(z: Column, c: float = 1.0) -> Column:
    return 2 / F.sqrt(F.lit(c)) * F.atanh(F.least(F.sqrt(F.lit(c)) * norm(z), F.lit(1 - EPS)))


def purity(v: Column, floor: float = 1e-6) -> Column:
    """|v|_2^2 / |v|_1^2, at least 1/d; `floor` for a zero vector."""
    one = l1_norm(v)
    return F.when(one < floor, F.lit(floor)).otherwise(F.greatest(sq_norm(v) / (one * one), 1.0 / F.size(v)))


def clipped_purity(v: Column, eps: float = 1e-10) -> Column:
    d = F.size(v)
    one = l1_norm(v)
    return F.when(one < eps, 1.0 / d).otherwise(F.least(F.greatest(sq_norm(v) / (one * one + eps), 1.0 / d), F.lit(1.0)))


def normalised_purity(v: Column, eps: float = 1e-10) -> Column:
    d = F.size(v)
    return F.least(F.greatest((clipped_purity(v, eps) - 1.0 / d) / (1 - 1.0 / d + eps), F.lit(0.0)), F.lit(1.0))


def entropy(v: Column, eps: float = 1e-10) -> Column:
    """Of |v| / |v|_1 in nats; 0 for a zero vector."""
    one = l1_norm(v)
    return F.when(one < eps, F.lit(0.0)).otherwise(-total(F.transform(doubles(v), lambda x: F.when(F.abs(x) / one > eps, F.abs(x) / one * F.ln(F.abs(x) / one)).otherwise(0.0))))


def similar(u: Column, v: Column, metric: str, bound: float) -> Column:
    """Cosine of at least `bound`, or hyperbolic distance of at most it; vectors of norm 1 or more are cut to 0.99."""
    if metric == "cosine":
        return cosine(u, v) >= bound
    return hyperbolic_near(sq_norm(u), sq_norm(v), dot(u, v), bound)


def hyperbolic_near(uu: Column, vv: Column, uv: Column, bound: float) -> Column:
    """Hyperbolic distance of at most `bound`, from squared norms and inner product; vectors of norm 1 or more are cut to 0.99."""
    s, t = (F.when(n >= 1, 0.99 / F.sqrt(n)).otherwise(1.0) for n in (uu, vv))
    a, b = s * s * uu, t * t * vv
    distance = F.acosh(1 + 2 * (a + b - 2 * s * t * uv) / ((1 - a) * (1 - b)))
    return 1 / (1 + distance) >= 1 / (1 + bound)
