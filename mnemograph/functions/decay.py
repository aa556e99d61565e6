"""Particle properties and decay as column expressions.

Ages are seconds; gamma is per second. A mass of 0 or less decays at once.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mnemograph.functions import vec

#: Decay rate, forgetting threshold, curvature, distance weight; fixed defaults.
GAMMA, FORGET, CURVATURE, BETA = 1.0, 1e-3, 1.0, 1.0
MAX_RADIUS = 10000.0


def age_seconds(created: Column, now: Column) -> Column:
    return F.greatest((F.unix_micros(now.cast("timestamp")) - F.unix_micros(created.cast("timestamp"))) / 1e6, F.lit(0.0))


def radius_at(r0: Column, mass: Column, age: Column, gamma: float = GAMMA) -> Column:
    return F.when(mass <= 0, F.lit(0.0)).otherwise(r0 * F.exp(-gamma / mass * F.greatest(age, F.lit(0.0))))


def strength(radius: Column, r0: Column) -> Column:
    return F.when(r0 > 0, radius / r0).otherwise(F.lit(0.0))


def is_forgotten(radius: Column, threshold: float = FORGET) -> Column:
    return radius < threshold


def time_to_forget(r0: Column, mass: Column, gamma: float = GAMMA, threshold: float = FORGET) -> Column:
    """0 where the particle is forgotten already."""
    return F.when((mass <= 0) | (r0 <= threshold), F.lit(0.0)).otherwise(mass / gamma * F.ln(r0 / threshold))


def mass_of(intensity: Column, kappa: Column, alpha: float = 1.0, beta: float = 1.0) -> Column:
    return F.greatest(alpha * intensity + beta * F.ln(1 + kappa), F.lit(0.01))


def temperature_of(kappa: Column, t0: float = 1.0, floor: float = 1e-6) -> Column:
    return F.least(t0 / F.greatest(kappa, F.lit(floor)), F.lit(t0 / floor))


def linear_temperature(p: Column, low: float = 0.1, high: float = 1.0) -> Column:
    return low + (high - low) * (1 - p)


def speed(intensity: Column, p: Column, alpha: float = 0.5) -> Column:
    return intensity * (1 + alpha * p)


def time_constant(p: Column, gain: float, tau: float = 86400.0) -> Column:
    return tau * (1 + gain * p)


def modulus(intensity: Column, alpha: float = 50.0) -> Column:
    return 1 + alpha * intensity


def phase(modulus_: Column) -> Column:
    return F.when(modulus_ < 10, "gas").when(modulus_ >= 40, "solid").otherwise("liquid")


def chunk_mass(emotion: Column, surprisal: Column) -> Column:
    return F.least(F.greatest(0.7 * emotion + 0.3 * surprisal, F.lit(0.0)), F.lit(1.0))


def surprisal(perplexity: Column) -> Column:
    return F.least(F.ln(perplexity + 1) / F.ln(F.lit(1001.0)), F.lit(1.0))


def vector_quality(v: Column) -> Column:
    n = F.size(v)
    nonzero = F.size(F.filter(v, lambda x: F.abs(x) > 1e-6)) / n
    spread = -vec.total(F.transform(vec.doubles(v), lambda x: F.greatest(x, F.lit(1e-10)) * F.ln(F.greatest(x, F.lit(1e-10))))) / F.ln(n.cast("double"))
    return 0.3 * nonzero + 0.4 * F.array_max(vec.doubles(v)) + 0.3 * spread


def repaired_label(v: Column, size: int = 28, soft: bool = True) -> Column:
    """Padded or cut to `size`, clipped to [0, 1] (soft), or divided by its sum, uniform where that is 0."""
    cut = F.slice(F.concat(vec.doubles(v), F.array_repeat(F.lit(0.0), size)), 1, size)
    clipped = F.transform(cut, lambda x: F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)))
    if soft:
        return clipped
    whole = vec.total(clipped)
    return F.when(whole > 0, F.transform(clipped, lambda x: x / whole)).otherwise(F.array_repeat(F.lit(1.0 / size), size))


def core_norm(norm: Column, threshold: float = 3.0, ratio: float = 0.8) -> Column:
    return F.when(norm > threshold, (norm - threshold) * ratio + threshold).otherwise(F.lit(0.0))


def two_layer_norm(norm: Column, core: Column, age: Column, alpha: float = 0.1, vanish: float = 1e-3) -> Column:
    """core + (norm - core) * exp(-alpha * age); 0 once it vanishes."""
    left = core + (norm - core) * F.exp(-alpha * age)
    return F.when(left < vanish, F.lit(0.0)).otherwise(left)
