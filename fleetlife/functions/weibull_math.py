"""Weibull expectation and divergences as Column expressions.

Spark has no gamma function, so it is written with the Lanczos series (g = 7, nine terms), which holds to about 1e-14.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Lanczos coefficients for g = 7, and the Euler-Mascheroni constant.
LANCZOS_G = 7
LANCZOS = (
    0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059,
    12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7,
)
EULER_GAMMA = 0.5772156649015329


def log_gamma(x: Column) -> Column:
    """Natural logarithm of gamma for x >= 0.5."""
    z = x - 1
    series = F.lit(LANCZOS[0])
    for i, c in enumerate(LANCZOS[1:], start=1):
        series = series + F.lit(c) / (z + i)
    t = z + (LANCZOS_G + 0.5)
    return F.lit(0.5 * math.log(2 * math.pi)) + (z + 0.5) * F.log(t) - t + F.log(series)


def gamma(x: Column) -> Column:
    return F.exp(log_gamma(x))


def expectation(scale: Column, shape: Column) -> Column:
    """Mean lifetime: scale * gamma(1 + 1 / shape)."""
    return scale * gamma(1 + 1 / shape)


def divergence(scale: Column, shape: Column, true_scale: Column, true_shape: Column) -> Column:
    """Kullback-Leibler divergence between two Weibull laws (arXiv:1310.3713)."""
    return (
        F.log(true_shape) - true_shape * F.log(true_scale) - F.log(shape) + shape * F.log(scale)
        + (true_shape - shape) * (F.log(true_scale) - F.lit(EULER_GAMMA) / true_shape)
        + F.pow(true_scale / scale, shape) * gamma(shape / true_shape + 1) - 1
    )


def shape_divergence(shape: Column, true_shape: Column) -> Column:
    """Divergence when only the shape differs."""
    ratio = shape / true_shape
    return gamma(ratio + 1) - 1 - F.log(ratio) - (1 - ratio) * F.lit(EULER_GAMMA)


def scale_divergence(scale: Column, true_scale: Column, shape: Column) -> Column:
    """Divergence when only the scale differs."""
    ratio = true_scale / scale
    return F.pow(ratio, shape) - shape * F.log(ratio) - 1
