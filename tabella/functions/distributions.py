"""Tail probabilities of one test statistic, from the maths library Spark ships."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import SparkSession

SIGNIFICANT = 0.05

# The rational approximations of the normal quantile of Wichura (1988, AS 241), lowest power first:
# (numerator, denominator) near the middle, in the tails, and far out.
_NORMAL_QUANTILE = (
    (
        (3.3871328727963666080, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4, 4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3),
        (1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3, 2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3),
    ),
    (
        (1.42343711074968357734, 4.63033784615654529590, 5.76949722146069140550, 3.64784832476320460504, 1.27045825245236838258, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4),
        (1.0, 2.05319162663775882187, 1.67638483018380384940, 6.89767334985100004550e-1, 1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9),
    ),
    (
        (6.65790464350110377720, 5.46378491116411436990, 1.78482653991729133580, 2.96560571828504891230e-1, 2.65321895265761230930e-2, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7),
        (1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2, 7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15),
    ),
)


def normal_quantile(p: np.ndarray) -> np.ndarray:
    """The value below which a share ``p`` of a standard normal lies, for a whole array; nan outside 0 to 1 or at its ends."""
    p = np.asarray(p, float)
    with np.errstate(invalid="ignore", divide="ignore"):
        q = p - 0.5
        r = np.sqrt(-np.log(np.minimum(p, 1 - p)))
        at = (0.180625 - q * q, r - 1.6, r - 5.0)
        middle, tail, far = (np.polynomial.polynomial.polyval(x, up) / np.polynomial.polynomial.polyval(x, down) for x, (up, down) in zip(at, _NORMAL_QUANTILE))
        out = np.where(np.abs(q) <= 0.425, q * middle, np.sign(q) * np.where(r <= 5, tail, far))
    return np.where((p > 0) & (p < 1), out, np.nan)


def _dist(spark: SparkSession, name: str, *args):
    return getattr(spark._jvm.org.apache.commons.math3.distribution, name)(*args)


def _bad(*values) -> bool:
    return any(v is None or math.isnan(v) for v in values)


def t_two_sided(spark: SparkSession, t: float | None, dof: float | None) -> float | None:
    if _bad(t, dof) or dof <= 0:
        return None
    if math.isinf(t):
        return 0.0
    return min(1.0, 2 * _dist(spark, "TDistribution", float(dof)).cumulativeProbability(-abs(float(t))))


def chi2_upper(spark: SparkSession, x: float | None, dof: float | None) -> float | None:
    if _bad(x, dof) or dof <= 0:
        return None
    return max(0.0, 1 - _dist(spark, "ChiSquaredDistribution", float(dof)).cumulativeProbability(float(x)))


def f_upper(spark: SparkSession, x: float | None, d1: float | None, d2: float | None) -> float | None:
    if _bad(x, d1, d2) or d1 <= 0 or d2 <= 0:
        return None
    if math.isinf(x):
        return 0.0
    return max(0.0, 1 - _dist(spark, "FDistribution", float(d1), float(d2)).cumulativeProbability(float(x)))


def binomial_upper(spark: SparkSession, hits: int, trials: int) -> float:
    """P(at least ``hits`` successes) for a fair coin."""
    return 1.0 if hits <= 0 else 1 - _dist(spark, "BinomialDistribution", int(trials), 0.5).cumulativeProbability(int(hits) - 1)


def binomial_lower(spark: SparkSession, hits: int, trials: int) -> float:
    """P(at most ``hits`` successes) for a fair coin."""
    return _dist(spark, "BinomialDistribution", int(trials), 0.5).cumulativeProbability(int(hits))


def correlation_p(spark: SparkSession, r: float | None, n: int) -> float | None:
    """Two-sided p-value of a correlation from its t statistic."""
    if _bad(r) or n < 3:
        return None
    if abs(r) >= 1:
        return 0.0
    return t_two_sided(spark, r * math.sqrt((n - 2) / (1 - r * r)), n - 2)
