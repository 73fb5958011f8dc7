"""Upper tail of the F distribution, as a column expression.

The tail is an incomplete beta function. Written as
``front * integral of exp(-u + (b - 1) * log1p(r * (1 - exp(-u / a)))) du`` over
u > 0, its integrand only falls, so no digits cancel: tails far below the
smallest double relative to 1 keep their digits, and the work does not depend
on the degrees of freedom, which are numbers of rows here. The integral is a sum
over fixed points (double-exponential rule).
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from scoreloom.functions.probability import bind

# Points of the rule: u = exp(t - exp(-t)) for t from FIRST in STEPS steps of 1 / PER_UNIT.
FIRST, PER_UNIT, STEPS = -4.0, 16, 28 * 16
# Coefficients of 1/z, 1/z^3, ... in the logarithm of the gamma function.
STIRLING = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188, -691 / 360360)
SHIFT = 10
HALF_LOG_TWO_PI = 0.9189385332046727


def _correction(z: Column) -> Column:
    out = F.lit(0.0)
    for c in reversed(STIRLING):
        out = out / (z * z) + c
    return out / z


def _log_gamma(z: Column) -> Column:
    """Logarithm of the gamma function of a positive number."""
    far = z + SHIFT
    product = z
    for i in range(1, SHIFT):
        product = product * (z + i)
    # Far out the product would overflow; the shift is not needed there.
    at, less = F.when(z < SHIFT, far).otherwise(z), F.when(z < SHIFT, F.log(product)).otherwise(F.lit(0.0))
    return bind(at, lambda v: (v - 0.5) * F.log(v) - v + HALF_LOG_TWO_PI + _correction(v)) - less


def _log_gamma_step(z: Column, step: Column) -> Column:
    """log gamma(z + step) - log gamma(z) without the digits that large z cancel."""
    far = z + SHIFT
    less = F.lit(0.0)
    for i in range(SHIFT):
        less = less + F.log1p(step / (z + i))
    return (far - 0.5) * F.log1p(step / far) + step * F.log(far + step) - step + _correction(far + step) - _correction(far) - less


def _log_beta(a: Column, b: Column) -> Column:
    return bind(F.greatest(a, b), lambda high: bind(F.least(a, b), lambda low: _log_gamma(low) - _log_gamma_step(high, low)))


def _incomplete_beta(a: Column, b: Column, odds: Column) -> Column:
    """I_x(a, b) for odds x / (1 - x) at most a / b."""
    front = F.exp(-a * F.log1p(1 / odds) - (b - 1) * F.log1p(odds) - F.log(a) - _log_beta(a, b))

    def height(u: Column, slope: Column) -> Column:
        return u * slope * F.exp(-u + (b - 1) * F.log1p(-odds * F.expm1(-u / a)))

    def added(total: Column, i: Column) -> Column:
        t = F.lit(FIRST) + i / PER_UNIT
        return total + bind(t, lambda v: bind(F.exp(-v), lambda e: height(F.exp(v - e), 1 + e)))

    return front * F.aggregate(F.sequence(F.lit(0), F.lit(STEPS)), F.lit(0.0), added) / PER_UNIT


def f_tail(f: Column, d1: Column, d2: Column) -> Column:
    """P(F > f) with d1 and d2 degrees of freedom.

    NULL if a value is NULL or NaN or a degree is not positive; 1 for f of 0 or less.
    """
    known = F.coalesce(~F.isnan(f) & ~F.isnan(d1) & ~F.isnan(d2) & (d1 > 0) & (d2 > 0) & f.isNotNull(), F.lit(False))

    def tail(v: Column) -> Column:
        a, b = v["d2"] / 2, v["d1"] / 2
        odds = v["d2"] / (v["d1"] * v["f"])
        return F.when(v["f"] >= 1, _incomplete_beta(a, b, odds)).otherwise(1 - _incomplete_beta(b, a, 1 / odds))

    given = F.struct(f.alias("f"), d1.alias("d1"), d2.alias("d2"))
    return F.when(known & (f <= 0), 1.0).when(known & (f == float("inf")), 0.0).when(known, bind(given, tail))
