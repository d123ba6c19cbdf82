"""Error function, normal distribution and Student t as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from perinuc.functions.scalars import col

_SERIES_TERMS = 40
_FRACTION_DEPTH = 60


def _gamma_ratio_series(x: Column) -> Column:
    """erf by its all-positive series 2/sqrt(pi) exp(-x^2) sum 2^n x^(2n+1) / (2n+1)!!."""
    x2 = x * x
    total = F.lit(0.0)
    for n in range(_SERIES_TERMS, 0, -1):  # nested form, one multiply-add per term
        total = (F.lit(1.0) + total) * (F.lit(2.0) * x2 / F.lit(2.0 * n + 1.0))
    return F.lit(2.0 / math.sqrt(math.pi)) * F.exp(-x2) * x * (F.lit(1.0) + total)


def _erfc_fraction(x: Column) -> Column:
    """erfc for x >= 2 by its continued fraction, evaluated from the inside out."""
    inner = x
    for n in range(_FRACTION_DEPTH, 0, -1):
        inner = x + F.lit(n / 2.0) / inner
    return F.exp(-x * x) / F.lit(math.sqrt(math.pi)) / inner


def _fold(x: Column, body) -> Column:
    """Evaluate ``body`` on a value bound once, so that deep formulas do not copy the argument's expression."""
    return F.transform(F.array(x), body)[0]


def erf(x: Column | str) -> Column:
    def body(v: Column) -> Column:
        a = F.abs(v)
        return F.signum(v) * F.when(a < 2.0, _gamma_ratio_series(a)).otherwise(F.lit(1.0) - _erfc_fraction(a))

    return _fold(col(x).cast("double"), body)


def erfc(x: Column | str) -> Column:
    def body(v: Column) -> Column:
        a = F.abs(v)
        tail = F.when(a < 2.0, F.lit(1.0) - _gamma_ratio_series(a)).otherwise(_erfc_fraction(a))
        return F.when(v >= 0, tail).otherwise(F.lit(2.0) - tail)

    return _fold(col(x).cast("double"), body)


def norm_cdf(x: Column | str) -> Column:
    return F.lit(0.5) * erfc(-col(x) / F.lit(math.sqrt(2.0)))


def two_sided_p(lr: Column | str) -> Column:
    """p-value of a likelihood ratio: 2 Phi(-sqrt(max(LR, 0)))."""
    return erfc(F.sqrt(F.greatest(col(lr), F.lit(0.0))) / F.lit(math.sqrt(2.0)))


def psf_weight(y, x, y0, x0, sigma: float, compat: bool = False) -> Column:
    """Share of a Gaussian spot that falls into a pixel.

    ``compat`` divides by 2 sigma^2 inside the error function instead of sqrt(2) sigma.
    """
    width = F.lit(2.0 * sigma * sigma if compat else math.sqrt(2.0) * sigma)

    def axis(p, p0) -> Column:
        d = col(p) - (col(p0) - F.lit(0.5))
        return F.lit(0.5) * (erf((d + F.lit(0.5)) / width) - erf((d - F.lit(0.5)) / width))

    return axis(y, y0) * axis(x, x0)


def harmonic(n: Column | str) -> Column:
    """Asymptotic harmonic number."""
    n = col(n).cast("double")
    n2 = n * n
    # Euler-Mascheroni constant and the first terms of the expansion.
    return (
        F.lit(0.57721566490153286)
        + F.log(n)
        + F.lit(0.5) / n
        - F.lit(1.0) / (F.lit(12.0) * n2)
        + F.lit(1.0) / (F.lit(120.0) * n2 * n2)
    )


def _log_gamma(z: Column) -> Column:
    """Stirling series after shifting the argument by eight."""
    shift = F.lit(0.0)
    for k in range(8):
        shift = shift + F.log(z + F.lit(float(k)))
    w = z + F.lit(8.0)
    w2 = w * w
    tail = F.lit(1.0 / 12.0) / w - F.lit(1.0 / 360.0) / (w2 * w) + F.lit(1.0 / 1260.0) / (w2 * w2 * w)
    return (w - F.lit(0.5)) * F.log(w) - w + F.lit(0.5 * math.log(2 * math.pi)) + tail - shift


def _log_gamma_step(a: Column) -> Column:
    """ln G(a + 1/2) - ln G(a); by its own series for large a, where the difference of two logs would cancel."""
    r = F.lit(1.0) / a
    r2 = r * r
    # The asymptotic series of the logarithm of the ratio.
    series = F.lit(0.5) * F.log(a) - r * (
        F.lit(1.0 / 8.0) - r2 * (F.lit(1.0 / 192.0) - r2 * (F.lit(1.0 / 640.0) - r2 * F.lit(17.0 / 14336.0)))
    )
    return F.when(a >= 20.0, series).otherwise(_log_gamma(a + 0.5) - _log_gamma(a))


def student_p(t: Column | str, df: Column | str, steps: int = 1000) -> Column:
    """Two-sided p of Student t, meant for a handful of result rows.

    After the substitution t = sqrt(df) tan(a) the tail is the integral of cos(a)^(df-1) from atan(|t| / sqrt(df)) to
    a right angle.  It is cut where it has fallen by forty powers of e, so that a tail of any size keeps its digits;
    Simpson's rule runs as an array fold.
    """
    t, df = F.abs(col(t).cast("double")), col(df).cast("double")
    low = F.atan(t / F.sqrt(df))
    reach = F.least(F.lit(12.0), F.lit(40.0) / F.greatest(t, F.lit(1e-9))) / F.sqrt(df)
    width = F.least(F.lit(math.pi / 2) - low, reach)
    log_scale = _log_gamma_step(df / 2.0) - F.lit(0.5 * math.log(math.pi))

    def body(s: Column) -> Column:
        h = s["width"] / F.lit(float(steps))

        def density(k: Column) -> Column:
            # cos^(df - 1) by its logarithm, which stays exact where the cosine is close to one
            sine = F.sin(s["low"] + k * h)
            return F.exp((s["df"] - 1.0) / 2.0 * F.log1p(-F.least(sine * sine, F.lit(1.0 - 1e-16))))

        area = F.aggregate(
            F.sequence(F.lit(0), F.lit(steps)),
            F.lit(0.0),
            lambda acc, k: acc
            + F.when((k == 0) | (k == steps), F.lit(1.0)).when(k % 2 == 1, F.lit(4.0)).otherwise(F.lit(2.0)) * density(k),
        )
        return F.least(F.lit(2.0) * F.exp(s["c"]) * area * h / F.lit(3.0), F.lit(1.0))

    bound = F.struct(low.alias("low"), width.alias("width"), df.alias("df"), log_scale.alias("c"))
    return F.transform(F.array(bound), body)[0]
