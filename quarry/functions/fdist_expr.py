"""F-distribution upper tail as a Spark Column expression (no Python worker).

``P(F > f) = I_x(d2/2, d1/2)`` with ``x = d2 / (d2 + d1 f)``, by the continued fraction
of the incomplete beta function.  Its factor in front is built without differences
of large numbers, so p-values keep their accuracy at 1e12 degrees of freedom: the
ratio of gamma functions from Stirling's series with ``log1p``, and ``1 - x`` and
``log x`` from ``d1 f / d2`` directly.  The fraction runs as many steps as the
smaller parameter can need; if it has not converged then, the job fails.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Stirling's series of ln Gamma, coefficients of 1/z, 1/z^3, ...
STIRLING = [1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188, -691 / 360360]
#: From here on the series is exact to double precision; smaller arguments are raised to it.
LARGE = 16
_STEPS, _TOLERANCE = 200, 1e-10


def _series(z: Column) -> Column:
    inv = 1.0 / z
    out = F.lit(0.0)
    for c in reversed(STIRLING):
        out = out * inv * inv + F.lit(c)
    return out * inv


def _raised(z: Column) -> Column:
    """ln of z (z + 1) ... (z + LARGE - 1)."""
    out = z
    for k in range(1, LARGE):
        out = out * (z + float(k))
    return F.log(out)


def lgamma(z: Column) -> Column:
    """ln Gamma(z) for z > 0."""
    def large(w: Column) -> Column:
        return (w - 0.5) * F.log(w) - w + 0.5 * math.log(2 * math.pi) + _series(w)

    return F.when(z >= LARGE, large(z)).otherwise(large(z + float(LARGE)) - _raised(z))


def _lgamma_step(a: Column, b: Column) -> Column:
    """ln Gamma(a + b) - ln Gamma(a)."""
    large = (a - 0.5) * F.log1p(b / a) + b * F.log(a + b) - b + _series(a + b) - _series(a)
    return F.when(a >= LARGE, large).otherwise(lgamma(a + b) - lgamma(a))


def _let(values: dict[str, Column], body) -> Column:
    """``body`` on names for ``values``, each computed once."""
    return F.transform(F.array(F.struct(*[v.alias(n) for n, v in values.items()])), body)[0]


def _beta_fraction(q: Column) -> Column:
    """I_x(a, b) B(a, b) / (x^a y^b) for q's a, b > 1, x, y = 1 - x and excess = a - (a + b) x >= 0.

    The continued fraction in terms of y and the excess, both known without
    cancellation, so it stays accurate where x is next to 1 (Didonato and Morris)."""
    a, b, x, y = (q[n] for n in "abxy")
    c, ratio, one = 1.0 + q["excess"], b / a, 1.0 + 1.0 / a
    names = ("p", "s", "an", "bn", "an1", "bn1", "r", "last")

    def state(*values):
        return F.struct(*[v.alias(n) for n, v in zip(names, values)])

    def step(st, k):
        n = k.cast("double")

        def coefficients(v):
            alpha = st["p"] * (st["p"] + ratio) * v["e"] * v["e"] * v["w"] * x
            beta = n + v["w"] / st["s"] + (1.0 + v["t"]) / (one + 2.0 * v["t"]) * (c + n * (1.0 + y))
            return F.struct((alpha * st["an"] + beta * st["an1"]).alias("an"), (alpha * st["bn"] + beta * st["bn1"]).alias("bn"), (1.0 + v["t"]).alias("p"))

        def advance(v):
            return state(v["p"], st["s"] + 2.0, st["an1"] / v["bn"], st["bn1"] / v["bn"], v["an"] / v["bn"], F.lit(1.0), v["an"] / v["bn"], st["r"])

        new = _let({"v": _let({"t": n / a, "w": n * (b - n) * x, "e": a / st["s"]}, coefficients)}, lambda z: advance(z["v"]))
        return F.when(F.abs(st["r"] - st["last"]) <= 1e-16 * st["r"], st).otherwise(new)  # settled: nothing changes any more

    start = state(F.lit(1.0), a + 1.0, F.lit(0.0), F.lit(1.0), F.lit(1.0), c / one, one / c, F.lit(-1.0))
    steps = F.sequence(F.lit(1), (F.lit(_STEPS) + 10 * F.sqrt(F.least(a, b))).cast("int"))
    return F.aggregate(steps, start, step, lambda st: F.when(F.abs(st["r"] - st["last"]) <= _TOLERANCE * st["r"], st["r"]).otherwise(
        F.raise_error(F.lit("the F tail did not converge")).cast("double")))


def _tail(v: Column) -> Column:
    """I_x(a, b) from a, b and ratio = y / x."""
    a, b, ratio = v["a"], v["b"], v["ratio"]
    x, y = 1.0 / (1.0 + ratio), ratio / (1.0 + ratio)
    # x^a y^b / B(a, b); the larger parameter goes through the step
    gammas = F.when(a >= b, _lgamma_step(a, b) - lgamma(b)).otherwise(_lgamma_step(b, a) - lgamma(a))
    front = F.exp(gammas - a * F.log1p(ratio) + b * (F.log(ratio) - F.log1p(ratio)))
    # the fraction needs parameters above 1: smaller ones are raised by 1, with the recurrences' terms
    raised = {"a": a + (a <= 1).cast("double"), "b": b + (b <= 1).cast("double"), "x": x, "y": y, "front": front}

    def sided(w):
        up_a = F.when(a <= 1, w["x"] * (a + b) / a).otherwise(F.lit(1.0))  # front of (w.a, b) by front
        up_b = F.when(b <= 1, w["y"] * (w["a"] + b) / b).otherwise(F.lit(1.0))  # front of (w.a, w.b) by that
        terms = F.when(a <= 1, w["front"] / a).otherwise(F.lit(0.0)) - F.when(b <= 1, w["front"] * up_a / b).otherwise(F.lit(0.0))
        excess = F.when(w["y"] < 0.5, (w["a"] + w["b"]) * w["y"] - w["b"]).otherwise(w["a"] - (w["a"] + w["b"]) * w["x"])
        return _let({"excess": excess, "front": w["front"] * up_a * up_b, "terms": terms}, lambda e: _let({
            # the side on which the fraction converges; the other one is its complement
            "upper": e["excess"] >= 0, "a": F.when(e["excess"] >= 0, w["a"]).otherwise(w["b"]), "b": F.when(e["excess"] >= 0, w["b"]).otherwise(w["a"]),
            "x": F.when(e["excess"] >= 0, w["x"]).otherwise(w["y"]), "y": F.when(e["excess"] >= 0, w["y"]).otherwise(w["x"]), "excess": F.abs(e["excess"]),
            "front": e["front"], "terms": e["terms"]}, lambda q: _let({"part": q["front"] * _beta_fraction(q)}, lambda r: F.when(
                q["upper"], r["part"]).otherwise(1.0 - r["part"]) + q["terms"])))

    return _let(raised, sided)


def f_sf_expr(f: Column, d1: Column, d2: Column) -> Column:
    """P(F > f) for F(d1, d2); null when f, d1 or d2 is null or a df is not positive."""
    f, d1, d2 = f.cast("double"), d1.cast("double"), d2.cast("double")
    tail = _let({"a": d2 / 2.0, "b": d1 / 2.0, "ratio": d1 * f / d2}, _tail)
    return (F.when(f.isNull() | d1.isNull() | d2.isNull() | (d1 <= 0) | (d2 <= 0) | F.isnan(f), F.lit(None))
            .when(f <= 0, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), tail))).cast("double"))


# Coefficients of Acklam's rational approximation of the normal quantile.
_A = [-3.969683028665376e+01, 2.209460984245205e+02, -2.759285104469687e+02,
      1.383577518672690e+02, -3.066479806614716e+01, 2.506628277459239e+00]
_B = [-5.447609879822406e+01, 1.615858368580409e+02, -1.556989798598866e+02,
      6.680131188771972e+01, -1.328068155288572e+01]
_C = [-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e+00,
      -2.549732539343734e+00, 4.374664141464968e+00, 2.938163982698783e+00]
_D = [7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e+00, 3.754408661907416e+00]


def _poly(coeffs, x: Column) -> Column:
    acc = F.lit(coeffs[0])
    for c in coeffs[1:]:
        acc = acc * x + F.lit(c)
    return acc


def norm_ppf_expr(p: Column) -> Column:
    """Standard normal quantile as a JVM expression (|error| < 1.2e-9); null outside (0, 1)."""
    p = p.cast("double")
    lo, hi = 0.02425, 1 - 0.02425
    q_lo = F.sqrt(-2.0 * F.log(p))
    q_hi = F.sqrt(-2.0 * F.log(1.0 - p))
    q = p - 0.5
    r = q * q
    central = _poly(_A, r) * q / (_poly(_B, r) * r + 1.0)
    tail_lo = _poly(_C, q_lo) / (_poly(_D, q_lo) * q_lo + 1.0)
    tail_hi = -_poly(_C, q_hi) / (_poly(_D, q_hi) * q_hi + 1.0)
    return (F.when(p.isNull() | (p <= 0) | (p >= 1), F.lit(None).cast("double"))
            .when(p < lo, tail_lo).when(p > hi, tail_hi).otherwise(central))
