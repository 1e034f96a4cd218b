"""Statistics as JVM expressions."""

from pyspark.sql import Column, functions as F

#: Coefficients (fixed values) of the Chebyshev fit of erfc, from the constant on.
ERFC = [-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277]


def erfc(x: Column) -> Column:
    """Complementary error function, fractional error below 1.2e-7; Spark has no builtin one."""
    z = F.abs(x)
    t = 1 / (1 + 0.5 * z)
    poly = F.lit(ERFC[-1])
    for c in reversed(ERFC[:-1]):
        poly = F.lit(c) + t * poly
    r = t * F.exp(-z * z + poly)
    return F.when(x >= 0, r).otherwise(2 - r)


def rate(part: Column, whole: Column) -> Column:
    """part / whole, null where nothing was measured."""
    return F.when(whole > 0, part / whole)


def two_proportion_z(a: Column, n: Column, b: Column, m: Column) -> Column:
    """Pooled two-proportion z of a/n against b/m, null without spread."""
    p = (a + b) / (n + m)
    se = F.sqrt(p * (1 - p) * (1 / n + 1 / m))
    return F.when((n > 0) & (m > 0), F.when(se > 0, (a / n - b / m) / se))


def p_two_sided(z: Column) -> Column:
    return erfc(F.abs(z) / F.sqrt(F.lit(2.0)))


def upper_median(values: Column) -> Column:
    """Element floor(n/2) of the sorted array, null for an empty one."""
    return F.when(F.size(values) > 0, F.element_at(F.sort_array(values), (F.floor(F.size(values) / 2) + 1).cast("int")))
