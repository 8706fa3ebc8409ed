"""The normal law as column expressions, so that values stay inside Spark's generated code.

erfc is taken from rational functions (W. J. Cody, "Rational Chebyshev approximations for the error
function", 1969) in three ranges of the argument; the relative error is below 1e-13.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Coefficients of Cody's approximations, highest power first.
NEAR_OVER = (
    1.85777706184603153e-1, 3.16112374387056560e0, 1.13864154151050156e2, 3.77485237685302021e2, 3.20937758913846947e3,
)
NEAR_UNDER = (1.0, 2.36012909523441209e1, 2.44024637934444173e2, 1.28261652607737228e3, 2.84423683343917062e3)
MIDDLE_OVER = (
    2.15311535474403846e-8, 5.64188496988670089e-1, 8.88314979438837594e0, 6.61191906371416295e1,
    2.98635138197400131e2, 8.81952221241769090e2, 1.71204761263407058e3, 2.05107837782607147e3, 1.23033935479799725e3,
)
MIDDLE_UNDER = (
    1.0, 1.57449261107098347e1, 1.17693950891312499e2, 5.37181101862009858e2, 1.62138957456669019e3,
    3.29079923573345963e3, 4.36261909014324716e3, 3.43936767414372164e3, 1.23033935480374942e3,
)
FAR_OVER = (
    1.63153871373020978e-2, 3.05326634961232344e-1, 3.60344899949804439e-1, 1.25781726111229246e-1,
    1.60837851487422766e-2, 6.58749161529837803e-4,
)
FAR_UNDER = (
    1.0, 2.56852019228982242e0, 1.87295284992346725e0, 5.27905102951428412e-1, 6.05183413124413191e-2,
    2.33520497626869185e-3,
)
NEAR, FAR = 0.46875, 4.0


def _polynomial(coefficients: Sequence[float], x: Column) -> Column:
    value = F.lit(coefficients[0])
    for c in coefficients[1:]:
        value = value * x + F.lit(c)
    return value


def _near(x: Column) -> Column:
    """erf(x) for abs(x) up to NEAR."""
    square = x * x
    return x * _polynomial(NEAR_OVER, square) / _polynomial(NEAR_UNDER, square)


def _scaled(y: Column) -> Column:
    """exp(y * y) * erfc(y) for y from NEAR on; it neither under- nor overflows."""
    inverse = 1.0 / (F.greatest(y, F.lit(FAR)) * F.greatest(y, F.lit(FAR)))
    far = (1 / math.sqrt(math.pi) - inverse * _polynomial(FAR_OVER, inverse) / _polynomial(FAR_UNDER, inverse)) / F.greatest(
        y, F.lit(FAR)
    )
    return F.when(y <= FAR, _polynomial(MIDDLE_OVER, y) / _polynomial(MIDDLE_UNDER, y)).otherwise(far)


def normal_cdf(z: Column) -> Column:
    """P(Z <= z); null and NaN stay as they are."""
    x = -z / math.sqrt(2.0)
    y = F.abs(x)
    tail = 0.5 * F.exp(-y * y) * _scaled(y)
    return F.when(y <= NEAR, 0.5 - 0.5 * _near(x)).when(x > 0, tail).otherwise(1.0 - tail)


def log_normal_cdf(z: Column) -> Column:
    """log P(Z <= z), also where the probability itself is too small for a double."""
    x = -z / math.sqrt(2.0)
    y = F.abs(x)
    near = F.log(0.5 - 0.5 * F.when(y <= NEAR, _near(x)).otherwise(F.lit(0.0)))
    return (
        F.when(y <= NEAR, near).when(x > 0, F.log(0.5 * _scaled(y)) - y * y)
        .otherwise(F.log1p(-0.5 * F.exp(-y * y) * _scaled(y)))
    )
