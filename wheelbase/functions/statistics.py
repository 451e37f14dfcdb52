"""Numeric column functions Spark has no built-in for."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Rational minimax coefficients for erf/erfc (W. J. Cody, Math. Comp. 23, 1969).
ERF_SMALL_NUM = (1.85777706184603153e-1, 3.16112374387056560e0, 1.13864154151050156e2, 3.77485237685302021e2, 3.20937758913846947e3)
ERF_SMALL_DEN = (1.0, 2.36012909523441209e1, 2.44024637934444173e2, 1.28261652607737228e3, 2.84423683343917062e3)
ERFC_MID_NUM = (2.15311535474403846e-8, 5.64188496988670089e-1, 8.88314979438837594e0, 6.61191906371416295e1, 2.98635138197400131e2, 8.81952221241769090e2, 1.71204761263407058e3, 2.05107837782607147e3, 1.23033935479799725e3)
ERFC_MID_DEN = (1.0, 1.57449261107098347e1, 1.17693950891312499e2, 5.37181101862009858e2, 1.62138957456669019e3, 3.29079923573345963e3, 4.36261909014324716e3, 3.43936767414372164e3, 1.23033935480374942e3)
ERFC_TAIL_NUM = (1.63153871373020978e-2, 3.05326634961232344e-1, 3.60344899949804439e-1, 1.25781726111229246e-1, 1.60837851487422766e-2, 6.58749161529837803e-4)
ERFC_TAIL_DEN = (1.0, 2.56852019228982242e0, 1.87295284992346725e0, 5.27905102951428412e-1, 6.05183413124413191e-2, 2.33520497626869185e-3)
INV_SQRT_PI = 5.6418958354775628695e-1
SMALL_LIMIT = 0.46875
MID_LIMIT = 4.0
ZERO_LIMIT = 26.5


def _polynomial(x: Column, coefficients) -> Column:
    """Horner form, highest power first."""
    return reduce(lambda total, c: total * x + F.lit(c), coefficients[1:], F.lit(coefficients[0]))


def erfc_nonnegative(x: Column) -> Column:
    """Complementary error function of x >= 0 as one codegen expression (relative error near 1e-15)."""
    square = x * x
    small = F.lit(1.0) - x * _polynomial(square, ERF_SMALL_NUM) / _polynomial(square, ERF_SMALL_DEN)
    mid = F.exp(-square) * _polynomial(x, ERFC_MID_NUM) / _polynomial(x, ERFC_MID_DEN)
    inverse = F.lit(1.0) / F.greatest(square, F.lit(1.0))
    tail_ratio = inverse * _polynomial(inverse, ERFC_TAIL_NUM) / _polynomial(inverse, ERFC_TAIL_DEN)
    tail = F.exp(-square) * (F.lit(INV_SQRT_PI) - tail_ratio) / F.greatest(x, F.lit(1.0))
    return (
        F.when(x <= SMALL_LIMIT, small)
        .when(x <= MID_LIMIT, mid)
        .when(x <= ZERO_LIMIT, tail)
        .when(x.isNotNull(), F.lit(0.0))
    )


def correlation_statistic(rho: Column, n: Column) -> Column:
    """|rho| as a t statistic over √2, the argument of erfc for the normal approximation."""
    size = F.least(F.abs(rho), F.lit(0.999999))
    statistic = size * F.sqrt(F.greatest(n - 2, F.lit(0)) / F.greatest(1 - size * size, F.lit(1e-12)))
    return F.when(rho.isNotNull(), statistic / F.lit(2.0) ** 0.5)


def with_spearman_p(df: DataFrame, rho: str, n: str, name: str = "p_value") -> DataFrame:
    """Add the two-sided p-value.  The argument is its own column, so it is computed once per row."""
    argued = df.withColumn("_z", correlation_statistic(F.col(rho), F.col(n)))
    return argued.withColumn(name, erfc_nonnegative(F.col("_z"))).drop("_z")


def nan_to_null(value: Column) -> Column:
    return F.when(~F.isnan(value), value)
