"""Statistical expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def pearson(x: Column, y: Column) -> Column:
    """Pearson r as an aggregate; null when a side is constant or has one row.

    ``corr`` divides by the deviations and fails on a constant series under
    ANSI mode, so the quotient is formed by ``try_divide``.
    """
    r = F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
    # Rounding may leave r a hair outside [-1, 1]; greatest and least skip nulls.
    bounded = F.least(F.lit(1.0), F.greatest(F.lit(-1.0), r))
    return F.when((F.count(F.lit(1)) > 1) & r.isNotNull(), bounded)


def pearson_p(r: Column, n: Column) -> Column:
    """Two-sided p-value of r over n pairs (Student t with n - 2 degrees).

    For whole degrees of freedom the t distribution is a finite trigonometric
    sum (Abramowitz & Stegun 26.7.3 and 26.7.4). With theta = atan(t/sqrt(v)):
    sin(theta) = |r| and cos(theta) = sqrt(1 - r^2), so neither t nor a
    division by 1 - r^2 is needed.
    """
    sin = F.abs(r)
    cos2 = F.greatest(F.lit(0.0), F.lit(1.0) - r * r)
    cos = F.sqrt(cos2)
    theta = F.atan2(sin, cos)
    v = (n - 2).cast("int")

    def series(first: Column, terms: Column, numer, denom) -> Column:
        """first * (1 + q1 + q1*q2 + ...), the j-th quotient being numer/denom."""
        start = F.struct(first.alias("term"), first.alias("total"))

        def step(acc, j):
            term = acc["term"] * cos2 * numer(j) / denom(j)
            return F.struct(term.alias("term"), (acc["total"] + term).alias("total"))

        steps = F.when(terms > 0, F.sequence(F.lit(1), terms)).otherwise(
            F.array().cast("array<int>"))
        return F.aggregate(steps, start, step, lambda acc: acc["total"])

    even = sin * series(
        F.lit(1.0), F.floor((v - 2) / 2).cast("int"),
        lambda j: (2 * j - 1).cast("double"), lambda j: (2 * j).cast("double"))
    odd_tail = F.when(v > 1, sin * series(
        cos, F.floor((v - 3) / 2).cast("int"),
        lambda j: (2 * j).cast("double"), lambda j: (2 * j + 1).cast("double"))
    ).otherwise(F.lit(0.0))
    odd = F.lit(2.0 / math.pi) * (theta + odd_tail)
    inside = F.when(v % 2 == 0, even).otherwise(odd)
    p = F.greatest(F.lit(0.0), F.lit(1.0) - inside)
    return F.when(r.isNull() | n.isNull() | (n < 2), F.lit(None).cast("double")).when(
        n == 2, F.lit(1.0)).otherwise(p)
