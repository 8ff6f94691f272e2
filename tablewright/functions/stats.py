"""Statistics with the bias corrections and null rules the reports use.

An infinite value leaves spread, skewness, kurtosis and correlation undefined: NULL, never NaN, which Spark would
order above every number.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def sample_std(x: str) -> Column:
    """Sample standard deviation of a SQL expression; 0 for a single value, NULL for none."""
    return F.expr(f"case when count({x}) = 1 then 0D else nanvl(stddev_samp({x}), null) end")


def skew(x: str) -> Column:
    """Bias-corrected skewness (G1); 0 below three values or without spread, NULL for no value."""
    n = f"cast(count({x}) as double)"
    corrected = f"try_divide(skewness({x}) * sqrt({n} * ({n} - 1)), {n} - 2)"
    return F.expr(
        f"case when count({x}) = 0 then null when count({x}) >= 3 and stddev_samp({x}) > 0 "
        f"then nanvl(coalesce({corrected}, 0D), null) else 0D end"
    )


def excess_kurtosis(x: str) -> Column:
    """Bias-corrected excess kurtosis (G2); 0 below four values or without spread."""
    n = f"cast(count({x}) as double)"
    corrected = f"try_divide({n} - 1, ({n} - 2) * ({n} - 3)) * (({n} + 1) * kurtosis({x}) + 6)"
    return F.expr(
        f"case when count({x}) = 0 then null when count({x}) >= 4 and stddev_samp({x}) > 0 "
        f"then nanvl(coalesce({corrected}, 0D), null) else 0D end"
    )


def pearson(a: str, b: str) -> Column:
    """Correlation over rows where both are present; NULL when a side does not vary (``corr`` would raise)."""
    return F.expr(f"nanvl(try_divide(covar_samp({a}, {b}), stddev_samp({a}) * stddev_samp({b})), null)")


def percent(part: Column, whole: Column) -> Column:
    """100 * part / whole, 0 when the whole is empty."""
    return F.coalesce(F.try_divide(part.cast("double") * 100.0, whole.cast("double")), F.lit(0.0))


def clamp(c: Column, low: float = 0.0, high: float = 100.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def tiers(c: Column, *steps: tuple[float, str], otherwise: str) -> Column:
    """First label whose threshold the value reaches."""
    out = F
    for limit, label in steps:
        out = out.when(c >= limit, label)
    return out.otherwise(otherwise)


# The labels and categories below, and their limits.


def skew_label(c: Column) -> Column:
    return (
        F.when(c.isNull(), "Undefined")
        .when(F.abs(c) <= 0.5, "Approximately Symmetric")
        .when(c > 1.0, "Highly Right-Skewed")
        .when(c > 0.5, "Moderately Right-Skewed")
        .when(c < -1.0, "Highly Left-Skewed")
        .otherwise("Moderately Left-Skewed")
    )


def skew_category(c: Column) -> Column:
    return (
        F.when(c.isNull(), "neutral")
        .when(F.abs(c) <= 0.5, "symmetric")
        .when(c > 1.0, "right_high")
        .when(c > 0.5, "right_mod")
        .when(c < -1.0, "left_high")
        .otherwise("left_mod")
    )


def kurtosis_label(c: Column) -> Column:
    return (
        F.when(c.isNull(), "Undefined")
        .when(c > 0.5, "Leptokurtic (Heavy-Tailed)")
        .when(c < -0.5, "Platykurtic (Light-Tailed)")
        .otherwise("Mesokurtic (Normal Tails)")
    )


def kurtosis_category(c: Column) -> Column:
    return (
        F.when(c.isNull(), "neutral")
        .when(c > 0.5, "leptokurtic")
        .when(c < -0.5, "platykurtic")
        .otherwise("mesokurtic")
    )


def settled(r: Column) -> Column:
    """A correlation without its last digits, so that equal ones rank by name in every run."""
    return F.round(r, 9)


def correlation_strength(r: Column) -> Column:
    return tiers(
        F.abs(r),
        (0.85, "Very Strong"),
        (0.70, "Strong"),
        (0.50, "Moderate"),
        (0.30, "Weak"),
        otherwise="Negligible",
    )
