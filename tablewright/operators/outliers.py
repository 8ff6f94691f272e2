"""IQR outliers of one column: show, remove, cap; and clipping to a given range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.missing import name_col, value
from .ordering import column_fences


def bounds(df: DataFrame, column: str) -> Column:
    """Struct (lower, upper, q1, q3, iqr, total); fences are NULL below four values."""
    f = column_fences(df, [column])
    low, high = [F.when(F.col("total") >= 4, F.col(x)).alias(x) for x in ("lower", "upper")]
    return f.select(F.struct(low, high, "q1", "q3", "iqr", "total").alias("b")).scalar()


def _outside(df: DataFrame, column: str, b: Column) -> Column:
    v = value(df, column).cast("double")
    return (v < b["lower"]) | (v > b["upper"])


def outlier_rows(df: DataFrame, column: str) -> DataFrame:
    """Rows whose value lies strictly outside the fences."""
    return df.where(_outside(df, column, bounds(df, column)))


def outlier_profile(df: DataFrame, column: str) -> DataFrame:
    """(outliers, lower, upper, q1, q3, iqr) of one column."""
    b = bounds(df, column)
    counted = df.agg(F.count_if(_outside(df, column, b)).alias("outliers"))
    return counted.select("outliers", *[b[x].alias(x) for x in ("lower", "upper", "q1", "q3", "iqr")])


def remove_outliers(df: DataFrame, column: str) -> DataFrame:
    """Drop outlier rows; rows with a missing value stay."""
    return df.where(~F.coalesce(_outside(df, column, bounds(df, column)), F.lit(False)))


def cap(df: DataFrame, column: str) -> DataFrame:
    """Move outliers to the nearer fence; missing values stay missing."""
    b = bounds(df, column)
    return _clipped(df, column, b["lower"], b["upper"])


def clip(df: DataFrame, column: str, low: float | None, high: float | None) -> DataFrame:
    """Limit a column to [low, high]; either end may be open."""
    none = F.lit(None).cast("double")
    return _clipped(df, column, F.lit(low) if low is not None else none, F.lit(high) if high is not None else none)


def _clipped(df: DataFrame, column: str, low: Column, high: Column) -> DataFrame:
    """``least`` and ``greatest`` skip NULL, so an open end has no effect; a NULL value is kept by the guard."""
    v = value(df, column)
    wide = v.cast("double")
    limited = F.least(F.greatest(wide, low.cast("double")), high.cast("double"))
    return df.withColumn(column, F.when(name_col(column).isNotNull() & v.isNotNull(), limited))
