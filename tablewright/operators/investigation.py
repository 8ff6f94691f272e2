"""How a target metric varies across a dimension, what it moves with, and how sure that is."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.missing import NUMERIC, kinds, name_col, number, numeric_columns, present
from ..functions.stats import settled
from .charts import _limits
from .statistics import outlier_summary, pair_correlations


def target_summary(df: DataFrame, target: str) -> DataFrame:
    """Mean, std, min, max and missing count of the target."""
    v = number(df, target)
    return df.agg(
        F.avg(v).alias("mean"),
        F.stddev_samp(v).alias("std"),
        F.min(v).alias("min"),
        F.max(v).alias("max"),
        F.count_if(v.isNull()).alias("missing"),
    )


def by_category(df: DataFrame, target: str, dimension: str, n: int = 15) -> DataFrame:
    """(category, mean, count, std): mean rounded to two places, highest first."""
    v = number(df, target)
    out = present(df, [dimension]).groupBy(name_col(dimension).cast("string").alias("category")).agg(
        F.round(F.avg(v), 2).alias("mean"), F.count(v).alias("count"), F.stddev_samp(v).alias("std")
    )
    return out.orderBy(F.col("mean").desc_nulls_last(), "category").limit(n)


def by_bins(df: DataFrame, target: str, dimension: str) -> DataFrame:
    """(bin, lo, hi, mean, count): right-closed equal-width bins of a numeric dimension, empty ones kept.

    There are as many bins as distinct values, between 2 and 10. The first edge lies 0.1 % of the range
    below the minimum, so that the minimum falls into the first bin.
    """
    d, v = number(df, dimension), number(df, target)
    limits = _limits(df, [dimension])[dimension]
    rows = df.select(d.alias("d"), v.alias("v")).where(F.col("d").isNotNull())
    distinct = rows.select("d").distinct().limit(10).agg(F.count(F.lit(1))).scalar()
    bins = F.greatest(F.lit(2), F.least(F.lit(10), distinct)).cast("int")
    span = limits["hi"] - limits["lo"]
    width = span / bins
    index = F.greatest(F.lit(1), F.least(bins, F.coalesce(F.ceil(F.try_divide(F.col("d") - limits["lo"], width)), F.lit(1))))
    counted = rows.groupBy(index.cast("int").alias("bin")).agg(
        F.round(F.avg("v"), 2).alias("mean"), F.count("v").alias("count")
    )
    one = df.sparkSession.range(1)
    every = one.select(F.explode(F.sequence(F.lit(1), bins)).alias("bin"))
    lo = limits["lo"] + width * (F.col("bin") - 1)
    lowered = F.when(F.col("bin") == 1, lo - span * 0.001).otherwise(lo)
    return every.join(counted, "bin", "left").select(
        "bin",
        lowered.alias("lo"),
        (limits["lo"] + width * F.col("bin")).alias("hi"),
        "mean",
        F.coalesce("count", F.lit(0)).alias("count"),
    )


def correlates(df: DataFrame, target: str, n: int = 4) -> DataFrame:
    """(column, r): the columns with the largest absolute correlation with the target."""
    others = [c for c in numeric_columns(df) if c != target]
    pairs = pair_correlations(df, [(c, target) for c in others])
    return pairs.orderBy(settled(F.abs("r")).desc(), "var1").limit(n).select(F.col("var1").alias("column"), "r")


def _groups(df: DataFrame, target: str, dimension: str) -> DataFrame:
    if kinds(df)[dimension] == NUMERIC:
        return by_bins(df, target, dimension).select("mean")
    return by_category(df, target, dimension).select("mean")


def confidence(df: DataFrame, target: str, dimension: str) -> DataFrame:
    """One row: spread of the group means against the target's std, its label, and the likely reasons."""
    v = number(df, target)
    means = _groups(df, target, dimension).agg(
        F.stddev_samp("mean").alias("group_std"), F.count("mean").alias("groups")
    )
    overall = df.agg(F.struct(F.stddev_samp(v).alias("std"), F.count_if(v.isNull()).alias("missing")).alias("s")).scalar()
    outliers = outlier_summary(df, [target]).select(F.col("outlier_pct")).scalar()
    out = means.select(
        "groups",
        F.coalesce(F.try_divide("group_std", overall["std"]), F.lit(0.0)).alias("ratio"),
        overall["missing"].alias("missing"),
        F.coalesce(outliers, F.lit(0.0)).alias("outlier_pct"),
    )
    if [c for c in numeric_columns(df) if c != target]:
        best = correlates(df, target, 1).select(F.struct("column", "r")).scalar()
    else:
        best = F.lit(None).cast("struct<column:string,r:double>")
    ratio = F.col("ratio")
    label = F.when((F.col("groups") > 1) & (ratio > 0.5), "High").when(
        (F.col("groups") > 1) & (ratio > 0.2), "Medium"
    )
    out = out.withColumns({"best": best, "confidence": label.otherwise("Low")})
    driver = F.abs("best.r") >= 0.5
    reasons = F.array_compact(
        F.array(
            F.when(F.col("outlier_pct") > 5, F.lit("outliers")),
            F.when(driver, F.concat(F.lit("driver: "), F.col("best.column"))),
            F.when(F.col("missing") > 0, F.lit("missing values")),
        )
    )
    text = F.when(F.size(reasons) > 0, F.array_join(reasons, "; ")).otherwise("no anomalous driver")
    return out.select("groups", "ratio", "confidence", "outlier_pct", "missing", text.alias("explanation"))
