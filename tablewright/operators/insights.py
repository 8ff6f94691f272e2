"""Observations about a chart's table: label, subject, value and a second number.

The labels are fixed values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.missing import name_col, number, numeric_columns, quoted
from ..functions.stats import pearson, percent, settled, skew
from .ordering import spread


def _fact(label: str, subject: Column, value: Column, extra: Column | None = None) -> list[Column]:
    return [
        F.lit(label).alias("label"),
        subject.cast("string").alias("subject"),
        value.cast("double").alias("value"),
        (extra if extra is not None else F.lit(None)).cast("double").alias("extra"),
    ]


def _facts(one: DataFrame, *rows: tuple[Column, list[Column]]) -> DataFrame:
    """Turn a one-row table into one row per fact whose condition holds."""
    cells = [F.when(rule, F.struct(*fields)) for rule, fields in rows]
    kept = one.select(F.filter(F.array(*cells), lambda x: x.isNotNull()).alias("facts"))
    return kept.select(F.inline("facts"))


def segments(chart: DataFrame, by: str, metric: str = "metric") -> DataFrame:
    """Dominant and lowest segment and the share of the top three. ``extra`` is % of the total."""
    sums = chart.groupBy(name_col(by).alias("label")).agg(F.sum(name_col(metric)).cast("double").alias("v"))
    entry = F.struct("label", "v")
    top = sums.orderBy(F.col("v").desc(), F.col("label").asc()).limit(3)
    top_sum = top.agg(F.sum("v")).scalar()
    first = sums.orderBy(F.col("v").desc(), F.col("label").asc()).limit(1).select(entry).scalar()
    last = sums.orderBy(F.col("v").asc(), F.col("label").desc()).limit(1).select(entry).scalar()
    one = sums.agg(F.sum("v").alias("total"), F.count(F.lit(1)).alias("n")).where(F.col("total") > 0)
    one = one.withColumns({"first": first, "last": last, "top": top_sum})
    total, n = F.col("total"), F.col("n")
    always = F.lit(True)
    return _facts(
        one,
        (always, _fact("Dominant Segment", F.col("first.label"), F.col("first.v"), percent(F.col("first.v"), total))),
        (n > 1, _fact("Lowest Segment", F.col("last.label"), F.col("last.v"), percent(F.col("last.v"), total))),
        (n >= 3, _fact("Top 3 Concentration", F.lit(None), F.col("top"), percent(F.col("top"), total))),
    )


def trend(chart: DataFrame, x: str, metric: str = "metric") -> DataFrame:
    """Change from first to last x in %, peak and trough. Needs at least two points."""
    m = name_col(metric).cast("double")
    rows = chart.select(name_col(x).alias("x"), m.alias("m")).where(F.col("m").isNotNull())
    one = rows.agg(
        F.min_by("m", "x").alias("start"),
        F.max_by("m", "x").alias("end"),
        F.min_by("x", F.struct(-F.col("m"), F.col("x"))).alias("peak_x"),
        F.max("m").alias("peak"),
        F.min_by("x", F.struct(F.col("m"), F.col("x"))).alias("trough_x"),
        F.min("m").alias("trough"),
        F.count(F.lit(1)).alias("n"),
    ).where(F.col("n") >= 2)
    change = F.coalesce(F.try_divide((F.col("end") - F.col("start")) * 100.0, F.abs("start")), F.lit(0.0))
    direction = (
        F.when(change > 2.0, "Upward Growth").when(change < -2.0, "Downward Decline").otherwise("Stable / Flat")
    )
    always = F.lit(True)
    return _facts(
        one,
        (always, _fact("Trend Direction", direction, change, F.col("end"))),
        (always, _fact("Peak Point", F.col("peak_x"), F.col("peak"))),
        (always, _fact("Trough Point", F.col("trough_x"), F.col("trough"))),
    )


def relationship(df: DataFrame, x: str, y: str) -> DataFrame:
    """Pearson r with a strength label, and the number of complete pairs (three at least)."""
    rows = df.select(number(df, x).alias("x"), number(df, y).alias("y")).where("x is not null and y is not null")
    one = rows.agg(pearson("x", "y").alias("r"), F.count(F.lit(1)).alias("n"))
    r = F.col("r")
    size = F.when(F.abs(r) >= 0.7, "Strong").when(F.abs(r) >= 0.4, "Moderate").when(F.abs(r) >= 0.15, "Weak")
    sign = F.when(r > 0, " Positive").otherwise(" Negative")
    label = F.coalesce(F.concat(size, sign), F.lit("Negligible / Uncorrelated"))
    enough = F.col("n") >= 3
    return _facts(
        one,
        (enough, _fact("Pearson Correlation (r)", label, r)),
        (enough, _fact("Sample Size", F.lit(None), F.col("n"))),
    )


def distribution(df: DataFrame, column: str) -> DataFrame:
    """Symmetry, interquartile range and outlier share of a numeric column (four values at least)."""
    v = number(df, column)
    one_col = df.select(v.alias(column))
    f = spread(one_col, [column]).select("total", "outliers", "iqr")
    skewness = one_col.agg(skew(quoted(column))).scalar()
    one = f.select(F.col("total").alias("n"), "outliers", "iqr", skewness.alias("skewness"))
    s = F.col("skewness")
    label = (
        F.when(s > 0.8, "Right-Skewed (Positive tail)")
        .when(s < -0.8, "Left-Skewed (Negative tail)")
        .otherwise("Approximately Symmetric")
    )
    enough = F.col("n") >= 4
    return _facts(
        one,
        (enough, _fact("Distribution Symmetry", label, s)),
        (enough, _fact("Interquartile Range (IQR)", F.lit(None), F.col("iqr"))),
        (enough, _fact("Statistical Outliers", F.lit(None), F.col("outliers"), percent(F.col("outliers"), F.col("n")))),
    )


def heatmap(matrix: DataFrame) -> DataFrame:
    """Strongest pair, and how many pairs lie beyond +-0.3. ``extra`` is the number of pairs."""
    pairs = matrix.where(F.col("var1") < F.col("var2"))
    best = pairs.orderBy(settled(F.abs("r")).desc(), "var1", "var2").limit(1).select(F.struct("var1", "var2", "r")).scalar()
    one = pairs.agg(
        F.count_if(F.col("r") > 0.3).alias("positive"),
        F.count_if(F.col("r") < -0.3).alias("negative"),
        F.count(F.lit(1)).alias("pairs"),
    ).withColumn("best", best)
    name = F.concat(F.col("best.var1"), F.lit(" ↔ "), F.col("best.var2"))
    some = F.col("pairs") > 0
    return _facts(
        one,
        (some, _fact("Strongest Correlation", name, F.col("best.r"))),
        (some, _fact("Positive Pairs", F.lit(None), F.col("positive"), F.col("pairs"))),
        (some, _fact("Negative Pairs", F.lit(None), F.col("negative"), F.col("pairs"))),
    )


def waterfall(steps: DataFrame) -> DataFrame:
    """Net change, best and worst step of a waterfall table."""
    rows = steps.where(F.col("kind") == "step")
    m = F.col("metric")
    up = F.when(m > 0, F.struct(-m, F.col("label")))
    down = F.when(m < 0, F.struct(m, F.col("label")))
    one = rows.agg(
        F.sum(m).alias("net"),
        F.min_by("label", up).alias("best"),
        F.max(F.when(m > 0, m)).alias("best_value"),
        F.min_by("label", down).alias("worst"),
        F.min(F.when(m < 0, m)).alias("worst_value"),
    )
    return _facts(
        one,
        (F.lit(True), _fact("Net Cumulative Delta", F.lit(None), F.col("net"))),
        (F.col("best").isNotNull(), _fact("Top Positive Driver", F.col("best"), F.col("best_value"))),
        (F.col("worst").isNotNull(), _fact("Top Negative Drag", F.col("worst"), F.col("worst_value"))),
    )


def radar(profiles: DataFrame) -> DataFrame:
    """Highest and lowest metric by mean over the profiles, and the number of metrics."""
    metrics = numeric_columns(profiles)
    entries = [
        F.struct(F.avg(number(profiles, m)).alias("mean"), F.lit(-i).alias("place"), F.lit(m).alias("name"))
        for i, m in enumerate(metrics)
    ]
    one = profiles.agg(F.array(*entries).alias("all"))
    high = F.array_max("all")
    low = F.array_min(F.transform("all", lambda e: F.struct(e["mean"], -e["place"], e["name"])))
    one = one.select(high.alias("high"), low.alias("low"), F.lit(len(metrics)).alias("n"))
    always = F.lit(True)
    return _facts(
        one,
        (always, _fact("Highest Dimension", F.col("high.name"), F.col("high.mean"))),
        (always, _fact("Lowest Dimension", F.col("low").getField("name"), F.col("low").getField("mean"))),
        (always, _fact("Metrics Evaluated", F.lit(None), F.col("n"))),
    )


def gauge(dial: DataFrame) -> DataFrame:
    """Current value and % of the target."""
    achieved = F.when(F.col("target") > 0, F.col("value") * 100.0 / F.col("target")).otherwise(100.0)
    one = dial.withColumn("achieved", achieved)
    always = F.lit(True)
    return _facts(
        one,
        (always, _fact("Current Metric Value", F.col("metric"), F.col("value"))),
        (always, _fact("Target Achievement", F.col("metric"), F.col("achieved"), F.col("target"))),
    )
