"""Exploratory statistics: summaries, correlations, outliers, column deep dives, findings, timelines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.dates import day_span
from ..functions.missing import NUMERIC, name_col, number, number_sql, numeric_columns, text_literal, value
from ..functions.stats import (
    correlation_strength,
    kurtosis_category,
    kurtosis_label,
    pearson,
    percent,
    settled,
    skew_category,
    skew_label,
)
from .correlation import pearson_pairs, spearman_pairs
from .ordering import _nothing, column_fences, exact_quantiles, keyed, spread, top_values, value_counts
from .profile import (
    _described,
    as_timestamp,
    column_stats,
    column_types,
    duplicate_summary,
)

# Correlation expressions per aggregate; wider tables use several passes.
PAIRS_PER_PASS = 400


def summary(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Count, mean, median, std, min, quartiles, max, skewness, kurtosis, missing % per numeric column."""
    columns = columns if columns is not None else numeric_columns(df)
    stats = column_stats(df, columns, numbers=True)
    q = exact_quantiles(df, columns, [0.25, 0.5, 0.75]).select("column", "quantiles")
    return stats.join(q, "column", "left").select(
        "position",
        "column",
        F.col("non_null").alias("count"),
        "mean",
        F.col("quantiles")[1].alias("median"),
        "std",
        "min",
        F.col("quantiles")[0].alias("q1"),
        F.col("quantiles")[2].alias("q3"),
        "max",
        "skewness",
        "kurtosis",
        "missing_pct",
    )


def search_summary(summary_: DataFrame, text: str = "", sort_by: str = "column") -> DataFrame:
    """Summary rows whose column name contains the text; any statistic sorts descending."""
    hit = summary_.where(F.lower("column").contains(text.lower())) if text else summary_
    return hit.orderBy(F.col(sort_by).asc() if sort_by == "column" else F.col(sort_by).desc_nulls_last(), "position")


def summary_leaders(summary_: DataFrame) -> DataFrame:
    """One row per headline: highest mean, highest std, largest absolute skewness."""
    def leader(label: str, field: str, by: Column) -> Column:
        # The first column wins a tie.
        pick = F.struct(by, -F.col("position"))
        present = F.when(F.col(field).isNotNull(), pick)
        return F.struct(
            F.lit(label).alias("headline"),
            F.max_by("column", present).alias("column"),
            F.max_by(field, present).alias("value"),
        )

    headlines = F.array(
        leader("Highest Mean", "mean", F.col("mean")),
        leader("Highest Std Dev", "std", F.col("std")),
        leader("Max Abs Skewness", "skewness", F.abs("skewness")),
    )
    return summary_.agg(headlines.alias("headlines")).select(F.inline("headlines"))


def shape_labels(summary_: DataFrame) -> DataFrame:
    """Skew and tail labels per column."""
    return summary_.select(
        "column",
        "skewness",
        skew_label(F.col("skewness")).alias("skew_label"),
        skew_category(F.col("skewness")).alias("skew_category"),
        "kurtosis",
        kurtosis_label(F.col("kurtosis")).alias("kurtosis_label"),
        kurtosis_category(F.col("kurtosis")).alias("kurtosis_category"),
    )


# --- correlation -------------------------------------------------------------------------------------------


def correlations(df: DataFrame, columns: list[str] | None = None, method: str = "pearson") -> DataFrame:
    """(var1, var2, r, n) for every pair, pairwise complete. Columns without spread have no pair."""
    columns = columns if columns is not None else numeric_columns(df)
    return spearman_pairs(df, columns) if method == "spearman" else pearson_pairs(df, columns)


def pair_correlations(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """(var1, var2, r, n) for the given pairs over the rows complete in both columns.

    Each row yields one (pair, x, y) per pair; one grouped aggregate with a partial step does the rest. That
    keeps one small aggregate in generated code, where an aggregate with several columns per pair would not.
    """
    if not pairs:
        return _nothing(df, [], "var1 string, var2 string, r double, n bigint")
    parts = []
    for start in range(0, len(pairs), PAIRS_PER_PASS):
        chunk = pairs[start : start + PAIRS_PER_PASS]
        points = [
            f"named_struct('pair', {i}, 'x', {number_sql(df, a)}, 'y', {number_sql(df, b)})"
            for i, (a, b) in enumerate(chunk)
        ]
        rows = df.select(F.expr(f"inline(array({', '.join(points)}))")).where("x is not null and y is not null")
        grouped = rows.groupBy("pair").agg(pearson("x", "y").alias("r"), F.count(F.lit(1)).alias("n"))
        labels = [f"named_struct('a', {text_literal(a)}, 'b', {text_literal(b)})" for a, b in chunk]
        label = F.expr(f"array({', '.join(labels)})[pair]")
        parts.append(grouped.select(label["a"].alias("var1"), label["b"].alias("var2"), "r", "n"))
    return reduce(DataFrame.unionByName, parts).where(F.col("r").isNotNull())


def full_matrix(pairs: DataFrame) -> DataFrame:
    """Both triangles and the diagonal of a correlation table, long format."""
    a, b, one = F.col("var1"), F.col("var2"), F.lit(1.0)

    def cell(x: Column, y: Column, r: Column) -> Column:
        return F.struct(x.alias("var1"), y.alias("var2"), r.alias("r"))

    sides = F.array(cell(a, b, F.col("r")), cell(b, a, F.col("r")), cell(a, a, one), cell(b, b, one))
    return pairs.select(F.inline(sides)).dropDuplicates(["var1", "var2"])


def strongest_pairs(pairs: DataFrame, n: int = 5, threshold: float = 0.0) -> DataFrame:
    """Top ``n`` positive and top ``n`` negative pairs at or beyond the threshold, with a strength label."""
    labelled = pairs.where(F.abs("r") >= threshold).withColumn("strength", correlation_strength(F.col("r")))
    positive = labelled.where(F.col("r") > 0).orderBy(settled(F.col("r")).desc(), "var1", "var2").limit(n)
    negative = labelled.where(F.col("r") < 0).orderBy(settled(F.col("r")).asc(), "var1", "var2").limit(n)
    fields = ["direction", "var1", "var2", "r", "strength"]
    return (
        positive.withColumn("direction", F.lit("positive"))
        .select(*fields)
        .unionByName(negative.withColumn("direction", F.lit("negative")).select(*fields))
    )


# --- outliers ----------------------------------------------------------------------------------------------


def _outlier_pct() -> Column:
    return percent(F.col("outliers"), F.col("total"))


def outlier_summary(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Fences, outlier count and %, extremes and status per numeric column, most outliers first."""
    columns = columns if columns is not None else numeric_columns(df)
    measured = _described(df, spread(df, columns).where(F.col("total") >= 4))
    pct = _outlier_pct()
    status = F.when(pct > 5.0, "High Outlier Burden").when(pct > 0.0, "Moderate Outliers").otherwise("Clean")
    return measured.orderBy(F.col("outliers").desc(), pct.desc(), "position").select(
        "column",
        F.col("total").alias("count"),
        "q1",
        "q3",
        "iqr",
        "lower",
        "upper",
        F.col("outliers").alias("outlier_count"),
        pct.alias("outlier_pct"),
        "min",
        "max",
        status.alias("status"),
    )


def outlier_totals(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row: total outliers, rate over all present numeric cells, number of affected columns."""
    counted = F.when(F.col("total") >= 4, F.col("outliers")).otherwise(0)
    totals = spread(df, columns if columns is not None else numeric_columns(df)).agg(
        F.sum(counted).alias("outliers"), F.sum("total").alias("total"), F.count_if(counted > 0).alias("affected")
    )
    return totals.select(
        F.coalesce("outliers", F.lit(0)).alias("total_outliers"),
        _outlier_pct().alias("outlier_rate"),
        F.col("affected").alias("affected_columns"),
    )


def outlier_samples(df: DataFrame, columns: list[str], order_by: list[str], n: int = 10) -> DataFrame:
    """(column, order keys..., value): first ``n`` outliers of each column.

    One scan for all columns: a row gives a cell per column in which it is an outlier, each task keeps its first ``n`` cells
    of a column, and only those are shuffled.
    """
    if not columns:
        return _nothing(df, order_by, "column string, value double")
    fence = keyed(column_fences(df, columns), "column", "lower", "upper")
    cells = [F.struct(F.lit(c).alias("__column"), value(df, c).cast("double").alias("__value"), fence[c]["lower"].alias("__lower"), fence[c]["upper"].alias("__upper")) for c in columns]
    keys = [name_col(o).alias(f"__o{i}") for i, o in enumerate(order_by)]
    outside = df.select(*keys, F.inline(F.array(*cells))).where("__value < __lower or __value > __upper")
    first = Window.partitionBy("__column").orderBy(*[f"__o{i}" for i in range(len(order_by))])
    kept = outside.withColumn("__rank", F.row_number().over(first)).where(F.col("__rank") <= n)
    return kept.select(F.col("__column").alias("column"), *[F.col(f"__o{i}").alias(o) for i, o in enumerate(order_by)], F.col("__value").alias("value"))


# --- one column --------------------------------------------------------------------------------------------


def column_overview(df: DataFrame, column: str) -> DataFrame:
    """One row: type, counts, distinct values, and whether the column is constant or a unique ID."""
    one = df.select(name_col(column))
    t = column_types(one)
    return t.select(
        "column",
        "semantic_type",
        "rows",
        "non_null",
        "missing",
        "missing_pct",
        "distinct",
        percent(F.col("distinct"), F.col("non_null")).alias("distinct_pct"),
        (F.col("distinct") == 1).alias("is_constant"),
        ((F.col("distinct") == F.col("rows")) & (F.col("rows") > 1)).alias("is_unique"),
    )


DEEP_QUANTILES = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)


def numeric_deep_dive(df: DataFrame, column: str) -> DataFrame:
    """One row: moments, range, fences, outliers and seven quantiles of a numeric column."""
    one = df.select(number(df, column).alias(column))
    stats = column_stats(one, numbers=True)
    q = spread(one, [column], probs=DEEP_QUANTILES)
    tails = {"p1": 0, "p5": 1, "p95": 5, "p99": 6}
    q = q.withColumns({x: F.col("quantiles")[i] for x, i in tails.items()}).drop("min", "max")
    out = stats.join(q, "column")
    labels = ["p1", "p5", "q1", "median", "q3", "p95", "p99"]
    return out.select(
        "column",
        F.col("non_null").alias("count"),
        "mean",
        "std",
        "variance",
        "min",
        "max",
        (F.col("max") - F.col("min")).alias("value_range"),
        *labels,
        "iqr",
        "lower",
        "upper",
        "outliers",
        "skewness",
        "kurtosis",
    )


def frequency_table(df: DataFrame, column: str, n: int = 15) -> DataFrame:
    """Most frequent values with count and % of the present values; ties by value."""
    counts = value_counts(df, column)
    total = df.agg(F.count(value(df, column))).scalar()
    top = counts.orderBy(F.col("n").desc(), F.col("value").asc()).limit(n)
    return top.select(
        F.col("value").cast("string").alias("value"), F.col("n").alias("count"), percent(F.col("n"), total).alias("pct")
    )


def date_deep_dive(df: DataFrame, column: str) -> DataFrame:
    """First and last moment and whole days between."""
    d = as_timestamp(df, column)
    stats = df.agg(F.count(d).alias("count"), F.min(d).alias("lo"), F.max(d).alias("hi"))
    shown = "yyyy-MM-dd HH:mm:ss"
    return stats.select(
        F.lit(column).alias("column"),
        "count",
        F.date_format("lo", shown).alias("first"),
        F.date_format("hi", shown).alias("last"),
        day_span(F.col("lo"), F.col("hi")).alias("span_days"),
    )


def timeline(df: DataFrame, column: str) -> DataFrame:
    """Records per year (span over 730 days), month (over 90) or day; occupied periods only."""
    d = as_timestamp(df, column)
    span = df.agg(day_span(F.min(d), F.max(d))).scalar()
    rows = df.select(d.alias("d")).where(F.col("d").isNotNull())
    period = (
        F.when(span > 730, F.date_format("d", "yyyy"))
        .when(span > 90, F.date_format("d", "yyyy-MM"))
        .otherwise(F.date_format("d", "yyyy-MM-dd"))
    )
    return rows.groupBy(period.alias("period")).agg(F.count(F.lit(1)).alias("records")).orderBy("period")


# --- findings ----------------------------------------------------------------------------------------------


def findings(df: DataFrame) -> DataFrame:
    """(category, severity, subject, measure): rule-based observations about the table."""
    numeric = numeric_columns(df)
    parts = [_column_findings(df, numeric)]
    if len(numeric) >= 2:
        parts.append(_correlation_findings(correlations(df, numeric)))
    if numeric:
        parts.append(_outlier_finding(df, numeric))
    copies = duplicate_summary(df).where(F.col("duplicate_rows") > 0)
    parts.append(
        copies.select(
            F.lit("Uniqueness").alias("category"),
            F.lit("DUPLICATES").alias("severity"),
            F.col("duplicate_rows").cast("string").alias("subject"),
            F.col("duplicate_pct").alias("measure"),
        )
    )
    return reduce(DataFrame.unionByName, parts)


def _names(rule: Column) -> Column:
    """Names of the profile rows that satisfy a rule, in table order (bounded by the number of columns)."""
    hits = F.array_sort(F.collect_list(F.when(rule, F.struct("position", "column"))))
    return F.array_join(F.transform(hits, lambda x: x["column"]), ", ")


def _column_findings(df: DataFrame, numeric: list[str]) -> DataFrame:
    p = column_stats(df, numbers=True).join(top_values(df, df.columns), "column")
    c = F.col
    # Findings name every column that they count.
    severe, high = c("missing_pct") > 50.0, c("missing_pct") > 20.0
    skewed = (c("kind") == NUMERIC) & (c("non_null") >= 4) & (F.abs("skewness") > 1.5)
    constant = (c("non_null") > 0) & (c("distinct") == 1)
    crowded = (
        (c("non_null") > 30)
        & (c("distinct") != 1)
        & (percent(c("distinct"), c("non_null")) > 85.0)
        & (c("kind") != NUMERIC)
    )
    order = F.when(skewed, F.struct(F.abs("skewness"), -c("position")))
    agg = p.agg(
        F.count_if(severe).alias("severe"),
        _names(severe).alias("severe_names"),
        F.count_if(high).alias("high"),
        _names(high).alias("high_names"),
        F.count(F.lit(1)).alias("columns"),
        F.max_by("column", order).alias("skew_column"),
        F.max_by("skewness", order).alias("skew_value"),
        F.count_if(constant).alias("constant"),
        _names(constant).alias("constant_names"),
        F.count_if(crowded).alias("crowded"),
        _names(crowded).alias("crowded_names"),
    )

    def row(rule: Column, category: str, severity: str, subject: Column, measure: Column) -> Column:
        return F.when(
            rule,
            F.struct(
                F.lit(category).alias("category"),
                F.lit(severity).alias("severity"),
                subject.alias("subject"),
                measure.cast("double").alias("measure"),
            ),
        )

    some, many = c("high") > 0, c("severe") > 0
    rows = [
        row(many, "Missing Data", "CRITICAL", c("severe_names"), c("severe")),
        row(~many & some, "Missing Data", "WARNING", c("high_names"), c("high")),
        row(~some, "Completeness", "POSITIVE", F.lit("all columns"), c("columns")),
        row(c("skew_column").isNotNull(), "Distribution", "HIGH SKEWNESS", c("skew_column"), c("skew_value")),
        row(c("constant") > 0, "Schema Quality", "ZERO VARIANCE", c("constant_names"), c("constant")),
        row(c("crowded") > 0, "Cardinality", "HIGH CARDINALITY", c("crowded_names"), c("crowded")),
    ]
    kept = agg.select(F.filter(F.array(*rows), lambda x: x.isNotNull()).alias("rows"))
    return kept.select(F.inline("rows"))


def _correlation_findings(pairs: DataFrame) -> DataFrame:
    subject = F.concat("var1", F.lit(" ↔ "), "var2")
    top = pairs.where(F.col("r") >= 0.75).orderBy(settled(F.col("r")).desc(), "var1", "var2").limit(1)
    low = pairs.where(F.col("r") <= -0.75).orderBy(settled(F.col("r")).asc(), "var1", "var2").limit(1)
    out = []
    for part, severity in ((top, "STRONG CORRELATION"), (low, "INVERSE CORRELATION")):
        out.append(
            part.select(
                F.lit("Correlation").alias("category"),
                F.lit(severity).alias("severity"),
                subject.alias("subject"),
                F.col("r").alias("measure"),
            )
        )
    return out[0].unionByName(out[1])


def _outlier_finding(df: DataFrame, numeric: list[str]) -> DataFrame:
    worst = outlier_summary(df, numeric).where(F.col("outlier_pct") > 5.0)
    worst = worst.orderBy(F.col("outlier_count").desc(), F.col("outlier_pct").desc(), "column").limit(1)
    return worst.select(
        F.lit("Outliers").alias("category"),
        F.lit("OUTLIER BURDEN").alias("severity"),
        F.col("column").alias("subject"),
        F.col("outlier_pct").alias("measure"),
    )
