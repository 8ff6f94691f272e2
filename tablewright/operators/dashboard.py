"""Which columns matter, headline numbers, and the tables of the four dashboard views."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions import names
from ..functions.dates import day_span
from ..functions.missing import number, present, value
from ..functions.stats import percent, settled
from ..functions.text import fixed
from .charts import histogram
from .ordering import _nothing, exact_quantiles, value_counts
from .profile import (
    named,
    _typed,
    as_timestamp,
    column_stats,
    duplicate_summary,
    table_summary,
)
from .quality import Audit
from .statistics import correlations


def _profile(df: DataFrame) -> DataFrame:
    return _typed(df, column_stats(df, numbers=True, dates=True))


def analytic_columns(df: DataFrame) -> DataFrame:
    """(position, column, role): numeric, categorical, datetime, boolean or text.

    IDs and integer sequences are not numeric; a category has 2 to 40 distinct values.
    """
    return _with_roles(df, _profile(df)).select("position", "column", "semantic_type", "distinct", "role")


def _with_roles(df: DataFrame, profile: DataFrame) -> DataFrame:
    c = F.col
    id_named = named(df.columns, lambda n: names.is_id(n) or "index" in n.lower())
    integers = [f.name for f in df.schema.fields if isinstance(f.dataType, T.IntegralType)]
    sequence = named(integers, lambda n: True) & (c("distinct") == c("rows")) & (c("rows") > 30)
    t = c("semantic_type")
    role = (
        F.when((t == "Numeric") & (id_named | sequence), "text")
        .when(t == "Numeric", "numeric")
        .when((t == "Categorical") & id_named & (c("distinct") == c("rows")), "text")
        .when((t == "Categorical") & c("distinct").between(2, 40), "categorical")
        .when(t == "Date/Time", "datetime")
        .when(t == "Boolean", "boolean")
        .otherwise("text")
    )
    return profile.withColumn("role", role)


def _with_scores(df: DataFrame, roles: DataFrame) -> DataFrame:
    """Add how well a present numeric or categorical column suits a headline; NULL for the others."""
    c = F.col
    filled = 1.0 - c("missing").cast("double") / c("rows")

    def points_if(rule: Column, points: float) -> Column:
        return F.when(rule, points).otherwise(0.0)

    numeric = (
        points_if(named(df.columns, names.is_metric), 12.0)
        + points_if(c("variance") > 0, 4.0)
        + filled * 3.0
        + points_if(c("distinct") > 5, 2.0)
    )
    size = F.when(c("distinct").between(2, 12), 10.0).when(c("distinct").between(13, 25), 5.0).otherwise(0.0)
    categorical = size + points_if(named(df.columns, names.is_category), 8.0) + filled * 2.0
    score = F.when(c("role") == "numeric", numeric).when(c("role") == "categorical", categorical)
    return roles.withColumn("score", F.when(c("non_null") > 0, score))


def ranked_columns(df: DataFrame) -> DataFrame:
    """(position, column, role, distinct, score) of numeric and categorical columns, best first in each role."""
    scored = _with_scores(df, _with_roles(df, _profile(df))).where(F.col("score").isNotNull())
    return scored.select("position", "column", "role", "distinct", "score").orderBy(
        "role", F.col("score").desc(), "position"
    )


class Layout:
    """Column choices for one table. One small job (a row per column) while the plan is built."""

    def __init__(self, df: DataFrame, profile: DataFrame | None = None):
        scored = _with_scores(df, _with_roles(df, profile if profile is not None else _profile(df)))
        in_order = scored.orderBy("position").select("position", "column", "role", "score").collect()
        best = sorted((r for r in in_order if r["score"] is not None), key=lambda r: (-r["score"], r["position"]))
        self.numeric = [r["column"] for r in best if r["role"] == "numeric"]
        self.categorical = [r["column"] for r in best if r["role"] == "categorical"]
        self.datetime = [r["column"] for r in in_order if r["role"] == "datetime"]
        self.numeric_in_order = [r["column"] for r in in_order if r["role"] == "numeric"]
        self.categorical_in_order = [r["column"] for r in in_order if r["role"] == "categorical"]


def short_number(c: Column) -> Column:
    """1234567 -> 1.23M, 1234 -> 1.2K, else two places."""
    size = F.abs(c)
    return (
        F.when(size >= 1_000_000, F.concat(fixed(c / 1_000_000, 2), F.lit("M")))
        .when(size >= 1_000, F.concat(fixed(c / 1_000, 1), F.lit("K")))
        .otherwise(F.format_number(c, 2))
    )


def primary_kpi(df: DataFrame, column: str) -> DataFrame:
    """One row: the sum (money and volume names) or mean of a column, its median, std and short text."""
    v = number(df, column)
    total = names.is_summable(column)
    median = exact_quantiles(df, [column], [0.5]).select(F.col("quantiles")[0]).scalar()
    one = df.agg((F.sum(v) if total else F.avg(v)).alias("value"), F.stddev_samp(v).alias("std"))
    kind = "Total" if total else "Average"
    label = f"{kind} {column.replace('_', ' ').title()}"
    return one.select(
        F.lit(column).alias("column"),
        F.lit(label).alias("label"),
        F.lit(kind).alias("aggregation"),
        "value",
        short_number(F.col("value")).alias("text"),
        median.alias("median"),
        "std",
    )


def listwise_correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """(var1, var2, r, n) over rows complete in all the given columns."""
    return correlations(present(df, columns), columns)


def correlation_snapshot(df: DataFrame, columns: list[str], n: int | None = None) -> DataFrame:
    """Listwise correlations of the columns, or of the first ``n``; the strongest pair is marked."""
    pairs = listwise_correlations(df, columns[:n])
    order = F.struct(-settled(F.abs("r")), F.col("var1"), F.col("var2"))
    best = pairs.agg(F.min_by(F.struct("var1", "var2"), order)).scalar()
    return pairs.select("var1", "var2", "r", (F.struct("var1", "var2") == best).alias("strongest"))


def smart_insights(df: DataFrame, layout: Layout | None = None) -> DataFrame:
    """(title, subject, value, extra): completeness, leading category, spread, correlation, span, copies."""
    layout = layout or Layout(df)
    numeric, category, dates = layout.numeric_in_order, layout.categorical_in_order, layout.datetime
    whole = table_summary(df)
    parts = [
        whole.select(
            *_insight("Data Completeness", F.lit("missing cells"), F.col("missing_cells"), F.col("missing_pct"))
        )
    ]
    if category:
        c = category[0]
        top = value_counts(df, c).orderBy(F.col("n").desc(), F.col("value")).limit(1)
        rows = df.agg(F.count(F.lit(1))).scalar()
        parts.append(
            top.select(
                *_insight("Category Distribution", F.concat(F.lit(f"{c}: "), "value"), F.col("n"), percent(F.col("n"), rows))
            )
        )
    if numeric:
        stats = column_stats(df, numeric, numbers=True)
        usable = stats.where((F.col("non_null") > 1) & (F.col("mean") != 0))
        cv = F.abs(F.col("std") / F.col("mean"))
        widest = usable.orderBy(cv.desc(), "position").limit(1)
        parts.append(widest.select(*_insight("Feature Variability", F.col("column"), F.col("mean"), F.col("std"))))
    if len(numeric) >= 2:
        pairs = listwise_correlations(df, numeric).where(F.col("n") > 5)
        best = pairs.orderBy(settled(F.abs("r")).desc(), "var1", "var2").limit(1).where(F.abs("r") >= 0.35)
        title = F.when(F.abs("r") >= 0.65, "Strong Correlation Detected").otherwise("Moderate Relationship")
        pair = F.concat("var1", F.lit(" ↔ "), "var2")
        parts.append(best.select(title.alias("title"), *_insight("", pair, F.col("r"))[1:]))
    if dates:
        d = as_timestamp(df, dates[0])
        span = df.agg(F.min(d).alias("lo"), F.max(d).alias("hi")).where(F.col("lo").isNotNull())
        text = F.concat_ws(" ", F.date_format("lo", "yyyy-MM-dd"), F.lit("to"), F.date_format("hi", "yyyy-MM-dd"))
        parts.append(span.select(*_insight("Temporal Coverage", text, day_span(F.col("lo"), F.col("hi")))))
    copies = duplicate_summary(df).where(F.col("duplicate_rows") > 0)
    parts.append(
        copies.select(
            *_insight("Record Redundancy", F.lit("duplicate rows"), F.col("duplicate_rows"), F.col("duplicate_pct"))
        )
    )
    return reduce(DataFrame.unionByName, parts)


def _insight(title: str, subject: Column, number_: Column, extra: Column | None = None) -> list[Column]:
    return [
        F.lit(title).alias("title"),
        subject.cast("string").alias("subject"),
        number_.cast("double").alias("value"),
        (extra if extra is not None else F.lit(None)).cast("double").alias("extra"),
    ]


def top_and_other(df: DataFrame, column: str, n: int = 8) -> DataFrame:
    """(label, records): the ``n`` most frequent values and, beyond them, one row "Other"."""
    counts = value_counts(df, column)
    top = counts.orderBy(F.col("n").desc(), F.col("value")).limit(n)
    shown = top.select(F.col("value").cast("string").alias("label"), F.col("n").alias("records"))
    total = df.agg(F.count(value(df, column))).scalar()
    rest = top.agg((total - F.sum("n")).alias("records")).where(F.col("records") > 0)
    return shown.unionByName(rest.select(F.lit("Other").alias("label"), "records"))


def time_trend(df: DataFrame, time: str, metric: str | None = None) -> DataFrame:
    """(period, value): sum of a metric, or records, per month (span over 730 days), week (over 60) or day.

    Periods without records count 0. A month is labelled by its last day, a week by its Sunday.
    """
    d = as_timestamp(df, time)
    rows = df.select(d.cast("date").alias("day"), d.alias("at"), *([number(df, metric).alias("m")] if metric else []))
    rows = rows.where(F.col("at").isNotNull())
    span = rows.agg(day_span(F.min("at"), F.max("at"))).scalar()
    monday = F.date_sub("day", F.weekday("day"))
    label = (
        F.when(span > 730, F.last_day("day")).when(span > 60, F.date_add(monday, 6)).otherwise(F.col("day"))
    )
    total = F.coalesce(F.sum("m"), F.lit(0.0)) if metric else F.count(F.lit(1)).cast("double")
    sums = rows.groupBy(label.alias("period")).agg(total.alias("value"))
    # The calendar between the first and last day: bounded by the number of days, built on one row.
    ends = rows.agg(F.min("day").alias("lo"), F.max("day").alias("hi"), day_span(F.min("at"), F.max("at")).alias("span"))
    every = ends.where(F.col("lo").isNotNull()).select(
        "span", F.explode(F.sequence("lo", "hi", F.expr("interval 1 day"))).alias("day")
    )
    monday = F.date_sub("day", F.weekday("day"))
    label = (
        F.when(F.col("span") > 730, F.last_day("day"))
        .when(F.col("span") > 60, F.date_add(monday, 6))
        .otherwise(F.col("day"))
    )
    calendar = every.select(label.alias("period")).distinct()
    joined = calendar.join(sums, "period", "left")
    return joined.select("period", F.coalesce("value", F.lit(0.0)).alias("value")).orderBy("period")


def slicer_values(df: DataFrame, column: str, n: int | None = None) -> DataFrame:
    """The values of a category, as text, in order; all of them, or the first ``n``."""
    text = df.select(value(df, column).cast("string").alias("value")).where(F.col("value").isNotNull())
    ordered = text.distinct().orderBy("value")
    return ordered if n is None else ordered.limit(n)


def sliced(df: DataFrame, column: str, choice: str) -> DataFrame:
    """The table restricted to one category value; "All" keeps it whole."""
    return df if choice == "All" else df.where(value(df, column).cast("string") == choice)


# --- the four views ------------------------------------------------------------------------------------------


def _card(n: int, label: Column, subject: Column, number_: Column, extra: Column) -> list[Column]:
    return [
        F.lit(n).alias("card"),
        label.cast("string").alias("label"),
        subject.cast("string").alias("subject"),
        number_.cast("double").alias("value"),
        extra.cast("double").alias("extra"),
    ]


def executive_cards(df: DataFrame, whole: DataFrame | None = None, layout: Layout | None = None) -> DataFrame:
    """Primary metric, second metric or leading category, quality score, share of the whole table in view.

    The column choice and the score share one profile (a row per column).
    """
    audit = Audit(df)
    layout = layout or Layout(df, audit.profile)
    none = F.lit(None)
    rows = df.agg(F.count(F.lit(1)).alias("rows"))
    parts = []
    if layout.numeric:
        parts.append(
            primary_kpi(df, layout.numeric[0]).select(
                *_card(1, F.col("label"), F.col("column"), F.col("value"), F.col("median"))
            )
        )
    else:
        parts.append(rows.select(*_card(1, F.lit("Total Records"), none, F.col("rows"), F.lit(len(df.columns)))))
    if len(layout.numeric) >= 2:
        c = layout.numeric[1]
        v = number(df, c)
        second = df.agg(F.avg(v).alias("mean"), F.max(v).alias("max"))
        parts.append(second.select(*_card(2, F.lit("Average"), F.lit(c), F.col("mean"), F.col("max"))))
    elif layout.categorical:
        c = layout.categorical[0]
        counts = value_counts(df, c)
        lead = counts.agg(
            F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("top"), F.count(F.lit(1)).alias("n")
        )
        parts.append(lead.select(*_card(2, F.lit(f"Top {c}"), F.col("top"), F.col("n"), none)))
    parts.append(
        audit.breakdown().select(
            *_card(3, F.lit("Data Quality Index"), F.col("status"), F.col("score"), F.col("completeness"))
        )
    )
    all_rows = (whole if whole is not None else df).agg(F.count(F.lit(1))).scalar()
    parts.append(
        rows.select(*_card(4, F.lit("Active Data Scope"), none, F.col("rows"), percent(F.col("rows"), all_rows)))
    )
    return reduce(DataFrame.unionByName, parts)


def type_mix(df: DataFrame) -> DataFrame:
    """Columns per semantic type."""
    return _profile(df).groupBy("semantic_type").agg(F.count(F.lit(1)).alias("columns"))


def segment_cards(df: DataFrame, layout: Layout | None = None) -> DataFrame:
    """For the three best categories: distinct values, leading value and its share."""
    layout = layout or Layout(df)
    parts = []
    for i, c in enumerate(layout.categorical[:3], start=1):
        counts = value_counts(df, c)
        one = counts.agg(
            F.count(F.lit(1)).alias("n"),
            F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("top"),
            F.max("n").alias("top_n"),
            F.sum("n").alias("total"),
        )
        parts.append(
            one.select(*_card(i, F.lit(c), F.col("top"), F.col("n"), percent(F.col("top_n"), F.col("total"))))
        )
    rows = df.agg(F.count(F.lit(1)).alias("rows"))
    fields = len(layout.categorical_in_order)
    for i in range(len(parts) + 1, 5):
        parts.append(
            rows.select(*_card(i, F.lit("Total Categorical Fields"), F.lit(None), F.lit(fields), F.col("rows")))
        )
    return reduce(DataFrame.unionByName, parts)


def segment_bars(df: DataFrame, layout: Layout | None = None) -> DataFrame:
    """(column, label, records): bars of the three best categories."""
    layout = layout or Layout(df)
    bars = [top_and_other(df, c, 10).select(F.lit(c).alias("column"), "*") for c in layout.categorical[:3]]
    return reduce(DataFrame.unionByName, bars) if bars else _nothing(df, [], "column string, label string, records bigint")


def driver_cards(df: DataFrame, layout: Layout | None = None) -> DataFrame:
    """Strongest listwise correlation, then std and mean of the next ranked metrics."""
    layout = layout or Layout(df)
    parts = []
    if len(layout.numeric) >= 2:
        pairs = listwise_correlations(df, layout.numeric)
        best = pairs.orderBy(settled(F.abs("r")).desc(), "var1", "var2").limit(1)
        pair = F.concat("var1", F.lit(" ↔ "), "var2")
        parts.append(best.select(*_card(1, F.lit("Strongest Correlation"), pair, F.col("r"), F.col("n"))))
    for i in range(len(parts), 4):
        if i < len(layout.numeric):
            c = layout.numeric[i]
            v = number(df, c)
            one = df.agg(F.stddev_samp(v).alias("std"), F.avg(v).alias("mean"))
            parts.append(one.select(*_card(i + 1, F.lit("Variance"), F.lit(c), F.col("std"), F.col("mean"))))
        else:
            one = df.sparkSession.range(1)
            n = len(layout.numeric)
            parts.append(one.select(*_card(i + 1, F.lit("Analyzed Metrics"), F.lit(None), F.lit(n), F.lit(None))))
    return reduce(DataFrame.unionByName, parts)


def anomaly_cards(df: DataFrame, layout: Layout | None = None, n: int | None = None) -> DataFrame:
    """Outliers in all metrics (or the ``n`` best), missing cells, duplicate rows, quality score.

    Column choice, outliers and score share one profile (a row per column).
    """
    audit = Audit(df)
    layout = layout or Layout(df, audit.profile)
    columns = layout.numeric[:n]
    none = F.lit(None)
    parts = []
    if columns:
        best = audit.profile.where(F.col("column").isin(columns) & (F.col("non_null") >= 4))
        counted = best.agg(F.coalesce(F.sum("outliers"), F.lit(0)).alias("n"))
        parts.append(counted.select(*_card(1, F.lit("Total Potential Outliers"), none, F.col("n"), none)))
    whole = table_summary(df)
    for i, label, field, pct in (
        (2, "Missing Data Cells", "missing_cells", "missing_pct"),
        (3, "Duplicate Rows", "duplicate_rows", "duplicate_pct"),
    ):
        parts.append(whole.select(*_card(i, F.lit(label), none, F.col(field), F.col(pct))))
    score = audit.breakdown()
    parts.append(score.select(*_card(4, F.lit("Health Index"), F.col("status"), F.col("score"), none)))
    return reduce(DataFrame.unionByName, parts)


def numeric_distribution(df: DataFrame, column: str) -> DataFrame:
    """Dashboard histogram: 8 to 25 bins by the number of distinct values (one small job for that number)."""
    distinct = value_counts(df, column).limit(26).count()
    return histogram(df, column, min(25, max(8, distinct)))
