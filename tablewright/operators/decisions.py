"""Repair decisions: which step fits each quality problem, its preview, its application and its check."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import names
from ..functions.missing import DATETIME, NUMERIC, TEXT, is_blank, kinds, name_col, strip, value
from ..functions.stats import percent, tiers
from ..functions.text import strip_number
from .outliers import cap, clip, remove_outliers
from .preparation import drop_columns, drop_duplicates, fill_missing
from .profile import column_counts, full_profile, ranked
from .quality import (
    WHOLE_TABLE,
    Audit,
    _validity_findings,
    empty_rule,
    mixed_count,
    mixed_pct,
    mixed_rule,
    named,
    outlier_pct,
    outlier_rule,
    severity_rank,
)


def investigate(df: DataFrame, profile: DataFrame | None = None) -> DataFrame:
    """The profile with the flags that the decisions test, one row per column."""
    p = profile if profile is not None else full_profile(df)
    c = F.col
    is_id = named(df.columns, names.is_id)
    numeric = (c("kind") == NUMERIC) & ~is_id
    datetime = c("kind") == DATETIME
    categorical = c("kind").isin(TEXT, "boolean") | (~numeric & ~datetime & ~is_id)

    def share(count: str) -> Column:
        return F.coalesce(F.try_divide(c(count).cast("double"), c("non_null").cast("double")), F.lit(0.0))

    skewness = F.when(c("non_null") >= 3, c("skewness")).otherwise(0.0)
    flagged = p.withColumns(
        {
            "is_id": is_id,
            "is_numeric": numeric,
            "is_datetime": datetime,
            "is_categorical": categorical,
            "is_target": named(df.columns, names.is_target),
            "is_skewed": F.coalesce(numeric & (F.abs(skewness) > 1.0), F.lit(False)),
            "is_heavily_skewed": F.coalesce(numeric & (F.abs(skewness) > 2.0), F.lit(False)),
            "outlier_pct": outlier_pct(),
            "top_ratio": share("top_count"),
            "is_dominant": categorical & (share("top_count") >= 0.40),
            "has_currency": share("currency_like") > 0.4,
            "has_percent": share("percent_like") > 0.4,
            "is_numeric_text": share("symbol_number_like") > 0.7,
        }
    )
    return flagged


def _missing_decision() -> Column:
    """The decision struct for a column with missing values."""
    c = F.col
    pct = c("missing_pct")
    special = c("is_id") | c("is_target")
    severity = (
        F.when((pct >= 60) | ((pct >= 30) & special), "CRITICAL")
        .when((pct >= 20) | ((pct >= 5) & special), "HIGH")
        .when(pct >= 5, "MEDIUM")
        .otherwise("LOW")
    )
    base = F.when(severity == "CRITICAL", 100.0).when(severity == "HIGH", 70.0).when(severity == "MEDIUM", 40.0)
    action = (
        F.when(pct >= 70, "drop_cols")
        .when(c("is_numeric"), F.when(c("is_skewed") | (c("outliers") > 0), "median").otherwise("mean"))
        .when(c("is_categorical"), F.when(c("is_dominant") & (pct <= 15), "mode").otherwise("unknown"))
        .when(c("is_datetime"), "ffill")
        .otherwise(F.when(pct > 1, "unknown").otherwise("drop_rows"))
    )
    confidence = F.when(action.isin("drop_cols", "median", "mean", "mode"), "HIGH").otherwise("MEDIUM")
    return _decision("missing", severity, base_or(base, 10.0) + pct, c("missing"), action, confidence)


def base_or(base: Column, default: float) -> Column:
    return base.otherwise(default)


def _decision(
    kind: str,
    severity: Column,
    weight: Column,
    affected: Column,
    action: Column,
    confidence: Column,
    low: Column | None = None,
    high: Column | None = None,
) -> Column:
    none = F.lit(None).cast("double")
    return F.struct(
        F.lit(kind).alias("type"),
        severity.alias("severity"),
        weight.cast("double").alias("weight"),
        affected.cast("bigint").alias("affected"),
        action.alias("action"),
        confidence.alias("confidence"),
        (low if low is not None else none).alias("low"),
        (high if high is not None else none).alias("high"),
    )


def missing_decisions(df: DataFrame, profile: DataFrame | None = None) -> DataFrame:
    """(column, type, severity, weight, affected, action, confidence, low, high) per incomplete column."""
    rows = investigate(df, profile).where(F.col("missing") > 0)
    return rows.select("column", _missing_decision().alias("d")).select("column", "d.*")


def _outlier_decision(columns: list[str]) -> Column:
    c = F.col
    age = F.lower("column").contains("age") & ((c("max") > 120) | (c("min") < 0))
    financial = named(columns, names.is_financial)
    severity = F.when(age, "HIGH").when(financial, "LOW").when(c("outlier_pct") > 8.0, "MEDIUM").otherwise("LOW")
    weight = F.when(age, 75.0).when(financial, 25.0).otherwise(c("outlier_pct") + 35.0)
    action = F.when(~age & financial, "retain_outliers").otherwise("cap_bounds")
    low = F.when(age, 0.0).otherwise(c("lower"))
    high = F.when(age, 100.0).otherwise(c("upper"))
    return _decision("outliers", severity, weight, c("outliers"), action, F.lit("HIGH"), low, high)


def decision_plan(df: DataFrame, audit: Audit | None = None) -> DataFrame:
    """Every decision, ranked by severity and then weight."""
    own = audit or Audit(df, share=False)
    c = F.col
    p = investigate(df, own.profile)
    hit = outlier_rule(df.columns) & (c("iqr") > 0) & (c("outliers") > 0) & c("is_numeric")
    high = F.lit("HIGH")
    found = [
        F.when(c("missing") > 0, _missing_decision()),
        F.when(hit, _outlier_decision(df.columns)),
        F.when(
            mixed_rule(),
            _decision("consistency", high, mixed_pct() + 65.0, mixed_count(), F.lit("cast_numeric_clean"), high),
        ),
        F.when(
            empty_rule(),
            _decision("empty", F.lit("CRITICAL"), F.lit(120.0), c("rows"), F.lit("drop_cols"), high),
        ),
    ]
    for v in _validity_findings(df):
        action = (
            F.when(v["issue"].contains("Negative"), "clip_non_negative")
            .when(v["issue"].contains("Whitespace"), "trim_whitespace")
            .otherwise("clean_invalid")
        )
        found.append(F.when(v.isNotNull(), _decision("validity", v["severity"], v["pct"] + 50.0, v["count"], action, high)))
    fields = ["column", "type", "severity", "weight", "affected", "action", "confidence", "low", "high"]
    per_column = (
        p.select("column", F.array(*found).alias("found"))
        .withColumn("found", F.filter("found", lambda x: x.isNotNull()))
        .select("column", F.inline("found"))
    )
    every = per_column.select(*fields).unionByName(duplicate_decision(own).select(*fields))
    order = [severity_rank(c("severity")), c("weight").desc(), c("type"), c("column"), c("action")]
    return ranked(every, *order).select("rank", *fields).orderBy("rank")


def duplicate_decision(audit: Audit) -> DataFrame:
    """The decision for duplicate rows, with the ID columns found; empty without duplicates."""
    share = F.col("duplicate_pct")
    base = F.when(share >= 15, 90.0).when(share >= 5, 60.0).otherwise(30.0)
    ids = [n for n in audit.df.columns if names.is_id(n)]
    struct = _decision(
        "duplicates",
        tiers(share, (15.0, "HIGH"), (5.0, "MEDIUM"), otherwise="LOW"),
        base + share,
        F.col("duplicate_rows"),
        F.lit("remove_exact"),
        F.lit("HIGH"),
    )
    rows = audit.duplicates.where(F.col("duplicate_rows") > 0)
    return rows.select(
        F.lit(WHOLE_TABLE).alias("column"), struct.alias("d"), F.lit(", ".join(ids)).alias("id_columns")
    ).select("column", "d.*", "id_columns")


@dataclass(frozen=True)
class Repair:
    """What to do to which column. ``low`` / ``high`` are bounds for capping."""

    strategy: str
    column: str | None = None
    low: float | None = None
    high: float | None = None
    order_by: str | None = None
    partition_by: tuple[str, ...] = ()


FILLS = ("median", "mean", "mode", "zero", "unknown")
KEEP = ("none", "keep_all", "keep_string", "retain_outliers")


def apply_repair(df: DataFrame, repair: Repair) -> DataFrame:
    """Apply one repair. Strategies that keep the data return it unchanged."""
    s, c = repair.strategy, repair.column
    if s in KEEP:
        return df
    if s == "remove_exact":
        return drop_duplicates(df)
    if c is None or c not in df.columns:
        raise ValueError(f"strategy '{s}' needs an existing column, got {c!r}")
    numeric = kinds(df)[c] == NUMERIC
    if s in FILLS:
        return fill_missing(df, [c], s)
    if s in ("ffill", "bfill"):
        if repair.order_by is None:
            raise ValueError(f"strategy '{s}' needs order_by")
        order = {"order_by": repair.order_by, "partition_by": list(repair.partition_by)}
        other = "bfill" if s == "ffill" else "ffill"
        return fill_missing(fill_missing(df, [c], s, **order), [c], other, **order)
    if s == "drop_rows":
        return df.where(value(df, c).isNotNull())
    if s == "drop_cols":
        return drop_columns(df, [c])
    if s == "cap_bounds" and numeric:
        return clip(df, c, repair.low, repair.high) if repair.low is not None else cap(df, c)
    if s == "drop_outliers" and numeric:
        return remove_outliers(df, c)
    if s == "clip_non_negative" and numeric:
        return clip(df, c, 0.0, None)
    if s == "trim_whitespace":
        if kinds(df)[c] != TEXT:
            return df
        return df.withColumn(c, F.when(~is_blank(name_col(c)), strip(name_col(c))))
    if s == "cast_numeric_clean":
        return df.withColumn(c, strip_number(name_col(c).cast("string")))
    if s == "clean_invalid" and numeric:
        return _clean_invalid(df, c)
    if s == "drop_invalid_rows":
        return df.where(~_invalid(df, c))
    raise ValueError(f"unknown or unfitting strategy '{s}' for column '{c}'")


def _clean_invalid(df: DataFrame, c: str) -> DataFrame:
    v = value(df, c)
    finite = F.when(F.abs(v.cast("double")) != float("inf"), v)
    if names.is_percentage(c):
        finite = F.when(finite.isNotNull(), F.least(F.greatest(finite, F.lit(0)), F.lit(100)))
    return df.withColumn(c, finite)


def _invalid(df: DataFrame, c: str) -> Column:
    """Rows whose value the validity rules reject; a missing value is not invalid."""
    v = value(df, c)
    if kinds(df)[c] == TEXT:
        bad = is_blank(v)
    elif kinds(df)[c] == NUMERIC:
        rules = [F.abs(v.cast("double")) == float("inf")]
        if names.is_non_negative(c):
            rules.append(v < 0)
        if names.is_percentage(c):
            rules.append((v < 0) | (v > 100))
        bad = reduce(Column.__or__, rules)
    else:
        return F.lit(False)
    return F.coalesce(bad, F.lit(False))


def _side(df: DataFrame, column: str | None) -> DataFrame:
    """One row: rows, columns, missing cells and, for a numeric column, mean / median / std."""
    from .ordering import exact_quantiles

    totals = column_counts(df).agg(F.max("rows").alias("rows"), F.sum("missing").alias("missing"))
    out = totals.select("rows", F.lit(len(df.columns)).alias("columns"), "missing")
    none = F.lit(None).cast("double")
    if column in df.columns and kinds(df)[column] == NUMERIC:
        v = value(df, column).cast("double")
        moments = df.agg(F.struct(F.avg(v).alias("mean"), F.stddev_samp(v).alias("std")).alias("m")).scalar()
        median = exact_quantiles(df, [column], [0.5]).select(F.col("quantiles")[0]).scalar()
        return out.select("*", moments["mean"].alias("mean"), median.alias("median"), moments["std"].alias("std"))
    return out.select("*", none.alias("mean"), none.alias("median"), none.alias("std"))


def preview(df: DataFrame, repair: Repair) -> DataFrame:
    """(side, rows, columns, missing, completeness, mean, median, std) before and after a repair."""
    after = apply_repair(df, repair)
    rows = []
    for i, (label, table) in enumerate((("before", df), ("after", after))):
        rows.append(_side(table, repair.column).select(F.lit(label).alias("side"), "*"))
    both = rows[0].unionByName(rows[1])
    filled = 100.0 - percent(F.col("missing"), F.col("rows") * F.col("columns"))
    return both.withColumn("completeness", F.round(filled, 1))


def verify(df: DataFrame, repair: Repair) -> DataFrame:
    """One row: scores before and after, their difference, and the side effects to warn about."""
    after = apply_repair(df, repair)
    scores = [Audit(t, share=False).breakdown().select("score").scalar() for t in (df, after)]
    stds = []
    for t in (df, after):
        c = repair.column
        if c in t.columns and kinds(t)[c] == NUMERIC:
            stds.append(t.agg(F.stddev_samp(value(t, c).cast("double"))).scalar())
        else:
            stds.append(F.lit(None).cast("double"))
    row_counts = [t.agg(F.count(F.lit(1))).scalar() for t in (df, after)]
    one = df.sparkSession.range(1).select(
        scores[0].alias("score_before"),
        scores[1].alias("score_after"),
        stds[0].alias("std_before"),
        stds[1].alias("std_after"),
        row_counts[0].alias("rows_before"),
        row_counts[1].alias("rows_after"),
    )
    delta = F.round(F.col("score_after") - F.col("score_before"), 1)
    kept = F.try_divide(F.col("std_after"), F.col("std_before"))
    expected = repair.strategy in ("drop_rows", "remove_exact", "drop_outliers", "drop_invalid_rows")
    return one.select(
        "score_before",
        "score_after",
        delta.alias("score_delta"),
        (delta > 0).alias("improved"),
        F.coalesce(kept < 0.60, F.lit(False)).alias("spread_warning"),
        ((F.col("rows_after") < F.col("rows_before")) & F.lit(not expected)).alias("rows_warning"),
    )
