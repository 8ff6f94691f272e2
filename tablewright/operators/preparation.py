"""Row and column transformations: fills, duplicates, columns, casts, filters, sort, text, dates, arithmetic.

Each takes a DataFrame and returns a new one. Statistics that a fix needs (mean, median, fences) enter the
plan as scalar subqueries, so a fix is one lazy plan and moves no rows to the driver.
"""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.dates import DATE_FORMATS, parse_timestamp
from ..functions.missing import (
    BOOLEAN,
    DATETIME,
    NUMERIC,
    is_blank,
    kinds,
    name_col,
    number,
    strip,
    value,
    without_nan,
)
from ..functions.stats import percent
from ..functions.text import blank_to_null, parse_boolean, title_case
from .copies import each_once
from .fills import directional_fill
from .ordering import exact_quantiles, keyed, value_counts
from .profile import column_counts, column_stats, duplicate_summary
from .winners import winning_rows

# --- missing values ----------------------------------------------------------------------------------------


def missing_summary(df: DataFrame) -> DataFrame:
    """(column, dtype, missing, missing_pct, advice) per column."""
    c = F.col
    # The advice texts.
    advice = (
        F.when(c("missing") == 0, "Complete (No Action Needed)")
        .when(c("missing_pct") > 70.0, "Consider Dropping Column (>70% missing)")
        .when((c("kind") == NUMERIC) & (F.abs("skewness") > 1.0), "Fill with Median (Skewed)")
        .when(c("kind") == NUMERIC, "Fill with Mean or Median")
        .when(c("kind") == DATETIME, "Drop Rows or Forward Fill")
        .otherwise("Fill with Mode or 'Unknown'")
    )
    return column_stats(df, numbers=True).select(
        "column", "dtype", "missing", F.round("missing_pct", 2).alias("missing_pct"), advice.alias("advice")
    )


def drop_missing_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.na.drop(subset=columns)


def fill_missing(
    df: DataFrame,
    columns: list[str],
    strategy: str,
    custom: Any = None,
    order_by: str | None = None,
    partition_by: list[str] | None = None,
) -> DataFrame:
    """Fill missing cells: mean, median, mode, zero, unknown, custom, ffill, bfill.

    mean and median skip columns that are not numeric. ffill and bfill need a unique ``order_by``.
    """
    columns = [c for c in columns if c in df.columns]
    kind = kinds(df)
    if strategy in ("mean", "median"):
        numeric = [c for c in columns if kind[c] == NUMERIC]
        if not numeric:
            return df
        fill = _means(df, numeric) if strategy == "mean" else _medians(df, numeric)
        return df.withColumns({c: F.coalesce(value(df, c).cast("double"), fill[c]) for c in numeric})
    if strategy == "mode":
        return df.withColumns({c: F.coalesce(value(df, c), _mode(df, c)) for c in columns})
    if strategy == "zero":
        return df.withColumns({c: _filled(df, c, 0 if kind[c] == NUMERIC else "0") for c in columns})
    if strategy == "unknown":
        return df.withColumns({c: _filled(df, c, "Unknown") for c in columns})
    if strategy == "custom":
        if custom is None:
            return df
        return df.withColumns({c: _filled(df, c, _custom_value(custom, kind[c])) for c in columns})
    if strategy in ("ffill", "bfill"):
        if order_by is None:
            raise ValueError(f"'{strategy}' needs order_by: a DataFrame has no row order")
        return directional_fill(df, columns, order_by, partition_by, backward=strategy == "bfill")
    raise ValueError(f"unknown fill strategy '{strategy}'")


def _means(df: DataFrame, columns: list[str]) -> Column:
    entries = [F.avg(value(df, c).cast("double")).alias(c) for c in columns]
    return df.agg(F.struct(*entries).alias("s")).scalar()


def _medians(df: DataFrame, columns: list[str]) -> Column:
    medians = exact_quantiles(df, columns, [0.5]).select("column", F.col("quantiles")[0].alias("median"))
    m = keyed(medians, "column", "median")
    return _Fields({c: m[c]["median"] for c in columns})


class _Fields(dict):
    """Columns by name, read like a struct column."""


def _mode(df: DataFrame, column: str) -> Column:
    """Most frequent value, the smallest of several. Equal values are counted before any shuffle."""
    return value_counts(df, column).agg(F.min_by("value", F.struct(-F.col("n"), F.col("value")))).scalar()


def _filled(df: DataFrame, column: str, new: Any) -> Column:
    """Coalesce; a text replacement turns any other column into text."""
    v = value(df, column)
    return F.coalesce(v.cast("string") if isinstance(new, str) else v, F.lit(new))


def _custom_value(custom: Any, kind: str) -> Any:
    if kind == BOOLEAN and isinstance(custom, bool):
        return custom
    if kind != NUMERIC:
        return str(custom)
    try:
        parsed = float(custom)
    except (TypeError, ValueError):
        return str(custom)
    return int(parsed) if parsed.is_integer() else parsed


def step_report(before: DataFrame, after: DataFrame, columns: list[str]) -> DataFrame:
    """One row: rows and columns before and after, and the cells or rows the step affected."""
    def side(df: DataFrame) -> Column:
        shown = [c for c in columns if c in df.columns]
        gaps = [F.count_if(value(df, c).isNull()) for c in shown] or [F.lit(0)]
        total = reduce(Column.__add__, gaps)
        return df.agg(F.struct(F.count(F.lit(1)).alias("rows"), total.alias("missing")).alias("s")).scalar()

    b, a = side(before), side(after)
    one = before.sparkSession.range(1).select(
        b["rows"].alias("rows_before"),
        a["rows"].alias("rows_after"),
        F.lit(len(before.columns)).alias("columns_before"),
        F.lit(len(after.columns)).alias("columns_after"),
        b["missing"].alias("missing_before"),
        a["missing"].alias("missing_after"),
    )
    dropped = len(before.columns) - len(after.columns)
    affected = (
        F.when(F.lit(dropped > 0), F.lit(dropped).cast("bigint"))
        .when(F.col("rows_after") < F.col("rows_before"), F.col("rows_before") - F.col("rows_after"))
        .otherwise(F.col("missing_before") - F.col("missing_after"))
    )
    return one.withColumn("affected", affected)


# --- duplicates --------------------------------------------------------------------------------------------


def duplicate_info(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(total_rows, duplicate_count, duplicate_pct): extra copies by whole row or by key columns."""
    keys = df.select(*[name_col(c) for c in (columns or df.columns)])
    return duplicate_summary(keys).select(
        F.col("rows").alias("total_rows"),
        F.col("duplicate_rows").alias("duplicate_count"),
        F.round("duplicate_pct", 2).alias("duplicate_pct"),
    )


def drop_duplicates(
    df: DataFrame, columns: list[str] | None = None, keep: str = "first", order_by: list[str] | None = None
) -> DataFrame:
    """One row per key. Whole rows need no order; a subset keeps the first or last row by ``order_by``."""
    if not columns or set(columns) == set(df.columns):
        return each_once(df)
    if not order_by:
        raise ValueError("keeping the first or last row of a key needs order_by")
    return winning_rows(without_nan(df), columns, order_by, keep)


# --- columns -----------------------------------------------------------------------------------------------


def rename_column(df: DataFrame, old: str, new: str) -> DataFrame:
    """Rename; a missing source, a blank name or a name in use is an error."""
    new = str(new).strip()
    if old not in df.columns:
        raise ValueError(f"no column '{old}' to rename")
    if not new:
        raise ValueError("a column needs a name")
    if new != old and new in df.columns:
        raise ValueError(f"the name '{new}' is taken")
    return df.withColumnRenamed(old, new)


def drop_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """Drop the given columns that exist; never all of them."""
    kept = [c for c in df.columns if c not in columns]
    return df.select(*[name_col(c) for c in kept]) if kept else df


def reorder_columns(df: DataFrame, first: list[str]) -> DataFrame:
    """Given columns first, the others after them in their old order."""
    front = [c for c in first if c in df.columns]
    return df.select(*[name_col(c) for c in [*front, *[c for c in df.columns if c not in front]]])


CASTS = ("Numeric", "Integer", "Float", "String", "Category", "Boolean", "Datetime")


def cast_column(df: DataFrame, column: str, target: str, formats: list[str] | None = None) -> DataFrame:
    """Cast; what cannot be read becomes NULL. ``Category`` is text with a metadata tag."""
    c = name_col(column)
    if target in ("Numeric", "Float"):
        new = number(df, column) if kinds(df)[column] != BOOLEAN else c.cast("double")
    elif target == "Integer":
        x = number(df, column) if kinds(df)[column] != BOOLEAN else c.cast("double")
        new = F.bround(x).try_cast("bigint")
    elif target == "String":
        new = value(df, column).cast("string")
    elif target == "Category":
        return df.withColumn(column, value(df, column).cast("string")).withMetadata(column, {"category": True})
    elif target == "Boolean":
        new = c if kinds(df)[column] == BOOLEAN else parse_boolean(value(df, column))
    elif target == "Datetime":
        if kinds(df)[column] == DATETIME:
            new = c.cast("timestamp_ntz")
        else:
            new = parse_timestamp(c.cast("string"), formats or DATE_FORMATS)
    else:
        raise ValueError(f"cannot cast to '{target}'")
    return df.withColumn(column, new)


def cast_report(before: DataFrame, after: DataFrame, column: str) -> DataFrame:
    """(converted, coerced): present values after the cast, and present values it could not read."""
    counts = [t.agg(F.count(value(t, column))).scalar() for t in (before, after)]
    return before.sparkSession.range(1).select(
        counts[1].alias("converted"), F.greatest(F.lit(0), counts[0] - counts[1]).alias("coerced")
    )


# --- filters and order -------------------------------------------------------------------------------------


def filter_rows(df: DataFrame, rules: list[dict[str, Any]]) -> DataFrame:
    """Rows that satisfy every valid rule. A rule: {column, operator, value, value_end}.

    Rules that cannot be read (unknown column or operator, a bad number or date) are ignored.
    """
    for rule in rules:
        condition = _condition(df, rule)
        if condition is not None:
            df = df.where(condition)
    return df


def _condition(df: DataFrame, rule: dict[str, Any]) -> Column | None:
    column, operator = rule.get("column"), rule.get("operator")
    if not column or column not in df.columns or not operator:
        return None
    kind = kinds(df)[column]
    test = {NUMERIC: _numeric_condition, DATETIME: _datetime_condition}.get(kind, _text_condition)
    return test(df, column, operator, rule.get("value"), rule.get("value_end"))


def _numeric_condition(df: DataFrame, column: str, op: str, low: Any, high: Any) -> Column | None:
    """Comparisons use the bare column so that the scan can skip row groups; NaN is excluded after."""
    c, v = name_col(column), value(df, column)
    if op == "Is Null / Missing":
        return v.isNull()
    if op == "Is Not Null":
        return v.isNotNull()
    try:
        a = float(low) if low is not None else 0.0
        b = float(high) if high is not None else a
    except (TypeError, ValueError):
        return None
    present = v.isNotNull()
    tests = {
        "Equals (=)": lambda: c == a,
        "Not Equals (!=)": lambda: ~v.eqNullSafe(F.lit(a)),
        "Greater Than (>)": lambda: (c > a) & present,
        "Greater or Equal (>=)": lambda: (c >= a) & present,
        "Less Than (<)": lambda: (c < a) & present,
        "Less or Equal (<=)": lambda: (c <= a) & present,
        "Between": lambda: (c >= min(a, b)) & (c <= max(a, b)),
    }
    return tests[op]() if op in tests else None


def _datetime_condition(df: DataFrame, column: str, op: str, low: Any, high: Any) -> Column | None:
    import datetime

    c = name_col(column)
    if op == "Is Null / Missing":
        return c.isNull()
    if op == "Is Not Null":
        return c.isNotNull()

    def moment(x: Any) -> datetime.datetime | None:
        if isinstance(x, datetime.datetime):
            return x
        if isinstance(x, datetime.date):
            return datetime.datetime(x.year, x.month, x.day)
        try:
            return datetime.datetime.fromisoformat(str(x))
        except ValueError:
            return None

    a = moment(low)
    if a is None:
        return None
    b = moment(high) if high else a
    if b is None:
        return None

    def literal(x: datetime.datetime) -> Column:
        return F.lit(x.isoformat(sep=" ")).cast("timestamp_ntz")

    day = literal(datetime.datetime(a.year, a.month, a.day))
    tests = {
        "Before (<)": lambda: c < literal(a),
        "After (>)": lambda: c > literal(a),
        # A range instead of to_date(column) keeps the comparison on the bare column.
        "Equals": lambda: (c >= day) & (c < day + F.expr("interval 1 day")),
        "Between": lambda: (c >= literal(a)) & (c <= literal(b)),
    }
    return tests[op]() if op in tests else None


def _text_condition(df: DataFrame, column: str, op: str, low: Any, high: Any) -> Column | None:
    text = value(df, column).cast("string")
    folded = F.lower(text)
    word = str(low).lower() if low is not None else ""
    if op == "Is one of":
        if not isinstance(low, (list, tuple, str)):
            return None
        raw = low if not isinstance(low, str) else [x.strip() for x in low.split(",") if x.strip()]
        return folded.isin([str(x).lower() for x in raw])
    tests = {
        "Equals": lambda: folded == word,
        "Not Equals": lambda: ~folded.eqNullSafe(F.lit(word)),
        "Contains": lambda: folded.contains(word),
        "Starts with": lambda: folded.startswith(word),
        "Ends with": lambda: folded.endswith(word),
        "Is Null / Missing": lambda: text.isNull() | is_blank(text),
        "Is Not Null": lambda: text.isNotNull() & ~is_blank(text),
    }
    return tests[op]() if op in tests else None


def sort_rows(df: DataFrame, columns: list[str], ascending: list[bool] | None = None) -> DataFrame:
    """Sort by several columns, each with its direction; missing values come last."""
    columns = [c for c in columns if c in df.columns]
    flags = list(ascending or [])[: len(columns)]
    flags += [True] * (len(columns) - len(flags))
    order = [
        value(df, c).asc_nulls_last() if up else value(df, c).desc_nulls_last() for c, up in zip(columns, flags)
    ]
    return df.orderBy(*order) if order else df


# --- text, dates, arithmetic -------------------------------------------------------------------------------


def clean_text(
    df: DataFrame, column: str, steps: list[str], find: str | None = None, replace: str | None = None
) -> DataFrame:
    """Apply trim, lower, upper, title, find_replace (literal), remove_empty in the given order."""
    c = name_col(column).cast("string")
    for step in steps:
        if step == "trim":
            c = strip(c)
        elif step == "lower":
            c = F.lower(c)
        elif step == "upper":
            c = F.upper(c)
        elif step == "title":
            c = title_case(c)
        elif step == "find_replace" and find:
            c = F.replace(c, F.lit(find), F.lit(replace or ""))
        elif step == "remove_empty":
            c = blank_to_null(c)
    return df.withColumn(column, c)


DATE_PARTS = {
    "year": ("Year", lambda d: F.year(d).cast("bigint")),
    "month": ("Month", lambda d: F.month(d).cast("bigint")),
    "day": ("Day", lambda d: F.day(d).cast("bigint")),
    "day_of_week": ("DayOfWeek", lambda d: F.date_format(d, "EEEE")),
    "quarter": ("Quarter", lambda d: F.quarter(d).cast("bigint")),
}


def date_parts(df: DataFrame, column: str, parts: list[str], prefix: str | None = None) -> DataFrame:
    """Add <prefix>_Year, _Month, _Day, _DayOfWeek, _Quarter for the requested parts."""
    from .profile import as_timestamp

    d = as_timestamp(df, column)
    pfx = prefix or column
    chosen = [DATE_PARTS[p] for p in parts if p in DATE_PARTS]
    return df.withColumns({f"{pfx}_{suffix}": make(d) for suffix, make in chosen})


def derive(
    df: DataFrame, new: str, a: str, operation: str, b: str | None = None, constant: float | None = None
) -> DataFrame:
    """New column from a and either another column or a constant; a zero divisor gives NULL."""
    new = str(new).strip()
    if not new:
        raise ValueError("the derived column needs a name")
    if new in df.columns:
        raise ValueError(f"the name '{new}' is taken")
    if b is not None:
        right = number(df, b)
    elif constant is not None:
        right = F.lit(float(constant))
    else:
        raise ValueError("give a second column or a constant")
    left = number(df, a)
    results = {
        "add": lambda: left + right,
        "subtract": lambda: left - right,
        "multiply": lambda: left * right,
        "divide": lambda: F.try_divide(left, right),
        "percentage": lambda: F.try_divide(left, right) * 100,
    }
    if operation not in results:
        raise ValueError(f"no operation '{operation}'")
    return df.withColumn(new, results[operation]())


def preparation_summary(original: DataFrame, current: DataFrame) -> DataFrame:
    """One row: rows, columns, completeness and duplicates of both tables, issues resolved and pending."""
    def side(df: DataFrame) -> Column:
        width = len(df.columns)
        counts = column_counts(df).agg(F.max("rows").alias("rows"), F.sum("missing").alias("missing"))
        copies = duplicate_summary(df).select("duplicate_rows").scalar()
        filled = 100.0 - percent(F.col("missing"), F.col("rows") * width)
        return counts.select(
            F.struct("rows", "missing", filled.alias("completeness"), copies.alias("duplicates")).alias("s")
        ).scalar()

    o, n = side(original), side(current)
    one = original.sparkSession.range(1).select(
        o["rows"].alias("rows_before"),
        n["rows"].alias("rows_after"),
        F.lit(len(original.columns)).alias("columns_before"),
        F.lit(len(current.columns)).alias("columns_after"),
        o["completeness"].alias("completeness_before"),
        n["completeness"].alias("completeness_after"),
        o["duplicates"].alias("duplicates_before"),
        n["duplicates"].alias("duplicates_after"),
        (o["missing"] + o["duplicates"]).alias("issues_before"),
        (n["missing"] + n["duplicates"]).alias("pending"),
    )
    return one.withColumn("resolved", F.greatest(F.lit(0), F.col("issues_before") - F.col("pending")))
