"""One row per column: counts, meaning, statistics. Most of it in a single pass without a shuffle."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import names
from ..functions.dates import DATE_FORMATS, day_span, parse_timestamp
from ..functions.missing import (
    BOOLEAN,
    DATETIME,
    NUMERIC,
    TEXT,
    columns_of,
    is_blank,
    kind_of,
    kinds,
    name_col,
    numeric_columns,
    parse_number_sql,
    strip,
    text_literal,
    value,
    value_sql,
    without_nan,
)
from ..functions.stats import excess_kurtosis, percent, sample_std, skew
from ..functions.text import CURRENCY_SYMBOLS, strip_number
from .ordering import _nothing, column_fences, row_label, spread, top_values

# Pairs of words (after trimming and lower-casing) that mean yes / no.
BOOLEAN_SETS = (
    ("true", "false"),
    ("1", "0"),
    ("1.0", "0.0"),
    ("yes", "no"),
    ("y", "n"),
    ("t", "f"),
    ("active", "inactive"),
    ("enable", "disable"),
    ("enabled", "disabled"),
)
SEMANTIC_TYPES = ("Numeric", "Categorical", "Date/Time", "Text", "Boolean")


def _double(c: Column) -> Column:
    return c.cast("double")


def column_counts(df: DataFrame) -> DataFrame:
    """(position, column, dtype, kind, rows, non_null, missing, missing_pct) in one pass."""
    cells = [
        f"named_struct('column', {text_literal(c)}, 'rows', count(1), 'non_null', count({value_sql(df, c)}))"
        for c in df.columns
    ]
    counts = df.agg(F.expr(f"array({', '.join(cells)})").alias("cells")).select(F.inline("cells"))
    return _with_missing(_described(df, counts))


def _with_missing(counts: DataFrame) -> DataFrame:
    missing = F.col("rows") - F.col("non_null")
    return counts.withColumns({"missing": missing, "missing_pct": percent(missing, F.col("rows"))})


def _described(df: DataFrame, per_column: DataFrame) -> DataFrame:
    """Put position, storage type and kind of each column in front of a one-row-per-column table."""
    entries = [
        f"{text_literal(f.name)}, named_struct('position', {i}, 'dtype', {text_literal(f.dataType.simpleString())}, "
        f"'kind', '{kind_of(f.dataType)}')"
        for i, f in enumerate(df.schema.fields)
    ]
    known = F.expr(f"map({', '.join(entries)})[column]")
    rest = [c for c in per_column.columns if c != "column"]
    return per_column.select(
        known["position"].alias("position"), "column", known["dtype"].alias("dtype"), known["kind"].alias("kind"), *rest
    )


def cells(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, present, number, text): one row per cell, numbers as doubles, text as it is.

    Statistics are then one grouped aggregate with a handful of groups, all reduced before the shuffle. The
    plan stays the same size however many columns the table has.
    """
    if not columns:
        return _nothing(df, [], "column string, present boolean, number double, text string")
    kind = kinds(df)
    out = []
    for c in columns:
        v = value_sql(df, c)
        number = f"cast({v} as double)" if kind[c] == NUMERIC else "cast(null as double)"
        text = v if kind[c] == TEXT else "cast(null as string)"
        out.append(
            f"named_struct('column', {text_literal(c)}, 'present', {v} is not null, 'number', {number}, 'text', {text})"
        )
    return df.select(F.expr(f"inline(array({', '.join(out)}))"))


def _number_aggregates() -> dict[str, Column]:
    x = "number"
    return {
        "mean": F.expr(f"avg({x})"),
        "std": sample_std(x),
        "min": F.expr(f"min({x})"),
        "max": F.expr(f"max({x})"),
        "skewness": skew(x),
        "kurtosis": excess_kurtosis(x),
        "zeros": F.expr(f"count_if({x} = 0)"),
        "infinite": F.expr(f"count_if(abs({x}) = double('Infinity'))"),
        "negative": F.expr(f"count_if({x} < 0)"),
        "out_of_percent": F.expr(f"count_if({x} < 0 or {x} > 100)"),
    }


def _text_aggregates() -> dict[str, Column]:
    """Blank, number-like and symbol counts."""
    t = F.col("text")
    return {
        "blank": F.count_if(is_blank(t)),
        "number_like": F.expr(f"count({parse_number_sql('text')})"),
        "currency_like": F.count_if(t.rlike(CURRENCY_SYMBOLS)),
        "percent_like": F.count_if(t.contains("%")),
        "symbol_number_like": F.count(strip_number(t)),
    }


def _date_aggregates() -> dict[str, Column]:
    """How many texts look like, and parse as, dates. Most free text never reaches the parsers."""
    t = F.col("text")
    # No format is shorter than 6 or longer than 40 characters.
    parsable = F.length(F.trim(t)).between(6, 40) & t.rlike(r"\d")
    return {
        "delimited": F.count_if(t.rlike(r"[/\-:\sT]")),
        "date_like": F.count(F.when(parsable, parse_timestamp(t, DATE_FORMATS))),
    }


def column_stats(
    df: DataFrame, columns: list[str] | None = None, numbers: bool = False, texts: bool = False, dates: bool = False
) -> DataFrame:
    """Counts of each column and, on request, number, text and date statistics, in one pass."""
    wanted: dict[str, Column] = {"rows": F.count(F.lit(1)), "non_null": F.count_if("present")}
    wanted |= _number_aggregates() if numbers else {}
    wanted |= _text_aggregates() if texts else {}
    wanted |= _date_aggregates() if dates else {}
    chosen = columns if columns is not None else df.columns
    grouped = cells(df, chosen).groupBy("column").agg(*[c.alias(f) for f, c in wanted.items()])
    out = _with_missing(_described(df, grouped))
    if not numbers:
        return out
    # A negative or out-of-range number is only suspicious where the column name says so.
    limited = {"negative": names.is_non_negative, "out_of_percent": names.is_percentage}
    checked = {f: F.when(named(chosen, rule), F.col(f)).otherwise(0) for f, rule in limited.items()}
    return out.withColumns(checked | {"variance": F.col("std") * F.col("std")})


def named(columns: list[str], rule) -> Column:
    """True for rows whose ``column`` satisfies a rule about names."""
    hits = [c for c in columns if rule(c)]
    return F.col("column").isin(hits) if hits else F.lit(False)


def boolean_words() -> Column:
    """With at most two distinct values, the smallest and the largest are all of them."""
    low, high = F.lower(strip(F.col("low_value"))), F.lower(strip(F.col("high_value")))
    fits = [low.isin(*pair) & high.isin(*pair) for pair in BOOLEAN_SETS]
    return F.col("kind").isin(NUMERIC, TEXT) & reduce(Column.__or__, fits)


def semantic_type() -> Column:
    """Meaning of a column from its profile row (see ``column_types``)."""
    c = F.col
    ratio = F.try_divide(_double(c("distinct")), _double(c("rows")))
    date_like = (F.try_divide(_double(c("delimited")), _double(c("non_null"))) > 0.7) | c("date_named")
    parses = F.try_divide(_double(c("date_like")), _double(c("non_null"))) >= 0.85
    indexed = (c("distinct") == c("rows")) & (c("rows") > 30) & F.lower(c("column")).contains("index")
    few = ((c("distinct") <= 25) & ((ratio <= 0.7) | (c("rows") <= 10))) | (
        (ratio <= 0.20) & (c("distinct") < 100)
    )
    return (
        F.when(c("kind") == BOOLEAN, "Boolean")
        .when(c("non_null") == 0, "Text")
        .when((c("distinct") <= 2) & boolean_words(), "Boolean")
        .when(c("kind") == DATETIME, "Date/Time")
        .when((c("kind") == TEXT) & date_like & parses, "Date/Time")
        .when(c("id_named") & ((ratio >= 0.7) | (c("distinct") > 50)), "Text")
        .when(c("id_named"), "Categorical")
        .when((c("kind") == NUMERIC) & indexed, "Text")
        .when(c("kind") == NUMERIC, "Numeric")
        .when(few, "Categorical")
        .otherwise("Text")
    )


def column_types(df: DataFrame) -> DataFrame:
    """Column counts plus distinct values, most frequent value and ``semantic_type``."""
    return _typed(df, column_stats(df, dates=True))


def _typed(df: DataFrame, stats: DataFrame) -> DataFrame:
    flags = {
        "id_named": named(df.columns, names.is_id_for_typing),
        "date_named": named(df.columns, names.is_date_named),
    }
    joined = stats.join(top_values(df, df.columns), "column").withColumns(flags)
    return joined.withColumn("semantic_type", semantic_type())


def column_profile(df: DataFrame, order_by: list[str] | None = None) -> DataFrame:
    """Type, storage type, counts, distinct values and three sample values per column."""
    out = column_types(df).select(
        "position", "column", "dtype", "semantic_type", "non_null", "missing", "missing_pct", "distinct"
    )
    if order_by is None:
        return out
    return out.join(sample_values(df, df.columns, order_by), "column", "left")


def sample_values(df: DataFrame, columns: list[str], order_by: list[str], n: int = 3) -> DataFrame:
    """First ``n`` present values of each column in ``order_by`` order, joined by a comma.

    One top-n per column over that column and the order keys only: no window over raw rows.
    """
    parts = []
    for c in columns:
        keys = [name_col(o) for o in order_by]
        top = df.where(value(df, c).isNotNull()).orderBy(*keys).limit(n)
        ranked = top.select(F.struct(*keys).alias("o"), value(df, c).cast("string").alias("v"))
        ordered = F.transform(F.array_sort(F.collect_list(F.struct("o", "v"))), lambda x: x["v"])
        parts.append(ranked.agg(row_label(c).alias("column"), F.array_join(ordered, ", ").alias("samples")))
    return reduce(DataFrame.unionByName, parts)


def type_counts(df: DataFrame) -> DataFrame:
    """Number of columns per semantic type."""
    return column_types(df).groupBy("semantic_type").agg(F.count(F.lit(1)).alias("columns"))


def row_digest(df: DataFrame) -> list[Column]:
    """Two 64-bit hashes of the whole row, NULLs included, that stand for it: 16 bytes instead of the row.

    Two different rows among 10^12 agree by chance with a probability below 10^-14. NaN counts as NULL.
    """
    values = [value(df, c) for c in df.columns]
    gaps = F.concat(F.lit(""), *[F.when(v.isNull(), "0").otherwise("1") for v in values])
    return [F.xxhash64(gaps, *values).alias("__h0"), F.xxhash64(F.lit("again"), *values, gaps).alias("__h1")]


def row_counts(df: DataFrame) -> DataFrame:
    """(__h0, __h1, n): copies of each distinct row, counted by digest, so that no row is shuffled."""
    return df.select(*row_digest(df)).groupBy("__h0", "__h1").agg(F.count(F.lit(1)).alias("n"))


def distinct_rows(df: DataFrame) -> DataFrame:
    """One-row table with the number of distinct rows."""
    return row_counts(df).agg(F.count(F.lit(1)).alias("distinct_rows"))


def duplicate_summary(df: DataFrame) -> DataFrame:
    """(rows, duplicate_rows, unique_rows, duplicate_pct)."""
    grouped = row_counts(df)
    totals = grouped.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count("n").alias("unique_rows"))
    extra = F.col("rows") - F.col("unique_rows")
    return totals.select(
        "rows",
        extra.alias("duplicate_rows"),
        "unique_rows",
        percent(extra, F.col("rows")).alias("duplicate_pct"),
    )


def table_summary(df: DataFrame) -> DataFrame:
    """Rows, columns, cells, missing cells and %, columns with missing values, duplicate rows and %."""
    width = len(df.columns)
    totals = column_counts(df).agg(
        F.max("rows").alias("rows"),
        F.sum("missing").alias("missing_cells"),
        F.count_if(F.col("missing") > 0).alias("columns_with_missing"),
    )
    cells = F.col("rows") * width
    duplicates = F.col("rows") - distinct_rows(df).scalar()
    return totals.select(
        "rows",
        F.lit(width).cast("bigint").alias("columns"),
        cells.alias("cells"),
        "missing_cells",
        percent(F.col("missing_cells"), cells).alias("missing_pct"),
        "columns_with_missing",
        duplicates.alias("duplicate_rows"),
        percent(duplicates, F.col("rows")).alias("duplicate_pct"),
    )


def search_rows(
    df: DataFrame, keyword: str, columns: list[str] | None = None, limit: int | None = None
) -> DataFrame:
    """Rows where any shown column contains the keyword, ignoring case. Missing cells never match."""
    shown = df.select(*[name_col(c) for c in (columns or df.columns)])
    word = keyword.strip().lower()
    if word:
        hits = [
            F.coalesce(F.lower(value(shown, c).cast("string")).contains(word), F.lit(False)) for c in shown.columns
        ]
        shown = shown.where(reduce(Column.__or__, hits))
    return shown.limit(limit) if limit is not None else shown


def describe_numeric(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Count, mean, std, min, quartiles, max, skew and number of zeros per numeric column."""
    columns = columns if columns is not None else numeric_columns(df)
    stats = column_stats(df, columns, numbers=True)
    quartiles = column_fences(df, columns).select("column", "q1", "median", "q3")
    return stats.join(quartiles, "column", "left").select(
        "position",
        "column",
        F.col("non_null").alias("count"),
        "mean",
        "std",
        "min",
        "q1",
        "median",
        "q3",
        "max",
        F.col("skewness").alias("skew"),
        "zeros",
    )


def describe_categorical(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Total, distinct, uniqueness %, most frequent value with count and % per text column."""
    columns = columns if columns is not None else columns_of(df, TEXT)
    counts = column_counts(df)
    return counts.join(top_values(df, columns), "column").select(
        "column",
        F.col("non_null").alias("total"),
        "distinct",
        percent(F.col("distinct"), F.col("non_null")).alias("unique_pct"),
        "top_value",
        "top_count",
        percent(F.col("top_count"), F.col("non_null")).alias("top_pct"),
    )


def describe_dates(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Valid count, first and last day and whole days between, for date or date-text columns."""
    columns = columns if columns is not None else columns_of(df, DATETIME)
    if not columns:
        return _nothing(df, [], "column string, valid bigint, first_day string, last_day string, span_days bigint")
    parts = []
    for name in columns:
        c = as_timestamp(df, name)
        span = df.agg(F.count(c).alias("valid"), F.min(c).alias("lo"), F.max(c).alias("hi"))
        parts.append(span.withColumn("column", F.lit(name)))
    return reduce(DataFrame.unionByName, parts).where(F.col("valid") > 0).select(
        "column",
        "valid",
        F.date_format("lo", "yyyy-MM-dd").alias("first_day"),
        F.date_format("hi", "yyyy-MM-dd").alias("last_day"),
        day_span(F.col("lo"), F.col("hi")).alias("span_days"),
    )


def as_timestamp(df: DataFrame, name: str) -> Column:
    """A date, timestamp or text column as a timestamp, NULL when it cannot be read."""
    c = name_col(name)
    return parse_timestamp(c) if kinds(df)[name] == TEXT else c.cast("timestamp_ntz")


def health_snapshot(df: DataFrame) -> DataFrame:
    """Columns with missing values next to the table's totals."""
    missing = column_counts(df).where(F.col("missing") > 0)
    totals = table_summary(df).select(
        F.struct("missing_cells", "missing_pct", "duplicate_rows", "duplicate_pct").alias("t")
    )
    whole = totals.scalar()
    return missing.select(
        "column",
        "missing",
        "missing_pct",
        whole["missing_cells"].alias("table_missing_cells"),
        whole["missing_pct"].alias("table_missing_pct"),
        whole["duplicate_rows"].alias("table_duplicate_rows"),
        whole["duplicate_pct"].alias("table_duplicate_pct"),
    )


def full_profile(df: DataFrame) -> DataFrame:
    """Everything the audit and the decisions need, one row per column."""
    stats = _typed(df, column_stats(df, numbers=True, texts=True, dates=True))
    numeric = numeric_columns(df)
    fields = ["q1", "median", "q3", "iqr", "lower", "upper"]
    if not numeric:
        none = F.lit(None).cast("double")
        return stats.withColumns(dict.fromkeys(fields, none) | {"outliers": F.lit(0).cast("bigint")})
    quartiles = spread(df, numeric).select("column", *fields, "outliers")
    joined = stats.join(quartiles, "column", "left")
    return joined.withColumn("outliers", F.coalesce("outliers", F.lit(0)))


def ranked(df: DataFrame, *order: Column, name: str = "rank") -> DataFrame:
    """Number the rows of a small report. Not for raw rows: it sorts in one task."""
    return df.withColumn(name, F.row_number().over(Window.orderBy(*order)))
