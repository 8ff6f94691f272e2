"""Questions about a table: which question asks for what, and the data behind each kind of answer."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.missing import name_col, number, numeric_columns, present, value
from ..functions.stats import percent
from .ordering import column_fences, exact_quantiles, value_counts
from .profile import column_counts, duplicate_summary, table_summary
from .quality import Audit
from .statistics import correlations, outlier_summary, strongest_pairs

# The phrases of each kind of question, in the order they are tried.
GREETINGS = [
    "hi", "hii", "hiii", "hello", "hey", "heyy", "namaste", "hola", "greetings", "good morning", "good afternoon", "good evening",
]
PHRASES: dict[str, list[str]] = {
    "help": ["help", "what can you do", "who are you", "how to use", "what are you"],
    "schema": [
        "what are the column", "list column", "show column", "column name", "column list",
        "schema", "features", "data type", "dtypes",
    ],
    "shape": [
        "how many row", "row count", "how many col", "shape", "size", "dimension", "rows and column", "total record",
    ],
    "quality": ["quality", "health", "score", "how clean", "cleanliness", "audit"],
    "missing": ["missing", "null", "nan", "blank", "empty"],
    "duplicates": ["duplicate", "duplicate row", "repeats", "redundant", "dedup"],
    "grouped": [" by ", " across ", " per ", " grouped by "],
    "extreme": [
        "highest", "maximum", "max ", "max of", "top ", "most expensive", "cheapest", "lowest", "minimum",
        "min ", "min of", "best", "worst", "oldest", "youngest",
    ],
    "column_stats": ["average", "mean", "median", "describe", "summary", "stats", "distribution", "variance", "std"],
    "correlation": ["correlation", "correlated", "relationship", "relation", "driver", "factors"],
    "outliers": ["outlier", "anomaly", "anomalies", "extreme", "abnormal"],
    "preview": ["sample", "preview", "first 5", "first 10", "head", "show data", "table"],
}
LOWEST = ["lowest", "minimum", "min ", "cheapest", "worst", "youngest"]


def _has_any(c: Column, phrases: list[str]) -> Column:
    return reduce(Column.__or__, [c.contains(p) for p in phrases])


def _clean(c: Column) -> Column:
    """Lower case with punctuation as spaces."""
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}_\s]", " ")


def _prepared(questions: DataFrame, text: str) -> DataFrame:
    """Add the lower-cased, cleaned and split question once, for all tests on it."""
    q = name_col(text)
    cleaned = questions.withColumns({"__lower": F.lower(q), "__clean": _clean(q)})
    words = F.array_distinct(F.filter(F.split("__clean", r"\s+"), lambda w: w != ""))
    return cleaned.withColumn("__words", words)


def match_scores(columns: list[str]) -> Column:
    """Array of (level, weakness, position, column) over a prepared question, columns that miss left out.

    Level 1: the name occurs in the question; 2: all its words do; 3: some of its words do.
    The array is bounded by the number of columns and built per question, without a join.
    """
    lowered, clean, words = F.col("__lower"), F.col("__clean"), F.col("__words")
    entries = []
    for i, name in enumerate(columns):
        low = name.lower()
        parts = "".join(ch if ch.isalnum() or ch == "_" or ch.isspace() else " " for ch in low)
        own = list(dict.fromkeys(parts.split()))
        overlap = F.size(F.array_intersect(F.array(*[F.lit(w) for w in own]), words)) if own else F.lit(0)
        level = (
            F.when(lowered.contains(low) | clean.contains(parts.strip()), 1)
            .when(F.lit(bool(own)) & (overlap == len(own)), 2)
            .when(overlap > 0, 3)
        )
        entries.append(
            F.struct(
                level.alias("level"),
                F.when(level == 3, -overlap).otherwise(0).alias("weakness"),
                F.lit(i).alias("position"),
                F.lit(name).alias("column"),
            )
        )
    return F.filter(F.array(*entries), lambda e: e["level"].isNotNull())


def _best(columns: list[str]) -> Column:
    """The best fitting column of a prepared question as a struct, or NULL."""
    if not columns:
        return F.lit(None).cast("struct<level:int,weakness:int,position:int,column:string>")
    return F.array_min(match_scores(columns))


def match_columns(questions: DataFrame, text: str, columns: list[str]) -> DataFrame:
    """Each question with its best column, how it matched, and all columns it names."""
    scored = _prepared(questions, text).withColumn("__best", _best(columns))
    lowered = F.col("__lower")
    named = [
        F.when(lowered.contains(c.lower()) | lowered.contains(c.lower().replace("_", " ")), F.lit(c)) for c in columns
    ]
    mentioned = F.array_join(F.array_compact(F.array(*named)), ", ")
    return scored.select(
        *[name_col(c) for c in questions.columns],
        F.col("__best.column").alias("best_column"),
        F.col("__best.level").alias("match_level"),
        mentioned.alias("mentioned"),
    )


def intents(questions: DataFrame, text: str, numeric: list[str], other: list[str]) -> DataFrame:
    """Each question with the first kind of question it fits, given the table's numeric and other columns."""
    q = F.lower(F.trim(name_col(text)))
    greeting = q.isin(GREETINGS) | reduce(Column.__or__, [q.startswith(g + " ") for g in GREETINGS])

    def says(kind: str) -> Column:
        return _has_any(q, PHRASES[kind])

    matched = _prepared(questions, text).withColumns({"__numeric": _best(numeric), "__other": _best(other)})
    has_numeric, has_other = F.col("__numeric").isNotNull(), F.col("__other").isNotNull()
    can_group = F.lit(bool(numeric) and bool(other))
    rules = [
        (greeting | says("help"), "greeting"),
        (says("schema"), "schema"),
        (says("shape"), "shape"),
        (says("quality"), "quality"),
        (says("missing"), "missing"),
        (says("duplicates"), "duplicates"),
        (says("grouped") & can_group, "grouped"),
        (says("extreme") & has_numeric, "extreme"),
        (says("column_stats") & has_numeric, "column_stats"),
        (has_other, "category_profile"),
        (says("correlation"), "correlation"),
        (says("outliers"), "outliers"),
        (says("preview"), "preview"),
    ]
    label = F
    for rule, name in rules:
        label = label.when(rule, name)
    return matched.select(*[name_col(c) for c in questions.columns], label.otherwise("default").alias("intent"))


# --- answers -------------------------------------------------------------------------------------------------


def grouped_answer(df: DataFrame, metric: str, by: str, n: int = 10) -> DataFrame:
    """Mean, sum and count of a metric per category, highest mean first."""
    rows = present(df, [by])
    v = number(df, metric)
    out = rows.groupBy(name_col(by)).agg(
        F.avg(v).alias("mean"), F.coalesce(F.sum(v), F.lit(0.0)).alias("sum"), F.count(v).alias("count")
    )
    return out.orderBy(F.col("mean").desc_nulls_last(), name_col(by)).limit(n)


def extreme_answer(df: DataFrame, column: str, order_by: list[str], lowest: bool = False) -> DataFrame:
    """The first record with the smallest or largest value, with mean, median and count of the column."""
    v = value(df, column)
    keys = [name_col(o) for o in order_by]
    order = [v.asc() if lowest else v.desc(), *[k.asc() for k in keys]]
    record = df.where(v.isNotNull()).orderBy(*order).limit(1)
    stats = df.agg(F.struct(F.avg(v.cast("double")).alias("mean"), F.count(v).alias("n")).alias("s")).scalar()
    median = exact_quantiles(df, [column], [0.5]).select(F.col("quantiles")[0]).scalar()
    return record.select(
        *[name_col(c) for c in df.columns],
        stats["mean"].alias("column_mean"),
        median.alias("column_median"),
        stats["n"].alias("column_count"),
    )


def column_answer(df: DataFrame, column: str) -> DataFrame:
    """Mean, median, std, range, quartiles and count of one column."""
    v = number(df, column)
    q = column_fences(df, [column]).select(F.struct("quantiles").alias("q")).scalar()["quantiles"]
    one = df.agg(
        F.avg(v).alias("mean"),
        F.stddev_samp(v).alias("std"),
        F.min(v).alias("min"),
        F.max(v).alias("max"),
        F.count(v).alias("count"),
    )
    return one.select(
        F.lit(column).alias("column"),
        "mean",
        q[1].alias("median"),
        "std",
        "min",
        "max",
        q[0].alias("q1"),
        q[2].alias("q3"),
        "count",
    )


def category_answer(df: DataFrame, column: str, n: int = 5) -> DataFrame:
    """Most frequent values with count and % of all rows, and the number of distinct values."""
    counts = value_counts(df, column)
    distinct = counts.agg(F.count(F.lit(1))).scalar()
    rows = df.agg(F.count(F.lit(1))).scalar()
    top = counts.orderBy(F.col("n").desc(), F.col("value")).limit(n)
    return top.select(
        F.col("value").cast("string").alias("value"),
        F.col("n").alias("count"),
        percent(F.col("n"), rows).alias("pct_of_rows"),
        distinct.alias("distinct"),
    )


def missing_answer(df: DataFrame, n: int = 6) -> DataFrame:
    """Columns with the most missing values."""
    gaps = column_counts(df).where(F.col("missing") > 0)
    return gaps.orderBy(F.col("missing").desc(), "position").limit(n).select("column", "missing", "missing_pct")


def duplicates_answer(df: DataFrame) -> DataFrame:
    return duplicate_summary(df).select("rows", "duplicate_rows", "duplicate_pct")


def shape_answer(df: DataFrame) -> DataFrame:
    """Rows, columns, cells, completeness and the number of numeric and other columns."""
    numeric = len(numeric_columns(df))
    counts = column_counts(df).agg(F.max("rows").alias("rows"), F.sum("missing").alias("missing"))
    cells = F.col("rows") * len(df.columns)
    return counts.select(
        "rows",
        F.lit(len(df.columns)).alias("columns"),
        cells.alias("cells"),
        F.lit(numeric).alias("numeric_columns"),
        F.lit(len(df.columns) - numeric).alias("other_columns"),
        (100.0 - percent(F.col("missing"), cells)).alias("completeness"),
    )


def schema_answer(df: DataFrame) -> DataFrame:
    """Name, storage type and present values of each column."""
    return column_counts(df).select("position", "column", "dtype", "non_null")


def quality_answer(df: DataFrame) -> DataFrame:
    """The audit score with missing and duplicate rates."""
    whole = table_summary(df).select(
        F.struct("missing_cells", "missing_pct", "duplicate_rows", "duplicate_pct").alias("t")
    ).scalar()
    fields = ["missing_cells", "missing_pct", "duplicate_rows", "duplicate_pct"]
    return Audit(df, share=False).breakdown().select("score", "status", *[whole[f].alias(f) for f in fields])


def correlation_answer(df: DataFrame, n: int | None = None) -> DataFrame:
    """The two strongest positive and negative pairs among all numeric columns, or the first ``n``."""
    return strongest_pairs(correlations(df, numeric_columns(df)[:n]), 2)


def outlier_answer(df: DataFrame, n: int | None = None) -> DataFrame:
    """Columns with outliers among all numeric ones, or the first ``n``: count, % and fences."""
    found = outlier_summary(df, numeric_columns(df)[:n]).where(F.col("outlier_count") > 0)
    return found.select("column", "outlier_count", "outlier_pct", "lower", "upper")


def preview(df: DataFrame, order_by: list[str], n: int = 5) -> DataFrame:
    return df.orderBy(*[name_col(o) for o in order_by]).limit(n)
