"""Quality audit: missing values, duplicates, structure, validity, outliers, score and issues.

Every rule is a CASE over the profile (one row per column), so the data itself is read by the profile and
the duplicate count only, whatever the number of rules.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import names
from ..functions.missing import (
    TEXT,
    kinds,
    name_col,
    numeric_columns,
    parse_number,
    strip,
    value,
)
from ..functions.stats import clamp, percent, tiers
from ..functions.text import fixed
from .copies import copied_rows
from .ordering import spread, top_values
from .profile import column_counts, column_stats, duplicate_summary, full_profile, named, ranked, sample_values

SEVERITIES = ("CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO")
WHOLE_TABLE = "Dataset (All Rows)"


def severity_rank(c: Column) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), c)


def missing_severity(pct: Column) -> Column:
    return (
        F.when(pct == 0, "Healthy")
        .when(pct <= 5.0, "Low")
        .when(pct <= 20.0, "Moderate")
        .when(pct <= 50.0, "High")
        .otherwise("Critical")
    )


def missing_analysis(df: DataFrame) -> DataFrame:
    """Missing count, % and severity per column, worst first."""
    out = column_counts(df).select(
        "position",
        "column",
        "missing",
        "missing_pct",
        "non_null",
        missing_severity(F.col("missing_pct")).alias("severity"),
    )
    return out.orderBy(F.col("missing_pct").desc(), "position")


def duplicate_groups(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys..., copies) for every key that occurs more than once; the default key is the whole row.

    Only rows that may have a copy are grouped; the others are told by their digest and never shuffled.
    """
    keys = keys or df.columns
    only = df.select(*[name_col(k) for k in keys])
    grouped = copied_rows(only).groupBy(*[name_col(k) for k in keys]).agg(F.count(F.lit(1)).alias("copies"))
    return grouped.where(F.col("copies") > 1)


# Copies of one row written by one task when duplicated rows are listed in full.
COPIES_PER_TASK_ROW = 100_000


def duplicate_rows(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """All copies of duplicated rows.

    Copies of a whole row are equal, so they are listed from (row, copies): in chunks that are spread over
    the tasks before the last step, so a row with very many copies is no bottleneck. With key columns the
    rows differ; they come from a semi join against the duplicated keys, whose hot keys AQE's skew join splits. Rows whose
    digest occurs once take no part.
    """
    if not keys or set(keys) == set(df.columns):
        groups = duplicate_groups(df)
        last = F.floor((F.col("copies") - 1) / COPIES_PER_TASK_ROW).cast("int")
        chunks = groups.withColumn("__chunk", F.explode(F.sequence(F.lit(0), last)))
        size = F.least(F.lit(COPIES_PER_TASK_ROW), F.col("copies") - F.col("__chunk") * COPIES_PER_TASK_ROW)
        spread_out = chunks.withColumn("__size", size.cast("int")).hint("rebalance")
        listed = spread_out.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__size"))))
        return listed.select(*[name_col(c) for c in df.columns])
    groups = duplicate_groups(df, keys).alias("g")
    rows = copied_rows(df, keys).alias("r")
    match = reduce(
        Column.__and__, [F.col(f"r.`{k}`").eqNullSafe(F.col(f"g.`{k}`")) for k in keys]
    )
    return rows.join(groups, match, "left_semi")


def duplicate_columns(df: DataFrame) -> DataFrame:
    """(column_a, column_b): pairs of the same type with identical values on every row.

    A first pass compares one hash sum and one null count per column; only pairs that agree on both are
    compared value by value, all in one second pass.
    """
    names_ = df.columns
    sums = [F.sum(F.xxhash64(value(df, c)).cast("decimal(38,0)")).cast("string") for c in names_]
    nulls = [F.count_if(value(df, c).isNull()) for c in names_]
    row = df.agg(*[s.alias(f"s{i}") for i, s in enumerate(sums)], *[n.alias(f"n{i}") for i, n in enumerate(nulls)])
    found = row.first()
    signature = [(df.schema[c].dataType, found[f"s{i}"], found[f"n{i}"]) for i, c in enumerate(names_)]
    pairs = [
        (a, b)
        for i, a in enumerate(names_)
        for j, b in enumerate(names_)
        if i < j and signature[i] == signature[j]
    ]
    schema = "column_a string, column_b string"
    if not pairs:
        return df.sparkSession.createDataFrame([], schema)
    cells = F.array(
        *[
            F.struct(
                F.lit(a).alias("column_a"),
                F.lit(b).alias("column_b"),
                F.count_if(~value(df, a).eqNullSafe(value(df, b))).alias("different"),
            )
            for a, b in pairs
        ]
    )
    checked = df.agg(cells.alias("cells")).select(F.inline("cells"))
    return checked.where(F.col("different") == 0).select("column_a", "column_b")


# --- rules over one profile row -------------------------------------------------------------------------


def empty_rule() -> Column:
    return F.col("non_null") == 0


def constant_rule() -> Column:
    return (F.col("distinct") == 1) & (F.col("rows") > 1)


def _distinct_pct() -> Column:
    return percent(F.col("distinct"), F.col("rows"))


def high_cardinality_rule(columns: list[str]) -> Column:
    return (F.col("distinct") > 50) & (_distinct_pct() >= 85.0) & ~named(columns, names.is_id)


def mixed_count() -> Column:
    return F.col("non_null") - F.col("number_like")


def mixed_rule() -> Column:
    ratio = F.try_divide(F.col("number_like").cast("double"), F.col("non_null").cast("double"))
    return (F.col("kind") == TEXT) & (F.col("non_null") >= 10) & (ratio > 0.15) & (ratio < 0.98)


def mixed_pct() -> Column:
    return percent(mixed_count(), F.col("non_null"))


def outlier_rule(columns: list[str]) -> Column:
    """The audit looks at a column when it is numeric, not an ID, and has some spread."""
    return (
        F.col("iqr").isNotNull()
        & (F.col("non_null") >= 5)
        & (F.col("distinct") > 2)
        & ~named(columns, names.is_id)
    )


def outlier_pct() -> Column:
    return percent(F.col("outliers"), F.col("non_null"))


def structure(df: DataFrame, profile: DataFrame | None = None) -> DataFrame:
    """(column, finding, detail, measure) for empty, constant and high-cardinality columns."""
    p = profile if profile is not None else column_counts(df).join(top_values(df, df.columns), "column")
    c = F.col
    findings = [
        _finding(empty_rule(), "empty", F.lit(None).cast("string"), F.lit(100.0)),
        _finding(constant_rule(), "constant", c("top_value"), c("non_null").cast("double")),
        _finding(high_cardinality_rule(df.columns), "high_cardinality", c("distinct").cast("string"), _distinct_pct()),
    ]
    return _explode_found(p.select("column", F.array(*findings).alias("found")))


def _finding(rule: Column, label: str, detail: Column, measure: Column) -> Column:
    return F.when(
        rule, F.struct(F.lit(label).alias("finding"), detail.alias("detail"), measure.alias("measure"))
    )


def _explode_found(df: DataFrame) -> DataFrame:
    kept = df.withColumn("found", F.filter("found", lambda x: x.isNotNull()))
    return kept.select(*[c for c in df.columns if c != "found"], F.inline("found"))


def mixed_types(df: DataFrame, order_by: list[str]) -> DataFrame:
    """Text columns that hold numbers and other text: count, % and three samples of the other text."""
    text = [c for c, k in kinds(df).items() if k == TEXT]
    counted = column_stats(df, text, texts=True)
    bad = df.select(
        *[name_col(o).alias(f"__o{i}") for i, o in enumerate(order_by)],
        *[F.when(parse_number(name_col(c)).isNull(), strip(name_col(c))).alias(c) for c in text],
    )
    samples = sample_values(bad, text, [f"__o{i}" for i in range(len(order_by))])
    return (
        counted.where(mixed_rule())
        .join(samples, "column", "left")
        .select("column", mixed_count().alias("count"), mixed_pct().alias("pct"), "samples")
    )


def _validity_findings(df: DataFrame) -> list[Column]:
    c, rows = F.col, F.col("rows")

    def found(label: str, count: Column, severity: Column, rule: Column) -> Column:
        return F.when(
            rule & (count > 0),
            F.struct(
                F.lit(label).alias("issue"),
                count.alias("count"),
                percent(count, rows).alias("pct"),
                severity.alias("severity"),
            ),
        )

    blank_severity = F.when(percent(c("blank"), rows) < 5, "LOW").otherwise("MEDIUM")
    negative_severity = F.when(F.lower("column").contains("age"), "HIGH").otherwise("MEDIUM")
    any_column = F.lit(True)
    # Names and severities of the issues.
    return [
        found("Whitespace / Blank Strings", c("blank"), blank_severity, any_column),
        found("Infinite Numeric Values", c("infinite"), F.lit("HIGH"), any_column),
        found("Unexpected Negative Values", c("negative"), negative_severity, any_column),
        found("Out-of-Bounds Percentage", c("out_of_percent"), F.lit("MEDIUM"), any_column),
    ]


def validity(df: DataFrame, profile: DataFrame | None = None) -> DataFrame:
    """(column, issue, count, pct, severity): blanks, infinities, negatives, impossible percentages."""
    p = profile if profile is not None else column_stats(df, numbers=True, texts=True)
    return _explode_found(p.select("position", "column", F.array(*_validity_findings(df)).alias("found")))


def _numeric_profile(df: DataFrame) -> DataFrame:
    numeric = numeric_columns(df)
    counts = column_counts(df).join(top_values(df, numeric), "column")
    return counts.join(spread(df, numeric), "column")


def audit_outliers(df: DataFrame, profile: DataFrame | None = None) -> DataFrame:
    """Columns with IQR outliers: count, %, rounded fences and extremes, highest share first."""
    p = profile if profile is not None else _numeric_profile(df)
    hit = p.where(outlier_rule(df.columns) & (F.col("iqr") > 0) & (F.col("outliers") > 0))
    return hit.select(
        "column",
        F.col("outliers").alias("outlier_count"),
        outlier_pct().alias("outlier_pct"),
        *[F.round(x, 2).alias(x) for x in ("lower", "upper", "min", "max")],
    ).orderBy(F.col("outlier_pct").desc(), "column")


def grade(score: Column) -> Column:
    return tiers(score, (90.0, "A"), (80.0, "B"), (70.0, "C"), (60.0, "D"), otherwise="F")


def status(score: Column) -> Column:
    return tiers(
        score, (90.0, "Excellent"), (75.0, "Good"), (60.0, "Needs Attention"), (40.0, "Poor"), otherwise="Critical"
    )


@dataclass
class Audit:
    """One audit of one table. Its parts are small DataFrames over one shared profile.

    With ``share`` the profile (one row per column) and the duplicate summary (one row) are computed on first
    use and kept as local tables, so several parts of the same audit read the data once. Without it every part
    is one lazy plan from the source.
    """

    df: DataFrame
    share: bool = True

    @cached_property
    def profile(self) -> DataFrame:
        return self._keep(full_profile(self.df))

    @cached_property
    def duplicates(self) -> DataFrame:
        return self._keep(duplicate_summary(self.df))

    @cached_property
    def duplicate_columns(self) -> DataFrame:
        return duplicate_columns(self.df)

    def _keep(self, small: DataFrame) -> DataFrame:
        return small.sparkSession.createDataFrame(small.collect(), small.schema) if self.share else small

    def breakdown(self) -> DataFrame:
        """One row: five dimension scores (unrounded inputs), overall score, grade and status."""
        columns = self.df.columns
        width = len(columns)
        c = F.col
        invalid = c("blank") + c("infinite") + c("negative") + c("out_of_percent")
        checked = outlier_rule(columns)
        totals = self.profile.agg(
            F.max("rows").alias("rows"),
            F.sum("missing").alias("missing"),
            F.count_if(empty_rule()).alias("empty"),
            F.count_if(constant_rule()).alias("constant"),
            F.coalesce(F.sum(F.when(mixed_rule(), mixed_pct())), F.lit(0.0)).alias("mixed"),
            F.sum(invalid).alias("invalid"),
            F.coalesce(F.sum(F.when(checked & (c("iqr") > 0), c("outliers"))), F.lit(0)).alias("outliers"),
            F.coalesce(F.sum(F.when(checked, c("non_null"))), F.lit(0)).alias("numeric_cells"),
        )
        cells = c("rows") * width
        duplicate_pct = self.duplicates.select("duplicate_pct").scalar()
        pairs = self.duplicate_columns.agg(F.count(F.lit(1)).alias("n")).scalar()
        parts = totals.select(
            clamp(100.0 - percent(c("missing"), cells) - c("empty") * 10.0).alias("completeness"),
            clamp(100.0 - duplicate_pct * 2.5 - pairs * 10.0).alias("uniqueness"),
            clamp(100.0 - c("constant") * 6.0 - c("mixed") * 0.5).alias("consistency"),
            clamp(100.0 - percent(c("invalid"), cells) * 3.5).alias("validity"),
            clamp(100.0 - percent(c("outliers"), c("numeric_cells")) * 2.5).alias("outlier_health"),
        )
        overall = (
            c("completeness") * 0.30
            + c("uniqueness") * 0.20
            + c("consistency") * 0.20
            + c("validity") * 0.15
            + c("outlier_health") * 0.15
        )
        dimensions = ["completeness", "uniqueness", "consistency", "validity", "outlier_health"]
        scored = parts.withColumn("score", F.round(clamp(overall), 1))
        return scored.select(
            "score",
            grade(c("score")).alias("grade"),
            status(c("score")).alias("status"),
            *[F.round(d, 1).alias(d) for d in dimensions],
        )

    def score(self) -> Column:
        """The overall score as a value for other plans."""
        return self.breakdown().select("score").scalar()

    def _column_issues(self) -> DataFrame:
        """(column, severity, category, issue, measure, penalty, note, strong) from the profile."""
        c = F.col
        pct = c("missing_pct")

        def issue(rule, severity, category, label, measure, penalty, note=None, strong=None) -> Column:
            return F.when(
                rule,
                F.struct(
                    severity.alias("severity"),
                    F.lit(category).alias("category"),
                    label.alias("issue"),
                    measure.cast("double").alias("measure"),
                    penalty.cast("double").alias("penalty"),
                    (note if note is not None else F.lit(None).cast("string")).alias("note"),
                    (strong if strong is not None else F.lit(False)).alias("strong"),
                ),
            )

        missing_severity_ = tiers(pct, (50.0, "CRITICAL"), (20.0, "HIGH"), (5.0, "MEDIUM"), otherwise="LOW")
        missing_penalty = F.when(pct >= 50, 30).when(pct >= 20, 20).when(pct >= 5, 10).otherwise(4)
        shown_pct = fixed(pct, 1)
        outlier_hit = outlier_rule(self.df.columns) & (c("iqr") > 0) & (outlier_pct() >= 5.0)
        rules = [
            issue(
                empty_rule(), F.lit("CRITICAL"), "Structure", F.lit("Completely Empty Column"),
                F.lit(100.0), F.lit(50), F.lit("100% empty column"), F.lit(True),
            ),
            issue(
                pct > 0, missing_severity_, "Missing Values", F.concat(shown_pct, F.lit("% Missing Values")),
                pct, missing_penalty, F.concat(shown_pct, F.lit("% missing values")), missing_penalty >= 20,
            ),
            issue(
                constant_rule(), F.lit("MEDIUM"), "Consistency", F.lit("Constant Single Value"),
                F.lit(1.0), F.lit(15), F.concat(F.lit("Constant value ('"), c("top_value"), F.lit("')")),
            ),
            issue(
                mixed_rule(), F.lit("HIGH"), "Consistency", F.lit("Mixed Numeric & Text Values"),
                mixed_pct(), F.lit(20), F.lit("Mixed data types"), F.lit(True),
            ),
            issue(
                outlier_hit, F.when(outlier_pct() < 15.0, "MEDIUM").otherwise("HIGH"), "Outliers",
                F.concat(c("outliers").cast("string"), F.lit(" Extreme Outliers")), outlier_pct(), F.lit(10),
            ),
        ]
        for finding in _validity_findings(self.df):
            rules.append(
                issue(
                    finding.isNotNull(), finding["severity"], "Validity", finding["issue"],
                    finding["pct"], F.lit(12),
                )
            )
        return _explode_found(self.profile.select("position", "column", F.array(*rules).alias("found")))

    def issues(self) -> DataFrame:
        """(rank, severity, category, column, issue, measure), most severe first."""
        fields = ["severity", "category", "column", "issue", "measure"]
        per_column = self._column_issues().select(*fields)
        share = F.col("duplicate_pct")
        rows = self.duplicates.where(F.col("duplicate_rows") > 0).select(
            tiers(share, (20.0, "HIGH"), (5.0, "MEDIUM"), otherwise="LOW").alias("severity"),
            F.lit("Duplicates").alias("category"),
            F.lit(WHOLE_TABLE).alias("column"),
            F.concat(F.format_number("duplicate_rows", 0), F.lit(" Duplicate Records")).alias("issue"),
            share.alias("measure"),
        )
        pairs = self.duplicate_columns.select(
            F.lit("HIGH").alias("severity"),
            F.lit("Duplicates").alias("category"),
            F.concat("column_a", F.lit(" ↔ "), "column_b").alias("column"),
            F.lit("Duplicate Column Content").alias("issue"),
            F.lit(100.0).alias("measure"),
        )
        every = per_column.unionByName(rows).unionByName(pairs)
        order = [severity_rank(F.col("severity")), F.col("measure").desc(), F.col("category"), F.col("column"), F.col("issue")]
        return ranked(every, *order).select("rank", *fields).orderBy("rank")

    def column_scores(self) -> DataFrame:
        """(column, quality_score, tier, main_issue), worst column first."""
        found = self._column_issues()
        copies = self.duplicate_columns.groupBy(F.col("column_b").alias("column")).agg(
            (F.count(F.lit(1)) * 25.0).alias("copy_penalty")
        )
        penalties = found.groupBy("column").agg(
            F.sum("penalty").alias("penalty"),
            # A strong finding replaces an earlier note; the last strong one wins, else the first weak one.
            F.max_by("note", F.when(F.col("strong") & F.col("note").isNotNull(), _note_order())).alias("strong_note"),
            F.min_by("note", F.when(F.col("note").isNotNull(), _note_order())).alias("weak_note"),
        )
        score = clamp(
            100.0 - F.coalesce("penalty", F.lit(0.0)) - F.coalesce("copy_penalty", F.lit(0.0))
        )
        listed = [(i, c) for i, c in enumerate(self.df.columns)]
        every = self.df.sparkSession.createDataFrame(listed, "position int, column string")
        joined = every.join(penalties, "column", "left").join(copies, "column", "left")
        scored = joined.select(
            "position",
            "column",
            F.round(score, 1).alias("quality_score"),
            F.coalesce("strong_note", "weak_note", F.lit("Clean")).alias("main_issue"),
        )
        tier = tiers(
            F.col("quality_score"), (90, "Healthy"), (75, "Low"), (60, "Moderate"), (40, "High"), otherwise="Critical"
        )
        return scored.withColumn("tier", tier).orderBy("quality_score", "position")

    def report(self) -> DataFrame:
        """One row: size, missing, duplicates, score, grade, status and number of issues per severity."""
        width = len(self.df.columns)
        issues = self.issues()
        by_severity = issues.agg(
            F.struct(
                F.count(F.lit(1)).alias("issues"),
                *[F.count_if(F.col("severity") == s).alias(s.lower()) for s in SEVERITIES[:4]],
            ).alias("s")
        ).scalar()
        d = self.duplicates.select(F.struct("duplicate_rows", "duplicate_pct").alias("d")).scalar()
        totals = self.profile.agg(F.max("rows").alias("rows"), F.sum("missing").alias("missing")).select(
            F.struct("rows", "missing").alias("t")
        ).scalar()
        pairs = self.duplicate_columns.agg(F.count(F.lit(1)).alias("n")).scalar()
        return self.breakdown().select(
            totals["rows"].alias("rows"),
            F.lit(width).cast("bigint").alias("columns"),
            totals["missing"].alias("missing_cells"),
            d["duplicate_rows"].alias("duplicate_rows"),
            pairs.alias("duplicate_column_pairs"),
            "score",
            "grade",
            "status",
            by_severity["issues"].alias("issues"),
            *[by_severity[s.lower()].alias(s.lower()) for s in SEVERITIES[:4]],
        )


def _note_order() -> Column:
    return F.array_position(
        F.array(*[F.lit(x) for x in ("Structure", "Missing Values", "Consistency")]), F.col("category")
    ) + F.when(F.col("issue").startswith("Mixed"), 1).otherwise(0)


def audit(df: DataFrame, share: bool = True) -> Audit:
    return Audit(df, share)
