"""Exact order statistics without sorting a column in one task.

``percentile``, ``median`` and ``mode`` keep every distinct value of a group in one task's memory, and a
window without ``partitionBy`` sorts the whole table in one task. Here, at every size:

1. equal values are counted, so a hot value becomes one row of a table of (value, count);
2. the value axis is cut into ranges that hold about equally many distinct values, as many as that needs;
3. the counts per range, a table bounded by groups x ranges, give every range its starting position;
4. inside a range an ordinary window adds the position of each value.

The limits only decide how work is spread. Any limits give the same, exact result. Columns that are added on the way
have names that begin with two underscores, and group columns take part under such names too, so no name of the
table can meet them.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions.missing import name_col, number, number_sql, text_literal, value, value_sql

# Distinct values that one range should hold.
PER_RANGE = 100_000
# One in so many distinct values, by hash, is looked at to place the limits.
SAMPLED = 64
PROBES = 1_000
RANGE = "__range"


def range_limits(df: DataFrame, exprs: list[Column], per_range: int) -> list[list[float]]:
    """Limits that cut the distinct values of each expression into ranges of about ``per_range``.

    They come from the distinct values whose hash falls into one of ``SAMPLED`` slots: a repeatable sample in which a
    hot value counts once. One row per expression comes back; a column with few values has no limit.
    """
    cells = F.array(*[F.struct(F.lit(i).alias("i"), c.cast("double").alias("v")) for i, c in enumerate(exprs)])
    some = df.select(F.inline(cells)).where(F.col("v").isNotNull() & (F.pmod(F.xxhash64("v"), F.lit(SAMPLED)) == 0))
    sample = some.distinct().groupBy("i")

    def asked(pieces: int) -> dict[int, tuple[int, list[float]]]:
        probs = [k / pieces for k in range(1, pieces)]
        rows = sample.agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("v", probs, 10 * pieces).alias("p")).collect()
        return {r["i"]: (r["n"], r["p"]) for r in rows}

    def needed(n: int) -> int:
        return math.ceil(n * SAMPLED / per_range)

    found = asked(PROBES)
    most = max((needed(n) for n, _ in found.values()), default=1)
    if most > PROBES:
        found = asked(most)
    out = []
    for i in range(len(exprs)):
        n, limits = found.get(i, (0, []))
        pieces = min(needed(n), len(limits) + 1)
        out.append([limits[k * (len(limits) + 1) // pieces - 1] for k in range(1, pieces)])
    return out


def _splits(limits: list[float]) -> list[float]:
    inner = sorted({x for x in limits if math.isfinite(x)}) or [0.0]
    return [-math.inf, *inner, math.inf]


def with_ranges(df: DataFrame, limits: dict[str, list[float]], out: dict[str, str]) -> DataFrame:
    """Add, for each double column, the index of the range its value falls into."""
    names = list(limits)
    ranged = Bucketizer(
        splitsArray=[_splits(limits[n]) for n in names],
        inputCols=names,
        outputCols=[out[n] for n in names],
        handleInvalid="keep",
    ).transform(df)
    return ranged.withColumns({out[n]: F.col(out[n]).cast("int") for n in names})


def _keyed(df: DataFrame, by: list[str]) -> tuple[DataFrame, list[str]]:
    """Rows with every group key present, and the keys under names of their own."""
    rows = df.dropna(subset=by) if by else df
    names = {f"__by{i}": name_col(b) for i, b in enumerate(by)}
    return rows.withColumns(names) if names else rows, list(names)


def _restored(df: DataFrame, by: list[str], *rest: str) -> DataFrame:
    return df.select(*[F.col(f"__by{i}").alias(b) for i, b in enumerate(by)], *rest)


def _counted(df: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    """(by..., column, value, n, __range): one row per distinct value; ``column`` is the column's number.

    Equal values are counted before the shuffle and after it; only then does each get its range.
    """
    cells = [f"named_struct('column', {i}, 'value', {number_sql(df, c)})" for i, c in enumerate(columns)]
    long = df.select(*by, F.expr(f"inline(array({', '.join(cells)}))")).where("value is not null")
    return ranged(long.groupBy(*by, "column", "value").agg(F.count(F.lit(1)).alias("n")), df, columns)


def ranged(counts: DataFrame, df: DataFrame, columns: list[str]) -> DataFrame:
    """Counts of (column number, value) with the range of each value; limits come from the rows of ``df``."""
    limits = range_limits(df, [number(df, c) for c in columns], PER_RANGE)
    cut = {i: x for i, x in enumerate(limits) if x}
    if not cut:
        return counts.withColumn(RANGE, F.lit(0))
    wide = counts.withColumns({f"__v{i}": F.when(F.col("column") == i, F.col("value")) for i in cut})
    wide = with_ranges(wide, {f"__v{i}": x for i, x in cut.items()}, {f"__v{i}": f"__r{i}" for i in cut})
    placed = F.coalesce(*[F.when(F.col("column") == i, F.col(f"__r{i}")) for i in cut], F.lit(0))
    return wide.select(*counts.columns, placed.alias(RANGE))


def _starts(counts: DataFrame, by: list[str]) -> DataFrame:
    """(by..., column, __range, start, total) from the counts per range."""
    keys = [*[name_col(b) for b in by], F.col("column")]
    per_range = counts.groupBy(*keys, RANGE).agg(F.sum("n").alias("size"))
    group = Window.partitionBy(*keys)
    before = group.orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    return per_range.select(
        *keys,
        RANGE,
        F.coalesce(F.sum("size").over(before), F.lit(0)).alias("start"),
        "size",
        F.sum("size").over(group).alias("total"),
    )


def _placed(counts: DataFrame, starts: DataFrame, by: list[str]) -> DataFrame:
    keys = [*by, "column", RANGE]
    inside = Window.partitionBy(*[name_col(k) for k in keys]).orderBy("value")
    joined = counts.join(starts, keys)
    running = F.sum("n").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    return joined.withColumn("below", F.col("start") + running - F.col("n"))


def value_positions(df: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """(by..., column, value, n, below, total) for every distinct value of the columns.

    ``below`` counts the rows with a smaller value in the same group. Rows with a missing value or a
    missing group key do not take part.
    """
    by = list(by or [])
    rest = ["column", "value", "n", "below", "total"]
    if not columns:
        return _nothing(df, by, "column string, value double, n bigint, below bigint, total bigint")
    rows, keys = _keyed(df, by)
    counts = _counted(rows, columns, keys)
    return _restored(_titled(_placed(counts, _starts(counts, keys), keys), columns), by, *rest)


def _nothing(df: DataFrame, by: list[str], rest: str) -> DataFrame:
    """An empty table with the group columns and further ones."""
    fields = [T.StructField(b, df.schema[b].dataType) for b in by] + T._parse_datatype_string(rest).fields
    return df.sparkSession.createDataFrame([], T.StructType(fields))


def _titled(df: DataFrame, columns: list[str]) -> DataFrame:
    """Column numbers back to names."""
    listed = ", ".join(text_literal(c) for c in columns)
    return df.withColumn("column", F.expr(f"array({listed})[`column`]"))


def exact_quantiles(
    df: DataFrame, columns: list[str], probs: list[float], by: list[str] | None = None
) -> DataFrame:
    """(by..., column, total, quantiles): linear interpolation between neighbours, as in pandas."""
    by = list(by or [])
    if not columns:
        return _nothing(df, by, "column string, total bigint, quantiles array<double>")
    rows, keys = _keyed(df, by)
    quantiles = _ranged_quantiles(_counted(rows, columns, keys), probs, keys)
    return _restored(_titled(quantiles, columns), by, "column", "total", "quantiles")


def _ranged_quantiles(counts: DataFrame, probs: list[float], by: list[str]) -> DataFrame:
    starts = _starts(counts, by)
    steps = [F.lit(float(p)) * (F.col("total") - 1) for p in probs]
    wanted = [(F.floor(s), F.ceil(s)) for s in steps]

    def holds(rank: Column, first: Column, size: Column) -> Column:
        return (rank >= first) & (rank < first + size)

    # Only ranges that contain a wanted position are sorted at all.
    needed = reduce(
        Column.__or__,
        [holds(r, F.col("start"), F.col("size")) for pair in wanted for r in pair],
    )
    placed = _placed(counts, starts.where(needed), by)
    picks = []
    for i, (low, high) in enumerate(wanted):
        picks.append(F.max(F.when(holds(low, F.col("below"), F.col("n")), F.col("value"))).alias(f"lo{i}"))
        picks.append(F.max(F.when(holds(high, F.col("below"), F.col("n")), F.col("value"))).alias(f"hi{i}"))
    keys = [*[name_col(b) for b in by], F.col("column")]
    found = placed.groupBy(*keys, "total").agg(*picks)
    values = [
        F.when(F.col(f"hi{i}") == F.col(f"lo{i}"), F.col(f"lo{i}")).otherwise(
            F.col(f"lo{i}") + (F.col(f"hi{i}") - F.col(f"lo{i}")) * (s - F.floor(s))
        )
        for i, s in enumerate(steps)
    ]
    return found.select(*keys, F.col("total"), F.array(*values).alias("quantiles"))


QUARTILES = (0.25, 0.5, 0.75)


def fences(quantiles: DataFrame, probs: tuple[float, ...] = QUARTILES) -> DataFrame:
    """Add q1, median, q3, iqr, lower and upper to a table of quantiles at ``probs``."""
    q1, median, q3 = [F.col("quantiles")[probs.index(p)] for p in QUARTILES]
    iqr = q3 - q1
    return quantiles.withColumns(
        {"q1": q1, "median": median, "q3": q3, "iqr": iqr, "lower": q1 - iqr * 1.5, "upper": q3 + iqr * 1.5}
    )


def column_fences(df: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """(by..., column, total, quantiles, q1, median, q3, iqr, lower, upper)."""
    return fences(exact_quantiles(df, columns, list(QUARTILES), by))


def spread(
    df: DataFrame, columns: list[str], by: list[str] | None = None, probs: tuple[float, ...] = QUARTILES
) -> DataFrame:
    """Fences plus outliers, min, max, and the smallest and largest value inside the fences.

    Outliers are counted on the value counts that the quantiles are made of, so the data is not read again.
    """
    by = list(by or [])
    measures = ["column", "total", "quantiles", "q1", "median", "q3", "iqr", "lower", "upper"]
    sides = ["outliers", "min", "max", "inside_low", "inside_high"]
    if not columns:
        doubles = ", ".join(f"{c} {'bigint' if c == 'outliers' else 'double'}" for c in [*measures[3:], *sides])
        return _nothing(df, by, f"column string, total bigint, quantiles array<double>, {doubles}")
    rows, groups = _keyed(df, by)
    keys = [*groups, "column"]
    v, n = F.col("value"), F.col("n")
    inside = (v >= F.col("lower")) & (v <= F.col("upper"))
    counts = _counted(rows, columns, groups)
    f = fences(_ranged_quantiles(counts, list(probs), groups), probs)
    measured = counts.join(f.select(*keys, "lower", "upper"), keys)
    outside = measured.groupBy(*keys).agg(
        F.coalesce(F.sum(F.when(~inside, n)), F.lit(0)).alias("outliers"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        F.min(F.when(inside, v)).alias("inside_low"),
        F.max(F.when(inside, v)).alias("inside_high"),
    )
    return _restored(_titled(f.join(outside, keys), columns), by, *measures, *sides)


def keyed(df: DataFrame, key: str, *fields: str) -> Column:
    """A small (one row per column name) table as a map, usable in any other plan.

    This is an uncorrelated scalar subquery: no join, and the map is bounded by the number of columns.
    """
    entry = F.struct(F.col(key), F.struct(*[F.col(f) for f in fields]))
    return df.agg(F.map_from_entries(F.collect_list(entry)).alias("m")).scalar()


def average_ranks(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value, rank): tied values share the mean of their positions."""
    p = value_positions(df, columns)
    return p.select("column", "value", (F.col("below") + (F.col("n") + 1) / 2).alias("rank"))


def row_label(name: str) -> Column:
    """A name in a one-row aggregate, as a value rather than a constant.

    With a constant on a one-column table Catalyst would drop the join key and plan a nested loop.
    """
    return F.when(F.count(F.lit(1)) >= 0, F.lit(name))


def top_values(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, distinct, top_value, top_count, low_value, high_value): one scan and one shuffle for all columns.

    Each row yields one (column number, value) cell per column, and equal cells are counted before the shuffle. A
    cell keeps a whole number, a floating point number or a text, whichever the column's type is, so numbers are
    compared as numbers. Values are shown as text. Ties go to the smallest value.
    """
    if not columns:
        fields = "column string, distinct bigint, top_value string, top_count bigint, low_value string, high_value string"
        return _nothing(df, [], fields)
    cells, single = [], []
    for i, c in enumerate(columns):
        dtype, v = df.schema[c].dataType, value_sql(df, c)
        whole = isinstance(dtype, T.IntegralType)
        real = isinstance(dtype, (T.FractionalType,))
        exact = isinstance(dtype, T.DecimalType) or not (whole or real)
        if isinstance(dtype, T.FloatType):
            single.append(i)
        cells.append(
            f"named_struct('i', {i}, 'whole', {f'cast({v} as bigint)' if whole else 'cast(null as bigint)'}, "
            f"'real', {f'cast({v} as double)' if real else 'cast(null as double)'}, "
            f"'text', {f'cast({v} as string)' if exact else 'cast(null as string)'})"
        )
    long = df.select(F.expr(f"inline(array({', '.join(cells)}))"))
    present = long.where("whole is not null or real is not null or text is not null")
    counts = present.groupBy("i", "whole", "real", "text").agg(F.count(F.lit(1)).alias("n"))
    cell = F.struct("whole", "real", "text")
    found = counts.groupBy("i").agg(
        F.count(F.lit(1)).alias("distinct"),
        F.min_by(cell, F.struct(-F.col("n"), cell.alias("cell"))).alias("top"),
        F.max("n").alias("top_count"),
        F.min(cell).alias("low"),
        F.max(cell).alias("high"),
    )

    def shown(x: str) -> Column:
        real = F.col(f"{x}.real")
        if single:
            real = F.when(F.col("i").isin(single), real.cast("float").cast("string")).otherwise(real.cast("string"))
        return F.coalesce(F.col(f"{x}.text"), F.col(f"{x}.whole").cast("string"), real.cast("string"))

    every = df.sparkSession.range(len(columns)).select(F.col("id").cast("int").alias("i"))
    listed = ", ".join(text_literal(c) for c in columns)
    return every.join(found, "i", "left").select(
        F.expr(f"array({listed})[i]").alias("column"),
        F.coalesce("distinct", F.lit(0)).alias("distinct"),
        shown("top").alias("top_value"),
        F.coalesce("top_count", F.lit(0)).alias("top_count"),
        shown("low").alias("low_value"),
        shown("high").alias("high_value"),
    )


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """(value, n) for the present values of one column."""
    v = value(df, column)
    return df.select(v.alias("value")).where(F.col("value").isNotNull()).groupBy("value").agg(
        F.count(F.lit(1)).alias("n")
    )
