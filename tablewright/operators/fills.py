"""Forward and backward fill that spreads every group, and the ungrouped table, over many tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F, types as T

from ..functions.missing import DATETIME, kind_of, name_col, value
from .ordering import RANGE, range_limits, with_ranges


def _axis(df: DataFrame, order_by: str) -> Column:
    """The order key as a number that never decreases along the order."""
    c, dtype = name_col(order_by), df.schema[order_by].dataType
    if isinstance(dtype, T.TimestampType):
        return F.unix_micros(c).cast("double")
    if kind_of(dtype) == DATETIME:
        days = F.datediff(c.cast("date"), F.lit("1970-01-01").cast("date")).cast("double")
        c = c.cast("timestamp_ntz")
        return days * 86400 + F.hour(c) * 3600 + F.minute(c) * 60 + F.second(c)
    return c.cast("double")


# Rows that one range of the order axis should hold.
PER_RANGE = 1_000_000


def directional_fill(
    df: DataFrame,
    columns: list[str],
    order_by: str,
    partition_by: list[str] | None = None,
    backward: bool = False,
) -> DataFrame:
    """Replace missing values by the previous (or next) present one in ``order_by`` order.

    ``order_by`` must be a unique, present number, date or timestamp. The order axis is cut into ranges, as many as
    the rows need: each (group, range) first reduces to its last present value per column, those rows carry across
    ranges, and the window works inside one (group, range), so that no group ends up in one task.
    """
    part = [name_col(p) for p in (partition_by or [])]
    return _ranged_fill(df, columns, order_by, part, backward)


def _window(part: list[Column], order_by: str, backward: bool) -> WindowSpec:
    order = name_col(order_by).desc() if backward else name_col(order_by).asc()
    return Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)


def _ranged_fill(
    df: DataFrame, columns: list[str], order_by: str, part: list[Column], backward: bool
) -> DataFrame:
    rows = df.withColumn("__axis", _axis(df, order_by))
    limits = {"__axis": range_limits(rows, [F.col("__axis")], PER_RANGE)[0]}
    # One struct as group key: NULL keys compare equal, and join and window share one partitioning.
    group = F.struct(*part) if part else F.struct(F.lit(0))
    if not limits["__axis"]:  # one range: nothing to carry
        w = _window([group], order_by, backward)
        return df.withColumns({c: F.last(value(df, c), ignorenulls=True).over(w) for c in columns})
    rows = with_ranges(rows, limits, {"__axis": RANGE}).drop("__axis").withColumn("__group", group)
    key = ["__group", RANGE]

    edge = F.min_by if backward else F.max_by
    ends = rows.groupBy(*key).agg(
        *[
            edge(value(df, c), F.when(value(df, c).isNotNull(), name_col(order_by))).alias(f"__end{i}")
            for i, c in enumerate(columns)
        ]
    )
    order = F.col(RANGE).desc() if backward else F.col(RANGE).asc()
    across = Window.partitionBy("__group").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(
        *key,
        *[F.last(f"__end{i}", ignorenulls=True).over(across).alias(f"__carry{i}") for i in range(len(columns))],
    )
    inside = _window([F.col(k) for k in key], order_by, backward)
    filled = {
        c: F.coalesce(F.last(value(df, c), ignorenulls=True).over(inside), F.col(f"__carry{i}"))
        for i, c in enumerate(columns)
    }
    return rows.join(carried, key).withColumns(filled).select(*[name_col(c) for c in df.columns])
