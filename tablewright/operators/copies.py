"""Rows that may have a copy, found by digests of 16 bytes before any row moves.

Digests of all rows are counted, and those that occur twice or more set a bit each in a bitmap of fixed size: at most
SLOTS / 64 rows of two numbers, so it can be broadcast whatever the table's size. A row whose bit is not set has no copy,
and stays where it is; only the others are grouped or joined. A bit may be shared, so grouping them is still exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.missing import name_col, without_nan
from .profile import row_counts, row_digest

SLOTS = 1 << 24


def _word(digest: str) -> Column:
    return F.shiftright(F.col(digest), 6).bitwiseAND(F.lit((SLOTS >> 6) - 1))


def _bit(digest: str) -> Column:
    return F.expr(f"shiftleft(1L, cast({digest} & 63 as int))")


def flagged(rows: DataFrame, digest: str, wanted: DataFrame) -> DataFrame:
    """Replaces the column ``digest`` by `__flag`: false only where no row of ``wanted`` has that digest."""
    bitmap = wanted.groupBy(_word(digest).alias("__word")).agg(F.bit_or(_bit(digest)).alias("__bits"))
    joined = rows.withColumn("__word", _word(digest)).join(F.broadcast(bitmap), "__word", "left")
    flag = F.coalesce(F.col("__bits").bitwiseAND(_bit(digest)) != 0, F.lit(False))
    return joined.select(*[name_col(c) for c in rows.columns if c != digest], flag.alias("__flag"))


def marked(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Adds `__flag`: false only for rows whose key (the whole row by default) occurs once. NaN counts as NULL."""
    own = df.select(*[name_col(k) for k in keys]) if keys else df
    return flagged(df.withColumn("__h0", row_digest(own)[0]), "__h0", row_counts(own).where("n > 1").select("__h0"))


def copied_rows(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The rows, NaN as NULL, that may have a copy: all that do, and few others."""
    clean = without_nan(df)
    return marked(clean, keys).where("__flag").drop("__flag")


def each_once(df: DataFrame) -> DataFrame:
    """Every row once, NaN as NULL. Rows without a copy are not shuffled."""
    rows = marked(without_nan(df))
    several = rows.where("__flag").drop("__flag")
    return rows.where("not __flag").drop("__flag").unionByName(several.distinct())
