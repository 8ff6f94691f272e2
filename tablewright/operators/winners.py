"""The first or last row of every key, without sorting the table.

1. A hash aggregate by a 16-byte digest of the key takes the least (or greatest) mark of the order, a number of fixed width.
2. A row goes on if its mark is its key's best: a bitmap of fixed size leaves out nearly all others where they are, and a
   join on (key, mark) the rest. A hot key's rows have many marks, so they spread over the tasks.
3. Of the rows that are left, about one per key, a window takes the one that comes first by the whole order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions.missing import name_col, quoted
from .copies import flagged
from .profile import row_digest


def order_mark(df: DataFrame, name: str) -> Column:
    """A double that never falls where the column rises; NULL comes first, as in a sort. Equal marks leave the order open."""
    dtype, c = df.schema[name].dataType, quoted(name)
    if isinstance(dtype, (T.StringType, T.BinaryType)):
        mark = F.expr(f"cast(conv(rpad(hex(substring(cast({c} as binary), 1, 6)), 12, '0'), 16, 10) as double)")
    elif isinstance(dtype, (T.TimestampType, T.DateType, T.TimestampNTZType)):
        seconds = "" if isinstance(dtype, T.DateType) else f" + hour({c}) * 3600D + minute({c}) * 60D + cast(extract(second from {c}) as double)"
        mark = F.expr(f"unix_date(cast({c} as date)) * 86400D{seconds}")
    elif isinstance(dtype, (T.NumericType, T.BooleanType)):
        mark = name_col(name).cast("double")
    else:
        mark = F.lit(0.0)  # decided by the window alone
    if isinstance(dtype, T.TimestampType):
        mark = F.expr(f"unix_micros({c}) / 1000000D")
    return F.coalesce(mark, F.lit(float("-inf"))) + 0.0  # one zero, so that equal marks have equal digests


def winning_rows(df: DataFrame, keys: list[str], order_by: list[str], keep: str = "first", also: dict[str, Column] | None = None) -> DataFrame:
    """One row per key: the first (or last) by ``order_by``, with aggregates over the key's rows in ``also``.

    NULL is a key like any other. Rows that are equal in the whole order are as good as each other.
    """
    best = F.min if keep == "first" else F.max
    digest = row_digest(df.select(*[name_col(k) for k in keys]))
    rows = df.select("*", digest[0].alias("__k0"), digest[1].alias("__k1"), order_mark(df, order_by[0]).alias("__mark"))
    found = rows.groupBy("__k0", "__k1").agg(best("__mark").alias("__mark"), *[c.alias(n) for n, c in (also or {}).items()])
    place = F.xxhash64("__k0", "__mark")
    near = flagged(rows.withColumn("__place", place), "__place", found.select(place.alias("__place"))).where("__flag").drop("__flag")
    held = near.join(found, ["__k0", "__k1", "__mark"])
    order = [name_col(o).asc_nulls_first() if keep == "first" else name_col(o).desc_nulls_last() for o in order_by]
    ranked = held.withColumn("__rank", F.row_number().over(Window.partitionBy("__k0", "__k1").orderBy(*order)))
    return ranked.where("__rank = 1").select(*[name_col(c) for c in [*df.columns, *(also or {})]])
