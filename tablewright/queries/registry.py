"""Named queries over the given tables, each with the SQL that must give the same rows."""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..functions.missing import name_col

TIME = "yyyy-MM-dd HH:mm:ss.SSSSSS"

# The given tables hold no missing values, duplicates or defects. These projections add them to every row
# of a table by the same expressions in Spark and in the SQL. The last entry repeats some rows.
FIXTURES: dict[str, tuple[str, list[str], str | None]] = {
    "lineitem_gaps": (
        "lineitem",
        [
            "l_orderkey",
            "l_partkey",
            "l_suppkey",
            "l_linenumber",
            "case when l_orderkey % 7 = 0 then null else l_quantity end as l_quantity",
            "l_extendedprice",
            "l_discount",
            "case when l_partkey % 11 = 0 then null else l_returnflag end as l_returnflag",
            "l_linestatus",
            "l_shipdate",
        ],
        None,
    ),
    "orders_gaps": (
        "orders",
        [
            "o_orderkey",
            "o_custkey",
            "o_orderstatus",
            "case when o_orderkey % 5 <> 0 then null else o_totalprice end as o_totalprice",
            "case when o_custkey % 6 = 0 then null else o_orderdate end as o_orderdate",
            "o_orderpriority",
        ],
        None,
    ),
    "customer_gaps": (
        "customer",
        [
            "c_custkey",
            "c_name",
            "c_nationkey",
            "case when c_custkey % 19 = 0 then null else c_acctbal end as c_acctbal",
            "case when c_custkey % 13 = 0 then null when c_custkey % 17 = 0 then '  ' else c_mktsegment end as c_mktsegment",
        ],
        None,
    ),
    "events_gaps": (
        "events",
        [
            "event_id",
            "ts",
            "user_id",
            "case when event_id % 11 = 0 then null else event_type end as event_type",
            "case when event_id % 5 in (1, 2) then null else value end as value",
        ],
        None,
    ),
    "customer_dirty": (
        "customer",
        [
            "c_custkey",
            "c_name",
            "case when c_custkey % 13 = 0 then null when c_custkey % 17 = 0 then '  ' else c_mktsegment end as segment",
            "c_acctbal as stock",
            "c_acctbal / 50 as discount_pct",
            "case when c_custkey % 5 <> 0 then null else c_acctbal end as balance",
            "'X' as k",
            "cast(null as double) as e",
            "c_nationkey as size_a",
            "c_nationkey as size_b",
            "case when c_custkey % 4 = 0 then 'n/a' else cast(c_nationkey as string) end as score_text",
        ],
        "c_mktsegment = 'BUILDING'",
    ),
    "events_dirty": (
        "events",
        [
            "event_id",
            "user_id",
            "case when user_id % 9 = 0 then null else ts end as ts",
            "case when event_id % 11 = 0 then null else event_type end as event_type",
            "case when event_id % 5 in (1, 2) then null else value end as value",
            "value - 5 + user_id % 7 as age",
            "value as amount",
        ],
        "event_type = 'purchase'",
    ),
    "events_repeated": (
        "events",
        ["event_id", "ts", "user_id", "event_type", "value"],
        "event_type = 'purchase'",
    ),
    "lineitem_repeated": (
        "lineitem",
        ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"],
        "l_orderkey % 10 = 0",
    ),
    "line_choices": ("lineitem", ["l_returnflag", "l_linestatus", "l_quantity", "l_discount"], None),
    "order_texts": (
        "orders",
        [
            "o_orderkey",
            "case when o_orderkey % 4 = 0 then 'n/a' else cast(o_custkey as string) end as mixed",
            "concat('$', cast(o_custkey as string), ',', cast(o_custkey % 10 as string), '%') as fee",
            "concat(' ', cast(o_totalprice as string), ' ') as price_text",
            "case when o_custkey % 3 = 0 then 'Yes' when o_custkey % 3 = 1 then ' inactive' else 'maybe' end as flag",
            "substring(cast(o_orderdate as string), 1, 10) as order_day",
            "o_totalprice / 100 as hundreds",
        ],
        None,
    ),
    "logins": (
        "events",
        [
            "cast(user_id as string) as user_id",
            "case when user_id % 10 = 0 then 'guest@session' else concat('user', cast(user_id as string), '@mail') end as email",
            "ts as login_time",
            "case when user_id % 10 = 0 then 'guest' when user_id % 3 = 0 then 'google' else 'email_password' end as provider",
            "event_type",
        ],
        None,
    ),
    "uploads": (
        "orders",
        [
            "o_orderkey",
            "cast(o_custkey as string) as user_id",
            "concat('user', cast(o_custkey as string), '@mail') as email",
            "o_orderdate as upload_time",
            "concat('orders_', cast(o_orderkey as string), '.csv') as dataset_name",
            "case when o_orderstatus = 'P' then null when o_orderstatus = 'F' then 'Excel' else 'CSV' end as file_type",
            "o_custkey % 1000 as row_count",
            "o_orderkey % 20 as column_count",
            "o_totalprice / 100000 as size_mb",
        ],
        None,
    ),
}


@dataclass(frozen=True)
class Tables:
    """The tables of one scale directory, and the fixtures made from them."""

    spark: SparkSession
    directory: str

    def __call__(self, name: str) -> DataFrame:
        if name in FIXTURES:
            table, exprs, repeated = FIXTURES[name]
            base = self(table)
            out = base.selectExpr(*exprs)
            return out if repeated is None else out.unionAll(base.where(repeated).selectExpr(*exprs))
        return self.spark.read.parquet(os.path.join(self.directory, f"{name}.parquet"))


def source_sql(name: str) -> str:
    """The same table or fixture as a SQL subquery."""
    if name not in FIXTURES:
        return f"(select * from {name})"
    table, exprs, repeated = FIXTURES[name]
    first = f"select {', '.join(exprs)} from {table}"
    return f"({first})" if repeated is None else f"({first} union all {first} where {repeated})"


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, digits: int = 4):
    """Register a function of ``Tables`` as a query, with the SQL that must agree with it."""

    def register(make: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, directory: str) -> DataFrame:
            return tidy(make(Tables(spark, directory)), digits)

        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = " ".join(sql.split("\n"))
        return make

    return register


def tidy(df: DataFrame, digits: int) -> DataFrame:
    """Comparable types: 64-bit integers, rounded doubles, times as text."""
    out = []
    for f in df.schema.fields:
        c = name_col(f.name)
        if isinstance(f.dataType, T.IntegralType):
            c = c.cast("bigint")
        elif isinstance(f.dataType, (T.FloatType, T.DoubleType, T.DecimalType)):
            c = F.round(c.cast("double"), digits)
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, TIME)
        elif isinstance(f.dataType, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        out.append(c.alias(f.name))
    return df.select(*out)
