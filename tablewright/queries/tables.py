"""Sources, profile and search."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame

from ..operators import profile as P
from ..sources import tables as S
from .registry import Tables, query, source_sql
from .sqltext import SEMANTIC, day, duplicates_sql, i, pct, profile_sql, q, r, skew0, std0, ts

LINEITEM = [
    ("l_orderkey", "numeric"), ("l_partkey", "numeric"), ("l_suppkey", "numeric"), ("l_linenumber", "numeric"),
    ("l_quantity", "numeric"), ("l_extendedprice", "numeric"), ("l_discount", "numeric"), ("l_tax", "numeric"),
    ("l_returnflag", "text"), ("l_linestatus", "text"), ("l_shipdate", "datetime"),
]
EVENTS = [
    ("event_id", "numeric"), ("ts", "datetime"), ("user_id", "numeric"), ("event_type", "text"),
    ("value", "numeric"), ("props", "text"),
]
EVENTS_GAPS = EVENTS[:5]
CUSTOMER = [
    ("c_custkey", "numeric"), ("c_name", "text"), ("c_nationkey", "numeric"), ("c_acctbal", "numeric"),
    ("c_mktsegment", "text"),
]
ORDERS = [
    ("o_orderkey", "numeric"), ("o_custkey", "numeric"), ("o_orderstatus", "text"), ("o_totalprice", "numeric"),
    ("o_orderdate", "datetime"), ("o_orderpriority", "text"),
]
PART = [
    ("p_partkey", "numeric"), ("p_name", "text"), ("p_brand", "text"), ("p_type", "text"), ("p_size", "numeric"),
    ("p_retailprice", "numeric"),
]
LABELS = [("doc_id", "numeric"), ("quality", "numeric"), ("toxic", "numeric")]
TEXTS = [
    ("o_orderkey", "numeric"), ("mixed", "text"), ("fee", "text"), ("price_text", "text"), ("flag", "text"),
    ("order_day", "text"), ("hundreds", "numeric"),
]


def scratch_folder(spark) -> str:
    """A new folder where every executor can write: the cluster's shared folder, or /tmp in tests."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if shared:
        import uuid

        return os.path.join(shared, f"tablewright-{uuid.uuid4().hex}")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    return os.path.join(tempfile.mkdtemp(prefix="run-"), "table")


@query("src_csv_roundtrip", f"""select o_orderkey, o_custkey, o_orderstatus, {r('o_totalprice')} as o_totalprice,
 {ts('o_orderdate')} as o_orderdate, o_orderpriority from orders""")
def _(t: Tables) -> DataFrame:
    orders = t("orders")
    path = scratch_folder(t.spark) + ".csv"
    padded = orders.withColumnRenamed("o_orderkey", " o_orderkey ")
    S.write_csv(padded, path)
    return S.load_table(t.spark, path, padded.schema)


@query("src_csv_roundtrip_documents", f"select doc_id, text, lang, source, {i('n_chars')} as n_chars from documents")
def _(t: Tables) -> DataFrame:
    documents = t("documents")
    path = scratch_folder(t.spark) + ".csv"
    S.write_csv(documents, path)
    return S.load_table(t.spark, path, documents.schema)


DATE_TEXTS = {
    "fraction": "date_format(o_orderdate, 'yyyy-MM-dd HH:mm:ss.SSS')", "zoned": "date_format(o_orderdate, \"yyyy-MM-dd'T'HH:mm:ss'Z'\")",
    "offset": "concat(date_format(o_orderdate, \"yyyy-MM-dd'T'HH:mm:ss\"), '+02:00')", "month": "date_format(o_orderdate, 'MMMM d, yyyy')",
    "slashed": "date_format(o_orderdate, 'M/d/yyyy HH:mm')", "padded": "concat(repeat(' ', 40), date_format(o_orderdate, 'yyyy-MM-dd'), '   ')",
}


@query("profile_types_date_texts", " union all ".join(f"select {n}::bigint as position, '{c}' as \"column\", count(*) as non_null, 'Date/Time' as semantic_type from orders" for n, c in enumerate(DATE_TEXTS)))
def _(t: Tables) -> DataFrame:
    texts = t("orders").selectExpr(*[f"{x} as {c}" for c, x in DATE_TEXTS.items()])
    return P.column_types(texts).select("position", "column", "non_null", "semantic_type")


@query("src_validate", """select 'orders' as source, true as usable, '' as message
 union all select 'empty', false, 'The dataset has no data rows.'""")
def _(t: Tables) -> DataFrame:
    orders = t("orders")
    checks = [("orders", *S.validate(orders)), ("empty", *S.validate(orders.where("o_totalprice < 0")))]
    return t.spark.createDataFrame(checks, "source string, usable boolean, message string")


TYPES = f"position, col as \"column\", kind, {i('non_null')} as non_null, {i('missing')} as missing, {i('distinct_')} as \"distinct\", {SEMANTIC} as semantic_type"


def _typed(t: Tables, name: str) -> DataFrame:
    return P.column_types(t(name)).select(
        "position", "column", "kind", "non_null", "missing", "distinct", "semantic_type"
    )


for _name, _columns in (
    ("lineitem", LINEITEM), ("events", EVENTS), ("customer", CUSTOMER), ("labels", LABELS), ("order_texts", TEXTS),
):
    query(f"profile_types_{_name}", f"with {profile_sql(_name, _columns)} select {TYPES} from p")(
        lambda t, name=_name: _typed(t, name)
    )


def _gaps(columns: list[str]) -> str:
    return " + ".join(f"count(*) - count({c})" for c in columns)


ORDER_COLUMNS = [c for c, _ in ORDERS]


@query("profile_table", f"""with {duplicates_sql('orders_gaps')}, m as (select {_gaps(ORDER_COLUMNS)} as missing_cells,
 {' + '.join(f'(count(*) > count({c}))::int' for c in ORDER_COLUMNS)} as columns_with_missing from {source_sql('orders_gaps')})
 select rows, 6::bigint as columns, rows * 6 as cells, missing_cells, {r(pct('missing_cells', 'rows * 6'))} as missing_pct,
 {i('columns_with_missing')} as columns_with_missing, duplicate_rows, {r('duplicate_pct')} as duplicate_pct from dup, m""")
def _(t: Tables) -> DataFrame:
    return P.table_summary(t("orders_gaps"))


def _samples_sql(source: str, columns: list[str], order: str) -> str:
    parts = [
        f"select '{c}' as col, (select string_agg(v, ', ' order by o) from (select cast({c} as varchar) as v, {order} as o "
        f"from {source_sql(source)} where {c} is not null order by {order} limit 3)) as samples"
        for c in columns
    ]
    return " union all ".join(parts)


@query("profile_columns", f"""with {profile_sql('customer_gaps', CUSTOMER)},
 s as (select col as scol, samples from ({_samples_sql('customer_gaps', [c for c, _ in CUSTOMER], 'c_custkey')}))
 select position, col as "column", {SEMANTIC} as semantic_type, {i('non_null')} as non_null, {i('missing')} as missing,
 {r('missing_pct')} as missing_pct, {i('distinct_')} as "distinct", samples from p join s on col = scol""")
def _(t: Tables) -> DataFrame:
    return P.column_profile(t("customer_gaps"), ["c_custkey"]).drop("dtype")


@query("profile_type_counts", f"""with {profile_sql('order_texts', TEXTS)}
 select {SEMANTIC} as semantic_type, count(*) as columns from p group by 1""")
def _(t: Tables) -> DataFrame:
    return P.type_counts(t("order_texts"))


@query("search_rows", f"""select p_partkey, p_name, p_brand, p_type, p_size::bigint as p_size, {r('p_retailprice')} as p_retailprice from part
 where contains(lower(p_name), 'ring') or contains(lower(p_brand), 'ring') or contains(lower(p_type), 'ring')
 or contains(cast(p_partkey as varchar), 'ring') or contains(cast(p_size as varchar), 'ring')""")
def _(t: Tables) -> DataFrame:
    return P.search_rows(t("part"), " Ring")


@query("search_rows_columns", """select c_custkey, c_mktsegment from (select c_custkey, c_mktsegment from """
       + source_sql("customer_gaps") + """) where contains(cast(c_custkey as varchar), '4') or contains(lower(c_mktsegment), '4')""")
def _(t: Tables) -> DataFrame:
    return P.search_rows(t("customer_gaps"), "4", ["c_custkey", "c_mktsegment"])


def describe_sql(source: str, columns: list[str]) -> str:
    return " union all ".join(
        f"select {n}::bigint as position, '{c}' as \"column\", count({c}) as count, {r(f'avg({c})')} as mean, {r(std0(c))} as std, "
        f"{r(f'min({c})')} as min, {r(q(c, 0.25))} as q1, {r(q(c, 0.5))} as median, {r(q(c, 0.75))} as q3, {r(f'max({c})')} as max, "
        f"{r(skew0(f'cast({c} as double)'))} as skew, count(*) filter (where {c} = 0) as zeros from {source_sql(source)}"
        for n, c in columns
    )


NUMBERS = [(n, c) for n, (c, k) in enumerate(LINEITEM) if k == "numeric"]


@query("describe_numeric", describe_sql("lineitem", NUMBERS))
def _(t: Tables) -> DataFrame:
    return P.describe_numeric(t("lineitem"))


def categorical_sql(source: str, columns: list[str]) -> str:
    return " union all ".join(
        f"select '{c}' as \"column\", count({c}) as total, count(distinct {c}) as \"distinct\", "
        f"{r(pct(f'count(distinct {c})', f'count({c})'))} as unique_pct, "
        f"(select {c} from {source_sql(source)} where {c} is not null group by {c} order by count(*) desc, {c} limit 1) as top_value, "
        f"(select count(*) from {source_sql(source)} where {c} is not null group by {c} order by count(*) desc limit 1) as top_count, "
        f"{r(pct(f'(select count(*) from {source_sql(source)} where {c} is not null group by {c} order by count(*) desc limit 1)', f'count({c})'))} as top_pct "
        f"from {source_sql(source)}"
        for c in columns
    )


@query("describe_categorical", categorical_sql("part", ["p_name", "p_brand", "p_type"]))
def _(t: Tables) -> DataFrame:
    return P.describe_categorical(t("part"))


@query("describe_categorical_documents", categorical_sql("documents", ["text", "lang", "source"]))
def _(t: Tables) -> DataFrame:
    return P.describe_categorical(t("documents"))


DATES = """select '{0}' as "column", count({0}) as valid, strftime(min({0}), '%Y-%m-%d') as first_day,
 strftime(max({0}), '%Y-%m-%d') as last_day, date_diff('second', min({0}), max({0})) // 86400 as span_days from {1}"""


@query("describe_dates", DATES.format("o_orderdate", source_sql("orders_gaps")))
def _(t: Tables) -> DataFrame:
    return P.describe_dates(t("orders_gaps"))


@query("describe_dates_text", f"""select 'order_day' as "column", count(d) as valid, {day('min(d)')} as first_day, {day('max(d)')} as last_day,
 date_diff('second', min(d), max(d)) // 86400 as span_days from (select cast(order_day as timestamp) as d from {source_sql('order_texts')})""")
def _(t: Tables) -> DataFrame:
    return P.describe_dates(t("order_texts"), ["order_day"])


@query("health_snapshot", f"""with {duplicates_sql('customer_gaps')}, {profile_sql('customer_gaps', CUSTOMER)},
 w as (select sum(missing) as m, max(rows) * 5 as cells from p)
 select col as "column", {i('missing')} as missing, {r('missing_pct')} as missing_pct, {i('m')} as table_missing_cells,
 {r(pct('m', 'cells'))} as table_missing_pct, duplicate_rows as table_duplicate_rows, {r('duplicate_pct')} as table_duplicate_pct
 from p, w, dup where missing > 0""")
def _(t: Tables) -> DataFrame:
    return P.health_snapshot(t("customer_gaps"))
