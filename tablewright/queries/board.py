"""Dashboard: column choice, headline numbers, trends and the four views."""

from __future__ import annotations


from pyspark.sql import DataFrame, functions as F

from ..operators import charts as C, dashboard as B
from . import words as W
from .audit import STATUS, score_sql
from .chart import histogram_sql
from .explore import pairs_sql
from .registry import Tables, query, source_sql
from .sqltext import SEMANTIC, day, duplicates_sql, profile_sql, q, r
from .tables import PART

# Names that trigger the ranking rules, over every line.
NAMED_COLUMNS = [
    ("order_id", "numeric"), ("quantity", "numeric"), ("total_price", "numeric"), ("discount", "numeric"), ("tax", "numeric"),
    ("region_status", "text"), ("flag", "text"), ("ship_date", "datetime"),
]
NAMED = """(select l_orderkey as order_id, case when l_orderkey % 7 = 0 then null else l_quantity end as quantity, l_extendedprice as total_price, l_discount as discount,
 l_tax as tax, case when l_partkey % 11 = 0 then null else l_returnflag end as region_status, l_linestatus as flag, l_shipdate as ship_date from lineitem)"""


def _named(t: Tables) -> DataFrame:
    return t("lineitem").selectExpr(
        "l_orderkey as order_id",
        "case when l_orderkey % 7 = 0 then null else l_quantity end as quantity",
        "l_extendedprice as total_price",
        "l_discount as discount",
        "l_tax as tax",
        "case when l_partkey % 11 = 0 then null else l_returnflag end as region_status",
        "l_linestatus as flag",
        "l_shipdate as ship_date",
    )


def roles_sql(source: str, columns: list[tuple[str, str]], integers: list[str]) -> str:
    """CTE ``w``: profile rows with semantic type and role."""
    ids = "(is_id or contains(lower(col), 'index'))"
    sequence = f"(list_contains([{', '.join(repr(c) for c in integers)}]::varchar[], col) and distinct_ = rows and rows > 30)"
    return f"""{profile_sql(source, columns)}, y as (select *, {SEMANTIC} as semantic_type from p),
 w as (select *, case when semantic_type = 'Numeric' and ({ids} or {sequence}) then 'text' when semantic_type = 'Numeric' then 'numeric'
 when semantic_type = 'Categorical' and {ids} and distinct_ = rows then 'text' when semantic_type = 'Categorical' and distinct_ between 2 and 40 then 'categorical'
 when semantic_type = 'Date/Time' then 'datetime' when semantic_type = 'Boolean' then 'boolean' else 'text' end as role from y)"""


SOURCES = {
    "part": ("part", PART, ["p_partkey", "p_size"], lambda t: t("part")),
    "named_lines": (NAMED, NAMED_COLUMNS, ["order_id"], _named),
}
METRIC = "(" + " or ".join(f"regexp_matches(lower(col), '(^|_){w}$')" for w in W.METRIC_WORDS.split()) + ")"
CATEGORY = "(" + " or ".join(f"regexp_matches(lower(col), '(^|_){w}$')" for w in W.CATEGORY_WORDS.split()) + ")"
FILLED = "(1.0 - missing::double / rows)"
SCORE = f"""case when role = 'numeric' then case when {METRIC} then 12.0 else 0 end + case when variance > 0 then 4.0 else 0 end + {FILLED} * 3 + case when distinct_ > 5 then 2.0 else 0 end
 else case when distinct_ between 2 and 12 then 10.0 when distinct_ between 13 and 25 then 5.0 else 0 end + case when {CATEGORY} then 8.0 else 0 end + {FILLED} * 2 end"""

for _name, (_source, _columns, _integers, _make) in SOURCES.items():
    query(f"dash_columns_{_name}", f'with {roles_sql(_source, _columns, _integers)} select position, col as "column", semantic_type, distinct_ as "distinct", role from w')(
        lambda t, f=_make: B.analytic_columns(f(t))
    )
    query(f"dash_rank_{_name}", f"""with {roles_sql(_source, _columns, _integers)} select position, col as "column", role, distinct_ as "distinct", {r(SCORE)} as score from w
 where role in ('numeric', 'categorical') and non_null > 0""")(lambda t, f=_make: B.ranked_columns(f(t)))

SHORT2 = "case when abs({0}) >= 1000000 then format('{{:.2f}}M', {0} / 1000000) when abs({0}) >= 1000 then format('{{:.1f}}K', {0} / 1000) else format('{{:,.2f}}', {0}) end"


def kpi_sql(source: str, column: str, label: str, agg: str) -> str:
    f = "sum" if agg == "Total" else "avg"
    return f"""select '{column}' as "column", '{label}' as label, '{agg}' as aggregation, {r(f'{f}({column})', 2)} as value, {SHORT2.format(f'{f}({column})')} as text,
 {r(q(column, 0.5), 2)} as median, {r(f'stddev_samp({column})', 2)} as std from {source}"""


@query("dash_primary_kpi", kpi_sql(NAMED, "total_price", "Total Total Price", "Total"), digits=2)
def _(t: Tables) -> DataFrame:
    return B.primary_kpi(_named(t), "total_price")


@query("dash_primary_kpi_mean", kpi_sql("part", "p_retailprice", "Average P Retailprice", "Average"), digits=2)
def _(t: Tables) -> DataFrame:
    return B.primary_kpi(t("part"), "p_retailprice")


COMPLETE = f"(select * from {NAMED} where quantity is not null and total_price is not null and discount is not null and tax is not null)"
FOUR = ["quantity", "total_price", "discount", "tax"]
MISSING = "count(*) * 8 - " + " - ".join(f"count({c})" for c, _ in NAMED_COLUMNS)


@query("dash_insights", f"""with {duplicates_sql(NAMED)}, c as ({pairs_sql(COMPLETE, FOUR, None)}),
 v as (select * from ({' union all '.join(f"select {n} as pos, '{c}' as col, avg({c}) as m, stddev_samp({c}) as s from {NAMED}" for n, c in enumerate(FOUR))}) where m <> 0 order by abs(s / m) desc, pos limit 1)
 select 'Data Completeness' as title, 'missing cells' as subject, ({MISSING})::double as value, {r(f'({MISSING}) * 100.0 / (count(*) * 8)')} as extra from {NAMED}
 union all (select 'Category Distribution', 'region_status: ' || region_status, count(*), {r(f'count(*) * 100.0 / (select count(*) from {NAMED})')} from {NAMED} where region_status is not null group by region_status order by count(*) desc, region_status limit 1)
 union all select 'Feature Variability', col, {r('m')}, {r('s')} from v
 union all (select case when abs(r) >= 0.65 then 'Strong Correlation Detected' else 'Moderate Relationship' end, var1 || ' ↔ ' || var2, {r('r')}, null
 from (select * from c order by round(abs(r), 9) desc, var1, var2 limit 1) where abs(r) >= 0.35)
 union all select 'Temporal Coverage', {day('min(ship_date)')} || ' to ' || {day('max(ship_date)')}, date_diff('second', min(ship_date), max(ship_date)) // 86400, null from {NAMED}
 union all select 'Record Redundancy', 'duplicate rows', duplicate_rows, {r('duplicate_pct')} from dup where duplicate_rows > 0""")
def _(t: Tables) -> DataFrame:
    return B.smart_insights(_named(t))


def top_other_sql(source: str, column: str, n: int) -> str:
    return f"""select label, records from (with c as (select {column}::varchar as label, count(*) as records from {source} where {column} is not null group by {column}),
 k as (select *, row_number() over (order by records desc, label) as place from c)
 select case when place <= {n} then label else 'Other' end as label, sum(records)::bigint as records from k group by 1)"""


@query("dash_top_other", top_other_sql("part", "p_brand", 8))
def _(t: Tables) -> DataFrame:
    return B.top_and_other(t("part"), "p_brand", 8)


def trend_sql(source: str, time: str, bucket: str, value: str) -> str:
    label = {
        "m": "last_day({0})", "w": "({0} - ((isodow({0}) - 1) * interval 1 day) + interval 6 day)::date", "d": "{0}",
    }[bucket]
    return f"""with e as (select {time}::date as d, {value} as v from {source} where {time} is not null),
 s as (select {label.format('d')} as period, sum(v) as v from e group by 1),
 a as (select distinct {label.format('x::date')} as period from (select unnest(generate_series((select min(d) from e), (select max(d) from e), interval 1 day)) as x))
 select strftime(a.period, '%Y-%m-%d') as period, {r('coalesce(s.v, 0)', 2)} as value from a left join s on a.period = s.period"""


WEEKLY = "(select o_totalprice, timestamp '1995-01-01' + to_days((date_diff('day', timestamp '1995-01-01', o_orderdate) % 180)::int) as d from orders)"


@query("dash_time_trend_m", trend_sql("orders", "o_orderdate", "m", "o_totalprice"), digits=2)
def _(t: Tables) -> DataFrame:
    return B.time_trend(t("orders"), "o_orderdate", "o_totalprice")


@query("dash_time_trend_w", trend_sql(WEEKLY, "d", "w", "o_totalprice"), digits=2)
def _(t: Tables) -> DataFrame:
    days = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1995-01-01").cast("date")) % 180
    folded = t("orders").select("o_totalprice", F.date_add(F.lit("1995-01-01").cast("date"), days).alias("d"))
    return B.time_trend(folded, "d", "o_totalprice")


@query("dash_time_trend_d", trend_sql("events", "ts", "d", "1"), digits=2)
def _(t: Tables) -> DataFrame:
    return B.time_trend(t("events"), "ts")


@query("dash_corr", f"""with c as ({pairs_sql(COMPLETE, FOUR, None)}), b as (select var1 as v1, var2 as v2 from c order by round(abs(r), 9) desc, var1, var2 limit 1)
 select var1, var2, {r('r')} as r, var1 = v1 and var2 = v2 as strongest from c, b""")
def _(t: Tables) -> DataFrame:
    return B.correlation_snapshot(_named(t), FOUR)


@query("dash_scatter", f"""select l_orderkey, l_linenumber::bigint as l_linenumber, l_partkey, l_suppkey, {r('l_quantity')} as l_quantity, {r('l_extendedprice')} as l_extendedprice
 from {source_sql('lineitem_gaps')} where l_quantity is not null""")
def _(t: Tables) -> DataFrame:
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    return C.first_points(t("lineitem_gaps"), "l_quantity", "l_extendedprice", keys)


EIGHT = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("dash_corr_all", f"""with c as ({pairs_sql('lineitem', EIGHT, None)}), b as (select var1 as v1, var2 as v2 from c order by round(abs(r), 9) desc, var1, var2 limit 1)
 select var1, var2, {r('r')} as r, var1 = v1 and var2 = v2 as strongest from c, b""")
def _(t: Tables) -> DataFrame:
    return B.correlation_snapshot(t("lineitem"), EIGHT)


@query("dash_slicer", "select distinct c_mktsegment as value from " + source_sql("customer_gaps") + " where c_mktsegment is not null")
def _(t: Tables) -> DataFrame:
    return B.slicer_values(t("customer_gaps"), "c_mktsegment")


@query("dash_slicer_numbers", "select distinct o_custkey::varchar as value from orders")
def _(t: Tables) -> DataFrame:
    return B.slicer_values(t("orders"), "o_custkey")


@query("dash_sliced", f"select p_partkey, p_name, p_brand, p_type, p_size::bigint as p_size, {r('p_retailprice')} as p_retailprice from part where p_type = 'PROMO'")
def _(t: Tables) -> DataFrame:
    return B.sliced(t("part"), "p_type", "PROMO")


@query("dash_distribution", histogram_sql("part", "p_size", 25))
def _(t: Tables) -> DataFrame:
    return B.numeric_distribution(t("part"), "p_size")


# --- the four views ----------------------------------------------------------------------------------------------------
# Ranked metrics of the named lines: total_price and discount score alike and keep table order; quantity has gaps.
VIEW = f"(select * from {NAMED} where flag = 'O')"


@query("dash_executive", f"""with {score_sql(NAMED_COLUMNS, VIEW)}
 select 1::bigint as card, 'Total Total Price' as label, 'total_price' as subject, {r('sum(total_price)', 2)} as value, {r(q('total_price', 0.5), 2)} as extra from {VIEW}
 union all select 2, 'Average', 'discount', {r('avg(discount)', 2)}, {r('max(discount)', 2)} from {VIEW}
 union all select 3, 'Data Quality Index', {STATUS}, {r('score', 1)}, {r('completeness', 1)} from sc
 union all select 4, 'Active Data Scope', null, count(*), {r(f'count(*) * 100.0 / (select count(*) from {NAMED})', 2)} from {VIEW}""", digits=2)
def _(t: Tables) -> DataFrame:
    whole = _named(t)
    return B.executive_cards(B.sliced(whole, "flag", "O"), whole)


def segment_sql(card: int, column: str) -> str:
    return f"""(select {card}::bigint as card, '{column}' as label, {column} as subject, (select count(distinct {column}) from part)::double as value,
 {r('count(*) * 100.0 / (select count(*) from part)')} as extra from part group by {column} order by count(*) desc, {column} limit 1)"""


@query("dash_segments", f"""{segment_sql(1, 'p_type')} union all {segment_sql(2, 'p_brand')}
 union all select 3, 'Total Categorical Fields', null, 2, count(*)::double from part union all select 4, 'Total Categorical Fields', null, 2, count(*) from part""")
def _(t: Tables) -> DataFrame:
    return B.segment_cards(t("part"))


@query("dash_segment_bars", " union all ".join(f"select '{c}' as \"column\", label, records from ({top_other_sql('part', c, 10)})" for c in ("p_type", "p_brand")))
def _(t: Tables) -> DataFrame:
    return B.segment_bars(t("part"))


@query("dash_drivers", f"""with c as ({pairs_sql(COMPLETE, FOUR, None)})
 (select 1::bigint as card, 'Strongest Correlation' as label, var1 || ' ↔ ' || var2 as subject, {r('r')} as value, n::double as extra from c order by round(abs(r), 9) desc, var1, var2 limit 1)
 union all select 2, 'Variance', 'discount', {r('stddev_samp(discount)')}, {r('avg(discount)')} from {NAMED}
 union all select 3, 'Variance', 'quantity', {r('stddev_samp(quantity)')}, {r('avg(quantity)')} from {NAMED}
 union all select 4, 'Variance', 'tax', {r('stddev_samp(tax)')}, {r('avg(tax)')} from {NAMED}""")
def _(t: Tables) -> DataFrame:
    return B.driver_cards(_named(t))


EVENT_COLUMNS = [("event_id", "numeric"), ("ts", "datetime"), ("user_id", "numeric"), ("event_type", "text"), ("value", "numeric")]
GAPPED = source_sql("events_gaps")
GAPPED_MISSING = "count(*) * 5 - count(event_id) - count(user_id) - count(event_type) - count(value) - count(ts)"


@query("dash_anomalies", f"""with {score_sql(EVENT_COLUMNS, GAPPED)}
 select 1::bigint as card, 'Total Potential Outliers' as label, null::varchar as subject, outliers::double as value, null::double as extra from p where col = 'value'
 union all select 2, 'Missing Data Cells', null, {GAPPED_MISSING}, {r(f'({GAPPED_MISSING}) * 100.0 / (count(*) * 5)', 2)} from {GAPPED}
 union all select 3, 'Duplicate Rows', null, duplicate_rows, {r('duplicate_pct', 2)} from dup
 union all select 4, 'Health Index', {STATUS}, {r('score', 1)}, null from sc""", digits=2)
def _(t: Tables) -> DataFrame:
    return B.anomaly_cards(t("events_gaps"))


@query("dash_type_mix", f"with {profile_sql('part', PART)} select {SEMANTIC} as semantic_type, count(*) as columns from p group by 1")
def _(t: Tables) -> DataFrame:
    return B.type_mix(t("part"))
