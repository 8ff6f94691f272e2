"""Preparation: fills, duplicates, columns, casts, filters, outliers, text, dates, arithmetic, pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import outliers as O, preparation as R
from ..plans.pipeline import Preparation, Step
from .audit import WHOLE_LINE, score_sql
from .registry import Tables, query, source_sql
from .sqltext import duplicates_sql, i, profile_sql, r, ts
from .tables import CUSTOMER, EVENTS, ORDERS

GAPS = source_sql("lineitem_gaps")
LINE = {
    "l_orderkey": "l_orderkey", "l_partkey": "l_partkey", "l_suppkey": "l_suppkey", "l_linenumber": i("l_linenumber"),
    "l_quantity": r("l_quantity"), "l_extendedprice": r("l_extendedprice"), "l_discount": r("l_discount"),
    "l_returnflag": "l_returnflag", "l_linestatus": "l_linestatus", "l_shipdate": ts("l_shipdate"),
}
ORDER = {
    "o_orderkey": "o_orderkey", "o_custkey": "o_custkey", "o_orderstatus": "o_orderstatus",
    "o_totalprice": r("o_totalprice"), "o_orderdate": ts("o_orderdate"), "o_orderpriority": "o_orderpriority",
}
PART = {
    "p_partkey": "p_partkey", "p_name": "p_name", "p_brand": "p_brand", "p_type": "p_type", "p_size": i("p_size"),
    "p_retailprice": r("p_retailprice"),
}
EVENT = {
    "event_id": "event_id", "ts": ts("ts"), "user_id": "user_id", "event_type": "event_type", "value": r("value"),
    "props": "props",
}
EVENT_GAPS = {k: v for k, v in EVENT.items() if k != "props"}


def row(fields: dict[str, str], source: str, where: str = "", drop: tuple[str, ...] = (), **replaced: str) -> str:
    shown = {**fields, **replaced}
    listed = ", ".join(f"{e} as {c}" for c, e in shown.items() if c not in drop)
    return f"select {listed} from {source} {where}"


# --- missing values ------------------------------------------------------------------------------------------------
ADVICE = f"""case when missing = 0 then 'Complete (No Action Needed)' when missing_pct > 70 then 'Consider Dropping Column (>70% missing)'
 when kind = 'numeric' and abs(skewness) > 1 then 'Fill with Median (Skewed)' when kind = 'numeric' then 'Fill with Mean or Median'
 when kind = 'datetime' then 'Drop Rows or Forward Fill' else 'Fill with Mode or ''Unknown''' end"""
for _source, _columns in (("orders_gaps", ORDERS), ("events_gaps", EVENTS[:5]), ("customer_gaps", CUSTOMER)):
    query(f"prep_missing_summary_{_source}", f"""with {profile_sql(_source, _columns)} select col as "column", missing, {r('missing_pct', 2)} as missing_pct,
 {ADVICE} as advice from p""", digits=2)(lambda t, s=_source: R.missing_summary(t(s)).drop("dtype"))


@query("prep_drop_rows", row(LINE, GAPS, "where l_quantity is not null and l_returnflag is not null"))
def _(t: Tables) -> DataFrame:
    return R.drop_missing_rows(t("lineitem_gaps"), ["l_quantity", "l_returnflag"])


def _fill(name: str, sql: str, column: str, strategy: str, **options) -> None:
    query(f"prep_fill_{name}", sql)(lambda t: R.fill_missing(t("lineitem_gaps"), [column], strategy, **options))


_fill("mean", row(LINE, GAPS, l_quantity=r(f"coalesce(l_quantity, (select avg(l_quantity) from {GAPS}))")), "l_quantity", "mean")
_fill("median", row(LINE, GAPS, l_quantity=r(f"coalesce(l_quantity, (select quantile_cont(l_quantity, 0.5) from {GAPS}))")), "l_quantity", "median")
_fill("zero", row(LINE, GAPS, l_quantity=r("coalesce(l_quantity, 0)")), "l_quantity", "zero")
_fill("zero_text", row(LINE, GAPS, l_returnflag="coalesce(l_returnflag, '0')"), "l_returnflag", "zero")
_fill(
    "mode",
    row(LINE, GAPS, l_returnflag=f"coalesce(l_returnflag, (select l_returnflag from {GAPS} where l_returnflag is not null group by 1 order by count(*) desc, 1 limit 1))"),
    "l_returnflag", "mode",
)
_fill("unknown", row(LINE, GAPS, l_returnflag="coalesce(l_returnflag, 'Unknown')"), "l_returnflag", "unknown")
_fill("custom", row(LINE, GAPS, l_quantity=r("coalesce(l_quantity, 12.5)")), "l_quantity", "custom", custom="12.5")
_fill("custom_text", row(LINE, GAPS, l_returnflag="coalesce(l_returnflag, 'none')"), "l_returnflag", "custom", custom="none")

EVENTS_GAPS = source_sql("events_gaps")
for _name, _part in (("", None), ("_by_user", ["user_id"])):
    _p = "partition by user_id " if _part else ""
    _last = f"last_value(value ignore nulls) over ({_p}order by event_id rows between unbounded preceding and current row)"
    _first = f"first_value(value ignore nulls) over ({_p}order by event_id rows between current row and unbounded following)"
    query(f"prep_ffill{_name}", row(EVENT_GAPS, EVENTS_GAPS, value=r(_last)))(
        lambda t, p=_part: R.fill_missing(t("events_gaps"), ["value"], "ffill", order_by="event_id", partition_by=p)
    )
    query(f"prep_bfill{_name}", row(EVENT_GAPS, EVENTS_GAPS, value=r(_first)))(
        lambda t, p=_part: R.fill_missing(t("events_gaps"), ["value"], "bfill", order_by="event_id", partition_by=p)
    )


@query("prep_step_report", f"""select count(*) as rows_before, count(*) as rows_after, 10::bigint as columns_before, 10::bigint as columns_after,
 count(*) - count(l_quantity) as missing_before, 0::bigint as missing_after, count(*) - count(l_quantity) as affected from {GAPS}""")
def _(t: Tables) -> DataFrame:
    before = t("lineitem_gaps")
    return R.step_report(before, R.fill_missing(before, ["l_quantity"], "mean"), ["l_quantity"])


# --- duplicates ----------------------------------------------------------------------------------------------------
@query("prep_dup_info", f"with {duplicates_sql('(select user_id, event_type from events)')} select rows as total_rows, duplicate_rows as duplicate_count, {r('duplicate_pct', 2)} as duplicate_pct from dup", digits=2)
def _(t: Tables) -> DataFrame:
    return R.duplicate_info(t("events"), ["user_id", "event_type"])


@query("prep_dup_copies", row(ORDER, "orders", "where (o_custkey, o_orderpriority) in (select (o_custkey, o_orderpriority) from orders group by o_custkey, o_orderpriority having count(*) > 1)"))
def _(t: Tables) -> DataFrame:
    from ..operators.quality import duplicate_rows

    return duplicate_rows(t("orders"), ["o_custkey", "o_orderpriority"])


for _keep, _direction in (("first", "asc"), ("last", "desc")):
    query(f"prep_dedup_{_keep}", row(EVENT, f"(select * from events qualify row_number() over (partition by user_id, event_type order by event_id {_direction}) = 1)"))(
        lambda t, k=_keep: R.drop_duplicates(t("events"), ["user_id", "event_type"], k, ["event_id"])
    )


@query("prep_dedup_rows", f"select distinct l_returnflag, l_linestatus, {r('l_quantity')} as l_quantity, {r('l_discount')} as l_discount from lineitem")
def _(t: Tables) -> DataFrame:
    return R.drop_duplicates(t("line_choices"))


@query("prep_dedup_lines", f"select distinct {WHOLE_LINE} from {source_sql('lineitem_repeated')}")
def _(t: Tables) -> DataFrame:
    return R.drop_duplicates(t("lineitem_repeated"))


# --- columns -------------------------------------------------------------------------------------------------------
@query("prep_rename", f"select o_orderkey, o_custkey, o_orderstatus, {r('o_totalprice')} as total, {ts('o_orderdate')} as o_orderdate, o_orderpriority from orders")
def _(t: Tables) -> DataFrame:
    return R.rename_column(t("orders"), "o_totalprice", " total ")


@query("prep_drop_cols", row(ORDER, "orders", drop=("o_orderdate", "o_orderpriority")))
def _(t: Tables) -> DataFrame:
    return R.drop_columns(t("orders"), ["o_orderdate", "o_orderpriority", "absent"])


@query("prep_reorder", row(ORDER, "orders"))
def _(t: Tables) -> DataFrame:
    return R.reorder_columns(t("orders"), ["o_totalprice", "o_orderdate"])


TEXTS = source_sql("order_texts")
TEXT = {
    "o_orderkey": "o_orderkey", "mixed": "mixed", "fee": "fee", "price_text": "price_text", "flag": "flag", "order_day": "order_day",
    "hundreds": r("hundreds"),
}
CASTS = {
    "numeric": ("mixed", "Numeric", r("try_cast(mixed as double)")),
    "float": ("price_text", "Float", r("try_cast(trim(price_text) as double)")),
    "integer": ("hundreds", "Integer", i("round_even(hundreds, 0)")),
    "string": ("o_orderkey", "String", "cast(o_orderkey as varchar)"),
    "category": ("flag", "Category", "flag"),
    "boolean": ("flag", "Boolean", "case when trim(lower(flag)) in ('yes', 'active', 'true') then true when trim(lower(flag)) in ('no', 'inactive', 'false') then false end"),
    "datetime": ("order_day", "Datetime", ts("strptime(order_day, '%Y-%m-%d')")),
}
for _name, (_column, _target, _sql) in CASTS.items():
    query(f"prep_cast_{_name}", row(TEXT, TEXTS, **{_column: _sql}))(
        lambda t, c=_column, k=_target: R.cast_column(t("order_texts"), c, k)
    )


@query("prep_cast_report", f"select count(try_cast(mixed as double)) as converted, count(*) - count(try_cast(mixed as double)) as coerced from {TEXTS}")
def _(t: Tables) -> DataFrame:
    before = t("order_texts")
    return R.cast_report(before, R.cast_column(before, "mixed", "Numeric"), "mixed")


@query("prep_cast_clean", row(TEXT, TEXTS, fee=r("try_cast(regexp_replace(fee, '[,$€£₹\\s%]', '', 'g') as double)")))
def _(t: Tables) -> DataFrame:
    from ..operators.decisions import Repair, apply_repair

    return apply_repair(t("order_texts"), Repair("cast_numeric_clean", "fee"))


# --- filters and order -----------------------------------------------------------------------------------------------
def _filter(name: str, source: str, rules: list[dict], where: str, fields: dict[str, str]) -> None:
    query(f"filter_{name}", row(fields, source_sql(source), f"where {where}"))(lambda t: R.filter_rows(t(source), rules))


def rule(column: str, operator: str, value=None, end=None) -> dict:
    return {"column": column, "operator": operator, "value": value, "value_end": end}


NUMERIC_FILTERS = {
    "equals": (rule("l_quantity", "Equals (=)", 10), "l_quantity = 10"),
    "not_equals": (rule("l_quantity", "Not Equals (!=)", 10), "l_quantity is distinct from 10"),
    "greater": (rule("l_quantity", "Greater Than (>)", 45), "l_quantity > 45"),
    "greater_equal": (rule("l_quantity", "Greater or Equal (>=)", 45), "l_quantity >= 45"),
    "less": (rule("l_quantity", "Less Than (<)", 5), "l_quantity < 5"),
    "less_equal": (rule("l_quantity", "Less or Equal (<=)", 5), "l_quantity <= 5"),
    "between": (rule("l_quantity", "Between", 20, 10), "l_quantity between 10 and 20"),
    "null": (rule("l_quantity", "Is Null / Missing"), "l_quantity is null"),
    "not_null": (rule("l_quantity", "Is Not Null"), "l_quantity is not null"),
}
for _name, (_rule, _where) in NUMERIC_FILTERS.items():
    _filter(f"numeric_{_name}", "lineitem_gaps", [_rule], _where, LINE)

DATE_FILTERS = {
    "before": (rule("o_orderdate", "Before (<)", "1996-01-01"), "o_orderdate < timestamp '1996-01-01'"),
    "after": (rule("o_orderdate", "After (>)", "2000-06-30 12:00:00"), "o_orderdate > timestamp '2000-06-30 12:00:00'"),
    "equals": (rule("o_orderdate", "Equals", "1997-05-28 10:00:00"), "cast(o_orderdate as date) = date '1997-05-28'"),
    "between": (rule("o_orderdate", "Between", "1997-01-01", "1997-12-31"), "o_orderdate between timestamp '1997-01-01' and timestamp '1997-12-31'"),
    "null": (rule("o_orderdate", "Is Null / Missing"), "o_orderdate is null"),
    "not_null": (rule("o_orderdate", "Is Not Null"), "o_orderdate is not null"),
}
for _name, (_rule, _where) in DATE_FILTERS.items():
    _filter(f"datetime_{_name}", "orders_gaps", [_rule], _where, ORDER)

TEXT_FILTERS = {
    "equals": (rule("p_type", "Equals", "Promo"), "lower(p_type) = 'promo'"),
    "not_equals": (rule("p_type", "Not Equals", "Promo"), "lower(p_type) is distinct from 'promo'"),
    "contains": (rule("p_name", "Contains", "RED"), "contains(lower(p_name), 'red')"),
    "starts": (rule("p_name", "Starts with", "Small"), "starts_with(lower(p_name), 'small')"),
    "ends": (rule("p_name", "Ends with", "Ring"), "ends_with(lower(p_name), 'ring')"),
    "one_of_list": (rule("p_brand", "Is one of", ["brand#2", "Brand#17"]), "lower(p_brand) in ('brand#2', 'brand#17')"),
    "one_of_text": (rule("p_brand", "Is one of", "brand#2, Brand#17 ,"), "lower(p_brand) in ('brand#2', 'brand#17')"),
}
for _name, (_rule, _where) in TEXT_FILTERS.items():
    _filter(f"text_{_name}", "part", [_rule], _where, PART)

CUST = {
    "c_custkey": "c_custkey", "c_name": "c_name", "c_nationkey": i("c_nationkey"), "c_acctbal": r("c_acctbal"), "c_mktsegment": "c_mktsegment",
}
_filter("text_blank", "customer_gaps", [rule("c_mktsegment", "Is Null / Missing")], "c_mktsegment is null or trim(c_mktsegment) = ''", CUST)
_filter("text_not_blank", "customer_gaps", [rule("c_mktsegment", "Is Not Null")], "trim(c_mktsegment) <> ''", CUST)
_filter(
    "compound", "orders_gaps",
    [
        rule("o_orderstatus", "Is one of", "F, O"), rule("o_totalprice", "Greater Than (>)", "250000"),
        rule("o_orderdate", "After (>)", "1998-01-01"), rule("o_totalprice", "Less Than (<)", "not a number"), rule("absent", "Equals", 1),
    ],
    "o_orderstatus in ('F', 'O') and o_totalprice > 250000 and o_orderdate > timestamp '1998-01-01'", ORDER,
)


@query("sort_rows", row(LINE, GAPS))
def _(t: Tables) -> DataFrame:
    keys = ["l_returnflag", "l_quantity", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    return R.sort_rows(t("lineitem_gaps"), keys, [False, True])


MIXED = {
    0: ("date_format(o_orderdate, \"yyyy-MM-dd'T'HH:mm:ss.SSS\")", "o_orderdate"),
    1: ("date_format(o_orderdate, \"yyyy-MM-dd'T'HH:mm:ss'Z'\")", "o_orderdate"),
    2: ("date_format(o_orderdate, 'MMMM d, yyyy')", "date_trunc('day', o_orderdate)"),
    3: ("date_format(o_orderdate, 'M/d/yyyy HH:mm')", "date_trunc('minute', o_orderdate)"),
    4: ("'no date'", "null::timestamp"),
}


@query("prep_cast_datetime_mixed", f"select o_orderkey, {ts('case ' + ' '.join(f'when o_orderkey % 5 = {k} then {x[1]}' for k, x in MIXED.items()) + ' end')} as day from orders")
def _(t: Tables) -> DataFrame:
    text = "case " + " ".join(f"when o_orderkey % 5 = {k} then {x[0]}" for k, x in MIXED.items()) + " end"
    return R.cast_column(t("orders").selectExpr("o_orderkey", f"{text} as day"), "day", "Datetime")


# --- outliers --------------------------------------------------------------------------------------------------------
FENCE = "(select z[1] - 1.5 * (z[2] - z[1]) as lo, z[2] + 1.5 * (z[2] - z[1]) as hi, z[1] as q1, z[2] as q3 from (select quantile_cont(value, [0.25, 0.75]) as z from {0}))"
EVENT_FENCE = f"events, {FENCE.format('events')}"
GAPS_FENCE = f"{EVENTS_GAPS}, {FENCE.format(EVENTS_GAPS)}"


@query("outlier_rows", row(EVENT, EVENT_FENCE, "where value < lo or value > hi"))
def _(t: Tables) -> DataFrame:
    return O.outlier_rows(t("events"), "value")


@query("outlier_profile", f"select count(*) filter (where value < lo or value > hi) as outliers, {r('min(lo)', 6)} as lower, {r('min(hi)', 6)} as upper, {r('min(q1)', 6)} as q1, {r('min(q3)', 6)} as q3, {r('min(q3 - q1)', 6)} as iqr from {EVENT_FENCE}", digits=6)
def _(t: Tables) -> DataFrame:
    return O.outlier_profile(t("events"), "value")


@query("outlier_remove", row(EVENT_GAPS, GAPS_FENCE, "where value is null or value between lo and hi"))
def _(t: Tables) -> DataFrame:
    return O.remove_outliers(t("events_gaps"), "value")


@query("outlier_cap", row(EVENT_GAPS, GAPS_FENCE, value=r("case when value is not null then least(greatest(value, lo), hi) end")))
def _(t: Tables) -> DataFrame:
    return O.cap(t("events_gaps"), "value")


@query("outlier_clip_custom", row(EVENT_GAPS, EVENTS_GAPS, value=r("case when value is not null then least(greatest(value, 5.0), 100.0) end")))
def _(t: Tables) -> DataFrame:
    return O.clip(t("events_gaps"), "value", 5.0, 100.0)


# --- text, dates, arithmetic -----------------------------------------------------------------------------------------
TITLE = "list_aggregate(list_transform(regexp_extract_all({0}, '\\p{{L}}+|[^\\p{{L}}]+'), lambda x: upper(x[1:1]) || lower(x[2:])), 'string_agg', '')"
CLEANS = {
    "lower": (["lower"], None, None, "lower(p_name)"),
    "upper": (["upper"], None, None, "upper(p_name)"),
    "title": (["title"], None, None, TITLE.format("p_name")),
    "replace": (["find_replace"], "ring", "[x]", "replace(p_name, 'ring', '[x]')"),
    "chain": (["upper", "find_replace", "trim", "title"], "RED", " ", TITLE.format("trim(replace(upper(p_name), 'RED', ' '))")),
}
for _name, (_steps, _find, _new, _sql) in CLEANS.items():
    query(f"text_clean_{_name}", row(PART, "part", p_name=_sql))(
        lambda t, s=_steps, f=_find, n=_new: R.clean_text(t("part"), "p_name", s, f, n)
    )


@query("text_clean_documents", "select doc_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') as text, lang, source, n_chars from documents")
def _(t: Tables) -> DataFrame:
    return R.clean_text(t("documents"), "text", ["trim"])


@query("text_clean_blank", row(CUST, source_sql("customer_gaps"), c_mktsegment="case when trim(c_mktsegment) <> '' then c_mktsegment end"))
def _(t: Tables) -> DataFrame:
    return R.clean_text(t("customer_gaps"), "c_mktsegment", ["remove_empty"])


@query("date_parts", f"""select o_orderkey, year(o_orderdate) as "d_Year", month(o_orderdate) as "d_Month", day(o_orderdate) as "d_Day",
 dayname(o_orderdate) as "d_DayOfWeek", quarter(o_orderdate) as "d_Quarter" from {source_sql('orders_gaps')}""")
def _(t: Tables) -> DataFrame:
    parts = ["year", "month", "day", "day_of_week", "quarter"]
    return R.date_parts(t("orders_gaps"), "o_orderdate", parts, "d").select(
        "o_orderkey", "d_Year", "d_Month", "d_Day", "d_DayOfWeek", "d_Quarter"
    )


DERIVED = {
    "add": ("l_extendedprice", "l_quantity", None, "l_extendedprice + l_quantity"),
    "subtract": ("l_extendedprice", None, 100, "l_extendedprice - 100.0::double"),
    "multiply": ("l_quantity", "l_discount", None, "l_quantity * l_discount"),
    "divide": ("l_extendedprice", "l_discount", None, "l_extendedprice / nullif(l_discount, 0)"),
    "percentage": ("l_quantity", "l_extendedprice", None, "l_quantity / nullif(l_extendedprice, 0) * 100"),
}
for _name, (_a, _b, _constant, _sql) in DERIVED.items():
    query(f"derive_{_name}", f"select l_orderkey, l_linenumber::bigint as l_linenumber, l_partkey, l_suppkey, {r(_sql)} as derived from {GAPS}")(
        lambda t, a=_a, b=_b, k=_constant, n=_name: R.derive(t("lineitem_gaps"), "derived", a, n, b, k).select(
            "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "derived"
        )
    )


# --- pipeline ----------------------------------------------------------------------------------------------------------
def _pipeline(t: Tables) -> Preparation:
    return (
        Preparation(t("events_gaps"))
        .then(Step("missing", "Fill value with its mean", lambda d: R.fill_missing(d, ["value"], "mean"), "value", "mean", "gaps"))
        .then(Step("missing", "Drop rows without a type", lambda d: R.drop_missing_rows(d, ["event_type"]), "event_type", "drop_rows"))
        .then(Step("columns", "Drop the user", lambda d: R.drop_columns(d, ["user_id"]), "user_id", "drop_cols"))
    )


LOG_KEPT = f"(select count(*) from {EVENTS_GAPS} where event_type is not null)"
STAGES = (
    ([c for c in EVENTS if c[0] != "props"], EVENTS_GAPS),
    ([c for c in EVENTS if c[0] != "props"], f"(select event_id, ts, user_id, event_type, coalesce(value, (select avg(value) from {EVENTS_GAPS})) as value from {EVENTS_GAPS})"),
)
STAGES += ((STAGES[0][0], f"(select * from {STAGES[1][1]} where event_type is not null)"),)
STAGES += (([c for c in EVENTS if c[0] not in ("props", "user_id")], f"(select event_id, ts, event_type, value from {STAGES[2][1]})"),)
SCORES = [f"(with {score_sql(c, 'events_gaps').replace(EVENTS_GAPS, s)} select score from sc)" for c, s in STAGES]


@query("prep_pipeline_log", f"""select step, type, description, "column", strategy, reason, rows_before, rows_after, columns_before, columns_after,
 {r('after_ - before_', 1)} as score_delta from (
 select 1::bigint as step, 'missing' as type, 'Fill value with its mean' as description, 'value' as "column", 'mean' as strategy, 'gaps' as reason,
 (select count(*) from events) as rows_before, (select count(*) from events) as rows_after, 5::bigint as columns_before, 5::bigint as columns_after,
 {SCORES[0]} as before_, {SCORES[1]} as after_
 union all select 2, 'missing', 'Drop rows without a type', 'event_type', 'drop_rows', '', (select count(*) from events), {LOG_KEPT}, 5, 5, {SCORES[1]}, {SCORES[2]}
 union all select 3, 'columns', 'Drop the user', 'user_id', 'drop_cols', '', {LOG_KEPT}, {LOG_KEPT}, 5, 4, {SCORES[2]}, {SCORES[3]})""", digits=1)
def _(t: Tables) -> DataFrame:
    return _pipeline(t).log(scores=True)


@query("prep_pipeline_result", f"select event_id, {ts('ts')} as ts, event_type, {r('value')} as value from {STAGES[3][1]}")
def _(t: Tables) -> DataFrame:
    return _pipeline(t).result()


@query("prep_pipeline_undo", row(EVENT_GAPS, STAGES[2][1]))
def _(t: Tables) -> DataFrame:
    return _pipeline(t).undo().result()


def _whole(source: str, width: int, gaps: str, label: str) -> str:
    return f"{label} as (select count(*) as n, {gaps} as m, count(*) - (select count(*) from (select distinct * from {source})) as d, {width} as w from {source})"


FIVE = "count(*) * 5 - count(event_id) - count(ts) - count(user_id) - count(event_type) - count(value)"
FOUR = "count(*) * 4 - count(event_id) - count(ts) - count(event_type) - count(value)"


@query("prep_summary", f"""with {_whole(EVENTS_GAPS, 5, FIVE, 'o')}, {_whole(STAGES[3][1], 4, FOUR, 'c')}
 select o.n as rows_before, c.n as rows_after, 5::bigint as columns_before, 4::bigint as columns_after,
 {r('100.0 - o.m * 100.0 / (o.n * o.w)')} as completeness_before, {r('100.0 - c.m * 100.0 / (c.n * c.w)')} as completeness_after,
 o.d as duplicates_before, c.d as duplicates_after, {i('o.m + o.d')} as issues_before, {i('c.m + c.d')} as pending,
 {i('greatest(0, o.m + o.d - c.m - c.d)')} as resolved from o, c""")
def _(t: Tables) -> DataFrame:
    plan = _pipeline(t)
    return R.preparation_summary(plan.source, plan.result())
