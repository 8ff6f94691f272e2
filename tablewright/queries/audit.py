"""Quality audit, repair decisions, their preview, application and check."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import decisions as D, quality as Q
from ..operators.decisions import Repair
from . import words as W
from .registry import Tables, query, source_sql
from .sqltext import duplicates_sql, i, pct, profile_sql, q, r, ts
from .tables import EVENTS, LINEITEM

LINEITEM_GAPS = [c for c in LINEITEM if c[0] != "l_tax"]
DIRTY_CUSTOMER = [
    ("c_custkey", "numeric"), ("c_name", "text"), ("segment", "text"), ("stock", "numeric"), ("discount_pct", "numeric"),
    ("balance", "numeric"), ("k", "text"), ("e", "numeric"), ("size_a", "numeric"), ("size_b", "numeric"), ("score_text", "text"),
]
DIRTY_EVENTS = [
    ("event_id", "numeric"), ("user_id", "numeric"), ("ts", "datetime"), ("event_type", "text"), ("value", "numeric"),
    ("age", "numeric"), ("amount", "numeric"),
]
DOCUMENTS = [("doc_id", "numeric"), ("text", "text"), ("lang", "text"), ("source", "text"), ("n_chars", "numeric")]
SEVERITY_ORDER = "list_position(['CRITICAL','HIGH','MEDIUM','LOW','INFO'], severity)"

# --- rules over the SQL profile ------------------------------------------------------------------------------
DISTINCT_PCT = pct("distinct_", "rows")
EMPTY = "non_null = 0"
CONSTANT = "(distinct_ = 1 and rows > 1)"
HIGH_CARD = f"(distinct_ > 50 and {DISTINCT_PCT} >= 85.0 and not is_id)"
MIXED = "(kind = 'text' and non_null >= 10 and number_like::double / non_null > 0.15 and number_like::double / non_null < 0.98)"
MIXED_PCT = pct("non_null - number_like", "non_null")
CHECKED = "(iqr is not null and non_null >= 5 and distinct_ > 2 and not is_id)"
OUT_PCT = pct("outliers", "non_null")

VALIDITY = f"""select position, col, 'Whitespace / Blank Strings' as issue, blank as count, {pct('blank', 'rows')} as pct,
 case when {pct('blank', 'rows')} < 5 then 'LOW' else 'MEDIUM' end as severity from p where blank > 0
 union all select position, col, 'Infinite Numeric Values', infinite, {pct('infinite', 'rows')}, 'HIGH' from p where infinite > 0
 union all select position, col, 'Unexpected Negative Values', negative, {pct('negative', 'rows')},
 case when contains(lower(col), 'age') then 'HIGH' else 'MEDIUM' end from p where negative > 0
 union all select position, col, 'Out-of-Bounds Percentage', out_of_percent, {pct('out_of_percent', 'rows')}, 'MEDIUM' from p where out_of_percent > 0"""


def copies_sql(columns: list[tuple[str, str]], source: str) -> str:
    """CTE ``cp``: identical column pairs of the same kind (fixture columns of one kind and type)."""
    parts = []
    for a in range(len(columns)):
        for b in range(a + 1, len(columns)):
            (x, kx), (y, ky) = columns[a], columns[b]
            if kx == ky:
                parts.append(
                    f"select '{x}' as a, '{y}' as b from {source_sql(source)} having count(*) filter (where {x} is distinct from {y}) = 0"
                )
    return f"cp as ({' union all '.join(parts)})"


def score_sql(columns: list[tuple[str, str]], source: str) -> str:
    """CTEs ending in ``sc``: one row of dimension scores and the overall score."""
    width = len(columns)
    return f"""{profile_sql(source, columns)}, {duplicates_sql(source)}, {copies_sql(columns, source)},
 tot as (select max(rows) as n, sum(missing) as missing, count(*) filter (where {EMPTY}) as empty,
 count(*) filter (where {CONSTANT}) as constant, coalesce(sum({MIXED_PCT}) filter (where {MIXED}), 0.0) as mixed,
 sum(blank + infinite + negative + out_of_percent) as invalid,
 coalesce(sum(outliers) filter (where {CHECKED} and iqr > 0), 0) as outliers,
 coalesce(sum(non_null) filter (where {CHECKED}), 0) as cells from p),
 dim as (select greatest(0.0, least(100.0, 100.0 - {pct('missing', f'n * {width}')} - empty * 10.0))::double as completeness,
 greatest(0.0, least(100.0, 100.0 - (select duplicate_pct from dup) * 2.5 - (select count(*) from cp) * 10.0))::double as uniqueness,
 greatest(0.0, least(100.0, 100.0 - constant * 6.0 - mixed * 0.5))::double as consistency,
 greatest(0.0, least(100.0, 100.0 - {pct('invalid', f'n * {width}')} * 3.5))::double as validity,
 greatest(0.0, least(100.0, 100.0 - {pct('outliers', 'cells')} * 2.5))::double as outlier_health from tot),
 sc as (select *, round(completeness * 0.30 + uniqueness * 0.20 + consistency * 0.20 + validity * 0.15 + outlier_health * 0.15, 1) as score from dim)"""


GRADE = "case when score >= 90 then 'A' when score >= 80 then 'B' when score >= 70 then 'C' when score >= 60 then 'D' else 'F' end"
STATUS = "case when score >= 90 then 'Excellent' when score >= 75 then 'Good' when score >= 60 then 'Needs Attention' when score >= 40 then 'Poor' else 'Critical' end"
SCORE_ROW = f"""select {r('score', 1)} as score, {GRADE} as grade, {STATUS} as status, {r('completeness', 1)} as completeness,
 {r('uniqueness', 1)} as uniqueness, {r('consistency', 1)} as consistency, {r('validity', 1)} as validity,
 {r('outlier_health', 1)} as outlier_health from sc"""


# --- single analyses -------------------------------------------------------------------------------------------
MISSING_SEVERITY = """case when missing_pct = 0 then 'Healthy' when missing_pct <= 5 then 'Low' when missing_pct <= 20 then 'Moderate'
 when missing_pct <= 50 then 'High' else 'Critical' end"""


@query("dq_missing", f"""with {profile_sql('lineitem_gaps', LINEITEM_GAPS)} select position, col as "column", missing,
 {r('missing_pct')} as missing_pct, non_null, {MISSING_SEVERITY} as severity from p""")
def _(t: Tables) -> DataFrame:
    return Q.missing_analysis(t("lineitem_gaps"))


CHOICES = "select l_returnflag, l_linestatus, l_quantity, l_discount, count(*) as n from lineitem group by all"


WHOLE_LINE = ", ".join(ts(c) + f" as {c}" if k == "datetime" else r(c) + f" as {c}" if c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax") else i(c) + f" as {c}" if c == "l_linenumber" else c for c, k in LINEITEM)


@query("dq_duplicate_rows", f"select {WHOLE_LINE}, count(*) as copies from {source_sql('lineitem_repeated')} group by all having count(*) > 1")
def _(t: Tables) -> DataFrame:
    return Q.duplicate_groups(t("lineitem_repeated"))


@query("dq_duplicate_choices", f"""select l_returnflag, l_linestatus, {r('l_quantity')} as l_quantity, {r('l_discount')} as l_discount,
 n as copies from ({CHOICES}) where n > 1""")
def _(t: Tables) -> DataFrame:
    return Q.duplicate_groups(t("line_choices"))


@query("dq_duplicate_copies", f"""select event_id, {ts('ts')} as ts, user_id, event_type, {r('value')} as value
 from {source_sql('events_repeated')} where event_type = 'purchase'""")
def _(t: Tables) -> DataFrame:
    return Q.duplicate_rows(t("events_repeated"))


@query("dq_duplicate_summary", f"with {duplicates_sql('events_repeated')} select rows, duplicate_rows, unique_rows, {r('duplicate_pct')} as duplicate_pct from dup")
def _(t: Tables) -> DataFrame:
    from ..operators.profile import duplicate_summary

    return duplicate_summary(t("events_repeated"))


@query("dq_duplicate_columns", f"with {copies_sql(DIRTY_CUSTOMER, 'customer_dirty')} select a as column_a, b as column_b from cp")
def _(t: Tables) -> DataFrame:
    return Q.duplicate_columns(t("customer_dirty"))


for _source, _columns in (("customer_dirty", DIRTY_CUSTOMER), ("documents", DOCUMENTS)):
    query(f"dq_structure_{_source}", f"""with {profile_sql(_source, _columns)}
 select col as "column", 'empty' as finding, null::varchar as detail, 100.0::double as measure from p where {EMPTY}
 union all select col, 'constant', top_value, non_null::double from p where {CONSTANT}
 union all select col, 'high_cardinality', distinct_::varchar, {r(DISTINCT_PCT)} from p where {HIGH_CARD}""")(
        lambda t, s=_source: Q.structure(t(s))
    )


@query("dq_mixed_types", f"""with {profile_sql('order_texts', [('mixed', 'text'), ('fee', 'text'), ('price_text', 'text'), ('flag', 'text'), ('order_day', 'text')])}
 select col as "column", non_null - number_like as count, {r(MIXED_PCT)} as pct,
 (select string_agg(m, ', ' order by o_orderkey) from (select mixed as m, o_orderkey from {source_sql('order_texts')}
 where try_cast(mixed as double) is null order by o_orderkey limit 3)) as samples from p where {MIXED}""")
def _(t: Tables) -> DataFrame:
    return Q.mixed_types(t("order_texts"), ["o_orderkey"])


for _source, _columns in (("customer_dirty", DIRTY_CUSTOMER), ("events_dirty", DIRTY_EVENTS)):
    query(f"dq_validity_{_source}", f"""with {profile_sql(_source, _columns)} select position, col as "column", issue, count,
 {r('pct')} as pct, severity from ({VALIDITY})""")(lambda t, s=_source: Q.validity(t(s)))

for _source, _columns in (("events", EVENTS), ("documents", DOCUMENTS), ("events_dirty", DIRTY_EVENTS)):
    query(f"dq_outliers_{_source}", f"""with {profile_sql(_source, _columns)} select col as "column", outliers as outlier_count,
 {r(OUT_PCT)} as outlier_pct, {r('lower_', 2)} as lower, {r('upper_', 2)} as upper, {r('min_', 2)} as min, {r('max_', 2)} as max
 from p where {CHECKED} and iqr > 0 and outliers > 0""")(lambda t, s=_source: Q.audit_outliers(t(s)))

AUDITED = (
    ("customer_dirty", DIRTY_CUSTOMER), ("events_dirty", DIRTY_EVENTS), ("lineitem_gaps", LINEITEM_GAPS), ("events", EVENTS),
)
for _source, _columns in AUDITED:
    query(f"dq_score_{_source}", f"with {score_sql(_columns, _source)} {SCORE_ROW}", digits=1)(
        lambda t, s=_source: Q.Audit(t(s), share=False).breakdown()
    )

# --- issues ------------------------------------------------------------------------------------------------------
SHOWN_PCT = "format('{:.1f}', missing_pct)"
ISSUES = f"""select col, 'CRITICAL' as severity, 'Structure' as category, 'Completely Empty Column' as issue, 100.0::double as measure,
 50 as penalty, 1 as ord, true as strong, '100% empty column' as note from p where {EMPTY}
 union all select col, case when missing_pct >= 50 then 'CRITICAL' when missing_pct >= 20 then 'HIGH' when missing_pct >= 5 then 'MEDIUM' else 'LOW' end,
 'Missing Values', {SHOWN_PCT} || '% Missing Values', missing_pct,
 case when missing_pct >= 50 then 30 when missing_pct >= 20 then 20 when missing_pct >= 5 then 10 else 4 end, 2, missing_pct >= 20,
 {SHOWN_PCT} || '% missing values' from p where missing_pct > 0
 union all select col, 'MEDIUM', 'Consistency', 'Constant Single Value', 1.0, 15, 3, false, 'Constant value (''' || top_value || ''')' from p where {CONSTANT}
 union all select col, 'HIGH', 'Consistency', 'Mixed Numeric & Text Values', {MIXED_PCT}, 20, 4, true, 'Mixed data types' from p where {MIXED}
 union all select col, severity, 'Validity', issue, pct, 12, 9, false, null from ({VALIDITY})
 union all select col, case when {OUT_PCT} < 15 then 'MEDIUM' else 'HIGH' end, 'Outliers', outliers::varchar || ' Extreme Outliers', {OUT_PCT}, 10, 9, false, null
 from p where {CHECKED} and iqr > 0 and {OUT_PCT} >= 5"""
ALL_ISSUES = f"""select col, severity, category, issue, measure from ({ISSUES})
 union all select 'Dataset (All Rows)', case when duplicate_pct >= 20 then 'HIGH' when duplicate_pct >= 5 then 'MEDIUM' else 'LOW' end, 'Duplicates',
 format('{{:,}}', duplicate_rows) || ' Duplicate Records', duplicate_pct from dup where duplicate_rows > 0
 union all select a || ' ↔ ' || b, 'HIGH', 'Duplicates', 'Duplicate Column Content', 100.0 from cp"""

for _source, _columns in AUDITED[:3]:
    _with = f"with {profile_sql(_source, _columns)}, {duplicates_sql(_source)}, {copies_sql(_columns, _source)}"
    query(f"dq_issues_{_source}", f"""{_with} select row_number() over (order by {SEVERITY_ORDER}, measure desc, category, col, issue) as rank,
 severity, category, col as "column", issue, {r('measure')} as measure from ({ALL_ISSUES})""")(
        lambda t, s=_source: Q.Audit(t(s), share=False).issues()
    )
    query(f"dq_column_scores_{_source}", f"""{_with}, iss as ({ISSUES}),
 pen as (select col, sum(penalty) as penalty, arg_max(note, ord) filter (where strong and note is not null) as strong_note,
 arg_min(note, ord) filter (where note is not null) as weak_note from iss group by col),
 scored as (select position, p.col as c, greatest(0.0, least(100.0, 100.0 - coalesce(penalty, 0) - 25.0 * (select count(*) from cp where b = p.col))) as s,
 coalesce(strong_note, weak_note, 'Clean') as main_issue from p left join pen on p.col = pen.col)
 select position, c as "column", {r('s', 1)} as quality_score, main_issue,
 case when s >= 90 then 'Healthy' when s >= 75 then 'Low' when s >= 60 then 'Moderate' when s >= 40 then 'High' else 'Critical' end as tier from scored""")(
        lambda t, s=_source: Q.Audit(t(s), share=False).column_scores()
    )

for _source, _columns in AUDITED[:2]:
    query(f"dq_audit_{_source}", f"""with {score_sql(_columns, _source)}, al as ({ALL_ISSUES})
 select (select max(rows) from p) as rows, {len(_columns)}::bigint as columns, {i('(select sum(missing) from p)')} as missing_cells,
 (select duplicate_rows from dup) as duplicate_rows, (select count(*) from cp) as duplicate_column_pairs, {r('score', 1)} as score,
 {GRADE} as grade, {STATUS} as status, (select count(*) from al) as issues,
 {', '.join(f"(select count(*) from al where severity = '{s}') as {s.lower()}" for s in ('CRITICAL', 'HIGH', 'MEDIUM', 'LOW'))} from sc""")(
        lambda t, s=_source: Q.Audit(t(s)).report()
    )

# --- decisions ---------------------------------------------------------------------------------------------------
IS_NUMERIC = "(kind = 'numeric' and not is_id)"
IS_CATEGORICAL = f"(kind in ('text', 'boolean') or (not {IS_NUMERIC} and kind <> 'datetime' and not is_id))"
IS_SKEWED = f"coalesce({IS_NUMERIC} and abs(case when non_null >= 3 then skewness else 0 end) > 1.0, false)"
IS_TARGET = "(" + " or ".join(f"contains(lower(col), '{w}')" for w in W.TARGET_PARTS) + ")"
IS_FINANCIAL = "(" + " or ".join(f"contains(lower(col), '{w}')" for w in W.FINANCIAL_PARTS) + ")"
DOMINANT = f"({IS_CATEGORICAL} and top_count::double / nullif(non_null, 0) >= 0.40)"
SPECIAL = f"(is_id or {IS_TARGET})"


def share(count: str) -> str:
    return f"coalesce({count}::double / nullif(non_null, 0), 0.0)"


for _source, _columns in AUDITED[:2]:
    query(f"dq_investigate_{_source}", f"""with {profile_sql(_source, _columns)} select position, col as "column", is_id,
 {IS_NUMERIC} as is_numeric, kind = 'datetime' as is_datetime, {IS_CATEGORICAL} as is_categorical, {IS_TARGET} as is_target, {r('mean')} as mean, {r('std')} as std,
 {r('median_')} as median, {r('q1')} as q1, {r('q3')} as q3, {r('skewness', 3)} as skewness, {IS_SKEWED} as is_skewed, outliers,
 {r(OUT_PCT)} as outlier_pct, top_value, top_count, {r(share('top_count'))} as top_ratio, coalesce({DOMINANT}, false) as is_dominant,
 {share('currency_like')} > 0.4 as has_currency, {share('percent_like')} > 0.4 as has_percent,
 {share('symbol_number_like')} > 0.7 as is_numeric_text from p""")(
        lambda t, s=_source: D.investigate(t(s)).select(
            "position", "column", "is_id", "is_numeric", "is_datetime", "is_categorical", "is_target", "mean", "std", "median",
            "q1", "q3", F.round("skewness", 3).alias("skewness"), "is_skewed", "outliers", "outlier_pct", "top_value",
            "top_count", "top_ratio", "is_dominant", "has_currency", "has_percent", "is_numeric_text",
        )
    )

MISSING_DECISION = f"""select col, 'missing' as type, case when missing_pct >= 60 or (missing_pct >= 30 and {SPECIAL}) then 'CRITICAL'
 when missing_pct >= 20 or (missing_pct >= 5 and {SPECIAL}) then 'HIGH' when missing_pct >= 5 then 'MEDIUM' else 'LOW' end as severity,
 missing_pct + case when missing_pct >= 60 or (missing_pct >= 30 and {SPECIAL}) then 100.0
 when missing_pct >= 20 or (missing_pct >= 5 and {SPECIAL}) then 70.0 when missing_pct >= 5 then 40.0 else 10.0 end as weight,
 missing as affected, case when missing_pct >= 70 then 'drop_cols'
 when {IS_NUMERIC} then case when {IS_SKEWED} or outliers > 0 then 'median' else 'mean' end
 when {IS_CATEGORICAL} then case when {DOMINANT} and missing_pct <= 15 then 'mode' else 'unknown' end
 when kind = 'datetime' then 'ffill' when missing_pct > 1 then 'unknown' else 'drop_rows' end as action,
 null::double as low, null::double as high from p where missing > 0"""
CONFIDENCE = "case when type <> 'missing' or action in ('drop_cols', 'median', 'mean', 'mode') then 'HIGH' else 'MEDIUM' end"
AGE = "(contains(lower(col), 'age') and (max_ > 120 or min_ < 0))"
PLAN = f"""{MISSING_DECISION}
 union all select col, 'outliers', case when {AGE} then 'HIGH' when {IS_FINANCIAL} then 'LOW' when {OUT_PCT} > 8 then 'MEDIUM' else 'LOW' end,
 case when {AGE} then 75.0 when {IS_FINANCIAL} then 25.0 else 35.0 + {OUT_PCT} end, outliers,
 case when not {AGE} and {IS_FINANCIAL} then 'retain_outliers' else 'cap_bounds' end,
 case when {AGE} then 0.0 else lower_ end, case when {AGE} then 100.0 else upper_ end
 from p where {CHECKED} and iqr > 0 and outliers > 0 and {IS_NUMERIC}
 union all select col, 'consistency', 'HIGH', 65.0 + {MIXED_PCT}, non_null - number_like, 'cast_numeric_clean', null, null from p where {MIXED}
 union all select col, 'empty', 'CRITICAL', 120.0, rows, 'drop_cols', null, null from p where {EMPTY}
 union all select col, 'validity', severity, 50.0 + pct, count, case when contains(issue, 'Negative') then 'clip_non_negative'
 when contains(issue, 'Whitespace') then 'trim_whitespace' else 'clean_invalid' end, null, null from ({VALIDITY})
 union all select 'Dataset (All Rows)', 'duplicates', case when duplicate_pct >= 15 then 'HIGH' when duplicate_pct >= 5 then 'MEDIUM' else 'LOW' end,
 case when duplicate_pct >= 15 then 90.0 when duplicate_pct >= 5 then 60.0 else 30.0 end + duplicate_pct, duplicate_rows, 'remove_exact', null, null
 from dup where duplicate_rows > 0"""

for _source, _columns in AUDITED[:2]:
    query(f"dq_decide_missing_{_source}", f"""with {profile_sql(_source, _columns)} select col as "column", type, severity, {r('weight')} as weight,
 affected, action, {CONFIDENCE} as confidence, low, high from ({MISSING_DECISION})""")(
        lambda t, s=_source: D.missing_decisions(t(s))
    )
    query(f"dq_decide_plan_{_source}", f"""with {profile_sql(_source, _columns)}, {duplicates_sql(_source)}
 select row_number() over (order by {SEVERITY_ORDER}, weight desc, type, col, action) as rank, col as "column", type, severity, {r('weight', 6)} as weight,
 affected, action, {CONFIDENCE} as confidence, {r('low', 6)} as low, {r('high', 6)} as high from ({PLAN})""", digits=6)(
        lambda t, s=_source: D.decision_plan(t(s))
    )


@query("dq_decide_duplicates", f"""with {duplicates_sql('events_dirty')} select 'Dataset (All Rows)' as "column", 'duplicates' as type,
 case when duplicate_pct >= 15 then 'HIGH' when duplicate_pct >= 5 then 'MEDIUM' else 'LOW' end as severity,
 {r('case when duplicate_pct >= 15 then 90.0 when duplicate_pct >= 5 then 60.0 else 30.0 end + duplicate_pct')} as weight,
 duplicate_rows as affected, 'remove_exact' as action, 'HIGH' as confidence, null::double as low, null::double as high,
 'event_id, user_id' as id_columns from dup""")
def _(t: Tables) -> DataFrame:
    return D.duplicate_decision(Q.Audit(t("events_dirty"), share=False))


# --- preview, apply, verify -----------------------------------------------------------------------------------------
GAPS = source_sql("events_gaps")
FILLED = f"(select event_id, ts, user_id, event_type, coalesce(value, (select quantile_cont(value, 0.5) from {GAPS})) as value from {GAPS})"


def _preview_side(label: str, source: str) -> str:
    missing = "count(*) * 5 - count(event_id) - count(ts) - count(user_id) - count(event_type) - count(value)"
    return f"""select '{label}' as side, count(*) as rows, 5::bigint as columns, {missing} as missing, {r('avg(value)')} as mean,
 {r(q('value', 0.5))} as median, {r('stddev_samp(value)')} as std, {r(f"100.0 - {pct(missing, 'count(*) * 5')}", 1)} as completeness from {source}"""


@query("dq_preview", f"{_preview_side('before', GAPS)} union all {_preview_side('after', FILLED)}")
def _(t: Tables) -> DataFrame:
    return D.preview(t("events_gaps"), Repair("median", "value"))


EVENT_ROW = f"event_id, {ts('ts')} as ts, user_id, event_type"


def _fill_sql(expr: str, source: str = GAPS) -> str:
    return f"select {EVENT_ROW}, {r(expr)} as value from {source}"


def _window(function: str, order: str) -> str:
    return f"{function}(value ignore nulls) over (order by event_id rows between {order})"


LAST = _window("last_value", "unbounded preceding and current row")
FIRST = _window("first_value", "current row and unbounded following")
APPLIED: dict[str, tuple[str, Repair, str]] = {
    "median": ("events_gaps", Repair("median", "value"), _fill_sql(f"coalesce(value, (select quantile_cont(value, 0.5) from {GAPS}))")),
    "mean": ("events_gaps", Repair("mean", "value"), _fill_sql(f"coalesce(value, (select avg(value) from {GAPS}))")),
    "zero": ("events_gaps", Repair("zero", "value"), _fill_sql("coalesce(value, 0)")),
    "mode": (
        "events_gaps",
        Repair("mode", "event_type"),
        f"select event_id, {ts('ts')} as ts, user_id, coalesce(event_type, (select event_type from {GAPS} where event_type is not null "
        f"group by 1 order by count(*) desc, 1 limit 1)) as event_type, {r('value')} as value from {GAPS}",
    ),
    "unknown": (
        "events_gaps",
        Repair("unknown", "event_type"),
        f"select event_id, {ts('ts')} as ts, user_id, coalesce(event_type, 'Unknown') as event_type, {r('value')} as value from {GAPS}",
    ),
    "ffill": ("events_gaps", Repair("ffill", "value", order_by="event_id"), _fill_sql(f"coalesce({LAST}, {FIRST})")),
    "bfill": ("events_gaps", Repair("bfill", "value", order_by="event_id"), _fill_sql(f"coalesce({FIRST}, {LAST})")),
    "drop_rows": ("events_gaps", Repair("drop_rows", "value"), _fill_sql("value", f"{GAPS} where value is not null")),
    "drop_cols": ("events_gaps", Repair("drop_cols", "value"), f"select {EVENT_ROW} from {GAPS}"),
    "remove_exact": (
        "events_repeated",
        Repair("remove_exact"),
        f"select distinct {EVENT_ROW}, {r('value')} as value from {source_sql('events_repeated')}",
    ),
    "keep_all": ("events_repeated", Repair("keep_all"), f"select {EVENT_ROW}, {r('value')} as value from {source_sql('events_repeated')}"),
    "cap_bounds": (
        "events_gaps",
        Repair("cap_bounds", "value"),
        f"select {EVENT_ROW}, {r('case when value is not null then least(greatest(value, lo), hi) end')} as value from {GAPS}, "
        f"(select z[1] - 1.5 * (z[2] - z[1]) as lo, z[2] + 1.5 * (z[2] - z[1]) as hi from (select quantile_cont(value, [0.25, 0.75]) as z from {GAPS}))",
    ),
    "drop_outliers": (
        "events_gaps",
        Repair("drop_outliers", "value"),
        f"select {EVENT_ROW}, {r('value')} as value from {GAPS}, "
        f"(select z[1] - 1.5 * (z[2] - z[1]) as lo, z[2] + 1.5 * (z[2] - z[1]) as hi from (select quantile_cont(value, [0.25, 0.75]) as z from {GAPS})) "
        "where value is null or value between lo and hi",
    ),
}
for _name, (_source, _repair, _sql) in APPLIED.items():
    query(f"dq_apply_{_name}", _sql)(lambda t, s=_source, x=_repair: D.apply_repair(t(s), x))

DIRTY = source_sql("customer_dirty")
DIRTY_ROW = {
    c: (r(c) if k == "numeric" and c in ("stock", "discount_pct", "balance", "e") else i(c) if k == "numeric" else c)
    for c, k in DIRTY_CUSTOMER
}


def _dirty(where: str = "", **replaced: str) -> str:
    fields = ", ".join(f"{replaced.get(c, e)} as {c}" for c, e in DIRTY_ROW.items())
    return f"select {fields} from {DIRTY} {where}"


DIRTY_REPAIRS = {
    "clip_non_negative": (Repair("clip_non_negative", "stock"), _dirty(stock=r("case when stock is not null then greatest(stock, 0.0) end"))),
    "trim_whitespace": (Repair("trim_whitespace", "segment"), _dirty(segment="case when trim(segment) <> '' then trim(segment) end")),
    "cast_numeric_clean": (Repair("cast_numeric_clean", "score_text"), _dirty(score_text=r("try_cast(score_text as double)"))),
    "clean_invalid": (Repair("clean_invalid", "discount_pct"), _dirty(discount_pct=r("least(greatest(discount_pct, 0.0), 100.0)"))),
    "drop_invalid_rows": (Repair("drop_invalid_rows", "stock"), _dirty("where stock >= 0 or stock is null")),
}
for _name, (_repair, _sql) in DIRTY_REPAIRS.items():
    query(f"dq_apply_{_name}", _sql)(lambda t, x=_repair: D.apply_repair(t("customer_dirty"), x))


def _verify_sql(columns, before: str, after: str, column: str, rows_expected: bool) -> str:
    warn = "false" if rows_expected else f"(select count(*) from {after}) < (select count(*) from {before})"
    scores = []
    for source in (before, after):
        scores.append(f"(with {_score_of(columns, source)} select score from sc)")
    spread = f"coalesce((select stddev_samp({column}) from {after}) / nullif((select stddev_samp({column}) from {before}), 0) < 0.60, false)"
    return f"""select {r('a', 1)} as score_before, {r('b', 1)} as score_after, {r('b - a', 1)} as score_delta, round(b - a, 1) > 0 as improved,
 {spread} as spread_warning, {warn} as rows_warning from (select {scores[0]} as a, {scores[1]} as b)"""


def _score_of(columns, source: str) -> str:
    """Score CTEs over any subquery text."""
    named_source = source_sql("events_gaps")
    return score_sql(columns, "events_gaps").replace(named_source, source)


@query("dq_verify", _verify_sql([(c, k) for c, k in EVENTS if c != "props"], GAPS, FILLED, "value", False), digits=1)
def _(t: Tables) -> DataFrame:
    return D.verify(t("events_gaps"), Repair("median", "value"))
