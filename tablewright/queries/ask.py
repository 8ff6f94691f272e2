"""Questions: which kind, which column, and the answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import questions as K
from . import words as W
from .audit import DOCUMENTS, STATUS, score_sql
from .explore import STRENGTH, pairs_sql
from .registry import Tables, query, source_sql
from .sqltext import duplicates_sql, i, pct, profile_sql, q, r, ts
from .tables import EVENTS, LINEITEM, ORDERS

# Columns the questions are matched against. Words of the given texts occur among them.
NUMERIC = ["customer_age", "sale", "data", "value total"]
OTHER = ["the region", "role", "plan_tier"]
COLUMNS = NUMERIC + OTHER


def _any(text: str, phrases: list[str]) -> str:
    return "(" + " or ".join(f"contains({text}, '{p}')" for p in phrases) + ")"


def _parts(name: str) -> str:
    return "".join(ch if ch.isalnum() or ch in "_ " else " " for ch in name.lower()).strip()


CLEAN = "regexp_replace(lower(text), '[^\\p{L}\\p{N}_\\s]', ' ', 'g')"
WORDS = f"list_distinct(list_filter(regexp_split_to_array({CLEAN}, '\\s+'), lambda w: w <> ''))"


def match_sql(columns: list[str], source: str = "conversations") -> str:
    """One row per (conversation turn, column) that fits at all: lvl, weakness, position, col."""
    parts = []
    for n, c in enumerate(columns):
        words = list(dict.fromkeys(_parts(c).split()))
        listed = "[" + ", ".join(f"'{w}'" for w in words) + "]"
        overlap = f"len(list_intersect({listed}, {WORDS}))"
        parts.append(
            f"select conv_id, turn, {n} as position, '{c}' as col, {overlap} as overlap, case when contains(lower(text), '{c.lower()}') or contains({CLEAN}, '{_parts(c)}') then 1 "
            f"when {overlap} = {len(words)} then 2 when {overlap} > 0 then 3 end as lvl from {source}"
        )
    return f"(select *, case when lvl = 3 then -overlap else 0 end as weakness from ({' union all '.join(parts)}) where lvl is not null)"


def best_sql(columns: list[str]) -> str:
    return f"(select conv_id, turn, first(col order by lvl, weakness, position) as col, min(lvl) as lvl from {match_sql(columns)} group by 1, 2)"


MENTIONED = ", ".join(
    f"case when contains(lower(text), '{c.lower()}') or contains(lower(text), '{c.lower().replace('_', ' ')}') then '{c}' end" for c in COLUMNS
)


@query("ask_match_columns", f"""select c.conv_id, c.turn, col as best_column, lvl::bigint as match_level, concat_ws(', ', {MENTIONED}) as mentioned
 from conversations c left join {best_sql(COLUMNS)} b on c.conv_id = b.conv_id and c.turn = b.turn""")
def _(t: Tables) -> DataFrame:
    return K.match_columns(t("conversations"), "text", COLUMNS).drop("role", "text")


QUESTION = "lower(trim(text))"
GREETING = (
    f"({QUESTION} in ({', '.join(repr(g) for g in W.GREETINGS)}) or "
    + " or ".join(f"starts_with({QUESTION}, '{g} ')" for g in W.GREETINGS)
    + ")"
)


def intent_sql(numeric: list[str], other: list[str]) -> str:
    says = {k: _any(QUESTION, v) for k, v in W.PHRASES.items()}
    return f"""select c.conv_id, c.turn, case when {GREETING} or {says['help']} then 'greeting' when {says['schema']} then 'schema' when {says['shape']} then 'shape'
 when {says['quality']} then 'quality' when {says['missing']} then 'missing' when {says['duplicates']} then 'duplicates' when {says['grouped']} then 'grouped'
 when {says['extreme']} and n.col is not null then 'extreme' when {says['column_stats']} and n.col is not null then 'column_stats'
 when o.col is not null then 'category_profile' when {says['correlation']} then 'correlation' when {says['outliers']} then 'outliers'
 when {says['preview']} then 'preview' else 'default' end as intent
 from conversations c left join {best_sql(numeric)} n on c.conv_id = n.conv_id and c.turn = n.turn
 left join {best_sql(other)} o on c.conv_id = o.conv_id and c.turn = o.turn"""


@query("ask_intent", intent_sql(NUMERIC, OTHER))
def _(t: Tables) -> DataFrame:
    return K.intents(t("conversations"), "text", NUMERIC, OTHER).select("conv_id", "turn", "intent")


@query("ask_intent_counts", f"select intent, count(*) as questions from ({intent_sql(['o_totalprice'], ['o_orderstatus'])}) group by 1")
def _(t: Tables) -> DataFrame:
    asked = K.intents(t("conversations"), "text", ["o_totalprice"], ["o_orderstatus"])
    return asked.groupBy("intent").agg(F.count(F.lit(1)).alias("questions"))


GAPS = source_sql("lineitem_gaps")


@query("ask_grouped", f"""select l_returnflag, {r('avg(l_quantity)', 2)} as mean, {r('sum(l_quantity)', 2)} as sum, count(l_quantity) as count from {GAPS}
 where l_returnflag is not null group by 1 order by avg(l_quantity) desc limit 10""", digits=2)
def _(t: Tables) -> DataFrame:
    return K.grouped_answer(t("lineitem_gaps"), "l_quantity", "l_returnflag")


for _low in (True, False):
    _name, _order = ("lowest", "asc") if _low else ("highest", "desc")
    query(f"ask_extreme_{_name}", f"""select o_orderkey, o_custkey, o_orderstatus, {r('o_totalprice', 2)} as o_totalprice, {ts('o_orderdate')} as o_orderdate, o_orderpriority,
 {r('(select avg(o_totalprice) from orders)', 2)} as column_mean, {r('(select quantile_cont(o_totalprice, 0.5) from orders)', 2)} as column_median,
 (select count(o_totalprice) from orders) as column_count from orders order by orders.o_totalprice {_order}, o_orderkey limit 1""", digits=2)(
        lambda t, low=_low: K.extreme_answer(t("orders"), "o_totalprice", ["o_orderkey"], low)
    )


@query("ask_column_stats", f"""select 'l_quantity' as "column", {r('avg(l_quantity)')} as mean, {r(q('l_quantity', 0.5))} as median, {r('stddev_samp(l_quantity)')} as std,
 {r('min(l_quantity)')} as min, {r('max(l_quantity)')} as max, {r(q('l_quantity', 0.25))} as q1, {r(q('l_quantity', 0.75))} as q3, count(l_quantity) as count from {GAPS}""")
def _(t: Tables) -> DataFrame:
    return K.column_answer(t("lineitem_gaps"), "l_quantity")


@query("ask_category", f"""select p_type as value, count(*) as count, {r('count(*) * 100.0 / (select count(*) from part)')} as pct_of_rows,
 (select count(distinct p_type) from part) as "distinct" from part group by 1 order by 2 desc, 1 limit 5""")
def _(t: Tables) -> DataFrame:
    return K.category_answer(t("part"), "p_type")


@query("ask_missing", f"""with {profile_sql('orders_gaps', ORDERS)} select col as "column", missing, {r('missing_pct')} as missing_pct from p where missing > 0
 order by p.missing desc, position limit 6""")
def _(t: Tables) -> DataFrame:
    return K.missing_answer(t("orders_gaps"))


@query("ask_duplicates", f"with {duplicates_sql('events_repeated')} select rows, duplicate_rows, {r('duplicate_pct')} as duplicate_pct from dup")
def _(t: Tables) -> DataFrame:
    return K.duplicates_answer(t("events_repeated"))


SIX = "(count(*) * 6 - " + " - ".join(f"count({c})" for c, _ in ORDERS) + ")"


@query("ask_shape", f"""select count(*) as rows, 6::bigint as columns, count(*) * 6 as cells, 3::bigint as numeric_columns, 3::bigint as other_columns,
 {r(f'100.0 - {SIX} * 100.0 / (count(*) * 6)')} as completeness from {source_sql('orders_gaps')}""")
def _(t: Tables) -> DataFrame:
    return K.shape_answer(t("orders_gaps"))


DTYPES = {"o_orderkey": "bigint", "o_custkey": "bigint", "o_orderstatus": "string", "o_totalprice": "double", "o_orderdate": "timestamp_ntz", "o_orderpriority": "string"}


@query("ask_schema", " union all ".join(f"select {n}::bigint as position, '{c}' as \"column\", '{k}' as dtype, count({c}) as non_null from {source_sql('orders_gaps')}" for n, (c, k) in enumerate(DTYPES.items())))
def _(t: Tables) -> DataFrame:
    return K.schema_answer(t("orders_gaps"))


FIVE = EVENTS[:5]
FIVE_MISSING = "(count(*) * 5 - " + " - ".join(f"count({c})" for c, _ in FIVE) + ")"


@query("ask_quality", f"""with {score_sql(FIVE, 'events_gaps')} select {r('score', 1)} as score, {STATUS} as status, {i('m')} as missing_cells, {r('m * 100.0 / (n * 5)')} as missing_pct,
 duplicate_rows, {r('duplicate_pct')} as duplicate_pct from sc, dup, (select {FIVE_MISSING} as m, count(*) as n from {source_sql('events_gaps')})""")
def _(t: Tables) -> DataFrame:
    return K.quality_answer(t("events_gaps"))


NUMBERS = [c for c, k in LINEITEM if k == "numeric"]


@query("ask_correlation", f"""with c as ({pairs_sql('lineitem', NUMBERS, None)})
 (select 'positive' as direction, var1, var2, {r('r')} as r, {STRENGTH} as strength from c where r > 0 order by round(c.r, 9) desc, var1, var2 limit 2)
 union all (select 'negative', var1, var2, {r('r')}, {STRENGTH} from c where r < 0 order by round(c.r, 9), var1, var2 limit 2)""")
def _(t: Tables) -> DataFrame:
    return K.correlation_answer(t("lineitem"))


@query("ask_outliers", f"""with {profile_sql('documents', DOCUMENTS)} select col as "column", outliers as outlier_count, {r(pct('outliers', 'non_null'), 6)} as outlier_pct,
 {r('lower_', 6)} as lower, {r('upper_', 6)} as upper from p where kind = 'numeric' and outliers > 0""", digits=6)
def _(t: Tables) -> DataFrame:
    return K.outlier_answer(t("documents"))


@query("ask_preview", f"select c_custkey, c_name, c_nationkey::bigint as c_nationkey, {r('c_acctbal')} as c_acctbal, c_mktsegment from customer order by c_custkey limit 5")
def _(t: Tables) -> DataFrame:
    return K.preview(t("customer"), ["c_custkey"])
