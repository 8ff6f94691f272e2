"""The tables behind the charts, and what they say."""

from __future__ import annotations


from pyspark.sql import DataFrame, functions as F

from ..operators import charts as C, insights as N
from .explore import pairs_sql
from .registry import Tables, query, source_sql
from .sqltext import pearson, q, r, skew0, ts
from .tables import LINEITEM

GAPS = source_sql("lineitem_gaps")
SQL_AGG = {
    "Sum": "sum({0})", "Mean": "avg({0})", "Median": "quantile_cont({0}, 0.5)", "Count": "count(*)", "Minimum": "min({0})",
    "Maximum": "max({0})", "Standard Deviation": "stddev_samp({0})",
}
KEPT = f"(select * from {GAPS} where l_returnflag is not null and l_quantity is not null)"
KEYED = f"(select * from {GAPS} where l_returnflag is not null)"


def agg_sql(source: str, by: str, metric: str | None, agg: str = "Sum", colour: str | None = None, digits: int = 2) -> str:
    """Unsorted aggregate; ``m`` is unrounded for ranking, ``metric`` is what is shown."""
    keys = ", ".join(k for k in (by, colour) if k)
    expr = "count(*)" if metric is None or agg == "Count" else SQL_AGG[agg].format(metric)
    shown = expr if metric is None or agg == "Count" else r(expr, digits)
    return f"select {keys}, {shown} as metric, {expr} as m from {source} group by {keys}"


# --- core aggregate --------------------------------------------------------------------------------------------------
for _agg, _name in (
    ("Sum", "sum"), ("Mean", "mean"), ("Median", "median"), ("Count", "count"), ("Minimum", "min"), ("Maximum", "max"),
    ("Standard Deviation", "std"),
):
    _from = KEYED if _agg == "Count" else KEPT
    query(f"agg_{_name}", f"select l_returnflag, metric from ({agg_sql(_from, 'l_returnflag', 'l_quantity', _agg)})", digits=2)(
        lambda t, a=_agg: C.aggregate(t("lineitem_gaps"), "l_returnflag", "l_quantity", a)
    )


@query("agg_two_keys", f"select l_returnflag, l_linestatus, metric from ({agg_sql(KEPT, 'l_returnflag', 'l_quantity', 'Mean', 'l_linestatus')})", digits=2)
def _(t: Tables) -> DataFrame:
    return C.aggregate(t("lineitem_gaps"), "l_returnflag", "l_quantity", "Mean", "l_linestatus")


@query("agg_median_suppliers", f"select l_suppkey, metric from ({agg_sql('lineitem', 'l_suppkey', 'l_extendedprice', 'Median', digits=4)})")
def _(t: Tables) -> DataFrame:
    return C.aggregate(t("lineitem"), "l_suppkey", "l_extendedprice", "Median", top_n=None)


@query("agg_global", f"select {r('sum(l_quantity)', 2)} as metric from {GAPS}", digits=2)
def _(t: Tables) -> DataFrame:
    return C.aggregate(t("lineitem_gaps"), None, "l_quantity", "Sum")


@query("agg_text_numbers", f"select flag, {r('avg(try_cast(mixed as double))', 2)} as metric from {source_sql('order_texts')} group by 1", digits=2)
def _(t: Tables) -> DataFrame:
    return C.aggregate(t("order_texts"), "flag", "mixed", "Mean")


for _sort, _order in (("value_desc", "m desc, p_brand"), ("value_asc", "m, p_brand"), ("alpha_asc", "p_brand"), ("alpha_desc", "p_brand desc")):
    query(f"agg_sorted_{_sort}", f"select p_brand, metric from ({agg_sql('part', 'p_brand', 'p_retailprice')}) order by {_order} limit 10", digits=2)(
        lambda t, s=_sort: C.aggregate(t("part"), "p_brand", "p_retailprice", "Sum", sort=s, top_n=10)
    )


@query("agg_top_n", f"select p_name, metric from ({agg_sql('part', 'p_name', 'p_size', 'Mean')}) order by m desc, p_name limit 5", digits=2)
def _(t: Tables) -> DataFrame:
    return C.aggregate(t("part"), "p_name", "p_size", "Mean", sort="value_desc", top_n=5)


def coloured(source: str, by: str, metric: str, agg: str, colour: str, n: int, worst: bool = False) -> str:
    pick, order = ("min", "asc") if worst else ("max", "desc")
    return f"""with a as ({agg_sql(source, by, metric, agg, colour)}) select {by}, {colour}, metric from a where {by} in
 (select {by} from a group by {by} order by {pick}(m) {order}, {by} limit {n})"""


@query("agg_top_n_colour", coloured("part", "p_brand", "p_retailprice", "Sum", "p_type", 4), digits=2)
def _(t: Tables) -> DataFrame:
    return C.aggregate(t("part"), "p_brand", "p_retailprice", "Sum", "p_type", "value_desc", 4)


# --- comparison --------------------------------------------------------------------------------------------------------
PART_SUM = agg_sql("part", "p_brand", "p_retailprice")


@query("chart_bar", f"select p_brand, metric from ({PART_SUM}) order by m desc, p_brand limit 15", digits=2)
def _(t: Tables) -> DataFrame:
    return C.bar(t("part"), "p_brand", "p_retailprice")


@query("chart_hbar", f"select p_brand, metric from ({PART_SUM}) order by m, p_brand limit 15", digits=2)
def _(t: Tables) -> DataFrame:
    return C.horizontal_bar(t("part"), "p_brand", "p_retailprice")


@query("chart_lollipop", "select p_brand, count(*) as metric from part group by 1 order by 2 desc, 1 limit 15")
def _(t: Tables) -> DataFrame:
    return C.lollipop(t("part"), "p_brand")


@query("chart_grouped_bar", coloured("part", "p_brand", "p_size", "Mean", "p_type", 12), digits=2)
def _(t: Tables) -> DataFrame:
    return C.grouped_bar(t("part"), "p_brand", "p_type", "p_size", "Mean")


WATERFALL = f"""with a as (select p_brand, sum(p_retailprice) as m from part group by 1 order by 1 limit 10),
 w as (select 'step' as kind, row_number() over (order by p_brand) as step, p_brand as label, m, sum(m) over (order by p_brand) as run from a)"""


@query("chart_waterfall", f"""{WATERFALL} select kind, step, label, {r('m', 2)} as metric, {r('run - m', 2)} as base, {r('run', 2)} as running from w
 union all select 'total', 11, 'Net Total', 0.0, 0.0, {r('sum(m)', 2)} from w""", digits=2)
def _(t: Tables) -> DataFrame:
    return C.waterfall(t("part"), "p_brand", "p_retailprice")


RADAR = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("chart_radar", f"select {', '.join(f'{r(f'avg({c})')} as {c}' for c in RADAR)} from lineitem")
def _(t: Tables) -> DataFrame:
    return C.radar(t("lineitem"), RADAR)


TOP_BRANDS = "(select p_brand from part group by 1 order by count(*) desc, 1 limit 4)"
PART_RADAR = ["p_partkey", "p_size", "p_retailprice"]


@query("chart_radar_categories", f"select p_brand, {', '.join(f'{r(f'avg({c})')} as {c}' for c in PART_RADAR)} from part where p_brand in {TOP_BRANDS} group by 1")
def _(t: Tables) -> DataFrame:
    return C.radar(t("part"), None, "p_brand")


@query("chart_radar_median", f"select p_brand, {', '.join(f'{r(q(c, 0.5))} as {c}' for c in PART_RADAR)} from part where p_brand in {TOP_BRANDS} group by 1")
def _(t: Tables) -> DataFrame:
    return C.radar(t("part"), PART_RADAR, "p_brand", "Median")


# --- trends --------------------------------------------------------------------------------------------------------------
for _name, _make, _agg in (("line", C.line, "Sum"), ("area", C.area, "Mean"), ("step", C.step, "Maximum")):
    query(f"chart_{_name}", f"select l_linenumber::bigint as l_linenumber, metric from ({agg_sql('lineitem', 'l_linenumber', 'l_extendedprice', _agg)})", digits=2)(
        lambda t, f=_make, a=_agg: f(t("lineitem"), "l_linenumber", "l_extendedprice", a)
    )


@query("chart_line_colour", f"select {ts('o_orderdate')} as o_orderdate, o_orderstatus, metric from ({agg_sql('orders', 'o_orderdate', 'o_totalprice', 'Sum', 'o_orderstatus')})", digits=2)
def _(t: Tables) -> DataFrame:
    return C.line(t("orders"), "o_orderdate", "o_totalprice", "Sum", "o_orderstatus")


@query("chart_multi_line", f"select l_returnflag, {', '.join(f'{r(f'sum({c})', 2)} as {c}' for c in ('l_quantity', 'l_discount', 'l_extendedprice'))} from {KEYED} group by 1", digits=2)
def _(t: Tables) -> DataFrame:
    return C.multi_line(t("lineitem_gaps"), "l_returnflag", ["l_quantity", "l_discount", "l_extendedprice"])


# --- relationships -----------------------------------------------------------------------------------------------------
@query("chart_scatter", f"select {r('l_quantity')} as l_quantity, {r('l_extendedprice')} as l_extendedprice, l_returnflag from {KEPT}")
def _(t: Tables) -> DataFrame:
    return C.points(t("lineitem_gaps"), ["l_quantity", "l_extendedprice"], "l_returnflag")


@query("chart_bubble", f"select {r('l_quantity')} as l_quantity, {r('l_extendedprice')} as l_extendedprice, {r('greatest(l_discount, 0.1)')} as l_discount from {GAPS} where l_quantity is not null")
def _(t: Tables) -> DataFrame:
    return C.points(t("lineitem_gaps"), ["l_quantity", "l_extendedprice"], size="l_discount")


@query("chart_scatter3d", f"select {r('l_quantity')} as l_quantity, {r('l_extendedprice')} as l_extendedprice, {r('l_discount')} as l_discount, l_linestatus from {GAPS} where l_quantity is not null")
def _(t: Tables) -> DataFrame:
    return C.points(t("lineitem_gaps"), ["l_quantity", "l_extendedprice", "l_discount"], "l_linestatus")


@query("chart_ols", f"""select l_returnflag, {r('regr_slope(l_extendedprice, l_quantity)')} as slope, {r('regr_intercept(l_extendedprice, l_quantity)')} as intercept,
 {r('regr_r2(l_extendedprice, l_quantity)')} as r2, count(*) as n from {KEPT} group by 1""")
def _(t: Tables) -> DataFrame:
    return C.trend_line(t("lineitem_gaps"), "l_quantity", "l_extendedprice", "l_returnflag")


def bin_sql(x: str, bins: int, lo: str = "lo", hi: str = "hi") -> str:
    return f"least(floor(({x} - {lo}) / (({hi} - {lo}) / {bins})), {bins - 1})::bigint"


@query("chart_density", f"""with l as (select min(l_quantity) as xlo, max(l_quantity) as xhi, min(l_extendedprice) as ylo, max(l_extendedprice) as yhi from {KEPT})
 select l_returnflag, {bin_sql('l_quantity', 20, 'xlo', 'xhi')} as x_bin, {bin_sql('l_extendedprice', 20, 'ylo', 'yhi')} as y_bin, count(*) as n from {KEPT}, l group by 1, 2, 3""")
def _(t: Tables) -> DataFrame:
    return C.density(t("lineitem_gaps"), "l_quantity", "l_extendedprice", 20, "l_returnflag")


def histogram_sql(source: str, x: str, bins: int, extra: str = "") -> str:
    return f"""select {extra} s.bin, {r(f'lo + (hi - lo) / {bins} * s.bin')} as lo, {r(f'lo + (hi - lo) / {bins} * (s.bin + 1)')} as hi, coalesce(n, 0) as n
 from (select unnest(range({bins})) as bin) s left join (select {bin_sql(x, bins)} as bin, count(*) as n from {source},
 (select min({x})::double as lo, max({x})::double as hi from {source}) group by 1) b on s.bin = b.bin,
 (select min({x})::double as lo, max({x})::double as hi from {source})"""


BOTH = f"(select * from {GAPS} where l_quantity is not null)"


@query("chart_density_margins", f"{histogram_sql(BOTH, 'l_quantity', 20, chr(39) + 'x' + chr(39) + ' as axis,')} union all {histogram_sql(BOTH, 'l_extendedprice', 20, chr(39) + 'y' + chr(39) + ' as axis,')}")
def _(t: Tables) -> DataFrame:
    return C.marginals(t("lineitem_gaps"), "l_quantity", "l_extendedprice", 20)


# --- distributions -----------------------------------------------------------------------------------------------------
@query("chart_histogram", histogram_sql("events", "value", 30))
def _(t: Tables) -> DataFrame:
    return C.histogram(t("events"), "value", 30)


@query("chart_histogram_colour", f"""with l as (select min(value) as lo, max(value) as hi from events), b as (select event_type, {bin_sql('value', 12)} as bin, count(*) as n from events, l group by 1, 2)
 select event_type, bin, {r('lo + (hi - lo) / 12 * bin')} as lo, {r('lo + (hi - lo) / 12 * (bin + 1)')} as hi, n from b, l""")
def _(t: Tables) -> DataFrame:
    return C.histogram(t("events"), "value", 12, "event_type")


def box_sql(source: str, metric: str, keys: str = "") -> str:
    by = f"{keys}," if keys else ""
    group = f"group by {keys}" if keys else ""
    join = f"join f using ({keys})" if keys else ", f"
    return f"""with f as (select {by} quantile_cont({metric}, 0.25) as q1, quantile_cont({metric}, 0.5) as med, quantile_cont({metric}, 0.75) as q3 from {source} {group}),
 x as (select *, q1 - 1.5 * (q3 - q1) as lower_, q3 + 1.5 * (q3 - q1) as upper_ from {source} {join})"""


BOX = f"""count(*) as n, {r('min(q1)', 6)} as q1, {r('min(med)', 6)} as median, {r('min(q3)', 6)} as q3, {r('min(lower_)', 6)} as lower, {r('min(upper_)', 6)} as upper,
 {r('min(value) filter (where value between lower_ and upper_)')} as whisker_low, {r('max(value) filter (where value between lower_ and upper_)')} as whisker_high,
 count(*) filter (where value < lower_ or value > upper_) as outliers from x"""


@query("chart_box", f"{box_sql('events', 'value', 'event_type')} select event_type, {BOX} group by 1", digits=6)
def _(t: Tables) -> DataFrame:
    return C.box(t("events"), "value", "event_type")


@query("chart_box_whole", f"{box_sql('events', 'value')} select {BOX}", digits=6)
def _(t: Tables) -> DataFrame:
    return C.box(t("events"), "value")


@query("chart_box_outliers", f"{box_sql('events', 'value', 'event_type')} select event_type, {r('value')} as value from x where value < lower_ or value > upper_")
def _(t: Tables) -> DataFrame:
    return C.box_outliers(t("events"), "value", "event_type")


@query("chart_violin", f"""with l as (select min(value) as lo, max(value) as hi from events),
 b as (select event_type, {bin_sql('value', 64)} as bin, count(*) as n from events, l group by 1, 2),
 s as (select event_type, 1.06 * stddev_samp(value) * pow(count(*)::double, -0.2) as h, count(*) as total from events group by 1),
 g as (select event_type, g as point, lo + (hi - lo) * g / 49 as x, n, total, h, lo + (hi - lo) / 64 * (bin + 0.5) as centre
 from b join s using (event_type), l, (select unnest(range(50)) as g))
 select event_type, point, {r('min(x)')} as x, {r('sum(n * exp(-0.5 * pow((x - centre) / h, 2)) / (total * h * sqrt(2 * pi())))', 6)} as density from g group by 1, 2""", digits=6)
def _(t: Tables) -> DataFrame:
    return C.violin(t("events"), "value", "event_type").withColumn("x", F.round("x", 4))


@query("chart_ecdf", f"""select {r('value')} as value, n, {r('sum(n) over (order by value) / sum(n) over ()', 6)} as fraction
 from (select value, count(*) as n from events group by 1)""", digits=6)
def _(t: Tables) -> DataFrame:
    return C.ecdf(t("events"), "value")


@query("chart_ecdf_colour", f"""select l_returnflag, {r('l_quantity')} as value, n, {r('sum(n) over (partition by l_returnflag order by l_quantity) / sum(n) over (partition by l_returnflag)', 6)} as fraction
 from (select l_returnflag, l_quantity, count(*) as n from {KEPT} group by 1, 2)""", digits=6)
def _(t: Tables) -> DataFrame:
    return C.ecdf(t("lineitem_gaps"), "l_quantity", "l_returnflag")


# --- composition -------------------------------------------------------------------------------------------------------
TOP8 = f"(select * from ({PART_SUM}) order by m desc, p_brand limit 8)"
SHORT = "case when {0} >= 1000000 then format('{{:.1f}}M', {0} / 1000000) when {0} >= 1000 then format('{{:.1f}}K', {0} / 1000) else format('{{:,.0f}}', {0}) end"


@query("chart_pie", f"select p_brand, metric, {r('m * 100.0 / sum(m) over ()', 2)} as share_pct from {TOP8}", digits=2)
def _(t: Tables) -> DataFrame:
    return C.pie(t("part"), "p_brand", "p_retailprice")


@query("chart_donut", f"""select p_brand, metric, {r('m * 100.0 / sum(m) over ()', 2)} as share_pct, {r('sum(m) over ()', 2)} as total,
 {SHORT.format('(sum(m) over ())')} as total_text from {TOP8}""", digits=2)
def _(t: Tables) -> DataFrame:
    return C.donut(t("part"), "p_brand", "p_retailprice")


@query("chart_treemap", f"""with leaf as (select p_type, p_brand, sum(p_retailprice) as m from part group by 1, 2)
 select p_type, p_brand, {r('sum(m)', 2)} as metric, 2 - (grouping(p_type) + grouping(p_brand))::bigint as level from leaf group by rollup (p_type, p_brand)""", digits=2)
def _(t: Tables) -> DataFrame:
    return C.treemap(t("part"), "p_type", "p_brand", "p_retailprice")


@query("chart_treemap_count", "select p_type, count(*)::double as metric, 1 - grouping(p_type)::bigint as level from part group by rollup (p_type)")
def _(t: Tables) -> DataFrame:
    return C.treemap(t("part"), "p_type")


@query("chart_sunburst", f"""with leaf as (select l_returnflag, l_linestatus, avg(l_quantity) as m from {KEPT} group by 1, 2)
 select l_returnflag, l_linestatus, {r('sum(m)')} as metric, 2 - (grouping(l_returnflag) + grouping(l_linestatus))::bigint as level from leaf group by rollup (l_returnflag, l_linestatus)""")
def _(t: Tables) -> DataFrame:
    return C.sunburst(t("lineitem_gaps"), "l_returnflag", "l_linestatus", "l_quantity", "Mean")


@query("chart_funnel", f"select p_brand, metric, {r('m * 100.0 / max(m) over ()', 2)} as pct_of_first from {TOP8}", digits=2)
def _(t: Tables) -> DataFrame:
    return C.funnel(t("part"), "p_brand", "p_retailprice")


def matrix_sql(source: str, columns: list[str]) -> str:
    pairs = pairs_sql(source, columns, 2)
    return f"""with c as ({pairs}) select var1, var2, r from c union all select var2, var1, r from c
 union all select v, v, 1.0::double from (select unnest([{', '.join(f"'{c}'" for c in columns)}]) as v)"""


NUMBERS = [c for c, k in LINEITEM if k == "numeric"]


@query("chart_heatmap", matrix_sql("lineitem", NUMBERS), digits=2)
def _(t: Tables) -> DataFrame:
    return C.heatmap(t("lineitem"), NUMBERS)


# Of the events' numbers only the value, and what is made of it, means a number; event_id and user_id are keys.
MEASURED = "(select event_id, user_id, value, value * value as squared, event_id * 0.5 + value as drift from events)"


@query("chart_heatmap_default", matrix_sql(MEASURED, ["value", "squared", "drift"]), digits=2)
def _(t: Tables) -> DataFrame:
    return C.heatmap(t("events").selectExpr("event_id", "user_id", "value", "value * value as squared", "event_id * 0.5D + value as drift"))


@query("chart_radar_default", f"select event_type, {r('avg(value)')} as value, {r('avg(value * value)')} as squared, {r('avg(event_id * 0.5 + value)')} as drift from events where event_type in (select event_type from events group by 1 order by count(*) desc, 1 limit 4) group by 1")
def _(t: Tables) -> DataFrame:
    made = t("events").selectExpr("event_id", "user_id", "event_type", "value", "value * value as squared", "event_id * 0.5D + value as drift")
    return C.radar(made, None, "event_type")


@query("chart_ecdf_by_value", f"""select {r('value')} as value_group, {r('age')} as value, n, {r('sum(n) over (partition by value order by age) / sum(n) over (partition by value)', 6)} as fraction
 from (select round(value) as value, event_id % 7 as age, count(*) as n from events group by 1, 2)""", digits=6)
def _(t: Tables) -> DataFrame:
    return C.ecdf(t("events").selectExpr("round(value) as value", "event_id % 7 as age"), "age", "value")


@query("agg_median_by_value", f"select {r('value')} as value, {r(q('age', 0.5))} as metric from (select round(value) as value, event_id % 7 as age from events) group by 1")
def _(t: Tables) -> DataFrame:
    return C.aggregate(t("events").selectExpr("round(value) as value", "event_id % 7 as age"), "value", "age", "Median", top_n=None)


def gauge_sql(agg: str) -> str:
    return f"""select 'l_quantity' as metric, '{agg}' as aggregation, {r('v')} as value, {r('case when v > 0 then v * 1.15 else 100.0 end')} as target, {r('lo')} as min,
 {r('hi')} as max, {r('(lo + hi) / 2')} as band_low, {r('hi * 0.85')} as band_high, {r('hi * 1.1')} as axis_end from (select {SQL_AGG[agg].format('l_quantity')} as v,
 min(l_quantity) as lo, max(l_quantity) as hi from {GAPS})"""


for _agg in ("Mean", "Median"):
    query(f"chart_gauge_{_agg.lower()}", gauge_sql(_agg))(lambda t, a=_agg: C.gauge(t("lineitem_gaps"), "l_quantity", a))

# --- insights ------------------------------------------------------------------------------------------------------------
BAR15 = f"(select p_brand, m from ({PART_SUM}) order by m desc, p_brand limit 15)"


@query("insight_segments", f"""with b as {BAR15}, s as (select sum(m) as total from b)
 (select 'Dominant Segment' as label, p_brand as subject, {r('m', 2)} as value, {r('m * 100 / total', 2)} as extra from b, s order by m desc, p_brand limit 1)
 union all (select 'Lowest Segment', p_brand, {r('m', 2)}, {r('m * 100 / total', 2)} from b, s order by m, p_brand desc limit 1)
 union all select 'Top 3 Concentration', null, {r('sum(m)', 2)}, {r('sum(m) * 100 / min(total)', 2)} from (select m from b order by m desc limit 3), s""", digits=2)
def _(t: Tables) -> DataFrame:
    return N.segments(C.bar(t("part"), "p_brand", "p_retailprice"), "p_brand")


@query("insight_trend", f"""with c as (select l_linenumber as x, sum(l_extendedprice) as m from lineitem group by 1),
 e as (select (select m from c order by x limit 1) as s, (select m from c order by x desc limit 1) as e), d as (select (e - s) * 100 / abs(s) as d, e from e)
 select 'Trend Direction' as label, case when d > 2 then 'Upward Growth' when d < -2 then 'Downward Decline' else 'Stable / Flat' end as subject, {r('d', 2)} as value, {r('e', 2)} as extra from d
 union all (select 'Peak Point', x::varchar, {r('m', 2)}, null from c order by m desc, x limit 1)
 union all (select 'Trough Point', x::varchar, {r('m', 2)}, null from c order by m, x limit 1)""", digits=2)
def _(t: Tables) -> DataFrame:
    return N.trend(C.line(t("lineitem"), "l_linenumber", "l_extendedprice"), "l_linenumber")


RELATION = """case when abs(r) >= 0.7 then 'Strong' || s when abs(r) >= 0.4 then 'Moderate' || s when abs(r) >= 0.15 then 'Weak' || s else 'Negligible / Uncorrelated' end"""
for _source, _x, _y in (("lineitem", "l_quantity", "l_extendedprice"), ("part", "p_partkey", "p_retailprice")):
    query(f"insight_relationship_{_source}", f"""with c as (select {pearson(f'{_x}::double', f'{_y}::double')} as r, count(*) as n from {_source}),
 d as (select *, case when r > 0 then ' Positive' else ' Negative' end as s from c)
 select 'Pearson Correlation (r)' as label, {RELATION} as subject, {r('r')} as value, null::double as extra from d
 union all select 'Sample Size', null, n, null from d""")(lambda t, s=_source, a=_x, b=_y: N.relationship(t(s), a, b))


@query("insight_distribution", f"""with f as (select quantile_cont(value, 0.25) as a, quantile_cont(value, 0.75) as b, {skew0('value')} as s, count(*) as n from events),
 o as (select count(*) as k from events, f where value < a - 1.5 * (b - a) or value > b + 1.5 * (b - a))
 select 'Distribution Symmetry' as label, case when s > 0.8 then 'Right-Skewed (Positive tail)' when s < -0.8 then 'Left-Skewed (Negative tail)' else 'Approximately Symmetric' end as subject,
 {r('s')} as value, null::double as extra from f union all select 'Interquartile Range (IQR)', null, {r('b - a')}, null from f
 union all select 'Statistical Outliers', null, k, {r('k * 100.0 / n')} from f, o""")
def _(t: Tables) -> DataFrame:
    return N.distribution(t("events"), "value")


@query("insight_heatmap", f"""with c as ({pairs_sql('part', ['p_partkey', 'p_retailprice', 'p_size'], 2)})
 (select 'Strongest Correlation' as label, var1 || ' ↔ ' || var2 as subject, r as value, null::double as extra from c order by round(abs(r), 9) desc, var1, var2 limit 1)
 union all select 'Positive Pairs', null, count(*) filter (where r > 0.3), count(*) from c
 union all select 'Negative Pairs', null, count(*) filter (where r < -0.3), count(*) from c""")
def _(t: Tables) -> DataFrame:
    return N.heatmap(C.heatmap(t("part")))


BALANCE = "select c_mktsegment as label, sum(c_acctbal - 5000) as m from customer group by 1"


@query("insight_waterfall", f"""with w as ({BALANCE} order by 1 limit 10) select 'Net Cumulative Delta' as label, null::varchar as subject, {r('sum(m)', 2)} as value, null::double as extra from w
 union all (select 'Top Positive Driver', label, {r('m', 2)}, null from w where m > 0 order by m desc, label limit 1)
 union all (select 'Top Negative Drag', label, {r('m', 2)}, null from w where m < 0 order by m, label limit 1)""", digits=2)
def _(t: Tables) -> DataFrame:
    balance = t("customer").withColumn("delta", F.col("c_acctbal") - 5000)
    return N.waterfall(C.waterfall(balance, "c_mktsegment", "delta"))


@query("insight_radar", f"""with m as (select p_brand, avg(p_partkey) as a, avg(p_size) as b, avg(p_retailprice) as c from part where p_brand in {TOP_BRANDS} group by 1),
 u as (select 'p_partkey' as n, avg(a) as v, 0 as k from m union all select 'p_size', avg(b), 1 from m union all select 'p_retailprice', avg(c), 2 from m)
 (select 'Highest Dimension' as label, n as subject, {r('v')} as value, null::double as extra from u order by v desc, k limit 1)
 union all (select 'Lowest Dimension', n, {r('v')}, null from u order by v, k limit 1) union all select 'Metrics Evaluated', null, 3, null""")
def _(t: Tables) -> DataFrame:
    return N.radar(C.radar(t("part"), PART_RADAR, "p_brand"))


@query("insight_gauge", f"""with g as ({gauge_sql('Mean')}) select 'Current Metric Value' as label, metric as subject, value, null::double as extra from g
 union all select 'Target Achievement', metric, {r('100 / 1.15')}, target from g""")
def _(t: Tables) -> DataFrame:
    return N.gauge(C.gauge(t("lineitem_gaps"), "l_quantity"))
