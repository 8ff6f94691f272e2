"""Summaries, correlations, outliers, deep dives, findings, timelines, investigations."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, functions as F

from ..operators import investigation as I, statistics as A
from .audit import DIRTY_CUSTOMER, DIRTY_EVENTS, DOCUMENTS, LINEITEM_GAPS
from .registry import Tables, query, source_sql
from .sqltext import SEMANTIC, duplicates_sql, i, kurt0, pct, pearson, profile_sql, q, r, skew0, std0
from .tables import EVENTS, LINEITEM, PART

# --- summaries -----------------------------------------------------------------------------------------------------
SUMMARY = f"""position, col as "column", non_null as count, {r('mean')} as mean, {r('median_')} as median, {r('std')} as std, {r('min_')} as min,
 {r('q1')} as q1, {r('q3')} as q3, {r('max_')} as max, {r('skewness')} as skewness, {r('kurtosis')} as kurtosis, {r('missing_pct')} as missing_pct"""
for _source, _columns in (("events_gaps", EVENTS[:5]), ("lineitem_gaps", LINEITEM_GAPS), ("documents", DOCUMENTS), ("part", PART)):
    query(f"eda_summary_{_source}", f"with {profile_sql(_source, _columns)} select {SUMMARY} from p where kind = 'numeric'")(
        lambda t, s=_source: A.summary(t(s))
    )


@query("eda_summary_search", f"with {profile_sql('lineitem_gaps', LINEITEM_GAPS)} select {SUMMARY} from p where kind = 'numeric' and contains(col, 'key')")
def _(t: Tables) -> DataFrame:
    return A.search_summary(A.summary(t("lineitem_gaps")), "KEY", "mean")


@query("eda_summary_leaders", f"""with {profile_sql('documents', DOCUMENTS)}, s as (select * from p where kind = 'numeric')
 (select 'Highest Mean' as headline, col as "column", {r('mean')} as value from s order by mean desc, position limit 1)
 union all (select 'Highest Std Dev', col, {r('std')} from s order by std desc, position limit 1)
 union all (select 'Max Abs Skewness', col, {r('skewness')} from s order by abs(skewness) desc, position limit 1)""")
def _(t: Tables) -> DataFrame:
    return A.summary_leaders(A.summary(t("documents")))


SKEW_LABEL = """case when skewness is null then 'Undefined' when abs(skewness) <= 0.5 then 'Approximately Symmetric' when skewness > 1 then 'Highly Right-Skewed'
 when skewness > 0.5 then 'Moderately Right-Skewed' when skewness < -1 then 'Highly Left-Skewed' else 'Moderately Left-Skewed' end"""
SKEW_CATEGORY = """case when skewness is null then 'neutral' when abs(skewness) <= 0.5 then 'symmetric' when skewness > 1 then 'right_high'
 when skewness > 0.5 then 'right_mod' when skewness < -1 then 'left_high' else 'left_mod' end"""
TAIL_LABEL = """case when kurtosis is null then 'Undefined' when kurtosis > 0.5 then 'Leptokurtic (Heavy-Tailed)'
 when kurtosis < -0.5 then 'Platykurtic (Light-Tailed)' else 'Mesokurtic (Normal Tails)' end"""
TAIL_CATEGORY = "case when kurtosis is null then 'neutral' when kurtosis > 0.5 then 'leptokurtic' when kurtosis < -0.5 then 'platykurtic' else 'mesokurtic' end"


@query("eda_shape_labels", f"""with {profile_sql('events', EVENTS)} select col as "column", {r('skewness', 3)} as skewness, {SKEW_LABEL} as skew_label,
 {SKEW_CATEGORY} as skew_category, {r('kurtosis', 3)} as kurtosis, {TAIL_LABEL} as kurtosis_label, {TAIL_CATEGORY} as kurtosis_category
 from p where kind = 'numeric'""", digits=3)
def _(t: Tables) -> DataFrame:
    return A.shape_labels(A.summary(t("events")))


# --- correlation ---------------------------------------------------------------------------------------------------
def pairs_sql(source: str, columns: list[str], digits: int | None = 4) -> str:
    """One SELECT per pair: var1, var2, r, n."""
    show = (lambda e: r(e, digits)) if digits is not None else (lambda e: e)
    return " union all ".join(
        f"select '{a}' as var1, '{b}' as var2, {show(pearson(f'cast({a} as double)', f'cast({b} as double)'))} as r, "
        f"count(*) filter (where {a} is not null and {b} is not null) as n from {source}"
        for a, b in combinations(columns, 2)
    )


LINE_NUMBERS = [c for c, k in LINEITEM_GAPS if k == "numeric"]


@query("corr_pearson", pairs_sql(source_sql("lineitem_gaps"), LINE_NUMBERS))
def _(t: Tables) -> DataFrame:
    return A.correlations(t("lineitem_gaps"))


@query("corr_pearson_constant", pairs_sql(source_sql("part"), ["p_partkey", "p_size", "p_retailprice"]))
def _(t: Tables) -> DataFrame:
    # The added constant has no spread: it must have no pair, and must not fail the others.
    part = t("part").withColumn("always_one", F.lit(1.0))
    return A.correlations(part, ["p_partkey", "p_size", "p_retailprice", "always_one"])


def spearman_sql(source: str, a: str, b: str) -> str:
    both = f"(select {a} as a, {b} as b from {source} where {a} is not null and {b} is not null)"
    ranked = (
        f"(select rank() over (order by a) + (count(*) over (partition by a) - 1) / 2.0 as x, "
        f"rank() over (order by b) + (count(*) over (partition by b) - 1) / 2.0 as y from {both})"
    )
    return f"select '{a}' as var1, '{b}' as var2, {r(pearson('x', 'y'))} as r, count(*) as n from {ranked}"


RANKED = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
EVERY = [c for c, k in LINEITEM if k == "numeric"]


@query("corr_spearman_all", " union all ".join(spearman_sql("lineitem", a, b) for a, b in combinations(EVERY, 2)))
def _(t: Tables) -> DataFrame:
    return A.correlations(t("lineitem"), method="spearman")


@query("corr_spearman", " union all ".join(spearman_sql("lineitem", a, b) for a, b in combinations(RANKED, 2)))
def _(t: Tables) -> DataFrame:
    return A.correlations(t("lineitem"), RANKED, "spearman")


@query("corr_spearman_gaps", " union all ".join(spearman_sql(source_sql("lineitem_gaps"), a, b) for a, b in combinations(LINE_NUMBERS, 2)))
def _(t: Tables) -> DataFrame:
    return A.correlations(t("lineitem_gaps"), method="spearman")


STRENGTH = """case when abs(r) >= 0.85 then 'Very Strong' when abs(r) >= 0.70 then 'Strong' when abs(r) >= 0.50 then 'Moderate'
 when abs(r) >= 0.30 then 'Weak' else 'Negligible' end"""


@query("corr_top_pairs", f"""with c as ({pairs_sql('part', ['p_partkey', 'p_size', 'p_retailprice'], None)} union all {pairs_sql('lineitem', [c for c, k in LINEITEM if k == 'numeric'], None)})
 (select 'positive' as direction, var1, var2, {r('r')} as r, {STRENGTH} as strength from c where r > 0 order by round(c.r, 9) desc, var1, var2 limit 8)
 union all (select 'negative', var1, var2, {r('r')}, {STRENGTH} from c where r < 0 order by round(c.r, 9), var1, var2 limit 8)""")
def _(t: Tables) -> DataFrame:
    pairs = A.correlations(t("part")).unionByName(A.correlations(t("lineitem")))
    return A.strongest_pairs(pairs, 8)


# --- outliers ------------------------------------------------------------------------------------------------------
OUTLIERS = f"""select col as "column", non_null as count, {r('q1', 6)} as q1, {r('q3', 6)} as q3, {r('iqr', 6)} as iqr, {r('lower_', 6)} as lower, {r('upper_', 6)} as upper,
 outliers as outlier_count, {r(pct('outliers', 'non_null'), 6)} as outlier_pct, {r('min_', 6)} as min, {r('max_', 6)} as max,
 case when {pct('outliers', 'non_null')} > 5 then 'High Outlier Burden' when outliers > 0 then 'Moderate Outliers' else 'Clean' end as status
 from p where kind = 'numeric' and non_null >= 4"""
for _source, _columns in (("events", EVENTS), ("documents", DOCUMENTS), ("lineitem_gaps", LINEITEM_GAPS)):
    query(f"eda_outliers_{_source}", f"with {profile_sql(_source, _columns)} {OUTLIERS}", digits=6)(lambda t, s=_source: A.outlier_summary(t(s)))


@query("eda_outlier_totals", f"""with {profile_sql('events', EVENTS)} select {i('sum(outliers)')} as total_outliers,
 {r(pct('sum(outliers)', 'sum(non_null)'))} as outlier_rate, count(*) filter (where outliers > 0) as affected_columns from p where kind = 'numeric'""")
def _(t: Tables) -> DataFrame:
    return A.outlier_totals(t("events"))


def _sample(source: str, c: str, order: str) -> str:
    return (
        f"(select '{c}' as \"column\", {order}, {r(c)} as value from {source}, (select z[1] - 1.5 * (z[2] - z[1]) as lo, z[2] + 1.5 * (z[2] - z[1]) as hi "
        f"from (select quantile_cont(cast({c} as double), [0.25, 0.75]) as z from {source})) where {c} < lo or {c} > hi order by {order} limit 10)"
    )


@query("eda_outlier_samples", _sample("documents", "n_chars", "doc_id"))
def _(t: Tables) -> DataFrame:
    return A.outlier_samples(t("documents"), ["n_chars"], ["doc_id"])


DIRTY_SAMPLES = " union all ".join(_sample(source_sql("events_dirty"), c, "event_id") for c in ("age", "amount"))


@query("eda_outlier_samples_events", DIRTY_SAMPLES)
def _(t: Tables) -> DataFrame:
    return A.outlier_samples(t("events_dirty"), ["user_id", "age", "amount"], ["event_id"])


# --- deep dives ----------------------------------------------------------------------------------------------------
@query("deep_dive_overview", f"""with {profile_sql('(select p_brand from part)', [('p_brand', 'text')])} select col as "column", {SEMANTIC} as semantic_type, rows, non_null,
 missing, {r('missing_pct')} as missing_pct, distinct_ as "distinct", {r(pct('distinct_', 'non_null'))} as distinct_pct, distinct_ = 1 as is_constant,
 distinct_ = rows and rows > 1 as is_unique from p""")
def _(t: Tables) -> DataFrame:
    return A.column_overview(t("part"), "p_brand")


def deep_sql(source: str, c: str) -> str:
    x = f"cast({c} as double)"
    lo, hi = f"({q(c, 0.25)} - 1.5 * ({q(c, 0.75)} - {q(c, 0.25)}))", f"({q(c, 0.75)} + 1.5 * ({q(c, 0.75)} - {q(c, 0.25)}))"
    quantiles = ", ".join(f"{r(q(c, p), 6)} as {n}" for p, n in ((0.01, "p1"), (0.05, "p5"), (0.25, "q1"), (0.5, "median"), (0.75, "q3"), (0.95, "p95"), (0.99, "p99")))
    return f"""select '{c}' as "column", count({c}) as count, {r(f'avg({x})', 6)} as mean, {r(std0(x), 6)} as std, {r(f'var_samp({x})', 6)} as variance,
 {r(f'min({x})', 6)} as min, {r(f'max({x})', 6)} as max, {r(f'max({x}) - min({x})', 6)} as value_range, {quantiles}, {r(f'{q(c, 0.75)} - {q(c, 0.25)}', 6)} as iqr,
 {r(lo, 6)} as lower, {r(hi, 6)} as upper, (select count(*) from {source}, (select {lo} as lo, {hi} as hi from {source}) where {x} < lo or {x} > hi) as outliers,
 {r(skew0(x), 6)} as skewness, {r(kurt0(x), 6)} as kurtosis from {source}"""


@query("deep_dive_numeric", deep_sql("events", "value"), digits=6)
def _(t: Tables) -> DataFrame:
    return A.numeric_deep_dive(t("events"), "value")


@query("deep_dive_numeric_gaps", deep_sql(source_sql("lineitem_gaps"), "l_quantity"), digits=6)
def _(t: Tables) -> DataFrame:
    return A.numeric_deep_dive(t("lineitem_gaps"), "l_quantity")


@query("deep_dive_categorical", f"""select p_name as value, count(*) as count, {r('count(*) * 100.0 / (select count(p_name) from part)')} as pct from part
 group by 1 order by count(*) desc, 1 limit 15""")
def _(t: Tables) -> DataFrame:
    return A.frequency_table(t("part"), "p_name")


@query("deep_dive_date", f"""select 'o_orderdate' as "column", count(o_orderdate) as count, strftime(min(o_orderdate), '%Y-%m-%d %H:%M:%S') as first,
 strftime(max(o_orderdate), '%Y-%m-%d %H:%M:%S') as last, date_diff('second', min(o_orderdate), max(o_orderdate)) // 86400 as span_days from {source_sql('orders_gaps')}""")
def _(t: Tables) -> DataFrame:
    return A.date_deep_dive(t("orders_gaps"), "o_orderdate")


for _source, _time, _format in (("orders", "o_orderdate", "%Y"), ("events", "ts", "%Y-%m-%d")):
    query(f"timeline_counts_{_source}", f"select strftime({_time}, '{_format}') as period, count(*) as records from {_source} group by 1")(
        lambda t, s=_source, c=_time: A.timeline(t(s), c)
    )

# Every order, with its day folded into one year, gives the span that is counted by month.
FOLDED = "(select timestamp '2001-01-01' + to_days((date_diff('day', timestamp '1995-01-01', o_orderdate) % 360)::int) as d from orders)"


@query("timeline_counts_months", f"select strftime(d, '%Y-%m') as period, count(*) as records from {FOLDED} group by 1")
def _(t: Tables) -> DataFrame:
    days = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1995-01-01").cast("date")) % 360
    folded = t("orders").select(F.date_add(F.lit("2001-01-01").cast("date"), days).alias("d"))
    return A.timeline(folded, "d")


@query("eda_histogram", f"""with l as (select min(n_chars)::double as lo, max(n_chars)::double as hi from documents),
 b as (select least(floor((n_chars - lo) / ((hi - lo) / 30)), 29)::bigint as bin, count(*) as n from documents, l group by 1)
 select s.bin, {r('lo + (hi - lo) / 30 * s.bin')} as lo, {r('lo + (hi - lo) / 30 * (s.bin + 1)')} as hi, coalesce(n, 0) as n
 from (select unnest(range(30)) as bin) s left join b on s.bin = b.bin, l""")
def _(t: Tables) -> DataFrame:
    from ..operators.charts import histogram

    return histogram(t("documents"), "n_chars", 30)


# --- findings ------------------------------------------------------------------------------------------------------
def findings_sql(source: str, columns: list[tuple[str, str]]) -> str:
    numeric = [c for c, k in columns if k == "numeric"]
    src = source_sql(source)
    crowded = f"non_null > 30 and distinct_ <> 1 and {pct('distinct_', 'non_null')} > 85 and kind <> 'numeric'"
    first3 = "(select string_agg(col, ', ' order by position) from (select col, position from p where {0}))"
    corr = (
        f", c as ({pairs_sql(src, numeric, None)})" if len(numeric) >= 2 else ", c as (select '' as var1, '' as var2, null::double as r where false)"
    )
    return f"""with {profile_sql(source, columns)}, {duplicates_sql(source)} {corr},
 k as (select count(*) filter (where missing_pct > 50) as severe, count(*) filter (where missing_pct > 20) as high, count(*) as n,
 count(*) filter (where non_null > 0 and distinct_ = 1) as constant, count(*) filter (where {crowded}) as crowded from p)
 select 'Missing Data' as category, 'CRITICAL' as severity, {first3.format('missing_pct > 50')} as subject, severe::double as measure from k where severe > 0
 union all select 'Missing Data', 'WARNING', {first3.format('missing_pct > 20')}, high from k where severe = 0 and high > 0
 union all select 'Completeness', 'POSITIVE', 'all columns', n from k where high = 0
 union all (select 'Correlation', 'STRONG CORRELATION', var1 || ' ↔ ' || var2, {r('r')} from c where r >= 0.75 order by round(r, 9) desc, var1, var2 limit 1)
 union all (select 'Correlation', 'INVERSE CORRELATION', var1 || ' ↔ ' || var2, {r('r')} from c where r <= -0.75 order by round(r, 9), var1, var2 limit 1)
 union all (select 'Distribution', 'HIGH SKEWNESS', col, {r('skewness')} from p where kind = 'numeric' and non_null >= 4 and abs(skewness) > 1.5
 order by abs(skewness) desc, position limit 1)
 union all (select 'Outliers', 'OUTLIER BURDEN', col, {r(pct('outliers', 'non_null'))} from p where kind = 'numeric' and non_null >= 4
 and {pct('outliers', 'non_null')} > 5 order by outliers desc, {pct('outliers', 'non_null')} desc, col limit 1)
 union all select 'Schema Quality', 'ZERO VARIANCE', (select string_agg(col, ', ' order by position) from p where non_null > 0 and distinct_ = 1), constant from k where constant > 0
 union all select 'Cardinality', 'HIGH CARDINALITY', {first3.format(crowded)}, crowded from k where crowded > 0
 union all select 'Uniqueness', 'DUPLICATES', duplicate_rows::varchar, {r('duplicate_pct')} from dup where duplicate_rows > 0"""


for _source, _columns in (("customer_dirty", DIRTY_CUSTOMER), ("events_dirty", DIRTY_EVENTS), ("documents", DOCUMENTS), ("part", PART)):
    query(f"eda_findings_{_source}", findings_sql(_source, _columns))(lambda t, s=_source: A.findings(t(s)))


# --- investigation --------------------------------------------------------------------------------------------------
GAPS = source_sql("lineitem_gaps")


@query("inv_target", f"""select {r('avg(l_quantity)')} as mean, {r('stddev_samp(l_quantity)')} as std, {r('min(l_quantity)')} as min, {r('max(l_quantity)')} as max,
 count(*) - count(l_quantity) as missing from {GAPS}""")
def _(t: Tables) -> DataFrame:
    return I.target_summary(t("lineitem_gaps"), "l_quantity")


@query("inv_by_category", f"""select l_returnflag as category, {r('avg(l_quantity)', 2)} as mean, count(l_quantity) as count, {r('stddev_samp(l_quantity)', 2)} as std
 from {GAPS} where l_returnflag is not null group by 1""", digits=2)
def _(t: Tables) -> DataFrame:
    return I.by_category(t("lineitem_gaps"), "l_quantity", "l_returnflag")


def bins_sql(source: str, target: str, dimension: str) -> str:
    return f"""with l as (select min({dimension})::double as lo, max({dimension})::double as hi,
 least(10, greatest(2, (select count(distinct {dimension}) from {source})))::bigint as k from {source}),
 b as (select greatest(1, least(k, ceil(({dimension} - lo) / ((hi - lo) / k))))::bigint as bin, avg({target}) as m, count({target}) as n
 from {source}, l where {dimension} is not null group by 1)
 select s.bin, {r('lo + (hi - lo) / k * (s.bin - 1) - case when s.bin = 1 then (hi - lo) * 0.001 else 0 end')} as lo,
 {r('lo + (hi - lo) / k * s.bin')} as hi, {r('m', 2)} as mean, coalesce(n, 0) as count
 from (select unnest(range(1, (select k + 1 from l))) as bin) s left join b on s.bin = b.bin, l"""


@query("inv_by_bins", bins_sql(GAPS, "l_quantity", "l_extendedprice"))
def _(t: Tables) -> DataFrame:
    return I.by_bins(t("lineitem_gaps"), "l_quantity", "l_extendedprice")


@query("inv_by_few_bins", bins_sql("lineitem", "l_quantity", "l_linenumber"))
def _(t: Tables) -> DataFrame:
    return I.by_bins(t("lineitem"), "l_quantity", "l_linenumber")


def correlates_sql(source: str, target: str, others: list[str], n: int = 4, digits: int = 4) -> str:
    rows = " union all ".join(f"select '{c}' as \"column\", {pearson(f'cast({c} as double)', f'cast({target} as double)')} as r from {source}" for c in others)
    return f'select "column", {r("r", digits)} as r from (select * from ({rows}) where r is not null order by round(abs(r), 9) desc, "column" limit {n})'


PART_NUMBERS = ["p_partkey", "p_size"]


@query("inv_correlates", correlates_sql(GAPS, "l_quantity", [c for c in LINE_NUMBERS if c != "l_quantity"]))
def _(t: Tables) -> DataFrame:
    return I.correlates(t("lineitem_gaps"), "l_quantity")


def confidence_sql(source: str, target: str, means: str, others: list[str]) -> str:
    outside = (
        f"(select count(*) * 100.0 / (select count({target}) from {source}) from {source}, (select z[1] - 1.5 * (z[2] - z[1]) as lo, z[2] + 1.5 * (z[2] - z[1]) as hi "
        f"from (select quantile_cont({target}, [0.25, 0.75]) as z from {source})) where {target} < lo or {target} > hi)"
    )
    best = f"(select * from ({correlates_sql(source, target, others, 1, 12)}))"
    return f"""with g as (select stddev_samp(m) as s, count(m) as n from ({means})),
 f as (select n as groups, coalesce(s / nullif((select stddev_samp({target}) from {source}), 0), 0) as ratio, {outside} as o,
 (select count(*) - count({target}) from {source}) as missing, (select "column" from {best}) as c, (select r from {best}) as cr from g)
 select groups, {r('ratio')} as ratio, case when groups > 1 and ratio > 0.5 then 'High' when groups > 1 and ratio > 0.2 then 'Medium' else 'Low' end as confidence,
 {r('o')} as outlier_pct, missing, coalesce(nullif(concat_ws('; ', case when o > 5 then 'outliers' end, case when abs(cr) >= 0.5 then 'driver: ' || c end,
 case when missing > 0 then 'missing values' end), ''), 'no anomalous driver') as explanation from f"""


@query("inv_confidence", confidence_sql(GAPS, "l_quantity", f"select round(avg(l_quantity), 2) as m from {GAPS} where l_returnflag is not null group by l_returnflag", [c for c in LINE_NUMBERS if c != "l_quantity"]))
def _(t: Tables) -> DataFrame:
    return I.confidence(t("lineitem_gaps"), "l_quantity", "l_returnflag")


@query("inv_confidence_bins", confidence_sql("part", "p_retailprice", f"select mean as m from ({bins_sql('part', 'p_retailprice', 'p_partkey')})", ["p_partkey", "p_size"]))
def _(t: Tables) -> DataFrame:
    return I.confidence(t("part"), "p_retailprice", "p_partkey")


# --- infinite values ---------------------------------------------------------------------------------------------------
INFINITE = "(select l_orderkey, l_quantity, l_extendedprice, case when l_orderkey % 1000 = 1 then cast('Infinity' as double) when l_orderkey % 1000 = 2 then cast('-Infinity' as double) else l_tax end as l_tax from lineitem)"
FINITE = ["l_orderkey", "l_quantity", "l_extendedprice"]


def _infinite(t: Tables) -> DataFrame:
    tax = "case when l_orderkey % 1000 = 1 then double('Infinity') when l_orderkey % 1000 = 2 then double('-Infinity') else l_tax end as l_tax"
    return t("lineitem").selectExpr(*FINITE, tax)


@query("corr_infinite", pairs_sql("lineitem", FINITE, 4))
def _(t: Tables) -> DataFrame:
    return A.correlations(_infinite(t))


@query("eda_shape_infinite", " union all ".join(
    f"""select '{c}' as "column", {r(skew0(c)) if c in FINITE else 'null::double'} as skewness, {r(kurt0(c)) if c in FINITE else 'null::double'} as kurtosis,
 {r(std0(f'cast({c} as double)')) if c in FINITE else 'null::double'} as std {'from lineitem' if c in FINITE else ''}""" for c in [*FINITE, "l_tax"]))
def _(t: Tables) -> DataFrame:
    return A.summary(_infinite(t)).select("column", "skewness", "kurtosis", "std")


@query("prep_missing_summary_infinite", """select col as "column", 0.0::double as missing_pct, 'Complete (No Action Needed)' as advice from (select unnest(['l_orderkey', 'l_quantity', 'l_extendedprice']) as col)
 union all select 'l_tax', round(count(*) filter (where l_orderkey % 3 = 0) * 100.0 / count(*), 2), 'Fill with Mean or Median' from lineitem""", digits=2)
def _(t: Tables) -> DataFrame:
    from ..operators.preparation import missing_summary

    gaps = _infinite(t).withColumn("l_tax", F.when(F.col("l_orderkey") % 3 != 0, F.col("l_tax")))
    return missing_summary(gaps).select("column", "missing_pct", "advice")


@query("eda_findings_infinite", """select 'Completeness' as category, 'POSITIVE' as severity, 'all columns' as subject, 4.0::double as measure
 union all select * from (select 'Uniqueness', 'DUPLICATES', (count(*) - count(distinct (l_orderkey, l_quantity, l_extendedprice, l_tax)))::varchar,
 (count(*) - count(distinct (l_orderkey, l_quantity, l_extendedprice, l_tax))) * 100.0 / count(*) as m from """ + INFINITE + """) where m > 0""")
def _(t: Tables) -> DataFrame:
    return A.findings(_infinite(t))
