"""Building blocks of the comparison SQL. Spark never sees this text."""

from __future__ import annotations

from . import words as W
from .registry import source_sql

CURRENCY = "[$€£₹¥]"
SYMBOLS = r"[,$€£₹\s%]"


def r(expr: str, digits: int = 4) -> str:
    return f"(round(cast({expr} as double), {digits}) + 0.0)"


def i(expr: str) -> str:
    return f"cast({expr} as bigint)"


def ts(expr: str) -> str:
    return f"strftime({expr}, '%Y-%m-%d %H:%M:%S.%f')"


def day(expr: str) -> str:
    return f"strftime({expr}, '%Y-%m-%d')"


def std0(x: str) -> str:
    return f"case when count({x}) = 1 then 0.0 else stddev_samp({x}) end"


def skew0(x: str) -> str:
    return (
        f"case when count({x}) = 0 then null when count({x}) >= 3 and stddev_samp({x}) > 0 "
        f"then skewness({x}) else 0.0 end"
    )


def kurt0(x: str) -> str:
    return (
        f"case when count({x}) = 0 then null when count({x}) >= 4 and stddev_samp({x}) > 0 "
        f"then kurtosis({x}) else 0.0 end"
    )


def q(x: str, p: float) -> str:
    return f"quantile_cont(cast({x} as double), {p})"


def pct(part: str, whole: str) -> str:
    return f"coalesce(cast({part} as double) * 100.0 / nullif(cast({whole} as double), 0), 0.0)"


def pearson(a: str, b: str) -> str:
    """Two-step in the text, so that it does not lean on the engine's own corr."""
    both = f"({a}) is not null and ({b}) is not null"
    return (
        f"(covar_samp({a}, {b}) / nullif(stddev_samp(case when {both} then {a} end) * "
        f"stddev_samp(case when {both} then {b} end), 0))"
    )


def named(column: str, words: str) -> str:
    return f"regexp_matches(lower('{column}'), '(^|_)({'|'.join(words.split())})$')"


def word_pairs() -> list[tuple[str, str]]:
    return [
        ("true", "false"), ("1", "0"), ("1.0", "0.0"), ("yes", "no"), ("y", "n"), ("t", "f"),
        ("active", "inactive"), ("enable", "disable"), ("enabled", "disabled"),
    ]


def profile_sql(source: str, columns: list[tuple[str, str]], label: str = "p") -> str:
    """CTEs ending in ``label``: one row per column with everything the audit needs.

    ``columns`` is a list of (name, kind) with kind numeric, text, datetime or boolean. Use after WITH.
    """
    parts = []
    for position, (c, kind) in enumerate(columns):
        parts.append(_column_sql(position, c, kind, f"{label}_src"))
    union = " union all ".join(parts)
    base = f"{label}_src as (select * from {source_sql(source) if not source.startswith('(') else source})"
    final = (
        f"{label} as (select *, q3 - q1 as iqr, q1 - (q3 - q1) * 1.5 as lower_, q3 + (q3 - q1) * 1.5 as upper_, "
        f"{pct('missing', 'rows')} as missing_pct from {label}_raw)"
    )
    return f"{base}, {label}_raw as ({union}), {final}"


def _column_sql(position: int, c: str, kind: str, src: str) -> str:
    num, txt = kind == "numeric", kind == "text"
    x = f"cast({c} as double)"
    zero, null = "0::bigint", "null::double"
    non_negative = f"{named(c, W.NON_NEGATIVE_WORDS)} and not {named(c, W.ID_WORDS)}"
    percent = f"{named(c, W.PERCENT_WORDS)} and not contains(lower('{c}'), 'diff') and not contains(lower('{c}'), 'growth')"
    quart = f"(select quantile_cont({x}, [0.25, 0.5, 0.75]) as z from {src})"
    outliers = (
        f"(select count(*) from {src}, (select z[1] - (z[3] - z[1]) * 1.5 as lo, z[3] + (z[3] - z[1]) * 1.5 as hi from {quart}) "
        f"where {x} < lo or {x} > hi)"
    )
    stripped = f"regexp_replace({c}, '^\\s+|\\s+$', '', 'g')" if txt else "null"
    words = [
        f"min(lower(trim(cast({c} as varchar)))) in ('{a}','{b}') and max(lower(trim(cast({c} as varchar)))) in ('{a}','{b}')"
        for a, b in word_pairs()
    ]
    dates = "try_strptime({0}, ['%Y-%m-%d', '%Y-%m-%d %H:%M:%S'])".format(c)
    return f"""select {position}::bigint as position, '{c}' as col, '{kind}' as kind, count(*) as rows, count({c}) as non_null,
 count(*) - count({c}) as missing, count(distinct {c}) as distinct_,
 (select cast({c} as varchar) from {src} where {c} is not null group by {c} order by count(*) desc, {c} asc limit 1) as top_value,
 coalesce((select count(*) from {src} where {c} is not null group by {c} order by count(*) desc limit 1), 0) as top_count,
 {f'avg({x})' if num else null} as mean, {std0(x) if num else null} as std,
 {f'case when count({c}) = 1 then 0.0 else var_samp({x}) end' if num else null} as variance,
 {f'min({x})' if num else null} as min_, {f'max({x})' if num else null} as max_,
 {skew0(x) if num else null} as skewness, {kurt0(x) if num else null} as kurtosis,
 {f'count(*) filter (where {x} = 0)' if num else zero} as zeros,
 {f'count(*) filter (where isinf({x}))' if num else zero} as infinite,
 {f'case when {non_negative} then count(*) filter (where {x} < 0) else 0 end' if num else zero} as negative,
 {f'case when {percent} then count(*) filter (where {x} < 0 or {x} > 100) else 0 end' if num else zero} as out_of_percent,
 {f"count(*) filter (where regexp_full_match({c}, '\\s*'))" if txt else zero} as blank,
 {f'count(try_cast({stripped} as double))' if txt else zero} as number_like,
 {f"count(*) filter (where regexp_matches({c}, '{CURRENCY}'))" if txt else zero} as currency_like,
 {f"count(*) filter (where contains({c}, '%'))" if txt else zero} as percent_like,
 {f"count(try_cast(regexp_replace({c}, '{SYMBOLS}', '', 'g') as double))" if txt else zero} as symbol_number_like,
 {f"count(*) filter (where regexp_matches({c}, '[/\\-:\\sT]'))" if txt else zero} as delimited,
 {f'count({dates})' if txt else zero} as date_like,
 coalesce({f"({' or '.join(words)})" if (num or txt) else 'false'}, false) as boolean_words,
 {f'quantile_cont({x}, 0.25)' if num else null} as q1, {f'quantile_cont({x}, 0.5)' if num else null} as median_,
 {f'quantile_cont({x}, 0.75)' if num else null} as q3,
 {outliers if num else zero} as outliers,
 {named(c, W.ID_WORDS)} as is_id, {named(c, W.TYPE_ID_WORDS)} as id_named, {named(c, W.DATE_WORDS)} as date_named
 from {src}"""


RATIO = "(distinct_::double / rows)"
SEMANTIC = f"""case when kind = 'boolean' then 'Boolean' when non_null = 0 then 'Text'
 when distinct_ <= 2 and boolean_words then 'Boolean' when kind = 'datetime' then 'Date/Time'
 when kind = 'text' and (delimited::double / non_null > 0.7 or date_named) and date_like::double / non_null >= 0.85 then 'Date/Time'
 when id_named and ({RATIO} >= 0.7 or distinct_ > 50) then 'Text' when id_named then 'Categorical'
 when kind = 'numeric' and distinct_ = rows and rows > 30 and contains(lower(col), 'index') then 'Text'
 when kind = 'numeric' then 'Numeric'
 when (distinct_ <= 25 and ({RATIO} <= 0.7 or rows <= 10)) or ({RATIO} <= 0.20 and distinct_ < 100) then 'Categorical'
 else 'Text' end"""


def duplicates_sql(source: str, label: str = "dup") -> str:
    """CTE ``label``: rows, duplicate_rows, unique_rows, duplicate_pct."""
    src = source_sql(source) if not source.startswith("(") else source
    return (
        f"{label} as (select n as rows, n - u as duplicate_rows, u as unique_rows, {pct('n - u', 'n')} as duplicate_pct "
        f"from (select (select count(*) from {src}) as n, (select count(*) from (select distinct * from {src})) as u))"
    )
