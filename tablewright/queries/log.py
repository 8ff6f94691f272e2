"""Usage-log analytics over logins (from events), uploads (from orders) and users (customers)."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, functions as F

from ..operators import usage as U
from .registry import Tables, query, source_sql
from .sqltext import SEMANTIC, i, profile_sql, r, ts
from .tables import CUSTOMER

AS_OF = datetime.datetime(2024, 1, 29, 15, 30)
LOGINS, UPLOADS = source_sql("logins"), source_sql("uploads")
STARTS = {"Today": "timestamp '2024-01-29 00:00:00'", "Last 7 Days": "timestamp '2024-01-22 15:30:00'", "Last 30 Days": "timestamp '2023-12-30 15:30:00'"}
LOGIN_ROW = f"user_id, email, {ts('login_time')} as login_time, provider, event_type"

for _period, _label in (("Today", "today"), ("Last 7 Days", "week"), ("Last 30 Days", "month"), ("All Time", "all")):
    _where = f"where login_time >= {STARTS[_period]}" if _period in STARTS else ""
    query(f"log_period_{_label}", f"select {LOGIN_ROW} from {LOGINS} {_where}")(
        lambda t, p=_period: U.in_period(t("logins"), "login_time", AS_OF, p)
    )

ISO = """case when event_id % 4 = 0 then strftime(ts, '%Y-%m-%dT%H:%M:%SZ') when event_id % 4 = 1 then strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+02:00'
 when event_id % 4 = 2 then strftime(ts, '%Y-%m-%d %H:%M:%S') else 'not a time' end"""


@query("log_parse_ts", f"""select event_id, {ISO} as text, {ts("case when event_id % 4 = 1 then date_trunc('second', ts) - interval 2 hour when event_id % 4 <> 3 then date_trunc('second', ts) end")} as at from events""")
def _(t: Tables) -> DataFrame:
    plain = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    turn = F.col("event_id") % 4
    text = (
        F.when(turn == 0, F.concat(plain, F.lit("Z")))
        .when(turn == 1, F.concat(plain, F.lit("+02:00")))
        .when(turn == 2, F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
        .otherwise("not a time")
    )
    return U.parse_times(t("events").select("event_id", text.alias("text")), "text")


def kpi_sql(start: str | None) -> str:
    login = f"login_time >= {start}" if start else "true"
    upload = f"upload_time >= {start}" if start else "true"
    active = f"select email from {LOGINS} where {login} union select email from {UPLOADS} where {upload}"
    return f"""select (select count(*) from customer) as registered_users, (select count(*) from {LOGINS} where {login}) as login_events,
 count(*) filter (where {upload}) as dataset_uploads, (select count(*) from ({active}) where email is not null and email not in ('', 'guest@session')) as active_users,
 (select count(*) from {LOGINS} where login_time >= {STARTS['Today']}) as today_logins, count(*) filter (where upload_time >= {STARTS['Today']}) as today_uploads,
 {i("floor(coalesce(avg(row_count) filter (where " + upload + "), 0))")} as avg_rows, {i("floor(coalesce(avg(column_count) filter (where " + upload + "), 0))")} as avg_columns,
 {r("coalesce(avg(size_mb) filter (where " + upload + "), 0)", 2)} as avg_size_mb, {i("coalesce(sum(row_count) filter (where " + upload + "), 0)")} as total_rows from {UPLOADS}"""


for _period, _label in (("All Time", "all"), ("Last 7 Days", "week")):
    query(f"log_kpis_{_label}", kpi_sql(STARTS.get(_period)), digits=2)(
        lambda t, p=_period: U.kpis(t("customer"), t("logins"), t("uploads"), AS_OF, p)
    )


@query("log_active_users", f"select count(*) as active_users from (select email from {LOGINS} union select email from {UPLOADS}) where email <> 'guest@session'")
def _(t: Tables) -> DataFrame:
    return U.active_users(t("logins"), t("uploads"))


@query("log_type_counts", f"select coalesce(file_type, 'CSV') as file_type, count(*) as uploads from {UPLOADS} group by 1")
def _(t: Tables) -> DataFrame:
    return U.type_counts(t("uploads"))


@query("log_map_frequencies", """select upper(v[1:1]) || lower(v[2:]) as column_type, count(*) as columns from (select event_type as v from events
 union all select case when value > 20 then 'HIGH' else 'low' end from events) group by 1""")
def _(t: Tables) -> DataFrame:
    level = F.when(F.col("value") > 20, "HIGH").otherwise("low")
    types = F.create_map(F.lit("kind"), F.col("event_type"), F.lit("level"), level)
    return U.map_frequencies(t("events").select(types.alias("column_types")))


@query("log_feed", f"""select {ts('f.moment')} as "at", user_id, action, details, type from (select login_time as moment, user_id,
 case when provider = 'guest' then 'Guest Demo Started' else 'User Logged In' end as action, 'Session authenticated via ' || provider as details, 'login' as type from {LOGINS}
 union all select upload_time, user_id, 'Uploaded ' || dataset_name, row_count::varchar || ' rows', 'upload' from {UPLOADS}) f
 order by f.moment desc, type, user_id, details, action limit 50""")
def _(t: Tables) -> DataFrame:
    return U.activity_feed(t("logins"), t("uploads"))


@query("log_users", f"""select c_custkey, c_name, c_nationkey::bigint as c_nationkey, {r('c_acctbal')} as c_acctbal, c_mktsegment, count(o_orderkey) as upload_count
 from customer left join orders on c_custkey = o_custkey group by all""")
def _(t: Tables) -> DataFrame:
    uploads = t("orders").withColumnRenamed("o_custkey", "c_custkey")
    return U.users_with_uploads(t("customer"), uploads, "c_custkey")


@query("log_search", f"""select o_orderkey, user_id, email, {ts('upload_time')} as upload_time, dataset_name, file_type, row_count, column_count, {r('size_mb')} as size_mb
 from {UPLOADS} where contains(dataset_name, '77') or contains(email, '77')""")
def _(t: Tables) -> DataFrame:
    found = U.search(t("uploads"), " 77 ", ["dataset_name", "email"])
    return U.newest_first(found, "upload_time", "o_orderkey")


@query("log_user_upsert", f"""select user_id, {ts('min(login_time)')} as created_at, {ts('max(login_time)')} as last_login_at,
 arg_max(provider, (login_time, provider, event_type)) as provider, arg_max(event_type, (login_time, provider, event_type)) as event_type from {LOGINS} group by 1""")
def _(t: Tables) -> DataFrame:
    return U.upsert_users(t("logins"), "user_id", "login_time", ["provider", "event_type"])


@query("log_upload_record", f"""with {profile_sql('customer_gaps', CUSTOMER)}, k as (select *, {SEMANTIC} as st from p)
 select 'customers.parquet' as dataset_name, 'Parquet' as file_type, 'parquet' as file_extension, max(rows) as row_count, 5::bigint as column_count,
 string_agg(col, ',' order by position) as column_names, string_agg(col || '=' || lower(st), ',' order by col) as column_types,
 count(*) filter (where st = 'Numeric') as numeric_columns, count(*) filter (where st = 'Categorical') as categorical_columns,
 count(*) filter (where st = 'Date/Time') as datetime_columns, {i('sum(missing)')} as missing_cells, {r('sum(missing) * 100.0 / (max(rows) * 5)', 2)} as missing_pct from k""")
def _(t: Tables) -> DataFrame:
    record = U.upload_record(t("customer_gaps"), "customers.parquet", "Parquet")
    pairs = F.transform(F.map_entries("column_types"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return record.withColumns(
        {"column_names": F.array_join("column_names", ","), "column_types": F.array_join(F.array_sort(pairs), ",")}
    )
