"""Usage-log analytics over three tables: users, logins and uploads.

``as_of`` is always a parameter, so a report can be repeated.
"""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.dates import parse_utc
from ..functions.missing import name_col
from .profile import column_types, table_summary
from .winners import winning_rows

GUEST = "guest@session"
PERIODS = ("Today", "Last 7 Days", "Last 30 Days", "All Time")


def _moment(as_of: datetime.datetime) -> Column:
    return F.lit(as_of.isoformat(sep=" ")).cast("timestamp_ntz")


def cutoff(as_of: datetime.datetime, period: str) -> datetime.datetime | None:
    """Start of a period, None for all time."""
    if period == "Today":
        return datetime.datetime(as_of.year, as_of.month, as_of.day)
    days = {"Last 7 Days": 7, "Last 30 Days": 30}.get(period)
    return as_of - datetime.timedelta(days=days) if days else None


def in_period(log: DataFrame, time: str, as_of: datetime.datetime, period: str) -> DataFrame:
    """Rows at or after the start of the period; rows without a time only count for all time.

    The comparison is on the bare column, so a timestamp filter reaches the scan.
    """
    start = cutoff(as_of, period)
    return log if start is None else log.where(name_col(time) >= _moment(start))


def parse_times(log: DataFrame, time: str, out: str = "at") -> DataFrame:
    """Add the instant of an ISO text column (``Z``, offset, or none = UTC)."""
    return log.withColumn(out, parse_utc(name_col(time)))


def kpis(
    users: DataFrame, logins: DataFrame, uploads: DataFrame, as_of: datetime.datetime, period: str = "All Time"
) -> DataFrame:
    """One row of totals. logins: email, login_time. uploads: email, upload_time, row_count, column_count, size_mb."""
    today = _moment(cutoff(as_of, "Today"))
    first = cutoff(as_of, period)

    def chosen(time: str) -> Column:
        return F.lit(True) if first is None else F.coalesce(F.col(time) >= _moment(first), F.lit(False))

    kept = chosen("login_time")
    login_side = logins.agg(
        F.struct(F.count_if(kept).alias("events"), F.count_if(F.col("login_time") >= today).alias("today")).alias("s")
    ).scalar()
    kept = chosen("upload_time")
    upload_side = uploads.agg(
        F.count_if(kept).alias("uploads"),
        F.count_if(F.col("upload_time") >= today).alias("today_uploads"),
        F.coalesce(F.sum(F.when(kept, F.col("row_count"))), F.lit(0)).cast("bigint").alias("rows"),
        F.coalesce(F.sum(F.when(kept, F.col("column_count"))), F.lit(0)).cast("bigint").alias("cols"),
        F.coalesce(F.sum(F.when(kept, F.col("size_mb"))), F.lit(0.0)).alias("size"),
    )
    registered = users.agg(F.count(F.lit(1))).scalar()
    active = active_users(
        in_period(logins, "login_time", as_of, period), in_period(uploads, "upload_time", as_of, period)
    ).scalar()

    def mean(total: str) -> Column:
        return F.coalesce(F.try_divide(F.col(total).cast("double"), F.col("uploads").cast("double")), F.lit(0.0))

    return upload_side.select(
        registered.alias("registered_users"),
        login_side["events"].alias("login_events"),
        F.col("uploads").alias("dataset_uploads"),
        active.alias("active_users"),
        login_side["today"].alias("today_logins"),
        "today_uploads",
        F.floor(mean("rows")).alias("avg_rows"),
        F.floor(mean("cols")).alias("avg_columns"),
        F.round(mean("size"), 2).alias("avg_size_mb"),
        F.col("rows").alias("total_rows"),
    )


def active_users(logins: DataFrame, uploads: DataFrame) -> DataFrame:
    """One row: distinct users over both logs, guests and blanks left out."""
    both = logins.select("email").union(uploads.select("email"))
    known = both.where(F.col("email").isNotNull() & (F.col("email") != "") & (F.col("email") != GUEST))
    return known.distinct().agg(F.count(F.lit(1)).alias("active_users"))


def type_counts(uploads: DataFrame, column: str = "file_type", default: str = "CSV") -> DataFrame:
    """Uploads per file type; a missing type is the default."""
    return uploads.groupBy(F.coalesce(name_col(column), F.lit(default)).alias("file_type")).agg(
        F.count(F.lit(1)).alias("uploads")
    )


def map_frequencies(uploads: DataFrame, column: str = "column_types") -> DataFrame:
    """How often each value occurs in a map column, first letter upper case, the rest lower."""
    values = uploads.select(F.explode(F.map_values(name_col(column))).alias("v")).where(F.col("v").isNotNull())
    shown = F.concat(F.upper(F.substring("v", 1, 1)), F.lower(F.expr("substring(v, 2)")))
    return values.groupBy(shown.alias("column_type")).agg(F.count(F.lit(1)).alias("columns"))


def activity_feed(logins: DataFrame, uploads: DataFrame, n: int = 50) -> DataFrame:
    """Newest ``n`` events of both logs in one shape.

    logins: login_time, user_id, provider. uploads: upload_time, user_id, dataset_name, row_count.
    """
    guest = F.col("provider") == "guest"
    seen = logins.select(
        F.col("login_time").alias("at"),
        "user_id",
        F.when(guest, "Guest Demo Started").otherwise("User Logged In").alias("action"),
        F.concat(F.lit("Session authenticated via "), F.coalesce("provider", F.lit("email_password"))).alias("details"),
        F.lit("login").alias("type"),
    )
    sent = uploads.select(
        F.col("upload_time").alias("at"),
        "user_id",
        F.concat(F.lit("Uploaded "), "dataset_name").alias("action"),
        F.concat(F.col("row_count").cast("string"), F.lit(" rows")).alias("details"),
        F.lit("upload").alias("type"),
    )
    both = seen.unionByName(sent)
    return both.orderBy(F.col("at").desc_nulls_last(), "type", "user_id", "details", "action").limit(n)


def users_with_uploads(users: DataFrame, uploads: DataFrame, key: str = "user_id") -> DataFrame:
    """Every user with the number of all uploads, 0 when none. Uploads are counted before the join."""
    counts = uploads.groupBy(name_col(key)).agg(F.count(F.lit(1)).alias("upload_count"))
    return users.join(counts, key, "left").withColumn("upload_count", F.coalesce("upload_count", F.lit(0)))


def newest_first(log: DataFrame, time: str, *ties: str) -> DataFrame:
    return log.orderBy(name_col(time).desc_nulls_last(), *[name_col(t) for t in ties])


def search(log: DataFrame, text: str, columns: list[str]) -> DataFrame:
    """Rows where one of the columns contains the text, ignoring case."""
    word = text.strip().lower()
    if not word:
        return log
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.lower(name_col(c)).contains(word), F.lit(False))
    return log.where(hit)


def upsert_users(log: DataFrame, key: str, time: str, latest: list[str]) -> DataFrame:
    """One row per user: first and last time seen, and the other fields as last seen."""
    seen = {"created_at": F.min(name_col(time)), "last_login_at": F.max(name_col(time))}
    own = log.select(*[name_col(c) for c in dict.fromkeys([key, time, *latest])])
    last = winning_rows(own, [key], [time, *latest], "last", seen)
    return last.select(name_col(key), *seen, *[name_col(c) for c in latest])


def upload_record(df: DataFrame, dataset: str, file_type: str = "CSV") -> DataFrame:
    """What is logged about an upload: names, types, sizes and missing share, never a value."""
    types = column_types(df).agg(
        F.map_from_entries(
            F.array_sort(F.collect_list(F.struct("column", F.lower("semantic_type"))))
        ).alias("column_types"),
        *[
            F.count_if(F.col("semantic_type") == t).alias(f)
            for t, f in (
                ("Numeric", "numeric_columns"),
                ("Categorical", "categorical_columns"),
                ("Date/Time", "datetime_columns"),
            )
        ],
    )
    whole = table_summary(df).select(F.struct("rows", "missing_cells", "missing_pct").alias("t")).scalar()
    extension = dataset.rsplit(".", 1)[-1].lower() if "." in dataset else file_type.lower()
    return types.select(
        F.lit(dataset).alias("dataset_name"),
        F.lit(file_type).alias("file_type"),
        F.lit(extension).alias("file_extension"),
        whole["rows"].alias("row_count"),
        F.lit(len(df.columns)).alias("column_count"),
        F.array(*[F.lit(c) for c in df.columns]).alias("column_names"),
        "column_types",
        "numeric_columns",
        "categorical_columns",
        "datetime_columns",
        whole["missing_cells"].alias("missing_cells"),
        F.round(whole["missing_pct"], 2).alias("missing_pct"),
    )
