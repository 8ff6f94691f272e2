"""One notion of "missing": NULL, and NaN in floating point columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

NUMERIC, TEXT, DATETIME, BOOLEAN, OTHER = "numeric", "text", "datetime", "boolean", "other"


def kind_of(dtype: T.DataType) -> str:
    """Storage kind of a Spark type. Booleans are not numbers here."""
    if isinstance(dtype, T.NumericType):
        return NUMERIC
    if isinstance(dtype, (T.StringType, T.VarcharType, T.CharType)):
        return TEXT
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return DATETIME
    return BOOLEAN if isinstance(dtype, T.BooleanType) else OTHER


def kinds(df: DataFrame) -> dict[str, str]:
    return {f.name: kind_of(f.dataType) for f in df.schema.fields}


def columns_of(df: DataFrame, *wanted: str) -> list[str]:
    return [name for name, kind in kinds(df).items() if kind in wanted]


def numeric_columns(df: DataFrame) -> list[str]:
    return columns_of(df, NUMERIC)


def quoted(name: str) -> str:
    """A column name as SQL text (dots and spaces included)."""
    return "`" + name.replace("`", "``") + "`"


def text_literal(text: str) -> str:
    """A string as a SQL literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def name_col(name: str) -> Column:
    return F.col(quoted(name))


def value_sql(df: DataFrame, name: str) -> str:
    """The column with NaN read as NULL, as SQL text."""
    if isinstance(df.schema[name].dataType, (T.FloatType, T.DoubleType)):
        return f"nanvl({quoted(name)}, null)"
    return quoted(name)


def value(df: DataFrame, name: str) -> Column:
    return F.expr(value_sql(df, name))


def number_sql(df: DataFrame, name: str) -> str:
    """The column as a double, as SQL text; text is parsed, unparsable text is NULL."""
    if kind_of(df.schema[name].dataType) == TEXT:
        return parse_number_sql(quoted(name))
    return f"cast({value_sql(df, name)} as double)"


def number(df: DataFrame, name: str) -> Column:
    return F.expr(number_sql(df, name))


# Fixed value: what counts as a number in text. Java alone would also read 1d, 1f and 0x1p3.
NUMBER = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|(?i:inf(inity)?))\s*$"
EDGES = r"^\s+|\s+$"


def parse_number_sql(text: str) -> str:
    """Text to double, NULL when it is not a number. The anchored test fails early on long texts."""
    return f"case when {text} rlike r'{NUMBER}' then try_cast(regexp_replace({text}, r'{EDGES}', '') as double) end"


def parse_number(c: Column) -> Column:
    return F.when(c.rlike(NUMBER), strip(c).try_cast("double"))


def strip(c: Column) -> Column:
    """Trim every kind of white space (``trim`` only knows the space character)."""
    return F.regexp_replace(c, EDGES, "")


def is_blank(c: Column) -> Column:
    return c.rlike(r"^\s*$")


def is_missing(df: DataFrame, name: str) -> Column:
    return value(df, name).isNull()


def without_nan(df: DataFrame) -> DataFrame:
    """The table with NaN turned into NULL, other columns untouched."""
    return df.select(*[value(df, c).alias(c) for c in df.columns])


def present(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows with every given column present; the NULL half reaches the scan as a filter."""
    for c in columns:
        df = df.where(name_col(c).isNotNull())
        if isinstance(df.schema[c].dataType, (T.FloatType, T.DoubleType)):
            df = df.where(~F.isnan(name_col(c)))
    return df
