"""Reading and writing tables: CSV with encoding and separator detection, Parquet, JSON, ORC."""

from __future__ import annotations

import os
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .records import read_broken_csv


class TableError(ValueError):
    """The source holds no usable table."""


def validate(df: DataFrame) -> tuple[bool, str]:
    """(usable, message): a table needs at least one column and one row."""
    if not df.columns:
        return False, "The dataset has no columns."
    if df.isEmpty():
        return False, "The dataset has no data rows."
    return True, ""


def trim_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[str(c).strip() for c in df.columns])


def _separator(header: str) -> str:
    """Comma, unless the header is a single name that holds another separator."""
    if "," not in header:
        for sep in (";", "\t"):
            if sep in header:
                return sep
    return ","


def _header(spark: SparkSession, paths: list[str], encoding: str) -> str:
    """First non-empty line; reads no more than the start of the input."""
    lines = spark.read.option("encoding", encoding).text(paths).where(F.length("value") > 0).head(1)
    return lines[0]["value"] if lines else ""


def _encoding(spark: SparkSession, path: str) -> str:
    """UTF-8 unless some line is not valid UTF-8; then Latin-1, which accepts any byte."""
    broken = spark.read.text(path).where(~F.is_valid_utf8("value")).head(1)
    return "ISO-8859-1" if broken else "UTF-8"


def _breaks(spark: SparkSession, path: str, encoding: str) -> bool:
    """Whether some quoted field holds a line break: then a line has an odd number of quotes."""
    lines = spark.read.option("encoding", encoding).text(path)
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    return bool(lines.where(quotes % 2 == 1).head(1))


def load_csv(
    spark: SparkSession,
    paths: str | list[str],
    schema: T.StructType | None = None,
    encoding: str | None = None,
    multi_line: bool | None = None,
) -> DataFrame:
    """Read CSV files with a header.

    Encoding and separator are found for each given path; paths that agree are read together and the groups
    are united by column name. Give ``schema``, ``encoding`` and ``multi_line`` for large inputs: finding any of them
    reads the data once more, and types of columns of files with line breaks inside quotes are found by one task per file.
    ``multi_line`` allows such breaks; by default only paths that hold one are read that way, by many tasks per file.
    """
    groups: dict[tuple[str, str, bool], list[str]] = {}
    for path in [paths] if isinstance(paths, str) else paths:
        found = encoding or _encoding(spark, path)
        broken = _breaks(spark, path, found) if multi_line is None else multi_line
        groups.setdefault((found, _separator(_header(spark, [path], found)), broken), []).append(path)
    parts = []
    for (found, sep, broken), members in groups.items():
        reader = spark.read.option("header", True).option("encoding", found).option("sep", sep)
        reader = reader.option("quote", '"').option("escape", '"').option("multiLine", broken)
        reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
        plain = reader.csv(members)
        parts.append(trim_names(read_broken_csv(spark, members, plain.schema, found, sep) if broken else plain))
    df = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts)
    usable, message = validate(df)
    if not usable:
        raise TableError(message)
    return df


def load_table(
    spark: SparkSession, path: str, schema: T.StructType | None = None, multi_line: bool | None = None
) -> DataFrame:
    """Read a file or directory by its extension. ``multi_line`` is for CSV, as in ``load_csv``."""
    extension = os.path.splitext(path.rstrip("/"))[1].lower().lstrip(".")
    if extension in ("csv", "tsv", "txt"):
        return load_csv(spark, path, schema, multi_line=multi_line)
    if extension not in ("parquet", "json", "orc"):
        raise TableError(f"Unsupported file format: '{extension}'. Supported: csv, tsv, txt, parquet, json, orc.")
    reader = spark.read.schema(schema) if schema is not None else spark.read
    df = trim_names(reader.format(extension).load(path))
    usable, message = validate(df)
    if not usable:
        raise TableError(message)
    return df


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write UTF-8 CSV part files with a header, one per partition."""
    df.write.mode(mode).option("header", True).option("quote", '"').option("escape", '"').csv(path)
