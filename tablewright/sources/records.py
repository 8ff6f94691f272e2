"""CSV files with line breaks inside quotes, read by many tasks.

Whether a line begins a record depends on the quotes before it: an even number, and it does. Each split of a file tells how
many quotes it holds and how many of its lines begin records if it starts outside of quotes, or inside. The running XOR over
a file's splits then says how each really starts, so every split finds its records without the others. Only the lines of
records that span several lines meet again, by record.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

SPLIT = ["file", "block"]


def _lines(spark: SparkSession, paths: list[str], encoding: str) -> DataFrame:
    """(file, block, line, value, quotes): `line` rises with the place of a line in its split."""
    lines = spark.read.option("lineSep", "\n").text(paths)
    if encoding.upper() not in ("UTF-8", "UTF8"):  # lines come as bytes
        lines = lines.select(F.decode(F.col("value").cast("binary"), encoding).alias("value"), "_metadata")
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    return lines.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"), "value", quotes.alias("quotes")
    )


def _filled() -> Column:
    return F.btrim("value", F.lit(" \t\r")) != ""


def _open(lines: DataFrame) -> DataFrame:
    """Adds `odd`: whether an odd number of quotes of the same split comes before the line."""
    before = Window.partitionBy(*SPLIT).orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    return lines.withColumn("odd", F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2 == 1)


def _splits(lines: DataFrame) -> DataFrame:
    """(file, block, inside, from_block, from_record): how each split starts, and which record is open there. A row per split."""
    small = _open(lines.select(*SPLIT, "line", "quotes", _filled().alias("filled")))
    told = small.groupBy(*SPLIT).agg(F.sum("quotes").alias("quotes"), F.count_if(F.col("filled") & ~F.col("odd")).alias("outside"), F.count_if(F.col("filled") & F.col("odd")).alias("within"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    started = told.withColumn("inside", F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2 == 1)
    started = started.withColumn("records", F.when(F.col("inside"), F.col("within")).otherwise(F.col("outside")))
    # A blank line inside quotes begins nothing; a split without a record goes on with the one open before it.
    last = F.last(F.when(F.col("records") > 0, F.struct("block", "records")), ignorenulls=True).over(before)
    return started.select(*SPLIT, "inside", last["block"].alias("from_block"), last["records"].alias("from_record"))


def csv_records(spark: SparkSession, paths: list[str], encoding: str) -> DataFrame:
    """(value): every record of the files but their headers, line breaks inside quotes kept, blank lines left out.

    A quote that is never closed makes one record of the rest of its file.
    """
    lines = _lines(spark, paths, encoding)
    rows = _open(lines).join(F.broadcast(_splits(lines)), SPLIT)  # one row per split, so the smaller side by far
    rows = rows.withColumn("begins", (F.col("odd") == F.col("inside")) & _filled())
    so_far = Window.partitionBy(*SPLIT).orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("own", F.count_if("begins").over(so_far))
    rows = rows.select(
        "file", F.when(F.col("own") > 0, F.col("block")).otherwise(F.col("from_block")).alias("first_block"), F.when(F.col("own") > 0, F.col("own")).otherwise(F.col("from_record")).alias("record"),
        "block", "line", "value", "quotes", "begins", (F.col("odd") != F.col("inside")).alias("within"),
    ).where("record is not null and (begins or within)")
    header = F.col("first_block").isin(0) & (F.col("record") == 1)
    alone = F.col("begins") & (F.col("quotes") % 2 == 0)
    body = rows.where(~header)
    several = body.where(~alone).groupBy("file", "first_block", "record").agg(F.array_sort(F.collect_list(F.struct("block", "line", "value"))).alias("parts"))
    joined = several.select(F.array_join(F.transform("parts", lambda x: x["value"]), "\n").alias("value"))
    return body.where(alone).select("value").unionByName(joined).select(F.regexp_replace("value", "\r$", "").alias("value"))


def read_broken_csv(spark: SparkSession, paths: list[str], schema: T.StructType, encoding: str, separator: str) -> DataFrame:
    """The files as a table with the columns of ``schema``, by position."""
    options = {"sep": separator, "quote": '"', "escape": '"', "multiLine": "true"}
    shape = ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(schema.fields))
    parsed = csv_records(spark, paths, encoding).select(F.from_csv("value", shape, options).alias("row"))
    return parsed.select("row.*").toDF(*schema.names)
