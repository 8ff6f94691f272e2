"""What several operators share: the shared folder, written intermediates, and keys of rows."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

_OWN: dict[str, str] = {}
_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors' Python workers, once per application."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parent.parent
    target = Path(tempfile.mkdtemp(prefix="tablewright-")) / "tablewright_workers.zip"
    with zipfile.ZipFile(target, "w") as archive:
        for file in sorted(package.rglob("*.py")):
            archive.write(file, file.relative_to(package.parent))
    context.addPyFile(str(target))
    _SHIPPED.add(context.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors see; one of our own only in a local session without it (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    application = spark.sparkContext.applicationId
    if application not in _OWN:
        _OWN[application] = "file://" + tempfile.mkdtemp(prefix="tablewright-")
    return _OWN[application]


def written(frame: DataFrame, what: str) -> DataFrame:
    """Cuts lineage: writes the rows as Parquet into the shared folder and reads them back.

    A lost executor costs nothing that was written. The files stay until the owner of the shared folder clears it.
    """
    path = f"{shared_dir(frame.sparkSession)}/{what}-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def read_bytes(spark: SparkSession, path: str) -> bytes:
    """A small file (a vocabulary) as bytes, read on the driver from a local path or else through Spark."""
    try:
        with open(path, "rb") as file:
            return file.read()
    except FileNotFoundError:
        return bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)
