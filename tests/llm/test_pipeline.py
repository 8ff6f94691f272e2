"""The pipeline's stages: columns, decisions, odd and empty input."""

import brute
import corpus_pipeline
import pytest
from pyspark.sql import functions as F

GIVEN = "/root/testdata/sf0.001"


def test_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "simhash_near_dedup", "secret_scan", "packing"]


@pytest.mark.parametrize("where", ["folder", "empty_folder", "given"])
def test_stages_keep_columns(spark, request, tmp_path, where):
    path = GIVEN if where == "given" else request.getfixturevalue(where)
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns = docs.dtypes
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.count()
        stage(spark, docs, path).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.dtypes == columns and docs.count() <= before
        assert docs.filter(~F.col("n_chars").eqNullSafe(F.length("text").cast("long"))).count() == 0
        if where == "given" and name != "simhash_near_dedup":
            assert docs.count() >= 0.99 * before
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, path)
    assert pieces.groupBy("doc_id").count().count() == docs.select("doc_id").distinct().count()


def test_decisions(spark):
    line = "one line of words that stands in several documents of this small table here"
    rows = [
        (0, f"alpha beta gamma delta\n{line}", "en"), (1, f"{line}\nepsilon zeta eta theta iota", "en"), (2, "12 34 56", "en"), (3, None, "en"),
        (4, "kappa lambda mu nu token=abcdefgh12345", "en"), (5, "kappa lambda mu nu token=abcdefgh12345", "en"),
    ]
    docs = spark.createDataFrame([(*r, "s", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    stages = dict(corpus_pipeline.STAGES)
    spoken = stages["language_id"](spark, docs, "")
    assert {r["doc_id"] for r in spoken.collect()} == {0, 1, 4, 5}
    lines = {r["doc_id"]: r["text"] for r in stages["line_dedup"](spark, spoken, "").collect()}
    assert lines == {0: rows[0][1], 1: "epsilon zeta eta theta iota", 4: rows[4][1], 5: ""}
    near = {r["doc_id"] for r in stages["simhash_near_dedup"](spark, docs, "").collect()}
    prints = [brute.fingerprint(r[1]) for r in rows]
    assert near == set(brute.groups([r[0] for r in rows], brute.near_pairs(prints)))
    masked = {r["doc_id"]: r["text"] for r in stages["secret_scan"](spark, docs, "").collect()}
    assert masked[4] == "kappa lambda mu nu [secret]" and masked[0] == rows[0][1] and masked[3] is None
