"""CSV reading and writing."""

import os

import pytest

from tablewright.sources import tables as S


def written(tmp_path, name, content: bytes):
    path = os.path.join(tmp_path, name)
    with open(path, "wb") as f:
        f.write(content)
    return path


def test_utf8_and_trimmed_names(spark, tmp_path):
    df = S.load_csv(spark, written(tmp_path, "a.csv", " Name , Age\nZoë,3\nBob,4\n".encode()))
    assert df.columns == ["Name", "Age"]
    assert {r["Name"] for r in df.collect()} == {"Zoë", "Bob"}


def test_latin1(spark, tmp_path):
    df = S.load_csv(spark, written(tmp_path, "a.csv", "name,n\nZoë,3\n".encode("latin-1")))
    assert df.first()["name"] == "Zoë"


def test_mixed_files(spark, tmp_path):
    one = written(tmp_path, "a.csv", "name,n\nZoë,3\n".encode("latin-1"))
    two = written(tmp_path, "b.csv", "n;name\n4;Åsa\n".encode())
    assert {tuple(r) for r in S.load_csv(spark, [one, two]).collect()} == {("Zoë", 3), ("Åsa", 4)}


def test_byte_order_mark(spark, tmp_path):
    df = S.load_csv(spark, written(tmp_path, "a.csv", "name,n\nx,3\n".encode("utf-8-sig")))
    assert df.columns == ["name", "n"]


@pytest.mark.parametrize("sep", [";", "\t"])
def test_separators(spark, tmp_path, sep):
    df = S.load_csv(spark, written(tmp_path, "a.csv", f"a{sep}b\n1{sep}x\n".encode()))
    assert df.columns == ["a", "b"] and df.first()["a"] == 1


def test_quoted_comma_and_quote(spark, tmp_path):
    df = S.load_csv(spark, written(tmp_path, "a.csv", b'a,b\n"New York, NY","say ""hi"""\n'))
    assert tuple(df.first()) == ("New York, NY", 'say "hi"')


@pytest.mark.parametrize("content", [b"", b"Col1,Col2,Col3\n"])
def test_empty_inputs(spark, tmp_path, content):
    with pytest.raises(S.TableError):
        S.load_csv(spark, written(tmp_path, "a.csv", content))


def test_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "b", c'), (2, None)], "n int, t string")
    path = os.path.join(tmp_path, "out.csv")
    S.write_csv(df, path)
    assert sorted(map(tuple, S.load_table(spark, path, df.schema).collect())) == sorted(map(tuple, df.collect()))


def test_dispatch(spark, tmp_path):
    path = os.path.join(tmp_path, "t.parquet")
    spark.range(3).write.parquet(path)
    assert S.load_table(spark, path).count() == 3
    with pytest.raises(S.TableError):
        S.load_table(spark, os.path.join(tmp_path, "t.docx"))


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_breaks_inside_quotes_are_read_by_many_tasks(spark, tmp_path, end):
    import csv
    import io
    import random

    draw, rows = random.Random(3), []
    for i in range(3000):
        text = "".join(draw.choice(["word ", "\n", "\n\n", '"', ",", "é", "a,b", " x", end]) for _ in range(draw.randrange(12)))
        rows.append((i, text + "." if i % 50 else "long " + "line\n" * 3000 * (i == 50) + "."))
    out = io.StringIO(newline="")
    csv.writer(out, lineterminator=end).writerows([("n", " t "), *rows])
    path = written(tmp_path, "a.csv", (end + out.getvalue()).encode())
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        df = S.load_csv(spark, path, "n int, t string")
        lines = spark.read.text(path)
        assert lines.rdd.getNumPartitions() > 5
        assert sorted(map(tuple, df.collect())) == rows
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_several_files_with_breaks(spark, tmp_path):
    one = written(tmp_path, "a.csv", b'n,t\n1,"x\ny"\n2,plain\n')
    two = written(tmp_path, "b.csv", 'n;t\n3;"Å\n\n;"\n\n4;""\n'.encode("latin-1"))
    assert {tuple(r) for r in S.load_csv(spark, [one, two]).collect()} == {(1, "x\ny"), (2, "plain"), (3, "Å\n\n;"), (4, None)}
