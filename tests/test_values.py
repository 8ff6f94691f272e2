"""Small tables with known answers."""

import datetime

import pytest
from pyspark.sql import functions as F

from tablewright.functions import names
from tablewright.functions.stats import kurtosis_category, skew_category
from tablewright.functions.text import title_case
from tablewright.operators import decisions as D, outliers as O, preparation as R, profile as P, quality as Q, statistics as A
from tablewright.operators.decisions import Repair
from tablewright.plans.pipeline import Preparation, Step


def column(df, name):
    return [r[name] for r in df.collect()]


@pytest.fixture
def gaps(frame):
    rows = [(1, 10.0, "A", 1), (2, None, "B", 2), (3, 30.0, None, 3), (4, 40.0, "A", 4), (5, float("nan"), "C", 5)]
    return frame(rows, "id int, num double, cat string, clean int")


def test_fills(gaps):
    def filled(c, strategy, **kw):
        return column(R.fill_missing(gaps, [c], strategy, **kw).orderBy("id"), c)

    assert filled("num", "mean")[1] == pytest.approx(26.666, abs=1e-3)
    assert filled("num", "median") == [10, 30, 30, 40, 30]
    assert filled("cat", "mode")[2] == "A"
    assert filled("num", "zero")[4] == 0
    assert filled("cat", "zero")[2] == "0"
    assert filled("cat", "unknown")[2] == "Unknown"
    assert filled("num", "unknown")[1] == "Unknown"
    assert filled("num", "custom", custom="7") == [10, 7, 30, 40, 7]
    assert filled("num", "ffill", order_by="id") == [10, 10, 30, 40, 40]
    assert filled("num", "bfill", order_by="id")[:4] == [10, 30, 30, 40]
    assert filled("cat", "mean")[2] is None
    assert R.drop_missing_rows(gaps, ["num", "cat"]).count() == 2
    with pytest.raises(ValueError):
        R.fill_missing(gaps, ["num"], "ffill")
    with pytest.raises(ValueError):
        R.fill_missing(gaps, ["num"], "magic")


def test_input_is_not_changed(gaps):
    before = gaps.collect()
    R.fill_missing(gaps, ["num"], "mean").collect()
    assert str(gaps.collect()) == str(before)


def test_step_report(gaps):
    after = R.fill_missing(gaps, ["num"], "mean")
    row = R.step_report(gaps, after, ["num"]).first()
    assert (row["rows_before"], row["rows_after"], row["affected"]) == (5, 5, 2)
    assert R.step_report(gaps, R.drop_missing_rows(gaps, ["num"]), ["num"]).first()["affected"] == 2
    assert R.step_report(gaps, R.drop_columns(gaps, ["num"]), ["num"]).first()["affected"] == 1


@pytest.fixture
def copies(frame):
    rows = [(1, "A"), (2, "B"), (2, "B"), (3, "C"), (3, "C"), (3, "D")]
    return frame(rows, "id int, val string")


def test_duplicates(copies):
    info = R.duplicate_info(copies).first()
    assert (info["duplicate_count"], info["duplicate_pct"]) == (2, 33.33)
    assert R.drop_duplicates(copies).count() == 4
    first = R.drop_duplicates(copies, ["id"], "first", ["val"])
    assert sorted(map(tuple, first.collect())) == [(1, "A"), (2, "B"), (3, "C")]
    last = R.drop_duplicates(copies, ["id"], "last", ["val"])
    assert sorted(map(tuple, last.collect())) == [(1, "A"), (2, "B"), (3, "D")]
    again = R.drop_duplicates(R.drop_duplicates(copies))
    assert again.count() == 4
    with pytest.raises(ValueError):
        R.drop_duplicates(copies, ["id"])
    assert Q.duplicate_rows(copies).count() == 4
    assert Q.duplicate_rows(copies, ["id"]).count() == 5


def test_many_copies_are_listed_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(Q, "COPIES_PER_TASK_ROW", 7)
    df = spark.range(100).select((F.col("id") < 60).alias("hot"), F.when(F.col("id") >= 60, F.col("id")).alias("k"))
    assert Q.duplicate_rows(df).count() == 60


def test_casts(frame):
    df = frame([("100",), ("200.5",), ("300",), ("invalid_val",), (None,), (" 1e3 ",), ("1d",), ("0x1p3",)], "s string")
    number = R.cast_column(df, "s", "Numeric")
    assert column(number, "s") == [100, 200.5, 300, None, None, 1000, None, None]
    report = R.cast_report(df, number, "s").first()
    assert (report["converted"], report["coerced"]) == (4, 3)
    half = frame([(0.5,), (1.5,), (2.5,), (None,)], "x double")
    assert column(R.cast_column(half, "x", "Integer"), "x") == [0, 2, 2, None]
    flags = frame([("Yes",), (" t ",), ("INACTIVE",), ("0.0",), ("perhaps",), (None,)], "b string")
    assert column(R.cast_column(flags, "b", "Boolean"), "b") == [True, True, False, False, None, None]
    dates = frame([("2024-03-15",), ("15 Mar 2024",), ("invalid_date",), (None,), ("3/15/2024",)], "d string")
    day = datetime.datetime(2024, 3, 15)
    assert column(R.cast_column(dates, "d", "Datetime"), "d") == [day, day, None, None, day]
    given = R.cast_column(frame([("15.03.2024",)], "d string"), "d", "Datetime", ["dd.MM.yyyy"])
    assert column(given, "d") == [day]
    with pytest.raises(ValueError):
        R.cast_column(df, "s", "Complex")


def test_filters(frame):
    rows = [(10, "Paris", True), (25, "London", False), (50, "Tokyo", True), (75, "Oslo", None), (100, "Paris", False)]
    df = frame([*rows, (None, None, None), (5, " ", None)], "score int, city string, active boolean")

    def count(*rules):
        return R.filter_rows(df, [dict(zip(("column", "operator", "value", "value_end"), r)) for r in rules]).count()

    assert count(("score", "Greater or Equal (>=)", 50)) == 3
    assert count(("city", "Contains", "o")) == 3
    assert count(("score", "Greater or Equal (>=)", 25), ("city", "Is one of", "Paris, Tokyo")) == 2
    assert count(("score", "Not Equals (!=)", 10)) == 6
    assert count(("score", "Between", 60, 20)) == 2
    assert count(("city", "Is Null / Missing")) == 2
    assert count(("city", "Is Not Null")) == 5
    assert count(("city", "Not Equals", "paris")) == 5
    assert count(("active", "Equals", "TRUE")) == 2
    assert count(("score", "Less Than (<)", "many"), ("nowhere", "Equals", 1), ("score", "About", 1)) == 7


def test_nan_is_missing_in_filters(frame):
    df = frame([(1.0,), (float("nan"),), (None,)], "x double")
    assert R.filter_rows(df, [{"column": "x", "operator": "Greater Than (>)", "value": 0}]).count() == 1
    assert R.filter_rows(df, [{"column": "x", "operator": "Is Null / Missing"}]).count() == 2


def test_sort_puts_missing_last(frame):
    df = frame([(2.0,), (None,), (float("nan"),), (1.0,)], "x double")
    assert column(R.sort_rows(df, ["x"], [False]), "x")[:2] == [2, 1]
    assert column(R.sort_rows(df, ["x"]), "x")[:2] == [1, 2]


@pytest.fixture
def spiky(frame):
    return frame([(x,) for x in (10, 12, 11, 13, 12, 11, 12, 14, 100, -50)], "v int")


def test_outliers(spiky, frame):
    profile = O.outlier_profile(spiky, "v").first()
    assert profile["outliers"] == 2
    assert sorted(column(O.outlier_rows(spiky, "v"), "v")) == [-50, 100]
    assert O.remove_outliers(spiky, "v").count() == 8
    capped = column(O.cap(spiky, "v"), "v")
    assert min(capped) == profile["lower"] and max(capped) == profile["upper"]
    twice = column(O.cap(O.cap(spiky, "v"), "v"), "v")
    assert sorted(twice) == sorted(capped)
    assert sorted(column(O.clip(spiky, "v", 0, None), "v"))[0] == 0
    few = frame([(1.0,), (2.0,), (900.0,)], "v double")
    assert O.remove_outliers(few, "v").count() == 3
    gap = frame([(None,), (1.0,), (2.0,), (3.0,), (90.0,), (2.0,), (2.0,)], "v double")
    assert None in column(O.cap(gap, "v"), "v")
    assert O.remove_outliers(gap, "v").where("v is null").count() == 1


def test_text(frame):
    df = frame([("  HELLO WORLD  ",), ("foo bar",), (None,), ("\t\n",)], "t string")
    assert column(R.clean_text(df, "t", ["trim", "title"]), "t")[:3] == ["Hello World", "Foo Bar", None]
    assert column(R.clean_text(df, "t", ["remove_empty"]), "t")[3] is None
    assert column(R.clean_text(df, "t", ["find_replace"], "o", ".*"), "t")[1] == "f.*.* bar"
    odd = frame([("o'neil foo-bar mixed CASE 3rd",)], "t string")
    assert odd.select(title_case(F.col("t"))).first()[0] == "O'Neil Foo-Bar Mixed Case 3Rd"


def test_dates_and_arithmetic(frame):
    df = frame([("2024-03-15",), ("2024-12-31",), ("no",)], "d string")
    rows = R.date_parts(df, "d", ["year", "month", "day", "day_of_week", "quarter"]).collect()
    assert tuple(rows[0])[1:] == (2024, 3, 15, "Friday", 1)
    assert tuple(rows[2])[1:] == (None,) * 5
    prices = frame([(100.0, 2, 10.0), (50.0, 0, 5.0)], "price double, units int, discount double")
    assert column(R.derive(prices, "n", "price", "multiply", "units"), "n") == [200, 0]
    assert column(R.derive(prices, "n", "discount", "percentage", "price"), "n") == [10, 10]
    assert column(R.derive(prices, "n", "price", "divide", "units"), "n") == [50, None]
    assert column(R.derive(prices, "n", "price", "divide", constant=0), "n") == [None, None]
    for bad in (("price", "price", "add", "units"), (" ", "price", "add", "units"), ("n", "price", "power", "units")):
        with pytest.raises(ValueError):
            R.derive(prices, *bad)
    with pytest.raises(ValueError):
        R.derive(prices, "n", "price", "add")


def test_columns(frame):
    df = frame([(1, 2, 3)], "a int, b int, c int")
    assert R.rename_column(df, "a", " x ").columns == ["x", "b", "c"]
    for old, new in (("z", "y"), ("a", " "), ("a", "b")):
        with pytest.raises(ValueError):
            R.rename_column(df, old, new)
    assert R.drop_columns(df, ["a", "b", "c"]).columns == ["a", "b", "c"]
    assert R.reorder_columns(df, ["c", "q"]).columns == ["c", "a", "b"]


@pytest.mark.parametrize(
    "value, expected", [(0.1, "symmetric"), (1.8, "right_high"), (-2.1, "left_high"), (0.7, "right_mod"), (None, "neutral")]
)
def test_skew_labels(spark, value, expected):
    c = F.lit(value).cast("double")
    assert spark.range(1).select(skew_category(c)).first()[0] == expected


@pytest.mark.parametrize("value, expected", [(1.2, "leptokurtic"), (-0.8, "platykurtic"), (0.2, "mesokurtic")])
def test_tail_labels(spark, value, expected):
    assert spark.range(1).select(kurtosis_category(F.lit(value))).first()[0] == expected


def test_name_rules():
    assert names.is_id("order_id") and not names.is_id("period") and not names.is_id("l_orderkey")
    assert names.is_id_for_typing("zipcode") and not names.is_id("zipcode")
    assert names.is_non_negative("Age") and not names.is_non_negative("average")
    assert names.is_percentage("discount_pct") and not names.is_percentage("growth_rate")
    assert names.is_metric("total_sales") and names.is_category("sub_category")


def test_metadata(frame):
    rows = [("A1", 10.0, True), ("A2", None, False), ("A3", 30.0, True), ("A3", 30.0, True), ("A4", None, False)]
    df = frame(rows, "ID string, Value double, Flag boolean")
    summary = P.table_summary(df).first()
    assert (summary["rows"], summary["missing_cells"], summary["duplicate_rows"]) == (5, 2, 1)
    types = {r["column"]: r["semantic_type"] for r in P.column_types(df).collect()}
    assert types == {"ID": "Text", "Value": "Numeric", "Flag": "Boolean"}


def test_types_of_text(frame):
    rows = [(f"2024-01-{i % 28 + 1:02d}", "yes" if i % 2 else "NO", f"k{i}", "x" if i < 30 else "y", None) for i in range(60)]
    df = frame(rows, "day string, ok string, words string, few string, none string")
    types = {r["column"]: r["semantic_type"] for r in P.column_types(df).collect()}
    assert types == {"day": "Date/Time", "ok": "Boolean", "words": "Text", "few": "Categorical", "none": "Text"}


@pytest.fixture
def dirty(frame):
    rows = [
        (
            f"C{i:03d}", -5 if i == 3 else 20 + i, "US", None, i, i,
            None if i in (1, 5, 9) else (950000.0 if i == 12 else 50000.0 + 100 * i),
            "N/A" if i % 7 == 0 else ("error" if i == 11 else str(i)),
        )
        for i in range(20)
    ]
    rows += [rows[0], rows[4]]
    return frame(
        rows,
        "Customer_ID string, Age int, Country string, Empty_Col double, Duplicate_A int, Duplicate_B int, Income double, Score_Str string",
    )


def test_audit(dirty):
    audit = Q.audit(dirty)
    findings = {(r["column"], r["finding"]) for r in Q.structure(dirty, audit.profile).collect()}
    assert {("Empty_Col", "empty"), ("Country", "constant")} <= findings
    assert [tuple(r) for r in Q.duplicate_columns(dirty).collect()] == [("Duplicate_A", "Duplicate_B")]
    assert audit.duplicates.first()["duplicate_rows"] == 2
    assert {r["column"] for r in Q.audit_outliers(dirty).collect()} >= {"Income"}
    assert {(r["column"], r["severity"]) for r in Q.validity(dirty).collect()} == {("Age", "HIGH")}
    assert {r["column"] for r in Q.mixed_types(dirty, ["Customer_ID"]).collect()} == {"Score_Str"}
    issues = audit.issues().collect()
    assert issues[0]["severity"] == "CRITICAL" and issues[0]["rank"] == 1
    scores = {r["column"]: r for r in audit.column_scores().collect()}
    assert scores["Empty_Col"]["quality_score"] == 20.0 and scores["Empty_Col"]["main_issue"] == "100.0% missing values"
    assert scores["Duplicate_B"]["quality_score"] == 75.0 and scores["Duplicate_A"]["main_issue"] == "Clean"
    assert scores["Score_Str"]["main_issue"] == "Mixed data types"
    assert 0 <= audit.report().first()["score"] <= 100


def test_infinities(frame):
    df = frame([(float("inf"), 150.0), (1.0, 50.0), (2.0, -1.0)], "x double, tax_rate double")
    found = {(r["column"], r["issue"], r["count"]) for r in Q.validity(df).collect()}
    assert found == {("x", "Infinite Numeric Values", 1), ("tax_rate", "Out-of-Bounds Percentage", 2)}
    assert column(D.apply_repair(df, Repair("clean_invalid", "x")), "x") == [None, 1, 2]
    assert column(D.apply_repair(df, Repair("clean_invalid", "tax_rate")), "tax_rate") == [100, 50, 0]
    assert D.apply_repair(df, Repair("drop_invalid_rows", "tax_rate")).count() == 1


def test_decisions(dirty):
    plan = {(r["type"], r["column"]): r for r in D.decision_plan(dirty).collect()}
    assert plan[("empty", "Empty_Col")]["action"] == "drop_cols"
    assert plan[("missing", "Income")]["action"] == "median"
    assert plan[("missing", "Income")]["severity"] == "HIGH"
    assert plan[("outliers", "Income")]["action"] == "retain_outliers"
    assert (plan[("outliers", "Age")]["low"], plan[("outliers", "Age")]["high"]) == (0.0, 100.0)
    assert plan[("validity", "Age")]["action"] == "clip_non_negative"
    assert plan[("consistency", "Score_Str")]["action"] == "cast_numeric_clean"
    assert plan[("duplicates", Q.WHOLE_TABLE)]["affected"] == 2


def test_repairs(dirty):
    assert D.apply_repair(dirty, Repair("retain_outliers", "Income")) is dirty
    assert D.apply_repair(dirty, Repair("remove_exact")).count() == 20
    capped = D.apply_repair(dirty, Repair("cap_bounds", "Age", 0, 100))
    assert capped.agg(F.min("Age")).first()[0] == 0
    assert "Empty_Col" not in D.apply_repair(dirty, Repair("drop_cols", "Empty_Col")).columns
    with pytest.raises(ValueError):
        D.apply_repair(dirty, Repair("median", "Nowhere"))
    with pytest.raises(ValueError):
        D.apply_repair(dirty, Repair("cap_bounds", "Country"))
    check = D.verify(dirty, Repair("remove_exact")).first()
    assert check["improved"] and not check["rows_warning"]


def test_verify_warns_about_lost_spread(frame):
    df = frame([(float(i),) if i < 4 else (None,) for i in range(40)], "x double")
    assert D.verify(df, Repair("mean", "x")).first()["spread_warning"]


def test_summary_edge_cases(frame):
    rows = [(float(2**i), 7, None, "a") for i in range(9)] + [(None, 7, None, "b")]
    df = frame(rows, "num_skewed double, constant_col int, all_nulls double, dup_col string")
    got = {r["column"]: r for r in A.summary(df).collect()}
    assert got["constant_col"]["skewness"] == 0 and got["constant_col"]["std"] == 0
    assert got["all_nulls"]["mean"] is None and got["all_nulls"]["missing_pct"] == 100
    assert got["num_skewed"]["count"] == 9 and got["num_skewed"]["skewness"] > 1
    assert A.correlations(df).count() == 0
    one = frame([(3.0,)], "x double")
    assert A.summary(one).first()["std"] == 0


def test_names_with_spaces_and_quotes(frame):
    df = frame([(1.0, "a"), (2.0, "b"), (None, "b")], "`Customer ID's` double, `the.kind` string")
    types = {r["column"]: r["non_null"] for r in P.column_types(df).collect()}
    assert types == {"Customer ID's": 2, "the.kind": 3}
    assert A.summary(df).first()["mean"] == 1.5
    assert Q.Audit(df, share=False).breakdown().first()["score"] <= 100
    assert R.fill_missing(df, ["Customer ID's"], "median").where("`Customer ID's` is null").count() == 0


def test_pipeline(gaps):
    plan = (
        Preparation(gaps)
        .then(Step("missing", "unknown", lambda d: R.fill_missing(d, ["cat"], "unknown"), "cat", "unknown"))
        .then(Step("columns", "drop", lambda d: R.drop_columns(d, ["num"]), "num", "drop_cols"))
    )
    log = plan.log(scores=True).orderBy("step").collect()
    assert [r["columns_after"] for r in log] == [4, 3]
    assert log[0]["score_delta"] > 0
    assert plan.undo().result().columns == gaps.columns


@pytest.mark.parametrize("schema", ["category string, label string", "val double, category string"])
def test_no_or_one_numeric_column(frame, schema):
    """Nothing to correlate or to summarise gives empty tables, not errors."""
    from tablewright.operators import charts as C, dashboard as B, questions as K

    rows = [("a", "x")] * 5 if "label" in schema else [(1.0, "x"), (2.0, "x"), (3.0, "y"), (4.0, None), (5.0, "y")]
    df = frame(rows, schema)
    one = 0 if "label" in schema else 1
    for pairs in (A.correlations(df), A.correlations(df, method="spearman"), C.heatmap(df), K.correlation_answer(df), C.radar(df)):
        assert pairs.collect() == []
    assert A.summary(df).count() == A.outlier_summary(df).count() == P.describe_numeric(df).count() == one
    assert K.outlier_answer(df).collect() == []
    assert P.describe_categorical(df.select(df.columns[0])).count() == 1 - one
    assert P.describe_dates(df).collect() == []
    assert B.segment_bars(frame([(1.0,)], "v double")).collect() == []
    assert A.findings(df).count() >= 1


def test_infinity_is_no_spread(frame):
    df = frame([(float(i), float(i * i), float("inf") if i == 3 else float(i)) for i in range(40)], "a double, b double, c double")
    assert [(r["var1"], r["var2"]) for r in A.strongest_pairs(A.correlations(df)).collect()] == [("a", "b")]
    shape = {r["column"]: r["skew_label"] for r in A.shape_labels(A.summary(df)).collect()}
    assert shape["c"] == "Undefined"
    assert not any("c" == r["subject"] for r in A.findings(df).collect() if r["category"] == "Distribution")


def test_group_column_with_a_reserved_name(frame):
    from tablewright.operators import charts as C

    df = frame([(1, 1.0), (1, 3.0), (2, 5.0)], "value int, x double")
    assert {r["value"]: r["metric"] for r in C.aggregate(df, "value", "x", "Median").collect()} == {1: 2.0, 2: 5.0}
    assert {r["value"]: r["median"] for r in C.box(df, "x", "value").collect()} == {1: 2.0, 2: 5.0}
    assert {(r["value_group"], r["value"]) for r in C.ecdf(df, "x", "value").collect()} == {(1, 1.0), (1, 3.0), (2, 5.0)}
    for name in ("column", "n", "total", "start", "size"):
        got = C.box(df.withColumnRenamed("value", name), "x", name) if name not in ("n",) else C.aggregate(df.withColumnRenamed("value", name), name, "x", "Median")
        assert got.count() == 2


def test_first_and_last_rows_of_odd_keys(frame):
    """NULL keys and orders, NaN, infinite values, ties of the first order column and texts with equal beginnings."""
    rows = [
        (None, None, "a", 1), (None, 2.0, "b", 2), ("k", float("nan"), "c", 3), ("k", float("inf"), "d", 4), ("k", float("-inf"), "e", 5),
        ("m", 0.0, "longer text 1", 6), ("m", -0.0, "longer text 0", 7), ("n", 1.0, None, 8), ("n", 1.0, "", 9),
    ]
    df = frame(rows, "k string, o double, t string, i int")
    first = {r["k"]: r["i"] for r in R.drop_duplicates(df, ["k"], "first", ["o", "t"]).collect()}
    assert first == {None: 1, "k": 3, "m": 7, "n": 8}  # NaN counts as missing, which comes first
    last = {r["k"]: r["i"] for r in R.drop_duplicates(df, ["k"], "last", ["o", "t"]).collect()}
    assert last == {None: 2, "k": 4, "m": 6, "n": 9}
    by_text = {r["k"]: r["i"] for r in R.drop_duplicates(df, ["k"], "first", ["t"]).collect()}
    assert by_text == {None: 1, "k": 3, "m": 7, "n": 8}
    assert R.drop_duplicates(df.limit(0), ["k"], "first", ["o"]).count() == 0


def test_copies_of_rows_with_nan(frame):
    df = frame([(1, float("nan")), (1, None), (2, 1.0), (None, None), (None, None)], "a int, b double")
    assert sorted(map(tuple, R.drop_duplicates(df).collect()), key=str) == [(1, None), (2, 1.0), (None, None)]
    assert Q.duplicate_rows(df).count() == 4
