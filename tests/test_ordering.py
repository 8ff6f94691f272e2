"""Order statistics and fills on skewed data, in one range and in many, against pandas."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablewright.operators import charts, fills, ordering, statistics


@pytest.fixture(params=["small", "ranged"])
def path(request, monkeypatch):
    if request.param == "ranged":
        monkeypatch.setattr(ordering, "PER_RANGE", 50)
        monkeypatch.setattr(ordering, "SAMPLED", 4)
        monkeypatch.setattr(fills, "PER_RANGE", 50)
    return request.param


def skewed(n=3000, seed=7):
    """One value and one group hold more than a third of all rows; some cells are missing or NaN."""
    rng = np.random.default_rng(seed)
    x = np.where(rng.random(n) < 0.4, 5.0, np.exp(rng.normal(0, 3, n)).round(3))
    y = x * 0.5 + rng.normal(0, 10, n).round(1)
    g = np.where(rng.random(n) < 0.5, "hot", rng.choice(list("abcdefgh"), n))
    pdf = pd.DataFrame({"id": rng.permutation(n), "g": g, "x": x, "y": y})
    pdf.loc[rng.random(n) < 0.15, "x"] = np.nan
    pdf.loc[rng.random(n) < 0.05, "g"] = None
    return pdf


@pytest.fixture(scope="module")
def data(spark):
    pdf = skewed()
    rows = [
        (int(r.id), r.g if isinstance(r.g, str) else None, float(r.x) if i % 2 or r.x == r.x else None, float(r.y))
        for i, r in enumerate(pdf.itertuples())
    ]
    return pdf, spark.createDataFrame(rows, "id long, g string, x double, y double").repartition(5)


def test_quantiles(path, data):
    pdf, df = data
    probs = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]
    got = {r["column"]: r for r in ordering.exact_quantiles(df, ["x", "y"], probs).collect()}
    for c in ("x", "y"):
        assert got[c]["total"] == pdf[c].count()
        assert got[c]["quantiles"] == pytest.approx(list(pdf[c].quantile(probs)))


def test_grouped_quantiles(path, data):
    pdf, df = data
    got = {r["g"]: r for r in ordering.exact_quantiles(df, ["x"], [0.1, 0.5], ["g"]).collect()}
    expected = pdf.dropna(subset=["g", "x"]).groupby("g")["x"]
    assert set(got) == set(expected.groups)
    for g, values in expected:
        assert got[g]["quantiles"] == pytest.approx(list(values.quantile([0.1, 0.5])))


def test_spread(path, data):
    pdf, df = data
    row = ordering.spread(df, ["x"]).first()
    x = pdf["x"].dropna()
    q1, q3 = x.quantile(0.25), x.quantile(0.75)
    low, high = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
    outside = (x < low) | (x > high)
    assert row["outliers"] == outside.sum()
    assert (row["min"], row["max"]) == (x.min(), x.max())
    assert (row["inside_low"], row["inside_high"]) == (x[~outside].min(), x[~outside].max())


def test_positions_and_ranks(path, data):
    pdf, df = data
    x = pdf["x"].dropna()
    got = {r["value"]: r for r in ordering.value_positions(df, ["x"]).collect()}
    assert len(got) == x.nunique()
    ranks = dict(zip(x, x.rank()))
    for v, r in got.items():
        assert r["below"] == (x < v).sum() and r["n"] == (x == v).sum() and r["total"] == len(x)
        assert r["below"] + (r["n"] + 1) / 2 == ranks[v]


def test_spearman_with_gaps(path, data):
    pdf, df = data
    got = statistics.correlations(df, ["x", "y"], "spearman").first()
    both = pdf[["x", "y"]].dropna()
    assert got["r"] == pytest.approx(both["x"].rank().corr(both["y"].rank()))
    assert got["n"] == len(both)


@pytest.mark.parametrize("narrow", [90, 0])
def test_spearman_of_few_columns_and_of_many(spark, monkeypatch, path, narrow):
    """Both ways back to the rows: repeated rows, a hot value, columns that miss values together, one without any."""
    from tablewright.operators import correlation

    monkeypatch.setattr(correlation, "NARROW", narrow)
    draw = np.random.default_rng(8)
    pdf = pd.DataFrame({"a": draw.normal(size=900), "b.c": np.where(draw.random(900) < 0.5, 3.0, draw.random(900)), "d": draw.integers(0, 5, 900) * 1.0})
    pdf["e"] = pdf["a"].round(1) + pdf["d"]
    pdf.loc[draw.random(900) < 0.3, ["a"]] = np.nan
    pdf.loc[pdf["d"] == 2, ["e"]] = np.nan
    pdf["none"] = np.nan
    pdf = pd.concat([pdf, pdf[:50]])
    df = spark.createDataFrame(pdf)
    pairs = statistics.correlations(df, method="spearman")
    got = {(r["var1"], r["var2"]): (r["r"], r["n"]) for r in pairs.collect()}
    assert len(got) == 6
    for (x, y), (r, n) in got.items():
        both = pdf[[x, y]].dropna()
        assert n == len(both) and r == pytest.approx(both[x].rank().corr(both[y].rank()), abs=1e-9)
    # Few columns: no row is taken apart and put together again.
    text = pairs._jdf.queryExecution().executedPlan().toString()
    assert ("collect_list" in text) == (narrow == 0)
    assert statistics.correlations(df.where("false"), method="spearman").collect() == []


def test_ecdf(path, data):
    pdf, df = data
    got = {(r["g"], r["value"]): r["fraction"] for r in charts.ecdf(df, "x", "g").collect()}
    kept = pdf.dropna(subset=["g", "x"])
    for g, part in kept.groupby("g"):
        for v in part["x"].unique()[:20]:
            assert got[(g, v)] == pytest.approx((part["x"] <= v).mean())


@pytest.mark.parametrize("backward", [False, True])
@pytest.mark.parametrize("by", [None, ["g"]])
def test_fill(path, data, by, backward):
    pdf, df = data
    got = fills.directional_fill(df, ["x"], "id", by, backward).toPandas().set_index("id")["x"].sort_index()
    ordered = pdf.sort_values("id").set_index("id")
    column = ordered["x"] if by is None else ordered.assign(g=ordered["g"].fillna("-")).groupby("g")["x"]
    expected = column.bfill() if backward else column.ffill()
    pd.testing.assert_series_equal(got, expected.sort_index(), check_names=False)


def test_fill_by_time(spark, monkeypatch):
    monkeypatch.setattr(fills, "PER_RANGE", 50)
    monkeypatch.setattr(ordering, "SAMPLED", 2)
    df = spark.range(500).select(
        F.col("id"),
        F.expr("timestamp_ntz'2024-03-30 20:00:00' + make_dt_interval(0, 0, cast(id as int) * 7, 0.5)").alias("at"),
        F.when(F.col("id") % 9 == 0, F.col("id") * 1.0).alias("v"),
    )
    got = fills.directional_fill(df, ["v"], "at").orderBy("id").collect()
    assert [r["v"] for r in got] == [float(i - i % 9) for i in range(500)]


def test_top_values_ties(frame):
    df = frame([("b",), ("a",), ("b",), ("a",), (None,)], "v string")
    row = ordering.top_values(df, ["v"]).first()
    assert (row["distinct"], row["top_value"], row["top_count"]) == (2, "a", 2)


def test_infinite_values_are_ordered(path, frame):
    inf = float("inf")
    df = frame([(x,) for x in (-inf, 1.0, 2.0, 3.0, inf)], "v double")
    assert ordering.exact_quantiles(df, ["v"], [0.0, 0.5, 1.0]).first()["quantiles"] == [-inf, 2.0, inf]
