"""Random small tables with missing values against pandas."""

import numpy as np
import pandas as pd
import pytest

from tablewright.operators import investigation as I, preparation as R, statistics as A


def random_table(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(20, 120))
    pdf = pd.DataFrame(
        {
            "a": rng.normal(50, 20, n).round(2),
            "b": rng.integers(0, 6, n).astype(float),
            "c": np.exp(rng.normal(0, 1.5, n)).round(3),
        }
    )
    pdf["d"] = (pdf["a"] * 2 + rng.normal(0, 5, n)).round(2)
    for c in pdf:
        pdf.loc[rng.random(n) < 0.1, c] = np.nan
    pdf.insert(0, "id", range(n))
    return pdf


@pytest.fixture(params=range(4))
def table(spark, request):
    pdf = random_table(request.param)
    return pdf, spark.createDataFrame(pdf)


COLUMNS = ["a", "b", "c", "d"]


def test_summary(table):
    pdf, df = table
    got = A.summary(df, COLUMNS).toPandas().set_index("column")
    for c in COLUMNS:
        s = pdf[c]
        expected = {
            "count": s.count(), "mean": s.mean(), "median": s.median(), "std": s.std(), "min": s.min(), "max": s.max(),
            "q1": s.quantile(0.25), "q3": s.quantile(0.75), "skewness": s.skew(), "kurtosis": s.kurtosis(),
            "missing_pct": s.isna().mean() * 100,
        }
        for k, v in expected.items():
            assert got.loc[c, k] == pytest.approx(v), (c, k)


@pytest.mark.parametrize("method", ["pearson", "spearman"])
def test_correlations(table, method):
    pdf, df = table
    for r in A.correlations(df, COLUMNS, method).collect():
        both = pdf[[r["var1"], r["var2"]]].dropna()
        x, y = both.iloc[:, 0], both.iloc[:, 1]
        expected = x.corr(y) if method == "pearson" else x.rank().corr(y.rank())
        assert r["r"] == pytest.approx(expected)


def test_outliers(table):
    pdf, df = table
    for r in A.outlier_summary(df, COLUMNS).collect():
        s = pdf[r["column"]].dropna()
        q1, q3 = s.quantile(0.25), s.quantile(0.75)
        low, high = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
        assert r["outlier_count"] == ((s < low) | (s > high)).sum()
        assert (r["lower"], r["upper"]) == (pytest.approx(low), pytest.approx(high))


@pytest.mark.parametrize("strategy", ["mean", "median", "mode", "zero", "ffill", "bfill"])
def test_fills(table, strategy):
    pdf, df = table
    got = R.fill_missing(df, ["a", "b"], strategy, order_by="id").toPandas().sort_values("id")
    for c in ("a", "b"):
        s = pdf[c]
        expected = {
            "mean": lambda: s.fillna(s.mean()), "median": lambda: s.fillna(s.median()),
            "mode": lambda: s.fillna(s.mode().iloc[0]), "zero": lambda: s.fillna(0),
            "ffill": s.ffill, "bfill": s.bfill,
        }[strategy]()
        np.testing.assert_allclose(got[c].to_numpy(), expected.to_numpy())


def test_bins(table):
    pdf, df = table
    got = I.by_bins(df, "a", "c").orderBy("bin").collect()
    kept = pdf.dropna(subset=["c"])
    cut = pd.cut(kept["c"], bins=min(10, max(2, kept["c"].nunique())), labels=False)
    expected = kept.groupby(cut)["a"].agg(["mean", "count"]).reindex(range(len(got)))
    for i, r in enumerate(got):
        assert r["count"] == (expected["count"].iloc[i] if expected["count"].iloc[i] == expected["count"].iloc[i] else 0)
        if r["count"]:
            assert r["mean"] == pytest.approx(round(expected["mean"].iloc[i], 2), abs=0.011)


@pytest.mark.parametrize("method", ["pearson", "spearman"])
@pytest.mark.parametrize("wide", [250, 6])
def test_many_columns_with_gaps(spark, monkeypatch, method, wide):
    """Every pair agrees with pandas, in one block of columns and in several; a constant column has no pair."""
    from tablewright.operators import correlation

    monkeypatch.setattr(correlation, "WIDE", wide)
    draw = np.random.default_rng(2)
    data = pd.DataFrame({f"c{i}": np.round(draw.normal(10.0 ** (i % 5), 3, 400), 1) for i in range(9)})
    data["c3"] = data["c2"] * -2 + draw.normal(0, 1, 400)
    for i in (1, 4, 5):
        data.loc[draw.random(400) < 0.3, f"c{i}"] = np.nan
    data["still"] = 7.25
    got = {(r["var1"], r["var2"]): (r["r"], r["n"]) for r in A.correlations(spark.createDataFrame(data), None, method).collect()}
    assert len(got) == 9 * 8 // 2
    for (a, b), (r, n) in got.items():
        both = data[[a, b]].dropna()
        x, y = (both[a], both[b]) if method == "pearson" else (both[a].rank(), both[b].rank())
        assert n == len(both) and r == pytest.approx(x.corr(y), abs=1e-9)
