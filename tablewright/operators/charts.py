"""The table behind each chart. Nothing is drawn."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.missing import name_col, number, numeric_columns, present, quoted
from ..functions.stats import percent
from ..functions.text import fixed
from .ordering import _nothing, column_fences, exact_quantiles, spread, value_counts, value_positions
from .profile import column_types
from .statistics import correlations, full_matrix

AGGREGATES = {
    "Sum": F.sum,
    "Mean": F.avg,
    "Count": F.count,
    "Minimum": F.min,
    "Maximum": F.max,
    "Standard Deviation": F.stddev_samp,
}
SORTS = ("value_desc", "value_asc", "alpha_asc", "alpha_desc", "default")


def aggregate(
    df: DataFrame,
    by: str | None = None,
    metric: str | None = None,
    agg: str = "Sum",
    colour: str | None = None,
    sort: str = "default",
    top_n: int | None = 15,
) -> DataFrame:
    """(by, colour, metric): one aggregate of one column by up to two keys.

    Rows with a missing key or metric do not take part. Without a metric column, rows are counted.
    """
    keys = [k for k in dict.fromkeys((by, colour)) if k]
    if metric is None or agg == "Count":
        out = present(df, keys).groupBy(*[name_col(k) for k in keys]).agg(F.count(F.lit(1)).alias("metric"))
    else:
        out = _grouped(df, keys, metric, agg)
    if by is None:
        return out
    limited = _limited(out, by, colour, sort, top_n)
    return limited.orderBy(*_row_order(by, colour, sort))


def _grouped(df: DataFrame, keys: list[str], metric: str, agg: str) -> DataFrame:
    rows = present(df, [*keys, metric])
    if agg == "Median":
        apart, own = _apart(rows, keys)
        q = exact_quantiles(apart, [metric], [0.5], list(own))
        return q.select(*[F.col(x).alias(k) for x, k in own.items()], F.col("quantiles")[0].alias("metric"))
    v = number(df, metric)
    rows = rows.where(v.isNotNull())
    return rows.groupBy(*[name_col(k) for k in keys]).agg(AGGREGATES[agg](v).alias("metric"))


def _apart(df: DataFrame, keys: list[str]) -> tuple[DataFrame, dict[str, str]]:
    """The rows with further columns that hold the keys under names of their own, and what those stand for."""
    own = {f"__key{i}": k for i, k in enumerate(keys)}
    return (df.withColumns({x: name_col(k) for x, k in own.items()}) if own else df), own


def _row_order(by: str, colour: str | None, sort: str) -> list[Column]:
    ties = [name_col(by).asc(), *([name_col(colour).asc()] if colour and colour != by else [])]
    first = {
        "value_desc": [F.col("metric").desc()],
        "value_asc": [F.col("metric").asc()],
        "alpha_desc": [name_col(by).desc()],
    }.get(sort, [])
    return [*first, *ties]


def _limited(out: DataFrame, by: str, colour: str | None, sort: str, top_n: int | None) -> DataFrame:
    """Keep the first ``top_n`` dimension values; each keeps all its colour rows.

    A dimension ranks by its best single row, not by its total.
    """
    if not top_n:
        return out
    if not colour or colour == by:
        return out.orderBy(*_row_order(by, None, sort)).limit(top_n)
    best = F.min("metric") if sort == "value_asc" else F.max("metric")
    kept = out.groupBy(name_col(by)).agg(best.alias("metric")).orderBy(*_row_order(by, None, sort)).limit(top_n)
    return out.join(kept.select(name_col(by)), by, "left_semi")


# --- comparison and trend charts -----------------------------------------------------------------------------


def bar(df, by, metric=None, agg="Sum", colour=None, sort="value_desc", top_n=15) -> DataFrame:
    return aggregate(df, by, metric, agg, colour, sort, top_n)


def horizontal_bar(df, by, metric=None, agg="Sum", colour=None, sort="value_asc", top_n=15) -> DataFrame:
    return aggregate(df, by, metric, agg, colour, sort, top_n)


def lollipop(df, by, metric=None, agg="Sum", sort="value_desc", top_n=15) -> DataFrame:
    return aggregate(df, by, metric, agg, None, sort, top_n)


def grouped_bar(df, by, colour, metric=None, agg="Sum", sort="value_desc", top_n=12) -> DataFrame:
    return aggregate(df, by, metric, agg, colour, sort, top_n)


def waterfall(df, by, metric=None, agg="Sum", top_n=10) -> DataFrame:
    """(step, label, metric, base, total): steps in key order, then a net total row.

    The running sum is over at most ``top_n`` rows.
    """
    steps = aggregate(df, by, metric, agg, None, "default", top_n)
    steps = steps.select(name_col(by).cast("string").alias("label"), name_col(by).alias("key"), F.col("metric").cast("double"))
    running = Window.orderBy("key").rowsBetween(Window.unboundedPreceding, 0)
    placed = steps.withColumns(
        {"step": F.row_number().over(Window.orderBy("key")), "running": F.sum("metric").over(running)}
    )
    rows = placed.select(
        F.lit("step").alias("kind"), "step", "label", "metric", (F.col("running") - F.col("metric")).alias("base"), "running"
    )
    net = steps.agg(F.sum("metric").alias("running"), F.count(F.lit(1)).alias("steps")).select(
        F.lit("total").alias("kind"),
        (F.col("steps") + 1).cast("int").alias("step"),
        F.lit("Net Total").alias("label"),
        F.lit(0.0).alias("metric"),
        F.lit(0.0).alias("base"),
        "running",
    )
    return rows.unionByName(net)


def radar(
    df: DataFrame, metrics: list[str] | None = None, by: str | None = None, agg: str = "Mean", n: int | None = None
) -> DataFrame:
    """One row per profile with one column per metric: overall, or for the four most frequent categories.

    The default metrics are all columns that mean numbers, or the first ``n`` of them. With fewer than three metrics
    all stored numbers are taken instead; a table with fewer than three has no radar, an empty table.
    """
    metrics = _default_metrics(df, metrics, n)
    if len(metrics) < 3:  # too few of those asked for
        metrics = numeric_columns(df)[:n]
    if len(metrics) < 3:
        return _nothing(df, [by] if by else [], ", ".join(f"{quoted(m)} double" for m in metrics) or "metric double")
    if by is None:
        return _metric_row(df, [], metrics, agg)
    top = value_counts(df, by).orderBy(F.col("n").desc(), F.col("value")).limit(4)
    rows = df.join(top.select(F.col("value").alias(by)), by, "left_semi")
    return _metric_row(rows, [by], metrics, agg)


def _default_metrics(df: DataFrame, metrics: list[str] | None, n: int | None = None) -> list[str]:
    """The asked columns that are numbers, else the columns that mean numbers (no IDs, no 0/1 flags): one small job."""
    stored = numeric_columns(df)
    if metrics:
        return [m for m in metrics if m in stored]
    if not stored:
        return []
    typed = column_types(df.select(*[name_col(c) for c in stored])).where(F.col("semantic_type") == "Numeric")
    return [r["column"] for r in typed.orderBy("position").select("column").collect()][:n]


def _metric_row(df: DataFrame, keys: list[str], metrics: list[str], agg: str) -> DataFrame:
    k = [name_col(x) for x in keys]
    if agg == "Median":
        apart, own = _apart(df, keys)
        q = exact_quantiles(apart, metrics, [0.5], list(own)).select(*own, "column", F.col("quantiles")[0].alias("m"))
        wide = q.groupBy(*own).pivot("column", metrics).agg(F.first("m"))
        return wide.select(*[F.col(x).alias(c) for x, c in own.items()], *[name_col(m) for m in metrics])
    make = AGGREGATES[agg]
    return df.groupBy(*k).agg(*[make(number(df, m)).alias(m) for m in metrics])


def line(df, by, metric=None, agg="Sum", colour=None) -> DataFrame:
    """Every x in order; also the table of area and step charts."""
    return aggregate(df, by, metric, agg, colour, "alpha_asc", None)


area = step = line


def multi_line(
    df: DataFrame, by: str, metrics: list[str] | None = None, agg: str = "Sum", n: int | None = None
) -> DataFrame:
    """Metrics by x: those asked for, else all columns that mean numbers or the first ``n`` of them."""
    rows = present(df, [by])
    chosen = _default_metrics(df, metrics, n)
    return _metric_row(rows, [by], chosen, agg).orderBy(name_col(by)) if chosen else _nothing(df, [by], "metric double")


# --- relationships -------------------------------------------------------------------------------------------


def points(
    df: DataFrame, axes: list[str], colour: str | None = None, size: str | None = None
) -> DataFrame:
    """Complete rows for scatter, bubble and 3-D scatter charts. A size is at least 0.1; text counts as 1."""
    needed = list(dict.fromkeys([*axes, *([colour] if colour else []), *([size] if size else [])]))
    rows = present(df.select(*[name_col(c) for c in needed]), needed)
    for a in axes:
        rows = rows.where(number(rows, a).isNotNull())
    out = rows.withColumns({a: number(rows, a) for a in axes})
    if size:
        out = out.withColumn(size, F.greatest(F.coalesce(number(rows, size), F.lit(1.0)), F.lit(0.1)))
    return out


def trend_line(df: DataFrame, x: str, y: str, colour: str | None = None) -> DataFrame:
    """(colour, slope, intercept, r2, n): least squares per colour group of at least three points."""
    p = points(df, [x, y], colour)
    keys = [name_col(colour)] if colour else []
    a, b = name_col(x), name_col(y)
    fitted = p.groupBy(*keys).agg(
        F.regr_slope(b, a).alias("slope"),
        F.regr_intercept(b, a).alias("intercept"),
        F.regr_r2(b, a).alias("r2"),
        F.count(F.lit(1)).alias("n"),
    )
    return fitted.where(F.col("n") >= 3)


def first_points(
    df: DataFrame, x: str, y: str, order_by: list[str], colour: str | None = None, n: int | None = None
) -> DataFrame:
    """All complete rows of a dashboard scatter, or the first ``n`` in order."""
    needed = list(dict.fromkeys([*order_by, x, y, *([colour] if colour else [])]))
    rows = present(df.select(*[name_col(c) for c in needed]), [x, y, *([colour] if colour else [])])
    return rows if n is None else rows.orderBy(*[name_col(o) for o in order_by]).limit(n)


def _limits(df: DataFrame, columns: list[str]) -> dict[str, Column]:
    """Per column a struct (lo, hi, n) as a scalar subquery; one pass for all."""
    entries = []
    for i, c in enumerate(columns):
        v = number(df, c)
        entries.append(F.struct(F.min(v).alias("lo"), F.max(v).alias("hi"), F.count(v).alias("n")).alias(f"c{i}"))
    s = df.agg(F.struct(*entries).alias("s")).scalar()
    return {c: s[f"c{i}"] for i, c in enumerate(columns)}


def _bin(v: Column, limits: Column, bins: int) -> Column:
    """Equal-width bin 0..bins-1; the maximum belongs to the last one."""
    width = (limits["hi"] - limits["lo"]) / bins
    return F.least(F.floor(F.try_divide(v - limits["lo"], width)), F.lit(bins - 1)).cast("int")


def _edges(index: Column, limits: Column, bins: int) -> tuple[Column, Column]:
    width = (limits["hi"] - limits["lo"]) / bins
    return limits["lo"] + width * index, limits["lo"] + width * (index + 1)


def density(df: DataFrame, x: str, y: str, bins: int = 20, colour: str | None = None) -> DataFrame:
    """(colour, x_bin, y_bin, n): counts on an equal-width grid, occupied cells only."""
    p = points(df, [x, y], colour)
    limits = _limits(p, [x, y])
    keys = [name_col(colour)] if colour else []
    cell = [_bin(name_col(c), limits[c], bins) for c in (x, y)]
    zero = F.lit(0)
    return p.groupBy(
        *keys, F.coalesce(cell[0], zero).alias("x_bin"), F.coalesce(cell[1], zero).alias("y_bin")
    ).agg(F.count(F.lit(1)).alias("n"))


def histogram(df: DataFrame, x: str, bins: int = 30, colour: str | None = None) -> DataFrame:
    """(colour, bin, lo, hi, n). Without a colour empty bins are listed too."""
    rows = points(df, [x], colour)
    limits = _limits(rows, [x])[x]
    keys = [name_col(colour)] if colour else []
    index = F.coalesce(_bin(name_col(x), limits, bins), F.lit(0))
    counted = rows.groupBy(*keys, index.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    if not colour:
        every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
        counted = every.join(counted, "bin", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    lo, hi = _edges(F.col("bin"), limits, bins)
    return counted.select(*keys, "bin", lo.alias("lo"), hi.alias("hi"), "n")


def marginals(df: DataFrame, x: str, y: str, bins: int = 20) -> DataFrame:
    """(axis, bin, lo, hi, n): the two histograms beside a density chart."""
    p = points(df, [x, y])
    sides = [histogram(p, c, bins).select(F.lit(axis).alias("axis"), "*") for axis, c in (("x", x), ("y", y))]
    return sides[0].unionByName(sides[1])


# --- distributions -------------------------------------------------------------------------------------------


def _groups(by: str | None, colour: str | None) -> list[str]:
    return [k for k in dict.fromkeys((by, colour)) if k]


def box(df: DataFrame, metric: str, by: str | None = None, colour: str | None = None) -> DataFrame:
    """Quartiles, fences, whisker ends and outlier count per group."""
    keys = _groups(by, colour)
    rows, own = _apart(_box_rows(df, metric, keys), keys)
    return spread(rows, [metric], list(own)).select(
        *[F.col(x).alias(k) for x, k in own.items()],
        F.col("total").alias("n"),
        "q1",
        "median",
        "q3",
        "lower",
        "upper",
        F.col("inside_low").alias("whisker_low"),
        F.col("inside_high").alias("whisker_high"),
        "outliers",
    )


def _box_rows(df: DataFrame, metric: str, keys: list[str]) -> DataFrame:
    rows = present(df.select(*[name_col(c) for c in dict.fromkeys([*keys, metric])]), [*keys, metric])
    return rows.where(number(rows, metric).isNotNull()).withColumn(metric, number(rows, metric))


def box_outliers(df: DataFrame, metric: str, by: str | None = None, colour: str | None = None) -> DataFrame:
    """The outlier points of a box chart. One group uses a scalar, several an equi-join on the keys."""
    keys = _groups(by, colour)
    rows = _box_rows(df, metric, keys)
    apart, own = _apart(rows, keys)
    f = column_fences(apart, [metric], list(own))
    if keys:
        placed = apart.join(f.select(*own, F.col("lower").alias("__lower"), F.col("upper").alias("__upper")), list(own))
    else:
        s = f.select(F.struct("lower", "upper").alias("s")).scalar()
        placed = rows.withColumns({"__lower": s["lower"], "__upper": s["upper"]})
    v = name_col(metric)
    return placed.where((v < F.col("__lower")) | (v > F.col("__upper"))).select(*[name_col(c) for c in rows.columns])


def violin(
    df: DataFrame, metric: str, by: str | None = None, bins: int = 64, grid: int = 50
) -> DataFrame:
    """(by, point, x, density): Gaussian kernel density of binned values on an equal grid.

    Values are binned once; the kernel then works on groups x bins rows. The bandwidth is
    1.06 * std * n^(-1/5) of the group.
    """
    keys = [by] if by else []
    k = [name_col(x) for x in keys]
    rows = _box_rows(df, metric, keys)
    limits = _limits(rows, [metric])[metric]
    v = name_col(metric)
    index = F.coalesce(_bin(v, limits, bins), F.lit(0))
    binned = rows.groupBy(*k, index.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    spread = rows.groupBy(*k).agg(F.stddev_samp(v).alias("std"), F.count(F.lit(1)).alias("total"))
    if keys:
        joined = binned.join(spread, keys)
    else:
        s = spread.select(F.struct("std", "total").alias("s")).scalar()
        joined = binned.withColumns({"std": s["std"], "total": s["total"]})
    width = (limits["hi"] - limits["lo"]) / bins
    centre = limits["lo"] + width * (F.col("bin") + 0.5)
    bandwidth = F.lit(1.06) * F.col("std") * F.pow(F.col("total").cast("double"), F.lit(-0.2))
    spaced = joined.where(F.col("std") > 0).withColumns({"centre": centre, "h": bandwidth})
    gridded = spaced.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(grid - 1))))
    x = limits["lo"] + (limits["hi"] - limits["lo"]) * F.col("point") / (grid - 1)
    z = (x - F.col("centre")) / F.col("h")
    weight = F.col("n") * F.exp(z * z * -0.5) / (F.col("total") * F.col("h") * F.sqrt(F.lit(2.0) * F.pi()))
    out = gridded.withColumns({"x": x, "weight": weight}).groupBy(*k, "point")
    return out.agg(F.first("x").alias("x"), F.sum("weight").alias("density"))


def ecdf(df: DataFrame, x: str, colour: str | None = None) -> DataFrame:
    """(colour, value, n, fraction): share of rows at or below each distinct value.

    A colour column with the name of a result column is called ``<name>_group``.
    """
    if colour in ("value", "n", "fraction", "column", "below", "total"):  # the result has columns of these names
        df, colour = df.withColumn(f"{colour}_group", name_col(colour)), f"{colour}_group"
    keys = [colour] if colour else []
    p = value_positions(df, [x], keys)
    fraction = (F.col("below") + F.col("n")).cast("double") / F.col("total")
    return p.select(*[name_col(k) for k in keys], "value", "n", fraction.alias("fraction"))


# --- composition ---------------------------------------------------------------------------------------------


def _compact(c: Column) -> Column:
    return (
        F.when(c >= 1_000_000, F.concat(fixed(c / 1_000_000, 1), F.lit("M")))
        .when(c >= 1_000, F.concat(fixed(c / 1_000, 1), F.lit("K")))
        .otherwise(F.format_number(c, 0))
    )


def pie(df, by, metric=None, agg="Sum", top_n=8) -> DataFrame:
    """Largest slices with their share of what is shown. The window is over at most ``top_n`` rows."""
    slices = aggregate(df, by, metric, agg, None, "value_desc", top_n)
    return slices.withColumn("share_pct", percent(F.col("metric"), F.sum("metric").over(Window.partitionBy())))


def donut(df, by, metric=None, agg="Sum", top_n=8) -> DataFrame:
    """A pie with the total in its centre, as a number and in short form."""
    slices = pie(df, by, metric, agg, top_n)
    total = F.sum("metric").over(Window.partitionBy())
    return slices.withColumns({"total": total.cast("double"), "total_text": _compact(total.cast("double"))})


def treemap(df: DataFrame, by: str, sub: str | None = None, metric: str | None = None, agg: str = "Sum") -> DataFrame:
    """(by, sub, metric, level): leaves by one or two keys; a parent is the sum of its leaves for any aggregate.

    Text that is not a number counts as 0.
    """
    keys = [k for k in dict.fromkeys((by, sub)) if k]
    if metric is None:
        leaves = present(df, keys).groupBy(*[name_col(k) for k in keys]).agg(F.count(F.lit(1)).cast("double").alias("metric"))
    else:
        rows = present(df, [*keys, metric])
        v = F.coalesce(number(df, metric), F.lit(0.0))
        if agg == "Median":
            leaves = aggregate(rows.withColumn(metric, v), by, metric, agg, sub, "default", None)
        else:
            leaves = rows.groupBy(*[name_col(k) for k in keys]).agg(AGGREGATES[agg](v).alias("metric"))
    out = leaves.rollup(*[name_col(k) for k in keys]).agg(
        F.sum("metric").alias("metric"), F.grouping_id().alias("gid")
    )
    # grouping_id counts the keys rolled away: 0 = leaf, all bits set = root.
    level = F.lit(len(keys)) - F.bit_count("gid")
    return out.select(*[name_col(k) for k in keys], "metric", level.alias("level"))


sunburst = treemap


def funnel(df, by, metric=None, agg="Sum", top_n=8) -> DataFrame:
    """Stages by size with % of the first one. The window is over at most ``top_n`` rows."""
    stages = aggregate(df, by, metric, agg, None, "value_desc", top_n)
    return stages.withColumn("pct_of_first", percent(F.col("metric"), F.max("metric").over(Window.partitionBy())))


def heatmap(
    df: DataFrame, columns: list[str] | None = None, method: str = "pearson", n: int | None = None
) -> DataFrame:
    """Full correlation matrix, rounded to two places: of the asked columns, else of all that mean numbers (or ``n``).

    Fewer than two columns have no matrix: an empty table.
    """
    chosen = _default_metrics(df, columns, n)
    return full_matrix(correlations(df, chosen, method)).withColumn("r", F.round("r", 2))


def gauge(df: DataFrame, metric: str, agg: str = "Mean") -> DataFrame:
    """One row: value, target, range and the two inner band edges of a KPI dial."""
    v = number(df, metric)
    if agg == "Median":
        val = exact_quantiles(df, [metric], [0.5]).select(F.col("quantiles")[0]).scalar()
        base = df.agg(F.min(v).alias("lo"), F.max(v).alias("hi")).withColumn("value", val)
    else:
        base = df.agg(F.min(v).alias("lo"), F.max(v).alias("hi"), AGGREGATES[agg](v).alias("value"))
    hi = F.when(F.col("hi") > F.col("lo"), F.col("hi")).otherwise(F.col("lo") + 100.0)
    target = F.when(F.col("value") > 0, F.col("value") * 1.15).otherwise(100.0)
    out = base.where(F.col("value").isNotNull()).withColumns({"hi": hi, "target": target})
    return out.select(
        F.lit(metric).alias("metric"),
        F.lit(agg).alias("aggregation"),
        "value",
        "target",
        F.col("lo").alias("min"),
        F.col("hi").alias("max"),
        ((F.col("lo") + F.col("hi")) / 2).alias("band_low"),
        (F.col("hi") * 0.85).alias("band_high"),
        (F.col("hi") * 1.1).alias("axis_end"),
    )
