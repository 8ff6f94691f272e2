"""Pairwise-complete correlations of many columns at once.

Pearson: a masked Gram matrix. Every column becomes its centred value (0 where it is missing), the square of that and a
flag that it is present; the sums of products of all these, one distributed Gramian, hold the count, sums, squares and
products of every pair over the rows that have both. One scan, no row per pair; what returns is bounded by the columns.

Spearman: Pearson of ranks, which depend on the pair where the other column has gaps. Equal values are counted together
with which columns are present beside them, so one table of positions ranks every value for every pair. Of few columns,
each has a table of its own, which a join on the value brings back to the rows: a broadcast if it has few values, a merge
otherwise. Of many, ranks go back by one merge on (column, value), as joins of wide rows would move more.
"""

from __future__ import annotations

from itertools import combinations, combinations_with_replacement

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.mllib.linalg.distributed import IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions.missing import number, text_literal
from . import ordering
from .ordering import RANGE, _nothing, _placed, _starts, range_limits, ranged, with_ranges

RESULT = "var1 string, var2 string, r double, n bigint"
# Columns whose products are added in one scan; wider tables take a scan per two blocks of half as many.
WIDE = 250
# Sums that one aggregate of ranks may hold; beyond that, columns are taken as cells.
NARROW = 90
# Rows that say roughly where a column's values lie. Any centre and scale give the same result.
NEAR = 1_000
# A column that varies by less than this share of its mean square, as far as the sums can tell, does not vary.
FLAT = 1e-12


def gram(df: DataFrame, features: list[Column]) -> np.ndarray:
    """Sums over all rows of the products of all pairs of features, which must not be NULL.

    Each task adds into one matrix, in the JVM; the matrices meet in a tree. The result is features x features.
    """
    rows = df.select(F.lit(0).cast("long").alias("i"), array_to_vector(F.array(*features)).alias("v"))
    matrix = IndexedRowMatrix(MLUtils.convertVectorColumnsFromML(rows, "v"), 0, len(features))
    return matrix.computeGramianMatrix().toArray()


def _placement(df: DataFrame, columns: list[str]) -> list[tuple[float, float]]:
    """A centre and a scale (a power of two) per column, from some rows."""
    some = df.select(*[number(df, c).alias(f"v{i}") for i, c in enumerate(columns)]).limit(NEAR)
    finite = [F.when(F.abs(f"v{i}") < float("inf"), F.col(f"v{i}")) for i in range(len(columns))]
    found = some.agg(*[F.avg(v).alias(f"c{i}") for i, v in enumerate(finite)], *[F.max(F.abs(v)).alias(f"m{i}") for i, v in enumerate(finite)]).first()
    out = []
    for i in range(len(columns)):
        most = found[f"m{i}"] or 1.0
        # Whole centres keep sums of whole numbers exact.
        centre = float(round(found[f"c{i}"] or 0.0)) if most < 2**53 else found[f"c{i}"]
        out.append((centre, 2.0 ** -round(np.log2(most)) if most > 0 else 1.0))
    return out


def _features(df: DataFrame, columns: list[str]) -> list[Column]:
    """Value, square, presence and infinity of each column, in four runs."""
    values, flags = [], []
    for c, (centre, scale) in zip(columns, _placement(df, columns)):
        v = number(df, c)
        infinite = F.abs(v) == float("inf") if isinstance(df.schema[c].dataType, (T.FractionalType, T.StringType)) else F.lit(False)
        values.append(F.when(v.isNotNull() & ~infinite, (v - F.lit(centre)) * F.lit(scale)).otherwise(0.0))
        flags.append((F.when(v.isNotNull() & ~infinite, 1.0).otherwise(0.0), F.when(infinite, 1.0).otherwise(0.0)))
    return [*values, *[v * v for v in values], *[f for f, _ in flags], *[f for _, f in flags]]


def _paired(df: DataFrame, columns: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(r, n) of all pairs of columns; r is NaN where it is undefined."""
    k = len(columns)
    sums = gram(df, _features(df, columns))
    z, q, m, f = (slice(i * k, (i + 1) * k) for i in range(4))
    n = sums[m, m] + sums[m, f] + sums[f, m] + sums[f, f]
    infinite = sums[f, m] + sums[m, f] + sums[f, f]
    x, xx, xy = sums[z, m], sums[q, m], sums[z, z]  # [i, j]: of column i over the rows that have j as well
    spread = n * xx - x * x
    spread = np.where(spread > FLAT * n * xx, spread, np.nan)
    with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
        r = (n * xy - x * x.T) / np.sqrt(spread) / np.sqrt(spread.T)
    return np.where(infinite > 0, np.nan, np.clip(r, -1, 1)), n


def pearson_pairs(df: DataFrame, columns: list[str]) -> DataFrame:
    """(var1, var2, r, n) of all pairs, pairwise complete. Pairs with a column without spread, or an infinite value, have no row.

    Runs when called: the matrix is added up then, and the result holds a row per pair.
    """
    if len(columns) < 2:
        return _nothing(df, [], RESULT)
    size = len(columns) if len(columns) <= WIDE else WIDE // 2
    blocks = [range(i, min(i + size, len(columns))) for i in range(0, len(columns), size)]
    rows = []
    for a, b in combinations_with_replacement(blocks, 2):
        own = list(a) if a == b else [*a, *b]
        r, n = _paired(df, [columns[i] for i in own])
        for p, q in combinations(range(len(own)), 2):
            if (a == b or (own[p] in a and own[q] in b)) and np.isfinite(r[p, q]):
                rows.append((own[p], own[q], float(r[p, q]), int(n[p, q])))
    told = [(columns[i], columns[j], r, n) for i, j, r, n in sorted(rows)]
    return df.sparkSession.createDataFrame(told, RESULT) if told else _nothing(df, [], RESULT)


def spearman_pairs(df: DataFrame, columns: list[str]) -> DataFrame:
    """(var1, var2, r, n) of all pairs by average ranks over the rows that have both; no row for a column without spread."""
    if len(columns) < 2:
        return _nothing(df, [], RESULT)
    missing = df.agg(*[F.count_if(number(df, c).isNull()).alias(f"m{i}") for i, c in enumerate(columns)]).first()
    gaps = [i for i in range(len(columns)) if missing[f"m{i}"]]
    if len(columns) * (len(columns) - 1) // 2 + 2 * len(columns) * (len(gaps) + 1) <= NARROW:
        return _narrow_spearman(df, columns, gaps)
    # Beside which columns a value is ranked: 0 all rows, k the rows that have the k-th column with gaps.
    beside = {c: k + 1 for k, c in enumerate(gaps)}
    cells = [F.struct(F.lit(i).alias("column"), number(df, c).alias("value")) for i, c in enumerate(columns)]
    shown = F.concat(F.lit("1"), *[F.when(number(df, columns[i]).isNull(), "0").otherwise("1") for i in gaps])
    rows = df.select(F.monotonically_increasing_id().alias("row"), shown.alias("shown"), F.array(*cells).alias("cells"))
    rows = rows.select("row", "shown", F.inline("cells")).where("value is not null")
    patterns = rows.groupBy("column", "value", "shown").agg(F.count(F.lit(1)).alias("n"))
    each = patterns.select("column", "value", "n", F.posexplode(F.split("shown", "")).alias("__beside", "has")).where("has = '1'")
    counts = each.groupBy("__beside", "column", "value").agg(F.sum("n").alias("n"))
    counts = ranged(counts, df, columns)
    placed = _placed(counts, _starts(counts, ["__beside"]), ["__beside"])
    centred = placed.select("__beside", "column", "value", "n", "total", (F.col("below") + (F.col("n") - F.col("total")) / 2).alias("rank"))
    spread = centred.groupBy("__beside", "column").agg(F.max("total").alias("n"), F.sum(F.col("n") * F.col("rank") * F.col("rank")).alias("spread"))
    ranks = centred.groupBy("column", "value").agg(F.map_from_entries(F.collect_list(F.struct("__beside", "rank"))).alias("m"))
    ranks = ranks.select("column", "value", F.transform(F.sequence(F.lit(0), F.lit(len(gaps))), lambda j: F.try_element_at("m", j)).alias("ranks"))
    back = rows.select("row", "column", "value").join(ranks, ["column", "value"])
    grid = back.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("column", "ranks"))).alias("m"))
    grid = grid.select(F.transform(F.sequence(F.lit(0), F.lit(len(columns) - 1)), lambda i: F.try_element_at("m", i)).alias("grid"))
    pairs = list(combinations(range(len(columns)), 2))
    listed = F.expr("array(" + ", ".join(f"named_struct('a', {a}, 'i', {beside.get(b, 0)}, 'b', {b}, 'j', {beside.get(a, 0)})" for a, b in pairs) + ")")

    def product(p: Column) -> Column:
        def of(column: Column, place: Column) -> Column:
            return F.get(F.get("grid", column), place)

        return F.coalesce(of(p["a"], p["i"]) * of(p["b"], p["j"]), F.lit(0.0))

    vectors = grid.select(array_to_vector(F.transform(listed, product)).alias("v"))
    # Grouped, so that no row gives no sum instead of an error.
    sums = vectors.groupBy(F.lit(1).alias("one")).agg(Summarizer.sum(F.col("v")).alias("v"))
    sums = sums.select(F.posexplode(vector_to_array("v")).alias("p", "product"))
    labelled = sums.select("product", listed[F.col("p")].alias("pair"))
    for side, place in (("a", "i"), ("b", "j")):
        own = spread.select(F.col("column").alias(f"c{side}"), F.col("__beside").alias(f"p{side}"), F.col("n").alias(f"n{side}"), F.col("spread").alias(f"s{side}"))
        labelled = labelled.join(own, (F.col(f"pair.{side}") == F.col(f"c{side}")) & (F.col(f"pair.{place}") == F.col(f"p{side}")))
    titles = F.expr("array(" + ", ".join(map(text_literal, columns)) + ")")
    r = F.col("product") / F.sqrt("sa") / F.sqrt("sb")
    return labelled.where("sa > 0 and sb > 0").select(titles[F.col("ca")].alias("var1"), titles[F.col("cb")].alias("var2"), r.alias("r"), F.col("na").alias("n"))


def _narrow_spearman(df: DataFrame, columns: list[str], gaps: list[int]) -> DataFrame:
    """`spearman_pairs` of few columns, of which `gaps` have missing values."""
    rows = df.select(*[number(df, c).alias(f"v{i}") for i, c in enumerate(columns)])
    limits = range_limits(df, [number(df, c) for c in columns], ordering.PER_RANGE)
    # Beside which columns a value is ranked: -1 all rows, g the rows that have column g, which has gaps.
    beside = {i: sorted({b if b in gaps else -1 for b in range(len(columns)) if b != i}) for i in range(len(columns))}
    grid = rows
    # Columns of many values first, while rows are narrow.
    for i in sorted(beside, key=lambda i: not limits[i]):
        ranks = _column_ranks(rows, i, beside[i], limits[i])
        grid = grid.join(ranks if limits[i] else F.broadcast(ranks), f"v{i}", "left").drop(f"v{i}")

    def rank(a: int, b: int) -> Column:
        """Of column a, over the rows that have column b; NULL elsewhere."""
        return F.col(f"r{a}_{b}") if b < 0 else F.when(F.col(f"r{b}_{beside[b][0]}").isNotNull(), F.col(f"r{a}_{b}"))

    own = [(a, g) for a, others in beside.items() for g in others]
    pairs = [(a, b, b if b in gaps else -1, a if a in gaps else -1) for a, b in combinations(range(len(columns)), 2)]
    sums = grid.agg(
        *[F.sum(rank(a, g) * rank(a, g)).alias(f"s{a}_{g}") for a, g in own],
        *[F.count(rank(a, g)).alias(f"n{a}_{g}") for a, g in own],
        *[F.sum(F.col(f"r{a}_{i}") * F.col(f"r{b}_{j}")).alias(f"p{a}_{b}") for a, b, i, j in pairs],
    )
    told = [
        F.struct(
            F.lit(columns[a]).alias("var1"),
            F.lit(columns[b]).alias("var2"),
            F.when((F.col(f"s{a}_{i}") > 0) & (F.col(f"s{b}_{j}") > 0), F.col(f"p{a}_{b}") / F.sqrt(f"s{a}_{i}") / F.sqrt(f"s{b}_{j}")).alias("r"),
            F.col(f"n{a}_{i}").alias("n"),
        )
        for a, b, i, j in pairs
    ]
    return sums.select(F.inline(F.array(*told))).where("r is not null")


def _column_ranks(rows: DataFrame, i: int, beside: list[int], limits: list[float]) -> DataFrame:
    """(v, r...) for each value of column `i`: its average rank, less the mean, over all rows (-1) or those that have a column."""
    v, key = f"v{i}", [RANGE]
    held = [F.count(F.lit(1) if g < 0 else F.col(f"v{g}")).alias(f"n{g}") for g in beside]
    counts = rows.where(F.col(v).isNotNull()).groupBy(v).agg(*held)
    # Also with one limit or none: by a constant range Spark would join in a nested loop.
    counts = with_ranges(counts, {v: limits}, {v: RANGE})
    sizes = counts.groupBy(*key).agg(*[F.sum(f"n{g}").alias(f"size{g}") for g in beside])
    # One row per range.
    every = Window.partitionBy(F.lit(0))
    before = every.orderBy(*key).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*key, *[F.coalesce(F.sum(f"size{g}").over(before), F.lit(0)).alias(f"start{g}") for g in beside], *[F.sum(f"size{g}").over(every).alias(f"total{g}") for g in beside])
    running = Window.partitionBy(*key).orderBy(v).rowsBetween(Window.unboundedPreceding, 0)
    placed = counts.join(F.broadcast(starts), key).select(v, *[f"start{g}" for g in beside], *[f"total{g}" for g in beside], *[f"n{g}" for g in beside], *[F.sum(f"n{g}").over(running).alias(f"upto{g}") for g in beside])
    return placed.select(v, *[(F.col(f"start{g}") + F.col(f"upto{g}") - (F.col(f"n{g}") + F.col(f"total{g}")) / 2).alias(f"r{i}_{g}") for g in beside])
