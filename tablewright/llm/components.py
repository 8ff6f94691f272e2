"""Connected components as a distributed union-find over an edge table.

Alternates two kinds of star: each node first hangs its larger neighbours below the least one it knows, then its
smaller ones. The edges end as one star per component. A step is a partial aggregate and a join of tables that are
written in between, so a node with very many edges is pre-aggregated, and its side of the join can be split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tablewright.llm.common import written


def _hung(edges: DataFrame, least: DataFrame) -> DataFrame:
    return edges.join(least, "u", "left")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of an edge with another: component is the least node reachable.

    `a` and `b` have one orderable type. Loops, repeated edges and edges with a NULL end are ignored; no edges, no rows.
    """
    now = edges.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    now = written(now, "edges")

    def stars(frame: DataFrame) -> bool:
        """Whether every node hangs below one node, and that below none."""
        if not frame.groupBy("u").agg(F.count("*").alias("n")).filter("n > 1").isEmpty():
            return False
        return frame.select(F.col("v").alias("u")).distinct().join(frame.select("u"), "u", "left_semi").isEmpty()

    while not stars(now):
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = written(_hung(both.filter(F.col("v") > F.col("u")), least).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        least = written(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = _hung(large, least).filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = written(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
