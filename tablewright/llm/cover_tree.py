"""Embedding near duplicates: exact pairs within an angle, by a dual traversal of cover trees.

Unit vectors are at distance sqrt(2 - 2 cosine), so a least cosine is a largest distance. A cover tree holds vectors
in nested levels whose radii halve: a node covers its vectors within its radius, and its own centre is one of its
children. Two trees are traversed together. A pair of nodes is dropped when its centres are farther apart than both
covering radii and the threshold, and what is left at the leaves is compared exactly, in double precision.

To spread the work, equal vectors become one with a weight, and the vectors of a label are laid out by their distance
to one vector of the label, in blocks of bounded size. Blocks whose distance ranges are farther apart than the
threshold can't hold a pair (triangle inequality); every other pair of blocks is a piece of work by itself, however
large the label is. A piece returns a count and one link per vector, not the pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from tablewright.llm.common import ship, written
from tablewright.llm.components import components
from tablewright.llm.simhash import Forest

#: Vectors of a block, and of a leaf.
BLOCK = 1024
LEAF = 48
SLACK = 1e-9
#: Trees that a task keeps for its next pairs of blocks.
TREES = 16


class Node:
    """`radius` is the largest distance of a member to the centre. Of the children: centres, radii, whether single."""

    __slots__ = ("centre", "radius", "members", "children", "centres", "radii", "single")

    def __init__(self, centre: int, radius: float, members: np.ndarray):
        self.centre, self.radius, self.members = centre, radius, members
        self.have([])

    def have(self, children: list[Node]) -> None:
        self.children = children
        own = children or [self]
        self.centres = np.array([c.centre for c in own])
        self.radii = np.array([c.radius for c in own])
        self.single = np.array([len(c.members) == 1 for c in own])


def build(vectors: np.ndarray, leaf: int = LEAF) -> Node:
    """Cover tree of unit vectors (rows)."""

    def distances(centre: int, members: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0.0, 2 - 2 * (vectors[members] @ vectors[centre])))

    everyone = np.arange(len(vectors))
    far = distances(0, everyone)
    root = Node(0, float(far.max()), everyone)
    todo = [(root, 2.0, far)]
    while todo:
        node, level, far = todo.pop()
        if len(node.members) <= leaf or node.radius <= 1e-7:
            continue
        while level / 2 >= node.radius:  # levels at which the node has itself as its only child
            level /= 2
        level /= 2
        children, members, centre = [], node.members, node.centre
        while True:
            near = far <= level
            child = Node(centre, float(far[near].max()), members[near])
            children.append(child)
            todo.append((child, level, far[near]))
            members = members[~near]
            if not len(members):
                break
            centre = int(members[0])
            far = distances(centre, members)
        node.have(children)
    return root


def traverse(a: Node, va: np.ndarray, b: Node, vb: np.ndarray, cosine: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows (i of va, j of vb) of all pairs with at least `cosine`. same: the trees are one, each pair comes once.

    A step takes two nodes down to their children at once, with one product of the children's centres.
    """
    most = math.sqrt(max(0.0, 2 - 2 * cosine)) + SLACK
    todo = [(a, b)]
    while todo:
        x, y = todo.pop()
        own = same and x is y
        if not x.children and not y.children:
            close = va[x.members] @ vb[y.members].T >= cosine
            i, j = np.nonzero(np.triu(close, 1) if own else close)
            if len(i):
                yield x.members[i], y.members[j]
            continue
        dots = va[x.centres] @ vb[y.centres].T
        near = np.sqrt(np.maximum(0.0, 2 - 2 * dots)) <= x.radii[:, None] + y.radii[None, :] + most
        if own:
            near = np.triu(near)
        alone = x.single[:, None] & y.single[None, :]
        i, j = np.nonzero(near & alone & (dots >= cosine))
        if own:
            i, j = i[i != j], j[i != j]
        if len(i):
            yield x.centres[i], y.centres[j]
        xs, ys = x.children or [x], y.children or [y]
        rest = near & ~alone
        ends = np.array([not c.children for c in ys])
        for i in np.flatnonzero(rest.any(1)).tolist():
            row = rest[i]
            if not xs[i].children:  # all leaves that are near this one, in one product
                leaves = [ys[j].members for j in np.flatnonzero(row & ends).tolist() if not (own and i == j)]
                row = row & ~ends
                if own and rest[i, i]:
                    row[i] = True
                if leaves:
                    members = np.concatenate(leaves)
                    p, q = np.nonzero(va[xs[i].members] @ vb[members].T >= cosine)
                    if len(p):
                        yield xs[i].members[p], members[q]
            todo += [(xs[i], ys[j]) for j in np.flatnonzero(row).tolist()]


def usable(vector) -> F.Column:
    """Not NULL, no NULL or non-finite component, not zero."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~odd & F.exists(vector, lambda x: x != 0), F.lit(False))


def _blocks(rows: DataFrame, size: int) -> DataFrame:
    """Blocks of vectors of one label and length, by distance to a vector of theirs."""
    pivot = rows.groupBy("label", "d").agg(F.min_by("vector", "node").alias("pivot"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    cosine = dot(F.col("vector"), F.col("pivot")) / F.sqrt(dot(F.col("vector"), F.col("vector"))) / F.sqrt(dot(F.col("pivot"), F.col("pivot")))
    far = rows.join(pivot, ["label", "d"]).withColumn("far", F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * cosine)))
    laid = far.select("label", "d", "far", "node", "copies", "vector")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32

        def block(label, d: int, own: list) -> pa.RecordBatch:
            nonlocal number
            number += 1
            vectors = np.array([r[3] for r in own], float)
            vectors /= np.abs(vectors).max(1, keepdims=True)
            vectors /= np.linalg.norm(vectors, axis=1)[:, None]
            packed = [np.array([r[k] for r in own], np.int64).tobytes() for k in (1, 2)]
            columns = [[number], [label], [d], [own[0][0]], [own[-1][0]], [packed[0]], [packed[1]], [vectors.tobytes()]]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

        held, of = [], None
        for batch in batches:
            for label, d, far, node, copies, vector in zip(*(c.to_pylist() for c in batch.columns)):
                if held and ((label, d) != of or len(held) >= size):
                    yield block(*of, held)
                    held = []
                of = (label, d)
                held.append((far, node, copies, vector))
        if held:
            yield block(*of, held)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    label = rows.schema["label"].dataType.simpleString()
    schema = _parse_datatype_string(f"block long, label {label}, d int, low double, high double, nodes binary, copies binary, vectors binary")
    arrow = to_arrow_schema(schema)
    ordered = laid.repartitionByRange("label", "d", "far", "node").sortWithinPartitions("label", "d", "far", "node")
    return ordered.mapInArrow(run, schema)


def _work(pairs: DataFrame, cosine: float) -> DataFrame:
    """(node, links, root) for each vector with a link in a pair of blocks; links counts copies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees: dict[int, tuple[np.ndarray, Node]] = {}

        def tree_of(block: int, packed: bytes, d: int) -> tuple[np.ndarray, Node]:
            if block not in trees:
                if len(trees) >= TREES:
                    trees.pop(next(iter(trees)))
                vectors = np.frombuffer(packed).reshape(-1, d)
                trees[block] = vectors, build(vectors)
            return trees[block]

        for batch in batches:
            for first, second, d, na, ca, xa, nb, cb, xb in zip(*(c.to_pylist() for c in batch.columns)):
                same = first == second
                nodes, copies = np.frombuffer(na, np.int64), np.frombuffer(ca, np.int64)
                va, tree = tree_of(first, xa, d)
                if same:
                    vb, other, shift = va, tree, 0
                else:
                    (vb, other), shift = tree_of(second, xb, d), len(nodes)
                    nodes = np.concatenate([nodes, np.frombuffer(nb, np.int64)])
                    copies = np.concatenate([copies, np.frombuffer(cb, np.int64)])
                forest, links = Forest(len(nodes)), np.zeros(len(nodes), np.int64)
                for i, j in traverse(tree, va, other, vb, cosine, same):
                    j = j + shift
                    np.add.at(links, i, copies[j])
                    np.add.at(links, j, copies[i])
                    forest.link(i, j)
                at = np.flatnonzero(links)
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array(nodes[at]), pa.array(links[at]), pa.array(nodes[forest.roots()[at]])], names=["node", "links", "root"])

    return pairs.mapInArrow(run, "node long, links long, root long")


def near_duplicates(vectors: DataFrame, key: str, vector: str, label: str, cosine: float = 0.93, block: int = BLOCK) -> DataFrame:
    """One row per row of `vectors`: key, n_links (other rows linked directly), component_id (least key reachable), kept.

    Rows link when their labels are equal and not NULL, their lengths are equal and the cosine is at least `cosine`.
    A NULL or zero vector, or one with a NULL or non-finite component, links with nothing, not even a copy. A NULL key
    is not least unless there is no other. Empty table: no rows.
    """
    ship(vectors.sparkSession)
    rows = vectors.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("vector"), F.col(label).alias("label"))
    good = usable(F.col("vector")) & F.col("label").isNotNull()
    distinct = rows.filter(good).groupBy("label", "vector").agg(F.min("key").alias("least"), F.count("*").alias("copies"))
    distinct = written(distinct.withColumns({"node": F.monotonically_increasing_id(), "d": F.size("vector")}), "vectors")
    blocks = written(_blocks(distinct, block), "blocks")
    meta = blocks.select("block", "label", "d", "low", "high")
    a, b = (meta.select(*(F.col(c).alias(f"{c}{k}") for c in meta.columns)) for k in "ab")
    most = math.sqrt(max(0.0, 2 - 2 * cosine)) + SLACK
    apart = F.greatest(F.col("lowa") - F.col("highb"), F.col("lowb") - F.col("higha"))
    pairs = a.join(b, (F.col("labela") == F.col("labelb")) & (F.col("da") == F.col("db")) & (F.col("blocka") <= F.col("blockb")) & (apart <= most))
    pairs = pairs.select("blocka", "blockb", F.col("da").alias("d"))
    for k in "ab":
        own = blocks.select(F.col("block").alias(f"block{k}"), *(F.col(c).alias(f"{c}{k}") for c in ("nodes", "copies", "vectors")))
        pairs = pairs.join(own, f"block{k}")
    pairs = pairs.select("blocka", "blockb", "d", "nodesa", "copiesa", "vectorsa", "nodesb", "copiesb", "vectorsb")
    found = written(_work(pairs, cosine), "found")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    groups = components(found, "node", "root")
    known = distinct.select("node", "least", "copies").join(links, "node", "left").join(groups, "node", "left")
    known = written(known.withColumn("component", F.coalesce("component", "node")), "known")
    named = known.groupBy("component").agg(F.min("least").alias("component_id"))
    told = known.join(named, "component").select("node", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    told = distinct.select("node", "label", "vector").join(told, "node").drop("node")
    joined = rows.filter(good).join(told, ["label", "vector"]).select("key", "n_links", "component_id")
    alone = rows.filter(~good).select("key", F.lit(0).cast("long").alias("n_links"), F.col("key").alias("component_id"))
    done = joined.unionByName(alone)
    return done.select(F.col("key").alias(key), "n_links", "component_id", F.col("key").eqNullSafe(F.col("component_id")).alias("kept"))
