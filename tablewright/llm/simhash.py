"""SimHash near duplicates: fingerprints, a binary trie self-join within a Hamming budget, and components.

A bit trie is walked in pairs of nodes of one depth. A pair carries the differing bits of its two prefixes and is
dropped as soon as they exceed the budget. To spread the walk, the bits are cut into budget + 1 blocks and there is
one trie for each block, with that block's bits first: two fingerprints within the budget agree on a block, so they
meet below a node of that trie with no error yet. A task walks the subtries below its nodes. A node with more
fingerprints than a task should hold is cut again in the same way, by blocks of its remaining bits.

Copies of a fingerprint are one before the join, and a task returns a spanning tree of what it links instead of all
pairs, so large groups of copies and near copies stay small.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from tablewright.llm.common import ship, written
from tablewright.llm.components import components
from tablewright.llm.line_dedup import _marked, document_key

BITS = 64
#: Fingerprints below one node that a task walks alone; more are cut by further bits.
NODE = 20_000
#: Node pairs that a walk handles at a time; the rest waits.
PAIRS = 1 << 20


def fingerprint(text: str | None, words: int = 3, seed: int = 42) -> int:
    """Majority bits of the XXH64 of all shingles, repeats included; fewer words: of the whole sequence; none: 0."""
    own = (text or "").encode().lower().split()  # bytes: only A-Z change, only ASCII white space splits
    if not own:
        return 0
    joined = b" ".join(own)
    if len(own) <= words:
        hashes = [xxhash.xxh64_intdigest(joined, seed)]
    else:
        ends = np.cumsum([len(w) + 1 for w in own])
        starts = np.concatenate([[0], ends[: len(own) - words]]).tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], seed) for a, b in zip(starts, (ends[words - 1 :] - 1).tolist())]
    counts = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = np.array(hashes[i : i + (1 << 16)], "<u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text", into: str = "fingerprint", words: int = 3) -> DataFrame:
    """Adds `into` (long, the 64 bits as they are) for each whole text. NULL counts as empty. No shuffle."""
    ship(docs.sparkSession)
    kept = [f for f in docs.schema.fields if f.name != into]
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py(), words) for t in batch.column(batch.schema.get_field_index(text))], np.uint64)
            columns = [batch.column(batch.schema.get_field_index(n)) for n in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(found.view(np.int64))], names=[*names, into])

    return docs.mapInArrow(run, T.StructType([*kept, T.StructField(into, T.LongType())]))


class Forest:
    """Union-find over the rows of one task."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def roots(self) -> np.ndarray:
        while True:
            up = self.parent[self.parent]
            if (up == self.parent).all():
                return up
            self.parent = up

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            root = self.roots()
            x, y = root[a], root[b]
            apart = x != y
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(self.parent, np.maximum(x, y), np.minimum(x, y))


def walk(values: np.ndarray, first: int, budget: int, link) -> None:
    """Walks the trie of sorted distinct `values` (uint64) below their equal first `first` bits, in pairs of nodes.

    Rows must be sorted; runs with equal first bits are the starting nodes, each paired with itself. Calls
    link(i, j) with the rows of all pairs within `budget` differing bits. A node is a range of rows.
    """
    n = len(values)
    if n < 2:
        return
    if first:
        top = values >> np.uint64(BITS - first)
        edges = np.concatenate([[0], np.flatnonzero(top[1:] != top[:-1]) + 1, [n]])
    else:
        edges = np.array([0, n])
    lo, hi = edges[:-1], edges[1:]
    more = hi - lo > 1
    lo, hi = lo[more], hi[more]
    waiting = [(first, lo, hi, lo.copy(), hi.copy(), np.zeros(len(lo), np.int8))]
    while waiting:
        depth, lo, hi, lo2, hi2, errors = waiting.pop()
        if len(lo) > PAIRS:
            half = len(lo) // 2
            waiting += [(depth, lo[:half], hi[:half], lo2[:half], hi2[:half], errors[:half]), (depth, lo[half:], hi[half:], lo2[half:], hi2[half:], errors[half:])]
            continue
        # Pairs of single rows, and of a node with itself when it is one row, are decided by their remaining bits.
        leaf = (hi - lo == 1) & (hi2 - lo2 == 1)
        if leaf.any():
            i, j = lo[leaf], lo2[leaf]
            near = (i != j) & (np.bitwise_count(values[i] ^ values[j]) <= budget)
            link(i[near], j[near])
            lo, hi, lo2, hi2, errors = (x[~leaf] for x in (lo, hi, lo2, hi2, errors))
        if not len(lo) or depth == BITS:
            continue
        # Where each node's rows with a set bit begin.
        bit = np.uint64(BITS - 1 - depth)
        ones = np.concatenate([[0], np.cumsum((values >> bit) & np.uint64(1)).astype(np.int64)])
        mid, mid2 = hi - (ones[hi] - ones[lo]), hi2 - (ones[hi2] - ones[lo2])
        same = lo == lo2
        made = [(lo, mid, lo2, mid2, errors), (mid, hi, mid2, hi2, errors), (lo, mid, mid2, hi2, errors + 1)]
        made.append(tuple(x[~same] for x in (mid, hi, lo2, mid2, errors + 1)))  # of a node with itself: seen already
        parts = [np.concatenate([m[k] for m in made]) for k in range(5)]
        good = (parts[0] < parts[1]) & (parts[2] < parts[3]) & (parts[4] <= budget)
        good &= ~((parts[0] == parts[2]) & (parts[1] - parts[0] == 1))
        if good.any():
            waiting.append((depth + 1, *(x[good] for x in parts)))


def blocks(width: int, budget: int) -> list[tuple[int, int]]:
    """(start, length) of budget + 1 blocks of `width` bits."""
    cuts = [round(width * k / (budget + 1)) for k in range(budget + 2)]
    return list(zip(cuts, (b - a for a, b in zip(cuts, cuts[1:]))))


def near_links(prints: DataFrame, budget: int = 2, node: int = NODE) -> DataFrame:
    """(a, b): links that span the components of distinct fingerprints (long column `fingerprint`) within `budget` bits."""
    ship(prints.sparkSession)
    unseen = [(r, start, length) for r, (start, length) in enumerate(blocks(BITS, budget))]

    def turned(value, start: int):
        return value if not start else F.shiftleft(value, start).bitwiseOR(F.shiftrightunsigned(value, BITS - start))

    one = prints.select("fingerprint").distinct()
    rows = one.select("fingerprint", F.explode(F.array(*(F.struct(F.lit(r).alias("r"), turned(F.col("fingerprint"), s).alias("bits"), F.lit(n).alias("fixed")) for r, s, n in unseen))).alias("x"))
    rows = rows.select("fingerprint", F.col("x.bits").alias("bits"), F.col("x.fixed").alias("fixed"), F.concat(F.lit("/"), F.col("x.r").cast("string")).alias("trie"))

    rows = rows.withColumn("head", F.expr(f"shiftrightunsigned(bits, {BITS} - fixed)"))
    found = None
    for _ in range(4):
        rows = written(rows, "trie")
        sizes = rows.groupBy("trie", "head").agg(F.count("*").alias("n")).filter(F.col("n") > 1)
        hot = written(sizes.filter(F.col("n") > node).select("trie", "head"), "trie-hot")
        small = rows.join(hot, ["trie", "head"], "left_anti")
        part = _walked(small, budget)
        found = part if found is None else found.unionByName(part)
        if hot.isEmpty():
            return written(found, "links")
        rows = _cut_again(rows.join(hot, ["trie", "head"], "left_semi"), budget)
    return written(found.unionByName(_walked(rows, budget)), "links")


def _cut_again(rows: DataFrame, budget: int) -> DataFrame:
    """Rows of crowded nodes under nodes of further tries: a block of the remaining bits moves behind the fixed ones."""
    ordered = rows.select("fingerprint", "bits", "fixed", "trie", "head")
    schema = ordered.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        full = (1 << BITS) - 1
        for batch in batches:
            out = []
            for own, bits, fixed, trie, _ in zip(*(c.to_pylist() for c in batch.columns)):
                bits &= full
                width = BITS - fixed
                rest = bits & ((1 << width) - 1)
                for r, (start, length) in enumerate(blocks(width, budget)):
                    turn = ((rest << start) | (rest >> (width - start))) & ((1 << width) - 1) if start else rest
                    made = (bits >> width << width) | turn
                    head = made >> (width - length)
                    signed = [x - (1 << BITS) if x >> (BITS - 1) else x for x in (made, head)]
                    out.append((own, signed[0], fixed + length, f"{trie}/{r}", signed[1]))
            columns = zip(*out) if out else [[]] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, batch.schema.types)], schema=batch.schema)

    return ordered.mapInArrow(run, schema)


def _walked(rows: DataFrame, budget: int) -> DataFrame:
    """Walks the subtries of each task's nodes. Rows of a node come together and in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def nodes() -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
            """(first bits, bits, fingerprints) of whole nodes, many small ones of a trie together."""
            held, trie, last = [], None, None
            for batch in batches:
                names = batch.column(2).to_pylist()
                bits, own, heads = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1, 4))
                fixed = batch.column(3).to_numpy(zero_copy_only=False)
                cuts = [0, *(i for i in range(1, len(names)) if names[i] != names[i - 1]), len(names)]
                for a, b in zip(cuts, cuts[1:]):
                    if a == b:
                        continue
                    if held and names[a] != trie:
                        yield joined(held)
                        held = []
                    trie, last = names[a], heads[b - 1]
                    held.append((int(fixed[a]), bits[a:b], own[a:b], heads[a:b]))
                    if sum(len(h[1]) for h in held) > 1 << 18:
                        whole = np.concatenate([h[3] for h in held])
                        open_ = int(np.argmax(whole == last)) if last is not None else 0
                        if open_:
                            f, x, y = joined(held)
                            yield f, x[:open_], y[:open_]
                            held = [(f, x[open_:], y[open_:], whole[open_:])]
            if held:
                yield joined(held)

        def joined(held: list) -> tuple[int, np.ndarray, np.ndarray]:
            return held[0][0], np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held])

        for first, bits, own in nodes():
            values = bits.view(np.uint64)
            order = np.argsort(values, kind="stable")
            forest = Forest(len(values))
            walk(values[order], first, budget, forest.link)
            root = forest.roots()
            tied = np.flatnonzero(root != np.arange(len(root)))
            if len(tied):
                yield pa.RecordBatch.from_arrays([pa.array(own[order][root[tied]]), pa.array(own[order][tied])], names=["a", "b"])

    dealt = rows.select("bits", "fingerprint", "trie", "fixed", "head").repartition("trie", "head").sortWithinPartitions("trie", "head")
    return dealt.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, key: str, text: str = "text", budget: int = 2) -> DataFrame:
    """One row per row of `docs`: key, fingerprint (16 hex digits), component_id (least key reachable).

    Texts link when their fingerprints differ in `budget` bits or fewer; NULL and empty texts have fingerprint zero
    and link like any other. NULL keys are not least unless there is no other. Repeated rows stay. Empty: no rows.
    """
    prints = written(fingerprints(docs.select(key, text), text).select(key, "fingerprint"), "fingerprints")
    groups = components(near_links(prints, budget)).withColumnRenamed("node", "fingerprint")
    least = prints.groupBy("fingerprint").agg(F.min(key).alias("least"))
    rooted = written(least.join(groups, "fingerprint", "left").withColumn("component", F.coalesce("component", "fingerprint")), "rooted")
    named = rooted.groupBy("component").agg(F.min("least").alias("component_id"))
    known = written(rooted.join(named, "component").select("fingerprint", "component_id"), "classes")
    joined = prints.join(known, "fingerprint")
    return joined.select(key, F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, key: str, text: str = "text", budget: int = 2) -> DataFrame:
    """The rows of `docs` that stay when each near-duplicate group keeps one: the least key, then the least digest.

    Rows with equal key and text are one; of these, one row stays. Texts without a word (NULL too) are alike, so one of
    them stays. A NULL key comes last. Empty: no rows. All columns stay.
    """
    named = docs.withColumn("__document", document_key(key, text))
    prints = fingerprints(named.select("__document", F.col(key).alias("key"), F.col(text).alias("text")), "text")
    prints = written(prints.select("__document", "key", "fingerprint"), "fingerprints")
    groups = components(near_links(prints, budget)).withColumnRenamed("node", "fingerprint")
    rank = F.struct(F.col("key").isNull().alias("none"), "key", F.col("__document").alias("document"))
    members = prints.join(groups, "fingerprint", "left").select(F.coalesce("component", "fingerprint").alias("component"), rank.alias("rank"))
    first = members.groupBy("component").agg(F.min("rank").alias("rank")).select(F.col("rank.document").alias("__document"), F.lit(True).alias("__stays"))
    counted = prints.groupBy("__document").agg(F.count("*").alias("__n")).join(first, "__document", "left")
    touched = written(counted.filter("__stays is null or __n > 1"), "touched")
    marked = _marked(named, "__document", touched, "__touched")
    plain = marked.filter("not __touched")
    known = marked.filter("__touched").join(touched, "__document", "left")
    once = known.filter("__n is null")
    repeated = known.filter("__stays").dropDuplicates(["__document"])
    return plain.drop("__touched").unionByName(once.unionByName(repeated).drop("__touched", "__n", "__stays")).drop("__document")
