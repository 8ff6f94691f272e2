"""Prefix trie of conversations: which beginnings they share, and what sharing saves, by time-forward processing.

Nodes are named by (depth, digest): the digest is the XOR of 128 bits of each turn with its position, so it is a running
sum that can be cut anywhere, and no conversation, however long, has to be read by one task. A node's owner is its least
conversation; (owner, depth) names it as well, and the nodes of one owner form a path, so range partitions by
(owner, depth) hold whole stretches of paths.

Subtree totals go up in three steps:

1. Within shards of bounded size, nodes stand in reverse level order. Each takes the totals sent to it from a priority
   queue, adds its own and sends the sum to its parent. The queue spills sorted runs to a scratch file of the task.
2. Shard roots (nodes whose parent is in another shard) form a smaller tree; totals pass between them by doubling: after
   k rounds each root has the totals of all roots up to 2^k - 1 shards below. Messages are added up before each shuffle.
3. What arrives at a node from roots of other shards is added to its own values, and step 1 gives the final totals.
"""

from __future__ import annotations

import hashlib
import heapq
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tablewright.llm.common import ship, written

#: Nodes of a shard, messages a queue holds in memory, rows of a spilled run that are read at once.
SHARD_NODES, IN_MEMORY, BLOCK = 400_000, 100_000, 4096
#: Ids that are joined to one text before the ids of a node meet in one task.
CHUNK_IDS = 4096
WORDS = r"[^\x20\x09-\x0D]+"
KEY = ["depth", "x1", "x2"]


def _xor(*parts: Column) -> Column:
    out = parts[0]
    for p in parts[1:]:
        out = out.bitwiseXOR(p)
    return out


def _mixed(position: Column, k: int, t1: Column, t2: Column) -> Column:
    """64 bits of a turn at a position; `k` tells the two halves of a digest apart."""
    return F.xxhash64(F.lit(k), position, t1, t2)


def _carried(rows: DataFrame, totals: dict[str, Column]) -> DataFrame:
    """(pid, conv, last, totals of the parts before): for conversations that range partitions cut, at most two rows a partition."""
    parts = rows.groupBy("pid", "conv").agg(*(c.alias(n) for n, c in totals.items()))
    cut = parts.groupBy("conv").agg(F.count("*").alias("n")).filter("n > 1").select("conv")
    return parts.join(F.broadcast(cut), "conv")


def ordered(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, pid, idx, t1, t2, words, last): the turns of each conversation numbered from 0, texts as 128-bit digests.

    By `turn`, NULL first; equal turns by role, then the first 100 characters of the text, then its digest. NULL roles and
    texts are empty. Rows without a conversation are no turns of any and are left out.
    """
    empty = F.lit("")
    rows = turns.filter(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("conv"), F.col(turn).alias("turn"), F.coalesce(F.col(role).cast("string"), empty).alias("role"), F.coalesce(text, empty).alias("text")
    )
    rows = rows.select("conv", "turn", "role", F.substring("text", 1, 100).alias("start"), *(F.xxhash64(F.lit(k), "role", "text").alias(f"t{k}") for k in (1, 2)), F.regexp_count("text", F.lit(WORDS)).cast("long").alias("words"))
    order = [F.col("turn").asc_nulls_first(), "role", "start", "t1", "t2"]
    dealt = written(rows.repartitionByRange("conv", *order[:3], "t1").withColumn("pid", F.spark_partition_id()), "turns")
    own = Window.partitionBy("pid", "conv").orderBy(*order)
    counted = dealt.select("conv", "pid", "t1", "t2", "words", (F.row_number().over(own) - 1).cast("long").alias("at"), F.lead(F.lit(1)).over(own).isNull().alias("ends"))
    carried = _carried(dealt, {"n": F.count("*")})
    before = Window.partitionBy("conv").orderBy("pid")
    carried = carried.select("pid", "conv", (F.sum("n").over(before) - F.col("n")).alias("before"), (F.lead(F.lit(1)).over(before).isNull()).alias("final"))
    joined = counted.join(F.broadcast(carried), ["pid", "conv"], "left")
    return joined.select("conv", "pid", (F.col("at") + F.coalesce("before", F.lit(0))).alias("idx"), "t1", "t2", "words", (F.col("ends") & F.coalesce("final", F.lit(True))).alias("last"))


def _begun(heads: DataFrame, most: int) -> DataFrame:
    """(base, head): per conversation its first `most` turns as (t1, t2, words, node digest and parent digest at that place)."""
    rows = heads.groupBy(F.col("conv").alias("base")).agg(F.sort_array(F.collect_list(F.struct("idx", "t1", "t2", "words"))).alias("own"))

    def upto(k: int) -> Column:
        def digest(j: int) -> Column:
            each = F.transform(F.slice("own", 1, k), lambda x: _mixed(x["idx"] + 1, j, x["t1"], x["t2"]))
            return F.aggregate(each, F.lit(0).cast("long"), lambda a, b: a.bitwiseXOR(b))

        return F.struct(digest(1).alias("x1"), digest(2).alias("x2"))

    made = [F.struct(F.lit(k).cast("long").alias("depth"), upto(k)["x1"].alias("x1"), upto(k)["x2"].alias("x2"), upto(k - 1)["x1"].alias("p1"), upto(k - 1)["x2"].alias("p2"), F.get("own", F.lit(k - 1))["words"].alias("words")) for k in range(1, most + 1)]
    return rows.select("base", F.slice(F.array(*made), 1, F.size("own")).alias("head"))


def rebuilt(own: DataFrame, block: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """(steps, ends) of rebuilt conversations, from `ordered` turns.

    Conversation c takes the first h turns of conversation c - c % block (all it has, none if there is none), then its own
    turns after its first h; h = crc32(c) % most. A step is (conv, depth, x1, x2, p1, p2, words), one for each prefix, the
    empty one included: digest of the prefix and of the one before, words of its last text. An end is (depth, x1, x2, conv).
    """
    base, h = F.col("conv") - F.col("conv") % block, (F.crc32(F.col("conv").cast("string").cast("binary")) % most).cast("int")
    heads = _begun(own.filter((F.col("conv") % block == 0) & (F.col("idx") < most - 1)), most - 1)
    placed = own.withColumns({"base": base, "h": h}).join(heads, "base", "left").withColumn("head", F.coalesce(F.slice("head", F.lit(1), F.col("h")), F.expr("array()").cast(heads.schema["head"].dataType)))
    depth = F.when(F.col("idx") >= F.col("h"), F.col("idx") - F.col("h") + F.size("head") + 1)
    zero = F.lit(0).cast("long")
    placed = placed.withColumn("depth", depth).select("*", *(F.when(F.col("depth").isNotNull(), _mixed(F.col("depth"), k, F.col("t1"), F.col("t2"))).otherwise(zero).alias(f"g{k}") for k in (1, 2)))
    placed = written(placed.drop("t1", "t2", "base", "h"), "placed")
    sums = Window.partitionBy("pid", "conv").orderBy("idx").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy("conv").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    carried = _carried(placed, {"g1": F.bit_xor("g1"), "g2": F.bit_xor("g2")}).select("pid", "conv", *(F.coalesce(F.bit_xor(f"g{k}").over(before), zero).alias(f"c{k}") for k in (1, 2)))
    run = placed.select("*", *(F.bit_xor(f"g{k}").over(sums).alias(f"r{k}") for k in (1, 2))).join(F.broadcast(carried), ["pid", "conv"], "left")
    begun = F.element_at("head", F.size("head"))
    start = {k: F.when(F.size("head") > 0, begun[f"x{k}"]).otherwise(zero) for k in (1, 2)}
    run = run.select("conv", "idx", "depth", "words", "last", "head", "g1", "g2", F.size("head").cast("long").alias("k"), *(_xor(start[k], F.coalesce(f"c{k}", zero), F.col(f"r{k}")).alias(f"x{k}") for k in (1, 2)))
    run = written(run, "runs")
    later = run.filter("depth is not null").select("conv", *KEY, _xor(F.col("x1"), F.col("g1")).alias("p1"), _xor(F.col("x2"), F.col("g2")).alias("p2"), "words")
    first = run.filter("idx = 0").select("conv", F.explode("head").alias("s")).select("conv", "s.*")
    top = run.filter("idx = 0").select("conv", *(zero.alias(c) for c in [*KEY, "p1", "p2", "words"]))
    ends = run.filter("last").select(F.coalesce("depth", "k").alias("depth"), "x1", "x2", "conv")
    return later.unionByName(first).unionByName(top), ends


def _listed(ends: DataFrame) -> DataFrame:
    """(depth, x1, x2, ends_sha256): the digest of each node's ids, ascending, joined by commas; long lists in chunks."""

    def keys(batch: pa.RecordBatch) -> list[np.ndarray]:
        return [batch.column(k).to_numpy() for k in KEY]

    def bounds(columns: list[np.ndarray]) -> list[int]:
        new = np.zeros(len(columns[0]), bool)
        for c in columns:
            new |= np.diff(c, prepend=c[:1] - 1) != 0
        return np.flatnonzero(new).tolist()

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            columns, ids = keys(batch), batch.column("conv").to_numpy()
            firsts = bounds(columns)
            starts = [at for a, b in zip(firsts, [*firsts[1:], len(ids)]) for at in range(a, b, CHUNK_IDS)]
            stops = [*starts[1:], len(ids)]
            texts = [",".join(map(str, ids[a:b].tolist())) for a, b in zip(starts, stops)]
            yield pa.RecordBatch.from_arrays([*(pa.array(c[starts]) for c in columns), pa.array(ids[starts]), pa.array(texts)], names=[*KEY, "first", "ids"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sha = None, None
        for batch in batches:
            done = []
            for *key, ids in zip(*(batch.column(k).to_pylist() for k in [*KEY, "ids"])):
                if key == now:
                    sha.update(b",")
                else:
                    if now is not None:
                        done.append((*now, sha.hexdigest()))
                    now, sha = key, hashlib.sha256()
                sha.update(ids.encode())
            yield told(done)
        if now is not None:
            yield told([(*now, sha.hexdigest())])

    def told(done: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*done)) or [()] * 4
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string())], names=[*KEY, "ends_sha256"])

    near = ends.repartitionByRange(*KEY, "conv").sortWithinPartitions(*KEY, "conv").mapInArrow(chunks, "depth long, x1 long, x2 long, first long, ids string")
    met = written(near, "chunks").repartition(*KEY).sortWithinPartitions(*KEY, "first")
    return met.mapInArrow(hashed, "depth long, x1 long, x2 long, ends_sha256 string")


class SpillingQueue:
    """Messages (place, a, b) by place, least first. Above `limit` those in memory become a sorted run in a scratch file."""

    def __init__(self, limit: int = 0):
        self.limit = limit or IN_MEMORY
        self.heap: list[tuple[int, int, int]] = []
        self.heads: list[tuple[int, int, int, int]] = []  # the first message of each run, and the run's number
        self.runs: list[Iterator[list[int]]] = []
        self.file = None

    def push(self, place: int, a: int, b: int) -> None:
        heapq.heappush(self.heap, (place, a, b))
        if len(self.heap) > self.limit:
            self._spill()

    def _spill(self) -> None:
        self.file = self.file or tempfile.TemporaryFile()
        start = self.file.seek(0, 2)
        rows = np.array(sorted(self.heap), np.int64)
        self.file.write(rows.tobytes())
        self.runs.append(self._read(start, len(rows)))
        self.heap = []
        self._advance(len(self.runs) - 1)

    def _read(self, start: int, n: int) -> Iterator[list[int]]:
        for at in range(0, n, BLOCK):
            self.file.seek(start + at * 24)
            yield from np.frombuffer(self.file.read(min(BLOCK, n - at) * 24), np.int64).reshape(-1, 3).tolist()

    def _advance(self, run: int) -> None:
        row = next(self.runs[run], None)
        if row is not None:
            heapq.heappush(self.heads, (*row, run))

    def take(self, place: int) -> tuple[int, int]:
        """The sums of all messages for `place`; every message for an earlier place must have been taken."""
        a = b = 0
        while self.heap and self.heap[0][0] == place:
            _, x, y = heapq.heappop(self.heap)
            a, b = a + x, b + y
        while self.heads and self.heads[0][0] == place:
            _, x, y, run = heapq.heappop(self.heads)
            a, b = a + x, b + y
            self._advance(run)
        return a, b

    def close(self) -> None:
        if self.file:
            self.file.close()


def forwarded(parent: np.ndarray, leaves: np.ndarray, saved: np.ndarray, limit: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Subtree totals of nodes in reverse level order; `parent` is the place of the parent, -1 if it is not here."""
    queue, up = SpillingQueue(limit), parent.tolist()
    own_leaves, own_saved = leaves.tolist(), saved.tolist()
    for i, p in enumerate(up):
        a, b = queue.take(i)
        if a or b:
            own_leaves[i] += a
            own_saved[i] += b
        if p >= 0:
            queue.push(p, own_leaves[i], own_saved[i])
    queue.close()
    return np.array(own_leaves, np.int64), np.array(own_saved, np.int64)


def _places(depth: np.ndarray, owner: np.ndarray, p_owner: np.ndarray) -> np.ndarray:
    """For rows sorted by falling depth and rising owner, where the node (p_owner, depth - 1) stands, or -1."""
    starts = {d: (a, b) for d, a, b in zip(*_runs(depth))}
    place = np.full(len(depth), -1, np.int64)
    for d, (a, b) in starts.items():
        above = starts.get(d - 1)
        if above:
            at = above[0] + np.searchsorted(owner[above[0] : above[1]], p_owner[a:b])
            found = (at < above[1]) & (owner[np.minimum(at, above[1] - 1)] == p_owner[a:b])
            place[a:b][found] = at[found]
    return place


def _runs(values: np.ndarray) -> tuple[list[int], list[int], list[int]]:
    starts = np.flatnonzero(np.diff(values, prepend=values[:1] - 1)).tolist() if len(values) else []
    return [int(values[s]) for s in starts], starts, [*starts[1:], len(values)]


def _within(nodes: DataFrame, roots: bool) -> DataFrame:
    """Step 1 in each shard: columns leaves and saved become totals within it; `roots` adds the node's shard root."""
    added = [T.StructField("r_owner", T.LongType()), T.StructField("r_depth", T.LongType())] if roots else []
    schema = T.StructType([*nodes.schema.fields, *added])

    def shard(batches: list[pa.RecordBatch]) -> pa.Table:
        rows = pa.Table.from_batches(batches).combine_chunks()
        depth, owner, leaves, saved = (rows.column(c).to_numpy() for c in ("depth", "owner", "leaves", "saved"))
        place = _places(depth, owner, rows.column("p_owner").fill_null(-1).to_numpy())
        place[rows.column("p_owner").is_null().to_numpy()] = -1
        for name, total in zip(("leaves", "saved"), forwarded(place, leaves, saved)):
            rows = rows.set_column(rows.schema.get_field_index(name), name, pa.array(total))
        if roots:
            top = np.where(place < 0, np.arange(len(place)), place)
            while (top[top] != top).any():
                top = top[top]
            rows = rows.append_column("r_owner", pa.array(owner[top])).append_column("r_depth", pa.array(depth[top]))
        return rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            for name, a, b in zip(*_runs(batch.column("shard").to_numpy())):
                if name != now and held:
                    yield from shard(held).to_batches(max_chunksize=10_000)
                    held = []
                now = name
                held.append(batch.slice(a, b - a))
        if held:
            yield from shard(held).to_batches(max_chunksize=10_000)

    dealt = nodes.repartition("shard").sortWithinPartitions("shard", F.col("depth").desc(), "owner")
    return dealt.mapInArrow(run, schema)


def _across(partial: DataFrame) -> DataFrame:
    """Step 2: (owner, depth, leaves, saved) to add to nodes, from roots of other shards. Takes nodes with their totals and roots."""
    here = ["owner", "depth"]
    roots = partial.filter("owner = r_owner and depth = r_depth and p_owner is not null").select(*here, "p_owner", "leaves", "saved")
    above = partial.select(F.col("owner").alias("p_owner"), (F.col("depth") + 1).alias("depth"), F.col("r_owner").alias("u_owner"), F.col("r_depth").alias("u_depth"))
    roots = written(roots.join(above, ["p_owner", "depth"]), "roots")
    targets = roots.select(*here, "p_owner")
    values = roots.select(*here, "u_owner", "u_depth", "leaves", "saved")
    # The top root (no parent) is not among them: what is sent to it is needed at its node only.
    while not values.filter("u_owner is not null").join(values.select(F.col("owner").alias("u_owner"), F.col("depth").alias("u_depth")), ["u_owner", "u_depth"], "left_semi").isEmpty():
        sent = values.filter("u_owner is not null").groupBy(F.col("u_owner").alias("owner"), F.col("u_depth").alias("depth")).agg(F.sum("leaves").alias("a"), F.sum("saved").alias("b"))
        jump = values.select(F.col("owner").alias("u_owner"), F.col("depth").alias("u_depth"), F.col("u_owner").alias("v_owner"), F.col("u_depth").alias("v_depth"))
        summed = values.join(sent, here, "left").withColumns({"leaves": F.col("leaves") + F.coalesce("a", F.lit(0)), "saved": F.col("saved") + F.coalesce("b", F.lit(0))}).drop("a", "b")
        moved = summed.join(jump, ["u_owner", "u_depth"], "left")
        values = written(moved.select(*here, F.col("v_owner").alias("u_owner"), F.col("v_depth").alias("u_depth"), "leaves", "saved"), "roots")
    sums = values.join(targets, here)
    return sums.groupBy(F.col("p_owner").alias("owner"), (F.col("depth") - 1).alias("depth")).agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))


def trie(steps: DataFrame, ends: DataFrame, shard_nodes: int = SHARD_NODES) -> DataFrame:
    """One row per distinct prefix: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Takes what `rebuilt` gives. A conversation stands for a node if it is the least that begins with it. n_leaves counts
    childless nodes below, saved_tokens adds (n_convs - 1) times the words of the last turn, both over the node's subtree,
    itself included. ends_sha256 is of the conversations that end there. No conversation, no rows.
    """
    spark = steps.sparkSession
    ship(spark)
    nodes = steps.groupBy(*KEY).agg(F.min("conv").alias("owner"), F.count("*").alias("n_convs"), F.min("p1").alias("p1"), F.min("p2").alias("p2"), F.min("words").alias("words"))
    nodes = written(nodes, "nodes")
    kids = nodes.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("x1"), F.col("p2").alias("x2")).agg(F.count("*").alias("n_children"))
    mothers = nodes.select((F.col("depth") + 1).alias("depth"), F.col("x1").alias("p1"), F.col("x2").alias("p2"), F.col("owner").alias("p_owner"))
    zero = F.lit(0).cast("long")
    whole = nodes.join(kids, KEY, "left").join(_listed(ends), KEY, "left").join(mothers, ["depth", "p1", "p2"], "left").select(
        "owner", "depth", "p_owner", "n_convs", F.coalesce("n_children", zero).alias("n_children"),
        F.when(F.col("n_children").isNull(), F.lit(1)).otherwise(0).cast("long").alias("leaves"),
        ((F.col("n_convs") - 1) * F.col("words")).alias("saved"),
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), nodes.count() // shard_nodes + 1)
    dealt = written(whole.repartitionByRange(shards, "owner", "depth").withColumn("shard", F.spark_partition_id()), "shards")
    partial = written(_within(dealt.select("shard", "owner", "depth", "p_owner", "leaves", "saved"), roots=True), "partial")
    more = _across(partial)
    fed = dealt.join(more, ["owner", "depth"], "left").withColumns({"leaves": F.col("leaves") + F.coalesce("more_leaves", zero), "saved": F.col("saved") + F.coalesce("more_saved", zero)})
    done = _within(fed.select(*dealt.columns), roots=False)
    return done.select(F.col("owner").alias("conv_id"), "depth", F.col("p_owner").alias("parent_conv_id"), "n_convs", "n_children", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), "ends_sha256")


def prefix_trie(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", block: int = 20, most: int = 4) -> DataFrame:
    """The trie of rebuilt conversations (see `ordered`, `rebuilt`, `trie`). Other columns of `turns` are not read.

    NULL turns come first, NULL roles and texts are empty, rows without a conversation are left out; repeated rows are turns
    of their own; an empty table gives no rows. Negative ids are rebuilt by the same remainder, which keeps their sign.
    """
    return trie(*rebuilt(written(ordered(turns, conv, turn, role, text), "ordered"), block, most))
