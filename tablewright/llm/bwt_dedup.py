"""Repeated byte strings: shard Burrows-Wheeler transforms, merged by iterative interleave refinement.

A string of `length` bytes that starts at two places is removed at both. Every start is dealt to an anchor: the least
of the hashes of the short grams inside its string, so equal strings have equal anchors and meet, wherever they are.
A stretch is a run of starts of a text with one anchor, with the bytes their strings cover, some 270 on average.

1. Stretches whose anchor occurs once can't repeat and go no further. Equal stretches become one with a weight; a weight
   of two means that all its starts repeat. What is left to compare are different stretches of one anchor.
2. Those go to tasks by anchor. A task cuts them into shards. Each shard has the transform of its stretches, over an
   alphabet of blocks (a symbol is the hash of a block's bytes, and the suffix before a suffix is one block earlier).
3. Transforms are merged without sorting their suffixes again. The interleave says from which shard the next suffix of
   the merged order comes. It begins as the shards one after the other; each round sends the symbols, in the order that
   the interleave gives, to their buckets, which orders it by one more block. The round in which two neighbours part is
   their common prefix. Neighbours that are still together after length / block rounds share `length` bytes: a repeat.
   They are confirmed on the bytes themselves.

No task holds more than a batch of stretches at a time. An anchor with more different stretches than CROWD (the edges of
a passage that very many documents quote) is not compared in one task: its starts are counted by the 128-bit hash of
their string, in a plain aggregate, eight neighbours at once where they repeat together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from tablewright.llm.common import ship, written
from tablewright.llm.line_dedup import _marked, document_key

#: Bytes of a gram, and of a block at most (a block is a divisor of the length).
GRAM, BLOCK = 32, 50
CROWD = 3_000
#: Bytes of stretches that a task merges at a time (more only for one anchor's), and bytes of a shard.
BATCH = 1 << 20
SHARD = 1 << 18
#: Longer texts pass in segments of so many starts.
SEGMENT = 1 << 25
BASE = np.uint64(0x9E3779B97F4A7C15)
BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) <= n:
        size = max(1 << 16, 2 * n)
        with np.errstate(over="ignore"):
            _POWERS[:] = [np.concatenate([[np.uint64(1)], np.multiply.accumulate(np.full(size, b, np.uint64))]) for b in (BASE, BACK)]
    return _POWERS[0], _POWERS[1]


def rolling(data: np.ndarray, width: int) -> np.ndarray:
    """64-bit hashes of all strings of `width` bytes."""
    n = len(data)
    up, down = _powers(n)
    with np.errstate(over="ignore"):
        sums = np.concatenate([[np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], dtype=np.uint64)])
        h = (sums[width:] - sums[:-width]) * down[: n - width + 1]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
    return h


def stretches(data: bytes, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first start, starts, place of the anchor, hash of the anchor) of the stretches, a segment at a time."""
    gram = min(GRAM, length)
    width = length - gram + 1
    whole = np.frombuffer(data, np.uint8)
    for begin in range(0, len(whole) - length + 1, SEGMENT):
        part = whole[begin : begin + SEGMENT + length - 1]
        h = rolling(part, gram)
        n = len(h)
        key = (h >> np.uint64(26) << np.uint64(26)) | np.arange(n, dtype=np.uint64)
        rows = np.concatenate([key, np.full(-n % width, ~np.uint64(0))]).reshape(-1, width)
        until = np.minimum.accumulate(rows, 1).ravel()
        since = np.minimum.accumulate(rows[:, ::-1], 1)[:, ::-1].ravel()
        least = np.minimum(since[: n - width + 1], until[width - 1 : n])
        at = (least & np.uint64((1 << 26) - 1)).astype(np.int64)
        edges = np.flatnonzero(np.diff(at)) + 1
        first = np.concatenate([[0], edges])
        yield first + begin, np.diff(np.concatenate([first, [len(at)]])), at[first] + begin, h[at[first]]


def _order(symbols: np.ndarray) -> np.ndarray:
    """Stable order of small whole numbers, by counting sorts of 16 bits."""
    order = np.argsort((symbols & 0xFFFF).astype(np.uint16), kind="stable")
    high = symbols >> 16
    return order[np.argsort(high[order].astype(np.uint16), kind="stable")] if high.any() else order


def _refined(order: np.ndarray, ends: np.ndarray, symbol: np.ndarray, previous: np.ndarray) -> np.ndarray:
    """Suffixes in order by one more block: each sends the suffix a block before it to that block's bucket."""
    sent = previous[order]
    sent = np.concatenate([ends, sent[sent >= 0]])
    return sent[_order(symbol[sent])]


class Shard:
    """The transform of some stretches: `suffixes` in order by `rounds` blocks, `ends` those of one block only.

    The symbol before a suffix is symbol[previous[suffix]].
    """

    def __init__(self, places: np.ndarray, symbol: np.ndarray, nxt: np.ndarray, previous: np.ndarray, rounds: int):
        self.ends = places[nxt[places] == len(symbol)]
        self.suffixes = places
        for _ in range(rounds):
            self.suffixes = _refined(self.suffixes, self.ends, symbol, previous)


def merge(shards: list[Shard], symbol: np.ndarray, nxt: np.ndarray, previous: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """The merged order of all suffixes by `rounds` blocks, and for each the blocks it shares with the one before it."""
    every = np.concatenate([s.suffixes for s in shards])
    ends = np.concatenate([s.ends for s in shards])
    shard_of = np.zeros(len(symbol) + 1, np.uint16)
    for k, s in enumerate(shards):
        shard_of[s.suffixes] = k
    interleave = shard_of[every]
    shared = np.zeros(len(every), np.int8)
    group = np.full(len(symbol) + 1, -1, np.int32)  # by place: suffixes that share all blocks so far

    def dealt(interleave: np.ndarray) -> np.ndarray:
        """The suffixes in the order the interleave gives: each shard's own order stays."""
        out = np.empty_like(every)
        out[np.argsort(interleave, kind="stable")] = every
        return out

    order = every
    for depth in range(1, rounds + 1):
        interleave = shard_of[_refined(order, ends, symbol, previous)]
        order = dealt(interleave)
        together = np.zeros(len(order), bool)
        together[1:] = symbol[order[1:]] == symbol[order[:-1]]
        if depth > 1:  # a suffix that has ended shares no further block
            follow = nxt[order]
            together[1:] &= (group[follow[1:]] == group[follow[:-1]]) & (follow[1:] < len(symbol))
        shared[together] = depth
        shared[~together] = np.minimum(shared[~together], depth - 1)
        group[order] = np.cumsum(~together)
        if not together.any():
            break
    return order, shared


def repeated(texts: list[bytes], length: int) -> list[np.ndarray]:
    """For each stretch the starts (0 ...) whose string of `length` bytes starts at another place too. All distinct."""
    block = max(b for b in range(1, BLOCK + 1) if length % b == 0)
    rounds = length // block
    data = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts])
    ends = np.cumsum(sizes)
    begins = ends - sizes
    n = len(data)
    left = (np.repeat(ends, sizes) - np.arange(n)).astype(np.int32)
    symbol = np.unique(rolling(data, block), return_inverse=True)[1].astype(np.int32)
    # A repeat consists of blocks that each occur twice: places that lie in no such run of blocks are irrelevant.
    live = np.zeros(n + length, bool)
    live[: len(symbol)] = (left[: len(symbol)] >= block) & (np.bincount(symbol, left[: len(symbol)] >= block)[symbol] >= 2)
    start = live[:n] & (left >= length)
    for k in range(1, rounds):
        start &= live[k * block : n + k * block]
    useful = start.copy()
    for k in range(1, rounds):
        useful[k * block :] |= start[: n - k * block]
    found = np.zeros(n, bool)
    places = np.flatnonzero(useful).astype(np.int32)
    if len(places):
        symbol = np.concatenate([symbol, np.zeros(n - len(symbol), np.int32)])
        symbol[places] = np.unique(symbol[places], return_inverse=True)[1]
        on = np.concatenate([useful, np.zeros(block, bool)])
        nxt, previous = np.full(n, n, np.int32), np.full(n, -1, np.int32)
        nxt[places] = np.where(on[places + block] & (left[places] >= 2 * block), places + block, n)
        follows = places[nxt[places] < n]
        previous[follows + block] = follows
        shards = []
        cuts = np.searchsorted(places, [*(begins[np.searchsorted(begins, k, "right") - 1] for k in range(0, n, SHARD)), n])
        for a, b in zip(cuts, cuts[1:]):
            if a < b:
                shards.append(Shard(places[a:b], symbol, nxt, previous, rounds))
        order, shared = merge(shards, symbol, nxt, previous, rounds)
        same = shared >= rounds
        # What hashes call equal is confirmed on the bytes.
        at = np.flatnonzero(same)
        for i in range(0, len(at), 1 << 14):
            part = at[i : i + (1 << 14)]
            x, y = order[part][:, None] + np.arange(length), order[part - 1][:, None] + np.arange(length)
            same[part] = (data[x] == data[y]).all(1)
        hit = same.copy()
        hit[:-1] |= same[1:]
        found[order[hit]] = True
    return [np.flatnonzero(found[x:y]) for x, y in zip(begins.tolist(), ends.tolist())]


def runs(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, last + 1) of the runs of consecutive sorted numbers."""
    cut = np.flatnonzero(np.diff(starts) > 1) + 1
    return starts[np.concatenate([[0], cut])], starts[np.concatenate([cut - 1, [len(starts) - 1]])] + 1


def _anchored(docs: DataFrame, text: str, length: int) -> DataFrame:
    """(document, first, starts, shape, anchor, content) of every stretch of every row.

    `shape` is where its anchor lies from its first start; `content` hashes its bytes and its shape.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for document, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                data = (value or "").encode()
                if len(data) < length:
                    continue
                for first, count, at, h in stretches(data, length):
                    shape = (at - first).tolist()
                    content = [xxhash.xxh3_64_intdigest(data[a : a + c + length - 1], s) for a, c, s in zip(first.tolist(), count.tolist(), shape)]
                    columns = [pa.array(first), pa.array(count), pa.array(at - first), pa.array(h.view(np.int64)), pa.array(np.array(content, np.uint64).view(np.int64))]
                    own = pa.DictionaryArray.from_arrays(pa.array(np.zeros(len(first), np.int32)), pa.array([document], pa.binary())).cast(pa.binary())
                    for i in range(0, len(first), 1 << 16):
                        yield pa.RecordBatch.from_arrays([x.slice(i, 1 << 16) for x in (own, *columns)], names=["document", "first", "starts", "shape", "anchor", "content"])

    return docs.select("__document", text).mapInArrow(run, "document binary, first long, starts long, shape long, anchor long, content long")


def _bytes_of(docs: DataFrame, text: str, wanted: DataFrame, length: int) -> DataFrame:
    """`wanted` (document, first, starts, shape, anchor, crowded) with `bytes`: what its strings cover."""
    schema = "document binary, anchor long, first long, shape long, crowded boolean, bytes binary"
    held = wanted.groupBy("document").agg(F.collect_list(F.struct("first", "starts", "shape", "anchor", "crowded")).alias("own"))
    texts = _marked(docs.select(F.col("__document").alias("document"), F.col(text).alias("text")), "document", held, "__needed").filter("__needed").drop("__needed")
    joined = texts.join(held, "document").select("document", "text", "own")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        size = 0
        for batch in batches:
            for document, value, own in zip(*(c.to_pylist() for c in batch.columns)):
                data = value.encode()
                for x in own:
                    piece = data[x["first"] : x["first"] + x["starts"] + length - 1]
                    out.append((document, x["anchor"], x["first"], x["shape"], x["crowded"], piece))
                    size += len(piece)
                    if size > 1 << 22:
                        yield _batch(out, kinds)
                        out, size = [], 0
        if out:
            yield _batch(out, kinds)

    kinds = [pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()]
    return joined.mapInArrow(run, schema)


def _batch(rows: list[tuple], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["document", "anchor", "first", "shape", "crowded", "bytes"])


SPANS = "document binary, low long, high long"


def _merged(pieces: DataFrame, length: int) -> DataFrame:
    """Spans (document, low, high) of the repeats between pieces of one anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, last = 0, None

        def done(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
            documents, low, high = [], [], []
            for (document, _, first, data), found in zip(rows, repeated([r[3] for r in rows], length)):
                if len(found):
                    a, b = runs(found)
                    documents += [document] * len(a)
                    low += (first + a).tolist()
                    high += (first + b + length - 1).tolist()
            if low:
                yield pa.RecordBatch.from_arrays([pa.array(documents, pa.binary()), pa.array(low), pa.array(high)], names=["document", "low", "high"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[1] != last and size >= BATCH:
                    yield from done(held)
                    held, size = [], 0
                last = row[1]
                held.append(row)
                size += len(row[3])
        if held:
            yield from done(held)

    dealt = pieces.select("document", "anchor", "first", "bytes").repartition("anchor").sortWithinPartitions("anchor")
    return dealt.mapInArrow(run, SPANS)


def _counted(pieces: DataFrame, length: int) -> DataFrame:
    """The same for pieces of crowded anchors: starts by the hash of their string.

    Eight neighbouring starts, at fixed places from the anchor, are a chunk. Equal chunks repeat whole. Only the starts of
    chunks that are alone are counted one by one, together with those of one chunk of each kind.
    """

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for document, first, shape, data in zip(*(c.to_pylist() for c in batch.columns)):
                n = len(data) - length + 1
                cuts = [0, *(i for i in range(1, n) if (shape - i + 1) % 8 == 0), n]
                spans_ = list(zip(cuts, cuts[1:]))
                whole = [xxhash.xxh3_128_digest(data[a : b + length - 1]) for a, b in spans_]
                each = [[xxhash.xxh3_128_digest(data[i : i + length]) for i in range(a, b)] for a, b in spans_]
                columns = [pa.array([document] * len(whole), pa.binary()), pa.array([first + a for a in cuts[:-1]], pa.int64()), pa.array(whole, pa.binary()), pa.array(each, pa.list_(pa.binary()))]
                yield pa.RecordBatch.from_arrays(columns, names=["document", "at", "chunk", "each"])

    schema = "document binary, at long, chunk binary, each array<binary>"
    rows = written(pieces.select("document", "first", "shape", "bytes").mapInArrow(chunks, schema), "chunks")
    kinds = written(rows.groupBy("chunk").agg(F.count("*").alias("n"), F.first("each").alias("each")), "kinds")
    several = kinds.filter("n > 1").select("chunk")
    whole = rows.join(several, "chunk").select("document", F.col("at").alias("low"), (F.col("at") + F.size("each") + length - 1).alias("high"))
    alone = rows.join(several, "chunk", "left_anti").select("document", "at", F.posexplode("each").alias("i", "string"))
    counted = kinds.select(F.explode("each").alias("string")).groupBy("string").agg(F.count("*").alias("n")).filter("n > 1").select("string")
    low = F.col("at") + F.col("i")
    return whole.unionByName(alone.join(counted, "string").select("document", low.alias("low"), (low + length).alias("high")))


def spans(docs: DataFrame, text: str, length: int = 200, crowd: int = CROWD) -> DataFrame:
    """(document, spans) for each document with repeats: covering pairs low, high of byte places, which may overlap.

    `docs` has a `__document` key; rows with one key are copies of each other, and count as different places.
    """
    ship(docs.sparkSession)
    rows = written(_anchored(docs, text, length).withColumn("row", F.monotonically_increasing_id()), "stretches")
    classes = rows.groupBy("anchor", "content").agg(F.count("*").alias("n"), F.min("row").alias("row"))
    classes = written(classes, "classes")
    groups = classes.groupBy("anchor").agg(F.count("*").alias("m"), F.sum("n").alias("total")).filter("total > 1").select("anchor", "m")
    several = written(classes.join(groups, "anchor").withColumnRenamed("row", "lead"), "several")
    shared = written(rows.join(several, ["anchor", "content"]), "shared")
    whole = shared.filter("n > 1").select("document", F.col("first").alias("low"), (F.col("first") + F.col("starts") + length - 1).alias("high"))
    wanted = shared.filter("m > 1 and row = lead").select("document", "first", "starts", "shape", "anchor", (F.col("m") > crowd).alias("crowded"))
    pieces = written(_bytes_of(docs, text, wanted, length), "pieces")
    found = whole.unionByName(_merged(pieces.filter("not crowded"), length))
    if not pieces.filter("crowded").isEmpty():
        found = found.unionByName(_counted(pieces.filter("crowded"), length))
    return found.groupBy("document").agg(F.collect_set(F.struct("low", "high")).alias("spans"))


RESULT = "kept binary, n_bytes long, n_removed long, removed array<struct<low:long,high:long>>"


def _cut(data: bytes, own: list) -> tuple[bytes, list[tuple[int, int]]]:
    merged: list[list[int]] = []
    for low, high in sorted((x["low"], x["high"]) for x in own):
        if merged and low <= merged[-1][1]:
            merged[-1][1] = max(high, merged[-1][1])
        else:
            merged.append([low, high])
    kept, at = [], 0
    for low, high in merged:
        kept.append(data[at:low])
        at = high
    return b"".join([*kept, data[at:]]), [(a, b) for a, b in merged]


def dedup(docs: DataFrame, key: str, text: str, length: int = 200, crowd: int = CROWD) -> DataFrame:
    """Every row of `docs` with kept (its remaining bytes), n_bytes, n_removed and removed (maximal runs).

    A byte goes if a string of `length` bytes that covers it also starts anywhere else, in the same text or another;
    strings are judged on the input. NULL counts as empty. Repeated rows are copies of each other. Empty: no rows.
    """
    docs = docs.withColumn("__document", document_key(key, text))
    found = written(spans(docs.select("__document", text), text, length, crowd), "spans").withColumnRenamed("document", "__document")
    marked = _marked(docs, "__document", found, "__touched")
    plain = marked.filter("not __touched").withColumn("spans", F.lit(None).cast("array<struct<low:long,high:long>>"))
    changed = marked.filter("__touched").join(found, "__document", "left")
    rows = plain.unionByName(changed).drop("__document", "__touched")
    added = T._parse_datatype_string(RESULT).fields
    fields = [f for f in docs.schema.fields if f.name not in {"__document", *(a.name for a in added)}]
    names = [f.name for f in fields]
    schema = T.StructType([*fields, *added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                column = lambda n: part.column(part.schema.get_field_index(n))
                out = []
                for value, own in zip(column(text).to_pylist(), column("spans").to_pylist()):
                    data = (value or "").encode()
                    kept, gone = _cut(data, own or [])
                    out.append((kept, len(data), len(data) - len(kept), [{"low": a, "high": b} for a, b in gone]))
                kinds = [pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.struct([("low", pa.int64()), ("high", pa.int64())]))]
                yield pa.RecordBatch.from_arrays([*map(column, names), *(pa.array(c, k) for c, k in zip(zip(*out), kinds))], names=[*names, *(a.name for a in added)])

    return rows.mapInArrow(run, schema)
