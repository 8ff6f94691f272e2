"""Byte-level BPE: text to ids and back.

Two tiers resolve a pre-token. A minimal perfect hash over the vocabulary answers when the whole pre-token is one
entry. Otherwise its bytes form a linked list, and a heap of adjacent pairs, lowest rank first, merges them.
Pre-tokens repeat, so each Python worker remembers resolved ones in two generations of bounded size: a memory
only, what it forgets is resolved again.

The vocabulary is read once by the driver and broadcast; its size is that of the vocabulary file.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, types as T

from tablewright.llm.common import read_bytes, ship

REMEMBERED = 300_000
SLICE_ROWS = 512
MASK = (1 << 64) - 1
STEP = 0x9E3779B97F4A7C15
MIX = 0xD6E8FEB86659FD93


class PerfectHash:
    """A minimal perfect hash by displacement: n keys, n slots, one probe and one comparison a lookup.

    Keys fall into about n / 2 buckets. Largest buckets first, each bucket looks for a displacement that sends all
    its keys to free slots; a bucket of one key simply takes a free slot, noted as a negative number.
    """

    def __init__(self, keys: list[bytes]):
        n = self.size = max(1, len(keys))
        self.buckets = n // 2 + 1
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys))
        order = np.argsort(hashes % np.uint64(self.buckets), kind="stable")
        parts = np.split(order, np.flatnonzero(np.diff(hashes[order] % np.uint64(self.buckets))) + 1) if keys else []
        self.shift = np.zeros(self.buckets, np.int64)
        taken = np.zeros(n, bool)
        self.at = np.full(n, -1, np.int64)
        single = []
        for part in sorted(parts, key=len, reverse=True):
            own = hashes[part]
            bucket = int(own[0] % np.uint64(self.buckets))
            if len(part) == 1:
                single.append((bucket, int(part[0])))
                continue
            d = 0
            while True:
                slots = self._slots(own, np.int64(d))
                if not taken[slots].any() and len(set(slots.tolist())) == len(part):
                    break
                d += 1
            taken[slots] = True
            self.shift[bucket], self.at[slots] = d, part
        for (bucket, key), slot in zip(single, np.flatnonzero(~taken).tolist()):
            self.shift[bucket], self.at[slot] = -slot - 1, key

    def _slots(self, hashes: np.ndarray, shift) -> np.ndarray:
        with np.errstate(over="ignore"):
            mixed = (hashes ^ (np.asarray(shift).astype(np.uint64) * np.uint64(STEP))) * np.uint64(MIX)
        return ((mixed >> np.uint64(32)) % np.uint64(self.size)).astype(np.int64)

    def __call__(self, key: bytes) -> int:
        """The number of the only key this could be, or -1."""
        h = xxhash.xxh3_64_intdigest(key)
        shift = int(self.shift[h % self.buckets])
        if shift < 0:
            return int(self.at[-shift - 1])
        return int(self.at[((((h ^ (shift * STEP & MASK)) * MIX) & MASK) >> 32) % self.size])


class Codec:
    """Encoder and decoder of one vocabulary: `vocabulary` holds lines "base64 rank", `pattern` splits text."""

    def __init__(self, vocabulary: bytes, pattern: str, index: PerfectHash | None = None):
        self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in vocabulary.splitlines() if line.strip())}
        self.keys = list(self.ranks)
        self.ids = [self.ranks[k] for k in self.keys]
        self.index = index or PerfectHash(self.keys)
        self.bytes_of = {i: k for k, i in self.ranks.items()}
        self.pattern = regex.compile(pattern)
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def whole(self, piece: bytes) -> int | None:
        """First tier: the id of a pre-token that is one entry of the vocabulary."""
        at = self.index(piece)
        return self.ids[at] if at >= 0 and self.keys[at] == piece else None

    def merged(self, piece: bytes) -> list[int]:
        """Second tier: repeatedly merges the adjacent pair of lowest rank, leftmost first."""
        n, ranks = len(piece), self.ranks
        end = list(range(1, n + 1))  # end[i]: where the part that starts at i stops; the next part starts there
        before = list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            middle = end[i]
            if middle < 0 or middle >= n or end[middle] != stop:
                continue  # one of the two parts has changed since
            end[i], end[middle] = stop, -1
            if stop < n:
                before[stop] = i
                if (r := ranks.get(piece[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if (left := before[i]) >= 0 and (r := ranks.get(piece[left:stop])) is not None:
                heapq.heappush(heap, (r, left, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = end[i]
        return out

    def resolve(self, token: str) -> bytes:
        """The ids of a pre-token as little-endian 32-bit numbers."""
        found = self.old.get(token)
        if found is None:
            piece = token.encode()
            one = self.whole(piece)
            found = np.array([one] if one is not None else self.merged(piece), "<u4").tobytes()
        if len(self.young) >= REMEMBERED:
            self.old, self.young = self.young, {}
        if len(token) <= 64:
            self.young[token] = found
        return found

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian 32-bit numbers."""
        known, resolve = self.young.get, self.resolve
        parts = []
        for token in self.pattern.findall(text):
            found = known(token)
            if found is None:
                found = resolve(token)
                known = self.young.get
            parts.append(found)
        return b"".join(parts)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_CODECS: dict[str, Codec] = {}


def _codec(shared) -> Codec:
    """One codec for each broadcast and worker process."""
    if shared.id not in _CODECS:
        _CODECS.clear()
        _CODECS[shared.id] = Codec(*shared.value)
    return _CODECS[shared.id]


class _Shared:
    """A broadcast with a name that worker processes know it by."""

    def __init__(self, broadcast, name: str):
        self.broadcast, self.id = broadcast, name

    @property
    def value(self):
        return self.broadcast.value


def _share(frame: DataFrame, path: str, pattern: str) -> _Shared:
    ship(frame.sparkSession)
    vocabulary = read_bytes(frame.sparkSession, path)
    built = Codec(vocabulary, pattern)
    name = xxhash.xxh3_128_hexdigest(vocabulary + pattern.encode())
    return _Shared(frame.sparkSession.sparkContext.broadcast((vocabulary, pattern, built.index)), name)


def mapped(frame: DataFrame, source: str, target: str, work_of) -> DataFrame:
    """Adds (or replaces) binary column `target`: work_of() gives a function of a value of `source`, NULL to NULL.

    Rows pass in slices, so memory holds a few hundred results at a time.
    """
    kept = [f for f in frame.schema.fields if f.name != target]
    schema = T.StructType([*kept, T.StructField(target, T.BinaryType())])
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = work_of()
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(start, SLICE_ROWS)
                values = part.column(part.schema.get_field_index(source)).to_pylist()
                made = pa.array([None if v is None else work(v) for v in values], pa.binary())
                yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(n)) for n in names), made], names=[*names, target])

    return frame.mapInArrow(run, schema)


def encode(frame: DataFrame, text: str, path: str, pattern: str, into: str = "ids") -> DataFrame:
    """Adds column `into`: the ids of each whole text as packed little-endian unsigned 32-bit numbers.

    NULL stays NULL, an empty text has no ids; special tokens are never made. Rows and partitions stay as they are:
    no shuffle. A column named `into` is replaced.
    """
    shared = _share(frame, path, pattern)
    return mapped(frame, text, into, lambda: _codec(shared).encode)


def decode(frame: DataFrame, ids: str, path: str, pattern: str, into: str = "decoded") -> DataFrame:
    """Adds column `into`: the bytes that packed ids stand for. NULL stays NULL."""
    shared = _share(frame, path, pattern)
    return mapped(frame, ids, into, lambda: _codec(shared).decode)


def round_trip(frame: DataFrame, text: str, path: str, pattern: str) -> DataFrame:
    """Adds `ids` and `decoded`, both from one broadcast of the vocabulary."""
    shared = _share(frame, path, pattern)
    encoded = mapped(frame, text, "ids", lambda: _codec(shared).encode)
    return mapped(encoded, "ids", "decoded", lambda: _codec(shared).decode)
