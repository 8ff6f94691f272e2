"""Vector bin packing of token pieces into training sequences.

A piece needs room in three dimensions at once: tokens, segments (one) and loss-bearing tokens. The dot-product
heuristic fills one sequence after the other: of the pieces that still fit, it places the one whose need has the
largest dot product with the room left, each dimension weighted by how scarce it is.

Pieces are packed where they are, in buffers of bounded size, so there is no shuffle and a lost executor costs its
partitions only: the same partition gives the same sequences again.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, types as T

from tablewright.llm.common import read_bytes, ship

BATCH_PIECES = 2_000


@dataclass(frozen=True)
class Limits:
    """What a sequence may hold. `buffer`: pieces (below a full sequence) that are packed together."""

    tokens: int = 2048
    segments: int = 256
    loss: int = 2048
    buffer: int = 8192


def dot_product_bins(needs: np.ndarray, room: np.ndarray) -> list[list[int]]:
    """Bins of row numbers of `needs` (n x d, each row within `room`).

    Equal needs are one kind with a count, so a step looks at kinds, not at pieces. Ties go to the larger first
    dimension, then to the earlier piece.
    """
    if not len(needs):
        return []
    kinds, of = np.unique(needs, axis=0, return_inverse=True)
    kinds, of = kinds[::-1], len(kinds) - 1 - of.ravel()  # larger first: argmax takes the first of equals
    order = np.argsort(of, kind="stable")
    starts = np.searchsorted(of[order], np.arange(len(kinds) + 1))
    nxt, left = starts[:-1].copy(), np.diff(starts)
    share = kinds / room
    weight = (share * left[:, None]).sum(0)
    share = share * (weight / max(weight.max(), 1e-12))
    bins, remaining = [], len(needs)
    while remaining:
        free, own = room.astype(np.int64).copy(), []
        while True:
            fits = (left > 0) & (kinds <= free).all(1)
            if not fits.any():
                break
            k = int(np.argmax(np.where(fits, share @ (free / room), -1.0)))
            own.append(int(order[nxt[k]]))
            nxt[k] += 1
            left[k] -= 1
            free -= kinds[k]
        bins.append(own)
        remaining -= len(own)
    return bins


def cut(ids: np.ndarray, loss: np.ndarray | None, limits: Limits) -> Iterator[tuple[int, int, int]]:
    """(start, length, loss-bearing tokens) of the pieces of one example: as long as the limits let them be."""
    n, at = len(ids), 0
    if loss is None:
        step = min(limits.tokens, limits.loss)
        for at in range(0, n, step):
            yield at, min(step, n - at), min(step, n - at)
        return
    total = np.concatenate([[0], np.cumsum(loss)])
    while at < n:
        stop = min(n, at + limits.tokens, int(np.searchsorted(total, total[at] + limits.loss, "right")) - 1)
        yield at, stop - at, int(total[stop] - total[at])
        at = stop


#: White space longer than this in one run goes to the tokenizers library, whose pattern matcher has no stack to overflow.
LONG_SPACE = regex.compile(r"\s{1000}")


def _alphabet() -> dict[str, int]:
    """The character that stands for each byte in byte-level files: printable ones for themselves, others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = (b for b in range(256) if b not in set(plain))
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class Tokens:
    """Ids of whole texts by a tokenizers file; special tokens' strings are ordinary text.

    A file that holds plain byte-level BPE, with merges in the order of their ids, runs in the faster tiktoken engine on
    ranks read from it, with the same ids. Any other file runs in the tokenizers library.
    """

    def __init__(self, model: bytes, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_str(model.decode())
        self.model.encode_special_tokens = True
        self.fast = self._engine(json.loads(model), pattern)

    @staticmethod
    def _engine(file: dict, pattern: str):
        inner, split = file["model"], file.get("pre_tokenizer") or {}
        plain = inner.get("type") == "BPE" and not any(inner.get(k) for k in ("dropout", "end_of_word_suffix", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
        if not plain or file.get("normalizer") or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex"):
            return None
        own, vocabulary = _alphabet(), inner["vocab"]
        special = {t["content"] for t in file.get("added_tokens", ())}
        ids = [vocabulary.get("".join(m if isinstance(m, list) else m.split(" ")), -1) for m in inner["merges"]]
        ranks = {bytes(map(own.__getitem__, word)): i for word, i in vocabulary.items() if word not in special}
        if ids != sorted(ids) or -1 in ids or any(bytes([b]) not in ranks for b in range(256)) or len(ranks) != 256 + len(ids):
            return None
        import tiktoken

        return tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as packed little-endian 32-bit numbers."""
        if self.fast is not None:
            return [self._one(x) for x in texts]
        return [np.array(e.ids, "<u4").tobytes() for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def _one(self, text: str) -> bytes:
        if LONG_SPACE.search(text):
            return np.array(self.model.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes()


PIECE = "start long, length long, n_loss long, ids binary, doc_tokens long, sequence_id long, offset long"


def pack(
    examples: DataFrame,
    key: str,
    text: str,
    model: str,
    pattern: str,
    end_id: int | None = 1,
    limits: Limits = Limits(),
) -> DataFrame:
    """Packs every whole text into sequences; one row per piece.

    Returns `key`, start, length, n_loss, ids (packed little-endian), doc_tokens, sequence_id, offset. Each example
    is its ids and then `end_id` (None: nothing added); NULL text is empty. An example beyond a limit is cut into
    pieces as long as the limit allows. All tokens bear loss. Repeated rows are packed each for itself; an empty
    table gives no rows. `sequence_id` is unique over the table, offsets have no gap.
    """
    schema = T.StructType([T.StructField(key, examples.schema[key].dataType), *T._parse_datatype_string(PIECE).fields])
    ship(examples.sparkSession)
    shared = examples.sparkSession.sparkContext.broadcast((read_bytes(examples.sparkSession, model), pattern))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens(*shared.value)
        end = b"" if end_id is None else np.array([end_id], "<u4").tobytes()

        def pieces() -> Iterator[tuple]:
            for batch in batches:
                keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                for i in range(0, len(keys), 256):
                    made = tokens([x or "" for x in texts[i : i + 256]])
                    for own, ids in zip(keys[i : i + 256], made):
                        ids += end
                        n = len(ids) // 4
                        for start, length, loss in cut(range(n), None, limits):
                            yield own, start, length, loss, ids[4 * start : 4 * (start + length)], n

        yield from packed(pieces(), schema, limits)

    return examples.select(key, text).mapInArrow(run, schema)


def pack_pieces(pieces: DataFrame, key: str, limits: Limits = Limits()) -> DataFrame:
    """Packs examples that are tokens already: `key`, ids (packed), loss (packed bytes 0 or 1, one a token; NULL: all bear).

    For instruction data: prompt tokens bear no loss, answers do. Same result as `pack`.
    """
    ship(pieces.sparkSession)
    schema = T.StructType([T.StructField(key, pieces.schema[key].dataType), *T._parse_datatype_string(PIECE).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def own() -> Iterator[tuple]:
            for batch in batches:
                for k, ids, loss in zip(*(batch.column(i).to_pylist() for i in range(3))):
                    ids = ids or b""
                    n = len(ids) // 4
                    flags = None if loss is None else np.frombuffer(loss, np.uint8)
                    for start, length, bearing in cut(range(n), flags, limits):
                        yield k, start, length, bearing, ids[4 * start : 4 * (start + length)], n

        yield from packed(own(), schema, limits)

    return pieces.select(key, "ids", "loss").mapInArrow(run, schema)


def packed(pieces: Iterator[tuple], schema: T.StructType, limits: Limits) -> Iterator[pa.RecordBatch]:
    """Record batches of placed pieces. Full pieces go out alone; the others wait in a buffer for company."""
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    room = np.array([limits.tokens, limits.segments, limits.loss])
    sequence = TaskContext.get().partitionId() << 40
    out: list[tuple] = []
    waiting: list[tuple] = []

    def flush() -> None:
        nonlocal sequence
        needs = np.array([(p[2], 1, p[3]) for p in waiting], np.int64).reshape(-1, 3)
        for members in dot_product_bins(needs, room):
            offset = 0
            for m in members:
                out.append((*waiting[m], sequence, offset))
                offset += waiting[m][2]
            sequence += 1
        waiting.clear()

    def ready(least: int) -> Iterator[pa.RecordBatch]:
        while len(out) >= max(1, least):
            part = out[:BATCH_PIECES]
            del out[:BATCH_PIECES]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part), arrow)], schema=arrow)

    for piece in pieces:
        if piece[2] == limits.tokens or piece[3] == limits.loss:
            out.append((*piece, sequence, 0))
            sequence += 1
        else:
            waiting.append(piece)
            if len(waiting) >= limits.buffer:
                flush()
        yield from ready(BATCH_PIECES)
    flush()
    yield from ready(1)
