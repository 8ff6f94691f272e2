"""SentencePiece models of the merge (BPE) type: text to ids and back, exactly as the model's own library does.

Merging takes, again and again, the adjacent pair whose union is the best piece, leftmost first. A sequence of pieces is
what merging gives if and only if every two neighbours stay apart when their joined characters are merged again: the
first merge across a border would also come first among these two pieces alone. So encoding is a search, not merging:

1. Where no piece of the vocabulary reaches across (before a run of spaces, around a character that is in no piece) the
   text is cut, so what follows concerns segments, mostly words.
2. At each place an Aho-Corasick automaton gives the longest piece. It is taken if merging it again with the piece before
   keeps them apart; otherwise its next shorter prefix is tried. If none is left, the place has failed: a bitfield notes
   it and the last piece is shortened. A prefix has one valid sequence only, so a failed place need never be entered
   again and the work is linear in the length of the segment.

Segments repeat, so each Python worker remembers resolved ones in two generations of bounded size, and the outcome of
re-merging two pieces likewise: a memory only, what it forgets is resolved again.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, types as T

from tablewright.llm.common import read_bytes, ship

SPACE = "▁"
REMEMBERED = 200_000
SLICE_ROWS = 512
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6


@dataclass(frozen=True)
class Model:
    """What encoding needs of a model file: per id its piece, score and kind, and whether a space is put first."""

    pieces: tuple[str, ...]
    scores: tuple[float, ...]
    kinds: tuple[int, ...]
    prefix: bool

    @staticmethod
    def read(content: bytes) -> Model:
        """Takes merge-type models without a normalisation map, with byte fallback; ValueError for any other."""
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(content)
        how, trained = proto.normalizer_spec, proto.trainer_spec
        kinds = tuple(p.type for p in proto.pieces)
        plain = how.escape_whitespaces and not how.remove_extra_whitespaces and not how.precompiled_charsmap
        if trained.model_type != 2 or not trained.byte_fallback or trained.treat_whitespace_as_suffix or not plain:
            raise ValueError("only merge-type models with byte fallback and plain white space are supported")
        if set(kinds) - {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("user-defined and unused pieces are not supported")
        return Model(tuple(p.piece for p in proto.pieces), tuple(p.score for p in proto.pieces), kinds, how.add_dummy_prefix)


class PieceCodec:
    """Encoder and decoder of one model."""

    def __init__(self, model: Model):
        self.model = model
        normal = [i for i, kind in enumerate(model.kinds) if kind == NORMAL]
        scores = sorted({model.scores[i] for i in normal}, reverse=True)
        order = {s: r for r, s in enumerate(scores)}
        self.rank = {model.pieces[i]: order[model.scores[i]] for i in normal}
        self.id_of = {model.pieces[i]: i for i in normal}
        self.byte_id = {int(model.pieces[i][3:5], 16): i for i, kind in enumerate(model.kinds) if kind == BYTE}
        self.end_id = next(i for i, p in enumerate(model.pieces) if p == "</s>" and model.kinds[i] == CONTROL)
        self.unknown = model.pieces[model.kinds.index(UNKNOWN)]
        self._search(sorted(set("".join(self.rank))))
        self._surfaces()
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.pairs: dict[tuple[str, str], bool] = {}

    def _search(self, characters: list[str]) -> None:
        """The automaton over all pieces that merging can reach, and over each character by itself."""
        reached = [p for p in self.rank if self.merged(p) == [p]]
        tokens = sorted(set(reached) | set(characters), key=len)
        self.automaton = ahocorasick.Automaton()
        for token in tokens:
            self.automaton.add_word(token, token)
        self.automaton.make_automaton()
        known = set(tokens)
        self.shorter = {t: next((t[:n] for n in range(len(t) - 1, 0, -1) if t[:n] in known), None) for t in tokens}
        plain = "".join(map(re.escape, (c for c in characters if c != SPACE)))
        crossing = any(a != SPACE and b == SPACE for p in self.rank for a, b in zip(p, p[1:]))
        inside = f"[{SPACE}{plain}]+" if crossing else f"{SPACE}*[{plain}]+|{SPACE}+"
        self.segments = re.compile(rf"(?s){inside}|." if plain else rf"(?s){SPACE}+|.")

    def _surfaces(self) -> None:
        surface = []
        for piece, kind in zip(self.model.pieces, self.model.kinds):
            if kind == BYTE:
                surface.append(bytes([int(piece[3:5], 16)]))
            else:
                surface.append({CONTROL: "", UNKNOWN: " ⁇ "}.get(kind, piece.replace(SPACE, " ")).encode())
        self.surface = surface
        # Bytes on both sides of a control piece are no character together: no UTF-8, so `decode` looks closer.
        self.strict = [b"\xff" if kind == CONTROL else own for own, kind in zip(surface, self.model.kinds)]

    def merged(self, piece: str) -> list[str]:
        """Merges by the rule itself, one pair after the other. Only for pieces and pairs of pieces, which are short."""
        parts, rank = list(piece), self.rank
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = rank.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def apart(self, left: str, right: str) -> bool:
        """Whether merging the characters of both pieces again gives these two pieces."""
        key = (left, right)
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) >= REMEMBERED:
                self.pairs.clear()
            found = self.pairs[key] = self.merged(left + right) == [left, right]
        return found

    def split(self, segment: str) -> list[str]:
        """The pieces of a segment of known characters, by backtracking."""
        out: list[str] = []
        failed = bytearray(len(segment) // 8 + 1)
        longest, shorter, apart = self.automaton.iter_long, self.shorter, self.apart
        at, n, token = 0, len(segment), None
        while at < n:
            if token is None:
                token = next(longest(segment, at))[1]
            end = at + len(token)
            if not failed[end >> 3] >> (end & 7) & 1 and (not out or apart(out[-1], token)):
                out.append(token)
                at, token = end, None
                continue
            token = shorter[token]
            while token is None:  # nothing fits here: what led here goes again, one character or more shorter
                failed[at >> 3] |= 1 << (at & 7)
                last = out.pop()
                at -= len(last)
                token = shorter[last]
        return out

    def _resolved(self, segment: str, ids: array) -> None:
        """Appends the ids of a segment (spaces as in pieces)."""
        for piece in self.split(segment) if segment[0] in self.shorter else (segment,):
            own = self.id_of.get(piece)
            if own is None:  # a character that is no piece
                ids.extend([self.byte_id[b] for b in piece.encode()])
            else:
                ids.append(own)

    def ids(self, normal: str) -> array:
        """The ids of a text as `pieces_of` takes it, without memory."""
        ids = array("I")
        for segment in self.segments.findall(normal):
            self._resolved(segment, ids)
        return ids

    def resolve(self, segment: str) -> bytes:
        """The ids of a segment as little-endian 32-bit numbers."""
        found = self.old.get(segment)
        if found is None:
            ids = array("I")
            self._resolved(segment, ids)
            found = ids.tobytes()
        if len(self.young) >= REMEMBERED:
            self.old, self.young = self.young, {}
        if len(segment) <= 64:
            self.young[segment] = found
        return found

    def pieces_of(self, normal: str) -> bytes:
        """The packed ids of a text whose spaces are as in pieces and that has its prefix already."""
        known, resolve, parts = self.young, self.resolve, []
        for segment in self.segments.findall(normal):
            found = known.get(segment)
            if found is None:
                found = resolve(segment)
                known = self.young
            parts.append(found)
        return b"".join(parts)

    def encode(self, text: str, end: bool = True) -> bytes:
        """The packed ids of a text, the end id last if asked for. An empty text has no others."""
        normal = text.replace(" ", SPACE)
        ids = self.pieces_of(SPACE + normal if self.model.prefix and text else normal)
        return ids + self.end_id.to_bytes(4, "little") if end else ids

    def decode(self, ids: bytes) -> str:
        """The text that packed ids stand for. Bytes that are no UTF-8 become U+FFFD, each by itself."""
        numbers = np.frombuffer(ids, "<u4").tolist()
        kinds = self.model.kinds
        while numbers and kinds[numbers[-1]] == CONTROL:
            numbers.pop()
        try:
            text = b"".join(map(self.strict.__getitem__, numbers)).decode()
        except UnicodeDecodeError:
            text = self._mended(numbers)
        first = next((i for i in numbers if kinds[i] != CONTROL), None)
        if self.model.prefix and first is not None and kinds[first] == NORMAL and self.model.pieces[first].startswith(SPACE):
            return text[1:]
        return text

    def _mended(self, numbers: list[int]) -> str:
        out, run = [], bytearray()
        for i in [*numbers, None]:
            if i is not None and self.model.kinds[i] == BYTE:
                run += self.surface[i]
                continue
            at = 0
            while at < len(run):
                for n in range(1, 5):
                    try:
                        out.append(run[at : at + n].decode())
                        at += n
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    out.append("�")
                    at += 1
            run.clear()
            if i is not None:
                out.append(self.surface[i].decode())
        return "".join(out)


_CODECS: dict[str, PieceCodec] = {}


def codec_of(name: str, model: Model) -> PieceCodec:
    """One codec for each model and worker process."""
    if name not in _CODECS:
        _CODECS.clear()
        _CODECS[name] = PieceCodec(model)
    return _CODECS[name]


def shared(frame: DataFrame, path: str) -> Callable[[], PieceCodec]:
    """Broadcasts the model in a file (its size is that of the vocabulary); the result gives a task its codec."""
    spark = frame.sparkSession
    ship(spark)
    content = read_bytes(spark, path)
    name = xxhash.xxh3_128_hexdigest(content)
    model = spark.sparkContext.broadcast(Model.read(content))
    return lambda: codec_of(name, model.value)


def _lists(parts: list[bytes | None]) -> pa.Array:
    """Packed ids as an array of lists of integers."""
    sizes = np.array([0 if p is None else len(p) // 4 for p in parts], np.int64)
    offsets = np.zeros(len(parts) + 1, np.int32)
    np.cumsum(sizes, out=offsets[1:])
    values = pa.array(np.frombuffer(b"".join(p or b"" for p in parts), "<u4").astype(np.int32), pa.int32())
    mask = pa.array([p is None for p in parts], pa.bool_())
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values, mask=mask if mask.true_count else None)


def _added(frame: DataFrame, fields: dict[str, T.DataType], work: Callable[[pa.RecordBatch], list[pa.Array]]) -> DataFrame:
    """Adds (or replaces) columns that `work` makes of slices of rows; rows and partitions stay: no shuffle."""
    kept = [f for f in frame.schema.fields if f.name not in fields]
    names = [f.name for f in kept]
    schema = T.StructType([*kept, *(T.StructField(n, t) for n, t in fields.items())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(start, SLICE_ROWS)
                own = [part.column(part.schema.get_field_index(n)) for n in names]
                yield pa.RecordBatch.from_arrays([*own, *work(part)], names=[*names, *fields])

    return frame.mapInArrow(run, schema)


IDS = T.ArrayType(T.IntegerType())


def encode(frame: DataFrame, text: str, path: str, end: bool = True, into: str = "ids") -> DataFrame:
    """Adds column `into`: the ids (array of int) of each whole text, the end id last unless `end` is False.

    NULL stays NULL; an empty text has the end id alone. No sampling, no start id. A column named `into` is replaced.
    Repeated rows are encoded alike; an empty table gives no rows.
    """
    codec = shared(frame, path)

    def work(part: pa.RecordBatch) -> list[pa.Array]:
        texts = part.column(part.schema.get_field_index(text)).to_pylist()
        return [_lists([None if x is None else codec().encode(x, end) for x in texts])]

    return _added(frame, {into: IDS}, work)


def decode(frame: DataFrame, ids: str, path: str, into: str = "decoded") -> DataFrame:
    """Adds column `into`: the text that arrays of ids stand for. NULL stays NULL; an id outside the model is an error."""
    codec = shared(frame, path)

    def work(part: pa.RecordBatch) -> list[pa.Array]:
        lists = part.column(part.schema.get_field_index(ids)).to_pylist()
        return [pa.array([None if x is None else codec().decode(np.array(x, "<u4").tobytes()) for x in lists], pa.string())]

    return _added(frame, {into: T.StringType()}, work)


def round_trip(frame: DataFrame, text: str, path: str, end: bool = True) -> DataFrame:
    """Adds `ids` and `decoded`, the text the ids stand for, in one pass; as `encode` and then `decode`."""
    codec = shared(frame, path)

    def work(part: pa.RecordBatch) -> list[pa.Array]:
        own = codec()
        ids = [None if x is None else own.encode(x, end) for x in part.column(part.schema.get_field_index(text)).to_pylist()]
        return [_lists(ids), pa.array([None if x is None else own.decode(x) for x in ids], pa.string())]

    return _added(frame, {"ids": IDS, "decoded": T.StringType()}, work)
