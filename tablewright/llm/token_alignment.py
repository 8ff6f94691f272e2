"""How two tokenizers cut the same texts, and how common each pair of linked tokens is in the corpus.

Two tokens are linked where their byte ranges overlap. How many documents hold a pair of ids linked is read off an
inverted index: for each pair, a compressed bitmap of the documents that hold it.

1. Texts become tokens and links. Both tokenizers start anew at a space that follows other characters, so a text is cut
   there and the segments, mostly words, are remembered by each Python worker (two generations of bounded size).
2. A task numbers its documents within shards of bounded size (at most 65,536 documents and about a million links, or one
   document) and inverts the links of each shard: per pair a bitmap of documents, as 16-bit numbers or as bits, whichever
   is shorter, and bitmaps for the binary digits of (links of the pair in the document - 1): the multiplicity planes.
3. Bitmaps are merged by OR and counted. The documents of different shards differ, so a merged bitmap holds those of the
   shards side by side and its bits are the sum of theirs: a partial aggregate that moves one number per pair and task.
4. The postings return scores: joined with the count of their pair, they go back to their shard, where each bit adds the
   count to its document, times 2^k in plane k. A frequent pair is a row per shard and plane, never one per document.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from tablewright.llm.common import read_bytes, ship, written
from tablewright.llm.packing import Tokens, _alphabet
from tablewright.llm.sentence_piece import BYTE, NORMAL, SPACE, Model, PieceCodec

REMEMBERED = 200_000
SHARD_DOCS, SHARD_LINKS = 1 << 16, 1_000_000
#: Bits for one of the counts of a segment that are added as one number.
DIGITS = 32
#: Rows of postings that are read back at once.
SLICE_ROWS = 8192


class Aligner:
    """Tokens, groups and links of texts: tokenizer A is a byte-level file, B a SentencePiece model that puts a space first."""

    def __init__(self, a: bytes, pattern: str, model: bytes):
        from sentencepiece import SentencePieceProcessor

        b = Model.read(model)
        self.a, self.b, self.library = Tokens(a, pattern), PieceCodec(b), SentencePieceProcessor(model_proto=model)
        own = _alphabet()
        vocabulary = self.a.model.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.a_bytes[i] = bytes(own[c] for c in token) if all(c in own for c in token) else token.encode()
        self.b_bytes = [self._bytes(p, k) for p, k in zip(b.pieces, b.kinds)]
        self.width = len(b.pieces)
        self.cut = self._cuts([p for p, k in zip(b.pieces, b.kinds) if k == NORMAL]) if self.a.fast is not None else None
        self.young: dict[str, tuple | None] = {}
        self.old: dict[str, tuple | None] = {}

    @staticmethod
    def _bytes(piece: str, kind: int) -> bytes:
        return bytes([int(piece[3:5], 16)]) if kind == BYTE else piece.replace(SPACE, " ").encode()

    @staticmethod
    def _cuts(pieces: list[str]) -> re.Pattern | None:
        """Finds segments at whose borders both tokenizers start anew; A's pattern is known, B's pieces say what they cross.

        Borders are: before a space, line feed or tab after another character; after letters before an ASCII sign.
        """
        crossed = {(x, y) for p in pieces for x, y in zip(p, p[1:])}
        starts = "".join(c for c, own in ((" ", SPACE), ("\n", "\n"), ("\t", "\t")) if not any(y == own and not (x.isspace() or x == SPACE) for x, y in crossed))
        if not starts:
            return None
        word = "" if any(x.isalnum() and y.isascii() and not (y.isalnum() or y == "_") for x, y in crossed) else r"\s*[^\W\d_]+(?=[^\w\x80-\U0010ffff]|$)|"
        return re.compile(rf"{word}\s*\S+(?:[^\S{starts}]\s*\S*)*|\s+")

    def _resolve(self, segments: list[str]) -> list[tuple | None]:
        """(tokens of A, of B and groups in one number, groups as text, links packed) of segments; None if bytes are not kept."""
        # B's library puts a space first, which stands for the one that most segments begin with; others go by pieces.
        by_library = [self.b.model.prefix and x[0] == " " and len(x) > 1 for x in segments]
        spaced = [x[1:] for x, own in zip(segments, by_library) if own]
        whole = iter(self.library.encode(spaced, num_threads=1)) if spaced else iter(())
        out = []
        for x, spaced_first in zip(segments, by_library):
            plain = self.a.fast is not None and len(x) < 1000
            a = self.a.fast.encode_ordinary(x) if plain else np.frombuffer(self.a([x])[0], "<u4").tolist()
            b = next(whole) if spaced_first else self.b.ids(x.replace(" ", SPACE)).tolist()
            out.append(self._aligned(x, a, b))
        return out

    def _aligned(self, segment: str, a: list[int], b: list[int]) -> tuple | None:
        a_parts, b_parts = [self.a_bytes[i] for i in a], [self.b_bytes[i] for i in b]
        whole = segment.encode()
        if b"".join(a_parts) != whole or b"".join(b_parts) != whole:
            return None
        i = j = a_first = b_first = 0
        a_end, b_end = len(a_parts[0]), len(b_parts[0])
        links, groups = [], []
        while True:
            links.append(a[i] * self.width + b[j])
            if a_end == b_end:
                groups.append(f"{','.join(map(str, a[a_first:i + 1]))}|{','.join(map(str, b[b_first:j + 1]))}")
                i, j = i + 1, j + 1
                if i == len(a):
                    break
                a_first, b_first = i, j
                a_end, b_end = a_end + len(a_parts[i]), b_end + len(b_parts[j])
            elif a_end < b_end:
                i += 1
                a_end += len(a_parts[i])
            else:
                j += 1
                b_end += len(b_parts[j])
        return (len(a) << DIGITS | len(b)) << DIGITS | len(groups), ";".join(groups), array("q", links).tobytes()

    def __call__(self, texts: list[str | None]) -> list[list[tuple]]:
        """For each text, the segments' results for a space and the text; none if it is NULL or empty, or its bytes are not kept."""
        if len(self.young) >= REMEMBERED:
            self.old, self.young = self.young, {}
        known = self.young
        cut = [[] if not x or SPACE in x else self.cut.findall(" " + x) if self.cut else [" " + x] for x in texts]
        missing = [x for x in set().union(*cut) if x not in known]
        known.update((x, self.old[x]) for x in missing if x in self.old)
        missing = [x for x in missing if x not in known]
        known.update(zip(missing, self._resolve(missing)))
        out = [[known[x] for x in segments] for segments in cut]
        for x in missing:
            if len(x) > 64:
                del known[x]
        return [[] if None in found else found for found in out]


_ALIGNERS: dict[str, Aligner] = {}


def _aligner(name: str, parts: tuple) -> Aligner:
    if name not in _ALIGNERS:
        _ALIGNERS.clear()
        _ALIGNERS[name] = Aligner(*parts)
    return _ALIGNERS[name]


def aligner_of(frame: DataFrame, a_path: str, pattern: str, b_path: str) -> Callable[[], Aligner]:
    """Broadcasts both vocabularies (of the size of their files); the result gives a task its aligner."""
    spark = frame.sparkSession
    ship(spark)
    a, b = read_bytes(spark, a_path), read_bytes(spark, b_path)
    name = xxhash.xxh3_128_hexdigest(a + b + pattern.encode())
    parts = spark.sparkContext.broadcast((a, pattern, b))
    return lambda: _aligner(name, parts.value)


POSTING = "shard long, plane int, pair long, dense boolean, bits binary, n int"


def _containers(shard: int, plane: int, pair: np.ndarray, doc: np.ndarray, docs: int) -> Iterator[pa.RecordBatch]:
    """Posting rows of one plane: (pair, doc) sorted and distinct. A bitmap of `docs` bits if 16-bit numbers take more."""
    starts = np.flatnonzero(np.diff(pair, prepend=-1))
    sizes = np.diff(starts, append=len(pair))
    dense = sizes * 16 > docs

    def rows(which: np.ndarray, bits: pa.Array, is_dense: bool) -> pa.RecordBatch:
        n = len(which)
        columns = [pa.array(np.full(n, shard)), pa.array(np.full(n, plane, np.int32)), pa.array(pair[starts[which]])]
        return pa.RecordBatch.from_arrays([*columns, pa.array(np.full(n, is_dense)), bits, pa.array(sizes[which].astype(np.int32))], names=["shard", "plane", "pair", "dense", "bits", "n"])

    few = np.flatnonzero(~dense)
    if len(few):
        kept = doc[np.repeat(~dense, sizes)].astype("<u2")
        offsets = np.zeros(len(few) + 1, np.int32)
        np.cumsum(sizes[few] * 2, out=offsets[1:])
        yield rows(few, pa.Array.from_buffers(pa.binary(), len(few), [None, pa.py_buffer(offsets), pa.py_buffer(kept)]), False)
    many = np.flatnonzero(dense)
    if len(many):
        maps = []
        for k in many.tolist():
            flags = np.zeros(docs, bool)
            flags[doc[starts[k] : starts[k] + sizes[k]]] = True
            maps.append(np.packbits(flags, bitorder="little").tobytes())
        yield rows(many, pa.array(maps, pa.binary()), True)


def postings(shard: int, links: np.ndarray, doc: np.ndarray, docs: int) -> Iterator[pa.RecordBatch]:
    """The posting rows of a shard from its link occurrences: plane 0 is presence, plane k + 1 the digit 2^k of (links - 1)."""
    keys = links * SHARD_DOCS + doc
    keys.sort()
    starts = np.flatnonzero(np.diff(keys, prepend=-1))
    times = np.diff(starts, append=len(keys)) - 1
    pair, doc = keys[starts] // SHARD_DOCS, keys[starts] % SHARD_DOCS
    yield from _containers(shard, 0, pair, doc, docs)
    for digit in range(int(times.max()).bit_length()):
        more = (times >> digit & 1).astype(bool)
        yield from _containers(shard, digit + 1, pair[more], doc[more], docs)


def _inverted(frame: DataFrame, text: str, aligner: Callable[[], Aligner], groups: bool) -> DataFrame:
    """Rows of two kinds: documents (their columns but `text` in `row`, `doc` numbers them in their shard) and postings."""
    import hashlib

    others = [f.name for f in frame.schema.fields if f.name != text]
    packed = frame.select(F.struct(*(F.col(f"`{c}`") for c in others)).alias("row") if others else F.lit(None).cast("struct<none:int>").alias("row"), F.col(f"`{text}`").alias("text"))
    counted = "doc int, n_a long, n_b long, n_groups long, n_links long, groups string"
    schema = T.StructType([T.StructField("row", packed.schema["row"].dataType), *T._parse_datatype_string(counted).fields, *T._parse_datatype_string(POSTING).fields])
    arrow = {f.name: t for f, t in zip(schema.fields[1:], [pa.int32(), *[pa.int64()] * 4, pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.bool_(), pa.binary(), pa.int32()])}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        align = aligner()
        shard = TaskContext.get().partitionId() << 32
        packs, counts, doc, row_type = [], [], 0, None

        def padded(given: dict[str, pa.Array], n: int) -> pa.RecordBatch:
            columns = [given.get("row", pa.nulls(n, row_type)), *(given.get(name, pa.nulls(n, t)) for name, t in arrow.items())]
            return pa.RecordBatch.from_arrays(columns, names=["row", *arrow])

        def inverted() -> Iterator[pa.RecordBatch]:
            links = np.frombuffer(b"".join(packs), "<i8")
            if len(links):
                for made in postings(shard, links, np.repeat(np.arange(len(counts)), counts), len(counts)):
                    yield padded(dict(zip(made.schema.names, made.columns)), made.num_rows)

        for batch in batches:
            row_type = batch.schema.field("row").type
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                if doc + part.num_rows > SHARD_DOCS or sum(counts) >= SHARD_LINKS:
                    yield from inverted()
                    packs, counts, doc, shard = [], [], 0, shard + 1
                done = align(part.column("text").to_pylist())
                parts = [list(zip(*rs)) or [(0,), (), ()] for rs in done]
                total = [sum(p[0]) for p in parts]
                texts = [";".join(p[1]) for p in parts]
                packs.extend(b"".join(p[2]) for p in parts)
                links = [len(x) // 8 for x in packs[-len(done) :]]
                sums = [pa.array([t >> k * DIGITS & (1 << DIGITS) - 1 for t in total], pa.int64()) for k in (2, 1, 0)] + [pa.array(links, pa.int64())]
                told = texts if groups else [hashlib.sha256(x.encode()).hexdigest() if x else "" for x in texts]
                counts.extend(links)
                numbers = np.arange(doc, doc + len(done), dtype=np.int32)
                doc += len(done)
                given = {"row": part.column("row"), "doc": pa.array(numbers), "groups": pa.array(told), "shard": pa.array(np.full(len(done), shard))}
                yield padded(given | dict(zip(["n_a", "n_b", "n_groups", "n_links"], sums)), len(done))
        yield from inverted()

    return packed.mapInArrow(run, schema)


def _returned(scored: DataFrame) -> DataFrame:
    """(shard, doc, n_best, count_sum) of all documents with links, from postings with the score of their pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total, best, seen = None, None, None, None

        def told() -> pa.RecordBatch:
            at = np.flatnonzero(seen)
            columns = [np.full(len(at), now), at.astype(np.int32), best[at], total[at]]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["shard", "doc", "n_best", "count_sum"])

        for batch in batches:
            shards = batch.column("shard").to_numpy()
            bounds = np.flatnonzero(np.diff(shards, prepend=-1)).tolist() if len(shards) else []
            for start, stop in zip(bounds, [*bounds[1:], len(shards)]):
                if now != shards[start]:
                    if now is not None:
                        yield told()
                    now = int(shards[start])
                    total, best = np.zeros(SHARD_DOCS, np.int64), np.zeros(SHARD_DOCS, np.int64)
                    seen = np.zeros(SHARD_DOCS, bool)
                for at in range(start, stop, SLICE_ROWS):
                    rows = batch.slice(at, min(SLICE_ROWS, stop - at))
                    dense = rows.column("dense").to_numpy(zero_copy_only=False)
                    bits, sizes = rows.column("bits").to_pylist(), rows.column("n").to_numpy()
                    docs = np.concatenate([
                        np.frombuffer(b"".join(b for b, d in zip(bits, dense) if not d), "<u2").astype(np.int64),
                        *(np.flatnonzero(np.unpackbits(np.frombuffer(b, np.uint8), bitorder="little")) for b, d in zip(bits, dense) if d),
                    ])
                    order = np.concatenate([np.flatnonzero(~dense), np.flatnonzero(dense)])
                    weight = np.int64(1) << np.maximum(rows.column("plane").to_numpy().astype(np.int64) - 1, 0)
                    score = weight * rows.column("count").to_numpy()
                    top = weight * rows.column("best").to_numpy(zero_copy_only=False)
                    np.add.at(total, docs, np.repeat(score[order], sizes[order]))
                    np.add.at(best, docs, np.repeat(top[order], sizes[order]))
                    seen[docs] = True
        if now is not None:
            yield told()

    dealt = scored.repartition("shard").sortWithinPartitions("shard")
    return dealt.mapInArrow(run, "shard long, doc int, n_best long, count_sum long")


def pair_counts(posted: DataFrame, width: int) -> DataFrame:
    """(pair, a, b, count, best) of every linked id pair: in how many documents, and whether no pair of that A id has more."""
    counts = posted.filter("plane = 0").groupBy("pair").agg(F.sum("n").alias("count"))
    counts = counts.select("pair", F.expr(f"pair div {width}L").alias("a"), F.expr(f"pair % {width}L").alias("b"), "count")
    counts = written(counts, "pairs")
    return counts.join(counts.groupBy("a").agg(F.max("count").alias("most")), "a").select("pair", "a", "b", "count", (F.col("count") == F.col("most")).alias("best"))


def align(frame: DataFrame, text: str, a_path: str, pattern: str, b_path: str, groups: bool = False) -> DataFrame:
    """The columns of `frame` but `text`, with n_a, n_b, n_groups, n_links, n_best, count_sum (long) and `groups`.

    Both tokenizers read a space and the text; strings of special tokens are plain text. Tokens of A and B are linked where
    their bytes overlap; where both end, a group ends. `groups` is the text `a1,a2|b1;a3|b2,b3` if asked for, else its
    SHA-256. A pair's count is the number of rows that hold it linked: repeated rows count each. count_sum adds the counts
    of all links; n_best counts links whose pair no other pair of its A id exceeds, ties included.

    NULL and empty texts, and texts whose bytes one tokenizer does not keep, have no tokens: zeros and an empty `groups`.
    Columns of `frame` with the names of results are replaced. An empty table gives no rows.
    """
    aligner = aligner_of(frame, a_path, pattern, b_path)
    width = len(Model.read(read_bytes(frame.sparkSession, b_path)).pieces)
    both = written(_inverted(frame, text, aligner, groups), "postings")
    posted = both.filter("doc is null").select("shard", "plane", "pair", "dense", "bits", "n")
    # The pairs grow with the corpus: never broadcast, however few they are.
    counts = pair_counts(posted, width).select("pair", "count", "best").hint("merge")
    scored = posted.join(counts, "pair").select("shard", "plane", "dense", "bits", "n", "count", "best")
    docs = both.filter("doc is not null").select("row", "shard", "doc", "n_a", "n_b", "n_groups", "n_links", "groups")
    done = docs.join(_returned(scored), ["shard", "doc"], "left")
    made = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]
    own = [F.col("row").getField(c).alias(c) for c in frame.columns if c not in {text, *made}]
    zero = F.lit(0).cast("long")
    return done.select(*own, "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"), "groups")
