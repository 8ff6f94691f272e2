"""SentencePiece codec and alignment of two tokenizers, against the libraries and brute force."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tablewright.llm import queries, sentence_piece, token_alignment

GIVEN = "/root/testdata/sf0.001"
PIECES, BYTES = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    "", " ", "  ", "a", " " * 33, " " * 1000, "\n\n", "▁", "▁▁ a▁ b", "<s> </s> <0x41> <|endoftext|>", "日本語テキスト 中文", "😀😀é", "\r\n x;\r\n",
    "a" * 5000, "ab" * 3000 + "  " * 7, "\x00\x01\x1c\x85\xa0", "�", " \n x\n\n  y", "it's  12\n\n\nKſ",
]
PARTS = ["a", "b", "t", "he", "in", " ", "  ", "▁", "\n", "\r", ";", "é", "😀", "中", "<0x0A>", "1", "23", "ing", "tion", " (", "=", "\t", "'s", "\x1c", "\x85", "\xa0"]


def given(spark, path):
    return [tuple(r) for r in spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


@pytest.fixture(scope="module")
def codec():
    with open(PIECES, "rb") as file:
        return sentence_piece.PieceCodec(sentence_piece.Model.read(file.read()))


def random_texts(n, seed):
    draw = random.Random(seed)
    return ["".join(draw.choice(PARTS) for _ in range(draw.randrange(30))) for _ in range(n)]


def test_pieces_are_those_of_the_library(codec, library):
    draw = random.Random(5)
    pieces = list(codec.rank)
    for text in [*ODD, *random_texts(1500, 4), *("".join(draw.choice(pieces) for _ in range(draw.randrange(12))) for _ in range(1500))]:
        ids = np.frombuffer(codec.encode(text), "<u4").tolist()
        assert ids == library.encode(text, add_eos=True)
        assert codec.decode(codec.encode(text)) == library.decode(ids)


def test_any_ids_decode_like_the_library(codec, library):
    draw = random.Random(6)
    for _ in range(500):
        ids = [draw.choice([draw.randrange(32000), draw.randrange(300), 0, 2]) for _ in range(draw.randrange(9))]
        assert codec.decode(np.array(ids, "<u4").tobytes()) == library.decode(ids)


def test_backtracking_meets_failed_places(codec):
    """Some words need a shorter piece than the longest; the search agrees with merging whole words."""
    draw = random.Random(8)
    pieces = [p for p in codec.rank if len(p) < 9]
    shortened = 0
    for _ in range(2000):
        word = "".join(draw.choice(pieces) for _ in range(3))
        for part in codec.segments.findall(word):
            if part[0] in codec.shorter:
                found = codec.split(part)
                assert found == codec.merged(part)
                shortened += found[0] != next(codec.automaton.iter_long(part, 0))[1]
    assert shortened > 20


@pytest.mark.parametrize("where", ["folder", "given", "empty_folder"])
def test_sentence_piece_query(spark, request, library, where):
    path = GIVEN if where == "given" else request.getfixturevalue(where)
    got = Counter(tuple(r) for r in queries.QUERIES["op11_sentence_piece"](spark, path).collect())
    expected = Counter()
    for key, text in given(spark, path):
        ids = library.encode(text or "", add_eos=True)
        digests = [hashlib.sha256(x.encode()).hexdigest() for x in (" ".join(map(str, ids)), library.decode(ids))]
        expected[(key, len(ids), *digests)] += 1
    assert got == expected


def test_piece_columns(spark):
    """NULL stays NULL, clashing columns are replaced, others stay; ids decode by themselves."""
    docs = spark.createDataFrame([(1, None, 5, "k"), (2, "", 5, "k"), (2, "a b", 5, "k")], "doc_id long, text string, ids int, line string")
    coded = sentence_piece.encode(docs, "text", PIECES)
    rows = {(r["doc_id"], r["text"]): r for r in sentence_piece.decode(coded, "ids", PIECES, into="line").collect()}
    assert rows[(1, None)]["ids"] is None and rows[(1, None)]["line"] is None
    assert rows[(2, "")]["ids"] == [2] and rows[(2, "a b")]["line"] == "a b"
    assert sentence_piece.encode(docs, "text", PIECES, end=False).filter("text = ''").first()["ids"] == []


def test_only_models_of_the_kind(spark):
    from sentencepiece import sentencepiece_model_pb2

    with open(PIECES, "rb") as file:
        content = file.read()
    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(content)
    proto.normalizer_spec.remove_extra_whitespaces = True
    with pytest.raises(ValueError):
        sentence_piece.Model.read(proto.SerializeToString())


def aligned(texts, library):
    """(n_a, n_b, n_groups, n_links, n_best, count_sum, groups) of each text, by comparing all byte ranges."""
    file = Tokenizer.from_file(BYTES)
    file.encode_special_tokens = True
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}

    def piece(i):
        p = library.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if library.is_byte(i) else p.replace("▁", " ").encode()

    def ranges(parts):
        ends = np.cumsum([len(p) for p in parts]).tolist()
        return list(zip([0, *ends], ends))

    held, out = defaultdict(set), []
    for n, text in enumerate(texts):
        whole = (" " + (text or "")).encode()
        a, b = (file.encode(" " + text, add_special_tokens=False).ids, library.encode(text)) if text else ([], [])
        parts_a, parts_b = [bytes(byte[c] for c in file.id_to_token(i)) for i in a], [piece(i) for i in b]
        if not text or b"".join(parts_a) != whole or b"".join(parts_b) != whole:
            out.append(None)
            continue
        at_a, at_b = ranges(parts_a), ranges(parts_b)
        links, first = [], 0
        for i, (s, e) in enumerate(at_a):
            while at_b[first][1] <= s:
                first += 1
            j = first
            while j < len(b) and at_b[j][0] < e:
                links.append((a[i], b[j]))
                j += 1
        ends, start, groups = sorted({e for _, e in at_a} & {e for _, e in at_b}), 0, []
        ia = ib = 0
        for end in ends:
            ja = next(k for k in range(ia, len(a)) if at_a[k][1] == end) + 1
            jb = next(k for k in range(ib, len(b)) if at_b[k][1] == end) + 1
            groups.append(",".join(map(str, a[ia:ja])) + "|" + ",".join(map(str, b[ib:jb])))
            ia, ib, start = ja, jb, end
        out.append((len(a), len(b), links, ";".join(groups), len(groups)))
        for pair in links:
            held[pair].add(n)
    count = {p: len(x) for p, x in held.items()}
    most = defaultdict(int)
    for (a, _), n in count.items():
        most[a] = max(most[a], n)
    return [
        (0, 0, 0, 0, 0, 0, "") if d is None
        else (d[0], d[1], d[4], len(d[2]), sum(count[p] == most[p[0]] for p in d[2]), sum(count[p] for p in d[2]), d[3])
        for d in out
    ]


@pytest.mark.parametrize("where", ["folder", "given", "empty_folder"])
def test_alignment_query(spark, request, library, where):
    path = GIVEN if where == "given" else request.getfixturevalue(where)
    rows = given(spark, path)
    expected = Counter()
    for (key, _), (*numbers, groups) in zip(rows, aligned([t for _, t in rows], library)):
        expected[(key, *numbers, hashlib.sha256(groups.encode()).hexdigest() if groups else "")] += 1
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    got = queries.QUERIES["op13_token_alignment"](spark, path).select(*names)
    assert [t for _, t in got.dtypes] == ["bigint"] * 7 + ["string"]
    assert Counter(tuple(r) for r in got.collect()) == expected


def test_alignment_in_small_shards(spark, library, monkeypatch):
    """Counts and groups do not depend on how documents are dealt to shards; repeated rows and clashing columns."""
    texts = [*ODD, *random_texts(120, 9), None, "the the the the the the the the", "the the the the the the the the"]
    docs = spark.createDataFrame([(i, t, 7, 8) for i, t in enumerate(texts)], "doc_id long, text string, shard int, n_a int").repartition(5)
    aligner = token_alignment.aligner_of

    def small(*given):
        found = aligner(*given)

        def made():
            token_alignment.SHARD_LINKS = 40
            return found()

        return made

    monkeypatch.setattr(token_alignment, "aligner_of", small)
    got = token_alignment.align(docs, "text", BYTES, public_tokenizers.PATTERN, PIECES, groups=True)
    assert got.columns == ["doc_id", "shard", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]
    rows = {r["doc_id"]: tuple(r)[2:] for r in got.filter(F.col("shard") == 7).collect()}
    assert [rows[i] for i in range(len(texts))] == aligned(texts, library)


def test_postings_hold_every_link():
    draw = np.random.default_rng(3)
    links, doc = draw.integers(0, 30, 5000) ** 2, np.sort(draw.integers(0, 90, 5000))
    links[:4000], doc[:3000] = 7, 5  # one pair very often in one document
    back = Counter()
    for batch in token_alignment.postings(0, links.astype(np.int64), doc, 90):
        for r in batch.to_pylist():
            held = np.flatnonzero(np.unpackbits(np.frombuffer(r["bits"], np.uint8), bitorder="little")) if r["dense"] else np.frombuffer(r["bits"], "<u2")
            assert len(held) == r["n"]
            for d in held.tolist():
                back[(r["pair"], d)] += 1 << max(r["plane"] - 1, 0)
    assert back == Counter(zip(links.tolist(), doc.tolist()))
