"""Each numbered query against brute force on odd small tables, on a given table, and on empty ones."""

import base64
import hashlib
import random
import re
from collections import Counter
from types import SimpleNamespace

import brute
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tablewright.llm import bwt_dedup, byte_bpe, components, cover_tree, html_text, language_id, line_dedup, packing, quality_rules, queries, secret_scan, simhash
from tablewright.llm.common import shared_dir

GIVEN = "/root/testdata/sf0.001"
NATIVE = ["op1_quality_rules", "op3_line_dedup", "op8_secret_scan"]


def run(name, spark, path):
    return [tuple(r) for r in queries.QUERIES[name](spark, path).collect()]


@pytest.fixture(scope="module", params=["odd", "given"])
def docs(request, spark, folder, odd_docs):
    """(folder, [(doc_id, text)])"""
    if request.param == "odd":
        return folder, odd_docs
    return GIVEN, [tuple(r) for r in spark.read.parquet(f"{GIVEN}/documents.parquet").select("doc_id", "text").collect()]


def test_quality_counts_and_base(spark, docs):
    got = Counter(r[:7] for r in run("op1_quality_rules", spark, docs[0]))
    assert got == Counter((k, *(c := brute.word_counts(t)), brute.base_failed(c)) for k, t in docs[1])


def test_quality_verdict_follows_the_labels(spark):
    kept = {r[0]: r[7] for r in run("op1_quality_rules", spark, "/root/testdata/sf0.01")}
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()
    good = [kept[r["doc_id"]] for r in labels if r["quality"] == 1]
    bad = [kept[r["doc_id"]] for r in labels if r["quality"] == 0]
    assert sum(good) >= 0.95 * len(good) and sum(bad) <= 0.1 * len(bad)


def test_rules_learn_a_conjunction(spark):
    rows = [(i, n, s, n > 50 and s > 3) for i in range(600) for n, s in [(i % 100, i % 7)]]
    frame = spark.createDataFrame(rows, "i int, n_words long, n_symbols long, bad boolean")
    others = ["word_chars", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct_words", "n_upper", "n_exclamation"]
    frame = frame.withColumn("word_chars", F.col("n_words") * 5).withColumns({c: F.lit(1) for c in others[1:]})
    rules = quality_rules.learn(frame.withColumn("n_symbols", F.col("n_symbols") * F.col("n_words")))
    assert rules and all(r.rejected_good == 0 for r in rules)
    wrong = frame.withColumn("n_symbols", F.col("n_symbols") * F.col("n_words")).filter(quality_rules.verdict(rules) == F.col("bad")).count()
    assert wrong <= 0.05 * 600


def test_no_labels_no_rules(spark):
    frame = spark.createDataFrame([], "bad boolean, " + ", ".join(f"{c} long" for c in quality_rules.FEATURES_COUNTS))
    assert quality_rules.learn(frame) == []


def test_packing_is_a_partition_of_all_ids(spark, docs):
    model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    model.encode_special_tokens = True
    whole = Counter()
    for k, t in docs[1]:
        ids = model.encode(t or "", add_special_tokens=False).ids + [1]
        for start in range(0, len(ids), 2048):
            part = ids[start : start + 2048]
            whole[(k, start, len(part), brute.crc(part), len(ids))] += 1
    rows = run("op2_packing", spark, docs[0])
    assert Counter(r[:5] for r in rows) == whole
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r[5], []).append((r[6], r[2]))
    padding = 0
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    if docs[0] == GIVEN:
        assert padding <= 0.02 * sum(r[2] for r in rows)


def test_bins_keep_all_limits():
    draw = np.random.default_rng(1)
    needs = np.stack([draw.integers(1, 100, 500), np.ones(500, int), draw.integers(0, 40, 500)], 1)
    room = np.array([100, 6, 60])
    bins = packing.dot_product_bins(needs, room)
    assert sorted(i for b in bins for i in b) == list(range(500))
    assert all((needs[b].sum(0) <= room).all() for b in bins)
    assert len(bins) <= 1.15 * max((needs.sum(0) / room).max(), 1) + 1
    assert packing.dot_product_bins(needs[:0], room) == []


def test_instruction_examples_keep_loss_limit(spark):
    limits = packing.Limits(tokens=16, segments=2, loss=5, buffer=8)
    draw = random.Random(3)
    rows = [(i, bytes(np.arange(n, dtype="<u4").tobytes()), bytes(draw.randrange(2) for _ in range(n))) for i in range(60) for n in [draw.randrange(0, 40)]]
    rows += [(60, None, None), (61, bytes(np.arange(9, dtype="<u4").tobytes()), None)]
    got = packing.pack_pieces(spark.createDataFrame(rows, "i int, ids binary, loss binary"), "i", limits).collect()
    ids = {i: b"".join(r["ids"] for r in sorted((r for r in got if r["i"] == i), key=lambda r: r["start"])) for i, _, _ in rows}
    assert ids == {i: x or b"" for i, x, _ in rows}
    totals = {}
    for r in got:
        t = totals.setdefault(r["sequence_id"], [0, 0, 0])
        t[0], t[1], t[2] = t[0] + r["length"], t[1] + 1, t[2] + r["n_loss"]
    assert all(a <= 16 and b <= 2 and c <= 5 for a, b, c in totals.values())


def test_fast_ids_are_those_of_the_library():
    tokens = packing.Tokens(open(public_tokenizers.path("byte_bpe_50k.json"), "rb").read(), public_tokenizers.PATTERN)
    assert tokens.fast is not None
    draw = random.Random(5)
    pool = "ab 'sll\n\t\x1c\x1f\x85\xa0 　éßñ中文😀١²½Ⅷ!?#_-<|endoftext|>́​"
    texts = ["".join(draw.choice(pool) for _ in range(draw.randrange(60))) for _ in range(500)] + [" " * 5000, "x" + " " * 3000 + "y", "a" * 20000]
    for text, ids in zip(texts, tokens(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == tokens.model.encode(text, add_special_tokens=False).ids


def test_line_dedup(spark, docs):
    expected = brute.deduped_lines(docs[1])
    rows = run("op3_line_dedup", spark, docs[0])
    assert Counter(r[0] for r in rows) == Counter(k for k, _ in docs[1])
    assert Counter((r[0], r[3]) for r in rows) == Counter((k, expected[(k, t)]) for k, t in docs[1])
    kept = sum(len([x for x in (r[3] or "").split("\n") if x]) for r in rows)
    assert all(r[2] <= r[1] for r in rows) and kept > 0


def test_lines_like_the_leader_and_others(spark):
    """Variants that are like each other but not like their bucket's leader still meet."""
    draw = random.Random(11)
    words = lambda n: [draw.choice("abcdefghij") * draw.randrange(1, 4) + draw.choice("klmnopqrst") * 5 for _ in range(n)]
    shared, rows = words(24), []
    for i in range(12):
        own = shared + words(14)
        for j in range(4):
            variant = list(own)
            variant[draw.randrange(len(own))] = words(1)[0]
            rows.append((10 * i + j, " ".join(variant)))
    expected = brute.deduped_lines(rows)
    assert deduped(spark, rows) == expected


def every_shingle(line):
    return {line[i : i + 8] for i in range(max(1, len(line) - 7))}


def deduped(spark, rows):
    frame = spark.createDataFrame(rows, "k int, text string").withColumn("t0", F.col("text"))
    return {(r["k"], r["t0"]): r["text"] for r in line_dedup.dedup(frame, "k", "text").collect()}


def test_lines_that_begin_alike_stay(spark):
    """What lies beyond the first characters of a word tells lines apart."""
    digests = ["sha256 9f86d081" + hashlib.sha256(str(i).encode()).hexdigest() for i in range(40)]
    rows = list(enumerate(digests + ["2024010112000001", "2024010199999999", "Krankenversicherungsbeitrag", "Krankenversicherungskarte"]))
    assert deduped(spark, rows) == {x: x[1] for x in rows}


def test_shingles_of_a_line(spark):
    lines = ["abc", "12345678", "x" * 31 + "😀" + "yz" * 20, "the quick brown fox 😀😀 jumps", "é" * 70, "ab" * 35 + "c"]
    frame = spark.createDataFrame(list(enumerate(lines)), "i int, line string")
    rows = line_dedup._placed(frame).collect()
    assert Counter(r["i"] for r in rows if r["first"]) == Counter(range(len(lines)))
    assert all(r["h1"] == r[f"h{k}"] for r in rows for k in range(r["m"] + 1, line_dedup.PLACES + 1))
    placed = Counter((r["i"], r[f"h{k}"]) for r in rows for k in range(1, r["m"] + 1))
    sets = {r["i"]: set(r["s"]) for r in frame.select("i", line_dedup._shingles(F.col("line")).alias("s")).collect()}
    for i, line in enumerate(lines):
        assert {h for k, h in placed if k == i} == sets[i] and len(sets[i]) == len(every_shingle(line))
        assert sum(n for (k, _), n in placed.items() if k == i) == max(1, len(line) - 7)


def test_signatures_hash_a_place_once_and_similar_lines_meet(spark):
    """A row holds eight places, each hashed once; lines of any length that are similar share a bucket, others hardly."""
    draw = random.Random(8)
    word = lambda n: "".join(draw.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    pairs = []
    while len(pairs) < 300:
        n = draw.choice([14, 20, 30, 60, 120, 300])
        a = word(n)
        cut = draw.randrange(n // 8 + 1)
        b = draw.choice([a[cut:], a[: n - cut], a[:n] + word(cut), a[: n - 1] + word(1)])
        x, y = every_shingle(a), every_shingle(b)
        if a != b and a.strip() and b.strip() and len(x & y) >= 0.8 * len(x | y):
            pairs.append((a, b))
    short = ["abc", "abd", "x", "y", "zzzzzzzz", "12345678"]
    lines = sorted({x for p in pairs for x in p} | set(short))
    frame = spark.createDataFrame([(x, "\n".join(lines)) for x in (0, 1)], "k int, text string")
    digests = spark.createDataFrame([(x,) for x in lines], "line string").select("line", F.xxhash64("line").alias("d")).collect()
    rows = {r["digest"]["a"]: r for r in line_dedup.signatures(frame, "text").collect()}
    assert len(rows) == len(lines) and all(r["copies"] == 2 for r in rows.values())
    keys = {r["line"]: set(rows[r["d"]]["keys"]) for r in digests}
    assert sum(not keys[a] & keys[b] for a, b in pairs) <= 1
    assert not any(keys[a] & keys[b] for a in short for b in short if a != b)
    placed = line_dedup._placed(frame.select("k", F.lit(word(407)).alias("line"))).filter("k = 0").collect()
    assert len(placed) == 50 and sum(r["m"] for r in placed) == 400


def test_buckets_take_one_shuffle(spark):
    """The leader and the number of lines of each bucket, from one exchange of the bands."""
    draw = random.Random(3)
    rows = [(i, [draw.randrange(60) * 10 + k for k in range(3)]) for i in range(150)]
    star = line_dedup._star(spark.createDataFrame(rows, "id long, keys array<long>"))
    buckets = {}
    for i, keys in rows:
        for key in keys:
            buckets.setdefault(key, []).append(i)
    expected = Counter((key, i, min(ids), len(ids)) for key, ids in buckets.items() for i in ids if i != min(ids))
    assert expected and Counter((r["key"], r["id"], r["leader"], r["n"]) for r in star.collect()) == expected
    assert star._jdf.queryExecution().sparkPlan().toString().count("Window [") == 1
    assert star._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1].count("Exchange hashpartitioning") == 1


def test_lines_without_a_word_have_no_digest(spark):
    frame = spark.createDataFrame([(1, "a\n\n \t\r\x0b\x0c\n b \n\u00a0"), (2, None), (3, "")], "k int, text string")
    rows = line_dedup._occurrences(frame, "text", F.col("k")).collect()
    assert sorted((r["k"], r["pos"], r["line"]) for r in rows) == [(1, 0, "a"), (1, 3, " b "), (1, 4, "\u00a0")]
    assert all(r["digest"] is not None for r in rows)


def test_marked_rows_are_those_whose_bit_is_set(spark):
    """Each bit of the bitmaps is found again: no wanted key is left out, and hardly another is let in."""
    keys = spark.range(40000).select("id", F.md5(F.col("id").cast("string")).alias("key"))
    marked = line_dedup._marked(keys, "key", keys.filter("id % 4 = 0"), "wanted")
    assert marked.columns == ["id", "key", "wanted"]
    found = {r["id"] for r in marked.filter("wanted").collect()}
    assert found >= set(range(0, 40000, 4)) and len(found) < 10100


def test_lines_with_one_passage_are_told_apart(spark):
    """Bits rule out nearly all pairs of lines that share a passage but are not similar, and no pair that is."""
    draw = random.Random(5)
    words = lambda n: " ".join("".join(draw.choice("abcdefghij") for _ in range(7)) for _ in range(n))
    passage = words(50)
    lines = [words(9) + passage + words(9) for _ in range(40)] + [words(j) + passage for j in (0, 1, 2, 3, 5, 9, 12)] + [passage + passage + words(1), "ab" * 300, "short"]
    texts = spark.createDataFrame(list(enumerate(lines)), "id long, line string")
    small = line_dedup._bitmaps(texts)
    pairs = small.alias("x").join(small.alias("y"), (F.col("x.id") < F.col("y.id")) & line_dedup._possible("x", "y", 0.8))
    left = {(r[0], r[1]) for r in pairs.select("x.id", "y.id").collect()}
    sets = [every_shingle(x) for x in lines]
    assert {r["id"]: r["size"] for r in small.collect()} == {i: len(s) for i, s in enumerate(sets)}
    every = {(a, b) for b in range(len(lines)) for a in range(b)}
    similar = {(a, b) for a, b in every if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    assert len(similar) > 3 and similar <= left and len(left) <= len(similar) + len(every) / 20


VECTORS = [(400, None, 1), (401, [0.0] * 6, 1), (402, [float("nan")] + [1.0] * 5, 1), (403, [None] * 6, 1), (404, [1.0, 2.0], 1), (405, [2.0, 4.0], 1), (406, [], 1), (407, [float("inf")] * 6, 1), (None, [1.0, 2.0], 1)]


@pytest.mark.parametrize("block", [1024, 16])
def test_cover_tree(spark, block):
    draw = np.random.default_rng(3)
    centres = draw.normal(size=(12, 6))
    rows = [(i, [float(np.float32(x)) for x in (centres[draw.integers(12)] + draw.normal(size=6) * draw.choice([0, 0.2, 0.5])) * draw.choice([1, 2])], int(draw.integers(3)) if i % 50 else None) for i in range(250)]
    rows += VECTORS + rows[:3]
    links = brute.vector_links([r[1] for r in rows], [r[2] for r in rows])
    least = brute.groups([r[0] for r in rows], links)
    count = Counter(x for pair in links for x in pair)
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("node", F.lit(1))
    got = cover_tree.near_duplicates(frame, "vec_id", "embedding", "label", block=block).collect()
    assert Counter(map(tuple, got)) == Counter((r[0], count[i], least[i], r[0] == least[i]) for i, r in enumerate(rows))


def test_cover_tree_query(spark):
    rows = spark.read.parquet(f"{GIVEN}/embeddings.parquet").collect()
    links = brute.vector_links([r["embedding"] for r in rows], [r["label"] for r in rows], 0.35)
    frame = spark.read.parquet(f"{GIVEN}/embeddings.parquet")
    got = {r[0]: r[2] for r in cover_tree.near_duplicates(frame, "vec_id", "embedding", "label", 0.35, 64).collect()}
    assert links and got == dict(zip((r["vec_id"] for r in rows), brute.groups([r["vec_id"] for r in rows], links)))
    assert len(run("op4_cover_tree", spark, GIVEN)) == len(rows)


def test_cover_tree_agrees_with_its_sql(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    draw = np.random.default_rng(8)
    centres = draw.normal(size=(6, 5))
    rows = [(i, [float(x) for x in centres[draw.integers(6)] + draw.normal(size=5) * draw.choice([0, 0.1, 0.4])], int(draw.integers(2)) if i % 9 else None) for i in range(80)]
    rows += [(80, [0.0] * 5, 1), (81, None, 1), (82, [float("nan")] * 5, 1)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    connection = duckdb.connect()
    connection.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    theirs = Counter(connection.execute(queries.ORACLES["op4_cover_tree"]).fetchall())
    ours = Counter(run("op4_cover_tree", spark, str(tmp_path)))
    assert ours == theirs and any(r[1] for r in ours)


def test_simhash(spark, docs):
    prints = [brute.fingerprint(t) for _, t in docs[1]]
    least = brute.groups([k for k, _ in docs[1]], brute.near_pairs(prints))
    assert Counter(run("op5_simhash", spark, docs[0])) == Counter((k, f"{p:016x}", c) for (k, _), p, c in zip(docs[1], prints, least))


@pytest.mark.parametrize("node", [20_000, 8, 2])
def test_trie_join_with_crowded_nodes(spark, node):
    draw = random.Random(2)
    values = set()
    for _ in range(15):
        base = draw.getrandbits(64)
        for _ in range(40):
            x = base
            for _ in range(draw.randrange(5)):
                x ^= 1 << draw.randrange(64)
            values.add(x)
    values = sorted(values)
    expected = brute.groups(values, brute.near_pairs(values))
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    links = simhash.near_links(spark.createDataFrame([(signed(x),) for x in values], "fingerprint long"), 2, node).collect()
    at = {signed(x): i for i, x in enumerate(values)}
    assert brute.groups(values, [(at[a], at[b]) for a, b in links]) == expected


def test_keep_one(spark, odd_docs):
    frame = spark.createDataFrame([(k, t, i) for i, (k, t) in enumerate(odd_docs)], "doc_id long, text string, i int")
    kept = simhash.keep_one(frame, "doc_id").collect()
    prints = [brute.fingerprint(t) for _, t in odd_docs]
    least = brute.groups([k for k, _ in odd_docs], brute.near_pairs(prints))
    assert len(kept) == len(set(least)) and {r["doc_id"] for r in kept} == set(least)


def test_components_of_a_random_graph(spark):
    draw = random.Random(9)
    edges = [(draw.randrange(400), draw.randrange(400)) for _ in range(260)] + [(0, i) for i in range(500, 600)] + [(i, i + 1) for i in range(700, 760)] + [(5, 5), (None, 3)]
    nodes = sorted({x for a, b in edges if a is not None and a != b for x in (a, b)})
    at = {n: i for i, n in enumerate(nodes)}
    expected = dict(zip(nodes, brute.groups(nodes, [(at[a], at[b]) for a, b in edges if a is not None and a != b])))
    got = components.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r["node"]: r["component"] for r in got} == expected and len(got) == len(expected)


@pytest.mark.parametrize("crowd", [5000, 2])
def test_repeated_strings(spark, odd_docs, crowd):
    rows = [(k, t) for k, t in odd_docs if t is None or len(t) < 20000]
    expected = Counter((k, *x) for (k, _), x in zip(rows, brute.without_repeats([(t or "").encode() for _, t in rows])))
    done = bwt_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string").withColumn("kept", F.lit(1)), "doc_id", "text", 200, crowd)
    got = done.select("doc_id", "n_bytes", "n_removed", F.size("removed"), F.sha2("kept", 256)).collect()
    assert Counter(map(tuple, got)) == expected


def test_repeated_strings_query(spark):
    docs = spark.read.parquet(f"{GIVEN}/documents.parquet").collect()
    expected = {d["doc_id"]: x for d, x in zip(docs, brute.without_repeats([d["text"].encode() for d in docs]))}
    assert {r[0]: r[1:] for r in run("op6_bwt_dedup", spark, GIVEN)} == expected


@pytest.mark.parametrize("shard", [200, 1500, 1 << 20])
def test_merged_transforms(shard, monkeypatch):
    monkeypatch.setattr(bwt_dedup, "SHARD", shard)
    draw = random.Random(shard)
    for length in (50, 60, 7):
        base = bytes(draw.choice(b"abcd") for _ in range(300))
        texts = set()
        for _ in range(draw.randrange(2, 30)):
            x = bytearray(base[draw.randrange(0, 100) : draw.randrange(150, 300)])
            for _ in range(draw.randrange(3)):
                x[draw.randrange(len(x))] = draw.choice(b"xyz")
            texts.add(bytes(x))
        texts = sorted(texts)
        counts = Counter(b[i : i + length] for b in texts for i in range(len(b) - length + 1))
        expected = [[i for i in range(len(b) - length + 1) if counts[b[i : i + length]] > 1] for b in texts]
        assert [g.tolist() for g in bwt_dedup.repeated(texts, length)] == expected


def test_language(spark):
    path = "/root/testdata/sf0.01"
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{path}/documents.parquet").collect()}
    rows = run("op7_language_id", spark, path)
    held = [r for r in rows if r[1]]
    assert {r[0] for r in rows} == set(lang) and len(held) > 200
    assert sum(lang[r[0]] == r[2] for r in held) >= 0.99 * len(held)
    assert all(0 <= r[3] <= 1 for r in rows)


def test_language_mixture_and_background():
    draw = random.Random(1)
    text = lambda letters, n: " ".join("".join(draw.choice(letters) for _ in range(5)) for _ in range(n))
    chances = np.full((3, language_id.CELLS), 1 / language_id.CELLS)
    for row, letters in enumerate(["abcde", "uvwxy"]):
        counts = np.bincount(language_id.trigrams(text(letters, 4000)), minlength=language_id.CELLS) + 0.5
        chances[row] = counts / counts.sum()
    model = language_id.Model(["one", "two"], chances)
    for a, b, expected in ((60, 0, [0]), (0, 60, [1]), (70, 30, [0, 1]), (30, 70, [1, 0])):
        chosen, shares = language_id.mixture(language_id.trigrams(text("abcde", a) + " " + text("uvwxy", b)), model)
        assert sorted(chosen, key=lambda i: -shares[i]) == expected
        assert abs(shares[0] - a / (a + b)) < 0.08
    assert language_id.mixture(language_id.trigrams(text("klmnop", 80)), model)[1][-1] > 0.9


def test_language_odd(spark, folder, odd_docs):
    rows = run("op7_language_id", spark, folder)
    assert Counter(r[0] for r in rows) == Counter(k for k, _ in odd_docs)
    none = {k for k, t in odd_docs if not any(c.isalpha() for c in t or "")}
    told = {r[0]: r for r in rows}
    assert all(told[k][2] == "und" and told[k][3] == 0 for k in none if k is not None)


def test_secrets(spark, docs):
    rows = run("op8_secret_scan", spark, docs[0])
    assert Counter(r[:5] for r in rows) == Counter((k, *(b := brute.base_secrets(t))[0], b[1]) for k, t in docs[1])
    if docs[0] != GIVEN:
        assert any("jwt:" in r[5] and "pem:" in r[5] for r in rows)


def test_secrets_agree_with_their_sql(spark, docs):
    duckdb = pytest.importorskip("duckdb")
    connection = duckdb.connect()
    connection.execute(f"create view documents as select * from '{docs[0]}/documents.parquet{'' if docs[0] == GIVEN else '/*.parquet'}'")
    assert Counter(run("op8_secret_scan", spark, docs[0])) == Counter(connection.execute(queries.ORACLES["op8_secret_scan"]).fetchall())


def test_ledger_scans_only_what_is_new(spark):
    frame = lambda *rows: spark.createDataFrame(rows, "path string, text string")
    ledger = secret_scan.new_ledger(spark)
    first = frame(("a", "token=abcdefgh"), ("b", "nothing"), ("c", "token=abcdefgh"), ("d", None))
    assert {r["path"]: len(r["findings"]) for r in secret_scan.findings(first, "text", ledger).collect()} == {"a": 1, "b": 0, "c": 1, "d": 0}
    assert secret_scan.open_ledger(spark, ledger).count() == 3
    second = frame(("a", "token=abcdefgh"), ("e", "secret: 12345678"))
    secret_scan.update(second, "text", ledger)
    assert secret_scan.open_ledger(spark, ledger).count() == 4
    secret_scan.update(second, "text", ledger, edition="next")
    assert secret_scan.open_ledger(spark, ledger).count() == 6


def test_other_rules_do_not_read_older_findings(spark):
    ledger = secret_scan.new_ledger(spark)
    frame = spark.createDataFrame([("a", "token=abcdefgh ZZZ123")], "path string, text string")
    kinds = lambda rules: [f["kind"] for f in secret_scan.findings(frame, "text", ledger, rules=rules).first()["findings"]]
    assert kinds(secret_scan.RULES) == ["assign"]
    assert kinds((secret_scan.Rule("own", "Z{3}[0-9]+", "ZZZ"),)) == ["own"]
    shorter = (secret_scan.Rule("assign", secret_scan.ASSIGN, "token", lambda hit: F.length(hit) > 99),)
    assert kinds(shorter) == [] and kinds(secret_scan.RULES) == ["assign"]


def test_masked(spark):
    frame = spark.createDataFrame([("é token=abcdef0123456789abcdef0123456789 z",), ("plain",), (None,)], "text string")
    got = secret_scan.findings(frame, "text").select(secret_scan.masked(F.col("text"), F.col("findings")).alias("t")).collect()
    assert {r["t"] for r in got} == {"é [secret] z", "plain", None}


PAGE = """<!doctype html><html><head><title>T</title><style>p{}</style><script>var a="<p>no</p>";</script></head><body>
<header class="top"><a href=/>Home</a> Site name that is long enough to look like text of some kind</header><nav><ul><li><a href=a>A</a><li><a href=b>B</a></ul></nav>
<div class="cookie-notice">We use cookies to make this page better for you and for us, please accept all of them.</div>
<div id="content"><article><h1>Title&nbsp;one</h1><p>First  paragraph with <b>bold</b> and an <a href=x>inline link</a> &amp; more words to read.<p>Second
paragraph, not closed, with many more words than the first one had.</p><p>End.</p><footer>Tags: a, b</footer></article>
<aside>Related things that you may like to read as well, with long text.</aside>
<section class="comments"><p>A reader wrote a long comment here, with many words in it, to look like an article.</p></section></div>
<form><label>Mail</label><input><button>Go</button></form><footer>&copy; 2020 Site, all rights reserved and so on and so forth.</footer></body></html>"""


def test_html():
    assert html_text.main_text(PAGE) == "Title one First paragraph with bold and an inline link & more words to read. Second paragraph, not closed, with many more words than the first one had. End."
    plain = "<html><body><div class=menu><a href=1>x</a></div><div><p>One long paragraph of text without any article element.</p><p>Short.</p></div></body>"
    assert html_text.main_text(plain) == "One long paragraph of text without any article element. Short."
    assert [html_text.main_text(x) for x in (None, "", "<p>", "<script>x</script>", "a &lt; b")] == ["", "", "", "", "a < b"]
    assert html_text.main_text("<div>" * 3000 + "deep text" + "</div>" * 3000) == "deep text"


def test_html_query(spark, folder):
    rows = run("op9_html_text", spark, folder)
    assert Counter(rows) == Counter([(1, "u", "", 0), (2, None, "", 0), (None, "v", "", 0), (4, "w", "plain & text", 12), (4, "w", "plain & text", 12)])
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{GIVEN}/pages.parquet").collect()}
    for page, _, text, n in run("op9_html_text", spark, GIVEN):
        article = re.search(r"<article>(.*?)</article>", pages[page], re.S)[1]
        import html

        bare = " ".join(html.unescape(re.sub(r"<[^>]*>", "", re.sub(r"<(/?(p|h1|br))\b[^>]*>", " ", article))).split())
        assert text == bare and n == len(text)


def test_byte_bpe(spark, docs):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    model = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    digest = lambda b: hashlib.sha256(b).hexdigest()
    expected = Counter((k, len(ids := model.encode_ordinary(t or "")), digest(np.array(ids, "<u4").tobytes()), digest((t or "").encode())) for k, t in docs[1])
    assert Counter(run("op10_byte_bpe", spark, docs[0])) == expected


def test_perfect_hash():
    for n in (0, 1, 2, 1000):
        keys = [f"key {i}".encode() for i in range(n)]
        index = byte_bpe.PerfectHash(keys)
        assert [index(k) for k in keys] == list(range(n))
        assert len(index.at) == max(1, n)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_empty_tables(spark, empty_folder, name):
    frame = queries.QUERIES[name](spark, empty_folder)
    assert frame.collect() == [] and frame.columns


@pytest.mark.parametrize("name", NATIVE)
def test_no_python_in_native_plans(spark, name):
    plan = queries.QUERIES[name](spark, GIVEN)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|CartesianProduct|NestedLoop", plan)


def test_shared_folder_is_the_session_s():
    assert shared_dir(SimpleNamespace(conf={"spark.checkpoint.dir": "file:///some/where/"})) == "file:///some/where"
    with pytest.raises(ValueError):  # a folder of the driver's own would be seen by no other machine
        shared_dir(SimpleNamespace(conf={}, sparkContext=SimpleNamespace(master="spark://somewhere")))
