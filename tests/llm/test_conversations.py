"""The conversation trie against a plain Python one."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewright.llm import conversation_trie, queries

GIVEN = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "conv_id long, turn long, role string, text string"


def tries(rows):
    """The nodes of rebuilt conversations; rows are (conv_id, turn, role, text)."""
    own = defaultdict(list)
    for c, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        own[c].append((role or "", text or ""))
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % 4
        path = own.get(c - c % 20, [])[:h] + own[c][h:]
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
        ends[tuple(path)].append(c)
    kids = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, cs in members.items():
        words = len(WORD.findall(p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in kids
            saved[p[:d]] += (len(cs) - 1) * words
    return Counter(
        (cs[0], len(p), members[p[:-1]][0] if p else None, len(cs), kids[p], leaves[p], saved[p], hashlib.sha256(",".join(map(str, ends[p])).encode()).hexdigest())
        for p, cs in members.items()
    )


def found(df):
    return Counter(tuple(r) for r in df.collect())


def odd_turns():
    draw = random.Random(11)
    texts = ["hello there", "how are  you\n", "", None, "fine", "a b c d e f", "x" * 3000]
    rows = []
    for c in range(0, 130):
        if c in (20, 41):
            continue
        for t in range(draw.choice([1, 1, 2, 3, 4, 5, 9])):
            rows.append((c, draw.choice([t, t, None, 0]), draw.choice(["user", "assistant", None]), draw.choice(texts)))
    rows += [(200 + c, t, "user", f"same {t}") for c in range(60) for t in range(6)]  # a large group of copies
    rows += [(300, t, "user", f"turn {t % 3}") for t in range(400)] + [(301, t, "user", f"turn {t % 3}") for t in range(380)]
    rows += [(None, 1, "user", "nobody"), *rows[:40]]  # repeated rows
    return rows


@pytest.fixture(scope="module")
def odd(spark):
    rows = odd_turns()
    return rows, spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("conv", "pid", "idx", "depth", "x1", "shard", "owner", "words")})


def test_odd_conversations(odd):
    rows, turns = odd
    assert found(conversation_trie.prefix_trie(turns.repartition(4))) == tries(rows)


def test_small_shards_and_ranges(spark, odd):
    """Many shards: totals pass between them; conversations are cut by the ranges of the first shuffle."""
    rows, turns = odd
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        own = conversation_trie.ordered(turns)
        assert own.groupBy("conv").agg(F.countDistinct("pid").alias("n")).filter("n > 1").count() > 3
        assert found(conversation_trie.prefix_trie(turns)) == tries(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_given_conversations(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{GIVEN}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = queries.QUERIES["op12_conversation_trie"](spark, GIVEN)
    assert [t for _, t in got.dtypes] == ["bigint"] * 7 + ["string"]
    assert found(got) == tries(rows)


def test_no_conversation(spark):
    assert conversation_trie.prefix_trie(spark.createDataFrame([], SCHEMA)).count() == 0
    assert conversation_trie.prefix_trie(spark.createDataFrame([(None, 1, "user", "x")], SCHEMA)).count() == 0


def test_a_conversation_without_turns_of_its_own(spark):
    """All own turns fall under h and there is no conversation to take them from: the root alone."""
    c = next(c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4 == 3)
    rows = [(c, 1, "user", "one"), (c, 2, "user", "two")]
    assert found(conversation_trie.prefix_trie(spark.createDataFrame(rows, SCHEMA))) == tries(rows)
    assert sum(tries(rows).values()) == 1


def test_queue_spills(monkeypatch):
    draw = np.random.default_rng(1)
    n = 5000
    parent = np.array([draw.integers(i + 1, min(n, i + 900)) if i + 1 < n else -1 for i in range(n)])
    leaves, saved = draw.integers(0, 5, n), draw.integers(0, 5, n)
    plain = conversation_trie.forwarded(parent, leaves, saved)
    monkeypatch.setattr(conversation_trie, "BLOCK", 7)
    spilled = conversation_trie.forwarded(parent, leaves, saved, limit=20)
    assert (plain[0] == spilled[0]).all() and (plain[1] == spilled[1]).all()
    assert plain[0][-1] == leaves.sum() and plain[1][-1] == saved.sum()
