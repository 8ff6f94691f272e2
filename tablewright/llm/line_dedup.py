"""Fuzzy line dedup: MinHash signatures, banding, exact Jaccard verification, distributed union-find.

All steps are Spark's own expressions over lines, which a 128-bit digest of their text names. Shingles are compared by
64-bit hashes.

1. Signature. The shingles of a line are the eight characters from every place (a shorter line is its own shingle). Each is
   hashed once: half of the hash tells one of 30 bins, and the least other half in a bin is a value of the signature. A bin
   without a shingle borrows from the first filled one in an order drawn for it. A row holds several places, so the aggregate
   by digest takes fewer rows than characters; equal lines become one there, with their number of copies.
2. Bands: three values each, and two bands more for short lines, whose values are less independent. In each bucket, lines
   are first compared with the leader, the line with most copies. Those that are not like it are then compared with the other
   lines of the bucket, but for lines that are linked already, by any way. So a bucket full of variants of one line costs a
   comparison each, and no component loses a line.
3. Lines that share a bucket with another are read again: 1,024 bits, each the parity of the shingles that fall on it. What
   two lines share cancels out, so they differ in at least as many shingles as their bits do; only by this bound, which no
   similar pair exceeds, are pairs left out. All others are verified on their texts: exact Jaccard of their shingles.
4. Components of the verified links; each keeps its first line by (document, line number).

Texts move only if they can matter: a bitmap of fixed size (1 MB, a Bloom filter with one hash) says which lines or
documents a later join needs, and all others are left out before the shuffle.
"""

from __future__ import annotations

import random
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from tablewright.llm.common import split_lines, written
from tablewright.llm.components import components
from tablewright.llm.quality_rules import SPACE

#: Characters of a shingle, and the bands of values; each value is the least hash of one bin.
SHINGLE = 8
BANDS, ROWS = 10, 3
BINS = BANDS * ROWS
#: Short lines, with so many empty bins, have further bands of values of different bands.
FEW, ACROSS = 10, ((0, 10, 20), (4, 14, 24))
#: What stands for the least hash of a bin without one.
EMPTY = (1 << 31) - 1
#: Longs of 64 bits that bound from below in how many shingles two lines differ.
BITS = 16
#: Places of a row: an aggregate takes the least of so many before it touches its buffer.
PLACES = 8
SLOTS = 1 << 23


def _slot(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(SLOTS)) + 1


def _marked(rows: DataFrame, key: str, wanted: DataFrame, name: str) -> DataFrame:
    """Rows with boolean `name`: false only where no row of `wanted` has that key. Broadcasts at most 256 bitmaps of 4 KB."""
    slots = wanted.select(_slot(F.col(key)).alias("__slot"))
    maps = slots.groupBy(F.bitmap_bucket_number("__slot").alias("__bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("__slot")).alias("__bits"))
    # As 512 longs of eight bytes, the first byte highest: a row looks its bit up without making a text of it.
    words = "transform(sequence(0, 511), i -> cast(conv(hex(substring(__bits, 8 * i + 1, 8)), 16, -10) as bigint))"
    maps = maps.select("__bucket", F.expr(words).alias("__words"))
    placed = rows.withColumns({"__bucket": F.bitmap_bucket_number(_slot(F.col(key))), "__at": F.bitmap_bit_position(_slot(F.col(key)))})
    word = F.get("__words", F.shiftright("__at", 6).cast("int"))
    bit = F.getbit(word, F.expr("cast(56 - 8 * (shiftright(__at, 3) & 7) + (__at & 7) as int)")) == 1
    joined = placed.join(F.broadcast(maps), "__bucket", "left")
    return joined.withColumn(name, F.coalesce(bit, F.lit(False))).drop("__bucket", "__at", "__words")


def document_key(key: str, text: str) -> Column:
    """128 bits of a document's key and text: repeated rows share it and are treated alike."""
    own = F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit("-"))
    return F.unhex(F.md5(F.concat(own, F.lit("\n"), F.coalesce(F.col(text), F.lit(""))).cast("binary")))


def _occurrences(docs: DataFrame, text: str, *more: Column) -> DataFrame:
    """(..., pos, line, digest) of every line with a word."""
    lines = docs.select(*more, F.posexplode(split_lines(F.col(text))).alias("pos", "line"))
    # From the left only: a trim from the right looks at every character.
    wordy = lines.filter(F.ltrim("line", F.lit(SPACE)) != "")
    return wordy.withColumn("digest", F.struct(F.xxhash64("line").alias("a"), F.xxhash64(F.lit("again"), "line").alias("b")))


def _characters(line: Column) -> Column:
    """A line as four bytes a character, so that a shingle is cut out at once."""
    return F.encode(line, "UTF-32")


def _last(characters: Column) -> Column:
    """Where the last shingle begins, in bytes from 1; a line shorter than a shingle has one place."""
    return F.greatest(F.lit(1), F.length(characters) - (4 * SHINGLE - 1))


def _shingle(characters: Column, at: Column) -> Column:
    return F.xxhash64(F.substring(characters, at, F.lit(4 * SHINGLE)))


def _placed(lines: DataFrame) -> DataFrame:
    """(..., first, m, h1, h2 ...): hashes of the shingles at up to PLACES places of each `line`, m of them; what is beyond
    repeats the first. `first` is true once a line."""
    rest = [c for c in lines.columns if c != "line"]
    wide = lines.select(*rest, F.coalesce(_characters(F.col("line")), F.lit(b"")).alias("characters"))
    wide = wide.select(*rest, "characters", _last(F.col("characters")).alias("last"))
    rows = wide.select(*rest, "characters", "last", F.explode(F.sequence(F.lit(1), "last", F.lit(4 * PLACES))).alias("at"))
    named = rows.select(*rest, "characters", "last", "at", _shingle(F.col("characters"), F.col("at")).alias("h1"))
    more = (F.when(F.col("at") + 4 * i <= F.col("last"), _shingle(F.col("characters"), F.col("at") + 4 * i)).otherwise(F.col("h1")).alias(f"h{i + 1}") for i in range(1, PLACES))
    m = F.least(F.lit(PLACES), F.shiftright(F.col("last") - F.col("at"), 2) + 1)
    return named.select(*rest, (F.col("at") == 1).alias("first"), m.alias("m"), "h1", *more)


def _borrowed(j: int) -> Column:
    """Of `values`, the first that is there in an order of the bins drawn for bin j: lines with the same bins filled agree on it."""
    order = list(range(BINS))
    random.Random(j).shuffle(order)
    order = [x for x in order if x != j]
    near = [F.get("values", F.lit(x)) for x in order[:4]]
    return F.coalesce(*near, F.get(F.filter(F.transform(F.array(*map(F.lit, order[4:])), lambda x: F.get("values", x)), lambda x: x.isNotNull()), F.lit(0)))


def signatures(docs: DataFrame, text: str) -> DataFrame:
    """(id, digest, copies, keys) of every distinct line with a word. `keys` has one per band. Lines with more copies have
    smaller ids."""
    lines = _occurrences(docs, text).select(F.col("digest.a").alias("da"), F.col("digest.b").alias("db"), "line")
    each = range(1, PLACES + 1)
    # The lower half of a hash tells the bin, the upper half is the value.
    halves = (F.shiftright(f"h{i}", 32).cast("int").alias(f"h{i}") for i in each)
    bins = (F.shiftright(F.col(f"h{i}").bitwiseAND(F.lit((1 << 32) - 1)) * BINS, 32).cast("int").alias(f"bin{i}") for i in each)
    placed = _placed(lines).select("da", "db", "first", *halves, *bins)

    def least(j: int) -> Column:
        return F.min(F.least(*(F.when(F.col(f"bin{i}") == j, F.col(f"h{i}")).otherwise(F.lit(EMPTY)) for i in each)))

    made = placed.groupBy("da", "db").agg(F.count_if("first").alias("copies"), *(least(j).alias(f"v{j}") for j in range(BINS)))
    made = made.select("da", "db", "copies", F.array(*(F.nullif(F.col(f"v{j}"), F.lit(EMPTY)) for j in range(BINS))).alias("values"))
    value = [F.coalesce(F.get("values", F.lit(j)), _borrowed(j)) for j in range(BINS)]
    level = F.lit(1023) - F.least(F.lit(1023), F.floor(F.log2("copies") * 32)).cast("int")
    keys = F.array(*(F.xxhash64(F.lit(k), *value[k * ROWS : (k + 1) * ROWS]) for k in range(BANDS)))
    empty = reduce(Column.__add__, (F.get("values", F.lit(j)).isNull().cast("int") for j in range(BINS)))
    across = F.array(*(F.xxhash64(F.lit(BANDS + k), *(value[j] for j in own)) for k, own in enumerate(ACROSS)))
    keys = F.when(empty >= FEW, F.concat(keys, across)).otherwise(keys)
    return made.select(
        (F.shiftleft(level.cast("long"), 53) + F.monotonically_increasing_id()).alias("id"),
        F.struct(F.col("da").alias("a"), F.col("db").alias("b")).alias("digest"),
        "copies", keys.alias("keys"),
    )


def _bitmaps(texts: DataFrame) -> DataFrame:
    """(id, size, b0, b1 ...): the number of a line's shingles, and the parities of those that fall on each bit."""
    sets = texts.select("id", _shingles(F.col("line")).alias("s"))
    rows = sets.select("id", "s", F.explode(F.sequence(F.lit(0), F.size("s") - 1, F.lit(PLACES))).alias("at"))
    each = range(PLACES)
    hashed = rows.select("id", F.when(F.col("at") == 0, F.size("s")).otherwise(0).alias("n"), *(F.get("s", F.col("at") + i).alias(f"h{i}") for i in each))
    zero = F.lit(0).cast("long")
    bit = [F.coalesce(F.expr(f"shiftleft(1L, cast(h{i} & 63 as int))"), zero).alias(f"bit{i}") for i in each]
    word = [F.coalesce(F.shiftright(f"h{i}", 6).bitwiseAND(F.lit(BITS - 1)).cast("int"), F.lit(0)).alias(f"word{i}") for i in each]
    hashed = hashed.select("id", "n", *bit, *word)

    def parity(j: int) -> Column:
        return F.bit_xor(reduce(Column.bitwiseXOR, (F.when(F.col(f"word{i}") == j, F.col(f"bit{i}")).otherwise(zero) for i in each)))

    return hashed.groupBy("id").agg(F.sum("n").alias("size"), *(parity(j).alias(f"b{j}") for j in range(BITS)))


def _possible(a: str, b: str, similarity: float) -> Column:
    """False only for pairs that cannot be similar: they differ in at least a shingle per bit that differs."""
    apart = reduce(lambda x, y: x + y, (F.bit_count(F.col(f"{a}.b{j}").bitwiseXOR(F.col(f"{b}.b{j}"))) for j in range(BITS)))
    return apart * F.lit(1 + similarity) <= F.lit(1 - similarity + 1e-9) * (F.col(f"{a}.size") + F.col(f"{b}.size"))


def _shingles(line: Column) -> Column:
    """The set of a line's shingles, as hashes."""
    one = F.array(_characters(line))  # so that it is made once a line
    each = F.transform(one, lambda x: F.transform(F.sequence(F.lit(1), _last(x), F.lit(4)), lambda at: _shingle(x, at)))
    return F.array_distinct(F.get(each, F.lit(0)))


def _verified(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of ids whose lines are that similar."""
    for k in "ab":
        pairs = pairs.join(texts.select(F.col("id").alias(k), F.col("line").alias(f"line{k}")), k)
    sets = pairs.select("a", "b", _shingles(F.col("linea")).alias("sa"), _shingles(F.col("lineb")).alias("sb"))
    both = sets.select("a", "b", F.size("sa").alias("nx"), F.size("sb").alias("ny"), F.size(F.array_intersect("sa", "sb")).alias("n"))
    return both.filter(F.col("n") >= F.lit(similarity) * (F.col("nx") + F.col("ny") - F.col("n"))).select("a", "b")


def _star(signed: DataFrame) -> DataFrame:
    """(key, id, leader, n): the n lines of a bucket, but for its leader, the least id. Buckets of one line have no rows."""
    # Hardly a key is found twice, so an aggregate before the shuffle would gain nothing; one shuffle and sort serve both.
    bands, bucket = signed.select("id", F.explode("keys").alias("key")), Window.partitionBy("key")
    met = bands.select("key", "id", F.min("id").over(bucket).alias("leader"), F.count("*").over(bucket).alias("n"))
    return met.filter("id != leader")


def similar_lines(docs: DataFrame, text: str, similarity: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """(signatures, groups): groups (id, component) of lines that links of at least `similarity` join."""
    signed = written(signatures(docs, text), "signatures")
    star = written(_star(signed), "star")
    some = written(star.select(F.col("id")).unionByName(star.select(F.col("leader").alias("id"))).distinct(), "some")
    wanted = written(signed.select("id", "digest").join(some, "id", "left_semi"), "wanted")
    lines = _occurrences(docs, text).select("digest", "line")
    near = _marked(lines, "digest", wanted, "__needed").filter("__needed").select("digest", "line")
    texts = written(near.join(wanted, "digest").select("id", "line").dropDuplicates(["id"]), "texts")
    small = written(_bitmaps(texts), "candidates")

    def possible(pairs: DataFrame) -> DataFrame:
        joined = pairs.alias("p").join(small.alias("x"), F.col("p.a") == F.col("x.id")).join(small.alias("y"), (F.col("p.b") == F.col("y.id")) & _possible("x", "y", similarity))
        return joined.select("p.a", "p.b")

    first = written(possible(star.select(F.col("id").alias("a"), F.col("leader").alias("b")).distinct()), "first")
    links = written(_verified(first, texts, similarity), "links")
    # Lines that are not like their bucket's leader meet the rest of the bucket, but for what is linked already.
    groups = written(components(links).withColumnRenamed("node", "id"), "groups")
    known = links.select(F.col("a").alias("id"), F.col("b").alias("leader"), F.lit(True).alias("linked"))
    rest = written(star.filter("n > 2").join(known, ["id", "leader"], "left").select("key", "id", F.coalesce("linked", F.lit(False)).alias("linked")), "rest")
    signed_rest = rest.join(small, "id").join(groups, "id", "left").withColumn("component", F.coalesce("component", "id"))
    alone, others = signed_rest.filter("not linked").alias("x"), signed_rest.alias("y")
    order = F.col("y.linked") | (F.col("x.id") < F.col("y.id"))
    second = alone.join(others, (F.col("x.key") == F.col("y.key")) & (F.col("x.component") != F.col("y.component")) & order & _possible("x", "y", similarity))
    second = second.select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()
    late = _verified(second, texts, similarity)
    for k in "ab":
        late = late.join(groups.select(F.col("id").alias(k), F.col("component").alias(f"c{k}")), k, "left")
    late = written(late.select(*(F.coalesce(f"c{k}", k).alias(k) for k in "ab")).distinct(), "late")
    later = components(late).select(F.col("node").alias("component"), F.col("component").alias("final"))
    alone = late.select(F.explode(F.array("a", "b")).alias("id")).distinct().join(groups, "id", "left_anti").select("id", F.col("id").alias("component"))
    named = groups.unionByName(alone).join(later, "component", "left")
    return signed, written(named.select("id", F.coalesce("final", "component").alias("component")), "groups")


def removed_lines(docs: DataFrame, key: str, text: str, similarity: float = 0.8) -> DataFrame:
    """(document, gone): for each document (`__document`, its `document_key`) that loses lines, their numbers in order."""
    signed, groups = similar_lines(docs, text, similarity)
    several = signed.select("id", "digest", "copies").join(groups, "id", "left").filter("copies > 1 or component is not null")
    several = written(several.select("digest", F.coalesce("component", "id").alias("line_group")), "several")
    rank = F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("key"), F.col("document"), F.col("pos"))
    named = docs.select(F.col("__document").alias("document"), F.col(key), F.col(text))  # below the lines: once a text
    lines = _occurrences(named, text, F.col("document"), F.col(key)).select("document", "pos", "digest", rank.alias("rank"))
    near = _marked(lines, "digest", several, "__needed").filter("__needed").drop("__needed")
    held = written(near.join(several, "digest").select("line_group", "document", "pos", "rank"), "held")
    first = held.groupBy("line_group").agg(F.min("rank").alias("first"))
    gone = held.join(first, "line_group").filter(F.col("rank") != F.col("first")).select("document", "pos").distinct()
    return gone.groupBy("document").agg(F.sort_array(F.collect_list("pos")).alias("gone"))


def dedup(docs: DataFrame, key: str, text: str, similarity: float = 0.8) -> DataFrame:
    """Every row of `docs` with `text` reduced to the lines that stay, and n_lines, n_removed (long).

    Of each group of lines (equal, or linked by a Jaccard similarity of character shingles of at least `similarity`)
    only the first by (key, line number) stays; a NULL key comes last. Lines without a word stay. NULL text stays
    NULL, with no lines. Repeated rows (same key and text) count as one document and are treated alike. Empty: no rows.
    """
    docs = docs.withColumn("__document", document_key(key, text))
    gone = written(removed_lines(docs.select("__document", key, text), key, text, similarity), "gone").withColumnRenamed("document", "__document")
    marked = _marked(docs, "__document", gone, "__touched")
    plain = marked.filter("not __touched").withColumn("__gone", F.lit(None).cast("array<int>"))
    changed = marked.filter("__touched").join(gone.withColumnRenamed("gone", "__gone"), "__document", "left")
    rows = plain.unionByName(changed)
    lines = split_lines(F.col(text))
    total = F.when(F.col(text).isNull(), 0).otherwise(F.size(lines)).cast("long")
    lost = F.coalesce(F.size("__gone"), F.lit(0)).cast("long")
    # Between two lines that go, what stays is one slice; the slices together are the text.
    bounds = F.concat(F.array(F.lit(-1)), F.col("__gone"), F.array(F.size(lines)))
    kept = _rest(lines, bounds)
    reduced = F.when(F.col("__gone").isNull(), F.col(text)).otherwise(kept)
    return rows.withColumns({"n_lines": total, "n_removed": lost, text: reduced}).drop("__document", "__touched", "__gone")


def _rest(lines: Column, bounds: Column) -> Column:
    def of(x: Column) -> Column:
        own, cuts = x["lines"], x["cuts"]
        pieces = F.transform(F.sequence(F.lit(1), F.size(cuts) - 1), lambda i: F.slice(own, F.get(cuts, i - 1) + 2, F.get(cuts, i) - F.get(cuts, i - 1) - 1))
        return F.array_join(F.flatten(pieces), "\n")

    return F.get(F.transform(F.array(F.struct(lines.alias("lines"), bounds.alias("cuts"))), of), F.lit(0))
