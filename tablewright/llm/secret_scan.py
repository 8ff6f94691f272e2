"""Secrets in texts, by a ledger of blobs.

Every version of every path is addressed by its content. A blob is scanned under a rule version at most once: the
ledger holds the (blob, rule version) pairs done and their findings, only unseen pairs are scanned, and findings are
joined back to all paths that hold the blob.

All work is Spark's own expressions. Spark gives all matches of a pattern but not where they are; splitting by the
same pattern gives the gaps between them, and the lengths of gaps and matches add up to the places.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tablewright.llm.common import shared_dir


@dataclass(frozen=True)
class Rule:
    """A kind of secret. `pattern` finds spans, leftmost and not overlapping; `keep` drops some of its matches.

    `hint` is found in any text that has a span, and quick to try.
    """

    kind: str
    pattern: str
    hint: str
    keep: Callable[[Column], Column] | None = None


ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""

#: The base kinds in their listed order. A least length is part of the pattern where that finds the
#: same spans; an assignment with a short value also uses up its text, so it is found first and dropped afterwards.
BASE = (
    Rule("assign", ASSIGN, r"(?i:passw|secret|token|api_?key)", lambda hit: F.length(F.regexp_extract(hit, ASSIGN, 2)) >= 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}+", r"AKIA[A-Z0-9]{16}"),
    Rule("hex", r"[0-9a-f]{24,}+", r"[0-9a-f]{24}"),
)
#: Kinds that the method adds: private key blocks and signed web tokens.
ADDED = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]+-----END [A-Z ]*PRIVATE KEY-----", "-----BEGIN "),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+", "eyJ"),
)
RULES = BASE + ADDED


def version_of(rules: tuple[Rule, ...]) -> str:
    """A digest of everything that decides what rules find: other rules never read an older scan's findings."""
    told = [(r.kind, r.pattern, r.hint, str(r.keep(F.col("hit"))) if r.keep else "") for r in rules]
    return hashlib.sha256(repr(told).encode()).hexdigest()


SPAN = "struct<start:int,rank:int,kind:string,stop:int>"
LEDGER = f"blob binary, rule_version string, findings array<{SPAN}>"


def _cut(pieces: Column, count: Column) -> Column:
    return F.slice(pieces, 1, F.greatest(count, F.lit(0)))


def spans(text: Column, rule: Rule, rank: int) -> Column:
    """The spans of one rule as array of (start, rank, kind, stop) in code points, stop exclusive."""
    hits = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    gaps = F.split(text, rule.pattern, -1)
    both = F.zip_with(hits, _cut(gaps, F.size(hits)), lambda hit, gap: F.struct(hit.alias("hit"), gap.alias("gap")))

    def step(done: Column, x: Column) -> Column:
        start = done["at"] + F.length(x["gap"])
        stop = start + F.length(x["hit"])
        one = F.array(F.struct(start.alias("start"), F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"), stop.alias("stop")))
        if rule.keep is not None:
            one = F.when(rule.keep(x["hit"]), one).otherwise(F.array().cast(f"array<{SPAN}>"))
        return F.struct(stop.alias("at"), F.concat(done["found"], one).alias("found"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("found"))
    placed = F.aggregate(both, start, step, lambda done: done["found"])
    return F.when(text.rlike(rule.hint), placed).otherwise(F.array().cast(f"array<{SPAN}>"))


def all_spans(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """The spans of all rules, by start and then in the order of the rules."""
    return F.sort_array(F.concat(*(spans(text, rule, i) for i, rule in enumerate(rules))))


def blob_of(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def new_ledger(spark: SparkSession) -> str:
    """A place for a ledger in the shared folder."""
    return f"{shared_dir(spark)}/ledger-{uuid.uuid4().hex}"


def open_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger at `path`; one that isn't there yet begins empty."""
    spark.createDataFrame([], LEDGER).write.mode("append").parquet(path)
    return spark.read.schema(LEDGER).parquet(path)


def update(versions: DataFrame, text: str, ledger: str, rules: tuple[Rule, ...] = RULES, edition: str = "") -> None:
    """Scans the blobs of `versions` that `ledger` doesn't hold under these rules, and adds them to it.

    Copies of a blob are dropped before the shuffle and after it, so no group of copies meets in one task. What a
    failed run has not committed is simply unseen again. NULL counts as the empty text. Another `edition` scans all anew.
    """
    spark = versions.sparkSession
    rule_version = version_of(rules) + edition
    seen = open_ledger(spark, ledger).filter(F.col("rule_version") == rule_version).select("blob")
    content = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    blobs = versions.select(blob_of(content).alias("blob"), content.alias("content")).dropDuplicates(["blob"])
    unseen = blobs.join(seen, "blob", "left_anti")
    done = unseen.select("blob", F.lit(rule_version).alias("rule_version"), all_spans(F.col("content"), rules).alias("findings"))
    done.write.mode("append").parquet(ledger)


def findings(
    versions: DataFrame, text: str, ledger: str | None = None, into: str = "findings", rules: tuple[Rule, ...] = RULES, edition: str = ""
) -> DataFrame:
    """Every row of `versions` (a path at a time, with its text) with `into`: the spans found in its blob.

    Scans what `ledger` (default: a new one) has not seen, then joins by content. All rows stay, repeated ones too;
    a text without secrets gets an empty array. A column named `into` is replaced. An empty table stays empty.
    """
    spark = versions.sparkSession
    ledger = ledger or new_ledger(spark)
    update(versions, text, ledger, rules, edition)
    rule_version = version_of(rules) + edition
    known = spark.read.schema(LEDGER).parquet(ledger).filter((F.col("rule_version") == rule_version) & (F.size("findings") > 0))
    found = known.groupBy(F.col("blob").alias("__blob")).agg(F.first("findings").alias("__findings"))
    rows = versions.drop(into).withColumn("__blob", blob_of(F.col(f"`{text}`")))
    joined = rows.join(found, "__blob", "left")
    return joined.withColumn(into, F.coalesce("__findings", F.array().cast(f"array<{SPAN}>"))).drop("__blob", "__findings")


def masked(text: Column, found: Column, mask: str = "[secret]") -> Column:
    """The text with each span (spans that overlap: each stretch) replaced by `mask`."""

    def step(done: Column, x: Column) -> Column:
        fresh = x["start"] >= done["at"]
        gap = F.when(fresh, F.concat(F.substring(text, done["at"] + 1, x["start"] - done["at"]), F.lit(mask))).otherwise("")
        return F.struct(F.greatest(done["at"], x["stop"]).alias("at"), F.concat(done["out"], gap).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    rest = lambda done: F.concat(done["out"], F.substring(text, done["at"] + 1, F.length(text)))
    return F.when(F.size(found) > 0, F.aggregate(found, start, step, rest)).otherwise(text)


def listed(found: Column) -> Column:
    """kind:start:stop of each span, comma-joined."""
    each = F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["stop"].cast("string")))
    return F.concat_ws(",", each)
