"""Quality rules learned from labelled statistics.

Sequential covering learns an ordered list of rules for rejecting. A rule is a conjunction of thresholds: conditions
are added as long as they raise the information gain on the growing part of the labelled rows, then dropped from the
end as long as that helps on the pruning part; what the rule covers is taken away and the next one starts. The list
comes out as one conditional expression.

Statistics, counts of candidate conditions and the verdict are Spark's own expressions. The driver sees thresholds
and counts only, features x thresholds of them.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

SPACE = " \t\n\x0b\x0c\r"
SPLIT = r"[\x20\x09-\x0D]+"
WINDOW = 5


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value) with value computed once, also where `then` uses it in a lambda."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _repeated(hashes: Column) -> Column:
    """How many words lie in windows (given by their hashes in order) that occur twice or more."""

    def covered(ordered: Column) -> Column:
        def same(x: Column, i: Column) -> Column:
            before = F.coalesce(F.get(ordered, i - 1)["h"] == x["h"], F.lit(False))
            after = F.coalesce(F.get(ordered, i + 1)["h"] == x["h"], F.lit(False))
            return F.when(before | after, x["i"])

        at = F.sort_array(F.array_compact(F.transform(ordered, same)))
        zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
        step = lambda a, p: F.struct((p + WINDOW).alias("end"), (a["n"] + p + WINDOW - F.greatest(p, a["end"])).alias("n"))
        return F.aggregate(at, zero, step, lambda a: a["n"])

    ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), let(ordered, covered)).otherwise(F.lit(0))


def _word_counts(words: Column) -> Column:
    """Struct of the counts that need the words: n, chars, repeated, distinct."""

    def of(hashes: Column) -> Column:
        window = lambda i: F.xxhash64(*(F.get(hashes, i + k) for k in range(WINDOW)))
        windows = F.transform(F.sequence(F.lit(0), F.size(hashes) - WINDOW), window)
        return F.struct(
            F.size(hashes).cast("long").alias("n"),
            F.when(F.size(hashes) >= WINDOW, let(windows, _repeated)).otherwise(F.lit(0)).cast("long").alias("repeated"),
            F.size(F.array_distinct(hashes)).cast("long").alias("distinct"),
        )

    return let(F.transform(words, lambda w: F.xxhash64(w)), of)


#: What rules may look at, beside n_words: shares, so that a threshold means the same for short and long texts.
FEATURES: dict[str, str] = {
    "n_words": "n_words",
    "word_length": "word_chars / greatest(n_words, 1)",
    "symbol_share": "n_symbols / greatest(n_words, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "distinct_share": "n_distinct_words / greatest(n_words, 1)",
    "upper_share": "n_upper / greatest(word_chars, 1)",
    "exclamation_share": "n_exclamation / greatest(n_words, 1)",
    "line_words": "n_words / greatest(n_lines, 1)",
}


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds counts of each whole text: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines,
    n_distinct_words, n_upper, n_exclamation. NULL counts as empty. Windows compare by 64-bit hashes of five words.
    Columns with these names are replaced.
    """
    content = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    trimmed = F.btrim(content, F.lit(SPACE))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPLIT, -1))
    lines = F.filter(F.split(content, "\n", -1), lambda x: F.btrim(x, F.lit(SPACE)) != "")
    rows = docs.withColumns({"__words": _word_counts(words), "__lines": let(lines, lambda x: F.struct(F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("d")))})
    counts = {
        "n_words": F.col("__words.n"),
        "word_chars": F.length(F.regexp_replace(content, SPLIT, "")).cast("long"),
        "n_symbols": F.length(F.regexp_replace(content, r"[^#*$%&|<>]+", "")).cast("long"),
        "n_dup_lines": (F.col("__lines.n") - F.col("__lines.d")).cast("long"),
        "n_repeat_words": F.col("__words.repeated"),
        "n_lines": F.col("__lines.n").cast("long"),
        "n_distinct_words": F.col("__words.distinct"),
        "n_upper": F.length(F.regexp_replace(content, r"[^A-Z]+", "")).cast("long"),
        "n_exclamation": (F.length(content) - F.length(F.replace(content, F.lit("!"), F.lit("")))).cast("long"),
    }
    return rows.withColumns(counts).drop("__words", "__lines")


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        value = F.expr(FEATURES[self.feature]).cast("double")
        return value > self.threshold if self.above else value <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:g}"


@dataclass(frozen=True)
class Rule:
    """Rejects what meets all conditions; counts are those of the pruning rows when it was made."""

    conditions: tuple[Condition, ...]
    rejected_bad: int
    rejected_good: int

    def column(self) -> Column:
        return reduce(lambda a, b: a & b, (c.column() for c in self.conditions))


@dataclass(frozen=True)
class Learning:
    """thresholds: candidates a feature (quantiles); precision: least share of bad rows among those a rule rejects;
    least: bad rows that a rule must reject; parts: one of so many parts of the rows prunes."""

    thresholds: int = 31
    rules: int = 12
    conditions: int = 4
    precision: float = 0.97
    least: int = 3
    parts: int = 3


def _gain(bad: int, good: int, all_bad: int, all_good: int) -> float:
    if not bad:
        return 0.0
    return bad * (math.log2(bad / (bad + good)) - math.log2(all_bad / (all_bad + all_good)))


def learn(labelled: DataFrame, learning: Learning = Learning()) -> list[Rule]:
    """Rules from rows with the statistics and a boolean `bad`, all of them. Empty or one-sided labels: no rules.

    `labelled` is read once per step, so pass a written table.
    """
    names = list(FEATURES)
    values = labelled.select("bad", (F.pmod(F.xxhash64(*FEATURES_COUNTS), F.lit(learning.parts)) == 0).alias("prune"), *(F.expr(FEATURES[n]).cast("double").alias(n) for n in names))
    steps = [i / (learning.thresholds + 1) for i in range(1, learning.thresholds + 1)]
    # Extremes of the bad rows matter most, so thresholds come from either class.
    cuts = values.groupBy("bad").agg(*(F.percentile_approx(n, steps, 2000).alias(n) for n in names)).collect()
    limits = {n: sorted({x for row in cuts for x in row[n] or ()}) for n in names}

    def bin_of(n: str) -> Column:
        return F.size(F.filter(F.array(*map(F.lit, limits[n])), lambda t: t < F.col(n))) if limits[n] else F.lit(0)

    binned = values.select("bad", "prune", F.explode(F.array(*(F.struct(F.lit(n).alias("feature"), bin_of(n).alias("bin")) for n in names))).alias("x"), *names)

    def met(conditions: list[Condition]) -> Column:
        return reduce(lambda a, b: a & b, ((F.col(c.feature) > c.threshold if c.above else F.col(c.feature) <= c.threshold) for c in conditions), F.lit(True))

    def counts(rest: Column, conditions: list[Condition]) -> dict[str, list[tuple[int, int, int]]]:
        """Of each feature (bin, bad, good) of the growing rows that the conditions cover."""
        rows = binned.filter(rest & met(conditions) & ~F.col("prune")).groupBy("x.feature", "x.bin")
        out: dict[str, list] = {n: [] for n in names}
        for r in rows.agg(F.count_if("bad").alias("b"), F.count_if(~F.col("bad")).alias("g")).collect():
            out[r["feature"]].append((r["bin"], r["b"], r["g"]))
        return {n: sorted(x) for n, x in out.items()}

    def best(found: dict, conditions: list[Condition]) -> tuple[float, Condition | None, int, int]:
        all_bad, all_good = (sum(x[k] for x in found[names[0]]) for k in (1, 2))
        top: tuple[float, Condition | None, int, int] = (0.0, None, all_bad, all_good)
        if not all_bad or not all_good:
            return top
        for n in names:
            for j, t in enumerate(limits[n]):
                low = [sum(x[k] for x in found[n] if x[0] <= j) for k in (1, 2)]
                for above, (b, g) in ((False, low), (True, [all_bad - low[0], all_good - low[1]])):
                    if (gain := _gain(b, g, all_bad, all_good)) > top[0] + 1e-9:
                        top = (gain, Condition(n, above, t), b, g)
        return top

    rules: list[Rule] = []
    rest = F.lit(True)
    while len(rules) < learning.rules:
        grown: list[Condition] = []
        while len(grown) < learning.conditions:
            _, condition, _, good = best(counts(rest, grown), grown)
            if condition is None:
                break
            grown.append(condition)
            if not good:
                break
        if not grown:
            break
        prefixes = [met(grown[:k]) for k in range(1, len(grown) + 1)]
        sums = [F.count_if(p & F.col("bad")) for p in prefixes] + [F.count_if(p & ~F.col("bad")) for p in prefixes]
        row = list(values.filter(rest & F.col("prune")).agg(*(s.alias(f"c{i}") for i, s in enumerate(sums))).first())
        k = max(range(len(grown)), key=lambda i: ((row[i] - row[i + len(grown)]) / max(1, row[i] + row[i + len(grown)]), row[i], -i))
        bad, good = row[k], row[k + len(grown)]
        if bad < learning.least or bad < learning.precision * (bad + good):
            break
        rules.append(Rule(tuple(grown[: k + 1]), bad, good))
        rest = rest & ~met(grown[: k + 1])
    return rules


FEATURES_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct_words", "n_upper", "n_exclamation"]


def verdict(rules: list[Rule]) -> Column:
    """true for what no rule rejects: the rules in their order as one conditional expression."""
    out = None
    for rule in rules:
        out = F.when(rule.column(), F.lit(False)) if out is None else out.when(rule.column(), F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def labels_of(labels: DataFrame, key: str = "doc_id", quality: str = "quality") -> DataFrame:
    """(key, bad): one row per labelled key. NULL keys and labels, and keys with both labels, are left out."""
    usable = labels.filter(F.col(key).isNotNull() & F.col(quality).isNotNull())
    both = usable.groupBy(key).agg(F.min(quality).alias("__low"), F.max(quality).alias("__high"))
    return both.filter(F.col("__low") == F.col("__high")).select(key, (F.col("__low") == 0).alias("bad"))
