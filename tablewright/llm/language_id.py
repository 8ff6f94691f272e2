"""Language identification as inference of a mixture.

Each language is a distribution over hashed character trigrams, counted over all labelled training texts. A text is a
mixture of languages: expectation-maximisation estimates the share of each (and of a flat background, for what is no
learned language), then languages are dropped from the set as long as the penalised likelihood rises.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tablewright.llm.common import ship

#: Trigrams are hashed into so many cells; a model is languages x CELLS numbers.
CELLS = 1 << 15
UND = "und"
_LETTER: list[np.ndarray] = []


@dataclass(frozen=True)
class Settings:
    """smoothing: added to each count; rounds: of expectation-maximisation at most; penalty: times the
    logarithm of the number of trigrams, what each language beyond the first must add to the log-likelihood."""

    smoothing: float = 0.5
    rounds: int = 25
    penalty: float = 4.0


@dataclass
class Model:
    languages: list[str]
    chances: np.ndarray  # (languages + 1) x CELLS, the last row is the flat background


def _letters() -> np.ndarray:
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _LETTER[0]


def trigrams(text: str) -> np.ndarray:
    """Cells of the trigrams of a text: letters in lower case, anything between words is one space. No letter: empty."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    letter = _letters()[codes]
    if not letter.any():
        return np.empty(0, np.int64)
    codes = np.where(letter, codes, 32).astype(np.uint32)
    codes = np.concatenate([[32], codes, [32]]).astype(np.uint32)
    codes = codes[np.concatenate([[True], (codes[1:] != 32) | (codes[:-1] != 32)])]
    a, b, c = codes[:-2], codes[1:-1], codes[2:]
    mixed = a * np.uint32(2654435761) ^ b * np.uint32(2246822519) ^ c * np.uint32(3266489917)
    return ((mixed ^ (mixed >> np.uint32(15))) * np.uint32(2654435769) >> np.uint32(17)).astype(np.int64)


def train(docs: DataFrame, text: str = "text", lang: str = "lang", settings: Settings = Settings()) -> Model:
    """Counts all rows with a language and a text. What comes back to the driver is languages x CELLS counts.

    Each task adds up its own counts first, then one sum per cell. No rows: a model without languages.
    """
    ship(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            for own, language in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                cells = trigrams(own)
                if len(cells):
                    if language not in totals:
                        totals[language] = np.zeros(CELLS, np.int64)
                    if len(cells) < CELLS // 8:
                        np.add.at(totals[language], cells, 1)
                    else:
                        totals[language] += np.bincount(cells, minlength=CELLS)
        for language, counts in totals.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([language] * len(at)), pa.array(at), pa.array(counts[at])], names=["language", "cell", "n"])

    rows = docs.select(F.col(text), F.col(lang).cast("string").alias("lang")).dropna()
    sums = rows.mapInArrow(count, "language string, cell long, n long").groupBy("language", "cell").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(sums["language"].unique())
    chances = np.full((len(languages) + 1, CELLS), 1.0 / CELLS)
    for i, language in enumerate(languages):
        own = sums[sums["language"] == language]
        counts = np.full(CELLS, settings.smoothing)
        counts[own["cell"].to_numpy()] += own["n"].to_numpy()
        chances[i] = counts / counts.sum()
    return Model(languages, chances)


def mixture(cells: np.ndarray, model: Model, settings: Settings = Settings()) -> tuple[list[int], np.ndarray]:
    """The language set (numbers, largest share first) and the shares of all languages and the background."""
    kinds, counts = np.unique(cells, return_counts=True)
    chances, total = model.chances[:, kinds], counts.sum()

    def fit(which: list[int], share: np.ndarray, rounds: int) -> tuple[np.ndarray, float]:
        own = chances[which]
        for _ in range(rounds):
            parts = share[:, None] * own
            new = (parts / parts.sum(0)) @ counts / total
            done = np.abs(new - share).max() < 1e-3
            share = new
            if done:
                break
        return share, float(np.log(share @ own) @ counts)

    every = list(range(len(chances)))
    shares, _ = fit(every, np.full(len(every), 1 / len(every)), settings.rounds)
    order = [int(i) for i in np.argsort(-shares[:-1], kind="stable")]
    single = np.log(chances[:-1]) @ counts
    chosen, best = [int(np.argmax(single))], float(single.max())
    for k in range(2, len(order) + 1):
        which = order[:k]
        start = shares[which] + 1e-6
        if shares[which[-1]] < 0.02:
            break
        _, likelihood = fit(which, start / start.sum(), 8)
        penalised = likelihood - settings.penalty * (k - 1) * math.log(total)
        if penalised <= best:
            break
        chosen, best = which, penalised
    return chosen, shares


RESULT = "lang_pred string, score double, langs array<string>, other double"


def predict(docs: DataFrame, model: Model, text: str = "text", settings: Settings = Settings()) -> DataFrame:
    """Adds lang_pred, score (its share, 0 to 1), langs (the chosen set, largest first) and other (the background's share).

    The prediction reads the whole text and nothing else. NULL, no letter, or a model without languages: `und`, score 0,
    empty set, other 1. Columns with these names are replaced. No shuffle; the model is broadcast (languages x CELLS).
    """
    ship(docs.sparkSession)
    added = T._parse_datatype_string(RESULT).fields
    kept = [f for f in docs.schema.fields if f.name not in {a.name for a in added}]
    names = [f.name for f in kept]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            out = []
            for value in batch.column(batch.schema.get_field_index(text)).to_pylist():
                cells = trigrams(value) if value and own.languages else ()
                if not len(cells):
                    out.append((UND, 0.0, [], 1.0))
                    continue
                chosen, shares = mixture(cells, own, settings)
                chosen = sorted(chosen, key=lambda i: -shares[i])
                out.append((own.languages[chosen[0]], float(min(1.0, shares[chosen[0]])), [own.languages[i] for i in chosen], float(shares[-1])))
            made = list(zip(*out)) if out else [[], [], [], []]
            types = [pa.string(), pa.float64(), pa.list_(pa.string()), pa.float64()]
            columns = [batch.column(batch.schema.get_field_index(n)) for n in names]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array(m, t) for m, t in zip(made, types))], names=[*names, *(a.name for a in added)])

    return docs.mapInArrow(run, T.StructType([*kept, *added]))


def held_out(key: Column) -> Column:
    """True for a quarter of the keys, by their checksum; false for a NULL key."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))
