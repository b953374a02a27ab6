"""Quality rules by weak supervision.

Each rule votes good, bad or abstains. Documents are counted by their pattern
of votes, and expectation-maximisation over these counts estimates how
accurate each rule is and what share is good, without labels, among those the base rule passes. A document's
verdict is the posterior probability that it is good, not whether every rule passed.

Null and empty texts have zero counts, and fail the base rule. Repeated rows and null ids
come back as they are, an empty table gives no row, other columns are not read. The
texts are read once, whole; the counts of patterns have 3^rules rows at most.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushlake.llm.common import BLANKS, written

SYMBOLS = "#*$%&|<>"
SENTENCE_ENDS = (b".", b"!", b"?", b":", b";", "…".encode(), b'"', b")")
#: Frequent function words of the languages covered.
FUNCTION_WORDS = frozenset(
    b"the of and to in is it that for with on as this by from was are be "
    b"le la les de des un une et est que qui en pour dans du au sur pas avec "
    b"der die das und ist nicht ein eine von zu mit den dem auf im sich als "
    b"el los las y es un una por para con del se no lo su al".split()
)
RULES = ("symbols", "word_length", "capitals", "dup_lines", "repeats", "line_ends", "function_words", "shouting", "variety")


@dataclass(frozen=True)
class Base:
    n_words: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int


def repeated(words: list[bytes]) -> int:
    """Words in three-word windows that occur twice or more, the first occurrence included."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    counts = Counter(windows)
    if len(counts) == len(windows):
        return 0
    many = np.fromiter(map(counts.__getitem__, windows), np.int64, len(windows)) > 1
    covered = np.zeros(len(words), bool)
    for shift in range(3):
        covered[shift : shift + len(windows)] |= many
    return int(covered.sum())


def base(text: str, words: list[bytes], lines: list[bytes]) -> Base:
    seen: set[bytes] = set()
    dup = 0
    for line in lines:
        if line in seen:
            dup += 1
        seen.add(line)
    blanks = sum(map(text.count, BLANKS))
    return Base(len(words), len(text) - blanks, sum(map(text.count, SYMBOLS)), dup, repeated(words))


def votes(text: str, words: list[bytes], lines: list[bytes], of: Base) -> list[int]:
    """One vote for each of RULES: 1 good, -1 bad, 0 abstains.

    A rule that looks for a defect abstains where it finds none; only what
    prose must have (function words, sentences that end) speaks for a text.
    """
    n = of.n_words
    if not n:
        return [0] * len(RULES)
    mean = of.word_chars / n
    ends = sum(line.rstrip().endswith(SENTENCE_ENDS) for line in lines) / len(lines)
    distinct = Counter(words)
    common = sum(distinct[w] for w in FUNCTION_WORDS) / n
    return [
        -int(of.n_symbols >= 0.1 * n),
        -int(not 2.5 <= mean <= 12),
        -int(sum(map(str.isupper, text.split())) >= 0.3 * n),
        -int(of.n_dup_lines >= 0.3 * len(lines)),
        -int(of.n_repeat_words >= 0.3 * n),
        1 if ends >= 0.6 else -1 if ends <= 0.2 else 0,
        1 if common >= 0.05 else -1 if common < 0.02 else 0,
        -int(text.count("!!") >= 0.05 * n),
        -int(n < 2000 and len(distinct) <= 0.15 * n),
    ]


def measured(docs: DataFrame) -> DataFrame:
    """The base columns and the pattern of votes of every row, as a number in base 3."""
    columns = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "pattern"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                text = text or ""
                raw = text.encode()
                words, lines = raw.split(), [x for x in raw.split(b"\n") if x.strip()]
                of = base(text, words, lines)
                pattern = sum((vote + 1) * 3**i for i, vote in enumerate(votes(text, words, lines, of)))
                rows.append((of.n_words, of.word_chars, of.n_symbols, of.n_dup_lines, of.n_repeat_words, pattern))
            made = [pa.array([r[i] for r in rows], pa.int64()) for i in range(len(columns))]
            yield pa.record_batch([batch.column(0), *made], names=["doc_id", *columns])

    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return texts.mapInArrow(run, "doc_id long, " + ", ".join(f"{c} long" for c in columns))


@dataclass(frozen=True)
class Model:
    """Share of good documents, and how often each rule votes bad, abstains and votes good, on bad and on good documents."""

    good: float
    chance: np.ndarray  # [0 bad, 1 good][rule][vote + 1]

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """Probability that a document with this pattern is good."""
        gain = np.log(self.chance[1] / self.chance[0])
        odds = np.log(self.good / (1 - self.good)) + gain[np.arange(len(RULES)), unpacked(patterns) + 1].sum(1)
        return 1 / (1 + np.exp(-odds))


def unpacked(patterns: np.ndarray) -> np.ndarray:
    return np.stack([patterns // 3**i % 3 - 1 for i in range(len(RULES))], 1)


#: Where the search begins, for rules that look for a defect and for those that vote either way.
DEFECT = [[0.30, 0.69, 0.01], [0.02, 0.97, 0.01]]
EITHER = [[0.50, 0.25, 0.25], [0.05, 0.15, 0.80]]
BEGIN = np.array([EITHER if rule in ("line_ends", "function_words") else DEFECT for rule in RULES]).transpose(1, 0, 2)
#: Imagined documents that pull each rule's rates towards these.
PULL = 20.0


def fit(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100) -> Model:
    """Expectation-maximisation over counted patterns.

    A vote never counts in reverse: bad votes are at least as frequent among bad documents as
    among good ones, so good and bad cannot trade places.
    """
    model = Model(0.8, BEGIN)
    if not len(patterns):
        return model
    cast = unpacked(patterns)
    for _ in range(rounds):
        good = model.posterior(patterns) * counts
        sums = np.stack([[mass @ (cast == vote) for vote in (-1, 0, 1)] for mass in (counts - good, good)]).transpose(0, 2, 1)
        chance = (sums + PULL * BEGIN) / (sums.sum(2, keepdims=True) + PULL)
        against = np.maximum(chance[0, :, :1], chance[1, :, :1])
        chance[0] = np.hstack([against, chance[0, :, 1:] * (1 - against) / (1 - chance[0, :, :1])])
        model = Model(float(np.clip((good.sum() + 8) / (counts.sum() + 10), 0.5, 0.95)), chance)
    return model


def judge(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """Base columns, base_failed, posterior and kept for every row of ``docs``."""
    rows = written(measured(docs), "votes")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    counted = rows.filter(~failed).groupBy("pattern").count().orderBy("pattern").toArrow()
    patterns, counts = (counted.column(i).to_numpy() for i in range(2))
    model = fit(patterns, counts.astype(float))
    seen = rows.select("pattern").distinct().orderBy("pattern").toArrow().column(0).to_numpy()
    chances = list(zip(seen.tolist(), model.posterior(seen).tolist(), strict=True))
    # A row for each pattern seen, 3^rules at most, so it may be broadcast.
    known = F.broadcast(rows.sparkSession.createDataFrame(chances, "pattern long, posterior double"))
    return rows.join(known, "pattern").withColumn("base_failed", failed).withColumn(
        "kept", ~F.col("base_failed") & (F.col("posterior") >= least)
    )
