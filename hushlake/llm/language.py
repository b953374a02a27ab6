"""Language identification by unigrams with all segmentations summed.

Each language has a probability for every piece of a fixed public vocabulary. A
word's probability in a language is the sum over all its segmentations into
pieces, which a forward algorithm gives without listing them; a text's is the
product over its words. The probabilities come from expectation-maximisation,
where a forward-backward pass counts each piece as often as it is expected in
the words of that language.

Words are runs of letters in lower case, with the vocabulary's mark in front. All
of the vocabulary's pieces of letters are used. Words of up to GROUPED letters go
through the lattice many at a time; longer ones, of any length, one by one, with
sums scaled as they shrink, so that nothing is cut. A text that is null or has no letter is ``und`` with score 0. The score is
the posterior of the language named. Only text and language are read: ids,
sources, other columns and repeated rows make no difference, an empty table gives no row.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hushlake.llm.common import in_third, tokenizer_path, written

UNKNOWN = "und"
MARK = "▁"
#: Letters up to which words of one length are put together; their sums need no scaling.
GROUPED = 24
#: Documents per language that the model is fitted on, chosen by hash.
SAMPLE = 1000
ROUNDS = 3
SMOOTHING = 0.05
#: Words kept with their scores in each Python worker, and their letters.
MEMO, MEMO_LETTERS = 150_000, 8_000_000
#: Words of some texts that are scored together.
FLUSH = 60_000
_letters = regex.compile(r"\p{L}+").findall
BASE = np.uint64(0x9E3779B97F4A7C15)


def words(text: str) -> list[str]:
    """Letter runs in lower case."""
    return _letters(text.lower())


def pieces(path: str | None = None) -> list[str]:
    """The vocabulary's pieces of letters, with or without the mark."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path or tokenizer_path("piece_bpe_32k.model"))
    listed = (model.id_to_piece(i) for i in range(model.get_piece_size()))
    kept = {p.lower() for p in listed if p.removeprefix(MARK).isalpha()}
    return sorted(kept | {MARK})


def _hashes(rows: np.ndarray) -> np.ndarray:
    """Prefix hashes of each row of code points, one column more than characters."""
    out = np.zeros((rows.shape[0], rows.shape[1] + 1), np.uint64)
    for j in range(rows.shape[1]):
        out[:, j + 1] = out[:, j] * BASE + rows[:, j] + np.uint64(1)
    return out


class Lattice:
    """Every way to cut words into pieces, for many words of one length at once."""

    def __init__(self, vocabulary: list[str]) -> None:
        keys = np.array([_hashes(np.array([[ord(c) for c in p]], np.uint64))[0, -1] for p in vocabulary], np.uint64)
        self.order = np.argsort(keys)
        self.keys = keys[self.order]
        self.size = len(vocabulary)
        self.longest = max(map(len, vocabulary))
        self.powers = np.array([pow(int(BASE), k, 1 << 64) for k in range(self.longest + 1)], np.uint64)

    def _pieces(self, wanted: np.ndarray) -> np.ndarray:
        """The pieces with these hashes; ``size`` where there is none."""
        place = np.minimum(np.searchsorted(self.keys, wanted), self.size - 1)
        return np.where(self.keys[place] == wanted, self.order[place], self.size)

    def arcs(self, group: list[str]) -> list[list[np.ndarray]]:
        """arcs[j][k]: for each word, the piece that ends at j and is k + 1 long; ``size`` where there is none."""
        flat = np.frombuffer("".join(MARK + w for w in group).encode("utf-32-le"), "<u4").astype(np.uint64)
        prefix = _hashes(flat.reshape(len(group), -1))
        out = []
        for j in range(1, prefix.shape[1]):
            row = []
            for k in range(1, min(j, self.longest) + 1):
                row.append(self._pieces(prefix[:, j] - prefix[:, j - k] * self.powers[k]))
            out.append(row)
        return out

    def arcs_of_one(self, word: str) -> np.ndarray:
        """For a word of any length: [j, k - 1] is the piece that ends at j and is k long; ``size`` where there is none."""
        codes, prefix = [ord(c) for c in MARK + word], [0]
        for code in codes:
            prefix.append((prefix[-1] * int(BASE) + code + 1) & 0xFFFFFFFFFFFFFFFF)
        prefix = np.array(prefix, np.uint64)
        out = np.full((len(prefix), self.longest), self.size)
        for k in range(1, min(len(codes), self.longest) + 1):
            out[k:, k - 1] = self._pieces(prefix[k:] - prefix[:-k] * self.powers[k])
        return out


def by_length(listed: list[str]) -> Iterator[np.ndarray]:
    sizes = np.fromiter(map(len, listed), np.int64, len(listed))
    for n in np.unique(sizes):
        yield np.flatnonzero(sizes == n)


def parts(group: np.ndarray) -> list[np.ndarray]:
    """The group in parts whose lattices take little memory."""
    return np.array_split(group, len(group) // 4_000 + 1)


@dataclass(frozen=True)
class Model:
    """chances[piece, language]; a last row stands for any single character that is no piece."""

    languages: list[str]
    vocabulary: list[str]
    chances: np.ndarray


def forward(arcs: list[list[np.ndarray]], chances: np.ndarray) -> list[np.ndarray]:
    """The sum over all segmentations of each prefix: (words, languages) for each length."""
    none = len(chances) - 1
    out = [np.ones((len(arcs[0][0]), chances.shape[1]))]
    for j, row in enumerate(arcs, 1):
        total = out[j - 1] * chances[row[0]]
        for k, found in enumerate(row[1:], 2):
            hit = np.flatnonzero(found != none)
            total[hit] += out[j - k][hit] * chances[found[hit]]
        out.append(total)
    return out


#: Sums under this are scaled up by its inverse.
TINY = 1e-120


def forward_of_one(arcs: np.ndarray, chances: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For one word, the sum over all segmentations of each prefix as a number and the logarithm of its scale.

    Both are (prefixes, languages); each language has its own scale.
    """
    none, (rows, longest) = len(chances) - 1, arcs.shape
    out, scale = np.zeros((rows, chances.shape[1])), np.zeros((rows, chances.shape[1]))
    out[0] = 1
    for j in range(1, rows):
        found = arcs[j, : min(j, longest)]
        ks = np.flatnonzero(found != none) + 1
        if not len(ks) or ks[0] != 1:
            ks = np.concatenate([[1], ks])  # a single character that is no piece
        scale[j] = scale[j - 1]
        out[j] = (out[j - ks] * chances[arcs[j, ks - 1]]).sum(0)
        small = out[j] < TINY
        if small.any():
            # All that later sums may still need gets the new scale.
            since = max(0, j - longest)
            out[since : j + 1, small] /= TINY
            scale[since : j + 1, small] += np.log(TINY)
    return out, scale


def expected_of_one(arcs: np.ndarray, chances: np.ndarray, times: float) -> np.ndarray:
    """As ``expected``, for one word of any length in one language."""
    none, (rows, longest) = len(chances) - 1, arcs.shape
    before, up = forward_of_one(arcs, chances)
    # The sums from behind are those of the word turned round.
    turned = np.full_like(arcs, none)
    for k in range(1, min(rows - 1, longest) + 1):
        turned[k:, k - 1] = arcs[k:, k - 1][::-1]
    after, down = (x[::-1] for x in forward_of_one(turned, chances))
    counts, whole = np.zeros(len(chances)), np.log(before[-1, 0]) + up[-1, 0]
    for k in range(1, min(rows - 1, longest) + 1):
        found = arcs[k:, k - 1]
        hit = np.arange(len(found)) if k == 1 else np.flatnonzero(found != none)
        shares = before[hit, 0] * chances[found[hit], 0] * after[hit + k, 0] * np.exp(up[hit, 0] + down[hit + k, 0] - whole)
        counts += times * np.bincount(found[hit], shares, len(chances))
    return counts


def expected(arcs: list[list[np.ndarray]], chances: np.ndarray, times: np.ndarray) -> np.ndarray:
    """How often each piece is expected in words that occur ``times`` often, in one language (``chances`` has one column)."""
    none, n = len(chances) - 1, len(arcs)
    before = forward(arcs, chances)
    after = [np.zeros_like(before[0]) for _ in range(n)] + [np.ones_like(before[0])]
    counts, share = np.zeros(len(chances)), times / before[n][:, 0]
    for j in range(n, 0, -1):
        for k, found in enumerate(arcs[j - 1], 1):
            hit = np.arange(len(found)) if k == 1 else np.flatnonzero(found != none)
            moved = chances[found[hit]] * after[j][hit]
            after[j - k][hit] += moved
            counts += np.bincount(found[hit], (before[j - k][hit] * moved)[:, 0] * share[hit], len(chances))
    return counts


def sample(docs: DataFrame, size: int = SAMPLE) -> DataFrame:
    """(lang, text) of up to ``size`` documents of each language, chosen by hash among those that may be learned from."""
    ids = docs.filter("doc_id IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL").filter(~in_third(1)).select("doc_id", "lang")
    # A threshold that leaves about three times as many comes first, so that no task ranks a whole language.
    hashed = F.xxhash64("doc_id")
    share = F.shiftrightunsigned(hashed, 11) / F.lit(float(1 << 53))
    sizes = ids.groupBy("lang").agg(F.count("*").alias("n"))
    # One row a language, of which a model holds all with a column each, so they may be broadcast.
    few = ids.join(F.broadcast(sizes), "lang").filter(share < (3.0 * size + 100) / F.col("n"))
    # The order is that of the share, so what is over the threshold comes behind all that is not.
    first = Window.partitionBy("lang").orderBy(F.shiftrightunsigned(hashed, 11), hashed, "doc_id")
    few = few.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= size)
    # ``size`` ids for each language at most, so the ids may be broadcast.
    return docs.select("doc_id", "text", "lang").join(F.broadcast(few.select("doc_id", "lang")), ["doc_id", "lang"]).select("lang", "text")


def word_counts(labelled: DataFrame) -> DataFrame:
    """(lang, word, n) over (lang, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: Counter = Counter()
            for lang, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                counts.update((lang, w) for w in words(text))
            rows = [(lang, w, n) for (lang, w), n in counts.items()]
            columns = list(zip(*rows, strict=True)) or [[], [], []]
            kinds = (pa.string(), pa.string(), pa.int64())
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["lang", "word", "n"])

    return labelled.mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def together(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.Table]:
    """Batches put together to ``size`` rows or a little more."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= size:
            yield pa.Table.from_batches(held)
            held = []
    if held:
        yield pa.Table.from_batches(held)


def _expectations(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(model.vocabulary)
        counts = np.zeros_like(model.chances)
        for rows in together(batches, FLUSH):
            langs, listed = (np.array(rows.column(i).to_pylist(), object) for i in (0, 1))
            times = rows.column(2).to_numpy().astype(float)
            for at, lang in enumerate(model.languages):
                own, chances = np.flatnonzero(langs == lang), model.chances[:, [at]]
                for group in by_length([listed[i] for i in own]):
                    if len(listed[own[group[0]]]) > GROUPED:
                        counts[:, at] += sum(expected_of_one(lattice.arcs_of_one(listed[i]), chances, times[i]) for i in own[group])
                        continue
                    for some in parts(own[group]):
                        counts[:, at] += expected(lattice.arcs(list(listed[some])), chances, times[some])
        piece, lang = np.nonzero(counts)
        yield pa.record_batch(
            [pa.array(piece, pa.int64()), pa.array(lang, pa.int64()), pa.array(counts[piece, lang], pa.float64())],
            names=["piece", "lang", "n"],
        )

    return run


def fit(docs: DataFrame, size: int = SAMPLE, rounds: int = ROUNDS, path: str | None = None) -> Model:
    """Probabilities after ``rounds`` of expectation-maximisation over a sample of ``size`` documents of each language.

    What comes to the driver has a row for each piece and language at most.
    """
    counted = written(word_counts(sample(docs, size)), "words")
    languages = sorted(r[0] for r in counted.select("lang").distinct().collect())
    vocabulary = pieces(path)
    model = Model(languages, vocabulary, np.full((len(vocabulary) + 1, len(languages)), 1 / (len(vocabulary) + 1)))
    for _ in range(rounds if languages else 0):
        sums = counted.mapInArrow(_expectations(model), "piece long, lang long, n double")
        # Rounded before the sum, so that the order of partial sums makes no difference.
        sums = sums.groupBy("piece", "lang").agg(F.sum(F.round(F.col("n") * 1e6).cast("long")).alias("n")).toArrow()
        counts = np.full(model.chances.shape, SMOOTHING)
        piece, lang, n = (sums.column(i).to_numpy() for i in range(3))
        counts[piece, lang] += n / 1e6
        model = Model(languages, vocabulary, counts / counts.sum(0))
    return model


class Scorer:
    """Log-probabilities of words in every language, kept as they turn up."""

    def __init__(self, model: Model) -> None:
        self.model, self.lattice = model, Lattice(model.vocabulary)
        self.place: dict[str, int] = {}
        self.logs, self.letters = np.zeros((0, len(model.languages))), 0

    def add(self, listed: list[str]) -> None:
        if len(self.place) > MEMO or self.letters > MEMO_LETTERS:
            self.place, self.logs, self.letters = {}, self.logs[:0], 0
        new = [w for w in dict.fromkeys(listed) if w not in self.place]
        self.letters += sum(map(len, new))
        logs = np.zeros((len(new), self.logs.shape[1]))
        for group in by_length(new):
            if len(new[group[0]]) > GROUPED:
                for i in group:
                    sums, scale = forward_of_one(self.lattice.arcs_of_one(new[i]), self.model.chances)
                    logs[i] = np.log(sums[-1]) + scale[-1]
                continue
            for some in parts(group):
                logs[some] = np.log(forward(self.lattice.arcs([new[i] for i in some]), self.model.chances)[-1])
        self.place.update(zip(new, range(len(self.logs), len(self.logs) + len(new)), strict=True))
        self.logs = np.vstack([self.logs, logs])

    def totals(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The log-probability of each text in each language, and its number of words."""
        out, sizes = np.zeros((len(texts), self.logs.shape[1])), np.zeros(len(texts), np.int64)
        flat: list[str] = []
        first = 0
        for at, text in enumerate(texts):
            found = words(text or "")
            sizes[at] = len(found)
            flat += found
            if flat and (len(flat) > FLUSH or at == len(texts) - 1):  # so that the words held stay bounded
                self.add(flat)
                codes = np.fromiter(map(self.place.__getitem__, flat), np.int64, len(flat))
                owner = np.repeat(np.arange(at + 1 - first), sizes[first : at + 1])
                for lang in range(out.shape[1]):
                    out[first : at + 1, lang] = np.bincount(owner, self.logs[codes, lang], at + 1 - first)
                flat, first = [], at + 1
        return out, sizes


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score for every row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            names, scores = scored(scorer, batch.column(1).to_pylist())
            yield pa.record_batch(
                [batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                names=["doc_id", "lang_pred", "score"],
            )

    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return texts.mapInArrow(run, "doc_id long, lang_pred string, score double")


def scored(scorer: Scorer, texts: list[str | None]) -> tuple[list[str], list[float]]:
    logs, sizes = scorer.totals(texts)
    if not scorer.model.languages:
        return [UNKNOWN] * len(texts), [0.0] * len(texts)
    share = np.exp(logs - logs.max(1, keepdims=True))
    share /= share.sum(1, keepdims=True)
    best = share.argmax(1)
    names = [scorer.model.languages[b] if n else UNKNOWN for b, n in zip(best, sizes, strict=True)]
    return names, [float(s) if n else 0.0 for s, n in zip(share.max(1), sizes, strict=True)]


def keep_known(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose text is in a known language with a score of ``least`` or more, with all columns."""
    schema = docs.schema
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            names, scores = scored(scorer, batch.column(at).to_pylist())
            yield batch.filter(pa.array([n != UNKNOWN and s >= least for n, s in zip(names, scores, strict=True)], pa.bool_()))

    return docs.mapInArrow(run, schema)
