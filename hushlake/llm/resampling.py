"""Importance resampling towards a target distribution, with an exact distributed cut.

Features are the runs of 1 to ``longest`` consecutive words, hashed into BUCKETS
buckets. A bucket's gain is the log ratio of its share in the target texts to
its share in the corpus; a document's weight adds up the gains of its features.
Gumbel noise, fixed by seed and doc_id, turns the highest scores into a draw
without replacement.

1. ``features`` reads each text once and writes its bucket numbers (two bytes a
   feature). Counts of buckets and weights come from these arrays: the gains are
   one array of BUCKETS numbers, and a weight is a sum over picked elements.
2. The cut is found by a weighted median of medians. Each task gives the median
   key of its part of the rows still in question, and how many those are. The
   median of these, weighted by the sizes, is the pivot: at least a quarter of
   the rows in question lies on either side of it, so each round settles that
   share or more, whatever the order or skew of the rows. One job a round counts
   the rows ahead of the pivot and brings the medians of both sides; the driver
   sees two medians a task. Once a quarter of the rows last written is in
   question, those are written as a smaller table.
3. The rows up to the cut are sorted by range, and a prefix sum over the parts'
   sizes gives ranks.

Keys are (score descending, null doc_id last, doc_id ascending, row number of
the scan), so no two are equal: ties and repeated rows are cut exactly.

Null text has no words; a document without words has weight 0. Null doc_id is
hashed as empty text. Documents under ``min_words`` words are scored, never
drawn. Texts of any length are read as a whole, in pieces. An empty table, or a
draw of none, gives null ranks or no row. An empty target gives each bucket the
ratio that no occurrence has. Other columns are not read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushlake.llm.common import written

BUCKETS = 10_000
MIN_WORDS = 20
SEED = 2024
#: Words that a worker keeps with their buckets, and their length in bytes at most.
MEMO, MEMO_WORD = 200_000, 64
#: Bytes of a text that are cut into words at a time.
PIECE = 1 << 22
#: Rows in question that the driver may sort itself.
LAST = 2000
#: Upper-case letters to lower case; digits, letters and bytes beyond ASCII as they are; all else to a blank.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 or 48 <= b <= 57 else 32 for b in range(256))


def words(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text in order, as lists for pieces of it."""
    folded = text.translate(LETTERS)
    at = 0
    while at < len(folded):
        cut = folded.find(b" ", at + PIECE)
        end = len(folded) if cut < 0 else cut
        yield folded[at:end].split()
        at = end


class Buckets(dict):
    """Feature to its bucket, filled as features turn up."""

    def __init__(self, number: int) -> None:
        self.number = number

    def __missing__(self, feature: bytes) -> int:
        bucket = zlib.crc32(feature) % self.number
        if len(feature) <= MEMO_WORD and len(self) < MEMO:
            self[feature] = bucket
        return bucket


def text_buckets(text: bytes, look: Buckets, longest: int = 1) -> tuple[int, np.ndarray]:
    """How many words the text has, and the bucket of each of its features."""
    found, n_words, carried = [], 0, []
    for piece in words(text):
        n_words += len(piece)
        found.extend(map(look.__getitem__, piece))
        if longest > 1:
            # Runs that end in this piece; words carried over are the last ones of the piece before.
            listed, own = carried + piece, len(carried)
            for size in range(2, longest + 1):
                found.extend(look[b" ".join(listed[i : i + size])] for i in range(max(0, own - size + 1), len(listed) - size + 1))
            carried = listed[len(listed) - longest + 1 :] if len(listed) >= longest else listed
    return n_words, np.array(found, _width(look.number))


def _featured(buckets: int, longest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = Buckets(buckets)
        for batch in batches:
            if len(look) >= MEMO:
                look.clear()
            made = [text_buckets(text, look, longest) for text in batch.column(2).to_pylist()]
            sizes = pa.array([len(x) for _, x in made], pa.int64())
            arrays = pa.array([x.tobytes() for _, x in made], pa.binary())
            yield pa.record_batch(
                [*batch.columns[:2], pa.array([n for n, _ in made], pa.int64()), sizes, arrays],
                names=["row", "doc_id", "n_words", "n_features", "buckets"],
            )

    return run


def features(docs: DataFrame, buckets: int = BUCKETS, longest: int = 1) -> DataFrame:
    """row, doc_id, n_words, n_features, buckets (one number a feature) of every row, in the shared folder."""
    text = F.coalesce(docs["text"].cast("string"), F.lit("")).cast("binary")
    # A row's number is fixed here, once, by the table that is written.
    rows = docs.select(F.monotonically_increasing_id().alias("row"), docs["doc_id"].cast("long").alias("doc_id"), text.alias("text"))
    found = rows.mapInArrow(_featured(buckets, longest), "row long, doc_id long, n_words long, n_features long, buckets binary")
    return written(found, "features")


def _width(buckets: int) -> str:
    return "<u2" if buckets <= 1 << 16 else "<u4"


def _joined(arrays: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The bucket numbers of a batch's rows one after the other, and where each row begins and ends there."""
    width = np.dtype(_width(buckets))
    ends = np.cumsum([0, *(len(x.as_buffer()) // width.itemsize for x in arrays)])
    return np.frombuffer(b"".join(x.as_buffer() for x in arrays), width), ends


def bucket_counts(listed: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Occurrences in each bucket over all rows: ``buckets`` numbers, however many documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(buckets, np.int64)
        for batch in batches:
            sums += np.bincount(_joined(batch.column(0), buckets)[0], minlength=buckets)
        at = np.flatnonzero(sums)
        yield pa.record_batch([pa.array(at, pa.int32()), pa.array(sums[at], pa.int64())], names=["bucket", "n"])

    found = listed.select("buckets").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, np.int64)
    for bucket, n in found:
        out[bucket] = n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln(target's share / corpus's share)) of each bucket, one added to each count."""
    n = len(corpus)
    total, wanted = float(corpus.sum() + n), float(target.sum() + n)
    ratios = ((float(t) + 1) * total / ((float(s) + 1) * wanted) for s, t in zip(corpus, target, strict=True))
    return np.array([math.floor(1000 * math.log(x)) for x in ratios], np.int64)


def weighed(listed: DataFrame, gain: np.ndarray) -> DataFrame:
    """row, doc_id, n_words, n_features, weight."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, ends = _joined(batch.column(4), len(gain))
            sums = np.concatenate([[0], np.cumsum(gain[found])])
            yield pa.record_batch([*batch.columns[:4], pa.array(sums[ends[1:]] - sums[ends[:-1]], pa.int64())], names=["row", "doc_id", "n_words", "n_features", "weight"])

    return listed.mapInArrow(run, "row long, doc_id long, n_words long, n_features long, weight long")


def noise(seed: int = SEED) -> Column:
    """Thousandths of Gumbel noise, fixed by seed and doc_id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long").cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def score(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, longest: int = 1, seed: int = SEED) -> DataFrame:
    """row, doc_id, n_words, n_features, weight, score of every row, in the shared folder."""
    listed = features(docs, buckets, longest)
    wanted = features(target.select(F.lit(None).cast("long").alias("doc_id"), target["text"]), buckets, longest)
    rows = weighed(listed, gains(bucket_counts(listed, buckets), bucket_counts(wanted, buckets)))
    return written(rows.withColumn("score", F.col("weight") + noise(seed)), "scores")


#: Best first: -score, whether doc_id is null, doc_id, row.
KEY = ["minus", "unknown", "id", "row"]


def keyed(scored: DataFrame) -> DataFrame:
    unknown = F.col("doc_id").isNull().cast("long")
    return scored.withColumns({"minus": -F.col("score"), "unknown": unknown, "id": F.coalesce("doc_id", F.lit(0))})


def before(key: tuple[int, ...], or_at: bool = False) -> Column:
    """Whether a row's key is smaller than ``key`` (or equal to it)."""
    out = F.lit(or_at)
    for name, value in reversed(list(zip(KEY, key, strict=True))):
        out = (F.col(name) < value) | ((F.col(name) == value) & out)
    return out


def _ahead(columns: list[np.ndarray], key: tuple[int, ...]) -> np.ndarray:
    out = np.zeros(len(columns[0]), bool)
    for column, value in reversed(list(zip(columns, key, strict=True))):
        out = (column < value) | ((column == value) & out)
    return out


def _medians(pivot: tuple[int, ...] | None):
    """For each side of the pivot, the median key of a task's rows there and their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [[c.to_numpy() for c in batch.columns] for batch in batches if batch.num_rows]
        if not parts:
            return
        rows = [np.concatenate(c) for c in zip(*parts, strict=True)]
        ahead = _ahead(rows, pivot) if pivot else np.zeros(len(rows[0]), bool)
        made = []
        for side, held in ((0, ahead), (1, ~ahead)):
            own = [c[held] for c in rows]
            if n := len(own[0]):
                middle = np.lexsort(own[::-1])[(n - 1) // 2]
                made.append((side, n, *(int(c[middle]) for c in own)))
        yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*made, strict=True)], names=["side", "n", *KEY])

    return run


def _weighted_median(found: list[tuple]) -> tuple[int, ...]:
    """The median of the tasks' medians, each with the weight of its rows."""
    half, seen = sum(n for n, *_ in found) / 2, 0
    for n, *key in sorted(found, key=lambda x: x[1:]):
        seen += n
        if seen >= half:
            return tuple(key)
    raise ValueError("no rows")


def cut(rows: DataFrame, wanted: int, last: int = LAST) -> tuple[int, ...] | None:
    """The key of the row at place ``wanted`` (from 1) in order of keys; None if there is none."""
    if wanted < 1:
        return None
    schema = "side long, n long, " + ", ".join(f"{name} long" for name in KEY)
    found = [tuple(r)[1:] for r in rows.mapInArrow(_medians(None), schema).collect()]
    left = stored = sum(n for n, *_ in found)
    if wanted > left:
        wanted = left
    while left > last:
        pivot = _weighted_median(found)
        sides: tuple[list, list] = ([], [])
        for side, *rest in rows.mapInArrow(_medians(pivot), schema).collect():
            sides[side].append(tuple(rest))
        ahead = sum(n for n, *_ in sides[0])
        # The pivot itself is the first of those not ahead of it.
        if wanted == ahead + 1:
            return pivot
        if wanted <= ahead:
            rows, left, found = rows.filter(before(pivot)), ahead, sides[0]
        else:
            rows, left, found, wanted = rows.filter(~before(pivot)), left - ahead, sides[1], wanted - ahead
        if 4 * left <= stored:
            rows, stored = written(rows, "in-question"), left
    listed = sorted(tuple(r) for r in rows.collect())
    return listed[wanted - 1] if listed else None


def ranked(winners: DataFrame) -> DataFrame:
    """``winners`` with ``rank`` from 1 in order of keys: sorted by range, then numbered from the parts' sizes."""
    ordered = winners.orderBy(*KEY).withColumn("place", F.monotonically_increasing_id())
    stored = written(ordered, "winners").withColumn("part", F.shiftright("place", 33))
    sizes = sorted(tuple(r) for r in stored.groupBy("part").count().collect())  # a number for each part
    starts, at = [], 0
    for part, n in sizes:
        starts.append((part, at))
        at += n
    known = winners.sparkSession.createDataFrame(starts, "part long, start long")
    within = F.col("place").bitwiseAND((1 << 33) - 1)
    return stored.join(F.broadcast(known), "part").withColumn("rank", F.col("start") + within + 1).drop("part", "start", "place")


def resample(
    docs: DataFrame, target: DataFrame, percent: int = 10, buckets: int = BUCKETS, longest: int = 1, seed: int = SEED,
    min_words: int = MIN_WORDS, last: int = LAST,
) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every row; rank is null where the row is not drawn."""
    scored = keyed(score(docs, target, buckets, longest, seed))
    fit = F.col("n_words") >= min_words
    n = scored.filter(fit).count()
    edge = cut(scored.filter(fit).select(KEY), percent * n // 100, last)
    columns = ["doc_id", "n_features", "weight", "score"]
    undrawn = F.lit(None).cast("long").alias("rank")
    if edge is None:
        return scored.select(*columns, undrawn)
    drawn = fit & before(edge, or_at=True)
    rest = scored.filter(~drawn).select(*columns, undrawn)
    return rest.unionByName(ranked(scored.filter(drawn)).select(*columns, "rank"))
