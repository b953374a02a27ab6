"""Quality by compression: which of two dictionaries makes a text smaller.

A zstandard dictionary is built from blocks of good texts, another from blocks
of bad ones. Every block of a text is compressed with either; the difference of
the sizes over the text's length is the one feature, and a logistic curve
turns it into the probability of label 1.

The documents that may be learned from have crc32(doc_id) modulo 3 of 0 or 2:
the dictionaries come from 0, the curve from 2, so it is fitted on texts the
dictionaries have not seen. Both samples are bounded (BLOCKS, CURVE) and chosen
by hash. Null and empty texts have feature 0 and get the curve's value there; texts
of any length are compressed whole, block by block. Repeated rows get equal scores.
Labels with null quality or without document are left out; a document that has
several labels counts once for each. Without labels of both kinds every score is 0.5. Scores
read nothing but the text. An empty table gives no row; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushlake.llm.common import in_third

#: Bytes of a text that are compressed together, so that a long text does not become its own dictionary.
BLOCK = 4096
#: Blocks per label that a dictionary is built from, and documents these are taken from.
BLOCKS, DOCUMENTS = 6000, 2000
#: Documents per label that the curve is fitted on.
CURVE = 4000
DICTIONARY = 112 << 10
LEVEL = 3


def blocks(text: str | None) -> list[bytes]:
    raw = (text or "").encode()
    return [raw[i : i + BLOCK] for i in range(0, len(raw), BLOCK)]


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    at_zero: float
    slope: float

    def score(self, feature: float) -> float:
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, self.at_zero + self.slope * feature))))


class Compressor:
    """Sizes of blocks under both dictionaries."""

    def __init__(self, model: Model) -> None:
        import zstandard

        def sizes(raw: bytes):
            kept = zstandard.ZstdCompressionDict(raw)
            kept.precompute_compress(level=LEVEL)
            return zstandard.ZstdCompressor(
                dict_data=kept, write_content_size=False, write_checksum=False, write_dict_id=False
            ).compress

        self.good, self.bad = (sizes(raw) if raw else None for raw in (model.good, model.bad))

    def feature(self, text: str | None) -> float:
        """How much smaller the good dictionary makes the text, as a share of its length."""
        cut = blocks(text)
        if not cut or not self.good or not self.bad:
            return 0.0
        return sum(len(self.bad(b)) - len(self.good(b)) for b in cut) / sum(map(len, cut))


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))


def labelled(docs: DataFrame, labels: DataFrame, third: int, size: int) -> DataFrame:
    """(quality, text) of up to ``size`` documents of each label in this third, chosen by hash."""
    marks = labels.filter("doc_id IS NOT NULL AND quality IN (0, 1)").filter(in_third(third)).select("doc_id", "quality")
    some = [marks.filter(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(size) for q in (0, 1)]
    # At most twice ``size`` ids, so they may be broadcast.
    return _texts(docs).join(F.broadcast(some[0].union(some[1])), "doc_id").select("quality", "text")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(q, b) for q, t in zip(*(c.to_pylist() for c in batch.columns), strict=True) for b in blocks(t)]
        yield pa.record_batch(
            [pa.array([q for q, _ in rows], pa.int32()), pa.array([b for _, b in rows], pa.binary())], names=["quality", "block"]
        )


def dictionaries(docs: DataFrame, labels: DataFrame, size: int = DICTIONARY, documents: int = DOCUMENTS, most: int = BLOCKS) -> Model:
    """Both dictionaries. At most twice ``most`` blocks of BLOCK bytes come to the driver."""
    import zstandard

    cut = labelled(docs, labels, 0, documents).mapInArrow(_cut, "quality int, block binary")
    made = []
    for quality in (1, 0):
        some = cut.filter(F.col("quality") == quality).orderBy(F.xxhash64("block"), "block").limit(most).toArrow()
        samples = [bytes(b) for b in some.column(1).to_pylist()]
        try:
            made.append(zstandard.train_dictionary(size, samples, level=LEVEL).as_bytes() if samples else b"")
        except zstandard.ZstdError:  # too few samples to train on: they are the dictionary themselves
            made.append(b"".join(samples)[-size:])
    return Model(made[0], made[1], 0.0, 0.0)


def _features(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressor = Compressor(model)
        for batch in batches:
            found = [compressor.feature(t) for t in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(found, pa.float64())], names=[batch.schema.names[0], "feature"])

    return run


def logistic(feature: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Value at zero and slope by Newton's method, with a weak pull towards 0."""
    x = np.stack([np.ones_like(feature), feature], 1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        slope = x.T @ (weight * (label - p)) - np.array([1e-6, 1e-6]) * w
        bend = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag([1e-6, 1e-6])
        step = np.linalg.solve(bend, slope)
        w += np.clip(step, -50, 50)
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Dictionaries and curve. The labels' true shares weigh the curve's sample, which takes as many of either."""
    model = dictionaries(docs, labels)
    marks = labels.filter("doc_id IS NOT NULL AND quality IN (0, 1)").filter(in_third(2))
    shares = {r[0]: r[1] for r in marks.groupBy("quality").count().collect()}
    rows = labelled(docs, labels, 2, CURVE).mapInArrow(_features(model), "quality int, feature double").toArrow()
    label, feature = rows.column(0).to_numpy(), rows.column(1).to_numpy()
    if not model.good or not model.bad or len(set(label.tolist())) < 2:
        return model
    order = np.lexsort((feature, label))
    label, feature = label[order].astype(float), feature[order]
    weight = np.where(label == 1, shares[1] / label.sum(), shares[0] / (1 - label).sum())
    return Model(model.good, model.bad, *logistic(feature, label, weight / weight.mean()))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, predicted for every row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressor = Compressor(model)
        for batch in batches:
            found = [model.score(compressor.feature(t)) for t in batch.column(1).to_pylist()]
            yield pa.record_batch(
                [batch.column(0), pa.array(found, pa.float64()), pa.array([int(s >= 0.5) for s in found], pa.int32())],
                names=["doc_id", "score", "predicted"],
            )

    return _texts(docs).mapInArrow(run, "doc_id long, score double, predicted int")


def keep_good(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` with a score of 0.5 or more, with all columns."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressor = Compressor(model)
        for batch in batches:
            yield batch.filter(pa.array([model.score(compressor.feature(t)) >= 0.5 for t in batch.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
