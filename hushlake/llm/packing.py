"""Packing: concatenate all documents' tokens and cut them into sequences of equal length.

Two passes. The first tokenizes each partition once, writes the ids with their
place in the partition's own stream, and totals each partition. A prefix sum
over those totals (one number for each partition) says where every partition
begins in the one long stream. The second pass cuts each document at the
multiples of the sequence length and gives a record for each piece. No row is
shuffled, and only the last sequence is not full.

Null or empty text gives the end mark alone. Repeated rows are packed as often
as they occur, null ids stay null, an empty table gives no row, other columns
of the input are not read. A text may have any length: it is held by one task
as ids and cut into as many pieces as it needs.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from hushlake.llm.common import tokenizer_path, written

SEQUENCE = 1024
END = 0
#: Fixed values of the public vocabulary byte_bpe_50k: how it splits a text, and its only special token.
PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
)
SPECIAL = {"<|endoftext|>": 50256}
_WORKER: dict[str, object] = {}


def text_encoder(path: str):
    """Text to its ids, 32 bits each; the vocabulary is read once in each Python worker."""
    if path not in _WORKER:
        import regex
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        encoding = tiktoken.Encoding("texts", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        _WORKER[path] = encoding.encode_ordinary, regex.compile("|".join(map(regex.escape, SPECIAL)))
    ordinary, special = _WORKER[path]

    def encode(text: str) -> bytes:
        if "<|" not in text or not special.search(text):
            return np.array(ordinary(text), "<u4").tobytes()
        out, at = [], 0
        for found in special.finditer(text):
            out += [*ordinary(text[at : found.start()]), SPECIAL[found[0]]]
            at = found.end()
        return np.array([*out, *ordinary(text[at:])], "<u4").tobytes()

    return encode


ENCODED = pa.schema(
    [("part", pa.int64()), ("base", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("ids", pa.binary())]
)


def encoded(docs: DataFrame, vocabulary: str | None = None, end: int = END) -> DataFrame:
    """One row for each document: partition, tokens before it there, doc_id, tokens with the end mark, ids.

    Ids have 16 bits each, or 32 in a document with one that is larger.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = text_encoder(vocabulary or tokenizer_path("byte_bpe_50k.tiktoken"))
        part, base = TaskContext.get().partitionId(), 0
        mark = np.array([end], "<u4").tobytes()
        for batch in batches:
            found = [np.frombuffer(encode(text or "") + mark, "<u4") for text in batch.column(1).to_pylist()]
            sizes = [len(x) for x in found]
            ids = [x.astype("<u2" if x.max() < 1 << 16 else "<u4").tobytes() for x in found]
            *starts, base = accumulate(sizes, initial=base)
            yield pa.record_batch(
                [pa.array([part] * len(ids), pa.int64()), pa.array(starts, pa.int64()), batch.column(0).cast(pa.int64()),
                 pa.array(sizes, pa.int64()), pa.array(ids, pa.binary())],
                schema=ENCODED,
            )

    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return texts.mapInArrow(run, "part long, base long, doc_id long, n long, ids binary")


PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
DIGEST = PIECES.replace("ids binary", "ids_crc32 long")
BOTH = PIECES.replace("ids binary", "ids binary, ids_crc32 long")


def _cut(starts: dict[int, int], size: int, columns: str):
    names = [x.split()[0] for x in columns.split(", ")]
    schema = pa.schema([(name, pa.binary() if name == "ids" else pa.int64()) for name in names])
    own = [name for name in names if name.startswith("ids")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made: list[list] = [[] for _ in schema]
            for part, base, doc, n, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                first = starts[part] + base
                wide = np.frombuffer(ids, "<u2" if len(ids) == 2 * n else "<u4").astype("<u4")
                at = 0
                while at < n:
                    sequence, offset = divmod(first + at, size)
                    length = min(size - offset, n - at)
                    piece = wide[at : at + length].tobytes()
                    shown = (piece if name == "ids" else zlib.crc32(piece) for name in own)
                    row = (doc, at, length, *shown, n, sequence, offset)
                    for column, value in zip(made, row, strict=True):
                        column.append(value)
                    at += length
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(made, schema, strict=True)], schema=schema)

    return run


def pack(
    docs: DataFrame, size: int = SEQUENCE, vocabulary: str | None = None, end: int = END, digest: bool = False, both: bool = False
) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids (32 bits each), doc_tokens, sequence_id, offset.

    With ``digest``, the column ids_crc32 stands in place of the ids; with ``both``, it stands behind them.
    """
    columns = BOTH if both else DIGEST if digest else PIECES
    stored = written(encoded(docs, vocabulary, end), "tokens")
    totals = sorted(stored.groupBy("part").sum("n").collect())  # a number for each partition
    before = accumulate((n for _, n in totals), initial=0)
    starts = {part: at for (part, _), at in zip(totals, before, strict=False)}
    return stored.mapInArrow(_cut(starts, size, columns), columns)
