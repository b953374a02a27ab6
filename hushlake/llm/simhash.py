"""SimHash near-duplicates by covering locality-sensitive hashing.

Every bit of the fingerprint gets a non-zero vector of RADIUS + 1 bits; for each
non-zero vector v there is a table whose mask keeps the bits whose vector has
odd inner product with v. Two fingerprints that differ in RADIUS bits at most
span less than the whole space, so some v is orthogonal to all of them: that
table's mask hides every difference, and the pair collides there for certain.

Steps: one fingerprint for each text (an Arrow function: words, hashes and
counts of whole texts), then one row for each *distinct* fingerprint, which
takes up exact copies. These go into 15 tables. A bucket is compared in one
task by exact distance and gives a tree over what is linked, never all pairs.
A bucket over BLOCK members is dealt into blocks by hash, and pairs of blocks go
to tasks: every pair still meets. Components then join the trees.

Null, empty and blank texts have fingerprint zero and link like any other. Rows
with equal doc_id keep their own fingerprints; a null doc_id stays null and is
no component's smallest unless it has no other. Texts of any length are hashed as a
whole, and repeated rows are one fingerprint. An empty table gives no row. Other
columns are not read, and kept by ``keep_one``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushlake.llm.common import written
from hushlake.llm.components import components

BITS, RADIUS, SHINGLE, SEED = 64, 3, 3, 42
#: Fingerprints of a bucket compared at once in one task.
BLOCK = 2048
ONES = np.uint64(0x0101010101010101)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def masks(radius: int = RADIUS) -> list[int]:
    """The covering masks, one for each table: 2^(radius + 1) - 1 of them."""
    vectors = (1 << (radius + 1)) - 1
    of_bit = [i % vectors + 1 for i in range(BITS)]
    return [sum(1 << i for i, m in enumerate(of_bit) if (m & v).bit_count() % 2) for v in range(1, vectors + 1)]


def fingerprint(text: bytes) -> int:
    """64 bits; a bit is set where over half of the shingles' hashes have it."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    if not words:
        return 0
    if len(words) < SHINGLE:
        return xxh64_intdigest(b" ".join(words), SEED)
    hashes = [xxh64_intdigest(b" ".join(t), SEED) for t in zip(*(words[i:] for i in range(SHINGLE)), strict=False)]
    return majority(np.array(hashes, np.uint64))


def majority(hashes: np.ndarray) -> int:
    counts = np.zeros((8, 8), np.int64)  # [shift, byte]: eight counters ride in one word, 255 hashes at a time
    for at in range(0, len(hashes), 255 * 64):
        part = hashes[at : at + 255 * 64]
        edges = np.arange(0, len(part), 255)
        for shift in range(8):
            packed = np.add.reduceat((part >> np.uint64(shift)) & ONES, edges)
            counts[shift] += packed.astype("<u8").view(np.uint8).reshape(-1, 8).sum(0, dtype=np.int64)
    set_bits = counts * 2 > len(hashes)
    return sum(1 << (8 * byte + shift) for shift in range(8) for byte in range(8) if set_bits[shift, byte])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) for every row; fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            found = pa.array([_signed(fingerprint(t or b"")) for t in texts], pa.int64())
            yield pa.record_batch([batch.column(0), found], names=["doc_id", "fp"])

    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return texts.mapInArrow(run, "doc_id long, fp long")


def tree(members: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Edges that connect what is linked within ``members``, one less than members for each connected part.

    Breadth first: each member is compared once with those not yet reached. The
    edges form a heap, so that no member has more than three.
    """
    left, edges = members, []
    while len(left):
        part, left, at = [left[0]], left[1:], 0
        while at < len(part) and len(left):
            near = np.bitwise_count(left ^ part[at]) <= radius
            if near.any():
                part.extend(left[near])
                left = left[~near]
            at += 1
        edges += [(part[i], part[(i - 1) // 2]) for i in range(1, len(part))]
    return edges


def _trees(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried: tuple | None = None
        held: list[np.ndarray] = []

        def made(edges: list) -> pa.RecordBatch:
            a, b = (np.array([e[i] for e in edges], np.uint64).view(np.int64) for i in (0, 1))
            return pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        edges: list = []
        for batch in batches:
            keys = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)])
            fps = batch.column(4).to_numpy(zero_copy_only=False).view(np.uint64)
            cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1).tolist(), len(fps)]
            for i, j in zip(cuts, cuts[1:], strict=False):
                if i == j:
                    continue
                key = tuple(keys[:, i])
                if key != carried:
                    if held:
                        edges += tree(np.concatenate(held), radius)
                    carried, held = key, []
                held.append(fps[i:j])
            if len(edges) > 50_000:
                yield made(edges)
                edges = []
        if held:
            edges += tree(np.concatenate(held), radius)
        yield made(edges)

    return run


def links(distinct: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """Edges (a, b) between fingerprints (column fp, each once) whose components are those of all links."""
    tables = F.array(*(F.lit(_signed(m)) for m in masks(radius)))
    keyed = distinct.select("fp", F.posexplode(tables).alias("tab", "mask")).select(
        "tab", F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp"
    )
    sizes = keyed.groupBy("tab", "key").agg(F.count("*").alias("n")).filter("n > 1")
    sizes = written(sizes, "buckets")
    shared = keyed.join(sizes, ["tab", "key"]).withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = shared.withColumn("own", own).withColumn("other", other)
    dealt = dealt.select("tab", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp")
    keys = ["tab", "key", "i", "j"]
    grouped = dealt.repartition(*keys).sortWithinPartitions(*keys)
    return grouped.mapInArrow(_trees(radius), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """doc_id, fp, component_id for every row of ``docs``."""
    prints = written(fingerprints(docs), "fingerprints")
    distinct = written(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    roots = components(links(distinct.select("fp"), radius, block)).withColumnRenamed("node", "fp")
    named = written(distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "rooted")
    smallest = written(named.groupBy("root").agg(F.min("first").alias("component_id")), "smallest")
    of_print = written(named.select("fp", "root").join(smallest, "root").select("fp", "component_id"), "components")
    return prints.join(of_print, "fp").select("doc_id", "fp", "component_id")


def hexadecimal(fp: str | Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the smallest of its component.

    Rows that repeat that doc_id are the same document and stay together; rows
    without doc_id stay only if nothing in their component has one.
    """
    found = near_duplicates(docs)
    kept = found.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("kept_id")).distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["kept_id"]), "left_semi")
