"""Exact duplicates through an extendible-hash index on shared files.

Only DataFrame expressions run here. Texts are equal when they are identical
after white space is deleted; the key of a text is the 64-bit hash of what is
left.

1. ``postings`` writes a small row for each document (key, digest, sizes).
2. ``directory`` begins with one slot, and doubles while a bucket holds more
   than CAPACITY bytes: a bucket that overflows splits by its key's next bit.
   The splitting runs over a histogram of the keys' first MAX_DEPTH bits. A
   bucket that cannot split (one key, or no bits left) gets overflow pages.
3. Buckets are laid out by key range over owners of CAPACITY bytes each. Every
   owner is one task: it takes its buckets' texts, chains those with equal keys,
   and compares their bytes. It writes one entry for each different text.
   Pages of one bucket have different owners, so a text that a third of all
   rows hold is spread over many tasks; the entries of its pages then merge.
4. Every posting looks up its entry.

Which row stays: most code points in the original text, then smallest doc_id
(null last); among repeated rows with equal doc_id, one. Null counts as empty,
and all blank texts are one group. Texts of any length are compared whole; one
longer than an owner's bytes has an owner of its own. An empty table gives no row.
Other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hushlake.llm.common import BLANKS, written

CAPACITY = 64 << 20
MAX_DEPTH = 20


def normalized(text: str | Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), BLANKS, "")


def slot_of(key: Column, depth: int = MAX_DEPTH) -> Column:
    """The key's first bits as a number from 0."""
    return F.lit(0).cast("long") if depth == 0 else F.shiftrightunsigned(key, 64 - depth)


def rank() -> Column:
    """Greatest for the row that stays."""
    known = F.col("doc_id").isNotNull()
    return F.struct("n_chars", known.alias("known"), F.bitwise_not(F.coalesce("doc_id", F.lit(0))).alias("order"))


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, norm, key, page hash of every row."""
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text.alias("text"))
    return rows.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), normalized("text").alias("norm")
    ).withColumn("key", F.xxhash64("norm"))


def postings(docs: DataFrame) -> DataFrame:
    """One small row for each row of ``docs``, in the shared folder."""
    rows = keyed(docs).select(
        F.monotonically_increasing_id().alias("row"), "doc_id", "n_chars", "key",
        F.octet_length("norm").cast("long").alias("n_bytes"), F.sha2(F.col("norm").cast("binary"), 256).alias("sha"),
    )
    return written(rows, "postings")


def directory(listed: DataFrame, capacity: int = CAPACITY, max_depth: int = MAX_DEPTH) -> list[tuple[int, int, int]]:
    """Buckets in key order: (first slot at max_depth, local depth, bytes), as found by doubling.

    At most 2^max_depth of them, however many documents there are. Each
    doubling is a grouped sum over the histogram, for overfull buckets alone.
    A bucket is overfull if it would be so without its heaviest slot; if only
    that slot is too heavy, splitting cannot help and it gets overflow pages.
    """
    histogram = listed.groupBy(slot_of(F.col("key"), max_depth).alias("slot")).agg(F.sum(F.col("n_bytes") + 32).alias("bytes"))
    histogram = written(histogram, "histogram")
    settled, parents, depth = [], None, 0
    while True:
        buckets = histogram.groupBy(F.shiftright("slot", max_depth - depth).alias("bucket")).agg(
            F.sum("bytes").alias("bytes"), F.max("bytes").alias("heaviest")
        )
        if parents is not None:
            buckets = buckets.join(parents, F.shiftright("bucket", 1) == parents["parent"], "left_semi")
        full = (F.col("bytes") - F.col("heaviest") > capacity) & F.lit(depth < max_depth)
        buckets = written(buckets.select("bucket", "bytes", full.alias("full")), "buckets")
        found = buckets.collect()
        settled += [(r.bucket << (max_depth - depth), depth, r.bytes) for r in found if not r.full]
        if not any(r.full for r in found):
            return sorted(settled)
        parents, depth = buckets.filter("full").select(F.col("bucket").alias("parent")), depth + 1


def owners(buckets: list[tuple[int, int, int]], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int]], int]:
    """(first slot, local depth, first owner, pages) of each bucket, and how many owners there are.

    Neighbouring buckets share an owner until it has its bytes; a bucket with
    overflow pages has an owner for each page.
    """
    laid, owner, held = [], 0, 0
    for slot, depth, size in buckets:
        pages = max(1, math.ceil(size / capacity))
        if held and held + size > capacity:
            owner, held = owner + 1, 0
        laid.append((slot, depth, owner, pages))
        held += size
        if pages > 1:
            owner, held = owner + pages, 0
    return laid, owner + (1 if held else 0)


def slots_table(spark: SparkSession, laid: list[tuple[int, int, int, int]], max_depth: int) -> tuple[DataFrame, int]:
    """The directory as a table: a row (slot, owner, pages) for each slot at the global depth, and that depth."""
    depth = max((d for _, d, _, _ in laid), default=0)
    heads = [(first >> (max_depth - depth), 1 << (depth - d), owner, pages) for first, d, owner, pages in laid]
    buckets = spark.createDataFrame(heads, "head long, span long, owner int, pages int")
    slot = F.explode(F.sequence("head", F.col("head") + F.col("span") - 1))
    return buckets.select(slot.alias("slot"), "owner", "pages"), depth


def build_index(docs: DataFrame, listed: DataFrame, capacity: int = CAPACITY, max_depth: int = MAX_DEPTH) -> DataFrame:
    """The index: one entry (key, chain, sha, best, group_size) for each different text.

    ``chain`` numbers the entries of a key, so it is over 1 only where keys collide.
    """
    laid, number = owners(directory(listed, capacity, max_depth), capacity)
    slots, depth = slots_table(docs.sparkSession, laid, max_depth)
    # The directory has 2^max_depth rows of 16 bytes at most, so it may be broadcast.
    owned = keyed(docs).withColumn("slot", slot_of(F.col("key"), depth)).join(F.broadcast(slots), "slot")
    page = F.pmod(F.xxhash64("doc_id", "n_chars"), F.col("pages"))
    owned = owned.select((F.col("owner") + page).cast("int").alias("owner"), "key", "norm", "n_chars", "doc_id")
    dealt = owned.repartitionById(max(1, number), "owner")
    compared = dealt.groupBy("owner", "key", "norm").agg(F.max(rank()).alias("best"), F.count("*").alias("copies"))
    pages = compared.select("key", F.sha2(F.col("norm").cast("binary"), 256).alias("sha"), "best", "copies")
    merged = written(pages, "index-pages").groupBy("key", "sha").agg(F.max("best").alias("best"), F.sum("copies").alias("group_size"))
    chain = F.row_number().over(Window.partitionBy("key").orderBy("sha"))
    return written(merged.withColumn("chain", chain), "index")


def exact_duplicates(docs: DataFrame, capacity: int = CAPACITY, max_depth: int = MAX_DEPTH) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, key, chain for every row of ``docs``."""
    listed = postings(docs)
    index = build_index(docs, listed, capacity, max_depth)
    entries = index.select(
        "key", "sha", "chain", "group_size", F.col("best.n_chars").alias("most"),
        F.when(F.col("best.known"), F.bitwise_not("best.order")).alias("keep_id"),
    )
    best = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n_chars") == F.col("most"))
    found = listed.join(entries, ["key", "sha"]).select(
        "doc_id", "keep_id", "group_size", best.alias("best"), F.col("sha").alias("text_sha256"), "key", "chain"
    )
    found = written(found, "lookups")
    columns = ["doc_id", "keep_id", "group_size", "kept", "text_sha256", "key", "chain"]
    dropped = found.filter("NOT best").withColumn("kept", F.lit(False)).select(columns)
    # Rows that repeat the winner's doc_id and text: the first stays, and the others are given back as dropped.
    same = found.filter("best").groupBy("doc_id", "keep_id", "group_size", "text_sha256", "key", "chain").count()
    winners = same.withColumn("time", F.explode(F.sequence(F.lit(1).cast("long"), "count"))).withColumn("kept", F.col("time") == 1)
    return dropped.unionByName(winners.select(columns))


def keep_one(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    columns, free = docs.columns, []
    for name in ("_known", "_id", "_key"):
        while name in columns:
            name += "_"
        free.append(name)
    known, number, key = free
    kept = exact_duplicates(docs, capacity).filter("kept")
    kept = kept.select(
        F.col("doc_id").isNotNull().alias(known), F.coalesce("doc_id", F.lit(0)).alias(number), F.col("key").alias(key)
    )
    doc_id = docs["doc_id"].cast("long")
    marked = docs.withColumns(
        {known: doc_id.isNotNull(), number: F.coalesce(doc_id, F.lit(0)), key: F.xxhash64(normalized(docs["text"].cast("string")))}
    )
    return marked.join(kept, free, "left_semi").dropDuplicates(free).select(columns)
