"""Shards of near equal bytes by way of a fixed number of virtual slots.

Only DataFrame expressions run on the records. A record's hash says which of
SLOTS virtual slots it lies in; that never changes. A small map says which
shard holds each slot. The map begins with equal runs of slots; rebalancing
adds up the bytes of each slot and edits the map: slots move from the fullest
shards to the emptiest, or change places with smaller ones, until neither helps.
Each edit is stored as a new version, so earlier layouts stay readable, and
records of slots that did not move stay where they are. ``grow`` adds shards by
moving slots to the new ones alone.

The map has SLOTS rows whatever the table's size, so it may lie in the driver
and be broadcast. Records are read once, as small rows without their texts.

Places within a shard come from two passes: counts of each (scan task, shard)
give where a task's records of that shard begin, and the rank among those
records is added. So no task sorts a shard, and a shard that holds a third of
all rows is no hot key.

The law is ``bytes``: as near equal as whole slots allow. A slot over a shard's
mean (a record longer than that, or rows repeated with the same doc_id and text,
which share a slot) leaves its shard larger. Null text has size 16 and the
checksum 0 of empty text; null doc_id is an id like any other. Empty and very
long texts are records like any other. Repeated rows each get a place of their
own. An empty table gives no row. Other columns are not read by ``assign``;
``write_shards`` keeps them all.
"""

from __future__ import annotations

from bisect import bisect_left, insort

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hushlake.llm.common import written
from hushlake.session import work_dir

SHARDS = 40
SLOTS = 8192
#: Bytes that a record takes besides its text.
OVERHEAD = 16


def slot_of(doc_id: Column, text: Column, slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(doc_id, text), F.lit(slots)).cast("int")


def records(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """task, row, doc_id, size, text_crc32, virtual_slot of every row, in the shared folder."""
    doc_id, text = docs["doc_id"].cast("long"), F.coalesce(docs["text"].cast("string"), F.lit(""))
    rows = docs.select(
        F.spark_partition_id().alias("task"), F.monotonically_increasing_id().alias("row"), doc_id.alias("doc_id"),
        (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        slot_of(doc_id, text, slots).alias("virtual_slot"),
    )
    return written(rows, "shard-records")


def slot_bytes(listed: DataFrame, slots: int = SLOTS) -> list[int]:
    """Bytes of each slot; one number for each, however many records there are."""
    sums = listed.groupBy("virtual_slot").agg(F.sum("size").alias("bytes")).collect()
    sizes = [0] * slots
    for slot, total in sums:
        sizes[slot] = total
    return sizes


def first_map(shards: int = SHARDS, slots: int = SLOTS) -> list[int]:
    """The shard of each slot before anything is known of sizes: equal runs."""
    return [slot * shards // slots for slot in range(slots)]


class _Shard(list):
    """(bytes, slot) of a shard's slots in order, and their sum."""

    def __init__(self, held: list[tuple[int, int]]) -> None:
        super().__init__(sorted(held))
        self.bytes = sum(n for n, _ in held)

    def take(self, item: tuple[int, int]) -> None:
        insort(self, item)
        self.bytes += item[0]

    def give(self, item: tuple[int, int]) -> None:
        del self[bisect_left(self, item)]
        self.bytes -= item[0]


def _nearest(held: list[tuple[int, int]], wanted: int, below: int, above: int = 0) -> tuple[int, int] | None:
    """The entry with bytes nearest to ``wanted`` among those with above < bytes < below."""
    at = bisect_left(held, (wanted, -1))
    fit = [x for x in held[max(0, at - 1) : at + 1] if above < x[0] < below]
    return min(fit, key=lambda x: (abs(x[0] - wanted), x), default=None)


def _step(full: _Shard, empty: _Shard) -> tuple[tuple[int, int], tuple[int, int] | None] | None:
    """What to move from ``full`` to ``empty``, and what to take back for it, so that they differ less."""
    gap = full.bytes - empty.bytes
    best = None
    for back in [None, *empty]:
        base = back[0] if back else 0
        item = _nearest(full, base + gap // 2, base + gap, base)
        if item and (best is None or abs(2 * (item[0] - base) - gap) < best[0]):
            best = abs(2 * (item[0] - base) - gap), item, back
            if 100 * best[0] <= gap:
                break
    return best[1:] if best else None


def rebalanced(placed: list[int], sizes: list[int], shards: int = SHARDS, tolerance: float = 1e-4) -> list[int]:
    """The map after edits: fullest against emptiest, until they differ by ``tolerance`` of the mean or no edit helps.

    A shard that no edit with the emptiest can lessen (one large slot) is left
    as it is, and the others go on.
    """
    held = [_Shard([(n, s) for s, n in enumerate(sizes) if placed[s] == shard]) for shard in range(shards)]
    placed, allowed, stuck = list(placed), tolerance * sum(sizes) / shards, set()
    while len(stuck) < shards - 1:
        full = max((x for x in range(shards) if x not in stuck), key=lambda x: (held[x].bytes, x))
        empty = min(range(shards), key=lambda x: (held[x].bytes, x))
        if held[full].bytes - held[empty].bytes <= allowed:
            break
        step = _step(held[full], held[empty])
        if step is None:
            stuck.add(full)
            continue
        for item, source, target in ((step[0], full, empty), (step[1], empty, full)):
            if item:
                held[source].give(item)
                held[target].take(item)
                placed[item[1]] = target
    return placed


def grow(placed: list[int], sizes: list[int], shards: int, added: int = 1) -> list[int]:
    """The map for ``added`` shards more: each takes slots from whichever shard is fullest; no other slot moves."""
    held = [_Shard([(n, s) for s, n in enumerate(sizes) if placed[s] == shard]) for shard in range(shards)]
    placed, wanted = list(placed), sum(sizes) // (shards + added)
    for new in range(shards, shards + added):
        room = wanted
        while True:
            offers = (_nearest(x, room // 2, room + 1) for x in sorted(held, key=lambda x: -x.bytes) if x.bytes > wanted)
            item = next(filter(None, offers), None)
            if item is None:
                break
            held[placed[item[1]]].give(item)
            placed[item[1]] = new
            room -= item[0]
    return placed


class SlotMap:
    """The versions of a slot-to-shard map, one folder each: virtual_slot, shard, bytes (of the slot, when it was stored)."""

    def __init__(self, spark: SparkSession, path: str | None = None) -> None:
        self.spark, self.path = spark, path or work_dir(spark, "slot-map")

    def store(self, version: int, placed: list[int], sizes: list[int]) -> DataFrame:
        shards, held = (F.split(F.lit(",".join(map(str, x))), ",") for x in (placed, sizes))
        rows = self.spark.range(1).select(F.posexplode(F.arrays_zip(shards.alias("shard"), held.alias("bytes"))).alias("virtual_slot", "at"))
        made = rows.select("virtual_slot", F.col("at.shard").cast("int").alias("shard"), F.col("at.bytes").cast("long").alias("bytes"))
        made.write.mode("overwrite").parquet(f"{self.path}/version={version}")
        return self.load(version)

    def load(self, version: int) -> DataFrame:
        return self.spark.read.schema("virtual_slot int, shard int, bytes long").parquet(f"{self.path}/version={version}")

    def placed(self, version: int) -> list[int]:
        return [r.shard for r in self.load(version).orderBy("virtual_slot").collect()]

    def edit(self, version: int, sizes: list[int], shards: int) -> DataFrame:
        """Stores the version after ``version``: with new shards if there are more, else rebalanced."""
        placed = self.placed(version)
        before = max(placed) + 1
        edited = grow(placed, sizes, before, shards - before) if shards > before else rebalanced(placed, sizes, shards)
        return self.store(version + 1, edited, sizes)


def places(listed: DataFrame) -> DataFrame:
    """``listed`` (task, row, shard and more) with ``slot``: the record's place in its shard, from 0 without gaps."""
    counts = listed.groupBy("shard", "task").agg(F.count("*").alias("here"))
    before = F.sum("here").over(Window.partitionBy("shard").orderBy("task")) - F.col("here")
    starts = written(counts.select("shard", "task", before.alias("before")), "shard-starts")
    rank = F.row_number().over(Window.partitionBy("task", "shard").orderBy("row")) - 1
    ranked = listed.withColumn("rank", rank).join(starts, ["task", "shard"])
    return ranked.withColumn("slot", F.col("before") + F.col("rank")).drop("before", "rank", "row", "task")


def assign(docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS, store: SlotMap | None = None) -> DataFrame:
    """doc_id, size, text_crc32, virtual_slot, shard, slot of every row, by the map's second version.

    Version 0 of the stored map is the even one, version 1 is rebalanced by the
    bytes at hand.
    """
    listed = records(docs, slots)
    sizes = slot_bytes(listed, slots)
    store = store or SlotMap(docs.sparkSession)
    store.store(0, first_map(shards, slots), sizes)
    chosen = store.edit(0, sizes, shards)
    # SLOTS rows of 8 bytes, so the map may be broadcast.
    placed = listed.join(F.broadcast(chosen.select("virtual_slot", "shard")), "virtual_slot")
    return places(placed)


def write_shards(docs: DataFrame, chosen: DataFrame, path: str, slots: int = SLOTS) -> None:
    """All columns of ``docs`` in folders ``path/shard=N``, by a version of the map.

    Records stay in the task that reads them, which writes a file for each
    shard it meets; nothing is shuffled.
    """
    name, shard = "virtual_slot", "shard"
    while name in docs.columns:
        name += "_"
    while shard in docs.columns:
        shard += "_"
    known = F.broadcast(chosen.select(F.col("virtual_slot").alias(name), F.col("shard").alias(shard)))
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    marked = docs.withColumn(name, slot_of(docs["doc_id"].cast("long"), text, slots))
    marked.join(known, name).drop(name).write.partitionBy(shard).parquet(path)
