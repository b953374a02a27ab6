"""Near-duplicate lines by MinHash, one line kept of each component.

A line's shingles are its runs of SHINGLE characters (a shorter line is one
shingle), after blanks at both ends are cut off and A-Z are in lower case. One
hash a shingle falls into one of BANDS * ROWS bins; a bin's smallest value is
that place of the signature, and empty bins borrow from others. Lines that
agree on all rows of a band are candidates. With independent rows, 24 bands of 4
miss three pairs in a million at a similarity of 0.8 and compare 18 % at 0.3. Of
120,000 random pairs at 0.8 (15, 50 and 100 shingles) none was missed.

1. ``occurrences``: the places of each document's lines with their 128-bit digests.
2. ``chains``: tasks send the band keys of the lines that a batch first shows, as
   arrays by range of key. Whoever gets a range ties the lines that share a key to the
   first of them, so all lines of a bucket have the same leader. Keys go as
   the 32 bits that do not name the range, lines as 40 bits of their digest: 9 bytes a key.
   What agrees by chance (512 pairs of keys in a range) makes a few more candidates.
3. ``close``: candidates that share a band by chance are more, for each line, the larger the
   corpus, and would in the end tie all families of lines to one group. So a leader's lines are first
   held against each other by sketches, four bits of PLACES places of the signature. Lines at
   a similarity of 0.8 agree on 52 of 64, give or take 3; pairs that agree on fewer than AGREE are let go.
   Distributed union-find makes groups of the others.
4. The text of each line in a group goes to its group once; other lines stay where they
   are, held back by a bitmap. In a group pairs are verified
   by exact Jaccard similarity, in large groups only pairs whose sketches agree; a
   tree over each verified part comes out. A group over BLOCK lines or BLOCK_CHARS
   characters is dealt into pairs of blocks.
5. Union-find over those trees gives the components. The line whose place
   (doc_id, row, line number) is first in a component is kept, wherever else it stands.

Lines are split at line feeds; a line of blanks only is neither counted nor dropped. Null and
empty texts have no lines; texts and lines of any length are read as a whole. Null doc_ids come after all others. Rows with equal doc_id are
documents of their own, as are repeated rows: their lines are dropped as copies. An empty table
gives no row; other columns are not read by ``judge`` and kept by ``deduplicate``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushlake.llm.common import BLANKS, written
from hushlake.llm.components import components
from hushlake.operators.sides import KEY_BITS, split_by_keys

SHINGLE, SIMILAR = 8, 0.8
BANDS, ROWS = 24, 4
#: Lines of a group, and their characters, that are held in one task for one side of a comparison.
BLOCK, BLOCK_CHARS = 4096, 1 << 22
#: Lines of a group up to which all of its pairs are compared; above, those whose sketches agree.
FEW = 64
#: Places of a sketch, and on how many of them two lines have to agree.
PLACES, AGREE = 64, 32
#: Lines of a leader up to which all pairs with agreeing sketches are named; above, a tree over them.
CLOSE = 8
#: Characters whose shingles are hashed together.
CHUNK = 1 << 16
#: Keys that a task chains, on average.
RANGE = 1 << 21
#: Bytes of a digest that name a candidate; candidates are verified.
NODE_BYTES = 5
LAST_ID = (1 << 63) - 1


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _mixed_once(h: np.ndarray) -> np.ndarray:
    return h ^ (h >> np.uint64(29))


def bands(lines: list[str]) -> np.ndarray:
    """BANDS keys for each line."""
    return _by_chunks(lines, _bands, np.zeros((0, BANDS), np.uint64))


def _by_chunks(lines: list[str], make: Callable[[list[str], np.ndarray], np.ndarray], none: np.ndarray) -> np.ndarray:
    out, first = [], 0
    sizes = np.fromiter(map(len, lines), np.int64, len(lines))
    while first < len(lines):
        last = max(first + 1, first + int(np.searchsorted(np.cumsum(sizes[first:]), CHUNK)))
        out.append(make(lines[first:last], sizes[first:last]))
        first = last
    return np.concatenate(out) if out else none


def _bands(lines: list[str], sizes: np.ndarray) -> np.ndarray:
    out = np.zeros((len(lines), BANDS), np.uint64)
    grouped = _signatures(lines, sizes).reshape(len(lines), BANDS, ROWS)
    for r in range(ROWS):
        out = _mixed(out * np.uint64(31) + grouped[:, :, r] + np.uint64(1))
    return out ^ np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def _signatures(lines: list[str], sizes: np.ndarray) -> np.ndarray:
    # Every line gets SHINGLE - 1 marks behind it; runs that reach into the marks count only for lines that are too short.
    padded = "".join(line + "\0" * (SHINGLE - 1) for line in lines)
    codes = np.frombuffer((padded + "\0" * SHINGLE).encode("utf-32-le"), "<u4").astype(np.uint64)
    n = len(padded)
    # Hashes of runs twice as long, out of two neighbours each time: 2, 4, 8 characters.
    h = codes
    for step, factor in ((1, 0x9E3779B97F4A7C15), (2, 0xC2B2AE3D27D4EB4F), (4, 0x165667B19E3779F9)):
        h = h[:-step] * np.uint64(factor) + _mixed_once(h[step:])
    h = h[:n]
    begins = np.concatenate([[0], np.cumsum(sizes + SHINGLE - 1)[:-1]])
    runs = np.maximum(1, sizes - SHINGLE + 1)
    owner = np.repeat(np.arange(len(lines)), runs)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(runs) - runs, runs) + np.repeat(begins, runs)
    h = _mixed(h[place])
    bins = BANDS * ROWS
    cell = owner * bins + ((h >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64)
    empty = np.uint64(0xFFFFFFFFFFFFFFFF)
    signature = np.full(len(lines) * bins, empty, np.uint64)
    np.minimum.at(signature, cell, h & np.uint64(0xFFFFFFFF))
    signature = signature.reshape(-1, bins)
    drawn = np.arange(bins, dtype=np.uint64)
    filled = signature.copy()
    rows, columns = np.nonzero(filled == empty)
    for attempt in range(1, 10_000):
        if not len(rows):
            break
        # The same bin asks the same others in every line.
        asked = (_mixed(drawn * np.uint64(10_007) + np.uint64(attempt)) % np.uint64(bins)).astype(np.int64)
        got = signature[rows, asked[columns]]
        filled[rows, columns] = got
        rows, columns = rows[got == empty], columns[got == empty]
    return filled


def _sketches(lines: list[str], sizes: np.ndarray) -> np.ndarray:
    fours = (_signatures(lines, sizes)[:, :PLACES] & np.uint64(15)).astype(np.uint8)
    return (fours[:, 0::2] | fours[:, 1::2] << np.uint8(4)).view("<u8")


def sketches(lines: list[str]) -> np.ndarray:
    """Four bits of PLACES places of each line's signature, as numbers of 64 bits."""
    return _by_chunks(lines, _sketches, np.zeros((0, PLACES // 16), np.uint64))


def agree(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Whether sketches have enough places in common."""
    apart = one ^ other
    apart |= apart >> np.uint64(1)
    apart |= apart >> np.uint64(2)
    return np.bitwise_count(apart & np.uint64(0x1111111111111111)).sum(-1) <= PLACES - AGREE


def digest(line: str) -> bytes:
    from xxhash import xxh3_128_digest

    return xxh3_128_digest(line.encode())


def shingles(line: str) -> frozenset[str]:
    return frozenset(line[i : i + SHINGLE] for i in range(max(1, len(line) - SHINGLE + 1)))


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))


def _lines(text: str | None) -> list[tuple[int, str]]:
    """(number, line) of the lines that are not blank, without blanks at both ends and with A-Z in lower case."""
    # Bytes are lower-cased in ASCII alone, and no other character has a byte of an ASCII one.
    lower = (text or "").encode().lower().decode()
    return [(i, line) for i, line in enumerate(x.strip(BLANKS) for x in lower.split("\n")) if line]


def _first(texts: list[str | None]) -> dict[bytes, str]:
    """The lines of some texts by digest, each once."""
    return {digest(line): line for line in {line: None for text in texts for _, line in _lines(text)}}


def occurrences(docs: DataFrame, row: str | None = None) -> DataFrame:
    """(doc_id, row, places, ids) for each row of ``docs``: numbers and digests of the lines that are not blank."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            listed = [_lines(text) for text in batch.column(2).to_pylist()]
            columns = [
                batch.column(0), batch.column(1), pa.array([[i for i, _ in row] for row in listed], pa.list_(pa.int32())),
                pa.array([[digest(line) for _, line in row] for row in listed], pa.list_(pa.binary())),
            ]
            yield pa.record_batch(columns, names=["doc_id", "row", "places", "ids"])

    number = F.col(row) if row else F.monotonically_increasing_id()
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), number.alias("row"), docs["text"].cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, row long, places array<int>, ids array<binary>")


def _nodes(digests: list[bytes]) -> np.ndarray:
    """The first NODE_BYTES of digests as numbers: enough to name a candidate, as candidates are verified."""
    return _wide(b"".join(x[:NODE_BYTES] for x in digests))


def _wide(narrow: bytes) -> np.ndarray:
    wide = np.zeros((len(narrow) // NODE_BYTES, 8), np.uint8)
    wide[:, :NODE_BYTES] = np.frombuffer(narrow, np.uint8).reshape(-1, NODE_BYTES)
    return wide.view("<i8").ravel().astype(np.int64)


def _narrow(nodes: np.ndarray) -> bytes:
    return nodes.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :NODE_BYTES].tobytes()


def _led(keys: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(leader, node) for all nodes of a key but its smallest, which leads."""
    order = np.argsort(keys)
    keys, nodes = keys[order], nodes[order]
    shared, same = np.zeros(len(keys), bool), keys[1:] == keys[:-1]
    shared[1:] |= same
    shared[:-1] |= same
    keys, nodes = keys[shared], nodes[shared]
    order = np.lexsort((nodes, keys))
    keys, nodes = keys[order], nodes[order]
    new_key = np.concatenate([[True], keys[1:] != keys[:-1]])[: len(keys)]
    new_node = new_key | np.concatenate([[True], nodes[1:] != nodes[:-1]])[: len(keys)]
    leaders = nodes[np.maximum.accumulate(np.where(new_key, np.arange(len(keys)), 0))]
    return leaders[new_node & ~new_key], nodes[new_node & ~new_key]


def chains(docs: DataFrame, n_lines: int, in_range: int = RANGE) -> DataFrame:
    """(a, b): of each bucket, pairs of its leader and another node."""
    ranges = max(1, -(-n_lines * BANDS // in_range))
    schema = pa.schema([("range", pa.int32()), ("keys", pa.list_(pa.int32())), ("nodes", pa.binary())])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first = _first(batch.column(0).to_pylist())
            if not first:
                continue
            keys, nodes = bands(list(first.values())).ravel(), np.repeat(_nodes(list(first)), BANDS)
            order = np.argsort(keys)
            keys, nodes = keys[order], nodes[order]
            of_range = (keys >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)
            held, begins = np.unique(of_range, return_index=True)
            ends = np.append(begins, len(keys)).astype(np.int32)
            low = pa.array(keys.astype(np.uint32).view(np.int32))
            named = pa.Array.from_buffers(pa.binary(), len(held), [None, pa.py_buffer(ends * np.int32(NODE_BYTES)), pa.py_buffer(_narrow(nodes))])
            yield pa.record_batch([pa.array(held, pa.int32()), pa.ListArray.from_arrays(pa.array(ends), low), named], schema=schema)

    def lead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            for keys, nodes in zip(batch.column(1), batch.column(2), strict=True):
                held.append((keys.values.to_numpy(), _wide(nodes.as_py())))
        if held:
            yield from _pairs(*_led(*(np.concatenate(x) for x in zip(*held, strict=True))))

    sent = _texts(docs).select("text").mapInArrow(send, "range int, keys array<int>, nodes binary")
    return sent.repartitionById(ranges, "range").mapInArrow(lead, "a long, b long").distinct()


def _pairs(a: np.ndarray, b: np.ndarray) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(a), 1 << 16):
        yield pa.record_batch([pa.array(a[i : i + (1 << 16)]), pa.array(b[i : i + (1 << 16)])], names=["a", "b"])


def spanning(n: int, near: Callable[[int, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """Edges of trees that connect 0 to n - 1 where ``near`` (of one, which of these) links them."""
    left, edges = np.arange(n), []
    while len(left):
        part, left, at = [int(left[0])], left[1:], 0
        while at < len(part) and len(left):
            linked = near(part[at], left)
            if len(linked):
                edges += [(i, part[at]) for i in linked.tolist()]
                part += linked.tolist()
                left = left[~np.isin(left, linked)]
            at += 1
    return edges


def _close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [[c.to_numpy() for c in batch.columns] for batch in batches]
    if not held:
        return
    leaders, nodes, *marks = (np.concatenate(x) for x in zip(*held, strict=True))
    order = np.argsort(leaders, kind="stable")
    leaders, nodes, marks = leaders[order], nodes[order], np.stack(marks, 1).view(np.uint64)[order]
    begins = np.flatnonzero(np.concatenate([[True], leaders[1:] != leaders[:-1]]))
    sizes = np.diff(np.append(begins, len(leaders)))
    at = np.flatnonzero(np.repeat(sizes <= CLOSE, sizes))
    for step in range(1, CLOSE):
        at = at[at + step < len(leaders)]
        at = at[leaders[at] == leaders[at + step]]
        linked = at[agree(marks[at], marks[at + step])]
        yield from _pairs(nodes[linked], nodes[linked + step])
    for begin, size in zip(begins[sizes > CLOSE].tolist(), sizes[sizes > CLOSE].tolist(), strict=True):
        own = marks[begin : begin + size]
        edges = spanning(size, lambda x, left, own=own: left[agree(own[left], own[x])])
        if edges:
            yield from _pairs(*nodes[begin + np.array(edges).T])


def close(pairs: DataFrame, marked: DataFrame) -> DataFrame:
    """(a, b): nodes of the same leader whose sketches agree, or trees over them; marked: node and its sketch."""
    led = pairs.union(pairs.select("a", F.col("a").alias("b")).distinct()).withColumnRenamed("b", "node")
    names = [f"s{i}" for i in range(PLACES // 16)]
    return led.join(marked, "node").select("a", "node", *names).repartition("a").mapInArrow(_close, "a long, b long")


def packed(line: str) -> np.ndarray | frozenset[str]:
    """The shingles of a line; as sorted 64-bit numbers where each of their characters is one byte of Latin-1."""
    try:
        codes = line.encode("latin-1")
    except UnicodeEncodeError:
        return shingles(line)
    if len(codes) < SHINGLE:
        return shingles(line)
    # Eight bytes from each byte on, read as one number.
    runs = np.ndarray(len(codes) - SHINGLE + 1, "<u8", codes, strides=(1,)).copy()
    runs.sort()
    return runs[np.concatenate([[True], runs[1:] != runs[:-1]])]


def alike(one: tuple, other: tuple, similar: float) -> bool:
    """Whether two (line, packed shingles) have that Jaccard similarity."""
    (x, a), (y, b) = one, other
    if min(len(a), len(b)) < similar * max(len(a), len(b)) - 1e-9:
        return False
    if isinstance(a, np.ndarray) and isinstance(b, np.ndarray):
        both = np.concatenate([a, b])
        both.sort()
        shared = int(np.count_nonzero(both[1:] == both[:-1]))
    else:
        shared = len(shingles(x) & shingles(y))
    return shared >= similar * (len(a) + len(b) - shared) - 1e-9


def tree(listed: list[tuple[bytes, str]], similar: float = SIMILAR) -> list[tuple[bytes, bytes]]:
    """Edges that connect lines of which ``similar`` or more of the shingles are shared.

    In a group of more than FEW lines, two whose sketches do not agree are not compared.
    """
    if len(listed) < 2:
        return []
    sets = [(line, packed(line)) for _, line in listed]
    marks = sketches([line for _, line in listed]) if len(listed) > FEW else None

    def near(x: int, left: np.ndarray) -> np.ndarray:
        some = left if marks is None else left[agree(marks[left], marks[x])]
        return some[[alike(sets[x], sets[i], similar) for i in some.tolist()]] if len(some) else some

    return [(listed[a][0], listed[b][0]) for a, b in spanning(len(listed), near)]


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, held = None, {}
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary())])
    for batch in batches:
        edges: list = []
        for *group, mark, line in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if group != key:
                edges += tree(list(held.items()))
                key, held = group, {}
            held[mark] = line
        yield pa.record_batch([pa.array([e[i] for e in edges], pa.binary()) for i in (0, 1)], schema=schema)
    edges = tree(list(held.items()))
    yield pa.record_batch([pa.array([e[i] for e in edges], pa.binary()) for i in (0, 1)], schema=schema)


def _bits(keys: int) -> int:
    """Sixteen bits a key, 64 MB at most: a bitmap of fixed size, which holds back few lines once it is full."""
    return min(KEY_BITS, max(1 << 20, 16 * keys))


def links(docs: DataFrame, n_lines: int, block: int = BLOCK) -> DataFrame:
    """Edges (a, b: digests) whose components are those of all verified pairs."""
    pairs = written(chains(docs, n_lines), "pairs")
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node"))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first = _first(batch.column(0).to_pylist())
            yield pa.record_batch(
                [pa.array(_nodes(list(first))), pa.array(list(first), pa.binary()), pa.array(list(first.values()), pa.string())],
                names=["node", "id", "line"],
            )

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = batch.column(1).to_pylist()
            columns = [batch.column(0), pa.array([len(x) for x in lines], pa.int64()), *map(pa.array, sketches(lines).view(np.int64).T)]
            yield pa.record_batch(columns, names=["node", "chars", *(f"s{i}" for i in range(PLACES // 16))])

    listed = _texts(docs).select("text").mapInArrow(split, "node long, id binary, line string")
    # Sketches are made for all lines that pass, so the bitmap is four times as sparse here.
    bits = _bits(4 * ends.agg(F.approx_count_distinct("node")).first()[0])
    listed = written(split_by_keys(listed, ends, ["node"], bits)[0], "candidates")
    columns = ", ".join(f"s{i} long" for i in range(PLACES // 16))
    marked = written(listed.select("node", "line").mapInArrow(mark, f"node long, chars long, {columns}").distinct(), "sketches")
    groups = components(close(pairs, marked))
    blocks = F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum("chars") / BLOCK_CHARS)).cast("int").alias("blocks")
    sizes = groups.join(marked.select("node", "chars"), "node").groupBy("root").agg(blocks)
    groups = written(groups.join(sizes, "root"), "groups")
    shared = split_by_keys(listed, groups, ["node"], _bits(groups.count()))[0].join(groups, "node")
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    dealt = shared.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("root", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "id", "line")
    keys = ["root", "i", "j"]
    return dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_verified, "a binary, b binary").distinct()


def judge(docs: DataFrame, block: int = BLOCK, row: str | None = None) -> DataFrame:
    """doc_id, row, n_lines, n_dropped, dropped (line numbers, ascending) for each row of ``docs``.

    Rows are numbered by the column ``row``, or as they are read.
    """
    places = written(occurrences(docs, row), "lines")
    n_lines = places.agg(F.sum(F.size("places"))).first()[0] or 0
    of_line = components(links(docs, n_lines, block)).select(F.col("node").alias("id"), "root")
    place = F.struct(F.coalesce("doc_id", F.lit(LAST_ID)).alias("order"), "row", F.col("x.places").alias("line"))
    each = places.select(F.explode(F.arrays_zip("places", "ids")).alias("x"), "doc_id", "row").select(F.col("x.ids").alias("id"), place.alias("place"))
    # Roots come along as rows without a place, so that lines are shuffled once for both.
    rooted = of_line.select("id", F.lit(None).cast(each.schema["place"].dataType).alias("place"), "root")
    both = each.withColumn("root", F.lit(None).cast("binary")).unionByName(rooted)
    firsts = both.groupBy("id").agg(F.min("place").alias("first"), F.count("place").alias("n"), F.max("root").alias("root"))
    # A line that stands once in the corpus and is like no other needs no more work.
    named = firsts.filter("n > 1 OR root IS NOT NULL").select("id", F.coalesce("root", "id").alias("root"), "first")
    named = written(named, "named")
    kept = written(named.groupBy("root").agg(F.min("first").alias("kept")), "kept")
    known = written(named.select("id", "root").join(kept, "root").select("id", "kept"), "known")
    dropped = split_by_keys(each, known, ["id"], _bits(known.count()))[0].join(known, "id").filter("place != kept").select(F.col("place.row").alias("row"), F.col("place.line").alias("line"))
    dropped = dropped.groupBy("row").agg(F.sort_array(F.collect_list("line")).alias("dropped"))  # no more than a document's lines
    found = places.select("doc_id", "row", F.size("places").cast("long").alias("n_lines")).join(dropped, "row", "left")
    dropped = F.coalesce("dropped", F.array().cast("array<int>"))
    return found.select("doc_id", "row", "n_lines", F.size(dropped).cast("long").alias("n_dropped"), dropped.alias("dropped"))


def deduplicate(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """``docs`` with all columns, their texts without the lines that are dropped; null texts stay null."""
    free = "_row"
    while free in docs.columns:
        free += "_"
    numbered = written(docs.withColumn(free, F.monotonically_increasing_id()), "numbered")
    dropped = judge(numbered, block, free).filter("n_dropped > 0").select(F.col("row").alias(free), "dropped")
    known = numbered.join(dropped, free, "left")
    split = F.split("text", "\n", -1)
    rest = F.filter(split, lambda _, i: ~F.array_contains("dropped", i))
    text = F.when(F.col("dropped").isNull(), F.col("text")).otherwise(F.array_join(rest, "\n"))
    return known.select(*(text.alias(c) if c == "text" else c for c in docs.columns))
