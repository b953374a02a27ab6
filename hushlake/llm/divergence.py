"""How far the sources of a language lie apart, and which terms set a source off from its language.

A term is a run of letters and of characters beyond ASCII, with A-Z lower-cased.
A language keeps the terms that at least MIN_DOCS of its documents hold. Each
(lang, source) group, and each language, gives each kept term the share
``p = 1 + floor(10^9 * (count + 5) / (N + 5 * V))``, in whole numbers.

- ``pair``: the shares of two sources, absolute differences summed over all kept
  terms, for each other source of the language. That table has a row for each
  ordered pair of sources by its definition. Its sums are made in blocks, as in
  a product of matrices: a task has the shares of two blocks of sources over one
  block of terms, whatever the number of either. Terms that neither source has
  enter by a closed form.
- ``term``: the terms with a larger share in the group than in the language, the
  ``top`` largest differences. Within a group the difference grows with the
  group's count and falls with the language's, and ties go to the earlier term.
  So a term that ``top`` others dominate (count at least as high, language's
  count at least as low, earlier in UTF-8) cannot be among the first ``top``.
  Each partition keeps its skyband, the terms with fewer than ``top``
  dominators; skybands are merged by a smaller number of tasks, and then by
  group, and only what is left is ranked by exact differences. A skyband is
  built batch by batch, so a task holds a band and a batch, never a group.

Texts are counted in the task that reads them, and counts combine before the
shuffle, so neither a hot source nor a very frequent term is a hot key.

Null text, lang and source count as ''. A group without terms has its pairs
(value 0 where the language keeps no term) and no terms. Repeated rows count as
often as they occur, and each is a document. Texts of any length are read as a
whole, in pieces. An empty table gives no row. Other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hushlake.llm.common import written

MIN_DOCS = 30
TOP = 50
#: Sources and terms in a block of the matrix of shares.
SOURCES, TERMS = 64, 4096
#: Counts that a task holds before it gives them on.
HELD = 200_000
#: Characters of a text that are cut into terms at a time.
PIECE = 1 << 22
#: Upper-case letters to lower case, letters and bytes beyond ASCII as they are, all else to a blank.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))

COUNTED = "lang string, source string, term binary, n long, docs long"
COUNTED_ARROW = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.binary()), ("n", pa.int64()), ("docs", pa.int64())])


def terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in order, as lists for pieces of it."""
    folded = text.translate(LETTERS)
    at = 0
    while at < len(folded):
        cut = folded.find(b" ", at + PIECE)
        end = len(folded) if cut < 0 else cut
        yield folded[at:end].split()
        at = end


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    groups: dict[tuple, tuple[Counter, Counter]] = {}

    def given() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in groups.items():
            listed = list(n)
            yield pa.record_batch(
                [pa.array([lang] * len(listed), pa.string()), pa.array([source] * len(listed), pa.string()),
                 pa.array(listed, pa.binary()), pa.array(n.values(), pa.int64()), pa.array([docs[t] for t in listed], pa.int64())],
                schema=COUNTED_ARROW,
            )
        groups.clear()

    def seen(found: set) -> pa.RecordBatch:
        # A group occurs even if it has no terms: a row without a term stands for it.
        langs, sources = zip(*sorted(found), strict=True)
        none, zero = pa.nulls(len(langs), pa.binary()), pa.array([0] * len(langs), pa.int64())
        return pa.record_batch([pa.array(langs, pa.string()), pa.array(sources, pa.string()), none, zero, zero], schema=COUNTED_ARROW)

    occur: set[tuple[str, str]] = set()
    for batch in batches:
        for lang, source, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            occur.add((lang, source))
            n, docs = groups.setdefault((lang, source), (Counter(), Counter()))
            of_text: set[bytes] = set()
            for piece in terms(text):
                n.update(piece)
                of_text.update(piece)
            docs.update(of_text)
        if sum(len(n) for n, _ in groups.values()) > HELD:
            yield from given()
        if len(occur) > HELD:
            yield seen(occur)
            occur.clear()
    yield from given()
    if occur:
        yield seen(occur)


def counted(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents with it); a null term stands for the group itself."""
    empty = F.lit("")
    rows = docs.select(
        F.coalesce(docs["lang"].cast("string"), empty).alias("lang"),
        F.coalesce(docs["source"].cast("string"), empty).alias("source"),
        F.coalesce(docs["text"].cast("string"), empty).cast("binary").alias("text"),
    )
    found = rows.mapInArrow(_count, COUNTED).withColumn("term", F.col("term").cast("string"))
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: Column | int, total: str, kept: str) -> Column:
    """1 + floor(10^9 * (count + 5) / (total + 5 * kept)); products beyond a long are decimals."""
    count = F.lit(count) if isinstance(count, int) else count
    top = (count + 5).cast("decimal(19,0)") * F.lit(1_000_000_000).cast("decimal(10,0)")
    below = (F.col(total) + 5 * F.col(kept)).cast("decimal(19,0)")
    return 1 + F.call_function("div", top, below)


class Tables:
    """What both parts read: kept terms, counts of kept terms by group, and totals; all in the shared folder."""

    def __init__(self, docs: DataFrame, min_docs: int = MIN_DOCS) -> None:
        counts = written(counted(docs), "term-counts")
        real = counts.filter("term IS NOT NULL")
        kept = real.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).filter(F.col("docs") >= min_docs)
        kept = written(kept.select("lang", "term", "lang_n"), "kept-terms")
        #: lang, lang_total, terms.
        langs = kept.groupBy("lang").agg(F.sum("lang_n").alias("lang_total"), F.count("*").alias("terms"))
        #: lang, source, term, n, lang_n.
        self.counts = written(real.join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "lang_n"), "kept-counts")
        totals = self.counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
        found = counts.filter("term IS NULL").select("lang", "source")
        groups = found.join(totals, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["total", "lang_total", "terms"])
        #: lang, source, total, lang_total, terms, least: the share of a term that the group does not have.
        self.groups = written(groups.withColumn("least", F.when(F.col("terms") > 0, share(0, "total", "terms"))), "groups")


def _differences(batch: pa.Table) -> pa.Table:
    """lang, source, item, beyond: for two blocks of sources, what the terms at hand add to the closed form."""
    lang = batch.column("lang")[0].as_py()
    first, second = batch.column("first")[0].as_py(), batch.column("second")[0].as_py()
    block, p, least = (batch.column(c).to_numpy() for c in ("block", "p", "least"))
    term, source = (batch.column(c).combine_chunks().dictionary_encode() for c in ("term", "source"))
    column, row = np.asarray(term.indices.fill_null(-1)), np.asarray(source.indices)
    names = source.dictionary.to_pylist()
    lowest = np.zeros(len(names), np.int64)
    lowest[row] = least
    of_block = np.zeros(len(names), np.int64)
    of_block[row] = block
    shares = np.repeat(lowest[:, None], len(term.dictionary), axis=1)
    shares[row[column >= 0], column[column >= 0]] = p[column >= 0]
    left, right = np.flatnonzero(of_block == first), np.flatnonzero(of_block == second)
    made: list[list] = [[], [], []]
    for one in left.tolist():
        apart = np.abs(shares[right] - shares[one]).sum(axis=1) - shares.shape[1] * np.abs(lowest[right] - lowest[one])
        for other, beyond in zip(right.tolist(), apart.tolist(), strict=True):
            if one != other:
                for column_, value in zip(made, (names[one], names[other], beyond), strict=True):
                    column_.append(value)
                if first != second:
                    for column_, value in zip(made, (names[other], names[one], beyond), strict=True):
                        column_.append(value)
    return pa.table({"lang": pa.array([lang] * len(made[0]), pa.string()), "source": pa.array(made[0], pa.string()),
                     "item": pa.array(made[1], pa.string()), "beyond": pa.array(made[2], pa.int64())})


def pairs(tables: Tables, sources: int = SOURCES, block_terms: int = TERMS) -> DataFrame:
    """lang, source, item, value for all ordered pairs of a language's sources."""
    sizes = tables.groups.groupBy("lang").agg(F.ceil(F.count("*") / sources).alias("blocks"), F.ceil(F.max("terms") / block_terms).alias("slices"))
    groups = tables.groups.filter("terms > 0").join(sizes, "lang")

    def numbers(count: str) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(count) - 1))

    shares = tables.counts.join(groups, ["lang", "source"]).withColumns(
        {"p": share(F.col("n"), "total", "terms"), "slice": F.pmod(F.xxhash64("term"), "slices")}
    )
    # A source without terms in a slice still meets the others there: it has a row without a term in each.
    present = groups.withColumns({"term": F.lit(None).cast("string"), "p": F.col("least"), "slice": numbers("slices")})
    columns = ["lang", "source", "term", "p", "least", "slice", "blocks"]
    rows = shares.select(columns).unionByName(present.select(columns))
    rows = rows.withColumns({"block": F.pmod(F.xxhash64("source"), "blocks"), "met": numbers("blocks")}).drop("blocks")
    dealt = rows.withColumns({"first": F.least("block", "met"), "second": F.greatest("block", "met")}).drop("met")
    apart = dealt.groupBy("lang", "slice", "first", "second").applyInArrow(_differences, "lang string, source string, item string, beyond long")
    apart = apart.groupBy("lang", "source", "item").agg(F.sum("beyond").alias("beyond"))
    other = tables.groups.select("lang", F.col("source").alias("item"), F.col("least").alias("other_least"))
    every = tables.groups.select("lang", "source", "terms", "least").join(other, "lang").filter(F.col("source") != F.col("item"))
    closed = F.coalesce(F.col("terms") * F.abs(F.col("least") - F.col("other_least")), F.lit(0))
    value = closed + F.coalesce("beyond", F.lit(0))
    return every.join(apart, ["lang", "source", "item"], "left").select("lang", "source", "item", value.alias("value"))


def skyband(high: np.ndarray, low: np.ndarray, order: np.ndarray, k: int, step: int = 256) -> np.ndarray:
    """Places of the points that fewer than ``k`` others dominate: ``high`` no lower, ``low`` no higher, ``order`` earlier.

    Points are taken from the best on, so that dominators come before what they
    dominate. It is enough to count dominators within the band: of a point's
    first ``k`` dominators each has fewer than ``k`` itself.
    """
    best_first = np.lexsort((order, low, -high))
    band = best_first[:0]
    for at in range(0, len(best_first), step):
        new = best_first[at : at + step]
        counts = np.zeros(len(new), np.int64)
        # The best of the band come first and settle most points, which the rest of it need not see.
        for part in range(0, len(band), step):
            counts += _dominators(high, low, order, band[part : part + step], new)
            new, counts = new[counts < k], counts[counts < k]
        # Dominators among the step's own points count whether or not they stay: they have fewer than k, or k dominate both.
        band = np.concatenate([band, new[counts + _dominators(high, low, order, new, new) < k]])
    return band


def _dominators(high: np.ndarray, low: np.ndarray, order: np.ndarray, over: np.ndarray, under: np.ndarray) -> np.ndarray:
    """For each point of ``under``, how many points of ``over`` dominate it."""
    found = high[over][None, :] >= high[under][:, None]
    found &= low[over][None, :] <= low[under][:, None]
    found &= order[over][None, :] < order[under][:, None]
    return found.sum(axis=1)


#: Rows that a task holds besides its groups' bands.
WAITING = 200_000


def _bands(rows: pa.Table, k: int) -> pa.Table:
    """The rows of each group's skyband."""
    order = np.empty(rows.num_rows, np.int64)
    order[pc.sort_indices(rows, [("term", "ascending")]).to_numpy()] = np.arange(rows.num_rows)
    lang, source = (rows.column(c).combine_chunks().dictionary_encode() for c in ("lang", "source"))
    group = lang.indices.to_numpy().astype(np.int64) * len(source.dictionary) + source.indices.to_numpy()
    high, low = rows.column("n").to_numpy(), rows.column("lang_n").to_numpy()
    by_group = np.argsort(group, kind="stable")
    kept = []
    for own in np.split(by_group, np.flatnonzero(np.diff(group[by_group])) + 1):
        kept.append(own[skyband(high[own], low[own], order[own], k)])
    return rows.take(pa.array(np.sort(np.concatenate(kept))))


def _band(k: int):
    """Reads rows of groups in any order; gives each group's skyband at the end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        waiting = 0
        for batch in batches:
            held.append(batch)
            waiting += batch.num_rows
            if waiting >= WAITING:
                held, waiting = _bands(pa.Table.from_batches(held), k).to_batches(), 0
        if held:
            rows = pa.Table.from_batches(held)
            if rows.num_rows:
                yield from _bands(rows, k).to_batches()

    return run


def skybands(counts: DataFrame, k: int, tasks: int = 16) -> DataFrame:
    """lang, source, term, n, lang_n of the terms that can be among the first ``k`` of their group."""
    schema = "lang string, source string, term binary, n long, lang_n long"
    rows = counts.select("lang", "source", F.col("term").cast("binary").alias("term"), "n", "lang_n")
    own = rows.mapInArrow(_band(k), schema)
    # A group's bands are first merged by a few tasks, each with its own terms, and then by one.
    some = own.repartition("lang", "source", F.pmod(F.xxhash64("term"), F.lit(tasks))).mapInArrow(_band(k), schema)
    merged = some.repartition("lang", "source").mapInArrow(_band(k), schema)
    return merged.withColumn("term", F.col("term").cast("string"))


def leading_terms(tables: Tables, top: int = TOP) -> DataFrame:
    """lang, source, item, value: the ``top`` terms of each group by how much larger their share is than the language's."""
    rows = skybands(tables.counts, top).join(tables.groups, ["lang", "source"])
    apart = share(F.col("n"), "total", "terms") - share(F.col("lang_n"), "lang_total", "terms")
    ranked = ranking(rows.select("lang", "source", F.col("term").alias("item"), apart.alias("value")).filter("value > 0"))
    return ranked.filter(F.col("rank") <= top)


def ranking(rows: DataFrame) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return rows.withColumn("rank", place)


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part (``pair`` or ``term``), item, value, rank."""
    tables = Tables(docs, min_docs)
    parts = {"pair": ranking(pairs(tables)), "term": leading_terms(tables, top)}
    pair, term = (rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank") for part, rows in parts.items())
    return pair.unionByName(term)
