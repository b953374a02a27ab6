"""Spans: external detectors, type switches and merging.

A span is a found piece of one text. Spans live in two forms: as an array
beside the text (no shuffle, the usual way) and as a table with one row each,
keyed by the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hushlake.functions.arrays import let, scan_before
from hushlake.operators.sides import measured

# start/end count characters from 0, end exclusive. Sorting this struct sorts
# by position. ``external`` is false for rules, which win over detectors.
SPAN = (
    "struct<start int, end int, external boolean, pos int, type string, source string,"
    " confidence double, value string>"
)
NO_SPANS = f"array<{SPAN}>"

SPAN_COLUMNS = ["start", "end", "external", "pos", "type", "source", "confidence", "value"]


def external_spans(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Bring a detector's table (keys, start, end, type, source, confidence) to span form.

    A span that begins before the text begins at its first character. What
    covers no character is left out; ``empty_spans`` counts it.
    """
    return spans.select(
        *keys,
        F.greatest(F.col("start").cast("int"), F.lit(0)).alias("start"),
        F.col("end").cast("int").alias("end"),
        F.lit(True).alias("external"),
        F.lit(0).alias("pos"),
        F.col("type"),
        F.col("source"),
        F.col("confidence").cast("double").alias("confidence"),
        (F.col("value") if "value" in spans.columns else F.lit(None)).cast("string").alias("value"),
    ).filter(F.col("end") > F.col("start"))


def clamp_spans(spans: DataFrame, texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Cut spans in table form to their texts, as ``mask`` does beside the text. Only lengths are joined."""
    lengths = texts.select(*keys, F.length(F.make_valid_utf8(text)).alias("__length"))
    cut = spans.join(lengths, keys).withColumn("end", F.least("end", "__length"))
    return cut.filter(F.col("end") > F.col("start")).select(*spans.columns)


def empty_spans(spans: DataFrame, keys: list[str]) -> DataFrame:
    """For each text, how many of a detector's spans were cut at the beginning and how many cover nothing."""
    start, end = F.col("start").cast("int"), F.col("end").cast("int")
    return spans.groupBy(*keys).agg(
        F.count_if((start < 0) & (end > 0)).alias("clamped"), F.count_if(~(end > F.greatest(start, F.lit(0)))).alias("empty")
    )


def detect_external(rule_spans: DataFrame, external: DataFrame, keys: list[str]) -> DataFrame:
    """Add a detector's spans to the spans of the rules."""
    return rule_spans.unionByName(external_spans(external, keys), allowMissingColumns=True)


def filter_types(spans: DataFrame, types: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Drop external spans of switched-off types. Rules obey their own switch only.

    A detector's own table, without the column ``external``, is external as a whole.
    """
    on = [*(keys or []), "type"]
    off = types.filter(~F.col("enabled")).select(*on).distinct()
    if "external" in spans.columns:
        off, on = off.withColumn("external", F.lit(True)), [*on, "external"]
    return spans.join(measured(off), on, "left_anti").select(*spans.columns)


def _rank(start: Column, end: Column, external: Column, pos: Column, type_: Column) -> Column:
    """Smallest wins: rule before detector, list order, longest, first, name."""
    return F.struct(
        external.alias("external"),
        pos.alias("pos"),
        (start - end).alias("neg_length"),
        start.alias("start"),
        type_.alias("type"),
    )


def merge_spans(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Merge overlapping spans of one text; touching spans stay apart.

    ``keys`` must name one text, so a window partition never exceeds what one
    text holds. The grouping after it reuses the partitioning: one shuffle.
    """
    order = Window.partitionBy(*keys).orderBy("start", "end")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    up_to = order.rowsBetween(Window.unboundedPreceding, 0)
    opens = F.coalesce(F.col("start") >= F.max("end").over(before), F.lit(True))
    marked = spans.withColumn("__opens", opens.cast("int")).withColumn(
        "__island", F.sum("__opens").over(up_to)
    )
    best = F.min(_rank(*[F.col(c) for c in ("start", "end", "external", "pos", "type")]))
    return (
        marked.groupBy(*keys, "__island")
        .agg(
            F.min("start").alias("start"),
            F.max("end").alias("end"),
            best.alias("__best"),
            F.max("confidence").alias("confidence"),
            F.sort_array(F.collect_set("source")).alias("sources"),
        )
        .select(
            *keys,
            "start",
            "end",
            F.col("__best.type").alias("type"),
            F.col("__best.external").alias("external"),
            "confidence",
            "sources",
        )
    )


def island_bounds(spans: str) -> str:
    """SQL: for sorted spans, the index of the first span of each island."""
    reach = scan_before(f"transform({spans}, s -> s.end)", "0", lambda a, b: f"greatest({a}, {b})")
    opens = f"zip_with({spans}, {reach}, (s, r) -> s.start >= r)"
    return f"filter(transform({opens}, (o, i) -> if(o, i, -1)), i -> i >= 0)"


def islands(spans: str, bounds: str) -> str:
    """SQL: one struct for each island, as ``merge_spans`` gives it, with the value if it is known."""
    members = f"transform({bounds}, (b, i) -> slice({spans}, b + 1, coalesce(get({bounds}, i + 1), size({spans})) - b))"
    rank = (
        "array_min(transform(m, s -> named_struct('external', s.external, 'pos', s.pos, "
        "'neg_length', s.start - s.end, 'start', s.start, 'type', s.type)))"
    )
    island = (
        "named_struct('start', m[0].start, 'end', array_max(m.end), 'type', best.type, "
        "'external', best.external, 'confidence', array_max(m.confidence), "
        "'sources', array_sort(array_distinct(m.source)), 'value', if(size(m) = 1, m[0].value, null))"
    )
    return f"transform({members}, m -> {let(rank, 'best', island)})"
