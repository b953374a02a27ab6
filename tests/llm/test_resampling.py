"""Importance resampling: scores by a plain-Python version, the exact cut on ties and hot rows, ranks, odd tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from hushlake.llm import resampling
from hushlake.llm.common import ready, written

SCHEMA = "doc_id long, text string, row int, minus long, id long, score int, n_words int, rank string, `buckets` int"
WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FILL = " ".join(f"word{i}" for i in range(25))


def runs(text, longest):
    found = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(found), [" ".join(found[i : i + n]) for n in range(1, longest + 1) for i in range(len(found) - n + 1)]


def resampled(rows, target, percent=10, buckets=10_000, longest=1, seed=2024):
    """(doc_id, n_features, weight, score, rank) of each row, in order."""
    listed = [runs(t, longest) for _, t in rows]
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s = Counter(bucket(f) for _, fs in listed for f in fs)
    t = Counter(bucket(f) for text in target for f in runs(text, longest)[1])
    all_s, all_t, out = sum(s.values()), sum(t.values()), []
    for (doc, _), (n_words, fs) in zip(rows, listed, strict=True):
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in map(bucket, fs))
        h = int(hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        out.append([doc, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n_words])
    order = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for i, r in enumerate(order[: percent * len(order) // 100], 1):
        r[4] = i
    return [tuple(r[:5]) for r in out]


def table(spark, rows):
    ready(spark)
    return written(spark.createDataFrame([(i, t, 1, 2, 3, 4, 5, "x", 6) for i, t in rows], SCHEMA), "resample-test")


def targets(spark, texts):
    ready(spark)
    return spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")


ODD = [(1, FILL), (1, FILL), (2, FILL), (None, FILL), (None, FILL + " É"), (3, None), (4, ""), (None, None), (-7, FILL.upper()),
       (8, "few words"), (9, "ÀB 12 a_b\x7f" * 9), (10, "long " * 200_000), *((i, f"w{i} " * 30) for i in range(20, 60))]


def bag(rows):
    return Counter(map(repr, map(tuple, rows)))


@pytest.mark.parametrize("longest", [1, 3])
def test_odd_rows(spark, longest):
    found = resampling.resample(table(spark, ODD), targets(spark, ["word1 word2 É", None, ""]), 30, 500, longest, last=8).collect()
    assert bag(found) == bag(resampled(ODD, ["word1 word2 É", None, ""], 30, 500, longest))


@pytest.mark.parametrize("percent", [0, 1, 100])
def test_shares_at_the_ends(spark, percent):
    found = resampling.resample(table(spark, ODD), targets(spark, []), percent).collect()
    assert bag(found) == bag(resampled(ODD, [], percent))


def test_empty_table(spark):
    docs = table(spark, ODD)
    assert resampling.resample(docs.filter("doc_id > 999"), targets(spark, ["x"])).count() == 0
    few = docs.filter("doc_id = 8")
    assert [tuple(r)[4] for r in resampling.resample(few, targets(spark, ["x"])).collect()] == [None]


def test_pieces_of_a_text(monkeypatch):
    """Runs of words over the ends of pieces are neither lost nor counted twice."""
    text = (FILL + " a b c, d e ").encode() * 3
    n, whole = resampling.text_buckets(text, resampling.Buckets(977), 4)
    assert (n, len(whole)) == (90, 90 + 89 + 88 + 87)
    for size in (1, 5, 40):
        monkeypatch.setattr(resampling, "PIECE", size)
        again = resampling.text_buckets(text, resampling.Buckets(977), 4)
        assert again[0] == n and sorted(again[1]) == sorted(whole)


def test_many_buckets(spark):
    """Over 65,536 buckets take four bytes each."""
    found = resampling.resample(table(spark, ODD), targets(spark, ["word1"]), 30, 200_000).collect()
    assert bag(found) == bag(resampled(ODD, ["word1"], 30, 200_000))


def drawn(spark, rows, parts, wanted, last=8):
    frame = spark.createDataFrame(rows, "minus long, unknown long, id long, row long").repartition(parts)
    return resampling.cut(written(frame, "cut-test"), wanted, last)


@pytest.mark.parametrize("wanted", [0, 1, 2, 700, 1400, 1999, 2000, 5000])
def test_cut_at_any_place(spark, wanted):
    ready(spark)
    rng = random.Random(wanted)
    rows = [(rng.randint(-5, 5), int(rng.random() < 0.3), rng.randint(0, 50), i) for i in range(2000)]
    place = min(wanted, 2000)
    assert drawn(spark, rows, 7, wanted) == (sorted(rows)[place - 1] if wanted else None)


def test_cut_within_one_key(spark):
    """A third of all rows have the same score and no id, and the cut lies among them; parts differ in size."""
    ready(spark)
    rows = [(0, 1, 0, i) for i in range(1000)] + [(1 - 2 * (i % 2), 0, i, 1000 + i) for i in range(2000)]
    for wanted in (1001, 1500, 2000, 2001):
        assert drawn(spark, rows, 3, wanted) == sorted(rows)[wanted - 1]


def test_a_pivot_leaves_a_quarter_on_each_side():
    """Parts of very different sizes, whose rows are dealt at random or in order."""
    rng = np.random.default_rng(0)
    for mixed in (True, False) * 5:
        sizes = rng.integers(1, 3000, 9)
        rows = rng.permutation(sizes.sum()) if mixed else np.arange(sizes.sum())
        parts = [rows[a:b] for a, b in zip(np.cumsum([0, *sizes[:-1]]), np.cumsum(sizes), strict=True)]
        (pivot,) = resampling._weighted_median([(len(p), int(np.sort(p)[(len(p) - 1) // 2])) for p in parts])
        assert 0.24 * len(rows) < (rows <= pivot).sum() and 0.24 * len(rows) < (rows >= pivot).sum()


def test_ranks_over_many_parts(spark):
    ready(spark)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = spark.range(5000).selectExpr("(id * 7919) % 50 AS minus", "0L AS unknown", "(id * 31) % 5000 AS id", "id AS row")
        found = sorted((r["rank"], r.minus, r.id) for r in resampling.ranked(rows).collect())
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert [r[0] for r in found] == list(range(1, 5001)) and [r[1:] for r in found] == sorted(r[1:] for r in found)
