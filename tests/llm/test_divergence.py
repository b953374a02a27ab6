"""The divergence audit against a plain-Python version, on odd tables, small blocks and hot sources."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from hushlake.llm import divergence
from hushlake.llm.common import ready, written

SCHEMA = "doc_id long, text string, lang string, source string, term string, n long, docs int, total int, p int, value int, rank int"
TERMS = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def audited(rows, min_docs, top):
    """{(lang, source, part, item, value, rank)} of (text, lang, source), every term of every pair looked at."""
    counts, docs, langs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        found = TERMS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        groups.add((lang, source))
        counts[lang, source].update(found)
        langs[lang].update(found)
        docs[lang].update(set(found))
    out = set()
    for lang, source in groups:
        kept = [t for t in langs[lang] if docs[lang][t] >= min_docs]

        def shares(of, kept=kept):
            total = sum(of[t] for t in kept)
            return {t: 1 + 10**9 * (of[t] + 5) // (total + 5 * len(kept)) for t in kept}

        own, whole = shares(counts[lang, source]), shares(langs[lang])
        others = [s for x, s in groups if x == lang and s != source]
        values = {"pair": [(sum(abs(own[t] - q) for t, q in shares(counts[lang, s]).items()), s) for s in others],
                  "term": [(own[t] - whole[t], t) for t in kept if counts[lang, source][t] and own[t] > whole[t]]}
        for part, listed in values.items():
            listed.sort(key=lambda x: (-x[0], x[1].encode()))
            out |= {(lang, source, part, item, value, i) for i, (value, item) in enumerate(listed, 1) if part == "pair" or i <= top}
    return out


def table(spark, rows):
    ready(spark)
    listed = [(i, text, lang, source, "x", 1, 2, 3, 4, 5, 6) for i, (text, lang, source) in enumerate(rows)]
    return written(spark.createDataFrame(listed, SCHEMA), "audit-test")


ODD = [
    ("The cat, the CAT; the cat9dog", "en", "a"), ("the É é ÀB", "en", "a"), ("the É é ÀB", "en", "a"), (None, "en", "b"), ("", None, None),
    ("the", None, "x"), (None, None, None), ("12 34", "de", "a"), ("zwei \U0001f4a9", "de", "b"), ("zwei", "de", "b"),
    ("cat " * 30_000 + "dog", "en", "c"), ("the", "en", ""), ("dog the", "en", None), ("\x7f[]`{}@ a", "fr", "alone"),
]


@pytest.mark.parametrize("min_docs", [1, 2, 30])
def test_odd_rows(spark, min_docs):
    found = [tuple(r) for r in divergence.audit(table(spark, ODD), min_docs, 2).collect()]
    assert len(found) == len(set(found)) and set(found) == audited(ODD, min_docs, 2)
    if min_docs == 30:
        assert all(r[2] == "pair" and r[4] == 0 for r in found)


def test_empty_table(spark):
    assert divergence.audit(table(spark, ODD).filter("doc_id > 99")).count() == 0


def made(rng, n=400):
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    sources = ["hot"] * 6 + [f"s{i}" for i in range(13)]
    return [(" ".join(words[min(int(rng.expovariate(0.02)), 299)] for _ in range(rng.randint(0, 60))), rng.choice(["en", "de"]), rng.choice(sources))
            for _ in range(n)]


def test_blocks_of_sources_and_terms(spark):
    """Several blocks either way, and a source without terms."""
    rows = made(random.Random(3)) + [("", "en", "silent")]
    tables = divergence.Tables(table(spark, rows), 3)
    found = {tuple(r) for r in divergence.pairs(tables, sources=4, block_terms=40).collect()}
    assert found == {(*r[:2], *r[3:5]) for r in audited(rows, 3, 50) if r[2] == "pair"}


def test_counts_given_on_early_add_up(monkeypatch):
    """A task that may hold few counts, and texts in pieces of a few characters."""
    rows = [(lang, source, (text or "").encode()) for text, lang, source in made(random.Random(6))]
    batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows[i : i + 40], strict=True)], ["lang", "source", "text"]) for i in range(0, 400, 40)]

    def sums():
        out = Counter()
        for batch in divergence._count(iter(batches)):
            for lang, source, term, n, docs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                out[lang, source, term, "n"] += n
                out[lang, source, term, "docs"] += docs
        return out

    whole = sums()
    monkeypatch.setattr(divergence, "HELD", 50)
    monkeypatch.setattr(divergence, "PIECE", 7)
    assert sums() == whole and len(list(divergence._count(iter(batches)))) > 20


def test_leading_terms(spark):
    rows = made(random.Random(4))
    found = {tuple(r) for r in divergence.leading_terms(divergence.Tables(table(spark, rows), 2), 5).collect()}
    assert found == {(*r[:2], *r[3:]) for r in audited(rows, 2, 5) if r[2] == "term"}


@pytest.mark.parametrize("k", [1, 3, 50])
def test_skyband_counts_every_dominator(k):
    rng = np.random.default_rng(k)
    high, low, order = rng.integers(0, 30, 900), rng.integers(0, 30, 900), rng.permutation(900)
    over = (high[None, :] >= high[:, None]) & (low[None, :] <= low[:, None]) & (order[None, :] < order[:, None])
    assert sorted(divergence.skyband(high, low, order, k, step=64)) == np.flatnonzero(over.sum(axis=1) < k).tolist()


def test_bands_of_groups_in_any_order(monkeypatch):
    """Batches whose groups are mixed, shrunk again and again, give what all rows at once give."""
    rng = random.Random(7)
    rows = [("en", rng.choice("abc"), f"t{i}é".encode(), rng.randint(1, 30), rng.randint(1, 30)) for i in range(600)]
    names = ["lang", "source", "term", "n", "lang_n"]
    batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows[i : i + 50], strict=True)], names) for i in range(0, 600, 50)]

    def found():
        return {tuple(r.values()) for b in divergence._band(3)(iter(batches)) for r in b.to_pylist()}

    whole = found()
    wanted = {r for r in rows if sum(o[1] == r[1] and o[3] >= r[3] and o[4] <= r[4] and o[2] < r[2] for o in rows) < 3}
    monkeypatch.setattr(divergence, "WAITING", 70)
    assert found() == whole == wanted


def test_skybands_merge(spark):
    """Many partitions with a part of each group; the merged band is the group's own."""
    rng = random.Random(5)
    rows = [("en", rng.choice("aab"), f"t{i:05}", rng.randint(1, 99), rng.randint(1, 99)) for i in range(3000)]
    frame = spark.createDataFrame(rows, "lang string, source string, term string, n long, lang_n long").repartition(13)
    found = {tuple(r) for r in divergence.skybands(frame, 4, tasks=3).collect()}
    wanted = set()
    for source in "ab":
        own = [r for r in rows if r[1] == source]
        wanted |= {r for r in own if sum(o[3] >= r[3] and o[4] <= r[4] and o[2] < r[2] for o in own) < 4}
    assert found == wanted
