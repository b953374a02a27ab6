"""Verdicts, labels, predictions and scores of whole tables against plain-Python versions without batches, patterns or indexes."""

import math
import os
import re
import struct
import sys
import zlib
from collections import Counter

import numpy as np
import pytest
import regex
from xxhash import xxh64_intdigest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import brute  # noqa: E402

from hushlake.llm import compression, language, licences, rules  # noqa: E402
from hushlake.llm.common import ready  # noqa: E402
from hushlake.llm.queries import QUERIES  # noqa: E402


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}


def signed(h):
    return h - (1 << 64) if h >> 63 else h


def id_hash(doc):
    """Spark's xxhash64 of a long."""
    return signed(xxh64_intdigest(struct.pack("<q", doc), 42))


# ------------------------------------------------------------ quality rules


def votes(text):
    """The rules one by one, as their docstring and constants state them."""
    words = brute.WORDS.findall(text)
    if not words:
        return [0] * 9
    n, chars, symbols, dup, repeat, _ = brute.base_counts(text)
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    ends = (".", "!", "?", ":", ";", "…", '"', ")")
    share = sum(x.rstrip(" \t\n\x0b\x0c\r").endswith(ends) for x in lines) / len(lines)
    common = sum(w.encode() in rules.FUNCTION_WORDS for w in words) / n
    return [
        -(symbols >= 0.1 * n), -(not 2.5 <= chars / n <= 12), -(sum(w.isupper() for w in text.split()) >= 0.3 * n), -(dup >= 0.3 * len(lines)),
        -(repeat >= 0.3 * n), 1 if share >= 0.6 else -1 if share <= 0.2 else 0, 1 if common >= 0.05 else -1 if common < 0.02 else 0,
        -(text.count("!!") >= 0.05 * n), -(n < 2000 and len(set(words)) <= 0.15 * n),
    ]


def posteriors(cast, learned):
    """Expectation-maximisation document by document; ``learned`` says which documents count."""
    rate = [[list(map(float, row)) for row in side] for side in rules.BEGIN]
    good = 0.8

    def chance(row):
        odds = [1 - good, good]
        for side in (0, 1):
            for rule, vote in enumerate(row):
                odds[side] *= rate[side][rule][vote + 1]
        return odds[1] / sum(odds)

    for _ in range(100):
        mass = [[[rules.PULL * x for x in rule] for rule in side] for side in rules.BEGIN]
        total = 0.0
        for row, n in Counter(tuple(r) for r, use in zip(cast, learned, strict=True) if use).items():
            p = chance(row)
            total += n * p
            for rule, vote in enumerate(row):
                mass[1][rule][vote + 1] += n * p
                mass[0][rule][vote + 1] += n * (1 - p)
        rate = [[[x / sum(rule) for x in rule] for rule in side] for side in mass]
        for bad, fine in zip(*rate, strict=True):
            against = max(bad[0], fine[0])
            bad[1:] = [x * (1 - against) / (1 - bad[0]) for x in bad[1:]]
            bad[0] = against
        good = min(0.95, max(0.5, (total + 8) / (sum(learned) + 10)))
    return [chance(row) for row in cast]


def test_rule_verdicts(spark, sf_dir, docs):
    found = QUERIES["op2_quality_rules"](spark, sf_dir).collect()
    cast = [votes(docs[r.doc_id] or "") for r in found]
    failed = [brute.base_counts(docs[r.doc_id])[5] for r in found]
    wanted = posteriors(cast, [not f for f in failed])
    assert np.allclose([r.posterior for r in found], wanted, atol=1e-9)
    assert [r.kept for r in found] == [not f and p >= 0.5 for f, p in zip(failed, wanted, strict=True)]


# ------------------------------------------------------------ licences


def licence_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", brute.lower(text or ""))


def wordings(listed, rarity):
    """{label: share} with every template laid at every place."""
    out = {}
    for label, wording, phrases in licences.TEMPLATES:
        words, needed = licence_words(wording), [licence_words(p) for p in phrases]
        if not {w for p in needed for w in p} <= set(listed):
            continue
        total = sum(rarity[w] for w in words)
        for begin in range(1 - len(words), len(listed)):
            held = sum(rarity[w] for q, w in enumerate(words) if 0 <= begin + q < len(listed) and listed[begin + q] == w)
            near = listed[max(0, begin - 2) : begin + len(words) + 2]
            if held / total >= licences.LEAST and all(any(near[i : i + len(p)] == p for i in range(len(near))) for p in needed):
                out[label] = max(out.get(label, 0), held / total)
    return out


def test_licence_labels(spark, sf_dir, docs):
    split = {i: licence_words(t) for i, t in docs.items()}
    vocabulary = {w for _, wording, _ in licences.TEMPLATES for w in licence_words(wording)}
    holders = Counter(w for listed in split.values() for w in vocabulary.intersection(listed))
    rarity = {w: math.log((len(docs) + 1) / (holders[w] + 0.5)) for w in vocabulary}
    labelled = 0
    for r in QUERIES["op9_license_scan"](spark, sf_dir).collect():
        base = set(filter(None, r.base_labels.split(",")))
        wanted = wordings(split[r.doc_id], rarity)
        assert r.labels == ",".join(sorted(base | set(wanted)))
        assert math.isclose(r.score, 1.0 if base else min(1.0, max(wanted.values(), default=0.0)), abs_tol=1e-9)
        labelled += bool(wanted)
    assert labelled > 5


# ------------------------------------------------------------ language


def test_language_predictions(spark, sf_dir, docs):
    """A plain forward sum over each whole word, with no grouping, hashing or scaling."""
    ready(spark)
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = language.fit(table)
    number = {p: i for i, p in enumerate(model.vocabulary)}
    longest, none = max(map(len, number)), len(model.vocabulary)
    logs: dict[str, np.ndarray] = {}

    def whole(word):
        if word not in logs:
            spelled, sums = language.MARK + word, [np.ones(len(model.languages))]
            for j in range(1, len(spelled) + 1):
                total = np.zeros(len(model.languages))
                for k in range(1, min(j, longest) + 1):
                    piece = number.get(spelled[j - k : j], none if k == 1 else None)
                    if piece is not None:
                        total += sums[j - k] * model.chances[piece]
                sums.append(total)
            logs[word] = np.log(sums[-1])
        return logs[word]

    found = {r.doc_id: r for r in language.predict(table, model).collect()}
    for doc, text in sorted(docs.items())[:300]:
        words = regex.findall(r"\p{L}+", (text or "").lower())
        if not words:
            assert (found[doc].lang_pred, found[doc].score) == ("und", 0.0)
            continue
        total = sum(map(whole, words))
        share = np.exp(total - total.max()) / np.exp(total - total.max()).sum()
        assert found[doc].lang_pred == model.languages[int(share.argmax())]
        assert math.isclose(found[doc].score, share.max(), rel_tol=1e-6)


# ------------------------------------------------------------ quality classifier


def test_classifier_scores(spark, sf_dir, docs):
    """Samples, dictionaries, curve and scores again, from lists in one process."""
    import zstandard

    marks = [(r.doc_id, r.quality) for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect() if r.quality in (0, 1)]

    def sample(third, quality, size):
        ids = [d for d, q in marks if q == quality and zlib.crc32(str(d).encode()) % 3 == third]
        return [docs[d] or "" for d in sorted(ids, key=lambda d: (id_hash(d), d))[:size] if d in docs]

    def cut(text):
        raw = text.encode()
        return [raw[i : i + 4096] for i in range(0, len(raw), 4096)]

    dictionaries = {}
    for quality in (1, 0):
        listed = sorted((b for t in sample(0, quality, 2000) for b in cut(t)), key=lambda b: (signed(xxh64_intdigest(b, 42)), b))[:6000]
        dictionaries[quality] = zstandard.train_dictionary(compression.DICTIONARY, listed, level=3).as_bytes()

    def size(quality, block):
        kept = zstandard.ZstdCompressionDict(dictionaries[quality])
        return len(zstandard.ZstdCompressor(level=3, dict_data=kept, write_content_size=False, write_dict_id=False).compress(block))

    def feature(text):
        return sum(size(0, b) - size(1, b) for b in cut(text)) / len(text.encode()) if text else 0.0

    curve = [(q, feature(t)) for q in (0, 1) for t in sample(2, q, 4000)]
    of_label = Counter(q for d, q in marks if zlib.crc32(str(d).encode()) % 3 == 2)
    drawn = Counter(q for q, _ in curve)
    weights = np.array([of_label[q] / drawn[q] for q, _ in curve])
    x, y, w = np.array([f for _, f in curve]), np.array([q for q, _ in curve], float), weights / weights.mean()
    a = b = 0.0
    for _ in range(100):  # Newton's method on the weighted likelihood, written out
        p = 1 / (1 + np.exp(-(a + b * x)))
        g = np.array([(w * (y - p)).sum() - 1e-6 * a, (w * (y - p) * x).sum() - 1e-6 * b])
        v = w * p * (1 - p)
        h = np.array([[v.sum() + 1e-6, (v * x).sum()], [(v * x).sum(), (v * x * x).sum() + 1e-6]])
        step = np.clip(np.linalg.solve(h, g), -50, 50)
        a, b = a + step[0], b + step[1]
    for r in QUERIES["op5_quality_classifier"](spark, sf_dir).collect():
        if r.doc_id % 5 == 0:
            score = 1 / (1 + math.exp(-max(-500.0, min(500.0, a + b * feature(docs[r.doc_id] or "")))))
            assert math.isclose(r.score, score, rel_tol=1e-3, abs_tol=1e-6) and r.predicted == int(r.score >= 0.5)
