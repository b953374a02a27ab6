"""The queries over whole tables against plain-Python versions, public libraries, SQL or held-out labels."""

import hashlib
import os
import sys
import zlib
from collections import defaultdict

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import brute  # noqa: E402
import compare  # noqa: E402

from hushlake.llm import licences  # noqa: E402
from hushlake.llm.common import tokenizer_path  # noqa: E402
from hushlake.llm.queries import QUERIES, TWINS  # noqa: E402


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}


@pytest.fixture(scope="module")
def labels(spark, sf_dir):
    return {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}


def rows(spark, sf_dir, name):
    return QUERIES[name](spark, sf_dir).collect()


def test_every_operator_has_a_query():
    assert [n.split("_")[0] for n in QUERIES] == [f"op{i}" for i in range(1, 14)]


def test_simhash(spark, sf_dir, docs):
    found = {tuple(r) for r in rows(spark, sf_dir, "op1_simhash_dedup")}
    assert found == set(brute.simhash(list(docs.items())))


def test_rules(spark, sf_dir, docs, labels):
    found = rows(spark, sf_dir, "op2_quality_rules")
    assert len(found) == len(docs)
    for r in found:
        assert tuple(r)[1:7] == brute.base_counts(docs[r.doc_id])
        assert not (r.base_failed and r.kept)
    judged = [(r.kept, labels[r.doc_id] == 1) for r in found if r.doc_id in labels and not r.base_failed]
    assert np.mean([a == b for a, b in judged]) > 0.97
    assert all(kept for kept, good in judged if good)


def test_language(spark, sf_dir):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    found = rows(spark, sf_dir, "op3_language_id")
    held = [r for r in found if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert [r for r in found if r.held_out] == held and len(found) == len(lang)
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in held]) > 0.99
    assert all(0 <= r.score <= 1 for r in found)


def test_bpe(spark, sf_dir, docs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    found = rows(spark, sf_dir, "op4_bpe_automaton")
    assert len(found) == len(docs)
    for r in found:
        ids = library.encode(docs[r.doc_id] or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        decoded = library.decode(ids, skip_special_tokens=False)
        assert r.decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()


def test_classifier(spark, sf_dir, labels):
    found = rows(spark, sf_dir, "op5_quality_classifier")
    held = [r for r in found if r.held_out and r.doc_id in labels]
    assert np.mean([r.predicted == labels[r.doc_id] for r in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in found)


@pytest.mark.parametrize("name", sorted(TWINS))
def test_sql(spark, sf_dir, name):
    con = compare.connect(sf_dir)
    cursor = con.execute(TWINS[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(map(repr, cursor.fetchall())) == sorted(repr(tuple(r)) for r in QUERIES[name](spark, sf_dir).select(*columns).collect())


def test_exact_dedup_stays_in_the_jvm(spark, sf_dir):
    plan = QUERIES["op6_exact_dedup"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "CartesianProduct", "NestedLoop"))


def test_html(spark, sf_dir):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    found = rows(spark, sf_dir, "op7_html_extraction")
    assert {r.page_id: r.text for r in found} == {k: brute.main_text(v) for k, v in pages.items()}
    assert all(r.n_chars == len(r.text) for r in found)


def test_lines(spark, sf_dir, docs):
    listed = sorted(docs.items())
    found = {r.doc_id: r.dropped for r in rows(spark, sf_dir, "op8_line_dedup")}
    wanted = [",".join(map(str, x)) for x in brute.dropped_lines(listed)]
    assert found == dict(zip((d for d, _ in listed), wanted, strict=True))


def test_licences(spark, sf_dir, docs):
    found = rows(spark, sf_dir, "op9_license_scan")
    assert len(found) == len(docs)
    for r in found:
        assert tuple(r)[1:6] == brute.licences(docs[r.doc_id], licences.BASE)
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
        assert ("gpl-3" in r.labels) == ("GNU General Public License, version 3" in docs[r.doc_id])


def packed_well(pieces, docs, size=1024):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    of_doc, of_sequence = defaultdict(list), defaultdict(list)
    for r in pieces:
        of_doc[r.doc_id].append(r)
        of_sequence[r.sequence_id].append((r.offset, r.length))
    assert set(of_doc) == set(docs)
    for doc, text in docs.items():
        ids, at = [*library.encode(text or "", add_special_tokens=False).ids, 0], 0
        for r in sorted(of_doc[doc], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids))
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    assert sorted(of_sequence) == list(range(len(of_sequence)))
    for number, held in of_sequence.items():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at == size or number == len(of_sequence) - 1


def test_packing(spark, sf_dir, docs):
    packed_well(rows(spark, sf_dir, "op10_packing"), docs)


def test_pipeline(spark, sf_dir, docs, labels):
    import corpus_pipeline

    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "language_id", "quality_classifier", "exact_dedup", "simhash_dedup", "packing",
    ]
    from hushlake.llm.common import written

    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, left = table.columns, dict(docs)
    for name, stage in corpus_pipeline.STAGES[:4]:
        table = written(stage(spark, table, sf_dir), name)
        assert table.columns == columns
        kept = {r.doc_id: r.text for r in table.collect()}
        assert len(kept) == table.count() and all(left[k] == v for k, v in kept.items())
        before = sorted(left.items())
        if name == "language_id":
            predicted = {r.doc_id: r for r in rows(spark, sf_dir, "op3_language_id")}
            assert set(kept) == {k for k in left if predicted[k].lang_pred != "und" and predicted[k].score >= 0.5}
        if name == "quality_classifier":
            good = [k for k in left if labels.get(k) == 1]
            assert np.mean([k in kept for k in good]) > 0.98
            assert np.mean([k not in kept for k in left if labels.get(k) == 0]) > 0.8
        if name == "exact_dedup":
            assert set(kept) == {k for (k, _), stays in zip(before, brute.exact(before), strict=True) if stays}
        if name == "simhash_dedup":
            assert set(kept) == {k for k, _, component in brute.simhash(before) if k == component}
        left = kept
    pieces = written(corpus_pipeline.STAGES[4][1](spark, table, sf_dir), "packing").collect()
    packed_well(pieces, left)


def test_pipeline_runs_as_a_whole(spark, sf_dir):
    import corpus_pipeline

    small = os.path.join(os.path.dirname(sf_dir), "sf0.001")
    pieces = corpus_pipeline.run(spark, small)
    assert pieces.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    kept = {r.doc_id for r in pieces.collect()}
    assert 100 < len(kept) < spark.read.parquet(f"{small}/documents.parquet").count()
