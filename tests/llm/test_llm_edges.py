"""Nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns, hot groups."""

import math
import os
import random
import re
import sys
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import brute  # noqa: E402
from measure import shuffled  # noqa: E402

from hushlake.llm import compression, exact, html_text, language, licences, lines, packing, rules, simhash, tokenization  # noqa: E402
from hushlake.llm.common import ready, tokenizer_path, written  # noqa: E402
from hushlake.llm.components import components  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, `key` string, fp long, row int, kept boolean, _key int"
LONG = "word and more " * 40_000
TEXTS = [
    (1, "The cat sat on the mat and looked at the dog. " * 8),
    (1, "The cat sat on the mat and looked at the dog. " * 8),  # a repeated row
    (2, "The cat sat on the mat and looked at the dog. " * 8),
    (3, None), (4, ""), (5, " \t\n\r\x0b\x0c "), (None, None), (None, "x"), (6, " "),
    (7, "thecatsat"), (8, "the cat sat"), (9, "the  cat sat"), (10, LONG), (11, "12 34 !!"),
    (12, "\U0001f4a9 ÉÉ ퟿\n\nline\nline \n LINE"), (-13, "Released under the MIT License."),
]


@pytest.fixture(scope="module")
def odd(spark):
    ready(spark)
    rows = [(i, t, "en" if i and i % 2 else None, "s", 1, "k", 5, 6, True, 7) for i, t in TEXTS]
    return written(spark.createDataFrame(rows, SCHEMA), "odd")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 0), (3, None, 0), (None, 1, 1), (99, 1, 0), (1, 0, 0)], "doc_id long, quality int, toxic int")


def operators(docs, labels):
    return {
        "simhash": lambda: simhash.near_duplicates(docs),
        "rules": lambda: rules.judge(docs),
        "language": lambda: language.predict(docs, language.fit(docs)),
        "bpe": lambda: tokenization.encode(docs),
        "classifier": lambda: compression.score(docs, compression.fit(docs, labels)),
        "exact": lambda: exact.exact_duplicates(docs),
        "lines": lambda: lines.judge(docs),
        "licences": lambda: licences.scan(docs),
    }


NAMES = ["simhash", "rules", "language", "bpe", "classifier", "exact", "lines", "licences"]


@pytest.mark.parametrize("name", NAMES)
def test_a_row_for_each_row(odd, labels, name):
    found = operators(odd, labels)[name]().select("doc_id").collect()
    assert sorted(map(str, (r[0] for r in found))) == sorted(str(i) for i, _ in TEXTS)


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(odd, labels, name):
    none = odd.filter("doc_id > 1000")
    assert operators(none, labels.filter("doc_id > 1000"))[name]().count() == 0


@pytest.mark.parametrize("empty", [False, True])
def test_stages_keep_columns(spark, odd, tmp_path, empty):
    import corpus_pipeline

    odd.limit(0).select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic")).write.parquet(f"{tmp_path}/labels.parquet")
    docs = odd.limit(0) if empty else odd
    for name, stage in corpus_pipeline.STAGES[:4]:
        after = written(stage(spark, docs, str(tmp_path)), name)
        assert after.columns == odd.columns and (after.count() == 0) == empty
        docs = after
    pieces = corpus_pipeline.STAGES[4][1](spark, docs, str(tmp_path))
    assert pieces.select("doc_id").distinct().count() == docs.count()


def test_simhash_values(odd):
    found = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(odd).select(
        "doc_id", simhash.hexadecimal("fp").alias("fingerprint"), "component_id").collect()), key=repr)
    assert found == sorted(brute.simhash(TEXTS), key=repr)


def test_covering_masks_hide_every_difference():
    listed = simhash.masks()
    assert len(listed) == 15
    rng = random.Random(0)
    for _ in range(3000):
        difference = sum(1 << b for b in rng.sample(range(64), 3))
        assert any(m & difference == 0 for m in listed)


@pytest.mark.parametrize("block", [7, 2048])
def test_simhash_of_a_hot_ball(spark, block):
    """Many fingerprints within a few bits: buckets over the block size are dealt out and lose no link."""
    rng = random.Random(1)
    prints = {rng.getrandbits(64) for _ in range(50)}
    centre = rng.getrandbits(64)
    prints |= {centre ^ sum(1 << b for b in rng.sample(range(24), rng.randint(0, 6))) for _ in range(300)}
    listed = sorted(simhash._signed(p) for p in prints)
    frame = written(spark.createDataFrame([(p,) for p in listed], "fp long"), "ball")
    found = {r.node: r.root for r in components(simhash.links(frame, block=block)).collect()}
    values, parts = np.array(listed, np.int64).view(np.uint64), brute.Union(len(listed))
    for i in range(len(listed)):
        for j in np.flatnonzero(np.bitwise_count(values[i + 1 :] ^ values[i]) <= 3):
            parts.join(i, i + 1 + int(j))
    assert {p: found.get(p, p) for p in listed} == {p: listed[parts.find(i)] for i, p in enumerate(listed)}


def test_components_of_long_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5000, 5000)]
    found = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(301)}, **{1000 + i: 1000 for i in range(200)}, 5000: 5000}


@pytest.mark.parametrize("seed", range(3))
def test_components_of_random_graphs(spark, seed):
    """Sparse graphs of numbers and of digests, with loops and repeated edges, against one union-find."""
    rng = random.Random(seed)
    edges = [(rng.randint(0, 900), rng.randint(0, 900)) for _ in range(rng.choice([200, 450, 900]))] * 2
    parts = brute.Union(901)
    for a, b in edges:
        parts.join(a, b)
    wanted = {x: parts.find(x) for e in edges for x in e}
    assert {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()} == wanted
    name = lambda x: f"{x:04}".encode()
    named = components(spark.createDataFrame([(name(a), name(b)) for a, b in edges], "a binary, b binary")).collect()
    assert {int(r.node): int(r.root) for r in named} == wanted
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("capacity", [64, 1000, 64 << 20])
def test_exact_keeps_one_row_of_each_group(odd, capacity):
    """Small buckets split, and a group larger than a bucket gets overflow pages."""
    found = exact.exact_duplicates(odd, capacity, 8)
    kept = sorted(str(r.doc_id) for r in found.filter("kept").collect())
    wanted = sorted(str(i) for (i, _), stays in zip(TEXTS, brute.exact(TEXTS), strict=True) if stays)
    assert kept == wanted
    assert {r.group_size for r in found.filter("keep_id = 5").collect()} == {4}
    rows = exact.keep_one(odd, capacity).collect()
    assert sorted(str(r.doc_id) for r in rows) == wanted


def test_directory_doubles_and_pages(spark):
    listed = spark.range(4000).select(F.xxhash64("id").alias("key"), F.lit(100).cast("long").alias("n_bytes"))
    hot = spark.range(2000).select(F.xxhash64(F.lit(-1).cast("long")).alias("key"), F.lit(100).cast("long").alias("n_bytes"))
    buckets = exact.directory(listed.union(hot), 10_000, 10)
    laid, owners = exact.owners(buckets, 10_000)
    spans = sorted((first, first + (1 << (10 - depth))) for first, depth, _ in buckets)
    assert spans[0][0] == 0 and spans[-1][1] == 1024 and all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))
    assert max(pages for *_, pages in laid) >= 26 and owners < 200


def test_language_values(odd):
    model = language.fit(odd)
    found = {r.doc_id: r for r in language.predict(odd, model).filter("doc_id IS NOT NULL").collect()}
    assert model.languages == ["en"]
    assert all((found[i].lang_pred, found[i].score) == ("und", 0.0) for i in (3, 4, 5, 6, 11))
    assert found[10].lang_pred == "en"


def test_forward_sums_all_segmentations():
    vocabulary = ["a", "b", "ab", "ba", language.MARK, language.MARK + "a"]
    chances = np.array([[0.1, 0.3], [0.2, 0.1], [0.15, 0.05], [0.05, 0.1], [0.2, 0.2], [0.1, 0.05], [0.01, 0.02]])
    lattice = language.Lattice(vocabulary)
    number = {p: i for i, p in enumerate(vocabulary)}

    def total(rest: str, lang: int) -> float:
        if not rest:
            return 1.0
        out = 0.0
        for k in range(1, len(rest) + 1):
            piece = number.get(rest[:k], len(vocabulary) if k == 1 else None)
            if piece is not None:
                out += chances[piece, lang] * total(rest[k:], lang)
        return out

    group = ["abab", "bbba", "axxb"]
    arcs = lattice.arcs(group)
    found = language.forward(arcs, chances)[-1]
    assert np.allclose(found, [[total(language.MARK + w, lang) for lang in (0, 1)] for w in group])
    counts = language.expected(arcs, chances[:, :1], np.ones(3))
    sizes = np.array([1, 1, 2, 2, 1, 2, 1])
    assert np.isclose((counts * sizes).sum(), 15)  # the pieces expected cover every character once


def test_long_words_are_summed_whole():
    """One word by itself gives what many at once give, and what exact fractions give at any length."""
    from fractions import Fraction

    rng = np.random.default_rng(1)
    vocabulary = ["a", "b", "ab", "ba", "aab", "abbab", language.MARK, language.MARK + "ab"]
    chances = rng.random((len(vocabulary) + 1, 2)) * [1, 1e-4]
    lattice, number = language.Lattice(vocabulary), {p: i for i, p in enumerate(vocabulary)}
    words = ["".join(random.Random(i).choices("abx", k=n)) for i, n in enumerate((1, 2, 7, 24, 25, 26, 90, 400))]
    for word in words:
        whole, exact = language.MARK + word, []
        for lang in (0, 1):
            sums = [Fraction(1)]
            for j in range(1, len(whole) + 1):
                arcs = ((k, number.get(whole[j - k : j], len(vocabulary) if k == 1 else None)) for k in range(1, min(j, 5) + 1))
                sums.append(sum(sums[j - k] * Fraction(chances[p, lang]) for k, p in arcs if p is not None))
            exact.append(math.log(sums[-1].numerator) - math.log(sums[-1].denominator))
        sums, scale = language.forward_of_one(lattice.arcs_of_one(word), chances)
        assert np.allclose(np.log(sums[-1]) + scale[-1], exact, rtol=1e-12)
        own = language.expected_of_one(lattice.arcs_of_one(word), chances[:, [1]], 3.0)
        lengths = np.array([*map(len, vocabulary), 1])
        assert np.isclose((own * lengths).sum(), 3 * len(whole))
        if len(word) <= 90:
            many = lattice.arcs([word] * 2)
            assert np.allclose(np.log(language.forward(many, chances)[-1][0, 0]), exact[0], rtol=1e-12)
            if len(word) <= 26:
                assert np.allclose(language.expected(many, chances[:, [1]], np.array([1.0, 2.0])), own)


def test_all_pieces_of_letters_are_used():
    listed = language.pieces()
    assert max(map(len, listed)) == 16 and sum(len(p) > 8 for p in listed) > 2_500


def test_sample_of_a_hot_language(spark):
    """The first ids in order of hash, whatever the number of documents of a language."""
    ready(spark)
    docs = spark.range(6000).selectExpr("id AS doc_id", "string(id) AS text", "if(id % 3 = 0, 'rare', 'hot') AS lang")
    found = language.sample(docs, 40).collect()
    plan = docs.filter("crc32(cast(string(doc_id) AS binary)) % 3 <> 1")
    order = plan.withColumn("h", F.expr("shiftrightunsigned(xxhash64(doc_id), 11)")).orderBy("h").collect()
    wanted = {lang: {r.text for r in [r for r in order if r.lang == lang][:40]} for lang in ("rare", "hot")}
    assert {lang: {r.text for r in found if r.lang == lang} for lang in wanted} == wanted


def test_bpe_on_random_words():
    from tokenizers import Tokenizer

    own, library = tokenization.Tokenizer(tokenizer_path("word_bpe_49k.json")), Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    rng = random.Random(2)
    letters = "aaabbcdehinortsTHE \n'.!?1é<|>ß\U0001f4a9Σİ՘Ᲊ"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    texts += ["a" * 500, "<|endoftext|>x<|startoftext|>", "aaaa" * 9 + "ing", "Á é"]
    for text in texts:
        ids, decoded = own.encode(text)
        wanted = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == wanted
        assert decoded == library.decode(wanted, skip_special_tokens=False)


def same_as_library(own, library, text):
    ids, decoded = own.encode(text)
    wanted = library.encode(text, add_special_tokens=False).ids
    return np.frombuffer(ids, "<u4").tolist() == wanted and decoded == library.decode(wanted, skip_special_tokens=False)


@pytest.fixture(scope="module")
def word_bpe():
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    return tokenization.Tokenizer(path), Tokenizer.from_file(path)


def test_bpe_of_every_character(word_bpe):
    """Each code point between letters, digits, blanks and marks; those that tables agree on apart from the others."""
    own, library = word_bpe
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    agreed = [c for c in points if ord(c) < 0x378 or not tokenization.Agreed().lacks(c)]
    for listed in (agreed, sorted(set(points) - set(agreed))):
        for at in range(0, len(listed), 2048):
            assert same_as_library(own, library, "".join(f"a{c}b 1{c}. {c} {c}{c}" for c in listed[at : at + 2048]))
    assert 60_000 < len(agreed) < len(points) / 2


def test_bpe_of_all_pairs_of_combining_marks(word_bpe):
    import unicodedata

    own, library = word_bpe
    marks = [chr(c) for c in range(0x110000) if unicodedata.combining(chr(c))]
    agreed = [c for c in marks if ord(c) < 0x378 or not tokenization.Agreed().lacks(c)]
    others = [c for c in marks if c not in set(agreed)]
    assert len(agreed) > 200 and len(others) > 400
    for first in marks:
        for listed in (agreed, others):
            assert same_as_library(own, library, "".join(f"e{first}{second} " for second in listed))


def test_a_machine_that_forgets(word_bpe, monkeypatch):
    """Few states and arcs kept: they are made again, and nothing changes."""
    own, library = word_bpe
    rng = random.Random(8)
    texts = [" ".join("".join(rng.choice("etaoinsrhld") for _ in range(rng.randint(1, 15))) for _ in range(50)) for _ in range(30)]
    assert own.machine.automaton.n_states > 48_000
    monkeypatch.setattr(tokenization, "STATES", 50)
    monkeypatch.setattr(tokenization, "ARCS", 10)
    monkeypatch.setattr(tokenization, "MEMO", 7)
    assert all(same_as_library(own, library, text) for text in texts)


def test_automaton_of_repeats():
    """Merges of equal halves: runs are cut from the left."""
    vocabulary = {"a": 0, "b": 1, "aa": 2, "aab": 3, "aaaa": 4}
    own = tokenization.Automaton(vocabulary, [("a", "a"), ("aa", "b"), ("aa", "aa")])
    names = {v: k for k, v in vocabulary.items()}
    cut = lambda s: [names[i] for i in own.path(list(s))]
    assert cut("aaa") == ["aa", "a"] and cut("aaaaa") == ["aaaa", "a"]
    assert cut("aaaab") == ["aa", "aab"] and cut("aaab") == ["aa", "a", "b"]


def test_byte_bpe_equals_the_library():
    from tokenizers import Tokenizer

    library, own = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json")), packing.text_encoder(tokenizer_path("byte_bpe_50k.tiktoken"))
    rng = random.Random(4)
    letters = "aabcdehinorts THE \n\t'.!?12é<|>ß\U0001f4a9　\x1c\x85"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    for text in [*texts, "<|endoftext|>", "a<|endoftext|> b<|endoftext|>", " " * 300, "x" * 5000]:
        assert np.frombuffer(own(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_byte_bpe_of_every_character():
    """Each code point between letters, digits, blanks and marks, many to a text."""
    from tokenizers import Tokenizer

    library, own = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json")), packing.text_encoder(tokenizer_path("byte_bpe_50k.tiktoken"))
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(points), 1024):
        text = "".join(f"a{chr(c)}1{chr(c)}. {chr(c)} {chr(c)}{chr(c)}" for c in points[at : at + 1024])
        assert np.frombuffer(own(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_ids_over_16_bits_are_kept(spark):
    """An end mark that takes 17 bits, beside ids that take fewer."""
    docs = spark.createDataFrame([(1, "a b"), (2, "")], "doc_id long, text string")
    pieces = {(r.doc_id, r.start): r for r in packing.pack(docs, 2, end=70_000).collect()}
    ids = {doc: sum((np.frombuffer(r.ids, "<u4").tolist() for (d, _), r in sorted(pieces.items()) if d == doc), []) for doc in (1, 2)}
    assert ids == {1: [64, 275, 70_000], 2: [70_000]}


def test_packing_of_odd_rows(odd):
    pieces = packing.pack(odd, size=64).collect()
    assert sum(r.length for r in pieces) == sum({(r.doc_id, r.start, r.sequence_id, r.offset): r.length for r in pieces}.values())
    places = sorted((r.sequence_id * 64 + r.offset, r.length) for r in pieces)
    assert places[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(places, places[1:], strict=False))
    assert {r.doc_tokens for r in pieces if r.doc_id in (3, 4)} == {1}
    assert all(len(r.ids) == 4 * r.length for r in pieces)


def test_pipeline_gives_token_ids(spark, odd, tmp_path, monkeypatch):
    """The last stage writes the ids themselves, in the order of the one long stream; the query has their digests."""
    import corpus_pipeline
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    wanted = sorted([*library.encode(text or "", add_special_tokens=False).ids, packing.END] for _, text in TEXTS)
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(corpus_pipeline, "STAGES", corpus_pipeline.STAGES[4:])
    pieces = sorted(corpus_pipeline.packed(spark, str(tmp_path)).collect(), key=lambda r: (r.sequence_id, r.offset))
    docs: list[list[int]] = []
    for r in pieces:
        if r.start == 0:
            docs.append([])
        docs[-1] += np.frombuffer(r.ids, "<u4").tolist()
        assert len(r.ids) == 4 * r.length and r.ids_crc32 == zlib.crc32(r.ids)
    assert sorted(docs) == wanted
    assert corpus_pipeline.run(spark, str(tmp_path)).columns == [c for c in pieces[0].asDict() if c != "ids"]


def test_classifier_without_labels(odd, labels):
    model = compression.fit(odd, labels.filter("quality = 5"))
    assert {(r.score, r.predicted) for r in compression.score(odd, model).collect()} == {(0.5, 1)}


def test_rules_without_text(odd):
    found = {r.doc_id: r for r in rules.judge(odd).filter("doc_id IN (3, 4, 5)").collect()}
    assert all((r.n_words, r.kept, r.base_failed) == (0, False, True) for r in found.values())


def test_expectation_finds_the_defect_rules():
    rng = np.random.default_rng(5)
    good = rng.random(20_000) < 0.8
    votes = np.zeros((20_000, len(rules.RULES)), int)
    votes[:, 0] = np.where(~good & (rng.random(20_000) < 0.7), -1, 0)
    votes[:, 6] = np.where(good ^ (rng.random(20_000) < 0.1), 1, -1)
    votes[:, 5] = np.where(good ^ (rng.random(20_000) < 0.2), 1, -1)
    patterns, counts = np.unique(((votes + 1) * 3 ** np.arange(len(rules.RULES))).sum(1), return_counts=True)
    model = rules.fit(patterns, counts.astype(float))
    every = model.posterior(((votes + 1) * 3 ** np.arange(len(rules.RULES))).sum(1))
    assert abs(model.good - 0.8) < 0.03 and np.mean((every >= 0.5) == good) > 0.93


PAGE = """<!doctype html><html><head><title>T</title><style>p{}</style></head><body>
<header><a href="/">Site</a></header><nav><ul><li><a href="/a">Menu</a></ul></nav>
<div class="cookie-notice">We use cookies</div><aside><p>Side text that is quite long, longer than the article.</p></aside>
<div class="story-12"><h1>Title &amp; more</h1><p>First  part <b>bold<br>line</b> &eacute;&nbsp;x<p>Second <a href="/x">link</a>
<form><p>Form</p><input></form><div class="ad">Buy!</div><script>var t = "</p>" + '<p>no</p>'</script>
<ul><li>One<li>Two</ul><table><tr><td>A<td>B</table><pre> a
 b </pre></div>
<div id="comments"><p>I disagree with all of this, at great length, as readers do in comments, again and again.</p></div>
<footer>Foot</footer></body></html>"""


def test_html_values(spark):
    text = "Title & more\nFirst part bold line é x\nSecond link\nOne\nTwo\nA\nB\na b"
    hosts = [f"https://u@Host{i}.example.com:80/p" for i in (1, 1, 1, 2)]
    listed = [(i, u, PAGE.replace("story-12", f"story-{i}"), 1) for i, u in enumerate(hosts)]
    odd = [(10, None, None), (11, "", ""), (12, "x", "plain & text"), (13, hosts[0], "<p>a<p>b"), (None, hosts[0], "<div"),
           (14, "http://h/", "<b>" * 5000 + "deep"), (15, "http://h/", '<div title="' + "<p>x" * 2000)]
    pages = spark.createDataFrame(listed + [(*r, 1) for r in odd], "page_id long, url string, html string, path int")
    found = {r.page_id: r for r in html_text.extract(pages).collect()}
    assert len(found) == len(listed) + len(odd)
    assert all(found[i].text == text for i in range(4))
    assert (found[10].text, found[11].text, found[12].text, found[13].text) == ("", "", "plain & text", "a\nb")
    assert found[14].text == "deep" and found[None].text == ""
    assert html_text.extract(pages.limit(0)).count() == 0


def test_votes_of_a_host_decide(spark):
    """A page whose side text is longer than its article follows the other pages of its host."""
    def page(body, side):
        return f"<body><div class='main'><p>{body}</p></div><div class='box'><p>{side}</p></div></body>"

    rows = [(i, "http://a.org/", page("long text " * 30, "short")) for i in range(5)] + [(9, "http://a.org/", page("tiny", "very long " * 50))]
    found = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert found[9] == "tiny"


def plain(html):
    return html_text.extracted(html_text.parse(html), None)


def test_headline_and_lead_beside_the_body():
    post = "<div class=post><h1>Title</h1><p class=lead>The lead.</p><div class=entry><p>First part, long.</p><p>Second part, long.</p></div></div>"
    whole = "Title\nThe lead.\nFirst part, long.\nSecond part, long."
    assert plain(f"<body>{post}</body>") == whole
    links = "<div class=x>" + "<a href=/>Elsewhere on this site</a> " * 9 + "</div>"
    assert plain(f"<body>{links}{post}{links}</body>") == whole
    # A wrapper with more text in other containers, or with links for the most part, is not climbed to.
    column = "<div class=y><p>" + "Words of another column. " * 9 + "</p></div>"
    long = "<div class=entry><p>" + "The body of it. " * 30 + "</p></div>"
    assert plain(f"<body><div class=w>{links}Go: {long}</div></body>") == ("The body of it. " * 30).strip()
    assert "another" not in plain(f"<body><div class=w>{column}{column}<p>x</p>{long}</div></body>")


def test_names_within_an_article_need_two_signs():
    inside = "<article><h1>T</h1><p>Text.</p>{}</article>"
    kept = '<div class="related-work"><p>Others did this.</p></div><div class="notice-period"><p>Two weeks.</p></div><div class="header-image">A view.</div>'
    assert plain(inside.format(kept)) == "T\nText.\nOthers did this.\nTwo weeks.\nA view."
    gone = '<div class="related-links"><a href=/>One</a> <a href=/>Two</a></div><div class="related">More</div><div class="comment-list"><p>I disagree.</p></div>'
    assert plain(inside.format(gone + '<div class="share-bar"><a href=/>Share</a></div><div class="ad-slot">Buy</div>')) == "T\nText."
    nested = '<div class="side-note"><div class="side-note"><a href=/>In</a></div><p>A note with words.</p></div>'
    assert plain(inside.format(nested)) == "T\nText.\nA note with words."


def test_a_rarer_template_of_a_host(spark):
    """A page with a teaser at the winning path and its article at another path that a fifth of the pages use."""
    story = "<body><div class='story'><p>{}</p></div></body>"
    review = "<body><div class='story'><p>Teaser {}</p></div><div class='review'><p>{}</p></div></body>"
    rows = [(i, "http://a.org/", story.format(f"story {i} " * 30)) for i in range(7)]
    rows += [(10 + i, "http://a.org/", review.format(i, f"review {i} " * 30)) for i in range(3)]
    rows += [(20, "http://b.org/", "<div class=b><p>one</p></div>"), (20, "http://b.org/", "<div class=b><p>one</p></div>")]
    rows += [(30, "http://c.org/", "<div class=y><p>a</p></div>"), (31, "http://c.org/", "<div class=x><p>b</p></div>")]  # a tie of votes
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = sorted((r.page_id, r.text) for r in html_text.extract(frame).collect())
    assert found[:7] == [(i, (f"story {i} " * 30).strip()) for i in range(7)]
    assert found[7:10] == [(10 + i, (f"review {i} " * 30).strip()) for i in range(3)]
    assert found[10:] == [(20, "one"), (20, "one"), (30, "a"), (31, "b")]
    paths = {r.host: r.paths for r in html_text.winning_paths(frame).collect()}
    assert paths == {"a.org": ["body>div.story", "body>div.review"], "b.org": ["div.b"], "c.org": ["div.x", "div.y"]}


def test_deep_pages_take_little_memory():
    import tracemalloc

    deep = "<div class=a>" * 100_000 + "<p>text</p>"
    tracemalloc.start()
    assert html_text.extracted(html_text.parse(deep), ["div.a"]) == "text"
    assert plain(deep) == "text"
    assert tracemalloc.get_traced_memory()[1] < 200 << 20
    tracemalloc.stop()


def test_licence_values(spark):
    texts = {
        1: "x Under the MIT-License, under\nthe mit license", 2: "Apache License, Version 2.0", 3: "cc-by-nc cc by nc",
        4: "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
           "files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, "
           "copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        5: "This work is licensed under the GNU General Public License, version 3.", 6: "the license of the public software copy",
        7: "under the mit élicense", 8: None,
    }
    found = {r.doc_id: r for r in licences.scan(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    for i, text in texts.items():
        assert tuple(found[i])[1:6] == brute.licences(text, licences.BASE)
    assert [found[i].labels for i in range(1, 9)] == ["mit", "apache-2", "cc-by-nc", "mit", "gpl-3", "", "", ""]
    assert found[6].score == 0 and found[4].score > 0.9


def test_licences_beside_others(spark):
    """A file with a full wording, whose words are rarer, still shows every other licence it holds."""
    common = [(-i, "licensed under the gnu general public license version 3 or any other") for i in range(1, 60)]
    whole = [text for label, text, _ in licences.TEMPLATES if label in ("mit", "bsd")]
    texts, wanted = [], {}
    for first in [whole[1], whole[2]]:
        held = next(label for label, text, _ in licences.TEMPLATES if text == first)
        for label, text, _ in licences.TEMPLATES:
            texts.append((len(texts), f"{first}. Parts: {text}."))
            wanted[len(texts) - 1] = {held, label}
    texts.append((len(texts), ".\n".join(text for _, text, _ in licences.TEMPLATES)))
    wanted[len(texts) - 1] = {label for label, _, _ in licences.TEMPLATES}
    found = licences.scan(spark.createDataFrame(texts + common, "doc_id long, text string")).filter("doc_id >= 0").collect()
    assert {r.doc_id: set(r.labels.split(",")) for r in found} == wanted


def test_near_lines(spark):
    base = "the quick brown fox jumps over the lazy dog while the other animals of the forest look on in wonder and say nothing at all"
    rng = random.Random(7)
    near = [base[: k] + rng.choice("XYZ") + base[k + 1 :] for k in range(0, len(base), 2)]
    rows = [(i, f"own line number {i * 7919} of this text\n\n{line}\n{base.upper()}") for i, line in enumerate(near)]
    rows += [(None, base), (500, None), (501, "\n \n"), (502, "short"), (502, "short"), (503, "SHORT \n shorter")]
    frame = written(spark.createDataFrame(rows, "doc_id long, text string"), "near").coalesce(1)
    listed = [(r.doc_id, r.text) for r in frame.collect()]
    wanted = sorted((str(d), x) for (d, _), x in zip(listed, brute.dropped_lines(listed), strict=True))
    for block in (8, 512):
        assert sorted((str(r.doc_id), r.dropped) for r in lines.judge(frame, block).collect()) == wanted
    texts = sorted((str(r.doc_id), r.text or "") for r in lines.deduplicate(frame).collect())
    numbered = [(str(d), (t or "").split("\n"), x) for (d, t), x in zip(listed, brute.dropped_lines(listed), strict=True)]
    assert texts == sorted((d, "\n".join(line for n, line in enumerate(t) if n not in x)) for d, t, x in numbered)


def test_band_keys_travel_in_few_bytes(spark):
    """Of 24 keys a line each takes 9 bytes of the shuffle and some per array; chains are the lines that share a band."""
    rng = random.Random(5)
    own = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=40)) for _ in range(8_000)]
    texts = ["\n".join(own[i : i + 40]) for i in range(0, 8_000, 40)] + [f"{line[:-1]}#" for line in own[:400]]
    frame = written(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "long_lines").coalesce(1)
    pairs = []
    n, size = shuffled(spark, lambda: pairs.extend(tuple(r) for r in lines.chains(frame, 8_400, 1 << 16).collect()))
    assert size < 11 * lines.BANDS * 8_400
    numbers = lines._nodes([lines.digest(line) for line in lines._first(texts).values()]).tolist()
    lists = list(lines._first(texts).values())
    keys = dict(zip(numbers, lines.bands(lists), strict=True))
    shared = {frozenset(p) for p in pairs if (keys[p[0]] == keys[p[1]]).any()}
    joined = {frozenset((a, b)) for a, b in zip(numbers[:400], numbers[8_000:], strict=True) if (keys[a] == keys[b]).any()}
    assert len(joined) > 390 and joined <= shared
    assert len({frozenset(p) for p in pairs} - shared) < 20  # keys that agree by chance


def test_nodes_are_the_first_bytes_of_digests():
    digests = [lines.digest(str(i)) for i in range(1_000)] + [b"\xff" * 16, b"\0" * 16]
    numbers = lines._nodes(digests)
    assert numbers.dtype == np.int64 and numbers.min() == 0 and numbers.max() == (1 << 8 * lines.NODE_BYTES) - 1
    assert len(set(numbers.tolist())) == len(digests)
    assert (lines._wide(lines._narrow(numbers)) == numbers).all() and len(lines._narrow(numbers)) == lines.NODE_BYTES * len(digests)


@pytest.mark.parametrize("size", [15, 50, 100])
def test_bands_hold_pairs_at_the_threshold(size):
    """Lines that lost a fifth of their shingles share a band with the whole ones."""
    rng = random.Random(3)
    whole = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=size + lines.SHINGLE - 1)) for _ in range(20_000)]
    cut = [line[: len(line) - size // 5] for line in whole]
    assert len(lines.shingles(cut[0]) & lines.shingles(whole[0])) / len(lines.shingles(whole[0])) == lines.SIMILAR
    assert (~(lines.bands(whole) == lines.bands(cut)).any(1)).sum() <= 2


@pytest.mark.parametrize("size", [5, 15, 50, 100])
def test_sketches_agree_at_the_threshold(size):
    rng = random.Random(4)
    whole = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=size + lines.SHINGLE - 1)) for _ in range(20_000)]
    marks = lines.sketches(whole)
    assert marks.shape == (20_000, lines.PLACES // 16)
    assert lines.agree(marks, lines.sketches([line[: len(line) - size // 5] for line in whole])).all()
    assert lines.agree(marks[1:], marks[:-1]).sum() <= (2 if size > 5 else 40)


def test_lines_of_a_bucket_have_one_leader():
    keys, nodes = np.array([3, 1, 3, 2, 3, 1, 3]), np.array([9, 5, 4, 5, 9, 5, 7])
    a, b = lines._led(keys, nodes)
    assert sorted(zip(a.tolist(), b.tolist(), strict=True)) == [(4, 7), (4, 9)]
    assert [len(x) for x in lines._led(keys[:0], nodes[:0])] == [0, 0]


def test_chance_candidates_do_not_gather(spark, monkeypatch):
    """Lines that share a phrase with hundreds of others have some candidates by chance each, enough to tie all of them together."""
    rng = random.Random(6)
    some = lambda n: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=n))
    phrases = [some(44) for _ in range(10)]
    own = ["".join([*rng.sample(phrases, 2), some(34)]) for _ in range(2_000)]
    family = some(120)
    own += [family[:k] + "#" + family[k + 1 :] for k in range(100)] + [f"{line[:-4]}####" for line in own[:40]]
    texts = list(enumerate("\n".join(own[i : i + 20]) for i in range(0, len(own), 20)))
    frame = written(spark.createDataFrame(texts, "doc_id long, text string"), "chance").coalesce(1)
    edges = []
    n, _ = shuffled(spark, lambda: edges.extend(map(tuple, lines.links(frame, len(own), 32).collect())))
    assert n < 20 * len(own), n
    at = {lines.digest(line.strip()): i for i, line in enumerate(own)}
    parts = brute.Union(len(own))
    for a, b in edges:
        parts.join(at[a], at[b])
    wanted = brute.dropped_lines([(i, line) for i, line in enumerate(own)])
    assert [i for i in range(len(own)) if parts.find(i) != i] == [i for i, x in enumerate(wanted) if x]
    assert sum(map(bool, wanted)) == 139
    # Blocks are bounded by characters too.
    monkeypatch.setattr(lines, "BLOCK_CHARS", 1_000)
    found = {r.doc_id: r.dropped for r in lines.judge(frame).collect()}
    assert found == {i: [j for j in range(20) if wanted[20 * i + j]] for i in range(len(own) // 20)}


def test_package_stands_alone():
    """Nothing outside the package imports it, but for the entry and the pipeline."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    for folder, _, names in os.walk(os.path.join(root, "hushlake")):
        for n in names:
            if n.endswith(".py") and not folder.endswith("llm"):
                with open(os.path.join(folder, n)) as file:
                    assert not re.search(r"hushlake\.llm|from \.*llm", file.read())
