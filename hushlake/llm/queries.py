"""The queries of this package: each operator over its whole table, with digests as result columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hushlake.llm import compression, divergence, exact, html_text, language, licences, lines, packing, resampling, rules, sharding, simhash, tokenization
from hushlake.llm.common import in_third, ready, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
TWINS: dict[str, str] = {}


def query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return function(ready(spark), sf_dir)

    QUERIES[function.__name__] = run
    return run


@query
def op1_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hexadecimal("fp").alias("fingerprint"), "component_id")


@query
def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rules.judge(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior"
    )


@query
def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language.predict(docs, language.fit(docs))
    return found.select("doc_id", in_third(1).alias("held_out"), "lang_pred", "score")


@query
def op4_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tokenization.encode(table(spark, sf_dir, "documents"), digest=True)
    return found.select("doc_id", "n_tokens", F.col("ids").alias("ids_sha256"), F.col("decoded").alias("decoded_sha256"))


@query
def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = compression.score(docs, compression.fit(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", in_third(1).alias("held_out"), "score", "predicted")


@query
def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact.exact_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


TWINS["op6_exact_dedup"] = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text,
                  regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
r AS (SELECT doc_id, norm, row_number() OVER w AS n, first_value(doc_id) OVER w AS keep_id,
             count(*) OVER (PARTITION BY norm) AS group_size
      FROM t WINDOW w AS (PARTITION BY norm ORDER BY length(text) DESC, doc_id))
SELECT doc_id, keep_id, group_size, n = 1 AS kept, sha256(norm) AS text_sha256 FROM r
"""


@query
def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


@query
def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document: how many lines it has, how many go, and their numbers (from 0, comma-joined)."""
    found = lines.judge(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", F.concat_ws(",", F.col("dropped").cast("array<string>")).alias("dropped"))


@query
def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents"))


@query
def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), digest=True)


@query
def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


TWINS["op11_source_divergence"] = r"""
WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text
           FROM documents),
w AS (SELECT row, lang, source, unnest(regexp_extract_all(
          translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
          '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*)::HUGEINT AS n FROM w GROUP BY ALL HAVING count(DISTINCT row) >= 30),
lang_sums AS (SELECT lang, sum(n)::HUGEINT AS total, count(*)::HUGEINT AS v FROM kept GROUP BY lang),
counts AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM w SEMI JOIN kept USING (lang, term) GROUP BY ALL),
sums AS (SELECT lang, source, sum(n)::HUGEINT AS total FROM counts GROUP BY ALL),
groups AS (SELECT DISTINCT lang, source FROM d),
shares AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
                  1 + 1000000000 * (coalesce(c.n, 0) + 5) // (coalesce(s.total, 0) + 5 * l.v) AS p,
                  1 + 1000000000 * (k.n + 5) // (l.total + 5 * l.v) AS q
           FROM groups g JOIN kept k USING (lang) JOIN lang_sums l USING (lang)
           LEFT JOIN counts c USING (lang, source, term) LEFT JOIN sums s USING (lang, source)),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(sum(abs(x.p - y.p)), 0) AS value
          FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN shares x ON x.lang = a.lang AND x.source = a.source
          LEFT JOIN shares y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term
          GROUP BY ALL),
parts AS (SELECT lang, source, 'pair' AS part, item, value FROM pairs
          UNION ALL SELECT lang, source, 'term', term, p - q FROM shares WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value,
       row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank
FROM parts QUALIFY part = 'pair' OR rank <= 50
"""


@query
def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.assign(table(spark, sf_dir, "documents"))
    law, grown = F.lit("bytes").alias("law"), F.lit(None).cast("int").alias("grown_shard")
    return found.select("doc_id", "size", "text_crc32", law, "shard", "slot", grown, "virtual_slot")


@query
def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


TWINS["op13_resampling"] = r"""
WITH crc_table AS (SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS v
    FROM range(256) r(i))),
texts AS (SELECT 'd' AS kind, row_number() OVER () AS row, doc_id, text FROM documents
          UNION ALL SELECT 'b', 0, NULL, text FROM benchmark),
found AS (SELECT kind, row, unnest(regexp_extract_all(
              translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
              '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM texts),
spelled AS (SELECT word, list_transform(range(0, strlen(word)), lambda k: ('0x' || substr(hex(word), 2 * k + 1, 2))::BIGINT) AS bytes
            FROM (SELECT DISTINCT word FROM found)),
bucketed AS (SELECT word, xor(4294967295, list_reduce(list_prepend(4294967295, bytes),
                              lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) % 10000 AS bucket
             FROM spelled, crc_table),
occurs AS (SELECT kind, row, bucket FROM found JOIN bucketed USING (word)),
sums AS (SELECT bucket, count(*) FILTER (kind = 'd') AS s, count(*) FILTER (kind = 'b') AS t FROM occurs GROUP BY bucket),
totals AS (SELECT sum(s)::DOUBLE AS all_s, sum(t)::DOUBLE AS all_t FROM sums),
gains AS (SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (all_s + 10000) / ((s + 1)::DOUBLE * (all_t + 10000))))::BIGINT AS gain
          FROM sums, totals),
weights AS (SELECT row, count(*) AS n, sum(gain)::BIGINT AS weight FROM occurs JOIN gains USING (bucket) WHERE kind = 'd' GROUP BY row),
scored AS (SELECT row, doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
                  coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT
                                                              + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
           FROM (SELECT * FROM texts WHERE kind = 'd') LEFT JOIN weights USING (row)),
placed AS (SELECT row, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 10 * n // 100 THEN place END AS rank
FROM scored LEFT JOIN placed USING (row)
"""
