"""Detection, masking, vault and annotation queries."""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushlake.functions.text import hide_value, n_chars
from hushlake.operators.annotate import annotate_all, annotate_first
from hushlake.operators.decode import decode
from hushlake.operators.detect import chunk_text, detect_distinct, detect_rules, rebase_spans
from hushlake.operators.detection_cache import cache_runs, detect_cached
from hushlake.operators.fields import BLOCK_PATHS, CHAT_PATHS, extract_fields, field_audit, operation_paths
from hushlake.operators.mask import Policy, entity_counts, mask, mask_conversations, mask_fast, residual_matches
from hushlake.operators.protect import mask_with_policy
from hushlake.operators.rules import Rule
from hushlake.operators.spans import detect_external, filter_types, merge_spans
from hushlake.operators.vault import build_vault, islands_table, protect, restore, vault_collisions
from hushlake.plans.registry import query
from hushlake.plans.tables import RULES, WORD_RULES, conversations, documents, literal, rules_sql, table
from hushlake.session import work_dir

# ---------------------------------------------------------------- SQL parts


def spans_sql(source: str, key: str, rules) -> str:
    """CTEs ``rules`` and ``rule_spans`` over a table with the key and ``text``."""
    return f"""{rules_sql(rules)},
found AS (SELECT d.{key}, d.text, r.pos, r.id, r.p, regexp_extract_all(d.text, r.p) AS ms
          FROM {source} d JOIN rules r ON regexp_matches(d.text, r.p)),
each AS (SELECT {key}, pos, id, unnest(ms) AS value,
                unnest(list_slice(string_split_regex(text, p), 1, len(ms))) AS gap,
                unnest(range(len(ms))) AS i FROM found),
rule_spans AS (SELECT {key}, false AS external, pos, id AS type, 'rule:' || id AS source,
                      1.0::DOUBLE AS confidence, value,
                      CAST(sum(length(gap) + length(value)) OVER w AS BIGINT) - length(value) AS s,
                      CAST(sum(length(gap) + length(value)) OVER w AS BIGINT) AS e
               FROM each WINDOW w AS (PARTITION BY {key}, pos ORDER BY i))"""


def islands_sql(spans: str, source: str, key: str) -> str:
    """CTE ``islands``: merged spans with value and placeholder."""
    return f"""marked AS (SELECT *, CASE WHEN s >= coalesce(max(e) OVER (PARTITION BY {key} ORDER BY s, e
                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) THEN 1 ELSE 0 END AS opens FROM {spans}),
numbered AS (SELECT *, sum(opens) OVER (PARTITION BY {key} ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM marked),
grouped AS (SELECT {key}, min(s) AS s, max(e) AS e,
                   first(type ORDER BY external, pos, s - e, s, type) AS type,
                   first(external ORDER BY external, pos, s - e, s, type) AS external,
                   max(confidence) AS confidence,
                   array_to_string(list_sort(list_distinct(list(source))), ',') AS sources
            FROM numbered GROUP BY {key}, island),
valued AS (SELECT g.*, substring(d.text, g.s + 1, g.e - g.s) AS value FROM grouped g JOIN {source} d USING ({key})),
islands AS (SELECT *, CASE WHEN external THEN '<' ELSE '<MASK_' END || type || ':' ||
                   upper(substr(sha256({key} || '|' || type || '|' || value), 1, 4)) || '>' AS replacement FROM valued)"""


def masked_sql(source: str, key: str, replacement: str = "replacement", extra: str = "") -> str:
    """CTE ``masked``: rewritten texts of a source."""
    return f"""stepped AS (SELECT *, coalesce(lag(e) OVER (PARTITION BY {key} ORDER BY s), 0) AS prev FROM islands),
rewritten AS (SELECT {key}, string_agg(substring(d.text, prev + 1, i.s - prev) || {replacement}, '' ORDER BY i.s)
                     || substring(any_value(d.text), max(i.e) + 1) AS text,
                     count(*) AS replacement_count,
                     string_agg(type || '=' || replacement || '(' || sources || ')', ' ' ORDER BY i.s) AS entities
              FROM stepped i JOIN {source} d USING ({key}) GROUP BY {key}),
masked AS (SELECT d.{key}, coalesce(r.text, d.text) AS text, coalesce(r.replacement_count, 0) AS replacement_count,
                  coalesce(r.entities, '') AS entities{extra} FROM {source} d LEFT JOIN rewritten r USING ({key}))"""


DOC_SPANS = spans_sql("documents", "doc_id", RULES)
DOC_MASKED = f"{DOC_SPANS},\n{islands_sql('rule_spans', 'documents', 'doc_id')},\n{masked_sql('documents', 'doc_id')}"
DOC_ISLANDS = f"{DOC_SPANS},\n{islands_sql('rule_spans', 'documents', 'doc_id')}"


def entity_text(column: str = "entities"):
    return F.expr(
        f"array_join(transform({column}, e -> concat(e.type, '=', e.replacement, '(', array_join(e.sources, ','), ')')), ' ')"
    ).alias("entities")


def result(masked: DataFrame, *keys: str) -> DataFrame:
    return masked.select(*keys, "text", F.col("replacement_count").cast("bigint").alias("replacement_count"), entity_text())


# ---------------------------------------------------------------- masking


@query("mask_documents", f"WITH {DOC_MASKED} SELECT doc_id, text, replacement_count, entities FROM masked")
def mask_documents(spark, sf_dir):
    return result(mask(documents(spark, sf_dir), RULES, "doc_id"), "doc_id")


# The joint pattern: its first non-empty group names the rule.
_JOINT = "|".join(f"({r.pattern})" for r in RULES)
_FAST = f"""{rules_sql(RULES)},
found AS (SELECT doc_id, text, regexp_extract_all(text, {literal(_JOINT)}) AS ms FROM documents),
each AS (SELECT doc_id, unnest(ms) AS value, unnest(range(len(ms))) AS i FROM found),
named AS (SELECT doc_id, i, value, (SELECT arg_min(id, pos) FROM rules WHERE regexp_full_match(value, p)) AS type FROM each),
placed AS (SELECT *, '<MASK_' || type || ':' || upper(substr(sha256(doc_id || '|' || type || '|' || value), 1, 4)) || '>'
                  AS replacement FROM named),
lists AS (SELECT doc_id, list(replacement ORDER BY i) AS rs,
                 string_agg(type || '=' || replacement || '(rule:' || type || ')', ' ' ORDER BY i) AS entities
          FROM placed GROUP BY doc_id),
masked AS (SELECT f.doc_id, coalesce(len(l.rs), 0) AS replacement_count, coalesce(l.entities, '') AS entities,
                  CASE WHEN l.rs IS NULL THEN f.text ELSE array_to_string(list_transform(
                       string_split_regex(f.text, {literal(_JOINT)}), lambda x, n: x || coalesce(l.rs[n], '')), '') END AS text
           FROM found f LEFT JOIN lists l USING (doc_id))"""


@query("mask_documents_fast", f"WITH {_FAST} SELECT doc_id, text, replacement_count, entities FROM masked")
def mask_documents_fast(spark, sf_dir):
    return result(mask_fast(documents(spark, sf_dir), RULES, "doc_id"), "doc_id")


@query(
    "mask_fast_vs_merged",
    f"""WITH a AS (WITH {DOC_MASKED} SELECT doc_id, text FROM masked), b AS (WITH {_FAST} SELECT doc_id, text FROM masked)
SELECT count(*) AS n_texts, count(*) FILTER (WHERE a.text <> b.text) AS n_differ FROM a JOIN b USING (doc_id)""",
)
def mask_fast_vs_merged(spark, sf_dir):
    """Texts where the fast path masks otherwise than merged spans do. Both run in one row."""
    docs = documents(spark, sf_dir)
    both = mask_fast(mask(docs.withColumn("original", F.col("text")), RULES, "doc_id").select(
        "doc_id", F.col("text").alias("merged"), F.col("original").alias("text")
    ), RULES, "doc_id")
    return both.agg(F.count("text").alias("n_texts"), F.count_if(F.col("text") != F.col("merged")).alias("n_differ"))


@query("mask_disabled", "SELECT doc_id, text, CAST(0 AS BIGINT) AS replacement_count, '' AS entities FROM documents")
def mask_disabled(spark, sf_dir):
    return result(mask(documents(spark, sf_dir), RULES, "doc_id", policy=Policy(enabled=False)), "doc_id")


@query("rule_spans", f"""WITH {DOC_SPANS} SELECT doc_id, type AS rule_id, s AS "start", e AS "end", value FROM rule_spans""")
def rule_spans(spark, sf_dir):
    found = detect_rules(documents(spark, sf_dir), RULES, ["doc_id"])
    return found.select(
        "doc_id",
        F.col("type").alias("rule_id"),
        F.col("start").cast("bigint").alias("start"),
        F.col("end").cast("bigint").alias("end"),
        "value",
    )


def _island_rows(islands: DataFrame) -> DataFrame:
    return islands.select(
        "doc_id",
        F.col("start").cast("bigint").alias("start"),
        F.col("end").cast("bigint").alias("end"),
        "type",
        "external",
        "confidence",
        F.array_join("sources", ",").alias("sources"),
    )


_ISLAND_SELECT = """SELECT doc_id, s AS "start", e AS "end", type, external, confidence, sources FROM """


@query("merged_spans", f"WITH {DOC_ISLANDS} {_ISLAND_SELECT} islands")
def merged_spans(spark, sf_dir):
    return _island_rows(merge_spans(detect_rules(documents(spark, sf_dir), RULES, ["doc_id"]), ["doc_id"]))


# Two stand-ins for outside detectors whose spans overlap each other and the rules'.
_DETECTORS = [
    ("model:a", "EMAIL_ADDRESS", 0.75, r"[A-Za-z0-9.]+@[A-Za-z0-9]+"),
    ("model:a", "PERSON", 0.5, r"\b[A-Z][a-z]{3,} [a-z]{4,}"),
    ("model:b", "ACCOUNT_NUMBER", 0.8125, r"[0-9][0-9 ()-]{7,}[0-9]"),
]


def external(docs: DataFrame) -> DataFrame:
    """A detector's span table made from the texts, in one pass over them."""
    found = detect_rules(docs, [Rule(t, p) for _, t, _, p in _DETECTORS], ["doc_id"])
    sources = F.array(*[F.lit(s) for s, *_ in _DETECTORS])
    confidences = F.array(*[F.lit(c) for _, _, c, _ in _DETECTORS])
    return found.select(
        "doc_id",
        "start",
        "end",
        "type",
        sources[F.col("pos")].alias("source"),
        confidences[F.col("pos")].alias("confidence"),
        "value",
    )


_EXTERNAL = ",\n".join(
    f"""f{i} AS (SELECT doc_id, text, regexp_extract_all(text, {literal(p)}) AS ms FROM documents),
e{i} AS (SELECT doc_id, unnest(ms) AS value, unnest(list_slice(string_split_regex(text, {literal(p)}), 1, len(ms))) AS gap,
             unnest(range(len(ms))) AS i FROM f{i}),
x{i} AS (SELECT doc_id, true AS external, 0 AS pos, '{t}' AS type, '{s}' AS source, {c}::DOUBLE AS confidence, value,
             CAST(sum(length(gap) + length(value)) OVER w AS BIGINT) - length(value) AS s,
             CAST(sum(length(gap) + length(value)) OVER w AS BIGINT) AS e
      FROM e{i} WINDOW w AS (PARTITION BY doc_id ORDER BY i))"""
    for i, (s, t, c, p) in enumerate(_DETECTORS)
) + ",\nall_spans AS (SELECT * FROM rule_spans UNION ALL BY NAME " + " UNION ALL BY NAME ".join(
    f"SELECT * FROM x{i}" for i in range(len(_DETECTORS))
) + ")"


@query(
    "external_spans",
    f"""WITH {DOC_SPANS}, {_EXTERNAL} SELECT doc_id, s AS "start", e AS "end", type, source, confidence, external FROM all_spans""",
)
def external_spans_query(spark, sf_dir):
    docs = documents(spark, sf_dir)
    both = detect_external(detect_rules(docs, RULES, ["doc_id"]), external(docs), ["doc_id"])
    return both.select(
        "doc_id", F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end"),
        "type", "source", "confidence", "external",
    )


@query(
    "merged_external_spans",
    f"WITH {DOC_SPANS}, {_EXTERNAL}, {islands_sql('all_spans', 'documents', 'doc_id')} {_ISLAND_SELECT} islands",
)
def merged_external_spans(spark, sf_dir):
    docs = documents(spark, sf_dir)
    both = detect_external(detect_rules(docs, RULES, ["doc_id"]), external(docs), ["doc_id"])
    return _island_rows(merge_spans(both, ["doc_id"]))


@query(
    "filter_types",
    f"""WITH {DOC_SPANS}, {_EXTERNAL} SELECT doc_id, s AS "start", e AS "end", type, source FROM all_spans
WHERE NOT (external AND type IN ('PERSON', 'EMAIL_ADDRESS'))""",
)
def filter_types_query(spark, sf_dir):
    docs = documents(spark, sf_dir)
    both = detect_external(detect_rules(docs, RULES, ["doc_id"]), external(docs), ["doc_id"])
    types = spark.createDataFrame(
        [("PERSON", False), ("EMAIL_ADDRESS", False), ("ACCOUNT_NUMBER", True)], "type string, enabled boolean"
    )
    return filter_types(both, types).select(
        "doc_id", F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end"), "type", "source"
    )


@query(
    "mask_documents_external",
    f"""WITH {DOC_SPANS}, {_EXTERNAL}, {islands_sql('all_spans', 'documents', 'doc_id')}, {masked_sql('documents', 'doc_id')}
SELECT doc_id, text, replacement_count, entities FROM masked""",
)
def mask_documents_external(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return result(mask(docs, RULES, "doc_id", external=external(docs), keys=["doc_id"]), "doc_id")


# The rules' patterns in parts of Java's dialect that a reader of plain patterns may trip over: nested and
# intersected classes, quoting, octal escapes, back-references.
_DIALECT = [
    ("EMAIL_ADDRESS", r"[A-Za-z0-9[._%+-]]+@[A-Za-z0-9.-]+\Q.\E[A-Za-z&&[^_]]{2,}", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"),
    ("PHONE_NUMBER", r"\053\d{1,3} \Q(\E[0-9[0-4]]{3}\) \d{3}-\d{4}", r"\+\d{1,3} \(\d{3}\) \d{3}-\d{4}"),
    (
        "BANK_CARD",
        r"\b(\d)\d{14}\1\b",
        r"\b(?:" + "|".join(f"{d}\\d{{14}}{d}" for d in range(10)) + r")\b",
    ),
    ("SECRET", r"(?i)TOKEN(?-i)\s*[:=]\s*[\S&&[^,;]]+", r"[Tt][Oo][Kk][Ee][Nn]\s*[:=]\s*[^\s,;]+"),
]
_PLAIN = spans_sql("documents", "doc_id", [Rule(i, plain) for i, _, plain in _DIALECT])


@query(
    "mask_dialect",
    f"""WITH {_PLAIN}, {islands_sql('rule_spans', 'documents', 'doc_id')}, {masked_sql('documents', 'doc_id')}
SELECT doc_id, text, replacement_count, entities FROM masked""",
)
def mask_dialect(spark, sf_dir):
    rules = [Rule(i, java) for i, java, _ in _DIALECT]
    return result(mask(documents(spark, sf_dir), rules, "doc_id"), "doc_id")


@query(
    "mask_external_clamped",
    f"""WITH {DOC_SPANS}, all_spans AS (SELECT * FROM rule_spans UNION ALL BY NAME
SELECT doc_id, true AS external, 0 AS pos, 'EDGE' AS type, 'model:e' AS source, 0.5::DOUBLE AS confidence,
       unnest([greatest(-4, 0), greatest(length(text) - 6, 0)]) AS s, unnest([least(5, length(text)), length(text)]) AS e FROM documents
WHERE doc_id % 3 = 0), {islands_sql('all_spans', 'documents', 'doc_id')}, {masked_sql('documents', 'doc_id')}
SELECT doc_id, text, replacement_count, entities FROM masked""",
)
def mask_external_clamped(spark, sf_dir):
    """A detector's spans that reach past both ends of every third text."""
    docs = documents(spark, sf_dir)
    edges = F.array(
        F.struct(F.lit(-4).alias("start"), F.lit(5).alias("end")),
        F.struct((F.length("text") - 6).alias("start"), (F.length("text") + 9).alias("end")),
    )
    given = docs.filter("doc_id % 3 = 0").select("doc_id", F.inline(edges)).withColumns(
        {"type": F.lit("EDGE"), "source": F.lit("model:e"), "confidence": F.lit(0.5)}
    )
    return result(mask(docs, RULES, "doc_id", external=given, keys=["doc_id"]), "doc_id")


# A policy document as it is stored: a rule switched off, a type switched off and on again, which has no effect.
_POLICY = """{"enabled": true, "redact_ai_answers": true,
 "entity_types": [{"type": "PERSON", "enabled": false}, {"type": "PERSON", "enabled": true}, {"type": "URL"}],
 "rules": [{"id": "email_address", "pattern": "[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][A-Za-z]{2,}"},
  {"id": "PHONE_NUMBER", "pattern": "[+]", "enabled": false}, {"id": "BLANK", "pattern": " "},
  {"id": "IP_ADDRESS", "pattern": "[0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}"}]}"""
_USED = [
    Rule("EMAIL_ADDRESS", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][A-Za-z]{2,}"),
    Rule("IP_ADDRESS", r"[0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}"),
]


@query(
    "mask_with_policy",
    f"""WITH {spans_sql('documents', 'doc_id', _USED)}, {_EXTERNAL},
kept AS (SELECT * FROM all_spans WHERE NOT (external AND type = 'PERSON')),
{islands_sql('kept', 'documents', 'doc_id')}, {masked_sql('documents', 'doc_id')}
SELECT doc_id, text, replacement_count, entities FROM masked""",
)
def mask_with_policy_query(spark, sf_dir):
    """From the policy's text to masked documents."""
    docs = documents(spark, sf_dir)
    policy = decode(spark.range(1).select(F.lit(_POLICY).alias("json")), "policy")
    return result(mask_with_policy(docs, policy, "doc_id", external=external(docs), keys=["doc_id"]), "doc_id")


# ------------------------------------------------------- conversations, fields

_CONV = (
    "turns AS (SELECT conv_id, turn, role, text AS original, CASE WHEN {where} THEN text END AS text, "
    "conv_id || '/' || turn AS k FROM conversations)"
)


def _conversation_sql(where: str) -> str:
    scoped = islands_sql("rule_spans", "turns", "k").replace("sha256(k ||", "sha256(split_part(k, '/', 1) ||")
    return f"""WITH {_CONV.format(where=where)}, {spans_sql('turns', 'k', WORD_RULES)}, {scoped},
{masked_sql('turns', 'k', extra=', d.conv_id, d.turn, d.role, d.original')}
SELECT conv_id, turn, role, coalesce(text, original) AS text, replacement_count, entities FROM masked"""


def _conversation_query(name: str, policy: Policy, where: str) -> None:
    @query(f"mask_conversations_{name}", _conversation_sql(where))
    def run(spark, sf_dir):
        masked = mask_conversations(conversations(spark, sf_dir), WORD_RULES, policy)
        return result(masked, "conv_id", "turn", "role")


_conversation_query("default", Policy(), "role = 'user'")
_conversation_query("system", Policy(redact_system_messages=True), "role IN ('user', 'system')")
_conversation_query("ai", Policy(redact_ai_answers=True), "role IN ('user', 'assistant')")
_conversation_query("both", Policy(redact_ai_answers=True, redact_system_messages=True), "true")


_SYSTEM = "Answer thoroughly, unconditionally."


def bodies(spark, sf_dir) -> DataFrame:
    """A request body for each turn, in four shapes: a text, a list of parts, a tool's answer, a tool's call and answer."""
    system, empty = f"'role', 'system', 'content', '{_SYSTEM}'", "'role', 'user', 'content', null"
    parts = "array(named_struct('type', 'image_url', 'text', null), named_struct('type', 'text', 'text', text))"
    shapes = [
        f"named_struct('messages', array(named_struct({system}), named_struct({empty}), named_struct('role', role, 'content', text)))",
        f"named_struct('messages', array(named_struct({system.replace(f"'{_SYSTEM}'", 'null')}, 'name', 'x'), named_struct({empty}, 'name', 'y'), "
        f"named_struct('role', role, 'content', {parts}, 'name', null)))",
        f"named_struct('system', array(named_struct('type', 'text', 'text', '{_SYSTEM}')), 'messages', array(named_struct('role', role, "
        "'content', array(named_struct('type', 'tool_result', 'content', array(named_struct('type', 'text', 'text', text)))))))",
        "named_struct('messages', array(named_struct('role', 'assistant', 'content', null, 'tool_calls', array(named_struct('function', "
        "named_struct('name', 'long_function_names', 'arguments', text)))), named_struct('role', 'tool', 'content', text, 'tool_calls', null)))",
    ]
    cases = " ".join(f"WHEN {i} THEN to_json({shape})" for i, shape in enumerate(shapes))
    return conversations(spark, sf_dir).select(
        "conv_id", "turn", F.expr("if(turn % 4 = 2, 'blocks', 'chat')").alias("profile_id"),
        F.expr(f"CASE turn % 4 {cases} END").alias("body"),
    )


def _profile_documents(spark) -> DataFrame:
    """Profiles as documents whose operations name the paths; one has a member of a wrong kind."""
    rows = [
        (i, json.dumps({"id": profile, "operations": [{"path": p, "role": r} for p, r in listed] + [5, {"path": None}]}))
        for i, (profile, listed) in enumerate([("chat", CHAT_PATHS), ("blocks", BLOCK_PATHS)])
    ]
    return decode(spark.createDataFrame(rows, "event_id int, json string"), "profiles")


_FIELDS = f"""fields AS (
SELECT conv_id, turn, CASE turn % 4 WHEN 2 THEN 'system[0].text' ELSE 'messages[0].content' END AS path, 'system' AS role,
       '{_SYSTEM}' AS text FROM conversations WHERE turn % 4 IN (0, 2)
UNION ALL SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'messages[2].content' WHEN 1 THEN 'messages[2].content[1].text'
       WHEN 2 THEN 'messages[0].content[0].content[0].text' ELSE 'messages[1].content' END,
       CASE WHEN turn % 4 IN (2, 3) THEN 'tool' ELSE role END, text FROM conversations WHERE text IS NOT NULL
UNION ALL SELECT conv_id, turn, 'messages[0].tool_calls[0].function.arguments', 'assistant', text FROM conversations
       WHERE turn % 4 = 3 AND text IS NOT NULL)"""


def _fields(spark, sf_dir) -> DataFrame:
    return extract_fields(bodies(spark, sf_dir), ["conv_id", "turn"], operation_paths(_profile_documents(spark)))


@query("conversation_fields", f"WITH {_FIELDS} SELECT * FROM fields")
def conversation_fields(spark, sf_dir):
    return _fields(spark, sf_dir)


_FIELD_TURNS = (
    "turns AS (SELECT conv_id, turn, path, text AS original, CASE WHEN role IN ('user', 'tool') THEN text END AS text, "
    "conv_id || '/' || turn || '/' || path AS k FROM fields)"
)
_FIELD_ISLANDS = islands_sql("rule_spans", "turns", "k").replace("sha256(k ||", "sha256(split_part(k, '/', 1) ||")


@query(
    "field_audit",
    f"""WITH {_FIELDS}, {_FIELD_TURNS}, {spans_sql('turns', 'k', WORD_RULES)}, {_FIELD_ISLANDS},
{masked_sql('turns', 'k', extra=', d.conv_id, d.turn, d.path, d.original')},
hidden AS (SELECT k, string_agg(substring(d.text, prev + 1, i.s - prev) || left(value, 1) || repeat('*', length(value) - 1), ''
                  ORDER BY i.s) || substring(any_value(d.text), max(i.e) + 1) AS original_masked
           FROM stepped i JOIN turns d USING (k) GROUP BY k)
SELECT conv_id, turn, path, coalesce(h.original_masked, m.original) AS original_masked,
       coalesce(m.text, m.original) AS redacted, entities, replacement_count AS n_entities
FROM masked m LEFT JOIN hidden h USING (k)""",
)
def field_audit_query(spark, sf_dir):
    audit = field_audit(_fields(spark, sf_dir), WORD_RULES, ["conv_id", "turn"], "conv_id")
    return audit.select(
        "conv_id", "turn", "path", "original_masked", "redacted", F.size("entities").cast("bigint").alias("n_entities"),
        entity_text(),
    )


@query("hide_value", f"WITH {DOC_ISLANDS} SELECT doc_id, s AS \"start\", left(value, 1) || repeat('*', length(value) - 1) AS masked FROM islands")
def hide_value_query(spark, sf_dir):
    found = islands_table(documents(spark, sf_dir), RULES, "doc_id", keys=["doc_id"])
    return found.select("doc_id", F.col("start").cast("bigint").alias("start"), hide_value(F.col("value")).alias("masked"))


# ---------------------------------------------------------------- vault

_VAULT = (
    "vault AS (SELECT DISTINCT {scope} AS scope_id, replacement AS placeholder, type, value FROM islands)"
)


def _vault(spark, sf_dir) -> DataFrame:
    return build_vault(islands_table(documents(spark, sf_dir), RULES, "doc_id"))


@query("vault", f"WITH {DOC_ISLANDS}, {_VAULT.format(scope='CAST(doc_id AS VARCHAR)')} SELECT * FROM vault")
def vault_query(spark, sf_dir):
    return _vault(spark, sf_dir)


# Long words of all conversations in three scopes: enough values for four digits to collide.
_SCOPES = "texts AS (SELECT conv_id || '/' || turn AS k, conv_id, text FROM conversations)"
_SCOPED = islands_sql("rule_spans", "texts", "k").replace(
    "sha256(k ||", "sha256((CAST(split_part(k, '/', 1) AS BIGINT) % 3) ||"
)
_SCOPE_VAULT = _VAULT.format(scope="CAST(CAST(split_part(k, '/', 1) AS BIGINT) % 3 AS VARCHAR)")


def _word_vault(spark, sf_dir) -> DataFrame:
    turns = conversations(spark, sf_dir).withColumn("scope", F.col("conv_id") % 3)
    return build_vault(islands_table(turns, WORD_RULES, "scope"))


@query(
    "vault_collisions",
    f"""WITH {_SCOPES}, {spans_sql('texts', 'k', WORD_RULES)}, {_SCOPED}, {_SCOPE_VAULT}
SELECT scope_id, placeholder, count(DISTINCT value) AS n_values FROM vault GROUP BY ALL HAVING count(DISTINCT value) > 1""",
)
def vault_collisions_query(spark, sf_dir):
    return vault_collisions(_word_vault(spark, sf_dir))


@query(
    "restore",
    f"""WITH {_SCOPES}, {spans_sql('texts', 'k', WORD_RULES)}, {_SCOPED}, {_SCOPE_VAULT},
clear AS (SELECT scope_id, placeholder, any_value(value) AS value FROM vault GROUP BY ALL HAVING count(DISTINCT value) = 1),
kept AS (SELECT i.* EXCLUDE (replacement), coalesce(c.value, i.replacement) AS replacement FROM islands i LEFT JOIN clear c
         ON c.placeholder = i.replacement AND c.scope_id = CAST(CAST(split_part(k, '/', 1) AS BIGINT) % 3 AS VARCHAR)),
{masked_sql('texts', 'k').replace('FROM islands', 'FROM kept')}
SELECT k, text FROM masked""",
)
def restore_query(spark, sf_dir):
    """Answers that repeat the masked text are restored, but for ambiguous placeholders."""
    turns = conversations(spark, sf_dir).select(
        F.concat_ws("/", "conv_id", "turn").alias("k"), (F.col("conv_id") % 3).alias("scope"), "text"
    )
    masked, vault = protect(turns, WORD_RULES, "scope", ["k"], work_dir(spark, "protected"))
    return restore(masked, vault, ["k"], entities="entities").select("k", "text")


@query("restore_roundtrip", "SELECT doc_id, text, true AS same FROM documents")
def restore_roundtrip(spark, sf_dir):
    docs = documents(spark, sf_dir)
    masked, vault = protect(docs, RULES, "doc_id", ["doc_id"], work_dir(spark, "protected"))
    back = restore(masked, vault, ["doc_id"]).select("doc_id", "text")
    originals = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("original"))
    return back.join(originals, "doc_id").select("doc_id", "text", F.col("text").eqNullSafe(F.col("original")).alias("same"))


@query("residual_matches", "SELECT doc_id, CAST(0 AS BIGINT) AS residual FROM documents")
def residual_matches_query(spark, sf_dir):
    masked = mask(documents(spark, sf_dir), RULES, "doc_id")
    return residual_matches(masked, RULES).select("doc_id", F.col("residual").cast("bigint").alias("residual"))


@query("mask_twice", f"WITH {DOC_MASKED} SELECT doc_id, text, true AS same FROM masked")
def mask_twice(spark, sf_dir):
    """Masking masked texts changes nothing."""
    once = mask(documents(spark, sf_dir), RULES, "doc_id").select("doc_id", "text", F.col("text").alias("once"))
    twice = mask(once, RULES, "doc_id")
    return twice.select("doc_id", "text", (F.col("text") == F.col("once")).alias("same"))


@query("entity_counts", f"WITH {DOC_ISLANDS} SELECT type, count(*) AS n_entities FROM islands GROUP BY type")
def entity_counts_query(spark, sf_dir):
    return entity_counts(islands_table(documents(spark, sf_dir), RULES, "doc_id"))


# ------------------------------------------------------- repeats and chunks


@query("detect_distinct", f"""WITH {DOC_SPANS} SELECT doc_id, s AS "start", type, value FROM rule_spans""")
def detect_distinct_query(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = detect_distinct(docs, RULES)
    return found.select("doc_id", F.inline("spans")).select(
        "doc_id", F.col("start").cast("bigint").alias("start"), "type", "value"
    )


_CACHED_AT = dt.datetime(2024, 1, 15, 12, 0, tzinfo=dt.timezone.utc)


def _cached_runs(spark, sf_dir, path: str) -> DataFrame:
    """Documents, then turns and documents within the time to live, then both after it: the last run's spans."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    both = docs.unionByName(conversations(spark, sf_dir).select(F.lit(-1).cast("bigint").alias("doc_id"), "text"))
    detect_cached(docs, RULES, path, _CACHED_AT)
    detect_cached(both, RULES, path, _CACHED_AT + dt.timedelta(seconds=900))
    return detect_cached(both, RULES, path, _CACHED_AT + dt.timedelta(seconds=1801))


_BOTH = "both_texts AS (SELECT doc_id, text FROM documents UNION ALL SELECT -1, text FROM conversations)"


@query("detect_cached", f"""WITH {DOC_SPANS} SELECT doc_id, s AS "start", type, value FROM rule_spans""")
def detect_cached_query(spark, sf_dir):
    """What cached results give for the documents is what searching them gives."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    path = work_dir(spark, "detection-cache")
    detect_cached(docs, RULES, path, _CACHED_AT)
    found = detect_cached(docs, RULES, path, _CACHED_AT + dt.timedelta(seconds=60))
    return found.select("doc_id", F.inline("spans")).select("doc_id", F.col("start").cast("bigint").alias("start"), "type", "value")


@query(
    "cache_runs",
    f"""WITH {_BOTH}, n AS (SELECT count(DISTINCT text) AS texts, count(DISTINCT CASE WHEN doc_id <> -1 THEN text END) AS old FROM both_texts)
SELECT unnest([0, 900, 1801]) AS seconds, unnest([old, texts, texts]) AS texts, unnest([old, texts - old, texts]) AS searched FROM n""",
)
def cache_runs_query(spark, sf_dir):
    """The second run searches the turns alone and renews the documents; the third comes a second too late for both."""
    path = work_dir(spark, "detection-cache")
    _cached_runs(spark, sf_dir, path)
    seconds = (F.col("at") - int(_CACHED_AT.timestamp())).cast("int")
    return cache_runs(spark, path).select(seconds.alias("seconds"), "texts", "searched")


_MAX, _STRIDE = 512, 128
_TOKEN = literal(r"[^ \t\n\r\f\x0B]+[ \t\n\r\f\x0B]*")
_CHUNKS = f"""tokens AS (SELECT doc_id, length(regexp_extract(text, '^[ \\t\\n\\r\\f\\x0B]+')) AS lead,
                  regexp_extract_all(text, {_TOKEN}) AS ts FROM documents),
windows AS (SELECT *, unnest(range(CAST(greatest(ceil((len(ts) - {_MAX}) / {_MAX - _STRIDE}.0), 0) AS BIGINT) + 1)) AS chunk
            FROM tokens WHERE len(ts) > 0),
chunks AS (SELECT doc_id, chunk, least(len(ts) - chunk * {_MAX - _STRIDE}, {_MAX}) AS n_tokens,
                  lead + length(array_to_string(ts[1 : chunk * {_MAX - _STRIDE}], '')) AS at,
                  regexp_replace(array_to_string(ts[chunk * {_MAX - _STRIDE} + 1 : chunk * {_MAX - _STRIDE} + {_MAX}], ''),
                                 '[ \\t\\n\\r\\f\\x0B]+$', '') AS text FROM windows)"""


@query("chunk_documents", f"WITH {_CHUNKS} SELECT * FROM chunks")
def chunk_documents(spark, sf_dir):
    chunks = chunk_text(documents(spark, sf_dir), ["doc_id"], _MAX, _STRIDE)
    return chunks.withColumns({c: F.col(c).cast("bigint") for c in ("chunk", "n_tokens", "at")})


@query("chunk_spans", f"WITH {DOC_ISLANDS} {_ISLAND_SELECT} islands")
def chunk_spans(spark, sf_dir):
    """Spans found in overlapping chunks, moved back and merged, are the spans of the whole text."""
    chunks = chunk_text(documents(spark, sf_dir), ["doc_id"], _MAX, _STRIDE)
    found = detect_rules(chunks, RULES, ["doc_id", "chunk", "at"])
    return _island_rows(merge_spans(rebase_spans(found), ["doc_id"]))


# ------------------------------------------------------- annotation and counts


_PARTS = f"""WITH {DOC_MASKED}, pieces AS (
  SELECT doc_id, string_split_regex(text, '<MASK_[A-Z_]+:[0-9A-F]{{4}}>') AS ps,
         regexp_extract_all(text, '<MASK_([A-Z_]+):[0-9A-F]{{4}}>', 0) AS ms,
         regexp_extract_all(text, '<MASK_([A-Z_]+):[0-9A-F]{{4}}>', 1) AS ts FROM masked),
parts AS (SELECT doc_id, unnest(range(len(ps))) * 2 AS i, unnest(ps) AS part, '' AS type FROM pieces
          UNION ALL SELECT doc_id, unnest(range(len(ms))) * 2 + 1, unnest(ms), unnest(ts) FROM pieces)
SELECT doc_id, i, part, type FROM parts"""


def _parts(masked: DataFrame, parts) -> DataFrame:
    cut = masked.select("doc_id", F.posexplode(parts).alias("i", "p"))
    return cut.select(
        "doc_id", F.col("i").cast("bigint").alias("i"), "p.part", F.coalesce("p.type", F.lit("")).alias("type")
    )


@query("annotate_all", _PARTS)
def annotate_all_query(spark, sf_dir):
    masked = mask(documents(spark, sf_dir), RULES, "doc_id")
    return _parts(masked, annotate_all("text", "entities"))


@query("annotate_first", _PARTS)
def annotate_first_query(spark, sf_dir):
    """With one entity for each occurrence, marking first occurrences marks all of them."""
    masked = mask(documents(spark, sf_dir), RULES, "doc_id")
    return _parts(masked, annotate_first("text", "entities"))


# Lists whose replacements repeat with other types, and lists whose replacements lie within each other: a number is
# the place of one of the text's own entities, a pair a type and a replacement or the place of one.
_LISTS = {
    "repeated": [0, ("AGAIN", 0), 2, ("THIRD", 0), 1],
    "nested": [0, ("WORD", "the"), ("LETTER", "e"), 1, ("WORD", "the"), ("MARK", "MASK_")],
}


def _listed(shape: list, entity: Callable[[str, str], str], own: Callable[[int, str], str]) -> str:
    """SQL of a list's entities, in the dialect that ``entity`` and ``own`` write."""
    parts = []
    for item in shape:
        type_, what = (None, item) if isinstance(item, int) else item
        replacement = own(what, "replacement") if isinstance(what, int) else f"'{what}'"
        parts.append(entity(f"'{type_}'" if type_ else own(what, "type"), replacement))
    return ", ".join(parts)


def _duck_list(kind: str) -> str:
    members = {"type": "type", "replacement": "r"}
    return _listed(_LISTS[kind], lambda t, r: f"{{'type': {t}, 'r': {r}}}", lambda i, m: f"entities[{i + 1}].{members[m]}")


def _spark_list(kind: str) -> str:
    return _listed(
        _LISTS[kind], lambda t, r: f"named_struct('type', {t}, 'replacement', {r})", lambda i, m: f"get(entities, {i}).{m}"
    )


_LISTED = DOC_MASKED.replace(
    "string_agg(type || '=' || replacement || '(' || sources || ')', ' ' ORDER BY i.s) AS entities",
    "list({'type': type, 'r': replacement} ORDER BY i.s) AS entities",
).replace("coalesce(r.entities, '')", "r.entities")
_MIXED = f"""WITH RECURSIVE {_LISTED},
lists AS (SELECT doc_id, text, unnest(['repeated', 'nested']) AS kind, unnest([[{_duck_list('repeated')}], [{_duck_list('nested')}]]) AS listed FROM masked),
start AS (SELECT doc_id, kind, list_filter(listed, lambda e: e.r IS NOT NULL) AS es, [{{'part': text, 'type': ''}}] AS parts FROM lists),
steps AS (SELECT doc_id, kind, es, parts, 1 AS step FROM start
  UNION ALL SELECT doc_id, kind, es, flatten(list_transform(parts, lambda p: CASE WHEN p.type <> '' OR strpos(p.part, es[step].r) = 0 THEN [p]
    ELSE [{{'part': substr(p.part, 1, strpos(p.part, es[step].r) - 1), 'type': ''}}, {{'part': es[step].r, 'type': es[step].type}},
          {{'part': substr(p.part, strpos(p.part, es[step].r) + length(es[step].r)), 'type': ''}}] END)), step + 1 FROM steps WHERE step <= len(es)),
ended AS (SELECT doc_id, kind, unnest(range(len(parts))) AS i, unnest(parts) AS p FROM steps WHERE step = len(es) + 1)
SELECT doc_id, kind, i, p.part AS part, p.type AS type FROM ended"""


@query("annotate_mixed", _MIXED)
def annotate_mixed(spark, sf_dir):
    """The sequential rule on lists that repeat a replacement, and on replacements that overlap."""
    masked = mask(documents(spark, sf_dir), RULES, "doc_id")
    lists = ", ".join(
        f"named_struct('kind', '{kind}', 'listed', filter(array({_spark_list(kind)}), e -> e.replacement is not null))" for kind in _LISTS
    )
    both = masked.select("doc_id", "text", F.inline(F.expr(f"array({lists})")))
    cut = both.select("doc_id", "kind", F.posexplode(annotate_first("text", "listed")).alias("i", "p"))
    return cut.select(
        "doc_id", "kind", F.col("i").cast("bigint").alias("i"), "p.part", F.coalesce("p.type", F.lit("")).alias("type")
    )


@query("text_length", "SELECT doc_id, length(text) AS n_chars FROM documents")
def text_length(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", n_chars(F.col("text")).cast("bigint").alias("n_chars"))
