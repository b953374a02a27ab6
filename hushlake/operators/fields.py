"""Text fields of request bodies and their audit rows.

A profile says where its bodies hold texts, as a table of paths. A body is taken
apart level by level, each level one generator over VARIANT, and only along
members that some path of the body's profile can still reach. No row leaves its
task, and the body is parsed once.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hushlake.functions import variants as V
from hushlake.operators.mask import HIDDEN, Policy, entities_of, rewrite, role_in_scope, with_islands
from hushlake.operators.rules import Rule
from hushlake.operators.sides import measured

PATHS = "profile_id string, path string, role string"

# Where known kinds of bodies keep their texts. ``[*]`` is any element, ``*`` any member, ``**`` anything below.
# Without a role, the nearest enclosing object with a ``role`` gives it.
CHAT_PATHS = [
    ("messages[*].content", None),
    ("messages[*].content[*].text", None),
    ("messages[*].tool_calls[*].function.arguments", None),
]
BLOCK_PATHS = [
    ("system", "system"),
    ("system[*].text", "system"),
    ("messages[*].content", None),
    ("messages[*].content[*].text", None),
    ("messages[*].content[*].content", "tool"),
    ("messages[*].content[*].content[*].text", "tool"),
    ("messages[*].content[*].input.**", None),
]
RESPONSE_PATHS = [
    ("instructions", "system"),
    ("input", "user"),
    ("input[*].content", None),
    ("input[*].content[*].text", None),
    ("input[*].output", "tool"),
]
ANY_PATHS = [("**", None)]

# Levels that ``**`` reaches below its place.
DEPTH = 12

_STEP = re.compile(r"\[\*\]|\[\d+\]|\.?\*\*|\.?\*|\.?[^.\[\]*]+")
# A member's name that stands in a path as it is; others are quoted in brackets.
_PLAIN = "^[A-Za-z_][A-Za-z0-9_-]*$"
_MEMBER = r"(?:(?:^|\.)[A-Za-z_][A-Za-z0-9_-]*|\['(?:[^'\\]|\\.)*'\])"


def profile_paths(spark: SparkSession, paths: dict[str, list[tuple[str, str | None]]]) -> DataFrame:
    """A table of paths from lists by profile id."""
    rows = [(profile, path, role) for profile, listed in paths.items() for path, role in listed]
    return spark.createDataFrame(rows, PATHS)


def operation_paths(profiles: DataFrame) -> DataFrame:
    """The table of paths of decoded profiles: the objects with a ``path`` among a profile's operations."""
    listed = V.records(V.parse(F.col("operations")))
    found = profiles.select("id", F.explode(listed).alias("__operation"))
    opened = found.select("id", V.open_record(F.col("__operation"), ["path", "role"]).alias("o"))
    path, role = V.optional_text(F.col("o")["path"]), V.optional_text(F.col("o")["role"])
    return opened.select(F.col("id").alias("profile_id"), path.alias("path"), role.alias("role")).filter("path <> ''")


def _steps(path: str) -> list[str]:
    steps = _STEP.findall(path)
    if not steps or "".join(steps) != path:
        raise ValueError(f"no path: {path}")
    return steps


def _pattern(step: str) -> str:
    """Regular expression of one step of a path."""
    if step.startswith("["):
        return r"\[\d+\]" if step == "[*]" else re.escape(step)
    if step.endswith("**"):
        return ".*"
    if step.endswith("*"):
        return _MEMBER
    name = step.removeprefix(".")
    return rf"(?:^|\.){re.escape(name)}" if re.match(_PLAIN, name) else re.escape(f"['{name}']")


def _compiled(paths: DataFrame, depth: int) -> tuple[DataFrame, int]:
    """One row for each profile: its paths in order, and what any of them can reach; and the deepest level.

    Paths are configuration: they are read to the driver to be compiled.
    """
    by_profile: dict[str | None, list[tuple[str, str | None]]] = {}
    deepest = 0
    for row in paths.orderBy("profile_id", "path", "role").collect():
        by_profile.setdefault(row.profile_id, []).append((row.path, row.role))
    rows = []
    for profile, listed in by_profile.items():
        reach, exact = [], []
        for path, role in listed:
            steps = _steps(path)
            deepest = max(deepest, len(steps) + (depth if any(s.endswith("**") for s in steps) else 0))
            patterns = [_pattern(s) for s in steps]
            exact.append((f"(?s)^{''.join(patterns)}$", role))
            # Every beginning of the path, one inside the other.
            nested = ""
            for pattern in reversed(patterns):
                nested = f"(?:{pattern}{nested})?"
            reach.append(nested)
        rows.append((profile, f"(?s)^(?:{'|'.join(reach)})$", exact))
    schema = "__profile string, __reach string, __exact array<struct<pattern string, role string>>"
    return paths.sparkSession.createDataFrame(rows, schema), deepest


def extract_fields(
    requests: DataFrame, keys: list[str], paths: DataFrame, body: str = "body", profile: str = "profile_id", depth: int = DEPTH
) -> DataFrame:
    """One row for each text of a JSON body that a path of its profile names: keys, path, role and text.

    ``paths`` is a table (profile_id, path, role). A request of an unknown
    profile, and a body that is no JSON, give no row. Paths come out with their
    places, as ``messages[0].content[1].text``. ``**`` reaches ``depth`` levels
    below its place; all other paths reach as deep as they are long.
    """
    known, levels = _compiled(paths, depth)
    parsed = requests.select(*keys, F.col(profile).alias("__profile"), V.parse(F.col(body)).alias("__value"))
    at = parsed.filter("__value IS NOT NULL").join(measured(known), "__profile")
    at = at.withColumns({"__path": F.lit(""), "__role": F.lit(None).cast("string")})
    # A row whose value is a scalar passes all further levels as it is.
    for _ in range(levels):
        level = at.lateralJoin(at.sparkSession.tvf.variant_explode_outer(F.col("__value").outer()))
        own_role = V.optional_text(F.try_variant_get("__value", "$.role", "variant"))
        name = F.when(F.col("key").rlike(_PLAIN), F.concat(F.when(F.col("__path") == "", "").otherwise("."), "key")).otherwise(
            F.concat(F.lit("['"), F.regexp_replace("key", r"(['\\])", r"\\$1"), F.lit("']"))
        )
        step = F.when(F.col("pos").isNull(), "").when(F.col("key").isNull(), F.concat(F.lit("["), "pos", F.lit("]"))).otherwise(name)
        at = level.select(
            *keys, "__profile", "__reach", "__exact",
            F.concat("__path", step).alias("__path"),
            F.coalesce(own_role, F.col("__role")).alias("__role"),
            F.when(F.col("pos").isNull(), F.col("__value")).otherwise(F.col("value")).alias("__value"),
        ).filter(F.expr("__path rlike __reach"))
    texts = at.select(*keys, "__path", "__role", "__exact", V.optional_text(F.col("__value")).alias("text"))
    hit = F.expr("get(filter(__exact, e -> __path rlike e.pattern), 0)")
    found = texts.filter("text IS NOT NULL").withColumn("__hit", hit).filter("__hit IS NOT NULL")
    return found.select(
        *keys, F.col("__path").alias("path"), F.coalesce("__hit.role", "__role").alias("role"), "text"
    )


def field_audit(
    fields: DataFrame, rules: list[Rule], keys: list[str], scope: str, policy: Policy = Policy()
) -> DataFrame:
    """Audit row of each field: path, partly hidden original, masked text, entities.

    The row stays in its task: nothing is grouped.
    """
    covered = role_in_scope(F.coalesce("role", F.lit("user")), policy) & F.lit(policy.enabled)
    prepared = fields.withColumn("__text", F.when(covered, F.col("text")))
    found = with_islands(prepared, rules, scope, text="__text", into="__islands")
    kept = list(dict.fromkeys([*keys, scope]))
    return found.select(
        *kept,
        "path",
        F.coalesce(rewrite("__text", "__islands", HIDDEN), "text").alias("original_masked"),
        F.coalesce(rewrite("__text", "__islands"), "text").alias("redacted"),
        F.coalesce(
            entities_of("__islands", with_masked=True),
            F.array().cast(
                "array<struct<type string, replacement string, masked string, confidence double,"
                " sources array<string>>>"
            ),
        ).alias("entities"),
    )
