"""Detection rules: hygiene, checks and the patterns that go into a plan.

Patterns stand in the plan as constants so that each is compiled once for a
task. A rule set is configuration, not data: it is read to the driver whole.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterable
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hushlake.functions.arrays import quoted

ID_SHAPE = re.compile(r"[A-Z][A-Z0-9_]*")

RULES_SCHEMA = "pos int, id string, pattern string, enabled boolean"


@dataclass(frozen=True)
class Rule:
    """A named pattern. The position in the list is its priority."""

    id: str
    pattern: str
    enabled: bool = True


def rules_frame(spark: SparkSession, rules: Iterable[Rule]) -> DataFrame:
    rows = [(i, r.id, r.pattern, r.enabled) for i, r in enumerate(rules)]
    return spark.createDataFrame(rows, RULES_SCHEMA)


def usable_rules(rules: DataFrame) -> DataFrame:
    """Rules that take part: enabled and not blank, with the id in upper case."""
    return rules.withColumn("id", F.upper("id")).filter(F.col("enabled") & (F.trim("pattern") != ""))


def rule_counts(rules: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Enabled and total number of rules, for each key if keys are given."""
    return rules.groupBy(*(keys or [])).agg(
        F.count_if("enabled").alias("enabled_rules"), F.count(F.lit(1)).alias("total_rules")
    )


def load_rules(rules: DataFrame) -> list[Rule]:
    """Usable rules of a table in list order. They become constants of the plan."""
    rows = usable_rules(rules).orderBy("pos").select("id", "pattern").collect()
    return checked(Rule(r.id, r.pattern) for r in rows)


def checked(rules: Iterable[Rule]) -> list[Rule]:
    """Upper-case the ids, leave out disabled and blank rules, refuse bad ones."""
    kept = [Rule(r.id.upper(), r.pattern) for r in rules if r.enabled and r.pattern.strip()]
    for rule in kept:
        if not ID_SHAPE.fullmatch(rule.id):
            raise ValueError(f"rule id {rule.id!r} must look like NAME_1")
        if matches_empty(rule.pattern):
            raise ValueError(f"rule {rule.id} can match the empty string")
    return kept


# Texts in which a pattern that can match the empty string does so somewhere.
_PROBES = ("", "a", "A1 b_-", "\n", "\u00e9 \u4e2d", "0.0", "!", "x@y.zz, <a> \"q\" 'r' (1) [2] {3}\r\n\t$ # / \\ ^ | * + ? ; : = & % ~ `")


@functools.cache
def _compiled(pattern: str):
    """The pattern as Java compiles it, for that is what runs on the texts."""
    try:
        return SparkContext._active_spark_context._jvm.java.util.regex.Pattern.compile(pattern)
    except Py4JJavaError as error:
        raise ValueError(f"pattern {pattern!r} cannot be read: {error.java_exception.getMessage()}") from error


def matches_empty(pattern: str) -> bool:
    """Whether the pattern matches an empty piece of one of a set of probing texts."""
    for probe in _PROBES:
        found = _compiled(pattern).matcher(probe)
        while found.find():
            if found.start() == found.end():
                return True
    return False


def group_count(pattern: str) -> int:
    """Number of capturing groups of a pattern."""
    return _compiled(pattern).matcher("").groupCount()


def refers_to_groups(pattern: str) -> bool:
    """Whether a pattern may hold a back-reference, which a joint pattern would point elsewhere."""
    return re.search(r"\\[1-9k]", pattern.replace("\\\\", "")) is not None


def group_names(pattern: str) -> list[str]:
    return re.findall(r"\(\?<([A-Za-z][A-Za-z0-9]*)>", pattern)


def may_match(text: str, pattern: str) -> str:
    """SQL for a cheap test that is true wherever the pattern can match.

    It looks for the fixed strings every match has to contain. Most texts lack
    them, and a substring test is far cheaper than a regular expression. Strings
    are derived only from patterns within a small part of Java's dialect that
    is read here in full; for any other pattern the test is always true.
    """
    try:
        needed = _Reader(text, pattern).alternatives()
    except _Unread:
        needed = None
    return needed or "true"


class _Unread(Exception):
    """The pattern goes beyond what the reader knows."""


class _Reader:
    """Reads literals, simple classes, groups, alternatives and repetitions; refuses all else.

    Each method gives a condition that holds wherever its part can match, or None if it knows of none.
    """

    # Escapes that stand for one character of a class, or for a place without width.
    CLASSES = frozenset("dDsSwWhHvVbB")

    def __init__(self, text: str, pattern: str) -> None:
        self.text, self.pattern, self.at = text, pattern, 0

    def alternatives(self, inner: bool = False) -> str | None:
        choices = [self.sequence()]
        while self.peek() == "|":
            self.at += 1
            choices.append(self.sequence())
        if self.peek() == ")" and not inner:
            raise _Unread
        if inner:
            if self.peek() != ")":
                raise _Unread
            self.at += 1
        if not all(choices):
            return None
        return choices[0] if len(choices) == 1 else "(" + " or ".join(choices) + ")"

    def peek(self) -> str:
        return self.pattern[self.at : self.at + 1]

    def sequence(self) -> str | None:
        conditions: list[str] = []
        run = ""
        while self.peek() not in ("", "|", ")"):
            literal, condition = self.atom()
            least = self.repetition()
            if literal is not None and least is None:
                run += literal
                continue
            if run:
                conditions.append(self.contains(run))
                run = ""
            if literal is not None:
                condition = self.contains(literal)
            if condition and least != 0:
                conditions.append(condition)
        if run:
            conditions.append(self.contains(run))
        unique = list(dict.fromkeys(conditions))
        return "(" + " and ".join(unique) + ")" if unique else None

    def contains(self, literal: str) -> str:
        return f"contains({self.text}, {quoted(literal)})"

    def atom(self) -> tuple[str | None, str | None]:
        """A literal character, or the condition of what is none."""
        c = self.peek()
        self.at += 1
        if c == "\\":
            escaped = self.peek()
            self.at += 1
            if escaped in self.CLASSES and escaped:
                return None, None
            if escaped and escaped.isascii() and not escaped.isalnum():
                return escaped, None
            raise _Unread
        if c == "[":
            self.simple_class()
            return None, None
        if c == "(":
            if self.peek() == "?":
                if self.pattern[self.at : self.at + 2] != "?:":
                    raise _Unread
                self.at += 2
            return None, self.alternatives(inner=True)
        if c in ".^$":
            return None, None
        if c in "*+?{":
            raise _Unread
        return c, None

    def simple_class(self) -> None:
        """Passes over a class of characters, ranges and class escapes; refuses nested and intersected ones."""
        if self.peek() == "^":
            self.at += 1
        first = self.at
        while self.peek() != "]" or self.at == first:
            c = self.peek()
            if c in ("", "[", "&") or c == "]":
                raise _Unread
            if c == "\\":
                self.at += 1
                escaped = self.peek()
                if not escaped or not escaped.isascii() or escaped.isalnum() and escaped not in "dDsSwWtnr":
                    raise _Unread
            self.at += 1
        self.at += 1

    def repetition(self) -> int | None:
        """The least number of times of what was just read; None if it is not repeated."""
        c = self.peek()
        if c not in tuple("*+?{"):
            return None
        if c == "{":
            found = re.compile(r"\{(\d{1,6})(,\d{0,6})?\}").match(self.pattern, self.at)
            if not found:
                raise _Unread
            least, self.at = int(found[1]), found.end()
        else:
            least, self.at = int(c == "+"), self.at + 1
        if self.peek() in tuple("?+"):
            self.at += 1  # reluctant or possessive
        if self.peek() in tuple("*{"):
            raise _Unread
        return least
