"""Masking as a policy document says: its rules, its type switches and its flags."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushlake.operators.mask import Policy, mask, role_in_scope
from hushlake.operators.policy import effective_types
from hushlake.operators.rules import Rule, load_rules


@dataclass(frozen=True)
class Protection:
    """What a policy document asks for."""

    policy: Policy
    rules: list[Rule]
    types_off: list[str]


def read_protection(policies: DataFrame) -> Protection:
    """The first of decoded policy documents. A policy is configuration: it is read to the driver whole."""
    one = policies.limit(1)
    flags = one.select("enabled", "redact_ai_answers", "redact_system_messages").first()
    rules = load_rules(one.select(F.posexplode("rules").alias("pos", "rule")).select("pos", "rule.*"))
    switches = one.select(F.posexplode("entity_types").alias("pos", "switch")).select("pos", "switch.*")
    off = effective_types(switches).filter("NOT enabled").select("type").collect()
    return Protection(Policy(*flags), rules, sorted(r.type for r in off))


def mask_with_policy(
    df: DataFrame,
    policies: DataFrame,
    scope: str,
    *,
    text: str = "text",
    role: Column | None = None,
    external: DataFrame | None = None,
    keys: list[str] | None = None,
    pepper: str = "",
) -> DataFrame:
    """Mask as a decoded policy says. With ``role``, its flags decide whose content is masked.

    Types that are switched off are left out of a detector's spans; rules obey their own switch only.
    """
    wanted = read_protection(policies)
    if external is not None and wanted.types_off:
        external = external.filter(~F.coalesce(F.col("type").isin(wanted.types_off), F.lit(False)))
    where = None if role is None else role_in_scope(role, wanted.policy)
    return mask(
        df, wanted.rules, scope, text=text, policy=wanted.policy, where=where, external=external, keys=keys, pepper=pepper
    )
