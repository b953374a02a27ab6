"""The vault of raw values, and restoring them within their scope."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushlake.functions.arrays import interleave, name, quoted
from hushlake.operators.detect import PLACEHOLDER, has_placeholder
from hushlake.operators.mask import ENTITY, NO_ENTITIES, entities_of, rewrite, with_islands
from hushlake.operators.rules import Rule
from hushlake.schemas import VAULT


def islands_table(
    df: DataFrame,
    rules: list[Rule],
    scope: str,
    *,
    text: str = "text",
    external: DataFrame | None = None,
    keys: list[str] | None = None,
    pepper: str = "",
) -> DataFrame:
    """One row for each merged span: keys, scope_id, place, type, value and replacement."""
    kept = list(dict.fromkeys([*(keys or []), text, scope]))
    scoped = df.select(*kept).withColumn("scope_id", F.col(scope).cast("string"))
    found = with_islands(
        scoped, rules, "scope_id", text=text, external=external, keys=keys, pepper=pepper, into="__islands"
    )
    out = [c for c in keys or []]
    return found.filter(F.size("__islands") > 0).select(*out, "scope_id", F.inline("__islands"))


def protect(
    df: DataFrame,
    rules: list[Rule],
    scope: str,
    keys: list[str],
    path: str,
    *,
    text: str = "text",
    external: DataFrame | None = None,
    pepper: str = "",
) -> tuple[DataFrame, DataFrame]:
    """Write masked texts and their vault out of one pass over the texts; give both as stored tables.

    The texts are searched once. A text gives one row for itself and one for
    each distinct value found in it; the rows go to folders of their own,
    ``kind=masked`` and ``kind=vault``, so raw values lie in the vault alone.
    Masked rows keep keys, scope_id, text, replacement_count and entities; the
    vault has a row for each text and value, which ``build_vault`` reduces.
    """
    scoped = df.select(*dict.fromkeys([*keys, text, scope])).withColumn("scope_id", F.col(scope).cast("string"))
    found = with_islands(
        scoped, rules, "scope_id", text=text, external=external, keys=keys, pepper=pepper, into="__islands"
    )
    nothing = {"text": "string", "entities": NO_ENTITIES, "placeholder": "string", "type": "string", "value": "string"}

    def row(kind: str, **given: str) -> str:
        values = {"kind": quoted(kind), **{c: f"cast({given.get(c, 'null')} as {t})" for c, t in nothing.items()}}
        return "named_struct(" + ", ".join(f"'{c}', {v}" for c, v in values.items()) + ")"

    masked = found.select(
        *keys, "scope_id", "__islands", rewrite(text, "__islands").alias("__text"), entities_of("__islands").alias("__entities")
    )
    own = row("masked", text="__text", entities=f"coalesce(__entities, cast(array() as {NO_ENTITIES}))")
    value = row("vault", placeholder="x.replacement", type="x.type", value="x.value")
    rows = f"concat(array({own}), coalesce(array_distinct(transform(__islands, x -> {value})), array()))"
    masked.select(*keys, "scope_id", F.inline(F.expr(rows))).write.mode("append").partitionBy("kind").parquet(path)
    spark = df.sparkSession
    types = ", ".join(f"{name(f.name)} {f.dataType.simpleString()}" for f in scoped.select(*keys).schema)
    stored = spark.read.schema(f"{types}, scope_id string, text string, entities array<{ENTITY}>").parquet(f"{path}/kind=masked")
    stored = stored.withColumn("replacement_count", F.size("entities"))
    return stored, spark.read.schema(VAULT).parquet(f"{path}/kind=vault")


def build_vault(islands: DataFrame) -> DataFrame:
    """One row for each distinct value of a scope. It holds raw values: keep it apart.

    Repeats collapse before the shuffle, so a value that fills a scope is one row.
    """
    placeholder = F.col("placeholder" if "placeholder" in islands.columns else "replacement").alias("placeholder")
    return islands.select("scope_id", placeholder, "type", "value").distinct()


def vault_collisions(vault: DataFrame) -> DataFrame:
    """Placeholders that stand for more than one value of their scope."""
    return (
        vault.select("scope_id", "placeholder", "value")
        .distinct()
        .groupBy("scope_id", "placeholder")
        .agg(F.count(F.lit(1)).alias("n_values"))
        .filter(F.col("n_values") > 1)
    )


def _unambiguous(vault: DataFrame) -> DataFrame:
    """Placeholders with exactly one value; the others are never restored."""
    bounds = vault.groupBy("scope_id", "placeholder").agg(
        F.min("value").alias("__value"), F.max("value").alias("__other")
    )
    return bounds.filter(F.col("__value") == F.col("__other")).drop("__other")


def restore(
    df: DataFrame, vault: DataFrame, keys: list[str], *, text: str = "text", scope: str = "scope_id", entities: str | None = None
) -> DataFrame:
    """Put values back for the placeholders of the same scope; unknown ones stay.

    ``keys`` must name one text. Only rows that hold a placeholder are joined.
    The lookup joins on (scope, placeholder), so neither a large scope nor its
    values are ever gathered; what is gathered is one text's own placeholders.
    The texts are read for each of the three steps: pass a stored table. Where
    ``entities`` names the stored list of what was replaced in a text, that says
    which placeholders are wanted, and only texts with some are read twice.
    """
    col = name(text)
    marks = f"regexp_extract_all({col}, {quoted(PLACEHOLDER)}, 0)"
    if entities is None:
        has, listed = F.expr(has_placeholder(col)), f"array_distinct({marks})"
    else:
        has, listed = F.size(entities) > 0, f"array_distinct({name(entities)}.replacement)"
    marked, plain = df.filter(has), df.filter(~F.coalesce(has, F.lit(False)))
    wanted = marked.select(
        *keys, F.col(scope).cast("string").alias("scope_id"), F.explode(F.expr(listed)).alias("placeholder")
    )
    found = (
        wanted.join(_unambiguous(vault), ["scope_id", "placeholder"])
        .groupBy(*keys)
        .agg(F.map_from_entries(F.collect_list(F.struct("placeholder", "__value"))).alias("__known"))
    )
    values = f"transform({marks}, m -> coalesce(try_element_at(__known, m), m))"
    whole = interleave(f"split({col}, {quoted(PLACEHOLDER)}, -1)", values)
    joined = marked.join(found, keys, "left").withColumn(
        text, F.expr(f"if(__known is null, {col}, {whole})")
    )
    return joined.select(*df.columns).unionByName(plain)
