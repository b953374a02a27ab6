"""Array expressions that stay linear in the length of the array.

They are SQL text, as ``functions.expr`` takes it: a long expression is then
sent to the JVM and parsed there once, instead of being put together call by
call from Python.
"""

from __future__ import annotations

from collections.abc import Callable

BLOCK = 128


def quoted(value: str) -> str:
    """A SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def name(column: str) -> str:
    """A column reference."""
    return "`" + column.replace("`", "``") + "`"


def let(value: str, variable: str, body: str) -> str:
    """``body`` with ``variable`` standing for ``value``, which is computed once."""
    return f"transform(array({value}), {variable} -> {body})[0]"


def scan_before(values: str, zero: str, step: Callable[[str, str], str]) -> str:
    """For each element, the fold of ``zero`` and all elements before it.

    ``step`` must be associative and ``zero`` neutral to it. Appending to an
    array copies it, so a plain fold is quadratic; long arrays are folded in
    blocks, the block results are folded once more, and each block starts from
    what precedes it.
    """

    def grow(items: str, start: str) -> str:
        # One element more than items: the start and every fold after it.
        return f"aggregate({items}, array({start}), (a, x) -> concat(a, array({step('element_at(a, -1)', 'x')})))"

    blocks = f"transform(sequence(0, greatest(size(vs) - 1, 0), {BLOCK}), i -> slice(vs, i + 1, {BLOCK}))"
    totals = f"transform(bs, b -> aggregate(b, {zero}, (a, x) -> {step('a', 'x')}))"
    carried = f"slice({grow(totals, zero)}, 1, size(bs))"
    each = f"flatten(zip_with(bs, {carried}, (b, c) -> slice({grow('b', 'c')}, 1, size(b))))"
    return let(values, "vs", let(blocks, "bs", each))


def interleave(parts: str, between: str) -> str:
    """Join n+1 string parts with the n strings that stand between them."""
    return f"array_join(flatten(zip_with({parts}, {between}, (p, q) -> array(p, coalesce(q, '')))), '')"
