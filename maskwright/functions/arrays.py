"""SQL expression builders for array work.

Nested array lambdas are written as Spark SQL text and parsed once with ``F.expr``:
building the same tree call by call costs seconds on the driver. Arguments named
``values``, ``text`` and so on are SQL expressions, most often plain column names.
"""

from __future__ import annotations

CHUNK = 32


def sql_string(value: str) -> str:
    """A Spark SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def let(name: str, value: str, body: str) -> str:
    """Evaluate ``value`` once per row and refer to it as ``name`` in ``body``.

    A column expression used twice, or inside a lambda, is evaluated again each time;
    a lambda variable over a one-element array is not.
    """
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def total(values: str) -> str:
    """Sum of an int array (0 when empty)."""
    return f"aggregate({values}, 0, (tot, add) -> tot + add)"


def chunked(values: str, size: int = CHUNK) -> str:
    """Cut a non-empty array into consecutive slices of ``size`` elements."""
    return f"transform(sequence(1, size({values}), {size}), at -> slice({values}, at, {size}))"


def _running(values: str) -> str:
    """One step an element; the array so far is copied in each, so this is for short arrays."""
    return (f"aggregate({values}, cast(array() as array<int>), (run, add) -> "
            "array_append(run, coalesce(try_element_at(run, -1), 0) + add))")


def prefix_sums(values: str, levels: int = 2) -> str:
    """Inclusive prefix sums of an int array.

    Running sums are taken inside slices of CHUNK elements; the slice totals are
    summed the same way one level up and added back. Work per element is then bound
    by CHUNK, so long documents stay close to linear, and no shuffle is needed. Arrays of
    one slice, which most are, are summed straight away.
    """
    v, local, sums = f"ps{levels}", f"local{levels}", f"sums{levels}"
    if levels == 0:
        return _running(values)
    added = (
        f"flatten(transform({local}, (part, k) -> "
        + let("base", f"coalesce(get({sums}, k - 1), 0)", "transform(part, v -> v + base)") + "))")
    slices = f"transform({chunked(v)}, piece -> {_running('piece')})"
    body = let(local, slices, let(
        sums, prefix_sums(f"transform({local}, part -> element_at(part, -1))", levels - 1), added))
    return let(v, values, f"case when size({v}) <= {CHUNK} then {_running(v)} else {body} end")
