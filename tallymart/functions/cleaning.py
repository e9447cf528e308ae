"""Value expressions the cleaning rules use, as Spark SQL text.

SQL text rather than ``Column`` objects: a rule list is then plain data that
can be written down, compared and logged before any session exists.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence


def _literal(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def below(column: str, bound: str) -> str:
    return f"{column} < {bound}"


def at_most(column: str, bound: str) -> str:
    return f"{column} <= {bound}"


def outside(column: str, low: str, high: str) -> str:
    """True outside the closed range; a null is neither inside nor outside."""
    return f"{column} NOT BETWEEN {low} AND {high}"


def not_above(column: str, bound: str) -> str:
    """True unless ``column > bound`` holds, so true for null as well."""
    return f"NOT coalesce({column} > {bound}, false)"


def not_among(column: str, allowed: Sequence[str]) -> str:
    return f"{column} NOT IN ({', '.join(_literal(v) for v in allowed)})"


def standardised(column: str, words: Mapping[str, str], codes: Sequence[str]) -> str:
    """Map spelled-out ``words`` (any case, outer spaces ignored) to their code.

    A value that already is one of ``codes``, exactly, stays; anything else
    becomes null.
    """
    entries = ", ".join(f"{_literal(w)}, {_literal(c)}" for w, c in words.items())
    kept = ", ".join(_literal(c) for c in codes)
    return (
        f"coalesce(try_element_at(map({entries}), upper(trim({column}))), "
        f"if({column} IN ({kept}), {column}, null))"
    )
