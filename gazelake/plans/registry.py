"""Named queries, each with its SQL twin where there is one."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql
        return function
    return add


def r6(c) -> Column:
    """Six digits, no negative zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6) + F.lit(0.0)


def ints(values) -> Column:
    """An integer array as text."""
    return F.array_join(F.transform(values, lambda v: v.cast("string")), ",")


def fixed(values, digits=4) -> Column:
    """A coordinate array as text of scaled integers."""
    return F.array_join(F.transform(values, lambda v: F.round(v * F.lit(10.0 ** digits)).cast("bigint").cast("string")), ",")


def sql_fixed(values, digits=4) -> str:
    return f"array_to_string(list_transform({values}, lambda v: round(v * {10 ** digits}.0::double)::bigint), ',')"


def sql_r6(e) -> str:
    return f"round({e}, 6) + 0e0"


def sql_text(template: str, *values: str) -> str:
    """A printf template as a SQL expression; each ``%d`` or ``%s`` takes the next SQL value."""
    pieces = re.split("%[ds]", template)
    literals = ["'" + piece.replace("'", "''").replace("\n", "' || chr(10) || '") + "'" for piece in pieces]
    filled = [x for piece, value in zip(literals, [*[f"({v})" for v in values], None]) for x in (piece, value) if x]
    return " || ".join(filled)
