"""Chains of text steps, usable as a Spark Column and as DuckDB SQL.

A step is ("text", old, new), ("regex", pattern, replacement) or ("arguments", pattern, separator): each match becomes its
first group, with every bar in it turned into the separator. Patterns use no look-around and no back-references, so
Java and RE2 read them alike; groups are written $1. Both forms stay in the JVM and in one projection.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Step = tuple[str, str, str]


def text(*pairs: tuple[str, str]) -> list[Step]:
    return [("text", a, b) for a, b in pairs]


def regex(*pairs: tuple[str, str]) -> list[Step]:
    return [("regex", a, b) for a, b in pairs]


def arguments(pattern: str, separator: str = " ") -> list[Step]:
    return [("arguments", pattern, separator)]


def run(column: Column, steps: list[Step]) -> Column:
    for kind, old, new in steps:
        if kind == "text":
            column = F.replace(column, F.lit(old), F.lit(new))
        elif kind == "regex":
            column = F.regexp_replace(column, F.lit(old), F.lit(new))
        else:
            column = F.transform(F.array(column), _joined(old, new))[0]  # an array of one, so that the column is evaluated once
    return column


def _joined(pattern: str, separator: str) -> Callable[[Column], Column]:
    def of(x: Column) -> Column:
        groups = F.transform(F.regexp_extract_all(x, F.lit(pattern), F.lit(1)), lambda g: F.replace(g, F.lit("|"), F.lit(separator)))
        return F.array_join(F.zip_with(F.split(x, pattern, -1), groups, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")

    return of


def literal(value: str) -> str:
    """A DuckDB string literal; control characters by chr()."""
    parts = re.split(r"([\x00-\x1f])", value)
    quoted = [f"chr({ord(p)})" if len(p) == 1 and ord(p) < 32 else "'" + p.replace("'", "''") + "'" for p in parts if p != ""]
    return "(" + " || ".join(quoted) + ")" if quoted else "''"


def sql(expression: str, steps: list[Step]) -> str:
    for kind, old, new in steps:
        if kind == "text":
            expression = f"replace({expression}, {literal(old)}, {literal(new)})"
        elif kind == "arguments":
            parts = f"list_zip(string_split_regex(x, {literal(old)}), list_transform(regexp_extract_all(x, {literal(old)}, 1), lambda g: replace(g, '|', {literal(new)})))"
            expression = f"list_transform([{expression}], lambda x: array_to_string(list_transform({parts}, lambda z: z[1] || coalesce(z[2], '')), ''))[1]"
        else:
            expression = f"regexp_replace({expression}, {literal(old)}, {literal(re.sub(r'[$]([0-9])', r'\\' + r'\1', new))}, 'g')"
    return expression
